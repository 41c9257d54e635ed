"""Operators 5, 9 and 10: counts against brute force, planted passages, held-out accuracy; and the pipeline's stages."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import context_mixing, decontaminate, q_models, toxicity
from marketlens.llm.common import remainder

SF = "/root/testdata/sf0.001"


def test_language_model_counts_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()][:80]
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "  \n\t "), (10**6 + 3, "ÀB ab AB unseenword\x0bx"), (10**6 + 3, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, b int")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    toks = [(i, t, [*re.findall("[^\x20\x09-\x0d]+", low(t)), None]) for i, t in docs]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, _, ws in toks if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, _, ws in toks:
        want[(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5))] += 1
    out = context_mixing.score(df, remainder() != 1).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    assert all(r.score < 0 for r in out)
    assert context_mixing.score(df.limit(0), remainder() != 1).count() == 0


def test_language_model_learns(spark):
    out = q_models.op5_context_mixing(spark, "/root/testdata/sf0.01").where("held_out").agg(F.avg("bits_per_byte")).first()[0]
    assert out < 3.0  # letters at random take more than 4


def test_language_model_scores_do_not_depend_on_partitions_and_know_repeated_texts(spark):
    r = random.Random(9)
    some = lambda: " ".join(f"w{r.randrange(800)}" for _ in range(120))
    twice = some()
    rows = [(i, some()) for i in range(60)] + [(100, twice), (102, twice)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append({x.doc_id: x.score for x in context_mixing.score(df.repartition(int(parts)), remainder() != 1).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(found[0][i] == pytest.approx(found[1][i], abs=1e-6) for i in found[0])
    assert max(found[0][100], found[0][102]) > 0.6 * max(found[0][i] for i in range(60))  # log probabilities: nearer to 0


def test_recalled_segments_equal_a_loop():
    import numpy as np

    r = random.Random(3)
    doc = sorted(r.randrange(5) for _ in range(60))
    asked, others, total, spelled = [r.random() < 0.8 for _ in doc], [r.choice([0, 0, 1, 7]) for _ in doc], 1000, [-r.random() * 50 for _ in doc]
    want, past = [], {}
    for d, a, o, s in zip(doc, asked, others, spelled, strict=True):
        if not a:
            want.append(s)
            continue
        bits = past.setdefault(d, [])
        same = [b for k, b in enumerate(bits) if [*[2, 2], *bits][k : k + 2] == [*[2, 2], *bits][-2:]]
        odds = sum(math.log((sum(x) + 0.4) / (len(x) - sum(x) + 0.4)) / 2 for x in (bits, same))
        p = 1 / (1 + math.exp(-odds))
        want.append(math.log10(p) + math.log10(o / total) if o else math.log10(1 - p) + s)
        bits.append(int(o > 0))
    got = context_mixing.recalled(np.arange(len(doc) + 1), np.array(others), np.array(asked), np.array(doc), np.full(len(doc), total), np.array(spelled))
    assert got == pytest.approx(want)


def test_codes_are_prefix_free():
    import numpy as np

    code, length = context_mixing.huffman(np.arange(256.0) ** 3)
    words = sorted(format(int(c), f"0{int(n)}b") for c, n in zip(code, length, strict=True))
    assert all(not b.startswith(a) for a, b in zip(words, words[1:], strict=False)) and sum(2.0 ** -int(n) for n in length) == pytest.approx(1)


def test_leaks_are_found_and_clean_texts_left(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    w = item.split()
    swapped = " ".join("x" if i % 6 == 5 else x for i, x in enumerate(w))
    far = " ".join("x" if i % 2 else x for i, x in enumerate(w))
    texts = [f"before {item.upper()}, after", f"{swapped} after", far, " ".join(w[:12]), "short item here", None, "", " ".join(w[3:17]), "of the and " * 400]
    docs = spark.createDataFrame([(i, t, [7], "k") for i, t in enumerate(texts)], "doc_id long, text string, item_id array<int>, words string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, "short item here"), (4, None), (5, ""), (6, "!!")], "item_id long, text string")
    for block in (4_000_000, 60):
        got = {r.doc_id: r.leaked_items for r in decontaminate.find_leaks(docs, bench, block_chars=block).collect()}
        assert got == {0: [1, 2], 1: [1, 2], 2: [], 3: [], 4: [3], 5: [], 6: [], 7: [1, 2], 8: []}
    assert all(r.leaked_items == [] for r in decontaminate.find_leaks(docs, bench.limit(0)).collect())
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("rules", [decontaminate.Rules(), decontaminate.Rules(window=11, similarity=0.7, exact_below=8)])
def test_every_placement_of_allowed_substitutions_is_found(rules):
    from itertools import combinations

    from marketlens.llm import tokens

    for n in range(4, 16):
        item = [f"w{k}" for k in range(n)]
        block = decontaminate.Block([([1], " ".join(item).encode())], rules)
        shown = min(n, rules.window)
        allowed = shown - rules.needed(shown)
        for first in {0, n - shown}:
            for wrong in range(allowed + 2):
                texts = []
                for places in combinations(range(shown), wrong):
                    said = ["x" if k in places else w for k, w in enumerate(item[first : first + shown])]
                    texts.append(" ".join(["before", *said, "after"]).encode())
                words, begins = tokens.words(texts)
                found = block.leaks(words, begins, rules)
                assert len(found) == (len(texts) if wrong <= allowed else 0), (n, first, wrong)


def test_toxicity_of_unseen_texts(spark):
    r = random.Random(4)
    some = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(40))
    calm = [f"{some()} the report says that work item {i % 17} went well {some()}" for i in range(300)]
    bad = [f"{some()} you are a {('rotten', 'vile', 'nasty')[i % 3]} fool and that is trash!! {some()}" for i in range(300)]
    rows = [(i, t, int(i % 2)) for i, t in enumerate(x for pair in zip(calm, bad, strict=True) for x in pair)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.where(remainder() != 0).select("doc_id", "toxic"))
    assert {"fool", "trash"} & set(model.lexicon)
    out = {r.doc_id: r.toxicity for r in toxicity.score(df, model).collect()}
    wrong = [i for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0 and (out[i] >= 0.5) != bool(y)]
    assert len(wrong) <= 4
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "ID10T!!", "z")], "doc_id long, text string, features string")
    assert [0 <= r.toxicity <= 1 for r in toxicity.score(odd, model).collect()] == [True] * 3
    none = toxicity.fit(df.select("doc_id", "text").limit(0), df.select("doc_id", "toxic").limit(0))
    assert {r.toxicity for r in toxicity.score(odd, none).collect()} == {0.0}


def test_lexicon_learns_from_texts_that_share_a_word(spark):
    least = min((f"w{k}" for k in range(20_000)), key=lambda w: int.from_bytes(toxicity._short_hash(w), "little", signed=True))
    rows = [(f"{least} calm{i} kind", 0) for i in range(200)] + [(f"{least} rude{i} fool", 1) for i in range(200)] + [(f"{least} copied text", 1)] * 40
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert "fool" in lexicon and not {"copied", "text", least} & set(lexicon)


def test_pipeline_stages_keep_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    cols = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == cols
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
