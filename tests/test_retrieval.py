"""Ranked retrieval against brute force and by hand."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marketlens.operators import retrieval as R
from marketlens.session import shared_folder


def brute(text, wanted):
    """Rank and covers by trying every stretch of words."""
    ws = re.findall(r"[^\W_]+", (text or "").lower())
    at = lambda p: [i for i in range(len(ws) - len(p) + 1) if tuple(ws[i : i + len(p)]) == p]
    if any(at(R.word_list(p)) for p in wanted.none):
        return 0.0, 0
    full = [(i, j) for i, j in itertools.combinations_with_replacement(range(len(ws)), 2) if all(any(i <= s and s + len(p) - 1 <= j for p in g for s in at(p)) for g in wanted.groups)]
    covers = [(i, j) for i, j in full if not any((a, b) != (i, j) and i <= a and b <= j for a, b in full)]
    noise = lambda i, j: sum(w not in wanted.vocabulary for w in ws[i : j + 1])
    return sum(0.1 / (1 + noise(i, j)) for i, j in covers), len(covers)


CASES = [
    R.Wanted((("a",),)), R.Wanted((("a",), ("b",))), R.Wanted((("a b",), ("c", "b"))), R.Wanted((("a b c", "d"), ("b",), ("e", "a a"))), R.Wanted((("a",), ("b", "c d")), none=("e d", "b b b")),
]


@pytest.mark.parametrize("wanted", CASES)
def test_cover_density_is_that_of_all_stretches(spark, wanted):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh"[: rng.randint(2, 8)]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    texts += [None, "", "A, B; a-b! C", "b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    got = {r["document_id"]: (r["rank"], r["covers"]) for r in R.rank_pages(df, wanted).collect()}
    want = {i: b for i, t in enumerate(texts) if (b := brute(t, wanted))[1]}
    assert got.keys() == want.keys()
    for i, (rank, covers) in want.items():
        assert covers == got[i][1] and math.isclose(rank, got[i][0], rel_tol=1e-9)


def test_pages_rank_excerpt_scope_and_literal(spark):
    far = "x " * 200
    rows = [
        (1, 1, "supply of oil"), (1, 2, f"{far}supply {far}oil {far}"), (2, 1, "nothing"), (3, 1, "oil supply, oil supply"), (4, 1, "(Supply-of oil!) and"), (5, 1, None), (6, 1, "the OIL-supplies of"), (6, 2, "art. 5 §2 holds"),
    ]
    df = spark.createDataFrame(rows, "document_id long, page_number int, text string").withColumn("rank_note", F.lit("mine"))
    wanted = R.Wanted((("oil",), ("supply",)))
    got = R.retrieve(df, wanted).collect()
    assert [(r["document_id"], r["page_number"]) for r in got] == [(3, 1), (1, 1), (4, 1), (1, 2)]
    assert got[0]["rank"] == pytest.approx(0.3) and got[1]["rank"] == pytest.approx(0.05) and got[0]["rank_note"] == "mine"
    cut = got[3]["excerpt"]
    assert cut.startswith("…") and cut.endswith("…") and "supply" in cut and len(cut) <= R.WIDTH + 2
    scope = spark.createDataFrame([(1,), (1,), (2,)], "document_id long")
    assert [(r["document_id"], r["page_number"]) for r in R.retrieve(df, wanted, scope).collect()] == [(1, 1), (1, 2)]
    also = R.retrieve(df, wanted, literal=" Art. 5 §2 ").collect()
    assert (also[-1]["document_id"], also[-1]["page_number"], also[-1]["rank"]) == (6, 2, 0.0) and len(also) == 5
    assert R.retrieve(df.limit(0), wanted).count() == 0
    with pytest.raises(ValueError):
        R.Wanted((("...",),))


RECORDS = [
    (1, "Supply of heating oil", "Municipality of Oil", "Alpha", ["09100000", "09130000"], "EL30"), (2, "Oil", "City", "Heating Oil Ltd", ["09100000"], "EL41"),
    (3, "heating heating oil oil and a long title of other words", "Port", None, ["45000000"], "EL30"), (4, None, None, None, None, None), (5, "Heating", "Oil company", "Oil heating", ["09", ""], "EL30"),
]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(RECORDS, "id long, title string, buyer string, suppliers string, cpv array<string>, nuts string")
    return R.build(df, "id", texts=("title", "buyer", "suppliers"), codes=("cpv", "nuts"), starts=("suppliers",))


def best_fields(text, boosts):
    """Scores by the formula, record by record."""
    cols, tokens, out = {"title": 1, "buyer": 2, "suppliers": 3}, set(R.word_list(text)), {}
    for f, boost in boosts.items():
        lists = {r[0]: R.word_list(r[cols[f]] or "") for r in RECORDS}
        docs = [v for v in lists.values() if v]
        mean = sum(map(len, docs)) / len(docs)
        for i, ws in lists.items():
            if tokens <= set(ws):
                s = 0.0
                for t in tokens:
                    df, tf = sum(t in d for d in docs), ws.count(t)
                    s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                out[i] = max(out.get(i, (0.0, "")), (boost * s, f))
    return out


def test_fields_need_all_words_and_the_best_counts(spark, index):
    boosts = {"title": 3.0, "buyer": 2.0, "suppliers": 1.0}
    for text in ("heating oil", "OIL oil", "oil company", "nowhere"):
        got = {r["doc_id"]: (r["score"], r["field"]) for r in R.search(index, text, boosts).collect()}
        want = best_fields(text, boosts)
        assert got.keys() == want.keys()
        for i, (score, field) in want.items():
            assert got[i][1] == field and math.isclose(got[i][0], score, rel_tol=1e-9)


def test_filters_codes_beginnings_and_pages(spark, index):
    boosts = {"title": 3.0, "buyer": 2.0, "suppliers": 1.0}
    hits = R.search(index, "oil", boosts)
    ids = lambda d: sorted(r["doc_id"] for r in d.collect())
    assert ids(hits) == [1, 2, 3, 5]
    assert ids(R.having(index, hits, "cpv", "09", prefix=True)) == [1, 2, 5] and ids(R.having(index, hits, "cpv", "09")) == [5]
    assert ids(R.having(index, R.having(index, hits, "nuts", "EL30"), "cpv", "09", prefix=True)) == [1, 5]
    assert ids(R.search(index, "heat", {"suppliers.start": 1.0})) == [2, 5] and ids(R.search(index, "h", {"suppliers.start": 1.0})) == []
    code = R.search(index, "EL41", boosts, {"nuts": 8.0}).collect()
    assert [(r["doc_id"], r["field"]) for r in code] == [(2, "nuts")] and code[0]["score"] == pytest.approx(8 * math.log(1 + 3.5 / 1.5))
    pages = [R.page(hits, o, 3).collect() for o in (0, 3)]
    assert [len(p) for p in pages] == [3, 1] and {r["total"] for p in pages for r in p} == {4}
    scores = [r["score"] for p in pages for r in p]
    assert scores == sorted(scores, reverse=True)


def test_stored_index_gives_the_same_and_opens_few_slots(spark, index):
    stored = R.store(index, f"{shared_folder(spark)}/index-{random.randrange(1 << 60):x}")
    boosts = {"title": 3.0, "buyer": 2.0, "suppliers": 1.0}
    rows = lambda d: sorted((r["doc_id"], round(r["score"], 9), r["field"]) for r in d.collect())
    assert rows(R.search(stored, "heating oil", boosts, {"nuts": 8.0})) == rows(R.search(index, "heating oil", boosts, {"nuts": 8.0}))
    hits = R.search(stored, "oil", boosts)
    assert sorted(r["doc_id"] for r in R.having(stored, hits, "nuts", "EL30").collect()) == [1, 3, 5]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "slot" in plan.split("PartitionFilters: [")[1].split("]")[0]
