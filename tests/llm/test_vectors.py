"""Operators 11, 12 and 13 against the library, loops, SQL and a dense eigensolver."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from marketlens.llm import bpe_codec, q_text, q_vectors, vector_codes, whitening
from tests.compare import same

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t ", "Hello  World's 123", "a<|endoftext|>B <|startoftext|><|endoftext|>", "<|endoftext", "İ ΣΑΣ ΌΣΟΣ", "é é ́x ﬁ µª²", "a b c d\x1ce\x85f\x00g", "x" * 30_000, "ab" * 9_000 + "'s don't I'LL we've", "日本語のテキスト" * 400, "naïve-café ÀÉÎ 12,5", "word " * 5_000, "­soft​zero"]


def sha(b: bytes | str) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def test_bpe_equals_library(spark):
    import tokenizers

    path = str(q_text.tokenizer_path("word_bpe_49k.json"))
    t = tokenizers.Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()} | {-i - 1: x for i, x in enumerate(ODD)}
    got = q_vectors.op11_digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        want = len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want, repr(texts[r.doc_id])[:80]


def test_bpe_arrays_other_columns_and_other_files(spark):
    import tokenizers

    path = str(q_text.tokenizer_path("byte_bpe_50k.json"))
    t = tokenizers.Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, x, "old", i) for i, x in enumerate(ODD)], "n int, text string, ids string, _x int")
    coded = bpe_codec.encode(df, path)
    assert coded.columns == ["n", "text", "_x", "ids"]
    for r in bpe_codec.decode(coded, path).collect():
        want = t.encode(ODD[r.n] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == (ODD[r.n] or "") and r._x == r.n
    assert bpe_codec.encode(df.limit(0), path).count() == 0
    assert [r.decoded for r in bpe_codec.decode(spark.createDataFrame([(None,)], "ids array<int>"), path).collect()] == [""]


def test_bpe_small_table_and_brute_merges():
    path = str(q_text.tokenizer_path("word_bpe_49k.json"))
    small, large = bpe_codec.Codec(path, 1), bpe_codec.Codec(path)
    text = "merging merges merged, merger; 123abc"
    assert [small.encode(text) for _ in range(3)] == [large.encode(text)] * 3
    m, rng = large.merges, np.random.default_rng(0)
    for word in ("".join(rng.choice(list("abcdeilnrst"), size=int(n))) for n in rng.integers(1, 30, 300)):
        symbols = [m.vocab[c] for c in word[:-1]] + [m.vocab[word[-1] + m.suffix]]
        while found := [(m.pairs[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in m.pairs]:  # noqa: B905
            k = min(found)[1]
            symbols[k : k + 2] = [m.pairs[symbols[k], symbols[k + 1]][1]]
        assert m.ids(word) == symbols, word


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The contract in plain loops over Python ints."""
    kept = sorted(((i, [math.floor(scale * float(v)) for v in x], label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[r[1][k * w : (k + 1) * w] for k in range(parts)] for r in kept]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    find = lambda k, a: min((far(a, b), e) for e, b in enumerate(books[k]))
    for _ in range(rounds):
        chosen = [[find(k, c[k])[1] for c in cut] for k in range(parts)]
        for k in range(parts):
            new = list(books[k])
            for e in set(chosen[k]):
                own = [c[k] for c, x in zip(cut, chosen[k], strict=True) if x == e]
                new[e] = [sum(v) // len(own) for v in zip(*own, strict=True)]
            books[k] = new
    out, by_label = [], {}
    for r, c in zip(kept, cut, strict=True):
        best = [find(k, c[k]) for k in range(parts)]
        out.append([r[0], "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), r[2]])
        by_label[r[2]] = by_label.get(r[2], 0) + out[-1][2]
    digest = sha(",".join(str(v) for b in books for e in b for v in e))
    return sorted(((i, code, err, by_label[label], digest) for i, code, err, label in out), key=repr)


VEC = "vec_id long, embedding array<float>, label int"


def vectors(n=700, d=16, seed=3, copies=200):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(v)) for v in np.round(rng.normal(size=d) / 8, 2)], int(i % 5) if i % 7 else None) for i in range(n)]
    hot = rows[5][1]
    return rows + [(n + i, hot, 1) for i in range(copies)] + [(-1, None, 1), (-2, [None] * d, 1), (-3, [float("nan")] * d, 1), (-4, [float("inf")] * d, 2), (9_999, [-0.25] * d, None), (9_999, [-0.25] * d, None)]


def test_codes_equal_loops(spark):
    rows = vectors()
    got = q_vectors.op12_digest(spark.createDataFrame(rows, VEC).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_codes(rows)


def test_codes_equal_sql(spark):
    same(q_vectors.op12_vector_codes(spark, SF), q_vectors.ORACLES["op12_vector_codes"], SF)


def test_codes_odd_rows(spark):
    few = [(3, [0.5, -0.5, 0.25, 1.0], 1), (None, [0.5, -0.5, 0.25, 1.0], None), (1, [9.0] * 3, 1), (2, [0.0] * 8, 2), (0, [-0.0001] * 4, 1)]
    got = {r.vec_id: r for r in q_vectors.op12_digest(spark.createDataFrame(few, VEC)).collect()}
    assert got[1].code is None and got[2].error is None and got[0].code == "00000000" and got[3].code == got[None].code and got[0].error == 0
    assert q_vectors.op12_digest(spark.createDataFrame([], VEC)).count() == 0
    assert q_vectors.op12_digest(spark.createDataFrame([(1, None, 1)], VEC)).count() == 0
    huge = q_vectors.op12_digest(spark.createDataFrame([(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1)], VEC)).collect()
    assert {r.error for r in huge} == {0}
    clash = spark.createDataFrame([(1, [0.5] * 4, 1, 2, "k")], "vec_id long, embedding array<float>, codes int, error long, _x string")
    out, books = vector_codes.compress(clash)
    assert out.columns == ["vec_id", "_x", "codes", "error"] and out.first().codes == [0, 0, 0, 0] and books.entries.shape == (4, 1, 1)


@pytest.mark.parametrize("big", [1, 1 << 24])
def test_trie_equals_dense_search(big):
    rng = np.random.default_rng(1)
    parts = np.unique(rng.integers(-3, 4, (3_000, 6)) * big, axis=0)
    book = rng.integers(-3, 4, (40, 6)) * big
    book[7] = book[3]
    code, dist = vector_codes.nearest(parts, book)
    dense = ((parts[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
    assert (dist == dense.min(1)).all() and (code == [list(r).index(min(r)) for r in dense]).all()


def brute_white(rows, most=16, scale=64):
    kept = [(i, [math.floor(scale * float(v)) + 1_000_000 for v in x]) for i, x in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    u = np.array([[(n * v - s) / n for v, s in zip(x, sums, strict=True)] for x in fit])
    cov = u.T @ u / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    dev = {i: sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)) for i, x in kept}
    white = {i: np.array([(n * v - s) / n for v, s in zip(x, sums, strict=True)]) @ axes / np.sqrt(values) for i, x in kept}
    return n, dev, white, values / np.trace(cov)


@pytest.mark.parametrize("source", ["table", "made"])
def test_whitening_equals_dense_solver(spark, source):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()] if source == "table" else [r[:2] for r in vectors(d=20)[:-1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    n, dev, white, explained = brute_white(rows)
    got = q_vectors.op13_digest(df).collect()
    assert len(got) == 16 * len(white) and {r.n for r in got} == {n}
    sign: dict[int, float] = {}
    for r in sorted(got, key=lambda r: -abs(white[r.vec_id][r.component - 1])):
        want = white[r.vec_id][r.component - 1]
        s = sign.setdefault(r.component, 1.0 if want * r.whitened > 0 else -1.0)  # one sign for all rows
        assert abs(s * r.whitened - want) < 1e-7 and r.deviation == dev[r.vec_id]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and 0 <= r.identity_error < 1e-8


def test_whitening_odd_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert q_vectors.op13_digest(spark.createDataFrame([], kind)).count() == 0
    assert q_vectors.op13_digest(spark.createDataFrame([(1, None), (2, [None, 1.0])], kind)).count() == 0
    one = q_vectors.op13_digest(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], kind)).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained) for r in one} == {(1, 0, 0.0, 0.0)}
    mixed, w = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [1.0]), (4, [3e38, 2.0])], kind))
    rows = {r.vec_id: r for r in mixed.collect()}
    assert w.n == 3 and rows[3].whitened is None and rows[3].deviation is None and rows[1].whitened[1] == 0.0 and all(np.isfinite(rows[4].whitened))
    clash = spark.createDataFrame([(1, [1.0], 1, 2, 3)], kind + ", whitened int, deviation int, _x int")
    assert whitening.whiten(clash)[0].columns == ["vec_id", "_x", "whitened", "deviation"]


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [2, 2, 2, 1, 1], [1, 1, 1, 1, 1], [1, 0, 0, 0, 0], [1, 1e-6, 1e-12, 1e-14, 0], [1, 1 - 1e-13, 1 - 2e-13, 0.5, 0.5]])
def test_spectral_division(values):
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(5, 5)))
    a = (q * np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    got, axes = whitening.components(a)
    assert np.allclose(got, sorted(values, reverse=True), atol=1e-14) and np.allclose(axes.T @ axes, np.eye(5), atol=1e-14)
    assert np.abs(a @ axes - axes * got).max() < 1e-14
    u = whitening.polar(a - 0.7 * np.eye(5))
    assert np.allclose(u @ u, np.eye(5), atol=1e-12)
