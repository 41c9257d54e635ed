"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is a sequence of words. Its k-mers (runs of ``SHINGLE`` words) are labelled with how often they came before, so
that all are different. For each of ``SKETCHES`` hash functions the two labelled k-mers of least hash are kept in text
order; such a pair of two documents agrees with a probability that falls as k-mers differ or change places, which makes it
sensitive to edit similarity. Documents that share a pair are candidates; copies of one text count as one. A candidate pair
is verified by aligning the two sequences of words: L is the length of their longest common subsequence within the band of
diagonals that the wanted similarity allows (an alignment that good can't leave it), and L / max(a, b) must be at least
``SIMILARITY`` for texts of a and b words. A twentieth of words changed anywhere in a text leaves 0.95.

With words changed independently, a pair at similarity 0.95, 0.9 and 0.85 shares a sketch with a chance of 1.00, 0.95 and
0.74; changes in runs, as edits are, leave more k-mers whole. Classes join what is linked through other copies.

Classes are the components of verified pairs and of equal texts; the least doc_id of a class names it. Null and empty
texts, and texts without words, are never duplicates. Texts of fewer words than a k-mer have one. Rows of one
doc_id and text share a class and are kept or not together; null ids come last in a class. Texts are named by 64-bit hashes.
Other columns pass through ``dedup`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import tokens
from marketlens.llm.common import chunks, cut, fresh_names, hold, short_batches, utf8
from marketlens.llm.near import Texts, classes

SHINGLE = 5
SKETCHES = 16
SIMILARITY = 0.8
#: Longs of a map of bits of a text's labelled words: so many that words of a long text seldom fall together, and few pairs that
#: don't align pass.
WORDS = 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


def labelled(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of ``k`` words of all texts in order, and where each text's begin."""
    words, begins = tokens.words(texts)
    h, begins = tokens.shingles(words, begins, k)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(begins))
    own = tokens.mix(h ^ tokens.mix(doc + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]]) if len(own) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.concatenate([first, [len(own)]])))
    before = np.empty(len(own), np.uint64)
    before[order] = rank.astype(np.uint64)
    return tokens.mix(h + before * _STEP), begins


def sketches(x: np.ndarray, begins: np.ndarray, n: int = SKETCHES) -> np.ndarray:
    """For each text with shingles (others get zeros): the keys of its n pairs of least shingles in text order."""
    counts = np.diff(begins)
    out = np.zeros((len(counts), n), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts, sizes = begins[:-1][full], counts[full]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(n):
        v = x * (tokens.mix(np.asarray([j + 1], np.uint64) * _STEP)[0] | np.uint64(1))  # labelled k-mers are mixed already
        least = np.repeat(np.minimum.reduceat(v, starts), sizes)
        one = np.flatnonzero(v == least)
        v[one] = top
        second = np.repeat(np.minimum.reduceat(v, starts), sizes)
        two = np.flatnonzero((v == second) | (np.repeat(sizes, sizes) == 1))
        # labelled shingles of a text differ, so each text has one place in either list
        first, last = np.minimum(one, two), np.maximum(one, two)
        out[full, j] = tokens.mix(x[first] * np.uint64(0x9FB21C651E98DF25) + tokens.mix(x[last]) + np.uint64(j))
    return out


def alignment(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """L / max(len(a), len(b)) for the longest common subsequence of two sequences of word hashes in the band; 0 if it can't
    reach ``similarity``.

    The subsequence is found with one bit for each place of the longer sequence (bit-parallel dynamic programming).
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    least = math.ceil(similarity * n - 1e-9)
    if not n or m < least:
        return 0.0
    kinds, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    if np.minimum(np.bincount(place[:n], minlength=len(kinds)), np.bincount(place[n:], minlength=len(kinds))).sum() < least:
        return 0.0
    same = a[:m] == b
    head = m if same.all() else int(np.argmin(same))
    same = a[n - m + head :] == b[head:]
    tail = m - head if same.all() else int(np.argmin(same[::-1]))
    x, y = place[head : n - tail].tolist(), place[n + head : n + m - tail].tolist()
    band, shift = n - least, 0
    masks: dict[int, int] = {}
    for i, w in enumerate(x):
        masks[w] = masks.get(w, 0) | 1 << i
    full, window = (1 << len(x)) - 1, (1 << 2 * band + 1) - 1
    row = full
    for j, w in enumerate(y):
        shift = j - band
        hit = masks.get(w, 0) & (window << shift if shift >= 0 else window >> -shift)
        if hit:
            met = row & hit
            row = (row + met | row - met) & full
    length = head + tail + len(x) - row.bit_count()
    return length / n if length >= least else 0.0


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc, id, size, keys) from (doc, text): id names the text, size counts k-mers; rows without words have size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(2))
            size, keys = np.zeros(len(texts), np.int64), np.zeros((len(texts), SKETCHES), np.uint64)
            for lo, hi in chunks(texts):
                x, begins = labelled(texts[lo:hi])
                size[lo:hi], keys[lo:hi] = np.diff(begins), sketches(x, begins)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * SKETCHES), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), lists], names=["doc", "id", "size", "keys"])

    return short_batches(docs).select("doc", F.xxhash64("text").alias("id"), "text").mapInArrow(run, "doc long, id long, size long, keys array<long>")


def parities(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A map of 64 * WORDS bits of each text's labelled words: each turns the bit over that it names. Two maps differ at no more
    bits than words that one text has alone, however long the texts are."""
    n, bits = len(begins) - 1, 64 * WORDS
    at = np.repeat(np.arange(n), np.diff(begins)) * bits + (x % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, size, bits): the number of labelled words of each text, and its map."""
    for b in batches:
        texts = utf8(b.column(1))
        for lo, hi in chunks(texts):
            x, begins = labelled(texts[lo:hi], 1)
            maps = [np.ascontiguousarray(m) for m in parities(x, begins).T]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(begins).astype(np.int64)), *map(pa.array, maps)], names=["id", "size", *(f"bits{k}" for k in range(WORDS))])


def _may_align(x: Column, y: Column) -> Column:
    """Aligned words are common ones; too many that one text has alone, and the texts needn't be aligned."""
    apart = F.lit(0)
    for k in range(WORDS):
        apart = apart + F.bit_count(x[f"bits{k}"].bitwiseXOR(y[f"bits{k}"]))
    return apart <= x["size"] + y["size"] - 2 * F.ceil(SIMILARITY * F.greatest(x["size"], y["size"]) - 1e-9)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = utf8(b.column(2)), utf8(b.column(3))
        share = np.zeros(len(left))
        for lo, hi in chunks([x + y for x, y in zip(left, right, strict=True)]):
            (x, xb), (y, yb) = tokens.words(left[lo:hi]), tokens.words(right[lo:hi])
            for k in range(hi - lo):
                share[lo + k] = alignment(x[xb[k] : xb[k + 1]], y[yb[k] : yb[k + 1]])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share)], names=["a", "b", "similarity"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, id, class_id, kept): one row per document; ``class_id`` is the least doc_id of its class."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = cut(_sketched(plain))
    texts = hold(rows.where("size > 0").groupBy("id").agg(F.first("keys").alias("keys"), F.count("*").alias("times")))

    def prepare(ids: DataFrame) -> Texts:
        # repeats within a task are summed up before whole texts are shuffled
        some = plain.select(F.xxhash64("text").alias("id"), "text").groupBy("id").agg(F.first("text").alias("text"))
        some = hold(some.join(ids, "id", "left_semi"))

        def verify(pairs: DataFrame) -> DataFrame:
            both = pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
            return short_batches(both).select("a", "b", "ta", "tb").mapInArrow(_aligned, "a long, b long, similarity double").where("similarity > 0")

        def words(few: DataFrame) -> DataFrame:
            return short_batches(some.join(few, "id", "left_semi").select("id", "text")).mapInArrow(_worded, "id long, size long, " + ", ".join(f"bits{k} long" for k in range(WORDS)))

        return Texts(ids.select("id", F.lit(0).alias("mark")), lambda x, y: F.lit(True), words, SIMILARITY, verify, _may_align, sure=False)

    comp = classes(texts, prepare)
    named = rows.join(comp, "id", "left").select("doc", "id", "size", F.coalesce("component", "id").alias("component"))
    least = named.where("size > 0").groupBy("component").agg(F.min("doc").alias("class_id"))
    out = named.join(least, "component", "left").withColumn("class_id", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc")))
    return out.select("doc", "id", "class_id", F.col("doc").eqNullSafe(F.col("class_id")).alias("kept"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class; of repeated rows (same id and text) one stays, unless they have no words."""
    doc_, id_, body_ = fresh_names(docs, "doc", "id", "body")
    keep = near_duplicates(docs, doc_id, text).where("kept").select(F.col("doc").alias(doc_), F.col("id").alias(id_)).distinct()
    whole = docs.withColumn(body_, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    out = whole.join(keep, F.col(doc_id).cast("long").eqNullSafe(F.col(doc_)) & (F.col(body_) == F.col(id_)), "left_semi")
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    return out.where(worded).dropDuplicates([doc_id, body_]).unionByName(out.where(~worded)).select(*docs.columns)
