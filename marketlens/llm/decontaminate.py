"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words that a fixed mask keeps of a short run; words under the mask's zeros may differ. All
seeds of the benchmark items meet all seeds of all texts; each hit names a diagonal (a place in the text less a place in
the item), along which the words are compared one by one. A text leaks an item if on a diagonal some ``window`` words in
a row (or the whole item, if it is shorter) agree in a share of ``similarity`` at least; below ``exact_below`` words all
must agree. Masks are made from the rules so that a leak always has a seed: the shortest run that may hold as many wrong
words is cut into pieces, and for every choice of that many pieces a mask keeps the words of all others, so wherever the
wrong words stand, some mask keeps none of them. Substituted words are thus tolerated, in seeds as in the check; inserted ones start another diagonal.

The texts are read once for each block of the benchmark: items are dealt into blocks of about ``block_chars`` characters,
and a block (its words and seeds) is all that is broadcast. No text is shuffled.

Words are lower-cased runs of letters, digits and bytes from 0x80 on. Null and empty texts or items leak nothing; items
with the same text share their fate; an item without words is never found; an empty benchmark leaves every text clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import tokens
from marketlens.llm.common import chunks, short_batches

#: Masks of kept (1) and ignored (0) words are made for a run at most, where its pieces allow it.
MOST_MASKS = 12
#: Words of a run that a seed keeps where all must agree.
RUN = 6


class Rules(NamedTuple):
    window: int = 13
    similarity: float = 0.8
    exact_below: int = 10

    def needed(self, n: int) -> int:
        """Words that must agree among ``n`` in a row."""
        return n if n < self.exact_below else int(np.ceil(self.similarity * n - 1e-9))


@lru_cache(maxsize=256)
def _masks_for(n: int, rules: Rules) -> tuple[str, ...]:
    """Masks of which one at least keeps right words only, however the words that may be wrong lie in an item of ``n`` words."""
    n = min(rules.window, n)
    wrong = n - rules.needed(n)
    if not wrong:
        return ("1" * min(n, RUN),)
    n = min(k for k in range(rules.exact_below, n + 1) if k - rules.needed(k) == wrong)
    pieces = max(k for k in range(wrong + 1, n + 1) if k == wrong + 1 or comb(k, wrong) <= MOST_MASKS)
    ends = [n * k // pieces for k in range(pieces + 1)]
    masks = set()
    for out in combinations(range(pieces), wrong):
        masks.add("".join(("0" if k in out else "1") * (ends[k + 1] - ends[k]) for k in range(pieces)).strip("0"))
    return tuple(sorted(masks))


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each place of ``words``; the mask's own number goes in, so that masks don't meet."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, int(mask, 2) % (1 << 64), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            acc *= np.uint64(0x9FB21C651E98DF25)
            acc += words[k : k + n]
            acc ^= acc >> np.uint64(29)
    return acc


class Block:
    """Words and seeds of some benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[list[int], bytes]], rules: Rules):
        self.ids = [i for i, _ in items]
        words, begins = tokens.words([t for _, t in items]) if items else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.words, self.begins = words, begins
        key, item, pos = [], [], []
        self.masks: set[str] = set()
        for i in range(len(items)):
            w = words[begins[i] : begins[i + 1]]
            for m in _masks_for(len(w), rules) if len(w) else []:
                self.masks.add(m)
                s = _seeds(w, m)
                key.append(s)
                item.append(np.full(len(s), i, np.int32))
                pos.append(np.arange(len(s), dtype=np.int32))
        self.key = np.concatenate(key) if key else np.zeros(0, np.uint64)
        order = np.argsort(self.key, kind="stable")
        self.key = self.key[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int32)
        self.pos = np.concatenate(pos)[order] if pos else np.zeros(0, np.int32)
        self.bits = max(16, int(len(self.key)).bit_length() + 3)
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(tokens.mix(self.key) >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Distinct rows (text, item, diagonal) where a seed of a text is one of the block."""
        found = [np.zeros((0, 3), np.int64)]
        for m in sorted(self.masks):
            s = _seeds(words, m)
            at = np.flatnonzero(self.filter[(tokens.mix(s) >> np.uint64(64 - self.bits)).astype(np.int64)])
            lo, hi = np.searchsorted(self.key, s[at], "left"), np.searchsorted(self.key, s[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            text = np.searchsorted(begins, at, "right") - 1
            inside = at + len(m) <= begins[text + 1]
            at, lo, hi, text = at[inside], lo[inside], hi[inside], text[inside]
            n = hi - lo
            seed = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text, at = np.repeat(text, n), np.repeat(at, n)
            found.append(np.unique(np.stack([text, self.item[seed], at - begins[text] - self.pos[seed]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def leaks(self, words: np.ndarray, begins: np.ndarray, rules: Rules) -> dict[int, dict[int, float]]:
        """For each text that leaks: item to the best share of agreeing words in a window."""
        out: dict[int, dict[int, float]] = {}
        for text, item, d in self.hits(words, begins).tolist():
            t, w = words[begins[text] : begins[text + 1]], self.words[self.begins[item] : self.begins[item + 1]]
            lo, hi = max(0, -d), min(len(w), len(t) - d)
            n = min(rules.window, len(w))
            if hi - lo < n:
                continue
            sums = np.concatenate([[0], np.cumsum(t[lo + d : hi + d] == w[lo:hi])])
            best = int((sums[n:] - sums[:-n]).max())
            if best >= rules.needed(n):
                mine = out.setdefault(text, {})
                mine[item] = max(mine.get(item, 0.0), best / n)
        return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int, rules: Rules) -> Iterator[Block]:
    """The benchmark in blocks of a bounded size; items of one text are one."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t")).where("t <> ''")
    items = items.groupBy("t").agg(F.array_sort(F.collect_set("i")).alias("ids"))
    total = items.agg(F.sum(F.char_length("t") + 8 * F.size("ids"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b).orderBy("t").collect()
        yield Block([(r.ids, r.t.encode()) for r in rows], rules)


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rules: Rules | None = None, block_chars: int = 4_000_000) -> DataFrame:
    """``df`` with leaked_items (sorted ids of the items it leaks) and leaked_share (the best share of agreeing words)."""
    rules = rules or Rules()
    names = [c for c in df.columns if c not in ("leaked_items", "leaked_share")]
    out = df.select(*names).withColumn("leaked_items", F.array().cast("array<bigint>")).withColumn("leaked_share", F.lit(0.0))
    schema = T.StructType([*df.select(*names).schema.fields, T.StructField("leaked_items", T.ArrayType(T.LongType())), T.StructField("leaked_share", T.DoubleType())])
    spark = df.sparkSession
    for block in _blocks(benchmark, item_id, item_text, block_chars, rules):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for b in batches:
                texts = [(x or "").lower().encode() for x in b.column(names.index(text)).to_pylist()]
                items, share = b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()
                for first, last in chunks(texts):
                    words, begins = tokens.words(texts[first:last])
                    for k, found in block.leaks(words, begins, rules).items():
                        items[first + k] = sorted({*items[first + k], *(i for x in found for i in block.ids[x])})
                        share[first + k] = max(share[first + k], *found.values())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(items, pa.list_(pa.int64())), pa.array(share, pa.float64())], names=[*names, "leaked_items", "leaked_share"])

        out = short_batches(out).mapInArrow(run, schema)
    return out
