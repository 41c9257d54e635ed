"""Likeness of texts by longest matching blocks, exact, with bounds that spare most pairs the search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.spans import bounded


def normal(c: Column) -> Column:
    """Trimmed and in capitals; null is empty."""
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T of two texts: M characters in longest matching blocks found in turn, T all characters."""
    out, matcher, last = [], SequenceMatcher(), None
    for x, y in zip(a, b, strict=True):
        if y != last:
            matcher.set_seq2(y)  # what is learned of the second text is kept while it stays the same
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype=float)


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two texts, 0 where one is null or empty, else their ratio in normal form."""
    x, y = normal(a), normal(b)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(_ratio(x, y))


def by_length(a: Column, b: Column) -> Column:
    """A bound from above by lengths alone."""
    return 2.0 * F.least(F.char_length(a), F.char_length(b)) / F.greatest(F.char_length(a) + F.char_length(b), F.lit(1))


def _common(x: str, masks: dict[str, int], full: int) -> int:
    """Length of the longest common subsequence of ``x`` and the text of ``masks`` (its places by character), a bit a place:
    matching blocks found in turn are a common subsequence, so they can't hold more."""
    row = full
    for c in x:
        hit = row & masks.get(c, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return (row ^ full).bit_count()


def _at_least(least: float) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        """As ``_ratio`` where that is at least ``least``, else 0: pairs that a bound rules out aren't searched."""
        out, matcher, last, masks, full = [], SequenceMatcher(), None, {}, 0
        for x, y in zip(a, b, strict=True):
            if y != last:
                last, masks, full, ready = y, {}, (1 << len(y)) - 1, False
                for i, c in enumerate(y):
                    masks[c] = masks.get(c, 0) | 1 << i
            r = 2.0 * _common(x, masks, full) / max(len(x) + len(y), 1)
            if r >= least - 1e-9:
                if not ready:
                    matcher.set_seq2(y)
                    ready = True
                matcher.set_seq1(x)
                r = matcher.ratio()
            out.append(r if r >= least else 0.0)
        return pd.Series(out, dtype=float)

    return ratio


def like_pairs(pairs: DataFrame, compared: list[tuple[str, str, float]]) -> DataFrame:
    """Of ``pairs`` those whose columns are at least as like as asked: ``compared`` holds (column, column, least likeness).

    All bounds by length come first, then for each comparison a bound by common subsequences and, on what is left, the exact
    search; a likeness column ``like_<k>`` is added for each comparison. Empty texts are like nothing.
    """
    for a, b, least in compared:
        pairs = pairs.where((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (by_length(normal(F.col(a)), normal(F.col(b))) >= least - 1e-9))
    for k, (a, b, least) in enumerate(compared):
        like = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), _at_least(least)(normal(F.col(a)), normal(F.col(b))))
        pairs = pairs.withColumn(f"like_{k}", like).where(F.col(f"like_{k}") >= least)
    return pairs


#: Texts of one side in a row while lists are compared, and pairs whose bounds are worked out at once.
CHUNK, AT_ONCE = 2048, 1 << 15


def _bounds(xs: list[str], ys: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """For blocks of ``xs``: the first, and lengths of longest common subsequences with all ``ys`` (at most 64 characters each), a
    bit a place as in ``_common``, for many pairs at once."""
    codes: dict[str, int] = {}
    for y in ys:
        for c in y:
            codes.setdefault(c, len(codes))
    masks = np.zeros((len(codes) + 1, len(ys)), np.uint64)  # the last one has no places
    for j, y in enumerate(ys):
        for i, c in enumerate(y):
            masks[codes[c], j] |= np.uint64(1 << i)
    full = np.array([(1 << len(y)) - 1 for y in ys], np.uint64)
    size = max(1, AT_ONCE // max(len(ys), 1))
    for lo in range(0, len(xs), size):
        some = xs[lo : lo + size]
        at = np.full((max(map(len, some)), len(some)), len(codes))
        for k, x in enumerate(some):
            at[: len(x), k] = [codes.get(c, len(codes)) for c in x]
        row = np.full((len(some), len(ys)), ~np.uint64(0))
        for step in at:
            hit = row & masks[step]
            row = row + hit | row - hit
        yield lo, np.bitwise_count(~row & full)


def like_lists(rows: DataFrame, least: float, enough: int | None = None) -> DataFrame:
    """(key, x, y, like) of rows (key, word, xs, ys): all pairs of members of the two lists that are at least as like as asked,
    once for each key. Members are structs with ``text`` (in normal form) and ``words``; a pair that shares several words is put
    out where ``word`` is the least of these. Pairs are made in a task's Python, many at once, and only like ones leave it.
    ``enough``: for a caller that asks no more of a y than whether it has so many; then a row's further xs of it are left out."""
    side = rows.schema["xs"].dataType.elementType, rows.schema["ys"].dataType.elementType
    schema = T.StructType([rows.schema["key"], T.StructField("x", side[0]), T.StructField("y", side[1]), T.StructField("like", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                word, lists = b.column(1)[r].as_py(), (b.column(2)[r].values, b.column(3)[r].values)
                (xs, xw), (ys, yw) = ((v.field("text").to_pylist(), v.field("words").to_pylist()) for v in lists)
                found: list[tuple[int, int, float]] = []
                matcher = SequenceMatcher()
                long = [j for j, y in enumerate(ys) if len(y) > 64]
                short = [j for j, y in enumerate(ys) if len(y) <= 64]
                total = np.array([len(y) for y in ys])
                near: dict[int, list[tuple[float, int]]] = {}
                for lo, common in _bounds(xs, [ys[j] for j in short]) if short else ():
                    sizes = np.array([len(x) for x in xs[lo : lo + len(common)]])[:, None] + total[short][None, :]
                    most = 2.0 * common / np.maximum(sizes, 1)
                    at = np.nonzero(most >= least - 1e-9)
                    for i, j, bound in zip(*(c.tolist() for c in at), most[at].tolist(), strict=True):
                        near.setdefault(short[j], []).append((-bound, lo + i))
                for j in long:
                    masks: dict[str, int] = {}
                    for i, c in enumerate(ys[j]):
                        masks[c] = masks.get(c, 0) | 1 << i
                    bounds = ((-2.0 * _common(x, masks, (1 << len(ys[j])) - 1) / max(len(x) + len(ys[j]), 1), i) for i, x in enumerate(xs))
                    near[j] = [b for b in bounds if -b[0] >= least - 1e-9]
                for j, some in near.items():
                    mine, ready, have = set(yw[j]), False, 0
                    for _, i in sorted(some):
                        if have == enough:
                            break
                        if min(mine.intersection(xw[i])) != word:
                            continue
                        if not ready:
                            matcher.set_seq2(ys[j])  # what is learned of it is kept
                            ready = True
                        matcher.set_seq1(xs[i])
                        like = matcher.ratio()
                        if like >= least:
                            found.append((i, j, like))
                            have += 1
                if found:
                    i, j, like = (list(c) for c in zip(*found, strict=True))
                    key = b.column(0).slice(r, 1).take(pa.array([0] * len(found)))
                    yield pa.RecordBatch.from_arrays([key, lists[0].take(pa.array(i)), lists[1].take(pa.array(j)), pa.array(like)], names=["key", "x", "y", "like"])

    return bounded(rows.select("key", "word", "xs", "ys")).mapInArrow(run, schema)


def single(pairs: DataFrame, key: str) -> DataFrame:
    """Rows of keys that have one row only: an ambiguous match is none. Counted by key, so that no group meets in one task."""
    one = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(key)
    return pairs.join(one, key, "left_semi")

