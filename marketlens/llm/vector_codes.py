"""Vector code compression (product quantisation) by a lexicographic trie over distinct parts.

Vectors are turned into integers and cut into equal parts; each part position has a codebook that a fixed number of
rounds improves. Distinct parts with their counts are made once (partial counts before the shuffle, so a vector that a
third of all rows repeat costs one row a task) and dealt by their lexicographic order, so that neighbours in a task
share long prefixes. A task walks the trie of its parts depth first: a node holds the distances of its prefix to every
entry, added up over the dimensions so far; its children add one dimension to a copy of it, and a branch with few
leaves is finished as one block. Leaves take the nearest entry and add their count and count-weighted components to its
sums. Only sums by entry leave the tasks; the codebooks (positions x entries x dimensions, fixed size) are all that the
driver and the tasks' closures hold.

Results for odd rows: vectors that are null or hold null, NaN or infinite components are dropped. Components beyond
``LARGEST`` count as it, as squared distances of larger ones don't fit a long. Rows with another number of components
than the row of the least id, or whose number of components isn't a multiple of the parts, keep null codes and errors
and teach nothing. Rows that repeat an id are rows of their own (the first codebooks take ids in order, nulls last, ties
by components). With fewer rows than entries, the codebook is as short. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import fresh_names, shared_folder, ship

#: Components as integers stay within this: a squared distance over 64 dimensions then fits a long.
LARGEST = 1 << 27
#: Children are made and leaves finished in blocks of so many, which bounds a task's memory.
BLOCK = 2_048
#: A branch is walked into if it has more leaves than this; others are finished as part of a block.
BUSHY = 24
#: Parts, or rows, that a task puts into one trie.
TRIE_PARTS, TRIE_ROWS = 65_536, 16_384
_EXACT = 1 << 52


@dataclass(frozen=True)
class Codebooks:
    """``entries[position]`` is an array of (entry, dimension), all integers."""

    entries: np.ndarray

    def text(self) -> str:
        """All components as decimals by position, entry and dimension, joined by commas."""
        return ",".join(map(str, self.entries.ravel().tolist()))


def integers(vector: Column, scale: int = 1_024) -> Column:
    """floor(scale * component) of a vector without null or non-finite components; null for other vectors."""
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    one = lambda v: F.greatest(F.least(F.floor(v.cast("double") * F.lit(float(scale))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    near = lambda v: F.greatest(F.least(v.cast("double"), F.lit(LARGEST / scale)), F.lit(-LARGEST / scale))
    return F.when(whole, F.transform(vector, lambda v: one(near(v))))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, the nearest entry for each row of ``parts``, which are distinct and sorted.

    Walks their trie depth first with a stack of (first leaf, end, depth, distances of the prefix to each entry).
    Ties go to the lower index. Sums of products are taken in doubles where all of them are below 2^52, hence exact.
    """
    m, d = parts.shape
    code, dist = np.zeros(m, np.int64), np.zeros(m, np.int64)
    if not m:
        return code, dist
    most = int(max(np.abs(parts).max(), np.abs(book).max()))
    kind = np.float64 if d * 4 * most * most < _EXACT else np.int64
    p, c = parts.astype(kind), book.astype(kind)
    c2 = np.flip(np.cumsum(np.flip(c * c, 1), 1), 1)  # squares of an entry from a dimension on

    def finish(rows: np.ndarray, depth: int, so_far: np.ndarray) -> None:
        for a in range(0, len(rows), BLOCK):
            r = rows[a : a + BLOCK]
            total = so_far if so_far.ndim == 1 else so_far[a : a + BLOCK]
            if depth < d:
                tail = p[r, depth:]
                total = total + (tail * tail).sum(1)[:, None] - 2 * (tail @ c[:, depth:].T) + c2[:, depth]
            else:
                total = np.broadcast_to(total, (len(r), len(c)))
            code[r] = best = total.argmin(1)
            dist[r] = total[np.arange(len(r)), best].astype(np.int64)

    stack = [(0, m, 0, np.zeros(len(c), kind))]
    while stack:
        first, end, depth, so_far = stack.pop()
        column = parts[first:end, depth]
        starts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [end - first]])
        bushy = np.diff(starts) > BUSHY
        few = np.repeat(~bushy, np.diff(starts))
        if few.any():
            finish(first + np.flatnonzero(few), depth, so_far)
        for k in np.flatnonzero(bushy)[::-1]:
            child = so_far + (p[first + starts[k], depth] - c[:, depth]) ** 2
            lo, hi = first + int(starts[k]), first + int(starts[k + 1])
            if depth + 1 == d:
                finish(np.arange(lo, hi), d, child)
            else:
                stack.append((lo, hi, depth + 1, child))
    return code, dist


def _in_order(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and for each row which of them it is."""
    order = np.lexsort(parts.T[::-1])
    s = parts[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]).any(1)]) if len(s) else np.zeros(0, bool)
    which = np.empty(len(s), np.int64)
    which[order] = np.cumsum(new) - 1
    return s[new], which


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _parts(x: str, n_parts: int, width: int) -> Column:
    return F.array(*(F.slice(x, 1 + k * width, width) for k in range(n_parts)))


def _sums(parts: DataFrame, books: np.ndarray) -> DataFrame:
    """Per position and entry: how many rows chose it, and the sums of their components."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, TRIE_PARTS):
            position, n, rows = t["position"].to_numpy(), t["n"].to_numpy(), _matrix(t["part"], width)
            for k in np.unique(position):
                own, weight = rows[position == k], n[position == k]
                leaves, which = _in_order(own)
                code = nearest(leaves, books[k])[0][which]
                order = np.argsort(code, kind="stable")
                entry, at = np.unique(code[order], return_index=True)
                total = np.add.reduceat(own[order] * weight[order, None], at, axis=0)
                yield pa.RecordBatch.from_pydict(
                    {"position": pa.array(np.full(len(entry), k, np.int32)), "entry": pa.array(entry.astype(np.int32)),
                     "n": pa.array(np.add.reduceat(weight[order], at)), "total": pa.array(total.tolist(), pa.list_(pa.int64()))}
                )

    found = parts.mapInArrow(run, "position int, entry int, n long, total array<long>")
    exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    return found.groupBy("position", "entry").agg(F.sum("n").alias("n"), *exact)


def fit(vectors: DataFrame, x: str, row_id: str, n_parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Learns codebooks from integer vectors ``x`` (all of one length, a multiple of ``n_parts``)."""
    spark = vectors.sparkSession
    ship(spark)
    order = [F.col(row_id).asc_nulls_last(), F.col(x)]
    first = [r[0] for r in vectors.orderBy(*order).select(x).limit(entries).collect()]
    width = len(first[0]) // n_parts
    books = np.array(first, np.int64).reshape(len(first), n_parts, width).transpose(1, 0, 2).copy()
    parts = vectors.select(F.posexplode(_parts(x, n_parts, width)).alias("position", "part")).groupBy("position", "part").agg(F.count(F.lit(1)).alias("n"))
    folder = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    parts.repartitionByRange("position", "part").sortWithinPartitions("position", "part").write.parquet(folder)
    parts = spark.read.parquet(folder)
    for _ in range(rounds):
        new = books.copy()
        for r in _sums(parts, books).collect():  # positions x entries rows at most
            new[r.position, r.entry] = [int(r[f"t{i}"]) // r.n for i in range(width)]
        books = new
    return Codebooks(books)


def assign(vectors: DataFrame, x: str, books: Codebooks, codes: str = "codes", error: str = "error") -> DataFrame:
    """Adds the nearest entries by position (array<int>) and the sum of squared distances (long). No shuffle: each task
    walks the trie of its own rows' distinct parts. Null vectors get nulls."""
    ship(vectors.sparkSession)
    table, (n_parts, _, width) = books.entries, books.entries.shape
    keep = [c for c in vectors.columns if c not in (codes, error)]
    schema = T.StructType([*(vectors.schema[c] for c in keep), T.StructField(codes, T.ArrayType(T.IntegerType())), T.StructField(error, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, TRIE_ROWS):
            known = t[x].is_valid().to_numpy(zero_copy_only=False)
            rows = _matrix(t[x].drop_null(), n_parts * width) if known.any() else np.zeros((0, n_parts * width), np.int64)
            code, far = np.zeros((len(known), n_parts), np.int32), np.zeros(len(known), np.int64)
            for k in range(n_parts):
                leaves, which = _in_order(rows[:, k * width : (k + 1) * width])
                c, d = nearest(leaves, table[k])
                code[known, k] = c[which]
                far[known] += d[which]
            size = np.where(known, n_parts, 0)
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(~known, False))
            lists = pa.ListArray.from_arrays(ends, pa.array(code[known].ravel()))
            for b in t.select(keep).append_column(codes, lists).append_column(error, pa.array(far, mask=~known)).to_batches():
                yield b

    return vectors.mapInArrow(run, schema)


def compress(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", scale: int = 1_024, n_parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks | None]:
    """(``df`` without the vector, with ``codes`` array<int> and ``error`` long, and the codebooks; None for an empty table)."""
    (x,) = fresh_names(df, "x")
    kept = df.withColumn(x, integers(F.col(vector), scale)).where(F.col(x).isNotNull()).drop(vector)
    head = kept.orderBy(F.col(row_id).asc_nulls_last(), F.col(x)).select(F.size(x)).limit(1).collect()
    length = head[0][0] if head else 0
    if not length or length % n_parts:
        return kept.drop(x, "codes", "error").withColumns({"codes": F.lit(None).cast("array<int>"), "error": F.lit(None).cast("long")}), None
    fits = kept.withColumn(x, F.when(F.size(x) == length, F.col(x)))
    books = fit(fits.where(F.col(x).isNotNull()), x, row_id, n_parts, entries, rounds)
    return assign(fits, x, books).drop(x), books
