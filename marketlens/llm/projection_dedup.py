"""Near-duplicate vectors by sorted projection passes.

Each pass gives every vector the signs of 62 random projections as one number and sorts vectors of a label by it, most
significant sign first. Vectors are taken relative to their label's mean before they are projected, so that signs also split
vectors that share a direction. In that order each vector is compared with its ``window`` predecessors; pairs with a cosine
of at least ``threshold`` are united over all passes. A first round of passes follows from the largest label: with n vectors,
two at the threshold stand within the window if their first log2(n / window) signs agree, and there are passes until that has
happened with probability ``recall``. As signs may split a label less evenly than that, rounds of half as many passes go on
until one joins no more components.

Links are then counted within each component exactly, also those that no window met: members within half the threshold's
angle of the component's mean are all linked to each other (by the triangle inequality), so a dense group of any size
costs one comparison a member; the others are compared with all members in blocks of bounded size. No pair is emitted.

Vectors link only if their labels are equal and not null and their lengths agree. Vectors that are null, zero, or hold null
or non-finite components link with nothing. Each row is a vector: rows that share a vec_id count each other, and take the
same component_id (the least vec_id of the component). A null vec_id stands for itself if it is alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import cut, ship
from marketlens.llm.components import components

SIGNS = 62
BLOCK = 1024


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector at length 1 in double precision, or null if it can't link. Scaled by its largest component first, so that
    no square over- or underflows."""
    for b in batches:
        out: list[np.ndarray | None] = []
        column = b.column(3).cast(pa.list_(pa.float64()))
        whole, values, at = column.is_valid().to_pylist(), column.values, column.offsets.to_numpy()
        holes, x = values.is_null().to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False)
        for k, ok in enumerate(whole):
            v = x[at[k] : at[k + 1]]
            top = np.abs(v).max() if ok and len(v) else 0.0
            if not ok or not len(v) or holes[at[k] : at[k + 1]].any() or not np.isfinite(v).all() or top == 0:
                out.append(None)
                continue
            v = v / top
            out.append(v / np.sqrt(v @ v))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.float64()))], names=["rid", "vec_id", "label", "x"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, dim, n, total) of a task's vectors (label, x)."""
    total: dict[tuple[str, int], list] = {}
    for b in batches:
        for g, v in zip(b.column(0).to_pylist(), _rows(b.column(1)), strict=True):
            at = total.setdefault((g, len(v)), [0, np.zeros(len(v))])
            at[0] += 1
            at[1] += v
    if total:
        yield pa.RecordBatch.from_pydict({"label": [k[0] for k in total], "dim": [k[1] for k in total], "n": [v[0] for v in total.values()], "total": [v[1] for v in total.values()]}, schema=pa.schema([("label", pa.string()), ("dim", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))]))


def _mean(t: pa.Table) -> pa.Table:
    v = np.sum([v for c in t["total"].chunks for v in _rows(c)], axis=0) / sum(t["n"].to_pylist())
    return pa.table({"label": t["label"][:1], "dim": t["dim"][:1], "mean": pa.array([v], pa.list_(pa.float64()))})


def label_means(vectors: DataFrame) -> DataFrame:
    """(label, dim, mean) of vectors (rid, label, x), summed up within tasks first."""
    sums = vectors.select("label", "x").mapInArrow(_sums, "label string, dim int, n long, total array<double>")
    return sums.groupBy("label", "dim").applyInArrow(_mean, "label string, dim int, mean array<double>")


def passes_for(n: int, window: int, threshold: float, recall: float) -> int:
    """Passes until two vectors at the threshold have been within the window with probability ``recall``."""
    same = 1 - math.acos(threshold) / math.pi
    met = same ** max(0.0, math.log2(max(n, 2) / window))
    return 3 if met >= 0.999 else max(3, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _planes(turn: int, dim: int) -> np.ndarray:
    return np.random.default_rng([turn, dim]).standard_normal((dim, SIGNS))


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    """The vectors of an Arrow column as views of its values."""
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _keys(first: int, to: int):
    weights = (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, means = _rows(b.column(2)), _rows(b.column(3))
            dims = np.asarray([len(r) for r in rows])
            for dim in sorted(set(dims.tolist())):
                at = np.flatnonzero(dims == dim)
                x = np.asarray([rows[i] - means[i] for i in at])
                part = b.take(pa.array(at))
                for turn in range(first, to):
                    key = ((x @ _planes(turn, dim)) > 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), turn, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(key), *part.columns[:3]], names=["turn", "dim", "key", "rid", "label", "x"])

    return run


def _links(x: np.ndarray, ids: np.ndarray, window: int, threshold: float) -> list[tuple[int, int]]:
    """A spanning set of the pairs that are linked and stand within the window of each other."""
    n = len(ids)
    close = x @ x.T >= threshold
    away = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    close &= away <= window
    label = np.arange(n)
    while True:
        least = np.where(close, label[None, :], n).min(1)
        least = np.minimum(label, least)
        if (least == label).all():
            break
        label = least[least]
    return [(int(ids[i]), int(ids[k])) for i, k in enumerate(label.tolist()) if i != k]


def _sweep(window: int, threshold: float):
    """Compares neighbours in sorted partitions; the rows at a partition's ends are passed on to meet the next one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        head: list[tuple] = []
        held: list[tuple] = []

        def edges(rows: list[tuple]) -> list[tuple[int, int]]:
            out, lo = [], 0
            while lo < len(rows):  # a run of one pass, label and length
                hi = lo
                while hi < len(rows) and rows[hi][0] == rows[lo][0]:
                    hi += 1
                out += _links(np.asarray([r[2] for r in rows[lo:hi]]), np.asarray([r[1] for r in rows[lo:hi]]), window, threshold)
                lo = hi
            return out

        def batch(pairs, ends=()):
            n = len(pairs)
            return pa.RecordBatch.from_pydict({
                "a": [p[0] for p in pairs] + [None] * len(ends), "b": [p[1] for p in pairs] + [None] * len(ends),
                "seam": [None] * n + [e[0] for e in ends], "nth": [None] * n + [e[1] for e in ends], "run": [None] * n + [str(e[2]) for e in ends],
                "x": [None] * n + [e[3] for e in ends],
            }, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("seam", pa.int64()), ("nth", pa.int64()), ("run", pa.string()), ("x", pa.list_(pa.float64()))]))

        for b in batches:
            of = lambda c, b=b: b.column(b.schema.names.index(c))
            got = [((t, d, g), r, x) for t, d, g, r, x in zip(*(of(c).to_pylist() for c in ("turn", "dim", "label", "rid")), _rows(of("x")), strict=True)]
            if len(head) < window:
                head += got[: window - len(head)]
            for lo in range(0, len(got), 256):
                rows = held + got[lo : lo + 256]
                yield batch(edges(rows))
                held = rows[-window:]
        ends = [(part - 1, 1 << 20 | i, r[0], r[2], r[1]) for i, r in enumerate(head)] + [(part, i, r[0], r[2], r[1]) for i, r in enumerate(held)]
        if ends:
            yield pa.RecordBatch.from_pydict({"a": [e[4] for e in ends], "b": [None] * len(ends), "seam": [e[0] for e in ends], "nth": [e[1] for e in ends], "run": [str(e[2]) for e in ends], "x": [e[3] for e in ends]}, schema=batch([]).schema)

    return run


def _seam(window: int, threshold: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("nth")
        ids, runs, x = t["a"].to_pylist(), t["run"].to_pylist(), [v for c in t["x"].chunks for v in _rows(c)]
        out = []
        for r in sorted(set(runs)):
            at = [i for i, k in enumerate(runs) if k == r]
            out += _links(np.asarray([x[i] for i in at]), np.asarray([ids[i] for i in at]), window, threshold)
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def linked_pairs(vectors: DataFrame, first: int, to: int, window: int, threshold: float) -> DataFrame:
    """(a, b): pairs of ``rid`` that span what passes ``first`` to ``to`` find among vectors (rid, label, x, mean)."""
    keyed = vectors.select("rid", "label", "x", "mean").mapInArrow(_keys(first, to), "turn int, dim int, key long, rid long, label string, x array<double>")
    order = ["turn", "label", "dim", "key", "rid"]
    swept = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sweep(window, threshold), "a long, b long, seam long, nth long, run string, x array<double>"))
    seams = swept.where("seam is not null").groupBy("seam").applyInArrow(_seam(window, threshold), "a long, b long")
    return swept.where("seam is null").select("a", "b").unionByName(seams).distinct()


def linked_components(vectors: DataFrame, window: int, threshold: float, recall: float) -> DataFrame:
    """(id, component) of all vectors (rid, label, x) that some pass links to another."""
    biggest = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    means = label_means(vectors)
    near = cut(vectors.withColumn("dim", F.size("x")).join(means, ["label", "dim"]))
    done, to = 0, passes_for(biggest, window, threshold, recall)
    comp, joined = None, 0
    while True:
        pairs = linked_pairs(near, done, to, window, threshold)
        if comp is not None:
            pairs = pairs.unionByName(comp.select(F.col("id").alias("a"), F.col("component").alias("b")))
        comp = components(pairs)
        now = comp.where("id <> component").count()
        if done and now == joined:
            return comp
        done, to, joined = to, to + max(3, -(-to // 2)) if not done else to + (to - done), now


def _count(threshold: float):
    """Links of the rows to be counted (side 0) with a block of members (side 1): (rid, links)."""

    def run(t: pa.Table) -> pa.Table:
        side, rid, core = (t[c].to_numpy() for c in ("side", "rid", "core"))
        x = np.asarray([v for c in t["x"].chunks for v in _rows(c)])
        one, all_ = side == 0, side == 1
        hit = (x[one] @ x[all_].T >= threshold) & (rid[one][:, None] != rid[all_][None, :])
        mine, theirs = hit.sum(1), (hit & core[all_][None, :]).sum(0)
        return pa.table({"rid": np.concatenate([rid[one], rid[all_]]), "links": np.concatenate([mine, theirs]).astype(np.int64)})

    return run


def near_vectors(df: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", threshold: float = 0.93, window: int = 64, recall: float = 0.99) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``df``."""
    ship(df.sparkSession)
    plain = df.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = cut(plain.mapInArrow(_unit, "rid long, vec_id long, label string, x array<double>"))
    fine = rows.where("x is not null and label is not null").select("rid", "label", "x")
    comp = linked_components(fine, window, threshold, recall).withColumnRenamed("id", "rid")
    members = cut(fine.select("rid", "x").join(comp, "rid"))
    at = F.posexplode("x").alias("k", "c")
    mean = members.select("component", at).groupBy("component", "k").agg(F.sum("c").alias("c"))
    mean = mean.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda s: s["c"]).alias("mean"))
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    dot = F.aggregate(F.zip_with("x", "mean", lambda p, q: p * q), F.lit(0.0), lambda a, c: a + c)
    size = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, c: a + c * c))
    members = cut(members.join(mean, "component").select("rid", "component", "x", (dot >= F.lit(half) * size).alias("core")))
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("core").cast("long")).alias("n_core"))
    blocks = sizes.where("n > n_core").select("component", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil((F.col("n") - F.col("n_core")) / BLOCK).cast("int").alias("rb"))
    some = members.join(blocks, "component")
    mine = F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int")
    turn = F.pmod(F.xxhash64("rid", F.lit(1)), F.col("rb")).cast("int")
    cols = ["component", "rid", "core", "x"]
    lone = some.where("not core").select(*cols, F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), turn.alias("j"))
    each = some.select(*cols, F.lit(1).alias("side"), mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("j"))
    counted = lone.unionByName(each).groupBy("component", "i", "j").applyInArrow(_count(threshold), "rid long, links long").groupBy("rid").agg(F.sum("links").alias("links"))
    links = members.join(sizes, "component").join(counted, "rid", "left").select("rid", "component", (F.when(F.col("core"), F.col("n_core") - 1).otherwise(0) + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("rid", "vec_id").join(links, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    least = out.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return out.join(least, "component").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
