"""Exact substring dedup: removes every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Sorting all suffixes of a corpus is out of reach of a shuffle, so the places where repeats can be are found first:

1. Each window of LENGTH bytes has an anchor: the leftmost of its runs of GRAM bytes with the least hash. Equal windows
   have equal anchors at equal offsets. Windows with the same anchor lie side by side; they make a context, the bytes from
   the first one's start to the last one's end. Contexts whose anchor's hash occurs once hold no repeat and go.
2. Contexts that occur twice as a whole (by a 64-bit hash) are repeats from end to end. If an anchor has other contexts, too,
   one of each kind goes on, with its bytes.
3. Those are dealt by anchor. In a task, the strings right of the anchors, in symbols of 8 bytes, are cut into shards; each
   shard gets its Burrows-Wheeler transform; the transforms are merged by refining their interleave, a symbol deeper in
   each round, without sorting suffixes again. Where a block of the interleave splits tells the common prefix of
   neighbours; blocks of common prefixes give, with the bytes left of the anchor, the windows that are repeated.
   An anchor with more than ``HOT`` kinds of contexts isn't gathered: its windows are hashed one by one and counted.
4. Repeated windows go back to their texts, where their union is cut out.

Rows with equal texts repeat each other. Null texts are empty; texts under LENGTH bytes lose nothing. Texts are named by
64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import tokens
from marketlens.llm.common import hold, short_batches, shuffle_partitions, utf8

LENGTH = 200
GRAM = 80
WINDOWS = LENGTH - GRAM + 1
HOT = 4_096
SHARD = 256
SEGMENT = 1 << 21
_STEP = np.uint64(0x9FB21C651E98DF25)


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of ``w``: minima from the left and from the right of blocks of w."""
    n = len(h) - w + 1
    padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _anchors(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, hash of the anchor, hash of the context) of a run of bytes of LENGTH at least."""
    n = len(raw)
    b, inv = tokens._pow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * b[:n], out=sums[1:])
    h = tokens.mix((sums[GRAM:] - sums[:-GRAM]) * inv[: n - GRAM + 1])
    least = _sliding_min(h, WINDOWS)
    lo = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    hi = np.concatenate([lo[1:] - 1, [len(least) - 1]])
    out: list[tuple[np.ndarray, ...]] = []
    while len(lo):
        at = lo + np.concatenate([h[lo[i : i + 4096, None] + np.arange(WINDOWS)].argmin(1) for i in range(0, len(lo), 4096)])
        out.append((at, lo, np.minimum(hi, at)))
        more = hi > at  # the same least value again further right
        lo, hi = at[more] + 1, hi[more]
    at, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
    size = (hi - lo + LENGTH).astype(np.uint64)
    c = tokens.mix((sums[hi + LENGTH] - sums[lo]) * inv[lo] + (size << np.uint64(8)) + (at - lo).astype(np.uint64))
    return at, lo, hi, h[at], c


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, place, anchor hash, context hash) of all texts; place holds the first window, and where the anchor and the last
    window are from there, in its lowest bytes."""
    whole = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    found: list[tuple[np.ndarray, ...]] = []
    for i in whole:
        raw = np.frombuffer(texts[i], np.uint8)
        for s in range(0, len(raw) - LENGTH + 1, SEGMENT):  # windows that start in a segment are its own
            at, lo, hi, f, c = _anchors(raw[s : s + SEGMENT + LENGTH - 1])
            found.append((np.full(len(at), i, np.int64), ((lo + s) << 16) | ((at - lo) << 8) | (hi - lo), f.view(np.int64), c.view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# --- Burrows-Wheeler transforms of shards, and their merge ---


def shard_bwt(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bwt) of the suffixes of some strings of one length: rows of ``symbols`` (from 1), each with an end sign 0 that
    sorts by row. ``order`` numbers suffixes row by row, ``bwt`` is the symbol before each."""
    m, k = symbols.shape
    s = np.zeros((m, k + 1), np.int64)
    s[:, :k] = symbols
    _, rank = np.unique(s.ravel(), return_inverse=True)
    rank = rank.reshape(m, k + 1).astype(np.int64)
    rank[:, :k] += m
    rank[:, k] = np.arange(m)  # ends differ
    step = 1
    while step <= k:  # prefix doubling
        after = np.zeros_like(rank)
        after[:, : k + 1 - step] = rank[:, step:] + 1
        _, rank = np.unique((rank * (rank.max() + after.max() + 2) + after).ravel(), return_inverse=True)
        rank = rank.reshape(m, k + 1)
        step *= 2
    order = np.argsort(rank.ravel(), kind="stable")
    before = np.zeros_like(s)
    before[:, 1:] = s[:, :-1]
    return order, before.ravel()[order]


def merge_bwt(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Merges two transforms (order, bwt, strings) by interleave refinement; also the common prefix, in symbols, of each
    suffix with the one before it. Suffixes of ``b`` are numbered after those of ``a``."""
    na, nb, m = len(a[0]), len(b[0]), a[2] + b[2]
    n = na + nb
    z = np.concatenate([np.zeros(na, bool), np.ones(nb, bool)])
    block = np.zeros(n, np.int64)
    lcp = np.full(n, -1, np.int64)
    lcp[0] = 0
    depth = 0
    while True:
        of_a, of_b = np.cumsum(~z) - 1, np.cumsum(z) - 1
        symbol = np.where(z, b[1][np.maximum(of_b, 0)] if nb else 0, a[1][np.maximum(of_a, 0)] if na else 0)
        # a suffix moves to where its symbol's suffixes are; end signs keep the order of their strings
        moved = np.flatnonzero(symbol)
        moved = moved[np.argsort(symbol[moved].astype(np.uint16) if symbol.max(initial=0) < 65_536 else symbol[moved], kind="stable")]
        new = np.concatenate([np.zeros(a[2], bool), np.ones(b[2], bool), z[moved]])
        edge = np.ones(n, bool)
        edge[m:][1:] = (symbol[moved][1:] != symbol[moved][:-1]) | (block[moved][1:] != block[moved][:-1])
        lcp[edge & (lcp < 0)] = depth
        done = (new == z).all() and (np.cumsum(edge) - 1 == block).all()
        z, block = new, np.cumsum(edge) - 1
        depth += 1
        if done or edge.all():
            break
    of_a, of_b = np.cumsum(~z) - 1, np.cumsum(z) - 1
    order = np.where(z, na + (b[0][np.maximum(of_b, 0)] if nb else 0), a[0][np.maximum(of_a, 0)] if na else 0)
    symbol = np.where(z, b[1][np.maximum(of_b, 0)] if nb else 0, a[1][np.maximum(of_a, 0)] if na else 0)
    return order, symbol, m, np.where(lcp < 0, depth, lcp)


def sort_strings(right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common bytes with the one before) of strings of LENGTH bytes, by shard transforms and their merges."""
    m = len(right)
    words = np.ascontiguousarray(right).view(">u8").astype(np.uint64)
    k = words.shape[1]
    _, code = np.unique(words.ravel(), return_inverse=True)
    code = code.reshape(m, k) + 1
    parts = []
    for lo in range(0, m, SHARD):
        order, bwt = shard_bwt(code[lo : lo + SHARD])
        parts.append((order, bwt, min(SHARD, m - lo)))
    if len(parts) == 1:
        parts.append((np.zeros(0, np.int64), np.zeros(0, np.int64), 0))
    lcp = None
    while len(parts) > 1:
        merged = []
        for i in range(0, len(parts) - 1, 2):
            *rest, lcp = merge_bwt(parts[i], parts[i + 1])
            merged.append(tuple(rest))
        parts = merged + parts[len(parts) - len(parts) % 2 :]
    order = parts[0][0]
    whole = np.flatnonzero(order % (k + 1) == 0)
    strings = order[whole] // (k + 1)
    common = np.minimum.reduceat(lcp[: whole[-1] + 1], np.concatenate([[0], whole[:-1] + 1])) if m > 1 else np.zeros(1, np.int64)
    common = np.minimum(common, k)
    common[0] = 0
    a, b = right[strings[1:]], right[strings[:-1]]
    at = np.minimum(common[1:], k - 1)[:, None] * 8 + np.arange(8)
    tail = np.logical_and.accumulate(np.take_along_axis(a, at, 1) == np.take_along_axis(b, at, 1), 1).sum(1)
    return strings, np.concatenate([[0], np.where(common[1:] < k, common[1:] * 8 + tail, k * 8)])


def repeated_windows(contexts: list[bytes], left: np.ndarray, n_windows: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each context (bytes from its first window; ``left`` bytes stand before its anchor) which of its windows are
    repeated: a matrix with a column for each window's offset."""
    m = len(contexts)
    right = np.zeros((m, LENGTH), np.uint8)
    back = np.zeros((m, WINDOWS), np.uint8)
    for i, c in enumerate(contexts):
        d = int(left[i])
        r = np.frombuffer(c, np.uint8)
        right[i, : min(LENGTH, len(r) - d)] = r[d : d + LENGTH]
        back[i, :d] = r[:d][::-1]
    order, common = sort_strings(right)
    out = np.zeros((m, WINDOWS), bool)
    out[times > 1] = np.arange(WINDOWS) < n_windows[times > 1, None]
    acc = np.zeros(m, np.uint64)
    lo, hi = left - n_windows + 1, left
    for d in range(int(hi.max()) + 1):  # windows that start d bytes before their anchor
        if d:
            acc = acc * _STEP + back[:, d - 1] + np.uint64(1)
        mine = (lo <= d) & (d <= hi)
        if not mine.any():
            continue
        group = np.empty(m, np.int64)
        group[order] = np.cumsum(common < LENGTH - d)
        key = tokens.mix(acc[mine] + tokens.mix(group[mine].astype(np.uint64)))
        _, back_to = np.unique(key, return_inverse=True)
        total = np.bincount(back_to, times[mine])
        rows = np.flatnonzero(mine)
        out[rows, left[rows] - d] |= total[back_to] > 1
    return out


def _runs(flags: np.ndarray) -> list[int]:
    """first << 8 | last of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [int(a) << 8 | int(b - 1) for a, b in zip(edge[0::2], edge[1::2], strict=True)]


def _merge_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor, in blocks of whole anchors: (f, c, runs of repeated windows)."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        left, n = np.asarray([r[2] >> 8 & 255 for r in rows]), np.asarray([(r[2] & 255) + 1 for r in rows])
        flags = repeated_windows([r[4] for r in rows], left, n, np.asarray([r[3] for r in rows]))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([_runs(x) for x in flags], pa.list_(pa.int32()))], names=["f", "c", "runs"])

    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if len(held) >= 4 * SHARD and row[0] != held[-1][0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_bytes", F.coalesce(F.col(text), F.lit("")).cast("binary")).withColumn("_t", F.xxhash64("_bytes"))


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(t, spans): for each text (by hash) with repeats that are not copies of the whole text: places and runs of windows."""
    plain = _texts(docs.select(text), text).select(F.col("_t").alias("t"), F.col("_bytes").alias("text"))
    n = shuffle_partitions(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(0).to_numpy()
            i, place, f, c = anchors(utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(t[i] if len(i) else i), pa.array(place), pa.array(f), pa.array(c)], names=["t", "place", "f", "c"])

    found = hold(short_batches(plain).mapInArrow(find, "t long, place long, f long, c long"))
    twice = found.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    again = hold(found.join(twice, "f"))
    # copies of a text count once: their places are the same
    kinds = hold(again.groupBy("f", "c").agg(F.min(F.struct("t", "place")).alias("one"), F.max(F.struct("t", "place")).alias("other"), F.count("*").alias("n")))
    kinds = kinds.select("f", "c", "one", F.when(F.col("one") == F.col("other"), 1).otherwise(2).alias("times"))
    per = kinds.groupBy("f").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1")
    open_ = hold(kinds.join(per.select("f", "kinds"), "f").select("f", "c", "times", F.col("one.t").alias("t"), F.col("one.place").alias("place"), (F.col("kinds") > HOT).alias("hot")))
    wanted = open_.groupBy("t").agg(F.collect_list(F.struct("f", "c", "place", "times", "hot")).alias("w"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, c, place, times, hot, ctx = [], [], [], [], [], []
            for text, w in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                for x in w:
                    lo = x["place"] >> 16
                    for k, v in ((f, "f"), (c, "c"), (place, "place"), (times, "times"), (hot, "hot")):
                        k.append(x[v])
                    ctx.append(text[lo : lo + (x["place"] & 255) + LENGTH])
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(c, pa.int64()), pa.array(place, pa.int64()), pa.array(times, pa.int32()), pa.array(ctx, pa.binary()), pa.array(hot, pa.bool_())], names=["f", "c", "place", "times", "ctx", "hot"])

    first = plain.repartition(n, "t").join(wanted, "t").select("text", "w", "t").dropDuplicates(["t"]).select("text", "w")
    ctx = hold(short_batches(first).mapInArrow(fetch, "f long, c long, place long, times int, ctx binary, hot boolean"))
    cold = ctx.where("not hot").select("f", "c", "place", "times", "ctx").repartition(n, "f").sortWithinPartitions("f")
    solved = cold.mapInArrow(_merge_partition, "f long, c long, runs array<int>")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, c, place, times, text = (b.column(i).to_pylist() for i in range(5))
            rows = [(f[i], c[i], k, times[i], int.from_bytes(hashlib.blake2b(text[i][k : k + LENGTH], digest_size=8).digest(), "little", signed=True)) for i in range(b.num_rows) for k in range((place[i] & 255) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["f", "c", "k", "times", "h"])

    each = ctx.where("hot").select("f", "c", "place", "times", "ctx").mapInArrow(windows, "f long, c long, k int, times int, h long")
    more = each.join(each.groupBy("h").agg(F.sum("times").alias("all")).where("all > 1").select("h"), "h")
    hot = more.groupBy("f", "c").agg(F.collect_list(F.shiftleft("k", 8).bitwiseOR(F.col("k"))).alias("runs"))
    # a kind with no other kind, or met twice as a whole, is repeated from end to end
    full = kinds.where("times > 1").select("f", "c", F.lit(True).alias("whole"))
    marked = again.join(full, ["f", "c"], "left").join(solved.unionByName(hot), ["f", "c"], "left").where(F.col("whole") | (F.size("runs") > 0))
    runs = F.when(F.col("whole"), F.array(F.col("place").bitwiseAND(F.lit(255)).cast("int"))).otherwise(F.col("runs"))
    return marked.groupBy("t").agg(F.collect_set(F.struct("place", runs.alias("runs"))).alias("spans"))


def _cut(text: bytes, spans: list, copied: bool) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed)."""
    n = len(text)
    if copied and n >= LENGTH:
        return b"", n, 1
    if not spans:
        return text, 0, 0
    mark = np.zeros(n + 1, np.int64)
    for s in spans:
        lo = s["place"] >> 16
        for r in s["runs"]:
            mark[lo + (r >> 8)] += 1
            mark[lo + (r & 255) + LENGTH] -= 1
    gone = np.cumsum(mark)[:n] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row per document; kept is what is left, as bytes."""
    plain = _texts(docs.select(doc_id, text), text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col("_t").alias("t"), F.col("_bytes").alias("text"))
    times = plain.groupBy("t").agg((F.count("*") > 1).alias("copied"))
    known = times.join(repeated_spans(docs, text), "t", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_cut(t, s, c) for t, s, c in zip(utf8(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in utf8(b.column(1))], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = plain.join(known, "t", "left").select("doc_id", "text", "spans", "copied")
    return short_batches(joined).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
