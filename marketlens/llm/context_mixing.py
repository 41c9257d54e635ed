"""Language-model scoring by logistic context mixing.

Text (lower-cased, A-Z) is coded item by item: an item is a word and the white-space byte that ends it (a white-space byte
alone where two meet; the last item ends in an end sign). Items stand in segments of about ``SEGMENT`` items, which end where
the words say so (a word's hash), so that the same passage is cut alike everywhere.

* A segment of at least ``LEAST`` items starts with a bit: whether it is recalled, that is occurs in other training texts. That
  bit is predicted by what such bits were before in the document, and after the same two bits. A recalled segment
  costs its share of all training segments, any other one the items it is made of.
* Each byte of an item is coded by the bits of a Huffman code. Four predictors give a probability for each bit, from the
  counts of that bit in a hashed context: the last 1, 2 and 3 bytes (with what came before the item, at its start) and the
  whole item so far. Their log-odds are added up with weights, chosen by a gate (place in the item, depth in the code, how
  often the whole item so far was seen). Weights are learned online; the result is refined by an adaptive map from
  (gate, quantised log-odds) to what happened.

A text's probability is the product over its bits and recalled segments.

All training documents count, and all that is gathered grows with them: distinct items with counts, segments with counts,
and the counts of items so far, which are made in groups of items that share their first three bytes. Only counts of
contexts of up to three bytes are tables of fixed size, as there are only so many such contexts.

1. Distinct items with their training counts; counts of segments (shuffles that grow with the corpus).
2. Online mixing over each group's items in the order of their hashes, from the same start; weights are averaged and maps
   summed over groups. Groups follow from the items alone, so another number of partitions or a lost executor changes nothing.
3. Each distinct item is scored once, in its group.
4. Documents are dealt into buckets of bounded size; a bucket asks for its distinct items and segments by hash, which are
   joined with their scores and counts and sent back.

A training document's own segments are not counted for it, so that it is not recalled from itself; its words and items are.
The base score is that of an add-half unigram model over words and text ends. Words, items and segments are told apart by
64-bit hashes. Null texts are empty texts: one token, the end. Without training documents all counts are 0.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import tokens
from marketlens.llm.common import chunks, hold, short_batches, utf8

TABLE_BITS = 19
ORDERS = (1, 2, 3)
PREDICTORS = len(ORDERS) + 1
PLACES, DEPTHS, LEVELS = 4, 6, 4
GATES = PLACES * DEPTHS * LEVELS
STEPS = 33
RATE = 0.15
SEGMENT, LEAST = 12, 4
GROUP = 60_000
SLICE = 10_000
BUCKET = 24_000_000
CHUNK = 12_000_000
BLOCK = 1 << 14
END = 0xFF
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E), END]] = True
_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Items:
    """The items of some texts: where they begin and end (the break included), their documents, the kind of break before,
    hashes of items (with that kind) and of words (0 where there is none)."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"".join(t.lower() + b"\xff" for t in texts), np.uint8)
        self.raw = raw
        self.ends = np.flatnonzero(_BREAK[raw])
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64) if len(self.ends) else self.ends
        last = np.cumsum([len(t) + 1 for t in texts]) - 1 if texts else np.zeros(0, np.int64)
        self.doc = np.searchsorted(last, self.starts)
        before = raw[self.starts - 1]
        self.kind = np.where((self.starts == 0) | (before == END), 0, np.where(before == 0x20, 1, 2)).astype(np.int64)
        self.hash = np.zeros(len(self.starts), np.uint64)
        self.word = np.zeros(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + (1 << 21), "right")))
            lo, hi = self.starts[at], self.ends[to - 1] + 1
            values = raw[lo:hi].astype(np.uint64) + np.uint64(1)
            s, e = self.starts[at:to] - lo, self.ends[at:to] - lo
            self.hash[at:to] = tokens.mix(tokens.span_hashes(values, s, e + 1) + self.kind[at:to].astype(np.uint64))
            self.word[at:to] = np.where(e > s, tokens.span_hashes(values, s, e), np.uint64(0))
            at = to

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """Where segments begin (one more entry than segments), and their hashes (0 for those of too few items)."""
        n = len(self.word)
        new_doc = np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if n else np.zeros(0, bool)
        after = np.concatenate([[False], (self.word[:-1] != 0) & (self.word[:-1] % np.uint64(SEGMENT) == 0)]) if n else new_doc
        begins = np.append(np.flatnonzero(new_doc | after), n)
        hashes = np.zeros(len(begins) - 1, np.uint64)
        values, at = tokens.mix(self.word + np.uint64(5)), 0
        while at < len(hashes):
            to = max(at + 1, int(np.searchsorted(begins, begins[at] + (1 << 20), "right")) - 1)
            lo, hi = begins[at], begins[to]
            hashes[at:to] = tokens.mix(tokens.span_hashes(values[lo:hi], begins[at:to] - lo, begins[at + 1 : to + 1] - lo) + np.uint64(11))
            at = to
        hashes[np.diff(begins) < LEAST] = 0
        return begins, hashes


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and length for each of 256 bytes; every byte has one."""
    heap = [(float(c) + 1e-3, i, (i,)) for i, c in enumerate(counts)]
    length = np.zeros(256, np.int64)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        length[[*a[2], *b[2]]] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    code, value, previous = np.zeros(256, np.int64), 0, 0
    for i in sorted(range(256), key=lambda i: (length[i], i)):
        value <<= int(length[i]) - previous
        code[i], previous = value, int(length[i])
        value += 1
    return code, length


class Bits:
    """All bits of some items (bytes with their break): the item, the bit, its gate, its slot for each order, and the key of
    the whole item so far (0 within the first three bytes, which the orders cover)."""

    def __init__(self, items: list[bytes], kind: np.ndarray, code: np.ndarray, length: np.ndarray):
        pad = max(ORDERS)
        sizes = np.fromiter(map(len, items), np.int64, len(items))
        begins = np.cumsum(sizes + pad) - sizes
        x = np.zeros(int(sizes.sum()) + pad * len(items), np.uint64)
        item = np.repeat(np.arange(len(items)), sizes)
        place = np.arange(len(item)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = begins[item] + place
        byte = np.frombuffer(b"".join(items), np.uint8)
        x[at] = byte.astype(np.uint64) + np.uint64(1)
        x[begins - 1] = kind.astype(np.uint64) + np.uint64(300)
        contexts, acc = [], np.zeros(len(x), np.uint64)
        for n in range(1, pad + 1):
            acc[n:] = acc[n:] * _A + x[:-n]
            contexts.append(tokens.mix(acc[at] + np.uint64(n)))
        starts = np.cumsum(sizes) - sizes
        so_far = tokens.span_hashes(x[at], starts[item], np.arange(len(item))) if len(item) else np.zeros(0, np.uint64)
        so_far = tokens.mix(so_far + kind.astype(np.uint64)[item] + np.uint64(77))
        n = length[byte]
        of = np.repeat(np.arange(len(byte)), n)
        depth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        rest = n[of] - depth
        self.item, self.bit = item[of], (code[byte][of] >> (rest - 1)) & 1
        node = tokens.mix(((np.int64(1) << depth) | (code[byte][of] >> rest)).astype(np.uint64))
        self.gate = (np.digitize(place, (1, 2, 5))[of] * DEPTHS + np.minimum(depth, DEPTHS - 1)) * LEVELS
        shift = np.uint64(64 - TABLE_BITS)
        self.slot = [(((c[of] ^ node) * _C) >> shift).astype(np.int64) for c in contexts]
        self.key = np.where(place[of] >= pad, tokens.mix(so_far[of] ^ node) | np.uint64(1), np.uint64(0))


def slices(items: list[bytes], kind: np.ndarray, code: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int, Bits]]:
    for lo in range(0, len(items), SLICE):
        hi = min(lo + SLICE, len(items))
        yield lo, hi, Bits(items[lo:hi], kind[lo:hi], code, length)


def log_odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.1) / (zeros + 0.1))


class SoFar:
    """Counts of the bits after items so far, of one group."""

    def __init__(self, items: list[bytes], kind: np.ndarray, count: np.ndarray, code: np.ndarray, length: np.ndarray):
        keys, zeros, ones = [np.zeros(1, np.uint64)], [np.zeros(1)], [np.zeros(1)]
        for lo, _, b in slices(items, kind, code, length):
            w = count[lo + b.item]
            key, back = np.unique(b.key, return_inverse=True)
            keys.append(key)
            ones.append(np.bincount(back, w * b.bit, len(key)))
            zeros.append(np.bincount(back, w * (1 - b.bit), len(key)))
        self.key, back = np.unique(np.concatenate(keys), return_inverse=True)
        self.ones, self.zeros = (np.bincount(back, np.concatenate(v), len(self.key)) for v in (ones, zeros))
        self.ones[0] = self.zeros[0] = 0  # key 0 is no context
        self.odds, self.total = log_odds(self.ones, self.zeros), self.ones + self.zeros

    def at(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, key)


class Model:
    """Code, counts by order and slot, weights by gate and the adaptive map."""

    def __init__(self, code, length, zeros=None, ones=None, weights=None, hits=None, seen=None):
        self.code, self.length, self.zeros, self.ones = code, length, zeros, ones
        self.weights = np.full((GATES, PREDICTORS), 0.3) if weights is None else weights
        self.hits, self.seen = (np.zeros((GATES, STEPS)) if hits is None else hits), (np.zeros((GATES, STEPS)) if seen is None else seen)

    def level(self, b: Bits, early: np.ndarray, late: np.ndarray) -> np.ndarray:
        """Gates, from how often the whole item so far was seen: within the first bytes that is the longest order."""
        return b.gate + np.digitize(np.where(b.key == 0, early, late), (0.5, 4, 40))

    def inputs(self, b: Bits, so_far: SoFar) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds by predictor, and gates, for learning. The bit itself is taken out of the counts, which hold it, so that
        what was seen once looks as new as it will be in other texts."""
        x = np.empty((len(b.bit), PREDICTORS))
        at = so_far.at(b.key)
        counts = [(self.ones[k][s], self.zeros[k][s]) for k, s in enumerate(b.slot)] + [(so_far.ones[at], so_far.zeros[at])]
        for k, (o, z) in enumerate(counts):
            o, z = counts[k] = np.maximum(o - b.bit, 0), np.maximum(z - (1 - b.bit), 0)
            x[:, k] = log_odds(o, z)
        return x, self.level(b, np.add(*counts[len(ORDERS) - 1]), np.add(*counts[-1]))

    def scoring_inputs(self, b: Bits, so_far: SoFar) -> tuple[np.ndarray, np.ndarray]:
        """The same for scoring, from all counts: each slot's log-odds are worked out once."""
        if not hasattr(self, "odds"):
            self.odds, self.longest = log_odds(self.ones, self.zeros), self.ones[len(ORDERS) - 1] + self.zeros[len(ORDERS) - 1]
        at = so_far.at(b.key)
        x = np.stack([*(self.odds[k][s] for k, s in enumerate(b.slot)), so_far.odds[at]], axis=1)
        return x, self.level(b, self.longest[b.slot[len(ORDERS) - 1]], so_far.total[at])

    @staticmethod
    def step(odds: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((odds + 8) * 2), 0, STEPS - 1).astype(np.int64)

    def learn(self, b: Bits, so_far: SoFar, count: np.ndarray) -> None:
        """One online step over the bits of a few items, each as heavy as its count."""
        (x, gate), w = self.inputs(b, so_far), count[b.item]
        odds = np.clip((x * self.weights[gate]).sum(1), -8, 8)
        key = gate * STEPS + self.step(odds)
        self.hits += np.bincount(key, w * b.bit, GATES * STEPS).reshape(GATES, STEPS)
        self.seen += np.bincount(key, w, GATES * STEPS).reshape(GATES, STEPS)
        miss = w * (b.bit - 1 / (1 + np.exp(-odds)))
        total = np.bincount(gate, w, GATES) + 1e-9
        for k in range(PREDICTORS):
            self.weights[:, k] += RATE * np.bincount(gate, miss * x[:, k], GATES) / total

    def score(self, b: Bits, so_far: SoFar, n: int) -> np.ndarray:
        """log10 probability of each of the ``n`` items of some bits."""
        x, gate = self.scoring_inputs(b, so_far)
        odds = np.clip((x * self.weights[gate]).sum(1), -8, 8)
        p = 1 / (1 + np.exp(-odds))
        at = (gate, self.step(odds))
        refined = (self.hits[at] + 4 * p) / (self.seen[at] + 4)
        p = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
        return np.bincount(b.item, np.log10(np.where(b.bit == 1, p, 1 - p)), n)


def recalled(begins: np.ndarray, others: np.ndarray, asked: np.ndarray, doc: np.ndarray, total: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """log10 probability of each segment: ``asked`` tells which start with the bit, ``others`` how often each occurs in other
    training texts, ``total`` how many segments those have, ``spelled`` what its items cost."""
    out = np.add.reduceat(spelled, begins[:-1]) if len(begins) > 1 else np.zeros(0)
    at = np.flatnonzero(asked)
    if not len(at):
        return out
    bit, d = (others[at] > 0).astype(np.int64), doc[at]
    same = np.concatenate([[False], d[1:] == d[:-1]])
    one = np.where(same, np.concatenate([[0], bit[:-1]]), 2)
    same2 = np.concatenate([[False, False], d[2:] == d[:-2]])[: len(d)]
    two = np.where(same2, np.concatenate([[0, 0], bit[:-2]])[: len(d)], 2)
    odds = np.zeros(len(at))
    for context in (d, (d * 3 + one) * 3 + two):
        order = np.argsort(context, kind="stable")
        c, b = context[order], bit[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(first, len(c)))
        before = np.concatenate([[0], np.cumsum(b)])[:-1]
        ones = before - np.repeat(before[first], size)
        seen = np.arange(len(c)) - np.repeat(first, size)
        odds[order] += np.log((ones + 0.4) / (seen - ones + 0.4)) / 2
    p = 1 / (1 + np.exp(-odds))
    named = np.log10(np.maximum(others[at], 1) / np.maximum(total[at], 1))
    out[at] = np.where(bit == 1, np.log10(p) + named, np.log10(1 - p) + out[at])
    return out


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for b in batches:
        for t in utf8(b.column(column)):
            held.append(t)
            size += len(t) + 1
            if size > CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_items(docs: DataFrame) -> DataFrame:
    """(item, kind, n): distinct items of all texts (text, held_out) with how often they occur in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(1).to_numpy(zero_copy_only=False)
            texts = utf8(b.column(0))
            yield from zip(texts, held, strict=True)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        train: list[bool] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = Items(texts)
            _, first, back = np.unique(t.hash, return_index=True, return_inverse=True)
            n = np.bincount(back, np.asarray(train, float)[t.doc], len(first)).astype(np.int64)
            raw = t.raw.tobytes()
            items = [raw[s : e + 1] for s, e in zip(t.starts[first].tolist(), t.ends[first].tolist(), strict=True)]
            for lo in range(0, len(items), 100_000):
                hi = lo + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(items[lo:hi], pa.binary()), pa.array(t.kind[first][lo:hi], pa.int32()), pa.array(n[lo:hi])], names=["item", "kind", "n"])

        for text, held in run(batches):
            texts.append(text)
            train.append(not held)
            size += len(text) + 1
            if size > CHUNK:
                yield from flush()
                texts, train, size = [], [], 0
        if texts:
            yield from flush()

    out = short_batches(docs).select("text", "held_out").mapInArrow(distinct, "item binary, kind int, n long")
    return out.groupBy("item", "kind").agg(F.sum("n").alias("n"))


def count_segments(texts: DataFrame) -> DataFrame:
    """(h, n): the segments of a column of training texts with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _runs(batches, 0):
            h, n = np.unique(Items(some).segments()[1], return_counts=True)
            at = h != 0
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(n[at])], names=["h", "n"])

    return short_batches(texts).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _merge_blocks(parts: DataFrame, n: int) -> DataFrame:
    """Sums arrays (table, block, part, sums) over parts, at most 64 in one task at a time."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in t["sums"].to_pylist())
        return pa.table({"table": t["table"][:1], "block": t["block"][:1], "part": pa.array([t["part"][0].as_py() // 64], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    while n > 1:
        parts = parts.withColumn("_g", F.floor(F.col("part") / 64)).groupBy("table", "block", "_g").applyInArrow(add, "table int, block int, part int, sums binary")
        n = -(-n // 64)
    return parts


def _grouped(items: DataFrame, n_items: int) -> DataFrame:
    """``items`` with the group ``g`` of the first three bytes of their word: all that items so far need is in one group."""
    start = F.substring("item", F.lit(1), F.least(F.lit(3), F.greatest(F.length("item") - 1, F.lit(0))))
    return items.withColumn("g", F.pmod(F.xxhash64(start), F.lit(max(1, -(-n_items // GROUP)))).cast("int"))


def _group(t: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items of a group in the order of their hashes, with kinds, counts, hashes and word hashes."""
    got, kind, n = t["item"].to_pylist(), t["kind"].to_numpy().astype(np.int64), t["n"].to_numpy().astype(np.float64)
    raw = np.frombuffer(b"".join(got), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
    starts = ends - np.fromiter(map(len, got), np.int64, len(got))
    h = tokens.mix(tokens.span_hashes(raw, starts, ends) + kind.astype(np.uint64))
    word = np.where(ends - 1 > starts, tokens.span_hashes(raw, starts, ends - 1), np.uint64(0))
    order = np.argsort(h)
    return [got[i] for i in order.tolist()], kind[order], n[order], h[order], word[order]


def fit(items: DataFrame, n_items: int) -> Model:
    """Learns from the distinct items (item, kind, n) that training texts have, all of them."""
    spark = items.sparkSession
    items = items.where("n > 0")
    byte = items.select(F.explode(F.split(F.hex("item"), "(?<=\\G..)")).alias("byte"), "n").groupBy("byte").agg(F.sum("n").alias("n"))
    histogram = np.zeros(256)
    for r in byte.collect():  # 256 rows at most
        if r.byte:
            histogram[int(r.byte, 16)] = r.n
    code, length = huffman(histogram)
    parts = max(2, -(-n_items // 400_000))
    dealt = items.coalesce(parts)
    slots = 1 << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sums = np.zeros((len(ORDERS) * 2, slots))
        held: list[pa.RecordBatch] = []

        def add() -> None:
            t = pa.Table.from_batches(held)
            got, n = t["item"].to_pylist(), t["n"].to_numpy().astype(np.float64)
            for lo, _, b in slices(got, t["kind"].to_numpy().astype(np.int64), code, length):
                w = n[lo + b.item]
                for k in range(len(ORDERS)):
                    for bit in (0, 1):
                        one = b.bit == bit
                        sums[2 * k + bit] += np.bincount(b.slot[k][one], w[one], slots)
            held.clear()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= SLICE:
                add()
        if held:
            add()
        for k in range(len(ORDERS) * 2):
            for block in range(slots // BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([sums[k, block * BLOCK : (block + 1) * BLOCK].tobytes()], pa.binary())], names=["table", "block", "part", "sums"])

    counted = short_batches(dealt).select("item", "kind", "n").mapInArrow(count, "table int, block int, part int, sums binary")
    tables = np.zeros((len(ORDERS) * 2, slots))
    for r in _merge_blocks(counted, parts).toLocalIterator():  # tables of a fixed size
        tables[r.table, r.block * BLOCK : (r.block + 1) * BLOCK] += np.frombuffer(r.sums, np.float64)
    zeros, ones = tables[0::2].astype(np.float32), tables[1::2].astype(np.float32)
    sent = spark.sparkContext.broadcast((code, length, zeros, ones))

    def learn(t: pa.Table) -> pa.Table:
        model = Model(*sent.value)
        got, kind, n, _, _ = _group(t)
        so_far = SoFar(got, kind, n, model.code, model.length)
        for lo in range(0, len(got), 500):
            model.learn(Bits(got[lo : lo + 500], kind[lo : lo + 500], model.code, model.length), so_far, n[lo : lo + 500])
        flat = np.concatenate([model.weights.ravel() * n.sum(), model.hits.ravel(), model.seen.ravel(), [n.sum()]])
        return pa.table({"k": pa.array(np.arange(len(flat)), pa.int32()), "v": pa.array(flat)})

    flat = _grouped(items, n_items).groupBy("g").applyInArrow(learn, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    v = np.zeros(GATES * (PREDICTORS + 2 * STEPS) + 1)
    for r in flat.collect():  # as many rows as the model has weights and map cells
        v[r.k] = r.v
    cut1, cut2 = GATES * PREDICTORS, GATES * (PREDICTORS + STEPS)
    weights = v[:cut1].reshape(GATES, PREDICTORS) / v[-1] if v[-1] else None
    return Model(code, length, zeros, ones, weights, v[cut1:cut2].reshape(GATES, STEPS), v[cut2:-1].reshape(GATES, STEPS))


def score_items(items: DataFrame, n_items: int, model) -> DataFrame:
    """(h, c, v): for each distinct item by its hash, how often its word occurs in training texts, and its log10 probability."""

    def run(t: pa.Table) -> pa.Table:
        m = model.value
        got, kind, n, h, word = _group(t)
        so_far = SoFar(got, kind, n, m.code, m.length)
        v = np.concatenate([m.score(b, so_far, hi - lo) for lo, hi, b in slices(got, kind, m.code, m.length)])
        _, back = np.unique(word, return_inverse=True)
        c = np.where(word == 0, 0, np.bincount(back, n)[back]).astype(np.int64)
        return pa.table({"h": pa.array(h.view(np.int64)), "c": pa.array(c), "v": pa.array(v)})

    return _grouped(items, n_items).groupBy("g").applyInArrow(run, "h long, c long, v double")


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes), learning from rows where ``train``."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (~train).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    items = hold(count_items(plain.select("text", "held_out")))
    n_items = items.count()
    model = spark.sparkContext.broadcast(fit(items, n_items))
    scored = hold(score_items(items, n_items, model))
    segments = hold(count_segments(plain.where("not held_out").select("text")))
    n_segments = segments.agg(F.sum("n")).first()[0] or 0
    sizes = plain.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum((~F.col("held_out")).cast("long")).alias("ends")).first()
    ends = sizes.ends or 0
    word = F.when(F.length("item") > 1, F.substring("item", F.lit(1), F.length("item") - 1))
    known = items.where("n > 0").select(word.alias("w"), "n").where("w is not null").groupBy("w").agg(F.sum("n").alias("n")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    total, distinct = (known.n or 0) + ends, known.v + (ends > 0)
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    buckets = max(1, -(-(sizes.bytes or 0) // BUCKET))
    dealt = plain.withColumn("b", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(buckets)).cast("int"))

    def ask(t: pa.Table) -> pa.Table:
        """Distinct items and segments of a bucket. ``own``: training occurrences of a segment that only one of its texts
        has; -1 for all that is to be answered whatever its count."""
        items_, segs, own_, texts_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in t.select(["held_out", "text"]).to_batches():
            held, texts = b.column(0).to_numpy(zero_copy_only=False), utf8(b.column(1))
            for lo, hi in chunks(texts, CHUNK // 4):
                some = Items(texts[lo:hi])
                items_.append(np.unique(some.hash))
                begins, h = some.segments()
                doc, fine = some.doc[begins[:-1]], h != 0
                for got, add in zip((segs, own_, texts_), _owned(h[fine], ~held[lo:hi][doc[fine]], doc[fine]), strict=True):
                    got.append(add)
        found = np.unique(np.concatenate(items_))
        seg, back = np.unique(np.concatenate(segs), return_inverse=True)
        own, n = np.bincount(back, np.concatenate(own_), len(seg)), np.bincount(back, np.concatenate(texts_), len(seg))
        h, own = np.concatenate([found, seg]), np.concatenate([np.full(len(found), -1), np.where(n > 1, -1, own)])
        return pa.table({"b": pa.array(np.full(len(h), t["b"][0].as_py()), pa.int32()), "h": pa.array(h.view(np.int64)), "own": pa.array(own.astype(np.int32))})

    asked = short_batches(dealt).groupBy("b").applyInArrow(ask, "b int, h long, own int")
    table = scored.select("h", F.col("c"), F.col("v").cast("float").alias("v")).unionByName(segments.select("h", F.col("n").alias("c"), F.lit(0.0).cast("float").alias("v")))
    answers = asked.join(table, "h").where("c > own").select("b", "h", F.col("c").cast("int").alias("c"), "v")

    def answer(docs_: pa.Table, got: pa.Table) -> pa.Table:
        h, c, v = np.asarray(got["h"].to_numpy()).view(np.uint64), got["c"].to_numpy(), got["v"].to_numpy()
        order = np.argsort(h)
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        h, c, v = np.concatenate([h[order], [top]]), np.concatenate([c[order], [0]]), np.concatenate([v[order], [0.0]]).astype(np.float64)
        out = []
        for b in docs_.select(["doc_id", "held_out", "text"]).to_batches(max_chunksize=500):
            texts = utf8(b.column(2))
            t, n = Items(texts), len(texts)
            at = np.minimum(np.searchsorted(h, t.hash), len(h) - 1)
            real = t.word != 0
            doc, cs = t.doc[real], c[at][real]
            count = np.bincount(doc, minlength=n) + 1
            base = np.bincount(doc, np.log10(cs + 0.5), n) + np.log10(ends + 0.5) - count * norm
            n_known = np.bincount(doc, cs > 0, n).astype(np.int64) + int(ends > 0)
            begins, seg = t.segments()
            of, mine = t.doc[begins[:-1]], ~b.column(1).to_numpy(zero_copy_only=False)
            where = np.minimum(np.searchsorted(h, seg), len(h) - 1)
            others = np.where((seg != 0) & (h[where] == seg), c[where], 0) - np.where(mine[of], _times(of, seg), 0)
            all_own = np.bincount(of, seg != 0, n)
            left = np.where(mine, n_segments - all_own, n_segments)[of]
            parts = recalled(begins, np.maximum(others, 0), seg != 0, of, left, v[at])
            out.append(pa.table({
                "doc_id": b.column(0), "held_out": b.column(1), "n_tokens": pa.array(count.astype(np.int64)), "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(n, total, np.int64)),
                "base_score": pa.array(base), "score": pa.array(np.bincount(of, parts, n)), "n_bytes": pa.array(np.asarray([len(x) for x in texts], np.int64)),
            }))
        kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
        return pa.concat_tables(out).cast(kind) if out else kind.empty_table()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return dealt.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(answer, schema)


def _times(doc: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """How often each segment occurs in its own document."""
    key = tokens.mix(seg ^ tokens.mix(doc.astype(np.uint64) + np.uint64(3)))
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[back]


def _owned(h: np.ndarray, train: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes with their training occurrences and texts."""
    order = np.lexsort((doc, h))
    x, t, d = h[order], train[order], doc[order]
    if not len(x):
        return x, np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], x[1:] != x[:-1]])
    text = new | np.concatenate([[True], d[1:] != d[:-1]])
    first = np.flatnonzero(new)
    return x[new], np.add.reduceat(t.astype(np.int64), first), np.add.reduceat(text.astype(np.int64), first)
