"""Word hashes of many texts at once, with numpy, inside Spark tasks."""

from __future__ import annotations

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(0x20)

_P = np.uint64((1 << 31) - 1)
_Q = 1_327_217_885

_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("b", ())) < n:
        m = max(n, 1 << 21)
        for key, base in (("b", _B), ("i", _BINV)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["b"][:n], _powers["i"][:n]


def _prime_pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo the prime 2**31 - 1."""
    if len(_powers.get("p", ())) < n:
        for key, base in (("p", _Q), ("q", pow(_Q, -1, int(_P)))):
            p = np.ones(max(n, 1 << 21), np.uint64)
            k = 1
            while k < len(p):
                to = min(2 * k, len(p))
                p[k:to] = p[: to - k] * np.uint64(pow(base, k, int(_P))) % _P
                k = to
            _powers[key] = p
    return _powers["p"][:n], _powers["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair.

    Two polynomials are mixed: one modulo 2**64, and one modulo a prime, as the first alone can't tell some periodic
    sequences apart. Spans of one call are at most 2**31 values long.
    """
    n = len(values)
    b, inv = _pow(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * b[:n], out=sums[1:])
    one = (sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64)
    p, q = _prime_pow(n + 1)
    np.cumsum(values % _P * p[:n] % _P, out=sums[1:])
    two = (sums[ends] - sums[starts]) % _P * q[starts] % _P
    return mix(one ^ mix(two))


def words(texts: list[bytes], segment: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words begin (one more entry than texts).

    A word is a run of digits, ASCII letters (case folded) and bytes from 0x80 on.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    is_word = _WORD[raw]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if len(raw) and is_word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # by segments, so that tables of powers stay small for any length of text
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + segment, "right")))
        lo, hi = starts[at], ends[to - 1]
        out[at:to] = span_hashes(_LOWER[raw[lo:hi]], starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return out, np.searchsorted(starts, begins)


def shingles(hashes: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that stay in one text; a text of fewer words, but one at least, has one run."""
    counts = np.diff(begins)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out_begins = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    doc = np.repeat(np.arange(len(counts)), sizes)
    pos = begins[:-1][doc] + (np.arange(out_begins[-1]) - out_begins[:-1][doc])
    left = np.minimum(begins[1:][doc] - pos, n)
    acc = np.zeros(len(pos), np.uint64)
    for k in range(n):
        acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + np.where(left > k, padded[pos + k], np.uint64(k)) + np.uint64(1)) if k == n - 1 else acc * np.uint64(0x9FB21C651E98DF25) + np.where(left > k, padded[pos + k], np.uint64(k))
    return acc, out_begins
