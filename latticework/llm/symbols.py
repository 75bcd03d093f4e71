"""Vectorised views of many texts at once: bytes, words and their hashes."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = 0x9E3779B97F4A7C15 | 1
#: The ASCII white space that separates words: space, tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: The most symbols that are hashed at once.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX1
    x ^= x >> np.uint64(33)
    x *= MIX2
    x ^= x >> np.uint64(33)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@functools.cache
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(symbols: np.ndarray, q: int) -> np.ndarray:
    """A hash of symbols[i : i + q] for every i, by doubling."""
    n = len(symbols) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, length, out, done = symbols, 1, None, 0
    while True:
        if q & length:
            part = h[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(BASE, length, 1 << 64)) + part
            done += length
        if length * 2 > q:
            return mix(out)
        h = h[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + h[length:]
        length *= 2


def leftmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of w values the place of its smallest by the upper 32
    bits, the leftmost on ties: minima of numbers that hold a value and its place."""
    best = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < w:
        step = min(width, w - width)
        best = np.minimum(best[step:], best[: len(best) - step])
        width += step
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in an array of bytes."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = SPACES[data]
    change = np.flatnonzero(gap[1:] != gap[:-1])
    return change[::2], change[1::2]


#: The lowest n bytes of a 64-bit number.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes. Words of up to 16 bytes are two numbers
    and a length, mixed by bijections; longer ones are hashed by XXH3."""
    if not len(starts):
        return np.empty(0, np.uint64)
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    n = (ends - starts).astype(np.int64)
    low = eight[starts] & LOW_BYTES[np.minimum(n, 8)]
    out = mix(low + n.astype(np.uint64) * MIX1)
    more = np.flatnonzero(n > 8)
    if len(more):
        high = eight[starts[more] + 8] & LOW_BYTES[np.minimum(n[more] - 8, 8)]
        out[more] = mix(out[more] * np.uint64(BASE) + high)
    long = np.flatnonzero(n > 16)
    if len(long):
        raw = data.tobytes()
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values stand in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values
