"""Benchmark decontamination by character q-grams, edit-budget counting and banded alignment.

A document contains an item if some stretch of it is within an edit distance of
``EDITS`` of the item's text, whatever its length. By the q-gram lemma such a stretch shares at least
m + 1 - q - q * k of the item's m + 1 - q grams, and they lie in a band of
2 * k + 1 neighbouring diagonals. So a document's grams that occur in the
benchmark are counted in overlapping bands; bands that meet the bound are
verified by banded alignment. Both sides are compared in lower case with white
space and punctuation runs as one space.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .repeats import _texts
from .rows import packed, unpacked
from .scratch import ship
from .symbols import BASE, gram_hashes

#: The edit budget as a share of an item's length, the spaces around it included.
EDITS = 0.1
#: The longest grams; shorter items have shorter ones, so that the lemma's bound stays positive.
GRAM = 8
#: Bits of a gram's hash that the table of item grams is looked up by first.
PREFIX = 20
#: The benchmark goes to every task, so its size is checked first.
MOST_BYTES = 64 << 20


@functools.cache
def _word() -> np.ndarray:
    """Whether each code point is a letter or a digit."""
    return np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)


def normal_codes(text: str | None) -> np.ndarray:
    """Numbers for the characters of a text in lower case, with one space between
    its words and at either end; nothing for a text without words."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _word()[points]
    keep = word.copy()
    keep[1:] |= word[:-1]  # a gap gives its first character
    first = int(word.argmax())
    keep[first - 1] = word[first]  # the gap before the first word its last; without words there is none
    return (np.where(word, points, np.uint32(32))[keep].astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)


def within(pattern: np.ndarray, text: np.ndarray, first: int, last: int, budget: int) -> bool:
    """Whether some stretch of ``text`` is within ``budget`` edits of ``pattern``,
    by an alignment on the diagonals (place in text less place in pattern) from
    ``first`` to ``last`` only. A stretch may begin and end anywhere."""
    width = last - first + 1
    far = len(pattern) + 1
    at = np.arange(width) + first  # the place in the text that a diagonal has reached
    padded = np.zeros(len(pattern) + width, np.uint64)  # what lies outside the text equals nothing
    lo, hi = max(0, first), min(len(text), last + len(pattern))
    if lo < hi:
        padded[lo - first : hi - first] = text[lo:hi]
    steps = np.arange(width)
    row = np.where((at >= 0) & (at <= len(text)), 0, far)
    for i, c in enumerate(pattern):
        now = row + (padded[i : i + width] != c)  # no code is 0
        np.minimum(now[:-1], row[1:] + 1, out=now[:-1])
        at += 1
        now[(at < 0) | (at > len(text))] = far
        row = np.minimum.accumulate(now - steps) + steps
        if row.min() > budget:
            return False
    return True


class Grams:
    """The items of one gram length, and the places of their grams."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray]]):
        self.q = q
        self.ids, self.codes = [k for k, _ in items], [c for _, c in items]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.budget = budget(self.size)
        self.least = self.size + 1 - q - q * self.budget
        g = [gram_hashes(c, q) for c in self.codes]
        item, place = np.repeat(np.arange(len(g)), [len(x) for x in g]), np.concatenate([np.arange(len(x)) for x in g])
        g = np.concatenate(g)
        order = np.argsort(g, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.times = np.unique(g, return_counts=True)
        self.first = np.cumsum(self.times) - self.times
        # most grams of a text are no item's: a table of hash prefixes says so
        self.maybe = np.zeros(1 << PREFIX, bool)
        self.maybe[self.grams >> np.uint64(64 - PREFIX)] = True

    def found(self, codes: np.ndarray) -> list[int]:
        """The ids of the items that a text contains."""
        g = gram_hashes(codes, self.q)
        spots = np.flatnonzero(self.maybe[g >> np.uint64(64 - PREFIX)])
        g = g[spots]
        which = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        hit = self.grams[which] == g
        spots, which = spots[hit], which[hit]
        n = self.times[which]
        entry = np.repeat(self.first[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        item, at = self.item[entry], np.repeat(spots, n)
        # most items have too few grams in the whole text
        some = np.flatnonzero((np.bincount(item, minlength=len(self.ids)) >= self.least)[item])
        if not len(some):
            return []
        item, place, at = item[some], self.place[entry[some]], at[some]
        # the grams of a match lie on 2k + 1 neighbouring diagonals: overlapping bands
        # of 4k + 1 diagonals, each 2k after the last, hold them whole
        half = np.maximum(1, 2 * self.budget[item])
        band = (at - place + self.size[item]) // half
        item, band, place = np.r_[item, item], np.r_[band, band - 1], np.r_[place, place]
        # most others too few in a band; bands that share a number count as one here
        number = (item * (len(codes) + 2) + band + 1) & ((1 << (4 * len(item)).bit_length()) - 1)
        some = np.flatnonzero(np.bincount(number)[number] >= self.least[item])
        if not len(some):
            return []
        item, band, place = item[some], band[some], place[some]
        order = np.lexsort((place, band, item))
        item, band, place = item[order], band[order], place[order]
        new = np.r_[True, (item[1:] != item[:-1]) | (band[1:] != band[:-1])]
        cuts = np.flatnonzero(new)
        # the lemma counts grams of the item, each once
        once = new | np.r_[True, place[1:] != place[:-1]]
        enough = np.add.reduceat(once, cuts) >= self.least[item[cuts]]
        done: set[int] = set()
        for c in cuts[enough]:
            i, k = int(item[c]), int(self.budget[item[c]])
            if i not in done:
                first = int(band[c]) * max(1, 2 * k) - int(self.size[i])
                if within(self.codes[i], codes, first - k, first + max(2, 4 * k) + k, k):
                    done.add(i)
        return [self.ids[i] for i in done]


def budget(size):
    return (size * EDITS).astype(np.int64) if isinstance(size, np.ndarray) else int(size * EDITS)


def gram_length(size: int) -> int:
    """The longest gram, ``GRAM`` at most, by which an item with its budget shares one at least."""
    return max(1, min(GRAM, size // (budget(size) + 1)))


class Benchmark:
    """All items. A text and an item have a space at either end, so that an item
    whose length leaves no edit must stand between word ends."""

    def __init__(self, items: list[tuple[int, str]]):
        by_length: dict[int, list] = {}
        for k, text in items:
            if len(codes := normal_codes(text)):
                by_length.setdefault(gram_length(len(codes)), []).append((k, codes))
        self.lengths = [Grams(q, rows) for q, rows in sorted(by_length.items())]

    def found(self, text: str | None) -> list[int]:
        """The ids of the items that a text contains."""
        codes = normal_codes(text)
        if not len(codes):
            return []
        return sorted((k for grams in self.lengths for k in grams.found(codes)), key=lambda k: (k is None, k))


def _search(items: list[tuple[int, str]], many: int):
    def run(batches):
        bench = Benchmark(items)
        for batch in batches:
            found = pa.array([bench.found(text) for (text,) in _texts(batch, "text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, f"found{many}"])

    return run


def contained_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with item_ids (sorted array of bigint): the benchmark
    items that the text contains.

    Null text and empty text contain nothing; null or blank items are contained
    in nothing; items of equal text are all reported, and an item of a null id as
    null. A benchmark above ``MOST_BYTES`` is searched in parts, one after another
    in the same tasks. Rows may repeat; an own column item_ids of ``docs`` is
    replaced, other columns may have any names. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    passing = [c for c in docs.columns if c != "item_ids"]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    parts = 1 + size // MOST_BYTES
    out = docs.select(packed(passing), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for p in range(parts):
        rows = [(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()]
        out = out.mapInArrow(_search(rows, p), StructType([*out.schema.fields, StructField(f"found{p}", ArrayType(LongType()))]))
    return out.select(*unpacked(passing), F.array_sort(F.concat(*[f"found{p}" for p in range(parts)])).alias("item_ids"))
