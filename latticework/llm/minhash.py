"""Sets that overlap: min-max signatures, banding, exact verification, components.

Both near-duplicate operators use this module. A permutation yields two values,
the smallest and the largest image of a set, so a signature of 2k values costs
k hash evaluations. A band joins several of them; members of one bucket (equal
bands) are candidates. No bucket's pairs are listed:

1. Each task sends the smallest of its members of a bucket to one shard, and all
   of several apart from it, so no shard sees all of a large bucket. A bucket of
   two, from two tasks, is one pair, and nothing more is kept of it by key.
2. All members of a bucket are compared with its head, the smallest: as many
   pairs as members. Links are united. By the triangle inequality of the Jaccard
   distance, two linked members are both near the head or both far from it, so
   the far ones take a new head among themselves. Members that met by chance come
   apart in this way.
3. Near members that still lie in several components are searched whole. Buckets
   of one smallest member are a family; buckets that merely share some member stay
   apart, as a chain of them would take in much of a large corpus. A family's sets
   meet in one place, or, if they are too large together, in pairs of blocks, a
   round after another. The overlaps of up to ``FEW`` sets are one product of
   matrices. Of more, a kernel finds each member's partners through an inverted
   index of the rarest elements, counts the overlaps, and returns links that join
   different components only: fewer than it has members.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .repeats import squeeze, unsqueeze
from .scratch import Scratch, shards_of
from .symbols import BASE, MIX2, mix

#: Elements hashed at once.
AT_ONCE = 1 << 17
#: Band keys that one shard sorts.
SHARD_KEYS = 1 << 22
#: Elements of sets that one task compares with one another.
CELL = 1 << 21
#: Copies of a family's sets that pairs of blocks may have on disk at once, as a multiple of all families' sets.
COPIES = 2
#: Bytes of sets that become elements at once in a cell.
PART = 1 << 18
#: Rare elements that two sets must have in common to be compared.
COMMON = 8
#: Sets of a family that are compared by one product of matrices; a power of two.
FEW = 256
#: Elements in one product.
MULTIPLIED = 1 << 13
#: Pairs, and elements of pairs, that are verified at once.
PAIRS = 1 << 9
VERIFIED = 1 << 21

#: Heads that a bucket has one after another before the rest of it is searched whole.
TURNS = 3
#: Members at least so similar to their head stay together.
NEAR = 0.3

#: sets as sent -> (all their elements as 64-bit hashes, one set after another; number of elements of each)
Elements = Callable[[list], tuple[np.ndarray, np.ndarray]]


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of n permutations of the 32-bit numbers."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(BASE)) >> np.uint64(32)
    return seeds[:n].astype(np.uint32) | np.uint32(1), seeds[n:].astype(np.uint32)


def min_max(elements: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima, one row for each of n permutations, of the sets that begin
    at ``begins``. Elements are permuted by their upper halves; two elements of one
    half would count as one, and full sets are compared afterwards."""
    mult, add = permutations(n)
    low = np.empty((n, len(begins)), np.uint32)
    high = np.empty_like(low)
    ends = np.r_[begins[1:], len(elements)]
    at = 0
    while at < len(begins):
        stop = max(at + 1, int(np.searchsorted(ends, begins[at] + AT_ONCE, "right")))
        part, cuts = (elements[begins[at] : ends[stop - 1]] >> np.uint64(32)).astype(np.uint32), begins[at:stop] - begins[at]
        image = np.empty_like(part)
        for k in range(n):
            np.multiply(part, mult[k], out=image)
            np.add(image, add[k], out=image)
            low[k, at:stop] = np.minimum.reduceat(image, cuts)
            high[k, at:stop] = np.maximum.reduceat(image, cuts)
        at = stop
    return low, high


#: Bands of four values: the minima and maxima of two permutations of their own.
FOUR = tuple((2 * j, 2 * j + 1) for j in range(32))


def band_keys(elements: np.ndarray, begins: np.ndarray, bands: tuple[tuple[int, ...], ...] = FOUR) -> np.ndarray:
    """A 64-bit key for each set and band; no set is empty."""
    low, high = min_max(elements, begins, 1 + max(k for band in bands for k in band))
    out = np.empty((len(begins), len(bands)), np.uint64)
    for j, band in enumerate(bands):
        key = np.full(len(begins), np.uint64(j))
        for k in band:
            key = mix(key * np.uint64(BASE) + (low[k].astype(np.uint64) << np.uint64(32) | high[k]))
        out[:, j] = key
    return out


#: Other bins that an empty bin asks before it takes a minimum of its own, for which
#: all elements are hashed again; all bins are asked at once while more than one in
#: ``SWEPT`` is empty.
PROBES, SWEPT = 32, 16
#: What a bin without an element holds; an element of just this value is not seen, in any set.
EMPTY = np.uint32(0xFFFFFFFF)


@functools.cache
def _probes(k: int) -> np.ndarray:
    return (mix(np.arange(1, PROBES * k + 1, dtype=np.uint64) * np.uint64(BASE)) % np.uint64(k)).astype(np.int64).reshape(PROBES, k)


def one_permutation(elements: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    """k minima for each set from one hash of its elements, one row for each of k:
    each bin of hashes gives its minimum; an empty bin takes that of the first filled
    one in an order of bins of its own, or, if ``PROBES`` bins are empty, the element
    that is smallest under a permutation of its own. Two sets agree in a value with a
    probability of their Jaccard similarity."""
    out = np.empty((k, len(begins)), np.uint32)
    ends = np.r_[begins[1:], len(elements)]
    probes = _probes(k)
    seeds = mix(np.arange(1, k + 1, dtype=np.uint64) * MIX2)
    at = 0
    while at < len(begins):
        stop = max(at + 1, int(np.searchsorted(ends, begins[at] + AT_ONCE, "right")))
        part, n = elements[begins[at] : ends[stop - 1]], ends[at:stop] - begins[at:stop]
        slot = part >> np.uint64(32)
        slot *= np.uint64(k)
        slot >>= np.uint64(32)
        slot *= np.uint64(len(n))
        slot += np.repeat(np.arange(len(n), dtype=np.uint64), n)
        made = np.full(k * len(n), EMPTY, np.uint32)
        np.minimum.at(made, slot.view(np.int64), part.astype(np.uint32))
        made = made.reshape(k, len(n))
        full = made.copy()
        blank, asked = full == EMPTY, 0
        while asked < PROBES and np.count_nonzero(blank) * SWEPT > blank.size:
            held = blank.astype(np.uint32)
            held -= np.uint32(1)  # all ones where a bin holds a value
            held |= made[probes[asked]]
            full &= held
            np.equal(full, EMPTY, out=blank)
            asked += 1
        spot = np.flatnonzero(blank)
        bin_, row = np.divmod(spot, len(n))
        flat, given = full.reshape(-1), made.reshape(-1)
        for probe in probes[asked:]:
            if not len(row):
                break
            other = given[probe[bin_] * len(n) + row]
            left = np.flatnonzero(other == EMPTY)
            flat[spot] = other
            spot, bin_, row = spot[left], bin_[left], row[left]
        if len(row):
            size = n[row]
            spots = np.repeat(begins[at + row] - begins[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            own = part[spots]
            image = mix(own ^ np.repeat(seeds[bin_], size)) & ~np.uint64(0xFFFFFFFF) | own & np.uint64(0xFFFFFFFF)
            flat[spot] = np.minimum.reduceat(image, np.cumsum(size) - size).astype(np.uint32)
        out[:, at:stop] = full
        at = stop
    return out


def wide_band_keys(elements: np.ndarray, begins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each set and band of ``rows`` values; no set is empty."""
    values = one_permutation(elements, begins, bands * rows).reshape(bands, rows, len(begins))
    key = np.repeat(np.arange(bands, dtype=np.uint64), len(begins)).reshape(bands, len(begins))
    for k in range(0, rows, 2):
        two = values[:, k].astype(np.uint64)
        two <<= np.uint64(32)
        if k + 1 < rows:
            two |= values[:, k + 1]
        two ^= two >> np.uint64(29)
        key *= np.uint64(BASE)
        key += two
        key ^= key >> np.uint64(33)
    return mix(np.ascontiguousarray(key.T))


def hashed_sets(sets: list) -> tuple[np.ndarray, np.ndarray]:
    """Elements of sets that are sent as 64-bit numbers."""
    return np.frombuffer(b"".join(bytes(s) for s in sets), np.uint64), np.array([len(s) // 8 for s in sets], np.int64)


def _read(sets: list, elements: Elements) -> tuple[np.ndarray, np.ndarray]:
    """The elements of sets; one that stands several times in a row is read once."""
    new = np.array([not i or sets[i] != sets[i - 1] for i in range(len(sets))], bool)
    if new.all():
        return elements(sets)
    element, n = elements([sets[i] for i in np.flatnonzero(new)])
    which = np.cumsum(new) - 1
    return element[_spots((np.cumsum(n) - n)[which], n[which])], n[which]


def similar(a: list, b: list, percent: int, elements: Elements) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of a overlap enough with their sets in b, and the similarities.
    Elements are compared by 54 bits at least of their hashes, inside one pair."""
    good, ratio = np.zeros(len(a), bool), np.zeros(len(a))
    sizes = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    cuts = np.cumsum(sizes)
    at = 0
    while at < len(a):
        stop = min(len(a), at + PAIRS, max(at + 1, int(np.searchsorted(cuts, (cuts[at - 1] if at else 0) + VERIFIED, "right"))))
        rows = stop - at
        bits = 63 - max(1, (rows - 1).bit_length())
        # one number for pair, element and side, so that one order tells all overlaps
        sides = []
        for k, side in enumerate((a[at:stop], b[at:stop])):
            element, n = _read(side, elements)
            packed = element >> np.uint64(63 - bits)
            packed &= ~np.uint64(1)
            packed |= np.repeat(np.arange(rows, dtype=np.uint64) << np.uint64(bits + 1) | np.uint64(k), n)
            sides.append(packed)
        every = np.concatenate(sides)
        every.sort()
        step = every[1:] ^ every[:-1]
        first = np.r_[np.searchsorted(every, np.arange(rows, dtype=np.uint64) << np.uint64(bits + 1)), len(every)]
        union = np.diff(np.r_[0, np.cumsum(np.r_[True, step > 1][: len(every)])][first])
        both = np.diff(np.r_[0, np.cumsum(np.r_[False, step == 1][: len(every)])][first])
        good[at:stop] = 100 * both >= percent * union
        ratio[at:stop] = both / np.maximum(1, union)
        at = stop
    return good, ratio


def _verified(percent: int, elements: Elements):
    def run(batches):
        for batch in batches:
            sets = ([x.as_buffer() for x in batch.column(c)] for c in ("set_a", "set_b"))
            good, ratio = similar(*sets, percent, elements)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good), pa.array(ratio)], ["a", "b", "linked", "ratio"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int, elements: Elements) -> DataFrame:
    """a, b, linked, ratio: whether the full sets of the pairs (a, b) have that Jaccard similarity, and which they have."""
    x = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    y = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(_verified(percent, elements), "a long, b long, linked boolean, ratio double")


PACKED_SCHEMA = "shard int, blob binary"


#: Items whose band keys are sorted together; their places fit in 16 bits.
SORTED = 1 << 16


def _cuts(shard: np.ndarray):
    """Begin and end of the stretches of equal shards."""
    at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else ()
    return zip(at[:-1], at[1:])


def packed_keys(ids: np.ndarray, keys: np.ndarray, shards: int):
    """The smallest member of each bucket of a block of items, and whether the block
    has others, packed by shard of keys; and all members of a bucket that has
    several, packed by shard of ids."""
    number, name, flag = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
    for lo in range(0, len(ids), SORTED):
        own = ids[lo : lo + SORTED]
        order = np.argsort(own, kind="stable")
        own = own[order]
        key = keys[lo : lo + SORTED][order] & ~np.uint64(SORTED - 1)
        packed = np.sort((key | np.arange(len(own), dtype=np.uint64)[:, None]).ravel())
        packed = packed[np.r_[True, packed[1:] != packed[:-1]]]  # a set may meet itself in two bands
        key, id_ = packed >> np.uint64(16), own[(packed & np.uint64(SORTED - 1)).astype(np.int64)]
        new = np.r_[True, key[1:] != key[:-1]]
        first, rest = np.flatnonzero(new), np.flatnonzero(~new)
        bucket = np.searchsorted(first, rest, "right") - 1
        other = id_[rest] != id_[first[bucket]]
        several = np.zeros(len(first), np.uint8)
        several[bucket[other]] = 1
        rest = np.concatenate([first[several > 0], rest[other]])
        for a, b in _cuts(shard := _range_shard(key[first], shards)):
            mine = first[a:b]
            yield _row(int(shard[a]), squeeze(np.diff(key[mine], prepend=np.uint64(0)), id_[mine], several[a:b], number, name))
        shard = _range_shard(mix(id_[rest].view(np.uint64)) >> np.uint64(16), shards)
        rest = rest[order := np.argsort(shard, kind="stable")]
        for a, b in _cuts(shard := shard[order]):
            mine = rest[a:b]
            yield _row(int(shard[a]), squeeze(number, name, flag, key[mine], id_[mine]))


def _range_shard(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 48-bit keys, in their order."""
    return ((key >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _row(shard: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])


def _met(table: pa.Table) -> pa.Table:
    """One shard: a bucket of two items that is whole here as one row, its larger
    member with the other; of larger ones the heads of the tasks, and what tasks
    have sent of their own, one member a row. Members may come twice."""
    got = [unsqueeze(b) for b in table.column("blob").to_pylist()]
    key = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
    id_, more, rest_key, rest = (np.concatenate([g[k] for g in got]) for k in (1, 2, 3, 4))
    # most keys stand once and go at once
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    order = order[np.r_[False, same] | np.r_[same, False]] if len(key) else order
    order = order[np.lexsort((id_[order], key[order]))]
    key, id_, more = key[order], id_[order], more[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    whole = np.maximum.reduceat(more, begin) == 0 if len(key) else np.empty(0, bool)
    new = np.r_[True, (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])] if len(key) else np.empty(0, bool)
    key, id_ = key[new], id_[new]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.r_[at, len(key)])
    pair = at[(count == 2) & whole]
    many = np.repeat((count > 2) | (count == 2) & ~whole, count)
    columns = [np.concatenate(x) for x in ((key[pair].view(np.int64), key[many].view(np.int64), rest_key.view(np.int64)), (id_[pair + 1], id_[many], rest))]
    other = np.concatenate([id_[pair], np.zeros(len(columns[0]) - len(pair), np.int64)])
    none = np.arange(len(other)) >= len(pair)
    return pa.table([*(pa.array(c, pa.int64()) for c in columns), pa.array(other, pa.int64(), mask=none)], ["key", "id", "other"])


def _spots(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches, one after another."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _codes(sets: list, elements: Elements) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each set that other sets have too, as numbers, with
    the set of each, ordered by set and number; and the sizes of the whole sets.
    Sets are read in parts, so that what ``elements`` needs meanwhile stays small."""
    parts, n, at = [], [], 0
    sizes = np.cumsum([len(x) for x in sets])
    while at < len(sets):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART, "right")))
        element, count = elements(sets[at:stop])
        parts.append(element)
        n.append(count)
        at = stop
    number = pa.array(np.concatenate(parts)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint64)
    del parts
    row = np.repeat(np.arange(len(sets), dtype=np.uint64), np.concatenate(n))
    packed = np.sort(row << np.uint64(32) | number)
    packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
    row, code = (packed >> np.uint64(32)).astype(np.int32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int32)
    n = np.bincount(row, minlength=len(sets))
    # elements of one set alone are in no overlap
    shared = (np.bincount(code) > 1)[code]
    return code[shared], row[shared], n


def united(root: np.ndarray, sets: list, side: np.ndarray, percent: int, elements: Elements) -> list[tuple[int, int]]:
    """Links between sets of different components that join them, a forest.

    ``root``: the component of each set. ``side``: 0, or two blocks 0 and 1 of
    which only pairs across count; then links inside a block are known elsewhere.

    Elements have one order, the rarest first. Two linked sets share at least
    ``need`` elements each, percent of their size. So the first ``COMMON`` shared
    ones lie among the first size - need + COMMON of either set: sets with fewer
    in common there are not compared.
    """
    code, row, n = _codes(sets, elements)
    # elements are numbered by how many sets have them
    seen = np.bincount(code)
    rank = np.empty(len(seen), np.uint64)
    rank[np.argsort(seen, kind="stable")] = np.arange(len(seen), dtype=np.uint64)
    packed = np.sort(row.astype(np.uint64) << np.uint64(32) | rank[code])
    row, code = (packed >> np.uint64(32)).astype(np.int32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int32)
    mine = np.searchsorted(row, np.arange(len(sets) + 1))
    need = -(-percent * n // 100)
    rare = np.maximum(0, np.minimum(n, n - need + COMMON) - (n - np.diff(mine)))
    head = np.flatnonzero(np.arange(len(row)) - mine[row] < rare[row])
    by_code = head[np.argsort(code[head], kind="stable")]
    posting, begin = row[by_code], np.searchsorted(code[by_code], np.arange(len(seen) + 1))
    marked = np.zeros(len(seen), bool)
    component = root.copy()
    out = []
    across = bool(side.any())
    for i in np.flatnonzero((rare > 0) & (side == 0)).tolist():
        codes = code[mine[i] : mine[i] + rare[i]]
        common = np.bincount(posting[_spots(begin[codes], begin[codes + 1] - begin[codes])], minlength=len(sets))
        other = np.flatnonzero(common)
        other = other[(side[other] == 1) if across else (other > i)]
        most = np.maximum(n[other], n[i])
        other = other[
            (component[other] != component[i])
            & (100 * np.minimum(n[other], n[i]) >= percent * most)
            & (common[other] >= np.minimum(COMMON, -(-percent * most // 100)))
        ]
        if not len(other):
            continue
        marked[code[mine[i] : mine[i + 1]]] = True
        size = mine[other + 1] - mine[other]
        both = np.add.reduceat(marked[code[_spots(mine[other], size)]].astype(np.int32), np.cumsum(size) - size)
        marked[code[mine[i] : mine[i + 1]]] = False
        for j in other[100 * both >= percent * (n[i] + n[other] - both)].tolist():
            x, y = component[i], component[j]
            if x != y:
                component[component == max(x, y)] = min(x, y)
                out.append((int(root[i]), int(root[j])))
    return out


def few_united(root: np.ndarray, n: np.ndarray, element: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """As :func:`united`, of up to ``FEW`` sets: their elements, one set after
    another, and how many each has. All overlaps are one product of matrices.
    Elements are compared by 56 bits."""
    low = np.uint64(FEW - 1)
    packed = element & ~low
    packed |= np.repeat(np.arange(len(n), dtype=np.uint64), n)
    packed.sort()
    new = np.ones(len(packed) + 1, bool)
    np.not_equal(packed[1:], packed[:-1], out=new[1:-1])
    packed = packed[new[:-1]]
    row = (packed & low).astype(np.int64)
    sizes = np.bincount(row, minlength=len(n))
    new = np.ones(len(packed) + 1, bool)
    np.greater(packed[1:] ^ packed[:-1], low, out=new[1:-1])
    shared = ~(new[:-1] & new[1:])
    new, row = np.flatnonzero(new[:-1][shared]), row[shared]
    both = np.zeros((len(n), len(n)), np.int64)
    for at in range(0, len(new), MULTIPLIED):
        cuts = np.r_[new[at : at + MULTIPLIED + 1], len(row)][: MULTIPLIED + 1]
        has = np.zeros((len(cuts) - 1, len(n)), np.float32)
        has[np.repeat(np.arange(len(has)), np.diff(cuts)), row[cuts[0] : cuts[-1]]] = 1
        both += (has.T @ has).astype(np.int64)
    good = 100 * both >= percent * (sizes[:, None] + sizes - both)
    good &= np.triu(root[:, None] != root, 1)
    if side.any():
        good &= side[:, None] != side
    return sorted({(int(root[i]), int(root[j])) for i, j in zip(*np.nonzero(good))})


def _families(percent: int, elements: Elements):
    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in ("family", "lo", "hi", "block", "root")]
        sets = table.column("set").combine_chunks() if table.num_rows else None
        order = np.lexsort(columns[:3][::-1])
        family, lo, hi, block, root = (c[order] for c in columns)
        cuts = np.flatnonzero(np.r_[True, (family[1:] != family[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True])
        out, few, held, size = [], [], [], 0

        def told():
            element, n = elements(held)
            ends, at = np.r_[0, np.cumsum(n)], 0
            for a, b in few:
                own = n[at : at + b - a]
                found = few_united(root[a:b], own, element[ends[at] : ends[at + b - a]], (block[a:b] != lo[a]).astype(np.int64), percent)
                out.extend(found)
                at += b - a

        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1 and (root[a:b] != root[a]).any():
                mine = [sets[int(i)].as_buffer() for i in order[a:b]]
                if b - a > FEW:
                    out += united(root[a:b], mine, (block[a:b] != lo[a]).astype(np.int64), percent, elements)
                    continue
                few.append((a, b))
                held += mine
                size += sum(x.size for x in mine)
                if size > PART:
                    told()
                    few, held, size = [], [], 0
        if few:
            told()
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def linked(packed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch, shards: int, elements: Elements, width: int, cell: int = CELL) -> DataFrame:
    """(id, root) of every item that is linked with another.

    ``packed``: what :func:`packed_keys` makes of the items' band keys in each
    task; an item of several tasks counts once. ``sets_of(ids)`` gives (id, set)
    for the ids asked, a set as ``elements`` reads it, of about ``width`` bytes for
    each element. Two items are candidates if
    they share a key, and linked if their full sets overlap enough. ``cell``
    bounds the elements that one task compares with one another.
    """
    met = scratch.keep(packed.repartition(shards, "shard").groupBy("shard").applyInArrow(_met, "key long, id long, other long"))
    sets = scratch.keep(sets_of(met.select(F.explode(F.array("id", "other")).alias("id")).filter("id is not null").distinct()))
    # buckets of two are told by their one pair; nothing has to be known by key
    two = met.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    left = scratch.keep(met.filter("other is null").select("key", "id"))
    links, near, told_by_key = [], [], []
    for turn in range(TURNS):
        # the smallest member of each bucket is its head
        heads = left.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1").select("key", "head")
        star = scratch.keep(left.join(heads, "key").filter("id <> head").select("key", F.col("id").alias("a"), F.col("head").alias("b")))
        if not turn:
            scratch.drop(left)
        pairs = star.select("a", "b") if turn else star.select("a", "b").unionByName(two)
        told = scratch.keep(verify(pairs.distinct(), sets, percent, elements))
        if not turn:
            scratch.drop(met)
        links.append(told)
        ratios = scratch.keep(star.join(told.select("a", "b", "ratio"), ["a", "b"]).select("key", F.col("a").alias("id"), "ratio"))
        told_by_key.append(ratios)
        scratch.drop(star)
        # 1 - similarity is a metric: of two linked members both are as near to the head as this or both as far as that
        near.append(ratios.filter(F.col("ratio") >= NEAR).select(F.lit(turn).alias("turn"), "key", "id"))
        left = ratios.filter(F.col("ratio") < NEAR + 1 - percent / 100 + 1e-9).select("key", "id")
    near.append(left.select(F.lit(TURNS).alias("turn"), "key", "id"))
    found = reduce(DataFrame.unionByName, [t.filter("linked").select("a", "b") for t in links])
    roots = components(found, scratch)
    scratch.drop(*links)
    # what is left of a bucket and still lies in several components
    place = reduce(DataFrame.unionByName, near).join(roots, "id", "left").select("turn", "key", "id", F.coalesce("root", "id").alias("root"))
    place = scratch.keep(place)
    scratch.drop(*told_by_key)
    open_ = place.groupBy("turn", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("id").alias("least")).filter("lo < hi")
    items = place.join(open_.select("turn", "key", "least"), ["turn", "key"]).select(F.col("least").alias("family"), "id", "root").distinct()
    items = scratch.keep(items.join(sets, "id").select("family", "id", "root", "set"))
    scratch.drop(place, sets)
    weight = F.octet_length("set") / width
    blocks = items.groupBy("family").agg(F.ceil(F.sum(weight) / cell).cast("long").alias("blocks"), F.sum(weight).alias("weight"))
    total, copied = blocks.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("blocks"))).collect()[0]
    cells = shards_of(scratch.spark, int(total or 0), cell)
    rounds = -(-int(copied or 0) // max(1, int(COPIES * (total or 0)))) or 1
    dealt = items.join(blocks.drop("weight"), "family").withColumn("block", F.pmod(F.xxhash64("id"), F.greatest("blocks", F.lit(1))))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "root", "set", "blocks")
    cell_of = F.pmod(F.xxhash64("family", "lo", "hi"), F.lit(cells)).cast("int")
    # a family of many blocks has a group for each pair of them
    group = F.when(F.col("blocks") > 1, F.xxhash64("family", "lo", "hi")).otherwise(cell_of.cast("long"))
    turn_of = F.pmod(F.xxhash64("family", "lo", "hi", F.lit("round")), F.lit(rounds))
    dealt = dealt.select(group.alias("cell"), turn_of.alias("round"), "family", "lo", "hi", "block", "root", "set")
    parts = []
    for k in range(rounds):
        now = dealt.filter(F.col("round") == k).drop("round").repartition(cells, "cell")
        parts.append(scratch.keep(now.groupBy("cell").applyInArrow(_families(percent, elements), "a long, b long")))
    scratch.drop(items)
    more = reduce(DataFrame.unionByName, parts)
    if more.isEmpty():
        scratch.drop(*parts)
        return roots
    # links join roots: the components of the roots take their members along
    joined = roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more)
    out = components(joined, scratch)
    scratch.drop(roots, *parts)
    return out
