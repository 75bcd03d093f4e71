"""Windows of W symbols that occur more than once in a corpus.

Both substring operators share this frame and differ in the index that a shard
builds (:mod:`suffix_dedup`, :mod:`substring_dedup`):

1. *Anchors.* Every window of W symbols has one anchor: its q-gram of smallest
   hash. Equal windows have equal anchors, so a window recurs only if its anchor
   does. Each task sends each anchor once to the shard that counts it.
2. *Runs.* Consecutive windows with one recurring anchor form a run. Each task
   sends every distinct run content once, for its first owner, to the shard of
   its anchor. Windows of the few anchors that make up more than
   1 / ``HOT_KEYS`` of all occurrences are sent singly, to shards chosen by
   window content, so that no anchor fills a shard.
3. *Owners.* A shard indexes its runs and returns which windows are the first
   with their content. All other windows with a recurring anchor are repeats.
   Runs that share no window with another one by their anchor alone are not
   indexed: all their windows are first.
4. Each document drops what its repeats cover.

All texts are read whole; nothing is capped. Every shuffle is keyed by hash or
document. A shard's size follows corpus / shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, shards_of, text_bytes
from .symbols import BLOCK, gram_hashes, leftmost_minima, member, mix

#: Anchors above this share of all occurrences are dealt by window content; at
#: most so many exist, which bounds the list that is sent to every task.
HOT_KEYS = 65_536
#: and only if they occur so often.
HOT_LEAST = 2_000
#: Symbols hashed at once, so that they stay in a core's cache.
CACHED = 1 << 15
#: Null ids sort last.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Rule:
    """What a window is and which of its occurrences stay."""

    name: str
    window: int
    gram: int
    #: text bytes -> array of units (bytes, or words as 64-bit hashes)
    units: Callable[[bytes], np.ndarray]
    #: units -> 64-bit codes to hash
    codes: Callable[[np.ndarray], np.ndarray]
    #: (all symbols of a shard, run starts, run windows, docs, places) -> mask of
    #: the windows, in run order, that are first with their content
    first: Callable[..., np.ndarray]
    #: True: the first document keeps all its windows of a content; False: only the first place
    whole_document: bool
    #: bytes of text for each shard
    share: int
    #: parts of a shard, indexed one after another
    parts: int


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; numbers by byte planes, which compress where they are small or near one another."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.nbytes, ord(a.dtype.char) + 256 * a.dtype.itemsize))], np.int64)
    planes = (np.ascontiguousarray(a) if a.dtype.kind == "V" else np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T) for a in map(np.ascontiguousarray, arrays))
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(x.tobytes() for x in planes)]))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 8), 8 + 16 * n, []
    for size, kind in zip(head[::2].tolist(), head[1::2].tolist()):
        if kind % 256 == ord("V"):
            out.append(np.frombuffer(data, np.dtype(f"V{kind // 256}"), size // (kind // 256), at))
        else:
            dtype = np.dtype(chr(kind % 256))
            planes = np.frombuffer(data, np.uint8, size, at).reshape(dtype.itemsize, -1)
            out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += size
    return out


def anchors(symbols: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a text: the place of its anchor, and the anchor's key (48 bits)."""
    n = len(symbols) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, keys = [], []
    for lo in range(0, n, CACHED):
        h = gram_hashes(symbols[lo : lo + CACHED + window - 1], gram)
        at = leftmost_minima(h, window - gram + 1)
        places.append(at + lo)
        keys.append(h[at] >> np.uint64(16))
    return np.concatenate(places), np.concatenate(keys)


def short(keys: np.ndarray) -> np.ndarray:
    """Keys as a document's flags hold them. Two anchors of one document may
    share a short key; then both are flagged, and the shards sort it out."""
    return keys.astype(np.uint32)


def _changes(x: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def _texts(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    cols = [batch.column(n) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_buffer() if pa.types.is_binary(c.type) and c[i].is_valid else c[i].as_py() for c in cols)


def _binary(parts: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """parts, cut at the given places, as binary values."""
    if parts.nbytes > np.iinfo(np.int32).max:
        raise ValueError("a bucket of documents is too large: more shards are needed")
    offsets = (np.r_[cuts, len(parts)] * parts.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes())])


def by_bucket(ids: np.ndarray, values: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """(id, value) rows packed for each bucket of ids."""
    bucket = (mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((ids, bucket))
    bucket, ids, values = bucket[order], ids[order], values[order]
    cuts = np.r_[_changes(bucket), len(bucket)]
    pieces = [(int(bucket[a]), squeeze(np.diff(ids[a:b], prepend=0), values[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
    return [k for k, _ in pieces], [x for _, x in pieces]


def _by_id(table: pa.Table) -> pa.Table:
    """One bucket: the packed rows of each id as one binary value."""
    got = [unsqueeze(b) for b in table.column("blob").to_pylist()]
    ids = np.concatenate([np.cumsum(g[0]) for g in got])
    values = np.concatenate([g[1] for g in got])
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    cuts = _changes(ids)
    return pa.table([pa.array(ids[cuts], pa.int64()), _binary(values, cuts)], ["id", "blob"])


def _asked(rule: Rule, shards: int, buckets: int):
    """Per task: each anchor once, packed by shard; and, by bucket of documents, the anchors that recur in the task itself."""

    def run(batches):
        ids, keys = [], []
        for batch in batches:
            for doc, text in _texts(batch, "id", "bytes"):
                at, key = anchors(rule.codes(rule.units(text)), rule.window, rule.gram)
                key = key[_changes(at)]
                keys.append(key)
                ids.append(np.full(len(key), doc, np.int64))
        if not keys:
            return
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        at = _changes(keys)
        counts = np.diff(np.r_[at, len(keys)])
        again = np.repeat(counts > 1, counts)
        only, asks = keys[at], ids[at]
        shard = (only % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        cuts = np.r_[_changes(shard[order]), len(order)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            yield _rows([int(shard[own[0]])], [None], [squeeze(np.diff(only[own], prepend=np.uint64(0)), asks[own], counts[own].astype(np.int32))])
        for bucket, blob in zip(*by_bucket(ids[again], short(keys[again]), buckets)):
            yield _rows([-1], [bucket], [blob])

    return run


def _rows(shard, ids, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(ids, pa.int64()), blobs if isinstance(blobs, pa.Array) else pa.array(blobs, pa.binary())], ["shard", "id", "blob"])


def _answered(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """One shard: the anchors that occur twice or more, for the documents that asked; and their counts where large."""
        keys, ids, counts = [], [], []
        for blob in table.column("blob").to_pylist():
            k, d, n = unsqueeze(blob)
            keys.append(np.cumsum(k, dtype=np.uint64))
            ids.append(d)
            counts.append(n)
        keys, ids, counts = np.concatenate(keys), np.concatenate(ids), np.concatenate(counts).astype(np.int64)
        order = np.argsort(keys)
        keys, ids, counts = keys[order], ids[order], counts[order]
        at = _changes(keys)
        total = np.add.reduceat(counts, at)
        seen = np.diff(np.r_[at, len(keys)])
        ask = np.repeat(total > 1, seen) & (counts == 1)
        many = total >= HOT_LEAST
        hot_keys, hot_counts = keys[at][many], total[many]
        bucket, blobs = by_bucket(ids[ask], short(keys[ask]), buckets)
        n, m = len(bucket), len(hot_keys)
        rows = [
            pa.array([*bucket, *([None] * m)], pa.int64()), pa.array([*([None] * n), *hot_keys.astype(np.int64).tolist()], pa.int64()),
            pa.array([*([None] * n), *hot_counts.tolist()], pa.int64()), pa.array([*blobs, *([None] * m)], pa.binary()),
        ]
        return pa.table(rows, ["id", "hot_key", "hot_count", "blob"])

    return run


def _flagged(rule: Rule, text, flags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units; for each window its anchor's place and key and whether the anchor recurs."""
    units = rule.units(text)
    at, key = anchors(rule.codes(units), rule.window, rule.gram)
    known = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in flags]))
    begin = _changes(at)  # neighbours of one anchor are looked up once
    return units, at, key, np.repeat(member(short(key[begin]), known), np.diff(np.r_[begin, len(at)]))


def run_names(content: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A name of 128 bits for each run's units, as two numbers."""
    raw, wide = content.tobytes(), content.itemsize
    names = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip((begins * wide).tolist(), ((begins + lengths) * wide).tolist())]
    return np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)


def first_owners(rule: Rule, name: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of runs with one name, those that belong to the first owner."""
    order = np.lexsort((name[:, 1], name[:, 0]))
    ordered = name[order]
    begin = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)])
    count = np.diff(np.r_[begin, len(order)])
    doc = docs[order]
    mine = doc == np.repeat(np.minimum.reduceat(doc, begin), count)
    if not rule.whole_document:  # only the first place of the first document
        place = np.where(mine, places[order], NO_ID)
        mine &= place == np.repeat(np.minimum.reduceat(place, begin), count)
    out = np.empty(len(name), bool)
    out[order] = mine
    return out


def take_runs(mine: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of the units of some runs."""
    n = lengths[mine]
    return np.repeat(begins[mine], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def gram_keys(rule: Rule, content: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the gram at each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(rule.gram):
        out = mix(out + rule.codes(content[at + k]))
    return out


def contested(rule: Rule, keys: np.ndarray, docs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Of runs with their anchors' keys, one owner for each content, those that may
    share a window with a run of another owner. Equal windows have equal anchors,
    and a run has no window twice. So an anchor is settled if one document (or
    one run) has it; and if its runs are single windows, all different as they are."""
    order = np.argsort(keys)
    begin = _changes(keys[order])
    count = np.diff(np.r_[begin, len(order)])
    if not len(order):
        return np.empty(0, bool)
    doc = docs[order]
    alone = np.minimum.reduceat(doc, begin) == np.maximum.reduceat(doc, begin) if rule.whole_document else count == 1
    single = np.maximum.reduceat(windows[order], begin) == 1
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(~(alone | single), count)
    return out


def _runs(rule: Rule, shards: int, hot: np.ndarray):
    """Per task: each distinct run content once, for its first owner, packed by shard."""
    w = rule.window

    def flush(parts):
        content, docs, places, windows, keys, offsets = (np.concatenate([p[i] for p in parts]) for i in range(6))
        lengths = windows + w - 1
        begins = np.r_[0, np.cumsum(lengths)[:-1]]
        name = run_names(content, begins, lengths)
        own = np.flatnonzero(first_owners(rule, name, docs, places))
        single = member(keys, hot) & (windows == 1)
        key = np.where(single, name[:, 0], keys)[own]
        part = (key % np.uint64(shards) * np.uint64(rule.parts) + key // np.uint64(shards) % np.uint64(rule.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        own, part = own[order], part[order]
        shard = part // rule.parts
        cuts = np.r_[_changes(shard), len(own)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            mine = own[a:b]
            spots = take_runs(mine, begins, lengths)
            sizes = np.bincount(part[a:b] % rule.parts, minlength=rule.parts)
            yield _rows([int(shard[a])], [None], [squeeze(content[spots], docs[mine], places[mine].astype(np.int64), windows[mine].astype(np.int32), offsets[mine], sizes)])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for doc, text, flags in _texts(batch, "id", "bytes", "flags"):
                units, at, key, on = _flagged(rule, text, flags)
                # a run: neighbours with one anchor; windows of hot anchors stand alone
                starts = _changes(at)
                windows = np.diff(np.r_[starts, len(at)])
                alone = member(key[starts], hot)
                if alone.any():
                    pieces = np.where(alone, windows, 1)
                    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
                    starts = np.repeat(starts, pieces) + np.arange(len(first)) - first
                    windows = np.diff(np.r_[starts, len(at)])
                keep = on[starts] if len(starts) else np.empty(0, bool)
                starts, windows = starts[keep], windows[keep]
                if not len(starts):
                    continue
                n = windows + w - 1
                spots = np.repeat(starts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                parts.append((units[spots], np.full(len(starts), doc, np.int64), starts, windows, key[starts], (at[starts] - starts).astype(np.int32)))
                held += len(spots)
                if held > 8 * BLOCK:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _owners(rule: Rule, buckets: int):
    """One shard: the first windows of each content, as ranges by document."""

    def ranges_of(got: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        content, docs, places, windows, offsets = (np.concatenate([g[i] for g in got]) for i in range(5))
        windows = windows.astype(np.int64)
        # tasks have sent some runs each for its own first owner: one owner stays
        lengths = windows + rule.window - 1
        begins = np.cumsum(lengths) - lengths
        own = np.flatnonzero(first_owners(rule, run_names(content, begins, lengths), docs, places))
        disputed = own[contested(rule, gram_keys(rule, content, begins[own] + offsets[own]), docs[own], windows[own])]
        indexed = np.zeros(len(docs), bool)
        indexed[disputed] = True
        first = np.ones(int(windows[own].sum()), bool)
        if len(disputed):
            first[np.repeat(indexed[own], windows[own])] = rule.first(content[take_runs(disputed, begins, lengths)], windows[disputed], docs[disputed], places[disputed])
        docs, places, windows = docs[own], places[own], windows[own]
        doc = np.repeat(docs, windows)[first]
        place = (np.repeat(places, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows))[first]
        # runs stand in one piece, so neighbours in place are neighbours here
        new = np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)] if len(doc) else np.empty(0, bool)
        at = np.flatnonzero(new)
        return doc[at], place[at], np.diff(np.r_[at, len(place)])

    def run(table: pa.Table) -> pa.Table:
        parts: list[list[list[np.ndarray]]] = [[] for _ in range(rule.parts)]
        for blob in table.column("blob").to_pylist():
            content, docs, places, windows, offsets, sizes = unsqueeze(blob)
            lengths = np.r_[0, np.cumsum(windows.astype(np.int64) + rule.window - 1)]
            cuts = np.r_[0, np.cumsum(sizes)]
            for k in range(rule.parts):
                a, b = cuts[k], cuts[k + 1]
                if b > a:
                    parts[k].append([content[lengths[a] : lengths[b]], docs[a:b], places[a:b], windows[a:b], offsets[a:b]])
        doc, place, count = (np.concatenate(x) for x in zip(*(ranges_of(p) for p in parts if p)))
        span = np.empty(len(doc), np.dtype([("place", np.int64), ("count", np.int64)]))
        span["place"], span["count"] = place, count
        bucket, blobs = by_bucket(doc, span.view("V16"), buckets)
        return pa.table([pa.array(bucket, pa.int64()), pa.array(blobs, pa.binary())], ["id", "blob"])

    return run


def covered(rule: Rule, text, flags: list[bytes] | None, owned: list[bytes] | None) -> tuple[int, np.ndarray]:
    """Number of units, and which of them some repeated window covers."""
    if not flags:
        n = len(rule.units(text))
        return n, np.zeros(n, bool)
    units, _, _, repeat = _flagged(rule, text, flags)
    n = len(units)
    if owned:
        ranges = np.concatenate([np.frombuffer(x, np.int64) for x in owned])
        step = np.zeros(len(repeat) + 1, np.int64)
        np.add.at(step, ranges[::2], 1)
        np.add.at(step, ranges[::2] + ranges[1::2], -1)
        repeat = repeat & (np.cumsum(step[:-1]) == 0)
    step = np.zeros(n + 1, np.int64)
    ends = np.flatnonzero(np.diff(np.r_[False, repeat, False]))  # where repeats begin and end, by turns
    step[ends[::2]] += 1
    step[ends[1::2] + rule.window - 1] -= 1
    return n, np.cumsum(step[:-1]) > 0


def drop_repeats(docs: DataFrame, rule: Rule, finish: Callable, schema: str, id_col: str, text_col: str) -> DataFrame:
    """``finish(batch rows (id, bytes, flags, owned)) -> RecordBatch`` over all documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark, rule.name)
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"),
    )
    shards = buckets = shards_of(spark, text_bytes(source, "bytes"), rule.share)
    asked = scratch.keep(source.mapInArrow(_asked(rule, shards, buckets), "shard int, id long, blob binary"))
    answers = scratch.keep(
        asked.filter("shard >= 0").select("shard", "blob").repartition(shards, "shard").groupBy("shard")
        .applyInArrow(_answered(buckets), "id long, hot_key long, hot_count long, blob binary")
    )
    known = asked.filter("shard < 0").select("id", "blob").unionByName(answers.filter("hot_key is null").select("id", "blob"))
    flags = scratch.keep(known.repartition(buckets, "id").groupBy("id").applyInArrow(_by_id, "id long, blob binary").select("id", F.array("blob").alias("flags")))
    # at most HOT_KEYS keys reach their share of all occurrences
    total = answers.agg(F.sum("hot_count")).collect()[0][0] or 0
    least = max(HOT_LEAST, total // HOT_KEYS)
    hot = np.sort(np.array([r[0] for r in answers.filter(F.col("hot_count") >= least).select("hot_key").collect()], np.uint64))
    scratch.drop(asked, answers)
    runs = source.join(flags, "id").mapInArrow(_runs(rule, shards, hot), "shard int, id long, blob binary")
    owned = scratch.keep(runs.select("shard", "blob").repartition(shards, "shard").groupBy("shard").applyInArrow(_owners(rule, buckets), "id long, blob binary"))
    owned = owned.repartition(buckets, "id").groupBy("id").applyInArrow(_by_id, "id long, blob binary").select("id", F.array("blob").alias("owned"))
    ready = source.join(flags, "id", "left").join(owned, "id", "left")
    return ready.mapInArrow(finish, schema)
