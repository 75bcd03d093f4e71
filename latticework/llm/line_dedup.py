"""Fuzzy line dedup: one line stays of every group of similar lines in a corpus."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .minhash import PACKED_SCHEMA, SHARD_KEYS, SORTED, linked, packed_keys, wide_band_keys
from .repeats import NO_ID, _changes, _texts, squeeze, unsqueeze
from .rows import packed, unpacked
from .scratch import Scratch, shards_of, text_bytes
from .symbols import gram_hashes, mix

#: Characters in a shingle; a shorter line is one shingle.
SHINGLE = 5
#: Bands, and values in a band. A pair of similarity s misses all of them with
#: probability (1 - s ** 7) ** 52: 5e-6 at 0.8, which a test measures. Unlike pairs,
#: whose number grows with the square of the lines, meet by chance ever less often
#: with more values.
BANDS, ROWS = 52, 7
PERCENT = 80
#: Bytes of distinct lines that a task or a shard holds at once.
HELD = 1 << 25
#: Distinct lines that are written as one value, 2 ** BLOCK of them.
BLOCK = 9
#: Lines signed together, so that they stay in a core's cache.
TOGETHER = 256


def normal(line: str) -> str:
    """What lines are compared by: lower case, white space runs as one space, trimmed."""
    return " ".join(line.lower().split())


@functools.cache
def _symbols() -> np.ndarray:
    """A well-mixed number for each code point."""
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


def _filled(line: bytes) -> bytes:
    """A short line is filled up with line ends."""
    return line if len(line) >= 4 * SHINGLE else line + b"\n" * (SHINGLE - len(line.decode("utf-8", "surrogatepass")))


def shingles(lines: list) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of non-empty lines (UTF-8), concatenated, and their numbers."""
    filled = [_filled(bytes(x)) for x in lines]
    raw = b"".join(filled)
    sizes = np.array([len(x) for x in filled], np.int64)
    codes = np.frombuffer(raw, np.uint8)
    if not raw.isascii():
        before = np.r_[0, np.cumsum(codes & 0xC0 != 0x80, dtype=np.int64)]
        sizes = np.diff(before[np.r_[0, np.cumsum(sizes)]])
        codes = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    grams = gram_hashes(_symbols()[codes], SHINGLE)
    inside = np.ones(len(grams), bool)
    inside[(np.cumsum(sizes)[:-1, None] - np.arange(1, SHINGLE)).ravel()] = False
    return grams[inside], sizes - SHINGLE + 1


def _normal(line: str) -> str:
    """As :func:`normal`, of a line in lower case. Of all white space only the space is printable."""
    return line.strip(" ") if line.isprintable() and "  " not in line else " ".join(line.split())


def _lines(shards: int):
    """Every distinct line of a task, for its first place, packed by shard of its name."""

    def flush(places: dict[bytes, tuple], texts: dict[bytes, bytes]):
        names = np.frombuffer(b"".join(places), "V16")
        shard = (names.view(np.uint64)[::2] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        held, at = list(texts.values()), np.array(list(places.values()), np.int64).reshape(-1, 2)
        cuts = np.r_[_changes(shard[order]), len(order)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            mine = [held[i] for i in own]
            sizes = np.array([len(x) for x in mine], np.int64)
            blob = squeeze(names[own], at[own, 0], at[own, 1], sizes, np.frombuffer(b"".join(mine), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[own[0]])], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])

    def run(batches):
        places: dict[bytes, tuple] = {}
        texts: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            for doc, text in _texts(batch, "id", "text"):
                for place, line in enumerate(text.lower().split("\n")):
                    if not (line := _normal(line).encode("utf-8", "surrogatepass")):
                        continue
                    name = xxhash.xxh3_128_digest(line)
                    known = places.get(name)
                    if known is None:
                        texts[name] = line
                        held += len(line)
                    if known is None or (doc, place) < known:
                        places[name] = (doc, place)
                if held > HELD:
                    yield from flush(places, texts)
                    places, texts, held = {}, {}, 0
        if places:
            yield from flush(places, texts)

    return run


def _nodes(table: pa.Table) -> pa.Table:
    """One shard: each distinct line once, with its first place, in blocks of lines;
    a line's number is that of its block and its place there."""
    got = [unsqueeze(b) for b in table.column("blob").to_pylist()]
    name, doc, place, sizes, text = (np.concatenate([g[k] for g in got]) for k in range(5))
    begins = np.cumsum(sizes) - sizes
    one, two = name.view(np.uint64)[::2], name.view(np.uint64)[1::2]
    order = np.lexsort((place, doc, two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    own = order[new]
    if len(own) >= 1 << 32:
        raise ValueError("a shard of lines is too large: more shards are needed")
    cuts = np.r_[np.arange(0, len(own), 1 << BLOCK), len(own)]
    first, raw, blobs = int(table.column("shard")[0].as_py()) << 32 - BLOCK, memoryview(text), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        mine = own[a:b]
        held = b"".join([raw[x : x + n] for x, n in zip(begins[mine].tolist(), sizes[mine].tolist())])
        blobs.append(squeeze(sizes[mine], np.frombuffer(held, np.uint8)))
    lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[own], pa.int64())) for x in (doc, place)]
    return pa.table([pa.array(first + np.arange(len(blobs)), pa.int64()), *lists, pa.array(blobs, pa.binary())], NODES)


NODES = ["block", "doc", "place", "lines"]


def _block(blob: bytes) -> list[bytes]:
    """The lines of a block."""
    sizes, text = unsqueeze(blob)
    raw, ends = text.tobytes(), np.cumsum(sizes).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _chosen(batches):
    """The lines of some numbers, block by block."""
    for batch in batches:
        for ids, blob in zip(batch.column("ids").to_pylist(), batch.column("lines")):
            lines = _block(blob.as_buffer())
            some = [lines[i & (1 << BLOCK) - 1] for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(some, pa.binary())], ["id", "set"])


def _keys(shards: int):
    """Band keys of the lines of a task, which are distinct."""

    def run(batches):
        ids, keys, held = [], [], 0
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("lines")):
                lines = _block(blob.as_buffer())
                for a in range(0, len(lines), TOGETHER):
                    element, n = shingles(lines[a : a + TOGETHER])
                    keys.append(wide_band_keys(element, np.cumsum(n) - n, BANDS, ROWS))
                ids.append((block << BLOCK) + np.arange(len(lines)))
                held += len(lines)
                if held >= SORTED // 2:
                    yield from packed_keys(np.concatenate(ids), np.concatenate(keys), shards)
                    ids, keys, held = [], [], 0
        if ids:
            yield from packed_keys(np.concatenate(ids), np.concatenate(keys), shards)

    return run


def _kept(passing: bool, with_text: bool = True):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, keep in _texts(batch, "id", "text", "keep"):
                keep = set(keep or ())
                lines = text.split("\n")
                filled = [i for i, x in enumerate(lines) if x and not x.isspace()]
                gone = {i for i in filled if i not in keep}
                kept = "\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text
                if passing:
                    rows.append(kept)
                    continue
                name = hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((None if doc == NO_ID else doc, len(filled), len(gone), *[kept] * with_text, name))
            if passing:
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(rows, pa.string())], ["row", "kept"])
            else:
                made = {c: kind for c, kind in MADE.items() if with_text or c != "kept"}
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * len(made), made.values())], list(made))

    return run


MADE = {"doc_id": pa.int64(), "n_lines": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "kept_sha256": pa.string()}


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, passing: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the remaining text; not without
    ``with_text``), kept_sha256 for every row; or, with ``passing``, these columns of ``docs`` with the remaining text in
    its column.

    Lines end at \\n and are compared in lower case with white space runs as one
    space; blank lines are no lines and stay. Two lines are linked if the Jaccard
    similarity of their sets of 5-character shingles is at least percent / 100,
    confirmed on full sets; the first line of each component (smallest id, then
    place) stays, all others go. Null text has no lines. Rows of one id are one
    document (of rows that repeat an id the same places stay); a null id counts
    as the largest. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    named = (
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    source = docs.select(*named)
    shards = shards_of(spark, text_bytes(source, "text"), HELD)
    sent = source.mapInArrow(_lines(shards), "shard int, blob binary").repartition(shards, "shard")
    nodes = scratch.keep(sent.groupBy("shard").applyInArrow(_nodes, "block long, doc array<long>, place array<long>, lines binary"))
    count = nodes.agg(F.sum(F.size("doc"))).collect()[0][0] or 0
    shards = shards_of(spark, count * BANDS, SHARD_KEYS)
    blocks = nodes.select("block", "lines")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = ids.groupBy(F.shiftright("id", BLOCK).alias("block")).agg(F.collect_list("id").alias("ids"))
        return blocks.join(wanted, "block").select("ids", "lines").mapInArrow(_chosen, "id long, set binary")

    roots = linked(blocks.mapInArrow(_keys(shards), PACKED_SCHEMA), sets_of, percent, scratch, shards, shingles, 1)
    # lines are looked up and left out by block, so that no row for each line is moved by its number
    at = (F.col("id") - F.shiftleft("block", BLOCK)).cast("int")
    by_block = lambda ids, *more: ids.groupBy(F.shiftright("id", BLOCK).alias("block")).agg(F.collect_list(F.struct("id", *more)).alias("some"))
    places = nodes.select("block", "doc", "place")
    alike = places.join(by_block(roots, "root"), "block").select("block", "doc", "place", F.inline("some"))
    alike = scratch.keep(alike.select("root", F.get("doc", at).alias("doc"), F.get("place", at).alias("place"), "id"))
    first = alike.groupBy("root").agg(F.min(F.struct("doc", "place", "id")).alias("first")).select(F.col("first.id").alias("id"))
    later = by_block(alike.select("id").join(first, "id", "left_anti")).select("block", F.col("some.id").alias("later"))
    placed = places.join(later, "block", "left").select("block", "later", F.posexplode(F.arrays_zip("doc", "place")).alias("at", "first"))
    stays = F.col("later").isNull() | ~F.array_contains("later", F.shiftleft("block", BLOCK) + F.col("at"))
    keep = placed.filter(stays).groupBy(F.col("first.doc").alias("id")).agg(F.collect_list(F.col("first.place").cast("int")).alias("keep"))
    keep = scratch.keep(keep)
    scratch.drop(nodes, roots, alike)
    if passing is None:
        made = "doc_id long, n_lines long, n_removed long, kept string, kept_sha256 string"
        return source.join(keep, "id", "left").mapInArrow(_kept(False, with_text), made if with_text else made.replace(" kept string,", ""))
    others = [c for c in passing if c != text_col]
    wide = docs.select(*named, packed(others))
    out = wide.join(keep, "id", "left").mapInArrow(_kept(True), StructType([wide.schema["row"], StructField("kept", StringType())]))
    columns = dict(zip(others, unpacked(others))) | {text_col: F.col("kept").cast(docs.schema[text_col].dataType).alias(text_col)}
    return out.select(*[columns[c] for c in passing])
