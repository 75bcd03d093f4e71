"""Near-dedup of documents by min-max hashing of word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .minhash import FOUR, PACKED_SCHEMA, SHARD_KEYS, band_keys, hashed_sets, linked, packed_keys
from .repeats import NO_ID, _texts
from .scratch import Scratch, shards_of
from .symbols import BASE, mix, word_bounds, word_hashes

#: A pair of similarity 0.8 misses all 32 bands with probability (1 - 0.8 ** 4) ** 32 < 5e-8.
BANDS = FOUR
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_set(text, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; with fewer words the whole
    sequence is one shingle, without words there is none."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    w = word_hashes(data, *word_bounds(data))
    if not len(w):
        return w
    size = min(words, len(w))
    out = np.full(len(w) - size + 1, np.uint64(size))
    for k in range(size):
        out = mix(out * np.uint64(BASE) + w[k : len(w) - size + 1 + k])
    return np.unique(out)


def set_name(s: np.ndarray) -> bytes:
    """The name of a set: 128 bits, none for the empty set."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""


def _named(words: int):
    """id, n, name: size and name of each text's set."""

    def run(batches):
        for batch in batches:
            ids, n, names = [], [], []
            for doc, text in _texts(batch, "id", "bytes"):
                s = shingle_set(text, words)
                ids.append(doc)
                n.append(len(s))
                names.append(set_name(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(names, pa.binary())], ["id", "n", "name"])

    return run


def _keys(words: int, bands: tuple, shards: int):
    """Band keys of each different set of a task, for the smallest id that has it."""

    def run(batches):
        owner: dict[bytes, int] = {}
        keys: list[np.ndarray] = []
        names: list[bytes] = []
        sets: list[np.ndarray] = []
        held = 0

        def sign():
            n = np.array([len(s) for s in sets])
            keys.append(band_keys(np.concatenate(sets), np.cumsum(n) - n, bands))
            sets.clear()

        for batch in batches:
            for doc, text in _texts(batch, "id", "bytes"):
                s = shingle_set(text, words)
                if not len(s):
                    continue
                name = set_name(s)
                if name in owner:
                    owner[name] = min(owner[name], doc)
                    continue
                owner[name] = doc
                names.append(name)
                sets.append(s)
                held += len(s)
                if held > 1 << 20:
                    sign()
                    held = 0
        if sets:
            sign()
        if names:
            yield from packed_keys(np.array([owner[x] for x in names], np.int64), np.concatenate(keys), shards)

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            rows = [(doc, shingle_set(text, words).tobytes()) for doc, text in _texts(batch, "id", "bytes")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["id", "set"])

    return run


def _of_groups(signed: DataFrame, groups: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) by the smallest id of each set. Tasks have named a set by their
    own smallest id; such ids are links to the set's smallest."""
    other = signed.join(roots.select("id"), "id", "left_semi").filter("n > 0").join(groups.withColumnRenamed("id", "least"), "name")
    same = other.filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    return components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(same), scratch)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: tuple = BANDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Texts are lower-cased (A-Z) and split at ASCII white space; a text's set is
    its distinct shingles of ``words`` words, as 64-bit hashes of whole words; sets
    are equal if 128-bit hashes of them are. Documents are linked if
    100 * intersection >= percent * union, confirmed on full sets; component_id
    is the smallest id reachable. Equal sets are one node of the graph. Null and
    empty texts have no shingles and no links. Rows of one id are one node; a
    null id counts as the largest and is returned as null. An empty table gives
    no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"),
    )
    signed = scratch.keep(source.mapInArrow(_named(words), "id long, n long, name binary"))
    groups = scratch.keep(signed.filter("n > 0").groupBy("name").agg(F.min("id").alias("id")))
    shards = shards_of(spark, groups.count() * len(bands), SHARD_KEYS)
    roots = linked(
        source.mapInArrow(_keys(words, bands, shards), PACKED_SCHEMA),
        lambda ids: source.join(ids, "id").mapInArrow(_sets(words), "id long, set binary"),
        percent, scratch, shards, hashed_sets, 8,
    )
    found = groups.join(_of_groups(signed, groups, roots, scratch), "id", "left").select("name", F.coalesce("root", "id").alias("root"))
    joined = signed.join(found, "name", "left")
    none = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    root = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("root"))
    return joined.withColumn("root", root).select(
        none("id").alias("doc_id"), F.col("n").alias("n_shingles"), none("root").alias("component_id"), (F.col("id") == F.col("root")).alias("kept")
    )
