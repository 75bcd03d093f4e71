"""Suffix-array dedup of byte strings, by bucket-pointer refinement.

A shard sorts the suffixes of its runs: the first buckets hold equal 8-grams; a
bucket is then split by the bucket pointers of its members' suffixes 8, 16 and
18 symbols on, so that each pass reuses what the last one refined, until buckets
hold equal 50-byte strings. A pass reads the pointers that the one before it left:
pointers refreshed inside a pass may tell apart strings that differ only beyond
50 bytes, and such strings are equal here. Buckets of one suffix are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import NO_ID, Rule, _changes, _texts, covered, drop_repeats
from .symbols import BYTE_CODES

WINDOW = 50
GRAM = 8


def bucket_pointers(text: np.ndarray, left: np.ndarray, depth: int, gram: int = GRAM) -> np.ndarray:
    """For each place of a byte array the pointer of its bucket. ``left``: bytes
    from a place to the end of its run. Of the places with ``depth`` bytes left,
    those with one pointer have equal ``depth`` bytes."""
    n = len(text)
    if n + depth >= 1 << 31:
        raise ValueError("a shard of bytes is too large: pointers of 31 bits are sorted in pairs")
    active = np.flatnonzero(left >= gram)
    padded = np.r_[text, np.zeros(gram, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(gram):
        key = (key << np.uint64(8)) | padded[k : k + n]
    key = key[active]
    order = np.argsort(key)
    active, key = active[order], key[order]
    begin = _changes(key)
    size = np.diff(np.r_[begin, len(key)])
    pointer = np.full(n + depth, -1, np.int64)
    pointer[active] = np.repeat(begin, size)
    known = gram
    while known < depth:
        step = min(known, depth - known)
        # buckets of one suffix are settled; so are places too near their end
        active = active[np.repeat(size > 1, size)]
        active = active[left[active] >= known + step]
        if not len(active):
            break
        key = (pointer[active] << np.int64(32)) + pointer[active + step]
        order = np.argsort(key)
        active, key = active[order], key[order]
        begin = _changes(key)
        size = np.diff(np.r_[begin, len(key)])
        # the pointer of a part: its bucket's pointer and what sorts before it inside
        bucket = key[begin] >> np.int64(32)
        first = np.repeat(begin[_changes(bucket)], np.diff(np.r_[_changes(bucket), len(bucket)]))
        pointer[active] = np.repeat(bucket + begin - first, size)
        known += step
    return pointer[:n]


def first_documents(content, windows, docs, places) -> np.ndarray:
    """Windows whose document is the first with their bytes."""
    lengths = windows + WINDOW - 1
    begins = np.cumsum(lengths) - lengths
    spots = np.repeat(begins, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    left = np.repeat(begins + lengths, lengths) - np.arange(len(content))
    bucket = bucket_pointers(content, left, WINDOW)[spots]
    doc = np.repeat(docs, windows)
    least = np.full(len(content), NO_ID, np.int64)
    np.minimum.at(least, bucket, doc)
    return least[bucket] == doc


def _bytes(text) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


RULE = Rule("suffix-dedup", WINDOW, 20, _bytes, lambda units: BYTE_CODES[units], first_documents, True, 16 << 20, 4)


def _finish(with_text: bool):
    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for doc, text, flags, owned in _texts(batch, "id", "bytes", "flags", "owned"):
                n, gone = covered(RULE, text, flags, owned)
                removed = int(gone.sum())
                kept = _bytes(text)[~gone].tobytes() if removed else bytes(text)
                ids.append(None if doc == NO_ID else doc)
                rows.append((n, removed, int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0, hashlib.sha256(kept).hexdigest(), kept))
            out = list(zip(*rows)) if rows else [()] * 5
            columns = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(out[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a 50-byte string that also starts in a
    document of smaller id.

    doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row, and with
    ``with_text`` the remaining bytes (``kept``, binary: a cut may fall inside a
    character). Null text is empty; texts under 50 bytes lose nothing. Rows of one
    id count as one document and remove nothing from each other; a null id counts
    as the largest. An empty table gives no rows; other columns are not read.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return drop_repeats(docs, RULE, _finish(with_text), schema, id_col, text_col)
