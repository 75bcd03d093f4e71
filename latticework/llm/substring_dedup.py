"""Substring dedup of word windows with a compressed FM-index per shard.

A shard concatenates its runs and indexes them (suffix order, Burrows-Wheeler
transform, wavelet tree over packed bit vectors). The runs are then streamed
through backward search from the end of every window: the matching statistic says
how many of its words, last to first, stand elsewhere too. Windows whose statistic
reaches the full length repeat; equal windows share a suffix interval, and the
first of them by document and place is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .fm_index import FMIndex
from .repeats import NO_ID, Rule, _texts, covered, drop_repeats
from .symbols import word_bounds, word_hashes

WINDOW = 20
#: Windows searched at once.
AT_ONCE = 1 << 16


def first_places(content, windows, docs, places) -> np.ndarray:
    """Windows that are the first with their words, by document and place."""
    lengths = windows + WINDOW - 1
    run = np.repeat(np.arange(len(windows)), lengths)
    begins = np.cumsum(lengths) - lengths
    # a 0 after each run
    _, code = np.unique(content, return_inverse=True)
    text = np.zeros(len(content) + len(windows), np.int64)
    text[np.arange(len(content)) + run] = code + 1
    begins = begins + np.arange(len(windows))
    nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    spots = np.repeat(begins, windows) + nth
    doc, place = np.repeat(docs, windows), np.repeat(places, windows) + nth
    index = FMIndex(text)
    found, begin = [], []
    for a in range(0, len(spots), AT_ONCE):
        length, at = index.matches(text, spots[a : a + AT_ONCE] + WINDOW, WINDOW)
        again = np.flatnonzero(length == WINDOW)
        found.append(again + a)
        begin.append(at[again])
    again, interval = np.concatenate(found), np.concatenate(begin)
    order = np.lexsort((place[again], doc[again], interval))
    again, interval = again[order], interval[order]
    first = np.ones(len(spots), bool)
    first[again[1:][interval[1:] == interval[:-1]]] = False
    return first


def _words(text) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return word_hashes(data, *word_bounds(data))


RULE = Rule("substring-dedup", WINDOW, 6, _words, lambda units: units, first_places, False, 32 << 20, 2)


def _finish(with_text: bool):
    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for doc, text, flags, owned in _texts(batch, "id", "bytes", "flags", "owned"):
                n, gone = covered(RULE, text, flags, owned)
                kept = [w for w, g in zip(bytes(text).split(), gone) if not g]
                kept = b" ".join(kept)
                ids.append(None if doc == NO_ID else doc)
                rows.append((n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            out = list(zip(*rows)) if rows else [()] * 4
            columns = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in out[:2]), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(out[3], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of 20 words that starts earlier too
    (smaller id, or same id and earlier place).

    doc_id, n_words, n_removed, kept_sha256 for every row, and with ``with_text``
    the kept words joined by a space. Words are split at ASCII white space and
    kept as they are. Null text has no words; texts under 20 words lose nothing.
    Rows of one id count as one document and remove nothing from each other; a
    null id counts as the largest. An empty table gives no rows; other columns are
    not read.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return drop_repeats(docs, RULE, _finish(with_text), schema, id_col, text_col)
