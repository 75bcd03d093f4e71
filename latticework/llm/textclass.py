"""A linear text classifier: hashed words and byte statistics, softmax regression in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .symbols import mix, word_bounds, word_hashes

#: Hashed word features.
BUCKETS = 2048
#: Features that count bytes and shapes.
STYLE = 256 + 8
WIDTH = BUCKETS + STYLE + 1
#: The most labelled rows that a classifier is fitted on, those with the smallest hash of their id.
MOST_TRAINING = 6_000
#: Bytes hashed at once.
AT_ONCE = 1 << 18
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def features(texts: list) -> np.ndarray:
    """One row for each text (UTF-8 bytes). A text without words has only the constant."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    out[:, -1] = 1
    at = 0
    while at < len(texts):  # texts hashed together, separated by line ends
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < AT_ONCE):
            size += len(texts[stop]) + 1
            stop += 1
        _fill(out[at:stop], texts[at:stop])
        at = stop
    return out


def _fill(out: np.ndarray, texts: list) -> None:
    data = np.frombuffer(b"\n".join(bytes(t) for t in texts) + b"\n", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    begins = np.cumsum(sizes) - sizes
    starts, ends = word_bounds(data)
    if not len(starts):
        return
    hashes = word_hashes(LOWER[data], starts, ends)
    doc = np.searchsorted(begins, starts, "right") - 1
    full, first, n = np.unique(doc, return_index=True, return_counts=True)
    row = np.repeat(np.arange(len(full)), n)
    slot = (hashes >> np.uint64(50)).astype(np.int64) % BUCKETS
    out[full, :BUCKETS] = np.sqrt(np.bincount(row * BUCKETS + slot, minlength=len(full) * BUCKETS).reshape(-1, BUCKETS) / n[:, None])
    kinds = LETTER[data]
    letters_before = np.r_[0, np.cumsum(kinds)]
    inside = letters_before[ends] - letters_before[starts]
    by_text = lambda x: np.add.reduceat(x.astype(np.float64), first) / n
    # a line by the sum of its word hashes
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    line_hash, line_row = np.add.reduceat(hashes, new), row[new]
    for k, i in enumerate(full):
        a, size = int(begins[i]), int(sizes[i]) - 1
        counts = np.bincount(data[a : a + size], minlength=256)
        out[i, BUCKETS : BUCKETS + 256] = np.sqrt(counts / size)
        letters = max(1, int(letters_before[a + size] - letters_before[a]))
        own = line_hash[np.searchsorted(line_row, k) : np.searchsorted(line_row, k, "right")]
        words = hashes[first[k] : first[k] + n[k]]
        out[i, BUCKETS + 256 : BUCKETS + 260] = (counts[65:91].sum() / letters, letters / size, len(np.unique(words)) / n[k], len(np.unique(own)) / len(own))
    out[full, BUCKETS + 260] = by_text(inside == 0)
    out[full, BUCKETS + 261] = by_text(inside == ends - starts)
    out[full, BUCKETS + 262] = np.minimum(1, np.log1p(n) / 10)
    out[full, BUCKETS + 263] = np.minimum(1, by_text(ends - starts) / 20)


class Softmax:
    """Weights of a softmax regression, fitted by accelerated gradient descent."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1e-5, steps: int = 800) -> Softmax:
        w = np.zeros((x.shape[1], classes), np.float64)
        if not len(x):
            return cls(w.astype(np.float32))
        target = np.eye(classes, dtype=np.float32)[y]
        rate = 2.0 / (float(np.mean(np.einsum("ij,ij->i", x, x))) * 0.5 + ridge)
        before, momentum = w.copy(), w.copy()
        for t in range(steps):
            p = softmax(x @ momentum.astype(np.float32))
            w = momentum - rate * (x.T @ (p - target) / len(x) + ridge * momentum)
            momentum = w + t / (t + 3) * (w - before)
            before = w
        return cls(w.astype(np.float32))

    def predict(self, texts: list) -> np.ndarray:
        """Class posteriors, one row for each text."""
        out = np.empty((len(texts), self.weights.shape[1]))
        for a in range(0, len(texts), 256):
            out[a : a + 256] = softmax(features(texts[a : a + 256]) @ self.weights)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def training_rows(docs: DataFrame, labels: DataFrame, label, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TRAINING) -> list[tuple[bytes, int]]:
    """(text, class) of at most ``most`` labelled documents: those whose ids have
    the smallest hashes. Ids are broadcast, so their number is their bound."""
    given = labels.select(F.col(id_col).cast("long").alias("_id"), label.cast("int").alias("_label")).filter("_id is not null and _label is not null")
    some = given.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_bytes")).join(F.broadcast(some), "_id").select("_bytes", "_label", "_id").collect()
    return [(bytes(r[0]), r[1]) for r in sorted(rows, key=lambda r: (mix(np.array([r[2]]).view(np.uint64))[0], r[2], r[0]))]
