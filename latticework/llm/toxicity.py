"""Toxicity by fuzzy lexicon matching.

A lexicon of whole words and of word stems is learned from labelled texts. Its
entries form a trie; Levenshtein automata are run on the trie, so that a state
holds every (trie node, edits) that the letters read so far can stand for.
States are built when first met, which makes a lookup one table step a letter,
and most words leave the automaton after a few. Each hit is weighed by how
reliable its entry, distance and context proved on the labelled texts: a
window around the hit tells quotation from use.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .repeats import _texts
from .scratch import ship
from .textclass import training_rows

#: A document is predicted toxic from this score on.
THRESHOLD = 0.7
#: The most labelled rows the lexicon is learned from.
MOST_TRAINING = 6_000
#: Words on either side of a hit that are its context.
WINDOW = 8
STEM = range(4, 9)
FOLDS = 4
OPEN, CLOSE = "\"“”«»„‘‹›", "\"“”«»‘’‹›"
EDGE = "".join(chr(c) for c in range(33, 48)) + ":;<=>?[\\]^_`{|}~" + "“”«»„‘’‹›…–—¡¿"
#: Trust in a kind of hit before it has been seen, by edits, and the weight of that trust in documents.
PRIOR, PRIOR_WEIGHT = {0: 0.9, 1: 0.75, 2: 0.6}, 2.0
#: Weights before labels are seen: constant, best plain hit, entries, places, near spellings, quotations.
START = np.array([-4.0, 3.0, 1.5, 0.5, 8.0, 1.0])
#: Texts that START counts as. Few labelled texts misspell or quote, so there it counts more.
HOLD = np.array([2.0, 2.0, 2.0, 2.0, 100.0, 100.0])


def budget(word: str, stem: bool) -> int:
    """Edits that are forgiven."""
    if stem:
        return 1 if len(word) >= 6 else 0
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


class Automaton:
    """All entries' Levenshtein automata on their trie, made deterministic as needed."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]  # the largest budget below a node
        for k, (word, stem) in enumerate(entries):
            node = 0
            self.most[0] = max(self.most[0], budget(word, stem))
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], budget(word, stem))
            self.ends[node].append(k)
        self.ids: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.whole: list[tuple[int, int] | None] = []
        self.stem: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The id of a set of (node, edits), closed under skipped entry letters."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes.get(node, 99) < e:
                continue
            for child in self.children[node].values():
                if e < self.most[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(nodes)
            self.next.append({})
            found: list[list[tuple[int, int]]] = [[], []]
            for node, e in nodes.items():
                for k in self.ends[node]:
                    word, stem = self.entries[k]
                    if e <= budget(word, stem):
                        found[stem].append((e, k))
            self.whole.append(min(found[0], default=None))
            self.stem.append(min(found[1], default=None))
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        out: dict[int, int] = {}

        def reach(node, e):
            if e <= self.most[node] and out.get(node, 99) > e:
                out[node] = e

        for node, e in self.states[state].items():
            reach(node, e + 1)
            for c, child in self.children[node].items():
                reach(child, e + (c != letter))
        self.next[state][letter] = got = self._state(out)
        return got

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the closest entry: the whole word, or a stem it begins with."""
        state, best = self.start, None
        for c in word:
            following = self.next[state]
            state = following[c] if c in following else self._step(state, c)
            if not self.states[state]:
                return best
            stem = self.stem[state]
            if stem and (best is None or stem < best):
                best = stem
        whole = self.whole[state]
        return whole if whole and (best is None or whole < best) else best


def tokens(text: str) -> list[str]:
    return text.lower().split()


def quoted(words: list[str], i: int) -> bool:
    """Whether words[i] stands inside quotation marks that open and close within the window."""
    before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
    opened = False
    for w in before:
        if w[0] in OPEN:
            opened = True
        if w[-1] in CLOSE and len(w) > 1 and w is not before[-1]:
            opened = False
    return opened and any(w[-1] in CLOSE or w.rstrip(".,;:!?")[-1:] in tuple(CLOSE) for w in after)


class _Cache(dict):
    """Words looked up so far."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str):
        if len(self) > 1_000_000:
            self.clear()
        self[word] = got = self.automaton.match(word.strip(EDGE))
        return got


@dataclass
class Lexicon:
    entries: list[tuple[str, bool]]
    trust: dict[tuple[int, int], float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: START.copy())

    def hits(self, text: str, cache: _Cache) -> dict[tuple[int, int], list[int]]:
        """(edits, entry) found in a text, with the number of plain and of quoted places."""
        words, out = tokens(text), {}
        for i, w in enumerate(words):
            if (hit := cache[w]) is not None:
                out.setdefault(hit, [0, 0])[quoted(words, i)] += 1
        return out

    def evidence(self, hits: dict[tuple[int, int], list[int]]) -> np.ndarray:
        """What the score weighs: the most trusted plain hit, how many trusted
        entries and places, near spellings, and hits that are only quoted."""
        best = entries = places = near = quotes = 0.0
        for (e, k), (plain, only) in hits.items():
            p = self.trust.get((e, k), PRIOR[e])
            if p < (0.7 if e and (e, k) in self.trust else 0.5):
                continue
            if not plain:
                quotes += p
            elif e:
                near += p
            else:
                best, entries, places = max(best, min(1.5, math.log(p / (1 - p)) / 3)), entries + 1, places + plain
        return np.array([1.0, best, math.log1p(entries), math.log1p(places), math.log1p(near), math.log1p(quotes)])

    def score(self, hits: dict[tuple[int, int], list[int]]) -> float:
        return float(1 / (1 + np.exp(-self.evidence(hits) @ self.weights)))


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, held near START where the texts say little. Only the
    constant may turn negative, and quotation weighs less than use."""
    w = START.copy()
    rate = 1.0 / (np.mean((x * x).sum(axis=1)) * 0.25 + 1e-2)
    for _ in range(3000):
        p = 1 / (1 + np.exp(-x @ w))
        w -= rate * (x.T @ (p - y) / len(x) + (w - START) * HOLD / len(x))
        w[1:] = np.maximum(w[1:], 0)
        w[5] = min(w[5], 0.5 * w[4])
    return w


def marks(text: str) -> set[tuple[str, bool]]:
    """What a text could be recognised by: its words, and their beginnings as stems."""
    out = set()
    for w in set(tokens(text)):
        w = w.strip(EDGE)
        if len(w) >= 3:
            out.add((w, False))
            out.update((w[:k], True) for k in STEM if len(w) >= k)
    return out


def select(positive: Counter, negative: Counter, total: int, rows: int) -> list[tuple[str, bool]]:
    """The marks of label 1: those more frequent there than chance would make any
    of the candidates. Of nested marks, the longest that loses nothing, then no
    longer ones."""
    if not total or total == rows:
        return []
    common = [c for c, n in positive.items() if n >= 3]
    bar = (math.log(max(2, len(common))) + 3) / max(0.1, -math.log(total / rows))
    good = [c for c in common if positive[c] >= bar and positive[c] >= 0.9 * (positive[c] + negative[c])]
    kept: list[tuple[str, bool]] = []
    for c in sorted(good, key=lambda c: (-positive[c], -len(c[0]), c[1], c[0])):
        word, stem = c
        if any(word.startswith(k) if s else word == k for k, s in kept):
            continue
        if stem and any(k.startswith(word) and positive[(k, s)] >= 0.95 * positive[c] for k, s in kept):
            continue
        kept.append(c)
    return sorted(kept)


def learn(rows: list[tuple[str, int]]) -> Lexicon:
    """A lexicon from (text, label). Trust in an entry comes from texts that
    played no part in selecting it: each fold is searched with the entries that
    the other folds select."""
    if not rows:
        return Lexicon([])
    counts = [[Counter(), Counter()] for _ in range(FOLDS)]
    sizes = [[0, 0] for _ in range(FOLDS)]
    for i, (text, y) in enumerate(rows):
        counts[i % FOLDS][y].update(marks(text))
        sizes[i % FOLDS][y] += 1
    every = [sum((c[y] for c in counts), Counter()) for y in (0, 1)]
    total = sum(s[1] for s in sizes)
    out = Lexicon(select(every[1], every[0], total, len(rows)))
    seen: dict = {}
    held: list = []
    for f in range(FOLDS):
        rest = [every[y] - counts[f][y] for y in (0, 1)]
        part = Lexicon(select(rest[1], rest[0], total - sizes[f][1], len(rows) - sum(sizes[f])))
        cache = _Cache(Automaton(part.entries))
        for text, y in rows[f::FOLDS]:
            found = {(e, part.entries[k]): n for (e, k), n in part.hits(text, cache).items()}
            held.append((found, y))
            for (e, entry), (plain, _) in found.items():
                if plain and e == 0:
                    seen.setdefault((e, entry), [0, 0])[y] += 1
    # near spellings had no part in the selection: all texts tell about them
    cache = _Cache(Automaton(out.entries))
    for text, y in rows:
        for (e, k), (plain, _) in out.hits(text, cache).items():
            if plain and e:
                seen.setdefault((e, out.entries[k]), [0, 0])[y] += 1
    trust = {key: (yes + PRIOR_WEIGHT * PRIOR[key[0]]) / (yes + no + PRIOR_WEIGHT) for key, (no, yes) in seen.items()}
    out.trust = {(e, k): trust[(e, entry)] for k, entry in enumerate(out.entries) for e in PRIOR if (e, entry) in trust}
    named = Lexicon([], trust)
    out.weights = calibrate(np.array([named.evidence(h) for h, _ in held]), np.array([y for _, y in held], float))
    return out


def _scored(lexicon: Lexicon):
    def run(batches):
        cache = _Cache(Automaton(lexicon.entries))
        for batch in batches:
            hits = [lexicon.hits(text, cache) for (text,) in _texts(batch, "_text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([lexicon.score(h) for h in hits], pa.float64()), pa.array([len(h) for h in hits], pa.int64()), pa.array([sum(not plain for plain, _ in h.values()) for h in hits], pa.int64())],
                [*batch.schema.names[:-1], "score", "n_terms", "n_quoted"],
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> DataFrame:
    """doc_id, held_out, score, predicted, n_terms, n_quoted for every row.

    Labels are learned from at most ``most`` rows, only from those whose
    crc32(doc_id as text) mod 3 is not 1. A text without hits, and so a null or
    empty one, has the share of toxic texts among labelled texts without hits.
    Without usable labels the lexicon is empty. Null ids are held out: no label
    can be theirs. Repeated rows get equal scores; other columns are not read.
    """
    ship(docs.sparkSession)
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    rows = training_rows(docs, labels.filter(part != 1), F.col("toxic"), most=most)
    lexicon = learn([(t.decode("utf-8", "replace"), int(y == 1)) for t, y in rows])
    wide = docs.select("doc_id", F.coalesce(part == 1, F.lit(True)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    scored = wide.mapInArrow(_scored(lexicon), f"doc_id {kind}, held_out boolean, score double, n_terms long, n_quoted long")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_terms", "n_quoted")
