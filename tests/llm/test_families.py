"""The kernel that searches families whole, against all pairs."""

import random

import numpy as np
import pytest

from latticework.llm import minhash
from latticework.llm.line_dedup import BANDS, ROWS, _normal, dedup_lines, normal, shingles
from latticework.llm.minhash import PACKED_SCHEMA, hashed_sets, linked, packed_keys, united
from latticework.llm.scratch import Scratch
from latticework.llm.symbols import mix


def _find(parent: dict, x: int) -> int:
    while parent[x] != x:
        x = parent[x]
    return x


def _components(root, links) -> list[int]:
    parent = {int(r): int(r) for r in root}
    for a, b in links:
        x, y = _find(parent, int(a)), _find(parent, int(b))
        parent[max(x, y)] = min(x, y)
    return [_find(parent, int(r)) for r in root]


@pytest.mark.parametrize("percent", [50, 80, 90])
@pytest.mark.parametrize("across", [False, True])
def test_united_finds_every_link(percent, across):
    rng = random.Random(percent + across)
    found = 0
    for _ in range(40):
        bases = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (3, 9, 20, 40, 120)]
        lines = []
        for _ in range(rng.randint(2, 50)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                line[rng.randrange(len(line))] = rng.choice("abcdéx")
            lines.append("".join(line).encode())
        root = np.array([rng.choice([i, max(0, i - 1)]) for i in range(len(lines))])
        side = np.array([rng.randint(0, 1) * across for _ in lines])
        sets = [set(shingles([x])[0].tolist()) for x in lines]
        pairs = [
            (root[i], root[j])
            for i in range(len(lines))
            for j in range(i)
            if (not side.any() or side[i] != side[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
        ]
        links = united(root, lines, side, percent, shingles)
        assert len(links) < len(lines)
        assert _components(root, links) == _components(root, pairs)
        found += len(links)
    assert found


@pytest.mark.parametrize("cell", [1 << 21, 100])
def test_chained_buckets_are_no_one_family(spark, cell):
    """Buckets {i, i + 1, i + 2} of sets half alike: a family holds one bucket, not the
    chain of all; the one pair of linked sets that no head has shown is found, in
    rounds of small blocks too."""
    n, common = 60, mix(np.arange(50, dtype=np.uint64))
    sets = [np.concatenate([common, mix(np.arange(1_000 * (i + 1), 1_000 * (i + 1) + 25, dtype=np.uint64))]) for i in range(n)]
    sets[32] = sets[31]
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate(sets)]
    sizes = []

    class Seen(Scratch):
        def keep(self, df):
            out = super().keep(df)
            if df.columns == ["family", "id", "root", "set"]:
                sizes.extend(r["count"] for r in out.groupBy("family").count().collect())
            return out

    def keys(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            near = mix((ids[:, None] - np.arange(3) + 1_000).astype(np.uint64))
            yield from packed_keys(ids, near, 4)

    table = spark.createDataFrame(rows, "id long, set binary").coalesce(1)
    roots = linked(table.mapInArrow(keys, PACKED_SCHEMA), lambda ids: table.join(ids, "id"), 80, Seen(spark, "families"), 4, hashed_sets, 8, cell)
    assert {r.id: r.root for r in roots.collect()} == {31: 31, 32: 31}
    assert sizes and max(sizes) <= 4


def test_shingles_of_lines_together():
    """One hash for each shingle, whatever lines stand beside it and however short they are."""
    rng = random.Random(3)
    lines = ["".join(rng.choice("abé中😀\ud800 ") for _ in range(rng.randint(1, 12))) for _ in range(300)] + ["abcdefgh"] * 2
    names: dict[str, int] = {}
    for some in (lines, lines[::-1], lines[-2:], lines[:1]):
        element, n = shingles([x.encode("utf-8", "surrogatepass") for x in some])
        cuts = np.r_[0, np.cumsum(n)]
        assert len(element) == cuts[-1]
        for k, x in enumerate(some):
            filled = x.ljust(5, "\n")
            got = element[cuts[k] : cuts[k + 1]].tolist()
            assert len(got) == len(filled) - 4
            for i, h in enumerate(got):
                assert names.setdefault(filled[i : i + 5], h) == h
    assert len(set(names.values())) == len(names)


def test_lines_are_normalised_alike():
    rng = random.Random(6)
    for _ in range(3000):
        line = "".join(rng.choice("aB é\t\r\x0b\x1c\x85\xa0 　​İ") for _ in range(rng.randint(0, 6)))
        assert _normal(line.lower()) == normal(line)


def test_a_turn_writes_what_it_found_once(spark, monkeypatch):
    """Of what is known by key: the members at first, and a table of similarities for each of three turns; near and far members are read from these."""
    made = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: made.append(tuple(df.columns)) or keep(self, df))
    texts = [f"the line number {k % 7} of the page {k % 3} ends here" for k in range(60)] + [f"{k} something else {k * k}" for k in range(20)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert dedup_lines(docs).count() == len(texts)
    assert sum(set(c) <= {"turn", "key", "id", "ratio"} and "key" in c for c in made) == 1 + 3


def test_pairs_that_are_verified_together():
    """Similarities against Python's sets; the head of many pairs in a row is read once for each ``PAIRS``."""
    r = random.Random(21)
    made = [r.sample(range(60), r.randint(1, 50)) * r.randint(1, 2) for _ in range(1100)]
    packed = [mix(np.array(x, np.uint64) + np.uint64(1)).tobytes() for x in made]
    heads = [i // 700 * 700 for i in range(1100)]
    seen = []

    def elements(sets):
        seen.extend(sets)
        return minhash.hashed_sets(sets)

    for n in (1100, 512, 2, 1, 0):
        good, ratio = minhash.similar(packed[:n], [packed[k] for k in heads[:n]], 80, elements)
        want = [len({*made[i]} & {*made[heads[i]]}) / len({*made[i]} | {*made[heads[i]]}) for i in range(n)]
        assert ratio.tolist() == want and good.tolist() == [x >= 0.8 for x in want]
        if n == 1100:
            assert len(seen) <= n + 2 * -(-n // minhash.PAIRS)


@pytest.mark.parametrize("percent", [50, 80])
def test_few_sets_are_compared_by_one_product(percent, monkeypatch):
    """All pairs of different components, and across blocks only; elements repeat; products of one and of several parts."""
    r = np.random.default_rng(percent)
    for part in (1 << 13, 7):
        monkeypatch.setattr(minhash, "MULTIPLIED", part)
        for m in (0, 1, 2, 9, minhash.FEW):
            sets = [mix(r.integers(0, 12, r.integers(1, 25)).astype(np.uint64) + np.uint64(1 + 6 * r.integers(0, 3))) for _ in range(m)]
            root = r.integers(0, max(1, m), m)
            for side in (np.zeros(m, np.int64), r.integers(0, 2, m)):
                want = {
                    (int(root[i]), int(root[j]))
                    for i in range(m)
                    for j in range(i + 1, m)
                    if root[i] != root[j] and (not side.any() or side[i] != side[j]) and 100 * len({*sets[i]} & {*sets[j]}) >= percent * len({*sets[i]} | {*sets[j]})
                }
                n = np.array([len(x) for x in sets], np.int64)
                element = np.concatenate([np.empty(0, np.uint64), *sets])
                assert minhash.few_united(root, n, element, side, percent) == sorted(want)


def test_pairs_by_chance_stay_few():
    """Lines of one vocabulary, none alike: hardly a pair meets in a bucket. Such pairs grow with the square of the lines; 40 bands of six values had 21 here."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(400)]
    lines = [" ".join(r.choice(words) for _ in range(100)).encode() for _ in range(3000)]
    element, n = shingles(lines)
    keys = minhash.wide_band_keys(element, np.cumsum(n) - n, BANDS, ROWS)
    order = np.sort(keys.T, axis=1)
    assert (order[:, 1:] == order[:, :-1]).sum() <= 8


def test_buckets_of_two_are_told_by_their_pair(spark, monkeypatch):
    """What is known by key are buckets of more than two and those met in a task; the rest is one row a bucket."""
    seen = {}
    keep = Scratch.keep

    def kept(self, df):
        out = keep(self, df)
        if "key" in df.columns:
            seen.setdefault(tuple(df.columns), out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    ids = [(1, 11, 5), (2, 12, 5), (3, 21, 6), (4, 22, 6), (5, 23, 6)]
    sets = {row: mix(np.arange(row * 100, row * 100 + 20, dtype=np.uint64)).tobytes() for _, _, row in ids}

    def keys(batches):
        for batch in batches:
            for i, g in zip(batch.column("id").to_pylist(), batch.column("g").to_pylist()):
                yield from packed_keys(np.array([i]), mix(np.array([[g << 1, g << 1 | 1]], np.uint64)), 2)

    table = spark.createDataFrame([(i, g, bytearray(sets[g])) for _, i, g in ids], "id long, g long, set binary").repartition(3)
    roots = linked(table.mapInArrow(keys, PACKED_SCHEMA), lambda x: table.select("id", "set").join(x, "id"), 80, Scratch(spark, "two"), 2, hashed_sets, 8)
    assert {r.id: r.root for r in roots.collect()} == {11: 11, 12: 11, 21: 21, 22: 21, 23: 21}
    assert seen[("key", "id", "other")] == 2 * 1 + 2 * 3 and seen[("key", "id")] == 2 * 3
