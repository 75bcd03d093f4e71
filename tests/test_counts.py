"""Pairs told by counts, against all pairs."""

import random
from itertools import permutations

import numpy as np
import pytest

import brute
from latticework import queries
from latticework.functions.masks import bits
from latticework.functions.predicates import Predicate
from latticework.operators.dc import dc_violations, evidence_sets, space_of
from latticework.operators.fd import discover_fds
from latticework.operators.ucc import discover_uccs
from latticework.plans import counts, kernels, pairs
from latticework.plans.kernels import Counter, agree_sets, evidence
from latticework.plans.sharded import refined


def rows_of(seed, n, rows, values):
    r = random.Random(seed)
    return [tuple(r.choice([None, *range(-1, values)]) for _ in range(n)) for _ in range(rows)]


def frame(spark, rows, n):
    return spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(n)))


def sign(x, y):
    x, y = ((v is not None, v if v is not None else 0) for v in (x, y))
    return (x > y) - (x < y)


def all_outcomes(rows, n, ordered):
    out = {}
    for a, b in permutations(rows, 2):
        key = tuple(sign(a[i], b[i]) if i in ordered else int(a[i] != b[i]) for i in range(n))
        out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("plan", ("counts", "nested", "triangle", "sharing"))
@pytest.mark.parametrize("seed", range(2))
def test_agree_sets_of_every_plan(spark, plan, seed):
    rows = [(*r, i) for i, r in enumerate(rows_of(seed, 3, 40, 3 + 20 * seed))] * 2
    assert agree_sets(frame(spark, rows, 4), ["c0", "c1", "c2", "c3"], plan) == brute.agree(rows, 4)
    assert agree_sets(frame(spark, rows[:1], 4), ["c0", "c1", "c2", "c3"], plan) == set()
    differ = {sum(1 << i for i in range(4) if a[i] == b[i] is not None) for k, a in enumerate(rows) for b in rows[:k]}
    assert agree_sets(frame(spark, rows, 4), ["c0", "c1", "c2", "c3"], plan, null_equals_null=False) == differ


def test_copies_with_keys_of_their_own_are_one_class(spark):
    rows = [(k, k % 30 % 7, k % 30 // 4) for k in range(3_000)]
    df = frame(spark, rows, 3)
    classes = pairs.agreement_classes(df, df.columns)
    assert classes.count() == 30 and classes.filter("_0 is null and _times = 100").count() == 30


def test_pairs_that_rise_together():
    r = np.random.default_rng(0)
    for size in (0, 1, 2, 30, 200):
        g, a, b = (r.integers(0, k, size) for k in (4, 9, 12))
        want = sum(g[i] == g[j] and a[i] < a[j] and b[i] < b[j] for i in range(size) for j in range(size))
        assert counts.concordant(g, a, b) == want


@pytest.mark.parametrize("block", [250_000, 9])
@pytest.mark.parametrize("seed", range(2))
def test_outcomes_of_three_ordered_columns(spark, monkeypatch, block, seed):
    """Small blocks: pairs of one block, of one block in one column, and of cells."""
    monkeypatch.setattr(counts, "BLOCK", block)
    rows = [(*r, x[0]) for r, x in zip(rows_of(seed, 3, 60, 4 + 30 * seed), rows_of(9, 1, 60, 2))]
    df = frame(spark, rows, 4)
    assert counts.outcomes(df, df.columns, {0, 1, 2}) == all_outcomes(rows, 4, {0, 1, 2})
    assert counts.outcomes(df, df.columns, {1, 3}) == all_outcomes(rows, 4, {1, 3})
    space = space_of(df, ["c0", "c1", "c2"])
    got, want = ({tuple(x) for x in evidence(df, ["c0", "c1", "c2"], space, plan).collect()} for plan in ("counts", "triangle"))
    assert got == want
    two = [Predicate("c0", "<", "c0"), Predicate("c1", ">=", "c1")]
    assert dc_violations(df, two).collect()[0][0] == sum(p for k, p in all_outcomes(rows, 4, {0, 1, 2}).items() if k[0] < 0 <= k[1])


def test_no_pairs_are_made_by_the_searches(spark, monkeypatch):
    """Difference sets, evidence and violations of inequalities are counted."""
    monkeypatch.setattr(pairs, "triangle_pairs", None)
    monkeypatch.setitem(pairs.PLANS, "triangle", None)
    monkeypatch.setattr("latticework.operators.dc.triangle_pairs", None)
    rows = [(k, k % 5, k * 7 % 11) for k in range(40)]
    df = frame(spark, rows, 3)
    assert {(r.lhs, r.rhs) for r in discover_fds(df, method="difference").collect()} == {(",".join(f"c{i}" for i in bits(m)), f"c{a}") for m, a in brute.fds(rows, 3)}
    assert evidence_sets(df).agg({"pairs": "sum"}).collect()[0][0] == 40 * 39
    assert dc_violations(df, [Predicate("c1", "<", "c1")]).collect()[0][0] == 40 * 32 // 2


def test_many_sets_by_shards(spark, monkeypatch):
    """Every column set of a table, in two jobs besides those of the few sets that no column deals."""
    r = random.Random(5)
    rows = [(r.choice([None, *range(40)]), r.choice([None, -0.0, 0.0, float("nan"), 1.5]), r.choice([None, "a", "b", "ü", ""]), i // 7 if i % 9 else None, r.choice([True, None])) for i in range(600)]
    df = spark.createDataFrame(rows, "a int, `b.x` double, c string, d long, e boolean")
    df = df.withColumnRenamed("b.x", "b").selectExpr("*", "cast(d % 5 as decimal(9,2)) f", "cast(c as binary) g", "timestamp_seconds(a) h")
    monkeypatch.setattr("latticework.plans.sharded.SMALL_GROUP", 1)  # nulls and frequent values deal nothing out
    count = Counter(df, df.columns)
    masks = list(range(1, 1 << 8))
    plain = lambda v: "nan" if v != v else 0.0 if v == 0 else v
    every = [tuple(bytes(v) if isinstance(v, bytearray) else plain(v) if isinstance(v, float) else v for v in row) for row in df.collect()]
    want = {m: len({tuple(row[i] for i in bits(m)) for row in every}) for m in masks}
    assert count(masks) == want
    assert count.jobs <= 3


def test_refined_classes():
    r = random.Random(8)
    columns = [np.array([r.randrange(k) for _ in range(200)]) for k in (2, 9, 40, 3)]
    sets = [s for n in range(1, 5) for s in permutations(range(4), n)]
    assert refined(columns, sets) == {s: len(set(zip(*(columns[i].tolist() for i in s)))) for s in sets}


def test_hybrid_searches_by_shards(spark, monkeypatch):
    """Every count by shards, and every count by groups."""
    r = random.Random(11)
    rows = [(i // 3, i % 3, *(r.choice([None, *range(k)]) for k in (30, 9, 2))) for i in range(150)]
    df = spark.createDataFrame([(*x, x[0] % 7) for x in rows], ", ".join(f"c{i} int" for i in range(6)))
    found = []
    for many in (0, 1 << 60):
        monkeypatch.setattr(kernels, "MANY_SETS", many)
        monkeypatch.setattr(kernels, "MANY_ROWS", many)
        found.append([{tuple(x) for x in f(df, method="hybrid").collect()} for f in (discover_fds, discover_uccs)])
    assert found[0] == found[1] and all(found[0])


@pytest.mark.parametrize("small", [1 << 12, 8, 1])
def test_keys_by_shards_need_one_search(spark, monkeypatch, small):
    """All sets with a column that deals rows out are told by one job, however many levels the search has."""
    made = []

    class Kept(Counter):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr("latticework.operators.ucc.Counter", Kept)
    monkeypatch.setattr(kernels, "MANY_ROWS", 0)
    monkeypatch.setattr("latticework.plans.sharded.SMALL_GROUP", small)
    for seed, values in ((1, 4), (2, 20), (3, 3)):
        r = random.Random(seed)
        rows = [(*x, r.randrange(9), i if seed == 2 else i // 6) for i, x in enumerate(rows_of(seed, 4, 70, values))] + [(None,) * 6]
        rows += rows[5:6] if seed == 3 else []
        got = {r.columns for r in discover_uccs(frame(spark, rows, 6), method="hybrid").collect()}
        want = brute.uccs(rows, 6)
        assert got == {",".join(f"c{i}" for i in bits(x)) for x in want}
        assert bool(want) == (seed != 3) and (seed != 1 or max(map(int.bit_count, want)) > 3)
        assert small < 1 << 12 or made[-1].jobs <= 2


@pytest.mark.parametrize("query", ["agree_sets_part_nested", "agree_sets_part_triangle", "difference_sets_part", "agree_sets_customer_nested", "agree_sets_customer_triangle", "agree_sets_part_sharing", "agree_sets_customer_sharing", "difference_sets_customer"])
def test_many_classes_are_counted(spark, monkeypatch, query):
    """A named plan meets no pairs of more classes than it may, and finds the same sets."""
    name = query.split("_")[2]
    columns = queries.COLUMNS[name]
    values = rows_of(3, len(columns) - 1, 60, 3)
    rows = [(i, *(v and v % (2 + k) for k, v in enumerate(r))) for i, r in enumerate(values)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in columns))
    monkeypatch.setattr(queries, "table", lambda *_: df)
    for plan in kernels.MEET_CLASSES:
        monkeypatch.setitem(kernels.MEET_CLASSES, plan, 10)
    for plan in pairs.PLANS:
        monkeypatch.setitem(pairs.PLANS, plan, None)
    full = (1 << len(columns)) - 1
    want = brute.agree(rows, len(columns))
    assert {r.mask for r in queries.QUERIES[query](spark, "").collect()} == ({full - m for m in want} if query.startswith("difference") else want)


@pytest.mark.parametrize("equal", [True, False])
def test_pairs_of_classes(spark, equal):
    """Copies of rows that hold nulls agree on these, or do not."""
    rows = [(*r, i // 2, i) for i, r in enumerate(rows_of(4, 3, 30, 2))] * 2 + [(None,) * 5] * 2
    df = frame(spark, rows, 5)
    classes = pairs.agreement_classes(df, df.columns, equal)
    assert counts.pairs_of_classes(classes, 5) == counts.pairs_agreeing(df, df.columns, equal)
