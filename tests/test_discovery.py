import datetime
import random

import pytest

import brute
from latticework.functions.masks import bits
from latticework.functions.predicates import Predicate
from latticework.operators.dc import dc_violations, discover_dcs, evidence_sets, space_of
from latticework.operators.fd import discover_fds, fd_violations
from latticework.operators.od import check_ocds, discover_ods
from latticework.operators.stats import column_overlap, interestingness, partition_stats
from latticework.operators.ucc import discover_uccs
from latticework.plans.encode import cluster_encoded, rank_encoded
from latticework.plans.kernels import agree_sets, distinct_counts, evidence
from latticework.queries import QUERIES
from latticework.sources.sinks import union_of_results, write_result
from latticework.sources.tables import attributes, part_of, read_table, sniff_types, typed_header

SAMPLE = "32132 41343 24123 41313 13342 32442 32324 13233 32334 41411 41141 13231 13341 24121 13244 41343 41344 24441 41123 24431"
METHODS = ("levels", "difference", "hybrid")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([(*map(int, r), i) for i, r in enumerate(SAMPLE.split())], "C0 long, C1 long, C2 long, C3 long, C4 long, index long")


def found(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("method", METHODS)
def test_sample_fds_and_keys(sample, method):
    fds = {(r[0], r[1]) for r in discover_fds(sample, id_col="index", method=method).collect()}
    assert fds == {("C0", "C1"), ("C1", "C0"), ("C0,C3,C4", "C2"), ("C1,C3,C4", "C2")}
    assert discover_uccs(sample, id_col="index", method=method).count() == 0


def test_sample_agree_sets_orders_and_evidence(sample):
    cols = attributes(sample, id_col="index")
    for plan in ("nested", "triangle", "sharing"):
        assert len(agree_sets(sample, cols, plan)) == 15
    assert found(discover_ods(sample, cols)) == {("C2,C3", "C0", "C4", "asc")}
    assert found(discover_ods(sample, cols, directions=("desc",))) == {("C2", "C0", "C1", "desc"), ("C2,C3", "C1", "C4", "desc")}
    assert evidence(sample, cols, space_of(sample, cols)).count() == 95
    assert evidence_sets(sample, cols).agg({"pairs": "sum"}).collect()[0][0] == 20 * 19


def test_lineitem_is_searched_whole(spark):
    """The counts of FIXTURES.md, F3."""
    for kind, n in (("fd", 429), ("ucc", 62)):
        got = QUERIES[f"{kind}_minimal_lineitem_hybrid"](spark, "/root/testdata/sf0.001").collect()
        assert (len(got), max(r[-1] for r in got)) == (n, 6)


def test_constraints_of_repeated_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (None, 3), (2, None), (2, 1)], "a long, b long")
    assert found(discover_dcs(df, method="hybrid")) == found(discover_dcs(df, method="evidence"))


@pytest.mark.parametrize("method", ("evidence", "hybrid"))
def test_sample_constraints(sample, method):
    assert discover_dcs(sample, id_col="index", method=method).count() == 17


def named(pairs, cols):
    return {(",".join(cols[i] for i in bits(x)), cols[a]) for x, a in pairs}


@pytest.mark.parametrize("seed", range(3))
def test_methods_agree_with_brute_force(spark, seed):
    r = random.Random(seed)
    n, rows = r.randint(2, 4), []
    for _ in range(r.choice([2, 6, 12])):
        rows.append(tuple(r.choice([None, -1, 0, 1, 2]) for _ in range(n)))
    cols = [f"c{i}" for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols)).coalesce(1)
    want = named(brute.fds(rows, n), cols)
    keys = {",".join(cols[i] for i in bits(x)) for x in brute.uccs(rows, n)}
    for method in METHODS:
        assert {(x[0], x[1]) for x in discover_fds(df, method=method).collect()} == want
        assert {x[0] for x in discover_uccs(df, method=method).collect()} == keys
    assert agree_sets(df, cols, "sharing") == brute.agree(rows, n)
    for down in (False, True):
        got = {(x.context, x.a, x.b) for x in discover_ods(df, directions=("desc" if down else "asc",)).collect()}
        assert got == {(",".join(cols[i] for i in bits(m)), cols[a], cols[b]) for m, a, b in brute.ods(rows, n, down)}


@pytest.mark.parametrize(
    "rows, fds, uccs",
    [
        ([], {("", "a"), ("", "b")}, {""}),
        ([(1, 2)], {("", "a"), ("", "b")}, {""}),
        ([(1, 7), (2, 7), (3, 7)], {("", "b")}, {"a"}),
        ([(1, 1), (2, 2)], {("a", "b"), ("b", "a")}, {"a", "b"}),
        ([(-1, -5), (-1, -5), (2, 3)], {("a", "b"), ("b", "a")}, set()),
        ([(1, None), (1, None), (2, 3)], {("a", "b"), ("b", "a")}, set()),
    ],
)
def test_edges(spark, rows, fds, uccs):
    df = spark.createDataFrame(rows, "a int, b int").coalesce(1)
    for method in METHODS:
        assert {(x[0], x[1]) for x in discover_fds(df, method=method).collect()} == fds
        assert {x[0] for x in discover_uccs(df, method=method).collect()} == uccs


def test_nulls_that_differ(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3)], "a int, b int").coalesce(1)
    assert {x[0] for x in discover_uccs(df, null_equals_null=False).collect()} == {"b"}
    assert agree_sets(df, ["a", "b"], null_equals_null=False) == {0b01, 0}


def test_dates_in_constraints_and_violations(spark):
    day = datetime.date
    df = spark.createDataFrame([(day(2020, 1, 1), 1), (day(2020, 1, 2), 2), (day(2020, 1, 2), 2)], "d date, v int")
    down = [Predicate("d", "<", "d"), Predicate("v", ">", "v")]
    assert dc_violations(df, down).collect()[0][0] == 0
    assert dc_violations(df, [Predicate("d", "=", "d")]).collect()[0][0] == 2
    assert dc_violations(df, [Predicate("v", "<", "v")]).collect()[0][0] == 2


def test_cross_column_space(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 4)], "a int, b int")
    assert len(space_of(df, ["a", "b"])) == 12
    assert any(p.left != p.right for p in space_of(df, ["a", "b"], cross_column=True))


def test_counts_of_wide_tables(spark):
    cols = [f"c{i}" for i in range(70)]
    df = spark.createDataFrame([tuple(range(70)), tuple(range(1, 71))], ", ".join(f"{c} int" for c in cols))
    masks = [1 << i for i in range(70)]
    assert distinct_counts(df, masks, 2, at_once=80) == dict.fromkeys(masks, 2)


def test_statistics_and_encodings(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, None)], "a int, b string")
    row = partition_stats(df, [["a"]]).collect()[0]
    assert (row.n_rows, row.n_classes, row.n_stripped_rows, row.n_stripped_classes, row.error, row.score) == (4, 3, 2, 1, 1, 6)
    assert {tuple(r) for r in interestingness(df, [[], ["b"]]).collect()} == {("", 16), ("b", 6)}
    assert column_overlap(df, "a", "a").collect()[0].overlap == 1.0
    assert sorted(r.b_rank for r in rank_encoded(df, ["b"]).collect()) == [1, 2, 3, 3]
    assert sorted(r.a_cluster for r in cluster_encoded(df, ["a"]).collect()) == [-1, -1, 1, 1]
    assert {r.swap for r in check_ocds(df, [([], "a", "b", "asc")]).withColumnRenamed("holds", "swap").collect()} == {False}
    assert fd_violations(df, ["a"], "b").collect()[0].asDict() == {"a": 1, "low": "x", "high": "y", "rows": 2}
    write_result(df, f"{tmp_path}/t.csv", "csv")
    back = read_table(spark, f"{tmp_path}/t.csv", header=True)
    assert union_of_results([df, back]).count() == 4 and part_of(back, 2, 1).columns == ["a"]
    texts = spark.createDataFrame([("1", "2.5", "x"), ("2", None, "3")], "a string, b string, c string")
    assert [t for _, t in sniff_types(texts).dtypes] == ["bigint", "double", "string"]
    assert typed_header(texts.toDF("a(long)", "b(double)", "c")).dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    with pytest.raises(ValueError):
        attributes(spark.sql("SELECT map(1, 2) AS m"))
