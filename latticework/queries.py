"""The registered queries over the operators, and their SQL.

Discovery runs search whole tables; SQL oracles enumerate all candidates over
the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.predicates import Predicate
from .operators import dc, fd, od, stats, ucc
from .plans.encode import cluster_encoded, rank_encoded, shared_dictionary
from .plans.kernels import agree_masks

COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "labels": ["doc_id", "quality", "toxic"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*COLUMNS.get(name, df.columns))


def register(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def subsets(items, least=0, most=None):
    most = len(items) if most is None else most
    return [list(s) for k in range(least, most + 1) for s in combinations(items, k)]


# K1 and what follows from it


def sql_counts(name: str, sets: list[list[str]]) -> str:
    parts = [f"SELECT '{','.join(s)}' AS column_set, count(*) AS n_distinct FROM (SELECT DISTINCT {', '.join(s)} FROM {name})" for s in sets]
    return " UNION ALL ".join(parts)


def sql_masks(name: str, most: int | None = None) -> str:
    """mask, names, n for every column set of a table."""
    cols = COLUMNS[name]
    parts = [f"SELECT 0 AS mask, '' AS names, least(1, count(*)) AS n FROM {name}"]
    for s in subsets(cols, 1, most):
        mask = sum(1 << cols.index(c) for c in s)
        parts.append(f"SELECT {mask}, '{','.join(s)}', count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM {name})")
    return " UNION ALL ".join(parts)


def sql_fds(name: str) -> str:
    rhs = ", ".join(f"({1 << i}, '{c}')" for i, c in enumerate(COLUMNS[name]))
    return f"""
WITH sets AS MATERIALIZED ({sql_masks(name)}),
rhs(bit, rhs) AS (VALUES {rhs}),
valid AS MATERIALIZED (
  SELECT l.mask, l.names AS lhs, rhs.bit, rhs.rhs FROM sets l CROSS JOIN rhs JOIN sets b ON b.mask = (l.mask | rhs.bit)
  WHERE (l.mask & rhs.bit) = 0 AND l.n = b.n)
SELECT lhs, rhs, CAST(bit_count(v.mask) AS INTEGER) AS lhs_size FROM valid v
WHERE NOT EXISTS (SELECT 1 FROM valid w WHERE w.bit = v.bit AND w.mask <> v.mask AND (w.mask & v.mask) = w.mask)"""


def sql_uccs(name: str) -> str:
    return f"""
WITH sets AS MATERIALIZED ({sql_masks(name)}),
uniq AS MATERIALIZED (SELECT mask, names FROM sets WHERE n = (SELECT count(*) FROM {name}))
SELECT names AS columns, CAST(bit_count(u.mask) AS INTEGER) AS size FROM uniq u
WHERE NOT EXISTS (SELECT 1 FROM uniq w WHERE w.mask <> u.mask AND (w.mask & u.mask) = w.mask)"""


def _counts(name: str, sets: list[list[str]]) -> None:
    register(f"column_set_counts_{name}", lambda spark, d: stats.column_set_counts(table(spark, d, name), sets), sql_counts(name, sets))


_counts("lineitem", subsets(COLUMNS["lineitem"], 1, 2))
_counts("orders", subsets(COLUMNS["orders"], 1))

for _name in ("customer", "part", "events"):
    _sets = subsets(COLUMNS[_name], 1, 2)
    register(
        f"partition_stats_{_name}",
        lambda spark, d, n=_name, s=_sets: stats.partition_stats(table(spark, d, n), s),
        " UNION ALL ".join(
            f"SELECT '{','.join(s)}' AS column_set, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_classes, "
            "CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_stripped_rows, count(*) FILTER (n > 1) AS n_stripped_classes, "
            "CAST(coalesce(sum(n) FILTER (n > 1), 0) - count(*) FILTER (n > 1) AS BIGINT) AS error, CAST(sum(n * n) AS BIGINT) AS score "
            f"FROM (SELECT count(*) AS n FROM {_name} GROUP BY {', '.join(s)})"
            for s in _sets
        ),
    )

for _name in ("nation", "customer", "part", "orders"):
    _cols = COLUMNS[_name]
    _cands = [([a], b) for a in _cols for b in _cols if a != b]
    register(
        f"fd_check_{_name}",
        lambda spark, d, n=_name, c=_cands: fd.check_fds(table(spark, d, n), c),
        " UNION ALL ".join(
            f"SELECT '{x[0]}' AS lhs, '{a}' AS rhs, count(DISTINCT {x[0]}) AS lhs_count, count(DISTINCT ({x[0]}, {a})) AS both_count, "
            f"count(DISTINCT {x[0]}) = count(DISTINCT ({x[0]}, {a})) AS holds FROM {_name}"
            for x, a in _cands
        ),
    )

for _name in ("region", "nation", "supplier", "customer", "part", "orders", "labels", "events"):
    for _method in ("levels", "difference", "hybrid"):
        if _method == "difference" and _name in ("orders", "events"):
            continue  # all pairs of the larger tables: see the block plan below
        register(f"fd_minimal_{_name}_{_method}", lambda spark, d, n=_name, m=_method: fd.discover_fds(table(spark, d, n), method=m), sql_fds(_name))
        register(f"ucc_minimal_{_name}_{_method}", lambda spark, d, n=_name, m=_method: ucc.discover_uccs(table(spark, d, n), method=m), sql_uccs(_name))

register(
    "ucc_check_lineitem",
    lambda spark, d: ucc.check_uccs(table(spark, d, "lineitem"), [["l_orderkey", "l_linenumber"], ["l_orderkey", "l_partkey"], ["l_orderkey"], ["l_partkey", "l_suppkey", "l_shipdate"]]),
    " UNION ALL ".join(
        f"SELECT '{','.join(s)}' AS columns, count(*) AS n_distinct, count(*) = (SELECT count(*) FROM lineitem) AS is_unique FROM (SELECT DISTINCT {', '.join(s)} FROM lineitem)"
        for s in (["l_orderkey", "l_linenumber"], ["l_orderkey", "l_partkey"], ["l_orderkey"], ["l_partkey", "l_suppkey", "l_shipdate"])
    ),
)
register("fd_minimal_lineitem_hybrid", lambda spark, d: fd.discover_fds(table(spark, d, "lineitem"), method="hybrid"))
register("ucc_minimal_lineitem_hybrid", lambda spark, d: ucc.discover_uccs(table(spark, d, "lineitem"), method="hybrid"))

for _lhs, _rhs in ((["o_custkey"], "o_orderpriority"), (["o_orderdate"], "o_orderstatus"), (["o_custkey", "o_orderstatus"], "o_totalprice")):
    register(
        f"fd_violations_{'_'.join(_lhs)}_{_rhs}",
        lambda spark, d, x=_lhs, a=_rhs: fd.fd_violations(table(spark, d, "orders"), x, a),
        f"SELECT {', '.join(_lhs)}, min({_rhs}) AS low, max({_rhs}) AS high, count(*) AS rows FROM orders GROUP BY {', '.join(_lhs)} HAVING count(DISTINCT {_rhs}) > 1",
    )

# K2


def sql_agree(name: str, complement: bool = False) -> str:
    cols = COLUMNS[name]
    mask = " + ".join(f"CASE WHEN a.{c} IS NOT DISTINCT FROM b.{c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(cols))
    value = f"({(1 << len(cols)) - 1} - ({mask}))" if complement else f"({mask})"
    return f"WITH t AS (SELECT *, row_number() OVER () AS id FROM {name}) SELECT DISTINCT CAST({value} AS BIGINT) AS mask FROM t a JOIN t b ON a.id < b.id"


def _agree(name: str, plan: str, complement: bool = False) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = agree_masks(table(spark, d, name), COLUMNS[name], plan)
        value = F.lit((1 << len(COLUMNS[name])) - 1) - F.col("m0") if complement else F.col("m0")
        return found.select(value.cast("bigint").alias("mask"))

    return run


for _name in ("nation", "supplier", "customer", "part"):
    for _plan in ("nested", "triangle", "sharing"):
        register(f"agree_sets_{_name}_{_plan}", _agree(_name, _plan), sql_agree(_name))
    register(f"difference_sets_{_name}", _agree(_name, "triangle", True), sql_agree(_name, True))

# K3


def sql_ocd(name: str, candidates: list[tuple[list[str], str, str, str]]) -> str:
    parts = []
    for x, a, b, direction in candidates:
        keys = "".join(f"{c}, " for c in x)
        over = f"OVER ({f'PARTITION BY {", ".join(x)} ' if x else ''}ORDER BY {a})"
        test = f"lag(hi) {over} > lo" if direction == "asc" else f"lag(lo) {over} < hi"
        parts.append(
            f"SELECT '{','.join(x)}' AS context, '{a}' AS a, '{b}' AS b, '{direction}' AS direction, NOT coalesce(bool_or(s), false) AS holds FROM "
            f"(SELECT {test} AS s FROM (SELECT {keys}{a}, min({b}) AS lo, max({b}) AS hi FROM {name} GROUP BY {keys}{a}))"
        )
    return " UNION ALL ".join(parts)


def sql_ods(name: str, direction: str) -> str:
    """Minimal order-compatible pairs, over every context."""
    cols = COLUMNS[name]
    n = len(cols)
    checks = []
    for k in range(n - 1):
        for x in combinations(range(n), k):
            for a, b in combinations([i for i in range(n) if i not in x], 2):
                keys = "".join(f"{cols[i]}, " for i in x)
                over = f"OVER ({f'PARTITION BY {", ".join(cols[i] for i in x)} ' if x else ''}ORDER BY {cols[a]})"
                test = f"lag(hi) {over} > lo" if direction == "asc" else f"lag(lo) {over} < hi"
                checks.append(
                    f"SELECT {sum(1 << i for i in x)} AS mask, '{','.join(cols[i] for i in x)}' AS context, {1 << a} AS abit, {1 << b} AS bbit, '{cols[a]}' AS a, '{cols[b]}' AS b, "
                    f"NOT coalesce(bool_or(s), false) AS holds FROM (SELECT {test} AS s FROM (SELECT {keys}{cols[a]}, min({cols[b]}) AS lo, max({cols[b]}) AS hi FROM {name} GROUP BY {keys}{cols[a]}))"
                )
    return f"""
WITH sets AS MATERIALIZED ({sql_masks(name)}),
checks AS MATERIALIZED ({' UNION ALL '.join(checks)}),
valid AS MATERIALIZED (
  SELECT c.* FROM checks c JOIN sets x ON x.mask = c.mask JOIN sets xa ON xa.mask = (c.mask | c.abit) JOIN sets xb ON xb.mask = (c.mask | c.bbit)
  WHERE c.holds AND x.n <> xa.n AND x.n <> xb.n)
SELECT context, a, b, '{direction}' AS direction FROM valid v
WHERE NOT EXISTS (SELECT 1 FROM valid w WHERE w.a = v.a AND w.b = v.b AND w.mask <> v.mask AND (w.mask & v.mask) = w.mask)"""


OCDS = {
    "customer": [([], "c_custkey", "c_name"), (["c_nationkey"], "c_custkey", "c_acctbal"), (["c_mktsegment"], "c_custkey", "c_name")],
    "orders": [([], "o_orderkey", "o_orderdate"), ([], "o_orderdate", "o_totalprice"), (["o_custkey"], "o_orderkey", "o_totalprice"), (["o_custkey", "o_orderstatus"], "o_orderkey", "o_totalprice")],
}
for _name, _list in OCDS.items():
    for _key, _direction in (("ocd_check", "asc"), ("bod_check", "desc")):
        _cands4 = [(x, a, b, _direction) for x, a, b in _list]
        register(f"{_key}_{_name}", lambda spark, d, n=_name, c=_cands4: od.check_ocds(table(spark, d, n), c), sql_ocd(_name, _cands4))
for _name in ("region", "nation", "supplier", "customer", "part"):
    register(f"od_minimal_{_name}", lambda spark, d, n=_name: od.discover_ods(table(spark, d, n)), sql_ods(_name, "asc"))
    register(f"od_minimal_desc_{_name}", lambda spark, d, n=_name: od.discover_ods(table(spark, d, n), directions=("desc",)), sql_ods(_name, "desc"))
register("topk_dependencies_part", lambda spark, d: od.discover_ods(table(spark, d, "part"), directions=("asc", "desc"), top=3))

# K4 and constraints


def _space(columns: list[str], ordered: set[str]) -> list[Predicate]:
    return [Predicate(c, op, c) for c in columns for op in (("=", "<>", "<", "<=", ">", ">=") if c in ordered else ("=", "<>"))]


def sql_evidence(name: str, ordered: set[str]) -> str:
    words = []
    for p in _space(COLUMNS[name], ordered):
        test = f"a.{p.left} IS NOT DISTINCT FROM b.{p.right}" if p.op == "=" else f"a.{p.left} IS DISTINCT FROM b.{p.right}" if p.op == "<>" else f"a.{p.left} {p.op} b.{p.right}"
        words.append(f"CASE WHEN {test} THEN '{p}' END")
    return f"""WITH t AS (SELECT *, row_number() OVER () AS id FROM {name})
SELECT concat_ws(' AND ', {', '.join(words)}) AS predicates, count(*) AS pairs FROM t a JOIN t b ON a.id <> b.id GROUP BY 1"""


for _name, _ordered in (("nation", {"n_nationkey", "n_regionkey"}), ("supplier", {"s_suppkey", "s_nationkey", "s_acctbal"}), ("customer", {"c_custkey", "c_nationkey", "c_acctbal"})):
    register(f"evidence_counts_{_name}", lambda spark, d, n=_name: dc.evidence_sets(table(spark, d, n)), sql_evidence(_name, _ordered))
for _name in ("region", "nation", "supplier"):
    for _method in ("evidence", "hybrid"):
        register(f"dc_minimal_{_name}_{_method}", lambda spark, d, n=_name, m=_method: dc.discover_dcs(table(spark, d, n), method=m))

DCS = {
    "customer_equality": ("customer", [("c_nationkey", "="), ("c_custkey", "<"), ("c_acctbal", ">")]),
    "customer_two_inequalities": ("customer", [("c_custkey", "<"), ("c_acctbal", ">")]),
    "supplier_one_inequality": ("supplier", [("s_acctbal", "<")]),
    "orders_equality": ("orders", [("o_custkey", "="), ("o_orderdate", "<"), ("o_totalprice", ">")]),
    "lineitem_equality": ("lineitem", [("l_orderkey", "="), ("l_linenumber", "<"), ("l_extendedprice", ">=")]),
    "lineitem_antijoin": ("lineitem", [("l_orderkey", "="), ("l_linenumber", "="), ("l_partkey", "<>")]),
}
for _key, (_name, _preds) in DCS.items():
    _dc = [Predicate(c, op, c) for c, op in _preds]
    _cols = ", ".join(dict.fromkeys(c for c, _ in _preds))
    register(
        f"dc_violations_{_key}",
        lambda spark, d, n=_name, p=_dc: dc.dc_violations(table(spark, d, n), p),
        f"WITH t AS (SELECT {_cols}, row_number() OVER () AS id FROM {_name}) SELECT count(*) AS violations FROM t a JOIN t b ON a.id <> b.id AND "
        + " AND ".join(f"a.{c} {op} b.{c}" for c, op in _preds),
    )

# Encoding and statistics

register(
    "rank_encode_part",
    lambda spark, d: rank_encoded(table(spark, d, "part"), ["p_brand", "p_size", "p_retailprice"]).select("p_partkey", "p_brand_rank", "p_size_rank", "p_retailprice_rank"),
    "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) AS p_brand_rank, dense_rank() OVER (ORDER BY p_size) AS p_size_rank, dense_rank() OVER (ORDER BY p_retailprice) AS p_retailprice_rank FROM part",
)
register(
    "rank_encode_reversed_supplier",
    lambda spark, d: rank_encoded(table(spark, d, "supplier"), ["s_acctbal"], reverse=True).select("s_suppkey", "s_acctbal_rank"),
    "SELECT s_suppkey, dense_rank() OVER (ORDER BY s_acctbal DESC) AS s_acctbal_rank FROM supplier",
)
register(
    "cluster_encode_customer",
    lambda spark, d: cluster_encoded(table(spark, d, "customer"), ["c_nationkey", "c_acctbal"]).select("c_custkey", "c_nationkey_cluster", "c_acctbal_cluster"),
    "SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) = 1 THEN -1 ELSE dense_rank() OVER (ORDER BY c_nationkey) END AS c_nationkey_cluster, "
    "CASE WHEN count(*) OVER (PARTITION BY c_acctbal) = 1 THEN -1 ELSE dense_rank() OVER (ORDER BY c_acctbal) END AS c_acctbal_cluster FROM customer",
)
register(
    "shared_dictionary_lineitem",
    lambda spark, d: shared_dictionary(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey_code", "l_suppkey_code"),
    "WITH v AS (SELECT value, dense_rank() OVER (ORDER BY value) AS code FROM (SELECT l_partkey AS value FROM lineitem UNION SELECT l_suppkey FROM lineitem)) "
    "SELECT l_orderkey, l_linenumber, p.code AS l_partkey_code, s.code AS l_suppkey_code FROM lineitem JOIN v p ON p.value = l_partkey JOIN v s ON s.value = l_suppkey",
)
register(
    "column_overlap_nationkeys",
    lambda spark, d: stats.column_overlap(table(spark, d, "customer"), "c_nationkey", "s_nationkey", table(spark, d, "supplier")).withColumn("overlap", F.round("overlap", 9)),
    "WITH c AS (SELECT c_nationkey AS v, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS v, count(*) AS n FROM supplier GROUP BY 1) "
    "SELECT 'c_nationkey' AS column_a, 's_nationkey' AS column_b, round(sum(least(coalesce(c.n, 0), coalesce(s.n, 0))) / sum(greatest(coalesce(c.n, 0), coalesce(s.n, 0))), 9) AS overlap FROM c FULL JOIN s ON c.v = s.v",
)
register(
    "column_partition_supplier",
    lambda spark, d: stats.column_partition(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", stripped=True).select(F.col("value").alias("s_nationkey"), F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"), "n"),
    "SELECT s_nationkey, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS ids, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1",
)
