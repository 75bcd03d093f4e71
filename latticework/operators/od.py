"""Order dependencies in set-based canonical form: minimal order-compatible pairs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions.masks import bits
from ..plans.kernels import Counter, swaps
from ..sources.tables import attributes
from .fd import names
from .stats import interestingness

SCHEMA = "context string, a string, b string, direction string"


def check_ocds(df: DataFrame, candidates: list[tuple[list[str], str, str, str]]) -> DataFrame:
    """context, a, b, direction, holds: whether, among rows of one context value,
    order by a is order by b (asc) or its reverse (desc). Nulls come first."""
    found = swaps(df, [(x, a, b, d == "desc") for x, a, b, d in candidates])
    rows = [(",".join(x), a, b, d, not s) for (x, a, b, d), s in zip(candidates, found)]
    return df.sparkSession.createDataFrame(rows, SCHEMA + ", holds boolean")


def discover_ods(
    df: DataFrame, columns: list[str] | None = None, id_col: str | None = None, directions: tuple[str, ...] = ("asc",),
    most: int | None = None, with_scores: bool = False, least_score: int | None = None, top: int | None = None, either: bool = False,
) -> DataFrame:
    """Minimal statements context: a ~ b, with at most ``most`` context columns.

    A pair is looked at in a context only if it holds in no part of it and the
    context determines neither a nor b (then it would hold for that reason
    alone). Level by level, one job of counts and one of swap checks for a batch.
    Directions are searched apart; ``either`` stops at the smallest context where
    one of them holds. Scores (sum of squared group sizes of the context) can be
    added, bounded from below, and cut to the ``top`` highest.
    """
    columns = attributes(df, columns, id_col)
    n = len(columns)
    df = df.select(*columns).persist()
    try:
        count = Counter(df, columns)
        found: list[tuple[int, int, int, str]] = []

        def settled(x: int, a: int, b: int, d: str) -> bool:
            return any(y & x == y and (p, q) == (a, b) and (either or e == d) for y, p, q, e in found)

        for size in range(n - 1 if most is None else min(n - 1, most + 1)):
            todo = []
            for picked in combinations(range(n), size):
                x = sum(1 << i for i in picked)
                rest = [i for i in range(n) if not x >> i & 1]
                todo += [(x, a, b, d) for a, b in combinations(rest, 2) for d in directions if not settled(x, a, b, d)]
            counts = count([m for x, a, b, _ in todo for m in (x, x | 1 << a, x | 1 << b)])
            todo = [(x, a, b, d) for x, a, b, d in todo if counts[x] != counts[x | 1 << a] and counts[x] != counts[x | 1 << b]]
            if not todo:
                continue
            bad = swaps(df, [([columns[i] for i in bits(x)], columns[a], columns[b], d == "desc") for x, a, b, d in todo])
            found += [c for c, s in zip(todo, bad) if not s]
        rows = sorted((names(x, columns), columns[a], columns[b], d) for x, a, b, d in found)
        out = df.sparkSession.createDataFrame(rows, SCHEMA)
        if not (with_scores or least_score is not None or top is not None):
            return out
        contexts = sorted({x for x, *_ in found})
        scores = interestingness(df, [[columns[i] for i in bits(x)] for x in contexts])
        out = out.join(F.broadcast(scores.withColumnRenamed("column_set", "context")), "context")
        if least_score is not None:
            out = out.filter(F.col("score") > least_score)
        if top is not None:
            out = out.orderBy(F.col("score").desc(), "context", "a", "b", "direction").limit(top)
        # what was found is small, and the cached table goes away
        kept = out.select("context", "a", "b", "direction", "score").collect()
        return df.sparkSession.createDataFrame([tuple(r) for r in kept], SCHEMA + ", score bigint")
    finally:
        df.unpersist()
