"""Mixing documents to target weights with soft domain membership.

A classifier fitted on the labelled table gives every document a posterior over
domains. Nonnegative document rates are then fitted by accelerated projected
gradient on

    sum over domains of weight * (expected tokens / target - 1) ** 2
    + RIDGE * mean over tokens of (rate - 1) ** 2

in steps of one over the largest curvature, until the totals settle. A step needs
only the K expected domain totals, one grouped sum over a compact table. A
document's rate after t steps follows from its posterior and t vectors of slopes,
so no state is kept by document between steps.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .repeats import _texts
from .rows import packed, unpacked
from .scratch import Scratch, ship
from .symbols import word_bounds
from .textclass import Softmax, features, training_rows

DOMAINS = ("good", "poor", "toxic")
#: Wanted shares of tokens, by domain.
WEIGHTS = (0.90, 0.07, 0.03)
#: The most copies of one document.
MOST_RATE = 4.0
RIDGE = 1e-4
#: The descent ends when a step moves no domain's tokens by more than this share of all.
SETTLED = 1e-5
#: and after so many steps in any case; what is then off its target is logged.
STEPS = 200
log = logging.getLogger(__name__)


def domain_label() -> Column:
    """The class of a labelled row: toxic before poor before good."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)


def _member(model: Softmax):
    def run(batches):
        for batch in batches:
            texts = [t for (t,) in _texts(batch, "bytes")]
            p = model.predict(texts)
            tokens = [len(word_bounds(np.frombuffer(t, np.uint8))[0]) for t in texts]
            posterior = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(tokens, pa.int64()), posterior], ["row", "tokens", "posterior"])

    return run


def with_posterior(docs: DataFrame, model: Softmax, passing: list[str], text_col: str = "text") -> DataFrame:
    """row (the columns ``passing``), tokens (words at ASCII white space) and posterior."""
    ship(docs.sparkSession)
    wide = docs.select(packed(passing), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"))
    return wide.mapInArrow(_member(model), StructType([wide.schema["row"], StructField("tokens", LongType()), StructField("posterior", ArrayType(DoubleType()))]))


def rate_after(posterior: Column, moves: list[list[float]], step: float, ridge: float, most: float) -> Column:
    """A document's rate after the given steps, folded inside one expression. A
    move is the momentum and the slope of each domain."""
    if not moves:
        return F.lit(1.0)
    k = len(moves[0]) - 1
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in moves])

    def move(state, m):
        ahead = state["rate"] + m[0] * (state["rate"] - state["before"])
        slope = sum((m[i + 1] * posterior[i] for i in range(k)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), F.least(F.lit(most), ahead - F.lit(step) * (slope + F.lit(2 * ridge) * (ahead - 1))))
        return F.struct(rate.alias("rate"), state["rate"].alias("before"))

    return F.aggregate(steps, F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("before")), move)["rate"]


def fit_rates(members: DataFrame, weights=WEIGHTS, budget: float | None = None, steps: int = STEPS, ridge: float = RIDGE, most: float = MOST_RATE) -> Column:
    """The rate of a row of ``members`` (tokens, posterior) as a Column.

    ``budget``: wanted tokens in all, those of the corpus unless given. A domain
    of weight 0 is left out of the fit. No tokens: rate 1. Targets that no rates
    between 0 and ``most`` reach are met as closely as they can be, and logged.
    """
    k = len(weights)
    weights = np.array(weights, float) / sum(weights)
    tokens = F.col("tokens").cast("double")
    posterior = F.col("posterior")

    def totals(rate: Column) -> np.ndarray:
        row = members.agg(*[F.sum(tokens * rate * posterior[i]) for i in range(k)]).collect()[0]
        return np.array([x or 0.0 for x in row])

    row = members.agg(*[F.sum(tokens * posterior[i] * posterior[j]) for i in range(k) for j in range(k)]).collect()[0]
    shared = np.array([x or 0.0 for x in row]).reshape(k, k)
    now = shared.sum(axis=1)  # posteriors add up to 1
    total = now.sum()
    if not total:
        return F.lit(1.0)
    target = weights * (budget or total)
    scale = np.divide(1.0, target, out=np.zeros(k), where=target > 0)
    # per token, the slope of a rate is 2 * total * sum of weight * (totals / target - 1) / target * posterior
    curve = 2 * total * np.sqrt(weights)[:, None] * scale[:, None] * shared * scale * np.sqrt(weights)
    step = 1.0 / (float(np.linalg.eigvalsh(curve)[-1]) + 2 * ridge)
    moves: list[list[float]] = []
    before, pace = now, 1.0
    for _ in range(steps):
        momentum = (pace - 1) / (pace := (1 + np.sqrt(1 + 4 * pace * pace)) / 2)
        ahead = now + momentum * (now - before)
        moves.append([float(momentum), *(2 * total * weights * scale * (ahead * scale - (target > 0)))])
        before, now = now, totals(rate_after(posterior, moves, step, ridge, most))
        if np.abs(now - before).max() <= SETTLED * total:
            break
    off = np.abs(now - target).max() / target.sum()
    log.log(logging.WARNING if off > 0.01 else logging.INFO, "mixing: %d steps, wanted %s, expected %s tokens", len(moves), target.tolist(), now.tolist())
    return rate_after(posterior, moves, step, ridge, most)


def expected_totals(rows: DataFrame, weights=WEIGHTS) -> DataFrame:
    """domain, wanted, expected: the shares of tokens that :func:`mixed` rows were to have and have."""
    sums = [F.sum(F.col("tokens") * F.col("rate") * F.col("posterior")[i]).alias(f"s{i}") for i in range(len(weights))]
    every = sum((F.col(f"s{i}") for i in range(len(weights))), F.lit(0.0))
    parts = [F.struct(F.lit(DOMAINS[i]).alias("domain"), F.lit(w / sum(weights)).alias("wanted"), (F.col(f"s{i}") / every).alias("expected")) for i, w in enumerate(weights)]
    return rows.agg(*sums).select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def mixed(docs: DataFrame, labels: DataFrame, weights=WEIGHTS, text_col: str = "text", id_col: str = "doc_id", with_text: bool = True) -> DataFrame:
    """``docs`` with tokens, posterior (by DOMAINS), rate and copies for every row.

    copies is the rate, rounded up with the probability of its fraction by a hash
    of the id, so that expected domain totals are those fitted; 0 means that the
    mixture leaves the row out. Empty and null texts have no tokens; they take
    the rate of their posterior. Without labelled rows posteriors are even. Rows
    of one id get one draw, as do rows without an id. Columns of these four names
    in ``docs`` are replaced, others may have any names. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    passing = [c for c in docs.columns if c not in ("tokens", "posterior", "rate", "copies") and (with_text or c != text_col)]
    rows = training_rows(docs, labels, domain_label(), id_col, text_col)
    model = Softmax.fit(features([t for t, _ in rows]), np.array([y for _, y in rows], np.int64), len(DOMAINS))
    members = scratch.keep(with_posterior(docs, model, passing, text_col))
    out = members.withColumn("rate", fit_rates(members.select("tokens", "posterior"), weights)).select(*unpacked(passing), "tokens", "posterior", "rate")
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return out.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
