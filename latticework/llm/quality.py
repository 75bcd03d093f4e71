"""Quality classifier with hierarchical empirical Bayes.

A text classifier gives each document its evidence. Documents belong to a host
and to a path below it; the share of good documents of a host is shrunk towards
the global share, and that of a path towards its host's, each by the strength
that the spread between groups supports (method of moments). A document's
posterior is its own evidence on the prior that the other documents of its path,
host and corpus give. Group statistics are plain grouped sums over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .repeats import _texts
from .rows import packed, unpacked
from .scratch import Scratch
from .textclass import MOST_TRAINING, Softmax, features, training_rows

#: Documents are kept from this posterior on.
THRESHOLD = 0.5
#: Shrinkage is never weaker than this many documents.
LEAST_STRENGTH = 10.0


@dataclass(frozen=True)
class Site:
    """How a row names its host and its path; for web pages pass expressions over the URL."""

    host: Column
    path: Column


def default_site() -> Site:
    return Site(F.col("source").cast("string"), F.concat_ws("/", F.col("source").cast("string"), F.col("lang").cast("string")))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Softmax:
    """Class 1 is good. Without labelled rows every document's evidence is even."""
    rows = training_rows(docs, labels, F.col("quality"), most=most)
    return Softmax.fit(features([t for t, _ in rows]), np.array([int(y == 1) for _, y in rows], np.int64), 2)


def _evidence(model: Softmax):
    def run(batches):
        for batch in batches:
            p = np.clip(model.predict([t for (t,) in _texts(batch, "bytes")])[:, 1], 1e-6, 1 - 1e-6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*batch.schema.names[:-1], "p"])

    return run


def _strength(share: Column, n: Column, centre: Column) -> Column:
    """Documents that the prior of a group weighs, from the spread of group shares:
    c (1 - c) / between-group variance - 1."""
    spread = F.sum(n * (share - centre) * (share - centre)) / F.sum(n)
    noise = F.sum(centre * (1 - centre)) / F.sum(n)
    middle = F.sum(n * centre * (1 - centre)) / F.sum(n)
    return F.greatest(F.lit(LEAST_STRENGTH), middle / F.greatest(spread - noise, F.lit(1e-6)) - 1)


def site_priors(scored: DataFrame) -> DataFrame:
    """The rows of ``scored`` (host, path, p) with ``prior`` and ``centre``: the
    shrunken share of good documents of the row's path and of all, over all rows
    but the row itself, so that no evidence counts twice."""
    paths = scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    n, good = hosts.agg(F.coalesce(F.sum("host_n"), F.lit(0.0)), F.coalesce(F.sum("host_good"), F.lit(0.0))).collect()[0]
    middle = F.lit((good + 1) / (n + 2))
    strength = hosts.agg(_strength(F.col("host_good") / F.col("host_n"), F.col("host_n"), middle)).collect()[0][0] or LEAST_STRENGTH
    of_host = F.lit(float(strength))
    hosts = hosts.withColumn("host_prior", (F.col("host_good") + of_host * middle) / (F.col("host_n") + of_host))
    both = paths.join(hosts, "host")
    strength = both.agg(_strength(F.col("good") / F.col("n"), F.col("n"), F.col("host_prior"))).collect()[0][0] or LEAST_STRENGTH
    of_path = F.lit(float(strength))
    centre = (F.lit(good) - F.col("p") + 1) / F.lit(n + 1)
    host_prior = (F.col("host_good") - F.col("p") + of_host * centre) / (F.col("host_n") - 1 + of_host)
    prior = (F.col("good") - F.col("p") + of_path * host_prior) / (F.col("n") - 1 + of_path)
    return scored.join(both.drop("host_prior"), ["host", "path"]).withColumn("prior", prior).withColumn("centre", centre)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def scored_rows(docs: DataFrame, labels: DataFrame, site: Site | None = None, text_col: str = "text", passing: list[str] | None = None) -> DataFrame:
    """row (the columns ``passing``), evidence, prior and score (the posterior that
    the text is good) for every row.

    Null and empty texts have only the evidence of the classifier's constant. A
    null host or path is a site of its own. Labels that are null, repeated (the
    larger counts) or of unknown ids do no harm; without any, the evidence is
    even. Rows may repeat, ids may be null, and columns may have any names. An
    empty table gives no rows. Site statistics are joined by site; the engine
    broadcasts them only below its own size threshold and deals large sites out
    otherwise.
    """
    site = site or default_site()
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(docs, labels)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes")
    named = docs.select(packed(docs.columns if passing is None else passing), F.coalesce(site.host, F.lit("")).alias("host"), F.coalesce(site.path, F.lit("")).alias("path"), text)
    schema = StructType([*named.schema.fields[:-1], StructField("p", DoubleType())])
    scored = site_priors(scratch.keep(named.mapInArrow(_evidence(model), schema)))
    z = _logit(F.col("p")) + _logit(F.col("prior")) - _logit(F.col("centre"))
    return scored.select("row", F.col("p").alias("evidence"), "prior", (1 / (1 + F.exp(-z))).alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, site: Site | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, evidence, prior, score, kept for every row."""
    scored = scored_rows(docs, labels, site, passing=["doc_id"])
    return scored.select(*unpacked(["doc_id"]), "evidence", "prior", "score", (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, site: Site | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose posterior reaches the threshold, with their columns."""
    return scored_rows(docs, labels, site).filter(F.col("score") >= threshold).select(*unpacked(docs.columns))
