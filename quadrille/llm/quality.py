"""Quality classifier by hierarchical empirical Bayes (operator 1).

A logistic model of surface statistics gives each text its evidence. Grouped sums of the evidence give every host, and every path of a
host, a posterior: a path shrinks toward its host, a host toward the whole corpus, the more the fewer documents it has; how
strongly is estimated from the spread between groups (method of moments). A document's score joins its evidence with the posterior of its
site, its own evidence left out of the site's sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, give_back, labelled_sample, materialize, ship, utf8
from .surface import TEXT_FEATURES, text_features

FIT_ROWS = 6000
FIT_CHARS = 100_000
THRESHOLD = 0.5
#: Evidence is summed in whole units, so that sums do not depend on the order of rows.
_UNIT = 1_000_000


@dataclass
class TextModel:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def probability(self, text: bytes | None) -> float:
        z = float(((np.array(text_features(text or b"")) - self.mean) / self.scale) @ self.weights + self.bias)
        return float(np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-4, 1 - 1e-4))


def fit_text_model(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS, max_chars: int = FIT_CHARS) -> TextModel:
    """Fit on at most ``max_rows`` labelled texts. With no label, or labels of one kind, every text gets that kind's rate (none: 1/2)."""
    sample = labelled_sample(docs, labels, "quality", max_rows, max_chars)
    y = np.array([q for _, q in sample], float)
    d = len(TEXT_FEATURES)
    if len(set(y.tolist())) < 2:
        rate = (y.sum() + 1) / (len(y) + 2)
        return TextModel(np.zeros(d), float(np.log(rate / (1 - rate))), np.zeros(d), np.ones(d))
    return TextModel(*fit_logistic([text_features(t.encode()) for t, _ in sample], y))


def evidence(text: str, model: TextModel) -> Column:
    """P(good | text) as whole units of 1e-6."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([round(model.probability(t) * _UNIT) for t in texts], dtype="int64")
        give_back()

    return of(utf8(text))


def _strength(groups: DataFrame, mean: Column, around: Column) -> float:
    """Prior strength of Beta groups with n rows and sum s around a centre: the spread between means beyond what n explains."""
    m = F.col("s") / F.col("n")
    row = groups.agg(
        F.sum(F.col("n") * (m - around) * (m - around)).alias("spread"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") * around * (1 - around)).alias("within")
    ).first()
    if not row["n"] or row["groups"] < 2:
        return 10.0
    within = row["within"] / row["n"]
    between = (row["spread"] - row["groups"] * within) / row["n"]
    return float(np.clip(within / between - 1, 1.0, 1e6)) if between > 0 else 1e6


@dataclass
class Sites:
    """Sums a path (host, path, n, s, host_n, host_s), the corpus mean, and the strengths of both shrinkages."""

    table: DataFrame
    mean: float
    host_strength: float
    path_strength: float


def site_posteriors(marked: DataFrame) -> Sites:
    """Sums of rows (host, path, e), e in units. Hosts and paths may be null; partial sums keep a common host from one task."""
    paths = materialize(marked.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), (F.sum("e") / _UNIT).alias("s")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(np.clip(total["s"] / total["n"], 1e-4, 1 - 1e-4)) if total["n"] else 0.5
    host_strength = _strength(hosts, F.lit(mean), F.lit(mean))
    h = hosts.select(F.col("host").alias("_host"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    # written, so that its size is known when texts meet it
    joined = materialize(paths.join(h, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "sites")
    centre = (F.col("host_s") + host_strength * mean) / (F.col("host_n") + host_strength)
    return Sites(joined, mean, host_strength, _strength(joined, F.lit(mean), centre))


def with_scores(marked: DataFrame, sites: Sites, threshold: float = THRESHOLD) -> DataFrame:
    """Add evidence, host_posterior, path_posterior, score and kept to rows with host, path and e."""
    t = sites.table.select(*[F.col(c).alias(f"_{c}") for c in sites.table.columns])
    own = F.col("e") / _UNIT
    logit = lambda p: F.log(p / (1 - p))
    rows = marked.join(t, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    inside = lambda x: F.least(F.greatest(x, F.lit(1e-4)), F.lit(1 - 1e-4))
    host = inside((F.col("_host_s") - own + sites.host_strength * sites.mean) / (F.col("_host_n") - 1 + sites.host_strength))
    rows = rows.withColumns({"evidence": own, "host_posterior": host})
    rows = rows.withColumn("path_posterior", inside((F.col("_s") - own + sites.path_strength * F.col("host_posterior")) / (F.col("_n") - 1 + sites.path_strength)))
    odds = logit(F.col("evidence")) + logit(F.col("path_posterior")) - F.lit(float(np.log(sites.mean / (1 - sites.mean))))
    rows = rows.withColumn("score", F.round(1 / (1 + F.exp(-odds)), 9))
    return rows.withColumn("kept", F.col("score") >= threshold).drop(*[f"_{c}" for c in sites.table.columns])


def score_documents(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, score, kept) for every row of ``docs``.

    ``host`` and ``path`` default to the columns source and lang. A null text counts as empty; null hosts form a site, as do null
    paths of a host. Rows that repeat count each on its own and get equal scores. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit_text_model(docs, labels)
    marked = docs.select(F.col("doc_id").cast("long"), host.cast("string").alias("host"), path.cast("string").alias("path"), evidence("text", model).alias("e"))
    marked = materialize(marked, "evidence")
    return with_scores(marked, site_posteriors(marked.select("host", "path", "e")), threshold).drop("e")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` keeps, all columns as they were. The evidence is computed again so that texts need no shuffle."""
    ship(docs.sparkSession)
    model = fit_text_model(docs, labels)
    slim = docs.select(F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"), evidence("text", model).alias("e"))
    sites = site_posteriors(materialize(slim, "evidence"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"), evidence("text", model).alias("e"))
    return with_scores(rows, sites, threshold).where("kept").select("row.*")
