"""Models of windows: one-class support vectors, and random forests under spatial cross-validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import model_input
from ..storage import materialize, ship
from . import labels, metrics

NU = 0.1
MAX_REFERENCE = 5000


@dataclass
class OneClass:
    """Support vectors of the reference rows, in scaled features. Sent to the executors with the scoring function: at most MAX_REFERENCE rows."""

    vectors: np.ndarray
    alpha: np.ndarray
    rho: float
    gamma: float
    mean: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        d = (z * z).sum(1)[:, None] + (self.vectors * self.vectors).sum(1) - 2 * z @ self.vectors.T
        return np.exp(-self.gamma * np.maximum(d, 0)) @ self.alpha - self.rho


def fit_one_class(reference: np.ndarray, nu: float = NU, tolerance: float = 1e-6, rounds: int = 100_000) -> OneClass:
    """Dual of the one-class SVM with a radial kernel, gamma 1 / (features * variance): pairs of multipliers, the worst violators first."""
    mean, scale = reference.mean(0), reference.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (reference - mean) / scale
    n = len(z)
    variance = z.var()
    gamma = 1.0 / (z.shape[1] * variance) if variance > 0 else 1.0
    square = (z * z).sum(1)
    k = np.exp(-gamma * np.maximum(square[:, None] + square - 2 * z @ z.T, 0))
    top = 1.0 / (nu * n)
    alpha = np.zeros(n)
    full = int(nu * n)
    alpha[:full] = top
    if full < n:
        alpha[full] = 1.0 - full * top
    g = k @ alpha
    for _ in range(rounds):
        i = int(np.argmin(np.where(alpha < top - 1e-12, g, np.inf)))
        j = int(np.argmax(np.where(alpha > 1e-12, g, -np.inf)))
        if g[j] - g[i] < tolerance:
            break
        step = min((g[j] - g[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), top - alpha[i], alpha[j])
        alpha[i] += step
        alpha[j] -= step
        g += step * (k[:, i] - k[:, j])
    inside = (alpha > 1e-9) & (alpha < top - 1e-9)
    rho = float(g[inside].mean()) if inside.any() else float((g[alpha > 1e-9].max() + g[alpha < top - 1e-9].min()) / 2) if (alpha < top - 1e-9).any() else float(g.max())
    keep = alpha > 1e-9
    return OneClass(z[keep], alpha[keep], rho, gamma, mean, scale)


def one_class_scores(features: DataFrame, columns: Sequence[str], is_reference: Column, nu: float = NU, max_reference: int = MAX_REFERENCE) -> DataFrame:
    """``features`` with ``svm_score`` and ``svm_inlier``. The reference rows, at most ``max_reference`` by the drawn order, are fitted on the driver."""
    ship(features.sparkSession)
    array = F.array(*[model_input(F.col(c).cast("double")) for c in columns])
    sample = features.where(is_reference).select(array.alias("x")).orderBy(F.md5(F.concat_ws(",", "x"))).limit(max_reference).toPandas()
    if sample.empty:
        raise ValueError("there are no reference rows")
    model = fit_one_class(np.array(sample["x"].tolist(), float), nu)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(x)) if len(x) else [], dtype="float64")

    return features.withColumn("svm_score", score(array)).withColumn("svm_inlier", (F.col("svm_score") >= 0).cast("int"))


def forest(trees: int = 300, depth: int = 30, least_leaf: int = 4, seed: int = 42, weight: str | None = "weight"):
    from pyspark.ml.classification import RandomForestClassifier

    f = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=least_leaf, featureSubsetStrategy="sqrt", maxBins=256, seed=seed)
    return f.setWeightCol(weight) if weight else f


def assembled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = rows.withColumns({f"_x_{c}": model_input(F.col(c).cast("double")) for c in columns})
    return VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="features").transform(filled).drop(*[f"_x_{c}" for c in columns])


@dataclass
class CrossValidated:
    """Out-of-fold probabilities (keys, prob) and importances (fold, feature, importance)."""

    scores: DataFrame
    importances: list[tuple[int, str, float]]


def cross_validate(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("win_r", "win_c"), trees: int = 300, balanced: bool = True, seed: int = 42) -> CrossValidated:
    """Every row is scored by the forest of the other folds. ``rows`` has columns fold and y (null: scored, not learned from).

    A fold without rows is skipped; where the other folds hold one class only, its rate is the score.
    """
    from pyspark.ml.functions import vector_to_array

    data = materialize(assembled(rows, columns).select(*keys, "fold", "y", "features"), "vectors")
    out, importances = None, []
    for fold in sorted(r[0] for r in data.select("fold").distinct().collect()):
        train, test = data.where((F.col("fold") != fold) & F.col("y").isNotNull()), data.where(F.col("fold") == fold)
        classes = [r[0] for r in train.select("y").distinct().collect()]
        if len(classes) < 2:
            part = test.select(*keys, F.lit(float(classes[0]) if classes else None).cast("double").alias("prob"))
        else:
            weighted = labels.class_weights(train) if balanced else train.withColumn("weight", F.lit(1.0))
            model = forest(trees, seed=seed).fit(weighted.withColumn("y", F.col("y").cast("double")))
            importances += [(int(fold), c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)]
            part = model.transform(test).select(*keys, vector_to_array("probability")[1].alias("prob"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("there are no rows")
    return CrossValidated(out, importances)


def importance_rows(spark, cv: CrossValidated) -> DataFrame:
    """(feature, importance): means over folds. A row a feature and fold."""
    return metrics.mean_importance(spark.createDataFrame(cv.importances or [(0, "none", 0.0)], "fold int, feature string, importance double"))


#: name: (only windows in scope, negatives a positive, balanced weights); the five settings that the tuner compares.
TUNING = {"base": (True, 4, True), "all": (False, 4, True), "ratio8": (True, 8, True), "ratio15": (True, 15, True), "plain": (True, 4, False)}


def tune(windows: DataFrame, columns: Sequence[str], settings: dict[str, tuple[bool, int, bool]] = TUNING, trees: int = 300, seed: int = 42) -> DataFrame:
    """(setting, n_train, auc): ``windows`` has keys, label, built_score, fold, in_scope and the features. Hard negatives are strictly the first."""
    spark, out = windows.sparkSession, []
    for name, (scoped, ratio, balanced) in settings.items():
        pool = windows.where("in_scope") if scoped else windows
        chosen = labels.training_sample(pool, seed=seed, ratio=ratio, draw_from_pool=False).select("win_r", "win_c", "y")
        chosen = materialize(chosen, "chosen")
        cv = cross_validate(windows.join(chosen, ["win_r", "win_c"], "left"), columns, trees=trees, balanced=balanced, seed=seed)
        scored = cv.scores.join(chosen, ["win_r", "win_c"])
        out.append((name, chosen.count(), metrics.roc_auc(scored, score="prob").first()[0]))
    return spark.createDataFrame(out, "setting string, n_train long, auc double")
