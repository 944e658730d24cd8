"""Helpers that the corpus operators share: shared-folder tables, word rules, bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import broadcast_if_few, materialize, shared_dir, ship

#: A word: a run of anything but the six ASCII white-space characters. ``bytes.split()`` cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "broadcast_if_few", "fit_logistic", "give_back", "labelled_sample", "materialize", "shared_dir", "ship", "table", "utf8"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """The UTF-8 bytes of a text column; null stays null."""
    return F.col(column).cast("binary")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int, max_chars: int, where: Column | None = None) -> list[tuple[str, int]]:
    """At most ``max_rows`` labelled texts on the driver, to fit a model on.

    The rows with the smallest hash of their ``doc_id`` are taken, so a sample does not depend on the order of the
    input. Texts over ``max_chars`` are left out of the *fit* only. ``max_rows * max_chars`` bounds the driver's share.
    Labels that are null or name a document more than once count as one label, the smallest.
    """
    chosen = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        chosen = chosen.where(where)
    chosen = (
        chosen.groupBy("doc_id").agg(F.min(target).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # max_rows rows of two numbers: the broadcast has a proven size
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .where(F.length("text") <= max_chars)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_rows)
        .select("text", "y").toPandas()
    )
    return list(zip(rows["text"].tolist(), (int(y) for y in rows["y"]), strict=True))


def give_back() -> None:
    """Return memory that a finished task has freed to the system: idle Python workers live on beside the next stage."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fit_logistic(x, y, l2: float = 1.0, steps: int = 50):
    """Newton's method for L2-regularised logistic regression with an intercept; returns (weights, bias, mean, scale)."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(y) == 0:
        return np.zeros(x.shape[1] if x.ndim == 2 else 0), 0.0, np.zeros(x.shape[1] if x.ndim == 2 else 0), np.ones(x.shape[1] if x.ndim == 2 else 0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], l2)
    ridge[-1] = 1e-2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), grad)
        big = np.abs(step).max()
        w -= step * min(1.0, 4.0 / big) if big > 0 else step
        if big < 1e-6:
            break
    return w[:-1], float(w[-1]), mean, scale


