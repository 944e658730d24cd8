"""Approximate nearest neighbours by inner product (operator 10): balanced posting lists.

Centroids are fitted by balanced k-means on a bounded sample and held in memory with a neighbour graph over them. Every vector goes to the
list of its nearest centroid and, at a boundary, to a few more whose distance is nearly as small. A query walks the graph for the
nearest centroids and visits the lists whose distance is within a ratio of the nearest one's. Lists and the queries that visit
them are cut into blocks, so a common vector spreads over tasks; each block pair is one product of two bounded matrices.

Largest inner product becomes least distance with one more coordinate, sqrt(max norm^2 - norm^2), for the vectors and 0 for queries.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

LIST_SIZE = 256
MAX_LISTS = 4096
FIT_VECTORS = 20_000
REPLICAS = 3
REPLICA_RATIO = 1.05
QUERY_RATIO = 1.15
LEAST_CANDIDATES = 8192
FIRST_CANDIDATES = 2048
DEGREE = 24
BLOCK = 2048


@dataclass
class Centroids:
    """At most MAX_LISTS centres and DEGREE links each: a bounded broadcast (under 4096 * (8 d + 100) bytes)."""

    points: np.ndarray
    links: np.ndarray
    sizes: np.ndarray
    squares: np.ndarray

    def walk(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of the graph from a few spread entries; the ``width`` nearest centres found and their distances."""
        n = len(self.points)
        width = min(width, n)
        entry = np.linspace(0, n - 1, min(n, 8)).astype(np.int64)
        seen = np.zeros(n, bool)
        seen[entry] = True
        d = np.maximum(self.squares[entry] - 2 * self.points[entry] @ q, -np.inf)
        front = list(zip(d.tolist(), entry.tolist(), strict=True))
        best = [(-x, c) for x, c in front]
        heapq.heapify(front)
        heapq.heapify(best)
        while front:
            x, c = heapq.heappop(front)
            if len(best) >= width and x > -best[0][0]:
                break
            new = self.links[c]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            for x, c in zip((self.squares[new] - 2 * self.points[new] @ q).tolist(), new.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-x, c))
                    heapq.heappush(front, (x, c))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, c))
                    heapq.heappush(front, (x, c))
        best.sort(reverse=True)
        lists = np.array([c for _, c in best], np.int64)
        return lists, np.sqrt(np.maximum(np.array([-x for x, _ in best]) + q @ q, 0))

    def select(self, q: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Lists to visit: within ``ratio`` of the nearest centre's distance, and nearest first until they hold ``least`` vectors."""
        width = 32
        while True:
            lists, d = self.walk(q, width)
            enough = int(np.searchsorted(np.cumsum(self.sizes[lists]), least)) + 1
            near = int(np.searchsorted(d, ratio * d[0] + 1e-12, side="right"))
            if max(enough, near) < len(lists) or len(lists) >= len(self.points) or len(lists) < width:
                return lists[: max(enough, near)]
            width *= 2


def _nearest(x: np.ndarray, points: np.ndarray, penalty: np.ndarray | float = 0.0) -> np.ndarray:
    squares = (points * points).sum(1) + penalty
    return np.concatenate([(squares - 2 * x[i : i + 4096] @ points.T).argmin(1) for i in range(0, len(x), 4096)])


def fit(sample: np.ndarray, lists: int, rounds: int = 12, balance: float = 0.3, seed: int = 7) -> Centroids:
    """Balanced k-means: a list over its fair share looks farther away, the more the fuller; then the graph over the centres."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    lists = max(1, min(lists, len(distinct)))
    points = distinct[rng.choice(len(distinct), lists, replace=False)].copy()
    fair, counts = len(sample) / lists, np.full(lists, len(sample) / lists)
    for _ in range(rounds):
        spread = max(float(((sample[:2048, None] - points[None, rng.integers(0, lists, 8)]) ** 2).sum(2).mean()), 1e-9) * 0.02
        own = _nearest(sample, points, balance * spread * np.minimum(np.maximum(counts / fair - 1, 0), 8))
        counts = np.bincount(own, minlength=lists).astype(float)
        for k in range(sample.shape[1]):
            points[:, k] = np.where(counts > 0, np.bincount(own, sample[:, k], lists) / np.maximum(counts, 1), points[:, k])
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            points[empty] = distinct[rng.choice(len(distinct), len(empty))]
    squares = (points * points).sum(1)
    degree = min(DEGREE, lists - 1) if lists > 1 else 1
    links = []
    for i in range(0, lists, 1024):
        d = squares - 2 * points[i : i + 1024] @ points.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        links.append(np.argsort(d, axis=1)[:, :degree] if lists > 1 else np.zeros((1, 1), np.int64))
    far = rng.integers(0, lists, (lists, 4))  # long links, so that separate clusters stay within reach
    return Centroids(points, np.hstack([np.vstack(links), far]).astype(np.int64), np.ones(lists), squares)


def usable(vector: str) -> Column:
    """Not null, not zero, all components finite numbers."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray, k: int, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): the k largest products of each query at or over its bar, ties to the smaller vec_id, its own row left out.

    A matrix product finds who may be among them; their scores are then summed in one fixed order, so that equal vectors tie.
    """
    if not len(queries) or not len(vectors):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    s = queries @ vectors.T
    s[query_ids[:, None] == vec_ids[None, :]] = -np.inf
    cut = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    cut = np.maximum(cut, bars)
    cut = np.where(np.isfinite(cut), cut - 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(cut), cut, 0))), cut)
    out_q, out_v, out_s = [], [], []
    for i in np.flatnonzero(s.max(axis=1) >= cut):
        q = queries[i]
        at = np.flatnonzero((s[i] >= cut[i]) & (s[i] > -np.inf))
        exact = (vectors[at] * q).sum(1)
        order = np.lexsort((vec_ids[at], -exact))[:k]
        out_q.append(np.full(len(order), query_ids[i]))
        out_v.append(vec_ids[at][order])
        out_s.append(exact[order])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, list_size: int = LIST_SIZE, max_lists: int = MAX_LISTS, fit_vectors: int = FIT_VECTORS,
    replicas: int = REPLICAS, replica_ratio: float = REPLICA_RATIO, query_ratio: float = QUERY_RATIO, least_candidates: int = LEAST_CANDIDATES,
    first_candidates: int = FIRST_CANDIDATES, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` nearest found rows of ``vectors``, its own left out.

    Both tables have vec_id and embedding; other columns are ignored. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor does one whose length is not the commonest (ties: the shorter), nor a null vec_id. Rows that repeat a
    vec_id count as one candidate, the nearest. Fewer candidates than ``k``: all of them. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    clean = lambda df: df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable("embedding"))
    v, q = clean(vectors), clean(queries)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = v.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return empty
    d, n, top = lengths
    v, q = v.where(F.size("embedding") == d), q.where(F.size("embedding") == d)
    rows = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_vectors).select("embedding").toArrow()
    raw = _matrix(rows.column(0))
    lists = max(1, min(max_lists, math.ceil(n / list_size)))

    def augmented(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])

    found = fit(augmented(raw), lists)
    shared = spark.sparkContext.broadcast(found)

    def assign(batches):
        c = shared.value
        for b in batches:
            x = augmented(_matrix(b.column(1)))
            ids = b.column(0).to_numpy()
            for i in range(0, len(x), 2048):
                part = x[i : i + 2048]
                dist = np.sqrt(np.maximum((part * part).sum(1)[:, None] + c.squares - 2 * part @ c.points.T, 0))
                r = min(replicas, dist.shape[1])
                near = np.argpartition(dist, r - 1, axis=1)[:, :r]
                dn = np.take_along_axis(dist, near, 1)
                order = np.argsort(dn, axis=1, kind="stable")
                near, dn = np.take_along_axis(near, order, 1), np.take_along_axis(dn, order, 1)
                row, col = np.nonzero(dn <= replica_ratio * dn[:, :1] + 1e-12)
                take = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([pa.array(near[row, col]), pa.array(col == 0), pa.array(ids[i + row]), b.column(1).take(take)], names=["list", "own", "vec_id", "embedding"])

    postings = materialize(v.mapInArrow(assign, "list long, own boolean, vec_id long, embedding array<double>"), "postings")
    # a row a list: at most max_lists
    counted = postings.groupBy("list").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("own").cast("long")).alias("own")).collect()
    sizes = np.zeros(len(found.points))
    for r in counted:
        sizes[r["list"]] = r["own"]
    sized = spark.sparkContext.broadcast(Centroids(found.points, found.links, sizes, found.squares))

    def visit(batches):
        c = sized.value
        for b in batches:
            x = _matrix(b.column(1))
            chosen = [c.select(np.append(row, 0.0), query_ratio, least_candidates) for row in x]
            at = np.repeat(np.arange(len(x)), [len(lists) for lists in chosen])
            if len(at):
                # the nearest lists come first: what they hold sets a bar for the others
                later = np.concatenate([np.cumsum(c.sizes[lists]) - c.sizes[lists] >= first_candidates for lists in chosen])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen)), pa.array(later), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["list", "later", "query_id", "query"])

    probes = materialize(q.mapInArrow(visit, "list long, later boolean, query_id long, query array<double>"), "probes")
    near = materialize(_top(_compared(postings, probes.where("not later").withColumn("bar", F.lit(float("-inf"))), k, block), k), "near")
    bars = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    far = probes.where("later").join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    rest = _compared(postings, far, k, block)
    return _top(near.select("query_id", "vec_id", "score").unionByName(rest), k)


def _compared(postings: DataFrame, probes: DataFrame, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): the k best at or over its bar for each query in each block of each list that it visits."""
    asked = probes.groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    held = postings.groupBy("list").agg(F.count(F.lit(1)).alias("held"))
    grid = held.join(asked, "list").select("list", F.ceil(F.col("held") / block).alias("vs"), F.ceil(F.col("asked") / block).alias("qs"))
    grid = F.broadcast(grid)  # a row a list, at most max_lists
    here = postings.join(grid, "list").withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.col("vs"))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)))
    there = probes.join(grid, "list").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qs"))).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vs") - 1)))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, s = best_of(_matrix(right.column("query")), right.column("query_id").to_numpy(), _matrix(left.column("embedding")), left.column("vec_id").to_numpy(), k, right.column("bar").to_numpy())
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    keys = ["list", "vb", "qb"]
    return here.select(*keys, "vec_id", "embedding").groupBy(*keys).cogroup(there.select(*keys, "query_id", "query", "bar").groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")


def _top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query, from k at most of each block that it visited."""
    from pyspark.sql import Window

    once = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
