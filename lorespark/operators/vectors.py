"""Exact vector search, joins of many queries, and upkeep of the vector table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a kNN join that are gathered and sent to all tasks at once; more are taken in blocks, a scan each.
QUERY_BLOCK = 20_000


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared Euclidean (the default), cosine or inner-product distance of two arrays, as double."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    total = lambda z: F.aggregate(z, F.lit(0.0), lambda s, v: s + v)
    if metric == "l2":
        return total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    if metric == "inner_product":
        return F.lit(1.0) - dot
    if metric == "cosine":
        norm = lambda z: F.sqrt(total(F.transform(z, lambda v: v * v)))
        return F.lit(1.0) - F.try_divide(dot, norm(x) * norm(y))
    raise ValueError(f"unknown metric {metric!r}")


def top_k(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "l2", key: str = "chunk_id", vector: str = "vector", max_distance: float | None = None) -> DataFrame:
    """The ``k`` nearest rows with ``distance`` and 1-based ``rank``; ties by key.

    The query is a literal, so the plan is one pruned scan and a top-k; only k
    rows are numbered. ``max_distance`` filters after the top-k if it is given.
    """
    literal = F.array(*[F.lit(float(v)) for v in query])
    near = vectors.withColumn("distance", distance(F.col(vector), literal, metric)).drop(vector).orderBy("distance", key).limit(k)
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))
    return ranked if max_distance is None else ranked.filter(F.col("distance") <= max_distance)


def distance_stats(hits: DataFrame) -> DataFrame:
    """min, max and mean distance of all hits, before any are dropped; nulls if there are none."""
    return hits.agg(F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"), F.avg("distance").alias("avg_distance"))


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, distance, rank) of the ``k`` nearest of every query by squared distance, ties by key.

    The stated queries (query_id, query) are held against all vectors block by
    block. A task scores its batches against a block and passes on ``k`` rows
    per query, so what is shuffled does not grow with the vectors. Of several
    blocks each is finished, and kept on disk, before the next is gathered, so
    driver and tasks hold one at a time.
    """
    blocks = max(1, -(-queries.count() // block))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    done: list[DataFrame] = []
    for b in range(blocks):
        local, shared = _nearest(vectors, queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), k, key, vector)
        best = local.withColumn("rank", place).filter(F.col("rank") <= k)
        if blocks > 1:
            best = best.persist(StorageLevel.DISK_ONLY)
            best.count()
            shared.unpersist()  # sent again if a lost part must be computed anew
        done.append(best)
    return reduce(DataFrame.unionByName, done)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> tuple[DataFrame, Broadcast]:
    """The ``k`` nearest of each query within each task, and the broadcast queries."""
    gathered = queries.select("query_id", "query").toPandas()
    ids = gathered["query_id"].tolist()
    matrix = np.array([list(q) for q in gathered["query"]], np.float64).reshape(len(ids), -1)
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))

    def nearest(batches):
        names, points = shared.value
        best: list[list[tuple[float, int]]] = [[] for _ in names]
        for batch in batches:
            if not (batch.num_rows and names):
                continue
            keys = batch.column(0).to_numpy()
            rows = np.array(batch.column(1).to_pylist(), np.float64)
            for i, point in enumerate(points):
                d = ((rows - point) ** 2).sum(axis=1)
                top = np.argpartition(d, k - 1)[:k] if len(d) > k else np.arange(len(d))
                top = np.flatnonzero(d <= d[top].max())  # all ties of the last one
                best[i] = sorted(best[i] + list(zip(d[top].tolist(), keys[top].tolist())))[:k]
        flat = [(names[i], key_, d) for i, found in enumerate(best) for d, key_ in found]
        columns = list(zip(*flat)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", key, "distance"])

    return vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector).mapInArrow(nearest, f"query_id long, {key} long, distance double"), shared


def upsert(vectors: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Insert or replace by key; keys that ``new`` lacks stay."""
    return vectors.join(new.select(key), key, "left_anti").unionByName(new)


def prune(vectors: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Vectors whose chunk still exists."""
    return vectors.join(chunks.select(key).distinct(), key, "left_semi")
