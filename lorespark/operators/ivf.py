"""Approximate vector search by an inverted file of residuals, kept beside the vectors.

Vectors are dealt to the lists of their nearest centroids. A list's entry holds
the vector's distance from the centroid as one signed byte per component, and
how far that is off (its error). A search looks only into the lists whose
centroids are nearest to the query; lists are folders, so what it reads is in
proportion to what it probes. The error bounds each entry's true distance from
both sides: entries that cannot be among the nearest of a list are dropped, and
the vectors of the rest are looked up in the store by key. Within the lists
that are probed the result is exact; probing all lists is an exact search.

Centroids are fitted on a bounded sample (``SAMPLE_PER_LIST`` rows a list, by a
hash of the key); every vector is indexed. An upsert adds entries of a new
generation and notes the keys; a deletion notes them only. Entries of earlier
generations than a key's note are passed over until the index is built again.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.operators.vectors import distance, knn_join
from lorespark.sources.files import Files

SAMPLE_PER_LIST = 64
#: Lists follow the square root of the number of vectors, up to what this many bytes of centroids allow.
CENTROID_BYTES = 64 << 20
#: Entries of a list that one task holds against its queries at a time, and queries of a list held by one task.
ENTRIES, QUERIES = 4_096, 4_096
#: Entries that are searched by one task.
SPLIT = 1 << 20
STEP = 127.0

ENTRY = "key string, code binary, scale float, error float, generation int, list int"
NOTE = "key string, latest int"


def _nearest_lists(points: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each point, nearest first."""
    far = (centroids**2).sum(axis=1) - 2 * points @ centroids.T
    if n < len(centroids):
        some = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)
    return np.argsort(far, axis=1, kind="stable")


def _points(column: pa.Array) -> np.ndarray:
    """Vectors of one length, without nulls, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


class Index:
    """An inverted file in a folder. ``key`` and ``vector`` name the store's columns; keys are kept as strings."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "chunk_id", vector: str = "vector"):
        self.spark, self.files, self.key, self.vector = spark, Files(spark, folder), key, vector

    # --- upkeep ---

    def exists(self) -> bool:
        return self.files.exists("CURRENT")

    def build(self, vectors: DataFrame, lists: int | None = None, seed: int = 42, rounds: int = 10) -> Index:
        """Fits centroids and indexes all ``vectors``, as a new version; the one before the last goes."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        whole = self._whole(vectors)
        n, size = whole.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        whole = whole.filter(F.size("v") == F.lit(size or 0))  # vectors of fewer components are in no list
        lists = min(lists or round(math.sqrt(n)), max(1, CENTROID_BYTES // (8 * (size or 1))), n) or 1
        share = SAMPLE_PER_LIST * lists / max(1, n)
        some = whole.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(math.ceil(min(1.0, share) * (1 << 30))))
        centroids = np.zeros((1, size or 1))
        if n and lists > 1:
            fitted = KMeans(k=lists, seed=seed, maxIter=rounds, initMode="random").fit(some.select(array_to_vector(F.col("v").cast("array<double>")).alias("features")))
            centroids = np.array(fitted.clusterCenters())
        elif n:
            centroids = np.array([some.select(F.col("v").cast("array<double>")).first()[0]])
        version, before = f"v-{uuid.uuid4().hex}", self.files.read("CURRENT") if self.exists() else None
        self.files.write(f"{version}/centroids.json", json.dumps({"centroids": centroids.tolist(), "size": size or 0}))
        self._append(whole, version, centroids, 0)
        self.files.write("CURRENT", version)
        for old in self.files.folders():
            if old.startswith("v-") and old not in (version, before):
                self.files.delete(old)
        return self

    def upsert(self, new: DataFrame) -> None:
        """Indexes new or changed vectors; the store must hold them as well. Of ``new``, each key once."""
        version, centroids = self._current()
        generation = self._note(version, new)
        self._append(self._whole(new), version, centroids, generation)

    def delete(self, gone: DataFrame) -> None:
        """Forgets the keys of ``gone``."""
        self._note(self._current()[0], gone)

    def _notes(self, version: str) -> DataFrame:
        found = self.files.exists(f"{version}/notes")
        return self.spark.read.schema(NOTE).parquet(f"{self.files.path}/{version}/notes") if found else self.spark.createDataFrame([], NOTE)

    def _note(self, version: str, rows: DataFrame) -> int:
        """Written before the entries: a batch that fails in between is missing until it is run again, never wrong."""
        generation = (self._notes(version).agg(F.max("latest")).first()[0] or 0) + 1
        rows.select(F.col(self.key).cast("string").alias("key"), F.lit(generation).alias("latest")).filter("key is not null").distinct().write.mode("append").parquet(f"{self.files.path}/{version}/notes")
        return generation

    def _whole(self, vectors: DataFrame) -> DataFrame:
        v = F.col(self.vector).cast("array<float>")
        return vectors.select(F.col(self.key).cast("string").alias("key"), v.alias("v")).filter(F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))

    def _current(self) -> tuple[str, np.ndarray]:
        version = self.files.read("CURRENT")
        return version, np.array(json.loads(self.files.read(f"{version}/centroids.json"))["centroids"], np.float64)

    def _append(self, whole: DataFrame, version: str, centroids: np.ndarray, generation: int) -> None:
        width = centroids.shape[1]

        def coded(batches):
            for batch in batches:
                keys, rows = batch.column(0), _points(batch.column(1))
                near = _nearest_lists(rows, centroids, 1)[:, 0]
                left = rows - centroids[near]
                scale = np.maximum(np.abs(left).max(axis=1), 1e-30) / STEP
                code = np.rint(left / scale[:, None]).astype(np.int8)
                scale = scale.astype(np.float32)
                error = np.sqrt(((left - code * scale[:, None].astype(np.float64)) ** 2).sum(axis=1)) * (1 + 1e-6)
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, codes, pa.array(scale), pa.array(np.nextafter(error.astype(np.float32), np.float32(np.inf))), pa.array(np.full(len(near), generation, np.int32)), pa.array(near.astype(np.int32))], ["key", "code", "scale", "error", "generation", "list"])

        fit = whole.filter(F.size("v") == width)
        entries = fit.mapInArrow(coded, ENTRY)
        # a list is one file, a long one several: partitions that grow too large are split
        entries.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{self.files.path}/{version}/entries")

    def calibrate(self, vectors: DataFrame, queries: DataFrame, k: int = 10, target: float = 0.95) -> int:
        """The fewest probes with which stated ``queries`` (query_id, query) find ``target`` of their exact ``k`` nearest; kept as the default.

        How many lists a query has to probe for a neighbour is the place of the
        neighbour's list in the query's order, so one exact join tells all.
        """
        version, centroids = self._current()
        exact = knn_join(vectors, queries, k, self.key, self.vector)
        asked = queries.select(F.col("query_id").alias("__of"), F.col("query").cast("array<float>").alias("query"))
        listed = self.entries().select("key", "list").distinct()
        placed = exact.select("query_id", F.col(self.key).cast("string").alias("key")).join(listed, "key", "left").join(asked, F.col("query_id") == F.col("__of"))

        def ranks(batches):
            for batch in batches:
                if batch.num_rows:
                    order = _nearest_lists(_points(batch.column(0)), centroids, len(centroids))
                    lists = batch.column(1).to_pylist()
                    place = [len(centroids) if n is None else int(np.flatnonzero(row == n)[0]) for row, n in zip(order, lists)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(place, np.int32) + 1)], ["probes"])

        counts = placed.select("query", "list").mapInArrow(ranks, "probes int").groupBy("probes").count().collect()  # a row per list at most
        total, found = sum(r["count"] for r in counts), 0
        needed = len(centroids)
        for row in sorted(counts, key=lambda r: r.probes):
            found += row["count"]
            if found >= target * total:
                needed = min(row.probes, len(centroids))
                break
        self.files.write(f"{version}/probes.json", json.dumps({"probes": needed, "target": target, "k": k}))
        return needed

    def probes(self) -> int:
        """What ``calibrate`` found; all lists before that, which is exact."""
        version, centroids = self._current()
        return json.loads(self.files.read(f"{version}/probes.json"))["probes"] if self.files.exists(f"{version}/probes.json") else len(centroids)

    def entries(self) -> DataFrame:
        version, _ = self._current()
        if not self.files.exists(f"{version}/entries"):
            return self.spark.createDataFrame([], ENTRY)
        entries = self.spark.read.schema(ENTRY).parquet(f"{self.files.path}/{version}/entries")
        if not self.files.exists(f"{version}/notes"):
            return entries
        latest = self._notes(version).groupBy(F.col("key").alias("__key")).agg(F.max("latest").alias("latest"))
        return entries.join(latest, F.col("key") == F.col("__key"), "left").filter(F.col("generation") >= F.coalesce("latest", F.lit(0))).drop("__key", "latest")

    # --- search ---

    def search(self, vectors: DataFrame, query: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        """The ``k`` nearest rows of the store among the lists probed, with ``distance`` and ``rank``; ties by key."""
        _, centroids = self._current()
        point = np.array([list(query)], np.float64)
        lists = _nearest_lists(point, centroids, min(probes or self.probes(), len(centroids)))[0].tolist()
        probed = self.entries().filter(F.col("list").isin(lists)).select("list", "key", "code", "scale", "error")
        names = ["key", "low", "high"]

        def bounds(batches):
            for batch in batches:
                if batch.num_rows:
                    low, high = _bounds(point, centroids, batch, 0)
                    yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(low[0]), pa.array(high[0])], names)

        found = probed.mapInArrow(bounds, "key string, low double, high double").groupBy("key").agg(F.min("low").alias("low"), F.min("high").alias("high"))
        limit = found.orderBy("high").limit(k).agg(F.max("high").alias("most"))
        keys = found.join(F.broadcast(limit), F.col("low") <= F.col("most")).select(F.col("key").alias("__key"))  # one row of limits
        literal = F.array(*[F.lit(float(x)) for x in query])
        rows = vectors.join(keys, vectors[self.key].cast("string") == F.col("__key"), "left_semi")
        near = rows.filter(F.size(self.vector) == len(centroids[0])).withColumn("distance", distance(F.col(self.vector), literal)).drop(self.vector).orderBy("distance", self.key).limit(k)
        return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", self.key)))

    def knn_join(self, vectors: DataFrame, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, key, distance, rank) of the ``k`` nearest of every query (query_id, query) within the lists it probes.

        Queries go to the lists that they probe, and there to each part of a long
        list; a task holds a list's queries and streams its entries by. What it
        cannot exclude meets the store once for exact distances.
        """
        _, centroids = self._current()
        probes, width = min(probes or self.probes(), len(centroids)), centroids.shape[1]

        def probing(batches):
            for batch in batches:
                lists = _nearest_lists(_points(batch.column(1)), centroids, probes) if batch.num_rows else np.empty((0, probes))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["query_id", "query", "lists"])

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<float>").alias("query")).filter(F.size("query") == width)
        probed = asked.mapInArrow(probing, "query_id long, query array<float>, lists array<int>").select("query_id", "query", F.explode("lists").alias("list"))
        entries = self.entries()
        parts = entries.groupBy("list").agg((1 + F.count(F.lit(1)) / SPLIT).cast("int").alias("parts"))
        asks = probed.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "query")
        held = entries.join(F.broadcast(parts), "list")  # a row per list, bounded by CENTROID_BYTES
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        both = asks.select("list", "part", "query_id", "query", none("string", "key"), none("binary", "code"), none("float", "scale"), none("float", "error")).unionByName(
            held.select("list", F.pmod(F.hash("key"), "parts").alias("part"), none("long", "query_id"), none("array<float>", "query"), "key", "code", "scale", "error")
        )
        dealt = both.repartition("list", "part").sortWithinPartitions("list", "part", F.col("query_id").asc_nulls_last())
        some = dealt.mapInArrow(_candidates(centroids, k), "query_id long, key string").distinct()
        stored = vectors.select(self.key, F.col(self.vector).alias("__v")).filter(F.size("__v") == width)
        met = some.join(stored, F.col(self.key).cast("string") == some["key"]).join(asked.select(F.col("query_id").alias("__of"), F.col("query").alias("__q")), F.col("query_id") == F.col("__of"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", self.key))
        return met.select("query_id", self.key, distance(F.col("__v"), F.col("__q")).alias("distance")).withColumn("rank", place).filter(F.col("rank") <= k)


def _bounds(points: np.ndarray, centroids: np.ndarray, batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Between what bounds the distance of each point to each entry lies. ``at``: the column of lists; code, scale and error follow the key."""
    width = centroids.shape[1]
    codes = np.frombuffer(b"".join(batch.column(at + 2).to_pylist()), np.int8).reshape(-1, width)
    scale, error = (batch.column(at + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (3, 4))
    rows = centroids[batch.column(at).to_numpy(zero_copy_only=False)] + codes * scale[:, None]
    far = np.sqrt(np.maximum((points**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1) - 2 * points @ rows.T, 0))
    slack = error + 1e-7 * (1 + far)
    return np.maximum(far - slack, 0), far + slack


def _candidates(centroids: np.ndarray, k: int):
    """Sorted rows of one (list, part) after the other: its queries, then its entries. Gives the entries that may be among a query's ``k``."""

    def task(batches):
        now, ids, points, best = None, [], [], None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out():
            queries, keys, low = (np.concatenate(x) for x in zip(*held))
            keep = low <= best[queries, -1]
            return pa.RecordBatch.from_arrays([pa.array(np.array(ids)[queries[keep]], pa.int64()), pa.array(keys[keep], pa.string())], ["query_id", "key"])

        for batch in batches:
            lists, parts = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero((np.diff(lists, prepend=-1) != 0) | (np.diff(parts, prepend=-1) != 0))
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
                if (lists[lo], parts[lo]) != now:
                    if held:
                        yield out()
                    now, ids, points, best, held = (lists[lo], parts[lo]), [], [], None, []
                rows = batch.slice(lo, hi - lo)
                asks = rows.filter(rows.column(2).is_valid())
                if asks.num_rows:
                    ids += asks.column(2).to_pylist()
                    points.append(_points(asks.column(3)))
                entries = rows.filter(rows.column(2).is_null())
                for at in range(0, entries.num_rows if ids else 0, ENTRIES):
                    some = entries.slice(at, ENTRIES)
                    if len(points) > 1:
                        points = [np.concatenate(points)]
                    best = np.full((len(ids), k), np.inf) if best is None else best
                    part = pa.RecordBatch.from_arrays([some.column(0), *some.columns[4:]], ["list", "key", "code", "scale", "error"])
                    for q in range(0, len(ids), QUERIES):
                        low, high = _bounds(points[0][q : q + QUERIES], centroids, part, 0)
                        own = np.concatenate([best[q : q + QUERIES], high], axis=1)
                        best[q : q + QUERIES] = np.sort(np.partition(own, k - 1, axis=1)[:, :k], axis=1)
                        query, entry = np.nonzero(low <= best[q : q + QUERIES, -1:])
                        held.append((query + q, np.array(some.column(4).to_pylist(), object)[entry], low[query, entry]))
                if sum(len(h[0]) for h in held) > 1 << 18:  # what later bounds exclude goes
                    queries, keys, low = (np.concatenate(x) for x in zip(*held))
                    keep = low <= best[queries, -1]
                    held = [(queries[keep], keys[keep], low[keep])]
        if held:
            yield out()

    return task


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> float:
    """The share of exact pairs (query_id, key) that were found."""
    n, hit = exact.join(found.select("query_id", key).withColumn("hit", F.lit(1)), ["query_id", key], "left").agg(F.count(F.lit(1)), F.sum("hit")).first()
    return (hit or 0) / n if n else 1.0
