"""The inverted-file index against exact search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import ivf, vectors

SCHEMA = "vec_id long, embedding array<float>"


def pairs(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.distance, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")


@pytest.fixture(scope="module")
def asked(stored):
    return stored.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@pytest.fixture(scope="module")
def index(spark, stored, tmp_path_factory):
    return ivf.Index(spark, str(tmp_path_factory.mktemp("ivf")), "vec_id", "embedding").build(stored)


def test_all_lists_are_exact_and_calibrated_probes_reach_the_target(spark, stored, asked, index):
    exact = vectors.knn_join(stored, asked, 10).cache()
    assert pairs(index.knn_join(stored, asked, 10)) == pairs(exact)
    other = stored.filter("vec_id % 100 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    probes = index.calibrate(stored, other, 10, target=0.97)
    assert probes == index.probes() < len(index._current()[1])
    found = ivf.recall(index.knn_join(stored, asked, 10), exact)
    assert found >= 0.95 > ivf.recall(index.knn_join(stored, asked, 10, probes=1), exact)


def test_files_read_follow_the_probes(index, asked, stored):
    lists = len(index._current()[1])
    point = list(asked.orderBy("query_id").first().query)
    for probes in (1, 5, lists):
        near = ivf._nearest_lists(ivf.np.array([point]), index._current()[1], probes)[0].tolist()
        scan = index.entries().filter(F.col("list").isin(near))
        assert "PartitionFilters: [list" in scan._jdf.queryExecution().executedPlan().toString().replace("isnotnull(list", "list").replace("PartitionFilters: [(", "PartitionFilters: [")
        assert scan.select(F.regexp_extract("_metadata.file_path", r"list=(\d+)", 1)).distinct().count() == probes
    hits = index.search(stored, point, 10, probes=lists).orderBy("rank").collect()
    want = vectors.top_k(stored, point, 10, key="vec_id", vector="embedding").orderBy("rank").collect()
    assert [(r.vec_id, round(r.distance, 9)) for r in hits] == [(r.vec_id, round(r.distance, 9)) for r in want]


def test_upserts_and_deletions_are_seen(spark, tmp_path):
    rng = random.Random(3)
    point = lambda at: [rng.gauss(x, 0.1) for x in at]
    corners = [(0.0, 0.0, 5.0), (5.0, 0.0, 0.0), (0.0, 5.0, 0.0), (-5.0, 0.0, 0.0)]
    table = {i: point(corners[i % 4]) for i in range(200)}
    rows = lambda: spark.createDataFrame(list(table.items()), SCHEMA)
    index = ivf.Index(spark, str(tmp_path), "vec_id", "embedding").build(rows(), lists=4)
    moved = {i: point(corners[(i + 1) % 4]) for i in range(0, 40)} | {500: [0.0, 5.0, 0.0]}
    table.update(moved)
    index.upsert(spark.createDataFrame(list(moved.items()), SCHEMA))
    del table[3]
    index.delete(spark.createDataFrame([(3,)], "vec_id long"))
    queries = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(corners)], "query_id long, query array<double>")
    assert pairs(index.knn_join(rows(), queries, 7)) == pairs(vectors.knn_join(rows(), queries, 7))
    near = {r.vec_id for r in index.search(rows(), [0.0, 5.0, 0.0], 30, probes=1).collect()}
    assert near == {r.vec_id for r in vectors.top_k(rows(), [0.0, 5.0, 0.0], 30, key="vec_id", vector="embedding").collect()} and 500 in near
    index.build(rows(), lists=2)
    assert index.entries().count() == len(table)


def test_odd_tables(spark, tmp_path):
    index = ivf.Index(spark, str(tmp_path / "a"), "vec_id", "embedding")
    none = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<float>")
    assert not index.exists()
    assert index.build(none).knn_join(none, queries, 3).count() == 0 and index.search(none, [0.0], 2).count() == 0
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (None, [1.0, 0.0]), (4, [1.0]), (5, [1.0, 0.0]), (6, [0.0, 0.0])]
    odd = spark.createDataFrame(rows, SCHEMA)
    index.build(odd)
    assert [r[:2] for r in ((x.vec_id, x["rank"]) for x in index.knn_join(odd, queries, 9).orderBy("rank").collect())] == [(1, 1), (5, 2), (6, 3)]
