"""Bucketed tables: what is read, rewritten and shuffled."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lorespark.sources.bucketed import BucketedTable

SCHEMA = "k string, v long, m map<string,string>"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, {"a": str(v)}) for k, v in rows], SCHEMA)


def held(table):
    return sorted(((r.k, r.v) for r in table.read().collect()), key=repr)


def data_files(path):
    return {f for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    # a blank, a quote and other scripts in the path
    return BucketedTable(spark, str(tmp_path / "it's a täble"), SCHEMA, "k", buckets=4)


def test_upserts_and_deletions_against_a_dict(spark, table):
    rng, want = random.Random(1), {}
    assert held(table) == []
    for step in range(6):
        new = {f"k{rng.randrange(60)}": rng.randrange(1000) for _ in range(25)}
        want |= new
        table.upsert(frame(spark, new.items()))
        if step % 2:
            gone = [f"k{rng.randrange(60)}" for _ in range(10)]
            for k in gone:
                want.pop(k, None)
            table.delete(spark.createDataFrame([(k,) for k in gone], "k string"))
        assert held(table) == sorted(want.items())
    assert table.read().filter("m['a'] = cast(v as string)").count() == len(want)
    before = held(table)
    assert table.grow(bucket_bytes=1 << 30) == 4
    assert table.grow(bucket_bytes=700) > 4 and held(table) == before
    assert table.read().join(frame(spark, [("k1", 0)]).select("k"), "k", "left_semi").count() == sum(k == "k1" for k, _ in before)


def test_keys_with_many_rows_nulls_and_emptied_keys(spark, table):
    table.replace_keys(frame(spark, []), frame(spark, [("a", 1), ("a", 2), ("b", 3), (None, 4)]))
    table.replace_keys(spark.createDataFrame([("b",), ("zz",)], "k string"), frame(spark, [("a", 5), (None, 6)]))
    assert held(table) == sorted([("a", 5), (None, 4), (None, 6)], key=repr)
    table.replace(frame(spark, [("c", 1)]))
    assert held(table) == [("c", 1)]
    table.clear()
    assert held(table) == []


def test_one_key_rewrites_one_bucket(spark, table):
    table.upsert(frame(spark, [(f"k{i}", i) for i in range(400)]))
    before = data_files(table.files.path)
    assert len(before) == 4
    table.upsert(frame(spark, [("k7", -1)]))
    after = data_files(table.files.path)
    assert len(before - after) == 1 and len(after - before) == 2  # what stayed of the bucket, and what is new
    table.upsert(frame(spark, [("k7", -2)]))
    assert len(data_files(table.files.path)) == 5 and dict(held(table))["k7"] == -2
    mine = [r[0] for r in table.read().filter("k = 'k7'").select(table.bucket()).collect()]
    assert all(f"_{mine[0]:05d}" in f for f in after - before)


def nodes_above_the_store(plan: str) -> str:
    """The part of a plan that stands on the line of the bucketed scan."""
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
    depth, above = len(lines[at]) - len(lines[at].lstrip(" :|+-")), []
    for x in reversed(lines[:at]):
        d = len(x) - len(x.lstrip(" :|+-"))
        if d < depth:
            depth = d
            above.append(x)
    return "\n".join(above)


def test_the_stored_side_is_not_shuffled(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table.upsert(frame(spark, [(f"k{i}", i) for i in range(100)]))
        new = frame(spark, [("k1", 1), ("k2", 2)])
        name = next(iter(table._bucket_files(json.loads(table.files.read("CURRENT"))["table"]).values()))
        for df in (table.read().join(new.select("k"), "k"), table.read().join(new.select("k"), "k", "left_anti"), table.read().groupBy("k").agg(F.count("v")), table.without(new.select("k"), name)):
            above = nodes_above_the_store(df._jdf.queryExecution().executedPlan().toString())
            assert "Exchange" not in above, above
        pruned = table.without(new.select("k"), name)
        assert 0 < pruned.count() < 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("done", [0, 1, 2, 3])
def test_a_commit_that_was_cut_off_is_carried_out(spark, table, monkeypatch, done):
    table.upsert(frame(spark, [(f"k{i}", i) for i in range(40)]))
    steps = []

    class Cut(Exception):
        pass

    move, delete = table.files.move, table.files.delete

    def count(f):
        def step(*a):
            if len(steps) >= done:
                raise Cut
            steps.append(a)
            return f(*a)

        return step

    monkeypatch.setattr(table.files, "move", count(move))
    monkeypatch.setattr(table.files, "delete", count(delete))
    with pytest.raises(Cut):
        table.upsert(frame(spark, [("k3", -3), ("new", 1)]))
    again = BucketedTable(spark, table.files.path, SCHEMA, "k")
    assert dict(held(again)) == {f"k{i}": i for i in range(40)} | {"k3": -3, "new": 1}
    assert len(held(again)) == 41 and not again.files.exists("JOURNAL")


def test_files_are_written_small(spark, tmp_path):
    """Texts take less room with zstd than by the session's codec."""
    import glob

    import pyarrow.parquet as pq

    table = BucketedTable(spark, str(tmp_path / "t"), "k string, v string", "k")
    table.upsert(spark.range(100).selectExpr("cast(id as string) as k", "repeat('text ', 50) as v"))
    found = glob.glob(str(tmp_path / "t/**/*.parquet"), recursive=True)
    assert found and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in found} == {"ZSTD"}
