"""Tables that joins and upserts meet where they lie: Spark's bucketed tables in a folder.

Rows are bucketed and sorted by a key. A scan of the table is partitioned by
that key, so a join, an upsert or a count by key shuffles only the other side.
An upsert reads and rewrites the buckets that hold one of its keys, and no
other; what stays of a bucket is one file, what is new another, and the next
rewrite makes them one. When buckets grow past a size their number is doubled,
each bucket splitting into two where it lies.

A rewrite is staged beside the table and listed in a journal before files are
moved; a journal that a lost driver has left is carried out by whoever opens
the table next. One writer at a time; a reader that planned its scan before a
commit has to plan it again. A key's rows are in one bucket, whatever their
number; a null key is no key: its rows are added and never replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.sources.files import Files

#: Buckets of a new table, and the mean bytes of a bucket past which they are doubled.
BUCKETS = 16
BUCKET_BYTES = 256 << 20
_FILE = re.compile(r"_(\d{5,})(?:\.c\d+)?\.[\w.]*parquet$")


class BucketedTable:
    """A table of one schema (DDL) in ``folder``, bucketed by ``key``; missing reads as empty."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.schema, self.key, self.first = spark, schema, key, buckets
        self.files = Files(spark, folder)

    # --- where it is ---

    def _state(self) -> dict | None:
        return json.loads(self.files.read("CURRENT")) if self.files.exists("CURRENT") else None

    def _recover(self) -> None:
        """Carries out a journal that was written but not finished; every step may have been done before."""
        if not self.files.exists("JOURNAL"):
            return
        journal = json.loads(self.files.read("JOURNAL"))
        for name in journal["add"]:
            staged = f"{journal['staging']}/{name}"
            if self.files.exists(staged):
                self.files.move(staged, f"{journal['table']}/{name.split('/')[-1]}")
        for name in journal["drop"]:
            self.files.delete(f"{journal['table']}/{name}")
        self.files.delete("JOURNAL")
        self.files.delete(journal["staging"])

    @property
    def buckets(self) -> int:
        state = self._state()
        return state["buckets"] if state else self.first

    def bucket(self, key: Column | str | None = None, buckets: int | None = None) -> Column:
        """A key's bucket, as Spark's writer deals it."""
        return F.pmod(F.hash(key if key is not None else self.key), F.lit(buckets or self.buckets))

    def _bucket_files(self, table: str) -> dict[int, list[str]]:
        found: dict[int, list[str]] = {}
        for name in self.files.names(table):
            if m := _FILE.search(name):
                found.setdefault(int(m[1]), []).append(name)
        return found

    def _registered(self, table: str, buckets: int) -> DataFrame:
        """The bucketed table, known to the session's catalog by a name that follows from its place."""
        where = f"{self.files.path}/{table}"
        name = f"lorespark_{hashlib.md5(f'{where}:{buckets}'.encode()).hexdigest()}"
        quoted = where.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({self.schema}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {buckets} BUCKETS LOCATION '{quoted}'")
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def read(self) -> DataFrame:
        self._recover()
        state = self._state()
        if state is None:
            return self.spark.createDataFrame([], self.schema)
        return self._registered(state["table"], state["buckets"])

    # --- writing ---

    def _staged(self, rows: DataFrame, where: str, buckets: int) -> list[str]:
        """Writes bucket files into a folder of the table's; gives their names."""
        name = f"lorespark_stage_{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        rows.select(*columns).write.format("parquet").option("compression", "zstd").bucketBy(buckets, self.key).sortBy(self.key).option("path", f"{self.files.path}/{where}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay
        return [n for n in self.files.names(where) if _FILE.search(n)]

    def replace_keys(self, keys: DataFrame, rows: DataFrame) -> None:
        """The rows of ``keys`` (a column named as the key) and of ``rows``' own keys become ``rows``."""
        self._recover()
        state = self._state()
        if state is None:
            table = f"g-{uuid.uuid4().hex}"
            self._staged(rows.repartition(self.first, self.key), table, self.first)
            self.files.write("CURRENT", json.dumps({"table": table, "buckets": self.first}))
            return
        table, n, staging = state["table"], state["buckets"], f"s-{uuid.uuid4().hex}"
        # written first, so that they are made once and their keys can be read off
        added = [f"new/{x}" for x in self._staged(rows.repartition(n, self.key), f"{staging}/new", n)]
        fresh = self.spark.read.schema(self.schema).parquet(f"{self.files.path}/{staging}/new")
        replaced = keys.select(self.key).unionByName(fresh.select(self.key)).filter(F.col(self.key).isNotNull()).distinct()
        touched = {r[0] for r in replaced.select(self.bucket(buckets=n)).distinct().collect()}  # a number per bucket at most
        old = [name for b, names in self._bucket_files(table).items() if b in touched for name in names]
        if old:
            added += [f"kept/{x}" for x in self._staged(self.without(replaced, old), f"{staging}/kept", n)]
        self.files.write("JOURNAL", json.dumps({"table": table, "staging": staging, "add": added, "drop": old}))
        self._recover()

    def without(self, keys: DataFrame, files: list[str]) -> DataFrame:
        """The rows in some of the table's files whose key is none of ``keys``; files are pruned by name and stay where they lie."""
        state = self._state()
        lying = self._registered(state["table"], state["buckets"]).filter(F.col("_metadata.file_name").isin(files))
        return lying.join(keys.select(F.col(self.key).alias("__key")), F.col(self.key) == F.col("__key"), "left_anti")

    def upsert(self, rows: DataFrame) -> None:
        """Inserts or replaces by key; keys that ``rows`` lacks stay."""
        self.replace_keys(self.spark.createDataFrame([], self.schema), rows)

    def delete(self, keys: DataFrame) -> None:
        self.replace_keys(keys, self.spark.createDataFrame([], self.schema))

    def replace(self, rows: DataFrame) -> None:
        """All rows at once, as a new generation."""
        self._recover()
        state, table, n = self._state(), f"g-{uuid.uuid4().hex}", self.buckets
        self._staged(rows.repartition(n, self.key), table, n)
        self.files.write("CURRENT", json.dumps({"table": table, "buckets": n}))
        self._forget(keep={table, state["table"] if state else table})

    def clear(self) -> None:
        for name in [*self.files.folders(), "CURRENT", "JOURNAL"]:
            self.files.delete(name)

    def grow(self, bucket_bytes: int = BUCKET_BYTES) -> int:
        """Doubles the buckets until they are small enough on average; gives their number. Nothing is shuffled: a bucket's rows go to two."""
        self._recover()
        while (state := self._state()) is not None and self.files.size(state["table"]) > bucket_bytes * state["buckets"]:
            table, n = f"g-{uuid.uuid4().hex}", 2 * state["buckets"]
            self._staged(self._registered(state["table"], state["buckets"]), table, n)
            self.files.write("CURRENT", json.dumps({"table": table, "buckets": n}))
            self._forget(keep={table, state["table"]})
        return self.buckets

    def _forget(self, keep: set[str]) -> None:
        for name in self.files.folders():
            if name[:2] in ("g-", "s-") and name not in keep:
                self.files.delete(name)
