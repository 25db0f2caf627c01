"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers are broadcast up to this many rows (about 16 bytes each);
#: larger sets are joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: What a batch of rows to a Python worker may hold.
ARROW_SETTING, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local master gets a temporary one."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not conf and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(conf or tempfile.mkdtemp(prefix="lorespark-"))
    return conf or jsc.getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage: shuffles, broadcasts and cached plans that nothing refers to any more go at
    once, not only when its heap is full."""
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _small(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast if counting them shows that they are few."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def join_ids(df: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Semi or anti join of wide rows with a set of keys, null-safe.

    ``ids`` should be materialised. It is counted: up to ``BROADCAST_ROWS`` keys
    are broadcast so that the wide rows stay where they are, beyond that both
    sides are shuffled.
    """
    ids = _small(ids.select(F.col(key).alias("__key")).distinct())
    return df.join(ids, df[key].eqNullSafe(ids["__key"]), how)


#: A row's identity where doc_ids may be null or repeat: the id and 128 bits of the text.
ROW = ["__row_id", "__row_a", "__row_b"]


def row_key(text: str = "text", of: DataFrame | None = None, names: list[str] = ROW) -> list[Column]:
    """The columns ``ROW`` of a row; rows that share them have one id and one text (null is not empty). ``of``: the frame that they are taken from."""
    column = F.col if of is None else of.__getitem__
    t = column(text).cast("string")
    return [x.alias(n) for x, n in zip((column("doc_id").cast("long"), F.xxhash64(t), F.xxhash64(F.lit(1), t)), names)]


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever they are called and whatever it is joined to."""
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Like ``names``, none of them a column of ``df``."""
    taken, mark = {c.lower() for c in df.columns}, ""
    while any(f"{n}{mark}".lower() in taken for n in names):
        mark += "_"
    return [f"{n}{mark}" for n in names]


def same_row(docs: DataFrame, keys: DataFrame) -> list[Column]:
    """The condition under which a row of ``docs`` has the key of a row of ``keys`` (columns ``ROW``, each with ``_of``)."""
    return [x.eqNullSafe(keys[f"{c}_of"]) for x, c in zip(row_key(of=docs), ROW)]


def join_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with a materialised set of row keys; see ``join_ids``."""
    keys = _small(rows.select(*[F.col(c).alias(f"{c}_of") for c in ROW]).distinct())
    return docs.join(keys, same_row(docs, keys), how)


def drop_rows(docs: DataFrame, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows of the keys ``dropped``; of the keys ``repeated`` one row each stays. Both materialised."""
    left = join_rows(docs, dropped, "left_anti")
    if repeated.isEmpty():
        return left
    names = unused(docs, *ROW)
    keyed = join_rows(left, repeated, "left_semi").select("*", *row_key(names=names))
    return join_rows(left, repeated, "left_anti").unionByName(keyed.dropDuplicates(names).drop(*names))


def _give_back() -> None:
    """Freed pages of a Python worker go back to the system."""
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own counsel
        ctypes.CDLL(None).malloc_trim(0)


def lean(task):
    """A ``mapInArrow`` function that is sparing with memory.

    Batches are held to ``ARROW_BYTES`` by the session's setting, if that is
    larger; they come from the system's allocator, and freed pages go back to
    the system when the task ends.
    """
    session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if int(re.sub(r"\D", "", session.conf.get(ARROW_SETTING)) or 0) > ARROW_BYTES:
        session.conf.set(ARROW_SETTING, f"{ARROW_BYTES}b")

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from task(batches)
        finally:
            _give_back()

    return run


def lean_groups(task):
    """The same for a function of ``applyInPandas``, of one or two frames."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return task(frame)
        finally:
            _give_back()

    def two(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return task(left, right)
        finally:
            _give_back()

    return two if task.__code__.co_argcount == 2 else one


def single_thread() -> None:
    """Tokenizer libraries must not start a thread for every core in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def tokenizer_file(name: str) -> str:
    """A path is taken as it is; a bare file name is one of the installed public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
