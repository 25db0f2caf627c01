"""Incremental ingest: which files changed, and the manifest's upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import collect_joined
from lorespark.sources.loaders import supported


def content_hash(content: Column | str) -> Column:
    return F.md5(F.col(content) if isinstance(content, str) else content)


def diff(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """``files`` (file, ext, hash) with ``state``: unsupported, unchanged, or changed (new ones too)."""
    before = manifest.select(F.col("file").alias("__file"), F.col("hash").alias("prev_hash"))
    joined = files.join(before, files.file == F.col("__file"), "left").drop("__file")
    same = F.lit(not force) & F.col("hash").eqNullSafe(F.col("prev_hash")) & F.col("prev_hash").isNotNull()
    return joined.withColumn("state", F.when(~supported("ext"), "unsupported").when(same, "unchanged").otherwise("changed"))


def counters(outcome: DataFrame) -> DataFrame:
    """total, processed, skipped and failed over ``outcome`` (state, failed)."""
    failed = (F.col("state") == "changed") & F.coalesce(F.col("failed"), F.lit(False))
    return outcome.agg(
        F.count(F.lit(1)).alias("total"), F.count_if((F.col("state") == "changed") & ~failed).alias("processed"),
        F.count_if(F.col("state") != "changed").alias("skipped"), F.count_if(failed).alias("failed"),
    )


def upsert(manifest: DataFrame, entries: DataFrame, key: str = "file") -> DataFrame:
    """``entries`` replace those of the same key; all others stay, also of files that are gone."""
    return manifest.join(entries.select(key), key, "left_anti").unionByName(entries)


def entries(changed: DataFrame, chunks: DataFrame, method: str, now: Column | None = None) -> DataFrame:
    """Manifest entries of the files that were processed; a file without chunks has 0."""
    counts = chunks.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
    stamp = (F.current_timestamp() if now is None else now).cast("timestamp_ntz")
    return changed.join(counts, "file", "left").select("file", "hash", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), stamp.alias("last_processed"), F.lit(method).alias("chunk_method"))


def view(manifest: DataFrame) -> DataFrame:
    """The manifest as shown: missing values are '-'."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    return manifest.select("file", shown("n_chunks"), shown("chunk_method"), shown("hash"))


def without_chunks(manifest: DataFrame) -> DataFrame:
    """Health check: files whose entry has no chunks."""
    return manifest.filter(F.coalesce("n_chunks", F.lit(0)) == 0).select("file")


def joined_names(rows: DataFrame, name: str = "file") -> DataFrame:
    """All names in one line, in order; for short lists such as warnings."""
    return rows.agg(collect_joined(name, name, ", ").alias("names"))


def new_uploads(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    return uploads.join(existing.select("file").distinct(), "file", "left_anti")


def repeated_uploads(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    return uploads.join(existing.select("file").distinct(), "file", "left_semi")
