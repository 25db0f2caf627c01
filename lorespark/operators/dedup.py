"""Keep-first by key and reports of repeated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = ("file", "pos")) -> DataFrame:
    """The first row of each key in the given order; '' and null are keys too.

    ``min_by`` aggregates before it shuffles, so one key's many rows are one
    row per task.
    """
    rest = [c for c in rows.columns if c != key]
    place = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order])
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), place).alias("__row")).select(key, "__row.*").select(*rows.columns)


def repeated_keys(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
