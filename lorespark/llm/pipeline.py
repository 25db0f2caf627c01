"""Stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps with
all their columns; the last gives packed pieces. ``run`` writes each stage's
rows and reads them back for the next one. A document that a stage drops is
gone for all later ones; substring dedup changes texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm.common import shared_dir, table, tidy


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lorespark.llm.quality_kn import keep_good

    tidy(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lorespark.llm.exact_dedup import keep_first

    tidy(spark)
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lorespark.llm.simhash import keep_one

    tidy(spark)
    return keep_one(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lorespark.llm.substring import remove_repeats

    tidy(spark)
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lorespark.llm.packing import pack

    tidy(spark)
    return pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("substring dedup", substring), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs, where = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
    return docs
