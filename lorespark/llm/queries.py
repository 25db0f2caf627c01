"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import exact_dedup, resample, topk
from lorespark.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.llm.html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.llm.fingerprint import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.llm.substring import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.llm.sp_nbest import segmentations

    return segmentations(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.llm.langid import evaluate

    return evaluate(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.llm.token_rollup import corpus_totals

    return corpus_totals(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.llm.quality_kn import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.llm.align import align

    return align(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_simhash": op2_simhash, "op3_html": op3_html, "op4_fingerprint": op4_fingerprint, "op5_substring": op5_substring, "op6_sentencepiece": op6_sentencepiece, "op7_langid": op7_langid, "op8_token_counts": op8_token_counts, "op9_quality": op9_quality, "op10_packing": op10_packing, "op11_align": op11_align, "op12_resample": op12_resample, "op13_topk": op13_topk}

ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": exact_dedup.ORACLE_SQL, "op12_resample": resample.ORACLE_SQL, "op13_topk": topk.ORACLE_SQL}
