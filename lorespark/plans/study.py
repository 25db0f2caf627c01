"""Review summaries and study cards from retrieved chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.templates import QUERY_REWRITE, STUDY_REWRITE, card_template, review_template
from lorespark.functions.text import empty, fill, strip
from lorespark.operators import retrieval
from lorespark.operators.memo import ask_once
from lorespark.operators.vectors import distance_stats, top_k
from lorespark.providers import EchoChat, HashEmbedder, ask, messages

SYSTEM = "You are a careful research assistant. The request stands between marks of five hash signs."


def rewrite(requests: DataFrame, query: str = "user_query", template: str = QUERY_REWRITE, make: Callable = EchoChat, model: str | None = None, optimize: bool = True, memo: str | None = None) -> DataFrame:
    """``requests`` with ``std_query``: rewritten by the model, stripped.

    Null and empty queries give ''; with ``optimize`` off, or when the call
    fails, the query stays as it was. With a ``memo`` folder each distinct
    query is asked once.
    """
    own = F.coalesce(F.col(query), F.lit(""))
    if not optimize:
        return requests.withColumn("std_query", own)
    asked = requests.withColumn("__asked", F.when(own != "", messages(SYSTEM, fill(template, {"user_query": own}))))
    how = {"make": make, "model": model or "gpt-4o-mini", "max_tokens": 300}
    answered = ask_once(asked, "__asked", memo, **how) if memo else ask(asked, "__asked", **how)
    better = F.when(F.col("answer.ok") & ~empty(strip("answer.text")), strip("answer.text")).otherwise(own)
    return answered.withColumn("std_query", better).drop("__asked", "answer", "seconds")


def study_rewrite(requests: DataFrame, **how) -> DataFrame:
    return rewrite(requests, template=STUDY_REWRITE, **how)


def search(vectors: DataFrame, query: str, k: int, embedder: Callable = HashEmbedder, max_distance: float | None = None, metric: str = "l2") -> tuple[DataFrame, DataFrame]:
    """(hits, distance statistics over all k) of a text query, embedded once on the driver."""
    ranked = top_k(vectors, embedder()([query])[0], k, metric, max_distance=max_distance)
    return retrieval.hits(ranked), distance_stats(ranked)


def review_prompt(context: Column, query: Column, template: str | None = None, lang: str = "en") -> Column:
    return fill(template or review_template(lang), {"context": context, "query": query})


def summarize(context: DataFrame, query: str, template: str | None = None, make: Callable = EchoChat, model: str = "gpt-4o-mini", max_tokens: int = 12800, temperature: float = 0.8, lang: str = "en") -> DataFrame:
    """One row (summary, processing_time, tokens); all null without valid context or when the call fails."""
    one = retrieval.context_block(context).filter("context is not null")
    asked = one.select(messages(SYSTEM, review_prompt(F.col("context"), F.lit(query), template, lang)).alias("asked"))
    got = ask(asked, "asked", make, model, max_tokens, temperature).filter("answer.ok")
    row = got.select(F.col("answer.text").alias("summary"), F.format_string("%.2f", "seconds").alias("processing_time"), F.col("answer.tokens").alias("tokens"))
    empty_row = context.sparkSession.range(1).select(F.lit("x").alias("__k"))
    return empty_row.join(row.withColumn("__k", F.lit("x")), "__k", "left").drop("__k")


def card_prompt(context: Column, query: Column | str, card_type: str = "qa", difficulty: str = "intermediate", detail_level: str = "moderate", num_cards: int = 5, lang: str = "en") -> Column:
    values = {"num_cards": str(num_cards), "card_type": card_type, "difficulty": difficulty, "detail_level": detail_level, "query": query, "context": context}
    return fill(card_template(lang), values)


def make_cards(spark: SparkSession, query: str, vectors: DataFrame, chunks: DataFrame, make: Callable = EchoChat, embedder: Callable = HashEmbedder, k: int = 10, optimize: bool = True, model: str = "gpt-4o-mini", **card) -> DataFrame:
    """One row with ``answer``: the cards' CSV text about ``query``. Raises without a query, and if nothing relevant is found."""
    if not (query or "").strip():
        raise ValueError("a query is needed")
    std = study_rewrite(spark.createDataFrame([(query,)], "user_query string"), make=make, optimize=optimize).first().std_query
    found, _ = search(vectors, std, k, embedder)
    found = spark.createDataFrame(found.collect(), found.schema)  # k rows, searched for once
    context = retrieval.context_plain(retrieval.lookup(found, chunks)).first().context
    if not context:
        raise ValueError("no relevant text was found")
    one = spark.createDataFrame([(context, std)], "context string, query string")
    asked = one.select(messages(SYSTEM, card_prompt(F.col("context"), F.col("query"), **card)).alias("asked"))
    return ask(asked, "asked", make, model).select("answer")
