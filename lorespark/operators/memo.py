"""A memo of model calls: each distinct request is sent once, and its answer kept.

A request's address is the digest of model, messages and parameters. Requests
are made distinct and anti-joined with the memo before any call; what is new is
asked once and added; then every row joins its answer. The memo is a table
bucketed by digest, so neither join moves it. Failed calls are kept with their
error and asked again the next time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.providers import RESULT, Chat, EchoChat, ask
from lorespark.sources.bucketed import BucketedTable

MEMO = f"digest string, model string, answer {RESULT}, seconds double, asked_at timestamp"


def memo_table(spark: SparkSession, folder: str) -> BucketedTable:
    return BucketedTable(spark, folder, MEMO, "digest")


def digest(asked: Column | str, model: str, max_tokens: int, temperature: float) -> Column:
    """A request's address; null where nothing is asked."""
    messages = F.col(asked) if isinstance(asked, str) else asked
    whole = F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(float(temperature)).alias("temperature"))
    return F.when(messages.isNotNull(), F.sha2(F.to_json(whole), 256))


def ask_once(rows: DataFrame, asked: str, folder: str, make: Callable[[], Chat] = EchoChat, model: str = "gpt-4o-mini", max_tokens: int = 1280, temperature: float = 0.5) -> DataFrame:
    """Like ``ask``, with the memo in ``folder``: ``rows`` with ``answer`` and ``seconds`` (of the call that was made, whenever that was)."""
    memo = memo_table(rows.sparkSession, folder)
    own = digest(asked, model, max_tokens, temperature)
    requests = rows.select(own.alias("digest"), F.col(asked).alias("asked")).filter("digest is not null").dropDuplicates(["digest"])
    new = requests.join(memo.read().filter("answer.ok").select("digest"), "digest", "left_anti")
    answered = ask(new, "asked", make, model, max_tokens, temperature)
    memo.upsert(answered.select("digest", F.lit(model).alias("model"), "answer", "seconds", F.current_timestamp().alias("asked_at")))
    memo.grow()
    told = memo.read().select(F.col("digest").alias("__digest"), F.col("answer").alias("__answer"), F.col("seconds").alias("__seconds"))
    nothing = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("tokens"), F.lit("nothing was asked").alias("error"))
    joined = rows.withColumn("__own", own).join(told, F.col("__own") == F.col("__digest"), "left")
    return joined.select(*rows.columns, F.coalesce("__answer", nothing).cast(RESULT).alias("answer"), F.coalesce("__seconds", F.lit(0.0)).alias("seconds"))
