"""From hits to context: ranked lookups in the chunks and context strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import collect_joined, empty
from lorespark.operators.dedup import keep_first

MISSING_TEXT = "[Not found]"
FIELDS = ["doi", "title", "author", "journal", "year", "keywords"]
LABELS = ["Title", "Author", "Journal", "Year", "DOI", "Source"]


def meta(name: str, default: str | None = None) -> Column:
    found = F.try_element_at("metadata", F.lit(name))
    return found if default is None else F.coalesce(found, F.lit(default))


def source() -> Column:
    return F.coalesce(meta("source_file"), meta("source"), F.lit("unknown"))


def hits(ranked: DataFrame) -> DataFrame:
    """rank, chunk_id, source and distance of ranked rows (rank, chunk_id, metadata, distance).

    Rows without an id are dropped after ranking, so ranks may have gaps.
    """
    return ranked.filter("chunk_id is not null").select(F.col("rank").cast("int").alias("rank"), "chunk_id", source().alias("source"), "distance")


def flatten(chunks: DataFrame) -> DataFrame:
    """Chunks as nine strings; an empty text falls back to the metadata's."""
    text = F.when(empty("chunk_text"), F.coalesce(meta("text"), F.col("chunk_text"), F.lit(""))).otherwise(F.col("chunk_text"))
    return chunks.select("chunk_id", text.alias("chunk_text"), source().alias("source"), *[meta(f, "").alias(f) for f in FIELDS])


def lookup(found: DataFrame, chunks: DataFrame, order: tuple[str, ...] = ("file", "pos")) -> DataFrame:
    """Texts of the hits in rank order; the first chunk of an id counts, misses and empty texts are dropped."""
    texts = _first(found, chunks, order).select("chunk_id", "chunk_text")
    return found.join(texts, "chunk_id").filter(~empty("chunk_text")).select("rank", "chunk_id", "chunk_text").orderBy("rank")


def _first(found: DataFrame, chunks: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """First chunks of the ids that were hit: the semi-join comes before the dedup, so little is shuffled."""
    ids = found.select("chunk_id").distinct()
    if ids.limit(100_001).count() <= 100_000:
        ids = F.broadcast(ids)
    return keep_first(chunks.join(ids, "chunk_id", "left_semi"), "chunk_id", order)


def context_chunks(found: DataFrame, chunks: DataFrame, order: tuple[str, ...] = ("file", "pos"), missing: str = MISSING_TEXT, unknown: str = "unknown") -> DataFrame:
    """All hits with their nine fields and ``found``; a miss has the given text and source, and '' elsewhere."""
    flat = flatten(_first(found, chunks, order)).withColumn("found", F.lit(True))
    joined = found.select("rank", "chunk_id").join(flat, "chunk_id", "left")
    filled = [F.coalesce("chunk_text", F.lit(missing)).alias("chunk_text"), F.coalesce("source", F.lit(unknown)).alias("source"), *[F.coalesce(f, F.lit("")).alias(f) for f in FIELDS]]
    return joined.select("rank", "chunk_id", *filled, F.coalesce("found", F.lit(False)).alias("found"))


def valid(context: DataFrame) -> DataFrame:
    """Context rows with a text of their own."""
    kept = context.filter(~empty("chunk_text") & (F.col("chunk_text") != MISSING_TEXT))
    return kept.filter("found") if "found" in context.columns else kept


def references() -> Column:
    """``Label: value`` of the fields that are not empty, in fixed order."""
    return F.concat_ws("; ", *[F.when(~empty(label.lower()), F.concat(F.lit(f"{label}: "), F.col(label.lower()))) for label in LABELS])


def blocks(context: DataFrame) -> DataFrame:
    """(number, block): valid rows numbered anew in rank order, as ``Chunk i: text`` over ``[references]``.

    A context is the k rows of one query; numbering it takes one task.
    """
    number = F.row_number().over(Window.orderBy("rank"))
    block = F.format_string("Chunk %d: %s\n[%s]", F.col("number"), F.col("chunk_text"), references())
    return valid(context).withColumn("number", number).select("number", block.alias("block"))


def context_block(context: DataFrame) -> DataFrame:
    """One row: the context of a review, or null if nothing is valid."""
    return blocks(context).agg(collect_joined("block", "number", "\n\n").alias("context"))


def context_plain(texts: DataFrame) -> DataFrame:
    """One row: the texts in rank order, one per line."""
    return texts.agg(collect_joined("chunk_text", "rank", "\n").alias("context"))


def preview(rows: DataFrame, n: int = 5, width: int = 500) -> DataFrame:
    """The first ``n`` by rank, texts shortened: what a screen shows."""
    shown = [F.substring("chunk_text", 1, width).alias("chunk_text") if c == "chunk_text" else F.col(c) for c in rows.columns]
    return rows.select(*shown).orderBy("rank").limit(n)
