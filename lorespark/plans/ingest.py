"""Ingest: files to chunks to vectors, only what changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lorespark import schemas
from lorespark.functions.clean import clean_stages
from lorespark.functions.text import collect_joined, suffix
from lorespark.operators import chunking, dedup, manifest
from lorespark.operators.chunking import Method
from lorespark.providers import HashEmbedder, embed
from lorespark.sources import loaders, stores


def process(project: stores.Project, method: Method = Method.SENTENCE, size: int = 400, overlap: int = 50, force: bool = False, compat_ids: bool = False, now: Column | None = None, files: DataFrame | None = None) -> DataFrame:
    """Chunks the project's changed files and gives the run's counters.

    Hashes decide what is loaded; a file that fails to load keeps its old
    chunks and entry and is counted. Chunks of each processed file are replaced,
    then the manifest is written as one new version. Files are read once: their
    pages are staged in the project's folder, and the counters are observed on
    that write.
    """
    if force:
        project.truncate()
    spark, staging = project.spark, f"staging/{uuid.uuid4().hex}"
    where, seen = f"{project.path}/{staging}", Observation()
    found = loaders.scan(spark, project.raw) if files is None else files
    hashed = found.withColumn("hash", manifest.content_hash("content"))
    state = manifest.diff(hashed, project.manifest.read(), force).observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") != "changed").alias("skipped"))
    try:
        loaders.load(state.filter("state = 'changed'"), keep=("hash",)).write.option("compression", "zstd").parquet(f"{where}/pages")
        pages = spark.read.schema(f"{schemas.PAGE}, hash string").parquet(f"{where}/pages")
        bad = pages.filter("error is not null").select("file").distinct()
        cleaned = pages.filter("error is null").withColumn("text", chunking.preclean("text", suffix("file")))
        chunking.chunk(cleaned, method, size, overlap, compat_ids).write.option("compression", "zstd").parquet(f"{where}/chunks")
        chunks = spark.read.schema(schemas.CHUNK_ROW).parquet(f"{where}/chunks")
        done = pages.join(bad, "file", "left_anti").select("file", "hash").distinct()
        stores.replace_chunks(chunks, done.select("file"), project.chunks)
        project.manifest.replace(manifest.upsert(project.manifest.read(), manifest.entries(done, chunks, method.value, now)))
        failed, counted = bad.count(), seen.get
    finally:
        stores.Files(spark, project.path).delete(staging)
    report = (counted["total"], counted["total"] - counted["skipped"] - failed, counted["skipped"], failed)
    return spark.createDataFrame([report], "total long, processed long, skipped long, failed long")


def embed_chunks(project: stores.Project, make: Callable = HashEmbedder, only: DataFrame | None = None, prune: bool = False) -> None:
    """Embeds the first chunk of every id, of all files or of ``only`` (stem), and upserts the vectors."""
    chunks = stores.drop_empty_ids(stores.read_chunks(project.spark, project.chunks))
    if only is not None:
        chunks = chunks.join(only.select("stem").distinct(), "stem", "left_semi")
    first = dedup.keep_first(chunks, "chunk_id", ("file", "doc_ix", "pos")).select("chunk_id", "chunk_text", "metadata")
    new = embed(first, "chunk_text", make).filter("vector is not null").select("chunk_id", "vector", "chunk_text", "metadata")
    project.vectors.upsert(new)
    if prune:
        left = stores.drop_empty_ids(stores.read_chunks(project.spark, project.chunks)).select("chunk_id").distinct()
        project.vectors.delete(project.vectors.read().select("chunk_id").join(left, "chunk_id", "left_anti"))
    project.vectors.grow()


def extract_texts(spark, folder: str, out: str) -> DataFrame:
    """Deep cleaning: each file's pages joined in order, cleaned, and written as one text per stem; gives (file, error) of failures, in the order of their names."""
    pages = loaders.load(loaders.scan(spark, folder).filter(loaders.supported("ext")))
    good = pages.filter("error is null").groupBy("file").agg(collect_joined("text", "doc_ix", "\n").alias("text"))
    stores.write_texts(clean_stages(good).select("file", F.col("cleaned").alias("text")), out)
    return pages.filter("error is not null").select("file", "error").orderBy("file")
