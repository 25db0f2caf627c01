"""Stores in folders: chunks, manifest, vectors, projects, cards.

Chunks and vectors are bucketed tables. The manifest is Parquet in versioned
folders: a version is written whole and then named by a small pointer, so a
reader never sees half a table and a table can be derived from its own last
version.
"""

from __future__ import annotations

import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark import schemas
from lorespark.functions.text import blank, stem
from lorespark.sources.bucketed import BucketedTable
from lorespark.sources.files import Files

CHUNK_FILES = "*_chunks.json"
#: The columns of a chunk store.
CHUNK_COLUMNS = [c.split(" ", 1)[0] for c in schemas.CHUNK_ROW.split(", ")]
# What the upload form accepts, fewer than the loaders.
UPLOADS = [".pdf", ".md", ".markdown", ".text", ".txt", ".docx", ".xlsx", ".html"]


class VersionedTable:
    """A table of one schema; missing reads as empty."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.schema, self.files = spark, schema, Files(spark, path)

    def read(self) -> DataFrame:
        if not self.files.exists("CURRENT"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.files.path}/{self.files.read('CURRENT')}")

    def replace(self, rows: DataFrame) -> None:
        """All rows at once; the version before the last one is deleted."""
        version = f"v-{uuid.uuid4().hex}"
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.files.path}/{version}")
        before = self.files.read("CURRENT") if self.files.exists("CURRENT") else None
        self.files.write("CURRENT", version)
        for old in self.files.folders():
            if old.startswith("v-") and old not in (version, before):
                self.files.delete(old)


def read_chunk_files(spark: SparkSession, folder: str, only: DataFrame | None = None) -> DataFrame:
    """All chunk JSON files of a folder, with file name and place; ``only`` (stem) restricts them."""
    if not Files(spark, folder).exists():
        return spark.createDataFrame([], "stem string, pos int, " + schemas.CHUNK)
    files = spark.read.option("pathGlobFilter", CHUNK_FILES).text(folder, wholetext=True).select("value", "_metadata.file_name")
    named = files.select(F.regexp_replace(F.url_decode("file_name"), r"_chunks\.json$", "").alias("stem"), "value")
    if only is not None:
        named = named.join(F.broadcast(only.select("stem").distinct()) if only.limit(100_001).count() <= 100_000 else only.select("stem").distinct(), "stem", "left_semi")
    entries = named.select("stem", F.posexplode(F.from_json("value", f"array<struct<{_fields(schemas.CHUNK)}>>")).alias("pos", "c"))
    return entries.select("stem", "pos", "c.*")


def _fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.split(" ", 1) for x in schema.split(", ")))


def manifest_from_json(text: str, spark: SparkSession) -> DataFrame:
    """A manifest kept as one JSON object by file name."""
    one = spark.createDataFrame([(text,)], "value string")
    entry = "map<string, struct<hash: string, n_chunks: int, last_processed: string, chunk_method: string>>"
    rows = one.select(F.explode(F.from_json("value", entry)).alias("file", "e"))
    return rows.select("file", "e.hash", "e.n_chunks", F.to_timestamp_ntz("e.last_processed").alias("last_processed"), "e.chunk_method")


def chunk_store(spark: SparkSession, folder: str) -> BucketedTable:
    """Chunks, bucketed by their file."""
    return BucketedTable(spark, folder, schemas.CHUNK_ROW, "file")


def replace_chunks(chunks: DataFrame, files: DataFrame, folder: str) -> None:
    """The chunks of ``files`` (file) become ``chunks``; a file that has none now loses its old ones.

    Only buckets that hold one of the files are written anew, and what they
    hold of other files is not shuffled; the buckets grow in number with the store.
    """
    store = chunk_store(chunks.sparkSession, folder)
    store.replace_keys(files, chunks)
    store.grow()


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_store(spark, folder).read().select(*CHUNK_COLUMNS)


def rewrite_without_empty_ids(project: Project) -> int:
    """Drops chunks without an id from the store for good, as before embedding; gives how many files lost some.

    A file none of whose chunks has an id is left as it is.
    """
    chunks = read_chunks(project.spark, project.chunks)
    empty = F.coalesce(blank("chunk_id"), F.lit(True))
    files = chunks.groupBy("file").agg(F.count_if(empty).alias("n"), F.count(F.lit(1)).alias("all")).filter("n > 0 and n < all").select("file").persist(StorageLevel.DISK_ONLY)
    count = files.count()
    if count:
        replace_chunks(chunks.join(files, "file", "left_semi").filter(~empty), files, project.chunks)
    files.unpersist()
    return count


def upload(project: Project, contents: dict[str, bytes]) -> DataFrame:
    """Puts files into the project's raw folder: (file, outcome), which is ``stored``, ``exists`` (kept as it was) or ``unsupported``."""
    raw, outcome = Files(project.spark, project.raw), []
    for name, content in contents.items():
        if "/" in name or not name.lower().endswith(tuple(UPLOADS)):
            outcome.append((name, "unsupported"))
        elif raw.exists(name):
            outcome.append((name, "exists"))
        else:
            raw.write_bytes(name, content)
            outcome.append((name, "stored"))
    return project.spark.createDataFrame(outcome, "file string, outcome string")


def drop_empty_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with an id; used before embedding, so that a file of empty ids embeds nothing."""
    return chunks.filter(~blank("chunk_id"))


class Project:
    """A named folder: raw files, chunks, manifest and vectors."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.path = spark, name, f"{root.rstrip('/')}/{name}"
        self.raw, self.chunks = f"{self.path}/raw", f"{self.path}/chunks"
        self.manifest = VersionedTable(spark, f"{self.path}/manifest", schemas.MANIFEST)
        self.vectors = BucketedTable(spark, f"{self.path}/vectors", schemas.VECTOR, "chunk_id")

    def create(self) -> Project:
        """Makes the folders; those that are there stay."""
        Files(self.spark, self.path).make("raw", "chunks", "manifest", "vectors")
        return self

    def ready(self) -> bool:
        return Files(self.spark, self.chunks).exists("CURRENT") and self.vectors.files.exists("CURRENT")

    def truncate(self) -> None:
        """Forgets chunks and manifest, not vectors."""
        chunk_store(self.spark, self.chunks).clear()
        self.manifest.replace(self.spark.createDataFrame([], schemas.MANIFEST))


def projects(spark: SparkSession, root: str) -> DataFrame:
    """The catalog: folders only."""
    return spark.createDataFrame([(n,) for n in Files(spark, root).folders()], "project string")


def legacy_metadata(text: str, spark: SparkSession) -> DataFrame:
    """(source, source_file) entries, repeats kept."""
    one = spark.createDataFrame([(json.dumps(json.loads(text)),)], "value string")
    return one.select(F.inline(F.from_json("value", "array<struct<source: string, source_file: string>>")))


def write_texts(rows: DataFrame, folder: str) -> None:
    """One text per stem (``file``, ``text``), partitioned by stem."""
    rows.select(stem("file").alias("stem"), "text").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("stem").text(folder)
