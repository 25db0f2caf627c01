"""Incremental ingest of a landing folder with Structured Streaming.

What is known of each file, its hash and number of chunks, is keyed state of
the stream. A file's pages arrive in one batch; where their hash is the state's
they go no further, else they are chunked and the file's chunks replaced, and
the state follows. So a batch costs what arrived, not what the project holds,
and one that is run again after a failure starts from the same state and ends
in the same chunks. A file that fails to load keeps its chunks and its state.

Files that an earlier batch run took up are known from the manifest.
``manifest_of`` is the manifest with the stream's state; ``settle`` writes it
down once the stream has stopped, for batch runs to come. Empty files, which
the file source passes over, are left to those.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespark.functions.text import suffix
from lorespark.operators import chunking, manifest
from lorespark.operators.chunking import Method
from lorespark.sources import loaders, stores
from lorespark.sources.stores import Project

BINARY = "path string, modificationTime timestamp, length long, content binary"
STATE = "hash string, n_chunks int, last_processed timestamp, chunk_method string"
#: A page of a changed file, or (``doc_ix`` -1) what became of a file.
PASSED = "file string, doc_ix int, text string, metadata string, outcome string"
MARK = -1
METADATA = "map<string,string>"


def _judge(method: str):
    """One file's pages of a batch against its state."""

    def judge(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(pages))  # the pages of one file
        held = held[held.version == held.version.max()]  # the last delivery, if there are several
        first, outcome = held.iloc[0], "changed"
        if first["error"] is not None:
            outcome = "failed"
        elif (state.get[0] if state.exists else first["known"]) == first["hash"]:
            outcome = "unchanged"
        if outcome == "changed":
            state.update((first["hash"], int(held["n"].sum()), first["at"].to_pydatetime(), method))
            yield held[["file", "doc_ix", "text", "metadata"]].assign(outcome=None)
        yield pd.DataFrame({"file": [key[0]], "doc_ix": [MARK], "text": [None], "metadata": [None], "outcome": [outcome]})

    return judge


def changes(project: Project, files: DataFrame, method: Method, size: int = 400, overlap: int = 50) -> DataFrame:
    """A stream of ``files`` (file, content, at, version) as rows of ``PASSED``; of several versions of a file the greatest counts."""
    known = project.manifest.read().select(F.col("file").alias("__file"), F.col("hash").alias("known"))
    hashed = files.withColumn("ext", suffix("file")).filter(loaders.supported("ext")).withColumn("hash", manifest.content_hash("content"))
    told = hashed.join(known, F.col("file") == F.col("__file"), "left").select("file", "ext", "content", "hash", "known", F.col("at").cast("string").alias("at"), "version")
    pages = loaders.load(told, keep=("hash", "known", "at", "version")).withColumn("ext", suffix("file")).withColumn("text", chunking.preclean("text", "ext"))
    counted = pages.select("file", "doc_ix", "text", F.to_json("metadata").alias("metadata"), "error", "hash", "known", "version", F.col("at").cast("timestamp").alias("at"), chunking.count_parts(method, size=size, overlap=overlap).alias("n"))
    return counted.groupBy("file").applyInPandasWithState(_judge(method.value), PASSED, STATE, "append", GroupStateTimeout.NoTimeout)


def watch(project: Project, checkpoint: str, method: Method = Method.SENTENCE, size: int = 400, overlap: int = 50, compat_ids: bool = False, landing: str | None = None, files_per_batch: int | None = None) -> StreamingQuery:
    """Processes what the landing folder (else the project's raw folder) holds now, at any depth, and then stops; start it again for later files.

    The file source takes up each path once: a changed file has to arrive under
    a new one, such as a folder of its delivery. Its name alone says which file it is.
    """
    source = project.spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    version = F.concat(F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss.SSS "), F.col("path")).alias("version")
    files = source.load(landing or project.raw).select(loaders.file_name("path").alias("file"), "content", F.current_timestamp().alias("at"), version)

    def batch(rows: DataFrame, _: int) -> None:
        held = rows.persist()  # else each use would ask the state again
        done = held.filter((F.col("doc_ix") == MARK) & (F.col("outcome") == "changed")).select("file")
        if done.count():
            pages = held.filter(F.col("doc_ix") != MARK).withColumn("metadata", F.from_json("metadata", METADATA))
            stores.replace_chunks(chunking.chunk(pages, method, size, overlap, compat_ids), done, project.chunks)
        held.unpersist()

    return changes(project, files, method, size, overlap).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stream's state as manifest rows."""
    held = spark.read.format("statestore").load(checkpoint).select("key.*", "value.groupState.*")
    return held.select(F.col(held.columns[0]).alias("file"), "hash", "n_chunks", F.col("last_processed").cast("timestamp_ntz").alias("last_processed"), "chunk_method")


def manifest_of(project: Project, checkpoint: str) -> DataFrame:
    """The manifest, with what the stream knows in place of what it knew before."""
    return manifest.upsert(project.manifest.read(), state(project.spark, checkpoint))


def settle(project: Project, checkpoint: str) -> None:
    """Writes ``manifest_of`` down; the stream must have stopped."""
    project.manifest.replace(manifest_of(project, checkpoint))
