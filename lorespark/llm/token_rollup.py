"""Token counts: totals that are maintained by deltas.

Totals of documents and tokens by source, language and tokenizer version are
never recounted. A batch of changes - inserts, deletes, and revisions that may
also move a document to another source, language or version - becomes signed
deltas; they are summed within the batch and written as one folder under the
batch's name. The batch counts from the moment its marker is written, after the
data. Committing a batch again does nothing if its marker is there, and
otherwise writes the same folder anew, so a driver or executor lost midway
leaves nothing half counted. Totals are the sum over the committed batches.
Batches are to be committed by one writer at a time.

Defined results: a change without a new key or old key (all of source, lang and
version null on a side that the operation needs) counts under nulls; null
counts are 0; unknown operations fail the batch; totals whose documents and
tokens are both 0 are left out; an empty batch commits.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import lean, materialize, shared_dir

TOKENIZER = "word_bpe_49k.json"
KEYS = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
CHANGE = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_source string, old_lang string, old_tokenizer_version string, old_n_tokens long"
MARKER = "batch_id string, committed_at timestamp"


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, lang and n_tokens of every row's whole text; null text has none."""

    def counted(batches):
        from lorespark.llm.word_encoder import encoder

        encode = encoder(tokenizer).encode
        for batch in batches:
            n = [len(encode([t])[0]) // 4 if t else 0 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    string = lambda c: F.col(c).cast("string").alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), string("source"), string("lang"), string("text")).mapInArrow(lean(counted), "doc_id long, source string, lang string, n_tokens long")


def inserts(counts: DataFrame, version: str) -> DataFrame:
    """Changes that insert counted documents under a tokenizer version."""
    none = F.lit(None)
    return counts.select(
        F.lit("insert").alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens",
        none.cast("string").alias("old_source"), none.cast("string").alias("old_lang"), none.cast("string").alias("old_tokenizer_version"), none.cast("long").alias("old_n_tokens"),
    )


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums per key: +1 document and its tokens on the new side, -1 and its old tokens on the old side."""
    op = F.lower("op")
    known = F.when(op.isin("insert", "delete", "revise"), op).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null")))))
    side = lambda sign, *cols: F.struct(F.lit(sign).alias("sign"), *[F.col(c).alias(k) for c, k in zip(cols, [*KEYS, "n_tokens"])])
    new = side(1, *KEYS, "n_tokens")
    old = side(-1, *[f"old_{k}" for k in KEYS], "old_n_tokens")
    sides = F.when(known == "insert", F.array(new)).when(known == "delete", F.array(old)).otherwise(F.array(new, old))
    moved = changes.select(F.explode(sides).alias("d")).select("d.*")
    return moved.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))


class TokenRollup:
    """Totals kept in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}"

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    @staticmethod
    def _name(batch_id: str) -> str:
        return "batch=" + "".join(c if c.isalnum() or c in "-_" else f"%{ord(c):x}." for c in batch_id)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch of ``CHANGE`` rows; False if it was committed before."""
        name = self._name(batch_id)
        if self._exists(f"markers/{name}/_SUCCESS"):
            return False
        deltas(changes).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.path}/deltas/{name}")
        marker = self.spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.current_timestamp().alias("committed_at"))
        marker.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.path}/markers/{name}")
        return True

    def batches(self) -> list[str]:
        """The committed batches."""
        if not self._exists("markers"):
            return []
        return [r.batch_id for r in self.spark.read.schema(MARKER).parquet(f"{self.path}/markers/*").select("batch_id").orderBy("batch_id").collect()]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs and n_tokens."""
        paths = [f"{self.path}/deltas/{self._name(b)}" for b in self.batches()]
        read = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        summed = read.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0 or n_tokens <> 0")


def _changes(op: str, counts: DataFrame, old_version: str, version: str, n_tokens) -> DataFrame:
    """Changes of all ``counts``, from what was counted under ``old_version`` to ``n_tokens`` under ``version``."""
    old = [F.col(c).alias(f"old_{c}") for c in ("source", "lang")] + [F.lit(old_version).alias("old_tokenizer_version"), F.col("n_tokens").alias("old_n_tokens")]
    return counts.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), n_tokens.alias("n_tokens"), *old)


def corpus_totals(docs: DataFrame, tokenizer: str = TOKENIZER, path: str | None = None) -> DataFrame:
    """Totals of ``docs`` after three batches, each replayed, which changes nothing.

    All rows are inserted; all are revised to counts that hold the end id, under
    a version of their own; rows without a token are then deleted.
    """
    rollup = TokenRollup(docs.sparkSession, path)
    counts = materialize(count_tokens(docs, tokenizer))
    version = tokenizer.rsplit("/", 1)[-1]
    ended = f"{version}+end"
    with_end = counts.withColumn("n_tokens", F.col("n_tokens") + 1)
    batches = [
        ("load", inserts(counts, version)),
        ("end id", _changes("revise", counts, version, ended, F.col("n_tokens") + 1)),
        ("no token", _changes("delete", with_end.filter("n_tokens = 1"), ended, ended, F.lit(0).cast("long"))),
    ]
    for name, batch in batches:
        rollup.commit(name, batch)
        rollup.commit(name, batch)
    return rollup.totals()
