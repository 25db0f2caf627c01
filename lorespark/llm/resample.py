"""Importance resampling towards a target: hashed n-gram counts, log-ratio gains, Gumbel top-k.

The counts of every document by bucket are written once, as blocks of a
compressed sparse row matrix (documents by buckets). Its column sums, and those
of the target, give each bucket a gain; the product of the matrix with the gains
gives each document's weight. A document's score is its weight plus Gumbel noise
drawn from its id, so that the highest scores are a sample without replacement
in proportion to the exponential of the weights.

Column sums are added up in each task before they are shuffled. Gains are the
one thing that is sent everywhere: ``BUCKETS`` numbers, whatever the input. The
ranking is one range shuffle of narrow rows; a rank is a row's place in its
partition after the partitions before it.

Defined results: null text holds no words; a null doc_id draws its noise as the
empty string and sorts last among ties; repeated rows count and rank each on
their own (by their place in the written matrix); an empty target or an empty
table has no counts, which the added ones allow for; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import lean, materialize, shared_dir

BUCKETS = 10_000
#: Runs of 1 to so many consecutive words.
NGRAM = 1
SEED = 2024
MIN_WORDS = 20
#: Of the documents with ``MIN_WORDS`` words, so many in a hundred are drawn.
PERCENT = 10
#: Documents of a block of the matrix, and its entries after which a block closes.
BLOCK_DOCS, BLOCK_FEATURES = 2_048, 1 << 16
#: Bytes of a row group of the written matrix; a reader unpacks a whole one, to several times that.
ROW_GROUP = 4 << 20
#: Features whose buckets a worker keeps.
CACHE = 400_000
#: Gains and noise are in thousandths.
SCALE = 1000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
CSR = "block long, ids array<long>, starts array<long>, buckets array<int>, times array<int>, words array<long>"


def features(text: str | None, ngram: int = NGRAM) -> tuple[list[str], int]:
    """All runs of 1 to ``ngram`` words, repeats included, and how many words there are."""
    words = WORD.findall((text or "").translate(LOWER))
    runs = words if ngram == 1 else [" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]
    return runs, len(words)


def write_counts(docs: DataFrame, where: str, key: str = "doc_id", buckets: int = BUCKETS, ngram: int = NGRAM) -> DataFrame:
    """The document-by-bucket counts in the folder ``where``: a row per block, its arrays those of a CSR matrix."""

    def counted(batches):
        known: dict[str, int] = {}
        part, block = TaskContext.get().partitionId() << 32, 0
        ids, words, starts, cols, times, size = [], [], [0], [], [], 0

        def out():
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (cols, times)]
            arrays = [pa.array([ids], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), *[pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in flat], pa.array([words], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([part + block], pa.int64()), *arrays], ["block", "ids", "starts", "buckets", "times", "words"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs, many = features(text.as_py(), ngram)
                if len(known) > CACHE:
                    known.clear()
                for w in set(runs).difference(known):
                    known[w] = zlib.crc32(w.encode()) % buckets
                found, n = np.unique(np.fromiter(map(known.__getitem__, runs), np.int64, len(runs)), return_counts=True)
                ids.append(doc_id)
                words.append(many)
                starts.append(starts[-1] + len(found))
                cols.append(found)
                times.append(n)
                size += len(found)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_FEATURES:
                    yield out()
                    block += 1
                    ids, words, starts, cols, times, size = [], [], [0], [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(lean(counted), CSR)
    # the writer looks at a group's size after so many rows, and a row is a whole block
    sizes = {"parquet.block.size": ROW_GROUP, "parquet.block.size.row.check.min": 4, "parquet.block.size.row.check.max": 32, "parquet.page.size.row.check.min": 4}
    rows.write.options(compression="zstd", **sizes).parquet(where)
    return docs.sparkSession.read.schema(CSR).parquet(where)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs; a task's blocks are added up before anything is shuffled, and at most ``buckets`` rows reach the driver."""

    def summed(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cols, times in zip(batch.column(0), batch.column(1)):
                np.add.at(total, cols.values.to_numpy(), times.values.to_numpy())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    sums = matrix.select("buckets", "times").mapInArrow(lean(summed), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of each bucket's smoothed share of the target over its share of the corpus."""
    s_all, t_all, n = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(SCALE * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of standard Gumbel noise, drawn from the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def score(matrix: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, row) of every document: the sparse product of its row with the gains, and noise."""
    names = ["doc_id", "n_features", "n_words", "weight", "score", "row"]

    def scored(batches):
        for batch in batches:
            for block, ids, starts, cols, times, words in zip(*(batch.column(i) for i in range(6))):
                starts, many = starts.values.to_numpy(), times.values.to_numpy().astype(np.int64)
                # sums of rows as differences of running sums: exact in integers, and empty rows are zero
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
                n, weight = sums(many), sums(many * gain[cols.values.to_numpy()])
                ids = ids.values
                noise = np.array([gumbel(i, seed) for i in ids.to_pylist()], np.int64)
                row = (block.as_py() << 12) + np.arange(len(ids))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n, words.values.to_numpy(), weight, weight + noise, row))], names)

    return matrix.mapInArrow(lean(scored), ", ".join(f"{n} long" for n in names))


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with rank 1, 2, 3 ... of the highest scores among documents with ``min_words`` words; the others' is null."""
    fit = F.col("n_words") >= min_words
    order = [F.col("out").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    dealt = scored.withColumn("out", F.when(fit, 0).otherwise(1)).repartitionByRange(*order).sortWithinPartitions(*order)
    # reliable: a row keeps its place when an executor is lost
    placed = materialize(dealt.select("doc_id", "n_features", "weight", "score", "out", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("out") == 0, 1)).alias("fit")).collect())
    drawn, before, offsets = percent * sum(f for *_, f in sizes) // 100, 0, {}
    for p, n, _ in sizes:  # one number of each partition
        offsets[p] = before
        before += n
    spark = scored.sparkSession
    first = spark.createDataFrame(list(offsets.items()), "part long, before long")
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    found = placed.withColumn("part", part).join(F.broadcast(first), "part")
    return found.select("doc_id", "n_features", "weight", "score", F.when((place <= drawn) & (F.col("out") == 0), place).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, target_key: str = "item_id", percent: int = PERCENT, ngram: int = NGRAM, seed: int = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank. The matrices stay in a folder of the shared one."""
    spark: SparkSession = docs.sparkSession
    where = f"{shared_dir(spark)}/resample-{uuid.uuid4().hex}"
    raw = write_counts(docs, f"{where}/raw", ngram=ngram)
    goal = write_counts(target, f"{where}/target", key=target_key, ngram=ngram)
    return ranked(score(raw, gains(column_sums(raw), column_sums(goal)), seed), percent, min_words)


#: CRC-32 over bits, for words once each: the table of bytes, then one step per byte.
ORACLE_SQL = r"""
WITH RECURSIVE bits(byte, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
raw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), target AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), seen AS (SELECT r, unnest(words) AS w FROM raw), goal AS (SELECT unnest(words) AS w FROM target),
vocabulary AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda i: (instr('0123456789ABCDEF', substr(hex(encode(w)), 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode(w)), 2 * i + 2, 1)) - 1)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM seen UNION SELECT w FROM goal), tab
), s AS (SELECT bucket, count(*) AS n FROM seen JOIN vocabulary USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM goal JOIN vocabulary USING (w) GROUP BY bucket),
gain AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM seen) + 10000) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM goal) + 10000))))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket)
), weights AS (SELECT r, sum(g)::BIGINT AS weight FROM seen JOIN vocabulary USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM raw LEFT JOIN weights USING (r)
), drawn AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS place FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM drawn) THEN place END AS rank
FROM scored LEFT JOIN drawn USING (r)
"""
