"""Document fingerprints: a canonical exact digest.

The canonical form of a text is its compatibility normal form (NFKC), case
folded and normalised again, with each run of Unicode white space made one
space and none at the ends. The fingerprint is the 128-bit xxHash (XXH3) of its
UTF-8 bytes. Fingerprints are an exact key, not a sketch: two texts have
likeness 1.0 if their fingerprints and then their canonical bytes are equal,
and 0.0 otherwise. Rows of equal canonical bytes are a class, named by its
smallest doc_id.

Defined results: null text counts as empty; null doc_ids sort last; rows that
share a doc_id are ordered by text; a class without any doc_id has a null name;
other columns are ignored; the only row of a table is its own next document.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import ROW, _small, join_rows, lean, materialize, row_key


def canonical(text: str | None) -> str:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> float:
    """Of two (fingerprint, canonical text): bytes are compared inside equal fingerprints."""
    return float(a[0] == b[0] and a[1] == b[1])


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to the first as many of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROWS = ", ".join(f"{c} long" for c in ROW)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The row key, fingerprint and canonical text of every row."""

    def printed(batches):
        for batch in batches:
            canon = [canonical(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([digest(c) for c in canon]), pa.array(canon, pa.string())], [*ROW, "fingerprint", "canonical"])

    return docs.select(*row_key(), F.col("text").cast("string").alias("text")).mapInArrow(lean(printed), f"{_ROWS}, fingerprint string, canonical string")


def _classed(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """``prints`` (materialised: row key, fingerprint and others) with class_id and class_size.

    Digests are counted first; only rows in buckets of several move with their
    canonical text, which map-side aggregation collapses to one row per task and
    distinct text. Texts that differ inside one bucket get classes of their own.
    """
    shared = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint")
    suspects = materialize(prints.join(shared, "fingerprint", "left_semi").select(*ROW))
    texts = fingerprints(join_rows(docs, suspects, "left_semi"))
    side = F.sha2("canonical", 256).alias("side")
    groups = texts.groupBy("fingerprint", "canonical").agg(F.min(ROW[0]).alias("class_id"), F.count(F.lit(1)).alias("class_size")).select("fingerprint", side, "class_id", "class_size")
    members = texts.select(*ROW, "fingerprint", side).distinct().join(groups, ["fingerprint", "side"])
    members = _small(materialize(members.select(*[F.col(c).alias(f"{c}_of") for c in ROW], "class_id", "class_size")))
    joined = prints.join(members, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in ROW], "left")
    alone = F.col("class_size").isNull()
    return joined.select(*prints.columns, F.when(alone, F.col(ROW[0])).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def equal_classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, class_id (smallest doc_id of the same canonical bytes) and class_size of every row."""
    found = _classed(docs, materialize(fingerprints(docs).drop("canonical")))
    return found.withColumnRenamed(ROW[0], "doc_id").select("doc_id", "fingerprint", "class_id", "class_size")


_OUT = pa.schema(
    [*[(c, pa.int64()) for c in ROW], ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("end", pa.int32()), ("part", pa.int32()), ("text", pa.string())]
)
_SQL = f"{_ROWS}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, end int, part int, text string"
FIRST, LAST = 1, 2


class _Reader:
    """Takes texts in order and compares each with the one that comes next."""

    def __init__(self):
        self.held = None
        self.rows: list[tuple] = []

    def compare(self, following: tuple) -> None:
        key, text, own = self.held
        new = edited(text, following[1])
        canon = canonical(new)
        other = (digest(canon), canon)
        self.rows.append((*key, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own[0], other[0], likeness(own, other), likeness(own, following[2]), None, None, None))

    def take(self, key: tuple, text: str) -> tuple:
        canon = canonical(text)
        row = (key, text, (digest(canon), canon))
        if self.held is not None:
            self.compare(row)
        self.held = row
        return row

    def end(self, which: int, row: tuple, part: int) -> None:
        self.rows.append((*row[0], None, None, None, None, None, None, which, part, row[1]))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) or [[] for _ in _OUT]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def _within(batches):
    """The rows of a sorted partition against their successors; its two ends are passed on."""
    reader, part, first = _Reader(), TaskContext.get().partitionId(), None
    for batch in batches:
        for *key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            row = reader.take(tuple(key), text or "")
            if first is None:
                first = row
                reader.end(FIRST, row, part)
        yield reader.batch()
    if first is not None:
        reader.end(LAST, reader.held, part)
        yield reader.batch()


def _between(batches):
    """Ends of partitions in order: each last row meets the first row of the next partition."""
    reader, first = _Reader(), None
    for batch in batches:
        for *key, text, end in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if end == LAST:
                reader.held = None
                reader.take(tuple(key), text)
            elif reader.held is None:
                first = (tuple(key), text)
            else:
                reader.take(tuple(key), text)
        yield reader.batch()
    if first is not None:
        reader.take(*first)
        yield reader.batch()


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, and its class.

    One range shuffle puts the texts in descending order of doc_id; a partition
    compares neighbours as they stream by. Two rows per partition, its ends, are
    compared across partitions afterwards.
    """
    order = [F.col(ROW[0]).desc_nulls_last(), F.col("text").asc()]
    ranged = docs.select(*row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartitionByRange(order[0]).sortWithinPartitions(*order)
    compared = materialize(ranged.mapInArrow(lean(_within), _SQL))
    result = [f.name for f in _OUT][: len(ROW) + 6]
    ends = compared.filter("end is not null").select(*ROW, "text", "end", "part").repartition(1).sortWithinPartitions("part", "end").select(*ROW, "text", "end")
    found = compared.filter("end is null").select(*result).unionByName(materialize(ends.mapInArrow(lean(_between), _SQL)).select(*result))
    return _classed(docs, found).withColumnRenamed(ROW[0], "doc_id").drop(*ROW)
