"""Exact dedup by a Golomb-coded exchange of fingerprints.

1. Every input partition hashes its normalised texts (64 bits), and sends each
   distinct hash once, sorted and Golomb-coded, to the owner of its range.
2. An owner marks the hashes that came from more than one partition and answers
   each partition with a bitmap over what it sent. A hash that repeats within
   its partition is marked there. One hash of a third of all rows thus costs an
   owner one entry per partition.
3. Only marked rows ("suspects") move with their text: grouping by the text
   itself compares bytes, and map-side aggregation leaves one row per task for
   each distinct text, however many copies there are.
4. Suspects take the outcome by (hash, SHA-256) of their text; all others stay.

Defined results: null text counts as empty, so all empty and null texts are
equal; the smallest non-null doc_id of a group is kept; rows that repeat a
doc_id are all returned and all carry their group's outcome; a null doc_id is
kept only if its group has no other; other columns are ignored. ``keep_first``
leaves exactly one row of each group: of rows that share the kept doc_id, or
have none, the one whose raw text's hash is smallest. Rows are told apart by
doc_id and text (``common.ROW``), so null and repeated ids lose no text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm import golomb
from lorespark.llm.common import ROW, drop_rows, join_rows, lean, materialize, row_key, shuffle_partitions

#: Rows whose hashes fall in an owner's range, at most, on average.
OWNED = 2_000_000
WHITE = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def _by_owner(hashes: np.ndarray, bits: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(owner, its distinct hashes ascending, how often each occurs) for a partition's hashes."""
    values, counts = np.unique(hashes.astype(np.int64).view(np.uint64), return_counts=True)
    owners = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    cuts = np.flatnonzero(np.diff(owners)) + 1
    return [(int(o[0]), v, c) for o, v, c in zip(np.split(owners, cuts), np.split(values, cuts), np.split(counts, cuts)) if len(v)]


def _sender(bits: int):
    def send(batches):
        part, hashes = None, []
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                hashes.append(batch.column(1).to_numpy())
        if hashes:
            sent = _by_owner(np.concatenate(hashes), bits)
            bases = [(owner << (64 - bits)) if bits else 0 for owner, _, _ in sent]
            coded = [golomb.encode(values, base) for (_, values, _), base in zip(sent, bases)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.int32()), pa.array([part] * len(sent), pa.int32()), pa.array(coded, pa.binary())], ["owner", "part", "coded"])

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: which of the hashes it got came from more than one partition."""
    lists = [golomb.decode(x) for x in pdf.coded]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = values[counts > 1]
    maps = [np.isin(x, twice, assume_unique=True) for x in lists]
    return pd.DataFrame({"part": pdf.part, "owner": pdf.owner, "bitmap": [np.packbits(m).tobytes() if m.any() else None for m in maps]}).dropna()


def _suspects(hashes: np.ndarray, bits: int, bitmaps: dict[int, bytes]) -> np.ndarray:
    """Which of a partition's hashes occur elsewhere, by its owners' bitmaps, or more than once in it."""
    suspect: list[np.ndarray] = []
    for owner, values, counts in _by_owner(hashes, bits):
        seen = counts > 1
        if owner in bitmaps:
            seen = seen | np.unpackbits(np.frombuffer(bitmaps[owner], np.uint8), count=len(values)).astype(bool)
        suspect.append(values[seen])
    marked = np.concatenate(suspect) if suspect else np.empty(0, np.uint64)
    return np.isin(hashes.astype(np.int64).view(np.uint64), marked)


def _marker(bits: int):
    def mark(rows: pa.Table, answers: pa.Table) -> pa.Table:
        # Arrow throughout: pandas would round large ids beside a null one
        bitmaps = dict(zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist()))
        found = _suspects(rows.column("h").to_numpy(), bits, bitmaps)
        return rows.select([*ROW, "h", "sha"]).append_column("suspect", pa.array(found))

    return mark


_ROW = ", ".join(f"{c} long" for c in ROW)


def mark_suspects(docs: DataFrame) -> DataFrame:
    """(row key, h, sha, suspect) of every row, materialised; suspects share their hash with another row."""
    prints = materialize(
        docs.select(*row_key(), normalized(F.col("text")).alias("norm"))
        .select(*ROW, F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
        .withColumn("part", F.spark_partition_id())
    )
    # at most OWNED rows on average for an owner, so that a task's memory does not grow with the table
    bits = max(1, shuffle_partitions(docs.sparkSession) - 1, prints.count() // OWNED).bit_length()
    sent = prints.select("part", "h").mapInArrow(lean(_sender(bits)), "owner int, part int, coded binary")
    answers = sent.groupBy("owner").applyInPandas(_answer, "part int, owner int, bitmap binary")
    marked = prints.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_marker(bits), f"{_ROW}, h long, sha binary, suspect boolean")
    return materialize(marked)


def _decided(docs: DataFrame) -> DataFrame:
    """(row key, sha, keep_id, group_size, best) of every row; ``best`` is the row key that stays, null for a row alone."""
    marked = mark_suspects(docs)
    suspects = marked.filter("suspect").select(*ROW, "h", "sha")
    norm = normalized(F.col("text"))
    texts = join_rows(docs, suspects, "left_semi")
    groups = (
        texts.select(*row_key(), norm.alias("norm"))
        .groupBy("norm")
        .agg(F.min(ROW[0]).alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min(F.struct(F.col(ROW[0]).isNull().alias("none"), *ROW)).alias("best"))
        .select(F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size", "best")
    )
    alone = marked.filter("not suspect").select(*ROW, "sha", F.col(ROW[0]).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(None).cast(groups.schema["best"].dataType).alias("best"))
    return alone.unionByName(suspects.join(groups, ["h", "sha"]).select(*ROW, "sha", "keep_id", "group_size", "best"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; see the module's text."""
    doc_id = F.col(ROW[0])
    return _decided(docs).select(doc_id.alias("doc_id"), "keep_id", "group_size", doc_id.eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    grouped = _decided(docs).filter("best is not null")
    stays = F.lit(True)
    for c in ROW:
        stays = stays & F.col(c).eqNullSafe(F.col(f"best.{c}"))
    judged = materialize(grouped.select(*ROW, stays.alias("stays")))
    repeated = materialize(judged.filter("stays").groupBy(*ROW).count().filter("count > 1").select(*ROW))
    return drop_rows(docs, judged.filter("not stays"), repeated)


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
