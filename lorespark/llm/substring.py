"""Substring dedup by content-defined chunks.

A gear rolling hash runs over the bytes of each text; a chunk ends after white
space where the hash's top bits are zero, so cuts depend on the 16 bytes before
them alone and an insertion moves no cut beyond the chunk or two it touches.
Scripts written without white space (Chinese, Japanese, Thai and others) are
cut between code points, as often as words are; other text without white space
where a rarer pattern comes. A chunk is known by 80 bits of its digest; its first occurrence, that of
the smallest doc_id and there the earliest, stays, all later ones are repeats.
Neighbouring repeats join to spans, and spans of at least ``MIN_WORDS`` words
count: chunks lose a few words at either end of a repeated passage, so a
passage of 50 words is far above this, a licence line or a common phrase below.
Where no white space parts words, every ``WORD_BYTES`` bytes count as a word:
in those scripts, and in all else beyond ``BARE_AFTER`` bytes from white space.

Texts are cut once, in blocks of about ``BLOCK_BYTES``. A block's distinct digests
(their first 64 bits) go to owners, sorted and Golomb-coded, as in exact dedup;
a bitmap tells the block which of them occur in another block too. Only the
chunks that do, or that repeat within the block, leave it with their places.
Their whole digests are then counted with map-side aggregation and joined back
over fresh exchanges, whose large partitions adaptive execution may split, so a
passage found in a third of all documents stays spread out.

Defined results: null and empty texts have no chunks; a null doc_id counts as
the largest; rows are told apart by doc_id and text (``common.ROW``), and rows
that share both are one document, which is not compared with itself; other
columns are ignored, or kept by ``remove_repeats``. Offsets are bytes of the
UTF-8 text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm import golomb
from lorespark.llm.common import ROW, lean, lean_groups, materialize, own_columns, row_key, same_row, shuffle_partitions, unused
from lorespark.llm.exact_dedup import _answer, _by_owner, _suspects

MIN_WORDS = 24
MIN_CHUNK = 16
#: One cut in 4 words, and one in 512 bytes where white space is further away than this.
WORD_BITS, BARE_BITS, BARE_AFTER = 2, 9, 64
#: One cut in 8 code points of scripts without white space; bytes that count as a word there.
POINT_BITS, WORD_BYTES = 3, 6
#: Bytes of text in a block, and chunks in an owner's range at most, on average.
BLOCK_BYTES, OWNED = 8_000_000, 8_000_000
#: Spans that are broadcast when texts are cut, over all documents; more are joined by shuffling.
BROADCAST_SPANS = 500_000

_GEAR = np.array([xxhash.xxh64_intdigest(bytes([i]), 42) & 0xFFFF for i in range(256)], np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i - 1] << 1) + gear[data[i]] in 16 bits, by doubling the width that each step has summed."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        before = h.copy()
        h[width:] += before[:-width] << np.uint16(width)
    return h


def unspaced(data: np.ndarray) -> np.ndarray:
    """Bytes of code points whose scripts are written without white space."""
    then = np.append(data[1:], np.uint8(0))
    lead = ((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE2) & (then >= 0xBA))  # kana, Chinese
    lead |= (data == 0xE0) & (then >= 0xB8)  # Thai, Lao, Tibetan
    lead |= (data == 0xE1) & ((then <= 0x82) | (then == 0x9E) | (then == 0x9F))  # Burmese, Khmer
    lead |= (data == 0xEF) & (((then >= 0xA4) & (then <= 0xAB)) | ((then >= 0xBC) & (then <= 0xBE)))
    lead |= (data == 0xF0) & (then >= 0xA0) & (then <= 0xB3)
    return lead[np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0))]


def cuts(text: bytes) -> tuple[list[int], np.ndarray]:
    """Chunk ends (the last is the text's end) and, for each, the words, or what counts as such, before it."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    h = gear(data)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    start = ~white
    start[1:] &= white[:-1]  # a word begins here
    words = np.cumsum(start)
    cut = np.zeros(n, bool)
    cut[:-1] = start[1:] & ((h[:-1] >> np.uint16(16 - WORD_BITS)) == 0)
    bare = (h >> np.uint16(16 - BARE_BITS)) == 0
    bare[:-1] &= (data[1:] & 0xC0) != 0x80
    dense = data.max() >= 0xE0
    if dense or np.diff(np.flatnonzero(white), prepend=-1, append=n).max() > BARE_AFTER:
        at = np.arange(n)
        run = at - np.maximum.accumulate(np.where(white, at, -1))
        cut |= bare & (run > BARE_AFTER)
        more = run > BARE_AFTER
        if dense:
            points = unspaced(data)
            cut[:-1] |= points[:-1] & ((data[1:] & 0xC0) != 0x80) & ((h[:-1] >> np.uint16(16 - POINT_BITS)) == 0)
            more |= points & (run > WORD_BYTES)
        words = words + np.cumsum(more) // WORD_BYTES
    ends, last = [], 0
    for end in (np.flatnonzero(cut) + 1).tolist():
        if end - last >= MIN_CHUNK:
            ends.append(end)
            last = end
    if last < n:
        ends.append(n)
    return ends, words[np.array(ends) - 1]


_INFO = pa.schema([*[(c, pa.int64()) for c in ROW], ("n", pa.int64())])
_PART = np.dtype([("hi", "<i8"), ("lo", "<i2"), ("length", "<u4"), ("words", "<u4"), ("again", "?")])
_ROWS = ", ".join(f"{c} long" for c in ROW)


def chunked(text: bytes) -> np.ndarray:
    """The chunks of a text: digest (80 of its bits), length, words, and whether it was seen earlier in the text."""
    ends, begun = cuts(text)
    begins = [0, *ends[:-1]]
    digests = [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(begins, ends)]
    out = np.zeros(len(ends), _PART)
    key = np.frombuffer(b"".join(digests), np.dtype([("hi", "<i8"), ("lo", "<i2"), ("rest", "V6")]))
    out["hi"], out["lo"] = key["hi"], key["lo"]
    out["length"], out["words"] = np.diff(ends, prepend=0), np.diff(begun, prepend=0)
    seen: set[bytes] = set()
    out["again"] = [d in seen or seen.add(d) is not None for d in digests]
    return out


def _blocks(bits: int):
    """Rows of a block: one without owner with its documents and chunks, and one per owner with the digests it is sent."""

    def flush(block: int, rows: list[tuple], held: list[np.ndarray]):
        flat = np.concatenate(held) if held else np.zeros(0, _PART)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _INFO) as out:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INFO)], schema=_INFO))
        fields = [zlib.compress(sink.getvalue().to_pybytes(), 1), flat["hi"].tobytes() + flat["lo"].tobytes()]
        planes = [np.ascontiguousarray(flat[f]) for f in ("length", "words", "again")]
        fields += [zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1) for x in planes]
        sent = _by_owner(flat["hi"], bits)
        coded = [golomb.encode(values, owner << (64 - bits)) for owner, values, _ in sent]
        n = len(sent)
        return pa.RecordBatch.from_arrays([pa.array([block] * (n + 1), pa.int64()), pa.array([None, *[x[0] for x in sent]], pa.int32()), pa.array([None, *coded], pa.binary()), pa.array([fields, *[None] * n], pa.list_(pa.binary()))], ["part", "owner", "coded", "chunks"])

    def blocks(batches):
        block, size, rows, held = TaskContext.get().partitionId() << 24, 0, [], []
        for batch in batches:
            for a, b, c, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found = chunked(text) if text else np.zeros(0, _PART)
                rows.append((a, b, c, len(found)))
                held.append(found)
                size += len(text or b"")
                if size >= BLOCK_BYTES:
                    yield flush(block, rows, held)
                    block, size, rows, held = block + 1, 0, [], []
        if rows:
            yield flush(block, rows, held)

    return blocks


def _found(bits: int):
    def found(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        bitmaps, out = dict(zip(answers.owner, answers.bitmap)), []
        for info, keys, length, words, again in blocks.chunks:
            with pa.ipc.open_stream(zlib.decompress(info)) as stream:
                info = stream.read_all()
            n_chunks = info.column("n").to_numpy()
            n = int(n_chunks.sum())
            plane = lambda data, kind: np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, n).T).view(kind).ravel()  # noqa: B023, E731
            hi, lo = np.frombuffer(keys, "<i8", n), np.frombuffer(keys, "<i2", n, 8 * n)
            take = np.flatnonzero(_suspects(hi, bits, bitmaps)) if n else np.zeros(0, np.int64)
            if not len(take):
                continue
            of = np.repeat(np.arange(len(n_chunks)), n_chunks)
            length = plane(length, "<u4").astype(np.int64)
            stop = np.cumsum(length)
            begin = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(n_chunks)[:-1]])]
            stop = stop - begin[of]
            frame = info.drop_columns(["n"]).take(pa.array(of[take])).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            out.append(frame.assign(start=(stop - length)[take], stop=stop[take], words=plane(words, "<u4")[take], hi=hi[take], lo=lo[take], again=plane(again, "?")[take]))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in [*ROW, "start", "stop", "words", "hi", "lo", "again"]})

    return found


def suspect_chunks(docs: DataFrame) -> DataFrame:
    """The chunks whose digest occurs more than once: row key, start, stop, words, digest (hi, lo), again."""
    bits = max(1, shuffle_partitions(docs.sparkSession) - 1, 100 * docs.count() // OWNED).bit_length()
    texts = docs.select(*row_key(), F.col("text").cast("string").cast("binary").alias("text"))
    blocks = materialize(texts.mapInArrow(lean(_blocks(bits)), "part long, owner int, coded binary, chunks array<binary>"))
    answers = blocks.filter("owner is not null").select("part", "owner", "coded").groupBy("owner").applyInPandas(lean_groups(_answer), "part long, owner int, bitmap binary")
    waiting = blocks.filter("owner is null").select("part", "chunks").groupBy("part")
    return waiting.cogroup(answers.groupBy("part")).applyInPandas(lean_groups(_found(bits)), f"{_ROWS}, start int, stop int, words int, hi long, lo short, again boolean")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """The chunks that occurred before: row key, start, stop, words and first_doc_id."""
    found = materialize(suspect_chunks(docs).distinct())
    order = F.struct(F.col(ROW[0]).isNull().alias("none"), *ROW)
    several = (
        found.groupBy("hi", "lo").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.bool_or("again").alias("any"))
        .filter("last > first or any").select(F.expr("hi | 0L").alias("h"), F.expr("lo | 0S").alias("l"), "first")
    )
    joined = found.join(several, (found.hi == several.h) & (found.lo == several.l))
    return joined.filter((order > F.col("first")) | F.col("again")).select(*ROW, "start", "stop", "words", F.col(f"first.{ROW[0]}").alias("first_doc_id"))


def row_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The row key, start, stop, n_words and first_doc_id of each repeated span; see the module's text."""
    order = Window.partitionBy(*ROW).orderBy("start", "stop")
    new = F.coalesce(F.col("start") > F.lag("stop").over(order), F.lit(True))
    runs = repeated_chunks(docs).withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    spans = runs.groupBy(*ROW, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"), F.min("first_doc_id").alias("first_doc_id"))
    return spans.filter(F.col("n_words") >= min_words).select(*ROW, "start", "stop", "n_words", "first_doc_id")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, stop, n_words and first_doc_id of each repeated span; see the module's text."""
    return row_spans(docs, min_words).withColumnRenamed(ROW[0], "doc_id").select("doc_id", "start", "stop", "n_words", "first_doc_id")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without its repeated spans, all columns kept; ``n_chars``, if there is one, follows the text.

    Texts of which only white space is left are dropped with their row; all
    other rows without a repeat come out as they went in.
    """
    spans = row_spans(docs, min_words).groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__row_spans"))
    by_row = materialize(spans.select(*[F.col(c).alias(f"{c}_of") for c in ROW], "__row_spans"))
    if (by_row.agg(F.sum(F.size("__row_spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        by_row = F.broadcast(by_row)
    names = docs.columns
    joined = docs.join(by_row, same_row(docs, by_row), "left").select(*own_columns(docs), by_row["__row_spans"].alias(*unused(docs, "spans")))
    at = names.index("text")

    def cut(batches):
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for i, cut_out in enumerate(spans):
                if cut_out:
                    data, parts, last = texts[i].encode(), [], 0
                    for s in cut_out:
                        parts.append(data[last : s["start"]])
                        last = s["stop"]
                    texts[i] = b"".join([*parts, data[last:]]).decode("utf-8", "replace")
                    keep[i] = bool(texts[i].strip())
            columns = [pa.array(texts, batch.schema.field(at).type) if j == at else batch.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    out = joined.mapInArrow(lean(cut), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
