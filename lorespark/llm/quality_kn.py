"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Units. A text is a sequence of words between white space; a word that repeats
the one before it is the single symbol ``AGAIN``, one longer than ``PIECE``
code points is cut into pieces. The model predicts a unit's code points, and its
end, from the ``ORDER - 1`` code points before them in the unit. All of Unicode
is told apart, so the n-gram tables grow with the trusted text. A text's symbols
are its units' code points and ends; ``AGAIN`` counts without an end.

Model. Every trusted document is counted, whole, but for one in ``HELD`` that
is kept to find the limits. Tasks add up their n-grams locally; counts are then
sharded by n-gram and summed. The continuation counts of the lower orders, the
discounts, the contexts' totals and the interpolated probabilities are joins
between these sharded count tables, order by order.

Scoring. A task turns its documents into blocks: the block's distinct units,
and of each document which of them it has how often. The block's distinct
n-grams go, sorted and compressed, to the shards of the count tables. Each distinct n-gram
that any block asked for is looked up once, by joins from the highest order
down: an unseen one takes its context's back-off and goes on with its suffix.
Shards answer each block with a byte per n-gram, and the block adds up its
documents. Nothing is held that grows with the corpus but the sharded tables.

Decision. A document's perplexity is 2 to the mean bits per symbol; ``PRIOR``
symbols at the trusted mean steady short texts. Each language's limit comes
from two quantiles of its held-out trusted documents' bits: the upper one plus
``MARGIN`` times its distance from the median. Languages with fewer than
``LEAST`` of them take the limit of all; where all are fewer, every trusted
document counts as held out. A document is kept if its perplexity is at most
the limit.

Defined results: null or empty text has no symbols and the trusted mean, so it
is kept; without trusted text nothing is rejected and perplexities are those of
a uniform model; null lang is a language of its own; rows that repeat a doc_id
are each returned, and each judged by its own text; a label row with null
doc_id or quality trusts nothing, and one whose doc_id several rows share
trusts them all; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import ROW, drop_rows, join_ids, lean, lean_groups, materialize, row_key, shuffle_partitions, tidy

ORDER, PIECE = 5, 32
PRIOR, LEAST, HELD = 48, 30, 3
MEDIAN, UPPER, MARGIN = 0.5, 0.99, 2.5
#: Bits of an n-gram's last symbol come back in steps of 1/STEPS.
STEPS = 12
#: What pads a unit's beginning, ends it, and stands for the word before once more.
START, END, AGAIN = "\0", " ", "\x01"
#: Code points of text in a block, distinct units that a counting task holds, n-grams in a shard on average.
BLOCK_CHARS, HELD_UNITS, SHARD_GRAMS = 4_000_000, 120_000, 100_000
#: How thoroughly blocks are packed: they are written once and shuffled once, their n-grams twice.
ZSTD = 6
#: Count tables of at most so many n-grams are broadcast when they are looked up.
BROADCAST_GRAMS = 200_000

_MIX = (np.arange(ORDER, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)


def units(text: str | None) -> list[str]:
    """The text's words, repeats as ``AGAIN``, in pieces of at most ``PIECE`` code points."""
    words = (text or "").replace(START, " ").split()
    found = [AGAIN if w == b else w for w, b in zip(words, [None, *words])] if any(map(eq, words, islice(words, 1, None))) else words
    if max(map(len, found), default=0) > PIECE:
        found = [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    return found


def windows(distinct: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(padded units in one string, where distinct n-grams end, which of them each symbol is, symbols per unit)."""
    pad = START * (ORDER - 1)
    joined = pad + (END + pad).join(distinct) + END
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points)
    h = np.zeros(len(ends), np.uint64)
    for k in range(ORDER):
        x = (points[ends - k].astype(np.uint64) + np.uint64(1)) * _MIX[k]
        h += (x ^ (x >> np.uint64(31))) * _MIX[k]
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 1
    return joined, ends[first], which, sizes


def grams(joined: str, ends: np.ndarray) -> list[str]:
    return [joined[e - ORDER + 1 : e + 1] for e in ends.tolist()]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(gram, n) of all n-grams of the highest order in ``text``: added up in each task, then sharded by n-gram."""

    def summed(found: Counter):
        distinct = list(found)
        joined, ends, which, sizes = windows(distinct)
        weight = np.repeat(np.fromiter(found.values(), np.int64, len(distinct)), sizes)
        n = np.bincount(which, weight, len(ends)).astype(np.int64)
        for i in range(0, len(ends), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(grams(joined, ends[i : i + 65536])), pa.array(n[i : i + 65536])], ["gram", "n"])

    def counted(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(units(text))
                if len(found) > HELD_UNITS:
                    yield from summed(found)
                    found.clear()
        if found:
            yield from summed(found)

    local = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(counted), "gram string, n long")
    return local.groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ of modified Kneser-Ney from how many n-grams occur once to four times."""
    n = [0.0] * 5
    for row in counts.filter("n <= 4").groupBy("n").count().collect():
        n[row.n] = float(row["count"])
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5
        out.append(min(max(d, 0.05), k - 0.05))
    return tuple(out)


def _suffix(gram: str = "gram"):
    return F.expr(f"substring({gram}, 2)")


def probabilities(counts: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], float]:
    """For orders 1 to ORDER, materialised: (gram, p) of the seen n-grams and (h, backoff) of the seen contexts;
    and the uniform probability below them.

    ``counts``: materialised (gram, n). Lower orders count the distinct symbols
    seen before an n-gram (continuation counts).
    """
    levels = [counts]
    for _ in range(ORDER - 1):
        levels.append(materialize(levels[-1].groupBy(_suffix().alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    uniform = 1.0 / (levels[-1].count() + 1)
    out: list[tuple[DataFrame, DataFrame]] = []
    below = None
    for k, level in enumerate(reversed(levels), 1):
        d = _discounts(level)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        seen = level.select("gram", "n", F.expr(f"substring(gram, 1, {k - 1})").alias("h"), cut.alias("cut"))
        contexts = materialize(seen.groupBy("h").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("backoff")))
        joined = seen.join(_few(contexts), "h")
        if below is None:
            joined = joined.withColumn("lower", F.lit(uniform))
        else:
            joined = joined.withColumn("suffix", _suffix()).join(_few(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))), "suffix")
        below = materialize(joined.select("gram", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("backoff") * F.col("lower")).alias("p")))
        out.append((below, contexts.select("h", "backoff")))
    return out, uniform


def _few(grams_: DataFrame) -> DataFrame:
    """A materialised table, to be broadcast if counting it shows that it is small."""
    return F.broadcast(grams_) if grams_.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else grams_


def look_up(asked: DataFrame, model: tuple[list[tuple[DataFrame, DataFrame]], float]) -> DataFrame:
    """(gram, bits) of distinct n-grams of the highest order, materialised; ``asked`` is so too."""
    levels, uniform = model
    left = asked.select("gram", F.col("gram").alias("at"), F.lit(0.0).alias("bits"))
    done: list[DataFrame] = []
    for k in range(ORDER, 0, -1):
        seen, contexts = levels[k - 1]
        found = left.join(_few(seen.select(F.col("gram").alias("seen"), "p")), F.col("at") == F.col("seen"), "left")
        found = found.select("gram", "at", "bits", "p", F.expr(f"substring(at, 1, {k - 1})").alias("context"))
        found = materialize(found.join(_few(contexts), F.col("context") == F.col("h"), "left").select("gram", "at", "bits", "p", "backoff"))
        done.append(found.filter("p is not null").select("gram", (F.col("bits") - F.log2("p")).alias("bits")))
        left = found.filter("p is null").select("gram", _suffix("at").alias("at"), (F.col("bits") - F.log2(F.coalesce("backoff", F.lit(1.0)))).alias("bits"))
    out = left.select("gram", (F.col("bits") - float(np.log2(uniform))).alias("bits"))
    for part in done:
        out = out.unionByName(part)
    return materialize(out)


_BLOCKS = "block long, shard int, units binary, docs binary"
_INFO = pa.schema([*[(c, pa.int64()) for c in ROW], ("lang", pa.string()), ("n_units", pa.int64())])


def _pack(data: bytes) -> bytes:
    """Compressed, behind its length."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", ZSTD).compress(data, asbytes=True)


def _unpack(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, "zstd", asbytes=True) if size else b""


def _points(joined: str, ends: np.ndarray) -> list[np.ndarray]:
    """The first code points of the n-grams, their second ones, and so on."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return [points[ends - k] for k in range(ORDER - 1, -1, -1)]


def _sharded(joined: str, ends: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, which n-grams are its own), in the order of shard and n-gram."""
    of = np.array([zlib.crc32(g.encode()) % shards for g in grams(joined, ends)], np.int64)
    order = np.lexsort([*reversed(_points(joined, ends)), of])
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [(int(of[part[0]]), part) for part in np.split(order, cuts) if len(part)]


class _Numbers(dict):
    """Numbers units in the order in which they are met."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by their lowest bytes, then the next ones, and so on: the higher ones compress well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _joint(joined: str, ends: np.ndarray) -> bytes:
    """N-grams in their order: all their first code points, then the second ones, and so on, which compress well."""
    return _pack(np.concatenate(_points(joined, ends)).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"))


def _split(packed: bytes) -> list[str]:
    text = _unpack(packed).decode("utf-8", "surrogatepass")
    n = len(text) // ORDER
    return list(map("".join, zip(*(text[k * n : k * n + n] for k in range(ORDER)))))


def _blocks(shards: int):
    """Rows of a block: one of shard -1 with its units and documents, and one per shard with the n-grams asked of it."""

    def flush(block: int, number: _Numbers, rows: list[tuple], held: list[np.ndarray]):
        distinct = list(number)
        joined, ends, _, _ = windows(distinct)
        flat = np.concatenate(held) if held else np.zeros((0, 2), np.uint32)
        info = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INFO)], schema=_INFO)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _INFO) as out:
            out.write_table(info)
        body = sink.getvalue().to_pybytes()
        docs = len(body).to_bytes(8, "little") + body + _planes(flat[:, 0].copy()) + _planes(flat[:, 1].copy())
        packed = [(block, -1, _pack(END.join(distinct).encode("utf-8", "surrogatepass")), _pack(docs))]
        if distinct:
            packed += [(block, s, _joint(joined, ends[part]), None) for s, part in _sharded(joined, ends, shards)]
        columns = list(zip(*packed))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["block", "shard", "units", "docs"])

    def blocks(batches):
        block, chars = TaskContext.get().partitionId() << 24, 0
        number = _Numbers()
        rows, held = [], []
        for batch in batches:
            for a, b, c, lang, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                found = Counter(units(text))
                at = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
                order = at.argsort()
                at = at[order]
                at[1:] -= at[:-1].copy()
                held.append(np.stack([at, np.fromiter(found.values(), np.int64, len(found))[order]], axis=1).astype(np.uint32))
                rows.append((a, b, c, lang, len(found)))
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    yield flush(block, number, rows, held)
                    block, chars, number, rows, held = block + 1, 0, _Numbers(), [], []
        if rows:
            yield flush(block, number, rows, held)

    return blocks


def _distinct(pdf: pd.DataFrame) -> pd.DataFrame:
    found: set[str] = set()
    for x in pdf.units:
        found.update(_split(x))
    return pd.DataFrame({"gram": list(found)})


def _answer(asks: pd.DataFrame, scored: pd.DataFrame) -> pd.DataFrame:
    steps = dict(zip(scored.gram, np.clip(np.rint(scored.bits.to_numpy() * STEPS), 0, 255).astype(np.uint8).tolist()))
    return pd.DataFrame({"block": asks.block, "shard": asks.shard, "steps": [_pack(bytes(map(steps.__getitem__, _split(x)))) for x in asks.units]})


def _summed(shards: int):
    def summed(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for packed, docs in zip(blocks.units, blocks.docs):
            docs = _unpack(docs)
            size = int.from_bytes(docs[:8], "little")
            with pa.ipc.open_stream(docs[8 : 8 + size]) as stream:
                info = stream.read_all()
            half = (len(docs) - 8 - size) // 2
            at, times = _unplaned(docs[8 + size : 8 + size + half]), _unplaned(docs[8 + size + half :])
            text = _unpack(packed).decode("utf-8", "surrogatepass")
            distinct = text.split(END) if text else []
            n_units = info.column("n_units").to_numpy()
            bits, symbols = np.zeros(len(n_units)), np.zeros(len(n_units), np.int64)
            if distinct:
                joined, ends, which, sizes = windows(distinct)
                steps, given = np.zeros(len(ends), np.int64), dict(zip(answers.shard, answers.steps))
                for s, part in _sharded(joined, ends, shards):
                    steps[part] = np.frombuffer(_unpack(given[s]), np.uint8)
                per_unit = np.add.reduceat(steps[which], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                sizes = sizes - np.fromiter((u == AGAIN for u in distinct), np.int64, len(distinct))  # one symbol, no end
                of = np.repeat(np.arange(len(n_units)), n_units)
                total = np.cumsum(at)
                begins = np.concatenate([[0], np.cumsum(n_units)])[:-1]
                before = np.concatenate([[0], total])[begins]
                at = total - before[of]
                bits = np.bincount(of, per_unit[at] * times, len(n_units)) / STEPS
                symbols = np.bincount(of, sizes[at] * times, len(n_units)).astype(np.int64)
            frame = info.drop_columns(["n_units"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            out.append(frame.assign(n_symbols=symbols, bits=bits))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in [*ROW, "lang", "n_symbols", "bits"]})

    return summed


def bits(docs: DataFrame, model: tuple[list[tuple[DataFrame, DataFrame]], float]) -> DataFrame:
    """The row key, lang, n_symbols and the sum of bits of every row."""
    shards = max(shuffle_partitions(docs.sparkSession), model[0][-1][0].count() // SHARD_GRAMS)
    rows = docs.select(*row_key(), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    blocks = materialize(rows.mapInArrow(lean(_blocks(shards)), _BLOCKS))
    asks = blocks.filter("shard >= 0").select("block", "shard", "units")
    scored = look_up(materialize(asks.groupBy("shard").applyInPandas(lean_groups(_distinct), "gram string")), model)
    tidy(docs.sparkSession)  # what the look-up shuffled goes before the blocks are shuffled
    by_shard = scored.withColumn("shard", (F.crc32(F.col("gram").cast("binary")) % shards).cast("int")).groupBy("shard")
    answers = asks.groupBy("shard").cogroup(by_shard).applyInPandas(lean_groups(_answer), "block long, shard int, steps binary")
    waiting = blocks.filter("shard < 0").select("block", "units", "docs").groupBy("block")
    schema = ", ".join(f"{c} long" for c in ROW) + ", lang string, n_symbols long, bits double"
    return waiting.cogroup(answers.groupBy("block")).applyInPandas(lean_groups(_summed(shards)), schema)


def train(trusted: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], float]:
    """The model of all ``text`` in ``trusted``."""
    model = probabilities(materialize(count_ngrams(trusted)))
    tidy(trusted.sparkSession)
    return model


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The row key, n_symbols, perplexity, limit and kept of every row; see the module's text.

    ``labels``: doc_id and quality; quality 1 makes a document trusted.
    """
    ids = materialize(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    held_out = F.pmod(F.col(ROW[1]), F.lit(HELD)) == 0
    model = train(join_ids(docs, ids, "left_semi").select("text", *row_key()).filter(~held_out))
    scored = materialize(bits(docs, model))
    trusted = scored.join(ids, F.col(ROW[0]) == ids.doc_id, "left_semi").filter("n_symbols > 0")
    if trusted.filter(held_out).limit(LEAST).count() >= LEAST:
        trusted = trusted.filter(held_out)
    mean = trusted.agg(F.sum("bits") / F.sum("n_symbols")).first()[0]
    mean = 6.0 if mean is None else float(mean)
    steady = (F.col("bits") + PRIOR * mean) / (F.col("n_symbols") + PRIOR)
    q = F.percentile_approx("mean_bits", [MEDIAN, UPPER], 10000)
    upper = lambda c: F.element_at(c, 2) + MARGIN * (F.element_at(c, 2) - F.element_at(c, 1))
    held = trusted.select(F.coalesce("lang", F.lit("")).alias("of"), steady.alias("mean_bits"))
    total = held.agg(q.alias("q")).select(upper("q")).first()[0]
    total = float("inf") if total is None else float(total)
    by_lang = held.groupBy("of").agg(q.alias("q"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST).select("of", upper("q").alias("most"))
    found = scored.withColumn("of", F.coalesce("lang", F.lit(""))).join(F.broadcast(by_lang) if by_lang.limit(10_001).count() <= 10_000 else by_lang, "of", "left")
    limit = F.pow(F.lit(2.0), F.coalesce("most", F.lit(total)))
    perplexity = F.pow(F.lit(2.0), steady)
    return found.select(*ROW, "n_symbols", perplexity.alias("perplexity"), limit.alias("limit"), (perplexity <= limit).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_symbols, perplexity, limit and kept of every row."""
    return judged(docs, labels).withColumnRenamed(ROW[0], "doc_id").select("doc_id", "n_symbols", "perplexity", "limit", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, repeated ones too, with all their columns."""
    dropped = materialize(judged(docs, labels).filter("not kept").select(*ROW))
    return drop_rows(docs, dropped, dropped.limit(0))
