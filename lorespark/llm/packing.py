"""Packing: cost-balanced filling of fixed-length training sequences.

A document of ``n`` tokens costs ``LINEAR * n + QUADRATIC * n * n`` (projection
and attention work). Within a block of about ``BLOCK_TOKENS`` tokens, whole
sequences are cut from documents longer than a sequence; what remains is
assigned in descending order of cost to the cheapest sequence that has room
left. A document that fits nowhere whole is cut over the cheapest sequences
with room. A block opens exactly as many sequences as its tokens fill, so they
all end full; the few tokens left over go to the partition's next block, and at
its end to sequences whose lengths are powers of two, which need no padding.

The work is one pass over each input partition: no shuffle, and memory bounded
by a block. A lost task is simply run again; its sequence ids follow from the
partition's number, so the input must keep its partitions between retries (a
table scan does).

Defined results: null text counts as empty; an empty document is the single end
id; a null doc_id stays null; repeated rows are packed as often as they occur;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import lean

from lorespark.llm.word_encoder import encoder as worker_encoder

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 4096
END_ID = 2
BLOCK_TOKENS = 2_097_152
LINEAR, QUADRATIC = 1.0, 1.0 / SEQUENCE

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n):
    """Estimated work of one piece of ``n`` tokens."""
    return LINEAR * n + QUADRATIC * n * n


class Packer:
    """Assigns pieces ``(document, start, length)`` to sequences, block by block."""

    def __init__(self, sequence: int = SEQUENCE, first_id: int = 0):
        self.sequence, self.next_id = sequence, first_id

    def block(self, items: list[tuple], last: bool) -> tuple[list[tuple], list[tuple]]:
        """Placed ``(document, start, length, sequence_id, offset)`` and the items left over."""
        size, placed, rest = self.sequence, [], []
        for doc, start, n in items:
            while n >= size:
                placed.append((doc, start, size, self.next_id, 0))
                self.next_id += 1
                start, n = start + size, n - size
            if n:
                rest.append((doc, start, n))
        rest.sort(key=lambda x: -x[2])
        many = sum(x[2] for x in rest) // size
        room = np.full(many, size)
        load = np.zeros(many)
        left = []

        def put(j, doc, start, n):
            placed.append((doc, start, n, self.next_id + j, size - int(room[j])))
            room[j] -= n
            load[j] += cost(n)

        for doc, start, n in rest:
            fits = np.where(room >= n, load, np.inf) if many else room
            j = int(fits.argmin()) if many else 0
            if many and fits[j] < np.inf:
                put(j, doc, start, n)
                continue
            while n and many:
                fits = np.where(room > 0, load, np.inf)
                j = int(fits.argmin())
                if fits[j] == np.inf:
                    break
                cut = min(n, int(room[j]))
                put(j, doc, start, cut)
                start, n = start + cut, n - cut
            if n:
                left.append((doc, start, n))
        self.next_id += many
        if last:
            placed += self.tail(left)
            left = []
        return placed, left

    def tail(self, items: list[tuple]) -> list[tuple]:
        """Fewer tokens than a sequence: one sequence for each power of two in their number."""
        placed, total, at = [], sum(x[2] for x in items), 0
        sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        for doc, start, n in items:
            while n:
                cut = min(n, sizes[0] - at)
                placed.append((doc, start, cut, self.next_id, at))
                start, n, at = start + cut, n - cut, at + cut
                if at == sizes[0]:
                    sizes.pop(0)
                    self.next_id, at = self.next_id + 1, 0
        return placed


def _rows(placed: list[tuple], docs: list) -> pa.RecordBatch:
    """``docs[i]`` is (doc_id, ids)."""
    crc = [zlib.crc32(memoryview(docs[d][1])[4 * s : 4 * (s + n)]) for d, s, n, _, _ in placed]
    column = lambda values: pa.array(values, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            column([docs[x[0]][0] for x in placed]), column([x[1] for x in placed]), column([x[2] for x in placed]), column(crc),
            column([len(docs[x[0]][1]) // 4 for x in placed]), column([x[3] for x in placed]), column([x[4] for x in placed]),
        ],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, sequence: int = SEQUENCE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of every document; see the module's text."""

    def packed(batches):
        encoder = worker_encoder(tokenizer)
        packer = Packer(sequence, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], "<u4").tobytes()
        held, items, tokens = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for doc_id, tok in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    tok += end
                    items.append((len(held), 0, len(tok) // 4))
                    held.append((doc_id, tok))
                    tokens += len(tok) // 4
                if tokens >= block_tokens:
                    placed, left = packer.block(items, last=False)
                    yield _rows(placed, held)
                    kept = {d: k for k, d in enumerate(dict.fromkeys(x[0] for x in left))}
                    held = [held[d] for d in kept]
                    items = [(kept[d], s, n) for d, s, n in left]
                    tokens = sum(x[2] for x in items)
        if items:
            yield _rows(packer.block(items, last=True)[0], held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(packed), SCHEMA)
