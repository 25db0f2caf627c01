"""Exact top-k search by integer inner product, exhaustive and term at a time.

Vectors become sparse rows of integers (``floor(256 * x)``); a component's place
is a term. Candidates are packed into blocks that hold a posting list for each
term (the vectors with a weight there, and the weights). A query takes its terms
one after the other and adds its weight times each posting's to one dense array
of scores per block; a partition selection keeps the k best of the block, and
merges keep the k best of a cell and of the whole.

Blocks of queries and blocks of candidates meet in a grid of cells: a block of
candidates goes to each column, a block of queries to each row of the grid, so
that a task holds one part of either side. The grid follows the number of
scores; nothing is sent to the driver but two counts. The queries are a stated
set of rows; every one of them meets every candidate in exactly one cell.

Defined results: vectors that are null or hold null, NaN or infinite components
take no part; components beyond the range of a long are held to it, and sums
wrap around it; vectors of different lengths share the terms that both have; an
empty vector scores zero everywhere; a null vec_id is no query and comes last
among ties; rows that repeat an id are rows of their own, each a candidate of
the others; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import lean, shuffle_partitions

K = 5
EVERY = 50
SCALE = 256
#: Vectors of a block of candidates: its scores stay in a core's cache. Queries of a block.
BLOCK, QUERIES = 4_096, 512
#: Scores that one cell of the grid makes at most, while there are more cells to be had.
CELL_SCORES = 1 << 29

CANDIDATE, QUERY = 1, 0  # a cell reads its queries first
_PACKED = "kind int, part long, vec_ids array<long>, rows array<long>, ends array<long>, vals array<long>"
_FOUND = "query_id long, query_row long, vec_id long, row long, score long"


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of finite components as longs."""
    broken = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    finite = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).filter(F.col("x").isNotNull() & ~broken)
    return finite.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


def _packed(every: int):
    """Blocks of candidates and, from the same rows, blocks of the queries among them. A row's number is its place in its partition."""

    def block(kind, number, vec_ids, rows, lists):
        ends = np.cumsum([len(v) for v in lists])
        vals = np.concatenate(lists) if lists else np.empty(0, np.int64)
        columns = [pa.array([kind], pa.int32()), pa.array([number], pa.int64()), pa.array([vec_ids], pa.list_(pa.int64())), *[pa.array([x], pa.list_(pa.int64())) for x in (rows, ends, vals)]]
        return pa.RecordBatch.from_arrays(columns, ["kind", "part", "vec_ids", "rows", "ends", "vals"])

    def task(batches):
        part, at = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list, list, int]] = {CANDIDATE: ([], [], [], BLOCK), QUERY: ([], [], [], QUERIES)}
        sent = {CANDIDATE: 0, QUERY: 0}
        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                vector = vector.values.to_numpy()
                for kind in (CANDIDATE, QUERY) if vec_id is not None and vec_id % every == 0 else (CANDIDATE,):
                    ids, rows, lists, most = held[kind]
                    ids.append(vec_id)
                    rows.append((part << 33) + at)
                    lists.append(vector)
                    if len(ids) >= most:
                        yield block(kind, part + sent[kind], ids, rows, lists)
                        sent[kind] += 1
                        held[kind] = ([], [], [], most)
                at += 1
        for kind, (ids, rows, lists, _) in held.items():
            if ids:
                yield block(kind, part + sent[kind], ids, rows, lists)

    return lean(task)


class Block:
    """A block of candidates in the order of their ids (null last), with its posting lists."""

    def __init__(self, vec_ids: list, rows: np.ndarray, ends: np.ndarray, vals: np.ndarray):
        order = np.array(sorted(range(len(vec_ids)), key=lambda i: (vec_ids[i] is None, vec_ids[i] or 0, rows[i])), np.int64)
        lengths = np.diff(ends, prepend=0)
        term = np.arange(len(vals)) - np.repeat(ends - lengths, lengths)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner = np.repeat(place, lengths)
        held = vals != 0
        term, owner, weight = term[held], owner[held], vals[held]
        by = np.lexsort((owner, term))
        term, owner, weight = term[by], owner[by], weight[by]
        cuts = np.flatnonzero(np.diff(term, prepend=-1))
        #: term: (places or a slice that holds them all, weights)
        self.postings = {int(term[lo]): (slice(None) if hi - lo == len(order) else owner[lo:hi], weight[lo:hi]) for lo, hi in zip(cuts, [*cuts[1:], len(term)])}
        self.vec_ids = [vec_ids[i] for i in order]
        self.rows = np.asarray(rows)[order]
        self.scores = np.empty(len(order), np.int64)

    def top(self, terms: list[tuple[int, int]], own: int, k: int) -> list[tuple[int, int]]:
        """(score, place) of the k best against a sparse query, ties to the smaller id; the row ``own`` is left out."""
        scores, postings = self.scores, self.postings
        scores[:] = 0
        for term, weight in terms:
            if term in postings:
                places, weights = postings[term]
                scores[places] += weights * weight
        left = np.flatnonzero(self.rows != own)
        if len(left) > k:
            among = scores[left]
            least = np.partition(among, len(left) - k)[len(left) - k]
            above = left[among > least]
            left = np.concatenate([above, left[among == least][: k - len(above)]])
        return [(int(scores[i]), int(i)) for i in left]


def _searched(k: int):
    """A cell after the other: its queries are held, candidates stream by in blocks, the k best of each query leave."""

    def task(batches):
        queries: list[tuple] = []  # (id, row, terms, best so far)
        now = None

        def out():
            rows = [(q[0], q[1], vec_id, row, score) for q in queries for score, _, _, vec_id, row in q[3]]
            queries.clear()
            columns = list(zip(*rows)) or [[] for _ in range(5)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "query_row", "vec_id", "row", "score"])

        for batch in batches:
            for cell, kind, ids, rows, ends, vals in zip(*(batch.column(i) for i in range(6))):
                if cell.as_py() != now:
                    if queries:
                        yield out()
                    now = cell.as_py()
                ids, rows, ends, vals = ids.as_py(), rows.values.to_numpy(), ends.values.to_numpy(), vals.values.to_numpy()
                if kind.as_py() == QUERY:
                    for i, (own, hi) in enumerate(zip(rows.tolist(), ends.tolist())):
                        v = vals[ends[i - 1] if i else 0 : hi]
                        terms = np.flatnonzero(v)
                        queries.append((ids[i], own, list(zip(terms.tolist(), v[terms].tolist())), []))
                    continue
                block = Block(ids, rows, ends, vals)
                for _, own, terms, best in queries:
                    for score, i in block.top(terms, own, k):
                        vec_id = block.vec_ids[i]
                        best.append((score, vec_id is None, vec_id or 0, vec_id, int(block.rows[i])))
                    best.sort(key=lambda x: (-x[0], *x[1:3], x[4]))
                    del best[k:]
        if queries:
            yield out()

    return lean(task)


def grid(vectors: int, queries: int, tasks: int) -> tuple[int, int]:
    """(rows, columns): cells of at most ``CELL_SCORES`` scores, as many as there are tasks at least, that copy as little as can be."""
    cells = max(tasks, math.ceil(vectors * queries / CELL_SCORES))
    columns = max(1, round(math.sqrt(cells * queries / max(1, vectors))))
    return math.ceil(cells / columns), columns


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: of every row whose id ``every`` divides, the ``k`` best of all other rows."""
    whole = whole_vectors(vectors, key, vector, scale)
    n, q = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col(key) % every == 0, 1))).first()
    down, across = grid(n, q, shuffle_partitions(vectors.sparkSession))
    packed = whole.mapInArrow(_packed(every), _PACKED)
    row, column = F.pmod("part", F.lit(down)), F.pmod("part", F.lit(across))
    rows, columns = (F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")) for size in (down, across))
    # a candidate block has its row of the grid and goes to every column of it, a query block the other way round
    cells = F.when(F.col("kind") == CANDIDATE, F.transform(columns, lambda c: row * across + c)).otherwise(F.transform(rows, lambda r: r * across + column))
    dealt = packed.select(F.explode(cells).alias("cell"), "kind", "vec_ids", "rows", "ends", "vals").repartitionById(down * across, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind")
    found = dealt.mapInArrow(_searched(k), _FOUND)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT r, vec_id, generate_subscripts(v, 1) AS term, unnest(v) AS w FROM whole),
scores AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.r AS r, c.vec_id, sum(q.w * c.w)::BIGINT AS score
  FROM parts q JOIN parts c ON q.term = c.term AND q.r <> c.r WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, (row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id ASC NULLS LAST))::INT AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""
