"""Connected components of a set of links, by alternating large and small stars.

Links are first contracted piece by piece: of at most ``PIECE`` of them a task
keeps one star per component that they make, so few links and few rounds are
left. Every round hangs the larger neighbours of each node, and then its smaller
ones, on the smallest node it knows of; a logarithmic number of rounds leaves
one star per component. Links stay in DataFrames throughout; a round's result
is written to the shared checkpoint folder. Minima are pre-aggregated before
they are shuffled, and joined back over fresh exchanges, whose large partitions
adaptive execution may split; the joins merge, so that the driver builds no
tables to broadcast, round after round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import lean, materialize, tidy

#: Links that a task contracts at once.
PIECE = 1_000_000


def _stars(links: np.ndarray) -> np.ndarray:
    """Rows (node, smallest node of its component) of every node of the links that is not that one."""
    ids, at = np.unique(links, return_inverse=True)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in at.reshape(-1, 2).tolist():
        a, b = find(x), find(y)
        parent[max(a, b)] = min(a, b)
    root = np.fromiter(map(find, range(len(ids))), np.int64, len(ids))
    inner = root != np.arange(len(ids))
    return np.stack([ids[inner], ids[root[inner]]], axis=1)


def _contract(batches):
    held, count = [], 0
    for batch in batches:
        links = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1)
        for lo in range(0, len(links), PIECE):
            held.append(links[lo : lo + PIECE])
            count += len(held[-1])
            if count >= PIECE:
                stars = _stars(np.concatenate(held))
                yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], ["u", "v"])
                held, count = [], 0
    if held:
        stars = _stars(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], ["u", "v"])


def _least(edges: DataFrame) -> DataFrame:
    """The smallest v of each u; the key is renamed by an expression, so that a join deals it anew."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.expr("u | 0L").alias("k"), "m").hint("merge")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    large = both.join(least, both.u == least.k).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
    least = _least(large)
    small = large.join(least, large.u == least.k).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars: each u has one v, and no v is a u."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"))))
    nodes = edges.select(ends.alias("end")).select("end.*").groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.max(F.col("to").isNull()).alias("root"))
    return nodes.filter("lo < hi or (lo is not null and root)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not its component's smallest.

    ``edges``: columns u and v, long, materialised, without nulls and without
    links of a node to itself; direction and repetition don't matter.
    """
    pieces = -(-edges.count() // PIECE)
    edges = materialize(edges.select("u", "v").coalesce(max(1, pieces)).mapInArrow(lean(_contract), "u long, v long"))
    tidy(edges.sparkSession)
    while pieces > 1 and not _settled(edges):
        edges = materialize(_round(edges))
        tidy(edges.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
