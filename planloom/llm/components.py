"""Connected components of a graph of long ids, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.tables import settled

#: Edges, counted beforehand, up to which one task joins them at once: 16 bytes each.
SMALL = 250_000


def _with_least_neighbour(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) plus ``least``, the least v of each u and u itself.

    The minima are settled first, so that the join has a shuffle on either side
    and a node with very many neighbours can be split among tasks.
    """
    least = settled(pairs.groupBy("u").agg(F.min("v").alias("least")))
    return pairs.join(least, "u").withColumn("least", F.least("u", "least"))


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of all edges of the partition, by hooking every root to the least root next to it."""
    met = list(batches)
    if not met:
        return
    u, v = (np.concatenate([b.column(i).to_numpy() for b in met]) for i in range(2))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if np.array_equal(x, y):
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, root[root]):
            root = root[root]
    away = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[root[away]])], names=["node", "component"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """Rows (node, component): each node of ``edges`` (u, v) that is not the least of its component.

    A graph of at most ``small`` edges is joined by one task.  A larger one in rounds:

    every round rewires each node's larger neighbours, then its smaller ones, to
    the least node it knows; rounds are logarithmic in the length of the longest
    chain, every round's result is checkpointed, and nothing but a count and a
    checksum reaches the driver.
    """
    stars = settled(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if stars.count() <= small:
        return settled(stars.repartition(1).mapInArrow(_joined, "node bigint, component bigint"))
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = _with_least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        larger = settled(larger)
        known = _with_least_neighbour(larger)
        smaller = known.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        smaller = smaller.unionByName(known.select("u", F.col("least").alias("v"))).distinct()
        stars = settled(smaller)
        mark = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if tuple(mark) == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(mark)
