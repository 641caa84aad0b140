"""Connected components of a graph given by links between long ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcut.llm.common import stored


class Forest:
    """Union-find over hashable nodes; the root of a tree is its smallest node."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, top)
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        nodes = list(forest.up)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["a", "b"]
        )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (columns a, b) but the roots; root is the smallest node.

    Each batch of links is first replaced by stars. Then two steps alternate until nothing changes:
    every node hands its larger neighbours to its smallest one, then its smaller ones. Minima are
    taken before the shuffle and hot nodes fall into skew joins, so no task holds a node's links.
    Each step is a written table; rounds grow with the logarithm of a component's diameter.
    """
    pairs = stored(links.where("a <> b").mapInArrow(_shorten, "a long, b long"), "links")
    state = None
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        larger = stored(larger.distinct(), "links_larger")
        lowest = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stored(smaller.union(lowest.select("a", "m")).distinct(), "links")
        found = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = found
