"""Connected components of edge tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Edges up to which one task joins them up; they are counted first.
FEW = 1 << 18


def _joined_up(batches):
    """Union-find over all edges of the task: (node, root), the root being the smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for p, q in zip(b.column("p").to_pylist(), b.column("q").to_pylist(), strict=True):
            x, y = root(p), root(q)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW, most: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (p, q: long): root is the smallest node reached.

    More than ``few`` edges are joined up in rounds, each of which links every node's neighbours to the smallest of them, first the
    larger and then the smaller ones.  Raises if ``most`` rounds do not suffice; they grow with the logarithm of the nodes.
    """
    e = settle(edges.where("p <> q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct())
    n = e.count()
    if n <= few:
        return e.select(F.col("u").alias("p"), F.col("v").alias("q")).coalesce(1).mapInArrow(_joined_up, "node long, root long")
    before = None
    for _ in range(most):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        e, before = new, now
    raise RuntimeError(f"components: no fixpoint after {most} rounds")
