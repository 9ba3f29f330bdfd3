"""What the corpus operators share: the shared folder, cut lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds on one Arrow batch, so that a Python worker holds a few MB of text at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a temporary folder serves a local master, and others raise: their machines share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lamella-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps then depend on replicated files and not on shuffle output of executors that may be lost,
    and what two of them read is computed once.
    """
    path = shared_dir(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    schema = df.schema
    if by:  # a partition column is read last
        schema = type(schema)([f for f in schema if f.name != by] + [f for f in schema if f.name == by])
    return df.sparkSession.read.schema(schema).parquet(path)


#: Rows up to which a table of narrow rows (a key and some numbers) is broadcast.
SMALL_ROWS = 200_000


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", rows: int = SMALL_ROWS) -> DataFrame:
    """``left`` joined with ``right``, a written table of narrow rows: broadcast where it has at most ``rows`` rows, else by shuffle."""
    small = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right, on, how)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner", most: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``weight`` how many rows of ``left`` have that key.

    Keys with more than a ``most``-th of all rows (fewer than ``most`` keys) are broadcast, so that their rows stay where they are;
    the others are shuffled.  Both tables are written ones, as they are read twice.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(weight) > total // most).drop(weight))
    cold = right.where(F.col(weight) <= total // most).drop(weight)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return left.join(hot, on).unionByName(rest)


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); component is the smallest node reached.

    Alternating large-star and small-star steps: each is a minimum per node and a join, never a list of
    neighbours, so that a hub with very many neighbours costs what its edges cost.  Every round is written
    to the shared folder.  Raises if ``max_rounds`` do not suffice (rounds grow with the logarithm of the nodes).
    """
    e = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u, are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        # converged when the edges are stars: each node has one edge and no centre is a leaf
        state = e.agg(F.count("*").alias("n"), F.countDistinct("u").alias("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
    else:
        raise RuntimeError(f"components: no fixpoint after {max_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
