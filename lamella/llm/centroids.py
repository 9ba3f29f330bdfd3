"""Centroid clustering with heap-ordered bounds.

Vectors are turned into whole numbers, so that sums, centroids (floors of means) and squared distances are exact.

A vector that is scanned gets its nearest centroid and the gap between the distances to the second nearest and to it.  When
centroids move, the gap shrinks by at most the cluster's drift: its centroid's way plus the longest way of any other.  Each cluster
adds its drifts up, and a vector's key is its gap plus what its cluster had added up when it was scanned.  As drifts only
add up, a vector is safe as long as its key exceeds its cluster's sum, and the keys of a cluster order its vectors by when they expire.

A round writes one generation: the vectors scanned in it.  Its rows stay where they are for good.  What the next round must
scan are, of every generation, the rows whose key lies between the cluster's last sum and the new one: that filter reaches the
files.  A task takes such rows into a heap a cluster and pops those that are due; popped vectors are compared with all
centroids.  Centroids' sums change by the vectors that changed their cluster, added up per batch before they are
shuffled, so a round's work follows the vectors that expire.  The driver holds centroids only (k x d numbers).

Cases: vectors with another number of components, null or non-finite ones are left out; so are components of 2**24 or more, and
null ids, which no result can name.  Rows that repeat an id are vectors of their own (one of them may start a centroid).  Fewer
vectors than clusters give as many clusters as vectors; an empty table no rows.  Ties go to the smaller cluster number.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune

#: Distances are floats: keys this close to a sum count as expired.
SLACK = 1e-6
GENERATION = "vec_id long, v array<int>, was int, cluster int, key double"
_FIELDS = [("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("was", pa.int32()), ("cluster", pa.int32()), ("key", pa.float64())]


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors that count."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < 2.0**24))
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") == dims) & fine)
    return d.select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("int")).alias("v"))


def squares(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to each centroid."""
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), dims)


def scan(v: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and its key: how far the second nearest is behind, plus the cluster's drift so far."""
    d = squares(v, centroids)
    own = d.argmin(1)
    near = d[np.arange(len(d)), own]
    if len(centroids) == 1:
        return own, np.full(len(d), np.inf)
    d[np.arange(len(d)), own] = np.iinfo(np.int64).max
    return own, np.sqrt(d.min(1)) - np.sqrt(near) + drift[own]


def due(cluster: np.ndarray, key: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Rows whose gap is used up: popped from a heap a cluster until its least key exceeds the cluster's drift."""
    out = []
    for c in np.unique(cluster):
        at = np.flatnonzero(cluster == c)
        heap = list(zip(key[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(heap)
        while heap and heap[0][0] <= drift[c] + SLACK:
            out.append(heapq.heappop(heap)[1])
    return np.sort(np.array(out, np.int64))


def _rescan(centroids: np.ndarray, drift: np.ndarray):
    def run(batches):
        for batch in batches:
            was = np.asarray(batch.column("cluster"))
            at = due(was, np.asarray(batch.column("key")), drift)
            if len(at):
                batch, was = batch.take(pa.array(at)), was[at]
                own, key = scan(_vectors(batch.column("v"), centroids.shape[1]), centroids, drift)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(was), pa.array(own.astype(np.int32)), pa.array(key)], schema=pa.schema(_FIELDS))

    return run


def _first_scan(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own, key = scan(_vectors(batch.column("v"), centroids.shape[1]), centroids, np.zeros(len(centroids)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(np.full(len(own), -1, np.int32)), pa.array(own.astype(np.int32)), pa.array(key)], schema=pa.schema(_FIELDS))

    return run


def _moves(dims: int):
    """Per batch and cluster the number and componentwise sum of the vectors that came, less those that left."""

    def run(batches):
        for batch in batches:
            v, was, own = _vectors(batch.column("v"), dims), np.asarray(batch.column("was")), np.asarray(batch.column("cluster"))
            moved = was != own
            v, was, own = v[moved], was[moved], own[moved]
            for c in np.union1d(was, own):
                if c >= 0:
                    n = int((own == c).sum() - (was == c).sum())
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([[n, *(v[own == c].sum(0) - v[was == c].sum(0)).tolist()]], pa.list_(pa.int64()))], names=["cluster", "s"])

    return run


def _add_moves(total: np.ndarray, generation: DataFrame) -> np.ndarray:
    """``total`` (a row a cluster: number, sums) after the moves of a generation; k * (d + 1) numbers come to the driver."""
    part = generation.where("was <> cluster").select("v", "was", "cluster").mapInArrow(_moves(total.shape[1] - 1), "cluster int, s array<long>")
    total = total.copy()
    for r in part.select("cluster", F.posexplode("s").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect():
        total[r["cluster"], r["i"]] += r["s"]
    return total


def _above(drift: np.ndarray):
    """The row's key is beyond its cluster's drift."""
    return F.col("key") > F.element_at(F.array(*(F.lit(float(x)) for x in drift + SLACK)), F.col("cluster") + 1)


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster) of each vector after ``rounds`` of assigning and moving centroids and a last assignment, and the centroids.

    Centroids start as the k vectors with the least sha256 of ``seed``:id.
    """
    tune(df.sparkSession)
    vectors = whole_vectors(df, id_col, vec_col, dims, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.withColumn("h", name).orderBy("h", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    if not len(first):
        return vectors.withColumn("cluster", F.lit(0)), centroids
    drift, total = np.zeros(len(first)), np.zeros((len(first), dims + 1), np.int64)
    generations = [materialize(vectors.mapInArrow(_first_scan(centroids), GENERATION), "clusters")]
    for _ in range(rounds):
        total = _add_moves(total, generations[-1])
        moved = np.where(total[:, :1] > 0, total[:, 1:] // np.maximum(total[:, :1], 1), centroids)
        way = np.sqrt(((moved - centroids) ** 2).sum(1))
        others = np.array([np.delete(way, c).max(initial=0.0) for c in range(len(way))])
        last, drift, centroids = drift, drift + way + others, moved
        expired = None
        for n, g in enumerate(generations):
            g = g.where(~_above(drift) if n == len(generations) - 1 else _above(last) & ~_above(drift))
            expired = g if expired is None else expired.unionByName(g)
        generations.append(materialize(expired.mapInArrow(_rescan(centroids, drift), GENERATION), "clusters"))
    live = generations[-1]
    for g in generations[:-1]:
        live = live.unionByName(g.where(_above(drift)))
    return live.select("vec_id", "v", "cluster"), centroids


def inertias(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""

    def run(batches):
        for batch in batches:
            v, own = _vectors(batch.column("v"), centroids.shape[1]), np.asarray(batch.column("cluster"))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(((v - centroids[own]) ** 2).sum(1))], names=["vec_id", "cluster", "distance"])

    d = materialize(assigned.mapInArrow(run, "vec_id long, cluster int, distance long"), "cluster-distances") if len(centroids) else assigned.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance"))
    by = d.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    total = sum(r["cluster_inertia"] for r in by)
    sha = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    own = {r["cluster"]: r["cluster_inertia"] for r in by}
    table = d.sparkSession.createDataFrame([(c, own.get(c, 0), total, h) for c, h in sha], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return d.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark, sf_dir):
    """Sixteen clusters of all ``embeddings``, three rounds."""
    return inertias(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
