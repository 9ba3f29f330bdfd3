"""Queries whose rows come of cells: what Spark takes for few rows is not sent through the driver, and counts hold by bricks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import rules, surface
from lamella.plans.registered import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layer_meshes_broadcasts_no_vertices(spark, sf):
    """Vertices count as few in Spark's estimate, whatever there are of them."""
    assert "Broadcast" not in plan(QUERIES["layer_meshes"](spark, sf))


def test_measures_by_bricks_are_those_of_the_whole(spark):
    """Vertices, edges and triangles that lie across bricks count once; layers and series touch."""
    grid = spark.range(2 * 11 * 10 * 9).select((F.col("id") % 2).alias("series"), F.floor(F.col("id") / 2).alias("k"))
    v = grid.select("series", (F.col("k") % 11).cast("int").alias("x"), (F.floor(F.col("k") / 11) % 10).cast("int").alias("y"), F.floor(F.col("k") / 110).cast("int").alias("z"))
    v = v.withColumn("field", F.sin(F.col("x") * 1.3 + F.col("series")) + F.cos(F.col("y") * 0.9) + F.sin(F.col("z") * 0.7 + F.col("x")))
    v = v.withColumn("label", F.when(F.col("field") > 0.3, F.when(F.col("x") < 6, 1).otherwise(2)).otherwise(0))
    tri = surface.cut(v, "field", "label", side=5).cache()
    want = {}
    for r in tri.collect():
        vids, edges, faces = want.setdefault((r.series, r.layer), ({}, set(), []))
        corners = np.array(r.p).reshape(3, 3)
        vids |= dict(zip((r.a, r.b, r.c), map(tuple, corners)))
        edges |= {tuple(sorted(e)) for e in ((r.a, r.b), (r.b, r.c), (r.c, r.a))}
        faces.append(corners)
    assert len(want) == 4
    spots = surface.vertices(tri, 0)
    for p in spots.collect():
        assert np.abs(np.array([p.x, p.y, p.z]) - want[p.series, p.layer][0][p.vid]).max() < 1e-12
    for side in (2, 5, 64):
        got = {(r.series, r.layer): r for r in surface.measures(tri, spots, side).collect()}
        assert set(got) == set(want)
        for key, (vids, edges, faces) in want.items():
            f, m = np.array(faces), got[key]
            n = np.cross(f[:, 1] - f[:, 0], f[:, 2] - f[:, 0])
            assert (m.vertices, m.edges, m.triangles) == (len(vids), len(edges), len(f))
            assert m.area == pytest.approx(np.linalg.norm(n, axis=1).sum() / 2) and m.volume == pytest.approx((f[:, 0] * n).sum() / 6)
    assert surface.measures(tri.where("false"), spots.where("false")).count() == 0


def test_series_overlap_broadcasts_no_boxes(spark, sf):
    """Boxes count as few in Spark's estimate, whatever cells they cover."""
    assert "Broadcast" not in plan(QUERIES["series_overlap"](spark, sf))


def test_overlap_of_boxes_against_every_pair(spark):
    """Boxes that begin alike, in one cell, far apart, inside each other or in groups of their own."""
    rng = np.random.default_rng(5)
    boxes = []
    for k in range(60):
        low, size = rng.integers(0, 12, 3) * 4.0, rng.integers(1, 9, 3) * 5.0
        boxes.append((k % 3, k, *(float(e) for c in zip(low, low + size) for e in c)))
    got = {(r.a, r.b): r.fraction for r in rules.overlap(spark.createDataFrame(boxes, "g int, id int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")).collect()}
    want = {}
    for g, a, *p in boxes:
        for h, b, *q in boxes:
            p_, q_ = np.reshape(p, (3, 2)), np.reshape(q, (3, 2))
            both = np.maximum(0, np.minimum(p_[:, 1], q_[:, 1]) - np.maximum(p_[:, 0], q_[:, 0])).prod()
            if g == h and a != b and round(both / np.diff(q_).prod(), 6) > 0:
                want[a, b] = both / np.diff(q_).prod()
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
