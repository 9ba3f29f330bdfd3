"""Structures and curved reformats against phantoms."""

import math

import pytest
from pyspark.sql import functions as F

from lamella.operators import findings, panoramic, segment, structures


def grid(spark, nx, ny, nz):
    g = spark.range(nx * ny * nz).select((F.col("id") % nx).cast("int").alias("x"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("y"), F.floor(F.col("id") / (nx * ny)).cast("int").alias("z"))
    return g.select(F.lit(1).alias("series"), "x", "y", "z")


def within(**edges):
    on = F.lit(True)
    for c, (lo, hi) in edges.items():
        on = on & F.col(c).between(lo, hi)
    return on


def places(df):
    return {(r.x, r.y, r.z) for r in df.collect()}


def test_split_by_touch(spark):
    left, right, bridge = within(x=(1, 6), y=(1, 6), z=(1, 6)), within(x=(10, 15), y=(1, 6), z=(1, 6)), within(x=(7, 9), y=(3, 3), z=(3, 3))
    v = grid(spark, 17, 8, 8).withColumn("label", F.when(left | right | bridge, 2).otherwise(0)).withColumn("hu", F.lit(0))
    hit = spark.createDataFrame([(1, 12, 3, 3)], "series int, hx int, hy int, hz int")
    got = places(structures.split_by_touch(v, hit))
    assert {p for p in got if p[0] >= 10} == places(v.where(right)) and all(p[0] >= 7 for p in got)
    block = v.withColumn("label", F.when(left, 2).otherwise(0))
    assert structures.split_by_touch(block, spark.createDataFrame([(1, 3, 3, 3)], hit.schema)).count() == 0
    assert structures.split_by_touch(block, hit).count() == 0  # nothing was hit
    assert structures.split_by_touch(v.limit(0), hit).count() == 0


def test_split_by_plane(spark):
    v = grid(spark, 8, 4, 4).withColumn("label", F.lit(1)).withColumn("hu", F.lit(0))
    cut = lambda px: spark.createDataFrame([(1, 6, 1, 1, px, 0.0, 0.0, 1.0, 0.0, 0.0)], "series int, hx int, hy int, hz int, px double, py double, pz double, ax double, ay double, az double")
    assert places(structures.split_by_plane(v, cut(4.0))) == places(v.where("x >= 4"))
    assert structures.split_by_plane(v, cut(-1.0)).count() == 0


def test_regrow_to_the_end(spark):
    v = grid(spark, 9, 1, 1).withColumn("owner", F.when(F.col("x") == 0, 5).when(F.col("x") == 8, 7).otherwise(0))
    got = {r.x: r.owner for r in structures.regrow(v).collect()}
    assert got == {x: 5 if x <= 4 else 7 for x in range(9)}  # the first seed wins the place halfway


def test_lower_jaw(spark):
    skull, jaw, bridge = within(x=(1, 18), y=(1, 18), z=(12, 22)), within(x=(2, 17), y=(1, 7), z=(1, 9)), within(x=(4, 4), y=(4, 4), z=(10, 11))
    v = grid(spark, 20, 20, 24).withColumn("label", F.when(skull | jaw | bridge, 1).otherwise(0)).withColumn("hu", F.lit(500))
    small = {"least": 100.0, "most": 5000.0, "tall": 5.0}
    got = structures.lower_jaw(v, bounds=small)
    mine = places(got.where("owner = 2"))
    assert places(v.where(jaw)) <= mine and not mine & places(v.where(skull))
    assert got.count() == v.where("label = 1").count()
    assert structures.lower_jaw(v).where("owner = 2").count() == 0  # too small by the usual bounds


def test_low_density_and_reading(spark):
    block, hole, canal = within(x=(1, 18), y=(1, 18), z=(1, 18)), within(x=(5, 12), y=(5, 12), z=(5, 12)), within(x=(15, 15), y=(15, 15), z=(2, 17))
    v = grid(spark, 20, 20, 20).withColumn("label", F.when(block & ~hole & ~canal, 2).otherwise(0)).withColumn("hu", F.when(F.col("label") == 2, 900).otherwise(10))
    refs = findings.references(v)
    got = findings.low_density(v, refs, least=10).collect()
    assert [(r.voxels, r.mean_hu, r.size_x, r.size_z) for r in got] == [(512, 10, 8, 8)] and got[0].position.startswith("midline, ")
    assert len(findings.low_density(v, refs, least=10, steps=0).collect()) == 2
    lines = {r.section: r.line for r in findings.reading(v, least_jaw=100).collect()}
    assert lines["coverage"].startswith("17 mm high, ") and "mirror overlap" in lines["jaw"] and "parts" not in lines
    assert findings.reading(v.where("x > 99")).count() == 0


def test_label_field_and_enamel(spark):
    v = grid(spark, 3, 1, 1).withColumns({"label": F.col("x"), "field": F.lit(-2.0)})
    assert [r.field for r in structures.label_field(v, 1).orderBy("x").collect()] == [pytest.approx(-0.11), 0.01, pytest.approx(-0.11)]
    v = grid(spark, 9, 1, 1).withColumn("hu", F.when(F.col("x") == 4, 2500).otherwise(0))
    objects = v.select("series", F.when(F.col("x") < 4, 1).otherwise(2).alias("object"), "x", "y", "z").where("x in (0, 2, 8)")
    assert {r.object: (r.near, r.voxels) for r in structures.enamel_near(objects, v, 3000.0).collect()} == {1: (1, 2), 2: (0, 1)}


def test_half_circle(spark):
    points = [(1, n, 32 + 20 * math.cos(math.pi * (1 - n / 8)), 40 - 20 * math.sin(math.pi * (1 - n / 8))) for n in range(9)]
    c = spark.createDataFrame(points, "series int, n int, px double, py double")
    curve = panoramic.arch(c).toPandas()
    assert 61 <= curve.col.max() <= 63 and sorted(curve.col) == list(range(len(curve)))
    far = ((curve.px - 32) ** 2 + (curve.py - 40) ** 2) ** 0.5
    assert (abs(far - 20) < 0.25).all() and (abs(far - 20)[10:-10] < 0.02).all()  # the outermost stretches are flatter
    assert ((curve.px - 32) * curve.ox + (curve.py - 40) * curve.oy > 19).all()  # normals point out
    turned = panoramic.arch(c.withColumn("n", -F.col("n"))).toPandas()
    assert sorted(map(tuple, turned[["col", "px"]].round(6).values)) == sorted(map(tuple, curve[["col", "px"]].round(6).values))
    assert panoramic.arch(c.where("n = 0")).count() == 0 and panoramic.arch(c.limit(0)).count() == 0
    v = grid(spark, 64, 64, 5).withColumn("hu", F.when(F.abs(F.hypot(F.col("x") - 32, F.col("y") - 40) - 20) <= 2.5, 2000).otherwise(-1000))
    dims = spark.createDataFrame([(1, 64, 64, 5)], "series int, nx int, ny int, nz int")
    mip = panoramic.panoramic(v, panoramic.arch(c), dims, 8.0, "mip").toPandas()
    mean = panoramic.panoramic(v, panoramic.arch(c), dims, 8.0).toPandas()
    assert len(mip) == 5 * len(curve) and (mip.value > 1900).all() and (mean.value < 1900).all()
    cross = panoramic.cross_section(v, panoramic.arch(c), dims, 31, 20.0).toPandas().set_index(["row", "c"]).value
    assert len(cross) == 5 * 21 and cross[2, 10] > 1900 and cross[2, 0] == -1000


def test_restorations(spark):
    kind = "series int, object int, kind string, cx double, cy double, cz double"
    o = spark.createDataFrame([(1, 1, "screw", 50.0, 5.0, 5.0), (1, 2, "plate", 10.0, 95.0, 95.0)], kind)
    dims = spark.createDataFrame([(1, 100, 100, 100)], "series int, nx int, ny int, nz int")
    near = spark.createDataFrame([(1, 1, 3, 10)], "series int, object int, near long, voxels long")
    got = {r.object: (r.kind, r.location) for r in segment.describe(o, dims, near).collect()}
    assert got == {1: ("restoration", "midline, lower third, front"), 2: ("plate", "right side, upper third, back")}


def test_growth_crosses_slabs(spark):
    v = spark.range(2 * 3 * 40).select(F.lit(1).alias("series"), (F.col("id") % 2).cast("int").alias("x"), (F.floor(F.col("id") / 2) % 3).cast("int").alias("y"), F.floor(F.col("id") / 6).cast("int").alias("z"))
    v = v.select("*", F.expr("int(z = 7 and x = 0 and y = 0)").alias("on"), F.expr("int(x = 0 and (y = 0 or z > 15))").alias("may"))
    want = structures.grow(v, 12, slab=64).where("on = 1")
    got = structures.grow(v, 12, slab=3).where("on = 1")
    key = lambda d: sorted((r.x, r.y, r.z) for r in d.collect())
    assert key(got) == key(want) == sorted([(0, 0, z) for z in range(0, 20)] + [(0, 1, z) for z in range(16, 19)] + [(0, 2, z) for z in range(16, 18)])
