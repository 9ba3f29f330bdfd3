"""Volumes, stacks and images derived from the given tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, x, y, z, hu): each label a series, each vector an 8 x 8 slice in order of vec_id."""
    e = table(spark, sf_dir, "embeddings")
    s = e.select(F.col("label").alias("series"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("z"), "embedding")
    v = s.select("series", "z", F.posexplode("embedding").alias("i", "e"))
    hu = F.floor(F.col("e").cast("double") * 4000 + 0.5)
    return v.select("series", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "z", hu.alias("hu"))


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, z, value): one slice for each line item, z in half millimetres a day, several may share a place."""
    li = table(spark, sf_dir, "lineitem")
    z = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) * 0.5
    return li.select(F.col("l_suppkey").alias("series"), z.alias("z"), (F.col("l_extendedprice") / 10 - 1000).alias("value"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("at"))


def series_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header-level descriptions of series from ``part``."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        k.alias("id"), F.col("p_brand").alias("study"), (F.col("p_size") * 8).alias("frames"), F.when(k % 5 == 0, 96).otherwise(512).alias("rows_"),
        F.when(k % 11 == 0, None).otherwise((k % 9 + 1) * 0.6).alias("spacing"), F.when(k % 13 == 0, None).otherwise((k % 4 + 1) * 0.25).alias("in_plane"),
        F.when(k % 22 == 0, None).otherwise((k % 5 + 1) * 0.8).alias("thickness"), (k % 3).cast("int").alias("axis"), (k % 7 == 0).alias("irregular"), (k % 17 != 0).alias("has_positions"), (k % 6 == 0).alias("lossy"), (k % 19 == 0).alias("derived"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, x, y, v): 64 vectors tiled to a 64 x 64 image of grays 0 to 255; what no vector fills is black."""
    e = table(spark, sf_dir, "embeddings")
    e = e.select((F.floor(F.col("vec_id") / 64)).alias("img"), (F.col("vec_id") % 64).cast("int").alias("t"), "embedding")
    whole = e.select("img").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(63)))).join(e, ["img", "t"], "left")
    dark = F.array_repeat(F.lit(-0.6), 64)
    p = whole.select("img", "t", F.posexplode(F.coalesce(F.col("embedding").cast("array<double>"), dark)).alias("i", "e"))
    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("e").cast("double") + 0.6) / 1.2 * 255))
    return p.select("img", ((F.col("t") % 8) * 8 + F.col("i") % 8).alias("x"), (F.floor(F.col("t") / 8) * 8 + F.floor(F.col("i") / 8)).cast("int").alias("y"), F.floor(v + 0.5).alias("v"))


def plan_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of series with places and makers from ``part``, three a study."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    tilted, none = k % 5 == 0, F.lit(None).cast("double")

    def part(main, side):
        return F.when(k % 29 == 0, none).when(k % 3 == main, F.when(tilted, 0.8).otherwise(1.0)).when((k % 3 == side) & tilted, 0.6).otherwise(0.0)

    pick = lambda values, at: F.element_at(F.array(*(F.lit(v) for v in values)), at.cast("int") + 1)
    px0 = (k % 4 + 1) * 0.25
    box = [e.alias(n) for c, (m, f, w) in {"x": (4, 20, 100), "y": (3, 15, 120), "z": (5, 10, 90)}.items() for n, e in ((f"{c}0", (k % m * f).cast("double")), (f"{c}1", (k % m * f + w).cast("double")))]
    return p.select(
        k.alias("id"), F.floor(k / 3).alias("study"), F.col("p_name").alias("description"), F.when(k % 4 == 1, None).otherwise(k % 6).alias("series_number"), F.when(k % 10 == 0, 5).otherwise(8 + F.col("p_size")).alias("frames"), F.when(k % 17 == 0, 96).otherwise(512).alias("rows_"),
        F.when(k % 19 == 0, "sr").when(k % 7 == 0, "MR").when(k % 31 == 0, "").otherwise("CT").alias("modality"), (k % 23 == 0).alias("colour"), F.when(k % 11 == 0, none).otherwise((k * 7 % 9 + 1) * 0.6).alias("spacing"), F.when(k % 22 == 0, none).otherwise((k * 5 % 6 + 1) * 0.5).alias("thickness"),
        px0.alias("px0"), F.when(k % 13 == 0, none).otherwise(px0 + k % 3 * 0.05).alias("px1"), part(0, 2).alias("nx"), part(1, 0).alias("ny"), part(2, 1).alias("nz"), *box,
        F.when(k % 7 == 0, None).when(k % 8 == 0, "G").otherwise("F").alias("frame_of_reference"), pick(("Planmeca", "GE MEDICAL", "i-CAT", "Siemens", "X-Ray Co", None), k % 6).alias("maker"), pick(("1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.4.91", "1.2.840.10008.1.2.4.70"), k % 4).alias("syntax"),
    )


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of slices from ``lineitem``, a series for each supplier."""
    li, k, n = table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.col("l_linenumber")
    at = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_quantity"))
    z = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) * 0.5
    zero, one = F.lit(0.0), F.lit(1.0)
    cy, cz = (F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c) for a, b, c in ((1.0, 0.8, 0.6), (0.0, 0.6, 0.8)))
    return li.select(
        k.alias("series"), at.alias("at"), F.when(n % 5 == 0, 256).otherwise(512).alias("rows_"), F.lit(512).alias("cols"), F.when((k % 9 == 0) & (n == 3), None).otherwise(k % 7 * 3.0).alias("px"), (k % 5 * 2.0).alias("py"), z.alias("pz"), one.alias("rx"), zero.alias("ry"), zero.alias("rz"), zero.alias("cx"), cy.alias("cy"), cz.alias("cz"),
        F.lit(0.5).alias("ps0"), F.lit(0.5).alias("ps1"), n.alias("instance"), n.alias("frames"), F.when(k % 4 == 0, None).otherwise(2.5).alias("thickness"),
    )
