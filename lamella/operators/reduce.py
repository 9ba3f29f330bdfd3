"""Thresholds and reductions over voxel rows (series, x, y, z, hu): map-side combined aggregates, no sort of a volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bone_summary(v: DataFrame, threshold: float = 200) -> DataFrame:
    """Count, volume (unit spacing), mean and bounding box of the voxels at or above ``threshold``."""
    edge = [f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))]
    return v.where(F.col("hu") >= threshold).groupBy("series").agg(F.count("*").alias("voxels"), F.count("*").cast("double").alias("volume_mm3"), F.round(F.avg("hu"), 6).alias("mean_hu"), *edge)


def otsu(v: DataFrame, least: int = -300, bins: int = 512) -> DataFrame:
    """Otsu's threshold per series, a whole number: one histogram, then a running sum over its bins."""
    v = v.where(F.col("hu") >= least)
    edge = v.groupBy("series").agg(F.min("hu").alias("lo"), F.max("hu").alias("hi"))
    h = v.join(edge, "series").where("hi > lo").withColumn("bin", F.floor((F.col("hu") - F.col("lo")) * (bins - 1) / (F.col("hi") - F.col("lo")) + 0.5).cast("int"))
    h = h.groupBy("series", "lo", "hi", "bin").agg(F.count("*").alias("n"))
    w = W.partitionBy("series")
    upto = w.orderBy("bin")
    c = h.select("*", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("bin")).over(upto).alias("s0"), F.sum("n").over(w).alias("n_all"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s_all"))
    n1 = F.col("n_all") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s_all") - F.col("s0")) / n1
    c = c.withColumn("between", F.when(n1 > 0, F.round(F.col("n0").cast("double") * n1 * gap * gap, 3)))
    best = c.groupBy("series", "lo", "hi").agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("bin"))
    t = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / (bins - 1)
    return edge.select("series").join(best, "series", "left").select("series", F.coalesce(F.floor(t + 0.5), F.lit(300)).cast("long").alias("threshold"))


def suggest(v: DataFrame, cbct: DataFrame) -> DataFrame:
    """(series, threshold): 200 where air shows that HU are calibrated, else Otsu's.  ``cbct``: series, cbct."""
    low = v.groupBy("series").agg(F.min("hu").alias("low")).join(cbct, "series")
    return low.join(otsu(v), "series").select("series", F.when(~F.col("cbct") & (F.col("low") < -800), F.lit(200)).otherwise(F.col("threshold")).cast("long").alias("threshold"))


def dice(v: DataFrame, a: Column, b: Column) -> DataFrame:
    """(series, dice) of two masks."""
    return v.groupBy("series").agg(F.round(2.0 * F.count_if(a & b) / F.nullif(F.count_if(a) + F.count_if(b), F.lit(0)), 6).alias("dice"))


MOST_CLASSES = 1000


def few(table: DataFrame, most: int = MOST_CLASSES) -> DataFrame:
    """``table``, which is then small enough to broadcast; raises where it has more than ``most`` rows."""
    n = table.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows")
    return table


def ranked(v: DataFrame, index: Column, value: str = "hu", key: str = "series") -> DataFrame:
    """The value at a place of each series' sorted values: counts of equal values, then a running sum; ``index`` is from 0 in terms of ``n``."""
    h = v.groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    w = W.partitionBy(key)
    h = h.select("*", F.sum("k").over(w.orderBy("v")).alias("upto"), F.sum("k").over(w).alias("n"))
    return h.where(F.col("upto") > index).groupBy(key).agg(F.min("v").alias("v"))


def soft_level(v: DataFrame, threshold: int = 200) -> DataFrame:
    """Upper median of soft tissue."""
    soft = v.where((F.col("hu") > -300) & (F.col("hu") < threshold))
    got = ranked(soft, F.floor(F.col("n") / 2))
    return v.select("series").distinct().join(got, "series", "left").select("series", F.coalesce("v", F.lit(threshold - 200)).cast("long").alias("level"))


def percentile(v: DataFrame, p: float, value: str = "hu", key: str = "series") -> DataFrame:
    """Index-floor percentile, not interpolated."""
    return ranked(v, F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), value, key).withColumnRenamed("v", "p")


#: fixed values: thresholds of metal in calibrated units
METAL_SEED, METAL_LOW = 3000.0, 2200.0


def metal_thresholds(v: DataFrame, value: str, key: str, calibrated: bool = False) -> DataFrame:
    """Seed and low thresholds of metal: fixed in calibrated units, else by the range where its top stands far off, else null."""
    if calibrated:
        return v.select(key).distinct().select(key, F.lit(METAL_SEED).alias("seed"), F.lit(METAL_LOW).alias("low"))
    p50 = percentile(v, 50, value, key).withColumnRenamed("p", "p50")
    p999 = percentile(v, 99.9, value, key).withColumnRenamed("p", "p999")
    d = v.groupBy(key).agg(F.max(value).alias("top")).join(p50, key).join(p999, key)
    far = F.col("top") - F.col("p999") >= 0.15 * (F.col("top") - F.col("p50"))
    return d.select(key, F.when(far, F.round(F.col("p999") + 0.6 * (F.col("top") - F.col("p999")), 6)).alias("seed"), F.when(far, F.round("p999", 6)).alias("low"))


def dental_slice(v: DataFrame, levels=(2500, 1800, 1200), least: int = 20) -> DataFrame:
    """The slice with most voxels above the first level that any slice has more than ``least`` of; else the middle one.

    Every other voxel of a slice counts.
    """
    wide = v.groupBy("series").agg((F.max("x") + 1).alias("nx"))
    even = (F.col("y") * F.col("nx") + F.col("x")) % 2 == 0
    v = v.join(wide, "series").select("series", "z", F.when(even, F.col("hu")).alias("hu"))
    c = v.groupBy("series", "z").agg(*[F.count_if(F.col("hu") > t).alias(f"n{i}") for i, t in enumerate(levels)])
    pick = [F.max_by("z", F.struct(f"n{i}", -F.col("z"))).alias(f"z{i}") for i in range(len(levels))] + [F.max(f"n{i}").alias(f"m{i}") for i in range(len(levels))]
    b = c.groupBy("series").agg(*pick, F.floor((F.max("z") + 1) / 2).alias("mid"))
    return b.select("series", F.coalesce(*[F.when(F.col(f"m{i}") > least, F.col(f"z{i}")) for i in range(len(levels))], "mid").cast("long").alias("slice"))


def tissue_histogram(v: DataFrame, classes: DataFrame, value: str = "hu", key: str = "series") -> DataFrame:
    """Voxels per class; classes are lo <= value <= hi and may overlap, more than ``MOST_CLASSES`` are refused."""
    counts = v.groupBy(key, F.floor(value).alias("u")).agg(F.count("*").alias("k"))
    return counts.join(F.broadcast(few(classes)), (F.col("u") >= F.col("lo")) & (F.col("u") <= F.col("hi"))).groupBy(key, "class").agg(F.sum("k").alias("voxels"))
