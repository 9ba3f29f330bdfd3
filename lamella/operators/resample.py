"""Assembly of stacks and resampling along z and in the plane."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import clamp, cubic, to_int16


def gaps(stack: DataFrame, near: float = 1e-3) -> DataFrame:
    """(series, z, gap) of the places that are kept of each stack; the first has no gap.

    Of places less than ``near`` from the last one kept none is kept.  Runs of such places are short, and each is gone through in order.
    """
    w = W.partitionBy("series").orderBy("z")
    places = stack.select("series", "z").distinct().withColumn("new", F.coalesce((F.col("z") - F.lag("z").over(w) >= near).cast("int"), F.lit(1)))
    run = places.withColumn("run", F.sum("new").over(w)).groupBy("series", "run").agg(F.array_sort(F.collect_list("z")).alias("zs"))
    kept = F.aggregate("zs", F.array().cast("array<double>"), lambda acc, z: F.when((F.size(acc) == 0) | (z - F.try_element_at(acc, F.lit(-1)) >= near), F.array_append(acc, z)).otherwise(acc))
    places = run.select("series", F.explode(kept).alias("z"))
    return places.withColumn("gap", F.col("z") - F.lag("z").over(w))


def stack_geometry(stack: DataFrame) -> DataFrame:
    """Slices, duplicates and gap statistics; irregular where gaps stray far from the median."""
    g = gaps(stack).groupBy("series").agg(F.count("*").alias("slices"), F.median("gap").alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))
    n = stack.groupBy("series").agg(F.count("*").alias("n"))
    odd = (F.col("max_gap") > 1.15 * F.col("median_gap")) | (F.col("min_gap") < 0.85 * F.col("median_gap"))
    return g.join(n, "series").select("series", "slices", (F.col("n") - F.col("slices")).alias("duplicates"), "median_gap", "min_gap", "max_gap", odd.alias("irregular"))


def header_spacing(stack: DataFrame) -> DataFrame:
    """Upper median of the gaps."""
    g = gaps(stack).where("gap > 0.001").groupBy("series", "gap").agg(F.count("*").alias("k"))
    w = W.partitionBy("series")
    g = g.select("*", F.sum("k").over(w.orderBy("gap")).alias("upto"), F.sum("k").over(w).alias("n"))
    return g.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("series").agg(F.min("gap").alias("spacing"))


def brackets(stack: DataFrame, near: float = 1e-3) -> DataFrame:
    """(series, k, a, b, t, filled): the grid of each stack, each place between the slices at z = ``a`` and ``b``, ``t`` of the way.

    Stacks with regular gaps keep their slices, others get a uniform grid at the median gap; ``filled``: no slice is within a quarter gap.
    The as-of join is a union and two windows along z: no pair of grid place and slice is made but those that bracket.
    """
    kept = gaps(stack, near)
    geo = kept.groupBy("series").agg(F.median("gap").alias("step"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    odd = (F.col("most") > 1.15 * F.col("step")) | (F.col("least") < 0.85 * F.col("step"))
    geo = geo.withColumn("odd", F.coalesce(odd, F.lit(False)))
    regular = kept.join(geo.where("not odd").select("series"), "series", "left_semi").withColumn("k", F.row_number().over(W.partitionBy("series").orderBy("z")) - 1)
    regular = regular.select("series", "k", F.col("z").alias("a"), F.col("z").alias("b"), F.lit(0.0).alias("t"), F.lit(False).alias("filled"))
    grid = geo.where("odd").select("series", F.explode(F.sequence(F.lit(0), F.floor((F.col("z1") - F.col("z0")) / F.col("step") + 0.5).cast("int"))).alias("k"), "z0", "step", "z1")
    grid = grid.select("series", "k", (F.col("z0") + F.col("k") * F.col("step")).alias("at"), "step", "z1").withColumn("z", F.least("at", "z1"))
    none = F.lit(None).cast("double")
    s = kept.select("series", "z", F.lit(None).cast("int").alias("k"), none.alias("at"), none.alias("step"), F.col("z").alias("s"))
    both = s.unionByName(grid.select("series", "z", "k", "at", "step", none.alias("s")))
    w = W.partitionBy("series").orderBy("z")
    low = F.last("s", True).over(w.rangeBetween(W.unboundedPreceding, 0))
    high = F.last("s", True).over(W.partitionBy("series").orderBy(F.desc("z")).rangeBetween(W.unboundedPreceding, 0))
    b = both.select("series", "z", "k", "at", "step", low.alias("a"), high.alias("b")).where("k is not null")
    t = F.when(F.col("b") > F.col("a"), (F.col("z") - F.col("a")) / (F.col("b") - F.col("a"))).otherwise(0.0)
    far = F.least(F.abs(F.col("at") - F.col("a")), F.abs(F.col("at") - F.col("b"))) > F.col("step") * 0.25
    return regular.unionByName(b.select("series", "k", "a", "b", F.when(t < 1e-3, 0.0).otherwise(t).alias("t"), far.alias("filled")))


def fill_gaps(stack: DataFrame, near: float = 1e-3) -> DataFrame:
    """(series, k, value, filled): stacks with regular gaps as they are, others on a uniform grid at the median gap.

    ``stack``: series, z, value and ``at``, the place in the input, of which the first counts among slices at the same place.  Values
    are lerped between the slices that bracket a place, and rounded to 16 bits.
    """
    one = stack.groupBy("series", "z").agg(F.min_by("value", "at").alias("value"))
    ends = (one.select("series", F.col("z").alias(c), F.col("value").alias(f"v{c}")) for c in "ab")
    d = brackets(stack, near)
    for c, e in zip("ab", ends, strict=True):
        d = d.join(e, ["series", c])
    value = F.when(F.col("t") == 0, F.col("va")).otherwise(F.col("va") + (F.col("vb") - F.col("va")) * F.col("t"))
    return d.select("series", "k", to_int16(value).cast("long").alias("value"), "filled")


def block_mean(v: DataFrame, f: int = 2) -> DataFrame:
    """Mean of f x f blocks in the plane, halves rounded up; what fills no whole block is dropped."""
    edge = v.groupBy("series").agg((F.floor((F.max("x") + 1) / f) * f).alias("nx"), (F.floor((F.max("y") + 1) / f) * f).alias("ny"))
    v = v.join(edge, "series").where("x < nx and y < ny")
    return v.groupBy("series", F.floor(F.col("x") / f).cast("int").alias("x"), F.floor(F.col("y") / f).cast("int").alias("y"), "z").agg(F.floor(F.avg("hu") + 0.5).alias("hu"))


def neighbours(v: DataFrame, value: str) -> DataFrame:
    """(series, x, y, z, p0 to p3, last): each voxel p1 with those before and after it along z; at the ends, itself."""
    w = W.partitionBy("series", "x", "y").orderBy("z")
    c = F.col(value)
    b = F.coalesce(F.lead(value).over(w), c)
    return v.select("series", "x", "y", "z", c.alias("p1"), b.alias("p2"), F.coalesce(F.lag(value).over(w), c).alias("p0"), F.coalesce(F.lead(value, 2).over(w), b).alias("p3"), F.lead("z").over(w).isNull().alias("last"))


def planes(v: DataFrame, value: str, ratio: float) -> DataFrame:
    """(series, x, y, k, t, p0 to p3): planes every ``ratio`` slices, ``t`` of the way from p1 to p2.

    A window along z brings the neighbours of each slice; the slice then emits the planes up to the next one.
    """
    v = neighbours(v, value)
    first = F.ceil(F.col("z") / ratio - 1e-9)
    end = F.when(F.col("last"), F.floor(F.col("z") / ratio + 1e-9)).otherwise(F.ceil((F.col("z") + 1) / ratio - 1e-9) - 1)
    v = v.where(end >= first).withColumn("k", F.explode(F.sequence(first, end)))
    return v.select("series", "x", "y", "k", F.greatest(F.lit(0.0), F.col("k") * ratio - F.col("z")).alias("t"), "p0", "p1", "p2", "p3")


def resample_z(v: DataFrame, target: float, spacing: float = 1.0, method: str = "linear") -> DataFrame:
    """(series, x, y, k, hu): planes every ``target`` mm; cubic never leaves the range of its two bracketing values.

    A target of 0.95 of the spacing or more leaves the slices as they are.
    """
    if target >= 0.95 * spacing:
        return v.select("series", "x", "y", F.col("z").cast("long").alias("k"), "hu")
    p = planes(v, "hu", target / spacing)
    if method == "linear":
        got = F.col("p1") + (F.col("p2") - F.col("p1")) * F.col("t")
    else:
        got = clamp(cubic(*(F.col(f"p{i}") for i in range(4)), F.col("t")), F.least("p1", "p2"), F.greatest("p1", "p2"))
    return p.select("series", "x", "y", "k", F.floor(got + 0.5).alias("hu"))
