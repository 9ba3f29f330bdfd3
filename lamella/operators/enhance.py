"""Enhancement of pixel rows (img, x, y, v): contrast-limited adaptive histogram equalisation and the whole chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stencil import box_blur, median3


def to_gray(r: Column, g: Column, b: Column) -> Column:
    """Brightness of a colour."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def to_rgba(v: Column) -> Column:
    """A gray as an opaque colour of whole numbers."""
    c = F.least(F.lit(255), F.greatest(F.lit(0), F.rint(v))).cast("int")
    return F.struct(c.alias("r"), c.alias("g"), c.alias("b"), F.lit(255).alias("a"))


def clahe(p: DataFrame, clip: float = 2.5, tiles: int = 4, width: int = 64, height: int | None = None) -> DataFrame:
    """Tiles' clipped histograms become lookup tables; each pixel blends those of the four tiles around it.

    Images are ``width`` x ``height`` (square by default); sides that the tiles do not divide give tiles of unequal size.
    """
    height = height or width
    tx, ty = (max(1, min(tiles, n // 8)) for n in (width, height))
    bin_ = F.least(F.lit(255), F.greatest(F.lit(0), F.floor("v"))).cast("int")
    p = p.select("img", "x", "y", bin_.alias("bin"))

    def tile(c, n, k):
        return (F.ceil((F.col(c) + 1) * k / n) - 1).cast("int")

    def size(c, n, k):
        return F.floor((F.col(c) + 1) * n / k) - F.floor(F.col(c) * n / k)

    h = p.groupBy("img", tile("x", width, tx).alias("tx"), tile("y", height, ty).alias("ty"), "bin").agg(F.count("*").alias("k"))
    every = h.select("img", "tx", "ty").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(255))))
    h = every.join(h, ["img", "tx", "ty", "bin"], "left").withColumn("n", size("tx", width, tx) * size("ty", height, ty))
    k, limit = F.coalesce("k", F.lit(0)).cast("double"), F.greatest(F.lit(1.0), clip * F.col("n") / 256)
    w = W.partitionBy("img", "tx", "ty")
    h = h.withColumns({"over": F.greatest(k - limit, F.lit(0.0)), "held": F.least(k, limit)})
    # one narrow row for each gray of a tile, which pixels are joined to by gray
    lut = h.select("img", "tx", "ty", "bin", ((F.sum("held").over(w.orderBy("bin")) + F.sum("over").over(w) / 256 * (F.col("bin") + 1)) / F.col("n") * 255).alias("value"))
    fx, fy = ((F.col(c) + 0.5) / (n / k) - 0.5 for c, n, k in (("x", width, tx), ("y", height, ty)))
    q = p.select("*", fx.alias("fx"), fy.alias("fy")).select("*", F.floor("fx").alias("x0"), F.floor("fy").alias("y0"))
    corner = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    q = q.select("*", F.explode(corner).alias("c"))
    wx = F.when(F.col("c.a") == 1, F.col("fx") - F.col("x0")).otherwise(1 - F.col("fx") + F.col("x0"))
    wy = F.when(F.col("c.b") == 1, F.col("fy") - F.col("y0")).otherwise(1 - F.col("fy") + F.col("y0"))
    inside = lambda c, k: F.least(F.lit(k - 1), F.greatest(F.lit(0), c)).cast("int")
    q = q.select("img", "x", "y", "bin", inside(F.col("x0") + F.col("c.a"), tx).alias("tx"), inside(F.col("y0") + F.col("c.b"), ty).alias("ty"), (wx * wy).alias("w"))
    return q.join(lut, ["img", "tx", "ty", "bin"]).groupBy("img", "x", "y").agg(F.round(F.sum(F.col("value") * F.col("w")), 4).alias("v"))


def enhance(p: DataFrame, denoise: int = 1, clip: float = 2.5, tiles: int = 8, sharpen: float = 0.8, brightness: float = 0.0, contrast: float = 0.0, gamma: float = 1.0, invert: bool = False, side: int = 64) -> DataFrame:
    """Median and half-mixed blur, equalisation, unsharp mask, then contrast, brightness, gamma and inversion; 0 leaves a step out."""
    p = p.select("img", "x", "y", F.col("v").cast("double").alias("v"))
    if denoise > 0:
        p = median3(p)
    if denoise > 1:
        p = box_blur(p.withColumn("u", F.col("v")), denoise - 1, "u").select("img", "x", "y", ((F.col("v") + F.col("u")) / 2).alias("v"))
    if clip > 0:
        p = clahe(p, clip, tiles, side)
    if sharpen > 0:
        p = box_blur(p.withColumn("u", F.col("v")), 2, "u").select("img", "x", "y", (F.col("v") + (F.col("v") - F.col("u")) * sharpen).alias("v"))
    v = (F.col("v") - 128) * ((100 + contrast) / 100) + 128 + brightness * 1.28
    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))
    if gamma != 1:
        v = 255 * F.pow(v / 255, F.lit(1 / gamma))
    return p.select("img", "x", "y", (255 - v if invert else v).alias("v"))
