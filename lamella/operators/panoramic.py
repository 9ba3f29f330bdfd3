"""Curved reformats along a dental arch.

Control points become a densely sampled curve by windows along their order; the curve emits its own evenly spaced columns;
sample places look up only the voxels around them, by an equi-join on the lattice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import cubic, half_up
from .views import window

OUTSIDE = -1024.0


def arch(control: DataFrame, sx: float = 1.0, sy: float = 1.0, toward_left: bool = True) -> DataFrame:
    """(series, col, px, py, ox, oy): columns every min(sx, sy) mm along the curve, and the unit normal that points out of it.

    ``control``: series, n, px, py in voxels, n giving their order, which is turned round where the curve would start at
    the patient's left.  Curves under two points or 1 mm give no rows.
    """
    key, step = W.partitionBy("series"), min(sx, sy)
    n = key.orderBy("n")
    ends = key.orderBy("n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first("px").over(ends), F.last("px").over(ends)
    turned = first > last if toward_left else first < last
    c = control.select("series", "px", "py", F.when(turned, -F.col("n")).otherwise(F.col("n")).alias("n"))
    after = {a: F.lead(a).over(n) for a in ("px", "py")}
    four = {a: (F.coalesce(F.lag(a).over(n), F.col(a)), F.col(a), after[a], F.coalesce(F.lead(a, 2).over(n), after[a])) for a in after}
    c = c.select("series", "n", *(p.alias(f"{a}{i}") for a, ps in four.items() for i, p in enumerate(ps)))
    across = F.hypot((F.col("px2") - F.col("px1")) * sx, (F.col("py2") - F.col("py1")) * sy)
    parts = F.when(F.col("px2").isNotNull(), F.greatest(F.lit(2), F.ceil(across * 4))).otherwise(1).cast("int")
    c = c.withColumn("parts", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    t = F.col("k") / F.col("parts")
    d = c.select("series", "n", "k", *(F.when(F.col("k") == 0, F.col(f"{a}1")).otherwise(cubic(*(F.col(f"{a}{i}") for i in range(4)), t)).alias(a) for a in ("px", "py")))
    w = key.orderBy("n", "k")
    d = d.select("*", F.lead("px").over(w).alias("qx"), F.lead("py").over(w).alias("qy"))
    d = d.withColumn("mm", F.coalesce(F.hypot((F.col("qx") - F.col("px")) * sx, (F.col("qy") - F.col("py")) * sy), F.lit(0.0)))
    d = d.select("*", F.round(F.sum("mm").over(w), 9).alias("to"), F.round(F.sum("mm").over(key), 9).alias("length"))
    d = d.withColumn("from", F.coalesce(F.lag("to").over(w), F.lit(0.0))).where("length >= 1 and mm > 0 and to > from")
    # each stretch emits the columns that fall in it, its end excluded but for the curve's own
    end = F.when(F.col("to") == F.col("length"), F.floor(F.col("to") / step)).otherwise(F.ceil(F.col("to") / step) - 1)
    d = d.select("*", F.ceil(F.col("from") / step).alias("k0"), end.alias("k1")).where("k1 >= k0").withColumn("col", F.explode(F.sequence("k0", "k1")))
    t = (F.col("col") * step - F.col("from")) / (F.col("to") - F.col("from"))
    p = d.select("series", F.col("col").cast("int").alias("col"), (F.col("px") + (F.col("qx") - F.col("px")) * t).alias("px"), (F.col("py") + (F.col("qy") - F.col("py")) * t).alias("py"))
    w = key.orderBy("col")
    tx, ty = ((F.coalesce(F.lead(a).over(w), F.col(a)) - F.coalesce(F.lag(a).over(w), F.col(a))) * s for a, s in (("px", sx), ("py", sy)))
    p = p.select("*", tx.alias("tx"), ty.alias("ty"), F.avg("px").over(key).alias("mx"), F.avg("py").over(key).alias("my"))
    norm = F.coalesce(F.nullif(F.hypot("tx", "ty"), F.lit(0.0)), F.lit(1.0))
    out = F.when(-F.col("ty") * (F.col("px") - F.col("mx")) * sx + F.col("tx") * (F.col("py") - F.col("my")) * sy < 0, -1.0).otherwise(1.0)
    return p.select("series", "col", "px", "py", (-F.col("ty") / norm * out).alias("ox"), (F.col("tx") / norm * out).alias("oy"))


def sample(places: DataFrame, v: DataFrame, dims: DataFrame) -> DataFrame:
    """``places`` (series, u, v, w in voxels, and what else) with ``value``: trilinear, OUTSIDE beyond the grid.

    ``dims``: series, nx, ny, nz; one row a series.  A place looks up only the corners that have weight.
    """
    keep = [c for c in places.columns if c not in ("u", "v", "w")]
    p = places.join(dims, "series")
    inside = (F.least("u", "v", "w") >= 0) & (F.col("u") <= F.col("nx") - 1) & (F.col("v") <= F.col("ny") - 1) & (F.col("w") <= F.col("nz") - 1)
    p = p.select(*keep, "u", "v", "w", inside.alias("inside"))
    for a in "uvw":
        low, part = F.floor(a), F.col(a) - F.floor(a)
        two = F.array(F.struct(low.cast("int").alias("at"), (F.lit(1.0) - part).alias("share")), F.struct((low + 1).cast("int").alias("at"), part.alias("share")))
        one = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(1.0).alias("share")))
        p = p.withColumn(a, F.explode(F.when(F.col("inside"), F.filter(two, lambda e: e["share"] > 0)).otherwise(one)))
    share = F.col("u")["share"] * F.col("v")["share"] * F.col("w")["share"]
    p = p.select(*keep, "inside", share.alias("share"), *(F.col(a)["at"].alias(n) for a, n in zip("uvw", "xyz", strict=True)))
    got = p.where("inside").join(v.select("series", "x", "y", "z", "hu"), ["series", "x", "y", "z"])
    got = got.groupBy(*keep).agg(F.sum(F.col("share") * F.col("hu")).alias("value"))
    return got.unionByName(p.where("not inside").select(*keep, F.lit(OUTSIDE).alias("value")))


def _rows(p: DataFrame, dims: DataFrame, sz: float, pixel: float, superior_plus: bool) -> DataFrame:
    """Each column times the rows of the image, with ``w``: the highest place on top."""
    rows = F.greatest(F.lit(1), half_up((F.col("nz") - 1) * sz / pixel) + 1).cast("int")
    d = dims.select("series", "nz", rows.alias("rows")).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    at = F.when(F.col("rows") > 1, F.round(F.col("row") / (F.col("rows") - 1) * (F.col("nz") - 1), 9)).otherwise(0.0)
    return p.join(d.select("series", "row", (F.col("nz") - 1 - at if superior_plus else at).alias("w")), "series")


def _along(offset: Column, sx: float, sy: float) -> list[Column]:
    return [F.round(F.col("px") + F.col("ox") * offset / sx, 9).alias("u"), F.round(F.col("py") + F.col("oy") * offset / sy, 9).alias("v")]


def panoramic(v: DataFrame, curve: DataFrame, dims: DataFrame, thickness: float, mode: str = "mean", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), superior_plus: bool = True) -> DataFrame:
    """(series, row, col, value): the mean or the maximum ("mip") over ``thickness`` mm across the curve."""
    if mode not in ("mean", "mip"):
        raise ValueError(f"mode {mode!r}")
    sx, sy, sz = spacing
    pixel = min(sx, sy)
    count = max(1, int(thickness / pixel + 0.5) + 1)
    o = F.explode(F.array(*(F.lit(-thickness / 2 + k * thickness / (count - 1) if count > 1 else 0.0) for k in range(count))))
    p = curve.withColumn("o", o).select("series", "col", "o", *_along(F.col("o"), sx, sy))
    s = sample(_rows(p, dims, sz, pixel, superior_plus), v, dims)
    return s.groupBy("series", "row", "col").agg((F.max if mode == "mip" else F.avg)("value").alias("value"))


def cross_section(v: DataFrame, curve: DataFrame, dims: DataFrame, col: int, width: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), superior_plus: bool = True) -> DataFrame:
    """(series, row, c, value): the plane across the curve at a column (the last one beyond its end), ``width`` mm wide."""
    sx, sy, sz = spacing
    pixel = min(sx, sy)
    at = curve.where(F.col("col") <= max(0, col)).groupBy("series").agg(F.max_by(F.struct("px", "py", "ox", "oy"), "col").alias("p")).select("series", "p.*")
    p = at.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(max(2, int(width / pixel + 0.5) + 1) - 1))))
    p = p.select("series", "c", *_along(F.lit(-width / 2) + F.col("c") * pixel, sx, sy))
    return sample(_rows(p, dims, sz, pixel, superior_plus), v, dims)


def nearest_column(points: DataFrame, curve: DataFrame) -> DataFrame:
    """(series, id, col, mm): for each traced point (series, id, px, py in voxels of 1 mm) its nearest column, the first on ties.

    A curve has a few hundred columns, so that a point meets few rows.
    """
    j = points.join(curve.select("series", "col", F.col("px").alias("cx"), F.col("py").alias("cy")), "series")
    mm = F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy"))
    return j.groupBy("series", "id").agg(F.min(F.struct(F.round(mm, 6).alias("mm"), "col")).alias("m")).select("series", "id", "m.col", "m.mm")


def canal_line(points: DataFrame, curve: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), origin: tuple[float, ...] = (0.0, 0.0, 0.0), direction: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)) -> DataFrame:
    """(series, n, id, col, x, y, z, length): traced points (series, id, px, py, pz in voxels) in order along the arch, in mm of the patient, and
    how long the line is up to each.

    A point's place in the order is its nearest column, then its id.  ``direction``: nine cosines, axis after axis.  A window holds the points
    of one canal.
    """
    d = points.join(nearest_column(points, curve), ["series", "id"])
    mm = [F.col(f"p{c}") * s for c, s in zip("xyz", spacing, strict=True)]
    at = {c: F.lit(float(origin[k])) + sum((float(direction[3 * a + k]) * mm[a] for a in range(3)), F.lit(0.0)) for k, c in enumerate("xyz")}
    d = d.select("series", "id", "col", *(e.alias(c) for c, e in at.items()))
    w = W.partitionBy("series").orderBy("col", "id")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in "xyz"), F.lit(0.0)))
    d = d.withColumns({"n": F.row_number().over(w), "step": F.coalesce(step, F.lit(0.0))})
    return d.select("series", "n", "id", "col", "x", "y", "z", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("length"))


#: fixed values: centre and width of the windows of bone and, for the greatest values along a ray, of teeth
WINDOWS = {"mean": (600.0, 3000.0), "mip": (1200.0, 3500.0)}


def shown(value: Column, mode: str = "mean") -> Column:
    """0 to 255 of a panoramic image's value in the window of its mode."""
    return window(value, *WINDOWS[mode])


def canal_marks(points: DataFrame, curve: DataFrame, dims: DataFrame, col: int, width: float = 40.0, beside: int = 2, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), superior_plus: bool = True) -> DataFrame:
    """(series, id, view, u, v): where traced points (series, id, px, py, pz in voxels) are drawn.

    View ``pano``: each point at its nearest column, told in voxels; view ``cross``: those at most ``beside`` columns from the cross-section at ``col``, at their
    place across the curve there.  Rows are those of the reformats, as high as pixels are wide; a series without ``col`` has no cross-section.
    """
    sx, sy, sz = spacing
    pixel = min(sx, sy)
    d = points.join(nearest_column(points, curve).select("series", "id", F.col("col").alias("u")), ["series", "id"]).join(dims.select("series", "nz"), "series")
    h = F.greatest(F.lit(1), half_up((F.col("nz") - 1) * (sz / pixel)) + 1)
    down = F.when(F.col("nz") > 1, F.col("pz") / (F.col("nz") - 1)).otherwise(0.0)
    d = d.withColumn("v", (1 - down if superior_plus else down) * (h - 1))
    here = curve.where(F.col("col") == col).select("series", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("ox").alias("nx"), F.col("oy").alias("ny"))
    across = (F.col("px") - F.col("ax")) * sx * F.col("nx") + (F.col("py") - F.col("ay")) * sy * F.col("ny")
    cross = d.where(F.abs(F.col("u") - col) <= beside).join(here, "series").select("series", "id", F.lit("cross").alias("view"), ((across + width / 2) / pixel).alias("u"), "v")
    return d.select("series", "id", F.lit("pano").alias("view"), F.col("u").cast("double").alias("u"), "v").unionByName(cross)
