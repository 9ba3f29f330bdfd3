"""Stacks from slices: which are kept, where they lie, and what a series looks like from its headers.

Slices are rows (series, at: place in the input, rows_, cols, position px, py, pz or null, row direction rx, ry, rz, column direction cx,
cy, cz, ps0 and ps1: mm between rows and between columns, instance, frames, thickness).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import cross, dot, normalize
from .resample import gaps

FIRST = ("rows_", "cols", "rx", "ry", "rz", "cx", "cy", "cz", "ps0", "ps1", "thickness")


def obliquity(nx: Column, ny: Column, nz: Column) -> Column:
    """Degrees between a unit normal and the nearest axis."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.abs(nx), F.abs(ny), F.abs(nz)))))


def firsts(slices: DataFrame) -> DataFrame:
    """One row a series: the header of its first slice, with f before each name, and the normal nx, ny, nz."""
    f = slices.groupBy("series").agg(F.min_by(F.struct(*FIRST), "at").alias("f")).select("series", *(F.col(f"f.{c}").alias(f"f{c}") for c in FIRST))
    row, col = (normalize([F.col(f"f{k}{c}") for c in "xyz"]) for k in "rc")
    f = f.withColumns({f"f{k}{c}": e for k, v in zip("rc", (row, col), strict=True) for c, e in zip("xyz", v, strict=True)})
    normal = normalize(cross([F.col(f"fr{c}") for c in "xyz"], [F.col(f"fc{c}") for c in "xyz"]))
    return f.withColumns(dict(zip(("nx", "ny", "nz"), normal, strict=True)))


def keyed(slices: DataFrame) -> DataFrame:
    """Slices of the first one's size with ``z``: along its normal where all of them have positions (``placed``), else by instance."""
    d = slices.join(firsts(slices), "series").where("rows_ = frows_ and cols = fcols")
    placed = F.min(F.col("px").isNotNull().cast("int")).over(W.partitionBy("series")) == 1
    thick = F.when(F.col("fthickness") > 0, F.col("fthickness")).otherwise(1.0)
    along = dot([F.col(f"p{c}") for c in "xyz"], [F.col(f"n{c}") for c in "xyz"])
    d = d.withColumns({"placed": placed, "thick": thick})
    return d.withColumn("z", F.round(F.when(F.col("placed"), along).otherwise(F.col("instance") * F.col("thick")), 9))


def assemble(slices: DataFrame) -> DataFrame:
    """(series, placed, kept, slices, duplicates, spacing, least, most, irregular, oblique) of each series."""
    k = keyed(slices)
    n = k.groupBy("series").agg(F.count("*").alias("kept"), F.first("placed").alias("placed"), F.first("thick").alias("thick"), F.first(obliquity(*(F.col(f"n{c}") for c in "xyz"))).alias("oblique"))
    g = gaps(k.select("series", "z")).groupBy("series").agg(F.count("*").alias("slices"), F.median("gap").alias("mid"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    odd = (F.col("most") > 1.15 * F.col("mid")) | (F.col("least") < 0.85 * F.col("mid"))
    spacing = F.coalesce(F.nullif("mid", F.lit(0.0)), "thick")
    return n.join(g, "series").select("series", "placed", "kept", "slices", (F.col("kept") - F.col("slices")).alias("duplicates"), spacing.alias("spacing"), "least", "most", F.coalesce(odd, F.lit(False)).alias("irregular"), "oblique")


def geometry(slices: DataFrame) -> DataFrame:
    """(series, sx, sy, sz, origin, direction): mm between columns, rows and slices, the place of the lowest slice (zeros without
    positions), and nine cosines: those of the rows, of the columns and of the normal."""
    k = keyed(slices)
    at = F.when(F.col("placed"), F.array("px", "py", "pz")).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    first = k.groupBy("series").agg(F.min_by(at, F.struct("z", "at")).alias("origin"))
    nine = F.array(*(F.col(f"f{a}{c}") for a in "rc" for c in "xyz"), "nx", "ny", "nz")
    f = firsts(slices).select("series", F.col("fps1").alias("sx"), F.col("fps0").alias("sy"), nine.alias("direction"))
    return f.join(assemble(slices).select("series", F.col("spacing").alias("sz")), "series").join(first, "series").select("series", "sx", "sy", "sz", "origin", "direction")


def summarize(slices: DataFrame) -> DataFrame:
    """(series, images, frames, middle, middle_frame, nx, ny, nz, x0 to z1): counts, the middle slice's place in the input, normal and box.

    The box holds the four corners of each slice that has a position; one file of several frames reaches to its last frame, by ``step``
    (where there is such a column) or the slices' thickness, and has a middle frame.
    """
    f = firsts(slices)
    n = slices.groupBy("series").agg(F.count("*").alias("images"), F.sum("frames").alias("frames"))
    order = slices.select("series", "at", F.row_number().over(W.partitionBy("series").orderBy("instance", "at")).alias("r")).join(n, "series")
    middle = order.where(F.col("r") == F.floor(F.col("images") / 2) + 1).select("series", "images", "frames", F.col("at").alias("middle"), F.when((F.col("images") == 1) & (F.col("frames") > 1), F.floor(F.col("frames") / 2)).alias("middle_frame"))
    p = slices.where("px is not null").join(f, "series").join(n.select("series", "images", F.col("frames").alias("all")), "series")
    step = F.coalesce(*(["step"] if "step" in slices.columns else []), "thickness", F.lit(1.0)) * (F.col("frames") - 1)
    reach = F.explode(F.when((F.col("images") == 1) & (F.col("all") > 1), F.array(F.lit(0.0), step)).otherwise(F.array(F.lit(0.0))))
    p = p.withColumn("reach", reach).withColumn("u", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("w", F.explode(F.array(F.lit(0), F.lit(1))))
    corner = {c: F.col(f"p{c}") + F.col(f"n{c}") * F.col("reach") + F.col(f"fr{c}") * F.col("u") * F.col("fcols") * F.col("fps1") + F.col(f"fc{c}") * F.col("w") * F.col("frows_") * F.col("fps0") for c in "xyz"}
    box = p.groupBy("series").agg(*(g(e).alias(f"{c}{k}") for c, e in corner.items() for k, g in ((0, F.min), (1, F.max))))
    return middle.join(f.select("series", "nx", "ny", "nz"), "series").join(box, "series", "left")


def thumbnail(pixels: DataFrame, rows: int, cols: int, size: int = 96, centre: float = 400.0, width: float = 2600.0) -> DataFrame:
    """(series, x, y, gray) of images (series, x, y, hu) drawn at most ``size`` high and wide: the nearest pixel, windowed."""
    scale = max(rows, cols) / size
    w, h = (max(1, int(n / scale + 0.5)) for n in (cols, rows))
    at = [F.array(*(F.lit(min(n - 1, int(k * scale))) for k in range(m))) for n, m in ((cols, w), (rows, h))]
    # each source pixel gives the places of the small image that it is the nearest of
    p = pixels
    for c, a in zip("xy", at, strict=True):
        every = p.withColumn(f"t{c}", F.explode(F.sequence(F.lit(0), F.size(a) - 1)))
        p = every.where(F.element_at(a, F.col(f"t{c}") + 1) == F.col(c))
    gray = F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("hu") - (centre - width / 2)) / width * 255))
    return p.select("series", F.col("tx").alias("x"), F.col("ty").alias("y"), gray.alias("gray"))


def merge_meshes(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (layer, vid from 0) and triangles (layer, tid, a, b, c) of all layers as one mesh: layer after layer, indices moved on."""
    n = vertices.groupBy("layer").agg(F.count("*").alias("n"))
    base = n.select("layer", F.coalesce(F.sum("n").over(W.orderBy("layer").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a layer
    v = vertices.join(base, "layer").withColumn("vid", F.col("vid") + F.col("base")).drop("base")
    t = triangles.join(base, "layer").withColumns({c: F.col(c) + F.col("base") for c in "abc"}).drop("base")
    return v, t
