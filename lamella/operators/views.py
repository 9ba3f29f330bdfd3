"""Slices and points of volumes as they are shown: places, windows, planes, labels and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import clamp, direction_label, half_up

#: fixed values: axis that each plane is a slice of
PLANES = {"axial": "z", "coronal": "y", "sagittal": "x"}


def window(value: Column, centre: float, width: float) -> Column:
    """0 to 255 within the window."""
    return clamp((value - (centre - width / 2)) * (255 / max(1.0, width)), 0.0, 255.0)


def index_of(p: list[Column], origin: list[Column], direction: list[Column], spacing: list[Column]) -> list[Column]:
    """Nearest voxel of a place in mm; ``direction``: nine cosines, axis after axis."""
    q = [a - b for a, b in zip(p, origin, strict=True)]
    return [half_up(sum((direction[3 * a + i] * q[i] for i in (1, 2)), direction[3 * a] * q[0]) / spacing[a]) for a in range(3)]


def index_map(target: dict[str, list[Column]], source: dict[str, list[Column]]) -> tuple[list[Column], list[Column]]:
    """(nine numbers row after row, offset) that take an index of the target grid to one of the source.

    Grids: origin, direction (nine cosines, axis after axis) and spacing.
    """
    dt, ds, st, ss = target["direction"], source["direction"], target["spacing"], source["spacing"]
    far = [a - b for a, b in zip(target["origin"], source["origin"], strict=True)]
    along = lambda a, v: ds[3 * a] * v[0] + ds[3 * a + 1] * v[1] + ds[3 * a + 2] * v[2]
    return [along(i, dt[3 * j : 3 * j + 3]) * st[j] / ss[i] for i in range(3) for j in range(3)], [along(i, far) / ss[i] for i in range(3)]


def fusion_grid(lo: list[Column], hi: list[Column], in_plane: Column, budget: float, least: float = 0.5) -> dict[str, Column]:
    """Spacing and sizes of the grid that covers a box: the finest pixel, coarsened by tenths until the voxels are within the budget."""
    start = F.greatest(in_plane, F.lit(least))
    extent = [b - a for a, b in zip(lo, hi, strict=True)]

    def sizes(s):
        return [F.floor(e / s) + 1 for e in extent]

    def fits(k):
        n = sizes(start * F.pow(F.lit(1.1), k))
        return n[0].cast("double") * n[1] * n[2] <= budget

    turns = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(200)), fits)), F.when(start.isNotNull() & extent[0].isNotNull() & extent[1].isNotNull() & extent[2].isNotNull(), F.raise_error(F.lit("no grid within the budget")).cast("int")))
    s = start * F.pow(F.lit(1.1), turns)
    return {"s": s} | {f"n{c}": n for c, n in zip("xyz", sizes(s), strict=True)}


def probe(points: DataFrame, v: DataFrame, dims: DataFrame) -> DataFrame:
    """(series, id, hu): the value at each point (series, id, px, py, pz): nearest voxel in the plane, linear between slices."""
    at = {c: clamp(half_up(F.col(f"p{c}")), F.lit(0), F.col(f"n{c}") - 1).cast("int") for c in "xy"}
    p = points.join(dims, "series").withColumn("zc", clamp(F.col("pz"), F.lit(0.0), F.col("nz") - 1.0)).select("series", "id", *(e.alias(c) for c, e in at.items()), "zc")
    low, part = F.floor("zc").cast("int"), F.col("zc") - F.floor("zc")
    ends = F.array(F.struct(low.alias("z"), (1 - part).alias("w")), F.struct((low + 1).alias("z"), part.alias("w")))
    p = p.withColumn("e", F.explode(F.filter(ends, lambda e: e["w"] > 0))).select("series", "id", "x", "y", F.col("e.z").alias("z"), F.col("e.w").alias("w"))
    return p.join(v.select("series", "x", "y", "z", "hu"), ["series", "x", "y", "z"]).groupBy("series", "id").agg(F.sum(F.col("w") * F.col("hu")).alias("hu"))


def plane_image(v: DataFrame, dims: DataFrame, plane: str, at: int, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(series, row, col, value) of one slice; of coronal and sagittal ones rows are as high as pixels are wide, the last slice on top.

    Rows between two slices are lerped: each slice emits the rows up to the next one.
    """
    if plane == "axial":
        return v.where(F.col("z") == at).select("series", F.col("y").alias("row"), F.col("x").alias("col"), F.col("hu").cast("double").alias("value"))
    from .resample import neighbours

    col, fixed, mm = ("x", "y", spacing[0]) if plane == "coronal" else ("y", "x", spacing[1])
    flat = v.where(F.col(fixed) == at).select("series", F.col(col).alias("x"), F.lit(0).alias("y"), "z", F.col("hu").cast("double").alias("hu"))
    d = dims.select("series", "nz", (F.greatest(F.lit(1), half_up((F.col("nz") - 1) * spacing[2] / mm) + 1)).alias("h"))
    s = neighbours(flat, "hu").join(d, "series")
    step = F.when(F.col("h") > 1, (F.col("nz") - 1) / (F.col("h") - 1)).otherwise(F.lit(1.0))
    # rows counted from below, of which the height is step * k slices
    first, end = F.ceil(F.col("z") / step - 1e-9), F.when(F.col("last"), F.floor(F.col("z") / step + 1e-9)).otherwise(F.ceil((F.col("z") + 1) / step - 1e-9) - 1)
    end = F.least(end, F.col("h") - 1)
    s = s.where(end >= first).withColumn("k", F.explode(F.sequence(first, end)))
    t = F.greatest(F.lit(0.0), F.col("k") * step - F.col("z"))
    return s.select("series", (F.col("h") - 1 - F.col("k")).cast("int").alias("row"), F.col("x").alias("col"), (F.col("p1") + (F.col("p2") - F.col("p1")) * t).alias("value"))


def edge_labels(plane: str, direction: list[Column]) -> list[Column]:
    """Letters of the left, right, top and bottom edge of a plane's image."""
    row, col, normal = direction[:3], direction[3:6], direction[6:]
    neg = lambda v: [-c for c in v]
    across, down = {"axial": (row, col), "coronal": (row, neg(normal)), "sagittal": (col, neg(normal))}[plane]
    return [direction_label(*neg(across)), direction_label(*across), direction_label(*neg(down)), direction_label(*down)]


def aligned(direction: list[Column], least: float = 0.95) -> Column:
    """Whether the axes are those of the patient, so that a mirror along x means something."""
    return (F.abs(direction[0]) > least) & (F.abs(direction[4]) > least) & (F.abs(direction[8]) > least)


def layout(w: Column, h: Column, pw: Column, ph: Column, cw: Column, ch: Column) -> dict[str, Column]:
    """Offset and scale that fit an image (w x h pixels of pw x ph mm) into a canvas, centred, with its proportions."""
    s = F.least(cw / (w * pw), ch / (h * ph))
    return {"x0": (cw - w * pw * s) / 2, "y0": (ch - h * ph * s) / 2, "sx": pw * s, "sy": ph * s}


def clip_plane(axis: int, fraction: Column, flip: Column, lo: list[Column], hi: list[Column]) -> tuple[list[Column], list[Column]]:
    """(place, normal) of the plane at a fraction of a box along an axis; what is on the normal's side is kept."""
    place = [lo[a] + (hi[a] - lo[a]) * fraction if a == axis else (lo[a] + hi[a]) / 2 for a in range(3)]
    return place, [F.when(flip, -1.0).otherwise(1.0) if a == axis else F.lit(0.0) for a in range(3)]


def marker(lo: list[Column], hi: list[Column]) -> Column:
    """Radius of a marker: 0.4 % of the box's diagonal, 0.6 at least."""
    d = [b - a for a, b in zip(lo, hi, strict=True)]
    return F.greatest(F.lit(0.6), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) * 0.004)


def drag(centre: Column, width: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Window after a drag by pixels: across the width, down the centre."""
    return centre + dy * 4, F.greatest(F.lit(1.0), width + dx * 8)


def to_volume(plane: str, u: Column, v: Column, cursor: list[Column], h: Column, nz: Column) -> list[Column]:
    """Place in the volume, in voxels, of a pixel of a plane's image ``h`` rows high; the plane's own axis is the cursor's."""
    if plane == "axial":
        return [u, v, half_up(cursor[2])]
    z = F.when(h > 1, (h - 1 - v) / (h - 1) * (nz - 1)).otherwise(0.0)
    return [u, cursor[1], z] if plane == "coronal" else [cursor[0], u, z]


def from_volume(plane: str, p: list[Column], h: Column, nz: Column) -> list[Column]:
    """Pixel of a plane's image, ``h`` rows high with the last slice on top, that shows a place."""
    if plane == "axial":
        return p[:2]
    return [p[0 if plane == "coronal" else 1], F.when(nz > 1, (h - 1) * (1 - p[2] / (nz - 1))).otherwise(0.0)]


def slice_at(plane: str, cursor: list[Column]) -> Column:
    """Number of the slice that a plane shows at the cursor."""
    return half_up(cursor["xyz".index(PLANES[plane])])


def turn_to(plane: str, cursor: list[Column], wanted: Column, slices: Column) -> list[Column]:
    """The cursor at the slice ``wanted``, or at the first or last one; it stays as it is where that slice is shown already."""
    k, axis = F.greatest(F.lit(0), F.least(slices - 1, wanted)), "xyz".index(PLANES[plane])
    return [F.when(slice_at(plane, cursor) == k, c).otherwise(k) if a == axis else c for a, c in enumerate(cursor)]


def move_to(plane: str, u: Column, v: Column, cursor: list[Column], h: Column, nz: Column) -> list[Column]:
    """The cursor after a touch of a plane's image: the plane's own axis stays, z is a whole slice."""
    p, own = to_volume(plane, u, v, cursor, h, nz), "xyz".index(PLANES[plane])
    p[2] = half_up(p[2])
    return [c if a == own else p[a] for a, c in enumerate(cursor)]


def bounds(vert: DataFrame, keys: list[str], layer: str = "layer") -> DataFrame:
    """(keys, layer, x0, x1, y0, y1, z0, z1) of the vertices of each layer, and with a null layer of all of them together."""
    ends = [e.alias(f"{c}{k}") for c in "xyz" for k, e in enumerate((F.min(c), F.max(c)))]
    each = vert.groupBy(*keys, layer).agg(*ends)
    ends = [e.alias(f"{c}{k}") for c in "xyz" for k, e in enumerate((F.min(f"{c}0"), F.max(f"{c}1")))]
    return each.unionByName(each.groupBy(*keys).agg(*ends).withColumn(layer, F.lit(None).cast(vert.schema[layer].dataType)))


#: fixed values: what kinds of measurement are called
MEASURES = {"distance": "Distance", "angle": "Angle", "point": "Point"}


def measure_list(measures: DataFrame, pending: DataFrame) -> DataFrame:
    """(study, n, id, line) of measurements (study, id, kind, label) in order of id, then one line for points marked so far (study, points).

    A kind of another name is shown by it; a study without points has no such line.
    """
    called = F.coalesce(F.create_map(*(F.lit(x) for kv in MEASURES.items() for x in kv))[F.col("kind")], F.col("kind"))
    done = measures.select("study", "id", F.concat(called, F.lit(": "), F.col("label")).alias("line"))
    open_ = pending.groupBy("study").agg(F.sum("points").alias("k")).where("k > 0").select("study", F.lit(None).cast(done.schema["id"].dataType).alias("id"), F.concat(F.col("k"), F.lit(" point(s) marked")).alias("line"))
    n = F.row_number().over(W.partitionBy("study").orderBy(F.asc_nulls_last("id")))
    return done.unionByName(open_).select("study", n.alias("n"), "id", "line")


def in_cubes(points: DataFrame, v: DataFrame, radius: int) -> DataFrame:
    """(series, id, d, z, y, x, label): the voxels ``v`` (series, x, y, z, label) in the cube of ``radius`` about each point, ``d`` its squared distance.

    Voxels are gathered in cells as wide as a cube, one row each; a cube meets eight cells at most, so that a point moves as eight rows and
    a cell once, and only cells that a cube meets are gathered.
    """
    wide, cell = 2 * radius + 1, ["series", "cx", "cy", "cz"]
    asked = points.select("series", "id", *(F.col(c).alias(f"p{c}") for c in "xyz"))
    for c in "xyz":
        low, high = (F.floor((F.col(f"p{c}") + k) / wide).cast("int") for k in (-radius, radius))
        asked = asked.withColumn(f"c{c}", F.explode(F.sequence(low, high)))
    held = v.select("series", *(F.floor(F.col(c) / wide).cast("int").alias(f"c{c}") for c in "xyz"), F.struct("z", "y", "x", "label").alias("at"))
    held = held.join(asked.select(*cell).distinct(), cell, "left_semi").groupBy(*cell).agg(F.collect_list("at").alias("voxels"))
    near_ = lambda a: (F.abs(a["x"] - F.col("px")) <= radius) & (F.abs(a["y"] - F.col("py")) <= radius) & (F.abs(a["z"] - F.col("pz")) <= radius)
    hit = asked.join(held, cell).select("series", "id", "px", "py", "pz", F.explode(F.filter("voxels", near_)).alias("a"))
    d = sum(((F.col(f"a.{c}") - F.col(f"p{c}")) * (F.col(f"a.{c}") - F.col(f"p{c}")) for c in "xyz"), F.lit(0))
    return hit.select("series", "id", d.alias("d"), "a.*")


def near(points: DataFrame, v: DataFrame, radius: int = 3) -> DataFrame:
    """(series, id, x, y, z, label): the labelled voxel nearest to each point's (series, id, x, y, z), within a cube; ties by z, y, x.

    ``v``: series, x, y, z, label; labels above 0 count.  A point with none in its cube, or with a null place, has no row.
    """
    hit = in_cubes(points, v.where("label > 0"), radius)
    return hit.groupBy("series", "id").agg(F.min(F.struct("d", "z", "y", "x", "label")).alias("b")).select("series", "id", "b.x", "b.y", "b.z", "b.label")


def majority(points: DataFrame, v: DataFrame, radius: int = 3) -> DataFrame:
    """(series, id, label): the label (1, 2 or 3) of most voxels in the cube about each point; of as many, the one met first."""
    k = in_cubes(points, v.where("label in (1, 2, 3)"), radius).groupBy("series", "id", "label").agg(F.count("*").alias("n"), F.min(F.struct("z", "y", "x")).alias("at"))
    return k.groupBy("series", "id").agg(F.min_by("label", F.struct(-F.col("n"), "at")).alias("label"))
