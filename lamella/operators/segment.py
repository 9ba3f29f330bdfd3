"""Air spaces, vessels and metal objects in voxel rows (series, x, y, z, hu)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import settle
from .stencil import line

AXES = ("x", "y", "z")
#: fixed values: least mm3 of an air space and of a group of vessels
LEAST_AIR, LEAST_VESSEL = 150.0, 60.0
#: fixed values: least length, length over width and most width of a screw; least length and width of a plate, and its most thickness
SCREW, PLATE = (4.0, 2.2, 4.0), (8.0, 3.0, 2.5)


def airways(v: DataFrame, air: float = -400) -> DataFrame:
    """(series, z, x, y) of air that no path of air within its slice joins to the slice's border.  A task holds one slice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_air = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), bool)
        is_air[pdf["y"], pdf["x"]] = pdf["hu"] < air
        out = is_air.copy()
        out[1:-1, 1:-1] = False
        while True:
            near = out.copy()
            near[1:] |= out[:-1]
            near[:-1] |= out[1:]
            near[:, 1:] |= out[:, :-1]
            near[:, :-1] |= out[:, 1:]
            near &= is_air
            if (near == out).all():
                break
            out = near
        inner = (is_air & ~out)[pdf["y"], pdf["x"]]
        return pdf.loc[inner, ["series", "z", "x", "y"]]

    return v.groupBy("series", "z").applyInPandas(run, "series int, z int, x int, y int")


def vessels(v: DataFrame, lo: float = 150, hi: float = 500, bone: float = 700, steps: int = 2) -> DataFrame:
    """Voxels of lo <= hu < hi that ``steps`` face-to-face steps do not reach from dense bone."""
    v = v.withColumn("__near", (F.col("hu") >= bone).cast("int"))
    for _ in range(steps):
        reach = F.col("__near")
        for a in AXES:
            w = line(a, AXES, "series")
            reach = F.greatest(reach, F.coalesce(F.lag("__near").over(w), F.lit(0)), F.coalesce(F.lead("__near").over(w), F.lit(0)))
        v = v.withColumn("__near", reach)
    return v.where((F.col("hu") >= lo) & (F.col("hu") < hi) & (F.col("__near") == 0)).drop("__near")


def principal_axes(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``axes``, nine numbers: the unit axes of most, middle and least spread of the covariances xx to zz; one row a piece."""
    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    place = [[0, 1, 2], [1, 3, 4], [2, 4, 5]]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def run(batches):
        for b in batches:
            six = np.stack([b.column(n).to_numpy() for n in names], axis=1)
            axes = np.linalg.eigh(six[:, place])[1][:, :, ::-1].transpose(0, 2, 1)
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(six) + 1, dtype=np.int32) * 9), pa.array(axes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, own], names=[*b.schema.names, "axes"])

    return pieces.mapInArrow(run, kinds + ", axes array<double>")


def metal_parts(v: DataFrame, seed: float | Column, low: float | Column, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), least_mm3: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(voxels, objects): (series, x, y, z, object) of metal, and what ``metal_objects`` gives.

    Voxels from ``seed`` grow by 1.5 mm over faces into those from ``low`` (numbers, or columns of ``v``); components (26 neighbours)
    under ``least_mm3`` are dropped.  Centres and covariances are aggregates a piece, and so are the extents along the axes: no volume meets in a task.
    """
    from .components import joined
    from .structures import PLACE, grow

    steps, unit = max(1, int(np.floor(1.5 / min(spacing) + 0.5))), float(np.prod(spacing))
    m = v.where(F.col("hu") >= low).select(*PLACE, (F.col("hu") >= seed).cast("int").alias("on"), F.lit(1).alias("may"))
    comp = settle(joined(grow(m, steps).where("on = 1"), corners=True))
    mm = {a: F.col(a) * s for a, s in zip(AXES, spacing, strict=True)}
    pairs = [F.covar_pop(mm[a], mm[b]).alias(a + b) for i, a in enumerate(AXES) for b in AXES[i:]]
    pieces = comp.groupBy("series", "root").agg(F.count("*").alias("n"), *(F.avg(e).alias(f"c{a}") for a, e in mm.items()), *pairs).where(F.col("n") * unit >= least_mm3)
    pieces = pieces.withColumn("object", F.row_number().over(W.partitionBy("series").orderBy("root")))
    pieces = settle(principal_axes(pieces)).select("series", "root", "object", "n", "cx", "cy", "cz", "axes")
    own = comp.join(pieces.select("series", "root", "object", "axes", "cx", "cy", "cz"), ["series", "root"])
    along = [sum((F.col("axes")[3 * k + i] * (mm[a] - F.col(f"c{a}")) for i, a in enumerate(AXES)), F.lit(0.0)) for k in range(3)]
    sizes = ("length", "width", "thickness")
    spread = own.groupBy("series", "root").agg(*((F.max(e) - F.min(e) + min(spacing)).alias(n) for e, n in zip(along, sizes, strict=True)))
    d = pieces.join(spread, ["series", "root"])
    length, width, thick = (F.col(n) for n in sizes)
    screw = (length >= SCREW[0]) & (length / F.greatest(width, F.lit(0.5)) >= SCREW[1]) & (width <= SCREW[2])
    plate = (length >= PLATE[0]) & (width >= PLATE[1]) & (thick <= F.greatest(F.lit(PLATE[2]), width * 0.4))
    kind = F.when(screw, "screw").when(plate, "plate").otherwise("fragment")
    objects = d.select("series", "object", kind.alias("kind"), (F.col("n") * unit).alias("volume"), *sizes, "cx", "cy", "cz")
    return own.select(*PLACE, "object"), objects


def metal_objects(v: DataFrame, seed: float, low: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), least_mm3: float = 1.5) -> DataFrame:
    """(series, object, kind, volume, length, width, thickness, cx, cy, cz) of metal pieces: extents along their principal axes, in mm."""
    return metal_parts(v, seed, low, spacing, least_mm3)[1]


def describe(objects: DataFrame, dims: DataFrame, near: DataFrame | None = None, midline: float = 6.0, share: float = 0.0) -> DataFrame:
    """Objects with ``location``: side, third and depth within the volume's box; x grows to the left, y to the back, z upward.

    ``dims``: series, and the box's sizes nx, ny, nz in mm.  ``near`` (series, object, near, voxels) turns objects of which more than
    ``share`` lies next to enamel into restorations.
    """
    o = objects.join(dims, "series")
    dx = F.col("cx") - (F.col("nx") - 1) / 2
    up, back = ((F.col(f"c{c}") / F.greatest(F.lit(1), F.col(f"n{c}") - 1)) for c in ("z", "y"))
    side = F.when(F.abs(dx) < midline, "midline").when(dx > 0, "left side").otherwise("right side")
    level = F.when(up < 0.33, "lower third").when(up < 0.66, "middle third").otherwise("upper third")
    depth = F.when(back < 0.4, "front").when(back < 0.65, "middle").otherwise("back")
    o = o.withColumn("location", F.concat_ws(", ", side, level, depth))
    if near is not None:
        o = o.join(near.select("series", "object", (F.col("near") > F.col("voxels") * share).alias("enamel")), ["series", "object"], "left")
        o = o.withColumn("kind", F.when(F.coalesce("enamel", F.lit(False)), "restoration").otherwise(F.col("kind")))
    return o.select(*objects.columns, "location")


def regions(mask: DataFrame, dims: DataFrame, least: float, midline: float = 8.0) -> DataFrame:
    """(series, component, volume, cx, cy, cz, location) of the face-joined parts of a mask of at least ``least`` voxels (1 mm).

    ``dims``: series, nx, ny, nz.  The largest of a series come first by ``volume``.
    """
    from .structures import label_voxels

    comp = label_voxels(mask)
    c = comp.groupBy("series", "component").agg(F.count("*").cast("double").alias("volume"), *(F.avg(a).alias(f"c{a}") for a in AXES)).where(F.col("volume") >= least)
    c = c.join(dims, "series")
    dx = F.col("cx") - (F.col("nx") - 1) / 2
    up, back = (F.col(f"c{a}") / F.greatest(F.lit(1), F.col(f"n{a}") - 1) for a in ("z", "y"))
    side = F.when(F.abs(dx) < midline, "midline").when(dx > 0, "left side").otherwise("right side")
    level = F.when(up < 0.33, "lower third").when(up < 0.66, "middle third").otherwise("upper third")
    depth = F.when(back < 0.4, "front").when(back < 0.65, "middle").otherwise("back")
    return c.select("series", "component", "volume", "cx", "cy", "cz", F.concat_ws(", ", side, level, depth).alias("location"))


def keep_regions(mask: DataFrame, least: float) -> DataFrame:
    """(series, x, y, z, component) of the mask's face-joined parts of at least ``least`` voxels; smaller ones are cleared."""
    from .structures import label_voxels

    comp = settle(label_voxels(mask))
    big = comp.groupBy("series", "component").count().where(F.col("count") >= least)
    return comp.join(big, ["series", "component"], "left_semi").select("series", "x", "y", "z", "component")


def merge_labels(v: DataFrame, air: DataFrame, blood: DataFrame | None = None) -> DataFrame:
    """``v`` (series, x, y, z, label ...) with 5 where there is inner air and 6 where there are vessels, but for voxels labelled before."""
    key = ["series", "x", "y", "z"]
    d = v.join(air.select(*key, F.lit(True).alias("__air")), key, "left")
    label = F.when(F.col("label") != 0, F.col("label")).when(F.col("__air"), 5)
    if blood is not None:
        d = d.join(blood.select(*key, F.lit(True).alias("__blood")), key, "left")
        label = label.when(F.col("__blood"), 6)
    return d.withColumn("label", label.otherwise(F.col("label"))).drop("__air", "__blood")


def metal_field(v: DataFrame, low: float, on: str = "metal") -> DataFrame:
    """``v`` with ``field``, whose zero is the surface of the metal mask ``on``."""
    return v.withColumn("field", F.when(F.col(on), F.greatest(F.lit(0.05), F.col("hu") - low + 1)).otherwise(F.least(F.lit(-0.05), F.col("hu") - low)))
