"""The field whose zero is the surface of bone: thin walls, interpolation by shape, and the whole reconstruction.

Voxel rows (series, x, y, z, hu); spacings in mm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cubic
from .components import clean_field, signed_distance
from .reduce import soft_level
from .resample import block_mean, planes, resample_z
from .stencil import dilate, gaussian

AXES = ("x", "y", "z")


def thin_walls(v: DataFrame, threshold: float, low: Column | float, spacing: dict[str, float] | None = None, radius: float = 1.5, axes: tuple[str, ...] = AXES) -> DataFrame:
    """``v`` with ``local``: the threshold, lowered down to ``low`` next to bone, which walls thinner than a voxel do not reach."""
    spacing = spacing or {}
    reach = {a: max(1, math.floor(radius / spacing.get(a, 1.0) + 0.5)) for a in axes}
    keys = [c for c in ("series", "z") if c == "series" or c not in axes]
    m = v.withColumn("m", (F.col("hu") >= threshold).cast("double"))
    if len(keys) > 1:  # slice by slice
        m = m.withColumn("__key", F.concat_ws("/", *keys))
    key = "__key" if len(keys) > 1 else "series"
    m = gaussian(dilate(m, reach, "m", key), {a: 0.5 for a in axes}, "m", key, spacing)
    low = low if isinstance(low, Column) else F.lit(float(low))
    return m.withColumn("local", F.lit(float(threshold)) - (F.lit(float(threshold)) - low) * F.least(F.lit(1.0), F.col("m"))).drop("m", "__key")


def shape_field(v: DataFrame, threshold: float, target: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), low: Column | float | None = None) -> DataFrame:
    """(series, x, y, k, field): signed distances of each slice's bone, interpolated between slices every ``target`` mm."""
    if low is None:
        d = signed_distance(v, threshold, 40.0, spacing[:2], -spacing[2] / 2)
    else:
        v = thin_walls(v, threshold, low, {"x": spacing[0], "y": spacing[1]}, axes=("x", "y")).withColumn("above", (F.col("hu") >= F.col("local")).cast("int"))
        d = signed_distance(v.select("series", "x", "y", "z", "above"), 1, 40.0, spacing[:2], -spacing[2] / 2, "above")
    if target >= 0.95 * spacing[2]:
        return d.select("series", "x", "y", F.col("z").cast("long").alias("k"), F.col("d").alias("field"))
    p = planes(d, "d", target / spacing[2])
    return p.select("series", "x", "y", "k", F.when(F.col("t") < 1e-4, F.col("p1")).otherwise(cubic(*(F.col(f"p{i}") for i in range(4)), F.col("t"))).alias("field"))


def shrink_factor(dims: tuple[int, int, int], spacing: tuple[float, float, float], target: float, budget: float) -> int:
    """In-plane factor that keeps a volume within ``budget`` voxels and pixels at 0.5 mm or near it."""
    sz = min(spacing[2], max(target, 0.2))
    nz, f = max(dims[2], (dims[2] - 1) * spacing[2] / sz + 1), 1
    while dims[0] / f * (dims[1] / f) * nz > budget:
        f += 1
    while spacing[0] * (f + 1) <= 0.5:
        f += 1
    return f


def reconstruct(v: DataFrame, threshold: float, target: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), method: str = "cubic", smoothing: float = 0.0, thin: bool = False, small_parts: bool = True, factor: int = 1, least: float = 150.0) -> DataFrame:
    """(series, x, y, z, hu, field) of each volume: shrunk in the plane, resampled along z, its field smoothed and small parts taken out.

    With thick slices smoothing is wider along z.  Voxels of parts taken out are at most ``threshold`` - 200.
    """
    if factor > 1:
        v = block_mean(v, factor)
        spacing = (spacing[0] * factor, spacing[1] * factor, spacing[2])
    low = None
    if thin:  # half way between the soft tissue of a volume and the threshold
        soft = soft_level(v, int(threshold)).select("series", (F.col("level") + 0.5 * (threshold - F.col("level"))).alias("low"))
        v, low = v.join(soft, "series"), F.col("low")
    d = resample_z(v.select("series", "x", "y", "z", "hu"), target, spacing[2], "cubic" if method == "shape" else method).withColumnRenamed("k", "z")
    fine = target < 0.95 * spacing[2]
    sz = target if fine else spacing[2]
    if method == "shape":
        d = d.join(shape_field(v, threshold, target, spacing, low).withColumnRenamed("k", "z"), ["series", "x", "y", "z"])
    elif thin:
        d = thin_walls(d.join(soft, "series"), threshold, low, dict(zip(AXES, (*spacing[:2], sz), strict=True))).withColumn("field", F.col("hu") - F.col("local"))
    else:
        d = d.withColumn("field", (F.col("hu") - threshold).cast("double"))
    d = d.select("series", "x", "y", "z", "hu", "field")
    if smoothing > 0:
        along = max(smoothing, 0.25 * spacing[2]) if spacing[2] > 2 * spacing[0] else smoothing
        d = gaussian(d, {"x": smoothing, "y": smoothing, "z": along}, "field", spacing=dict(zip(AXES, (*spacing[:2], sz), strict=True)))
    if small_parts:
        d = clean_field(d.withColumn("z", F.col("z").cast("int")), least=least / (spacing[0] * spacing[1] * sz))
        d = d.withColumn("hu", F.when(F.col("dropped") & (F.col("hu") >= threshold), F.least(F.col("hu"), F.lit(threshold - 200))).otherwise(F.col("hu"))).drop("dropped")
    return d
