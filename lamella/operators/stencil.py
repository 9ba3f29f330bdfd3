"""Fixed neighbourhoods on dense grids.  Each axis is a window along that axis within its line of voxels, so that what meets
in a task is a line and not a volume."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def line(axis: str, axes: tuple[str, ...], key: str) -> W:
    return W.partitionBy(key, *(a for a in axes if a != axis)).orderBy(axis)


def dilate(v: DataFrame, radius: dict[str, int], mask: str = "m", key: str = "series") -> DataFrame:
    """Box dilation of a 0/1 mask, axis by axis."""
    for axis, r in radius.items():
        v = v.withColumn(mask, F.max(mask).over(line(axis, tuple(radius), key).rowsBetween(-r, r)))
    return v


def erode6(v: DataFrame, mask: str = "m", key: str = "series", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """A voxel stays where it and its six neighbours are set; the outer shell goes."""
    keep = F.col(mask) == 1
    for a in axes:
        w = line(a, axes, key)
        keep = keep & (F.coalesce(F.lag(mask).over(w), F.lit(0)) == 1) & (F.coalesce(F.lead(mask).over(w), F.lit(0)) == 1)
    return v.withColumn(mask, keep.cast("int"))


def _clamped(value: str, w, k: int):
    """The neighbour k places on, or the last one before the edge."""
    if k == 0:
        return F.col(value)
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one value a line
    edge = F.first(value).over(full) if k < 0 else F.last(value).over(full)
    return F.coalesce(F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w), edge)


def gaussian(v: DataFrame, sigma: dict[str, float], value: str, key: str = "series", spacing: dict[str, float] | None = None) -> DataFrame:
    """Separable Gaussian with replicated edges; sigmas in mm, ``spacing`` 1 mm by default; those below 0.3 voxels are no smoothing."""
    for axis, mm in sigma.items():
        s = mm / (spacing or {}).get(axis, 1.0)
        if s < 0.3:
            continue
        r = math.ceil(2.5 * s)
        kernel = [math.exp(-k * k / (2 * s * s)) for k in range(-r, r + 1)]
        w, total = line(axis, tuple(sigma), key), sum(kernel)
        v = v.withColumn(value, sum((_clamped(value, w, k - r) * (g / total) for k, g in enumerate(kernel)), F.lit(0.0)))
    return v


def box_blur(v: DataFrame, r: int, value: str = "v", key: str = "img") -> DataFrame:
    """Mean of (2r+1) x (2r+1) with replicated edges."""
    for axis in ("x", "y"):
        w = line(axis, ("x", "y"), key)
        v = v.withColumn(value, sum((_clamped(value, w, k) for k in range(-r, r + 1)), F.lit(0.0)) / (2 * r + 1))
    return v


def median3(v: DataFrame, value: str = "v", key: str = "img") -> DataFrame:
    """3 x 3 median with replicated edges."""
    w = line("x", ("x", "y"), key)
    v = v.withColumn("__row", F.array(*(_clamped(value, w, k) for k in (-1, 0, 1))))
    w = line("y", ("x", "y"), key)
    nine = F.array_sort(F.flatten(F.array(*(_clamped("__row", w, k) for k in (-1, 0, 1)))))
    return v.withColumn(value, nine[4]).drop("__row")
