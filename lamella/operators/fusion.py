"""Several stacks of one study fused on one grid, brick by brick.

Volumes are stored as bricks with one more place on their high faces, so that every sample lies in one brick with all its corners.
Bricks of the target grid are joined with the bricks that their box meets in each series; a task holds those of one target brick.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bricks import AXES, BRICK, column, deal, kind
from ..functions.scalar import to_int16
from .views import fusion_grid, index_map

#: Places along a side of a brick.
SIDE = 16
#: fixed values: least weight of a series off its slices, least mm of a slice's reach and its reach in pixels, the value where no series is
FLOOR, REACH, REACH_PIXELS, NOTHING = 0.02, 0.6, 1.5, -1024


def bricked(v: DataFrame, side: int = SIDE) -> DataFrame:
    """(series, bx, by, bz, values) of voxel rows (series, x, y, z, hu): 16-bit values of a brick with its halo, x first; places without a voxel are null."""
    wide, names = side + 1, ["series", *BRICK, "values"]

    def run(table: pa.Table) -> pa.Table:
        b = [table.column(n)[0].as_py() for n in BRICK]
        x, y, z = (column(table, c).astype(np.int64) - k * side for c, k in zip(AXES, b, strict=True))
        values, there = np.zeros(wide**3, np.int32), np.zeros(wide**3, bool)
        at = (z * wide + y) * wide + x
        values[at], there[at] = column(table, "hu"), True
        own = pa.array(values, mask=~there)
        return pa.table([table.column("series").slice(0, 1), *(pa.array([k], pa.int32()) for k in b), pa.ListArray.from_arrays(pa.array([0, wide**3], pa.int32()), own)], names=names)

    d = v.select("series", *AXES, F.col("hu").cast("int").alias("hu"))
    return deal(d, side, after=1).groupBy("series", *BRICK).applyInArrow(run, f"series {kind(v, 'series')}, bx int, by int, bz int, values array<int>")


def _mapped(m, at):
    """Index of the source at an index of the target; ``m``: 12 numbers, row after row, the offset last."""
    return [m[4 * r] * at[0] + m[4 * r + 1] * at[1] + m[4 * r + 2] * at[2] + m[4 * r + 3] for r in range(3)]


def _wanted(targets: DataFrame, maps: DataFrame, side: int) -> DataFrame:
    """``maps`` for each brick of the target with the bricks of the series that its box meets."""
    t = targets.join(maps, "study")
    low, high = [F.col(f"t{c}") * side for c in AXES], [F.least((F.col(f"t{c}") + 1) * side, F.col(f"g{c}")) - 1 for c in AXES]
    m = [F.col("m")[i] for i in range(12)]
    for r, (b, n) in enumerate(zip(BRICK, ("nx", "ny", "nz"), strict=True)):
        ends = [(m[4 * r + k] * low[k], m[4 * r + k] * high[k]) for k in range(3)]
        first, last = (sum((f(p, q) for p, q in ends), m[4 * r + 3]) for f in (F.least, F.greatest))
        far = F.col(n) - 1
        meets = (first <= far + (0.5 if r == 2 else 0)) & (last >= (-0.5 if r == 2 else 0))
        inside = lambda e: F.floor(F.greatest(F.lit(0.0), F.least(e, far.cast("double"))) / side).cast("int")  # noqa: E731, B023
        t = t.where(meets).withColumn(b, F.explode(F.sequence(inside(first), inside(last))))
    return t


def fuse(grids: DataFrame, maps: DataFrame, voxels: DataFrame, side: int = SIDE) -> DataFrame:
    """(study, x, y, z, value): on each grid the weighted mean of the series that cover a place, as a 16-bit number.

    ``grids``: study and the sizes gx, gy, gz.  ``maps``: study, series, nx, ny, nz, sz, sigma, and m, the 12 numbers of the affine map
    (row after row, offset last) from grid to series index; one row a series.  ``voxels``: series, x, y, z, hu, dense.  A series weighs
    0.02 + exp(-(d / sigma)^2), d mm from its nearest slice, and is read linearly along each axis; in z it holds for half a slice
    beyond its ends.  Places that no series covers are -1024.
    """
    targets = grids
    for c in AXES:
        targets = targets.withColumn(f"t{c}", F.explode(F.sequence(F.lit(0), F.floor((F.col(f"g{c}") - 1) / side).cast("int"))))
    wanted = _wanted(targets, maps, side)
    key = ["study", "tx", "ty", "tz"]
    held = wanted.join(bricked(voxels, side), ["series", *BRICK])
    size = [f"g{c}" for c in AXES]
    # a grid's bricks that meet no series are there too
    every = targets.select(*key, *size).join(held.select(*key, *BRICK, "series", "nx", "ny", "nz", "sz", "sigma", "m", "values"), key, "left")
    wide = side + 1

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first = [table.column(f"t{c}")[0].as_py() * side for c in AXES]
        last = [min(f + side, table.column(g)[0].as_py()) for f, g in zip(first, size, strict=True)]
        z, y, x = (g.ravel() for g in np.meshgrid(*(np.arange(first[k], last[k]) for k in (2, 1, 0)), indexing="ij"))
        total, weight = np.zeros(len(x)), np.zeros(len(x))
        series = table.column("series").to_pylist()
        for r in sorted((r for r, name in enumerate(series) if name is not None), key=series.__getitem__):
            row = {c: table.column(c)[r].as_py() for c in ("nx", "ny", "nz", "sz", "sigma", "m", *BRICK)}
            u, v, w = _mapped(row["m"], (x, y, z))
            ok = (u >= 0) & (v >= 0) & (w >= -0.5) & (u <= row["nx"] - 1) & (v <= row["ny"] - 1) & (w <= row["nz"] - 0.5)
            w = np.clip(w, 0, row["nz"] - 1)
            low = [np.floor(c).astype(np.int64) for c in (u, v, w)]
            for c, b in zip(low, BRICK, strict=True):
                ok &= c // side == row[b]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            part = [(c - f)[at] for c, f in zip((u, v, w), low, strict=True)]
            i, j, k = (c[at] - row[b] * side for c, b in zip(low, BRICK, strict=True))
            values = table.column("values").chunk(0)[r].values.to_numpy(zero_copy_only=False).astype(float)
            value = np.zeros(len(at))
            for step in np.ndindex(2, 2, 2):
                share = np.prod([p if s else 1 - p for p, s in zip(part, step, strict=True)], axis=0)
                # a corner without share may lie beyond the volume
                spot = ((k + step[2]) * wide + j + step[1]) * wide + i + step[0]
                value += np.where(share > 0, np.where(share > 0, values[spot], 0.0) * share, 0.0)
            off = np.abs(w[at] - np.floor(w[at] + 0.5)) * row["sz"] / row["sigma"]
            own = np.exp(-off * off) + FLOOR
            total[at] += own * value
            weight[at] += own
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.where(weight > 0, total / weight, float(NOTHING))
        study = pa.array([table.column("study")[0].as_py()] * len(x), table.schema.field("study").type)
        return pa.table([study, *(pa.array(c, pa.int32()) for c in (x, y, z)), pa.array(value)], names=["study", *AXES, "value"])

    d = every.groupBy(*key).applyInArrow(run, f"study {kind(grids, 'study')}, x int, y int, z int, value double")
    return d.withColumn("value", to_int16(F.round("value", 9)))


def corners(geo: DataFrame) -> DataFrame:
    """``geo`` with lo and hi, the corners in mm of the box around each volume: the least and the most of its eight corners."""
    d = geo
    for a, c in enumerate(AXES):
        ends = []
        for k, (s, n) in enumerate(zip(("sx", "sy", "sz"), ("nx", "ny", "nz"), strict=True)):
            far = F.col("direction")[3 * k + a] * (F.col(n) - 1) * F.col(s)
            ends.append((F.least(F.lit(0.0), far), F.greatest(F.lit(0.0), far)))
        d = d.withColumn(f"lo{c}", sum((e[0] for e in ends), F.col("origin")[a])).withColumn(f"hi{c}", sum((e[1] for e in ends), F.col("origin")[a]))
    return d


def plan_grid(geo: DataFrame, budget: float = 16e6) -> tuple[DataFrame, DataFrame]:
    """(grids, maps) for ``fuse``: the grid of each study and the maps to its series.

    ``geo``: study, series, place (1: the main series), nx, ny, nz, sx, sy, sz (mm), origin (3) and direction (9 cosines, axis after
    axis).  The grid has the patient's axes, covers the main series and is as fine as the finest pixel and the budget allow.
    """
    fine = geo.groupBy("study").agg(F.min(F.least("sx", "sy")).alias("fine"))
    main = corners(geo.where("place = 1")).join(fine, "study")
    g = fusion_grid([F.col(f"lo{c}") for c in AXES], [F.col(f"hi{c}") for c in AXES], F.col("fine"), budget)
    main = main.select("study", g["s"].alias("s"), *(g[f"n{c}"].cast("int").alias(f"g{c}") for c in AXES), F.array(*(F.col(f"lo{c}") for c in AXES)).alias("at"))
    unit = [F.lit(float(i == j)) for i in range(3) for j in range(3)]
    each = geo.join(main, "study")
    a, b = index_map({"origin": [F.col("at")[i] for i in range(3)], "direction": unit, "spacing": [F.col("s")] * 3}, {"origin": [F.col("origin")[i] for i in range(3)], "direction": [F.col("direction")[i] for i in range(9)], "spacing": [F.col(c) for c in ("sx", "sy", "sz")]})
    numbers = [e for r in range(3) for e in (*a[3 * r : 3 * r + 3], b[r])]
    sigma = F.greatest(F.lit(REACH), F.least("sx", "sy") * REACH_PIXELS)
    return main, each.select("study", "series", "nx", "ny", "nz", "sz", sigma.alias("sigma"), F.array(*numbers).alias("m"))


def fuse_study(geo: DataFrame, voxels: DataFrame, budget: float = 16e6) -> tuple[DataFrame, DataFrame]:
    """(volume, grids): the study's series fused into one volume (study, x, y, z, value), and its grid (study, s, gx, gy, gz, at)."""
    grids, maps = plan_grid(geo, budget)
    return fuse(grids.select("study", *(f"g{c}" for c in AXES)), maps, voxels), grids
