"""Connected components of voxels brick by brick, and distances line by line."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bricks import BITS, BRICK, box, column, deal, places
from ..functions.graph import components
from ..functions.shared import settle


def label6(mask: np.ndarray) -> np.ndarray:
    """Labels of a 3-D mask by 6-neighbourhood: the smallest flat index of each component, -1 outside.

    Every voxel takes the least label of its neighbours, then labels are followed to where they point, until nothing changes.
    """
    flat = np.arange(mask.size).reshape(mask.shape)
    lab = np.where(mask, flat, mask.size)
    while True:
        new = lab.copy()
        for axis in range(3):
            a, b = [slice(None)] * 3, [slice(None)] * 3
            a[axis], b[axis] = slice(1, None), slice(None, -1)
            a, b = tuple(a), tuple(b)
            new[a] = np.where(mask[a], np.minimum(new[a], new[b]), new[a])
            new[b] = np.where(mask[b], np.minimum(new[a], new[b]), new[b])
        new = np.where(mask, new, mask.size)
        ext = np.append(new.ravel(), mask.size)
        new = ext[new]
        new = np.where(mask, new, mask.size)
        if (new == lab).all():
            return np.where(mask, lab, -1)
        lab = new


#: Places along a side of a brick.
SIDE = 64


def label26(mask: np.ndarray) -> np.ndarray:
    """As ``label6``, over faces, edges and corners."""
    none = mask.size
    lab = np.where(mask, np.arange(none).reshape(mask.shape), none)
    while True:
        new = lab
        for axis in range(mask.ndim):  # least of three along each axis in turn: least of the 26 around
            a, b = [slice(None)] * mask.ndim, [slice(None)] * mask.ndim
            a[axis], b[axis] = slice(1, None), slice(None, -1)
            wide = new.copy()
            wide[tuple(a)] = np.minimum(wide[tuple(a)], new[tuple(b)])
            wide[tuple(b)] = np.minimum(wide[tuple(b)], new[tuple(a)])
            new = wide
        new = np.append(np.where(mask, new, none).ravel(), none)
        new = np.where(mask, new[new[:-1]].reshape(mask.shape), none)
        if (new == lab).all():
            return np.where(mask, lab, -1)
        lab = new


def joined(v: DataFrame, corners: bool = False, side: int = SIDE) -> DataFrame:
    """(series, x, y, z, root) of the rows given, joined over faces (or edges and corners too); ``root`` numbers a component's first voxel.

    A task holds one brick of ``side`` with one layer of the next, and labels what it holds by the first voxel there.  A voxel that
    several bricks hold has a label in each: these are the same component, and the graph of such labels is all that leaves the bricks.
    """
    series, label = v.schema["series"].dataType.simpleString(), label26 if corners else label6

    def run(table: pa.Table) -> pa.Table:
        low, at, shape = box(table)
        mask = np.zeros(shape, bool)
        mask[at] = True
        first = np.stack(np.unravel_index(label(mask)[at], shape)) + low[:, None]
        own = np.all([column(table, c) // side == column(table, b) for c, b in zip("xyz", BRICK, strict=True)], axis=0)
        return pa.table([table.column("series"), *(table.column(c) for c in "xyz"), pa.array(places(*first[::-1])), pa.array(own)], names=["series", "x", "y", "z", "label", "own"])

    dealt = deal(v.select("series", *(F.col(c).cast("int").alias(c) for c in "xyz")), side, after=1)
    every = settle(dealt.groupBy("series", *BRICK).applyInArrow(run, f"series {series}, x int, y int, z int, label long, own boolean"))
    edge = F.lit(False)
    for c in "xyz":
        edge = edge | (F.col(c) % side == 0)
    several = every.where(edge).groupBy("series", "x", "y", "z").agg(F.min("label").alias("p"), F.collect_set("label").alias("q"))  # eight bricks at most
    links = settle(several.where(F.size("q") > 1).select("series", "p", F.explode("q").alias("q")).where("p <> q").distinct())
    own = every.where("own").drop("own")
    if links.isEmpty():
        return own.withColumnRenamed("label", "root")
    ends = links.select("series", F.col("p").alias("label")).unionByName(links.select("series", F.col("q").alias("label"))).distinct()
    ends = settle(ends.withColumn("node", F.monotonically_increasing_id()))
    for c in "pq":
        links = links.join(ends.select("series", F.col("label").alias(c), F.col("node").alias(f"n{c}")), ["series", c])
    found = settle(components(links.select(F.col("np").alias("p"), F.col("nq").alias("q"))).join(ends, "node"))
    first = found.join(found.groupBy("root").agg(F.min("label").alias("first")), "root").select("series", "label", "first")
    return own.join(first, ["series", "label"], "left").select("series", "x", "y", "z", F.coalesce("first", "label").alias("root"))


def label_voxels(v: DataFrame, corners: bool = False, side: int = SIDE) -> DataFrame:
    """(series, x, y, z, component) of the rows given; components of a series count from 1 in order of their first voxel."""
    d = settle(joined(v, corners, side))
    number = d.select("series", "root").distinct().withColumn("component", F.row_number().over(W.partitionBy("series").orderBy("root")))
    return d.join(number, ["series", "root"]).select("series", "x", "y", "z", "component")


def components6(v: DataFrame, threshold: float = 200, side: int = SIDE) -> DataFrame:
    """(series, component, voxels) of hu >= threshold; a component is named by its smallest flat index."""
    wide = v.groupBy("series").agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"))
    c = joined(v.where(F.col("hu") >= threshold), side=side).groupBy("series", "root").agg(F.count("*").alias("voxels")).join(wide, "series")
    x, y, z = (F.shiftright("root", k * BITS).bitwiseAND(F.lit((1 << BITS) - 1)) for k in range(3))
    return c.select("series", ((z * F.col("ny") + y) * F.col("nx") + x).alias("component"), "voxels")


def keep_large(comps: DataFrame, share: float = 0.005, least: float = 150) -> DataFrame:
    """Components of at least ``share`` of the largest and ``least`` voxels (150 mm3 at 1 mm)."""
    top = comps.groupBy("series").agg(F.max("voxels").alias("top"))
    return comps.join(top, "series").where(F.col("voxels") >= F.greatest(F.col("top") * share, F.lit(least))).select("series", "component", "voxels")


def clean_field(v: DataFrame, share: float = 0.005, least: float = 150) -> DataFrame:
    """(series, x, y, z, field, dropped): ``field`` > 0 in small components becomes -0.01."""
    place = ["series", "x", "y", "z"]
    comp = label_voxels(v.where("field > 0"))
    size = comp.groupBy("series", "component").agg(F.count("*").alias("voxels"))
    small = size.join(keep_large(size, share, least).select("series", "component"), ["series", "component"], "left_anti")
    gone = comp.join(small, ["series", "component"], "left_semi").select(*place, F.lit(True).alias("dropped"))
    d = v.join(gone, place, "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))
    return d.withColumn("field", F.when(F.col("dropped"), -0.01).otherwise(F.col("field")))


def least_square(at: np.ndarray, cost: np.ndarray, step: float) -> np.ndarray:
    """At each place of a line the least ``cost[j] + (step * (at - at[j])) ** 2``; a cost of NaN offers nothing.

    With the squares of ``at`` split off each j offers a straight line, so that the least is on the lower hull of (at, cost + square):
    one pass builds it, and the best j of a place is where the hull's slope passes the place's.  NaN where nothing is offered.
    """
    known = np.flatnonzero(~np.isnan(cost))
    if not len(known):
        return np.full(len(at), np.nan)
    known = known[np.lexsort((cost[known], at[known]))]
    known = known[np.unique(at[known], return_index=True)[1]]
    square = step * step
    place, height = at[known].tolist(), (cost[known] + square * at[known] ** 2).tolist()
    hull: list[int] = []
    for j, (x, h) in enumerate(zip(place, height, strict=True)):
        while len(hull) > 1:
            a, b = hull[-2:]
            if (height[b] - height[a]) * (x - place[b]) < (h - height[b]) * (place[b] - place[a]):
                break
            hull.pop()
        hull.append(j)
    slope = np.diff(np.asarray(height)[hull]) / np.diff(np.asarray(place)[hull])
    best = known[np.asarray(hull)[np.searchsorted(slope, 2 * square * at)]]
    return cost[best] + square * (at - at[best]) ** 2


def _along_x(step: float, half: float, cap: float, empty: float):
    """Lines of (x, inside, squared distances along y to both kinds) to signed distances."""

    def run(batches):
        for batch in batches:
            line = batch.column("line")
            sizes = np.diff(np.asarray(line.offsets))
            x, inside, to_in, to_out = (line.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
            at, d, end = x.astype(float), np.empty(len(x)), 0
            for n in sizes.tolist():
                part, end = slice(end, end + n), end + n
                own = inside[part].astype(bool)
                ways = [np.sqrt(least_square(at[part], c[part].astype(float), step)) for c in (to_in, to_out)]
                d[part] = np.clip(np.where(own, ways[1] - half, half - ways[0]), -cap, cap)
                d[part] = np.where(np.isnan(d[part]), np.where(own, cap, empty), d[part])
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield from pa.table({"series": batch.column("series").take(row), "z": batch.column("z").take(row), "x": x, "y": batch.column("y").take(row), "d": np.round(d, 6)}).to_batches()

    return run


def signed_distance(v: DataFrame, threshold: float = 0, cap: float = 40.0, spacing: tuple[float, float] = (1.0, 1.0), empty: float = -0.5, on: str = "hu") -> DataFrame:
    """(series, z, x, y, d): in each slice the distance to the nearest voxel of the other kind less half a voxel, positive inside.

    ``spacing``: mm along x and y.  A slice without voxels from ``threshold`` is ``empty`` throughout, one of nothing else ``cap``.
    Along y the nearest voxel of a kind is the last one met from either end; along x a task takes line after line, never a slice.
    A null counts as below the threshold, a place without a row as of no kind; rows that repeat a place are all kept and all count.
    """
    rows = v.select("series", *(F.col(c).cast("int").alias(c) for c in "zxy"), F.coalesce(F.col(on) >= threshold, F.lit(False)).alias("inside"))
    columns = W.partitionBy("series", "z", "x")
    for name, kind in (("in", F.col("inside")), ("out", ~F.col("inside"))):
        y = F.when(kind, F.col("y"))
        rows = rows.withColumns({f"{name}_low": F.last(y, True).over(columns.orderBy("y")), f"{name}_high": F.last(y, True).over(columns.orderBy(F.desc("y")))})
    far = [F.pow(F.least(F.col("y") - F.col(f"{k}_low"), F.col(f"{k}_high") - F.col("y")) * float(spacing[1]), F.lit(2.0)).alias(f"to_{k}") for k in ("in", "out")]
    lines = rows.groupBy("series", "z", "y").agg(F.collect_list(F.struct("x", "inside", *far)).alias("line"))
    kind = v.schema["series"].dataType.simpleString()
    return lines.mapInArrow(_along_x(float(spacing[0]), 0.5 * min(spacing), cap, empty), f"series {kind}, z int, x int, y int, d double")
