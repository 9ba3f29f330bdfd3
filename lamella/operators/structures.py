"""Structures of labelled voxel rows (series, x, y, z, hu, label): growth, competition, cuts, teeth and lower jaw.

Labels: 0 none, 1 skull, 2 lower jaw, 3 teeth, 4 metal.  Growth by a number of steps and erosion are windows along lines of
voxels; what runs to a fixpoint is a kernel on the voxels of one structure of one exam.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bricks import BRICK, box, column, deal, place
from ..functions.shared import settle
from .components import SIDE, label6, label_voxels
from .reduce import percentile
from .stencil import erode6, line

AXES = ("x", "y", "z")
PLACE = ["series", "x", "y", "z"]
#: fixed values: the least share of the teeth's range that dentine reaches
DENTINE = 0.62
#: fixed values: bounds of a lower jaw as least width, most height, most gap below, farthest back, least and most mm3, least mm
JAW = {"span": 0.35, "height": 0.4, "lowest": 0.12, "back": 0.6, "least": 10000.0, "most": 110000.0, "tall": 30.0}


def _box(pdf: pd.DataFrame) -> tuple[tuple[np.ndarray, ...], tuple[int, ...]]:
    """Places (z, y, x) within the bounding box, and its shape."""
    at = pdf[["z", "y", "x"]].to_numpy()
    at = at - at.min(0)
    return tuple(at.T), tuple((at.max(0) + 1).tolist())


def _ways(n: int = 3):
    for axis in range(n):
        a, b = [slice(None)] * n, [slice(None)] * n
        a[axis], b[axis] = slice(1, None), slice(None, -1)
        yield tuple(a), tuple(b)


SLAB = 64


def grow(v: DataFrame, steps: int, on: str = "on", may: str = "may", slab: int = SLAB) -> DataFrame:
    """0/1 column ``on`` grown over faces by ``steps`` into voxels where ``may`` is 1.

    A task holds a slab of ``slab`` slices with ``steps`` more on either side, and of these only the voxels that may be reached or
    grow; what is reached is joined back.
    """
    if steps < 1:
        return v

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, shape = _box(pdf)
        may_, on_ = np.zeros(shape, bool), np.zeros(shape, bool)
        may_[at], on_[at] = pdf["may"].to_numpy() == 1, pdf["on"].to_numpy() == 1
        had = on_.copy()
        for _ in range(steps):
            new = on_.copy()
            for a, b in _ways():
                new[a] |= on_[b]
                new[b] |= on_[a]
            new &= may_ | on_
            if (new == on_).all():
                break
            on_ = new
        low, s = pdf["z"].min(), pdf["slab"].iloc[0]
        got = np.argwhere(on_ & ~had)
        got = got[(got[:, 0] + low) // slab == s]
        base = pdf[["z", "y", "x"]].min().to_numpy()
        z, y, x = (got + base).T if len(got) else np.zeros((3, 0), int)
        return pd.DataFrame({"series": np.full(len(got), pdf["series"].iloc[0]), "x": x, "y": y, "z": z})

    part = v.where((F.col(on) == 1) | (F.col(may) == 1)).select(*PLACE, F.col(on).alias("on"), F.col(may).alias("may"))
    slabs = F.sequence(F.floor((F.col("z") - steps) / slab), F.floor((F.col("z") + steps) / slab))
    reached = part.withColumn("slab", F.explode(slabs)).groupBy("series", "slab").applyInPandas(run, "series int, x int, y int, z int")
    d = v.join(reached.withColumn("__hit", F.lit(1)), PLACE, "left")
    return d.withColumn(on, F.coalesce("__hit", F.col(on))).select(*v.columns)


def _compete(may: np.ndarray, seed: np.ndarray, steps: int | None) -> np.ndarray:
    """``seed`` (flat index, or the array's size for none) spread over ``may``: the nearest by steps, the smallest on ties."""
    none, k = may.size, 0
    while steps is None or k < steps:
        best = np.full(may.shape, none)
        for a, b in _ways():
            best[a] = np.minimum(best[a], seed[b])
            best[b] = np.minimum(best[b], seed[a])
        new = may & (seed == none) & (best < none)
        if not new.any():
            break
        seed[new] = best[new]
        k += 1
    return seed


def _spread(side: int, steps: int | None):
    """A brick's voxels after all that its halo and its own seeds reach; of a voxel's offers the least (steps, seed) counts."""

    def run(table: pa.Table) -> pa.Table:
        _, at, shape = box(table)
        own = np.all([column(table, c) // side == column(table, b) for c, b in zip(AXES, BRICK, strict=True)], axis=0)
        seed, far, owner = (column(table, c) for c in ("seed", "steps", "owner"))
        seeds, first, rank = np.unique(seed, return_index=True, return_inverse=True)
        n, none = len(seeds), np.iinfo(np.int64).max // 2
        key = np.full(shape, none)
        key[at] = np.where(seed >= 0, far.astype(np.int64) * n + rank, none)
        may = np.zeros(shape, bool)
        may[at] = own
        most = none if steps is None else (steps + 1) * n
        while True:
            new = key.copy()
            for a, b in _ways():
                np.minimum(new[a], key[b] + n, out=new[a])
                np.minimum(new[b], key[a] + n, out=new[b])
            new = np.where(may & (new < most), new, key)
            if (new == key).all():
                break
            key = new
        got = key[at][own]
        hit = got < none
        which = first[np.where(hit, got % n, 0)]
        new_seed, new_far = np.where(hit, seed[which], -1), np.where(hit, got // n, 0).astype(np.int32)
        changed = (new_seed != seed[own]) | (new_far != far[own])
        keep = pa.array(own)
        return pa.table([table.column("series").filter(keep), *(table.column(c).filter(keep) for c in AXES), pa.array(np.where(hit, owner[which], 0).astype(np.int32)), pa.array(new_seed), pa.array(new_far), pa.array(changed)], names=["series", *AXES, "owner", "seed", "steps", "changed"])

    return run


def regrow(v: DataFrame, steps: int | None = None, side: int = SIDE, most: int = 1000) -> DataFrame:
    """(series, x, y, z, owner): voxels with owner 0 go to the owner that reaches them in fewest steps through the rows given.

    Of seeds as near, the one that comes first along x, then y, then z wins; what none reaches keeps 0.  A task holds a brick with
    one layer around.  Rounds hand on (steps, seed) over the bricks' faces, to bricks next to which something changed, until nothing does;
    more than ``most`` rounds raise.
    """
    series = v.schema["series"].dataType.simpleString()
    seed = F.when(F.col("owner") > 0, place()).otherwise(F.lit(-1)).cast("long")
    own_brick = [F.floor(F.col(c) / side).cast("int").alias(b) for c, b in zip(AXES, BRICK, strict=True)]
    state = v.select("series", *(F.col(c).cast("int").alias(c) for c in AXES), F.col("owner").cast("int").alias("owner"), seed.alias("seed"), F.lit(0).alias("steps"))
    state = settle(state.withColumn("changed", F.col("owner") > 0))
    for turn in range(most):
        ask = deal(state.where("changed").select("series", *AXES), side, 1, 1)
        if turn:  # a brick that has run is at rest until a neighbour changes
            ask = ask.where(" or ".join(f"{b} <> floor({c} / {side})" for c, b in zip(AXES, BRICK, strict=True)))
        active = settle(ask.select("series", *BRICK).distinct())
        if active.isEmpty():
            return state.select(*PLACE, "owner")
        near = deal(state.drop("changed"), side, 1, 1).join(active, ["series", *BRICK], "left_semi")
        done = near.groupBy("series", *BRICK).applyInArrow(_spread(side, steps), f"series {series}, x int, y int, z int, owner int, seed long, steps int, changed boolean")
        rest = state.withColumns(dict(zip(BRICK, own_brick, strict=True))).join(active, ["series", *BRICK], "left_anti").drop(*BRICK).withColumn("changed", F.lit(False))
        state = settle(done.unionByName(rest))
    raise RuntimeError(f"regrow: no fixpoint after {most} rounds")


def split_by_plane(v: DataFrame, cuts: DataFrame, most: float = 0.98) -> DataFrame:
    """(series, x, y, z) of the part that a plane cuts off: voxels of the hit one's label, on its side and joined to it.

    ``cuts``: one row a series with the voxel hit (hx, hy, hz), a place of the plane (px, py, pz) and its normal (ax, ay, az).
    A part of ``most`` of the structure or more is no cut; nor is a hit outside every structure.
    """
    def side(names):
        return sum(((F.col(a) - F.col(f"p{c}")) * F.col(f"a{c}") for a, c in zip(names, AXES, strict=True)), F.lit(0.0)) >= 0

    hit = v.join(cuts, "series").where("x = hx and y = hy and z = hz and label > 0").select("series", *(f"{a}{c}" for a in "hpa" for c in AXES), F.col("label").alias("hit"))
    own = v.join(hit, "series").where("label = hit").select(*PLACE, "hx", "hy", "hz", (side(AXES) == side(["hx", "hy", "hz"])).alias("same"))
    comp = label_voxels(own.where("same"))
    start = comp.join(hit, "series").where("x = hx and y = hy and z = hz").select("series", "component")
    part = comp.join(start, ["series", "component"]).select(*PLACE)
    n = own.groupBy("series").agg(F.count("*").alias("total")).join(part.groupBy("series").agg(F.count("*").alias("moved")), "series")
    return part.join(n.where(F.col("moved") < F.col("total") * most).select("series"), "series", "left_semi")


def split_by_touch(v: DataFrame, hits: DataFrame, steps: int = 5, joined: float = 0.85, most: float = 0.95) -> DataFrame:
    """(series, x, y, z) of the part that comes loose at the hit voxel (hx, hy, hz) when its structure is eroded step by step.

    Both parts then regrow to all of the structure.  No rows where nothing comes loose in ``steps`` or nearly all would move.
    A task holds one structure of one exam.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, shape = _box(pdf)
        mask, flat = np.zeros(shape, bool), np.arange(int(np.prod(shape))).reshape(shape)
        mask[at] = True
        base = pdf[["z", "y", "x"]].min().to_numpy()
        hit = pdf[["hz", "hy", "hx"]].iloc[0].to_numpy() - base
        left, keep = mask, np.zeros(len(pdf), bool)
        for step in range(1, steps + 1):
            wide = np.pad(left, 1)
            left = left & wide[2:, 1:-1, 1:-1] & wide[:-2, 1:-1, 1:-1] & wide[1:-1, 2:, 1:-1] & wide[1:-1, :-2, 1:-1] & wide[1:-1, 1:-1, 2:] & wide[1:-1, 1:-1, :-2]
            where = np.argwhere(left)
            off = np.abs(where - hit)
            near = off.max(1, initial=0) <= step + 3
            if not near.any():
                break
            where, off = where[near], off[near]
            lab = label6(left)
            part = lab == lab[tuple(where[np.argmin((off * off).sum(1))])]
            if part.sum() >= joined * left.sum():
                continue
            got = _compete(mask, np.where(left, flat, flat.size), None)
            mine = np.append(part.ravel(), False)[got][at]
            if mine.sum() <= most * len(pdf):
                keep = mine
            break
        return pdf.loc[keep, PLACE]

    hit = v.join(hits, "series").where("x = hx and y = hy and z = hz and label > 0").select("series", "hx", "hy", "hz", F.col("label").alias("hit"))
    own = v.join(hit, "series").where("label = hit").select(*PLACE, "hx", "hy", "hz")
    return own.groupBy("series").applyInPandas(run, "series int, x int, y int, z int")


def teeth_bounds(v: DataFrame, threshold: float, calibrated: bool = True, clamp: tuple[float, float] = (2300.0, 3000.0)) -> DataFrame:
    """(series, seed, low): from where enamel seeds, near the top of the bone's range, and how far down dentine reaches."""
    bone = v.where((F.col("hu") >= threshold) & (F.col("label") != 4))
    seed = F.least(F.greatest(F.lit(clamp[0]), F.col("p")), F.lit(clamp[1])) if calibrated else F.col("p").cast("double")
    cut = percentile(bone, 99.9).select("series", seed.alias("seed"))
    return cut.withColumn("low", threshold + DENTINE * (F.col("seed") - threshold))


def teeth(v: DataFrame, threshold: float, calibrated: bool = True, steps: int = 14, least: int = 15, clamp: tuple[float, float] = (2300.0, 3000.0)) -> DataFrame:
    """(series, x, y, z) of enamel grown into dentine: seeds near the top of the bone's range, then ``steps`` over faces; groups
    under ``least`` voxels go.  ``v`` is dense; metal (column ``label`` 4) takes no part."""
    cut = teeth_bounds(v, threshold, calibrated, clamp)
    m = v.join(cut, "series").select(*PLACE, *(((F.col("hu") >= F.col(c)) & (F.col("label") != 4)).cast("int").alias(n) for c, n in (("seed", "on"), ("low", "may"))))
    comp = settle(label_voxels(grow(m, steps).where("on = 1")))
    big = comp.groupBy("series", "component").count().where(F.col("count") >= least)
    return comp.join(big, ["series", "component"], "left_semi").select(*PLACE)


def lower_jaw(v: DataFrame, tries: int = 3, bounds: dict | None = None, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(series, x, y, z, owner): bone (label 1) as 2 where it belongs to the lower jaw, else 1; ``v`` is dense.

    Bone is eroded once to ``tries`` times; the first erosion that has a component within ``bounds`` (wide, low, in front, of
    a jaw's size, below the teeth, and not the largest) gives the jaw, and all bone regrows from the components.
    """
    b = JAW | (bounds or {})
    bone = v.where("label = 1").select(*PLACE)
    key = W.partitionBy("series", "try")
    edge = bone.groupBy("series").agg(*(f(c).alias(f"{n}{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))))
    bite = v.where("label = 3").groupBy("series").agg(F.avg("z").alias("bite"))
    m, levels = v.select(*PLACE, (F.col("label") == 1).cast("int").alias("m")), []
    for k in range(1, tries + 1):
        m = settle(erode6(m))
        levels.append(label_voxels(m.where("m = 1")).withColumn("try", F.lit(k)))
    comp = levels[0]
    for other in levels[1:]:
        comp = comp.unionByName(other)
    comp = settle(comp)
    s = comp.groupBy("series", "try", "component").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.avg("z").alias("z"), F.avg("y").alias("y"))
    s = s.withColumns({"total": F.sum("n").over(key), "rank": F.row_number().over(key.orderBy(F.desc("n"), "component"))})
    s = s.join(edge, "series").join(bite, "series", "left")
    wide, tall, deep = (F.greatest(F.lit(1), F.col(f"hi{c}") - F.col(f"lo{c}")) for c in ("x", "z", "y"))
    mm3 = F.col("n") * float(np.prod(spacing))
    fits = (F.col("rank") > 1) & (F.col("n") >= F.col("total") * 0.01) & ((F.col("x1") - F.col("x0")) / wide > b["span"]) & ((F.col("z") - F.col("loz")) / tall < b["height"]) & ((F.col("z0") - F.col("loz")) / tall < b["lowest"])
    fits = fits & ((F.col("y") - F.col("loy")) / deep < b["back"]) & (mm3 > b["least"]) & (mm3 < b["most"]) & ((F.col("z1") - F.col("z0")) * spacing[2] > b["tall"]) & (F.col("bite").isNull() | (F.col("z") < F.col("bite")))
    jaw = s.where(fits).groupBy("series").agg(F.min_by(F.struct("try", "component"), F.struct("try", -F.col("n"), "component")).alias("j")).select("series", "j.try", F.col("j.component").alias("jaw"))
    seeds = comp.join(jaw, ["series", "try"]).select(*PLACE, F.when(F.col("component") == F.col("jaw"), 2).otherwise(1).alias("owner"))
    start = bone.join(seeds, PLACE, "left").select(*PLACE, F.coalesce("owner", F.lit(0)).alias("owner"))
    return regrow(start).select(*PLACE, F.greatest("owner", F.lit(1)).alias("owner"))


def label_field(v: DataFrame, label: int, field: str = "field") -> DataFrame:
    """``field`` with its zero at the border of one label: at least 0.01 inside, below -0.01 outside."""
    return v.withColumn(field, F.when(F.col("label") == label, F.greatest(F.lit(0.01), F.col(field))).otherwise(-0.01 - F.abs(F.col(field)) * 0.05))


def suppress_artefacts(v: DataFrame, threshold: float, reach: int = 4, soft: float = 250.0, field: str | None = None) -> DataFrame:
    """(series, x, y, z, field): hu over ``threshold``, or the column ``field``, not bone (-0.05 at most) next to metal (label 4), nor within
    ``reach`` of it where it is barely bone.  Distances are steps over faces; ``v`` is dense."""
    own = F.col(field) if field else F.col("hu") - float(threshold)
    m = v.select(*PLACE, "hu", own.alias("field"), (F.col("label") == 4).cast("int").alias("d0"), F.lit(1).alias("may"))
    m = grow(m.withColumn("d1", F.col("d0")), 1, on="d1")
    m = grow(m.withColumn("dn", F.col("d1")), reach - 1, on="dn")
    hide = (F.col("d1") == 1) | (F.col("dn") == 1) & (F.col("hu") < threshold + soft) & (F.col("field") > 0)
    return m.select(*PLACE, F.when(hide, F.least(F.col("field"), F.lit(-0.05))).otherwise(F.col("field")).alias("field"))


def enamel_near(objects: DataFrame, v: DataFrame, seed: float, reach: int = 2, enamel: float = 2300.0) -> DataFrame:
    """Objects' voxels (series, object, x, y, z) counted within ``reach`` voxels of enamel: (series, object, near, voxels)."""
    low = min(enamel, 0.8 * seed)
    m = v.select(*PLACE, ((F.col("hu") >= low) & (F.col("hu") < seed)).cast("int").alias("m"))
    for a in AXES:
        m = m.withColumn("m", F.max("m").over(line(a, AXES, "series").rowsBetween(-reach, reach)))
    return objects.join(m, PLACE).groupBy("series", "object").agg(F.sum("m").alias("near"), F.count("*").alias("voxels"))
