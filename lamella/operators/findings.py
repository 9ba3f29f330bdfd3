"""Measures and a written reading of labelled voxel rows (series, x, y, z, hu, label) of 1 mm voxels.

Labels: 1 skull, 2 lower jaw, 3 teeth; x grows to the patient's left, y to the back, z upward.  The text is educational, not diagnostic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import half_up
from ..functions.shared import settle
from .reduce import percentile
from .segment import airways
from .stencil import erode6
from .structures import PLACE, label_voxels

#: fixed values: mm from the midline that still count as midline
MIDLINE = 6.0


def references(v: DataFrame, least_teeth: int = 50, every: int = 1) -> DataFrame:
    """(series, voxels, mid_x, width, bite_z, front_y, back_y, z_lo, z_hi) of bone and teeth.

    The midline is halfway between the 2nd and the 98th percentile of x; ``bite_z`` is the median height of the teeth, null where there are
    no more than ``least_teeth`` voxels of them.  With ``every`` above 1 only every such voxel of the teeth counts, by flat index, and ``v`` is dense.
    """
    bone = v.where("label in (1, 2, 3)")
    lo, hi = (percentile(bone, p, "x").withColumnRenamed("p", n) for p, n in ((2, "lo"), (98, "hi")))
    tooth = bone.where("label = 3")
    if every > 1:
        dims = v.groupBy("series").agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"))
        tooth = tooth.join(dims, "series").where(((F.col("z") * F.col("ny") + F.col("y")) * F.col("nx") + F.col("x")) % every == 0)
    enough = tooth.groupBy("series").agg(F.count("*").alias("n")).where(F.col("n") > least_teeth).select("series")
    bite = percentile(tooth, 50, "z").withColumnRenamed("p", "bite_z").join(enough, "series")
    e = bone.groupBy("series").agg(F.count("*").alias("voxels"), F.min("y").alias("front_y"), F.max("y").alias("back_y"), F.min("z").alias("z_lo"), F.max("z").alias("z_hi"))
    r = e.join(lo, "series").join(hi, "series").join(bite, "series", "left")
    return r.select("series", "voxels", ((F.col("lo") + F.col("hi")) / 2).alias("mid_x"), (F.col("hi") - F.col("lo")).alias("width"), "bite_z", "front_y", "back_y", "z_lo", "z_hi")


def whole(c: Column) -> Column:
    """A number rounded half up, as text."""
    return half_up(F.round(c, 6)).cast("long").cast("string")


def position(midline: float = MIDLINE) -> Column:
    """Where (cx, cy, cz) lies, in words, from the columns of ``references``."""
    dx, up = F.col("cx") - F.col("mid_x"), F.col("cz") - F.coalesce("bite_z", "z_lo")
    side = F.when(F.abs(dx) < midline, "midline").otherwise(F.concat(F.when(dx > 0, "left side (").otherwise("right side ("), whole(F.abs(dx)), F.lit(" mm from the midline)")))
    level = F.when(F.col("bite_z").isNull(), " mm above the lowest bone, ").when(up >= 0, " mm above the bite, ").otherwise(" mm below the bite, ")
    return F.concat(side, F.lit(", "), whole(F.abs(up)), level, whole(F.col("cy") - F.col("front_y")), F.lit(" mm behind the front"))


def _centres(comp: DataFrame, refs: DataFrame, midline: float, *more: Column) -> DataFrame:
    c = comp.groupBy("series", "component").agg(F.count("*").alias("voxels"), *(F.round(F.avg(a), 6).alias(f"c{a}") for a in "xyz"), *more)
    return c.join(refs.drop("voxels"), "series").withColumn("position", position(midline))


def isolated_parts(v: DataFrame, refs: DataFrame, least: int = 150, jaw: int = 10000, midline: float = MIDLINE) -> DataFrame:
    """(series, component, voxels, cx, cy, cz, position) of bone pieces apart from the largest, a loose lower jaw excepted."""
    bone = v.where("label in (1, 2, 3)")
    comp = label_voxels(bone).join(bone.select(*PLACE, "label"), PLACE)
    c = _centres(comp, refs, midline, F.count_if(F.col("label") == 2).alias("jaw")).where(F.col("voxels") >= least)
    c = c.withColumn("rank", F.row_number().over(W.partitionBy("series").orderBy(F.desc("voxels"), "component")))
    own = (F.col("jaw") > F.col("voxels") / 2) & (F.col("voxels") > jaw)
    return c.where((F.col("rank") > 1) & ~own).select("series", "component", "voxels", "cx", "cy", "cz", "position")


def low_density(v: DataFrame, refs: DataFrame, least: int = 80, steps: int = 2, air: float = -300.0, midline: float = MIDLINE) -> DataFrame:
    """(series, component, voxels, mean_hu, size_x, size_y, size_z, position) of places that the lower jaw closes in within each slice.

    Neither teeth, metal nor air; a place counts where some of it outlasts ``steps`` erosions, which a canal does not.
    """
    closed = airways(v.select(*PLACE, F.when(F.col("label") == 2, 1).otherwise(-1).alias("hu")), 0)
    holes = v.join(closed, PLACE, "left_semi").where((~F.coalesce("label", F.lit(0)).isin(2, 3, 4)) & (F.col("hu") > air)).select(*PLACE, "hu", F.lit(1).alias("m"))
    comp = label_voxels(holes).join(holes, PLACE)
    core = v.select(*PLACE).join(holes.drop("hu"), PLACE, "left").select(*PLACE, F.coalesce("m", F.lit(0)).alias("core"))
    for _ in range(steps):
        core = erode6(core, "core")
    comp = comp.join(core, PLACE)
    sizes = [(F.max(a) - F.min(a) + 1).alias(f"size_{a}") for a in "xyz"]
    c = _centres(comp, refs, midline, F.round(F.avg("hu"), 6).alias("mean_hu"), *sizes, F.max("core").alias("core"))
    return c.where((F.col("voxels") >= least) & (F.col("core") == 1)).select("series", "component", "voxels", "mean_hu", "size_x", "size_y", "size_z", "position")


def jaw_summary(v: DataFrame, refs: DataFrame, lateral: float = 25.0, aligned: bool | Column = True) -> DataFrame:
    """(series, voxels, mean_hu, left, right, difference, overlap, left_height, right_height) of label 2.

    ``difference`` of the sides is in percent of their mean; ``overlap`` is the share whose mirror place is label 2 too, null where
    the axes are not those of the patient (``aligned``: a flag, or a column over ``refs``, see ``views.aligned``); heights are of what lies
    more than ``lateral`` from the midline, null where nothing does.
    """
    m = v.where("label = 2").select(*PLACE, "hu").join(refs.select("series", "mid_x"), "series")
    m = m.withColumns({"dx": F.col("x") - F.col("mid_x"), "other": half_up(2 * half_up(F.col("mid_x")) - F.col("x")).cast("int")})
    hit = m.select("series", F.col("x").alias("other"), "y", "z", F.lit(1).alias("hit"))
    j = m.join(hit, ["series", "other", "y", "z"], "left")
    left = F.col("dx") > 0

    def tall(on):
        return F.max(F.when(on, F.col("z"))) - F.min(F.when(on, F.col("z")))

    g = j.groupBy("series").agg(
        F.count("*").alias("voxels"), F.round(F.avg("hu"), 6).alias("mean_hu"), F.count_if(left).alias("left"), F.count_if(~left).alias("right"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("overlap"),
        tall(F.col("dx") > lateral).alias("left_height"), tall(F.col("dx") < -lateral).alias("right_height"),
    )
    part = F.abs(F.col("left") - F.col("right")) * 200 / F.greatest(F.lit(1), F.col("voxels"))
    return _if_aligned(g.withColumn("difference", F.round(part, 6)), refs, aligned, "overlap")


def _if_aligned(d: DataFrame, refs: DataFrame, aligned: bool | Column, name: str) -> DataFrame:
    """``d`` with ``name`` null for series whose axes are not aligned."""
    flag = aligned if isinstance(aligned, Column) else F.lit(aligned)
    return d.join(refs.select("series", flag.alias("__aligned")), "series").withColumn(name, F.when(F.col("__aligned"), F.col(name))).drop("__aligned")


def symmetry(v: DataFrame, refs: DataFrame, least: float = 2000.0, aligned: bool | Column = True) -> DataFrame:
    """(series, part, voxels, left, right, overlap): bone by thirds of its height (0: lowest), its sides of the midline, and the share
    whose mirror place at the midline is bone too.  Thirds of fewer than ``least`` voxels, and series that are not ``aligned``, are left out.
    """
    third = F.least(F.lit(2), F.floor((F.col("z") - F.col("z_lo")) * 3 / F.greatest(F.lit(1), F.col("z_hi") - F.col("z_lo")))).cast("int")
    b = v.where("label in (1, 2, 3)").select(*PLACE).join(refs.select("series", "mid_x", "z_lo", "z_hi"), "series")
    b = b.withColumns({"part": third, "other": half_up(2 * half_up(F.col("mid_x")) - F.col("x")).cast("int")})
    hit = b.select("series", F.col("x").alias("other"), "y", "z", F.lit(1).alias("hit"))
    left = F.col("x") > F.col("mid_x")
    g = b.join(hit, ["series", "other", "y", "z"], "left").groupBy("series", "part").agg(F.count("*").alias("voxels"), F.count_if(left).alias("left"), F.count_if(~left).alias("right"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("overlap"))
    return _if_aligned(g.where(F.col("voxels") >= least), refs, aligned, "overlap").where("overlap is not null").select("series", "part", "voxels", "left", "right", "overlap")


def tooth_blocks(v: DataFrame, refs: DataFrame, least: int = 15) -> DataFrame:
    """(series, upper, lower, left, right, blocks_upper, blocks_lower): voxels of teeth by side of the bite and midline, and their pieces.

    Without a ``bite_z`` all count as lower.
    """
    comp = label_voxels(v.where("label = 3"))
    b = comp.groupBy("series", "component").agg(F.count("*").alias("n"), F.avg("z").alias("cz")).where(F.col("n") >= least).join(refs, "series")
    above = F.coalesce(F.col("cz") >= F.col("bite_z"), F.lit(False))
    b = b.groupBy("series").agg(F.count_if(above).alias("blocks_upper"), F.count_if(~above).alias("blocks_lower"))
    over = F.coalesce(F.col("z") >= F.col("bite_z"), F.lit(False))
    t = comp.join(refs, "series").groupBy("series").agg(F.count_if(over).alias("upper"), F.count_if(~over).alias("lower"), F.count_if(F.col("x") > F.col("mid_x")).alias("left"), F.count_if(F.col("x") <= F.col("mid_x")).alias("right"))
    return t.join(b, "series", "left").select("series", "upper", "lower", "left", "right", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blocks_upper", "blocks_lower")))


def jaw_parts(v: DataFrame, refs: DataFrame, least: int = 400, top: int = 5, midline: float = MIDLINE) -> DataFrame:
    """(series, parts, n, voxels, position): how many pieces the lower jaw has, and the ``top`` largest."""
    c = _centres(label_voxels(v.where("label = 2")), refs, midline).where(F.col("voxels") >= least)
    w = W.partitionBy("series")
    c = c.withColumns({"parts": F.count("*").over(w), "n": F.row_number().over(w.orderBy(F.desc("voxels"), "component"))})
    return c.where(F.col("n") <= top).select("series", "parts", "n", "voxels", "position")


#: fixed values: sections of the reading in order
SECTIONS = ("coverage", "jaw", "jaw_parts", "low_density", "symmetry", "parts", "teeth", "metal", "air", "sinuses", "vessels")


def reading(v: DataFrame, metal: DataFrame | None = None, air: DataFrame | None = None, vessels: DataFrame | None = None, least_part: int = 150, top: int = 8, least_jaw: int = 5000, midline: float = MIDLINE, aligned: bool | Column = True, least_hole: int = 80, hole_steps: int = 2, air_hu: float = -300.0, least_third: float = 2000.0, least_jaw_part: int = 400, every: int = 4) -> DataFrame:
    """(series, section, n, line): the reading of an exam, line by line, in the order of ``SECTIONS``.

    ``metal``: objects of ``segment.metal_objects``; ``air`` and ``vessels``: regions of ``segment.regions``; a section whose table is not given
    is left out, and so is symmetry where the axes are not ``aligned``.  Jaw parts and places of low density are told where the lower jaw
    is separated.  The bite is that of every ``every``-th voxel of the teeth, see ``references``.
    """
    from .report import air_list, metal_near, sinus_pair, vessel_list

    v = settle(v.select(*PLACE, "hu", "label"))
    refs = settle(references(v, every=every).withColumn("aligned", aligned if isinstance(aligned, Column) else F.lit(aligned)))
    flag = F.col("aligned")

    def lines(d: DataFrame, section: str, n, line) -> DataFrame:
        return d.select("series", F.lit(section).alias("section"), (F.lit(n) if isinstance(n, int) else n).cast("int").alias("n"), line.alias("line"))

    text = lambda c: F.col(c).cast("string")
    out = [lines(refs, "coverage", 1, F.concat(whole(F.col("z_hi") - F.col("z_lo")), F.lit(" mm high, "), whole(F.col("width")), F.lit(" mm wide, "), whole(F.col("back_y") - F.col("front_y")), F.lit(" mm deep; bone "), text("voxels"), F.lit(" mm3")))]
    j = settle(refs.select("series").join(jaw_summary(v, refs, aligned=flag), "series", "left"))
    mirrored = F.coalesce(F.concat(F.lit("; mirror overlap "), whole(F.col("overlap") * 100), F.lit(" %")), F.lit(""))
    told = F.concat(text("voxels"), F.lit(" mm3; right "), text("right"), F.lit(", left "), text("left"), F.lit(" (difference "), whole(F.col("difference")), F.lit(" %)"), mirrored)
    out.append(lines(j, "jaw", 1, F.when(F.coalesce("voxels", F.lit(0)) >= least_jaw, told).otherwise("not separated")))
    apart = j.where(F.col("voxels") >= least_jaw).select("series")

    c = jaw_parts(v, refs, least_jaw_part, midline=midline).join(apart, "series", "left_semi")
    several = lines(c.where("parts > 1"), "jaw_parts", F.col("n"), F.concat(text("voxels"), F.lit(" mm3: "), "position"))
    whole_jaw = lines(apart.join(c.where("parts > 1"), "series", "left_anti"), "jaw_parts", 1, F.lit("continuous"))
    h = low_density(v, refs, least_hole, hole_steps, air_hu, midline).join(apart, "series", "left_semi")
    h = h.withColumn("n", F.row_number().over(W.partitionBy("series").orderBy(F.desc("voxels"), "component"))).where("n <= 6")
    sides = F.concat_ws(" x ", *(text(f"size_{a}") for a in "xyz"))
    holes = lines(h, "low_density", F.col("n"), F.concat(text("voxels"), F.lit(" mm3, "), sides, F.lit(" mm, mean "), whole(F.col("mean_hu")), F.lit(": "), "position"))
    third = F.element_at(F.array(F.lit("lower third"), F.lit("middle third"), F.lit("upper third")), F.col("part") + 1)
    y = symmetry(v, refs, least_third, flag)
    mirror = lines(y, "symmetry", F.col("part") + 1, F.concat(third, F.lit(": overlap "), whole(F.col("overlap") * 100), F.lit(" %; right "), text("right"), F.lit(" mm3, left "), text("left"), F.lit(" mm3")))
    p = isolated_parts(v, refs, least_part, midline=midline)
    p = p.withColumn("n", F.row_number().over(W.partitionBy("series").orderBy(F.desc("voxels"), "component"))).where(F.col("n") <= top)
    parts = lines(p, "parts", F.col("n"), F.concat(text("voxels"), F.lit(" mm3: "), "position"))
    t = tooth_blocks(v, refs)
    tooth = lines(t, "teeth", 1, F.concat(F.lit("upper "), text("upper"), F.lit(" mm3, lower "), text("lower"), F.lit(" mm3")))
    out += [several, whole_jaw, holes, mirror, parts, tooth]
    where = refs.select("series", "mid_x", "bite_z", "front_y", "z_lo")
    if metal is not None:
        out.append(lines(metal_near(metal, v, where, midline=midline), "metal", F.col("n"), F.col("line")))
    if air is not None:
        a = settle(air.join(where, "series"))
        out.append(lines(air_list(a, midline=midline), "air", F.col("n"), F.col("line")))
        out.append(lines(sinus_pair(a), "sinuses", 1, F.col("line")))
    if vessels is not None:
        out.append(lines(vessel_list(vessels.join(where, "series"), midline=midline), "vessels", 1, F.col("line")))
    every = out[0]
    for d in out[1:]:
        every = every.unionByName(d)
    return every
