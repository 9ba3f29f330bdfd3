"""What a user calls: files to series, series to volumes, volumes to surfaces, labels, layers and a reading.

Each verb is a composition of operators, DataFrames in and DataFrames out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import to_int16
from .functions.shared import settle
from .operators import assemble, components, findings, fusion, reconstruct, reduce, report, resample, rules, segment, structures, surface
from .sources import dicom

PLACE = structures.PLACE
#: fixed values: smoothing steps of the metal's surface
METAL_STEPS = 4


def parse(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(slices, summaries, best, skipped) of the images below ``path``: the last with the reason why a file is not read.

    The spacing of a series of one file is the one that it tells.
    """
    every = dicom.read_slices(spark, path)
    slices, files = dicom.headers(every), dicom.file_headers(every)
    told = files.groupBy("series").agg(F.min_by("step", "at").alias("step"), F.min_by("thickness", "at").alias("thickness"))
    summary = assemble.summarize(files).join(assemble.assemble(slices).select("series", F.col("spacing").alias("gap")), "series").join(told, "series")
    summary = summary.withColumn("spacing", F.when(F.col("images") > 1, F.col("gap")).otherwise(F.col("step"))).drop("gap", "step")
    heads = assemble.firsts(slices).select("series", F.col("frows_").alias("rows_"))
    best = rules.best_series(summary.join(heads, "series").select(F.lit(0).alias("study"), F.col("series").alias("id"), "frames", "rows_", "spacing", "thickness"))
    return slices, summary, best, dicom.skipped(every)


def build(slices: DataFrame) -> DataFrame:
    """(series, x, y, z, hu) of each series: slices of the first one's size, one a place, on a uniform grid."""
    k = assemble.keyed(slices)
    one = k.groupBy("series", "z").agg(F.min_by(F.struct("hu", "cols"), "at").alias("s")).select("series", "z", "s.*")
    d = resample.brackets(k.select("series", "z"))
    d = d.join(one.select("series", F.col("z").alias("a"), F.col("hu").alias("ha"), "cols"), ["series", "a"]).join(one.select("series", F.col("z").alias("b"), F.col("hu").alias("hb")), ["series", "b"])
    d = d.select("series", F.col("k").alias("z"), "cols", F.posexplode(F.zip_with("ha", "hb", lambda a, b: a + (b - a) * F.col("t"))).alias("i", "v"))
    return d.select("series", (F.col("i") % F.col("cols")).alias("x"), F.floor(F.col("i") / F.col("cols")).cast("int").alias("y"), "z", to_int16(F.col("v")).cast("long").alias("hu"))


def build_study(slices: DataFrame, used: DataFrame, budget: float = 16e6) -> tuple[DataFrame, DataFrame]:
    """(volume, grids): the series ``used`` (study, series, place; 1 is the main one) of each study fused into one volume (series: the study,
    x, y, z, hu), and its grid (study, s: mm, sizes gx, gy, gz, and the origin ``at``)."""
    v = settle(build(slices.join(used.select("series"), "series", "left_semi")))
    dims = v.groupBy("series").agg(*((F.max(c) + 1).cast("int").alias(f"n{c}") for c in "xyz"))
    geo = settle(assemble.geometry(slices).join(dims, "series").join(used, "series"))
    volume, grids = fusion.fuse_study(geo, v, budget)
    return volume.select(F.col("study").alias("series"), "x", "y", "z", F.col("value").cast("long").alias("hu")), grids


class Recon(NamedTuple):
    """What ``recon`` gives.  Layer 0 of the mesh is bone, 4 metal."""

    field: DataFrame  # series, x, y, z, hu, field, metal_field (null where a series has no metal)
    spacing: tuple[float, float, float]
    metal: DataFrame  # series, x, y, z, object
    objects: DataFrame
    triangles: DataFrame
    vertices: DataFrame
    notes: DataFrame  # series, note


def recon(v: DataFrame, threshold: float, target: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), budget: float | None = None, calibrated: bool = True, small_parts: bool = True, steps: int = surface.STEPS, least: float = 150.0, **options) -> Recon:
    """Bone and metal of each volume: the field (see ``operators.reconstruct``), metal pieces, surfaces and notes.

    With a ``budget`` of voxels volumes are shrunk in the plane as the largest one needs.  Bone does not cover metal, and what seems bone next to it is
    taken out.
    """
    factor = 1
    if budget:
        top = v.agg(*((F.max(c) + 1).alias(c) for c in "xyz")).first()
        factor = reconstruct.shrink_factor((top["x"], top["y"], top["z"]), spacing, target, budget) if top["x"] else 1
    d = reconstruct.reconstruct(v, threshold, target, spacing, factor=factor, small_parts=small_parts, least=least, **options)
    d = settle(d.withColumn("z", F.col("z").cast("int")))
    mm = (spacing[0] * factor, spacing[1] * factor, target if target < 0.95 * spacing[2] else spacing[2])
    cut = settle(reduce.metal_thresholds(d, "hu", "series", calibrated))
    voxels, objects = segment.metal_parts(d.join(cut, "series"), F.col("seed"), F.col("low"), mm)
    voxels = settle(voxels)
    box = d.groupBy("series").agg(*(((F.max(c) + 1) * s).alias(f"n{c}") for c, s in zip("xyz", mm, strict=True)))
    objects = settle(segment.describe(objects, box, structures.enamel_near(voxels, d, reduce.METAL_SEED)))
    d = d.join(voxels.select(*PLACE, F.lit(4).alias("label")), PLACE, "left").withColumn("label", F.coalesce("label", F.lit(0)))
    near = structures.suppress_artefacts(d, threshold, max(1, int(4 / min(mm) + 0.5)), field="field").withColumnRenamed("field", "clear")
    d = settle(d.join(near, PLACE))
    lost = d.where("field > 0 and clear <= 0 and label <> 4").groupBy("series").agg(F.count("*").alias("lost"))
    d = d.withColumn("field", F.col("clear")).drop("clear")
    if small_parts:
        d = components.clean_field(d, least=least / (mm[0] * mm[1] * mm[2])).drop("dropped")
    has = objects.select("series").distinct().withColumn("has", F.lit(True))
    d = d.join(cut, "series").join(has, "series", "left").withColumn("low", F.when(F.col("has"), F.col("low")))
    metal_field = F.when(F.col("low").isNull(), None).when(F.col("label") == 4, F.greatest(F.lit(0.05), F.col("hu") - F.col("low") + 1)).otherwise(F.least(F.lit(-0.05), F.col("hu") - F.col("low")))
    d = settle(d.select(*PLACE, "hu", "field", metal_field.alias("metal_field")))
    bone = settle(surface.cut(d))
    gold = settle(surface.cut(d.where("metal_field is not null"), "metal_field").withColumn("layer", F.lit(4)))
    vert = surface.vertices(bone, steps).unionByName(surface.vertices(gold, METAL_STEPS))
    counts = report.metal_counts(objects)
    told = F.concat(F.lit("metal: "), F.col("pieces").cast("string"), F.lit(" piece(s): "), F.concat_ws(", ", *(F.concat(F.col(k).cast("string"), F.lit(f" {k}(s)")) for k in report.KINDS)))
    notes = counts.select("series", told.alias("note")).unionByName(lost.join(has, "series").select("series", F.lit("artefacts near metal reduced: only dense bone counts there").alias("note")))
    if factor > 1:
        notes = notes.unionByName(d.select("series").distinct().select("series", F.lit(f"shrunk in the plane by {factor} to stay within the budget").alias("note")))
    tri = bone.unionByName(gold).select("series", "layer", "a", "b", "c")
    return Recon(d, mm, voxels, objects, tri, surface.to_patient(vert, mm), notes)


def _masks(v: DataFrame, contrast: bool, voxel: float) -> tuple[DataFrame, DataFrame | None]:
    """Inner air and, with contrast, vessels, with the number of their region; small regions are cleared."""
    air = settle(segment.keep_regions(segment.airways(v), segment.LEAST_AIR / voxel))
    return air, settle(segment.keep_regions(segment.vessels(v), segment.LEAST_VESSEL / voxel)) if contrast else None


def label(v: DataFrame, threshold: float, contrast: bool = False, calibrated: bool = True, jaw: dict | None = None, metal: DataFrame | None = None, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), **tooth) -> DataFrame:
    """``v`` with labels: skull 1, lower jaw 2, teeth 3, metal 4 (of ``metal``, its voxels), inner air 5, and with contrast vessels 6."""
    v = settle(v.drop("label").join(metal.select(*PLACE, F.lit(4).alias("label")), PLACE, "left") if metal is not None else v.drop("label").withColumn("label", F.lit(None).cast("int")))
    v = v.withColumn("label", F.coalesce("label", F.lit(0)))
    teeth = settle(structures.teeth(v, threshold, calibrated, **tooth)).select(*PLACE, F.lit(3).alias("t"))
    own = F.when(F.col("label") == 4, 4).otherwise(F.coalesce("t", F.when(F.col("hu") >= threshold, 1).otherwise(0)))
    d = settle(v.join(teeth, PLACE, "left").withColumn("label", own).drop("t"))
    owner = settle(structures.lower_jaw(d, bounds=jaw, spacing=spacing)).select(*PLACE, "owner")
    d = d.join(owner, PLACE, "left").withColumn("label", F.when(F.col("label") == 1, F.coalesce("owner", F.lit(1))).otherwise(F.col("label"))).drop("owner")
    return settle(segment.merge_labels(d, *_masks(v, contrast, spacing[0] * spacing[1] * spacing[2])))


#: fixed values: label, name and the base of its surface
LAYERS = ((1, "skull and face", "bone"), (2, "lower jaw", "bone"), (3, "teeth", "teeth"), (4, "metal", "metal"), (5, "inner air", "air"), (6, "vessels", "vessel"))


def layers(labelled: DataFrame, threshold: float, calibrated: bool = True, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), air: float = -400.0, vessel: float = 150.0, clamp: tuple[float, float] = (2300.0, 3000.0), **geometry) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, triangles, vertices) of a labelled volume (series, x, y, z, hu, label, field, and metal_field where there is metal).

    ``table``: series, layer, name, base, volume in mm3.  Each label's surface is taken from the field of its base: bone's, metal's, and
    for teeth, air and vessels hu from where these begin.
    """
    low = structures.teeth_bounds(labelled, threshold, calibrated, clamp).select("series", F.col("low").alias("teeth_low"))
    d = labelled.join(low, "series", "left")
    metal = F.coalesce("metal_field", "field") if "metal_field" in labelled.columns else F.col("field")
    d = d.withColumns({"metal_base": metal, "teeth_base": F.coalesce(F.col("hu") - F.col("teeth_low") + 1, F.col("field")), "air_base": air - F.col("hu"), "vessel_base": F.col("hu") - vessel})
    tri, vert = surface.layer_meshes(d, "field", {3: "teeth_base", 4: "metal_base", 5: "air_base", 6: "vessel_base"}, spacing=spacing, **geometry)
    table = labelled.where("label > 0").groupBy("series", F.col("label").alias("layer")).agg((F.count("*") * float(spacing[0] * spacing[1] * spacing[2])).alias("volume"))
    name, base = (F.element_at(F.map_from_arrays(F.array(*(F.lit(r[0]) for r in LAYERS)), F.array(*(F.lit(r[k]) for r in LAYERS))), F.col("layer")) for k in (1, 2))
    return table.select("series", "layer", name.alias("name"), base.alias("base"), "volume"), tri, vert


def analyze(labelled: DataFrame, objects: DataFrame | None = None, contrast: bool = False, **limits) -> DataFrame:
    """(series, section, n, line): the reading of labelled volumes of 1 mm voxels, with all sections; see ``findings.reading``."""
    labelled = settle(labelled)
    dims = labelled.groupBy("series").agg(*((F.max(c) + 1).alias(f"n{c}") for c in "xyz"))
    air = segment.regions(labelled.where("label = 5"), dims, segment.LEAST_AIR)
    blood = segment.regions(labelled.where("label = 6"), dims, segment.LEAST_VESSEL) if contrast else None
    return findings.reading(labelled, objects, air, blood, **limits)


def split(labelled: DataFrame, hits: DataFrame, new: int, plane: bool = False, **options) -> DataFrame:
    """``labelled`` with the part that comes loose at the voxels hit, or that a plane cuts off there, as label ``new``."""
    part = (structures.split_by_plane if plane else structures.split_by_touch)(labelled, hits, **options)
    moved = part.select(*PLACE, F.lit(True).alias("moved"))
    return labelled.join(moved, PLACE, "left").withColumn("label", F.when(F.col("moved"), new).otherwise(F.col("label"))).drop("moved")
