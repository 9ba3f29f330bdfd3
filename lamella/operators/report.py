"""Study data, summaries and lists of findings as text columns; numbers stay as columns beside the text.  Educational, not diagnostic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import fmt, half_up
from .findings import MIDLINE, position

#: fixed values: order of the kinds of metal in lists
KINDS = ("screw", "plate", "fragment", "restoration")
#: fixed values: mm from the midline and behind the front by which air spaces are guessed
LATERAL, MASTOID, NASAL, PHARYNX, SINUS, SINUS_DEPTH, MIXED = 30, 80, 12, 55, 45, 75, 18


def study_info(name: Column, number: Column, date: Column) -> dict[str, Column]:
    """Patient with carets as spaces, number, and the date (yyyyMMdd) as day, month and year."""
    return {"patient": F.trim(F.replace(F.coalesce(name, F.lit("")), F.lit("^"), F.lit(" "))), "patient_id": F.coalesce(number, F.lit("")), "study_date": F.coalesce(F.date_format(F.try_to_timestamp(date, F.lit("yyyyMMdd")), "dd/MM/yyyy"), F.lit(""))}


def masked(value: Column, hidden: Column) -> Column:
    return F.when(hidden, "•••").otherwise(F.coalesce(F.nullif(value, F.lit("")), F.lit("—")))


def technical_summary(modality: Column, device: Column, facts: Column, level: Column, warnings: Column, threshold: Column) -> Column:
    """array<string>: the lines of a technical summary; ``facts`` and ``warnings`` are arrays of lines."""
    head = F.array(F.concat(F.lit("Modality: "), F.coalesce(F.nullif(modality, F.lit("")), F.lit("CT"))), F.concat(F.lit("Device: "), F.coalesce(F.nullif(device, F.lit("")), F.lit("not stated"))))
    tail = F.array(F.concat(F.lit("Threshold: "), threshold.cast("string"), F.lit(" HU")))
    return F.concat(head, facts, F.array(F.concat(F.lit("Quality: "), level)), F.transform(warnings, lambda w: F.concat(F.lit("Warning: "), w)), tail)


def images_text(images: DataFrame) -> DataFrame:
    """(study, images): the labels of a study's images, numbered in order of ``at``."""
    order = F.array_sort(F.collect_list(F.struct("at", "label")))
    told = F.transform(order, lambda e, k: F.concat(F.lit("Image "), (k + 1).cast("string"), F.lit(": "), e["label"]))
    return images.groupBy("study").agg(F.array_join(told, "\n").alias("images"))


def prompt(images: Column, technical: Column, findings: Column, question: Column) -> Column:
    """What is asked of a reader: images, technical data, findings where there are any, and the question."""
    auto = F.coalesce(F.concat(F.lit("\n\nReading of the whole exam:\n"), findings), F.lit(""))
    asked = F.coalesce(F.nullif(F.trim(question), F.lit("")), F.lit("(none: describe the exam)"))
    return F.concat(F.lit("Images sent, in order:\n"), F.coalesce(images, F.lit("(none)")), F.lit("\n\nTechnical data:\n"), technical, auto, F.lit("\n\nQuestion:\n"), asked)


def metal_counts(objects: DataFrame) -> DataFrame:
    """(series, pieces, and the number of each kind)."""
    return objects.groupBy("series").agg(F.count("*").alias("pieces"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))


def metal_list(objects: DataFrame, top: int = 20) -> DataFrame:
    """(series, object, n, line): pieces by kind and then length; of each series the ``top`` first."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    size = F.when(F.col("kind") == "screw", F.concat(fmt(F.col("length"), 1), F.lit(" mm long x "), fmt(F.col("width"), 1), F.lit(" mm"))).otherwise(F.concat(F.concat_ws(" x ", *(fmt(F.col(c), 1) for c in ("length", "width", "thickness"))), F.lit(" mm")))
    n = F.row_number().over(W.partitionBy("series").orderBy(kind, F.desc("length"), "object"))
    return objects.select("series", "object", n.alias("n"), F.concat(F.col("kind"), F.lit(": "), size, F.lit(", "), fmt(F.col("volume"), 0), F.lit(" mm3")).alias("line")).where(F.col("n") <= top)


#: fixed values: what the labels 1 to 3 are called next to metal
NEAR = {1: "skull", 2: "lower jaw", 3: "teeth"}


def metal_near(objects: DataFrame, v: DataFrame, refs: DataFrame, top: int = 20, reach: int = 3, midline: float = MIDLINE) -> DataFrame:
    """(series, object, n, line): each piece's kind, three sizes and volume, the label of most voxels about its centre, and where it lies."""
    from .views import majority

    at = objects.select("series", F.col("object").alias("id"), *(half_up(F.col(f"c{c}")).cast("int").alias(c) for c in "xyz"))
    near = majority(at, v, reach).withColumnRenamed("id", "object")
    name = F.lit("outside bone")
    for k, called in NEAR.items():
        name = F.when(F.col("label") == k, called).otherwise(name)
    d = objects.join(near, ["series", "object"], "left").join(refs, "series")
    n = F.row_number().over(W.partitionBy("series").orderBy("object"))
    size = F.concat_ws(" x ", fmt(F.col("length"), 0), fmt(F.col("width"), 0), fmt(F.col("thickness"), 1))
    line = F.concat("kind", F.lit(": "), size, F.lit(" mm, "), fmt(F.col("volume"), 0), F.lit(" mm3; next to "), name, F.lit("; "), position(midline))
    return d.select("series", "object", n.alias("n"), line.alias("line")).where(F.col("n") <= top)


def vessel_list(regions: DataFrame, top: int = 4, midline: float = MIDLINE) -> DataFrame:
    """(series, groups, line): how many groups, and volume and place of the ``top`` largest."""
    n = F.row_number().over(W.partitionBy("series").orderBy(F.desc("volume"), "component"))
    one = F.concat(fmt(F.col("volume") / 1000, 1), F.lit(" cm3 ("), position(midline), F.lit(")"))
    r = regions.select("series", n.alias("n"), F.when(n <= top, one).alias("one"))
    g = r.groupBy("series").agg(F.count("*").alias("groups"), F.array_sort(F.collect_list(F.when(F.col("n") <= top, F.struct("n", "one")))).alias("l"))  # ``top`` at most
    return g.select("series", "groups", F.concat(F.col("groups").cast("string"), F.lit(" group(s): "), F.array_join(F.transform("l", lambda e: e["one"]), "; ")).alias("line"))


def air_kind(regions: DataFrame) -> DataFrame:
    """``regions`` (series, volume, cx, cy, cz, and the columns of ``findings.references``) with ``kind``, what an air space may be."""
    lateral, deep = F.abs(F.col("cx") - F.col("mid_x")), F.col("cy") - F.col("front_y")
    above = F.col("bite_z").isNull() | (F.col("cz") > F.col("bite_z"))
    kind = F.when((lateral > LATERAL) & (deep > MASTOID), "mastoid or middle ear").when(lateral < NASAL, F.when(deep > PHARYNX, "pharynx").otherwise("nasal cavity"))
    kind = kind.when((lateral <= SINUS) & (deep <= SINUS_DEPTH) & above, F.when(lateral < MIXED, "maxillary sinus, perhaps with the nasal cavity").otherwise("maxillary sinus")).otherwise("other air space")
    return regions.withColumn("kind", kind)


def air_list(regions: DataFrame, top: int = 8, midline: float = MIDLINE) -> DataFrame:
    """(series, component, n, line) of the ``top`` largest air spaces of each series."""
    n = F.row_number().over(W.partitionBy("series").orderBy(F.desc("volume"), "component"))
    line = F.concat(fmt(F.col("volume") / 1000, 1), F.lit(" cm3: "), F.col("kind"), F.lit("; "), position(midline))
    return air_kind(regions).select("series", "component", n.alias("n"), line.alias("line")).where(F.col("n") <= top)


def sinus_pair(regions: DataFrame) -> DataFrame:
    """(series, left, right, line): the largest likely maxillary sinus of each side, null where a side has none."""
    r = air_kind(regions)
    likely = F.startswith("kind", F.lit("maxillary sinus"))
    side = [F.max(F.when(likely & on, F.col("volume"))) for on in (F.col("cx") > F.col("mid_x"), F.col("cx") < F.col("mid_x"))]
    g = r.groupBy("series").agg(side[0].alias("left"), side[1].alias("right"))
    both = F.concat(F.lit("right "), fmt(F.col("right") / 1000, 1), F.lit(" cm3, left "), fmt(F.col("left") / 1000, 1), F.lit(" cm3"))
    one = F.concat(F.lit("only one with air: "), F.when(F.col("left").isNotNull(), "left").otherwise("right"))
    return g.withColumn("line", F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), both).when(F.coalesce("left", "right").isNotNull(), one).otherwise("none"))


def largest(regions: DataFrame, top: int = 4) -> DataFrame:
    """(series, groups, line): how many groups of vessels, and the volumes of the ``top`` largest."""
    n = F.row_number().over(W.partitionBy("series").orderBy(F.desc("volume"), "component"))
    r = regions.select("series", "volume", "component", n.alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= top, F.struct("n", fmt(F.col("volume") / 1000, 1).alias("t"))))), lambda e: F.concat(e["t"], F.lit(" cm3"))), "; ")
    return r.groupBy("series").agg(F.count("*").alias("groups"), text.alias("line"))


def sampled_centroid(v: DataFrame, keys: list[str], most: int = 5000) -> DataFrame:
    """(keys, cx, cy, cz): mean place of each group's voxels, of about ``most`` or some more at even steps where it has more."""
    w = W.partitionBy(*keys)
    d = v.withColumns({"n": F.count("*").over(w), "k": F.row_number().over(w.orderBy("z", "y", "x")) - 1})
    d = d.where(F.col("k") % F.greatest(F.lit(1), F.floor(F.col("n") / most)) == 0)
    return d.groupBy(*keys).agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"))


def upsert_layers(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Layers (key, name, triangles, visible) with those of the same key replaced, which keep their visibility; empty ones go."""
    old = held.select("key", F.struct("name", "triangles", "visible").alias("old"))
    new = incoming.select("key", F.struct("name", "triangles", "visible").alias("new"))
    d = old.join(new, "key", "full")
    pick = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))
    return d.select("key", pick("name").alias("name"), pick("triangles").alias("triangles"), F.coalesce("old.visible", "new.visible").alias("visible")).where("triangles > 0")


#: fixed values: colours of the labels 1 to 6, and of the structures that users make from 10 on
LABEL_COLOURS = ((0.93, 0.89, 0.8), (0.55, 0.75, 0.95), (1.0, 0.98, 0.9), (1.0, 0.74, 0.18), (0.55, 0.85, 0.98), (0.95, 0.22, 0.25))
USER_COLOURS = ((0.6, 0.83, 0.55), (0.78, 0.62, 0.92), (0.95, 0.6, 0.45), (0.45, 0.82, 0.78), (0.93, 0.55, 0.68), (0.9, 0.85, 0.45), (0.55, 0.6, 0.95), (0.75, 0.75, 0.75))


def colour(label: Column) -> Column:
    table = lambda t: F.array(*(F.array(*map(F.lit, c)) for c in t))
    return F.when(label.between(1, 6), F.try_element_at(table(LABEL_COLOURS), label.cast("int"))).otherwise(F.element_at(table(USER_COLOURS), (F.pmod(label - 10, F.lit(8)) + 1).cast("int")))


def register(structures: DataFrame, splits: DataFrame, first: int = 10, last: int = 250) -> DataFrame:
    """Structures (series, id, name, base) with the splits (series, at, of, name) added: numbered on from ``first`` in order, with the
    base of what they are split from; beyond ``last`` none is added."""
    top = structures.groupBy("series").agg(F.greatest(F.max("id"), F.lit(first - 1)).alias("top"))
    base = structures.select("series", F.col("id").alias("of"), "base")
    n = F.row_number().over(W.partitionBy("series").orderBy("at"))
    new = splits.join(base, ["series", "of"]).withColumn("n", n).join(top, "series").select("series", (F.col("top") + F.col("n")).alias("id"), "name", "base")
    return structures.select("series", "id", "name", "base").unionByName(new.where(F.col("id") <= last))


def base_field(base: Column, bone: Column, metal: Column, teeth: Column, extra: Column) -> Column:
    """The field that a structure's surface is taken from: metal's, the teeth's, an own one, else the bone's."""
    return F.when((base == "metal") & metal.isNotNull(), metal).when((base == "teeth") & teeth.isNotNull(), teeth).otherwise(F.coalesce(extra, bone))
