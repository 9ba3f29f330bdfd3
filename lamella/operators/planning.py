"""Choice of the series of a study from which a volume is rebuilt: one fine series, or coarse ones of several orientations fused.

Series are rows (study, id, description, modality, frames, rows_, spacing, thickness, px0, px1, the unit normal nx, ny, nz, the box x0 to
z1, frame_of_reference, colour); null spacings fall back to the slice thickness and then to 5 mm, null pixel sizes to 1 mm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dominant_axis, fmt

#: fixed values: modalities that are no images of the body, least frames and rows, mm up to which a series is fine, least overlap and most cosine of complements
NO_IMAGES, FRAMES, ROWS, FINE, OVERLAP, COSINE = "(?i)^(SR|PR|KO|DOC)$", 8, 128, 1.5, 0.3, 0.7
NORMAL = ("nx", "ny", "nz")


def plane_name(normal=NORMAL) -> Column:
    a = dominant_axis(*(F.col(n) for n in normal))
    return F.when(a == 0, "sagittal").when(a == 1, "coronal").otherwise("axial")


def spacing_of() -> Column:
    return F.coalesce("spacing", "thickness", F.lit(5.0))


def in_plane_of() -> Column:
    return F.greatest(F.coalesce("px0", F.lit(1.0)), F.coalesce("px1", F.lit(1.0)))


def along(axis: int) -> Column:
    """mm between samples along an axis of the patient."""
    c = F.abs(F.col(NORMAL[axis]))
    return c * spacing_of() + (1 - c) * in_plane_of()


def judged(s: DataFrame) -> DataFrame:
    """``s`` with plane, sp, ip, worst (mm along the worst axis), usable, and the reason where it is not."""
    bad = F.coalesce("modality", F.lit("")).rlike(NO_IMAGES)
    usable = (F.col("frames") >= FRAMES) & (F.col("rows_") >= ROWS) & F.col("nx").isNotNull() & ~F.col("colour") & ~bad
    why = F.when(F.coalesce(F.col("nx").isNotNull() & F.col("colour"), F.lit(False)), "colour image").when(F.col("frames") < FRAMES, "few images").otherwise("no usable geometry")
    s = s.withColumns({"plane": F.when(F.col("nx").isNotNull(), plane_name()), "sp": spacing_of(), "ip": in_plane_of(), "worst": F.greatest(*(along(a) for a in range(3))), "usable": usable})
    return s.withColumn("reason", F.when(~F.col("usable"), why))


def _overlap(a: Column, b: Column) -> Column:
    """Share of b's box that lies in a's."""
    both = own = F.lit(1.0)
    for c in "xyz":
        both = both * F.greatest(F.lit(0.0), F.least(a[f"{c}1"], b[f"{c}1"]) - F.greatest(a[f"{c}0"], b[f"{c}0"]))
        own = own * F.greatest(F.lit(1e-6), b[f"{c}1"] - b[f"{c}0"])
    return both / own


def _finer(a: Column, b: Column) -> Column:
    """Below zero where a comes before b: by the worst axis; differences of up to a fifth are ties, which axial series and then more frames break."""
    tie = b["axial"] - a["axial"]
    tie = F.when(tie != 0, tie).otherwise(b["frames"] - a["frames"])
    apart = F.abs(a["worst"] - b["worst"]) > 0.2 * F.least(a["worst"], b["worst"])
    return F.when(apart, F.when(a["worst"] < b["worst"], -1).otherwise(1)).otherwise(tie.cast("int"))


def _ranked(series: Column) -> Column:
    """A study's series in order, inserted one by one.

    The order is not transitive, so that no ORDER BY can say it.  A series is put behind the last one that it does not come before; as long
    as each comes before the first, it is put in front of it.
    """

    def insert(acc: Column, e: Column) -> Column:
        held = acc["held"]
        first = F.get(held, F.lit(0))
        front = F.coalesce(acc["front"] & (_finer(e, first) < 0), F.lit(False))
        behind = F.coalesce(F.array_max(F.transform(held, lambda x, i: F.when(_finer(e, x) >= 0, i + 1).otherwise(0))), F.lit(0))
        at = F.when(front, 0).otherwise(behind)
        new = F.concat(F.slice(held, F.lit(1), at), F.array(e), F.slice(held, at + 1, F.size(held) - at))
        return F.struct(new.alias("held"), (front | (F.size(held) == 0)).alias("front"))

    start = F.struct(F.slice(series, 1, 0).alias("held"), F.lit(True).alias("front"))
    return F.aggregate(series, start, insert, lambda acc: acc["held"])


def _chosen(ranked: Column) -> Column:
    """The series used, the main one first: up to two more that fill the gaps of a coarse main series."""
    main = ranked[0]

    def add(used: Column, c: Column) -> Column:
        blank = lambda e: F.coalesce(e["frame_of_reference"], F.lit("")) == ""
        same = blank(main) | blank(c) | (c["frame_of_reference"] == main["frame_of_reference"])
        apart = F.forall(used, lambda u: F.abs(u["nx"] * c["nx"] + u["ny"] * c["ny"] + u["nz"] * c["nz"]) < COSINE)
        fits = (main["sp"] > FINE) & (F.size(used) < 3) & same & (_overlap(c, main) > OVERLAP) & apart
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(used, F.array(c))).otherwise(used)

    return F.aggregate(F.slice(ranked, F.lit(2), F.size(ranked)), F.slice(ranked, 1, 1), add)


def plan(s: DataFrame) -> DataFrame:
    """(study, id, role, place, reason): the main series, up to two complementary ones, and why the others are not used.

    ``place`` counts the series used from 1.  What meets is the headers of one study, as an array.
    """
    j = judged(s)
    axial = (F.col("plane") == "axial").cast("int").alias("axial")
    head = F.struct("id", "worst", axial, F.col("frames").cast("int").alias("frames"), "sp", "plane", "frame_of_reference", *NORMAL, *(f"{c}{k}" for c in "xyz" for k in "01"))
    g = j.where("usable").groupBy("study").agg(F.array_sort(F.collect_list(head)).alias("l"))
    g = g.select("study", _ranked(F.col("l")).alias("l")).select("study", F.col("l")[0].alias("main"), F.transform(_chosen(F.col("l")), lambda e: e["id"]).alias("used"))
    d = j.join(g.select("study", F.col("main.sp").alias("main_sp"), F.col("main.plane").alias("main_plane"), "used"), "study", "left")
    d = d.withColumn("place", F.nullif(F.array_position("used", F.col("id")), F.lit(0)).cast("int"))
    told = F.when(F.col("place") == 1, F.concat("plane", F.lit(", "), F.col("frames").cast("string"), F.lit(" slices, "), fmt(F.col("sp")), F.lit(" mm apart")))
    told = told.when(F.col("place") > 1, F.concat("plane", F.lit(", fills the gaps of the main series")))
    told = told.when(~F.col("usable"), F.col("reason")).when((F.col("sp") <= F.col("main_sp") * 1.05) & (F.col("plane") == F.col("main_plane")), "same orientation as the main series").otherwise("covers another region or has less detail")
    role = F.when(F.col("place") == 1, "main").when(F.col("place") > 1, "complementary").otherwise("ignored")
    return d.select("study", "id", role.alias("role"), "place", told.alias("reason"))


def effective(s: DataFrame, planned: DataFrame) -> DataFrame:
    """(study, strategy, n_used, ex, ey, ez, gap): the best mm along each axis that a used series offers, and a realistic gap."""
    u = judged(s).join(planned.where("place is not null").select("study", "id", "place"), ["study", "id"])
    g = u.groupBy("study").agg(F.count("*").alias("n_used"), *(F.min(along(a)).alias(f"e{c}") for a, c in enumerate("xyz")), F.exp(F.avg(F.log("sp"))).alias("mean"), F.max(F.when(F.col("place") == 1, F.col("ip"))).alias("ip"))
    gap = F.greatest("ip", F.col("mean") / F.sqrt("n_used"))
    return g.select("study", F.when(F.col("n_used") > 1, "fusion").otherwise("single").alias("strategy"), "n_used", "ex", "ey", "ez", gap.alias("gap"))


def role_list(planned: DataFrame) -> DataFrame:
    """``planned`` with ``n``, its place in the list of a study: main, complementary, ignored, each by id."""
    from pyspark.sql import Window as W

    kind = F.when(F.col("role") == "main", 0).when(F.col("role") == "complementary", 1).otherwise(2)
    return planned.withColumn("n", F.row_number().over(W.partitionBy("study").orderBy(kind, "id")))


def series_list(s: DataFrame) -> DataFrame:
    """(study, id, n, line): the series of a study by number, those without one first."""
    from pyspark.sql import Window as W

    mm = F.coalesce("spacing", "thickness")
    line = F.concat(F.coalesce("modality", F.lit("")), F.lit(" - "), F.col("frames").cast("string"), F.lit(" image(s)"), F.coalesce(F.concat(F.lit(" - "), fmt(mm), F.lit(" mm")), F.lit("")))
    return s.select("study", "id", F.row_number().over(W.partitionBy("study").orderBy(F.coalesce("series_number", F.lit(0)), "id")).alias("n"), line.alias("line"))
