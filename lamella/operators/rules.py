"""Rules over series headers, symmetry, and text columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import clamp, dot
from .assess import level
from .planning import along
from .reduce import few


def quality(s: DataFrame) -> DataFrame:
    """Score from 100 by deductions, its level, and the warnings."""
    sz, xy = F.coalesce("spacing", F.lit(5.0)), F.coalesce("in_plane", F.lit(1.0))
    rules = [
        (sz > 3, 45, "thick slices"), ((sz > 1.25) & (sz <= 3), 20, "moderate slices"), (F.col("frames") < 40, 15, "few slices"), (xy > 0.8, 10, "coarse pixels"),
        (F.col("irregular"), 10, "irregular gaps"), (~F.col("has_positions"), 10, "no positions"), (F.col("lossy"), 5, "lossy"), (F.col("derived"), 5, "derived"),
    ]
    score = F.greatest(F.lit(0), F.lit(100) - sum((F.when(c, n).otherwise(0) for c, n, _ in rules), F.lit(0)))
    return s.select("id", score.alias("score"), level(score).alias("level"), F.concat_ws("; ", *(F.when(c, F.lit(t)) for c, _, t in rules)).alias("warnings"))


def best_series(s: DataFrame) -> DataFrame:
    """Of each study the series with most frames a millimetre of spacing; the first id on ties; unusable ones last.  Without a spacing the slices' thickness counts, else 5 mm."""
    rank = F.when((F.col("frames") < 3) | (F.col("rows_") < 128), -1.0).otherwise(F.col("frames") / F.greatest(F.lit(0.3), F.coalesce("spacing", "thickness", F.lit(5.0))))
    r = s.withColumn("rank", F.round(rank, 6))
    w = W.partitionBy("study").orderBy(F.desc("rank"), "id")
    return r.withColumn("n", F.row_number().over(w)).where("n = 1").select("study", "id", "rank")


def resolution(s: DataFrame) -> DataFrame:
    """(id, axis 0-2, mm): a series is fine within its plane and coarse along its normal."""
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.round(along(a), 6).alias("mm")) for a in range(3)))
    return s.where("nx is not null").select("id", F.explode(each).alias("e")).select("id", "e.a", "e.mm")


def overlap(boxes: DataFrame) -> DataFrame:
    """(a, b, fraction): how much of b's box lies in a's, for the pairs of a group ``g`` that meet along x.

    Boxes are dealt to cells along x and joined by cell, so that a group is not paired with itself whole.  The join is a merge: Spark's
    estimate leaves out that a box covers many cells, so that it would broadcast them all through the driver.
    """
    cell, edges = 8.0, ("x0", "x1", "y0", "y1", "z0", "z1")
    c = boxes.withColumn("cell", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))))
    left, right = (c.select("g", "cell", *(F.col(n).alias(f"{k}_{n}") for n in ("id", *edges))) for k in "ab")
    j = left.join(right.hint("merge"), ["g", "cell"]).where((F.col("a_id") != F.col("b_id")) & (F.col("cell") == F.floor(F.greatest("a_x0", "b_x0") / cell)))
    both = [F.greatest(F.lit(0.0), F.least(f"a_{n}1", f"b_{n}1") - F.greatest(f"a_{n}0", f"b_{n}0")) for n in "xyz"]
    own = [F.greatest(F.lit(1e-6), F.col(f"b_{n}1") - F.col(f"b_{n}0")) for n in "xyz"]
    share = both[0] * both[1] * both[2] / (own[0] * own[1] * own[2])
    return j.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(share, 6).alias("fraction")).where("fraction > 0")


def mirror_symmetry(v: DataFrame, threshold: float = 200) -> DataFrame:
    """Share of mask voxels whose mirror image across the middle of x is in the mask, and counts of either side; see also ``findings.symmetry``."""
    wide = v.groupBy("series").agg((F.max("x") + 1).alias("width"))
    m = v.where(F.col("hu") >= threshold).select("series", F.lit(0).alias("part"), "x", "y", "z").join(wide, "series")
    other = m.select("series", (F.col("width") - 1 - F.col("x")).alias("x"), "y", "z", F.lit(1).alias("hit"))
    j = m.join(other, ["series", "x", "y", "z"], "left")
    return j.groupBy("series", "part").agg(F.count("*").alias("voxels"), F.count_if(F.col("x") < F.floor(F.col("width") / 2)).alias("low_side"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("overlap"))


#: fixed values below; words end where no ASCII letter, digit or underscore follows, whatever the JVM takes for a word character
_B, _E = "(?<![a-z0-9_])", "(?![a-z0-9_])"
#: fixed values: mentions of contrast in lower case, and those that take it back
CONTRAST = rf"{_B}c\s*/\s*c{_E}|com\s+contraste|{_B}contraste{_E}|{_B}c\+|{_B}pos[- ]?contraste|{_B}angio"
NO_CONTRAST = rf"sem\s+contraste|{_B}s\s*/\s*c{_E}"


def contrast_flag(agent: Column, text: Column) -> Column:
    """A named agent, or a mention in the description that is not taken back."""
    named = F.lower(F.trim(F.coalesce(agent, F.lit(""))))
    said = F.lower(F.coalesce(text, F.lit("")))
    return F.when((named != "") & ~named.isin("none", "nenhum", "sem", "no", "n/a"), True).otherwise(said.rlike(CONTRAST) & ~said.rlike(NO_CONTRAST))


#: fixed values: endings and the name that are not read
SKIPPED = ("txt", "xml", "htm", "html", "pdf", "exe", "ini", "inf", "jpg", "jpeg", "png", "db")


def readable(name: Column) -> Column:
    return ~F.lower(name).rlike(r"\.(" + "|".join(SKIPPED) + ")$") & (name != "DICOMDIR")


def _marked() -> tuple[str, str]:
    """Letters with marks, and the ASCII letters that they decompose to."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, d[0]) for a, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, with a dash for each run of others; marks are taken off letters."""
    plain = F.regexp_replace(F.translate(text, *_marked()), "[\u0300-\u036f]", "")
    return F.lower(F.regexp_replace(plain, "[^A-Za-z0-9]+", "-"))


def base_name(patient: Column, hidden: Column) -> Column:
    """Name of a file: the patient before it where that is not hidden."""
    who = F.when(~hidden & (F.coalesce(patient, F.lit("")) != ""), F.concat(F.regexp_replace(patient, r"\s+", "_"), F.lit("-"))).otherwise("")
    return F.concat(who, F.lit("reconstrucao-ossea"))


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, block, kind, lines): lines by kind, with runs of list items (and of plain lines) as one block each.

    Headings of one or two signs are h3, of three or four h4.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.replace(F.col(text_col), F.lit("\r"), F.lit("")), "\n")).alias("n", "line"))
    line = F.regexp_replace("line", r"\s+$", "")
    kind = F.when(line == "", "blank").when(line.rlike(r"^\s*(-{3,}|\*{3,}|_{3,})$"), "hr").when(line.rlike(r"^#{1,2}\s+"), "h3").when(line.rlike(r"^#{3,4}\s+"), "h4").when(line.rlike(r"^\s*[-*•]\s+\S"), "ul").when(line.rlike(r"^\s*[0-9]+[.)]\s+\S"), "ol").otherwise("p")
    lines = lines.withColumn("kind", kind)
    w = W.partitionBy("id").orderBy("n")
    new = F.when((F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit(""))) | ~F.col("kind").isin("ul", "ol", "p", "blank"), 1).otherwise(0)
    lines = lines.withColumn("new", new).withColumn("block", F.sum("new").over(w))
    return lines.where("kind <> 'blank'").groupBy("id", "block", "kind").agg(F.count("*").alias("lines"))


#: fixed values: strong, emphasis and code within a line; of what is not marked with a star and a space
SPANS = r"\*\*.+?\*\*|__.+?__|\*\S.*?\*|`[^`]+`"


def markdown_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, kind, content) of the marked spans of each text, in order."""
    d = docs.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(SPANS), F.lit(0))).alias("n", "m"))
    code, strong = F.startswith("m", F.lit("`")), F.col("m").rlike(r"^(\*\*.+\*\*|__.+__)$")
    cut = F.when(strong, 2).otherwise(1)
    return d.select("id", "n", F.when(code, "code").when(strong, "strong").otherwise("em").alias("kind"), F.substring(F.col("m"), cut + 1, F.length("m") - 2 * cut).alias("content"))


def transfer(levels: DataFrame, classes: DataFrame, edge: int = 20) -> DataFrame:
    """At each level the most opaque class, with linear edges; the first on ties, none where all are clear.

    ``classes`` are those that are shown, one row each; more than ``MOST_CLASSES`` are refused.
    """
    j = levels.join(F.broadcast(few(classes).where("hi > lo")), (F.col("u") > F.col("lo") - edge) & (F.col("u") < F.col("hi") + edge), "left")
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("u") - F.col("lo") + edge) / edge), F.greatest(F.lit(0.0), (F.col("hi") + edge - F.col("u")) / edge))
    j = j.withColumn("o", F.round(F.col("opacity") * ramp, 6))
    return j.groupBy("u").agg(F.max_by("class", F.struct("o", -F.col("ord"))).alias("class"), F.coalesce(F.max("o"), F.lit(0.0)).alias("opacity"))


#: fixed values: tissue classes (key, lowest and highest HU, opacity); bone begins at the threshold, with contrast at 450 at least, and vessels end below it
def tissues(threshold: float, contrast: bool) -> list[tuple[str, float, float, float]]:
    bone = max(threshold, 450) if contrast else threshold
    table = (
        ("skin", -500, -150, 0.25), ("fat", -140, -50, 0.03), ("glands", -30, 25, 0.04), ("muscle", 30, 90, 0.03),
        ("vessels", 150, min(bone - 10, 450), 0.45), ("bone", bone, 1800, 0.55), ("teeth", 1800, 2999, 0.85), ("metal", 3000, 4095, 1.0),
    )
    return [(key, float(lo), float(hi), opacity) for key, lo, hi, opacity in table]


#: fixed values: the colours of skin and bone
SKIN, BONE = (0.86, 0.62, 0.5), (0.93, 0.89, 0.8)
CHANNELS = ("opacity", "red", "green", "blue")


def control_points(threshold: float) -> list[tuple[str, str, float, float]]:
    """(view, channel, level, value): the break points of opacity and colour of each view of a volume, around the bone's threshold."""
    t = float(threshold)
    #: fixed values: (level, opacity) and (level, red, green, blue)
    bone = [(t + 80, 0.25), (t + 500, 0.65), (t + 1500, 0.9)]
    opacity = {
        "skin": [(-750, 0), (-450, 0.5), (-200, 0.9), (3000, 0.9)],
        "bone-skin": [(-800, 0), (-500, 0), (-350, 0.06), (-100, 0.04), (t - 120, 0.03), *bone],
        "bone": [(-1024, 0), (t - 120, 0), *bone],
    }
    warm = [(t - 150, 0.55, 0.25, 0.15), (t + 150, 0.88, 0.78, 0.65), (t + 900, *BONE), (t + 2000, 1, 1, 0.97)]
    colour = {"skin": [(-600, *SKIN), (0, 0.9, 0.7, 0.6), (t, *BONE)], "bone-skin": [(-500, *SKIN), (-100, 0.8, 0.55, 0.45), *warm], "bone": warm}
    out = [(view, "opacity", float(u), float(o)) for view, points in opacity.items() for u, o in points]
    return out + [(view, c, float(p[0]), float(p[k + 1])) for view, points in colour.items() for p in points for k, c in enumerate(CHANNELS[1:])]


def interpolated(levels: DataFrame, points: DataFrame) -> DataFrame:
    """(u, view, channel, value) at each level ``u``: linear between the break points on either side, that of the outermost beyond them.

    ``points``: view, channel, level, value, few rows that are broadcast; a level is joined with one interval a channel.
    """
    w = W.partitionBy("view", "channel").orderBy("level")
    hi, last = F.lead("level").over(w), F.col("level")
    s = points.select("view", "channel", F.when(F.lag("level").over(w).isNull(), F.lit(float("-inf"))).otherwise(last).alias("lo"), last.alias("a"), F.coalesce(hi, F.lit(float("inf"))).alias("hi"), F.col("value").alias("va"), F.coalesce(F.lead("value").over(w), "value").alias("vb"))
    j = levels.join(F.broadcast(few(s)), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    part = F.when((F.col("hi") == float("inf")) | (F.col("u") <= F.col("a")), 0.0).otherwise((F.col("u") - F.col("a")) / (F.col("hi") - F.col("a")))
    return j.select("u", "view", "channel", (F.col("va") + (F.col("vb") - F.col("va")) * part).alias("value"))


#: fixed values: classes that each preset shows
PRESETS = {"bone": ("bone", "teeth", "metal"), "bone-skin": ("skin", "bone", "teeth", "metal"), "skin": ("skin",), "soft": ("fat", "glands", "muscle", "bone", "teeth", "metal"), "vessels": ("vessels", "bone", "teeth", "metal")}


def landmark_angles(points: DataFrame) -> DataFrame:
    """(series, vec_id, before, after, angle) of every point between two others: its distances to them and the angle at it in degrees.

    Points follow each other by vec_id; the angle is null where a distance is zero.
    """
    w = W.partitionBy("series").orderBy("vec_id")
    p = points.select("series", "vec_id", *(F.lag(c).over(w).alias(f"p{c}") for c in "xyz"), *(F.lead(c).over(w).alias(f"n{c}") for c in "xyz"), *"xyz").where("px is not null and nx is not null")
    a, b = ([F.col(k + c) - F.col(c) for c in "xyz"] for k in "pn")
    ab, bc = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    turn = F.degrees(F.acos(clamp(dot(a, b) / F.nullif(ab * bc, F.lit(0.0)), -1.0, 1.0)))
    return p.select("series", "vec_id", F.round(ab, 5).alias("before"), F.round(bc, 5).alias("after"), F.round(turn, 4).alias("angle"))
