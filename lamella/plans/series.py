"""Queries over headers: planning, quality, assembly and text, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import fmt
from ..operators import assemble as B
from ..operators import assess as Q
from ..operators import planning as P
from ..operators import report as W
from ..operators import rules as U
from ..sources import adapters as A
from .catalog import query


def sql_fmt(e: str, digits: int = 2) -> str:
    """DuckDB for ``functions.scalar.fmt``."""
    text = f"format('{{:,.{digits}f}}', round(({e})::DOUBLE, {digits}))"
    if digits:
        text = f"regexp_replace({text}, '[.]?0+$', '')"
    return f"translate({text}, ',.', '.,')"


_K = "p_partkey"
#: headers of series, three a study
S = f"""s AS (SELECT {_K} AS id, {_K} // 3 AS study, p_name AS description, CASE WHEN {_K} % 4 = 1 THEN NULL ELSE {_K} % 6 END AS series_number, CASE WHEN {_K} % 10 = 0 THEN 5 ELSE 8 + p_size END AS frames, CASE WHEN {_K} % 17 = 0 THEN 96 ELSE 512 END AS rows_,
list_extract(['CT', 'sr', 'MR', 'CT', 'CT', ''], CAST(CASE WHEN {_K} % 19 = 0 THEN 2 WHEN {_K} % 7 = 0 THEN 3 WHEN {_K} % 31 = 0 THEN 6 ELSE 1 END AS INT)) AS modality, {_K} % 23 = 0 AS colour,
CASE WHEN {_K} % 11 = 0 THEN NULL ELSE ({_K} * 7 % 9 + 1) * 0.6::DOUBLE END AS spacing, CASE WHEN {_K} % 22 = 0 THEN NULL ELSE ({_K} * 5 % 6 + 1) * 0.5::DOUBLE END AS thickness, ({_K} % 4 + 1) * 0.25::DOUBLE AS px0, CASE WHEN {_K} % 13 = 0 THEN NULL ELSE ({_K} % 4 + 1) * 0.25::DOUBLE + {_K} % 3 * 0.05::DOUBLE END AS px1,
CASE WHEN {_K} % 29 = 0 THEN NULL WHEN {_K} % 3 = 0 THEN CASE WHEN {_K} % 5 = 0 THEN 0.8::DOUBLE ELSE 1 END WHEN {_K} % 3 = 2 AND {_K} % 5 = 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS nx,
CASE WHEN {_K} % 29 = 0 THEN NULL WHEN {_K} % 3 = 1 THEN CASE WHEN {_K} % 5 = 0 THEN 0.8::DOUBLE ELSE 1 END WHEN {_K} % 3 = 0 AND {_K} % 5 = 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS ny,
CASE WHEN {_K} % 29 = 0 THEN NULL WHEN {_K} % 3 = 2 THEN CASE WHEN {_K} % 5 = 0 THEN 0.8::DOUBLE ELSE 1 END WHEN {_K} % 3 = 1 AND {_K} % 5 = 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS nz,
{_K} % 4 * 20.0::DOUBLE AS x0, {_K} % 4 * 20 + 100.0::DOUBLE AS x1, {_K} % 3 * 15.0::DOUBLE AS y0, {_K} % 3 * 15 + 120.0::DOUBLE AS y1, {_K} % 5 * 10.0::DOUBLE AS z0, {_K} % 5 * 10 + 90.0::DOUBLE AS z1,
CASE WHEN {_K} % 7 = 0 THEN NULL WHEN {_K} % 8 = 0 THEN 'G' ELSE 'F' END AS frame_of_reference, list_extract(['Planmeca', 'GE MEDICAL', 'i-CAT', 'Siemens', 'X-Ray Co', NULL], CAST({_K} % 6 + 1 AS INT)) AS maker,
list_extract(['1.2.840.10008.1.2.4.50', '1.2.840.10008.1.2.1', '1.2.840.10008.1.2.4.91', '1.2.840.10008.1.2.4.70'], CAST({_K} % 4 + 1 AS INT)) AS syntax FROM part)"""
_MM = [f"abs({n}) * sp + (1 - abs({n})) * ip" for n in ("nx", "ny", "nz")]
J = f"""{S}, j0 AS (SELECT *, coalesce(spacing, thickness, 5.0::DOUBLE) AS sp, greatest(coalesce(px0, 1.0::DOUBLE), coalesce(px1, 1.0::DOUBLE)) AS ip, CASE WHEN nx IS NULL THEN NULL WHEN abs(nx) >= abs(ny) AND abs(nx) >= abs(nz) THEN 'sagittal' WHEN abs(ny) >= abs(nz) THEN 'coronal' ELSE 'axial' END AS plane FROM s),
j AS (SELECT *, CASE WHEN nx IS NOT NULL THEN greatest({", ".join(_MM)}) END AS worst, frames >= 8 AND rows_ >= 128 AND nx IS NOT NULL AND NOT colour AND NOT regexp_matches(upper(modality), '^(SR|PR|KO|DOC)$') AS usable FROM j0),
why AS (SELECT *, CASE WHEN usable THEN NULL WHEN nx IS NOT NULL AND colour THEN 'colour image' WHEN frames < 8 THEN 'few images' ELSE 'no usable geometry' END AS reason FROM j)"""
_OVER = " * ".join(f"greatest(0.0::DOUBLE, least(a.{c}1, m.{c}1) - greatest(a.{c}0, m.{c}0))" for c in "xyz") + " / (" + " * ".join(f"(m.{c}1 - m.{c}0)" for c in "xyz") + ")"
_DOT = "abs({0}.nx * {1}.nx + {0}.ny * {1}.ny + {0}.nz * {1}.nz)"
PLAN = f"""{J}, u AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY id) - 1 AS n FROM j WHERE usable),
c AS (SELECT a.study, a.n AS i, b.n AS k, CASE WHEN abs(a.worst - b.worst) > 0.2::DOUBLE * least(a.worst, b.worst) THEN a.worst < b.worst WHEN (a.plane = 'axial') <> (b.plane = 'axial') THEN a.plane = 'axial' ELSE a.frames > b.frames END AS lt FROM u a JOIN u b USING (study)),
o AS (SELECT study, CASE WHEN max(i) = 0 THEN [0] WHEN max(i) = 1 THEN CASE WHEN bool_or(lt) FILTER (i = 1 AND k = 0) THEN [1, 0] ELSE [0, 1] END
WHEN bool_or(lt) FILTER (i = 1 AND k = 0) THEN CASE WHEN bool_or(lt) FILTER (i = 2 AND k = 1) THEN [2, 1, 0] WHEN bool_or(lt) FILTER (i = 2 AND k = 0) THEN [1, 2, 0] ELSE [1, 0, 2] END
WHEN NOT bool_or(lt) FILTER (i = 2 AND k = 1) THEN [0, 1, 2] WHEN bool_or(lt) FILTER (i = 2 AND k = 0) THEN [2, 0, 1] ELSE [0, 2, 1] END AS ord FROM c GROUP BY study),
r AS (SELECT u.*, list_position(ord, n) AS rank FROM u JOIN o USING (study)), m AS (SELECT * FROM r WHERE rank = 1),
a AS (SELECT r.*, r.rank > 1 AND m.sp > 1.5 AND (r.frame_of_reference IS NULL OR m.frame_of_reference IS NULL OR r.frame_of_reference = m.frame_of_reference) AND ({_OVER.replace("a.", "r.")}) > 0.3 AND {_DOT.format("r", "m")} < 0.7 AS may FROM r JOIN m USING (study)),
t AS (SELECT a.*, CASE WHEN a.rank = 1 THEN 1 WHEN a.rank = 2 AND a.may THEN 2 WHEN a.rank = 3 AND a.may AND coalesce(b.may, false) AND {_DOT.format("a", "b")} < 0.7 THEN 3 WHEN a.rank = 3 AND a.may AND NOT coalesce(b.may, false) THEN 2 END AS place FROM a LEFT JOIN a b ON b.study = a.study AND b.rank = 2)"""
ROLES = f"""{PLAN}, pl AS (SELECT why.study, why.id, CASE WHEN place = 1 THEN 'main' WHEN place > 1 THEN 'complementary' ELSE 'ignored' END AS role, CAST(place AS INT) AS place, CASE WHEN place = 1 THEN why.plane || ', ' || why.frames || ' slices, ' || {sql_fmt("why.sp")} || ' mm apart' WHEN place > 1 THEN why.plane || ', fills the gaps of the main series'
WHEN NOT why.usable THEN reason WHEN why.sp <= m.sp * 1.05::DOUBLE AND why.plane = m.plane THEN 'same orientation as the main series' ELSE 'covers another region or has less detail' END AS reason FROM why LEFT JOIN t ON t.id = why.id LEFT JOIN m ON m.study = why.study)"""
EFFECT = f"""{PLAN}, ef AS (SELECT study, CASE WHEN count(*) > 1 THEN 'fusion' ELSE 'single' END AS strategy, count(*) AS n_used, {", ".join(f"min({e}) AS e{c}" for e, c in zip(_MM, "xyz", strict=True))}, greatest(max(ip) FILTER (place = 1), exp(avg(ln(sp))) / sqrt(count(*))) AS gap FROM t WHERE place IS NOT NULL GROUP BY study)"""


@query(f"WITH {J} SELECT id, unnest([0, 1, 2]) AS a, round(unnest([{', '.join(_MM)}]), 6) AS mm FROM j WHERE nx IS NOT NULL")
def series_resolution(spark, d):
    return U.resolution(A.plan_series(spark, d))


@query(f"WITH {S}, p AS (SELECT a.id AS a, m.id AS b, round({_OVER}, 6) AS fraction FROM s a JOIN s m ON a.study = m.study AND a.id <> m.id) SELECT * FROM p WHERE fraction > 0")
def series_overlap(spark, d):
    return U.overlap(A.plan_series(spark, d).withColumn("g", F.col("study")))


@query(f"WITH {J} SELECT study, id, plane, usable, reason, round(worst, 6) AS worst FROM why")
def usable_series(spark, d):
    return P.judged(A.plan_series(spark, d)).select("study", "id", "plane", "usable", "reason", F.round("worst", 6).alias("worst"))


@query(f"WITH {ROLES} SELECT * FROM pl")
def reconstruction_plan(spark, d):
    return P.plan(A.plan_series(spark, d))


@query(f"WITH {ROLES} SELECT *, row_number() OVER (PARTITION BY study ORDER BY CASE role WHEN 'main' THEN 0 WHEN 'complementary' THEN 1 ELSE 2 END, id) AS n FROM pl")
def plan_card(spark, d):
    return P.role_list(P.plan(A.plan_series(spark, d)))


@query(f"WITH {EFFECT} SELECT study, strategy, n_used, round(ex, 6) AS ex, round(ey, 6) AS ey, round(ez, 6) AS ez, round(gap, 6) AS gap FROM ef")
def effective_resolution(spark, d):
    s = A.plan_series(spark, d)
    return P.effective(s, P.plan(s)).select("study", "strategy", "n_used", *(F.round(c, 6).alias(c) for c in ("ex", "ey", "ez", "gap")))


@query(f"WITH {S} SELECT study, id, row_number() OVER (PARTITION BY study ORDER BY coalesce(series_number, 0), id) AS n, modality || ' - ' || frames || ' image(s)' || coalesce(' - ' || {sql_fmt('coalesce(spacing, thickness)')} || ' mm', '') AS line FROM s")
def series_list(spark, d):
    return P.series_list(A.plan_series(spark, d))


_SCORE = "CASE WHEN gap <= 1.25 THEN 80 WHEN gap <= 4 THEN 60 ELSE 40 END"
_LEVEL = "CASE WHEN {0} >= 75 THEN 'good' WHEN {0} >= 45 THEN 'moderate' ELSE 'limited' END"


@query(f"WITH {EFFECT} SELECT study, {_SCORE} AS score, {_LEVEL.format(_SCORE)} AS level, 'Series fused: ' || n_used || '; Grid: 0,5 mm; Effective spacing: ' || {sql_fmt('gap', 1)} || ' mm; Best axes: ' || {sql_fmt('ex', 1)} || ' / ' || {sql_fmt('ey', 1)} || ' / ' || {sql_fmt('ez', 1)} || ' mm' AS facts, 'fused from ' || n_used || ' series; about ' || {sql_fmt('gap', 1)} || ' mm between real slices; irregular gaps' AS warnings FROM ef WHERE strategy = 'fusion'")
def fused_quality(spark, d):
    s = A.plan_series(spark, d)
    main = s.select("study").distinct().withColumn("warnings", F.array(F.lit("thick slices"), F.lit("few slices"), F.lit("irregular gaps")))
    return Q.fused(P.effective(s, P.plan(s)), main).select("study", "score", "level", Q.listed(F.col("facts")).alias("facts"), F.concat_ws("; ", "warnings").alias("warnings"))


_NORMAL = "degrees(acos(least(1.0::DOUBLE, greatest(abs(nx), abs(ny), abs(nz)))))"
_CBCT = f"regexp_matches(lower(coalesce(maker, '')), '{Q.CBCT}')"


@query(f"""WITH {S} SELECT id, syntax IN ({", ".join(f"'{x}'" for x in Q.LOSSY)}) AS lossy, {_CBCT} AS cbct, round({_NORMAL}, 4) AS oblique, concat_ws('; ', CASE WHEN id % 5 > 2 THEN id % 5 || ' duplicate slice(s) ignored' END, CASE WHEN {_NORMAL} > 2 THEN 'slices tilted by ' || {sql_fmt(_NORMAL, 1)} || ' degrees' END, CASE WHEN {_CBCT} THEN 'cone beam: densities are not calibrated' END,
CASE WHEN id % 8 = 0 THEN 'multi-frame: places estimated from the header' END, CASE WHEN modality <> '' AND NOT regexp_matches(upper(modality), '{Q.EXPECTED}') THEN 'modality ' || modality || ' is not expected' END) AS remarks,
'Slices: ' || frames || '; Matrix: ' || rows_ || ' x ' || rows_ || '; Pixel: ' || {sql_fmt("px0", 3)} || ' x ' || {sql_fmt("coalesce(px1, 1.0)", 3)} || ' mm; Between slices: ' || {sql_fmt("coalesce(spacing, 5.0)")} || ' mm; Anisotropy: ' || {sql_fmt("coalesce(spacing, 5.0) / least(px0, coalesce(px1, 1.0))", 1)} || 'x; Coverage: ' || {sql_fmt("(frames - 1) * coalesce(spacing, 5.0)", 0)} || ' mm' AS facts FROM s""")
def series_checks(spark, d):
    s = A.plan_series(spark, d)
    oblique = B.obliquity(*(F.col(c) for c in ("nx", "ny", "nz")))
    sx, sy, sz = F.col("px0"), F.coalesce("px1", F.lit(1.0)), F.coalesce("spacing", F.lit(5.0))
    remarks = Q.remarks(F.when(F.col("id") % 5 > 2, F.col("id") % 5).otherwise(0), oblique, F.col("maker"), F.col("id") % 8 == 0, F.col("modality"))
    return s.select("id", Q.is_lossy(F.col("syntax")).alias("lossy"), Q.is_cbct(F.col("maker")).alias("cbct"), F.round(oblique, 4).alias("oblique"), F.concat_ws("; ", remarks).alias("remarks"), Q.listed(Q.facts(F.col("rows_"), F.col("rows_"), F.col("frames"), sx, sy, sz)).alias("facts"))


_T = "CASE WHEN id % 3 = 0 AND NOT cb THEN greatest(350, su) ELSE su END"


@query(f"""WITH {S}, b AS (SELECT id, 150 + id % 40 * 10 AS su, {_CBCT} AS cb, id % 6 = 5 AS fu, px0 AS sx, coalesce(spacing, 5.0::DOUBLE) AS sz FROM s)
SELECT id, {_T} AS threshold, least(-200, {_T} - 500) AS lowest, greatest(1500, {_T} + 1500) AS highest, CASE WHEN fu THEN 0.7::DOUBLE WHEN sz > 3 THEN 0.8::DOUBLE WHEN sz > 1.25 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS smoothing, CASE WHEN sz > 2 THEN 'shape' ELSE 'cubic' END AS interpolation,
round(CASE WHEN sz <= 1 THEN sz ELSE greatest(greatest(0.5::DOUBLE, least(1.0::DOUBLE, sx * 2)), least(1.6::DOUBLE, sz / 3.5::DOUBLE)) END, 6) AS target,
CASE WHEN id % 3 = 0 THEN 'With contrast: enhanced vessels show in red.' ELSE 'No contrast found: vessels and muscles have the same density.' END || ' Nerves do not show in a CT; trace the canal in the panoramic view.' || CASE WHEN cb THEN ' Cone beam: ranges of soft tissue are not reliable.' ELSE '' END AS note FROM b""")
def recon_defaults(spark, d):
    k, cbct = F.col("id"), Q.is_cbct(F.col("maker"))
    c = Q.defaults((150 + k % 40 * 10), k % 3 == 0, cbct, k % 6 == 5, F.col("px0"), F.coalesce("spacing", F.lit(5.0)))
    c["target"] = F.round(c["target"], 6)
    return A.plan_series(spark, d).select("id", *(e.alias(n) for n, e in c.items()), Q.tissue_note(k % 3 == 0, cbct).alias("note"))


#: slices of a stack for each supplier, in the order of their line items
L = """sl AS (SELECT l_suppkey AS series, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate, l_quantity) AS nr, CASE WHEN l_linenumber % 5 = 0 THEN 256 ELSE 512 END AS rows_, 512 AS cols, CASE WHEN l_suppkey % 9 = 0 AND l_linenumber = 3 THEN NULL ELSE l_suppkey % 7 * 3.0::DOUBLE END AS px, l_suppkey % 5 * 2.0::DOUBLE AS py,
date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 0.5::DOUBLE AS pz, CASE l_suppkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS cy, CASE l_suppkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS cz, l_linenumber AS instance, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 2.5::DOUBLE END AS thickness FROM lineitem)"""


@query(f"""WITH {L}, f AS (SELECT series, rows_ AS r0, cols AS c0, thickness AS t0 FROM sl WHERE nr = 1), k AS (SELECT sl.*, coalesce(t0, 1.0::DOUBLE) AS t0 FROM sl JOIN f USING (series) WHERE rows_ = r0 AND cols = c0),
h AS (SELECT series, bool_and(px IS NOT NULL) AS placed, count(*) AS kept FROM k GROUP BY series), z AS (SELECT series, placed, kept, CASE WHEN placed THEN py * -cz + pz * cy ELSE instance * t0 END AS z, t0 FROM k JOIN h USING (series)), q AS (SELECT DISTINCT series, placed, kept, t0, round(z, 9) AS z FROM z),
g AS (SELECT *, z - lag(z) OVER (PARTITION BY series ORDER BY z) AS gap FROM q) SELECT series, any_value(placed) AS placed, any_value(kept) AS kept, count(*) AS slices, any_value(kept) - count(*) AS duplicates, round(coalesce(median(gap), any_value(t0)), 6) AS spacing, round(min(gap), 6) AS least, round(max(gap), 6) AS most, coalesce(max(gap) > 1.15::DOUBLE * median(gap) OR min(gap) < 0.85::DOUBLE * median(gap), false) AS irregular FROM g GROUP BY series""")
def assembled_stacks(spark, d):
    g = B.assemble(A.slices(spark, d))
    return g.select("series", "placed", "kept", "slices", "duplicates", *(F.round(c, 6).alias(c) for c in ("spacing", "least", "most")), "irregular")


@query(f"""WITH {L}, n AS (SELECT series, count(*) AS images, sum(instance) AS frames FROM sl GROUP BY series), o AS (SELECT series, nr, row_number() OVER (PARTITION BY series ORDER BY instance, nr) AS r FROM sl), f AS (SELECT series, rows_ AS r0, cols AS c0, cy AS fy, cz AS fz FROM sl WHERE nr = 1),
b AS (SELECT series, px + u * 512 * 0.5::DOUBLE AS x, py + fy * w * r0 * 0.5::DOUBLE AS y, pz + fz * w * r0 * 0.5::DOUBLE AS z FROM sl JOIN f USING (series), (VALUES (0), (1)) t1(u), (VALUES (0), (1)) t2(w) WHERE px IS NOT NULL)
SELECT n.series, images, frames, o.nr AS middle, round(min(x), 4) AS x0, round(max(x), 4) AS x1, round(min(y), 4) AS y0, round(max(y), 4) AS y1, round(min(z), 4) AS z0, round(max(z), 4) AS z1, round(-any_value(fz), 6) AS ny, round(any_value(fy), 6) AS nz FROM n JOIN o ON o.series = n.series AND o.r = n.images // 2 + 1 JOIN b ON b.series = n.series JOIN f ON f.series = n.series GROUP BY ALL""")
def series_summary(spark, d):
    s = B.summarize(A.slices(spark, d))
    return s.select("series", "images", "frames", "middle", *(F.round(c, 4).alias(c) for c in ("x0", "x1", "y0", "y1", "z0", "z1")), F.round("ny", 6).alias("ny"), F.round("nz", 6).alias("nz"))


_HIDE = "c_custkey % 2 = 0"
_NAME = "trim(replace(replace(c_name, '#', '^'), '^', ' '))"


@query(f"""SELECT c_custkey AS id, CASE WHEN {_HIDE} THEN '•••' ELSE coalesce(nullif({_NAME}, ''), '—') END AS patient, CASE WHEN {_HIDE} THEN '•••' ELSE c_custkey::VARCHAR END AS patient_id, strftime(DATE '2020-01-01' + CAST(c_custkey % 900 AS INT), '%d/%m/%Y') AS study_date,
CASE WHEN {_HIDE} THEN '' ELSE regexp_replace({_NAME}, '\\s+', '_', 'g') || '-' END || 'reconstrucao-ossea' AS file, 'Modality: CT; Device: ' || c_mktsegment || ' M' || c_nationkey || '; Quality: ' || {_LEVEL.format("c_custkey % 100")} || '; Threshold: ' || (200 + c_custkey % 5 * 50) || ' HU' AS summary FROM customer""")
def study_card(spark, d):
    c = A.table(spark, d, "customer")
    k = F.col("c_custkey")
    info = W.study_info(F.replace("c_name", F.lit("#"), F.lit("^")), k.cast("string"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int")), "yyyyMMdd"))
    c = c.select(k.alias("id"), "c_mktsegment", "c_nationkey", *(e.alias(n) for n, e in info.items()))
    hide, k = F.col("id") % 2 == 0, F.col("id")
    summary = W.technical_summary(F.lit(""), F.concat(F.col("c_mktsegment"), F.lit(" M"), F.col("c_nationkey").cast("string")), F.array().cast("array<string>"), Q.level(k % 100), F.array().cast("array<string>"), 200 + k % 5 * 50)
    return c.select("id", W.masked(F.col("patient"), hide).alias("patient"), W.masked(F.col("patient_id"), hide).alias("patient_id"), "study_date", U.base_name(F.col("patient"), hide).alias("file"), F.concat_ws("; ", summary).alias("summary"))


_TEXT = "'**bold ' || doc_id || '** and *em ' || lang || '* `code x` __strong d__ 2 * 3 * ' || text"
_SPAN = "'\\*\\*.+?\\*\\*|__.+?__|\\*\\S.*?\\*|`[^`]+`'"


@query(f"""WITH d AS (SELECT doc_id AS id, unnest(regexp_extract_all({_TEXT}, {_SPAN})) AS m, generate_subscripts(regexp_extract_all({_TEXT}, {_SPAN}), 1) - 1 AS n FROM documents), k AS (SELECT *, CASE WHEN m LIKE '`%' THEN 'code' WHEN regexp_matches(m, '^(\\*\\*.+\\*\\*|__.+__)$') THEN 'strong' ELSE 'em' END AS kind FROM d)
SELECT id, CAST(n AS INT) AS n, kind, CASE kind WHEN 'strong' THEN substr(m, 3, length(m) - 4) ELSE substr(m, 2, length(m) - 2) END AS content FROM k""")
def markdown_spans(spark, d):
    t = F.concat(F.lit("**bold "), F.col("doc_id").cast("string"), F.lit("** and *em "), F.col("lang"), F.lit("* `code x` __strong d__ 2 * 3 * "), F.col("text"))
    return U.markdown_spans(A.table(spark, d, "documents").select("doc_id", t.alias("t")), "doc_id", "t")


@query(f"WITH {S} SELECT study, 'Images sent, in order:' || chr(10) || string_agg('Image ' || n || ': ' || description, chr(10) ORDER BY n) || chr(10) || chr(10) || 'Technical data:' || chr(10) || 'CT' || chr(10) || chr(10) || 'Question:' || chr(10) || '(none: describe the exam)' AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY id) AS n FROM s) GROUP BY study")
def chat_prompt(spark, d):
    s = A.plan_series(spark, d).select("study", F.col("id").alias("at"), F.col("description").alias("label"))
    p = W.images_text(s)
    return p.select("study", W.prompt(F.col("images"), F.lit("CT"), F.lit(None).cast("string"), F.lit(" ")).alias("prompt"))
