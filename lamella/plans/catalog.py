"""The registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import half_up
from ..operators import components as C
from ..operators import enhance as E
from ..operators import findings as N
from ..operators import fusion as G
from ..operators import panoramic as P
from ..operators import reduce as R
from ..operators import resample as Z
from ..operators import rules as U
from ..operators import segment as M
from ..operators import stencil as S
from ..operators import structures as B
from ..operators import surface as T
from ..sources import adapters as A

#: shown classes, of an exam with contrast
TISSUES = U.tissues(200, True)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


VOX = """WITH s AS (SELECT label AS series, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS z, embedding FROM embeddings),
v AS (SELECT series, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, CAST(z AS INT) AS z, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 4000 + 0.5) AS BIGINT) AS hu FROM s, range(64) t(i))"""
STACK = """WITH st AS (SELECT l_suppkey AS series, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 0.5::DOUBLE AS z, l_extendedprice / 10 - 1000 AS value, (l_orderkey, l_linenumber, l_extendedprice) AS nr FROM lineitem),
pl AS (SELECT DISTINCT series, z FROM st), g AS (SELECT series, z, z - lag(z) OVER (PARTITION BY series ORDER BY z) AS gap FROM pl)"""
PIX = """WITH e AS (SELECT vec_id // 64 AS img, vec_id % 64 AS t, embedding FROM embeddings),
f AS (SELECT DISTINCT img, t.t FROM e, range(64) t(t)),
p AS (SELECT img, CAST((t % 8) * 8 + i % 8 AS INT) AS x, CAST((t // 8) * 8 + i // 8 AS INT) AS y, CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (coalesce(CAST(embedding[i + 1] AS DOUBLE), -0.6::DOUBLE) + 0.6::DOUBLE) / 1.2::DOUBLE * 255)) + 0.5::DOUBLE) AS BIGINT) AS v FROM f LEFT JOIN e USING (img, t), range(64) r(i))"""
HEAD = """WITH h AS (SELECT p_partkey AS id, p_brand AS study, p_size * 8 AS frames, CASE WHEN p_partkey % 5 = 0 THEN 96 ELSE 512 END AS rows_,
CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey % 9 + 1) * 0.6::DOUBLE END AS spacing, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey % 4 + 1) * 0.25::DOUBLE END AS in_plane,
CASE WHEN p_partkey % 22 = 0 THEN NULL ELSE (p_partkey % 5 + 1) * 0.8::DOUBLE END AS thickness, p_partkey % 3 AS axis, p_partkey % 7 = 0 AS irregular, p_partkey % 17 <> 0 AS has_positions, p_partkey % 6 = 0 AS lossy, p_partkey % 19 = 0 AS derived FROM part)"""
CLASSES = "c(class, lo, hi, opacity, ord) AS (VALUES " + ", ".join(f"('{c}', {lo}, {hi}, {o}::DOUBLE, {i})" for i, (c, lo, hi, o) in enumerate(TISSUES)) + ")"


def _classes(spark):
    return spark.createDataFrame([(*t, i) for i, t in enumerate(TISSUES)], "class string, lo double, hi double, opacity double, ord int")


@query(f"{VOX} SELECT series, count(*) AS voxels, count(*)::DOUBLE AS volume_mm3, round(avg(hu), 6) AS mean_hu, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM v WHERE hu >= 200 GROUP BY series")
def bone_summary(spark, d):
    return R.bone_summary(A.voxels(spark, d))


@query(f"""{VOX}, w AS (SELECT * FROM v WHERE hu >= -300), ed AS (SELECT series, min(hu) lo, max(hu) hi FROM w GROUP BY series),
b AS (SELECT series, lo, hi, CAST(floor((hu - lo) * 511 / (hi - lo) + 0.5) AS INT) bin FROM w JOIN ed USING (series) WHERE hi > lo), h AS (SELECT series, lo, hi, bin, count(*) n FROM b GROUP BY ALL),
k AS (SELECT *, sum(n) OVER o n0, sum(n * bin) OVER o s0, sum(n) OVER a n_all, sum(n * bin) OVER a s_all FROM h WINDOW o AS (PARTITION BY series ORDER BY bin), a AS (PARTITION BY series)),
bt AS (SELECT series, lo, hi, bin, round(n0::DOUBLE * (n_all - n0)::DOUBLE * (s0 / n0 - (s_all - s0) / (n_all - n0)) * (s0 / n0 - (s_all - s0) / (n_all - n0)), 3) btw FROM k WHERE n_all > n0),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY btw DESC, bin) rn FROM bt)
SELECT ed.series, coalesce(floor(r.lo + r.bin * (r.hi - r.lo) / 511 + 0.5::DOUBLE), 300)::BIGINT AS threshold FROM ed LEFT JOIN r ON r.series = ed.series AND rn = 1""")
def otsu_threshold(spark, d):
    return R.otsu(A.voxels(spark, d))


@query(f"{VOX}, w AS (SELECT series, list_sort(list(hu)) l FROM v WHERE hu > -300 AND hu < 200 GROUP BY series) SELECT a.series, coalesce(l[len(l) // 2 + 1], 0)::BIGINT AS level FROM (SELECT DISTINCT series FROM v) a LEFT JOIN w USING (series)")
def soft_level(spark, d):
    return R.soft_level(A.voxels(spark, d))


@query(f"{VOX}, w AS (SELECT series, list_sort(list(hu)) l FROM v GROUP BY series) SELECT series, l[least(floor(len(l) * 99.9::DOUBLE / 100)::BIGINT, len(l) - 1) + 1] AS p FROM w")
def percentile_999(spark, d):
    return R.percentile(A.voxels(spark, d), 99.9)


@query("""WITH w AS (SELECT user_id, list_sort(list(value)) l FROM events GROUP BY user_id), q AS (SELECT user_id, l[-1] AS top, l[least(floor(len(l) * 50::DOUBLE / 100)::BIGINT, len(l) - 1) + 1] p50, l[least(floor(len(l) * 99.9::DOUBLE / 100)::BIGINT, len(l) - 1) + 1] p999 FROM w)
SELECT user_id, CASE WHEN top - p999 >= 0.15::DOUBLE * (top - p50) THEN round(p999 + 0.6::DOUBLE * (top - p999), 6) END AS seed, CASE WHEN top - p999 >= 0.15::DOUBLE * (top - p50) THEN round(p999, 6) END AS low FROM q""")
def metal_thresholds(spark, d):
    return R.metal_thresholds(A.table(spark, d, "events").where("value is not null"), "value", "user_id")


@query(f"""{VOX}, c AS (SELECT series, z, count(*) FILTER (hu > 700 AND (y * 8 + x) % 2 = 0) n0, count(*) FILTER (hu > 500 AND (y * 8 + x) % 2 = 0) n1, count(*) FILTER (hu > 300 AND (y * 8 + x) % 2 = 0) n2 FROM v GROUP BY ALL),
b AS (SELECT series, max(n0) m0, max(n1) m1, max(n2) m2, arg_max(z, n0 * 100000 - z) z0, arg_max(z, n1 * 100000 - z) z1, arg_max(z, n2 * 100000 - z) z2, (max(z) + 1) // 2 mid FROM c GROUP BY series)
SELECT series, CASE WHEN m0 > 2 THEN z0 WHEN m1 > 2 THEN z1 WHEN m2 > 2 THEN z2 ELSE mid END::BIGINT AS slice FROM b""")
def dental_slice(spark, d):
    return R.dental_slice(A.voxels(spark, d), (700, 500, 300), 2)


@query(f"{VOX}, {CLASSES} SELECT series, class, count(*) AS voxels FROM v JOIN c ON hu >= lo AND hu <= hi GROUP BY ALL")
def tissue_histogram(spark, d):
    return R.tissue_histogram(A.voxels(spark, d), _classes(spark))


@query(f"""WITH u AS (SELECT DISTINCT (CAST(floor(value) AS BIGINT) * 5) AS u FROM events WHERE value IS NOT NULL), {CLASSES},
j AS (SELECT u, class, ord, round(opacity * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (u - lo + 20) / 20), greatest(0.0::DOUBLE, (hi + 20 - u) / 20)), 6) o FROM u LEFT JOIN c ON u > lo - 20 AND u < hi + 20 AND hi > lo),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY o DESC NULLS LAST, ord) rn FROM j) SELECT u, class, coalesce(o, 0.0::DOUBLE) AS opacity FROM r WHERE rn = 1""")
def transfer_table(spark, d):
    levels = A.table(spark, d, "events").where("value is not null").select((F.floor("value") * 5).alias("u")).distinct()
    return U.transfer(levels, _classes(spark))


_POINTS = ", ".join(f"('{v}', '{c}', {u}::DOUBLE, {y}::DOUBLE)" for v, c, u, y in U.control_points(250))


@query(f"""WITH u AS (SELECT DISTINCT (CAST(floor(value) AS BIGINT) * 15 - 1100) AS u FROM events WHERE value IS NOT NULL), p(view, channel, level, value) AS (VALUES {_POINTS}),
b AS (SELECT u, view, channel, max(level) FILTER (level <= u) AS a, min(level) FILTER (level > u) AS b FROM u, p GROUP BY ALL)
SELECT u, b.view, b.channel, round(CASE WHEN a IS NULL THEN q.value WHEN b IS NULL THEN p.value ELSE p.value + (q.value - p.value) * ((u - a) / (b - a)) END, 6) AS value FROM b LEFT JOIN p ON p.view = b.view AND p.channel = b.channel AND p.level = a LEFT JOIN p q ON q.view = b.view AND q.channel = b.channel AND q.level = b""")
def view_transfer(spark, d):
    levels = A.table(spark, d, "events").where("value is not null").select((F.floor("value") * 15 - 1100).alias("u")).distinct()
    points = spark.createDataFrame(U.control_points(250), "view string, channel string, level double, value double")
    return U.interpolated(levels, points).withColumn("value", F.round("value", 6))


@query(f"""{STACK} SELECT a.series, slices, n - slices AS duplicates, median_gap, min_gap, max_gap, max_gap > 1.15::DOUBLE * median_gap OR min_gap < 0.85::DOUBLE * median_gap AS irregular
FROM (SELECT series, count(*) slices, median(gap) median_gap, min(gap) min_gap, max(gap) max_gap FROM g GROUP BY series) a JOIN (SELECT series, count(*) n FROM st GROUP BY series) b USING (series)""")
def stack_geometry(spark, d):
    return Z.stack_geometry(A.stack(spark, d))


@query(f"{STACK}, w AS (SELECT series, list_sort(list(gap)) l FROM g WHERE gap > 0.001 GROUP BY series) SELECT series, l[len(l) // 2 + 1] AS spacing FROM w")
def header_spacing(spark, d):
    return Z.header_spacing(A.stack(spark, d))


@query(f"""{STACK}, one AS (SELECT series, z, arg_min(value, nr) AS value FROM st GROUP BY ALL), geo AS (SELECT series, median(gap) step, min(gap) lo, max(gap) hi, min(z) z0, max(z) z1, coalesce(hi > 1.15::DOUBLE * step OR lo < 0.85::DOUBLE * step, false) AS odd FROM g GROUP BY series),
gr AS (SELECT series, k, step, z0 + k * step AS pos, least(z0 + k * step, z1) z FROM (SELECT *, unnest(range(0, CAST(floor((z1 - z0) / step + 0.5) AS BIGINT) + 1)) AS k FROM geo WHERE odd)),
lo AS (SELECT gr.series, k, step, gr.pos, gr.z, o.z az, o.value av FROM gr ASOF JOIN one o ON gr.series = o.series AND gr.z >= o.z), hi AS (SELECT lo.*, o.z bz, o.value bv, CASE WHEN o.z > az THEN (lo.z - az) / (o.z - az) ELSE 0.0 END AS t FROM lo ASOF JOIN one o ON lo.series = o.series AND lo.z <= o.z)
SELECT series, CAST(k AS INT) AS k, greatest(-32768, least(32767, floor(CASE WHEN t < 0.001::DOUBLE THEN av ELSE av + (bv - av) * t END + 0.5::DOUBLE)))::BIGINT AS value, least(abs(pos - az), abs(pos - bz)) > step * 0.25::DOUBLE AS filled FROM hi
UNION ALL SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY z) - 1 AS INT), greatest(-32768, least(32767, floor(value + 0.5::DOUBLE)))::BIGINT, false FROM one JOIN geo USING (series) WHERE NOT odd""")
def gap_fill(spark, d):
    return Z.fill_gaps(A.stack(spark, d))


@query(f"{VOX} SELECT series, x // 2 AS x, y // 2 AS y, z, CAST(floor(avg(hu) + 0.5) AS BIGINT) AS hu FROM v GROUP BY series, x // 2, y // 2, z")
def block_mean(spark, d):
    return Z.block_mean(A.voxels(spark, d))


_PLANES = f"""{VOX}, k AS (SELECT series, unnest(range(0, CAST(floor(max(z) / 0.4::DOUBLE + 1e-9) AS BIGINT) + 1)) AS k, max(z) AS zmax FROM v GROUP BY series),
q AS (SELECT series, k, zmax, least(zmax, CAST(floor(k * 0.4::DOUBLE + 1e-9) AS INT)) AS z1 FROM k), t AS (SELECT *, greatest(0.0::DOUBLE, k * 0.4::DOUBLE - z1) AS t FROM q),
p AS (SELECT t.series, b.x, b.y, k, t, coalesce(a.hu, b.hu) p0, b.hu p1, coalesce(c.hu, b.hu) p2, coalesce(e.hu, c.hu, b.hu) p3 FROM t JOIN v b ON b.series = t.series AND b.z = z1
LEFT JOIN v a ON a.series = b.series AND a.x = b.x AND a.y = b.y AND a.z = z1 - 1 LEFT JOIN v c ON c.series = b.series AND c.x = b.x AND c.y = b.y AND c.z = z1 + 1 LEFT JOIN v e ON e.series = b.series AND e.x = b.x AND e.y = b.y AND e.z = z1 + 2)"""


@query(f"{_PLANES} SELECT series, x, y, k, CAST(floor(p1 + (p2 - p1) * t + 0.5) AS BIGINT) AS hu FROM p")
def resample_z_linear(spark, d):
    return Z.resample_z(A.voxels(spark, d), 0.4)


@query(f"{_PLANES} SELECT series, x, y, k, CAST(floor(greatest(least(p1, p2), least(greatest(p1, p2), p1 + t * ((p2 - p0) * 0.5::DOUBLE + t * ((p2 - p1) * 3 - (p2 - p0) * 0.5::DOUBLE * 2 - (p3 - p1) * 0.5::DOUBLE + t * ((p2 - p0) * 0.5::DOUBLE + (p3 - p1) * 0.5::DOUBLE - (p2 - p1) * 2))))) + 0.5) AS BIGINT) AS hu FROM p")
def resample_z_cubic(spark, d):
    return Z.resample_z(A.voxels(spark, d), 0.4, method="cubic")


@query(f"{VOX}, m AS (SELECT *, CASE WHEN hu >= 400 THEN 1 ELSE 0 END m FROM v) SELECT a.series, a.x, a.y, a.z, max(b.m) AS m FROM m a JOIN m b ON a.series = b.series AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 GROUP BY ALL")
def dilate_box(spark, d):
    v = A.voxels(spark, d).withColumn("m", (F.col("hu") >= 400).cast("int"))
    return S.dilate(v, {"x": 1, "y": 1, "z": 1}).select("series", "x", "y", "z", "m")


@query(f"{VOX}, m AS (SELECT * FROM v WHERE hu >= 0) SELECT v.series, v.x, v.y, v.z, CAST(count(b.x) = 7 AS INT) AS m FROM v LEFT JOIN m b ON v.series = b.series AND abs(v.x - b.x) + abs(v.y - b.y) + abs(v.z - b.z) <= 1 GROUP BY ALL")
def erode_six(spark, d):
    v = A.voxels(spark, d).withColumn("m", (F.col("hu") >= 0).cast("int"))
    return S.erode6(v).select("series", "x", "y", "z", "m")


def _gauss(axis: str, source: str, target: str) -> str:
    other = [a for a in "xyz" if a != axis]
    key = " AND ".join(f"a.{o} = b.{o}" for o in other)
    return f"""{target} AS (SELECT a.series, a.x, a.y, a.z, sum(b.v * g.w) v FROM {source} a JOIN ext USING (series) CROSS JOIN g JOIN {source} b ON a.series = b.series AND {key}
AND b.{axis} = greatest(0, least(ext.m{axis}, a.{axis} + g.k)) GROUP BY ALL)"""


@query(f"""{VOX}, ext AS (SELECT series, max(x) mx, max(y) my, max(z) mz FROM v GROUP BY series), g0 AS (SELECT k, exp(-k * k / (2 * 0.8::DOUBLE * 0.8::DOUBLE)) w FROM range(-2, 3) r(k)), g AS (SELECT k, w / (SELECT sum(w) FROM g0) w FROM g0),
v0 AS (SELECT series, x, y, z, hu::DOUBLE v FROM v), {_gauss("x", "v0", "vx")}, {_gauss("y", "vx", "vy")}, {_gauss("z", "vy", "vz")} SELECT series, x, y, z, round(v, 4) AS v FROM vz""")
def gaussian_smooth(spark, d):
    v = A.voxels(spark, d).select("series", "x", "y", "z", F.col("hu").cast("double").alias("v"))
    return S.gaussian(v, {"x": 0.8, "y": 0.8, "z": 0.8}, "v").select("series", "x", "y", "z", F.round("v", 4).alias("v"))


_NINE = "JOIN p b ON a.img = b.img JOIN range(-1, 2) dx(i) ON b.x = greatest(0, least(63, a.x + i)) JOIN range(-1, 2) dy(j) ON b.y = greatest(0, least(63, a.y + j))"


@query(f"{PIX} SELECT a.img, a.x, a.y, list_sort(list(b.v))[5] AS v FROM p a {_NINE} GROUP BY ALL")
def median_three(spark, d):
    return S.median3(A.pixels(spark, d)).select("img", "x", "y", "v")


@query(f"{PIX} SELECT a.img, a.x, a.y, round(sum(b.v) / 9.0::DOUBLE, 4) AS v FROM p a {_NINE} GROUP BY ALL")
def box_blur(spark, d):
    return S.box_blur(A.pixels(spark, d), 1).select("img", "x", "y", F.round("v", 4).alias("v"))


@query(f"""{PIX}, q AS (SELECT img, x, y, CAST(v AS INT) bin FROM p), h AS (SELECT img, x // 16 tx, y // 16 ty, bin, count(*) n FROM q GROUP BY ALL),
l AS (SELECT img, tx, ty, bin, sum(least(n::DOUBLE, 2.5::DOUBLE)) OVER (PARTITION BY img, tx, ty ORDER BY bin) cum FROM h), o AS (SELECT img, tx, ty, sum(greatest(n - 2.5::DOUBLE, 0.0::DOUBLE)) / 256 share FROM h GROUP BY ALL),
fp AS (SELECT *, (x + 0.5::DOUBLE) / 16 - 0.5::DOUBLE fx, (y + 0.5::DOUBLE) / 16 - 0.5::DOUBLE fy FROM q), c AS (SELECT fp.*, CAST(floor(fx) AS INT) x0, CAST(floor(fy) AS INT) y0, a, b FROM fp, range(2) r(a), range(2) s(b)),
k AS (SELECT img, x, y, bin, greatest(0, least(3, x0 + a)) tx, greatest(0, least(3, y0 + b)) ty, CASE WHEN a = 1 THEN fx - x0 ELSE 1 - fx + x0 END * CASE WHEN b = 1 THEN fy - y0 ELSE 1 - fy + y0 END w FROM c),
j AS (SELECT k.*, l.cum FROM k ASOF LEFT JOIN l ON k.img = l.img AND k.tx = l.tx AND k.ty = l.ty AND k.bin >= l.bin)
SELECT j.img, x, y, round(sum((coalesce(cum, 0) + share * (bin + 1)) / 256 * 255 * w), 4) AS v FROM j JOIN o USING (img, tx, ty) GROUP BY ALL""")
def clahe(spark, d):
    return E.clahe(A.pixels(spark, d))


@query(f"""{VOX}, m AS (SELECT row_number() OVER () id, * FROM v WHERE hu >= 300), dims AS (SELECT series, max(z) + 1 nz FROM v GROUP BY series)
SELECT series, component, count(*) AS voxels FROM (WITH RECURSIVE r(series, i, c) AS (SELECT series, (z * 8 + y) * 8 + x, (z * 8 + y) * 8 + x FROM m
UNION SELECT b.series, (b.z * 8 + b.y) * 8 + b.x, r.c FROM r JOIN m b ON r.series = b.series AND abs(b.x - r.i % 8) + abs(b.y - r.i // 8 % 8) + abs(b.z - r.i // 64) = 1) SELECT series, i, min(c) AS component FROM r GROUP BY ALL) GROUP BY ALL""")
def components_six(spark, d):
    return C.components6(A.voxels(spark, d), 300)


@query(ORACLE["components_six"].replace("SELECT series, component, count(*) AS voxels FROM (WITH", ", cc AS (SELECT series, component, count(*) AS voxels FROM (WITH") + ") SELECT series, component, voxels FROM cc QUALIFY voxels >= greatest(max(voxels) OVER (PARTITION BY series) * 0.005, 5)")
def keep_large_components(spark, d):
    return C.keep_large(C.components6(A.voxels(spark, d), 300), least=5)


@query(f"""{VOX}, n AS (SELECT a.series, a.z, a.x, a.y, a.hu >= 0 AS inside, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d2, count(b.x) k FROM v a LEFT JOIN v b ON a.series = b.series AND a.z = b.z AND (a.hu >= 0) <> (b.hu >= 0) GROUP BY ALL)
SELECT series, z, x, y, round(CASE WHEN k = 0 THEN CASE WHEN inside THEN 40.0 ELSE -0.5 END WHEN inside THEN sqrt(d2) - 0.5 ELSE 0.5 - sqrt(d2) END::DOUBLE, 6) AS d FROM n""")
def signed_distance(spark, d):
    return C.signed_distance(A.voxels(spark, d))


_MIRROR = "SELECT m.series, m.part, count(*) AS voxels, count(*) FILTER (m.x < 4) AS low_side, round(avg(CASE WHEN o.x IS NULL THEN 0 ELSE 1 END), 6) AS overlap FROM m LEFT JOIN m o ON m.series = o.series AND m.y = o.y AND m.z = o.z AND o.x = 7 - m.x GROUP BY ALL"


@query(f"{VOX}, m AS (SELECT *, 0 AS part FROM v WHERE hu >= 200) {_MIRROR}")
def mirror_symmetry(spark, d):
    return U.mirror_symmetry(A.voxels(spark, d))


_Q = "coalesce(spacing, 5.0)"


@query(f"""{HEAD}, s AS (SELECT *, greatest(0, 100 - CASE WHEN {_Q} > 3 THEN 45 WHEN {_Q} > 1.25 THEN 20 ELSE 0 END - CASE WHEN frames < 40 THEN 15 ELSE 0 END - CASE WHEN coalesce(in_plane, 1.0) > 0.8 THEN 10 ELSE 0 END - 10 * irregular::INT - 10 * (NOT has_positions)::INT - 5 * lossy::INT - 5 * derived::INT) AS score FROM h)
SELECT id, CAST(score AS INT) AS score, CASE WHEN score >= 75 THEN 'good' WHEN score >= 45 THEN 'moderate' ELSE 'limited' END AS level, concat_ws('; ', CASE WHEN {_Q} > 3 THEN 'thick slices' END, CASE WHEN {_Q} > 1.25 AND {_Q} <= 3 THEN 'moderate slices' END, CASE WHEN frames < 40 THEN 'few slices' END, CASE WHEN coalesce(in_plane, 1.0) > 0.8 THEN 'coarse pixels' END, CASE WHEN irregular THEN 'irregular gaps' END, CASE WHEN NOT has_positions THEN 'no positions' END, CASE WHEN lossy THEN 'lossy' END, CASE WHEN derived THEN 'derived' END) AS warnings FROM s""")
def quality_score(spark, d):
    return U.quality(A.series_headers(spark, d))


@query(f"{HEAD}, r AS (SELECT study, id, round(CASE WHEN frames < 3 OR rows_ < 128 THEN -1.0::DOUBLE ELSE frames / greatest(0.3::DOUBLE, coalesce(spacing, thickness, 5.0::DOUBLE)) END, 6) AS rank FROM h) SELECT study, id, rank FROM r QUALIFY row_number() OVER (PARTITION BY study ORDER BY rank DESC, id) = 1")
def best_series(spark, d):
    return U.best_series(A.series_headers(spark, d))


@query("""WITH t AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'iohexol' ELSE '' END AS agent, list_extract(['CT com  contraste ', 'sem contraste angio ', 'contrast ', 'C / C ', 'C+ ', 'S/C c/c ', 'angio', 'pos-contraste ', ''], CAST(turn % 9 + 1 AS INT)) || text AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN agent <> '' AND agent <> 'none' THEN true ELSE regexp_matches(lower(coalesce(t, '')), '\\bc\\s*/\\s*c\\b|com\\s+contraste|\\bcontraste\\b|\\bc\\+|\\bpos[- ]?contraste|\\bangio') AND NOT regexp_matches(lower(coalesce(t, '')), 'sem\\s+contraste|\\bs\\s*/\\s*c\\b') END AS contrast FROM t""")
def contrast_flag(spark, d):
    c = A.table(spark, d, "conversations")
    agent = F.when(F.col("conv_id") % 4 == 0, "none").when(F.col("conv_id") % 4 == 1, "iohexol").otherwise("")
    said = F.array(*map(F.lit, ("CT com  contraste ", "sem contraste angio ", "contrast ", "C / C ", "C+ ", "S/C c/c ", "angio", "pos-contraste ", "")))
    text = F.concat(F.element_at(said, (F.col("turn") % 9 + 1).cast("int")), F.col("text"))
    return c.select("conv_id", "turn", U.contrast_flag(agent, text).alias("contrast"))


_NAME = "regexp_extract(url, '([^/?#]*)([?#].*)?$', 1)"


@query(f"SELECT page_id, {_NAME} AS name, NOT regexp_matches(lower({_NAME}), '\\.(txt|xml|htm|html|pdf|exe|ini|inf|jpg|jpeg|png|db)$') AND {_NAME} <> 'DICOMDIR' AS readable FROM pages")
def file_filter(spark, d):
    name = F.regexp_extract("url", "([^/?#]*)([?#].*)?$", 1)
    return A.table(spark, d, "pages").select("page_id", name.alias("name"), U.readable(name).alias("readable"))


@query("SELECT doc_id, lower(regexp_replace(strip_accents(text), '[^A-Za-z0-9]+', '-', 'g')) AS slug FROM documents")
def slug_title(spark, d):
    return A.table(spark, d, "documents").select("doc_id", U.slug(F.col("text")).alias("slug"))


@query("""WITH d AS (SELECT doc_id AS id, '# Title' || chr(10) || '###  Sub' || chr(10) || '___' || chr(10) || '  • a' || chr(13) || chr(10) || '- b' || chr(10) || chr(10) || '1. x' || chr(10) || '---' || chr(10) || text AS t FROM documents), s AS (SELECT id, string_split(t, chr(10)) l FROM d),
n AS (SELECT id, i AS n, regexp_replace(replace(l[i + 1], chr(13), ''), '\\s+$', '') AS line FROM (SELECT *, unnest(range(len(l))) AS i FROM s)),
k AS (SELECT id, n, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^\\s*(-{3,}|\\*{3,}|_{3,})$') THEN 'hr' WHEN regexp_matches(line, '^#{1,2}\\s+') THEN 'h3' WHEN regexp_matches(line, '^#{3,4}\\s+') THEN 'h4' WHEN regexp_matches(line, '^\\s*[-*•]\\s+\\S') THEN 'ul' WHEN regexp_matches(line, '^\\s*[0-9]+[.)]\\s+\\S') THEN 'ol' ELSE 'p' END AS kind FROM n),
w AS (SELECT *, CASE WHEN kind <> coalesce(lag(kind) OVER (PARTITION BY id ORDER BY n), '') OR kind NOT IN ('ul', 'ol', 'p', 'blank') THEN 1 ELSE 0 END new FROM k), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY id ORDER BY n) AS BIGINT) block FROM w)
SELECT id, block, kind, count(*) AS lines FROM b WHERE kind <> 'blank' GROUP BY ALL""")
def markdown_blocks(spark, d):
    t = A.table(spark, d, "documents").select("doc_id", F.concat(F.lit("# Title\n###  Sub\n___\n  • a\r\n- b\n\n1. x\n---\n"), F.col("text")).alias("t"))
    return U.markdown_blocks(t, "doc_id", "t")


@query(f"""{VOX}, a AS (SELECT * FROM v WHERE hu < -200) SELECT series, z, x, y FROM a ANTI JOIN (WITH RECURSIVE r(series, z, x, y) AS (SELECT series, z, x, y FROM a WHERE x IN (0, 7) OR y IN (0, 7)
UNION SELECT b.series, b.z, b.x, b.y FROM r JOIN a b ON r.series = b.series AND r.z = b.z AND abs(b.x - r.x) + abs(b.y - r.y) = 1) SELECT * FROM r) o USING (series, z, x, y)""")
def enclosed_air(spark, d):
    return M.airways(A.voxels(spark, d), -200)


@query(f"{VOX} SELECT v.series, v.x, v.y, v.z, v.hu FROM v ANTI JOIN (SELECT * FROM v WHERE hu >= 700) b ON b.series = v.series AND abs(b.x - v.x) + abs(b.y - v.y) + abs(b.z - v.z) <= 2 WHERE v.hu >= 150 AND v.hu < 500")
def vessels(spark, d):
    return M.vessels(A.voxels(spark, d))


_STEP = "SELECT * FROM {0} UNION SELECT b.* FROM {0} a JOIN m b ON a.series = b.series AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1"


@query(f"""{VOX}, m AS (SELECT series, x, y, z, (z * 8 + y) * 8 + x AS i, hu FROM v WHERE hu >= 700), g0 AS (SELECT * FROM m WHERE hu >= 1300), g1 AS ({_STEP.format("g0")}), g AS ({_STEP.format("g1")}),
n AS (SELECT a.series, a.i, b.i AS j FROM g a JOIN g b ON a.series = b.series AND greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) <= 1),
c AS (SELECT series, j AS i, min(c) AS c FROM (WITH RECURSIVE r(series, c, j) AS (SELECT series, i, j FROM n UNION SELECT r.series, r.c, n.j FROM r JOIN n ON r.series = n.series AND r.j = n.i) SELECT * FROM r) GROUP BY ALL)
SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY c) AS INT) AS object, count(*)::DOUBLE AS volume, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(avg(z), 4) AS cz FROM c JOIN g USING (series, i) GROUP BY series, c HAVING count(*) >= 2""")
def metal_pieces(spark, d):
    return M.metal_objects(A.voxels(spark, d), 1300, 700).select("series", "object", "volume", *(F.round(c, 4).alias(c) for c in ("cx", "cy", "cz")))


@query(f"""{VOX}, mp AS (SELECT series, series // 2 AS study, max(z) + 1 AS nz FROM v GROUP BY series),
p AS (SELECT study, x, y, z, mp.series, nz, CASE WHEN mp.series % 2 = 0 THEN x ELSE 0.75::DOUBLE * y + 0.5 END AS u, CASE WHEN mp.series % 2 = 0 THEN y ELSE 0.75::DOUBLE * x + 0.25 END AS w1, CASE WHEN mp.series % 2 = 0 THEN z ELSE 0.8::DOUBLE * z + 0.3 END::DOUBLE AS w
FROM (SELECT series // 2 AS study, x, y, z FROM v WHERE series % 2 = 0) g JOIN mp USING (study)),
q AS (SELECT * REPLACE (greatest(0.0::DOUBLE, least(w, nz - 1.0::DOUBLE)) AS w) FROM p WHERE w <= nz - 0.5::DOUBLE),
r AS (SELECT *, 0.02::DOUBLE + exp(-pow(abs(w - floor(w + 0.5::DOUBLE)) * CASE WHEN series % 2 = 0 THEN 1 ELSE 1.25::DOUBLE END / 1.5::DOUBLE, 2)) AS k FROM q),
c AS (SELECT r.*, a, b, e, k * abs(1 - a - (u - floor(u))) * abs(1 - b - (w1 - floor(w1))) * abs(1 - e - (w - floor(w))) AS f FROM r, range(2) t1(a), range(2) t2(b), range(2) t3(e))
SELECT study, c.x, c.y, c.z, greatest(-32768, least(32767, floor(round(sum(f * hu) / sum(f), 9) + 0.5::DOUBLE)))::SMALLINT AS value FROM c JOIN v ON v.series = c.series AND v.x = floor(u) + a AND v.y = floor(w1) + b AND v.z = floor(w) + e WHERE f > 0 GROUP BY ALL""")
def fuse_stacks(spark, d):
    v = A.voxels(spark, d).withColumn("study", F.floor(F.col("series") / 2).cast("int"))
    even, same, turned = F.col("series") % 2 == 0, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0], [0, 0.75, 0, 0.5, 0.75, 0, 0, 0.25, 0, 0, 0.8, 0.3]
    maps = v.groupBy("study", "series").agg(F.lit(8).alias("nx"), F.lit(8).alias("ny"), (F.max("z") + 1).alias("nz"))
    numbers = [F.array(*(F.lit(float(n)) for n in m)) for m in (same, turned)]
    maps = maps.withColumns({"sz": F.when(even, 1.0).otherwise(1.25), "sigma": F.lit(1.5), "m": F.when(even, numbers[0]).otherwise(numbers[1])})
    grids = v.where(even).groupBy("study").agg(F.lit(8).alias("gx"), F.lit(8).alias("gy"), (F.max("z") + 1).cast("int").alias("gz"))
    return G.fuse(grids, maps, v.drop("study"))


_TETS = ", ".join(f"({n}, {k})" for n, t in enumerate(T.TETRAHEDRA) for k in t)


@query(f"""{VOX}, c AS (SELECT series, x - k % 2 AS cx, y - k // 2 % 2 AS cy, z - k // 4 AS cz, k, (hu - 200)::DOUBLE AS f FROM v, range(8) t(k)),
w AS (SELECT series, cx, cy, cz FROM c GROUP BY ALL HAVING count(*) = 8), p AS (SELECT *, {{'x': (k % 2)::DOUBLE, 'y': (k // 2 % 2)::DOUBLE, 'z': (k // 4)::DOUBLE, 'f': f}} AS p FROM c JOIN w USING (series, cx, cy, cz) JOIN (VALUES {_TETS}) tt(t, k) USING (k)),
g AS (SELECT series, list(p ORDER BY k) FILTER (f > 0) AS i, list(p ORDER BY k) FILTER (f <= 0) AS o FROM p GROUP BY series, cx, cy, cz, t HAVING max(f) > 0 AND min(f) <= 0),
e AS (SELECT series, i, o, unnest(CASE len(i) WHEN 1 THEN [[[1, 1], [1, 2], [1, 3]]] WHEN 3 THEN [[[1, 1], [2, 1], [3, 1]]] ELSE [[[1, 1], [1, 2], [2, 2]], [[1, 1], [2, 2], [2, 1]]] END) AS e FROM g),
tr AS (SELECT series, list_transform(e, lambda q: list_transform(['x', 'y', 'z'], lambda n: CASE n WHEN 'x' THEN i[q[1]].x + (o[q[2]].x - i[q[1]].x) * i[q[1]].f / (i[q[1]].f - o[q[2]].f) WHEN 'y' THEN i[q[1]].y + (o[q[2]].y - i[q[1]].y) * i[q[1]].f / (i[q[1]].f - o[q[2]].f)
ELSE i[q[1]].z + (o[q[2]].z - i[q[1]].z) * i[q[1]].f / (i[q[1]].f - o[q[2]].f) END)) AS t FROM e),
n AS (SELECT series, t[2][1] - t[1][1] a, t[2][2] - t[1][2] b, t[2][3] - t[1][3] c, t[3][1] - t[1][1] d, t[3][2] - t[1][2] e, t[3][3] - t[1][3] f FROM tr)
SELECT series, count(*) AS triangles, round(sum(sqrt(pow(b * f - c * e, 2) + pow(c * d - a * f, 2) + pow(a * e - b * d, 2)) / 2), 3) AS area FROM n GROUP BY series""")
def surface_area(spark, d):
    return T.area(T.triangles(A.voxels(spark, d), 200)).withColumn("area", F.round("area", 3))


@query("""WITH p AS (SELECT label AS series, vec_id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z FROM embeddings),
q AS (SELECT *, lag(x) OVER o ax, lag(y) OVER o ay, lag(z) OVER o az, lead(x) OVER o cx, lead(y) OVER o cy, lead(z) OVER o cz FROM p WINDOW o AS (PARTITION BY series ORDER BY vec_id)),
r AS (SELECT series, vec_id, sqrt(pow(ax - x, 2) + pow(ay - y, 2) + pow(az - z, 2)) ab, sqrt(pow(cx - x, 2) + pow(cy - y, 2) + pow(cz - z, 2)) bc, (ax - x) * (cx - x) + (ay - y) * (cy - y) + (az - z) * (cz - z) d FROM q WHERE ax IS NOT NULL AND cx IS NOT NULL)
SELECT series, vec_id, round(ab, 5) AS before, round(bc, 5) AS after, CASE WHEN ab * bc > 0 THEN round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, d / (ab * bc))))), 4) END AS angle FROM r""")
def landmark_angles(spark, d):
    p = A.table(spark, d, "embeddings").select(F.col("label").alias("series"), "vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    return U.landmark_angles(p)


_CONTROL = """WITH c0 AS (SELECT label AS series, n, CASE n WHEN 0 THEN 0.6::DOUBLE WHEN 1 THEN 1.7::DOUBLE WHEN 2 THEN 4.9::DOUBLE ELSE 6.3::DOUBLE END AS px, CASE n WHEN 0 THEN 6.1::DOUBLE WHEN 1 THEN 2.2::DOUBLE + (label % 3) * 0.3::DOUBLE WHEN 2 THEN 1.9::DOUBLE ELSE 5.7::DOUBLE END AS py FROM (SELECT DISTINCT label FROM embeddings), range(4) t(n)),
c1 AS (SELECT *, lead(px) OVER o AS bx, lead(py) OVER o AS by_, lag(px) OVER o AS ax, lag(py) OVER o AS ay, lead(px, 2) OVER o AS dx, lead(py, 2) OVER o AS dy FROM c0 WINDOW o AS (PARTITION BY series ORDER BY n)),
c2 AS (SELECT series, n, px, py, bx, by_, coalesce(ax, px) AS ax, coalesce(ay, py) AS ay, coalesce(dx, bx) AS dx, coalesce(dy, by_) AS dy, CASE WHEN bx IS NULL THEN 1 ELSE greatest(2, ceil(sqrt(pow(bx - px, 2) + pow(by_ - py, 2)) * 4)) END::BIGINT AS parts FROM c1),
c3 AS (SELECT *, k::DOUBLE / parts AS t FROM (SELECT *, unnest(range(parts)) AS k FROM c2)),
c4 AS (SELECT series, n, k, CASE WHEN k = 0 THEN px ELSE px + (bx - ax + (ax * 2 - px * 5 + bx * 4 - dx + (px * 3 - ax - bx * 3 + dx) * t) * t) * t * 0.5::DOUBLE END AS x, CASE WHEN k = 0 THEN py ELSE py + (by_ - ay + (ay * 2 - py * 5 + by_ * 4 - dy + (py * 3 - ay - by_ * 3 + dy) * t) * t) * t * 0.5::DOUBLE END AS y FROM c3),
c5 AS (SELECT *, coalesce(sqrt(pow(qx - x, 2) + pow(qy - y, 2)), 0) AS mm FROM (SELECT *, lead(x) OVER (PARTITION BY series ORDER BY n, k) AS qx, lead(y) OVER (PARTITION BY series ORDER BY n, k) AS qy FROM c4)),
c6 AS (SELECT *, round(sum(mm) OVER (PARTITION BY series ORDER BY n, k), 9) AS e, round(sum(mm) OVER (PARTITION BY series), 9) AS len FROM c5),
c7 AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY series ORDER BY n, k), 0) AS s FROM c6),
c8 AS (SELECT series, col, x + (qx - x) * (col - s) / (e - s) AS px, y + (qy - y) * (col - s) / (e - s) AS py FROM c7, range(64) r(col) WHERE len >= 1 AND e > s AND col >= s AND (col < e OR e = len AND col <= e)),
c9 AS (SELECT *, coalesce(lead(px) OVER o, px) - coalesce(lag(px) OVER o, px) AS tx, coalesce(lead(py) OVER o, py) - coalesce(lag(py) OVER o, py) AS ty, avg(px) OVER (PARTITION BY series) AS mx, avg(py) OVER (PARTITION BY series) AS my FROM c8 WINDOW o AS (PARTITION BY series ORDER BY col)),
arch AS (SELECT series, CAST(col AS INT) AS col, px, py, -ty / sqrt(tx * tx + ty * ty) * f AS ox, tx / sqrt(tx * tx + ty * ty) * f AS oy FROM (SELECT *, CASE WHEN -ty * (px - mx) + tx * (py - my) < 0 THEN -1 ELSE 1 END AS f FROM c9))"""
_READ = """dims AS (SELECT series, max(z) + 1 AS nz FROM v GROUP BY series), rz AS (SELECT series, nz, i AS row, nz - 1 - CASE WHEN h > 1 THEN round(i::DOUBLE / (h - 1) * (nz - 1), 9) ELSE 0.0 END AS w FROM (SELECT *, unnest(range(h)) AS i FROM (SELECT *, greatest(1, floor((nz - 1) * 1.5::DOUBLE + 0.5::DOUBLE) + 1)::BIGINT AS h FROM dims))),
p AS (SELECT * FROM pl JOIN rz USING (series)), c AS (SELECT p.*, CAST(floor(u) + a AS INT) AS xi, CAST(floor(w1) + b AS INT) AS yi, CAST(floor(w) + e AS INT) AS zi, abs(1 - a - (u - floor(u))) * abs(1 - b - (w1 - floor(w1))) * abs(1 - e - (w - floor(w))) AS f FROM p, range(2) t1(a), range(2) t2(b), range(2) t3(e) WHERE least(u, w1, w) >= 0 AND u <= 7 AND w1 <= 7 AND w <= nz - 1),
g AS (SELECT c.series, row, q, o, sum(f * hu) AS value FROM c JOIN v ON v.series = c.series AND v.x = xi AND v.y = yi AND v.z = zi WHERE f > 0 GROUP BY ALL UNION ALL SELECT series, row, q, o, -1024.0::DOUBLE FROM p WHERE NOT (least(u, w1, w) >= 0 AND u <= 7 AND w1 <= 7 AND w <= nz - 1))"""
_VOX = VOX.removeprefix("WITH ")
_PANO = f"{_CONTROL}, {_VOX}, pl AS (SELECT series, col AS q, o, round(px + ox * o, 9) AS u, round(py + oy * o, 9) AS w1 FROM arch, (VALUES (-1.5::DOUBLE), (-0.5::DOUBLE), (0.5::DOUBLE), (1.5::DOUBLE)) t(o)), {_READ}"


def _arch(spark, d):
    """A curve of four control points for each series."""
    s = A.table(spark, d, "embeddings").select(F.col("label").alias("series")).distinct().withColumn("n", F.explode(F.array(*map(F.lit, range(4)))))
    x = F.when(F.col("n") == 0, 0.6).when(F.col("n") == 1, 1.7).when(F.col("n") == 2, 4.9).otherwise(6.3)
    y = F.when(F.col("n") == 0, 6.1).when(F.col("n") == 1, 2.2 + F.col("series") % 3 * 0.3).when(F.col("n") == 2, 1.9).otherwise(5.7)
    return P.arch(s.select("series", "n", x.alias("px"), y.alias("py")))


def _dims(v):
    return v.groupBy("series").agg(F.lit(8).alias("nx"), F.lit(8).alias("ny"), (F.max("z") + 1).alias("nz"))


@query(f"{_CONTROL} SELECT series, col, round(px, 5) AS px, round(py, 5) AS py, round(ox, 5) AS ox, round(oy, 5) AS oy FROM arch")
def arch_curve(spark, d):
    return _arch(spark, d).select("series", "col", *(F.round(c, 5).alias(c) for c in ("px", "py", "ox", "oy")))


@query(f"{_PANO} SELECT series, CAST(row AS INT) AS row, q AS col, round(avg(value), 4) AS value FROM g GROUP BY ALL")
def pano_mean(spark, d):
    v = A.voxels(spark, d)
    return P.panoramic(v, _arch(spark, d), _dims(v), 3.0, "mean", (1.0, 1.0, 1.5)).withColumn("value", F.round("value", 4))


@query(f"{_PANO} SELECT series, CAST(row AS INT) AS row, q AS col, round(max(value), 4) AS value FROM g GROUP BY ALL")
def pano_mip(spark, d):
    v = A.voxels(spark, d)
    return P.panoramic(v, _arch(spark, d), _dims(v), 3.0, "mip", (1.0, 1.0, 1.5)).withColumn("value", F.round("value", 4))


@query(f"{_CONTROL}, {_VOX}, pl AS (SELECT series, CAST(i AS INT) AS q, 0 AS o, round(px + ox * (i - 2.5::DOUBLE), 9) AS u, round(py + oy * (i - 2.5::DOUBLE), 9) AS w1 FROM arch, range(6) t(i) WHERE col = 4), {_READ} SELECT series, CAST(row AS INT) AS row, q AS c, round(value, 4) AS value FROM g")
def cross_section(spark, d):
    v = A.voxels(spark, d)
    return P.cross_section(v, _arch(spark, d), _dims(v), 4, 5.0, (1.0, 1.0, 1.5)).withColumn("value", F.round("value", 4))


@query(f"{_CONTROL}, pt AS (SELECT label AS series, vec_id AS id, round((embedding[1]::DOUBLE + 0.5::DOUBLE) * 7, 3) AS px, round((embedding[2]::DOUBLE + 0.5::DOUBLE) * 7, 3) AS py FROM embeddings), j AS (SELECT pt.series, id, col, round(sqrt(pow(pt.px - a.px, 2) + pow(pt.py - a.py, 2)), 6) AS mm FROM pt JOIN arch a USING (series)) SELECT series, id, col, mm FROM j QUALIFY row_number() OVER (PARTITION BY series, id ORDER BY mm, col) = 1")
def canal_columns(spark, d):
    x, y = (F.round((F.col("embedding")[i].cast("double") + 0.5) * 7, 3) for i in (0, 1))
    return P.nearest_column(A.table(spark, d, "embeddings").select(F.col("label").alias("series"), F.col("vec_id").alias("id"), x.alias("px"), y.alias("py")), _arch(spark, d))


@query(f"""{_CONTROL}, pt AS (SELECT label AS series, vec_id AS id, round((embedding[1]::DOUBLE + 0.5::DOUBLE) * 7, 3) AS px, round((embedding[2]::DOUBLE + 0.5::DOUBLE) * 7, 3) AS py, round((embedding[3]::DOUBLE + 0.5::DOUBLE) * 9, 3) AS pz FROM embeddings),
j AS (SELECT pt.series, id, pt.px, pt.py, pz, col, round(sqrt(pow(pt.px - a.px, 2) + pow(pt.py - a.py, 2)), 6) AS mm FROM pt JOIN arch a USING (series)), k AS (SELECT series, id, col, 1 - py * 0.5::DOUBLE AS x, 2 + px * 0.4::DOUBLE AS y, 3 + pz * 1.5::DOUBLE AS z FROM j QUALIFY row_number() OVER (PARTITION BY series, id ORDER BY mm, col) = 1),
s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM k WINDOW w AS (PARTITION BY series ORDER BY col, id))
SELECT series, row_number() OVER w AS n, id, col, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(coalesce(sum(step) OVER w, 0), 3) AS length FROM s WINDOW w AS (PARTITION BY series ORDER BY col, id)""")
def canal_line(spark, d):
    x, y, z = (F.round((F.col("embedding")[i].cast("double") + 0.5) * n, 3) for i, n in enumerate((7, 7, 9)))
    points = A.table(spark, d, "embeddings").select(F.col("label").alias("series"), F.col("vec_id").alias("id"), x.alias("px"), y.alias("py"), z.alias("pz"))
    c = P.canal_line(points, _arch(spark, d), (0.4, 0.5, 1.5), (1.0, 2.0, 3.0), (0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0))
    return c.select("series", "n", "id", "col", *(F.round(k, 4).alias(k) for k in "xyz"), F.round("length", 3).alias("length"))


_CLAHE8 = ORACLE["clahe"].removeprefix(PIX).removeprefix(", q AS (SELECT img, x, y, CAST(v AS INT) bin FROM p)").replace("x // 16 tx, y // 16 ty", "x // 8 tx, y // 8 ty").replace("2.5::DOUBLE", "1.0::DOUBLE").replace("/ 16 - 0.5", "/ 8 - 0.5").replace("least(3,", "least(7,").replace("/ 256 * 255", "/ 64 * 255")
_CLAHE8, _LAST = _CLAHE8.rsplit("\nSELECT ", 1)


@query(f"""{PIX}, q AS (SELECT a.img, a.x, a.y, CAST(list_sort(list(b.v))[5] AS INT) AS bin FROM p a {_NINE} GROUP BY ALL){_CLAHE8}, cl AS (SELECT {_LAST}),
bl AS (SELECT a.img, a.x, a.y, a.v, sum(b.v) / 25.0::DOUBLE AS u FROM cl a JOIN range(-2, 3) dx(i) ON true JOIN range(-2, 3) dy(j) ON true JOIN cl b ON a.img = b.img AND b.x = greatest(0, least(63, a.x + i)) AND b.y = greatest(0, least(63, a.y + j)) GROUP BY a.img, a.x, a.y, a.v)
SELECT img, x, y, round(255 - greatest(0.0::DOUBLE, least(255.0::DOUBLE, (v + (v - u) * 0.8::DOUBLE - 128) * 1.1::DOUBLE + 128 + 6.4::DOUBLE)) + 1e-9, 3) AS v FROM bl""")
def enhance_image(spark, d):
    return E.enhance(A.pixels(spark, d), brightness=5.0, contrast=10.0, invert=True).withColumn("v", F.round(F.col("v") + 1e-9, 3))  # values are multiples of 1e-8: no ties


LAB = f"{VOX}, lab AS (SELECT series, x, y, z, hu, (z * 8 + y) * 8 + x AS i, CASE WHEN hu >= 900 THEN 3 WHEN hu >= 300 AND y < 4 THEN 2 WHEN hu >= 300 THEN 1 ELSE 0 END AS label FROM v)"
_REFS = """, bo AS (SELECT * FROM lab WHERE label IN (1, 2, 3)), xs AS (SELECT series, list_sort(list(x)) AS l, count(*) AS voxels, min(y) AS front_y, max(y) AS back_y, min(z) AS z_lo, max(z) AS z_hi FROM bo GROUP BY series), zs AS (SELECT series, list_sort(list(z)) AS l FROM bo WHERE label = 3 GROUP BY series),
refs AS (SELECT xs.series, voxels, (xs.l[floor(voxels * 2::DOUBLE / 100)::BIGINT + 1] + xs.l[floor(voxels * 98::DOUBLE / 100)::BIGINT + 1]) / 2::DOUBLE AS mid_x, xs.l[floor(voxels * 98::DOUBLE / 100)::BIGINT + 1] - xs.l[floor(voxels * 2::DOUBLE / 100)::BIGINT + 1] AS width,
CASE WHEN len(zs.l) > 50 THEN zs.l[floor(len(zs.l) * 50::DOUBLE / 100)::BIGINT + 1] END AS bite_z, front_y, back_y, z_lo, z_hi FROM xs LEFT JOIN zs USING (series))"""
#: the same with the bite by every fourth voxel of the teeth
_REFS_4 = _REFS.replace("WHERE label = 3 GROUP", "WHERE label = 3 AND i % 4 = 0 GROUP")


def _joined(mask: str, out: str) -> str:
    """CTEs that number the face-joined components of a table (series, x, y, z, i)."""
    return f""", {out}_n AS (SELECT a.series, a.i, b.i AS j FROM {mask} a JOIN (SELECT *, unnest([0, 1, -1, 8, -8, 64, -64]) AS o FROM {mask}) b ON a.series = b.series AND a.i = b.i + b.o AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1),
{out}_c AS (SELECT series, j AS i, min(c) AS c FROM (WITH RECURSIVE r(series, c, j) AS (SELECT series, i, i FROM {mask} UNION SELECT r.series, r.c, n.j FROM r JOIN {out}_n n ON r.series = n.series AND r.j = n.i) SELECT * FROM r) GROUP BY ALL),
{out} AS (SELECT m.*, CAST(dense_rank() OVER (PARTITION BY m.series ORDER BY c) AS INT) AS component FROM {out}_c k JOIN {mask} m ON m.series = k.series AND m.i = k.i)"""


def _whole(e: str) -> str:
    return f"floor(round({e}, 6) + 0.5::DOUBLE)::BIGINT::VARCHAR"


def _labelled(spark, d):
    hu = F.col("hu")
    return A.voxels(spark, d).withColumn("label", F.when(hu >= 900, 3).when((hu >= 300) & (F.col("y") < 4), 2).when(hu >= 300, 1).otherwise(0))


_POSITION = f"""CASE WHEN abs(cx - mid_x) < 2 THEN 'midline' ELSE CASE WHEN cx > mid_x THEN 'left side (' ELSE 'right side (' END || {_whole("abs(cx - mid_x)")} || ' mm from the midline)' END || ', ' || {_whole("abs(cz - coalesce(bite_z, z_lo))")} || CASE WHEN bite_z IS NULL THEN ' mm above the lowest bone, ' WHEN cz >= bite_z THEN ' mm above the bite, ' ELSE ' mm below the bite, ' END || {_whole("cy - front_y")} || ' mm behind the front'"""
_PARTS = _joined("bo", "k") + f""", kc AS (SELECT series, component, count(*) AS voxels, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, count(*) FILTER (label = 2) AS jaw FROM k GROUP BY ALL HAVING count(*) >= 4),
kr AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY voxels DESC, component) AS rank FROM kc), parts AS (SELECT kr.series, component, kr.voxels, cx, cy, cz, {_POSITION} AS position FROM kr JOIN refs USING (series) WHERE rank > 1 AND NOT (jaw > kr.voxels / 2 AND kr.voxels > 10000))"""
_JAW = """, jm AS (SELECT b.*, x - mid_x AS dx, CAST(floor(2 * floor(mid_x + 0.5::DOUBLE) - x + 0.5::DOUBLE) AS INT) AS other FROM bo b JOIN refs USING (series) WHERE label = 2), jaw AS (SELECT a.series, count(*) AS voxels, round(avg(a.hu), 6) AS mean_hu, count(*) FILTER (a.dx > 0) AS left, count(*) FILTER (a.dx <= 0) AS right, round(avg(CASE WHEN o.x IS NULL THEN 0 ELSE 1 END), 6) AS overlap,
max(a.z) FILTER (a.dx > 2) - min(a.z) FILTER (a.dx > 2) AS left_height, max(a.z) FILTER (a.dx < -2) - min(a.z) FILTER (a.dx < -2) AS right_height, round(abs(count(*) FILTER (a.dx > 0) - count(*) FILTER (a.dx <= 0)) * 200::DOUBLE / count(*), 6) AS difference FROM jm a LEFT JOIN jm o ON o.series = a.series AND o.x = a.other AND o.y = a.y AND o.z = a.z GROUP BY a.series)"""


@query(f"{LAB}{_REFS} SELECT * FROM refs".replace("len(zs.l) > 50", "len(zs.l) > 10"))
def exam_references(spark, d):
    return N.references(_labelled(spark, d), least_teeth=10)


@query(f"{LAB}{_REFS}{_PARTS} SELECT * FROM parts")
def isolated_parts(spark, d):
    v = _labelled(spark, d)
    return N.isolated_parts(v, N.references(v), least=4, midline=2.0)


@query(f"{LAB}{_REFS_4}{_JAW} SELECT * FROM jaw")
def jaw_summary(spark, d):
    v = _labelled(spark, d)
    return N.jaw_summary(v, N.references(v), lateral=2.0)


_THIRDS = """, sb AS (SELECT b.series, x, y, z, CAST(least(2, floor((z - z_lo) * 3 / greatest(1, z_hi - z_lo))) AS INT) AS part, x > mid_x AS is_left, CAST(floor(2 * floor(mid_x + 0.5::DOUBLE) - x + 0.5::DOUBLE) AS INT) AS other FROM bo b JOIN refs USING (series)),
sy AS (SELECT a.series, a.part, count(*) AS voxels, count(*) FILTER (a.is_left) AS left, count(*) FILTER (NOT a.is_left) AS right, round(avg(CASE WHEN o.x IS NULL THEN 0 ELSE 1 END), 6) AS overlap FROM sb a LEFT JOIN sb o ON o.series = a.series AND o.x = a.other AND o.y = a.y AND o.z = a.z GROUP BY ALL HAVING count(*) >= 20)"""


@query(f"{LAB}{_REFS_4}{_THIRDS} SELECT * FROM sy")
def symmetry_thirds(spark, d):
    v = _labelled(spark, d)
    return N.symmetry(v, N.references(v), least=20)


_TEETH = """, tv AS (SELECT series, count(*) FILTER (coalesce(z >= bite_z, false)) AS upper, count(*) FILTER (NOT coalesce(z >= bite_z, false)) AS lower, count(*) FILTER (x > mid_x) AS left, count(*) FILTER (x <= mid_x) AS right FROM bo JOIN refs USING (series) WHERE label = 3 GROUP BY series)"""


@query(f"""{LAB}{_REFS}{_TEETH}, tm AS (SELECT series, x, y, z, i FROM bo WHERE label = 3){_joined("tm", "t")}, tb AS (SELECT series, component, avg(z) AS cz FROM t GROUP BY ALL HAVING count(*) >= 2), tn AS (SELECT series, count(*) FILTER (coalesce(cz >= bite_z, false)) AS a, count(*) FILTER (NOT coalesce(cz >= bite_z, false)) AS b FROM tb JOIN refs USING (series) GROUP BY series)
SELECT tv.*, coalesce(a, 0) AS blocks_upper, coalesce(b, 0) AS blocks_lower FROM tv LEFT JOIN tn USING (series)""")
def tooth_blocks(spark, d):
    v = _labelled(spark, d)
    return N.tooth_blocks(v, N.references(v), least=2)


_HOLES = f""", ho AS (SELECT series, x, y, z, i, hu FROM lab WHERE label NOT IN (2, 3, 4) AND hu > -600), a AS (SELECT series, x, y, z FROM lab WHERE label <> 2),
ou AS (SELECT * FROM (WITH RECURSIVE r(series, z, x, y) AS (SELECT series, z, x, y FROM a WHERE x IN (0, 7) OR y IN (0, 7) UNION SELECT b.series, b.z, b.x, b.y FROM r JOIN a b ON r.series = b.series AND r.z = b.z AND abs(b.x - r.x) + abs(b.y - r.y) = 1) SELECT * FROM r)),
hm AS (SELECT ho.* FROM ho ANTI JOIN ou USING (series, x, y, z)){_joined("hm", "h")}, hc AS (SELECT series, component, count(*) AS voxels, round(avg(hu), 6) AS mean_hu, max(x) - min(x) + 1 AS size_x, max(y) - min(y) + 1 AS size_y, max(z) - min(z) + 1 AS size_z, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM h GROUP BY ALL HAVING count(*) >= 2),
hp AS (SELECT series, component, hc.voxels, mean_hu, size_x, size_y, size_z, {_POSITION} AS position FROM hc JOIN refs USING (series))"""
_DENSE = LAB.replace("WHEN hu >= 300 AND y < 4 THEN 2 WHEN hu >= 300 THEN 1", "WHEN hu >= -100 THEN 2")


@query(f"{_DENSE}{_REFS}{_HOLES} SELECT * FROM hp")
def low_density(spark, d):
    hu = F.col("hu")
    v = A.voxels(spark, d).withColumn("label", F.when(hu >= 900, 3).when(hu >= -100, 2).otherwise(0))
    return N.low_density(v, N.references(v), least=2, steps=0, air=-600.0, midline=2.0)


_JAW_PARTS = f"""{_joined("jw", "jk")}, jc AS (SELECT series, component, count(*) AS voxels, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM jk GROUP BY ALL HAVING count(*) >= 3), jr AS (SELECT *, count(*) OVER (PARTITION BY series) AS parts, row_number() OVER (PARTITION BY series ORDER BY voxels DESC, component) AS n FROM jc),
jp AS (SELECT series, parts, n, jr.voxels, {_POSITION} AS position FROM jr JOIN refs USING (series) WHERE n <= 5 AND parts > 1)"""


@query(f"""{LAB}{_REFS_4}{_PARTS}{_JAW}{_TEETH}{_THIRDS}{_HOLES}, jw AS (SELECT series, x, y, z, i FROM bo WHERE label = 2){_JAW_PARTS}, big AS (SELECT series FROM jaw WHERE voxels >= 100)
SELECT series, 'coverage' AS section, 1 AS n, {_whole("z_hi - z_lo")} || ' mm high, ' || {_whole("width")} || ' mm wide, ' || {_whole("back_y - front_y")} || ' mm deep; bone ' || voxels || ' mm3' AS line FROM refs
UNION ALL SELECT series, 'jaw', 1, CASE WHEN coalesce(jaw.voxels, 0) >= 100 THEN jaw.voxels || ' mm3; right ' || "right" || ', left ' || "left" || ' (difference ' || {_whole("difference")} || ' %); mirror overlap ' || {_whole("overlap * 100")} || ' %' ELSE 'not separated' END FROM refs LEFT JOIN jaw USING (series)
UNION ALL SELECT series, 'jaw_parts', n, voxels || ' mm3: ' || position FROM jp JOIN big USING (series)
UNION ALL SELECT series, 'jaw_parts', 1, 'continuous' FROM big ANTI JOIN jp USING (series)
UNION ALL SELECT series, 'low_density', n, voxels || ' mm3, ' || size_x || ' x ' || size_y || ' x ' || size_z || ' mm, mean ' || {_whole("mean_hu")} || ': ' || position FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY voxels DESC, component) AS n FROM hp JOIN big USING (series)) WHERE n <= 6
UNION ALL SELECT series, 'symmetry', part + 1, ['lower third', 'middle third', 'upper third'][part + 1] || ': overlap ' || {_whole("overlap * 100")} || ' %; right ' || "right" || ' mm3, left ' || "left" || ' mm3' FROM sy
UNION ALL SELECT series, 'parts', n, voxels || ' mm3: ' || position FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY voxels DESC, component) AS n FROM parts) WHERE n <= 8
UNION ALL SELECT series, 'teeth', 1, 'upper ' || upper || ' mm3, lower ' || lower || ' mm3' FROM tv""")
def exam_reading(spark, d):
    return N.reading(_labelled(spark, d), least_part=4, least_jaw=100, midline=2.0, least_hole=2, hole_steps=0, air_hu=-600.0, least_third=20, least_jaw_part=3)


_SPREAD = "SELECT m.series, m.x, m.y, m.z, m.i, coalesce(any_value(m.s), min(b.s)) AS s FROM {0} m LEFT JOIN (SELECT *, unnest([1, -1, 8, -8, 64, -64]) AS o FROM {0} WHERE s IS NOT NULL) b ON m.s IS NULL AND b.series = m.series AND m.i = b.i + b.o AND abs(m.x - b.x) + abs(m.y - b.y) + abs(m.z - b.z) = 1 GROUP BY m.series, m.x, m.y, m.z, m.i"


@query(f"""{LAB}, r0 AS (SELECT series, x, y, z, i, CASE WHEN hu >= 900 THEN i END AS s FROM lab WHERE hu >= 0), r1 AS ({_SPREAD.format("r0")}), r2 AS ({_SPREAD.format("r1")}), r3 AS ({_SPREAD.format("r2")})
SELECT r.series, r.x, r.y, r.z, CASE WHEN s IS NULL THEN 0 WHEN s // 8 % 8 < 4 THEN 2 ELSE 1 END AS owner FROM r3 r""")
def regrow_three(spark, d):
    v = A.voxels(spark, d).where("hu >= 0")
    return B.regrow(v.withColumn("owner", F.when(F.col("hu") < 900, 0).when(F.col("y") < 4, 2).otherwise(1)), 3)


_REACH = "SELECT * FROM {0} UNION SELECT m.* FROM (SELECT *, unnest([1, -1, 8, -8, 64, -64]) AS o FROM {0}) a JOIN m ON m.series = a.series AND m.i = a.i + a.o AND abs(m.x - a.x) + abs(m.y - a.y) + abs(m.z - a.z) = 1"


@query(f"""{LAB}, pq AS (SELECT series, list_sort(list(hu)) AS l FROM lab WHERE hu >= 200 GROUP BY series), cut AS (SELECT series, seed, 200 + 0.62::DOUBLE * (seed - 200) AS low FROM (SELECT series, least(greatest(1200.0::DOUBLE, l[least(floor(len(l) * 99.9::DOUBLE / 100)::BIGINT, len(l) - 1) + 1]), 1300.0::DOUBLE) AS seed FROM pq)),
m AS (SELECT lab.series, x, y, z, i FROM lab JOIN cut USING (series) WHERE hu >= low), g0 AS (SELECT lab.series, x, y, z, i FROM lab JOIN cut USING (series) WHERE hu >= seed), g1 AS ({_REACH.format("g0")}), g2 AS ({_REACH.format("g1")}){_joined("g2", "k")}
SELECT series, x, y, z FROM k QUALIFY count(*) OVER (PARTITION BY series, component) >= 2""")
def teeth_mask(spark, d):
    v = A.voxels(spark, d).withColumn("label", F.lit(0))
    return B.teeth(v, 200, steps=2, least=2, clamp=(1200.0, 1300.0))


@query(f"""{LAB}, hits AS (SELECT series, x AS hx, y AS hy, z AS hz, label AS hit FROM lab WHERE label > 0 QUALIFY row_number() OVER (PARTITION BY series ORDER BY hu DESC, i) = 1), ow AS (SELECT lab.*, h.*  EXCLUDE (series), (x - 3.5::DOUBLE + 0.25::DOUBLE * (z - hz) >= 0) = (hx - 3.5::DOUBLE >= 0) AS same FROM lab JOIN hits h USING (series) WHERE label = hit), m AS (SELECT series, x, y, z, i, hx, hy, hz FROM ow WHERE same){_joined("m", "k")},
pt AS (SELECT k.* FROM k JOIN (SELECT series, component FROM k WHERE x = hx AND y = hy AND z = hz) USING (series, component)) SELECT series, x, y, z FROM pt QUALIFY count(*) OVER (PARTITION BY series) < 0.98::DOUBLE * (SELECT count(*) FROM ow WHERE ow.series = pt.series)""")
def plane_split(spark, d):
    v = _labelled(spark, d)
    flat = (F.col("z") * 8 + F.col("y")) * 8 + F.col("x")
    hit = v.where("label > 0").groupBy("series").agg(F.max_by(F.struct("x", "y", "z"), F.struct("hu", -flat)).alias("h"))
    fixed = {"px": F.lit(3.5), "py": F.lit(0.0), "pz": F.col("h.z").cast("double"), "ax": F.lit(1.0), "ay": F.lit(0.0), "az": F.lit(0.25)}
    return B.split_by_plane(v, hit.select("series", *(F.col(f"h.{c}").alias(f"h{c}") for c in "xyz"), *(e.alias(k) for k, e in fixed.items())))


@query(f"""{LAB}, mt AS (SELECT *, hu >= 1300 AS metal FROM lab), ds AS (SELECT series, x, y, z, min(s) AS s FROM (SELECT t.series, t.x + a AS x, t.y + b AS y, t.z + c AS z, abs(a) + abs(b) + abs(c) AS s FROM mt t, range(-3, 4) ra(a), range(-3, 4) rb(b), range(-3, 4) rc(c) WHERE metal AND abs(a) + abs(b) + abs(c) <= 3) GROUP BY ALL)
SELECT lab.series, lab.x, lab.y, lab.z, CASE WHEN s <= 1 OR s <= 3 AND hu < 450 AND hu > 200 THEN least(hu - 200.0::DOUBLE, -0.05::DOUBLE) ELSE hu - 200.0::DOUBLE END AS field FROM lab LEFT JOIN ds USING (series, x, y, z)""")
def artefact_field(spark, d):
    v = A.voxels(spark, d).withColumn("label", F.when(F.col("hu") >= 1300, 4).otherwise(0))
    return B.suppress_artefacts(v, 200, reach=3)


@query(f"""SELECT series, object, CASE WHEN abs(cx - 3.5::DOUBLE) < 1 THEN 'midline' WHEN cx > 3.5::DOUBLE THEN 'left side' ELSE 'right side' END || ', ' || CASE WHEN cz / greatest(1, nz - 1) < 0.33::DOUBLE THEN 'lower third' WHEN cz / greatest(1, nz - 1) < 0.66::DOUBLE THEN 'middle third' ELSE 'upper third' END
|| ', ' || CASE WHEN cy / 7 < 0.4::DOUBLE THEN 'front' WHEN cy / 7 < 0.65::DOUBLE THEN 'middle' ELSE 'back' END AS location FROM ({ORACLE["metal_pieces"]}) JOIN (SELECT label AS series, count(*) AS nz FROM embeddings GROUP BY label) USING (series)""")
def metal_locations(spark, d):
    v = A.voxels(spark, d)
    o = M.metal_objects(v, 1300, 700).withColumns({c: F.round(c, 4) for c in ("cx", "cy", "cz")})
    return M.describe(o, _dims(v), midline=1.0).select("series", "object", "location")
