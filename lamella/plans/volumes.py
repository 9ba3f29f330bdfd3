"""Queries over voxels: thresholds, reconstruction, views, regions and labels, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import direction_label
from ..operators import components as C
from ..operators import reconstruct as K
from ..operators import reduce as R
from ..operators import resample as Z
from ..operators import rules as U
from ..operators import segment as M
from ..operators import stencil as S
from ..operators import views as V
from ..sources import adapters as A
from .catalog import _PLANES, LAB, ORACLE, PIX, VOX, _dims, _gauss, _joined, _labelled, _whole, query
from .series import S as HEADS

_OTSU = ORACLE["otsu_threshold"].removeprefix("WITH ").rsplit("\nSELECT ", 1)


@query(f"WITH {_OTSU[0]}, ot AS (SELECT {_OTSU[1]}) SELECT ot.series, CASE WHEN ot.series % 2 = 0 AND low < -800 THEN 200 ELSE threshold END::BIGINT AS threshold FROM ot JOIN (SELECT series, min(hu) AS low FROM v GROUP BY series) USING (series)")
def suggest_threshold(spark, d):
    v = A.voxels(spark, d)
    return R.suggest(v, v.select("series").distinct().withColumn("cbct", F.col("series") % 2 == 1))


@query(f"{VOX} SELECT series, round(2.0::DOUBLE * count(*) FILTER (hu >= 300 AND hu + x * 20 >= 350) / nullif(count(*) FILTER (hu >= 300) + count(*) FILTER (hu + x * 20 >= 350), 0), 6) AS dice FROM v GROUP BY series")
def dice_overlap(spark, d):
    return R.dice(A.voxels(spark, d), F.col("hu") >= 300, F.col("hu") + F.col("x") * 20 >= 350)


_G5 = "g0 AS (SELECT k, exp(-k * k / (2 * 0.5::DOUBLE * 0.5::DOUBLE)) w FROM range(-2, 3) r(k)), g AS (SELECT k, w / (SELECT sum(w) FROM g0) w FROM g0)"
_EXT = "ext AS (SELECT series, max(x) mx, max(y) my, max(z) mz FROM v GROUP BY series)"
_BOX = "v0 AS (SELECT a.series, a.x, a.y, a.z, max(CASE WHEN b.hu >= 400 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM v a JOIN v b ON a.series = b.series AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND abs(a.z - b.z) <= 2 GROUP BY ALL)"


@query(f"{VOX}, {_EXT}, {_G5}, {_BOX}, {_gauss('x', 'v0', 'vx')}, {_gauss('y', 'vx', 'vy')}, {_gauss('z', 'vy', 'vz')} SELECT series, x, y, z, round(400 - (400 - 250) * least(1.0::DOUBLE, v), 4) AS local FROM vz")
def thin_walls(spark, d):
    return K.thin_walls(A.voxels(spark, d), 400, 250).select("series", "x", "y", "z", F.round("local", 4).alias("local"))


_SHAPE = """dn AS (SELECT a.series, a.z, a.x, a.y, a.hu >= 200 AS inside, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d2, count(b.x) k FROM v a LEFT JOIN v b ON a.series = b.series AND a.z = b.z AND (a.hu >= 200) <> (b.hu >= 200) GROUP BY ALL),
sd AS (SELECT series, z, x, y, round(CASE WHEN k = 0 THEN CASE WHEN inside THEN 40.0 ELSE -0.5 END WHEN inside THEN sqrt(d2) - 0.5 ELSE 0.5 - sqrt(d2) END::DOUBLE, 6) AS hu FROM dn)"""
_CUBIC = "p1 + t * ((p2 - p0) * 0.5::DOUBLE + t * ((p2 - p1) * 3 - (p2 - p0) * 0.5::DOUBLE * 2 - (p3 - p1) * 0.5::DOUBLE + t * ((p2 - p0) * 0.5::DOUBLE + (p3 - p1) * 0.5::DOUBLE - (p2 - p1) * 2)))"
_ON_SHAPE = _PLANES.removeprefix(VOX).replace("JOIN v b ON", "JOIN sd b ON").replace("JOIN v a ON", "JOIN sd a ON").replace("JOIN v c ON", "JOIN sd c ON").replace("JOIN v e ON", "JOIN sd e ON")


@query(f"{VOX}, {_SHAPE}{_ON_SHAPE} SELECT series, x, y, k, round(CASE WHEN t < 0.0001 THEN p1 ELSE {_CUBIC} END, 4) AS field FROM p")
def shape_field(spark, d):
    return K.shape_field(A.voxels(spark, d), 200, 0.4).select("series", "x", "y", "k", F.round("field", 4).alias("field"))


_FINE = f"{_PLANES}, fi AS (SELECT series, x, y, CAST(k AS INT) AS z, CAST(floor(p1 + (p2 - p1) * t + 0.5) AS BIGINT) AS hu FROM p)"
_G6 = "ext AS (SELECT series, max(x) mx, max(y) my, max(z) mz FROM fi GROUP BY series), {0}0 AS (SELECT k, exp(-k * k / (2 * {1}::DOUBLE * {1}::DOUBLE)) w FROM range(-{2}, {2} + 1) r(k)), {0} AS (SELECT k, w / (SELECT sum(w) FROM {0}0) w FROM {0}0)"
_GZ = "gz0 AS (SELECT k, exp(-k * k / (2 * pow(0.6::DOUBLE / 0.4::DOUBLE, 2))) w FROM range(-4, 5) r(k)), gz AS (SELECT k, w / (SELECT sum(w) FROM gz0) w FROM gz0)"


@query(f"{_FINE}, {_G6.format('g', '0.6', 2)}, {_GZ}, v0 AS (SELECT series, x, y, z, (hu - 200)::DOUBLE AS v FROM fi), {_gauss('x', 'v0', 'vx')}, {_gauss('y', 'vx', 'vy')}, {_gauss('z', 'vy', 'vz').replace('CROSS JOIN g ', 'CROSS JOIN gz g ')} SELECT series, x, y, z::BIGINT AS z, fi.hu, round(v, 3) AS field FROM vz JOIN fi USING (series, x, y, z)")
def reconstruct_field(spark, d):
    return K.reconstruct(A.voxels(spark, d), 200, 0.4, method="linear", smoothing=0.6, small_parts=False).select("series", "x", "y", "z", "hu", F.round("field", 3).alias("field"))


@query(f"""{VOX}, m AS (SELECT series, x, y, z, (z * 8 + y) * 8 + x AS i, hu FROM v WHERE hu > 300){_joined("m", "k")}, n AS (SELECT series, component, count(*) AS n FROM k GROUP BY ALL), dr AS (SELECT series, component FROM n QUALIFY n < greatest(max(n) OVER (PARTITION BY series) * 0.005::DOUBLE, 3)),
gone AS (SELECT series, x, y, z FROM k JOIN dr USING (series, component)) SELECT v.series, count(*) FILTER (gone.x IS NOT NULL) AS dropped, count(*) FILTER (hu > 300 AND gone.x IS NULL) AS kept, round(sum(CASE WHEN gone.x IS NOT NULL THEN -0.01::DOUBLE ELSE hu - 300 END), 2) AS total FROM v LEFT JOIN gone USING (series, x, y, z) GROUP BY v.series""")
def clean_field(spark, d):
    c = C.clean_field(A.voxels(spark, d).withColumn("field", (F.col("hu") - 300).cast("double")), least=3)
    return c.groupBy("series").agg(F.count_if("dropped").alias("dropped"), F.count_if(F.col("field") > 0).alias("kept"), F.round(F.sum("field"), 2).alias("total"))


_DIMS = "dims AS (SELECT series, max(z) + 1 AS nz FROM v GROUP BY series)"
_POINT = "pt AS (SELECT label AS series, vec_id AS id, round((embedding[1]::DOUBLE + 0.6::DOUBLE) * 7, 3) AS px, round((embedding[2]::DOUBLE + 0.6::DOUBLE) * 7, 3) AS py, round((embedding[3]::DOUBLE + 0.6::DOUBLE) * 9, 3) AS pz FROM embeddings)"


def _points(spark, d):
    e = lambda i, n: F.round((F.col("embedding")[i].cast("double") + 0.6) * n, 3)
    return A.table(spark, d, "embeddings").select(F.col("label").alias("series"), F.col("vec_id").alias("id"), e(0, 7).alias("px"), e(1, 7).alias("py"), e(2, 9).alias("pz"))


def _near_index(c, n):
    return f"greatest(0, least({n}, CAST(floor({c} + 0.5::DOUBLE) AS INT)))"


@query(f"""{VOX}, {_DIMS}, {_POINT}, q AS (SELECT pt.series, id, {_near_index('px', 7)} AS x, {_near_index('py', 7)} AS y, greatest(0.0::DOUBLE, least(nz - 1.0::DOUBLE, pz)) AS zc, nz FROM pt JOIN dims USING (series))
SELECT q.series, id, round(a.hu + (coalesce(b.hu, a.hu) - a.hu) * (zc - floor(zc)), 4) AS hu FROM q JOIN v a ON a.series = q.series AND a.x = q.x AND a.y = q.y AND a.z = floor(zc) LEFT JOIN v b ON b.series = q.series AND b.x = q.x AND b.y = q.y AND b.z = floor(zc) + 1""")
def probe(spark, d):
    v = A.voxels(spark, d)
    return V.probe(_points(spark, d), v, _dims(v)).withColumn("hu", F.round("hu", 4))


@query(f"""{VOX}, {_DIMS}, h AS (SELECT series, nz, greatest(1, CAST(floor((nz - 1) * 1.5::DOUBLE + 0.5::DOUBLE) AS INT) + 1) AS h FROM dims), r AS (SELECT *, unnest(range(h)) AS k FROM h), rs AS (SELECT series, nz, h, k, least(nz - 1, k * CASE WHEN h > 1 THEN (nz - 1)::DOUBLE / (h - 1) ELSE 1.0 END) AS w FROM r), z AS (SELECT *, CAST(floor(w + 1e-9) AS INT) AS z0 FROM rs)
SELECT z.series, CAST(h - 1 - k AS INT) AS row, a.x AS col, round(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (a.hu + (coalesce(b.hu, a.hu) - a.hu) * greatest(0.0::DOUBLE, w - z0) - (0 - 1200 / 2)) * (255 / 1200.0::DOUBLE))) + 1e-9, 3) AS gray, round(a.hu + (coalesce(b.hu, a.hu) - a.hu) * greatest(0.0::DOUBLE, w - z0), 6) >= 900 AS gold FROM z JOIN v a ON a.series = z.series AND a.y = 4 AND a.z = z0 LEFT JOIN v b ON b.series = z.series AND b.y = 4 AND b.x = a.x AND b.z = z0 + 1""")
def mpr_coronal_window(spark, d):
    v = A.voxels(spark, d)
    p = V.plane_image(v, _dims(v), "coronal", 4, (1.0, 1.0, 1.5))
    return p.select("series", "row", "col", F.round(V.window(F.col("value"), 0, 1200) + 1e-9, 3).alias("gray"), (F.round("value", 6) >= 900).alias("gold"))


_D9 = "nx, ny, nz, CASE WHEN abs(nz) > 0.9 THEN 0.0::DOUBLE ELSE -ny END, CASE WHEN abs(nz) > 0.9 THEN 1.0::DOUBLE ELSE nx END, 0.0::DOUBLE, 0.0::DOUBLE, CASE WHEN id % 2 = 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN id % 2 = 0 THEN -0.8::DOUBLE ELSE 1.0::DOUBLE END".split(", ")


def _letter(v):
    x, y, z = v
    return f"CASE WHEN abs({x}) >= abs({y}) AND abs({x}) >= abs({z}) THEN CASE WHEN {x} >= 0 THEN 'L' ELSE 'R' END WHEN abs({y}) >= abs({z}) THEN CASE WHEN {y} >= 0 THEN 'P' ELSE 'A' END ELSE CASE WHEN {z} >= 0 THEN 'S' ELSE 'I' END END"


def _minus(v):
    return [f"(-({c}))" for c in v]


@query(f"""WITH {HEADS} SELECT id, {_letter(_D9[:3])} AS row_label, {" || ".join(_letter(v) for v in (_minus(_D9[:3]), _D9[:3], _D9[6:], _minus(_D9[6:])))} AS coronal, {" || ".join(_letter(v) for v in (_minus(_D9[3:6]), _D9[3:6], _D9[6:], _minus(_D9[6:])))} AS sagittal,
abs({_D9[0]}) > 0.95 AND abs({_D9[4]}) > 0.95 AND abs({_D9[8]}) > 0.95 AS aligned FROM s WHERE nx IS NOT NULL""")
def orientation_labels(spark, d):
    n, k, zero = [F.col(c) for c in ("nx", "ny", "nz")], F.col("id"), F.lit(0.0)
    up = F.abs(n[2]) > 0.9
    nine = [*n, F.when(up, 0.0).otherwise(-n[1]), F.when(up, 1.0).otherwise(n[0]), zero, zero, F.when(k % 2 == 0, 0.6).otherwise(0.0), F.when(k % 2 == 0, -0.8).otherwise(1.0)]
    s = A.plan_series(spark, d).where("nx is not null")
    return s.select("id", direction_label(*n).alias("row_label"), F.concat(*V.edge_labels("coronal", nine)).alias("coronal"), F.concat(*V.edge_labels("sagittal", nine)).alias("sagittal"), V.aligned(nine).alias("aligned"))


@query(f"""WITH {HEADS}, b AS (SELECT id, greatest(px0, 0.5::DOUBLE) AS s0, x1 - x0 AS ex, y1 - y0 AS ey, z1 - z0 AS ez FROM s), t AS (SELECT *, unnest(range(201)) AS k FROM b), f AS (SELECT id, min(k) AS k FROM t WHERE (floor(ex / (s0 * pow(1.1::DOUBLE, k))) + 1)::DOUBLE * (floor(ey / (s0 * pow(1.1::DOUBLE, k))) + 1) * (floor(ez / (s0 * pow(1.1::DOUBLE, k))) + 1) <= 2000000 GROUP BY id)
SELECT id, round(s0 * pow(1.1::DOUBLE, k), 6) AS s, (floor(ex / (s0 * pow(1.1::DOUBLE, k))) + 1)::BIGINT AS nx, (floor(ey / (s0 * pow(1.1::DOUBLE, k))) + 1)::BIGINT AS ny, (floor(ez / (s0 * pow(1.1::DOUBLE, k))) + 1)::BIGINT AS nz FROM f JOIN b USING (id)""")
def fusion_grid(spark, d):
    g = V.fusion_grid([F.col(f"{c}0") for c in "xyz"], [F.col(f"{c}1") for c in "xyz"], F.col("px0"), 2e6)
    return A.plan_series(spark, d).select("id", F.round(g["s"], 6).alias("s"), *(g[f"n{c}"].cast("long").alias(f"n{c}") for c in "xyz"))


_IDX = [f"floor(({_D9[3 * a]} * (px0 * 40 - x0) + {_D9[3 * a + 1]} * (id % 50 - y0) + {_D9[3 * a + 2]} * (id % 70 - z0)) / {s} + 0.5::DOUBLE)::BIGINT" for a, s in enumerate(("px0", "px0", "coalesce(spacing, 5.0::DOUBLE)"))]


@query(f"""WITH {HEADS} SELECT id, {_IDX[0]} AS ix, {_IDX[1]} AS iy, {_IDX[2]} AS iz, round({_D9[0]} * 0.5 / px0, 6) AS a00, round({_D9[3]} * 0.5 / px0, 6) AS a10, round({_D9[8]} * 0.5 / coalesce(spacing, 5.0), 6) AS a22, round(({_D9[0]} * (1 - x0) + {_D9[1]} * (2 - y0) + {_D9[2]} * (3 - z0)) / px0, 6) AS b0 FROM s WHERE nx IS NOT NULL""")
def index_places(spark, d):
    n, k, zero = [F.col(c) for c in ("nx", "ny", "nz")], F.col("id"), F.lit(0.0)
    up = F.abs(n[2]) > 0.9
    nine = [*n, F.when(up, 0.0).otherwise(-n[1]), F.when(up, 1.0).otherwise(n[0]), zero, zero, F.when(k % 2 == 0, 0.6).otherwise(0.0), F.when(k % 2 == 0, -0.8).otherwise(1.0)]
    origin, spacing = [F.col(f"{c}0") for c in "xyz"], [F.col("px0"), F.col("px0"), F.coalesce("spacing", F.lit(5.0))]
    at = V.index_of([F.col("px0") * 40, (k % 50).cast("double"), (k % 70).cast("double")], origin, nine, spacing)
    unit = [F.lit(float(i == j)) for i in range(3) for j in range(3)]
    a, b = V.index_map({"origin": [F.lit(float(i)) for i in (1, 2, 3)], "direction": unit, "spacing": [F.lit(0.5)] * 3}, {"origin": origin, "direction": nine, "spacing": spacing})
    return A.plan_series(spark, d).where("nx is not null").select("id", *(e.alias(c) for e, c in zip(at, ("ix", "iy", "iz"), strict=True)), F.round(a[0], 6).alias("a00"), F.round(a[3], 6).alias("a10"), F.round(a[8], 6).alias("a22"), F.round(b[0], 6).alias("b0"))


_PLACE = "CASE WHEN abs(cx - 3.5::DOUBLE) < 1 THEN 'midline' WHEN cx > 3.5::DOUBLE THEN 'left side' ELSE 'right side' END || ', ' || CASE WHEN cz / greatest(1, nz - 1) < 0.33::DOUBLE THEN 'lower third' WHEN cz / greatest(1, nz - 1) < 0.66::DOUBLE THEN 'middle third' ELSE 'upper third' END || ', ' || CASE WHEN cy / 7 < 0.4::DOUBLE THEN 'front' WHEN cy / 7 < 0.65::DOUBLE THEN 'middle' ELSE 'back' END"
_AIR = ORACLE["enclosed_air"].removeprefix(VOX + ", ").split(" SELECT series, z, x, y FROM a ANTI", 1)
AIR = f"{_AIR[0]}, ar AS (SELECT series, x, y, z, (z * 8 + y) * 8 + x AS i FROM a ANTI{_AIR[1]})"
BLOOD = "bl AS (SELECT series, x, y, z, (z * 8 + y) * 8 + x AS i FROM (" + ORACLE["vessels"].removeprefix(VOX) + "))"


def _regions(mask: str, least: int) -> str:
    return f"{_joined(mask, 'k')}, re AS (SELECT series, component, count(*)::DOUBLE AS volume, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM k GROUP BY ALL HAVING count(*) >= {least}) SELECT re.series, component, volume, round(cx, 4) AS cx, round(cy, 4) AS cy, round(cz, 4) AS cz, {_PLACE} AS location FROM re JOIN dims USING (series)"


def _rounded(r):
    return r.select("series", "component", "volume", *(F.round(c, 4).alias(c) for c in ("cx", "cy", "cz")), "location")


@query(f"{VOX}, {_DIMS}, {AIR}{_regions('ar', 2)}")
def air_regions(spark, d):
    v = A.voxels(spark, d)
    return _rounded(M.regions(M.airways(v, -200), _dims(v), 2, 1.0))


@query(f"{VOX}, {_DIMS}, {BLOOD}{_regions('bl', 2)}")
def vessel_regions(spark, d):
    v = A.voxels(spark, d)
    return _rounded(M.regions(M.vessels(v), _dims(v), 2, 1.0))


def _kept(mask: str, out: str, least: int) -> str:
    return f"{_joined(mask, out + 'k')}, {out} AS (SELECT series, x, y, z FROM {out}k QUALIFY count(*) OVER (PARTITION BY series, component) >= {least})"


@query(f"{LAB}, {AIR}, {BLOOD}{_kept('ar', 'la', 4)}{_kept('bl', 'lb', 3)} SELECT lab.series, CASE WHEN label <> 0 THEN label WHEN la.x IS NOT NULL THEN 5 WHEN lb.x IS NOT NULL THEN 6 ELSE 0 END AS label, count(*) AS voxels FROM lab LEFT JOIN la USING (series, x, y, z) LEFT JOIN lb USING (series, x, y, z) GROUP BY ALL")
def label_volumes(spark, d):
    v = _labelled(spark, d)
    return M.merge_labels(v, M.keep_regions(M.airways(v, -200), 4), M.keep_regions(M.vessels(v), 3)).groupBy("series", "label").agg(F.count("*").alias("voxels"))


@query(f"{VOX} SELECT series, x, y, z, CASE WHEN hu >= 1300 THEN greatest(0.05::DOUBLE, hu - 1100.0::DOUBLE + 1) ELSE least(-0.05::DOUBLE, hu - 1100.0::DOUBLE) END AS field FROM v")
def metal_surface_field(spark, d):
    return M.metal_field(A.voxels(spark, d).withColumn("metal", F.col("hu") >= 1300), 1100.0).select("series", "x", "y", "z", "field")


_SOUP = ORACLE["surface_area"].split("c AS (", 1)[1].split("SELECT series, count(*) AS triangles", 1)[0]
_SOUP = "c AS (" + _SOUP.replace("(hu - 200)::DOUBLE AS f FROM v", "f FROM vl")


@query(f"""{LAB}, l AS (SELECT series, x, y, z, layer, CASE WHEN label = layer THEN greatest(0.01::DOUBLE, (hu - 300)::DOUBLE) ELSE -0.01::DOUBLE - abs(hu - 300) * 0.05::DOUBLE END AS f FROM lab, range(1, 4) t(layer)), vl AS (SELECT series * 8 + layer AS series, x, y, z, f FROM l), {_SOUP},
ve AS (SELECT a.series, count(*) AS vertices FROM vl a, range(1, 8) t(k) JOIN vl b ON b.series = a.series AND b.x = a.x + k % 2 AND b.y = a.y + k // 2 % 2 AND b.z = a.z + k // 4 WHERE (a.f > 0) <> (b.f > 0) GROUP BY a.series)
SELECT CAST(n.series // 8 AS INT) AS series, CAST(n.series % 8 AS INT) AS layer, any_value(vertices) AS vertices, count(*) AS triangles, round(sum(sqrt(pow(b * f - c * e, 2) + pow(c * d - a * f, 2) + pow(a * e - b * d, 2)) / 2), 3) AS area FROM n JOIN ve USING (series) GROUP BY n.series""")
def layer_meshes(spark, d):
    from ..operators import surface as T

    tri, vert = T.layer_meshes(_labelled(spark, d).withColumn("field", F.col("hu") - 300), steps=0, fine=())
    return T.measures(tri, vert).select("series", "layer", "vertices", "triangles", F.round("area", 3).alias("area"))


_CUBE = "c AS (SELECT series, id, CAST(floor(px + 0.5::DOUBLE) AS INT) + a AS x, CAST(floor(py + 0.5::DOUBLE) AS INT) + b AS y, CAST(floor(pz + 0.5::DOUBLE) AS INT) + e AS z, a * a + b * b + e * e AS dd FROM pt, range(-3, 4) t1(a), range(-3, 4) t2(b), range(-3, 4) t3(e))"


def _places(spark, d):
    return _points(spark, d).select("series", "id", *(F.floor(F.col(f"p{c}") + 0.5).cast("int").alias(c) for c in "xyz"))


@query(f"{LAB}, {_POINT}, {_CUBE} SELECT series, id, c.x, c.y, c.z, label FROM c JOIN lab USING (series, x, y, z) WHERE label > 0 QUALIFY row_number() OVER (PARTITION BY series, id ORDER BY dd, z, y, x) = 1")
def label_at(spark, d):
    return V.near(_places(spark, d), _labelled(spark, d))


@query(f"{LAB}, {_POINT}, {_CUBE}, n AS (SELECT series, id, label, count(*) AS n, min(i) AS first FROM c JOIN lab USING (series, x, y, z) WHERE label IN (1, 2, 3) GROUP BY ALL) SELECT series, id, label FROM n QUALIFY row_number() OVER (PARTITION BY series, id ORDER BY n DESC, first) = 1")
def label_near(spark, d):
    return V.majority(_places(spark, d), _labelled(spark, d))


@query(f"""{LAB}, pt AS (SELECT c_custkey % 10 AS series, c_custkey AS id, c_custkey % 8 AS px, c_custkey // 8 % 8 AS py, c_custkey * 7 % 40 AS pz FROM customer)
SELECT pt.series, id, x, y, z, label FROM pt JOIN lab ON lab.series = pt.series AND abs(x - px) <= 3 AND abs(y - py) <= 3 AND abs(z - pz) <= 3 WHERE label > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY (x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz), z, y, x) = 1""")
def nearest_voxels(spark, d):
    k = F.col("c_custkey")
    at = {"x": k % 8, "y": F.floor(k / 8) % 8, "z": k * 7 % 40}
    p = A.table(spark, d, "customer").select((k % 10).cast("int").alias("series"), k.alias("id"), *(e.cast("int").alias(c) for c, e in at.items()))
    return V.near(p, _labelled(spark, d))


@query(f"{LAB} SELECT series, label, {', '.join(f'{f}({c}) AS {c}{k}' for c in 'xyz' for k, f in enumerate(('min', 'max')))} FROM lab GROUP BY GROUPING SETS ((series, label), (series))")
def layer_bounds(spark, d):
    return V.bounds(_labelled(spark, d), ["series"], "label")


_PRESET = ", ".join(f"('{p}', '{c}')" for p, cs in U.PRESETS.items() for c in cs)
_CLASS = ", ".join(f"('{c}', {lo}, {hi}, {o})" for c, lo, hi, o in U.tissues(200, True))


@query(f"{VOX}, c(class, lo, hi, opacity) AS (VALUES {_CLASS}), p(preset, class) AS (VALUES {_PRESET}) SELECT series, preset, count(*) AS voxels, round(avg(opacity), 6) AS opacity FROM v JOIN c ON hu >= lo AND hu <= hi JOIN p USING (class) GROUP BY ALL")
def preset_voxels(spark, d):
    shown = spark.createDataFrame([(p, *t) for p, cs in U.PRESETS.items() for t in U.tissues(200, True) if t[0] in cs], "preset string, class string, lo double, hi double, opacity double")
    v = A.voxels(spark, d).groupBy("series", "hu").agg(F.count("*").alias("k"))
    j = v.join(F.broadcast(R.few(shown)), (F.col("hu") >= F.col("lo")) & (F.col("hu") <= F.col("hi")))
    return j.groupBy("series", "preset").agg(F.sum("k").alias("voxels"), F.round(F.sum(F.col("k") * F.col("opacity")) / F.sum("k"), 6).alias("opacity"))


@query(f"{VOX}, {_DIMS} SELECT v.series, CAST(u AS INT) AS x, CAST(w AS INT) AS y, round(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (hu + 900) / 2600.0::DOUBLE * 255)), 4) AS gray FROM v JOIN dims USING (series), range(3) a(u), range(3) b(w) WHERE z = nz // 2 AND x = least(7, floor(u * 8 / 3.0::DOUBLE)) AND y = least(7, floor(w * 8 / 3.0::DOUBLE))")
def series_thumbnail(spark, d):
    from ..operators.assemble import thumbnail

    v = A.voxels(spark, d)
    mid = _dims(v).select("series", F.floor(F.col("nz") / 2).cast("int").alias("z"))
    return thumbnail(v.join(mid, ["series", "z"]), 8, 8, 3).withColumn("gray", F.round("gray", 4))


@query(f"{PIX} SELECT img, x, y, round(0.299::DOUBLE * v + 0.587::DOUBLE * (255 - v) + 0.114::DOUBLE * (x * 4), 4) AS v FROM p")
def luma(spark, d):
    from ..operators.enhance import to_gray

    p = A.pixels(spark, d)
    return p.select("img", "x", "y", F.round(to_gray(F.col("v"), 255 - F.col("v"), F.col("x") * 4), 4).alias("v"))


@query(f"{VOX}, m AS (SELECT series, x, y, z, row_number() OVER (PARTITION BY series ORDER BY z, y, x) - 1 AS k, count(*) OVER (PARTITION BY series) AS n FROM v WHERE hu >= 300) SELECT series, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(avg(z), 4) AS cz FROM m WHERE k % greatest(1, n // 10) = 0 GROUP BY series")
def sampled_centroid(spark, d):
    from ..operators.report import sampled_centroid as centre

    return centre(A.voxels(spark, d).where("hu >= 300"), ["series"], 10).select("series", *(F.round(c, 4).alias(c) for c in ("cx", "cy", "cz")))
