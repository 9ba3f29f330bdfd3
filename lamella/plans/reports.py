"""Queries over findings and lists, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble as B
from ..operators import findings as N
from ..operators import panoramic as P
from ..operators import report as W
from ..operators import views as V
from ..sources import adapters as A
from .catalog import _CONTROL, _POSITION, _REFS, _VOX, LAB, _arch, _dims, _joined, _labelled, query
from .series import sql_fmt

#: pieces of metal and air spaces from ``part``, three a series
O = """o AS (SELECT p_partkey AS object, p_partkey // 3 AS series, list_extract(['screw', 'plate', 'fragment', 'restoration'], CAST(p_partkey % 4 + 1 AS INT)) AS kind, p_size + 0.25::DOUBLE AS length, p_size / 3.0::DOUBLE AS width, p_partkey % 5 + 0.5::DOUBLE AS thickness, p_retailprice AS volume,
(p_partkey * 37 % 120)::DOUBLE AS cx, (p_partkey * 53 % 130)::DOUBLE AS cy, (p_partkey * 29 % 90)::DOUBLE AS cz, 60.0::DOUBLE AS mid_x, 10 AS front_y, CASE WHEN p_partkey % 9 < 6 THEN 40 END AS bite_z, 5 AS z_lo FROM part)"""


def _objects(spark, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("screw", "plate", "fragment", "restoration"))), (k % 4 + 1).cast("int"))
    return A.table(spark, d, "part").select(
        k.alias("object"), k.alias("component"), F.floor(k / 3).alias("series"), kind.alias("kind"), (F.col("p_size") + 0.25).alias("length"), (F.col("p_size") / 3.0).alias("width"), (k % 5 + 0.5).alias("thickness"), F.col("p_retailprice").alias("volume"),
        *((k * a % m).cast("double").alias(c) for c, a, m in (("cx", 37, 120), ("cy", 53, 130), ("cz", 29, 90))), F.lit(60.0).alias("mid_x"), F.lit(10).alias("front_y"), F.when(k % 9 < 6, 40).alias("bite_z"), F.lit(5).alias("z_lo"),
    )


@query(f"WITH {O} SELECT series, count(*) AS pieces, {', '.join(f'count(*) FILTER (kind = {chr(39)}{k}{chr(39)}) AS {k}' for k in W.KINDS)} FROM o GROUP BY series")
def metal_counts(spark, d):
    return W.metal_counts(_objects(spark, d))


@query(f"""WITH {O} SELECT series, object, row_number() OVER (PARTITION BY series ORDER BY list_position({list(W.KINDS)}, kind), length DESC, object) AS n, kind || ': ' || CASE WHEN kind = 'screw' THEN {sql_fmt("length", 1)} || ' mm long x ' || {sql_fmt("width", 1)} || ' mm' ELSE {sql_fmt("length", 1)} || ' x ' || {sql_fmt("width", 1)} || ' x ' || {sql_fmt("thickness", 1)} || ' mm' END || ', ' || {sql_fmt("volume", 0)} || ' mm3' AS line FROM o QUALIFY n <= 2""")
def metal_list(spark, d):
    return W.metal_list(_objects(spark, d), 2)


_AIR = """ak AS (SELECT *, CASE WHEN abs(cx - mid_x) > 30 AND cy - front_y > 80 THEN 'mastoid or middle ear' WHEN abs(cx - mid_x) < 12 THEN CASE WHEN cy - front_y > 55 THEN 'pharynx' ELSE 'nasal cavity' END
WHEN abs(cx - mid_x) <= 45 AND cy - front_y <= 75 AND (bite_z IS NULL OR cz > bite_z) THEN CASE WHEN abs(cx - mid_x) < 18 THEN 'maxillary sinus, perhaps with the nasal cavity' ELSE 'maxillary sinus' END ELSE 'other air space' END AS what FROM o)"""


@query(f"""WITH {O}, {_AIR} SELECT series, object AS component, row_number() OVER (PARTITION BY series ORDER BY volume DESC, object) AS n, {sql_fmt("volume / 1000", 1)} || ' cm3: ' || what || '; ' || {_POSITION} AS line FROM ak""")
def air_list(spark, d):
    return W.air_list(_objects(spark, d).drop("kind"), midline=2.0)


@query(f"""WITH {O}, {_AIR}, g AS (SELECT series, max(volume) FILTER (what LIKE 'maxillary sinus%' AND cx > mid_x) AS "left", max(volume) FILTER (what LIKE 'maxillary sinus%' AND cx < mid_x) AS "right" FROM ak GROUP BY series)
SELECT series, "left", "right", CASE WHEN "left" IS NOT NULL AND "right" IS NOT NULL THEN 'right ' || {sql_fmt('"right" / 1000', 1)} || ' cm3, left ' || {sql_fmt('"left" / 1000', 1)} || ' cm3' WHEN "left" IS NOT NULL THEN 'only one with air: left' WHEN "right" IS NOT NULL THEN 'only one with air: right' ELSE 'none' END AS line FROM g""")
def sinus_pair(spark, d):
    return W.sinus_pair(_objects(spark, d).drop("kind"))


@query(f"WITH {O}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY volume DESC, object) AS n FROM o) SELECT series, count(*) AS groups, string_agg({sql_fmt('volume / 1000', 1)} || ' cm3', '; ' ORDER BY n) FILTER (n <= 2) AS line FROM r GROUP BY series")
def vessel_summary(spark, d):
    return W.largest(_objects(spark, d), 2)


@query(f"""{LAB}{_REFS}, jm2 AS (SELECT series, x, y, z, i FROM bo WHERE label = 2){_joined("jm2", "k")}, jc AS (SELECT series, component, count(*) AS voxels, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM k GROUP BY ALL HAVING count(*) >= 3),
jr AS (SELECT *, count(*) OVER (PARTITION BY series) AS parts, row_number() OVER (PARTITION BY series ORDER BY voxels DESC, component) AS n FROM jc) SELECT jr.series, parts, n, jr.voxels, {_POSITION} AS position FROM jr JOIN refs USING (series) WHERE n <= 5""")
def jaw_parts(spark, d):
    v = _labelled(spark, d)
    return N.jaw_parts(v, N.references(v), least=3, midline=2.0)


@query("""WITH h AS (SELECT p_partkey AS key, p_brand AS name, p_size AS triangles, p_partkey % 3 = 0 AS visible FROM part WHERE p_partkey % 4 < 3), i AS (SELECT p_partkey AS key, p_type AS name, p_size % 7 AS triangles, true AS visible FROM part WHERE p_partkey % 4 > 1)
SELECT key, coalesce(i.name, h.name) AS name, coalesce(i.triangles, h.triangles) AS triangles, coalesce(h.visible, i.visible) AS visible FROM h FULL JOIN i USING (key) WHERE coalesce(i.triangles, h.triangles) > 0""")
def layer_list(spark, d):
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    held = p.where(k % 4 < 3).select(k.alias("key"), F.col("p_brand").alias("name"), F.col("p_size").alias("triangles"), (k % 3 == 0).alias("visible"))
    new = p.where(k % 4 > 1).select(k.alias("key"), F.col("p_type").alias("name"), (F.col("p_size") % 7).alias("triangles"), F.lit(True).alias("visible"))
    return W.upsert_layers(held, new)


_COLOURS = ["[" + ", ".join("[" + ", ".join(map(str, c)) + "]" for c in t) + "]" for t in (W.LABEL_COLOURS, W.USER_COLOURS)]


@query(f"""WITH t AS (SELECT n_regionkey AS series, n_nationkey % 6 + 1 AS id, min(n_name) AS name, list_extract(['bone', 'metal', 'teeth'], CAST(n_nationkey % 6 % 3 + 1 AS INT)) AS base FROM nation GROUP BY ALL), sp AS (SELECT s_nationkey % 5 AS series, s_suppkey AS nr, s_suppkey % 6 + 1 AS of, s_name AS name FROM supplier),
n AS (SELECT sp.series, row_number() OVER (PARTITION BY sp.series ORDER BY nr) + 9 AS id, sp.name, base FROM sp JOIN t ON t.series = sp.series AND t.id = sp.of), a AS (SELECT series, id, name, base FROM t UNION ALL SELECT series, id, name, base FROM n WHERE id <= 30)
SELECT series, id, name, base, (CASE WHEN id <= 6 THEN {_COLOURS[0]}[CAST(id AS INT)] ELSE {_COLOURS[1]}[CAST((id - 10) % 8 + 1 AS INT)] END)[1]::DOUBLE AS red, CASE base WHEN 'metal' THEN id * 2 WHEN 'teeth' THEN id * 3 ELSE id END AS field FROM a""")
def structure_list(spark, d):
    n, s = A.table(spark, d, "nation"), A.table(spark, d, "supplier")
    k, p = F.col("n_nationkey"), F.col("s_suppkey")
    base = F.element_at(F.array(*map(F.lit, ("bone", "metal", "teeth"))), (k % 6 % 3 + 1).cast("int"))
    have = n.groupBy(F.col("n_regionkey").alias("series"), (k % 6 + 1).cast("long").alias("id"), base.alias("base")).agg(F.min("n_name").alias("name"))
    split = s.select((F.col("s_nationkey") % 5).alias("series"), p.alias("at"), (p % 6 + 1).alias("of"), F.col("s_name").alias("name"))
    r = W.register(have, split, last=30)
    i = F.col("id")
    return r.select("series", "id", "name", "base", W.colour(i)[0].alias("red"), W.base_field(F.col("base"), i, i * 2, i * 3, F.lit(None).cast("long")).alias("field"))


@query("""WITH v AS (SELECT c_nationkey AS layer, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS vid FROM customer), t AS (SELECT s_nationkey AS layer, s_suppkey AS tid, s_suppkey % 3 AS a, s_suppkey % 2 AS b, s_suppkey % 4 AS c FROM supplier),
n AS (SELECT layer, count(*) AS n FROM v GROUP BY layer), b AS (SELECT layer, coalesce(sum(n) OVER (ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n) SELECT layer, tid, (a + base)::BIGINT AS a, (b + base)::BIGINT AS b, (c + base)::BIGINT AS c FROM t JOIN b USING (layer)""")
def merged_mesh(spark, d):
    from pyspark.sql import Window

    c, k = A.table(spark, d, "customer"), F.col("s_suppkey")
    v = c.select(F.col("c_nationkey").alias("layer"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("vid"))
    t = A.table(spark, d, "supplier").select(F.col("s_nationkey").alias("layer"), k.alias("tid"), (k % 3).alias("a"), (k % 2).alias("b"), (k % 4).alias("c"))
    return B.merge_meshes(v, t)[1]


@query("""WITH p AS (SELECT p_partkey AS id, p_size + 100.0::DOUBLE AS w, p_size % 20 + 80.0::DOUBLE AS h, (p_partkey % 4 + 1) * 0.25::DOUBLE AS pw, (p_partkey % 3 + 1) * 0.5::DOUBLE AS ph, 640.0::DOUBLE AS cw, 480.0::DOUBLE AS ch, p_partkey % 11 / 10.0::DOUBLE AS fr, p_partkey % 2 = 0 AS flip FROM part), q AS (SELECT *, least(cw / (w * pw), ch / (h * ph)) AS s FROM p)
SELECT id, round((cw - w * pw * s) / 2, 4) AS x0, round((ch - h * ph * s) / 2, 4) AS y0, round(pw * s, 6) AS sx, round(ph * s, 6) AS sy, round(0 + (h * ph - 0) * fr, 6) AS clip, CASE WHEN flip THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS side, round(greatest(0.6::DOUBLE, sqrt(w * pw * (w * pw) + h * ph * (h * ph) + 900) * 0.004::DOUBLE), 6) AS radius, 400.0::DOUBLE + (id % 13 - 6) * 4 AS centre, greatest(1.0::DOUBLE, 600.0::DOUBLE + (id % 200 - 150) * 8) AS width, round(sqrt(pow(w * pw, 2) + pow(h * ph, 2)), 4) AS ruler FROM q""")
def view_geometry(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    w, h, pw, ph = size + 100.0, size % 20 + 80.0, (k % 4 + 1) * 0.25, (k % 3 + 1) * 0.5
    fit = V.layout(w, h, pw, ph, F.lit(640.0), F.lit(480.0))
    zero, top = [F.lit(0.0)] * 3, [w * pw, h * ph, F.lit(30.0)]
    place, normal = V.clip_plane(1, k % 11 / 10.0, k % 2 == 0, zero, top)
    centre, width = V.drag(F.lit(400.0), F.lit(600.0), k % 200 - 150, k % 13 - 6)
    return A.table(spark, d, "part").select(
        k.alias("id"), *(F.round(fit[c], n).alias(c) for c, n in (("x0", 4), ("y0", 4), ("sx", 6), ("sy", 6))), F.round(place[1], 6).alias("clip"), normal[1].alias("side"), F.round(V.marker(zero, top), 6).alias("radius"), centre.alias("centre"), width.alias("width"), F.round(F.hypot(w * pw, h * ph), 4).alias("ruler"),
    )


@query("""WITH t AS (SELECT p_partkey AS id, p_size::INT AS nz, (p_size * 2 - p_partkey % 3 + 1)::INT AS h, p_partkey * 37 % 64 AS u, p_partkey * 29 % (p_size * 2 - p_partkey % 3 + 1) AS v, p_partkey % 64 + 0.25::DOUBLE AS cx, p_partkey * 3 % 64 + 0.5::DOUBLE AS cy, p_partkey * 5 % p_size + 0.75::DOUBLE AS cz, p_partkey % 90 - 10 AS k FROM part),
g AS (SELECT *, plane, CASE plane WHEN 'axial' THEN cz WHEN 'coronal' THEN cy ELSE cx END AS own, CASE plane WHEN 'axial' THEN nz ELSE 64 END AS slices, CASE WHEN h > 1 THEN (h - 1 - v) / (h - 1)::DOUBLE * (nz - 1) ELSE 0 END AS up FROM t, (VALUES ('axial'), ('coronal'), ('sagittal')) p(plane)),
q AS (SELECT *, CASE plane WHEN 'sagittal' THEN cx ELSE u END AS x, CASE plane WHEN 'axial' THEN v WHEN 'coronal' THEN cy ELSE u END AS y, CASE plane WHEN 'axial' THEN floor(cz + 0.5::DOUBLE) ELSE up END AS z, greatest(0, least(slices - 1, k)) AS wanted FROM g)
SELECT id, plane, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CASE WHEN plane = 'axial' OR nz > 1 THEN round(v, 6) ELSE 0 END AS back_v, floor(own + 0.5::DOUBLE) AS slice, CASE WHEN floor(own + 0.5::DOUBLE) = wanted THEN own ELSE wanted END AS turned, CASE plane WHEN 'axial' THEN cz ELSE floor(z + 1e-9 + 0.5::DOUBLE) END AS moved_z FROM q""")
def plane_places(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("int")
    t = A.table(spark, d, "part").select(k.alias("id"), n.alias("nz"), (n * 2 - k % 3 + 1).cast("int").alias("h"), (k * 37 % 64).cast("double").alias("u"), (k % 64 + 0.25).alias("cx"), (k * 3 % 64 + 0.5).alias("cy"), (k * 5 % n + 0.75).alias("cz"), (k % 90 - 10).alias("k"))
    t = t.withColumn("v", (F.col("id") * 29 % F.col("h")).cast("double"))
    u, v, h, nz, cursor = F.col("u"), F.col("v"), F.col("h"), F.col("nz"), [F.col(f"c{c}") for c in "xyz"]
    out = []
    for plane, axis in V.PLANES.items():
        p = V.to_volume(plane, u, v + (1e-9 if plane == "axial" else 0.0), cursor, h, nz)  # off the halves that rounding would tell apart
        own, slices = "xyz".index(axis), nz if plane == "axial" else F.lit(64)
        back, turned = V.from_volume(plane, p, h, nz)[1], V.turn_to(plane, cursor, F.col("k"), slices)[own]
        moved = V.move_to(plane, u, v - 1e-9, cursor, h, nz)[2]
        out.append(t.select("id", F.lit(plane).alias("plane"), *(F.round(e, 6).alias(c) for c, e in zip("xyz", p, strict=True)), F.round(back, 6).alias("back_v"), V.slice_at(plane, cursor).alias("slice"), turned.alias("turned"), moved.alias("moved_z")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH l AS (SELECT o_custkey AS study, o_orderkey AS id, list_extract(['Distance', 'Angle', 'Point', 'area'], CAST(o_orderkey % 4 + 1 AS INT)) || ': ' || o_orderpriority AS line FROM orders UNION ALL SELECT c_custkey, NULL, CAST(c_custkey % 4 AS VARCHAR) || ' point(s) marked' FROM customer WHERE c_custkey % 4 > 0)
SELECT study, row_number() OVER (PARTITION BY study ORDER BY id NULLS LAST) AS n, id, line FROM l""")
def measure_list(spark, d):
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    kind = F.element_at(F.array(*map(F.lit, ("distance", "angle", "point", "area"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    measures = o.select(F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("id"), kind.alias("kind"), F.col("o_orderpriority").alias("label"))
    return V.measure_list(measures, c.select(F.col("c_custkey").alias("study"), (F.col("c_custkey") % 4).alias("points")))


@query(f"""{_CONTROL}, {_VOX}, nzs AS (SELECT series, max(z) + 1 AS nz FROM v GROUP BY series), pt AS (SELECT label AS series, vec_id AS id, round((embedding[1]::DOUBLE + 0.5::DOUBLE) * 7, 3) AS px, round((embedding[2]::DOUBLE + 0.5::DOUBLE) * 7, 3) AS py, round((embedding[3]::DOUBLE + 0.5::DOUBLE) * 9, 3) AS pz FROM embeddings),
j AS (SELECT pt.series, id, pt.px, pt.py, pz, col, round(sqrt(pow(pt.px - a.px, 2) + pow(pt.py - a.py, 2)), 6) AS mm FROM pt JOIN arch a USING (series)), k AS (SELECT j.*, (1 - CASE WHEN nz > 1 THEN pz / (nz - 1) ELSE 0 END) * (greatest(1, floor((nz - 1) * (1.5::DOUBLE / 0.4::DOUBLE) + 0.5::DOUBLE) + 1) - 1) AS v FROM j JOIN nzs USING (series) QUALIFY row_number() OVER (PARTITION BY series, id ORDER BY mm, col) = 1)
SELECT series, id, 'pano' AS view, round(col::DOUBLE, 4) AS u, round(v, 4) AS v FROM k UNION ALL
SELECT k.series, id, 'cross', round((((k.px - a.px) * 0.4::DOUBLE * a.ox + (k.py - a.py) * 0.5::DOUBLE * a.oy) + 20) / 0.4::DOUBLE, 4), round(v, 4) FROM k JOIN arch a ON a.series = k.series AND a.col = 4 WHERE abs(k.col - 4) <= 2""")
def canal_marks(spark, d):
    x, y, z = (F.round((F.col("embedding")[i].cast("double") + 0.5) * n, 3) for i, n in enumerate((7, 7, 9)))
    points = A.table(spark, d, "embeddings").select(F.col("label").alias("series"), F.col("vec_id").alias("id"), x.alias("px"), y.alias("py"), z.alias("pz"))
    m = P.canal_marks(points, _arch(spark, d), _dims(A.voxels(spark, d)), 4, spacing=(0.4, 0.5, 1.5))
    return m.select("series", "id", "view", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))
