"""Cases that the tables do not hold: rounding, ties, phantoms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import scalar as M
from lamella import verbs
from lamella.operators import assess as Q
from lamella.operators import components as C
from lamella.operators import enhance as E
from lamella.operators import panoramic as PN
from lamella.operators import planning as L
from lamella.operators import reconstruct as K
from lamella.operators import reduce as R
from lamella.operators import report as W
from lamella.operators import resample as Z
from lamella.operators import rules as U
from lamella.operators import segment as M2
from lamella.operators import stencil as S
from lamella.operators import views as V


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_rounding_and_clamping(spark):
    assert one(spark, M.half_up(F.lit(-2.5)), M.half_up(F.lit(2.5)), M.to_int16(F.lit(1e6)), M.clamp(F.lit(None).cast("double"), 0, 1)) == [-2, 3, 32767, None]


def test_vectors(spark):
    v = [F.lit(0.0), F.lit(3.0), F.lit(4.0)]
    assert one(spark, *M.normalize(v), *M.normalize([F.lit(0.0)] * 3), *M.cross([F.lit(1), F.lit(0), F.lit(0)], [F.lit(0), F.lit(1), F.lit(0)])) == [0.0, 0.6, 0.8, 0.0, 0.0, 0.0, 0, 0, 1]
    assert one(spark, M.dominant_axis(F.lit(1), F.lit(-1), F.lit(1)), M.dominant_axis(F.lit(0), F.lit(1), F.lit(-1)), M.dominant_axis(F.lit(0), F.lit(0), F.lit(2))) == [0, 1, 2]


def grid(spark, n, expr):
    v = spark.range(n**3).select(F.lit(0).alias("series"), (F.col("id") % n).cast("int").alias("x"), (F.floor(F.col("id") / n) % n).cast("int").alias("y"), F.floor(F.col("id") / n / n).cast("int").alias("z"))
    return v.withColumn("hu", F.expr(expr).cast("long"))


def test_components_of_a_block_and_a_voxel(spark):
    v = grid(spark, 8, "case when (x < 3 and y < 3 and z < 3) or (x = 6 and y = 6 and z = 6) then 1000 else -1000 end")
    got = sorted((r.component, r.voxels) for r in C.components6(v).collect())
    assert got == [(0, 27), (6 * 64 + 6 * 8 + 6, 1)]
    assert [r.voxels for r in C.keep_large(C.components6(v), least=5).collect()] == [27]
    assert C.keep_large(C.components6(v)).count() == 0  # 150 mm3 by default


def test_label6_against_search():
    rng = np.random.default_rng(1)
    mask = rng.random((6, 7, 5)) < 0.5
    lab = C.label6(mask)
    seen = np.full(mask.shape, -1)
    for start in zip(*np.nonzero(mask), strict=True):
        if seen[start] >= 0:
            continue
        name, todo = np.ravel_multi_index(start, mask.shape), [start]
        seen[start] = name
        while todo:
            p = todo.pop()
            for axis in range(3):
                for s in (-1, 1):
                    q = list(p)
                    q[axis] += s
                    q = tuple(q)
                    if all(0 <= a < b for a, b in zip(q, mask.shape, strict=True)) and mask[q] and seen[q] < 0:
                        seen[q] = name
                        todo.append(q)
    assert (lab == seen).all()


def test_erosion_clears_the_shell(spark):
    v = grid(spark, 4, "1").withColumn("m", F.lit(1))
    assert S.erode6(v).agg(F.sum("m")).first()[0] == 8


def test_gap_fill_of_a_missing_slice(spark):
    rows = [(1, float(z), float(z), z) for z in (0, 1, 2, 4, 5)] + [(1, 4.0004, 99.0, 9), (1, 4.0, 50.0, 8)] + [(2, z * 2.5, float(z), z) for z in range(4)] + [(2, 5.0, 70.0, 0)]
    s = spark.createDataFrame(rows, "series int, z double, value double, at int")
    got = [(r.series, r.value, r.filled) for r in Z.fill_gaps(s).orderBy("series", "k").collect()]
    assert got == [(1, k, k == 3) for k in range(6)] + [(2, 0, False), (2, 1, False), (2, 70, False), (2, 3, False)]


def test_places_near_the_last_kept_one_go(spark):
    s = spark.createDataFrame([(1, z) for z in (0.0, 0.0006, 0.0012, 0.0018, 1.0)], "series int, z double")
    assert sorted(r.z for r in Z.gaps(s).collect()) == [0.0, 0.0012, 1.0]


def test_cubic_stays_in_range(spark):
    v = grid(spark, 4, "case when z < 2 then -1000 else 1000 end")
    r = Z.resample_z(v, 0.3, method="cubic").agg(F.min("hu"), F.max("hu")).first()
    assert list(r) == [-1000, 1000]


@pytest.mark.parametrize("name,want", [("a.TXT", False), ("DICOMDIR", False), ("dicomdir", True), ("img001.dcm", True), ("x", True)])
def test_readable(spark, name, want):
    assert one(spark, U.readable(F.lit(name))) == [want]


def test_slug(spark):
    assert one(spark, U.slug(F.lit(" Élan, vitãl! 2 Ź")), U.base_name(F.lit("Ana B"), F.lit(False)), U.base_name(F.lit("Ana"), F.lit(True))) == ["-elan-vital-2-z", "Ana_B-reconstrucao-ossea", "reconstrucao-ossea"]


@pytest.mark.parametrize("text,want", [("CRANIO C/C", True), ("cranio s/c", False), ("sem  contraste c+", False), ("Angio TC", True), ("contrast medium", False), ("pós-contraste", True), ("pos contraste", True), ("abc+", False), ("C+ ", True)])
def test_contrast(spark, text, want):
    assert one(spark, U.contrast_flag(F.lit(None).cast("string"), F.lit(text))) == [want]
    assert one(spark, U.contrast_flag(F.lit("Iohexol"), F.lit(text)), U.contrast_flag(F.lit("N/A"), F.lit(""))) == [True, False]


def test_markdown(spark):
    md = "# A\r\n#### B\n#C\n  - x\n* y\n2) z\n___\n***\n\np **b** and *i* `c`\nq\n\u2022 w\n"
    got = [(r.kind, r.lines) for r in U.markdown_blocks(spark.createDataFrame([(1, md)], "id int, t string"), "id", "t").orderBy("block").collect()]
    assert got == [("h3", 1), ("h4", 1), ("p", 1), ("ul", 2), ("ol", 1), ("hr", 1), ("hr", 1), ("p", 2), ("ul", 1)]
    spans = U.markdown_spans(spark.createDataFrame([(1, "p **b** and *i* `c` * no* **x *y* z** __s__")], "id int, t string"), "id", "t").orderBy("n").collect()
    assert [(r.kind, r.content) for r in spans] == [("strong", "b"), ("em", "i"), ("code", "c"), ("strong", "x *y* z"), ("strong", "s")]


def test_numbers_as_text(spark):
    assert one(spark, M.fmt(F.lit(1234.5)), M.fmt(F.lit(0.1), 0), M.fmt(F.lit(3.10), 1), M.direction_label(F.lit(-1.0), F.lit(0.5), F.lit(0.0)), M.direction_label(F.lit(0.0), F.lit(0.0), F.lit(1.0))) == ["1.234,5", "0", "3,1", "R", "S"]


def test_otsu_is_whole_and_air_shows_calibration(spark):
    from operator import attrgetter

    v = grid(spark, 8, "case when x < 2 then -1000 when x < 5 then 40 else 1201 end")
    t = R.otsu(v).first().threshold
    assert isinstance(t, int) and 40 <= t < 1201
    cbct = spark.createDataFrame([(0, True)], "series int, cbct boolean")
    assert [attrgetter("threshold")(R.suggest(v, c).first()) for c in (cbct, cbct.withColumn("cbct", F.lit(False)))] == [t, 200]


def test_dental_slice_defaults(spark):
    v = grid(spark, 12, "case when z = 3 and y > 2 then 1300 when z = 5 and y > 9 then 2600 else 0 end")
    assert R.dental_slice(v).first().slice == 3  # 12 of every other voxel from 2500 are too few
    assert R.dental_slice(v, least=10).first().slice == 5


def sphere(spark, n, radius, step):
    v = grid(spark, n, "0").where(f"z * {step} < {n}")
    r = F.sqrt((F.col("x") - n / 2) ** 2 + (F.col("y") - n / 2) ** 2 + (F.col("z") * step - n / 2) ** 2)
    return v.withColumn("hu", F.when(r <= radius, 1000).otherwise(-1000).cast("long"))


def test_shape_interpolation_follows_a_sphere(spark):
    v = sphere(spark, 32, 11, 4)
    areas = {}
    for method in ("shape", "linear"):
        d = K.reconstruct(v, 0, 1.0, (1.0, 1.0, 4.0), method, small_parts=False)
        areas[method] = [r.n for r in d.groupBy("z").agg(F.count_if(F.col("field") > 0).alias("n")).orderBy("z").collect()]
    radius = np.sqrt(np.asarray(areas["shape"]) / np.pi)
    want = np.sqrt(np.maximum(0, 121.0 - (np.arange(len(radius)) - 16.0) ** 2))
    inner = want > 5
    assert np.abs(radius - want)[inner].mean() < 0.6
    steps = {m: np.abs(np.diff(np.sqrt(np.asarray(a) / np.pi)))[8:24].max() for m, a in areas.items()}
    assert steps["shape"] < steps["linear"] * 0.75


def test_small_parts_go_and_thin_walls_stay_near_bone(spark):
    v = grid(spark, 20, "case when x < 8 and y < 8 and z < 8 then 1000 when x = 15 and y = 15 and z = 15 then 1000 when x = 8 and y < 8 and z < 8 then 130 when x = 17 and y < 3 then 130 else 40 end")
    d = K.reconstruct(v, 200, 1.0, thin=True)
    on = {(r.x, r.y, r.z) for r in d.where("field > 0").collect()}
    assert (4, 4, 4) in on and (8, 4, 4) in on and (15, 15, 15) not in on and (17, 1, 4) not in on
    assert d.where("x = 15 and y = 15 and z = 15").first().hu == 0
    assert R.soft_level(v).first().level == 40
    assert K.shrink_factor((100, 100, 10), (0.2, 0.2, 1.0), 1.0, 1e9) == 2 and K.shrink_factor((100, 100, 10), (1.0, 1.0, 1.0), 1.0, 3e4) == 2


def test_signed_distance_of_pixels_that_are_not_square(spark):
    rng = np.random.default_rng(0)
    m = rng.random((9, 13)) < 0.3
    v = spark.createDataFrame([(1, x, y, 0, int(m[y, x])) for y in range(9) for x in range(13)], "series int, x int, y int, z int, hu int")
    got = {(r.x, r.y): r.d for r in C.signed_distance(v, 1, 40.0, (0.4, 1.3), -2.0).collect()}
    for (x, y), d in got.items():
        far = min(np.hypot((x - a) * 0.4, (y - b) * 1.3) for b in range(9) for a in range(13) if m[b, a] != m[y, x])
        assert abs(d - (far - 0.2 if m[y, x] else 0.2 - far)) < 1e-4


def test_least_square_on_a_line():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = rng.integers(1, 40)
        at, cost, step = np.sort(rng.choice(60, n)).astype(float), rng.integers(0, 400, n).astype(float), rng.choice([0.4, 1.0, 1.3])
        cost[rng.random(n) < 0.3] = np.nan
        every = cost[None] + (step * (at[:, None] - at[None])) ** 2
        want = [np.nan if np.isnan(e).all() else np.nanmin(e) for e in every]
        assert np.allclose(C.least_square(at, cost, step), want, equal_nan=True, atol=1e-9)


def test_signed_distance_of_a_wide_slice_and_of_one_kind(spark):
    rng = np.random.default_rng(1)
    m = rng.random((17, 23)) < 0.1
    rows = [(1, x, y, 0, int(m[y, x])) for y in range(17) for x in range(23)] + [(1, x, y, z, z - 1) for y in range(2) for x in range(3) for z in (1, 2)] + [(1, 0, 0, 3, None)]
    got = {(r.z, r.x, r.y): r.d for r in C.signed_distance(spark.createDataFrame(rows, "series int, x int, y int, z int, hu int"), 1, 40.0, (0.4, 1.3), -2.0).collect()}
    assert len(got) == len(rows) and {d for (z, *_), d in got.items() if z in (1, 3)} == {-2.0} and {d for (z, *_), d in got.items() if z == 2} == {40.0}
    for (z, x, y), d in got.items():
        if z == 0:
            far = min(np.hypot((x - a) * 0.4, (y - b) * 1.3) for b in range(17) for a in range(23) if m[b, a] != m[y, x])
            assert abs(d - (far - 0.2 if m[y, x] else 0.2 - far)) < 1e-4
    assert C.signed_distance(spark.createDataFrame([], "series int, x int, y int, z int, hu int")).count() == 0


def series(spark, rows):
    names = "study long, id long, description string, modality string, frames int, rows_ int, spacing double, thickness double, px0 double, px1 double, nx double, ny double, nz double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, frame_of_reference string, colour boolean"
    box = (0.0, 200.0, 0.0, 200.0, 0.0, 150.0)
    return spark.createDataFrame([(1, i, "s", m, n, 512, sp, None, 0.5, 0.5, *normal, *box, "F", False) for i, m, n, sp, normal in rows], names)


def test_plan_of_coarse_series_fuses_and_a_fine_one_stands_alone(spark):
    ax, cor = (0.0, 0.0, 1.0), (0.0, 1.0, 0.0)
    coarse = [(1, "CT", 25, 5.6, ax), (2, "CT", 25, 5.5, cor), (3, "CT", 22, 6.0, ax), (4, "SR", 9, 1.0, ax)]
    got = {r.id: (r.role, r.place) for r in L.plan(series(spark, coarse)).collect()}
    assert got == {1: ("main", 1), 2: ("complementary", 2), 3: ("ignored", None), 4: ("ignored", None)}
    s = series(spark, coarse)
    e = L.effective(s, L.plan(s)).first()
    assert e.strategy == "fusion" and (e.ex, e.ey, e.ez) == (0.5, 0.5, 0.5) and abs(e.gap - (5.6 * 5.5) ** 0.5 / 2**0.5) < 1e-9
    fine = {r.id: r.role for r in L.plan(series(spark, [*coarse, (5, "CT", 280, 0.625, ax)])).collect()}
    assert [i for i, r in fine.items() if r == "main"] == [5] and "complementary" not in fine.values()


def test_files_to_reading(spark, tmp_path):
    from .test_segment import image

    for k in range(12):
        (tmp_path / f"{k}.dcm").write_bytes(image(np.arange(6, dtype="<i2").reshape(2, 3) + k, k))
    (tmp_path / "x.dcm").write_bytes(b"no")
    slices, summary, best, skipped = verbs.parse(spark, str(tmp_path))
    assert summary.first().images == 12 and best.count() == 1 and skipped.count() == 1
    v = verbs.build(slices)
    assert v.agg(F.max("z")).first()[0] == 11


def head(spark, n=40):
    """An upper block, a lower arch with teeth, loosely joined by a bridge; two air spaces within soft tissue."""
    v = grid(spark, n, "0")
    arch = "z between 6 and 11 and y between 6 and 34 and x between 6 and 33 and (x < 11 or x > 28 or y < 11)"
    tooth = "z between 12 and 16 and y between 6 and 10 and x between 10 and 29"
    air = "z between 26 and 30 and y between 16 and 24 and (x between 8 and 12 or x between 27 and 31)"
    soft = "x between 3 and 36 and y between 3 and 36"
    return v.withColumn("hu", F.expr(f"case when {tooth} then 2600 when {arch} then 900 when z between 20 and 36 and {soft} and not ({air}) and (x < 7 or x > 32 or y < 9 or z > 33) then 1000 when {air} then -950 when {soft} then 40 else -1000 end").cast("long"))


def test_labels_regions_and_reading_of_a_head(spark):
    v = head(spark)
    jaw = {"least": 500.0, "most": 9000.0, "tall": 2.0, "height": 0.6, "lowest": 0.3}
    d = verbs.label(v, 300, jaw=jaw, least=5).cache()
    n = {r.label: r["count"] for r in d.groupBy("label").count().collect()}
    assert n[3] >= 5 * 5 * 20 and n[5] == 2 * 5 * 9 * 5 and n.get(1, 0) > 0
    dims = d.groupBy("series").agg(F.lit(40).alias("nx"), F.lit(40).alias("ny"), F.lit(40).alias("nz"))
    rooms = sorted((r.volume, r.location) for r in M2.regions(d.where("label = 5"), dims, 150).collect())
    assert rooms == [(225.0, "left side, upper third, middle"), (225.0, "right side, upper third, middle")]
    told = verbs.analyze(d, least_jaw=500, least_third=200).collect()
    assert {r.section for r in told} == {"coverage", "jaw", "jaw_parts", "symmetry", "parts", "teeth", "air", "sinuses"}
    assert sum(r.section == "air" for r in told) == 2
    hits = spark.createDataFrame([(0, 20, 8, 14, 20.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "series int, hx int, hy int, hz int, px double, py double, pz double, ax double, ay double, az double")
    cut = verbs.split(d, hits, 10, plane=True)
    assert 0 < cut.where("label = 10").count() < n[3] and cut.where("label = 10").agg(F.min("x")).first()[0] == 20


def test_lookups_near_a_place(spark):
    v = grid(spark, 9, "0").withColumn("label", F.expr("case when x = 7 and y = 4 and z = 4 then 2 when x = 1 and y = 4 and z = 4 then 3 when z = 0 then 1 else 0 end"))
    p = spark.createDataFrame([(0, 1, 4, 4, 4), (0, 2, 6, 4, 4), (0, 3, 4, 8, 7)], "series int, id int, x int, y int, z int")
    assert {r.id: (r.x, r.label) for r in V.near(p, v).collect()} == {1: (1, 3), 2: (7, 2)}  # as near: the one met first
    assert {r.id: r.label for r in V.majority(p, v).collect()} == {1: 3, 2: 2}


def test_nearest_voxels_against_all_voxels(spark):
    rng = np.random.default_rng(5)
    held = [(s, *map(int, rng.integers(-6, 20, 3)), int(rng.integers(0, 3))) for s in (0, 1) for _ in range(400)]
    asked = [(k % 3, k, *map(int, rng.integers(-9, 23, 3))) for k in range(150)] + [(0, 150, None, 1, 1)]
    v, p = spark.createDataFrame(held, "series int, x int, y int, z int, label int"), spark.createDataFrame(asked, "series int, id int, x int, y int, z int")
    for radius in (0, 1, 4):
        want = {}
        for s, k, *at in asked[:-1]:
            near = [(sum((a - b) ** 2 for a, b in zip(q, at)), *q[::-1]) for t, *q, label in held if t == s and label and max(abs(a - b) for a, b in zip(q, at)) <= radius]
            if near:
                want[k] = min(near)[1:]
        assert {r.id: (r.z, r.y, r.x) for r in V.near(p, v, radius).collect()} == want
    assert V.near(p.limit(0), v).count() == V.near(p, v.limit(0)).count() == 0


def test_places_of_a_planes_image(spark):
    c = [F.lit(float(k)) for k in (3.25, 4.5, 6.5)]
    for plane in V.PLANES:
        for h, nz in ((21, 11), (1, 1)):
            p = V.to_volume(plane, F.lit(7.0), F.lit(float(h // 3)), c, F.lit(h), F.lit(nz))
            assert one(spark, *V.from_volume(plane, p, F.lit(h), F.lit(nz))) == pytest.approx([7.0, h // 3])
    assert one(spark, *V.to_volume("coronal", F.lit(7.0), F.lit(0.0), c, F.lit(21), F.lit(11))) == [7.0, 4.5, 10.0]  # the last slice on top
    assert one(spark, *V.turn_to("axial", c, F.lit(99), F.lit(11))) == [3.25, 4.5, 10.0] and one(spark, *V.turn_to("axial", c, F.lit(7), F.lit(11))) == [3.25, 4.5, 6.5]
    assert one(spark, *V.move_to("sagittal", F.lit(7.0), F.lit(8.0), c, F.lit(21), F.lit(11))) == [3.25, 7.0, 6.0]
    vert = spark.createDataFrame([(1, 1, 0.0, 1.0, 2.0), (1, 1, 4.0, -1.0, 2.0), (1, 2, 9.0, 0.0, 0.0)], "series int, layer int, x double, y double, z double")
    assert {r.layer: tuple(r)[2:] for r in V.bounds(vert, ["series"]).collect()} == {1: (0, 4, -1, 1, 2, 2), 2: (9, 9, 0, 0, 0, 0), None: (0, 9, -1, 1, 0, 2)}


def test_marks_of_a_canal(spark):
    curve = spark.createDataFrame([(0, k, float(k), 5.0, 0.0, -1.0) for k in range(12)], "series int, col int, px double, py double, ox double, oy double")
    points = spark.createDataFrame([(0, 1, 3.2, 4.0, 0.0), (0, 2, 6.1, 7.0, 9.0), (0, 3, 8.0, 5.0, 4.5)], "series int, id int, px double, py double, pz double")
    dims = spark.createDataFrame([(0, 10)], "series int, nz int")
    got = {(r.view, r.id): (round(r.u, 6), r.v) for r in PN.canal_marks(points, curve, dims, 5).collect()}
    assert got == {("pano", 1): (3.0, 9.0), ("pano", 2): (6.0, 0.0), ("pano", 3): (8.0, 4.5), ("cross", 1): (21.0, 9.0), ("cross", 2): (18.0, 0.0)}
    assert one(spark, PN.shown(F.lit(600.0)), PN.shown(F.lit(2950.0), "mip")) == pytest.approx([127.5, 255.0])


def test_structures_are_numbered_up_to_the_last(spark):
    have = spark.createDataFrame([(1, 2, "jaw", "bone"), (1, 4, "metal", "metal")], "series int, id long, name string, base string")
    new = spark.createDataFrame([(1, k, 4 if k % 2 else 2, f"n{k}") for k in range(4)], "series int, at int, of long, name string")
    got = {r.id: (r.name, r.base) for r in W.register(have, new, last=12).collect()}
    assert got == {2: ("jaw", "bone"), 4: ("metal", "metal"), 10: ("n0", "bone"), 11: ("n1", "metal"), 12: ("n2", "bone")}


def test_fused_quality_keeps_other_warnings(spark):
    e = spark.createDataFrame([(1, "fusion", 2, 0.5, 0.5, 0.5, 3.93), (2, "single", 1, 1.0, 1.0, 1.0, 1.0)], "study int, strategy string, n_used long, ex double, ey double, ez double, gap double")
    w = spark.createDataFrame([(1, ["thick slices", "few slices", "lossy"])], "study int, warnings array<string>")
    r = Q.fused(e, w).collect()
    assert len(r) == 1 and (r[0].score, r[0].level) == (60, "moderate") and r[0].warnings[1:] == ["lossy"] and r[0].warnings[0].startswith("fused from 2")


def test_equalisation_of_sides_that_tiles_do_not_divide(spark):
    p = spark.createDataFrame([(1, x, y, 100.0 + 40 * x / 36) for x in range(37) for y in range(29)], "img int, x int, y int, v double")
    got = E.clahe(p, 3.0, 4, 37, 29)
    r = got.agg(F.count("*"), F.min("v"), F.max("v")).first()
    assert r[0] == 37 * 29 and r[1] >= 0 and r[2] <= 255.001 and r[2] - r[1] > 1.4 * 40
