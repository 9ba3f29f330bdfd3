"""Files, surfaces and objects against phantoms."""

import io
import math
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamella.operators import fusion, segment, surface
from lamella.sources import dicom, stl


def element(group, number, kind, value, explicit=True):
    value += b" " * (len(value) % 2)
    head = struct.pack("<HH", group, number)
    if not explicit:
        return head + struct.pack("<I", len(value)) + value
    return head + kind + (b"\0\0" + struct.pack("<I", len(value)) if kind in dicom.LONG else struct.pack("<H", len(value))) + value


def image(pixels, k=0, explicit=True, photometric=b"MONOCHROME2", syntax=None, more=()):
    syntax = syntax or (dicom.EXPLICIT if explicit else dicom.IMPLICIT)
    short = lambda n: struct.pack("<H", n)
    body = [
        (0x0008, 0x0060, b"CS", b"CT"), (0x0008, 0x1140, b"SQ", b""), (0x0020, 0x000E, b"UI", b"1.2.3"), (0x0020, 0x0013, b"IS", str(k + 1).encode()), (0x0020, 0x0032, b"DS", f"0\\0\\{5 - k}".encode()),
        (0x0020, 0x0037, b"DS", b"1\\0\\0\\0\\1\\0"), (0x0028, 0x0002, b"US", short(1)), (0x0028, 0x0004, b"CS", photometric), (0x0028, 0x0010, b"US", short(pixels.shape[-2])), (0x0028, 0x0011, b"US", short(pixels.shape[-1])),
        *more, (0x0028, 0x0100, b"US", short(16)), (0x0028, 0x0103, b"US", short(1)), (0x0028, 0x1052, b"DS", b"-1000"), (0x0028, 0x1053, b"DS", b"2"), (0x7FE0, 0x0010, b"OW", pixels.astype("<i2").tobytes()),
    ]
    return b"\0" * 128 + b"DICM" + element(2, 0x0010, b"UI", syntax.encode()) + b"".join(element(*e, explicit) for e in body)


def test_slices(spark, tmp_path):
    px = np.arange(6).reshape(2, 3)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.dcm").write_bytes(image(px, 0))
    (tmp_path / "b").write_bytes(image(px + 10, 1, explicit=False))
    (tmp_path / "bad.dcm").write_bytes(b"nothing")
    (tmp_path / "short.dcm").write_bytes(image(px)[:-4])
    (tmp_path / "jpeg.dcm").write_bytes(image(px, syntax="1.2.840.10008.1.2.4.70"))
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("c", image(px, 2, photometric=b"MONOCHROME1"))
        z.writestr("__MACOSX/c", b"x")
        z.writestr(".hidden", b"x")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("inner.zip", inner.getvalue())
    (tmp_path / "d.zip").write_bytes(outer.getvalue())
    (tmp_path / "e.zip").write_bytes(b"PK\x03\x04 no archive")
    rows = {r["name"]: r for r in dicom.read_slices(spark, str(tmp_path)).collect()}
    assert sorted(k for k, r in rows.items() if r["error"] is None) == ["a.dcm", "b", "c"]
    assert sorted(k for k, r in rows.items() if r["error"]) == ["bad.dcm", "e.zip", "jpeg.dcm", "short.dcm"]
    assert rows["a.dcm"]["hu"] == [-1000 + 2 * i for i in range(6)] and rows["c"]["hu"] == rows["a.dcm"]["hu"][::-1]
    assert {rows[k]["series_key"] for k in ("a.dcm", "b", "c")} == {"1.2.3|2x3|1.00,0.00,0.00,0.00,1.00,0.00"}
    v = dicom.slice_voxels(dicom.read_slices(spark, str(tmp_path)))
    got = {(r.z, r.y, r.x): r.hu for r in v.collect()}
    assert len(got) == 18 and got[2, 1, 2] == -990 and got[1, 0, 0] == -980 and got[0, 0, 0] == -990


def ball(spark, n, r):
    grid = spark.range(n**3).select(F.lit(1).alias("series"), *((F.floor(F.col("id") / n**i) % n).cast("int").alias(c) for i, c in enumerate("xyz")))
    m = (n - 1) / 2
    return grid.withColumn("hu", 100 * (r - F.sqrt((F.col("x") - m) ** 2 + (F.col("y") - m) ** 2 + (F.col("z") - m) ** 2)))


def test_surface_of_ball(spark, tmp_path):
    t = surface.triangles(ball(spark, 20, 7), 0)
    got = surface.area(t).first()
    assert got.area == pytest.approx(4 * math.pi * 49, rel=0.03)
    volume = t.select(sum((F.col("a")[x] * (F.col("b")[y] * F.col("c")[z] - F.col("b")[z] * F.col("c")[y]) for x, y, z in ("xyz", "yzx", "zxy")), F.lit(0.0)).alias("v")).agg(F.sum("v") / 6).first()[0]
    assert volume == pytest.approx(4 / 3 * math.pi * 343, rel=0.03)  # positive: normals point out, and the surface is closed
    made = stl.write_stl(t, f"file://{tmp_path}/out", "ball").collect()
    with open(made[0]["path"], "rb") as f:
        data = f.read()
    assert made[0]["triangles"] == got.triangles and len(data) == 84 + 50 * got.triangles and data[:4] == b"ball"
    normals = np.frombuffer(data, stl.FACET, offset=84)["normal"]
    assert np.allclose(np.linalg.norm(normals, axis=1), 1, atol=1e-4) | (normals == 0).all()
    assert surface.triangles(ball(spark, 6, -50), 0).count() == 0


def test_metal_kinds(spark):
    rows = [(1, x, y, 5, 3000) for x in range(20) for y in (4, 5)] + [(1, x, y, 30, 3000) for x in range(20) for y in range(10)]
    rows += [(1, 30, 30, 50, 3000), (2, 0, 0, 0, 1000)]
    v = spark.createDataFrame(rows, "series int, x int, y int, z int, hu int")
    got = {r.kind: r for r in segment.metal_objects(v, 2000, 1500, (0.5, 0.5, 0.5)).collect()}
    assert set(got) == {"screw", "plate"} and got["screw"].length == pytest.approx(10, abs=0.5) and got["plate"].thickness == pytest.approx(0.5)
    assert segment.metal_objects(v.limit(0), 2000, 1500).count() == 0


def test_fusion_uncovered(spark):
    grid = spark.createDataFrame([(1, 1, 1, 4)], "study int, gx int, gy int, gz int")
    vox = spark.createDataFrame([(7, 0, 0, 0, 10), (7, 0, 0, 1, 20)], "series int, x int, y int, z int, hu int")
    maps = spark.createDataFrame([(1, 7, 1, 1, 2, 1.0, 1.5, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.0])], "study int, series int, nx int, ny int, nz int, sz double, sigma double, m array<double>")
    got = {r.z: r.value for r in fusion.fuse(grid, maps, vox).collect()}
    assert got == {0: 10, 1: 15, 2: 20, 3: 20}
    assert fusion.fuse(grid, maps.limit(0), vox).agg(F.max("value")).first()[0] == -1024


def naive_filter(x, faces, steps):
    """The smoothing polynomial with neighbours looked up vertex by vertex."""
    near, used = {}, {}
    for f in faces:
        for a, b in ((0, 1), (1, 2), (2, 0)):
            i, j = f[a], f[b]
            near.setdefault(i, set()).add(j), near.setdefault(j, set()).add(i)
            used[min(i, j), max(i, j)] = used.get((min(i, j), max(i, j)), 0) + 1
    fixed = {i for e, n in used.items() if n == 1 for i in e}
    rough = lambda y: {i: np.zeros(3) if i in fixed else y[i] - sum(y[j] for j in near[i]) / len(near[i]) for i in y}
    c = surface.filter_weights(steps)
    before = dict(x)
    d = rough(before)
    now = {i: before[i] - d[i] / 2 for i in x}
    out = {i: c[0] * before[i] + c[1] * now[i] for i in x}
    for k in range(2, steps + 1):
        d = rough(now)
        before, now = now, {i: 2 * now[i] - before[i] - d[i] for i in x}
        out = {i: out[i] + c[k] * now[i] for i in x}
    return {i: x[i] if i in fixed else out[i] for i in x}


def test_meshes_share_vertices_and_are_closed(spark):
    v = ball(spark, 24, 8).withColumn("field", F.col("hu") / 100)
    tri = surface.cut(v, side=7).cache()
    raw = surface.measures(tri, surface.vertices(tri, 0)).first()
    assert raw.vertices - raw.edges + raw.triangles == 2 and 3 * raw.triangles == 2 * raw.edges
    vert = surface.vertices(tri)
    fine = surface.measures(tri, vert).first()
    want = 4 / 3 * math.pi * 512
    assert fine.volume == pytest.approx(want, rel=0.01) and fine.area == pytest.approx(4 * math.pi * 64, rel=0.01)
    at = surface.to_patient(vert, (1.0, 1.0, 1.0)).toPandas()
    out = (at[["x", "y", "z"]].to_numpy() - 11.5) / 8
    assert ((out * at[["nx", "ny", "nz"]].to_numpy()).sum(1) > 0.97).all()


def test_smoothing_by_bricks_is_that_of_the_whole(spark):
    """Bricks of few places give the same vertices as one mesh does, open borders and touching layers included."""
    grid = spark.range(14 * 12 * 10).select(F.lit(3).alias("series"), (F.col("id") % 14).cast("int").alias("x"), (F.floor(F.col("id") / 14) % 12).cast("int").alias("y"), F.floor(F.col("id") / 168).cast("int").alias("z"))
    v = grid.withColumn("field", F.sin(F.col("x") * 1.1) + F.cos(F.col("y") * 0.9) + F.sin(F.col("z") * 0.7 + F.col("x")))
    v = v.withColumn("label", F.when(F.col("field") > 0.3, F.when(F.col("x") < 7, 1).otherwise(2)).otherwise(0)).cache()
    tri = surface.cut(v, "field", "label", side=5).cache()
    rows = tri.collect()
    for layer in (1, 2):
        own = [r for r in rows if r.layer == layer]
        spots = {k: np.array(r.p[3 * i : 3 * i + 3]) for r in own for i, k in enumerate((r.a, r.b, r.c))}
        want = naive_filter(spots, [(r.a, r.b, r.c) for r in own], 4)
        for side in (4, 64):
            got = {r.vid: (r.x, r.y, r.z) for r in surface.vertices(tri, 4, side=side).where(F.col("layer") == layer).collect()}
            assert set(got) == set(want) and max(np.abs(np.array(got[k]) - want[k]).max() for k in got) < 1e-9
    # a mesh is wound alike throughout: each edge is used once each way, or lies on the border
    way = {}
    for r in rows:
        for e in ((r.a, r.b), (r.b, r.c), (r.c, r.a)):
            way[r.layer, *e] = way.get((r.layer, *e), 0) + 1
    assert set(way.values()) == {1}
    assert {r.layer for r in rows} == {1, 2} and surface.cut(v.where("false"), "field", "label").count() == 0


def test_mesh_in_the_patients_coordinates(spark):
    v = ball(spark, 12, 4).withColumn("field", F.col("hu"))
    c, s = math.cos(0.5), math.sin(0.5)
    tri, vert = surface.layer_meshes(v.withColumn("label", (F.col("hu") > 0).cast("int") * 9), steps=0, spacing=(1.0, 1.0, 2.0), origin=(5.0, -3.0, 1.0), direction=(c, s, 0.0, -s, c, 0.0, 0.0, 0.0, 1.0))
    p = vert.toPandas()
    turned = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    index = (p[["x", "y", "z"]].to_numpy() - [5, -3, 1]) @ turned / [1, 1, 2]
    assert np.linalg.norm(index - 5.5, axis=1) == pytest.approx(4.6, abs=0.6)  # the field is steeper inside
    assert np.linalg.norm(p[["nx", "ny", "nz"]].to_numpy(), axis=1) == pytest.approx(1)
    index = surface.vertices(surface.cut(v.withColumn("label", (F.col("hu") > 0).cast("int") * 9), "field", "label"), 0)
    assert surface.measures(tri, vert).first().volume == pytest.approx(2 * surface.measures(tri, index).first().volume)
    assert vert.select("layer").distinct().first()[0] == 9


def test_fusion_by_bricks_against_place_by_place(spark):
    """Three turned stacks on a grid of several bricks, against a plain loop."""
    rng = np.random.default_rng(8)
    shapes = {1: (21, 18, 6), 2: (9, 20, 19), 3: (5, 5, 5)}
    data = {s: rng.integers(-900, 900, n[::-1]) for s, n in shapes.items()}
    vox = spark.createDataFrame([(s, x, y, z, int(a[z, y, x])) for s, a in data.items() for z, y, x in np.ndindex(a.shape)], "series int, x int, y int, z int, hu int")
    m = {1: [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0.3, 0], 2: [0, 0, 0.5, -1.0, 0.1, 1, 0, -0.5, 0.9, -0.1, 0, 0.2], 3: [0.3, 0, 0, -3.2, 0, 0.3, 0, -2, 0, 0, 0.3, -1]}
    maps = spark.createDataFrame([(0, s, *shapes[s], 2.5, 1.2, [float(k) for k in m[s]]) for s in m], "study int, series int, nx int, ny int, nz int, sz double, sigma double, m array<double>")
    grid = spark.createDataFrame([(0, 20, 19, 18)], "study int, gx int, gy int, gz int")
    want = {}
    for x, y, z in np.ndindex(20, 19, 18):
        top = low = 0.0
        for s, a in data.items():
            u, v, w = (m[s][4 * r] * x + m[s][4 * r + 1] * y + m[s][4 * r + 2] * z + m[s][4 * r + 3] for r in range(3))
            nx, ny, nz = shapes[s]
            if u < 0 or v < 0 or w < -0.5 or u > nx - 1 or v > ny - 1 or w > nz - 0.5:
                continue
            w = min(nz - 1, max(0, w))
            f = [int(np.floor(c)) for c in (u, v, w)]
            value = 0
            for e in np.ndindex(2, 2, 2):
                share = np.prod([(c - i) if d else 1 - (c - i) for c, i, d in zip((u, v, w), f, e, strict=True)])
                if share > 0:
                    value += share * a[f[2] + e[2], f[1] + e[1], f[0] + e[0]]
            weight = 0.02 + math.exp(-((abs(w - math.floor(w + 0.5)) * 2.5 / 1.2) ** 2))
            top, low = top + weight * value, low + weight
        want[x, y, z] = math.floor(round(top / low, 9) + 0.5) if low else -1024
    for side in (5, 16):
        got = {(r.x, r.y, r.z): r.value for r in fusion.fuse(grid, maps, vox, side).collect()}
        assert got == want
    assert -1024 in want.values()


def shell(p):
    """A hollow ball, an oblique plate and a rod, as one would scan them: 1000 inside, -1000 elsewhere."""
    x, y, z = p
    r = np.sqrt(x * x + y * y + z * z)
    plate = (np.abs(x * 0.5 + y * 0.3 + z * 0.81 - 2) < 0.9) & (r < 14)
    rod = (np.hypot(x - 3, y + 4) < 1.5) & (np.abs(z) < 18)
    return np.where((np.abs(r - 15) < 1.2) | plate | rod, 1000, -1000)


def test_fused_study_is_nearer_to_the_truth_than_its_main_series(spark):
    """Axial, coronal and sagittal stacks with gaps of 4 mm of one object."""
    n, gap, half = 41, 4.0, 20.0
    turn = {1: np.eye(3), 2: np.array([[1.0, 0, 0], [0, 0, 1.0], [0, 1.0, 0]]), 3: np.array([[0, 1.0, 0], [0, 0, 1.0], [1.0, 0, 0]])}
    rows, geo = [], []
    for s, axes in turn.items():
        count = int(2 * half / gap) + 1
        k, j, i = np.meshgrid(np.arange(count), np.arange(n), np.arange(n), indexing="ij")
        origin = -half * axes.sum(0)
        p = origin[:, None, None, None] + sum(axes[a][:, None, None, None] * c * mm for a, (c, mm) in enumerate(((i, 1.0), (j, 1.0), (k, gap))))
        rows.append(pd.DataFrame({"series": s, "x": i.ravel(), "y": j.ravel(), "z": k.ravel(), "hu": shell(p).ravel()}))
        geo.append((1, s, s, n, n, count, 1.0, 1.0, gap, origin.tolist(), axes.ravel().tolist()))
    vox = spark.createDataFrame(pd.concat(rows))
    geo = spark.createDataFrame(geo, "study int, series long, place int, nx int, ny int, nz int, sx double, sy double, sz double, origin array<double>, direction array<double>")
    volume, grids = fusion.fuse_study(geo, vox)
    g = grids.first()
    assert (g.s, g.gx, g.gy, g.gz, g["at"]) == (1.0, 41, 41, 41, [-20.0] * 3)
    alone, _ = fusion.fuse_study(geo.where("place = 1"), vox)
    z, y, x = np.meshgrid(*[np.arange(41)] * 3, indexing="ij")
    truth = shell((x - half, y - half, z - half)) > 0

    def dice(d):
        got = np.zeros((41,) * 3, bool)
        p = d.where("value > 0").toPandas()
        got[p["z"], p["y"], p["x"]] = True
        return 2 * (got & truth).sum() / (got.sum() + truth.sum())

    both, one = dice(volume), dice(alone)
    assert both > 0.7 and both > one + 0.1
    with pytest.raises(Exception, match="budget"):
        fusion.fuse_study(geo, vox, 0.5)[1].collect()
