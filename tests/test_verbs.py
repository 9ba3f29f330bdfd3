"""Files of several frames, the data source, and the verbs from end to end on phantoms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamella import verbs
from lamella.operators import findings, segment, surface
from lamella.sources import dicom

from .test_segment import image


def frames(n, rows=4, cols=3):
    return (np.arange(n * rows * cols).reshape(n, rows, cols) * 3) % 97


def test_one_file_of_several_frames(spark, tmp_path):
    px = frames(5)
    (tmp_path / "m.dcm").write_bytes(image(px, 0, more=[(0x0018, 0x0088, b"DS", b"2.5 "), (0x0028, 0x0008, b"IS", b"5 ")]))
    slices, summary, best, skipped = verbs.parse(spark, str(tmp_path))
    s = summary.first()
    assert (s.images, s.frames, s.middle_frame, s.spacing) == (1, 5, 2, 2.5) and skipped.count() == 0
    assert s.z1 - s.z0 == pytest.approx(4 * 2.5) and best.count() == 1  # the box reaches to the last frame
    v = {(r.z, r.y, r.x): r.hu for r in verbs.build(slices).collect()}
    assert len(v) == 60 and all(v[z, y, x] == -1000 + 2 * px[z, y, x] for z, y, x in v)
    assert slices.agg(F.max("thickness")).first()[0] == 2.5


def test_frames_of_several_files_count_once(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.dcm").write_bytes(image(frames(2), k, more=[(0x0028, 0x0008, b"IS", b"2 ")]))
    slices, summary, _, _ = verbs.parse(spark, str(tmp_path))
    assert slices.count() == 3 and (summary.first().images, summary.first().frames, summary.first().middle_frame) == (3, 6, None)
    (tmp_path / "short.dcm").write_bytes(image(frames(2), 1, more=[(0x0028, 0x0008, b"IS", b"9 ")]))
    assert "cut short" in verbs.parse(spark, str(tmp_path))[3].first().error


def test_data_source_plans_partitions_by_bytes(spark, tmp_path):
    assert dicom.planned([5, 5, 5, 20, 1], 10) == [[0, 1], [2], [3], [4]] and dicom.planned([], 10) == []
    for k in range(6):
        (tmp_path / f"{k}.dcm").write_bytes(image(frames(2), k, more=[(0x0028, 0x0008, b"IS", b"2 ")]))
    (tmp_path / "bad").write_bytes(b"nothing")
    spark.dataSource.register(dicom.SliceSource)
    d = spark.read.format("slices").option("bytes", 600).load(str(tmp_path))
    assert d.rdd.getNumPartitions() > 2
    key = lambda df: sorted((r.name, r.frame if r.frame is not None else -1, r.hu or [], r.error or "") for r in df.collect())
    assert key(d) == key(dicom.read_slices(spark, str(tmp_path))) and dicom.skipped(d).count() == 1
    assert spark.read.format("slices").load(str(tmp_path / "3.dcm")).count() == 2


def phantom(spark, n=32):
    """A bone ball with a metal rod in it, soft tissue around."""
    z, y, x = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
    m = (n - 1) / 2
    r = np.sqrt((x - m) ** 2 + (y - m) ** 2 + (z - m) ** 2)
    hu = np.where(r < 10, 1000, np.where(r < 14, 60, -1000))
    rod = (np.hypot(x - m, y - m) < 1.3) & (np.abs(z - m) < 7)
    hu = np.where(rod, 3071, hu)
    return spark.createDataFrame(pd.DataFrame({"series": 1, "x": x.ravel(), "y": y.ravel(), "z": z.ravel(), "hu": hu.ravel()}).astype({"series": "int32", "x": "int32", "y": "int32", "z": "int32"})), int(rod.sum())


def test_recon_labels_and_layers(spark):
    v, rod = phantom(spark)
    r = verbs.recon(v, 300, 1.0, steps=4)
    o = r.objects.collect()
    assert len(o) == 1 and o[0].kind == "screw" and o[0].volume == rod and r.metal.count() == rod
    assert "1 piece(s): 1 screw(s)" in " ".join(x.note for x in r.notes.collect())
    # bone next to metal is cut out, the metal has its own closed surface
    assert r.field.where("field > 0").join(r.metal, segment_place(), "left_semi").count() == 0
    m = {x.layer: x for x in surface.measures(r.triangles, r.vertices).collect()}
    assert set(m) == {0, 4} and m[4].vertices - m[4].edges + m[4].triangles == 2
    assert rod / 3 < m[4].volume < 2 * rod

    d = verbs.label(r.field, 300, metal=r.metal, least=5)
    n = {x.label: x["count"] for x in d.groupBy("label").count().collect()}
    assert n[4] == rod and n[1] > 1000
    table, tri, vert = verbs.layers(d, 300)
    rows = {x.layer: x for x in table.collect()}
    assert (rows[4].name, rows[4].base, rows[4].volume) == ("metal", "metal", rod)
    assert {x.layer for x in vert.select("layer").distinct().collect()} == set(rows) and tri.count() > 0
    told = {x.section: x.line for x in verbs.analyze(d, r.objects).collect()}
    assert told["metal"].startswith("screw: ") and "next to skull" in told["metal"]


def segment_place():
    return ["series", "x", "y", "z"]


def test_recon_within_a_budget_and_without_metal(spark):
    v, _ = phantom(spark)
    r = verbs.recon(v.withColumn("hu", F.least("hu", F.lit(1000))), 300, 1.0, budget=32**3 / 3, steps=0)
    assert r.spacing == (2.0, 2.0, 1.0) and r.objects.count() == 0 and r.field.where("metal_field is not null").count() == 0
    assert any("shrunk" in x.note for x in r.notes.collect())
    m = surface.measures(r.triangles, r.vertices).collect()
    assert [x.layer for x in m] == [0] and m[0].volume == pytest.approx(4 / 3 * math.pi * 1000, rel=0.2)


def test_study_of_two_stacks_from_files(spark, tmp_path):
    """An axial and a coronal stack of one ball become one volume."""
    n, step = 17, 4
    c = np.arange(n) - 8.0
    at = [(k, t) for k in ("ax", "cor") for t in range(0, n, step)]
    for k, t in at:
        u, w = np.meshgrid(c, c, indexing="xy")
        r = np.sqrt(u * u + w * w + (t - 8.0) ** 2)
        facing = b"1\\0\\0\\0\\1\\0" if k == "ax" else b"1\\0\\0\\0\\0\\-1"
        place = f"-8\\-8\\{t - 8}" if k == "ax" else f"-8\\{t - 8}\\8"
        raw = np.where(r < 6, 1000, 0)
        data = image(raw, t, more=[(0x0020, 0x000E, b"UI", k.encode().ljust(4, b"\0")), (0x0020, 0x0037, b"DS", facing.ljust(len(facing) + len(facing) % 2)), (0x0020, 0x0032, b"DS", place.encode().ljust(len(place) + len(place) % 2)), (0x0028, 0x0030, b"DS", b"1\\1 ")])
        (tmp_path / f"{k}{t}.dcm").write_bytes(data)
    slices, summary, _, skipped = verbs.parse(spark, str(tmp_path))
    assert skipped.count() == 0 and summary.count() == 2
    used = summary.select(F.lit(1).alias("study"), "series", F.when(F.col("series").startswith("ax"), 1).otherwise(2).alias("place"))
    volume, grids = verbs.build_study(slices, used)
    g = grids.first()
    assert (g.s, g.gx, g.gy, g.gz, g["at"]) == (1.0, 17, 17, 17, [-8.0, -8.0, -8.0])
    p = volume.toPandas()
    truth = np.sqrt(((p[["x", "y", "z"]] - 8) ** 2).sum(1)) < 6
    inside = p.hu > 0
    assert len(p) == 17**3 and 2 * (truth & inside).sum() / (truth.sum() + inside.sum()) > 0.9
    alone, _ = verbs.build_study(slices, used.where("place = 1"))
    q = alone.toPandas().set_index(["x", "y", "z"]).hu.reindex(pd.MultiIndex.from_frame(p[["x", "y", "z"]])).to_numpy() > 0
    assert 2 * (truth.to_numpy() & q).sum() / (truth.sum() + q.sum()) < 2 * (truth & inside).sum() / (truth.sum() + inside.sum())


def test_readings_of_axes_that_are_not_the_patients(spark):
    v, _ = phantom(spark, 16)
    d = v.withColumn("label", F.when(F.col("hu") == 1000, 1).otherwise(0))
    assert findings.symmetry(d, findings.references(d), 1).count() == 3
    assert "symmetry" not in {r.section for r in findings.reading(d, aligned=False).collect()}


def test_small_regions_are_cleared(spark):
    v = spark.createDataFrame([(1, x, 0, 0) for x in range(5)] + [(1, 9, 9, 9)], "series int, x int, y int, z int")
    assert segment.keep_regions(v, 3).count() == 5
