"""Pictures read, reduced, made gray and enhanced."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import enhance
from lamella.sources import images


def png(a):
    """(rows, columns, 3) of bytes as a PNG file."""
    raw = b"".join(b"\0" + line.tobytes() for line in a.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pictures_to_gray_and_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (6, 10, 3))
    (tmp_path / "a.png").write_bytes(png(a))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    pixels, skipped = images.read_images(spark, str(tmp_path))
    got = {(r.y, r.x): (r.red, r.green, r.blue) for r in pixels.collect()}
    assert len(got) == 60 and all(got[y, x] == tuple(a[y, x]) for y, x in got)
    assert [r.origin.rsplit("/", 1)[-1] for r in skipped.collect()] == ["bad.png"]
    gray = pixels.select("img", "x", "y", enhance.to_gray(F.col("red"), F.col("green"), F.col("blue")).alias("v"))
    back = {(r.y, r.x): r.c.r for r in gray.select("x", "y", enhance.to_rgba(F.col("v")).alias("c")).collect()}
    assert all(back[y, x] == round(float(a[y, x] @ [0.299, 0.587, 0.114])) for y, x in back)


def test_long_sides_are_reduced(spark, tmp_path):
    a = np.repeat(np.repeat(np.arange(12).reshape(3, 4, 1) * 20, 3, axis=2), 2, axis=0).repeat(2, axis=1)
    (tmp_path / "a.png").write_bytes(png(a))
    pixels, _ = images.read_images(spark, str(tmp_path), side=4)
    got = {(r.y, r.x): r.red for r in pixels.collect()}
    assert got == {(y, x): pytest.approx((y * 4 + x) * 20) for y in range(3) for x in range(4)}
    b = np.random.default_rng(1).random((7, 5, 3))
    small = images.reduced(b, 3, 2)
    assert small.shape == (3, 2, 3) and small.mean((0, 1)) == pytest.approx(b.mean((0, 1)))
