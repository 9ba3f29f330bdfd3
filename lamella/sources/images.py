"""Pictures (PNG, JPEG, GIF, BMP) as pixel rows, through Spark's ``image`` source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: most pixels along a side
SIDE = 2000


def reduced(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """``a`` (rows, columns, channels) as ``height`` x ``width`` means over the area that each pixel covers."""
    for axis, m in enumerate((height, width)):
        n = a.shape[axis]
        if m == n:
            continue
        total = np.concatenate([np.zeros_like(a.take([0], axis)), np.cumsum(a, axis=axis)], axis=axis)
        edge = np.arange(m + 1) * (n / m)
        low = np.minimum(edge.astype(np.int64), n - 1)
        part = (edge - low).reshape([-1 if k == axis else 1 for k in range(3)])
        at = total.take(low, axis) * (1 - part) + total.take(low + 1, axis) * part
        a = np.diff(at, axis=axis) * (m / n)
    return a


def read_images(spark: SparkSession, path: str, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """(pixels, skipped): (img, x, y, red, green, blue) of the pictures below ``path``, longer sides reduced to ``side``; and the paths that cannot be read.

    A task decodes one picture at a time.  Transparency is not kept; gray pictures have three equal channels.
    """
    d = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(path).select("image.*")
    names = ["img", "x", "y", "red", "green", "blue"]

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                h, w, k = r["height"], r["width"], r["nChannels"]
                a = np.frombuffer(r["data"], np.uint8).reshape(h, w, k).astype(float)
                a = np.repeat(a, 3, axis=2) if k == 1 else a[:, :, 2::-1]  # blue comes first
                scale = min(1.0, side / max(h, w))
                a = reduced(a, max(1, int(h * scale + 0.5)), max(1, int(w * scale + 0.5)))
                y, x = np.indices(a.shape[:2], dtype=np.int32)
                step = max(1, (1 << 18) // a.shape[1])
                for lo in range(0, len(a), step):  # some lines at a time
                    part = slice(lo, lo + step)
                    flat = a[part].reshape(-1, 3)
                    yield pa.RecordBatch.from_arrays([pa.array([r["origin"]] * len(flat)), pa.array(x[part].ravel()), pa.array(y[part].ravel()), *(pa.array(c) for c in flat.T)], names=names)

    good = d.where("height > 0 and width > 0 and nChannels > 0")
    pixels = good.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "img string, x int, y int, red double, green double, blue double")
    return pixels, d.where(~F.coalesce((F.col("height") > 0) & (F.col("width") > 0) & (F.col("nChannels") > 0), F.lit(False))).select("origin")
