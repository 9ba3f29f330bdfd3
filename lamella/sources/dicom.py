"""Uncompressed little-endian DICOM slices, loose or in ZIP archives, as rows: one a frame.

``read_slices`` takes files from Spark's ``binaryFile`` source, and ``SliceSource`` is a data source of its own (format ``slices``), whose
partitions are planned by the files' sizes.  What cannot be read gives a row with ``error`` set and no pixels, so that good and bad files
are told apart by a filter (``skipped``).
"""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalar import cross, normalize

#: fixed values: the two transfer syntaxes that are read, (group, element) of the tags that are kept, representations with a 4-byte length
IMPLICIT, EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
TAGS = {
    "transfer_syntax": (0x0002, 0x0010), "modality": (0x0008, 0x0060), "study_description": (0x0008, 0x1030), "series_description": (0x0008, 0x103E), "contrast_agent": (0x0018, 0x0010), "thickness": (0x0018, 0x0050), "step": (0x0018, 0x0088), "frames": (0x0028, 0x0008),
    "series_uid": (0x0020, 0x000E), "series_number": (0x0020, 0x0011), "instance": (0x0020, 0x0013), "position": (0x0020, 0x0032), "orientation": (0x0020, 0x0037), "samples": (0x0028, 0x0002), "photometric": (0x0028, 0x0004),
    "rows": (0x0028, 0x0010), "cols": (0x0028, 0x0011), "pixel_spacing": (0x0028, 0x0030), "bits": (0x0028, 0x0100), "signed": (0x0028, 0x0103), "intercept": (0x0028, 0x1052), "slope": (0x0028, 0x1053), "pixels": (0x7FE0, 0x0010),
}
LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT"}
SHORTS = {"samples", "rows", "cols", "bits", "signed"}

SCHEMA = (
    "path string, name string, error string, series_key string, series_uid string, series_number int, instance int, modality string, study_description string, series_description string, contrast_agent string, "
    "rows int, cols int, position array<double>, orientation array<double>, pixel_spacing array<double>, thickness double, step double, frame int, frames int, hu array<double>"
)


def tags(data: bytes) -> dict[str, bytes]:
    """Raw values of the known tags; sequences are passed over."""
    if data[128:132] != b"DICM":
        raise ValueError("no DICOM preamble")
    wanted, found, at, explicit = {v: k for k, v in TAGS.items()}, {}, 132, True
    nested, end = 0, len(data)
    while at + 8 <= end:
        group, element = struct.unpack_from("<HH", data, at)
        if group != 0x0002 and not nested and "transfer_syntax" in found and at < end:
            syntax = found["transfer_syntax"].rstrip(b"\0 ").decode("ascii", "replace")
            if syntax not in (IMPLICIT, EXPLICIT):
                raise ValueError(f"transfer syntax {syntax} is not supported")
            explicit = syntax == EXPLICIT
        if group == 0xFFFE:  # an item, its end or the end of a sequence of unknown length
            size = struct.unpack_from("<I", data, at + 4)[0]
            nested -= element == 0xE0DD
            at += 8 + (size if element == 0xE000 and size != 0xFFFFFFFF and not nested else 0)
            continue
        kind = data[at + 4 : at + 6]
        if not explicit and group != 0x0002:
            size, at = struct.unpack_from("<I", data, at + 4)[0], at + 8
        elif kind in LONG:
            size, at = struct.unpack_from("<I", data, at + 8)[0], at + 12
        else:
            size, at = struct.unpack_from("<H", data, at + 6)[0], at + 8
        if size == 0xFFFFFFFF:
            nested += 1
            continue
        name = wanted.get((group, element))
        if name and not nested:
            if at + size > end:
                raise ValueError(f"{name} is cut short")
            found[name] = data[at : at + size]
        at += size
    return found


def _numbers(raw: bytes | None) -> list[float] | None:
    try:
        return [float(x) for x in raw.decode("ascii").strip("\0 ").split("\\")] if raw else None
    except ValueError:
        return None


def _first(raw: bytes | None, default=None):
    return (_numbers(raw) or [default])[0]


def parse(data: bytes) -> list[dict]:
    """The frames of one image as rows of ``SCHEMA`` without path and name; frames count from 0."""
    t = tags(data)
    text = {k: t[k].decode("utf-8", "replace").strip("\0 ") if k in t else None for k in ("series_uid", "modality", "study_description", "series_description", "contrast_agent", "photometric")}
    n = {k: struct.unpack_from("<H", t[k])[0] if len(t.get(k, b"")) >= 2 else None for k in SHORTS}
    if "pixels" not in t or not n["rows"] or not n["cols"]:
        raise ValueError("no pixels")
    if (n["samples"] or 1) != 1:
        raise ValueError("colour images are not supported")
    if n["bits"] not in (8, 16):
        raise ValueError(f"{n['bits']} bits a pixel are not supported")
    size, frames = n["rows"] * n["cols"], max(1, int(_first(t.get("frames"), 1)))
    dtype = np.dtype(("<i" if n["signed"] else "<u") + str(n["bits"] // 8))
    if len(t["pixels"]) < size * frames * dtype.itemsize:
        raise ValueError("pixels are cut short")
    raw = np.frombuffer(t["pixels"], dtype, size * frames).reshape(frames, size).astype(float)
    hu = raw * _first(t.get("slope"), 1.0) + _first(t.get("intercept"), 0.0)
    if text.pop("photometric") == "MONOCHROME1":
        hu = hu.max(1, keepdims=True) + hu.min(1, keepdims=True) - hu
    place = {k: _numbers(t.get(k)) for k in ("position", "orientation", "pixel_spacing")}
    facing = ",".join(f"{x + 0.0:.2f}" for x in place["orientation"] or [])
    whole = {k: None if (x := _first(t.get(k))) is None else int(x) for k in ("series_number", "instance")}
    row = text | place | whole | {"rows": n["rows"], "cols": n["cols"], "thickness": _first(t.get("thickness")), "step": _first(t.get("step")), "frames": frames, "series_key": f"{text['series_uid'] or ''}|{n['rows']}x{n['cols']}|{facing}", "error": None}
    return [row | {"frame": k, "hu": hu[k].tolist()} for k in range(frames)]


def members(path: str, data: bytes):
    """(name, content) of a file, or of what an archive holds at any depth but folders, empty, hidden and resource entries."""
    if data[:4] != b"PK\x03\x04":
        yield path.rsplit("/", 1)[-1], data
        return
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for e in z.infolist():
            parts = e.filename.split("/")
            if not e.is_dir() and e.file_size and "__MACOSX" not in parts and not parts[-1].startswith("."):
                yield from members(e.filename, z.read(e))


def images(path: str, content: bytes):
    """Rows of one file, or of all files of an archive."""
    try:
        for name, data in members(path, content):
            try:
                for row in parse(data):
                    yield {"path": path, "name": name} | row
            except (ValueError, struct.error) as e:
                yield {"path": path, "name": name, "error": str(e)}
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
        yield {"path": path, "name": path.rsplit("/", 1)[-1], "error": str(e)}


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """Every frame below ``path``, one row each, in the columns of ``SCHEMA``."""
    schema = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                for row in images(path.as_py(), content.as_py()):
                    yield pa.RecordBatch.from_pylist([row], schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def planned(sizes: list[int], most: int) -> list[list[int]]:
    """Files (by place) in groups of about ``most`` bytes: in order, a group ends before it would exceed them."""
    out, held = [], 0
    for k, n in enumerate(sizes):
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(k)
        held += n
    return out


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class SliceSource(DataSource):
    """``spark.read.format("slices").load(path)``: the rows of ``read_slices``; option ``bytes``: of files a partition, about (128 MB).

    ``path`` is a folder or file that pyarrow's file systems reach from driver and executors alike.  A file is read by one task, and
    frame by frame handed on.  Register it with ``spark.dataSource.register(SliceSource)``.
    """

    @classmethod
    def name(cls):
        return "slices"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _SliceReader(self.options, to_arrow_schema(schema))


class _SliceReader(DataSourceReader):
    def __init__(self, options, kind: pa.Schema):
        self.path, self.bytes, self.kind = options["path"], int(options.get("bytes", 128 << 20)), kind

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self):
        from pyarrow import fs

        where, at = self._fs()
        if where.get_file_info(at).type == fs.FileType.File:
            return [_Files([at])]
        found = sorted((f for f in where.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File), key=lambda f: f.path)
        return [_Files([found[k].path for k in group]) for group in planned([f.size for f in found], self.bytes)] or [_Files([])]

    def read(self, partition):
        where, _ = self._fs()
        for path in partition.paths:
            with where.open_input_file(path) as f:
                content = f.read()
            for row in images(path, content):
                yield pa.RecordBatch.from_pylist([row], self.kind)


def skipped(slices: DataFrame) -> DataFrame:
    """(path, name, error) of what could not be read."""
    return slices.where("error is not null").select("path", "name", "error")


def headers(slices: DataFrame) -> DataFrame:
    """Readable slices in the columns of ``operators.assemble``, with their pixels ``hu``; ``at`` orders them by path, name and frame.

    A series of one file has a slice for each frame, a step apart along the normal (the step between slices, else their thickness, else
    1 mm); of several files with frames the first of each counts.
    """
    o, p, s = F.coalesce("orientation", F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)))), F.col("position"), F.col("pixel_spacing")
    key = W.partitionBy("series_key")
    d = slices.where("error is null").withColumn("one", F.min(F.concat_ws("|", "path", "name")).over(key) == F.max(F.concat_ws("|", "path", "name")).over(key))
    d = d.where("one or frame = 0").withColumn("several", F.col("one") & (F.col("frames") > 1))
    d = d.withColumn("at", F.row_number().over(key.orderBy("path", "name", "frame")))
    axes = {f"{k}{c}": o[3 * j + i] for j, k in enumerate("rc") for i, c in enumerate("xyz")}
    normal = normalize(cross([axes[f"r{c}"] for c in "xyz"], [axes[f"c{c}"] for c in "xyz"]))
    step = F.coalesce("step", "thickness", F.lit(1.0))
    place = {}
    for i, c in enumerate("xyz"):
        own = F.try_element_at(p, F.lit(i + 1))
        place[f"p{c}"] = F.when(F.col("several"), F.coalesce(own, F.lit(0.0)) + normal[i] * step * F.col("frame")).otherwise(own)
    instance = F.when(F.col("several"), F.col("frame")).otherwise(F.coalesce("instance", F.lit(0)))
    return d.select(F.col("series_key").alias("series"), "at", F.col("rows").alias("rows_"), "cols", *(e.alias(n) for n, e in (axes | place).items()), *(F.coalesce(F.try_element_at(s, F.lit(i + 1)), F.lit(1.0)).alias(f"ps{i}") for i in (0, 1)), instance.alias("instance"), F.lit(1).alias("frames"), F.when(F.col("several"), step).otherwise(F.col("thickness")).alias("thickness"), "hu")


def file_headers(slices: DataFrame) -> DataFrame:
    """One row a file in the columns of ``operators.assemble``, ``frames`` being how many it has and ``step`` the mm between them, for summaries."""
    h = headers(slices.where("frame = 0").withColumns({"frames": F.lit(1), "hu": F.array().cast("array<double>")})).drop("hu", "frames")
    n = slices.where("frame = 0 and error is null").withColumn("at", F.row_number().over(W.partitionBy("series_key").orderBy("path", "name", "frame")))
    return h.join(n.select(F.col("series_key").alias("series"), "at", "frames", "step"), ["series", "at"])


def slice_voxels(slices: DataFrame) -> DataFrame:
    """(series_key, z, x, y, hu) of readable slices; z numbers a series' slices along its normal, else by instance."""
    o, p = F.col("orientation"), F.col("position")
    normal = [o[(i + 1) % 3] * o[3 + (i + 2) % 3] - o[(i + 2) % 3] * o[3 + (i + 1) % 3] for i in range(3)]
    along = F.coalesce(sum((normal[i] * p[i] for i in range(3)), F.lit(0.0)), F.coalesce("instance", F.lit(0)) * F.coalesce("thickness", F.lit(1.0)))  # frames of one file keep their order
    s = slices.where("error is null").withColumn("z", (F.row_number().over(W.partitionBy("series_key").orderBy(along, "instance", "path", "name", "frame")) - 1))
    v = s.select("series_key", "z", "cols", F.posexplode("hu").alias("i", "hu"))
    return v.select("series_key", "z", (F.col("i") % F.col("cols")).alias("x"), F.floor(F.col("i") / F.col("cols")).cast("int").alias("y"), "hu")
