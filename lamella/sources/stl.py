"""Binary STL files, one a series, through the file system that Spark's paths name."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: 80 bytes of header, a count, then 50 bytes a triangle
FACET = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])


def stl_bytes(corners: np.ndarray, header: str = "") -> bytes:
    """``corners``: (n, 3, 3).  A triangle without area has a zero normal."""
    normal = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    size = np.linalg.norm(normal, axis=1, keepdims=True)
    out = np.zeros(len(corners), FACET)
    out["normal"], out["corners"] = normal / np.where(size == 0, 1, size), corners
    return header.encode("ascii", "replace")[:80].ljust(80, b"\0") + np.asarray([len(out)], "<u4").tobytes() + out.tobytes()


def write_stl(triangles: DataFrame, folder: str, header: str = "") -> DataFrame:
    """Write (series, a, b, c) below ``folder``; returns (series, path, triangles).

    A file is the surface of one exam and is made by one task.  Its name bears the attempt, so that a task which runs again never meets
    an earlier file; the rows returned name the files that count.
    """

    def run(table: pa.Table) -> pa.Table:
        from pyarrow import fs
        from pyspark import TaskContext

        columns = [table.column(f"{s}{c}").to_numpy() for s in "abc" for c in "xyz"]
        series = table.column("series")[0].as_py()
        where, at = fs.FileSystem.from_uri(folder)
        where.create_dir(at, recursive=True)
        name = f"{at}/series-{series}-{TaskContext.get().taskAttemptId()}.stl"
        with where.open_output_stream(name) as out:
            out.write(stl_bytes(np.stack(columns, 1).reshape(-1, 3, 3), header))
        return pa.table({"series": [series], "path": [name], "triangles": [table.num_rows]})

    flat = triangles.select("series", *(F.col(s)[c].alias(f"{s}{c}") for s in "abc" for c in "xyz"))
    return flat.groupBy("series").applyInArrow(run, "series long, path string, triangles long")
