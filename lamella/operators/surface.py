"""Surfaces where a field is zero: triangles that share their vertices, smoothed, with normals, in the patient's coordinates.

Cells are cut into six tetrahedra each, by rule and without a case table.  A vertex lies on a grid edge (one of the seven that
lead from a corner to a later one of its cell) and bears the edge's number, so that the cells around it name the same vertex.
Voxel rows are dealt to bricks with one layer of the next; smoothing deals triangles to bricks with as many cells around as
it has steps, which is as far as a vertex's neighbours of that many steps can lie.  So each brick is exact by itself.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bricks import AXES, BRICK, box, column, deal, kind, places, unplaced, unplaced_columns

#: Corners of a cell are numbered by bits: 1 a step in x, 2 in y, 4 in z.  Each order of the axes is a path from 0 to 7, a tetrahedron.
TETRAHEDRA = [(0, 1 << a, (1 << a) | (1 << b), 7) for a, b, _ in permutations(range(3))]
#: Sides of bricks of voxels and of triangles.
SIDE, MESH_SIDE = 32, 64
#: Vertices are named by places from 0 on; what reaches below them is no brick of theirs.
HELD = " AND ".join(f"{b} >= 0" for b in BRICK)
#: fixed values: steps and pass band of the smoothing filter, and its steps on layers of metal and vessels
STEPS, PASS_BAND, FINE_STEPS = 15, 0.08, 6


def _parity(order) -> int:
    return (-1) ** sum(order[i] > order[j] for i in range(len(order)) for j in range(i + 1, len(order)))


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each set of inner corners of a tetrahedron (bits): its corners, inner ones first, and the parity of that order."""
    order = [[j for j in range(4) if code >> j & 1] + [j for j in range(4) if not code >> j & 1] for code in range(16)]
    return np.array(order), np.array([_parity(o) for o in order])


ORDER, PARITY = _orders()
TURN = np.array([_parity(p) for p in permutations(range(3))])
TETS = np.array(TETRAHEDRA)
#: triangles as pairs (inner, outer) of places in the order, by the number of inner corners; wound outward where the parities agree
FACES = {1: [[(0, 1), (0, 2), (0, 3)]], 2: [[(0, 2), (0, 3), (1, 3)], [(0, 2), (1, 3), (1, 2)]], 3: [[(0, 3), (1, 3), (2, 3)]]}


def march(f: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (x, y, z), vertex numbers (three a triangle) and positions (x, y, z of each) of the zero surface of f[z, y, x].

    ``low``: z, y and x of f's first place.  NaN is no voxel; cells with one have no surface.  Above zero is inside.
    """
    n = [max(0, s - 1) for s in f.shape]
    corner = np.stack([f[k >> 2 & 1 :][: n[0], k >> 1 & 1 :][:, : n[1], k & 1 :][:, :, : n[2]] for k in range(8)], axis=-1)
    with np.errstate(invalid="ignore"):
        at = np.argwhere((corner.max(-1) > 0) & (corner.min(-1) <= 0))
    value = corner[tuple(at.T)]
    at = (at + low)[:, ::-1]  # x, y, z
    inner = value[:, TETS] > 0
    code = inner @ np.array([1, 2, 4, 8])
    cells, keys, spots = [], [], []
    for n_in, faces in FACES.items():
        c, t = np.nonzero(np.isin(code, [k for k in range(16) if bin(k).count("1") == n_in]))
        order = ORDER[code[c, t]]
        corners = np.take_along_axis(TETS[t], order, axis=1)
        flip = PARITY[code[c, t]] * TURN[t] < 0
        for face in faces:
            key, spot = [], []
            for i, o in face:
                p, q = corners[:, i], corners[:, o]
                first, way = p & q, p ^ q
                a, b = value[c, first], value[c, first | way]
                step = np.stack([way >> k & 1 for k in range(3)], axis=1)
                start = at[c] + np.stack([first >> k & 1 for k in range(3)], axis=1)
                key.append(places(*start.T) << 3 | way)
                spot.append(start + step * (a / (a - b))[:, None])
            key, spot = np.stack(key, axis=1), np.stack(spot, axis=1)
            key[flip, 1:], spot[flip, 1:] = key[flip, :0:-1], spot[flip, :0:-1].copy()
            cells.append(at[c]), keys.append(key), spots.append(spot)
    return np.concatenate(cells), np.concatenate(keys), np.concatenate(spots)


def label_values(label: np.ndarray, field: np.ndarray, which: int) -> np.ndarray:
    """A field whose zero is the border of one label: at least 0.01 inside, below -0.01 outside."""
    return np.where(label == which, np.maximum(0.01, field), -0.01 - np.abs(field) * 0.05)


def cut(v: DataFrame, field: str = "field", label: str | None = None, bases: dict[int, str] | None = None, side: int = SIDE) -> DataFrame:
    """(series, layer, cx, cy, cz, a, b, c, p): triangles of the zero surface of ``field``, with the cell, vertex numbers and nine coordinates.

    With ``label`` the surfaces of all labels above 0 in one pass over the bricks, ``layer`` being the label; ``bases`` names another
    column than ``field`` for some labels.  Normals point out of what is above zero.  The grid's outer faces are not closed.
    """
    bases = bases or {}
    extra = sorted({field, *bases.values()})
    v = v.select("series", *AXES, *(F.col(c).cast("double").alias(c) for c in extra), *([F.col(label).cast("int").alias("__label")] if label else []))
    schema = [("layer", pa.int32()), *((n, pa.int32()) for n in ("cx", "cy", "cz")), *((n, pa.int64()) for n in "abc"), ("p", pa.list_(pa.float64()))]

    def run(table: pa.Table) -> pa.Table:
        own_schema = pa.schema([table.schema.field("series"), *map(pa.field, *zip(*schema, strict=True))])
        low, at, shape = box(table)
        grid = {}
        for name in [*extra, *(["__label"] if label else [])]:
            grid[name] = np.full(shape, np.nan)
            grid[name][at] = column(table, name)
        out = []
        for which in (np.unique(column(table, "__label")).tolist() if label else [0]):
            if label and which <= 0:
                continue
            own = grid[bases.get(int(which), field)]
            f = label_values(grid["__label"], own, which) if label else own
            cells, keys, spots = march(f, low)
            n = len(cells)
            if n:
                p = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 9), pa.array(spots.reshape(-1)))
                columns = [[table.column("series")[0].as_py()] * n, np.full(n, int(which)), *cells.T, *keys.T]
                out.append(pa.table([pa.array(c, t.type) for c, t in zip(columns, own_schema, strict=False)] + [p], schema=own_schema))
        return pa.concat_tables(out) if out else own_schema.empty_table()

    kinds = f"series {kind(v, 'series')}, layer int, cx int, cy int, cz int, a long, b long, c long, p array<double>"
    return deal(v, side, after=1).groupBy("series", *BRICK).applyInArrow(run, kinds)


def filter_weights(steps: int, band: float = PASS_BAND) -> np.ndarray:
    """Chebyshev coefficients of a low-pass filter of the graph's Laplacian (eigenvalues 0 to 2): a sinc with a Hamming window.

    The edge is moved until the gain at the pass band is one; the gain of a constant is one.
    """
    edge, k = np.arccos(1 - 0.5 * band), np.arange(1, steps + 1)
    window = 0.54 + 0.46 * np.cos(np.arange(steps + 1) * np.pi / (steps + 1))

    def weights(shift):
        own = edge + shift
        return window * np.concatenate([[own / np.pi], 2 * np.sin(k * own) / (k * np.pi)])

    low, high = 0.0, np.pi - edge
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if weights(mid) @ np.cos(np.arange(steps + 1) * edge) < 1 else (low, mid)
    c = weights(low)
    return c / c.sum()


def smoothed(x: np.ndarray, faces: np.ndarray, steps: int, band: float = PASS_BAND) -> np.ndarray:
    """Vertices after the filter, each step of which is a mean over neighbours; vertices on an open border stay."""
    if steps < 1 or not len(faces):
        return x
    pair = np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), axis=1)
    (i, j), used = (lambda u, n: (u.T, n))(*np.unique(pair, axis=0, return_counts=True))
    fixed = np.zeros(len(x), bool)
    fixed[i[used == 1]] = fixed[j[used == 1]] = True
    degree = np.bincount(np.concatenate([i, j]), minlength=len(x))

    def rough(y):
        total = np.stack([np.bincount(i, y[j, k], len(x)) + np.bincount(j, y[i, k], len(x)) for k in range(3)], axis=1)
        d = y - total / np.maximum(degree, 1)[:, None]
        d[fixed] = 0
        return d

    c = filter_weights(steps, band)
    before, now = x, x - 0.5 * rough(x)
    out = c[0] * before + c[1] * now
    for k in range(2, steps + 1):
        before, now = now, 2 * now - before - rough(now)
        out += c[k] * now
    out[fixed] = x[fixed]
    return out


def marked(tri: DataFrame) -> DataFrame:
    """``tri`` of ``cut`` with pa, pb and pc for the nine coordinates: how far each vertex lies along the edge that its number names."""
    step = lambda c, k, axis, low: F.when(F.col(c).bitwiseAND(F.lit(1 << axis)) != 0, F.col("p")[3 * k + axis] - low)
    far = [F.coalesce(*(step(c, k, axis, low) for axis, low in enumerate(unplaced_columns(F.shiftright(c, 3))))).alias(f"p{c}") for k, c in enumerate("abc")]
    return tri.select("series", "layer", "cx", "cy", "cz", *"abc", *far)


def vertices(tri: DataFrame, steps: int = STEPS, band: float = PASS_BAND, fine: tuple[int, ...] = (), fine_steps: int = FINE_STEPS, side: int = MESH_SIDE) -> DataFrame:
    """(series, layer, vid, x, y, z, nx, ny, nz) of the triangles of ``cut`` or ``marked``: smoothed places and the sums of the areas' normals, in index units.

    Layers ``fine`` take ``fine_steps``.
    """
    schema = [("layer", pa.int32()), ("vid", pa.int64()), *((n, pa.float64()) for n in ("x", "y", "z", "nx", "ny", "nz"))]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        layer = table.column("layer")[0].as_py()
        vid, first, face = np.unique(np.stack([column(table, c) for c in "abc"], axis=1), return_index=True, return_inverse=True)
        face = face.reshape(-1, 3)
        far = np.stack([column(table, f"p{c}") for c in "abc"], axis=1).reshape(-1, 1)[first]
        x = np.stack(unplaced(vid >> 3), axis=1) + np.stack([vid >> k & 1 for k in range(3)], axis=1) * far
        x = smoothed(x, face, fine_steps if layer in fine else steps, band)
        a, b, c = (x[face[:, k]] for k in range(3))
        area = np.cross(b - a, c - a) / 2
        normal = np.stack([np.bincount(face.ravel(), np.repeat(area[:, k], 3), len(vid)) for k in range(3)], axis=1)
        own = np.all([at // side == table.column(n)[0].as_py() for at, n in zip(unplaced(vid >> 3), BRICK, strict=True)], axis=0)
        n = int(own.sum())
        own_schema = pa.schema([table.schema.field("series"), *map(pa.field, *zip(*schema, strict=True))])
        columns = [[table.column("series")[0].as_py()] * n, np.full(n, layer), vid[own], *x[own].T, *normal[own].T]
        return pa.table([pa.array(c, t.type) for c, t in zip(columns, own_schema, strict=True)], schema=own_schema)

    reach = max(steps, fine_steps if fine else 0) + 2
    dealt = deal(tri if "pa" in tri.columns else marked(tri), side, reach, reach, ("cx", "cy", "cz")).where(HELD).drop("cx", "cy", "cz")
    return dealt.groupBy("series", "layer", *BRICK).applyInArrow(run, f"series {kind(tri, 'series')}, layer int, vid long, x double, y double, z double, nx double, ny double, nz double")


def to_patient(vert: DataFrame, spacing: tuple[float, float, float] | list[Column], origin=(0.0, 0.0, 0.0), direction=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)) -> DataFrame:
    """``vert`` in mm of the patient, with unit normals; ``direction``: nine cosines, axis after axis.  Numbers or columns of ``vert``."""
    s, o, d = ([c if isinstance(c, Column) else F.lit(float(c)) for c in x] for x in (spacing, origin, direction))
    mm, area = [F.col(c) * k for c, k in zip(AXES, s, strict=True)], [F.col(f"n{c}") / k for c, k in zip(AXES, s, strict=True)]
    at = [o[k] + d[k] * mm[0] + d[3 + k] * mm[1] + d[6 + k] * mm[2] for k in range(3)]
    turned = [d[k] * area[0] + d[3 + k] * area[1] + d[6 + k] * area[2] for k in range(3)]
    long = F.sqrt(turned[0] * turned[0] + turned[1] * turned[1] + turned[2] * turned[2])
    size = F.coalesce(F.nullif(long, F.lit(0.0)), F.lit(1.0))
    return vert.select("series", "layer", "vid", *(e.alias(c) for e, c in zip(at, AXES, strict=True)), *((e / size).alias(f"n{c}") for e, c in zip(turned, AXES, strict=True)))


def measures(tri: DataFrame, vert: DataFrame, side: int = MESH_SIDE) -> DataFrame:
    """(series, layer, vertices, edges, triangles, area, volume) of each mesh; ``volume`` holds where the mesh is closed.

    Triangles meet their vertices in bricks, and nothing is joined: Spark takes what comes of a cell for as little as the voxels it
    comes from, and would broadcast millions of vertices through the driver.  A vertex counts in the brick of its place, a triangle in
    that of its first vertex and an edge in that of its lower one; the other vertices lie one place away at most.
    """
    key = ["series", "layer"]

    def run(at: tuple, t: pa.Table, v: pa.Table) -> pa.Table:
        series, layer, *brick = at
        inside = lambda vid: np.all([c // side == b.as_py() for c, b in zip(unplaced(vid >> 3), brick, strict=True)], axis=0)
        face, vid = np.stack([column(t, c) for c in "abc"], axis=1), column(v, "vid")
        p, q = np.sort(np.concatenate([face[:, [0, 1]], face[:, [1, 2]], face[:, [2, 0]]]), axis=1).T
        own = inside(p)
        p, q = p[own], q[own]
        order = np.lexsort((q, p))
        edges = int(len(p) > 0) + int(((np.diff(p[order]) != 0) | (np.diff(q[order]) != 0)).sum())
        face, order = face[inside(face[:, 0])], np.argsort(vid)
        spot = np.stack([column(v, c) for c in AXES], axis=1)[order]
        a, b, c = (spot[np.searchsorted(vid, face[:, k], sorter=order)] for k in range(3))
        n = np.cross(b - a, c - a)
        row = [series.as_py(), layer.as_py(), int(inside(vid).sum()), edges, len(face), float(np.sqrt((n * n).sum(1)).sum() / 2), float((a * n).sum() / 6)]
        return pa.table([pa.array([x], k) for x, k in zip(row, [series.type, pa.int32(), *[pa.int64()] * 3, *[pa.float64()] * 2], strict=True)], names=[*key, *sums])

    sums = ["vertices", "edges", "triangles", "area", "volume"]
    kinds = f"series {kind(tri, 'series')}, layer int, vertices long, edges long, triangles long, area double, volume double"
    low = [F.least(*c).alias(n) for n, c in zip(("px", "py", "pz"), zip(*(unplaced_columns(F.shiftright(k, 3)) for k in "abc"), strict=True), strict=True)]
    at = [c.alias(n) for n, c in zip(("px", "py", "pz"), unplaced_columns(F.shiftright("vid", 3)), strict=True)]
    own = [F.col("series").cast(tri.schema["series"].dataType), F.col("layer").cast("int")]
    faces = deal(tri.where("series is not null").select(*own, "a", "b", "c", *low), side, 1, 0, ("px", "py", "pz"))
    spots = deal(vert.where("series is not null").select(*own, "vid", *AXES, *at), side, 1, 1, ("px", "py", "pz"))
    faces, spots = (d.where(HELD).drop("px", "py", "pz").groupBy(*key, *BRICK) for d in (faces, spots))
    each = faces.cogroup(spots).applyInArrow(run, kinds)
    return each.groupBy(*key).agg(*(F.sum(c).alias(c) for c in sums)).where("triangles > 0")


def _minus(a: Column, b: Column) -> list[Column]:
    return [a[c] - b[c] for c in AXES]


def _normal(a: Column, b: Column, c: Column) -> list[Column]:
    p, q = _minus(b, a), _minus(c, a)
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def triangles(v: DataFrame, level: float) -> DataFrame:
    """(series, a, b, c): triangles between hu above ``level`` and the rest, as structs of x, y, z in index units."""
    t = cut(v.withColumn("__f", F.col("hu") - level), "__f")
    return t.select("series", *(F.struct(*(F.col("p")[3 * k + i].alias(c) for i, c in enumerate(AXES))).alias(n) for k, n in enumerate("abc")))


def area(t: DataFrame) -> DataFrame:
    """(series, triangles, area) in index units."""
    n = _normal(F.col("a"), F.col("b"), F.col("c"))
    return t.groupBy("series").agg(F.count("*").alias("triangles"), F.sum(F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2).alias("area"))


def layer_meshes(v: DataFrame, field: str = "field", bases: dict[int, str] | None = None, steps: int = STEPS, fine: tuple[int, ...] = (4, 6), **geometry) -> tuple[DataFrame, DataFrame]:
    """(triangles, vertices) of all layers of labelled voxel rows (series, x, y, z, label, ``field``), in the patient's coordinates."""
    from ..functions.shared import settle

    tri = settle(marked(cut(v, field, "label", bases)))
    return tri.select("series", "layer", "a", "b", "c"), to_patient(vertices(tri, steps, fine=fine), **({"spacing": (1.0, 1.0, 1.0)} | geometry))
