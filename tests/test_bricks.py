"""Work by bricks against the same work on the whole: components, competition, graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import graph
from lamella.operators import components, segment, structures


def rows_of(spark, mask, series=1, **more):
    at = np.argwhere(mask)
    data = [(series, int(x), int(y), int(z), *(int(m[z, y, x]) for m in more.values())) for z, y, x in at]
    return spark.createDataFrame(data, "series int, x int, y int, z int" + "".join(f", {c} int" for c in more))


def numbered(lab, mask):
    """Components counted from 1 in order of their first voxel."""
    return np.unique(lab[mask], return_inverse=True)[1] + 1


@pytest.mark.parametrize("corners", [False, True])
def test_components_by_bricks(spark, corners):
    rng = np.random.default_rng(3)
    mask = rng.random((13, 12, 14)) < (0.16 if corners else 0.33)
    other = rng.random((5, 5, 5)) < 0.5
    v = rows_of(spark, mask).unionByName(rows_of(spark, other, 2))
    label = components.label26 if corners else components.label6
    for side in (3, 64):
        got = {(r.series, r.z, r.y, r.x): r.component for r in components.label_voxels(v, corners, side).collect()}
        for s, m in ((1, mask), (2, other)):
            want = dict(zip(map(tuple, np.argwhere(m)), numbered(label(m), m), strict=True))
            assert {k[1:]: c for k, c in got.items() if k[0] == s} == want
    assert components.label_voxels(v.where("false")).count() == 0


def snake(turns=12, wide=9):
    """A path that winds through slab after slab: one component in which every slab holds many pieces."""
    mask = np.zeros((4 * turns, wide, wide), bool)
    for t in range(wide):
        mask[:, t, 0::2] = t == 0
    mask[:, 0, 0::2] = True
    for k, x in enumerate(range(0, wide - 2, 2)):
        mask[-1 if k % 2 == 0 else 0, 0, x : x + 3] = True
    return mask


def test_a_component_winds_through_ten_slabs(spark, monkeypatch):
    mask = snake()
    most = []
    label = components.label6
    v = rows_of(spark, mask)
    side = 4
    assert mask.shape[0] // side >= 10
    got = components.label_voxels(v, side=side)
    assert got.select("component").distinct().count() == 1 and got.count() == mask.sum()
    # no task holds two bricks and their layer
    most = components.deal(v, side, after=1).groupBy("series", *components.BRICK).count().agg(F.max("count")).first()[0]
    assert most <= (side + 1) ** 3 and label(mask).max() == np.flatnonzero(mask.ravel())[0]
    cut = mask.copy()
    cut[20, 0, 4] = False
    assert components.label_voxels(rows_of(spark, cut), side=side).select("component").distinct().count() == 2


def competed(may, owner, steps):
    """Breadth first, step by step, the smallest seed among equally near ones."""
    flat = np.arange(may.size).reshape(may.shape)
    seed = np.where(owner > 0, flat, flat.size)
    got = structures._compete(may, seed, steps)
    return np.append(owner.ravel(), 0)[got]


@pytest.mark.parametrize("steps", [None, 3])
def test_regrow_by_bricks(spark, steps):
    rng = np.random.default_rng(5)
    may = rng.random((11, 12, 13)) < 0.62
    owner = np.where(may & (rng.random(may.shape) < 0.03), rng.integers(1, 5, may.shape), 0)
    want = competed(may, owner, steps)
    assert len(np.unique(want[may])) > 3
    v = rows_of(spark, may, owner=owner)
    for side in (4, 64):
        got = {(r.z, r.y, r.x): r.owner for r in structures.regrow(v, steps, side).collect()}
        assert got == {tuple(k): int(want[tuple(k)]) for k in np.argwhere(may)}


def test_regrow_along_a_path_of_many_bricks(spark):
    mask = snake(6)
    owner = np.zeros(mask.shape, int)
    first, last = np.argwhere(mask)[0], np.argwhere(mask & (np.arange(mask.shape[2]) == mask.shape[2] - 1))[-1]
    owner[tuple(first)], owner[tuple(last)] = 7, 9
    got = {(r.z, r.y, r.x): r.owner for r in structures.regrow(rows_of(spark, mask, owner=owner), side=4).collect()}
    want = competed(mask, owner, None)
    assert got == {tuple(k): int(want[tuple(k)]) for k in np.argwhere(mask)} and set(got.values()) == {7, 9}
    with pytest.raises(RuntimeError):
        structures.regrow(rows_of(spark, mask, owner=owner), side=4, most=2)


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_graph_components(spark, few):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20] + [(100, 50), (7, 7), (50, 100)], "p long, q long")
    got = {r.node: r.root for r in graph.components(e, few).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(21, 41)} == {21} and got[100] == got[50] == 50
    assert graph.components(e.where("false"), few).count() == 0
    with pytest.raises(RuntimeError):
        graph.components(e, 0, most=1)


def test_metal_extents_against_the_whole_piece(spark):
    """A turned rod over several bricks of growth, its extents by numpy."""
    rng = np.random.default_rng(2)
    axis = np.array([0.6, 0.64, 0.48])
    z, y, x = np.meshgrid(*[np.arange(40)] * 3, indexing="ij")
    p = np.stack([x, y, z], axis=-1) - 20
    along = p @ axis
    hu = np.where((np.linalg.norm(p - along[..., None] * axis, axis=-1) < 2) & (np.abs(along) < 15), 3000, 100)
    hu[5, 5, 5] = 3000  # under the least volume
    at = np.argwhere(hu > 100)
    v = spark.createDataFrame([(4, int(c), int(b), int(a), int(hu[a, b, c])) for a, b, c in at], "series int, x int, y int, z int, hu int")
    voxels, objects = segment.metal_parts(v, 2500, 1500, (0.5, 0.5, 0.5))
    r = objects.collect()
    q = at[np.any(at != 5, axis=1)][:, ::-1] * 0.5
    t = (q - q.mean(0)) @ np.linalg.eigh(np.cov(q.T, bias=True))[1][:, ::-1]
    assert len(r) == 1 and r[0].kind == "screw" and r[0].volume == pytest.approx(len(q) / 8) and voxels.count() == len(q)
    assert [r[0].length, r[0].width, r[0].thickness] == pytest.approx((t.max(0) - t.min(0) + 0.5).tolist())
