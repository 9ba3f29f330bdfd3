"""The bite of findings is that of all voxels of the teeth, also where every fourth tells another."""

import duckdb
import pytest

from lamella.plans.registered import ORACLE, QUERIES

AIR, HOLLOW, JAW, TOOTH = -0.25, -0.1, 0.1, 0.3


def value(x: int, y: int, z: int) -> float:
    """Lower teeth where no fourth voxel lies, upper ones where all are such, and a ring of jaw high up."""
    if y >= 4 and (x in (1, 2) and z < 12 or x == 0 and z >= 12):
        return TOOTH
    if 5 <= x <= 7 and y <= 2 and z in (20, 21):
        return HOLLOW if (x, y) == (6, 1) else JAW
    return AIR


@pytest.fixture(scope="module")
def exam(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("exam"))
    rows = [(z, [value(i % 8, i // 8, z) for i in range(64)], 3) for z in range(24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    return d


def told(spark, exam, name):
    """Rows of a query, which its SQL twin has as well."""
    got = QUERIES[name](spark, exam).toPandas()
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{exam}/embeddings.parquet/*.parquet'")
    want = c.sql(ORACLE[name]).df()[list(got.columns)]
    key = list(got.columns)[:3]
    assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()
    return got.sort_values(key).to_dict("records")


def test_exam_references(spark, exam):
    assert [r["bite_z"] for r in told(spark, exam, "exam_references")] == [9]


def test_isolated_parts(spark, exam):
    got = [(r["voxels"], r["position"].split(", ")[1]) for r in told(spark, exam, "isolated_parts")]
    assert sorted(got) == [(16, "12 mm above the bite"), (48, "9 mm above the bite")]


def test_tooth_blocks(spark, exam):
    got = [(r["upper"], r["lower"], r["blocks_upper"], r["blocks_lower"]) for r in told(spark, exam, "tooth_blocks")]
    assert got == [(72, 72, 1, 1)]


def test_low_density(spark, exam):
    got = [(r["voxels"], r["position"].split(", ")[1]) for r in told(spark, exam, "low_density")]
    assert got == [(2, "12 mm above the bite")]


def test_jaw_parts(spark, exam):
    got = [(r["parts"], r["voxels"], r["position"].split(", ")[1]) for r in told(spark, exam, "jaw_parts")]
    assert got == [(1, 16, "12 mm above the bite")]
