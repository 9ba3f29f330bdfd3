"""Voxel rows dealt to bricks, so that a task holds one brick with its halo and never a whole volume."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
BRICK = ("bx", "by", "bz")
#: bits of a coordinate in a place's number
BITS = 20


def deal(v: DataFrame, side: int, before: int = 0, after: int = 0, at: tuple[str, ...] = AXES) -> DataFrame:
    """``v`` with bx, by and bz: a row for each brick of ``side`` a side whose reach holds the place in columns ``at``.

    A brick reaches ``before`` places beyond its low faces and ``after`` beyond its high ones.
    """
    for b, c in zip(BRICK, at, strict=True):
        low, high = F.floor((F.col(c) - after) / side).cast("int"), F.floor((F.col(c) + before) / side).cast("int")
        v = v.withColumn(b, F.explode(F.sequence(low, high)) if before or after else high)
    return v


def places(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """One number a place: in order of z, then y, then x."""
    return (z.astype(np.int64) << 2 * BITS) | (y.astype(np.int64) << BITS) | x.astype(np.int64)


def place() -> F.Column:
    """``places`` of the columns x, y and z."""
    return (F.shiftleft(F.col("z").cast("long"), 2 * BITS)).bitwiseOR(F.shiftleft(F.col("y").cast("long"), BITS)).bitwiseOR(F.col("x").cast("long"))


def unplaced(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and z of place numbers."""
    mask = (1 << BITS) - 1
    return key & mask, key >> BITS & mask, key >> 2 * BITS


def unplaced_columns(key: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    """``unplaced`` of a column."""
    mask = F.lit((1 << BITS) - 1)
    return key.bitwiseAND(mask), F.shiftright(key, BITS).bitwiseAND(mask), F.shiftright(key, 2 * BITS)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def box(table: pa.Table) -> tuple[np.ndarray, tuple[np.ndarray, ...], tuple[int, ...]]:
    """Lowest (z, y, x) of the rows, their places from there, and the shape that holds them."""
    at = np.stack([column(table, c) for c in ("z", "y", "x")], axis=1).astype(np.int64)
    low = at.min(0)
    at -= low
    return low, tuple(at.T), tuple((at.max(0) + 1).tolist())


def kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
