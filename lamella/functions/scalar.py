"""Column helpers: rounding, clamping, vectors, Catmull-Rom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Nearest whole number, halves upward (also below zero)."""
    return F.floor(c + 0.5)


def clamp(c: Column, lo, hi) -> Column:
    """Null stays null."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(c.isNotNull(), F.greatest(lo, F.least(hi, c)))


def to_int16(c: Column) -> Column:
    return clamp(half_up(c), -32768, 32767).cast("smallint")


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def normalize(a: list[Column]) -> list[Column]:
    """A zero vector stays as it is."""
    n = F.coalesce(F.nullif(F.sqrt(dot(a, a)), F.lit(0.0)), F.lit(1.0))
    return [x / n for x in a]


def cubic(a: Column, b: Column, c: Column, d: Column, t: Column) -> Column:
    """From b to c with the slopes that their neighbours give: a Hermite curve with tangents (c - a) / 2 and (d - b) / 2."""
    out, in_, rise = (c - a) * 0.5, (d - b) * 0.5, c - b
    return b + t * (out + t * (rise * 3 - out * 2 - in_ + t * (out + in_ - rise * 2)))


def dominant_axis(x: Column, y: Column, z: Column) -> Column:
    """0, 1 or 2; the lower axis on ties."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    return F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2)


def direction_label(x: Column, y: Column, z: Column) -> Column:
    """The letter of the side that a vector points to most: L or R, P or A, S or I."""
    a = dominant_axis(x, y, z)
    pick = lambda c, plus, minus: F.when(c >= 0, plus).otherwise(minus)
    return F.when(a == 0, pick(x, "L", "R")).when(a == 1, pick(y, "P", "A")).otherwise(pick(z, "S", "I"))


def fmt(c: Column, digits: int = 2) -> Column:
    """A number with at most ``digits`` decimals after a comma and dots between thousands."""
    text = F.call_function("format_number", F.round(c.cast("double"), digits), F.lit("#,##0" + ("." + "#" * digits if digits else "")))
    return F.translate(text, ",.", ".,")
