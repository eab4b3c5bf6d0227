"""Column functions that the operators share."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x: float) -> Column:
    return F.lit(float(x))


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def nan_to_num(x: Column, nan: float = 1e-12, posinf: float = 1e18, neginf: float = -1e18) -> Column:
    """NaN and infinities replaced; null stays null."""
    return F.when(F.isnan(x), lit(nan)).when(x == float("inf"), lit(posinf)).when(x == float("-inf"), lit(neginf)).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    """x held in [low, high]; NaN stays NaN, which greatest and least alone would not keep."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(lit(low), F.least(lit(high), x)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def relu(x: Column) -> Column:
    return F.greatest(lit(0.0), x)


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return total([x * y for x, y in zip(a, b, strict=True)])


def norm(a: tuple[Column, ...]) -> Column:
    return F.sqrt(dot(a, a))


def rotate(v: tuple[Column, ...], rx: float, ry: float, rz: float) -> tuple[Column, ...]:
    """v turned by rx, ry, rz degrees about x, then y, then z."""
    sx, cx = math.sin(math.radians(rx)), math.cos(math.radians(rx))
    sy, cy = math.sin(math.radians(ry)), math.cos(math.radians(ry))
    sz, cz = math.sin(math.radians(rz)), math.cos(math.radians(rz))
    x, y, z = v
    y, z = y * cx - z * sx, y * sx + z * cx
    x, z = x * cy + z * sy, z * cy - x * sy
    return x * cz - y * sz, x * sz + y * cz, z


def as_float32(x: Column) -> Column:
    """Rounded to single precision, still a double."""
    return x.cast("float").cast("double")


def r(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """``r`` for numpy: halves away from zero, without a negative zero."""
    scaled = v * 10.0**digits
    whole = np.trunc(scaled)
    return (whole + np.sign(scaled) * (np.abs(scaled - whole) >= 0.5)) / 10.0**digits + 0.0
