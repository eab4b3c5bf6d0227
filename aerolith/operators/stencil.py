"""Stencils on dense grids as window functions over grid lines.

A grid is a table (keys..., x, y, z, fields...) with one row a cell. Lines along an axis are window partitions,
so any number of grids is processed together and no task holds more than a line at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import lit, total

AXES = ("x", "y", "z")


def line(axis: str, keys: tuple[str, ...]):
    return W.partitionBy(*keys, *[a for a in AXES if a != axis]).orderBy(axis)


def slope(column: str, axis: str, keys: tuple[str, ...]) -> Column:
    """Central difference of unit spacing; one-sided at both ends; 0 on a line of one cell."""
    w = line(axis, keys)
    after, before = F.lead(column).over(w), F.lag(column).over(w)
    return F.when(before.isNull() & after.isNull(), lit(0.0)).when(before.isNull(), after - F.col(column)).when(after.isNull(), F.col(column) - before).otherwise((after - before) / 2)


def gradient(df: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Adds <column>_x, _y, _z: one shuffle an axis for all columns together."""
    for axis in AXES:
        df = df.withColumns({f"{c}_{axis}": slope(c, axis, keys) for c in columns})
    return df


def vorticity(df: DataFrame, u: tuple[str, str, str] = ("ux", "uy", "uz"), keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Adds the velocity gradient and wx, wy, wz."""
    df = gradient(df, u, keys)
    a, b, c = u
    return df.withColumns({"wx": F.col(f"{c}_y") - F.col(f"{b}_z"), "wy": F.col(f"{a}_z") - F.col(f"{c}_x"), "wz": F.col(f"{b}_x") - F.col(f"{a}_y")})


def strain(u: tuple[str, str, str] = ("ux", "uy", "uz")) -> dict[str, Column]:
    """The symmetric strain tensor from the columns that ``gradient`` added."""
    a, b, c = u
    half = lambda p, q: (F.col(p) + F.col(q)) / 2
    return {"s11": F.col(f"{a}_x"), "s22": F.col(f"{b}_y"), "s33": F.col(f"{c}_z"), "s12": half(f"{a}_y", f"{b}_x"), "s13": half(f"{a}_z", f"{c}_x"), "s23": half(f"{b}_z", f"{c}_y")}


def square_sum(s: dict[str, Column], prefix: str = "s") -> Column:
    """Sum of squares of a symmetric tensor, off-diagonal parts twice."""
    on = total([s[f"{prefix}{k}"] ** 2 for k in ("11", "22", "33")])
    return on + 2.0 * total([s[f"{prefix}{k}"] ** 2 for k in ("12", "13", "23")])


def q_criterion(df: DataFrame, u: tuple[str, str, str] = ("ux", "uy", "uz"), keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Adds q = (|vorticity|^2 - |strain|^2) / 2, which takes the whole vorticity, not half of it."""
    return with_q(vorticity(df, u, keys).withColumns(strain(u)))


def with_q(df: DataFrame) -> DataFrame:
    """Adds q to rows that have their vorticity and strain."""
    s = {k: F.col(k) for k in ("s11", "s22", "s33", "s12", "s13", "s23")}
    return df.withColumn("q", 0.5 * (F.col("wx") ** 2 + F.col("wy") ** 2 + F.col("wz") ** 2 - square_sum(s)))


def guide_q(df: DataFrame, u: tuple[str, str, str] = ("ux", "uy", "uz"), keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Adds q = |vorticity|^2 / 2."""
    return vorticity(df, u, keys).withColumn("q", 0.5 * (F.col("wx") ** 2 + F.col("wy") ** 2 + F.col("wz") ** 2))


def box_width(ratio: float) -> int:
    """The odd number of cells for a filter ratio."""
    k = int(ratio)
    return k + 1 if k % 2 == 0 else k


def box_filter(df: DataFrame, columns: dict[str, Column | str], keys: tuple[str, ...] = ("sim_id",), width: int = 3) -> DataFrame:
    """Adds, for each name, the mean over a cube of cells; cells outside the grid count as zeros."""
    reach = width // 2
    df = df.withColumns({name: F.col(c) if isinstance(c, str) else c for name, c in columns.items()})
    for axis in AXES:
        w = line(axis, keys).rowsBetween(-reach, reach)
        df = df.withColumns({name: F.sum(name).over(w) for name in columns})
    return df.withColumns({name: F.col(name) / lit(float(width**3)) for name in columns})


def gaussian_filter(df: DataFrame, column: str, out: str, sigma: float = 0.8, truncate: float = 4.0, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Adds ``out``: separable Gaussian blur whose edges repeat the border cells in mirror order (d c b a | a b c d).

    The mirror never reaches farther than the line is long, so lines need at least as many cells as the radius.
    """
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    scale = sum(weights)
    df = df.withColumn(out, F.col(column))
    for axis in AXES:
        w = line(axis, keys)
        back = W.partitionBy(*keys, *[a for a in AXES if a != axis]).orderBy(F.col(axis).desc())
        whole = lambda o: o.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        # places from either end, and the cells that the mirror may show
        df = df.withColumns({"_low": F.row_number().over(w) - 1, "_high": F.row_number().over(back) - 1} | {f"_{side}{k}": F.nth_value(out, k + 1).over(whole(o)) for side, o in (("l", w), ("h", back)) for k in range(radius)})
        terms = [lit(weights[radius] / scale) * F.col(out)]
        for k in range(1, radius + 1):
            for side, place, near in (("l", "_low", F.lag(out, k).over(w)), ("h", "_high", F.lead(out, k).over(w))):
                mirrored = F.when(F.col(place) >= k, near)
                for i in range(k):
                    mirrored = mirrored.when(F.col(place) == i, F.col(f"_{side}{k - 1 - i}"))
                terms.append(lit(weights[radius + k] / scale) * mirrored)
        df = df.withColumn("_new", total(terms)).drop(out, "_low", "_high", *[f"_{side}{k}" for side in "lh" for k in range(radius)]).withColumnRenamed("_new", out)
    return df


def neighbours(n: int, here: bool = False, keys: tuple[str, ...] = ("sim_id",)):
    """A function from cells to cells that shares a face with them, inside the grid only."""
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)] + [(0, 0, 0)] * here

    def spread(df: DataFrame) -> DataFrame:
        to = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (F.col("z") + dz).alias("z")) for dx, dy, dz in steps])).alias("to")
        out = df.select(*[c for c in df.columns if c not in AXES], *[F.col(a).alias(f"from_{a}") for a in AXES], to)
        out = out.select(*[c for c in df.columns if c not in AXES], "from_x", "from_y", "from_z", "to.x", "to.y", "to.z")
        return out.where(" and ".join(f"{a} between 0 and {n - 1}" for a in AXES))

    return spread


def dilated(solid: DataFrame, n: int, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Solid cells and their face neighbours, without wrapping round: distinct (keys, x, y, z)."""
    return neighbours(n, here=True)(solid.select(*keys, *AXES)).select(*keys, *AXES).distinct()


def boundary(solid: DataFrame, n: int, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Cells next to a solid one that aren't solid themselves."""
    return dilated(solid, n, keys).join(solid.select(*keys, *AXES), [*keys, *AXES], "left_anti")
