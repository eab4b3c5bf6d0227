"""Forces, reference areas and coefficients of flow fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lit, total
from ..sources.lattice import Lattice
from . import stencil

SOUND = 343.0


def projected_area(cells: DataFrame, spacing: float = 1.0, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """(keys, area): number of (y, z) columns that hold a solid cell, times the face of a cell."""
    columns = cells.where("solid").groupBy(*keys, "y", "z").agg(F.lit(1).alias("one"))
    return columns.groupBy(*keys).agg((F.count("one") * lit(spacing**2)).alias("area"))


def link_force(boundary: DataFrame, lat: Lattice, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """(keys, force_x, force_z): sum over boundary cells and directions of e (f_i + f_opposite(i))."""
    pair = lambda i: F.col("f")[i] + F.col("f")[lat.opposite[i]]
    along = lambda axis: total([lit(e[axis]) * pair(i) for i, e in enumerate(lat.directions) if e[axis]])
    return boundary.groupBy(*keys).agg(F.sum(along(0)).alias("force_x"), F.sum(along(2)).alias("force_z"))


def link_force_by_wall(cells: DataFrame, lat: Lattice, n: int, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """(keys, force_x, force_z) over real links only: a fluid cell and the solid cell that its direction points to."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(s).alias(f"e{a}") for a, s in zip("xyz", e, strict=True)]) for i, e in enumerate(lat.directions) if any(e)])
    links = cells.where("not solid").select(*keys, "x", "y", "z", "f", F.explode(steps).alias("d"))
    links = links.select(*keys, *[F.pmod(F.col(a) + F.col(f"d.e{a}"), F.lit(n)).alias(a) for a in "xyz"], "d", (2.0 * F.element_at("f", F.col("d.i") + 1)).alias("momentum"))
    hit = links.join(cells.where("solid").select(*keys, "x", "y", "z"), [*keys, "x", "y", "z"], "left_semi")
    return hit.groupBy(*keys).agg(F.sum(F.col("d.ex") * F.col("momentum")).alias("force_x"), F.sum(F.col("d.ez") * F.col("momentum")).alias("force_z"))


def solid_momentum(cells: DataFrame, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """(keys, force_x, force_z): sums of ux and uz over solid cells."""
    return cells.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("solid"), F.col(u))), lit(0.0)).alias(f"force_{a}") for u, a in (("ux", "x"), ("uz", "z"))])


def coefficients(cells: DataFrame, lat: Lattice, n: int, mach: float, spacing: float = 1.0, exchange: str = "reference", keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """(keys, cd, cl, pressure_sum, max_vorticity) of fields with solid, f, rho and, if present, wx, wy, wz.

    exchange: ``reference`` sums over all directions of boundary cells, ``links`` over links to solid cells,
    ``momentum`` takes the momentum inside the solid.
    """
    if exchange == "links":
        force = link_force_by_wall(cells, lat, n, keys)
    elif exchange == "momentum":
        force = solid_momentum(cells, keys)
    elif exchange == "reference":
        edge = stencil.boundary(cells.where("solid"), n, keys)
        force = link_force(cells.join(edge, [*keys, "x", "y", "z"]), lat, keys)
    else:
        raise ValueError(f"unknown momentum exchange: {exchange}")
    pressure = 0.5 * (SOUND * mach) ** 2
    curl = F.sqrt(F.col("wx") ** 2 + F.col("wy") ** 2 + F.col("wz") ** 2) if "wx" in cells.columns else lit(0.0)
    whole = cells.groupBy(*keys).agg(F.sum("rho").alias("pressure_sum"), F.max(curl).alias("max_vorticity"))
    out = whole.join(force, list(keys), "left").join(projected_area(cells, spacing, keys), list(keys), "left")
    size = lambda c: F.abs(F.coalesce(c, lit(0.0)) + 1e-13) / (lit(pressure) * F.coalesce("area", lit(0.0)) + 1e-10)
    return out.select(*keys, size(F.col("force_x")).alias("cd"), size(F.col("force_z")).alias("cl"), "pressure_sum", "max_vorticity")


def field_summary(cells: DataFrame, spacing: float = 1.0, threshold: float = 0.2, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Largest vorticity, mean eddy viscosity, pressure sum, vortex cells and their volume, and what isn't finite."""
    odd = F.isnan("rho") | (F.abs(F.col("rho")) == float("inf"))
    return cells.groupBy(*keys).agg(F.max(F.sqrt(F.col("wx") ** 2 + F.col("wy") ** 2 + F.col("wz") ** 2)).alias("max_vorticity"), F.avg("nu_t").alias("mean_nu_t"), F.sum("rho").alias("pressure_sum"), F.count_if(F.col("q") > threshold).alias("vortex_cells"), (F.count_if(F.col("q") > threshold) * lit(spacing**3)).alias("vortex_volume"), F.count_if(odd).alias("not_finite"))


def two_resolutions(coarse: DataFrame, fine: DataFrame, outside: DataFrame | None = None, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Mean of two resolutions, and, where an outside solver has a result, 0.7 of it plus 0.3 of that result."""
    out = coarse.join(fine.select(*keys, F.col("cd").alias("fine_cd"), F.col("cl").alias("fine_cl")), list(keys), "left")
    mean = {c: F.coalesce((F.col(c) + F.col(f"fine_{c}")) / 2, F.col(c)) for c in ("cd", "cl")}
    out = out.select(*keys, mean["cd"].alias("cd"), mean["cl"].alias("cl"))
    if outside is None:
        return out.withColumn("blended", F.lit(False))
    out = out.join(outside.select(*keys, F.col("cd").alias("out_cd"), F.col("cl").alias("out_cl")), list(keys), "left")
    blend = {c: F.when(F.col("out_cd").isNull(), F.col(c)).otherwise(0.7 * F.col(c) + 0.3 * F.col(f"out_{c}")) for c in ("cd", "cl")}
    return out.select(*keys, blend["cd"].alias("cd"), blend["cl"].alias("cl"), F.col("out_cd").isNotNull().alias("blended"))


def outside_stub(designs: DataFrame, keys: tuple[str, ...] = ("sim_id",), volume: float = 0.1) -> DataFrame:
    """(keys, cd, cl): what the outside solver returns for any shape."""
    return designs.select(*keys, lit(0.02 + volume * 0.1).alias("cd"), lit(volume * 0.4).alias("cl"))


def design_loss(results: DataFrame, space: float = 33.0, drag: float = 33.0, lift: float = 34.0) -> DataFrame:
    """One row: mean over designs (volume, cd, cl) of space * volume + drag * cd + lift * (1 - min(|cl|, 1))."""
    loss = lit(space) * F.col("volume") + lit(drag) * F.col("cd") + lit(lift) * (1.0 - F.least(F.abs("cl"), lit(1.0)))
    return results.agg(F.avg(loss).alias("loss"))
