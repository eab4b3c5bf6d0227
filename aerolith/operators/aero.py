"""The closed-form aerodynamic model: a projection over rows of features and flow states."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, lit
from ..sources.grids import sheet_faces, sheet_vertices
from . import mesh

GRAVITY = 9.81
DEFAULTS = {"aoa_deg": 10.0, "v": 10.0, "rho": 1.225, "mu": 1.81e-5}


def with_defaults(df: DataFrame, defaults: dict[str, float] = DEFAULTS) -> DataFrame:
    """State columns that are missing or null take the configured value."""
    return df.withColumns({k: F.coalesce(F.col(k), lit(v)) if k in df.columns else lit(v) for k, v in defaults.items()})


def lifting_line(aoa: Column, ar: Column, camber: Column) -> tuple[Column, Column]:
    """Lift and induced drag of a finite wing."""
    flat = 2 * math.pi * (aoa + camber * math.radians(5))
    cl = flat / (1 + flat / (math.pi * ar + 1e-8))
    return cl, cl * cl / (math.pi * ar * 0.8 + 1e-8)


def skin_friction(re: Column) -> Column:
    """Laminar below Re 5e5, turbulent from there on."""
    return F.when(re < 5e5, 1.328 / F.sqrt(re + 1e-8)).otherwise(0.0744 / (F.pow(re, lit(0.2)) + 1e-8))


def surrogate(designs: DataFrame) -> DataFrame:
    """Adds re, cl, cd, ld, range_est from area_proj, chord, ar, camber, dihedral, area_wet and the flow state."""
    aoa = F.radians("aoa_deg")
    re = F.col("rho") * F.col("v") * F.col("chord") / (F.col("mu") + 1e-8)
    df = designs.withColumns({"re": re, "_aoa": aoa})
    cl, induced = lifting_line(F.col("_aoa"), F.col("ar"), F.col("camber"))
    df = df.withColumns({"cl": cl + 0.1 * F.col("dihedral"), "_induced": induced})
    viscous = 1.1 * skin_friction(F.col("re")) * 2 * F.col("area_wet") / (F.col("area_proj") + 1e-8)
    stall = 1.0 + 2.0 * F.greatest(lit(0.0), F.col("_aoa") - math.radians(15)) / math.pi
    df = df.withColumn("cd", viscous + F.col("_induced") * stall)
    df = df.withColumn("ld", F.col("cl") / (F.col("cd") + 1e-8) * 0.8)
    return df.withColumn("range_est", F.col("ld") * F.col("v") ** 2 * math.sin(math.radians(20)) / GRAVITY).drop("_aoa", "_induced")


def evaluate(actions: DataFrame, resolution: int = 10, key: str = "design_id") -> DataFrame:
    """Fold, measure and rate any number of actions in one plan; state columns of ``actions`` are used if present."""
    spark = actions.sparkSession
    vertex = mesh.folded(actions, sheet_vertices(spark, resolution), key)
    measured = mesh.features(vertex, sheet_faces(spark, resolution), key)
    states = with_defaults(actions).select(key, *DEFAULTS)
    return surrogate(measured.join(states, key))


def from_forces(df: DataFrame) -> DataFrame:
    """Adds cd, cl, range_est from force_x, force_z, area (projected) and state; 0 where the dynamic pressure isn't positive."""
    q = 0.5 * F.col("rho") * F.col("v") ** 2 * F.col("area")
    df = df.withColumns({"cd": F.when(q > 0, -F.col("force_x") / q).otherwise(lit(0.0)), "cl": F.when(q > 0, F.col("force_z") / q).otherwise(lit(0.0))})
    ld = F.when(F.col("cd") > 0, F.col("cl") / F.col("cd")).otherwise(lit(0.0))
    return df.withColumn("range_est", ld * F.col("v") ** 2 * math.sin(math.radians(20)) / GRAVITY)


def from_outside_forces(df: DataFrame) -> DataFrame:
    """As ``from_forces``, with drag along x, the range by the angle of attack, and results held in their bounds."""
    q = 0.5 * F.col("rho") * F.col("v") ** 2 * F.col("area")
    cl = F.when(F.col("area") > 0, F.col("force_z") / q).otherwise(lit(0.3))
    cd = F.when(F.col("area") > 0, F.col("force_x") / q).otherwise(lit(0.05))
    df = df.withColumns({"_cl": cl, "_cd": cd}).withColumn("ld", F.col("_cl") / (F.col("_cd") + 1e-8))
    reach = F.col("ld") * F.col("v") ** 2 * F.sin(2 * F.radians("aoa_deg")) / GRAVITY
    return df.withColumns({"cl": clamp(F.col("_cl"), -2, 2), "cd": clamp(F.col("_cd"), 0.01, 1), "range_est": clamp(reach, 0, 100)}).drop("_cl", "_cd")


def best_known(surrogates: DataFrame, outside: DataFrame, key: str = "design_id") -> DataFrame:
    """High-fidelity results where there are any, else the surrogate's; ``source`` says which."""
    names = ["cl", "cd", "ld", "range_est"]
    high = outside.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    out = surrogates.select(key, *names).join(high, key, "left")
    return out.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in names], F.when(F.col("_cl").isNull(), "surrogate").otherwise("outside").alias("source"))


def bounded(df: DataFrame) -> DataFrame:
    """Learned predictions held in their physical bounds."""
    return df.withColumns({"cl": clamp(F.col("cl"), -2, 2), "cd": clamp(F.col("cd"), 0.01, 1), "range_est": clamp(F.col("range_est"), 0, 100)})


def batch_for_memory(gigabytes: Column) -> Column:
    """Designs of a batch that fit a device."""
    return F.when(gigabytes >= 12, 128).when(gigabytes >= 6, 64).otherwise(32)


def bounded_estimate(available: Column, each: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), (available / each).cast("int")))
