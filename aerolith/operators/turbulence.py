"""Eddy viscosities and the vorticity confinement force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, lit, nan_to_num, total
from . import stencil

U = ("ux", "uy", "uz")
PARTS = ("11", "22", "33", "12", "13", "23")


def magnitude(prefix: str = "s"):
    """sqrt(2 S:S + 1e-12)."""
    return F.sqrt(2.0 * stencil.square_sum({f"{prefix}{k}": F.col(f"{prefix}{k}") for k in PARTS}, prefix) + 1e-12)


def with_gradient(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with the gradient of u, which takes a shuffle or a sort an axis where they lack it."""
    return df if "ux_x" in df.columns else stencil.gradient(df, U, keys)


def smagorinsky(df: DataFrame, cs: float = 0.17, delta: float = 1.0, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Adds nu_t = (cs delta)^2 |S|."""
    df = with_gradient(df, keys).withColumns(stencil.strain())
    return df.withColumn("nu_t", lit((cs * delta) ** 2) * magnitude())


def dynamic_smagorinsky(df: DataFrame, delta: float = 1.0, ratio: float = 2.0, low: float = 0.0, high: float = 0.2, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Adds cs (from the Germano identity, held in [low, high]) and nu_t = (cs delta)^2 |S|."""
    had = "ux_x" in df.columns
    df = with_gradient(df, keys).withColumns(stencil.strain())
    df = df.withColumn("s_mag", magnitude())
    df = df if had else df.drop(*[f"{u}_{a}" for u in U for a in "xyz"])
    pairs = {"11": ("ux", "ux"), "22": ("uy", "uy"), "33": ("uz", "uz"), "12": ("ux", "uy"), "13": ("ux", "uz"), "23": ("uy", "uz")}
    filtered = {f"t{u}": u for u in U} | {f"l{k}": F.col(a) * F.col(b) for k, (a, b) in pairs.items()}
    df = stencil.box_filter(df, filtered, keys, stencil.box_width(ratio))
    df = df.withColumns({f"l{k}": F.col(f"l{k}") - F.col(f"t{a}") * F.col(f"t{b}") for k, (a, b) in pairs.items()})
    tested = tuple(f"t{u}" for u in U)
    df = stencil.gradient(df, tested, keys)
    df = df.withColumns({k.replace("s", "ts"): c for k, c in stencil.strain(tested).items()})
    df = df.withColumn("ts_mag", magnitude("ts"))
    wide = (ratio * delta) ** 2
    df = df.withColumns({f"m{k}": -2.0 * delta**2 * F.col("s_mag") * F.col(f"s{k}") + 2.0 * wide * F.col("ts_mag") * F.col(f"ts{k}") for k in PARTS})
    twice = lambda f: total([f(k) for k in PARTS[:3]]) + 2.0 * total([f(k) for k in PARTS[3:]])
    lm = twice(lambda k: F.col(f"l{k}") * F.col(f"m{k}"))
    mm = twice(lambda k: F.col(f"m{k}") ** 2)
    square = F.greatest(nan_to_num(lm / (mm + 1e-12)), lit(1e-12))
    df = df.withColumn("cs", clamp(F.sqrt(square + 1e-12), low, high))
    df = df.withColumn("nu_t", F.col("cs") ** 2 * delta**2 * F.col("s_mag"))
    return df.drop(*[f"{p}{k}" for p in ("l", "m", "ts") for k in PARTS], *tested, *[f"{t}_{a}" for t in tested for a in "xyz"], "ts_mag")


def wale(df: DataFrame, cw: float = 0.5, delta: float = 1.0, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Adds nu_t of the wall-adapting model, from the diagonal of the squared velocity gradient."""
    df = with_gradient(df, keys)
    g = {(a, b): F.col(f"{u}_{b}") for a, u in zip("xyz", U, strict=True) for b in "xyz"}
    third = (g["x", "x"] + g["y", "y"] + g["z", "z"]) / 3.0
    diagonal = []
    for a in "xyz":
        squared = total([g[a, b] * g[b, a] for b in "xyz"])
        diagonal.append(squared - 2.0 * third * g[a, a])
    d = F.sqrt(total([x * x for x in diagonal]) + 1e-12)
    s = F.sqrt(2.0 * total([g[a, a] ** 2 for a in "xyz"]) + 1e-12)
    return df.withColumn("nu_t", lit((cw * delta) ** 2) * F.pow(d, lit(1.5)) / (F.pow(s, lit(2.5)) + F.pow(d, lit(1.25)) + 1e-12))


def eddy_viscosity(df: DataFrame, model: str | None, keys: tuple[str, ...] = ("sim_id",), delta: float = 1.0) -> DataFrame:
    """Adds nu_t by the named model; None means no model, and an unknown name is an error."""
    if model is None:
        return df.withColumn("nu_t", lit(0.0))
    models = {"smagorinsky": smagorinsky, "dynamic_smagorinsky": dynamic_smagorinsky, "wale": wale}
    if model not in models:
        raise ValueError(f"unknown turbulence model: {model}")
    return models[model](df, delta=delta, keys=keys)


def confinement_force(df: DataFrame, epsilon: float = 0.01, adaptive: bool = True, keys: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """Adds fx, fy, fz = epsilon (eta x vorticity), eta being the direction of rising vorticity.

    Components of eta are held in [1e-12, 1e12], so falling ones count as 1e-12. With ``adaptive`` epsilon is scaled by
    the vorticity over its mean of the whole grid.
    """
    if "wx" not in df.columns:
        df = stencil.vorticity(df.drop(*[f"{u}_{a}" for u in U for a in "xyz"]), keys=keys)
    w = tuple(F.col(c) for c in ("wx", "wy", "wz"))
    df = df.withColumn("w_mag", F.sqrt(w[0] ** 2 + w[1] ** 2 + w[2] ** 2 + 1e-12))
    df = stencil.gradient(df, ("w_mag",), keys)
    size = F.sqrt(total([F.col(f"w_mag_{a}") ** 2 for a in "xyz"]) + 1e-12)
    eta = [clamp(F.col(f"w_mag_{a}") / size, 1e-12, 1e12) for a in "xyz"]
    local = lit(epsilon)
    if adaptive:
        means = df.groupBy(*keys).agg(F.avg("w_mag").alias("w_mean"))  # one row a grid, summed before the shuffle
        df = df.join(means, list(keys))
        local = lit(epsilon) * (F.col("w_mag") / (F.col("w_mean") + 1e-12))
    df = df.withColumns({"fx": local * (eta[1] * w[2] - eta[2] * w[1]), "fy": local * (eta[2] * w[0] - eta[0] * w[2]), "fz": local * (eta[0] * w[1] - eta[1] * w[0])})
    return df.drop("w_mean", "w_mag_x", "w_mag_y", "w_mag_z")
