"""Log-periodic antennas: gain and reflection over a frequency sweep."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, lit
from ..sources.grids import dipole_lengths

LIGHT = 3e8


def sweep(params: DataFrame, frequencies: DataFrame, f0: float, f1: float) -> DataFrame:
    """(tau, sigma, f, gain, s11_db, s11_re, s11_im): every array at every frequency, without measurement noise."""
    elements = dipole_lengths(params, f0, f1)
    whole = elements.groupBy("tau", "sigma").agg(F.sum("spacing").alias("long"), F.max("length").alias("first"))
    pairs = elements.select("tau", "sigma", "length").join(F.broadcast(frequencies))
    own = LIGHT / (2 * F.col("length"))
    peaks = pairs.groupBy("tau", "sigma", "f").agg(F.sum(0.3 * F.exp(-8.0 * F.pow((F.col("f") - own) / own, lit(2.0)))).alias("peaks"))
    rows = peaks.join(whole, ["tau", "sigma"])
    mean = frequencies.agg(F.avg("f").alias("mean_f"))
    rows = rows.join(F.broadcast(mean))
    ripple = 2.5 * (1 - 0.5 * F.col("sigma")) * F.sin(2 * math.pi * F.log10(F.col("f") / F.col("mean_f")))
    gain = 12 * (1 - F.col("tau")) + 8 + 3 * F.col("sigma") + ripple
    level = clamp(-18 - 15 * F.col("sigma") + F.col("peaks"), -35, -5)
    k = 2 * math.pi * F.col("f") / LIGHT
    phase = -k * F.col("long") + 0.5 * F.sin(k * F.col("first"))
    size = F.pow(lit(10.0), level / 20.0)
    return rows.select("tau", "sigma", "f", gain.alias("gain"), level.alias("s11_db"), (size * F.cos(phase)).alias("s11_re"), (size * F.sin(phase)).alias("s11_im"))


def in_box() -> Column:
    """Parameters that an array may have; others cost 1e12."""
    return (F.col("tau") > 0.8) & (F.col("tau") < 0.98) & (F.col("sigma") > 0.05) & (F.col("sigma") < 0.25)


def cost(params: DataFrame, frequencies: DataFrame, f0: float, f1: float, rms: float = 0.0) -> DataFrame:
    """(tau, sigma, n_elements, cost): -mean gain + 100 rms + a penalty above seven elements; 1e12 outside the bounds."""
    allowed = in_box()
    inside = params.where(allowed)
    count = dipole_lengths(inside, f0, f1).groupBy("tau", "sigma").agg(F.count(F.lit(1)).alias("n_elements"))
    gain = sweep(inside, frequencies, f0, f1).groupBy("tau", "sigma").agg(F.avg("gain").alias("mean_gain"))
    rated = params.join(count.join(gain, ["tau", "sigma"]), ["tau", "sigma"], "left")
    over = F.greatest(F.lit(0), F.col("n_elements") - 7).cast("double")
    return rated.select("tau", "sigma", "n_elements", F.when(allowed, -F.col("mean_gain") + 100 * rms + over * over * 5e5).otherwise(lit(1e12)).alias("cost"))


def best(costs: DataFrame) -> DataFrame:
    return costs.agg(F.min_by(F.struct("tau", "sigma"), F.struct("cost", "tau", "sigma")).alias("p"), F.min("cost").alias("cost")).select("p.tau", "p.sigma", "cost")
