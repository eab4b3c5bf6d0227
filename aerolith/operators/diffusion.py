"""Noise schedules and denoising of latent codes: (id, v array<double>)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import lit, sigmoid
from . import graph


def schedule(spark: SparkSession, steps: int = 1000, first: float = 1e-4, last: float = 0.02) -> DataFrame:
    """(t, beta, alpha, alpha_bar, alpha_bar_prev, and the square roots used by samplers)."""
    t = F.col("t")
    rows = spark.range(steps).select(F.col("id").cast("int").alias("t")).withColumn("beta", lit(first) + (last - first) * t / lit(max(1, steps - 1)))
    w = W.orderBy("t")  # a schedule is one short table
    rows = rows.withColumn("alpha", 1.0 - F.col("beta")).withColumn("alpha_bar", F.product("alpha").over(w))
    bar = F.col("alpha_bar")
    return rows.withColumns({"alpha_bar_prev": F.lag("alpha_bar", 1, 1.0).over(w), "sqrt_bar": F.sqrt(bar), "sqrt_one_minus_bar": F.sqrt(1.0 - bar), "sqrt_recip": F.sqrt(1.0 / bar), "sqrt_recip_minus_one": F.sqrt(1.0 / bar - 1.0)})


def noised(latents: DataFrame, table: DataFrame) -> DataFrame:
    """Adds x_t = sqrt(alpha_bar) v + sqrt(1 - alpha_bar) noise at each row's own t."""
    rows = latents.join(F.broadcast(table.select("t", "sqrt_bar", "sqrt_one_minus_bar")), "t")
    a, b = F.col("sqrt_bar"), F.col("sqrt_one_minus_bar")
    return rows.withColumn("x_t", F.zip_with("v", "noise", lambda x, e: a * x + b * e))


def half_life_bar(t: Column, steps: int) -> Column:
    """0.5 ^ (t / steps): the schedule of the few-step sampler, which is not that of ``schedule``."""
    return F.pow(lit(0.5), t / lit(steps))


def consistency_noised(latents: DataFrame, steps: int) -> DataFrame:
    bar = half_life_bar(F.col("t"), steps)
    a, b = F.sqrt(bar), F.sqrt(1.0 - bar)
    return latents.withColumn("x_t", F.zip_with("v", "noise", lambda x, e: a * x + b * e))


def sampler_steps(steps: int = 100, count: int = 4) -> list[int]:
    return [steps - k * (steps // count) - 1 for k in range(count)]


def step_back(a: float):
    return lambda x, e: (x - (1 - a) * e) / math.sqrt(a + 1e-8)


def denoised(latents: DataFrame, predictor, steps: int = 100, count: int = 4, column: str = "x") -> DataFrame:
    """x <- (x - (1 - a) eps) / sqrt(a + 1e-8) at each step; predictor(x, t) gives the noise column."""
    for t in sampler_steps(steps, count):
        latents = latents.withColumn("_eps", predictor(F.col(column), t))
        latents = latents.withColumn(column, F.zip_with(column, "_eps", step_back(0.5 ** (t / steps)))).drop("_eps")
    return latents


def distillation(pairs: DataFrame, counts: tuple[int, ...] = (500, 250, 125, 64, 32), batch: int = 16, batches: int = 10) -> DataFrame:
    """(steps, loss, batches): mean over the first batches of the mean squared difference of two noised codes.

    Each count of steps compares a code noised at t % steps with the same code noised at the teacher's own t.
    """
    first = pairs.orderBy("id").limit(batch * batches)  # the sweep reads so many rows; a window over them is short
    first = first.withColumn("batch", F.floor((F.row_number().over(W.orderBy("id")) - 1) / batch))
    rows = first.withColumn("steps", F.explode(F.array(*[F.lit(c) for c in counts])))
    student = half_life_bar(F.col("t") % F.col("steps"), 1000)
    teacher = half_life_bar(F.col("t"), 1000)
    gap = F.zip_with("v", "noise", lambda x, e: F.pow((F.sqrt(student) - F.sqrt(teacher)) * x + (F.sqrt(1.0 - student) - F.sqrt(1.0 - teacher)) * e, lit(2.0)))
    rows = rows.withColumn("gap", F.aggregate(gap, lit(0.0), lambda s, x: s + x) / F.size("v"))
    per = rows.groupBy("steps", "batch").agg(F.avg("gap").alias("loss"))
    return per.groupBy("steps").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("batches"))


def decoded(latents: DataFrame, side: int, hidden: int = 32, size: int = 64, column: str = "x", salt: int = 7) -> DataFrame:
    """Adds p: occupancy of side^3 voxels from a code, by a two-layer network and a sigmoid."""
    raw = graph.mlp(column, graph.dense([size, hidden, side**3], salt), "relu")
    return latents.withColumn("_raw", raw).withColumn("p", F.transform("_raw", lambda x: sigmoid(x))).drop("_raw")


def voxels(decoded_rows: DataFrame, side: int, key: str = "design_id") -> DataFrame:
    """(key, x, y, z, cell, p) from the array of occupancies."""
    rows = decoded_rows.select(key, F.posexplode("p").alias("cell", "p"))
    return rows.select(key, (F.col("cell") / (side * side)).cast("int").alias("x"), (F.col("cell") / side % side).cast("int").alias("y"), (F.col("cell") % side).alias("z"), F.col("cell").cast("long").alias("cell"), "p")


def reshaped(latents: DataFrame, side: int, column: str = "v") -> DataFrame:
    """Adds p = sigmoid(v) for codes that are as long as the grid; others are an error."""
    ok = F.size(column) == side**3
    return latents.withColumn("p", F.when(ok, F.transform(column, lambda x: sigmoid(x))).otherwise(F.raise_error(F.lit("code and grid differ in size")).cast("array<double>")))


def mean_squared(df: DataFrame, a: str, b: str) -> Column:
    """Mean squared difference of two array columns of a row."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lit(0.0), lambda s, x: s + x) / F.size(a)


def cosine_rate(t: Column, period: float, rate: float) -> Column:
    return 0.5 * rate * (1.0 + F.cos(math.pi * t / lit(period)))
