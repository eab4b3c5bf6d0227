"""Queries: telemetry, diffusion schedules, viewer transfers, refinement, antennas, parsers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lit, r
from ..operators import amr, antenna, diffusion, mesh, telemetry, viz
from ..sources import grids, logs, stl
from ..streaming import metrics
from . import fixtures as fx
from .grid_plans import KERNEL_SQL, gauss_sql
from .registry import query, table

KEYS, ORDER = ("user_id",), ("ts", "event_id")
RUN = "(PARTITION BY user_id ORDER BY ts, event_id"

# ------------------------------------------------------------------ telemetry


@query("win12_trailing_mean", f"SELECT event_id, round(avg(value) OVER {RUN} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) + 0.0 AS trailing FROM events")
def win12(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.trailing_mean(fx.series(spark, d), "value", KEYS, ORDER).select("event_id", r(F.col("trailing")).alias("trailing"))


@query("win10_exponential_mean", f"""WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER {RUN}) AS n FROM events),
e AS (SELECT user_id, event_id, n, value AS ema FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.event_id, s.n, 0.731::DOUBLE * e.ema + (1 - 0.731::DOUBLE) * s.value FROM e JOIN s ON s.user_id = e.user_id AND s.n = e.n + 1)
SELECT event_id, round(ema, 9) + 0.0 AS ema FROM e""")
def win10(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.exponential_mean(fx.series(spark, d), "value", KEYS, ORDER, 0.731).select("event_id", r(F.col("ema"), 9).alias("ema"))


@query("doc06_mean_reverting_noise", f"""WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER {RUN}) AS n FROM events),
e AS (SELECT user_id, event_id, n, 0.863::DOUBLE * 0.37 + 0.137::DOUBLE * 0.37 + 0.2::DOUBLE * value AS x FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.event_id, s.n, 0.863::DOUBLE * e.x + 0.137::DOUBLE * 0.37 + 0.2::DOUBLE * s.value FROM e JOIN s ON s.user_id = e.user_id AND s.n = e.n + 1)
SELECT event_id, round(x, 9) + 0.0 AS state FROM e""")
def doc06(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.mean_reverting(fx.series(spark, d), "value", KEYS, ORDER, pull=0.137, mean=0.37).select("event_id", r(F.col("state"), 9).alias("state"))


@query("joi13_positional_zip", """WITH a AS (SELECT *, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS place FROM part), b AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1 AS place FROM events)
SELECT place, p_partkey, event_id FROM a JOIN b USING (place)""")
def joi13(spark: SparkSession, d: str) -> DataFrame:
    events = fx.series(spark, d).withColumns({"back": -F.unix_micros(F.col("ts").cast("timestamp")), "down": -F.col("event_id")})
    both = telemetry.zipped(table(spark, d, "part"), events, ("p_size", "p_partkey"), ("back", "down"))
    return both.select("place", "p_partkey", "event_id")


@query("win13_early_stopping", f"""WITH b AS (SELECT *, min(value) OVER {RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(value) OVER {RUN}) AS best FROM events),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR value < before THEN 1 ELSE 0 END) OVER {RUN}) AS run FROM b),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS waited FROM g)
SELECT event_id, best, CAST(waited AS INTEGER) AS waited, waited >= 10 AS stop FROM w""")
def win13(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.early_stopping(fx.series(spark, d), "value", KEYS, ORDER).select("event_id", "best", "waited", "stop")


@query("win14_periodic_events", "SELECT event_id FROM events WHERE event_id % 250 = 0")
def win14(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.every(fx.series(spark, d), "event_id", 250).select("event_id")


EPISODES = f"ep AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER {RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM events)"


@query("itr05_episodes", f"WITH {EPISODES} SELECT user_id, CAST(episode AS BIGINT) AS episode, round(sum(value), 6) + 0.0 AS total, max(value) AS best, count(*) AS steps FROM ep GROUP BY user_id, episode")
def itr05(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.episode_totals(telemetry.episodes(fx.series(spark, d), "done", KEYS, ORDER), "value", KEYS)
    return out.withColumn("total", r(F.col("total")))


@query("agg24_episode_extremes", f"WITH {EPISODES}, t AS (SELECT user_id, episode, sum(value) AS total FROM ep GROUP BY ALL) SELECT user_id, round(max(total), 6) + 0.0 AS best_total, count(*) AS episodes FROM t GROUP BY user_id")
def agg24(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.episode_totals(telemetry.episodes(fx.series(spark, d), "done", KEYS, ORDER), "value", KEYS)
    return out.groupBy("user_id").agg(r(F.max("total")).alias("best_total"), F.count(F.lit(1)).alias("episodes"))


@query("itr04_ring_buffer", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def itr04(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.ring_buffer(fx.series(spark, d), KEYS, ORDER, 10).select("user_id", "event_id")


@query("itr07_random_walk", f"SELECT event_id, round(sum(value) OVER {RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) + 0.0 AS state FROM events")
def itr07(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.random_walk(fx.series(spark, d), "value", KEYS, ORDER).select("event_id", r(F.col("state"), 5).alias("state"))


@query("srt04_position_split", "WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS nth, count(*) OVER () AS n FROM part) SELECT p_partkey, CASE WHEN nth <= n - floor(n * 0.2::DOUBLE) THEN 'train' ELSE 'validate' END AS part FROM p")
def srt04(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.split(table(spark, d, "part").select("p_partkey"), ("p_partkey",))


@query("src19_mini_batches", "SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 32 AS BIGINT) AS batch FROM part")
def src19(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.batched(table(spark, d, "part").select("p_partkey"), 32, ("p_partkey",))


@query("agg18_epoch_means", "SELECT event_id // 100 AS epoch, round(avg(value), 6) + 0.0 AS mean, count(*) AS batches FROM events GROUP BY 1")
def agg18(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("epoch", F.floor(F.col("event_id") / 100))
    return telemetry.epoch_means(rows, "value", "epoch").withColumn("mean", r(F.col("mean")))


@query("win16_softmax", "WITH m AS (SELECT event_id, user_id, exp(value / 100 - max(value / 100) OVER (PARTITION BY user_id)) AS e FROM events) SELECT event_id, round(e / sum(e) OVER (PARTITION BY user_id), 9) + 0.0 AS weight FROM m")
def win16(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.series(spark, d).withColumn("score", F.col("value") / 100)
    return telemetry.softmax(rows, "score", KEYS).select("event_id", r(F.col("weight"), 9).alias("weight"))


@query("win17_cosine_rate", "SELECT k, round(0.5 * 0.001 * (1 + cos(pi() * k / 200)), 9) + 0.0 AS rate FROM range(201) t(k)")
def win17(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(201).select(F.col("id").alias("k"), r(diffusion.cosine_rate(F.col("id"), 200, 0.001), 9).alias("rate"))


# ------------------------------------------------------------------ diffusion

BARS = "bars AS (SELECT CAST(t AS INTEGER) AS t, product(1 - (0.0001::DOUBLE + 0.0199::DOUBLE * t / 999)) OVER (ORDER BY t) AS bar FROM range(1000) s(t))"


@query("win08_noise_schedule", f"WITH {BARS} SELECT t, round(bar, 9) + 0.0 AS alpha_bar, round(lag(bar, 1, 1.0) OVER (ORDER BY t), 9) + 0.0 AS alpha_bar_prev FROM bars")
def win08(spark: SparkSession, d: str) -> DataFrame:
    return diffusion.schedule(spark).select("t", r(F.col("alpha_bar"), 9).alias("alpha_bar"), r(F.col("alpha_bar_prev"), 9).alias("alpha_bar_prev"))


PICKED = "round({x}[1], 6) + 0.0 AS first, round(list_sum({x}), 5) + 0.0 AS total"


def picked(column: str) -> list:
    x = F.col(column)
    return [r(x[0]).alias("first"), r(F.aggregate(x, lit(0.0), lambda a, b: a + b), 5).alias("total")]


@query("cmp34_forward_noise", f"WITH {BARS}, {fx.LATENTS_SQL}, x AS (SELECT id, list_transform(list_zip(v, noise), lambda p: sqrt(bar) * p[1] + sqrt(1 - bar) * p[2]) AS x FROM latent JOIN bars USING (t)) SELECT id, {PICKED.format(x='x')} FROM x")
def cmp34(spark: SparkSession, d: str) -> DataFrame:
    return diffusion.noised(fx.latents(spark, d), diffusion.schedule(spark)).select("id", *picked("x_t"))


@query("cmp35_consistency_noise", f"WITH {fx.LATENTS_SQL}, x AS (SELECT id, list_transform(list_zip(v, noise), lambda p: sqrt(pow(0.5, t / 1000.0::DOUBLE)) * p[1] + sqrt(1 - pow(0.5, t / 1000.0::DOUBLE)) * p[2]) AS x FROM latent) SELECT id, {PICKED.format(x='x')} FROM x")
def cmp35(spark: SparkSession, d: str) -> DataFrame:
    return diffusion.consistency_noised(fx.latents(spark, d), 1000).select("id", *picked("x_t"))


def denoise_sql() -> str:
    x = "p[1]"
    for t in (99, 74, 49, 24):
        x = f"(({x}) - (1 - pow(0.5, {t} / 100.0::DOUBLE)) * p[2]) / sqrt(pow(0.5, {t} / 100.0::DOUBLE) + 1e-8)"
    return f"SELECT id, list_transform(list_zip(v, noise), lambda p: {x}) AS v FROM latent"


DENOISED = denoise_sql()


@query("cmp36_denoise", f"WITH {fx.LATENTS_SQL}, x AS ({DENOISED}) SELECT id, {PICKED.format(x='v')} FROM x")
def cmp36(spark: SparkSession, d: str) -> DataFrame:
    return diffusion.denoised(fx.latents(spark, d), lambda x, t: F.col("noise"), column="v").select("id", *picked("v"))


@query("agg17_mean_squared", f"WITH {fx.LATENTS_SQL} SELECT id, round(list_avg(list_transform(list_zip(v, noise), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) + 0.0 AS mse FROM latent")
def agg17(spark: SparkSession, d: str) -> DataFrame:
    return fx.latents(spark, d).select("id", r(diffusion.mean_squared(None, "v", "noise")).alias("mse"))


# ------------------------------------------------------------------ viewer

@query("agg19_percentile_linear", "SELECT user_id, round(quantile_cont(value, 0.02), 6) + 0.0 AS vmin, round(quantile_cont(value, 0.98), 6) + 0.0 AS vmax, round(stddev_pop(value), 6) + 0.0 AS spread FROM events GROUP BY user_id")
def agg19(spark: SparkSession, d: str) -> DataFrame:
    out = viz.linear_percentiles(fx.series(spark, d), "value", KEYS)
    return out.select("user_id", *[r(F.col(c)).alias(c) for c in ("vmin", "vmax", "spread")])


@query("agg19_percentile_index", "WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, max(CASE WHEN i = floor(n * 0.02::DOUBLE) THEN value END) AS vmin, max(CASE WHEN i = floor(n * 0.98::DOUBLE) THEN value END) AS vmax FROM s GROUP BY user_id")
def agg19_index(spark: SparkSession, d: str) -> DataFrame:
    return viz.index_percentiles(fx.series(spark, d), "value", KEYS)


@query("cmp40_normalised_volume", "WITH b AS (SELECT user_id, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events GROUP BY user_id) SELECT event_id, round(CASE WHEN hi - lo > 1e-10 THEN greatest(0, least(1, (value - lo) / (hi - lo))) ELSE 0 END, 6) + 0.0 AS v FROM events JOIN b USING (user_id)")
def cmp40(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.series(spark, d)
    return viz.normalised(rows, "value", viz.linear_percentiles(rows, "value", KEYS), KEYS).select("event_id", r(F.col("v")).alias("v"))


@query("cmp40_volume_bytes", f"""WITH {fx.single(fx.SMOOTH_SQL)}, {KERNEL_SQL}, b AS (SELECT quantile_cont(uz, 0.02) AS lo, quantile_cont(uz, 0.98) AS hi FROM u), v0 AS (SELECT sim, c, x, y, z, greatest(0, least(1, (uz - lo) / (hi - lo))) AS v FROM u, b),
{gauss_sql('v0', 'v', 'x', 'g1')}, {gauss_sql('g1', 'v', 'y', 'g2')}, {gauss_sql('g2', 'v', 'z', 'g3')}, t AS (SELECT c AS cell, CASE WHEN v < 0.1 THEN 0 ELSE v END AS v FROM g3),
l AS (SELECT cell, v, least(255, trunc(v * 256)) / 255.0::DOUBLE * 2 AS s FROM t), m AS (SELECT *, CASE WHEN s >= 1 THEN s - 1 ELSE 0 END AS r, CASE WHEN s >= 1 THEN 1 - (s - 1) ELSE s END AS g, CASE WHEN s >= 1 THEN 0.5 + (s - 1) * -0.5 ELSE 0.5 END AS b FROM l)
SELECT cell, CAST(floor(r * 255) AS SMALLINT) AS red, CAST(floor(g * 255) AS SMALLINT) AS green, CAST(floor(b * 255) AS SMALLINT) AS blue, CAST(floor(greatest(0, least(0.95, pow(v, 0.25) * 0.95)) * 255) AS SMALLINT) AS alpha FROM m""")
def cmp40_bytes(spark: SparkSession, d: str) -> DataFrame:
    return viz.volume(fx.smooth(spark), "uz", viz.ramp(spark, [(0.0, 0.0, 0.5), (0.0, 1.0, 0.5), (1.0, 0.0, 0.0)]), smooth=True).select("cell", "red", "green", "blue", "alpha")


@query("agg21_histogram", "SELECT CAST(least(19, floor(value / 100 * 20)) AS INTEGER) AS bin, count(*) AS count FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def agg21(spark: SparkSession, d: str) -> DataFrame:
    return viz.histogram(table(spark, d, "events"), "value", 20, 0.0, 100.0)


@query("agg22_box_plot", "SELECT event_type, round(quantile_cont(value, 0.25), 6) + 0.0 AS q1, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(quantile_cont(value, 0.75), 6) + 0.0 AS q3 FROM events GROUP BY event_type")
def agg22(spark: SparkSession, d: str) -> DataFrame:
    return viz.box_plot(table(spark, d, "events"), "value", ("event_type",)).select("event_type", *[r(F.col(c)).alias(c) for c in ("q1", "median", "q3")])


@query("agg23_key_figures", "SELECT event_type, round(avg(value), 6) + 0.0 AS mean, max(value) AS highest, min(value) AS lowest FROM events GROUP BY event_type")
def agg23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(r(F.avg("value")).alias("mean"), F.max("value").alias("highest"), F.min("value").alias("lowest"))


@query("cmp42_streamlines")
def cmp42(spark: SparkSession, d: str) -> DataFrame:
    flow = fx.smooth(spark, d).withColumn("ux", lit(1.0)).select("sim_id", "x", "y", "z", "ux", "uy", "uz")
    return viz.streamlines(flow, viz.seeds(spark, fx.N, 4), fx.N, length=2, least=1)


# ------------------------------------------------------------------ refinement

TREE = "blocks AS (SELECT user_id % 8 AS block_id, 0 AS level, max(CASE WHEN user_id % 8 % 3 = 0 THEN value ELSE 0 END) > 0.2 AS hit FROM events GROUP BY user_id % 8)"


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Eight blocks, refined where the events of a block are high."""
    roots, block = amr.new_tree(spark, 8, 4), F.col("user_id") % 8
    fields = table(spark, d, "events").select(block.alias("block_id"), F.when(block % 3 == 0, F.col("value")).otherwise(lit(0.0)).alias("q"), lit(0.0).alias("vorticity"))
    return amr.refined(roots, amr.marked(roots, fields, 3))


@query("cmp44_adapted_blocks", f"WITH {TREE} SELECT block_id, level, NOT hit AS is_leaf FROM blocks UNION ALL SELECT (block_id + 1) * 8 + o, 1, true FROM blocks, range(8) s(o) WHERE hit")
def cmp44(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d).select("block_id", "level", "is_leaf")


@query("agg25_blocks_per_level", f"WITH {TREE} SELECT 0 AS level, count(*) FILTER (WHERE NOT hit) AS blocks FROM blocks UNION ALL SELECT 1, 8 * count(*) FILTER (WHERE hit) FROM blocks")
def agg25(spark: SparkSession, d: str) -> DataFrame:
    return amr.per_level(tree(spark, d))


@query("cmp46_subcycles", f"WITH {TREE}, l AS (SELECT 0 AS level, count(*) FILTER (WHERE NOT hit) AS blocks FROM blocks UNION ALL SELECT 1, 8 * count(*) FILTER (WHERE hit) FROM blocks) SELECT CAST(s AS INTEGER) AS substep, level, blocks FROM l, range(2) t(s) WHERE level = 1 OR s % 2 = 0")
def cmp46(spark: SparkSession, d: str) -> DataFrame:
    return amr.subcycles(tree(spark, d))


@query("cmp43_prolongation", f"""WITH {fx.single(fx.SMOOTH_SQL)}, k AS (SELECT CAST(o AS INTEGER) AS octant, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, CAST(l AS INTEGER) AS z, 4 * (o // 4) + i * 3 / 7.0::DOUBLE AS px, 4 * (o // 2 % 2) + j * 3 / 7.0::DOUBLE AS py, 4 * (o % 2) + l * 3 / 7.0::DOUBLE AS pz FROM range(8) a(o), range(8) b(i), range(8) c(j), range(8) e(l))
SELECT 0::BIGINT AS block_id, octant, k.x, k.y, k.z, round(sum(uz * (1 - abs(px - u.x)) * (1 - abs(py - u.y)) * (1 - abs(pz - u.z))), 6) + 0.0 AS uz FROM k JOIN u ON abs(px - u.x) < 1 AND abs(py - u.y) < 1 AND abs(pz - u.z) < 1 GROUP BY ALL""")
def cmp43(spark: SparkSession, d: str) -> DataFrame:
    return amr.prolonged(fx.smooth(spark).withColumnRenamed("sim_id", "block_id"), fx.N, ("uz",)).withColumn("uz", r(F.col("uz")))


# ------------------------------------------------------------------ antennas

def arrays(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Antennas of the parameters of all parts, and frequencies."""
    k = F.col("p_partkey")
    params = table(spark, d, "part").select((0.78 + k % 17 / lit(100)).alias("tau"), (0.04 + k % 1800 / lit(10_000)).alias("sigma")).distinct()
    return params, spark.range(101).select((1e8 + F.col("id") * 9.9e7).alias("f"))


LPDA = """p AS MATERIALIZED (SELECT DISTINCT 0.78::DOUBLE + p_partkey % 17 / 100.0::DOUBLE AS tau, 0.04::DOUBLE + p_partkey % 1800 / 10000.0::DOUBLE AS sigma FROM part), freq AS (SELECT 1e8 + k * 9.9e7 AS f FROM range(101) t(k)),
el AS (SELECT tau, sigma, k, 1.5 * pow(tau, k) AS len FROM p, range(60) t(k) WHERE 1.5 * pow(tau, k) >= 3e8 / 1e9 / 4)"""


@query("src22_dipole_lengths", f"WITH {LPDA} SELECT tau, sigma, CAST(k AS INTEGER) AS k, round(len, 9) + 0.0 AS length, round(4 * sigma * len, 9) + 0.0 AS spacing FROM el")
def src22(spark: SparkSession, d: str) -> DataFrame:
    params, _ = arrays(spark, d)
    out = grids.dipole_lengths(params, 1e8, 1e9)
    return out.select("tau", "sigma", "k", r(F.col("length"), 9).alias("length"), r(F.col("spacing"), 9).alias("spacing"))


@query("win15_element_positions", f"WITH {LPDA} SELECT tau, sigma, CAST(k AS INTEGER) AS k, round(coalesce(sum(4 * sigma * len) OVER (PARTITION BY tau, sigma ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) + 0.0 AS position FROM el")
def win15(spark: SparkSession, d: str) -> DataFrame:
    params, _ = arrays(spark, d)
    return grids.dipole_lengths(params, 1e8, 1e9).select("tau", "sigma", "k", r(F.col("position"), 9).alias("position"))


@query("cmp48_antenna_sweep", f"""WITH {LPDA} SELECT tau, sigma, f, round(12 * (1 - tau) + 8 + 3 * sigma + 2.5 * (1 - 0.5 * sigma) * sin(2 * pi() * log10(f / (SELECT avg(f) FROM freq))), 6) + 0.0 AS gain,
round(greatest(-35, least(-5, -18 - 15 * sigma + sum(0.3 * exp(-8 * pow((f - 3e8 / (2 * len)) / (3e8 / (2 * len)), 2))))), 6) + 0.0 AS s11_db FROM el, freq GROUP BY tau, sigma, f""")
def cmp48(spark: SparkSession, d: str) -> DataFrame:
    params, f = arrays(spark, d)
    return antenna.sweep(params, f, 1e8, 1e9).select("tau", "sigma", "f", r(F.col("gain")).alias("gain"), r(F.col("s11_db")).alias("s11_db"))


@query("cmp49_antenna_cost", f"""WITH {LPDA}, g AS (SELECT tau, sigma, avg(12 * (1 - tau) + 8 + 3 * sigma + 2.5 * (1 - 0.5 * sigma) * sin(2 * pi() * log10(f / (SELECT avg(f) FROM freq)))) AS gain FROM p, freq GROUP BY tau, sigma),
n AS (SELECT tau, sigma, count(*) AS n FROM el GROUP BY tau, sigma), ok AS (SELECT *, tau > 0.8 AND tau < 0.98 AND sigma > 0.05 AND sigma < 0.25 AS ok FROM g JOIN n USING (tau, sigma))
SELECT tau, sigma, CASE WHEN ok THEN n END AS n_elements, round(CASE WHEN ok THEN -gain + pow(greatest(0, n - 7), 2) * 5e5 ELSE 1e12 END, 5) AS cost FROM ok""")
def cmp49(spark: SparkSession, d: str) -> DataFrame:
    return antenna.cost(*arrays(spark, d), 1e8, 1e9).withColumn("cost", F.round("cost", 5))


# ------------------------------------------------------------------ parsers, files, streams

@query("src12_bracketed_forces", "SELECT event_id AS file, CAST(event_id AS DOUBLE) AS time, value AS force_x, 2.0::DOUBLE AS force_y, -1.5::DOUBLE AS force_z FROM events")
def src12(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    lines = e.select(F.col("event_id").alias("file"), F.posexplode(F.array(F.lit("# time forces"), F.lit("0 (1 1 1) (0 0 0)"), F.concat(F.col("event_id").cast("string"), F.lit(" ("), F.col("value").cast("string"), F.lit(" 2 -1.5) (0 0 0)")), F.lit(""))).alias("line_no", "line"))
    return logs.bracketed_forces(lines).select("file", "time", "force_x", "force_y", "force_z")


@query("src14_json_results", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE 0.5 END AS cl, 0.05::DOUBLE AS cd, 10.0::DOUBLE AS ld, 20.0::DOUBLE AS range_est FROM events")
def src14(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("value").alias("cl")))).otherwise("{}")
    return logs.json_results(e.select("event_id", text.alias("value"))).select("event_id", "cl", "cd", "ld", "range_est")


@query("src15_printed_results", "SELECT event_id AS file, value AS cl, 0.0::DOUBLE AS cd FROM events")
def src15(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    lines = e.select(F.col("event_id").alias("file"), F.posexplode(F.array(F.lit("starting"), F.concat(F.lit("final cl = "), F.col("value").cast("string")), F.lit("cd n/a"))).alias("line_no", "line"))
    return logs.printed_results(lines)


@query("snk01_stl_round_trip", f"""WITH {fx.VOXELS_SQL}, s AS (SELECT * FROM voxel WHERE p > 0.5)
SELECT design_id, 12 * count(*) AS triangles, round(count(*) * 6.0::DOUBLE, 6) AS area, CAST(sum(36 * (x + y + z + 1.5)) AS DOUBLE) AS corners FROM s GROUP BY design_id""")
def snk01(spark: SparkSession, d: str) -> DataFrame:
    t = stl.read_stl(stl.from_voxels(fx.voxels(spark, d)), "design_id", "data")
    corners = sum((F.col(c) for c in stl.CORNERS[1:]), F.col(stl.CORNERS[0]))
    area = mesh.normals(t.drop("nx", "ny", "nz")).groupBy("design_id").agg(F.round(F.sum("area"), 6).alias("area"))
    return t.groupBy("design_id").agg(F.count(F.lit(1)).alias("triangles"), F.sum(corners).alias("corners")).join(area, "design_id").select("design_id", "triangles", "area", "corners")


@query("itr06_metric_stream", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def itr06(spark: SparkSession, d: str) -> DataFrame:
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    stream = metrics.metric_stream(spark, f"{d}/event[s].parquet", schema)  # a pattern, as a stream reads folders
    out = metrics.drained(metrics.windowed(stream, "ts", "value", ("event_type",)), "metric-windows", "update")
    return out.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max("n").alias("n"))
