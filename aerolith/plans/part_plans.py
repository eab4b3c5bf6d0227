"""Queries: the parts that larger operators are made of, each by itself, and files that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lit, r
from ..operators import amr, antenna, diffusion, forces, graph, mesh, stencil, telemetry, viz
from ..session import scratch
from ..sources import config, logs, stl
from . import fixtures as fx
from .data_plans import BARS, DENOISED, KEYS, PICKED, TREE, arrays, picked, tree
from .grid_plans import CURL, GRAD, S2
from .registry import query, table

# ------------------------------------------------------------------ sources and files


@query("src07_stl_scan", f"""WITH {fx.VOXELS_SQL} SELECT design_id, cell, 12::BIGINT AS triangles, CAST(36 * x + 18 AS DOUBLE) AS sx, CAST(36 * y + 18 AS DOUBLE) AS sy, CAST(36 * z + 18 AS DOUBLE) AS sz FROM voxel WHERE p > 0.5""")
def src07(spark: SparkSession, d: str) -> DataFrame:
    # a file lists its cubes in order of their cells, twelve triangles each
    t = stl.read_stl(stl.from_voxels(fx.voxels(spark, d)), "design_id", "data").withColumn("nth", F.floor(F.col("t") / 12))
    sums = {x: F.sum(F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}")).alias(f"s{x}") for x in "xyz"}
    cubes = t.groupBy("design_id", "nth").agg(F.count(F.lit(1)).alias("triangles"), *sums.values())
    place = lambda x: ((F.col(f"s{x}") - 18) / 36).cast("long")
    return cubes.select("design_id", (place("x") * 64 + place("y") * 8 + place("z")).alias("cell"), "triangles", "sx", "sy", "sz")


SIZES = tuple((c, 2 + k, m) for k, (c, m) in enumerate((("sx", 5), ("sy", 7), ("sz", 3))))


@query("src08_voxelised_mesh", "WITH s AS (SELECT p_partkey AS design_id, 2 + p_partkey % 5 AS a, 3 + p_partkey % 7 AS b, 4 + p_partkey % 3 AS c FROM part) SELECT design_id, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, CAST(k AS INTEGER) AS z FROM s, range(7) u(i), range(10) v(j), range(7) w(k) WHERE i <= a AND j <= b AND k <= c")
def src08(spark: SparkSession, d: str) -> DataFrame:
    boxes = table(spark, d, "part").select(F.col("p_partkey").alias("design_id"), *[(first + F.col("p_partkey") % m).cast("double").alias(c) for c, first, m in SIZES])
    return mesh.voxelised(mesh.box_surface(boxes), 1.0)


@query("src09_array_files", "SELECT vec_id AS id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) + 0.0 AS total, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first FROM embeddings")
def src09(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    back = stl.read_npy(stl.npy_bytes(rows, "id", "v"), "id", "data")
    return back.select("id", F.size("values").cast("long").alias("n"), *picked("values")[::-1])


@query("snk04_checkpoint", "SELECT vec_id % 4 AS layer, vec_id AS row, k AS col, round(CAST(embedding[1 + k] AS DOUBLE) * 2, 9) + 0.0 AS value FROM embeddings, range(4) t(k)")
def snk04(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("layer"), F.col("vec_id").alias("row"), F.posexplode(F.slice("embedding", 1, 4)).alias("col", "value"))
    path = scratch(spark, "weights")
    for step, factor in ((100, 1.0), (200, 2.0)):
        stl.save_weights(rows.withColumn("value", F.col("value").cast("double") * factor), path, step)
    return stl.load_weights(spark, path).select("layer", "row", F.col("col").cast("long").alias("col"), r(F.col("value"), 9).alias("value"))


@query("src10_checkpoint_of_a_step", "SELECT n_nationkey % 2 AS layer, n_nationkey AS row, CAST(n_nationkey AS DOUBLE) AS value FROM nation")
def src10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select((F.col("n_nationkey") % 2).alias("layer"), F.col("n_nationkey").alias("row"), F.lit(0).alias("col"), F.col("n_nationkey").cast("double").alias("value"))
    path = scratch(spark, "weights")
    stl.save_weights(rows, path, 1)
    stl.save_weights(rows.withColumn("value", lit(0.0)), path, 2)
    return stl.load_weights(spark, path, 1).select("layer", "row", "value")


@query("src11_settings", "SELECT 250.0::DOUBLE AS width, 297.0::DOUBLE AS height, 8::BIGINT AS folds, 15.5::DOUBLE AS target, 1.225::DOUBLE AS density")
def src11(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "settings")
    text = "project:\n  sheet_width_mm: 250.0\n  n_folds: 8  # fewer\ngoals:\n  target_range_m: 15.5\n"
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    c = config.Config.read(spark, path).frame(spark)
    return c.select(F.col("project_sheet_width_mm").alias("width"), F.col("project_sheet_height_mm").alias("height"), F.col("project_n_folds").alias("folds"), F.col("goals_target_range_m").alias("target"), F.col("environment_air_density_kgm3").alias("density"))


def force_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = F.array(F.lit("# Fx Fy Fz"), F.lit("0 0 0"), F.concat(F.lit("  "), F.col("value").cast("string"), F.lit("  2 "), F.col("event_id").cast("string")), F.lit("   "), F.lit("# end"))
    return table(spark, d, "events").select(F.col("event_id").alias("file"), F.posexplode(lines).alias("line_no", "line"))


@query("src13_plain_forces", "SELECT event_id AS file, value AS force_x, 2.0::DOUBLE AS force_y, CAST(event_id AS DOUBLE) AS force_z FROM events")
def src13(spark: SparkSession, d: str) -> DataFrame:
    return logs.plain_forces(force_lines(spark, d))


@query("prj12_real_lines", "SELECT event_id AS file, k AS line_no FROM events, range(1, 3) t(k)")
def prj12(spark: SparkSession, d: str) -> DataFrame:
    return logs.real_lines(force_lines(spark, d)).select("file", F.col("line_no").cast("long").alias("line_no"))


@query("src17_synthetic_graphs", """WITH g AS (SELECT i AS design_id, greatest(0.1, least(2.0, 0.5::DOUBLE + 0.1 * (i % 31 / 30.0::DOUBLE) + 0.02 * ((5 + i % 21) / 25.0::DOUBLE) + ((i * 7919) % 201 - 100) / 1000.0::DOUBLE)) AS y FROM (SELECT p_partkey AS i FROM part)),
f AS (SELECT i AS design_id, sum((i * (k * 7919 + 104729)) % 1000) / 1000.0::DOUBLE + 4 AS total FROM (SELECT p_partkey AS i FROM part) a, range(50) b(k) GROUP BY i)
SELECT design_id, round(y, 9) AS y, round(total, 6) AS features, 14::BIGINT AS nodes, 106::BIGINT AS edges FROM g JOIN f USING (design_id)""")
def src17(spark: SparkSession, d: str) -> DataFrame:
    node, edge, target = graph.synthetic_graphs(table(spark, d, "part").select(F.col("p_partkey").alias("design_id")))
    n = node.groupBy("design_id").agg(F.round(F.sum(F.aggregate("feat", lit(0.0), lambda s, x: s + x)), 6).alias("features"), F.count(F.lit(1)).alias("nodes"))
    e = edge.groupBy("design_id").agg(F.count(F.lit(1)).alias("edges"))
    return target.join(n, "design_id").join(e, "design_id").select("design_id", F.round("y", 9).alias("y"), "features", "nodes", "edges")


@query("snk07_design_spec", """SELECT p_partkey AS design_id, '{"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}' AS spec FROM part""")
def snk07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("design_id"), config.spec_json(["p_partkey", "p_size"]).alias("spec"))


@query("snk09_case_text", "SELECT p_partkey AS design_id, 'nx = ' || p_size || chr(10) || 'steps = ' || p_partkey AS settings FROM part")
def snk09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("design_id"), config.case_text(nx=F.col("p_size"), steps=F.col("p_partkey")).alias("settings"))


# ------------------------------------------------------------------ filters and expressions

POINTS = "pt AS (SELECT p_partkey AS id, p_partkey % 10 AS sim, p_partkey % 83 / 10.0::DOUBLE - 0.5 AS px, p_partkey % 79 / 10.0::DOUBLE - 0.5 AS py, p_partkey % 71 / 10.0::DOUBLE AS pz, (p_partkey % 3) * 1e-6::DOUBLE AS v FROM part)"


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k % 10).alias("sim_id"), k.alias("id"), (k % 83 / lit(10) - 0.5).alias("px"), (k % 79 / lit(10) - 0.5).alias("py"), (k % 71 / lit(10)).alias("pz"), ((k % 3) * lit(1e-6)).alias("vx"), lit(0.0).alias("vy"), lit(0.0).alias("vz"))


@query("prj08_points_that_go_on", f"WITH {POINTS} SELECT id FROM pt WHERE px >= 0 AND px < 7 AND py >= 0 AND py < 7 AND pz >= 0 AND pz < 7 AND v >= 1e-6")
def prj08(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where(viz.inside(fx.N) & viz.moving()).select("id")


@query("prj09_long_lines", "SELECT user_id, event_id FROM events QUALIFY count(*) OVER (PARTITION BY user_id) > 5")
def prj09(spark: SparkSession, d: str) -> DataFrame:
    return viz.long_lines(fx.series(spark, d), KEYS, 5).select("user_id", "event_id")


@query("prj17_parameter_box", "SELECT i AS k, 0.7 + i % 40 / 100.0::DOUBLE AS tau, i // 40 / 100.0::DOUBLE AS sigma, 0.7 + i % 40 / 100.0::DOUBLE > 0.8 AND 0.7 + i % 40 / 100.0::DOUBLE < 0.98 AND i // 40 / 100.0::DOUBLE > 0.05 AND i // 40 / 100.0::DOUBLE < 0.25 AS allowed FROM (SELECT p_partkey AS i FROM part)")
def prj17(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("k"), (0.7 + k % 40 / lit(100)).alias("tau"), (F.floor(k / 40) / lit(100)).alias("sigma"))
    return rows.withColumn("allowed", antenna.in_box())


@query("cmp38_domain_box", "SELECT p_partkey AS design_id, round(l * (f + 1 + b), 9) AS size_x, round(l * (2 * s + 1), 9) AS size_y, round(l * (2 * v + 1), 9) AS size_z, round(-l * (f - b) / 2, 9) + 0.0 AS offset_x FROM (SELECT p_partkey, 1 + p_partkey % 50 / 10.0::DOUBLE AS l, p_partkey % 4 * 1.0::DOUBLE AS f, p_partkey % 7 * 1.0::DOUBLE AS b, p_partkey % 3 * 0.5::DOUBLE AS s, p_partkey % 5 * 0.5::DOUBLE AS v FROM part)")
def cmp38(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("design_id"), (1 + k % 50 / lit(10)).alias("length"), (k % 4 * lit(1)).alias("front"), (k % 7 * lit(1)).alias("back"), (k % 3 * lit(0.5)).alias("sides"), (k % 5 * lit(0.5)).alias("vertical"))
    box = viz.domain_box(rows)
    return box.select("design_id", *[F.round(c, 9).alias(c) for c in ("size_x", "size_y", "size_z")], r(F.col("offset_x"), 9).alias("offset_x"))


# ------------------------------------------------------------------ joins

TRILINEAR = "round(sum(uz * (1 - abs(qx - u.x)) * (1 - abs(qy - u.y)) * (1 - abs(qz - u.z))), 6) + 0.0 AS uz"
NEAR = "abs(qx - u.x) < 1 AND abs(qy - u.y) < 1 AND abs(qz - u.z) < 1"


@query("joi10_trilinear_sample", f"WITH {fx.SMOOTH_SQL}, {POINTS}, q AS (SELECT id, sim, greatest(0, least(6.999, px)) AS qx, greatest(0, least(6.999, py)) AS qy, greatest(0, least(6.999, pz)) AS qz FROM pt) SELECT id, {TRILINEAR} FROM q JOIN u ON u.sim = q.sim AND {NEAR} GROUP BY id")
def joi10(spark: SparkSession, d: str) -> DataFrame:
    return viz.sampled(points(spark, d), fx.smooth(spark, d), ("uz",), fx.N, ("id",)).select("id", r(F.col("uz")).alias("uz"))


@query("cmp41_zoomed_grid", f"WITH {fx.SMOOTH_SQL}, q AS (SELECT CAST(i AS INTEGER) AS tx, CAST(j AS INTEGER) AS ty, CAST(k AS INTEGER) AS tz, i * 7 / 11.0::DOUBLE AS qx, j * 7 / 11.0::DOUBLE AS qy, k * 7 / 11.0::DOUBLE AS qz FROM range(12) a(i), range(12) b(j), range(12) c(k)), z AS (SELECT sim AS sim_id, tx AS x, ty AS y, tz AS z, {TRILINEAR} FROM q JOIN u ON {NEAR} GROUP BY sim, tx, ty, tz) SELECT sim_id, x, y, z, uz, uz > 0.5 AS filled FROM z")
def cmp41(spark: SparkSession, d: str) -> DataFrame:
    out = viz.zoomed(fx.smooth(spark, d), "uz", fx.N, 12).withColumn("uz", r(F.col("uz")))
    return out.select("sim_id", "x", "y", "z", "uz", (F.col("uz") > 0.5).alias("filled"))


@query("joi06_schedule_lookup", f"WITH {BARS}, {fx.LATENTS_SQL} SELECT id, t, round(sqrt(bar), 9) AS kept, round(sqrt(1 - bar), 9) AS noise FROM latent JOIN bars USING (t)")
def joi06(spark: SparkSession, d: str) -> DataFrame:
    at = fx.latents(spark, d).select("id", "t").join(F.broadcast(diffusion.schedule(spark)), "t")  # a schedule has 1,000 rows
    return at.select("id", "t", F.round("sqrt_bar", 9).alias("kept"), F.round("sqrt_one_minus_bar", 9).alias("noise"))


@query("joi09_parent_and_child", f"WITH {TREE} SELECT (block_id + 1) * 8 + o AS block_id, block_id AS parent_id, CAST(block_id // 4 * 4 + o // 4 * 2 AS INTEGER) AS ox, CAST(block_id // 2 % 2 * 4 + o // 2 % 2 * 2 AS INTEGER) AS oy, CAST(block_id % 2 * 4 + o % 2 * 2 AS INTEGER) AS oz FROM blocks, range(8) s(o) WHERE hit")
def joi09(spark: SparkSession, d: str) -> DataFrame:
    blocks = tree(spark, d)
    return blocks.alias("c").join(blocks.alias("p"), F.col("c.parent_id") == F.col("p.block_id")).select("c.block_id", "c.parent_id", "c.ox", "c.oy", "c.oz")


# ------------------------------------------------------------------ aggregates

@query("agg05_vortex_cells", f"WITH {fx.SMOOTH_SQL}, {GRAD}, {CURL}, s AS (SELECT sim, 0.5 * (wx * wx + wy * wy + wz * wz - {S2}) AS q FROM w) SELECT sim AS sim_id, count(*) FILTER (WHERE q > 0.1) AS vortex_cells, count(*) FILTER (WHERE q > 0.1) * 0.125::DOUBLE AS vortex_volume FROM s GROUP BY sim")
def agg05(spark: SparkSession, d: str) -> DataFrame:
    s = stencil.q_criterion(fx.smooth(spark, d)).withColumns({"nu_t": lit(0.0), "rho": lit(1.0)})
    return forces.field_summary(s, 0.5, 0.1).select("sim_id", "vortex_cells", "vortex_volume")


@query("agg20_spread_guard", "SELECT user_id, round(stddev_pop(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE value END), 6) AS spread FROM events GROUP BY user_id HAVING stddev_pop(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE value END) >= 1e-12")
def agg20(spark: SparkSession, d: str) -> DataFrame:
    flat = fx.series(spark, d).withColumn("value", F.when(F.col("user_id") % 3 == 0, lit(1.0)).otherwise(F.col("value")))
    return viz.spread_out(flat, "value", KEYS).withColumn("spread", F.round("spread", 6))


@query("agg26_blocks_to_refine", "SELECT user_id AS block_id FROM events GROUP BY user_id HAVING max(value) > 190 OR max(value / 2) > 99")
def agg26(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "events").select(F.col("user_id").alias("block_id"), F.col("value").alias("q"), (F.col("value") / 2).alias("vorticity"))
    blocks = fields.select("block_id").distinct().withColumns({"is_leaf": F.lit(True), "level": F.lit(0)})
    return amr.marked(blocks, fields, 3, 190.0, 99.0)


@query("agg27_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def agg27(spark: SparkSession, d: str) -> DataFrame:
    square = F.aggregate("embedding", lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(square), 6).alias("norm"))


@query("agg29_weighted_losses", "SELECT round(avg(33 * (p_size / 50.0::DOUBLE) + 33 * (p_partkey % 97 / 1000.0::DOUBLE) + 34 * (1 - least(abs(p_partkey % 53 / 50.0::DOUBLE - 0.4), 1))), 6) AS loss FROM part")
def agg29(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select((F.col("p_size") / lit(50)).alias("volume"), (k % 97 / lit(1000)).alias("cd"), (k % 53 / lit(50) - 0.4).alias("cl"))
    return forces.design_loss(rows).select(F.round("loss", 6).alias("loss"))


# ------------------------------------------------------------------ windows, order and sets

@query("win09_previous_bar", f"WITH {BARS} SELECT t, round(lag(bar, 1, 1.0) OVER (ORDER BY t), 9) + 0.0 AS previous FROM bars")
def win09(spark: SparkSession, d: str) -> DataFrame:
    return diffusion.schedule(spark).select("t", r(F.col("alpha_bar_prev"), 9).alias("previous"))


@query("win11_soft_update", f"WITH {fx.LATENTS_SQL}, x AS (SELECT id, list_transform(list_zip(v, noise), lambda p: 0.005::DOUBLE * p[2] + (1 - 0.005::DOUBLE) * p[1]) AS x FROM latent) SELECT id, {PICKED.format(x='x')} FROM x")
def win11(spark: SparkSession, d: str) -> DataFrame:
    return fx.latents(spark, d).withColumn("x", telemetry.soft_update("v", "noise")).select("id", *picked("x"))


@query("srt01_places", "SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def srt01(spark: SparkSession, d: str) -> DataFrame:
    return viz.ordered(fx.series(spark, d), "value", KEYS).select("user_id", F.col("_v").alias("value"), F.col("_i").alias("place"), F.col("_n").alias("n"))


@query("srt03_first_of_each", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3")
def srt03(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.first_of(fx.series(spark, d), KEYS, ("ts", "event_id"), 3).select("user_id", "event_id")


@query("srt05_seeded_sample", "SELECT event_id FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 32")
def srt05(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.sampled(table(spark, d, "events"), "event_id", 32, 7).select("event_id")


GRID = "p AS (SELECT * FROM (SELECT DISTINCT 0.78::DOUBLE + p_partkey % 17 / 100.0::DOUBLE AS tau, 0.04::DOUBLE + p_partkey % 1800 / 10000.0::DOUBLE AS sigma FROM part) WHERE tau > 0.8 AND tau < 0.98 AND sigma > 0.05 AND sigma < 0.25)"
COSTS = f"""WITH {GRID}, freq AS (SELECT 1e8 + k * 9.9e7 AS f FROM range(101) t(k)),
n AS (SELECT CAST(tau AS DOUBLE) AS tau, CAST(sigma AS DOUBLE) AS sigma, count(*) AS n FROM p, range(60) t(k) WHERE 1.5 * pow(tau, k) >= 3e8 / 1e9 / 4 - 1e-12 GROUP BY ALL),
c AS (SELECT tau, sigma, n, -avg(12 * (1 - tau) + 8 + 3 * sigma + 2.5 * (1 - 0.5 * sigma) * sin(2 * pi() * log10(f / (SELECT avg(f) FROM freq)))) + pow(greatest(0, n - 7), 2) * 5e5 AS cost FROM n, freq GROUP BY tau, sigma, n)"""


@query("srt08_best_of_population", f"{COSTS} SELECT round(tau, 6) AS tau, round(sigma, 6) AS sigma, round(cost, 4) AS cost FROM c ORDER BY cost, tau, sigma LIMIT 1")
def srt08(spark: SparkSession, d: str) -> DataFrame:
    population, f = arrays(spark, d)
    return antenna.best(antenna.cost(population, f, 1e8, 1e9)).select(F.round("tau", 6).alias("tau"), F.round("sigma", 6).alias("sigma"), F.round("cost", 4).alias("cost"))


@query("set01_union_all", "SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def set01(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s).unionByName(s)


@query("set03_distinct_edges", "SELECT DISTINCT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_partkey <> l_suppkey")
def set03(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("src"), F.greatest("l_partkey", "l_suppkey").alias("dst"))
    return pairs.where("src <> dst").distinct()


@query("set06_leaf_set", f"WITH {TREE} SELECT block_id FROM blocks WHERE NOT hit UNION ALL SELECT (block_id + 1) * 8 + o FROM blocks, range(8) s(o) WHERE hit")
def set06(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d).where("is_leaf").select("block_id")


# ------------------------------------------------------------------ codes and fixed networks

@query("cmp37_distillation_sweep", f"""WITH {fx.LATENTS_SQL}, b AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 16 AS batch FROM latent QUALIFY row_number() OVER (ORDER BY id) <= 160),
s AS (SELECT steps, batch, pow(0.5, (t % steps) / 1000.0::DOUBLE) AS a, pow(0.5, t / 1000.0::DOUBLE) AS c, v, noise FROM b, (VALUES (500), (250), (125), (64), (32)) k(steps)),
g AS (SELECT steps, batch, list_avg(list_transform(list_zip(v, noise), lambda p: pow((sqrt(a) - sqrt(c)) * p[1] + (sqrt(1 - a) - sqrt(1 - c)) * p[2], 2))) AS gap FROM s), l AS (SELECT steps, batch, avg(gap) AS loss FROM g GROUP BY ALL)
SELECT steps, round(avg(loss), 9) + 0.0 AS loss, count(*) AS batches FROM l GROUP BY steps""")
def cmp37(spark: SparkSession, d: str) -> DataFrame:
    return diffusion.distillation(fx.latents(spark, d)).withColumn("loss", r(F.col("loss"), 9))


@query("cmp56_code_as_grid", f"WITH {fx.LATENTS_SQL} SELECT id, k AS cell, round(1 / (1 + exp(-v[1 + k])), 9) AS p FROM latent, range(64) t(k)")
def cmp56(spark: SparkSession, d: str) -> DataFrame:
    grid = diffusion.reshaped(fx.latents(spark, d), 4).select("id", F.posexplode("p").alias("cell", "p"))
    return grid.select("id", F.col("cell").cast("long").alias("cell"), F.round("p", 9).alias("p"))


def weight_sql(rows: int, salt: int, i: str, j: str, columns: int) -> str:
    return f"((({i} * {columns} + {j}) * 7919 + {salt} * 104729) % 2003 / 2003.0::DOUBLE - 0.5) * 2.0 / sqrt({rows}.0::DOUBLE)"


#: The two-layer network of ``decoded`` for 64 numbers, 32 hidden ones and 4^3 cells.
DECODER_SQL = f"""{fx.LATENTS_SQL}, h AS (SELECT id, j, greatest(0, sum(v[1 + i] * {weight_sql(64, 7, 'i', 'j', 32)}) + 0.1 * {weight_sql(1, 57, '0', 'j', 32)}) AS h FROM code, range(64) a(i), range(32) b(j) GROUP BY id, j),
o AS (SELECT id, k AS cell, sum(h * {weight_sql(32, 8, 'j', 'k', 64)}) + 0.1 * {weight_sql(1, 58, '0', 'k', 64)} AS raw FROM h, range(64) c(k) GROUP BY id, k)"""


def decoder_sql(code: str) -> str:
    """The network over (id, v) given as the query ``code``."""
    return DECODER_SQL.replace("h AS (SELECT id, j", f"code AS ({code}), h AS (SELECT id, j", 1)


@query("nn05_decoded_code", f"WITH {decoder_sql('SELECT id, v FROM latent')} SELECT id, cell, round(1 / (1 + exp(-raw)), 6) AS p FROM o")
def nn05(spark: SparkSession, d: str) -> DataFrame:
    grid = diffusion.decoded(fx.latents(spark, d), 4, column="v").select("id", F.posexplode("p").alias("cell", "p"))
    return grid.select("id", F.col("cell").cast("long").alias("cell"), F.round("p", 6).alias("p"))


@query("cmp54_generated_designs", f"WITH {decoder_sql(DENOISED)} SELECT id AS design_id, cell, raw > 0 AS filled FROM o")
def cmp54(spark: SparkSession, d: str) -> DataFrame:
    codes = diffusion.denoised(fx.latents(spark, d), lambda x, t: F.col("noise"), column="v")
    cells = diffusion.voxels(diffusion.decoded(codes.withColumnRenamed("id", "design_id"), 4, column="v"), 4)
    return cells.select("design_id", "cell", (F.col("p") > 0.5).alias("filled"))


@query("nn01_grouped_attention", """WITH tok AS (SELECT vec_id // 8 AS design_id, CAST(vec_id % 8 AS INTEGER) AS t, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings),
s AS (SELECT q.design_id, q.t, h, k.f AS f, list_dot_product(q.f[4 * h + 1:4 * h + 4], k.f[1:4]) / 2 AS score FROM tok q JOIN tok k USING (design_id), range(2) x(h)),
m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY design_id, t, h)) AS e FROM s)
SELECT design_id, t, h * 4 + i AS c, round(sum(e * f[1 + i]) / sum(e), 6) + 0.0 AS value FROM m, range(4) y(i) GROUP BY ALL""")
def nn01(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("design_id"), (F.col("vec_id") % 8).cast("int").alias("t"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("feat"))
    out = graph.attention(tokens, 8).select("design_id", "t", F.posexplode("feat").alias("c", "value"))
    return out.select("design_id", "t", F.col("c").cast("long").alias("c"), r(F.col("value")).alias("value"))
