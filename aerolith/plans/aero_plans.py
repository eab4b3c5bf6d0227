"""Queries: designs, folds, meshes, graphs and the closed-form model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lit, r
from ..operators import aero, graph, mesh, rl, sheets, telemetry
from ..sources import grids
from . import fixtures as fx
from .registry import query, table

SURROGATE_SQL = """
flow AS (SELECT *, rho * v * chord / (mu + 1e-8) AS re, radians(aoa_deg) AS aoa FROM designs),
lift AS (SELECT *, 2 * pi() * (aoa + camber * radians(5)) AS flat FROM flow),
wing AS (SELECT *, flat / (1 + flat / (pi() * ar + 1e-8)) AS cl0 FROM lift),
drag AS (SELECT *, cl0 + 0.1 * dihedral AS cl,
  1.1 * CASE WHEN re < 5e5 THEN 1.328 / sqrt(re + 1e-8) ELSE 0.0744 / (pow(re, 0.2) + 1e-8) END * 2 * area_wet / (area_proj + 1e-8)
  + cl0 * cl0 / (pi() * ar * 0.8 + 1e-8) * (1 + 2 * greatest(0, aoa - radians(15)) / pi()) AS cd FROM wing),
rated AS (SELECT *, cl / (cd + 1e-8) * 0.8 AS ld, cl / (cd + 1e-8) * 0.8 * v * v * sin(radians(20)) / 9.81 AS range_est FROM drag)"""

RATED = "round(cl, 6) + 0.0 AS cl, round(cd, 6) + 0.0 AS cd, round(ld, 6) + 0.0 AS ld, round(range_est, 6) + 0.0 AS range_est"


def rounded(df: DataFrame, names: tuple[str, ...], *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*keep, *[r(F.col(c), digits).alias(c) for c in names])


def sql_rounded(names: tuple[str, ...], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in names)


@query("cmp25_aero_surrogate", f"WITH {fx.DESIGNS_SQL}, {SURROGATE_SQL} SELECT design_id, {RATED}, round(re, 3) AS re FROM rated")
def cmp25(spark: SparkSession, d: str) -> DataFrame:
    out = aero.surrogate(fx.designs(spark, d))
    return out.select("design_id", *[r(F.col(c)).alias(c) for c in ("cl", "cd", "ld", "range_est")], F.round("re", 3).alias("re"))


@query("cmp24_lifting_line", f"WITH {fx.DESIGNS_SQL}, a AS (SELECT design_id, ar, 2 * pi() * (radians(aoa_deg) + camber * radians(5)) AS flat FROM designs), b AS (SELECT design_id, ar, flat / (1 + flat / (pi() * ar + 1e-8)) AS cl FROM a) SELECT design_id, round(cl, 6) + 0.0 AS cl, round(cl * cl / (pi() * ar * 0.8 + 1e-8), 6) + 0.0 AS cd_induced FROM b")
def cmp24(spark: SparkSession, d: str) -> DataFrame:
    cl, cd = aero.lifting_line(F.radians("aoa_deg"), F.col("ar"), F.col("camber"))
    return fx.designs(spark, d).select("design_id", r(cl).alias("cl"), r(cd).alias("cd_induced"))


@query("prj13_skin_friction", f"WITH {fx.DESIGNS_SQL}, a AS (SELECT design_id, rho * v * chord / mu AS re FROM designs) SELECT design_id, re < 5e5 AS laminar, round(CASE WHEN re < 5e5 THEN 1.328 / sqrt(re + 1e-8) ELSE 0.0744 / (pow(re, 0.2) + 1e-8) END, 8) AS friction FROM a")
def prj13(spark: SparkSession, d: str) -> DataFrame:
    re = F.col("rho") * F.col("v") * F.col("chord") / F.col("mu")
    return fx.designs(spark, d).select("design_id", (re < 5e5).alias("laminar"), F.round(aero.skin_friction(re), 8).alias("friction"))


def sheet_faces(spark: SparkSession, d: str) -> DataFrame:
    """The faces of the sheet of each part."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("design_id")).join(F.broadcast(grids.sheet_faces(spark, 10)))


@query("src06_sheet_mesh", f"WITH {fx.folds_sql()}, m AS (SELECT 'v' AS kind, v AS id, x AS p, y AS q, 0.0::DOUBLE AS s FROM sheet UNION ALL SELECT 'f', t, a, b, c FROM face) SELECT p_partkey AS design_id, kind, id, round(p * scale, 9) AS p, round(q * scale, 9) AS q, round(s * scale, 9) AS s FROM (SELECT p_partkey, p_size AS scale FROM part) x CROSS JOIN m")
def src06(spark: SparkSession, d: str) -> DataFrame:
    v = grids.sheet_vertices(spark, 10).select(F.lit("v").alias("kind"), F.col("v").alias("id"), F.col("x").alias("p"), F.col("y").alias("q"), F.col("z").alias("s"))
    f = grids.sheet_faces(spark, 10).select(F.lit("f"), "t", *[F.col(c).cast("double") for c in "abc"])
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("design_id"), F.col("p_size").alias("scale"))
    rows = parts.join(F.broadcast(v.union(f)))
    return rows.select("design_id", "kind", "id", *[F.round(F.col(c) * F.col("scale"), 9).alias(c) for c in "pqs"])


@query("prj11_valid_creases", f"WITH {fx.folds_sql()} SELECT design_id, CAST(k AS INTEGER) AS k, round(len, 9) AS length FROM crease")
def prj11(spark: SparkSession, d: str) -> DataFrame:
    return mesh.creases(fx.actions(spark, d)).select("design_id", "k", F.round("length", 9).alias("length"))


@query("cmp22_fold", f"WITH {fx.folds_sql()} SELECT design_id, v, round(z, 9) + 0.0 AS z FROM vertex")
def cmp22(spark: SparkSession, d: str) -> DataFrame:
    return mesh.folded(fx.actions(spark, d), grids.sheet_vertices(spark, 10)).select("design_id", "v", r(F.col("z"), 9).alias("z"))


@query("joi07_fold_vertex_pairs", f"WITH {fx.folds_sql()} SELECT design_id, count(*) AS pairs, CAST(sum(k * v) AS BIGINT) AS keyed, round(sum(len * x), 6) AS weighed FROM crease, sheet GROUP BY design_id")
def joi07(spark: SparkSession, d: str) -> DataFrame:
    pairs = mesh.creases(fx.actions(spark, d)).join(F.broadcast(grids.sheet_vertices(spark, 10)))
    return pairs.groupBy("design_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("k") * F.col("v")).alias("keyed"), F.round(F.sum(F.col("length") * F.col("x")), 6).alias("weighed"))


FEATURES_SQL = """
box AS (SELECT design_id, greatest(max(x) - min(x), 0.001) AS bx, greatest(max(y) - min(y), 0.001) AS by_, avg(abs(z)) AS height FROM vertex GROUP BY design_id),
surface AS (SELECT design_id, sum(len / 2) AS area, avg(abs(nz - 1)) AS dihedral FROM nor GROUP BY design_id),
feature AS (SELECT design_id, bx * by_ * 0.8 AS area_proj, by_ AS span, bx * by_ * 0.8 / by_ AS chord, by_ * by_ / (bx * by_ * 0.8) AS ar, height / (bx * by_ * 0.8 / by_) AS camber, dihedral, 2 * area AS area_wet FROM box JOIN surface USING (design_id))"""
FEATURES = ("area_proj", "span", "chord", "ar", "camber", "dihedral", "area_wet")


@query("cmp23_aero_features", f"WITH {fx.folds_sql()}, {fx.TRIANGLES_SQL}, {FEATURES_SQL} SELECT design_id, {sql_rounded(FEATURES)} FROM feature")
def cmp23(spark: SparkSession, d: str) -> DataFrame:
    v = mesh.folded(fx.actions(spark, d), grids.sheet_vertices(spark, 10))
    return rounded(mesh.features(v, grids.sheet_faces(spark, 10)), FEATURES, "design_id")


@query("joi04_triangle_corners", f"WITH {fx.folds_sql()}, {fx.TRIANGLES_SQL} SELECT design_id, t, a, b, c, round(ux, 9) + 0.0 AS ux, round(wz, 9) + 0.0 AS wz FROM tri")
def joi04(spark: SparkSession, d: str) -> DataFrame:
    c = mesh.corners(mesh.folded(fx.actions(spark, d), grids.sheet_vertices(spark, 10)), grids.sheet_faces(spark, 10))
    return c.select("design_id", "t", "a", "b", "c", r(F.col("bx") - F.col("ax"), 9).alias("ux"), r(F.col("cz") - F.col("az"), 9).alias("wz"))


@query("agg13_mesh_area", f"WITH {fx.folds_sql()}, {fx.TRIANGLES_SQL} SELECT design_id, round(sum(len) / 2, 9) AS area FROM nor GROUP BY design_id")
def agg13(spark: SparkSession, d: str) -> DataFrame:
    t = mesh.normals(mesh.corners(mesh.folded(fx.actions(spark, d), grids.sheet_vertices(spark, 10)), grids.sheet_faces(spark, 10)))
    return t.groupBy("design_id").agg(F.round(F.sum("area"), 9).alias("area"))


@query("agg12_height_and_tilt", f"WITH {fx.folds_sql()}, {fx.TRIANGLES_SQL}, h AS (SELECT design_id, avg(abs(z)) AS height FROM vertex GROUP BY design_id), t AS (SELECT design_id, avg(abs(nz - 1)) AS tilt FROM nor GROUP BY design_id) SELECT design_id, round(height, 9) AS height, round(tilt, 9) AS tilt FROM h JOIN t USING (design_id)")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    v = mesh.folded(fx.actions(spark, d), grids.sheet_vertices(spark, 10))
    n = mesh.normals(mesh.corners(v, grids.sheet_faces(spark, 10))).groupBy("design_id").agg(F.round(F.avg(F.abs(F.col("nz") - 1.0)), 9).alias("tilt"))
    return v.groupBy("design_id").agg(F.round(F.avg(F.abs("z")), 9).alias("height")).join(n, "design_id")


VERTEX_NORMALS_SQL = """
ends AS (SELECT design_id, unnest([a, b, c]) AS v, nx, ny, nz FROM nor),
vn AS MATERIALIZED (SELECT design_id, v, avg(nx) AS nx, avg(ny) AS ny, avg(nz) AS nz, (stddev_pop(nx) + stddev_pop(ny) + stddev_pop(nz)) / 3 AS curvature FROM ends GROUP BY design_id, v)"""


@query("agg14_vertex_normals", f"WITH {fx.folds_sql()}, {fx.TRIANGLES_SQL}, {VERTEX_NORMALS_SQL} SELECT design_id, v, {sql_rounded(('nx', 'ny', 'nz', 'curvature'))} FROM vn")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    digits = dict.fromkeys(("nx", "ny", "nz", "curvature"), 6)
    return sheets.on_sheets(fx.actions(spark, d), grids.sheet_vertices(spark, 10), grids.sheet_faces(spark, 10), sheets.vertex_normals, "v int, nx double, ny double, nz double, curvature double", digits)


@query("joi05_faces_of_vertex", f"WITH {fx.folds_sql()} SELECT p_partkey AS design_id, unnest([a, b, c]) AS v, t FROM part, face")
def joi05(spark: SparkSession, d: str) -> DataFrame:
    return sheet_faces(spark, d).select("design_id", F.explode(F.array("a", "b", "c")).alias("v"), "t")


EDGES_SQL = "edge AS (SELECT DISTINCT least(p, q) AS src, greatest(p, q) AS dst FROM (SELECT a AS p, b AS q FROM face UNION ALL SELECT b, c FROM face UNION ALL SELECT c, a FROM face))"


@query("agg28_distinct_edges", f"WITH {fx.folds_sql()}, {EDGES_SQL} SELECT p_partkey AS design_id, src, dst FROM part, edge")
def agg28(spark: SparkSession, d: str) -> DataFrame:
    return mesh.edges(sheet_faces(spark, d), ("design_id",))


@query("set02_undirected_edges", f"WITH {fx.folds_sql()}, {EDGES_SQL}, way AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge) SELECT p_partkey AS design_id, src, dst FROM part, way")
def set02(spark: SparkSession, d: str) -> DataFrame:
    return mesh.undirected(mesh.edges(sheet_faces(spark, d), ("design_id",)), ("design_id",))


@query("cmp29_mesh_graph", f"""WITH {fx.folds_sql()}, {fx.TRIANGLES_SQL}, {VERTEX_NORMALS_SQL}, {EDGES_SQL}
SELECT e.src, e.dst, m.design_id, round(xs[e.dst + 1] - xs[e.src + 1], 9) + 0.0 AS dx, round(ys[e.dst + 1] - ys[e.src + 1], 9) + 0.0 AS dy, round(zs[e.dst + 1] - zs[e.src + 1], 9) + 0.0 AS dz, 0.0::DOUBLE AS dihedral, round(n.nz, 6) + 0.0 AS src_nz, round(n.curvature, 6) + 0.0 AS src_curvature
FROM edge e JOIN vn n ON n.v = e.src JOIN mesh m ON m.design_id = n.design_id""")
def cmp29(spark: SparkSession, d: str) -> DataFrame:
    digits = dict.fromkeys(("dx", "dy", "dz"), 9) | dict.fromkeys(("src_nz", "src_curvature"), 6)
    made = "src int, dst int, dx double, dy double, dz double, dihedral double, src_nz double, src_curvature double"
    rows = sheets.on_sheets(fx.actions(spark, d), grids.sheet_vertices(spark, 10), grids.sheet_faces(spark, 10), sheets.edges, made, digits)
    return rows.select("src", "dst", "design_id", "dx", "dy", "dz", "dihedral", "src_nz", "src_curvature")


@query("cmp30_fold_graph", f"""WITH n AS (SELECT p_partkey AS design_id FROM part), f AS (SELECT design_id, i FROM n, range(10) t(i)),
one AS (SELECT design_id, i - 1 AS src, i AS dst FROM f WHERE i > 0 UNION ALL SELECT design_id, i, 10 + b FROM f, range(4) t(b) UNION ALL SELECT design_id, 10 + k, 10 + (k + 1) % 4 FROM n, range(4) t(k))
SELECT design_id, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM one UNION ALL SELECT design_id, CAST(dst AS INTEGER), CAST(src AS INTEGER) FROM one""")
def cmp30(spark: SparkSession, d: str) -> DataFrame:
    return graph.fold_graph(fx.actions(spark, d))[1].select("design_id", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


@query("joi03_edge_gather", f"""WITH {fx.folds_sql()}, {EDGES_SQL}, height AS MATERIALIZED (SELECT design_id, list(z ORDER BY v) AS zs FROM vertex GROUP BY design_id)
SELECT h.design_id, e.src, e.dst, round(zs[e.src + 1], 9) + 0.0 AS src_z, round(zs[e.dst + 1], 9) + 0.0 AS dst_z FROM height h CROSS JOIN edge e""")
def joi03(spark: SparkSession, d: str) -> DataFrame:
    v = mesh.folded(fx.actions(spark, d), grids.sheet_vertices(spark, 10))
    node = v.select("design_id", "v", F.array("x", "y", "z").alias("feat"))
    edge = v.select("design_id").distinct().join(F.broadcast(mesh.edges(grids.sheet_faces(spark, 10))))
    return graph.gathered(edge, node).select("design_id", "src", "dst", r(F.col("src_feat")[2], 9).alias("src_z"), r(F.col("dst_feat")[2], 9).alias("dst_z"))


@query("agg15_scatter_add", f"""WITH {fx.folds_sql()}, {EDGES_SQL}, m AS (SELECT s.design_id, e.dst AS v, sum(s.z) AS z, sum(s.x) AS x FROM edge e JOIN vertex s ON s.v = e.src GROUP BY s.design_id, e.dst)
SELECT v.design_id, v.v, round(coalesce(m.x, 0), 9) + 0.0 AS x, round(coalesce(m.z, 0), 9) + 0.0 AS z FROM vertex v LEFT JOIN m ON m.design_id = v.design_id AND m.v = v.v""")
def agg15(spark: SparkSession, d: str) -> DataFrame:
    v = mesh.folded(fx.actions(spark, d), grids.sheet_vertices(spark, 10))
    node = v.select("design_id", "v", F.array("x", "z").alias("feat"))
    edge = v.select("design_id").distinct().join(F.broadcast(mesh.edges(grids.sheet_faces(spark, 10))))
    got = graph.scattered(node, graph.gathered(edge, node).withColumn("msg", F.col("src_feat")), 2)
    return got.select("design_id", "v", r(F.col("msg")[0], 9).alias("x"), r(F.col("msg")[1], 9).alias("z"))


@query("agg16_mean_pool", f"WITH {fx.folds_sql()} SELECT design_id, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) + 0.0 AS z FROM vertex GROUP BY design_id")
def agg16(spark: SparkSession, d: str) -> DataFrame:
    node = mesh.folded(fx.actions(spark, d), grids.sheet_vertices(spark, 10)).select("design_id", "v", F.array("x", "y", "z").alias("feat"))
    return graph.mean_pool(node, "feat", 3).select("design_id", *[r(F.col("pooled")[k], 9).alias(c) for k, c in enumerate("xyz")])


@query("graph_degrees", f"WITH {fx.folds_sql()}, {EDGES_SQL} SELECT p_partkey AS design_id, v, degree FROM part, (SELECT v, count(*) AS degree FROM (SELECT unnest([src, dst]) AS v FROM edge) GROUP BY v)")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(mesh.edges(sheet_faces(spark, d), ("design_id",)))


EVALUATED_SQL = f"""{fx.folds_sql()}, {fx.TRIANGLES_SQL}, {FEATURES_SQL},
designs AS (SELECT *, 10.0::DOUBLE AS aoa_deg, 10.0::DOUBLE AS v, 1.225::DOUBLE AS rho, 1.81e-5::DOUBLE AS mu FROM feature), {SURROGATE_SQL}"""


@query("cmp26_batch_evaluate", f"WITH {EVALUATED_SQL} SELECT design_id, {RATED} FROM rated")
def cmp26(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aero.evaluate(fx.actions(spark, d)), ("cl", "cd", "ld", "range_est"), "design_id")


@query("cmp26_aero_model", f"WITH {fx.DESIGNS_SQL}, {SURROGATE_SQL} SELECT design_id, {RATED} FROM rated")
def cmp26_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aero.surrogate(fx.designs(spark, d)), ("cl", "cd", "ld", "range_est"), "design_id")


FORCES_SQL = f"{fx.DESIGNS_SQL}, forces AS (SELECT *, -(design_id % 7) * 0.01::DOUBLE AS force_x, (design_id % 11) * 0.02::DOUBLE AS force_z, CASE WHEN design_id % 13 = 0 THEN 0.0::DOUBLE ELSE area_proj END AS area FROM designs)"


def with_forces(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("design_id")
    return fx.designs(spark, d).withColumns({"force_x": -(k % 7) * lit(0.01), "force_z": (k % 11) * lit(0.02), "area": F.when(k % 13 == 0, lit(0.0)).otherwise(F.col("area_proj"))})


@query("cmp27_force_coefficients", f"""WITH {FORCES_SQL}, q AS (SELECT *, 0.5 * rho * v * v * area AS q FROM forces),
c AS (SELECT design_id, v, CASE WHEN q > 0 THEN -force_x / q ELSE 0 END AS cd, CASE WHEN q > 0 THEN force_z / q ELSE 0 END AS cl FROM q)
SELECT design_id, round(cl, 6) + 0.0 AS cl, round(cd, 6) + 0.0 AS cd, round(CASE WHEN cd > 0 THEN cl / cd ELSE 0 END * v * v * sin(radians(20)) / 9.81, 6) + 0.0 AS range_est FROM c""")
def cmp27(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aero.from_forces(with_forces(spark, d)), ("cl", "cd", "range_est"), "design_id")


@query("cmp28_outside_coefficients", f"""WITH {FORCES_SQL}, q AS (SELECT *, 0.5 * rho * v * v * area AS q FROM forces),
c AS (SELECT design_id, v, aoa_deg, CASE WHEN area > 0 THEN force_z / q ELSE 0.3 END AS cl, CASE WHEN area > 0 THEN -force_x / q ELSE 0.05 END AS cd FROM q)
SELECT design_id, round(greatest(-2, least(2, cl)), 6) + 0.0 AS cl, round(greatest(0.01, least(1, cd)), 6) + 0.0 AS cd,
       round(greatest(0, least(100, cl / (cd + 1e-8) * v * v * sin(2 * radians(aoa_deg)) / 9.81)), 6) + 0.0 AS range_est FROM c""")
def cmp28(spark: SparkSession, d: str) -> DataFrame:
    rows = with_forces(spark, d).withColumn("force_x", -F.col("force_x")).withColumn("area", F.col("area"))
    safe = rows.where("area > 0").unionByName(rows.where("not area > 0"))
    return rounded(aero.from_outside_forces(safe), ("cl", "cd", "range_est"), "design_id")


@query("cmp51_best_known", f"""WITH {fx.DESIGNS_SQL}, {SURROGATE_SQL}
SELECT design_id, round(CASE WHEN design_id % 10 = 0 THEN 0.5 ELSE cl END, 6) + 0.0 AS cl, round(CASE WHEN design_id % 10 = 0 THEN 0.05 ELSE cd END, 6) + 0.0 AS cd, CASE WHEN design_id % 10 = 0 THEN 'outside' ELSE 'surrogate' END AS source FROM rated""")
def cmp51(spark: SparkSession, d: str) -> DataFrame:
    rated = aero.surrogate(fx.designs(spark, d))
    high = rated.where("design_id % 10 = 0").select("design_id", lit(0.5).alias("cl"), lit(0.05).alias("cd"), lit(10.0).alias("ld"), lit(20.0).alias("range_est"))
    return rounded(aero.best_known(rated, high), ("cl", "cd"), "design_id", "source")


@query("joi12_state_defaults", f"SELECT p_partkey AS design_id, CASE WHEN p_partkey % 3 = 0 THEN 10.0::DOUBLE ELSE CAST(p_partkey % 31 AS DOUBLE) END AS aoa_deg, 10.0::DOUBLE AS v, 1.225::DOUBLE AS rho, 1.81e-5::DOUBLE AS mu FROM part")
def joi12(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return aero.with_defaults(table(spark, d, "part").select(k.alias("design_id"), F.when(k % 3 != 0, (k % 31).cast("double")).alias("aoa_deg")))


@query("nn13_bounded_outputs", f"WITH {fx.DESIGNS_SQL}, {SURROGATE_SQL} SELECT design_id, round(greatest(-2, least(2, cl * 4)), 6) + 0.0 AS cl, round(greatest(0.01, least(1, cd * 0.1)), 6) + 0.0 AS cd, round(greatest(0, least(100, range_est * 5)), 6) + 0.0 AS range_est FROM rated")
def nn13(spark: SparkSession, d: str) -> DataFrame:
    raw = aero.surrogate(fx.designs(spark, d)).withColumns({"cl": F.col("cl") * 4, "cd": F.col("cd") * 0.1, "range_est": F.col("range_est") * 5})
    return rounded(aero.bounded(raw), ("cl", "cd", "range_est"), "design_id")


@query("srt07_best_design", f"WITH {fx.DESIGNS_SQL}, {SURROGATE_SQL} SELECT arg_max(design_id, ld) AS design_id, round(max(ld), 6) AS ld, round(max(range_est), 6) AS longest FROM rated")
def srt07(spark: SparkSession, d: str) -> DataFrame:
    return aero.surrogate(fx.designs(spark, d)).agg(F.max_by("design_id", "ld").alias("design_id"), F.round(F.max("ld"), 6).alias("ld"), F.round(F.max("range_est"), 6).alias("longest"))


@query("agg11_bounding_box", f"WITH {fx.folds_sql()} SELECT design_id, round(min(z), 9) + 0.0 AS z_min, round(max(z), 9) + 0.0 AS z_max, round(max(x) - min(x), 9) AS x_extent, round(max(y) - min(y), 9) AS y_extent FROM vertex GROUP BY design_id")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    v = mesh.folded(fx.actions(spark, d), grids.sheet_vertices(spark, 10))
    return v.groupBy("design_id").agg(r(F.min("z"), 9).alias("z_min"), r(F.max("z"), 9).alias("z_max"), F.round(F.max("x") - F.min("x"), 9).alias("x_extent"), F.round(F.max("y") - F.min("y"), 9).alias("y_extent"))


@query("cmp39_place_mesh", f"""WITH {fx.folds_sql()}, c AS (SELECT design_id, v, x - avg(x) OVER g AS x, y - avg(y) OVER g AS y, z - avg(z) OVER g AS z, greatest(max(x) OVER g - min(x) OVER g, max(y) OVER g - min(y) OVER g, max(z) OVER g - min(z) OVER g) AS extent FROM vertex WINDOW g AS (PARTITION BY design_id)),
s AS (SELECT design_id, v, x * 2 / extent AS x, y * 2 / extent AS y, z * 2 / extent AS z FROM c)
SELECT design_id, v, round(cos(radians(30)) * cos(radians(20)) * x + (cos(radians(30)) * sin(radians(20)) * sin(radians(10)) - sin(radians(30)) * cos(radians(10))) * y + (cos(radians(30)) * sin(radians(20)) * cos(radians(10)) + sin(radians(30)) * sin(radians(10))) * z, 6) + 0.0 AS x,
       round(sin(radians(30)) * cos(radians(20)) * x + (sin(radians(30)) * sin(radians(20)) * sin(radians(10)) + cos(radians(30)) * cos(radians(10))) * y + (sin(radians(30)) * sin(radians(20)) * cos(radians(10)) - cos(radians(30)) * sin(radians(10))) * z, 6) + 0.0 AS y,
       round(-sin(radians(20)) * x + cos(radians(20)) * sin(radians(10)) * y + cos(radians(20)) * cos(radians(10)) * z, 6) + 0.0 AS z FROM s""")
def cmp39(spark: SparkSession, d: str) -> DataFrame:
    v = mesh.folded(fx.actions(spark, d), grids.sheet_vertices(spark, 10))
    return rounded(mesh.placed(v, 2.0, (10.0, 20.0, 30.0)), ("x", "y", "z"), "design_id", "v")


STEP_SQL = f"{fx.DESIGNS_SQL}, {SURROGATE_SQL}, step AS (SELECT design_id, range_est, 20.0::DOUBLE AS target, CAST(design_id % 205 AS INTEGER) AS step, CASE WHEN design_id % 4 = 0 THEN NULL ELSE (design_id % 10) / 2.0::DOUBLE END AS prev_range FROM rated)"


@query("cmp31_environment_step", f"""WITH {STEP_SQL} SELECT design_id, round(greatest(-1, least(10, range_est / target - 1)), 6) + 0.0 AS reward, range_est > 1.1 * target AS terminated, step >= 200 AS truncated, coalesce(prev_range, 0) < 0.1 * target AS use_high_fidelity, step + 1 AS next_step FROM step""")
def cmp31(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("design_id")
    rows = aero.surrogate(fx.designs(spark, d)).select("design_id", "range_est", lit(20.0).alias("target"), (k % 205).cast("int").alias("step"), F.when(k % 4 != 0, (k % 10) / lit(2)).alias("prev_range"))
    return rl.stepped(rows).select("design_id", r(F.col("reward")).alias("reward"), "terminated", "truncated", "use_high_fidelity", "next_step")


@query("cmp32_vector_step", f"WITH {EVALUATED_SQL} SELECT design_id, round(greatest(-1, least(10, range_est / 20 - 1)), 6) + 0.0 AS reward, range_est > 22 AS terminated FROM rated")
def cmp32(spark: SparkSession, d: str) -> DataFrame:
    rated = aero.evaluate(fx.actions(spark, d)).withColumns({"target": lit(20.0), "step": F.lit(0), "prev_range": lit(0.0)})
    return rl.stepped(rated).select("design_id", r(F.col("reward")).alias("reward"), "terminated")


@query("cmp33_state_vector", f"WITH {fx.DESIGNS_SQL} SELECT design_id, round(v / 20, 9) AS v, round(aoa_deg / 20, 9) AS aoa, round(rho / 1.5, 9) AS rho, round(mu / 2e-5, 9) AS mu, round(v / 20 * 20, 9) AS v_back FROM designs")
def cmp33(spark: SparkSession, d: str) -> DataFrame:
    state = {c: F.col(c) for c in ("v", "aoa_deg", "rho", "mu")} | {"width_mm": lit(210.0), "height_mm": lit(297.0), "temperature": lit(293.15), "target": lit(20.0)}
    s = fx.designs(spark, d).withColumn("s", rl.normalised(state))
    return s.select("design_id", *[F.round(F.col("s")[i], 9).alias(c) for i, c in ((2, "v"), (6, "aoa"), (7, "rho"), (8, "mu"))], F.round(rl.denormalised(F.col("s"))["v"], 9).alias("v_back"))


@query("src25_environment_states", "SELECT s_suppkey AS env_id, 0.7::DOUBLE AS s0, 0.5::DOUBLE AS s2, round((10 + s_suppkey % 11) / 50.0::DOUBLE, 9) AS s4 FROM supplier")
def src25(spark: SparkSession, d: str) -> DataFrame:
    state = {"width_mm": 210.0, "height_mm": 297.0, "v": 10.0, "temperature": 293.15, "target": 10 + F.col("env_id") % 11, "aoa_deg": 10.0, "rho": 1.225, "mu": 1.81e-5}
    envs = fx.simulations(spark, d, "env_id")
    return grids.env_states(envs, state).select("env_id", *[F.round(F.col("state")[i], 9).alias(f"s{i}") for i in (0, 2, 4)])


@query("prj14_batch_for_memory", "SELECT i AS gb, CASE WHEN i >= 12 THEN 128 WHEN i >= 6 THEN 64 ELSE 32 END AS batch FROM (SELECT s_suppkey AS i FROM supplier)")
def prj14(spark: SparkSession, d: str) -> DataFrame:
    return fx.simulations(spark, d, "id").select(F.col("id").alias("gb"), aero.batch_for_memory(F.col("id")).alias("batch"))


@query("prj15_bounded_estimate", "SELECT i AS gb, CAST(greatest(4, least(64, floor(i * 1024 * 0.8::DOUBLE / 300))) AS INTEGER) AS envs FROM (SELECT s_suppkey AS i FROM supplier)")
def prj15(spark: SparkSession, d: str) -> DataFrame:
    return fx.simulations(spark, d, "id").select(F.col("id").alias("gb"), aero.bounded_estimate(F.col("id") * 1024 * lit(0.8), lit(300.0), 4, 64).alias("envs"))


@query("prj18_feature_batch", f"WITH {fx.DESIGNS_SQL} SELECT design_id, area_proj, span, chord, ar, camber, dihedral, area_wet FROM designs")
def prj18(spark: SparkSession, d: str) -> DataFrame:
    return fx.designs(spark, d).select("design_id", *FEATURES)


@query("doc03_self_test", f"""WITH {fx.DESIGNS_SQL}, {SURROGATE_SQL}, o AS (SELECT *, range_est * (1 + 0.1 * (design_id % 5 - 2)) AS other FROM rated), k AS (SELECT *, rank() OVER (ORDER BY range_est) AS a, rank() OVER (ORDER BY other) AS b FROM o)
SELECT round(avg(abs(range_est - other)), 6) AS mae, round(corr(a, b), 6) AS rank_correlation, arg_max(design_id, range_est) AS best FROM k""")
def doc03(spark: SparkSession, d: str) -> DataFrame:
    o = aero.surrogate(fx.designs(spark, d)).withColumn("other", F.col("range_est") * (1 + 0.1 * (F.col("design_id") % 5 - 2)))
    k = telemetry.ranked(telemetry.ranked(o.select("design_id", "range_est", "other"), "range_est", "a"), "other", "b")
    return k.agg(F.round(F.avg(F.abs(F.col("range_est") - F.col("other"))), 6).alias("mae"), F.round(F.corr("a", "b"), 6).alias("rank_correlation"), F.max_by("design_id", "range_est").alias("best"))


@query("doc04_worth_high_fidelity", f"WITH {fx.DESIGNS_SQL}, {SURROGATE_SQL} SELECT design_id FROM rated WHERE range_est > 0.9 * 20")
def doc04(spark: SparkSession, d: str) -> DataFrame:
    return rl.worth_high_fidelity(aero.surrogate(fx.designs(spark, d)).withColumn("target", lit(20.0))).select("design_id")


@query("src16_keyed_actions", "SELECT p_partkey AS design_id, k AS k, (p_partkey * (k * 7919 + 104729)) % 1000 / 1000.0::DOUBLE AS v FROM part, range(50) t(k)")
def src16(spark: SparkSession, d: str) -> DataFrame:
    return fx.actions(spark, d).select("design_id", F.posexplode("action").alias("k", "v")).select("design_id", F.col("k").cast("long").alias("k"), "v")


@query("src18_example_data", "WITH d AS (SELECT p_partkey AS id, [0, 5, 10, 15, 20][1 + p_partkey % 5] AS a, [5, 10, 15, 20, 25][1 + p_partkey // 5 % 5] AS s FROM part) SELECT id, a AS aoa, s AS speed, round(0.5::DOUBLE + 0.1 * a + 0.02 * s, 9) AS cl, round(0.05::DOUBLE + 0.002 * a * a, 9) AS cd, round((0.5::DOUBLE + 0.1 * a + 0.02 * s) / greatest(0.05::DOUBLE + 0.002 * a * a, 0.01), 6) AS eff FROM d")
def src18(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values]), (1 + i).cast("int"))
    rows = table(spark, d, "part").select(k.alias("id"), pick((0, 5, 10, 15, 20), k % 5).alias("aoa"), pick((5, 10, 15, 20, 25), F.floor(k / 5) % 5).alias("speed"))
    cl, cd = 0.5 + 0.1 * F.col("aoa") + 0.02 * F.col("speed"), 0.05 + 0.002 * F.col("aoa") * F.col("aoa")
    return rows.select("id", "aoa", "speed", F.round(cl, 9).alias("cl"), F.round(cd, 9).alias("cd"), F.round(cl / F.greatest(cd, lit(0.01)), 6).alias("eff"))
