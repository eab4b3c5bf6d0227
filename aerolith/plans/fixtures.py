"""Inputs that both the engine and SQL build from the shared tables by integer arithmetic alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lit
from ..sources import grids
from ..sources.lattice import Lattice
from .registry import dealt, table

N = 8
#: Simulations and designs a task.
SIMS, DESIGNS = 256, 2048


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aerodynamic design a part."""
    p = F.col("design_id")
    area = 0.210 * 0.297 * 0.8
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("design_id"))
    return rows.select("design_id", (p % 31).cast("double").alias("aoa_deg"), (5 + p % 60).cast("double").alias("v"), lit(1.225).alias("rho"), lit(1.81e-5).alias("mu"), lit(area).alias("area_proj"), lit(0.297).alias("span"), lit(area / 0.297).alias("chord"), lit(0.297**2 / area).alias("ar"), ((p % 97) / lit(1000)).alias("camber"), ((p % 53) / lit(500)).alias("dihedral"), (lit(2 * 0.06237) * (1 + (p % 31) / lit(100))).alias("area_wet"))


DESIGNS_SQL = """designs AS (
  SELECT p_partkey AS design_id, CAST(p_partkey % 31 AS DOUBLE) AS aoa_deg, CAST(5 + p_partkey % 60 AS DOUBLE) AS v, 1.225::DOUBLE AS rho, 1.81e-5::DOUBLE AS mu,
         0.210::DOUBLE * 0.297::DOUBLE * 0.8::DOUBLE AS area_proj, 0.297::DOUBLE AS span, 0.210::DOUBLE * 0.8::DOUBLE AS chord,
         0.297::DOUBLE / (0.210::DOUBLE * 0.8::DOUBLE) AS ar, (p_partkey % 97) / 1000.0::DOUBLE AS camber, (p_partkey % 53) / 500.0::DOUBLE AS dihedral,
         2 * 0.06237::DOUBLE * (1 + (p_partkey % 31) / 100.0::DOUBLE) AS area_wet FROM part)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold actions of one design a part."""
    return grids.keyed_actions(dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("design_id")), "design_id", DESIGNS))


def folds_sql() -> str:
    """creases, sheet and folded vertices."""
    return """
param AS (SELECT p_partkey AS design_id, k, (p_partkey * (k * 7919 + 104729)) % 1000 / 1000.0::DOUBLE AS v FROM part, range(50) t(k)),
raw AS (SELECT design_id, k // 5 AS k, max(CASE WHEN k % 5 = 0 THEN v END) * 0.210::DOUBLE AS x1, max(CASE WHEN k % 5 = 1 THEN v END) * 0.297::DOUBLE AS y1,
               max(CASE WHEN k % 5 = 2 THEN v END) * 0.210::DOUBLE AS x2, max(CASE WHEN k % 5 = 3 THEN v END) * 0.297::DOUBLE AS y2, max(CASE WHEN k % 5 = 4 THEN v END) AS a FROM param GROUP BY design_id, k // 5),
crease AS MATERIALIZED (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM raw WHERE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 0.01),
sheet AS (SELECT CAST(i * 11 + j AS INTEGER) AS v, j / 10.0::DOUBLE * 0.210::DOUBLE AS x, i / 10.0::DOUBLE * 0.297::DOUBLE AS y FROM range(11) a(i), range(11) b(j)),
face AS (SELECT CAST(20 * i + 2 * j + h AS INTEGER) AS t, CAST(i * 11 + j + CASE h WHEN 0 THEN 0 ELSE 1 END AS INTEGER) AS a, CAST(i * 11 + j + CASE h WHEN 0 THEN 1 ELSE 12 END AS INTEGER) AS b, CAST(i * 11 + j + 11 AS INTEGER) AS c FROM range(10) a(i), range(10) b(j), range(2) c(h)),
hit AS (SELECT c.design_id, s.v, c.len, c.a, ((s.x - x1) * (x2 - x1) + (s.y - y1) * (y2 - y1)) / len AS along,
               (x2 - x1) / len AS dx, (y2 - y1) / len AS dy, s.x - x1 AS rx, s.y - y1 AS ry FROM crease c, sheet s),
off AS (SELECT *, rx - along * dx AS ox, ry - along * dy AS oy FROM hit),
dz AS (SELECT design_id, v, sum((dx * oy - dy * ox) / sqrt(ox * ox + oy * oy) * sin((a - 0.5) * pi()) * exp(-sqrt(ox * ox + oy * oy) / 0.02)) AS dz
       FROM off WHERE along >= 0 AND along <= len AND sqrt(ox * ox + oy * oy) >= 0.001 GROUP BY design_id, v),
vertex AS MATERIALIZED (SELECT p.p_partkey AS design_id, s.v, s.x, s.y, coalesce(dz.dz, 0) AS z FROM part p CROSS JOIN sheet s LEFT JOIN dz ON dz.design_id = p.p_partkey AND dz.v = s.v)"""


TRIANGLES_SQL = """
mesh AS MATERIALIZED (SELECT design_id, list(x ORDER BY v) AS xs, list(y ORDER BY v) AS ys, list(z ORDER BY v) AS zs FROM vertex GROUP BY design_id),
tri AS MATERIALIZED (SELECT design_id, t, a, b, c, xs[b + 1] - xs[a + 1] AS ux, ys[b + 1] - ys[a + 1] AS uy, zs[b + 1] - zs[a + 1] AS uz, xs[c + 1] - xs[a + 1] AS wx, ys[c + 1] - ys[a + 1] AS wy, zs[c + 1] - zs[a + 1] AS wz FROM mesh, face),
nrm AS (SELECT *, uy * wz - uz * wy AS cx, uz * wx - ux * wz AS cy, ux * wy - uy * wx AS cz FROM tri),
nor AS MATERIALIZED (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS len, cx / (sqrt(cx * cx + cy * cy + cz * cz) + 1e-10) AS nx, cy / (sqrt(cx * cx + cy * cy + cz * cz) + 1e-10) AS ny, cz / (sqrt(cx * cx + cy * cy + cz * cz) + 1e-10) AS nz FROM nrm)"""


def lattice_sql(lat: Lattice, name: str = "lat") -> str:
    rows = ", ".join(f"({i}, {e[0]}, {e[1]}, {e[2]}, {w!r}::DOUBLE, {o})" for i, (e, w, o) in enumerate(zip(lat.directions, lat.weights, lat.opposite, strict=True)))
    return f"{name}(i, ex, ey, ez, w, opp) AS (VALUES {rows})"


#: One simulation a supplier.
SIMS_SQL = "(SELECT s_suppkey AS sim FROM supplier)"
#: A grid of 8^3 cells for each of them, with the aircraft as its solid; c numbers the cells of all.
CELLS_SQL = f"""cell AS MATERIALIZED (SELECT sim, sim * {N**3} + k AS c, CAST(k // 64 AS INTEGER) AS x, CAST(k // 8 % 8 AS INTEGER) AS y, CAST(k % 8 AS INTEGER) AS z,
  (sqrt((k // 64 - 4) * (k // 64 - 4) + (k % 8 - 4) * (k % 8 - 4)) < 1.5 AND k // 8 % 8 > 2.5 AND k // 8 % 8 < 5.5)
  OR (k // 8 % 8 > 2 AND k // 8 % 8 < 6 AND (k % 8 < 1 OR k % 8 > 7)) AS solid FROM {SIMS_SQL} u, range({N**3}) t(k))"""


def single(sql: str) -> str:
    """The same SQL for one simulation, numbered 0."""
    return sql.replace(SIMS_SQL, "(SELECT 0::BIGINT AS sim)")


def simulations(spark: SparkSession, sf_dir: str | None, key: str = "sim_id") -> DataFrame:
    """One simulation a supplier; a single one, numbered 0, without a folder."""
    if sf_dir is None:
        return spark.range(1).select(F.col("id").alias(key))
    return dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(key)), key, SIMS)


def grid(spark: SparkSession, sf_dir: str | None, n: int = N) -> DataFrame:
    """(sim_id, x, y, z, cell, solid): ``cell`` numbers the cells of all simulations."""
    rows = grids.cells(spark, n, simulations(spark, sf_dir)).withColumn("solid", grids.aircraft_solid(n, n / 32))
    return rows.withColumn("cell", F.col("sim_id") * n**3 + F.col("cell"))


def flow(spark: SparkSession, sf_dir: str | None, lat: Lattice, n: int = N) -> DataFrame:
    """(sim_id, x, y, z, cell, solid, f): populations near their weights, the aircraft as solid."""
    rows = grid(spark, sf_dir, n)
    return rows.withColumn("f", F.array(*[lit(w) * (1 + 0.01 * ((F.col("cell") * (i + 3)) % 17)) for i, w in enumerate(lat.weights)]))


def flow_sql(lat: Lattice) -> str:
    return f"{lattice_sql(lat)}, {CELLS_SQL}, pop AS (SELECT sim, c, x, y, z, solid, i, ex, ey, ez, w, opp, w * (1 + 0.01 * ((c * (i + 3)) % 17)) AS f FROM cell, lat)"


def smooth(spark: SparkSession, sf_dir: str | None = None, n: int = N) -> DataFrame:
    """(sim_id, x, y, z, cell, solid, ux, uy, uz): smooth flows of several strengths whose w grows by 0.1 a cell along x."""
    import math

    turn = 2 * math.pi / 8
    strength = 1 + F.col("sim_id") % 7 / lit(11)
    return grid(spark, sf_dir, n).withColumns({"ux": F.sin(turn * F.col("x")) * F.cos(turn * F.col("y")) * strength, "uy": F.cos(turn * F.col("z")), "uz": 0.1 * F.col("x") + 0.2 * F.col("y") * F.col("y")})


SMOOTH_SQL = CELLS_SQL + ", u AS (SELECT *, sin(pi() / 4 * x) * cos(pi() / 4 * y) * (1 + sim % 7 / 11.0::DOUBLE) AS ux, cos(pi() / 4 * z) AS uy, 0.1::DOUBLE * x + 0.2::DOUBLE * y * y AS uz FROM cell)"


def gradient_sql(values: tuple[str, ...], source: str, out: str) -> str:
    """out: source with <value>_x, _y, _z, by joins to the six neighbours."""
    joins, columns = [], []
    for axis in "xyz":
        others = [a for a in "xyz" if a != axis]
        same = lambda t, others=others: " AND ".join(f"{t}.{a} = g.{a}" for a in ("sim", *others))
        joins.append(f"LEFT JOIN {source} {axis}p ON {same(axis + 'p')} AND {axis}p.{axis} = g.{axis} + 1 LEFT JOIN {source} {axis}m ON {same(axis + 'm')} AND {axis}m.{axis} = g.{axis} - 1")
        columns += [f"CASE WHEN {axis}m.c IS NULL THEN {axis}p.{v} - g.{v} WHEN {axis}p.c IS NULL THEN g.{v} - {axis}m.{v} ELSE ({axis}p.{v} - {axis}m.{v}) / 2 END AS {v}_{axis}" for v in values]
    return f"{out} AS MATERIALIZED (SELECT g.*, {', '.join(columns)} FROM {source} g {' '.join(joins)})"


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, v, noise): codes, and as their noise the codes of the next id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    count = rows.agg(F.count(F.lit(1)).alias("n"))
    at = rows.join(F.broadcast(count)).select(F.col("vec_id").alias("id"), "v", ((F.col("vec_id") + 1) % F.col("n")).alias("next"))
    return at.join(rows.select(F.col("vec_id").alias("next"), F.col("v").alias("noise")), "next").select("id", (F.col("id") % 100).cast("int").alias("t"), "v", "noise")


LATENTS_SQL = """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
latent AS (SELECT a.vec_id AS id, CAST(a.vec_id % 100 AS INTEGER) AS t, a.v, b.v AS noise FROM e a JOIN e b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM e))"""


def voxels(spark: SparkSession, sf_dir: str | None = None, n: int = N) -> DataFrame:
    """(design_id, x, y, z, cell, p): a design a supplier, three without a folder: scattered, a block, the aircraft in turn."""
    sims = simulations(spark, sf_dir, "design_id") if sf_dir else spark.range(3).select(F.col("id").alias("design_id"))
    rows = grids.cells(spark, n, sims, "design_id")
    scattered = grids.hashed_solid()
    block = (F.col("x") < 4) & (F.col("y") < 4) & (F.col("z") < 4)
    solid = F.when(F.col("design_id") % 3 == 0, scattered).when(F.col("design_id") % 3 == 1, block).otherwise(grids.aircraft_solid(n, n / 32))
    return rows.withColumn("p", F.when(solid, lit(0.75)).otherwise(lit(0.25)))


VOXELS_SQL = CELLS_SQL + """, voxel AS MATERIALIZED (SELECT sim AS design_id, c - sim * 512 AS cell, x, y, z,
  CASE WHEN CASE sim % 3 WHEN 0 THEN (31 * x + 57 * y + 91 * z + 13 * x * y * z) % 101 < 30 WHEN 1 THEN x < 4 AND y < 4 AND z < 4 ELSE solid END THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS p FROM cell)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, event_id, value, done): metric series, an episode ending at each purchase."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", (F.col("event_type") == "purchase").alias("done"))
