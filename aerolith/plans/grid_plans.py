"""Queries: grids, stencils, lattice steps, turbulence, forces and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clamp, half_up, lit, nan_to_num, r
from ..operators import components, forces, lbm, mesh, stencil, turbulence
from ..sources import grids
from ..sources.lattice import lattice
from . import fixtures as fx
from .registry import query, table

N = fx.N
D27, D19 = lattice("D3Q27"), lattice("D3Q19")
OMEGA = 1.0 / 0.6


def rounded(df: DataFrame, names: tuple[str, ...], *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*keep, *[r(F.col(c), digits).alias(c) for c in names])


def sql_rounded(names: tuple[str, ...], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in names)


def cell_number() -> Column:
    """The number of a cell among those of all simulations."""
    return ((F.col("sim_id") * N + F.col("x")) * N + F.col("y")) * N + F.col("z")


# ------------------------------------------------------------------ sources

@query("src01_aircraft_voxels", f"WITH {fx.CELLS_SQL} SELECT sim AS design_id, c - sim * 512 AS cell, CASE WHEN solid THEN 1.0::DOUBLE ELSE 0.0 END AS p FROM cell")
def src01(spark: SparkSession, d: str) -> DataFrame:
    return grids.aircraft_designs(spark, N, fx.simulations(spark, d, "design_id")).select("design_id", "cell", "p")


@query("set05_fuselage_or_wings", f"WITH {fx.CELLS_SQL} SELECT count(*) AS solid, count(*) FILTER (WHERE z < 1 OR z > 7) AS in_wings FROM cell WHERE solid")
def set05(spark: SparkSession, d: str) -> DataFrame:
    return fx.grid(spark, d).where("solid").agg(F.count(F.lit(1)).alias("solid"), F.count_if(F.expr("z < 1 or z > 7")).alias("in_wings"))


@query("src02_constant_grid", f"WITH {fx.CELLS_SQL} SELECT c AS cell, 1e-12::DOUBLE AS value FROM cell")
def src02(spark: SparkSession, d: str) -> DataFrame:
    return fx.grid(spark, d).select("cell", lit(1e-12).alias("value"))


def lattice_query(name: str, lat, sql_name: str) -> None:
    @query(name, f"WITH {fx.lattice_sql(lat)} SELECT '{lat.name}' AS model, i, ex, ey, ez, w, opp FROM lat")
    def f(spark: SparkSession, d: str, lat=lat) -> DataFrame:
        return lat.frame(spark)


lattice_query("src03_lattice_27", D27, "D3Q27")
lattice_query("src04_lattice_19", D19, "D3Q19")
lattice_query("src05_lattice_guide27", lattice("guide27"), "guide27")
lattice_query("src05_lattice_guide19", lattice("guide19"), "guide19")
lattice_query("src03_lattice_27_corrected", lattice("D3Q27", "corrected"), "D3Q27")


@query("joi02_opposite_lookup", f"WITH {fx.lattice_sql(D27)} SELECT a.i, a.opp, a.ex + b.ex = 0 AND a.ey + b.ey = 0 AND a.ez + b.ez = 0 AS is_opposite FROM lat a JOIN lat b ON b.i = a.opp")
def joi02(spark: SparkSession, d: str) -> DataFrame:
    a, b = D27.frame(spark).alias("a"), D27.frame(spark).alias("b")
    ok = F.lit(True)
    for e in ("ex", "ey", "ez"):
        ok = ok & (F.col(f"a.{e}") + F.col(f"b.{e}") == 0)
    return a.join(F.broadcast(b), F.col("b.i") == F.col("a.opp")).select("a.i", "a.opp", ok.alias("is_opposite"))


@query("cmp55_relaxation_rates", "SELECT i, CASE WHEN i < 4 THEN 1.0 WHEN i < 7 THEN 1.2 WHEN i < 13 THEN 1.0 ELSE 1.6 END::DOUBLE AS rate FROM range(19) t(i)")
def cmp55(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(D19.relaxation)), "i long, rate double")


@query("src23_linspace", "SELECT CAST(k AS INTEGER) AS k, round(-1 + 3.0::DOUBLE * k / 10, 9) + 0.0 AS value FROM range(11) t(k)")
def src23(spark: SparkSession, d: str) -> DataFrame:
    return grids.linspace(spark, -1.0, 2.0, 11).select("k", r(F.col("value"), 9).alias("value"))


@query("src24_root_blocks", "SELECT i AS block_id, 0 AS level, CAST(i // 4 * 4 AS INTEGER) AS ox, CAST(i // 2 % 2 * 4 AS INTEGER) AS oy, CAST(i % 2 * 4 AS INTEGER) AS oz, 4 AS size, true AS is_leaf FROM range(8) t(i)")
def src24(spark: SparkSession, d: str) -> DataFrame:
    return grids.root_blocks(spark, 8, 4).drop("parent_id")


@query("src21_opcodes", "SELECT * FROM (VALUES " + ", ".join(f"('{name}', {code}, '{code:06b}')" for name, code in grids.OPCODES.items()) + ") AS t(name, code, bits)")
def src21(spark: SparkSession, d: str) -> DataFrame:
    return grids.opcodes(spark)


# ------------------------------------------------------------------ scalars

@query("prj01_threshold_mask", f"WITH {fx.VOXELS_SQL} SELECT design_id, cell, p > 0.5 AS solid FROM voxel")
def prj01(spark: SparkSession, d: str) -> DataFrame:
    return fx.voxels(spark, d).select("design_id", "cell", (F.col("p") > 0.5).alias("solid"))


ODD_SQL = "odd AS (SELECT i, CASE i % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE ELSE i END AS x FROM (SELECT event_id AS i FROM events))"


def odd(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(i.alias("i"), F.when(i % 4 == 0, lit(float("nan"))).when(i % 4 == 1, lit(float("inf"))).when(i % 4 == 2, lit(float("-inf"))).otherwise(i.cast("double")).alias("x"))


@query("prj06_nan_to_num", f"WITH {ODD_SQL} SELECT i, CASE WHEN isnan(x) THEN 1e-12 WHEN isinf(x) AND x > 0 THEN 1e18 WHEN isinf(x) THEN -1e18 ELSE x END AS x FROM odd")
def prj06(spark: SparkSession, d: str) -> DataFrame:
    return odd(spark, d).select("i", nan_to_num(F.col("x")).alias("x"))


@query("prj07_clamp", f"WITH {ODD_SQL} SELECT i, CASE WHEN isnan(x) THEN 'NaN' ELSE CAST(CAST(greatest(-5, least(5, x)) AS INTEGER) AS VARCHAR) END AS x FROM odd")
def prj07(spark: SparkSession, d: str) -> DataFrame:
    c = clamp(F.col("x"), -5, 5)
    return odd(spark, d).select("i", F.when(F.isnan(c), F.lit("NaN")).otherwise(F.when(~F.isnan(c), c).cast("int").cast("string")).alias("x"))


@query("prj16_finite_test", f"WITH {ODD_SQL} SELECT count(*) FILTER (WHERE isnan(x)) AS nans, count(*) FILTER (WHERE isinf(x)) AS infinities, bool_or(isnan(x)) AS any_nan FROM odd")
def prj16(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return odd(spark, d).agg(F.count_if(F.isnan(x)).alias("nans"), F.count_if(F.abs(x) == float("inf")).alias("infinities"), F.bool_or(F.isnan(x)).alias("any_nan"))


@query("fn_scalar_families", "SELECT i, round(1 / (1 + exp(-x)), 9) AS sigmoid, round(x / (1 + exp(-x)), 9) + 0.0 AS silu, greatest(0, x) AS relu, round(tanh(x), 9) + 0.0 AS tanh, round(radians(x), 9) + 0.0 AS radians FROM (SELECT event_id AS i, (event_id % 40 - 20) / 2.0::DOUBLE AS x FROM events)")
def fn_scalars(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.scalars import relu, sigmoid, silu

    x = (F.col("event_id") % 40 - 20) / lit(2)
    return table(spark, d, "events").select(F.col("event_id").alias("i"), F.round(sigmoid(x), 9).alias("sigmoid"), r(silu(x), 9).alias("silu"), relu(x).alias("relu"), r(F.tanh(x), 9).alias("tanh"), r(F.radians(x), 9).alias("radians"))


# ------------------------------------------------------------------ stencils

GRAD = fx.gradient_sql(("ux", "uy", "uz"), "u", "g")
CURL = "w AS (SELECT *, uz_y - uy_z AS wx, ux_z - uz_x AS wy, uy_x - ux_y AS wz, ux_x AS s11, uy_y AS s22, uz_z AS s33, (ux_y + uy_x) / 2 AS s12, (ux_z + uz_x) / 2 AS s13, (uy_z + uz_y) / 2 AS s23 FROM g)"
S2 = "(s11 * s11 + s22 * s22 + s33 * s33 + 2 * (s12 * s12 + s13 * s13 + s23 * s23))"


@query("win01_gradient", f"WITH {fx.SMOOTH_SQL}, {GRAD} SELECT c AS cell, {sql_rounded(tuple(f'{u}_{a}' for u in ('ux', 'uy', 'uz') for a in 'xyz'))} FROM g")
def win01(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.gradient(fx.smooth(spark, d), ("ux", "uy", "uz")), tuple(f"{u}_{a}" for u in ("ux", "uy", "uz") for a in "xyz"), "cell")


@query("win02_vorticity", f"WITH {fx.SMOOTH_SQL}, {GRAD}, {CURL} SELECT c AS cell, {sql_rounded(('wx', 'wy', 'wz'))} FROM w")
def win02(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.vorticity(fx.smooth(spark, d)), ("wx", "wy", "wz"), "cell")


@query("win03_strain", f"WITH {fx.SMOOTH_SQL}, {GRAD}, {CURL} SELECT c AS cell, {sql_rounded(('s11', 's22', 's33', 's12', 's13', 's23'))} FROM w")
def win03(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.gradient(fx.smooth(spark, d), ("ux", "uy", "uz")).withColumns(stencil.strain()), ("s11", "s22", "s33", "s12", "s13", "s23"), "cell")


@query("win04_q_criterion", f"WITH {fx.SMOOTH_SQL}, {GRAD}, {CURL} SELECT c AS cell, round(0.5 * (wx * wx + wy * wy + wz * wz - {S2}), 6) + 0.0 AS q FROM w")
def win04(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.q_criterion(fx.smooth(spark, d)), ("q",), "cell")


@query("win05_guide_q", f"WITH {fx.SMOOTH_SQL}, {GRAD}, {CURL} SELECT c AS cell, round(0.5 * (wx * wx + wy * wy + wz * wz), 6) + 0.0 AS q FROM w")
def win05(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.guide_q(fx.smooth(spark, d)), ("q",), "cell")


def box_sql(value: str, source: str = "u") -> str:
    return f"(SELECT sum(n.{value}) FROM {source} n WHERE abs(n.x - g.x) <= 1 AND abs(n.y - g.y) <= 1 AND abs(n.z - g.z) <= 1) / 27"


@query("win06_box_filter", f"WITH {fx.SMOOTH_SQL} SELECT g.c AS cell, round(sum(n.ux) / 27, 6) + 0.0 AS fx, round(sum(n.uz * n.uz) / 27, 6) + 0.0 AS fz2 FROM u g JOIN u n ON n.sim = g.sim AND abs(n.x - g.x) <= 1 AND abs(n.y - g.y) <= 1 AND abs(n.z - g.z) <= 1 GROUP BY g.c")
def win06(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.box_filter(fx.smooth(spark, d), {"fx": "ux", "fz2": F.col("uz") * F.col("uz")}, width=stencil.box_width(2.0)), ("fx", "fz2"), "cell")


def gauss_sql(source: str, value: str, axis: str, out: str) -> str:
    others = " AND ".join(f"n.{a} = g.{a}" for a in "xyz" if a != axis)
    mirror = f"CASE WHEN g.{axis} + k < 0 THEN -g.{axis} - k - 1 WHEN g.{axis} + k > 7 THEN 15 - g.{axis} - k ELSE g.{axis} + k END"
    return f"{out} AS MATERIALIZED (SELECT g.sim, g.c, g.x, g.y, g.z, sum(n.{value} * wt) / max(total) AS {value} FROM {source} g CROSS JOIN kernel JOIN {source} n ON n.sim = g.sim AND {others} AND n.{axis} = {mirror} GROUP BY g.sim, g.c, g.x, g.y, g.z)"


KERNEL_SQL = "kernel AS (SELECT k, exp(-0.5 * (k / 0.8::DOUBLE) * (k / 0.8::DOUBLE)) AS wt, sum(exp(-0.5 * (k / 0.8::DOUBLE) * (k / 0.8::DOUBLE))) OVER () AS total FROM range(-3, 4) t(k))"


@query("win07_gaussian_filter", f"""WITH {fx.SMOOTH_SQL}, {KERNEL_SQL},
{gauss_sql('u', 'ux', 'x', 'g1')}, {gauss_sql('g1', 'ux', 'y', 'g2')}, {gauss_sql('g2', 'ux', 'z', 'g3')} SELECT c AS cell, round(ux, 6) + 0.0 AS smooth FROM g3""")
def win07(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencil.gaussian_filter(fx.smooth(spark, d), "ux", "smooth"), ("smooth",), "cell")


DILATED_SQL = "wide AS (SELECT DISTINCT b.c FROM cell a JOIN cell b ON a.sim = b.sim AND a.solid AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1)"


@query("cmp20_dilation", f"WITH {fx.CELLS_SQL}, {DILATED_SQL} SELECT c AS cell FROM wide")
def cmp20(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.smooth(spark, d)
    return stencil.dilated(cells.where("solid"), N).select(cell_number().alias("cell"))


@query("joi15_boundary_fluid", f"WITH {fx.CELLS_SQL}, {DILATED_SQL} SELECT c AS cell FROM wide WHERE c NOT IN (SELECT c FROM cell WHERE solid)")
def joi15(spark: SparkSession, d: str) -> DataFrame:
    return stencil.boundary(fx.smooth(spark, d).where("solid"), N).select(cell_number().alias("cell"))


@query("prj10_mask_algebra", f"WITH {fx.CELLS_SQL}, {DILATED_SQL} SELECT count(*) FILTER (WHERE w.c IS NOT NULL) AS dilated, count(*) FILTER (WHERE solid) AS solid, count(*) FILTER (WHERE w.c IS NOT NULL AND NOT solid) AS boundary FROM cell LEFT JOIN wide w USING (c)")
def prj10(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.smooth(spark, d)
    wide = stencil.dilated(cells.where("solid"), N).withColumn("in_wide", F.lit(True))
    at = cells.join(wide, ["sim_id", "x", "y", "z"], "left").withColumn("in_wide", F.coalesce("in_wide", F.lit(False)))
    return at.agg(F.count_if("in_wide").alias("dilated"), F.count_if("solid").alias("solid"), F.count_if(F.expr("in_wide and not solid")).alias("boundary"))


@query("set04_except", f"WITH {fx.CELLS_SQL}, {DILATED_SQL} SELECT c AS cell FROM wide EXCEPT SELECT c FROM cell WHERE solid")
def set04(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.smooth(spark, d)
    at = lambda df: df.select(cell_number().alias("cell"))
    return at(stencil.dilated(cells.where("solid"), N)).subtract(at(cells.where("solid")))


@query("joi11_face_neighbours", f"WITH {fx.CELLS_SQL} SELECT a.c AS cell, count(*) AS neighbours FROM cell a JOIN cell b ON a.sim = b.sim AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 GROUP BY a.c")
def joi11(spark: SparkSession, d: str) -> DataFrame:
    spread = stencil.neighbours(N)(fx.grid(spark, d))
    return spread.groupBy("cell").agg(F.count(F.lit(1)).alias("neighbours"))


# ------------------------------------------------------------------ lattice steps

MOMENTS = "m AS MATERIALIZED (SELECT c, sum(f) AS rho, sum(f * ex) / (sum(f) + 1e-12) AS ux, sum(f * ey) / (sum(f) + 1e-12) AS uy, sum(f * ez) / (sum(f) + 1e-12) AS uz FROM pop GROUP BY c)"
EQ = "w * rho * (1 + 3 * (ex * ux + ey * uy + ez * uz) + 4.5 * (ex * ux + ey * uy + ez * uz) * (ex * ux + ey * uy + ez * uz) - 1.5 * (ux * ux + uy * uy + uz * uz))"
BGK = f"pre AS MATERIALIZED (SELECT p.*, m.rho, m.ux, m.uy, m.uz, f + {OMEGA!r} * ({EQ} - f) AS fp FROM pop p JOIN m USING (c))"


def stream_sql(value: str = "fp", source: str = "pre", wall: bool = True) -> str:
    pulled = f"JOIN {source} s ON s.sim = p.sim AND s.i = p.i AND s.x = (p.x - p.ex + 8) % 8 AND s.y = (p.y - p.ey + 8) % 8 AND s.z = (p.z - p.ez + 8) % 8"
    bounce = f"LEFT JOIN {source} b ON b.c = p.c AND b.i = p.opp" if wall else ""
    result = f"CASE WHEN p.solid THEN b.{value} ELSE s.{value} END" if wall else f"s.{value}"
    return f"post AS MATERIALIZED (SELECT p.c, p.i, {result} AS f FROM {source} p {pulled} {bounce})"


def long_form(df: DataFrame, digits: int = 9) -> DataFrame:
    """One row for each cell and population, a slice of cells at a time."""

    def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.slice(start, 2000)
                sizes = part.column("f").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                values = part.column("f").flatten()
                f = half_up(values.to_numpy(zero_copy_only=False), digits)
                i = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                none = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("cell").to_numpy(), sizes)), pa.array(i.astype(np.int32)), pa.array(f, mask=none)], names=["cell", "i", "f"])

    return df.select(cell_number().alias("cell"), "f").mapInArrow(unrolled, "cell long, i int, f double")


@query("agg01_moments", f"WITH {fx.flow_sql(D27)}, {MOMENTS} SELECT c AS cell, {sql_rounded(('rho', 'ux', 'uy', 'uz'), 9)} FROM m")
def agg01(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lbm.moments(fx.flow(spark, d, D27), D27), ("rho", "ux", "uy", "uz"), "cell", digits=9)


@query("prj02_equilibrium", f"WITH {fx.flow_sql(D27)}, {MOMENTS} SELECT c AS cell, CAST(i AS INTEGER) AS i, round({EQ}, 9) + 0.0 AS f FROM pop JOIN m USING (c)")
def prj02(spark: SparkSession, d: str) -> DataFrame:
    return long_form(lbm.collided(fx.flow(spark, d, D27), D27, lbm.resting(D27)))


@query("prj04_bgk_relaxation", f"WITH {fx.flow_sql(D27)}, {MOMENTS}, {BGK} SELECT c AS cell, CAST(i AS INTEGER) AS i, round(fp, 9) + 0.0 AS f FROM pre")
def prj04(spark: SparkSession, d: str) -> DataFrame:
    return long_form(lbm.collided(fx.flow(spark, d, D27), D27, lbm.relaxing(D27, OMEGA)))


@query("prj03_guo_force", f"""WITH {fx.flow_sql(D19)}, {MOMENTS} SELECT c AS cell, CAST(i AS INTEGER) AS i, round(w * (1 - 0.5 * {OMEGA!r}) * (3 * (ex * 0.01 + ey * 0.02 - ez * 0.03) + 9 * (ex * ux + ey * uy + ez * uz) * (ex * 0.01 + ey * 0.02 - ez * 0.03) - 3 * (ux * 0.01 + uy * 0.02 - uz * 0.03)), 9) + 0.0 AS f FROM pop JOIN m USING (c)""")
def prj03(spark: SparkSession, d: str) -> DataFrame:
    df = lbm.moments(fx.flow(spark, d, D19), D19)
    force = tuple(lit(x) for x in (0.01, 0.02, -0.03))
    return long_form(df.withColumn("f", F.array(*lbm.guo_force(D19, lit(OMEGA), lbm.velocity_columns(), force))))


@query("joi01_streaming", f"WITH {fx.flow_sql(D27)}, {stream_sql('f', 'pop', wall=False)} SELECT c AS cell, CAST(i AS INTEGER) AS i, round(f, 9) AS f FROM post")
def joi01(spark: SparkSession, d: str) -> DataFrame:
    return long_form(lbm.streamed(fx.flow(spark, d, D27), D27, N))


@query("prj05_bounce_back", f"WITH {fx.flow_sql(D27)}, {stream_sql('f', 'pop')} SELECT c AS cell, CAST(i AS INTEGER) AS i, round(f, 9) AS f FROM post")
def prj05(spark: SparkSession, d: str) -> DataFrame:
    return long_form(lbm.streamed(fx.flow(spark, d, D27), D27, N).withColumn("f", lbm.bounced(D27)))


@query("cmp03_plain_step", f"WITH {fx.flow_sql(D27)}, {MOMENTS}, {BGK}, {stream_sql()} SELECT c AS cell, CAST(i AS INTEGER) AS i, round(f, 9) + 0.0 AS f FROM post")
def cmp03(spark: SparkSession, d: str) -> DataFrame:
    return long_form(lbm.plain_step(fx.flow(spark, d, D27), D27, N, OMEGA))


G27 = lattice("guide27")


@query("cmp52_guide_step", f"""WITH {fx.flow_sql(G27)}, {MOMENTS}, {BGK}, {stream_sql(wall=False)}
SELECT p.c AS cell, CAST(p.i AS INTEGER) AS i, round(CASE WHEN p.solid AND p.opp > p.i THEN o.f ELSE s.f END, 9) + 0.0 AS f FROM pop p JOIN post s ON s.c = p.c AND s.i = p.i JOIN post o ON o.c = p.c AND o.i = p.opp""")
def cmp52(spark: SparkSession, d: str) -> DataFrame:
    return long_form(lbm.guide_step(fx.flow(spark, d, G27), G27, N, OMEGA))


G19 = lattice("guide19")


@query("cmp45_block_step", f"WITH {fx.flow_sql(G19)}, {MOMENTS}, {BGK}, {stream_sql(wall=False)} SELECT c AS cell, CAST(i AS INTEGER) AS i, round(f, 9) + 0.0 AS f FROM post")
def cmp45(spark: SparkSession, d: str) -> DataFrame:
    return long_form(lbm.block_step(fx.flow(spark, d, G19).withColumnRenamed("sim_id", "block_id"), G19, N, OMEGA).withColumnRenamed("block_id", "sim_id"))


@query("cmp16_shifted_step", f"WITH {fx.flow_sql(D27)}, {MOMENTS}, {BGK}, {stream_sql()} SELECT p.c AS cell, CAST(p.i AS INTEGER) AS i, round(p.f - l.w, 7) + 0.0 AS f FROM post p JOIN lat l USING (i)")
def cmp16(spark: SparkSession, d: str) -> DataFrame:
    shifted = fx.flow(spark, d, D27).withColumn("f", F.array(*[F.col("f")[i] - lit(w) for i, w in enumerate(D27.weights)]))
    return long_form(lbm.mixed_precision_step(shifted, D27, N, (0.6 - 0.5) / 3, half=False), 7)


@query("cmp16_half_precision_step")
def cmp16_half(spark: SparkSession, d: str) -> DataFrame:
    shifted = fx.flow(spark, d, D27).withColumn("f", lbm.as_half(F.array(*[F.col("f")[i] - lit(w) for i, w in enumerate(D27.weights)])))
    return long_form(lbm.mixed_precision_step(shifted, D27, N, (0.6 - 0.5) / 3), 7)


CENTRAL = lambda powers: f"sum(f * {' * '.join(['1'] + ['(ex - ux)'] * powers[0] + ['(ey - uy)'] * powers[1] + ['(ez - uz)'] * powers[2])})"
ALL_MOMENTS = ("000", "100", "010", "001", "200", "020", "002", "110", "101", "011", "111", "300", "210", "220", "211", "400", "310", "311")


@query("agg02_central_moments", f"WITH {fx.flow_sql(D27)}, {MOMENTS} SELECT c AS cell, {', '.join(f'round({CENTRAL(tuple(map(int, p)))}, 9) + 0.0 AS k{p}' for p in ALL_MOMENTS)} FROM pop JOIN m USING (c) GROUP BY c")
def agg02(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lbm.central_moments(fx.flow(spark, d, D27), D27, ALL_MOMENTS), tuple(f"k{p}" for p in ALL_MOMENTS), "cell", digits=9)


RELAXED = """k AS MATERIALIZED (SELECT c, any_value(rho) AS rho, any_value(ux) AS ux, any_value(uy) AS uy, any_value(uz) AS uz, sum(f * (ex - ux) * (ex - ux)) AS a, sum(f * (ey - uy) * (ey - uy)) AS b, sum(f * (ez - uz) * (ez - uz)) AS d,
  sum(f * (ex - ux) * (ey - uy)) AS ab, sum(f * (ex - ux) * (ez - uz)) AS ad, sum(f * (ey - uy) * (ez - uz)) AS bd FROM pop JOIN m USING (c) GROUP BY c),
kr AS (SELECT c, rho, ux, uy, uz, a + 1.2 * (rho / 3 - a) AS a, b + 1.2 * (rho / 3 - b) AS b, d + 1.2 * (rho / 3 - d) AS d, ab * (1 - 1 / 0.6::DOUBLE) AS ab, ad * (1 - 1 / 0.6::DOUBLE) AS ad, bd * (1 - 1 / 0.6::DOUBLE) AS bd FROM k)"""


@query("cmp04_cascaded_relaxation", f"WITH {fx.flow_sql(D27)}, {MOMENTS}, {RELAXED} SELECT c AS cell, round(a, 9) AS k200, round(b, 9) AS k020, round(d, 9) AS k002, round(ab, 9) + 0.0 AS k110, round(ad, 9) + 0.0 AS k101, round(bd, 9) + 0.0 AS k011 FROM kr")
def cmp04(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lbm.relaxed_central(fx.flow(spark, d, D27), D27, 1 / 0.6, 1.2, 1.6), tuple(f"k{p}" for p in lbm.SECOND), "cell", digits=9)


POPULATIONS = f"""pre AS MATERIALIZED (SELECT p.sim, p.c, p.x, p.y, p.z, p.solid, p.i, p.ex, p.ey, p.ez, p.opp, {EQ} + w * (0.5 * (a - rho / 3) * ((ex - ux) * (ex - ux) - 1 / 3.0::DOUBLE) + 0.5 * (b - rho / 3) * ((ey - uy) * (ey - uy) - 1 / 3.0::DOUBLE) + 0.5 * (d - rho / 3) * ((ez - uz) * (ez - uz) - 1 / 3.0::DOUBLE)
  + ab * (ex - ux) * (ey - uy) + ad * (ex - ux) * (ez - uz) + bd * (ey - uy) * (ez - uz)) AS fp FROM pop p JOIN kr USING (c))"""


@query("cmp05_moments_to_populations", f"WITH {fx.flow_sql(D27)}, {MOMENTS}, {RELAXED}, {POPULATIONS} SELECT c AS cell, CAST(i AS INTEGER) AS i, round(fp, 9) + 0.0 AS f FROM pre")
def cmp05(spark: SparkSession, d: str) -> DataFrame:
    return long_form(lbm.cascaded_collision(fx.flow(spark, d, D27), D27))


@query("cmp02_cascaded_step", f"WITH {fx.flow_sql(D27)}, {MOMENTS}, {RELAXED}, {POPULATIONS}, {stream_sql()} SELECT c AS cell, CAST(i AS INTEGER) AS i, round(f, 9) + 0.0 AS f FROM post")
def cmp02(spark: SparkSession, d: str) -> DataFrame:
    return long_form(lbm.cascaded_step(fx.flow(spark, d, D27), D27, N))


@query("cmp47_guide_cascaded", f"WITH {fx.flow_sql(G19)}, {MOMENTS} SELECT c AS cell, CAST(i AS INTEGER) AS i, round({EQ}, 9) + 0.0 AS f FROM pop JOIN m USING (c)")
def cmp47(spark: SparkSession, d: str) -> DataFrame:
    return long_form(lbm.guide_cascaded_collision(fx.flow(spark, d, G19), G19))


@query("cmp11_constants_19", "SELECT round(8.575 * 0.1 * 32 / 1000 * 0.001 / 0.01, 9)::DOUBLE AS nu, round(3 * 8.575 * 0.1 * 32 / 1000 * 0.001 / 0.01 + 0.5, 9)::DOUBLE AS tau")
def cmp11(spark: SparkSession, d: str) -> DataFrame:
    k = lbm.constants_19(0.025, 1000, 0.1, 0.001, 32)
    return spark.createDataFrame([(round(k["nu"], 9), round(k["tau"], 9))], "nu double, tau double")


@query("cmp12_constants_27", "SELECT n, round(least(100000, 0.5 * pow(n, 1.5)), 6) AS reynolds, round(0.05 * n / least(100000, 0.5 * pow(n, 1.5)), 9) AS nu FROM (VALUES (16), (32), (64)) t(n)")
def cmp12(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, round(k["reynolds"], 6), round(k["nu"], 9)) for n in (16, 32, 64) for k in [lbm.constants_27(1e5, n)]]
    return spark.createDataFrame(rows, "n int, reynolds double, nu double")


@query("agg04_largest_change", f"WITH {fx.SMOOTH_SQL} SELECT round(max(abs(ux - (ux * 0.9 + 0.01 * x))), 9) AS change FROM u")
def agg04(spark: SparkSession, d: str) -> DataFrame:
    u = fx.smooth(spark, d)
    before, now = u.select("sim_id", "x", "y", "z", F.col("ux").alias("before")), u.select("sim_id", "x", "y", "z", (F.col("ux") * 0.9 + 0.01 * F.col("x")).alias("now"))
    return lbm.largest_change(before, now).select(F.round("change", 9).alias("change"))


@query("itr01_two_steps", f"""WITH {fx.flow_sql(D27)}, {MOMENTS}, {BGK}, {stream_sql()},
pop2 AS (SELECT p.sim, p.c, p.x, p.y, p.z, p.solid, p.i, p.ex, p.ey, p.ez, p.w, p.opp, q.f FROM pop p JOIN post q ON q.c = p.c AND q.i = p.i),
{MOMENTS.replace('m AS', 'm2 AS').replace('FROM pop ', 'FROM pop2 ')}, {BGK.replace('pre AS', 'pre2 AS').replace('FROM pop p JOIN m ', 'FROM pop2 p JOIN m2 ').replace('m.', 'm2.')}, {stream_sql('fp', 'pre2').replace('post AS', 'post2 AS')}
SELECT c AS cell, CAST(i AS INTEGER) AS i, round(f, 8) + 0.0 AS f FROM post2""")
def itr01(spark: SparkSession, d: str) -> DataFrame:
    last, _ = lbm.run(fx.flow(spark, d, D27).drop("cell"), lambda s: lbm.plain_step(s, D27, N, OMEGA), 2)
    return long_form(last, 8)


# ------------------------------------------------------------------ turbulence and forces

@query("cmp06_smagorinsky", f"WITH {fx.SMOOTH_SQL}, {GRAD}, {CURL} SELECT c AS cell, round(0.17 * 0.17 * sqrt(2 * {S2} + 1e-12), 8) AS nu_t FROM w")
def cmp06(spark: SparkSession, d: str) -> DataFrame:
    return rounded(turbulence.smagorinsky(fx.smooth(spark, d)), ("nu_t",), "cell", digits=8)


T_GRAD = fx.gradient_sql(("ux", "uy", "uz"), "t", "tg")
DYNAMIC = f"""{fx.SMOOTH_SQL}, {GRAD}, {CURL},
t AS MATERIALIZED (SELECT g.sim, g.c, g.x, g.y, g.z, sum(n.ux) / 27 AS ux, sum(n.uy) / 27 AS uy, sum(n.uz) / 27 AS uz, sum(n.ux * n.ux) / 27 AS xx, sum(n.uy * n.uy) / 27 AS yy, sum(n.uz * n.uz) / 27 AS zz, sum(n.ux * n.uy) / 27 AS xy, sum(n.ux * n.uz) / 27 AS xz, sum(n.uy * n.uz) / 27 AS yz
  FROM u g JOIN u n ON n.sim = g.sim AND abs(n.x - g.x) <= 1 AND abs(n.y - g.y) <= 1 AND abs(n.z - g.z) <= 1 GROUP BY g.sim, g.c, g.x, g.y, g.z),
{T_GRAD}, ts AS (SELECT *, ux_x AS s11, uy_y AS s22, uz_z AS s33, (ux_y + uy_x) / 2 AS s12, (ux_z + uz_x) / 2 AS s13, (uy_z + uz_y) / 2 AS s23 FROM tg),
mag AS (SELECT a.c, sqrt(2 * {S2.replace('s', 'a.s')} + 1e-12) AS ga, sqrt(2 * {S2.replace('s', 'b.s')} + 1e-12) AS gb, a.s11 AS a11, a.s22 AS a22, a.s33 AS a33, a.s12 AS a12, a.s13 AS a13, a.s23 AS a23, b.s11, b.s22, b.s33, b.s12, b.s13, b.s23,
  xx - b.ux * b.ux AS l11, yy - b.uy * b.uy AS l22, zz - b.uz * b.uz AS l33, xy - b.ux * b.uy AS l12, xz - b.ux * b.uz AS l13, yz - b.uy * b.uz AS l23 FROM w a JOIN ts b USING (c)),
mm AS (SELECT *, {', '.join(f'-2 * ga * a{k} + 8 * gb * s{k} AS m{k}' for k in turbulence.PARTS)} FROM mag),
cs AS (SELECT c, ga, greatest(0, least(0.2, sqrt(greatest((l11 * m11 + l22 * m22 + l33 * m33 + 2 * (l12 * m12 + l13 * m13 + l23 * m23)) / (m11 * m11 + m22 * m22 + m33 * m33 + 2 * (m12 * m12 + m13 * m13 + m23 * m23) + 1e-12), 1e-12) + 1e-12))) AS cs FROM mm)"""


@query("cmp07_dynamic_smagorinsky", f"WITH {DYNAMIC} SELECT c AS cell, round(cs, 6) AS cs, round(cs * cs * ga, 6) AS nu_t FROM cs")
def cmp07(spark: SparkSession, d: str) -> DataFrame:
    return rounded(turbulence.dynamic_smagorinsky(fx.smooth(spark, d)), ("cs", "nu_t"), "cell")


WALE = """d AS (SELECT *, (ux_x + uy_y + uz_z) / 3 AS third FROM g),
dd AS (SELECT *, ux_x * ux_x + ux_y * uy_x + ux_z * uz_x - 2 * third * ux_x AS d1, uy_x * ux_y + uy_y * uy_y + uy_z * uz_y - 2 * third * uy_y AS d2, uz_x * ux_z + uz_y * uy_z + uz_z * uz_z - 2 * third * uz_z AS d3 FROM d),
mag AS (SELECT c, sqrt(d1 * d1 + d2 * d2 + d3 * d3 + 1e-12) AS dm, sqrt(2 * (ux_x * ux_x + uy_y * uy_y + uz_z * uz_z) + 1e-12) AS sm FROM dd)"""


@query("cmp08_wale", f"WITH {fx.SMOOTH_SQL}, {GRAD}, {WALE} SELECT c AS cell, round(0.25 * pow(dm, 1.5) / (pow(sm, 2.5) + pow(dm, 1.25) + 1e-12), 6) AS nu_t FROM mag")
def cmp08(spark: SparkSession, d: str) -> DataFrame:
    return rounded(turbulence.wale(fx.smooth(spark, d)), ("nu_t",), "cell")


@query("cmp09_turbulence_dispatch", f"WITH {fx.SMOOTH_SQL}, {GRAD}, {CURL} SELECT 'none' AS model, 0.0::DOUBLE AS mean_nu_t UNION ALL SELECT 'smagorinsky', round(avg(0.17 * 0.17 * sqrt(2 * {S2} + 1e-12)), 7) FROM w")
def cmp09(spark: SparkSession, d: str) -> DataFrame:
    none = turbulence.eddy_viscosity(fx.smooth(spark, d), None).agg(F.avg("nu_t").alias("mean_nu_t")).select(F.lit("none").alias("model"), "mean_nu_t")
    some = turbulence.eddy_viscosity(fx.smooth(spark, d), "smagorinsky").agg(F.round(F.avg("nu_t"), 7).alias("mean_nu_t")).select(F.lit("smagorinsky").alias("model"), "mean_nu_t")
    return none.union(some)


CONFINEMENT = f"""{fx.SMOOTH_SQL}, {GRAD}, {CURL}, wm AS MATERIALIZED (SELECT sim, c, x, y, z, wx, wy, wz, sqrt(wx * wx + wy * wy + wz * wz + 1e-12) AS mag FROM w), {fx.gradient_sql(('mag',), 'wm', 'h')},
e AS (SELECT *, sqrt(mag_x * mag_x + mag_y * mag_y + mag_z * mag_z + 1e-12) AS gm, 0.01 * mag / (avg(mag) OVER (PARTITION BY sim) + 1e-12) AS eps FROM h),
eta AS (SELECT *, greatest(1e-12, least(1e12, mag_x / gm)) AS ex, greatest(1e-12, least(1e12, mag_y / gm)) AS ey, greatest(1e-12, least(1e12, mag_z / gm)) AS ez FROM e)"""


@query("cmp10_vorticity_confinement", f"WITH {CONFINEMENT} SELECT c AS cell, round(eps * (ey * wz - ez * wy), 7) + 0.0 AS fx, round(eps * (ez * wx - ex * wz), 7) + 0.0 AS fy, round(eps * (ex * wy - ey * wx), 7) + 0.0 AS fz FROM eta")
def cmp10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(turbulence.confinement_force(fx.smooth(spark, d)), ("fx", "fy", "fz"), "cell", digits=7)


@query("cmp01_les_step")
def cmp01(spark: SparkSession, d: str) -> DataFrame:
    out = lbm.les_step(fx.flow(spark, d, D19), D19, N, 0.02)
    cell = cell_number()
    return out.select(cell.alias("cell"), "solid", *[r(F.col(c)).alias(c) for c in ("rho", "ux", "uy", "uz", "nu_t", "q")], F.transform("f", lambda v: F.round(v, 7)).alias("f"))


@query("agg06_projected_area", f"WITH {fx.CELLS_SQL} SELECT sim AS sim_id, count(DISTINCT (y, z)) * 0.25::DOUBLE AS area FROM cell WHERE solid GROUP BY sim")
def agg06(spark: SparkSession, d: str) -> DataFrame:
    return forces.projected_area(fx.smooth(spark, d), 0.5)


FORCE_SQL = f"""{fx.flow_sql(D27)}, {DILATED_SQL}, fp AS (SELECT p.sim, p.ex, p.ez, p.f + o.f AS pair FROM pop p JOIN pop o ON o.c = p.c AND o.i = p.opp WHERE p.c IN (SELECT c FROM wide) AND NOT p.solid)"""


@query("agg07_link_force", f"WITH {FORCE_SQL} SELECT sim AS sim_id, round(sum(ex * pair), 7) + 0.0 AS force_x, round(sum(ez * pair), 7) + 0.0 AS force_z FROM fp GROUP BY sim")
def agg07(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.flow(spark, d, D27)
    edge = stencil.boundary(cells.where("solid"), N)
    return rounded(forces.link_force(cells.join(edge, ["sim_id", "x", "y", "z"]), D27), ("force_x", "force_z"), "sim_id", digits=7)


@query("cmp13_coefficients", f"""WITH {FORCE_SQL}, s AS (SELECT sim, sum(ex * pair) AS fx, sum(ez * pair) AS fz FROM fp GROUP BY sim), a AS (SELECT sim, count(DISTINCT (y, z)) AS area FROM cell WHERE solid GROUP BY sim), q AS (SELECT sim, sum(f) AS total FROM pop GROUP BY sim)
SELECT sim AS sim_id, round(abs(fx + 1e-13) / (0.5 * 8.575 * 8.575 * area + 1e-10), 8)::DOUBLE AS cd, round(abs(fz + 1e-13) / (0.5 * 8.575 * 8.575 * area + 1e-10), 8)::DOUBLE AS cl, round(total, 6) AS pressure_sum FROM s JOIN a USING (sim) JOIN q USING (sim)""")
def cmp13(spark: SparkSession, d: str) -> DataFrame:
    out = forces.coefficients(lbm.moments(fx.flow(spark, d, D27), D27), D27, N, 0.025)
    return out.select("sim_id", F.round("cd", 8).alias("cd"), F.round("cl", 8).alias("cl"), F.round("pressure_sum", 6).alias("pressure_sum"))


@query("cmp13_coefficients_by_wall", f"""WITH {fx.flow_sql(lattice('D3Q27', 'corrected'))}, l AS (SELECT p.sim, p.ex, p.ez, 2 * p.f AS mom FROM pop p JOIN cell s ON s.sim = p.sim AND s.solid AND s.x = (p.x + p.ex + 8) % 8 AND s.y = (p.y + p.ey + 8) % 8 AND s.z = (p.z + p.ez + 8) % 8 WHERE NOT p.solid AND p.i > 0)
SELECT sim AS sim_id, round(sum(ex * mom), 7) + 0.0 AS force_x, round(sum(ez * mom), 7) + 0.0 AS force_z FROM l GROUP BY sim""")
def cmp13_wall(spark: SparkSession, d: str) -> DataFrame:
    lat = lattice("D3Q27", "corrected")
    return rounded(forces.link_force_by_wall(fx.flow(spark, d, lat), lat, N), ("force_x", "force_z"), "sim_id", digits=7)


@query("cmp14_solid_momentum", f"WITH {fx.SMOOTH_SQL} SELECT sim AS sim_id, round(sum(ux) FILTER (WHERE solid), 7) + 0.0 AS force_x, round(sum(uz) FILTER (WHERE solid), 7) + 0.0 AS force_z FROM u GROUP BY sim")
def cmp14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forces.solid_momentum(fx.smooth(spark, d)), ("force_x", "force_z"), "sim_id", digits=7)


@query("agg03_field_summary", f"""WITH {fx.SMOOTH_SQL}, {GRAD}, {CURL}, s AS (SELECT *, 0.0289 * sqrt(2 * {S2} + 1e-12) AS nu_t, 0.5 * (wx * wx + wy * wy + wz * wz - {S2}) AS q FROM w)
SELECT sim AS sim_id, round(max(sqrt(wx * wx + wy * wy + wz * wz)), 6) AS max_vorticity, round(avg(nu_t), 6) AS mean_nu_t, round(sum(ux * ux + 1), 6) AS pressure_sum, count(*) FILTER (WHERE q > 0.2) AS vortex_cells, count(*) FILTER (WHERE q > 0.2) * 0.125::DOUBLE AS vortex_volume, 0::BIGINT AS not_finite FROM s GROUP BY sim""")
def agg03(spark: SparkSession, d: str) -> DataFrame:
    s = stencil.q_criterion(fx.smooth(spark, d)).withColumns({"nu_t": lit(0.17**2) * turbulence.magnitude(), "rho": F.col("ux") ** 2 + 1})
    out = forces.field_summary(s, 0.5)
    return out.select("sim_id", *[F.round(c, 6).alias(c) for c in ("max_vorticity", "mean_nu_t", "pressure_sum")], "vortex_cells", "vortex_volume", "not_finite")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return fx.simulations(spark, d, "id")


@query("cmp15_two_resolutions", "SELECT i AS sim_id, round(CASE WHEN i % 2 = 0 THEN 0.7 * (0.1 * i + 0.05 * i) / 2 + 0.3 * 0.03 ELSE (0.1 * i + 0.05 * i) / 2 END, 9)::DOUBLE AS cd, round(CASE WHEN i % 2 = 0 THEN 0.7 * (0.2 * i + 0.1 * i) / 2 + 0.3 * 0.04 ELSE (0.2 * i + 0.1 * i) / 2 END, 9)::DOUBLE AS cl, i % 2 = 0 AS blended FROM (SELECT s_suppkey AS i FROM supplier)")
def cmp15(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    coarse = suppliers(spark, d).select(i.alias("sim_id"), (0.1 * i).alias("cd"), (0.2 * i).alias("cl"))
    fine = suppliers(spark, d).select(i.alias("sim_id"), (0.05 * i).alias("cd"), (0.1 * i).alias("cl"))
    out = forces.two_resolutions(coarse, fine, forces.outside_stub(coarse.where("sim_id % 2 = 0")))
    return out.select("sim_id", F.round("cd", 9).alias("cd"), F.round("cl", 9).alias("cl"), "blended")


@query("cmp53_outside_stub", "SELECT i AS sim_id, 0.03::DOUBLE AS cd, 0.04::DOUBLE AS cl FROM (SELECT s_suppkey AS i FROM supplier)")
def cmp53(spark: SparkSession, d: str) -> DataFrame:
    out = forces.outside_stub(suppliers(spark, d).select(F.col("id").alias("sim_id")))
    return out.select("sim_id", F.round("cd", 9).alias("cd"), F.round("cl", 9).alias("cl"))


@query("cmp18_design_loss", "SELECT round(avg(33 * (i / 20.0) + 33 * 0.01 * i + 34 * (1 - least(abs(i / 5.0 - 1), 1))), 9)::DOUBLE AS loss FROM (SELECT s_suppkey AS i FROM supplier)")
def cmp18(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    rows = suppliers(spark, d).select((i / lit(20)).alias("volume"), (0.01 * i).alias("cd"), (i / lit(5) - 1).alias("cl"))
    return forces.design_loss(rows).select(F.round("loss", 9).alias("loss"))


# ------------------------------------------------------------------ components

COMPONENTS_SQL = f"""{fx.VOXELS_SQL}, s AS MATERIALIZED (SELECT * FROM voxel WHERE p > 0.5), a AS MATERIALIZED (SELECT p.design_id, p.cell AS f, q.cell AS t FROM s p JOIN s q ON p.design_id = q.design_id AND abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1),
reach(design_id, cell, other) AS (SELECT design_id, cell, cell FROM s UNION SELECT r.design_id, r.cell, a.t FROM reach r JOIN a ON a.design_id = r.design_id AND a.f = r.other),
lab AS MATERIALIZED (SELECT design_id, cell, min(other) AS label FROM reach GROUP BY design_id, cell),
size AS (SELECT design_id, label, count(*) AS cells FROM lab GROUP BY design_id, label)"""


@query("cmp19_components", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT design_id, cell, label FROM lab")
def cmp19(spark: SparkSession, d: str) -> DataFrame:
    out = components.labelled(fx.voxels(spark, d).where("p > 0.5"), N)
    return out.select("design_id", F.col("cell").cast("long").alias("cell"), F.col("label").cast("long").alias("label"))


@query("agg08_component_sizes", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT design_id, label, cells FROM size")
def agg08(spark: SparkSession, d: str) -> DataFrame:
    return components.sizes(components.labelled(fx.voxels(spark, d).where("p > 0.5"), N)).select("design_id", F.col("label").cast("long").alias("label"), "cells")


@query("agg09_largest_component", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT design_id, count(*) AS components, max(cells) AS largest, CAST(sum(cells) AS BIGINT) AS total FROM size GROUP BY design_id")
def agg09(spark: SparkSession, d: str) -> DataFrame:
    return components.largest(components.sizes(components.labelled(fx.voxels(spark, d).where("p > 0.5"), N)))


@query("cmp17_connectivity_penalty", f"WITH RECURSIVE {COMPONENTS_SQL}, l AS (SELECT design_id, count(*) AS n, max(cells) AS m, sum(cells) AS t FROM size GROUP BY design_id) SELECT round(10 * avg(CASE WHEN n > 1 THEN (t - m) / (t + 1e-6) ELSE 0 END), 9) AS penalty FROM l")
def cmp17(spark: SparkSession, d: str) -> DataFrame:
    v = fx.voxels(spark, d)
    out = components.connectivity_penalty(v, components.sizes(components.labelled(v.where("p > 0.5"), N)))
    return out.select(F.round("penalty", 9).alias("penalty"))


@query("agg10_occupancy", f"WITH {fx.VOXELS_SQL} SELECT design_id, count(*) FILTER (WHERE p > 0.5) AS filled, count(*) AS cells, round(100.0::DOUBLE * count(*) FILTER (WHERE p > 0.5) / count(*), 9) AS percent FROM voxel GROUP BY design_id")
def agg10(spark: SparkSession, d: str) -> DataFrame:
    return components.occupancy(fx.voxels(spark, d)).withColumn("percent", F.round("percent", 9))


@query("cmp50_geometry_report", f"WITH RECURSIVE {COMPONENTS_SQL}, l AS (SELECT design_id, count(*) AS components, max(cells) AS largest FROM size GROUP BY design_id), b AS (SELECT design_id, max(x) - min(x) + 1 AS x_extent, max(y) - min(y) + 1 AS y_extent, max(z) - min(z) + 1 AS z_extent, count(*) AS filled FROM s GROUP BY design_id) SELECT design_id, filled, components, largest, x_extent, y_extent, z_extent FROM l JOIN b USING (design_id)")
def cmp50(spark: SparkSession, d: str) -> DataFrame:
    return components.report(fx.voxels(spark, d), N).select("design_id", "filled", "components", "largest", "x_extent", "y_extent", "z_extent")


@query("joi14_nearest_resample", f"WITH {fx.VOXELS_SQL} SELECT v.design_id, count(*) AS cells, count(*) FILTER (WHERE p > 0.5) AS filled FROM range(12) a(i), range(12) b(j), range(12) e(k), voxel v WHERE v.x = i * 8 // 12 AND v.y = j * 8 // 12 AND v.z = k * 8 // 12 GROUP BY v.design_id")
def joi14(spark: SparkSession, d: str) -> DataFrame:
    out = components.resampled(fx.voxels(spark, d), N, 12)
    return out.groupBy("design_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("p") > 0.5).alias("filled"))


@query("snk02_voxel_cubes", f"WITH {fx.VOXELS_SQL} SELECT design_id, 12 * count(*) AS triangles, round(count(*) * 1.0::DOUBLE, 6) AS volume, round(count(*) * 6.0::DOUBLE, 6) AS area FROM voxel WHERE p > 0.5 GROUP BY design_id")
def snk02(spark: SparkSession, d: str) -> DataFrame:
    out = mesh.signed_volume(mesh.cube_surface(fx.voxels(spark, d)))
    return out.select("design_id", "triangles", F.round("volume", 6).alias("volume"), F.round("area", 6).alias("area"))


@query("joi08_voxel_triangle_pairs", f"WITH {fx.VOXELS_SQL} SELECT design_id, cell, CAST(k AS INTEGER) AS k FROM voxel, range(12) t(k) WHERE p > 0.5")
def joi08(spark: SparkSession, d: str) -> DataFrame:
    return mesh.cube_surface(fx.voxels(spark, d)).select("design_id", "cell", "k")


@query("cmp21_level_surface")
def cmp21(spark: SparkSession, d: str) -> DataFrame:
    solid = fx.voxels(spark, d).withColumn("p", (F.col("p") > 0.5).cast("double"))
    out = mesh.signed_volume(mesh.level_surface(solid, N))
    return out.select("design_id", "triangles", F.round("volume", 6).alias("volume"), F.round("area", 6).alias("area"))
