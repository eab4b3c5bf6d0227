"""Queries: convolution blocks and pyramids over one grid of 4^3 cells for each embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lit, r
from ..operators import tiles
from ..session import scratch
from .network_plans import saved, weights_sql
from .registry import query, table

SHAPES = {"conv1": (54, 3), "conv2": (81, 3), "time1": (2, 3), "time2": (3, 3), "skip": (2, 3)}


def grids_of(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, y, z, feat): the 64 numbers of each row as cells, and their squares as a second channel."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("k", "p"))
    at = {a: F.floor(F.col("k") / n).cast("int") % 4 for a, n in (("x", 16), ("y", 4), ("z", 1))}
    p = F.col("p").cast("double") * 8
    return rows.select("id", *[c.alias(a) for a, c in at.items()], F.array(p, p * p).alias("feat"))


CELLS_SQL = """cell AS MATERIALIZED (SELECT vec_id AS id, k, k // 16 AS x, k // 4 % 4 AS y, k % 4 AS z, c, CASE c WHEN 0 THEN p ELSE p * p END AS v
  FROM (SELECT vec_id, k, CAST(embedding[1 + k] AS DOUBLE) * 8 AS p FROM embeddings, range(64) t(k)), range(2) u(c))"""


def block_sql(source: str, layer: str, out: str, shift: str = "") -> str:
    """out(id, k, x, y, z, c, v): norm, SiLU and convolution of a source of the same columns."""
    return f"""{out}_a AS MATERIALIZED (SELECT id, k, x, y, z, c, n / (1 + exp(-n)) AS v FROM (SELECT id, k, x, y, z, c, (v - avg(v) OVER g) / sqrt(var_pop(v) OVER g + 1e-5) AS n FROM {source} WINDOW g AS (PARTITION BY id, c))),
{out}_s AS (SELECT a.id, a.x - o.dx AS x, a.y - o.dy AS y, a.z - o.dz AS z, w.col AS c, sum(a.v * w.value) AS v FROM {out}_a a, (SELECT i, i // 9 - 1 AS dx, i // 3 % 3 - 1 AS dy, i % 3 - 1 AS dz FROM range(27) t(i)) o JOIN w ON w.layer = '{layer}' AND NOT w.bias AND w.row = a.c * 27 + o.i
  WHERE a.x - o.dx BETWEEN 0 AND 3 AND a.y - o.dy BETWEEN 0 AND 3 AND a.z - o.dz BETWEEN 0 AND 3 GROUP BY ALL),
{out} AS MATERIALIZED (SELECT q.id, q.x * 16 + q.y * 4 + q.z AS k, q.x, q.y, q.z, q.c, q.v + b.value{' + t.v' if shift else ''} AS v FROM {out}_s q JOIN w b ON b.layer = '{layer}' AND b.bias AND b.col = q.c{f' JOIN {shift} t ON t.id = q.id AND t.c = q.c' if shift else ''})"""


RESIDUAL_SQL = f"""WITH {weights_sql(SHAPES)}, {CELLS_SQL},
t0 AS (SELECT vec_id AS id, i AS c, CASE i WHEN 0 THEN vec_id % 7 / 7.0::DOUBLE ELSE vec_id % 11 / 11.0::DOUBLE END AS v FROM embeddings, range(2) t(i)),
t1 AS (SELECT id, col AS c, x / (1 + exp(-x)) AS v FROM (SELECT id, w.col, sum(t0.v * w.value) + any_value(b.value) AS x FROM t0 JOIN w ON w.layer = 'time1' AND NOT w.bias AND w.row = t0.c JOIN w b ON b.layer = 'time1' AND b.bias AND b.col = w.col GROUP BY id, w.col)),
t2 AS MATERIALIZED (SELECT id, w.col AS c, sum(t1.v * w.value) + any_value(b.value) AS v FROM t1 JOIN w ON w.layer = 'time2' AND NOT w.bias AND w.row = t1.c JOIN w b ON b.layer = 'time2' AND b.bias AND b.col = w.col GROUP BY id, w.col),
{block_sql("cell", "conv1", "h1", "t2")}, {block_sql("h1", "conv2", "h2")},
skip AS (SELECT c.id, c.k, w.col AS c, sum(c.v * w.value) + any_value(b.value) AS v FROM cell c JOIN w ON w.layer = 'skip' AND NOT w.bias AND w.row = c.c JOIN w b ON b.layer = 'skip' AND b.bias AND b.col = w.col GROUP BY c.id, c.k, w.col)
SELECT h2.id, CAST(h2.k AS BIGINT) AS cell, CAST(h2.c AS BIGINT) AS channel, round(h2.v + s.v, 6) + 0.0 AS value FROM h2 JOIN skip s ON s.id = h2.id AND s.k = h2.k AND s.c = h2.c"""


@query("nn03_residual_block", RESIDUAL_SQL)
def nn03(spark: SparkSession, d: str) -> DataFrame:
    cells = grids_of(spark, d)
    k = F.col("vec_id")
    time = table(spark, d, "embeddings").select(k.alias("id"), F.array(k % 7 / lit(7), k % 11 / lit(11)).alias("t"))
    out = tiles.residual_block(cells, time, saved(spark, SHAPES), 2, 3, "id", side=2)
    long = out.select("id", (F.col("x") * 16 + F.col("y") * 4 + F.col("z")).cast("long").alias("cell"), F.posexplode("feat").alias("c", "value"))
    return long.select("id", "cell", F.col("c").cast("long").alias("channel"), r(F.col("value")).alias("value"))


PYRAMID_SQL = """WITH c AS (SELECT vec_id AS id, k // 16 AS x, k // 4 % 4 AS y, k % 4 AS z, CAST(embedding[1 + k] AS DOUBLE) AS p FROM embeddings, range(64) t(k)),
l AS (SELECT id, level, x >> level AS x, y >> level AS y, z >> level AS z, p FROM c, range(3) t(level))
SELECT id, CAST(level AS INTEGER) AS level, CAST((x // 2 << 5) | (y // 2 << 4) | (z // 2 << 3) | (x % 2 << 2) | (y % 2 << 1) | z % 2 AS BIGINT) AS at, count(*) AS cells, round(avg(p), 9) + 0.0 AS mean, CASE level WHEN 0 THEN 50 ELSE 25 END AS epochs FROM l GROUP BY ALL"""


@query("itr03_resolutions", PYRAMID_SQL)
def itr03(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "pyramid")
    tiles.save_pyramid(tiles.pyramid(grids_of(spark, d).withColumn("p", F.col("feat")[0] / 8), "p", 2, "id", inner=1), path, "id")
    rows = spark.read.parquet(path)
    return rows.select("id", "level", "at", "cells", r(F.col("mean"), 9).alias("mean"), tiles.epochs_of(F.col("level"), 50).alias("epochs"))


@query("itr03_block_of_a_level", "WITH c AS (SELECT vec_id AS id, k, CAST(embedding[1 + k] AS DOUBLE) AS p FROM embeddings, range(64) t(k) WHERE k // 16 >= 2 AND k // 4 % 4 >= 2 AND k % 4 < 2) SELECT id, CAST(6 AS BIGINT) AS at, round(avg(p), 9) + 0.0 AS mean FROM c GROUP BY id")
def itr03_block(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "pyramid")
    tiles.save_pyramid(tiles.pyramid(grids_of(spark, d).withColumn("p", F.col("feat")[0] / 8), "p", 2, "id"), path, "id")
    # one block of the second level: a folder and a range of places
    return spark.read.parquet(path).where("level = 1 and at between 6 and 6").select("id", "at", r(F.col("mean"), 9).alias("mean"))
