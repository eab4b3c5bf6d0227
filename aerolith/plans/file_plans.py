"""Queries: mesh files by record ranges, and streams with state that go on after a stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import r
from ..operators import mesh
from ..session import remove_all, scratch
from ..sources import meshes, stl
from ..streaming import metrics
from .part_plans import SIZES
from .registry import query, table


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(design_id, t, ax, ... cz): the box of each part."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("design_id"), *[(first + F.col("p_partkey") % m).cast("double").alias(c) for c, first, m in SIZES])
    return mesh.box_surface(rows)


BOX_SQL = "WITH s AS (SELECT p_partkey AS design_id, 2 + p_partkey % 5 AS a, 3 + p_partkey % 7 AS b, 4 + p_partkey % 3 AS c FROM part)"


@query("snk06_mesh_segments", f"{BOX_SQL} SELECT design_id, 12::BIGINT AS triangles, 66::BIGINT AS places, CAST(18 * a AS DOUBLE) AS sx, CAST(18 * b AS DOUBLE) AS sy, CAST(18 * c AS DOUBLE) AS sz FROM s")
def snk06(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "meshes")
    meshes.write_meshes(boxes(spark, d), path)
    back = meshes.read_meshes(spark, path, records=1000)  # ranges that end inside meshes
    sums = [F.sum(sum((F.col(f"{c}{x}") for c in "bc"), F.col(f"a{x}"))).alias(f"s{x}") for x in "xyz"]
    return back.groupBy("design_id").agg(F.count(F.lit(1)).alias("triangles"), F.sum("t").alias("places"), *sums)


@query("src20_model_files", "SELECT row_number() OVER (ORDER BY lpad(CAST(n_nationkey AS VARCHAR), 4, '0')) - 1 AS place, 'model-' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || '.stl' AS name, 684::BIGINT AS length FROM nation")
def src20(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "models")
    save_models(spark, d, path)
    rows = meshes.listed(spark, path)
    return rows.select("place", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def save_models(spark: SparkSession, d: str, path: str) -> None:
    """A file for the box of each nation."""
    k = F.col("n_nationkey")
    sizes = table(spark, d, "nation").select(k.alias("design_id"), *[(first + k % m).cast("double").alias(c) for c, first, m in SIZES])
    files = stl.stl_bytes(mesh.box_surface(sizes))
    meshes.save_files(files.select(F.concat(F.lit("model-"), F.lpad(F.col("design_id").cast("string"), 4, "0"), F.lit(".stl")).alias("name"), "data"), path)


@query("srt06_files_in_order", "SELECT row_number() OVER (ORDER BY lpad(CAST(n_nationkey AS VARCHAR), 4, '0')) - 1 AS design_id, 12::BIGINT AS triangles, CAST(18 * (2 + n_nationkey % 5) AS DOUBLE) AS sx FROM nation")
def srt06(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "models")
    save_models(spark, d, path)
    back = meshes.read_meshes(spark, path, records=5)
    return back.groupBy("design_id").agg(F.count(F.lit(1)).alias("triangles"), F.sum(F.col("ax") + F.col("bx") + F.col("cx")).alias("sx"))


EVENTS = "user_id long, event_type string, ts timestamp, id long, value double"


def stopped_and_resumed(spark: SparkSession, d: str, build, mode: str) -> DataFrame:
    """A stream over the events in four files by time, stopped after the first two and resumed from its state."""
    path, at = scratch(spark, "feed"), scratch(spark, "stream")
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "value")
    first, last = rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts")) + 1).head()
    quarter = F.floor((F.unix_micros("ts") - first) * 4 / (last - first))
    for half in ((0, 1), (2, 3)):
        for k in half:
            metrics.fed(rows, path, quarter == k)
        out = metrics.run_on(build(metrics.metric_stream(spark, path, EVENTS)), at, mode)
    remove_all(spark, [path, f"{at}/state"])
    return out


@query("itr04_replay_state", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events)
SELECT user_id, count(*) AS kept, arg_max(event_id, age) AS oldest, arg_min(event_id, age) AS newest, round(avg(value), 6) + 0.0 AS mean FROM k WHERE age <= 30 GROUP BY user_id""")
def itr04_state(spark: SparkSession, d: str) -> DataFrame:
    out = stopped_and_resumed(spark, d, lambda s: metrics.replayed(s, "user_id", 30, idle=86_400.0 * 3650), "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("kept", "oldest", "newest", "mean"), "batch").alias("x"))
    return last.select("user_id", "x.kept", "x.oldest", "x.newest", r(F.col("x.mean")).alias("mean"))


@query("snk05_scalar_log", """WITH k AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 100 AS step FROM events)
SELECT event_type AS tag, CAST(step AS BIGINT) AS step, round(avg(value), 6) + 0.0 AS mean FROM k GROUP BY event_type, step HAVING count(*) = 100""")
def snk05(spark: SparkSession, d: str) -> DataFrame:
    out = stopped_and_resumed(spark, d, lambda s: metrics.logged(s, "event_type", 100), "append")
    return out.select(F.col("event_type").alias("tag"), "step", r(F.col("mean")).alias("mean"))
