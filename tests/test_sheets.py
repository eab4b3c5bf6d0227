"""Folded sheets by slices of designs against the same from tables of vertices and faces."""

import pytest
from pyspark.sql import functions as F

from aerolith.operators import aero, graph, mesh, sheets, surface
from aerolith.plans import fixtures as fx
from aerolith.plans.catalog import QUERIES
from aerolith.sources import grids

DATA = "/root/testdata/sf0.001"
AT_SIZE = "agg14_vertex_normals cmp29_mesh_graph doc05_curvature".split()


def near(rows, others):
    a, b = (sorted(map(tuple, r.collect())) for r in (rows, others))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=1e-9)


@pytest.fixture(scope="module")
def few(spark):
    """Actions of several lengths, one of them null: sheets stay flat without creases."""
    length = F.expr("element_at(array(50, 15, 7, 50), cast(design_id as int))")
    rows = grids.keyed_actions(spark.range(1, 5).select(F.col("id").alias("design_id"))).select("design_id", F.slice("action", F.lit(1), length).alias("action"))
    return rows, grids.sheet_vertices(spark, 10), grids.sheet_faces(spark, 10)


@pytest.mark.parametrize("name", AT_SIZE)
def test_one_shuffle_of_keys(spark, name):
    """Corners were joined to faces by three shuffles of all triangles, out of one task's folds."""
    df = QUERIES[name](spark, DATA)
    assert df.rdd.getNumPartitions() > 1
    found = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert found.count("Exchange") == 1 and "REPARTITION_BY_NUM" in found and "Join" not in found


def test_normals_equal_those_of_tables(few):
    actions, sheet, face = few
    got = sheets.on_sheets(*few, sheets.vertex_normals, "v int, nx double, ny double, nz double, curvature double", {})
    near(got, mesh.vertex_normals(mesh.folded(actions, sheet), face).select("design_id", "v", "nx", "ny", "nz", "curvature"))


def test_edges_equal_those_of_tables(few):
    actions, sheet, face = few
    got = sheets.on_sheets(*few, sheets.edges, "src int, dst int, dx double, dy double, dz double, src_nz double, src_curvature double", {})
    node, edge, _ = graph.mesh_graph(mesh.folded(actions, sheet), face, aero.with_defaults(actions))
    at = edge.join(node.select("design_id", F.col("v").alias("src"), "feat"), ["design_id", "src"])
    near(got, at.select("design_id", "src", "dst", *[F.col("attr")[k] for k in range(3)], F.col("feat")[5], F.col("feat")[6]))


def test_curvature_equals_that_of_tables(few):
    actions, sheet, face = few
    got = sheets.on_sheets(*few, sheets.curvature, "v int, lz double, area double, boundary boolean, curvature double", {})
    near(got, surface.curvature(mesh.folded(actions, sheet), face).select("design_id", "v", "lz", "area", "boundary", "curvature"))


def test_a_design_without_actions_is_flat(spark, few):
    rows = spark.createDataFrame([(1, None)], "design_id long, action array<double>")
    got = sheets.on_sheets(rows, *few[1:], sheets.vertex_normals, "v int, nz double, curvature double", {}).collect()
    assert len(got) == 121 and all(r.nz == pytest.approx(1.0) and r.curvature == pytest.approx(0.0) for r in got)
