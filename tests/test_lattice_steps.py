"""Lattice queries at size: simulations are dealt to tasks, and cells move without a row for each population."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import lbm
from aerolith.plans import fixtures as fx
from aerolith.plans.catalog import QUERIES
from aerolith.sources.lattice import lattice

DATA = "/root/testdata/sf0.001"
D27 = lattice("D3Q27")
AT_SIZE = """
cmp02_cascaded_step
cmp04_cascaded_relaxation
cmp16_shifted_step
cmp45_block_step
cmp47_guide_cascaded
prj02_equilibrium
prj04_bgk_relaxation
prj05_bounce_back
agg02_central_moments
cmp03_plain_step
cmp05_moments_to_populations
cmp52_guide_step
cmp01_les_step
""".split()
#: The mean of each grid reads the simulations a second time.
SHUFFLES = {"cmp01_les_step": 2}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", AT_SIZE)
def test_is_many_tasks_without_rows_of_populations(spark, name):
    """The file of suppliers is one split, which was one task's work for all cells until the first shuffle."""
    df = QUERIES[name](spark, DATA)
    assert df.rdd.getNumPartitions() > 1
    found = plan(df)
    assert found.count("Exchange hashpartitioning") == SHUFFLES.get(name, 1) and "REPARTITION_BY_NUM" in found
    assert "Generate" not in found and "SortAggregate" not in found


@pytest.mark.parametrize("n, tile", [(8, 16), (8, 3), (5, 2)])
def test_streaming_by_tiles(spark, n, tile):
    """Grids of one tile and of several, against numpy's roll."""
    flow = fx.flow(spark, None, D27, n)
    before = np.array([r.f for r in flow.orderBy("x", "y", "z").collect()]).reshape(n, n, n, 27)
    wanted = np.stack([np.roll(before[..., i], e, (0, 1, 2)) for i, e in enumerate(D27.directions)], axis=-1)
    out = lbm.streamed(flow, D27, n, tile=tile).orderBy("x", "y", "z").collect()
    assert np.array_equal(np.array([r.f for r in out]).reshape(wanted.shape), wanted)
    assert np.array_equal(np.array([r.f_pre for r in out]).reshape(wanted.shape), before)


def test_streaming_refuses_a_grid_with_holes(spark):
    with pytest.raises(Exception, match="each cell of a grid once"):
        lbm.streamed(fx.flow(spark, None, D27).where(F.col("x") + F.col("y") + F.col("z") > 0), D27, fx.N).collect()


def test_two_steps_write_one_state(spark, monkeypatch):
    """The last state was written too, although nothing reads it again."""
    written = []
    monkeypatch.setattr(lbm, "materialized", lambda df, name: written.append(name) or df)
    flow = fx.flow(spark, None, D27).drop("cell")
    last, steps = lbm.run(flow, lambda s: lbm.plain_step(s, D27, fx.N, 1 / 0.6), 2)
    assert (steps, written, last.count()) == (2, ["lbm-step"], fx.N**3)


def test_halves_are_rounded_by_batches_of_lists(spark):
    """One call rounded one list; lists of any lengths, in one column."""
    rows = spark.createDataFrame([(k, [0.1 * k, -1e-9, 70000.0][: 1 + k % 3]) for k in range(20)], "k int, v array<double>")
    assert "ArrowEvalPython" in plan(rows.select(lbm.as_half("v"))) and lbm.as_half.evalType == 250
    for row in rows.select("v", lbm.as_half("v").alias("h")).collect():
        assert row.h == [float(np.float16(x)) for x in row.v]


def test_large_eddies_read_one_gradient(spark):
    """Gradients of u were taken three times."""
    found = plan(lbm.les_step(fx.flow(spark, None, D27), D27, fx.N, 0.02, adaptive=False))
    assert sum("lead(ux#" in line for line in found.splitlines() if "Window [" in line) == 3
