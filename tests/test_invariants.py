"""Operators without SQL against numpy, and files that are written and found again."""

import numpy as np
from pyspark.sql import functions as F

from aerolith.operators import mesh, viz
from aerolith.plans import fixtures as fx
from aerolith.sources import stl


def trilinear(field, p):
    n = field.shape[0]
    p = np.clip(p, 0, n - 1.001)
    low = np.floor(p).astype(int)
    part = p - low
    out = 0.0
    for i in range(8):
        d = np.array([i >> 2 & 1, i >> 1 & 1, i & 1])
        at = np.minimum(low + d, n - 1)
        out = out + np.prod(np.where(d == 1, part, 1 - part)) * field[tuple(at)]
    return out


def test_streamlines_equal_numpy(spark):
    flow = fx.smooth(spark).withColumn("ux", F.lit(1.0)).select("sim_id", "x", "y", "z", "ux", "uy", "uz")
    field = np.zeros((fx.N, fx.N, fx.N, 3))
    for r in flow.collect():
        field[r["x"], r["y"], r["z"]] = r["ux"], r["uy"], r["uz"]
    seeds = viz.seeds(spark, fx.N, 4)
    wanted, dt = {}, 0.5
    for r in seeds.collect():
        p = np.array([r["px"], r["py"], r["pz"]])
        line = [p]
        for _ in range(3):
            k1 = trilinear(field, p)
            k2 = trilinear(field, p + 0.5 * dt * k1)
            k3 = trilinear(field, p + 0.5 * dt * k2)
            k4 = trilinear(field, p + dt * k3)
            p = p + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
            if (p < 0).any() or (p >= fx.N - 1).any() or np.linalg.norm(trilinear(field, p)) < 1e-6:
                break
            line.append(p)
        if len(line) > 1:
            wanted[r["seed_id"]] = line
    got = viz.streamlines(flow, seeds, fx.N, length=3, least=1).collect()
    assert len(got) == sum(map(len, wanted.values()))
    for r in got:
        assert np.allclose([r["px"], r["py"], r["pz"]], wanted[r["seed_id"]][r["step"]])


def test_level_surface_of_a_block_encloses_it(spark):
    # a block of two cells a side inside the grid: its surface lies half a cell outside the corner cells' centres
    block = fx.voxels(spark).where("design_id = 1").withColumn("p", ((F.col("x").between(3, 4)) & (F.col("y").between(3, 4)) & (F.col("z").between(3, 4))).cast("double"))
    out = mesh.signed_volume(mesh.level_surface(block, fx.N)).head()
    assert out["triangles"] > 0 and 1.0 < abs(out["volume"]) < 8.0 and 6.0 < out["area"] < 24.0


def test_scan_finds_files_by_name(spark, tmp_path):
    for r in stl.from_voxels(fx.voxels(spark)).collect():
        (tmp_path / f"design-{r['design_id']}.stl").write_bytes(r["data"])
    (tmp_path / "notes.txt").write_text("no mesh")
    files = stl.scan(spark, str(tmp_path), "*.stl")
    assert [r["path"].rsplit("/", 1)[1] for r in files.select("path").collect()] == [f"design-{k}.stl" for k in range(3)]
    triangles = stl.read_stl(files).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["path"]: r["length"] for r in files.select("path", "length").collect()}
    assert all(sizes[r["path"]] == 84 + 50 * r["n"] for r in triangles.collect())


def test_voxelised_ball_is_filled(spark):
    # an octahedron of radius 4 round (5, 5, 5): cells well inside are filled, cells well outside are not
    c = np.array([5.0, 5.0, 5.0])
    tips = [c + 4 * np.array(v) for v in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    faces = [(tips[a], tips[b], tips[k]) for a in (0, 1) for b in (2, 3) for k in (4, 5)]
    rows = [(0, t, *map(float, np.concatenate(f))) for t, f in enumerate(faces)]
    df = spark.createDataFrame(rows, "design_id long, t int, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz"))
    got = {(r["x"], r["y"], r["z"]) for r in mesh.voxelised(df, 1.0).collect()}
    for x in range(11):
        for y in range(11):
            for z in range(11):
                far = np.abs(np.array([x, y, z]) - c).sum()
                assert (x, y, z) in got if far <= 3 else (x, y, z) not in got or far <= 5.5
