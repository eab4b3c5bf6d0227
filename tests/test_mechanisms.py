"""Networks, tiles, streams with state, mesh files, scans, selection and surfaces against plain versions, with odd rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import blocks, mesh, networks, surface, telemetry, tiles, viz
from aerolith.plans import fixtures as fx
from aerolith.plans import network_plans
from aerolith.sources import meshes
from aerolith.streaming import metrics


def weights_of(rows):
    """Matrices by layer, the bias as the last row."""
    out = {}
    for r in rows:
        out.setdefault(r["layer"], {})[r["row"], r["col"]] = r["value"]
    return {k: np.array([[v[i, j] for j in range(max(c for _, c in v) + 1)] for i in range(max(r for r, _ in v) + 1)]) for k, v in out.items()}


def plain_recurrent(x, edges, w, levels, heads):
    """The recurrent network over one graph in numpy."""
    line = lambda h, name: h @ w[name][:-1] + w[name][-1]
    norm = lambda h, name: (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5) * w[name][0] + w[name][1]
    h = line(x, "input")
    n, size = h.shape
    per = size // heads
    loops = [(s, d) for s, d in edges if s != d] + [(i, i) for i in range(n)]
    for k in range(levels):
        m = line(h, f"level{k}_attention")
        score = lambda end, i, a: m[i, a * per : a * per + per] @ w[f"level{k}_attention_{end}"][a * per : a * per + per, 0]  # noqa: B023, E731
        seen = np.zeros_like(h)
        for d in range(n):
            for a in range(heads):
                into = [s for s, t in loops if t == d]
                raw = np.array([score("source", s, a) + score("target", d, a) for s in into])
                raw = np.where(raw > 0, raw, 0.2 * raw)
                e = np.exp(raw - raw.max())
                seen[d, a * per : a * per + per] = (e / e.sum()) @ m[into, a * per : a * per + per]
        h = norm(h + seen + w[f"level{k}_attention_bias"][0], f"level{k}_norm1")
        near = np.zeros_like(h)
        for s, d in edges:
            near[d] += h[s]
        h = norm(line(near, f"level{k}_neighbours") + line(h, f"level{k}_itself") + h, f"level{k}_norm2")
        h = h + line(np.maximum(line(h, f"level{k}_widened"), 0), f"level{k}_narrowed")
    return line(np.maximum(line(h.mean(0, keepdims=True), "read"), 0), "output")[0]


def test_recurrent_network_with_a_hub_a_lone_node_and_no_edges(spark):
    rng = np.random.default_rng(1)
    shapes = network_plans.recurrent_shapes(3, 4, 2)
    table = networks.formula_weights(spark, shapes)
    w = weights_of(table.collect())
    graphs = {1: (60, [(i, 0) for i in range(1, 59)] + [(0, 5), (5, 5), (7, 8), (7, 8)]), 2: (3, [])}
    x = {g: rng.normal(size=(n, 3)) for g, (n, _) in graphs.items()}
    node = spark.createDataFrame([(g, i, x[g][i].tolist()) for g, (n, _) in graphs.items() for i in range(n)], "design_id long, v int, feat array<double>")
    edge = spark.createDataFrame([(g, s, d) for g, (_, e) in graphs.items() for s, d in e], "design_id long, src int, dst int")
    got = {r["design_id"]: r["out"] for r in networks.recurrent_network(node, edge, table, 4, 2, 2).collect()}
    for g, (_, e) in graphs.items():
        assert np.allclose(got[g], plain_recurrent(x[g], e, w, 2, 2))


def test_models_that_are_too_large_are_refused(spark, monkeypatch):
    monkeypatch.setattr(networks, "MOST_WEIGHTS", 5)
    with pytest.raises(ValueError, match="too many"):
        networks.model_row(networks.formula_weights(spark, {"a": (3, 3)}))


def test_convolution_over_ragged_tiles_equals_numpy(spark):
    rng = np.random.default_rng(2)
    n, inputs, outputs = 5, 2, 3
    field, w = rng.normal(size=(2, n, n, n, inputs)), rng.normal(size=(inputs * 27 + 1, outputs))
    rows = [(str(g), x, y, z, field[g, x, y, z].tolist()) for g in range(2) for x in range(n) for y in range(n) for z in range(n)]
    cell = spark.createDataFrame(rows, "id string, x int, y int, z int, feat array<double>")
    got = tiles.neighbours_summed(cell, w, "id", side=2).collect()
    assert len(got) == len(rows)
    padded, k = np.pad(field, ((0, 0), (1, 1), (1, 1), (1, 1), (0, 0))), w[:-1].reshape(inputs, 3, 3, 3, outputs)
    for r in got:
        g, x, y, z = int(r["id"]), r["x"], r["y"], r["z"]
        wanted = np.einsum("xyzc,cxyzo->o", padded[g, x : x + 3, y : y + 3, z : z + 3], k) + w[-1]
        assert np.allclose(r["feat"], wanted)


def test_pyramid_rolls_up_every_level(spark):
    rows = [(1, x, y, z, float(x + 10 * y + 100 * z)) for x in range(8) for y in range(8) for z in range(8)]
    cell = spark.createDataFrame(rows, "design_id long, x int, y int, z int, p double")
    got = {(r["level"], r["at"]): (r["cells"], r["mean"]) for r in tiles.pyramid(cell, "p", 3, inner=1).collect()}
    assert len(got) == 512 + 64 + 8 + 1
    assert got[3, 0] == (512, 3.5 * 111) and got[2, 4] == (64, 5.5 + 15 + 150) and got[0, 7] == (1, 111.0)


def test_a_buffer_drops_late_rows_and_forgets_idle_keys(spark, tmp_path):
    def feed(rows):
        df = spark.createDataFrame(rows, "user_id long, ts string, id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.select("user_id", F.lit("x").alias("event_type"), "ts", "id", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")

    def run():
        stream = metrics.metric_stream(spark, f"file://{tmp_path}/feed", "user_id long, event_type string, ts timestamp, id long, value double")
        out = metrics.run_on(metrics.replayed(stream, "user_id", 2, late="10 minutes", idle=3600.0), f"file://{tmp_path}/at", "update")
        return sorted(((r["batch"], r["user_id"], r["kept"], r["oldest"], r["newest"], r["mean"]) for r in out.collect()), key=repr)

    feed([(1, "2024-01-01 00:00:00", 1, 1.0), (1, "2024-01-01 00:01:00", 2, 2.0), (1, "2024-01-01 00:02:00", 3, 6.0), (2, "2024-01-01 00:00:00", 4, 5.0)])
    assert run() == [(0, 1, 2, 2, 3, 4.0), (0, 2, 1, 4, 4, 5.0)]
    feed([(2, "2024-01-01 05:00:00", 5, 7.0)])
    run()
    feed([(2, "2023-12-31 00:00:00", 6, 9.0), (2, "2024-01-01 05:01:00", 7, 9.0)])  # the first of these is late
    got = run()
    assert (1, None) not in [(k, i) for _, k, _, i, _, _ in got[:2]]
    last = {}
    for row in got:
        last[row[1]] = row[2:]
    assert last[1] == (0, None, None, None)  # forgotten by its timer
    assert last[2] in ((2, 5, 7, 8.0), (1, 7, 7, 9.0))  # without the late row


def test_mesh_files_keep_what_is_committed(spark, tmp_path):
    at = f"file://{tmp_path}/m"
    box = mesh.box_surface(spark.createDataFrame([(1, 2.0, 3.0, 4.0), (5, 1.0, 1.0, 1.0)], "design_id long, sx double, sy double, sz double"))
    meshes.write_meshes(box, at)
    meshes.write_meshes(box.where("design_id = 5").withColumn("design_id", F.lit(9).cast("long")), at)
    (tmp_path / "m" / "segment-of-a-lost-task.bin").write_bytes(b"\0" * 50)
    rows = meshes.read_meshes(spark, at, records=5).orderBy("design_id", "t").collect()
    assert [(r["design_id"], r["t"]) for r in rows] == [(k, t) for k in (1, 5, 9) for t in range(12)]
    wanted = box.orderBy("design_id", "t").collect()
    assert all(r[c] == w[c] for r, w in zip(rows, wanted, strict=False) for c in ("ax", "by", "cz"))
    meshes.write_meshes(box.where("design_id = 1"), at, "overwrite")
    assert meshes.read_meshes(spark, at).select("design_id").distinct().count() == 1
    kept = [s["name"] for e in json.loads((tmp_path / "m" / meshes.MANIFEST).read_text()) for s in e["segments"]]
    assert sorted(p.name for p in (tmp_path / "m").glob("*.bin") if "lost" not in p.name) == sorted(kept)
    meshes.write_meshes(box.limit(0), f"file://{tmp_path}/none")
    assert meshes.read_meshes(spark, f"file://{tmp_path}/none").count() == 0


def test_a_failed_write_leaves_nothing_and_a_torn_file_is_an_error(spark, tmp_path):
    at = tmp_path / "m"
    bad = mesh.box_surface(spark.createDataFrame([(1, 1.0, 1.0, 1.0)], "design_id long, sx double, sy double, sz double")).withColumn("ax", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        meshes.write_meshes(bad, f"file://{at}")
    assert not (at / meshes.MANIFEST).exists()
    at.mkdir(exist_ok=True)
    (at / "a.stl").write_bytes(b"\0" * 80 + (3).to_bytes(4, "little") + b"\0" * 50)
    with pytest.raises(Exception, match="fewer triangles"):
        meshes.read_meshes(spark, f"file://{at}").count()


def test_selection_of_odd_values_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(viz, "SORTED", 4)
    rng = np.random.default_rng(4)
    inf, nan = float("inf"), float("nan")
    groups = {"a": rng.normal(size=300).tolist(), "b": [1.0] * 50, "c": [1e300, -1e300, 1e-300, 0.0, 5e-324, 7.0, 7.0, 8.0], "d": [inf, -inf, nan, nan, 3.0, inf], None: [2.0, 1.0], "e": [5.0], "f": [nan] * 9}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("g", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    places = {"low": lambda n: F.floor(n * 0.1), "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}
    got = {r["k"]: (r["_n"], r["low"], r["mid"], r["top"]) for r in viz.selected(df, "v", ("k",), places, buckets=3).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s = sorted(vs, key=lambda v: (math.isnan(v), v))
        wanted = (len(s), s[int(len(s) * 0.1)], s[len(s) // 2], s[-1])
        assert repr(tuple(map(float, got[k]))) == repr(tuple(map(float, wanted))), k
    whole = viz.selected(df, "v", (), places, buckets=3).head()
    s = sorted((v for vs in groups.values() for v in vs), key=lambda v: (math.isnan(v), v))
    assert whole["mid"] == s[len(s) // 2]
    assert viz.selected(df.limit(0), "v", ("k",), places).count() == 0


def test_scan_over_long_series_nulls_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [("long", i, float(x)) for i, x in enumerate(rng.normal(size=4000))] + [("nulls", 0, None), ("nulls", 1, 2.0), ("nulls", 2, None), ("one", 0, 1.0), (None, 0, 3.0), (None, 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, i long, p double").repartition(5)
    got = telemetry.affine_scan(df, ("k",), ("i",), F.lit(0.9), F.col("p"), F.lit(10.0), "s").collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"k", "i", "p", "s"}
    state = {}
    for k, i, p in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        s = state.get(k, (0, 10.0))[1]
        state[k] = (i, s if p is None else 0.9 * s + p)
        mine = next(r["s"] for r in got if r["k"] == k and r["i"] == i)
        assert math.isclose(mine, state[k][1], rel_tol=1e-9)
    assert telemetry.affine_scan(df.limit(0), ("k",), ("i",), F.lit(0.9), F.col("p"), F.lit(0.0)).count() == 0


def test_zip_of_tables_of_unequal_length(spark):
    a = spark.createDataFrame([(i % 7, i) for i in range(30)], "x long, y long")
    b = spark.createDataFrame([(9 - i, f"r{i}") for i in range(10)], "x long, z string")
    got = telemetry.zipped(a, b, ("x", "y"), ("x",)).orderBy("place").collect()
    left = sorted((i % 7, i) for i in range(30))[:10]
    assert [(r["place"], r["x"], r["y"], r["right_x"], r["z"]) for r in got] == [(k, *left[k], k, f"r{9 - k}") for k in range(10)]


def ball(n):
    """Triangles of a closed ball of unit radius."""
    out = []
    at = lambda i, j: (math.sin(math.pi * i / n) * math.cos(2 * math.pi * (j % (2 * n)) / (2 * n)), math.sin(math.pi * i / n) * math.sin(2 * math.pi * (j % (2 * n)) / (2 * n)), math.cos(math.pi * i / n))
    index = lambda i, j: 0 if i == 0 else 1 if i == n else 2 + (i - 1) * 2 * n + j % (2 * n)
    places = {index(i, j): at(i, j) if 0 < i < n else (0.0, 0.0, 1.0 if i == 0 else -1.0) for i in range(n + 1) for j in range(2 * n)}
    for i in range(n):
        for j in range(2 * n):
            a, b, c, d = index(i, j), index(i + 1, j), index(i + 1, j + 1), index(i, j + 1)
            out += [t for t in ((a, b, c), (a, c, d)) if len(set(t)) == 3]
    return places, out


def test_curvature_of_a_ball_and_of_a_sheet(spark):
    places, faces = ball(16)
    vertex = spark.createDataFrame([(1, v, *p) for v, p in places.items()], "design_id long, v int, x double, y double, z double")
    face = spark.createDataFrame([(t, *f) for t, f in enumerate(faces)], "t int, a int, b int, c int")
    got = surface.curvature(vertex, face).collect()
    assert not any(r["boundary"] for r in got) and math.isclose(sum(r["area"] for r in got), 4 * math.pi, rel_tol=0.03)
    assert np.median([abs(r["curvature"] - 1) for r in got]) < 0.1
    flat = spark.createDataFrame([(1, i * 3 + j, float(i), float(j), 0.0) for i in range(3) for j in range(3)], "design_id long, v int, x double, y double, z double")
    pairs = [t for i in range(2) for j in range(2) for t in ((i * 3 + j, i * 3 + j + 3, i * 3 + j + 4), (i * 3 + j, i * 3 + j + 4, i * 3 + j + 1))]
    rows = surface.curvature(flat, spark.createDataFrame([(t, *f) for t, f in enumerate(pairs)], "t int, a int, b int, c int")).collect()
    assert {r["v"] for r in rows if not r["boundary"]} == {4} and all(abs(r["curvature"]) < 1e-12 for r in rows)


def test_simplified_surfaces_stay_closed_and_near(spark):
    places, faces = ball(24)
    columns = "design_id long, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz")
    rows = [(g, *[s * q for v in f for q in places[v]]) for g, s in ((1, 1.0), (2, 10.0)) for f in faces]
    small = mesh.box_surface(spark.createDataFrame([(3, 1.0, 2.0, 3.0)], "design_id long, sx double, sy double, sz double")).drop("t")
    triangles = spark.createDataFrame(rows, columns).unionByName(small)
    out = surface.simplified(triangles, 400)
    report = {r["design_id"]: r for r in mesh.signed_volume(out).join(surface.open_edges(out), "design_id").collect()}
    assert report[3]["triangles"] == 12 and all(r["open"] == 0 for r in report.values())
    for g, s in ((1, 1.0), (2, 10.0)):
        assert 60 < report[g]["triangles"] <= 400
        assert math.isclose(abs(report[g]["volume"]), 4 / 3 * math.pi * s**3, rel_tol=0.15)
    for r in out.where("design_id = 1").collect():
        for c in "abc":
            assert abs(math.sqrt(sum(r[f"{c}{x}"] ** 2 for x in "xyz")) - 1) < 2 / 2**3 * math.sqrt(3)


def test_surface_force_of_constant_pressure_vanishes(spark):
    cells = fx.smooth(spark).withColumns({"ux": F.lit(1.0), "uy": F.lit(0.0), "uz": F.lit(0.0), "p": F.lit(2.0)})
    box = mesh.box_surface(spark.createDataFrame([(0, 3.0, 4.0, 5.0)], "sim_id long, sx double, sy double, sz double"), "sim_id")
    r = surface.surface_coefficients(surface.surface_force(box, cells, fx.N, 0.1), 1.0, 1.0, F.lit(0.0)).head()
    assert abs(r["fx"]) < 1e-9 and abs(r["fy"]) < 1e-9 and abs(r["fz"]) < 1e-9 and math.isclose(r["area"], 94.0) and r["cd"] == 0.0


def test_products_of_blocks_equal_numpy(spark):
    rng = np.random.default_rng(8)
    shapes = {"one": (300, 500), "two": (500, 70)}
    table = networks.formula_weights(spark, shapes)
    w = weights_of(table.collect())
    x = rng.normal(size=(45, 300))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = blocks.decoded(vectors, table, [("one", "relu"), ("two", None)], "id", "v", rows=16, side=128).collect()
    wanted = np.maximum(x @ w["one"][:-1] + w["one"][-1], 0) @ w["two"][:-1] + w["two"][-1]
    assert len(got) == 45 * 70 and all(math.isclose(r["value"], wanted[r["id"], r["place"]], rel_tol=1e-9, abs_tol=1e-9) for r in got)
    assert blocks.decoded(vectors.limit(0), table, [("one", "relu"), ("two", None)], "id", "v").count() == 0
