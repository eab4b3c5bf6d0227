"""Approximate search against brute force: scores are exact, and recall is high, with copies, ties and odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from aerolith.llm import graph_search
from aerolith.llm.queries import QUERIES

SHAPE = "vec_id long, embedding array<float>"


def dot(v, w):
    """Summed from the first to the last; the built-in sum corrects its rounding."""
    s = 0.0
    for a, b in zip(v, w, strict=True):
        s += float(a) * float(b)
    return s


def brute(rows, every, k):
    """Answers of each query row: lists of (score, vec_id), nearest first."""
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for n, (q, v) in enumerate(good):
        if q % every == 0:
            s = [(-dot(v, w), i) for m, (i, w) in enumerate(good) if m != n]
            out.append((q, [(-a, i) for a, i in sorted(s)[:k]]))
    return out


def answers(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(a) for q, a in got.items()}


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, SHAPE).repartition(4).withColumns({c: F.lit("clash") for c in ("h", "v", "shard", "score", "rank", "ids")})
    got = answers(graph_search.nearest(df, F.col("vec_id") % 20 == 0))
    table, hits = dict(rows), 0
    wanted = brute(rows, 20, 20)
    assert sorted(got) == [q for q, _ in wanted]
    for q, best in wanted:
        mine = got[q]
        assert [r for r, _, _ in mine] == list(range(1, 21)) and len({i for _, i, _ in mine}) == 20 and q not in {i for _, i, _ in mine}
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        for _, i, s in mine:
            assert s == dot(table[q], table[i])
        hits += len({i for _, i, _ in mine} & {i for _, i in best})
    assert hits >= 0.95 * 20 * len(wanted)


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(90)]  # equal vectors, some of them queries
    rows += [(400, None), (420, []), (440, [0.0] * 4), (460, [1.0, None, 0.0, 0.0]), (480, [float("nan")] * 4), (500, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (520, [1.0]), (540, [2e18, -1e18, 0.0, 1.0]), (0, rows[0][1]), (7, rows[9][1])]
    df = spark.createDataFrame(rows, SHAPE)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in graph_search.nearest(df, F.col("vec_id") % 20 == 0).collect())
    wanted = sorted((q, r, i, s) for q, best in brute(rows, 20, 20) for r, (s, i) in enumerate(best, 1))
    assert got == wanted


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], SHAPE)
    query = F.col("vec_id") % 20 == 0
    assert [tuple(r) for r in graph_search.nearest(df, query).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert graph_search.nearest(df.where("vec_id = 0"), query).count() == 0
    assert graph_search.nearest(df.where("vec_id > 0"), query).count() == 0
    assert graph_search.nearest(df.limit(0), query).count() == 0
    assert graph_search.nearest(df.where("vec_id = 0").withColumn("embedding", F.lit(None).cast("array<float>")), query).count() == 0


def test_query_over_its_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = answers(QUERIES["op13_graph_search"](spark, folder))
    wanted = brute(rows, 20, 20)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in best}) for q, best in wanted)
    assert len(got) == len(wanted) and hits >= 0.9 * sum(len(b) for _, b in wanted)
