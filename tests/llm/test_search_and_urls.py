"""Top-k search and url filters against brute force, with odd rows."""

import numpy as np
from pyspark.sql import functions as F

from aerolith.llm import topk_search, url_filter
from tests.compare import spark_rows


def brute_top_k(rows, is_query, k=5):
    wide = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            wide[i] = np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64)
    longest = max(map(len, wide.values()), default=0)
    wide = {i: [int(x) for x in v] + [0] * (longest - len(v)) for i, v in wide.items()}
    out = []
    for q, v in wide.items():
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in wide.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_equals_brute_force_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(900)]
    rows += [(900 + i, rows[3][1]) for i in range(300)]  # a large group of equal vectors
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2050, [float("nan")] * 8), (2100, [float("inf")] * 8), (2150, [0.0] * 8), (2200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_top_k(rows, lambda q: q % 50 == 0)


def test_top_k_of_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_top_k(rows, lambda q: q % 50 == 0)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk_search.top_k(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_vectors_of_many_lengths_and_sizes(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [1.0])] + [(i, rng.normal(size=3).astype(float).tolist()) for i in range(1, 120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_top_k(rows, lambda q: q % 50 == 0) and len(got) == 15
    large = rows[1:] + [(200, [1e6, 2.0, 3.0]), (201, [-1e6, 1.0, 0.0]), (250, [1e6, 0.5, -1e6])]
    df = spark.createDataFrame(large, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_top_k(large, lambda q: q % 50 == 0)
    huge = [*rows, (300, [1e9, 0.0, 0.0]), (301, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<float>")
    got = topk_search.top_k(df, F.col("vec_id") == 300).orderBy("rank").collect()
    assert got[0]["vec_id"] == 301 and got[0]["score"] == 2**63 - 1 and len(got) == 5


def test_top_k_of_ids_that_repeat_is_the_same_each_time(spark):
    rows = [(i % 40, [float(i), 1.0]) for i in range(120)]
    first = [(i, [float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    assert sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") == 0).collect())) == brute_top_k(first, lambda q: q == 0)


PAGES = [
    (1, "http://WWW.Example.NET/en/a?x#y", "<a href='http://good.com/'>"),
    (2, "https://a.example.net/de/", "<a href=//bad.com/x>"),
    (3, "http://example.com/de/page", None),
    (4, "http://example.com/fr/", "<a href=\"http://bad.net/\">"),
    (5, "ftp://x.org/fr/", "<a href='http://good.com'>"),
    (6, "http://notexample.net", ""),
    (7, "http://bad.net/?q", "<a href='http://mid.com/'>"),
    (8, "http://mid.com/p", "<img src='http://bad.net/i.png'><a href='http://bad.net/j'>"),
    (9, "no scheme", "<a href='http://mid.com/'>"),
    (10, None, None),
    (11, "://", "x"),
    (12, "http://good.com#f://x/en/", ""),
    (12, "http://good.com#f://x/en/", ""),
    (None, "http://x.net/", None),
    (13, "http://h?u/en/", ""),
]


def test_rules_and_hosts(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("trust", F.lit("x"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(df).collect()}
    assert got[1] == ("www.example.net", "/en/a", "example.net/en/", "allow")
    assert got[2] == ("a.example.net", "/de/", "net/", "block")
    assert got[3] == ("example.com", "/de/page", "example.com/de/", "block")
    assert got[4][2] is None
    assert got[5] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[6] == ("notexample.net", "", None, got[6][3])  # the path is empty, so it doesn't start with /
    assert got[8][3] == "block"  # it links to a blocked host only
    assert got[9] == got[10] == ("", "", None, "allow")
    assert got[12][:3] == ("good.com", "", None) and got[12][3] == "allow"
    assert got[13][:2] == ("h", "")
    assert url_filter.judged(df.limit(0)).count() == 0
    assert url_filter.judged(df).count() == len(PAGES)


def test_rank_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 12
    w = rng.integers(0, 3, (n, n)) * (1 - np.eye(n, dtype=int))
    edges = spark.createDataFrame([(str(i), str(j), float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "a string, b string, weight double")
    seeds = spark.createDataFrame([("0", 2.0), ("5", 1.0)], "host string, weight double")
    start = np.zeros(n)
    start[0], start[5] = 2 / 3, 1 / 3
    x = start
    for _ in range(10):
        share = w / np.maximum(w.sum(1, keepdims=True), 1)
        x = 0.85 * x @ share + 0.15 * start
    got = {r["host"]: r["score"] for r in url_filter.personalised_rank(edges, seeds).collect()}
    assert all(abs(got.get(str(i), 0.0) - x[i]) < 1e-12 for i in range(n))
