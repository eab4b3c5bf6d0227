"""Exact top-k by inner product with a pivot-distance index.

Vectors get one more coordinate that makes all norms equal, so the largest inner product is the smallest
distance. Each vector is keyed by its nearest pivot and its distance from it; sorted by that key, short runs of
vectors are annuli around the pivots. For a query at distance d of a pivot, the annulus from r0 to r1 holds nothing
nearer than max(r0 - d, d - r1) by the triangle inequality, which bounds the score in it. Queries start from the best
scores in their own annulus and visit other annuli from the best bound on, until the bound is below their k-th score.
Work moves in blocks of queries and annuli; rows beyond the smallest ids of equal vectors can't be among the first k
and are left out of the annuli.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import if_small, scratch, written

#: Vectors of an annulus, queries of a block, annuli described by one row of the directory.
ANNULUS, QUERIES, DIRECTORY = 512, 2_048, 2_048
#: Vectors on which pivots are chosen: those with the smallest hash of vec_id.
PIVOT_SAMPLE, PIVOTS = 4_096, 48
#: Tasks among which the annuli of a query block are dealt.
SPREAD = 16
#: Numbers of annuli in one range partition.
PART = 1_000_000_000
#: Below every score; its negative is an integer too.
LOWEST = -(1 << 62)


def scaled(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null if there is none or one isn't finite.

    Components beyond 64 bits are the nearest integer of 64 bits.
    """
    wide = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    ok = embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, wide)


def products(a: np.ndarray, b: np.ndarray, top: float) -> np.ndarray:
    """Integer inner products of all rows of a and b, whose squared norms are at most ``top``.

    They are exact below 2^64, in the narrowest floating numbers that hold them, and beyond rounded and held in 64 bits.
    """
    if top < 2.0**52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    most = np.longdouble((1 << 63) - 1)
    return np.clip(a.astype(np.longdouble) @ b.T.astype(np.longdouble), -most, most).astype(np.int64)


def slack(top: float) -> float:
    """What rounding may add to a distance when squared norms are ``top``."""
    return 1e-6 + 1e-9 * top**0.5


def choose_pivots(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from the points that lie farthest from those chosen before."""
    centres = [sample[0]]
    far = ((sample - centres[0]) ** 2).sum(1)
    while len(centres) < min(k, len(sample)) and far.max() > 0:
        centres.append(sample[int(far.argmax())])
        far = np.minimum(far, ((sample - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        own = ((sample**2).sum(1)[:, None] - 2 * sample @ c.T + (c**2).sum(1)).argmin(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = sample[own == j].mean(0)
    return c


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """With the coordinate that makes every squared norm ``top``."""
    return np.hstack([v, np.sqrt(np.maximum(top - (v**2).sum(1), 0))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1), 0))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((ids, -scores))[:k]
    return ids[o], scores[o]


def top_k(vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """For each row where ``query`` holds: query_id, rank, vec_id, score of its k best other rows.

    Scores are integer inner products, ties go to the smaller id, and fewer rows than k give fewer results. Rows
    without id, with a null vector, or with a null or non-finite component take no part. What a vector lacks to the
    length of the longest is zero. Equal vectors are different rows; rows that repeat an id count once, with the first
    of their vectors in order. Scores beyond 64 bits are held at the nearest integer that fits. No rows give no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), query.alias("is_query"), scaled(F.col(vector_col)).alias("v")).where("vec_id is not null and v is not null")
    longest, most = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).head()
    if longest is None:
        return spark.createDataFrame([], result)
    kind, stored = ("int", "<i4") if most < 2.0**31 - 1 else ("long", "<i8")
    same_length = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("v"))).cast(f"array<{kind}>")
    # equal vectors: k + 1 smallest ids each, found in two steps so that no task ranks a large group alone
    rows = rows.select("vec_id", "is_query", same_length.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
    rows = rows.withColumn("same", F.sha2(F.array_join(F.col("v").cast("array<string>"), ",").cast("binary"), 256))
    rows = written(rows, "topk-rows")
    spread = W.partitionBy("same", F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    some = rows.withColumn("_n", F.row_number().over(spread)).where(F.col("_n") <= k + 1)
    some = some.withColumn("_n", F.row_number().over(W.partitionBy("same").orderBy("vec_id"))).withColumn("listed", F.col("_n") <= k + 1).select("vec_id", "listed")
    listed = some.where("listed").select("vec_id", F.lit(True).alias("listed"))
    rows = written(rows.join(listed, "vec_id", "left").where("listed or is_query").select("vec_id", "is_query", F.coalesce("listed", F.lit(False)).alias("listed"), "v"), "topk-listed")

    top = float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).head()[0])
    sample = np.array([r["v"] for r in rows.where("listed").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").collect()], dtype=float)
    centres = choose_pivots(lifted(sample, top), pivots)
    shared = spark.sparkContext.broadcast((centres, top))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t = shared.value
        for b in batches:
            if b.num_rows:
                v = np.stack(b.column(3).to_numpy(zero_copy_only=False)).astype(float)
                d = distances(lifted(v, t), c)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "is_query", "listed", "v", "pivot", "far"])

    key = rows.select("vec_id", "is_query", "listed", "v").mapInArrow(keyed, f"vec_id long, is_query boolean, listed boolean, v array<{kind}>, pivot int, far double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = key.repartitionByRange(parts, "pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id")

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def close(b: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number
            v = np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(np.int64)
            ids, is_query, listed, far = (b.column(n).to_numpy(zero_copy_only=False) for n in ("vec_id", "is_query", "listed", "far"))
            li = np.flatnonzero(listed)
            qi = np.flatnonzero(is_query)
            # the k-th best score of each query in its own annulus, where to start from
            floor = np.full(len(qi), LOWEST)
            if len(li) > k:
                s = products(v[qi], v[li], top)
                s[ids[qi][:, None] == ids[li][None, :]] = LOWEST
                floor = -np.partition(-s, k - 1, axis=1)[:, k - 1] if len(qi) else floor
            number += 1
            name = part * PART + number
            out = {"annulus": [name], "pivot": [int(b.column("pivot")[0].as_py())], "low": [float(far.min())], "high": [float(far.max())], "n": [len(li)], "ids": [ids[li].astype("<i8").tobytes()], "vectors": [v[li].astype(stored).tobytes()], "queries": [ids[qi].astype("<i8").tobytes()], "asked": [v[qi].astype(stored).tobytes()], "floor": [floor.astype("<i8").tobytes()]}
            return pa.RecordBatch.from_pydict(out, schema=shape)

        shape = pa.schema([("annulus", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("queries", pa.binary()), ("asked", pa.binary()), ("floor", pa.binary())])
        count = 0
        last = None
        for b in batches:
            low = 0
            pivot = b.column("pivot").to_numpy()
            for i in range(b.num_rows):
                if count and (count >= ANNULUS or pivot[i] != last):
                    held.append(b.slice(low, i - low))
                    yield close(_joined(held))
                    held, low, count = [], i, 0
                last = pivot[i]
                count += 1
            held.append(b.slice(low))
        if count:
            yield close(_joined(held))

    index_path = scratch(spark, "topk-index")
    ordered.mapInArrow(annuli, "annulus long, pivot int, low double, high double, n int, ids binary, vectors binary, queries binary, asked binary, floor binary").write.parquet(index_path)
    index = spark.read.parquet(index_path)

    # the directory in rows of many annuli, and queries in blocks; every block looks through every directory row
    directory = index.select("annulus", "pivot", "low", "high", "n").where("n > 0")
    pages = directory.groupBy(F.floor(F.pmod(F.xxhash64("annulus"), F.lit(max(1, -(-directory.count() // DIRECTORY))))).cast("int").alias("page")).agg(F.collect_list(F.struct("annulus", "pivot", "low", "high")).alias("entries"))
    pages = written(pages, "topk-directory")
    n_pages = max(1, pages.agg(F.max("page")).head()[0] or 0) + 1
    asking = query_blocks(index)
    visits = asking.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)))).join(pages, "page")
    width = longest

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t = shared.value
        for b in batches:
            for r in b.to_pylist():
                asked = np.frombuffer(r["asked"], stored).reshape(-1, width).astype(float)
                floor = np.frombuffer(r["floor"], "<i8")
                norm = (asked**2).sum(1)
                q = np.hstack([asked, np.zeros((len(asked), 1))])
                d = distances(q, c)
                e = r["entries"]
                pivot = np.array([x["pivot"] for x in e])
                low, high = np.array([x["low"] for x in e]), np.array([x["high"] for x in e])
                gap = np.maximum(np.maximum(low[None] - d[:, pivot], d[:, pivot] - high[None]), 0)
                # a query is as far from a vector as the lifted norms and their product say; 1 covers rounding
                bound = (norm[:, None] + t - np.maximum(gap - slack(t), 0) ** 2) / 2 + 1 + 1e-9 * t
                some = np.flatnonzero((bound >= floor[:, None]).any(0))
                most = np.where(bound >= floor[:, None], bound, -np.inf).max(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), r["block"])), pa.array(np.array([x["annulus"] for x in e], dtype=np.int64)[some]), pa.array(most[some])], ["block", "annulus", "bound"])

    wanted = visits.select("block", "asked", "floor", "entries").mapInArrow(bounds, "block long, annulus long, bound double")
    # a block's queries go once to each of the tasks that its annuli are dealt to, ahead of them; annuli come best first
    asks = asking.select("block", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"), F.lit(float("inf")).alias("bound"), *[F.lit(None).cast(t).alias(c) for c, t in (("pivot", "int"), ("low", "double"), ("high", "double"), ("ids", "binary"), ("vectors", "binary"))], "queries", "asked", "floor")
    held = wanted.join(index.select("annulus", "pivot", "low", "high", "ids", "vectors"), "annulus")
    held = held.select("block", F.pmod("annulus", F.lit(SPREAD)).cast("int").alias("part"), "bound", "pivot", "low", "high", "ids", "vectors", *[F.lit(None).cast("binary").alias(c) for c in ("queries", "asked", "floor")])
    work = asks.union(held).repartition(parts, "block", "part").sortWithinPartitions("block", "part", F.col("bound").desc())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t = shared.value
        found, floor, ids, asked, d, norm = None, None, None, None, None, None

        def out() -> pa.RecordBatch:
            q = [np.full(len(f[0]), i) for i, f in zip(ids, found, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(q).astype(np.int64)), pa.array(np.concatenate([f[0] for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))], ["query_id", "vec_id", "score"])

        none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        for b in batches:
            for r in b.to_pylist():
                if r["asked"] is not None:
                    if found is not None:
                        yield out()
                    ids = np.frombuffer(r["queries"], "<i8")
                    asked, floor = np.frombuffer(r["asked"], stored).reshape(-1, width), np.frombuffer(r["floor"], "<i8").copy()
                    found = [none] * len(ids)
                    norm = (asked.astype(float) ** 2).sum(1)
                    d = distances(np.hstack([asked.astype(float), np.zeros((len(asked), 1))]), c)
                    continue
                gap = np.maximum(np.maximum(r["low"] - d[:, r["pivot"]], d[:, r["pivot"]] - r["high"]), 0)
                go = np.flatnonzero((norm + t - np.maximum(gap - slack(t), 0) ** 2) / 2 + 1 + 1e-9 * t >= floor)
                if not len(go):
                    continue
                there, v = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], stored).reshape(-1, width)
                for i, s in zip(go, products(asked[go], v, t), strict=True):
                    keep = (s >= floor[i]) & (there != ids[i])
                    if keep.any():
                        found[i] = best(np.concatenate([found[i][0], there[keep]]), np.concatenate([found[i][1], s[keep]]), k)
                        if len(found[i][1]) == k:
                            floor[i] = max(floor[i], found[i][1][-1])
        if found is not None:
            yield out()

    hits = work.drop("part").mapInArrow(search, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query_blocks(index: DataFrame) -> DataFrame:
    """(block, queries, asked, floor): the queries of annuli that follow each other, about ``QUERIES`` in a block.

    Every annulus that a block has to visit is sent to it once, so few large blocks move less than one for each annulus.
    Places are running sums over the range partitions and then over the annuli inside each.
    """
    own = index.where(F.octet_length("queries") > 0).select("annulus", F.floor(F.col("annulus") / PART).alias("part"), (F.octet_length("queries") / 8).cast("long").alias("n"), "queries", "asked", "floor")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = own.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", before(W.orderBy("part")).alias("base"))
    own = own.withColumn("inside", before(W.partitionBy("part").orderBy("annulus"))).join(if_small(parts), "part")
    rows = own.groupBy(F.floor((F.col("base") + F.col("inside")) / QUERIES).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct("annulus", "queries", "asked", "floor"))).alias("x"))
    whole = lambda name: F.reduce(F.transform("x", lambda r: r[name]), F.lit(b""), lambda a, b: F.concat(a, b)).alias(name)
    return written(rows.select("block", whole("queries"), whole("asked"), whole("floor")), "topk-asked")


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def sql(k: int = 5, every: int = 50) -> str:
    """Brute force in SQL, for small tables."""
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}
"""
