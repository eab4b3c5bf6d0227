"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard, results merged.

Equal vectors are one node, which carries as many of its smallest ids as an answer can hold. Nodes are dealt to shards by
the band of their largest component and their hash, so those of a shard are about as large. They get one more
coordinate that makes all norms of the shard equal, so that the largest inner product is the smallest distance. In a
shard a node's level follows from its hash, and nodes stand in order of falling level, so each layer of the graph is a
prefix of the nodes, and its links are one flat array of as many numbers for each of them. Nodes are linked in steps:
those of a step search the graph so far together, meet each other directly, and keep neighbours that are nearer to them
than to a neighbour kept before. Queries go in blocks to every shard, walk down its layers side by side, and the first
of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mixed_bits, remove_all, written

#: Links of a node in upper layers; twice as many in the lowest.
LINKS = 16
#: Nodes that a search keeps in sight while the graph is built and when it is asked.
BUILD_WIDTH, SEARCH_WIDTH = 64, 64
#: Bytes of vectors and nodes in a shard at most; small tables have fewer nodes in each of ``SHARDS``.
SHARD_BYTES, SHARD_ROWS, SHARDS, SMALL = 1 << 27, 200_000, 16, 256
#: Queries of a block, and blocks that one task takes through a shard.
BLOCK, TASK_BLOCKS = 1_024, 256
#: Nodes times queries whose visits a walk marks at once.
VISITS = 16_000_000
#: Parts in which the rows of equal vectors meet.
SPREAD = 16


def lifted(v: np.ndarray, scale: float, top: float) -> np.ndarray:
    """Vectors divided by ``scale``, with the coordinate that makes every squared norm ``top``."""
    x = v / scale
    return np.hstack([x, np.sqrt(np.maximum(top - (x**2).sum(1), 0))[:, None]]).astype(np.float32)


def walk(x: np.ndarray, links: np.ndarray, asked: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes that queries reach over the links of a layer, all queries side by side.

    ``start`` holds nodes of each query, -1 for none. Nearest come first; -1 and -inf fill what is not found.
    """
    n, q = len(links), len(asked)
    seen = np.zeros((q, n + 1), dtype=bool)
    ids = np.full((q, width), -1, dtype=np.int64)
    near = np.full((q, width), -np.inf, dtype=np.float32)
    done = np.ones((q, width), dtype=bool)

    def take(rows: np.ndarray, new: np.ndarray) -> None:
        new = np.where(seen[rows[:, None], new], -1, new)
        seen[rows[:, None], new] = True
        seen[rows, n] = False
        s = np.einsum("qmd,qd->qm", x[new], asked[rows])
        s[new < 0] = -np.inf
        every, scores = np.hstack([ids[rows], new]), np.hstack([near[rows], s])
        old = np.hstack([done[rows], new < 0])
        best = np.argsort(-scores, axis=1, kind="stable")[:, :width]
        ids[rows], near[rows], done[rows] = (np.take_along_axis(a, best, 1) for a in (every, scores, old))

    take(np.arange(q), start)
    while True:
        rows = np.flatnonzero(~done.all(1))
        if not len(rows):
            return ids, near
        at = (~done[rows]).argmax(1)
        done[rows, at] = True
        take(rows, links[ids[rows, at]].astype(np.int64))


def spread_out(x: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in order of nearness at most ``most`` that are nearer to the node than to one kept before.

    Places that stay free go to the nearest of the others, so that no node is cut off.
    """
    rows, width = ids.shape
    v = x[ids]
    among = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros((rows, width), dtype=bool)
    closest = np.full((rows, width), -np.inf, dtype=np.float32)
    count = np.zeros(rows, dtype=np.int64)
    for c in range(width):
        good = (ids[:, c] >= 0) & (near[:, c] > closest[:, c]) & (count < most)
        kept[:, c] = good
        count += good
        closest = np.where(good[:, None], np.maximum(closest, among[:, :, c]), closest)
    rank = np.where(kept, 0, np.where(ids >= 0, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def meet(x: np.ndarray, links: np.ndarray, low: int, high: int) -> None:
    """Give the nodes that new ones link to a link back, and choose again where there are too many."""
    most = links.shape[1]
    new = np.repeat(np.arange(low, high), most)
    to = links[low:high].ravel().astype(np.int64)
    new, to = new[to >= 0], to[to >= 0]
    touched = np.unique(to)
    old = links[touched].astype(np.int64).ravel()
    a, b = np.concatenate([np.repeat(touched, most), to]), np.concatenate([old, new])
    a, b = a[b >= 0], b[b >= 0]
    pair = np.unique(a * len(x) + b)
    a, b = pair // len(x), pair % len(x)
    s = np.einsum("pd,pd->p", x[a], x[b])
    order = np.lexsort((-s, a))
    a, b, s = a[order], b[order], s[order]
    first = np.searchsorted(a, touched)
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    width = 3 * most
    inside = place < width
    row = np.searchsorted(touched, a)
    ids, near = np.full((len(touched), width), -1, dtype=np.int64), np.full((len(touched), width), -np.inf, dtype=np.float32)
    ids[row[inside], place[inside]], near[row[inside], place[inside]] = b[inside], s[inside]
    for k in range(0, len(touched), BLOCK):
        links[touched[k : k + BLOCK]] = spread_out(x, ids[k : k + BLOCK], near[k : k + BLOCK], most)


def descend(x: np.ndarray, layers: list[np.ndarray], asked: np.ndarray, down_to: int) -> np.ndarray:
    """The node that a greedy walk from the first node reaches in the layers above ``down_to``, for each query."""
    at = np.zeros((len(asked), 1), dtype=np.int64)
    for links in reversed(layers[down_to + 1 :]):
        at = walk(x, links, asked, at, 1)[0]
    return at


def step_size(n: int) -> int:
    return int(np.clip(VISITS // max(n, 1), 16, 512))


def built(x: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Links of every layer, the lowest first, of nodes in order of falling level; -1 stands for no link."""
    n = len(x)
    sizes = [int((levels >= k).sum()) for k in range(int(levels.max(initial=0)) + 1)]
    layers = [np.full((size, LINKS if k else 2 * LINKS), -1, dtype=np.int32) for k, size in enumerate(sizes)]
    low = 0
    while low < n:
        level = int(levels[low])
        high = min(n, low + max(1, min(low, step_size(n))), int(np.searchsorted(-levels, -level, "right")))
        new = x[low:high]
        among = new @ new.T
        np.fill_diagonal(among, -np.inf)
        at = descend(x, [links[:low] for links in layers], new, level) if low else np.full((high - low, 1), -1, dtype=np.int64)
        for k in range(level, -1, -1):
            links = layers[k]
            ids, near = walk(x, links[:low], new, at, BUILD_WIDTH) if low else (np.full((high - low, 1), -1, dtype=np.int64), np.full((high - low, 1), -np.inf, dtype=np.float32))
            at = ids[:, :4]
            mates = np.argsort(-among, axis=1)[:, :BUILD_WIDTH]
            own = np.take_along_axis(among, mates, 1)
            every = np.hstack([ids, np.where(own > -np.inf, mates + low, -1)])
            scores = np.hstack([near, own])
            order = np.argsort(-scores, axis=1, kind="stable")[:, :BUILD_WIDTH]
            links[low:high] = spread_out(x, np.take_along_axis(every, order, 1), np.take_along_axis(scores, order, 1), links.shape[1])
            meet(x, links, low, high)
        low = high
    return layers


def exact(asked: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Inner products of each query with its own rows, summed from the first component to the last in doubles."""
    s = np.zeros(found.shape[:2])
    for j in range(found.shape[2]):
        s += asked[:, None, j] * found[:, :, j]
    return s


def nodes_of(vectors: DataFrame, k: int, id_col: str, vector_col: str, query: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that take part (vec_id, is_query, h, g, v), and nodes (h, g, ids, v) of equal vectors with k + 1 ids."""
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("is_query"), F.transform(vector_col, lambda x: x.cast("double") + 0.0).alias("v"))
    rows = rows.where(ok & F.col("vec_id").isNotNull())
    longest = rows.agg(F.max(F.size("v"))).head()[0] or 0
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))))
    rows = rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), F.col("v"))})
    spread = W.partitionBy("h", "g", F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD))).orderBy("vec_id")
    some = rows.select("h", "g", "vec_id", "v", F.row_number().over(spread).alias("_n")).where(F.col("_n") <= k + 1)
    some = some.withColumn("_n", F.row_number().over(W.partitionBy("h", "g").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    return rows, some.groupBy("h", "g").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))


INDEX = "shard int, size int, top double, scale double, h binary, ids binary, counts binary, vectors binary, layers array<binary>"


def index_of(nodes: DataFrame) -> DataFrame:
    """The graph of each shard as one row of flat arrays, ``INDEX``, from nodes (h, g, ids, v)."""
    nodes = nodes.withColumn("band", F.floor(F.log2(F.array_max(F.transform("v", F.abs))) / 2).cast("int"))
    bands = nodes.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size")).collect()  # a double has 1,050 bands at most
    dealt, base = [], 0
    for band, count, size in sorted(bands):
        rows = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * size)))
        shards = max(min(SHARDS, -(-count // SMALL)), -(-count // rows))
        dealt.append((band, base, shards))
        base += shards
    dealt = nodes.sparkSession.createDataFrame(dealt, "band int, base int, shards int")

    def build(group: pa.Table) -> pa.Table:
        g, h = group["g"].to_numpy(), group["h"].to_numpy()
        chance = (mixed_bits(g.view(np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53
        levels = np.minimum(np.floor(-np.log(np.maximum(chance, 1e-18)) / np.log(LINKS)), 12).astype(np.int64)
        order = np.lexsort((g, h, -levels))
        group = group.take(pa.array(order)).combine_chunks()
        v = group["v"].chunk(0).flatten().to_numpy().reshape(len(order), -1)
        scale = float(np.abs(v).max())
        top = float(((v / scale) ** 2).sum(1).max())
        layers = built(lifted(v, scale, top), levels[order])
        lists = group["ids"].chunk(0)
        row = {"shard": [group["shard"][0].as_py()], "size": [v.shape[1]], "top": [top], "scale": [scale], "h": [h[order].tobytes() + g[order].tobytes()], "ids": [lists.flatten().to_numpy().tobytes()], "counts": [np.diff(lists.offsets.to_numpy()).astype(np.int32).tobytes()], "vectors": [v.tobytes()], "layers": [[links.tobytes() for links in layers]]}
        return pa.table(row, schema=pa.schema([("shard", pa.int32()), ("size", pa.int32()), ("top", pa.float64()), ("scale", pa.float64()), ("h", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary()), ("layers", pa.list_(pa.binary()))]))

    placed = nodes.join(F.broadcast(dealt), "band").withColumn("shard", (F.col("base") + F.pmod("h", F.col("shards"))).cast("int"))
    return placed.select("shard", "h", "g", "ids", "v").groupBy("shard").applyInArrow(build, INDEX)


class Shard:
    """The graph of one shard, as its row holds it."""

    def __init__(self, row: dict):
        flat = lambda name, kind: np.frombuffer(row[name], kind)
        self.v = flat("vectors", "<f8").reshape(-1, row["size"])
        self.h, self.g = flat("h", "<i8").reshape(2, -1)
        self.ids, self.counts = flat("ids", "<i8"), flat("counts", "<i4").astype(np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        self.x = lifted(self.v, row["scale"], row["top"])
        self.layers = [np.frombuffer(b, "<i4").reshape(-1, LINKS if k else 2 * LINKS) for k, b in enumerate(row["layers"])]

    def search(self, h: np.ndarray, g: np.ndarray, v: np.ndarray, k: int, width: int) -> list[np.ndarray]:
        """h, g, vec_id, score and whether the vector is the query's own, of the k first ids for each query."""
        out = []
        asked = np.hstack([v / np.abs(v).max(1, keepdims=True), np.zeros((len(v), 1))]).astype(np.float32)
        at = descend(self.x, self.layers, asked, 0)
        nodes = walk(self.x, self.layers[0], asked, at, max(width, k))[0]
        scores = exact(v, self.v[nodes])
        for i in range(len(v)):
            mine = nodes[i] >= 0
            node, score = nodes[i][mine], scores[i][mine]
            n = self.counts[node]
            ids = self.ids[np.repeat(self.begins[node] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            score, own = np.repeat(score, n), np.repeat((self.h[node] == h[i]) & (self.g[node] == g[i]), n)
            first = np.lexsort((ids, -score))[:k]
            out.append((np.full(len(first), h[i]), np.full(len(first), g[i]), ids[first], score[first], own[first]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]


def asked_blocks(rows: DataFrame) -> DataFrame:
    """(block, h, g, v): distinct vectors of the queries, about ``BLOCK`` in each."""
    distinct = rows.where("is_query").groupBy("h", "g").agg(F.first("v").alias("v"))
    blocks = max(1, -(-rows.where("is_query").count() // BLOCK))
    some = distinct.groupBy(F.pmod("g", F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("h", "g", "v")).alias("x"))
    return some.select("block", F.col("x.h").alias("ask_h"), F.col("x.g").alias("ask_g"), F.flatten("x.v").alias("ask_v"))


def nearest(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", width: int = SEARCH_WIDTH) -> DataFrame:
    """For each row where ``query`` holds: query_id, rank, vec_id, score of about its k nearest other rows.

    Nearest is the largest inner product, in doubles of the vectors as they are; ties go to the smaller id. Rows without
    id, and vectors that are null, empty, zero or hold a null or non-finite component, take no part; what a vector
    lacks to the length of the longest is zero. Every other row is indexed: rows of equal vectors are different
    rows, and a second row with a query's id is a candidate. No rows give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    paths: list[str] = []
    rows, nodes = nodes_of(vectors, k, id_col, vector_col, query)
    nodes = written(nodes, "graph-nodes", paths)
    index = written(index_of(nodes), "graph-index", paths)
    blocks = written(asked_blocks(rows), "graph-asked", paths)
    parts = max(1, -(-blocks.count() // TASK_BLOCKS))
    shards = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    tasks = max(1, shards.count())
    names = [c.split()[0] for c in INDEX.split(", ")][1:]
    asks = ["ask_h", "ask_g", "ask_v"]
    graph = shards.join(index, "shard").select("shard", "part", F.lit(-1).alias("block"), *names, *[F.lit(None).cast(t).alias(c) for c, t in zip(asks, ("array<long>", "array<long>", "array<double>"), strict=True)])
    kinds = dict(c.split(" ", 1) for c in INDEX.split(", "))
    visits = blocks.withColumn("part", F.pmod("block", F.lit(parts))).join(shards, "part").select("shard", "part", "block", *[F.lit(None).cast(kinds[c]).alias(c) for c in names], *asks)
    # a shard's graph goes ahead of the blocks that ask it
    work = graph.union(visits).repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            for i in range(b.num_rows):
                if b.column("block")[i].as_py() < 0:
                    shard = Shard({c: b.column(c)[i].as_py() for c in names})
                    continue
                h, g = (b.column(c)[i].values.to_numpy() for c in asks[:2])
                v = b.column("ask_v")[i].values.to_numpy().reshape(len(h), -1)
                step = step_size(len(shard.v))
                for low in range(0, len(h), step):
                    found = shard.search(h[low : low + step], g[low : low + step], v[low : low + step], k + 1, width)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["h", "g", "vec_id", "score", "own"])

    hits = work.mapInArrow(search, "h long, g long, vec_id long, score double, own boolean")
    order = W.partitionBy("h", "g").orderBy(F.col("score").desc(), "vec_id", "own")
    first = hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    lists = written(first.groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score", "own"))).alias("found")), "graph-found", paths)
    # queries of one vector share its list; it goes to as many parts as they are dealt to
    salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    asking = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "h", "g", F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD)).cast("int").alias("salt"))
    mine = F.filter("found", lambda x: x["own"] & (x["vec_id"] == F.col("query_id")))
    others = F.filter("found", lambda x: F.coalesce(x["_n"] != F.get(mine, F.lit(0))["_n"], F.lit(True)))
    out = asking.join(salted, ["h", "g", "salt"]).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("i", "x"))
    out = written(out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"), "graph-nearest")
    remove_all(spark, paths)
    return out
