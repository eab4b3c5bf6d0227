"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct shingles in one global order, rare ones first. For a similarity of t, two
documents that are linked share at least l shingles among the first n - ceil(t n) + l of each, for any l. Every
document chooses its own l by the estimated cost of the candidates its prefix brings: documents whose prefix holds
common shingles lengthen it, and in return a pair must share min(l, l') prefix shingles before its full sets are
compared. Documents with the same set are one class and take part once.

The rarest shingle that two linked documents share stands in the prefixes for l = 1, and no more than what follows it
can be shared. So a document at place i of a list, with n shingles, is linked through it only with documents of a size
that n - i shared shingles allow. Members of short lists are paired if each allows the size of the other.

Only groups, not pairs, are asked for, so long lists aren't multiplied out. First each is cut into bands of sizes, and
the member with the fewest rare shingles of a band is compared with the members of its own band and of the next: where
many documents are near copies of one, this joins them in one component. Then only members of different components are
paired, by list and band, a document whose rare shingles leave little to share with few sizes or none; no member is
repeated for the sizes it allows. Every pair that may be linked is either compared or lies in one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, connected_components, if_small, release, remove_all, text_of, word_hashes, written

#: Prefixes are lengthened for one of these numbers of shared shingles.
MATCHES = (1, 2, 4, 8, 16)
#: A shingle is common if so many documents hold it; by a share of all, at most 2^20 shingles are.
COMMON, COMMON_SHARE = 8, 2.0**-20
#: Cost of comparing two full sets, in visits to a posting.
COMPARE = 16
#: Lists of so many members or fewer are paired at once.
SHORT = 8
#: Sizes of one fine band differ by less than this factor.
FINE = 1.02
#: Long lists get another round of pivots while so many times their members would be paired, and rounds halve that.
MANY = 16
#: Shingles that a task counts at once.
FLUSH = 1_500_000
#: Bytes of text that are cut into shingles at once.
TEXT_BYTES = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit shingles of each text, one text after the other, and how many each has.

    Fewer words than ``width`` are one shingle, none are none.
    """
    h, counts = word_hashes(texts)
    n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    begin = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(np.cumsum(counts) - counts - begin, n)
    k = np.repeat(np.minimum(counts, width).astype(np.uint64), n)
    x = k.copy()
    with np.errstate(over="ignore"):
        for i in range(width):
            y = (x ^ h[np.minimum(at + i, len(h) - 1)]) * _MIX
            y ^= y >> np.uint64(29)
            x = np.where(k > i, y, x)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    x = x.view(np.int64)
    for low, size in zip(begin.tolist(), n.tolist(), strict=True):
        x[low : low + size].sort()
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    new[begin[n > 0]] = True
    sums = np.concatenate([[0], np.cumsum(new)])
    return x[new], sums[begin + n] - sums[begin]


def prefixes(x: np.ndarray, n: np.ndarray, common: np.ndarray, held: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefixes of sets that stand one after the other, their lengths, and the number of matches each stands for."""
    df = np.ones(len(x))
    if len(common):
        at = np.searchsorted(common, x)
        at[at == len(common)] = 0
        df = np.where(common[at] == x, held[at], 1.0)
    order = np.lexsort((df, np.repeat(np.arange(len(n)), n)))  # stable, so shingles that are as common stay sorted
    x, visits = x[order], np.concatenate([[0.0], np.cumsum(df[order] - 1)])
    begin = np.cumsum(n) - n
    first = n + -percent * n // 100
    best, chosen = np.full(len(n), np.inf), np.ones(len(n), dtype=np.int64)
    for m in MATCHES:
        fits = first + m <= n
        cost = (visits[begin + np.where(fits, first + m, 0)] - visits[begin]) * (1 + COMPARE / m) + first + m
        better = fits & (cost < best)
        best, chosen = np.where(better, cost, best), np.where(better, m, chosen)
    size = np.where(n > 0, first + chosen, 0)
    return x[np.arange(len(x)) - np.repeat(begin, n) < np.repeat(size, n)], size, chosen


def shingle_counts(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles and how many documents hold them: sorted and at most 1 / COMMON_SHARE.

    All documents are counted, and tasks pass on what more than one of their documents hold: a shingle that is
    spread so thinly that no task meets it twice counts as rare. Counts set the order and the cost, and no link.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0

        def out() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(s[n > 1]), pa.array(n[n > 1].astype(np.int64))], ["s", "n"])

        for some in chunks(batches, "text", TEXT_BYTES):
            sets.append(shingle_sets(some.column("text"), width)[0])
            size += len(sets[-1])
            if size > FLUSH:
                yield out()
                sets, size = [], 0
        if sets:
            yield out()
        sets.clear()
        release()

    paths: list[str] = []
    counts = written(docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON), "join-common", paths)
    total = counts.agg(F.sum("n")).head()[0] or 0
    found = counts.where(F.col("n") > COMMON_SHARE * total).toArrow()
    remove_all(docs.sparkSession, paths)
    order = np.argsort(found["s"].to_numpy())
    return found["s"].to_numpy()[order], found["n"].to_numpy()[order].astype(float)


def prefix_rows(docs: DataFrame, width: int, percent: int, common) -> DataFrame:
    """(doc_id, n, digest, matches, prefix) of every row; the digest of the empty set is null."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("matches", pa.int32()), ("prefix", pa.list_(pa.int64()))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, held = common.value
        for some in chunks(batches, "text", TEXT_BYTES):
            x, n = shingle_sets(some.column("text"), width)
            ends = np.cumsum(n).tolist()
            digests = [hashlib.sha256(x[b - k : b]).digest() if k else None for b, k in zip(ends, n.tolist(), strict=True)]
            p, size, matches = prefixes(x, n, values, held, percent)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(p))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(digests, pa.binary()), pa.array(matches.astype(np.int32)), lists], schema=schema)
        release()

    return docs.mapInArrow(emit, "doc_id long, n int, digest binary, matches int, prefix array<long>")


def band(size: Column, factor: float) -> Column:
    """Sizes that differ by at most this factor lie in one band or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / (log(factor) * 1.000001)).cast("int") if factor > 1 else size.cast("int")


def fits(x: str, y: str) -> Column:
    """Each of two members of a list allows the size of the other."""
    return (F.col(f"{x}.n") <= F.col(f"{y}.most")) & (F.col(f"{y}.n") <= F.col(f"{x}.most"))


def pair(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.doc_id", f"{y}.doc_id").alias("a"), F.greatest(f"{x}.doc_id", f"{y}.doc_id").alias("b")]


def pivot_pairs(long: DataFrame, turn: int, percent: int) -> DataFrame:
    """Members of long lists beside the pivot of their band of sizes and of the next.

    The first pivot is the member that the fewest rare shingles stand before; later ones are of any component.
    """
    rows = long.withColumn("band", band(F.col("n"), 100 / percent))
    first = F.struct(F.xxhash64("label", F.lit(turn)).alias("h") if turn else F.lit(0).alias("h"), "i", "doc_id", "n", "most", "label")
    pivots = written(rows.groupBy("s", "band").agg(F.min(first).alias("p")).select("s", "band", "p.*"), "join-pivots")
    # a pivot is set beside the members of its band and of the one before: pivots are few, members many
    near = pivots.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    both = rows.alias("x").join(if_small(near, 200_000).alias("p"), ["s", "band"])
    return both.where((F.col("x.label") != F.col("p.label")) & fits("x", "p")).select(*pair("x", "p"))


def remaining(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of lists that hold several components, and of them the smaller and larger partners of pairs that may be left.

    A member is one row on each side at most. A list of one component has nothing left and stays out: components only
    grow together.
    """
    mixed = written(rows.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("s"), "join-mixed")
    rows = written(rows.join(if_small(mixed), "s", "left_semi"), "join-rest")
    low, high = band(F.greatest(F.ceil(F.col("n") * percent / 100), F.lit(1)), FINE), band(F.least("n", "most"), FINE)
    return rows, rows.where("n <= most"), rows.withColumns({"low": low, "high": high}).where("low <= high")


def pairs_left(small: DataFrame, large: DataFrame) -> int:
    """How many pairs are of one list and of sizes that may be linked, by fine bands.

    A larger partner meets the smaller ones up to its highest band without those below its lowest: running counts of a
    list are taken there, so no member is repeated for the bands between.
    """
    places = small.select("s", band(F.col("n"), FINE).alias("f"), F.lit(1).alias("m"), F.lit(0).alias("k"))
    places = places.union(large.select("s", "high", F.lit(0), F.lit(1))).union(large.select("s", F.col("low") - 1, F.lit(0), F.lit(-1)))
    places = places.groupBy("s", "f").agg(F.sum("m").alias("m"), F.sum("k").alias("k"))
    upto = F.sum("m").over(W.partitionBy("s").orderBy("f"))
    return places.select((upto * F.col("k")).alias("work")).agg(F.sum("work")).head()[0] or 0


def pairs_of_rest(small: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be left: the larger partner's size lies in the smaller one's band or in the next."""
    small, large = (x.withColumn("band", band(F.col("n"), 100 / percent)) for x in (small, large))
    ordered = F.struct("y.n", "y.doc_id") < F.struct("x.n", "x.doc_id")

    def beside(y: DataFrame) -> DataFrame:
        both = y.alias("y").join(large.alias("x"), ["s", "band"])
        return both.where((F.col("x.label") != F.col("y.label")) & ordered & fits("x", "y")).select(*pair("x", "y"))

    return beside(small).union(beside(small.withColumn("band", F.col("band") + 1)))


def jaccard_classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id that links reach. Null, empty and blank texts have no shingles and are linked with nothing.
    Rows that repeat a doc_id are one document that holds each of their sets. A row without doc_id is in a component
    only through documents with the same set, and else has none. No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    paths: list[str] = []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    counted = shingle_counts(docs, width)
    common = spark.sparkContext.broadcast(counted)
    rows = written(prefix_rows(docs, width, percent, common), "join-sets")
    first = written(rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "join-copies")
    marked = rows.join(if_small(first), "digest", "left")
    own = marked.where("n > 0 and doc_id is not null and (first is null or first = doc_id)").select("doc_id", "n", "matches", "prefix")
    own = written(own, "join-prefixes", paths)

    reach = F.expr(f"n - cast(ceil(n * {percent} / 100) as int) + 1")
    places = own.select("doc_id", "n", F.posexplode(F.slice("prefix", F.lit(1), reach)).alias("i", "s"))
    places = places.withColumn("most", F.expr(f"cast({100 + percent} * (n - i) div {percent} - n as int)"))
    often = F.broadcast(written(spark.createDataFrame(pa.table({"s": pa.array(counted[0], pa.int64())})), "join-often", paths))  # at most 1 / COMMON_SHARE rows
    # lists of common shingles are summed up before the shuffle; the others are short
    many = places.join(often, "s", "left_semi")
    sums = [F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("members")]
    many = many.join(F.broadcast(many.groupBy("s").agg(*sums).where("least < last")), "s")  # one row a common shingle
    by_shingle = W.partitionBy("s")
    few = places.join(often, "s", "left_anti").withColumns({"least": F.min("doc_id").over(by_shingle), "last": F.max("doc_id").over(by_shingle), "members": F.count(F.lit(1)).over(by_shingle)}).where("least < last")
    columns = ["s", "doc_id", "n", "i", "most", "members"]
    lists = written(many.select(*columns).union(few.select(*columns)), "join-lists", paths)
    short, long = lists.where(F.col("members") <= SHORT), lists.where(F.col("members") > SHORT).drop("members")

    at_once = short.alias("x").join(short.alias("y"), "s").where((F.col("x.doc_id") < F.col("y.doc_id")) & fits("x", "y")).select(*pair("x", "y"))
    tested = links = labels = None
    turn, members, before = 0, long.count(), float("inf")
    named = long.withColumn("label", F.col("doc_id"))
    while True:
        new = pivot_pairs(named, turn, percent)
        new = at_once.union(new) if turn == 0 else new
        tested, links, labels, more = compared(docs, own, new, tested, links, labels, width, percent, paths)
        if not members:
            break
        if more:
            named = written(with_labels(named.drop("label"), labels), "join-named", paths)
        named, small, large = remaining(named, percent)
        turn += 1
        work = pairs_left(small, large)
        if more and MANY * members < work <= before / 2:
            before = work
            continue
        rest = pairs_of_rest(small, large, percent)
        labels = compared(docs, own, rest, tested, links, labels, width, percent, paths)[2]
        break

    component = F.coalesce("first", "doc_id")
    out = marked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("node"))
    if labels is None:
        out = out.select("doc_id", "n_shingles", F.col("node").alias("component_id"))
    else:
        out = out.join(if_small(labels), "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    remove_all(spark, paths)
    return out


def with_labels(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the name of their component: by the document alone where it has no link."""
    named = lists.join(if_small(labels), lists.doc_id == labels.node, "left")
    return named.select(*lists.columns, F.coalesce("component", "doc_id").alias("label"))


def compared(docs: DataFrame, own: DataFrame, pairs: DataFrame, tested: DataFrame | None, links: DataFrame | None, labels: DataFrame | None, width: int, percent: int, paths: list[str]) -> tuple[DataFrame, DataFrame | None, DataFrame | None, bool]:
    """Compare new pairs (a, b): all pairs tested, all links, components by document, and whether there are new links."""
    pairs = pairs.where("a <> b").distinct()
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    pairs = written(pairs, "join-pairs", paths)
    found = similar(docs, own, pairs, width, percent, paths)
    tested = pairs if tested is None else tested.union(pairs)
    if found.isEmpty():
        return tested, links, labels, False
    links = found if links is None else links.union(found)
    return tested, links, connected_components(links, "join-components"), True


def similar(docs: DataFrame, own: DataFrame, pairs: DataFrame, width: int, percent: int, paths: list[str]) -> DataFrame:
    """The pairs (a, b) that share enough prefix shingles and whose full sets are similar enough."""
    # the first bits of a shingle do to count what prefixes share; shingles of one document that have them in common
    # are counted on top, so that no pair is lost
    ids = written(pairs.select("a").union(pairs.select("b")).distinct().toDF("doc_id"), "join-ids", paths)
    cut = F.transform("prefix", lambda x: F.shiftright(x, 32).cast("int"))
    short = own.join(if_small(ids, 250_000), "doc_id", "left_semi").select("doc_id", "n", "matches", cut.alias("prefix")).withColumn("twice", F.size("prefix") - F.size(F.array_distinct("prefix")))
    near = pairs.join(short.toDF("a", "na", "la", "pa", "ta"), "a").join(short.toDF("b", "nb", "lb", "pb", "tb"), "b")
    near = near.withColumn("shared", F.size(F.array_intersect("pa", "pb")) + F.greatest("ta", "tb"))
    # all that two sets share up to where the first prefix ends is in both prefixes; the rest of that set is the most to come
    most = F.col("shared") + F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    near = near.where((F.col("shared") >= F.least("la", "lb")) & ((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))))
    near = written(near.select("a", "b"), "join-near", paths)
    needed = if_small(written(near.select("a").union(near.select("b")).distinct().toDF("doc_id"), "join-needed", paths), 250_000)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in chunks(batches, "text", TEXT_BYTES):
            x, n = shingle_sets(some.column("text"), width)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists], ["doc_id", "x"])
        release()

    sets = written(docs.join(needed, "doc_id", "left_semi").mapInArrow(emit, "doc_id long, x array<long>"), "join-full", paths)
    both = near.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    shared = F.size(F.array_intersect("xa", "xb"))
    return written(both.where(100 * shared >= percent * (F.size("xa") + F.size("xb") - shared)).select("a", "b").distinct(), "join-links", paths)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that have a similar one of smaller doc_id in their component, own columns.

    Rows without doc_id, and rows whose text has no words, stay. Rows that repeat a doc_id stay or go together.
    """
    found = jaccard_classes(docs, **options)
    gone = written(found.where("component_id is not null and component_id <> doc_id").select("doc_id").distinct(), "join-gone")
    return docs.join(if_small(gone), "doc_id", "left_anti")
