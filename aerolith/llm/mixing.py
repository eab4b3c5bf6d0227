"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every source takes each of its documents a whole number of times and a part of them once more. Which
part is decided by a threshold on a hash of doc_id: sizes are summed by source and hash bucket, running
sums find the bucket in which the budget ends, and only that bucket is divided again, until it holds one
hash. Documents are then filtered against the threshold. Nothing is sorted, and a larger budget takes a
superset of what a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, if_small, text_of, unused, written

#: Bits of the hash, and how many of them each level of the histogram divides by.
HASH_BITS, LEVEL_BITS = 48, 12


def hash_of(key: Column) -> Column:
    """48 bits of the MD5 of the key's text; null is the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """(source, source_size, target) by water filling: of a source at most ``most`` times its size.

    Sources stand in code point order, null last, and their weights repeat. Taking the sources in the order
    in which a rising water level fills them, the first level that no later source is filled by is the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "utf-8"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(kinds, (((F.row_number().over(order) - 1) % len(weights)) + 1).cast("int")))
    full = W.orderBy(most * F.col("source_size") / F.col("weight"), "source")
    every = W.partitionBy()
    per = per.withColumn("cap", most * F.col("source_size"))
    per = per.withColumns({"rest": budget * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), "rest_weight": F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing))})
    fits = F.col("rest") / F.col("rest_weight") * F.col("weight") <= F.col("cap")
    level = F.max(F.when(fits, F.col("rest") / F.col("rest_weight"))).over(every)
    return per.select("source", "source_size", F.least(F.coalesce(level * F.col("weight"), F.col("cap")), "cap").alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): documents whose hash is below it hold a number of words next to the budget.

    sizes: source, size, h. budgets: source, budget (below the source's size). Each level reads only
    the documents of the boundary buckets and keeps ``1 << LEVEL_BITS`` sums a source at most.
    """
    spark = sizes.sparkSession
    state = budgets.select("source", F.col("budget").alias("left_over"), F.lit(0).cast("long").alias("prefix"))
    inside = sizes
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        where = (F.col("s.source").eqNullSafe(F.col("b.source"))) & (F.shiftright("s.h", shift + LEVEL_BITS) == F.col("b.prefix"))
        inside = inside.alias("s").join(if_small(state).alias("b"), where).select("s.source", "s.size", "s.h")
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = W.partitionBy("source").orderBy("bucket")
        sums = sums.withColumns({"until": F.sum("words").over(run), "nth": F.row_number().over(run)})
        sums = sums.withColumn("before", F.col("until") - F.col("words"))
        at = sums.alias("s").join(state.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")))
        last = at.where("s.until > b.left_over").groupBy("s.source").agg(F.min(F.struct("s.bucket", "s.before", "s.words", "b.left_over")).alias("x"))
        state = last.select("source", (F.col("x.left_over") - F.col("x.before")).alias("left_over"), F.col("x.bucket").alias("prefix"), F.col("x.words").alias("words"))
        state = written(state, "mix-threshold")
        if shift:
            state = state.drop("words")
            if shift + LEVEL_BITS == HASH_BITS:  # from here on a small part of the table
                inside = written(inside.alias("s").join(if_small(state).alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")) & (F.shiftright("s.h", shift) == F.col("b.prefix"))).select("s.source", "s.size", "s.h"), "mix-boundary")
    # of the documents with the boundary hash, all are taken if that comes nearer
    return state.select("source", F.when(F.col("left_over") * 2 >= F.col("words"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("threshold"))


def cuts(sizes: DataFrame, weights: tuple[int, ...], budget: float, most: int) -> DataFrame:
    """(source, source_size, target, whole, threshold): one row a source, from (source, size, h) of every document."""
    targets = written(source_targets(sizes, weights, budget, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    targets = targets.withColumn("whole", whole)
    budgets = targets.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")).where("budget > 0")
    cut = targets.alias("t").join(thresholds(sizes.select("source", "size", "h"), budgets).alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.*", F.coalesce("c.threshold", F.lit(0)).alias("threshold"))
    return written(cut, "mix-cut")


def sizes_of(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", word_count(text_of()).alias("size"), hash_of(F.col("doc_id")).alias("h")), "mix-sizes")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), budget: float = 1.0, most: int = 3) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words, repeats counted), copies.

    A null text has no words, a null source is a source of its own, a null doc_id hashes as the empty
    text. Rows with one doc_id share a hash and are taken together. Documents without words are taken as
    their source's hash threshold says, with taken 0. A source without words has target 0 and its documents
    stay once. An empty table gives an empty result; other columns are ignored.
    """
    sizes = sizes_of(docs)
    # one row a source: sent to all tasks while it is small, which also keeps a hot source spread out
    cut = if_small(cuts(sizes, weights, budget, most))
    joined = sizes.alias("d").join(cut.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    copies = F.col("whole") + (F.col("h") < F.col("threshold")).cast("long")
    return joined.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), budget: float = 1.0, most: int = 3) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken.

    Documents meet only their source's threshold, so they aren't shuffled. Rows of a source that repeat a doc_id are
    taken alike, those without one too; an empty table gives an empty one.
    """
    columns = docs.columns
    of, whole, threshold = (unused(columns, c) for c in ("of", "whole", "threshold"))
    cut = cuts(sizes_of(docs), weights, budget, most).select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("threshold").alias(threshold))
    joined = docs.join(if_small(cut), docs["source"].eqNullSafe(cut[of]))
    copies = (F.col(whole) + (hash_of(docs["doc_id"]) < F.col(threshold)).cast("long")).cast("int")
    times = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))
    return joined.withColumn(of, times).select(*[f"`{c}`" for c in columns])


#: The same result in SQL: the threshold found by one running sum in hash order.
SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
p AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
             CAST(1 + (row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 AS DOUBLE) AS weight
      FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size AS cap,
             sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
      FROM p),
l AS (SELECT *, max(CASE WHEN rest / rest_weight * weight <= cap THEN rest / rest_weight END) OVER () AS level FROM f),
t AS (SELECT source, source_size, least(coalesce(level * weight, cap), cap) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN budget > 0 AND (until <= budget OR (until - same <= budget AND 2 * (budget - (until - same)) >= same)) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(whole + CASE WHEN budget > 0 AND (until <= budget OR (until - same <= budget AND 2 * (budget - (until - same)) >= same)) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r
"""
