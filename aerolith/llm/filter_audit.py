"""How text filters interact: what each removes, repeats or wastes in every order they may be applied in.

Words are exploded and counted by (document, word) and then by document, which gives totals and distincts; the flags
that need no words are computed in a second, narrow scan and joined to them. Which of the five filters a document fails
is a number of five bits, so 32 conditional counts a part, for all, good and toxic documents, say all there is to know:
every order and step is a sum over some of them.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove_all, text_of, written

#: The filters in order of their bits.
FILTERS = "ABCDE"
#: Bytes of a task's memory for each byte of text that it explodes and counts, so that its table of words fits.
EXPANSION = 30
#: Fewest and most bytes of text of a task.
LEAST_BYTES, MOST_BYTES = 8_000_000, 256_000_000


def identity() -> list[Column]:
    """What tells documents apart: doc_id and 128 bits of the text."""
    return [F.col("doc_id"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("g")]


def task_bytes(spark: SparkSession) -> int:
    """Bytes of text whose words a task can count without spilling, by the session's memory and cores."""
    conf = spark.sparkContext.getConf()
    local = conf.get("spark.master", "").startswith("local")
    memory = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "1"))
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(memory)
    return int(min(max(held * 0.3 / cores / EXPANSION, LEAST_BYTES), MOST_BYTES))


def word_counts(docs: DataFrame, key: tuple[str, ...] = ("doc_id", "h", "g")) -> DataFrame:
    """(key, words, distinct_words): totals of each document (key, text), from its exploded words.

    Documents are dealt by their key before they are exploded, so both aggregations run where the words are. A null
    stands before the words of each row; how many of them a key has is how many equal rows it stands for.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // task_bytes(spark)))
    split = F.split("text", r"[\x20\x09-\x0D]+")
    words = docs.repartition(tasks, *key).select(*key, F.explode(F.concat(F.array(F.lit(None).cast("string")), split)).alias("word"))
    pairs = words.where("word is null or word <> ''").groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))
    rows = F.sum(F.when(F.col("word").isNull(), F.col("n")))
    total = F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0))
    return pairs.groupBy(*key).agg(F.floor(total / rows).alias("words"), F.count("word").alias("distinct_words"))


def marked(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, h, g, part, mask, n): the first four filters as bits; n rows are alike."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    c, d = 100 * capitals.cast("long") > 2 * F.length("text"), F.col("text").rlike("[#$%&*|]")
    other = rows.select(*identity(), "part", (F.when(c, 4).otherwise(0) + F.when(d, 8).otherwise(0)).alias("cd"))
    other = other.groupBy("doc_id", "h", "g", "part", "cd").agg(F.count(F.lit(1)).alias("n"))
    counted = word_counts(rows.select(*identity(), "text"))
    same = other.doc_id.eqNullSafe(counted.doc_id) & (other.h == counted.h) & (other.g == counted.g)
    both = other.join(counted, same, "left")
    a, b = F.col("words") < 200, 100 * F.col("distinct_words") < 50 * F.col("words")
    return both.select(other.doc_id, other.h, other.g, "part", (F.col("cd") + F.when(a, 1).otherwise(0) + F.when(b, 2).otherwise(0)).alias("mask"), "n")


def counts_by_mask(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row a part: arrays ``n``, ``good`` and ``toxic`` of 32 counts each, by the set of filters that documents fail.

    The last bit says that a smaller doc_id has the same text. It is found by joining each document with the smallest
    doc_id of its text, by both, so that no text is a hot key; labels meet rows that are added up before.
    """
    spark = docs.sparkSession
    paths: list[str] = []
    rows = written(marked(docs, part), "audit-marked", paths)
    first = rows.where("doc_id is not null").groupBy("h", "g").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    seen = rows.join(first, ["h", "g", "doc_id"], "left")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    masks = seen.select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"), "n")
    masks = masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    judged = masks.join(known.where("doc_id is not null"), "doc_id", "left")
    weights = {"n": F.col("n"), "good": F.col("n") * F.coalesce("good", F.lit(0)), "toxic": F.col("n") * F.coalesce("toxic", F.lit(0))}
    columns = [F.sum(F.when(F.col("mask") == m, w).otherwise(0)).alias(f"{name}_{m}") for name, w in weights.items() for m in range(32)]
    table = judged.groupBy("part").agg(*columns).select("part", *[F.array(*[F.col(f"{name}_{m}") for m in range(32)]).alias(name) for name in weights])
    out = written(table, "audit-counts")
    remove_all(spark, paths)
    return out


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of those before) of all orders: a fixed 600 rows."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append((order, step, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step and seven counts.

    A: fewer than 200 words; B: under half of them distinct; C: over 2% capitals; D: one of ``#$%&*|``; E: the text of a
    smaller doc_id. Null texts count as empty, so they fail A; a null part is the empty string, one with the parts called
    so. Rows without doc_id have no label and never fail E; rows that repeat a doc_id are documents by themselves, of
    which neither comes before the other. Labels that repeat a doc_id count as good or toxic if one of them says so.
    No documents give no rows; other columns are ignored.
    """
    counts = counts_by_mask(docs, labels, part)
    names = ("filter_order", "step", "bit", "before")
    every = F.from_json(F.lit(json.dumps([dict(zip(names, s, strict=True)) for s in steps()])), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = counts.select("part", "n", "good", "toxic", F.inline(every))

    def summed(values: str, which) -> Column:
        """Sum of the counts whose number fulfils a condition."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, m: s + F.when(which(m), F.get(F.col(values), m)).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(F.col("before")) == 0)
    again = lambda m: fails(m) & (m.bitwiseAND(F.col("before")) != 0)
    stays = lambda m: m.bitwiseAND(F.col("bit").bitwiseOR(F.col("before"))) == 0
    alone = lambda m: m == F.col("bit")
    # of 120 orders a filter comes first among the k that a document fails in 120 / k
    share = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, m: s + F.when(fails(m), F.get(F.col("n"), m) * (120 / F.bit_count(m)).cast("long")).otherwise(0))
    return rows.select("part", "filter_order", "step", summed("n", stays).alias("kept"), summed("n", here).alias("removed"), summed("n", again).alias("redundant"), summed("n", alone).alias("unique_fails"), summed("good", here).alias("good_lost"), summed("toxic", here).alias("toxic_lost"), share.alias("shapley"))


#: The same in SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask,
  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(l, b)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) t(i)),
r AS (SELECT p.part, filter_order, step, bit, before, mask, coalesce(n, 0) AS n, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM (SELECT DISTINCT part FROM g) p CROSS JOIN s LEFT JOIN g ON g.part = p.part)
SELECT part, filter_order, step, CAST(sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & bit <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM r GROUP BY part, filter_order, step"""
