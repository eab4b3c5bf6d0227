"""Sharding by balanced label propagation, law ``rows``: shards hold equally many documents, give or take one.

Documents start spread evenly by hash. In each round a document that shares a hub (for the query: its text)
with others asks for the shard that holds most of its neighbours; a shard admits no more linked documents than
its quota. Hubs stand for the links within a group, so a group of n copies costs n rows, not n^2. Unlinked
documents, whose move cuts nothing, then fill the shards to equal counts. Ranks inside a shard are found by
counts over small buckets and a rank inside a bucket: no task sorts a whole shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import if_small, remove_all, text_of, written

#: Rows of a bucket, the unit within which rows are ranked.
BUCKET_ROWS = 20_000


def ranked(rows: DataFrame, key: str, first: str, buckets: int) -> DataFrame:
    """rows plus ``rank``: gapless from 0 inside each value of ``key``, the rows with ``first`` true ahead.

    Ranks follow (bucket, hash, doc_id); bucket counts are added up in a table of keys x buckets rows.
    """
    rows = rows.withColumn("_b", F.when(F.col(first), F.lit(0)).otherwise(buckets) + F.pmod(F.col("h"), F.lit(buckets)))
    counts = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, "_b", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_from"))
    inside = rows.withColumn("_in", F.row_number().over(W.partitionBy(key, "_b").orderBy("h", "doc_id")) - 1)
    return inside.join(if_small(offsets), [key, "_b"]).withColumn("rank", F.col("_from") + F.col("_in")).drop("_b", "_from", "_in")


def balanced_shards(docs: DataFrame, shards: int = 24, rounds: int | None = None, links: DataFrame | None = None) -> DataFrame:
    """One row a document (doc_id, text): doc_id, size, text_crc32, shard, slot, hub (null if unlinked).

    ``links`` (doc_id, hub) names the hubs of linked documents, any number each; links without doc_id or hub are
    ignored. If it is not given, equal texts are linked, whether they have a doc_id or not. A null text is empty and
    weighs 8 bytes; null texts and empty texts are linked with each other. Rows that repeat whole are rows of their own,
    placed by the same law. Fewer rows than shards leave shards empty; no rows give no rows.
    """
    spark = docs.sparkSession
    paths: list[str] = []
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("hub"))
    hubs_of = None  # (hub, one): the hubs behind a set of hubs, which documents with the same set share
    if links is not None:
        sets = links.where("doc_id is not null and hub is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("hub").cast("string"))).alias("hubs"))
        sets = written(sets.withColumn("hub", F.sha2(F.to_json("hubs"), 256)), "shard-sets", paths)
        hubs_of = written(sets.select("hub", F.explode("hubs").alias("one")).distinct(), "shard-hubs-of", paths)
        rows = rows.drop("hub").join(sets.select("doc_id", "hub"), "doc_id", "left")
    rows = rows.withColumns({"h": F.xxhash64("doc_id", "text_crc32"), "row": F.monotonically_increasing_id()})
    rows = written(rows, "shard-rows", paths)
    n = rows.count()
    buckets = max(1, n // (shards * BUCKET_ROWS))

    def by_hub(counts: DataFrame) -> DataFrame:
        """Counts (hub, shard, n) of documents by set of hubs, as what each set's hubs hold together."""
        if hubs_of is None:
            return counts
        one = counts.join(hubs_of, "hub").groupBy("one", "shard").agg(F.sum("n").alias("n"))
        return hubs_of.join(one, "one").groupBy("hub", "shard").agg(F.sum("n").alias("n"))

    own = rows.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", F.lit(0))
    wide = by_hub(own)
    if hubs_of is not None:  # a set counts its own document once for each of its hubs
        wide = wide.join(hubs_of.groupBy("hub").agg(F.count(F.lit(1)).alias("k")), "hub").withColumn("n", F.col("n") - F.col("k") + 1)
    linked_hubs = written(wide.where("n > 1").select("hub", F.lit(True).alias("linked")), "shard-hubs", paths)
    rows = rows.join(if_small(linked_hubs), "hub", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    rows = written(rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")), "shard-start", paths)

    quota = n // shards  # linked documents that a shard takes at most
    linked = rows.where("linked").select("row", "doc_id", "h", "hub", "shard")
    last: list[str] = []
    # a hub fills one shard a round: until none moves, or as many rounds as it takes to fill each of the shards
    for _ in range(shards if rounds is None else rounds):
        this: list[str] = []
        held = written(linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")), "shard-held", this)
        load = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        room = {s: quota - load.get(s, 0) for s in range(shards)}
        votes = held if hubs_of is None else written(by_hub(held), "shard-votes", this)
        # a document wishes for the shard with most of its neighbours among those with room, ties to the smaller one;
        # it moves there from a shard that holds fewer of them
        wish = votes.where(F.col("shard").isin([s for s in room if room[s] > 0])).groupBy("hub").agg(F.max(F.struct("n", (-F.col("shard")).alias("minus"))).alias("best"))
        asks = votes.join(wish, "hub").where(F.struct("n", (-F.col("shard")).alias("minus")) < F.col("best")).select("hub", "shard", (-F.col("best.minus")).cast("int").alias("to"))
        asked = linked.join(if_small(written(asks, "shard-asks", this)), ["hub", "shard"]).withColumn("first", F.lit(True))
        admit = F.create_map(*[x for s in range(shards) for x in (F.lit(s), F.lit(max(0, room[s])))])
        won = written(ranked(asked, "to", "first", buckets).where(F.col("rank") < admit[F.col("to")]).select("row", "to"), "shard-won", this)
        if won.isEmpty():
            remove_all(spark, this)
            break
        linked = written(linked.join(if_small(won), "row", "left").select("row", "doc_id", "h", "hub", F.coalesce("to", "shard").alias("shard")), "shard-linked", this)
        now = this.pop()
        remove_all(spark, [*last, *this])
        last = [now]
    final = linked.select("row", F.col("shard").alias("moved"))
    rows = rows.join(final, "row", "left").withColumn("shard", F.coalesce("moved", "shard")).drop("moved", "row")

    placed = written(ranked(rows, "shard", "linked", buckets), "shard-placed")
    remove_all(spark, [*last, *paths])
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    fair = {s: n // shards + (s < n % shards) for s in range(shards)}
    # rows beyond a shard's fair count, unlinked ones as ranks put them last, are numbered and dealt to shards with room
    extra_from, gaps, total = {}, [], 0
    for s in range(shards):
        extra_from[s] = total
        total += max(0, counts.get(s, 0) - fair[s])
    at = 0
    for s in range(shards):
        lack = max(0, fair[s] - counts.get(s, 0))
        if lack:
            gaps.append((at, at + lack, s, counts.get(s, 0)))
            at += lack
    number = F.create_map(*[x for s in range(shards) for x in (F.lit(s), F.lit(extra_from[s]))])
    limit = F.create_map(*[x for s in range(shards) for x in (F.lit(s), F.lit(fair[s]))])
    is_extra = F.col("rank") >= limit[F.col("shard")]
    nth = number[F.col("shard")] + F.col("rank") - limit[F.col("shard")]
    to, slot = F.col("shard"), F.col("rank")
    for low, high, s, first in gaps:
        here = is_extra & (nth >= low) & (nth < high)
        to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, nth - low + first).otherwise(slot)
    return placed.select("doc_id", "size", "text_crc32", to.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.when(F.col("linked"), F.col("hub")).alias("hub"))
