"""Exact deduplication by a stateful stream.

Digests of all documents are written as a feed and read as a stream in bounded micro-batches. A
streaming aggregation keyed by digest keeps, in RocksDB state without expiry, the number of rows,
the stable identifier (the largest doc_id) and the locator of its content: the file it stands in and its row there.
Rows are combined in each task before they are shuffled, so a group of copies that holds a third of all rows
costs one row per task. Rows whose digest is known already are hits: the text of the row that stays is fetched through
its locator and compared in full with theirs. Texts that only share a digest are grouped by their bytes.

With a ``state`` folder the stream goes on from where an earlier call left it, over what that call has read too.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, scratch, text_of, unused, written

#: Groups of copies (50 bytes each) that are sent to every task; more are joined by a shuffle.
BROADCAST_GROUPS = 500_000

#: State in RocksDB with bounded memory; only changes are written at each commit.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else each of many small stores sets aside megabytes of disk that it never fills
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def copy_groups(feed_path: str, schema, like: DataFrame, max_bytes_per_trigger: int, checkpoint: str) -> DataFrame:
    """Run the stream over the feed; returns (digest, keep_id, file, at, n) of digests seen more than once.

    With the same checkpoint a later call reads only new files of the feed and goes on from the state.
    """
    base = like.sparkSession
    spark = base.newSession()
    for k, v in STATE.items() | {("spark.sql.shuffle.partitions", base.conf.get("spark.sql.shuffle.partitions"))}:
        spark.conf.set(k, v)
    out = f"{checkpoint}-groups"

    def keep(batch: DataFrame, number: int) -> None:
        # counts only grow: of one digest the update with the most rows is the last. A repeated batch overwrites itself.
        batch.where("n > 1").select("digest", "keep.*", "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

    feed = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(feed_path)
    state = feed.groupBy("digest").agg(F.max(F.struct(F.col("doc_id").alias("keep_id"), "file", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))
    query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    schema = "digest binary, keep_id long, file string, at long, n long"
    # an empty table has no batch at all; no digest is seen twice then
    updates = base.read.schema(schema).option("recursiveFileLookup", "true").parquet(out) if exists(base, out) else base.createDataFrame([], schema)
    return updates.groupBy("digest").agg(F.max(F.struct("keep_id", "file", "at")).alias("keep"), F.max("n").alias("n")).select("digest", "keep.*", "n")


def exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def located(docs: DataFrame, store: str | None) -> DataFrame:
    """(doc_id, text, file, at): documents with the file and the row that hold them.

    Documents that aren't read from files, and all that a state is kept of, are written first.
    """
    def from_files(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))

    if store is None:
        try:
            return from_files(docs)
        except AnalysisException:  # no files
            store = scratch(docs.sparkSession, "dedup-content")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).write.mode("append").parquet(store)
    return from_files(docs.sparkSession.read.schema("doc_id long, text string").parquet(store))


def exact_dedup(docs: DataFrame, digest=sha256, max_bytes_per_trigger: int = 1 << 28, state: str | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group and its largest doc_id stays. A null text is the empty text. Rows without
    doc_id count in their group, but don't stay while another row has one; a group without any keeps
    none of them by id (keep_id null, kept true). A row repeated whole, doc_id too, is reported each
    time alike; ``deduplicated`` leaves one. An empty table gives an empty result, extra columns are ignored.
    ``digest`` may be any function of the text: collisions are found and resolved by comparing bytes.

    ``state`` is a folder that later calls name again: each adds its documents, and the result has the rows of all of
    them. It must not be shared by two calls at a time, and its documents are kept in it.
    """
    spark = docs.sparkSession
    feed_path = f"{state}/feed" if state else scratch(spark, "dedup-feed")
    new = located(docs, f"{state}/content" if state else None)
    rows = new
    if state and exists(spark, feed_path):  # only rows that the feed doesn't hold yet
        new = new.join(spark.read.parquet(feed_path).select("file", "at"), ["file", "at"], "left_anti")
    feed = new.select("doc_id", digest(F.col("text")).alias("digest"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "file", "at")
    feed.write.mode("append").parquet(feed_path)
    feed = spark.read.schema(feed.schema).parquet(feed_path)
    groups = written(copy_groups(feed_path, feed.schema, docs, max_bytes_per_trigger, f"{state}/stream" if state else scratch(spark, "dedup-state")), "dedup-groups")

    # with few groups, texts and digests stay where they are; with many, they are shuffled once
    few = if_small(groups, BROADCAST_GROUPS)

    # hits: the bytes of every row in a group against the bytes of the row that stays
    members = written(rows.withColumn("digest", digest(F.col("text"))).join(few.select("digest"), "digest").select("digest", "doc_id", "text"), "dedup-members")
    # written, so that both sides of the join are plain shuffles, of which large partitions can be split
    stays = written(rows.join(few.select("file", "at", "digest"), ["file", "at"]).select("digest", F.col("text").alias("stays")), "dedup-stays")
    clash = written(members.join(stays, "digest").where("text <> stays").select("digest").distinct(), "dedup-clashes")
    plain = ["doc_id", "text_sha256", "keep_id", "n"]
    joined = feed.select("doc_id", "digest", "text_sha256").join(few.select("digest", "keep_id", "n"), "digest", "left")
    if not clash.isEmpty():
        split = members.join(clash, "digest").groupBy("digest", "text").agg(F.max("doc_id").alias("true_id"), F.count(F.lit(1)).alias("true_n"))
        split = split.select("digest", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "true_id", "true_n")
        joined = joined.join(split, ["digest", "text_sha256"], "left").select("doc_id", "text_sha256", F.when(F.col("true_n").isNull(), F.col("keep_id")).when(F.col("true_n") > 1, F.col("true_id")).alias("keep_id"), F.coalesce("true_n", "n").alias("n"))
    joined = joined.select(*plain)
    keep_id = F.when(F.coalesce("n", F.lit(1)) > 1, F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with their own columns: one row of every distinct text.

    Of rows that tie, as they repeat a doc_id and a text or have no doc_id, the one whose columns hash to the least
    stays. Null counts as the empty text; an empty table gives an empty one.
    """
    columns = docs.columns
    sha, keep = unused(columns, "sha"), unused(columns, "keep")
    marks = written(exact_dedup(docs, **options), "dedup-marks")
    copies = marks.where("group_size > 1").select(F.col("text_sha256").alias(sha), F.struct("keep_id").alias(keep)).distinct()
    copies = if_small(written(copies, "dedup-copies"), BROADCAST_GROUPS)
    own = docs.withColumn(sha, F.sha2(text_of().cast("binary"), 256)).join(copies, sha, "left")
    quoted = [f"`{c}`" for c in columns]
    alone = own.where(F.col(keep).isNull()).select(*quoted)
    tied = own.where(F.col(keep).isNotNull() & F.col("doc_id").cast("long").eqNullSafe(F.col(keep)["keep_id"]))
    chosen = tied.groupBy(sha).agg(F.min_by(F.struct(*quoted), F.xxhash64(*quoted)).alias(keep)).select(f"{keep}.*")
    return alone.union(chosen)
