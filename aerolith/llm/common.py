"""Helpers that the operators of this subpackage share: shared scratch tables and words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: ASCII white space, as ``bytes.split()`` sees it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset (one machine, tests)
    a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="aerolith-"))
            current = spark.sparkContext.getCheckpointDir()
        found = current
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs the tasks that were running, not the work before. The table's path is put in
    ``paths``, if given, for ``remove_all``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_all(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that no later plan reads."""
    for path in paths:
        remove(spark, path)
    paths.clear()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Give memory that a Python worker has freed back to the system, as the worker goes on to serve other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(name: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose values in a text column have at most so many bytes; a longer value is a slice by itself."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        low, before = 0, 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(low, high - low)
            low, before = high, int(ends[high - 1])


def bytes_of(texts: pa.Array) -> list[bytes]:
    """The texts in UTF-8."""
    return texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A number for each byte, the same for A-Z as for a-z, and an odd factor: a word's hash is a polynomial modulo 2^64.
_BYTES = np.random.Generator(np.random.Philox(20_240_229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTES[0x41:0x5B] = _BYTES[0x61:0x7B]
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of the texts, A-Z lowered, one text after the other, and how many each text has.

    Words stand between ASCII white space. Of n distinct words about n^2 / 2^65 pairs share a hash and count as the
    same. The empty word's hash, which no text holds, is that of 0.
    """
    raw = texts.cast(pa.large_string()).cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], "<i8")[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]) if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = ~_SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, ends))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    chars = _BYTES[data[inside]]
    at = np.flatnonzero(first[inside])
    sizes = np.diff(np.append(at, len(chars)))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), _FACTOR, dtype=np.uint64))
        chars *= powers[np.arange(len(chars)) - np.repeat(at, sizes)]
        sums = np.add.reduceat(chars, at)
        return mixed_bits(sums + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), counts


class Places:
    """Where 64-bit keys stand in a sorted array of distinct ones: a table of their first bits, then a few steps."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)  # in the order of signed numbers
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        self.first = np.searchsorted(self.keys, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 if it isn't there."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        wanted = keys.view(np.uint64) ^ np.uint64(1 << 63)
        at = self.first[wanted >> self.shift].astype(np.int64)
        rows = np.arange(len(keys))
        while len(rows):
            inside = at < len(self.keys)
            rows, at, wanted = rows[inside], at[inside], wanted[inside]
            found = self.keys[at]
            same = found == wanted
            out[rows[same]] = at[same]
            more = found < wanted
            rows, at, wanted = rows[more], at[more] + 1, wanted[more]
        return out


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered: other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); component is the smallest node reached.

    Labels are passed along edges and then followed one jump, until none changes; each round is a
    table in the shared folder. A jump is looked up once for each label, so a label that a giant component shares costs
    a row, and joined back by a plain shuffle, of which Spark splits large partitions. Nodes without edges don't
    appear. No edges give an empty table.
    """
    spark = edges.sparkSession
    old: list[str] = []

    def kept(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
        return written(df, name, paths)

    graph: list[str] = []
    both = kept(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), graph)
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), old)
    while True:
        this: list[str] = []
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        stepped = kept(labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("next")), this)
        jump = stepped.select("next").distinct().join(labels.select(F.col("node").alias("next"), F.col("component").alias("far")), "next")
        after = kept(stepped.join(if_small(jump), "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), (F.least("next", F.coalesce("far", "next")) != F.col("component")).alias("moved")), this)
        labels = after.select("node", "component")
        remove_all(spark, old)
        old = this
        if after.where("moved").isEmpty():
            remove_all(spark, graph)
            return labels


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The table marked for broadcast if it has at most so many rows, otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
