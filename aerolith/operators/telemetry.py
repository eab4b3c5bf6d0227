"""Training telemetry as windows over metric series: (series, step, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..functions.scalars import lit
from ..session import materialized


def series(keys: tuple[str, ...], order: tuple[str, ...]):
    return W.partitionBy(*keys).orderBy(*order)


def trailing_mean(df: DataFrame, value: str, keys: tuple[str, ...], order: tuple[str, ...], width: int = 10, out: str = "trailing") -> DataFrame:
    """Mean of the last ``width`` values, of all while there are fewer."""
    return df.withColumn(out, F.avg(value).over(series(keys, order).rowsBetween(1 - width, 0)))


def exponential_mean(df: DataFrame, value: str, keys: tuple[str, ...], order: tuple[str, ...], decay: float, start: float | None = None, out: str = "ema") -> DataFrame:
    """e <- decay e + (1 - decay) p along each series, from ``start`` or from the first value."""
    return affine_scan(df, keys, order, lit(decay), (1 - decay) * F.col(value), lit(start) if start is not None else F.col(value), out)


def mean_reverting(df: DataFrame, noise: str, keys: tuple[str, ...], order: tuple[str, ...], pull: float = 0.15, spread: float = 0.2, mean: float = 0.0, out: str = "state") -> DataFrame:
    """x <- x + pull (mean - x) + spread noise along each series, from the mean."""
    return affine_scan(df, keys, order, lit(1.0 - pull), pull * mean + spread * F.col(noise), lit(mean), out)


def composed(factor: np.ndarray, term: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the map s -> a s + b of all rows from its series' first one on; ``begin`` is where that stands."""
    a, b, at, step = factor.copy(), term.copy(), np.arange(len(factor)), 1
    while step < len(a):
        rows = np.flatnonzero(at - step >= begin)
        if not len(rows):
            break
        a[rows], b[rows] = a[rows] * a[rows - step], a[rows] * b[rows - step] + b[rows]
        step *= 2
    return a, b


def affine_scan(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], factor: Column, term: Column, start: Column, out: str = "state") -> DataFrame:
    """Adds s <- factor s + term along each series; before its first row s is what ``start`` says there.

    Maps s -> a s + b compose to maps of their kind. Rows are dealt by ranges of key and order, so a long series lies in
    many tasks, and each composes the maps of its own rows. Only the first series of a range waits for the range before;
    the ranges' last maps, one row each, are applied one after the other, and what enters a range goes to its waiting
    rows. Where factor or term is null, s stays as it is.
    """
    spark = df.sparkSession
    known = factor.isNotNull() & term.isNotNull()
    rows = df.withColumns({"_a": F.when(known, factor).otherwise(lit(1.0)), "_b": F.when(known, term).otherwise(lit(0.0)), "_s": F.coalesce(start, lit(0.0)), "_key": F.xxhash64(*keys) if keys else F.lit(0).cast("long")})

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, held, count, waiting = TaskContext.get().partitionId(), None, (1.0, 0.0), 0, True
        for b in batches:
            if not b.num_rows:
                continue
            key, starts = b.column("_key").to_numpy(), b.column("_s").to_numpy()
            first = np.ones(b.num_rows, dtype=bool)
            first[1:] = key[1:] != key[:-1]
            goes_on = last is not None and key[0] == last
            segment = np.cumsum(first) - 1
            begin = np.flatnonzero(first)[segment]
            a, t = composed(b.column("_a").to_numpy(), b.column("_b").to_numpy(), begin)
            head = segment == 0
            if goes_on:
                a, t = np.where(head, a * held[0], a), np.where(head, a * held[1] + t, t)
            waits = head & (waiting and (goes_on or last is None))
            done = ~waits & ~(head & goes_on)
            t = np.where(done, a * starts[begin] + t, t)
            a = np.where(done, 0.0, a)
            last, held, waiting = key[-1], (float(a[-1]), float(t[-1])), bool(waits[-1])
            names = [n for n in b.schema.names if n not in ("_a", "_b")]
            more = [pa.array(a), pa.array(t), pa.array(waits), pa.array(np.full(b.num_rows, part)), pa.array(np.arange(count, count + b.num_rows))]
            count += b.num_rows
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *more], [*names, "_a", "_b", "_waits", "_range", "_n"])

    kept = [f for f in rows.schema.fields if f.name not in ("_a", "_b")]
    shape = StructType([*kept, *[StructField(n, t) for n, t in (("_a", DoubleType()), ("_b", DoubleType()), ("_waits", BooleanType()), ("_range", LongType()), ("_n", LongType()))]])
    dealt = materialized(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(compose, shape), "scan")
    ends = dealt.groupBy("_range").agg(F.min_by(F.struct("_key", "_s"), "_n").alias("first"), F.max_by(F.struct("_key", "_a", "_b", "_waits"), "_n").alias("last"))
    entering, key, state = [(-1, 0.0)], None, 0.0
    for r in ends.orderBy("_range").collect():  # one row a range
        into = state if key == r["first"]["_key"] else r["first"]["_s"]
        entering.append((r["_range"], into))
        key, state = r["last"]["_key"], r["last"]["_a"] * into + r["last"]["_b"]
    carried = spark.createDataFrame(entering, "_range long, _into double")
    return dealt.join(F.broadcast(carried), "_range").withColumn(out, F.col("_a") * F.col("_into") + F.col("_b")).drop("_a", "_b", "_s", "_key", "_waits", "_range", "_n", "_into")


def soft_update(target, online, tau: float = 0.005):
    """tau online + (1 - tau) target, for array columns of parameters."""
    return F.zip_with(target, online, lambda t, o: tau * o + (1 - tau) * t)


def early_stopping(df: DataFrame, value: str, keys: tuple[str, ...], order: tuple[str, ...], patience: int = 10) -> DataFrame:
    """Adds best (so far), waited (steps since it improved) and stop."""
    w = series(keys, order)
    before = F.min(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn("_better", (before.isNull() | (F.col(value) < before)).cast("int"))
    df = df.withColumn("_run", F.sum("_better").over(w)).withColumn("best", F.min(value).over(w))
    run = W.partitionBy(*keys, "_run").orderBy(*order)
    return df.withColumn("waited", F.row_number().over(run) - 1).withColumn("stop", F.col("waited") >= patience).drop("_better", "_run")


def every(df: DataFrame, step: str, k: int) -> DataFrame:
    return df.where(F.col(step) % k == 0)


def episodes(df: DataFrame, done: str, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Adds episode: 0, 1, ... along each series; the row that is done is the last of its episode."""
    w = series(keys, order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("episode", F.coalesce(F.sum(F.col(done).cast("long")).over(w), F.lit(0)))


def episode_totals(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys, "episode").agg(F.sum(value).alias("total"), F.max(value).alias("best"), F.count(F.lit(1)).alias("steps"))


def ring_buffer(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], size: int) -> DataFrame:
    """The last ``size`` rows of each series."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_age", F.row_number().over(w)).where(F.col("_age") <= size).drop("_age")


def first_of(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], count: int) -> DataFrame:
    """The first ``count`` rows of each series."""
    return df.withColumn("_at", F.row_number().over(series(keys, order))).where(F.col("_at") <= count).drop("_at")


def random_walk(df: DataFrame, step: str, keys: tuple[str, ...], order: tuple[str, ...], out: str = "state") -> DataFrame:
    """Running sum of steps along each series."""
    return df.withColumn(out, F.sum(step).over(series(keys, order)))


def numbered(df: DataFrame, order: tuple[str, ...], out: str = "place") -> DataFrame:
    """Adds the place of each row in the given order, from 0.

    Rows are dealt out by ranges, each task numbers its own, and the counts of the ranges before are added: no task
    sees the whole table.
    """
    own = F.monotonically_increasing_id()
    rows = materialized(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_own", own), "numbered")
    rows = rows.withColumns({"_range": F.shiftright("_own", 33), "_own": F.col("_own").bitwiseAND((1 << 33) - 1)})
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_before"))
    return rows.join(F.broadcast(starts), "_range").withColumn(out, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def ranked(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the rank of a value in the whole table, from 1; equal values share the smallest of their places."""
    placed = numbered(df, (value,), "_at")
    first = placed.groupBy(value).agg((F.min("_at") + 1).alias(out))
    return placed.drop("_at").join(first, value)


def split(df: DataFrame, order: tuple[str, ...], held_out: float = 0.2) -> DataFrame:
    """Adds part: the first n - floor(n held_out) rows by place are for training."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(df, order, "_at").join(F.broadcast(n))
    return placed.withColumn("part", F.when(F.col("_at") + 1 <= F.col("_n") - F.floor(F.col("_n") * held_out), "train").otherwise("validate")).drop("_at", "_n")


def batched(df: DataFrame, size: int, order: tuple, out: str = "batch") -> DataFrame:
    """Adds the number of each row's mini-batch in the given order."""
    return numbered(df, order, "_at").withColumn(out, F.floor(F.col("_at") / size)).drop("_at")


def sampled(df: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``count`` rows without replacement: those with the smallest hash of seed and key."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(mark, key).limit(count)


def epoch_means(df: DataFrame, value: str, epoch: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, epoch).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("batches"))


def td_target(reward, next_value, done, gamma: float = 0.99):
    return reward + gamma * next_value * (1.0 - done.cast("double"))


def softmax(df: DataFrame, score: str, keys: tuple[str, ...], out: str = "weight") -> DataFrame:
    """exp(s - max) over its sum within each group."""
    w = W.partitionBy(*keys)
    df = df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return df.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def zipped(left: DataFrame, right: DataFrame, left_order: tuple[str, ...], right_order: tuple[str, ...], out: str = "place") -> DataFrame:
    """Rows of both tables side by side, by their places in their own orders, as far as the shorter one goes.

    Places are numbered by ranges, and both sides dealt once by place into as many parts; rows are looked up by hash
    there, so neither side is sorted by place. Columns of the right table are told apart by ``right_`` where they clash.
    """
    a, b = numbered(left, left_order, "_place"), numbered(right, right_order, "_place")
    taken = {c.lower() for c in left.columns}
    b = b.withColumnsRenamed({c: f"right_{c}" for c in right.columns if c.lower() in taken})
    return a.join(b.hint("shuffle_hash"), "_place").withColumnRenamed("_place", out)
