"""Streams of metrics: append-only logs, windows with late data, and bounded buffers with keyed state.

The engine's own additions: the solvers it mirrors only append scalars to a log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import shared_dir


def metric_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(events: DataFrame, ts: str, value: str, keys: tuple[str, ...], length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean of each window; rows later than ``late`` behind the newest are dropped."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total", "mean")


def sessions(events: DataFrame, ts: str, keys: tuple[str, ...], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote, as a table in the shared folder.

    Each batch writes a folder of its own, so a batch that is run again replaces itself.
    """
    import uuid

    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{at}/rows")


STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Replay(StatefulProcessor):
    """The last ``size`` rows of each key in list state; a key that is idle longer than ``idle`` is forgotten by a timer.

    It puts out what it holds after every batch with rows of the key, and a row of zero kept when it forgets.
    """

    def __init__(self, key: str, size: int, idle: float):
        self.key, self.size, self.idle = key, size, int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ts timestamp, id long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        for pdf in rows:
            held += list(pdf[["ts", "id", "value"]].itertuples(index=False, name=None))
        held = sorted(held)[-self.size :]
        self.held.put([(pd.Timestamp(ts).to_pydatetime(), int(i), float(v)) for ts, i, v in held])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        newest = int(pd.Timestamp(held[-1][0]).timestamp() * 1000)
        self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.idle)
        yield self.row(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield self.row(key, [])

    def row(self, key: tuple, held: list[tuple]) -> pd.DataFrame:
        ends = (held[0][1], held[-1][1]) if held else (None, None)
        mean = sum(v for _, _, v in held) / len(held) if held else None
        return pd.DataFrame({self.key: pd.Series([key[0]], dtype=object), "kept": [len(held)], "oldest": pd.Series([ends[0]], dtype="Int64"), "newest": pd.Series([ends[1]], dtype="Int64"), "mean": pd.Series([mean], dtype="float64")})

    def close(self) -> None:
        pass


class ScalarLog(StatefulProcessor):
    """Scalars of a tag, one for every ``every`` rows: their mean and the number of the interval, as they fill up."""

    def __init__(self, key: str, every: int):
        self.key, self.every = key, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "step long, n long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        step, n, total = tuple(self.sums.get()) if self.sums.exists() else (0, 0, 0.0)
        values = pd.concat(list(rows)).sort_values(["ts", "id"])["value"].tolist()
        out = []
        while n + len(values) >= self.every:
            took, values = values[: self.every - n], values[self.every - n :]
            out.append((step, (total + sum(took)) / self.every))
            step, n, total = step + 1, 0, 0.0
        self.sums.update((step, n + len(values), total + sum(values)))
        yield pd.DataFrame({self.key: pd.Series([key[0]] * len(out), dtype=object), "step": [s for s, _ in out], "mean": [m for _, m in out]}).astype({"step": "int64", "mean": "float64"})

    def close(self) -> None:
        pass


def replayed(events: DataFrame, key: str, size: int, late: str = "10 minutes", idle: float = 86_400.0) -> DataFrame:
    """(key, kept, oldest, newest, mean) of rows (key, ts, id, value): what each key's buffer holds, whenever it changes.

    Rows later than ``late`` behind the newest are dropped; seconds of ``idle`` event time forget a key.
    """
    kind = dict(events.dtypes)[key]
    grouped = events.select(key, "ts", "id", "value").withWatermark("ts", late).groupBy(key)
    return grouped.transformWithStateInPandas(Replay(key, size, idle), f"{key} {kind}, kept long, oldest long, newest long, mean double", "Update", "eventTime")


def logged(events: DataFrame, key: str, every: int) -> DataFrame:
    """(key, step, mean) of rows (key, ts, id, value) that arrive in order of ts and id."""
    kind = dict(events.dtypes)[key]
    return events.select(key, "ts", "id", "value").groupBy(key).transformWithStateInPandas(ScalarLog(key, every), f"{key} {kind}, step long, mean double", "Append", "none")


def run_on(stream: DataFrame, at: str, mode: str) -> DataFrame:
    """Run a stream over all that is there, or on from where it stopped, and return all it has put out, with its batch.

    ``at`` holds its progress, its state and a folder for each batch: a batch that is run again replaces its own folder,
    so nothing is put out twice.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    shape = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(shape).parquet(f"{at}/rows")


def fed(rows: DataFrame, path: str, part: Column) -> None:
    """Append the rows where ``part`` holds as a file that a stream finds."""
    rows.where(part).coalesce(1).write.mode("append").parquet(path)
