"""Three-dimensional convolutions over tiled grids: cells are dealt to tiles, and borders go to the tiles beside them once.

cell(key, x, y, z, feat) with all cells of an n^3 grid, feat a vector of channels. A tile and its border are one group of
bounded size, so a grid of any size is many tasks' work. Weights are a table (layer, row, col, value): row c * 27 + k holds
channel c of neighbour k, 9 (dx + 1) + 3 (dy + 1) + dz + 1, and the last row the bias.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialized, remove_all
from .networks import MOST_WEIGHTS, added, linear, model_row, with_model

#: Cells along the side of a tile.
SIDE = 16
#: Grids whose means may go to every task.
SMALL = 10_000


def matrices(weights: DataFrame) -> dict[str, np.ndarray]:
    """The matrices of a model of checked size, by layer."""
    rows = weights.limit(MOST_WEIGHTS + 1).toPandas()
    if len(rows) > MOST_WEIGHTS:
        raise ValueError("the model is too large to send to every task")
    out = {}
    for layer, own in rows.groupby("layer"):
        m = np.zeros((int(own["row"].max()) + 1, int(own["col"].max()) + 1))
        m[own["row"].to_numpy(), own["col"].to_numpy()] = own["value"].to_numpy()
        out[str(layer)] = m
    return out


def with_halo(cell: DataFrame, side: int) -> DataFrame:
    """Adds the tile (_tx, _ty, _tz): a row for the cell's own tile, and one for each tile that has it in its border."""
    near = lambda a: F.array_distinct(F.array(*[F.floor((F.col(a) + d) / side) for d in (0, -1, 1)]))
    out = cell
    for a in "xyz":
        out = out.withColumn(f"_t{a}", F.explode(near(a)))
    return out


def neighbours_summed(cell: DataFrame, matrix: np.ndarray, key: str, side: int = SIDE) -> DataFrame:
    """(key, x, y, z, feat): each cell's 27 neighbours and itself times the weights, zeros beyond the grid."""
    inputs, outputs = (len(matrix) - 1) // 27, matrix.shape[1]
    shared = cell.sparkSession.sparkContext.broadcast((matrix[:-1].reshape(inputs, 3, 3, 3, outputs), matrix[-1]))

    names = [key, "_tx", "_ty", "_tz"]

    def convolve(rows: pa.RecordBatch) -> pa.RecordBatch:
        w, bias = shared.value
        tile = np.cumsum(starts(rows)) - 1
        at = (tile, *[rows.column(a).to_numpy() - rows.column(f"_t{a}").to_numpy() * side + 1 for a in "xyz"])
        block = np.zeros((int(tile[-1]) + 1, side + 2, side + 2, side + 2, inputs))
        block[at] = rows.column("feat").flatten().to_numpy().reshape(-1, inputs)
        out = np.zeros((len(block), side, side, side, outputs)) + bias
        for dx in range(3):
            for dy in range(3):
                for dz in range(3):
                    out += block[:, dx : dx + side, dy : dy + side, dz : dz + side] @ w[:, dx, dy, dz]
        own = np.flatnonzero(np.logical_and.reduce([(a >= 1) & (a <= side) for a in at[1:]]))
        values = out[(tile[own], *[a[own] - 1 for a in at[1:]])]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * outputs, pa.int32()), pa.array(values.ravel()))
        kept = rows.take(pa.array(own))
        return pa.RecordBatch.from_arrays([*[kept.column(c) for c in (key, "x", "y", "z")], lists], [key, "x", "y", "z", "feat"])

    def starts(rows: pa.RecordBatch) -> np.ndarray:
        """Where another tile begins; rows of a tile follow each other."""
        first = np.ones(rows.num_rows, dtype=bool)
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (rows.column(n).to_numpy(zero_copy_only=False) for n in names)])
        return first

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                last = int(np.flatnonzero(starts(rows))[-1])
                if last:
                    yield convolve(rows.slice(0, last))
                held = [rows.slice(last)]
        if held:
            yield convolve(held[0])

    kinds = dict(cell.dtypes)
    dealt = with_halo(cell.select(key, "x", "y", "z", "feat"), side).repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(each, f"{key} {kinds[key]}, x {kinds['x']}, y {kinds['y']}, z {kinds['z']}, feat array<double>")


def instance_norm(cell: DataFrame, size: int, key: str, eps: float = 1e-5) -> DataFrame:
    """Each channel less its mean over the grid, over its population deviation; the sums are one row a grid."""
    sums = cell.groupBy(key).agg(*[F.avg(F.col("feat")[i]).alias(f"_m{i}") for i in range(size)], *[F.var_pop(F.col("feat")[i]).alias(f"_v{i}") for i in range(size)])
    stats = sums.select(key, F.array(*[F.struct(F.col(f"_m{i}").alias("m"), F.sqrt(F.col(f"_v{i}") + eps).alias("s")) for i in range(size)]).alias("_stats"))
    stats = F.broadcast(stats) if stats.limit(SMALL + 1).count() <= SMALL else stats
    return cell.join(stats, key).withColumn("feat", F.zip_with("feat", "_stats", lambda x, s: (x - s["m"]) / s["s"])).drop("_stats")


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v / (1.0 + F.exp(-v)))


def residual_block(cell: DataFrame, time: DataFrame, weights: DataFrame, inputs: int, outputs: int, key: str = "id", side: int = SIDE) -> DataFrame:
    """(key, x, y, z, feat): two rounds of norm, SiLU and convolution, with the time (key, t) between, and the input added.

    Layers are conv1, conv2, time1, time2 and, where the numbers of channels differ, skip, which maps each cell's input.
    Grids without a time are left out.
    """
    spark, paths = cell.sparkSession, []
    matrix, model = matrices(weights), model_row(weights.where("layer in ('time1', 'time2', 'skip')"))
    shift = with_model(time, model).select(key, linear(silu(linear(F.col("t"), "time1")), "time2").alias("_shift"))

    def block(df: DataFrame, layer: str, size: int) -> DataFrame:
        active: Callable[[DataFrame], DataFrame] = lambda d: d.withColumn("feat", silu(F.col("feat")))
        return neighbours_summed(active(instance_norm(df, size, key)), matrix[layer], key, side)

    one = block(cell, "conv1", inputs).join(shift, key).withColumn("feat", added(F.col("feat"), F.col("_shift"))).drop("_shift")
    two = block(materialized(one, "residual", paths), "conv2", outputs).withColumnRenamed("feat", "_h")
    both = with_model(two.join(cell.select(key, "x", "y", "z", "feat"), [key, "x", "y", "z"]), model)
    skip = linear(F.col("feat"), "skip") if "skip" in matrix else F.col("feat")
    out = materialized(both.select(key, "x", "y", "z", added(F.col("_h"), skip).alias("feat")), "residual")
    remove_all(spark, paths)
    return out


def morton(x: Column, y: Column, z: Column, bits: int) -> Column:
    """Place of a cell on the Z-order curve: bits of x, y and z in turn, the highest first."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for place, a in enumerate((z, y, x)):
            bit = F.shiftright(a.cast("long"), k).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, 3 * k + place))
    return out


def pyramid(cell: DataFrame, value: str, bits: int, key: str = "design_id", inner: int = 4) -> DataFrame:
    """(key, level, at, cells, mean) of a 2^bits grid at every resolution: level 0 is the finest, ``at`` its Z-order place.

    Cells are dealt by the first bits of their place, so up to ``inner`` levels are rolled up where they lie, each from the
    one below by dropping three bits; only what is left of those goes through another shuffle. Written in order of level
    and place, a level or a block of it is a range of rows.
    """
    low = min(inner, bits)
    at = morton(F.col("x"), F.col("y"), F.col("z"), bits)
    base = cell.select(key, at.alias("at"), F.col(value).cast("double").alias("_s"), F.lit(1).cast("long").alias("_c")).withColumn("_chunk", F.shiftright("at", 3 * low)).repartition(key, "_chunk")

    def up(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys, F.shiftright("at", 3).alias("at")).agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))

    levels = [base.groupBy(key, "_chunk", "at").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))]
    for _ in range(low):
        levels.append(up(levels[-1], key, "_chunk"))
    for _ in range(low, bits):
        levels.append(up(levels[-1], key))
    rows = [df.select(key, F.lit(k).alias("level"), "at", F.col("_c").alias("cells"), (F.col("_s") / F.col("_c")).alias("mean")) for k, df in enumerate(levels)]
    out = rows[0]
    for df in rows[1:]:
        out = out.union(df)
    return out


def save_pyramid(rows: DataFrame, path: str, key: str = "design_id") -> None:
    """A folder for each level, in order of place, so that a block is read by ranges of ``at``."""
    rows.repartitionByRange("level", key, "at").sortWithinPartitions("level", key, "at").write.partitionBy("level").mode("overwrite").parquet(path)


def epochs_of(level: Column, epochs: int) -> Column:
    """Rounds at a resolution: all at the finest, half at the others, one at least."""
    return F.when(level == 0, F.lit(epochs)).otherwise(F.lit(max(1, epochs // 2)))
