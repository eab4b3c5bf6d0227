"""Products of a tall table of vectors and a matrix of any size, both as tables of square blocks.

Vectors (key, v) are dealt to row blocks by a hash of their key and cut into column blocks; weights (row, col, value) are
cut the same way. Blocks that share an inner number are joined and multiplied where they meet, and the products of one
place are added up. No task holds more than a few blocks, whatever the sizes of either table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a block.
SIDE = 256

BLOCK = "rb int, kb int, keys array<long>, data binary"


def row_blocks(vectors: DataFrame, key: str, column: str, blocks: int, side: int = SIDE) -> DataFrame:
    """``BLOCK`` rows of vectors of one length: the rows of a block in order of key, a row for each of its column blocks."""
    dealt = vectors.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("rb"), F.struct(F.col(key).cast("long").alias("k"), F.col(column).alias("v")).alias("x"))
    rows = dealt.groupBy("rb").agg(F.sort_array(F.collect_list("x")).alias("x")).select("rb", F.col("x.k").alias("keys"), F.col("x.v").alias("v"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys = b.column("keys")[i].values
                v = b.column("v")[i].values.flatten().to_numpy().reshape(len(keys), -1)
                for kb in range(0, v.shape[1], side):
                    one = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                    yield pa.RecordBatch.from_arrays([b.column("rb").slice(i, 1), pa.array([kb // side], pa.int32()), one, pa.array([np.ascontiguousarray(v[:, kb : kb + side]).tobytes()], pa.binary())], ["rb", "kb", "keys", "data"])

    return rows.mapInArrow(cut, BLOCK)


def weight_blocks(weights: DataFrame, side: int = SIDE) -> DataFrame:
    """(kb, cb, data, width): blocks of (row, col, value); what is missing is zero. A block is one group of bounded size."""

    def pack(group: pa.Table) -> pa.Table:
        row, col = group["row"].to_numpy() % side, group["col"].to_numpy() % side
        m = np.zeros((int(group["height"][0].as_py()), int(group["width"][0].as_py())))
        m[row, col] = group["value"].to_numpy()
        return pa.table({"kb": group["kb"].slice(0, 1), "cb": group["cb"].slice(0, 1), "width": group["width"].slice(0, 1), "data": pa.array([m.tobytes()], pa.binary())})

    size = weights.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    at = weights.join(F.broadcast(size)).select("row", "col", "value", F.floor(F.col("row") / side).cast("int").alias("kb"), F.floor(F.col("col") / side).cast("int").alias("cb"), "rows", "cols")
    least = lambda total, block: F.least(F.lit(side), F.col(total) - F.col(block) * side).cast("int")
    return at.select("row", "col", "value", "kb", "cb", least("rows", "kb").alias("height"), least("cols", "cb").alias("width")).groupBy("kb", "cb").applyInArrow(pack, "kb int, cb int, width int, data binary")


def product(x: DataFrame, weights: DataFrame, bias: DataFrame, activation: str | None = None, side: int = SIDE) -> DataFrame:
    """``BLOCK`` rows of x times the weights, plus the bias (col, value); ``relu`` and ``sigmoid`` are known."""
    w = weight_blocks(weights, side).select("kb", "cb", "width", F.col("data").alias("weights"))
    columns = bias.groupBy(F.floor(F.col("col") / side).cast("int").alias("cb")).agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "value"))), lambda s: s["value"]).alias("plus"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, width = b.column("keys")[i].values, b.column("width")[i].as_py()
                left = np.frombuffer(b.column("data")[i].as_py()).reshape(len(keys), -1)
                right = np.frombuffer(b.column("weights")[i].as_py()).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([b.column("rb").slice(i, 1), b.column("cb").slice(i, 1), b.column("keys").slice(i, 1), pa.array([(left @ right).tobytes()], pa.binary())], ["rb", "cb", "keys", "data"])

    parts = x.join(w, "kb").select("rb", "cb", "keys", "width", "data", "weights").mapInArrow(multiply, "rb int, cb int, keys array<long>, data binary")

    def add(group: pa.Table) -> pa.Table:
        plus = np.array(group["plus"][0].as_py())
        total = sum(np.frombuffer(d.as_py()) for d in group["data"]).reshape(-1, len(plus)) + plus
        if activation == "relu":
            total = np.maximum(total, 0)
        elif activation == "sigmoid":
            total = 1 / (1 + np.exp(-total))
        elif activation is not None:
            raise ValueError(f"unknown activation: {activation}")
        return pa.table({"rb": group["rb"].slice(0, 1), "kb": group["cb"].slice(0, 1), "keys": group["keys"].slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    # as many products meet as the matrix has row blocks
    return parts.join(F.broadcast(columns) if columns.limit(100_000).count() < 100_000 else columns, "cb").groupBy("rb", "cb").applyInArrow(add, BLOCK)


def rows_of(x: DataFrame, key: str, side: int = SIDE) -> DataFrame:
    """(key, place, value) of a table of blocks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys = b.column("keys")[i].values.to_numpy()
                v = np.frombuffer(b.column("data")[i].as_py()).reshape(len(keys), -1)
                place = np.arange(v.shape[1]) + b.column("kb")[i].as_py() * side
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, v.shape[1])), pa.array(np.tile(place, len(keys))), pa.array(v.ravel())], [key, "place", "value"])

    return x.mapInArrow(unpack, f"{key} long, place long, value double")


def decoded(vectors: DataFrame, weights: DataFrame, layers: list[tuple[str, str]], key: str, column: str, rows: int = 1024, side: int = SIDE) -> DataFrame:
    """(key, place, value): vectors through layers (name, activation) of a weight table (layer, row, col, value), bias last.

    Vectors are all of one length. Keys are told apart by number; no vectors give no rows.
    """
    count = vectors.count()
    x = row_blocks(vectors, key, column, max(1, -(-count // rows)), side)
    last = {r["layer"]: r["last"] for r in weights.groupBy("layer").agg(F.max("row").alias("last")).collect()}  # one row a layer
    for name, activation in layers:
        own = weights.where(F.col("layer") == name)
        x = product(x, own.where(F.col("row") < last[name]), own.where(F.col("row") == last[name]), activation, side)
    return rows_of(x, key, side)
