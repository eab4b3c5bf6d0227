"""Adaptive refinement: blocks as rows, cells keyed by block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lit


def marked(blocks: DataFrame, fields: DataFrame, max_levels: int, q_limit: float = 0.2, vorticity_limit: float = 100.0) -> DataFrame:
    """Leaf blocks whose largest q or vorticity is over its limit and that may still be divided: (block_id)."""
    worst = fields.groupBy("block_id").agg(F.max("q").alias("q"), F.max("vorticity").alias("vorticity")).where((F.col("q") > q_limit) | (F.col("vorticity") > vorticity_limit))
    return blocks.where(F.col("is_leaf") & (F.col("level") < max_levels - 1)).join(worst, "block_id", "left_semi").select("block_id")


def refined(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """The block table after division of the chosen leaves into eight octants each.

    A child's id is 8 times its parent's plus 1 to 8, over all ids of its level; origins count cells of half blocks,
    as the parents' do.
    """
    hit = chosen.select("block_id", F.lit(True).alias("_hit"))
    known = blocks.join(hit, "block_id", "left")
    parents = known.withColumn("is_leaf", F.col("is_leaf") & F.col("_hit").isNull()).drop("_hit")
    octant = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("o")
    children = known.where(F.col("_hit") & F.col("is_leaf")).select("block_id", "level", "ox", "oy", "oz", "size", octant)
    half = lambda bit: (F.shiftright("o", bit).bitwiseAND(F.lit(1)) * F.col("size") / 2).cast("int")
    children = children.select(((F.col("block_id") + 1) * 8 + F.col("o")).alias("block_id"), F.col("block_id").alias("parent_id"), (F.col("level") + 1).alias("level"), (F.col("ox") + half(2)).cast("int").alias("ox"), (F.col("oy") + half(1)).cast("int").alias("oy"), (F.col("oz") + half(0)).cast("int").alias("oz"), "size", F.lit(True).alias("is_leaf"))
    return parents.select(*children.columns).unionByName(children)


def prolonged(parents: DataFrame, size: int, fields: tuple[str, ...]) -> DataFrame:
    """Cells of the eight children of each block (block_id, x, y, z, fields): (block_id, octant, x, y, z, fields).

    Each octant of the parent is stretched to the full block by trilinear interpolation with end cells on end cells.
    """
    spark = parents.sparkSession
    half, scale = size // 2, (size // 2 - 1) / (size - 1)
    at = spark.range(8 * size**3).select((F.col("id") / size**3).cast("int").alias("octant"), *[(F.col("id") / size**k % size).cast("int").alias(a) for a, k in (("cx", 2), ("cy", 1), ("cz", 0))])
    corner = F.explode(F.array(*[F.struct(*[F.lit(i >> s & 1).alias(f"d{a}") for a, s in (("x", 2), ("y", 1), ("z", 0))]) for i in range(8)])).alias("d")
    at = at.select("octant", "cx", "cy", "cz", corner)
    place = {a: F.col(f"c{a}") * scale for a in "xyz"}
    weight = lit(1.0)
    for a in "xyz":
        part = place[a] - F.floor(place[a])
        weight = weight * F.when(F.col(f"d.d{a}") == 1, part).otherwise(1.0 - part)
    shift = {a: F.shiftright("octant", s).bitwiseAND(F.lit(1)) * half for a, s in (("x", 2), ("y", 1), ("z", 0))}
    at = at.withColumn("w", weight).withColumns({a: (shift[a] + F.least(F.lit(half - 1), F.floor(place[a]) + F.col(f"d.d{a}"))).cast("int") for a in "xyz"}).where("w > 0")
    met = parents.select("block_id", "x", "y", "z", *fields).join(F.broadcast(at.drop("d")), ["x", "y", "z"])
    return met.groupBy("block_id", "octant", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")).agg(*[F.sum(F.col("w") * F.col(f)).alias(f) for f in fields])


def subcycles(blocks: DataFrame) -> DataFrame:
    """(substep, level, blocks): level l is due in every 2^(deepest - l)-th of 2^deepest substeps."""
    leaves = blocks.where("is_leaf").groupBy("level").agg(F.count(F.lit(1)).alias("blocks"))
    deepest = leaves.agg(F.max("level").alias("deepest"))
    due = leaves.join(F.broadcast(deepest)).withColumn("substep", F.explode(F.sequence(F.lit(0), F.pow(lit(2.0), F.col("deepest")).cast("int") - 1)))
    return due.where(F.col("substep") % F.pow(lit(2.0), (F.col("deepest") - F.col("level"))).cast("int") == 0).select("substep", "level", "blocks")


def per_level(blocks: DataFrame) -> DataFrame:
    return blocks.where("is_leaf").groupBy("level").agg(F.count(F.lit(1)).alias("blocks"))


def new_tree(spark: SparkSession, base: int, block: int) -> DataFrame:
    from ..sources.grids import root_blocks

    return root_blocks(spark, base, block)
