"""Connected components of voxel grids, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lit
from ..session import materialized, remove_all


def adjacency(solid: DataFrame, n: int, key: str = "design_id") -> DataFrame:
    """(key, a, b): pairs of solid cells with a common face, each once; cell = (x n + y) n + z."""
    cell = (F.col("x") * n + F.col("y")) * n + F.col("z")
    cells = solid.select(key, "x", "y", "z", cell.alias("a"))
    steps = F.array(*[F.when(F.col(axis) < n - 1, F.col("a") + by) for axis, by in (("x", n * n), ("y", n), ("z", 1))])
    pairs = cells.select(key, "a", F.explode(steps).alias("b")).where("b is not null")
    return pairs.join(cells.select(key, F.col("a").alias("b")), [key, "b"], "left_semi").select(key, "a", "b")


def labelled(solid: DataFrame, n: int, key: str = "design_id") -> DataFrame:
    """(key, cell, label): label is the smallest cell of the component.

    Labels spread to neighbours and then jump to the label of their label; each round is a table in the shared
    folder, and rounds grow with the logarithm of the longest path, not with its length.
    """
    cell = (F.col("x") * n + F.col("y")) * n + F.col("z")
    pairs = adjacency(solid, n, key)
    graph: list[str] = []
    old: list[str] = []
    both = materialized(pairs.union(pairs.select(key, "b", "a")), "components-pairs", graph)
    labels = materialized(solid.select(key, cell.alias("cell"), cell.alias("label")), "components", old)
    while True:
        this: list[str] = []
        heard = both.join(labels.select(key, F.col("cell").alias("b"), F.col("label").alias("other")), [key, "b"]).groupBy(key, F.col("a").alias("cell")).agg(F.min("other").alias("heard"))
        near = labels.join(heard, [key, "cell"], "left").select(key, "cell", "label", F.least("label", F.coalesce("heard", "label")).alias("near"))
        # each label is looked up once, so that one which a giant component shares costs a row
        jump = near.select(key, "near").distinct().join(labels.select(key, F.col("cell").alias("near"), F.col("label").alias("far")), [key, "near"])
        after = near.join(jump, [key, "near"]).select(key, "cell", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved"))
        after = materialized(after, "components", this)
        labels = after.select(key, "cell", "label")
        remove_all(solid.sparkSession, old)
        old = this
        if after.where("moved").isEmpty():
            remove_all(solid.sparkSession, graph)
            return labels


def sizes(labels: DataFrame, key: str = "design_id") -> DataFrame:
    return labels.groupBy(key, "label").agg(F.count(F.lit(1)).alias("cells"))


def largest(component_sizes: DataFrame, key: str = "design_id") -> DataFrame:
    return component_sizes.groupBy(key).agg(F.count(F.lit(1)).alias("components"), F.max("cells").alias("largest"), F.sum("cells").alias("total"))


def connectivity_penalty(designs: DataFrame, component_sizes: DataFrame, penalty: float = 10.0, key: str = "design_id") -> DataFrame:
    """One row: penalty times the mean over designs of the share of cells outside the largest of several components."""
    per = largest(component_sizes, key).select(key, F.when(F.col("components") > 1, (F.col("total") - F.col("largest")) / (F.col("total") + 1e-6)).otherwise(lit(0.0)).alias("loose"))
    return designs.select(key).distinct().join(per, key, "left").agg((lit(penalty) * F.avg(F.coalesce("loose", lit(0.0)))).alias("penalty"))


def occupancy(voxels: DataFrame, threshold: float = 0.5, key: str = "design_id") -> DataFrame:
    """(key, filled, cells, percent)."""
    filled = F.count_if(F.col("p") > threshold)
    return voxels.groupBy(key).agg(filled.alias("filled"), F.count(F.lit(1)).alias("cells"), (100.0 * filled / F.count(F.lit(1))).alias("percent"))


def bounding_box(solid: DataFrame, key: str = "design_id") -> DataFrame:
    """(key, x_min, x_max, x_extent, ...) of solid cells."""
    sides = [c for a in "xyz" for c in (F.min(a).alias(f"{a}_min"), F.max(a).alias(f"{a}_max"), (F.max(a) - F.min(a) + 1).alias(f"{a}_extent"))]
    return solid.groupBy(key).agg(*sides)


def report(voxels: DataFrame, n: int, key: str = "design_id") -> DataFrame:
    """Occupancy, components and bounding box of each design."""
    solid = voxels.where("p > 0.5")
    return occupancy(voxels, key=key).join(largest(sizes(labelled(solid, n, key), key), key), key, "left").join(bounding_box(solid, key), key, "left")


def resampled(voxels: DataFrame, n: int, m: int, key: str = "design_id") -> DataFrame:
    """Nearest resampling of n^3 to m^3 cells: target i takes cell floor(i n / m)."""
    side = F.sequence(F.lit(0), F.lit(m - 1))
    takes = lambda c: F.filter(side, lambda i: F.floor(i * n / lit(m)).cast("int") == F.col(c))
    out = voxels.withColumns({f"_{a}": takes(a) for a in "xyz"})
    for a in "xyz":
        out = out.withColumn(a, F.explode(f"_{a}"))
    return out.drop("_x", "_y", "_z")
