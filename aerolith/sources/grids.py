"""Sources that are computed: grids, sheets, ranges, actions and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lit

SHEET = (0.210, 0.297)
#: Operation codes of the control program; two codes occur twice. Fixed values.
OPCODES = {
    "emg_land_lat": 0b000000, "emglandlong": 0b000001, "qdest_fin_lat": 0b000010, "qdest_fin_long": 0b000011, "qloc_lat": 0b000100, "qloc_long": 0b000101,
    "q_airspd": 0b000110, "qtype": 0b000111, "qspdmax": 0b001000, "r_freq_change": 0b001001, "a_freq_change": 0b001001, "dfreq_change": 0b001011,
    "r_spd_change": 0b001100, "a_spd_change": 0b001101, "qscup": 0b001110, "qsclow": 0b001110, "q_load": 0b010001, "r_change_br": 0b010010,
    "a_change_br": 0b010011, "mayday": 0b010100, "wypnt_rchd": 0b011000, "wypnt_unrchd": 0b011001, "cllsn": 0b011010,
}


def cells(spark: SparkSession, n: int, sims: DataFrame | None = None, key: str = "sim_id") -> DataFrame:
    """(key, x, y, z, cell): a grid of n^3 cells for each row of ``sims`` (one grid numbered 0 without it)."""
    base = spark.range(n**3).select((F.col("id") / (n * n)).cast("int").alias("x"), (F.col("id") / n % n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("z"), F.col("id").alias("cell"))
    if sims is None:
        return base.select(F.lit(0).cast("long").alias(key), "x", "y", "z", "cell")
    return sims.select(key).crossJoin(F.broadcast(base))


def constant_grid(spark: SparkSession, n: int, value: float = 1e-12) -> DataFrame:
    return cells(spark, n).withColumn("value", lit(value))


def aircraft_solid(n: int, scale: float = 1.0) -> Column:
    """Fuselage cylinder or wing slabs; distances are for a grid of 32 and scale with it."""
    x, y, z, c = F.col("x"), F.col("y"), F.col("z"), n // 2
    fuselage = (F.hypot((x - c).cast("double"), (z - c).cast("double")) < 6 * scale) & (y > 10 * scale) & (y < 22 * scale)
    wings = (y > 8 * scale) & (y < 24 * scale) & ((z < 4 * scale) | (z > n - 4 * scale))
    return fuselage | wings


def aircraft_designs(spark: SparkSession, n: int, designs: DataFrame | None = None, noise: bool = True) -> DataFrame:
    """(design_id, x, y, z, p): synthetic designs. The noise of at most 0.1 can't turn a cell over the threshold."""
    grid = cells(spark, n, designs, "design_id")
    p = aircraft_solid(n, n / 32).cast("double")
    if noise:
        p = (p + 0.1 * (F.pmod(F.xxhash64("design_id", "cell"), F.lit(1000)) / 1000.0) > 0.5).cast("double")
    return grid.withColumn("p", p)


def hashed_solid() -> Column:
    """A scattered solid for component tests, from integer arithmetic alone."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return (31 * x + 57 * y + 91 * z + 13 * x * y * z) % 101 < 30


def linspace(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """(k, value): n equally spaced numbers, both ends included; one number is the low end."""
    return spark.range(n).select(F.col("id").cast("int").alias("k"), (lit(low) + lit(high - low) * F.col("id") / lit(max(1, n - 1))).alias("value"))


def sheet_vertices(spark: SparkSession, resolution: int, width: float = SHEET[0], height: float = SHEET[1]) -> DataFrame:
    """(v, x, y, z) of a flat sheet: (resolution + 1)^2 vertices in row order."""
    m = resolution + 1
    return spark.range(m * m).select(F.col("id").cast("int").alias("v"), (F.col("id") % m / lit(resolution) * width).alias("x"), ((F.col("id") / m).cast("int") / lit(resolution) * height).alias("y"), lit(0.0).alias("z"))


def sheet_faces(spark: SparkSession, resolution: int) -> DataFrame:
    """(t, a, b, c): two triangles in each square."""
    m = resolution + 1
    v0 = (F.col("id") / resolution).cast("int") * m + (F.col("id") % resolution).cast("int")
    both = F.array(F.struct(v0.alias("a"), (v0 + 1).alias("b"), (v0 + m).alias("c")), F.struct((v0 + 1).alias("a"), (v0 + m + 1).alias("b"), (v0 + m).alias("c")))
    return spark.range(resolution * resolution).select("id", F.posexplode(both).alias("k", "f")).select((2 * F.col("id") + F.col("k")).cast("int").alias("t"), F.col("f.a").cast("int").alias("a"), F.col("f.b").cast("int").alias("b"), F.col("f.c").cast("int").alias("c"))


def keyed_actions(designs: DataFrame, params: int = 50) -> DataFrame:
    """(design_id, action): actions in [0, 1) that depend on the key alone."""
    p = F.col("design_id")
    action = F.transform(F.sequence(F.lit(0), F.lit(params - 1)), lambda k: (p * (k * 7919 + 104729)) % 1000 / lit(1000))
    return designs.select("design_id", action.alias("action"))


def random_actions(spark: SparkSession, n: int, params: int = 50, seed: int = 0) -> DataFrame:
    """(design_id, action): uniform random actions; the same seed and number of rows give the same ones."""
    return spark.range(n).select(F.col("id").alias("design_id"), F.array(*[F.rand(seed * 1000 + k) for k in range(params)]).alias("action"))


def env_states(envs: DataFrame, state: dict[str, float | Column]) -> DataFrame:
    """(env_id, state): the normalised start state of each environment (env_id and what the state's columns name)."""
    from ..operators.rl import normalised

    return envs.select("env_id", normalised({k: v if isinstance(v, Column) else lit(v) for k, v in state.items()}).alias("state"))


def root_blocks(spark: SparkSession, base: int, block: int) -> DataFrame:
    """(block_id, parent_id, level, ox, oy, oz, size, is_leaf): (base / block)^3 blocks of the coarsest level."""
    m = base // block
    k = F.col("id")
    return spark.range(m**3).select(k.alias("block_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("level"), ((k / (m * m)).cast("int") * block).alias("ox"), ((k / m % m).cast("int") * block).alias("oy"), ((k % m).cast("int") * block).alias("oz"), F.lit(block).alias("size"), F.lit(True).alias("is_leaf"))


def dipole_lengths(params: DataFrame, f0: float, f1: float, c: float = 3e8) -> DataFrame:
    """One row an element of each array (tau, sigma): k, length, spacing, position.

    Lengths shrink by tau from half the longest wavelength while they are a quarter of the shortest or more.
    """
    first, last = c / f0 / 2, c / f1 / 4
    count = F.floor(F.log(lit(last / first)) / F.log("tau") + 1e-9).cast("int")
    rows = params.withColumn("k", F.explode(F.sequence(F.lit(0), count)))
    rows = rows.withColumn("length", lit(first) * F.pow("tau", F.col("k").cast("double"))).withColumn("spacing", 4 * F.col("sigma") * F.col("length"))
    from pyspark.sql import Window as W

    before = W.partitionBy("tau", "sigma").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("position", F.coalesce(F.sum("spacing").over(before), lit(0.0)))


def opcodes(spark: SparkSession, table: dict[str, int] = OPCODES) -> DataFrame:
    """(name, code, bits): a table of six-bit operation codes."""
    frame = spark.createDataFrame(list(table.items()), "name string, code int")
    return frame.withColumn("bits", F.lpad(F.bin("code"), 6, "0"))
