"""Parsers of solver output: force logs, result files and printed lines, as text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lit


def numbered(spark: SparkSession, path: str, key: str = "file") -> DataFrame:
    """(file, line_no, line) of text files. Lines of a file are numbered from 0; files are read whole, each in one task."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias(key), F.split("value", "\n").alias("lines"))
    return files.select(key, F.posexplode("lines").alias("line_no", "line"))


def real_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor a comment."""
    return lines.where("trim(line) <> '' and not startswith(line, '#')")


def last_line(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, line): the last line that is neither blank nor a comment."""
    return real_lines(lines).groupBy(key).agg(F.max_by("line", "line_no").alias("line"))


def bracketed_forces(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, time, force_x.., moment_x..) from lines ``time (Fx Fy Fz) (Mx My Mz)``; the last line counts."""
    last = last_line(lines, key)
    part = lambda k: F.split(F.trim(F.regexp_extract("line", r"^\s*(\S+)\s*\(([^)]*)\)\s*\(([^)]*)\)", k)), r"\s+")
    number = lambda k, i: F.try_element_at(part(k), F.lit(i + 1)).try_cast("double")
    columns = [number(1, 0).alias("time")]
    columns += [number(k, i).alias(f"{name}_{a}") for k, name in ((2, "force"), (3, "moment")) for i, a in enumerate("xyz")]
    return last.select(key, *columns)


def plain_forces(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, force_x, force_y, force_z) from the first three numbers of the last line."""
    words = F.split(F.trim("line"), r"\s+")
    return last_line(lines, key).select(key, *[F.try_element_at(words, F.lit(i + 1)).try_cast("double").alias(f"force_{a}") for i, a in enumerate("xyz")])


def json_results(rows: DataFrame, column: str = "value") -> DataFrame:
    """Adds cl, cd, ld, range_est of a JSON result, each with its default."""
    defaults = {"cl": ("cl", 0.5), "cd": ("cd", 0.05), "ld": ("ld", 10.0), "range_est": ("range", 20.0)}
    parsed = rows.withColumn("_r", F.from_json(column, "cl double, cd double, ld double, `range` double"))
    return parsed.withColumns({name: F.coalesce(F.col(f"_r.{field}"), lit(v)) for name, (field, v) in defaults.items()}).drop("_r")


def printed_results(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, cl, cd): the last word of the last line that names CL, and CD; 0 where it is none or no number."""
    value = F.element_at(F.split(F.trim("line"), r"\s+"), -1).try_cast("double")
    at = lines.select(key, "line_no", value.alias("v"), F.upper("line").contains("CL").alias("is_cl"), F.upper("line").contains("CD").alias("is_cd"))
    pick = lambda c: F.coalesce(F.max_by(F.when(c, F.col("v")), F.when(c & F.col("v").isNotNull(), F.col("line_no"))), lit(0.0))
    return at.groupBy(key).agg(pick(F.col("is_cl")).alias("cl"), pick(F.col("is_cd") & ~F.col("is_cl")).alias("cd"))
