"""Settings as dataclasses, and designs' result and case files as text."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Project:
    sheet_width_mm: float = 210.0
    sheet_height_mm: float = 297.0
    n_folds: int = 10


@dataclass
class Goals:
    target_range_m: float = 20.0
    throw_speed_mps: float = 10.0
    angle_of_attack_deg: float = 10.0


@dataclass
class Environment:
    air_density_kgm3: float = 1.225
    air_viscosity_pas: float = 1.81e-5
    temperature_k: float = 293.15


@dataclass
class Config:
    project: Project = field(default_factory=Project)
    goals: Goals = field(default_factory=Goals)
    environment: Environment = field(default_factory=Environment)

    @classmethod
    def of(cls, values: dict) -> Config:
        """From nested dictionaries; missing keys take their defaults, unknown ones are an error."""
        return cls(Project(**values.get("project", {})), Goals(**values.get("goals", {})), Environment(**values.get("environment", {})))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Config:
        """From a JSON file, or from a flat two-level ``key: value`` file."""
        text = spark.read.text(path, wholetext=True).head()[0]
        return cls.of(json.loads(text) if text.lstrip().startswith("{") else two_levels(text))

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row, a column a setting."""
        flat = {f"{part}_{k}": v for part, values in asdict(self).items() for k, v in values.items()}
        return spark.createDataFrame([tuple(flat.values())], list(flat))


def two_levels(text: str) -> dict:
    """Sections with indented ``key: value`` lines; numbers, booleans and plain words."""
    out: dict = {}
    section = out
    for raw in text.splitlines():
        line = raw.split("#")[0].rstrip()
        if not line.strip() or ":" not in line:
            continue
        key, _, value = line.strip().partition(":")
        value = value.strip()
        if not line[0].isspace() and not value:
            section = out.setdefault(key, {})
            continue
        target = section if line[0].isspace() else out
        try:
            target[key] = json.loads(value)
        except ValueError:
            try:
                target[key] = float(value)
            except ValueError:
                target[key] = value.strip("'\"")
    return out


def spec_json(columns: list[str]) -> Column:
    """A design's figures as one JSON text."""
    return F.to_json(F.struct(*columns))


def case_text(**values: Column) -> Column:
    """Solver settings as ``key = value`` lines."""
    return F.concat_ws("\n", *[F.format_string(f"{k} = %s", v.cast("string")) for k, v in values.items()])
