"""Registry of the engine's queries and of their SQL equivalents: importing the plans fills it."""

from __future__ import annotations

from . import aero_plans, data_plans, file_plans, grid_plans, network_plans, part_plans, surface_plans, tile_plans  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
