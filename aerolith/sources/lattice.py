"""Velocity sets of the lattice-Boltzmann operators, as data.

Every set exists in two modes: ``reference`` holds the direction and opposite tables as published with the
solver, defects included, so that its results can be reproduced; ``corrected`` derives opposites by negation
and uses 19 distinct directions.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lattice:
    name: str
    directions: tuple[tuple[int, int, int], ...]
    weights: tuple[float, ...]
    opposite: tuple[int, ...]
    relaxation: tuple[float, ...] = ()

    @property
    def q(self) -> int:
        return len(self.directions)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(model, i, ex, ey, ez, w, opp): small, and broadcast by whoever joins it."""
        rows = [(self.name, i, *e, w, o) for i, (e, w, o) in enumerate(zip(self.directions, self.weights, self.opposite, strict=True))]
        return spark.createDataFrame(rows, "model string, i int, ex int, ey int, ez int, w double, opp int")

    def column(self, axis: int) -> Column:
        return F.array(*[F.lit(float(e[axis])) for e in self.directions])

    def opposites(self) -> Column:
        return F.array(*[F.lit(o) for o in self.opposite])


def negated(directions: tuple[tuple[int, int, int], ...]) -> tuple[int, ...]:
    return tuple(directions.index(tuple(-x for x in e)) for e in directions)


def by_axes(axes: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """All signs on the given axes, the first axis changing fastest."""
    out = []
    for signs in product((1, -1), repeat=len(axes)):
        e = [0, 0, 0]
        for axis, s in zip(reversed(axes), signs, strict=True):
            e[axis] = s
        out.append(tuple(e))
    return out


def cube() -> tuple[tuple[int, int, int], ...]:
    """Rest, 6 faces, 12 edges, 8 corners."""
    faces = [e for axis in range(3) for e in by_axes((axis,))]
    edges = [e for axes in ((0, 1), (0, 2), (1, 2)) for e in by_axes(axes)]
    return ((0, 0, 0), *faces, *edges, *by_axes((0, 1, 2)))


W27 = (8 / 27, *[2 / 27] * 6, *[1 / 54] * 12, *[1 / 216] * 8)
W19 = (1 / 3, *[1 / 18] * 6, *[1 / 36] * 12)

# Opposite and direction tables that reference results depend on.
OPPOSITE_27 = (0, 2, 1, 4, 3, 6, 5, 8, 7, 10, 9, 12, 11, 14, 13, 16, 15, 18, 17, 26, 25, 24, 23, 22, 21, 20, 19)
OPPOSITE_19 = (0, 2, 1, 4, 3, 6, 5, 9, 10, 7, 8, 13, 14, 11, 12, 17, 18, 15, 16)
EX_19 = (0, 1, -1, 0, 0, 0, 0, 1, -1, 1, -1, 1, -1, 1, -1, 0, 0, 0, 0)
EY_19 = (0, 0, 0, 1, -1, 0, 0, 1, 1, -1, -1, 0, 0, 0, 0, 1, -1, 1, -1)
EZ_19 = (0, 0, 0, 0, 0, 1, -1, 0, 0, 0, 0, 0, 0, 1, 1, -1, -1, 1, 1)
GUIDE_EZ_19 = (0, 0, 0, 0, 0, 1, -1, 0, 0, 0, 0, 1, 1, -1, -1, 1, 1, -1, -1)
GUIDE_OPPOSITE_27 = (0, 2, 1, 4, 3, 6, 5, 9, 10, 7, 8, 13, 14, 11, 12, 17, 18, 15, 16, 26, 25, 24, 23, 22, 21, 20, 19)
GUIDE_CORNERS = ((1, 1, 1), (-1, 1, 1), (1, -1, 1), (1, 1, -1), (-1, -1, 1), (-1, 1, -1), (1, -1, -1), (-1, -1, -1))


def relaxation_19(s_nu: float = 1.0, s_energy: float = 1.2, s_higher: float = 1.6) -> tuple[float, ...]:
    """Relaxation rates of the 19 moments; kept for inspection, no collision uses them."""
    return (1.0,) * 4 + (s_energy,) * 3 + (s_nu,) * 6 + (s_higher,) * 6


def lattice(name: str, mode: str = "reference") -> Lattice:
    """D3Q27, D3Q19, guide27 or guide19; any other name or mode is an error."""
    if mode not in ("reference", "corrected"):
        raise ValueError(f"unknown mode: {mode}")
    guide19 = tuple(zip(EX_19, EY_19, GUIDE_EZ_19, strict=True))
    published = {
        "D3Q27": (cube(), W27, OPPOSITE_27),
        "D3Q19": (tuple(zip(EX_19, EY_19, EZ_19, strict=True)), W19, OPPOSITE_19),
        "guide27": (cube()[:19] + GUIDE_CORNERS, W27, GUIDE_OPPOSITE_27),
        "guide19": (guide19, W19, OPPOSITE_19),
    }
    if name not in published:
        raise ValueError(f"unknown lattice: {name}")
    directions, weights, opposite = published[name]
    if mode == "corrected":
        directions = guide19 if name == "D3Q19" else directions
        opposite = negated(directions)
    return Lattice(name, directions, weights, opposite, relaxation_19() if len(weights) == 19 else ())
