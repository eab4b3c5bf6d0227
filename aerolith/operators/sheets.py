"""Folded sheets of many designs at once: one sheet and its faces serve all, and numpy folds a slice of designs in a task.

Each design's vertices follow from its actions alone, so nothing is joined or shuffled. Sheet and faces are small; meshes
with faces of their own stay tables (``mesh.py``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.scalars import half_up
from ..sources.grids import SHEET

#: Designs that numpy takes at once.
SLICE = 128


@dataclass
class Sheets:
    """Places (designs, vertices, 3) of a slice of designs, the number of each vertex, and faces (faces, 3) by position."""

    at: np.ndarray
    v: np.ndarray
    face: np.ndarray


def rise(action: np.ndarray, x: np.ndarray, y: np.ndarray, width: float = SHEET[0], height: float = SHEET[1]) -> np.ndarray:
    """(designs, vertices): how far the valid creases of actions (designs, creases, 5) lift the vertices; NaN is no crease."""
    a = action.transpose(2, 0, 1)[..., None]
    px, py, turn = a[0] * width, a[1] * height, (a[4] - 0.5) * 3.141592653589793
    dx, dy = a[2] * width - px, a[3] * height - py
    length = np.sqrt(dx * dx + dy * dy)
    with np.errstate(divide="ignore", invalid="ignore"):
        dx, dy = dx / length, dy / length
        rx, ry = x - px, y - py
        along = rx * dx + ry * dy
        ox, oy = rx - along * dx, ry - along * dy
        dist = np.sqrt(ox * ox + oy * oy)
        lift = (dx * (oy / dist) - dy * (ox / dist)) * np.sin(turn) * np.exp(-dist / 0.02)
        valid = (length >= 0.01) & (along >= 0) & (along <= length) & (dist >= 0.001)
    return np.where(valid, lift, 0.0).sum(axis=1)


def creases_of(column: pa.Array) -> np.ndarray:
    """(designs, creases, 5) of a column of actions; NaN where a design has fewer."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) // 5 * 5
    every = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.full((len(column), max(int(sizes.max(initial=0)), 5)), np.nan)
    row = np.repeat(np.arange(len(column)), every)
    place = np.arange(len(row)) - np.repeat(np.cumsum(every) - every, every)
    kept = place < sizes[row]
    out[row[kept], place[kept]] = column.flatten().to_numpy(zero_copy_only=False)[kept]
    return out.reshape(len(column), -1, 5)


def on_sheets(actions: DataFrame, sheet: DataFrame, face: DataFrame, work: Callable[[Sheets], dict[str, np.ndarray]], made: str, digits: dict[str, int], key: str = "design_id") -> DataFrame:
    """(key, made...): the rows that ``work`` makes of the folded sheets; its arrays are (designs, rows) or (rows,) for all.

    Columns in ``digits`` are rounded.
    """
    flat, faces = sheet.orderBy("v").toArrow(), face.orderBy("t").toArrow()
    v = flat["v"].to_numpy()
    x, y, z = (flat[c].to_numpy() for c in "xyz")
    corner = np.stack([np.searchsorted(v, faces[c].to_numpy()) for c in "abc"], axis=1)
    schema = T.StructType([actions.schema[key], *T.StructType.fromDDL(made)])
    arrow = {f.name: {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}.get(f.dataType.simpleString(), pa.float64()) for f in schema.fields[1:]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), SLICE):
                part = batch.slice(start, SLICE)
                n = len(part)
                at = np.empty((n, len(v), 3))
                at[..., 0], at[..., 1], at[..., 2] = x, y, z + rise(creases_of(part.column("action")), x, y)
                out = work(Sheets(at, v, corner))
                out |= {c: half_up(out[c], k) for c, k in digits.items()}
                rows = next(iter(out.values())).shape[-1]
                columns = [pa.array(np.ascontiguousarray(np.broadcast_to(out[c], (n, rows))).ravel(), type=t) for c, t in arrow.items()]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(np.repeat(np.arange(n), rows))), *columns], names=[key, *arrow])

    return actions.select(key, "action").mapInArrow(run, schema)


def unit_normals(s: Sheets) -> np.ndarray:
    """(designs, faces, 3), their length guarded by 1e-10 as ``mesh.normals`` does."""
    a, b, c = (s.at[:, s.face[:, k]] for k in range(3))
    n = np.cross(b - a, c - a)
    return n / (np.sqrt((n * n).sum(axis=2)) + 1e-10)[..., None]


def vertex_normals(s: Sheets) -> dict[str, np.ndarray]:
    """``mesh.vertex_normals`` of the vertices that have faces."""
    vertex, face = s.face.ravel(), np.repeat(np.arange(len(s.face)), 3)
    order = np.argsort(vertex, kind="stable")
    vertex, face = vertex[order], face[order]
    first = np.flatnonzero(np.diff(vertex, prepend=-1))
    count = np.diff(np.append(first, len(vertex)))[:, None]
    n = unit_normals(s)[:, face]
    mean = np.add.reduceat(n, first, axis=1) / count
    off = n - np.repeat(mean, count[:, 0], axis=1)
    spread = np.sqrt(np.add.reduceat(off * off, first, axis=1) / count).sum(axis=2) / 3.0
    return {"v": s.v[vertex[first]], "nx": mean[..., 0], "ny": mean[..., 1], "nz": mean[..., 2], "curvature": spread}


def edges(s: Sheets) -> dict[str, np.ndarray]:
    """Each edge once, from the smaller to the larger vertex, with its offset and the normal and curvature of its source."""
    ends = np.unique(np.sort(np.concatenate([s.face[:, [0, 1]], s.face[:, [1, 2]], s.face[:, [2, 0]]]), axis=1), axis=0)
    offset = s.at[:, ends[:, 1]] - s.at[:, ends[:, 0]]
    known = vertex_normals(s)
    place = np.searchsorted(known["v"], s.v[ends[:, 0]])  # an edge's ends have a face
    flat = np.zeros(len(ends))
    return {"src": s.v[ends[:, 0]], "dst": s.v[ends[:, 1]], "dx": offset[..., 0], "dy": offset[..., 1], "dz": offset[..., 2], "dihedral": flat, "src_nz": known["nz"][:, place], "src_curvature": known["curvature"][:, place]}


def curvature(s: Sheets) -> dict[str, np.ndarray]:
    """``surface.curvature`` of the vertices that have faces."""
    ends = [(tip, one, other) for tip, i, j in ((0, 1, 2), (1, 2, 0), (2, 0, 1)) for one, other in ((i, j), (j, i))]
    vertex, to, tip = (np.concatenate([s.face[:, e[k]] for e in ends]) for k in (1, 2, 0))
    face = np.tile(np.arange(len(s.face)), len(ends))
    order = np.lexsort((to, vertex))
    vertex, to, tip, face = vertex[order], to[order], tip[order], face[order]
    a, b, c = (s.at[:, s.face[:, k]] for k in range(3))
    normal = np.cross(b - a, c - a)
    size = np.sqrt((normal * normal).sum(axis=2))[:, face]
    one, other = s.at[:, vertex] - s.at[:, tip], s.at[:, to] - s.at[:, tip]
    half = np.divide((one * other).sum(axis=2) / 2, size, out=np.zeros_like(size), where=size > 1e-15)
    pull = half[..., None] * (one - other)
    first = np.flatnonzero(np.diff(vertex, prepend=-1))
    edge = np.flatnonzero((np.diff(vertex, prepend=-1) != 0) | (np.diff(to, prepend=-1) != 0))
    single = np.diff(np.append(edge, len(vertex))) < 2  # an edge that only one triangle has
    boundary = np.isin(vertex[first], vertex[edge][single])
    total, area = np.add.reduceat(pull, first, axis=1), np.add.reduceat(size / 12, first, axis=1)
    bent = np.divide(np.sqrt((total * total).sum(axis=2)), 2 * area, out=np.zeros_like(area), where=~boundary & (area > 0))
    return {"v": s.v[vertex[first]], "lz": total[..., 2], "area": area, "boundary": boundary, "curvature": bent}
