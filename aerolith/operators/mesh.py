"""Triangle meshes: folding, normals, areas, features, transforms and voxel surfaces.

vertex(key, v, x, y, z) and face(key, t, a, b, c) are plain tables; a face finds its corners by three joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cross, dot, lit, norm, rotate, total
from ..sources.grids import SHEET

#: The twelve triangles of a unit cube, as corners in {0, 1}^3, seen from outside anticlockwise.
def cube_triangles() -> list[tuple[tuple[int, int, int], ...]]:
    out = []
    for axis in range(3):
        for side in (0, 1):
            u, v = (axis + 1) % 3, (axis + 2) % 3
            quad = []
            for p, q in ((0, 0), (1, 0), (1, 1), (0, 1)):
                corner = [0, 0, 0]
                corner[axis], corner[u], corner[v] = side, p, q
                quad.append(tuple(corner))
            if side == 0:
                quad = [quad[0], quad[3], quad[2], quad[1]]
            out += [(quad[0], quad[1], quad[2]), (quad[0], quad[2], quad[3])]
    return out


def creases(actions: DataFrame, width: float = SHEET[0], height: float = SHEET[1], key: str = "design_id") -> DataFrame:
    """(key, k, px, py, dx, dy, length, turn): valid creases of fold actions of five numbers each."""
    k = F.explode(F.sequence(F.lit(0), (F.size("action") / 5).cast("int") - 1)).alias("k")
    at = lambda j: F.element_at("action", 5 * F.col("k") + j + 1)
    rows = actions.select(key, "action", k).select(key, "k", (at(0) * width).alias("px"), (at(1) * height).alias("py"), (at(2) * width).alias("qx"), (at(3) * height).alias("qy"), ((at(4) - 0.5) * lit(3.141592653589793)).alias("turn"))
    length = F.sqrt((F.col("qx") - F.col("px")) ** 2 + (F.col("qy") - F.col("py")) ** 2)
    rows = rows.withColumn("length", length).where("length >= 0.01")
    return rows.select(key, "k", "px", "py", ((F.col("qx") - F.col("px")) / F.col("length")).alias("dx"), ((F.col("qy") - F.col("py")) / F.col("length")).alias("dy"), "length", "turn")


def folded(actions: DataFrame, sheet: DataFrame, key: str = "design_id") -> DataFrame:
    """vertex(key, v, x, y, z) after all folds.

    Folds move z alone and look at x and y alone, so their order doesn't matter: each fold meets each vertex of
    the (small, fixed) sheet, and displacements are added up.
    """
    pairs = creases(actions, key=key).join(F.broadcast(sheet))
    rx, ry = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    along = rx * F.col("dx") + ry * F.col("dy")
    pairs = pairs.withColumns({"along": along, "off_x": rx - along * F.col("dx"), "off_y": ry - along * F.col("dy")})
    pairs = pairs.withColumn("dist", F.sqrt(F.col("off_x") ** 2 + F.col("off_y") ** 2)).where("along >= 0 and along <= length and dist >= 0.001")
    side = F.col("dx") * (F.col("off_y") / F.col("dist")) - F.col("dy") * (F.col("off_x") / F.col("dist"))
    moved = pairs.groupBy(key, "v").agg(F.sum(side * F.sin("turn") * F.exp(-F.col("dist") / 0.02)).alias("dz"))
    every = actions.select(key).join(F.broadcast(sheet))
    return every.join(moved, [key, "v"], "left").select(key, "v", "x", "y", (F.col("z") + F.coalesce("dz", lit(0.0))).alias("z"))


def corners(vertex: DataFrame, face: DataFrame, key: str = "design_id", shared_faces: bool = True) -> DataFrame:
    """(key, t, a, b, c, ax, ay, az, bx, ...): faces with the places of their corners.

    With ``shared_faces`` one face table (without key) serves all meshes.
    """
    rows = vertex.select(key).distinct().join(F.broadcast(face)) if shared_faces else face
    for c in "abc":
        rows = rows.join(vertex.select(key, F.col("v").alias(c), *[F.col(p).alias(f"{c}{p}") for p in "xyz"]), [key, c])
    return rows


def normals(triangles: DataFrame) -> DataFrame:
    """Adds the unit normal nx, ny, nz (length guarded by 1e-10) and the area of each triangle."""
    p = {c: tuple(F.col(f"{c}{x}") for x in "xyz") for c in "abc"}
    e1 = tuple(q - o for q, o in zip(p["b"], p["a"], strict=True))
    e2 = tuple(q - o for q, o in zip(p["c"], p["a"], strict=True))
    n = cross(e1, e2)
    out = triangles.withColumns({"_x": n[0], "_y": n[1], "_z": n[2]}).withColumn("_n", norm(tuple(F.col(f"_{x}") for x in "xyz")))
    return out.withColumns({f"n{x}": F.col(f"_{x}") / (F.col("_n") + 1e-10) for x in "xyz"} | {"area": F.col("_n") / 2}).drop("_x", "_y", "_z", "_n")


def features(vertex: DataFrame, face: DataFrame, key: str = "design_id") -> DataFrame:
    """(key, area_proj, span, chord, ar, camber, dihedral, area_wet) of each mesh."""
    box = vertex.groupBy(key).agg(F.greatest(F.max("x") - F.min("x"), lit(0.001)).alias("bx"), F.greatest(F.max("y") - F.min("y"), lit(0.001)).alias("by"), F.avg(F.abs("z")).alias("height"))
    surface = normals(corners(vertex, face, key)).groupBy(key).agg(F.sum("area").alias("area"), F.avg(F.abs(F.col("nz") - 1.0)).alias("dihedral"))
    proj = F.col("bx") * F.col("by") * 0.8
    chord = proj / F.col("by")
    return box.join(surface, key).select(key, proj.alias("area_proj"), F.col("by").alias("span"), chord.alias("chord"), (F.col("by") ** 2 / proj).alias("ar"), (F.col("height") / chord).alias("camber"), "dihedral", (2 * F.col("area")).alias("area_wet"))


def vertex_normals(vertex: DataFrame, face: DataFrame, key: str = "design_id") -> DataFrame:
    """(key, v, nx, ny, nz, curvature): mean of the normals of adjoining faces, and their mean population deviation."""
    at = normals(corners(vertex, face, key)).select(key, F.explode(F.array("a", "b", "c")).alias("v"), "nx", "ny", "nz")
    return at.groupBy(key, "v").agg(*[F.avg(f"n{x}").alias(f"n{x}") for x in "xyz"], ((F.stddev_pop("nx") + F.stddev_pop("ny") + F.stddev_pop("nz")) / 3.0).alias("curvature"))


def edges(face: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, src, dst): each edge once, from the smaller to the larger vertex."""
    sides = F.explode(F.array(*[F.struct(F.least(p, q).alias("src"), F.greatest(p, q).alias("dst")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e")
    return face.select(*keys, sides).select(*keys, "e.src", "e.dst").distinct()


def undirected(edge: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Both directions of each edge, once."""
    return edge.select(*keys, "src", "dst").union(edge.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def placed(vertex: DataFrame, size: float = 1.0, turn: tuple[float, float, float] = (0.0, 0.0, 0.0), key: str = "design_id") -> DataFrame:
    """Vertices moved to their mean, scaled so that the largest extent is ``size``, and turned by degrees."""
    extent = F.greatest(*[F.max(a) - F.min(a) for a in "xyz"])
    middle = vertex.groupBy(key).agg(*[F.avg(a).alias(f"_{a}") for a in "xyz"], extent.alias("_extent"))
    at = vertex.join(middle, key).withColumns({a: F.col(a) - F.col(f"_{a}") for a in "xyz"})
    extent = F.col("_extent")
    at = at.withColumn("_s", F.when(extent > 0, lit(size) / extent).otherwise(lit(1.0)))
    out = rotate(tuple(F.col(a) * F.col("_s") for a in "xyz"), *turn)
    return at.withColumns({f"_{a}": c for a, c in zip("xyz", out, strict=True)}).select(key, "v", *[F.col(f"_{a}").alias(a) for a in "xyz"])


def cube_surface(voxels: DataFrame, key: str = "design_id", threshold: float = 0.5) -> DataFrame:
    """(key, cell, t, ax, ... cz): twelve triangles for each filled voxel; inner faces are not left out."""
    spark = voxels.sparkSession
    table = spark.createDataFrame([(t, *map(float, a + b + c)) for t, (a, b, c) in enumerate(cube_triangles())], "k int, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz"))
    solid = voxels.where(F.col("p") > threshold).select(key, "cell", *[F.col(a).cast("double").alias(f"o{a}") for a in "xyz"])
    return solid.join(F.broadcast(table)).select(key, "cell", "k", *[(F.col(f"{c}{x}") + F.col(f"o{x}")).alias(f"{c}{x}") for c in "abc" for x in "xyz"])


def signed_volume(triangles: DataFrame, key: str = "design_id") -> DataFrame:
    """(key, volume, area, triangles): a closed surface seen from outside has a positive volume."""
    p = {c: tuple(F.col(f"{c}{x}") for x in "xyz") for c in "abc"}
    v = dot(p["a"], cross(p["b"], p["c"])) / 6.0
    return normals(triangles).groupBy(key).agg(F.sum(v).alias("volume"), F.sum("area").alias("area"), F.count(F.lit(1)).alias("triangles"))


def level_surface(voxels: DataFrame, n: int, key: str = "design_id", level: float = 0.5) -> DataFrame:
    """Triangles (key, ax, ... cz) of the surface at ``level`` between voxel centres.

    Each cube of eight neighbouring centres is cut into six tetrahedra along one diagonal, and each tetrahedron into none,
    one or two triangles: a rule in place of a table of cases, which closes the surface without holes. Outside the
    grid there is nothing, so the grid is padded by one layer of zeros.
    """
    pad = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(("dx", "dy", "dz"), e, strict=True)], F.lit(i).alias("i")) for i, e in enumerate(_corner(i) for i in range(8))])
    at = voxels.where(F.col("p") != 0).select(key, "x", "y", "z", "p", F.explode(pad).alias("d"))
    cubes = at.groupBy(key, (F.col("x") - F.col("d.dx")).alias("x"), (F.col("y") - F.col("d.dy")).alias("y"), (F.col("z") - F.col("d.dz")).alias("z")).agg(*[F.coalesce(F.max(F.when(F.col("d.i") == i, F.col("p"))), lit(0.0)).alias(f"p{i}") for i in range(8)])
    inside = [F.col(f"p{i}") > level for i in range(8)]
    some = inside[0]
    every = inside[0]
    for c in inside[1:]:
        some, every = some | c, every & c
    cubes = cubes.where(some & ~every)
    tets = F.array(*[F.array(*[F.struct(F.lit(float(_corner(i)[0])).alias("x"), F.lit(float(_corner(i)[1])).alias("y"), F.lit(float(_corner(i)[2])).alias("z"), F.col(f"p{i}").alias("p")) for i in t]) for t in _tetrahedra()])
    tet = cubes.select(key, "x", "y", "z", F.explode(tets).alias("t"))
    high = F.filter("t", lambda c: c["p"] > level)
    low = F.filter("t", lambda c: c["p"] <= level)
    tet = tet.select(key, "x", "y", "z", high.alias("h"), low.alias("l"))

    def cut(h: int, lo: int) -> dict[str, object]:
        a, b = F.col("h")[h], F.col("l")[lo]
        s = (lit(level) - a["p"]) / (b["p"] - a["p"])
        return {x: a[x] + s * (b[x] - a[x]) + F.col(x) for x in "xyz"}

    def triangle(*points: dict) -> object:
        return F.struct(*[p[x].alias(f"{c}{x}") for c, p in zip("abc", points, strict=True) for x in "xyz"])

    one = F.array(triangle(cut(0, 0), cut(0, 1), cut(0, 2)))
    three = F.array(triangle(cut(0, 0), cut(1, 0), cut(2, 0)))
    two = F.array(triangle(cut(0, 0), cut(0, 1), cut(1, 1)), triangle(cut(0, 0), cut(1, 1), cut(1, 0)))
    made = F.when(F.size("h") == 1, one).when(F.size("h") == 3, three).when(F.size("h") == 2, two)
    out = tet.where("size(h) between 1 and 3").select(key, *[F.col("h")[0][x].alias(f"i{x}") for x in "xyz"], "x", "y", "z", F.explode(made).alias("f"))
    out = out.select(key, *[(F.col(f"i{x}") + F.col(x)).alias(f"i{x}") for x in "xyz"], "f.*")
    # turn each triangle so that its normal points away from the filled corner
    p = {c: tuple(F.col(f"{c}{x}") for x in "xyz") for c in "abc"}
    n_ = cross(tuple(q - o for q, o in zip(p["b"], p["a"], strict=True)), tuple(q - o for q, o in zip(p["c"], p["a"], strict=True)))
    away = dot(n_, tuple(o - F.col(f"i{x}") for o, x in zip(p["a"], "xyz", strict=True))) >= 0
    flip = lambda c, o: [F.when(away, F.col(f"{c}{x}")).otherwise(F.col(f"{o}{x}")).alias(f"{c}{x}") for x in "xyz"]
    return out.select(key, *[f"a{x}" for x in "xyz"], *flip("b", "c"), *flip("c", "b"))


def _corner(i: int) -> tuple[int, int, int]:
    return i & 1, i >> 1 & 1, i >> 2 & 1


def _tetrahedra() -> list[tuple[int, int, int, int]]:
    """Paths along three axes, in any order, from corner 0 to corner 7."""
    from itertools import permutations

    return [(0, 1 << a, (1 << a) | (1 << b), 7) for a, b, _ in permutations(range(3))]


def surface_cells(triangles: DataFrame, pitch: float, key: str = "design_id") -> DataFrame:
    """(key, x, y, z): cells, with centres at multiples of the pitch, that points of the triangles fall into.

    Each triangle is sampled at half a pitch or closer, along two sides, so no cell that it crosses widely is missed.
    """
    p = {c: [F.col(f"{c}{x}") for x in "xyz"] for c in "abc"}
    longest = F.greatest(*[F.sqrt(total([(u - v) ** 2 for u, v in zip(p[s], p[t], strict=True)])) for s, t in ("ab", "bc", "ca")])
    steps = F.greatest(F.lit(1), F.ceil(longest / lit(pitch / 2)).cast("int"))
    rows = triangles.select(key, *[f"{c}{x}" for c in "abc" for x in "xyz"], steps.alias("_m")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m"))))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_m") - F.col("_i"))))
    at = lambda x: F.col(f"a{x}") + (F.col(f"b{x}") - F.col(f"a{x}")) * (F.col("_i") / F.col("_m")) + (F.col(f"c{x}") - F.col(f"a{x}")) * (F.col("_j") / F.col("_m"))
    return rows.select(key, *[F.floor(at(x) / lit(pitch) + 0.5 + 1e-9).cast("int").alias(x) for x in "xyz"]).distinct()


def voxelised(triangles: DataFrame, pitch: float, key: str = "design_id") -> DataFrame:
    """(key, x, y, z) of the filled cells of closed meshes: those of the surface, and cells that it encloses on all three axes.

    Along each axis a line of cells is filled between its first and last surface cell; a cell is inside if its lines
    along x, y and z all say so. Lines are runs, so nothing depends on the size of a mesh's bounding box.
    """
    shell = surface_cells(triangles, pitch, key)
    spans = {a: shell.groupBy(key, *[b for b in "xyz" if b != a]).agg(F.min(a).alias(f"_{a}0"), F.max(a).alias(f"_{a}1")) for a in "xyz"}
    inner = spans["z"].withColumn("z", F.explode(F.sequence("_z0", "_z1"))).drop("_z0", "_z1")
    for a in "xy":
        others = [b for b in "xyz" if b != a]
        inner = inner.join(spans[a], [key, *others]).where(F.col(a).between(F.col(f"_{a}0"), F.col(f"_{a}1"))).drop(f"_{a}0", f"_{a}1")
    return inner.select(key, "x", "y", "z").union(shell).distinct()


def box_surface(boxes: DataFrame, key: str = "design_id") -> DataFrame:
    """(key, t, ax, ... cz): twelve triangles of the box from 0 to (sx, sy, sz) of each row."""
    unit = boxes.sparkSession.createDataFrame([(t, *map(float, a + b + c)) for t, (a, b, c) in enumerate(cube_triangles())], "t int, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz"))
    return boxes.join(F.broadcast(unit)).select(key, "t", *[(F.col(f"{c}{x}") * F.col(f"s{x}")).alias(f"{c}{x}") for c in "abc" for x in "xyz"])
