"""Projection, visibility, grids, neighbours and shapes of points and boxes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project(points: DataFrame, frames: DataFrame, scene: str = "scene") -> DataFrame:
    """Points seen through the frames of their scene: pixel (truncated towards zero), depth z. z = 0 gives no row.

    points: scene, point_id, x, y, z. frames: scene, frame_id, pose (16 numbers, world to camera, by rows), fx, fy, cx, cy. The
    frames of a scene are joined to its points on the scene, as an equi-join: the result has one row per point and frame.
    """
    row = lambda i: F.get("pose", 4 * i) * F.col("x") + F.get("pose", 4 * i + 1) * F.col("y") + F.get("pose", 4 * i + 2) * F.col("z") + F.get("pose", 4 * i + 3)
    out = points.join(frames, scene).select(scene, "frame_id", "point_id", row(0).alias("cxx"), row(1).alias("cyy"), row(2).alias("depth"), "fx", "fy", "cx", "cy").where("depth <> 0")
    return out.select(scene, "frame_id", "point_id", (F.col("fx") * F.col("cxx") / F.col("depth") + F.col("cx")).cast("int").alias("px"), (F.col("fy") * F.col("cyy") / F.col("depth") + F.col("cy")).cast("int").alias("py"), "depth")


def visible(proj: DataFrame, depth: DataFrame, width: int, height: int, tolerance: float = 0.05, scene: str = "scene") -> DataFrame:
    """Projected points strictly inside the image (0 excluded) whose depth agrees with the measured one at their pixel."""
    inside = (F.col("px") > 0) & (F.col("px") < width) & (F.col("py") > 0) & (F.col("py") < height)
    seen = depth.select(scene, "frame_id", "px", "py", F.col("depth").alias("measured"))
    return proj.where(inside).join(seen, [scene, "frame_id", "px", "py"]).where(F.abs(F.col("measured") - F.col("depth")) <= tolerance).drop("measured")


def front_points(proj: DataFrame, width: int, height: int, tolerance: float, scene: str = "scene") -> DataFrame:
    """Points within tolerance of the nearest one at their pixel (0 included): visibility without a depth image."""
    inside = proj.where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height) & (F.col("depth") > 0))
    near = F.min("depth").over(Window.partitionBy(scene, "frame_id", "px", "py"))
    return inside.withColumn("__near", near).where(F.col("depth") <= F.col("__near") + tolerance).drop("__near")


def seen_box(proj: DataFrame, key: list[str], scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """(key, x1, y1, x2, y2, n): box of a set's projected points in image pixels; the far edge is one beyond the last pixel."""
    return proj.groupBy(*key).agg((F.min("px") / scale_x).alias("x1"), (F.min("py") / scale_y).alias("y1"), ((F.max("px") + 1) / scale_x).alias("x2"), ((F.max("py") + 1) / scale_y).alias("y2"), F.count(F.lit(1)).alias("n"))


def voxels(points: DataFrame, key: list[str], axes: list[str], size: float, id_col: str) -> DataFrame:
    """(key, cells, first_id, n): one row per voxel - floor(axis / size) - with its smallest point and its number of points."""
    cells = [F.floor(F.col(a) / size).alias(f"v{a}") for a in axes]
    return points.groupBy(*key, *cells).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n"))


def _term(metric: str, d: Column) -> Column:
    """What an axis adds to a distance: squares (l2), amounts (l1), or squares up to 1 and amounts beyond (huber)."""
    if metric == "l2":
        return d * d
    if metric == "l1":
        return F.abs(d)
    if metric == "huber":
        return F.when(F.abs(d) <= 1, d * d / 2).otherwise(F.abs(d) - 0.5)
    raise ValueError(metric)


def near_pairs(a: DataFrame, b: DataFrame, key: list[str], axes: list[str], radius: float, a_id: str = "a", b_id: str = "b", metric: str = "l2") -> DataFrame:
    """(key, a, b, d2): all pairs within the radius, exactly: cells as large as the radius, each point looking into the cells around.

    d2: the sum over the axes, see _term(); the squared distance by default. In the radius is what lies no farther than a point at that
    distance along an axis. a: key, a_id, axes; b: key, b_id, axes. An equi-join on (key, cell); only a is multiplied, by 3 per axis.
    """
    grid = [F.floor(F.col(x) / radius).cast("long") for x in axes]
    steps = F.array(*[F.struct(*[F.lit(s).cast("long").alias(f"s{i}") for i, s in enumerate(step)]) for step in product((-1, 0, 1), repeat=len(axes))])
    left = a.select(*key, a_id, *[F.col(x).alias(f"__a{i}") for i, x in enumerate(axes)], *[g.alias(f"__g{i}") for i, g in enumerate(grid)], F.explode(steps).alias("__s"))
    left = left.select(*key, a_id, *[f"__a{i}" for i in range(len(axes))], *[(F.col(f"__g{i}") + F.col(f"__s.s{i}")).alias(f"__c{i}") for i in range(len(axes))])
    right = b.select(*key, b_id, *[F.col(x).alias(f"__b{i}") for i, x in enumerate(axes)], *[g.alias(f"__c{i}") for i, g in enumerate(grid)])
    d2 = sum((_term(metric, F.col(f"__a{i}") - F.col(f"__b{i}")) for i in range(len(axes))), F.lit(0.0))
    met = left.join(right, [*key, *[f"__c{i}" for i in range(len(axes))]])
    return met.select(*key, a_id, b_id, d2.alias("d2")).where(F.col("d2") <= _term(metric, F.lit(float(radius))))


def nearest(a: DataFrame, b: DataFrame, key: list[str], axes: list[str], k: int, radius: float, a_id: str = "a", b_id: str = "b", metric: str = "l2") -> DataFrame:
    """(key, a, b, d2, place): the k nearest of b for every row of a, exactly; equal distances go to the smaller b.

    A row is no neighbour of its own id. Rows that find fewer than k within the radius look again within a larger one, until
    all have k; keys with k rows of b or fewer are settled first, by joining the key. So every row of a gets min(k, what there
    is). Rows without a place (a null or NaN axis) are left out on both sides.
    """
    from scantable.common import cut

    def placed(df: DataFrame) -> DataFrame:
        known = F.lit(True)
        for x in axes:
            known = known & F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
        return df.where(known)

    a, b = placed(a), placed(b)
    place = F.row_number().over(Window.partitionBy(*key, a_id).orderBy("d2", b_id))
    few = cut(b.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= k).select(*key))
    apart = sum((_term(metric, F.col(f"__a{i}") - F.col(f"__b{i}")) for i in range(len(axes))), F.lit(0.0))
    side = lambda df, name, s: df.select(*key, name, *[F.col(x).alias(f"__{s}{i}") for i, x in enumerate(axes)])
    met = side(a, a_id, "a").join(side(b.join(few, key, "left_semi"), b_id, "b"), key).where(F.col(a_id) != F.col(b_id))
    out = met.select(*key, a_id, b_id, apart.alias("d2")).withColumn("place", place)
    known = b.select(*key).distinct().join(few, key, "left_anti")  # keys with more than k rows: everybody finds k
    todo = cut(a.join(known, key, "left_semi"))
    left = todo.count()
    while left:
        found = near_pairs(todo, b, key, axes, radius, a_id, b_id, metric).where(F.col(a_id) != F.col(b_id))
        best = cut(found.withColumn("place", place).where(F.col("place") <= k))
        done = best.groupBy(*key, a_id).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        out = out.unionByName(best.join(done, [*key, a_id], "left_semi"))
        before, todo = left, cut(todo.join(done, [*key, a_id], "left_anti"))
        left = todo.count()
        radius *= 2 if left < before else 8
    return out


def mesh_edges(faces: DataFrame, key: list[str]) -> DataFrame:
    """(key, left, right): the three edges of each triangle, first-second, first-third, third-second, once each."""
    each = F.array(*[F.struct(F.col(a).alias("left"), F.col(b).alias("right")) for a, b in (("v0", "v1"), ("v0", "v2"), ("v2", "v1"))])
    return faces.select(*key, F.explode(each).alias("e")).select(*key, "e.left", "e.right").distinct()


def vertex_normals(points: DataFrame, faces: DataFrame, key: list[str], unit: bool = True) -> DataFrame:
    """(key, point_id, nx, ny, nz): mean of the normals of the faces at each vertex, with length 1 if unit; a zero mean stays zero."""
    p = lambda i: points.select(*key, F.col("point_id").alias(f"v{i}"), *[F.col(a).alias(f"{a}{i}") for a in "xyz"])
    f = faces.join(p(0), [*key, "v0"]).join(p(1), [*key, "v1"]).join(p(2), [*key, "v2"])
    u, w = ([F.col(f"{a}{i}") - F.col(f"{a}0") for a in "xyz"] for i in (1, 2))
    n = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    length = F.sqrt(n[0] ** 2 + n[1] ** 2 + n[2] ** 2)
    each = f.select(*key, F.explode(F.array("v0", "v1", "v2")).alias("point_id"), *[(x / F.greatest(length, F.lit(1e-6))).alias(c) for x, c in zip(n, ("nx", "ny", "nz"))])
    mean = each.groupBy(*key, "point_id").agg(*[F.avg(c).alias(c) for c in ("nx", "ny", "nz")])
    size = F.greatest(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), F.lit(1e-6)) if unit else F.lit(1.0)
    return mean.select(*key, "point_id", *[(F.col(c) / size).alias(c) for c in ("nx", "ny", "nz")])


def eigenvalues(cxx: Column, cxy: Column, cxz: Column, cyy: Column, cyz: Column, czz: Column) -> list[Column]:
    """The three eigenvalues of a symmetric 3 x 3 matrix, largest first, in closed form (angles of the characteristic cubic)."""
    mean = (cxx + cyy + czz) / 3
    off = cxy * cxy + cxz * cxz + cyz * cyz
    scale = F.sqrt(((cxx - mean) ** 2 + (cyy - mean) ** 2 + (czz - mean) ** 2 + 2 * off) / 6)
    x, y, z = cxx - mean, cyy - mean, czz - mean
    det = x * (y * z - cyz * cyz) - cxy * (cxy * z - cyz * cxz) + cxz * (cxy * cyz - y * cxz)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / F.nullif(2 * scale * scale * scale, F.lit(0.0))))) / 3
    top, low = mean + 2 * scale * F.cos(turn), mean + 2 * scale * F.cos(turn + 2.0943951023931953)
    flat = scale <= 0
    return [F.when(flat, mean).otherwise(v) for v in (top, 3 * mean - top - low, low)]


def shape_features(points: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, linearity, planarity, scattering, residual, extent_x, extent_y, extent_z, aspect, density) of each set's points.

    The first three and the plane residual (square root of the least eigenvalue) come from the covariance, in closed form: no
    row leaves the JVM. aspect: longest over shortest extent, at least 1e-6; density: points per volume of the box, extents at least 1e-6. Fewer than three
    points, or no extent, give 0 for the first four.
    """
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs], *[(F.max(a) - F.min(a)).alias(f"extent_{a}") for a in "xyz"])
    e = sums.withColumns({f"__e{i}": F.greatest(v, F.lit(0.0)) for i, v in enumerate(eigenvalues(*[F.col(f"c{a}{b}") for a, b in pairs]))})
    a, b, c = (F.col(f"__e{i}") for i in range(3))
    none = (a <= 1e-12) | (F.col("n") < 3)
    wide = [F.greatest(F.col(f"extent_{x}"), F.lit(1e-6)) for x in "xyz"]
    each = {"linearity": (a - b) / F.nullif(a, F.lit(0.0)), "planarity": (b - c) / F.nullif(a, F.lit(0.0)), "scattering": c / F.nullif(a, F.lit(0.0)), "residual": F.sqrt(c)}
    out = e.withColumns({k: F.when(none, F.lit(0.0)).otherwise(v) for k, v in each.items()} | {"aspect": F.greatest(*wide) / F.least(*wide), "density": F.col("n") / (wide[0] * wide[1] * wide[2])})
    return out.select(*key, "n", *each, *[f"extent_{x}" for x in "xyz"], "aspect", "density")


def oriented_iou(a: list[Column], b: list[Column]) -> Column:
    """IoU of two boxes turned about z, each given as (x, y, z, length, width, height, angle) around its centre; 0 without volume.

    The ground plans are clipped against one another, edge by edge: a polygon is an array of corners, and every edge of the other one keeps
    what is on its left. All of it is column expressions over at most eight corners, so no row leaves the JVM.
    """
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def corners(box: list[Column]) -> Column:
        x, y, _, dx, dy, _, turn = box
        c, s = F.cos(turn), F.sin(turn)
        at = lambda u, v: point(x + c * dx * u - s * dy * v, y + s * dx * u + c * dy * v)
        return F.array(at(0.5, 0.5), at(-0.5, 0.5), at(-0.5, -0.5), at(0.5, -0.5))

    def clipped(poly: Column, edge: Column) -> Column:
        p, q = edge["p"], edge["q"]
        side = lambda c: (q["x"] - p["x"]) * (c["y"] - p["y"]) - (q["y"] - p["y"]) * (c["x"] - p["x"])

        def step(c: Column, i: Column) -> Column:
            n = F.element_at(poly, (F.pmod(i + 1, F.size(poly)) + 1).cast("int"))
            u, v = side(c), side(n)
            part = u / F.nullif(u - v, F.lit(0.0))
            cross = point(c["x"] + (n["x"] - c["x"]) * part, c["y"] + (n["y"] - c["y"]) * part)
            none = F.array().cast("array<struct<x:double,y:double>>")
            return F.concat(F.when(u >= 0, F.array(c)).otherwise(none), F.when(u * v < 0, F.array(cross)).otherwise(none))

        return F.flatten(F.transform(poly, step))

    ring = lambda poly: F.transform(poly, lambda c, i: F.struct(c.alias("p"), F.element_at(poly, (F.pmod(i + 1, F.size(poly)) + 1).cast("int")).alias("q")))
    shared = F.aggregate(ring(corners(b)), corners(a), clipped)
    area = F.abs(F.aggregate(ring(shared), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2
    high = F.greatest(F.lit(0.0), F.least(a[2] + a[5] / 2, b[2] + b[5] / 2) - F.greatest(a[2] - a[5] / 2, b[2] - b[5] / 2))
    both = area * high
    whole = a[3] * a[4] * a[5] + b[3] * b[4] * b[5] - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def edge_weights(edges: DataFrame, points: DataFrame, key: list[str], spatial: float = 1.0, normal: float = 1.0, colour: float = 1.0) -> DataFrame:
    """(key, a, b, weight): distance over the median distance, angle between normals and difference of colours, weighted.

    edges: key, a, b; points: key, point_id, x, y, z, nx, ny, nz, r, g, b_. The normal term is 1 - |cosine|; all edges give the median.
    """
    names = ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b_")
    side = lambda s: points.select(*key, F.col("point_id").alias(s), *[F.col(n).alias(f"{s}_{n}") for n in names])
    e = edges.select(*key, "a", "b").join(side("a"), [*key, "a"]).join(side("b"), [*key, "b"])
    apart = lambda cols: F.sqrt(sum(((F.col(f"a_{n}") - F.col(f"b_{n}")) ** 2 for n in cols), F.lit(0.0)))
    dot = sum((F.col(f"a_{n}") * F.col(f"b_{n}") for n in names[3:6]), F.lit(0.0))
    e = e.select(*key, "a", "b", apart(names[:3]).alias("__d"), (1 - F.least(F.lit(1.0), F.abs(dot))).alias("__n"), apart(names[6:]).alias("__c"))
    middle = e.agg(F.percentile("__d", 0.5).alias("__m"))
    return e.crossJoin(F.broadcast(middle)).select(*key, "a", "b", (spatial * F.col("__d") / F.greatest("__m", F.lit(1e-12)) + normal * F.col("__n") + colour * F.col("__c")).alias("weight"))


def mesh_weights(points: DataFrame, faces: DataFrame, key: list[str]) -> DataFrame:
    """(key, left, right, weight): 1 - the product of the vertices' mean normals for each mesh edge, squared where the edge is convex.

    points: key, point_id, x, y, z. An edge is convex where the second normal points away from the first vertex.
    """
    n = vertex_normals(points, faces, key, unit=False).join(points, [*key, "point_id"])
    side = lambda s: n.select(*key, F.col("point_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("nx", "ny", "nz", "x", "y", "z")])
    e = mesh_edges(faces, key).join(side("left"), [*key, "left"]).join(side("right"), [*key, "right"])
    c = F.col
    bend = 1 - sum((c(f"left_n{a}") * c(f"right_n{a}") for a in "xyz"), F.lit(0.0))
    away = sum((c(f"right_n{a}") * (c(f"right_{a}") - c(f"left_{a}")) for a in "xyz"), F.lit(0.0))
    return e.select(*key, "left", "right", F.when(away > 1e-12, bend * bend).otherwise(bend).alias("weight"))


def segment_profile(points: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, cx, cy, cz, r, g, b_, nx, ny, nz, planarity): centre, mean colour, mean normal with length 1, and planarity of each segment."""
    mean = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"c{a}") for a in "xyz"], *[F.avg(a).alias(a) for a in ("r", "g", "b_", "nx", "ny", "nz")])
    size = F.greatest(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), F.lit(1e-6))
    out = mean.withColumns({a: F.col(a) / size for a in ("nx", "ny", "nz")})
    flat = shape_features(points, key).select(*key, "planarity")
    return out.join(flat, key)


def rigid(x: Column, y: Column, z: Column, matrix: list[float]) -> list[Column]:
    """A point under a 4 x 4 transform given by rows."""
    return [x * matrix[4 * i] + y * matrix[4 * i + 1] + z * matrix[4 * i + 2] + matrix[4 * i + 3] for i in range(3)]


def boundary_cuts(edges: DataFrame, labels: DataFrame, key: list[str], least: int, share: float, unknown: int = 0) -> DataFrame:
    """(key, left, right, observed, conflicts, keep): edges whose ends bear different 2D labels in enough of the frames that see both.

    labels: key, frame_id, point_id, label. A frame counts if both ends have a known label. An edge that no frame sees is kept.
    """
    of = lambda side: labels.where(F.col("label") != unknown).select(*key, "frame_id", F.col("point_id").alias(side), F.col("label").alias(f"label_{side}"))
    seen = edges.join(of("left"), [*key, "left"]).join(of("right"), [*key, "right", "frame_id"])
    counts = seen.groupBy(*key, "left", "right").agg(F.count(F.lit(1)).alias("observed"), F.count_if(F.col("label_left") != F.col("label_right")).alias("conflicts"))
    out = edges.join(counts, [*key, "left", "right"], "left").fillna(0, ["observed", "conflicts"])
    cutting = (F.col("observed") >= least) & (F.col("conflicts") >= F.col("observed") * share) & (F.col("conflicts") > 0)
    return out.select(*key, "left", "right", "observed", "conflicts", (~cutting).alias("keep"))
