"""Meshes as tables: grid triangles and their gates, edges, components' sizes, normals, ownership of corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.sizing import dealt, joined, partitions


def best_points(points: DataFrame, by: tuple = ()) -> DataFrame:
    """points: by, gx, gy, id, confidence. The id that stands for each grid cell: most confidence, then the lower one."""
    return dealt(points, partitions(points), *by, "gx", "gy").groupBy(*by, "gx", "gy").agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("id"))


def grid_cells(points: DataFrame, by: tuple = (), single: bool = False, whole: bool = False) -> DataFrame:
    """points: by, gx, gy, id, confidence. Cells of each grid with the best point at each of their corners, null where there is none. single: no two points of a grid are in one place.

    whole: the points are dealt by grid, or left to Spark, and cells stay where their points are. With single, ids may be structs.
    """
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (0, 1) for j in (0, 1)]))
    at = (points.select(*by, "gx", "gy", "id") if single else best_points(points, by)).withColumn("s", shifts)
    corner = lambda i, j: F.max(F.when((F.col("s.dx") == i) & (F.col("s.dy") == j), F.col("id"))).alias(f"p{i}{j}")
    at = at.select("*", (F.col("gx") - F.col("s.dx")).alias("cx"), (F.col("gy") - F.col("s.dy")).alias("cy"))
    return dealt(at, 0 if whole else partitions(points), *by, "cx", "cy").groupBy(*by, "cx", "cy").agg(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))


def cell_triangles(cells: DataFrame, by: tuple = ()) -> DataFrame:
    """Triangles of cells with three corners or more: two for a full cell, one for a cell that lacks a corner; (a, b, c) run the same way round."""
    a, b, c, d = (F.col(x) for x in ("p00", "p10", "p01", "p11"))
    tri = lambda *p: F.struct(*[v.alias(n) for v, n in zip(p, "abc")])
    kind = cells.schema["p00"].dataType.simpleString()
    none = F.array().cast(f"array<struct<a:{kind},b:{kind},c:{kind}>>")
    has = lambda *p: F.coalesce(sum(v.isNotNull().cast("int") for v in p) == len(p), F.lit(False))
    made = F.when(has(a, b, c, d), F.array(tri(a, b, c), tri(b, d, c))).when(has(a, b, c), F.array(tri(a, b, c))).when(has(b, d, c), F.array(tri(b, d, c))).when(has(a, b, d), F.array(tri(a, b, d))).when(has(a, d, c), F.array(tri(a, d, c))).otherwise(none)
    return cells.select(*by, "cx", "cy", F.explode(made).alias("t")).select(*by, "cx", "cy", "t.*")


def triangle_gate(depths: list[Column], signed_area: Column, edges: list[Column], stride: float, focal: float, jump: float = 0.15, reach: float = 3.0, floor: float = 1e-3) -> Column:
    """Name of the gate that stops a triangle, null if none: a depth jump, a turned or thin projection, a long edge."""
    low, high = F.least(*depths), F.greatest(*depths)
    step = sum(depths) / 3 * stride / focal
    out = F.when(F.greatest(*edges) > step * (2**0.5) * reach, "discontinuity")
    out = F.when(signed_area <= stride * stride * floor, "degenerate").otherwise(out)
    return F.when((low <= 0) | ((high - low) / high > jump), "discontinuity").otherwise(out)


def distinct_triangles(triangles: DataFrame) -> DataFrame:
    """One of the triangles over the same three vertices: that of the least index."""
    key = F.array_sort(F.array("a", "b", "c"))
    return triangles.groupBy(key.alias("key")).agg(F.min(F.struct("triangle_index", "a", "b", "c")).alias("t")).select("t.*")


def edges(triangles: DataFrame) -> DataFrame:
    """Undirected edges with the number of triangles that use them; boundaries are used once."""
    side = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    each = triangles.select(F.explode(F.array(side("a", "b"), side("b", "c"), side("c", "a"))).alias("e")).select("e.*")
    return dealt(each, partitions(triangles), "u", "v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("used"))


def vertex_normals(triangles: DataFrame, points: DataFrame) -> DataFrame:
    """Unit normals: area-weighted face normals summed at each corner. points: id, x, y, z."""
    t, n = triangles.select("a", "b", "c"), partitions(triangles)
    for corner in "abc":
        t = joined(t, points.select(F.col("id").alias(f"i{corner}"), *[F.col(k).alias(f"{corner}{k}") for k in "xyz"]), n, corner, f"i{corner}")
    u, v = ([F.col(f"{c}{k}") - F.col(f"a{k}") for k in "xyz"] for c in "bc")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    each = t.select(F.explode(F.array("a", "b", "c")).alias("id"), *[c.alias(k) for c, k in zip(cross, ("nx", "ny", "nz"))])
    s = each.groupBy("id").agg(*[F.sum(k).alias(k) for k in ("nx", "ny", "nz")])
    size = F.sqrt(F.expr("nx * nx + ny * ny + nz * nz"))
    return s.select("id", *[F.when(size > 0, F.col(k) / size).alias(k) for k in ("nx", "ny", "nz")])


def corner_owners(triangles: DataFrame, owners: DataFrame) -> DataFrame:
    """owners: id, region. For each triangle its number of different regions, the region if it is one, and whether it is mixed."""
    n = partitions(triangles)
    each = joined(triangles.select("triangle_index", F.explode(F.array("a", "b", "c")).alias("corner")), owners, n, "corner", "id", "left").select("triangle_index", "region")
    out = dealt(each, n, "triangle_index").groupBy("triangle_index").agg(F.count_distinct("region").alias("regions"), F.min("region").alias("region"), F.count_if(F.col("region").isNull()).alias("unowned"))
    return out.select("triangle_index", "regions", F.when((F.col("regions") == 1) & (F.col("unowned") == 0), F.col("region")).alias("region"), ((F.col("regions") > 1) | (F.col("unowned") > 0)).alias("mixed"))
