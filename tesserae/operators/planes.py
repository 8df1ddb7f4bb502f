"""Planes through points from moments that merge: no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest_axis(xx: str, xy: str, xz: str, yy: str, yz: str, zz: str) -> tuple[Column, Column]:
    """(least eigenvalue, its unit eigenvector as an array, null if it is not single) of a symmetric matrix of columns, in closed form.

    The eigenvalues are q + 2 p cos(phi + 2 pi k / 3); the vector is the largest cross product of two rows of what is left once the least is taken off the diagonal.
    """
    q = f"(({xx} + {yy} + {zz}) / 3)"
    p = f"sqrt((pow({xx} - {q}, 2) + pow({yy} - {q}, 2) + pow({zz} - {q}, 2) + 2 * (pow({xy}, 2) + pow({xz}, 2) + pow({yz}, 2))) / 6)"
    a, b, c = f"(({xx} - {q}) / {p})", f"(({yy} - {q}) / {p})", f"(({zz} - {q}) / {p})"
    d, e, f = f"({xy} / {p})", f"({xz} / {p})", f"({yz} / {p})"
    half = f"(({a} * ({b} * {c} - {f} * {f}) - {d} * ({d} * {c} - {f} * {e}) + {e} * ({d} * {f} - {b} * {e})) / 2)"
    least = f"if({p} = 0, {q}, {q} + 2 * {p} * cos(acos(greatest(-1D, least(1D, {half}))) / 3 + 2 * pi() / 3))"
    rows = [(f"({xx} - low)", xy, xz), (xy, f"({yy} - low)", yz), (xz, yz, f"({zz} - low)")]
    cross = lambda u, v: F.array(*[F.expr(f"{u[i]} * {v[j]} - {u[j]} * {v[i]}") for i, j in ((1, 2), (2, 0), (0, 1))])
    each = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    best = F.array_max(F.array(*[F.struct(size(v).alias("size"), v.alias("v")) for v in each]))
    single = best["size"] > 1e-13 * F.expr(f"pow({xx} + {yy} + {zz}, 4)")  # the differences to the other eigenvalues, as a share of all
    return F.expr(least), F.when(single, F.transform(best["v"], lambda x: x / F.sqrt(best["size"])))


def planes(points: DataFrame, by: list[str]) -> DataFrame:
    """points: by, x, y, z. The plane of each group of three points or more: n, cx, cy, cz, nx, ny, nz (unit, its largest component positive), offset (normal . x), rms distance.

    The normal is the direction of least spread about the centre; null where two directions have the same least one, such as for points on a line. Rows with a null are left out.
    """
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    whole = points.where("x is not null and y is not null and z is not null")
    m = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"c{c}") for c in "xyz"], *[F.covar_pop(F.col(i).cast("double"), F.col(j).cast("double")).alias(f"{i}{j}") for i, j in pairs]).where("n >= 3")
    low, axis = smallest_axis("xx", "xy", "xz", "yy", "yz", "zz")
    v = m.withColumn("low", low).withColumn("v", axis)
    largest = F.array_max(F.transform("v", lambda x: F.struct(F.abs(x).alias("a"), x.alias("x"))))["x"]
    v = v.withColumn("v", F.transform("v", lambda x: x * F.signum(largest)))
    at = F.expr("v[0] * cx + v[1] * cy + v[2] * cz")
    return v.select(*by, "n", "cx", "cy", "cz", *[F.col("v")[i].alias(f"n{c}") for i, c in enumerate("xyz")], at.alias("offset"), F.sqrt(F.greatest("low", F.lit(0.0))).alias("rms"))
