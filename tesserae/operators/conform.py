"""Edges made to conform: vertices that lie inside other triangles' edges are found, and the triangles split at them, until none is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.lineage import discard, materialise
from tesserae.functions.sizing import dealt, joined, partitions, sides

#: A vertex this near to an end of an edge, as a share of it, is that end.
END = 1e-9
#: Cells begin at this share of a cell, so that whole coordinates are not on their borders.
SHIFT = 0.25


def edge_keys(triangles: DataFrame, n: int = 0) -> DataFrame:
    """Each undirected edge (u < v) once."""
    side = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    each = triangles.select(F.explode(F.array(side("a", "b"), side("b", "c"), side("c", "a"))).alias("e")).select("e.*").where("u <> v")
    return dealt(each, sides(triangles, n), "u", "v").distinct()


def on_edges(triangles: DataFrame, points: DataFrame, tolerance: float, cell: float, n: int | None = None) -> DataFrame:
    """(u, v, w, t): vertices w inside edges u < v, at the share t of the way from u, within `tolerance` of the line.

    triangles: a, b, c; points: id, x, y, z. An edge is dealt to the cells (of the side `cell`) along its longest axis that its slice there passes, not to all of its
    box, so a long edge makes as many rows as it is cells long; a point to its own cell and meets each edge once: slices follow each other along
    every axis, so a slice leaves out the cells of the one before it. Corners without a place, and edges
    without a length, are left out. n: partitions of the joins, by the input of the triangles if not given.
    """
    n = partitions(triangles) if n is None else n
    ends = edge_keys(triangles, n)
    for c in "uv":
        ends = joined(ends, points.select(F.col("id").alias("i"), *[F.col(k).alias(f"{k}{c}") for k in "xyz"]), n, c, "i").drop("i")
    span = F.greatest(*[F.abs(F.col(f"{k}v") - F.col(f"{k}u")) for k in "xyz"])
    steps = F.greatest(F.ceil(span / cell).cast("int"), F.lit(1))
    cut = ends.where(span > 0).withColumn("steps", steps).withColumn("s", F.explode(F.expr("sequence(0, steps - 1)")))
    low = lambda k, s: F.expr(f"least({k}u + ({k}v - {k}u) * {s} / steps, {k}u + ({k}v - {k}u) * ({s} + 1) / steps)") - tolerance
    high = lambda k, s: F.expr(f"greatest({k}u + ({k}v - {k}u) * {s} / steps, {k}u + ({k}v - {k}u) * ({s} + 1) / steps)") + tolerance
    at = lambda x: F.floor(x / cell + SHIFT)
    for k in "xyz":
        cut = cut.withColumn(f"c{k}", F.explode(F.sequence(at(low(k, "s")), at(high(k, "s")))))
    before = [F.col(f"c{k}").between(at(low(k, "(s - 1)")), at(high(k, "(s - 1)"))) for k in "xyz"]
    cut = cut.where((F.col("s") == 0) | ~(before[0] & before[1] & before[2])).drop("s", "steps")
    place = points.select(F.col("id").alias("w"), *[F.col(k).alias(f"{k}w") for k in "xyz"], *[at(F.col(k)).alias(f"d{k}") for k in "xyz"])
    m = sides(points, n)
    met = dealt(cut, m, "cx", "cy", "cz").join(dealt(place, m, "dx", "dy", "dz"), F.expr("cx = dx and cy = dy and cz = dz and w <> u and w <> v"))
    along = " + ".join(f"({k}v - {k}u) * ({k}w - {k}u)" for k in "xyz")
    square = " + ".join(f"({k}v - {k}u) * ({k}v - {k}u)" for k in "xyz")
    met = met.withColumn("t", F.expr(f"({along}) / ({square})")).where((F.col("t") > END) & (F.col("t") < 1 - END))
    off = " + ".join(f"pow({k}w - {k}u - t * ({k}v - {k}u), 2)" for k in "xyz")
    return met.where(F.expr(f"sqrt({off})") <= tolerance).select("u", "v", "w", "t")


def conform(triangles: DataFrame, inside: DataFrame, n: int | None = None) -> DataFrame:
    """tid, a, b, c: triangles (tid, a, b, c) split at the vertices inside their edges (u, v, w, t), all on one side of a common edge like on the other.

    Each edge of a piece that is part of an edge of its triangle knows which part it is. A round splits each piece at the vertex nearest to the
    middle of such a part, by a join on the edge's key; so rounds grow with the log of the vertices on an edge, and end when no part has one inside. Pieces keep the
    turn of their triangle. An edge that has the triangle's own third corner inside is a flat triangle's; that vertex is passed over.
    What meets the vertices is an edge's part with the name of its piece, not the whole piece. n: as in on_edges.
    """
    n = sides(triangles, partitions(triangles) if n is None else n)
    key = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), F.when(F.col(p) < F.col(q), 0.0).otherwise(1.0).alias("s"), F.when(F.col(p) < F.col(q), 1.0).otherwise(0.0).alias("t"))
    kind = "struct<u:bigint,v:bigint,s:double,t:double>"
    open_ = materialise(triangles.select("tid", "a", "b", "c", key("a", "b").cast(kind).alias("ab"), key("b", "c").cast(kind).alias("bc"), key("c", "a").cast(kind).alias("ca")), "pieces")
    done = None
    none = F.lit(None).cast(kind)
    while True:
        turned = F.array(*[F.struct(F.lit(i).alias("i"), F.col(p).alias("a"), F.col(q).alias("b"), F.col(r).alias("c"), F.col(e).alias("ab"), F.col(f).alias("bc"), F.col(g).alias("ca")) for i, (p, q, r, e, f, g) in enumerate((("a", "b", "c", "ab", "bc", "ca"), ("b", "c", "a", "bc", "ca", "ab"), ("c", "a", "b", "ca", "ab", "bc")))])
        piece = ["tid", "a", "b", "c"]
        name = [f"k_{c}" for c in piece]
        part = F.expr("transform(turned, x -> struct(x.i, x.c as third, x.ab.u as eu, x.ab.v as ev, x.ab.s as es, x.ab.t as et))")
        parts = open_.withColumn("turned", turned).select(*[F.col(c).alias(f"k_{c}") for c in piece], F.explode(part).alias("e")).select(*name, "e.*").where("eu is not null")
        within = F.expr("eu = u and ev = v and t > least(es, et) + 1e-12 and t < greatest(es, et) - 1e-12 and w <> third")
        met = dealt(parts, n, "eu", "ev").join(dealt(inside, n, "u", "v"), within)
        best = dealt(met, n, *name).groupBy(*name).agg(F.min_by(F.struct("i", "w", "t"), F.struct("i", F.expr("abs(t - (es + et) / 2)"), "w")).alias("best"))
        same = F.expr(" and ".join(f"{c} = k_{c}" for c in piece))
        seen = materialise(dealt(open_, n, *piece).join(best, same, "left").select(*piece, "ab", "bc", "ca", "best"), "seen")
        whole = seen.where("best is null").select(*piece)
        done = whole if done is None else done.unionByName(whole)
        best = seen.where("best is not null").select(F.col("tid").alias("k_tid"), F.struct(F.element_at(turned, F.col("best.i") + 1).alias("side"), F.col("best.w").alias("w"), F.col("best.t").alias("t")).alias("cut"))
        if best.isEmpty():
            return done
        part = lambda s, t: F.struct(F.col("cut.side.ab.u").alias("u"), F.col("cut.side.ab.v").alias("v"), s.alias("s"), t.alias("t")).cast(kind)
        at: Column = F.col("cut.t")
        first = F.struct(F.col("cut.side.a").alias("a"), F.col("cut.w").alias("b"), F.col("cut.side.c").alias("c"), part(F.col("cut.side.ab.s"), at).alias("ab"), none.alias("bc"), F.col("cut.side.ca").alias("ca"))
        second = F.struct(F.col("cut.w").alias("a"), F.col("cut.side.b").alias("b"), F.col("cut.side.c").alias("c"), part(at, F.col("cut.side.ab.t")).alias("ab"), F.col("cut.side.bc").alias("bc"), none.alias("ca"))
        old, open_ = open_, materialise(best.select(F.col("k_tid").alias("tid"), F.explode(F.array(first, second)).alias("p")).select("tid", "p.*"), "pieces")
        discard(old)
