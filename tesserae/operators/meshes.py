"""Mesh operators that run to a fix point: moves of pairs of vertices that keep every triangle's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.lineage import discard, materialise

# Fixed values of the rule: a triangle keeps so much of its area, and its normal so much of its direction; less area than that is none.
AREA, DIRECTION, FLAT = 0.75, 0.985, 1e-9


def normal(prefixes: str) -> list[Column]:
    """Cross product of a triangle's sides ab and ac; columns <prefix><corner><axis>, a prefix for each corner."""
    of = dict(zip("abc", prefixes))
    d = lambda c, k: f"({of[c]}{c}{k} - {of['a']}a{k})"
    return [F.expr(f"{d('b', i)} * {d('c', j)} - {d('b', j)} * {d('c', i)}") for i, j in (("y", "z"), ("z", "x"), ("x", "y"))]


def dot(p: list[Column], q: list[Column]) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def corner(place: str, goal: str) -> Column:
    """What a triangle knows of a vertex: its place (struct of x, y, z), and the move that holds for it with its goal (struct of move, x, y, z, or null)."""
    return F.struct(*[F.col(f"{place}.{k}").alias(f"p{k}") for k in "xyz"], F.col(f"{goal}.move").alias("m"), *[F.col(f"{goal}.{k}").alias(f"g{k}") for k in "xyz"])


def safe_moves(triangles: DataFrame, points: DataFrame, moves: DataFrame) -> DataFrame:
    """triangles: tid, a, b, c; points: id, x, y, z; moves: move, first, second, x, y, z (both vertices go there). The moves that are left once no triangle suffers.

    A move of a vertex without a place is dropped, and a triangle with one counts as harmed. Two moves of one vertex: the later
    one (by `move`) holds for it. The rule is that of settled().
    """
    known = points.select(F.col("id").alias("k"))
    active = moves.join(known, F.expr("first = k"), "left_semi").join(known, F.expr("second = k"), "left_semi")
    active = materialise(active, "moves")
    holds = materialise(active.select("move", F.explode(F.array("first", "second")).alias("id"), "x", "y", "z").groupBy("id").agg(F.max(F.struct("move", "x", "y", "z")).alias("goal")), "holds")
    at = points.select(F.col("id").alias("i"), F.struct("x", "y", "z").alias("place")).join(holds, F.expr("i = id"), "left").select("i", corner("place", "goal").alias("at"))
    touched = triangles.select("tid", "a", "b", "c", F.explode(F.array("a", "b", "c")).alias("id")).join(holds.select("id"), "id", "left_semi").select("tid", "a", "b", "c").distinct()
    for c in "abc":
        touched = touched.join(at.select(F.col("i").alias("j"), F.col("at").alias(f"at{c}")), F.expr(f"{c} = j"), "left").drop("j")
    return settled(touched.select(*[F.col(f"at{c}").alias(c) for c in "abc"]), active)


def cases(triangles: DataFrame) -> DataFrame:
    """ma, mb, mc, bad for each triangle (a, b, c: corner()) that may suffer: its moves, and a bit for each set of corners (1, 2, 4) that it can't bear being moved."""
    known = lambda c, k: F.coalesce(F.col(f"{c}.{k}"), F.lit(float("nan"))).alias(f"{k[0]}{c}{k[1]}")
    t = triangles.select(*[F.col(f"{c}.m").alias(f"m{c}") for c in "abc"], *[known(c, p + k) for c in "abc" for p in "pg" for k in "xyz"]).where("ma is not null or mb is not null or mc is not null")
    t = t.withColumns(dict(zip(("nx", "ny", "nz"), normal("ppp"))))
    before = [F.col(f"n{k}") for k in "xyz"]
    t = t.withColumn("size", F.sqrt(dot(before, before)))
    bad = F.lit(0)
    for case in range(1, 8):
        t = t.withColumns(dict(zip((f"r{case}x", f"r{case}y", f"r{case}z"), normal("".join("pg"[case >> i & 1] for i in range(3))))))
        after = [F.col(f"r{case}{k}") for k in "xyz"]
        t = t.withColumn(f"new{case}", F.sqrt(dot(after, after)))
        size, new = F.col("size"), F.col(f"new{case}")
        fine = (size > FLAT) & (size < float("inf")) & (new >= size * AREA) & (new < float("inf")) & (dot(before, after) / (size * new) >= DIRECTION)
        moved = F.expr(" and ".join(f"m{c} is not null" for i, c in enumerate("abc") if case >> i & 1))
        bad = bad + F.when(moved & ~fine, 1 << case).otherwise(0)
    return t.select("ma", "mb", "mc", bad.alias("bad")).where("bad <> 0")


#: For each set of corners the bits of its subsets, itself left out.
SUBSETS = [sum(1 << k for k in range(1, case) if k & case == k) for case in range(8)]


def settled(triangles: DataFrame, active: DataFrame) -> DataFrame:
    """triangles: a, b, c, each a corner(); active: move and more. The moves that are left once no triangle suffers.

    A triangle at a moved vertex suffers if it was flat, loses over a quarter of its area or turns its normal below 0.985 of its
    direction. Each round takes back all active moves at the corners of triangles that suffer, since one of them alone may be to blame;
    rounds end when there is none. A move taken back can harm a neighbour, so a round may add some, but active ones only become
    fewer. Whether a triangle suffers depends only on which corners are moved, so all cases are worked out at once, and rounds have no more than
    three moves and a number for each triangle. At first all moves are active, which needs no join; later rounds see only triangles that
    what was taken back can still harm: those that suffered are still, and so are those of one move.
    """
    state = F.expr("if(ma is null, 0, 1) + if(mb is null, 0, 2) + if(mc is null, 0, 4)")
    bit = lambda c: F.element_at(F.array(*[F.lit(x) for x in c]), state + 1)
    suffers = F.col("bad").bitwiseAND(bit([1 << k for k in range(8)])) != 0
    rest, taken = materialise(cases(triangles), "cases"), None
    while True:
        stopped = materialise(rest.where(suffers).select(F.explode(F.array("ma", "mb", "mc")).alias("move")).where("move is not null").distinct(), "stopped")
        if stopped.isEmpty():
            return active if taken is None else active.join(taken, "move", "left_anti")
        taken = stopped if taken is None else taken.unionByName(stopped)
        left = rest.where(~suffers & (F.col("bad").bitwiseAND(bit(SUBSETS)) != 0))
        for c in "abc":
            left = left.join(stopped.select(F.col("move").alias("n")), F.expr(f"m{c} = n"), "left").withColumn(f"m{c}", F.expr(f"if(n is null, m{c}, null)")).drop("n")
        old, rest = rest, materialise(left.where(F.col("bad").bitwiseAND(bit([SUBSETS[k] | (1 << k if k else 0) for k in range(8)])) != 0), "cases")
        discard(old)
