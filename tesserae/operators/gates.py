"""Gates that keep rejected rows with the name of the first gate that stops them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_gate(gates: list[tuple[str, Column]]) -> Column:
    """Name of the first gate, in order, whose condition holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(gates):
        out = F.when(fails, F.lit(name)).otherwise(out)
    return out


def decisive(df: DataFrame, by: list, gate: str, rank: Column) -> DataFrame:
    """Counts by gate, and for each group the gate reached furthest (largest rank, then most rows)."""
    counts = df.where(F.col(gate).isNotNull()).groupBy(*by, gate).agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("rank"))
    return counts.groupBy(*by).agg(F.max_by(gate, F.struct("rank", "n")).alias("decisive"), F.sum("n").alias("rejected"))


def severity(share: Column, warn: float = 0.0, block: float = 0.5) -> Column:
    return F.when(share > block, "blocking").when(share > warn, "warning").otherwise("ok")


def motion_class(motion: Column, residual: Column, matches: Column) -> Column:
    """Kind of a frame pair by how far and how unevenly it moves."""
    return F.when(matches < 6, "unknown").when(motion < 0.25, "duplicate").when(motion < 1.4, "static").when(residual < 0.55, "rotation").otherwise("parallax")


def spread_outliers(df: DataFrame, by: list, value: str, factor: float) -> DataFrame:
    """Rows over factor times their group's median."""
    return df.withColumn("_m", F.median(value).over(Window.partitionBy(*by))).where(F.col(value) > factor * F.col("_m")).drop("_m")


def low_parallax(matches: Column, motion: Column, residual: Column) -> Column:
    """Too few matches, too little motion, or motion that a turn explains."""
    return (matches < 6) | (motion < 1.4) | (residual < 0.55)


def weak_link(matches: Column, overlap: Column) -> Column:
    return (matches < 8) | ((overlap < 0.18) & (matches < 48))


def accepted_pose(inliers: Column, matches: Column, median_error: Column) -> Column:
    share = inliers * 100 >= matches * 55  # whole numbers: 0.55 * 100 is more than 55 in double precision
    return (inliers >= 8) & share & (median_error <= 2.5)


def reciprocal(depth: Column, back: Column, share: float = 0.08) -> Column:
    """Whether the depth found in the other view agrees."""
    return F.abs(back - depth) <= share * depth


def closes(distance: Column, angle: Column, baseline: Column) -> Column:
    """Eligible for closure: near in place and angle, but not where it is already."""
    return (distance <= 0.35 * baseline) & (angle <= 8.0) & ((distance >= 0.005 * baseline) | (angle >= 0.1))


def margin_score(margin: Column) -> Column:
    """Depth margin to 0 .. 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), margin / 6))


def confidence(*factors: Column) -> Column:
    """Product of factors, each held to 0 .. 1."""
    out = F.lit(1.0)
    for f in factors:
        out = out * F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))
    return out


def fused_position(observations: DataFrame, group: str, order: str, first: str = "x", reach: float = 0.08, least: float = 1e-4) -> DataFrame:
    """observations: group, order, x, y, z (depth). The mean of a group's primary observation, the first in order, and of the others within reach of it.

    The reach is a share of the primary's depth, `least` at least. Others that are not finite, or further off, are counted as rejected.
    `first` is the primary's x where it differs. Rows that tie for the first are one primary and others at no distance.
    """
    place = F.struct(F.col(first).alias("x"), "y", "z")
    head = observations.groupBy(group).agg(F.min_by(place, order).alias("p"), F.min(order).alias("o"))
    met = observations.join(head, group)
    distance = F.sqrt(sum((F.col(c) - F.col(f"p.{c}")) ** 2 for c in "xyz"))
    near = ~F.isnan(distance) & (distance <= F.greatest(F.abs(F.col("p.z")) * reach, F.lit(least)))
    met = met.withColumn("others", F.coalesce(near, F.lit(False)) & (F.col(order) != F.col("o"))).withColumn("head", F.col(order) == F.col("o"))
    heads = F.greatest(F.count_if("head"), F.lit(1))
    total = lambda c: F.first(f"p.{c}") * heads + F.coalesce(F.sum(F.when(F.col("others"), F.col(c))), F.lit(0.0))
    n = heads + F.count_if("others")
    return met.groupBy(group).agg(n.alias("observations"), (F.count(F.lit(1)) - n).alias("rejected"), *[(total(c) / n).alias(c) for c in "xyz"])
