"""Sampling plans: at which times to take frames of a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(clips: DataFrame, duration: str, rate: float = 1.25, least: int = 4, floor: int = 18, most: int = 120) -> DataFrame:
    """clips with frames, first, last and step: even times over 5 to 95 % of the duration.

    As many frames as the rate gives, no more than max(floor, ceil(seconds)) and `most`, no fewer than `least`.
    """
    d = F.col(duration)
    cap = F.least(F.lit(most), F.greatest(F.lit(floor), F.ceil(d)))
    n = F.greatest(F.lit(least), F.least(F.floor(d * rate), cap)).cast("long")
    out = clips.withColumn("frames", n).withColumn("first", d * 0.05).withColumn("last", d * 0.95)
    return out.withColumn("step", d * 0.9 / (F.col("frames") - 1))


def times(planned: DataFrame) -> DataFrame:
    """One row for each frame of a plan: frame_index and requested_s."""
    each = planned.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)).alias("frame_index", "_k"))
    return each.withColumn("requested_s", F.col("first") + F.col("step") * F.col("_k")).drop("_k")
