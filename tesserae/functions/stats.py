"""The median variants that gates and aggregates use; each differs in ties of even groups and in what an empty group gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled_round(c: Column, digits: int) -> Column:
    """Rounds the scaled double, as SQL engines in C++ do, not its decimal digits: 1.005 is a little less, and gives 1.0 at two digits."""
    return F.round(c * 10.0**digits) / 10.0**digits


def sorted_values(c: Column) -> Column:
    """The group's values in order. Groups here are small by nature (a frame pair, a track); nulls are left out."""
    return F.array_sort(F.collect_list(c))


def median_or(c: Column, empty: float | None) -> Column:
    """Mean of the two middle values; `empty` (0, inf or null) for a group without values."""
    m = F.median(c)
    return m if empty is None else F.coalesce(m, F.lit(float(empty)))


def upper_median(c: Column) -> Column:
    """v[n // 2] of the sorted values; null if there are none."""
    v = sorted_values(c)
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def lower_median(c: Column) -> Column:
    """v[(n - 1) // 2] of the sorted values; null if there are none."""
    v = sorted_values(c)
    return F.get(v, F.floor((F.size(v) - 1) / 2).cast("int"))


def nearest_rank(c: Column, q: float) -> Column:
    """v[round((n - 1) * q)], halves away from zero."""
    v = sorted_values(c)
    return F.get(v, F.floor((F.size(v) - 1) * q + 0.5).cast("int"))


def upper_quantile(c: Column, numerator: int, denominator: int) -> Column:
    """v[n * numerator // denominator], such as 3 n / 4."""
    v = sorted_values(c)
    return F.get(v, F.floor(F.size(v) * numerator / denominator).cast("int"))


def geometric_mean(c: Column) -> Column:
    """exp of the mean log; 0 if any value is 0 or less."""
    positive = F.when(c > 0, F.log(c))
    return F.when(F.min(c) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(positive)))


def at_rank(values: DataFrame, column: str, rank: int, held: int = 10_000) -> float | None:
    """The value at a rank (from 0) of a whole column without nulls, exactly; null beyond its rows.

    Approximate quantiles about the rank narrow the values down, by counts, until at most `held` are left, or all left are equal.
    """
    n = values.count()
    if not 0 <= rank < n:
        return None
    c = F.col(column)
    while n > held:
        lo, hi = values.approxQuantile(column, [max(0.0, (rank - n / 100) / n), min(1.0, (rank + n / 100) / n)], 0.005)
        found = values.agg(F.count_if(c < lo).alias("below"), F.count_if((c >= lo) & (c <= hi)).alias("within")).first()
        if not found["below"] <= rank < found["below"] + found["within"] or found["within"] == n:
            lo, hi = values.agg(F.min(c), F.max(c)).first()
            if lo == hi:
                return lo
            middle = (lo + hi) / 2
            low = values.where(c <= middle).count()
            values, rank, n = (values.where(c <= middle), rank, low) if rank < low else (values.where(c > middle), rank - low, n - low)
            continue
        values, rank, n = values.where(c.between(lo, hi)), rank - found["below"], found["within"]
    return sorted(r[0] for r in values.select(column).collect())[rank]
