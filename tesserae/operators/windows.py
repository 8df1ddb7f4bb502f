"""Ordered-sequence operators: outliers against neighbours, segments, resettable budgets, runs, intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outlier_against_neighbours(df: DataFrame, by: list, order: list, value: str, limit: float, agree: float) -> DataFrame:
    """outlier: the value is over `limit` from both neighbours, who agree within `agree`. local: upper median of the three rows each side."""
    w = Window.partitionBy(*by).orderBy(*order)
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    far = (F.abs(F.col(value) - prev) > limit) & (F.abs(F.col(value) - nxt) > limit) & (F.abs(prev - nxt) <= agree)
    around = F.array_sort(F.collect_list(value).over(w.rowsBetween(-3, 3)))
    return df.withColumn("outlier", F.coalesce(far, F.lit(False))).withColumn("local", F.get(around, F.floor(F.size(around) / 2).cast("int")))


def segments(df: DataFrame, by: list, order: list, breaks: Column) -> DataFrame:
    """Gaps and islands: the running number of breaks."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("segment", F.sum(breaks.cast("int")).over(w).cast("long"))


def runs(df: DataFrame, by: list, value: Column) -> DataFrame:
    """Consecutive integers merged: start, end and length of each run. df must have distinct values by group."""
    w = Window.partitionBy(*by).orderBy("_v")
    marked = df.withColumn("_v", value).withColumn("_run", F.col("_v") - F.row_number().over(w))
    return marked.groupBy(*by, "_run").agg(F.min("_v").alias("start"), F.max("_v").alias("end"), F.count(F.lit(1)).alias("length")).drop("_run")


def budget_marks(df: DataFrame, by: list, order: str, spend: str, weak: str, budget: float) -> DataFrame:
    """Keyframes by a resettable budget: spends add up until the budget is reached, which marks the row and starts anew; a weak row resets.

    The rows of a group lie together in their order, and the sum is carried from batch to batch, so a task holds one batch however
    long the group is. Null keys are a group of their own; rows of equal order follow each other as they come.
    """
    rows = df.select(*by, F.col(order).alias("_o"), F.col(spend).cast("double").alias("_s"), F.coalesce(F.col(weak), F.lit(False)).alias("_w"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"_o {kinds['_o']}"])
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, 0.0
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(n))))
            at, orders = [], []
            for i, (k, s, w) in enumerate(zip(keys, b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist())):
                if (k,) != key:
                    key, total = (k,), 0.0
                    at.append(i)
                    orders.append(None)  # one row without a place for each group, so that none is lost
                total = 0.0 if w else total + (s or 0.0)
                if total >= budget:
                    total = 0.0
                    at.append(i)
                    orders.append(i)
            if at:
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(n)), b.column(n).take(pa.array(orders, pa.int64()))], [*by, "_o"])

    marked = rows.repartition(*by).sortWithinPartitions(*by, "_o").mapInArrow(run, schema)
    return marked.groupBy(*by).agg(F.count("_o").alias("marks"), F.array_sort(F.collect_list("_o")).alias("at"))


def intervals(df: DataFrame, by: list, order: list, time: str, asked: str | None = None) -> DataFrame:
    """Rows, steps that do not advance, least and largest step, and the largest gap between asked and presented time."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_d", F.col(time) - F.lag(time).over(w))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum((F.col("_d") <= 0).cast("long")).alias("stalled"), F.min("_d").alias("least"), F.max("_d").alias("most")]
    if asked:
        aggs.append(F.max(F.abs(F.col(time) - F.col(asked))).alias("seek_error"))
    return d.groupBy(*by).agg(*aggs)


def next_usable(df: DataFrame, by: list, order: str, usable: Column) -> DataFrame:
    """Usable rows with the next usable one and how many rejected rows lie between. order: consecutive integers."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.where(usable).withColumn("next", F.lead(order).over(w)).withColumn("rejected_between", F.col("next") - F.col(order) - 1)


def evenly(df: DataFrame, by: list, order: list, cap: int) -> DataFrame:
    """Every k-th row, k the least step that keeps at most `cap` rows of a group."""
    w = Window.partitionBy(*by)
    k = F.ceil(F.count(F.lit(1)).over(w) / cap)
    return df.withColumn("_k", k).withColumn("_n", F.row_number().over(w.orderBy(*order)) - 1).where(F.col("_n") % F.col("_k") == 0).drop("_k", "_n")
