"""Queries over files that Spark writes from the tables and reads back: point files, trajectories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.functions.lineage import shared_dir
from tesserae.plans.bindings import query, table
from tesserae.sources import scans


@query(
    "s11_scan_points",
    "SELECT l_quantity AS x, round(l_discount * 100, 2) AS y, l_extendedprice AS z, l_linenumber AS r FROM lineitem WHERE l_extendedprice < 20000 AND l_quantity >= 10",
)
def s11_scan_points(spark, sf_dir):
    """Line items as points, written as binary point files and read back; the reader drops what is out of bounds."""
    scans.register(spark)
    path = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    l = table(spark, sf_dir, "lineitem")
    l.select(F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100, 2).alias("y"), F.col("l_extendedprice").alias("z"), F.col("l_linenumber").alias("r")).write.format("ply").mode("append").save(path)
    return spark.read.format("ply").load(path).where((F.col("z") < 20000) & (F.col("x") >= 10))


@query("s11_trajectory", "SELECT o_orderkey AS camera, o_totalprice AS x, (o_custkey % 1000)::DOUBLE AS y, o_orderkey / 4.0 AS z FROM orders")
def s11_trajectory(spark, sf_dir):
    """Orders as cameras along a path, written as a trajectory's text and read back."""
    scans.register(spark)
    path = f"{shared_dir(spark)}/trajectory-{uuid.uuid4().hex}"
    at = [F.col("o_totalprice"), (F.col("o_custkey") % 1000).cast("double"), F.col("o_orderkey") / 4.0]
    rows = [F.concat_ws(" ", *[F.lit(str(int(i == k))) for k in range(3)], c.cast("string")) for i, c in enumerate(at)]
    record = F.concat_ws("\n", F.concat_ws(" ", "o_orderkey", "o_orderkey", F.lit("0")), *rows, F.lit("0 0 0 1"))
    table(spark, sf_dir, "orders").select(record.alias("value")).write.text(path)
    return spark.read.format("trajectory").load(path).select("camera", "x", "y", "z")
