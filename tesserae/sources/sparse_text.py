"""Sparse reconstructions as text: a folder with cameras.txt, images.txt (two lines an image) and points3D.txt; # begins a comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fields(path: str, spark: SparkSession) -> DataFrame:
    """line and its fields, without comments and blank lines. Each line stands for itself, so files may be split."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.where("line <> '' and not startswith(line, '#')").select("line", F.split(F.regexp_replace("line", r"\s+", " "), " ").alias("f"))


def demand(ok: Column, what: str, line: Column, value: Column) -> Column:
    """value, or an error that quotes the line."""
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(what + ": "), line)))


def cameras(spark: SparkSession, folder: str) -> DataFrame:
    """id, model, width, height, params."""
    f = F.col("f")
    rows = fields(f"{folder}/cameras.txt", spark).withColumn("f", demand(F.size(f) >= 5, "a camera needs five fields", F.col("line"), f))
    return rows.select(f[0].cast("int").alias("id"), f[1].alias("model"), f[2].cast("int").alias("width"), f[3].cast("int").alias("height"), F.transform(F.slice(f, 5, 10_000), lambda x: x.cast("double")).alias("params"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """id, qw, qx, qy, qz, tx, ty, tz, camera_id, name, points2d (x, y, point3d_id or null).

    An image is a line and the one after it, so each file is read whole, as one row; there is one such file a reconstruction.
    """
    whole = spark.read.text(f"{folder}/images.txt", wholetext=True)
    kept = F.filter(F.split("value", r"\r?\n", -1), lambda x: ~F.startswith(F.ltrim(x), F.lit("#")))

    def pair(acc: Column, x: Column) -> Column:
        """Blank lines count only as the second of a pair: an image without points."""
        head = F.when(acc["open"], F.lit("")).otherwise(F.trim(x))
        rows = F.when(acc["open"], F.array_append(acc["rows"], F.struct(acc["head"].alias("a"), F.trim(x).alias("b")))).otherwise(acc["rows"])
        return F.struct((~acc["open"] & (F.trim(x) != "")).alias("open"), head.alias("head"), rows.alias("rows"))

    start = F.struct(F.lit(False).alias("open"), F.lit("").alias("head"), F.array().cast("array<struct<a:string,b:string>>").alias("rows"))
    done = F.aggregate(kept, start, pair, lambda acc: F.when(acc["open"], F.array_append(acc["rows"], F.struct(acc["head"].alias("a"), F.lit("").alias("b")))).otherwise(acc["rows"]))
    cut = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    rows = whole.select(F.explode(done).alias("r")).select(F.col("r.a").alias("line"), cut(F.col("r.a")).alias("f"), cut(F.col("r.b")).alias("p"))
    f, p = F.col("f"), F.col("p")
    rows = rows.withColumn("f", demand(F.size(f) >= 10, "an image needs ten fields", F.col("line"), f)).withColumn("p", demand(F.size(p) % 3 == 0, "points of an image come in threes", F.col("line"), p))
    triples = F.transform(F.filter(F.transform(p, lambda x, i: i), lambda i: i % 3 == 0), lambda i: F.struct(F.get(p, i).cast("double").alias("x"), F.get(p, i + 1).cast("double").alias("y"), F.when(F.get(p, i + 2) != "-1", F.get(p, i + 2).cast("long")).alias("point3d_id")))
    names = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]
    return rows.select(f[0].cast("int").alias("id"), *[f[k + 1].cast("double").alias(n) for k, n in enumerate(names)], f[8].cast("int").alias("camera_id"), F.array_join(F.slice(f, 10, 10_000), " ").alias("name"), triples.alias("points2d"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    """id, x, y, z, r, g, b, error, track (image_id, point2d_index)."""
    f = F.col("f")
    rows = fields(f"{folder}/points3D.txt", spark).withColumn("f", demand((F.size(f) >= 8) & (F.size(f) % 2 == 0), "a point needs eight fields and pairs", F.col("line"), f))
    rest = F.slice(f, 9, 1_000_000)
    track = F.transform(F.filter(F.transform(rest, lambda x, i: i), lambda i: i % 2 == 0), lambda i: F.struct(F.get(rest, i).cast("int").alias("image_id"), F.get(rest, i + 1).cast("int").alias("point2d_index")))
    return rows.select(f[0].cast("long").alias("id"), *[f[k + 1].cast("double").alias(n) for k, n in enumerate("xyz")], *[f[k + 4].cast("int").alias(n) for k, n in enumerate("rgb")], f[7].cast("double").alias("error"), track.alias("track"))
