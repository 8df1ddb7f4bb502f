"""Queries over generated image sequences: features, matches, tracks, poses, landmarks, and their distance from the truth. No SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.lineage import materialise
from tesserae.operators import cameras, geometry, graph, images, matching
from tesserae.sources import fixtures

QUERIES: dict = {}
SIZE = (fixtures.FOCAL, fixtures.WIDTH, fixtures.HEIGHT)


def query(f):
    QUERIES[f.__name__] = f
    return f


def features(spark, scenario: str = "lateral") -> DataFrame:
    return images.detect(fixtures.frames(spark, scenario))


def matched(found: DataFrame, radius: float = 42.0, ratio: float = 0.82, limit: float = 36.0) -> DataFrame:
    """Adjacent frames: nearest by mean absolute difference within the radius, ratio test, greedy one to one; with both places."""
    f = found.select(F.col("frame_index").alias("frame"), F.col("feature_index").alias("id"), "x", "y", F.col("descriptor").alias("d"))
    pairs = matching.candidate_pairs(f, radius=radius)
    m = pairs.select("frame_a", "frame_b", "a", "b", matching.l1(F.col("da"), F.col("db")).alias("distance"))
    kept = matching.one_to_one(matching.ratio_matches(m, ratio, limit))
    at = found.select("clip_id", "frame_index", "feature_index", "x", "y")
    a = at.withColumnsRenamed({"frame_index": "fa", "feature_index": "ia", "x": "xa", "y": "ya"})
    b = at.drop("clip_id").withColumnsRenamed({"frame_index": "fb", "feature_index": "ib", "x": "xb", "y": "yb"})
    return kept.join(a, F.expr("frame_a = fa and a = ia")).join(b, F.expr("frame_b = fb and b = ib")).select("clip_id", "frame_a", "frame_b", "a", "b", "distance", "xa", "ya", "xb", "yb")


@query
def p9_frame_quality(spark, sf_dir) -> DataFrame:
    return images.quality(fixtures.frames(spark)).select("frame_index", *[F.round(c, 6).alias(c) for c in ("mean_luma", "crushed", "clipped", "texture", "sharpness", "blockiness")])


@query
def p2_features(spark, sf_dir) -> DataFrame:
    return features(spark).select("frame_index", "feature_index", "x", "y", "score", "descriptor")


@query
def s3_violations(spark, sf_dir) -> DataFrame:
    """Requests that break a rule; the generated clip has one frame cut short here."""
    cut = fixtures.frames(spark).withColumn("rgba", F.when(F.col("frame_index") == 3, F.substring("rgba", 1, 100)).otherwise(F.col("rgba")))
    return images.violations(cut)


@query
def a1_scene_pair_stats(spark, sf_dir) -> DataFrame:
    """Counts, overlap, median motion and low parallax for each adjacent pair."""
    found = features(spark)
    n = found.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n"))
    m = matched(found).withColumn("dx", F.col("xb") - F.col("xa")).withColumn("dy", F.col("yb") - F.col("ya"))
    s = m.groupBy("frame_a", "frame_b").agg(F.count(F.lit(1)).alias("matches"), F.median("dx").alias("median_dx"), F.median("dy").alias("median_dy"), F.median(F.sqrt(F.expr("dx * dx + dy * dy"))).alias("median_motion"))
    met = s.join(n.withColumnsRenamed({"frame_index": "fa", "n": "na"}), F.expr("frame_a = fa")).join(n.withColumnsRenamed({"frame_index": "fb", "n": "nb"}), F.expr("frame_b = fb"))
    return met.select("frame_a", "frame_b", F.col("na").alias("features_from"), F.col("nb").alias("features_to"), "matches", F.round(F.expr("matches / least(na, nb)"), 6).alias("overlap"), "median_dx", "median_dy", F.round("median_motion", 6).alias("median_motion"), F.expr("matches < 6 or median_motion < 1.4").alias("low_parallax"))


@query
def x4_pair_poses(spark, sf_dir) -> DataFrame:
    """Relative pose of each adjacent pair from its matches."""
    got = geometry.pair_poses(matched(features(spark)), *SIZE)
    return got.select("frame_a", "frame_b", "matches", "inliers", *[F.round(F.col("direction")[k], 4).alias(f"d{k}") for k in range(3)])


def observations(spark) -> DataFrame:
    found = materialise(features(spark), "features")
    m = matched(found)
    t = graph.tracks(m.select("frame_a", "a", "frame_b", "b"))
    named = t.select("frame", "id", F.concat_ws("-", "root_frame", "root").alias("track"))
    long = named.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("track"))).where("n >= 3")
    at = long.join(found.select("clip_id", "frame_index", "feature_index", "x", "y"), F.expr("frame = frame_index and id = feature_index"))
    cams = fixtures.cameras(spark).select(F.col("frame_index").alias("c"), "rotation", "translation")
    return at.join(F.broadcast(cams), F.expr("frame_index = c")).select("clip_id", "track", "frame_index", "x", "y", "rotation", "translation")  # one row a frame


@query
def f9_landmarks(spark, sf_dir) -> DataFrame:
    """Landmarks of the tracks seen from the true cameras."""
    got = geometry.landmarks(observations(spark), *SIZE)
    return got.select("track", "views", *[F.round(c, 4).alias(c) for c in ("x", "y", "z", "error", "angle")])


@query
def p5_projections(spark, sf_dir) -> DataFrame:
    """Where each scene point falls in each frame, and back: null behind the camera."""
    met = fixtures.points(spark).crossJoin(F.broadcast(fixtures.cameras(spark)))  # points x 8 cameras
    cam = geometry.camera_point(F.col("rotation"), F.col("translation"), F.col("x"), F.col("y"), F.col("z"))
    at = met.withColumn("p", geometry.project(*cam, *SIZE)).withColumn("depth", cam[2])
    back = geometry.unproject(F.col("p.u"), F.col("p.v"), F.col("depth"), *SIZE)
    return at.select("point_index", "frame_index", F.round("p.u", 4).alias("u"), F.round("p.v", 4).alias("v"), F.round(F.abs(back["x"] - cam[0]), 9).alias("round_trip"))


@query
def g2_registered_cameras(spark, sf_dir) -> DataFrame:
    """Cameras of the clip from its tracks alone, up to a similarity."""
    got = cameras.solve_clips(observations(spark).select("clip_id", "track", "frame_index", "x", "y"), *SIZE)
    return got.select("frame_index", "landmarks", "adjusted", *[F.round(F.col("center")[k], 3).alias(f"c{k}") for k in range(3)])
