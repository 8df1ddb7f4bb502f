"""Pairs that blocks keep against all pairs: the same matches, whatever the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import matching
from tesserae.plans import bindings


def rows_of(df):
    return sorted(map(tuple, df.select("frame_a", "frame_b", "a", "b", "distance").collect()))


@pytest.fixture(scope="module")
def features(spark):
    r = np.random.default_rng(5)
    d = r.normal(size=(150, 6)).astype(np.float32).round(1)  # many equal distances
    d[40:60] = d[7]  # copies
    rows = [(int(f), 1000 - k, float(x), float(y), [float(v) for v in v_]) for k, (f, x, y, v_) in enumerate(zip(r.integers(0, 4, 150), r.uniform(-50, 50, 150), r.uniform(-50, 50, 150), d))]
    return spark.createDataFrame(rows, "frame int, id long, x double, y double, d array<float>")


@pytest.mark.parametrize("reach", [{}, {"radius": 30.0, "dx": 3.0, "dy": -2.0}, {"step": 2}])
def test_blocks_give_the_matches_of_all_pairs(spark, features, reach):
    every = matching.candidate_pairs(features, **reach).select("frame_a", "frame_b", "a", "b", matching.l1(F.col("da"), F.col("db")).alias("distance"))
    near = matching.nearest_pairs(features, block=16, **reach)
    assert set(rows_of(near)) <= set(rows_of(every))
    for rule in (lambda p: matching.ratio_matches(p, 0.98), matching.mutual_best, lambda p: matching.reverse_checked(matching.ratio_matches(p, 0.98), p), lambda p: matching.both_ways(p, 0.98)):
        assert rows_of(rule(near)) == rows_of(rule(every)) != []


def test_bits_in_blocks(spark, features):
    f = features.select("frame", "id", "x", "y", (F.xxhash64("d") % 4096).alias("d"))
    every = matching.candidate_pairs(f).select("frame_a", "frame_b", "a", "b", matching.hamming(F.col("da"), F.col("db")).alias("distance"))
    assert rows_of(matching.mutual_best(matching.nearest_pairs(f, bits=True, block=16))) == rows_of(matching.mutual_best(every)) != []


def test_copies_and_places_without_number_keep_few_pairs(spark):
    rows = [(k % 2, k, 0.0, float("nan") if k < 2 else 0.0, [0.5, float("nan") if k > 60 else 1.0]) for k in range(64)]
    f = spark.createDataFrame(rows, "frame int, id long, x double, y double, d array<double>")
    assert matching.nearest_pairs(f).count() <= 4 * 32
    near = matching.nearest_pairs(f, radius=1.0)
    assert near.where("a < 2 or b < 2").count() == 0 and {(r.a, r.b) for r in matching.mutual_best(near).collect()} == {(2, 3)}


def test_rounding_is_spark_s(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(0, 10**9, 300) / 1e9 + 0.5e-9, r.uniform(0, 3, 300), [0.0, 2.5e-9, 123456.7890123455, 1e20]])
    got = [v[0] for v in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 9)).collect()]
    assert (matching.rounded(x)[:-1] / 1e9).tolist() == got[:-1]


def test_queries_shuffle_no_pairs(spark):
    """Before, every pair of a frame pair was joined and sorted: its vectors on both sides of a join by frame."""
    plan = bindings.QUERIES["j1_ratio_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "aggregate(zip_with" not in plan
