"""Queries that bind the operators to tables, each with the SQL that defines its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import stats
from tesserae.functions.lineage import materialise
from tesserae.operators import gates, graph, matching, spatial, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- matching on embeddings: a label is a frame, a vector is a descriptor ---

FEATURES = """f AS (SELECT vec_id AS id, label AS frame, [x::DOUBLE for x in embedding] AS d FROM embeddings),
pairs AS (
  SELECT a.frame AS frame_a, b.frame AS frame_b, a.id AS a, b.id AS b,
         round(list_sum([abs(a.d[i] - b.d[i]) for i in range(1, len(a.d) + 1)]) / len(a.d), 9) AS distance
  FROM f a JOIN f b ON b.frame = a.frame + 1 {where})"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    axis = lambda k: F.col("embedding")[k].cast("double") * 1000
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("frame"), F.col("embedding").alias("d"), axis(0).alias("x"), axis(1).alias("y"))


RATIO_SQL = """
WITH {features},
ranked AS (
  SELECT *, row_number() OVER w AS k, lead(distance) OVER w AS nxt FROM pairs
  WINDOW w AS (PARTITION BY frame_a, frame_b, a ORDER BY distance, b)),
good AS (SELECT * FROM ranked WHERE k = 1 AND (nxt IS NULL OR distance < {ratio} * nxt)),
greedy AS (SELECT *, row_number() OVER (PARTITION BY frame_a, frame_b, b ORDER BY distance, a) AS g FROM good)
SELECT frame_a, frame_b, a, b, distance FROM greedy WHERE g = 1
"""


@query("j1_ratio_match", RATIO_SQL.format(features=FEATURES.format(where=""), ratio="0.95"))
def j1_ratio_match(spark, sf_dir):
    return matching.one_to_one(matching.ratio_matches(matching.nearest_pairs(features(spark, sf_dir)), 0.95))


NEAR = "WHERE (1000 * (b.d[1] - a.d[1])) ** 2 + (1000 * (b.d[2] - a.d[2])) ** 2 <= 10000"


@query("j1_radius_match", RATIO_SQL.format(features=FEATURES.format(where=NEAR), ratio="0.98"))
def j1_radius_match(spark, sf_dir):
    return matching.one_to_one(matching.ratio_matches(matching.nearest_pairs(features(spark, sf_dir), radius=100.0), 0.98))


SHIFTED = "WHERE (1000 * (b.d[1] - a.d[1]) - 20) ** 2 + (1000 * (b.d[2] - a.d[2]) + 10) ** 2 <= 10000"


@query("j4_shifted_match", RATIO_SQL.format(features=FEATURES.format(where=SHIFTED), ratio="0.98"))
def j4_shifted_match(spark, sf_dir):
    return matching.one_to_one(matching.ratio_matches(matching.nearest_pairs(features(spark, sf_dir), radius=100.0, dx=20.0, dy=-10.0), 0.98))


@query(
    "j3_global_match",
    f"""
WITH {FEATURES.format(where="")},
ranked AS (
  SELECT *, row_number() OVER w AS k, lead(distance) OVER w AS nxt FROM pairs
  WINDOW w AS (PARTITION BY frame_a, frame_b, a ORDER BY distance, b)),
good AS (SELECT * FROM ranked WHERE k = 1 AND (nxt IS NULL OR distance < 0.98 * nxt) AND distance <= 0.12),
greedy AS (SELECT *, row_number() OVER (PARTITION BY frame_a, frame_b, b ORDER BY distance, a) AS g FROM good),
back AS (SELECT frame_a, frame_b, b, a, row_number() OVER (PARTITION BY frame_a, frame_b, b ORDER BY distance, a) AS k FROM pairs)
SELECT g.frame_a, g.frame_b, g.a, g.b, g.distance
FROM greedy g JOIN back r ON r.k = 1 AND r.frame_a = g.frame_a AND r.frame_b = g.frame_b AND r.b = g.b AND r.a = g.a
WHERE g.g = 1
""",
)
def j3_global_match(spark, sf_dir):
    pairs = materialise(matching.nearest_pairs(features(spark, sf_dir)), "pairs")
    return matching.reverse_checked(matching.ratio_matches(pairs, 0.98, limit=0.12), pairs).select("frame_a", "frame_b", "a", "b", "distance")


MUTUAL = """mutual AS (
  SELECT frame_a, frame_b, a, b, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY frame_a, frame_b, a ORDER BY distance, b) AS k,
           row_number() OVER (PARTITION BY frame_a, frame_b, b ORDER BY distance, a) AS r FROM pairs)
  WHERE k = 1 AND r = 1)"""


def mutual(spark, sf_dir) -> DataFrame:
    return materialise(matching.mutual_best(matching.nearest_pairs(features(spark, sf_dir))), "mutual")


#: Features of a frame that revisits are looked for among, and the share of the runner-up's distance that a nearest one may have.
REVISIT, REVISIT_RATIO = 192, 0.95


@query(
    "j5_mutual_match",
    f"""
WITH f AS (SELECT * FROM (SELECT vec_id AS id, label AS frame, [x::DOUBLE for x in embedding] AS d, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth FROM embeddings) WHERE nth <= {REVISIT}),
pairs AS (
  SELECT a.frame AS frame_a, b.frame AS frame_b, a.id AS a, b.id AS b, round(list_sum([abs(a.d[i] - b.d[i]) for i in range(1, len(a.d) + 1)]) / len(a.d), 9) AS distance
  FROM f a JOIN f b ON b.frame = a.frame + 2),
forth AS (
  SELECT *, row_number() OVER (PARTITION BY frame_a, b ORDER BY distance, a) AS g
  FROM (SELECT *, row_number() OVER w AS k, lead(distance) OVER w AS nxt FROM pairs WINDOW w AS (PARTITION BY frame_a, a ORDER BY distance, b)) WHERE k = 1 AND (nxt IS NULL OR distance < {REVISIT_RATIO} * nxt)),
back AS (
  SELECT *, row_number() OVER (PARTITION BY frame_a, a ORDER BY distance, b) AS g
  FROM (SELECT *, row_number() OVER w AS k, lead(distance) OVER w AS nxt FROM pairs WINDOW w AS (PARTITION BY frame_a, b ORDER BY distance, a)) WHERE k = 1 AND (nxt IS NULL OR distance < {REVISIT_RATIO} * nxt))
SELECT forth.frame_a, forth.frame_b, forth.a, forth.b, forth.distance FROM forth JOIN back USING (frame_a, a, b) WHERE forth.g = 1 AND back.g = 1
""",
)
def j5_mutual_match(spark, sf_dir):
    """Revisits two frames apart: ratio-tested greedy matches of the first features of each, those that are found both ways."""
    first = features(spark, sf_dir).withColumn("order", -F.col("id"))
    pairs = materialise(matching.nearest_pairs(matching.strongest(first, "frame", "order", REVISIT), step=2), "pairs")
    return matching.both_ways(pairs, REVISIT_RATIO)


@query(
    "j6_hamming_match",
    """
WITH f AS (
  SELECT vec_id AS id, label AS frame, list_sum([CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END for i in range(0, 60)])::BIGINT AS code
  FROM embeddings),
pairs AS (
  SELECT a.frame AS frame_a, b.frame AS frame_b, a.id AS a, b.id AS b, bit_count(xor(a.code, b.code))::INT AS distance
  FROM f a JOIN f b ON b.frame = a.frame + 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY frame_a, frame_b, a ORDER BY distance, b) AS k,
         row_number() OVER (PARTITION BY frame_a, frame_b, b ORDER BY distance, a) AS r FROM pairs)
SELECT frame_a, frame_b, a, b, distance FROM ranked WHERE k = 1 AND r = 1
""",
)
def j6_hamming_match(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    code = F.aggregate(F.transform(F.slice(F.coalesce("embedding", F.array().cast("array<float>")), 1, 60), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    f = e.select(F.col("vec_id").alias("id"), F.col("label").alias("frame"), code.alias("d"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return matching.mutual_best(matching.nearest_pairs(f, bits=True))


@query(
    "j7_compose",
    f"""
WITH {FEATURES.format(where="")}, {MUTUAL}
SELECT m.frame_a, m.a, o.frame_b, o.b, greatest(m.distance, n.distance, o.distance) AS distance
FROM mutual m JOIN mutual n ON m.frame_b = n.frame_a AND m.b = n.a JOIN mutual o ON n.frame_b = o.frame_a AND n.b = o.a
""",
)
def j7_compose(spark, sf_dir):
    return matching.compose(mutual(spark, sf_dir), 3)


@query(
    "g1_track_paths",
    f"""
WITH RECURSIVE {FEATURES.format(where="")}, {MUTUAL},
nodes AS (SELECT frame_a AS frame, a AS id FROM mutual UNION SELECT frame_b, b FROM mutual),
path AS (
  SELECT frame, id, frame AS root_frame, id AS root FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM mutual m WHERE m.frame_b = n.frame AND m.b = n.id)
  UNION ALL
  SELECT m.frame_b, m.b, p.root_frame, p.root FROM path p JOIN mutual m ON m.frame_a = p.frame AND m.a = p.id)
SELECT frame, id, root_frame, root FROM path
""",
)
def g1_track_paths(spark, sf_dir):
    return graph.tracks(mutual(spark, sf_dir))


@query(
    "a3_track_stats",
    f"""
WITH RECURSIVE {FEATURES.format(where="")}, {MUTUAL},
nodes AS (SELECT frame_a AS frame, a AS id FROM mutual UNION SELECT frame_b, b FROM mutual),
path AS (
  SELECT frame, id, frame AS root_frame, id AS root FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM mutual m WHERE m.frame_b = n.frame AND m.b = n.id)
  UNION ALL
  SELECT m.frame_b, m.b, p.root_frame, p.root FROM path p JOIN mutual m ON m.frame_a = p.frame AND m.a = p.id),
t AS (SELECT root_frame, root, count(*) AS length FROM path GROUP BY ALL)
SELECT count(*) AS tracks, count(*) FILTER (WHERE length >= 3) AS long_tracks, max(length) AS longest, sum(length)::BIGINT AS observations FROM t
""",
)
def a3_track_stats(spark, sf_dir):
    t = graph.track_stats(g1_track_paths(spark, sf_dir))
    return t.agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("length") >= 3).alias("long_tracks"), F.max("length").alias("longest"), F.sum("length").alias("observations"))


# --- aggregates ---


@query(
    "a1_pair_stats",
    """
WITH g AS (SELECT l_returnflag, l_linestatus, l_quantity::DOUBLE AS q FROM lineitem),
v AS (SELECT l_returnflag, l_linestatus, list_sort(list(q)) AS s, count(*) AS n FROM g GROUP BY ALL)
SELECT l_returnflag, l_linestatus, n, list_aggregate(s, 'median')::DOUBLE AS mid, s[n // 2 + 1] AS upper, s[(n - 1) // 2 + 1] AS lower,
       s[floor((n - 1) * 0.9 + 0.5)::BIGINT + 1] AS p90, s[3 * n // 4 + 1] AS p75
FROM v
""",
)
def a1_pair_stats(spark, sf_dir):
    """The median variants by group, from counts by value, so that a large group is never held as a list."""
    g = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("double").alias("q"))
    counts = g.groupBy("l_returnflag", "l_linestatus", "q").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("l_returnflag", "l_linestatus")
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy("q"))).withColumn("n", F.sum("c").over(w))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("q")))  # noqa: E731  the k-th value, from 0
    n = F.col("n")
    lower, upper = at(F.floor((n - 1) / 2)), at(F.floor(n / 2))
    out = run.groupBy("l_returnflag", "l_linestatus", "n").agg(upper.alias("upper"), lower.alias("lower"), at(F.floor((n - 1) * 0.9 + 0.5)).alias("p90"), at(F.floor(3 * n / 4)).alias("p75"))
    return out.withColumn("mid", (F.col("upper") + F.col("lower")) / 2)


@query(
    "a1_user_medians",
    """
WITH v AS (SELECT user_id, list_sort(list(value) FILTER (WHERE value IS NOT NULL)) AS s FROM events GROUP BY user_id)
SELECT user_id, round(coalesce(list_aggregate(s, 'median'), 0), 6) AS mid, round(s[len(s) // 2 + 1], 6) AS upper,
       round(s[(len(s) - 1) // 2 + 1], 6) AS lower, round(s[3 * len(s) // 4 + 1], 6) AS p75 FROM v
""",
)
def a1_user_medians(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = lambda c: F.round(c, 6)
    return e.groupBy("user_id").agg(r(stats.median_or(F.col("value"), 0)).alias("mid"), r(stats.upper_median(F.col("value"))).alias("upper"), r(stats.lower_median(F.col("value"))).alias("lower"), r(stats.upper_quantile(F.col("value"), 3, 4)).alias("p75"))


@query(
    "a2_motion_residual",
    """
WITH p AS (SELECT event_id, user_id, hour(ts)::DOUBLE AS x, value AS y, value * 0.9 + hour(ts) * 0.1 AS x2, value + hour(ts) AS y2 FROM events),
s AS (SELECT *, x2 - x AS dx, y2 - y AS dy FROM p),
t AS (SELECT user_id, median(dx) AS tx, median(dy) AS ty FROM s GROUP BY user_id),
r AS (SELECT s.*, tx, ty, dx - tx AS ex, dy - ty AS ey FROM s JOIN t USING (user_id)),
w AS (SELECT user_id, greatest(-0.35, least(0.35, coalesce(sum(x * ey - y * ex) / nullif(sum(x * x + y * y), 0), 0))) AS rot FROM r GROUP BY user_id)
SELECT user_id, count(*) AS n, round(any_value(rot), 6) AS rotation, round(avg(sqrt((ex + y * rot) ** 2 + (ey - x * rot) ** 2)), 6) AS residual
FROM r JOIN w USING (user_id) GROUP BY user_id
""",
)
def a2_motion_residual(spark, sf_dir):
    """Global motion by user: median shift, then the small rotation that explains most of the rest, then what is left."""
    x, y = F.hour("ts").cast("double"), F.col("value")
    s = table(spark, sf_dir, "events").select("user_id", x.alias("x"), y.alias("y"), (y * 0.9 + x * 0.1 - x).alias("dx"), (y + x - y).alias("dy"))
    w = Window.partitionBy("user_id")
    r = s.withColumn("ex", F.col("dx") - F.median("dx").over(w)).withColumn("ey", F.col("dy") - F.median("dy").over(w))
    rot = F.coalesce(F.sum(F.expr("x * ey - y * ex")).over(w) / F.nullif(F.sum(F.expr("x * x + y * y")).over(w), F.lit(0.0)), F.lit(0.0))
    r = r.withColumn("rot", F.greatest(F.lit(-0.35), F.least(F.lit(0.35), rot)))
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("rot"), 6).alias("rotation"), F.round(F.avg(F.expr("sqrt(pow(ex + y * rot, 2) + pow(ey - x * rot, 2))")), 6).alias("residual"))


@query(
    "a4_tolerance_mode",
    """
WITH v AS (SELECT user_id, event_id AS id, round(value, 4) AS value FROM events WHERE value IS NOT NULL),
m AS (
  SELECT a.user_id, a.id, count(*) AS n, round(sum(abs(b.value - a.value)), 6) AS spread, median(b.value) AS mode
  FROM v a JOIN v b ON a.user_id = b.user_id AND abs(b.value - a.value) <= 5.0 GROUP BY a.user_id, a.id),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, spread, id) AS k FROM m),
t AS (SELECT user_id, count(*) AS total FROM v GROUP BY user_id)
SELECT user_id, n AS votes, round(mode, 6) AS mode FROM r JOIN t USING (user_id) WHERE k = 1 AND n >= 2 AND n >= 0.25 * total
""",
)
def a4_tolerance_mode(spark, sf_dir):
    v = table(spark, sf_dir, "events").where("value is not null").select("user_id", F.col("event_id").alias("id"), F.round("value", 4).alias("value"))
    return matching.dominant(v, "user_id", "value", 5.0, 2, 0.25).withColumn("mode", F.round("mode", 6))


@query(
    "a9_confidence",
    """
WITH f AS (SELECT s_nationkey, greatest(0, least(1, round(s_acctbal / 10000, 4))) AS c FROM supplier),
g AS (SELECT s_nationkey, CASE WHEN min(c) <= 0 THEN 0 ELSE exp(avg(ln(CASE WHEN c > 0 THEN c END))) END AS confidence FROM f GROUP BY s_nationkey)
SELECT n_name, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.35 THEN 'medium' ELSE 'low' END AS band
FROM g JOIN nation ON s_nationkey = n_nationkey
""",
)
def a9_confidence(spark, sf_dir):
    f = table(spark, sf_dir, "supplier").select("s_nationkey", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.col("s_acctbal") / 10000, 4))).alias("c"))
    g = f.groupBy("s_nationkey").agg(stats.geometric_mean(F.col("c")).alias("c"))
    band = F.when(F.col("c") >= 0.6, "high").when(F.col("c") >= 0.35, "medium").otherwise("low")
    return g.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", F.round("c", 6).alias("confidence"), band.alias("band"))


@query(
    "a10_band_histogram",
    """
WITH b AS (SELECT CASE WHEN p_retailprice >= 980 THEN 'high' WHEN p_retailprice >= 940 THEN 'medium' ELSE 'low' END AS band, p_retailprice AS v FROM part)
SELECT band, count(*) AS n, round(min(v), 4) AS least, round(max(v), 4) AS most FROM b GROUP BY band
""",
)
def a10_band_histogram(spark, sf_dir):
    v = F.col("p_retailprice")
    band = F.when(v >= 980, "high").when(v >= 940, "medium").otherwise("low")
    return table(spark, sf_dir, "part").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min(v), 4).alias("least"), F.round(F.max(v), 4).alias("most"))


@query(
    "a7_weighted_fuse",
    """
SELECT l_partkey, round(sum(greatest(l_discount, 0.05) * l_extendedprice) / sum(greatest(l_discount, 0.05)), 4) AS fused FROM lineitem GROUP BY l_partkey
""",
)
def a7_weighted_fuse(spark, sf_dir):
    w = F.greatest("l_discount", F.lit(0.05))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum(w * F.col("l_extendedprice")) / F.sum(w), 4).alias("fused"))


@query(
    "a12_front_band",
    """
WITH d AS (SELECT l_suppkey, l_extendedprice AS depth, min(l_extendedprice) OVER (PARTITION BY l_suppkey) AS front FROM lineitem)
SELECT l_suppkey, count(*) AS n, round(avg(depth), 4) AS location FROM d WHERE depth <= 1.1 * front GROUP BY l_suppkey HAVING count(*) >= 3
""",
)
def a12_front_band(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("depth"))
    front = l.groupBy("l_suppkey").agg(F.min("depth").alias("front"))
    return l.join(front, "l_suppkey").where("depth <= 1.1 * front").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("depth"), 4).alias("location")).where("n >= 3")


@query(
    "a17_trimmed_fit",
    """
WITH d AS (SELECT l_partkey AS g, l_orderkey, l_linenumber, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem),
f AS (SELECT g, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM d GROUP BY g HAVING var_pop(x) > 0),
r AS (SELECT d.*, n, row_number() OVER (PARTITION BY g ORDER BY round(abs(y - a - b * x), 6), l_orderkey, l_linenumber) AS k FROM d JOIN f USING (g))
SELECT g AS l_partkey, count(*) AS used, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 3) AS intercept
FROM r WHERE k <= ceil(0.8 * n) GROUP BY g HAVING var_pop(x) > 0
""",
)
def a17_trimmed_fit(spark, sf_dir):
    """Least squares by group, then again on the 80 % of rows that fit best."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("g"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    f = d.groupBy("g").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("v")).where("v > 0")
    w = Window.partitionBy("g").orderBy(F.round(F.abs(F.expr("y - a - b * x")), 6), "l_orderkey", "l_linenumber")
    kept = d.join(f, "g").withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.ceil(0.8 * F.col("n")))
    out = kept.groupBy(F.col("g").alias("l_partkey")).agg(F.count(F.lit(1)).alias("used"), F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_intercept("y", "x"), 3).alias("intercept"), F.var_pop("x").alias("v"))
    return out.where("v > 0").drop("v")


@query(
    "a19_fscore",
    """
WITH c AS (SELECT sum((quality = 0 AND toxic = 1)::INT) AS tp, sum((quality = 0)::INT) AS pp, sum((toxic = 1)::INT) AS ap FROM labels)
SELECT round(tp / nullif(pp, 0), 6) AS precision, round(tp / nullif(ap, 0), 6) AS recall, round(2.0 * tp / nullif(pp + ap, 0), 6) AS f FROM c
""",
)
def a19_fscore(spark, sf_dir):
    n = lambda c: F.sum(F.expr(c).cast("int"))
    c = table(spark, sf_dir, "labels").agg(n("quality = 0 and toxic = 1").alias("tp"), n("quality = 0").alias("pp"), n("toxic = 1").alias("ap"))
    return c.selectExpr("round(tp / nullif(pp, 0), 6) as precision", "round(tp / nullif(ap, 0), 6) as recall", "round(2.0D * tp / nullif(pp + ap, 0), 6) as f")


@query(
    "a20_scale_hint",
    """
WITH v AS (SELECT p_brand, list_sort(list(p_retailprice / p_size)) AS s, count(DISTINCT p_type) AS labels FROM part WHERE p_size > 0 GROUP BY p_brand)
SELECT p_brand, round(s[len(s) // 2 + 1], 6) AS hint, labels FROM v
""",
)
def a20_scale_hint(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size > 0")
    return p.groupBy("p_brand").agg(F.round(stats.upper_median(F.col("p_retailprice") / F.col("p_size")), 6).alias("hint"), F.count_distinct("p_type").alias("labels"))


@query(
    "a22_huber",
    """
WITH e AS (SELECT user_id, abs(value - avg(value) OVER (PARTITION BY user_id)) / 10 AS e FROM events)
SELECT user_id, round(sum(CASE WHEN e <= 2 THEN e * e ELSE 4 * e - 4 END), 4) AS cost, round(sqrt(avg(e * e)), 6) AS rmse FROM e GROUP BY user_id
""",
)
def a22_huber(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.abs(F.col("value") - F.avg("value").over(Window.partitionBy("user_id"))) / 10).alias("e"))
    return e.groupBy("user_id").agg(F.round(F.sum(F.expr("case when e <= 2 then e * e else 4 * e - 4 end")), 4).alias("cost"), F.round(F.sqrt(F.avg(F.expr("e * e"))), 6).alias("rmse"))


# --- windows ---

DAILY = "d AS (SELECT event_type, date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS day, round(avg(value), 6) AS v FROM events GROUP BY ALL)"


def daily(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.unix_date(F.to_date("ts")).alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))


@query(
    "w1_quality",
    f"""
WITH {DAILY},
w AS (
  SELECT *, lag(v) OVER o AS p, lead(v) OVER o AS n, list_sort(list(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS s
  FROM d WINDOW o AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, v, coalesce(abs(v - p) > 5 AND abs(v - n) > 5 AND abs(p - n) <= 20, false) AS outlier, s[len(s) // 2 + 1] AS local FROM w
""",
)
def w1_quality(spark, sf_dir):
    return windows.outlier_against_neighbours(daily(spark, sf_dir), ["event_type"], ["day"], "v", 5.0, 20.0)


@query(
    "w2_segments",
    """
WITH l AS (SELECT user_id, event_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT user_id, event_id, sum(CASE WHEN gap > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM l
""",
)
def w2_segments(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(w) > 86_400_000_000, F.lit(False))
    return windows.segments(e.withColumn("brk", gap), ["user_id"], ["ts", "event_id"], F.col("brk")).select("user_id", "event_id", "segment")


@query(
    "w3_keyframes",
    """
WITH RECURSIVE e AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, round(abs(value) / 50, 4) AS s, event_type = 'error' AS weak FROM events WHERE value IS NOT NULL),
f AS (
  SELECT user_id, 0::BIGINT AS k, 0.0::DOUBLE AS t, 0 AS full_ FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.k, CASE WHEN u >= 1.25 THEN 0 ELSE u END, (u >= 1.25)::INT
  FROM (SELECT e.user_id, e.k, CASE WHEN e.weak THEN 0.0 ELSE f.t + e.s END AS u FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1) e)
SELECT user_id, sum(full_)::BIGINT AS marks FROM f GROUP BY user_id
""",
)
def w3_keyframes(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", F.row_number().over(w).alias("k"), F.round(F.abs("value") / 50, 4).alias("s"), (F.col("event_type") == "error").alias("weak"))
    return windows.budget_marks(e, ["user_id"], "k", "s", "weak", 1.25).select("user_id", "marks")


@query(
    "w4_runs",
    """
WITH d AS (SELECT DISTINCT o_orderpriority, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS v FROM orders),
r AS (SELECT *, v - row_number() OVER (PARTITION BY o_orderpriority ORDER BY v) AS run FROM d)
SELECT o_orderpriority, min(v) AS start, max(v) AS "end", count(*) AS length FROM r GROUP BY o_orderpriority, run
""",
)
def w4_runs(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderpriority", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("v")).distinct()
    return windows.runs(d, ["o_orderpriority"], F.col("v"))


@query(
    "w5_next_usable",
    """
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value FROM events),
u AS (SELECT user_id, k, lead(k) OVER (PARTITION BY user_id ORDER BY k) AS nxt FROM e WHERE value > 20)
SELECT user_id, k, nxt AS next, nxt - k - 1 AS rejected_between FROM u WHERE nxt IS NOT NULL
""",
)
def w5_next_usable(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).cast("long").alias("k"), "value")
    return windows.next_usable(e, ["user_id"], "k", F.col("value") > 20).where("next is not null").select("user_id", "k", "next", "rejected_between")


@query(
    "w6_intervals",
    """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events)
SELECT user_id, count(*) AS n, sum((d <= 0)::INT)::BIGINT AS stalled, min(d) AS least, max(d) AS most FROM e GROUP BY user_id
""",
)
def w6_intervals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return windows.intervals(e, ["user_id"], ["t", "event_id"], "t")


@query(
    "w9_even_sample",
    """
WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, ceil(count(*) OVER (PARTITION BY event_type) / 50.0)::BIGINT AS k FROM events)
SELECT event_type, event_id FROM e WHERE n % k = 0
""",
)
def w9_even_sample(spark, sf_dir):
    return windows.evenly(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 50)


# --- gates ---


@query(
    "f1_gates",
    """
SELECT doc_id, CASE WHEN n_chars < 200 THEN 'quality' WHEN lang NOT IN ('en', 'fr') THEN 'segment' WHEN n_chars > 20000 THEN 'baseline' END AS rejected_gate FROM documents
""",
)
def f1_gates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    order = [("quality", F.col("n_chars") < 200), ("segment", ~F.col("lang").isin("en", "fr")), ("baseline", F.col("n_chars") > 20000)]
    return d.select("doc_id", gates.first_gate(order).alias("rejected_gate"))


@query(
    "f6_readiness",
    """
WITH s AS (SELECT source, count(*) AS n, avg((n_chars < 500)::INT) AS short, avg((n_chars > 5000)::INT) AS long FROM documents GROUP BY source)
SELECT source, n, CASE WHEN short > 0.5 THEN 'blocking' WHEN short > 0 THEN 'warning' ELSE 'ok' END AS short_issue,
       CASE WHEN long > 0.5 THEN 'blocking' WHEN long > 0 THEN 'warning' ELSE 'ok' END AS long_issue,
       CASE WHEN short > 0.5 OR long > 0.5 THEN 'unsuitable' WHEN short > 0 OR long > 0 THEN 'marginal' ELSE 'ready' END AS verdict FROM s
""",
)
def f6_readiness(spark, sf_dir):
    share = lambda c: F.avg(F.expr(c).cast("int"))
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), share("n_chars < 500").alias("short"), share("n_chars > 5000").alias("long"))
    worst = F.greatest("short", "long")
    return s.select("source", "n", gates.severity(F.col("short")).alias("short_issue"), gates.severity(F.col("long")).alias("long_issue"), F.when(worst > 0.5, "unsuitable").when(worst > 0, "marginal").otherwise("ready").alias("verdict"))


@query(
    "f7_motion_class",
    """
WITH u AS (SELECT user_id, count(*) AS n, abs(avg(value)) / 20 AS motion, stddev_pop(value) / 30 AS residual FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN n < 6 THEN 'unknown' WHEN motion < 0.25 THEN 'duplicate' WHEN motion < 1.4 THEN 'static' WHEN residual < 0.55 THEN 'rotation' ELSE 'parallax' END AS kind FROM u
""",
)
def f7_motion_class(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("value")) / 20).alias("motion"), (F.stddev_pop("value") / 30).alias("residual"))
    return u.select("user_id", gates.motion_class(F.col("motion"), F.col("residual"), F.col("n")).alias("kind"))


@query(
    "f15_gate_counts",
    """
WITH g AS (
  SELECT source, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'quality' WHEN toxic = 1 THEN 'toxic' END AS gate
  FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT source, gate, count(*) AS n, CASE gate WHEN 'unlabelled' THEN 1 WHEN 'quality' THEN 2 ELSE 3 END AS r FROM g WHERE gate IS NOT NULL GROUP BY ALL)
SELECT source, arg_max(gate, r) AS decisive, sum(n)::BIGINT AS rejected FROM c GROUP BY source
""",
)
def f15_gate_counts(spark, sf_dir):
    l = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l")
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(l, F.col("doc_id") == F.col("l"), "left")
    gate = gates.first_gate([("unlabelled", F.col("l").isNull()), ("quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)])
    rank = F.when(F.col("gate") == "unlabelled", 1).when(F.col("gate") == "quality", 2).otherwise(3)
    return gates.decisive(d.withColumn("gate", gate), ["source"], "gate", rank)


# --- joins ---


@query("j8_observations", "SELECT o_orderkey, c_nationkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def j8_observations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "l_linenumber")


@query("j9_candidates", "SELECT c_custkey, count(o_orderkey) AS links FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def j9_candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("links"))


@query("j11_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j11_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j12_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j12_semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query(
    "j13_track_pairs",
    "SELECT a.l_orderkey, a.l_linenumber AS first, b.l_linenumber AS second FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE NOT (a.l_returnflag = 'R' AND b.l_returnflag = 'R')",
)
def j13_track_pairs(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    a, b = l.alias("a"), l.alias("b")
    met = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    return met.where("not (a.l_returnflag = 'R' and b.l_returnflag = 'R')").select("a.l_orderkey", F.col("a.l_linenumber").alias("first"), F.col("b.l_linenumber").alias("second"))


@query(
    "j14_pairs_topk",
    """
WITH p AS (SELECT a.n_regionkey, a.n_nationkey AS f, b.n_nationkey AS t FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey + 1)
SELECT n_regionkey, f AS "from", t AS "to" FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY t - f DESC, f, t) AS k FROM p) WHERE k <= 4
""",
)
def j14_pairs_topk(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("from")), n.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("to"))
    p = a.join(b, (F.col("n_regionkey") == F.col("r")) & (F.col("to") > F.col("from") + 1))
    w = Window.partitionBy("n_regionkey").orderBy(F.desc(F.col("to") - F.col("from")), "from", "to")
    return p.withColumn("k", F.row_number().over(w)).where("k <= 4").select("n_regionkey", "from", "to")


POINTS = """v AS (SELECT vec_id AS id, label AS grp, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
near AS (
  SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 9) AS distance
  FROM v a JOIN v b ON a.id < b.id AND a.grp <> b.grp
  WHERE round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 9) <= 0.05)"""


def placed_points(spark, sf_dir) -> DataFrame:
    at = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def near_points(spark, sf_dir) -> DataFrame:
    return spatial.neighbours(placed_points(spark, sf_dir), 0.05)


@query("j15_hash_neighbours", f"WITH {POINTS} SELECT * FROM near")
def j15_hash_neighbours(spark, sf_dir):
    return near_points(spark, sf_dir)


@query(
    "j16_mutual",
    f"""
WITH {POINTS}, both_ AS (SELECT a, b, distance FROM near UNION ALL SELECT b, a, distance FROM near),
best AS (SELECT a, b, distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS k FROM both_) WHERE k = 1)
SELECT x.a, x.b, x.distance FROM best x JOIN best y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b
""",
)
def j16_mutual(spark, sf_dir):
    return spatial.mutual(spatial.nearest(spatial.sites(placed_points(spark, sf_dir)), 0.05))


@query(
    "j17_mask_points",
    """
SELECT p_partkey, (p_partkey * 7) % 64 AS at, ((p_partkey * 7) % 64 >= p_size % 16 AND (p_partkey * 7) % 64 < p_size % 16 + 8)
       OR ((p_partkey * 7) % 64 >= p_size % 16 + 12 AND (p_partkey * 7) % 64 < p_size % 16 + 12 + p_size) AS inside, (8 + p_size)::BIGINT AS area
FROM part
""",
)
def j17_mask_points(spark, sf_dir):
    """Points against run-length masks: background, 8 on, 4 off, p_size on."""
    size = F.col("p_size").cast("long")
    counts = F.array(size % 16, F.lit(8).cast("long"), F.lit(4).cast("long"), size)
    p = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 7) % 64).alias("at"), counts.alias("m"))
    return p.select("p_partkey", "at", spatial.inside(F.col("at"), spatial.mask_runs(F.col("m"))).alias("inside"), spatial.mask_area(F.col("m")).alias("area"))


@query(
    "j18_occlusion",
    """
WITH k AS (SELECT l_orderkey, l_linenumber, floor(l_quantity / 3) AS cx, floor(l_discount * 100 / 3) AS cy, l_extendedprice AS d FROM lineitem),
f AS (SELECT cx, cy, min(d) AS front FROM k GROUP BY ALL)
SELECT cx::BIGINT AS cx, cy::BIGINT AS cy, count(*) AS n, count(*) FILTER (WHERE d <= front * 1.05) AS visible FROM k JOIN f USING (cx, cy) GROUP BY cx, cy
""",
)
def j18_occlusion(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 3).cast("long").alias("cx"), F.floor(F.col("l_discount") * 100 / 3).cast("long").alias("cy"), F.col("l_extendedprice").alias("d"))
    seen = spatial.visible(l, [F.col("cx"), F.col("cy")], "d", 0.05)
    return seen.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.count_if("visible").alias("visible"))


@query(
    "j19_ranges",
    """
WITH r AS (SELECT p_partkey AS region, p_partkey * 20 AS start, p_size AS count FROM part)
SELECT o_orderkey, region FROM orders JOIN r ON o_orderkey >= start AND o_orderkey < start + count
""",
)
def j19_ranges(spark, sf_dir):
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("region"), (F.col("p_partkey") * 20).alias("start"), F.col("p_size").cast("long").alias("count"))
    return spatial.locate(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", r, 64).select("o_orderkey", "region")


@query(
    "j24_nearest_frame",
    """
WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS t FROM orders),
p AS (SELECT c.c_custkey, o.o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(t - 820454400000000), o_orderkey) AS k FROM customer c JOIN o ON o.o_custkey = c.c_custkey)
SELECT c_custkey, o_orderkey FROM p WHERE k = 1
""",
)
def j24_nearest_frame(spark, sf_dir):
    """As-of nearest: of each customer's orders the one nearest in time, ties to the lower key."""
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(F.abs(t - 820454400000000), F.col("o_orderkey"))).alias("o_orderkey"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query(
    "j25_currency",
    """
WITH now_ AS (SELECT doc_id, sha256(text) AS h FROM documents), then_ AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents)
SELECT doc_id, n.h = t.h AS current FROM now_ n JOIN then_ t USING (doc_id)
""",
)
def j25_currency(spark, sf_dir):
    """Artifacts whose recorded identity is still that of their content; every seventh was recorded from other content."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    then = d.select(F.col("doc_id").alias("k"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("recorded"))
    return d.select("doc_id", F.sha2("text", 256).alias("h")).join(then, F.col("doc_id") == F.col("k")).select("doc_id", (F.col("h") == F.col("recorded")).alias("current"))


# --- top-k and sets ---


@query("k1_strongest", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 20")
def k1_strongest(spark, sf_dir):
    return matching.strongest(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_mktsegment", "c_acctbal", 20, "c_custkey").select("c_mktsegment", "c_custkey")


@query(
    "k2_margin",
    """
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS support, l_extendedprice AS err, row_number() OVER w AS k, lead(l_quantity) OVER w AS s2, lead(l_extendedprice) OVER w AS e2
           FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice, l_linenumber))
SELECT l_orderkey, l_linenumber, CASE WHEN s2 = support THEN round(e2 - err, 4) END AS margin FROM r WHERE k = 1
""",
)
def k2_margin(spark, sf_dir):
    """Best hypothesis of each group by support, then error; the runner-up counts only with equal support."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_extendedprice", "l_linenumber")
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.row_number().over(w).alias("k"), F.lead("l_quantity").over(w).alias("s2"), F.lead("l_extendedprice").over(w).alias("e2"))
    return r.where("k = 1").select("l_orderkey", "l_linenumber", F.expr("case when s2 = l_quantity then round(e2 - l_extendedprice, 4) end").alias("margin"))


@query("k13_argmax", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice, l_discount DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def k13_argmax(spark, sf_dir):
    best = F.min(F.struct(-F.col("l_quantity"), F.col("l_extendedprice"), -F.col("l_discount"), F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best.alias("m")).select("l_orderkey", F.col("m.l_linenumber").alias("l_linenumber"))


@query(
    "k4_reference_order",
    """
WITH f AS (SELECT n_regionkey AS clip, n_nationkey AS frame, length(n_name) AS visible FROM nation),
h AS (SELECT clip, frame AS first FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY visible DESC, frame) AS k FROM f) WHERE k = 1)
SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY frame <> first, abs(frame - first) DESC, visible DESC, frame) AS place FROM f JOIN h USING (clip)
""",
)
def k4_reference_order(spark, sf_dir):
    """First the frame that sees most, then by distance from it."""
    f = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("clip"), F.col("n_nationkey").alias("frame"), F.char_length("n_name").alias("visible"))
    first = F.first("frame").over(Window.partitionBy("clip").orderBy(F.desc("visible"), "frame"))
    g = f.withColumn("first", first)
    w = Window.partitionBy("clip").orderBy(F.col("frame") != F.col("first"), F.desc(F.abs(F.col("frame") - F.col("first"))), F.desc("visible"), "frame")
    return g.select("clip", "frame", F.row_number().over(w).cast("long").alias("place"))


@query(
    "u1_union_offsets",
    """
SELECT row_number() OVER (ORDER BY part_, k) - 1 AS point, part_ AS patch, k AS own FROM (
  SELECT 0 AS part_, s_suppkey AS k FROM supplier UNION ALL SELECT 1, c_custkey FROM customer)
""",
)
def u1_union_offsets(spark, sf_dir):
    """Patches one after another under one index: own index plus the sizes of the patches before, counted by blocks."""
    s = table(spark, sf_dir, "supplier").select(F.lit(0).alias("patch"), F.col("s_suppkey").alias("own"))
    u = s.unionByName(table(spark, sf_dir, "customer").select(F.lit(1).alias("patch"), F.col("c_custkey").alias("own"))).withColumn("blk", F.floor(F.col("own") / 4096).cast("long"))
    sizes = u.groupBy("patch", "blk").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(F.col("patch").alias("p"), F.col("blk").alias("b"), F.coalesce(F.sum("n").over(Window.orderBy("patch", "blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    w = Window.partitionBy("patch", "blk").orderBy("own")
    return u.withColumn("k", F.row_number().over(w) - 1).join(starts, (F.col("patch") == F.col("p")) & (F.col("blk") == F.col("b"))).select((F.col("start") + F.col("k")).cast("long").alias("point"), "patch", "own")


@query("u2_distinct_frames", "SELECT c_nationkey AS frame FROM customer UNION SELECT s_nationkey FROM supplier")
def u2_distinct_frames(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("frame")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("u3_intersect", "SELECT c_nationkey AS frame FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u3_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("frame")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("frame")))


@query("u4_first_seen", "SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_type")
def u4_first_seen(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("p_partkey"))


@query(
    "u5_triangle_keys",
    """
WITH t AS (SELECT list_sort([l_partkey % 97, l_suppkey % 89, l_orderkey % 83]) AS k FROM lineitem)
SELECT k[1] AS a, k[2] AS b, k[3] AS c, count(*) AS n FROM t WHERE k[1] <> k[2] AND k[2] <> k[3] GROUP BY ALL
""",
)
def u5_triangle_keys(spark, sf_dir):
    k = F.array_sort(F.array(F.col("l_partkey") % 97, F.col("l_suppkey") % 89, F.col("l_orderkey") % 83))
    t = table(spark, sf_dir, "lineitem").select(k.alias("k")).select(F.col("k")[0].alias("a"), F.col("k")[1].alias("b"), F.col("k")[2].alias("c"))
    return t.where("a <> b and b <> c").groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u6_cells",
    """
WITH p AS (SELECT DISTINCT (l_quantity)::BIGINT AS x, (l_discount * 100)::BIGINT AS y FROM lineitem),
o AS (SELECT DISTINCT x - dx AS x, y - dy AS y FROM p, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) s(dx, dy))
SELECT o.x, o.y, (SELECT count(*) FROM p WHERE p.x BETWEEN o.x AND o.x + 1 AND p.y BETWEEN o.y AND o.y + 1) AS corners FROM o
""",
)
def u6_cells(spark, sf_dir):
    """Each point opens the four cells of which it is a corner; a cell's corners are then a count."""
    l = table(spark, sf_dir, "lineitem")
    p = l.select(F.round("l_quantity").cast("long").alias("x"), F.round(F.col("l_discount") * 100).cast("long").alias("y")).distinct()
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (0, 1) for j in (0, 1)]))
    return p.withColumn("s", shifts).groupBy((F.col("x") - F.col("s.dx")).alias("x"), (F.col("y") - F.col("s.dy")).alias("y")).agg(F.count(F.lit(1)).alias("corners"))


@query("u7_disjoint", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE NOT list_has_any([a.n_nationkey % 7, a.n_nationkey % 11], [b.n_nationkey % 7, b.n_nationkey % 11])")
def u7_disjoint(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.array(F.col("n_nationkey") % 7, F.col("n_nationkey") % 11).alias("frames"))
    met = n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return met.where(~F.arrays_overlap("a.frames", "b.frames")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query(
    "a11_boxes",
    """
WITH c AS (SELECT DISTINCT l_linenumber AS g, (l_quantity)::BIGINT AS x, (l_discount * 100)::BIGINT AS y FROM lineitem),
r AS (SELECT g, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY g, y ORDER BY x) AS k FROM c) GROUP BY g, y, k)
SELECT g, x0, x1, min(y) AS y0, max(y) AS y1 FROM (SELECT *, y - row_number() OVER (PARTITION BY g, x0, x1 ORDER BY y) AS k FROM r) GROUP BY g, x0, x1, k
""",
)
def a11_boxes(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return spatial.boxes(l.select(F.col("l_linenumber").alias("g"), F.round("l_quantity").cast("long").alias("x"), F.round(F.col("l_discount") * 100).cast("long").alias("y")), ["g"])


@query(
    "g2_expansion",
    """
WITH RECURSIVE l AS (
  SELECT DISTINCT a, b FROM (SELECT l_suppkey AS a, 100000 + l_partkey AS b FROM lineitem UNION ALL SELECT 100000 + l_partkey, l_suppkey FROM lineitem) WHERE a <> b),
c(node, root) USING KEY (node) AS (
  SELECT a, min(least(a, b)) FROM l GROUP BY a
  UNION SELECT l.a, min(c.root) FROM c JOIN l ON l.b = c.node JOIN recurring.c AS k ON k.node = l.a WHERE c.root < k.root GROUP BY l.a),
r(node, round) USING KEY (node) AS (
  SELECT DISTINCT root, 0 FROM c
  UNION SELECT DISTINCT l.a, r.round + 1 FROM r JOIN l ON l.b = r.node ANTI JOIN recurring.r AS k ON k.node = l.a)
SELECT node, round FROM r
""",
)
def g2_expansion(spark, sf_dir):
    """Every component of the links is expanded from its least node until no node is added."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 100000).alias("b")).where("a <> b")
    return graph.expand(graph.clusters(l).select(F.col("root").alias("node")), l, 1)


@query(
    "s1_sampling_plan",
    """
WITH d AS (SELECT doc_id, n_chars / 100.0 AS dur FROM documents WHERE n_chars > 0),
n AS (SELECT *, greatest(4, least(floor(dur * 1.25)::BIGINT, least(120, greatest(18, ceil(dur)::BIGINT)))) AS n FROM d)
SELECT doc_id, n AS frames, round(dur * 0.05, 6) AS first, round(dur * 0.95, 6) AS last, round(dur * 0.9 / (n - 1), 6) AS step FROM n
""",
)
def s1_sampling_plan(spark, sf_dir):
    from tesserae.sources import sampling

    d = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", (F.col("n_chars") / 100.0).cast("double").alias("dur"))
    p = sampling.plan(d, "dur")
    return p.select("doc_id", F.col("frames"), *[F.round(c, 6).alias(c) for c in ("first", "last", "step")])


# --- surfaces: lineitem rows as grid points, a sheet for each supplier ---

GRID = """g AS (
  SELECT l_suppkey AS sheet, l_quantity::BIGINT AS gx, round(l_discount * 100)::BIGINT AS gy, l_orderkey * 10 + l_linenumber AS id, round(l_tax, 4) AS confidence
  FROM lineitem),
best AS (SELECT sheet, gx, gy, id FROM (SELECT *, row_number() OVER (PARTITION BY sheet, gx, gy ORDER BY confidence DESC, id) AS k FROM g) WHERE k = 1),
cells AS (
  SELECT sheet, gx - dx AS cx, gy - dy AS cy, max(CASE WHEN dx = 0 AND dy = 0 THEN id END) AS a, max(CASE WHEN dx = 1 AND dy = 0 THEN id END) AS b,
         max(CASE WHEN dx = 0 AND dy = 1 THEN id END) AS c, max(CASE WHEN dx = 1 AND dy = 1 THEN id END) AS d
  FROM best, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) s(dx, dy) GROUP BY 1, 2, 3),
tri AS (
  SELECT sheet, cx, cy, a, b, c FROM cells WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
  UNION ALL SELECT sheet, cx, cy, b, d, c FROM cells WHERE b IS NOT NULL AND d IS NOT NULL AND c IS NOT NULL
  UNION ALL SELECT sheet, cx, cy, a, b, d FROM cells WHERE a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL AND c IS NULL
  UNION ALL SELECT sheet, cx, cy, a, d, c FROM cells WHERE a IS NOT NULL AND d IS NOT NULL AND c IS NOT NULL AND b IS NULL)"""


def grid_points(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    at = F.round("l_quantity").cast("long").alias("gx"), F.round(F.col("l_discount") * 100).cast("long").alias("gy")
    return l.select(F.col("l_suppkey").alias("sheet"), *at, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round("l_tax", 4).alias("confidence"))


def grid_triangles(spark, sf_dir) -> DataFrame:
    from tesserae.operators import surface

    return surface.cell_triangles(surface.grid_cells(grid_points(spark, sf_dir), ("sheet",)), ("sheet",))


@query("r2_grid_mesh", f"WITH {GRID} SELECT * FROM tri")
def r2_grid_mesh(spark, sf_dir):
    return grid_triangles(spark, sf_dir)


@query(
    "g8_boundary_edges",
    f"""
WITH {GRID}, e AS (
  SELECT least(a, b) AS u, greatest(a, b) AS v FROM tri UNION ALL SELECT least(b, c), greatest(b, c) FROM tri UNION ALL SELECT least(c, a), greatest(c, a) FROM tri)
SELECT u, v FROM e GROUP BY u, v HAVING count(*) = 1
""",
)
def g8_boundary_edges(spark, sf_dir):
    from tesserae.operators import surface

    return surface.edges(grid_triangles(spark, sf_dir)).where("used = 1").select("u", "v")


@query(
    "a8_vertex_normals",
    f"""
WITH {GRID}, p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z FROM lineitem),
n AS (
  SELECT t.a, t.b, t.c, (pb.y - pa.y) * (pc.z - pa.z) - (pb.z - pa.z) * (pc.y - pa.y) AS nx, (pb.z - pa.z) * (pc.x - pa.x) - (pb.x - pa.x) * (pc.z - pa.z) AS ny,
         (pb.x - pa.x) * (pc.y - pa.y) - (pb.y - pa.y) * (pc.x - pa.x) AS nz
  FROM tri t JOIN p pa ON t.a = pa.id JOIN p pb ON t.b = pb.id JOIN p pc ON t.c = pc.id),
s AS (SELECT id, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT a AS id, nx, ny, nz FROM n UNION ALL SELECT b, nx, ny, nz FROM n UNION ALL SELECT c, nx, ny, nz FROM n) GROUP BY id)
SELECT id, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 5) AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 5) AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 5) AS nz FROM s
""",
)
def a8_vertex_normals(spark, sf_dir):
    from tesserae.operators import surface

    p = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"))
    n = surface.vertex_normals(grid_triangles(spark, sf_dir), p)
    return n.select("id", *[F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")])


@query(
    "j20_corner_regions",
    """
WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS triangle_index, l_partkey AS a, l_suppkey AS b, l_orderkey % 2000 AS c FROM lineitem),
e AS (SELECT triangle_index, unnest([a, b, c]) AS id FROM t),
r AS (SELECT p_partkey // 64 AS region, p_partkey // 64 * 64 AS start FROM part GROUP BY ALL),
o AS (SELECT triangle_index, region FROM e LEFT JOIN r ON id >= start AND id < start + 50)
SELECT triangle_index, count(DISTINCT region) AS regions, CASE WHEN count(DISTINCT region) = 1 AND count(*) = count(region) THEN min(region) ELSE -1 END AS region,
       count(DISTINCT region) > 1 OR count(*) > count(region) AS mixed FROM o GROUP BY triangle_index
""",
)
def j20_corner_regions(spark, sf_dir):
    from tesserae.operators import surface

    l = table(spark, sf_dir, "lineitem")
    t = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("triangle_index"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_orderkey") % 2000).alias("c"))
    regions = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 64).cast("long").alias("region")).distinct().select("region", (F.col("region") * 64).alias("start"), F.lit(50).cast("long").alias("count"))
    ids = t.select(F.explode(F.array("a", "b", "c")).alias("id")).distinct()
    owners = spatial.locate(ids, "id", regions, 64).select("id", "region")
    return surface.corner_owners(t, owners).withColumn("region", F.coalesce("region", F.lit(-1)))


@query(
    "f13_view_verdict",
    """
WITH v AS (SELECT l_suppkey, round(avg((l_quantity <= 30)::INT), 6) AS inside, round(avg(l_discount) * 10, 6) AS iou, round(avg((l_tax > 0.06)::INT), 6) AS violations FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, concat_ws(',', CASE WHEN inside < 0.6 THEN 'inside' END, CASE WHEN iou < 0.48 THEN 'iou' END, CASE WHEN violations > 0.2 THEN 'depth' END) AS reasons,
       inside >= 0.6 AND iou >= 0.48 AND violations <= 0.2 AS valid FROM v
""",
)
def f13_view_verdict(spark, sf_dir):
    share = lambda c: F.round(F.avg(F.expr(c).cast("int")), 6)
    v = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(share("l_quantity <= 30").alias("inside"), F.round(F.avg("l_discount") * 10, 6).alias("iou"), share("l_tax > 0.06").alias("violations"))
    reasons = F.concat_ws(",", F.when(F.col("inside") < 0.6, "inside"), F.when(F.col("iou") < 0.48, "iou"), F.when(F.col("violations") > 0.2, "depth"))
    return v.select("l_suppkey", reasons.alias("reasons"), (reasons == "").alias("valid"))


@query(
    "f14_invariants",
    """
SELECT 'orphan line' AS reason, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order without lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'repeated line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'bad discount', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1
""",
)
def f14_invariants(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    says = lambda df, reason: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(reason).alias("reason"), "n")
    on = F.col("l_orderkey") == F.col("o_orderkey")
    out = says(l.join(o, on, "left_anti"), "orphan line")
    out = out.unionByName(says(o.join(l, on, "left_anti"), "order without lines"))
    out = out.unionByName(says(l.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "repeated line"))
    return out.unionByName(says(l.where("l_discount < 0 or l_discount > 1"), "bad discount"))


@query(
    "f4_link_breaks",
    f"""
WITH {DAILY}, w AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY day) AS p FROM d)
SELECT event_type, day, CASE WHEN abs(v - p) > 20 THEN 'hard_cut' WHEN v < 40 THEN 'lost_overlap' WHEN abs(v - p) > 10 THEN 'motion_jump' END AS break FROM w
""",
)
def f4_link_breaks(spark, sf_dir):
    p = F.lag("v").over(Window.partitionBy("event_type").orderBy("day"))
    d = daily(spark, sf_dir).withColumn("p", p)
    change = F.abs(F.col("v") - F.col("p"))
    return d.select("event_type", "day", gates.first_gate([("hard_cut", change > 20), ("lost_overlap", F.col("v") < 40), ("motion_jump", change > 10)]).alias("break"))


@query(
    "a13_spread",
    """
WITH p AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey) AS k, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS depth FROM lineitem),
d AS (SELECT a.g, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS widest FROM p a JOIN p b ON a.g = b.g AND a.k < b.k GROUP BY a.g)
SELECT g AS l_orderkey, round(widest / mean, 5) AS spread FROM d JOIN (SELECT g, avg(depth) AS mean FROM p GROUP BY g) USING (g)
""",
)
def a13_spread(spark, sf_dir):
    """Largest distance between two places of a group by the mean depth; groups are an object's few observations, and one place has no spread."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey")).agg(F.collect_list(F.struct(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))).alias("p"), F.avg(F.col("l_extendedprice") / 1000).alias("mean"))
    far = lambda a: F.array_max(F.transform("p", lambda b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))))
    return p.where(F.size("p") > 1).select("l_orderkey", F.round(F.array_max(F.transform("p", far)) / F.col("mean"), 5).alias("spread"))


@query(
    "a14_mask_support",
    """
WITH p AS (SELECT p_brand, ((p_partkey * 7) % 64 >= p_size % 16 AND (p_partkey * 7) % 64 < p_size % 16 + 8) AS inside FROM part)
SELECT p_brand, count(*) AS visible, round(avg(inside::INT), 6) AS support FROM p GROUP BY p_brand HAVING count(*) >= 3
""",
)
def a14_mask_support(spark, sf_dir):
    size = F.col("p_size").cast("long")
    p = table(spark, sf_dir, "part").select("p_brand", spatial.inside((F.col("p_partkey") * 7) % 64, spatial.mask_runs(F.array(size % 16, F.lit(8).cast("long")))).alias("inside"))
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("visible"), F.round(F.avg(F.col("inside").cast("int")), 6).alias("support")).where("visible >= 3")


@query(
    "r5_appearance_diff",
    """
WITH b AS (SELECT doc_id AS ref, sha256(text) AS k FROM documents WHERE doc_id % 5 <> 0), a AS (SELECT doc_id AS ref, CASE WHEN doc_id % 3 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS k FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(a.ref, b.ref) AS ref, CASE WHEN b.ref IS NULL THEN 'added' WHEN a.ref IS NULL THEN 'removed' WHEN a.k <> b.k THEN 'changed' ELSE 'same' END AS state FROM b FULL JOIN a ON a.ref = b.ref
""",
)
def r5_appearance_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("b"), F.sha2("text", 256).alias("kb"))
    a = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("a"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("ka"))
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("ka") != F.col("kb"), "changed").otherwise("same")
    return b.join(a, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("ref"), state.alias("state"))


@query(
    "r12_reconcile",
    """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'stale' ELSE sha256(text) END AS recorded, doc_id % 13 <> 0 AS receipt FROM documents WHERE doc_id % 4 <> 0)
SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN NOT receipt THEN 'no_receipt' WHEN recorded <> sha256(d.text) THEN 'changed' ELSE 'reuse' END AS verdict FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
""",
)
def r12_reconcile(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    r = d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("r"), F.when(F.col("doc_id") % 11 == 0, "stale").otherwise(F.col("h")).alias("recorded"), (F.col("doc_id") % 13 != 0).alias("receipt"))
    verdict = F.when(F.col("r").isNull(), "missing").when(~F.col("receipt"), "no_receipt").when(F.col("recorded") != F.col("h"), "changed").otherwise("reuse")
    return d.join(r, F.col("doc_id") == F.col("r"), "left").select("doc_id", verdict.alias("verdict"))


@query(
    "r16_mask_iou",
    """
WITH p AS (SELECT p_partkey, p_size % 16 AS s1, p_size % 16 + 8 AS e1, p_size % 10 AS s2, p_size % 10 + 12 AS e2 FROM part)
SELECT p_partkey, round(greatest(0, least(e1, e2) - greatest(s1, s2)) / (e1 - s1 + e2 - s2 - greatest(0, least(e1, e2) - greatest(s1, s2))), 6) AS iou FROM p
""",
)
def r16_mask_iou(spark, sf_dir):
    """Overlap of two run-length masks of one run each."""
    size = F.col("p_size").cast("long")
    run = lambda off, on: spatial.mask_runs(F.array(off, F.lit(on).cast("long")))[0]
    p = table(spark, sf_dir, "part").select("p_partkey", run(size % 16, 8).alias("a"), run(size % 10, 12).alias("b"))
    both = F.greatest(F.lit(0).cast("long"), F.least("a.to", "b.to") - F.greatest("a.from", "b.from"))
    return p.select("p_partkey", F.round(both / (F.expr("a.to - a.from + b.to - b.from") - both), 6).alias("iou"))


@query(
    "k9_widest",
    "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1",
)
def k9_widest(spark, sf_dir):
    best = F.max_by(F.struct("l_orderkey", "l_linenumber"), F.struct(F.col("l_extendedprice"), -F.col("l_orderkey"), -F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(best.alias("m")).select("l_suppkey", "m.l_orderkey", "m.l_linenumber")


@query("k14_patch_order", "SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY p_brand")
def k14_patch_order(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))  # a row for each patch
    return n.select("p_brand", F.row_number().over(Window.orderBy(F.desc("n"), "p_brand")).cast("long").alias("rank"))


# --- more joins, choices and fix points ---


@query(
    "j21_overlaps",
    """
WITH r AS (SELECT o_orderkey AS id, o_custkey % 100 AS x0, o_custkey % 100 + o_totalprice / 200000 AS x1, (o_orderkey * 7) % 90 AS y0, (o_orderkey * 7) % 90 + 2 AS y1 FROM orders)
SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
""",
)
def j21_overlaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.selectExpr("o_orderkey as id", "o_custkey % 100 as x0", "o_custkey % 100 + o_totalprice / 200000 as x1", "(o_orderkey * 7) % 90 as y0", "(o_orderkey * 7) % 90 + 2 as y1")
    return spatial.overlapping(r, 4.0)


@query(
    "j23_fscore_within",
    f"""
WITH {POINTS}, hit AS (SELECT a AS id FROM near UNION SELECT b FROM near)
SELECT grp, count(*) AS points, round(avg((hit.id IS NOT NULL)::INT), 6) AS within FROM v LEFT JOIN hit ON v.id = hit.id GROUP BY grp
""",
)
def j23_fscore_within(spark, sf_dir):
    """Share of each group's points with a point of another group within the threshold: precision and recall of one against another."""
    v, own = placed_points(spark, sf_dir), ["grp", "x", "y", "z"]
    at = materialise(spatial.sites(v), "places")
    hit = at.join(spatial.nearest(at, 0.05).select(F.col("a").alias("h")), F.expr("id = h")).select(*own, "h")
    return v.join(hit, own, "left").groupBy("grp").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg(F.col("h").isNotNull().cast("int")), 6).alias("within"))


@query(
    "a5_best_line",
    """
WITH d AS (SELECT l_partkey AS g, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem),
h AS (SELECT a.g, a.k, (b.y - a.y) / (b.x - a.x) AS m, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS c FROM d a JOIN d b ON a.g = b.g AND b.k = a.k + 1 AND b.x <> a.x),
s AS (SELECT h.g, h.k, count(*) FILTER (WHERE abs(y - m * x - c) <= 2000) AS inliers FROM h JOIN d ON h.g = d.g GROUP BY h.g, h.k)
SELECT g AS l_partkey, k AS sample, inliers FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY inliers DESC, k) AS r FROM s) WHERE r = 1
""",
)
def a5_best_line(spark, sf_dir):
    """Argmax over samples: each neighbouring pair of a group proposes a line, the one with most rows near it wins, the first of equals."""
    w = Window.partitionBy("g").orderBy("l_orderkey", "l_linenumber")
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("g"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"), "l_orderkey", "l_linenumber")
    nxt = d.withColumn("k", F.row_number().over(w).cast("long")).withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 <> x")
    h = nxt.select(F.col("g").alias("hg"), "k", F.expr("(y2 - y) / (x2 - x)").alias("m"), F.expr("y - (y2 - y) / (x2 - x) * x").alias("c"))
    s = d.join(h, F.col("g") == F.col("hg")).groupBy("hg", "k").agg(F.count_if(F.expr("abs(y - m * x - c) <= 2000")).alias("inliers"))
    return s.groupBy(F.col("hg").alias("l_partkey")).agg(F.max(F.struct(F.col("inliers"), -F.col("k"))).alias("b")).select("l_partkey", (-F.col("b.col2")).alias("sample"), F.col("b.inliers").alias("inliers"))


@query("k3_least_error", "SELECT l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount, l_extendedprice, l_orderkey) AS k FROM lineitem) WHERE k = 1")
def k3_least_error(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct("l_discount", "l_extendedprice", "l_orderkey")).alias("l_orderkey"))


@query(
    "k7_nearest_sources",
    """
SELECT a.n_nationkey AS frame, b.n_nationkey AS source FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
QUALIFY row_number() OVER (PARTITION BY a.n_nationkey ORDER BY abs(a.n_nationkey - b.n_nationkey), b.n_nationkey) <= 3
""",
)
def k7_nearest_sources(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    met = n.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("frame")).join(n.select("n_regionkey", F.col("n_nationkey").alias("source")), F.expr("r = n_regionkey and frame <> source"))
    w = Window.partitionBy("frame").orderBy(F.abs(F.col("frame") - F.col("source")), "source")
    return met.withColumn("k", F.row_number().over(w)).where("k <= 3").select("frame", "source")


@query(
    "k11_ranked_attempts",
    """
WITH a AS (SELECT o_custkey, o_orderkey, (o_orderstatus = 'F')::INT AS done, o_orderpriority AS p, o_totalprice AS t FROM orders)
SELECT o_custkey, o_orderkey FROM a QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY done DESC, p DESC, t DESC, o_orderkey DESC) = 1
""",
)
def k11_ranked_attempts(spark, sf_dir):
    """The best attempt by a lexicographic score."""
    score = F.struct((F.col("o_orderstatus") == "F").cast("int"), F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", score).alias("o_orderkey"))


COMPLETE_PASS = """
n{k} AS (SELECT x + dx AS x, y + dy AS y, v FROM c{j}, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) s(dx, dy)),
f{k} AS (SELECT x, y, avg(v) AS v, {k} AS pass FROM n{k} WHERE NOT EXISTS (SELECT 1 FROM c{j} WHERE c{j}.x = n{k}.x AND c{j}.y = n{k}.y) GROUP BY x, y HAVING count(*) >= 3 AND max(v) - min(v) <= 0.06 * max(v)),
c{k} AS (SELECT * FROM c{j} UNION ALL SELECT * FROM f{k})"""


@query(
    "g10_completion",
    """
WITH c0 AS (SELECT p_size::BIGINT AS x, (p_partkey % 60)::BIGINT AS y, round(avg(p_retailprice), 4) AS v, 0 AS pass FROM part GROUP BY 1, 2),"""
    + COMPLETE_PASS.format(k=1, j=0) + "," + COMPLETE_PASS.format(k=2, j=1) + " SELECT x, y, round(v, 7) AS v, pass FROM c2",
)
def g10_completion(spark, sf_dir):
    cells = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("x"), (F.col("p_partkey") % 60).alias("y")).agg(F.round(F.avg("p_retailprice"), 4).alias("v"))
    return spatial.complete(cells).withColumn("v", F.round("v", 7))


@query(
    "r10_camera_states",
    """
WITH s AS (SELECT o_custkey, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS share FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN n IS NULL THEN 'unregistered' WHEN n < 3 THEN 'weak' WHEN share >= 0.5 THEN 'registered' ELSE 'uncertain' END AS state FROM customer LEFT JOIN s ON c_custkey = o_custkey
""",
)
def r10_camera_states(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share"))
    state = F.when(F.col("n").isNull(), "unregistered").when(F.col("n") < 3, "weak").when(F.col("share") >= 0.5, "registered").otherwise("uncertain")
    return table(spark, sf_dir, "customer").join(s, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", state.alias("state"))


@query(
    "r14_ancestry",
    """
WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 64 >= 2 THEN p_partkey - p_partkey % 64 + (p_partkey % 64) // 2 END AS parent FROM part),
t AS (
  SELECT node, node AS root, 0::BIGINT AS depth FROM n WHERE parent IS NULL OR parent NOT IN (SELECT node FROM n)
  UNION ALL SELECT n.node, t.root, t.depth + 1 FROM n JOIN t ON n.parent = t.node)
SELECT node, root, depth FROM t
""",
)
def r14_ancestry(spark, sf_dir):
    """Roots and depths of assets under their parents."""
    p = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(p.alias("node"), F.when(p % 64 >= 2, p - p % 64 + F.floor((p % 64) / 2)).cast("long").alias("parent"))
    return graph.ancestry(nodes)


@query("r15_evidence_ratio", "SELECT event_type, round(avg((value IS NOT NULL AND isfinite(value) AND value > 0)::INT), 6) AS share FROM events GROUP BY event_type")
def r15_evidence_ratio(spark, sf_dir):
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")) & (F.col("value") > 0)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(F.coalesce(ok, F.lit(False)).cast("int")), 6).alias("share"))


def spread_sql(extra: int = 4) -> str:
    """The greedy choice, one step after another: gaps to the chosen so far, then the widest."""
    parts = [
        """v AS (SELECT label::VARCHAR AS object, vec_id::INT AS frame, embedding[4]::DOUBLE AS score, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)""",
        "c0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY score DESC, frame) AS k FROM v) WHERE k = 1)",
    ]
    for n in range(extra):
        far = f"sqrt((v.x - c{n}.x) ** 2 + (v.y - c{n}.y) ** 2 + (v.z - c{n}.z) ** 2)"
        gap, more = (f"least(g{n - 1}.gap, {far})", f" JOIN g{n - 1} ON g{n - 1}.object = v.object AND g{n - 1}.frame = v.frame") if n else (far, "")
        parts.append(f"g{n} AS (SELECT v.*, {gap} AS gap FROM v JOIN c{n} ON c{n}.object = v.object{more})")
        parts.append(f"c{n + 1} AS (SELECT object, frame, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY gap DESC, frame) AS k FROM g{n}) WHERE k = 1 AND gap > 0)")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT 'clip' AS clip_id, object, frame AS frame_index, {n} AS rank FROM c{n}" for n in range(extra + 1))


@query("w7_spread_views", spread_sql())
def w7_spread_views(spark, sf_dir):
    """Greedy farthest views by label; order is the semantics."""
    from tesserae.operators import objects

    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double")
    return objects.spread_views(e.select(F.lit("clip").alias("clip_id"), F.col("label").cast("string").alias("object"), F.col("vec_id").cast("int").alias("frame_index"), at(3).alias("score"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z")))


# --- single gates on aggregates ---

PER_SUPPLIER = """p AS (SELECT l_suppkey, l_returnflag, count(*) AS matches, median(l_quantity) AS motion, round(stddev_pop(l_discount) * 20, 9) AS residual, round(avg(l_tax) * 4, 9) AS overlap FROM lineitem GROUP BY ALL)"""


def per_supplier(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("matches"), F.median("l_quantity").alias("motion"), F.round(F.stddev_pop("l_discount") * 20, 9).alias("residual"), F.round(F.avg("l_tax") * 4, 9).alias("overlap"))


@query("f2_low_parallax", f"WITH {PER_SUPPLIER} SELECT l_suppkey, l_returnflag, matches < 6 OR motion < 1.4 OR residual < 0.55 AS low FROM p")
def f2_low_parallax(spark, sf_dir):
    return per_supplier(spark, sf_dir).select("l_suppkey", "l_returnflag", gates.low_parallax(F.col("matches"), F.col("motion"), F.col("residual")).alias("low"))


@query("f3_weak_links", f"WITH {PER_SUPPLIER} SELECT l_suppkey, l_returnflag, matches < 8 OR (overlap < 0.18 AND matches < 48) AS weak FROM p")
def f3_weak_links(spark, sf_dir):
    return per_supplier(spark, sf_dir).select("l_suppkey", "l_returnflag", gates.weak_link(F.col("matches"), F.col("overlap")).alias("weak"))


@query(
    "f8_accepted_poses",
    "WITH p AS (SELECT l_suppkey, count(*) AS m, count(*) FILTER (WHERE l_discount <= 0.055) AS i, median(l_discount) * 50 AS e FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, i >= 8 AND i >= 0.55 * m AND e <= 2.5 AS accepted FROM p",
)
def f8_accepted_poses(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("l_discount") <= 0.055).alias("i"), (F.median("l_discount") * 50).alias("e"))
    return p.select("l_suppkey", gates.accepted_pose(F.col("i"), F.col("m"), F.col("e")).alias("accepted"))


@query(
    "f11_reciprocal_fusion",
    """
WITH a AS (SELECT a.l_orderkey, a.l_extendedprice AS d, b.l_extendedprice AS back FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber)
SELECT l_orderkey, count(*) AS views, round(avg(CASE WHEN abs(back - d) <= 0.08 * d THEN back END), 6) AS fused FROM a GROUP BY l_orderkey HAVING count(*) FILTER (WHERE abs(back - d) <= 0.08 * d) > 0
""",
)
def f11_reciprocal_fusion(spark, sf_dir):
    """Depths that agree both ways, fused to their mean."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    b = l.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("back"))
    met = l.join(b, F.expr("l_orderkey = o and l_linenumber <> n")).withColumn("ok", gates.reciprocal(F.col("l_extendedprice"), F.col("back")))
    out = met.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("views"), F.round(F.avg(F.when(F.col("ok"), F.col("back"))), 6).alias("fused"), F.count_if("ok").alias("n"))
    return out.where("n > 0").drop("n")


@query("f12_closures", "SELECT o_orderkey, (d <= 0.35 AND a <= 8 AND (d >= 0.005 OR a >= 0.1)) AS closes FROM (SELECT o_orderkey, (o_orderkey % 100) / 200.0 AS d, (o_custkey % 40) / 4.0 AS a FROM orders)")
def f12_closures(spark, sf_dir):
    d, a = (F.col("o_orderkey") % 100) / 200.0, (F.col("o_custkey") % 40) / 4.0
    return table(spark, sf_dir, "orders").select("o_orderkey", gates.closes(d, a, F.lit(1.0)).alias("closes"))


@query(
    "p7_confidence",
    "SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, l_quantity / 50)) * greatest(0, least(1, 1 - l_discount * 5)) * greatest(0, least(1, l_tax * 100 / 6)), 6) AS confidence FROM lineitem",
)
def p7_confidence(spark, sf_dir):
    c = gates.confidence(F.col("l_quantity") / 50, 1 - F.col("l_discount") * 5, gates.margin_score(F.col("l_tax") * 100))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(c, 6).alias("confidence"))


from tesserae.plans import evidence, files, scenes, sheets  # noqa: E402, F401

QUERIES |= scenes.QUERIES
