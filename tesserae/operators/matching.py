"""Descriptor matching as joins: ratio-tested nearest neighbours, greedy one-to-one, mutual best, composition, dominant displacement."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Features of a frame, or of a cell of one, that a task compares with as many of another at a time.
BLOCK = 4096


def l1(a: Column, b: Column) -> Column:
    """Mean absolute difference, rounded so that ranks don't hang on the last bits."""
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a), 9)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def strongest(features: DataFrame, frame: str, score: str, cap: int, *ties: str) -> DataFrame:
    """The `cap` best features of a frame by falling score; ties keep the given order."""
    w = Window.partitionBy(frame).orderBy(F.desc(score), *ties)
    return features.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap).drop("_rank")


def candidate_pairs(features: DataFrame, step: int = 1, radius: float | None = None, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """features: frame, id, x, y, d (descriptor). Pairs of a feature and those `step` frames later, within radius of its shifted place.

    With a radius both sides are dealt to grid cells of that size, so a feature meets nine cells rather than the whole frame.
    """
    a = features.select(F.col("frame").alias("frame_a"), F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("d").alias("da"))
    b = features.select(F.col("frame").alias("frame_b"), F.col("id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("d").alias("db"))
    if radius is None:
        return a.join(b, F.col("frame_b") == F.col("frame_a") + step)
    cell = lambda c: F.floor(c / radius).cast("long")
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    a = a.withColumn("ox", F.explode(near)).withColumn("oy", F.explode(near))
    a = a.withColumn("cx", cell(F.col("xa") + dx) + F.col("ox")).withColumn("cy", cell(F.col("ya") + dy) + F.col("oy")).drop("ox", "oy")
    b = b.withColumn("bx", cell(F.col("xb"))).withColumn("by", cell(F.col("yb")))
    met = a.join(b, (F.col("frame_b") == F.col("frame_a") + step) & (F.col("cx") == F.col("bx")) & (F.col("cy") == F.col("by")))
    far = (F.col("xb") - F.col("xa") - dx) ** 2 + (F.col("yb") - F.col("ya") - dy) ** 2
    return met.where(far <= radius * radius).drop("cx", "cy", "bx", "by")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as columns of doubles, `width` long; what is null or lacking is NaN."""
    lists = column.combine_chunks()
    values = lists.flatten().cast(pa.float64())
    if not lists.null_count and not values.null_count and len(values) == width * len(lists):
        sizes = np.diff(lists.offsets.to_numpy())
        if (sizes == width).all():
            return np.ascontiguousarray(values.to_numpy().reshape(len(lists), width).T)
    out = np.full((width, len(lists)), np.nan)
    for k, v in enumerate(lists.to_pylist()):
        if v:
            out[: len(v), k] = [np.nan if x is None else x for x in v]
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """Billionths, halves up by the decimal digits of x like Spark's round: ranks by it are ranks by the rounded distance."""
    t = x * 1e9
    low = np.floor(t)
    part = t - low
    q = low + (part >= 0.5)
    top = np.max(t, initial=0.0, where=np.isfinite(t))
    for at in zip(*np.nonzero(np.abs(part - 0.5) < 1e-6 + 5e-16 * top)):
        if t[at] < 2**52:
            q[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal("1e-9"), ROUND_HALF_UP) * 10**9)
    return np.where(np.isfinite(q), q, 1e300)


def l1_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of all columns of a and b, in tiles that stay in the cache."""
    out = np.zeros((a.shape[1], b.shape[1]), a.dtype)
    for r in range(0, a.shape[1], 128):
        for c in range(0, b.shape[1], 1024):
            tile = out[r : r + 128, c : c + 1024]
            total, part = np.zeros(tile.shape, a.dtype), np.empty(tile.shape, a.dtype)
            for x, y in zip(a[:, r : r + 128, None], b[:, None, c : c + 1024]):
                np.subtract(x, y, out=part)
                np.abs(part, out=part)
                total += part
            tile[:] = total
    return out


def l1_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Mean absolute differences of pairs of columns, summed in order of the dimensions like l1()."""
    out = np.zeros(len(i))
    for k in range(0, len(i), 1 << 20):
        for x, y in zip(a, b):
            out[k : k + (1 << 20)] += np.abs(x[i[k : k + (1 << 20)]] - y[j[k : k + (1 << 20)]])
    return out / len(a)


def second_least(q: np.ndarray) -> np.ndarray:
    """The second least of each row, infinite for a row of one."""
    rows, first = np.arange(len(q)), q.argmin(1)
    least = q[rows, first]
    q[rows, first] = np.inf
    out = q.min(1)
    q[rows, first] = least
    return out


def two_of_each(groups: np.ndarray, rank: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Whether an entry is one of the first two of its group, by rank and then ties."""
    order = np.lexsort((ties, rank, groups))
    g = groups[order]
    out = np.ones(len(g), bool)
    out[order[2:]] = g[2:] != g[:-2]
    return out


def near_pairs(left: pa.Table, right: pa.Table, hamming: bool, reach: tuple[float, float, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in left, in right, distance): the two nearest of each row on either side, ties to the lower place.

    Sums in single precision, with a bound for what they may be off, tell which pairs can be among them; those are worked out in double precision. Vectors
    that are not finite are compared in double precision at once.
    """
    slack = 0.0
    if hamming:
        a, b = (t.column("d").to_numpy().view(np.uint64) for t in (left, right))
        q = np.bitwise_count(a[:, None] ^ b).astype(np.float32)
    else:
        width = max(1, *(pc.max(pc.list_value_length(t.column("d"))).as_py() or 0 for t in (left, right)))
        a, b = matrix(left.column("d"), width), matrix(right.column("d"), width)
        size = np.abs(a).sum(0).max() + np.abs(b).sum(0).max()
        if size < 1e30:
            slack = float((width + 4) * np.finfo(np.float32).eps * size * 2 + 2e-9 * width)
            q = l1_block(a.astype(np.float32), b.astype(np.float32))
        else:
            q = rounded(l1_block(a, b) / width)
    if reach:
        (xa, ya), (xb, yb) = ([t.column(c).to_numpy() for c in "xy"] for t in (left, right))
        radius, dx, dy = reach
        for r in range(0, len(q), 128):
            some = slice(r, r + 128)
            q[some][~((xb - xa[some, None] - dx) ** 2 + (yb - ya[some, None] - dy) ** 2 <= radius * radius)] = np.inf
    by_row, by_column = second_least(q) + slack, second_least(np.ascontiguousarray(q.T)) + slack
    i, j = np.nonzero((q < np.inf) & ((q <= by_row[:, None]) | (q <= by_column)))
    distance = np.bitwise_count(a[i] ^ b[j]).astype(np.int32) if hamming else l1_pairs(a, b, i, j)
    rank = distance if hamming else rounded(distance)
    on = two_of_each(i, rank, j) | two_of_each(j, rank, i)
    return i[on], j[on], distance[on]


def nearest_pairs(features: DataFrame, step: int = 1, radius: float | None = None, dx: float = 0.0, dy: float = 0.0, bits: bool = False, block: int | None = None) -> DataFrame:
    """frame_a, frame_b, a, b, distance: of candidate_pairs() those that rank first or second for one of their features, and some more.

    So ratio_matches(), mutual_best(), reverse_checked() and both_ways() give the same rows as over all pairs. Both frames are dealt to blocks by a hash
    of the id; a task compares one block with another and keeps two pairs for each row of either, so all pairs are looked at and none is shuffled. With a
    radius, frames of more than a block are dealt to cells of that size first. `d` is a vector, or a long where `bits` are compared.
    """
    block = block or BLOCK
    n = features.groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    sizes = n.select(F.col("frame").alias("frame_a"), F.col("n").alias("na")).join(n.select((F.col("frame") - step).alias("fb"), F.col("frame").alias("frame_b"), F.col("n").alias("nb")), F.expr("frame_a = fb")).drop("fb")
    columns = ["frame_a", "frame_b", "id", "x", "y", "d"]
    wide = F.lit(False) if radius is None else F.greatest("na", "nb") > block
    cell = lambda c: F.floor(c / radius).cast("long") if radius else F.lit(0).cast("long")
    shift = lambda: F.explode(F.when(wide, F.array(*[F.lit(k) for k in (-1, 0, 1)])).otherwise(F.array(F.lit(0))))
    a = features.join(sizes, F.expr("frame = frame_a")).select(*columns, "na", "nb", shift().alias("ox"), "frame").select("*", shift().alias("oy"))
    b = features.join(sizes, F.expr("frame = frame_b"))
    none = F.lit(0).cast("long")
    a = a.select(*columns, F.when(wide, cell(F.col("x") + dx) + F.col("ox")).otherwise(none).alias("cx"), F.when(wide, cell(F.col("y") + dy) + F.col("oy")).otherwise(none).alias("cy"))
    b = b.select(*columns, F.when(wide, cell(F.col("x"))).otherwise(none).alias("cx"), F.when(wide, cell(F.col("y"))).otherwise(none).alias("cy"))
    key = ["frame_a", "frame_b", "cx", "cy"]
    parts = lambda df, c: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).alias(c))
    dealt = parts(a, "ka").join(parts(b, "kb"), key)
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    all_of = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    a = a.join(dealt, key).select(*key, "id", "x", "y", "d", own("ka").alias("i"), all_of("kb").alias("j"))
    b = b.join(dealt, key).select(*key, "id", "x", "y", "d", own("kb").alias("j"), all_of("ka").alias("i"))
    b = b.toDF(*[f"{c}_" for c in b.columns])  # names of their own, since both sides come from one table
    reach = None if radius is None else (radius, dx, dy)
    kinds = dict(features.dtypes)
    schema = f"frame_a {kinds['frame']}, frame_b {kinds['frame']}, a {kinds['id']}, b {kinds['id']}, distance {'int' if bits else 'double'}"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("id"), right.rename_columns([c[:-1] for c in right.column_names]).sort_by("id")
        i, j, distance = near_pairs(left, right, bits, reach) if left.num_rows and right.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32 if bits else np.float64))
        taken = [left.column("frame_a").take(i), left.column("frame_b").take(i), left.column("id").take(i), right.column("id").take(j), pa.array(distance)]
        return pa.table(taken, ["frame_a", "frame_b", "a", "b", "distance"])

    met = a.groupBy(*key, "i", "j").cogroup(b.groupBy(*[f"{c}_" for c in (*key, "i", "j")])).applyInArrow(run, schema)
    return met if bits else met.withColumn("distance", F.round("distance", 9))


def ratio_matches(pairs: DataFrame, ratio: float, limit: float | None = None) -> DataFrame:
    """pairs: frame_a, frame_b, a, b, distance. Each a's nearest b whose distance is under ratio times the runner-up's.

    An exact tie for the nearest counts as runner-up, so it fails. An a with one candidate only passes.
    """
    w = Window.partitionBy("frame_a", "frame_b", "a").orderBy("distance", "b")
    ranked = pairs.withColumn("_rank", F.row_number().over(w)).withColumn("_next", F.lead("distance").over(w)).where("_rank = 1")
    good = F.col("_next").isNull() | (F.col("distance") < ratio * F.col("_next"))
    kept = ranked.where(good if limit is None else good & (F.col("distance") <= limit))
    return kept.select("frame_a", "frame_b", "a", "b", "distance")


def one_to_one(matches: DataFrame) -> DataFrame:
    """Greedy resolution: a target goes to the proposal of least distance, then least a. Each source proposes once, so this is the greedy result."""
    w = Window.partitionBy("frame_a", "frame_b", "b").orderBy("distance", "a")
    return matches.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest; ties go to the lower index."""
    fwd = Window.partitionBy("frame_a", "frame_b", "a").orderBy("distance", "b")
    rev = Window.partitionBy("frame_a", "frame_b", "b").orderBy("distance", "a")
    ranked = pairs.withColumn("_f", F.row_number().over(fwd)).withColumn("_r", F.row_number().over(rev))
    return ranked.where("_f = 1 and _r = 1").drop("_f", "_r")


def reverse_checked(proposals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy first, then the mutual check: a match that fails it has still used up its target."""
    best = pairs.groupBy("frame_a", "frame_b", "b").agg(F.min(F.struct("distance", "a")).alias("m")).select("frame_a", "frame_b", "b", F.col("m.a").alias("back"))
    return one_to_one(proposals).join(best, ["frame_a", "frame_b", "b"]).where("back = a").drop("back")


def both_ways(pairs: DataFrame, ratio: float, limit: float | None = None) -> DataFrame:
    """Ratio-tested greedy matches from a to b that are also such matches from b to a."""
    turned = pairs.select("frame_a", "frame_b", F.col("b").alias("a"), F.col("a").alias("b"), "distance")
    back = one_to_one(ratio_matches(turned, ratio, limit)).select("frame_a", "frame_b", F.col("b").alias("a"), F.col("a").alias("b"))
    return one_to_one(ratio_matches(pairs, ratio, limit)).join(back, ["frame_a", "frame_b", "a", "b"], "left_semi")


def compose(matches: DataFrame, links: int) -> DataFrame:
    """Chains of `links` adjacent matches as one match with the worst distance."""
    out = matches.select("frame_a", "a", "frame_b", "b", "distance")
    step = matches.select(F.col("frame_a").alias("f"), F.col("a").alias("g"), F.col("frame_b").alias("to"), F.col("b").alias("last"), F.col("distance").alias("worst"))
    for _ in range(links - 1):
        met = out.join(step, (F.col("frame_b") == F.col("f")) & (F.col("b") == F.col("g")))
        out = met.select("frame_a", "a", F.col("to").alias("frame_b"), F.col("last").alias("b"), F.greatest("distance", "worst").alias("distance"))
    return out


def dominant(votes: DataFrame, group: str, value: str, reach: float, least: int, share: float) -> DataFrame:
    """Mode by tolerance voting: the value with most neighbours within reach (ties: least spread, then least id), median of its neighbours.

    votes: group, id, value. Neighbours meet by buckets of the reach, so far values never do.
    """
    bucket = F.floor(F.col(value) / reach).cast("long")
    a = votes.select(F.col(group).alias("g"), F.col("id").alias("i"), F.col(value).alias("v"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k"))
    b = votes.select(F.col(group).alias("h"), F.col(value).alias("u"), bucket.alias("l"))
    met = a.join(b, (F.col("g") == F.col("h")) & (F.col("k") == F.col("l")) & (F.abs(F.col("u") - F.col("v")) <= reach))
    scored = met.groupBy("g", "i", "v").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs(F.col("u") - F.col("v"))), 6).alias("spread"), F.median("u").alias("m"))
    total = votes.groupBy(F.col(group).alias("h")).agg(F.count(F.lit(1)).alias("all"))
    best = scored.groupBy("g").agg(F.min(F.struct(-F.col("n"), "spread", "i", "n", "m")).alias("x"))
    met = best.join(total, F.col("g") == F.col("h")).where((F.col("x.n") >= least) & (F.col("x.n") >= share * F.col("all")))
    return met.select(F.col("g").alias(group), F.col("x.n").alias("votes"), F.col("x.m").alias("mode"))
