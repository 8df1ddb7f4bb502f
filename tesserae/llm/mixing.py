"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import common

#: Expected members of one block of the reduction tree; blocks are cut by hash, so none grows with the input.
BLOCK = 256
#: Up to this many sources the table of targets is broadcast (some tens of bytes a row); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000
EPS = 1e-12


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """One row per source: source, docs, source_size, target.

    sizes has source and size. Sources in code-point order, null last, get the weights in turn and share the sum of all sizes
    by weight; a target stops at cap times its source's size and the excess goes to the others by weight until none is above.
    An empty table gives no rows; sources of size 0 get target 0.
    """
    each = common.materialise(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").cast("long").alias("source_size")), "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    full = (F.col("source_size") * F.lit(float(cap))).alias("full")
    listed = common.materialise(numbered(each).select("source", "docs", "source_size", full, weight.alias("weight")), "mix-weights")
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    # each round adds the sources that the common level fills; it only rises, and ends with a round that adds none
    level, filled = 0.0, -1
    while True:
        is_full = F.col("full") <= F.lit(level) * F.col("weight")
        held, open_weight, n = listed.agg(F.coalesce(F.sum(F.when(is_full, F.col("full"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)), F.count(F.when(is_full, 1))).first()
        if n == filled or not open_weight:
            break
        level, filled = max(level, (total - held) / open_weight), n
    target = F.least("full", F.lit(level) * F.col("weight")) if open_weight else F.col("full")
    common.discard(each)
    return listed.select("source", "docs", "source_size", target.alias("target"))


def numbered(each: DataFrame) -> DataFrame:
    """each (written before) with nth, its place in the order of source, null last.

    Sources are dealt to ranges of the order and numbered in each; a range begins after the rows of those before it. So no task
    sees all sources, and only the ranges' sizes (one row a partition) go through one.
    """
    spark = each.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = common.materialise(each.repartitionByRange(most, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-ranges")
    sizes = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a partition
    starts = [sum(n for j, n in sizes.items() if j < k) for k in range(max(sizes, default=0) + 1)]
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    start = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("range"))
    return dealt.withColumn("nth", start + within).drop("range")


def fold(seed: int, level: int) -> str:
    """SQL that folds the array `units` of (p, size, key, row) by pivotal steps into (done: array of (row, bit), left: the last unit).

    A step takes the carried unit and the next one and moves words between them, so that the sum of p * size stays, until
    one of the two is 0 or 1. The direction is drawn with the odds that keep both expectations. That one is settled.
    """
    u = f"(shiftrightunsigned(xxhash64({seed}, {level}, acc.left.key, x.key), 11) * {2.0**-53!r}D)"
    up = "least((1D - acc.left.p) * acc.left.size, x.p * x.size)"
    down = "least(acc.left.p * acc.left.size, (1D - x.p) * x.size)"
    move = f"if({u} * ({up} + {down}) < {down}, {up}, -{down})"
    near = f"({{0}} <= {EPS!r}D or {{0}} >= 1D - {EPS!r}D)"
    settled = "array_append(acc.done, struct({0}.row as row, {1} > 0.5D as bit))"
    unit = "struct({1} as p, {0}.size as size, {0}.key as key, {0}.row as row)"
    a, b = "(acc.left.p + m / acc.left.size)", "(x.p - m / x.size)"
    met = f"if({near.format(a)}, struct({settled.format('acc.left', a)} as done, {unit.format('x', b)} as left), struct({settled.format('x', b)} as done, {unit.format('acc.left', a)} as left))"
    step = f"if({near.format('acc.left.p')}, struct({settled.format('acc.left', 'acc.left.p')} as done, x as left), transform(array({move}), m -> {met})[0])"
    start = "struct(slice(transform(units, d -> struct(d.row as row, false as bit)), 1, 0) as done, units[0] as left)"
    return f"aggregate(slice(units, 2, size(units)), {start}, (acc, x) -> {step})"


def units_of(rows: DataFrame, seed: int) -> DataFrame:
    unit = F.struct(F.col("p"), F.col("size").cast("double").alias("size"), F.xxhash64(F.lit(seed), F.col("row")).alias("key"), F.col("row"))
    return rows.select("source", unit.alias("unit"), F.floor(F.log2(F.col("size") + 1) * 4).cast("long").alias("place"))


def folded(cut: DataFrame, seed: int, level: int, *by: str) -> DataFrame:
    """One row for each group by `by`: source, place, got (done, left). Units lie in the order of size."""
    members = F.array_sort(F.collect_list(F.struct(F.col("place"), F.col("unit.key").alias("k"), F.col("unit"))))
    blocks = cut.groupBy(*by).agg(members.alias("members"), F.max("place").alias("place"))
    units = blocks.select("source", "place", F.transform("members", lambda m: m["unit"]).alias("units"))
    return common.materialise(units.select("source", "place", F.expr(fold(seed, level)).alias("got")), "mix-level")


def settled(got: DataFrame, left: DataFrame, seed: int) -> DataFrame:
    """Rows and bits of what got has settled, and of left, drawn by its probability."""
    drawn = common.unit(F.lit(seed), F.lit(-1), F.col("got.left.key")) < F.col("got.left.p")
    done = got.select("source", F.explode("got.done").alias("d")).select("source", "d.row", "d.bit")
    return done if left is None else done.unionByName(left.select("source", F.col("got.left.row").alias("row"), drawn.alias("bit")))


def round_tree(rows: DataFrame, seed: int = 0) -> DataFrame:
    """rows: source, p (in [0, 1)), size (over 0), row (a struct). Returns source, row, bit: one row for each unit.

    Level 0 cuts each source into size classes and those by hash into blocks of about BLOCK units; each block is folded to
    whole bits and one residual. Each higher level hashes a source's residuals into blocks, until one block holds all; its
    residual is drawn by its probability. So a source keeps its words to less than one unit, nothing depends on the number
    of partitions, and a source with a third of all rows is just more blocks.
    """
    now, out, level, last = units_of(rows, seed), None, 0, False
    while not last:
        split = now.withColumn("class", F.col("place") if level == 0 else F.lit(0).cast("long"))
        parts = split.groupBy("source", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).withColumnsRenamed({"source": "s", "class": "c"})
        parts = common.materialise(parts, "mix-parts")
        n, most = parts.agg(F.count(F.lit(1)), F.max("parts")).first()
        last = level > 0 and (most or 1) <= 1
        cut = split.join(F.broadcast(parts) if n <= BROADCAST_SOURCES else parts, F.expr("source <=> s and class = c"))
        got = folded(cut.withColumn("part", F.pmod(F.xxhash64(F.lit(level), F.col("unit.key")), F.col("parts"))), seed, level, "source", "class", "part")
        bits = settled(got, got if last else None, seed)
        out = bits if out is None else out.unionByName(bits)
        now = got.select("source", F.col("got.left").alias("unit"), "place")
        level += 1
    return out


#: A row with over 1 / LARGE of its source's words is rounded first; a source has fewer than LARGE of those.
LARGE = 64


def plan_mix(rows: DataFrame, seed: int = 0, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """rows: source, size, row (a struct that tells rows apart as far as they differ). Returns row, size, source_size, target, copies.

    A row is copied target / source_size times on average: the whole part of that, and one more by pivotal rounding of the
    rest. A source's large rows are rounded first, and the rate of its other rows makes up for what that gave too much or too
    little, so that the last residual is a small row. No row is copied more than cap times. Rows of size 0 count no words;
    they are copied at the same rate. An empty table gives no rows.
    """
    goals = common.materialise(targets(rows, weights, cap), "mix-targets")
    few = goals.count() <= BROADCAST_SOURCES
    wide = lambda df: F.broadcast(df) if few else df
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    put = rows.join(wide(goals.withColumn("rate", rate).withColumnRenamed("source", "s").drop("docs")), F.expr("source <=> s"))
    put = put.withColumn("row", F.struct("row", "size", "source_size", "target"))
    base, p = F.floor("rate").cast("long").alias("base"), (F.col("rate") - F.floor("rate")).alias("p")
    is_large = F.col("size") * LARGE > F.col("source_size")

    large = put.where(is_large & (F.col("size") > 0)).select("source", "size", "row", base, p).withColumn("row", F.struct("row", "base"))
    got = folded(units_of(large, seed), seed, -1, "source")
    first = settled(got, got, seed).select("source", "row.row", (F.col("row.base") + F.col("bit").cast("long")).alias("copies"))
    gave = first.groupBy("source").agg(F.sum(F.col("row.size") * F.col("copies")).alias("gave"), F.sum("row.size").alias("held")).withColumnRenamed("source", "g")
    small = put.where(~is_large | (F.col("size") <= 0)).join(wide(gave), F.expr("source <=> g"), "left")
    rest = F.col("source_size") - F.coalesce("held", F.lit(0))
    makes_up = F.when(F.col("gave").isNull(), F.col("rate")).when(rest > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), (F.col("target") - F.col("gave")) / rest))).otherwise(F.col("rate"))
    small = small.withColumn("rate", makes_up).select("source", "size", F.struct("row", base).alias("row"), p)
    whole = (F.col("p") <= 0) | (F.col("size") <= 0)
    chance = (common.unit(F.lit(seed), F.lit(-2), F.col("row.row.row")) < F.col("p")).alias("bit")
    second = round_tree(small.where(~whole), seed).unionByName(small.where(whole).select("source", "row", chance))
    both = first.select("row", "copies").unionByName(second.select("row.row", (F.col("row.base") + F.col("bit").cast("long")).alias("copies")))
    return both.select("row.row", "row.size", "row.source_size", "row.target", "copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """docs with every row as often as the mix takes it; columns stay as they are.

    Sizes are words (null text: none). Rows that are alike in every column are counted one by one. Null ids and sources are
    values like others. An empty table stays empty.
    """
    like = common.row_hash(docs)
    base = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), like.alias("__h"), F.col(source_col).alias("__source"), common.word_count(F.col(text_col)).alias("__size"))
    counted = common.materialise(base.groupBy("__id", "__h", "__source", "__size").agg(F.count(F.lit(1)).alias("__n")), "mix-rows")
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))
    units = counted.withColumn("__nth", nth).select(F.col("__source").alias("source"), F.col("__size").alias("size"), F.struct("__id", "__h", "__nth").alias("row"))
    copies = plan_mix(units, seed).select(F.col("row.__id").alias("__i"), F.col("row.__h").alias("__k"), F.col("row.__nth").alias("__nth"), "copies")
    planned = copies.groupBy("__i", "__k").agg(F.map_from_entries(F.collect_list(F.struct("__nth", "copies"))).alias("__plan"), F.max("__nth").alias("__most"))
    # rows alike are numbered only where there are several; both branches read the same exchange of the texts
    joined = base.select("__row", "__id", "__h").join(planned, F.expr("__id <=> __i and __h = __k"))
    once = joined.where("__most = 1").select("__row", F.col("__plan")[1].alias("copies"))
    several = joined.where("__most > 1").withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__h").orderBy("__most")).cast("long"))
    taken = once.unionByName(several.select("__row", F.col("__plan")[F.col("__nth")].alias("copies")))
    return taken.where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    docs = common.table(spark, sf_dir, "documents")
    sizes = docs.select("source", common.word_count(F.col("text")).alias("size"), F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("row"))
    mixed = plan_mix(common.materialise(sizes, "mix-sizes"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
