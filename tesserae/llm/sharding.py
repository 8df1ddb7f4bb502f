"""Sharding by longest-processing-time scheduling over groups that stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import common

#: Each shard gets about this many bundles. A group over total / (shards * BUNDLES) is scheduled by itself; there can be at
#: most shards * BUNDLES of those, and the smaller ones are hashed into as many bundles, so the heap never sees more than twice that.
BUNDLES = 256
#: Cells for numbering the slots of a shard without one task per shard.
CELLS = 1024


def lpt(items: list[tuple], shards: int) -> dict:
    """Longest processing time first: items (size, key) by falling size go to the least-loaded shard, ties to the lower shard."""
    heap = [(0, k) for k in range(shards)]
    placed = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def assign_shards(docs: DataFrame, size: Column, group: Column, order: list[Column], shards: int = 16, prefix: str = "") -> DataFrame:
    """Rows of docs with <prefix>shard and <prefix>slot.

    Rows whose `group` values are equal share a shard; the sums of `size` are near equal as far as the groups allow it; slots
    count from 0 in each shard without gaps, in no meaningful order. Groups larger than 1 / (shards * BUNDLES) of all are
    scheduled one by one, the rest in hashed bundles, so the heap holds a bounded number of items whatever the number of rows.
    Null groups form one group. An empty table gives an empty table; a repeated row counts as often as it occurs.
    Columns of docs keep their names and values, also where they are called shard or slot, if a prefix tells them apart.
    """
    spark = docs.sparkSession
    bundles = shards * BUNDLES
    h1, h2 = common.text_hash(group)
    sized = docs.select(h1, h2, size.cast("long").alias("size"))
    groups = common.materialise(sized.groupBy("h1", "h2").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    bundle = F.pmod(F.col("h1"), F.lit(bundles)).cast("int")
    large = groups.where(F.col("size") * bundles > total).collect()
    small = groups.where(F.col("size") * bundles <= total).groupBy(bundle.alias("b")).agg(F.sum("size").alias("size")).collect()
    placed = lpt([(r["size"], (1, r["h1"], r["h2"])) for r in large] + [(r["size"], (0, r["b"], 0)) for r in small], shards)
    one = spark.createDataFrame([(*k[1:], s) for k, s in placed.items() if k[0]], "__h1 long, __h2 long, __large int")
    many = spark.createDataFrame([(k[1], s) for k, s in placed.items() if not k[0]], "__b int, __small int")
    common.discard(groups)

    keyed = docs.select(F.struct("*").alias("__row"), h1.alias("__k1"), h2.alias("__k2"), F.pmod(F.xxhash64(*order, h1), F.lit(CELLS)).alias("__cell"), *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    # both maps have at most shards * BUNDLES rows
    put = (
        keyed.join(F.broadcast(one), (F.col("__k1") == F.col("__h1")) & (F.col("__k2") == F.col("__h2")), "left")
        .join(F.broadcast(many), F.pmod(F.col("__k1"), F.lit(bundles)).cast("int") == F.col("__b"), "left")
        .withColumn("__shard", F.coalesce("__large", "__small"))
        .select("__row", "__k1", "__shard", "__cell", *[f"__o{i}" for i in range(len(order))])
    )
    counts = put.groupBy("__shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))  # at most shards * CELLS rows
    before = Window.partitionBy("__shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__shard").alias("__s"), F.col("__cell").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__shard", "__cell").orderBy(*[f"__o{i}" for i in range(len(order))], "__k1")
    numbered = put.withColumn("__at", F.row_number().over(within).cast("long") - 1)
    return numbered.join(F.broadcast(starts), (F.col("__shard") == F.col("__s")) & (F.col("__cell") == F.col("__c"))).select(
        "__row.*", F.col("__shard").alias(f"{prefix}shard"), (F.col("__start") + F.col("__at")).alias(f"{prefix}slot")
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; equal texts stay together (null counts as the empty text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = common.table(spark, sf_dir, "documents")
    h1, h2 = common.text_hash(text)
    narrow = common.materialise(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.struct(h1, h2).alias("group")), "sizes")
    out = assign_shards(narrow, F.col("size"), F.col("group"), [F.col("doc_id")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
