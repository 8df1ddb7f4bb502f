"""SimHash near-dedup: fingerprints, links by a positional byte index with count filtering, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import common

#: Bytes of a fingerprint, and how many differing bits still link two of them. So many bytes at least are equal in a link.
BYTES, DISTANCE = 8, 4
MATCHES = BYTES - DISTANCE
#: The index lists fingerprints by three positional bytes at a time: a list for a single byte would hold a fixed share of all rows.
#: The sets of positions are chosen so that any MATCHES equal bytes hold one of the sets whole (see covering()), so no link is lost.
WIDTH = 3
#: A fingerprint that more rows than this have is named by a broadcast of such fingerprints (at most rows / HOT of them), so
#: that no join gathers a group of copies in one task.
HOT = 1 << 20
#: Fingerprints of one list that a task compares at once; longer lists are cut into blocks and pairs of blocks.
BLOCK = 4096


def covering(points: int = BYTES, chosen: int = MATCHES, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Position sets of `width` such that any `chosen` of the `points` positions hold one of them whole.

    Greedy: take the set that lies in most of the still uncovered choices, the first of equals.
    """
    left = set(combinations(range(points), chosen))
    sets = list(combinations(range(points), width))
    family = []
    while left:
        best = max(sets, key=lambda s: sum(set(s) <= set(c) for c in left))
        family.append(best)
        left = {c for c in left if not set(best) <= set(c)}
    return family


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text's shingles of `width` words, repeats included.

    A shingle is XXH64 (seed 42) of its words joined by spaces; fewer words make one shingle; no words give 0. A bit is 1 if
    it is set in over half of the shingles.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(flat, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the 8 positional bytes are equal, from the xor of two fingerprints."""
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    return BYTES - np.bitwise_count(y & np.uint64(0x0101010101010101))  # the lowest bit of each byte tells whether any of it is set


def forest(fps: np.ndarray, matches: int = MATCHES, distance: int = DISTANCE, tally: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all links among fps would: a spanning forest.

    Breadth first: what links to the one at hand leaves the pool. A dense group of near copies is used up in a few steps, so
    neither work nor output are the group's pairs. Shared positional bytes are tallied first; only pairs that reach `matches`
    are verified. tally, if given, counts pairs met, retained by the filter, and linked.
    """
    pool, links = fps, []
    while len(pool) > 1:
        queue, pool = [pool[0]], pool[1:]
        while queue and len(pool):
            one = queue.pop()
            x = np.bitwise_xor(pool, one)
            retained = np.flatnonzero(shared_bytes(x) >= matches)
            near = retained[np.bitwise_count(x[retained]) <= distance]
            if tally is not None:
                tally += (len(x), len(retained), len(near))
            if len(near):
                links += [(int(one.view(np.int64)), int(o)) for o in pool[near].view(np.int64)]
                queue += list(pool[near])
                pool = np.delete(pool, near)
    return links


def links(distinct: DataFrame) -> DataFrame:
    """distinct: fp (long), no repeats. Returns links (a, b) that connect the same fingerprints as all links within DISTANCE bits."""
    family = covering()
    masks = [sum(0xFF << (8 * p) for p in s) for s in family]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    listed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("position", "value"))
    posted = listed.select("fp", F.xxhash64("position", "value").alias("list"), "position", "value")
    sizes = posted.groupBy("position", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnsRenamed({"position": "p", "value": "v"})
    several = posted.join(sizes, F.expr("position = p and value = v")).select("fp", "position", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # a list longer than BLOCK is cut into blocks, and every pair of blocks is compared as a list of its own
    own = F.pmod(F.xxhash64(F.lit(5), F.col("fp")), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j")))
    dealt = several.withColumn("own", own).select("fp", F.explode(pairs).alias("pair"), "position", "value").select("fp", "position", "value", "pair.i", "pair.j")
    grouped = dealt.repartition("position", "value", "i", "j").sortWithinPartitions("position", "value", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        parts: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(parts) if len(parts) > 1 else parts[0]
            if found := forest(fps.view(np.uint64)):
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp, *keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            change = np.zeros(len(fp), bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(fp)]
            for x, y in zip(cuts, cuts[1:]):
                key = tuple(int(k[x]) for k in keys)
                if held is not None and key != held:
                    yield from flush()
                    parts = []
                held = key
                parts.append(fp[x:y])
        if held is not None:
            yield from flush()

    found = grouped.mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (any orderable type). Returns (node, root): root is the least node of the component.

    Alternates large-star and small-star steps (every node hands its larger, then its smaller, neighbours to the least one it
    knows) until nothing changes. Steps only take minima by node, so a hub costs no more than its links; lineage is cut by
    writing each round to the shared folder.
    """
    now = common.materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        met = both.join(least, both.u == least.w)
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    state = None
    while True:
        step = common.materialise(star(star(now, True), False), "edges")
        sign = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.discard(now)
        now = step
        if sign == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = sign


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp, component): for every row its fingerprint and the least id among all documents that links reach.

    Fingerprints link at DISTANCE or fewer differing bits; equal ones are one node. Null and empty texts have fingerprint 0
    and link like any other. A component all of whose ids are null has component null. An empty table stays empty.
    """
    prints = common.materialise(with_fingerprints(docs, id_col, text_col), "prints")
    nodes = common.materialise(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "m"), F.col("fp") == F.col("m"), "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "r")
    named = common.materialise(rooted.join(first, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component", "rows"), "named")
    hot = [r["f"] for r in named.where(F.col("rows") > HOT).select("f").collect()]  # at most rows / HOT
    cold = prints.where(~F.col("fp").isin(hot)).join(named.where(F.col("rows") <= HOT), F.col("fp") == F.col("f"))
    if not hot:
        return cold.select("id", "fp", "component")
    warm = prints.where(F.col("fp").isin(hot)).join(F.broadcast(named.where(F.col("rows") > HOT)), F.col("fp") == F.col("f"))
    return cold.select("id", "fp", "component").unionByName(warm.select("id", "fp", "component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id.

    Of several rows with this id the one with the least hash over all columns stays, once if it is repeated.
    """
    like, key = common.row_hash(docs), F.col(f"`{id_col}`")
    groups = near_duplicates(docs.select(F.struct(key.alias("i"), like.alias("like")).alias("key"), F.col(f"`{text_col}`").alias("text")), "key", "text")
    rows = groups.groupBy("id", "component").agg(F.count(F.lit(1)).alias("n"))
    rows = common.materialise(rows.withColumn("goes", ~F.col("id").eqNullSafe(F.col("component"))).select("id.i", "id.like", "n", "goes"), "rows")
    on = {"i": key, "like": like}
    kept = common.without(docs, rows.where("goes"), on)
    again = rows.where("not goes and n > 1")
    if not again.limit(1).count():
        return kept
    # rows that repeat as a whole: one of each
    packed = kept.select(F.struct("*").alias("row"), key.alias("i"), like.alias("like"))
    once = packed.join(again.select(F.col("i").alias("ai"), F.col("like").alias("al")), F.expr("i <=> ai and like = al"), "left_semi")
    once = once.withColumn("nth", F.row_number().over(Window.partitionBy("i", "like").orderBy("like"))).where("nth = 1").select("row.*")
    return common.without(kept, again, on).unionByName(once)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
