"""Graph operators: tracks along one-to-one matches, fix-point expansion, operation identities."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.lineage import discard, materialise
from tesserae.functions.sizing import dealt, joined, partitions


def tracks(matches: DataFrame) -> DataFrame:
    """matches: frame_a, a, frame_b, b, one to one, to later frames. (frame, id, root_frame, root): each observation with its track's first one.

    Pointer doubling: in each round an observation takes over its root's root; rounds end when none changes, after the log of the longest
    track. Each round is written, as it reads the last one twice.
    """
    nodes = matches.select(F.col("frame_a").alias("frame"), F.col("a").alias("id")).union(matches.select("frame_b", "b")).distinct()
    back = matches.select(F.col("frame_b").alias("f"), F.col("b").alias("i"), F.col("frame_a").alias("pf"), F.col("a").alias("pi"))
    now = nodes.join(back, (F.col("frame") == F.col("f")) & (F.col("id") == F.col("i")), "left").select("frame", "id", F.coalesce("pf", "frame").alias("root_frame"), F.coalesce("pi", "id").alias("root"))
    now = materialise(now, "tracks")
    while True:
        up = now.select(F.col("frame").alias("f"), F.col("id").alias("i"), F.col("root_frame").alias("rf"), F.col("root").alias("r"))
        moved = ~((F.col("rf") == F.col("root_frame")) & (F.col("r") == F.col("root")))
        met = now.join(up, (F.col("root_frame") == F.col("f")) & (F.col("root") == F.col("i"))).select("frame", "id", F.col("rf").alias("root_frame"), F.col("r").alias("root"), moved.alias("moved"))
        old, now = now, materialise(met, "tracks")
        discard(old)
        if now.where("moved").isEmpty():
            return now.drop("moved")


def track_stats(observations: DataFrame) -> DataFrame:
    """Length and span of each track."""
    return observations.groupBy("root_frame", "root").agg(F.count(F.lit(1)).alias("length"), (F.max("frame") - F.min("frame")).cast("long").alias("span"))


def expand(start: DataFrame, links: DataFrame, least: int, rounds: int | None = None) -> DataFrame:
    """Fix point: nodes join the set once they have `least` links to it. start: node; links: a, b (undirected). Ends when a round adds no node, or after `rounds` rounds."""
    n = partitions(links)
    both = materialise(dealt(links.select("a", "b").union(links.select("b", "a")), n, "a", "b").distinct(), "links")
    reached = start.select("node").distinct().withColumn("round", F.lit(0))
    for k in itertools.count(1) if rounds is None else range(1, rounds + 1):
        known = reached.select(F.col("node").alias("k"))
        ends = joined(both, known, n if partitions(known) else 0, "b", "k", "left_semi")  # a small set goes to every task instead
        met = dealt(ends.select("a"), n, "a").groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        new = met.select(F.col("a").alias("node")).join(reached, "node", "left_anti").withColumn("round", F.lit(k))
        new = materialise(new, "reached")
        if new.isEmpty():
            break
        reached = materialise(reached.unionByName(new), "reached")
    return reached


#: Links that are contracted together in a task.
AT_ONCE = 1 << 18


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (v, u) as links of each node to the least one that those at hand reach, AT_ONCE of them or a batch at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= AT_ONCE:
            yield star(held)
            held, n = [], 0
    if n:
        yield star(held)


def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    links = pa.Table.from_batches(held)
    ids, at = np.unique(np.concatenate([links.column(c).to_numpy() for c in "vu"]), return_inverse=True)
    v, u = at.reshape(2, -1)
    root = np.arange(len(ids))
    while (root[v] != root[u]).any():
        low = np.minimum(root[v], root[u])
        for end in (v, u):
            np.minimum.at(root, root[end], low)
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[far], links.schema.field("v").type), pa.array(ids[root[far]], links.schema.field("u").type)], ["v", "u"])


def clusters(links: DataFrame) -> DataFrame:
    """links: a, b. (node, root) for every node that has a link: root is the least node that links reach.

    Links that meet in a task are contracted there, so those dealt by something that they share, and few ones, are done at once; the rest goes in rounds.
    Each round a node goes under the least of its neighbours below it, trees are flattened by pointer doubling, and links are carried over to the trees'
    roots, where most of them fall away; rounds end when no link is left. Minima by node are combined before they are shuffled, so a hub costs its links.
    """
    ends = lambda df, a, b: df.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
    contracted = lambda df: df.mapInArrow(stars, df.schema)
    left = ends(links, "a", "b")
    left = materialise(contracted(contracted(left).distinct()), "links")
    nodes = materialise(left.select(F.col("v").alias("node")).union(left.select("u")).distinct(), "nodes")
    levels = []
    while not left.isEmpty():
        now = materialise(left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")), "roots")
        while True:
            up = now.select(F.col("node").alias("n"), F.col("root").alias("far"))
            step = materialise(now.join(up, F.expr("root = n"), "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
            discard(now)
            now = step.drop("moved")
            now._tesserae_path = step._tesserae_path
            if step.where("moved").isEmpty():
                break
        levels.append(now)
        carried = left
        for c in "uv":
            carried = carried.join(now.select(F.col("node").alias("n"), F.col("root").alias(f"r{c}")), F.expr(f"{c} = n"), "left").drop("n").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
        old, left = left, materialise(contracted(ends(carried, "ru", "rv").distinct()), "links")
        discard(old)
    out = nodes.select("node", F.col("node").alias("root"))
    for now in levels:
        out = out.join(now.select(F.col("node").alias("n"), F.col("root").alias("r")), F.expr("root = n"), "left").select("node", F.coalesce("r", "root").alias("root"))
    return out


def ancestry(nodes: DataFrame) -> DataFrame:
    """nodes: node, parent (null for roots). (node, root, depth) by pointer doubling until none moves; a parent that is missing ends a path there.

    Parents in a circle have no root: ValueError, once a path is longer than there are nodes.
    """
    known = nodes.select(F.col("node").alias("k"))
    up = nodes.join(known, F.col("parent") == F.col("k"), "left").select("node", F.coalesce("k", "node").alias("root"), F.col("k").isNotNull().cast("long").alias("depth"))
    up = materialise(up, "ancestry")
    most = up.count()
    while True:
        nxt = up.select(F.col("node").alias("n"), F.col("root").alias("r"), F.col("depth").alias("d"))
        met = up.join(nxt, F.col("root") == F.col("n")).select("node", F.col("r").alias("root"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("r") != F.col("root")).alias("moved"))
        old, up = up, materialise(met, "ancestry")
        discard(old)
        if up.where("moved").isEmpty() and up.where(F.col("depth") > most).isEmpty():
            return up.drop("moved")
        if not up.where(F.col("depth") > most).isEmpty():
            raise ValueError("parents in a circle")


def identity(kind: str, parameters: str, inputs: list[str]) -> str:
    """Content identity of an operation: SHA-256 over its fields, separated by zero bytes."""
    return hashlib.sha256(b"\0".join(x.encode() for x in [kind, parameters, *inputs])).hexdigest()


def identities(operations: dict[str, tuple[str, str, list[str]]]) -> dict[str, str]:
    """operations: name -> (kind, parameters, names of its inputs). Identities in dependency order; an unknown or circular input raises."""
    out: dict[str, str] = {}
    left = dict(operations)
    while left:
        ready = [n for n, (_, _, ins) in left.items() if all(i in out for i in ins)]
        if not ready:
            raise ValueError(f"unknown or circular inputs: {sorted(left)}")
        for n in ready:
            kind, parameters, ins = left.pop(n)
            out[n] = identity(kind, parameters, [out[i] for i in ins])
    return out
