"""Spatial joins: hashed neighbourhoods, occlusion cells, ranges, run-length masks, box merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.lineage import materialise
from tesserae.functions.sizing import dealt, partitions
from tesserae.operators import graph
from tesserae.operators.windows import runs


def neighbours(points: DataFrame, radius: float, axes: tuple = ("x", "y", "z"), group: str | None = "grp") -> DataFrame:
    """points: id, axes, group. Pairs a < b of different groups within radius, with their distance, by cells of that size.

    One side is dealt to its own cell, the other to all adjacent ones, so each pair meets exactly once and no other cell is read.
    """
    cell = [F.floor(F.col(c) / radius).cast("long") for c in axes]
    a = points.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}a") for c in axes], *([F.col(group).alias("ga")] if group else []), *[k.alias(f"k{i}") for i, k in enumerate(cell)])
    for i in range(len(axes)):
        a = a.withColumn(f"o{i}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"k{i}", F.col(f"k{i}") + F.col(f"o{i}")).drop(f"o{i}")
    b = points.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}b") for c in axes], *([F.col(group).alias("gb")] if group else []), *[k.alias(f"l{i}") for i, k in enumerate(cell)])
    on = F.col("a") < F.col("b")
    for i in range(len(axes)):
        on = on & (F.col(f"k{i}") == F.col(f"l{i}"))
    met = a.join(b, on & (F.col("ga") != F.col("gb")) if group else on)
    distance = F.round(F.sqrt(sum((F.col(f"{c}a") - F.col(f"{c}b")) ** 2 for c in axes)), 9)
    return met.withColumn("distance", distance).where(F.col("distance") <= radius).select("a", "b", "distance")


#: Finest level of nearest(): cells of the radius / 2 ** DEEPEST; a point begins at the coarsest level at which its cell has CROWD points at most.
DEEPEST, CROWD = 10, 8


def sites(points: DataFrame, axes: tuple = ("x", "y", "z"), group: str = "grp") -> DataFrame:
    """One row for all points of one group at one place, with the least id; points without a group or a place are left out, as nothing is near them."""
    placed = points.where(F.col(group).isNotNull())
    for c in axes:
        placed = placed.where(F.abs(c) < float("inf"))
    return placed.groupBy(group, *axes).agg(F.min("id").alias("id"))


def key(c, side) -> Column:
    return F.floor(F.least(F.greatest(F.col(c) / side, F.lit(-1e18)), F.lit(1e18)))


def nearest(at: DataFrame, radius: float, axes: tuple = ("x", "y", "z"), group: str = "grp") -> DataFrame:
    """(a, b, distance): for each of the sites its nearest one of another group within radius, the lower id of equals. Distances are rounded to nine places.

    A site asks the cells around its own, at a level at which they hold few, and at coarser ones until what it finds is nearer than a cell's side; so it meets
    some tens of others however many lie within the radius. Of the groups at one place only the two least ids can be anyone's nearest.
    """
    side = lambda k: radius * (1 + 1e-6) / 2.0**k
    tasks = max(partitions(at), 1)  # each core has a share of few sites too
    at = materialise(dealt(at.select("id", group, *axes), tasks, "id"), "sites")
    names = [f"k{i}" for i in range(len(axes))]
    cell = lambda k: [key(c, side(k)).alias(n) for c, n in zip(axes, names)]
    held = Window.partitionBy(*axes).orderBy("id")
    others = at.withColumn("rank", F.row_number().over(held)).where("rank <= 2").select(F.col("id").alias("b"), F.col(group).alias("gb"), *[F.col(c).alias(f"{c}b") for c in axes])
    others = materialise(others, "candidates")
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *cell(k)) for k in range(DEEPEST + 1)])).alias("s")
    each = at.select("id", levels).select("id", "s.*")
    full = each.groupBy("level", *names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).drop("n")
    begin = each.join(full, ["level", *names], "left_semi").groupBy("id").agg(F.least(F.max("level") + 1, F.lit(DEEPEST)).alias("start"))
    asking = materialise(dealt(at.join(begin, "id", "left").withColumn("start", F.coalesce("start", F.lit(0))), tasks, "id"), "asking")
    starts = sorted((r.start for r in asking.select("start").distinct().collect()), reverse=True)  # DEEPEST + 1 at most
    out, left = None, None
    for k in range(starts[0] if starts else -1, -1, -1):
        now = asking.where(F.col("start") == k)
        now = now if left is None else now.unionByName(left)
        a = now.select(F.col("id").alias("a"), F.col(group).alias("ga"), *[F.col(c).alias(f"{c}a") for c in axes], *cell(k))
        for n in names:
            a = a.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
        b = others.select("b", "gb", *[f"{c}b" for c in axes], *[key(f"{c}b", side(k)).alias(n) for c, n in zip(axes, names)])
        distance = F.round(F.sqrt(sum((F.col(f"{c}a") - F.col(f"{c}b")) ** 2 for c in axes)), 9)
        met = a.join(b, names).where("ga <> gb").select("a", "b", distance.alias("distance")).where(F.col("distance") <= radius)
        best = met.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m")).select("a", "m.b", "m.distance")
        found = materialise(best if k == 0 else best.where(F.col("distance") < side(k) - 1e-9), "nearest")
        out = found if out is None else out.unionByName(found)
        if k:
            left = materialise(dealt(now.join(found, F.expr("id = a"), "left_anti"), tasks, "id"), "asking")
    return out if out is not None else at.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance")).limit(0)


def linked(at: DataFrame, radius: float, axes: tuple = ("x", "y", "z"), group: str = "grp") -> DataFrame:
    """(a, b): links between sites of different groups within radius that join what all of them join, and reach all sites that have one.

    Each site has the link to its nearest. A cell of half the radius with several groups is joined in itself, so its sites are linked to the least one. What the links
    join then is compared: whatever is still apart has a side outside the largest set, so only those sites meet all that is near them.
    """
    at = materialise(dealt(at.select("id", group, *axes), max(partitions(at), 1), "id"), "sites")
    close = nearest(at, radius, axes, group).select("a", "b")
    names = [f"k{i}" for i in range(len(axes))]
    celled = at.select("id", group, *[key(c, radius / 2).alias(n) for c, n in zip(axes, names)])
    mixed = celled.groupBy(*names).agg(F.min("id").alias("least"), (F.min(group) < F.max(group)).alias("mixed")).where("mixed")
    stars = celled.join(mixed, names).where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    some = materialise(close.unionByName(stars), "links")
    roots = materialise(graph.clusters(some), "roots")
    largest = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("root", F.struct("n", "root")).alias("root")).first().root
    if largest is None:
        return some
    known = at.join(roots, F.expr("id = node"))
    rest = known.where(F.col("root") != largest)
    side, reach = radius * (1 + 1e-6), F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = rest.select(F.col("id").alias("a"), F.col(group).alias("ga"), F.col("root").alias("ra"), *[F.col(c).alias(f"{c}a") for c in axes], *[key(c, side).alias(n) for c, n in zip(axes, names)])
    for n in names:
        a = a.withColumn("o", F.explode(reach)).withColumn(n, F.col(n) + F.col("o")).drop("o")
    b = known.select(F.col("id").alias("b"), F.col(group).alias("gb"), F.col("root").alias("rb"), *[F.col(c).alias(f"{c}b") for c in axes], *[key(c, side).alias(n) for c, n in zip(axes, names)])
    distance = F.round(F.sqrt(sum((F.col(f"{c}a") - F.col(f"{c}b")) ** 2 for c in axes)), 9)
    across = a.join(b, names).where("ra <> rb and ga <> gb").where(distance <= radius).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    return some.unionByName(across)


def mutual(best: DataFrame) -> DataFrame:
    """Undirected pairs (a, b, distance) of rows (a, b, distance) that name each other."""
    back = best.select(F.col("a").alias("c"), F.col("b").alias("d"))
    return best.join(back, (F.col("b") == F.col("c")) & (F.col("a") == F.col("d"))).where("a < b").select("a", "b", "distance")


def visible(points: DataFrame, cell: list[Column], depth: str, slack: float) -> DataFrame:
    """Occlusion: a point is visible if it is within `slack` of the least depth in its cell."""
    keyed = points.select("*", *[c.alias(f"_c{i}") for i, c in enumerate(cell)])
    names = [f"_c{i}" for i in range(len(cell))]
    front = keyed.groupBy(*names).agg(F.min(depth).alias("_front"))
    return keyed.join(front, names).withColumn("visible", F.col(depth) <= F.col("_front") * (1 + slack)).drop(*names, "_front")


def locate(points: DataFrame, position: str, ranges: DataFrame, block: int) -> DataFrame:
    """Range lookup: the range [start, start + count) that holds a position, by blocks of positions, so it is an equi-join. Others are lost."""
    cut = ranges.where("count > 0").withColumn("_k", F.explode(F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("count") - 1) / block).cast("long"))))
    keyed = points.withColumn("_b", F.floor(F.col(position) / block).cast("long"))
    return keyed.join(cut, (F.col("_b") == F.col("_k")) & (F.col(position) >= F.col("start")) & (F.col(position) < F.col("start") + F.col("count"))).drop("_k", "_b")


def mask_runs(counts: Column) -> Column:
    """Runs of a run-length mask that begins with background: array of (from, to), ends exclusive, of the foreground."""
    ends = F.transform(counts, lambda c, i: F.aggregate(F.slice(counts, 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x))
    return F.filter(F.transform(counts, lambda c, i: F.struct((F.get(ends, i) - c).alias("from"), F.get(ends, i).alias("to"), (i % 2 == 1).alias("on"))), lambda r: r["on"] & (r["to"] > r["from"]))


def mask_area(counts: Column) -> Column:
    return F.aggregate(F.transform(counts, lambda c, i: F.when(i % 2 == 1, c).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def inside(position: Column, runs_: Column) -> Column:
    return F.exists(runs_, lambda r: (position >= r["from"]) & (position < r["to"]))


def boxes(cells: DataFrame, by: list) -> DataFrame:
    """Occupied cells (by, x, y) merged to boxes: runs along x, then equal runs on consecutive y."""
    rows = runs(cells.select(*by, "y", "x").distinct(), [*by, "y"], F.col("x"))
    flat = rows.select(*by, F.col("start").alias("x0"), F.col("end").alias("x1"), "y")
    out = runs(flat, [*by, "x0", "x1"], F.col("y"))
    return out.select(*by, "x0", "x1", F.col("start").alias("y0"), F.col("end").alias("y1"))


#: Shares that a cell's blocks are dealt to, and rectangles of a block: at most, and at least where a cell has several.
SHARES, BLOCK, FEW = 4, 8192, 64
#: Rectangles that meet a block at once, and pairs that leave a task together.
AT_ONCE, PAIRS = 128, 1 << 17


def block(column: pa.ListArray, k: int) -> dict[str, np.ndarray]:
    rows = column[k].values
    return {f.name: rows.field(f.name).to_numpy(zero_copy_only=False) for f in rows.type}


def met(a: dict[str, np.ndarray], b: dict[str, np.ndarray], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of a, how many of b each overlaps, their ids) of two blocks of a cell. Rows are sorted by y0, so a few rows of a meet a stretch of b only."""
    a = {c: v[order] for order in [np.lexsort((a["x0"], a["y0"]))] for c, v in a.items()}
    b = {c: v[order] for order in [np.argsort(b["y0"], kind="stable")] for c, v in b.items()}
    reach = np.maximum.accumulate(b["y1"])
    for k in range(0, len(a["id"]), AT_ONCE):
        some = {c: v[k : k + AT_ONCE] for c, v in a.items()}
        near = slice(np.searchsorted(reach, some["y0"].min()), np.searchsorted(b["y0"], some["y1"].max(), "right"))
        beside = (b["x0"][near] <= some["x1"].max()) & (b["x1"][near] >= some["x0"].min())
        others = {c: v[near][beside] for c, v in b.items()}
        some = {c: v[:, None] for c, v in some.items()}
        hit = some["x0"] <= others["x1"]
        for axis in "xy":
            if axis == "y":
                hit &= some["y0"] <= others["y1"]
            hit &= others[f"{axis}0"] <= some[f"{axis}1"]
            if not some[f"{axis}_here"].all():
                hit &= some[f"{axis}_here"] | others[f"{axis}_here"]
        if same:
            hit &= some["id"] < others["id"]
        yield some["id"][:, 0], np.count_nonzero(hit, axis=1), np.broadcast_to(others["id"], hit.shape)[hit]


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """left, right (blocks), same (they are one): the pairs of a rectangle of the left and one of the right that overlap, the lower id first."""
    held, n = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            for ids, counts, others in met(block(batch.column("left"), k), block(batch.column("right"), k), batch.column("same")[k].as_py()):
                mine = np.repeat(ids, counts)
                held.append((np.minimum(mine, others), np.maximum(mine, others)))
                n += len(others)
                if n >= PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["a", "b"])
                    held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["a", "b"])


def overlapping(rectangles: DataFrame, size: float) -> DataFrame:
    """rectangles: id (long), x0, x1, y0, y1. Pairs a < b that overlap, each once.

    They are dealt to the cells they touch; a pair is taken in the cell of the lower left corner of what they share, so it needs no distinct. A cell's
    rectangles are blocks by a hash of their id, and two blocks meet in a task; a full cell is that of several tasks, which hold two blocks and some pairs each.
    """
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    touched = rectangles.select("id", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")]).where("id is not null")
    for axis in "xy":  # where a rectangle begins beyond a cell, which only one of negative extent does, no corner of a pair is there
        touched = touched.withColumn(f"c{axis}", F.explode(F.sequence(cell(f"{axis}0"), cell(f"{axis}1")))).where(cell(f"{axis}0") <= F.col(f"c{axis}"))
        touched = touched.withColumn(f"{axis}_here", cell(f"{axis}0") == F.col(f"c{axis}"))
    n = max(partitions(rectangles), int(rectangles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.lit(SHARES), F.ceil(F.col("n") / FEW)))
    sizes = touched.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).select("cx", "cy", number.cast("int").alias("number"))
    blocks = touched.join(sizes, ["cx", "cy"]).withColumn("block", F.pmod(F.hash("id"), F.col("number")))
    blocks = materialise(blocks.groupBy("cx", "cy", "block").agg(F.collect_list(F.struct("id", "x0", "x1", "y0", "y1", "x_here", "y_here")).alias("rows")), "blocks")
    side = lambda c, share: dealt(blocks.select("cx", "cy", F.col("block").alias(f"block_{c}"), F.col("rows").alias(c), share.alias("share")), n, "cx", "cy", "share")
    left, right = side("left", F.col("block") % SHARES), side("right", F.explode(F.array(*map(F.lit, range(SHARES)))))
    both = left.hint("merge").join(right, ["cx", "cy", "share"]).where("block_left <= block_right").select("left", "right", F.expr("block_left = block_right").alias("same"))
    return both.mapInArrow(meetings, "a long, b long")


def complete(cells: DataFrame, least: int = 3, spread: float = 0.06, passes: int = 2) -> DataFrame:
    """cells: x, y, v. Empty cells with `least` or more of their eight neighbours whose values agree within the spread get their mean; pass 0 are the given ones."""
    now = cells.select("x", "y", "v", F.lit(0).alias("pass"))
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    for k in range(1, passes + 1):
        near = now.withColumn("s", shifts).select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "v")
        empty = near.join(now.select("x", "y"), ["x", "y"], "left_anti").groupBy("x", "y")
        found = empty.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("v"))
        kept = found.where((F.col("n") >= least) & (F.col("hi") - F.col("lo") <= spread * F.col("hi")))
        now = now.unionByName(kept.select("x", "y", "v", F.lit(k).alias("pass")))
    return now
