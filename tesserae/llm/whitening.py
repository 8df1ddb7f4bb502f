"""Whitening of embeddings by hierarchical SVD merging."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

#: Summaries that one merge takes.
FAN_IN = 8
#: Rows that a leaf gathers before it takes their SVD, at least; four times the dimensions if that is more.
LEAF_ROWS = 2048

SUMMARY = "d int, node long, n long, sums array<decimal(38,0)>, singular array<double>, vectors array<double>"
MODEL = "d int, n long, sums array<decimal(38,0)>, mean array<double>, components array<array<double>>, variances array<double>, trace double"


class Summary:
    """n rows: their exact sums, and singular values and right vectors of what is left once their mean is taken away."""

    def __init__(self, n: int, sums: list[int], singular: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.singular, self.vectors = n, sums, singular, vectors

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of integer rows. All singular values stay: as many as the dimensions, or the rows if they are fewer."""
        n = len(x)
        wide = int(np.abs(x).max(initial=0)) > (1 << 62) // n
        sums = [int(s) for s in (x.astype(object) if wide else x).sum(axis=0)]
        centred = x - np.array([s / n for s in sums])
        return cls(n, sums, *np.linalg.svd(centred, full_matrices=False)[1:])

    def merge(self, other: Summary) -> Summary:
        """Both row sets as one: the weighted vectors of both above each other, a row for the shift between the means, and an SVD of that.

        The stacked rows have the scatter matrix of the union about its own mean, so nothing is lost but rounding.
        """
        shift = np.sqrt(self.n * other.n / (self.n + other.n)) * (self.mean - other.mean)
        stacked = np.vstack([self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, shift[None, :]])
        _, singular, vectors = np.linalg.svd(stacked, full_matrices=False)
        return Summary(self.n + other.n, [a + b for a, b in zip(self.sums, other.sums)], singular, vectors)

    def row(self, node: int) -> dict:
        return {"d": len(self.sums), "node": node, "n": self.n, "sums": [Decimal(s) for s in self.sums], "singular": self.singular.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def read(cls, r) -> Summary:
        return cls(int(r.n), [int(s) for s in r.sums], np.asarray(r.singular, float), np.asarray(r.vectors, float).reshape(-1, r.d))


def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary for each vector length of a partition; at most LEAF_ROWS (or four times the length) rows of a length are held."""
    from pyspark import TaskContext

    held: dict[int, list[np.ndarray]] = {}
    done: dict[int, Summary] = {}

    def settle(d: int) -> None:
        if rows := held.pop(d, None):
            part = Summary.of(np.concatenate(rows))
            done[d] = done[d].merge(part) if d in done else part

    for batch in batches:
        x = batch.column("x")
        lengths, flat = np.diff(x.offsets.to_numpy()), x.flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
        for d in np.unique(lengths):
            at, step = starts[lengths == d], max(LEAF_ROWS, 4 * int(d))
            for k in range(0, len(at), step):
                held.setdefault(int(d), []).append(flat[at[k : k + step, None] + np.arange(d)])
                if sum(map(len, held[int(d)])) >= step:
                    settle(int(d))
    for d in list(held):
        settle(d)
    node = TaskContext.get().partitionId()
    for s in done.values():
        yield pa.RecordBatch.from_pylist([s.row(node)], schema=ARROW_SUMMARY)


ARROW_SUMMARY = pa.schema(
    [("d", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("singular", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))]
)


def merged(group: pd.DataFrame) -> pd.DataFrame:
    """One summary of at most FAN_IN, in the order of their nodes."""
    group = group.sort_values("node")
    parts = [Summary.read(r) for r in group.itertuples()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p)
    return pd.DataFrame([whole.row(int(group.node.iloc[0]) // FAN_IN)])


def model(components: int):
    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                s = Summary.read(r)
                variances = s.singular**2 / s.n
                least = s.singular.max(initial=0) * max(s.vectors.shape) * np.finfo(float).eps
                top = np.zeros((min(components, r.d), r.d))
                e = np.zeros(len(top))
                some = min(len(top), len(s.singular))
                top[:some], e[:some] = s.vectors[:some], np.where(s.singular[:some] > least, variances[:some], 0.0)
                out.append({"d": r.d, "n": s.n, "sums": list(r.sums), "mean": s.mean.tolist(), "components": top.tolist(), "variances": e.tolist(), "trace": float(variances.sum())})
            if out:
                yield pd.DataFrame(out)

    return finish


def fit(vectors: DataFrame, components: int) -> DataFrame:
    """The whitening model (MODEL) of each length among vectors (x: array<long>, no nulls), one row a length.

    Each partition makes one summary; rounds of merges of FAN_IN follow until one is left, so a task holds FAN_IN + 1 squares of the dimensions.
    """
    found = common.materialise(vectors.mapInArrow(leaves, SUMMARY), "svd-leaves")
    last = found.agg(F.max("node")).first()[0] or 0
    while True:
        found = found.groupBy("d", F.floor(F.col("node") / FAN_IN).alias("up")).applyInPandas(merged, SUMMARY)
        last //= FAN_IN
        if not last:
            return found.mapInPandas(model(components), MODEL)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * entry) of each entry as a long; null if the vector or an entry is null or an entry is not finite."""
    whole = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), F.lit(False)))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))))


def project(x: str) -> Column:
    """The whitened coordinates of a vector by the model in the same row; null along a direction without variance."""
    at = f"aggregate(zip_with(zip_with({x}, mean, (a, m) -> a - m), c, (a, b) -> a * b), 0D, (s, y) -> s + y)"
    return F.expr(f"zip_with(transform(components, c -> {at}), variances, (y, e) -> if(e > 0, y / sqrt(e), null))")


def deviation(x: str) -> Column:
    """sum((n x - S)^2), exactly, as n^2 sum(x^2) - 2 n sum(x S) + sum(S^2); null if it does not fit in a long."""
    dot = "aggregate(zip_with({}, {}, (a, b) -> try_multiply(a, b)), {}, (s, y) -> try_add(s, y))"
    squares = "cast(" + dot.format(x, x, "0L") + " as decimal(38,0))"
    cross = "cast(" + dot.format(x, "long_sums", "0L") + " as decimal(38,0))"
    n = "cast(n as decimal(38,0))"
    return F.expr(f"try_cast(try_add(try_subtract(try_multiply({n}, try_multiply({n}, {squares})), try_multiply(2 * {n}, {cross})), sums_squared) as bigint)")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """<id_col>, x (the quantised vector), n, deviation, whitened (array), explained (array), identity_error, one row for each row kept.

    Rows whose vector is null, or has an entry that is null or not finite, are left out. The model is fitted on each different x once,
    so copies don't count; vectors of each length are a space of their own, with their own fit. There are `components` of them, or as many
    as dimensions. A direction without variance (one vector, or all on a plane) has explained 0 (null if nothing varies at all) and null
    coordinates, and is no part of identity_error. Entries are limited to what a long holds once scaled. A null id is kept, repeated
    rows are kept, an empty table or one of empty vectors gives no coordinates. Other columns are not looked at.
    """
    x = quantised(F.col(f"`{vector_col}`"), scale)
    kept = rows.select(F.col(f"`{id_col}`").alias("id"), x.alias("x")).where(F.col("x").isNotNull())
    different = common.materialise(kept.where(F.size("x") > 0).select("x").distinct(), "vectors")
    fitted = common.materialise(fit(different, components), "whitening")
    ready = fitted.select(
        "*",
        F.expr("transform(sums, s -> try_cast(s as bigint))").alias("long_sums"),
        F.expr("aggregate(sums, cast(0 as decimal(38,0)), (t, s) -> try_add(t, try_multiply(s, s)))").cast("decimal(38,0)").alias("sums_squared"),
    )
    # one row a length, of six times the length: Spark broadcasts it by its size
    w = different.select(F.size("x").alias("size"), "x").join(fitted, F.col("size") == F.col("d")).select("d", project("x").alias("w"))
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    off = [F.abs(F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))) - (1.0 if i == j else 0.0)) for i, j in pairs]
    errors = w.groupBy(F.col("d").alias("of")).agg(F.greatest(*off, F.lit(None)).alias("identity_error"))
    full = common.materialise(ready.join(errors, F.col("d") == F.col("of")).drop("of"), "whitening-checked")
    out = kept.withColumn("size", F.size("x")).join(full, F.col("size") == F.col("d"))
    explained = F.expr("transform(variances, e -> if(trace > 0, e / trace, null))")
    return out.select(F.col("id").alias(id_col), "x", "n", deviation("x").alias("deviation"), project("x").alias("whitened"), explained.alias("explained"), "identity_error")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings, whitened: a row for each vector and component up to 4."""
    done = whiten(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = done.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
