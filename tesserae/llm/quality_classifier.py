"""Quality classifier learnt from trusted positives and unlabelled texts by the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

#: Units of the one hidden layer.
HIDDEN = 16
ROUNDS, RATE = 60, 0.1
#: About so many trusted positives are used at most, chosen by hash of the id. Unlabelled texts are all used.
POSITIVES = 200_000
#: Bins of the score for the class prior.
BINS = 200
FEATURES = 20
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def features(text: str | None) -> np.ndarray:
    """What a text's writing looks like: shares of kinds of bytes, word lengths, and how far words, pairs and lines repeat."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, size = len(words), max(1.0, float(len(raw)))
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    folded = [w.lower() for w in words]
    windows = sum(len(set(folded[i : i + 100])) / min(100, n) ** 0.5 for i in range(0, n, 100)) / max(1.0, sum(min(100, n - i) / min(100, n) ** 0.5 for i in range(0, n, 100)))
    punctuation = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    return np.array(
        [
            np.log1p(n),
            lengths.mean() if n else 0.0,
            lengths.std() if n else 0.0,
            np.log1p(lengths.max()),
            counts[SYMBOLS].sum() / size,
            np.sqrt(counts[SYMBOLS].sum() / size),
            punctuation / size,
            counts[65:91].sum() / size,
            counts[48:58].sum() / size,
            counts[33] / size,
            counts[44] / size,
            counts[46] / size,
            counts[128:].sum() / size,
            len(set(folded)) / max(1, n),
            windows,
            len(set(zip(folded, folded[1:]))) / max(1, n - 1),
            len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))),
            max(map(len, lines), default=0) / size,
            float(n == 0),
        ],
        np.float32,
    )


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, x): the features of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([features(t) for t in b.column(1).to_pylist()]) if b.num_rows else np.zeros((0, FEATURES), np.float32)
            offsets = np.arange(0, (b.num_rows + 1) * FEATURES, FEATURES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))], ["id", "x"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, x array<float>")


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES).astype(float)


class Net:
    """One hidden layer over standardised features. theta holds all weights in one vector."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, theta: np.ndarray | None = None):
        self.mean, self.scale = mean, scale
        if theta is None:
            rng = np.random.default_rng(11)
            theta = np.concatenate([rng.normal(0, FEATURES**-0.5, FEATURES * HIDDEN), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)])
        self.theta = theta

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        k = FEATURES * HIDDEN
        return self.theta[:k].reshape(FEATURES, HIDDEN), self.theta[k : k + HIDDEN], self.theta[k + HIDDEN : -1], float(self.theta[-1])

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        w, b, v, c = self.parts()
        h = np.tanh(z @ w + b)
        return z, h, h @ v + c

    def gradient(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """Of sum(loss), from the loss's slope at each output."""
        _, _, v, _ = self.parts()
        back = (slope[:, None] * v) * (1 - h**2)
        return np.concatenate([(z.T @ back).ravel(), back.sum(0), slope @ h, [slope.sum()]])


#: Vectors that the driver adds up at last, whatever the number of partitions.
FAN = 8


def sums(table: DataFrame, work) -> np.ndarray:
    """The sum over all partitions of what work(x, kind) returns: a vector of fixed length. Partitions are added in their order, in FAN groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                part = work(matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["p", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, None
        for b in batches:
            for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first, total = (p, np.frombuffer(v).copy()) if total is None else (first, total + np.frombuffer(v))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["p", "v"])

    each = table.select("x", "kind").mapInArrow(run, "p int, v binary")
    found = each.repartition(FAN, F.col("p") % FAN).sortWithinPartitions("p").mapInArrow(add, "p int, v binary").collect()  # FAN vectors of fixed length at most
    return np.sum([np.frombuffer(r["v"]) for r in sorted(found, key=lambda r: r["p"])], axis=0)


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(f / 2))


def descend(net: Net, table: DataFrame, step, rounds: int) -> Net:
    """Full-batch Adam: each round sums the losses and gradients over all rows. step turns the sums into a direction."""
    size = len(net.theta)
    m = v = np.zeros(size)
    for t in range(1, rounds + 1):

        def work(x: np.ndarray, kind: np.ndarray, net: Net = net) -> np.ndarray:
            z, h, f = net.forward(x)
            out = []
            # kind: 0 unlabelled, 1 and 2 trusted positives (2 are kept apart for the prior); losses as class 1 and as class 0
            for rows, sign in ((kind == 1, 1), (kind == 2, 1), (kind == 1, 0), (kind == 2, 0), (kind == 0, 0)):
                g = f[rows]
                out.append(np.concatenate([[rows.sum(), np.logaddexp(0, -g if sign else g).sum()], net.gradient(z[rows], h[rows], sigmoid(g) - sign)]))
            return np.concatenate(out)

        total = sums(table, work).reshape(5, 2 + size)
        g = step(total) + 1e-4 * net.theta
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g**2
        net = Net(net.mean, net.scale, net.theta - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8))
    return net


def class_prior(net: Net, table: DataFrame) -> float:
    """Share of positives among the unlabelled: the least ratio of their tails above a score, with a margin for small tails.

    Above a high score only positives are left, so there the tail of the unlabelled is the prior times the tail of the
    positives. The positives used here took no part in fitting the score.
    """

    def work(x: np.ndarray, kind: np.ndarray) -> np.ndarray:
        at = np.minimum((sigmoid(net.forward(x)[2]) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at[kind == k], minlength=BINS) for k in (0, 2)]).astype(float)

    u, p = sums(table, work).reshape(2, BINS)
    tail_u, tail_p = (np.cumsum(c[::-1]) / max(1.0, c.sum()) for c in (u, p))
    margin = np.sqrt(np.log(40 * BINS) / 2) * (1 / np.sqrt(max(1.0, u.sum())) + 1 / np.sqrt(max(1.0, p.sum())))
    good = tail_p > 0
    bound = (tail_u[good] + margin) / tail_p[good]
    at = int(np.argmin(bound)) if good.any() else 0
    ratio = tail_u[good][at] / tail_p[good][at] if good.any() else 0.5
    return float(np.clip(ratio, 0.02, 0.98))


def risk_direction(total: np.ndarray, prior: float) -> np.ndarray:
    """Where the non-negative risk falls, from the sums of descend(): rows (count, loss, gradient) of both halves of the positives as class 1, the
    same as class 0, and of the unlabelled as class 0. Where the negatives' risk comes out below 0, its own gradient is gone up."""
    n = max(1.0, total[0, 0] + total[1, 0])
    as_one, as_zero, unlabelled = (total[0] + total[1]) / n, (total[2] + total[3]) / n, total[4] / max(1.0, total[4, 0])
    negative = unlabelled - prior * as_zero  # its loss estimates the negatives' risk, which can't be below 0
    return prior * as_one[2:] + negative[2:] if negative[1] >= 0 else -negative[2:]


def fit(table: DataFrame) -> tuple[Net, float]:
    """table: x, kind (0 unlabelled, 1 and 2 trusted positives). Returns the net and the estimated class prior."""
    moments = sums(table, lambda x, kind: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]))
    if not np.ndim(moments) or not moments[0]:
        return Net(np.zeros(FEATURES), np.ones(FEATURES)), 0.5
    mean = moments[1 : 1 + FEATURES] / moments[0]
    scale = np.sqrt(np.maximum(moments[1 + FEATURES :] / moments[0] - mean**2, 1e-8))
    size = len(Net(mean, scale).theta)

    def against(total: np.ndarray) -> np.ndarray:  # positives against unlabelled, both as heavy
        return total[0, 2:] / max(1.0, total[0, 0]) + total[4, 2:] / max(1.0, total[4, 0])

    prior = class_prior(descend(Net(mean, scale), table, against, ROUNDS // 2), table)

    assert size == len(against(np.zeros((5, 2 + size))))
    return descend(Net(mean, scale), table, lambda total: risk_direction(total, prior), ROUNDS), prior


def scores(featured: DataFrame, net: Net) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(net.forward(matrix(b.column(1)))[2]))], ["id", "score"])

    kind = dict(featured.dtypes)["id"]
    return featured.select("id", "x").mapInArrow(run, f"id {kind}, score double")


def remainder(c, m: int):
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % m


def classify(docs: DataFrame, labels: DataFrame, may_learn, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Rows (id, score) for all docs. may_learn: column over `id` that tells which rows may be learnt from.

    Positives are rows labelled 1 that may be learnt from; the other rows that may be learnt from are unlabelled text, whatever
    their label. Null texts are empty ones, and are scored too. Null ids are unlabelled. With no positives every score is the
    same side of nothing: the start's. An empty table stays empty.
    """
    featured = common.materialise(with_features(docs, id_col, text_col), "features")
    wanted = labels.where(F.col(label_col) == 1).select(F.col(label_id).alias("l")).where(F.col("l").isNotNull()).distinct()
    share = min(1.0, POSITIVES / max(1, wanted.count()))
    chosen = wanted.where(F.pmod(F.xxhash64("l"), F.lit(1 << 30)) < int(share * (1 << 30)))
    marked = featured.where(may_learn).join(chosen, F.col("id") == F.col("l"), "left")
    kind = F.when(F.col("l").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.lit(9), "l"), F.lit(2)).cast("int")).cast("int")
    table = common.materialise(marked.select("x", kind.alias("kind")), "learn")
    net, _ = fit(table)
    return scores(featured, net)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their score; rows of remainder 1 are held out, texts and labels."""
    found = classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), remainder(F.col("id"), 3) != 1)
    return found.select(F.col("id").alias("doc_id"), (remainder(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
