"""Image kernels: one frame is one row, and a kernel sees one frame at a time as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def luma(rgba: bytes, width: int, height: int) -> np.ndarray:
    """Integer luma: (77 r + 150 g + 29 b) >> 8."""
    p = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).astype(np.int32)
    return (p[..., 0] * 77 + p[..., 1] * 150 + p[..., 2] * 29) >> 8


def gradients(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences of the interior."""
    return y[1:-1, 2:] - y[1:-1, :-2], y[2:, 1:-1] - y[:-2, 1:-1]


def box3(a: np.ndarray) -> np.ndarray:
    """Sums over 3 x 3 neighbourhoods of the interior."""
    rows = a[:-2] + a[1:-1] + a[2:]
    return rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]


def harris(y: np.ndarray) -> np.ndarray:
    """det - 0.04 trace ** 2 of the summed gradient products, in 32-bit floats; two pixels smaller on each side."""
    gx, gy = gradients(y)
    sxx, syy, sxy = (box3(v).astype(np.float32) for v in (gx * gx, gy * gy, gx * gy))
    trace = sxx + syy
    return sxx * syy - sxy * sxy - np.float32(0.04) * trace * trace


def spread_out(x: np.ndarray, y: np.ndarray, distance: float, cap: int) -> np.ndarray:
    """Greedy choice in the given order: what is closer than `distance` to a chosen one is passed over. Places of the chosen.

    Chosen ones mark their neighbourhood in a grid of pixels, so a candidate is one look-up.
    """
    r = int(np.ceil(distance))
    taken = np.zeros((int(y.max(initial=0)) + 2 * r + 1, int(x.max(initial=0)) + 2 * r + 1), bool)
    dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
    disc = dx * dx + dy * dy < distance * distance
    chosen = []
    for k in range(len(x)):
        if taken[y[k] + r, x[k] + r]:
            continue
        chosen.append(k)
        if len(chosen) >= cap:
            break
        taken[y[k] : y[k] + 2 * r + 1, x[k] : x[k] + 2 * r + 1] |= disc
    return np.array(chosen, int)


def features_of(y: np.ndarray, cap: int = 320, distance: float = 7, radius: int = 3, least: float = 1e6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, score and mean-centred patch of the strongest corners, ties in scan order."""
    border = max(radius, 3) + 2
    score = harris(y)
    inner = score[border - 2 : score.shape[0] - border + 2, border - 2 : score.shape[1] - border + 2]
    py, px = np.nonzero(inner > np.float32(least))
    order = np.argsort(-inner[py, px], kind="stable")
    px, py, s = px[order] + border, py[order] + border, inner[py, px][order]
    keep = spread_out(px, py, distance, cap)
    px, py, s = px[keep], py[keep], s[keep]
    d = np.arange(-radius, radius + 1)
    patches = y[py[:, None, None] + d[None, :, None], px[:, None, None] + d[None, None, :]].reshape(len(px), -1)
    means = patches.sum(1) // max(1, patches.shape[1])  # values are not negative, so this truncates
    return px, py, s, (patches - means[:, None]).astype(np.int16)


def detect(frames: DataFrame, cap: int = 320, distance: float = 7, radius: int = 3) -> DataFrame:
    """frames -> clip_id, frame_index, feature_index, x, y, score, descriptor."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples(index=False):
                x, y, s, d = features_of(luma(r.rgba, r.width, r.height), cap, distance, radius)
                yield pd.DataFrame({"clip_id": r.clip_id, "frame_index": np.int32(r.frame_index), "feature_index": np.arange(len(x), dtype=np.int32), "x": x.astype(np.int32), "y": y.astype(np.int32), "score": s.astype(np.float32), "descriptor": list(d)})

    return frames.mapInPandas(run, "clip_id string, frame_index int, feature_index int, x int, y int, score float, descriptor array<short>")


def quality_of(y: np.ndarray) -> dict[str, float]:
    gx, gy = gradients(y)
    grad = np.abs(gx) + np.abs(gy)
    lap = np.abs(y[1:-1, 2:] + y[1:-1, :-2] + y[2:, 1:-1] + y[:-2, 1:-1] - 4 * y[1:-1, 1:-1])
    on = grad >= 24
    across, down = np.abs(np.diff(y, axis=1)), np.abs(np.diff(y, axis=0))
    edge_x, edge_y = np.arange(1, y.shape[1]) % 8 == 0, np.arange(1, y.shape[0]) % 8 == 0
    mean = lambda *parts: sum(float(p.sum()) for p in parts) / max(1, sum(p.size for p in parts))
    boundary, inner = mean(across[:, edge_x], down[edge_y]), mean(across[:, ~edge_x], down[~edge_y])
    total = float(grad[on].sum())
    return {
        "mean_luma": float(y.mean()),
        "crushed": float((y <= 5).mean()),
        "clipped": float((y >= 250).mean()),
        "texture": float(on.mean()),
        "sharpness": float(lap[on].sum()) / total if total > 0 else 0.0,
        "blockiness": boundary / inner if inner > 0.5 else 1.0,
    }


def quality(frames: DataFrame) -> DataFrame:
    """frames -> clip_id, frame_index, mean_luma, crushed, clipped, texture, sharpness, blockiness."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [{"clip_id": r.clip_id, "frame_index": r.frame_index, **quality_of(luma(r.rgba, r.width, r.height))} for r in p.itertuples(index=False)]
            yield pd.DataFrame(rows)

    return frames.mapInPandas(run, "clip_id string, frame_index int, mean_luma double, crushed double, clipped double, texture double, sharpness double, blockiness double")


def violations(frames: DataFrame) -> DataFrame:
    """Rows (clip_id, frame_index, reason) of what a request must not have; null frame_index for a whole clip."""
    each = frames.select("clip_id", "frame_index", "width", "height", F.octet_length("rgba").alias("bytes"))
    small = each.where("width < 32 or height < 24").select("clip_id", "frame_index", F.lit("too small").alias("reason"))
    wrong = each.where("bytes is null or bytes <> width * height * 4").select("clip_id", "frame_index", F.lit("wrong number of bytes").alias("reason"))
    clips = each.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("width", "height").alias("sizes"))
    none = F.lit(None).cast("int").alias("frame_index")
    few = clips.where("n < 2").select("clip_id", none, F.lit("fewer than two frames").alias("reason"))
    mixed = clips.where("sizes > 1").select("clip_id", none, F.lit("mixed sizes").alias("reason"))
    return small.unionByName(wrong).unionByName(few).unionByName(mixed)


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples between pixels; places must lie inside."""
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = x - x0, y - y0
    return (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy


def patch_contrast(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Largest minus least of the 3 x 3 pixels."""
    d = np.arange(-1, 2)
    p = image[y[:, None, None] + d[None, :, None], x[:, None, None] + d[None, None, :]].reshape(len(x), -1)
    return p.max(1) - p.min(1)


def linear(c: Column) -> Column:
    """Linear light of an sRGB channel in [0, 1]."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def resampled(maps: DataFrame, column: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """maps with x, y and `column` for each pixel of a map of size `to` (width, height): bilinear, pixel centres at halves, clamped at the edges.

    column: a row-major array of the map of size `size`.
    """
    (w, h), (tw, th) = size, to
    pixels = maps.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tw - 1).cast("long")))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(th - 1).cast("long"))))
    place = lambda c, n, tn: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (F.col(c) + 0.5) * n / tn - 0.5))
    u, v = place("x", w, tw), place("y", h, th)
    x0, y0 = F.floor(u), F.floor(v)
    x1, y1 = F.least(F.lit(w - 1), x0 + 1), F.least(F.lit(h - 1), y0 + 1)
    at = lambda x, y: F.get(column, (y * w + x).cast("int")).cast("double")
    fx, fy = u - x0, v - y0
    value = (1 - fy) * ((1 - fx) * at(x0, y0) + fx * at(x1, y0)) + fy * ((1 - fx) * at(x0, y1) + fx * at(x1, y1))
    return pixels.select(*[c for c in maps.columns if c != column], "x", "y", value.alias(column))
