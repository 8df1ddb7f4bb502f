"""Depth by plane sweep: one reference frame is one task, all hypotheses of all its sites are arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.images import bilinear, luma, patch_contrast


def sites(width: int, height: int, border: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
    """Grid of the reference: stride clamp(min side / 48, 4, 12)."""
    stride = int(min(12, max(4, min(width, height) // 48)))
    y, x = np.mgrid[border : height - border : stride, border : width - border : stride]
    return x.ravel(), y.ravel(), stride


def sweep(reference: np.ndarray, sources: list[tuple[np.ndarray, np.ndarray, np.ndarray]], focal: float, near: float, far: float, hypotheses: int = 24, limit: float = 18.0, contrast: float = 12.0) -> pd.DataFrame:
    """sources: (luma, rotation, translation) relative to the reference. gx, gy, depth, support, error, margin for the accepted sites.

    Hypotheses are even in inverse depth. A source supports one if the mean-free difference of 3 x 3 patches is small. Best by
    (support, error, depth); the margin is to the next of equal support.
    """
    h, w = reference.shape
    x, y, _ = sites(w, h)
    textured = patch_contrast(reference, x, y) >= contrast
    x, y = x[textured], y[textured]
    d = np.arange(-1, 2)
    dy, dx = (v.ravel() for v in np.meshgrid(d, d, indexing="ij"))
    own = reference[y[:, None] + dy, x[:, None] + dx].astype(float)
    own -= own.mean(1, keepdims=True)
    depths = 1 / np.linspace(1 / near, 1 / far, hypotheses)
    px, py = (x[:, None] + dx - w * 0.5) / focal, (y[:, None] + dy - h * 0.5) / focal
    support, total = np.zeros((hypotheses, len(x)), int), np.zeros((hypotheses, len(x)))
    for k, depth in enumerate(depths):
        p = np.stack([px * depth, py * depth, np.full_like(px, depth)], -1)
        for image, rotation, translation in sources:
            q = p @ rotation.T + translation
            z = q[..., 2]
            u, v = q[..., 0] / np.maximum(z, 1e-9) * focal + w * 0.5, q[..., 1] / np.maximum(z, 1e-9) * focal + h * 0.5
            inside = ((z > 1e-4) & (u >= 0) & (v >= 0) & (u <= w - 1) & (v <= h - 1)).all(1)
            e = np.full(len(x), np.inf)
            if inside.any():
                there = bilinear(image, u[inside], v[inside])
                e[inside] = np.abs(there - there.mean(1, keepdims=True) - own[inside]).mean(1)
            on = e <= limit
            support[k] += on
            total[k] += np.where(on, e, 0)
    error = np.where(support > 0, total / np.maximum(support, 1), np.inf)
    order = np.lexsort((np.broadcast_to(depths[:, None], error.shape), error, -support), axis=0)
    first, second = order[0], order[1] if hypotheses > 1 else order[0]
    at = np.arange(len(x))
    equal = (support[second, at] == support[first, at]) & np.isfinite(error[second, at])
    margin = np.full(len(x), np.inf)
    margin[equal] = error[second, at][equal] - error[first, at][equal]
    out = pd.DataFrame({"gx": x, "gy": y, "depth": depths[first], "support": support[first, at], "error": error[first, at], "margin": margin})
    return out[(out["support"] >= min(2, len(sources)))].replace(np.inf, 1e6)


def depth_points(frames: DataFrame, cameras: DataFrame, focal: float, near: float, far: float, nearest: int = 4) -> DataFrame:
    """Points of each reference frame from its `nearest` frames: clip_id, frame_index, gx, gy, depth, support, error, margin.

    Each frame is sent to the references near it, so a task holds nearest + 1 images.
    """
    posed = frames.join(F.broadcast(cameras), ["clip_id", "frame_index"])  # a row for each frame, 12 numbers
    near_by = F.explode(F.sequence(F.col("frame_index") - nearest, F.col("frame_index") + nearest))
    dealt = posed.withColumn("reference", near_by).join(frames.select(F.col("clip_id").alias("c"), F.col("frame_index").alias("r")), F.expr("clip_id = c and reference = r")).drop("c", "r")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        ref = int(p["reference"].iat[0])
        p = p.assign(gap=(p["frame_index"] - ref).abs()).sort_values(["gap", "frame_index"]).head(nearest + 1)
        pose = lambda r: (np.reshape(r.rotation, (3, 3)), np.asarray(r.translation))
        rows = list(p.itertuples(index=False))
        r0, t0 = pose(rows[0])
        sources = []
        for r in rows[1:]:
            r1, t1 = pose(r)
            rel = r1 @ r0.T
            sources.append((luma(r.rgba, r.width, r.height), rel, t1 - rel @ t0))
        out = sweep(luma(rows[0].rgba, rows[0].width, rows[0].height), sources, focal, near, far)
        return out.assign(clip_id=rows[0].clip_id, frame_index=np.int32(ref))[["clip_id", "frame_index", "gx", "gy", "depth", "support", "error", "margin"]]

    return dealt.groupBy("clip_id", "reference").applyInPandas(run, "clip_id string, frame_index int, gx int, gy int, depth double, support int, error double, margin double")
