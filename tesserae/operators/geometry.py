"""Camera geometry: projections as columns, and solvers over small arrays for one pair, track or frame at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(x: Column, y: Column, z: Column, focal: float, width: int, height: int, near: float = 1e-6) -> Column:
    """Pixel (u, v) of a camera-space point; null behind the near plane."""
    return F.when(z > near, F.struct((x / z * focal + width * 0.5).alias("u"), (y / z * focal + height * 0.5).alias("v")))


def unproject(u: Column, v: Column, depth: Column, focal: float, width: int, height: int) -> Column:
    return F.struct(((u - width * 0.5) / focal * depth).alias("x"), ((v - height * 0.5) / focal * depth).alias("y"), depth.alias("z"))


def camera_point(rotation: Column, translation: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Rotation (row-major) times the point plus translation."""
    return [rotation[3 * k] * x + rotation[3 * k + 1] * y + rotation[3 * k + 2] * z + translation[k] for k in range(3)]


def camera_center(rotation: Column, translation: Column) -> list[Column]:
    """-R' t."""
    return [-(rotation[k] * translation[0] + rotation[3 + k] * translation[1] + rotation[6 + k] * translation[2]) for k in range(3)]


def angle_degrees(a: list[Column], b: list[Column]) -> Column:
    dot = sum(p * q for p, q in zip(a, b))
    norm = F.sqrt(sum(p * p for p in a)) * F.sqrt(sum(q * q for q in b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm))))


def rays(uv: np.ndarray, focal: float, width: int, height: int) -> np.ndarray:
    """Points of the image plane at depth 1."""
    return (uv - np.array([width, height]) * 0.5) / focal


def triangulate(projections: np.ndarray, places: np.ndarray) -> np.ndarray | None:
    """Point from (n, 3, 4) cameras and their (n, 2) rays by the least singular vector; None if it is at infinity."""
    rows = np.concatenate([places[:, :1] * projections[:, 2] - projections[:, 0], places[:, 1:] * projections[:, 2] - projections[:, 1]])
    v = np.linalg.svd(rows)[2][-1]
    return v[:3] / v[3] if abs(v[3]) > 1e-12 else None


def essential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Eight points or more: b' E a = 0, with two equal singular values."""

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(0)
        s = np.sqrt(2) / max(1e-12, np.sqrt(((p - c) ** 2).sum(1)).mean())
        t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
        return np.c_[p, np.ones(len(p))] @ t.T, t

    (x, ta), (y, tb) = normal(a), normal(b)
    m = np.einsum("ni,nj->nij", y, x).reshape(len(x), 9)
    e = tb.T @ np.linalg.svd(m)[2][-1].reshape(3, 3) @ ta
    u, _, v = np.linalg.svd(e)
    return u @ np.diag([1.0, 1.0, 0.0]) @ v


def sampson(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First-order distance to the epipolar constraint, in units of the rays."""
    x, y = np.c_[a, np.ones(len(a))], np.c_[b, np.ones(len(b))]
    ex, ey = x @ e.T, y @ e
    return np.abs((y * ex).sum(1)) / np.sqrt(np.maximum(ex[:, 0] ** 2 + ex[:, 1] ** 2 + ey[:, 0] ** 2 + ey[:, 1] ** 2, 1e-24))


def poses_of(e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four rotations and directions of an essential matrix."""
    u, _, v = np.linalg.svd(e)
    u, v = u * np.sign(np.linalg.det(u)), v * np.sign(np.linalg.det(v))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return [(r, s * u[:, 2]) for r in (u @ w @ v, u @ w.T @ v) for s in (1, -1)]


def two_view(a: np.ndarray, b: np.ndarray, limit: float, rounds: int = 256, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rotation, unit translation and inliers between two views by random samples; best by (inliers, median error)."""
    if len(a) < 8:
        return None
    rng, best = np.random.default_rng(seed), None
    for _ in range(rounds):
        pick = rng.choice(len(a), 8, replace=False)
        errors = sampson(essential(a[pick], b[pick]), a, b)
        on = errors <= limit
        if on.sum() >= 8 and (best is None or (on.sum(), -np.median(errors[on])) > best[0]):
            best = ((on.sum(), -np.median(errors[on])), on)
    if best is None:
        return None
    on = best[1]
    for _ in range(3):
        e = essential(a[on], b[on])
        new = sampson(e, a, b) <= limit
        if new.sum() < 8 or (new == on).all():
            break
        on = new
    first, front = np.eye(3, 4), []
    for r, t in poses_of(e):
        second = np.c_[r, t]
        found = [triangulate(np.stack([first, second]), np.stack([p, q])) for p, q in zip(a[on][:64], b[on][:64])]
        front.append(sum(x is not None and x[2] > 0 and (r @ x + t)[2] > 0 for x in found))
    r, t = poses_of(e)[int(np.argmax(front))]
    return r, t, on


def pair_poses(matches: DataFrame, focal: float, width: int, height: int, limit_pixels: float = 1.5) -> DataFrame:
    """matches: clip_id, frame_a, frame_b, xa, ya, xb, yb, distance. Per pair: matches, inliers, rotation, direction; nulls if there is no pose."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["distance", "xa", "ya", "xb", "yb"])
        a, b = (rays(p[list(c)].to_numpy(float), focal, width, height) for c in (("xa", "ya"), ("xb", "yb")))
        got = two_view(a, b, limit_pixels / focal)
        row = {"clip_id": p["clip_id"].iat[0], "frame_a": p["frame_a"].iat[0], "frame_b": p["frame_b"].iat[0], "matches": len(p)}
        return pd.DataFrame([row | {"inliers": int(got[2].sum()) if got else 0, "rotation": got[0].ravel().tolist() if got else None, "direction": got[1].tolist() if got else None}])

    return matches.groupBy("clip_id", "frame_a", "frame_b").applyInPandas(run, "clip_id string, frame_a int, frame_b int, matches int, inliers int, rotation array<double>, direction array<double>")


def resect(points: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Pose of a camera from six points or more in general position and their rays."""
    if len(points) < 6:
        return None
    x = np.c_[points, np.ones(len(points))]
    zero = np.zeros_like(x)
    m = np.concatenate([np.c_[x, zero, -places[:, :1] * x], np.c_[zero, x, -places[:, 1:] * x]])
    _, s, v = np.linalg.svd(m)
    if s[-2] < 1e-9 * s[0]:
        return None
    p = v[-1].reshape(3, 4)
    u, d, w = np.linalg.svd(p[:, :3])
    sign = np.sign(np.linalg.det(u @ w))
    r, t = sign * (u @ w), sign * p[:, 3] / d.mean()
    return (r, t) if np.median((points @ r.T + t)[:, 2]) > 0 else None


def landmarks(observations: DataFrame, focal: float, width: int, height: int, angle: float = 0.5, error: float = 4.0, median: float = 2.5, support: float = 0.6) -> DataFrame:
    """observations: clip_id, track, frame_index, x, y, rotation, translation. One row for each accepted track.

    Every pair of a track's views proposes a point; it needs the angle, the support of both ends and of the share of views
    within the error, and a small median error. The best is by support, then error, then angle.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame_index")
        uv = p[["x", "y"]].to_numpy(float)
        place = rays(uv, focal, width, height)
        r = np.stack([np.reshape(v, (3, 3)) for v in p["rotation"]])
        t = np.stack([np.asarray(v) for v in p["translation"]])
        cams, center = np.concatenate([r, t[:, :, None]], 2), -np.einsum("nji,nj->ni", r, t)
        best = None
        for i in range(len(p) - 1):
            for j in range(i + 1, len(p)):
                x = triangulate(cams[[i, j]], place[[i, j]])
                if x is None:
                    continue
                a, b = x - center[i], x - center[j]
                cos = a @ b / max(1e-12, np.linalg.norm(a) * np.linalg.norm(b))
                wide = np.degrees(np.arccos(np.clip(cos, -1, 1)))
                c = r @ x + t
                with np.errstate(divide="ignore", invalid="ignore"):
                    e = np.linalg.norm(c[:, :2] / c[:, 2:] - place, axis=1) * focal
                on = (c[:, 2] > 1e-6) & (e <= error)
                if wide < angle or not (on[i] and on[j]) or on.sum() < support * len(p) or np.median(e[on]) > median:
                    continue
                key = (on.sum(), -np.median(e[on]), wide)
                if best is None or key > best[0]:
                    best = (key, x)
        if best is None:
            return pd.DataFrame(columns=["clip_id", "track", "x", "y", "z", "views", "error", "angle"])
        (n, e, wide), x = best
        return pd.DataFrame([{"clip_id": p["clip_id"].iat[0], "track": p["track"].iat[0], "x": x[0], "y": x[1], "z": x[2], "views": int(n), "error": -e, "angle": wide}])

    return observations.groupBy("clip_id", "track").applyInPandas(run, "clip_id string, track string, x double, y double, z double, views int, error double, angle double")


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and translation that take points a to b with least squares."""
    ca, cb = a.mean(0), b.mean(0)
    u, d, v = np.linalg.svd((b - cb).T @ (a - ca) / len(a))
    s = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(v))])
    r = u @ s @ v
    scale = (d @ np.diag(s)) / ((a - ca) ** 2).sum(1).mean()
    return scale, r, cb - scale * r @ ca


def plane(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centroid, unit normal and root mean square distance of the best plane."""
    c = points.mean(0)
    values, vectors = np.linalg.eigh(np.cov((points - c).T, bias=True))
    return c, vectors[:, 0], float(np.sqrt(max(values[0], 0)))
