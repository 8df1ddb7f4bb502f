"""Cameras of a clip from its tracks: a seed pair, registration of further frames until none is added, and adjustment.

Each step depends on the one before, so a clip is one task; clips are independent, and a clip's tracks are small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tesserae.operators.geometry import rays, resect, triangulate, two_view

#: Gates of a registration, of a new landmark, and of the adjustment, in pixels, degrees and counts.
LEAST_LINKS, LEAST_INLIERS, INLIER_RATIO, INLIER_PIXELS, MEDIAN_PIXELS = 12, 8, 0.55, 4.0, 2.5
LEAST_ANGLE, SUPPORT, ROUNDS = 0.5, 0.6, 64
HUBER, PASSES = 2.0, 8


def residuals(r: np.ndarray, t: np.ndarray, x: np.ndarray, place: np.ndarray, focal: float) -> tuple[np.ndarray, np.ndarray]:
    """Pixel residuals and camera-space points for aligned rows of poses (n, 3, 3), (n, 3), points and rays."""
    c = np.einsum("nij,nj->ni", r, x) + t
    return (c[:, :2] / c[:, 2:] - place) * focal, c


def huber(e: np.ndarray) -> float:
    n = np.linalg.norm(e, axis=1)
    return float(np.where(n <= HUBER, n**2, 2 * HUBER * n - HUBER**2).sum())


def turn(v: np.ndarray) -> np.ndarray:
    """Rotation by a vector."""
    a = np.linalg.norm(v)
    if a < 1e-12:
        return np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / a
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def slopes(c: np.ndarray, focal: float) -> np.ndarray:
    """d pixel / d camera-space point, (n, 2, 3)."""
    z = c[:, 2]
    j = np.zeros((len(c), 2, 3))
    j[:, 0, 0] = j[:, 1, 1] = focal / z
    j[:, 0, 2], j[:, 1, 2] = -focal * c[:, 0] / z**2, -focal * c[:, 1] / z**2
    return j


def adjust(r: np.ndarray, t: np.ndarray, x: np.ndarray, cam: np.ndarray, point: np.ndarray, place: np.ndarray, focal: float, fixed: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Block-coordinate Gauss-Newton with Huber weights: landmarks, then cameras but the fixed ones. Kept only if cost and RMSE fall and the median hardly rises."""
    new_r, new_t, new_x = r.copy(), t.copy(), x.copy()

    def state(a, b, c):
        e, p = residuals(a[cam], b[cam], c[point], place, focal)
        return e, p

    e, _ = state(r, t, x)
    before = huber(e)
    cost = before
    for _ in range(PASSES):
        e, p = state(new_r, new_t, new_x)
        n = np.linalg.norm(e, axis=1)
        w = np.where(n <= HUBER, 1.0, HUBER / np.maximum(n, 1e-12))
        j = np.einsum("nij,njk->nik", slopes(p, focal), new_r[cam])
        h, g = np.zeros((len(x), 3, 3)), np.zeros((len(x), 3))
        np.add.at(h, point, np.einsum("n,nij,nik->njk", w, j, j))
        np.add.at(g, point, np.einsum("n,nij,ni->nj", w, j, e))
        h += np.eye(3) * (1e-6 + 1e-3 * np.trace(h, axis1=1, axis2=2)[:, None, None] / 3)
        new_x = new_x - np.linalg.solve(h, g[..., None])[..., 0]
        e, p = state(new_r, new_t, new_x)
        n = np.linalg.norm(e, axis=1)
        w = np.where(n <= HUBER, 1.0, HUBER / np.maximum(n, 1e-12))
        s = slopes(p, focal)
        rotated = p - new_t[cam]
        cross = np.zeros((len(p), 3, 3))
        cross[:, 0, 1], cross[:, 0, 2], cross[:, 1, 0] = rotated[:, 2], -rotated[:, 1], -rotated[:, 2]
        cross[:, 1, 2], cross[:, 2, 0], cross[:, 2, 1] = rotated[:, 0], rotated[:, 1], -rotated[:, 0]
        j = np.concatenate([np.einsum("nij,njk->nik", s, cross), s], 2)
        h, g = np.zeros((len(r), 6, 6)), np.zeros((len(r), 6))
        np.add.at(h, cam, np.einsum("n,nij,nik->njk", w, j, j))
        np.add.at(g, cam, np.einsum("n,nij,ni->nj", w, j, e))
        for k in set(range(len(r))) - fixed:
            d = -np.linalg.solve(h[k] + np.eye(6) * (1e-6 + 1e-3 * np.trace(h[k]) / 6), g[k])
            new_r[k], new_t[k] = turn(d[:3]) @ new_r[k], new_t[k] + d[3:]
        now = huber(state(new_r, new_t, new_x)[0])
        if not np.isfinite(now) or now >= cost * (1 - 1e-6):
            break
        cost = now
    old, e = np.linalg.norm(state(r, t, x)[0], axis=1), np.linalg.norm(state(new_r, new_t, new_x)[0], axis=1)
    better = np.isfinite(e).all() and huber(state(new_r, new_t, new_x)[0]) < before and np.sqrt((e**2).mean()) < np.sqrt((old**2).mean()) and np.median(e) <= np.median(old) + 0.05
    return (new_r, new_t, new_x, True) if better else (r, t, x, False)


def register(points: np.ndarray, place: np.ndarray, focal: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray] | None:
    """Pose of a frame from its landmarks by random samples of six, refitted on the inliers, if the gates let it pass."""
    if len(points) < LEAST_LINKS:
        return None
    rng, best = np.random.default_rng(seed), None

    def errors(pose):
        c = points @ pose[0].T + pose[1]
        e = np.linalg.norm(c[:, :2] / np.where(c[:, 2:] > 1e-6, c[:, 2:], np.nan) - place, axis=1) * focal
        return np.where(np.isfinite(e), e, np.inf)

    for _ in range(128):
        pose = resect(*(v[k] for k in [rng.choice(len(points), 6, replace=False)] for v in (points, place)))
        if pose is None:
            continue
        e = errors(pose)
        on = e <= INLIER_PIXELS
        if on.sum() >= 6 and (best is None or (on.sum(), -np.median(e[on])) > best[0]):
            best = ((on.sum(), -np.median(e[on])), on, pose)
    if best is None:
        return None
    pose = resect(points[best[1]], place[best[1]]) or best[2]
    if (errors(pose) <= INLIER_PIXELS).sum() < best[1].sum():
        pose = best[2]
    e = errors(pose)
    on = e <= INLIER_PIXELS
    return pose if on.sum() >= LEAST_INLIERS and on.mean() >= INLIER_RATIO and np.median(e[on]) <= MEDIAN_PIXELS else None


def solve(obs: pd.DataFrame, focal: float, width: int, height: int, span: int = 6) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict, bool]:
    """obs: track, frame_index, x, y. Poses by frame, landmarks by track, and whether the adjustment was kept. No seed: nothing."""
    obs = obs.sort_values(["frame_index", "track"])
    place = dict(zip(zip(obs["track"], obs["frame_index"]), rays(obs[["x", "y"]].to_numpy(float), focal, width, height)))
    by_frame = {f: set(g["track"]) for f, g in obs.groupby("frame_index")}
    frames, best = sorted(by_frame), None
    for i, a in enumerate(frames):
        for b in frames[i + 1 : i + 1 + span]:
            both = sorted(by_frame[a] & by_frame[b])
            if len(both) < 20:
                continue
            pa, pb = (np.array([place[k, f] for k in both]) for f in (a, b))
            got = two_view(pa, pb, 1.5 / focal, rounds=96)
            if got is None or got[2].sum() < 16 or np.median(np.linalg.norm(pa - pb, axis=1)) * focal < 1.4:
                continue
            # the angle at which the views' rays meet, up to the turn between them
            wide = np.degrees(np.median(np.linalg.norm(pa - pb, axis=1)))
            key = (min(wide, 8.0) * got[2].mean(), got[2].sum())
            if best is None or key > best[0]:
                best = (key, a, b, got)
    if best is None:
        return {}, {}, False
    _, a, b, (r, t, _) = best
    poses, marks = {a: (np.eye(3), np.zeros(3)), b: (r, t)}, {}
    fixed = {a, b}

    def extend() -> None:
        for k in sorted({k for f in poses for k in by_frame[f]} - set(marks)):
            seen = [f for f in poses if k in by_frame[f]]
            if len(seen) < 2:
                continue
            x = triangulate(np.stack([np.c_[poses[f]] for f in seen]), np.stack([place[k, f] for f in seen]))
            if x is None:
                continue
            rr, tt = np.stack([poses[f][0] for f in seen]), np.stack([poses[f][1] for f in seen])
            e, c = residuals(rr, tt, np.repeat(x[None], len(seen), 0), np.stack([place[k, f] for f in seen]), focal)
            n = np.linalg.norm(e, axis=1)
            view = x + np.einsum("nji,nj->ni", rr, tt)
            view /= np.linalg.norm(view, axis=1, keepdims=True)
            angle = np.degrees(np.arccos(np.clip((view @ view.T).min(), -1, 1)))
            on = (n <= INLIER_PIXELS) & (c[:, 2] > 1e-6)
            if angle >= LEAST_ANGLE and on.sum() >= 2 and on.mean() >= SUPPORT and np.median(n[on]) <= MEDIAN_PIXELS:
                marks[k] = x

    extend()
    for _ in range(ROUNDS):
        links = sorted(((len(by_frame[f] & set(marks)), -f) for f in frames if f not in poses), reverse=True)
        for n, f in links:
            known = sorted(by_frame[-f] & set(marks))
            pose = register(np.array([marks[k] for k in known]), np.array([place[k, -f] for k in known]), focal) if n >= LEAST_LINKS else None
            if pose is not None:
                poses[-f] = pose
                extend()
                break
        else:
            break
    order, names = sorted(poses), sorted(marks)
    rows = [(order.index(f), j, place[k, f]) for j, k in enumerate(names) for f in order if k in by_frame[f]]
    if not rows:
        return poses, marks, False
    cam, point, at = np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    rr, tt, xx = np.stack([poses[f][0] for f in order]), np.stack([poses[f][1] for f in order]), np.array([marks[k] for k in names])
    rr, tt, xx, kept = adjust(rr, tt, xx, cam, point, at, focal, {order.index(f) for f in fixed})
    return {f: (rr[k], tt[k]) for k, f in enumerate(order)}, {k: xx[j] for j, k in enumerate(names)}, kept


def solve_clips(observations: DataFrame, focal: float, width: int, height: int) -> DataFrame:
    """observations: clip_id, track, frame_index, x, y. Registered cameras: clip_id, frame_index, rotation, translation, center, landmarks, adjusted."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        poses, marks, kept = solve(p, focal, width, height)
        rows = [(p["clip_id"].iat[0], int(f), r.ravel().tolist(), t.tolist(), (-r.T @ t).tolist(), len(marks), bool(kept)) for f, (r, t) in sorted(poses.items())]
        return pd.DataFrame(rows, columns=["clip_id", "frame_index", "rotation", "translation", "center", "landmarks", "adjusted"])

    return observations.groupBy("clip_id").applyInPandas(run, "clip_id string, frame_index int, rotation array<double>, translation array<double>, center array<double>, landmarks int, adjusted boolean")
