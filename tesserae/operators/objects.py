"""Objects of a scene: where observations lie, and which of them are one object."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels that are structure and are never merged by place.
STRUCTURE = "wall floor ceiling door window ground"
BAND, LEAST, STATIONARY = 0.1, 3, 0.08


def locations(front: DataFrame) -> DataFrame:
    """front: observation, depth, x, y, z of the points inside each mask. Mean of the front band, for observations with LEAST points in it."""
    near = front.groupBy("observation").agg(F.min("depth").alias("near"))
    kept = front.join(near, "observation").where(F.col("depth") <= F.col("near") * (1 + BAND))
    return kept.groupBy("observation").agg(F.count(F.lit(1)).alias("points"), *[F.avg(c).alias(c) for c in ("depth", "x", "y", "z")]).where(F.col("points") >= LEAST)


def spread(places: np.ndarray, depths: np.ndarray) -> float | None:
    """Largest distance between places relative to the mean depth; None for fewer than two."""
    if len(places) < 2:
        return None
    gaps = np.linalg.norm(places[:, None] - places[None], axis=2)
    return float(gaps.max() / depths.mean())


def stable_id(label: str, observations: list[str]) -> str:
    return "obj-" + hashlib.sha256(b"\0".join(x.encode() for x in [label, *observations])).hexdigest()[:12]


def identify(candidates: DataFrame) -> DataFrame:
    """candidates: clip_id, label, candidate, observation, frame_index, x, y, z, depth (nulls where not located). Rows (clip_id, object, label, motion, observation).

    By clip and label the largest candidate first: it joins the first object of its label that shares no frame with it and
    whose places agree with its own; structure never joins. The order is the semantics, so one task sees a clip's label.
    """
    structure = set(STRUCTURE.split())

    def run(p: pd.DataFrame) -> pd.DataFrame:
        label = str(p["label"].iat[0])
        groups = []
        for _, g in p.groupby("candidate"):
            g = g.sort_values(["frame_index", "observation"])
            at = g.dropna(subset=["x", "y", "z", "depth"])
            groups.append((list(g["observation"]), set(g["frame_index"]), at[["x", "y", "z"]].to_numpy(float), at["depth"].to_numpy(float), dict(zip(g["observation"], g["frame_index"])), set(at["frame_index"])))
        groups.sort(key=lambda g: (-len(g[0]), g[0]))
        objects: list[list] = []
        for names, frames, places, depths, where, seen in groups:
            for o in objects if label.lower() not in structure else []:
                both = np.concatenate([o[2], places]), np.concatenate([o[3], depths])
                if not (o[1] & frames) and len(places) and len(o[2]) and (spread(*both) or 0) <= STATIONARY:
                    o[0], o[1], o[2], o[3], o[4], o[5] = o[0] + names, o[1] | frames, *both, o[4] | where, o[5] | seen
                    break
            else:
                objects.append([names, frames, places, depths, where, seen])
        rows = []
        for names, _, places, depths, where, seen in objects:
            names = sorted(names, key=lambda n: (where[n], n))
            s = spread(places, depths)
            motion = "static_structure" if label.lower() in structure else "unknown" if s is None or len(seen) < 2 else "movable_stationary" if s <= STATIONARY else "moving"
            rows += [(p["clip_id"].iat[0], stable_id(label, names), label, motion, n) for n in names]
        return pd.DataFrame(rows, columns=["clip_id", "object", "label", "motion", "observation"])

    return candidates.groupBy("clip_id", "label").applyInPandas(run, "clip_id string, object string, label string, motion string, observation string")


def spread_views(views: DataFrame, extra: int = 4) -> DataFrame:
    """views: clip_id, object, frame_index, score, x, y, z. The best view and up to `extra` more, each the farthest from those chosen (ties: lower frame).

    Greedy, so one task sees an object's views.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["score", "frame_index"], ascending=[False, True]).reset_index(drop=True)
        at = p[["x", "y", "z"]].to_numpy(float)
        chosen, gap = [0], np.linalg.norm(at - at[0], axis=1)
        while len(chosen) <= extra and gap.max() > 0:
            k = min(np.flatnonzero(gap == gap.max()), key=lambda j: p["frame_index"].iat[j])
            chosen.append(int(k))
            gap = np.minimum(gap, np.linalg.norm(at - at[k], axis=1))
        return p.loc[chosen, ["clip_id", "object", "frame_index"]].assign(rank=np.arange(len(chosen), dtype=np.int32))

    return views.groupBy("clip_id", "object").applyInPandas(run, "clip_id string, object string, frame_index int, rank int")
