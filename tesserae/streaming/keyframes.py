"""Keyframes and segments of clips whose frames arrive as a stream: the folds of operators.windows with state kept by clip."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "clip_id string, frame_index int, segment long, keyframe boolean, late boolean"
STATE = "last int, total double, segment long"


def mark(stream: DataFrame, budget: float) -> DataFrame:
    """stream: clip_id, frame_index, spend, weak, brk. A row for each frame in Append mode.

    Spends add up until the budget is reached, which marks a keyframe and starts anew; a weak link resets; a break begins a new
    segment and resets too. Frames come in order within a clip; one at or before the last seen is late: it is reported and changes
    nothing. Nulls count as 0 and false. The state is three numbers a clip.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total, segment = state.get if state.exists else (-1, 0.0, 0)
        rows = []
        # a clip's frames in one trigger: few, and needed in order
        for r in pd.concat(list(parts)).sort_values("frame_index", kind="stable").itertuples(index=False):
            if r.frame_index <= last:
                rows.append((key[0], r.frame_index, segment, False, True))
                continue
            last = int(r.frame_index)
            broken, weak = bool(r.brk) if r.brk is not None else False, bool(r.weak) if r.weak is not None else False
            segment += broken
            total = 0.0 if broken or weak else total + (0.0 if pd.isna(r.spend) else float(r.spend))
            full = total >= budget
            total = 0.0 if full else total
            rows.append((key[0], last, segment, full, False))
        state.update((last, total, segment))
        yield pd.DataFrame(rows, columns=["clip_id", "frame_index", "segment", "keyframe", "late"])

    return stream.groupBy("clip_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
