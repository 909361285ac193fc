"""Unbounded inputs: presence per track, session windows, and the two-phase colour classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.clustering import ColorTeams


def running_presence(detections: DataFrame, keys: list[str]) -> DataFrame:
    """First and last frame and frames seen per track; for output mode update or complete."""
    return detections.groupBy(*keys).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("frames_seen")
    )


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, delay: str | None = None) -> DataFrame:
    """Session windows per key, closed when the watermark passes their end.

    Rows later than ``delay`` (by default the gap) behind the newest are dropped. Emitted are
    exactly the sessions of a batch over the same rows that end by the last watermark; those
    that are open when a stream ends stay in its state. The bounds are aggregates: a filter on
    the bounds of the window itself would be pushed below the merging of sessions and split them.
    """
    windowed = events.withWatermark(time, delay or gap).groupBy(*keys, F.session_window(time, gap).alias("w"))
    bounds = F.min(time).alias("start"), (F.max(time) + F.expr(f"INTERVAL {gap}")).alias("end")
    return windowed.agg(*bounds, F.count(F.lit(1)).alias("n")).select(*keys, "start", "end", "n")


def color_teams(colors: DataFrame, min_samples: int = 8) -> DataFrame:
    """``game_id, frame, track_id, team`` of rows with blue, green, red: a split by brightness
    until enough samples of a game came, then its frozen centres. Append mode."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = ColorTeams(min_samples)
        if state.exists:
            samples, centres = state.get
            model.samples = [list(samples[i : i + 3]) for i in range(0, len(samples), 3)]
            model.centres = np.array(centres).reshape(2, 3) if len(centres) else None
        rows = pd.concat(batches).sort_values(["frame", "track_id"], ignore_index=True)
        out = []
        for _, part in rows.groupby("frame", sort=True):
            team = model.predict(part[["blue", "green", "red"]].to_numpy())
            out.append(part[["frame", "track_id"]].assign(game_id=key[0], team=team.astype("int32")))
        if model.centres is not None:
            model.samples = []
        flat = [float(x) for s in model.samples for x in s]
        state.update((flat, [] if model.centres is None else model.centres.ravel().tolist()))
        yield pd.concat(out)[["game_id", "frame", "track_id", "team"]]

    return colors.groupBy("game_id").applyInPandasWithState(
        run,
        "game_id long, frame long, track_id long, team int",
        "samples array<double>, centres array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
