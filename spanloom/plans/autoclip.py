"""Live segments from a strided sample of frames, for cutting or for a full game run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import seconds
from ..operators import activity, intervals, tracks


def live_segments(
    detections: DataFrame,
    clips: DataFrame,
    keys: list[str],
    fps: float,
    width: int,
    height: int,
    mask: DataFrame | None = None,
    conf: float = 0.25,
    stride: int = 15,
    min_players: int = 5,
    min_spread: float = 0.15,
    smooth_seconds: float = 2.0,
    min_segment_seconds: float = 3.0,
    merge_gap_seconds: float = 2.0,
    pad_seconds: float = 1.0,
) -> DataFrame:
    """Segments with seconds of all ``clips``, which share a rate and a frame size. Tracks are not
    needed: every person of a sampled frame counts."""
    seen = tracks.with_surface(tracks.with_geometry(tracks.people(activity.strided(detections, stride), conf)), mask, width, height)
    spine = activity.strided(activity.frame_spine(clips, keys), stride)
    window = max(1, round(smooth_seconds * fps / stride)) if fps > 0 else 1
    flags = activity.detect_activity(seen.where("on_surface"), spine, keys, width, min_players, min_spread, window)
    samples = flags.select(*keys, "sample", "active").join(clips.select(*keys, "total_frames"), keys)
    own = [*keys, "total_frames"]
    found = intervals.sampled_segments(
        samples, own, fps, stride, F.col("total_frames"), min_segment_seconds, merge_gap_seconds, pad_seconds
    )
    return intervals.timed(found.drop("total_frames"), fps)


def extras(segs: DataFrame, clips: DataFrame, keys: list[str], fps: float, source: str, surface_found: bool, stride: int) -> DataFrame:
    """The further fields of each clip's segment document, also of clips without a segment."""
    total = seconds("total_frames", fps, None)
    live = clips.select(*keys, "total_frames").join(intervals.total_live_seconds(segs, keys, fps), keys, "left")
    saved = F.bround(intervals.savings(F.coalesce("live_seconds", F.lit(0.0)), total), 4)
    return live.select(
        *keys,
        F.lit(float(fps)).alias("fps"),
        F.lit(source).alias("source"),
        "total_frames",
        F.bround(total, 2).alias("total_seconds"),
        saved.alias("savings_frac"),
        F.lit(surface_found).alias("surface_found"),
        F.lit(stride).alias("stride"),
    )
