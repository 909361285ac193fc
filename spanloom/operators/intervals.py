"""Intervals of whole frames, inclusive at both ends, coalesced per key.

Every operator here partitions by the caller's keys; nothing sorts a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import frames, seconds


def coalesce_intervals(
    df: DataFrame, keys: list[str], start: str = "start_frame", end: str = "end_frame", tolerance: int = 0
) -> DataFrame:
    """Join intervals of a key whose idle gap ``start - end - 1`` is at most ``tolerance``.

    Returns the keys, ``start_frame, end_frame, n_fragments``. One shuffle on the keys: the
    running maximum of ends opens islands, and the islands are aggregated in place.
    """
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    opens = F.when(reach.isNull() | (F.col(start) - reach - 1 > tolerance), 1).otherwise(0)
    islands = df.withColumn("_opens", opens).withColumn(
        "_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        islands.groupBy(*keys, "_island")
        .agg(F.min(start).alias("start_frame"), F.max(end).alias("end_frame"), F.count(F.lit(1)).alias("n_fragments"))
        .drop("_island")
    )


def numbered(df: DataFrame, keys: list[str], name: str, order: str = "start_frame") -> DataFrame:
    """Dense numbers from 0 within the keys, in time order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def with_length(df: DataFrame) -> DataFrame:
    return df.withColumn("n_frames", F.col("end_frame") - F.col("start_frame") + 1)


def segments(flags: DataFrame, keys: list[str], fps: float, min_seconds: float = 2.0, bridge_seconds: float = 1.0) -> DataFrame:
    """Live segments of per-frame flags (keys, frame, active): bridge short idle runs, drop short segments."""
    live = flags.where("active").select(*keys, F.col("frame").alias("start_frame"), F.col("frame").alias("end_frame"))
    return segments_from_spans(live, keys, fps, min_seconds, bridge_seconds)


def segments_from_spans(spans: DataFrame, keys: list[str], fps: float, min_seconds: float, bridge_seconds: float) -> DataFrame:
    joined = with_length(coalesce_intervals(spans, keys, tolerance=frames(bridge_seconds, fps)).drop("n_fragments"))
    return numbered(joined.where(F.col("n_frames") >= frames(min_seconds, fps, least=1)), keys, "segment")


def pad_segments(segs: DataFrame, keys: list[str], pad: int, frame_count: Column | int) -> DataFrame:
    """Widen by ``pad`` frames on both sides inside 0 .. frame_count - 1; join what then overlaps or touches."""
    count = frame_count if isinstance(frame_count, Column) else F.lit(frame_count)
    wide = segs.select(
        *keys,
        F.greatest(F.lit(0), F.col("start_frame") - pad).alias("start_frame"),
        F.least(count - 1, F.col("end_frame") + pad).alias("end_frame"),
    )
    return numbered(with_length(coalesce_intervals(wide, keys).drop("n_fragments")), keys, "segment")


def sampled_segments(
    samples: DataFrame,
    keys: list[str],
    fps: float,
    stride: int,
    total_frames: Column | int,
    min_segment_seconds: float = 3.0,
    merge_gap_seconds: float = 2.0,
    pad_seconds: float = 1.0,
) -> DataFrame:
    """Segments of flags sampled every ``stride`` frames (keys, sample, active); each covers its stride.

    The minimum length is tested after gaps are merged and before padding. ``total_frames`` may
    be a column of the keys.
    """
    total = total_frames if isinstance(total_frames, Column) else F.lit(total_frames)
    spans = samples.where("active").select(
        *keys,
        (F.col("sample") * stride).alias("start_frame"),
        (F.least((F.col("sample") + 1) * stride, total) - 1).alias("end_frame"),
    )
    spans = spans.where(F.col("start_frame") < total)
    found = segments_from_spans(spans, keys, fps, min_segment_seconds, merge_gap_seconds)
    return pad_segments(found, keys, frames(pad_seconds, fps), total)


def shifts(
    spans: DataFrame,
    keys: list[str],
    fps: float,
    gap_seconds: float = 15.0,
    min_seconds: float = 0.0,
    start: str = "first_frame",
    end: str = "last_frame",
) -> DataFrame:
    """Shifts per key: spans joined over short absences, short shifts dropped afterwards, numbered from 0."""
    joined = with_length(coalesce_intervals(spans, keys, start, end, frames(gap_seconds, fps)))
    if min_seconds > 0 and fps > 0:
        joined = joined.where(F.col("n_frames") >= frames(min_seconds, fps, least=1))
    return numbered(joined, keys, "shift")


def timed(df: DataFrame, fps: float) -> DataFrame:
    """Adds start, end and duration in seconds; the end is that of the last frame."""
    return (
        df.withColumn("start_time_s", seconds("start_frame", fps))
        .withColumn("end_time_s", seconds(F.col("end_frame") + 1, fps))
        .withColumn("duration_s", seconds("n_frames", fps))
    )


def shift_summary(found: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Per key: shifts, fragments, total, longest and mean seconds, first and last frame."""
    return (
        found.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_shifts"),
            F.sum("n_fragments").alias("n_fragments"),
            F.sum("n_frames").alias("total_frames"),
            F.max("n_frames").alias("longest_frames"),
            F.min("start_frame").alias("first_frame"),
            F.max("end_frame").alias("last_frame"),
        )
        .withColumn("total_seconds", seconds("total_frames", fps))
        .withColumn("longest_seconds", seconds("longest_frames", fps))
        .withColumn("avg_seconds", seconds(F.col("total_frames") / F.col("n_shifts"), fps))
    )


def total_live_seconds(segs: DataFrame, keys: list[str], fps: float) -> DataFrame:
    return segs.groupBy(*keys).agg(seconds(F.sum("n_frames"), fps, None).alias("live_seconds"))


def savings(live: Column | str, total: Column | str) -> Column:
    """The share of time that is skipped; 0 when there is none at all."""
    live = F.col(live) if isinstance(live, str) else live
    total = F.col(total) if isinstance(total, str) else total
    return F.when(total > 0, F.lit(1.0) - live / total).otherwise(F.lit(0.0))


def frame_segments(segs: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """Every frame of the spine with its segment or null; a later segment wins where two overlap."""
    inside = segs.select(*keys, "segment", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    inside = inside.groupBy(*keys, "frame").agg(F.max("segment").alias("segment"))
    return spine.join(inside, [*keys, "frame"], "left")


def overlap_pairs(spans: DataFrame, keys: list[str], id_col: str, start: str, end: str, min_gap: int = 0) -> DataFrame:
    """Pairs a < b of a key that cannot be one: the spans overlap or are at most ``min_gap`` apart.

    A sort-merge join on the keys with the overlap as its condition.
    """
    left = spans.select(*keys, F.col(id_col).alias("a"), F.col(start).alias("a_start"), F.col(end).alias("a_end"))
    right = spans.select(*keys, F.col(id_col).alias("b"), F.col(start).alias("b_start"), F.col(end).alias("b_end"))
    conflict = F.greatest("a_start", "b_start") <= F.least("a_end", "b_end") + min_gap
    return left.join(right, keys).where((F.col("a") < F.col("b")) & conflict)


def overlap_pairs_bucketed(
    spans: DataFrame, keys: list[str], id_col: str, start: str, end: str, width: int, min_gap: int = 0
) -> DataFrame:
    """As ``overlap_pairs`` for large keys: spans meet only in time buckets of ``width`` that both touch.

    A pair is kept in the bucket where its overlap begins, so it appears once.
    """
    reach = F.col(end) + min_gap
    spread = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), reach) / width))).alias("_bucket")
    left = spans.select(*keys, F.col(id_col).alias("a"), F.col(start).alias("a_start"), F.col(end).alias("a_end"), spread)
    right = spans.select(*keys, F.col(id_col).alias("b"), F.col(start).alias("b_start"), F.col(end).alias("b_end"), spread)
    begin = F.greatest("a_start", "b_start")
    conflict = (begin <= F.least("a_end", "b_end") + min_gap) & (F.floor(begin / width) == F.col("_bucket"))
    return left.join(right, [*keys, "_bucket"]).where((F.col("a") < F.col("b")) & conflict).drop("_bucket")


def peak_concurrency(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per key the largest number of spans that are open at once (inclusive ends).

    Changes are summed by time before the running sum, so a key's window is as long as its
    number of different times.
    """
    open_ = spans.select(*keys, F.col(start).alias("t"), F.lit(1).alias("d"))
    close = spans.select(*keys, (F.col(end) + 1).alias("t"), F.lit(-1).alias("d"))
    steps = open_.unionByName(close).groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    running = F.sum("d").over(Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    peaks = steps.withColumn("n", running)
    return peaks.groupBy(*keys).agg(F.max("n").alias("peak")) if keys else peaks.agg(F.max("n").alias("peak"))


def live_timeline(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``live_start``: the frames of live play before each segment."""
    order = Window.partitionBy(*keys).orderBy("start_frame").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end_frame") - F.col("start_frame") + 1
    return segs.withColumn("live_start", F.coalesce(F.sum(length).over(order), F.lit(0)))


#: Frames of a bucket in which points meet segments: segments of seconds come by the dozen in one.
LOOKUP_WIDTH = 4096


def _in_buckets(timeline: DataFrame, keys: list[str], start: str) -> DataFrame:
    """The keys, ``_bucket`` and ``_seg`` of each segment, once for each bucket it reaches from ``start`` on."""
    last = F.col(start) + F.col("end_frame") - F.col("start_frame")
    buckets = F.sequence(F.floor(F.col(start) / LOOKUP_WIDTH), F.floor(last / LOOKUP_WIDTH))
    return timeline.select(*keys, F.explode(buckets).alias("_bucket"), F.struct("live_start", "start_frame", "end_frame").alias("_seg"))


def to_live(points: DataFrame, timeline: DataFrame, keys: list[str], frame: str = "frame", strict: bool = True) -> DataFrame:
    """Adds ``live_frame``. A frame in no segment raises with ``strict`` and is null otherwise.

    An equi-join on the keys and a bucket of frames, with the bounds as its condition, so a
    long game spreads over tasks and a point only meets the segments near it.
    """
    bounds = _in_buckets(timeline, keys, "start_frame")
    at = points.withColumn("_bucket", F.floor(F.col(frame) / LOOKUP_WIDTH)).alias("p")
    inside = F.col(f"p.{frame}").between(F.col("t._seg.start_frame"), F.col("t._seg.end_frame"))
    for k in [*keys, "_bucket"]:
        inside = inside & (F.col(f"p.{k}") == F.col(f"t.{k}"))
    live = F.col("t._seg.live_start") + F.col(f"p.{frame}") - F.col("t._seg.start_frame")
    if strict:
        live = F.coalesce(live, F.raise_error(F.concat(F.lit("frame outside all segments: "), F.col(f"p.{frame}"))).cast("long"))
    return at.join(bounds.alias("t"), inside, "left").select(*[F.col(f"p.{c}") for c in points.columns], live.alias("live_frame"))


def to_game(points: DataFrame, timeline: DataFrame, keys: list[str], live: str = "live_frame") -> DataFrame:
    """Adds ``game_frame``: a live frame back on the game axis, up to the end of its segment.

    A live frame before the first segment belongs to it, one after the last to the last. The
    live axis has no gaps, so the lookup is an equi-join on the keys and a bucket of live frames.
    A point whose keys have no segments gets null.
    """
    total = timeline.groupBy(*keys).agg(F.max(F.col("live_start") + F.col("end_frame") - F.col("start_frame")).alias("_most"))
    held = F.greatest(F.lit(0), F.least(F.col(live), F.col("_most")))
    at = points.join(total, keys, "left") if keys else points.crossJoin(F.broadcast(total))
    at = at.withColumn("_held", held).withColumn("_bucket", F.floor(F.col("_held") / LOOKUP_WIDTH)).alias("p")
    begin = F.col("t._seg.live_start")
    inside = F.col("p._held").between(begin, begin + F.col("t._seg.end_frame") - F.col("t._seg.start_frame"))
    for k in [*keys, "_bucket"]:
        inside = inside & (F.col(f"p.{k}") == F.col(f"t.{k}"))
    game = F.least(F.col("t._seg.end_frame"), F.col("t._seg.start_frame") + F.col(f"p.{live}") - begin)
    found = at.join(_in_buckets(timeline, keys, "live_start").alias("t"), inside, "left")
    return found.select(*[F.col(f"p.{c}") for c in points.columns], F.when(F.col("t._seg").isNotNull(), game).alias("game_frame"))
