"""Detections to tracks: filters, foot points, surface test, presence, roles, sampling, heat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rounded_position, safe_ratio, seconds, truncated_position

#: What makes a track a player.
MIN_FRAMES_SEEN, MIN_SURFACE_FRACTION = 15, 0.5
#: Which detections are cropped.
MIN_CROP_AREA, CROP_STRIDE, CROPS_PER_TRACK, MIN_CROP_HEIGHT, MIN_CROP_WIDTH = 1500, 10, 6, 20, 10


def people(detections: DataFrame, min_confidence: float, person_class: int = 0) -> DataFrame:
    """Class and confidence filter; both reach the scan."""
    return detections.where((F.col("class_id") == person_class) & (F.col("conf") >= min_confidence))


def tracked(detections: DataFrame) -> DataFrame:
    return detections.where(F.col("track_id").isNotNull())


def with_geometry(detections: DataFrame) -> DataFrame:
    """Foot point (middle of the bottom edge, single precision) and box area."""
    return (
        detections.withColumn("foot_x", ((F.col("x1") + F.col("x2")) / 2).cast("float"))
        .withColumn("foot_y", F.col("y2").cast("float"))
        .withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    )


def with_surface(detections: DataFrame, mask: DataFrame | None, width: int, height: int) -> DataFrame:
    """``on_surface`` by a table of surface pixels (x, y); without one everything is on it.

    The mask has at most width x height rows, so the join leaves its strategy to Spark.
    """
    if mask is None:
        return detections.withColumn("on_surface", F.lit(True))
    pixels = mask.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct().withColumn("_hit", F.lit(True))
    at = detections.withColumn("_x", truncated_position("foot_x", width)).withColumn("_y", truncated_position("foot_y", height))
    return at.join(pixels, ["_x", "_y"], "left").withColumn("on_surface", F.coalesce("_hit", F.lit(False))).drop("_x", "_y", "_hit")


def presence(detections: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """First and last frame, frames seen and their seconds, per track."""
    return (
        detections.groupBy(*keys)
        .agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("frames_seen"))
        .withColumn("seconds_on_surface", seconds("frames_seen", fps))
    )


def track_stats(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Presence with surface frames and the median box area (interpolated, then truncated)."""
    return detections.groupBy(*keys).agg(
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.count(F.lit(1)).alias("frames_seen"),
        F.count_if("on_surface").alias("on_surface_frames"),
        F.median("area").cast("int").alias("median_area_px"),
    )


def with_role(stats: DataFrame, min_frames: int = MIN_FRAMES_SEEN, min_fraction: float = MIN_SURFACE_FRACTION) -> DataFrame:
    fraction = safe_ratio("on_surface_frames", "frames_seen")
    player = (F.col("frames_seen") >= min_frames) & (fraction >= min_fraction)
    return stats.withColumn("on_surface_frac", fraction).withColumn("role", F.when(player, "player").otherwise("spectator"))


def sample_crops(
    detections: DataFrame,
    keys: list[str],
    min_area: float = MIN_CROP_AREA,
    stride: int = CROP_STRIDE,
    per_track: int = CROPS_PER_TRACK,
) -> DataFrame:
    """The first crops of each track: every ``stride``-th of its detections that is large and on the surface.

    The ordinal counts all detections of the track; the limit counts those that pass.
    """
    order = Window.partitionBy(*keys).orderBy("frame")
    good = F.col("on_surface") & (F.col("area") >= min_area) & (F.col("_nth") % stride == 1)
    if {"x1", "y1", "x2", "y2"} <= set(detections.columns):
        good = good & (F.col("y2") - F.col("y1") > MIN_CROP_HEIGHT) & (F.col("x2") - F.col("x1") > MIN_CROP_WIDTH)
    numbered = detections.withColumn("_nth", F.row_number().over(order)).where(good)
    return numbered.withColumn("crop", F.row_number().over(order)).where(F.col("crop") <= per_track).drop("_nth")


def heat(detections: DataFrame, width: int, height: int, keys: list[str] | None = None) -> DataFrame:
    """Foot points by rounded pixel; those outside the frame are dropped."""
    at = detections.select(*(keys or []), rounded_position("foot_x").alias("xi"), rounded_position("foot_y").alias("yi"))
    inside = F.col("xi").between(0, width - 1) & F.col("yi").between(0, height - 1)
    return at.where(inside).groupBy(*(keys or []), "xi", "yi").agg(F.count(F.lit(1)).alias("n"))
