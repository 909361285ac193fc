"""Activity per frame: people, spread, live flags, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_spine(clips: DataFrame, keys: list[str], total: str = "total_frames") -> DataFrame:
    """Every frame of every clip, with or without detections."""
    return clips.where(F.col(total) > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col(total) - 1)).alias("frame"))


def people_per_frame(detections: DataFrame, spine: DataFrame, keys: list[str], on: str | None = None) -> DataFrame:
    """``n`` per frame of the spine, 0 where nobody is seen."""
    seen = detections if on is None else detections.where(on)
    counts = seen.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, [*keys, "frame"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def frame_activity(
    detections: DataFrame, spine: DataFrame, keys: list[str], width: float, min_players: int = 5, min_spread: float = 0.15
) -> DataFrame:
    """People, horizontal spread (population deviation of foot x over the width) and the raw live flag."""
    per_frame = detections.groupBy(*keys, "frame").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col("foot_x").cast("double")).alias("_std")
    )
    spread = F.when(F.col("n") >= 2, F.col("_std") / F.lit(float(width))).otherwise(F.lit(0.0))
    return (
        spine.join(per_frame, [*keys, "frame"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        .withColumn("spread", spread)
        .drop("_std")
        .withColumn("raw_active", (F.col("n") >= min_players) & (F.col("spread") >= min_spread))
    )


def majority_smooth(flags: DataFrame, keys: list[str], window: int, flag: str = "raw_active", out: str = "active") -> DataFrame:
    """Centred majority over ``window`` frames, cut at the ends; a tie is live, one frame changes nothing."""
    if window <= 1:
        return flags.withColumn(out, F.col(flag))
    half = window // 2
    around = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-half, half)
    return flags.withColumn(out, F.avg(F.col(flag).cast("double")).over(around) >= 0.5)


def detect_activity(
    detections: DataFrame,
    spine: DataFrame,
    keys: list[str],
    width: float,
    min_players: int = 5,
    min_spread: float = 0.15,
    smooth_window: int = 15,
) -> DataFrame:
    return majority_smooth(frame_activity(detections, spine, keys, width, min_players, min_spread), keys, smooth_window)


def activity_summary(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the frames of a clip; 0 without frames."""
    found = {"active_fraction": F.avg(F.col("active").cast("double")), "mean_players": F.avg("n"), "mean_spread": F.avg("spread")}
    columns = [F.coalesce(v, F.lit(0.0)).alias(k) for k, v in found.items()]
    return flags.groupBy(*keys).agg(*columns) if keys else flags.agg(*columns)


def active_frames(detections: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Per track the number of its detections, anywhere, in live frames."""
    live = flags.where("active").select(*keys, "frame")
    return detections.join(live, [*keys, "frame"], "left_semi").groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("active_frames"))


def strided(detections: DataFrame, stride: int) -> DataFrame:
    """Detections of every ``stride``-th frame, with the number of the sample."""
    return detections.where(F.col("frame") % stride == 0).withColumn("sample", F.floor(F.col("frame") / stride))
