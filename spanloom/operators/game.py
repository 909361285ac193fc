"""Several segments of one game as one: identities, the live axis, merged players and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import joined_ids, lenient_int, lenient_team, seconds
from .intervals import live_timeline, numbered, shifts, to_game, to_live
from .votes import majority


def mapped_tracks(tracks: DataFrame, segs: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Tracks of players with a game-wide identity, on game frames held inside their segment.

    ``tracks`` has ``segment, track_id, role, team, player`` and local frames; ``mapping`` has
    ``segment, local_id, player``.
    """
    local = tracks.where("role = 'player'").withColumn("local_id", lenient_int("player")).where("local_id IS NOT NULL").drop("player")
    joined = local.join(mapping.select(*keys, "segment", "local_id", "player"), [*keys, "segment", "local_id"])
    bounds = segs.select(*keys, "segment", F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"))
    at = joined.join(bounds, [*keys, "segment"])
    return at.select(
        *keys,
        "segment",
        "player",
        F.format_string("s%d:%s", F.col("segment").cast("int"), F.col("track_id").cast("string")).alias("track_id"),
        lenient_team("team").alias("team"),
        "frames_seen",
        "active_seconds",
        "seconds_on_surface",
        F.least(F.col("_s") + F.col("first_frame"), F.col("_e")).alias("first_frame"),
        F.least(F.col("_s") + F.col("last_frame"), F.col("_e")).alias("last_frame"),
    )


def on_live_axis(tracks: DataFrame, segs: DataFrame, keys: list[str]) -> DataFrame:
    timeline = live_timeline(segs, keys)
    first = to_live(tracks, timeline, keys, "first_frame").withColumnRenamed("live_frame", "live_first")
    return to_live(first, timeline, keys, "last_frame").withColumnRenamed("live_frame", "live_last")


def game_shifts(tracks: DataFrame, segs: DataFrame, keys: list[str], fps: float, gap_seconds: float = 15.0) -> DataFrame:
    """Shifts found on the axis of live play, with bounds mapped back to game frames.

    Lengths and durations stay those of live play, so a shift across a stoppage is shorter than
    the distance between its bounds.
    """
    live = on_live_axis(tracks, segs, keys)
    found = shifts(live, [*keys, "player"], fps, gap_seconds, start="live_first", end="live_last")
    timeline = live_timeline(segs, keys)
    found = found.withColumnRenamed("start_frame", "live_start_frame").withColumnRenamed("end_frame", "live_end_frame")
    found = to_game(found, timeline, keys, "live_start_frame").withColumnRenamed("game_frame", "start_frame")
    found = to_game(found, timeline, keys, "live_end_frame").withColumnRenamed("game_frame", "end_frame")
    return (
        found.withColumn("start_time_s", seconds("start_frame", fps))
        .withColumn("end_time_s", seconds(F.col("end_frame") + 1, fps))
        .withColumn("duration_s", seconds("n_frames", fps))
    )


def game_players(tracks: DataFrame, found: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """One line per game player: the vote on the team, sums of rounded seconds, bounds and ids."""
    who = [*keys, "player"]
    team = majority(tracks, who, "team", F.greatest(F.lit(1), F.col("frames_seen"))).drop("weight")
    sums = tracks.groupBy(*who).agg(
        F.count(F.lit(1)).alias("n_fragments"),
        joined_ids("track_id", "segment", "first_frame", "track_id").alias("track_ids"),
        F.sum("frames_seen").alias("frames_seen"),
        F.bround(F.sum("seconds_on_surface"), 2).alias("seconds_on_surface"),
        F.bround(F.sum("active_seconds"), 2).alias("active_seconds"),
        F.min("first_frame").alias("first_frame"),
        F.max("last_frame").alias("last_frame"),
    )
    by_shift = found.groupBy(*who).agg(
        F.count(F.lit(1)).alias("n_shifts"),
        seconds(F.sum("n_frames"), fps).alias("shift_seconds"),
        seconds(F.max("n_frames"), fps).alias("longest_shift_s"),
        seconds(F.avg("n_frames"), fps).alias("avg_shift_s"),
    )
    return sums.join(team, who, "left").join(by_shift, who, "left")


def game_header(segs: DataFrame, players: DataFrame, keys: list[str], fps: float, total_frames: Column | int) -> DataFrame:
    """Duration, live play, segments, players and the active share of a game; ``total_frames`` may be a column of ``segs``."""
    total = total_frames if isinstance(total_frames, Column) else F.lit(total_frames)
    live = segs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("_live"), F.max(total).alias("_total")
    )
    who = players.groupBy(*keys).agg(F.count_distinct("player").alias("n_players"))
    return live.join(who, keys, "left").select(
        *keys,
        seconds("_total", fps).alias("duration_s"),
        seconds("_live", fps).alias("live_play_s"),
        "n_segments",
        F.coalesce("n_players", F.lit(0)).alias("n_players"),
        F.bround(F.coalesce(F.try_divide(F.col("_live"), F.col("_total")), F.lit(0.0)), 4).alias("active_fraction"),
    )


def first_segments(segs: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """The first ``n`` segments in time of each game, or all."""
    return segs if n is None else numbered(segs, keys, "_at").where(F.col("_at") < n).drop("_at")


def cannot_link(identities: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of identities of one segment, which can never be one player."""
    left = identities.select(*keys, "segment", F.col("local_id").alias("a"))
    right = identities.select(*keys, "segment", F.col("local_id").alias("b"))
    return left.join(right, [*keys, "segment"]).where(F.col("a") < F.col("b"))
