"""Sinks: Parquet is the canonical form; CSV and JSON files are for people and other tools."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip_filename, seconds
from ..operators.rollups import team_active_seconds
from . import schemas


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def csv(
    df: DataFrame, path: str, ddl: str, order: list[Column | str], extra: list[str] | None = None, by: list[str] | None = None
) -> None:
    """One ordered CSV file with a header, or one in a folder for each value of ``by``. For tables
    of a game's size; nulls are blank cells."""
    columns = [F.col(c) for c in [*schemas.names(ddl), *(extra or [])]]
    if by:
        rows = df.select(*by, *columns).repartition(*by).sortWithinPartitions(*by, *order)
        rows.write.mode("overwrite").option("header", True).partitionBy(*by).csv(path)
    else:
        df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def presence_csv(tracks: DataFrame, path: str, with_team: bool = False, by: list[str] | None = None) -> None:
    csv(tracks, path, schemas.PRESENCE, [F.desc("seconds_on_surface"), "track_id"], ["team"] if with_team else [], by)


def tracks_csv(tracks: DataFrame, path: str, fps: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Write tracks, live ones first; team and player are blank for spectators. Returns live seconds per team.

    Without ``fps`` the tracks have their seconds already.
    """
    player = F.col("role") == "player"
    shown = tracks
    for c in ("team", "team_conf", "player", "player_conf"):
        shown = shown.withColumn(c, F.when(player, F.col(c)))
    if fps is not None:
        shown = shown.withColumn("seconds_on_surface", seconds("on_surface_frames", fps)).withColumn("active_seconds", seconds("active_frames", fps))
    csv(shown, path, schemas.TRACKS, [F.desc("active_seconds"), "track_id"], by=by)
    return team_active_seconds(tracks, by or [], fps)


def players_csv(players: DataFrame, path: str, by: list[str] | None = None) -> None:
    csv(players, path, schemas.PLAYERS, [F.desc("active_seconds"), "player"], by=by)


def shifts_csv(found: DataFrame, path: str, by: list[str] | None = None) -> None:
    csv(found, path, schemas.SHIFTS, ["player", "shift"], by=by)


def segments_csv(segs: DataFrame, path: str, by: list[str] | None = None) -> None:
    csv(segs, path, schemas.SEGMENTS, ["segment"], by=by)


def segments_document(segs: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and the JSON text of each clip's segment list: fps, counts, the extras, then the segments.

    ``extra`` has one row a clip with ``fps`` and the further fields.
    """
    line = F.struct(*schemas.names(schemas.SEGMENTS))
    whole = segs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("n_frames").alias("_live"), F.array_sort(F.collect_list(line)).alias("segments")
    )
    joined = extra.join(whole, keys, "left") if keys else extra.crossJoin(whole)
    live = F.bround(F.coalesce(seconds("_live", F.col("fps"), None), F.lit(0.0)), 2).alias("live_seconds")
    fields = [F.round("fps", 3).alias("fps"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"), live]
    fields += [F.col(c) for c in extra.columns if c not in ("fps", *keys)]
    empty = F.array().cast(segs.select(F.array(line)).schema[0].dataType)
    return joined.select(*keys, F.to_json(F.struct(*fields, F.coalesce("segments", empty).alias("segments"))).alias("value"))


def json_text(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write rows of one text column, such as a document of ``to_json``, or one file for each value of ``by``."""
    if by:
        df.select(*by, "value").repartition(*by).write.mode("overwrite").partitionBy(*by).text(path)
    else:
        df.select("value").coalesce(1).write.mode("overwrite").text(path)


def boxscore_json(score: DataFrame, path: str, keys: list[str], by: list[str] | None = None) -> None:
    fields = [c for c in score.columns if c not in keys]
    json_text(score.select(*keys, F.to_json(F.struct(*fields)).alias("value")), path, by)


def label_template(tracks: DataFrame, crops: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A table for a person to fill in, with predictions as hints, for tracks that have a crop."""
    blank, on_track = F.lit(""), [*(keys or []), "track_id"]
    with_crop = tracks.join(crops.select(*on_track).distinct(), on_track, "left_semi")
    return with_crop.select(
        *(keys or []),
        "track_id",
        blank.alias("team"),
        blank.alias("role"),
        blank.alias("player"),
        F.coalesce(F.col("team").cast("string"), blank).alias("pred_team"),
        F.col("role").alias("pred_role"),
        "frames_seen",
        "seconds_on_surface",
        "median_area_px",
        F.format_string("track_%03d.jpg", F.col("track_id").cast("int")).alias("crop"),
    )


def cut_plan(segs: DataFrame, reencode: bool = False, keys: list[str] | None = None) -> DataFrame:
    """What to cut from a video: start, duration and file name of each segment, and whether to
    encode anew (exact to the frame) or to copy the stream."""
    return segs.select(
        *(keys or []),
        "segment",
        F.col("start_time_s").alias("start_s"),
        "duration_s",
        clip_filename("segment", "start_time_s", "end_time_s").alias("filename"),
        F.lit(reencode).alias("reencode"),
    )


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version of a table that ``df`` may itself read, then put it in place of the old one.

    The old version is renamed aside first and deleted last, so one of the two is always whole.
    """
    spark = df.sparkSession
    new = f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).csv(new)
    hadoop = spark._jvm.org.apache.hadoop.fs
    old_path, new_path = hadoop.Path(path), hadoop.Path(new)
    fs = old_path.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = hadoop.Path(f"{path}.{uuid.uuid4().hex}.old")
    if fs.exists(old_path) and not fs.rename(old_path, aside):
        raise OSError(f"cannot move {path} aside; the new version is {new}")
    if not fs.rename(new_path, old_path):
        if fs.exists(aside):
            fs.rename(aside, old_path)
        raise OSError(f"cannot put {new} in place of {path}")
    fs.delete(aside, True)
