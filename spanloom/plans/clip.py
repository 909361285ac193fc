"""One pass over the detections of any number of clips: tracks, activity, teams, identities, shifts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import element_medians, kit_chroma_column, torso_hsv_column
from ..functions.scalars import seconds
from ..operators import activity, clustering, intervals, rollups, tracks, vectors, votes

KEYS = ["game_id"]


@dataclass
class ClipTables:
    """Lazy tables of a run, each keyed by ``game_id``."""

    tracks: DataFrame
    activity: DataFrame
    segments: DataFrame
    shifts: DataFrame
    players: DataFrame
    boxscore: DataFrame
    identities: DataFrame
    heat: DataFrame
    crops: DataFrame

    def release(self) -> None:
        """Give up what was persisted, once the tables are written."""
        self.activity.unpersist()
        self.tracks.unpersist()


def presence_run(detections: DataFrame, fps: float, min_confidence: float = 0.3, teams: DataFrame | None = None) -> DataFrame:
    """The first phase: tracks with presence, and with per-detection ``teams`` (game_id, frame,
    track_id, team) the team most of them say, of equal ones the one said first."""
    seen = tracks.tracked(tracks.people(detections, min_confidence))
    found = tracks.presence(seen, [*KEYS, "track_id"], fps)
    if teams is None:
        return found
    return found.join(votes.majority(teams, [*KEYS, "track_id"], "team", seen="frame").drop("weight"), [*KEYS, "track_id"], "left")


def track_colors(crops: DataFrame) -> DataFrame:
    """``hsv`` and ``chroma`` of each track: the medians over its crops (pixels, height, width)."""
    on_track = [*KEYS, "track_id"]
    measured = crops.select(*on_track, torso_hsv_column("pixels", "height", "width").alias("hsv"), kit_chroma_column("pixels", "height", "width").alias("chroma"))
    seen = measured.where("hsv IS NOT NULL AND chroma IS NOT NULL")
    return seen.groupBy(*on_track).agg(element_medians("hsv", 3).alias("hsv"), element_medians("chroma", 2).alias("chroma"))


def analyse(
    detections: DataFrame,
    clips: DataFrame,
    embeddings: DataFrame | None,
    fps: float,
    width: int,
    height: int,
    mask: DataFrame | None = None,
    min_confidence: float = 0.25,
    roster: int | None = None,
    distance: float = clustering.IDENTITY_DISTANCE,
    gap_seconds: float = 15.0,
    min_segment_seconds: float = 2.0,
    bridge_seconds: float = 1.0,
    min_players: int = 5,
    min_spread: float = 0.15,
    smooth_window: int = 15,
    colors: DataFrame | None = None,
    with_teams: bool = True,
    with_identities: bool = True,
    crops_per_track: int = tracks.CROPS_PER_TRACK,
) -> ClipTables:
    """The second phase of all ``clips``, which share a rate and a frame size.

    ``embeddings`` has one vector per crop: game_id, track_id, embedding. With ``colors``, such as
    those of ``track_colors``, teams follow the kits if these split clearly, and team 0 is the
    more saturated one; without, the numbers of teams are arbitrary. Without embeddings, or if
    not asked for, there are no teams and no identities.

    The flags per frame and the finished tracks feed several tables each and are persisted on
    first use, so detections are scanned for them once; call ``release`` when the tables are
    written.
    """
    on_track = [*KEYS, "track_id"]
    people = tracks.with_geometry(tracks.people(detections, min_confidence))
    seen = tracks.with_surface(tracks.tracked(people), mask, width, height)
    on_surface = seen.where("on_surface")
    flags = activity.detect_activity(on_surface, activity.frame_spine(clips, KEYS), KEYS, width, min_players, min_spread, smooth_window).persist()
    segs = intervals.timed(intervals.segments(flags, KEYS, fps, min_segment_seconds, bridge_seconds), fps)
    stats = tracks.with_role(tracks.track_stats(seen, on_track))
    live = activity.active_frames(seen, flags, KEYS)
    stats = stats.join(live, on_track, "left").withColumn("active_frames", F.coalesce("active_frames", F.lit(0).cast("long")))
    players = stats.where("role = 'player'")
    if embeddings is None:
        embeddings = detections.sparkSession.createDataFrame([], "game_id long, track_id long, embedding array<double>")
    pooled = vectors.pooled(embeddings.join(players.select(*on_track), on_track, "left_semi"), on_track)
    known = pooled.join(players, on_track)
    to_split, to_link = (known if wanted else known.where("false") for wanted in (with_teams, with_identities))
    if colors is None:
        team = clustering.assign_teams(to_split, KEYS, "centroid", "median_area_px")
    else:
        to_split = to_split.join(colors.select(*on_track, "hsv", "chroma"), on_track)
        team = clustering.assign_teams(to_split, KEYS, "centroid", "median_area_px", "chroma", "hsv")
    who = clustering.assign_identities(to_link, KEYS, roster, distance, vector="centroid").select(*on_track, "player", "player_conf")
    every = stats.join(team, on_track, "left").join(who, on_track, "left")
    every = every.withColumn("seconds_on_surface", seconds("on_surface_frames", fps)).withColumn("active_seconds", seconds("active_frames", fps))
    every = every.persist()
    identified = every.where("player IS NOT NULL")
    found = intervals.timed(intervals.shifts(identified, [*KEYS, "player"], fps, gap_seconds), fps)
    line = player_lines(identified, found, fps)
    header = (
        clips.select(*KEYS, F.lit(float(fps)).alias("fps"), F.col("total_frames").alias("frames"))
        .join(segs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_segments"), seconds(F.sum("n_frames"), fps).alias("live_play_s")), KEYS, "left")
        .join(activity.activity_summary(flags, KEYS).select(*KEYS, F.bround("active_fraction", 4).alias("active_fraction")), KEYS, "left")
        .join(every.where("role = 'spectator'").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_spectators")), KEYS, "left")
        .na.fill(0)
        .withColumn("surface_found", F.lit(mask is not None))
    )
    score = rollups.boxscore(every.where("role = 'player'"), KEYS, header, fps)
    centroids = vectors.identity_centroids(pooled.join(who.select(*on_track, "player"), on_track), [*KEYS, "player"])
    crops = tracks.sample_crops(seen, on_track, per_track=crops_per_track)
    teams_of_shifts = found.join(line.select(*KEYS, "player", "team"), [*KEYS, "player"], "left")
    return ClipTables(every, flags, segs, teams_of_shifts, line, score, centroids, tracks.heat(on_surface, width, height, KEYS), crops)


def player_lines(identified: DataFrame, found: DataFrame, fps: float) -> DataFrame:
    """One line per identity: the weighted team vote, sums over tracks, and its shifts."""
    who = [*KEYS, "player"]
    team = votes.majority(identified, who, "team", votes.frames_weight()).drop("weight")
    line = rollups.player_rollup(identified, who, fps).drop("on_surface_frames", "active_frames")
    shifts = intervals.shift_summary(found, who, fps).select(
        *who,
        "n_shifts",
        F.col("total_seconds").alias("shift_seconds"),
        F.col("longest_seconds").alias("longest_shift_s"),
        F.col("avg_seconds").alias("avg_shift_s"),
    )
    return line.join(team, who, "left").join(shifts, who, "left")
