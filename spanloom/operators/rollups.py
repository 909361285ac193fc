"""Roll-ups of tracks, shifts and players: player lines, team totals, box score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import joined_ids, lenient_double, lenient_team, safe_ratio, seconds

SCHEMA_VERSION = 1


def player_rollup(tracks: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Fragments, frames, seconds (of the summed frames), bounds, ids and mean confidence per identity."""
    return (
        tracks.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_fragments"),
            joined_ids("track_id", "first_frame", "track_id").alias("track_ids"),
            F.sum("frames_seen").alias("frames_seen"),
            F.sum("on_surface_frames").alias("on_surface_frames"),
            F.sum("active_frames").alias("active_frames"),
            F.min("first_frame").alias("first_frame"),
            F.max("last_frame").alias("last_frame"),
            F.bround(F.avg("player_conf"), 2).alias("mean_conf"),
        )
        .withColumn("seconds_on_surface", seconds("on_surface_frames", fps))
        .withColumn("active_seconds", seconds("active_frames", fps))
    )


def team_totals(tracks: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Tracks per team with sums of the rounded seconds of each; no team is a team of its own."""
    return tracks.groupBy(*keys, "team").agg(
        F.count(F.lit(1)).alias("n_players"),
        F.bround(F.sum(seconds("active_frames", fps)), 2).alias("active_s"),
        F.bround(F.sum(seconds("on_surface_frames", fps)), 2).alias("on_surface_s"),
    )


def team_totals_from_players(players: DataFrame, keys: list[str]) -> DataFrame:
    """Identities per team, from the text columns of a players table."""
    rows = players.withColumn("team", lenient_team("team"))
    return rows.groupBy(*keys, "team").agg(
        F.count(F.lit(1)).alias("n_players"),
        F.bround(F.sum(lenient_double("active_seconds")), 2).alias("active_s"),
        F.bround(F.sum(lenient_double("seconds_on_surface")), 2).alias("on_surface_s"),
    )


def team_active_seconds(tracks: DataFrame, keys: list[str], fps: float | None = None) -> DataFrame:
    """Live seconds of players per team; without ``fps`` the tracks have their seconds already."""
    players = tracks.where("role = 'player'")
    own = F.col("active_seconds") if fps is None else seconds("active_frames", fps)
    return players.groupBy(*keys, "team").agg(F.bround(F.sum(own), 2).alias("active_s"))


def player_records(players: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Box-score lines of players."""
    return players.select(
        *keys,
        "track_id",
        "team",
        seconds("active_frames", fps).alias("active_s"),
        seconds("on_surface_frames", fps).alias("on_surface_s"),
        seconds("frames_seen", fps).alias("seen_s"),
        F.bround(safe_ratio("on_surface_frames", "frames_seen"), 3).alias("on_surface_frac"),
        "median_area_px",
        "active_frames",
        "frames_seen",
    )


def boxscore_levels(tracks: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Game, team and track lines in one pass of grouping sets; ``level`` is game, team or track."""
    rows = tracks.withColumn("_active", seconds("active_frames", fps)).withColumn("_seen", seconds("on_surface_frames", fps))
    game = [F.col(k) for k in keys]
    sets = [game, [*game, F.col("team")], [*game, F.col("team"), F.col("track_id")]]
    level = F.when(F.grouping("team") == 1, "game").when(F.grouping("track_id") == 1, "team").otherwise("track")
    return rows.groupingSets(sets, *keys, "team", "track_id").agg(
        level.alias("level"),
        F.count(F.lit(1)).alias("n_players"),
        F.bround(F.sum("_active"), 2).alias("active_s"),
        F.bround(F.sum("_seen"), 2).alias("on_surface_s"),
    )


def boxscore(
    players: DataFrame,
    keys: list[str],
    header: DataFrame,
    fps: float,
) -> DataFrame:
    """One row per game: ``schema_version, game, teams, players`` as nested columns.

    ``header`` has one row per game with the fields of ``game``: frames, live play, segments,
    active fraction, surface found, spectators. Lines are bounded by the players of a game.
    """
    teams = team_totals(players, keys, fps).groupBy(*keys).agg(
        F.expr(
            "transform(array_sort(collect_list(struct(team IS NULL AS last, team, n_players, active_s, on_surface_s))), "
            "x -> struct(x.team, x.n_players, x.active_s, x.on_surface_s))"
        ).alias("teams")
    )
    order = "struct(-active_frames AS a, -frames_seen AS b, track_id AS c, struct(track_id, team, active_s, on_surface_s, seen_s, on_surface_frac, median_area_px) AS line)"
    lines = player_records(players, keys, fps).groupBy(*keys).agg(
        F.expr(f"transform(array_sort(collect_list({order})), x -> x.line)").alias("players"), F.count(F.lit(1)).alias("_n")
    )
    joined = header.join(teams, keys, "left").join(lines, keys, "left")
    fields = [c for c in header.columns if c not in keys]
    game = F.struct(*fields, seconds("frames", fps).alias("duration_s"), F.coalesce("_n", F.lit(0)).alias("n_players"))
    return joined.select(*keys, F.lit(SCHEMA_VERSION).alias("schema_version"), game.alias("game"), "teams", "players")


def team_order(team: str = "team") -> Column:
    """Teams ascending, no team last."""
    return F.col(team).asc_nulls_last()
