"""A whole game from several segments: identities across segments and merged statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..operators import clustering, game


@dataclass
class GameTables:
    mapping: DataFrame
    players: DataFrame
    shifts: DataFrame
    header: DataFrame


def merge_segments(
    tracks: DataFrame,
    identities: DataFrame,
    segments: DataFrame,
    keys: list[str],
    fps: float,
    total_frames: Column | int,
    roster: int | None = None,
    distance: float = clustering.IDENTITY_DISTANCE,
    gap_seconds: float = 15.0,
    max_segments: int | None = None,
) -> GameTables:
    """Merge the tables of all segments of each game.

    ``tracks`` holds every segment's track table with its segment, ``identities`` one centroid
    per segment and local identity. Segments are independent until here, so they run as one
    grouped job rather than one after the other.
    """
    chosen = game.first_segments(segments, keys, max_segments)
    mapping = clustering.merge_segment_identities(identities.join(chosen.select(*keys, "segment"), [*keys, "segment"], "left_semi"), keys, roster, distance)
    placed = game.mapped_tracks(tracks, chosen, mapping, keys)
    found = game.game_shifts(placed, chosen, keys, fps, gap_seconds)
    players = game.game_players(placed, found, keys, fps)
    teams = players.select(*keys, "player", "team")
    return GameTables(mapping, players, found.join(teams, [*keys, "player"], "left"), game.game_header(chosen, players, keys, fps, total_frames))
