"""The game report: chart layout as a table, then text and HTML from bounded, collected rows."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from html import escape

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NO_TEAM_COLOR, TEAM_COLORS, bar_duration, clean_text, lenient_team, player_label
from ..operators.intervals import peak_concurrency

#: Pixels of a side of a cell of the heat map.
HEAT_CELL = 32


def chart_rows(shifts: DataFrame, names: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row per player: ``row, player, team, label, toi_s, n_shifts, longest_s, bars``.

    Teams come in order with no team last, then the most time first, then the player. Time is
    taken from the bounds of shifts, so it includes stoppages that a merged game's shift
    seconds leave out. The team is that of the player's first row. With ``keys`` a chart for
    each game; ``names`` has the keys too.
    """
    keys = keys or []
    rows = shifts.withColumn("_team", lenient_team("team")).withColumn("_bar", bar_duration("start_time_s", "end_time_s"))
    bars = F.array_sort(F.collect_list(F.struct(F.col("start_time_s").alias("start_s"), F.col("end_time_s").alias("end_s"))))
    players = rows.groupBy(*keys, "player").agg(
        F.min_by("_team", "shift").alias("team"),
        F.sum("_bar").alias("_toi"),
        F.count(F.lit(1)).alias("n_shifts"),
        F.max("_bar").alias("longest_s"),
        bars.alias("bars"),
    )
    name: Column = F.lit(None).cast("string")
    if names is not None:
        players = players.join(names.select(*keys, "player", F.nullif(clean_text("name"), F.lit("")).alias("name")), [*keys, "player"], "left")
        name = F.col("name")
    # The rows of a chart are the players of one game, so its window is bounded.
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("team").asc_nulls_last(), F.desc("_toi"), "player")
    return players.select(
        *keys,
        (F.row_number().over(order) - 1).alias("row"),
        "player",
        "team",
        player_label("player", name, F.col("team")).alias("label"),
        F.bround("_toi", 2).alias("toi_s"),
        "n_shifts",
        "longest_s",
        "bars",
    )


def presence_lines(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Tracks of each clip, and the most at once."""
    n = tracks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tracks"))
    return n.join(peak_concurrency(tracks, keys, "first_frame", "last_frame"), keys)


def heat_cells(heat: DataFrame) -> DataFrame:
    """The heat table (xi, yi, n) in cells of a picture: ``x, y, n``, at most a few thousand a frame."""
    at = [F.floor(F.col(c) / HEAT_CELL).cast("int").alias(a) for c, a in (("xi", "x"), ("yi", "y"))]
    return heat.groupBy(*at).agg(F.sum("n").alias("n"))


def chart_span(shifts: DataFrame, duration_s: float | None = None) -> float:
    """The chart's extent: the given duration, or else the end of the last shift."""
    if duration_s is not None:
        return float(duration_s)
    return float(shifts.agg(F.max("end_time_s")).first()[0] or 0.0)


def team_lines(players: DataFrame) -> DataFrame:
    """Players, seconds on the surface and live seconds per team, no team last."""
    return (
        players.groupBy(lenient_team("team").alias("team"))
        .agg(
            F.count(F.lit(1)).alias("n_players"),
            F.bround(F.sum(F.coalesce("shift_seconds", F.lit(0.0))), 2).alias("toi_s"),
            F.bround(F.sum(F.coalesce("active_seconds", F.lit(0.0))), 2).alias("active_s"),
        )
        .orderBy(F.col("team").asc_nulls_last())
    )


@dataclass
class Report:
    """Everything a report shows, collected; its size is that of a game's players and shifts."""

    title: str
    game: dict
    chart: list[dict]
    span_s: float
    teams: list[dict]
    players: list[dict] = field(default_factory=list)
    heat: list[dict] = field(default_factory=list)


def build_report(
    shifts: DataFrame, players: DataFrame, game: dict | None = None, title: str = "Game report", heat: DataFrame | None = None
) -> Report:
    names = players.select("player", "name") if "name" in players.columns else None
    chart = [r.asDict(recursive=True) for r in chart_rows(shifts, names).orderBy("row").collect()]
    game = game or {}
    lines = [r.asDict() for r in players.orderBy(F.desc("active_seconds"), "player").collect()]
    cells = [] if heat is None else [r.asDict() for r in heat_cells(heat).collect()]
    return Report(title, game, chart, chart_span(shifts, game.get("duration_s")), [r.asDict() for r in team_lines(players).collect()], lines, cells)


def _team(team: int | None) -> str:
    return "T?" if team is None else f"T{team}"


def report_text(report: Report) -> str:
    """A console table, players with the most time first."""
    g = report.game
    head = f"{report.title}: {len(report.chart)} players"
    if g:
        head += f", {g.get('duration_s') or 0:.0f} s, {g.get('live_play_s') or 0:.0f} s live in {g.get('n_segments') or 0} segment(s)"
    out = [head]
    out += [f"  {_team(t['team']):>3} {t['n_players']:3d} players {t['toi_s']:8.0f} s on surface {t['active_s']:8.0f} s active" for t in report.teams]
    out.append(f"  {'player':>8} {'team':>4} {'shifts':>6} {'time_s':>8} {'mean_s':>7} {'longest_s':>9}")
    for r in sorted(report.chart, key=lambda r: -r["toi_s"]):
        mean = r["toi_s"] / r["n_shifts"] if r["n_shifts"] else 0.0
        out.append(f"  {r['player']:>8} {_team(r['team']):>4} {r['n_shifts']:>6} {r['toi_s']:>8.1f} {mean:>7.1f} {r['longest_s']:>9.1f}")
    return "\n".join(out)


def boxscore_text(score: dict) -> str:
    g = score["game"]
    out = [f"Box score: {g['n_players']} players, {g.get('duration_s') or 0:.0f} s, {g.get('live_play_s') or 0:.0f} s live in {g.get('n_segments') or 0} segment(s)"]
    out += [f"  {_team(t['team']):>3} {t['n_players']:3d} players {t['active_s']:8.0f} s active" for t in score.get("teams") or []]
    out.append(f"  {'track':>8} {'team':>4} {'active_s':>9} {'surface_s':>10} {'share':>6}")
    for p in score.get("players") or []:
        out.append(f"  {p['track_id']:>8} {_team(p['team']):>4} {p['active_s']:>9.1f} {p['on_surface_s']:>10.1f} {p['on_surface_frac'] * 100:>5.0f}%")
    return "\n".join(out)


def game_text(header: dict, analysed: int, identities: int, players: int) -> str:
    return (
        f"Game: {header['duration_s']:.0f} s of video, {header['live_play_s']:.0f} s live in {header['n_segments']} segment(s), {analysed} analysed\n"
        f"{identities} identities of segments became {players} players"
    )


def evaluation_text(fields: list[dict], missing: dict[str, list] | None = None) -> str:
    """One line a field; of labelled tracks without a prediction the first ten."""
    if not fields:
        return "Evaluation: no labelled field"
    out = ["Evaluation:"]
    for f in fields:
        out.append(f"  {f['field']:8s} {f['accuracy'] * 100:5.1f} % ({f['correct']} of {f['n_overlap']}, {f['n_missing']} labelled but not predicted)")
        if f.get("mapping"):
            out.append(f"           map: {f['mapping']}")
        if lost := (missing or {}).get(f["field"]):
            out.append("           " + ", ".join(map(str, lost[:10])) + (f" (+{len(lost) - 10} more)" if len(lost) > 10 else ""))
    return "\n".join(out)


def applied_text(summary: dict, conflicts: list[dict]) -> str:
    out = [f"Labels: {summary['n_direct']} tracks tagged, {summary['n_propagated']} tags inherited"]
    out += [f"  {c['kind']} {c['key']}: {', '.join(c['labels'])}" for c in conflicts]
    return "\n".join(out)


def _table(head: list[str], rows: list[list[str]]) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table><tr>{''.join(f'<th>{escape(h)}</th>' for h in head)}</tr>{cells}</table>"


def chart_svg(report: Report, width: int = 900, bar: int = 18) -> str:
    """The shift chart as a picture: a line per player, a bar per shift."""
    span, left = max(report.span_s, 1e-9), 120
    parts = []
    for r in report.chart:
        y = r["row"] * bar
        color = TEAM_COLORS.get(r["team"], NO_TEAM_COLOR)
        parts.append(f'<text x="0" y="{y + bar - 5}" font-size="11">{escape(r["label"], quote=False)}</text>')
        for b in r["bars"]:
            x = left + b["start_s"] / span * (width - left)
            w = max(0.0, b["end_s"] - b["start_s"]) / span * (width - left)
            parts.append(f'<rect x="{x:.1f}" y="{y + 3}" width="{w:.1f}" height="{bar - 6}" fill="{color}"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{max(1, len(report.chart)) * bar}">{"".join(parts)}</svg>'


def heat_svg(report: Report, cell: int = 12) -> str:
    """Where players stood: a square a cell, the darker the more often."""
    most = max(c["n"] for c in report.heat)
    parts = [
        f'<rect x="{c["x"] * cell}" y="{c["y"] * cell}" width="{cell}" height="{cell}" fill="#c0392b" fill-opacity="{(c["n"] / most) ** 0.5:.3f}"/>'
        for c in sorted(report.heat, key=lambda c: (c["y"], c["x"]))
    ]
    width, height = ((max(c[k] for c in report.heat) + 1) * cell for k in ("x", "y"))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(parts)}</svg>'


def chart_png(report: Report, width: int = 900, bar: int = 18) -> bytes:
    """The bars of the shift chart as a PNG file, without text: a line per player in the chart's order."""
    span = max(report.span_s, 1e-9)
    picture = np.full((max(1, len(report.chart)) * bar, width, 3), 255, np.uint8)
    for r in report.chart:
        color = TEAM_COLORS.get(r["team"], NO_TEAM_COLOR).lstrip("#")
        top = r["row"] * bar
        for b in r["bars"]:
            left, right = (min(width, max(0, round(b[k] / span * width))) for k in ("start_s", "end_s"))
            picture[top + 3 : top + bar - 3, left:right] = list(bytes.fromhex(color))

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    lines = np.concatenate([np.zeros((len(picture), 1), np.uint8), picture.reshape(len(picture), -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, len(picture), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def report_html(report: Report) -> str:
    """A page by itself: header, chart, heat map, teams and players."""
    g = report.game
    cards = {k: g.get(k) for k in ("n_players", "duration_s", "live_play_s", "n_segments", "active_fraction", "fps") if g.get(k) is not None}
    teams = [[_team(t["team"]), str(t["n_players"]), f"{t['toi_s']:.1f}", f"{t['active_s']:.1f}"] for t in report.teams]
    columns = [c for c in ("name", "player", "team", "n_shifts", "shift_seconds", "avg_shift_s", "longest_shift_s", "active_seconds", "n_fragments") if any(p.get(c) is not None for p in report.players)]
    players = [[escape(str("" if p.get(c) is None else p[c]), quote=False) for c in columns] for p in report.players]
    body = [
        f"<h1>{escape(report.title, quote=False)}</h1>",
        _table(list(cards), [[escape(str(v)) for v in cards.values()]]) if cards else "",
        chart_svg(report),
        heat_svg(report) if report.heat else "",
        _table(["team", "players", "time (s)", "active (s)"], teams) if teams else "",
        _table(columns, players) if players else "",
    ]
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(report.title, quote=False)}</title></head><body>{''.join(body)}</body></html>"
