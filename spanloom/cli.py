"""Command line: analyse detections, find live segments, merge a game, report, label, evaluate.

The inputs are tables: detections, one row per clip, one embedding per crop. Models and video
files stay outside; options that name one choose among the rows it made. The tables of one clip
are written to the output folder itself, those of several under ``<table>/game_id=<id>``.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import game
from .plans import autoclip, clip, full_game, labels, report
from .sources import readers, schemas, writers

#: Identity distance by embedder.
DISTANCE = {"siglip": 0.35, "osnet": 0.45}
KEYS = clip.KEYS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    p.add_argument("detections", nargs="?", help="Parquet table of detections")
    p.add_argument("--clip-table", help="Parquet table with fps, width, height and total_frames per game_id")
    p.add_argument("--embeddings", help="Parquet table with one embedding per crop of a track")
    p.add_argument("--crop-pixels", help="Parquet table of crops (pixels, height, width), for kit colours")
    p.add_argument("--mask", help="Parquet table of surface pixels (x, y)")
    p.add_argument("--team-votes", help="Parquet table of team votes per detection, for --teams")
    p.add_argument("--clip", type=int, help="the game_id to report, label or evaluate in a run of several clips")
    p.add_argument("--out", default="runs/output")
    p.add_argument("--model", default="yolo11n.pt", help="detections of this model, where the table names models")
    p.add_argument("--tracker", default="bytetrack.yaml", choices=["bytetrack.yaml", "botsort.yaml"])
    p.add_argument("--conf", type=float, default=0.3)
    p.add_argument("--teams", action="store_true", help="the team of each track by --team-votes, in the first phase")
    p.add_argument("--phase2", action="store_true", help="roles, activity, teams, box score; with --reid identities and shifts")
    p.add_argument("--no-siglip", action="store_true", help="no teams in the second phase")
    p.add_argument("--no-surface-filter", action="store_true")
    p.add_argument("--no-bg-suppress", action="store_true", help="embeddings of raw crops, where the table has both")
    p.add_argument("--embedder", choices=sorted(DISTANCE), default="siglip")
    p.add_argument("--reid-weights", help="embeddings of these weights, where the table names weights")
    p.add_argument("--crops-per-track", type=int, default=6)
    p.add_argument("--clips", action="store_true", help="with --phase2, write what to cut for each live segment")
    p.add_argument("--label-crops", action="store_true", help="write a label template")
    p.add_argument("--reid", action="store_true", help="with --phase2, join tracks to identities")
    p.add_argument("--roster", type=int)
    p.add_argument("--reid-distance", type=float)
    p.add_argument("--shift-gap", type=float, default=15.0)
    p.add_argument("--report", metavar="RUN_DIR")
    p.add_argument("--apply-labels", metavar="CSV")
    p.add_argument("--evaluate", metavar="CSV")
    p.add_argument("--tracks", metavar="CSV")
    p.add_argument("--game", action="store_true", help="merge segment runs found under --out")
    p.add_argument("--max-segments", type=int)
    p.add_argument("--autoclip", action="store_true")
    p.add_argument("--clip-stride", type=int, default=15)
    p.add_argument("--min-segment", type=float, default=3.0)
    p.add_argument("--merge-gap", type=float, default=2.0)
    p.add_argument("--pad", type=float, default=1.0)
    p.add_argument("--cut", action="store_true", help="write what to cut for each segment")
    p.add_argument("--reencode-clips", action="store_true", help="with --cut, ask for cuts exact to the frame")
    return p


def table(run_dir: str, name: str, clip_id: int | None) -> str:
    """The path of a table of one clip."""
    return f"{run_dir}/{name}" if clip_id is None else f"{run_dir}/{name}/game_id={clip_id}"


def run_report(spark: SparkSession, run_dir: str, clip_id: int | None = None) -> str:
    shifts = readers.shifts(spark, table(run_dir, "shifts.csv", clip_id))
    players = readers.text_csv(spark, table(run_dir, "players.csv", clip_id))
    typed = [F.col(f.split()[0]).try_cast(f.split()[1]).alias(f.split()[0]) for f in schemas.PLAYERS.split(", ")]
    name = [F.col("name")] if "name" in players.columns else []
    score = readers.json_document(spark, table(run_dir, "boxscore.json", clip_id))
    head = score.first().asDict(recursive=True).get("game") if score is not None else None
    heat = readers.parquet_or_none(spark, table(run_dir, "heat", clip_id))
    made = report.build_report(shifts, players.select(*typed, *name), head, heat=heat)
    html = spark.createDataFrame([(report.report_html(made),)], "value string")
    writers.json_text(html, table(run_dir, "report.html", clip_id))
    chart = spark.createDataFrame([(bytearray(report.chart_png(made)),)], "image binary")
    writers.parquet(chart, table(run_dir, "shift_chart", clip_id))
    return report.report_text(made)


class Run:
    """One command over the clips of a table. Clips of one rate and frame size share a plan."""

    def __init__(self, spark: SparkSession, a: argparse.Namespace):
        self.spark, self.a = spark, a
        self.clips = readers.clips(spark, a.clip_table)
        self.several = self.clips.limit(2).count() > 1
        self.by = KEYS if self.several else None
        self.mask = spark.read.parquet(a.mask) if a.mask and not a.no_surface_filter else None
        self.distance = a.reid_distance or DISTANCE[a.embedder]
        self.detections = readers.detections(spark, a.detections, model=a.model, tracker=a.tracker)

    def settings(self) -> list[tuple]:
        """The different rates and frame sizes, with their clips and detections: as few as there are kinds of cameras."""
        kinds = self.clips.select("fps", "width", "height").distinct().orderBy("fps", "width", "height").collect()
        if len(kinds) == 1:
            return [(*kinds[0], self.clips, self.detections)]
        out = []
        for kind in kinds:
            own = self.clips.where((F.col("fps") == kind.fps) & (F.col("width") == kind.width) & (F.col("height") == kind.height))
            out.append((*kind, own, self.detections.join(own.select(*KEYS), KEYS, "left_semi")))
        return out

    def path(self, name: str) -> str:
        return f"{self.a.out}/{name}"

    def presence(self) -> str:
        a, found = self.a, []
        votes = self.spark.read.parquet(a.team_votes) if a.teams and a.team_votes else None
        for fps, _, _, _, detections in self.settings():
            found.append(clip.presence_run(detections, fps, a.conf, votes))
        every = together(found)
        writers.presence_csv(every, self.path("tracks.csv"), votes is not None, self.by)
        lines = report.presence_lines(every, KEYS)
        return "\n".join(f"{r['n_tracks']} tracks, peak {r['peak']} at once" for r in lines.orderBy(*KEYS).toLocalIterator()) or "0 tracks"

    def live_segments(self) -> str:
        a, found, extras = self.a, [], []
        for fps, width, height, clips, detections in self.settings():
            segs = autoclip.live_segments(
                detections, clips, KEYS, fps, width, height, self.mask, a.conf, a.clip_stride,
                min_segment_seconds=a.min_segment, merge_gap_seconds=a.merge_gap, pad_seconds=a.pad,
            )
            found.append(segs)
            extras.append(autoclip.extras(segs, clips, KEYS, fps, a.detections, self.mask is not None, a.clip_stride))
        segs, extra = together(found), together(extras)
        writers.segments_csv(segs, self.path("segments.csv"), self.by)
        writers.json_text(writers.segments_document(segs, extra, KEYS), self.path("segments.json"), self.by)
        if a.cut:
            writers.parquet(writers.cut_plan(segs, a.reencode_clips, KEYS), self.path("cut_plan"), self.by)
        counts = extra.join(segs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), KEYS, "left").na.fill(0, ["n"])
        return "\n".join(f"{r['n']} live segments, {r['savings_frac'] * 100:.1f} % skipped" for r in counts.orderBy(*KEYS).toLocalIterator())

    def analysis(self) -> str:
        a = self.a
        vectors = None
        if a.embeddings:
            suppressed = a.embedder == "siglip" and not a.no_bg_suppress
            vectors = readers.embeddings(self.spark, a.embeddings, a.embedder, a.reid_weights, suppressed, a.crops_per_track)
        elif a.reid or not a.no_siglip:
            raise SystemExit("--phase2 needs --embeddings, or --no-siglip without --reid")
        colors = clip.track_colors(self.spark.read.parquet(a.crop_pixels)) if a.crop_pixels else None
        runs = [
            clip.analyse(
                detections, clips, vectors, fps, width, height, self.mask, a.conf, a.roster, self.distance, a.shift_gap,
                colors=colors, with_teams=not a.no_siglip, with_identities=a.reid, crops_per_track=a.crops_per_track,
            )
            for fps, width, height, clips, detections in self.settings()
        ]
        made = clip.ClipTables(**{name: together([getattr(r, name) for r in runs]) for name in vars(runs[0])})
        writers.tracks_csv(made.tracks, self.path("tracks.csv"), by=self.by)
        writers.segments_csv(made.segments, self.path("segments.csv"), self.by)
        writers.boxscore_json(made.boxscore, self.path("boxscore.json"), KEYS, self.by)
        writers.parquet(made.heat, self.path("heat"), self.by)
        if a.reid:
            writers.players_csv(made.players, self.path("players.csv"), self.by)
            writers.shifts_csv(made.shifts, self.path("shifts.csv"), self.by)
            writers.parquet(made.identities, self.path("identities"), self.by)
        if a.clips:
            writers.parquet(writers.cut_plan(made.segments, keys=KEYS), self.path("clips"), self.by)
        if a.label_crops:
            writers.parquet(writers.label_template(made.tracks, made.crops, KEYS), self.path("labels"), self.by)
        lines = [report.boxscore_text(r.asDict(recursive=True)) for r in made.boxscore.orderBy(*KEYS).toLocalIterator()]
        for r in runs:
            r.release()
        return "\n".join(lines)

    def merged_games(self) -> str:
        """Merge ``segment=<n>`` folders of track tables, and their identities, under ``--out``."""
        a, spark = self.a, self.spark
        schema = schemas.SEGMENTS + (", game_id long" if self.several else "")
        segs = readers.csv(spark, self.path("segments.csv"), schema)
        tracks = readers.segment_tables(spark, self.path("tracks"), schemas.TRACKS, self.several)
        found = readers.identities(spark, self.path("identities"), self.several)
        runs, analysed = [], []
        for fps, _, _, clips, _ in self.settings():
            own = clips.select(*KEYS, "total_frames")
            keyed = [df.join(own, KEYS) if self.several else df.crossJoin(F.broadcast(own)) for df in (segs, tracks, found)]
            runs.append(
                full_game.merge_segments(keyed[1], keyed[2], keyed[0], KEYS, fps, F.col("total_frames"), a.roster, self.distance, a.shift_gap, a.max_segments)
            )
            analysed.append(game.first_segments(keyed[0], KEYS, a.max_segments))
        made = full_game.GameTables(**{name: together([getattr(r, name) for r in runs]) for name in vars(runs[0])})
        writers.parquet(made.players, self.path("game_players"), self.by)
        writers.parquet(made.shifts, self.path("game_shifts"), self.by)
        fields = [c for c in made.header.columns if c not in KEYS]
        writers.json_text(made.header.select(*KEYS, F.to_json(F.struct(*fields)).alias("value")), self.path("game_boxscore.json"), self.by)
        counts = made.header
        for name, df in (("_analysed", together(analysed)), ("_identities", made.mapping), ("_players", made.players)):
            counts = counts.join(df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(name)), KEYS, "left").na.fill(0, [name])
        rows = counts.orderBy(*KEYS).toLocalIterator()
        return "\n".join(report.game_text(r.asDict(), r["_analysed"], r["_identities"], r["_players"]) for r in rows)


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs one command and returns its text; commands are tried in the order report, labels,
    evaluation, game, live segments, second phase, first phase."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("spanloom").getOrCreate()
    if a.report:
        return run_report(spark, a.report, a.clip)
    if a.apply_labels:
        found = labels.apply_to_run(spark, table(a.out, "tracks.csv", a.clip), table(a.out, "players.csv", a.clip), a.apply_labels)
        return report.applied_text(*found)
    if a.evaluate:
        found = labels.evaluate_files(spark, a.evaluate, a.tracks or table(a.out, "tracks.csv", a.clip))
        return report.evaluation_text([r.asDict() for r in found.orderBy("field").collect()])
    if not a.detections or not a.clip_table:
        raise SystemExit("detections and --clip-table are needed")
    run = Run(spark, a)
    if a.game:
        return run.merged_games()
    if a.autoclip:
        return run.live_segments()
    return run.analysis() if a.phase2 else run.presence()
