import inspect
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.operators import activity, clustering, intervals
from spanloom.plans import autoclip, clip, labels, report
from spanloom.sources import readers, schemas, writers

FPS, FRAMES = 10.0, 200


def scene(spark):
    """Six people walk through 120 live frames; two of them are seen in two fragments."""
    rng = np.random.default_rng(1)
    rows = []
    for person in range(6):
        for f in range(120):
            if person < 2 and 50 <= f < 60:
                continue
            track = person if f < 55 or person >= 2 else person + 10
            x = 100 + 130 * person + rng.normal(0, 2)
            rows.append((1, f, track, 0, 0.9, x - 25.0, 100.0, x + 25.0, 200.0))
    rows += [(1, f, 99, 0, 0.9, 5.0, 5.0, 9.0, 9.0) for f in range(3)] + [(1, 3, None, 0, 0.9, 0.0, 0.0, 1.0, 1.0)]
    detections = spark.createDataFrame(rows, schemas.DETECTIONS)
    clips = spark.createDataFrame([(1, FPS, 900, 400, FRAMES)], schemas.CLIPS)
    kit = [np.eye(8)[0], np.eye(8)[1]]
    vectors = []
    for track in [*range(6), 10, 11]:
        person = track % 10
        own = kit[person % 2] * 2 + np.eye(8)[2 + person] + rng.normal(0, 0.02, 8)
        vectors += [(1, track, (own + rng.normal(0, 0.01, 8)).tolist()) for _ in range(3)]
    return detections, clips, spark.createDataFrame(vectors, "game_id long, track_id long, embedding array<double>")


def analysed(spark):
    d, c, v = scene(spark)
    return clip.analyse(d, c, v, FPS, 900, 400, distance=0.3)


def test_analysis(spark):
    made = analysed(spark)
    tracks = {r.track_id: r for r in made.tracks.collect()}
    assert tracks[99].role == "spectator" and tracks[99].player is None
    assert tracks[0].player == tracks[10].player and tracks[1].player == tracks[11].player
    assert len({t.player for t in tracks.values() if t.player is not None}) == 6
    assert tracks[0].team == tracks[2].team != tracks[1].team
    segs = made.segments.collect()
    assert len(segs) == 1 and segs[0].start_frame == 0 and 119 <= segs[0].end_frame <= 126
    assert made.shifts.count() == 6 and made.players.count() == 6
    line = made.players.where("n_fragments = 2").orderBy("player").first()
    assert line.track_ids == "0 10" and line.n_shifts == 1
    score = made.boxscore.first()
    assert score.game.n_players == 8 and score.game.n_spectators == 1 and score.game.n_segments == 1
    assert made.identities.count() == 6 and made.heat.agg(F.sum("n")).first()[0] == made.tracks.agg(F.sum("on_surface_frames")).first()[0]


def test_live_segments_from_samples(spark):
    d, c, _ = scene(spark)
    c = c.union(spark.createDataFrame([(2, FPS, 900, 400, 50)], schemas.CLIPS))
    segs = autoclip.live_segments(d, c, ["game_id"], FPS, 900, 400, stride=5)
    found = segs.collect()
    assert len(found) == 1 and found[0].start_frame == 0 and 120 <= found[0].end_frame <= 145
    extra = autoclip.extras(segs, c, ["game_id"], FPS, "x.mp4", False, 5)
    documents = {r.game_id: json.loads(r.value) for r in writers.segments_document(segs, extra, ["game_id"]).collect()}
    assert documents[1]["n_segments"] == 1 and documents[1]["segments"][0]["segment"] == 0 and 0 < documents[1]["savings_frac"] < 1
    assert (documents[2]["n_segments"], documents[2]["segments"], documents[2]["savings_frac"], documents[2]["total_seconds"]) == (0, [], 1.0, 5.0)
    assert writers.cut_plan(segs).first().filename.startswith("segment_000_0s-")


SHIFTS = [(1, 0, 0, 0.0, 10.0), (2, 0, 0, 0.0, 10.0), (2, 0, 1, 20.0, 40.0), (3, 1, 0, 0.0, 20.0), (4, None, 0, 5.0, 10.0)]


def shift_table(spark):
    rows = [(p, t, s, 0, 0, 0, 1, a, b, b - a) for p, t, s, a, b in SHIFTS]
    return spark.createDataFrame(rows, schemas.SHIFTS)


def test_chart_and_report(spark):
    chart = report.chart_rows(shift_table(spark)).orderBy("row").collect()
    assert [r.player for r in chart] == [2, 1, 3, 4] and chart[0].label == "P2 (T0)" and chart[3].label == "P4"
    assert chart[0].toi_s == 30.0 and [(b.start_s, b.end_s) for b in chart[0].bars] == [(0.0, 10.0), (20.0, 40.0)]
    assert report.chart_span(shift_table(spark)) == 40.0 and report.chart_span(shift_table(spark), 60) == 60.0
    players = spark.createDataFrame([(2, 0, 30.0, 25.0, 2, "<Ana>"), (3, 1, 20.0, 20.0, 1, None)], "player long, team int, shift_seconds double, active_seconds double, n_shifts long, name string")
    made = report.build_report(shift_table(spark), players, {"duration_s": 60.0, "live_play_s": 50.0, "n_segments": 1})
    page = report.report_html(made)
    assert "&lt;Ana&gt;" in page and "<Ana>" not in page and page.count("<rect") == 5
    assert "T0" in report.report_text(made) and made.span_s == 60.0


def test_csv_rules(spark, tmp_path):
    (tmp_path / "t.csv").write_text("track_id,team,player\n1,white,\n2.0, dark ,4\nx,red,5\n1,blue,\n")
    rows = readers.text_csv(spark, str(tmp_path / "t.csv"))
    assert {r.track_id: r.team for r in readers.csv_column(rows, "team").collect()} == {1: "blue", 2: "dark"}
    assert readers.csv_column(rows, "missing").count() == 0
    assert readers.json_document(spark, str(tmp_path / "none.json")) is None


def saved(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    return {name: str(tmp_path / name) for name in tables}


def test_command_line_from_analysis_to_labels(spark, tmp_path):
    d, c, v = scene(spark)
    at = saved(tmp_path, d=d, c=c, v=v)
    out = str(tmp_path / "run")
    common = [at["d"], "--clip-table", at["c"], "--out", out]
    assert "9 tracks" in cli.main(common, spark)
    text = cli.main([*common, "--phase2", "--reid", "--embeddings", at["v"], "--label-crops", "--clips", "--reid-distance", "0.3"], spark)
    assert "Box score" in text and spark.read.parquet(f"{out}/clips").count() == 1
    assert "6 players" in cli.main(["--report", out], spark)
    page = "".join(p.read_text() for p in (tmp_path / "run" / "report.html").glob("part*"))
    assert page.count("<svg") == 2
    assert bytes(spark.read.parquet(f"{out}/shift_chart").first().image).startswith(b"\x89PNG")
    (tmp_path / "labels.csv").write_text("track_id,team,role,player\n0,white,player,Ana\n1,dark,player,Ben\n99,,spectator,\n")
    tags = str(tmp_path / "labels.csv")
    assert "2 tracks tagged" in cli.main(["--apply-labels", tags, "--out", out], spark)
    first = readers.text_csv(spark, f"{out}/tracks.csv")
    cli.main(["--apply-labels", tags, "--out", out], spark)
    again = readers.text_csv(spark, f"{out}/tracks.csv")
    assert len(set(again.columns)) == len(again.columns) and first.columns == again.columns
    assert not [p for p in (tmp_path / "run").iterdir() if ".csv." in p.name]
    assert {r.player_name for r in again.where("track_id IN (0, 10)").collect()} == {"Ana"}
    players = readers.text_csv(spark, f"{out}/players.csv")
    assert players.columns[:2] == ["player", "name"] and players.where("name = 'Ben'").count() == 1
    cli.main(["--report", out], spark)
    assert "Ana" in "".join(p.read_text() for p in (tmp_path / "run" / "report.html").glob("part*"))
    scored = cli.main(["--evaluate", tags, "--out", out], spark)
    assert "team" in scored and "100.0 %" in scored
    clipped = cli.main([*common, "--autoclip", "--clip-stride", "5", "--cut", "--reencode-clips"], spark)
    assert clipped.startswith("1 live segments") and spark.read.parquet(f"{out}/cut_plan").first().reencode
    with pytest.raises(SystemExit):
        cli.main([], spark)
    with pytest.raises(SystemExit, match="embeddings"):
        cli.main([*common, "--phase2"], spark)


def test_command_line_with_clips_of_two_rates(spark, tmp_path):
    d, c, v = scene(spark)
    shift = lambda df: df.withColumn("game_id", F.lit(2).cast("long"))
    clips = c.union(spark.createDataFrame([(2, 2 * FPS, 900, 400, FRAMES)], schemas.CLIPS))
    at = saved(tmp_path, d=d.union(shift(d)), c=clips, v=v.union(shift(v)))
    out = str(tmp_path / "run")
    common = [at["d"], "--clip-table", at["c"], "--out", out]
    assert cli.main(common, spark).count("9 tracks") == 2
    text = cli.main([*common, "--phase2", "--reid", "--embeddings", at["v"], "--label-crops", "--reid-distance", "0.3"], spark)
    assert text.count("Box score") == 2
    one, two = (readers.text_csv(spark, f"{out}/tracks.csv/game_id={i}") for i in (1, 2))
    assert one.count() == two.count() == 9
    seconds = [{r.track_id: float(r.seconds_on_surface) for r in df.collect()} for df in (one, two)]
    assert seconds[1] == {k: pytest.approx(s / 2) for k, s in seconds[0].items()}
    assert "6 players" in cli.main(["--report", out, "--clip", "2"], spark)
    (tmp_path / "labels.csv").write_text("track_id,team,role,player\n0,white,player,Ana\n")
    assert "1 tracks tagged" in cli.main(["--apply-labels", str(tmp_path / "labels.csv"), "--out", out, "--clip", "1"], spark)
    assert cli.main([*common, "--autoclip", "--clip-stride", "5"], spark).count("1 live segments") == 2
    documents = [json.loads(p.read_text()) for i in (1, 2) for p in (tmp_path / "run" / "segments.json" / f"game_id={i}").glob("part*")]
    assert [x["fps"] for x in documents] == [FPS, 2 * FPS] and documents[0]["segments"][0]["end_time_s"] > documents[1]["segments"][0]["end_time_s"]


def test_second_phase_without_teams_or_identities(spark, tmp_path):
    d, c, v = scene(spark)
    at = saved(tmp_path, d=d, c=c)
    cli.main([at["d"], "--clip-table", at["c"], "--out", str(tmp_path / "run"), "--phase2", "--no-siglip"], spark)
    rows = readers.text_csv(spark, str(tmp_path / "run" / "tracks.csv")).collect()
    assert len(rows) == 9 and {(r.team, r.player) for r in rows} == {(None, None)} and not (tmp_path / "run" / "players.csv").exists()


def test_command_line_merges_games(spark, tmp_path):
    """Two games of two segments; local identity 0 of either segment is one player."""
    clips = spark.createDataFrame([(1, FPS, 900, 400, 400), (2, FPS, 900, 400, 500)], schemas.CLIPS)
    at = saved(tmp_path, c=clips, d=spark.createDataFrame([], schemas.DETECTIONS))
    segs, tracks, found = [], [], []
    for g in (1, 2):
        for s, (a, b) in enumerate([(0, 99), (200, 299)]):
            segs.append((g, s, a, b, 100, a / FPS, (b + 1) / FPS, 10.0))
            for local in (0, 1):
                tracks.append((g, s, local, "player", local, 0.9, local, 0.9, 0, 79, 80, 8.0, 8.0, 1.0, 2000))
                found.append((s, local, np.eye(4)[local].tolist(), "siglip", g))
    run = str(tmp_path / "run")
    spark.createDataFrame(segs, "game_id long, " + schemas.SEGMENTS).repartition("game_id").write.partitionBy("game_id").option("header", True).csv(f"{run}/segments.csv")
    spark.createDataFrame(tracks, "game_id long, segment int, " + schemas.TRACKS).write.partitionBy("game_id", "segment").option("header", True).csv(f"{run}/tracks")
    spark.createDataFrame(found, schemas.IDENTITIES + ", game_id long").write.partitionBy("game_id").parquet(f"{run}/identities")
    text = cli.main([at["d"], "--clip-table", at["c"], "--out", run, "--game", "--shift-gap", "3"], spark)
    assert text.count("4 identities of segments became 2 players") == 2
    players = spark.read.parquet(f"{run}/game_players")
    assert players.groupBy("game_id").count().orderBy("game_id").collect() == [(1, 2), (2, 2)]
    assert {r.active_seconds for r in players.collect()} == {16.0} and spark.read.parquet(f"{run}/game_shifts").count() == 4
    documents = [json.loads(p.read_text()) for i in (1, 2) for p in (tmp_path / "run" / "game_boxscore.json" / f"game_id={i}").glob("part*")]
    assert [x["duration_s"] for x in documents] == [40.0, 50.0] and all(x["live_play_s"] == 20.0 for x in documents)


def test_labels_template(spark):
    made = analysed(spark)
    template = writers.label_template(made.tracks, made.crops)
    assert template.columns == schemas.names(schemas.LABEL_TEMPLATE) and template.where("track_id = 99").count() == 0
    assert labels.applied(made.tracks.select("track_id", "team", "player", "frames_seen"), spark.createDataFrame([(0, "w", "", "A")], "track_id long, team string, role string, player string")).where("player_name = 'A'").count() == 2


def test_defaults_of_the_command_line_and_the_operators():
    a = vars(cli.parser().parse_args([]))
    expected = {
        "out": "runs/output", "model": "yolo11n.pt", "conf": 0.3, "tracker": "bytetrack.yaml", "embedder": "siglip", "crops_per_track": 6,
        "shift_gap": 15.0, "clip_stride": 15, "min_segment": 3.0, "merge_gap": 2.0, "pad": 1.0,
    }
    none = ("reid_weights", "roster", "reid_distance", "report", "apply_labels", "evaluate", "tracks", "max_segments", "detections")
    flags = ("teams", "phase2", "no_siglip", "no_surface_filter", "no_bg_suppress", "clips", "label_crops", "reid", "game", "autoclip", "cut", "reencode_clips")
    assert {k: a[k] for k in expected} == expected and not any(a[k] for k in flags) and all(a[k] is None for k in none)
    assert cli.DISTANCE == {"siglip": 0.35, "osnet": 0.45}

    def default(f, name):
        return inspect.signature(f).parameters[name].default

    assert [default(activity.detect_activity, n) for n in ("min_players", "min_spread", "smooth_window")] == [5, 0.15, 15]
    assert [default(intervals.segments, n) for n in ("min_seconds", "bridge_seconds")] == [2.0, 1.0]
    assert [default(intervals.shifts, n) for n in ("gap_seconds", "min_seconds")] == [15.0, 0.0]
    assert [default(autoclip.live_segments, n) for n in ("conf", "stride", "min_segment_seconds", "merge_gap_seconds", "pad_seconds")] == [0.25, 15, 3.0, 2.0, 1.0]
    assert default(clustering.constrained_merge, "threshold") == 0.35 and default(intervals.overlap_pairs, "min_gap") == 0
