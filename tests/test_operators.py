import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import pixels
from spanloom.functions import scalars as S
from spanloom.operators import activity, clustering, evaluation, game, intervals, rollups, tracks, vectors, votes
from spanloom.plans import catalog


def value(spark, column, schema="a double", row=(1.0,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_seconds_round_half_even(spark):
    df = spark.createDataFrame([(f,) for f in range(2000)], "f long")
    for fps in (8.0, 29.97, 30.0):
        found = df.select("f", S.seconds("f", fps).alias("s")).collect()
        assert all(r.s == round(r.f / fps, 2) for r in found)
    assert value(spark, S.seconds("a", 0.0)) == 0.0
    assert S.frames(0.25, 10) == 2 and S.frames(1, 0, least=1) == 1


@pytest.mark.parametrize("text, as_int, as_team, as_double", [("7", 7, 7, 7.0), (" 7.9 ", 7, None, 7.9), ("", None, None, 0.0), ("x", None, None, 0.0), (None, None, None, 0.0), ("1.0", 1, None, 1.0)])
def test_lenient_parsing(spark, text, as_int, as_team, as_double):
    r = spark.createDataFrame([(text,)], "t string").select(S.lenient_int("t"), S.lenient_team("t"), S.lenient_double("t"), S.clean_text("t")).first()
    assert tuple(r) == (as_int, as_team, as_double, (text or "").strip())


def test_text_functions(spark):
    r = spark.createDataFrame([(3, None, "<a&b>")], "p int, t int, h string").select(
        S.player_label("p"), S.player_label("p", F.lit(" Ana "), F.lit(1)), S.team_label("t"), S.escape_html("h"), S.team_color("p"), S.team_color(F.lit("0")),
        S.clip_filename(F.lit(4), F.lit(1.9), F.lit(7.2)), S.data_uri(F.lit(b"ab"), "x/y"), S.hue_distance(F.lit(175.0), F.lit(5.0)), S.safe_ratio(F.lit(1), F.lit(0)),
    ).first()
    assert tuple(r) == ("P3", "Ana (T1)", "-", "&lt;a&amp;b&gt;", "#9c9c9c", "#3cdc3c", "segment_004_1s-7s.mp4", "data:x/y;base64,YWI=", 10.0, 0.0)


def test_positions_and_boxes(spark):
    r = spark.createDataFrame([(2.5, -3.9, 9.99)], "a double, b double, c double").select(
        S.rounded_position("a"), S.truncated_position("b", 5), S.truncated_position("c", 5), S.bar_duration(F.lit(3.0), F.lit(1.0)),
        S.crop_box(F.lit(-2.0), F.lit(1.0), F.lit(4.0), F.lit(3.0), 10, 10), S.crop_box(F.lit(5.0), F.lit(1.0), F.lit(5.0), F.lit(3.0), 10, 10),
    ).first()
    assert tuple(r[:4]) == (2, 0, 4, 0.0) and tuple(r[4]) == (0, 1, 4, 3) and r[5] is None


def test_hsv_agrees_with_numpy(spark):
    colors = [(10, 200, 30), (0, 0, 0), (255, 255, 255), (200, 10, 10), (5, 5, 250), (9, 60, 61)]
    df = spark.createDataFrame(colors, "b int, g int, r int").select("b", "g", "r", S.hsv("b", "g", "r").alias("x"))
    for row in df.collect():
        assert np.allclose(tuple(row.x), pixels.to_hsv(np.array([row.b, row.g, row.r])), atol=1e-6)


def test_activity_and_smoothing(spark):
    clips = spark.createDataFrame([(1, 6), (2, 0)], "game_id int, total_frames long")
    spine = activity.frame_spine(clips, ["game_id"])
    seen = spark.createDataFrame([(1, 0, 0.0), (1, 0, 100.0), (1, 1, 50.0), (1, 3, 0.0), (1, 3, 100.0)], "game_id int, frame long, foot_x double")
    found = activity.detect_activity(seen, spine, ["game_id"], 100.0, 2, 0.4, 1).orderBy("frame").collect()
    assert [(r.n, r.spread, r.active) for r in found] == [(2, 0.5, True), (1, 0.0, False), (0, 0.0, False), (2, 0.5, True), (0, 0.0, False), (0, 0.0, False)]
    means = activity.activity_summary(activity.majority_smooth(activity.frame_activity(seen, spine, ["game_id"], 100.0, 2, 0.4), ["game_id"], 3), []).first()
    assert means.mean_players == pytest.approx(5 / 6) and means.active_fraction == pytest.approx(1 / 6)
    flags = spark.createDataFrame([(1, i, bool(x)) for i, x in enumerate([1, 0, 0, 1, 1])], "k int, frame long, raw_active boolean")
    assert [r.active for r in activity.majority_smooth(flags, ["k"], 2).orderBy("frame").collect()] == [True, False, False, True, True]
    assert activity.activity_summary(activity.majority_smooth(flags.where("false").withColumn("n", F.lit(1)).withColumn("spread", F.lit(0.0)), ["k"], 3), []).first().active_fraction == 0.0


def test_tracks_roles_and_crops(spark):
    boxes = [(1, f, 7, 0, 0.9, 0.0, 0.0, 40.0, 50.0) for f in range(60)] + [(1, f, 8, 0, 0.9, 100.0, 0.0, 110.0, 50.0) for f in range(5)] + [(1, 0, None, 0, 0.9, 0.0, 0.0, 1.0, 1.0), (1, 0, 9, 2, 0.9, 0.0, 0.0, 1.0, 1.0)]
    raw = spark.createDataFrame(boxes, "game_id long, frame long, track_id long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    seen = tracks.with_geometry(tracks.tracked(tracks.people(raw, 0.3)))
    mask = spark.createDataFrame([(20, 50)], "x int, y int")
    on = tracks.with_surface(seen, mask, 200, 100)
    found = {r.track_id: r for r in tracks.with_role(tracks.track_stats(on, ["game_id", "track_id"])).collect()}
    assert found[7].role == "player" and found[7].median_area_px == 2000 and found[7].on_surface_frac == 1.0
    assert found[8].role == "spectator" and found[8].on_surface_frames == 0
    crops = tracks.sample_crops(on, ["track_id"]).orderBy("frame").collect()
    assert [r.frame for r in crops] == [0, 10, 20, 30, 40, 50]
    assert tracks.heat(on, 200, 100).where("xi = 20 and yi = 50").first().n == 60
    assert tracks.with_surface(seen, None, 1, 1).where("not on_surface").count() == 0


def test_votes_break_ties_by_label(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, None, 99), (2, "z", 1)], "k int, l string, w int")
    assert sorted((r.k, r.l, r.weight) for r in votes.majority(df, ["k"], "l", "w").collect()) == [(1, "a", 5), (2, "z", 1)]
    assert [(r.k, r.labels) for r in votes.conflicts(df, ["k"], "l").collect()] == [(1, ["a", "b"])]


def lines(spark):
    return spark.createDataFrame(
        [(1, 0, 100, 50, 90, 10), (2, 0, 60, 30, 50, 11), (3, 1, 80, 40, 70, 12), (4, None, 5, 5, 5, 13)],
        "track_id long, team int, frames_seen long, active_frames long, on_surface_frames long, median_area_px int",
    )


def test_first_seen_label_wins_a_tie(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (1, 9, "b"), (1, 7, "a"), (2, 1, "c"), (2, 2, "a"), (2, 3, "a"), (3, 1, None)], "k int, frame long, l string")
    assert {r.k: r.l for r in votes.majority(df, ["k"], "l", seen="frame").collect()} == {1: "b", 2: "a"}
    assert {r.k: r.l for r in votes.majority(df, ["k"], "l").collect()} == {1: "a", 2: "a"}


def test_team_totals_and_box_score(spark):
    totals = rollups.team_totals(lines(spark), [], 10.0).orderBy(rollups.team_order()).collect()
    assert [(r.team, r.n_players, r.active_s) for r in totals] == [(0, 2, 8.0), (1, 1, 4.0), (None, 1, 0.5)]
    header = spark.createDataFrame([(1, 600, 2)], "game_id int, frames long, n_segments int")
    score = rollups.boxscore(lines(spark).withColumn("game_id", F.lit(1)), ["game_id"], header, 10.0).first()
    assert score.game.duration_s == 60.0 and score.game.n_players == 4 and score.schema_version == 1
    assert [t.team for t in score.teams] == [0, 1, None]
    assert [p.track_id for p in score.players] == [1, 3, 2, 4] and score.players[0].on_surface_frac == 0.9
    from spanloom.plans.report import boxscore_text

    assert "T?" in boxscore_text(score.asDict(recursive=True))


def test_team_totals_from_text(spark):
    df = spark.createDataFrame([("0", "25", "30"), ("0", "18", "20"), ("1", "35", "40"), ("", "4", "5")], "team string, active_seconds string, seconds_on_surface string")
    found = rollups.team_totals_from_players(df, []).orderBy(rollups.team_order()).collect()
    assert [(r.team, r.on_surface_s, r.active_s) for r in found] == [(0, 50.0, 43.0), (1, 40.0, 35.0), (None, 5.0, 4.0)]


def blobs(groups, each, size=32, seed=0, noise=0.03):
    rng = np.random.default_rng(seed)
    centres = clustering.unit_rows(rng.normal(size=(groups, size)))
    points = np.concatenate([c + rng.normal(scale=noise, size=(each, size)) for c in centres])
    return clustering.unit_rows(points), np.repeat(np.arange(groups), each)


def same_partition(a, b):
    return len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(set(a.tolist())) == len(set(b.tolist()))


def test_identities_respect_time():
    first, last = np.array([0, 5, 20]), np.array([10, 15, 30])
    assert np.argwhere(np.triu(clustering.conflict_matrix(first, last))).tolist() == [[0, 1]]
    assert not clustering.conflict_matrix(np.array([0, 12]), np.array([10, 20])).any()
    assert clustering.conflict_matrix(np.array([0, 12]), np.array([10, 20]), 5).any()
    x = np.tile(clustering.unit_rows(np.ones((1, 8))), (2, 1))
    labels, blocked = clustering.constrained_merge(x, clustering.conflict_matrix(np.array([0, 5]), np.array([10, 15])))
    assert labels.tolist() == [0, 1] and blocked >= 1
    x = np.tile(x[:1], (3, 1))
    labels, _ = clustering.constrained_merge(x, ~np.eye(3, dtype=bool), target=1)
    assert len(set(labels.tolist())) == 3


def test_identities_of_four_people():
    x, true = blobs(4, 2)
    spans = np.arange(8) * 100
    labels, confidence, _, _ = clustering.identities(x, spans, spans + 50, threshold=0.5)
    assert same_partition(labels, true) and (confidence > 0.5).all()
    assert len(set(clustering.identities(x, spans, spans + 50, target=3)[0].tolist())) == 3


def slow_merge(points, veto, target, threshold):
    """Average linkage from scratch in every step; also how often the closest pair of all was vetoed."""
    groups, blocked = [[i] for i in range(len(points))], 0
    d = np.clip(1 - points @ points.T, 0, 2)
    while len(groups) > (target or 1):
        every = [(d[np.ix_(a, b)].mean(), i, j, veto[np.ix_(a, b)].any()) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        pairs = [x[:3] for x in every if not x[3]]
        blocked += bool(min(every)[3])
        if not pairs or (target is None and min(pairs)[0] > threshold):
            break
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    out = np.zeros(len(points), int)
    for k, g in enumerate(groups):
        out[g] = k
    return out, blocked


def test_merging_equals_the_slow_way():
    rng = np.random.default_rng(3)
    for trial in range(30):
        n = rng.integers(2, 12)
        x = clustering.unit_rows(rng.normal(size=(n, 4)))
        veto = rng.random((n, n)) < 0.15
        veto |= veto.T
        np.fill_diagonal(veto, False)
        target = None if trial % 2 else 3
        (labels, blocked), (expected, vetoed) = clustering.constrained_merge(x, veto, target, 0.6), slow_merge(x, veto, target, 0.6)
        assert same_partition(labels, expected) and blocked == vetoed


def test_a_veto_counts_where_merging_ends():
    x = clustering.unit_rows(np.array([[1.0, 0, 0], [1, 0.01, 0], [0, 1, 0]]))
    veto = np.zeros((3, 3), bool)
    veto[0, 1] = veto[1, 0] = True
    assert clustering.constrained_merge(x, veto, None, 0.3)[1] == 1


VECTORS = "/root/testdata/sf0.001"


def test_clustering_queries_equal_the_slow_way(spark):
    """The queries without SQL, over the whole table, against plain loops."""
    made = {n: catalog.QUERIES[n](spark, VECTORS).toPandas() for n in ("q_constrained_agglomerative", "q_cross_segment_merge", "q_hungarian_accuracy", "q_team_cluster", "q_kit_split")}
    clips = catalog._clips(spark, VECTORS).toPandas().sort_values("track_id")
    right = []
    for g, own in clips.groupby("game"):
        x = clustering.identity_reduction(np.stack(own["embedding"].to_numpy()).astype(float))
        first, last = own["first_frame"].to_numpy(), own["last_frame"].to_numpy()
        veto = np.array([[i != j and max(first[i], first[j]) <= min(last[i], last[j]) for j in range(len(own))] for i in range(len(own))])
        labels, blocked = slow_merge(x, veto, None, 0.6)
        found = made["q_constrained_agglomerative"].query("game == @g").sort_values("track_id")
        assert same_partition(found["player"].to_numpy(), labels) and set(found["blocked"]) == {blocked}
        assert found["player"].drop_duplicates().tolist() == list(range(labels.max() + 1))  # numbered by first appearance
        pinned, _ = slow_merge(x, veto, 10, 0.35)
        table = np.array([[((pinned == a) & (own["label"].to_numpy() == b)).sum() for b in range(10)] for a in range(pinned.max() + 1)])
        right.append((g, len(own), permuted_most(table)))
        segment = own["track_id"].to_numpy() % 5
        order = np.lexsort((own["track_id"].to_numpy(), segment))
        conflict = (segment[:, None] == segment) & ~np.eye(len(own), dtype=bool)
        players, _ = slow_merge(clustering.identity_reduction(np.stack(own["embedding"].to_numpy()[order]).astype(float)), conflict[np.ix_(order, order)], None, 0.6)
        found = made["q_cross_segment_merge"].query("game == @g").sort_values(["segment", "local_id"])
        assert same_partition(found["player"].to_numpy(), players)
    found = made["q_hungarian_accuracy"]
    assert sorted(zip(found["game"], found["n"], found["correct"], strict=True)) == sorted(right)
    for name in ("q_team_cluster", "q_kit_split"):
        assert len(made[name]) == len(clips) and set(made[name]["team"]) <= {0, 1} and made[name]["team_conf"].between(0, 1).all()
    kits = made["q_kit_split"].merge(clips[["track_id", "label"]], on="track_id")
    split = kits.groupby("game")["team"].nunique() == 2
    assert split.all()


def permuted_most(table):
    """The largest total of a one-to-one map, by dynamic programming over sets of columns."""
    best = {0: 0}
    for row in table:
        new = dict(best)  # the row may stay without a column
        for used, total in best.items():
            for j, n in enumerate(row):
                if not used >> j & 1:
                    key = used | 1 << j
                    new[key] = max(new.get(key, 0), total + int(n))
        best = new
    return max(best.values())


def test_team_numbers_follow_colors(spark):
    labels = np.array([0, 0, 1, 1, 1])
    hsv = np.array([[10, 50, 90], [12, 60, 80], [90, 200, 70], [91, 10, 60], [95, 190, 50.0]])
    assert clustering.by_color(labels, hsv).tolist() == [1, 1, 0, 0, 0]
    assert clustering.by_color(np.array([3, 3]), hsv[:2]).tolist() == [0, 0]
    even = np.array([[30, 9, 9], [20, 9, 9.0]])
    assert clustering.by_color(np.array([0, 1]), even).tolist() == [1, 0]
    x, true = blobs(2, 8)
    rows = [(1, i, v.tolist(), [5.0, 40.0 + 100 * float(t), 50.0], [0.0, 0.0]) for i, (v, t) in enumerate(zip(x, true, strict=True))]
    df = spark.createDataFrame(rows, "g int, track_id long, embedding array<double>, hsv array<double>, chroma array<double>")
    teams = {r.track_id: r.team for r in clustering.assign_teams(df, ["g"], chroma="chroma", hsv="hsv").collect()}
    assert teams == {i: int(1 - t) for i, t in enumerate(true.tolist())}


def test_two_teams_and_kits():
    x, true = blobs(2, 8)
    teams, confidence = clustering.team_clusters(x)
    assert same_partition(teams, true) and (confidence > 0.5).all()
    assert clustering.team_clusters(x[:1])[0].tolist() == [0] and clustering.team_clusters(x[:2])[0].tolist() == [0, 1]
    vivid = np.array([[0.5, 0.05], [0.48, 0.0], [0.52, 0.02], [0.5, -0.03]])
    split = clustering.kit_split(np.vstack([vivid, vivid * 0.05]))
    assert split[0].tolist() == [0] * 4 + [1] * 4 and (split[1] > 0.9).all()
    assert clustering.kit_split(vivid) is None and clustering.kit_split(np.zeros((8, 2))) is None


def test_size_does_not_decide_the_team():
    x, true = blobs(2, 10, noise=0.05)
    sizes = np.exp(np.linspace(6, 9, 20)[np.random.default_rng(1).permutation(20)])
    direction = clustering.unit_rows(np.random.default_rng(9).normal(size=(1, 32)))
    tilted = clustering.unit_rows(x + np.log(sizes)[:, None] * direction * 0.8)
    assert same_partition(clustering.team_clusters(tilted, sizes)[0], true)


def test_color_teams_freeze():
    model = clustering.ColorTeams(4)
    assert model.predict([[10, 10, 10], [200, 200, 200]]).tolist() == [0, 1]
    model.predict([[12, 12, 12], [198, 198, 198]])
    frozen = model.centres.copy()
    assert model.predict([[0, 0, 0], [250, 250, 250]]).tolist() in ([0, 1], [1, 0])
    assert (model.centres == frozen).all()


def test_silhouette_of_plan_and_array_agree(spark):
    x, labels = blobs(3, 6, size=8, noise=0.3)
    df = spark.createDataFrame([(1, i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(labels, x, strict=True))], "g int, id int, label int, v array<double>")
    assert vectors.silhouette(df, ["g"], "id", "v", "label").first().silhouette == pytest.approx(clustering.silhouette_score(x, labels))
    assert math.isnan(vectors.silhouette(df.withColumn("label", F.lit(1)), ["g"], "id", "v", "label").first().silhouette)


def test_pooling(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [0.0, 2.0]), (2, None)], "t int, embedding array<double>")
    every = spark.createDataFrame([(1,), (2,), (3,)], "t int")
    found = {r.t: r.centroid for r in vectors.pooled(df, ["t"], every, size=2).collect()}
    mean = np.array([0.3, 0.9])
    assert np.allclose(found[1], mean / np.linalg.norm(mean), atol=1e-6) and found[2] == [0.0, 0.0] == found[3]


@pytest.mark.parametrize("pred, true, correct", [("000111", "wwwddd", 6), ("000111", "AAABBA", 5), ("001122", "AABBAA", 4), ("0011", "AABC", 3)])
def test_mapped_accuracy(spark, pred, true, correct):
    df = spark.createDataFrame([(1, p, t) for p, t in zip(pred, true, strict=True)], "g int, pred string, true string")
    found = evaluation.mapped_accuracy(evaluation.contingency(df, ["g"]), ["g"]).first()
    assert (found.correct, found.accuracy) == (correct, correct / len(pred))


def test_assignment_against_trials():
    rng = np.random.default_rng(2)
    for _ in range(60):
        w = rng.integers(0, 9, size=rng.integers(1, 6, size=2))
        assert sum(w[i, j] for i, j in evaluation.best_assignment(w)) == evaluation.best_assignment_by_trial(w)
    assert evaluation.best_assignment(np.zeros((0, 0))) == []


def test_evaluate_fields(spark):
    pred = spark.createDataFrame([(1, "0", "player"), (2, "0", "player"), (3, "1", "spectator")], "track_id long, team string, role string")
    lab = spark.createDataFrame([(1, "white", "player"), (2, "white", "spectator"), (3, "dark", "spectator"), (4, "dark", "")], "track_id long, team string, role string")
    found = {r.field: r for r in evaluation.evaluate(pred, lab).collect()}
    assert (found["team"].n_overlap, found["team"].n_missing, found["team"].correct) == (3, 1, 3)
    assert (found["role"].n_overlap, found["role"].correct) == (3, 2) and "player" not in found


def tagged(spark, labels):
    rows = [("1", "0", "5", "500"), ("2", "0", "5", "10"), ("3", "1", "5", "x")]
    return spark.createDataFrame(rows, "track_id string, team string, player string, frames_seen string"), spark.createDataFrame(labels, "track_id string, team string, role string, player string")


def test_labels_spread_through_clusters(spark):
    t, lab = tagged(spark, [("1", "", "", " Ben ")])
    found = evaluation.propagate_labels(t, lab)
    assert {r.player_name for r in found.collect()} == {"Ben"}
    assert tuple(evaluation.propagation_summary(found).first()) == (1, 2)


def test_heavier_label_wins_and_conflicts_show(spark):
    t, lab = tagged(spark, [("1", "", "", "Ben"), ("2", "", "", "Ana"), ("99", "", "", "Nobody")])
    found = {r.track_id: r.player_name for r in evaluation.propagate_labels(t, lab).collect()}
    assert found == {"1": "Ben", "2": "Ana", "3": "Ben"}
    assert [(r.kind, r.key, r.labels) for r in evaluation.label_conflicts(t, lab).collect()] == [("mixed cluster", "5", ["Ana", "Ben"])]


def test_overlaps_are_counted_without_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), int(rng.integers(4)), i, int(a), int(a + n), None if t == 2 else int(t)) for i, (k, a, n, t) in enumerate(zip(rng.integers(0, 3, 150), rng.integers(0, 60, 150), rng.integers(-1, 9, 150), rng.integers(0, 3, 150), strict=True))]
    df = spark.createDataFrame(rows, "g int, player long, track_id long, first_frame long, last_frame long, team int")
    found = {r.g: r for r in evaluation.validate_identities(df, ["g"]).collect()}
    for g in range(3):
        pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] == b[0] == g and a[1] == b[1]]
        known = [(a, b) for a, b in pairs if a[5] is not None and b[5] is not None]
        violations = sum(max(a[3], b[3]) <= min(a[4], b[4]) for a, b in pairs)
        same = sum(a[5] == b[5] for a, b in known)
        r = found[g]
        assert (r.pairs, r.violations, r.checkable, r.same, r.cross, r.verdict) == (len(pairs), violations, len(known), same, len(known) - same, "FAIL")
    none = evaluation.validate_identities(df.where("false"), []).first()
    assert (none.pairs, none.violations, none.verdict) == (0, 0, "PASS")


def test_validation_counts(spark):
    df = spark.createDataFrame([(1, 1, 0, 10, 0), (2, 1, 5, 20, 0), (3, 1, 30, 40, 1), (4, 2, 0, 9, None)], "track_id int, player int, first_frame long, last_frame long, team int")
    assert tuple(evaluation.validate_identities(df, []).first()) == (3, 1, 3, 1, 2, "FAIL")


def merged(spark):
    segs = spark.createDataFrame([(1, 0, 0, 899), (1, 1, 1800, 2699)], "game_id int, segment int, start_frame long, end_frame long")
    rows = [(1, s, t, role, team, str(p), 0, 899, 900, 30.0, 30.0) for s, t, role, team, p in [(0, 1, "player", "0", 0), (0, 2, "player", "1", 1), (1, 1, "player", "0", 0), (1, 2, "player", "1", 1), (1, 3, "spectator", "", "")]]
    t = spark.createDataFrame(rows, "game_id int, segment int, track_id long, role string, team string, player string, first_frame long, last_frame long, frames_seen long, active_seconds double, seconds_on_surface double")
    ids = spark.createDataFrame([(1, s, k, [1.0, 0.0, 0.0] if k == 0 else [0.0, 1.0, 0.0]) for s in (0, 1) for k in (0, 1)], "game_id int, segment int, local_id long, centroid array<double>")
    return t, ids, segs


def test_game_merge(spark):
    from spanloom.plans.full_game import merge_segments

    t, ids, segs = merged(spark)
    made = merge_segments(t, ids, segs, ["game_id"], 30.0, 2700)
    players = {r.player: r for r in made.players.collect()}
    assert len(players) == 2 and players[0].track_ids == "s0:1 s1:1" and players[0].n_fragments == 2 and players[0].team == 0
    found = made.shifts.collect()
    assert len(found) == 2 and all(r.end_time_s > 60 and r.duration_s < 61 for r in found)
    assert made.header.first().asDict() == {"game_id": 1, "duration_s": 90.0, "live_play_s": 60.0, "n_segments": 2, "n_players": 2, "active_fraction": 0.6667}


def test_one_segment_never_merges(spark):
    ids = spark.createDataFrame([(1, 0, 0, [1.0, 0.0]), (1, 0, 1, [1.0, 0.0])], "game_id int, segment int, local_id long, centroid array<double>")
    assert clustering.merge_segment_identities(ids, ["game_id"]).select("player").distinct().count() == 2
    assert game.cannot_link(ids, ["game_id"]).count() == 1


def test_pixels(spark):
    rng = np.random.default_rng(0)
    crop = np.zeros((40, 20, 3), np.uint8)
    crop[:] = (200, 80, 20)
    crop[6:22, 4:16] = (20, 20, 220)
    assert pixels.torso_hsv(crop)[0] == pytest.approx(0, abs=1)
    assert np.linalg.norm(pixels.kit_chroma(crop)) > 0.8
    kept = pixels.without_background(crop)
    assert (kept == 20).any() and not (kept[0, 0] == (200, 80, 20)).all()
    assert pixels.network_input(rng.integers(0, 255, (30, 17, 3), dtype=np.uint8)).shape == (3, 256, 128)
    assert pixels.box_color(crop, (5, 5, 5, 9)).tolist() == [0, 0, 0]
    df = spark.createDataFrame([(crop.tobytes(), 40, 20), (None, 40, 20)], "p binary, h int, w int")
    found = df.select(pixels.kit_chroma_column("p", "h", "w").alias("c"), pixels.torso_hsv_column("p", "h", "w").alias("t")).collect()
    assert np.allclose(found[0].c, pixels.kit_chroma(crop)) and found[1].c is None
    boxes = df.withColumn("box", F.array(*[F.lit(float(v)) for v in (2, 3, 18, 30)]))
    found = boxes.select(
        pixels.without_background_column("p", "h", "w").alias("s"),
        pixels.box_color_column("p", "h", "w", "box").alias("b"),
        pixels.network_input_column("p", "h", "w").alias("n"),
    ).collect()
    assert bytes(found[0].s.pixels) == kept.tobytes() and (found[0].s.height, found[0].s.width) == kept.shape[:2] and found[1].s is None
    assert found[0].b == pytest.approx(pixels.box_color(crop, (2, 3, 18, 30)).tolist()) and found[1].b is None
    assert np.allclose(found[0].n, pixels.network_input(crop).ravel(), atol=1e-6) and found[1].n is None


def test_intervals_of_no_rows(spark):
    empty = spark.createDataFrame([], "k int, start_frame long, end_frame long")
    assert intervals.pad_segments(empty, ["k"], 3, 100).count() == 0
    assert votes.majority(spark.createDataFrame([], "k int, l string"), ["k"], "l").count() == 0
