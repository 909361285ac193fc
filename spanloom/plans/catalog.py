"""The query catalogue: every operator over the given tables, with its equivalent SQL.

Stand-ins: users are players, hours are frames of the activity queries and seconds those of
the shift queries; an order's life from order date to last ship date is a track's span, in
days, of the customer as player; languages of documents are clusters and labels human tags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels, scalars
from ..functions.scalars import l2_normalised, log_size, safe_corr, seconds
from ..operators import activity, clustering, evaluation, game, intervals, rollups, tracks, vectors, votes
from . import labels as label_plans
from . import report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOURS = 720
#: Thresholds that suit the tables: people and spread of a live hour, smoothing, bridge and minimum.
PEOPLE, SPREAD, SMOOTH, BRIDGE, SHORTEST, WIDTH = 12, 0.08, 5, 1, 2, 500.0
GAP = 1800


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return _read(spark, d, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.floor(micros / 1_000_000).alias("sec"),
        F.floor(micros / 3_600_000_000).alias("hour"),
    )


EV = """ev AS (
    SELECT event_id, user_id, event_type, value,
           (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS sec,
           (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS hour
    FROM events)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tracks of customers: first and last day, line items as frames seen, status as team."""
    day = lambda c: F.date_diff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    lines = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("last"),
        F.count(F.lit(1)).alias("frames_seen"),
        F.count_if(F.col("l_returnflag") == "N").alias("on_surface_frames"),
        F.count_if(F.col("l_quantity") < 25).alias("active_frames"),
    )
    orders = _read(spark, d, "orders")
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    return joined.select(
        F.col("o_orderkey").alias("track_id"),
        F.col("o_custkey").alias("player"),
        F.col("o_orderstatus").alias("team"),
        "frames_seen",
        "on_surface_frames",
        "active_frames",
        (F.col("frames_seen") / 7.0 + 0.0013).alias("player_conf"),
        day("o_orderdate").alias("first_frame"),
        day("last").alias("last_frame"),
    ).where("first_frame <= last_frame")


SP = """sp AS (
    SELECT * FROM (
        SELECT o_orderkey AS track_id, o_custkey AS player, o_orderstatus AS team, frames_seen, on_surface_frames, active_frames, frames_seen / 7.0::DOUBLE + 0.0013 AS player_conf,
               date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS first_frame,
               date_diff('day', DATE '1992-01-01', CAST(last AS DATE)) AS last_frame
        FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last, count(*) AS frames_seen, count(*) FILTER (l_returnflag = 'N') AS on_surface_frames,
            count(*) FILTER (l_quantity < 25) AS active_frames FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
    ) WHERE first_frame <= last_frame)"""


# --- tracks ---------------------------------------------------------------------------------


@query(f"""WITH {EV} SELECT user_id, min(sec) AS first_frame, max(sec) AS last_frame, count(*) AS frames_seen,
    round_even(count(*) / 30.0::DOUBLE, 2) AS seconds_on_surface FROM ev GROUP BY 1""")
def q_track_presence(spark, d):
    found = tracks.presence(_events(spark, d).withColumnRenamed("sec", "frame"), ["user_id"], 30.0)
    return found


@query("""SELECT l_suppkey, min(l_linenumber) AS first_frame, max(l_linenumber) AS last_frame, count(*) AS frames_seen,
    count(*) FILTER (l_returnflag = 'N') AS on_surface_frames, CAST(trunc(median(l_extendedprice)) AS INTEGER) AS median_area_px
    FROM lineitem GROUP BY 1""")
def q_track_stats_median(spark, d):
    rows = _read(spark, d, "lineitem").select(
        "l_suppkey", F.col("l_linenumber").alias("frame"), (F.col("l_returnflag") == "N").alias("on_surface"), F.col("l_extendedprice").alias("area")
    )
    return tracks.track_stats(rows, ["l_suppkey"])


@query(f"""WITH {EV}, s AS (SELECT user_id, count(*) AS frames_seen, count(*) FILTER (event_type <> 'view') AS on_surface_frames FROM ev GROUP BY 1)
    SELECT user_id, frames_seen, on_surface_frames, on_surface_frames / frames_seen::DOUBLE AS on_surface_frac,
           CASE WHEN frames_seen >= 60 AND on_surface_frames / frames_seen::DOUBLE >= 0.5 THEN 'player' ELSE 'spectator' END AS role FROM s""")
def q_role_filter(spark, d):
    rows = _events(spark, d).select("user_id", F.col("sec").alias("frame"), (F.col("event_type") != "view").alias("on_surface"), F.col("value").alias("area"))
    found = tracks.with_role(tracks.track_stats(rows, ["user_id"]), 60, 0.5)
    return found.select("user_id", "frames_seen", "on_surface_frames", "on_surface_frac", "role")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS nth, l_suppkey, l_returnflag FROM lineitem),
    g AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY nth) AS crop FROM s
          WHERE nth % 10 = 1 AND l_extendedprice >= 1500 AND l_returnflag = 'N')
    SELECT l_suppkey, l_orderkey, l_linenumber, CAST(crop AS INTEGER) AS crop FROM g WHERE crop <= 6""")
def q_crop_sampling(spark, d):
    rows = _read(spark, d, "lineitem").select(
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate").alias("frame"),
        (F.col("l_returnflag") == "N").alias("on_surface"),
        F.col("l_extendedprice").alias("area"),
    )
    return tracks.sample_crops(rows, ["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", "crop")


@query("""SELECT CAST(round_even(l_quantity + l_discount, 0) AS BIGINT) AS xi, CAST(round_even(l_extendedprice / 1000, 0) AS BIGINT) AS yi, count(*) AS n
    FROM lineitem WHERE round_even(l_quantity + l_discount, 0) BETWEEN 0 AND 39 AND round_even(l_extendedprice / 1000, 0) BETWEEN 0 AND 79 GROUP BY 1, 2""")
def q_heatmap_bins(spark, d):
    rows = _read(spark, d, "lineitem").select(
        (F.col("l_quantity") + F.col("l_discount")).alias("foot_x"), (F.col("l_extendedprice") / 1000).alias("foot_y")
    )
    return tracks.heat(rows, 40, 80)


@query("""WITH m AS (SELECT DISTINCT CAST(p_size AS INTEGER) AS x FROM part WHERE p_size % 2 = 0)
    SELECT l_returnflag, count(*) FILTER (m.x IS NOT NULL) AS inside, count(*) FILTER (m.x IS NULL) AS outside
    FROM lineitem LEFT JOIN m ON least(greatest(CAST(trunc(l_quantity) AS INTEGER), 0), 49) = m.x GROUP BY 1""")
def q_surface_test(spark, d):
    rows = _read(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("foot_x"), F.lit(0.0).alias("foot_y"))
    mask = _read(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_size").alias("x"), F.lit(0).alias("y"))
    marked = tracks.with_surface(rows, mask, 50, 1)
    return marked.groupBy("l_returnflag").agg(F.count_if("on_surface").alias("inside"), F.count_if(~F.col("on_surface")).alias("outside"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey AS track_id, CAST((l_quantity + (l_quantity + 30.5)) / 2 AS FLOAT) AS foot_x, CAST(l_extendedprice / 100 AS FLOAT) AS foot_y,
    round_even((l_quantity + 30.5 - l_quantity) * (l_extendedprice / 100 - l_tax), 6) AS area FROM lineitem WHERE l_linenumber % 2 = 0 AND l_discount >= 0.03 AND l_suppkey % 3 <> 0""")
def q_geometry(spark, d):
    rows = _read(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey")).alias("track_id"),
        (F.col("l_linenumber") % 2).alias("class_id"),
        F.col("l_discount").alias("conf"),
        F.col("l_quantity").alias("x1"),
        (F.col("l_quantity") + 30.5).alias("x2"),
        F.col("l_tax").alias("y1"),
        (F.col("l_extendedprice") / 100).alias("y2"),
    )
    found = tracks.with_geometry(tracks.tracked(tracks.people(rows, 0.03)))
    return found.select("l_orderkey", "l_linenumber", "track_id", "foot_x", "foot_y", F.bround("area", 6).alias("area"))


# --- activity -------------------------------------------------------------------------------


def _spine(spark: SparkSession) -> DataFrame:
    return spark.range(HOURS).select(F.floor(F.col("id") / HOURS).alias("game"), F.col("id").alias("frame"))


def _detections(spark: SparkSession, d: str) -> DataFrame:
    """One detection per user and hour; the mean value stands for the foot's x."""
    rows = _events(spark, d).groupBy("hour", "user_id").agg(F.avg("value").alias("foot_x"))
    return rows.select(F.floor(F.col("hour") / HOURS).alias("game"), F.col("hour").alias("frame"), F.col("user_id").alias("track_id"), "foot_x")


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return activity.detect_activity(_detections(spark, d), _spine(spark), ["game"], WIDTH, PEOPLE, SPREAD, SMOOTH)


ACT = f"""{EV}, det AS (SELECT hour AS frame, user_id AS track_id, avg(value) AS foot_x FROM ev GROUP BY 1, 2),
    spine AS (SELECT range AS frame FROM range({HOURS})),
    per AS (SELECT s.frame, count(d.frame) AS n, CASE WHEN count(d.frame) >= 2 THEN stddev_pop(foot_x) / {WIDTH} ELSE 0 END AS spread
            FROM spine s LEFT JOIN det d ON s.frame = d.frame GROUP BY 1),
    raw AS (SELECT *, n >= {PEOPLE} AND spread >= {SPREAD} AS raw_active FROM per),
    act AS (SELECT *, avg(CASE WHEN raw_active THEN 1.0 ELSE 0.0 END) OVER (ORDER BY frame ROWS BETWEEN {SMOOTH // 2} PRECEDING AND {SMOOTH // 2} FOLLOWING) >= 0.5 AS active FROM raw)"""
ISLANDS = """{p} AS (SELECT *, sum(opens) OVER ({w} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN s - max(e) OVER ({w} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 <= {tol} THEN 0 ELSE 1 END AS opens FROM {src}))"""
LIVE = "live AS (SELECT frame AS s, frame AS e FROM act WHERE active)"
SEGS = (
    f"{ACT}, {LIVE}, {ISLANDS.format(p='isl', w='', tol=BRIDGE, src='live')}, "
    f"""seg AS (SELECT row_number() OVER (ORDER BY start_frame) - 1 AS segment, * FROM (
        SELECT min(s) AS start_frame, max(e) AS end_frame FROM isl GROUP BY island HAVING max(e) - min(s) + 1 >= {SHORTEST}))"""
)


@query(f"WITH {ACT} SELECT frame, n FROM per")
def q_people_per_frame(spark, d):
    return activity.people_per_frame(_detections(spark, d), _spine(spark), ["game"]).select("frame", "n")


@query(f"WITH {ACT} SELECT frame, n, round_even(spread, 6) AS spread, raw_active FROM raw")
def q_activity_spread(spark, d):
    found = activity.frame_activity(_detections(spark, d), _spine(spark), ["game"], WIDTH, PEOPLE, SPREAD)
    return found.select("frame", "n", F.bround("spread", 6).alias("spread"), "raw_active")


@query(f"WITH {ACT} SELECT frame, active FROM act")
def q_majority_smooth(spark, d):
    return _flags(spark, d).select("frame", "active")


@query(f"""WITH {ACT} SELECT round_even(avg(CASE WHEN active THEN 1.0 ELSE 0.0 END), 6) AS active_fraction,
    round_even(avg(n), 6) AS mean_players, round_even(avg(spread), 6) AS mean_spread FROM act""")
def q_activity_summary(spark, d):
    found = activity.activity_summary(_flags(spark, d), [])
    return found.select(*[F.bround(c, 6).alias(c) for c in found.columns])


@query(f"WITH {ACT} SELECT d.track_id, count(*) AS active_frames FROM det d JOIN act a ON d.frame = a.frame WHERE a.active GROUP BY 1")
def q_active_frames(spark, d):
    return activity.active_frames(_detections(spark, d), _flags(spark, d), ["game"]).drop("game")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return intervals.segments(_flags(spark, d), ["game"], 1.0, SHORTEST, BRIDGE)


@query(f"""WITH {SEGS} SELECT CAST(segment AS INTEGER) AS segment, start_frame, end_frame, end_frame - start_frame + 1 AS n_frames,
    CAST(start_frame AS DOUBLE) AS start_time_s, CAST(end_frame + 1 AS DOUBLE) AS end_time_s, CAST(end_frame - start_frame + 1 AS DOUBLE) AS duration_s FROM seg""")
def q_segments(spark, d):
    return intervals.timed(_segments(spark, d), 1.0).drop("game")


@query(f"""WITH {SEGS}, wide AS (SELECT greatest(0, start_frame - 2) AS s, least({HOURS - 1}, end_frame + 2) AS e FROM seg),
    {ISLANDS.format(p='pad', w='', tol=0, src='wide')}
    SELECT CAST(row_number() OVER (ORDER BY min(s)) - 1 AS INTEGER) AS segment, min(s) AS start_frame, max(e) AS end_frame, max(e) - min(s) + 1 AS n_frames
    FROM pad GROUP BY island""")
def q_segments_padded(spark, d):
    return intervals.pad_segments(_segments(spark, d), ["game"], 2, HOURS).drop("game")


@query(f"""WITH {ACT}, live AS (SELECT frame AS s, least(frame // 3 * 3 + 3, {HOURS}) - 1 AS e FROM raw WHERE frame % 3 = 0 AND n >= {PEOPLE}),
    {ISLANDS.format(p='isl', w='', tol=2, src='live')},
    long AS (SELECT min(s) AS s0, max(e) AS e0 FROM isl GROUP BY island HAVING max(e) - min(s) + 1 >= 6),
    wide AS (SELECT greatest(0, s0 - 1) AS s, least({HOURS - 1}, e0 + 1) AS e FROM long), {ISLANDS.format(p='pad', w='', tol=0, src='wide')}
    SELECT CAST(row_number() OVER (ORDER BY min(s)) - 1 AS INTEGER) AS segment, min(s) AS start_frame, max(e) AS end_frame, max(e) - min(s) + 1 AS n_frames
    FROM pad GROUP BY island""")
def q_autoclip_sampled(spark, d):
    spine = activity.strided(_spine(spark), 3)
    n = activity.people_per_frame(_detections(spark, d), spine, ["game"])
    samples = n.select("game", "sample", (F.col("n") >= PEOPLE).alias("active"))
    return intervals.sampled_segments(samples, ["game"], 1.0, 3, HOURS, 6, 2, 1).drop("game")


@query(f"""WITH {SEGS} SELECT CAST(sum(end_frame - start_frame + 1) AS DOUBLE) AS live_seconds,
    round_even(1 - sum(end_frame - start_frame + 1) / {HOURS}.0::DOUBLE, 6) AS savings_frac FROM seg""")
def q_savings(spark, d):
    live = intervals.total_live_seconds(_segments(spark, d), [], 1.0)
    return live.withColumn("savings_frac", F.bround(intervals.savings("live_seconds", F.lit(float(HOURS))), 6))


@query(f"WITH {SEGS} SELECT sp.frame, CAST(max(segment) AS INTEGER) AS segment FROM spine sp LEFT JOIN seg ON sp.frame BETWEEN start_frame AND end_frame GROUP BY 1")
def q_frame_segment_index(spark, d):
    return intervals.frame_segments(_segments(spark, d), _spine(spark), ["game"]).select("frame", "segment")


# --- shifts ---------------------------------------------------------------------------------


def _shifts(spark: SparkSession, d: str) -> DataFrame:
    spans = _events(spark, d).select("user_id", F.col("sec").alias("first_frame"), F.col("sec").alias("last_frame"))
    return intervals.shifts(spans, ["user_id"], 1.0, GAP)


SHIFTS = (
    f"{EV}, pts AS (SELECT user_id, sec AS s, sec AS e FROM ev), {ISLANDS.format(p='isl', w='PARTITION BY user_id', tol=GAP, src='pts')}, "
    """sh AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_frame) - 1 AS INTEGER) AS shift, start_frame, end_frame,
        end_frame - start_frame + 1 AS n_frames, n_fragments FROM (
        SELECT user_id, min(s) AS start_frame, max(e) AS end_frame, count(*) AS n_fragments FROM isl GROUP BY user_id, island))"""
)


@query(f"WITH {SHIFTS} SELECT * FROM sh")
def q_shifts(spark, d):
    return _shifts(spark, d)


@query(f"""WITH {SHIFTS} SELECT user_id, count(*) AS n_shifts, CAST(sum(n_fragments) AS BIGINT) AS n_fragments, CAST(sum(n_frames) AS BIGINT) AS total_frames,
    max(n_frames) AS longest_frames, min(start_frame) AS first_frame, max(end_frame) AS last_frame, CAST(sum(n_frames) AS DOUBLE) AS total_seconds,
    CAST(max(n_frames) AS DOUBLE) AS longest_seconds, round_even(sum(n_frames) / count(*)::DOUBLE, 2) AS avg_seconds FROM sh GROUP BY 1""")
def q_shift_summary(spark, d):
    return intervals.shift_summary(_shifts(spark, d), ["user_id"], 1.0)


VOTE = "SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY weight DESC, {l}) AS r FROM (SELECT {k}, {l}, CAST(sum({w}) AS BIGINT) AS weight FROM {t} WHERE {l} IS NOT NULL GROUP BY ALL)"


ROLLUP = """count(*) AS n_fragments, string_agg(CAST(track_id AS VARCHAR), ' ' ORDER BY first_frame, track_id) AS track_ids,
        CAST(sum(s.frames_seen) AS BIGINT) AS frames_seen, CAST(sum(on_surface_frames) AS BIGINT) AS on_surface_frames, CAST(sum(active_frames) AS BIGINT) AS active_frames,
        min(first_frame) AS first_frame, max(last_frame) AS last_frame, round_even(avg(player_conf), 2) AS mean_conf,
        round_even(sum(on_surface_frames) / 30.0::DOUBLE, 2) AS seconds_on_surface, round_even(sum(active_frames) / 30.0::DOUBLE, 2) AS active_seconds"""


@query(f"WITH {SP} SELECT player, {ROLLUP} FROM sp s GROUP BY 1")
def q_player_rollup(spark, d):
    return rollups.player_rollup(_spans(spark, d), ["player"], 30.0)


@query(f"WITH v AS ({VOTE.format(k='l_suppkey', l='l_returnflag', w='l_quantity', t='lineitem')}) SELECT l_suppkey, l_returnflag, weight FROM v WHERE r = 1")
def q_team_vote_weighted(spark, d):
    found = votes.majority(_read(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "l_quantity")
    return found.withColumn("weight", F.col("weight").cast("long"))


@query(f"""WITH {SP}, v AS ({VOTE.format(k='player', l='team', w='frames_seen', t='sp')})
    SELECT s.player, {ROLLUP}, any_value(v.team) AS team FROM sp s JOIN v ON s.player = v.player AND v.r = 1 GROUP BY 1""")
def q_track_ids_listagg(spark, d):
    spans = _spans(spark, d)
    team = votes.majority(spans, ["player"], "team", "frames_seen").drop("weight")
    return rollups.player_rollup(spans, ["player"], 30.0).join(team, "player")


@query(f"""WITH {EV}, w AS (SELECT user_id, event_type, count(*) AS weight, min(sec) AS seen FROM ev GROUP BY 1, 2),
    v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, seen, event_type) AS r FROM w)
    SELECT user_id, event_type, weight FROM v WHERE r = 1""")
def q_vote_first_seen(spark, d):
    return votes.majority(_events(spark, d), ["user_id"], "event_type", seen="sec")


# --- roll-ups -------------------------------------------------------------------------------


def _player_lines(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as players of the return flag's team: lines as frames, cheap lines as live ones."""
    return _read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("track_id"), F.nullif("l_returnflag", F.lit("R")).alias("team")).agg(
        F.count(F.lit(1)).alias("frames_seen"),
        F.count_if(F.col("l_quantity") < 25).alias("active_frames"),
        F.count_if(F.col("l_linestatus") == "O").alias("on_surface_frames"),
        F.median("l_extendedprice").cast("int").alias("median_area_px"),
    )


LINES = """pl AS (SELECT l_suppkey AS track_id, nullif(l_returnflag, 'R') AS team, count(*) AS frames_seen, count(*) FILTER (l_quantity < 25) AS active_frames,
    count(*) FILTER (l_linestatus = 'O') AS on_surface_frames, CAST(trunc(median(l_extendedprice)) AS INTEGER) AS median_area_px FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {LINES} SELECT team, count(*) AS n_players, round_even(sum(round_even(active_frames / 30.0::DOUBLE, 2)), 2) AS active_s,
    round_even(sum(round_even(on_surface_frames / 30.0::DOUBLE, 2)), 2) AS on_surface_s FROM pl GROUP BY 1""")
def q_team_totals(spark, d):
    return rollups.team_totals(_player_lines(spark, d), [], 30.0)


@query("""SELECT CAST(n_nationkey AS INTEGER) AS team, count(*) AS n_players, round_even(sum(round_even(c_acctbal, 2)), 2) AS active_s,
    round_even(sum(floor(c_acctbal)), 2) AS on_surface_s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def q_team_totals_from_players(spark, d):
    players = _read(spark, d, "customer").select(
        F.col("c_nationkey").cast("string").alias("team"),
        F.bround("c_acctbal", 2).cast("string").alias("active_seconds"),
        F.floor("c_acctbal").cast("string").alias("seconds_on_surface"),
    )
    return rollups.team_totals_from_players(players, [])


@query(f"""WITH {LINES} SELECT CASE WHEN grouping(team) = 1 THEN 'game' WHEN grouping(track_id) = 1 THEN 'team' ELSE 'track' END AS level, team, track_id,
    count(*) AS n_players, round_even(sum(round_even(active_frames / 30.0::DOUBLE, 2)), 2) AS active_s,
    round_even(sum(round_even(on_surface_frames / 30.0::DOUBLE, 2)), 2) AS on_surface_s FROM pl GROUP BY GROUPING SETS ((), (team), (team, track_id))""")
def q_boxscore_grouping_sets(spark, d):
    return rollups.boxscore_levels(_player_lines(spark, d), [], 30.0)


@query(f"""WITH {SP}, o AS (SELECT c_nationkey AS nation, player AS track_id, CAST(sum(active_frames) AS BIGINT) AS a, CAST(sum(frames_seen) AS BIGINT) AS f, CAST(sum(on_surface_frames) AS BIGINT) AS o
        FROM sp JOIN customer ON player = c_custkey GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY nation ORDER BY a DESC, f DESC, track_id) - 1 AS INTEGER) AS rank, count(*) OVER (PARTITION BY nation) AS n_players FROM o)
    SELECT nation, rank, track_id, round_even(a / 30.0::DOUBLE, 2) AS active_s, round_even(f / 30.0::DOUBLE, 2) AS seen_s, round_even(o / f::DOUBLE, 3) AS on_surface_frac, n_players
    FROM r WHERE rank < 6""")
def q_boxscore_topk(spark, d):
    spans, customer = _spans(spark, d), _read(spark, d, "customer")
    players = spans.join(customer, spans["player"] == customer["c_custkey"]).groupBy(F.col("c_nationkey").alias("nation"), F.col("player").alias("track_id")).agg(
        *[F.sum(c).alias(c) for c in ("frames_seen", "active_frames", "on_surface_frames")], F.lit(None).cast("int").alias("team"), F.lit(0).alias("median_area_px")
    )
    header = players.select("nation").distinct().withColumn("frames", F.lit(900))
    score = rollups.boxscore(players, ["nation"], header, 30.0)
    lines = score.select("nation", F.col("game.n_players").alias("n_players"), F.posexplode("players").alias("rank", "p")).where("rank < 6")
    return lines.select("nation", "rank", "p.track_id", "p.active_s", "p.seen_s", "p.on_surface_frac", "n_players")


@query(f"""WITH {SP} SELECT player, team, round_even(sum(round_even(active_frames / 30.0::DOUBLE, 2)), 2) AS active_s FROM sp WHERE frames_seen >= 3 GROUP BY 1, 2""")
def q_team_active_seconds(spark, d):
    rows = _spans(spark, d).withColumn("role", F.when(F.col("frames_seen") >= 3, "player").otherwise("spectator"))
    return rollups.team_active_seconds(rows, ["player"], 30.0)


@query(f"""WITH {LINES} SELECT track_id, team, round_even(active_frames / 30.0::DOUBLE, 2) AS active_s, round_even(on_surface_frames / 30.0::DOUBLE, 2) AS on_surface_s,
    round_even(frames_seen / 30.0::DOUBLE, 2) AS seen_s, round_even(on_surface_frames / frames_seen::DOUBLE, 3) AS on_surface_frac, median_area_px, active_frames, frames_seen FROM pl""")
def q_boxscore_players(spark, d):
    return rollups.player_records(_player_lines(spark, d), [], 30.0)


# --- overlap, concurrency, validation ---------------------------------------------------------


@query(f"""WITH {SP} SELECT a.player, a.track_id AS a, b.track_id AS b FROM sp a JOIN sp b ON a.player = b.player AND a.track_id < b.track_id
    AND greatest(a.first_frame, b.first_frame) <= least(a.last_frame, b.last_frame) + 3""")
def q_overlap_pairs(spark, d):
    return intervals.overlap_pairs(_spans(spark, d), ["player"], "track_id", "first_frame", "last_frame", 3).select("player", "a", "b")


@query(f"""WITH {SP} SELECT a.player, a.track_id AS a, b.track_id AS b FROM sp a JOIN sp b ON a.player = b.player AND a.track_id < b.track_id
    AND greatest(a.first_frame, b.first_frame) <= least(a.last_frame, b.last_frame) + 3""")
def q_overlap_pairs_bucketed(spark, d):
    found = intervals.overlap_pairs_bucketed(_spans(spark, d), ["player"], "track_id", "first_frame", "last_frame", 64, 3)
    return found.select("player", "a", "b")


@query(f"""WITH {SP}, ev2 AS (SELECT team, first_frame AS t, 1 AS d FROM sp UNION ALL SELECT team, last_frame + 1, -1 FROM sp),
    g AS (SELECT team, t, sum(d) AS d FROM ev2 GROUP BY 1, 2), r AS (SELECT team, sum(d) OVER (PARTITION BY team ORDER BY t) AS n FROM g)
    SELECT team, CAST(max(n) AS BIGINT) AS peak FROM r GROUP BY 1""")
def q_peak_concurrency(spark, d):
    return intervals.peak_concurrency(_spans(spark, d), ["team"], "first_frame", "last_frame")


@query(f"""WITH {SP}, p AS (SELECT a.team AS ta, b.team AS tb, greatest(a.first_frame, b.first_frame) <= least(a.last_frame, b.last_frame) AS bad
        FROM sp a JOIN sp b ON a.player = b.player AND a.track_id < b.track_id)
    SELECT count(*) AS pairs, count(*) FILTER (bad) AS violations, count(*) FILTER (ta IS NOT NULL AND tb IS NOT NULL) AS checkable,
           count(*) FILTER (ta = tb) AS same, count(*) FILTER (ta <> tb) AS "cross", CASE WHEN count(*) FILTER (bad) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM p""")
def q_validate_identity(spark, d):
    return evaluation.validate_identities(_spans(spark, d), [])


# --- live axis --------------------------------------------------------------------------------


LIVE_AXIS = SEGS + ", tl AS (SELECT *, coalesce(sum(end_frame - start_frame + 1) OVER (ORDER BY start_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS live_start FROM seg)"


@query(f"""WITH {LIVE_AXIS} SELECT d.track_id, d.frame, CAST(live_start + d.frame - start_frame AS BIGINT) AS live_frame
    FROM det d JOIN tl ON d.frame BETWEEN start_frame AND end_frame""")
def q_live_timeline(spark, d):
    timeline = intervals.live_timeline(_segments(spark, d), ["game"])
    points = _detections(spark, d).select("game", "track_id", "frame")
    return intervals.to_live(points, timeline, ["game"], strict=False).where("live_frame IS NOT NULL").select("track_id", "frame", "live_frame")


@query(f"""WITH {LIVE_AXIS}, total AS (SELECT sum(end_frame - start_frame + 1) AS n FROM seg), pts AS (SELECT range AS live_frame FROM range({HOURS}), total WHERE range <= n + 3)
    SELECT p.live_frame, CAST(least(end_frame, start_frame + p.live_frame - live_start) AS BIGINT) AS game_frame FROM pts p JOIN tl
    ON tl.live_start = (SELECT max(live_start) FROM tl t2 WHERE t2.live_start <= p.live_frame)""")
def q_live_to_game_roundtrip(spark, d):
    segs = _segments(spark, d)
    total = segs.groupBy("game").agg(F.sum("n_frames").alias("n"))
    points = _spine(spark).withColumnRenamed("frame", "live_frame").join(total, "game").where("live_frame <= n + 3").drop("n")
    return intervals.to_game(points, intervals.live_timeline(segs, ["game"]), ["game"]).select("live_frame", "game_frame")


@query(f"""WITH {LIVE_AXIS}, lv AS (SELECT d.track_id AS player, live_start + d.frame - start_frame AS s, live_start + d.frame - start_frame AS e
        FROM det d JOIN tl ON d.frame BETWEEN start_frame AND end_frame), {ISLANDS.format(p='gi', w='PARTITION BY player', tol=6, src='lv')},
    gs AS (SELECT player, min(s) AS ls, max(e) AS le, count(*) AS n_fragments FROM gi GROUP BY player, island)
    SELECT player, CAST(row_number() OVER (PARTITION BY player ORDER BY ls) - 1 AS INTEGER) AS shift, CAST(le - ls + 1 AS BIGINT) AS n_frames, n_fragments,
        CAST(a.start_frame + ls - a.live_start AS BIGINT) AS start_frame, CAST(b.start_frame + le - b.live_start AS BIGINT) AS end_frame
    FROM gs JOIN tl a ON ls >= a.live_start AND ls < a.live_start + a.end_frame - a.start_frame + 1
            JOIN tl b ON le >= b.live_start AND le < b.live_start + b.end_frame - b.start_frame + 1""")
def q_game_shifts(spark, d):
    segs = _segments(spark, d)
    inside = intervals.frame_segments(segs, _spine(spark), ["game"]).where("segment IS NOT NULL")
    spans = _detections(spark, d).join(inside.select("game", "frame"), ["game", "frame"], "left_semi")
    spans = spans.select("game", F.col("track_id").alias("player"), F.col("frame").alias("first_frame"), F.col("frame").alias("last_frame"))
    found = game.game_shifts(spans, segs, ["game"], 1.0, 6)
    return found.select("player", "shift", "n_frames", "n_fragments", "start_frame", "end_frame")


# --- vectors ----------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings")


VEC = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    u AS (SELECT vec_id, label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) AS u FROM e),
    parts AS (SELECT label, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM u),
    m AS (SELECT label, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS a FROM parts GROUP BY 1, 2) GROUP BY 1),
    cen AS (SELECT label, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-8)) AS c FROM m)"""


def _unit(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", "label", l2_normalised("embedding").alias("u"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return vectors.pooled(_vectors(spark, d), ["label"])


@query(f"WITH {VEC} SELECT label, CAST(i - 1 AS INTEGER) AS i, round_even(x, 6) AS x FROM (SELECT label, generate_subscripts(c, 1) AS i, unnest(c) AS x FROM cen)")
def q_l2norm_pool(spark, d):
    return _centroids(spark, d).select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.bround("x", 6))


@query(f"""WITH {VEC}, raw AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
    rm AS (SELECT label, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS a FROM raw GROUP BY 1, 2) GROUP BY 1)
    SELECT label, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS i, round_even(unnest(list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-8))), 6) AS x FROM rm""")
def q_identity_centroids(spark, d):
    found = vectors.identity_centroids(_vectors(spark, d), ["label"], "embedding")
    return found.select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.bround("x", 6))


@query(f"""WITH {VEC} SELECT a.label, count(*) AS pairs, round_even(avg(least(2, greatest(0, 1 - list_dot_product(a.u, b.u)))), 6) AS mean_distance
    FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def q_cosine_pairs(spark, d):
    pairs = vectors.cosine_pairs(_unit(spark, d), ["label"], "vec_id", "u")
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.bround(F.avg("distance"), 6).alias("mean_distance"))


@query(f"""WITH {VEC}, s AS (SELECT vec_id, cen.label, list_dot_product(u, c) AS similarity FROM u CROSS JOIN cen),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, label) AS r FROM s)
    SELECT vec_id, label, round_even(similarity, 6) AS similarity FROM r WHERE r = 1""")
def q_nearest_centroid(spark, d):
    points = _unit(spark, d).select(F.lit(1).alias("game"), "vec_id", "u")
    centres = _centroids(spark, d).withColumn("game", F.lit(1))
    found = vectors.nearest_centroid(points, centres, ["game"], "vec_id", "u", "label")
    return found.select("vec_id", "label", F.bround("similarity", 6).alias("similarity"))


@query(f"""WITH {VEC}, s AS (SELECT vec_id, max(list_dot_product(u, c)) FILTER (u.label = cen.label) AS own, max(list_dot_product(u, c)) FILTER (u.label <> cen.label) AS other
        FROM u CROSS JOIN cen GROUP BY 1)
    SELECT vec_id, round_even(least(1, greatest(0, (own - other) * 0.5 + 0.5)), 6) AS confidence, round_even(least(1, greatest(0, (own - other + 2) / 4)), 6) AS team_conf FROM s""")
def q_identity_confidence(spark, d):
    points = _unit(spark, d).withColumn("game", F.lit(1))
    centres = _centroids(spark, d).withColumn("game", F.lit(1))
    found = vectors.own_and_other(points, centres, ["game"], "vec_id", "u", "label")
    return found.select("vec_id", F.bround(vectors.identity_confidence(), 6).alias("confidence"), F.bround(vectors.team_confidence(), 6).alias("team_conf"))


@query(f"""WITH {VEC}, g AS (SELECT *, vec_id // 100 AS game FROM u),
    p AS (SELECT a.game, a.vec_id, a.label AS la, b.label AS lb, avg(list_distance(a.u, b.u)) AS m FROM g a JOIN g b ON a.game = b.game AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4),
    q AS (SELECT game, vec_id, max(m) FILTER (la = lb) AS i, min(m) FILTER (la <> lb) AS o FROM p GROUP BY 1, 2)
    SELECT game, round_even(avg(CASE WHEN i IS NULL THEN 0 ELSE (o - i) / greatest(i, o) END), 6) AS silhouette FROM q GROUP BY 1""")
def q_silhouette(spark, d):
    points = _unit(spark, d).withColumn("game", F.floor(F.col("vec_id") / 100))
    found = vectors.silhouette(points, ["game"], "vec_id", "u", "label")
    return found.withColumn("silhouette", F.bround("silhouette", 6))


@query("""WITH s AS (SELECT vec_id % 50 AS segment, vec_id AS local_id FROM embeddings)
    SELECT a.segment, a.local_id AS a, b.local_id AS b FROM s a JOIN s b ON a.segment = b.segment AND a.local_id < b.local_id""")
def q_cannot_link_same_segment(spark, d):
    rows = _vectors(spark, d).select((F.col("vec_id") % 50).alias("segment"), F.col("vec_id").alias("local_id"))
    return game.cannot_link(rows, [])


@query("""WITH n AS (SELECT vec_id // 100 AS game, label, count(*) AS n FROM embeddings GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY game ORDER BY n DESC, label) - 1 AS INTEGER) AS anchor FROM n) SELECT * FROM r WHERE anchor < 2""")
def q_largest_two(spark, d):
    return vectors.largest_two(_vectors(spark, d).withColumn("game", F.floor(F.col("vec_id") / 100)), ["game"], "label")


@query("""WITH m AS (SELECT l_returnflag AS label, median(l_discount) AS h, median(l_quantity) AS s, median(l_tax) AS v FROM lineitem GROUP BY 1)
    SELECT label, h, s, v, CAST(row_number() OVER (ORDER BY s DESC, v DESC, h, label) - 1 AS INTEGER) AS new_label FROM m""")
def q_color_anchor(spark, d):
    rows = _read(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.col("l_discount").alias("h"), F.col("l_quantity").alias("s"), F.col("l_tax").alias("v")
    )
    return vectors.ordered_by_color(rows, [], "label")


@query("""WITH c AS (SELECT l_returnflag AS label, l_partkey * 7 % 256 / 255.0::DOUBLE AS b, l_suppkey * 31 % 256 / 255.0::DOUBLE AS g, l_orderkey * 13 % 256 / 255.0::DOUBLE AS r FROM lineitem),
    x AS (SELECT *, greatest(b, g, r) AS hi, greatest(b, g, r) - least(b, g, r) AS span FROM c),
    f AS (SELECT label, 30 * CASE WHEN span < 1e-9 THEN 0 WHEN hi = r THEN ((g - b) / span % 6 + 6) % 6 WHEN hi = g THEN (b - r) / span + 2 ELSE (r - g) / span + 4 END AS h,
        255 * CASE WHEN hi < 1e-9 THEN 0 ELSE span / hi END AS s, 255 * hi AS v FROM x)
    SELECT label, round_even(median(h), 6) AS h, round_even(median(s), 6) AS s, round_even(median(v), 6) AS v FROM f GROUP BY 1""")
def q_hsv_medians(spark, d):
    rows = _read(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("label"), scalars.hsv(F.col("l_partkey") * 7 % 256, F.col("l_suppkey") * 31 % 256, F.col("l_orderkey") * 13 % 256).alias("c")
    )
    medians = rows.groupBy("label").agg(pixels.element_medians(F.array("c.h", "c.s", "c.v"), 3).alias("m"))
    return medians.select("label", *[F.bround(F.col("m")[i], 6).alias(c) for i, c in enumerate("hsv")])


@query("""SELECT p_brand, round_even(corr(CAST(l_extendedprice AS DOUBLE), ln(CAST(p_size AS DOUBLE) + 1e-6)), 6) AS r
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def q_scale_corr(spark, d):
    lines, part = _read(spark, d, "lineitem"), _read(spark, d, "part")
    joined = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    return joined.groupBy("p_brand").agg(F.bround(safe_corr("l_extendedprice", log_size("p_size")), 6).alias("r"))


# --- evaluation -------------------------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _read(spark, d, "documents"), _read(spark, d, "labels")
    return docs.select("doc_id", F.col("lang").alias("pred")).join(labels.select("doc_id", F.col("quality").alias("true")), "doc_id")


@query("SELECT lang AS pred, CAST(quality AS VARCHAR) AS \"true\", count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1, 2")
def q_contingency(spark, d):
    return evaluation.contingency(_labelled(spark, d))


@query("""WITH c AS (SELECT count(*) FILTER (toxic = 0 AND quality = 0) AS a, count(*) FILTER (toxic = 0 AND quality = 1) AS b, count(*) FILTER (toxic = 1 AND quality = 0) AS c,
        count(*) FILTER (toxic = 1 AND quality = 1) AS d, count(*) AS n FROM labels)
    SELECT n, greatest(a + d, b + c) AS correct, greatest(a + d, b + c) / n::DOUBLE AS accuracy FROM c""")
def q_best_map_accuracy_2x2(spark, d):
    pairs = _read(spark, d, "labels").select(F.col("toxic").alias("pred"), F.col("quality").alias("true"))
    return evaluation.mapped_accuracy(evaluation.contingency(pairs.withColumn("game", F.lit(1)), ["game"]), ["game"]).select("n", "correct", "accuracy")


@query("""SELECT count(*) AS n, CAST(sum(CASE WHEN toxic = 1 - quality THEN 1 ELSE 0 END) AS BIGINT) AS correct,
    avg(CASE WHEN toxic = 1 - quality THEN 1.0 ELSE 0.0 END) AS accuracy FROM labels""")
def q_direct_accuracy(spark, d):
    pairs = _read(spark, d, "labels").select(F.col("toxic").alias("pred"), (1 - F.col("quality")).alias("true"))
    return evaluation.direct_accuracy(pairs, [])


@query("""WITH p AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'a' ELSE 'b' END AS team, CAST(n_chars % 2 AS VARCHAR) AS role FROM documents WHERE lang = 'en'),
    j AS (SELECT l.doc_id, p.team AS pt, p.role AS pr, l.toxic AS t, CAST(l.quality AS VARCHAR) AS q FROM labels l LEFT JOIN p USING (doc_id)),
    c AS (SELECT count(pt) AS n, count(*) - count(pt) AS missing, count(*) FILTER (pt = 'a' AND t = 0) AS a0, count(*) FILTER (pt = 'a' AND t = 1) AS a1,
        count(*) FILTER (pt = 'b' AND t = 0) AS b0, count(*) FILTER (pt = 'b' AND t = 1) AS b1, count(*) FILTER (pr = q) AS same FROM j)
    SELECT 'team' AS field, n AS n_overlap, missing AS n_missing, greatest(a0 + b1, a1 + b0) AS correct, greatest(a0 + b1, a1 + b0) / n::DOUBLE AS accuracy FROM c
    UNION ALL SELECT 'role', n, missing, same, same / n::DOUBLE FROM c""")
def q_label_overlap_missing(spark, d):
    odd = F.col("n_chars") % 2
    pred = _read(spark, d, "documents").where("lang = 'en'").select(  # English documents have predictions
        F.col("doc_id").alias("track_id"), F.when(odd == 0, "a").otherwise("b").alias("team"), odd.cast("string").alias("role")
    )
    human = _read(spark, d, "labels").select(F.col("doc_id").alias("track_id"), F.col("toxic").cast("string").alias("team"), F.col("quality").cast("string").alias("role"))
    return evaluation.evaluate(pred, human, {"team": True, "role": False}).drop("mapping")


def _tagged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tracks_ = _read(spark, d, "documents").select(
        F.col("doc_id").alias("track_id"), F.col("lang").alias("team"), F.col("source").alias("player"), F.col("n_chars").cast("string").alias("frames_seen")
    )
    labels = _read(spark, d, "labels").select(
        F.col("doc_id").alias("track_id"), F.concat(F.lit("q"), F.col("quality")).alias("team"), F.concat(F.lit("t"), F.col("toxic")).alias("player")
    )
    return tracks_, labels


TAGS = f"""t AS (SELECT doc_id AS track_id, lang AS cl, source AS cp, CAST(n_chars AS BIGINT) AS w, 'q' || quality AS lt, 't' || toxic AS lp FROM documents LEFT JOIN labels USING (doc_id)),
    vt AS ({VOTE.format(k='cl', l='lt', w='greatest(1, w)', t='t')}), vp AS ({VOTE.format(k='cp', l='lp', w='greatest(1, w)', t='t')})"""


@query(f"""WITH {TAGS} SELECT track_id, coalesce(t.lt, vt.lt) AS team_name, coalesce(t.lp, vp.lp) AS player_name,
        CASE WHEN t.lt IS NOT NULL THEN 'direct' WHEN vt.lt IS NOT NULL THEN 'inherited' END AS team_source,
        CASE WHEN t.lp IS NOT NULL THEN 'direct' WHEN vp.lp IS NOT NULL THEN 'inherited' END AS player_source
    FROM t LEFT JOIN vt ON t.cl = vt.cl AND vt.r = 1 LEFT JOIN vp ON t.cp = vp.cp AND vp.r = 1""")
def q_propagate_labels(spark, d):
    return evaluation.propagate_labels(*_tagged(spark, d))


APPLIED = f"""{TAGS}, ap AS (SELECT track_id, coalesce(t.lt, vt.lt, '') AS team_name, coalesce(t.lp, vp.lp, '') AS player_name, t.lt IS NOT NULL AS dt, t.lp IS NOT NULL AS dp,
        t.lt IS NULL AND vt.lt IS NOT NULL AS it, t.lp IS NULL AND vp.lp IS NOT NULL AS ip
    FROM t LEFT JOIN vt ON t.cl = vt.cl AND vt.r = 1 LEFT JOIN vp ON t.cp = vp.cp AND vp.r = 1)"""


@query(f"WITH {APPLIED} SELECT track_id, team_name, player_name FROM ap")
def q_applied_labels(spark, d):
    return label_plans.applied(*_tagged(spark, d)).select("track_id", "team_name", "player_name")


@query(f"WITH {APPLIED} SELECT count(*) FILTER (dt OR dp) AS n_direct, count(*) FILTER (it) + count(*) FILTER (ip) AS n_propagated FROM ap")
def q_propagation_summary(spark, d):
    return evaluation.propagation_summary(evaluation.propagate_labels(*_tagged(spark, d)))


@query(f"""WITH {TAGS} SELECT 'mixed cluster' AS kind, cp AS key, string_agg(DISTINCT lp, ' ' ORDER BY lp) AS labels FROM t WHERE lp IS NOT NULL GROUP BY cp HAVING count(DISTINCT lp) > 1
    UNION ALL SELECT 'split label', lp, string_agg(DISTINCT cp, ' ' ORDER BY cp) FROM t WHERE lp IS NOT NULL GROUP BY lp HAVING count(DISTINCT cp) > 1""")
def q_label_conflicts(spark, d):
    return evaluation.label_conflicts(*_tagged(spark, d)).withColumn("labels", F.array_join("labels", " "))


CHART = SHIFTS + """, named AS (SELECT user_id, CASE WHEN (user_id + shift) % 3 < 2 THEN (user_id + shift) % 3 END AS team, shift, start_frame AS a, end_frame + 1 AS b FROM sh),
    bars AS (SELECT user_id, list(team ORDER BY shift)[1] AS team, round_even(sum(CAST(b - a AS DOUBLE)), 2) AS toi_s, count(*) AS n_shifts, CAST(max(b - a) AS DOUBLE) AS longest_s FROM named GROUP BY 1)"""


def _chart(spark: SparkSession, d: str, keys: list[str] | None = None) -> DataFrame:
    found = intervals.timed(_shifts(spark, d), 1.0).withColumnRenamed("user_id", "player")
    third = (F.col("player") + F.col("shift")) % 3
    found = found.withColumn("team", F.when(third < 2, third).cast("string")).withColumn("game", F.col("player") % 7)
    names = found.where("player % 10 = 0").select("game", "player", F.concat(F.lit(" n"), F.col("player")).alias("name")).distinct()
    return report.chart_rows(found, names, keys)


@query(f"""WITH {CHART} SELECT CAST(row_number() OVER (ORDER BY team NULLS LAST, toi_s DESC, user_id) - 1 AS INTEGER) AS row, user_id AS player, CAST(team AS INTEGER) AS team,
    CASE WHEN user_id % 10 = 0 THEN 'n' ELSE 'P' END || user_id || coalesce(' (T' || team || ')', '') AS label, toi_s, n_shifts, longest_s, n_shifts AS n_bars FROM bars""")
def q_shift_chart(spark, d):
    return _chart(spark, d).withColumn("n_bars", F.size("bars").cast("long")).drop("bars")


@query(f"""WITH {CHART} SELECT user_id % 7 AS game, CAST(row_number() OVER (PARTITION BY user_id % 7 ORDER BY team NULLS LAST, toi_s DESC, user_id) - 1 AS INTEGER) AS row,
    user_id AS player, CAST(team AS INTEGER) AS team FROM bars""")
def q_first_value_per_player(spark, d):
    return _chart(spark, d, ["game"]).select("game", "row", "player", "team")


# --- games of several segments ------------------------------------------------------------------


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tracks of five segments of 600 frames; customers stand for local identities, thirty for a player."""
    rows = _spans(spark, d).select(
        (F.col("track_id") % 5).alias("segment"),
        "track_id",
        F.when(F.col("track_id") % 11 == 0, "spectator").otherwise("player").alias("role"),
        F.when(F.col("team") == "O", "1").when(F.col("team") == "F", "0.5").otherwise("0").alias("team"),
        F.when(F.col("track_id") % 13 == 0, "").otherwise(F.concat("player", F.lit(".0"))).alias("player"),
        "frames_seen",
        seconds("active_frames", 30.0).alias("active_seconds"),
        seconds("on_surface_frames", 30.0).alias("seconds_on_surface"),
        (F.col("first_frame") % 500).alias("first_frame"),
        (F.col("first_frame") % 500 + 40 + F.col("track_id") % 90).alias("last_frame"),
    )
    mapping = _read(spark, d, "customer").crossJoin(F.broadcast(spark.range(4).withColumnRenamed("id", "segment")))
    mapping = mapping.select("segment", F.col("c_custkey").alias("local_id"), (F.col("c_custkey") % 30).alias("player"))
    segs = spark.range(5).select(F.col("id").alias("segment"), (F.col("id") * 600).alias("start_frame"), (F.col("id") * 600 + 549).alias("end_frame"))
    return game.mapped_tracks(rows, segs, mapping, [])


PLACED = f"""{SP}, pt AS (SELECT track_id % 5 AS segment, player % 30 AS player, 's' || (track_id % 5) || ':' || track_id AS track_id,
        CASE WHEN team = 'O' THEN 1 WHEN team = 'F' THEN NULL ELSE 0 END AS team, frames_seen, round_even(active_frames / 30.0::DOUBLE, 2) AS active_seconds,
        round_even(on_surface_frames / 30.0::DOUBLE, 2) AS seconds_on_surface, least(track_id % 5 * 600 + first_frame % 500, track_id % 5 * 600 + 549) AS first_frame,
        least(track_id % 5 * 600 + first_frame % 500 + 40 + track_id % 90, track_id % 5 * 600 + 549) AS last_frame
    FROM sp WHERE track_id % 11 <> 0 AND track_id % 13 <> 0 AND track_id % 5 < 4)"""


@query(f"WITH {PLACED} SELECT segment, player, track_id, CAST(team AS INTEGER) AS team, frames_seen, active_seconds, seconds_on_surface, first_frame, last_frame FROM pt")
def q_mapped_tracks(spark, d):
    return _placed(spark, d)


@query(f"""WITH {PLACED}, v AS ({VOTE.format(k='player', l='team', w='greatest(1, frames_seen)', t='pt')}), pf AS (SELECT player, first_frame AS s, last_frame AS e FROM pt),
    {ISLANDS.format(p='isl', w='PARTITION BY player', tol=20, src='pf')},
    sh AS (SELECT player, count(*) AS n_shifts, CAST(sum(n) AS DOUBLE) AS total, max(n) AS longest FROM (SELECT player, max(e) - min(s) + 1 AS n FROM isl GROUP BY player, island) GROUP BY 1),
    li AS (SELECT player, count(*) AS n_fragments, string_agg(track_id, ' ' ORDER BY segment, first_frame, track_id) AS track_ids, CAST(sum(frames_seen) AS BIGINT) AS frames_seen,
        round_even(sum(seconds_on_surface), 2) AS seconds_on_surface, round_even(sum(active_seconds), 2) AS active_seconds, min(first_frame) AS first_frame, max(last_frame) AS last_frame FROM pt GROUP BY 1)
    SELECT li.*, CAST(v.team AS INTEGER) AS team, n_shifts, round_even(total / 2, 2) AS shift_seconds, round_even(longest / 2.0::DOUBLE, 2) AS longest_shift_s, round_even(total / n_shifts / 2, 2) AS avg_shift_s
    FROM li JOIN sh USING (player) LEFT JOIN v ON li.player = v.player AND v.r = 1""")
def q_game_players(spark, d):
    placed = _placed(spark, d)
    found = intervals.shifts(placed, ["player"], 2.0, 10.0)
    return game.game_players(placed, found, [], 2.0)


@query(f"""WITH {SEGS} SELECT CAST(0 AS BIGINT) AS game, round_even({HOURS} / 2.0::DOUBLE, 2) AS duration_s, round_even(sum(end_frame - start_frame + 1) / 2.0::DOUBLE, 2) AS live_play_s, count(*) AS n_segments,
    (SELECT count(DISTINCT track_id) FROM det WHERE frame < {HOURS}) AS n_players, round_even(sum(end_frame - start_frame + 1) / {HOURS}.0::DOUBLE, 4) AS active_fraction FROM seg HAVING count(*) > 0""")
def q_game_header(spark, d):
    segs = _segments(spark, d).withColumn("total_frames", F.lit(HOURS))
    players = _detections(spark, d).select("game", F.col("track_id").alias("player"))
    return game.game_header(segs, players, ["game"], 2.0, F.col("total_frames"))


@query(f"WITH {SEGS} SELECT CAST(segment AS INTEGER) AS segment, start_frame, end_frame FROM seg WHERE segment < 5")
def q_first_segments(spark, d):
    return game.first_segments(_segments(spark, d), ["game"], 5).select("segment", "start_frame", "end_frame")


@query("""SELECT l_orderkey, l_linenumber, greatest(0, CAST(trunc(l_quantity * 20 - 15.5) AS INTEGER)) AS x1, greatest(0, CAST(trunc(l_tax * 1000 - 9.25) AS INTEGER)) AS y1,
    least(800, CAST(trunc(l_quantity * 20 + 170.5) AS INTEGER)) AS x2, least(70, CAST(trunc(l_tax * 1000 + 101.75) AS INTEGER)) AS y2 FROM lineitem
    WHERE least(800, CAST(trunc(l_quantity * 20 + 170.5) AS INTEGER)) > greatest(0, CAST(trunc(l_quantity * 20 - 15.5) AS INTEGER))
      AND least(70, CAST(trunc(l_tax * 1000 + 101.75) AS INTEGER)) > greatest(0, CAST(trunc(l_tax * 1000 - 9.25) AS INTEGER))""")
def q_crop_box(spark, d):
    x, y = F.col("l_quantity") * 20, F.col("l_tax") * 1000
    box = scalars.crop_box(x, y, x + 155, y + 92.5, 800, 70, 0.1)
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box")).where("box IS NOT NULL").select("l_orderkey", "l_linenumber", "box.*")


@query(f"""WITH {SP}, t AS (SELECT track_id, CASE WHEN track_id % 3 = 0 THEN 'n' || (track_id % 7) ELSE '' END AS name, player, CAST(frames_seen AS BIGINT) AS w FROM sp),
    tn AS (SELECT player, name, w FROM t WHERE name <> ''), v AS ({VOTE.format(k='player', l='name', w='greatest(1, w)', t='tn')})
    SELECT CAST(c_custkey AS VARCHAR) AS player, coalesce(v.name, '') AS name, c_nationkey FROM customer LEFT JOIN v ON c_custkey = v.player AND v.r = 1""")
def q_named_players(spark, d):
    """Names from tracks onto players, text as in the files of a run."""
    name = F.when(F.col("track_id") % 3 == 0, F.concat(F.lit("n"), F.col("track_id") % 7)).otherwise("")
    rows = _spans(spark, d).select(F.col("player").cast("string").alias("player"), name.alias("player_name"), F.col("frames_seen").cast("string").alias("frames_seen"))
    players = _read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("player"), "c_nationkey")
    return label_plans.named_players(players, rows)


@query("""SELECT n_nationkey, 'T' || (n_nationkey % 4) AS team, 'P' || n_nationkey || CASE WHEN n_nationkey % 4 < 3 THEN ' (T' || (n_nationkey % 4) || ')' ELSE '' END AS player,
    CASE n_nationkey % 4 WHEN 0 THEN '#3cdc3c' WHEN 1 THEN '#f03c3c' ELSE '#9c9c9c' END AS color, replace('<' || n_name || '&>', '&', '&amp;').replace('<', '&lt;').replace('>', '&gt;') AS html,
    format('segment_{:03d}_{}s-{}s.mp4', n_nationkey, n_nationkey * 3 // 2, n_nationkey * 2) AS file, 'data:text/plain;base64,' || to_base64(encode(n_name)) AS uri,
    CAST(least(abs(n_nationkey * 7 - 90), 180 - abs(n_nationkey * 7 - 90)) AS BIGINT) AS hue, greatest(0, n_nationkey - 5.0::DOUBLE) AS bar,
    CASE WHEN n_nationkey + 3 > 0 THEN least(1, greatest(0, 3 / (n_nationkey + 3.0::DOUBLE))) END AS margin FROM nation""")
def q_labels_and_colors(spark, d):
    key = F.col("n_nationkey")
    team = key % 4
    return _read(spark, d, "nation").select(
        "n_nationkey",
        scalars.team_label(team).alias("team"),
        scalars.player_label(key, None, F.when(team < 3, team)).alias("player"),
        scalars.team_color(team).alias("color"),
        scalars.escape_html(F.concat(F.lit("<"), "n_name", F.lit("&>"))).alias("html"),
        scalars.clip_filename(key, key * 1.5, key * 2).alias("file"),
        scalars.data_uri(F.col("n_name").cast("binary"), "text/plain").alias("uri"),
        scalars.hue_distance(key * 7, F.lit(90)).cast("long").alias("hue"),
        scalars.bar_duration(F.lit(5.0), key).alias("bar"),
        vectors.margin_confidence(key.cast("double"), F.lit(3.0)).alias("margin"),
    )


# --- clustering: no SQL ------------------------------------------------------------------------


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as tracks of clips of at most 100, with made-up spans and sizes."""
    return _vectors(spark, d).select(
        F.floor(F.col("vec_id") / 100).alias("game"),
        F.col("vec_id").alias("track_id"),
        "embedding",
        "label",
        (F.col("vec_id") * 37 % 500).alias("first_frame"),
        (F.col("vec_id") * 37 % 500 + 20 + F.col("vec_id") % 30).alias("last_frame"),
        (1500.0 + F.col("vec_id") * 7919 % 4000).alias("area"),
    )


@query()
def q_constrained_agglomerative(spark, d):
    return clustering.assign_identities(_clips(spark, d), ["game"], threshold=0.6).select("game", "track_id", "player", "player_conf", "blocked")


@query()
def q_team_cluster(spark, d):
    return clustering.assign_teams(_clips(spark, d), ["game"], size="area")


@query()
def q_kit_split(spark, d):
    chroma = F.when(F.col("label") % 2 == 0, F.array(F.lit(0.5), F.col("embedding")[0] / 20)).otherwise(F.array(F.lit(0.05), F.lit(0.05)))
    return clustering.assign_teams(_clips(spark, d).withColumn("chroma", chroma), ["game"], chroma="chroma")


@query()
def q_cross_segment_merge(spark, d):
    rows = _clips(spark, d).select("game", (F.col("track_id") % 5).alias("segment"), F.col("track_id").alias("local_id"), F.col("embedding").alias("centroid"))
    return clustering.merge_segment_identities(rows, ["game"], threshold=0.6)


@query()
def q_hungarian_accuracy(spark, d):
    found = clustering.assign_identities(_clips(spark, d), ["game"], target=10)
    pairs = found.join(_clips(spark, d).select("track_id", F.col("label").alias("true")), "track_id").withColumn("pred", F.col("player"))
    return evaluation.mapped_accuracy(evaluation.contingency(pairs, ["game"]), ["game"])


# --- time conversion ---------------------------------------------------------------------------


@query(f"WITH {SP} SELECT track_id, round_even((last_frame - first_frame + 1) / 29.97::DOUBLE, 2) AS seconds, CASE WHEN frames_seen % 2 = 0 THEN 0.0 ELSE round_even(frames_seen / 8.0::DOUBLE, 2) END AS seen FROM sp")
def q_frames_to_seconds(spark, d):
    fps = F.when(F.col("frames_seen") % 2 == 0, 0.0).otherwise(8.0)
    return _spans(spark, d).select("track_id", seconds(F.col("last_frame") - F.col("first_frame") + 1, 29.97).alias("seconds"), seconds("frames_seen", fps).alias("seen"))
