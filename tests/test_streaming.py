import random

from pyspark.sql import functions as F

from spanloom.streaming import presence

EVENTS = "user_id long, ts timestamp, frame long, game_id long, track_id long, blue double, green double, red double"


def stream(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, EVENTS.replace("ts timestamp", "t long")).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.select("user_id", "ts", "frame", "game_id", "track_id", "blue", "green", "red").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), spark.read.schema(EVENTS).parquet(str(tmp_path / "in"))


def run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def rows_of(n):
    return [(i % 3, 1_700_000_000 + i * 100, i // 2, 1, i % 2, *([10.0] * 3 if i % 2 else [200.0] * 3)) for i in range(n)]


def test_presence_equals_batch(spark, tmp_path):
    live, batch = stream(spark, tmp_path, rows_of(60))
    found = run(presence.running_presence(live, ["user_id"]), "presence_out", "complete")
    assert sorted(found.collect()) == sorted(presence.running_presence(batch, ["user_id"]).collect())


def test_emitted_sessions_are_the_closed_batch_sessions(spark, tmp_path):
    """Over several micro-batches; what is missing ends after the last watermark."""
    rng = random.Random(1)
    rows = [(rng.randrange(5), 1_700_000_000 + i * 60 + rng.randrange(50), 0, 1, 0, 0.0, 0.0, 0.0) for i in range(600)]
    df = spark.createDataFrame(rows, EVENTS.replace("ts timestamp", "t long")).withColumn("ts", F.timestamp_seconds("t"))
    df.withColumn("part", F.floor((F.col("t") - 1_700_000_000) / 6000)).drop("t").repartition("part").sortWithinPartitions("ts").drop("part").write.option(
        "maxRecordsPerFile", 100
    ).parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    # Files come in no order of time, so the delay is as long as the table: nothing is late.
    query = presence.sessions(live, ["user_id"], "ts", "6 minutes", "12 hours").writeStream.format("memory").queryName("session_out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("session_out").count() == 0 and len(query.recentProgress) > 2
    last = spark.createDataFrame([(9, 1_700_000_000 + 12 * 3600 + 18_000)], "user_id long, t long").select("user_id", F.timestamp_seconds("t").alias("ts"))
    last.selectExpr("user_id", "ts", *[f"CAST(0 AS {t}) AS {c}" for c, t in (f.split() for f in EVENTS.split(", ")[2:])]).write.mode("append").parquet(str(tmp_path / "in"))
    query = presence.sessions(live, ["user_id"], "ts", "6 minutes", "12 hours").writeStream.format("memory").queryName("session_all").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    reached = max(p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p.get("eventTime", {}))
    batch = presence.sessions(spark.read.schema(EVENTS).parquet(str(tmp_path / "in")), ["user_id"], "ts", "6 minutes")
    closed = {tuple(r) for r in batch.where(F.col("end") <= F.lit(reached).cast("timestamp")).collect()}
    assert {tuple(r) for r in spark.table("session_all").collect()} == closed
    assert 20 < len(closed) < batch.count()


def test_color_teams_by_state(spark, tmp_path):
    live, _ = stream(spark, tmp_path, rows_of(40))
    colors = live.select("game_id", "frame", "track_id", "blue", "green", "red")
    found = run(presence.color_teams(colors, 8), "color_out", "append").collect()
    assert len(found) == 40
    late = {(r.track_id, r.team) for r in found if r.frame > 8}
    assert len(late) == 2
