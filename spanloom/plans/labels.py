"""Human labels on a run: apply them to its tables, or score the run against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, lenient_int
from ..operators import evaluation
from ..sources import readers, writers


def evaluate_files(spark: SparkSession, labels_csv: str, tracks_csv: str, fields: dict[str, bool] | None = None) -> DataFrame:
    """Score a tracks file against a labels file; of labels that repeat for a track the last counts."""
    labels, tracks = readers.text_csv(spark, labels_csv), readers.text_csv(spark, tracks_csv)
    chosen = fields or evaluation.FIELDS

    def wide(rows: DataFrame) -> DataFrame:
        out = rows.select(lenient_int("track_id").alias("track_id")).where("track_id IS NOT NULL").distinct()
        for f in chosen:
            out = out.join(readers.csv_column(rows, f), "track_id", "left")
        return out

    return evaluation.evaluate(wide(tracks), wide(labels), chosen)


def applied(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """The tracks with ``team_name, player_name``; columns of an earlier application are replaced."""
    rows = tracks.drop("team_name", "player_name")
    names = evaluation.propagate_labels(rows, labels).select(
        "track_id", F.coalesce("team_name", F.lit("")).alias("team_name"), F.coalesce("player_name", F.lit("")).alias("player_name")
    )
    return rows.join(names, "track_id", "left")


def named_players(players: DataFrame, tracks: DataFrame) -> DataFrame:
    """The players with ``name`` after the id: the label with most frames behind it in the cluster."""
    named = tracks.where(clean_text("player_name") != "")
    best = evaluation.majority(named, ["player"], "player_name", evaluation.frames_weight()).select("player", F.col("player_name").alias("name"))
    rows = players.drop("name").join(best, "player", "left")
    columns = [c for c in rows.columns if c not in ("player", "name")]
    return rows.select("player", F.coalesce("name", F.lit("")).alias("name"), *columns)


def apply_to_run(spark: SparkSession, tracks_csv: str, players_csv: str, labels_csv: str) -> tuple[dict, list[dict]]:
    """Rewrite a run's tracks and players with names; applying twice gives the same. Returns counts and conflicts."""
    tracks = readers.text_csv(spark, tracks_csv)
    labels = readers.text_csv(spark, labels_csv)
    summary = evaluation.propagation_summary(evaluation.propagate_labels(tracks, labels)).first().asDict()
    conflicts = [r.asDict() for r in evaluation.label_conflicts(tracks, labels).orderBy("kind", "key").collect()]
    new = applied(tracks, labels)
    players = readers.text_csv(spark, players_csv)
    named = named_players(players, new)
    writers.replace_table(named, players_csv)
    writers.replace_table(new, tracks_csv)
    return summary, conflicts
