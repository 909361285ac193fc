"""Scans: Parquet, CSV with a schema or as text, JSON, and segment folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.scalars import clean_text, lenient_int
from . import schemas


def detections(spark: SparkSession, path: str, **origin: str | None) -> DataFrame:
    """Detections, of a table that names their origin only those of the given ``model`` or ``tracker``."""
    rows = of_origin(spark.read.parquet(path), **origin)
    return rows.select(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in schemas.DETECTIONS.split(", ")])


def of_origin(rows: DataFrame, **origin: object) -> DataFrame:
    """The rows with these values in the columns of the same names; a missing column or None is no filter."""
    for column, value in origin.items():
        if value is not None and column in rows.columns:
            rows = rows.where(F.col(column) == value)
    return rows


def embeddings(spark: SparkSession, path: str, embedder: str, weights: str | None, suppressed: bool, crops_per_track: int) -> DataFrame:
    """``game_id, track_id, embedding`` of crops. Optional columns choose among them: ``embedder``,
    ``weights``, ``suppressed`` (without the background) and ``crop``, numbered from 1 in a track."""
    rows = of_origin(spark.read.parquet(path), embedder=embedder, weights=weights, suppressed=suppressed)
    if "crop" in rows.columns:
        rows = rows.where(F.col("crop") <= crops_per_track)
    return rows.select("game_id", "track_id", "embedding")


def clips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CLIPS).parquet(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and the columns of the schema; blank cells are null."""
    return spark.read.schema(schema).option("header", True).csv(path)


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every cell as text; blank cells are null."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def shifts(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.SHIFTS)


def csv_column(rows: DataFrame, value: str, key: str = "track_id") -> DataFrame:
    """``key, value`` from a table of text: blank cells and keys that are no number are skipped.

    Of rows with one key the last in the file counts. A missing column gives no rows.
    """
    if value not in rows.columns or key not in rows.columns:
        return rows.sparkSession.createDataFrame([], f"{key} long, {value} string")
    at = rows.select(lenient_int(key).alias(key), clean_text(value).alias(value), F.monotonically_increasing_id().alias("_at"))
    found = at.where(F.col(key).isNotNull() & (F.col(value) != ""))
    return found.groupBy(key).agg(F.max_by(value, "_at").alias(value))


def json_document(spark: SparkSession, path: str) -> DataFrame | None:
    """One JSON document as a row, or None if there is no such file."""
    try:
        return spark.read.option("multiLine", True).json(path)
    except AnalysisException:
        return None


def parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def segment_tables(spark: SparkSession, path: str, schema: str, by_game: bool = False) -> DataFrame:
    """Tables of all segments under ``path/segment=<n>/``, with the segment as a column; ``by_game``
    those of all games under ``path/game_id=<id>/segment=<n>/``, with the game too."""
    parts, folders = (", game_id long, segment int", "game_id=*/segment=*") if by_game else (", segment int", "segment=*")
    return spark.read.schema(schema + parts).option("header", True).option("basePath", path).csv(f"{path}/{folders}")


def identities(spark: SparkSession, path: str, by_game: bool = False) -> DataFrame:
    return spark.read.schema(schemas.IDENTITIES + (", game_id long" if by_game else "")).parquet(path)


def named_players(rows: DataFrame) -> DataFrame:
    """Rows of a tracks table that are players with an identity."""
    return rows.where((clean_text("role") == "player") & (clean_text("player") != ""))
