"""Exact deduplication by a 128-bit content hash with a byte comparison inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by the MD5 of their text together with the text itself, so the
    aggregation compares the bytes of rows whose hashes agree and two texts never merge by a
    hash collision. Copies collapse in the map-side aggregation: each task sends one row for
    each distinct text it holds, however large a group is. The answer is then joined to the
    ids by the hash alone; Spark splits a hot hash there since nothing aggregates above it.

    Null text counts as empty, and empty texts form a group of their own. ``keep`` names the
    survivor: the smallest (``min``) or largest (``max``) id that is not null. Rows that repeat
    an id with the same text count in ``group_size`` and are flagged alike; so are rows without
    an id, which are kept only if no row of the text has one (``keep_id`` is null then). An
    empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    pick = F.min if keep == "min" else F.max
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn(
        "_hash", F.unhex(F.md5(F.col("_text").cast("binary")))
    )
    classes = (
        rows.groupBy("_hash", "_text")
        .agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", "keep_id", "group_size", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"))
    )
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    classes = scratch.save(classes)
    collided = classes.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_hash")
    keys = ["_hash"]
    if not collided.isEmpty():
        # Different texts with one MD5: tell them apart by their SHA-256 as well.
        rows = rows.withColumn("text_sha256", F.sha2(F.col("_text").cast("binary"), 256))
        keys = ["_hash", "text_sha256"]
    return (
        rows.drop("_text")
        .join(classes, keys)
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            "group_size",
            F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of each text, the one with the smallest (``keep="min"``) or largest (``max``) id; all columns stay.

    Rows are the unit, not ids: a row whose id repeats with another text is judged by its own
    text, one row stays of those that repeat id and text, and a null id is chosen only if no
    row of the text has one. Null text counts as empty; the row that stays keeps what it has.
    One aggregation by MD5 and text, map-side first, so a task sends one row for each text.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.unhex(F.md5(text_or_empty(text_col).cast("binary"))).alias("_hash"),
        text_or_empty(text_col).alias("_text"),
        F.struct(F.col(text_col).isNull().alias("_null"), F.struct(*[F.col(c) for c in others]).alias("_others")).alias("_row"),
        F.col(id_col).alias("_id"),
    )
    missing, pick = (F.col("_id").isNull(), F.min_by) if keep == "min" else (F.col("_id").isNotNull(), F.max_by)
    kept = rows.groupBy("_hash", "_text").agg(pick("_row", F.struct(missing.alias("missing"), "_id")).alias("_row"))
    text = F.when(~F.col("_row._null"), F.col("_text")).alias(text_col)
    return kept.select(*[text if c == text_col else F.col(f"_row._others.{c}").alias(c) for c in docs.columns])
