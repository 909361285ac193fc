"""Weighted majority votes: the larger weight, then the label seen first or the smaller label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vote_weights(votes: DataFrame, keys: list[str], label: str, weight: Column | str | None = None, seen: str | None = None) -> DataFrame:
    """Summed weight per key and label; one per row without a weight. Null labels do not vote.

    With ``seen``, a column such as the frame, ``_seen`` is its least value for the label.
    """
    w = F.lit(1) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    first = [] if seen is None else [F.min(seen).alias("_seen")]
    return votes.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.sum(w).alias("weight"), *first)


def majority(votes: DataFrame, keys: list[str], label: str, weight: Column | str | None = None, seen: str | None = None) -> DataFrame:
    """The winning label of each key and its weight. Ties go to the label seen first by the
    column ``seen``, if one is named, then to the smaller label."""
    order = [F.desc("weight"), *([] if seen is None else ["_seen"]), label]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return vote_weights(votes, keys, label, weight, seen).withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_seen")


def frames_weight(frames_seen: str = "frames_seen") -> Column:
    """Frames as a vote's weight, at least one; text that is no number counts as one."""
    return F.greatest(F.lit(1.0), F.coalesce(F.col(frames_seen).try_cast("double"), F.lit(1.0)))


def conflicts(votes: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Keys with more than one different label, and the labels in order."""
    found = votes.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return found.where(F.size("labels") > 1)
