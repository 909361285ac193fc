"""Label-aligned evaluation, label propagation and validation of identities."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_text
from .votes import conflicts, frames_weight, majority

#: Fields that are evaluated, and whether their predicted labels are arbitrary numbers.
FIELDS = {"team": True, "role": False, "player": True}


def contingency(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``pred, true, n`` of rows with both labels, as text."""
    keys = keys or []
    both = pairs.where(F.col("pred").isNotNull() & F.col("true").isNotNull())
    rows = both.select(*keys, F.col("pred").cast("string").alias("pred"), F.col("true").cast("string").alias("true"))
    return rows.groupBy(*keys, "pred", "true").agg(F.count(F.lit(1)).alias("n"))


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of a minimum-cost assignment, by shortest augmenting paths with potentials."""
    flipped = cost.shape[0] > cost.shape[1]
    a = cost.T if flipped else cost
    n, m = a.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[column]:
            done[column] = True
            reduced = a[owner[column] - 1] - u[owner[column]] - v[1:]
            open_ = ~done[1:]
            closer = open_ & (reduced < least[1:])
            least[1:][closer], back[1:][closer] = reduced[closer], column
            following = int(np.where(open_, least[1:], np.inf).argmin()) + 1
            delta = least[following]
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            column = following
        while column:
            owner[column] = owner[back[column]]
            column = back[column]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((j, i) if flipped else (i, j) for i, j in pairs)


def best_assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs with the largest total weight; pairs of no weight are left out."""
    if not weight.size:
        return []
    return [(i, j) for i, j in hungarian(-weight.astype(float)) if weight[i, j] > 0]


def best_assignment_by_trial(weight: np.ndarray) -> float:
    """The largest total weight by trying every assignment; an oracle for small tables."""
    w = weight if weight.shape[0] <= weight.shape[1] else weight.T
    return max((sum(w[i, j] for i, j in enumerate(p)) for p in permutations(range(w.shape[1]), w.shape[0])), default=0)


def mapped_accuracy(table: DataFrame, keys: list[str]) -> DataFrame:
    """``n, correct, accuracy, mapping`` per key from a contingency table, under the best one-to-one map."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*keys).schema)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        grid = rows.pivot(index="pred", columns="true", values="n").fillna(0).sort_index().sort_index(axis=1)
        weight = grid.to_numpy()
        pairs = best_assignment(weight)
        n, correct = int(weight.sum()), int(sum(weight[i, j] for i, j in pairs))
        mapping = " ".join(f"{grid.index[i]}={grid.columns[j]}" for i, j in pairs)
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, "n": n, "correct": correct, "accuracy": correct / n if n else 0.0, "mapping": mapping}])

    schema = (fields + ", " if fields else "") + "n long, correct long, accuracy double, mapping string"
    return table.groupBy(*keys).applyInPandas(solve, schema)


def direct_accuracy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``n, correct, accuracy`` of labels that mean the same on both sides."""
    same = (F.col("pred").cast("string") == F.col("true").cast("string")).cast("int")
    both = pairs.where(F.col("pred").isNotNull() & F.col("true").isNotNull())
    columns = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(same), F.lit(0)).alias("correct"), F.coalesce(F.avg(same), F.lit(0.0)).alias("accuracy")]
    return both.groupBy(*keys).agg(*columns) if keys else both.agg(*columns)


def labelled_fields(labels: DataFrame, fields: list[str], id_col: str = "track_id") -> DataFrame:
    """``track_id, field, label`` of the fields a person filled in, one row a cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(clean_text(f), F.lit("")).alias("label")) for f in fields])).alias("c")
    return labels.select(id_col, cells).select(id_col, "c.field", "c.label").where(F.col("label").isNotNull())


def evaluate(predictions: DataFrame, labels: DataFrame, fields: dict[str, bool] | None = None, id_col: str = "track_id") -> DataFrame:
    """One row per labelled field: ``field, n_overlap, n_missing, n, correct, accuracy, mapping``."""
    fields = fields or FIELDS
    own = [f for f in fields if f in predictions.columns and f in labels.columns]
    true = labelled_fields(labels, own, id_col).withColumnRenamed("label", "true")
    pred = labelled_fields(predictions, own, id_col).withColumnRenamed("label", "pred")
    joined = pred.join(true, [id_col, "field"])
    missing = true.join(pred, [id_col, "field"], "left_anti").groupBy("field").agg(F.count(F.lit(1)).alias("n_missing"))
    arbitrary = [f for f in own if fields[f]]
    mapped = mapped_accuracy(contingency(joined.where(F.col("field").isin(arbitrary)), ["field"]), ["field"])
    direct = direct_accuracy(joined.where(~F.col("field").isin(arbitrary)), ["field"]).withColumn("mapping", F.lit(None).cast("string"))
    scored = mapped.unionByName(direct)
    present = true.select("field").distinct()
    zero = F.lit(0).cast("long")
    return (
        present.join(scored, "field", "left")
        .join(missing, "field", "left")
        .select(
            "field",
            F.coalesce("n", zero).alias("n_overlap"),
            F.coalesce("n_missing", zero).alias("n_missing"),
            F.coalesce("correct", zero).alias("correct"),
            F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
            "mapping",
        )
    )


def propagate_labels(tracks: DataFrame, labels: DataFrame, id_col: str = "track_id", team: str = "team", player: str = "player") -> DataFrame:
    """``track_id, team_name, player_name, source`` per track: human labels spread through clusters.

    A cluster takes the label with the most frames behind it; a label on a track itself wins
    over what its cluster says. Labels of unknown tracks do not vote. ``team_source`` and
    ``player_source`` are ``direct``, ``inherited`` or null.
    """
    rows = tracks.select(
        id_col,
        F.nullif(clean_text(team), F.lit("")).alias("_team"),
        F.nullif(clean_text(player), F.lit("")).alias("_player"),
        frames_weight().alias("_w"),
    )
    human = labels.select(
        F.col(id_col), F.nullif(clean_text("team"), F.lit("")).alias("_team_label"), F.nullif(clean_text("player"), F.lit("")).alias("_player_label")
    )
    joined = rows.join(human, id_col, "left")
    for field in ("team", "player"):
        votes = joined.where(F.col(f"_{field}").isNotNull())
        won = majority(votes, [f"_{field}"], f"_{field}_label", "_w").select(f"_{field}", F.col(f"_{field}_label").alias(f"_{field}_cluster"))
        joined = joined.join(won, f"_{field}", "left")

    def source(field: str):
        return F.when(F.col(f"_{field}_label").isNotNull(), "direct").when(F.col(f"_{field}_cluster").isNotNull(), "inherited")

    return joined.select(
        id_col,
        F.coalesce("_team_label", "_team_cluster").alias("team_name"),
        F.coalesce("_player_label", "_player_cluster").alias("player_name"),
        source("team").alias("team_source"),
        source("player").alias("player_source"),
    )


def propagation_summary(applied: DataFrame) -> DataFrame:
    """Tracks with a label of their own, and inheritances of teams and of players."""
    own = (F.col("team_source") == "direct") | (F.col("player_source") == "direct")
    inherited = (F.col("team_source") == "inherited").cast("int"), (F.col("player_source") == "inherited").cast("int")
    return applied.agg(
        F.count_if(own).alias("n_direct"), F.coalesce(sum(F.sum(F.coalesce(c, F.lit(0))) for c in inherited), F.lit(0)).alias("n_propagated")
    )


def label_conflicts(tracks: DataFrame, labels: DataFrame, cluster: str = "player", label: str = "player", id_col: str = "track_id") -> DataFrame:
    """``kind, key, labels``: clusters with several labels, and labels on several clusters."""
    human = labels.select(F.col(id_col), F.nullif(clean_text(label), F.lit("")).alias("_label"))
    votes = tracks.select(id_col, F.nullif(clean_text(cluster), F.lit("")).alias("_cluster")).join(human, id_col)
    votes = votes.where(F.col("_cluster").isNotNull() & F.col("_label").isNotNull())
    mixed = conflicts(votes, ["_cluster"], "_label").select(F.lit("mixed cluster").alias("kind"), F.col("_cluster").alias("key"), "labels")
    split = conflicts(votes, ["_label"], "_cluster").select(F.lit("split label").alias("kind"), F.col("_label").alias("key"), "labels")
    return mixed.unionByName(split)


def overlapping_pairs(spans: DataFrame, keys: list[str], start: str, end: str, out: str = "n") -> DataFrame:
    """Per key the number of pairs of spans (inclusive ends) that share a frame, without making the pairs.

    Swept in time: a span that opens overlaps those that opened before it and have not closed.
    """
    whole = spans.where(F.col(start) <= F.col(end))
    opens = whole.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_close"))
    closes = whole.select(*keys, F.col(end).alias("_t"), F.lit(1).alias("_close"))
    before = Window.partitionBy(*keys).orderBy("_t", "_close").rowsBetween(Window.unboundedPreceding, -1)
    swept = opens.unionByName(closes).withColumn("_open", F.coalesce(F.sum(1 - 2 * F.col("_close")).over(before), F.lit(0)))
    return swept.where("_close = 0").groupBy(*keys).agg(F.sum("_open").cast("long").alias(out))


def validate_identities(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Counters per game: pairs of one identity that overlap in time, and pairs with known teams.

    A run passes without overlaps; ``same`` and ``cross`` count checkable pairs by team. Pairs
    are counted, not made: from the sizes of identities and of their teams, and by a sweep in time.
    """

    def pairs_of(n: str) -> Column:
        return F.sum(F.col(n) * (F.col(n) - 1) / 2).cast("long")

    rows = tracks.where(F.col("player").isNotNull())
    who = [*keys, "player"]
    teams = rows.groupBy(*who, "team").agg(F.count(F.lit(1)).alias("_n")).withColumn("_known", F.when(F.col("team").isNotNull(), F.col("_n")).otherwise(0))
    sizes = teams.groupBy(*who).agg(F.sum("_n").alias("_n"), F.sum("_known").alias("_of_team"), pairs_of("_known").alias("same"))
    zero = F.lit(0).cast("long")
    counted = sizes.groupBy(*keys).agg(pairs_of("_n").alias("pairs"), pairs_of("_of_team").alias("checkable"), F.sum("same").alias("same"))
    swept = overlapping_pairs(rows, who, "first_frame", "last_frame", "violations")
    parts = counted.withColumn("violations", zero).unionByName(
        swept.select(*keys, "violations", *[zero.alias(c) for c in ("pairs", "checkable", "same")])
    )
    sums = [F.coalesce(F.sum(c), zero).alias(c) for c in ("pairs", "violations", "checkable", "same")]
    found = parts.groupBy(*keys).agg(*sums) if keys else parts.agg(*sums)
    found = found.withColumn("cross", F.col("checkable") - F.col("same"))
    return found.withColumn("verdict", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))
