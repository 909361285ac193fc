"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, component`` for every id in ``edges`` (u, v): the smallest id of its component.

    Kiveris et al. (2014): every step joins edges with the smallest neighbour of their node,
    found by a partial aggregation, so no neighbourhood is ever gathered. Edges are written
    to the shared folder after each round, which keeps the lineage short.
    """
    now = scratch.save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(new)
        scratch.drop(now)
        now = new
        if after == state:
            break
        state = after
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    centres = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return scratch.save(stars.unionByName(centres))
