"""Exact top-k search by tiled matrix products with partial selection and tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal

OUT = "query_id long, node long, vec_id long, score long"
_EXACT = float(1 << 53)


def quantised(embedding: str = "embedding", scale: int = 1024) -> Column:
    """Each component x as floor(scale * x), a long."""
    return F.transform(F.col(embedding), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(embedding: str = "embedding") -> Column:
    """True for a vector that is not null and whose components are all finite numbers."""
    bad = F.exists(
        F.col(embedding),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    return F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(False))


def _select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``scores`` the k best columns, ties to the smaller id; ``ids`` ascend."""
    n = scores.shape[1]
    if n > k:
        # Columns stand in id order, so score * n - column ranks by score, then by id.
        key = scores * n + np.arange(n - 1, -1, -1, dtype=scores.dtype)
        top = np.argpartition(-key, k - 1, axis=1)[:, :k]
        return np.take_along_axis(scores, top, 1), ids[top]
    return scores, np.broadcast_to(ids, scores.shape)


class _Best:
    """The running best k of every query of a block, as padded arrays."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, 0), 0, np.int64)
        self.ids = np.full((n, 0), 0, np.int64)
        self.real = np.full((n, 0), False)

    def merge(self, score: np.ndarray, ids: np.ndarray, real: np.ndarray) -> None:
        score = np.concatenate([self.score, score], 1)
        ids = np.concatenate([self.ids, ids], 1)
        real = np.concatenate([self.real, real], 1)
        order = np.lexsort((ids, -score, ~real), axis=1)[:, : self.k]
        self.score, self.ids, self.real = (np.take_along_axis(x, order, 1) for x in (score, ids, real))


def _vectors(table: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of rows ``vec_id, v``, whose vectors have one length."""
    ids, v = table.column("vec_id"), table.column("v")
    flat = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy(zero_copy_only=False)
    return ids.to_numpy(), flat.reshape(len(ids), len(flat) // max(1, len(ids)))


def _best(qid: np.ndarray, q: np.ndarray, candidates: Iterator[tuple[np.ndarray, np.ndarray]], k: int, tile: int) -> _Best:
    """The best k candidates of every query, a tile of candidates and 1,024 queries at a time."""
    q64 = q.astype(np.float64)
    reach = float(np.abs(q64).sum(1).max()) if len(qid) else 0.0
    best = _Best(len(qid), k)
    for ids, c in candidates:
        order = np.argsort(ids, kind="stable")
        ids, c = ids[order], c[order]
        for start in range(0, len(ids), tile):
            part, pid = c[start : start + tile], ids[start : start + tile]
            exact = reach * float(np.abs(part.astype(np.float64)).max(initial=0)) * 2 * tile < _EXACT
            found = []
            for lo in range(0, len(qid), 1024):
                own = qid[lo : lo + 1024]
                if exact:
                    s = q64[lo : lo + 1024] @ part.T.astype(np.float64)
                    floor = -_EXACT / (2 * tile)
                    s[own[:, None] == pid[None, :]] = floor
                    top, tid = _select(s, pid, k)
                    real = top > floor
                    found.append((np.where(real, top, 0).astype(np.int64), tid, real))
                else:
                    found.append(_select_exactly(q[lo : lo + 1024], part, own, pid, k))
            if found:
                best.merge(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return best


def _lists(qid: np.ndarray, best: _Best, node: int) -> Iterator[pa.RecordBatch]:
    """The lists as rows of ``OUT``."""
    rows, cols = np.nonzero(best.real)
    for lo in range(0, max(1, len(rows)), 1 << 16):
        r, c = rows[lo : lo + (1 << 16)], cols[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (qid[r], np.full(len(r), node), best.ids[r, c], best.score[r, c])],
            names=["query_id", "node", "vec_id", "score"],
        )


def _in_tasks(candidates: DataFrame, queries: DataFrame, k: int, tile: int) -> tuple[DataFrame, int]:
    """Lists of each task of the candidates, for queries that are few enough to be broadcast."""
    model = candidates.sparkSession.sparkContext.broadcast(_vectors(queries.select("vec_id", "v").toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = _best(*model.value, (_vectors(b) for b in batches if b.num_rows), k, tile)
        yield from _lists(model.value[0], found, TaskContext.get().partitionId())

    return candidates.select("vec_id", "v").mapInArrow(frugal(run), OUT), candidates.rdd.getNumPartitions()


def _in_cells(candidates: DataFrame, queries: DataFrame, blocks: int, shards: int, k: int, tile: int) -> tuple[DataFrame, int]:
    """Lists of each shard of the candidates, each block of queries meeting each shard in one cell."""
    cell = ["dim", "block", "shard"]

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    # Rows are dealt by their place, so that an id that repeats fills no shard.
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard")
    left = queries.select("dim", block, "vec_id", "v").select("dim", "block", every(shards, "shard"), "vec_id", "v")
    right = candidates.select("dim", shard, "vec_id", "v").select("dim", every(blocks, "block"), "shard", "vec_id", "v")

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        qid, q = _vectors(own)
        node = own.column("shard")[0].as_py() if len(own) else 0
        found = _best(qid, q, iter([_vectors(others)] if len(others) else []), k, tile)
        return pa.Table.from_batches(_lists(qid, found, node))

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, OUT), shards


def _select_exactly(q: np.ndarray, part: np.ndarray, own: np.ndarray, pid: np.ndarray, k: int):
    """As the float path, for products too large for it: Python's integers, then a check of the range."""
    s = q.astype(object) @ part.T.astype(object)
    real = own[:, None] != pid[None, :]
    s[~real] = 0
    if s.size and (max(s.max(), -s.min())) >= 1 << 63:
        raise OverflowError("an inner product does not fit a long")
    s = s.astype(np.int64)
    ids = np.broadcast_to(pid, s.shape)
    order = np.lexsort((ids, -s, ~real), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (s, ids, real))


def topk_search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    embedding: str = "embedding",
    scale: int = 1024,
    queries_at_once: int = 16384,
    shard_rows: int = 65536,
    tile: int = 4096,
    fan_in: int = 16,
) -> DataFrame:
    """The k best candidates of every query by integer inner product: ``query_id, rank, vec_id, score``.

    Queries up to ``queries_at_once`` of one length are broadcast, and every task multiplies its
    candidates with them. More queries are dealt to blocks of that size and candidates to
    shards of ``shard_rows``; a block and a shard meet in one cell of a join. Either way products
    are made a tile at a time, the k best per query and tile are kept by partial selection, and
    a task or cell sends k rows per query; lists then merge in a tree with ``fan_in`` lists a
    node, so no task ever reads more than ``k * fan_in`` rows of one query.

    Products of float64 matrices are exact while they stay below 2**53, which is checked for
    each tile; larger ones are computed with Python integers, and one beyond a long raises.
    Vectors that are null or hold null or non-finite components take no part, nor do rows
    with a null id. Vectors of different length are never compared; empty ones have score 0
    with each other. Ties go to the smaller id. Rows that repeat an id are candidates each; as
    queries they count once, and no row with the query's id is its candidate. A query without
    candidates has no rows. Extra columns are ignored.
    """
    valid = vectors.where(usable(embedding) & F.col(id_col).isNotNull())
    vector = quantised(embedding, scale).alias("v")
    candidates = valid.select(F.col(id_col).cast("long").alias("vec_id"), vector).withColumn("dim", F.size("v"))
    queries = valid.where(is_query).select(F.col(id_col).cast("long").alias("vec_id"), vector)
    queries = queries.dropDuplicates(["vec_id"]).withColumn("dim", F.size("v"))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.min("dim").alias("low"), F.max("dim").alias("high")).first()
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if size["n"] <= queries_at_once and size["low"] == size["high"]:
        found, width = _in_tasks(candidates.where(F.col("dim") == size["low"]), queries, k, tile)
    else:
        shards = max(1, -(-candidates.count() // shard_rows))
        found, width = _in_cells(candidates, queries, -(-size["n"] // queries_at_once), shards, k, tile)
    best = F.row_number().over(Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id"))
    while True:
        width = -(-width // fan_in)
        node = F.floor(F.col("node") / fan_in).cast("long") if width > 1 else F.lit(0).cast("long")
        found = found.withColumn("node", node).withColumn("rank", best).where(F.col("rank") <= k)
        if width == 1:
            break
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
