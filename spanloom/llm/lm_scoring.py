"""Cross-entropy difference between a target and a background n-gram model (Moore and Lewis, 2010).

Counts are exact and grow with the corpus. Each task cuts its texts into chunks and counts the
chunk's distinct words and bigrams. The counts of words, then of bigrams, are dealt to buckets by
the key, summed there, and the sums go back to the chunks that asked, in the order they were sent.
No table of the corpus is gathered or broadcast.

Both models are bigram models with the same smoothing over the vocabulary of all documents, and
neither has seen the text it scores: a document's own counts are taken off before it is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, frugal, text_or_empty
from .features import word_blocks

#: The count that every word has beforehand, and the weight of the unigrams in tokens of a context.
SMOOTH, PRIOR = 0.5, 4.0
#: Target ids up to this number are broadcast (15 MB); more are joined by a shuffle of both sides.
BROADCAST_IDS = 200_000
#: A chunk is closed at this many tokens, a bucket gets about so many keys of all chunks.
CHUNK_TOKENS = 700_000
BUCKET_WORDS, BUCKET_PAIRS = 1_000_000, 2_000_000
OUT = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
SIZES = ["n_words", "n_pairs", "n_tokens", "t_tokens", "n_texts", "t_texts"]
CHUNK = (
    "chunk long, " + ", ".join(f"{c} long" for c in SIZES) + ", words binary, word_counts binary,"
    " ids array<long>, targets binary, lengths binary, tokens binary"
)


def cells(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of each pair of ids below 2^32: no two pairs share one."""
    return before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)


def packed(x: np.ndarray | bytes) -> bytes:
    """Compressed bytes, those of numbers plane by plane: all the lowest bytes first, and so on."""
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(np.ascontiguousarray(x).reshape(-1, 1).view(np.uint8).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_words(words) -> bytes:
    """Words hold no white space, so a line break parts them."""
    return packed("\n".join(words).encode())


def unpacked_words(data: bytes) -> list[str]:
    return unpacked(data, np.uint8).tobytes().decode().split("\n")


class _Numbers(dict):
    """Numbers of words from 0 on, in the order they come."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        return at


def _chunk(chunk: int, numbers: _Numbers, ids: list, parts: list[np.ndarray], lengths: list[int], targets: list[bool]) -> pa.RecordBatch:
    tokens = np.concatenate([*parts, np.empty(0, np.int32)])
    n, size, wanted = np.array(lengths, np.int64), len(numbers), np.array(targets, bool)
    full = n > 0
    before = _before(tokens, n, size)
    own = np.repeat(wanted, n)
    words = [np.bincount(x, minlength=size + 1)[:size] for x in (tokens, tokens[own], before, before[own])]
    pairs = len(np.unique(cells(before, tokens)))
    sizes = [size, pairs, len(tokens), int(own.sum()), int(full.sum()), int((full & wanted).sum())]
    columns = [pa.array([chunk]), *[pa.array([x], pa.int64()) for x in sizes]]
    columns += [pa.array([x], pa.binary()) for x in (packed_words(numbers), packed(np.stack(words)))]
    columns += [pa.array([ids], pa.list_(pa.int64())), *[pa.array([packed(x)], pa.binary()) for x in (wanted, n, tokens)]]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", *SIZES, "words", "word_counts", "ids", "targets", "lengths", "tokens"])


def _before(tokens: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    """The word before each token of texts of ``n`` tokens; the start of a text is a context too."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = start
    return before


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct pairs of places in its words (the start of a text after them), the pair of each token, and texts' lengths."""
    n = unpacked(row["lengths"], np.int64)
    tokens = unpacked(row["tokens"], np.int32)
    pairs, at_pair = np.unique(cells(_before(tokens, n, row["n_words"]), tokens), return_inverse=True)
    return np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)]).astype(np.int64), at_pair, n


def chunks_of(rows: DataFrame) -> DataFrame:
    """Texts in chunks (``CHUNK``): distinct words with their counts in all and in target texts, and
    the place in ``words`` of each token, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        numbers, ids, parts, lengths, targets, held = _Numbers(), [], [], [], [], 0
        for batch in batches:
            for id_, text, target in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = [np.fromiter(map(numbers.__getitem__, b), np.int32, len(b)) for b in word_blocks(text.as_py().lower())]
                ids.append(id_)
                parts += own
                lengths.append(sum(map(len, own)))
                targets.append(target)
                held += lengths[-1]
                if held >= CHUNK_TOKENS:
                    yield _chunk(chunk, numbers, ids, parts, lengths, targets)
                    chunk, numbers, ids, parts, lengths, targets, held = chunk + 1, _Numbers(), [], [], [], [], 0
        if ids:
            yield _chunk(chunk, numbers, ids, parts, lengths, targets)

    return rows.mapInArrow(frugal(run), CHUNK)


def _dealt(bucket: np.ndarray, key: np.ndarray | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by bucket (and key), and where each bucket starts in it."""
    order = np.argsort(bucket, kind="stable") if key is None else np.lexsort((key, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def word_totals(chunks: DataFrame, buckets: int) -> DataFrame:
    """``chunk, bucket, at, found, distinct``: for the words of a chunk at the places ``at``, their ids
    and their counts as words and contexts over the whole input (all and target texts).

    Ids are from 1 on. ``distinct`` adds up to the number of distinct words; ``bucket`` is -1.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = unpacked(batch.column(2)[i].as_py(), np.int64).reshape(4, -1)
                if not counts.size:
                    continue
                words = np.array(unpacked_words(batch.column(1)[i].as_py()), object)
                hashed = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
                order, starts = _dealt(hashed % buckets, None, buckets)
                used = np.flatnonzero(np.diff(starts))
                cuts = [order[starts[b] : starts[b + 1]] for b in used.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int32)),
                        pa.array([batch.column(0)[i].as_py()] * len(used), pa.int64()),
                        pa.array([packed(x.astype(np.int32)) for x in cuts], pa.binary()),
                        pa.array([packed_words(words[x]) for x in cuts], pa.binary()),
                        pa.array([packed(counts[:, x]) for x in cuts], pa.binary()),
                    ],
                    names=["bucket", "chunk", "at", "words", "counts"],
                )

    def total(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        words = [pa.array(unpacked_words(x.as_py()), pa.string()) for x in table.column("words")]
        coded = pa.concat_arrays(words).dictionary_encode()
        at, size = coded.indices.to_numpy(), len(coded.dictionary)
        counts = np.concatenate([unpacked(x.as_py(), np.int64).reshape(4, -1) for x in table.column("counts")], axis=1)
        sums = [np.bincount(at, c, size).astype(np.int64)[at] for c in counts]
        ids = at.astype(np.int64) * buckets + bucket + 1
        if ids.max() >= 1 << 32:
            raise ValueError("more than 2^32 word ids")
        ends = np.cumsum([len(x) for x in words])[:-1]
        found = [packed(x) for x in np.split(np.stack([ids, *sums]), ends, axis=1)]
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "bucket": pa.array([-1] * len(found), pa.int32()),
                "at": table.column("at"),
                "found": pa.array(found, pa.binary()),
                "distinct": pa.array([size] + [0] * (len(found) - 1), pa.int64()),
            }
        )

    dealt = chunks.select("chunk", "words", "word_counts").mapInArrow(
        frugal(deal), "bucket int, chunk long, at binary, words binary, counts binary"
    )
    return dealt.groupBy("bucket").applyInArrow(total, "chunk long, bucket int, at binary, found binary, distinct long")


def _words(size: int, answers: pa.Table) -> np.ndarray:
    """Ids and four counts of a chunk's words, and a column of zeros for the start of a text."""
    out = np.zeros((5, size + 1), np.int64)
    for bucket, at, found in zip(*[answers.column(c) for c in ("bucket", "at", "found")], strict=True):
        if bucket.as_py() < 0:
            out[:, unpacked(at.as_py(), np.int32)] = unpacked(found.as_py(), np.int64).reshape(5, -1)
    return out


def _keys(halves: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of a chunk's pairs under the ids of the corpus, their order by bucket and its starts."""
    key = cells(ids[halves[0]], ids[halves[1]])
    spread = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return key, *_dealt((spread % np.uint64(buckets)).astype(np.int64), key, buckets)


def pair_totals(chunks: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """``chunk, bucket, at, found``: counts over the whole input of the chunk's pairs in a bucket, in the order of ``_keys``."""

    def deal(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = {"bucket": [], "chunk": [], "keys": [], "counts": []}
        for row in chunk.to_pylist():
            halves, at, n = _pairs(row)
            own = np.repeat(unpacked(row["targets"], bool), n)
            counts = np.stack([np.bincount(x, minlength=halves.shape[1]) for x in (at, at[own])])
            key, order, starts = _keys(halves, _words(row["n_words"], answers)[0], buckets)
            for b in np.flatnonzero(np.diff(starts)).tolist():
                own = order[starts[b] : starts[b + 1]]
                rows["bucket"].append(b)
                rows["chunk"].append(row["chunk"])
                rows["keys"].append(packed(np.diff(key[own], prepend=np.uint64(0))))
                rows["counts"].append(packed(counts[:, own]))
        return pa.table(rows, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def total(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("keys")]
        counts = np.concatenate([unpacked(x.as_py(), np.int64).reshape(2, -1) for x in table.column("counts")], axis=1)
        ends = np.cumsum([len(x) for x in keys])[:-1]
        one, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.stack([np.bincount(at, c, len(one)).astype(np.int64)[at] for c in counts])
        found = [packed(x) for x in np.split(sums, ends, axis=1)]
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "bucket": table.column("bucket"),
                "at": pa.nulls(len(found), pa.binary()),
                "found": pa.array(found, pa.binary()),
            }
        )

    own = chunks.select("chunk", "n_words", "targets", "lengths", "tokens").groupBy("chunk")
    dealt = own.cogroup(words.select("chunk", "bucket", "at", "found").groupBy("chunk")).applyInArrow(
        deal, "bucket int, chunk long, keys binary, counts binary"
    )
    return dealt.groupBy("bucket").applyInArrow(total, "chunk long, bucket int, at binary, found binary")


def losses(pair: np.ndarray, context: np.ndarray, word: np.ndarray, tokens: np.ndarray | int, types: int) -> np.ndarray:
    """The loss of each pair in nats from its counts.

    The unigram has a count of ``SMOOTH`` for every type beforehand, the bigram ``PRIOR`` tokens
    dealt by the unigram, so the probabilities of any context add up to one over all types; an
    unseen context leaves the unigram alone.
    """
    unigram = (word + SMOOTH) / (tokens + SMOOTH * types)
    return -np.log((pair + PRIOR * unigram) / (context + PRIOR))


def _own_counts(doc: np.ndarray, item: np.ndarray, size: int, count: np.ndarray) -> np.ndarray:
    """For each row how often its item occurs in its document."""
    _, at = np.unique(doc * size + item, return_inverse=True)
    return np.bincount(at, count)[at] if len(at) else np.zeros(0)


def score_documents(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cross-entropy of each whole text under both models and their difference.

    Returns ``doc_id, n_tokens, target_loss, background_loss, score``: losses are means per
    token in nats and ``score`` is target minus background, so lower is closer to the target.
    The background model counts all documents and the target model those whose id is in
    ``target_ids`` (one column named ``id_col``), every lower-cased word and every bigram with
    its exact count; a document is scored by the counts of all others. Both models share the
    distinct words of all documents and one unseen word as their types. More than 2^32 word
    ids raise an error.

    Texts without words, null ones included, have 0 tokens and score 0. Repeated rows are
    counted and scored each, as other documents to one another; ids that repeat in
    ``target_ids`` or are null count once or not at all; without target ids the target model
    is uniform. Other columns are ignored.
    """
    spark = docs.sparkSession
    targets = target_ids.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct().withColumn("is_target", F.lit(True))
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
    bounded_batches(spark)
    scratch = Scratch(spark, "lm_scoring")
    # Target ids grow with the corpus: their number decides how they are joined.
    few = targets.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = rows.join(targets.hint("broadcast" if few else "merge"), "_id", "left").select(
        F.col("_id").cast("long").alias("id"), "text", F.coalesce("is_target", F.lit(False)).alias("is_target")
    )
    chunks = scratch.save(chunks_of(marked))
    sizes = {c: n or 0 for c, n in chunks.agg(*[F.sum(c).alias(c) for c in SIZES]).first().asDict().items()}
    words = scratch.save(word_totals(chunks, sizes["n_words"] // BUCKET_WORDS + 1))
    types = (words.agg(F.sum("distinct")).first()[0] or 0) + 1
    buckets = sizes["n_pairs"] // BUCKET_PAIRS + 1
    pairs = scratch.save(pair_totals(chunks, words, buckets))

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        ids, lengths, target, background = [], [], [], []
        for row in chunk.to_pylist():
            size = row["n_words"]
            known = _words(size, answers)
            halves, at, n = _pairs(row)
            _, order, starts = _keys(halves, known[0], buckets)
            known[3:, size] = sizes["n_texts"], sizes["t_texts"]
            pair = np.zeros((2, len(order)), np.int64)
            for bucket, found in zip(answers.column("bucket").to_pylist(), answers.column("found"), strict=True):
                if bucket >= 0:
                    pair[:, order[starts[bucket] : starts[bucket + 1]]] = unpacked(found.as_py(), np.int64).reshape(2, -1)
            # The distinct pairs of each document, and what the document itself added to their counts.
            of_token = np.repeat(np.arange(len(n)), n) * max(1, len(order)) + at
            key, times = np.unique(of_token, return_counts=True)
            doc, at = np.divmod(key, max(1, len(order)))
            before, word = halves[0][at], halves[1][at]
            own_before, own_word = (_own_counts(doc, x, size + 1, times) for x in (before, word))
            wanted = unpacked(row["targets"], bool)
            for k, tokens, out in ((0, "n_tokens", background), (1, "t_tokens", target)):
                held = np.ones(len(n)) if k == 0 else wanted.astype(float)
                own = held[doc]
                of_pair = losses(
                    pair[k][at] - own * times,
                    known[3 + k][before] - own * own_before,
                    known[1 + k][word] - own * own_word,
                    sizes[tokens] - own * n[doc],
                    types,
                )
                out.append(np.bincount(doc, of_pair * times, len(n)) / np.maximum(n, 1))
            ids += row["ids"]
            lengths.append(n)
        n, target, background = (np.concatenate([*x, np.empty(0, kind)]) for x, kind in ((lengths, np.int64), (target, float), (background, float)))
        columns = [pa.array(ids, pa.int64()), pa.array(n), pa.array(target), pa.array(background), pa.array(target - background)]
        return pa.table(columns, names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    answers = words.select("chunk", "bucket", "at", "found").unionByName(pairs)
    own = chunks.select("chunk", "n_words", "ids", "targets", "lengths", "tokens").groupBy("chunk")
    return own.cogroup(answers.groupBy("chunk")).applyInArrow(run, OUT)
