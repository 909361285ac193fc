"""Exact n-gram Jaccard self-join with prefix filters under several global token orders.

Two sets of n and m tokens with a Jaccard similarity of at least t share at least
``a = ceil(t / (1 + t) * (n + m))`` tokens, so under *any* global order of tokens the first
``n - a + 1`` of one and the first ``m - a + 1`` of the other share one. Three orders are used:
all put rare tokens first, by counts over the whole input, and break ties by different hashes.
The first order is an index that makes candidate pairs; they must share a prefix token under
the second and third order too before their sets are compared.

Components come first: groups of near copies are linked to one central member each, found by
min-hash keys, so that the index only looks at pairs of different components. Every link lies
inside a component, so each set's links are then counted by comparing the sets of a component
with one another, block by block; a link is a number in a matrix there, not a row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembering, Scratch, bounded_batches, frugal, numbered_rows, text_or_empty
from .components import connected_components

#: The least and most cells of the table of counts, and the characters of input for one.
LEAST_CELLS, MOST_CELLS, CELL_CHARS = 1 << 22, 1 << 24, 256
BLOCK = 1 << 14
ORDERS = 3
#: Pairs of min-hash values that form the keys of the first, star-shaped round.
KEYS = 5
#: Bits of the filter for each id, and the most words of 64 bits that are broadcast (32 MB).
FILTER_BITS, FILTER_WORDS = 16, 1 << 22
#: Sets of a component that are compared with one another at once, and tokens of a matrix.
SETS_AT_ONCE, CELL_TOKENS, TOKENS_AT_ONCE = 500, 1_000_000, 8192
_CELL = ["component", "lo", "hi"]
SIGNED = "id long, n int, signature binary, central int, keys array<long>, p1 array<long>, p2 array<int>, p3 array<int>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(32))
    return x * np.uint64(0x94D049BB133111EB)


class Shingler:
    """Sets of word n-grams as sorted distinct 64-bit hashes."""

    def __init__(self, words: int):
        import xxhash

        self.words = words
        self.get = Remembering(xxhash.xxh64_digest, 150_000).__getitem__

    def all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the texts' shingles, one text after the other, and their number per text.

        A text of fewer words than a shingle has is one shingle.
        """
        size = self.words
        split = [text.lower().split() for text in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        own = np.frombuffer(b"".join(map(self.get, chain.from_iterable(split))), np.uint64)
        n = max(0, len(own) - size + 1)
        out = own[:n] + np.uint64(size)
        for j in range(1, size):
            out = mix(out * _ODD + own[j : n + j])
        ends = np.cumsum(count)
        inside = np.repeat(ends, count)[:n] - np.arange(n) >= size
        short = np.flatnonzero((count > 0) & (count < size))
        number = np.where(count < size, (count > 0).astype(np.int64), count - size + 1)
        if not len(short):
            return out[inside], number
        whole = []
        for i in short.tolist():
            words = own[ends[i] - count[i] : ends[i]]
            x = words[:1] + np.uint64(len(words))
            for j in range(1, len(words)):
                x = mix(x * _ODD + words[j : j + 1])
            whole.append(x[0])
        at = np.cumsum(number) - number
        out = np.insert(out[inside], at[short] - np.arange(len(short)), np.array(whole, np.uint64))
        return out, number

    def distinct(self, texts: list[bytes]) -> list[np.ndarray]:
        tokens, number = self.all(texts)
        ends = np.cumsum(number).tolist()
        out = []
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            own = np.sort(tokens[a:b])
            if len(own) > 1:
                new = np.empty(len(own), bool)
                new[0] = True
                np.not_equal(own[1:], own[:-1], out=new[1:])
                own = own[new]
            out.append(own)
        return out


def _texts(batch: pa.RecordBatch, column: int, most: int = 1_500_000) -> Iterator[tuple[int, list[bytes]]]:
    """The first row and the texts of consecutive parts of a batch, about ``most`` bytes each."""
    first, own, size = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        own.append(text.as_py())
        size += len(own[-1])
        if size >= most:
            yield first, own
            first, own, size = i + 1, [], 0
    if own:
        yield first, own


def token_levels(rows: DataFrame, words: int, scratch: Scratch) -> np.ndarray:
    """The rarity of every cell of hashed shingles, from counts over the whole input.

    The table grows with the input up to ``MOST_CELLS``. Each task counts its own texts and
    sends its table in compressed blocks; blocks of one number are added up, and turned into
    levels of one byte, on the executors. Only levels reach the driver.
    """
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (chars // CELL_CHARS).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table = Shingler(words), np.zeros(cells, np.uint32)
        shift = np.uint64(64 - (cells.bit_length() - 1))
        for batch in batches:
            for _, texts in _texts(batch, 0):
                np.add.at(table, (shingler.all(texts)[0] >> shift).astype(np.int64), 1)
        for b in range(cells // BLOCK):
            own = table[b * BLOCK : (b + 1) * BLOCK]
            if own.any():
                yield _block_batch(b, zlib.compress(own.tobytes(), 1), int(own.sum(dtype=np.int64)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(zlib.decompress(data.as_py()), np.uint32)
                sums[block] = sums.get(block, np.zeros(BLOCK, np.int64)) + own
        for block, own in sums.items():
            yield _block_batch(block, own.tobytes(), int(own.sum()))

    schema = "block int, data binary, total long"
    blocks = rows.select("text").mapInArrow(frugal(count), schema).repartition("block").mapInArrow(frugal(add), schema)
    blocks = scratch.save(blocks)
    mean = (blocks.agg(F.sum("total")).first()[0] or 0) / cells

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _block_batch(block, rarity_levels(np.frombuffer(data.as_py(), np.int64), mean).tobytes(), 0)

    out = np.full(cells, rarity_levels(np.zeros(1), mean)[0])
    for row in blocks.mapInArrow(frugal(level), schema).toLocalIterator():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["data"], np.uint8)
    scratch.drop(blocks)
    return out


def _block_batch(block: int, data: bytes, total: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([data], pa.binary()), pa.array([total], pa.int64())], names=["block", "data", "total"]
    )


#: Odd multipliers: each permutes the hashes of tokens, and so gives an order of its own.
_MULTIPLIERS = np.random.default_rng(7).integers(1 << 62, 1 << 63, ORDERS + 2 * KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rarity_levels(counts: np.ndarray, mean: float) -> np.ndarray:
    """The cells' counts in steps of an eighth of an octave, from half the mean count on: 0 to 63.

    A token's cell holds about the mean count of other tokens besides its own; fine steps let
    the tokens of even a small group of copies stand behind those that occur once.
    """
    return np.clip(8 * np.log2((counts + 1.0) / (mean + 1.0)) + 8, 0, 63).astype(np.uint8)


def _ordered(tokens: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of the tokens under one order: rare first, then by hash. Equal keys, equal tokens."""
    return level << np.uint64(57) | (tokens * _MULTIPLIERS[order]) >> np.uint64(7)


def signatures(rows: DataFrame, words: int, num: int, den: int, model, cells: int) -> DataFrame:
    """Size, signature, star keys and the prefixes under each order of every non-empty set.

    ``model`` is the broadcast of the ``cells`` rarity levels.
    """
    shift = np.uint64(64 - (cells.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, texts in _texts(batch, 1):
                sets = shingler.distinct(texts)
                ids = [docs[first + i] for i, own in enumerate(sets) if len(own)]
                sets = [own for own in sets if len(own)]
                if not ids:
                    continue
                n = np.array([len(own) for own in sets])
                ends = np.cumsum(n)
                starts = ends - n
                tokens = np.concatenate(sets)
                rarity = model.value[(tokens >> shift).astype(np.int64)].astype(np.uint64)
                signature = [hashlib.md5(own.tobytes()).digest() for own in sets]
                central = (np.add.reduceat(rarity, starts).astype(np.int64) * 16 // n).astype(np.int32)
                least = [np.minimum.reduceat(tokens * m, starts) for m in _MULTIPLIERS[ORDERS:]]
                keys = np.stack([mix(least[2 * k] + mix(least[2 * k + 1]) + np.uint64(k)) for k in range(KEYS)], 1)
                take = (n - (num * n + den - 1) // den + 1).tolist()
                prefixes: list[list[np.ndarray]] = []
                for k in range(ORDERS):
                    key = _ordered(tokens, rarity, k)
                    own = [key[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    prefixes.append([np.sort(np.partition(x, t - 1)[:t] if t < len(x) else x) for x, t in zip(own, take, strict=True)])
                lists = [_lists(list(keys), np.int64), _lists(prefixes[0], np.int64)]
                lists += [_lists([x.astype(np.uint32) for x in p], np.int32) for p in prefixes[1:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(signature, pa.binary()), pa.array(central, pa.int32()), *lists],
                    names=["id", "n", "signature", "central", "keys", "p1", "p2", "p3"],
                )

    return rows.mapInArrow(frugal(run), SIGNED)


def _lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(kind)))


def sizes_match(n: str, m: str, num: int, den: int) -> Column:
    return (F.lit(den) * F.least(n, m) >= F.lit(num) * F.greatest(n, m))


def _overlap(num: int, den: int) -> Column:
    """The tokens that sets of n and m must share."""
    return F.ceil(F.lit(num) * (F.col("n") + F.col("m")) / F.lit(num + den))


def share_prefixes(pairs: DataFrame, live: DataFrame, first: bool) -> DataFrame:
    """Pairs (x, y, ..) whose prefixes meet under the second and third order (``first``: also the first)."""
    used = ["p1", "p2", "p3"] if first else ["p2", "p3"]
    for side in ("x", "y"):
        own = live.select(F.col("id").alias(side), *[F.col(p).alias(side + p) for p in used])
        pairs = pairs.join(own, side)
    for p in used:
        pairs = pairs.where(F.arrays_overlap("x" + p, "y" + p))
    return pairs.select("x", "y")


def _bits(ids: DataFrame, words: int) -> np.ndarray:
    """A Bloom filter over ``id`` of ``words`` words; it may only let too many rows through."""
    two = F.explode(F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(7)))).alias("h")
    found = (
        ids.select(two)
        .selectExpr(f"pmod(shiftright(h, 6), {words}) AS word", "shiftleft(1L, CAST(pmod(h, 64) AS int)) AS bit")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(words, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _sets(ids: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """``id, tokens``: the sets of the rows whose id is in ``ids``, and of few others.

    The filter that spares other texts grows with the number of ids up to ``FILTER_WORDS``;
    with more ids than that serves, the texts are semi-joined to the ids instead.
    """
    spark = rows.sparkSession
    n = ids.count()
    size = 1 << max(10, (n * FILTER_BITS // 64).bit_length())
    bits = None
    if size <= FILTER_WORDS:
        bits = spark.sparkContext.broadcast(_bits(ids, size))
    else:
        rows = rows.join(ids.select("id").distinct(), "id", "left_semi")
    hashed = rows.select("id", "text", F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(7)).alias("b"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for column in (2, 3) if bits is not None else ():
                h = batch.column(column).to_numpy()
                hit &= (bits.value[(h >> 6) % size] >> (h % 64)) & 1 == 1
            at = np.flatnonzero(hit).tolist()
            for lo in range(0, len(at), 500):
                own = at[lo : lo + 500]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(own)),
                        pa.array([x.tobytes() for x in shingler.distinct([batch.column(1)[i].as_py() for i in own])], pa.binary()),
                    ],
                    names=["id", "tokens"],
                )

    return hashed.mapInArrow(frugal(sets), "id long, tokens binary")


def verified(pairs: DataFrame, rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose similarity is at least num / den, by comparing their sets."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, a = None, np.empty(0, np.uint64)
            for i, (x, left, right) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if x != last:
                    last, a = x, np.frombuffer(left.as_py(), np.uint64)
                b = np.frombuffer(right.as_py(), np.uint64)
                at = np.searchsorted(a, b)
                at[at == len(a)] = 0
                both = int((a[at] == b).sum())
                if den * both >= num * (len(a) + len(b) - both):
                    keep.append(i)
            yield batch.select(["x", "y"]).take(pa.array(keep, pa.int64()))

    tokens = _sets(pairs.select(F.explode(F.array("x", "y")).alias("id")), rows, words)
    left = tokens.select(F.col("id").alias("x"), F.col("tokens").alias("left"))
    right = tokens.select(F.col("id").alias("y"), F.col("tokens").alias("right"))
    joined = pairs.join(left, "x").join(right, "y").select("x", "y", "left", "right")
    return joined.mapInArrow(frugal(compare), "x long, y long")


def _links_of_cell(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of the sets are linked: a symmetric matrix of booleans, true on the diagonal.

    Intersections are products of a matrix of sets and tokens, some tokens at a time; tokens
    of one set alone take no part.
    """
    n = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), n)
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    new = np.r_[True, token[1:] != token[:-1]]
    df = np.diff(np.r_[np.flatnonzero(new), len(token)])
    shared = np.repeat(df > 1, df)
    of, column = of[shared], (np.cumsum(new) - 1)[shared]
    column = np.unique(column, return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float64)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 1 + TOKENS_AT_ONCE, TOKENS_AT_ONCE))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = np.zeros((len(sets), TOKENS_AT_ONCE), np.float32)
        part[of[lo:hi], column[lo:hi] - k * TOKENS_AT_ONCE] = 1
        both += part @ part.T
    linked = den * both >= num * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(linked, True)
    return linked


def linked_sets(components: DataFrame, weights: DataFrame, rows: DataFrame, words: int, num: int, den: int, pairs: bool) -> DataFrame:
    """``id, n_links``: the documents whose set is linked to that of the representative ``id``, other than by being equal.

    With ``pairs`` the links themselves, ``x, y``, each once. ``components`` has ``id, component``
    and ``weights`` the size ``n`` of the set of ``id`` and the number ``weight`` of documents with it.
    A component of more than ``SETS_AT_ONCE`` sets or ``CELL_TOKENS`` tokens is dealt to cells of
    two blocks each, so no task holds more at once.
    """
    own = components.join(weights, "id")
    most = F.greatest(F.count(F.lit(1)) / F.lit(SETS_AT_ONCE), F.sum("n") / F.lit(CELL_TOKENS))
    sizes = own.groupBy("component").agg(F.ceil(most).alias("blocks"))
    placed = own.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id", F.lit(13)), "blocks"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("id", "component", "weight", "block", meets).select(
        "id", "component", "weight", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    sent = dealt.join(_sets(components.select("id"), rows, words), "id").select(*_CELL, "id", "weight", "block", "tokens")

    def compare(table: pa.Table) -> dict[str, np.ndarray]:
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)  # rows alike bring a set twice
        weight, block = table.column("weight").to_numpy()[first], table.column("block").to_numpy()[first]
        held = table.column("tokens").to_pylist()
        linked = _links_of_cell([np.frombuffer(held[i], np.uint64) for i in first.tolist()], num, den)
        # Sets of one block meet in the cell of their own block, others in the cell of both.
        linked &= (block[:, None] == block[None, :]) == (table.column("lo")[0] == table.column("hi")[0])
        np.fill_diagonal(linked, False)
        if not pairs:
            return {"id": ids, "n_links": linked @ weight}
        x, y = np.nonzero(np.triu(linked))
        return {"x": ids[x], "y": ids[y]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def first_rows(table: pa.Table) -> np.ndarray:
            keys = [table.column(c).to_numpy() for c in _CELL]
            return np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])

        def solve(table: pa.Table) -> pa.RecordBatch:
            edges = [*first_rows(table).tolist(), table.num_rows]
            found = [compare(table.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_pydict({k: pa.array(np.concatenate([f[k] for f in found]).astype(np.int64)) for k in found[0]})

        waiting, held = [], 0
        for batch in batches:
            waiting.append(batch)
            held += batch.column("tokens").nbytes
            if held < 8 * CELL_TOKENS:
                continue
            table = pa.Table.from_batches(waiting)
            cut = int(first_rows(table)[-1])
            if cut:
                yield solve(table.slice(0, cut))
                waiting = table.slice(cut).to_batches()
                held = sum(x.column("tokens").nbytes for x in waiting)
        if waiting:
            yield solve(pa.Table.from_batches(waiting))

    dealt = sent.repartition(*_CELL).sortWithinPartitions(*_CELL)
    found = dealt.mapInArrow(frugal(run), "x long, y long" if pairs else "id long, n_links long")
    return found if pairs else found.groupBy("id").agg(F.sum("n_links").alias("n_links"))


def star_pairs(live: DataFrame, num: int, den: int) -> DataFrame:
    """Each set with the most central set of its min-hash keys, if their sizes allow a link."""
    keyed = live.select(F.explode("keys").alias("key"), "id", "n", "central")
    best = F.max(F.struct(F.col("central"), (-F.col("id")).alias("minus"), F.col("n").alias("m")))
    centres = keyed.groupBy("key").agg(best.alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1")
    pairs = keyed.join(centres, "key").select(F.col("id").alias("x"), (-F.col("c.minus")).alias("y"), "n", F.col("c.m").alias("m"))
    return pairs.where(F.col("x") != F.col("y")).where(sizes_match("n", "m", num, den)).select("x", "y").distinct()


def index_pairs(live: DataFrame, labels: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs of different components that meet in the index of first-order prefixes.

    A pair qualifies by a shared token whose positions leave room for the overlap it needs:
    the token stands before position n - a in the one and m - a in the other.
    """
    rows = live.join(labels, "id", "left").select("id", "n", F.coalesce("component", "id").alias("c"), F.posexplode("p1").alias("at", "token"))
    mixed = rows.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    rows = scratch.save(rows.join(mixed, "token"))
    # For sets of one size the prefix is shorter than for a smaller partner: the smaller set of
    # a pair (the first by id among equals) meets the other in its short prefix.
    short = F.col("at") <= F.col("n") - F.ceil(F.lit(2 * num) * F.col("n") / F.lit(num + den))
    small = rows.where(short).select("token", F.col("id").alias("x"), "n", F.col("c").alias("cx"), F.col("at").alias("i"))
    other = rows.select("token", F.col("id").alias("y"), F.col("n").alias("m"), F.col("c").alias("cy"), F.col("at").alias("j"))
    a = _overlap(num, den)
    ordered = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("x") < F.col("y")))
    pairs = small.join(
        other,
        (small["token"] == other["token"])
        & ordered
        & (F.col("cx") != F.col("cy"))
        & (F.lit(den) * F.col("n") >= F.lit(num) * F.col("m"))
        & (F.col("i") <= F.col("n") - a)
        & (F.col("j") <= F.col("m") - a),
    )
    return pairs.select("x", "y").distinct()


class _Join:
    """The tables of one join: rows, who has which set, and the components of representatives."""

    def __init__(self, docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str):
        spark = docs.sparkSession
        bounded_batches(spark)
        self.words, self.num, self.den = words, num, den
        self.scratch = scratch = Scratch(spark, "jaccard")
        self.docs, self.unique = numbered_rows(docs, scratch, id_col, text_col)
        self.rows = self.docs.select(F.col("_doc").alias("id"), text_or_empty(f"_row.{text_col}").cast("binary").alias("text"))
        levels = token_levels(self.rows, words, scratch)
        model = spark.sparkContext.broadcast(levels)
        cells = len(levels)
        del levels
        every = scratch.save(signatures(self.rows, words, num, den, model, cells))
        model.destroy()
        groups = scratch.save(every.groupBy("signature").agg(F.min("id").alias("member_of"), F.count(F.lit(1)).alias("weight")))
        #: ``id, n, member_of, weight``: a row's number, its set's size, the smallest number with that set, and how many have it.
        self.members = scratch.save(every.select("id", "n", "signature").join(groups, "signature").select("id", "n", "member_of", "weight"))
        chosen = self.members.where("id = member_of").select("id").distinct()
        live = scratch.save(every.drop("signature").join(chosen, "id", "left_semi").dropDuplicates(["id"]))
        scratch.drop(every)
        scratch.drop(groups)
        self.components = self._components(live)
        scratch.drop(live)

    def _components(self, live: DataFrame) -> DataFrame:
        scratch, rows, words, num, den = self.scratch, self.rows, self.words, self.num, self.den
        stars = scratch.save(share_prefixes(star_pairs(live, num, den), live, first=True))
        links = scratch.save(verified(stars, rows, words, num, den))
        scratch.drop(stars)
        labels = connected_components(links.select(F.col("x").alias("u"), F.col("y").alias("v")), scratch)
        scratch.drop(links)
        across = scratch.save(share_prefixes(index_pairs(live, labels, num, den, scratch), live, first=False))
        more = scratch.save(verified(across, rows, words, num, den))
        scratch.drop(across)
        # Components of the first round stand for their members when the second round's links are added.
        tree = labels.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
        return connected_components(tree.unionByName(more.select(F.col("x").alias("u"), F.col("y").alias("v"))), scratch)

    def linked(self, pairs: bool) -> DataFrame:
        weights = self.members.where("id = member_of").select("id", "n", "weight").dropDuplicates(["id"])
        return self.scratch.save(linked_sets(self.components, weights, self.rows, self.words, self.num, self.den, pairs))

    def found(self) -> DataFrame:
        """``id, n, member_of, weight, component`` of every row with a set."""
        reached = self.components.select(F.col("id").alias("member_of"), "component")
        out = self.members.join(reached, "member_of", "left").withColumn("component", F.coalesce("component", "member_of"))
        return out if self.unique else out.dropDuplicates(["id"])  # of rows that repeat id and text


def jaccard_pairs(
    docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and who has which set; ids must be there and differ.

    Returns ``id, n, member_of`` (an id, its set's size and the smallest id with that set) and
    ``x, y``: each pair of such representatives whose sets reach the similarity, once. The
    pairs of a group of near copies grow with its square; ``jaccard_components`` counts them.
    """
    join = _Join(docs, words, num, den, id_col, text_col)
    if not join.unique:
        raise ValueError("ids are null or repeat")
    links = join.linked(pairs=True)
    join.scratch.keep_only(join.members, links)
    return join.members.select("id", "n", "member_of"), links


def jaccard_components(
    docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", links: bool = False
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``, and ``n_links`` with ``links``.

    Words are what ASCII white space separates, after A-Z are lower-cased; a document's set
    are its distinct shingles of ``words`` words, or its whole sequence as one shingle if it
    has fewer. Documents with ``den * intersection >= num * union`` are linked, and
    ``component_id`` is the smallest id that links reach, itself included. ``n_links`` is the
    number of other documents that a document is linked to; all links of a component are
    verified for it. Shingles are compared by 64-bit hashes.

    Null and empty texts and texts of white space have an empty set and are linked with
    nothing. Rows that repeat an id, null included, are documents of their own if their texts
    differ; a component of null ids alone has a null ``component_id``. Rows that repeat id and
    text get the same answer, and are linked to one another. An empty table gives an empty
    result; other columns are ignored.
    """
    join = _Join(docs.select(id_col, text_col), words, num, den, id_col, text_col)
    found = join.found()
    kept = [join.members, join.components]
    if links:
        degree = join.linked(pairs=False)
        kept.append(degree)
        found = found.join(degree.withColumnRenamed("id", "member_of"), "member_of", "left").withColumn(
            "n_links", F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1
        )
    ids = join.docs.select("_doc", F.col(f"_row.{id_col}").cast("long").alias("doc_id"))
    out = ids.join(found.withColumnRenamed("id", "_doc"), "_doc", "left")
    if join.unique:
        out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    else:
        names = ids.select(F.col("_doc").alias("component"), F.col("doc_id").alias("component_id")).distinct()
        out = out.withColumn("component", F.coalesce("component", "_doc")).join(names, "component", "left")
        kept.append(join.docs)
    join.scratch.keep_only(*kept)
    columns = [F.col("doc_id"), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_shingles"), F.col("component_id")]
    return out.select(*columns, *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []))


def keep_one_of_each(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id (null last), and all that are linked with nothing.

    Rows are told apart by id and text; of rows that repeat both, one stays. All columns stay.
    """
    join = _Join(docs, words, num, den, id_col, text_col)
    dropped = join.found().where("id <> component").select(F.col("id").alias("_doc"))
    kept = join.docs if join.unique else join.docs.dropDuplicates(["_doc"])
    join.scratch.keep_only(join.members, join.components, *([] if join.unique else [join.docs]))
    return kept.join(dropped, "_doc", "left_anti").select(*[F.col(f"_row.{c}") for c in docs.columns])
