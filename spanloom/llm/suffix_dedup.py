"""Removal of repeated substrings by longest-previous-factor arrays over dealt suffixes.

One suffix array of a whole corpus fits no machine, so suffixes are dealt to tasks such
that all suffixes with equal first ``min_bytes`` bytes (a *window*) meet:

* Every window picks an anchor, the k-gram in it with the smallest hash (leftmost on ties).
  Equal windows pick equal anchors at equal offsets. Consecutive windows of a text with one
  anchor form a *run*, so a text has about ``2 / (min_bytes - k)`` runs a byte.
* Anchors that occur once settle their windows: those repeat nowhere. Runs of equal content
  settle each other: all their windows repeat. Contents are told apart by 128-bit hashes.
* What is left, one run of each content for anchors with runs of several contents, goes to
  the task of its anchor with its bytes. There the suffixes that begin the windows are put
  into suffix order by ranking longer and longer prefixes, the previous and next smaller positions in that order
  are found, and the longer of the two matches is the suffix's longest previous factor. A
  window repeats an earlier one exactly if that factor has ``min_bytes`` bytes.
* An anchor with too many contents for one task is cut finer: its windows are dealt by their
  distance to the anchor and the bytes that all windows of such a block share, first in a few
  blocks, then one by one, and equal pieces settle each other again. Equal windows still meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, frugal, numbered_rows, text_or_empty

CHUNK = 500_000
#: Bytes of dealt runs that are put into suffix order at once; so few stay in a core's cache.
AT_ONCE = 400_000
#: Contents of an anchor from which it is cut finer, the blocks of the first cut, and how many
#: times as many contents a block may have, whose pieces are so much shorter.
SPREAD_FROM, BLOCKS, OF_A_BLOCK = 1000, 8, 10
#: Runs meet the anchors that occur often in so many passes, each over its own anchors: what the
#: join of one pass shuffles is gone before the next.
PASSES = 2
_POSITION_BITS = 21
#: Parts of a prefix whose ranks make the rank of the next length.
_WAYS = 3
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

ANCHORS = "anchor long, run binary, doc long, start long, windows int, off int"
PIECES = "anchor long, doc long, start long, bytes binary"
SINGLES = "run binary, doc long, start long"
RANGES = "doc long, first long, last long"


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


class Rolling:
    """Hashes of the k-grams of a buffer from one array of prefix sums, modulo 2**64.

    They only choose and name anchors: unequal grams with one hash share a task, no more.
    """

    _up: np.ndarray = _powers(_BASE, 1)
    _down: np.ndarray = _powers(1, 1)

    def __init__(self, buffer: bytes):
        n = len(buffer)
        if len(Rolling._up) <= n:
            size = max(n + 1, CHUNK * 2)
            Rolling._up, Rolling._down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(buffer, np.uint8)] * Rolling._up[:n], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * Rolling._down[:n])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def gram_size(min_bytes: int) -> int:
    return max(1, min(64, min_bytes // 4))


def runs(buffer: bytes, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content hash, first window, number of windows and anchor's offset of each run.

    ``starts`` and ``ends`` delimit the texts that the buffer joins; windows never cross them.
    """
    from xxhash import xxh3_128_digest

    gram = gram_size(size)
    hashes = Rolling(buffer).all(gram)
    low = np.uint64(_POSITION_BITS)
    key = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_minimum(key, size - gram + 1) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    edge = np.zeros(len(at) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends - size + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    at = at[window]
    text = np.searchsorted(starts, window, side="right")
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[first, len(at)])
    begin, anchor = window[first], at[first]
    view = memoryview(buffer)
    content = [xxh3_128_digest(view[a:b]) for a, b in zip(begin.tolist(), (begin + count - 1 + size).tolist(), strict=True)]
    return hashes[anchor], content, begin, count, anchor - begin


def _buffers(texts: Iterator[tuple[int, int, bytes]], size: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, list[int], list[int]]]:
    """Texts of at least ``size`` bytes joined into buffers; a long text in pieces that overlap by size - 1.

    A text comes with its number and its place; yields the buffer, the starts and ends in it,
    and the numbers and places.
    """
    parts, ids, bases, total = [], [], [], 0

    def out():
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        return b"".join(parts), ends - lengths, ends, list(ids), list(bases)

    for i, place, text in texts:
        for base in range(0, len(text) - size + 1, CHUNK):
            part = text[base : base + CHUNK + size - 1]
            parts.append(part)
            ids.append(i)
            bases.append(place + base)
            total += len(part)
            if total >= CHUNK:
                yield out()
                parts, ids, bases, total = [], [], [], 0
    if parts:
        yield out()


def anchors(rows: DataFrame, size: int, regions: DataFrame | None = None) -> DataFrame:
    """The runs of every text of ``rows`` (doc, text as binary), or of its ``regions`` (doc, list of first, last)."""

    whole = regions is None

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
        for i, text in enumerate(batch.column(1)):
            if whole:
                yield i, 0, text.as_py()
            else:
                body = text.as_py()
                for r in batch.column(2)[i].as_py():
                    yield i, r["first"], body[r["first"] : r["last"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for buffer, starts, ends, ids, bases in _buffers(parts(batch), size):
                anchor, content, begin, count, off = runs(buffer, starts, ends, size)
                text = np.searchsorted(starts, begin, side="right") - 1
                start = begin - starts[text] + np.array(bases)[text]
                yield _batch(ANCHORS, (anchor.view(np.int64), content, docs[np.array(ids)[text]], start, count, off))

    if not whole:
        rows = rows.join(regions, "doc").select("doc", "text", "regions")
    return rows.mapInArrow(frugal(run), ANCHORS)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(ddl: str, columns) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    arrays = [pa.array(np.asarray(c, np.int32) if t == "int" else c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _of_each_run(rows: DataFrame, chosen: DataFrame, ddl: str, made, at_once: int) -> DataFrame:
    """Rows of ``ddl`` that ``made`` gives for each chosen run (doc, anchor, start, windows, off) and its text."""
    own = chosen.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "windows", "off")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                for r in found.as_py():
                    out += made(doc, text, r)
                    if len(out) >= at_once:
                        yield _batch(ddl, zip(*out, strict=True))
                        out = []
            if out:
                yield _batch(ddl, zip(*out, strict=True))

    return rows.join(own, "doc").select("doc", "text", "runs").mapInArrow(frugal(run), ddl)


def finer(rows: DataFrame, chosen: DataFrame, size: int, blocks: int = BLOCKS) -> DataFrame:
    """Chosen runs cut into ``blocks`` by the windows' distance to the anchor, as runs of finer anchors.

    The finer anchor is the block with the bytes that all of its windows share.
    """
    most = size - gram_size(size) + 1
    width = -(-most // blocks)

    def made(doc: int, text: bytes, r: dict) -> Iterator[tuple]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        at = r["start"] + r["off"]
        for block in range((r["off"] - r["windows"] + 1) // width, r["off"] // width + 1):
            near, far = block * width, min((block + 1) * width, most) - 1
            high, low = min(far, r["off"]), max(near, r["off"] - r["windows"] + 1)
            start, count = at - high, high - low + 1
            shared = xxh3_64_intdigest(text[at - near : at - far + size], block)
            key = (shared ^ (r["anchor"] & 0xFFFFFFFFFFFFFFFF)) - (1 << 63)
            yield key, xxh3_128_digest(text[start : start + count - 1 + size]), doc, start, count, high

    return _of_each_run(rows, chosen, ANCHORS, made, 20_000)


def single_windows(rows: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """Every window of chosen runs by the 128-bit hash of its bytes."""

    def made(doc: int, text: bytes, r: dict) -> Iterator[tuple]:
        from xxhash import xxh3_128_digest

        for start in range(r["start"], r["start"] + r["windows"]):
            yield xxh3_128_digest(text[start : start + size]), doc, start

    return _of_each_run(rows, chosen, SINGLES, made, 20_000)


def pieces(rows: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """The bytes of chosen runs."""

    def made(doc: int, text: bytes, r: dict) -> list[tuple]:
        return [(r["anchor"], doc, r["start"], text[r["start"] : r["start"] + r["windows"] - 1 + size])]

    return _of_each_run(rows, chosen, PIECES, made, 5000)


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1 on, equal ones for equal keys."""
    order = np.argsort(key)
    own = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.r_[True, own[1:] != own[:-1]]) if len(key) else own
    return rank


class SuffixOrder:
    """Suffixes of a buffer in the order of their first bytes, by multiplying the length of ranked prefixes.

    The rank of the first 3 h bytes comes from the ranks of three parts (of two, where three
    ranks of a large buffer do not fit one number). The ranks of every length up to ``most``
    bytes are kept: they give the order of any number of bytes, and the common prefix of any
    two suffixes.
    """

    def __init__(self, text: np.ndarray, most: int):
        n = len(text)
        self.ways = _WAYS if (n + 2) ** _WAYS < 1 << 62 else 2
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)
        self.levels: list[tuple[int, np.ndarray]] = []
        h, key, every = 8, self.words, np.arange(n)
        while h <= most:
            rank = _dense(key)
            self.levels.append((h, np.append(rank, 0)))  # 0: beyond the end
            if h * self.ways <= most:
                key = self._joined(rank, every, [h * k for k in range(self.ways)])
            h *= self.ways

    def order(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``at`` (ascending suffixes) by the first ``size`` bytes, equal ones by position,
        and keys that are equal for equal bytes."""
        known = [(h, rank) for h, rank in self.levels if h <= size]
        if not known:
            key = self.words[at] >> np.uint64(64 - 8 * size)
        else:
            h, rank = known[-1]
            parts = -(-size // h)  # as many as the ways; the last one overlaps
            key = self._joined(rank[:-1], at, [h * k for k in range(parts - 1)] + [size - h])
        key = _dense(key)
        return np.argsort(key * (len(at) + 1) + np.arange(len(at))), key

    @staticmethod
    def _joined(rank: np.ndarray, at: np.ndarray, offsets: list[int]) -> np.ndarray:
        """Sort keys from the ranks at the offsets from each suffix."""
        n, ended = len(rank), np.append(rank, 0)
        key = np.zeros(len(at), np.int64)
        for off in offsets:
            key = key * (n + 2) + ended[np.minimum(at + off, n)]
        return key

    def common(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """The common prefix of suffixes at ``a`` and ``b``, ``size`` at most."""
        n, length = len(self.words), np.zeros(len(a), np.int64)
        for h, rank in reversed(self.levels):
            for _ in range(self.ways - 1):
                x, y = a + length, b + length
                inside = (length + h <= size) & (np.maximum(x, y) + h <= n)
                same = inside & (rank[np.minimum(x, n)] == rank[np.minimum(y, n)])
                length += np.where(same, h, 0)
        x, y = a + length, b + length
        differ = self.words[np.minimum(x, n - 1)] ^ self.words[np.minimum(y, n - 1)]
        equal = np.full(len(a), 8, np.int64)
        for k in range(7, -1, -1):
            equal[differ >> np.uint64(56 - 8 * k) & np.uint64(255) != 0] = k
        rest = np.minimum(np.minimum(size - length, n - np.maximum(x, y)), 8)
        return length + np.minimum(equal, np.maximum(rest, 0))


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1.

    All places look back at once: one whose candidate is not smaller takes its candidate's.
    """
    at = np.arange(len(values)) - 1
    todo = np.flatnonzero((at >= 0) & (values[at] > values))
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[(at[todo] >= 0) & (values[at[todo]] > values[todo])]
    return at


def longest_previous(suffixes: SuffixOrder, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factors of the suffixes ``at`` among them, and the place in ``at`` of that earlier match or -1.

    Factors are counted up to ``size`` bytes. Of the suffixes before one in the text, the one
    with the longest match is its previous or its next smaller position in suffix order
    (Crochemore and Ilie, 2008).
    """
    best, match = np.zeros(len(at), np.int64), np.full(len(at), -1)
    if not len(at):
        return best, match
    order, key = suffixes.order(at, size)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = previous_smaller(order)
    after = len(order) - 1 - previous_smaller(order[::-1])[::-1]
    for near in (before, after):
        earlier = near[place]  # for each suffix, no longer for each place in the order
        real = np.flatnonzero((earlier >= 0) & (earlier < len(order)) & (best < size))
        found = order[earlier[real]]
        length = np.full(len(real), size)
        # Equal keys are equal bytes, if the text goes on for so many.
        part = np.flatnonzero((key[real] != key[found]) | (at[real] + size > len(suffixes.words)))
        length[part] = suffixes.common(at[real[part]], at[found[part]], size)
        better = length > best[real]
        best[real[better]], match[real[better]] = length[better], found[better]
    return best, match


def repeated_windows(suffixes: SuffixOrder, at: np.ndarray, size: int, later: bool) -> np.ndarray:
    """Which windows, given in order of position, match another (``later``: an earlier) one."""
    factor, match = longest_previous(suffixes, at, size)
    found = factor >= size
    if not later:
        found[match[found]] = True
    return found


def _matched(size: int, later: bool):
    """A mapInArrow function over ``PIECES`` sorted by anchor: ranges of repeated bytes."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        doc, start = (table.column(c).to_numpy() for c in ("doc", "start"))
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])]  # rows alike in id and text bring a piece twice
        order, doc, start = order[new], doc[new], start[new]
        own = table.column("bytes").to_pylist()
        own = [own[i] for i in order.tolist()]
        n = np.fromiter(map(len, own), np.int64, len(own))
        windows = n - size + 1
        begin = np.cumsum(n) - n
        row = np.repeat(np.arange(len(own)), windows)
        j = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        suffixes = SuffixOrder(np.frombuffer(b"".join(own), np.uint8), size)
        hit = np.flatnonzero(repeated_windows(suffixes, begin[row] + j, size, later))
        r, k = row[hit], j[hit]
        first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1] + 1)]) if len(r) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(r)] - 1 if len(r) else first
        return _batch(RANGES, (doc[r[first]], start[r[first]] + k[first], start[r[last]] + k[last] + size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                waiting.append(part)
                held += part.column("bytes").nbytes
                if held < AT_ONCE:
                    continue
                table = pa.Table.from_batches(waiting)
                anchor = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    yield solve(table.slice(0, cut))
                    waiting = table.slice(cut).to_batches()
                    held = sum(x.column("bytes").nbytes for x in waiting)
        if waiting:
            yield solve(pa.Table.from_batches(waiting))

    return run


def repeated_ranges(
    rows: DataFrame, size: int, later: bool, scratch: Scratch, spread_from: int | None = None, regions: DataFrame | None = None
) -> DataFrame:
    """``doc, first, last``: byte ranges of ``rows`` (doc, text as binary), or of their ``regions``, made of repeated windows."""
    most = SPREAD_FROM if spread_from is None else spread_from
    every, found = anchors(rows, size, regions), []
    for finest in (False, True):
        every = scratch.save(every)
        parts = _shared(every, scratch)
        shared = reduce(DataFrame.unionByName, parts)
        scratch.drop(every)
        place = F.struct("doc", "start", "windows", "off")
        contents = scratch.save(
            shared.groupBy("anchor", "run")
            .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
            .select("anchor", "run", "n", "place.*")
        )
        copies = contents.where("n > 1").select("anchor", "run", F.col("doc").alias("_doc"), F.col("start").alias("_start"))
        settled = shared.join(copies, ["anchor", "run"])
        if later:
            settled = settled.where((F.col("doc") != F.col("_doc")) | (F.col("start") != F.col("_start")))
        last = (F.col("start") + F.col("windows") - 1 + size).alias("last")
        found.append(scratch.save(settled.select("doc", F.col("start").alias("first"), last)))
        for part in parts:
            scratch.drop(part)
        open_anchors = scratch.save(
            contents.groupBy("anchor")
            .agg(F.count(F.lit(1)).alias("runs"), F.min("n").alias("least"))
            .where("runs > 1" if later else "runs > 1 AND least = 1")
            .select("anchor", (F.col("runs") > most).alias("hot"))
        )
        chosen = scratch.save(contents.join(open_anchors, "anchor").select("anchor", "doc", "start", "windows", "off", "hot"))
        scratch.drop(contents)
        scratch.drop(open_anchors)
        cold = pieces(rows, chosen.where("NOT hot"), size).repartition("anchor").sortWithinPartitions("anchor")
        found.append(scratch.save(cold.mapInArrow(frugal(_matched(size, later)), RANGES)))
        hot = chosen.where("hot")
        if hot.isEmpty():
            break
        if finest:
            found.append(_equal_windows(single_windows(rows, hot, size), size, later, scratch))
        else:
            every, most = finer(rows, hot, size), most * OF_A_BLOCK
    return reduce(DataFrame.unionByName, found)


def _shared(every: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The runs (``ANCHORS``) whose anchor occurs more than once, in ``PASSES`` tables of different anchors."""
    # Written first, so that nothing above the exchanges of the join keeps Spark from splitting a hot anchor.
    often = scratch.save(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    out = []
    for i in range(PASSES):
        own = F.pmod(F.col("anchor"), F.lit(PASSES)) == i
        out.append(scratch.save(every.where(own).join(often.where(own), "anchor")))
    scratch.drop(often)
    return out


def _equal_windows(singles: DataFrame, size: int, later: bool, scratch: Scratch) -> DataFrame:
    """The ranges of single windows whose bytes occur again, by their hashes."""
    singles = scratch.save(singles)
    again = singles.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "start")).alias("first")).where("n > 1")
    joined = singles.join(scratch.save(again), "run")
    if later:
        joined = joined.where(F.struct("doc", "start") != F.col("first"))
    return scratch.save(joined.select("doc", F.col("start").alias("first"), (F.col("start") + size).alias("last")))


def union_of(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts)


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk such that no UTF-8 character is cut in two."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _by_doc(found: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.save(found.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("ranges")))


def _long_regions(by_doc: DataFrame, size: int) -> DataFrame:
    """``doc, regions``: what the ranges of a text cover, where that is ``size`` bytes or more at a stretch."""

    def joined(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ranges in arrays:
            spans = [[x for x in own if x[1] - x[0] >= size] for own in _spans(ranges)]
            ends = np.cumsum([0, *map(len, spans)]).astype(np.int32)
            flat = np.array([x for own in spans for x in own], np.int64).reshape(-1, 2)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["first", "last"])
            yield pa.ListArray.from_arrays(pa.array(ends), parts)

    regions = F.arrow_udf(joined, "array<struct<first:bigint,last:bigint>>")("ranges").alias("regions")
    return by_doc.select("doc", regions).where(F.size("regions") > 0)


def _marked(docs: DataFrame, min_bytes: int, report_bytes: int, later: bool, id_col: str, text_col: str) -> DataFrame:
    """``_row`` (all columns of ``docs``), ``_text`` as binary, and ``_ranges`` to remove and ``_report`` or nulls."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "suffix_dedup")
    numbered, _ = numbered_rows(docs, scratch, id_col, text_col)
    kept = scratch.tables()
    rows = numbered.select(F.col("_doc").alias("doc"), text_or_empty(f"_row.{text_col}").cast("binary").alias("text"))
    report, regions = None, None
    if report_bytes < min_bytes:
        report = _by_doc(repeated_ranges(rows, report_bytes, later, scratch), scratch)
        kept.append(report)
        if not later:
            # Longer strings that occur again lie where shorter ones do: nothing else is searched for them.
            regions = scratch.save(_long_regions(report, min_bytes))
            kept.append(regions)
        scratch.keep_only(*kept)
    ranges = _by_doc(repeated_ranges(rows, min_bytes, later, scratch, regions=regions), scratch)
    if regions is not None:
        kept.remove(regions)
    scratch.keep_only(ranges, *kept)
    marked = numbered.select(F.col("_doc").alias("doc"), "_row").join(ranges.withColumnRenamed("ranges", "_ranges"), "doc", "left")
    report = F.col("_ranges") if report is None else F.col("_report")
    if report_bytes < min_bytes:
        marked = marked.join(kept[-1].withColumnRenamed("ranges", "_report"), "doc", "left")
    return marked.select("_row", F.col(f"_row.{text_col}").cast("binary").alias("_text"), "_ranges", report.alias("_report"))


def _spans(ranges: pa.Array) -> Iterator[list[tuple[int, int]]]:
    """The maximal runs of covered bytes of each row of ranges; none for a null."""
    first, last = (ranges.values.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("first", "last"))
    ends = ranges.offsets.to_numpy().tolist()
    for a, b, real in zip(ends[:-1], ends[1:], ranges.is_valid().to_pylist(), strict=True):
        yield union_of(list(zip(first[a:b], last[a:b], strict=True))) if real else []


DIGEST_DDL = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"
DIGEST = pa.struct([*[(c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], ("kept_sha256", pa.string()), ("n_repeated", pa.int64())])


def _digest(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, ranges, reports in columns:
        out = []
        for text, spans, report in zip(texts, _spans(ranges), _spans(reports), strict=True):
            body = text.as_py() or b""
            kept = hashlib.sha256(cut(body, spans)).hexdigest()
            out.append((len(body), sum(b - a for a, b in spans), len(spans), kept, sum(b - a for a, b in report)))
        yield pa.StructArray.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(DIGEST)], fields=list(DIGEST))


def _remaining(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, ranges in columns:
        out = []
        for text, spans in zip(texts, _spans(ranges), strict=True):
            body = text.as_py()
            out.append(None if body is None else cut(body, whole_characters(body, spans)).decode())
        yield pa.array(out, pa.string())


def suffix_dedup(
    docs: DataFrame,
    min_bytes: int = 400,
    later: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    report_bytes: int | None = None,
) -> DataFrame:
    """What removing every byte covered by a repeated string of ``min_bytes`` bytes leaves of each text.

    With ``later`` only copies with an earlier occurrence go (in order of id, then position),
    so the first one stays; without it all occurrences go. A string may repeat within one
    text, occurrences may overlap, and all are judged on the input. Strings never span texts.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated``, where spans are
    maximal removed runs; ``without_repeats`` returns the remaining texts. ``n_repeated`` counts
    the bytes covered by repeated strings of ``report_bytes`` bytes, at most ``min_bytes`` and
    by default the same, so that shorter passages show that are not removed. Null texts count
    as empty.
    Rows that repeat an id, null included, are texts of their own, in the order of id (null
    last) and MD5 of the text. Rows that repeat id and text are occurrences each, but treated
    alike: with ``later`` all stay if they are the first. An empty table gives an empty
    result; other columns are ignored.
    """
    report = min_bytes if report_bytes is None else report_bytes
    if not 0 < report <= min_bytes:
        raise ValueError("report_bytes is from 1 to min_bytes")
    marked = _marked(docs.select(id_col, text_col), min_bytes, report, later, id_col, text_col)
    digest = F.arrow_udf(_digest, DIGEST_DDL)("_text", "_ranges", "_report").alias("_found")
    found = marked.select(F.col(f"_row.{id_col}").cast("long").alias("doc_id"), digest)
    return found.select("doc_id", "_found.*")


def without_repeats(
    docs: DataFrame,
    min_bytes: int = 400,
    later: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = None,
) -> DataFrame:
    """``docs`` with the remaining texts, all rows and columns; see ``suffix_dedup``.

    Removed spans are shrunk to whole characters. A null text stays null. ``length_col``
    names a column that then gets the number of characters of the new text.
    """
    marked = _marked(docs, min_bytes, min_bytes, later, id_col, text_col)
    marked = marked.withColumn("_left", F.arrow_udf(_remaining, "string")("_text", "_ranges"))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("_left").alias(c))
        elif c == length_col:
            columns.append(F.when(F.col("_left").isNull(), F.col(f"_row.{c}")).otherwise(F.length("_left").cast("long")).alias(c))
        else:
            columns.append(F.col(f"_row.{c}"))
    return marked.select(*columns)
