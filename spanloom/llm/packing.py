"""Packing of token sequences by local search: moves and swaps between underfull bins raise the
sum of squared fills until bins empty. The search starts from a cheap first packing."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembering, Scratch, bounded_batches, frugal, text_or_empty

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
#: Separators of str.split() that the tokenizer's pattern does not count as white space.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def _is_latin(text: str) -> bool:
    """Whether all characters are of the Latin blocks; most texts need no look at each."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _BEYOND_LATIN.search(text)


class WordTokenizer:
    """A tokenizer whose tokens never span white space; remembers the ids of words.

    ``encode`` returns ids as little-endian unsigned 32-bit integers, equal to those of the
    library for the whole text without added special tokens. A text that holds the string of an
    added token goes through the library whole. A word of Latin letters, which normalising and
    splitting leave in one piece, goes straight to the library's merges; any other word takes
    the library's whole way.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(data)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merges = self.library.model
        split = self.library.pre_tokenizer.pre_tokenize_str
        self.as_bytes = {i: split(chr(i))[0][0] for i in range(0x250) if chr(i).isalpha()}
        self.words = Remembering(self._word, 400_000)

    def _direct(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in ".,:;?!" and word[:-1].isalpha():
            return self.words[word[:-1]] + self.words[word[-1]]
        lower = word.lower()
        if lower.isalpha() and max(word) < "\u0250":
            return b"".join(t.id.to_bytes(4, "little") for t in self.merges.tokenize(lower.translate(self.as_bytes)))
        return self._direct(word)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        get = self.words.__getitem__
        whole = [*self.added, *_ODD_SPACE]
        for text in texts:
            if [x for x in whole if x in text]:
                yield self._direct(text)
                continue
            if _is_latin(text):
                text = text.lower()  # what the library does, here before words are looked up
            yield b"".join(map(get, text.split()))


_TOKENIZERS: dict[bytes, WordTokenizer] = {}


def _tokenizer(data: bytes) -> WordTokenizer:
    key = hashlib.md5(data).digest()
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordTokenizer(data)
    return _TOKENIZERS[key]


def _slices(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, about ``most`` characters at a time."""
    ids, texts, size = [], [], 0
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = text.as_py()
        ids.append(i)
        texts.append(text)
        size += len(text)
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: bool = False,
) -> DataFrame:
    """Each document's ids and then ``end_id``, cut into pieces of at most ``capacity``.

    Returns ``doc_id, piece, start, length, ids_crc32`` and with ``tokens`` also ``ids``.
    Null and empty texts give one piece of the end id alone.
    """
    bounded_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    end = int(end_id).to_bytes(4, "little")
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(data.value)
        for batch in batches:
            for ids, texts in _slices(batch):
                rows = []
                for doc, flat in zip(ids, coder.encode(texts), strict=True):
                    flat += end
                    for piece, at in enumerate(range(0, len(flat), width)):
                        own = flat[at : at + width]
                        rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), own))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(cols[:5], types, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if tokens:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), PIECES + (", ids array<int>" if tokens else ""))


def next_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices in the order given: an item that does not fit the bin at hand opens the next."""
    bins: list[list[int]] = []
    free = 0
    for item in range(len(lengths)):
        if lengths[item] > free:
            bins.append([])
            free = capacity
        bins[-1].append(item)
        free -= lengths[item]
    return bins


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices: longest item first, each into the fullest bin that still has room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is free in them
    free = 0  # bit r: some bin has r free
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[item]
        fits = free >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
            bins[b].append(item)
            r -= size
        else:
            b = len(bins)
            bins.append([item])
            r = capacity - size
        if r:
            room[r].append(b)
            free |= 1 << r
    return bins


def packed_bins(lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search from next fit; if that leaves more bins than the sum of lengths asks for, also
    from best fit, and the packing with fewer bins."""
    bins = swap_search(lengths, next_fit(lengths, capacity), capacity)
    if len(bins) > -(-sum(lengths) // capacity):
        bins = min(bins, swap_search(lengths, best_fit(lengths, capacity), capacity), key=len)
    return bins


class _Search:
    """Local search over underfull bins; the items of donor bins are indexed by length."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = bins
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.where: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # length: item -> bin
        self.up = 0  # bit l: a donor holds an item of length l
        self.down = 0  # bit capacity - l: the same

    def offer(self, item: int, b: int) -> None:
        size = self.lengths[item]
        self.where[size][item] = b
        self.up |= 1 << size
        self.down |= 1 << (self.capacity - size)

    def withdraw(self, item: int) -> None:
        size = self.lengths[item]
        own = self.where[size]
        own.pop(item, None)
        if not own:
            self.up &= ~(1 << size)
            self.down &= ~(1 << (self.capacity - size))

    def largest(self, most: int) -> int:
        """The largest donor length up to ``most``, or 0."""
        return (self.up & ((1 << (min(most, self.capacity) + 1)) - 1)).bit_length() - 1 if most > 0 and self.up else 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two donor lengths with the given sum."""
        if not 2 <= total <= 2 * self.capacity:
            return None
        shift = self.capacity - total
        mirrored = self.down >> shift if shift >= 0 else self.down << -shift
        both = self.up & mirrored
        while both:
            a = both.bit_length() - 1
            if a * 2 != total or len(self.where[a]) > 1:
                return a, total - a
            both &= ~(1 << a)
        return None

    def donors(self, sizes: list[int]) -> list[tuple[int, int]]:
        """An item and its bin for each of one or two donor lengths, two different items for two."""
        found = []
        for size in sizes:
            found.append(next((i, d) for i, d in self.where[size].items() if not found or i != found[0][0]))
        return found

    def apply(self, b: int, give: list[int], sizes: list[int]) -> bool:
        """Trade items of bin b for donors' items of these lengths, if every bin has room for its
        new items and the sum of squared fills grows. The last donor gets what is given."""
        taken = self.donors(sizes)
        given = sum(self.lengths[i] for i in give)
        change = {b: sum(sizes) - given}
        for (_, d), size in zip(taken, sizes, strict=True):
            change[d] = change.get(d, 0) - size
        change[taken[-1][1]] += given
        if any(self.fill[k] + x > self.capacity for k, x in change.items()):
            return False
        if sum(x * (2 * self.fill[k] + x) for k, x in change.items()) <= 0:
            return False
        for item, d in taken:
            self.withdraw(item)
            self.bins[d].remove(item)
            self.bins[b].append(item)
        for item in give:
            self.bins[b].remove(item)
            self.bins[taken[-1][1]].append(item)
            self.offer(item, taken[-1][1])
        for k, x in change.items():
            self.fill[k] += x
        return True

    def improve(self, b: int) -> bool:
        """Try the changes of bin b in the order of what they add to it: a move, one for one,
        two for one, one for two. The first that helps is made."""
        gap = self.capacity - self.fill[b]
        lengths, own = self.lengths, self.bins[b]
        options: list[tuple[int, list[int], list[int]]] = []

        def offer(gain: int, give: list[int], sizes: list[int]) -> bool:
            if gain > 0:
                options.append((gain, give, sizes))
            return gain == gap and self.apply(b, give, sizes)

        y = self.largest(gap)
        if offer(y, [], [y]):
            return True
        distinct = list({lengths[i]: i for i in own}.values())
        for item in distinct:
            x = lengths[item]
            y = self.largest(x + gap)
            if offer(y - x, [item], [y]):
                return True
        for item in distinct:
            if (two := self.pair(lengths[item] + gap)) and offer(gap, [item], list(two)):
                return True
        alike: dict[int, list[int]] = {}
        for item in own:
            alike.setdefault(lengths[item], []).append(item)
        sums = {2 * x: items[:2] for x, items in alike.items() if len(items) > 1}
        for i, first in enumerate(distinct):
            for second in distinct[i + 1 :]:
                sums.setdefault(lengths[first] + lengths[second], [first, second])
        for x, both in sums.items():
            y = self.largest(x + gap)
            if offer(y - x, both, [y]):
                return True
        if (two := self.pair(gap)) and offer(gap, [], list(two)):
            return True
        return any(self.apply(b, give, sizes) for _, give, sizes in sorted(options, key=lambda o: -o[0]))


def swap_search(lengths: list[int], bins: list[list[int]], capacity: int, passes: int | None = None) -> list[list[int]]:
    """Raise the sum of squared fills by moves and swaps between underfull bins, until none helps.

    Bins are filled from the fullest on, out of emptier ones, whose items are the donors; the
    emptiest bins end up without items and go. Each change raises the sum, so rounds end; ``passes`` bounds their number, if given.
    """
    total = sum(lengths)
    least = -(-total // capacity)
    for _ in count() if passes is None else range(passes):
        if len(bins) <= least:
            break
        search = _Search(lengths, bins, capacity)
        order = sorted((b for b in range(len(bins)) if search.fill[b] < capacity), key=lambda b: -search.fill[b])
        for b in order:
            for item in bins[b]:
                search.offer(item, b)
        changed = False
        for b in order:
            for item in bins[b]:
                search.withdraw(item)
            while bins[b] and search.fill[b] < capacity and search.improve(b):
                changed = True
        bins = [b for b in bins if b]
        if not changed:
            break
    return bins


def pack(pieces: DataFrame, capacity: int = 2048, group_size: int = 40_000) -> DataFrame:
    """Place pieces of at most ``capacity`` tokens into sequences; adds ``sequence_id, offset``.

    Pieces are dealt at random, row by row, into groups of about ``group_size``, and every
    group is packed by itself: a cheap first packing, then local search until nothing helps.
    The pieces of sequences that stay underfull, or if those are over half of all pieces, of
    each group's emptiest sequence, are dealt again into fewer groups, until they are one. No
    group grows with the input, whatever repeats. Rows that repeat (doc_id, piece) are packed once each, and null ids are ids
    like any other. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "pack")
    columns = [f.split()[0] for f in PLACED.split(", ")]

    def packed(rows: DataFrame, groups: int, base: int) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            group = table.column("group")[0].as_py() + base
            table = table.drop_columns(["group"]).sort_by([("doc_id", "ascending"), ("piece", "ascending")])
            lengths = table.column("length").to_numpy()
            part = np.flatnonzero(lengths < capacity)
            own = lengths[part].tolist()
            bins = packed_bins(own, capacity)
            sequence, offset, room = (np.zeros(len(lengths), np.int64) for _ in range(3))
            for b, items in enumerate(bins):
                sizes = lengths[part[items]]
                sequence[part[items]], offset[part[items]] = b, np.cumsum(sizes) - sizes
                room[part[items]] = capacity - sizes.sum()
            whole = np.flatnonzero(lengths >= capacity)
            sequence[whole] = len(bins) + np.arange(len(whole))
            emptiest = (room > 0) & (sequence == sequence[np.argmax(room)])
            for name, values in (("sequence_id", (group << 32) + sequence), ("offset", offset), ("underfull", room > 0), ("emptiest", emptiest)):
                table = table.append_column(name, pa.array(values))
            return table

        dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        return dealt.groupBy("group").applyInArrow(run, PLACED + ", underfull boolean, emptiest boolean")

    n, base, rest, done, most = pieces.count(), 0, pieces, None, None
    while True:
        groups = max(1, min(-(-n // group_size), most or 1 << 62))
        now = packed(rest, groups, base)
        if groups == 1:
            now = now.select(*columns)
            return now if done is None else done.unionByName(now)
        now = scratch.save(now)
        left = "underfull" if 2 * now.where("underfull").count() <= n else "emptiest"
        kept = now.where(f"NOT {left}").select(*columns)
        done = kept if done is None else done.unionByName(kept)
        rest = now.where(left).select(*columns[:5])
        n, base, most = rest.count(), base + groups, groups // 2


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenise, cut and pack: one row for each piece, ``PLACED``.

    The digest of each piece is written to the shared folder once; token ids are not moved.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.save(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col)), capacity)
