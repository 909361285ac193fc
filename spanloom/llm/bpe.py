"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

The tree over the byte positions of a piece stores in each node the smallest pair rank
below it, and a descent that prefers the left child finds the leftmost smallest pair. A
merge touches the leaves of the pair and of its live neighbours, each by a point update of
logarithmic depth. Short pieces run through their trees side by side in numpy, long ones
one at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, text_or_empty

NONE = np.int32(2**31 - 1)
LONGEST_SIDE_BY_SIDE = 64
CACHED_PIECES = 400_000
PIECES_AT_ONCE = 200_000

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file that holds a base64 token and its rank in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class BytePairCodec:
    """Encodes and decodes pieces by the ranks; all 256 single bytes must have one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_ranks = np.array([pairs.get(key, NONE) for key in self.pair_keys.tolist()], np.int32)
        self.cache: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def _merge_side_by_side(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of at most ``size`` bytes, ``size`` a power of two: a row of trees each."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.zeros((n, size), np.uint8)
        raw[np.arange(size) < length[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.byte_id[raw]
        ids[np.arange(size) >= length[:, None]] = -1
        following = np.broadcast_to(np.arange(1, size + 1), (n, size)).copy()
        following[np.arange(n), length - 1] = size
        before = np.broadcast_to(np.arange(-1, size - 1), (n, size)).copy()
        tree = np.full((n, 2 * size), NONE, np.int32)
        if size > 1:
            live = np.arange(1, size) < length[:, None]
            tree[:, size : 2 * size - 1][live] = self._rank(ids[:, :-1][live], ids[:, 1:][live])
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        depth = size.bit_length() - 1
        row = np.flatnonzero(tree[:, 1] != NONE) if size > 1 else np.empty(0, np.int64)
        while len(row):
            node = np.ones(len(row), np.int64)
            for _ in range(depth):
                node = 2 * node + (tree[row, 2 * node] > tree[row, 2 * node + 1])
            merged = tree[row, node]
            at = node - size
            gone = following[row, at]
            after = following[row, gone]
            ids[row, at] = merged
            ids[row, gone] = -1
            following[row, at] = after
            tree[row, size + gone] = NONE
            tree[row, size + at] = NONE
            inside = after < size
            r, a, b = row[inside], at[inside], after[inside]
            before[r, b] = a
            tree[r, size + a] = self._rank(ids[r, a], ids[r, b])
            prior = before[row, at]
            first = prior < 0
            r, a, b = row[~first], prior[~first], at[~first]
            tree[r, size + a] = self._rank(ids[r, a], ids[r, b])
            for leaf in (size + gone, size + at, size + np.where(first, at, prior)):
                for _ in range(depth):
                    leaf = leaf >> 1
                    tree[row, leaf] = np.minimum(tree[row, 2 * leaf], tree[row, 2 * leaf + 1])
            row = row[tree[row, 1] != NONE]
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_alone(self, piece: bytes) -> bytes:
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        none = int(NONE)
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        get = self.pairs.get
        for i in range(n - 1):
            tree[size + i] = get(ids[i] << 32 | ids[i + 1], none)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(leaf: int, value: int) -> None:
            tree[leaf] = value
            leaf >>= 1
            while leaf:
                small = min(tree[2 * leaf], tree[2 * leaf + 1])
                if tree[leaf] == small:
                    break
                tree[leaf] = small
                leaf >>= 1

        while tree[1] != none:
            node = 1
            while node < size:
                node = 2 * node + (tree[2 * node] > tree[2 * node + 1])
            at = node - size
            gone = following[at]
            after = following[gone]
            ids[at], ids[gone] = tree[node], -1
            following[at] = after
            update(size + gone, none)
            if after < n:
                before[after] = at
                update(node, get(ids[at] << 32 | ids[after], none))
            else:
                update(node, none)
            if before[at] >= 0:
                update(size + before[at], get(ids[before[at]] << 32 | ids[at], none))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > LONGEST_SIDE_BY_SIDE:
                out[i] = self._merge_alone(piece)
            elif piece:
                classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for size, members in classes.items():
            for lo in range(0, len(members), 20_000):
                part = members[lo : lo + 20_000]
                for i, ids in zip(part, self._merge_side_by_side([pieces[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of these pieces into the cache, which is emptied when it is full."""
        missing = list(pieces.difference(self.cache))
        if len(self.cache) + len(missing) > CACHED_PIECES:
            self.cache.clear()
            missing = list(pieces)
        self.cache.update(zip(missing, self.encode_pieces([p.encode() for p in missing]), strict=True))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[bytes, BytePairCodec] = {}


def codec(data: bytes) -> BytePairCodec:
    """The codec of a vocabulary file, built once in each Python worker."""
    key = hashlib.md5(data).digest()
    if key not in _CODECS:
        _CODECS[key] = BytePairCodec(read_ranks(data))
    return _CODECS[key]


def _blocks(find, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The pieces of each text, a very long text in several blocks."""
    for i, text in enumerate(texts):
        if len(text) < PIECES_AT_ONCE * 4:
            yield i, find.findall(text)
        else:
            matches = (m.group() for m in find.finditer(text))
            while block := list(islice(matches, PIECES_AT_ONCE)):
                yield i, block


def encoded(coder: BytePairCodec, pattern: str, texts: list[str]) -> Iterator[tuple[int, bytes]]:
    """The ids of each text; a very long text comes in several parts, each with the text's index."""
    import regex

    find = regex.compile(pattern)
    waiting: list[tuple[int, list[str]]] = []

    def flush():
        coder.learn(set().union(*(block for _, block in waiting)))
        get = coder.cache.__getitem__
        for i, block in waiting:
            yield i, b"".join(map(get, block))
        waiting.clear()

    n = 0
    for i, block in _blocks(find, texts):
        waiting.append((i, block))
        n += len(block)
        if n >= PIECES_AT_ONCE:
            yield from flush()
            n = 0
    yield from flush()


def byte_bpe(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False
) -> DataFrame:
    """Encode every whole text, decode the ids again, and digest both.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and with ``tokens`` also ``ids``
    (array of int) and ``decoded`` (binary). ``vocabulary`` is a file of base64 tokens and
    ranks, read by the driver and broadcast (its size is fixed); ``pattern`` splits a text
    into the pieces that are encoded separately. Null and empty texts have no tokens. Rows are
    treated one by one, so repeated rows repeat their result; other columns are ignored. A
    very long text is encoded block by block.
    """
    bounded_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                n = batch.num_rows
                sums = [hashlib.sha256() for _ in range(n)]
                plain = [hashlib.sha256() for _ in range(n)]
                count = [0] * n
                kept: list[list[bytes]] = [[] for _ in range(n)]
                text: list[list[bytes]] = [[] for _ in range(n)]
                for i, ids in encoded(coder, pattern, batch.column(1).to_pylist()):
                    sums[i].update(ids)
                    count[i] += len(ids) // 4
                    back = coder.decode(ids)
                    plain[i].update(back)
                    if tokens:
                        kept[i].append(ids)
                        text[i].append(back)
                columns = [
                    batch.column(0),
                    pa.array(count, pa.int64()),
                    pa.array([s.hexdigest() for s in sums]),
                    pa.array([s.hexdigest() for s in plain]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if tokens:
                    columns.append(pa.array([np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in kept], pa.list_(pa.int32())))
                    columns.append(pa.array([b"".join(x) for x in text], pa.binary()))
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = OUT + (", ids array<int>, decoded binary" if tokens else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), out)
