"""Language proportions of a text by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, is_held_out
from .features import hashed_sample, label_sizes, sample_hint, word_blocks

WIDTH = 1 << 15
SIZES = 4
CACHED_WORDS = 200_000
UNKNOWN = "und"
PREDICTION = "lang_pred string, score double, languages array<string>, shares array<double>"
ARROW_PREDICTION = pa.struct(
    [("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))]
)
#: Characters that one round of the EM holds; a text longer than ``LONG`` is counted by word first.
TEXT_AT_ONCE, LONG = 1_000_000, 1_000_000


class Grams:
    """Hashed character n-grams of 1 to 4 of many words at once, each lower-cased between edge marks."""

    def __init__(self, words: list[str]):
        marked = [f"<{w}>" for w in words]
        text = "".join(marked)
        lower = text.lower()
        if len(lower) != len(text):  # some letters grow
            marked = [w.lower() for w in marked]
            lower = "".join(marked)
        self.char = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.length = np.fromiter(map(len, marked), np.int64, len(marked))
        self.start = np.cumsum(self.length) - self.length
        kinds, of = np.unique(self.char, return_inverse=True)
        letter = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)[of] if len(kinds) else np.zeros(0, bool)
        self.has_letter = np.logical_or.reduceat(letter, self.start) if len(words) else np.zeros(0, bool)
        self.left = np.repeat(self.start + self.length, self.length) - np.arange(len(self.char))

    def sizes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size the positions that begin an n-gram, and its cell."""
        h = np.zeros(len(self.char), np.uint64)
        for n in range(1, SIZES + 1):
            h[: len(h) - n + 1] = h[: len(h) - n + 1] * np.uint64(0x100000001B3) + self.char[n - 1 :] + np.uint64(n)
            at = np.flatnonzero(self.left >= n)
            cell = (h[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (WIDTH.bit_length() - 1))
            yield at, cell.astype(np.int64)


def language_counts(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram counts over the training sample, summed by Spark."""
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    ids = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    sizes = label_sizes(ids, "_lang")
    sample = hashed_sample(ids, "_lang", "_id", per_language, sizes).select("_id").distinct()
    rows = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words.setdefault(lang, Counter())
                for block in word_blocks(text.as_py()):
                    own.update(block)
        for lang, own in words.items():
            grams, n = Grams(list(own)), np.array(list(own.values()))
            n = np.repeat(np.where(grams.has_letter, n, 0), grams.length)
            counts = np.zeros(WIDTH, np.int64)
            for at, cell in grams.sizes():
                np.add.at(counts, cell, n[at])
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used])],
                names=["lang", "gram", "n"],
            )

    found = (
        rows.join(sample.hint(sample_hint(sizes, per_language)), "_id")
        .select("lang", "text")
        .mapInArrow(frugal(count), "lang string, gram int, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    langs = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((len(langs), WIDTH))
    row = {lang: i for i, lang in enumerate(langs)}
    at = np.fromiter((row[x] for x in found.column("lang").to_pylist()), np.int64, found.num_rows)
    counts[at, found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return langs, counts


class Mixture:
    """Mixtures of the languages, fitted to many texts at once.

    A text is a run of rows: the likelihoods of a word under each language, scaled to a
    largest value of one, with the number of times the word counts.
    """

    def __init__(self, langs: int, steps: int = 6, most: int = 3, penalty: float = 1.0):
        self.langs, self.steps, self.most, self.penalty = langs, steps, min(most, langs), penalty

    def _fit(self, p: np.ndarray, n: np.ndarray, of: np.ndarray, starts: np.ndarray, mass: np.ndarray, share: np.ndarray, steps: int):
        for _ in range(steps):
            r = p * share[of]
            r *= (n / np.maximum(r.sum(1), 1e-30))[:, None]
            share = np.add.reduceat(r, starts, axis=0) / mass[:, None]
        like = np.log(np.maximum(np.einsum("ij,ij->i", p, share[of]), 1e-30)) * n
        return share, np.add.reduceat(like, starts)

    def infer(self, p: np.ndarray, n: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Proportions (texts x languages) of the set chosen by penalised likelihood; no text is empty.

        After a fit of all languages, the one, two, .. ``most`` languages with the largest
        proportions are fitted by themselves; each language beyond the first costs
        ``penalty`` times the logarithm of the number of words.
        """
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        of = np.repeat(np.arange(len(lengths)), lengths)
        mass = np.add.reduceat(n, starts)
        full, _ = self._fit(p, n, of, starts, mass, np.full((len(lengths), self.langs), 1 / self.langs, np.float32), self.steps)
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        best, chosen = np.full(len(lengths), -np.inf), np.zeros_like(full)
        for size in range(1, self.most + 1):
            share = np.where(rank < size, np.maximum(full, 1e-6), 0)
            share /= share.sum(1, keepdims=True)
            share, like = self._fit(p, n, of, starts, mass, share.astype(np.float32), 0 if size == 1 else 3)
            like = like - self.penalty * (size - 1) * np.log(mass + 1)
            better = like > best
            best = np.where(better, like, best)
            chosen[better] = share[better]
        return chosen


def language_column(model, text: Column) -> Column:
    """The inference as a column: struct of ``lang_pred, score, languages, shares``.

    ``model`` is a broadcast of languages and the table of n-gram log likelihoods.
    """

    def infer(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, table = model.value
        mixture = Mixture(max(1, len(names)))
        width = 4 * len(names)

        memo: dict[str, bytes] = {}

        def learn(words: set[str]) -> None:
            """The likelihoods of new words; none for a word without a letter."""
            missing = list(words.difference(memo))
            if len(memo) + len(missing) > CACHED_WORDS:
                memo.clear()
                missing = list(words)
            for lo in range(0, len(missing), 20_000):
                part = missing[lo : lo + 20_000]
                grams = Grams(part)
                s = np.zeros((len(grams.char), len(names)), np.float32)
                for at, cell in grams.sizes():
                    s[at] += table[cell]
                # The sizes of n-grams tell a letter several times over; their mean undoes that.
                s = np.add.reduceat(s, grams.start, axis=0) / SIZES
                p = np.exp(s - s.max(1, keepdims=True)).astype(np.float32)
                flat = p.tobytes()
                memo.update((w, flat[i * width : (i + 1) * width] if ok else b"") for i, (w, ok) in enumerate(zip(part, grams.has_letter.tolist(), strict=True)))

        get = memo.__getitem__

        def rows(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray | None]]:
            """The rows of each text, and how often each counts if that is not once."""
            split = [Counter(chain.from_iterable(word_blocks(t))) if t and len(t) > LONG else (t or "").split() for t in texts]
            learn(set().union(*split))
            for own in split:
                if isinstance(own, Counter):
                    found = [(get(w), n) for w, n in own.items()]
                    found = [x for x in found if x[0]]
                    yield b"".join(x[0] for x in found), np.array([x[1] for x in found], np.float32)
                else:
                    yield b"".join(map(get, own)), None

        def solve(waiting: list) -> list[dict]:
            out = [{"lang_pred": UNKNOWN, "score": 0.0, "languages": [], "shares": []} for _ in waiting]
            real = [i for i, (flat, _) in enumerate(waiting) if flat]
            if real:
                p = np.frombuffer(b"".join(waiting[i][0] for i in real), np.float32).reshape(-1, len(names))
                lengths = np.array([len(waiting[i][0]) // width for i in real])
                n = [np.ones(k, np.float32) if waiting[i][1] is None else waiting[i][1] for i, k in zip(real, lengths, strict=True)]
                share = mixture.infer(p, np.concatenate(n), lengths)
                order = np.argsort(-share, axis=1, kind="stable")
                for i, s, o in zip(real, share.tolist(), order.tolist(), strict=True):
                    own = [k for k in o if s[k] > 0]
                    parts = [min(1.0, s[k]) for k in own]
                    out[i] = {"lang_pred": names[own[0]], "score": parts[0], "languages": [names[k] for k in own], "shares": parts}
            return out

        for array in arrays:
            out: list[dict] = []
            texts, size = [], 0
            for text in array:
                texts.append(text.as_py() if names else None)
                size += len(texts[-1] or "")
                if size >= TEXT_AT_ONCE:
                    out += solve(list(rows(texts)))
                    texts, size = [], 0
            out += solve(list(rows(texts)))
            yield pa.array(out, ARROW_PREDICTION)

    def inferring(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from frugal(infer)(arrays)

    return F.arrow_udf(inferring, PREDICTION)(text)


def fitted(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str):
    """The broadcast model learnt from ``docs``."""
    langs, counts = language_counts(docs, per_language, id_col, text_col, lang_col)
    smooth = 0.5
    table = np.log((counts + smooth) / (counts + smooth).sum(1, keepdims=True)).T.astype(np.float32)
    return docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(table)))


def identify(
    docs: DataFrame,
    per_language: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_on: DataFrame | None = None,
) -> DataFrame:
    """The language of every whole text: ``doc_id, held_out, lang_pred, score, languages, shares``.

    Character n-grams of 1 to 4 give each word a likelihood under each language; EM finds the
    proportions of languages that explain a text's words best, and a penalised likelihood
    picks the set of languages. ``lang_pred`` is the one with the largest proportion (ties:
    first in alphabetical order) and ``score`` that proportion; ``languages`` and ``shares``
    hold the whole set, largest first.

    The models learn from at most ``per_language`` documents of each language, those with the
    smallest hash of the id, with a text and a language and outside the held-out fold, of
    ``train_on`` or else of ``docs``. A text that is null or has no letter is ``und`` with
    score 0 and no languages, as is every text when nothing can be learnt. Repeated rows
    repeat their result; other columns are ignored; a very long text is counted in blocks.
    """
    model = fitted(docs if train_on is None else train_on, per_language, id_col, text_col, lang_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(is_held_out(id_col), F.lit(False)).alias("held_out"),
        language_column(model, F.col(text_col)).alias("_found"),
    ).select("doc_id", "held_out", "_found.*")


def keep_identified(
    docs: DataFrame,
    per_language: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` whose text is not ``und``; all columns stay.

    Only null texts and texts without letters are rejected (all, when nothing can be learnt): a
    text in a language never learnt is kept under the nearest ones.
    """
    model = fitted(docs, per_language, id_col, text_col, lang_col)
    found = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), language_column(model, F.col(text_col)).alias("_found"))
    return found.where(F.col("_found.lang_pred") != UNKNOWN).select("_row.*")
