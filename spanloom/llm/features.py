"""Words of texts, labelled samples and sparse linear training shared by the classifiers."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from math import log1p, sqrt
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, is_held_out, text_or_empty

_SPACE = re.compile(r"\s")


def word_blocks(text: str, most: int = 1_000_000) -> Iterator[list[str]]:
    """The words of a text, split at white space; a very long text in blocks of about ``most`` characters."""
    at = 0
    while len(text) - at > most:
        gap = _SPACE.search(text, at + most)
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end
    yield (text[at:] if at else text).split()


#: Stands for a word that follows itself.
AGAIN = "\0again"


def word_counts(text: str, again: bool = False) -> Counter:
    """How often each word of a text occurs, and with ``again`` how often a word follows itself (``AGAIN``)."""
    counts: Counter = Counter()
    last = None
    for words in word_blocks(text):
        counts.update(words)
        if again and words:
            n = sum(map(eq, words, words[1:])) + (words[0] == last)
            if n:
                counts[AGAIN] += n
            last = words[-1]
    return counts


def damped(counts: Iterable[int]) -> list[float]:
    """Logarithms of counts, to unit length: a word that matters is not lost among many others."""
    values = [log1p(c) for c in counts]
    length = sqrt(sum(v * v for v in values)) or 1.0
    return [v / length for v in values]


#: Sampled ids up to this number are broadcast (15 MB); more, of very many labels, are joined by a shuffle.
BROADCAST_IDS = 200_000


def label_sizes(rows: DataFrame, label: str) -> dict:
    """The number of rows of each label. Labels are few: they are collected."""
    return {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def sample_hint(sizes: dict, most: int) -> str:
    """How a sample of ``most`` rows of each label at most is joined."""
    return "broadcast" if sum(min(n, most) for n in sizes.values()) <= BROADCAST_IDS else "merge"


def hashed_sample(rows: DataFrame, label: str, id_: str, most: int, sizes: dict | None = None) -> DataFrame:
    """The ``most`` rows of each label with the smallest hash of the id, ties by id.

    A cut of the hash's range, from the number of rows of each label, leaves little more than
    that before rows of a label meet, however frequent the label is.
    """
    sizes = label_sizes(rows, label) if sizes is None else sizes
    ample = most + 20 * most**0.5 + 100
    cuts = [F.lit(x) for k, n in sizes.items() if k is not None for x in (k, min(1.0, ample / n))]
    if not cuts:
        return rows.where("false")
    place = (F.xxhash64(id_).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    near = rows.where(place <= F.create_map(*cuts)[F.col(label)])
    first = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(id_), id_))
    return near.withColumn("_n", first).where(F.col("_n") <= most).drop("_n")


def labelled_words(
    docs: DataFrame,
    labels: DataFrame,
    label: Column,
    per_class: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    again: bool = False,
) -> DataFrame:
    """``label, words, counts`` of a sample of labelled documents; ``again`` as in ``word_counts``.

    At most ``per_class`` documents of each label value are taken, those with the smallest
    hash of the id, and never one of the held-out fold; that bounds the sample, whose ids are
    broadcast if there are few enough labels. A label that repeats for an id counts once, the largest.
    """
    bounded_batches(docs.sparkSession)
    own = (
        labels.select(F.col(label_id_col).alias("_id"), label.cast("int").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~is_held_out("_id"))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    sizes = label_sizes(own, "_label")
    sample = hashed_sample(own, "_label", "_id", per_class, sizes)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                words, counts = [], []
                for text in part.column(0).to_pylist():
                    c = word_counts(text, again)
                    words.append(list(c))
                    counts.append(list(c.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                    names=["label", "words", "counts"],
                )

    return (
        rows.join(sample.hint(sample_hint(sizes, per_class)), "_id")
        .select("_text", "_label")
        .mapInArrow(frugal(count), "label int, words array<string>, counts array<long>")
    )


def fit(sample: DataFrame, train: Callable[[Iterator[tuple[int, list[str], list[int]]]], list[np.ndarray]]) -> list[np.ndarray]:
    """Run ``train`` over the bounded sample in one task of an executor; returns its arrays.

    The model is small, and the sample never reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (label.as_py(), words.as_py(), counts.as_py())
            for batch in batches
            for label, words, counts in zip(*batch.columns, strict=True)
        )
        made = [np.asarray(x, np.float64) for x in train(rows)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(made)), pa.int32()), pa.array([x.tobytes() for x in made], pa.binary())], names=["k", "data"]
        )

    found = sample.repartition(1).mapInArrow(frugal(run), "k int, data binary").collect()
    return [np.frombuffer(r["data"], np.float64) for r in sorted(found, key=lambda r: r["k"])]


class Bags:
    """Documents as sums of words, words as sums of hashed features: a two-step sparse matrix."""

    def __init__(self, features: Callable[[str], list[int]], width: int):
        self.features, self.width = features, width
        self.docs = 0
        self._index: dict[str, int] = {}
        self._doc, self._word, self._value = array("i"), array("i"), array("d")
        self._of_word, self._feature = array("i"), array("i")

    def add(self, words: Iterable[str], values: Iterable[float]) -> None:
        """One more document."""
        for word, value in zip(words, values, strict=True):
            at = self._index.get(word)
            if at is None:
                at = self._index[word] = len(self._index)
                own = self.features(word)
                self._feature.extend(own)
                self._of_word.extend([at] * len(own))
            self._doc.append(self.docs)
            self._word.append(at)
            self._value.append(value)
        self.docs += 1

    def close(self) -> None:
        """No more documents come; the words themselves are forgotten."""
        self.words = len(self._index)
        self._index.clear()
        self.doc, self.word = np.frombuffer(self._doc, np.int32), np.frombuffer(self._word, np.int32)
        self.value = np.frombuffer(self._value, np.float64)
        self.of_word, self.feature = np.frombuffer(self._of_word, np.int32), np.frombuffer(self._feature, np.int32)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The matrix times a vector of feature weights."""
        by_word = np.bincount(self.of_word, weights[self.feature], self.words)
        return np.bincount(self.doc, self.value * by_word[self.word], self.docs)

    def back(self, errors: np.ndarray) -> np.ndarray:
        """The transposed matrix times a vector of document errors."""
        by_word = np.bincount(self.word, self.value * errors[self.doc], self.words)
        return np.bincount(self.feature, by_word[self.of_word], self.width)


class Adam:
    """First-order steps with moment estimates (Kingma and Ba, 2015), over one flat vector."""

    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient**2 - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
