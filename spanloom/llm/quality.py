"""Quality by ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembering, frugal, is_held_out, text_or_empty
from .features import AGAIN, Adam, Bags, damped, fit, labelled_words, logistic, word_counts

WIDTH = 1 << 17
OUT = (
    "doc_id long, held_out boolean, n_words long, expected_grade double, tail_probability double, selected boolean,"
    " tail_probabilities array<double>"
)
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"\d+")


def word_features(word: str) -> list[int]:
    """A word's hashed lower-case form and its shape (runs of capitals, letters and digits)."""
    if word == AGAIN:
        return [zlib.crc32(b"again") % WIDTH]
    shape = _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", word)))[:12]
    return [zlib.crc32(b"w" + word.lower().encode()) % WIDTH, zlib.crc32(b"s" + shape.encode()) % WIDTH]


def train(
    rows: Iterable[tuple[int, list[str], list[int]]], grades: int, rounds: int = 200, penalty: float = 1e-5
) -> list[np.ndarray]:
    """Shared weights and ascending thresholds of P(grade > k) = logistic(f - threshold_k)."""
    bag = Bags(word_features, WIDTH)
    labels = []
    for label, words, counts in rows:
        if 0 <= label < grades:
            bag.add(words, damped(counts))
            labels.append(label)
    bag.close()
    y = np.array(labels)
    if len(set(labels)) < 2:
        share = np.arange(1, grades) / grades
        return [np.zeros(WIDTH), np.log(share / (1 - share))]
    weights = np.zeros(WIDTH)
    # First threshold, then the logarithms of the gaps above it: thresholds stay in order.
    above = np.array([np.clip((y > k).mean(), 0.01, 0.99) for k in range(grades - 1)])
    cuts = np.log((1 - above) / above)
    free = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))])
    adam = Adam(WIDTH + grades - 1, 0.3)
    for _ in range(rounds):
        gaps = np.exp(free[1:])
        cuts = np.cumsum(np.concatenate([free[:1], gaps]))
        f = bag.scores(weights)
        low = np.concatenate([[-np.inf], cuts])[y][:, None]
        high = np.concatenate([cuts, [np.inf]])[y][:, None]
        p_low, p_high = (logistic(x[:, 0] - f) for x in (low, high))  # P(grade < y), P(grade <= y)
        p_low[y == 0], p_high[y == grades - 1] = 0, 1
        mass = np.maximum(p_high - p_low, 1e-9)
        slope_low, slope_high = p_low * (1 - p_low), p_high * (1 - p_high)
        by_f = (slope_high - slope_low) / mass / len(y)
        by_cut = np.zeros(grades - 1)
        np.add.at(by_cut, y[y < grades - 1], -(slope_high / mass)[y < grades - 1] / len(y))
        np.add.at(by_cut, y[y > 0] - 1, (slope_low / mass)[y > 0] / len(y))
        tails = np.cumsum(by_cut[::-1])[::-1]
        by_free = np.concatenate([tails[:1], tails[1:] * gaps])
        step = adam.step(np.concatenate([bag.back(by_f) + penalty * weights, by_free]))
        weights -= step[:WIDTH]
        free -= step[WIDTH:]
    return [weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))]


def quality(
    docs: DataFrame,
    labels: DataFrame,
    grade: Column | None = None,
    grades: int = 3,
    select_from: int = 1,
    least_probability: float = 0.5,
    per_grade: int = 4000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Expected grade and tail probability of every whole text, and whether it is selected.

    ``grade`` is a rating 0 .. ``grades`` - 1 over the columns of ``labels``; by default 0 for
    low quality, 1 for good but toxic, 2 for good text. All grades share one vector of weights
    over hashed words, word shapes and immediate repetition, each with the logarithm of its
    count in the text, to unit length; ordered thresholds cut the score into grades.
    ``tail_probabilities`` are P(grade >= 1), P(grade >= 2), ..; ``tail_probability`` is the one
    of ``select_from``, and a text is selected from ``least_probability`` on. The model learns
    from at most ``per_grade`` documents of each grade outside the held-out fold.

    Null and empty texts score 0 before the thresholds. With fewer than two grades among the
    labels nothing is learnt, and the probabilities are those of equal grades. Repeated rows
    repeat their result; other columns are ignored; a very long text is read in blocks.
    """
    if grade is None:
        grade = F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).when(F.col("quality") == 1, 2)
    sample = labelled_words(docs, labels, grade, per_grade, id_col, text_col, again=True)
    weights, cuts = fit(sample, lambda rows: train(rows, grades))
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = model.value
        table = table.tolist()
        memo = Remembering(lambda w: sum([table[g] for g in word_features(w)]))
        get = memo.__getitem__
        for batch in batches:
            total, count = [], []
            for text in batch.column(2):
                own = word_counts(text.as_py(), again=True)
                total.append(sum(map(mul, damped(own.values()), map(get, own))))
                count.append(own.total() - own[AGAIN])
            above = logistic(np.array(total, np.float64)[:, None] - at[None, :])
            tail = above[:, select_from - 1] if select_from else np.ones(len(total))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(count, pa.int64()),
                    pa.array(above.sum(1)),
                    pa.array(tail),
                    pa.array(tail >= least_probability),
                    pa.array(list(above), pa.list_(pa.float64())),
                ],
                names=["doc_id", "held_out", "n_words", "expected_grade", "tail_probability", "selected", "tail_probabilities"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text")
    )
    return rows.mapInArrow(frugal(run), OUT)
