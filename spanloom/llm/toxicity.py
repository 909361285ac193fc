"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembering, frugal, is_held_out, text_or_empty
from .features import Adam, Bags, fit, labelled_words, logistic, word_blocks

WIDTH = 1 << 18
SIZES = (3, 4, 5)
OUT = "doc_id long, held_out boolean, score double, predicted int"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def word_grams(word: str) -> list[int]:
    """Hashed character n-grams of a lower-case word between edge marks, each once."""
    core = f"<{_EDGE.sub('', word)}>"
    if len(core) == 2:
        return []
    return list({zlib.crc32(core[i : i + n].encode()) % WIDTH for n in SIZES for i in range(len(core) - n + 1)})


def train(
    rows: Iterable[tuple[int, list[str], list[int]]],
    rounds: int = 150,
    smooth: float = 1.0,
    penalty: float = 1e-3,
    seen: int = 3,
) -> list[np.ndarray]:
    """Weights by hashed n-gram, the ratio included, and the bias; classes weigh the same."""
    bag = Bags(word_grams, WIDTH)
    labels = []
    for label, words, _ in rows:
        own = {w.lower() for w in words}
        bag.add(own, repeat(1.0, len(own)))
        labels.append(label)
    bag.close()
    y = np.array(labels)
    if not {0, 1} <= set(labels):
        return [np.zeros(WIDTH), np.zeros(1)]
    positive, negative = bag.back((y == 1).astype(float)), bag.back((y == 0).astype(float))
    p, q = (positive + smooth) / (positive + smooth).sum(), (negative + smooth) / (negative + smooth).sum()
    # N-grams of fewer different words than this, counted over documents, tell documents apart, not classes.
    ratio = np.where(positive + negative >= seen, np.log(p / q), 0.0)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    beta, bias = np.zeros(WIDTH), 0.0
    adam = Adam(WIDTH + 1, 0.02)
    for _ in range(rounds):
        error = share * (logistic(bag.scores(ratio * beta) + bias) - y)
        step = adam.step(np.append(ratio * bag.back(error) + penalty * beta, error.sum()))
        beta -= step[:-1]
        bias -= step[-1]
    return [ratio * beta, np.array([bias])]


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: Column | None = None,
    per_class: int = 4000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``.

    The model learns from at most ``per_class`` labelled documents of each class outside the
    held-out fold (see ``labelled_words``). A feature is a hashed character n-gram of 3 to 5,
    its value the number of different words of the text that hold it; values are scaled by
    the log ratio of the n-gram's smoothed shares in the two classes, and a logistic
    regression is fitted to the scaled values. Only text enters a score.

    Null and empty texts have no features and get the bias alone. Without labels of both
    classes every score is that of an untrained model, 0.5. Repeated rows repeat their score;
    other columns are ignored; a very long text is read in blocks.
    """
    label = F.col("toxic") if label is None else label
    weights, (bias,) = fit(labelled_words(docs, labels, label, per_class, id_col, text_col), train)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), float(bias)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = model.value
        table = table.tolist()
        memo = Remembering(lambda w: sum([table[g] for g in word_grams(w)]))
        get = memo.__getitem__
        for batch in batches:
            z = [
                base + sum(map(get, set(chain.from_iterable(word_blocks(t.as_py().lower())))))
                for t in batch.column(2)
            ]
            score = logistic(np.array(z, np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text")
    )
    return rows.mapInArrow(frugal(run), OUT)
