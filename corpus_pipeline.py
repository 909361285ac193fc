"""The corpus pipeline: language ID, exact and near dedup, repeated passages, packing.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir), with ``docs`` what the
stage before it kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import Scratch
from spanloom.llm.exact_dedup import drop_copies
from spanloom.llm.jaccard_join import keep_one_of_each
from spanloom.llm.language import keep_identified
from spanloom.llm.packing import pack_documents
from spanloom.llm.suffix_dedup import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which some language is found; those without letters go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of equal texts."""
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of near copies (5 words, 0.8)."""
    return keep_one_of_each(docs, words=5, num=8, den=10)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later copies of passages of 200 bytes or more from the texts; the first copy stays."""
    return without_repeats(docs, min_bytes=200, later=True, length_col="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the tokens of all documents into sequences of 2048."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, token ids and the local search of the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.keep_only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
