"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .language import identify
from .lm_scoring import score_documents
from .packing import pack_documents
from .quality import quality
from .suffix_dedup import suffix_dedup
from .topk_search import topk_search
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document between models of good texts and of all texts."""
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score_documents(_table(spark, sf_dir, "documents"), good)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text by the ranks of the public byte-level tokenizer."""
    import public_tokenizers

    return byte_bpe(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 3-word shingle sets with a similarity of 0.9, and each document's number of links."""
    return jaccard_components(_table(spark, sf_dir, "documents"), words=3, num=90, den=100, links=True)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language mixture of every text, learnt outside the held-out fold."""
    return identify(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every text by the labels of quality and toxicity."""
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every vector whose id is divisible by 100."""
    return topk_search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens of the public word tokenizer."""
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every text, learnt outside the held-out fold."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document; the largest id stays."""
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the strings of 400 bytes that occur again; all copies go.

    ``n_repeated`` also counts passages from 200 bytes on, which stay.
    """
    return suffix_dedup(_table(spark, sf_dir, "documents"), min_bytes=400, later=False, report_bytes=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_byte_bpe,
        op3_ngram_jaccard_join,
        op4_language_id,
        op5_quality_classifier,
        op6_topk_search,
        op7_best_fit_packing,
        op8_toxicity,
        op9_exact_dedup,
        op10_suffix_array_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
            FROM split
        ), tokens AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
        ), shared AS (
            SELECT a.doc_id AS i, b.doc_id AS j, a.n AS n, b.n AS m, count(*) AS c
            FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT i, j FROM shared WHERE 100 * c >= 90 * (n + m - c)
        ), both_ways AS (
            SELECT i, j FROM links UNION ALL SELECT j, i FROM links
        ), reach(i, j) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.i, b.j FROM reach r JOIN both_ways b ON r.j = b.i
        )
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.j) AS component_id,
               (SELECT count(*) FROM both_ways b WHERE b.i = s.doc_id) AS n_links
        FROM sets s JOIN reach r ON s.doc_id = r.i GROUP BY ALL
    """,
    "op10_suffix_array_dedup": """
        WITH bytes AS (
            SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
        ), starts AS (
            SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM bytes WHERE octet_length(b) >= 400
        ), windows AS (
            SELECT doc_id, i, md5(hex(b[i:i + 399])) AS h FROM starts
        ), again AS (
            SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
        ), opened AS (
            SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS o FROM again
        ), islands AS (
            SELECT doc_id, i, sum(o) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM opened
        ), spans AS (
            SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM islands GROUP BY doc_id, k
        ), cuts AS (
            SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed FROM spans GROUP BY doc_id
        ), kept AS (
            SELECT b.doc_id, coalesce(lag(s.z) OVER (PARTITION BY b.doc_id ORDER BY s.a), 1) AS f, s.a - 1 AS t, b.b
            FROM bytes b JOIN spans s ON b.doc_id = s.doc_id
            UNION ALL
            SELECT b.doc_id, coalesce(max(s.z), 1), octet_length(any_value(b.b)), any_value(b.b) FROM bytes b LEFT JOIN spans s ON b.doc_id = s.doc_id GROUP BY b.doc_id
        ), text AS (
            SELECT doc_id, string_agg(CASE WHEN t >= f THEN hex(b[f:t]) ELSE '' END, '' ORDER BY f) AS x FROM kept GROUP BY doc_id
        )
        , short AS (
            SELECT doc_id, i, md5(hex(b[i:i + 199])) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM bytes WHERE octet_length(b) >= 200)
        ), shown AS (
            SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 200) AS j FROM short
            WHERE h IN (SELECT h FROM short GROUP BY h HAVING count(*) > 1)
        ), passages AS (
            SELECT doc_id, sum(least(j - i, 200)) AS n FROM shown GROUP BY doc_id
        )
        SELECT b.doc_id, octet_length(b.b) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
               sha256(unhex(t.x)) AS kept_sha256, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeated
        FROM bytes b JOIN text t ON b.doc_id = t.doc_id LEFT JOIN cuts c ON b.doc_id = c.doc_id LEFT JOIN passages p ON b.doc_id = p.doc_id
    """,
    "op6_topk_search": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op9_exact_dedup": """
        WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM base GROUP BY t)
        SELECT b.doc_id, g.keep_id, g.group_size, b.doc_id = g.keep_id AS kept, sha256(b.t) AS text_sha256
        FROM base b JOIN groups g ON b.t = g.t
    """,
}
