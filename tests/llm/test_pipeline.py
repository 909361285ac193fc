"""The stages of the pipeline, one after the other, against plain Python on a small table."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm.language import identify

P = pytest.importorskip("public_tokenizers")


def corpus(seed=0):
    rng = random.Random(seed)
    letters = {"aa": "abcdeé", "bb": "fghijß"}
    word = lambda x: "".join(rng.choice(letters[x]) for _ in range(rng.randrange(1, 8)))
    rows = []
    shared = {x: " ".join(word(x) for _ in range(70)) for x in letters}
    for i in range(90):
        lang = rng.choice(list(letters))
        parts = [word(lang) for _ in range(rng.randrange(20, 120))]
        if i % 4 == 0:
            at = rng.randrange(len(parts))
            parts[at:at] = shared[lang].split()
        rows.append((" ".join(parts), lang))
    for i in range(0, 30, 3):
        rows.append(rows[i])
        own = rows[i][0].split()
        own[len(own) // 2] = word(rows[i][1])
        rows.append((" ".join(own), rows[i][1]))
    rows += [("123 456", None), (None, "aa"), ("", None), ("!!", "bb")]
    rng.shuffle(rows)
    return [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(rows)]


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def one_of_each(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}
    for _ in sets:
        changed = False
        for i in sets:
            for j in sets:
                if i < j and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and parent[i] != parent[j]:
                    parent[i] = parent[j] = min(parent[i], parent[j])
                    changed = True
        if not changed:
            break
    return [(i, t) for i, t in docs if parent[i] == i]


def without_later_passages(docs, size=200):
    seen, out = set(), []
    for i, t in docs:
        body = t.encode()
        cover = np.zeros(len(body) + 1, int)
        for j in range(len(body) - size + 1):
            w = body[j : j + size]
            if w in seen:
                cover[j] += 1
                cover[j + size] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        chars, at = [], 0
        for c in t:
            n = len(c.encode())
            # A character goes only if all its bytes lie in a removed span.
            if not gone[at : at + n].all():
                chars.append(c)
            at += n
        out.append((i, "".join(chars)))
    return out


def test_pipeline(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    known = {r.doc_id for r in identify(df).collect() if r.lang_pred != "und" and r.score >= 0.3}
    assert known == {r[0] for r in rows if any(map(str.isalpha, r[1] or ""))}
    first = {}
    for r in rows:
        if r[0] in known:
            first.setdefault(r[1], r[0])
    docs = sorted((i, t) for t, i in first.items())
    single = one_of_each(docs)
    left = without_later_passages(single)
    assert len(docs) < len(known) and len(single) < len(docs) and sum(len(t) for _, t in left) < sum(len(t) for _, t in single) - 2000

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in left}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(expected)
    for i, ids in expected.items():
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [
            (a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for a in range(0, len(ids), 2048)
        ]
    fill = defaultdict(int)
    for r in found:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(map(len, expected.values())) // 2048) + 1


def test_stages_return_the_columns_of_documents(spark):
    df = spark.createDataFrame(corpus(1)[:20], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns
        assert stage(spark, df.where("false"), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, df.where("false"), "").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]


def test_stages_judge_rows_whatever_their_ids(spark):
    """Repeated and null ids, fully repeated rows and clashing columns through every stage."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, c, d = text(60), text(60), text(60), text(60)
    passage = text(80)
    rows = [(3, a), (5, a), (5, b), (5, b), (None, a), (None, c), (None, c), (7, c + " end"), (8, d + " " + passage), (8, passage + " " + b), (9, None), (9, "12 !!"), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({x: F.lit(1) for x in ("_doc", "_text", "_row", "_id", "id", "_md5", "_hash", "component")})
    stages = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        made = stages[name](spark, docs, "")
        assert made.columns == df.columns and made.where("_doc <> 1 OR _row <> 1 OR _id <> 1 OR id <> 1").count() == 0
        return spark.createDataFrame(made.collect(), df.schema)

    kept = lambda docs: sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    docs = after("language_id", df)
    assert kept(docs) == sorted([(i, t) for i, t in rows if any(map(str.isalpha, t or ""))], key=repr)
    docs = after("exact_dedup", docs)
    assert kept(docs) == sorted([(3, a), (5, b), (None, c), (7, c + " end"), (8, d + " " + passage), (8, passage + " " + b)], key=repr)
    docs = after("ngram_jaccard_join", docs)
    assert kept(docs) == sorted([(3, a), (5, b), (7, c + " end"), (8, d + " " + passage), (8, passage + " " + b)], key=repr)
    docs = after("suffix_array_dedup", docs)
    left = kept(docs)
    assert len(left) == 5 and {(3, a), (5, b), (7, c + " end")} <= set(left)
    shorter = [t for i, t in left if i == 8]
    assert sum(map(len, shorter)) <= len(d) + len(passage) + 30 and all(r.n_chars == len(r.text) for r in docs.collect())
    packed = stages["best_fit_packing"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in packed) == [3, 5, 7, 8, 8]
