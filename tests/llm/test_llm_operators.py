"""Each operator against brute force, an exact round trip or held-out accuracy, on small tables."""

import hashlib
import random
import subprocess
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, exact_dedup, features, jaccard_join, language, lm_scoring, packing, quality, suffix_dedup, topk_search, toxicity
from spanloom.llm.common import Remembering, Scratch, is_held_out
from spanloom.llm.components import connected_components

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def awkward(df):
    """The table with columns whose names clash with those that operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("id", "_text", "_id", "token", "n", "key", "doc", "start", "component", "label", "words")})


ODD = [None, "", " ", "\n\t ", "a", "a b", "A  b", "É é 漢字 🙂", "x" * 3000, "the cat sat on the mat " * 400]


# --- exact dedup ---


@pytest.mark.parametrize("keep, pick", [("min", min), ("max", max)])
def test_exact_dedup(spark, keep, pick):
    texts = [*ODD, "a", "", "a b", "a", "b"]
    rows = exact_dedup.exact_dedup(awkward(documents(spark, texts)), keep=keep).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[texts[r.doc_id] or ""]
        expected = (pick(own), len(own), r.doc_id == pick(own), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == expected
    kept = exact_dedup.drop_copies(documents(spark, texts), keep=keep)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(pick(g) for g in groups.values())
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_exact_dedup_of_repeated_rows_and_of_none(spark):
    df = documents(spark, ["a", "a", "b"], [5, 5, 6])
    assert sorted((r.doc_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()) == [(5, 2, True), (5, 2, True), (6, 1, True)]
    assert exact_dedup.exact_dedup(df.where("false")).count() == 0


# --- byte BPE ---


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, reference):
    rng = random.Random(3)
    texts = [*ODD, "<|endoftext|>", "it's  what\r\n we'll 12345", "a" * 70_000]
    texts += ["".join(rng.choice("aabcé 漢\n1🙂thing ") for _ in range(rng.choice([3, 30, 300]))) for _ in range(60)]
    texts += ["".join(rng.choice("abth") for _ in range(n)) for n in (63, 64, 65, 66, 127, 129, 1000)]
    found = bpe.byte_bpe(awkward(documents(spark, texts)), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, tokens=True).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and bytes(r.decoded) == text.encode()


def test_bpe_of_repeated_and_null_ids(spark, reference):
    texts, ids = ["a b", "a b", "c", None, "c"], [1, 1, 1, None, None]
    found = bpe.byte_bpe(documents(spark, texts, ids), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    expected = [(i, len(reference.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in zip(ids, texts, strict=True)]
    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in found), key=repr) == sorted(expected, key=repr)
    assert bpe.byte_bpe(documents(spark, []), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_in_blocks(monkeypatch, reference):
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 7)
    coder = bpe.BytePairCodec(bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()))
    text = "the quick brown fox's 12 tails  \n " * 40
    parts = b"".join(ids for _, ids in bpe.encoded(coder, P.PATTERN, [text]))
    assert np.frombuffer(parts, "<u4").tolist() == reference.encode_ordinary(text) and coder.decode(parts) == text.encode()


# --- n-gram Jaccard join ---


def sets_of(texts, words):
    out = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()
    return out


def components_by_hand(sets, num, den):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and den * both >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def near_copies(seed, families=6, each=14, edits=6, length=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of"] * 8
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, length, length * 2]))]
        for _ in range(each):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                at = rng.randrange(len(own))
                rng.choice([lambda: own.__setitem__(at, rng.choice(vocabulary)), lambda: own.insert(at, rng.choice(vocabulary)), lambda: own.pop(at)])()
            texts.append(" ".join(own))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, words, num, den", [(1, 3, 90, 100), (2, 5, 8, 10), (3, 1, 7, 10)])
def test_jaccard_components(spark, seed, words, num, den):
    texts = [*ODD, "A", "the CAT sat on the mat", *near_copies(seed)]
    sets = sets_of(texts, words)
    expected = components_by_hand(sets, num, den)
    found = jaccard_join.jaccard_components(awkward(documents(spark, texts)), words, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(sets[i]), expected[i]) for i in sets}
    assert len(found) == len(texts) and len(set(expected.values())) < len(texts) - 20


@pytest.mark.parametrize("seed, words, num, den", [(1, 3, 90, 100), (3, 1, 7, 10)])
def test_jaccard_links_are_all_found(spark, monkeypatch, seed, words, num, den):
    monkeypatch.setattr(jaccard_join, "SETS_AT_ONCE", 7)  # so that components are dealt to several cells
    texts = [*ODD, "A", "a", *near_copies(seed, families=3, each=30, edits=3)]
    sets = sets_of(texts, words)
    first = {s: i for i, s in reversed(sets.items())}
    links = set()
    for i in first.values():
        for j in first.values():
            both = len(sets[i] & sets[j])
            if i < j and both and den * both >= num * len(sets[i] | sets[j]):
                links.add((i, j))
    assert len(links) > len(first)
    members, found = jaccard_join.jaccard_pairs(documents(spark, texts), words, num, den)
    found = [tuple(sorted((r.x, r.y))) for r in found.collect()]
    assert len(found) == len(links) and set(found) == links
    assert {r.id: r.member_of for r in members.collect()} == {i: first[s] for i, s in sets.items() if s}
    texts += texts[5:25] + texts[5:15]
    sets = sets_of(texts, words)
    similar = lambda a, b: den * len(a & b) >= num * len(a | b)
    degree = {i: sum(i != j and bool(s) and similar(s, t) for j, t in sets.items()) for i, s in sets.items()}
    rows = jaccard_join.jaccard_components(awkward(documents(spark, texts)), words, num, den, links=True).collect()
    expected = components_by_hand(sets, num, den)
    assert {r.doc_id: (r.component_id, r.n_links) for r in rows} == {i: (expected[i], degree[i]) for i in sets}


def test_jaccard_odd_tables(spark):
    texts, ids = ["a b c d", "a b c d", "x y z", None, "A b c d", "x y z", "q"], [7, 7, None, 3, 7, 9, None]
    df = documents(spark, texts, ids)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(df, 3, 9, 10, links=True).collect()), key=repr)
    assert found == sorted([(7, 2, 7, 2)] * 3 + [(None, 1, 9, 1), (3, 0, 3, 0), (9, 1, 9, 1), (None, 1, None, 0)], key=repr)
    assert jaccard_join.jaccard_components(df.where("false")).count() == 0
    assert jaccard_join.jaccard_components(df.where("false"), links=True).count() == 0
    kept = jaccard_join.keep_one_of_each(documents(spark, ["a b c d e f", "a b c d e f", "q", None, ""]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    kept = jaccard_join.keep_one_of_each(awkward(df), 3, 9, 10)
    assert kept.columns == awkward(df).columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=repr) == sorted([(7, "a b c d"), (9, "x y z"), (3, ""), (None, "q")], key=repr)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_drop_copies_judges_rows(spark, keep):
    rows = [(3, "a"), (5, "a"), (5, "b"), (5, "b"), (None, "a"), (None, "c"), (None, "c"), (2, ""), (1, None), (9, "")]
    df = awkward(documents(spark, [t for _, t in rows], [i for i, _ in rows]))
    kept = exact_dedup.drop_copies(df, keep=keep)
    assert kept.columns == df.columns and kept.schema["text"].dataType == df.schema["text"].dataType
    expected = [(3, "a"), (5, "b"), (None, "c"), (1, None)] if keep == "min" else [(5, "a"), (5, "b"), (None, "c"), (9, "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(expected, key=repr)
    assert exact_dedup.drop_copies(df.where("false")).count() == 0
    found = exact_dedup.exact_dedup(df, keep=keep).collect()
    by_hand = {"a": 3 if keep == "min" else 5, "b": 5, "c": None, "": 1 if keep == "min" else 9}
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in by_hand}
    size = Counter(t or "" for _, t in rows)
    assert len(found) == len(rows)
    for r in found:
        t = texts[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (by_hand[t], size[t], r.doc_id == by_hand[t])


def test_components_of_chains(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(5, 5)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"))
    parent = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.id: r.component for r in found.collect()} == {x: parent[x] for x in nodes}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test")).count() == 0


# --- suffix dedup ---


def removed_by_hand(texts, size, later):
    """Covered bytes per text; windows in order of id and position."""
    seen, total = set(), Counter()
    for t in texts:
        total.update(t[i : i + size] for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            w = t[i : i + size]
            if total[w] > 1 and (not later or w in seen):
                cover[i] += 1
                cover[i + size] -= 1
            seen.add(w)
        out.append(np.cumsum(cover[:-1]) > 0)
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé漢") for _ in range(rng.randrange(1, 7)))
    shared = [" ".join(word() for _ in range(n)) for n in (15, 40, 120)]
    texts = []
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 30)))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(shared)
            parts.append(own[rng.randrange(20) :] if rng.random() < 0.5 else own)
            parts.append(word())
        texts.append(" ".join(parts))
    return [*texts, texts[3], texts[3], "ab" * 900, "x" * 500, "yx" * 20 + "x" * 450]


@pytest.mark.parametrize("size, later, report", [(60, False, 25), (60, True, 41), (200, False, None), (200, True, 60), (7, True, 3)])
def test_suffix_dedup(spark, size, later, report):
    texts = [*ODD, *passages(size)]
    data = [(t or "").encode() for t in texts]
    cover = removed_by_hand(data, size, later)
    df = awkward(documents(spark, texts))
    shown = removed_by_hand(data, report or size, later)
    found = suffix_dedup.suffix_dedup(df, size, later, report_bytes=report).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.n_repeated == int(shown[r.doc_id].sum())
        own, body = cover[r.doc_id], np.frombuffer(data[r.doc_id], np.uint8)
        spans = int((np.diff(np.r_[0, own.astype(int)]) == 1).sum())
        expected = (len(body), int(own.sum()), spans, hashlib.sha256(body[~own].tobytes()).hexdigest())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected
    assert sum(int(c.sum()) for c in cover) > 2000
    left = suffix_dedup.without_repeats(df, size, later, length_col="n_chars")
    assert left.columns == df.columns
    for r in left.collect():
        if texts[r.doc_id] is None:
            assert r.text is None
        else:
            assert r.n_chars == len(r.text) and len(r.text.encode()) >= len(data[r.doc_id]) - cover[r.doc_id].sum()


@pytest.mark.parametrize("later", [False, True])
def test_hot_anchors_are_dealt_out(spark, monkeypatch, later):
    """Anchors of more than one content are cut to blocks, and those again to single windows."""
    monkeypatch.setattr(suffix_dedup, "OF_A_BLOCK", 1)
    texts = passages(1)
    data = [(t or "").encode() for t in texts]
    rows = documents(spark, texts).select(F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("text"))
    cover = removed_by_hand(data, 60, later)
    for most in (10**6, 1):
        found = suffix_dedup.repeated_ranges(rows, 60, later, Scratch(spark, "t"), most).collect()
        own = defaultdict(list)
        for r in found:
            own[r.doc].append((r.first, r.last))
        for i, c in enumerate(cover):
            mine = np.zeros(len(c), bool)
            for a, b in own[i]:
                assert b <= len(c)
                mine[a:b] = True
            assert (mine == c).all()
    assert len(found) > 10


def test_runs_of_shared_anchors_come_in_passes(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(-300, 300), bytes([rng.randrange(3)]), i, 0, 1, 0) for i in range(500)]
    every = spark.createDataFrame(rows, suffix_dedup.ANCHORS)
    parts = [p.collect() for p in suffix_dedup._shared(every, Scratch(spark, "passes"))]
    times = Counter(r[0] for r in rows)
    found = [(r.anchor, bytes(r.run), r.doc, r.start, r.windows, r.off) for p in parts for r in p]
    assert sorted(found) == sorted(r for r in rows if times[r[0]] > 1)
    assert len(parts) > 1 and all(len(p) < 0.7 * len(found) for p in parts)
    assert sum(len({r.anchor for r in p}) for p in parts) == len({r[0] for r in found})


def test_suffix_dedup_odd_tables(spark):
    df = documents(spark, ["abc" * 50, "abc" * 50, None], [1, 1, None])
    assert sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.suffix_dedup(df, 100, False).collect()) == [(-1, 0), (1, 150), (1, 150)]
    assert suffix_dedup.suffix_dedup(df.where("false")).count() == 0


@pytest.mark.parametrize("later", [False, True])
def test_suffix_dedup_of_repeated_and_null_ids(spark, later):
    texts = [t for t in dict.fromkeys(passages(5)) if t]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(len(texts))]
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, hashlib.md5(texts[i].encode()).digest()))
    data = [texts[i].encode() for i in order]
    cover = removed_by_hand(data, 60, later)
    found = suffix_dedup.suffix_dedup(documents(spark, texts, ids), 60, later).collect()
    expected = [(ids[i], len(b), int(c.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~c].tobytes()).hexdigest()) for i, b, c in zip(order, data, cover, strict=True)]
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in found), key=key) == sorted(expected, key=key)
    left = suffix_dedup.without_repeats(documents(spark, texts, ids), 60, later, length_col="n_chars")
    assert left.count() == len(texts) and left.columns == documents(spark, texts).columns


def test_rows_that_repeat_id_and_text_stay_alike(spark):
    df = documents(spark, ["abcdefgh" * 20] * 2 + ["z" + "abcdefgh" * 20], [1, 1, 2])
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(df, 100, True).collect()) == [(1, 152)] * 2 + [(2, 160)]


def test_thue_morse_texts_are_not_mistaken(spark):
    bit = lambda i: bin(i).count("1") & 1
    one = "".join("ab"[bit(i)] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    df = documents(spark, ["1" + one + "1", "2" + other + "2"])
    cover = removed_by_hand([b"1" + one.encode() + b"1", b"2" + other.encode() + b"2"], 2048, False)
    assert [int(c.sum()) for c in cover] == [0, 0]
    assert [r.n_removed for r in suffix_dedup.suffix_dedup(df, 2048, False).collect()] == [0, 0]


def factors_by_hand(text, at, size):
    common = lambda p, q: next((k for k in range(size) if max(p, q) + k >= len(text) or text[p + k] != text[q + k]), size)
    return [max((common(p, q) for q in at[:i]), default=0) for i, p in enumerate(at)]


@pytest.mark.parametrize("size", [1, 5, 8, 9, 16, 24, 33, 100])
@pytest.mark.parametrize("ways", [2, 3])
def test_longest_previous_factors(monkeypatch, size, ways):
    if ways == 2:  # as for a large buffer
        monkeypatch.setattr(suffix_dedup, "_WAYS", 2)
    rng = random.Random(size)
    for n in (0, 1, 40, 150):
        for text in (bytes(rng.choice(b"ab") for _ in range(n)), b"ab" * (n // 2) + b"x" * n):
            at = sorted(rng.sample(range(len(text)), len(text) * 2 // 3))
            suffixes = suffix_dedup.SuffixOrder(np.frombuffer(text, np.uint8), size + rng.randrange(40))
            factor, match = suffix_dedup.longest_previous(suffixes, np.array(at, int), size)
            assert factor.tolist() == factors_by_hand(text, at, size)
            assert all(m < i and factors_by_hand(text, [at[m], at[i]], size)[1] == f for i, (f, m) in enumerate(zip(factor.tolist(), match.tolist(), strict=True)) if f)


def test_long_text_in_chunks(spark, monkeypatch):
    rng = random.Random(0)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    df = documents(spark, [long, "q" + long[600_000:600_500] + "z"])
    found = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df, 400, False).collect()}
    assert (found[0].n_removed, found[1].n_removed, found[0].n_spans) == (500, 500, 1)


# --- top-k search ---


@pytest.mark.parametrize("at_once", [2, 1000])
def test_topk(spark, at_once):
    rng = np.random.default_rng(0)
    rows = [(i, 0, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(230)]
    rows += [(500, 1, None), (501, 1, [1.0, float("nan"), 0.0, 0.0, 0.0]), (502, 1, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, 1, [1.0] * 5), (600, 1, [1.0, 2.0]), (7, 1, [1.0] * 5)]
    rows += [(700, 1, [1.0, None, 0.0, 0.0, 0.0])]
    if at_once == 2:
        rows += [(650, 1, []), (651, 1, []), (652, 1, []), (750, 1, [2.0, -1.0])]
    else:
        rows = [r for r in rows if r[0] != 600]  # queries of one length are broadcast
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(7)
    found = defaultdict(list)
    for r in topk_search.topk_search(df, F.col("vec_id") % 50 == 0, k=4, queries_at_once=at_once, shard_rows=40, tile=16, fan_in=2).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    real = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, _, v in rows if v is not None and i is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    for q, v in real:
        if q % 50 == 0:
            scores = sorted((-int(v @ w), i) for i, w in real if i != q and len(w) == len(v))[:4]
            assert sorted(found.pop(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert not found


def test_topk_of_huge_numbers_and_of_none(spark):
    rows = [(0, [3e9, 1.0]), (1, [1000.0, 5.0]), (2, [999.0, 5.0]), (3, [-7.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk_search.topk_search(df, F.col("vec_id") == 0, k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 1024**2 * (3 * 10**12 + 5)), (2, 1024**2 * (2997 * 10**9 + 5))]
    assert topk_search.topk_search(df.where("false"), F.col("vec_id") == 0).count() == 0


# --- packing ---


def test_packing_of_documents(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*ODD, "İstanbul ΣΑΣ it's don't. a\x1cb é x,,", "word " * 5000, "<|endoftext|> x", "É<|startoftext|><|ENDOFTEXT|>  a"]
    expected = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    found = packing.pack_documents(awkward(documents(spark, texts)), P.path("word_bpe_49k.json"), 512).collect()
    import zlib

    bins = defaultdict(list)
    for i, ids in expected.items():
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 512)) and [r.piece for r in own] == list(range(len(own)))
        for r in own:
            part = ids[r.start : r.start + 512]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 512
    total = sum(len(x) for x in expected.values())
    assert len(bins) <= -(-total // 512) + 1
    assert packing.pack_documents(documents(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_packing_of_null_repeated_and_large_ids(spark, monkeypatch):
    ids = [None, None, (1 << 60) + 1, (1 << 60) + 3, 7, 7, 7, None]
    texts = ["a b", "c", "d e f", "g", "h", "h", "", None]
    df = awkward(documents(spark, texts, ids))
    found = packing.pack_documents(df, P.path("word_bpe_49k.json"), 4).collect()
    expected = [(i, len((t or "").split()) + 1) for i, t in zip(ids, texts, strict=True)]
    assert sorted(((r.doc_id, r.length) for r in found), key=repr) == sorted(expected, key=repr)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4


def test_leftovers_of_groups_are_packed_together(spark):
    """Groups of 200 pieces would leave an underfull sequence each; repeated ids spread over groups."""
    rng = random.Random(3)
    rows = [(None if i % 3 else i, 0, 0, rng.choice([rng.randint(1, 40), 64]), i) for i in range(6000)]
    df = spark.createDataFrame(rows, packing.PIECES)
    found = packing.pack(df.repartition(5), 64, group_size=200).collect()
    total = sum(r[3] for r in rows)
    assert sorted(r.ids_crc32 for r in found) == list(range(6000))
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 64
    assert len(bins) <= -(-total // 64) + 1


def test_search_starts_from_a_poor_packing():
    rng = random.Random(5)
    lengths = [rng.choice([rng.randint(2, 400), rng.randint(300, 1900)]) for _ in range(3000)]
    first = packing.next_fit(lengths, 2048)
    least = -(-sum(lengths) // 2048)
    found = packing.swap_search(lengths, [list(b) for b in first], 2048)
    assert sorted(i for b in found for i in b) == list(range(3000)) and len(first) > least * 1.02
    assert len(found) <= least + 1


def test_swaps_empty_bins():
    # Best fit leaves three bins; exchanging one for one fits everything into two.
    lengths, bins = [6, 5, 5, 4], [[0], [1, 2], [3]]
    better = packing.swap_search(lengths, [list(b) for b in bins], 10)
    assert len(better) == 2 and sorted(i for b in better for i in b) == [0, 1, 2, 3]
    better = packing.swap_search([7, 3, 3, 2, 2, 3], [[0], [1, 3, 4], [2, 5]], 10)
    assert len(better) == 2


def test_swaps_try_every_pair_of_a_bin():
    """Only the last two of 26 pieces can be given for a longer one."""
    lengths = [7] * 24 + [3, 5, 13, 13]
    found = packing.swap_search(lengths, [list(range(26)), [26], [27]], 181)
    assert max(sum(lengths[i] for i in b) for b in found) == 181 and sorted(i for b in found for i in b) == list(range(28))


def test_search_keeps_items_and_raises_fill():
    saved = 0
    for seed in range(200):
        rng = random.Random(seed)
        size = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, size - 1) for _ in range(rng.randint(0, 60))]
        first = packing.best_fit(lengths, size)
        shuffled = [[i] for i in range(len(lengths))] if seed % 2 else first
        before = sum(sum(lengths[i] for i in b) ** 2 for b in shuffled)
        better = packing.swap_search(lengths, [list(b) for b in shuffled], size)
        fills = [sum(lengths[i] for i in b) for b in better]
        assert sorted(i for b in better for i in b) == list(range(len(lengths))) and all(f <= size for f in fills)
        assert len(better) <= len(shuffled) and sum(f * f for f in fills) >= before
        saved += len(shuffled) - len(better)
    assert saved > 500


# --- language, toxicity, quality, LM scoring ---

LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}


def language_table(spark, n=240, seed=0):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choice(LETTERS[lang] + "xy") for _ in range(rng.randrange(2, 8)))
    langs = [rng.choice(list(LETTERS)) for _ in range(n)]
    return documents(spark, [" ".join(word(x) for _ in range(30)) for x in langs], langs=langs), word


def test_language_held_out_and_mixtures(spark):
    train, word = language_table(spark)
    odd = [None, "", "123 ... 45", "!!", " ".join([word("aa") for _ in range(60)] + [word("bb") for _ in range(40)]), "ABCDE bcdea", "7 " * 600_000 + "abc dea"]
    df = train.unionByName(documents(spark, odd, range(1000, 1000 + len(odd)), [None] * len(odd)))
    found = {r.doc_id: r for r in language.identify(awkward(df), per_language=60).collect()}
    true = {r.doc_id: r.lang for r in train.collect()}
    held = [i for i in true if found[i].held_out]
    assert len(held) > 20 and sum(found[i].lang_pred == true[i] for i in held) >= 0.97 * len(held)
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in range(1000, 1004))
    mixed = found[1004]
    assert list(mixed.languages) == ["aa", "bb"] and abs(mixed.shares[0] - 0.6) < 0.1 and mixed.score == mixed.shares[0]
    assert found[1005].lang_pred == "aa" and found[1006].lang_pred == "aa"
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and not {r.doc_id for r in kept.collect()} & {1000, 1001, 1002, 1003} and kept.count() == df.count() - 4


def mixture_by_hand(words, langs, steps, most, penalty):
    """EM over (likelihoods, count) of a text's words, a word at a time, then sets of languages by penalised likelihood."""

    def fit(share, rounds):
        for _ in range(rounds):
            new = [0.0] * langs
            for p, n in words:
                total = sum(a * b for a, b in zip(p, share, strict=True))
                for k in range(langs):
                    new[k] += n * p[k] * share[k] / total
            mass = sum(n for _, n in words)
            share = [x / mass for x in new]
        return share, sum(n * np.log(sum(a * b for a, b in zip(p, share, strict=True))) for p, n in words)

    full, _ = fit([1 / langs] * langs, steps)
    order = sorted(range(langs), key=lambda k: (-full[k], k))
    best, chosen = -np.inf, None
    for size in range(1, min(most, langs) + 1):
        share = [max(full[k], 1e-6) if k in order[:size] else 0.0 for k in range(langs)]
        share, like = fit([x / sum(share) for x in share], 0 if size == 1 else 3)
        like -= penalty * (size - 1) * np.log(sum(n for _, n in words) + 1)
        if like > best:
            best, chosen = like, share
    return chosen


def test_language_mixture_equals_plain_em():
    rng = np.random.default_rng(3)
    mixture = language.Mixture(4)
    texts = []
    for size in (1, 2, 7, 40, 40, 60):
        p = rng.random((size, 4)) ** 4 + 1e-3
        p[: size // 2, rng.integers(4)] += 2
        texts.append((p / p.max(1, keepdims=True), rng.integers(1, 4, size).astype(float)))
    found = mixture.infer(
        np.concatenate([p for p, _ in texts]).astype(np.float32), np.concatenate([n for _, n in texts]).astype(np.float32), np.array([len(n) for _, n in texts])
    )
    for own, (p, n) in zip(found, texts, strict=True):
        assert np.allclose(own, mixture_by_hand(list(zip(p.tolist(), n.tolist(), strict=True)), 4, mixture.steps, mixture.most, mixture.penalty), atol=2e-3)
    assert len({int((own > 0).sum()) for own in found}) > 1


def test_language_and_classifiers_take_null_and_repeated_ids(spark):
    table, word = language_table(spark, 60)
    odd = documents(spark, [" ".join(word("aa") for _ in range(20))] * 3, [None, None, 5], ["aa", None, "bb"])
    found = language.identify(table.unionByName(odd)).collect()
    assert len(found) == 63 and {(r.lang_pred, r.held_out) for r in found if r.doc_id is None} == {("aa", False)}
    docs, labels = rated(spark, 80)
    odd = documents(spark, ["vilk zogge"] * 3, [None, None, 5])
    for made in (toxicity.toxicity(docs.unionByName(odd), labels), quality.quality(docs.unionByName(odd), labels)):
        rows = made.collect()
        assert len(rows) == 83 and sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 5 for r in rows) == 2


def test_language_learns_from_nothing(spark):
    df = documents(spark, ["abc", None], langs=[None, "en"])
    assert {r.lang_pred for r in language.identify(df).collect()} == {"und"}
    assert language.identify(df.where("false")).count() == 0


def test_held_out_fold(spark):
    import zlib

    found = spark.range(200).select("id", is_held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in found)


def rated(spark, n=400, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(40)]
        toxic, bad = int(rng.random() < 0.25), int(rng.random() < 0.25)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["vilk", "vilkum", "zogge", "Zoggen!"]))
        if bad:
            words = [w.upper() + "!!" if rng.random() < 0.7 else w for w in words]
        texts.append(" ".join(words))
        labels.append((i, 1 - bad, toxic))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_sample_takes_the_smallest_hashes(spark):
    rows = [(i, i % 10 == 0) for i in range(3000)] + [(i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, label boolean")
    found = [(r.id, r.label) for r in features.hashed_sample(df, "label", "id", 40).collect()]
    hashed = df.where("label IS NOT NULL").select("id", "label", F.xxhash64("id").alias("h")).collect()
    for label in (True, False):
        expected = sorted((r.h, r.id) for r in hashed if r.label == label)[:40]
        assert sorted(i for i, x in found if x == label) == sorted(i for _, i in expected)
    assert len(found) == 80 and features.hashed_sample(df.where("false"), "label", "id", 3).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = rated(spark)
    odd = documents(spark, [None, "", "VILK zogge vilkum"], [9000, 9001, 9002])
    known = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (77777, 1, 1)], labels.schema))
    found = {r.doc_id: r for r in toxicity.toxicity(awkward(docs.unionByName(odd)), known, per_class=200).collect()}
    true = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in true if found[i].held_out]
    assert sum(found[i].predicted == true[i] for i in held) >= 0.95 * len(held)
    assert found[9000].score == found[9001].score < 0.5 < found[9002].score and 0 <= found[9002].score <= 1
    blank = toxicity.toxicity(docs.limit(3), labels.where("false")).collect()
    assert [r.score for r in blank] == [0.5] * 3
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_toxicity_equals_a_plain_fit(spark):
    """Naive Bayes ratios times logistic weights on a dense table of named n-grams, without hashes."""
    docs, labels = rated(spark, 120, seed=4)
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    texts = {r.doc_id: {w.lower().strip("!") for w in r.text.split()} for r in docs.collect()}
    own = {i: Counter(g for w in words for g in {f"<{w}>"[a : a + n] for n in (3, 4, 5) for a in range(len(w) + 3 - n)}) for i, words in texts.items()}
    true = {r.doc_id: r.toxic for r in labels.collect()}
    train = [i for i in sorted(own) if not found[i].held_out]
    names = {g: k for k, g in enumerate(sorted({g for i in train for g in own[i]}))}
    x, y = np.zeros((len(train), len(names))), np.array([true[i] for i in train])
    for row, i in enumerate(train):
        for g, n in own[i].items():
            x[row, names[g]] = n
    positive, negative = x[y == 1].sum(0), x[y == 0].sum(0)
    # The smoothing of all hashed cells counts, used or not.
    p, q = ((c + 1) / (c.sum() + toxicity.WIDTH) for c in (positive, negative))
    ratio = np.where(positive + negative >= 3, np.log(p / q), 0)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    beta, m, v = np.zeros(len(names) + 1), 0, 0
    for t in range(1, 151):
        error = weight * (1 / (1 + np.exp(-(x @ (ratio * beta[:-1]) + beta[-1]))) - y)
        gradient = np.append(ratio * (error @ x) + 1e-3 * beta[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        beta -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    final = ratio * beta[:-1]
    score = {i: 1 / (1 + np.exp(-(beta[-1] + sum(n * final[names[g]] for g, n in own[i].items() if g in names)))) for i in own}
    off = [abs(score[i] - found[i].score) for i in own]
    assert np.median(off) < 0.01 and np.mean(np.array(off) < 0.05) > 0.95


def quality_by_hand(text, weights, cuts):
    words = text.split()
    counts = Counter(words)
    if n := sum(a == b for a, b in zip(words, words[1:], strict=False)):
        counts[features.AGAIN] = n
    length = np.sqrt(sum(np.log1p(c) ** 2 for c in counts.values())) or 1
    f = sum(np.log1p(c) / length * sum(weights[g] for g in quality.word_features(w)) for w, c in counts.items())
    return [1 / (1 + np.exp(c - f)) for c in cuts]


def test_quality_equals_plain_formulas(spark):
    docs, labels = rated(spark, 150, seed=6)
    odd = documents(spark, ["a a a b", "a b a b", "", None, "x " * 30], range(900, 905))
    every = docs.unionByName(odd)
    found = {r.doc_id: r for r in quality.quality(every, labels).collect()}
    texts = {r.doc_id: r.text or "" for r in every.collect()}
    true = {r.doc_id: (0 if r.quality == 0 else 2 - r.toxic) for r in labels.collect()}
    sample = [i for i in true if not found[i].held_out]
    counts = {i: features.word_counts(texts[i], True) for i in sample}
    weights, cuts = quality.train([(true[i], list(counts[i]), list(counts[i].values())) for i in sample], 3)
    for i, r in found.items():
        above = quality_by_hand(texts[i], weights, cuts)
        assert list(r.tail_probabilities) == pytest.approx(above, abs=0.02) and r.tail_probability == r.tail_probabilities[0]
        assert r.expected_grade == pytest.approx(sum(above), abs=0.03) and r.selected == (r.tail_probability >= 0.5)
        assert r.n_words == len(texts[i].split())

    def likelihood(weights, cuts):
        """Of the sample's grades, by differences of tails."""
        out = 0.0
        for i in sample:
            tails = [1.0, *quality_by_hand(texts[i], weights, cuts), 0.0]
            out += np.log(max(tails[true[i]] - tails[true[i] + 1], 1e-12))
        return out

    best = likelihood(weights, cuts)
    share = np.bincount([true[i] for i in sample], minlength=3) / len(sample)
    assert best > len(sample) * (share * np.log(share)).sum() * 0.2
    rng = np.random.default_rng(0)
    used = np.unique([g for i in sample for w in counts[i] for g in quality.word_features(w)])
    for _ in range(3):
        other = weights.copy()
        other[used] += rng.normal(0, 1.5, len(used))
        assert likelihood(other, cuts) < best
    assert likelihood(weights, cuts + np.array([2.0, 0])) < best and likelihood(weights, cuts + np.array([0, -2.0])) < best


def test_quality_grades_held_out(spark):
    docs, labels = rated(spark, 600)
    found = {r.doc_id: r for r in quality.quality(awkward(docs), labels, per_grade=300).collect()}
    true = {r.doc_id: (0 if r.quality == 0 else 2 - r.toxic) for r in labels.collect()}
    held = [i for i in true if found[i].held_out]
    assert sum(found[i].selected == (true[i] > 0) for i in held) >= 0.95 * len(held)
    mean = [np.mean([found[i].expected_grade for i in held if true[i] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    none = quality.quality(documents(spark, [None, "", "x"]), labels.where("false")).collect()
    assert len(none) == 3 and all(abs(r.tail_probability - 2 / 3) < 1e-9 for r in none)


def test_ordinal_thresholds_stay_in_order():
    rng = random.Random(1)
    rows = [(g, [f"g{g}", f"r{rng.randrange(20)}"], [3, 2]) for g in (0, 1, 2, 3) for _ in range(20)]
    weights, cuts = quality.train(rows, 4)
    assert (np.diff(cuts) > 0).all()
    score = [sum(weights[f] for f in quality.word_features(f"g{g}")) for g in range(4)]
    assert score == sorted(score)


def losses_by_hand(texts, target):
    """Both losses of each text, by plain dictionaries over all other texts."""
    split = [(t or "").lower().split() for t in texts]
    bigrams = [Counter(zip([None, *s], s, strict=False)) for s in split]
    types = len({w for s in split for w in s}) + 1

    def model(counted):
        pairs, before, words = Counter(), Counter(), Counter()
        for i in counted:
            pairs.update(bigrams[i])
        for (a, b), n in pairs.items():
            before[a] += n
            words[b] += n
        return pairs, before, words, sum(words.values())

    def loss(i, counted, pairs, before, words, n):
        if not split[i]:
            return 0.0
        if i in counted:  # without the text itself
            pairs, before, words, n = pairs - bigrams[i], Counter(before), Counter(words), n - len(split[i])
            for (a, b), k in bigrams[i].items():
                before[a] -= k
                words[b] -= k
        unigram = lambda w: (words[w] + 0.5) / (n + 0.5 * types)
        return -np.mean([np.log((pairs[a, b] + 4 * unigram(b)) / (before[a] + 4)) for a, b in zip([None, *split[i]], split[i], strict=False)])

    every = set(range(len(texts)))
    known = [(set(target), *model(target)), (every, *model(every))]
    return [tuple(loss(i, *m) for m in known) for i in range(len(texts))]


def check_losses(found, texts, expected):
    assert len(found) == len(texts)
    for r in found:
        own, background = expected[r.doc_id]
        assert r.n_tokens == len((texts[r.doc_id] or "").split())
        assert (r.target_loss, r.background_loss) == pytest.approx((own, background)) and r.score == pytest.approx(own - background)


def test_lm_scores(spark, monkeypatch):
    texts = [*ODD, "a b c a b", "c d", "A b C"] + [f"w{i} a b w{i + 1}" for i in range(30)]
    target = [10, 12, 13, 3]
    ids = spark.createDataFrame([(i,) for i in [*target, 10, None, 999]], "doc_id long")
    expected = losses_by_hand(texts, target)
    check_losses(lm_scoring.score_documents(awkward(documents(spark, texts)), ids).collect(), texts, expected)
    monkeypatch.setattr(lm_scoring, "BROADCAST_IDS", 2)
    check_losses(lm_scoring.score_documents(documents(spark, texts), ids).collect(), texts, expected)
    assert lm_scoring.score_documents(documents(spark, []), ids).count() == 0
    found = lm_scoring.score_documents(documents(spark, ["a b", "a b", None], [1, 1, None]), ids.where("false")).collect()
    assert sorted((r.n_tokens, round(r.target_loss, 9)) for r in found) == [(0, 0), *[(2, round(float(np.log(3)), 9))] * 2]


def test_lm_probabilities_of_a_context_add_up_to_one():
    rng = np.random.default_rng(0)
    for total in (0, 1, 500):
        words = rng.multinomial(total, np.ones(40) / 40)
        pairs = rng.binomial(words, 0.3)
        types = len(words) + 1
        known = np.exp(-lm_scoring.losses(pairs, np.full(40, pairs.sum()), words, total, types)).sum()
        unseen = np.exp(-lm_scoring.losses(np.zeros(1), np.array([pairs.sum()]), np.zeros(1), total, types)).sum()
        assert known + unseen == pytest.approx(1)


def test_lm_counts_have_no_caps(spark, monkeypatch):
    """More words and bigrams than any fixed table held, in several chunks and buckets."""
    for name, most in (("CHUNK_TOKENS", 9_000), ("BUCKET_WORDS", 20_000), ("BUCKET_PAIRS", 20_000)):
        monkeypatch.setattr(lm_scoring, name, most, raising=False)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(70_000)}" for _ in range(3000)) for _ in range(100)] + ["", None]
    texts += [texts[3], "w1 neverseen w1 neverseen"]
    own = list(range(0, 100, 3))
    ids = spark.createDataFrame([(i,) for i in own], "doc_id long")
    check_losses(lm_scoring.score_documents(documents(spark, texts), ids).collect(), texts, losses_by_hand(texts, own))


def test_numbers_are_packed_by_planes():
    rng = np.random.default_rng(4)
    for x in (rng.integers(0, 9, (2, 500)), rng.integers(0, 1 << 40, 77), rng.random(9) < 0.5, np.arange(6, dtype=np.int32), np.empty(0, np.uint64)):
        assert np.array_equal(lm_scoring.unpacked(lm_scoring.packed(x), x.dtype.type), x.ravel())
    counts = rng.geometric(0.7, 100_000)
    assert len(lm_scoring.packed(counts)) < 0.7 * len(lm_scoring.packed(counts.tobytes()))


def test_shuffle_files_go_with_the_write_of_a_scratch_table(spark):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {n for n in (blocks.apply(i).name() for i in range(blocks.size())) if n.startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, own = shuffled(), spark.conf.get(setting, None)
    scratch = Scratch(spark, "shuffled")
    counts = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
    saved = scratch.save(counts.join(spark.range(700).repartition(3).withColumnRenamed("id", "k").hint("merge"), "k"))
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and saved.count() == 700 and spark.conf.get(setting, None) == own
    with pytest.raises(Exception, match="own error"):
        scratch.save(counts.select(F.raise_error(F.lit("own error"))))
    assert spark.conf.get(setting, None) == own


def test_scratch_tables_go_with_the_process(tmp_path):
    """Dropped tables go at once, the others at the end of the process that wrote them."""
    code = f"""
import sys
from pyspark.sql import SparkSession
from spanloom.llm.common import Scratch
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()
scratch = Scratch(spark, 'x')
one, two = scratch.save(spark.range(3)), scratch.save(spark.range(4))
scratch.keep_only(two)
import glob
found = glob.glob('{tmp_path}/spanloom-*/*/*')
assert len(found) == 1 and two.count() == 4, found
if len(sys.argv) > 1:
    spark.stop()
"""
    for extra in ([], ["stop"]):
        subprocess.run([sys.executable, "-c", code, *extra], check=True, cwd=Path(__file__).parents[2], timeout=120)
        assert not list(tmp_path.glob("spanloom-*"))


def test_remembering_holds_two_generations():
    made = []
    memo = Remembering(lambda k: made.append(k) or k * 2, 3)
    assert [memo[k] for k in (1, 2, 3, 4, 1, 2)] == [2, 4, 6, 8, 2, 4] and made == [1, 2, 3, 4] and len(memo) <= 3
