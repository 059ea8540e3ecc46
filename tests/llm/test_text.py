"""Word hashing, language ID, token counts, toxicity."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.llm import common, langid, tokencount, toxicity
from tests.llm import naive

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NASTY = [None, "", " ", "\n\n", "a", "A  b\tc", "é É", "x" * 5000, "word " * 3000, " 　", "😀 ok"]


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, "s", None) for k, t in enumerate(texts)], DOCS)


def test_words_are_those_of_the_pattern(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice("ab \n\tÄé.") for _ in range(rng.randrange(300))) for _ in range(100)]
    data, at = common.utf8(pa.array(texts))
    h, start, end, offsets = common.words(data, at)
    seen = {}
    for k, t in enumerate(texts):
        want = naive.words(t)
        got = [bytes(data[s:e]).decode().translate({c: c + 32 for c in range(65, 91)}) for s, e in zip(start[offsets[k] : offsets[k + 1]], end[offsets[k] : offsets[k + 1]])]
        assert got == want
        for w, x in zip(want, h[offsets[k] : offsets[k + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_prefixes():
    data, at = common.utf8(pa.array(["abcdef abcdxy ab"]))
    h = common.words(data, at, common.LETTERS, (4,))[0]
    assert h[0, 1] == h[1, 1] != 0 and h[2, 1] == 0 and h[0, 0] != h[1, 0]


LANGUAGES = {"aa": ["tion", "er", "the", "ing"], "bb": ["que", "eau", "oi", "ment"], "cc": ["sch", "ung", "keit", "ein"]}


def invented(rng, lang, n):
    return " ".join("".join(rng.choices(LANGUAGES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(2)
    rows = [(k, invented(rng, lang, rng.randrange(8, 200)), lang, None, None) for k, lang in enumerate(rng.choices(list(LANGUAGES), k=240))]
    rows += [(1000 + k, t, None if k % 2 else "aa", None, None) for k, t in enumerate(NASTY)]
    rows += [(2000, invented(rng, "bb", 8) + " " + invented(rng, "cc", 9000), None, None, None)]  # block by block
    docs = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    assert len(got) == len(rows) and got[2000].lang_pred == "cc" and len(rows[-1][1]) > 3 * langid.BLOCK_BYTES
    held = [(r[0], r[2]) for r in rows[:240] if got[r[0]].held_out]
    assert len(held) > 30 and np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97
    for k, t in enumerate(NASTY):
        r = got[1000 + k]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= r.score <= 1
        assert r.accepted <= (r.lang_pred != "und")
    kept = langid.keep_accepted(docs, langid.learn_dictionaries(docs))
    assert kept.columns == docs.columns and kept.count() >= 235
    none = docs.where("false")
    assert langid.identify_languages(none).count() == 0 and langid.keep_accepted(none, {}).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_are_the_library_s(name):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    pieces = tokencount.load_pieces(public_tokenizers.path(name))
    rng = random.Random(3)
    texts = [t or "" for t in NASTY] + ["".join(rng.choice(" \n\t\r▁ab;)}é中　<s>/…<|endoftext|>") for _ in range(rng.randrange(60))) for _ in range(2000)]
    assert pieces.splits
    assert tokencount.Counts(pieces, {}).count(texts) == [pieces.whole(t) for t in texts]


def test_token_cache_overflow(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokencount, "CACHE_ENTRIES", 20)
    pieces = tokencount.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    counts = tokencount.Counts(pieces, {"▁the": 1})
    for k in range(30):
        texts = [f"the word{k} and word{k + j}" for j in range(5)]
        assert counts.count(texts) == [pieces.whole(t) for t in texts]


def test_frequent_pretokens_are_those_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "MERGED", 2)
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    late = "first " * 3000 + "late " * 1000  # behind any prefix
    texts = [None, "", *(f"own{k} here" for k in range(3000)), late]
    found = tokencount.frequent_lengths(table(spark, texts).repartition(7), path, entries=3)
    assert set(found) == {"▁first", "▁here", "▁late"}
    assert found == dict(zip(found, tokencount.load_pieces(path).lengths(list(found))))
    assert tokencount.frequent_lengths(table(spark, []), path) == {}


def test_summary_keeps_the_frequent():
    rng = random.Random(5)
    words = [f"w{rng.randrange(4000)}" for _ in range(20_000)] + [f"hot{k % 5}" for k in range(5000)]
    rng.shuffle(words)
    seen = tokencount.Summary(50)
    for low in range(0, len(words), 100):
        seen.counts.update(words[low : low + 100])
        seen.cut(3)
    kept = {p for b in seen.batches() for p in b.column(0).to_pylist()}
    assert len(kept) <= 50 and kept >= {f"hot{k}" for k in range(5)}


def test_token_counts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, NASTY + NASTY[:3]).withColumn("n_tokens", F.lit(-1))
    got = {r.doc_id: r for r in tokencount.count_tokens(docs, path).collect()}
    pieces = tokencount.load_pieces(path)
    for k, t in enumerate(NASTY):
        n = pieces.whole(t or "")
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 4096)
    assert tokencount.count_tokens(docs.where("false"), path).count() == 0


def test_maximal_segments():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, drift = int(rng.integers(1, 25)), float(rng.random() * 2 + 0.01)
        hit = np.flatnonzero(rng.random(n) < 0.4)
        value = rng.integers(1, 6, len(hit)).astype(float) + rng.random(len(hit)) * 1e-3
        dense = np.full(n, -drift)
        dense[hit] = value
        got = toxicity.maximal_segments(hit, value, drift)
        want = naive.segments(dense.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_segments_take_linear_time():
    import time

    def seconds(n):
        hit = np.arange(n) * 50
        value = np.full(n, 1.0)
        start = time.perf_counter()
        assert len(toxicity.maximal_segments(hit, value, 1.0)) == n
        return time.perf_counter() - start

    seconds(1000)
    assert min(seconds(32_000) for _ in range(3)) < 4 * min(seconds(16_000) for _ in range(3)) + 0.05


def naive_toxicity(rows, marks):
    """{id: score}: the model and its scores, word by word with dictionaries."""
    from collections import Counter
    from math import exp, log, log1p, sqrt

    def units(text):
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()):
            yield [w, *(("begins", w[:n]) for n in toxicity.PREFIXES if len(w) >= n)]

    y = {}
    for i, label in marks:
        if i is not None and label is not None and zlib.crc32(str(i).encode()) % 5:
            y[i] = max(label, y.get(i, 0))
    sample = [(y[i], list(units(t))) for i, t in rows if i in y and t is not None]
    n = Counter(label > 0 for label, _ in sample)
    seen = {side: Counter(u for label, t in sample if (label > 0) == side for u in {u for us in t for u in us}) for side in (True, False)}
    lexicon = {}
    for u in seen[True]:
        prior = (seen[True][u] + seen[False][u]) * toxicity.PRIOR / len(sample)
        a, b = seen[True][u] + prior, seen[False][u] + prior
        d = log(a / (n[True] + toxicity.PRIOR)) - log(b / (n[False] + toxicity.PRIOR))
        if seen[True][u] > 1 and d / sqrt(1 / a + 1 / b) >= toxicity.LEAST_Z and d >= toxicity.LEAST_ODDS:
            lexicon[u] = d
    score = lambda us: max((lexicon.get(u, 0.0) for u in us), default=0.0)
    hits = {side: [s for label, t in sample if (label > 0) == side for s in map(score, t) if s] for side in (True, False)}
    words = {side: sum(len(t) for label, t in sample if (label > 0) == side) for side in (True, False)}
    p1, p0 = len(hits[True]) / max(words[True], 1), (len(hits[False]) + 0.5) / (words[False] + 1)
    drift = max(1e-4, log1p(-min(p0, 0.9)) - log1p(-min(p1, 0.9)))
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        clean = hits[False] or [sum(lexicon.values()) / len(lexicon)]
        low, high = (mid, high) if p0 * sum(exp(min(mid * s, 600)) for s in clean) / len(clean) + (1 - p0) * exp(-mid * drift) < 1 else (low, mid)
    lam, place, scale = max(low, 1e-3), 0.0, 1.0
    segments = lambda t: [s for *_, s in naive.segments([score(us) or -drift for us in t])]

    def p_value(s, size):
        x = (lam * s - log(max(size, 1)) - place) / scale
        return -np.expm1(-exp(-min(max(x, -30.0), 700.0)))

    def evidence(t):
        found = segments(t)
        if not found:
            return 0.0, 0.0
        return -log(max(p_value(max(found), len(t)), 1e-30)), log1p(sum(s for s in found if p_value(s, len(t)) < toxicity.LEAST_P))

    best = [(max(segments(t), default=0), len(t)) for label, t in sample if not label and t]
    x = [lam * s - log(size) for s, size in best if s > 0]
    if len(x) >= 20:
        q = np.quantile(x, [0.25, 0.5, 0.75])
        scale = max(1e-3, (q[2] - q[0]) / 1.5725)
        place = q[1] - 0.3665 * scale
    weights = toxicity._fit_logistic(np.array([evidence(t) for _, t in sample]), np.array([label > 0 for label, _ in sample], float))
    return {i: 1 / (1 + exp(-min(max(float(np.dot(weights, (1.0, *evidence(list(units(t)))))), -30.0), 30.0))) for i, t in rows}


def test_toxicity_against_dictionaries(spark):
    rng = random.Random(6)
    vocabulary = [invented(rng, "aa", 1) for _ in range(200)]
    rows, marks = [], []
    for k in range(260):
        text = rng.choices(vocabulary, k=rng.randrange(5, 40))
        if k % 4 == 0:
            at = rng.randrange(len(text))
            text[at:at] = rng.choices(["scumword", "foulthing", "scumwords"], k=rng.randrange(1, 5))
        elif k % 5 == 0:
            text.append("foulthing")
        rows.append((k, " ".join(text)))
        marks.append((k, int(k % 4 == 0)))
    rows += [(1000 + k, t) for k, t in enumerate(NASTY[:8])]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    want = naive_toxicity(rows, marks)
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-3 and max(got.values()) > 0.8


def test_toxicity(spark):
    rng = random.Random(5)
    vocabulary = [invented(rng, "aa", 1) for _ in range(400)]
    rows, labels = [], []
    for k in range(600):
        text = rng.choices(vocabulary, k=rng.randrange(20, 120))
        toxic = k % 5 == 0 or k % 7 == 0
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = rng.choices(["scumword", "foulthing", "badname"], k=4)
        rows.append((k, " ".join(text), "aa", "s", None))
        labels.append((k, 1, int(toxic)))
    rows += [(1000 + k, t, None, None, None) for k, t in enumerate(NASTY)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert len(held) > 60 and np.mean([p == y for p, y in held]) > 0.97
    for i, text, *_ in rows[:600]:
        for s in got[i].segments:
            assert any(w in text.encode()[s.start : s.end].decode() for w in ("scumword", "foulthing", "badname"))
    assert got[1000].segments == [] and got[1000].score == got[1001].score
    assert toxicity.score_documents(docs.where("false"), marks).count() == 0
    assert {r.predicted for r in toxicity.score_documents(docs, marks.where("false")).collect()} == {0}
