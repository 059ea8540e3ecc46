"""Jaccard join, embedding near-dedup, line dedup, decontamination."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from cellweave.llm import decontam, embdedup, jaccard, linedup
from cellweave.llm.common import utf8
from cellweave.llm.graph import connected_components, forest
from tests.llm import naive
from tests.llm.test_text import DOCS, NASTY, invented


def corpus(seed, n=160):
    """Unrelated texts, chains of near copies, exact copies, shared passages, short and nasty ones."""
    rng = random.Random(seed)
    base = [invented(rng, rng.choice(["aa", "bb", "cc"]), rng.choice([3, 7, 12, 30, 90, 250])) for _ in range(n // 4)]
    passage = invented(rng, "aa", 60)
    out = list(base)
    while len(out) < n:
        w = rng.choice(out).split(" ")
        kind = rng.random()
        if kind < 0.2:
            out.append(" ".join(w))
        elif kind < 0.8:
            for _ in range(max(1, int(len(w) * rng.choice([0.004, 0.01, 0.03])))):
                w[rng.randrange(len(w))] = invented(rng, "bb", 1)
            out.append(" ".join(w))
        else:
            out.append(" ".join(w) + "\n" + passage)
    return out + NASTY


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_jaccard_against_all_pairs(spark, k, num, den):
    texts = corpus(k)
    docs = spark.createDataFrame([(3 * i + 1, t, None, None, 0) for i, t in enumerate(texts)], DOCS).withColumn("n_shingles", F.lit("clash"))
    want = naive.jaccard([(3 * i + 1, t) for i, t in enumerate(texts)], k, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, num, den).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
    kept = jaccard.keep_first(docs, k, num, den)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_jaccard_edges(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard.jaccard_components(none).count() == 0 and jaccard.keep_first(none).count() == 0
    rows = [(1, "a b c d e f", None, None, 0)] * 3 + [(None, "a b c d e f", None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0), (3, "", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).where("doc_id is not null").collect())
    assert got == [(1, 2, 1)] * 3 + [(2, 0, 2), (3, 0, 3), (3, 0, 3)]
    assert sorted(r.doc_id or -1 for r in jaccard.keep_first(docs).collect()) == [-1, 1, 2, 3, 3]
    clash = docs.withColumns({"__id0": F.lit(1), "__ROW0": F.lit(2), "k1": F.lit(3), "n": F.lit(4)})
    assert jaccard.keep_first(clash).columns == clash.columns and jaccard.keep_first(clash).count() == 5


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(7)
    for num in (60, 80, 85, 95):
        for _ in range(150):
            n = int(rng.choice([5, 8, 13, 20, 40, 120, 700]))
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            b = a.copy()
            while True:  # change one feature after another while they are similar enough
                c = b.copy()
                c = c[1:] if rng.random() < 0.4 and len(c) > 1 else np.append(c[1:], rng.integers(0, 1 << 62)).astype(np.uint64)
                rng.shuffle(c)
                both = len(np.intersect1d(a, c))
                if 100 * both < num * (len(a) + len(c) - both):
                    break
                b = c
            sig, whose = jaccard.signatures([np.unique(a), np.unique(b)], num, 100)
            assert len(np.intersect1d(sig[whose == 0], sig[whose == 1]))


def test_sets_that_share_most_pieces_by_chance():
    """Sets whose features leave most pieces empty: weak signatures are refined, and none is shared by all sets."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 62, 40).astype(np.uint64)) for _ in range(3000)]
    sig, _ = jaccard.signatures(sets, 85, 100)
    assert np.unique(sig, return_counts=True)[1].max() <= 6


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(9)
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.choice([1, 5, 60, 250, 260, 2000]))).astype(np.uint64))
        keep = a[rng.random(len(a)) < rng.choice([0.7, 0.9, 0.99])]
        b = np.unique(np.append(keep, rng.integers(0, 1 << 62, int(len(a) * rng.choice([0, 0.02, 0.2]))).astype(np.uint64)))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        one, two = jaccard.sketch(a), jaccard.sketch(b)
        width = 2 * min(len(one), len(two))
        found = jaccard.plausible(jaccard._counters([one], width), jaccard._counters([two], width), np.array([len(a)]), np.array([len(b)]), 80, 100)[0]
        assert found or 100 * both < 80 * (len(a) + len(b) - both)
    other = np.unique(rng.integers(0, 1 << 62, 500).astype(np.uint64))
    a = np.unique(rng.integers(0, 1 << 62, 500).astype(np.uint64))
    assert not jaccard.plausible(jaccard._counters([jaccard.sketch(a)], 32), jaccard._counters([jaccard.sketch(other)], 32), np.array([500]), np.array([500]), 80, 100)[0]


def test_large_buckets(spark, monkeypatch):
    """Groups of near copies that hang together by chains, all through large buckets."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    rng = random.Random(11)
    texts = []
    for _ in range(3):
        w = invented(rng, "aa", 120).split()
        for _ in range(60):
            w[rng.randrange(len(w))] = invented(rng, "bb", 1)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    want = naive.jaccard(list(enumerate(texts)), 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 4, 85, 100).collect()}
    assert got == want and len({c for _, c in want.values()}) < 30


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(500, 500 + k) for k in range(1, 80)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert len(forest(4, np.array([0, 1, 0, 3]), np.array([1, 2, 2, 3]))[0]) == 2


VECTORS = "vec_id long, embedding array<float>, label int"


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(10)
    rows, centres = [], rng.normal(size=(8, 24))
    for k in range(220):
        v = centres[k % 8] + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.25, 0.4, 2.0])
        rows.append((k, [float(np.float32(x)) for x in v * rng.choice([1, 3])], int(k % 3) if k % 11 else None))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [float("nan")] * 24, 1), (1004, [None, *[1.0] * 23], 1), (1005, [float("inf"), *[1.0] * 23], 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [3e38] * 24, 1), (1009, [1e-38] * 24, 1), (1010, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicate_vectors(df, 0.93).collect()}
    want = naive.vector_links([r for r in rows if r[0] not in (1008, 1009)], 0.93)
    assert {k: v for k, v in got.items() if k < 1008 or k > 1009} == want and sum(v[0] for v in want.values()) > 50
    assert got[1008] == (1, 1008, True) and got[1009] == (1, 1008, False)
    assert embdedup.near_duplicate_vectors(df.where("false")).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(x @ embdedup.rotation(16), axis=1))


@pytest.mark.parametrize("dims", [1, 2, 7, 8, 9, 24, 63, 64, 70])
def test_block_candidates_lose_no_pair_and_are_few(dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(333, dims))
    x[200:] = x[:133] + rng.normal(size=(133, dims)) * rng.choice([0, 0.05, 0.2, 0.3], (133, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ embdedup.rotation(dims)
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.14
    found = embdedup.candidates(y[:150], y, 0.14)
    assert found.shape == (150, 333) and (found | ~near[:150]).all()
    once = embdedup.candidates(y, y, 0.14, same=True)
    assert not np.tril(once).any() and (once | ~np.triu(near, 1)).all()
    if dims == 64:
        assert once.sum() < 0.02 * 333 * 332 / 2 + np.triu(near, 1).sum()
    cuts = embdedup._cuts(dims)
    assert cuts[0] == 0 and cuts[-1] == dims and (np.diff(cuts) <= embdedup.WIDTH).all() and (np.diff(cuts) > 0).all()


def test_vectors_of_a_label_over_many_units(spark, monkeypatch):
    """One label holds all rows, in sides of a few rows each."""
    monkeypatch.setattr(embdedup, "SIDE_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(k, [float(v) for v in centres[k % 40] + rng.normal(size=16) * 0.12], 1) for k in range(200)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS), 0.93).collect()}
    want = naive.vector_links(rows, 0.93)
    assert got == want and sum(v[0] for v in want.values()) > 100


# ---------------------------------------------------------------- line dedup


def test_line_runs(spark):
    rng = random.Random(12)
    passage = [invented(rng, "aa", rng.randrange(10, 30)) for _ in range(4)]
    docs = []
    for i in range(60):
        lines = [invented(rng, "bb", rng.randrange(1, 40)) for _ in range(rng.randrange(1, 9))]
        if i % 4 == 0:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage
        if i % 9 == 0:
            lines += lines[-2:]
        docs.append((i, "\n".join(lines)))
    docs.append((60, "again " * 400))
    df = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in docs] + [(100 + k, t, None, None, 0) for k, t in enumerate(NASTY)] + [(None, docs[0][1], None, None, 0)], DOCS)
    check_repeats(spark, [*docs, *((100 + k, t) for k, t in enumerate(NASTY) if t is not None)])
    clean = {r.doc_id: r for r in linedup.delete_repeats(df.where("doc_id is not null")).collect()}
    for i, t in docs:
        if i % 4 == 0 and i:  # the passage stays in the first only
            assert passage[1] not in (clean[i].text if i in clean else "")
        if i % 4 and i % 9 and i < 60:
            assert clean[i].text == t and clean[i].n_chars == len(t)
    assert passage[1] in clean[0].text
    assert clean[100].text is None and clean[101].text == ""
    assert 0 < clean[60].text.count("again") < 400 and clean[60].n_chars == len(clean[60].text)
    assert linedup.merged_runs(df).count() > 0
    assert linedup.delete_repeats(df.where("false")).count() == 0


def test_a_repeated_row_is_no_repeat_of_itself(spark):
    text = invented(random.Random(1), "aa", 200)
    df = spark.createDataFrame([(1, text, None, None, 1)] * 2 + [(2, text, None, None, 1)], DOCS).withColumn("runs", F.lit("clash"))
    out = linedup.delete_repeats(df)
    assert [(r.doc_id, r.runs) for r in out.collect()] == [(1, "clash")] * 2 and out.columns == df.columns


def repeated_words(docs, min_words):
    """{id: places of words in windows that stand earlier}, from all windows of all texts."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = naive.words(t)
        out[i] = set()
        for a in range(len(w) - min_words + 1):
            gram = tuple(w[a : a + min_words])
            if gram in seen:
                out[i].update(range(a, a + min_words))
            seen.add(gram)
    return out


def check_repeats(spark, docs, min_words=20):
    """Runs and deletions against all windows; returns what is repeated."""
    df = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in docs], DOCS)
    want, got, texts = repeated_words(docs, min_words), {i: set() for i, _ in docs}, dict(docs)
    for r in linedup.repeated_runs(df, min_words).collect():
        got[r.id].update(range(r["first"], r["last"]))
        assert r.n_words == r["last"] - r["first"] >= min_words and (r.sid, r.sfirst) < (r.id, r["first"])
        assert naive.words(texts[r.id])[r["first"] : r["last"]] == naive.words(texts[r.sid])[r.sfirst : r.sfirst + r.n_words]
    assert got == want
    left = {i: [w for k, w in enumerate(naive.words(t)) if k not in want[i]] for i, t in docs}
    clean = {r.doc_id: naive.words(r.text) for r in linedup.delete_repeats(df, min_words).collect()}
    assert clean == {i: w for i, w in left.items() if w or not naive.words(texts[i])}
    merged = [(r.id, r["first"], r["last"]) for r in linedup.merged_runs(df, min_words).collect()]
    assert {(i, k) for i, a, b in merged for k in range(a, b)} == {(i, k) for i, at in want.items() for k in at} and sum(b - a for _, a, b in merged) == sum(map(len, want.values()))
    return want


@pytest.mark.parametrize(("chunk", "often"), [(300, 1), (2000, 2), (1 << 19, 8)])
def test_every_planted_repeat_is_found(spark, monkeypatch, chunk, often):
    """Repeats of 20 to 40 words in otherwise distinct texts, however tasks cut their rows and whatever is frequent."""
    monkeypatch.setattr(linedup, "CHUNK", chunk)
    monkeypatch.setattr(linedup, "OFTEN", often)
    rng = random.Random(chunk)
    passages = [invented(rng, "aa", rng.randrange(20, 41)).split() for _ in range(60)]
    notice = invented(rng, "cc", 26).split()
    docs = []
    for i in range(200):
        w = invented(rng, "bb", rng.randrange(30, 120)).split()
        if i < 120:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passages[i % 60]
        docs.append((i, " ".join(notice[: rng.randrange(15, 27)] * (i % 2) + w)))
    want = check_repeats(spark, docs)
    assert all(len(want[i]) >= 20 for i in range(60, 120))


def test_line_dedup_of_repeated_ids_and_clashing_names(spark):
    a, b = (invented(random.Random(k), "aa", 40) for k in (1, 2))
    rows = [(1, a, None, None, 0), (1, a, None, None, 0), (1, b + " " + a, None, None, 0), (2, a, None, None, 0), (3, None, None, None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"__id0": F.lit(1), "__TH0": F.lit(2), "__runs0": F.lit(3), "__gone0": F.lit(4), "id": F.lit(5), "runs": F.lit(6)})
    out = linedup.delete_repeats(df)
    got = sorted((r.doc_id, r.text or "") for r in out.collect())
    assert out.columns == df.columns and 2 not in [i for i, _ in got] and (3, "") in got
    assert sum(len(naive.words(t)) for i, t in set(got) if i == 1) == 80  # each of a and b stays once among different texts of an id


def test_passages_planted_mid_line(spark):
    rng = random.Random(14)
    passages = [invented(rng, "aa", n).split() for n in (19, 20, 21, 27, 34, 51, 60, 90)]
    docs = []
    for i in range(80):
        w = invented(rng, "bb", rng.randrange(60, 200)).split()
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(4)  # some start or end elsewhere
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[cut : len(p) - rng.randrange(4)]
        docs.append((i, "".join(x + rng.choice("     \n") for x in w)))
    assert sum(map(len, check_repeats(spark, docs).values())) > 800
    assert sum(map(len, check_repeats(spark, docs[:40], 5).values())) > 400
    periods = [(100 + k, " ".join(f"w{j % n}" for j in range(120))) for k, n in enumerate((1, 2, 7, 25))]
    check_repeats(spark, docs[:5] + periods)


def test_short_quotes_hide_no_passage(spark):
    for seed in range(4):
        rng = random.Random(40 + seed)
        notice = [invented(rng, "aa", 6) for _ in range(9)]
        docs = [(i, "\n".join([invented(rng, "bb", 30), *notice[i : i + 3], invented(rng, "bb", 30)])) for i in range(7)]
        docs += [(i, "\n".join([invented(rng, "bb", 30), *notice, invented(rng, "bb", 30)])) for i in (7, 8)]
        want = check_repeats(spark, docs)
        assert len(want[8]) >= 54 and not any(want[i] for i in range(7))


# ---------------------------------------------------------------- decontamination


def test_tiles_against_all_places():
    rng = random.Random(14)
    for _ in range(200):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 14))]
        text = [rng.randrange(7) for _ in range(rng.randrange(0, 30))]
        assert decontam.greedy_tiles(item, text, 3) == naive.tiles(item, text, 3)


def test_leaks(spark, monkeypatch):
    rng = random.Random(15)
    items = [(k, invented(rng, "aa", rng.randrange(15, 50))) for k in range(12)]
    rows, planted = [], set()
    for i in range(90):
        text = invented(rng, "bb", rng.randrange(30, 200)).split(" ")
        if i % 6 == 0:
            k = rng.randrange(12)
            w = items[k][1].split(" ")
            if i % 12 == 0:  # in another order, with other words in between
                third = len(w) // 3
                w = w[2 * third :] + ["zzz", "yyy"] + w[:third] + ["xxx"] + w[third : 2 * third]
            at = rng.randrange(len(text))
            text[at:at] = [x.upper() if i % 18 == 0 else x for x in w]
            planted.add((i, k))
        rows.append((i, " ".join(text).replace(" zzz", ", zzz!"), None, None, 0))
    rows += [(100 + k, t, None, None, 0) for k, t in enumerate(NASTY)] + [(200, "say Two words, please", None, None, 0), (201, "two wordsmiths", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([*items, items[0], (50, None), (51, ""), (52, "two words"), (None, "a b c d e f")], "item_id long, text string")
    got = decontam.find_leaks(docs, bench).collect()
    short = {(r[0], 52) for r in rows if re.search(r"(?i)(?<![0-9a-z])two\W+words(?![0-9a-z])", r[1] or "")}
    planted |= short
    assert {(r.doc_id, r.item_id) for r in got} == planted and all(r.coverage >= 0.5 for r in got) and short
    assert any(r.n_tiles >= 3 for r in got)
    monkeypatch.setattr(decontam, "SEEDS_AT_ONCE", 60)
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()} == planted
    left = decontam.drop_leaks(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {i for i, _ in planted}
    assert decontam.find_leaks(docs.where("false"), bench).count() == decontam.find_leaks(docs, bench.where("false")).count() == 0
    assert decontam.drop_leaks(docs, bench.where("false")).count() == len(rows)


def test_leaks_in_scripts_without_spaces(spark):
    item = "天地玄黄宇宙洪荒日月盈昃辰宿列张"
    docs = spark.createDataFrame([(1, f"前言：{item}。后记"), (2, "日月盈昃辰宿列张，天地玄黄宇宙洪荒"), (3, "天地会的故事，玄黄之间"), (4, "«esto» ¿no?")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "esto no")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()} == {(1, 7), (2, 7), (4, 8)}


#: A few words of ten scripts, and marks of each that end a word.
SCRIPTS = {
    "latin": ("straße naïve garden stone light œuvre paper", ",;!"), "greek": ("λόγος ποταμός πέτρα φως κήπος χαρτί πρωί", "·;,"), "cyrillic": ("река камень свет сад бумага утро окно", "«»,"), "arabic": ("نهر حجر ضوء حديقة ورق صباح نافذة", "،؛؟"),
    "hebrew": ("נהר אבן אור גן נייר בוקר חלון", "־׃׀"), "armenian": ("գետ քար լույս այգի թուղթ առավոտ պատուհան", "՝։՞"), "devanagari": ("नदी पत्थर प्रकाश बगीचा कागज सुबह खिड़की", "।॥,"), "georgian": ("მდინარე ქვა სინათლე ბაღი ქაღალდი დილა ფანჯარა", "჻,."),
    "chinese": ("河石光园纸晨窗", "，。、"), "hangul": ("강물 돌멩이 불빛 정원 종이 아침 창문", "·,!"),
}


def passage(rng, script, n):
    words, marks = SCRIPTS[script]
    words = list(words) if script == "chinese" else words.split()
    return "".join(rng.choice(words) + str(rng.randrange(90)) * (rng.random() < 0.3) + rng.choice([" ", " ", rng.choice(marks) + " ", rng.choice(marks), "×", "÷ ", " — ", "… "]) for _ in range(n))


def cut(text):
    return [x for _, h, _ in decontam.tokens(pa.array([text])) for x in h.tolist()]


def test_words_are_the_same_wherever_a_passage_stands():
    """The rule that cuts words is one for each character: nothing around a passage changes its words."""
    rng = random.Random(41)
    for script in SCRIPTS:
        for _ in range(30):
            inside = passage(rng, script, rng.randrange(1, 12))
            before, after = (passage(rng, rng.choice(list(SCRIPTS)), rng.randrange(0, 6)) for _ in range(2))
            assert cut(f"{before} {inside} {after}") == cut(before) + cut(inside) + cut(after)
    assert len(cut("3×4 ÷ 5 naïve ßa")) == len(cut("3×4 ÷ 5 naïve ßa —")) == 5


def test_a_whole_item_is_found_in_any_surroundings(spark):
    rng = random.Random(42)
    items = [(k, passage(rng, script, 20)) for k, script in enumerate(SCRIPTS)]
    around = [("", ""), ("نص — ", " — نص"), ("a×b ", " «x»"), ("。", "、"), ("plain ", " text"), ("— ", "")]
    rows = [(100 * k + j, a + t + b) for k, t in items for j, (a, b) in enumerate(around)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.coverage for r in decontam.find_leaks(docs, bench).collect()}
    assert {(i, i // 100): 1.0 for i, _ in rows}.items() <= found.items()
    assert decontam.drop_leaks(docs, bench).count() == 0


def plain_leaks(rows, items):
    """Every document against every item, by the naive tiling over words that a pattern finds."""
    pattern = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]|[^\p{P}\p{S}\p{Z}\p{Cc}\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")
    number = {}
    words = lambda t: [number.setdefault(w, len(number)) for w in pattern.findall((t or "").lower())]
    found = set()
    for i, text in rows:
        w = words(text)
        for k, item in items:
            v = words(item)
            if not v:
                continue
            if len(v) < decontam.MATCH:
                hit = any(w[p : p + len(v)] == v for p in range(len(w) - len(v) + 1))
            else:
                hit = sum(n for *_, n in naive.tiles(v, w, decontam.MATCH)) >= decontam.COVERAGE * len(v)
            if hit:
                found.add((i, k))
    return found


def test_leaks_against_every_pair(spark):
    """The query's rows, over random texts of ten scripts with parts of items in any order, against the naive tiling of all pairs."""
    rng = random.Random(43)
    names = list(SCRIPTS)
    items = [(k, passage(rng, rng.choice(names), rng.choice([2, 3, 9, 15, 25]))) for k in range(25)] + [(90, None), (91, ""), (92, "—")]
    rows = []
    for i in range(120):
        parts = [passage(rng, rng.choice(names), rng.randrange(0, 15))]
        for _ in range(rng.randrange(3)):
            words = rng.choice(items[:25])[1].split(" ")
            a = rng.randrange(len(words))
            parts.insert(rng.randrange(len(parts) + 1), " ".join(words[a : a + rng.randrange(1, len(words) + 1)]))
        rows.append((i, " ".join(parts)))
    rows += [(900, None), (901, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert found == plain_leaks(rows, items) and len(found) > 40
    assert {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in found}


def test_sets_of_many_shared_buckets_are_tied_once(spark, monkeypatch):
    """Near copies share many large buckets: ties found in all of them don't add up, and what links reach stays the same."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(500):
        text = list(base)
        for at in rng.choice(150, int(rng.integers(1, 8)), replace=False).tolist():
            text[at] = f"x{rng.integers(1 << 40)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = jaccard._plausible_ties
    monkeypatch.setattr(jaccard, "_plausible_ties", lambda *a: (lambda found: seen.append(found.count()) or found)(plain(*a)))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 4, 85, 100).collect()}
    sets = [{tuple(t[k : k + 4]) for k in range(len(t) - 3)} for t in (text.split() for _, text in rows)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(500):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {k: find(k) for k in range(500)}
    assert len(seen) == 2 and sum(seen) <= 3000, seen


def test_short_texts_and_unlike_sets_make_no_ties(spark, monkeypatch):
    """Sets too small to be like any but equal ones have no signatures; sets of which half is the same aren't taken for candidates."""
    word = lambda k, j: f"w{k}x{j}"
    rows = [(k, " ".join(word(k % 390, j) for j in range(4 + k % 4))) for k in range(400)]  # 1 to 3 shingles; 390 to 399 stand already
    rows += [(400, " ".join(word(400, j) for j in range(8))), (401, " ".join(word(400, j) for j in range(9)))]  # 4 of 5: just alike
    seen = []
    plain = jaccard._plausible_ties
    monkeypatch.setattr(jaccard, "_plausible_ties", lambda *a: (lambda found: seen.append(found.count()) or found)(plain(*a)))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()}
    first: dict = {}
    assert got == {k: first.setdefault(t, k) for k, t in rows[:-1]} | {401: 400} and sum(seen) == 0, seen
    rng = np.random.default_rng(6)
    common = rng.integers(1 << 63, size=250).astype(np.uint64)
    for n in (500, 600, 1000):
        sets = [np.unique(np.append(common, rng.integers(1 << 63, size=n - 250).astype(np.uint64))) for _ in range(60)]
        rows = jaccard._counters([jaccard.sketch(s) for s in sets], 2 * len(jaccard.sketch(sets[0])))
        size = np.full(59, n)
        assert sum(int(jaccard.plausible(rows[k][None, :], np.delete(rows, k, 0), n, size, 80, 100).sum()) for k in range(60)) == 0


def test_texts_of_which_nothing_is_needed_are_not_shuffled(spark):
    docs = spark.range(20000).select("id", F.lit("a text").alias("text"))
    docs = docs.unionByName(docs.where("id < 3"))  # ids may stand for several rows
    found = [r.id for r in jaccard._asked(docs, docs.where("id % 100 = 0").select("id")).collect()]
    assert {k for k in range(20000) if k % 100 == 0} <= set(found) and found.count(0) == 2 and len(found) < 300
    assert jaccard._asked(docs, docs.where("id < 0").select("id")).count() == 0
