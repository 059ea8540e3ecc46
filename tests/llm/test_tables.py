"""Manifest, token alignment, quality rules: against plain versions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cellweave.llm import align, merkle, quality

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, TREE string, part string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- manifest


def plain_leaf(r, text):
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(put, (r[0], r[1], r[2], r[3], text))))


def plain_levels(nodes):
    """All levels of a tree, from its leaves to the one node that remains."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[k : k + 8])) for k in range(0, len(below), 8)])
    return levels


def plain_sides(levels, k):
    for level in levels[:-1]:
        first = k - k % 8
        yield "".join(level[first:k]), "".join(level[k + 1 : first + 8])
        k //= 8


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[4])))
        trees[g] = plain_levels([plain_leaf(r, r[4]) for r in groups[g]])
    over = plain_levels([trees[g][-1][0] for g in names])
    root, out = over[-1][0], []
    for at, g in enumerate(names):
        for k, r in enumerate(groups[g]):
            sides = [*plain_sides(trees[g], k), *plain_sides(over, at)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4] or "")
            value = plain_leaf(r, low) if hit else trees[g][0][k]
            for a, b in sides:
                value = sha(a + value + b)
            out.append((r[0], trees[g][0][k], trees[g][-1][0], root, sha("".join(a + b for a, b in sides)), value, value == root))
    return sorted(out, key=str)


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    return [(k * 3 - 5, rng.choice(["s", None, "é"]), langs[int(len(langs) * rng.random() ** 2)], rng.choice([7, None]), rng.choice(["Word é", "low", "", None, "X" * 5000]), "clash", "clash") for k in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["a"]), (8, ["a"]), (9, [None]), (65, ["a", None]), (700, ["de", "b", None, "é", "", "Z"]), (300, [f"l{k}" for k in range(120)])])
def test_manifest_against_plain_version(spark, n, langs):
    rows = rows_of(n, langs)
    if n > 60:
        rows += [rows[3]] * 40 + [(None, "s", "a", 1, "No id", "c", "c"), (None, "s", "a", 1, "No id", "c", "c")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = sorted((tuple(r) for r in merkle.tampered_proofs(df).collect()), key=str)
    assert got == plain_manifest(rows)


def test_manifest_over_many_partitions(spark, monkeypatch):
    """Three layers of merging, and stretches that begin and end anywhere in a run of siblings."""
    monkeypatch.setattr(merkle, "FAN", 3)
    rows = rows_of(500, ["a", "b", None], 5)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tree = merkle.build(spark.createDataFrame(rows, SCHEMA).repartition(5))
        assert len(tree.layers) >= 4 and tree.rows == 500 and tree.groups == 3
        got = sorted((tuple(r) for r in merkle.prove(tree).collect()), key=str)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    want = plain_manifest(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want] and all(r[6] for r in got)


def test_manifest_of_nothing(spark):
    found = merkle.tampered_proofs(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and found.columns[0] == "doc_id"


def test_forests_merge_in_any_order():
    rng = random.Random(4)
    leaves = [(g, k, n) for g, n in enumerate([1, 8, 9, 64, 70, 3]) for k in range(n)]
    roots = set()
    for _ in range(20):
        rng.shuffle(leaves)
        cuts = sorted(rng.sample(range(len(leaves)), 6))
        parts = []
        for a, b in zip([0, *cuts], [*cuts, len(leaves)]):
            one = merkle.Forest(6)
            for g, k, n in leaves[a:b]:
                one.add(g, 0, k, n, merkle.digest(f"{g}/{k}".encode()))
            parts.append(one)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].merge(parts[k + 1])]
        assert len(parts[0].nodes) == 1
        roots.update(v for _, v in parts[0].nodes.values())
    assert len(roots) == 1


# ---------------------------------------------------------------- quality


def plain_counts(text):
    words, here = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            words += [here] if here else []
            here = ""
        else:
            here += c
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    inside = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def noise(rng, n, letters):
    return "".join(rng.choice(letters) for _ in range(n))


def test_counts_against_plain_version():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", "#", "<", " ", " ", "\n", "\t", "\r", "\v", " ", " ", "\x1c", "漢"]) for _ in range(rng.randrange(120)))
        assert quality.base_counts(text) == plain_counts(text)
        words = [rng.choice("ab") for _ in range(rng.randrange(40))]
        assert quality.base_counts(" ".join(words))[4] == plain_counts(" ".join(words))[4]


def prose(rng, n):
    stems = ["the", "of", "river", "walk", "stone", "light", "under", "garden", "old", "morning", "paper", "quiet", "and", "window", "letter", "near"]
    return " ".join(rng.choice(stems) + rng.choice(["", "", "s", "ed", "ing", "er"]) for _ in range(n))


def test_quality_rows(spark):
    import base64

    rng = random.Random(9)
    base64_words = lambda n: " ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(n))
    cases = {
        1: (prose(rng, 40), True), 2: (prose(rng, 5000), True), 3: (None, False), 4: ("", False), 5: ("too few words", False), 6: (base64_words(40), False), 7: (base64_words(900), False),
        8: (prose(rng, 2000) + "\n" + base64_words(600), False),  # a third of it is noise: the whole shrinks enough, chunks don't
        9: ("ab " * 3000, False), 10: (prose(rng, 20) + " " + "0" * 30_000, False), 11: (prose(rng, 4000) + " " + base64_words(20), True),
    }
    rows = [(k, t, "clash") for k, (t, _) in cases.items()] + [(None, prose(rng, 30), "c"), (1, cases[1][0], "c")]
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            text, kept = cases[r.doc_id]
            assert r.kept == kept, r
            if len(text or "") < 4000:
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(text or "")
            assert not (r.kept and r.base_failed)
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_narrow_with_length():
    highs = [b[2] for b in quality.BANDS]
    assert highs == sorted(highs, reverse=True) and quality.BANDS[-1][0] == float("inf")
    strict = quality.Bands(((float("inf"), 0.5, 0.6),), chunk_bytes=10, bad_share=1.0)
    assert strict.judge(b"x" * 100, lambda b: b[:55])[2] and not strict.judge(b"x" * 100, lambda b: b[: len(b) // 4])[2]


# ---------------------------------------------------------------- token alignment


@pytest.fixture(scope="module")
def paths():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


def plain_alignment(rows, paths):
    """By the libraries alone, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    letters = merkle_free_letters()
    docs, count = [], {}
    for _, text in rows:
        out = ([], [], [])
        if text:
            ia = a.encode(" " + text, add_special_tokens=False).ids
            ib = b.encode(text)
            ta = [bytes(letters[c] for c in a.id_to_token(k)) for k in ia]
            tb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ib]
            if b"".join(ta) == b"".join(tb) == (" " + text).encode():
                ea, eb = ([sum(map(len, t[: k + 1])) for k in range(len(t))] for t in (ta, tb))
                links = [(i, j) for i in range(len(ia)) for j in range(len(ib)) if ea[i] == eb[j]]
                out = (ia, ib, links)
                for i, j in links:
                    count[ia[i], ib[j]] = count.get((ia[i], ib[j]), 0) + 1
        docs.append(out)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    found = []
    for (k, _), (ia, ib, links) in zip(rows, docs):
        parts, p, q = [], 0, 0
        for i, j in links:
            parts.append(",".join(map(str, ia[p : i + 1])) + "|" + ",".join(map(str, ib[q : j + 1])))
            p, q = i + 1, j + 1
        ns = [count[ia[i], ib[j]] for i, j in links]
        found.append((k, len(ia), len(ib), len(parts), len(links), sum(n == best[ib[j]] for n, (_, j) in zip(ns, links)), sum(ns), sha(";".join(parts)) if parts else ""))
    return sorted(found, key=str), count


def merkle_free_letters():
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


def texts(seed=6, n=60):
    rng = random.Random(seed)
    some = ["the ", "river ", "é", "漢字", "\n", "  ", "don't ", "123,456 ", "\t", "<0x0A>", "<|endoftext|>", "</s>", "🙂", "naïve ", "Straße ", "́", "_x_", " ", "a" * 40, "привет "]
    rows = [(k, "".join(rng.choice(some) for _ in range(rng.randrange(1, 50)))) for k in range(n)]
    return rows + [(500, None), (501, ""), (502, " "), (503, "▁x"), (504, "a\x00b"), (505, "e" * 5000), (506, "Some words again. " * 400), (7, rows[7][1]), (None, "no id")]


def test_alignment_against_plain_version(spark, paths, monkeypatch):
    monkeypatch.setattr(align, "JOIN_BYTES", 700)
    rows = texts()
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, kind string").repartition(3)
    found = align.align(df, *paths)
    want, count = plain_alignment(rows, paths)
    assert sorted((tuple(r) for r in found.documents.collect()), key=str) == want
    assert {(r.a_id, r.b_id): r.n for r in found.pairs.collect()} == count
    assert align.align(df.where("false"), *paths).documents.count() == 0


def test_long_texts_are_joined_in_pieces(spark, paths, monkeypatch):
    rows = texts(9, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted((tuple(r) for r in align.align(df, *paths).documents.collect()), key=str)
    monkeypatch.setattr(align, "PIECE_TOKENS", 13)
    aligner = align.Aligner(*paths)
    _, ids, _ = aligner.tokens(["Words and more words. " * 300])
    pieces = list(aligner._pieces(ids))
    assert len(pieces) > 50 and pieces[0][0] == 0 and pieces[-1][1] == len(ids[0]) and pieces[-1][3] == len(ids[1])
    linked = align.linkable(aligner.a.bytes, aligner.b.bytes)
    got = [[c.to_pylist() for c in align._documents([t or ""], aligner, linked)] for _, t in rows]
    assert sorted((k, g[0][0], g[1][0], g[2][0], len(g[4][0]), g[3][0]) for (k, _), g in zip(rows, got) if k is not None) == sorted((r[0], r[1], r[2], r[3], r[4], r[7]) for r in want if r[0] is not None)


def test_overlaps_against_plain_version(spark, paths):
    rows = [(k, t) for k, t in texts(8, 12) if t and len(t) < 2000]
    got = sorted((r.doc_id, r.a_token, r.b_token, r.start, r.stop) for r in align.overlapping_tokens(spark.createDataFrame(rows, "doc_id long, text string"), *paths).collect() if r.doc_id is not None)
    a, b = align.load(paths[0]), align.load(paths[1])
    want = []
    for k, t in rows:
        sides = []
        for model in (a, b):
            at, spans = 0, []
            for i in model.encode([t])[0]:
                spans.append((at, at + len(model.bytes[i] or b"?")))
                at = spans[-1][1]
            sides.append((spans, b"".join(model.bytes[i] or b"?" for i in model.encode([t])[0])))
        if k is not None and sides[0][1] == sides[1][1] == b" " + t.encode():
            want += [(k, i, j, max(p[0], q[0]), min(p[1], q[1])) for i, p in enumerate(sides[0][0]) for j, q in enumerate(sides[1][0]) if max(p[0], q[0]) < min(p[1], q[1])]
    assert got == sorted(want) and got


def test_both_ways_of_encoding_agree(paths):
    """Texts of settled characters take the fast way; both give the tokenizer's own ids, whatever white space and controls there are."""
    rng = random.Random(12)
    model = align.load(paths[0])
    assert model.fast is not None
    some = ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(33, 127), 32, 10, 0xA0, 0x85])) for _ in range(rng.randrange(1, 80))) for _ in range(1500)]
    assert [model.fast(" " + t) for t in some] == [e.ids for e in model.model.encode_batch([" " + t for t in some], add_special_tokens=False)]
    assert model.encode(["漢 <|endoftext|>", "x"]) == [e.ids for e in model.model.encode_batch([" 漢 <|endoftext|>", " x"], add_special_tokens=False)]


def test_linkable_pairs_are_those_with_a_common_end():
    a, b = [b"ab", b"b", b"xab", None], [b"ab", b" ab", b"c", b"", b"b"]
    want = [i * 5 + j for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x))]
    assert align.linkable(a, b).tolist() == want
