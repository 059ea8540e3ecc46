"""WARC, chat formatting, mixing, the pipeline."""

import base64
import hashlib
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from cellweave.llm import chat, mixing, warc
from tests.llm import naive
from tests.llm.test_near import corpus
from tests.llm.test_text import DOCS, NASTY, invented

PAGES = "page_id long, url string, html string"


def pages(spark):
    rng = random.Random(21)
    rows = [(k, f"http://x/{k}", "<p>" + invented(rng, "aa", rng.randrange(1, 60)) + "é") for k in range(80)]
    rows += [(200 + k, f"http://y/{k}\r\nX-Evil: 1", rows[k % 7][2]) for k in range(30)]
    rows += [(300, None, None), (301, "u", ""), (302, "u", None), (303, "v", "big " * 60_000), (5, "http://x/5", rows[5][2]), (None, "n", rows[2][2]), (None, "m", "only here")]
    return rows, spark.createDataFrame(rows, PAGES).withColumn("payload_bytes", F.lit("clash"))


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def files(folder):
    folder = folder.removeprefix("file://")
    return {n: open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if n.endswith(".warc.gz")}


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    folder, manifest = warc.write_archives(df, shard_bytes=60_000, roll_bytes=6_000)
    got = warc.read_archives(folder, manifest).collect()
    assert len(got) == len(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    first = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    for r in got:
        assert r.record_type == "revisit" or r.html is not None
        assert r.refers_to is None or r.refers_to == first[next(h for i, _, h in rows if i == r.page_id and b32(h) == r.payload_digest) or ""]
    want = sorted((i or -1, len((h or "").encode()), b32(h)) for i, _, h in rows)
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in got) == want
    responses = [r.payload_digest for r in got if r.record_type == "response"]
    assert len(responses) == len(set(responses)) == len({b32(h) for *_, h in rows})
    assert sorted(r.record_type for r in got if r.page_id == 5) == ["response", "revisit"]
    held = files(folder)
    assert len(held) > 3 and not [n for n in os.listdir(folder) if n.startswith("_temporary")]
    assert all(len(v) <= 6_000 or sum(1 for _ in warc.parse_archive(v)) == 2 for v in held.values())
    starts = [int(h["X-Page-ID"]) for n in held for h, _ in warc.parse_archive(held[n]) if "X-Page-ID" in h]
    assert starts == sorted(starts)
    again, _ = warc.write_archives(df.repartition(7), shard_bytes=60_000, roll_bytes=6_000)
    assert files(again) == held


def test_warc_least_bytes_and_nothing(spark):
    _, df = pages(spark)
    got = warc.read_archives(*warc.write_archives(df, least_bytes=10)).collect()
    assert {r.record_type for r in got if r.payload_bytes < 10} == {"response"}
    assert warc.read_archives(*warc.write_archives(df.where("false"))).count() == 0


def test_warc_reader_checks(spark):
    _, df = pages(spark)
    folder, manifest = warc.write_archives(df.where("page_id < 5"))
    name = next(iter(files(folder)))
    with open(f"{folder.removeprefix('file://')}/part-999999-00000.warc.gz", "wb") as f:
        f.write(files(folder)[name])  # not in the manifest
    assert warc.read_archives(folder, manifest).count() == 5
    with pytest.raises(ValueError):
        warc.write_archives(df, folder)


def damage(whole, how):
    return {"gone": None, "short": whole[: len(whole) // 2], "flipped": whole[:500] + bytes([whole[500] ^ 1]) + whole[501:], "doubled": whole + whole}[how]


@pytest.mark.parametrize("how", ["gone", "short", "flipped", "doubled"])
def test_no_record_is_lost_in_silence(spark, how):
    _, df = pages(spark)
    folder, manifest = warc.write_archives(df, shard_bytes=60_000, roll_bytes=6_000)
    held = files(folder)
    name = sorted(held)[1]
    place = f"{folder.removeprefix('file://')}/{name}"
    os.remove(place)
    if (left := damage(held[name], how)) is not None:
        with open(place, "wb") as f:
            f.write(left)
    with pytest.raises(Exception, match="(?s)(No such file|archive ends|manifest says|digest|length|decompress)"):
        warc.read_archives(folder, manifest).count()


def test_shards_of_one_id_and_of_none(spark):
    """Rows of one id, and rows without id, are spread over shards by digest, in order."""
    rng = random.Random(31)
    rows = [(7 if k % 2 else None, f"http://z/{k}", invented(rng, "aa", 200)) for k in range(120)]
    df = spark.createDataFrame(rows, PAGES)
    folder, manifest = warc.write_archives(df, shard_bytes=20_000)
    assert manifest.where("first = 7").select("shard").distinct().count() > 3 and manifest.where("first is null").select("shard").distinct().count() > 3
    assert sorted((r.page_id or -1, r.html) for r in warc.read_archives(folder, manifest).collect()) == sorted((i or -1, h) for i, _, h in rows)
    heads = [h for n, v in files(folder).items() for h, _ in warc.parse_archive(v) if h["WARC-Type"] != "warcinfo"]
    keys = [("X-Page-ID" not in h, base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:"))) for h in heads]
    assert keys == sorted(keys)


# ---------------------------------------------------------------- chat


def render(template, **names):
    return "".join(p for p, _ in chat.compile_template(template)(names))


def test_template_language():
    assert render("a{{ 'b' + x | upper }}{% if x == 'q' and not y %}1{% elif true %}2{% else %}3{% endif %}", x="q", y=False) == "abQ1"
    assert render("{% for i in xs %}[{{ i.a.b }}]{% endfor %}", xs=[{"a": {"b": 1}}, {"a": None}]) == "[1][]"
    assert render("{{ 1 + 2 }}{{ 'a\\n' }}{{ none_such }}{{ (1 == 1) or z }}") == "3a\ntrue"
    assert chat.fold(chat.parse("a{% if 1 == 2 %}x{% else %}b{{ 'c' | upper }}{% endif %}")) == (chat.Text("abC"),)
    for bad in ("{% for x in y %}", "{{ x.__class__ }}", "{{ f(1) }}", "{{ x | eval }}", "{% endif %}", "{{ }}", "{% import os %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_escape_is_reversible():
    rng = random.Random(22)
    for _ in range(500):
        text = "".join(rng.choice(["\\", "#", ":", "<", "### ", " </turn>\n", "Assistant: ", "é", "\n", " "]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text and "</turn>" not in chat.escape(text) and "###" not in chat.escape(text)


def naive_digests(rows):
    out = {}
    for key, turns in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for role, t in turns if role == "assistant")
        out[key] = (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_digests(spark):
    rng = random.Random(23)
    odd = ["\\", " </turn>\n", "### user: x </turn>\n", " ", "\n", "", None, "a: b <c> \\# ", "x </turn>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "od:d\n"]), rng.choice(odd) if rng.random() < 0.5 else invented(rng, "aa", 9)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(50, 0, "assistant", "b"), (50, 0, "assistant", "a"), (50, 0, "assistant", "a"), (51, None, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))
    probed = chat.with_probe(df)
    got = {r.conv_id: r for r in chat.digests(probed).collect()}
    want = naive_digests([*[r if r[1] is not None else (r[0], -1, *r[2:]) for r in rows], (-7, 0, "user", chat._PROBE), (-7, 1, "assistant", chat._PROBE)])
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    whole = {r.conv_id: r for r in chat.format_conversations(probed).collect()}
    for k, r in whole.items():
        turns = list(chat.read_turns(r.formatted))
        assert len(r.formatted) == got[k].formatted_chars and len(turns) == r.n_turns == got[k].n_turns
        loss = "".join(chat.unescape(r.formatted[s.start : s.end]) for s in r.loss)
        assert hashlib.sha256(loss.encode()).hexdigest() == got[k].loss_sha256
        assert loss == "".join(t for role, t, *_ in turns if role == "assistant")
    assert chat.digests(df.where("false")).count() == 0


def test_reader_knows_only_characters_and_spans():
    """Cut anywhere, the same output reads the same; what isn't a row of turns is refused."""
    rng = random.Random(25)
    turns = [{"role": rng.choice(["user", "assistant", "a: b"]), "text": rng.choice(["", " ", "x </turn>\n", "### assistant: y", "\\", "so </turn> it goes " * 9])} for _ in range(60)]
    marked = [(c, learned) for piece, learned in chat.compile_template(chat.TEMPLATE)({"messages": turns}) for c in piece]
    want = naive_digests([(1, k, t["role"], t["text"]) for k, t in enumerate(turns)])[1]
    for longest in (1, 3, 40):
        reader, at = chat._Reader(), 0
        while at < len(marked):
            stop = at + 1
            while stop < min(len(marked), at + longest) and marked[stop][1] == marked[at][1]:
                stop += 1
            reader.add("".join(c for c, _ in marked[at:stop]), marked[at][1])
            at = stop
        reader.end()
        assert (reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest()) == want and reader.chars == len(marked)
    reader = chat._Reader()
    reader.add("### user: x </turn>\n### left", False)
    with pytest.raises(ValueError):
        reader.end()
    with pytest.raises(ValueError):
        chat._Reader().add("no head: x </turn>\n", False)


# ---------------------------------------------------------------- mixing


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [3, 1, 2], 450, 2) == [200.0, 250 / 3, 500 / 3]
    assert mixing.water_fill([10, 1000], [3, 1], 1500, 2) == [20.0, 1480.0]
    assert mixing.water_fill([0, 0], [1, 1], 0, 2) == [0.0, 0.0]
    rng = random.Random(24)
    for _ in range(200):
        sizes = [rng.randrange(100) for _ in range(rng.randrange(1, 9))]
        weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
        got = mixing.water_fill(sizes, weights, 1.5 * sum(sizes), 2)
        assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 and all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes))
        free = [g / w for g, w, s in zip(got, weights, sizes) if g < 2 * s - 1e-9]
        assert not free or max(free) - min(free) < 1e-6


def best_cost(patterns, quotas, repeats):
    """Least cost of any flow that meets the most tokens: all ways to spread, by recursion."""
    best = None
    ways = [[w for w in itertools.product(range(repeats * size + 1), repeat=len(members)) if sum(w) <= repeats * size] for members, size in patterns]
    for choice in itertools.product(*ways):
        got = [0] * len(quotas)
        for (members, _), w in zip(patterns, choice):
            for m, x in zip(members, w):
                got[m] += x
        if any(g > q for g, q in zip(got, quotas)):
            continue
        cost = sum(c * min(size, max(0, sum(w) - (c - 1) * size)) for (_, size), w in zip(patterns, choice) for c in range(1, repeats + 1))
        key = (-sum(got), cost)
        best = key if best is None or key < best else best
    return best


def test_flow_is_of_least_cost():
    rng = random.Random(25)
    for _ in range(60):
        k = rng.randrange(1, 4)
        patterns = [(sorted(rng.sample(range(k), rng.randrange(1, k + 1))), rng.randrange(0, 3)) for _ in range(rng.randrange(1, 4))]
        quotas = [rng.randrange(0, 5) for _ in range(k)]
        flow = mixing.min_cost_flow([n for _, n in patterns], [(p, m, 2 * n) for p, (m, n) in enumerate(patterns)], quotas, 2)
        used = [sum(flow.get((p, s), 0) for s in range(k)) for p in range(len(patterns))]
        assert all(v >= 0 and s in patterns[p][0] for (p, s), v in flow.items())
        assert all(sum(flow.get((p, s), 0) for p in range(len(patterns))) <= quotas[s] for s in range(k))
        cost = sum(c * min(size, max(0, u - (c - 1) * size)) for (_, size), u in zip(patterns, used) for c in (1, 2))
        assert (-sum(used), cost) == best_cost(patterns, quotas, 2)


def best_shared_cost(sizes, classes, quotas, repeats):
    """(-words, cost) of the best flow of whole words, by trying all amounts for each class and source."""
    edges = [(c, s) for c, (_, members, _) in enumerate(classes) for s in members]
    best = (1, 0)

    def go(k, full, short, used):
        nonlocal best
        if k == len(edges):
            cost = sum(sum(min(x // n + 1 if n else repeats + 1, repeats + 1) for x in range(u)) for n, u in zip(sizes, used))
            best = min(best, (-sum(used), cost))
            return
        c, s = edges[k]
        p, _, most = classes[c]
        for amount in range(min(short[s], most - full[c]) + 1):
            full[c], short[s], used[p] = full[c] + amount, short[s] - amount, used[p] + amount
            go(k + 1, full, short, used)
            full[c], short[s], used[p] = full[c] - amount, short[s] + amount, used[p] - amount

    go(0, [0] * len(classes), list(quotas), [0] * len(sizes))
    return best


def test_flow_of_shared_texts_is_of_least_cost():
    """Several classes of a pattern, each with a limit of its own: words move from class to class and source to source."""
    rng = random.Random(35)
    for _ in range(150):
        k = rng.randrange(1, 4)
        sizes = [rng.randrange(0, 3) for _ in range(rng.randrange(1, 3))]
        classes = [(rng.randrange(len(sizes)), sorted(rng.sample(range(k), 1 if rng.random() < 0.7 else rng.randrange(1, k + 1))), rng.randrange(0, 5)) for _ in range(rng.randrange(1, 5))]
        quotas = [rng.randrange(0, 5) for _ in range(k)]
        flow = mixing.min_cost_flow(sizes, classes, quotas, 2)
        used, full = [0] * len(sizes), [0] * len(classes)
        for (c, s), v in flow.items():
            assert v > 0 and s in classes[c][1]
            used[classes[c][0]] += v
            full[c] += v
        assert all(f <= most for f, (_, _, most) in zip(full, classes)) and all(sum(v for (_, s), v in flow.items() if s == q) <= quotas[q] for q in range(k))
        cost = sum(sum(min(x // n + 1 if n else 3, 3) for x in range(u)) for n, u in zip(sizes, used))
        assert (-sum(used), cost) == best_shared_cost(sizes, classes, quotas, 2)


def test_mix_goes_through_the_flow(spark, monkeypatch):
    """Texts that several sources hold are one supply: what each source takes of them comes from the flow, and they are repeated less than if each
    source went by itself."""
    rng = random.Random(36)
    own = [(k, f"own{k} " + "w " * rng.randrange(5, 30), rng.choice("ab"), 0) for k in range(600)]
    both = [f"both{k} " + "w " * rng.randrange(5, 30) for k in range(200)]
    rows = own + [(1000 + 2 * k + j, t, "ab"[j], 0) for k, t in enumerate(both) for j in (0, 1)]
    rows += [(5000 + k, f"other{k} " * 20, "c", 0) for k in range(300)] + [(9000, None, None, 0), (9001, both[0], "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pattern int")
    seen = []
    plain = mixing.min_cost_flow

    def watched(*given):
        seen.append((given, plain(*given)))
        return seen[-1][1]

    monkeypatch.setattr(mixing, "min_cost_flow", watched)
    got = {r.doc_id: r for r in mixing.mix_sources(df, weights=(1,), share=1.0).collect()}
    (((sizes, classes, quotas, _), flow),) = seen
    words = {i: len((t or "").split()) for i, t, _, _ in rows}
    source = {i: s for i, _, s, _ in rows}
    assert len(sizes) == 3 and sizes[0] + sizes[1] + sizes[2] == sum(words[i] for i, *_ in own) + sum(len(t.split()) for t in both)
    for at, s in enumerate("ab"):
        routed = sum(v for (_, q), v in flow.items() if q == at)
        taken = sum(r.taken for i, r in got.items() if source[i] == s)
        assert routed == quotas[at] == round(next(r.target for i, r in got.items() if source[i] == s)) and abs(taken - routed) <= 60
    uses = {}
    for i, t, s, _ in rows:
        if s in ("a", "b"):
            uses[t] = uses.get(t, 0) + got[i].copies
    assert all(r.taken <= 2 * words[i] for i, r in got.items())
    # by itself each source would take the same share of all its rows, and so most shared texts twice
    again = sum((n - 1) * len(t.split()) for t, n in uses.items() if n > 1)
    rates = [quotas[k] / sum(words[i] for i, _, s, _ in rows if s == "ab"[k]) for k in (0, 1)]
    assert again < 0.85 * rates[0] * rates[1] * sum(len(t.split()) for t in both)


def test_mix(spark):
    rng = random.Random(26)
    rows = [(k, invented(rng, "aa", rng.randrange(0, 60)), "aa", rng.choice(["a", "b", "é", "Z", None]), 0) for k in range(1500)] + [(5000 + k, t, None, "a", 0) for k, t in enumerate(NASTY)]
    df = spark.createDataFrame(rows, DOCS).withColumn("taken", F.lit("clash"))
    got = {r.doc_id: r for r in mixing.mix_sources(df).collect()}
    sizes = {}
    for i, t, _, s, _ in rows:
        assert got[i].size == len(naive.WORD.findall(t or ""))
        sizes[s] = sizes.get(s, 0) + got[i].size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.water_fill([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes.values()), 2)))
    taken = dict.fromkeys(names, 0)
    for i, _, _, s, _ in rows:
        r = got[i]
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-9 and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 60 for s in names)
    again = {r.doc_id: r.taken for r in mixing.mix_sources(df.repartition(5)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    assert mixing.mix_sources(df.where("false")).count() == 0
    assert mixing.mix_sources(df.where("text = ''")).first().taken == 0


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(27)
    rows = [(k, "w " * rng.randrange(1, 9), rng.choice([["a"], ["a", "b"], ["b"], ["b", "c"], [], None])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix_sources(df, weights=(1,), share=1.0)
    total = got.agg(F.sum("size"), F.sum("taken")).first()
    assert abs(total[0] - total[1]) < 40 and got.where("copies > 2").isEmpty()


def naive_mix(rows, weights=(3, 1, 2), share=1.5):
    """{id: taken} of rows (id, size, source, order): each source's documents in their order, until its quota is met as near as may be."""
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    of = {s: sorted((h, n, i) for i, n, x, h in rows if x == s) for s in names} if len(names) < 100 else None
    if of is None:
        of = {s: [] for s in names}
        for i, n, s, h in rows:
            of[s].append((h, n, i))
        of = {s: sorted(v) for s, v in of.items()}
    sizes = [sum(n for _, n, _ in of[s]) for s in names]
    out = {}
    for s, size, target in zip(names, sizes, mixing.water_fill(sizes, [weights[k % len(weights)] for k in range(len(names))], share * sum(sizes), 2)):
        base, left = divmod(round(target), size) if size else (0, 0)
        for _, n, i in of[s]:
            more = left > 0 and (n <= left or 2 * left > n)
            left = left - n if n <= left else 0
            out[i] = n * min(2, base + more)
    return out


def test_mix_against_every_source_by_itself(spark):
    rng = random.Random(28)
    rows = [(k, "w " * rng.randrange(0, 30), "aa", rng.choice(["a", "b", "c", None, "d"]), 0) for k in range(2000)]
    df = spark.createDataFrame(rows, DOCS)
    order = {r.doc_id: r.h for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 64 - mixing.BITS * mixing.LEVELS).alias("h")).collect()}
    want = naive_mix([(i, len(t.split()), s, order[i]) for i, t, _, s, _ in rows])
    assert {r.doc_id: r.taken for r in mixing.mix_sources(df).collect()} == want


def test_mix_of_many_sources(spark):
    df = spark.range(52_000).selectExpr("id AS doc_id", "repeat('w ', int(id % 5)) AS text", "concat('host', id % 50000) AS source")
    got = mixing.mix_sources(df).toPandas()
    want = naive_mix([(int(k), int(k) % 5, f"host{k % 50000}", 0) for k in range(52_000)])
    assert len(got) == 52_000 and abs(got.taken.sum() / sum(want.values()) - 1) < 0.02
    assert (got.taken <= 2 * got["size"]).all() and got.target.max() <= 2 * got.source_size.max()


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from cellweave.llm import decontam, jaccard, langid, linedup

    texts = corpus(30, 120)
    items = [(k, invented(random.Random(k), "cc", 40)) for k in range(4)]
    texts += [f"{invented(random.Random(90 + k), 'bb', 40)} {items[k][1]}" for k in range(4)]
    docs = spark.createDataFrame([(k, t, ["aa", "bb", "cc"][k % 3], f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    state, want = spark.read.parquet(f"{sf}/documents.parquet"), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in state.collect()}
        after = stage(spark, state, sf)
        after.write.parquet(f"{sf}/stage{k}")
        state = spark.read.parquet(f"{sf}/stage{k}")
        rows = {r.doc_id: r for r in state.collect()}
        if k < 4:
            assert state.columns == docs.columns and rows.keys() <= before.keys()
        if k == 0:
            learned = langid.learn_dictionaries(docs.where(langid.fold_of("doc_id", 4) != 2))
            assert rows.keys() == {r.doc_id for r in langid.predict(docs, learned).where("accepted").collect()}
        if k == 1:
            assert all(r.n_chars == len(r.text) and len(r.text) <= len(before[i].text) for i, r in rows.items())
            cut = {r.id for r in linedup.repeated_runs(spark.read.parquet(f"{sf}/stage0")).collect()}
            assert all(r.text == before[i].text for i, r in rows.items() if i not in cut) and before.keys() - rows.keys() <= cut
        if k == 2:
            groups = naive.jaccard([(i, r.text) for i, r in before.items()], 5, 80, 100)
            assert rows.keys() == {i for i, (n, c) in groups.items() if i == c}
        if k == 3:
            leaked = {r.doc_id for r in decontam.find_leaks(spark.read.parquet(f"{sf}/stage2"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert rows.keys() == before.keys() - leaked and leaked
        want = rows
    total = sum(len(naive.WORD.findall(r.text)) for r in spark.read.parquet(f"{sf}/stage3").collect())
    assert abs(sum(r.taken for r in want.values()) - 1.5 * total) < 0.1 * total
    assert {r.doc_id: r.taken for r in corpus_pipeline.run(spark, sf).collect()} == {i: r.taken for i, r in want.items()}
    assert jaccard.keep_first is not None


def test_all_patterns_of_shared_texts_count(spark, monkeypatch):
    """Texts of 5000 pairs of sources: each is one supply of both. Many classes are routed group by group as few are at once."""
    rows = spark.range(10_000).selectExpr("id", "array(string(id)) AS members", "id div 2 AS k1", "id div 2 AS k2", "1 + id div 2000 AS size")
    found = mixing._shared(rows)
    assert (found.count(), found.select("pattern").distinct().count()) == (5000, 5000)
    texts = [(2 * k + j, f"s{k}_{j}", f"t{k} " * (9 + k)) for k in range(3) for j in range(2)]
    docs = spark.createDataFrame([*texts, (9, None, "t0 " * 9), (10, "alone", "x y"), (11, "s1_0", "own text here"), (12, "s2_1", "one more")], "doc_id long, source string, text string")
    read = lambda: sorted(mixing.mix_sources(docs).collect())
    want = read()
    monkeypatch.setattr(mixing, "AT_ONCE", 0)
    assert len(want) == 10 and read() == want
