"""Toxicity by maximum-scoring segments.

Words get log-odds between toxic and other documents under an informative Dirichlet prior; those
significantly more frequent in toxic ones make a lexicon, all other words cost a little. A
linear-time scan finds every maximal scoring segment of a text. Segment scores are calibrated by
the extreme-value law of the best segments of clean documents, and a document's evidence (its best and
its summed significant segments) is mapped to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, SLICE_BYTES, discard, map_arrow, scratch_table, signed, utf8, words

#: A word is in the lexicon from this z-score and these log-odds on; a segment is significant below this p-value.
LEAST_Z, LEAST_ODDS, LEAST_P = 4.0, 1.0, 0.01

#: Imagined texts in the Dirichlet prior.
PRIOR = 20.0

#: A word is known by itself and by its beginnings of so many bytes; the highest score counts.
PREFIXES = (4, 5, 6, 7, 8, 9)


@dataclass
class Model:
    """What scoring needs; bounded by the number of lexicon words."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = 0.01
    lam: float = 1.0
    place: float = 0.0
    scale: float = 1.0
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0)


def maximal_segments(places: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """(first place, last place, score) of all maximal scoring segments, where the words at ``places`` have
    positive ``scores`` and all others cost ``drift``.

    One pass in the manner of Ruzzo and Tompa: a list of candidates with the running total
    at their left and right ends, each with the nearest earlier one whose left end is lower. A new one joins back to its own such
    neighbour, unless that one's right end is as high; where there is none, all before it are final. Each candidate is passed
    over once: time is linear in the positive words, and only these are visited.
    """
    final: list[tuple[int, int, float]] = []
    held: list[tuple[int, int, float, float, int]] = []  # first, last, left total, right total, neighbour
    total, before = 0.0, 0
    for p, s in zip(places.tolist(), scores.tolist()):
        total -= drift * (p - before)
        before = p + 1
        first, left = p, total
        total += s
        k = len(held) - 1
        while k >= 0 and held[k][2] >= left:
            k = held[k][4]
        while k >= 0 and held[k][3] < total:
            first, _, left, _, lower = held[k]
            del held[k:]
            k = lower
        if k < 0:
            final += [(a, b, r - l) for a, b, l, r, _ in held]
            held.clear()
        held.append((first, p, left, total, k))
    return final + [(a, b, r - l) for a, b, l, r, _ in held]


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes of words and their beginnings, start bytes, end bytes) of each text in lower case."""
    column = pc.utf8_lower(pc.fill_null(column, ""))
    data, at = utf8(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + 2 * SLICE_BYTES, "right")) - 1)
        h, start, end, offsets = words(data, at[low : high + 1], LETTERS, PREFIXES)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            yield h[a:b], start[a:b] - at[low + i], end[a:b] - at[low + i]
        low = high


def _segments(model: Model, h: np.ndarray) -> list[tuple[int, int, float]]:
    if not len(h) or not len(model.words):
        return []
    k = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
    score = np.where(model.words[k] == h, model.scores[k], 0.0).max(axis=1)
    hit = np.flatnonzero(score)
    return maximal_segments(hit, score[hit], model.drift)


def _p_value(model: Model, score: float, n: int) -> float:
    x = (model.lam * score - np.log(max(n, 1)) - model.place) / model.scale
    return float(-np.expm1(-np.exp(-min(max(x, -30.0), 700.0))))


def _evidence(model: Model, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
    """Minus log p of the best segment; and the summed scores of significant ones, per log word."""
    if not segments:
        return 0.0, 0.0
    best = max(s for _, _, s in segments)
    most = -np.log(max(_p_value(model, best, n), 1e-30))
    summed = sum(s for _, _, s in segments if _p_value(model, s, n) < LEAST_P)
    return float(most), float(np.log1p(summed))


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 1e-3 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_words: int = 50_000, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled rows.

    ``most_rows`` bounds the labelled rows that are used (by hash of id, about that many where there are
    more); ``most_words`` the lexicon. They are written once, whole, and read from there. Of repeated labels the largest counts, of
    rows that repeat an id the least text; rows and labels without id, text or label teach nothing. With no toxic or no other
    row, the model calls all clean.
    """
    labels = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = labels.count()
    order = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30))
    chosen = labels.where(order < int((1 << 30) * min(1.0, most_rows / max(n, 1))))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(chosen), "id")  # at most about most_rows pairs of numbers
    rows, sample = scratch_table(rows.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "text"), "sample")
    model = _fit(rows, most_words)
    discard(docs.sparkSession, sample)
    return model


def _fit(rows: DataFrame, most_words: int) -> Model:
    """A model from rows (y, text)."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        y = batch.column(0).to_numpy()
        # a text counts once for each word in it, and once at word 0: a text that repeats itself is one witness
        found = [(np.unique(np.append(h.ravel(), np.uint64(0))), y[k]) for k, (h, _, _) in enumerate(_texts(batch.column(1)))]
        h = np.concatenate([h for h, _ in found])
        t = np.repeat(np.array([v for _, v in found]) > 0, [len(h) for h, _ in found])
        u, at = np.unique(h, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(np.bincount(at[t], minlength=len(u))), pa.array(np.bincount(at[~t], minlength=len(u)))], ["w", "y1", "y0"])

    counts = map_arrow(rows, count, "w long, y1 long, y0 long").groupBy("w").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    counts, place = scratch_table(counts, "words")
    total = counts.where("w = 0").first()
    n1, n0 = (total.y1, total.y0) if total else (0, 0)
    if not n1 or not n0:
        return Model()
    # the prior of a word: as many of PRIOR imagined texts as its share of all
    prior = (F.col("y1") + F.col("y0")) * (PRIOR / (n1 + n0))
    a, b = F.col("y1") + prior, F.col("y0") + prior
    delta = F.log(a / (n1 + PRIOR)) - F.log(b / (n0 + PRIOR))
    z = delta / F.sqrt(1 / a + 1 / b)
    lexicon = counts.where("w <> 0 and y1 > 1").select("w", delta.alias("d"), z.alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("d") >= LEAST_ODDS)).orderBy(F.desc("z"), "w").limit(most_words).collect()
    discard(rows.sparkSession, place)
    if not lexicon:
        return Model()
    w = np.array([r.w for r in lexicon], np.int64).view(np.uint64)
    order_w = np.argsort(w)
    model = Model(w[order_w], np.array([r.d for r in lexicon])[order_w])
    # how often a word scores, in toxic and in other documents, and what it then scores
    def hits(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for y, (h, _, _) in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
            out += [(y, s) for _, _, s in _segments(Model(model.words, model.scores, 1e9), h)]
            out.append((y + 2, float(len(h))))
        return pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int32()), pa.array([s for _, s in out])], ["y", "s"])

    seen = map_arrow(rows.select(F.expr("int(y > 0)").alias("y"), "text"), hits, "y int, s double")
    # scores are those of lexicon words: no more different ones than these
    by = seen.groupBy("y", F.when(F.col("y") == 0, F.col("s")).alias("s")).agg(F.count("*").alias("n"), F.sum("s").alias("sum")).collect()
    n_hits = {y: sum(r.n for r in by if r.y == y) for y in (0, 1)}
    clean_words, toxic_words = (sum(r["sum"] for r in by if r.y == y) for y in (2, 3))
    p1 = n_hits[1] / max(toxic_words, 1.0)
    p0 = (n_hits[0] + 0.5) / (clean_words + 1)
    model.drift = max(1e-4, float(np.log1p(-min(p0, 0.9)) - np.log1p(-min(p1, 0.9))))
    # lambda: the root of the expected exp(lambda * score) = 1 over words of clean documents
    clean_hits = sorted((r.s, r.n) for r in by if r.y == 0) or [(float(model.scores.mean()), 1)]
    seen_scores, times = (np.array(c, float) for c in zip(*clean_hits))
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        grown = float(p0 * np.average(np.exp(np.minimum(mid * seen_scores, 600)), weights=times) + (1 - p0) * np.exp(-mid * model.drift))
        low, high = (mid, high) if grown < 1 else (low, mid)
    model.lam = max(low, 1e-3)

    def measure(held: Model):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for h, _, _ in _texts(batch.column(1)):
                found = _segments(held, h)
                out.append((len(h), max((s for _, _, s in found), default=0.0), *_evidence(held, found, len(h))))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in np.array(out, float).T)], ["y", "n", "best", "most", "summed"])

        return map_arrow(rows, run, "y int, n double, best double, most double, summed double").toPandas()

    clean = measure(model).query("y == 0 and n > 0 and best > 0")
    if len(clean) >= 20:
        # extreme-value law of the best segment of clean texts, by the median and the quartiles' distance
        x = model.lam * clean.best.to_numpy() - np.log(clean.n.to_numpy())
        q = np.quantile(x, [0.25, 0.5, 0.75])
        model.scale = max(1e-3, float((q[2] - q[0]) / 1.5725))
        model.place = float(q[1] - 0.3665 * model.scale)
    seen = measure(model)
    model.weights = _fit_logistic(seen[["most", "summed"]].to_numpy(), (seen.y > 0).to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted, segments) per row of ``docs``.

    ``score`` is 0 to 1, predicted = 1 if it is >= 0.5. ``segments`` are the significant toxic passages: bytes
    ``start`` to ``end`` of the text, their score and p-value. A null or empty text has no segment and the
    score of no evidence. Other columns are ignored; equal texts score alike, and an empty table has no rows. Long texts are scanned whole,
    slice by slice.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = sent.value
        scores, segments = [], []
        for h, start, end in _texts(batch.column(1)):
            found = _segments(held, h)
            x = np.dot(held.weights, (1.0, *_evidence(held, found, len(h))))
            scores.append(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))
            tested = [(a, b, s, _p_value(held, s, len(h))) for a, b, s in found]
            segments.append([{"start": int(start[a]), "end": int(end[b]), "score": s, "p": p} for a, b, s, p in tested if p < LEAST_P])
        s = np.array(scores)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(segments, kind)], ["id", "score", "predicted", "segments"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return map_arrow(rows, run, "id long, score double, predicted int, segments array<struct<start:long,end:long,score:double,p:double>>").withColumnRenamed("id", id)


def score_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``score`` for all rows, learned from labels whose fold (crc32 of id mod 5) isn't 0."""
    held_out = F.pmod(F.crc32(F.col(id).cast("string")), F.lit(5)) == 0
    model = learn(docs, labels.where(~held_out), id=id, text=text, label=label)
    return score(docs, model, id, text).select(id, held_out.alias("held_out"), "score", "predicted", "segments")
