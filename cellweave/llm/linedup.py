"""Line dedup: runs of words that stand earlier in the corpus, found by winnowing and deleted where they stand later.

Line feeds are white space like any other, so a passage is found wherever in a line it stands. With
``min_words`` = 20, every window of 20 words has a fingerprint: the least hash of its shingles of SHINGLE words. The windows
in a row that have one fingerprint are a span. Equal windows have equal fingerprints, so spans are joined by fingerprint:
equal spans repeat the first of them, window by window, and of unequal ones only the first of each kind are looked into:
their windows are hashed whole and joined. What repeats is then extended both ways, over all windows that follow
one another in a text. No two texts are compared, and no short quote hides a longer passage.

A fingerprint may stand in a third of all texts. Each task joins its own rows first and ships one row of each kind; a
fingerprint with over OFTEN kinds in a task ships one row that says so. So no fingerprint has more than
OFTEN rows of any task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, WORDS, discard, fresh, map_arrow, map_batches, mix, scratch_table, signed, utf8, words

#: Words of a shingle, of which a window's least is its fingerprint.
SHINGLE = 8

#: Rows that a task joins at a time, and kinds of a fingerprint from which it is frequent there.
CHUNK, OFTEN = 1 << 19, 8

_STEP = np.uint64(0xD6E8FEB86659FD93)


def _parts(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, hashes, starts, ends, offsets) of the words of some texts at a time, see words()."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + 2 * SLICE_BYTES, "right")) - 1)
        yield low, high, *words(data, at[low : high + 1], WORDS)
        low = high


def _least(hashes: np.ndarray, window: int) -> np.ndarray:
    """Where the least of every ``window`` hashes in a row is, the last one if equal."""
    at, size = np.arange(len(hashes)), 1
    while size < window:
        d = min(size, window - size)
        later = hashes[d:] <= hashes[:-d]
        hashes, at, size = np.where(later, hashes[d:], hashes[:-d]), np.where(later, at[d:], at[:-d]), size + d
    return at


def _runs_of(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` units."""
    out = units[: len(units) - k + 1]
    for j in range(1, k):
        out = out * _STEP + units[j : len(units) - k + 1 + j]
    return mix(out)


def _windows(h: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, chosen, fingerprints): of every window of ``min_words`` words of every text the first word, the first
    word of the least shingle, and that shingle's hash."""
    k = min(SHINGLE, min_words)
    if len(h) < min_words:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    end = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(min_words, len(h) + 1) <= end[: len(h) - min_words + 1])
    found = _runs_of(h, k)
    chosen = _least(found, min_words - k + 1)[starts]
    return starts, chosen, found[chosen]


# ---------------------------------------------------------------- joining rows by key

#: Kinds of rows: to be joined; the same, of a frequent key; windows that repeat others; first ones that must be looked into.
_JOIN, _FREQUENT, _REPEAT, _LOOK = range(4)

#: key; kind; kind of span under the key, or the source's id; place (id, th, start) of ``n`` windows in a row; the source's th and start.
_ROWS = "key long, kind byte, x long, id long, th long, start int, n int, y long, z int"
_TYPES = (pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
KEY, KIND, X, ID, TH, START, N, Y, Z = range(9)


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, _TYPES)], _NAMES)


def _first_of(rows: list[np.ndarray], some: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first) of the rows ``some``: sorted by group and place, and for each of them its group's first row."""
    order = some[np.lexsort((rows[START][some], rows[TH][some], rows[ID][some], groups))]
    g = np.sort(groups)
    begin = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else g
    return order, np.repeat(order[begin], np.diff(np.append(begin, len(g))))


def _later(rows: list[np.ndarray], order: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Those of ``order`` that stand elsewhere than their ``first``, as rows that repeat it.

    A repeated row of a table stands where its like does, and is no repeat.
    """
    apart = (rows[ID][order] != rows[ID][first]) | (rows[TH][order] != rows[TH][first]) | (rows[START][order] != rows[START][first])
    late, source = order[apart], first[apart]
    return [mix(rows[ID][late].view(np.uint64) + rows[START][late].astype(np.uint64)).view(np.int64), np.full(len(late), _REPEAT), rows[ID][source], rows[ID][late], rows[TH][late], rows[START][late], rows[N][late], rows[TH][source], rows[START][source]]


def _chunk(rows: list[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """What a task ships of its own rows: the first of each kind; others as repeats of it; frequent keys by one row."""
    both = mix(rows[KEY].view(np.uint64) * _STEP + rows[X].view(np.uint64)).view(np.int64)
    sort = np.argsort(both)
    same = both[sort][1:] == both[sort][:-1]
    many = np.append(same, False) | np.append(False, same)
    order, first = _first_of(rows, sort[many], both[sort[many]])
    yield _batch(_later(rows, order, first))
    stays = np.ones(len(both), bool)
    stays[order[order != first]] = False
    stays = np.flatnonzero(stays)
    sort = stays[np.argsort(rows[KEY][stays], kind="stable")]
    keys = rows[KEY][sort]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(keys)))
    often = np.repeat(size > most, size)
    kind = np.full(len(keys), _JOIN)
    kind[begin[size > most]] = _FREQUENT
    ship = ~often
    ship[begin] = True
    part = [c[sort[ship]] for c in rows]
    part[KIND] = kind[ship]
    yield _batch(part)
    look = [c[sort[often]] for c in rows]
    look[KIND] = np.full(int(often.sum()), _LOOK)
    look[KEY] = mix(look[ID].view(np.uint64) + look[START].astype(np.uint64)).view(np.int64)
    yield _batch(look)


def _chunked(parts: Iterator[list[np.ndarray]], chunk: int, most: int) -> Iterator[pa.RecordBatch]:
    """``_chunk`` of about ``chunk`` rows at a time."""
    held: list[list[np.ndarray]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= chunk:
            yield from _chunk([np.concatenate(c) for c in zip(*held)], most)
            held, size = [], 0
    if size:
        yield from _chunk([np.concatenate(c) for c in zip(*held)], most)


def _joined(shipped: DataFrame) -> DataFrame:
    """Repeats, and first rows to be looked into, of what tasks have shipped."""

    def resolve(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        done = rows[KIND] >= _REPEAT
        yield _batch([c[done] for c in rows])
        rows = [c[~done] for c in rows]
        key = rows[KEY]  # sorted
        if not len(key):
            return
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        some = np.flatnonzero(np.repeat(size > 1, size))
        if not len(some):
            return
        both = mix(key[some].view(np.uint64) * _STEP + rows[X][some].view(np.uint64))
        order, first = _first_of(rows, some, both)
        yield _batch(_later(rows, *(c[rows[KIND][order] != _FREQUENT] for c in (order, first))))  # all of a frequent key's are looked into
        # first rows of a key that has several kinds, or may have more that weren't shipped
        number = np.repeat(np.arange(len(begin)), size)
        kinds = np.bincount(number[order[order == first]], minlength=len(begin)) > 1
        kinds |= np.bincount(number, weights=rows[KIND] == _FREQUENT, minlength=len(begin)) > 0
        look = order[(order == first) & kinds[number[order]] & (rows[KIND][order] != _FREQUENT)]
        part = [c[look] for c in rows]
        part[KIND] = np.full(len(look), _LOOK)
        yield _batch(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy() for c in batch.columns]
            cut = int(np.searchsorted(rows[KEY], rows[KEY][-1]))
            if cut:
                yield from resolve([np.concatenate(c) for c in zip(*held, [r[:cut] for r in rows])])
                held = []
            elif held and held[-1][KEY][-1] != rows[KEY][0]:
                yield from resolve([np.concatenate(c) for c in zip(*held)])
                held = []
            held.append([r[cut:] for r in rows])
        if held:
            yield from resolve([np.concatenate(c) for c in zip(*held)])

    return map_batches(shipped.repartition("key").sortWithinPartitions("key"), run, _ROWS)


# ---------------------------------------------------------------- spans and windows


def _spans(docs: DataFrame, min_words: int) -> DataFrame:
    """The spans of all texts, as tasks ship them."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for low, _, h, _, _, offsets in _parts(*utf8(batch.column(2))):
                starts, chosen, fp = _windows(h, offsets, min_words)
                if not len(starts):
                    continue
                begin = np.flatnonzero(np.diff(chosen, prepend=-1))
                n = np.diff(np.append(begin, len(starts)))
                grams = _runs_of(h, min_words)
                # its first and last window hold all words of a span
                span = mix((grams[starts[begin]] * _STEP + grams[starts[begin] + n - 1]) * _STEP + n.astype(np.uint64))
                row = np.searchsorted(offsets, starts[begin], "right") - 1
                zero = np.zeros(len(begin), np.int64)
                yield [signed(fp[begin]), zero, signed(span), ids[low + row], ths[low + row], starts[begin] - offsets[row], n, zero, zero]

    chunk, often = CHUNK, OFTEN
    return map_batches(docs.select("id", "th", "text"), lambda batches: _chunked(parts(batches), chunk, often), _ROWS)


def _looked_into(found: DataFrame, min_words: int) -> DataFrame:
    """Of rows (id, th, text, spans) the windows of the ``spans`` (start, n), by hash, as tasks ship them."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            ids, ths, spans = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            many, flat = spans.value_lengths().to_numpy(zero_copy_only=False), spans.flatten()
            begin, size = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            cuts = np.concatenate([[0], np.cumsum(many)])
            for low, high, h, _, _, offsets in _parts(*utf8(batch.column(2))):
                here = slice(cuts[low], cuts[high])
                n = size[here]
                row = np.repeat(np.repeat(np.arange(high - low), many[low:high]), n)
                start = np.repeat(begin[here], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                grams = _runs_of(h, min_words)[offsets[row] + start]
                zero = np.zeros(len(row), np.int64)
                yield [signed(grams), zero, zero, ids[low + row], ths[low + row], start, zero + 1, zero, zero]

    chunk, often = CHUNK, OFTEN
    return map_batches(found.select("id", "th", "text", "spans"), lambda batches: _chunked(parts(batches), chunk, often), _ROWS)


def _segments(repeats: DataFrame, min_words: int, merged: bool) -> DataFrame:
    """(id, th, first, last, n_words, sid, sfirst): words of windows in a row of one text that repeat windows in a row of
    one source; if ``merged`` all that overlap are one row, under the source of the longest part."""
    names = ["id", "th", "start", "n", "x", "y", "z"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
    out = ["id", "th", "first", "last", "n_words", "sid", "sfirst"]

    def process(rows: pa.Table) -> pa.RecordBatch:
        x = np.stack([rows.column(n).to_numpy().astype(np.int64) for n in names])
        x = x[:, np.append(True, (np.diff(x[:3]) != 0).any(axis=0))]  # a repeated row has its windows twice
        id, th, start, n, sid, sth, sstart = x
        step = np.diff(x)
        same = (step[:2] == 0).all(axis=0)
        goes_on = same & (step[2] == n[:-1]) & (step[4:6] == 0).all(axis=0) & (step[6] == n[:-1])
        begin = np.flatnonzero(np.append(True, ~goes_on))
        end = np.append(begin[1:], len(id)) - 1
        id, th, first, last, sid, sfirst = id[begin], th[begin], start[begin], (start + n - 1)[end] + min_words, sid[begin], sstart[begin]
        if merged:
            apart = (id[1:] != id[:-1]) | (th[1:] != th[:-1]) | (first[1:] >= last[:-1])
            begin = np.flatnonzero(np.append(True, apart))
            group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(id))))
            order = np.lexsort((first, first - last, group))  # the longest of each group, the first if equal
            best = order[np.searchsorted(group[order], np.arange(len(begin)))]
            id, th, first, last, sid, sfirst = id[begin], th[begin], first[begin], np.maximum.reduceat(last, begin), sid[best], sfirst[best]
        found = id, th, first, last, last - first, sid, sfirst
        return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(found, kinds)], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the text at the end
        for batch in batches:
            if not batch.num_rows:
                continue
            id, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            other = np.flatnonzero((id != id[-1]) | (th != th[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and not cut and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (id[0], th[0]):
                yield process(pa.Table.from_batches(held))
                held = []
            if cut:
                yield process(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield process(pa.Table.from_batches(held))

    rows = repeats.select(*names).repartition("id", "th").sortWithinPartitions("id", "th", "start")
    return map_batches(rows, run, "id long, th long, first int, last int, n_words int, sid long, sfirst int")


# ---------------------------------------------------------------- over a table


def _which_text(docs: DataFrame, id: str, text: str) -> Column:
    """What tells the texts of one id apart: their hash, or 0 where no id occurs twice."""
    twice = docs.select(F.col(id).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64(F.col(text))


def _runs(docs: DataFrame, th: Column, min_words: int, id: str, text: str, merged: bool) -> tuple[DataFrame, list[str]]:
    """The runs of all texts, and the scratch tables they are read from."""
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    found = docs.select(F.col(id).cast("long").alias("id"), th.alias("th"), F.col(text).alias("text")).where("id is not null and text is not null")
    spans, one = scratch_table(_joined(_spans(found, min_words)).drop("key"), "spans")
    some = spans.where(F.col("kind") == _LOOK).groupBy("id", "th").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    windows, two = scratch_table(_joined(_looked_into(found.join(some, ["id", "th"]), min_words)).drop("key"), "windows")
    return _segments(spans.where(F.col("kind") == _REPEAT).unionByName(windows.where(F.col("kind") == _REPEAT)), min_words, merged), [one, two]


def _run_table(docs: DataFrame, min_words: int, id: str, text: str, merged: bool) -> DataFrame:
    runs, paths = _runs(docs, _which_text(docs, id, text), min_words, id, text, merged)
    runs, _ = scratch_table(runs, "runs")
    discard(docs.sparkSession, *paths)
    return runs


def repeated_runs(docs: DataFrame, min_words: int = 20, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, first, last, n_words, sid, sfirst): runs of words that repeat earlier ones.

    Words ``first`` to ``last`` - 1 of a row are those from ``sfirst`` of row ``sid``. Earlier is a smaller id, or an earlier
    place in the same text; rows with equal id go by the hash of their text, ``th`` (0 where all ids differ). Every run of
    ``min_words`` words or more that stands earlier anywhere in the corpus is covered, and nothing else. Of several
    earlier places one is named; which one may change with the number of tasks, what is covered doesn't. Words
    are compared with A-Z as a-z; white space doesn't count. Null texts and null ids have no runs. Rows equal in id and
    text are one text. Other columns are ignored; an empty table has none; long texts are read slice by slice.
    """
    return _run_table(docs, min_words, id, text, False)


def merged_runs(docs: DataFrame, min_words: int = 20, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``repeated_runs`` with those of a text that overlap made one, under the source of the longest."""
    return _run_table(docs, min_words, id, text, True)


def _without(column: pa.Array, runs: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts without the words of their ``runs`` (first, last), and whether nothing else was in them."""
    hit = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
    gone = np.zeros(len(column), bool)
    if not len(hit):
        return column, gone
    data, offsets = utf8(column.take(pa.array(hit)))
    texts: list[bytes] = []
    for low, high, _, start, _, cuts in _parts(data, offsets):
        for k in range(low, high):
            raw = data[offsets[k] : offsets[k + 1]]
            edges = np.append(start[cuts[k - low] : cuts[k - low + 1]] - offsets[k], len(raw))
            depth = np.zeros(len(edges), np.int64)
            spans = runs[int(hit[k])].values
            np.add.at(depth, spans.field(0).to_numpy(), 1)
            np.add.at(depth, spans.field(1).to_numpy(), -1)
            keep = np.ones(len(raw), bool)
            keep[edges[0] :] = np.repeat(np.cumsum(depth)[:-1] == 0, np.diff(edges))
            texts.append(raw[keep].tobytes())
            gone[hit[k]] = not texts[-1].strip()
    mask = np.zeros(len(column), bool)
    mask[hit] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array(texts, pa.binary()).cast(column.type)), gone


def delete_repeats(docs: DataFrame, min_words: int = 20, id: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """``docs`` without later repeated runs of words (see ``repeated_runs``); rows of which nothing is left are dropped.

    A run goes with the white space after it. All columns stay, whatever their names; ``chars``, where present, becomes the
    length of the text that is left. Null texts, null ids and texts that were empty before stay. Rows equal in id and
    text lose the same runs, and all stay.
    """
    names = docs.columns
    i, t, r, g = fresh(names, "id", "th", "runs", "gone")
    th = _which_text(docs, id, text)
    runs, paths = _runs(docs, th, min_words, id, text, True)
    runs, _ = scratch_table(runs.groupBy(F.col("id").alias(i), F.col("th").alias(t)).agg(F.collect_list(F.struct("first", "last")).alias(r)), "runs")
    discard(docs.sparkSession, *paths)
    # runs grow with the documents: the same join at every size
    rows = docs.withColumns({i: F.col(id).cast("long"), t: th}).join(runs.hint("merge"), [i, t], "left").select(*names, r)
    at = names.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, gone = _without(batch.column(at), batch.column(len(names)))
        return pa.RecordBatch.from_arrays([*(left if j == at else batch.column(j) for j in range(len(names))), pa.array(gone)], [*names, g])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {g} boolean"
    out = map_arrow(rows, run, shape).where(~F.col(g)).drop(g)
    if chars in names:
        out = out.withColumn(chars, F.when(F.col(text).isNull(), F.col(chars)).otherwise(F.length(text)).cast(docs.schema[chars].dataType))
    return out.select(*names)
