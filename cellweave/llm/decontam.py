"""Benchmark decontamination by greedy string tiling.

Documents are joined with benchmark items on shared runs of MATCH words (seeds; items of fewer words are seeds as they are). For each pair that
shares enough of them, the longest non-overlapping common runs are marked again and again, found by
running Karp-Rabin hashes; the share of the item's words under such tiles is its coverage. Tiles
may stand in any order, so reordered passages count as well.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, SLICE_BYTES, map_batches, mix, utf8, words

#: Least length of a tile in words; and share of an item under tiles from which it counts as leaked.
MATCH, COVERAGE = 4, 0.5

#: Seeds of a benchmark that are broadcast at once (24 bytes each); a larger one goes in rounds.
SEEDS_AT_ONCE = 1_000_000

_STEP = np.uint64(0xD6E8FEB86659FD93)


#: Scripts that are written without spaces: each character is a word. Punctuation, symbols and spaces end one.
ALONE, BETWEEN = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", r"[\p{P}\p{S}\p{Z}]+"


def _spaced(texts: pa.Array) -> pa.Array:
    """The texts with spaces around what ALONE and BETWEEN match beyond ASCII: a rule for each character, whatever stands around it.

    Texts of which no character could match are left alone, as they would come out the same: those of ASCII (``LETTERS`` cuts at its marks
    as BETWEEN would) and of U+00C0 to U+00FF, which are letters but for U+00D7 and U+00F7.
    """
    data, at = utf8(texts)
    if not len(data):
        return texts
    sign = np.zeros(len(data), bool)
    sign[:-1] = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    odd = np.concatenate([[0], np.cumsum((data == 0xC2) | (data >= 0xC4) | sign)])
    rows = np.flatnonzero(odd[at[1:]] > odd[at[:-1]])
    if not len(rows):
        return texts
    some = pc.replace_substring_regex(pc.replace_substring_regex(texts.take(pa.array(rows)), ALONE, r" \1 "), BETWEEN, " ")
    mask = np.zeros(len(texts), bool)
    mask[rows] = True
    return pc.replace_with_mask(texts, pa.array(mask), some)


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, offsets) of slices of the texts. Words are runs of letters and digits, in lower case; in scripts without
    spaces, characters."""
    low = 0
    raw = _spaced(pc.utf8_lower(pc.fill_null(texts, "")))
    data, at = utf8(raw)
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + 2 * SLICE_BYTES, "right")) - 1)
        h, _, _, offsets = words(data, at[low : high + 1], LETTERS)
        yield low, h, offsets
        low = high


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * _STEP + h[j : len(h) - n + 1 + j]
    return mix(out)


def _tops(free: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def greedy_tiles(item: Sequence[int], text: Sequence[int], least: int = MATCH) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of greedy string tiling, longest first.

    Each round takes the longest common run of words that no tile has yet; among equally long ones
    the first in the item, then in the text. Runs are found by running Karp-Rabin hashes of a length
    that falls from long to ``least``.
    """
    a, b = np.asarray(item, np.uint64), np.asarray(text, np.uint64)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    tiles = []
    length = min(len(a), len(b))
    while length >= least:
        longest: list[tuple[int, int, int]] = []
        table = defaultdict(list)
        for low, high in _tops(free_a):
            for k, x in enumerate(_windows(a[low:high], length).tolist()):
                table[x].append(low + k)
        if table:
            for low, high in _tops(free_b):
                for k, x in enumerate(_windows(b[low:high], length).tolist()):
                    q = low + k
                    for p in table.get(x, ()):
                        n = 0
                        while p + n < len(a) and q + n < len(b) and free_a[p + n] and free_b[q + n] and a[p + n] == b[q + n]:
                            n += 1
                        if n >= length:
                            longest.append((-n, p, q))
        top = max((-n for n, _, _ in longest), default=0)
        if top > length:  # a longer run than asked for: look at that length first
            length = top
            continue
        for n, p, q in sorted(longest):
            if free_a[p : p - n].all() and free_b[q : q - n].all():
                free_a[p : p - n] = free_b[q : q - n] = False
                tiles.append((p, q, -n))
        length = length - 1 if length <= 2 * least else max(least, length // 2) if not longest else length - 1
    return tiles


class Benchmark:
    """Items as word hashes, and their seeds sorted by hash."""

    def __init__(self, ids: list[int], items: list[np.ndarray], match: int, coverage: float):
        self.ids, self.items, self.match, self.coverage = ids, items, match, coverage
        # items of fewer words, by their number of words: sorted hashes of the whole, and which items these are
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(x) for x in items if len(x) < match}):
            which = np.array([k for k, x in enumerate(items) if len(x) == n])
            whole = np.concatenate([_windows(items[k], n) for k in which.tolist()])
            order = np.argsort(whole, kind="stable")
            self.short[n] = whole[order], which[order]
        seeds = [_windows(x, match) for x in items]
        self.seed = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
        self.place = np.concatenate([*(np.arange(len(s)) for s in seeds), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.place = self.seed[order], self.item[order], self.place[order]

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, coverage, tiles, longest tile) of each text and item at or above the coverage."""
        if not self.items:
            return
        for low, h, offsets in tokens(texts):
            for n, (whole, which) in self.short.items():
                run = _windows(h, n)
                first, last = np.searchsorted(whole, run, "left"), np.searchsorted(whole, run, "right")
                hits = np.flatnonzero(last > first)
                row = np.searchsorted(offsets, hits, "right") - 1
                inside = hits + n <= offsets[row + 1]
                found = {(r, k) for r, a, b in zip(row[inside].tolist(), first[hits[inside]].tolist(), last[hits[inside]].tolist()) for k in which[a:b].tolist()}
                yield from ((low + r, k, 1.0, 1, n) for r, k in sorted(found))
            if not len(self.seed):
                continue
            run = _windows(h, self.match)
            at = np.searchsorted(self.seed, run)
            hits = np.flatnonzero(self.seed[np.minimum(at, len(self.seed) - 1)] == run)
            row = np.searchsorted(offsets, hits, "right") - 1
            inside = hits + self.match <= offsets[row + 1]
            hits, row = hits[inside], row[inside]
            cuts = np.flatnonzero(np.diff(row)) + 1
            for part in np.split(np.arange(len(hits)), cuts) if len(hits) else []:
                r = int(row[part[0]])
                yield from ((low + r, *found) for found in self._document(h, hits[part], run[hits[part]]))

    def _document(self, h: np.ndarray, hits: np.ndarray, run: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        first, last = np.searchsorted(self.seed, run, "left"), np.searchsorted(self.seed, run, "right")
        many = last - first
        post = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        item, place, where = self.item[post], self.place[post], np.repeat(hits, many)
        order = np.argsort(item, kind="stable")
        item, place, where = item[order], place[order], where[order]
        for group in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
            k = int(item[group[0]])
            m = len(self.items[k])
            # no tiling covers more than the words that some seed covers
            covered = np.zeros(m + 1, np.int64)
            np.add.at(covered, place[group], 1)
            np.add.at(covered, np.minimum(place[group] + self.match, m), -1)
            if (np.cumsum(covered[:m]) > 0).sum() < self.coverage * m:
                continue
            # the text's words that this item's seeds touch; a word that equals nothing stands between stretches
            spots = np.unique(where[group])
            pieces = [np.arange(s[0], s[-1] + self.match) for s in np.split(spots, np.flatnonzero(np.diff(spots) > self.match) + 1)]
            gap = np.setdiff1d(np.arange(m + 1, dtype=np.uint64), self.items[k])[:1]
            text = np.concatenate([x for p in pieces for x in (h[p], gap)])
            tiles = greedy_tiles(self.items[k], text, self.match)
            share = sum(t[2] for t in tiles) / m
            if share >= self.coverage:
                yield k, share, len(tiles), tiles[0][2]


def _rounds(benchmark: DataFrame, match: int, coverage: float, id: str, text: str) -> Iterator[Benchmark]:
    """The benchmark in parts of at most SEEDS_AT_ONCE seeds (or one item): each is broadcast by itself."""
    rows = benchmark.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("long").alias("i"), F.col(text).alias("t")).distinct().orderBy("i", "t")
    ids: list[int] = []
    items: list[np.ndarray] = []
    size = 0
    for row in rows.toLocalIterator():  # a benchmark is read once, a partition at a time
        for _, h, _ in tokens(pa.array([row.t])):
            if not len(h):
                continue
            if size + len(h) > SEEDS_AT_ONCE and items:
                yield Benchmark(ids, items, match, coverage)
                ids, items, size = [], [], 0
            ids.append(row.i)
            items.append(h.copy())
            size += len(h)
    yield Benchmark(ids, items, match, coverage)


def find_leaks(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, coverage, n_tiles, longest_tile) of each document and benchmark item that it covers to ``coverage`` or more.

    An item of under ``match`` words is covered where all of it stands in a row. Null and empty texts cover nothing, and null, empty and
    wordless items are covered by nothing. Items with equal id and text count once; repeated documents give repeated rows. Other columns are
    ignored. Long texts are read whole, slice by slice; empty tables give no rows.
    """
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    parts = []
    for held in _rounds(benchmark, match, coverage, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                found = list(items.leaks(batch.column(1)))
                if found:
                    row, k, share, n, longest = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([items.ids[x] for x in k], pa.int64()), pa.array(share, pa.float64()), pa.array(n, pa.int32()), pa.array(longest, pa.int32())], ["id", "item_id", "coverage", "n_tiles", "longest_tile"])

        parts.append(map_batches(docs, run, "id long, item_id long, coverage double, n_tiles int, longest_tile int"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.withColumnRenamed("id", id)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``find_leaks`` reports; all columns stay, whatever their names, and no row moves.

    Null and empty texts stay; repeated rows share their fate; with an empty benchmark all rows stay.
    """
    names = docs.columns
    at = names.index(text)
    for held in _rounds(benchmark, match, coverage, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in sent.value.leaks(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = map_batches(docs, run, docs.schema)
    return docs
