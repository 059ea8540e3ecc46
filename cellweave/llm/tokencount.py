"""Token counts per document by a map-side two-tier lookup.

A text is cut into pre-tokens that no vocabulary piece crosses. Tier one is a broadcast table of
the lengths of pre-tokens that are frequent in the whole corpus, tier two a bounded cache in each Python worker, filled by the
tokenizer itself. No pre-token is shuffled; the result is the tokenizer's own count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Longest pre-token that is cached, and most entries in a worker's cache.
CACHED_CHARS, CACHE_ENTRIES = 48, 400_000

#: How many summaries of frequent pre-tokens a task merges, or a little more.
MERGED = 16

SPACE = "▁"


class SentencePieces:
    """Pre-tokens of a sentencepiece BPE model that never merges over white space or a line end.

    ``__init__`` checks on the vocabulary that no piece has a space mark after another character
    or a line end inside; then counts of the pre-tokens add up to the count of the text.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) and len(self.model.encode(" a \n a")) == len(self.model.encode(" a ")) + 1 + len(self.model.encode("a"))
        self.cut = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall

    def pretokens(self, text: str) -> list[str]:
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def lengths(self, pretokens: list[str]) -> list[int]:
        """The model puts a space mark before what it encodes; that of a pre-token without one is taken off."""
        asked = [p[1:] if p[0] == SPACE else "\n" + p for p in pretokens]
        found = self.model.encode(asked, num_threads=1)
        return [self._length(p, ids) for p, ids in zip(pretokens, found)]

    def _length(self, pretoken: str, ids: list[int]) -> int:
        if pretoken[0] != SPACE:
            return len(ids) - 2  # the space mark and the line end before it
        return len(ids) if len(pretoken) > 1 else 1

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))


class JsonPieces:
    """Pre-tokens as the tokenizer file's own normalizer and pre-tokenizer give them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.splits = self.model.pre_tokenizer is not None

    def pretokens(self, text: str) -> list[str] | None:
        """None if a special token's string is inside: then the text is encoded as a whole."""
        if any(s in text for s in self.special):
            return None
        if self.model.normalizer is not None:
            text = self.model.normalizer.normalize_str(text)
        return [p for p, _ in self.model.pre_tokenizer.pre_tokenize_str(text)]

    def lengths(self, pretokens: list[str]) -> list[int]:
        return [len(self.model.model.tokenize(p)) for p in pretokens]

    def whole(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)


def load_pieces(path: str) -> SentencePieces | JsonPieces:
    return JsonPieces(path) if path.endswith(".json") else SentencePieces(path)


class Counts:
    """Lengths by pre-token: the frequent ones for good, others while there is room."""

    def __init__(self, pieces: SentencePieces | JsonPieces, frequent: dict[str, int]):
        self.pieces, self.frequent, self.cache = pieces, frequent, dict(frequent)

    def count(self, texts: list[str]) -> list[int]:
        if not self.pieces.splits:
            return [self.pieces.whole(t) for t in texts]
        cut = [self.pieces.pretokens(t) for t in texts]
        missing = list(set().union(*(c for c in cut if c)).difference(self.cache))
        now = self.cache
        if missing:
            found = dict(zip(missing, self.pieces.lengths(missing)))
            if len(self.cache) + len(found) > CACHE_ENTRIES + len(self.frequent):
                now = self.cache | found
                self.cache = dict(self.frequent)
            else:
                self.cache.update((p, n) for p, n in found.items() if len(p) <= CACHED_CHARS)
                now = found | self.cache if any(len(p) > CACHED_CHARS for p in missing) else self.cache
        get = now.__getitem__
        return [self.pieces.whole(t) if c is None else sum(map(get, c)) for t, c in zip(texts, cut)]


class Summary:
    """Counts of the frequent among very many pre-tokens (Misra-Gries): at most ``held`` survive a cut.

    Of N pre-tokens, one that stands more than N / held times is kept, also by a summary of summaries.
    """

    def __init__(self, held: int):
        self.held, self.counts = held, Counter()

    def cut(self, room: int = 1) -> None:
        if len(self.counts) > room * self.held:
            counts = np.fromiter(self.counts.values(), np.int64, len(self.counts))
            least = int(np.partition(counts, -self.held - 1)[-self.held - 1])
            self.counts = Counter({p: n - least for p, n in self.counts.items() if n > least})

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.cut()
        keys = list(self.counts)
        for low in range(0, len(keys), 10_000):
            some = keys[low : low + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([self.counts[p] for p in some], pa.int64())], ["pretoken", "n"])


def slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, about a megabyte at a time; a null is an empty text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        before = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + (1 << 20))))
        yield [t or "" for t in texts.slice(low, high - low).to_pylist()]
        low = high


def frequent_lengths(docs: DataFrame, path: str, entries: int = 50_000, text: str = "text") -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of at most CACHED_CHARS characters of all documents.

    Each task sums its whole texts up to 2 * ``entries`` rows; these summaries, never pre-tokens, are merged
    about MERGED at a time, as a tree, and ``entries`` rows at most reach the driver. They only decide which lengths are broadcast, never a count.
    """
    pieces = load_pieces(path)
    if not pieces.splits:
        return {}
    held, shape = 2 * entries, "pretoken string, n long"

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = load_pieces(path), Summary(held)
        for batch in batches:
            for texts in slices(batch.column(0)):
                some: Counter = Counter()
                for t in texts:
                    some.update(own.pretokens(t) or ())
                seen.counts.update({p: n for p, n in some.items() if len(p) <= CACHED_CHARS})
                seen.cut(3)
        yield from seen.batches()

    def of_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Summary(held)
        for batch in batches:
            for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.counts[p] += n
            seen.cut(3)
        yield from seen.batches()

    some = map_batches(docs.select(text), of_texts, shape).withColumn("task", F.spark_partition_id())
    some = map_batches(some.repartition("task").drop("task"), of_summaries, shape)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > MERGED:
        parts = -(-parts // MERGED)
        some = map_batches(some.withColumn("task", F.spark_partition_id() % parts).repartition(parts, "task").drop("task"), of_summaries, shape)
    some = map_batches(some.repartition(1), of_summaries, shape)
    top = [r.pretoken for r in some.where("n > 1").orderBy(F.desc("n"), "pretoken").limit(entries).collect()]
    return dict(zip(top, pieces.lengths(top))) if top else {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``docs``; no begin, end or added special tokens.

    A null or empty text has 0 bytes and, with a tokenizer that adds nothing to it, 0 tokens.
    Repeated rows and null ids stay as they are; other columns are ignored. ``tokenizer`` is the path
    of a tokenizer file (.json or .model) that every executor can read.
    """
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(load_pieces(tokenizer), frequent.value)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            n_tokens = [n for some in slices(texts) for n in counts.count(some)]
            n = np.array(n_tokens, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs, run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id)
