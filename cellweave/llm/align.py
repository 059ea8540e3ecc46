"""Alignment of two tokenizers over the same bytes.

Tokens of a text are intervals of its bytes, once for each tokenizer. DuckDB, one connection for each Arrow partition, joins them: those that
end together are linked and cut the text into groups (an as-of join finds the groups of tokens, window sums their places), and an as-of join
with a range join gives all tokens that overlap. Counts of linked id pairs are summed by each partition, then by Spark.

Two tokens that end together are one the end of the other, so only pairs of ids whose bytes are so related can ever be linked: the two
vocabularies bound the table of counts, whatever the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _give_back as give_back
from .common import map_batches, scratch_table

#: Bytes of text that are joined at a time, and slices after which a partition's pair counts are summed up.
JOIN_BYTES, SUM_AFTER = 1 << 19, 32

#: Tokens that are joined at once: of a text with more, as many as end at a cut; and memory of a partition's DuckDB.
PIECE_TOKENS, DUCK_MEMORY = 500_000, "400MB"

#: Fixed value: how byte-level tokenizers of this family cut a text before merging.
BYTE_LEVEL_CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Below this code point (Latin letters) all versions of Unicode agree on what is a letter, a number or a space, so that any library cuts alike.
SETTLED = 0x250


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of a tokenizer file (.json); a space is put before each text."""

    def __init__(self, path: str):
        self.path = path
        with open(path) as f:
            told = json.load(f)
        letters, vocab = byte_letters(), told["model"]["vocab"]
        special = {t["content"] for t in told.get("added_tokens", ())}
        self.bytes: list[bytes | None] = [None] * (max(vocab.values(), default=-1) + 1)
        for piece, k in vocab.items():
            self.bytes[k] = bytes(letters[c] for c in piece) if piece not in special else None
        self.fast = self._ranks(told, letters)

    @functools.cached_property
    def model(self):
        """The library's tokenizer, loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        found.encode_special_tokens = True
        return found

    def _ranks(self, told: dict, letters: dict[str, int]):
        """The same merges for tiktoken, where the file says nothing that tiktoken wouldn't do: ids in the order of merges, the usual cut."""
        import tiktoken

        cut = told.get("pre_tokenizer") or {}
        plain = told["model"]["type"] == "BPE" and told.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"].get("merges", ())]
        vocab = told["model"]["vocab"]
        if not plain or told["model"].get("ignore_merges") or [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))) or sorted(vocab[c] for c in letters) != list(range(256)):
            return None
        ranks = {b: k for k, b in enumerate(self.bytes) if b is not None}
        return tiktoken.Encoding("merges", pat_str=BYTE_LEVEL_CUT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + t for t in texts]
        settled = [self.fast is not None and (t.isascii() or ord(max(t)) < SETTLED) for t in texts]
        other = iter(self.model.encode_batch_fast([t for t, s in zip(texts, settled) if not s], add_special_tokens=False)) if not all(settled) else iter(())
        return [self.fast(t) if s else next(other).ids for t, s in zip(texts, settled)]


class Pieces:
    """A sentencepiece model; it puts a space before each text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes | None] = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            if self.model.is_byte(k):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(None if self.model.is_control(k) or self.model.is_unknown(k) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteLevel | Pieces:
    """The tokenizer of a file, once for each worker."""
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


def linkable(a: list[bytes | None], b: list[bytes | None]) -> np.ndarray:
    """a_id * len(b) + b_id, in order, of all pairs of which one's bytes end with the other's: no others can end together."""
    of_a: dict[bytes, list[int]] = {}
    of_b: dict[bytes, list[int]] = {}
    for table, names in ((a, of_a), (b, of_b)):
        for k, x in enumerate(table):
            if x:
                names.setdefault(x, []).append(k)
    found = set()
    for x, ks in of_a.items():
        for j in range(len(x)):
            found.update(k * len(b) + m for m in of_b.get(x[j:], ()) for k in ks)
    for x, ms in of_b.items():
        for j in range(1, len(x)):
            found.update(k * len(b) + m for k in of_a.get(x[j:], ()) for m in ms)
    return np.array(sorted(found), np.int64)


class Spelled:
    """What each id of a tokenizer stands for, as Arrow columns: its bytes, and its decimal digits before each of three marks."""

    MARKS = (",", "|", ";")

    def __init__(self, table: list[bytes | None]):
        self.size = np.array([len(x or b"") for x in table], np.int64)
        self.known = np.array([bool(x) for x in table], bool)
        self.bytes = pa.array([x or b"" for x in table], pa.large_binary())
        self.digits = [pa.array([f"{k}{mark}".encode() for k in range(len(table))], pa.large_binary()) for mark in self.MARKS]


def _joined(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a binary column one after another, and where each value begins."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return memoryview(data if data is not None else b"").cast("B"), at


class Aligner:
    """The joins of one partition."""

    def __init__(self, a: str, b: str):
        import duckdb

        self.a, self.b = load(a), load(b)
        self.spelled = Spelled(self.a.bytes), Spelled(self.b.bytes)
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY})
        self.sql.execute("SET temp_directory = ''")
        self.sql.execute("CREATE TABLE pair (a INTEGER, b INTEGER, n BIGINT)")
        self.summed = 0

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(which texts count, ids, numbers of tokens by text): of both tokenizers; texts that either doesn't spell have no tokens."""
        encoded = [t.encode(texts) for t in (self.a, self.b)]
        counts = [np.array([len(x) for x in e], np.int64) for e in encoded]
        ids = [np.fromiter(itertools.chain.from_iterable(e), np.int64, int(c.sum())) for e, c in zip(encoded, counts)]
        good = np.array([bool(t) for t in texts], bool)
        want = [b" " + t.encode() for t in texts]
        for held, some, n in zip(self.spelled, ids, counts):
            data, at = _joined(held.bytes.take(pa.array(some)))
            ends = np.cumsum(n)
            cuts = at[np.append(0, ends)]
            whole = np.add.reduceat(np.append(~held.known[some], False), np.minimum(ends - n, len(some))) if len(n) else n
            for k, text in enumerate(want):
                if n[k] and whole[k] or data[cuts[k] : cuts[k + 1]] != text:
                    good[k] = False
        kept = [i[np.repeat(good, n)] for i, n in zip(ids, counts)]
        return good, kept, [np.where(good, n, 0) for n in counts]

    def _register(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """The interval tables a and b (k, id, s, e) of tokens that follow each other; ends of both."""
        ends = []
        for name, i, held in zip("ab", ids, self.spelled):
            e = np.cumsum(held.size[i])
            table = pa.table({"k": np.arange(len(i)), "id": i.astype(np.int32), "s": np.append(0, e[:-1])[: len(e)], "e": e})
            self.sql.register(name, table)
            ends.append(e)
        return ends

    def _pieces(self, ids: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(from, to token of a, from, to token of b, byte at which they begin) of stretches of about PIECE_TOKENS that end where tokens of both end."""
        ends = [np.cumsum(held.size[i]) for i, held in zip(ids, self.spelled)]
        p = q = 0
        while p < len(ids[0]):
            k = p + PIECE_TOKENS - 1
            while k < len(ids[0]) - 1:
                some = ends[0][k : k + 4096]
                at = np.minimum(np.searchsorted(ends[1], some), len(ends[1]) - 1)
                hit = np.flatnonzero(ends[1][at] == some)
                if len(hit):
                    k += int(hit[0])
                    break
                k += len(some)
            k = min(k, len(ids[0]) - 1)
            stop = int(np.searchsorted(ends[1], ends[0][k], "right"))
            yield p, k + 1, q, stop, int(ends[0][p - 1]) if p else 0
            p, q = k + 1, stop

    def align(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(end, a id, b id of each link in order; (tokens of a, of b, of both up to its end) by group). The pairs are counted."""
        found = []
        for p, p1, q, q1, byte in self._pieces(ids):
            end, a, b, group = self._align([ids[0][p:p1], ids[1][q:q1]])
            found.append((end + byte, a, b, group + np.array([[0], [0], [p], [q]])))
        return tuple(np.concatenate(x, axis=-1) for x in zip(*found))

    def _align(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        self._register(ids)
        self.sql.execute("CREATE OR REPLACE TEMP TABLE link AS SELECT a.k AS k, a.id AS a, b.id AS b, a.e AS e FROM a JOIN b ON a.e = b.e")
        self.sql.execute("INSERT INTO pair SELECT a, b, count(*) FROM link GROUP BY a, b")
        self.summed += 1
        if self.summed % SUM_AFTER == 0:
            self.sql.execute("CREATE OR REPLACE TABLE pair AS SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM pair GROUP BY a, b")
        # a token of b belongs to the first cut at or after its end; those of a follow from the one that ends there
        found = self.sql.execute(
            "WITH f AS (SELECT link.e AS e, count(*) AS n FROM b ASOF JOIN link ON b.e <= link.e GROUP BY link.e) "
            "SELECT e, a, b, k - lag(k, 1, -1) OVER w AS n_a, n AS n_b, k + 1 AS upto_a, CAST(sum(n) OVER w AS BIGINT) AS upto_b FROM link JOIN f USING (e) WINDOW w AS (ORDER BY e) ORDER BY e"
        ).fetchnumpy()
        return np.asarray(found["e"]), np.asarray(found["a"], np.int64), np.asarray(found["b"], np.int64), np.stack([np.asarray(found[c], np.int64) for c in ("n_a", "n_b", "upto_a", "upto_b")])

    def overlapping(self, ids: list[np.ndarray]) -> pa.Table:
        """(ka, kb, start, stop): all tokens of a and b whose bytes overlap: from the one at a token's first byte to the last that begins before its end."""
        self._register(ids)
        return self.sql.execute(
            "WITH f AS (SELECT b.k, b.s, b.e, a.k AS first FROM b ASOF JOIN a ON b.s >= a.s) "
            "SELECT a.k AS ka, f.k AS kb, greatest(a.s, f.s) AS start, least(a.e, f.e) AS stop FROM f JOIN a ON a.k >= f.first AND a.s < f.e ORDER BY kb, ka"
        ).to_arrow_table()

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.sql.execute("SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM pair GROUP BY a, b ORDER BY a, b").fetchnumpy()
        return tuple(np.asarray(found[c], np.int64) for c in "abn")

    def written(self, ids: list[np.ndarray], group: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The groups as text (``a1,a2|b1;`` and so on), and where each group begins."""
        n_a, n_b, upto_a, upto_b = group
        out_n = n_a + n_b
        place = [np.arange(len(ids[0])) + np.repeat(upto_b - n_b, n_a), np.arange(len(ids[1])) + np.repeat(upto_a, n_b)]
        total = int(out_n.sum())
        last = [np.zeros(len(i), bool) for i in ids]
        last[0][upto_a - 1] = True
        last[1][upto_b - 1] = True
        # one column of all spellings: a with comma, a with bar, b with comma, b with semicolon
        columns = [self.spelled[0].digits[0], self.spelled[0].digits[1], self.spelled[1].digits[0], self.spelled[1].digits[2]]
        first = np.cumsum([0, *(len(c) for c in columns)])
        which = np.zeros(total, np.int64)
        for side in (0, 1):
            which[place[side]] = ids[side] + np.where(last[side], first[2 * side + 1], first[2 * side])
        data, at = _joined(pa.concat_arrays(columns).take(pa.array(which)))
        return data, at[np.append(0, np.cumsum(out_n))]


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        before = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + JOIN_BYTES)))
        yield [t or "" for t in texts.slice(low, high - low).to_pylist()]
        low = high


@dataclass
class Alignment:
    """What was aligned: a row per document, and how often each pair of ids is linked in all of them."""

    documents: DataFrame
    pairs: DataFrame


_ROW = "kind int, id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, counts array<long>"
_NAMES = ["kind", "id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts"]


def _documents(texts: list[str], aligner: Aligner, linked: np.ndarray) -> list[pa.Array]:
    good, ids, counts = aligner.tokens(texts)
    n = len(texts)
    if not good.any():
        none = np.zeros(n, np.int64)
        return [pa.array(none), pa.array(none), pa.array(none), pa.array([""] * n), pa.array([[]] * n, pa.list_(pa.int32()))]
    end, a, b, group = aligner.align(ids)
    key = a * len(aligner.b.bytes) + b
    pair = np.searchsorted(linked, key)
    if (linked[np.minimum(pair, len(linked) - 1)] != key).any():
        raise ValueError("tokens end together of which neither ends with the other")
    data, at = aligner.written(ids, group)
    # texts end where a group does: a group's last token of a tells which text it is of
    upto = np.cumsum(counts[0])
    groups = np.searchsorted(group[2], upto, "right")
    ends = np.cumsum(aligner.spelled[0].size[ids[0]])
    text_end = np.where(upto > 0, ends[np.maximum(upto, 1) - 1], 0)
    links = np.searchsorted(end, text_end, "right")
    begin = np.append(0, groups[:-1])
    shas = [hashlib.sha256(data[at[p] : at[q] - 1]).hexdigest() if q > p else "" for p, q in zip(begin.tolist(), groups.tolist())]
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, links).astype(np.int32)), pa.array(pair.astype(np.int32)))
    return [pa.array(counts[0]), pa.array(counts[1]), pa.array(groups - begin), pa.array(shas), lists]


def align(docs: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text") -> Alignment:
    """Align tokenizer ``a`` (.json, byte-level) with ``b`` (.model) over each text, a space before it.

    ``documents``: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row. Groups lie between byte offsets at which tokens of both end;
    links are pairs of tokens that end together; a pair's count is how many links of all documents hold it, ``n_best`` how many of the
    row's links have their b id's greatest count (ties included). ``pairs``: (a_id, b_id, n).

    Null and empty texts, and those that either tokenizer doesn't spell byte for byte, have no tokens: zeros, and no digest. Long texts are aligned
    whole; special tokens' strings are plain text; repeated rows count each; null ids stay; an empty table gives no rows; other columns are
    ignored. Texts are encoded once: each row's links are written to the shared folder as places in the table of linkable pairs. That
    table follows from the vocabularies alone, so its counts (12 bytes for each pair) can be sent to the driver and to every task, whatever the corpus.
    """
    spark = docs.sparkSession
    left, right = load(a), load(b)
    linked = linkable(left.bytes, right.bytes)
    n_right = len(right.bytes)
    sent = spark.sparkContext.broadcast(linked)
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, linked = Aligner(a, b), sent.value
        for batch in batches:
            low = 0
            for texts in _slices(batch.column(1)):
                n = len(texts)
                n_a, n_b, n_groups, shas, lists = _documents(texts, aligner, linked)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0).slice(low, n), n_a, n_b, n_groups, shas, lists, pa.nulls(n, pa.list_(pa.int64()))], _NAMES)
                low += n
            give_back()
        ids_a, ids_b, counts = aligner.pairs()
        if len(counts):
            places = np.searchsorted(linked, ids_a * n_right + ids_b).astype(np.int32)
            one = [pa.array([x], k) for x, k in ((1, pa.int32()), *[(None, pa.int64())] * 4, (None, pa.string()))]
            yield pa.RecordBatch.from_arrays([*one, pa.array([places], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int64()))], _NAMES)

    held, _ = scratch_table(map_batches(docs, run, _ROW), "aligned")
    summed = held.where("kind = 1").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    table = summed.toArrow()
    count = np.zeros(len(linked), np.int64)
    count[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    most = np.zeros(n_right, np.int64)
    np.maximum.at(most, linked % n_right, count)
    known = spark.sparkContext.broadcast((count, (count == most[linked % n_right])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = known.value
        for batch in batches:
            lists = batch.column(4)
            at = lists.offsets.to_numpy()
            pair = lists.values.to_numpy()[at[0] : at[-1]]
            sums = [np.append(0, np.cumsum(x[pair]))[at - at[0]] for x in (np.ones_like(count), best.astype(np.int64), count)]
            columns = [batch.column(k) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.diff(s)) for s in sums), batch.column(5)], ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = held.where("kind = 0").select("id", "n_a", "n_b", "n_groups", "pairs", "groups_sha256")
    found = map_batches(rows, score, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    at = np.flatnonzero(count)
    pairs = spark.createDataFrame(pa.table({"a_id": linked[at] // n_right, "b_id": linked[at] % n_right, "n": count[at]}))
    return Alignment(found.withColumnRenamed("id", id), pairs)


def overlapping_tokens(docs: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, a_token, b_token, start, stop) per row of ``docs`` and two tokens that overlap: their numbers in the text, from 0, and the bytes in common
    (of a space and the text). Rows as in ``align``: those without tokens give none."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)
        for batch in batches:
            low = 0
            for texts in _slices(batch.column(1)):
                good, ids, counts = aligner.tokens(texts)
                low += len(texts)
                if not good.any():
                    continue
                found = aligner.overlapping(ids)
                upto = [np.cumsum(c) for c in counts]
                ka, kb, start, stop = (found.column(c).to_numpy() for c in ("ka", "kb", "start", "stop"))
                of = np.searchsorted(upto[0], ka, "right")
                base = np.append(0, np.cumsum(aligner.spelled[0].size[ids[0]]))[upto[0] - counts[0]]
                row = pa.array(of + low - len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(ka - (upto[0] - counts[0])[of]), pa.array(kb - (upto[1] - counts[1])[of]), pa.array(start - base[of]), pa.array(stop - base[of])], ["id", "a_token", "b_token", "start", "stop"])

    return map_batches(docs, run, "id long, a_token long, b_token long, start long, stop long").withColumnRenamed("id", id)
