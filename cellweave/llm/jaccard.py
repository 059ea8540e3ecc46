"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles are put into size bands; inside a band, similarity bounds the symmetric
difference by k. The feature domain is cut into more than k / (u + 1) parts, each into u + 2 pieces: some part differs in
at most u features, so two of its pieces are equal, and hashes of such pairs of pieces are
signatures that two similar sets must share. Sets that share a signature are candidates, each pair of them or, where many share
one, first each with the least; sketches rule most of those out that share some words only, and the features of the others meet.
What is still untied in a large bucket is compared in blocks of bounded size, by sketches and then by features.

A signature of few features is shared by chance, by a share of all sets. Some parts more than the pigeonhole
needs make up for such signatures in most sets; other sets refine them by signatures of a second partition, so
that no bucket holds a share of the corpus. Neither loses a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, WORDS, discard, fresh, map_batches, mix, scratch_table, shingles, signed, sorted_groups, utf8, words
from .graph import Forest, connected_components, forest, meetings, spread_join

#: Weak signatures are refined at most so many times; and so many of a set's, on average, at most.
REFINED, MOST_REFINED = 2, 1.5

#: Parts beyond those that the pigeonhole needs, as shares of them that are tried.
SPARE = (0.0, 0.06, 0.1, 0.15, 0.22, 0.3, 0.4)

#: Sets of a bucket that all meet; in larger ones all meet the least first.
SMALL = 32

#: Of so many large buckets one, on average, is looked at before the others.
EARLY = 8

#: Hashes of ids by which the texts that are needed are told from others.
ASKED = 1 << 20

#: Features signed at a time, signatures of a packet, and features (times rows) of a unit of verification.
SIGNED, PACKET, UNIT = 1 << 19, 1 << 19, 1 << 20

_PART, _PIECE, _VALUE = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


@lru_cache(maxsize=4096)
def band_of(n: int, num: int, den: int) -> int:
    """Index of the size band of n: band i + 1 begins over what band i's least size can be similar to."""
    band, low = 0, 1
    while low * den // num < n:
        low = low * den // num + 1
        band += 1
    return band


@lru_cache(maxsize=4096)
def band_rule(band: int, num: int, den: int) -> tuple[int, int, int, np.ndarray]:
    """(parts, spare, least, pairs) of a band: number of parts, how many of them aren't needed, the features below which a
    signature is weak, and the pairs of a part's pieces that make its signatures.

    Two sets of sizes up to ``high`` and similarity num / den differ in at most
    k = 2 * high * (den - num) / (den + num) features. At most k // (u + 1) parts differ in more than u, so of
    k // (u + 1) + 1 + spare parts of u + 2 pieces spare + 1 have two equal pieces. Weak are signatures of no feature, or of
    under two. Of all ways the one of fewest signatures, refined ones counted, is taken; where over MOST_REFINED of a set's would have to be
    refined, as for low similarities, no signature counts as weak.
    """
    low = 1
    for _ in range(band):
        low = low * den // num + 1
    high = low * den // num
    k = 2 * high * (den - num) // (den + num)
    found = []
    for uneven in range(1, 9):  # differences that a part may have: two of its uneven + 2 pieces are equal
        need, pairs = k // (uneven + 1) + 1, (uneven + 2) * (uneven + 1) // 2
        for share in SPARE:
            spare = max(1, round(share * need)) if share else 0
            own = (need + spare) * pairs
            for least in (1, 2):
                features = 2 * low * sqrt(num / den) / ((uneven + 2) * (need + spare))  # between the two bands that use the rule
                weak = max(1e-9, own * exp(-features) * (1 + features * (least - 1)))
                fits = sum(exp(j * log(weak) - weak - lgamma(j + 1)) for j in range(spare + 1))  # Poisson
                more = weak * max(0.0, 1 - fits)  # signatures that are refined
                if more <= min(MOST_REFINED, 300 / own):  # a large set that must refine makes very many
                    found.append((own * (1 + more) * (1.3 if least == 1 else 1.0), need + spare, spare, least, uneven + 2))
    if found:
        _, parts, spare, least, pieces = min(found)
        return parts, spare, least, _pairs(pieces)
    return k // 2 + 1, 0, 0, _pairs(3)


def _pairs(pieces: int) -> np.ndarray:
    return np.array([(i, j) for j in range(pieces) for i in range(j)])


def _band_signatures(features: np.ndarray, sizes: np.ndarray, band: int, num: int, den: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, set) of sets of ``sizes`` by a band's rule; ``features`` has them one behind another.

    A set with no more weak parts than are spare has a strong signature in common with every similar set, which has it as
    well: of its weak ones none is needed. Other sets have their weak ones combined with their signatures of another partition.
    """
    parts, spare, least, pairs = band_rule(band, num, den)
    pieces, m = int(pairs.max()) + 1, len(sizes)
    seed = mix(np.array([depth * 2 + 1], np.uint64))[0] * np.uint64(depth > 0)
    owner = np.repeat(np.arange(m), sizes)
    part, piece = mix(features ^ _PART ^ seed) % np.uint64(parts), mix(features ^ _PIECE ^ seed) % np.uint64(pieces)
    slot = (owner * parts + part.astype(np.int64)) * pieces + piece.astype(np.int64)
    value, n = mix(features ^ _VALUE), m * parts * pieces
    # sums of 64-bit words modulo 2^64, by halves that are exact in double precision
    low, high = (np.bincount(slot, x.astype(float), n).astype(np.uint64) for x in (value & np.uint64(0xFFFFFFFF), value >> np.uint64(32)))
    sums = ((high << np.uint64(32)) + low).reshape(m, parts, pieces)
    count = np.bincount(slot, minlength=n).reshape(m, parts, pieces)
    weak = count[:, :, pairs[:, 0]] + count[:, :, pairs[:, 1]] < least
    tag = mix(seed ^ ((np.uint64(band) << np.uint64(40)) + np.arange(parts * len(pairs), dtype=np.uint64))).reshape(parts, len(pairs))
    sig = mix(mix(sums[:, :, pairs[:, 0]] + tag) + mix(sums[:, :, pairs[:, 1]] ^ _PIECE))
    needy = weak.any(axis=2).sum(axis=1) > spare
    out, whose = [sig[~weak]], [np.nonzero(~weak)[0]]
    if needy.any():
        poor, at = sig[weak & needy[:, None, None]], np.nonzero(weak & needy[:, None, None])[0]
        if depth < REFINED:
            some = np.flatnonzero(needy)
            finer, of = _band_signatures(features[needy[owner]], sizes[some], band, num, den, depth + 1)
            order = np.argsort(of, kind="stable")
            finer, many = finer[order], np.bincount(of, minlength=len(some))
            begin = (np.cumsum(many) - many)[np.searchsorted(some, at)]
            many = many[np.searchsorted(some, at)]
            pick = np.repeat(begin, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            poor, at = mix(np.repeat(poor, many) ^ (finer[pick] + _PART)), np.repeat(at, many)
        out.append(poor)
        whose.append(at)
    return np.concatenate(out), np.concatenate(whose)


def signatures(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, set) of the PartEnum signatures of sets of 64-bit features, for their own size bands and the next."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bands = np.array([band_of(int(n), num, den) if n else -2 for n in sizes])
    out, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for band in np.unique(np.concatenate([bands, bands + 1])):
        if band < 0:
            continue
        members = np.flatnonzero((bands == band) | (bands == band - 1))
        if not len(members):
            continue
        found, at = _band_signatures(np.concatenate([sets[k] for k in members.tolist()]), sizes[members], int(band), num, den)
        out.append(found)
        whose.append(members[at])
    return np.concatenate(out), np.concatenate(whose)


def sketch(features: np.ndarray) -> bytes:
    """How many features (modulo 16) fall on each of a power of two of counters, one for 2 to 4 features; two to a byte.

    Distances of the counters of two sets, on a ring of 16, add up to no more than their symmetric difference. With many more features to
    a counter unlike sets look alike, and large buckets hang together by that.
    """
    width = 1 << max(5, (len(features) // 2).bit_length() - 1)
    counters = (np.bincount((mix(features ^ _VALUE) & np.uint64(width - 1)).astype(np.int64), minlength=width) % 16).astype(np.uint8)
    return (counters[: width // 2] | counters[width // 2 :] << 4).tobytes()


def _counters(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of one length as rows of ``width`` counters: longer ones are folded."""
    raw = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    found = np.concatenate([raw & 15, raw >> 4], axis=1)
    while found.shape[1] > width:
        found = (found[:, : found.shape[1] // 2] + found[:, found.shape[1] // 2 :]) & 15
    return found.astype(np.int8)


def plausible(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of rows of counters, of sets of these sizes, aren't ruled out as similar."""
    apart = np.abs(a - b)
    apart = np.minimum(apart, 16 - apart).sum(axis=1, dtype=np.int64)
    return ((den + num) * apart <= (den - num) * (size_a + size_b)) & (num * np.maximum(size_a, size_b) <= den * np.minimum(size_a, size_b))


def set_key(features: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, the same for equal sets."""
    n = np.uint64(len(features))
    return int(mix(np.array([np.sum(mix(features)) + n]))[0]), int(mix(np.array([np.sum(mix(features ^ _VALUE)) ^ n]))[0])


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data, at = utf8(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + 4 * SLICE_BYTES, "right")) - 1)
        h, _, _, offsets = words(data, at[low : high + 1], WORDS)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield np.unique(shingles(h[a:b], k))
        low = high


# ---------------------------------------------------------------- signatures in packets


#: A packet has the signatures that go to ``p``: 40 bits of each (candidates are verified), by set; or what sets there are.
_PACKETS = "p int, low binary, high binary, key binary, many binary, sets binary, sketches array<binary>"


def _packets(docs: DataFrame, k: int, num: int, den: int, groups: int) -> DataFrame:
    """Signatures of the sets of rows (id, text), one set of each task's equal ones, and (id, size, key) of all rows."""
    signed_, packet = SIGNED, PACKET

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sig, key = (np.concatenate(c) for c in zip(*held))
        p = ((sig >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(p.astype(np.uint16) if groups < 1 << 16 else p, kind="stable")
        sig, key, p = sig[order], key[order], p[order]
        edges = np.searchsorted(p, np.arange(groups + 1))
        rows: list[tuple] = []
        for g in np.flatnonzero(np.diff(edges)).tolist():
            s, x = sig[edges[g] : edges[g + 1]], key[edges[g] : edges[g + 1]]
            begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            many = np.diff(np.append(begin, len(x)))
            if many.max() > 0xFFFF:  # counts have two bytes
                begin = np.concatenate([np.arange(b, b + n, 0xFFFF) for b, n in zip(begin.tolist(), many.tolist())])
                many = np.diff(np.append(begin, len(x)))
            many = many.astype(np.uint16)
            rows.append((g, s.astype(np.uint32).tobytes(), (s >> np.uint64(32)).astype(np.uint8).tobytes(), x[begin].tobytes(), many.tobytes(), None, None))
        yield _packet(rows)

    def _packet(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), *(pa.binary(),) * 5, pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in _PACKETS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sign(sets: list[np.ndarray], keys: list[int]) -> None:
            nonlocal size
            sig, whose = signatures(sets, num, den)
            held.append((sig, np.array(keys, np.uint64)[whose]))
            size += len(sig)

        for batch in batches:
            ids = batch.column(0)
            described, sketches, sets, keys, waiting = [], [], [], [], 0
            for s in _sets(batch.column(1), k):
                key = set_key(s)
                described.append((len(s), *key))
                sketches.append(sketch(s))
                if len(s) * (den - num) >= num and key not in seen:  # smaller ones are similar to equal ones alone
                    seen.add(key)
                    sets.append(s)
                    keys.append(key[0])
                    waiting += len(s)
                    if waiting > signed_:
                        sign(sets, keys)
                        sets, keys, waiting = [], [], 0
            if sets:
                sign(sets, keys)
            rows = np.array(described, np.uint64).reshape(-1, 3)
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            whole = np.column_stack([ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64), valid.astype(np.uint64), rows])
            yield _packet([(int(rows[:, 1].sum(dtype=np.uint64) % np.uint64(groups)), None, None, None, None, whole.tobytes(), sketches)])
            if size > packet:
                yield from packed(held)
                held, size = [], 0
                if len(seen) > 1 << 18:
                    seen = set()
        if held:
            yield from packed(held)

    return map_batches(docs, run, _PACKETS)


#: kind 0: sets a and b share a signature; 1: set a is in the large bucket c, whose least is b; 2: row id a has a set of b features, key (c, d), sketch s.
_FOUND = "kind byte, a long, b long, c long, d long, s binary"
_PAIR, _MEMBER, _ROW = range(3)


def _buckets(packets: DataFrame, small: int) -> DataFrame:
    """What the packets of each group say."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def batch(kind: int, columns: list[np.ndarray], null: np.ndarray | None = None, sketches: pa.Array | None = None) -> pa.RecordBatch:
        n = len(columns[0])
        arrays = [pa.array(signed(np.ascontiguousarray(c).view(np.uint64)), mask=null if j == 0 else None) for j, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *arrays, pa.nulls(n, pa.binary()) if sketches is None else sketches], names)

    def join(sig: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(sig)
        sig, key = sig[order], key[order]
        same = sig[1:] == sig[:-1]
        many = np.append(same, False) | np.append(False, same)
        sig, key = sig[many], key[many]
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]))[: len(sig)]
        sig, key = sig[new], key[new]
        begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
        size = np.diff(np.append(begin, len(sig)))
        pairs = []
        for m in np.unique(size[(size > 1) & (size <= small)]).tolist():
            at = begin[size == m]
            for j in range(1, m):
                for i in range(j):
                    pairs.append(np.stack([key[at + i], key[at + j]]))
        if pairs:
            both = np.unique(np.concatenate(pairs, axis=1), axis=1)
            zero = np.zeros(both.shape[1], np.uint64)
            yield batch(_PAIR, [both[0], both[1], zero, zero])
        large = np.repeat(size > small, size)
        if large.any():
            least = np.repeat(key[begin], size)[large]
            yield batch(_MEMBER, [key[large], least, sig[large], np.zeros(len(least), np.uint64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 1):
            p = np.uint64(group.column("p")[0].as_py())
            sigs, keys = [], []
            for part in group.to_batches():
                for low, high, key, many, sets, sketches in zip(*(part.column(n) for n in ("low", "high", "key", "many", "sets", "sketches"))):
                    if sets.is_valid:
                        rows = np.frombuffer(sets.as_buffer(), np.uint64).reshape(-1, 5)
                        yield batch(_ROW, [rows[:, 0], rows[:, 2], rows[:, 3], rows[:, 4]], rows[:, 1] == 0, sketches.values)
                        continue
                    s = np.frombuffer(low.as_buffer(), np.uint32).astype(np.uint64) | np.frombuffer(high.as_buffer(), np.uint8).astype(np.uint64) << np.uint64(32)
                    sigs.append(s | (p << np.uint64(40)))
                    keys.append(np.repeat(np.frombuffer(key.as_buffer(), np.uint64), np.frombuffer(many.as_buffer(), np.uint16)))
            if sigs:
                yield from join(np.concatenate(sigs), np.concatenate(keys))

    return map_batches(packets, run, _FOUND)


# ---------------------------------------------------------------- verification


def _plausible_pairs(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` that sketches don't rule out."""
    side = lambda x: classes.select(F.col("k1").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            sa, sb = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            keep = np.zeros(len(na), bool)
            shapes = np.array([(len(x), len(y)) for x, y in zip(sa, sb)]).reshape(-1, 2)
            for shape in np.unique(shapes, axis=0):
                some = np.flatnonzero((shapes == shape).all(axis=1))
                width = 2 * int(shape.min())
                step = max(1, (1 << 23) // width)
                for low in range(0, len(some), step):
                    at = some[low : low + step]
                    keep[at] = plausible(_counters([sa[k] for k in at.tolist()], width), _counters([sb[k] for k in at.tolist()], width), na[at], nb[at], num, den)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    held = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb")
    return map_batches(held, run, "a long, b long")


def _plausible_ties(units: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a spanning forest of the pairs of different components ``comp`` that sketches don't rule out, in each unit (g, bi, bj). What ties so far
    hold together (``tied``, null: nothing) is one vertex, named by that, which is one of its sets: nothing that is tied already is tied again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            keys, blk, comp, size = (group.column(n).to_numpy() for n in ("k1", "blk", "comp", "n"))
            name, vertex = np.unique(pc.coalesce(group.column("tied"), group.column("k1")).to_numpy(), return_inverse=True)
            one, two = (np.flatnonzero(blk == group.column(n)[0].as_py()) for n in ("bi", "bj"))
            if not len(one) or not len(two) or len(np.unique(comp)) < 2 or len(name) < 2:
                continue
            sketches = group.column("s").to_pylist()
            width = 2 * min(map(len, sketches))
            counters = np.empty((len(sketches), width), np.int8)
            for n in {len(x) for x in sketches}:
                some = [k for k, x in enumerate(sketches) if len(x) == n]
                counters[some] = _counters([sketches[k] for k in some], width)
            tree = Forest(len(name))
            for i in one.tolist():  # a row at a time: memory doesn't grow with the square of a block
                ok = two[(comp[two] != comp[i]) & (vertex[two] != vertex[i])]
                ok = ok[plausible(counters[i][None, :], counters[ok], size[i], size[ok], num, den)]
                if len(ok):
                    tree.add(np.full(len(ok), vertex[i]), vertex[ok])
                    if len(tree.left) == len(name) - 1:  # all hang together
                        break
            if tree.left:
                yield pa.RecordBatch.from_arrays([pa.array(name[tree.left]), pa.array(name[tree.right])], ["a", "b"])

    return map_batches(units, run, "a long, b long")


def _featured(needs: DataFrame, docs: DataFrame, k: int, shape: str, names: list[str]) -> DataFrame:
    """``needs`` (id, k1, k2, units: arrays of structs of ``names``) with the features of their sets, a row per unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(batch.schema.get_field_index("units"))
            ids, k1, k2 = (batch.column(batch.schema.get_field_index(n)) for n in ("id", "k1", "k2"))
            many, flat = units.value_lengths().to_numpy(zero_copy_only=False), units.flatten()
            cuts = np.concatenate([[0], np.cumsum(many)])
            for at, s in enumerate(_sets(batch.column(batch.schema.get_field_index("text")), k)):
                # an id may stand for several rows: only the text whose set is meant counts
                if tuple(signed(np.array(set_key(s), np.uint64)).tolist()) != (k1[at].as_py(), k2[at].as_py()):
                    continue
                n, raw = int(many[at]), s.tobytes()
                here = flat.slice(int(cuts[at]), n)
                step = max(1, (4 << 20) // max(1, len(raw)))
                for low in range(0, n, step):
                    part = here.slice(low, step)
                    yield pa.RecordBatch.from_arrays([*(part.field(names.index(x)) for x in names), *(pa.repeat(c[at], len(part)) for c in (ids, k1)), pa.array([raw] * len(part), pa.binary())], [*names, "id", "k1", "f"])

    found = needs.join(_asked(docs, needs), "id").select("id", "k1", "k2", "units", "text")
    return map_batches(found, run, f"{shape}, id long, k1 long, f binary")


def _asked(docs: DataFrame, needs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an id of ``needs``, and a few others: no other text is shuffled. What is broadcast has ASKED rows at most."""
    taken = F.pmod(F.xxhash64("id"), F.lit(ASKED).cast("long"))
    return docs.join(F.broadcast(needs.select(taken.alias("asked")).distinct()), taken == F.col("asked"), "left_semi")


def _verify_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): ids of linked sets, of units (ua, us): one set (role 0) and those that it is to be compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 2):
            role, ids = group.column("role").to_numpy(), group.column("id").to_numpy()
            sets = [np.frombuffer(f.as_buffer(), np.uint64) for chunk in group.column("f").chunks for f in chunk]
            rest = np.flatnonzero(role == 1)
            if not len(rest):
                continue
            size = np.array([len(sets[j]) for j in rest.tolist()])
            every, owner = np.concatenate([sets[j] for j in rest.tolist()]), np.repeat(np.arange(len(rest)), size)
            for c in np.flatnonzero(role == 0).tolist():
                one = sets[c]
                at = np.minimum(np.searchsorted(one, every), len(one) - 1)
                shared = np.bincount(owner[one[at] == every], minlength=len(rest))
                linked = (den * shared >= num * (len(one) + size - shared)) & (ids[rest] != ids[c])
                if linked.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(linked.sum()), ids[c])), pa.array(ids[rest[linked]])], ["a", "b"])

    return map_batches(rows, run, "a long, b long")


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: sums of 0/1 products, a few thousand features at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out
    at_a, at_b = np.searchsorted(common, a), np.searchsorted(common, b)
    ok_a, ok_b = common[np.minimum(at_a, len(common) - 1)] == a, common[np.minimum(at_b, len(common) - 1)] == b
    row_a, at_a, row_b, at_b = row_a[ok_a], at_a[ok_a], row_b[ok_b], at_b[ok_b]
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    row_a, at_a, row_b, at_b = row_a[order_a], at_a[order_a], row_b[order_b], at_b[order_b]
    step = 2048
    for low in range(0, len(common), step):
        width = min(step, len(common) - low)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        i, j = np.searchsorted(at_a, (low, low + width)), np.searchsorted(at_b, (low, low + width))
        x[row_a[i[0] : i[1]], at_a[i[0] : i[1]] - low] = 1
        y[row_b[j[0] : j[1]], at_b[j[0] : j[1]] - low] = 1
        out += x @ y.T
    return out


def _verify_blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a spanning forest of the links between different components ``comp`` in each unit (g, bi, bj)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            ids, blk, comp = (group.column(n).to_numpy() for n in ("id", "blk", "comp"))
            sets = [np.frombuffer(f.as_buffer(), np.uint64) for chunk in group.column("f").chunks for f in chunk]
            one, two = (np.flatnonzero(blk == group.column(n)[0].as_py()) for n in ("bi", "bj"))
            if not len(one) or not len(two):
                continue
            size = np.array([len(s) for s in sets])
            shared = _intersections([sets[x] for x in one], [sets[x] for x in two]).astype(np.int64)
            linked = den * shared >= num * (size[one][:, None] + size[two][None, :] - shared)
            x, y = np.nonzero(linked & (comp[one][:, None] != comp[two][None, :]))
            x, y = forest(len(sets), one[x], two[y])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["a", "b"])

    return map_batches(rows, run, "a long, b long")


def _placed(rows: DataFrame, part: str = "comp") -> DataFrame:
    """``rows`` (g, part, tie, ...) in units in which what isn't in the largest ``part`` of a group meets all others of it."""
    top = rows.groupBy("g", part).agg(F.count("*").alias("m")).groupBy("g").agg(F.max(F.struct("m", part)).alias("top"), F.sum("m").alias("m"))
    top = top.select("g", F.col(f"top.{part}").alias("main"), (F.col("m") - F.col("top.m")).alias("n_home"), F.col("top.m").alias("n_other")).where("n_home > 0")
    return meetings(spread_join(rows, top, "g", "tie").withColumn("home", F.col(part) != F.col("main")))


def _unresolved(members: DataFrame, classes: DataFrame, pairs: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame | None:
    """(g, bi, bj, blk, comp, id, k1, k2): units of the sets of large buckets that may be linked and aren't tied by the links so far, None if there are none.

    Within a bucket, sets of different components are compared by sketches; what hangs together by what is left is a cluster g. The plausible
    ``pairs`` of each with the bucket's least tell most of what hangs together; only what these leave apart meets block by block. Sets that are alike share many buckets, so first some of
    the buckets are looked at, and then, in all others, what those leave apart.
    """
    spark = members.sparkSession
    reach = connected_components(links)
    named = classes.select("k1", "k2", "n", "s", F.col("first").alias("id")).join(reach, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    named, one = scratch_table(named, "named")
    side = lambda x: named.select(F.col("k1").alias(x), F.col("comp").alias(f"c{x}"))
    stars = members.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))
    stars = pairs.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select("a", "b").join(stars, ["a", "b"], "left_semi")
    ties, two = scratch_table(stars, "ties")
    held = members.select(F.col("a").alias("k1"), F.col("c").alias("g")).join(named.select("k1", "n", "s", "comp"), "k1")
    held, three = scratch_table(held, "members")
    open_ = held.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("g")
    held, four = scratch_table(held.join(open_, "g", "left_semi"), "members")
    paths = [two, three, four]
    for some in (F.pmod(F.xxhash64("g"), F.lit(EARLY)) == 0, F.pmod(F.xxhash64("g"), F.lit(EARLY)) != 0):
        tied = connected_components(ties).select(F.col("id").alias("k1"), F.col("component").alias("tied"))
        part = F.struct(F.col("tied").isNull().alias("alone"), F.coalesce("tied", "comp").alias("of"))  # what need not meet
        rows, path = scratch_table(held.where(some).join(tied, "k1", "left").withColumn("part", part), "members")
        units = _placed(rows.withColumn("tie", F.xxhash64("k1")), "part").select("g", "bi", "bj", "blk", "comp", "tied", "k1", "n", "s")
        more, last = scratch_table(_plausible_ties(units.repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj"), num, den).distinct(), "ties")
        ties = ties.unionByName(more)
        paths += [path, last]
    if ties.isEmpty():
        discard(spark, one, *paths)
        return None
    clusters = connected_components(ties)
    discard(spark, *paths)
    every = clusters.select(F.col("id").alias("k1"), F.col("component").alias("g")).join(named.select("k1", "k2", "id", "comp"), "k1")
    return _placed(every.withColumn("tie", F.xxhash64("k2"))).select("g", "bi", "bj", "blk", "comp", "id", "k1", "k2")


def _links(found: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, list[str]]:
    """(a, b): linked ids of classes, enough to tie all that links reach; and the scratch tables it is read from."""
    pairs = found.where(f"kind = {_PAIR}").select("a", "b")
    members = found.where(f"kind = {_MEMBER}")  # of large buckets
    stars = members.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs, one = scratch_table(_plausible_pairs(pairs.unionByName(stars).distinct(), classes, num, den), "pairs")
    # units of one set and so many others that they fit together
    centre = pairs.groupBy("a").agg(F.count("*").alias("deg")).withColumnRenamed("a", "k1").join(classes.select("k1", "n"), "k1")
    centre = centre.groupBy("k1").agg(F.max(F.greatest(F.lit(1), F.ceil(F.col("deg") * F.col("n") / UNIT))).cast("int").alias("cuts"))
    role = lambda x: F.lit(x).cast("int").alias("role")
    mine = centre.select("k1", F.col("k1").alias("ua"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("us"), role(0))
    theirs = pairs.join(centre.withColumnRenamed("k1", "a"), "a").select(F.col("b").alias("k1"), F.col("a").alias("ua"), F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int").alias("us"), role(1))
    needs = mine.unionByName(theirs).groupBy("k1").agg(F.collect_list(F.struct("ua", "us", "role")).alias("units"))
    needs, three = scratch_table(needs.join(classes.select("k1", "k2", F.col("first").alias("id")), "k1"), "needs")
    rows = _featured(needs, docs, k, "ua long, us int, role int", ["ua", "us", "role"])
    links, two = scratch_table(_verify_pairs(rows.repartition("ua", "us").sortWithinPartitions("ua", "us", "role"), num, den), "links")
    paths = [one, two, three]
    if not members.isEmpty() and (work := _unresolved(members, classes, pairs, links, num, den)) is not None:
        names = ["g", "bi", "bj", "blk", "comp"]
        needs, four = scratch_table(work.groupBy("id", "k1", "k2").agg(F.collect_list(F.struct(*names)).alias("units")), "needs")
        rows = _featured(needs, docs, k, "g long, bi int, bj int, blk int, comp long", names)
        more, five = scratch_table(_verify_blocks(rows.repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj"), num, den), "links")
        links = links.unionByName(more)
        paths += [four, five]
    return links, paths


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``.

    A row's set has the distinct runs of ``k`` words (fewer words: the whole sequence; none, or a
    null text: empty, linked with nothing). Words are runs of other bytes than space and \\t to \\r;
    A-Z count as a-z. Rows with den * intersection >= num * union are linked; component_id is
    the smallest id that links reach. Equal sets are one vertex, however many rows have them; rows
    with the same id count as one document. Features are 64-bit hashes. Other columns are ignored;
    a null id is its own component. Long texts are cut into words slice by slice; an empty table has no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    # a packet group for each two million signatures: a byte of text has about a tenth of one
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 20_000_000 + 1)
    packets = _packets(docs, k, num, den, groups).repartitionById(groups, "p").sortWithinPartitions("p")
    found, one = scratch_table(_buckets(packets, SMALL), "buckets")
    sets = found.where(f"kind = {_ROW}").select(F.col("a").alias("id"), F.col("b").alias("n"), F.col("c").alias("k1"), F.col("d").alias("k2"), "s")
    classes, two = scratch_table(sets.where("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min("id").alias("first"), F.first("s").alias("s")), "classes")
    links, paths = _links(found, classes, docs.where("id is not null and text is not null"), k, num, den)
    reach = connected_components(links).withColumnRenamed("id", "first")
    named = classes.join(reach, "first", "left").select("n", "k1", "k2", F.coalesce("component", "first").alias("component"))
    rows, _ = scratch_table(sets.drop("s").join(named, ["n", "k1", "k2"], "left").select("id", "n", "component"), "components")
    discard(spark, one, two, *paths)
    return rows.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of ``jaccard_components``: the one with the smallest id; all columns stay, whatever their names.

    Rows of empty sets (null and empty texts) are in no group and all stay, and so do rows without an id. Of rows that repeat
    the smallest id one stays (the least by text). Rows of an empty table are none.
    """
    names = docs.columns
    i, r = fresh(names, "id", "row")
    found, _ = scratch_table(jaccard_components(docs, k, num, den, id, text).where(F.col("n_shingles") > 0), "groups")
    gone, _ = scratch_table(found.where(F.col(id) != F.col("component_id")).select(F.col(id).alias(i)).distinct(), "gone")  # often few: Spark sees how many
    kept = docs.join(gone, F.col(id).cast("long") == F.col(i), "left_anti")
    twice = found.where(F.col(id) == F.col("component_id")).groupBy(F.col(id).alias(i)).count().where("count > 1").drop("count")
    if twice.isEmpty():
        return kept
    repeated = F.col(id).cast("long") == F.col(i)
    order = F.struct(F.col(text).isNull(), F.col(text), F.to_json(F.struct(*(F.col(f"`{n}`") for n in names))))
    some = kept.join(twice, repeated, "left_semi")
    first = some.groupBy(F.col(id).alias(i)).agg(F.min_by(F.struct(*(F.col(f"`{n}`") for n in names)), order).alias(r)).select(f"{r}.*")
    return kept.join(twice, repeated, "left_anti").unionByName(first)
