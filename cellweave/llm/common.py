"""Helpers shared by the operators: scratch tables, Arrow batches, vectorised word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text is hashed in slices of about this many bytes, so that memory doesn't grow with a text.
SLICE_BYTES = 1 << 20

#: Most bytes of an Arrow batch on its way to Python.
BATCH_BYTES = "8m"
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where a session doesn't set it, a temporary folder is made once if all runs on this machine; else it's an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _made:
            _made.append(tempfile.mkdtemp(prefix="cellweave-"))
        found = _made[0]
    return found.rstrip("/")


_made: list[str] = []


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``taken`` has, however it is written."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        k = 0
        while f"__{name}{k}" in used:
            k += 1
        out.append(f"__{name}{k}")
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cellweave-{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and where it is."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    return scratch_table(df, name)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing will read any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


# ---------------------------------------------------------------- Arrow batches


def _give_back() -> None:
    """What the allocators hold beyond what is in use goes back to the system: workers stay when a task is over."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``, with batches of BATCH_BYTES unless the session asks for other than Spark's default.

    A batch is held several times over, by the executor and by Python, and by each task at once.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        conf.set(_BATCH_CONF, BATCH_BYTES)

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(frugal, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out
                del out

    return map_batches(df, run, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal first ``n_keys`` columns (integers), of rows sorted by these."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        starts = [0, *cuts.tolist()]
        for a, b in zip(starts, [*cuts.tolist(), batch.num_rows]):
            key = keys[:, a].tolist()
            if key != last and held:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without copying, and the n + 1 offsets; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    x = x ^ (x >> np.uint64(29))
    x = x * _BASE
    return x ^ (x >> np.uint64(32))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def _lookup(is_part: Callable[[int], bool], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    part = np.array([is_part(b) for b in range(256)])
    value = np.arange(1, 257, dtype=np.uint64)
    if lower:
        value[65:91] = value[97:123]
    return part, value


#: Words are runs of other bytes than space and \t \n \v \f \r; A-Z count as a-z.
WORDS = _lookup(lambda b: not (b == 32 or 9 <= b <= 13), True)
#: Words are runs of letters and digits: ASCII ones, and all that isn't ASCII; A-Z count as a-z.
LETTERS = _lookup(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128, True)


def _cuts(data: np.ndarray, at: np.ndarray, part: np.ndarray) -> list[int]:
    """Where to cut the bytes into slices: at a text's start, or at a separator inside a long text."""
    cuts = [int(at[0])]
    end = int(at[-1])
    while end - cuts[-1] > SLICE_BYTES:
        low = cuts[-1]
        k = int(np.searchsorted(at, low + SLICE_BYTES, "right")) - 1
        if at[k] > low:
            cuts.append(int(at[k]))
            continue
        stop = int(at[k + 1])  # one text is longer than a slice
        p = low + SLICE_BYTES
        while p < stop:
            gap = np.flatnonzero(~part[data[p : min(stop, p + 65536)]])
            if len(gap):
                p += int(gap[0])
                break
            p = min(stop, p + 65536)
        cuts.append(p)
    if end > cuts[-1]:
        cuts.append(end)
    return cuts


def words(data: np.ndarray, at: np.ndarray, kind: tuple[np.ndarray, np.ndarray] = WORDS, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, offsets): 64-bit hash and byte range of every word of every text.

    Words of text i are those from offsets[i] to offsets[i + 1]. With ``prefixes``, hashes has a
    column for the word and one for each of its beginnings of so many bytes (that of a shorter word is 0).
    """
    part, value = kind
    hashes, starts, ends = [], [], []
    cuts = _cuts(data, at, part)
    for low, high in zip(cuts, cuts[1:]):
        piece = data[low:high]
        inside = part[piece]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        texts = at[(at >= low) & (at < high)] - low
        begins[texts] = inside[texts]  # a word doesn't run from one text to the next
        s = np.flatnonzero(begins)
        if not len(s):
            continue
        gaps = np.flatnonzero(~inside)
        e = np.append(gaps, high - low)[np.searchsorted(gaps, s)]
        e[:-1] = np.minimum(e[:-1], s[1:])
        up, down = _power_tables(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(value[piece] * up[: high - low], out=total[1:])
        whole = mix((total[e] - total[s]) * down[s])
        if prefixes:
            begun = [np.where(e - s >= n, mix(((total[np.minimum(s + n, e)] - total[s]) * down[s]) ^ np.uint64(n)), np.uint64(0)) for n in prefixes]
            whole = np.column_stack([whole, *begun])
        hashes.append(whole)
        starts.append(s + low)
        ends.append(e + low)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), none, none, np.zeros(len(at), np.int64)
    first = np.concatenate(starts)
    return np.concatenate(hashes), first, np.concatenate(ends), np.searchsorted(first, at)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words; of the whole sequence if it is shorter; none of none."""
    if not len(h):
        return h
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * _STEP + h[j : len(h) - n + 1 + j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
