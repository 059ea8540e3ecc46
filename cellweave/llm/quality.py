"""Quality rules: word, symbol and repetition counts, and bands of compression.

What zstandard makes of a text tells repetition (it shrinks far more than prose) and noise (it hardly shrinks). Both the whole text and
fixed chunks of it are compressed, and the share that is left must lie within limits for that length: short texts hardly shrink,
whatever they are, so limits narrow as texts grow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: (bytes below which it holds, least, greatest share that compression leaves), for level LEVEL. Rules of thumb for natural language of any script:
#: prose leaves 0.3 to 0.7 of a few kilobytes, base64 and other noise of 6 bits a byte 0.75 and more, repeated lines under 0.1.
BANDS: tuple[tuple[float, float, float], ...] = (
    (128, 0.25, 2.0),
    (256, 0.20, 1.05),
    (512, 0.18, 0.90),
    (1024, 0.15, 0.80),
    (4096, 0.13, 0.75),
    (16_384, 0.11, 0.72),
    (float("inf"), 0.09, 0.70),
)

#: Level of zstandard, bytes of a chunk, and the share of a text's bytes in chunks outside of their band from which it is rejected.
LEVEL, CHUNK_BYTES, BAD_SHARE = 3, 4096, 0.25

#: Words of a window, fewest words, and the percentage of words in repeated windows above which a text fails.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

_SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(_SYMBOLS, np.uint8))


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """How many words stand in windows that the text has twice or more, their first places included. Windows are compared exactly: equal
    ones get equal numbers, made of those of their two halves."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    one = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    names, size, have = one, 1, len(number)
    while size < window:
        step = min(size, window - size)
        longer = names[: len(names) - step] * np.int64(have) + names[step:]
        names = np.unique(longer, return_inverse=True)[1].astype(np.int64)
        have, size = int(names.max()) + 1, size + step
    twice = np.bincount(names)[names] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows) of a text.

    Words are runs of other characters than space and \\t to \\r; a line counts if it has a word and equals an earlier one.
    """
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blank = sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = int(_IS_SYMBOL[np.frombuffer(raw, np.uint8)].sum())
    return len(words), len(text) - blank, symbols, len(lines) - len(set(lines)), repeated_words(words)


@dataclass(frozen=True)
class Bands:
    """Limits by length for the share of bytes that compression leaves."""

    limits: tuple[tuple[float, float, float], ...] = BANDS
    chunk_bytes: int = CHUNK_BYTES
    bad_share: float = BAD_SHARE
    level: int = LEVEL

    def outside(self, size: int, left: int) -> bool:
        _, low, high = next(b for b in self.limits if size < b[0])
        return not low * size <= left <= high * size

    def judge(self, raw: bytes, compress) -> tuple[float, float, bool]:
        """(share that is left of the whole, share of its bytes in bad chunks, within the bands). Nothing is within them of an empty text."""
        if not raw:
            return 0.0, 0.0, False
        left = len(compress(raw))
        bad = 0
        for k in range(0, len(raw), self.chunk_bytes):
            chunk = raw[k : k + self.chunk_bytes]
            if self.outside(len(chunk), left if len(chunk) == len(raw) else len(compress(chunk))):
                bad += len(chunk)
        share = bad / len(raw)
        return left / len(raw), share, not self.outside(len(raw), left) and share <= self.bad_share


def quality(docs: DataFrame, bands: Bands = Bands(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, left_share, bad_chunk_share) per row of ``docs``.

    ``base_failed``: fewer than LEAST_WORDS words, or more than MOST_REPEATED percent of them in repeated windows. ``kept``: not that, and
    within the bands. Null and empty texts have no words, so they fail; texts of any length are judged whole, one at a time; repeated rows and null ids
    are rows like others; an empty table gives none; other columns are ignored.
    """
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_share", "bad_chunk_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level, write_content_size=False).compress
        for batch in batches:
            out = []
            for value in batch.column(1):
                t = value.as_py() or ""
                counts = base_counts(t)
                failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
                left, bad, within = bands.judge(t.encode(), compress)
                out.append((*counts, failed, not failed and within, left, bad))
            if out:
                kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)

    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, left_share double, bad_chunk_share double"
    return map_batches(docs, run, schema).withColumnRenamed("id", id)
