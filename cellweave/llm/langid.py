"""Language ID by compression: the language whose dictionary compresses a text best.

For every language seen in training a zstandard raw-content dictionary is cut from a bounded
sample of its texts. A text is encoded with each dictionary, block by block so that all of a long
text is judged and memory stays bounded; the smallest total wins, and a narrow margin rejects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

UNKNOWN = "und"

#: Bytes of text that are encoded at a time, and zstandard's level.
BLOCK_BYTES, LEVEL = 16_384, 6

#: So many bytes of the dictionary stand before each block: a block that doesn't compress at all is
#: stored as it is, which would hide what a dictionary saves on a short text.
PRIMER_BYTES = 64

#: A best total that is not under the second by this share is rejected.
MARGIN = 0.004


def fold_of(id: str, folds: int):
    return F.pmod(F.crc32(F.col(id).cast("string")), F.lit(folds))


def learn_dictionaries(docs: DataFrame, per_language: int = 300, least_rows: int = 1, id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """{language: dictionary}, frequent languages first.

    The sample is at most ``per_language`` rows of each language, the least by hash of id and text, each of them whole; that and the
    number of languages (those of ``least_rows`` rows or more) bound what training brings to the driver. Rows without text or language
    teach nothing; equal rows count once each; other columns are ignored; an empty table teaches no language.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("l"), F.xxhash64(id, F.lit("langid"), text).alias("h"), F.col(text).alias("t"))
    counts = {r.l: r["count"] for r in rows.groupBy("l").count().where(F.col("count") >= least_rows).collect()}
    if not counts:
        return {}
    # a share of rows by hash that has some more than wanted of each language: only these are sorted
    share = docs.sparkSession.createDataFrame([(k, min(1.0, (2 * per_language + 100) / n)) for k, n in counts.items()], "l string, share double")
    order = F.pmod("h", F.lit(1 << 30))
    some = rows.join(F.broadcast(share), "l").where(order < F.col("share") * (1 << 30)).withColumn("o", order)
    kept = some.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("o", "t"))).where(F.col("k") <= per_language)
    found: dict[str, list] = {}
    for r in kept.select("l", "k", "t").collect():
        found.setdefault(r.l, []).append((r.k, r.t))
    # zstandard finds what stands last at the least cost, so the order among equals is kept fixed
    return {k: "\n".join(t for _, t in sorted(found[k])).lower().encode() for k in sorted(found, key=lambda k: (-counts[k], k))}


class Encoders:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.names, self.encoders = list(dictionaries), []
        self.primers = [d[-PRIMER_BYTES:] for d in dictionaries.values()]
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK_BYTES, dict_size=len(dictionaries[name]), write_content_size=False, write_checksum=False, write_dict_id=False)
            content.precompute_compress(compression_params=parameters)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=parameters).compress)

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[k : k + BLOCK_BYTES] for k in range(0, len(text), BLOCK_BYTES)]
        return [sum(len(encode(primer + b)) for b in blocks) for encode, primer in zip(self.encoders, self.primers)]


def _judge(encoders: Encoders, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and margin of each text."""
    texts = pc.fill_null(column, "")
    letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    names, margins = [], np.zeros(len(texts))
    for k, (t, has) in enumerate(zip(texts, letters.tolist())):
        if not has or not encoders.names:
            names.append(UNKNOWN)
            continue
        sizes = encoders.sizes(t.as_py().lower().encode())
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        names.append(encoders.names[order[0]])
        margins[k] = 1 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 else 1.0
    return names, margins


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, margin, accepted) per row of ``docs``.

    ``lang_pred`` is ``und`` for a text that is null or has no letter, and if no language was
    learned; ties go to the language that is more frequent in training. ``margin`` (the column) is the share by which the
    best total is under the second, 1 if there is one language only; ``accepted`` is false for
    ``und`` and below the ``margin`` given. ``score`` maps the margin to 0 to 1 (half at 2 %).
    Other columns are ignored; repeated rows give equal results; long texts are encoded whole, block by block.
    """
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(held.value)
        for batch in batches:
            names, margins = _judge(encoders, batch.column(1))
            known = np.array([n != UNKNOWN for n in names], bool)
            score = np.where(known, margins / (margins + 0.02), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(margins), pa.array(known & (margins >= margin))], ["id", "lang_pred", "score", "margin", "accepted"])

    return map_batches(docs, run, "id long, lang_pred string, score double, margin double, accepted boolean").withColumnRenamed("id", id)


def keep_accepted(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``predict`` accepts, whole and where they are: no join.

    Null, empty and letterless texts go, and those of two languages that compress about alike; repeated rows share their fate, all
    columns stay, an empty table stays empty, and without any dictionary all rows go.
    """
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(held.value)
        for batch in batches:
            names, margins = _judge(encoders, batch.column(at))
            yield batch.filter(pa.array([n != UNKNOWN and m >= margin for n, m in zip(names, margins.tolist())], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def identify_languages(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``predict`` for all rows, learned from those with a language whose fold (crc32 of id mod 4) isn't 2."""
    learned = learn_dictionaries(docs.where(fold_of(id, 4) != 2), id=id, text=text, lang=lang)
    found = predict(docs, learned, id=id, text=text)
    return found.select(id, (fold_of(id, 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "accepted")
