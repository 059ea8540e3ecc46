"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id into shards whose bounds depend on the rows only, each shard is
written by one task as gzip members, and files roll by compressed size. Headers and digests are
made anew. A file is written under a temporary name and renamed; a manifest that is written last lists
what counts; a reader that misses any of it fails. Of records with equal payloads one is a response and others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, scratch_path, scratch_table
from .graph import spread_join

#: Places (id and the first digits of a digest) that the shards' bounds are taken from, by hash: about that many at most. And most shards.
BOUND_SAMPLE, MOST_SHARDS = 200_000, 10_000

#: Digits of a digest that tell rows of one id apart where shards are cut, and bytes that a record has beside its payload.
DIGITS, HEADERS = 4, 700

CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header's value: control characters would end it, so they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields)
    return head + f"Content-Length: {len(block)}".encode() + CRLF + CRLF + block + CRLF + CRLF


def _gzip(raw: bytes, level: int) -> bytes:
    """A gzip member without time or name: the same bytes every time."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, revisit: bool, refers_to: int | None, serial: int, date: str) -> bytes:
    """A response record, or a revisit of page ``refers_to`` (null: a page without id) without its payload."""
    http = b"HTTP/1.1 200 OK" + CRLF + b"Content-Type: text/html; charset=utf-8" + CRLF + f"Content-Length: {len(payload)}".encode() + CRLF + CRLF
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{url}/{payload_digest}/{serial}")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if refers_to is not None:
            fields.append(("X-Refers-To-Page-ID", str(refers_to)))
    return _record(fields, block)


def _info(name: str, date: str) -> bytes:
    body = b"software: cellweave" + CRLF + b"format: WARC File Format 1.1" + CRLF
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{digest(body)}")]
    return _record(fields, body)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class _Shard:
    """Files of one shard. Each is written under a name of this attempt and renamed when it is whole."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, level: int, date: str):
        self.fs, self.folder = _filesystem(folder)
        self.shard, self.roll_bytes, self.level, self.date = shard, roll_bytes, level, date
        self.attempt, self.file, self.made = uuid.uuid4().hex, None, []

    def add(self, raw: bytes, page_id: int | None) -> None:
        packed = _gzip(raw, self.level)
        if self.file is not None and self.size + len(packed) > self.roll_bytes:
            self.close()
        if self.file is None:
            self.name = f"part-{self.shard:06d}-{len(self.made):05d}.warc.gz"
            self.file = self.fs.open_output_stream(f"{self.folder}/_temporary-{self.attempt}-{self.name}", compression=None)  # else the name decides
            self.size, self.records, self.sum, self.first = 0, 0, hashlib.sha256(), page_id
            self._write(_gzip(_info(self.name, self.date), self.level))
        self._write(packed)
        self.records += 1
        self.last = page_id

    def _write(self, packed: bytes) -> None:
        self.file.write(packed)
        self.sum.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            from pyarrow import fs

            place = f"{self.folder}/{self.name}"
            mine = f"{self.folder}/_temporary-{self.attempt}-{self.name}"
            if self.fs.get_file_info(place).type == fs.FileType.NotFound:
                self.fs.move(mine, place)
            else:  # another attempt's: the same bytes, and perhaps listed
                self.fs.delete_file(mine)
            self.made.append((self.shard, self.name, self.records, self.size, self.sum.hexdigest(), self.first, self.last))
            self.file = None


def _bounds(small: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """(ids, digits) from which the next shard begins: quantiles by bytes of a sample that depends on rows only, whatever the partitions."""
    places = small.where("page_id is not null").groupBy("page_id", "digits").agg(F.sum("bytes").alias("bytes"))
    if shards < 2:
        return [], []
    every = max(1, -(-places.count() // BOUND_SAMPLE))
    rows = places.where(F.pmod(F.xxhash64("page_id", "digits"), F.lit(every)) == 0).collect()
    rows.sort(key=lambda r: (r.page_id, r.digits))
    total = np.cumsum([r.bytes for r in rows])
    if not len(total):
        return [], []
    cuts = np.unique(np.searchsorted(total, total[-1] * np.arange(1, shards) / shards, "right"))
    cuts = cuts[cuts < len(rows)].tolist()
    return [rows[k].page_id for k in cuts], [rows[k].digits for k in cuts]


def _shard_of(bounds: tuple[list[int], list[int]]) -> Column:
    """Number of bounds <= (page_id, digits); rows without id come after all shards of others."""
    ids, digits = (np.array(b, np.int64) for b in bounds)

    @F.pandas_udf("int")
    def shard(page_id, digit):  # noqa: ANN001, ANN202
        import pandas as pd

        page, digit = page_id.to_numpy(np.int64), digit.to_numpy(np.int64)
        low, high = np.searchsorted(ids, page, "left"), np.searchsorted(ids, page, "right")
        for k in np.unique(low[high > low]).tolist():  # shards that begin inside an id
            some = (low == k) & (high > low)
            end = int(high[some][0])
            high[some] = k + np.searchsorted(digits[k:end], digit[some], "right")
        return pd.Series(high.astype(np.int32))

    return shard(F.coalesce("page_id", F.lit(0).cast("long")), F.col("digits"))


def write_archives(pages: DataFrame, folder: str | None = None, shard_bytes: int = 64 << 20, roll_bytes: int = 64 << 20, least_bytes: int = 0, level: int = 6, date: str = "2000-01-01T00:00:00Z", id: str = "page_id", url: str = "url", payload: str = "html") -> tuple[str, DataFrame]:
    """Write a record per row; return the folder and its manifest (shard, file, records, bytes, sha256, first, last).

    The payload is the text in UTF-8, null an empty one. Of rows with equal payloads of at least
    ``least_bytes`` bytes the first by page id (null last; ties by url) is the response, others are revisits; of rows equal in all
    three, one is. Records go by page id (null last), then digest, then url. About ``shard_bytes`` of payload make a shard (more where
    there would be over MOST_SHARDS), which one task writes, and a file ends before it has over ``roll_bytes`` compressed bytes (but has one
    record at least). Rows of one id are spread over shards by digest, and so are rows without id. ``folder`` must be seen by all
    executors. The same rows give the same files, whatever the cluster; of two attempts at a file one stays, with equal bytes. What an
    unfinished write has left in the folder goes first. Other columns are ignored; no rows give no files.
    """
    from pyarrow import fs as filesystems

    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    if fs.get_file_info(f"{path}/_manifest/_SUCCESS").type != filesystems.FileType.NotFound:
        raise ValueError(f"{folder} holds archives already")
    for left in fs.get_file_info(filesystems.FileSelector(path)):
        if left.base_name.startswith(("part-", "_temporary-")) and left.base_name.endswith(".warc.gz"):
            fs.delete_file(left.path)
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html")).withColumn("digits", F.conv(F.substring("sha", 1, DIGITS), 16, 10).cast("int"))
    small, scratch = scratch_table(keyed.select("page_id", F.coalesce("url", F.lit("")).alias("u"), "sha", "digits", "size", (F.col("size") + HEADERS).cast("long").alias("bytes")), "pages")
    total, nameless = (x or 0 for x in small.agg(F.sum("bytes"), F.sum(F.when(F.col("page_id").isNull(), F.col("bytes")))).first())
    each = max(shard_bytes, -(-total // MOST_SHARDS))
    bounds = _bounds(small, max(1, -(-(total - nameless) // each)))
    n_named, n_nameless = len(bounds[0]) + 1, -(-nameless // each)
    # the first page of each payload that occurs twice; needed by later pages only
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "u")
    first = small.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1").select("sha", "f")
    places = small.select("page_id", "sha", "u", "digits").distinct().withColumn("deal", F.xxhash64("page_id", "u"))
    later = spread_join(places, first, "sha", "deal")
    later = later.select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.col("f.page_id").alias("ref"), "u", F.col("f.u").alias("ref_u"), F.lit(True).alias("known"), "digits")
    records = keyed.select("page_id", "sha", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("ref"), F.coalesce("url", F.lit("")).alias("u"), F.lit(None).cast("string").alias("ref_u"), F.lit(False).alias("known"), "digits")
    both = records.unionByName(later)
    beyond = n_named + F.floor(F.col("digits") * n_nameless / 16**DIGITS)
    both = both.withColumn("shard", F.when(F.col("page_id").isNull(), beyond).otherwise(_shard_of(bounds) if bounds[0] else F.lit(0)).cast("int"))
    placed = both.repartitionById(n_named + n_nameless, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "sha", "u", "kind")
    names = ["shard", "page_id", "sha", "kind", "url", "html", "ref", "u", "ref_u", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: _Shard | None = None
        said: tuple | None = None  # (page_id, sha, u, first page, first url) of the last row of kind 0
        before, serial = None, 0
        for batch in batches:
            for s, page_id, sha, kind, url, html, ref, u, ref_u in zip(*(batch.column(j).to_pylist() for j in range(9))):
                if held is None or held.shard != s:
                    if held is not None:
                        held.close()
                        out += held.made
                    held = _Shard(folder, s, roll_bytes, level, date)
                if kind == 0:
                    said = (page_id, sha, u, ref, ref_u)
                    continue
                serial = serial + 1 if before == (page_id, sha, u) else 0
                before = (page_id, sha, u)
                body = html.encode()
                known = said is not None and said[:3] == before
                revisit = known and ((page_id, u) != said[3:] or serial > 0)
                held.add(page_record(page_id, url, body, base64.b32encode(bytes.fromhex(sha)).decode(), revisit, said[3] if revisit else None, serial, date), page_id)
        if held is not None:
            held.close()
            out += held.made
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["shard", "file", "records", "bytes", "sha256", "first", "last"])

    manifest = map_batches(placed.select(*names), run, "shard int, file string, records long, bytes long, sha256 string, first long, last long")
    manifest.write.parquet(f"{folder}/_manifest")  # its _SUCCESS is the commit
    discard(spark, scratch)
    return folder, spark.read.schema("shard int, file string, records long, bytes long, sha256 string, first long, last long").parquet(f"{folder}/_manifest")


class _Hashed:
    """A stream that is hashed and counted as it is read."""

    def __init__(self, source):
        self.source, self.sum, self.size = source, hashlib.sha256(), 0

    def read(self, n: int) -> bytes:
        found = self.source.read(n)
        self.sum.update(found)
        self.size += len(found)
        return found


def parse_archive(source: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, given as bytes or as a stream, member by member: one record is held at a time."""
    source = io.BytesIO(source) if isinstance(source, bytes) else source
    ahead = source.read(1 << 20)
    while ahead:
        opener, parts = zlib.decompressobj(31), []
        while ahead and not opener.eof:
            parts.append(opener.decompress(ahead))
            ahead = opener.unused_data if opener.eof else source.read(1 << 20)
        if not opener.eof:
            raise ValueError("the archive ends inside a record")
        ahead = ahead or source.read(1 << 20)
        raw = b"".join(parts)
        head, _, rest = raw.partition(CRLF + CRLF)
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        if len(rest) != int(headers["Content-Length"]) + 4:
            raise ValueError(f"length of {headers.get('WARC-Record-ID')}")
        yield headers, rest[: int(headers["Content-Length"])]


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) of the records of the manifest's files.

    Whatever the manifest lists must be there: a file that is missing, or whose bytes, digest, records, block or payload digests or
    lengths differ from what is said of them, is an error. Files that it doesn't list are left out. ``html`` is null for a revisit.
    """
    n = max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        for batch in batches:
            for name, records, size, sha256 in zip(*(c.to_pylist() for c in batch.columns)):
                out, held, seen = [], 0, 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw:
                    source = _Hashed(raw)
                    for head, block in parse_archive(source):
                        if digest(block) != head["WARC-Block-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"block digest of {head['WARC-Record-ID']}")
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(CRLF + CRLF)[2]
                        named, length = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        response = head["WARC-Type"] == "response"
                        if response and (digest(payload) != named or len(payload) != length):
                            raise ValueError(f"payload digest of {head['WARC-Record-ID']}")
                        page, ref = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                        out.append((page and int(page), head.get("WARC-Target-URI"), length, named, head["WARC-Type"], ref and int(ref), payload.decode() if response else None))
                        held, seen = held + len(payload), seen + 1
                        if held > 4 << 20:
                            yield _rows(out)
                            out, held = [], 0
                if (seen, source.size, source.sum.hexdigest()) != (records, size, sha256):
                    raise ValueError(f"{name} isn't what the manifest says")
                if out:
                    yield _rows(out)

    listed = manifest.select("file", "records", "bytes", "sha256").repartition(n, "file")
    return map_batches(listed, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
