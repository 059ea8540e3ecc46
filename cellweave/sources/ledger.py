"""Runs in chunks that may be killed anywhere and gone on with, and proofs of what they go on from.

A run has a folder: ``contract.json`` says what must stay as it was, ``inputs`` holds a hash of every input file, ``chunks`` what was committed and
``writers`` who writes. A chunk is written aside, read back, and gets the fingerprints of its tables and the hash of the commit before it; one rename
commits it. So what is there after a kill is a chain of whole chunks and leavings that nobody reads. ``Ledger.verify`` checks the chain against
the files before anything is added. The folder must be seen by driver and executors; input files too.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import changed_rows
from .series import local
from .tables import _hadoop, exists

LEDGER_VERSION = 1

#: Bytes that a task hashes at once; of a larger file, several tasks hash parts.
BLOCK = 64 << 20

#: How many names an error message gives.
NAMED = 5


# ---------------------------------------------------------------- small files


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _hadoop(spark, path)
    if not fs.exists(place):
        raise FileNotFoundError(path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file, whole or not at all; FileExistsError if there is one."""
    if exists(spark, path):
        raise FileExistsError(path)
    fs, aside = _hadoop(spark, f"{path}.incomplete")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(aside, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"can't rename to {path}")


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; of none if it isn't there."""
    fs, place = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


# ---------------------------------------------------------------- hashes


def hash_files(spark: SparkSession, paths: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(path, bytes, sha256) of files: the hash of the hex hashes of their blocks in order, which tasks compute side by side."""
    sizes = [(p, os.path.getsize(local(p))) for p in sorted(set(paths))]
    parts = [(p, n, at) for p, n in sizes for at in range(0, max(n, 1), block)]
    rows = spark.createDataFrame(parts, "path string, bytes long, start long").repartition(max(1, min(len(parts), 10_000)), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, start in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                digest, left = hashlib.sha256(), block
                with open(local(path), "rb") as f:
                    f.seek(start)
                    while left and (piece := f.read(min(left, 1 << 20))):
                        digest.update(piece)
                        left -= len(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.string())], ["path", "bytes", "start", "digest"])

    hashed = rows.mapInArrow(run, "path string, bytes long, start long, digest string")
    ordered = F.array_sort(F.collect_list(F.struct("start", "digest")))  # 64 characters per block
    return hashed.groupBy("path", "bytes").agg(F.sha2(F.concat_ws("", F.transform(ordered, lambda x: x["digest"])), 256).alias("sha256"))


def table_prints(df: DataFrame, *key) -> DataFrame:
    """(key, n, x, s) of the rows in whatever order they come: number, and two sums of row hashes."""
    names = [c for c in sorted(df.columns) if c not in key]
    first, other = F.xxhash64(*names), F.pmod(F.xxhash64(F.lit(1), *reversed(names)), F.lit(1 << 31))
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.bit_xor(first).alias("x"), F.coalesce(F.sum(other), F.lit(0)).alias("s"))


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- the ledger


@dataclass(frozen=True)
class Commit:
    """A committed chunk: frames ``low`` to below ``high``, its folder, and the hash of its proof."""

    low: int
    high: int
    path: str
    proof: str


class Ledger:
    """The commit log of one run.

    ``contract`` (plain JSON values) must not change between starts, nor may the files ``inputs``. A new run needs a folder without one; with
    ``resume``, an old run is verified and its commits are in ``commits``; where there is none yet, it begins. A start takes the folder over: a writer that
    started before can't commit any more.
    """

    def __init__(self, spark: SparkSession, folder: str, contract: dict, inputs: Sequence[str], resume: bool = False):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits: list[Commit] = []
        text = json.dumps({"ledger_version": LEDGER_VERSION, **contract}, sort_keys=True)
        if exists(spark, f"{self.folder}/contract.json"):
            if not resume:
                raise FileExistsError(self.folder)
            self._same_contract(json.loads(text))
            self._same_inputs(inputs)
        elif names_in(spark, f"{self.folder}/chunks"):
            raise ValueError("the run has chunks but no contract")
        self.writer = self._take()
        if exists(spark, f"{self.folder}/contract.json"):
            self.verify()
        else:  # the contract comes last: without it, nothing has begun
            hash_files(spark, inputs).write.mode("overwrite").parquet(f"{self.folder}/inputs")
            write_text(spark, f"{self.folder}/contract.json", text)

    # ------------------------------------------------ who writes

    def _take(self) -> int:
        taken = [int(n) for n in names_in(self.spark, f"{self.folder}/writers") if n.isdigit()]
        number = max(taken, default=0) + 1
        write_text(self.spark, f"{self.folder}/writers/{number:08d}", str(number))
        self.drop_leavings()
        return number

    def _still_mine(self) -> None:
        if max(int(n) for n in names_in(self.spark, f"{self.folder}/writers") if n.isdigit()) != self.writer:
            raise RuntimeError("another writer has taken this run over")

    def drop_leavings(self) -> None:
        """Delete what earlier writers wrote aside and didn't commit."""
        fs, place = _hadoop(self.spark, f"{self.folder}/staging")
        fs.delete(place, True)

    # ------------------------------------------------ what must not change

    def _same_contract(self, now: dict) -> None:
        old = json.loads(read_text(self.spark, f"{self.folder}/contract.json"))
        changed = sorted(k for k in {*old, *now} if old.get(k, self) != now.get(k, self))
        if changed:
            raise ValueError("the contract of the run differs in " + ", ".join(f"{k} ({old.get(k)!r}, now {now.get(k)!r})" for k in changed))

    def _same_inputs(self, inputs: Sequence[str]) -> None:
        gone = [p for p in inputs if not os.path.exists(local(p))]
        if gone:
            raise ValueError(f"input files are gone: {', '.join(gone[:NAMED])}")
        old = self.spark.read.parquet(f"{self.folder}/inputs")
        found = changed_rows(old, hash_files(self.spark, inputs), ["path"]).select("path").distinct().orderBy("path").limit(NAMED).collect()
        if found:
            raise ValueError(f"input files have changed: {', '.join(r.path for r in found)}")

    # ------------------------------------------------ chunks

    @property
    def end(self) -> int | None:
        """The frame after the last committed one."""
        return self.commits[-1].high if self.commits else None

    @property
    def head(self) -> str:
        """The hash of the last proof, which hangs together with all before it."""
        return self.commits[-1].proof if self.commits else ""

    def commit(self, low: int, high: int, tables: dict[str, DataFrame]) -> Commit:
        """Write the tables of frames ``low`` to below ``high`` aside, read them back, prove and commit them."""
        if high <= low or self.end not in (None, low):
            raise ValueError("chunks must follow each other")
        name = f"{low:08d}-{high:08d}"
        aside, place = f"{self.folder}/staging/{self.writer:08d}/{name}", f"{self.folder}/chunks/{name}"
        prints = {}
        for table, df in sorted(tables.items()):
            df.write.mode("overwrite").parquet(f"{aside}/{table}")
            prints[table] = list(table_prints(self.spark.read.parquet(f"{aside}/{table}")).first())
        text = json.dumps({"low": low, "high": high, "writer": self.writer, "previous": self.head, "tables": prints}, sort_keys=True)
        write_text(self.spark, f"{aside}/COMMITTED.json", text)
        self._still_mine()
        if exists(self.spark, place):
            raise FileExistsError(place)
        fs, source = _hadoop(self.spark, aside)
        parent = _hadoop(self.spark, f"{self.folder}/chunks")[1]
        fs.mkdirs(parent)
        if not fs.rename(source, _hadoop(self.spark, place)[1]) or read_text(self.spark, f"{place}/COMMITTED.json") != text:
            raise OSError(f"can't commit {place}")
        self.commits.append(Commit(low, high, place, text_hash(text)))
        return self.commits[-1]

    def verify(self) -> None:
        """Read the chain of commits; ValueError where one is missing, or its tables aren't what was committed.

        A table of all chunks is read in one job; what it gives is a row per chunk.
        """
        found, proofs = [], {}
        for name in names_in(self.spark, f"{self.folder}/chunks"):
            path = f"{self.folder}/chunks/{name}"
            text = read_text(self.spark, f"{path}/COMMITTED.json")
            told = json.loads(text)
            if told["previous"] != (found[-1].proof if found else "") or (found and told["low"] != found[-1].high) or name != f"{told['low']:08d}-{told['high']:08d}":
                raise ValueError(f"chunk {name} doesn't follow the one before it")
            found.append(Commit(told["low"], told["high"], path, text_hash(text)))
            proofs[name] = told["tables"]
        for table in sorted({t for told in proofs.values() for t in told}):
            names = [n for n, told in proofs.items() if table in told]
            lost = [n for n in names if not exists(self.spark, f"{self.folder}/chunks/{n}/{table}")]
            if lost:
                raise ValueError(f"{table} of chunk {lost[0]} is gone")
            rows = self.spark.read.parquet(*(f"{self.folder}/chunks/{n}/{table}" for n in names))
            chunk = F.regexp_extract(F.col("_metadata.file_path"), r"/chunks/(\d+-\d+)/", 1)
            got = {r.chunk: [r.n, r.x, r.s] for r in table_prints(rows.select(*rows.columns, chunk.alias("chunk")), "chunk").collect()}
            for n in names:
                if got.get(n, [0, None, 0]) != proofs[n][table]:
                    raise ValueError(f"{table} of chunk {n} isn't what was committed")
        self.commits = found

    def read(self, table: str) -> DataFrame:
        """A table of all committed chunks."""
        return self.spark.read.parquet(*(f"{c.path}/{table}" for c in self.commits))

    def last(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.commits[-1].path}/{table}")

    # ------------------------------------------------ the end

    @property
    def finished(self) -> bool:
        return exists(self.spark, f"{self.folder}/SUCCESS.json")

    def finish(self, told: dict) -> None:
        """The marker that all is there; it names the last proof. Written once."""
        self._still_mine()
        text = json.dumps({"head": self.head, **told}, sort_keys=True)
        if not self.finished:
            write_text(self.spark, f"{self.folder}/SUCCESS.json", text)
        elif read_text(self.spark, f"{self.folder}/SUCCESS.json") != text:
            raise ValueError("the run was finished with something else")
