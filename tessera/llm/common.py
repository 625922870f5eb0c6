"""Shared pieces of the training-data operators: shared storage, Arrow text access, byte-level words.

Text is handled as the UTF-8 bytes of an Arrow column, so that a whole batch is split into words and
hashed by a few numpy passes instead of a Python loop over words.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SEED = np.random.default_rng(20240229)
#: Odd multiplier and random byte values of the word hash; fixed so that every executor agrees.
_BASE = np.uint64(int(_SEED.integers(1, 2**62)) * 2 + 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)


#: Where a local session without spark.checkpoint.dir keeps its tables.
_local: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir; a temporary folder only where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tessera-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = f"file://{_local[0]}"
    return f"{base.rstrip('/')}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries begun here delete their shuffle files when they end, which else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.options(compression="zstd", **options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[id(table)] = (weakref.ref(table), path)
    for folders in _recorded:
        folders.append(path)
    return table


#: The folder of each written table, and how many rows those have that were counted.
_folders: dict[int, tuple[weakref.ref, str]] = {}
_counts: dict[int, tuple[weakref.ref, int]] = {}


def rows_of(df: DataFrame) -> int:
    """How many rows a written table has, counted once."""
    known, count = _counts.get(id(df), (lambda: None, 0))
    if known() is not df:
        with shuffles_freed(df.sparkSession):
            count = df.count()
        _counts[id(df)] = (weakref.ref(df), count)
    return count


def dropped(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing will read any more (others are left alone)."""
    for table in tables:
        known, path = _folders.pop(id(table), (lambda: None, ""))
        _counts.pop(id(table), None)
        if table is not None and known() is table:
            deleted(table.sparkSession, path)


#: Lists that get the folders of the tables written meanwhile.
_recorded: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of the tables written within."""
    folders: list[str] = []
    _recorded.append(folders)
    try:
        yield folders
    finally:
        _recorded[:] = [x for x in _recorded if x is not folders]


def deleted(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, if they are there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def cleared(spark: SparkSession) -> None:
    """Deletes all tables this application has written, once its results are stored elsewhere."""
    deleted(spark, shared_dir(spark, "any").rsplit("/", 1)[0])


def bounded(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if it has at most so many rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if rows_of(df) <= rows else df


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, by their internal names; all others (clashing names too) are left out."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


class Text(NamedTuple):
    """UTF-8 bytes of a batch's texts, one after the other; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


def text_of(column: pa.Array) -> Text:
    """Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return Text(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return Text(raw, offsets - lo)


#: Which bytes are part of a word, for the two word forms in use.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


_LOWER_BYTE = _BYTE[LOWER]


class Words(NamedTuple):
    """Words of a batch in order: byte range, hash, and for each text its first word (n + 1 entries)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


_BLOCK = 1 << 16
_up, _down = np.full(_BLOCK + 1, _BASE, np.uint64), np.full(_BLOCK + 1, _INVERSE, np.uint64)
_up[0] = _down[0] = 1
np.multiply.accumulate(_up, out=_up)
np.multiply.accumulate(_down, out=_down)


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of byte ranges, ascending and not overlapping, from prefix sums of byte values times powers; in blocks that stay in cache."""
    digests = np.empty(len(start), np.uint64)
    up, down, at = _up, _down, 0
    sums = np.zeros(_BLOCK + 1, np.uint64)
    while at < len(start):
        lo = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, lo + _BLOCK, "right")))
        n = int(end[to - 1]) - lo
        if n >= len(up):  # one long range
            up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
            sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data[lo : lo + n]] * up[:n], out=sums[1 : n + 1])
        s, e = start[at:to] - lo, end[at:to] - lo
        digests[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mixed(digests)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _single(data: np.ndarray) -> np.ndarray | None:
    """Where characters of scripts without blanks begin and end (Thai, Lao, U+3000 to U+9FFF, U+20000 to U+2FFFF), if there are any."""
    if not len(data) or int(data.max()) < 0xE0:
        return None
    after = np.append(data[1:], 0)
    three = ((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE0) & (after >= 0xB8) & (after <= 0xBB))
    four = (data == 0xF0) & (after >= 0xA0) & (after <= 0xAF)
    cut = np.zeros(len(data) + 4, bool)
    for lead, size in ((three, 3), (four, 4)):
        at = np.flatnonzero(lead)
        cut[at] = cut[at + size] = True
    return cut[: len(data)]


def words_of(text: Text, kind: np.ndarray = NOT_SPACE, single: bool = False) -> Words:
    """Maximal runs of the bytes of a kind, cut at text ends too, with a 64-bit hash of their lower-cased bytes; single: each character of scripts without blanks is one."""
    data, offsets = text
    n = len(data)
    if not n:
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    part = kind[data]
    opens = part.copy()
    opens[1:] &= ~part[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    opens[heads] = part[heads]
    shuts = part.copy()
    shuts[:-1] &= ~part[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    shuts[tails] = part[tails]
    if single and (cut := _single(data)) is not None:
        opens |= cut & part
        shuts[:-1] |= cut[1:] & part[:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    return Words(start, end, hashes_of(data, start, end, _LOWER_BYTE), np.searchsorted(start, offsets))


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int, Text]]:
    """A column's texts in runs (from, to) of about so many bytes, to bound memory."""
    text, lo = text_of(column), 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(text.offsets, text.offsets[lo] + size, "right")) - 1)
        a, b = int(text.offsets[lo]), int(text.offsets[hi])
        yield lo, hi, Text(text.data[a:b], text.offsets[lo : hi + 1] - a)
        lo = hi
