"""Token-ID files: whole texts as ids, compressed per shard by a Re-Pair grammar that keeps random access.

Re-Pair replaces frequent adjacent pairs by new symbols (nonterminals). Here a round counts all pairs of a
shard, takes the most frequent ones such that no symbol is the left of one and the right of
another (then no two occurrences overlap; in runs of one id every second place counts) and replaces all of them at once. Rounds go
on while a pair is frequent and symbols are left. Pairs never cross a document's
end. A file holds the rules, each rule's expansion length, and per document its symbols and ids, so that
any document, or any range of its ids, is decoded by the rules it uses, without the rest.

Rows: null text counts as empty (the end id alone); a null doc_id comes first; equal doc_ids are ordered by text;
an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .common import documents, saved, shared_dir, slices
from .tokens import SLICE_BYTES, encoder, release, vocabulary_path

MAGIC = b"TRP1"
_HEAD = struct.Struct("<4sIIIII")
#: Symbols are 16 bits wide: ids below `base`, nonterminals from there.
WIDTH = 1 << 16
END_ID = 2


def _seconds(equal: np.ndarray) -> np.ndarray:
    """Every second place of each run of set flags: of overlapping pairs of one id, those that begin within the pair before."""
    at = np.flatnonzero(equal)
    if not len(at):
        return at
    begins = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    return at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 1]


def compressed(ids: np.ndarray, ends: np.ndarray, base: int, least: int = 12, most: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (n x 2) and the documents' ends among the symbols. ends: the place after each document's last id.

    Goes on until no pair occurs `least` times or the symbols run out; a round takes the `most` most frequent ones at a time, which bounds its table.
    """
    seq = ids.astype(np.uint16)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    symbol = base
    while len(seq) > 1 and symbol < WIDTH:
        free = ~last[:-1]
        free[_seconds((seq[:-1] == seq[1:]) & free)] = False
        codes = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
        ordered = np.sort(codes[free])
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)
        counts = np.diff(np.append(heads, len(ordered)))
        many = np.flatnonzero(counts >= least)
        many = many[np.argsort(-counts[many], kind="stable")]
        left, right, took, lefts, rights = np.zeros(WIDTH, np.uint16), np.zeros(WIDTH, np.uint16), [], 0, 0
        for code in ordered[heads[many]].tolist():
            a, b = code >> 16, code & 0xFFFF
            if right[a] or left[b] or (a == b and (left[a] or right[b])):
                continue
            if not left[a]:
                lefts += 1
                left[a] = lefts
            if not right[b]:
                rights += 1
                right[b] = rights
            took.append((a, b))
            if len(took) == min(most, WIDTH - symbol):
                break
        if not took:
            break
        pairs = np.array(took, np.uint16)
        row, column, wide = left.astype(np.int64) * (rights + 1), right.astype(np.int64), seq.astype(np.intp)
        table = np.zeros((lefts + 1) * (rights + 1), np.uint16)
        table[row[pairs[:, 0]] + column[pairs[:, 1]]] = np.arange(symbol, symbol + len(pairs), dtype=np.uint16)
        made = table.take(row.take(wide[:-1]) + column.take(wide[1:]))
        made[~free] = 0
        at = np.flatnonzero(made)
        seq[at] = made[at]
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(pairs)
        symbol += len(pairs)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16), np.flatnonzero(last) + 1


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each nonterminal stands for; a rule only refers to earlier ones."""
    n = np.ones(base + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        n[base + k] = n[a] + n[b]
    return n


class Shard:
    """A token file in memory."""

    def __init__(self, data: bytes):
        magic, self.base, docs, n_rules, symbols, crc = _HEAD.unpack_from(data)
        if magic != MAGIC or zlib.crc32(memoryview(data)[_HEAD.size :]) != crc:
            raise ValueError("not a whole token file")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.known = take("<i8", docs), take("u1", docs).astype(bool)
        self.symbol_ends, self.id_ends = take("<u4", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        self.rules, self.rule_lengths = take("<u2", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.symbols = take("<u2", symbols)
        self._sizes = np.concatenate([np.ones(self.base, np.int64), self.rule_lengths.astype(np.int64)])
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def packed(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
        """ends: where each document's ids end; every document has an id at least."""
        symbols, rules, symbol_ends = compressed(ids, ends, base)
        known = np.array([d is not None for d in doc_ids], np.uint8)
        body = b"".join(
            x.tobytes()
            for x in (
                np.array([d or 0 for d in doc_ids], "<i8"), known, symbol_ends.astype("<u4"), ends.astype("<u4"),
                rules.astype("<u2"), lengths_of(rules, base)[base:].astype("<u4"), symbols.astype("<u2"),
            )
        )
        return _HEAD.pack(MAGIC, base, len(doc_ids), len(rules), len(symbols), zlib.crc32(body)) + body

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' ids in one array, and where each symbol's begin. A rule's pair occurred `least` times without overlap when it was made, so a
        round's expansions together are no longer than that part of the shard."""
        if self._flat is None:
            begin = np.concatenate([[0], np.cumsum(self._sizes)])
            flat = np.empty(int(begin[-1]), np.uint32)
            flat[: self.base] = np.arange(self.base)
            for k, (a, b) in enumerate(self.rules.tolist()):
                lo, mid, hi = begin[self.base + k], begin[self.base + k] + self._sizes[a], begin[self.base + k + 1]
                flat[lo:mid], flat[mid:hi] = flat[begin[a] : begin[a + 1]], flat[begin[b] : begin[b + 1]]
            self._flat = flat, begin
        return self._flat

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin = self._expansions()
        n = self._sizes[symbols]
        if len(n) and int(n.sum()) < 2**31 > len(flat):
            n, begin = n.astype(np.int32), begin.astype(np.int32)
        ends = np.cumsum(n, dtype=n.dtype)
        return flat[np.repeat(begin[symbols] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=n.dtype)]

    def ids(self) -> np.ndarray:
        """All documents' ids in order."""
        return self._expand(self.symbols)

    def document(self, i: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo to hi of document i, expanding only the symbols that cover them."""
        own = self.symbols[self.symbol_ends[i - 1] if i else 0 : self.symbol_ends[i]]
        ends = np.cumsum(self._sizes[own])
        hi = int(ends[-1]) if hi is None else min(hi, int(ends[-1]))
        if lo >= hi:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self._range(own[a:b], lo - skipped, hi - skipped)

    def _range(self, symbols: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the symbols, by following only the rules that reach into the range; each turn opens all its nonterminals once."""
        while True:
            ends = np.cumsum(self._sizes[symbols])
            a, b = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left")) + 1
            skipped = int(ends[a - 1]) if a else 0
            symbols, lo, hi = symbols[a:b], lo - skipped, hi - skipped
            opened = symbols >= self.base
            if not opened.any():
                return symbols[lo:hi].astype(np.uint32)
            wide = 1 + opened.astype(np.int64)
            at = (np.cumsum(wide) - wide)[opened]
            pairs = self.rules[symbols[opened].astype(np.int64) - self.base]
            symbols = np.repeat(symbols, wide)
            symbols[at], symbols[at + 1] = pairs[:, 0], pairs[:, 1]


def write(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = 1_500_000) -> DataFrame:
    """Writes the files and returns their manifest (part, seq, file, n_docs, n_ids), in ascending order of doc_id by part and seq.

    A shard closes once it has shard_ids ids, so one task's memory doesn't depend on the size of its partition.
    """
    vocabulary = vocabulary or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        base = enc.tokenizer.get_vocab_size(True)
        if base > WIDTH - 4096:
            raise ValueError(f"a vocabulary of {base} ids leaves no room for nonterminals in {WIDTH}")
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq
            whole, ends = np.concatenate(ids), np.cumsum(np.concatenate(sizes))
            file = files.put(f"{path}/{part:06d}-{seq:05d}.trp", Shard.packed(names, whole, ends, base))
            out = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [file], "n_docs": [len(names)], "n_ids": [len(whole)]}, _MANIFEST)
            seq += 1
            names.clear(), ids.clear(), sizes.clear()
            return out

        held = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, text in slices(batch.column(1), SLICE_BYTES):
                some, off = enc.encode(text, end_id)
                ids.append(some)
                sizes.append(np.diff(off))
                names += doc_ids[lo:hi]
                held += len(ids[-1])
                if held >= shard_ids:
                    yield close()
                    held = 0
        if names:
            yield close()

    ordered = documents(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return saved(ordered.mapInArrow(encode, "part int, seq int, file string, n_docs long, n_ids long"), "manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids before it), n_tokens, ids_crc32, and the file with its place there."""
    by_part = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    placed = manifest.withColumn("within", within).join(before, "part").select("file", (F.col("before") + F.col("within")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # a worker that has encoded texts before
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(files.get(file))
                ids = shard.ids()
                ends = shard.id_ends
                begins = np.concatenate([[0], ends[:-1]])
                if len(ids) != ends[-1]:
                    raise ValueError(f"{file}: {len(ids)} ids, not {ends[-1]}")
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=~shard.known), pa.array(start + begins), pa.array(ends - begins), pa.array(crc, pa.int64()), pa.array([file] * len(ends)), pa.array(np.arange(len(ends)))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "file", "place"],
                )

    count = manifest.count()
    dealt = placed.repartition(max(1, min(-(-count // 6), 20_000)))  # rows are file names; a task reads its files one by one
    return dealt.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, place long")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, shared_dir(spark, "tokens"), **options))
