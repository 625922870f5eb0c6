"""Benchmark decontamination with an FM-index per shard of training text.

A shard (the documents of a few megabytes) becomes a sequence of benchmark word numbers. Words that no benchmark item has, and runs
of known words too short for any phrase, can't be part of an occurrence: each such stretch becomes one separator. Over what is left an
FM-index is built: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, suffix positions kept for every
16th place and each place after a separator. Test phrases (the windows of all items) are found by backward search, all at
once; occurrences are located by walking to the next kept position, and their spans are merged.

Items are written in blocks of bounded size to the shared folder and read block by block in each task, so neither the driver
nor a broadcast ever holds the whole test set.

Rows: a null text has no words; a null item text has no windows; equal or null doc_ids are rows of their own; an empty
benchmark leaves every document clean; an empty table gives no rows; other columns are passed on untouched by `cleaned` and left out by `found`.
Words are compared by length and a 64-bit hash of their lower-cased bytes.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import ALNUM, Text, saved, shared_dir, slices, text_of, words_of
from .memory import trimming

WINDOW = 10
SHARD_BYTES = 8_000_000
BLOCK_CHARS = 16_000_000
SAMPLE = 16


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes; separators (0) count as different symbols, smaller than all words, in order of place."""
    n = len(seq)
    zeros = np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    k = 1
    while True:
        key = rank * (n + len(zeros) + int(seq.max(initial=0)) + 2)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class Wavelet:
    """Wavelet matrix: rank and access for arrays of places at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        low = np.zeros(len(symbols), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbols >> (len(self.ones) - 1 - level)) & 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - low

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before it."""
        low, symbols = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            symbols = symbols * 2 + bit
            low = np.where(bit, zeros + ones[low], low - ones[low])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return symbols, at - low


class FMIndex:
    """Over a sequence of word numbers from 1 with separators 0, the last of them at the end."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(seq)
        self.size = len(seq)
        before = np.bincount(seq, minlength=2)
        self.first = np.concatenate([[0], np.cumsum(before)])
        self.wavelet = Wavelet(seq[order - 1].astype(np.int64), max(1, int(seq.max(initial=1)).bit_length()))
        kept = (order % sample == 0) | (seq[order - 1] == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of rows that hold their words at the right end; the range of suffixes that begin with each."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.size, np.int64)
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            word = patterns[live, width - 1 - k]
            known = word < len(self.first) - 1
            hi[live[~known]] = 0
            live, word = live[known], word[known]
            lo[live] = self.first[word] + self.wavelet.rank(word, lo[live])
            hi[live] = self.first[word] + self.wavelet.rank(word, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes at these ranks."""
        at, out = at.copy(), np.zeros(len(at), np.int64)
        live, steps = np.arange(len(at)), 0
        while len(live):
            there = self.kept[at[live] + 1] > self.kept[at[live]]
            done = live[there]
            out[done] = self.places[self.kept[at[done]]] + steps
            live = live[~there]
            symbols, rank = self.wavelet.step(at[live])
            at[live] = self.first[symbols] + rank
            steps += 1
        return out


class Phrases:
    """A block of items: their vocabulary, distinct windows, and the items of each window."""

    def __init__(self, names: list[str], text: Text, window: int):
        words = words_of(text, ALNUM)
        size = (words.end - words.start).astype(np.int64)
        self.names = names
        self.hashes, where, number = np.unique(words.hash, return_index=True, return_inverse=True)
        self.sizes = size[where]
        rows, owners, lengths = [], [], []
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            n = min(window, b - a)
            for at in range(a, b - n + 1 if n else a):
                rows.append(np.concatenate([np.zeros(window - n, np.int64), number[at : at + n] + 1]))
                owners.append(i), lengths.append(n)
        table = np.array(rows, np.int64).reshape(-1, window)
        self.windows, which = np.unique(table, axis=0, return_inverse=True)
        self.lengths = (self.windows > 0).sum(axis=1)
        order = np.lexsort((owners, which.ravel())) if rows else np.zeros(0, int)
        self.owners, self.reach = np.array(owners, np.int64)[order], np.searchsorted(which.ravel()[order], np.arange(len(self.windows) + 1))

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, names=np.array(self.names, dtype=str), **{k: v for k, v in self.__dict__.items() if k != "names"})
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Phrases:
        self = cls.__new__(cls)
        self.__dict__.update(np.load(io.BytesIO(data)))
        self.names = self.names.tolist()
        return self


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> list[str]:
    """Files with the items' phrases, in blocks of about so many characters; the list grows by one name per block."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("item_id"), benchmark[text_col].cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    path = shared_dir(benchmark.sparkSession, "phrases")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names = [x or "" for x in batch.column(0).to_pylist()]
                file = files.put(f"{path}/block.npz", Phrases(names, text_of(batch.column(1)), window).saved())
                yield pa.RecordBatch.from_pydict({"file": [file]})

    blocks = saved(items.repartition(1 + total // block_chars).mapInArrow(write, "file string"), "blocks")
    return sorted(r["file"] for r in blocks.collect())


class Found:
    """What a shard's documents have: word ranges, which words are hit, and (document, item) pairs."""

    def __init__(self, text: Text, blocks: Iterator[Phrases]):
        self.words = words_of(text, ALNUM)
        n = len(self.words.start)
        self.hit, self.pairs = np.zeros(n, bool), []
        size = self.words.end - self.words.start
        doc_start = np.zeros(n + 1, bool)
        doc_start[self.words.first] = True
        for phrases in blocks:
            if not len(phrases.windows) or not n:
                continue
            at = np.minimum(np.searchsorted(phrases.hashes, self.words.hash), len(phrases.hashes) - 1)
            number = np.where((phrases.hashes[at] == self.words.hash) & (phrases.sizes[at] == size), at + 1, 0)
            opens = (number > 0) & (doc_start[:-1] | np.concatenate([[True], number[:-1] == 0]))
            starts = np.flatnonzero(opens)
            shuts = (number > 0) & (doc_start[1:] | np.concatenate([number[1:] == 0, [True]]))
            ends = np.flatnonzero(shuts) + 1
            long = ends - starts >= phrases.lengths.min()
            starts, ends = starts[long], ends[long]
            if not len(starts):
                continue
            spread = ends - starts + 1  # a run and its separator
            to = np.cumsum(spread)
            source = np.repeat(starts - to + spread, spread) + np.arange(int(to[-1]))
            source[to - 1] = n
            index = FMIndex(np.append(number, 0)[source])
            lo, hi = index.search(phrases.windows, phrases.lengths)
            count = hi - lo
            ends_at = np.cumsum(count)
            window = np.repeat(np.arange(len(count)), count)
            rows = np.repeat(lo - ends_at + count, count) + np.arange(int(ends_at[-1]))
            places = source[index.locate(rows)]
            marks = np.zeros(n + 1, np.int64)
            np.add.at(marks, places, 1)
            np.add.at(marks, places + phrases.lengths[window], -1)
            self.hit |= np.cumsum(marks)[:-1] > 0
            doc = np.searchsorted(self.words.first, places, "right") - 1
            doc, window = np.unique(np.stack([doc, window], axis=1), axis=0).T if len(doc) else (doc, window)
            own = phrases.reach[window + 1] - phrases.reach[window]
            flat = np.cumsum(own)
            owner = phrases.owners[np.repeat(phrases.reach[window] - flat + own, own) + np.arange(int(flat[-1]) if len(flat) else 0)]
            self.pairs += {(d, phrases.names[i]) for d, i in zip(np.repeat(doc, own).tolist(), owner.tolist())}

    def spans(self, doc: int) -> list[tuple[int, int]]:
        """Byte ranges of the shard, from the first to the last word of each run of hit words."""
        a, b = int(self.words.first[doc]), int(self.words.first[doc + 1])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], self.hit[a:b].astype(np.int8), [0]])))
        return [(int(self.words.start[a + x]), int(self.words.end[a + y - 1])) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist())]


def _reader(blocks: list[str]):
    """Blocks one by one; a single one stays in memory."""
    only = [Phrases.loaded(files.get(blocks[0]))] if len(blocks) == 1 else None
    return lambda: iter(only) if only else (Phrases.loaded(files.get(b)) for b in blocks)


_FOUND = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def found(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document its words, hit words, items with occurring windows (sorted as strings) and merged spans (characters, end exclusive)."""
    blocks = phrase_blocks(benchmark, item_col, item_text_col, window, block_chars)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(blocks)
        for batch in batches:
            for lo, hi, text in slices(batch.column(1), shard_bytes):
                got = Found(text, read())
                first = got.words.first
                sums = np.concatenate([[0], np.cumsum(got.hit)])
                n_hit = sums[first[1:]] - sums[first[:-1]]
                items: list[list[str]] = [[] for _ in range(hi - lo)]
                for d, item in sorted(set(got.pairs)):
                    items[d].append(item)
                spans: list[list[dict[str, int]]] = [[] for _ in range(hi - lo)]
                for d in np.flatnonzero(n_hit).tolist():
                    at, raw = 0, text.data[text.offsets[d] : text.offsets[d + 1]].tobytes()
                    done = 0
                    for a, b in got.spans(d):
                        a, b = a - int(text.offsets[d]), b - int(text.offsets[d])
                        at += len(raw[done:a].decode())
                        n = len(raw[a:b].decode())
                        spans[d].append({"start": at, "end": at + n})
                        at, done = at + n, b
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(trimming(scan), _FOUND)


def cleaned(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The same rows with the merged spans cut out of the texts, again until no phrase is left (a cut can join what stood around it)."""
    blocks = phrase_blocks(benchmark, item_col, item_text_col, window)
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(blocks)
        for batch in batches:
            changed: dict[int, str] = {}
            for lo, hi, text in slices(batch.column(at), shard_bytes):
                rows = np.arange(lo, hi)
                while len(rows):
                    got, again, parts = Found(text, read()), [], []
                    sums = np.concatenate([[0], np.cumsum(got.hit)])
                    for d in np.flatnonzero(sums[got.words.first[1:]] > sums[got.words.first[:-1]]).tolist():
                        rest, done = [], int(text.offsets[d])
                        for a, b in got.spans(d):
                            rest.append(text.data[done:a].tobytes())
                            done = b
                        rest.append(text.data[done : text.offsets[d + 1]].tobytes())
                        parts.append(b"".join(rest)), again.append(int(rows[d]))
                        changed[again[-1]] = parts[-1].decode()
                    rows = np.array(again, np.int64)
                    text = Text(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
            if changed:
                values = batch.column(at).to_pylist()
                for i, new in changed.items():
                    values[i] = new
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(trimming(cut), docs.schema)
