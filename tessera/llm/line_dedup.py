"""Fuzzy line dedup: of each connected group of near-equal lines in the whole corpus, one occurrence stays.

Lines are normalised (ASCII lower case, words of letters, digits and non-ASCII characters, single blanks; each Chinese, Japanese, Thai or Lao character
is a word). Equal normalised lines are one point with a 64-bit SimHash of its words. Near are two lines, the longer one of ten words or more, whose word sequences' edit
distance is at most a tenth of its words (words are told apart by 20 bits of a hash), and two lines of four to nine words that differ by one character.

Candidates share a block (pigeonhole principle): among more blocks than edits one is left whole. Blocks are cut from the word sequence, as lines one word apart may
differ in a third of their SimHash bits. Lines of up to 39 words have blocks at places counted from their start and their end, so that no pair within
the limit is missed; lines from 36 words on have the `SKETCH` least hashes of their runs of four words, of which pairs at the limit share one with a
probability of 0.99, whatever the places of the edits. Numbers of words, the parities of words that fall to one of 48 bits (an edit changes two at most) and SimHash bits
(more than `bits` apart) then spare edit distances.

All members of a block's group are first compared with one of them, by the JVM's banded edit distance with growing bands; groups that this makes one class are done, however large. The
rest's lines go to the groups, in blocks of rows, where pairs of different classes are verified as long as their classes are two (edits.py); what comes out is a row per joined classes, not per pair.
The kept occurrence is the first by doc_id, row and line.

Rows: a null text stays null and has no lines; lines without a word are left alone; null doc_ids come last when the kept occurrence is chosen; equal doc_ids are rows of
their own; a document that loses all its lines keeps an empty text; an empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Text, Words, bounded, dropped, mixed, rows_of, saved, shuffles_freed, slices, words_of
from .graph import components, links_within, with_classes
from .memory import trimming

LEAST_WORDS, BITS, PERCENT = 1, 28, 90
#: Lines of so many words at least may have near ones; the hashes of a long line's runs.
NEAR_WORDS, SKETCH, RUN = 4, 8, 4
#: Up to so many named points, only the documents that hold them are read again; up to so many, tasks know each one's first document (16 MB), beyond that a bitmap of
#: 2 ** BITMAP bits stands for them (32 MB), which lets a few others through.
MOST_NAMED, MOST_NODES, BITMAP = 500_000, 2_000_000, 28
SLICE_BYTES, SMALL, BLOCK = 8_000_000, 32, 2048
_STEP = np.uint64(0xD1342543DE82EF95)
#: Blocks of a line of (from, to) words: (size, places from the start and from the end).
BLOCKS = [
    (9, 15, 5, [0]), (15, 19, 7, [0]),  # one edit: the first or the last half
    (18, 27, 5, [0]), (18, 27, 4, [5, 6]), (26, 39, 7, [0]), (26, 39, 6, [7, 8]),  # up to three: a half has one, so one of its quarters none, moved by one place at most
]
SKETCHED = 36
#: Below so many words lines are compared by characters; bits that one character's edit changes.
SHORT, CHANGED = 10, 4


def lines_of(text: Text, least: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, and of each line with enough of them: its text, its number there, and its first and last word (exclusive)."""
    words = words_of(text, ALNUM, single=True)
    data, offsets = text
    breaks = np.flatnonzero(data == 0x0A)
    # a line begins with each text and after each line break, the one after a final line break being empty
    place = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets[1:], breaks, "right")])
    order = np.lexsort((doc, place))
    place, doc = place[order], doc[order]
    number = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
    ends = np.minimum(np.append(place[1:], len(data)), offsets[1:][doc])
    first, last = np.searchsorted(words.start, place), np.searchsorted(words.start, ends)
    enough = np.flatnonzero(last - first >= least)
    return words, doc[enough], number[enough], first[enough], last[enough]


def _sequence(words: Words, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all the lines' words, one line after the other, and where each line's begin."""
    n = last - first
    ends = np.cumsum(n)
    return words.hash[np.repeat(first - ends + n, n) + np.arange(int(ends[-1]) if len(n) else 0)], ends - n


def nodes_of(own: np.ndarray, heads: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each line's word sequence."""
    if not len(n):
        return np.zeros(0, np.uint64)
    place = (np.arange(len(own)) - np.repeat(heads, n)).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(own + place * _STEP), heads) + n.astype(np.uint64))


def simhashes_of(own: np.ndarray, heads: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of each line: the bits that more than half of its words' hashes have. Counts are kept in bytes, eight to a number, for runs of up to 255 words."""
    if not len(n):
        return np.zeros(0, np.uint64)
    runs = -(-n // 255)
    of = np.cumsum(runs) - runs
    cut = np.repeat(heads, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(of, runs))
    out, lanes = np.zeros(len(n), np.uint64), np.uint64(0x0101010101010101)
    for k in range(8):
        counts = np.add.reduceat((own >> np.uint64(k)) & lanes, cut).view(np.uint8).reshape(-1, 8).astype(np.int64)
        many = 2 * np.add.reduceat(counts, of, axis=0) > n[:, None]
        out |= (many * (np.uint64(1) << np.arange(k, 64, 8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    return out


def shapes_of(own: np.ndarray, heads: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each line 48 bits (whether the words that fall to a bit are odd in number), of which an edit changes two at most, above its number of words (up to 65,535)."""
    if not len(n):
        return np.zeros(0, np.int64)
    bits = np.bitwise_xor.reduceat(np.uint64(1) << (np.uint64(16) + (own >> np.uint64(8)) % np.uint64(48)), heads)
    return (bits | np.minimum(n, 65_535).astype(np.uint64)).view(np.int64)


def can_be_near(x: np.ndarray, y: np.ndarray | int, percent: int) -> np.ndarray:
    """Whether two shapes allow the edit limit."""
    n, m = x & 0xFFFF, y & 0xFFFF
    limit = np.maximum(n, m) * (100 - percent) // 100
    odd = np.bitwise_count(((x ^ y) >> 16).view(np.uint64) & np.uint64((1 << 48) - 1)).astype(np.int64)
    return (np.abs(n - m) <= limit) & (odd + np.abs(n - m) <= 2 * limit)


def codes_of(own: np.ndarray) -> str:
    """A character of the supplementary planes for each word (20 bits of its hash), so that edits of words are edits of characters."""
    return (np.uint64(0x10000) + (own >> np.uint64(44))).astype("<u4").tobytes().decode("utf-32-le")


def _hashes(own: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words that begin at the given places."""
    return mixed(sum(own[first + k] * (_STEP + np.uint64(2 * k)) for k in range(size)) + np.uint64(size))


def _least(own: np.ndarray, heads: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the SKETCH least distinct hashes of its runs (its number, hash)."""
    runs, whole = n - RUN + 1, max(0, len(own) - RUN + 1)
    ends = np.cumsum(runs)
    rolled = mixed(sum(own[k : whole + k] * (_STEP + np.uint64(2 * k)) for k in range(RUN)) + np.uint64(RUN))
    h = rolled[np.repeat(heads - ends + runs, runs) + np.arange(int(ends[-1]) if len(ends) else 0)]
    # of long lines all but about 6 * SKETCH are too large, unless many runs are alike
    low = h <= np.repeat((np.float64(2**64 - 2**12) * np.minimum(1, 6 * SKETCH / runs)).astype(np.uint64), runs)
    line = np.repeat(np.arange(len(n)), runs)
    few = np.bincount(line[low], minlength=len(n)) < 4 * SKETCH
    if few.any():
        low |= few[line]
    line, h = line[low], h[low]
    size = np.bincount(line, minlength=len(n))
    if not len(h) or len(n) * int(size.max()) > 4 * len(h):  # lines of very different numbers of runs
        order = np.lexsort((h, line))
        line, h = line[order], h[order]
    else:
        place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        table = np.full((len(n), int(size.max())), np.uint64(2**64 - 1))
        table[line, place] = h
        table.sort(axis=1)
        h = table[line, place]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    line, h = line[new], h[new]
    size = np.bincount(line, minlength=len(n))
    some = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size) < SKETCH
    return line[some], h[some]


def keys_of(own: np.ndarray, heads: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Even keys (line's number, key) of blocks of words; lines within the edit limit share one."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for low, high, size, places in BLOCKS:
        some = np.flatnonzero((n >= low) & (n <= high))
        for place in places:
            for side, first in ((0, heads[some] + place), (1, heads[some] + n[some] - place - size)):
                out.append((some, _hashes(own, first, size) * np.uint64(4) + np.uint64(2 * side)))
    long = np.flatnonzero(n >= SKETCHED)
    line, h = _least(own, heads[long], n[long])
    out.append((long[line], h & ~np.uint64(1)))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def plain_lines(text: Text, words: Words, first: np.ndarray, last: np.ndarray) -> list[str]:
    """The normalised lines."""
    raw = LOWER[text.data].tobytes()
    start, end = words.start.tolist(), words.end.tolist()
    return [b" ".join([raw[start[k] : end[k]] for k in range(a, b)]).decode(errors="replace") for a, b in zip(first.tolist(), last.tolist())]


def halves_of(line: str) -> list[int]:
    """Odd keys of a line's first and last half, of which lines that differ by one character share one; of two sizes if the number of characters is odd."""
    half, out = len(line) // 2, []
    for size in range(half, half + 1 + len(line) % 2):
        for salt, part in ((b"a", line[:size]), (b"b", line[-size:])):
            out.append(int.from_bytes(blake2b(part.encode(), digest_size=8, salt=salt).digest(), "little", signed=True) | 1)
    return out


def bigrams_of(line: str) -> int:
    """64 bits of which one character's edit changes CHANGED at most: whether the pairs of neighbouring characters that fall to a bit are odd in number."""
    bits, codes = 0, list(map(ord, line))
    for a, b in zip(codes, codes[1:]):
        bits ^= 1 << ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 13 & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def near_texts(x: Column, y: Column, percent: int) -> Column:
    """Whether the edit distance is within the limit, tried with growing bands."""
    limit = F.floor(F.greatest(F.length(x), F.length(y)) * (100 - percent) / 100).cast("int")
    near = F.when(F.abs(F.length(x) - F.length(y)) > limit, False)
    for band in (4, 16, 64, 256):
        near = near.when((limit > band) & (F.call_function("levenshtein", x, y, F.lit(band)) >= 0), True)
    return near.otherwise(F.call_function("levenshtein", x, y, limit) >= 0)


def places_of(row: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A hash of each line's document and point."""
    return mixed(mixed(row.astype(np.uint64) + _STEP) ^ node.view(np.uint64))


def _probes(place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each place in a bitmap."""
    return place >> np.uint64(64 - bits), place & np.uint64((1 << bits) - 1)


def bitmap(first: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits bits in which those of all (node, row) are set; the driver gets a row per 64 bits at most."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.concatenate(_probes(places_of(batch.column(1).to_numpy(), batch.column(0).to_numpy()), bits))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], ["slot", "bits"])

    with shuffles_freed(first.sparkSession):
        table = first.select("node", "row").mapInArrow(mark, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table["slot"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def marked(table: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    """Whether both bits of each place are set."""
    out = np.ones(len(place), bool)
    for bit in _probes(place, bits):
        out &= (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


class Lines:
    """docs: row (unique), doc_id, text."""

    def __init__(self, docs: DataFrame, least: int = LEAST_WORDS, bits: int = BITS, percent: int = PERCENT, small: int = SMALL, block: int = BLOCK):
        if percent < 90:
            raise ValueError("blocks are cut for 90 percent or more")
        self.docs, self.least, self.bits, self.percent, self.small, self.block = docs, least, bits, percent, small, block
        self.classes: DataFrame | None = None
        self.near: DataFrame | None = None

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, text in slices(batch.column(2), SLICE_BYTES):
                    words, doc, number, first, last = lines_of(text, least)
                    own, heads = _sequence(words, first, last)
                    node = nodes_of(own, heads, last - first)
                    at = pa.array(doc + lo)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number.astype(np.int32)), pa.array(node.view(np.int64))], ["row", "doc_id", "line", "node"])

        self.lines = saved(docs.mapInArrow(trimming(emit), "row long, doc_id long, line int, node long"), "lines")

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                for _, _, text in slices(batch.column(2), SLICE_BYTES):
                    words, _, _, first, last = lines_of(text, max(least, NEAR_WORDS))
                    own, heads = _sequence(words, first, last)
                    node = nodes_of(own, heads, last - first).view(np.int64)
                    new = []
                    for i, x in enumerate(node.tolist()):
                        if x not in seen:
                            seen.add(x)
                            new.append(i)
                    if len(seen) > 1_000_000:
                        seen.clear()  # repeats are harmless
                    first, last, node = first[new], last[new], node[new]
                    own, heads = _sequence(words, first, last)
                    n = last - first
                    line, key = keys_of(own, heads, n)
                    sim, shape = simhashes_of(own, heads, n).view(np.int64), shapes_of(own, heads, n)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[line]), pa.array(sim[line]), pa.array(shape[line])], ["s", "node", "value", "more"])
                    short = np.flatnonzero(n < SHORT)
                    rows = [(key, int(node[i]), bigrams_of(x), len(x)) for i, x in zip(short.tolist(), plain_lines(text, words, first[short], last[short])) for key in halves_of(x)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["s", "node", "value", "more"])

        whole, odd = Window.partitionBy("s"), F.col("s").bitwiseAND(F.lit(1)) == 1
        keys = docs.mapInArrow(trimming(keyed), "s long, node long, value long, more long")
        several = keys.withColumn("low", F.min("node").over(whole)).withColumn("high", F.max("node").over(whole)).where("low <> high").select("s", "node", "value", "more").distinct()
        several = several.withColumn("size", F.count("*").over(whole)).withColumn("pivot", F.min(F.struct("node", "value", "more")).over(whole)).withColumn("low", F.min("value").over(whole)).withColumn("high", F.max("value").over(whole))
        far = (F.col("size") == 2) & (F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) > F.when(odd, CHANGED).otherwise(bits))
        self.groups = saved(several.where(~far).select("s", "node", "value", "more", "pivot"), "groups")

    def _first(self, nodes: DataFrame) -> DataFrame:
        """(node, row): the first document of each of the given points."""
        return saved(self.lines.join(bounded(nodes, MOST_NAMED), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")), "first")

    def _texts(self, first: DataFrame) -> tuple[DataFrame, Broadcast]:
        """A broadcast to destroy after use, and before it (node, codes, chars) of points given with a document each, made again from the documents, once each (others, and some of them twice, may come along beyond MOST_NODES). codes: a
        character per word, of lines of nine words or more; chars: the normalised line, of lines of up to nine."""
        count, least, docs, context = rows_of(first), self.least, self.docs, self.docs.sparkSession.sparkContext
        if count <= MOST_NAMED:  # only the documents that are named
            docs = docs.join(F.broadcast(first.select("row").distinct()), "row", "left_semi")
        exact = count <= MOST_NODES
        if exact:
            table = first.toArrow()
            wanted = context.broadcast(np.sort(places_of(table["row"].to_numpy(), table["node"].to_numpy())))
        else:
            wanted = context.broadcast(bitmap(first, BITMAP))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = batch.column(0).to_numpy()
                for lo, _, text in slices(batch.column(2), SLICE_BYTES):
                    words, doc, _, begin, end = lines_of(text, max(least, NEAR_WORDS))
                    own, heads = _sequence(words, begin, end)
                    node = nodes_of(own, heads, end - begin).view(np.int64)
                    place = places_of(row[doc + lo], node)
                    if exact:
                        at = np.minimum(np.searchsorted(wanted.value, place), max(0, len(wanted.value) - 1))
                        known = wanted.value[at] == place if len(wanted.value) else np.zeros(len(place), bool)
                    else:
                        known = marked(wanted.value, place, BITMAP)
                    rows = np.flatnonzero(known)
                    rows = rows[np.unique(place[rows], return_index=True)[1]]  # a document's equal lines
                    n = (end - begin)[rows]
                    codes = [codes_of(own[heads[i] : heads[i] + k]) if k >= SHORT - 1 else None for i, k in zip(rows.tolist(), n.tolist())]
                    chars = iter(plain_lines(text, words, begin[rows][n < SHORT], end[rows][n < SHORT]))
                    yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(codes, pa.string()), pa.array([next(chars) if k < SHORT else None for k in n.tolist()], pa.string())], ["node", "codes", "chars"])

        found = docs.mapInArrow(trimming(emit), "node long, codes string, chars string")
        return found if exact else found.dropDuplicates(["node"]), wanted

    def _verify(self, pairs: DataFrame) -> None:
        """Links of new pairs (a < b) extend the classes."""
        pairs = saved(pairs.distinct(), "pairs")
        nodes = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
        if nodes.isEmpty():
            return
        first = self._first(nodes)
        texts, wanted = self._texts(first)
        x, y = texts.alias("x"), texts.alias("y")  # the same shuffle serves both joins
        both = pairs.join(y, F.col("b") == F.col("y.node")).join(x, F.col("a") == F.col("x.node"))
        by_words = (F.greatest(F.length("x.codes"), F.length("y.codes")) >= SHORT) & near_texts(F.col("x.codes"), F.col("y.codes"), self.percent)
        by_chars = F.call_function("levenshtein", F.col("x.chars"), F.col("y.chars"), F.lit(1)) >= 0
        near = both.where(F.coalesce(by_words, F.lit(False)) | F.coalesce(by_chars, F.lit(False))).select("a", "b").distinct()
        self._extend(near)
        wanted.destroy()
        dropped(pairs, nodes, first)

    def _extend(self, near: DataFrame) -> None:
        """New links extend the classes."""
        before, self.near = self.near, saved(near if self.near is None else self.near.unionByName(near), "near")
        dropped(before)
        before, self.classes = self.classes, saved(components(self.near), "classes")
        dropped(before)

    def link(self) -> None:
        """Finds the classes of near-equal lines."""
        chars = F.col("s").bitwiseAND(F.lit(1)) == 1
        percent, bits = self.percent, self.bits
        others = self.groups.where(F.col("node") != F.col("pivot.node"))
        apart, low = F.bit_count(F.col("value").bitwiseXOR(F.col("pivot.value"))), F.lit(0xFFFF)
        n, m = F.col("more").bitwiseAND(low), F.col("pivot.more").bitwiseAND(low)
        limit = F.floor(F.greatest(n, m) * (100 - percent) / 100)
        odd = F.bit_count(F.shiftright(F.col("more").bitwiseXOR(F.col("pivot.more")), 16).bitwiseAND(F.lit((1 << 48) - 1)))
        alike = (apart <= bits) & (F.abs(n - m) <= limit) & (odd + F.abs(n - m) <= 2 * limit)
        alike = F.when(chars, (apart <= CHANGED) & (F.abs(F.col("more") - F.col("pivot.more")) <= 1)).otherwise(alike)
        self._verify(others.where(alike).select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")))
        live = saved(with_classes(others.drop("pivot"), self.classes), "live")
        if live.isEmpty():
            return
        nodes = saved(live.select("node").distinct(), "nodes")
        first = self._first(nodes)
        texts, wanted = self._texts(first)

        def near(s: np.ndarray, v: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            differ = np.bitwise_count((v ^ w).view(np.uint64))
            return np.where(s & 1 == 1, (differ <= CHANGED) & (np.abs(x - y) <= 1), (differ <= bits) & can_be_near(x, y, percent))

        def most(s: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
            longer = np.maximum(n, m)
            return np.where(s & 1 == 1, 1, np.where(longer >= SHORT, longer * (100 - percent) // 100, -1))

        rows = live.join(texts, "node").select("s", "node", "value", "more", "class", "size", F.when(chars, F.col("chars")).otherwise(F.col("codes")).alias("text"))
        self._extend(links_within(rows, near, most, self.block, self.small))
        wanted.destroy()
        dropped(live, nodes, first)

    def removed(self) -> DataFrame:
        """(row, lines): numbers of the lines that go."""
        rows = self.lines.select("row", "doc_id", "line", "node")
        if self.classes is not None:
            known = bounded(self.classes).select(F.col("node").alias("of"), "component")
            rows = rows.join(known, F.col("node") == F.col("of"), "left").withColumn("class", F.coalesce("component", "node"))
        else:
            rows = rows.withColumn("class", F.col("node"))
        place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("line").alias("l"))
        several = rows.groupBy("class").agg(F.min(place).alias("stays"), F.count("*").alias("n")).where("n > 1").select(F.col("class").alias("key"), F.col("stays.r").alias("r"), F.col("stays.l").alias("l"))
        several = bounded(saved(several, "stays"))
        gone = rows.join(several, F.col("class") == F.col("key")).where((F.col("row") != F.col("r")) | (F.col("line") != F.col("l")))
        return gone.groupBy("row").agg(F.collect_list("line").alias("lines"))


def deduped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents as struct `doc` with their text rewritten, and n_lines, n_removed."""
    rows = saved(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    lines = Lines(rows.select("row", F.col(f"doc.{id_col}").cast("long").alias("doc_id"), F.col(f"doc.{text_col}").cast("string").alias("text")), **options)
    lines.link()
    dropped(lines.groups, lines.near)
    gone = saved(lines.removed().select(F.col("row").alias("of"), "lines"), "removed")
    dropped(lines.lines, lines.classes)
    with shuffles_freed(docs.sparkSession):
        size = gone.agg(F.coalesce(F.sum(F.size("lines") + 4), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(gone) if size <= 4_000_000 else gone, F.col("row") == F.col("of"), "left")  # 16 MB at most
    parts = F.split(F.col(f"doc.{text_col}"), "\n")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("lines", i)), "\n")
    text = F.when(F.col("lines").isNull(), F.col(f"doc.{text_col}")).otherwise(left)
    return joined.select(F.col("doc").withField(text_col, text).alias("doc"), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"))


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """The documents without the repeated lines, with the columns they came with; those left without a word by it go."""
    text = F.col(f"doc.{options.get('text_col', 'text')}")
    got = deduped(docs, **options)
    return got.where((F.col("n_removed") == 0) | text.rlike("[^\\x20\\x09-\\x0D]")).select("doc.*")
