"""Packing into windows of 1024 ids by non-negative least squares on the histogram of lengths.

Documents are cut into full windows and one rest. Shallow combinations of rest lengths that fill a window (two lengths, or
three of which two are equal) are columns of a matrix; non-negative least squares finds repeat counts whose use of each
length comes closest to the histogram. Counts are rounded down and held to what is there; what no combination takes is
laid out greedily, longest first, and cut at the window's end; the very last ids go to windows whose sizes are powers of two, which need no padding.

Only the histogram (at most 1024 numbers) reaches the driver, at any input size. A piece finds its place by arithmetic from
its rank within its length, and ranks are per-task counters plus offsets that a window function sums up.

Rows: null text counts as empty (the end id alone); equal or null doc_ids are packed as rows of their own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, saved, slices
from .memory import trimming
from .tokens import SLICE_BYTES, encoder, vocabulary_path

WINDOW = 1024
END_ID = 0


def combinations(size: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a window: a + b, and a + a + b."""
    two = [(a, size - a, 0) for a in range(1, size // 2 + 1)]
    three = [(a, a, size - 2 * a) for a in range(1, (size - 1) // 2 + 1)]
    return np.array(two + three, np.int64).reshape(-1, 3)


def least_squares(parts: np.ndarray, wanted: np.ndarray, steps: int = 600) -> np.ndarray:
    """x >= 0 that minimises |A x - wanted|, by accelerated projected gradients; A counts how often a combination (row of parts) uses a length."""
    if not len(parts):
        return np.zeros(0)
    n, flat, own = len(wanted), parts.ravel(), np.repeat(np.arange(len(parts)), parts.shape[1])
    used = flat > 0
    flat, own = flat[used], own[used]
    usage = lambda x: np.bincount(flat, x[own], n)
    back = lambda r: np.bincount(own, r[flat], len(parts))
    bound = back(usage(np.ones(len(parts)))).max()  # row sums of A'A bound its largest eigenvalue
    x = y = np.zeros(len(parts))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(usage(y) - wanted) / bound)
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


class Plan:
    """Where the r-th piece of each length goes."""

    def __init__(self, histogram: dict[int, int], size: int = WINDOW):
        self.size = size
        self.full = histogram.get(size, 0)
        left = np.zeros(size, np.int64)
        for n, count in histogram.items():
            if n < size:
                left[n] = count
        parts = combinations(size)
        parts = parts[np.all((left[parts] > 0) | (parts == 0), axis=1)]
        x = least_squares(parts, left.astype(float))
        at, sequence, slots = np.zeros(size, np.int64), self.full, []
        for i in np.argsort(-x, kind="stable"):
            lengths, times = np.unique(parts[i][parts[i] > 0], return_counts=True)
            k = min(int(x[i] + 0.5), int((left[lengths] // times).min()))
            if k <= 0:
                continue
            offset = 0
            for n in parts[i][parts[i] > 0].tolist():
                slots.append((n, int(at[n]), k, sequence, offset))
                at[n] += k
                left[n] -= k
                offset += n
            sequence += k
        self.planned, self.first_rest = at, sequence
        order = np.arange(size - 1, 0, -1)
        self.base = np.zeros(size, np.int64)  # where a length's residual pieces begin in the residual stream
        self.base[order] = np.concatenate([[0], np.cumsum(order * left[order])])[:-1]
        total = int((np.arange(size) * left).sum())
        whole = total // size * size
        tail = [b for b in (1 << k for k in range(size.bit_length() - 1, -1, -1)) if (total - whole) & b]
        self.whole, self.tail = whole, np.concatenate([[0], np.cumsum(tail)]).astype(np.int64) + whole
        slots.sort()
        s = np.array(slots, np.int64).reshape(-1, 5)
        self.slots, self.reach = s, np.searchsorted(s[:, 0], np.arange(size + 2))

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (from, to, sequence, offset) of the rank-th rest of a length."""
        if length == self.size:
            return [(0, length, rank, 0)]
        if rank < self.planned[length]:
            lo, hi = self.reach[length], self.reach[length + 1]
            i = lo + int(np.searchsorted(self.slots[lo:hi, 1], rank, "right")) - 1
            _, first, _, sequence, offset = self.slots[i].tolist()
            return [(0, length, sequence + rank - first, offset)]
        p = int(self.base[length] + (rank - self.planned[length]) * length)
        out, done = [], 0
        while done < length:
            if p < self.whole:
                sequence, offset, room = p // self.size, p % self.size, self.size - p % self.size
            else:
                i = int(np.searchsorted(self.tail, p, "right")) - 1
                sequence, offset, room = self.whole // self.size + i, p - int(self.tail[i]), int(self.tail[i + 1]) - p
            n = min(room, length - done)
            out.append((done, done + n, self.first_rest + sequence, offset))
            done, p = done + n, p + n
        return out


_PIECES = "part int, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, rank long, ids binary"


def packed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, size: int = WINDOW) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if size < 2 or size & (size - 1):
        raise ValueError("the window must be a power of two")
    vocabulary = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary, 400_000), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for lo, hi, text in slices(batch.column(1), SLICE_BYTES):
                ids, off = enc.encode(text, end_id)
                ids = ids.astype("<u4", copy=False)
                raw = memoryview(ids).cast("B")
                row, start, length, crc, total, rank, rest = [], [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    for at in range(a, b, size):
                        n = min(size, b - at)
                        own = raw[4 * at : 4 * (at + n)]
                        row.append(lo + i), start.append(at - a), length.append(n), total.append(b - a)
                        crc.append(zlib.crc32(own)), rank.append(int(seen[n]))
                        rest.append(None if n == size else own.tobytes())
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(row), pa.int32()), batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(rank, pa.int64()), pa.array(rest, pa.binary())],
                    ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids"],
                )

    pieces = saved(documents(docs, id_col, text_col).mapInArrow(trimming(cut), _PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)  # a row per length: at most `size`
    shift = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.join(counts.select("part", "length", shift.alias("shift")), ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("shift")).alias("rank"), "ids")
    return _placed(ranked, plan)


def _placed(ranked: DataFrame, plan: Plan) -> DataFrame:
    """The plan's arithmetic (as in Plan.place) on columns. Its tables have a row per length or slot, a few thousand at any input size."""
    spark, size = ranked.sparkSession, plan.size
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = ranked.where(F.col("length") == size).select(*kept[:2], F.col("length").cast("long").alias("length"), *kept[3:5], F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    lengths = spark.createDataFrame([(n, int(plan.planned[n]), int(plan.base[n])) for n in range(1, size)], "of int, planned long, base long")
    rests = ranked.where(F.col("length") < size).join(F.broadcast(lengths), F.col("length") == F.col("of"))
    slots = spark.createDataFrame([tuple(x) for x in plan.slots.tolist()], "of_slot int, first long, times long, sequence long, slot_offset long")
    fits = (F.col("length") == F.col("of_slot")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("times"))
    planned = rests.where("rank < planned").join(F.broadcast(slots), fits).select(*kept[:2], F.col("length").cast("long").alias("length"), *kept[3:5], (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("slot_offset").alias("offset"))

    at = F.col("base") + (F.col("rank") - F.col("planned")) * F.col("length")
    rest = rests.where("rank >= planned").withColumn("at", at).withColumn("to", F.col("at") + F.col("length"))
    edges = F.array(F.least((F.floor(F.col("at") / size) + 1) * size, F.lit(plan.whole)), *(F.lit(int(x)).cast("long") for x in plan.tail))
    inside = F.array_distinct(F.filter(edges, lambda x: (x > F.col("at")) & (x < F.col("to"))))
    rest = rest.withColumn("cuts", F.concat(F.array("at"), F.array_sort(inside), F.array("to")))
    rest = rest.select("*", F.explode(F.sequence(F.lit(1), F.size("cuts") - 1)).alias("k"))
    rest = rest.withColumn("a", F.element_at("cuts", F.col("k"))).withColumn("b", F.element_at("cuts", F.col("k") + 1))
    skip, n = F.col("a") - F.col("at"), F.col("b") - F.col("a")
    tail = F.array(*(F.lit(int(x)).cast("long") for x in plan.tail))
    before = F.size(F.filter(tail, lambda x: x <= F.col("a"))) - 1
    in_whole = F.col("a") < plan.whole
    return full.unionByName(planned).unionByName(
        rest.select(
            "doc_id", (F.col("start") + skip).alias("start"), n.alias("length"),
            F.when(F.size("cuts") == 2, F.col("ids_crc32")).otherwise(F.crc32(F.col("ids").substr((4 * skip + 1).cast("int"), (4 * n).cast("int")))).alias("ids_crc32"), "doc_tokens",
            (plan.first_rest + F.when(in_whole, F.floor(F.col("a") / size)).otherwise(plan.whole // size + before)).cast("long").alias("sequence_id"),
            F.when(in_whole, F.col("a") % size).otherwise(F.col("a") - F.element_at(tail, before + 1)).cast("long").alias("offset"),
        )
    )
