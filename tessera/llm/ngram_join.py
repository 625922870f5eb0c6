"""Exact self-join of documents on the Jaccard similarity of their word shingles, as a join in a metric space.

Documents with equal shingle sets are one point. Jaccard distance is 1 between points that share no shingle, so pivots taken from the
documents alone would leave nearly all points at distance 1 from all of them. The first level therefore takes single shingles
as pivots: the region of a shingle holds the points that have it among their rarest ones. Points within the distance
limit share at least one region (a point's prefix is as long as that needs), which makes the first level exact.

Within a region, pivots are points. Round 0 measures each region's members against one of them; members within the limit form one class,
and regions that hold a single class are done, however many copies they have. Regions of more than `leaf` points are measured against
`PIVOTS` further ones; its points go to the Voronoi cells of their nearest pivots and, by the triangle inequality, also to every cell whose pivot is
not farther than the nearest one by more than twice the limit; cells are regions again, for `depth` levels. In those still large each point is measured
against the one that seems nearest in one of its cells, twice, so that points beside a class join it first. What is left is joined pair by pair: pairs of one class, of sizes too different, or with distances to a common pivot that differ by more than the limit are
skipped, as are pairs whose bucket counts (a contraction of the metric) are too far apart; pairs that share fewer rare shingles than a pair within the limit must have are dropped; all others are verified on
their whole sets. Before that, points that share too few of their rare shingles with all others together are left out: they are within the limit of none. A leaf that stays large is dealt out in blocks.

Shingles and sets are 64-bit hashes. No bound drops a pair: `hot_most` bounds the frequent shingles that are told to all tasks, which
only orders prefixes.

Rows: null and wordless texts have no shingles and link with nothing; texts of fewer words than a shingle count as one shingle; equal doc_ids
are rows of their own but share links; null doc_ids never name a component unless all its ids are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Text, bounded, documents, dropped, mixed, rows_of, saved, shuffles_freed, slices, words_of
from .graph import SMALL, components, nearest_within, pairs_within, with_classes
from .memory import trimming

WIDTH = 5
PERCENT = 75
SLICE_BYTES = 8_000_000
#: A shingle is frequent from so many documents on; so many are told to all tasks at most (8 bytes each).
HOT_LEAST, HOT_MOST = 32, 200_000
RUN_SHINGLES = 4_000_000
FREE = 1 << 29
BUCKETS, LEAST_BUCKETS = 256, 16
MOST_NAMED, MOST_NODES, MOST_SKETCHES = 500_000, 2_000_000, 200_000
LEAF, DEPTH, PIVOTS, BLOCK = 16, 2, 3, 2048
TURNS = 2
_TURN = np.random.default_rng(77).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(text: Text, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and where each text's begin (n + 1 entries)."""
    words = words_of(text)
    first, h = words.first, words.hash
    n = np.diff(first)
    m = len(h) - width + 1
    rolled = mixed(sum(h[k : m + k] * _TURN[k] for k in range(width))) if m > 0 else np.zeros(0, np.uint64)
    parts: list[np.ndarray] = []
    for a, k in zip(first[:-1].tolist(), n.tolist()):
        if k >= width:
            parts.append(np.unique(rolled[a : a + k - width + 1]))
        elif k:
            parts.append(mixed(np.array([(h[a : a + k] * _TURN[:k]).sum()], np.uint64) + _TURN[32 + k : 33 + k]))
        else:
            parts.append(h[:0])
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts) if parts else h[:0], np.concatenate([[0], np.cumsum(sizes)])


def signatures(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set; meaningless for empty ones."""
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return mixed(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * _TURN[63])


def sketches_of(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per set, how many of its shingles fall into each of BUCKETS buckets (255 at most). Two sketches' distance in sum is at most the sets' symmetric difference."""
    cell = np.repeat(np.arange(len(at) - 1), np.diff(at)) * BUCKETS + ((flat >> np.uint64(17)) % np.uint64(BUCKETS)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=(len(at) - 1) * BUCKETS), 255).astype(np.uint8).reshape(-1, BUCKETS)


def buckets_for(points: int) -> int:
    """How many buckets the sketches of so many points may have, so that they are no larger than those of MOST_SKETCHES points (51 MB); 0 if none."""
    width = BUCKETS
    while width >= LEAST_BUCKETS and points * width > MOST_SKETCHES * BUCKETS:
        width //= 2
    return width if width >= LEAST_BUCKETS else 0


def folded(sketch: np.ndarray, width: int) -> np.ndarray:
    """A sketch of fewer buckets. Sums of buckets, and what 255 cuts off, bring two sketches no further apart, so the bound holds."""
    return np.minimum(sketch.reshape(width, -1).sum(axis=1, dtype=np.int64), 255).astype(np.uint8)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document; after each run of documents also the shingles that several of them have, with times."""
    names = ["doc_id", "n", "sig", "sketch", "shingle", "times"]
    held: list[np.ndarray] = []

    def often() -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        some = times >= 2
        none = pa.nulls(int(some.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(none), pa.binary()), pa.array(values[some].view(np.int64)), pa.array(times[some])], names)

    for batch in batches:
        for lo, hi, text in slices(batch.column(1), SLICE_BYTES):
            flat, at = shingle_sets(text)
            n = np.diff(at)
            none = pa.nulls(hi - lo, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(signatures(flat, at).view(np.int64), mask=n == 0), pa.array([x.tobytes() for x in sketches_of(flat, at)], pa.binary()), none, none], names)
            held.append(flat)
            if sum(map(len, held)) > RUN_SHINGLES:
                yield often()
    if held:
        yield often()


def shared_least(n: Column | np.ndarray):
    """How many shingles two points' prefixes share at least, if both have n shingles or more and are within the limit."""
    return n // 16 + 1 if isinstance(n, np.ndarray) else F.floor(n / 16) + 1


def prefixes(flat: np.ndarray, at: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest shingles of each set (frequent ones last, by frequency, all others by hash), how many those are, and how many of the whole set aren't
    frequent. Two sets that share `percent` of the larger one's shingles share shared_least(of the smaller one) within their prefixes."""
    order = np.argsort(hot)
    ranked = hot[order]
    place = np.minimum(np.searchsorted(ranked, flat), max(0, len(hot) - 1))
    is_hot = ranked[place] == flat if len(hot) else np.zeros(len(flat), bool)
    key = flat >> np.uint64(1)
    key[is_hot] = np.uint64(1 << 63) + order[place[is_hot]].astype(np.uint64)
    n = np.diff(at)
    size = np.minimum(n, n - -(-n * percent // 100) + shared_least(n))
    out = [flat[a:b][np.argsort(key[a:b], kind="stable")[:k]] for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), size.tolist())]
    few = np.concatenate([[0], np.cumsum(~is_hot)])
    return np.concatenate(out) if out else flat[:0], size, few[at[1:]] - few[at[:-1]]


def _near(n: Column, m: Column, percent: int) -> Column:
    """Whether sizes allow the limit."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


class Join:
    def __init__(self, docs: DataFrame, percent: int = PERCENT, hot_least: int = HOT_LEAST, hot_most: int = HOT_MOST, leaf: int = LEAF, block: int = BLOCK):
        self.docs, self.percent, self.leaf, self.block = docs, percent, leaf, block
        self.limit = 1 - percent / 100
        self.spark = docs.sparkSession
        profile = saved(docs.mapInArrow(trimming(_profile), "doc_id long, n long, sig long, sketch binary, shingle long, times long"), "profile")
        self.profile = profile
        self.members = profile.where("shingle is null").select("doc_id", "n", "sig")
        often = profile.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= hot_least)
        with shuffles_freed(self.spark):
            rows = often.orderBy(F.desc("times"), "shingle").limit(hot_most).collect()
        hot = np.array([r["shingle"] for r in reversed(rows)], np.int64).view(np.uint64)
        self.regions = self._trimmed(self._first_level(self.spark.sparkContext.broadcast(hot)))
        schema = "a long, b long, near boolean, distance double"
        self.tried = self.spark.createDataFrame([], schema)
        self.classes: DataFrame | None = None

    def _first_level(self, hot) -> DataFrame:
        """(s, node, n, few, rare): the regions with two points at least. few: how many of the point's shingles aren't frequent, -1 if its
        prefix doesn't have all of those; rare: whether s isn't."""
        percent = self.percent

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                for _, _, text in slices(batch.column(1), SLICE_BYTES):
                    flat, at = shingle_sets(text)
                    sig, n = signatures(flat, at), np.diff(at)
                    chosen = []
                    for i, x in enumerate(sig.tolist()):
                        if n[i] and x not in seen:
                            seen.add(x)
                            chosen.append(i)
                    keep = np.array(chosen, np.int64)
                    if not len(keep):
                        continue
                    flat = np.concatenate([flat[at[i] : at[i + 1]] for i in chosen])
                    at = np.concatenate([[0], np.cumsum(n[keep])])
                    rare, size, few = prefixes(flat, at, hot.value, percent)
                    # size, how many shingles aren't frequent (if the prefix has them all), and whether this one is
                    info = n[keep] | np.where(few <= size, few + 1, 0) << 28
                    place = np.arange(len(rare)) - np.repeat(np.cumsum(size) - size, size)
                    info = np.repeat(info, size) | (place >= np.repeat(few, size)).astype(np.int64) << 60
                    for lo in range(0, len(rare), 200_000):
                        hi = lo + 200_000
                        node = np.repeat(sig[keep].view(np.int64), size)[lo:hi]
                        yield pa.RecordBatch.from_arrays([pa.array(rare[lo:hi].view(np.int64)), pa.array(node), pa.array(info[lo:hi])], ["s", "node", "info"])

        rows = self.docs.mapInArrow(trimming(emit), "s long, node long, info long")
        whole = Window.partitionBy("s")
        several = rows.withColumn("low", F.min("node").over(whole)).withColumn("high", F.max("node").over(whole)).where("low <> high")
        info, low = F.col("info"), F.lit((1 << 28) - 1)
        few = F.shiftright(info, 28).bitwiseAND(low) - 1
        return saved(several.select("s", "node", info.bitwiseAND(low).alias("n"), few.alias("few"), (info < 1 << 60).alias("rare")).distinct(), "regions")

    def _trimmed(self, regions: DataFrame, turns: int = 2) -> DataFrame:
        """(s, node, n, u): points that share too few of their prefix with all others together go, and then regions of one point, in turns.

        u bounds the shingles that two points share if both have all their infrequent shingles in their prefixes: an infrequent one
        whose region holds no other point isn't shared by such points. For all other points u is FREE.
        """
        n, own, whole = F.col("n"), Window.partitionBy("node"), Window.partitionBy("s")
        least = shared_least(F.ceil(n * self.percent / 100))
        u = F.when(F.col("few") < 0, FREE).otherwise(n - F.col("few") + F.col("held"))
        for _ in range(turns):
            rows = regions.select("s", "node", "n", "few", "rare").withColumn("live", F.count("*").over(own)).withColumn("held", F.sum(F.col("rare").cast("int")).over(own))
            left = rows.where(F.col("live") >= least).select("s", "node", "n", "few", "rare", u.alias("u"))
            left = left.withColumn("low", F.min("node").over(whole)).withColumn("high", F.max("node").over(whole)).where("low <> high")
            before, regions = regions, saved(left.drop("low", "high"), "trimmed")
            dropped(before)
        return regions.select("s", "node", "n", "u")

    def _can(self, n: Column, u: Column, m: Column, v: Column) -> Column:
        """Whether points of sizes n and m can be within the limit, with bounds u and v on what they share."""
        return _near(n, m, self.percent) & ((F.greatest(u, v) >= FREE) | ((100 + self.percent) * F.least(u, v) >= self.percent * (n + m)))

    def _live(self, regions: DataFrame) -> DataFrame:
        """With each point's class; regions of one class are left out."""
        return saved(with_classes(regions, self.classes), "live")

    def _measure(self, pairs: DataFrame) -> None:
        """Exact distances of new pairs (a < b); links extend the classes."""
        pairs = saved(pairs.distinct().join(self.tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        nodes = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
        count, ids = rows_of(nodes), None
        if not count:
            return
        docs, wanted = self.docs, None
        if count <= MOST_NAMED:  # texts that hold none of the points aren't read into sets again
            ids = self.members.join(F.broadcast(nodes), F.col("sig") == F.col("node"), "left_semi").groupBy("sig").agg(F.min("doc_id").alias("id"))
            ids = saved(ids.where("id is not null").select("id").distinct(), "ids")
            docs = docs.where("doc_id is null").unionByName(docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi"))
        if count <= MOST_NODES:  # 16 MB at most; beyond that, all sets are made and joined
            wanted = self.spark.sparkContext.broadcast(np.sort(nodes.toArrow()["node"].to_numpy()))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                for _, _, text in slices(batch.column(1), SLICE_BYTES):
                    flat, at = shingle_sets(text)
                    sig, n = signatures(flat, at).view(np.int64), np.diff(at)
                    ok = n > 0
                    if wanted is not None:
                        place = np.minimum(np.searchsorted(wanted.value, sig), len(wanted.value) - 1)
                        ok &= wanted.value[place] == sig
                    rows = []
                    for i in np.flatnonzero(ok).tolist():
                        if int(sig[i]) not in seen:
                            seen.add(int(sig[i]))
                            rows.append(i)
                    if rows:
                        own = [flat[at[i] : at[i + 1]].view(np.int64) for i in rows]
                        offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own)))
                        yield pa.RecordBatch.from_arrays([pa.array(sig[rows]), lists], ["node", "shingles"])

        found = docs.mapInArrow(trimming(sets), "node long, shingles array<long>")
        if wanted is None:
            found = found.join(nodes, "node", "left_semi")
        x, y = found.alias("x"), found.alias("y")  # the same shuffle serves both joins
        both = pairs.join(y, F.col("b") == F.col("y.node")).join(x, F.col("a") == F.col("x.node"))
        shared = both.select("a", "b", F.size(F.array_intersect("x.shingles", "y.shingles")).alias("shared"), (F.size("x.shingles") + F.size("y.shingles")).alias("total"))
        union = F.col("total") - F.col("shared")
        measured = shared.select("a", "b", (100 * F.col("shared") >= self.percent * union).alias("near"), (1 - F.col("shared") / union).alias("distance"))
        before, self.tried = self.tried, saved(self.tried.unionByName(measured).distinct(), "tried")
        dropped(before, pairs, nodes, ids)
        before, self.classes = self.classes, saved(components(self.tried.where("near").select("a", "b")), "classes")
        dropped(before)

    def _pivots(self, live: DataFrame, turn: int) -> DataFrame:
        """One point per region, another one each turn."""
        point = F.struct("node", "n", "u", "class")
        return live.groupBy("s").agg(F.min_by(point, F.xxhash64("node", F.lit(turn))).alias("p")).select(F.col("s").alias("region"), F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.u").alias("pivot_u"), F.col("p.class").alias("pivot_class"))

    @staticmethod
    def _ordered(x: Column, y: Column) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def _against(self, live: DataFrame, pivots: DataFrame) -> DataFrame:
        """Pairs of a region's members with its pivot that can be near and aren't of one class."""
        rows = live.join(pivots, F.col("s") == F.col("region")).where((F.col("class") != F.col("pivot_class")) & self._can(F.col("n"), F.col("u"), F.col("pivot_n"), F.col("pivot_u")))
        return rows.select(*self._ordered(F.col("node"), F.col("pivot")), F.least("n", "pivot_n").alias("m")).distinct()

    def _sharing(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, m: the smaller size) that share as many rare shingles as the limit asks for. A point's rare shingles are one row, so that joins make a row per pair."""
        pairs = saved(pairs, "asked")
        nodes = bounded(saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked-nodes"))
        rare = self.regions.join(nodes, "node", "left_semi").groupBy("node").agg(F.collect_list("s").alias("rare"))
        x, y = rare.alias("x"), rare.alias("y")  # the same shuffle serves both joins
        both = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
        return both.where(F.size(F.array_intersect("x.rare", "y.rare")) >= shared_least(F.col("m"))).select("a", "b")

    def _voronoi(self, live: DataFrame, level: int) -> DataFrame:
        """Large regions split into the cells of their pivots: (s, node, n, u) with new region numbers. A region whose cells overlap so much that they have as many pairs as itself
        (points far from all pivots go to each cell) stays whole."""
        every = self._pivots(live, 100 * level).select("region", "pivot", F.lit(0).alias("cell"))
        for k in range(1, PIVOTS):
            every = every.unionByName(self._pivots(live, 100 * level + k).select("region", "pivot", F.lit(k).alias("cell")))
        every = saved(every, "pivots")
        rows = live.join(every, F.col("s") == F.col("region")).where(F.col("node") != F.col("pivot"))
        self._measure(rows.select(*self._ordered(F.col("node"), F.col("pivot"))))
        rows = live.join(every, F.col("s") == F.col("region"))
        rows = rows.select("s", "node", "n", "u", "pivot", "cell", *self._ordered(F.col("node"), F.col("pivot")))
        known = self.tried.select("a", "b", "distance")
        rows = rows.join(known, ["a", "b"], "left").withColumn("d", F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("distance")))
        nearest = F.min("d").over(Window.partitionBy("s", "node"))
        # a partner within the limit, at home in this cell, is at most twice the limit closer to its pivot than to any other
        rows = rows.withColumn("nearest", nearest).where(F.col("d") <= F.col("nearest") + 2 * self.limit + 1e-9)
        members = saved(rows.select("s", "cell", "node", "n", "u").distinct(), "members")
        work = members.groupBy("s", "cell").agg(F.count("*").alias("k")).groupBy("s").agg(F.sum(F.col("k") * F.col("k")).alias("work"))
        split = work.join(live.groupBy("s").agg(F.count("*").alias("k")), "s").where(F.col("work") < F.col("k") * F.col("k")).select("s")
        split, named = saved(split, "split"), lambda cell: F.xxhash64("s", cell, F.lit(level)).alias("s")
        cells = members.join(split, "s", "left_semi").select(named(F.col("cell")), "node", "n", "u")
        return cells.unionByName(live.join(split, "s", "left_anti").select(named(F.lit(-1)), "node", "n", "u"))

    def _sketches(self, live: DataFrame):
        """The live points' sketches, names ascending, for all tasks, of fewer buckets the more points there are; none where even LEAST_BUCKETS are too many (they only spare counting)."""
        nodes = live.select("node").distinct()
        found = self.profile.where("sig is not null").join(nodes, F.col("sig") == F.col("node"), "left_semi").groupBy("sig").agg(F.first("sketch").alias("sketch"))
        found = saved(found, "sketches")
        count = rows_of(found)
        width = buckets_for(count)
        if not count or not width:
            return None
        names, table = np.empty(count, np.int64), np.empty((count, width), np.uint8)
        for i, row in enumerate(found.orderBy("sig").toLocalIterator()):
            names[i], table[i] = row["sig"], folded(np.frombuffer(row["sketch"], np.uint8), width)
        dropped(found)
        return self.spark.sparkContext.broadcast((names, table))

    def _homes(self, live: DataFrame):
        """The regions of the points of large regions, for all tasks; none where they are too many (pairs then come once per region)."""
        rows = saved(live.where(F.col("size") > min(SMALL, self.block)).select("node", "s"), "homes")
        if rows_of(rows) > 4_000_000:  # 64 MB at most
            return None
        table = rows.toArrow().sort_by([("node", "ascending"), ("s", "ascending")])
        dropped(rows)
        nodes = table["node"].to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]])) if len(nodes) else np.zeros(0, np.int64)
        return self.spark.sparkContext.broadcast((nodes[begin], np.append(begin, len(nodes)), table["s"].to_numpy()))

    def _leaves(self, live: DataFrame, homes=None) -> DataFrame:
        """Candidate pairs (a, b, m: the smaller size), once per region they share, or once in all where homes are given."""
        low, apart = (1 << 32) - 1, self._apart(live)
        pairs = pairs_within(self._packed(live), lambda *row: np.isfinite(apart(*row)), self.block, homes)
        return pairs.select("a", "b", F.least(F.col("x").bitwiseAND(F.lit(low)), F.col("y").bitwiseAND(F.lit(low))).alias("m"))

    @staticmethod
    def _packed(live: DataFrame) -> DataFrame:
        return live.withColumn("value", F.shiftleft(F.col("u").cast("long"), 32).bitwiseOR(F.col("n").cast("long")))

    def _apart(self, live: DataFrame):
        """How far points seem apart (a share of their sizes, by bucket counts), infinite where they can't be within the limit."""
        percent, low, sketches = self.percent, (1 << 32) - 1, self._sketches(live)

        def apart(values: np.ndarray, value: np.ndarray | int, nodes: np.ndarray, node: np.ndarray | int) -> np.ndarray:
            n, u, m, v = values & low, values >> 32, value & low, value >> 32
            ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((np.maximum(u, v) >= FREE) | ((100 + percent) * np.minimum(u, v) >= percent * (n + m)))
            out = np.where(ok, 0.0, np.inf)
            if sketches is not None:
                names, table = sketches.value
                some, m, node = np.flatnonzero(ok), np.broadcast_to(m, n.shape), np.broadcast_to(node, nodes.shape)
                for lo in range(0, len(some), 2048):
                    part = some[lo : lo + 2048]
                    x, y = (table[np.searchsorted(names, z[part])].astype(np.int16) for z in (nodes, node))
                    differ, sizes = np.abs(x - y).sum(axis=1), n[part] + m[part]
                    out[part] = np.where((100 + percent) * differ <= (100 - percent) * sizes, differ / sizes, np.inf)
            return out

        return apart

    def _gathered(self, live: DataFrame) -> DataFrame:
        """The regions left when each point was measured against the one that seems nearest in one of its regions, some `TURNS` times in other regions: points beside a class join it
        before pairs are made of them and the whole class."""
        for turn in range(TURNS):
            if live.isEmpty():
                break
            chosen = live.groupBy("node").agg(F.min_by(F.struct("s", "n", "u", "class"), F.xxhash64("s", F.lit(turn))).alias("p")).select("p.s", "node", "p.n", "p.u", "p.class")
            chosen = saved(chosen, "chosen")
            sizes = chosen.groupBy("s").agg(F.count("*").alias("size")).where("size > 1").select(F.col("s").alias("region"), "size")
            rows = chosen.join(sizes, F.col("s") == F.col("region")).drop("region")
            self._measure(nearest_within(self._packed(rows), self._apart(chosen), self.block))
            before, live = live, self._live(live.drop("class", "size"))
            dropped(chosen, before if turn else None)
        return live

    def run(self) -> DataFrame:
        live = self._live(self.regions)
        self._measure(self._sharing(self._against(live, self._pivots(live, 0))))
        live, large = self._live(self.regions), []
        big = live.where(F.col("size") > self.leaf)
        for level in range(1, DEPTH + 1):
            if big.isEmpty():
                break
            big = self._live(saved(self._voronoi(big, level), "cells"))
            large.append(big.where(F.col("size") <= self.leaf) if level < DEPTH else self._gathered(big))
            big = big.where(F.col("size") > self.leaf)
        live = self._live(self.regions) if large else live
        # pairs of small regions are counted there; a pair that shares a larger one comes once from it, or from its cells, and is counted by a join
        small = min(SMALL, self.leaf)
        counted = self._leaves(live.where(F.col("size") <= small)).groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("m").alias("m"))
        middle = live.where((F.col("size") > small) & (F.col("size") <= self.leaf))
        rest = self._leaves(middle, self._homes(middle))
        for part in large:
            rest = rest.unionByName(self._triangle(self._leaves(part, self._homes(part)).distinct()))
        rest = self._sharing(rest.distinct())
        pairs = counted.where(F.col("shared") >= shared_least(F.col("m"))).select("a", "b").unionByName(rest)
        self._measure(pairs)
        return self._answer()

    def _triangle(self, pairs: DataFrame) -> DataFrame:
        """Without pairs whose distances to a common pivot differ by more than the limit."""
        both = self.tried.select(F.col("a").alias("x"), F.col("b").alias("p"), "distance").unionByName(self.tried.select(F.col("b").alias("x"), F.col("a").alias("p"), "distance"))
        pivots = both.groupBy("p").agg(F.count("*").alias("k")).where(F.col("k") > self.leaf).select(F.col("p").alias("pivot"))
        near = both.join(pivots, F.col("p") == F.col("pivot")).groupBy("x").agg(F.map_from_entries(F.slice(F.array_sort(F.collect_list(F.struct("p", "distance"))), 1, 64)).alias("d"))
        rows = pairs.join(near.select(F.col("x").alias("a"), F.col("d").alias("da")), "a", "left").join(near.select(F.col("x").alias("b"), F.col("d").alias("db")), "b", "left")
        apart = F.exists(F.map_entries("da"), lambda e: F.abs(e["value"] - F.try_element_at("db", e["key"])) > self.limit + 1e-9)
        return rows.where(~F.coalesce(apart, F.lit(False))).select("a", "b", "m")

    def _answer(self) -> DataFrame:
        rows = self.members
        if self.classes is not None:
            classes = bounded(self.classes).select(F.col("node").alias("of"), "component")
            rows = rows.join(classes, F.col("sig") == F.col("of"), "left").withColumn("class", F.coalesce("component", "sig"))
        else:
            rows = rows.withColumn("class", F.col("sig"))
        least = rows.where("sig is not null").groupBy("class").agg(F.min("doc_id").alias("least")).select(F.col("class").alias("key"), "least")
        linked = rows.where("sig is not null").join(least, F.col("class") == F.col("key")).select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
        return linked.unionByName(rows.where("sig is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def joined(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    return Join(documents(docs, id_col, text_col), **options).run()


def kept(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component (the one with the smallest id; of repeated rows any one), with the columns it came with."""
    rows = saved(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    found = joined(rows.select("row", F.col(f"doc.{text_col}").alias("text")), id_col="row", **options)
    ids = rows.select(F.col("row").alias("doc_id"), F.col(f"doc.{id_col}").alias("own"))
    first = found.join(ids, "doc_id").groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "doc_id")).alias("m")).select(F.col("m.doc_id").alias("row"))
    return rows.join(first, "row", "left_semi").select("doc.*")
