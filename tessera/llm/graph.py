"""Pairs and links within groups, and connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import edits
from .common import bounded, dropped, rows_of, saved, shuffles_freed
from .memory import trimming

#: Up to so many rows a group's pairs are made along with those of all other such groups.
SMALL = 64
#: So many bytes of texts are compared at once, or those of one group's block.
TEXT_BYTES = 16_000_000
#: Up to so many edges the driver finds the components (8 MB of edges); beyond them they are found by joins.
MOST_EDGES = 500_000


def _rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, and each one's smallest reachable node."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])  # a root hangs on the smallest one it meets
        while np.any(root[root] != root):
            root = root[root]
    return nodes, nodes[root]


def components(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """From edges (a, b) of longs: (node, component) for every node of an edge between two nodes, component being its smallest node.

    Up to `most` edges are solved by the driver. With more, each step hangs a node's larger (then smaller) neighbours on its smallest one; the number of steps grows
    with the logarithm of the component's size. Steps are written to the shared folder, so lineage stays short and lost executors cost one step.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = saved(pairs, "edges"), None
    if rows_of(pairs) <= most:
        table = pairs.toArrow()
        dropped(pairs)
        nodes, roots = _rooted(table["u"].to_numpy(), table["v"].to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(roots, pa.int64())}))
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("m", "u").alias("m"))
        large = both.join(least, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m")
        small = large.join(least, F.col("u") == F.col("of")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, pairs = pairs, saved(small.unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct(), "small")
        dropped(last, large)
        with shuffles_freed(pairs.sparkSession):
            state = tuple(pairs.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if state == before:
            break
        before = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_classes(rows: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Rows (s, node, ...) of groups s that hold two classes at least, with the node's class and the group's size."""
    if classes is None:
        rows = rows.withColumn("class", F.col("node"))
    else:
        known = bounded(classes).select(F.col("node").alias("of"), "component")
        rows = rows.join(known, F.col("node") == F.col("of"), "left").withColumn("class", F.coalesce("component", "node")).drop("of", "component")
    state = rows.groupBy("s").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("size")).where("low <> high").select(F.col("s").alias("live"), "size")
    return rows.join(state, F.col("s") == F.col("live")).drop("live")


def _dealt(rows: DataFrame, block: int, *columns: str) -> DataFrame:
    """(s, i, j, own, columns) sorted by s, i, j: rows of each group, of one with more than `block` rows by pairs of blocks."""
    parts = F.ceil(F.col("size") / block).cast("int")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), parts).cast("int"))
    dealt = dealt.select("s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns)
    return dealt.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")


def _last(kind: np.ndarray) -> np.ndarray:
    """An order of rows in which those of the largest class come last."""
    names, times = np.unique(kind, return_counts=True)
    return np.argsort(kind == names[np.argmax(times)], kind="stable")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Runs of whole groups; one that is split over batches comes when it is complete."""
    rest: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
        last = np.flatnonzero(np.any(table[:, :3] != table[-1, :3], axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if rest and np.any(rest[0][0, :3] != table[0, :3]):
            yield np.concatenate(rest)
            rest = []
        if cut:
            yield np.concatenate([*rest, table[:cut]])
            rest = []
        rest.append(table[cut:])
    if rest:
        yield np.concatenate(rest)


def pairs_within(rows: DataFrame, near: Callable[..., np.ndarray], block: int, homes=None) -> DataFrame:
    """Pairs (a < b, x and y: their values) of nodes of one group s, of two classes, that near(values, value, nodes, node) keeps; once per group.

    homes: a broadcast of (nodes ascending, where each one's groups begin, their numbers ascending), if given a pair comes from the first group
    that both are in only, for groups of over SMALL rows.

    rows: s, node, value, class, size. A group of more than `block` rows is dealt out as pairs of blocks, so a task never holds more than two
    blocks of it.
    """
    dealt = _dealt(rows, block, "node", "value", "class")

    def ordered(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        first = a < b
        return np.stack([np.where(first, a, b), np.where(first, b, a), np.where(first, x, y), np.where(first, y, x)], axis=1)

    def kept(table: np.ndarray, some: np.ndarray, other: np.ndarray | int) -> np.ndarray:
        return near(table[some, 5], table[other, 5], table[some, 4], table[other, 4])

    def of_large(group: np.ndarray) -> Iterator[np.ndarray]:
        """Each row against all after it; those of the largest class come last, as they have no pairs among themselves."""
        group = group[_last(group[:, 6])]
        own, node, value, kind = group[:, 3], group[:, 4], group[:, 5], group[:, 6]
        cross, earlier = group[0, 1] != group[0, 2], None
        for k in range(int(np.sum(kind != kind[-1]))):
            ok = kind[k + 1 :] != kind[k]
            if cross:
                ok &= own[k + 1 :] != own[k]
            some = np.flatnonzero(ok) + k + 1
            some = some[kept(group, some, k)] if len(some) else some
            if len(some) and homes is not None:
                earlier = shared_before(node, group[0, 0]) if earlier is None else earlier
                some = some[~np.any(earlier[some] & earlier[k], axis=1)]
            if len(some):
                yield ordered(node[some], np.full(len(some), node[k]), value[some], np.full(len(some), value[k]))

    def shared_before(node: np.ndarray, s: int) -> np.ndarray:
        """Which groups of smaller number each node is in, as a row of booleans."""
        names, begin, numbers = homes.value
        at = np.searchsorted(names, node)
        own = [numbers[begin[i] : begin[i + 1]] for i in at.tolist()]
        own = [x[: np.searchsorted(x, s)] for x in own]
        every = np.unique(np.concatenate(own))
        out = np.zeros((len(node), len(every)), bool)
        for i, x in enumerate(own):
            out[i, np.searchsorted(every, x)] = True
        return out

    def of_small(table: np.ndarray, group: np.ndarray) -> Iterator[np.ndarray]:
        """All groups at once: rows against those one, two, ... places behind, while any group is that long."""
        node, value, kind = table[:, 4], table[:, 5], table[:, 6]
        first = np.arange(len(table))
        for k in range(1, SMALL):
            first = first[first + k < len(table)]
            first = first[group[first] == group[first + k]]
            if not len(first):
                return
            some = first[kind[first] != kind[first + k]]
            some = some[kept(table, some, some + k)] if len(some) else some
            if len(some):
                yield ordered(node[some], node[some + k], value[some], value[some + k])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            heads = np.concatenate([[True], np.any(table[1:, :3] != table[:-1, :3], axis=1)])
            group = np.cumsum(heads) - 1
            size = np.bincount(group)[group]
            few = (size <= SMALL) & (table[:, 1] == table[:, 2])
            made = [of_small(table[few], group[few])]
            made += [of_large(table[group == g]) for g in np.unique(group[~few]).tolist()]
            for part in (x for m in made for x in m):
                yield pa.RecordBatch.from_arrays([pa.array(part[:, k]) for k in range(4)], ["a", "b", "x", "y"])

    return dealt.mapInArrow(pairs, "a long, b long, x long, y long")


def nearest_within(rows: DataFrame, apart: Callable[..., np.ndarray], block: int) -> DataFrame:
    """(a, b), a < b: each node with the one of its group, of another class, that seems nearest by apart(values, value, nodes, node), if that is finite; as many rows as nodes at most
    where groups have one block. Rows as in pairs_within."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            heads = np.flatnonzero(np.concatenate([[True], np.any(table[1:, :3] != table[:-1, :3], axis=1)]))
            found = []
            for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(table)]):
                own, node, value, kind = table[lo:hi, 3], table[lo:hi, 4], table[lo:hi, 5], table[lo:hi, 6]
                cross = table[lo, 1] != table[lo, 2]
                for k in range(hi - lo):
                    some = np.flatnonzero((kind != kind[k]) & (own != own[k]) if cross else kind != kind[k])
                    if len(some):
                        distance = apart(value[some], value[k], node[some], node[k])
                        best = int(np.argmin(distance))
                        if np.isfinite(distance[best]):
                            found.append(sorted((int(node[k]), int(node[some[best]]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return _dealt(rows, block, "node", "value", "class").mapInArrow(nearest, "a long, b long")


def links_within(rows: DataFrame, near: Callable[..., np.ndarray], limit: Callable[..., np.ndarray], block: int, small: int = SMALL) -> DataFrame:
    """Links (a < b) that join the classes which pairs of one group s within the edit limit join. Pairs are verified where the group is, so that rows come per joined classes, not per pair.

    rows: s, node, value, more, class, size, text. near(s, value, value, more, more): whether two rows can be near; limit(s, length, length): how many edits two texts may be apart. Groups
    are dealt out as in pairs_within; those of up to `small` rows are dealt with together.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Runs of whole groups."""
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            keys = np.stack([table.column(k).to_numpy() for k in range(3)], axis=1)
            last = np.flatnonzero(np.any(keys != keys[-1], axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = table.slice(cut)
            for lo, hi in cuts(keys[:cut], pc.binary_length(table.column(8)).to_numpy()[:cut]):
                yield table.slice(lo, hi - lo)
        if rest is not None:
            yield rest

    def cuts(keys: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
        """Whole groups of about TEXT_BYTES of text."""
        heads = np.flatnonzero(np.concatenate([[True], np.any(keys[1:] != keys[:-1], axis=1)])) if len(keys) else np.zeros(0, np.int64)
        run = (np.cumsum(size) // TEXT_BYTES)[heads]
        first = heads[np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))] if len(heads) else heads
        return zip(first.tolist(), [*first[1:].tolist(), len(keys)])

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole(batches):
            table = np.stack([part.column(k).to_numpy().astype(np.int64) for k in range(8)], axis=1)
            s, own, node, value, more, kind = table[:, 0], table[:, 3], table[:, 4], table[:, 5], table[:, 6], table[:, 7]
            codes, at = edits.flat(part.column(8).to_pylist())
            n, bits = np.diff(at), edits.parities(codes, at)
            found: list[tuple[np.ndarray, ...]] = []

            def keep(x: np.ndarray, y: np.ndarray) -> None:
                ok = kind[x] != kind[y]  # noqa: B023
                x, y = x[ok], y[ok]
                ok = near(s[x], value[x], value[y], more[x], more[y])  # noqa: B023
                x, y = x[ok], y[ok]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) + np.abs(n[x] - n[y])  # noqa: B023
                most = limit(s[x], n[x], n[y])  # noqa: B023
                ok = apart <= 2 * most
                found.append((x[ok], y[ok], apart[ok], most[ok]))  # noqa: B023

            heads = np.concatenate([[True], np.any(table[1:, :3] != table[:-1, :3], axis=1)])
            group = np.cumsum(heads) - 1
            size, cross = np.bincount(group)[group], table[:, 1] != table[:, 2]
            first, step = np.flatnonzero((size <= small) & ~cross), 1
            while len(first):  # rows against those one, two, ... places behind, while any group is that long
                first = first[first + step < len(table)]
                first = first[group[first] == group[first + step]]
                keep(first, first + step)
                step += 1
            large = (size > small) | cross
            for lo in np.flatnonzero(heads & large).tolist():
                rows = lo + _last(kind[lo : lo + int(size[lo])])
                for k in range(int(np.sum(kind[rows] != kind[rows[-1]]))):
                    after = rows[k + 1 :]
                    after = after[own[after] != own[rows[k]]] if cross[lo] else after
                    keep(np.full(len(after), rows[k]), after)
            if not found:
                continue
            x, y, apart, most = (np.concatenate(z) for z in zip(*found))
            some = edits.links(codes, at, kind, x, y, apart, most)
            a, b = node[x[some]], node[y[some]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _dealt(rows, block, "node", "value", "more", "class", "text").mapInArrow(trimming(joining), "a long, b long")
