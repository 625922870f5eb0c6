import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import graph, ngram_join
from tessera.llm.common import rows_of, saved, text_of


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choice(vocab, 40)
    out = [None, "", " \n", "one", "One", "a b c d", "A b  c\td", "a b c d e", "x" * 50]
    for n in rng.integers(5, 120, 30):
        base = rng.choice(vocab, int(n)).tolist()
        out.append(" ".join(base))
        for _ in range(6):  # edits around the limit
            w = list(base)
            for _ in range(int(rng.integers(0, max(1, n // 30) + 1))):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(vocab))
            out.append(" ".join(w[: len(w) - int(rng.integers(0, max(1, n // 6)))]))
    out += [" ".join([*rng.choice(vocab, 30), *passage, *rng.choice(vocab, 30)]) for _ in range(20)]
    core = rng.choice(vocab, 200).tolist()
    for _ in range(60):  # a dense group
        w = list(core)
        for k in rng.integers(0, 200, 5):
            w[int(k)] = str(rng.choice(vocab))
        out.append(" ".join(w))
    out += ["copy of a text that is here many times over"] * 40
    out.append("long " * 30000)
    return [(None if i % 50 == 7 else i if i % 61 else 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(
    ("options", "limits"),
    [({}, {"SMALL": 3}), ({"hot_least": 3, "leaf": 4, "block": 8}, {}), ({"hot_most": 1, "leaf": 1000, "block": 4}, {"SMALL": 2, "MOST_NODES": 0, "MOST_SKETCHES": 0})],
)
def test_join_is_exact(spark, rows, options, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
        if name == "SMALL":
            monkeypatch.setattr(graph, name, value)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, sig string").repartition(3)
    got = ngram_join.joined(docs, **options).collect()
    want = brute(rows)
    ids = [d for d, _ in rows]
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert len(ids) == len(got)


def test_one_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, row int")
    left = ngram_join.kept(docs)
    assert left.columns == docs.columns
    own = brute([(i, t) for i, (_, t) in enumerate(rows)])
    assert left.count() == len({c for _, _, c in own})


def test_edges_of_the_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.joined(empty).count() == 0 and ngram_join.kept(empty).count() == 0
    one = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, None)], "doc_id long, text string")
    assert sorted((tuple(r) for r in ngram_join.joined(one).collect()), key=repr) == [(5, 0, 5), (None, 1, None), (None, 1, None)]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1080, (60, 2))] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for e in edges for x in e if any(x in f and f[0] != f[1] for f in edges)}


def test_components_by_joins_and_by_the_driver_are_the_same(spark):
    rng = np.random.default_rng(3)
    edges = [(i + 1, i) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(-500, 500, (400, 2))]
    table = spark.createDataFrame(edges, "a long, b long")
    few, many = (sorted(map(tuple, graph.components(table, most=m).collect())) for m in (1000, 0))
    assert few == many and len(few) == len({x for e in edges if e[0] != e[1] for x in e})
    assert graph.components(table.where("a = b")).count() == 0


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        found = manager.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    kept, before = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), files()
    table = saved(kept, "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and rows_of(table) == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_equal_sets_have_equal_signatures_wherever_they_stand():
    texts = [" ".join(f"w{(i * 7 + k) % 50}" for k in range(20 + i)) for i in range(40)]
    whole = ngram_join.signatures(*ngram_join.shingle_sets(text_of(pa.array(texts))))
    alone = [ngram_join.signatures(*ngram_join.shingle_sets(text_of(pa.array([t]))))[0] for t in texts]
    assert whole.tolist() == alone


def test_a_large_group_of_copies_gives_no_row_per_pair_and_region(spark, monkeypatch):
    rng = np.random.default_rng(21)
    vocab, texts = [f"w{i}" for i in range(5000)], []
    core = rng.choice(vocab, 200).tolist()
    for k in range(150):  # a group of near copies, and texts beside it
        w = list(core)
        for at in rng.integers(0, 200, 2 if k < 110 else 7):
            w[int(at)] = str(rng.choice(vocab))
        texts.append(" ".join(w))
    for module in (graph, ngram_join):
        monkeypatch.setattr(module, "SMALL", 8)
    made, leaves = [], ngram_join.Join._leaves

    def counted(self, live, *homes):
        pairs = leaves(self, live, *homes).persist()
        made.append((live.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(ngram_join.Join, "_leaves", counted)
    rows = list(enumerate(texts))
    got = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    print(made)
    assert all(pairs <= live for live, pairs in made)


def test_nearest_of_another_class(spark):
    rows = [(1, k, k * k, k // 3, 9) for k in range(9)] + [(2, 50, 1, 50, 1), (3, 60, 1, 7, 2), (3, 61, 2, 7, 2)]
    df = spark.createDataFrame(rows, "s long, node long, value long, class long, size long")
    far = lambda v, w, n, m: np.where(np.abs(v - w) > 20, np.inf, np.abs(v - w).astype(float))
    want = set()
    for s, node, v, c, _ in rows:
        others = [(abs(v - w), m) for t, m, w, d, _ in rows if t == s and c != d and abs(v - w) <= 20]
        if others:
            want.add(tuple(sorted((node, min(others)[1]))))
    assert {tuple(r) for r in graph.nearest_within(df, far, 2048).collect()} == want


def test_sketches_of_fewer_buckets_stay_a_bound():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, 6000, dtype=np.uint64)), *(np.unique(rng.choice(200, 120).astype(np.uint64) << np.uint64(17)) for _ in range(6))]
    sets.append(sets[0][:5000])
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    table = ngram_join.sketches_of(flat, at)
    assert [ngram_join.buckets_for(ngram_join.MOST_SKETCHES * k) for k in (1, 2, 3, 16, 17)] == [256, 128, 64, 16, 0]
    for width in (256, 128, 64, 16):
        rows = [ngram_join.folded(x, width).astype(int) for x in table]
        for x, s in zip(rows, sets):
            for y, t in zip(rows, sets):
                assert np.abs(x - y).sum() <= len(np.setxor1d(s, t))


def test_cells_that_divide_nothing_are_not_made(spark):
    """Points that share a passage and are far from each other are in each cell of their region; they stay one region."""
    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([*passage, *(f"{i}x{k}" for k in range(int(rng.integers(25, 40))))]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    join = ngram_join.Join(docs, hot_least=1000)
    live = join._live(join.regions)
    big = live.where(F.col("size") > 16)
    n = big.count()
    assert n > 0
    cells = join._voronoi(big, 1)
    assert cells.count() <= n
    homes = lambda rows: {frozenset(x["p"]) for x in rows.groupBy("s").agg(F.collect_set("node").alias("p")).collect()}
    assert homes(cells) == homes(big)
