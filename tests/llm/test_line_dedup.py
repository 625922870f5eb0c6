import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, line_dedup
from tessera.llm.common import text_of


def words(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return re.findall("[\u0e00-\u0eff\u3000-\u9fff\U00020000-\U0002ffff]|[^\x00-\x2f\x3a-\x60\x7b-\x7f\u0e00-\u0eff\u3000-\u9fff\U00020000-\U0002ffff]+", low)


@lru_cache(None)
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    """The edit limit alone, without hashes."""
    x, y = tuple(a.split()), tuple(b.split())
    if max(len(x), len(y)) >= 10:
        return abs(len(x) - len(y)) <= max(len(x), len(y)) // 10 and distance(x, y) <= max(len(x), len(y)) // 10
    return min(len(x), len(y)) >= 4 and abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1


def brute(docs, least=1):
    lines = [(d is None, d or 0, r, k, " ".join(w)) for r, (d, t) in enumerate(docs) for k, x in enumerate((t or "").split("\n")) if len(w := words(x)) >= least]
    norms = sorted({x[4] for x in lines})
    root = {n: n for n in norms}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(norms):
        for b in norms[:i]:
            if near(a, b):
                root[find(a)] = find(b)
    stays = {}
    for x in sorted(lines):
        stays.setdefault(find(x[4]), x)
    gone = {(x[2], x[3]) for x in lines if stays[find(x[4])] != x}
    return [(d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r, k) not in gone), sum(g[0] == r for g in gone)) for r, (d, t) in enumerate(docs)]


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(8)
    vocab = ["word", "Straße", "été", "alpha", "beta", "gamma", "delta", "x1", "Omega", "nu", "pi", "rho"]
    pool = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(1, 40, 25)]
    pool += [x + "." for x in pool[:5]] + [x.replace("a", "b", 1) for x in pool] + [x.replace("word", "wort", 1) for x in pool for _ in range(2)]
    texts = [None, "", "\n", "\n\n", "one two three four five six", "ONE, two: three\tfour five - six!\n", "\none two three four five six", "a b c d e f " * 3000]
    texts += ["\n".join(rng.choice(pool, int(n))) + ("\n" if n % 2 else "") for n in rng.integers(1, 8, 60)]
    return [(None if i % 9 == 4 else 1000 - i if i % 7 else 5, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"block": 4, "small": 2}])
def test_lines_against_brute_force(spark, docs, options):
    df = spark.createDataFrame([(d, t, 3, "x") for d, t in docs], "doc_id long, text string, line int, row string").coalesce(1)
    got = line_dedup.deduped(df, **options).select("doc.doc_id", "doc.text", "n_removed", "doc.line").collect()
    assert all(r.line == 3 for r in got)
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=repr) == sorted(brute(docs), key=repr)
    left = line_dedup.cleaned(df)
    assert left.columns == df.columns
    assert left.count() == sum(not n or bool((t or "").strip()) for _, t, n in brute(docs))


def test_empty(spark):
    assert line_dedup.deduped(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_texts_bands(spark):
    from pyspark.sql import functions as F

    rows = [("a" * 1000, "a" * 900 + "b" * 100), ("a" * 1000, "a" * 899 + "b" * 101), ("a" * 100, "a" * 95), ("", ""), ("abc", "abd"), ("x" * 8000, "x" * 7000 + "y" * 700 + "x" * 300)]
    df = spark.createDataFrame(rows, "x string, y string")
    got = [r[0] for r in df.select(line_dedup.near_texts(F.col("x"), F.col("y"), 90)).collect()]
    assert got == [True, False, True, True, False, True]


def varied(rng, n):
    """Pairs of lines (a, b) of about n words: b has as many words replaced, left out and put in as the limit allows."""
    a = [f"w{i}" for i in rng.integers(0, 5000, n)]
    b, limit = list(a), n // 10
    for at in sorted(rng.choice(n, limit, replace=False).tolist(), reverse=True):
        b[at : at + 1] = [["new"], [], ["new", b[at]]][rng.integers(0, 3)]
    return " ".join(a), " ".join(b)


def test_lines_within_the_edit_limit_are_found(spark):
    """Recall of pairs at the limit by length, against the edit limit alone (no hashes)."""
    rng = np.random.default_rng(12)
    made = [(n, *varied(rng, n)) for n in [*range(10, 61), 80, 99, 100, 150, 300] * 4]
    pairs = [(n, k) for k, (n, a, b) in enumerate(made) if near(a, b)]
    df = spark.createDataFrame([(2 * k + i, x) for k, (_, *ab) in enumerate(made) for i, x in enumerate(ab)], "doc_id long, text string")
    gone = {r[0] // 2 for r in line_dedup.deduped(df).where("n_removed > 0").select("doc.doc_id").collect()}
    for low, high in ((10, 19), (20, 39), (40, 300)):
        own = [k for n, k in pairs if low <= n <= high]
        print("recall", low, high, sum(k in gone for k in own), len(own))
        assert sum(k in gone for k in own) >= 0.97 * len(own)


def test_short_lines_with_a_typo(spark):
    lines = ["read the whole story here", "read the whole stroy here", "read the whole storys here", "read the whole tory here", "read a story", "read a stury", "eight words are in this little line now", "eight words are in this litle line now"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r[0] for r in line_dedup.deduped(df).where("n_removed > 0").select("doc.doc_id").collect()}
    assert gone == {2, 3, 7}


def test_lines_without_blanks(spark):
    text = "一行没有空格的很长的文字在这里写着以便比较"
    df = spark.createDataFrame([(0, text), (1, text.replace("长", "短")), (2, text[::-1])], "doc_id long, text string")
    assert [r[0] for r in line_dedup.deduped(df).where("n_removed > 0").select("doc.doc_id").collect()] == [1]


DATA = "/root/testdata/sf0.001/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_real_lines_against_the_edit_limit_alone(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lines = sorted({" ".join(w) for _, t in rows for x in (t or "").split("\n") if (w := words(x))}, key=lambda x: len(x.split()))
    bags, found = [Counter(x.split()) for x in lines], 0
    size = [len(x.split()) for x in lines]
    lost = Counter()
    classes = {}
    own = line_dedup.Lines(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    own.link()
    if own.classes is not None:
        classes = {r.node: r.component for r in own.classes.collect()}
    text = text_of(pa.array(lines))
    w, _, _, first, last = line_dedup.lines_of(text, 1)
    node = line_dedup.nodes_of(*line_dedup._sequence(w, first, last), last - first).view(np.int64).tolist()
    for i in range(len(lines)):
        for j in range(i - 1, -1, -1):
            if size[i] - size[j] > max(1, size[i] // 10):
                break
            if size[i] >= 10 and (bags[i] - bags[j]).total() > size[i] // 10:
                continue
            if near(lines[i], lines[j]):
                found += 1
                lost[size[i] // 20] += classes.get(node[i], node[i]) != classes.get(node[j], node[j])
    print("pairs", found, "lost", dict(lost))
    assert found > 20 and sum(lost.values()) <= 0.03 * found


def test_query_drops_exact_repeats_of_short_lines(spark, tmp_path):
    from tessera.llm.queries import op4_line_dedup

    texts = ["Read more\n一行没有空格的很长的文字" + "字" * 50, "other words\nread MORE!", "一行没有空格的很长的文字" + "字" * 50 + "\n...\n...", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: texts[0], 1: "other words", 2: "...\n...", 3: None}


def families(rng, number, size, words=60, edits=5):
    """Lines of one template each, apart by about twice the edit limit's share."""
    out = []
    for f in range(number):
        base = [f"f{f}w{i}" for i in range(words)]
        for k in range(size):
            w = list(base)
            for at in rng.choice(np.arange(words // 2, words), edits, replace=False).tolist():
                w[at] = f"own{f}x{k}x{at}"
            out.append(" ".join(w))
    return out


def test_no_table_holds_a_row_per_pair_of_a_group(spark, monkeypatch):
    """Lines that share a block but mostly aren't near: joins hold rows by the groups' rows, links rows by classes."""
    lines = families(np.random.default_rng(3), 2, 90)
    docs = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "row long, doc_id long, text string")
    own, asked, verify = line_dedup.Lines(docs), [], line_dedup.Lines._verify
    monkeypatch.setattr(line_dedup.Lines, "_verify", lambda self, pairs: (asked.append(pairs.distinct().count()), verify(self, pairs)))
    own.link()
    assert sum(asked) <= own.groups.count()
    assert own.near is None or own.near.count() <= 2 * len(lines)
    want = brute(list(enumerate(lines)))
    got = line_dedup.deduped(docs.select("doc_id", "text")).select("doc.doc_id", "doc.text", "n_removed").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_edit_distances_in_bands(monkeypatch):
    from tessera.llm import edits

    monkeypatch.setattr(edits, "BANDS", (2,))
    rng = np.random.default_rng(4)
    texts = ["", "a", "xyz"]
    for n in rng.integers(0, 40, 20):
        w = rng.integers(97, 105, int(n)).tolist()
        for _ in range(3):
            for p in rng.integers(0, len(w) + 1, int(rng.integers(0, 5))).tolist():
                w[p : p + int(rng.integers(0, 2))] = [120] * int(rng.integers(0, 2))
            texts.append("".join(map(chr, w)))
    codes, at = edits.flat(texts)
    a, b = np.triu_indices(len(texts), 1)
    true = np.array([distance(texts[i], texts[j]) for i, j in zip(a, b)])
    bits, n = edits.parities(codes, at), np.diff(at)
    assert (np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) + np.abs(n[a] - n[b]) <= 2 * true).all()
    for limit in (0, 1, 3, 7):
        assert (edits.within(codes, at, a, b, np.full(len(a), limit)) == (true <= limit)).all()
    limit = rng.integers(0, 9, len(a))
    assert (edits.within(codes, at, a, b, limit) == (true <= limit)).all()
    some = edits.links(codes, at, np.arange(len(texts)), a, b, true, np.full(len(a), 2))
    assert (true[some] <= 2).all()
    root = {}

    def find(i):
        while root.get(i, i) != i:
            i = root[i]
        return i

    for i, j in zip(a[some].tolist(), b[some].tolist()):
        assert find(i) != find(j)  # a link joins two classes
        root[find(i)] = find(j)
    assert all(find(i) == find(j) for i, j in zip(a[true <= 2].tolist(), b[true <= 2].tolist()))


def test_sketches_are_the_least_distinct_hashes_of_runs():
    rng = np.random.default_rng(8)
    for sizes, vocab in (((36, 36, 90, 400), 10**6), ((36, 5000, 40), 60), ((50,), 1), ((), 5)):
        n = np.array(sizes, np.int64)
        heads = np.cumsum(n) - n
        own = rng.integers(0, vocab, int(n.sum())).astype(np.uint64)
        line, h = line_dedup._least(own, heads, n)
        for i, (a, k) in enumerate(zip(heads.tolist(), n.tolist())):
            runs = line_dedup._hashes(own, np.arange(a, a + k - line_dedup.RUN + 1), line_dedup.RUN)
            assert h[line == i].tolist() == sorted(set(runs.tolist()))[: line_dedup.SKETCH]


@pytest.mark.parametrize("most", [(500_000, 2_000_000), (0, 2_000_000), (0, 0)])
def test_texts_of_points_come_once_however_many_tasks_hold_them(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "MOST_NAMED", most[0])
    monkeypatch.setattr(line_dedup, "MOST_NODES", most[1])
    monkeypatch.setattr(line_dedup, "BITMAP", 20)
    lines = families(np.random.default_rng(5), 1, 30, edits=4)
    texts = [f"{lines[k % 30]}\n{lines[(k + 1) % 30]}\n{lines[k % 30]}\nrow {k} has a line of its own" for k in range(120)]
    docs = spark.createDataFrame([(i, i, x) for i, x in enumerate(texts)], "row long, doc_id long, text string").repartition(8)
    own, made, of = line_dedup.Lines(docs), [], line_dedup.Lines._texts

    def counted(self, nodes):
        out = of(self, nodes)
        found = out[0] if isinstance(out, tuple) else out
        made.append((found.count(), nodes.select("node").distinct().count()))
        return out

    monkeypatch.setattr(line_dedup.Lines, "_texts", counted)
    own.link()
    assert made and all(n == names for n, names in made)
    got = line_dedup.deduped(docs.select("doc_id", "text")).select("doc.doc_id", "doc.text", "n_removed").collect()
    assert sorted(map(tuple, got)) == sorted(brute(list(enumerate(texts))))


def test_bitmap_has_all_its_places(spark):
    rng = np.random.default_rng(2)
    rows = [(int(n), i // 3) for i, n in enumerate(rng.integers(-(2**62), 2**62, 3000))]
    first = spark.createDataFrame(rows, "node long, row long").repartition(3)
    table = line_dedup.bitmap(first, 18)
    node, row = (np.array(x) for x in zip(*rows))
    assert len(table) == 1 << 12 and line_dedup.marked(table, line_dedup.places_of(row, node), 18).all()
    assert line_dedup.marked(table, line_dedup.places_of(row + 5000, node), 18).mean() < 0.01


def test_only_what_the_result_needs_stays_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(line_dedup, "saved", lambda df, name: written.append((name, common.saved(df, name))) or written[-1][1])
    texts = ["one line of some words here that is longer than ten words\nb", "one line of some words here that is longer than ten wordz\nc c c c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = line_dedup.deduped(docs)
    left = {name for name, table in written if id(table) in common._folders}
    assert not left & {"lines", "groups", "near", "classes"} and {"rows", "removed"} <= left
    assert sorted(r.n_removed for r in got.collect()) == [0, 1]
