import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontamination as d


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=4), min_size=1, max_size=8))
def test_index_finds_all_occurrences(seq, patterns):
    seq = np.array([*seq, 0])
    index = d.FMIndex(seq, 4)
    rows = np.array([[0] * (4 - len(p)) + p for p in patterns])
    lo, hi = index.search(rows, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo, hi):
        want = [i for i in range(len(seq)) if seq[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(texts, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    wins = [(i, tuple(w[k : k + min(window, len(w))])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - window + 1))]
    for t in texts:
        w = words(t)
        hit, got = set(), set()
        for i, p in wins:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    got.add(str(i))
        out.append((len(w), len(hit), sorted(got)))
    return out


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(5)
    vocab = ["alpha", "Beta", "gämma", "delta", "e", "zeta9"]
    item = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(1, 30, 12)]
    items = [*enumerate(item), (100, None), (101, " .,! "), (102, "two words"), (103, item[0])]
    texts = [None, "", "...", "Two, words", "x" * 50, *(" ".join([*rng.choice(vocab, 8), rng.choice(item), "unknown", *rng.choice(vocab, 9)]) for _ in range(40)), item[3], item[3]]
    texts.append("filler " * 20000 + item[2].upper().replace(" ", "--"))
    return texts, items


def test_found_and_cleaned_against_brute_force(spark, cases):
    texts, items = cases
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, items int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    for options in ({}, {"shard_bytes": 200, "block_chars": 60}):
        got = {r.doc_id: r for r in d.found(docs, bench, **options).collect()}
        assert len(got) == len(texts)
        for i, w in enumerate(want):
            assert (got[i].n_words, got[i].n_hit, sorted(got[i]["items"])) == w
            inside = brute(["\n".join(texts[i][s.start : s.end] for s in got[i].spans)], [])[0][0] if texts[i] else 0
            assert inside == w[1]
    rows = d.cleaned(docs, bench, shard_bytes=300).collect()
    assert len(rows) == len(texts) and all(r["items"] == 5 for r in rows)
    assert all(n == 0 for _, n, _ in brute([r.text for r in rows], items))
    assert all(r.text == texts[r.doc_id] for r in rows if want[r.doc_id][1] == 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.found(docs, bench).count() == 0 and d.cleaned(docs, bench).count() == 0
    one = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in d.found(one, bench).collect()] == [(None, 2, 0, [])]
