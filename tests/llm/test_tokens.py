import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_files
from tessera.llm.common import text_of
from tessera.llm.packing import Plan, packed
from tessera.llm.tokens import Encoder, vocabulary_path

ODD = ["a  b", "a   b\n\n c \n d", "x\n\n\ny", "it's 'll\n's", " lead", "trail ", "\n\nq", "a\tb \t c", "é <|endoftext|> b", "", None, " ", "a\x01 b", "a\xa0 b", "don't 12 3\n4", "word. " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def exact(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_memo_gives_the_library_ids(library):
    rng = np.random.default_rng(4)
    marks = ["a", "Bé", "é", "\n", " ", ".", ",", "'s", "3", "\t", "\xa0", "“", "\u3000", "\x1c", "漢", "<|endoftext|>", "-", "it's", " the"]
    made = ["".join(rng.choice(marks, int(n), p=[0.12] * 5 + [0.4 / 14] * 14)) for n in rng.integers(0, 40, 400)]
    for enc in (Encoder(vocabulary_path()), Encoder(vocabulary_path(), memo=1)):
        for texts in (ODD, made, [], [None], made):
            ids, off = enc.encode(text_of(pa.array(texts, pa.string())))
            assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [exact(library, t) for t in texts]
            ids, off = enc.encode(text_of(pa.array(texts, pa.string())), 7)
            assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [[*exact(library, t), 7] for t in texts]


def rows(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)], "doc_id long, text string, start string, part string")


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.tile(rng.integers(0, 50, 40), 60), rng.integers(0, 50257, 3000), np.zeros(500, int), [2]]).astype(np.uint32)
    ends = np.array([1, 2, 700, 2401, len(ids)])
    shard = token_files.Shard(token_files.Shard.packed([5, None, 7, 8, 9], ids, ends, 50257))
    assert len(shard.symbols) < len(ids) and len(shard.rules)
    assert shard.ids().tolist() == ids.tolist()
    begins = [0, *ends[:-1]]
    for i, (a, b) in enumerate(zip(begins, ends)):
        assert shard.document(i).tolist() == ids[a:b].tolist()
        for lo, hi in ((0, 1), (3, 90), (b - a - 1, b - a), (5, 5)):
            assert shard.document(i, lo, hi).tolist() == ids[a:b][lo:hi].tolist()
    assert shard._flat is not None
    fresh = token_files.Shard(token_files.Shard.packed([5, None, 7, 8, 9], ids, ends, 50257))
    assert fresh.document(3, 5, 600).tolist() == ids[700:2401][5:600].tolist() and fresh._flat is None  # no expansion of the whole grammar
    assert shard.known.tolist() == [True, False, True, True, True]
    with pytest.raises(ValueError):
        token_files.Shard(token_files.Shard.packed([5], ids[:9], np.array([9]), 50257)[:-1])


@pytest.mark.parametrize("kinds", [1, 2, 3, 40])
def test_grammar_leaves_no_frequent_pair(kinds):
    rng = np.random.default_rng(kinds)
    for n in (0, 1, 2, 3, 24, 25, 999):
        ids = np.repeat(rng.integers(0, kinds, n), rng.integers(1, 6, n)).astype(np.uint32)
        ends = np.unique(np.append(rng.integers(1, len(ids) + 1, 5 if len(ids) else 0), len(ids)))
        ends = ends[ends > 0]
        symbols, rules, symbol_ends = token_files.compressed(ids, ends, 50)
        spelled = {s: [s] for s in range(50)}
        for k, (a, b) in enumerate(rules.tolist()):
            spelled[50 + k] = spelled[a] + spelled[b]
        begins = [0, *symbol_ends[:-1]]
        got = [[x for s in symbols[a:b].tolist() for x in spelled[s]] for a, b in zip(begins, symbol_ends)]
        assert got == [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
        left = {}
        for a, b in zip(begins, symbol_ends):
            i = a
            while i + 1 < b:
                pair = symbols[i], symbols[i + 1]
                left[pair] = left.get(pair, 0) + 1
                i += 2 if pair[0] == pair[1] and i + 2 < b and symbols[i + 2] == pair[0] else 1
        assert max(left.values(), default=0) < 12


def test_token_files_against_the_library(spark, library):
    texts = [*ODD, "same", "same"]
    got = token_files.token_files(rows(spark, texts, [100 - i for i in range(len(texts) - 2)] + [3, 3]).repartition(3), shard_ids=2000).orderBy("start").collect()
    start = 0
    want = sorted(zip([100 - i for i in range(len(ODD))] + [3, 3], texts), key=lambda x: x[0])
    assert len(got) == len(want)
    for r, (i, t) in zip(got, want):
        ids = np.array([*exact(library, t), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_nothing(spark):
    assert token_files.token_files(rows(spark, [])).count() == 0
    got = token_files.token_files(rows(spark, ["b", None], [None, 1])).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 2), (1, 1)]


def check_packing(got, texts, library, size=1024):
    want = {i: np.array([*exact(library, t), 0], "<u4") for i, t in enumerate(texts)}
    by_seq, by_doc = {}, {}
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length > 0 and r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(want[r.doc_id])
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
    for spans in (*by_seq.values(), *by_doc.values()):
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
    assert {i: sum(n for _, n in x) for i, x in by_doc.items()} == {i: len(x) for i, x in want.items()}
    used = [sum(n for _, n in x) for x in by_seq.values()]
    assert max(used, default=0) <= size and all(u == size or u & (u - 1) == 0 for u in used)


def test_packing_places_each_id_once_without_padding(spark, library):
    rng = np.random.default_rng(3)
    texts = [*ODD, *("w " * int(n) for n in rng.integers(1, 3000, 60)), *["same text"] * 40]
    check_packing(packed(rows(spark, texts).repartition(3)).collect(), texts, library)
    check_packing(packed(rows(spark, ["only"])).collect(), ["only"], library)
    assert packed(rows(spark, [])).count() == 0


def test_plan_uses_combinations():
    plan = Plan({300: 50, 724: 30, 362: 20, 1024: 4, 7: 3})
    assert plan.planned[724] == 30 and plan.planned[300] == 40
    spots = [plan.place(n, r) for n, k in {300: 50, 724: 30, 362: 20, 1024: 4, 7: 3}.items() for r in range(k)]
    cells = {}
    for (n, r), spot in zip([(n, r) for n, k in {300: 50, 724: 30, 362: 20, 1024: 4, 7: 3}.items() for r in range(k)], spots):
        assert spot[0][0] == 0 and spot[-1][1] == n
        for a, b, s, o in spot:
            for x in range(o, o + b - a):
                assert (s, x) not in cells
                cells[s, x] = n
