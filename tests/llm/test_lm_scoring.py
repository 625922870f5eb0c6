import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lm_scoring


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    tongues = [[f"{a}{b}" for a in x for b in x] for x in (["ba", "do", "ki", "lu", "me"], ["str", "ach", "ung", "ei", "ö"])]
    made = [" ".join(rng.choice(tongues[i % 2], int(n)) if n else []) for i, n in enumerate(rng.integers(0, 400, 300))]
    texts = [None, "", " \n", "Word", "neverseen before é.", *made, made[3], "lu" * 3000 + " x" * 5000]
    return [(None if i == 7 else i if i % 40 else 9, t) for i, t in enumerate(texts)]


def test_scores(spark, rows):
    docs = spark.createDataFrame([(d, t, 1.5, "x") for d, t in rows], "doc_id long, text string, score double, block string").repartition(3)
    got = lm_scoring.scored(docs).collect()
    train = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    want = []
    for d, t in rows:
        w = [*words(t), None]
        want.append((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 5)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_of_next_words_add_up():
    """Over the words of the training texts and the end, after the same context; words that are spelled get less than 1 in all."""
    from tessera.llm import attention
    from tessera.llm.tokens import encoder, vocabulary_path

    enc = encoder(vocabulary_path())
    end = enc.tokenizer.get_vocab_size(True)
    train = Counter({"apple": 5, "stone": 2, "wordthatneedsseveralids": 1, "x": 9, None: 4})
    ids_of = lambda w: [end] if w is None else enc.tokenizer.encode(f" {w}", add_special_tokens=False).ids
    counts = np.zeros((end + 1, lm_scoring.BEGINS + 1), np.int64)
    for w, n in train.items():
        for k, i in enumerate(ids_of(w)):
            counts[i, (7 * k) % lm_scoring.BUCKETS] += n
            counts[i, lm_scoring.BEGINS] += n * (k == 0)
    v = lm_scoring.Vocabulary.of(counts, attention.CLASSES)
    rng = np.random.default_rng(3)
    p = attention.initial(rng.normal(size=(attention.CLASSES, attention.CLASSES)) - np.log(attention.CLASSES))
    p["out"] = rng.normal(size=p["out"].shape).astype(np.float32)

    def next_word(w, new):
        words = ["apple", "x", w]
        ids = [ids_of(x) for x in words]
        c = np.array([train[x] for x in words], float)
        return lm_scoring.word_logs(p, v, np.array(sum(ids, [])), np.array([sum(map(len, ids))]), np.array([len(x) for x in ids]), c, sum(train.values()), 0.1, new)[-1]

    assert abs(sum(np.exp(next_word(w, 1e-12)) for w in train) - 1) < 1e-4
    assert sum(np.exp(next_word(w, 0.2)) for w in [*train, "unseen", "words", "also"]) < 1 + 1e-4


DATA = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_trained_model_beats_base_and_untrained_model(spark):
    docs = spark.read.parquet(DATA)
    mean = lambda c, **o: lm_scoring.scored(docs, **o).where("held_out").agg({c: "sum"}).first()[0]
    score = mean("score")
    assert score > mean("base_score", rounds=0) and score > mean("score", rounds=0)


def test_tables_without_text(spark):
    assert lm_scoring.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(99) if lm_scoring.held_out(i))
    got = lm_scoring.scored(spark.createDataFrame([(held, "a b"), (held, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 0, 0), (3, 0, 0)]
    assert all(r.base_score == 0 for r in got)


def test_word_of_more_ids_than_16_bits_count(spark):
    from tessera.llm.tokens import encoder, vocabulary_path

    rng, path = np.random.default_rng(4), vocabulary_path()
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789+/"), 160_000))
    texts = ["some words before", f"in {long} between", "other words after", *(f"word{k} w{k}" for k in range(20))]

    def ids_of(texts):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
        (row,) = lm_scoring.encoded(docs, path).collect()
        ids, lengths, _ = lm_scoring.Block(row.asDict()).texts(np.arange(len(texts)), end)
        return np.split(ids, np.cumsum(lengths)[:-1])

    end = encoder(path).tokenizer.get_vocab_size(True)
    got = ids_of(texts)
    assert len(got[1]) > 1 << 16
    for text, own in zip(texts, got):
        assert own.tolist() == ids_of([text])[0].tolist() == [*encoder(path).tokenizer.encode("".join(f" {w}" for w in words(text)), add_special_tokens=False).ids, end]


def test_training_takes_every_text(spark):
    from tessera.llm import attention
    from tessera.llm.tokens import encoder, vocabulary_path

    path = vocabulary_path()
    end = encoder(path).tokenizer.get_vocab_size(True)
    ids = [i for i in range(40) if not lm_scoring.held_out(i)][:12]
    kinds = spark.sparkContext.broadcast(np.arange(end + 1) % attention.CLASSES)
    start = attention.initial(np.full((attention.CLASSES, attention.CLASSES), -np.log(attention.CLASSES)))

    def model(changed):
        docs = spark.createDataFrame([(d, "green apples fell" if k == changed else "the same words here") for k, d in enumerate(ids)], "doc_id long, text string").coalesce(1)
        return attention.vector(lm_scoring.trained(lm_scoring.encoded(docs, path), kinds, end, start))

    common = model(None)
    assert all(not np.allclose(model(k), common) for k in (0, 1, 2, 5, len(ids) - 1))


def test_row_groups_hold_a_few_blocks(spark, monkeypatch):
    """However many blocks a task writes."""
    import pyarrow.dataset

    from tessera.llm.tokens import vocabulary_path

    monkeypatch.setattr(lm_scoring, "ROW_GROUP_BYTES", 10_000)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 400))) for i in range(60)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        blocks = lm_scoring.encoded(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), vocabulary_path())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    files = [f.removeprefix("file://") for f in blocks.inputFiles()]
    groups = [g.num_rows for f in pyarrow.dataset.dataset(files).get_fragments() for g in f.row_groups]
    assert sum(groups) == blocks.count() == 12 and max(groups) <= 2
