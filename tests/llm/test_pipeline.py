import os

import numpy as np
import test_decontamination
import test_line_dedup
import test_ngram_join
import test_quality_rules
import test_tokens
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import common
from tessera.llm.tokens import vocabulary_path


def corpus():
    rng = np.random.default_rng(9)
    vocab = [f"word{i}" for i in range(300)]
    base = ["\n".join(" ".join(rng.choice(vocab, 12)) for _ in range(6)) for _ in range(15)]
    items = [" ".join(rng.choice(vocab, 14)) for _ in range(3)]
    texts = [None, "", "short", *base, base[0], base[1].replace("word1", "w1", 1), "\n".join([*base[2].split("\n")[:5], " ".join(rng.choice(vocab, 40))])]
    texts += [" ".join([*rng.choice(vocab, 40), x, *rng.choice(vocab, 40)]) for x in items]
    whole = rng.choice(vocab, 80).tolist()
    wrapped = base[4].split()
    texts += [" ".join(whole), " ".join([*whole[:-1], "other"]), "a b c " * 60, "\n".join(" ".join(wrapped[i : i + 20]) for i in range(0, len(wrapped), 20))]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], list(enumerate(items))


def test_each_stage_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[k] = ({r.doc_id: r.text for r in before.collect()}, docs.collect())
    after = lambda k: {r.doc_id: r.text for r in seen[k][1]}

    fine = {i: t for i, t in seen[0][0].items() if (m := test_quality_rules.brute(t))[0] >= 50 and 2 * m[4] <= m[0]}
    assert after(0) == fine and len(fine) < len(rows)
    before = sorted(seen[1][0].items())
    want = {d: t for d, t, n in test_line_dedup.brute(before) if not n or t.strip()}
    assert after(1) == want and want != seen[1][0]
    before = sorted(seen[2][0].items())
    own = test_ngram_join.brute(before)
    assert sorted(after(2)) == sorted({c for _, n, c in own if n}) and len(after(2)) < len(before)
    texts = list(after(3).values())
    assert all(n == 0 for _, n, _ in test_decontamination.brute(texts, items))
    hits = dict(zip(seen[3][0], test_decontamination.brute(list(seen[3][0].values()), items)))
    assert any(h[1] for h in hits.values())
    assert all(after(3)[i] == t for i, t in seen[3][0].items() if not hits[i][1])
    assert all(r.n_chars == len(r.text) for r in seen[3][1])
    ids = list(seen[4][0])
    got = [r for r in seen[4][1]]
    renumbered = [type("R", (), {**r.asDict(), "doc_id": ids.index(r.doc_id)}) for r in got]
    test_tokens.check_packing(renumbered, list(seen[4][0].values()), Tokenizer.from_file(vocabulary_path()))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)


def test_stages_delete_what_the_one_before_has_left(spark, tmp_path):
    """But nothing that their documents are read from."""
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, (quality, lines) = spark.read.parquet(f"{tmp_path}/documents.parquet"), [f for _, f in corpus_pipeline.STAGES[:2]]
    there = lambda folders: [os.path.exists(x.removeprefix("file://")) for x in folders]
    with common.recorded() as lazy:
        kept = quality(spark, docs, str(tmp_path))
    want = lines(spark, kept, str(tmp_path)).count()
    assert lazy and all(there(lazy))
    with common.recorded() as stored:
        quality(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/0")
    assert all(there(lazy)) and all(there(stored))
    assert lines(spark, spark.read.parquet(f"{tmp_path}/0"), str(tmp_path)).count() == want
    assert not any(there(stored)) and all(there(lazy))
