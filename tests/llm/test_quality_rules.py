import re

from tessera.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    twice = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), len(lines)


TEXTS = [None, "", "  \n\t", "one", "a b", "a b c a b c", "a b c d a b c x a b c d", "x x x x", "é\x0bü\fß # * | <a>\n\nq\nq\n q", "w " * 30000, "a\n" * 9, " lead\xa0one two\x1cthree ", "v" + "".join(f" v{i}" for i in range(60))]


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(i % 5, t, "h", 1) for i, t in enumerate(TEXTS)], "doc_id int, text string, source string, n_words int")
    got = q.judged(docs, columns=["text", "n_words"]).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert tuple(r.m) == brute(r.row.text)
        assert r.base_failed == (r.m.n_words < 50 or 2 * r.m.n_repeat_words > r.m.n_words)
        assert r.row.n_words == 1


def test_bad_host_only_loses_documents_that_fail_a_soft_rule(spark):
    good = " ".join(f"word{i}" for i in range(80))
    bad = good + " ###" * 10
    rows = [(i, bad if i < 9 else good, "spam") for i in range(10)] + [(100 + i, good if i else bad, f"h{i % 3}") for i in range(40)] + [(999, good, None), (999, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = q.kept(docs)
    assert left.columns == docs.columns
    many = q.kept(docs, most_hosts=2)  # rates joined by host and salt
    assert sorted(r.doc_id for r in many.collect()) == sorted(r.doc_id for r in left.collect()) and "Broadcast" not in many._jdf.queryExecution().sparkPlan().toString()
    ids = sorted(r.doc_id for r in left.collect())
    assert ids == sorted([9, *range(100, 140), 999, 999])
    only = spark.createDataFrame([(1, bad, "a"), (2, good, "a")], docs.schema)
    assert q.kept(only).count() in (1, 2)


def test_empty(spark):
    assert q.kept(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
