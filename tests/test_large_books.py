"""What a book's steps hold and compute must not grow faster than the book."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import checks, lines, paragraphs, render, translate
from tessera.operators.anchors import numbered_anchors, restored, simplified
from tessera.operators.batches import parts
from tessera.operators.store import Store
from tessera.plans import translation


def plan(df):
    return df._jdf.queryExecution().optimizedPlan()


def test_parts():
    batch = pa.RecordBatch.from_pydict({"k": list(range(6)), "t": ["x" * 4, None, "", "y" * 9, "z", "z"]})
    got = [p.column("k").to_pylist() for p in parts(batch, "t", 3, 6)]
    assert got == [[0, 1, 2], [3], [4, 5]]
    assert list(parts(batch.slice(0, 0), "t")) == [] and [p.num_rows for p in parts(batch.slice(3, 3), "t", 3, 1)] == [1, 1, 1]


@pytest.mark.parametrize("page", ["<p>a</p>\n<p>b\nc</p>\n", "\n" * 3])
def test_paragraphs_leave_python_in_small_batches(page):
    n = 3000
    batch = pa.RecordBatch.from_pydict({"book_id": ["b"] * n, "file_ord": list(range(n)), "html": [page] * n})
    got = list(paragraphs._scan(iter([batch])))
    assert len(got) > 1 and max(x.num_rows for x in got) <= 2048
    rows = [tuple(r.values()) for x in got for r in x.to_pylist()]
    assert rows == [("b", i, *r) for i in range(n) for r in ([(0, 0, 0, "<p>a</p>\n"), (1, 1, 2, "<p>b\nc</p>\n")] if "p" in page else [])]


def test_calls_leave_python_in_order_and_without_pandas(spark):
    chunks = spark.range(3000).select(F.lit("b").alias("book_id"), F.col("id").alias("chunk_id"), F.concat(F.lit("x"), "id").alias("orig"))
    for permits in (1, 3):
        got = translate.translated(chunks, translate.FakeBackend(("none", "error")), permits=permits, partitions=1)
        assert "MapInArrow" in plan(got).toString()
        rows = sorted(got.collect(), key=lambda r: r.chunk_id)
        assert [(r.book_id, r.trans, r.status) for r in rows] == [("b", f"x{i}", "ok") if i % 2 == 0 else ("b", None, "api_error") for i in range(3000)]


def test_a_file_is_split_once_not_once_a_line(spark):
    text = plan(lines.lines(spark.createDataFrame([("b", 0, "a\nb")], "book_id string, file_ord int, html string"))).toString()
    assert "split(" not in text[: text.index("Generate")]


def test_a_block_takes_its_own_reply_before_the_shuffle(spark):
    results = spark.createDataFrame([("b", 0, "<1>x</1><2>y</2>")], "book_id string, chunk_id long, trans string")
    members = spark.createDataFrame([("b", 0, 1, 5), ("b", 0, 3, 6)], "book_id string, chunk_id long, n int, global_idx long")
    blocks = spark.createDataFrame([("b", 5, "o"), ("b", 6, "p")], "book_id string, global_idx long, text string")
    got = checks.parsed(results, members, blocks)
    assert sorted((r.global_idx, r.text) for r in got.collect()) == [(5, "x"), (6, "p")]
    join = plan(got).children().apply(0)
    assert "found" not in join.children().apply(0).output().toString()


def test_blocks_are_numbered_from_stored_rows(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(translation, "numbered_anchors", lambda found: seen.append(plan(found).toString()) or numbered_anchors(found))
    store = Store(spark, f"file://{tmp_path}/book")
    files = spark.createDataFrame([("b", i, f"p{i}.html", "<p>a</p>\n<p>b</p>", None) for i in range(3)], "book_id string, file_ord int, rel_path string, html string, decode_error string")
    translation.prepare(store, files)
    assert len(seen) == 1 and "simplified" not in seen[0] and "parquet" in seen[0]
    assert sorted(r.global_idx for r in store.read("blocks").collect()) == list(range(6))
    assert not store.has("found")


def test_restored_and_simplified_over_parts_and_nulls(spark):
    """More rows than one part, with nulls: the same row by row."""
    rows = spark.range(5000, numPartitions=1).select("id", F.when(F.col("id") % 7 != 3, F.concat(F.lit("<b>x"), "id", F.lit("</b><br/>"))).alias("line"))
    b = rows.select("id", "line", simplified(F.col("line"), F.lit(True)).alias("b"))
    text = F.when(F.col("id") % 5 != 2, F.concat(F.lit("<t9><t1>"), "b.text"))
    mapping = F.when(F.col("id") % 11 != 4, F.col("b.mapping"))
    got = b.select("id", "line", restored(text, mapping, F.col("b.indent"), F.col("b.trailing")).alias("back")).collect()
    for r in got:
        want = None if r.id % 5 == 2 or r.id % 11 == 4 else "\n" if r.line is None else f"<b>x{r.id}</b><br/>\n"
        assert r.back == want, r


def test_rendering_sorts_parts_natively(spark):
    rows = spark.createDataFrame([("b", 0, i, f"{i}\n") for i in (10, 9, 2, 0)], "book_id string, file_ord int, line int, part string")
    got = render._joined(rows.select("book_id", "file_ord", F.struct("line").alias("place"), "part"))
    assert got.first().html == "0\n2\n9\n10\n" and "lambda" not in plan(got).toString()
