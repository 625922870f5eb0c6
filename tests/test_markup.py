import json
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.functions.replies import reply_content, status, without_thinking
from tessera.operators import checks, chunks, lines, paragraphs, render, store, translate
from tessera.operators.anchors import anchor_blocks, restored, simplified


def one(spark, value, column, *more):
    kinds = ", ".join(f"c{i} string" for i in range(1 + len(more)))
    return spark.createDataFrame([(value, *more)], kinds).select(column.alias("x")).first()["x"]


def files(spark, *html):
    return spark.createDataFrame([("b", i, f"f{i}.html", h, None) for i, h in enumerate(html)], "book_id string, file_ord long, rel_path string, html string, decode_error string")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a</p><p>b</p>", "<p>a</p>\n<p>b</p>\n"),
        ("<div><p>a</p></div>", "<div>\n<p>a</p>\n</div>\n"),
        ("a<br/><br/>b", "a<br/>\n<br/>\nb"),
        ("a\n\n 　 \n\n\nb", "a\n\nb"),
        ("\n\n<P CLASS='x'>a</P>", "<P CLASS='x'>a</P>\n"),
        ("<pre>x</pre><span>y</span>", "<pre>x</pre>\n<span>y</span>"),
        ("", ""),
    ],
)
def test_normalise(spark, html, want):
    got = one(spark, html, markup.normalised(F.col("c0")))
    assert got == want
    assert one(spark, got, markup.normalised(F.col("c0"))) == got


@pytest.mark.parametrize(("line", "want"), [("<b>a</b>", True), ("漢", True), ("かカ", True), ("한", True), ("Ж", True), ("é", True), ("αβ", False), ("عربي", False), ("…—", False), ("×", True), ("&nbsp;", True), ("<img alt='a'/>", False), ("<!-- a -->", False), ("<?xml a?>", False), ("<!DOCTYPE html>", False), ("<1>", False)])
def test_readable(spark, line, want):
    assert one(spark, line, markup.has_text(F.col("c0"))) is want
    assert paragraphs.readable(line) is want


CASES = [
    ("I <b>am</b> here", "I <t1>am</t1> here", ["<t1>=<b>", "</t1>=</b>"]),
    ("<b><i>x</b></i>", "<t1><t2>x</t1></t2>", ["<t1>=<b>", "</t1>=</b>", "<t2>=<i>", "</t2>=</i>"]),
    ("x</b> <b>y", "x<s1/> <s2/>y", ["<s1/>=</b>", "<s2/>=<b>"]),
    ("<b>a<b>b</b>", "<s1/>a<t1>b</t1>", ["<s1/>=<b>", "<t1>=<b>", "</t1>=</b>"]),
    ("a<br>b<img src='x'/>c<!-- n --><?q?>", "a<s1/>b<s2/>c<s3/><s4/>", ["<s1/>=<br>", "<s2/>=<img src='x'/>", "<s3/>=<!-- n -->", "<s4/>=<?q?>"]),
    ("  <1>x</1>\t", "<t1>x</t1>", ["<t1>=<1>", "</t1>=</1>"]),
    ("plain", "plain", []),
]


@pytest.mark.parametrize(("line", "text", "mapping"), CASES)
def test_simplify_and_restore(spark, line, text, mapping):
    df = spark.createDataFrame([(line, True)], "line string, ends boolean").select("line", simplified(F.col("line"), F.col("ends")).alias("b"))
    row = df.select("b", restored(F.col("b.text"), F.col("b.mapping"), F.col("b.indent"), F.col("b.trailing")).alias("back")).first()
    assert row.b.text == text and [f"{m.token}={m.tag}" for m in row.b.mapping] == mapping
    assert row.back == line + "\n"


def stack(line):
    """A plain simulation with a stack per name."""
    tags = re.findall(r"</?[a-z]+/?>", line)
    open_, pairs = {}, {}
    for i, t in enumerate(tags):
        name = t.strip("</>")
        if t.endswith("/>"):
            continue
        if t.startswith("</"):
            if open_.get(name):
                pairs[open_[name].pop()] = i
        else:
            open_.setdefault(name, []).append(i)
    out, t_no, s_no = [None] * len(tags), 0, 0
    for i in range(len(tags)):
        if i in pairs:
            t_no += 1
            out[i], out[pairs[i]] = f"<t{t_no}>", f"</t{t_no}>"
        elif out[i] is None:
            s_no += 1
            out[i] = f"<s{s_no}/>"
    return "x".join(["", *out, ""])


def test_pairing_matches_a_stack(spark):
    import random

    rnd = random.Random(4)
    made = ["x".join(["", *(rnd.choice(["<a>", "</a>", "<b>", "</b>", "<c/>"]) for _ in range(rnd.randint(0, 9))), ""]) for _ in range(400)]
    rows = spark.createDataFrame([(x, False) for x in made], "line string, ends boolean")
    for r in rows.select("line", simplified(F.col("line"), F.col("ends"))["text"].alias("t")).collect():
        assert r.t == stack(r.line)


@pytest.mark.parametrize(("text", "want"), [("<t1>a</t1><t1>b", "<b>a</b>b"), ("a<t9>", "a<b></b>"), ("</t1>a", "</b>a<b>"), ("<t<t9>1>", "<b><b></b>")])
def test_restore_repairs(spark, text, want):
    mapping = F.array(*(F.struct(F.lit(a).alias("token"), F.lit(b).alias("tag")) for a, b in (("<t1>", "<b>"), ("</t1>", "</b>"))))
    assert one(spark, text, restored(F.col("c0"), mapping, F.lit(" "), F.lit("\n"))) == f" {want}\n"


@pytest.mark.parametrize(
    ("text", "n", "want"),
    [
        ("<1>a</1>\n<2>b\nc</2>", 2, "ok"), ("<1>a</1>", 2, "line_count_mismatch"), ("<2>a</2>\n<1>b</1>", 2, "index_mismatch_at_2_expected_1"), ("<1>a</1><1>b</1>", 2, "index_mismatch_at_1_expected_2"),
        ("<1><t1>a</1>", 1, "unbalanced_internal_t1"), ("<1><t10>a<t2>b</1>", 1, "unbalanced_internal_t2"), ("<1>a</t1></1>", 1, "ok"), ("<1>a<s3/></1>", 1, "ok"), ("<01>a</01>", 1, "ok"), ("", 0, "ok"), ("<1><t1>a</1><3>x</3>", 2, "unbalanced_internal_t1"),
    ],
)
def test_format_check(spark, text, n, want):
    assert one(spark, text, checks.anchored_format(F.col("c0"), F.lit(n))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<think>a</think>b", "b"), ("<think>a <cot>b</cot> x", "<think>a <cot>b</cot> x"), ("<think>a<cot>b</cot></think>c", "c"), ("<THINK x='1'>a</think>\n\n\n\nb\n\n", "b"),
        ("a<think>b</think><cot>c", "a<cot>c"), ("<th<think>x</think>ink>y</think>z", "z"), ("", ""), (None, None), ("a\n \n \n\nb", "a\n\nb"),
    ],
)
def test_thinking(text, want):
    assert without_thinking(text) == want
    assert without_thinking("a<think>b", partial=True) == "a"


def test_fences(spark):
    got = lambda t: one(spark, t, markup.without_fences(F.col("c0")))
    assert got("```html\n  <p>a</p>\n```\n") == "  <p>a</p>"
    assert got("a\n 　``` \nb") == "a\nb"
    assert got("\n\r\n x \n\n") == " x "


def test_chunk_folds(spark):
    sizes = F.array(*map(F.lit, [400, 400, 400, 1200, 10, 990]))
    assert one(spark, "", chunks.closing_chunks(F.slice(sizes, 1, 5), 1000)) == [0, 3, 4]
    assert one(spark, "", chunks.bounded_chunks(sizes, 1000)) == [0, 2, 3, 4]


def test_lines_and_numbers(spark):
    rows = lines.lines(files(spark, "a\n\nb", "", "c\n", " \x0c\n")).orderBy("file_ord", "line_idx").collect()
    assert [(r.file_ord, r.line_idx, r.line, r.ends) for r in rows] == [(0, 0, "a", True), (0, 1, "", True), (0, 2, "b", False), (2, 0, "c", True), (3, 0, " \x0c", True)]
    found = anchor_blocks(files(spark, "a\n\nb", "-", "c\nd\n")).orderBy("global_idx").collect()
    assert [(r.file_ord, r.block_ord, r.global_idx, r.start_line) for r in found] == [(0, 0, 0, 0), (0, 1, 1, 2), (2, 0, 2, 0), (2, 1, 3, 1)]


def test_paragraph_ranges():
    lines_ = ["<div>", "<p>a", "b</p>", "c", "<li>d</li>", "<p>open", "<h1>e</h1>", "--", "<blockquote>", "<li>f</li>", "</blockquote>"]
    assert paragraphs.paragraph_ranges(lines_) == [(1, 2), (3, 3), (4, 4), (5, 5), (6, 6), (8, 10)]


def test_reply_decoding(spark):
    got = lambda t: tuple(one(spark, t, reply_content(F.col("c0"))))[:2]
    body = lambda m: json.dumps({"choices": [{"message": m}]})
    assert got(body({"content": "a"})) == ("a", "ok")
    assert got(body({"content": None, "reasoning_content": "r"})) == ("r", "ok")
    assert got(body({})) == (None, "api_error")
    assert got("plain") == (None, "api_error") == got(json.dumps({"choices": []}))


def test_rate_limiter():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    limiter = translate.RateLimiter(10, 2, lambda: now[0], sleep)
    for _ in range(5):
        limiter.acquire()
    assert waits == [10, 10]
    translate.RateLimiter(0, 2, sleep=sleep).acquire()
    assert len(waits) == 2


def test_chat_backend_falls_back_and_decodes():
    seen = []

    def post(url, body, headers, timeout):
        seen.append(body.get("thinking"))
        if "thinking" in body:
            return 400, "text/plain", "BadRequest"
        return 200, "application/json", json.dumps({"choices": [{"message": {"content": "<think>x</think>ok"}}]})

    backend = translate.ChatBackend("http://h/v1", "m", lambda: "k", "s", post=post)
    assert backend(0, "t") == "ok" == backend(1, "t")
    assert seen == [{"type": "disabled"}, "disabled", None, None]
    bad = translate.ChatBackend("http://h/v1", "m", lambda: "k", "s", post=lambda *a: (200, "text/html", "<html>"))
    with pytest.raises(translate.ReplyError):
        bad(0, "t")


def test_direct_render_deals_lines(spark):
    source = files(spark, "<div>\n<p>a\nb</p>\n<p>c</p>\n</div>")
    blocks = paragraphs.paragraph_blocks(source)
    found = chunks.chunked(blocks, "direct")
    for reply, want in {"A\nB\nC": "<div>\nA\nB\nC\n</div>", "A\nB\nC\nD\n": "<div>\nA\nB\nC\nD\n</div>", "A": "<div>\nA\n\n</div>", "```\nA\nB\n```": "<div>\nA\nB\n\n</div>"}.items():
        results = spark.createDataFrame([("b", 0, reply)], "book_id string, chunk_id long, trans string")
        assert render.direct(source, blocks, chunks.chunk_blocks(found), results).first()["html"] == want


def test_bilingual_after_a_last_line(spark):
    source = files(spark, "a\n-\nb")
    blocks = anchor_blocks(source)
    out = render.bilingual(source, blocks, blocks.select("book_id", "global_idx", F.upper("text").alias("text")))
    assert out.first()["html"] == "a\nA\n-\nb\nB"


def test_revalidation_status_and_search(spark):
    rows = spark.createDataFrame([("b", 0, "<1>x</1>", "<1>y</1>", 1, None), ("b", 1, "o", "", 1, "api_error"), ("b", 2, "o", "[API错误] t", 1, None), ("b", 3, "The %", "<1>y", 1, None), ("b", 4, "o", "t", 1, "api_error")], "book_id string, chunk_id long, orig string, trans string, n_blocks int, error_type string")
    got = checks.revalidated(rows)
    assert [r.error_type for r in got.orderBy("chunk_id").collect()] == ["ok", None, "api_error", "line_count_mismatch", "api_error"]
    assert [r.s for r in got.orderBy("chunk_id").select(status(F.col("error_type"), F.col("trans")).alias("s")).collect()] == ["已翻译", "未翻译", "API错误", "格式错误", "API错误"]
    assert [r.chunk_id for r in store.matching(rows, " the ", "orig").collect()] == [3] == [r.chunk_id for r in store.matching(rows, "%").collect()]
    assert store.matching(rows, "  ").count() == 5


def test_settings(spark):
    rows = spark.createDataFrame([(f"k{i % 12}", "u", i) for i in range(30)], "api_key string, api_url string, saved_at int")
    assert [r.saved_at for r in store.settings_history(rows).collect()] == list(range(29, 19, -1))
    assert store.loaded_settings(spark, "{broken").count() == 0
    assert store.loaded_settings(spark, '{"history": [{"api_key": "k", "chunk_size": 500}]}').first()["chunk_size"] == 500


def test_settings_round_trip(spark):
    rows = spark.createDataFrame([("k", "u", "m", 0.7, 1)], "api_key string, api_url string, model string, temp double, saved_at int")
    text = store.settings_text(store.settings_history(rows), output_dir="out")
    assert json.loads(text)["output_dir"] == "out" and store.loaded_settings(spark, text).first()["model"] == "m"


def test_direct_lines(spark):
    got = one(spark, " \u3000<b>a</b>\t", paragraphs.plain_simplified(F.col("c0")))
    assert tuple(got) == ("<b>a</b>", " \u3000", "\t")
    assert one(spark, "x", paragraphs.plain_restored(F.col("c0"), F.lit(" "), F.lit("\n"))) == " x\n" and one(spark, "", paragraphs.plain_restored(F.col("c0"), F.lit(" "), F.lit("\n"))) == ""
