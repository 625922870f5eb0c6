"""Queries over the tables of a folder, one per operator of the text pipeline. Pages are the files of one book."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markup
from .functions.replies import reply_content, status, strip_thinking
from .operators import checks, chunks, lines, render, store, translate
from .operators.anchors import anchored, numbered_anchors, restored, tagged
from .operators.paragraphs import found_paragraphs, numbered_paragraphs
from .plans.translation import prepare
from .sources import epub
from .sources.epub import from_pages

FAULTS = ("none", "drop", "swap", "unbalance", "duplicate", "forge", "error")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of fewer splits than cores is dealt over the cores; a larger one is read where it lies."""
    pages, cores = _table(spark, sf_dir, "pages"), spark.sparkContext.defaultParallelism
    return pages.repartition(cores, "page_id") if pages.rdd.getNumPartitions() < cores else pages


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.normalised_files(from_pages(_pages(spark, sf_dir)))


#: Where a local session without spark.checkpoint.dir keeps its books.
_local: list[str] = []


def _store(spark: SparkSession) -> store.Store:
    """A new book store in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tessera-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = f"file://{_local[0]}"
    return store.Store(spark, f"{base.rstrip('/')}/tessera/{spark.sparkContext.applicationId}/book-{uuid.uuid4().hex}")


def _book(spark: SparkSession, sf_dir: str, mode: str = "anchor") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, blocks and chunks, computed once and written to the shared folder, as a translation job does."""
    book = _store(spark)
    found = prepare(book, from_pages(_pages(spark, sf_dir)), mode)
    return book.read("files"), book.read("blocks"), found


def html_normalize(spark, sf_dir):
    return files(spark, sf_dir).select(F.col("file_ord").alias("page_id"), "html")


def text_lines(spark, sf_dir):
    return lines.lines(files(spark, sf_dir)).select(F.col("file_ord").alias("page_id"), F.col("line_idx").cast("long").alias("line_idx"), "line")


def text_blocks(spark, sf_dir):
    return lines.text_lines(files(spark, sf_dir)).select(F.col("file_ord").alias("page_id"), F.col("line_idx").cast("long").alias("line_idx"), "line")


def tag_strip(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", markup.without_tags(F.col("html")).alias("text"))


def readable_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", markup.has_text(F.col("html")).alias("readable"))


def tag_pairs_query(spark, sf_dir):
    rows = lines.text_lines(files(spark, sf_dir))
    return rows.select(F.col("file_ord").alias("page_id"), F.col("line_idx").cast("long").alias("line_idx"), F.posexplode(tagged(F.col("line"))).alias("i", "z")).select("page_id", "line_idx", F.col("i").cast("long").alias("i"), F.col("z.tag").alias("tag"), F.col("z.token").alias("token"))


def tag_simplify(spark, sf_dir):
    found = anchored(files(spark, sf_dir))
    mapping = F.array_join(F.transform("mapping", lambda m: F.concat(m["token"], F.lit("="), m["tag"])), "\x1f")
    return found.select(F.col("file_ord").alias("page_id"), F.col("start_line").cast("long").alias("line_idx"), "text", mapping.alias("mapping"), "indent", F.col("trailing").alias("tail"))


def block_global_index(spark, sf_dir):
    found = numbered_anchors(_store(spark).write("found", anchored(files(spark, sf_dir))))
    return found.select(F.col("file_ord").alias("page_id"), F.col("start_line").cast("long").alias("line_idx"), F.col("block_ord").cast("long").alias("block_ord"), F.col("global_idx").cast("long").alias("global_idx"))


def chunk_anchor(spark, sf_dir):
    found = _chunks(spark, sf_dir)
    return found.select(F.col("file_ord").alias("page_id"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("n_blocks").cast("long").alias("n_blocks"), F.array_join("blocks", ",").alias("blocks"))


def _document_blocks(spark, sf_dir):
    """Documents as files whose lines are blocks."""
    docs = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("book_id"), F.col("doc_id").alias("file_ord"), F.col("text").alias("html"))
    rows = lines.text_lines(docs).select("book_id", "file_ord", "block_ord", F.col("line_idx").alias("start_line"), F.col("line_idx").alias("end_line"), F.concat("line", F.when(F.col("ends"), "\n").otherwise("")).alias("text"))
    return lines.numbered(rows).withColumn("n_chars", F.length("text"))


def chunk_direct(spark, sf_dir):
    found = chunks.chunked(_document_blocks(spark, sf_dir), "direct")
    return found.select(F.col("file_ord").alias("doc_id"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("n_blocks").cast("long").alias("n_blocks"), "orig")


def prompt_render(spark, sf_dir):
    found = _chunks(spark, sf_dir)
    return found.select(F.col("chunk_id").cast("long").alias("chunk_id"), "orig")


def chunk_stats(spark, sf_dir):
    found = chunks.chunk_counts(_chunks(spark, sf_dir))
    return found.select("book_id", F.col("n_chunks").cast("long"), F.col("n_files").cast("long"), F.col("n_blocks").cast("long"))


def _chunks(spark, sf_dir):
    return _book(spark, sf_dir)[2]


def _judged(found, faults=FAULTS):
    """The chunks through the fake backend, with their check; deterministic, so it may be computed more than once."""
    return translate.judged(translate.translated(found, translate.FakeBackend(faults)), found)


def _usable():
    """What goes into an export. Just judged, api_error is the status of failed calls and of no others, so the format check isn't needed for this."""
    return checks.exported(F.col("status"), F.col("trans"))


def translate_identity(spark, sf_dir):
    found = _chunks(spark, sf_dir)
    return translate.translated(found, translate.FakeBackend()).select("chunk_id", "trans", "status")


def validate_format(spark, sf_dir):
    found = _book(spark, sf_dir)[2]
    return _judged(found).select("chunk_id", "trans", F.col("n_blocks").cast("long").alias("n_blocks"), "error_type")


def parse_response(spark, sf_dir):
    _, blocks, found = _book(spark, sf_dir)
    return checks.parsed(_judged(found).where("trans is not null"), chunks.chunk_blocks(found), blocks).select("global_idx", "text")


def revalidate(spark, sf_dir):
    """Stored results checked anew."""
    rows = _judged(_book(spark, sf_dir)[2]).withColumn("error_type", F.when(F.col("error_type") != "api_error", "stale").otherwise(F.col("error_type")))
    return checks.revalidated(rows).select("chunk_id", "error_type")


def backfill_eligible(spark, sf_dir):
    return store.in_book(_judged(_book(spark, sf_dir)[2])).select("chunk_id")


def export_eligible(spark, sf_dir):
    return _judged(_book(spark, sf_dir)[2]).where(_usable()).select("chunk_id")


def blocks_of_chunk(spark, sf_dir):
    _, blocks, found = _book(spark, sf_dir)
    return store.blocks_of(chunks.chunk_blocks(found), blocks, 3).select(F.col("n").cast("long").alias("n"), "global_idx", "preview")


def chunk_detail(spark, sf_dir):
    """The chunk whose reply has a forged anchor."""
    found = _book(spark, sf_dir)[2]
    one = store.chunk_detail(store.reassembled(found.select("book_id", "chunk_id", "orig"), _judged(found).drop("n_blocks")), FAULTS.index("forge"))
    return one.select("chunk_id", "trans", F.array_join(F.array_sort("tokens"), ",").alias("tokens"), F.array_join(F.array_sort("forged"), ",").alias("forged"))


def all_done(spark, sf_dir):
    """Whether nothing is left to translate: with failed calls, and without."""
    found = _book(spark, sf_dir)[2]
    rows = [(kind, store.all_done(found, _judged(found, faults))) for kind, faults in (("faulty", FAULTS), ("whole", ("none",)))]
    return spark.createDataFrame(rows, "kind string, done boolean")


def epub_round_trip(spark, sf_dir):
    """Pages packed as ten books, whose spines run from the last page to the first, and read back."""
    book = (F.col("page_id") % 10).cast("string")
    pages = _pages(spark, sf_dir).select(book.alias("book_id"), "page_id", F.concat(F.lit("text/p"), F.col("page_id"), F.lit(".html")).alias("name"), "html")
    listed = pages.groupBy("book_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("page_id", "name")))).alias("p"))
    item = F.array_join(F.transform("p", lambda x: F.concat(F.lit("<item id='i"), x["page_id"], F.lit("' media-type='application/xhtml+xml' href='"), x["name"], F.lit("'/>"))), "")
    ref = F.array_join(F.transform("p", lambda x: F.concat(F.lit("<itemref idref='i"), x["page_id"], F.lit("'/>"))), "")
    package = F.concat(F.lit("<package xmlns='http://www.idpf.org/2007/opf'><manifest>"), item, F.lit("</manifest><spine>"), ref, F.lit("</spine></package>"))
    container = F.lit("<container><rootfiles><rootfile full-path='book.opf'/></rootfiles></container>")
    fixed = listed.select("book_id", F.explode(F.array(F.struct(F.lit("mimetype").alias("n"), F.lit("application/epub+zip").alias("t")), F.struct(F.lit("META-INF/container.xml").alias("n"), container.alias("t")), F.struct(F.lit("book.opf").alias("n"), package.alias("t")))).alias("m"))
    parts = pages.select("book_id", F.col("name").alias("rel_path"), F.col("html").alias("t")).unionByName(fixed.select("book_id", F.col("m.n").alias("rel_path"), F.col("m.t").alias("t")))
    made = parts.select("book_id", F.concat("book_id", F.lit(".epub")).alias("path"), "rel_path", F.col("t").cast("binary").alias("content"), F.lit(None).cast("int").alias("file_ord"))
    books = epub.packed(made, spark.createDataFrame([], "book_id string, file_ord int, html string"))
    back = epub.content_files(epub.unpacked(books.select("path", F.col("epub").alias("content"))))
    return back.select(F.regexp_extract("rel_path", r"(\d+)", 1).cast("long").alias("page_id"), F.col("file_ord").cast("long").alias("file_ord"), "html")


def restore_line(spark, sf_dir):
    """Each block restored from its own simplified text."""
    found = anchored(files(spark, sf_dir))
    return found.select(F.col("file_ord").alias("page_id"), F.col("start_line").cast("long").alias("line_idx"), restored(F.col("text"), F.col("mapping"), F.col("indent"), F.col("trailing")).alias("line"))


def restore_faulty(spark, sf_dir):
    """Blocks restored from texts with a doubled, a forged and a missing anchor."""
    found = anchored(files(spark, sf_dir))
    text = F.concat(F.regexp_replace("text", "</t1>", ""), F.lit("<s99/><t1>"))
    return found.select(F.col("file_ord").alias("page_id"), F.col("start_line").cast("long").alias("line_idx"), restored(text, F.col("mapping"), F.col("indent"), F.col("trailing")).alias("line"))


def render_replace_identity(spark, sf_dir):
    source, blocks, _ = _book(spark, sf_dir)
    out = render.replaced(source, blocks, blocks.select("book_id", "global_idx", "text"))
    return out.select(F.col("file_ord").alias("page_id"), "html")


def render_bilingual(spark, sf_dir):
    source, blocks, _ = _book(spark, sf_dir)
    out = render.bilingual(source, blocks, blocks.select("book_id", "global_idx", "text"))
    return out.select(F.col("file_ord").alias("page_id"), "html")


def render_translated(spark, sf_dir):
    """The export with faulty replies: what isn't usable keeps its original line."""
    source, blocks, found = _book(spark, sf_dir)
    results = _judged(found)
    usable = results.where(_usable())
    out = render.replaced(source, blocks, checks.parsed(usable, chunks.chunk_blocks(found), blocks))
    return out.select(F.col("file_ord").alias("page_id"), "html")


def paragraph_blocks_query(spark, sf_dir):
    found = numbered_paragraphs(_store(spark).write("found", found_paragraphs(files(spark, sf_dir))))
    return found.select(F.col("file_ord").alias("page_id"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "text", F.col("global_idx").cast("long").alias("global_idx"))


def render_direct(spark, sf_dir):
    """Direct mode through the identity backend."""
    source, blocks, found = _book(spark, sf_dir, "direct")
    results = translate.translated(found, translate.FakeBackend(("fence",)))
    return render.direct(source, blocks, chunks.chunk_blocks(found), results).select(F.col("file_ord").alias("page_id"), "html")


def strip_thinking_query(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>a <cot>b</cot> x"), F.col("text"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>\n\n\n\nrest"))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", strip_thinking(text).alias("text"))


def code_fence_strip(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("```html\n"), F.col("text"), F.lit("\n  ```\n\n"))
    return rows.select("conv_id", "turn", markup.without_fences(text).alias("text"))


def reply_decode(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    message = F.when(F.col("turn") % 4 == 0, F.struct(F.col("text").alias("content"), F.lit(None).cast("string").alias("reasoning_content"))).when(F.col("turn") % 4 == 1, F.struct(F.lit(None).cast("string").alias("content"), F.col("text").alias("reasoning_content")))
    body = F.when(F.col("turn") % 4 == 3, F.col("text")).otherwise(F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices"))))
    found = reply_content(body)
    return rows.select("conv_id", "turn", found["text"].alias("text"), found["status"].alias("status"))


def token_set(spark, sf_dir):
    found = _chunks(spark, sf_dir)
    return found.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.array_join(F.array_sort(markup.tokens(F.col("orig"))), ",").alias("tokens"))


def forged_tokens(spark, sf_dir):
    found = _chunks(spark, sf_dir)
    made = F.concat("orig", F.lit("<t77><s88/>"))
    return found.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.array_join(F.array_sort(markup.forged_tokens(made, F.col("orig"))), ",").alias("forged"))


def _attempts(spark, sf_dir):
    """Conversations as a table of results: a conversation is a chunk, its turns are attempts."""
    rows = _table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 4 == 0, "ok").when(F.col("turn") % 4 == 1, "api_error").when(F.col("turn") % 4 == 2, "line_count_mismatch").otherwise("unbalanced_internal_t1")
    return rows.select(F.lit("c").alias("book_id"), F.col("conv_id").alias("chunk_id"), F.col("turn").cast("int").alias("attempt"), F.when(kind != "api_error", F.col("text")).alias("trans"), F.when(kind == "api_error", "api_error").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("error"), kind.alias("error_type"))


def latest_result(spark, sf_dir):
    return store.latest(_attempts(spark, sf_dir)).select("chunk_id", F.col("attempt").cast("long").alias("attempt"), "trans", "error_type")


def _reassembled(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.lit("c").alias("book_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("orig"))
    return store.reassembled(docs, store.latest(_attempts(spark, sf_dir)))


def reassemble(spark, sf_dir):
    return _reassembled(spark, sf_dir).select("chunk_id", "trans", "is_error")


def resume_pending(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.lit("c").alias("book_id"), F.col("doc_id").alias("chunk_id"))
    return store.pending(docs, store.latest(_attempts(spark, sf_dir))).select("chunk_id")


def status_filter(spark, sf_dir):
    return store.with_status(_reassembled(spark, sf_dir), "error").select("chunk_id", status(F.col("error_type"), F.col("trans")).alias("status"))


def status_counts(spark, sf_dir):
    return store.progress(_reassembled(spark, sf_dir)).select("status", "n")


def keyword_search(spark, sf_dir):
    return store.matching(store.with_status(_reassembled(spark, sf_dir), "translated"), "  The ").select("chunk_id")


def chunk_list(spark, sf_dir):
    return store.listed(_reassembled(spark, sf_dir)).select("chunk_id", "status", "preview")


def preview(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", markup.preview(F.col("text")).alias("short"), markup.preview(F.col("text"), 100, "").alias("long"))


def history_topk(spark, sf_dir):
    """Events as saved settings: the newest per (user, type), the ten newest of those."""
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("api_key"), F.col("event_type").alias("api_url"), F.struct("ts", "event_id").alias("saved_at"))
    return store.settings_history(rows).select("api_key", "api_url", F.col("saved_at.event_id").alias("event_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "html_normalize": html_normalize, "text_lines": text_lines, "text_blocks": text_blocks, "tag_strip": tag_strip, "readable_pages": readable_pages,
    "tag_pairs": tag_pairs_query, "tag_simplify": tag_simplify, "block_global_index": block_global_index, "chunk_anchor": chunk_anchor, "chunk_direct": chunk_direct,
    "prompt_render": prompt_render, "chunk_stats": chunk_stats, "translate_identity": translate_identity, "validate_format": validate_format, "parse_response": parse_response,
    "restore_line": restore_line, "restore_faulty": restore_faulty, "render_replace_identity": render_replace_identity, "render_bilingual": render_bilingual, "render_translated": render_translated,
    "paragraph_blocks": paragraph_blocks_query, "render_direct": render_direct, "strip_thinking": strip_thinking_query, "code_fence_strip": code_fence_strip, "reply_decode": reply_decode,
    "token_set": token_set, "forged_tokens": forged_tokens, "latest_result": latest_result, "reassemble": reassemble, "resume_pending": resume_pending, "status_filter": status_filter,
    "revalidate": revalidate, "backfill_eligible": backfill_eligible, "export_eligible": export_eligible, "blocks_of_chunk": blocks_of_chunk, "chunk_detail": chunk_detail,
    "all_done": all_done, "epub_round_trip": epub_round_trip,
    "status_counts": status_counts, "keyword_search": keyword_search, "chunk_list": chunk_list, "preview": preview, "history_topk": history_topk,
}
