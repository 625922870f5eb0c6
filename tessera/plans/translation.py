"""The three jobs on a book store: prepare, translate, export. Each writes tables and leaves everything between to the planner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.anchors import anchored, numbered_anchors
from ..operators.checks import exported, parsed
from ..operators.chunks import CHUNK_CHARS, chunk_blocks, chunked
from ..operators.lines import normalised_files
from ..operators.paragraphs import found_paragraphs, numbered_paragraphs
from ..operators.render import bilingual, direct, replaced
from ..operators.store import VERSION, Store, pending
from ..operators.translate import judged, translated


def prepare(store: Store, files: DataFrame, mode: str = "anchor", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Files (book_id, file_ord, rel_path, html, decode_error) to stored files, blocks and chunks; files that can't be decoded are kept with their error and give no blocks."""
    files = store.write("files", normalised_files(files))
    good = files.where("html is not null")
    # found once and stored, then numbered: the numbers read the rows twice more
    found = store.write("found", anchored(good) if mode == "anchor" else found_paragraphs(good))
    blocks = store.write("blocks", numbered_anchors(found) if mode == "anchor" else numbered_paragraphs(found))
    store.purge("found")
    chunks = store.write("chunks", chunked(blocks, mode, chunk_chars))
    books = files.select("book_id").distinct().select("book_id", F.lit(mode).alias("mode"), F.lit(VERSION).alias("version"))
    store.write("books", books)
    return chunks


def translate(store: Store, backend: Callable[[int, str], str], *, mode: str = "anchor", targets: DataFrame | None = None, interval: float = 0, permits: int = 1, partitions: int | None = None, group: str | None = None) -> DataFrame:
    """Translates what is pending (or the targets) and appends the results. A stopped job (cancelJobGroup) is resumed by calling this again."""
    spark = store.spark
    if group:
        spark.sparkContext.setJobGroup(group, "translation", interruptOnCancel=True)
    chunks = store.read("chunks")
    todo = pending(chunks, store.results(), targets)
    rows = translated(todo, backend, interval=interval, permits=permits, partitions=partitions)
    # calls are made once: their results are stored before the check and the join read them
    raw = store.write("calls", rows, "overwrite")
    store.append(judged(raw, chunks, mode).drop("n_blocks"))
    store.purge("calls")
    return store.results()


def stop(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def export(store: Store, kind: str = "translated", mode: str = "anchor", faulty: bool = True) -> DataFrame:
    """(book_id, file_ord, html) of the translated or bilingual book. faulty: results of a wrong format count too; failed calls never do."""
    files, blocks, chunks = (store.read(t) for t in ("files", "blocks", "chunks"))
    good = files.where("html is not null")
    usable = exported(F.col("error_type"), F.col("trans"))
    results = store.results().where(usable if faulty else usable & (F.col("error_type") == "ok"))
    members = chunk_blocks(chunks)
    if mode != "anchor":
        if kind != "translated":
            raise ValueError("direct mode has no bilingual export")
        return direct(good, blocks, members, results)
    texts = parsed(results, members, blocks)
    return replaced(good, blocks, texts) if kind == "translated" else bilingual(good, blocks, texts)
