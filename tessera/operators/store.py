"""Results as an append-only table of attempts; resume, edits, status queries, progress and settings on top of it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markup import forged_tokens, preview, tokens
from ..functions.replies import status
from .checks import anchored_format, backfilled

#: attempt: 0 for the first translation, growing; the latest attempt of a chunk counts.
RESULTS = "book_id string, chunk_id long, attempt int, trans string, status string, error string, error_type string"
#: Layout of a book's tables; a store of another one is prepared anew.
VERSION = 1
SETTINGS = "api_key string, api_url string, model string, temp double, prompt string, chunk_size int, max_workers int, interval double, timeout double"


class Store:
    """A folder with the tables files, blocks, chunks, books (one row per book and version) and results."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def write(self, name: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        writer = df.write.mode(mode)
        (writer.partitionBy("book_id") if "book_id" in df.columns else writer).option("partitionOverwriteMode", "dynamic").parquet(self._at(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self._at(name))

    def usable(self, book_id: str) -> bool:
        """Whether a book is here in this layout."""
        return self.has("books") and not self.read("books").where((F.col("book_id") == book_id) & (F.col("version") == VERSION)).isEmpty()

    def purge(self, name: str | None = None) -> None:
        for table in [name] if name else ["files", "found", "blocks", "chunks", "books", "results"]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def results(self) -> DataFrame:
        """The latest attempt of each chunk."""
        return latest(self.read("results", RESULTS)) if self.has("results") else self.spark.createDataFrame([], RESULTS)

    def append(self, rows: DataFrame) -> None:
        """New attempts, each numbered after the chunk's last one."""
        before = self.results().select("book_id", "chunk_id", F.col("attempt").alias("last"))
        numbered = rows.join(before, ["book_id", "chunk_id"], "left").withColumn("attempt", F.coalesce(F.col("last") + 1, F.lit(0)).cast("int"))
        columns = [c.split()[0] for c in RESULTS.split(", ")]
        numbered.select(*columns).write.mode("append").partitionBy("book_id").parquet(self._at("results"))

    def edit(self, book_id: str, chunk_id: int, text: str, n_blocks: int, mode: str = "anchor") -> None:
        """A translation by hand, checked like any other."""
        row = self.spark.createDataFrame([(book_id, chunk_id, text, "ok", None)], "book_id string, chunk_id long, trans string, status string, error string")
        check = anchored_format(F.col("trans"), F.lit(n_blocks)) if mode == "anchor" else F.lit("ok")
        self.append(row.withColumn("error_type", check))


def latest(results: DataFrame) -> DataFrame:
    newest = Window.partitionBy("book_id", "chunk_id").orderBy(F.desc("attempt"))
    return results.withColumn("rank", F.row_number().over(newest)).where("rank = 1").drop("rank")


def pending(chunks: DataFrame, results: DataFrame, targets: DataFrame | None = None, retry_failed: bool = True) -> DataFrame:
    """What is left to translate: the chunks without a result, or the given targets whatever they have."""
    if targets is not None:
        return chunks.join(targets.select("book_id", "chunk_id").distinct(), ["book_id", "chunk_id"], "left_semi")
    done = results.where(F.col("status") == "ok") if retry_failed else results
    return chunks.join(done, ["book_id", "chunk_id"], "left_anti")


def reassembled(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """All chunks, with an empty translation where there is none."""
    both = chunks.join(results, ["book_id", "chunk_id"], "left")
    return both.withColumn("trans", F.coalesce("trans", F.lit(""))).withColumn("is_error", F.coalesce(F.col("error_type") != "ok", F.lit(False)))


def listed(rows: DataFrame) -> DataFrame:
    """A line per chunk: status and previews."""
    return rows.select("book_id", "chunk_id", status(F.col("error_type"), F.col("trans")).alias("status"), preview(F.col("orig")).alias("preview"))


def with_status(rows: DataFrame, which: str = "all") -> DataFrame:
    """which: all, translated (faulty ones too), untranslated, error."""
    has = F.coalesce(F.col("trans"), F.lit("")) != ""
    kinds = {"all": F.lit(True), "translated": has, "untranslated": ~has, "error": F.coalesce(F.col("is_error"), F.lit(False))}
    return rows.where(kinds[which])


def matching(rows: DataFrame, keyword: str, where: str = "both") -> DataFrame:
    """Case-insensitive substring search in orig, trans or both; white space around the keyword doesn't count, an empty one matches all."""
    key = keyword.strip().lower()
    if not key:
        return rows
    inside = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(key)
    return rows.where({"orig": inside("orig"), "trans": inside("trans")}.get(where, inside("orig") | inside("trans")))


def chunk_detail(rows: DataFrame, chunk_id: int) -> DataFrame:
    """One chunk with the placeholders of its original and those that its translation made up."""
    one = rows.where(F.col("chunk_id") == chunk_id)
    return one.select("*", tokens(F.col("orig")).alias("tokens"), forged_tokens(F.col("trans"), F.col("orig")).alias("forged"))


def blocks_of(chunk_blocks: DataFrame, blocks: DataFrame, chunk_id: int) -> DataFrame:
    """A chunk's blocks in order; a number without a block shows an empty text."""
    own = chunk_blocks.where(F.col("chunk_id") == chunk_id)
    both = own.join(blocks.select("book_id", "global_idx", "text"), ["book_id", "global_idx"], "left")
    return both.select("n", "global_idx", preview(F.coalesce("text", F.lit("")), 100, "").alias("preview")).orderBy("n")


def progress(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book_id", status(F.col("error_type"), F.col("trans")).alias("status")).agg(F.count("*").alias("n"))


def all_done(chunks: DataFrame, results: DataFrame) -> bool:
    return pending(chunks, results).isEmpty()


def in_book(results: DataFrame, manual: Column | bool = False) -> DataFrame:
    """Results that go into the book at once."""
    return results.where(backfilled(F.col("error_type"), manual))


def settings_history(entries: DataFrame, most: int = 10) -> DataFrame:
    """The newest entry per (api_key, api_url), newest first, at most so many. entries has saved_at."""
    newest = Window.partitionBy("api_key", "api_url").orderBy(F.desc("saved_at"))
    return entries.withColumn("rank", F.row_number().over(newest)).where("rank = 1").drop("rank").orderBy(F.desc("saved_at")).limit(most)


def loaded_settings(spark: SparkSession, text: str | None) -> DataFrame:
    """The history of a settings file's text; a broken one is empty."""
    rows = spark.createDataFrame([(text or "",)], "text string")
    parsed = F.from_json("text", f"history array<struct<{', '.join(c.replace(' ', ':') for c in SETTINGS.split(', '))}>>")
    return rows.select(F.posexplode(parsed["history"]).alias("place", "s")).select("place", "s.*")


def settings_text(history: DataFrame, **others: str) -> str:
    """A settings file's text from a history (at most its ten entries reach the driver) and single values such as folders."""
    names = [c.split()[0] for c in SETTINGS.split(", ")]
    entries = [{k: v for k, v in r.asDict().items() if k in names} for r in history.collect()]
    return json.dumps({"history": entries, **others}, ensure_ascii=False, indent=2)
