"""Translated files from immutable lines, blocks and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import without_fences
from .anchors import restored
from .lines import FILE, lines


def _joined(rows: DataFrame) -> DataFrame:
    """Files from (book_id, file_ord, place, part): ordered parts, one row per file."""
    return rows.groupBy(*FILE).agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "part")))["part"], "").alias("html"))


def _line_rows(files: DataFrame) -> DataFrame:
    return lines(files).withColumn("whole", F.concat("line", F.when(F.col("ends"), "\n").otherwise("")))


def _restored(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    both = blocks.join(texts.withColumnRenamed("text", "translated"), ["book_id", "global_idx"])
    return both.select(*FILE, F.col("start_line").alias("line_idx"), restored(F.col("translated"), F.col("mapping"), F.col("indent"), F.col("trailing")).alias("restored"))


def replaced(files: DataFrame, blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Translated lines instead of the original ones. texts: (book_id, global_idx, text)."""
    rows = _line_rows(files).join(_restored(blocks, texts), [*FILE, "line_idx"], "left")
    return _joined(rows.select(*FILE, F.struct("line_idx").alias("place"), F.coalesce("restored", "whole").alias("part")))


def bilingual(files: DataFrame, blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Translated lines after the original ones; one that follows a last line without a break gets a line of its own."""
    original = _line_rows(files)
    place = lambda k: F.struct(F.col("line_idx").alias("line"), F.lit(k).alias("k")).alias("place")
    translated = _restored(blocks, texts).join(original.select(*FILE, "line_idx", "ends"), [*FILE, "line_idx"])
    part = F.when(F.col("ends"), F.col("restored")).otherwise(F.concat(F.lit("\n"), F.col("restored")))
    return _joined(original.select(*FILE, place(0), F.col("whole").alias("part")).unionByName(translated.select(*FILE, place(1), part.alias("part"))))


def direct(files: DataFrame, blocks: DataFrame, chunk_blocks: DataFrame, results: DataFrame) -> DataFrame:
    """Direct mode: a chunk's reply is dealt to its blocks by their numbers of lines; the last block takes the rest; a block left without gets empty lines."""
    reply = F.regexp_replace(without_fences(F.col("trans")), r"[\r\n]+\z", "")
    replies = results.select("book_id", "chunk_id", reply.alias("reply")).where("reply <> ''").select("book_id", "chunk_id", F.split("reply", "\n").alias("reply"))
    rows = chunk_blocks.join(blocks.select(*FILE, "global_idx", "start_line", "end_line"), ["book_id", "global_idx"]).join(replies, ["book_id", "chunk_id"])
    size = F.col("end_line") - F.col("start_line") + 1
    ordered = Window.partitionBy("book_id", "chunk_id").orderBy("start_line")
    rows = rows.withColumn("before", F.sum(size).over(ordered) - size).withColumn("last", F.lead("start_line").over(ordered).isNull())
    share = F.when(F.col("before") < F.size("reply"), F.slice("reply", (F.col("before") + 1).cast("int"), F.when(F.col("last"), F.size("reply")).otherwise(size).cast("int"))).otherwise(F.array().cast("array<string>"))
    text = F.when(F.size(share) == 0, F.expr("repeat('\n', end_line - start_line + 1)")).otherwise(F.concat(F.array_join(share, "\n"), F.lit("\n")))
    blocks_in = rows.select(*FILE, "start_line", "end_line", text.alias("part"))
    inside = blocks_in.select(*FILE, F.explode(F.sequence("start_line", "end_line")).alias("line_idx"), F.lit(True).alias("gone"))
    kept = _line_rows(files).join(inside, [*FILE, "line_idx"], "left_anti").select(*FILE, F.struct("line_idx").alias("place"), F.col("whole").alias("part"))
    return _joined(kept.unionByName(blocks_in.select(*FILE, F.struct(F.col("start_line").alias("line_idx")).alias("place"), "part")))
