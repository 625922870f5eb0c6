"""Files to lines to blocks of readable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import has_text, normalised

FILE = ["book_id", "file_ord"]
#: Files per bucket of a running sum; sums within a bucket and over buckets are separate windows, so no task sees all files.
BUCKET = 4096


def normalised_files(files: DataFrame) -> DataFrame:
    """Contents files but .ncx are normalised."""
    plain = F.coalesce(F.lower("rel_path").endswith(".ncx"), F.lit(False))
    return files.withColumn("html", F.when(plain, F.col("html")).otherwise(normalised(F.col("html"))))


def lines(files: DataFrame) -> DataFrame:
    """(book_id, file_ord, line_idx, line, ends): the lines without their line breaks; ends: whether one follows. A final break opens no further line."""
    # counted below the explode: beside it the whole file would be split again for each of its lines
    rows = files.select(*FILE, F.split("html", "\n").alias("all")).select(*FILE, "all", F.size("all").alias("n")).select(*FILE, F.posexplode("all").alias("line_idx", "line"), "n")
    last = F.col("line_idx") == F.col("n") - 1
    return rows.where(~(last & (F.col("line") == ""))).select(*FILE, "line_idx", "line", (~last).alias("ends"))


def text_lines(files: DataFrame) -> DataFrame:
    """The lines with readable text, numbered in their file (block_ord) within the file's row, so without a shuffle."""
    n = F.size(F.split("html", "\n"))
    every = F.transform(F.split("html", "\n"), lambda x, i: F.struct(i.alias("line_idx"), x.alias("line"), (i < n - 1).alias("ends")))
    rows = files.select(*FILE, every.alias("every"))
    kept = F.filter("every", lambda s: has_text(s["line"]))
    return rows.select(*FILE, F.posexplode(kept).alias("block_ord", "s")).select(*FILE, "block_ord", "s.line_idx", "s.line", "s.ends")


def offsets(per_file: DataFrame, n: str) -> DataFrame:
    """Adds `before`: the sum of n over the book's earlier files."""
    bucket = F.floor(F.col("file_ord") / BUCKET)
    rows = per_file.withColumn("bucket", bucket)
    inner = F.sum(n).over(Window.partitionBy("book_id", "bucket").orderBy("file_ord")) - F.col(n)
    sums = rows.groupBy("book_id", "bucket").agg(F.sum(n).alias("total"))
    outer = F.sum("total").over(Window.partitionBy("book_id").orderBy("bucket")) - F.col("total")
    return rows.withColumn("inner", inner).join(sums.select("book_id", "bucket", outer.alias("outer")), ["book_id", "bucket"]).withColumn("before", F.col("inner") + F.col("outer")).drop("bucket", "inner", "outer")


def numbered(blocks: DataFrame, order: Column | str = "start_line") -> DataFrame:
    """Adds block_ord (in the file, unless it is there) and global_idx (in the book), both dense from 0."""
    rows = blocks if "block_ord" in blocks.columns else blocks.withColumn("block_ord", F.row_number().over(Window.partitionBy(*FILE).orderBy(order)) - 1)
    counts = offsets(rows.groupBy(*FILE).agg(F.count("*").alias("n_blocks")), "n_blocks").select(*FILE, "before")
    return rows.join(counts, FILE).withColumn("global_idx", F.col("before") + F.col("block_ord")).drop("before")
