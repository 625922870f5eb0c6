"""Structured Streaming ingest of pages (an addition to the batch pipeline): new pages become blocks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.anchors import simplified
from ..operators.lines import FILE, normalised_files, text_lines
from ..sources.epub import from_pages


def block_stream(pages: DataFrame, book_id: str = "pages") -> DataFrame:
    """Blocks of a stream of pages: stateless, so a page's blocks are numbered by their lines only."""
    rows = text_lines(normalised_files(from_pages(pages, book_id)))
    return rows.withColumn("b", simplified(F.col("line"), F.col("ends"))).select(*FILE, "line_idx", "b.text", "b.mapping", "b.indent", "b.trailing")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there now and stops; started again, it goes on where it was."""
    schema = spark.read.parquet(source).schema
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    return block_stream(pages).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
