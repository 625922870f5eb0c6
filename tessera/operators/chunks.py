"""Blocks to chunks (the units sent to a translator), per file, and the text a chunk is sent as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import FILE, offsets

#: Fixed value: characters per chunk.
CHUNK_CHARS = 1000


def _starts(sizes: Column, step) -> Column:
    """Places of the blocks that begin chunks. step(size, count, n) gives, for a block of n characters after a chunk so far: whether it begins a new one though the
    last is open, and size and count of the chunk so far after it (count 0: closed). The fold keeps an entry per chunk, not per block."""
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("count"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def fold(x: Column, n: Column) -> Column:
        flush, size, count = step(x["size"], x["count"], n)
        begins = (x["count"] == 0) | flush
        return F.struct(size.alias("size"), count.alias("count"), (x["i"] + 1).alias("i"), F.when(begins, F.concat(x["starts"], F.array(x["i"]))).otherwise(x["starts"]).alias("starts"))

    return F.aggregate(sizes, start, fold, lambda x: x["starts"])


def closing_chunks(sizes: Column, limit: int) -> Column:
    """Places where chunks begin: a chunk is closed by the block that brings it to the limit (and may pass it)."""

    def step(size: Column, count: Column, n: Column) -> tuple[Column, Column, Column]:
        full = size + n >= limit
        return F.lit(False), F.when(full, 0).otherwise(size + n), F.when(full, 0).otherwise(count + 1)

    return _starts(sizes, step)


def bounded_chunks(sizes: Column, limit: int) -> Column:
    """Places where chunks begin: a chunk is closed before the block that would bring it over the limit; a block of the limit's size stands alone."""

    def step(size: Column, count: Column, n: Column) -> tuple[Column, Column, Column]:
        flush, alone = (count > 0) & ((n >= limit) | (size + n > limit)), n >= limit
        return flush, F.when(alone, 0).when(flush, n).otherwise(size + n), F.when(alone, 0).when(flush, 1).otherwise(count + 1)

    return _starts(sizes, step)


def anchored_prompt(texts: Column) -> Column:
    """<n>text</n> per block, n from 1."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("<"), i + 1, F.lit(">"), t, F.lit("</"), i + 1, F.lit(">"))), "\n")


def plain_prompt(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t: F.regexp_replace(t, r"[\r\n]+\z", "")), "\n")


def chunked(blocks: DataFrame, mode: str = "anchor", limit: int = CHUNK_CHARS) -> DataFrame:
    """(book_id, file_ord, chunk_id, orig, n_blocks, blocks: their global_idx in order). A file's blocks are folded in one row; chunks never span files."""
    fold, prompt = (closing_chunks, anchored_prompt) if mode == "anchor" else (bounded_chunks, plain_prompt)
    files = blocks.groupBy(*FILE).agg(F.sort_array(F.collect_list(F.struct("block_ord", "global_idx", "text", "n_chars"))).alias("b"))
    files = files.withColumn("c", fold(F.transform("b", lambda x: x["n_chars"]), limit)).withColumn("n_chunks", F.size("c"))
    before = offsets(files.select(*FILE, "n_chunks"), "n_chunks").select(*FILE, "before")
    # each chunk's row gets its own blocks only
    own = F.transform("c", lambda first, k: F.slice("b", first + 1, F.coalesce(F.get("c", k + 1), F.size("b")) - first))
    rows = files.join(before, FILE).select(*FILE, "before", F.posexplode(own).alias("k", "own"))
    return rows.select(*FILE, (F.col("before") + F.col("k")).alias("chunk_id"), prompt(F.transform("own", lambda x: x["text"])).alias("orig"), F.size("own").alias("n_blocks"), F.transform("own", lambda x: x["global_idx"]).alias("blocks"))


def chunk_blocks(chunks: DataFrame) -> DataFrame:
    """(book_id, chunk_id, n from 1, global_idx)."""
    return chunks.select("book_id", "chunk_id", F.posexplode("blocks").alias("n", "global_idx")).withColumn("n", F.col("n") + 1)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("book_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("file_ord").alias("n_files"), F.sum("n_blocks").alias("n_blocks"))
