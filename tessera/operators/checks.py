"""Format checks of translated chunks, and their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import trimmed

# Fixed value: a block in a reply.
BLOCK = r"(?s)<(\d+)>(.*?)</\1>"


def reply_blocks(text: Column) -> Column:
    """array(struct(id, body)) in order; ids as written."""
    found = trimmed(text)
    return F.transform(F.arrays_zip(F.regexp_extract_all(found, F.lit(BLOCK), F.lit(1)).alias("id"), F.regexp_extract_all(found, F.lit(BLOCK), F.lit(2)).alias("body")), lambda z: F.struct(z["id"].alias("id"), z["body"].alias("body")))


def _plain(number: Column) -> Column:
    return F.regexp_replace(number, r"^0+(?=\d)", "")


def _times(text: Column, part: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, part))) / F.length(part)


def _unbalanced(body: Column) -> Column:
    """The lowest anchor number whose opening and closing anchors differ in number, as written."""
    numbers = F.array_distinct(F.regexp_extract_all(body, F.lit(r"<t(\d+)>"), F.lit(1)))
    wrong = F.filter(numbers, lambda k: _times(body, F.concat(F.lit("<t"), k, F.lit(">"))) != _times(body, F.concat(F.lit("</t"), k, F.lit(">"))))
    order = F.transform(wrong, lambda k: F.struct(F.length(_plain(k)).alias("n"), _plain(k).alias("p"), k.alias("k")))
    return F.array_min(order)["k"]


def anchored_format(text: Column, expected: Column) -> Column:
    """ok, line_count_mismatch, index_mismatch_at_<a>_expected_<b> or unbalanced_internal_t<k>."""

    def check(blocks: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            number = (i + 1).cast("string")
            wrong = F.concat(F.lit("index_mismatch_at_"), b["id"], F.lit("_expected_"), number)
            return F.when(_plain(b["id"]) != number, wrong).otherwise(F.concat(F.lit("unbalanced_internal_t"), _unbalanced(b["body"])))

        first = F.get(F.filter(F.transform(blocks, one), lambda e: e.isNotNull()), 0)
        return F.when(F.size(blocks) != expected, "line_count_mismatch").otherwise(F.coalesce(first, F.lit("ok")))

    return F.transform(F.array(reply_blocks(text)), check)[0]


def format_of(text: Column, expected: Column, mode: str = "anchor") -> Column:
    """Direct mode has no anchors to check."""
    return anchored_format(text, expected) if mode == "anchor" else F.lit("ok")


def revalidated(results: DataFrame, mode: str = "anchor") -> DataFrame:
    """error_type anew from trans and n_blocks: none without a translation, api_error stays (also where the text says so), else by format."""
    trans = F.coalesce("trans", F.lit(""))
    api = (F.col("error_type") == "api_error") | trans.startswith("[API错误]")
    return results.withColumn("error_type", F.when(trans == "", F.lit(None).cast("string")).when(api, "api_error").otherwise(format_of(trans, F.col("n_blocks"), mode)))


def backfilled(error_type: Column, manual: bool = False) -> Column:
    """Whether a result goes into the book at once; an edit by hand must be faultless."""
    return error_type == "ok" if manual else (error_type == "ok") | error_type.startswith("unbalanced_internal_")


def exported(error_type: Column, trans: Column) -> Column:
    """Whether a result goes into an export."""
    return (F.coalesce(trans, F.lit("")) != "") & ~F.coalesce(error_type == "api_error", F.lit(False))


def parsed(results: DataFrame, chunk_blocks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(book_id, global_idx, text): each block's translation, the first with its number; the original where there is none."""
    found = results.select("book_id", "chunk_id", F.transform(reply_blocks(F.col("trans")), lambda b: F.struct(_plain(b["id"]).alias("id"), b["body"].alias("body"))).alias("found"))
    own = F.get(F.filter("found", lambda b: b["id"] == F.col("n").cast("string")), 0)["body"]
    # each block's row takes its own text before it is shuffled, not the chunk's whole reply
    rows = chunk_blocks.join(found, ["book_id", "chunk_id"]).select("book_id", "global_idx", own.alias("own"))
    both = rows.join(blocks.select("book_id", "global_idx", F.col("text").alias("original")), ["book_id", "global_idx"])
    return both.select("book_id", "global_idx", F.coalesce(trimmed(F.col("own")), F.col("original")).alias("text"))
