"""Direct mode: blocks are whole block-level elements, found by a scan over a file's lines that jumps past each block."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import SPACE, trimmed
from .batches import parts, release
from .lines import FILE, numbered

# Elements in order of precedence.
PARAGRAPH_TAGS = ["p", "h[1-6]", "li", "blockquote", "figcaption", "dt", "dd", "summary", "pre", "text"]
_OPEN = [re.compile(rf"<({tag})(?:\s+[^>]*)?>", re.IGNORECASE) for tag in PARAGRAPH_TAGS]
_TAGS = re.compile(r"<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>|</?[a-zA-Z0-9\-:]+(?:\s+[^>]*)?>|<[a-zA-Z0-9\-:]+(?:\s+[^>]*)?/>", re.DOTALL | re.IGNORECASE)
_READABLE = re.compile("[a-zA-Z0-9一-鿿぀-ゟ゠-ヿ가-힯Ѐ-ӿÀ-ɏ]")


def readable(text: str) -> bool:
    return _READABLE.search(_TAGS.sub("", text)) is not None


class _Closers:
    """For each element name, the lines that have its end tag; looked up instead of searched again from every opener."""

    def __init__(self, lines: list[str]):
        self.lines, self.at = lines, {}

    def after(self, name: str, line: int) -> int | None:
        """The first line from `line` on that has the end tag."""
        if name not in self.at:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE)
            following, found = [None] * (len(self.lines) + 1), None
            for i in range(len(self.lines) - 1, -1, -1):
                found = i if end.search(self.lines[i]) else found
                following[i] = found
            self.at[name] = following
        return self.at[name][line]


def paragraph_ranges(lines: list[str]) -> list[tuple[int, int]]:
    """Inclusive ranges of lines that are blocks; ascending, never overlapping."""
    closers, out, i = _Closers(lines), [], 0
    while i < len(lines):
        end = None
        for tag in _OPEN if "<" in lines[i] else ():
            opened = tag.search(lines[i])
            if opened and (end := closers.after(opened[1].lower(), i)) is not None:
                break
        end = i if end is None else end
        if readable("\n".join(lines[i : end + 1])):
            out.append((i, end))
        i = end + 1
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, "html"):
            rows = []
            for at, html in enumerate(part.column("html").to_pylist()):
                lines = (html or "").split("\n")
                if lines[-1] == "":
                    lines.pop()
                    ends = len(lines)
                else:
                    ends = len(lines) - 1  # the last line has no break
                for k, (a, b) in enumerate(paragraph_ranges(lines)):
                    rows.append((at, k, a, b, "\n".join(lines[a : b + 1]) + ("\n" if b < ends else "")))
            at, *numbers, texts = list(zip(*rows)) or [()] * 5
            files = [part.column(c).take(pa.array(at, pa.int64())) for c in FILE]
            yield pa.RecordBatch.from_arrays([*files, *(pa.array(x, pa.int32()) for x in numbers), pa.array(texts, pa.string())], [*FILE, "block_ord", "start_line", "end_line", "text"])
    release()


def found_paragraphs(files: DataFrame) -> DataFrame:
    """Blocks (start_line, end_line, text with its line breaks), numbered in their file only, so without a shuffle."""
    kind = files.schema["file_ord"].dataType.simpleString()
    return files.select(*FILE, "html").mapInArrow(_scan, f"book_id string, file_ord {kind}, block_ord int, start_line int, end_line int, text string")


def paragraph_blocks(files: DataFrame) -> DataFrame:
    """The same, numbered in the book too. The scan is made again for the numbers: write found_paragraphs first where that counts."""
    return numbered_paragraphs(found_paragraphs(files))


def numbered_paragraphs(found: DataFrame) -> DataFrame:
    return numbered(found).withColumn("n_chars", F.length("text"))


def plain_simplified(line: Column) -> Column:
    """Direct mode keeps tags: struct(text, indent, trailing) of a line."""
    return F.struct(trimmed(line).alias("text"), F.regexp_extract(line, rf"(?U)^({SPACE}*)", 1).alias("indent"), F.regexp_extract(line, rf"(?U)({SPACE}*)\z", 1).alias("trailing"))


def plain_restored(text: Column, indent: Column, trailing: Column) -> Column:
    """Nothing for an empty translation."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(indent, text, trailing))
