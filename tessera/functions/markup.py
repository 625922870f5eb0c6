"""Text functions on markup, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Block-level elements that stand on lines of their own, line-ending elements, elements without an end tag.
BLOCK_TAGS = ["p", "div", "h[1-6]", "ul", "ol", "li", "blockquote", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "figure", "figcaption", "header", "footer", "article", "section", "aside", "nav", "main", "pre", "details", "summary", "dl", "dt", "dd"]
BREAK_TAGS = ["br", "hr"]
VOID_TAGS = ["img", "br", "hr", "col", "meta", "link", "input", "base", "source", "area", "param", "track", "wbr", "keygen"]
# What counts as a tag; what counts as readable; placeholders.
TAG = r"(?is)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>|</?[a-zA-Z0-9\-:]+(?:\s+[^>]*)?>|<[a-zA-Z0-9\-:]+(?:\s+[^>]*)?/>"
READABLE = r"[a-zA-Z0-9\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}\x{00c0}-\x{024f}]"
PLACEHOLDER = r"</?t\d+>|<s\d+/>"
ANY_TOKEN = r"</?\d+>|</?t\d+>|<s\d+/>"

#: White space as Unicode has it plus the separators U+001C to U+001F, for a pattern under (?U).
SPACE = r"[\s\x1c-\x1f]"



def normalised(html: Column) -> Column:
    """Block elements on lines of their own, at most one blank line between two, none at the start. Idempotent."""
    blocks, breaks = "|".join(BLOCK_TAGS), "|".join(BREAK_TAGS)
    out = F.regexp_replace(html, rf"(?i)\n?(<(?:{blocks})\b[^>]*>)", "\n$1")
    out = F.regexp_replace(out, rf"(?i)(</(?:{blocks})\b[^>]*>)\n?", "$1\n")
    out = F.regexp_replace(out, rf"(?i)(</?(?:{breaks})\b[^>]*>)\n?", "$1\n")
    out = F.regexp_replace(out, rf"(?U)\n{SPACE}*\n{SPACE}*\n", "\n\n")
    return F.regexp_replace(out, r"^\n+", "")


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def has_text(text: Column) -> Column:
    """Whether anything readable is left without tags."""
    return without_tags(text).rlike(READABLE)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column) -> Column:
    """Distinct block and tag placeholders, in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ANY_TOKEN})"), F.lit(1)))


def forged_tokens(translated: Column, original: Column) -> Column:
    return F.array_except(tokens(translated), tokens(original))


def without_fences(reply: Column) -> Column:
    """Without the lines that open or close a code fence, and without line breaks at either end (indentation stays)."""
    kept = F.filter(F.split(reply, "\n"), lambda x: ~x.rlike(rf"(?U)^{SPACE}*```"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^[\r\n]+|[\r\n]+\z", "")


def preview(text: Column, length: int = 50, more: str = "...") -> Column:
    """The first characters on one line."""
    return F.concat(F.regexp_replace(F.substring(text, 1, length), "\n", " "), F.lit(more))


def joined_pieces(gaps: Column, pieces: Column) -> Column:
    """gaps[0] pieces[0] gaps[1] ... with one gap more than pieces."""
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(pieces, i), F.lit("")))), "")


def split_by(text: Column, pattern: str) -> tuple[Column, Column]:
    """The gaps between a pattern's matches, and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})" if not pattern.startswith("(?") else _grouped(pattern)), F.lit(1))


def _grouped(pattern: str) -> str:
    flags, rest = pattern.split(")", 1)
    return f"{flags})({rest})"
