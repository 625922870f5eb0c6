"""Cleaning and decoding of model replies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of tags that hold a model's reasoning.
THINK_TAGS = ["thought", "think", "thinking", "reasoning", "cot", "scratchpad", "reflection", "analysis"]
_OPEN = re.compile(rf"<({'|'.join(THINK_TAGS)})\b[^>]*>", re.IGNORECASE)
_CLOSE = {name: re.compile(rf"</{name}>", re.IGNORECASE) for name in THINK_TAGS}


def _spans(text: str) -> tuple[list[tuple[int, int]], int | None]:
    """Closed reasoning spans from left to right, and where the first one without an end begins (spans behind it don't count)."""
    spans, at = [], 0
    while opened := _OPEN.search(text, at):
        closed = _CLOSE[opened[1].lower()].search(text, opened.end())
        if not closed:
            return spans, opened.start()
        spans.append((opened.start(), closed.end()))
        at = closed.end()
    return spans, None


def without_thinking(text: str | None, partial: bool = False) -> str | None:
    """A reply without its reasoning; partial: of an unfinished reply, also without what an open tag begins."""
    if not text:
        return text
    while (found := _spans(text))[0]:
        kept, at = [], 0
        for a, b in found[0]:
            kept.append(text[at:a])
            at = b
        text = "".join(kept) + text[at:]
    if partial and found[1] is not None:
        text = text[: found[1]]
    text = re.sub(r"[ \t]*\n[ \t]*\n[ \t]*\n+", "\n\n", text)
    return re.sub(r"(\s*\n)+$", "", re.sub(r"^(\s*\n)+", "", text))


@F.pandas_udf(T.StringType())
def strip_thinking(text: pd.Series) -> pd.Series:
    return text.map(without_thinking, na_action="ignore")


_MESSAGE = "struct<content:string,reasoning_content:string>"


def reply_content(body: Column) -> Column:
    """Of a chat completion in JSON: struct(text, status, error). A missing content falls back to reasoning_content."""
    parsed = F.from_json(body, f"choices array<struct<message:{_MESSAGE}>>")
    message = F.get(parsed["choices"], 0)["message"]
    reasoning = F.when(message["reasoning_content"] != "", message["reasoning_content"])
    text = F.coalesce(message["content"], reasoning)
    error = (
        F.when(parsed.isNull() | (parsed["choices"].isNull() & ~body.rlike(r"^\s*\{")), "plain text instead of a completion")
        .when(F.coalesce(F.size(parsed["choices"]), F.lit(0)) <= 0, "no choices")
        .when(message.isNull(), "no message")
        .when(text.isNull(), "no content")
    )
    shown = F.when(error.isNotNull(), F.concat(error, F.lit(": "), F.substring(body, 1, 500)))
    return F.struct(F.when(error.isNull(), text).alias("text"), F.when(error.isNull(), "ok").otherwise("api_error").alias("status"), shown.alias("error"))


def status(error_type: Column, translated: Column) -> Column:
    """A chunk's state for people: failed call, wrong format, translated, or not yet."""
    wrong = error_type.isNotNull() & (error_type != "ok")
    return F.when(wrong & (error_type == "api_error"), "API错误").when(wrong, "格式错误").when(F.coalesce(translated, F.lit("")) != "", "已翻译").otherwise("未翻译")
