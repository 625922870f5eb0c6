"""Inline tags as numbered anchors, per line and without a shuffle: a line's tags are paired in one pass, by an Arrow function."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markup import PLACEHOLDER, TAG, VOID_TAGS
from .batches import ROWS
from .lines import FILE, numbered, text_lines


_TAG = re.compile(TAG[5:], re.IGNORECASE | re.DOTALL | re.ASCII)
_PLACE = re.compile(PLACEHOLDER, re.ASCII)
_NAME = re.compile(r"</?([a-zA-Z0-9\-:]+)")
_ALONE = frozenset(VOID_TAGS)
_string = lambda *names: [T.StructField(x, T.StringType()) for x in names]
TAGGED = T.ArrayType(T.StructType(_string("tag", "token")))
SIMPLIFIED = T.StructType([*_string("text"), T.StructField("mapping", T.ArrayType(T.StructType(_string("token", "tag")))), *_string("indent", "trailing")])


def _pairs(tags: list[str]) -> dict[int, int]:
    """Places of opening tags with those of their closing tags: a closing tag takes the last open one of its name; pairs may cross. One pass with a stack per name."""
    open_at, pairs = defaultdict(list), {}
    for i, tag in enumerate(tags):
        name = _NAME.match(tag)
        if name is None:  # comment, instruction, doctype
            continue
        name = name[1].lower()
        if tag.startswith("</"):
            if open_at[name]:
                pairs[open_at[name].pop()] = i
        elif not tag.endswith("/>") and name not in _ALONE:
            open_at[name].append(i)
    return pairs


def _tokens(tags: list[str], pairs: dict[int, int]) -> list[str]:
    """Per tag its token: <tN> and </tN> for the N-th pair by opening tag, <sN/> for the N-th of the others."""
    out, singles = [""] * len(tags), 0
    for n, a in enumerate(sorted(pairs), 1):
        out[a], out[pairs[a]] = f"<t{n}>", f"</t{n}>"
    for i, token in enumerate(out):
        if not token:
            singles += 1
            out[i] = f"<s{singles}/>"
    return out


def _simplified(line: str, ends: bool) -> tuple:
    """(text, mapping, indent, trailing). The mapping lists pairs and single tags in order, a pair's two tokens together."""
    mapping, whole = [], line
    if "<" in line and (found := list(_TAG.finditer(line))):
        tags = [m[0] for m in found]
        pairs = _pairs(tags)
        tokens, shut = _tokens(tags, pairs), set(pairs.values())
        parts, at = [], 0
        for m, token in zip(found, tokens):
            parts += [line[at : m.start()], token]
            at = m.end()
        whole = "".join(parts) + line[at:]
        for i in range(len(tags)):
            if i not in shut:
                mapping += [(tokens[k], tags[k]) for k in (i, pairs.get(i)) if k is not None]
    text = whole.strip()
    lead = len(whole) - len(whole.lstrip())
    after = whole[lead + len(text) :] if text else whole
    return text, mapping, whole[:lead], after + ("\n" if ends else "")


_PAIRS = {"token": pa.string(), "tag": pa.string()}


def _lists(rows: list[list[tuple]]) -> pa.ListArray:
    """Lists of (token, tag) as an Arrow array."""
    offsets = [0, *accumulate(map(len, rows))]
    columns = [pa.array([x[k] for row in rows for x in row], pa.string()) for k in range(2)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, list(_PAIRS)))


def _in_parts(work, *columns: pa.Array) -> pa.Array:
    """work(part of each column), a few rows at a time."""
    done = [work(*(c.slice(lo, ROWS) for c in columns)) for lo in range(0, len(columns[0]), ROWS)]
    return pa.concat_arrays(done) if done else work(*columns)


@F.arrow_udf(SIMPLIFIED)
def simplified(line: pa.Array, ends: pa.Array) -> pa.Array:
    """struct(text, mapping, indent, trailing) of a line; `ends`: whether a line break follows it. One pass over a line's tags."""

    def work(line: pa.Array, ends: pa.Array) -> pa.Array:
        rows = [_simplified(x or "", bool(e)) for x, e in zip(line.to_pylist(), ends.to_pylist())]
        text, mapping, indent, trailing = list(zip(*rows)) or [(), (), (), ()]
        text, indent, trailing = (pa.array(c, pa.string()) for c in (text, indent, trailing))
        return pa.StructArray.from_arrays([text, _lists(mapping), indent, trailing], ["text", "mapping", "indent", "trailing"])

    return _in_parts(work, line, ends)


@F.arrow_udf(TAGGED)
def tagged(line: pa.Array) -> pa.Array:
    """A line's tags with their tokens."""

    def work(line: pa.Array) -> pa.Array:
        found = [[m[0] for m in _TAG.finditer(x or "")] for x in line.to_pylist()]
        rows = _lists([list(zip(_tokens(tags, _pairs(tags)), tags)) for tags in found])
        return pa.ListArray.from_arrays(rows.offsets, pa.StructArray.from_arrays([rows.values.field("tag"), rows.values.field("token")], ["tag", "token"]))

    return _in_parts(work, line)


def anchored(files: DataFrame) -> DataFrame:
    """Blocks of one line each: text with anchors, mapping, indent, trailing, numbers in their file only, so without a shuffle."""
    rows = text_lines(files).withColumn("b", simplified(F.col("line"), F.col("ends")))
    return rows.select(*FILE, "block_ord", F.col("line_idx").alias("start_line"), F.col("line_idx").alias("end_line"), "b.text", "b.mapping", "b.indent", "b.trailing")


def anchor_blocks(files: DataFrame) -> DataFrame:
    """The same, numbered in the book too. Lines are anchored again for the numbers: write them first where that counts."""
    return numbered_anchors(anchored(files))


def numbered_anchors(found: DataFrame) -> DataFrame:
    return numbered(found).withColumn("n_chars", F.length("text"))


def _restored(text: str | None, known: list[str], tags: list[str | None]) -> str:
    tag_of: dict[str, str | None] = {}
    for x, y in zip(known, tags):
        tag_of.setdefault(x, y)
    seen: set[str] = set()

    def kept(m: re.Match) -> str:
        x = m[0]
        if x in seen or x not in tag_of:
            seen.add(x)
            return ""
        seen.add(x)
        return x

    def tag(m: re.Match) -> str:
        y = tag_of.get(m[0])
        return m[0] if y is None else y

    clean = _PLACE.sub(kept, text) if "<" in text else text
    clean += "".join(x for x in known if x not in seen)
    return _PLACE.sub(tag, clean) if "<" in clean else clean


@F.arrow_udf(T.StringType())
def restored(text: pa.Array, mapping: pa.Array, indent: pa.Array, trailing: pa.Array) -> pa.Array:
    """A translated line with its original tags: unknown anchors and repeats go, missing ones are appended in mapping order; null where anything is null."""

    def work(text: pa.Array, mapping: pa.Array, indent: pa.Array, trailing: pa.Array) -> pa.Array:
        at, whole = mapping.offsets.to_pylist(), mapping.flatten()
        valid, out = mapping.is_valid().to_pylist(), []
        tokens, tags = (whole.field(k).to_pylist() for k in _PAIRS)
        k = 0
        for i, (t, a, z) in enumerate(zip(text.to_pylist(), indent.to_pylist(), trailing.to_pylist())):
            n = at[i + 1] - at[i] if valid[i] else 0
            out.append(None if t is None or a is None or z is None or not valid[i] else a + _restored(t, tokens[k : k + n], tags[k : k + n]) + z)
            k += n
        return pa.array(out, pa.string())

    return _in_parts(work, text, mapping, indent, trailing)
