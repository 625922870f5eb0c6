"""Secret scan: Aho-Corasick keywords first, anchored patterns only near hits, then embedded checksums.

All texts of a batch are lower-cased as bytes and searched for the keywords in one pass. A pattern is tried only where its keyword was
hit, from the keyword's first character on; bare hex strings have no keyword, for them runs of hex digits of the least length take the
keyword's part. Tokens that carry a checksum (of the forms gh?_ and npm_) count only where it is right. All patterns are
ASCII, so they run on the UTF-8 bytes, and only the spans found are turned into characters.

Rows: a null text counts as empty; equal or null doc_ids are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, documents, text_of

# Kinds in their order, keywords (lower case), patterns and least lengths.
KINDS = ("assign", "access", "hex", "github", "npm")
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "api_key": "assign",
    "apikey": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "github": re.compile(r"gh[oprsu]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
}
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE_KINDS = KINDS[:3]


def checksum(body: str) -> str:
    """The six base-62 digits of the CRC-32 of a token's body."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def _valid(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= LEAST_VALUE
    if kind == "access":
        return len(match[0]) >= LEAST_ACCESS
    if kind == "hex":
        return len(match[0]) >= LEAST_HEX
    token = match[0]
    return token[-6:] == checksum(token[4:-6])


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (KINDS.index(kind), len(word)))
    found.make_automaton()
    return found


def _hex_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where runs of hex digits of the least length begin; a run ends with its text."""
    is_hex = np.zeros(256, bool)
    is_hex[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
    inside = is_hex[data]
    if len(inside) < LEAST_HEX:
        return np.zeros(0, np.int64)
    edge = np.concatenate([[True], inside[1:] != inside[:-1]])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    return starts[inside[starts] & (ends - starts >= LEAST_HEX)]


def spans_of(data: np.ndarray, offsets: np.ndarray, words) -> dict[int, list[tuple[int, int, int]]]:
    """By text: (start, kind, end) in bytes from the text's start, in order."""
    raw = data.tobytes().decode("latin-1")
    hits = [(at - n + 1, kind) for at, (kind, n) in words.iter(LOWER[data].tobytes().decode("latin-1"))]
    hits += [(at, 2) for at in _hex_starts(data, offsets).tolist()]
    hits.sort()
    out: dict[int, list[tuple[int, int, int]]] = {}
    docs = (np.searchsorted(offsets, np.array([at for at, _ in hits], np.int64), "right") - 1).tolist()
    free = [0] * len(KINDS)
    for (at, kind), doc in zip(hits, docs):
        if at < free[kind]:
            continue
        name = KINDS[kind]
        match = PATTERNS[name].match(raw, at, int(offsets[doc + 1]))
        if match:
            if name in BASE_KINDS:
                free[kind] = match.end()  # a match that fails is used up all the same
            if _valid(name, match):
                base = int(offsets[doc])
                out.setdefault(doc, []).append((at - base, kind, match.end() - base))
    return out


def scanned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its spans: array of (kind, start, end), characters, end exclusive, by start and then kind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            data, offsets = text_of(batch.column(1))
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for doc, found in spans_of(data, offsets, words).items():
                own = data[offsets[doc] : offsets[doc + 1]]
                chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                spans[doc] = [{"kind": KINDS[k], "start": int(chars[a]), "end": int(chars[b])} for a, k, b in sorted(found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind_of))], ["doc_id", "spans"])

    return documents(docs, id_col, text_col).mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
