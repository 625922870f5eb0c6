"""EPUB books: a source of files in reading order, and a sink that packs them again."""

from __future__ import annotations

import hashlib
import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "book_id string, path string, rel_path string, content binary, file_ord int, html string, decode_error string"
_PAGES = (".xhtml", ".html", ".htm")


def _elements(text: str, name: str) -> Iterator[ElementTree.Element]:
    """All elements of a local name, in document order, whatever their namespace."""
    return (e for e in ElementTree.fromstring(text).iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2].lower() == name)


def reading_order(names: list[str], read) -> list[str]:
    """Content files: the package's spine, then pages that it doesn't name, then tables of contents; without a usable package all of them by path."""
    pages = sorted(n for n in names if n.lower().endswith(_PAGES))
    contents = sorted(n for n in names if n.lower().endswith(".ncx"))
    try:
        package = next(_elements(read("META-INF/container.xml"), "rootfile")).attrib["full-path"]
        text = read(package)
        items = {e.get("id"): e for e in _elements(text, "item") if e.get("id") and e.get("href")}
        refs = [e.get("idref") for e in _elements(text, "itemref")]
    except (KeyError, StopIteration, UnicodeDecodeError, ElementTree.ParseError):
        refs = []
    if not refs:
        return sorted(pages + contents)
    listed = [items[r] for r in refs if r in items and "html" in items[r].get("media-type", "").lower()]
    paths = [posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(e.get("href")))) for e in listed]
    order = list(dict.fromkeys(p for p in paths if p in set(names)))
    return order + [p for p in pages if p not in set(order)] + contents


def _unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path, content in zip(part["path"], part["content"]):
            book, rows = hashlib.sha256(content).hexdigest()[:16], []
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
                members = {i.filename: archive.read(i) for i in archive.infolist() if not i.is_dir()}
            except (zipfile.BadZipFile, OSError) as e:
                yield pd.DataFrame([(book, path, "", None, None, None, f"not a book: {e}")], columns=[c.split()[0] for c in MEMBERS.split(", ")])
                continue
            order = {n: k for k, n in enumerate(reading_order(list(members), lambda n, m=members: m[n].decode()))}
            for name, data in members.items():
                html = error = None
                if name in order:
                    try:
                        html = data.decode().replace("\r\n", "\n").replace("\r", "\n")
                    except UnicodeDecodeError as e:
                        error = str(e)
                rows.append((book, path, name, data, order.get(name), html, error))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBERS.split(", ")])
            frame["file_ord"] = frame["file_ord"].astype("Int32")
            yield frame


def members(spark: SparkSession, path: str) -> DataFrame:
    """All members of the books under a path; content files have file_ord (reading order) and html, or decode_error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")
    return unpacked(raw)


def unpacked(books: DataFrame) -> DataFrame:
    """The members of books (path, content)."""
    return books.mapInPandas(_unpack, MEMBERS)


def content_files(members: DataFrame) -> DataFrame:
    """(book_id, file_ord, rel_path, html, decode_error)."""
    return members.where("file_ord is not null").select("book_id", "file_ord", "rel_path", "html", "decode_error")


def toc_files(members: DataFrame) -> DataFrame:
    return members.where(F.lower("rel_path").endswith(".ncx"))


def packed(members: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, path, epub): books again, with the given files' html. The mimetype comes first and uncompressed. A book is one row, as its archive is one file."""
    new = files.select("book_id", "file_ord", F.col("html").alias("new_html"))
    rows = members.where("content is not null").join(new, ["book_id", "file_ord"], "left").select("book_id", "path", "rel_path", F.coalesce(F.col("new_html").cast("binary"), F.col("content")).alias("content"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        part = part.drop_duplicates("rel_path").sort_values("rel_path")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for first in (True, False):
                for name, data in zip(part["rel_path"], part["content"]):
                    if (name == "mimetype") == first:
                        info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                        info.compress_type = zipfile.ZIP_STORED if first else zipfile.ZIP_DEFLATED
                        archive.writestr(info, bytes(data))
        return pd.DataFrame([(part["book_id"].iloc[0], part["path"].iloc[0], out.getvalue())], columns=["book_id", "path", "epub"])

    return rows.groupBy("book_id").applyInPandas(build, "book_id string, path string, epub binary")


def written(books: DataFrame, folder: str, prefix: str) -> DataFrame:
    """Writes the books as <prefix>_<name>.epub and returns (book_id, file); by a name of its own first, so no half-written book is seen."""

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for part in parts:
            out = []
            for book, path, data in zip(part["book_id"], part["path"], part["epub"]):
                file = f"{base}/{prefix}_{posixpath.basename(path)}"
                part_file = f"{file}.{uuid.uuid4().hex}"
                with store.open_output_stream(part_file) as f:
                    f.write(data)
                store.move(part_file, file)
                out.append((book, file))
            yield pd.DataFrame(out, columns=["book_id", "file"])

    return books.mapInPandas(put, "book_id string, file string")


def from_pages(pages: DataFrame, book_id: str = "pages") -> DataFrame:
    """Web pages as the files of one book, in order of page_id."""
    return pages.select(F.lit(book_id).alias("book_id"), F.col("page_id").alias("file_ord"), F.concat(F.lit("page"), F.col("page_id"), F.lit(".html")).alias("rel_path"), F.regexp_replace("html", "\r\n?", "\n").alias("html"), F.lit(None).cast("string").alias("decode_error"))
