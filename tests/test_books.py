import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators.store import Store, all_done, chunk_detail, listed, pending, progress, reassembled, with_status
from tessera.operators.translate import FakeBackend
from tessera.plans import translation
from tessera.sources import epub

PAGE = "<html><body><p>Hello <b>big</b> world</p><p>Two</p></body></html>"


def book(path, name, package=True, broken=False):
    with zipfile.ZipFile(f"{path}/{name}.epub", "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        if package:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile media-type="x" full-path="OPS/p.opf"/></rootfiles></container>')
            items = '<item id="b" href="b%20b.xhtml" media-type="application/xhtml+xml"/><item href="a.xhtml" id="a" media-type="application/xhtml+xml"/><item id="c" href="c.css" media-type="text/css"/>'
            z.writestr("OPS/p.opf", f'<package><manifest>{items}</manifest><spine toc="n"><itemref idref="b"/><itemref linear="no" idref="a"/><itemref idref="c"/><itemref idref="b"/></spine></package>')
        z.writestr("OPS/a.xhtml", PAGE.replace("Hello", name))
        z.writestr("OPS/b b.xhtml", b"\xff\xfe" if broken else PAGE.replace("\n", "\r\n"))
        z.writestr("OPS/nav.html", "<p>Nav</p>")
        z.writestr("OPS/toc.ncx", "<ncx><text>One</text><text>Two</text></ncx>")
        z.writestr("OPS/c.css", "p {}")


def test_reading_order(spark, tmp_path):
    book(tmp_path, "one")
    book(tmp_path, "two", package=False)
    book(tmp_path, "three", broken=True)
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    members = epub.members(spark, str(tmp_path)).cache()
    names = lambda name: [r.rel_path for r in epub.content_files(members.where(F.col("path").endswith(f"{name}.epub"))).orderBy("file_ord").collect()]
    assert names("one") == ["OPS/b b.xhtml", "OPS/a.xhtml", "OPS/nav.html", "OPS/toc.ncx"]
    assert names("two") == ["OPS/a.xhtml", "OPS/b b.xhtml", "OPS/nav.html", "OPS/toc.ncx"]
    assert members.where("decode_error is not null and file_ord is not null").count() == 1
    assert members.where(F.col("path").endswith("bad.epub")).first()["decode_error"].startswith("not a book")
    assert epub.toc_files(members).count() == 3


@pytest.mark.parametrize("mode", ["anchor", "direct"])
def test_prepare_translate_resume_export(spark, tmp_path, mode):
    source = tmp_path / "in"
    source.mkdir()
    book(source, "one")
    members = epub.members(spark, str(source)).cache()
    store = Store(spark, str(tmp_path / "store"))
    chunks = translation.prepare(store, epub.content_files(members), mode, 20)
    ident = members.first()["book_id"]
    assert store.usable(ident) and not store.usable("other")
    n = chunks.count()
    assert n > 4 and not all_done(chunks, store.results())
    calls = tmp_path / "calls"
    calls.mkdir()

    def counted(chunk, text, inner=FakeBackend(("none", "error", "none")), calls=str(calls)):
        open(f"{calls}/{chunk}-{os.urandom(4).hex()}", "w").close()
        return inner(chunk, text)

    first = translation.translate(store, counted, mode=mode)
    failed = first.where("error_type = 'api_error'").count()
    assert first.count() == n and failed == len([c for c in range(n) if c % 3 == 1]) and len(list(calls.iterdir())) == n
    again = translation.translate(store, FakeBackend(), mode=mode)
    assert again.where("error_type <> 'ok'").count() == 0 and again.where("attempt = 1").count() == failed
    assert all_done(chunks, store.results()) and pending(chunks, store.results()).isEmpty()
    out = translation.export(store, mode=mode)
    want = {r.file_ord: r.html for r in store.read("files").where("html is not null").collect()}
    got = {r.file_ord: r.html for r in out.collect()}
    assert {k: v.rstrip("\n") for k, v in got.items()} == {k: v.rstrip("\n") for k, v in want.items()}
    books = epub.packed(members, out)
    written = epub.written(books, str(tmp_path / "out"), "translated").collect()
    archive = zipfile.ZipFile(written[0]["file"])
    assert archive.infolist()[0].filename == "mimetype" and archive.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert archive.read("OPS/a.xhtml").decode().rstrip("\n") == got[1].rstrip("\n") and archive.read("OPS/c.css") == b"p {}"
    assert len(archive.namelist()) == len(zipfile.ZipFile(io.BytesIO((source / "one.epub").read_bytes())).namelist())
    if mode == "anchor":
        store.edit(ident, 0, "<1>Hand <t1>made</t1></1>", chunks.where("chunk_id = 0").first()["n_blocks"])
        row = store.results().where("chunk_id = 0").first()
        assert row.attempt >= 1 and row.trans.startswith("<1>Hand")
        text = translation.export(store, "bilingual").orderBy("file_ord").first()["html"]
        assert "Hello" in text and "Hand" in text
        rows = reassembled(chunks, store.results())
        assert with_status(rows, "translated").count() == n and progress(rows).count() >= 1 and listed(rows).count() == n
        assert chunk_detail(rows, 0).first()["tokens"]
        targets = chunks.where("chunk_id = 1").select("book_id", "chunk_id")
        assert translation.translate(store, FakeBackend(), targets=targets).where("chunk_id = 1").first()["attempt"] >= 1
    store.purge()
    assert not store.has("results")


def test_stream_ingest(spark, tmp_path):
    from tessera.streaming.ingest import ingest

    spark.createDataFrame([(1, "u", "<p>a <b>b</b></p><p>c</p>"), (2, "u", "-")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/in")
    ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("line_idx").collect()
    assert [r.text for r in got] == ["<t1>a <t2>b</t2></t1>", "<t1>c</t1>"]
    ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
