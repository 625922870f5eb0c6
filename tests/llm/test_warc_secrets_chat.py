import gzip
import hashlib
import io
import re

import pytest

from tessera.llm import preferences, secret_scan, warc


def brute_pages(rows):
    best = {}
    for i, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        to = best.get(h)
        revisit = i is not None and to is not None and to != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_archives_round_trip(spark):
    big = "<p>é</p>\r\n\r\n" * 200
    rows = [(1, big), (2, big), (3, "small"), (4, "small"), (5, None), (6, ""), (7, big), (7, big), (None, big), (8, "x" * 999), (9, "x" * 999), (10, "y" * 1000), (11, "y" * 1000), (12, "z" * 300000)]
    pages = spark.createDataFrame([(i, f"http://x/%0A\n{i}" if n % 2 else None, h, "clash") for n, (i, h) in enumerate(rows)], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.round_trip(pages, archive_bytes=400).collect()
    assert order(tuple(r) for r in got) == order(brute_pages(rows))
    manifest = warc.write(pages, warc.shared_dir(spark, "t"))
    full = warc.read(spark, manifest, payloads=True).collect()
    assert order((r.url, r.html or "") for r in full if r.record_type == "response") == order((f"http://x/%0A\n{i}" if n % 2 else "", h or "") for n, (i, h) in enumerate(rows) if i not in (1, 2, 10))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_reader_rejects_damage():
    a, b = warc.member(1, "u", b"hello", None), warc.member(2, "u", b"hello", 1)
    assert [warc.page(r)[0] for r in warc.records(io.BytesIO(a + b))] == [1, 2]
    plain = gzip.decompress(a)
    assert plain.count(b"\r\n\r\n") == 3
    for bad in (a[:-3], a + b"junk", gzip.compress(plain.replace(b"hello", b"hellO")), gzip.compress(plain[:-1]), gzip.compress(b"x")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(bad)))


def brute_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end()))
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_secrets_against_plain_patterns(spark):
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = body + secret_scan.checksum(body)
    texts = [
        None, "", "token", "é PassWord' : \"abc.def=gh\" ü", "token=abc token=secret=abcdefgh", "secret: token: abcdefg", "API_KEY==xxxxxxx apikey:1234567", "ſecret=abcdefgh toKen=abcdefgh",
        "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "Z9" * 10, "akia" + "A" * 20, "f" * 24, "0" * 23, "F" * 30 + "é" + "deadbeef" * 4, "token=" + "ab12" * 9, "pass", "word: abcdefgh" , "abcdef012345", "6789abcdef01",
        f"x ghp_{good} npm_{good}, ghp_{good}x", f"gho_{body}AAAAAA", "token" * 50 + "=abcdefg", "q" * 100000 + " password = hunter22",
    ]
    docs = spark.createDataFrame([(i % 7, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, spans string").coalesce(1)
    got = secret_scan.scanned(docs).collect()
    for t, r in zip(texts, got):
        assert [tuple(s) for s in r.spans if s.kind in secret_scan.BASE_KINDS] == brute_secrets(t), t
    extra = [tuple(s) for r in got for s in r.spans if s.kind not in secret_scan.BASE_KINDS]
    assert extra == [("github", 2, 42), ("npm", 43, 83)]
    assert secret_scan.scanned(docs.limit(0)).count() == 0


def brute_pair(chosen, rejected):
    show = lambda t: f"<|{t[0] or ''}|>\n{t[1] or ''}\n"
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def side(turns):
        at, text, mask = 0, "", []
        for t in turns[n:]:
            text += show(t)
            if t[0] == "assistant":
                mask.append((at + len("assistant") + 5, len(text)))
            at = len(text)
        return text, mask

    (c, cm), (r, rm) = side(chosen), side(rejected)
    return n, "".join(map(show, chosen[:n])), c, r, cm, rm


def test_preferences(spark):
    u, a = lambda x: ("user", x), lambda x: ("assistant", x)
    pairs = {
        1: ([u("q"), a("good")], [u("q"), a("bad é")]), 2: ([u("q")], [u("q")]), 3: ([a("x"), u("y"), a("z")], [a("w")]), 4: ([u("q"), a("one"), u("r"), a("two")], [u("q"), a("one")]),
        5: ([("", ""), a("")], []), 6: ([u("w " * 20000), a("s")], [u("w " * 20000), a("t")]),
    }
    rows = [(i, side, n, r or None, t or None, "x") for i, both in pairs.items() for side, turns in zip(("chosen", "rejected"), both) for n, (r, t) in enumerate(turns)]
    rows += [(None, "chosen", 0, "user", "x", "x"), (1, None, 0, "user", "x", "x")]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string, chosen string")
    got = {r.pair_id: r for r in preferences.formatted(df).collect()}
    assert set(got) == set(pairs)
    for i, both in pairs.items():
        r = got[i]
        assert (r.n_prefix, r.prompt, r.chosen, r.rejected, [tuple(x) for x in r.chosen_mask], [tuple(x) for x in r.rejected_mask]) == brute_pair(*both)
    assert preferences.formatted(df.limit(0)).count() == 0


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "user", "p"), (1, 1, "assistant", "old"), (1, 2, "user", "r"), (1, 3, "assistant", "a1"), (2, 0, "user", "z"), (3, 0, "assistant", "a3")]
    df = preferences.swapped_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.pair_id: (r.n_prefix, r.chosen, r.rejected) for r in preferences.formatted(df).collect()}
    assert got == {0: (1, "<|assistant|>\na0\n", "<|assistant|>\na1\n"), 1: (3, "<|assistant|>\na1\n", "<|assistant|>\na0\n")}
