import gzip
import hashlib
import base64
import json
import time

import pytest

from gapcast.llm import warc

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x}</style><script>var t="</p>";</script></head>
<body><!-- <p>not this</p> --><h1>Head</h1><p>One <b>two</b>&nbsp;&copy;<br>three <a href="/x?a=1&amp;b=2" title='q>r'>link</a></p>
<img src=pic.png data-src="no.png"><p>open"""


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_pages_are_read_whole():
    text, title, links = warc.read_page(PAGE, "http://h.example/d/e")
    assert title == "A & B"
    assert text == "Head\nOne two ©\nthree link\nopen"
    assert [k["url"] for k in links] == ["http://h.example/x?a=1&b=2", "http://h.example/d/pic.png"]
    for broken in ("<script>never closed", "<!-- open", "<", "<p", "a < b > c", '<a href="x', ""):
        warc.read_page(broken, None)
    long = "<p>word</p>" * 100_000
    assert warc.read_page(long, None)[0].count("word") == 100_000


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' AS key", "'mine' AS block")
    return warc.response_records(df, "page_id", "url", "html", "2026-01-01T00:00:00Z")


def test_derived_records_are_linked(spark):
    rows = [(1, "http://h.example/a", PAGE), (2, None, None), (None, "http://h.example/b", ""), (1, "http://h.example/a", PAGE)]
    source = pages(spark, rows)
    ids = {r["key"]: r["record_id"] for r in source.collect()}
    found = warc.derivatives(source).collect()
    assert len(found) == 8
    by = {(r["key"], r["warc_type"]): r for r in found}
    for key, url, html in rows:
        meta, text = by[(key, "metadata")], by[(key, "conversion")]
        assert meta["refers_to"] == text["refers_to"] == ids[key]
        assert (meta["concurrent_to"], text["concurrent_to"]) == (text["record_id"], meta["record_id"])
        assert meta["source_payload_digest"] == text["source_payload_digest"] == sha1(html or "")
        for r in (meta, text):
            assert r["block_digest"] == sha1(r["block"]) and r["content_length"] == len(r["block"].encode()) and r["target_uri"] == url
        envelope = json.loads(meta["block"])
        assert envelope["source"]["WARC-Record-ID"] == ids[key] and envelope["http"]["status"] == "HTTP/1.1 200 OK"
        assert ["Content-Length", str(len((html or "").encode()))] in envelope["http"]["headers"]
        assert envelope["text"]["digest"] == text["block_digest"]
    assert warc.derivatives(pages(spark, [])).count() == 0


def test_records_survive_a_file(spark, tmp_path):
    made = warc.derivatives(pages(spark, [(1, "http://h.example/a", PAGE), (2, None, "é")]))
    rows = made.select("record_id", "block", warc.record_bytes().alias("raw")).collect()
    parsed = list(warc.parse_records(b"".join(bytes(r["raw"]) for r in rows)))
    assert [(f["warc-record-id"], b.decode()) for f, b in parsed] == [(r["record_id"], r["block"]) for r in rows]
    http = b"HTTP/1.1 200 OK\r\nX-A: b\r\n\r\n<p>hello"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://h.example/\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nContent-Length: {len(http)}\r\n\r\n"
    record = head.encode() + http + b"\r\n\r\n"
    other = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(other) + gzip.compress(record) + gzip.compress(record))
    (tmp_path / "b.warc").write_bytes(record)
    read = warc.read_responses(spark, str(tmp_path))
    assert read.count() == 3
    text = warc.derivatives(read).where("warc_type = 'conversion'").first()
    assert text["block"] == "hello" and text["refers_to"] == "<urn:uuid:1>"


def test_elements_left_open_or_closed_in_themselves_hide_nothing():
    page = '<p>one</p><svg width="1"/><p>two <a href="/x">x</a></p><svg><a href="/in"><text>no</text></a></svg><p>three</p>'
    text, _, links = warc.read_page(page, "http://h.org/")
    assert text == "one\ntwo x\nthree" and [k["url"] for k in links] == ["http://h.org/x", "http://h.org/in"]
    for name in ("svg", "noscript", "template", "object", "iframe", "textarea"):
        text, _, links = warc.read_page(f'<p>one</p><{name}><p>two</p><{name}><img src="i.png">three', "http://h.org/")
        assert text == "one\ntwo\nthree" and [k["url"] for k in links] == ["http://h.org/i.png"]
    page = '<noscript><object data="o"><img src="a.png"></object><!-- <a href="no"> --></noscript><iframe><a href="b">b</a></iframe>end'
    text, _, links = warc.read_page(page, "http://h.org/")
    assert text == "end" and [k["path"] for k in links] == ["IMG@/src", "A@/href"]
    assert warc.read_page("<p>one</p><style>.a {} <p>two", None)[0] == "one"


@pytest.mark.parametrize("shape", ["<a", "<a href ", '<a "', "<a '", "<!", "</title", "<title>", "<svg><p", "<!--", "&lt;", '<a "<b\'', "<script "])
def test_a_megabyte_of_broken_markup_takes_linear_time(shape):
    started = time.perf_counter()
    for end in ("", ">", '">'):
        warc.read_page(shape * ((1 << 20) // len(shape)) + end, "http://h.example/")
    assert time.perf_counter() - started < 9


def test_broken_tags_are_text_and_the_next_ones_are_read():
    text, _, links = warc.read_page('<p>one <b two <i>three</i> <a href="x<y">four</a> <!-- open', None)
    assert text == "one <b two three four" and [k["url"] for k in links] == ["x<y"]


def test_charsets_encodings_and_source_headers_are_kept(spark, tmp_path):
    pages = {
        "latin": ("text/html; charset=ISO-8859-1", None, "<p>caf\u00e9</p>".encode("latin-1")),
        "gzip": ("text/html; charset=utf-8", "gzip", gzip.compress("<p>\u00fcber</p>".encode())),
        "odd": ("text/html; charset=no-such", None, "<p>\u00e4</p>".encode()),
    }
    raw = b""
    for name, (kind, encoding, body) in pages.items():
        http = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n" + (f"Content-Encoding: {encoding}\r\n" if encoding else "")
        block = http.encode() + b"\r\n" + body
        stated = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{name}>\r\nWARC-IP-Address: 10.0.0.1\r\n"
        head += f"WARC-Payload-Digest: {stated}\r\nContent-Length: {len(block)}\r\n\r\n"
        raw += head.encode() + block + b"\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(raw))
    found = warc.derivatives(warc.read_responses(spark, str(tmp_path))).collect()
    texts = {r["key"]: r["block"] for r in found if r["warc_type"] == "conversion"}
    assert texts == {"<urn:latin>": "caf\u00e9", "<urn:gzip>": "\u00fcber", "<urn:odd>": "\u00e4"}
    for r in found:
        body = pages[r["key"][5:-1]][2]
        assert r["source_payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        if r["warc_type"] == "metadata":
            source = json.loads(r["block"])["source"]
            assert source["WARC-IP-Address"] == "10.0.0.1" and not any(k.startswith("Declared") for k in source)
