"""WARC derivatives: linked metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcast.llm.labelled import slices

# Elements whose content is no text, and elements that end a line of text (fixed values of HTML).
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title"}
MARKED_UP = {"noscript", "template", "svg", "iframe", "object"}  # of these, elements whose content can hold links
LINES = set(
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
TAG = re.compile(r"<!--|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+)>|<[!?][^>]*+>")
LINK = re.compile(r"""(?<![\w-])(href|src)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.IGNORECASE)
CLOSE = {name: re.compile(f"</{name}[^>]*+>", re.IGNORECASE) for name in RAW}
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.IGNORECASE)
BLANKS = re.compile(r"[^\S\n]+")


def read_page(html: str, base: str | None) -> tuple[str, str | None, list[dict]]:
    """(plain text, title, links) of a page; reads it once from front to back, whatever is left open.

    A ``<`` outside quotes ends a tag that is still open: what came before is text.
    Nothing is looked for beyond the last ``>``, so the time is linear in the page.
    """
    text, title, links, at, unclosed = [], None, [], 0, set()
    limit = html.rfind(">") + 1
    while (tag := TAG.search(html, at, limit)) is not None:
        text.append(html[at : tag.start()])
        at = tag.end()
        if tag[0] == "<!--":
            end = html.find("-->", at)
            at = len(html) if end < 0 else end + 3
            continue
        name = (tag[2] or "").lower()
        if name in LINES:
            text.append("\n")
        if not name or tag[1]:
            continue
        for found in LINK.finditer(tag[3]):
            url = entities.unescape(next(g for g in found.groups()[1:] if g is not None)).strip()
            links.append({"path": f"{name.upper()}@/{found[1].lower()}", "url": _absolute(base, url)})
        if name in RAW and not (name == "svg" and tag[3].endswith("/")):
            end = None if name in unclosed else CLOSE[name].search(html, at, limit)
            if name == "title" and title is None:
                title = " ".join(entities.unescape(html[at : end.start() if end else len(html)]).split())
            if end is None:
                unclosed.add(name)  # nor does any later one close: only the tags are dropped
                if name in ("script", "style"):
                    at = len(html)
                continue
            if name in MARKED_UP:
                links += read_page(html[at : end.start()], base)[2]  # holds no end tag of this name, so it nests once a name
            at = end.end()
    text.append(html[at:].partition("<!--")[0])
    lines = (BLANKS.sub(" ", line).strip() for line in entities.unescape("".join(text)).split("\n"))
    return "\n".join(line for line in lines if line), title, links


def _absolute(base: str | None, url: str) -> str:
    try:
        return urljoin(base or "", url)
    except ValueError:  # no valid address: kept as it stands
        return url


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    """A name that the same parts always get."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts, default=str))}>"


def response_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, date: str) -> DataFrame:
    """Pages as response records: (key, record_id, target_uri, date, http_headers, payload).

    The record id is derived from key, address and content, so it is the same on
    every run. Null content is an empty payload; a null address stays null.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, url_col)]
    name = F.sha2(F.concat_ws("\n", *parts, F.sha2(payload, 256)), 256)
    groups = [F.substring(name, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n"),
    )
    return pages.select(
        F.col(id_col).alias("key"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">")).alias("record_id"),
        F.col(url_col).alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
    )


FIELDS = (
    "warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, "
    "content_type string, content_length long, block_digest string, source_payload_digest string, title string, "
    "n_links long, block string"
)
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _fields(head: str | None) -> list[list[str]]:
    lines = (head or "").replace("\r\n", "\n").split("\n")
    return [[part.strip() for part in line.split(":", 1)] for line in lines if ":" in line]


def decoded(payload: bytes, headers: list[list[str]]) -> str:
    """The text of a payload by its declared content encoding and charset, UTF-8 if it names none or an unknown one.

    What does not decode is replaced; an encoding other than gzip and deflate, or a broken one, leaves the bytes as they are.
    """
    given = {name.lower(): value for name, value in headers}
    bits = {"gzip": 31, "x-gzip": 31, "deflate": 47}.get(given.get("content-encoding", "").lower())
    if bits is not None:
        with suppress(zlib.error):
            payload = zlib.decompressobj(bits).decompress(payload)
    charset = CHARSET.search(given.get("content-type", ""))
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _derive(source: str | None, uri: str | None, date: str | None, headers: str | None, fields: str | None, payload: str | bytes | None) -> list[tuple]:
    raw = payload.encode() if isinstance(payload, str) else payload or b""
    lines = [line for line in (headers or "").replace("\r\n", "\n").split("\n") if line]
    text, title, links = read_page(payload if isinstance(payload, str) else decoded(raw, _fields(headers)), uri)
    own = digest(raw)
    known = {"WARC-Type": "response", "WARC-Record-ID": source, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": own}
    carried = {name: value for name, value in _fields(fields) if name not in known}
    declared = {name: value for name, value in _fields(fields) if name == "WARC-Payload-Digest" and value != own}
    envelope = {
        "source": known | carried | {f"Declared-{name}": value for name, value in declared.items()},
        "http": {"status": lines[0] if lines else None, "headers": [line.split(": ", 1) for line in lines[1:]]},
        "html": {"title": title, "links": links},
        "text": {"digest": digest(text.encode()), "characters": len(text)},
    }
    meta_id, text_id = record_id("metadata", source, own), record_id("conversion", source, own)
    rows = []
    for kind, name, other, media, block in (
        ("metadata", meta_id, text_id, "application/json", json.dumps(envelope, ensure_ascii=False)),
        ("conversion", text_id, meta_id, "text/plain", text),
    ):
        raw = block.encode()
        rows.append((kind, name, source, other, uri, date, media, len(raw), digest(raw), own, title, len(links), block))
    return rows


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response: key, and the columns of FIELDS.

    ``responses`` has columns key, record_id, target_uri, date, http_headers and
    payload, and may have warc_headers (the source record's own header lines);
    others are not read. A binary payload is digested as it is and decoded by its
    declared content encoding and charset; a payload of text counts as UTF-8. Both records name the response in refers_to and
    each other in concurrent_to, and keep its address, date and payload digest;
    the metadata block also holds its WARC and HTTP headers, title and links (a source
    digest that does not match the payload as Declared-WARC-Payload-Digest). Null headers
    and payloads count as empty; a null address or date stays null. Repeated rows
    give repeated records with the same ids.
    """
    fields = F.col("warc_headers") if "warc_headers" in responses.columns else F.lit(None).cast("string")
    source = responses.select("payload", "key", "record_id", "target_uri", "date", "http_headers", fields.alias("warc_headers"))
    kinds = [pa.int64() if f.endswith(" long") else pa.string() for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, payloads in slices(batch, 0):
                columns = [piece.column(i).to_pylist() for i in range(2, 7)]
                made = [_derive(*row, payload) for *row, payload in zip(*columns, payloads)]
                rows = [row for pair in made for row in pair]
                at = pa.array([i for i, pair in enumerate(made) for _ in pair], pa.int64())
                values = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([piece.column(1).take(at), *values], ["key", *NAMES])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, {FIELDS}")


def record_bytes(version: str = "WARC/1.1") -> Column:
    """The whole record, as it stands in a WARC file, from the columns of ``derivatives``."""
    fields = {
        "WARC-Type": "warc_type",
        "WARC-Record-ID": "record_id",
        "WARC-Date": "date",
        "WARC-Refers-To": "refers_to",
        "WARC-Concurrent-To": "concurrent_to",
        "WARC-Target-URI": "target_uri",
        "WARC-Block-Digest": "block_digest",
        "Content-Type": "content_type",
        "Content-Length": "content_length",
    }
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in fields.items()]  # null fields have no line
    head = F.concat_ws("\r\n", F.lit(version), *lines)
    return F.concat(head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")).cast("binary")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of an uncompressed WARC file; the header lines are under ''."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)} | {"": "\n".join(lines)}
        start, size = end + 4, int(fields["content-length"])
        yield fields, data[start : start + size]
        at = start + size + 4


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (plain or gzipped), one file per task, as input of ``derivatives``.

    A file is held in memory by its task: keep files at the usual size of a gigabyte or less.
    Payloads are binary, and warc_headers has the header lines of each record as they stand.
    """
    names = ["key", "record_id", "target_uri", "date", "http_headers", "warc_headers", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                members = []
                while data[:2] == b"\x1f\x8b":
                    member = zlib.decompressobj(31)
                    members.append(member.decompress(data))
                    data = member.unused_data
                found = [(f, b) for f, b in parse_records(b"".join(members) or data) if f.get("warc-type") == "response"]
                rows = []
                for f, block in found:
                    head, _, payload = block.partition(b"\r\n\r\n")
                    name = f.get("warc-record-id")
                    rows.append((name, name, f.get("warc-target-uri"), f.get("warc-date"), head.decode("utf-8", "replace"), f[""], payload))
                columns = list(zip(*rows)) or [()] * len(names)
                kinds = [pa.string()] * (len(names) - 1) + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{name} {'binary' if name == 'payload' else 'string'}" for name in names))
