"""Web-archive derivatives: metadata and plain-text conversion records from response records.

A response yields one conversion record (the text of its HTML) and one metadata record (what its header and page say).
Both point at it by WARC-Refers-To, and carry the digests of their own blocks; the source's record headers and its block
and payload digests are kept in the metadata record's fields. Record ids are made from the source's id, so a job that runs
again makes the same records.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
RECORD = "record_id string, type string, target_uri string, date string, headers map<string,string>, block binary"
_SPACE = re.compile(r"[ \t\r\f\v ]+")
#: Codecs of text that are no charsets of pages.
NOT_CHARSETS = frozenset("idna punycode raw-unicode-escape undefined unicode-escape raw_unicode_escape unicode_escape".split())
#: Elements whose text is not content, and those that end a line.
HIDDEN = frozenset("script style noscript template iframe svg".split())
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title body html".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


class _Page(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.in_title = base, False
        self.hidden: list[str] = []  # the open elements whose text is not content
        self.waiting: list[str] = []  # their text
        self.text: list[str] = []
        self.title: list[str] = []
        self.links: list[str] = []
        self.metas: list[tuple[str, str]] = []
        self.lang = ""

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        if tag in HIDDEN:
            self.hidden.append(tag)
        self.in_title = tag == "title" or self.in_title
        if tag in BREAKS:
            self.handle_data("\n")
        if tag == "html":
            self.lang = found.get("lang", "")
        if tag == "a" and found.get("href"):
            try:
                self.links.append(urljoin(self.base, found["href"]))
            except ValueError:
                self.links.append(found["href"])
        if tag == "meta" and (found.get("name") or found.get("property")):
            self.metas.append((found.get("name") or found["property"], found.get("content", "")))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self._leave(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self._leave(tag)
        if tag == "title":
            self.in_title = False
        if tag in BREAKS:
            self.handle_data("\n")

    def _leave(self, tag):
        # with the last one of its kind, those that were opened in it and never closed end as well
        del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        if not self.hidden:
            self.waiting = []

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        else:
            (self.waiting if self.hidden else self.text).append(data)

    def parse_marked_section(self, i, report=1):
        # browsers read what the standard parser stops at as a comment
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def close(self):
        super().close()
        # an element that never ends hides nothing, unless it holds code
        if self.hidden and self.hidden[0] not in ("script", "style"):
            self.text += self.waiting


def read_page(html: str, base: str) -> _Page:
    """The page as far as the parser can read it: it takes any text, but stops where it finds itself in a state it rules out."""
    page = _Page(base)
    try:
        page.feed(html)
    except AssertionError:
        page.rawdata = ""
    page.close()
    return page


def plain(page: _Page) -> str:
    """The page's lines of text, without empty ones; runs of spaces become one."""
    lines = (_SPACE.sub(" ", line).strip() for line in "".join(page.text).split("\n"))
    return "\n".join(line for line in lines if line)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, header fields, payload) of an HTTP response; a block without a header is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n") if b"\r\n\r\n" in block else block.partition(b"\n\n")
    status, *lines = head.decode("latin-1").splitlines()
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def body(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without its transfer and content codings: chunked, gzip and deflate; whatever is not coded so stays."""
    codings = [x.strip().lower() for name in ("transfer-encoding", "content-encoding") for k, v in fields if k.lower() == name for x in reversed(v.split(","))]
    for coding in codings:
        if coding == "chunked":
            payload = _dechunked(payload)
        elif coding in ("gzip", "x-gzip", "deflate"):
            payload = _inflated(payload)
    return payload


def _dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while (end := data.find(b"\n", at)) >= 0:
        size = data[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(data[end + 1 : end + 1 + n])
        at = end + 1 + n
        at += 2 if data[at : at + 2] == b"\r\n" else data[at : at + 1] == b"\n"
    # crawlers often store the text without its chunks, under the old header; a cut-off last chunk counts as far as it goes
    return b"".join(out) if out and at >= len(data) else data


def _inflated(data: bytes) -> bytes:
    for kind in (47, -15):  # gzip and zlib by their headers, or bare
        out, rest = [], data
        try:
            while rest:
                one = zlib.decompressobj(kind)
                out.append(one.decompress(rest))
                rest = one.unused_data
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return data


def decoded(fields: list[tuple[str, str]], payload: bytes) -> tuple[str, str]:
    """(text, charset): by the header or the page itself; UTF-8 where they name none, or one that does not decode text."""
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    found = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.IGNORECASE) or re.search(rb"<meta[^>]{0,200}charset=[\"']?([\w.:-]+)", payload[:4096], re.IGNORECASE)
    name = found[1] if found else "utf-8"
    name = name.decode("ascii", "replace") if isinstance(name, bytes) else name
    try:
        if codecs.lookup(name).name not in NOT_CHARSETS:
            return payload.decode(name, "replace"), name
    except (LookupError, UnicodeError):
        pass
    return payload.decode("utf-8", "replace"), "utf-8"


def derive_one(record_id: str, uri: str, date: str, headers: dict[str, str], block: bytes) -> list[dict]:
    """The conversion and the metadata record of one response."""
    status, fields, payload = split_http(block)
    html, coding = decoded(fields, body(fields, payload))
    page = read_page(html, uri)
    text = plain(page).encode("utf-8", "replace")
    link = {"WARC-Refers-To": record_id, "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date}
    block_digest, payload_digest = headers.get("WARC-Block-Digest") or digest(block), headers.get("WARC-Payload-Digest") or digest(payload)
    conversion_id, metadata_id = urn(record_id, "conversion"), urn(record_id, "metadata")
    facts = [("source-status", status), *((f"source-http-{k.lower()}", v) for k, v in fields), *((f"source-{k.lower()}", v) for k, v in sorted(headers.items())), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("charset", coding), ("title", " ".join("".join(page.title).split())), ("lang", page.lang), *((f"meta-{k}", " ".join(v.split())) for k, v in page.metas), *(("outlink", x) for x in page.links), ("conversion", conversion_id)]
    about = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in facts).encode("utf-8", "replace")

    def record(kind: str, own: str, content: str, block: bytes, also: dict[str, str]) -> dict:
        named = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Target-URI": uri, "WARC-Date": date, **link, **also, "WARC-Block-Digest": digest(block), "Content-Type": content, "Content-Length": str(len(block))}
        return {"record_id": own, "type": kind, "target_uri": uri, "date": date, "headers": list(named.items()), "block": block}

    return [
        record("conversion", conversion_id, "text/plain; charset=utf-8", text, {"WARC-Source-Payload-Digest": payload_digest}),
        record("metadata", metadata_id, "application/warc-fields", about, {"WARC-Concurrent-To": record_id}),
    ]


_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def derive(records: DataFrame, batch_rows: int = 64) -> DataFrame:
    """Conversion and metadata records of the response records of ``records`` (columns as RECORD; others are ignored).

    Other types yield nothing. A null block counts as empty and still yields both records, as does a null address (empty);
    a null record id takes one made from address, date and block; null headers are none. Repeated rows yield repeated
    records with the same ids. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                out = []
                for r in batch.slice(start, batch_rows).to_pylist():
                    block, uri, date = r["block"] or b"", r["target_uri"] or "", r["date"] or ""
                    out += derive_one(r["record_id"] or urn(uri, date, digest(block)), uri, date, dict(r["headers"] or []), block)
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return records.filter(F.col("type") == "response").select(*[f.split()[0] for f in RECORD.split(", ")]).mapInArrow(run, RECORD)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages (page_id, url, html), with the digests that a crawler would have written."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = []
                for number, url, html in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns), strict=True):
                    payload = (html or "").encode("utf-8", "replace")
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                    headers = {"WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(payload), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)), "X-Page-Id": str(number)}
                    out.append({"record_id": urn(url or "", str(number)), "type": "response", "target_uri": url or "", "date": date, "headers": list(headers.items()), "block": block})
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return pages.select("page_id", "url", "html").mapInArrow(run, RECORD)


def dump(record: dict) -> bytes:
    """One record as bytes of a WARC file; a null block is empty, null fields are left out."""
    headers, block = dict(record["headers"] or []), record["block"] or b""
    named = {"WARC-Type": record["type"], "WARC-Record-ID": record["record_id"], "WARC-Target-URI": record["target_uri"], "WARC-Date": record["date"], **headers, "Content-Length": str(len(block))}
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file, one by one; a broken or cut-off one as far as it can be read. Plain data is one."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        one, out = zlib.decompressobj(31), []
        try:
            for at in range(0, len(data), 1 << 20):
                out.append(one.decompress(data[at : at + (1 << 20)]))
                if one.eof:
                    break
        except zlib.error:
            pass
        yield b"".join(out)
        if not one.eof:
            return
        data = data[at + min(1 << 20, len(data) - at) - len(one.unused_data) :]


def parse(data: bytes) -> Iterator[dict]:
    """Records of a WARC file's bytes, gzipped (by records, or as one) or not.

    The values of a repeated header are joined by a comma. Without a usable length, a record goes as far as the next one;
    a cut-off record has what is there.
    """
    for member in members(data):
        yield from _parse(member)


def _parse(data: bytes) -> Iterator[dict]:
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers: dict[str, str] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip()] = f"{headers[k.strip()]}, {v.strip()}" if k.strip() in headers else v.strip()
        size = headers.get("Content-Length", "")
        after = data.find(b"\r\n\r\nWARC/", end + 4)
        stop = end + 4 + int(size) if re.fullmatch("[0-9]{1,18}", size) else after if after >= 0 else len(data)
        own = {k: headers.pop(k, None) for k in ("WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "WARC-Date")}
        yield {"record_id": own["WARC-Record-ID"], "type": own["WARC-Type"], "target_uri": own["WARC-Target-URI"], "date": own["WARC-Date"], "headers": list(headers.items()), "block": data[end + 4 : stop]}
        at = data.find(b"WARC/", stop)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``, plain or gzipped; a file is read by one task."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                held = []
                for record in parse(data.as_py()):
                    held.append(record)
                    if len(held) == 64:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def serialize(records: DataFrame) -> DataFrame:
    """Every record as the bytes that a WARC file holds (column ``value``); a file is any run of them."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([dump(r) for r in batch.to_pylist()], pa.binary())], names=["value"])

    return records.select(*[f.split()[0] for f in RECORD.split(", ")]).mapInArrow(run, "value binary")
