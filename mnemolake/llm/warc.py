"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response yields two records that refer to it: a ``metadata`` record (application/warc-fields: title, language,
charset, links, the source's HTTP headers and digests) and a ``conversion`` record (text/plain) of its text. Both name
the response's record id in WARC-Refers-To, keep its target URI and date, and carry their own block digest; record ids
derive from the response's id, so reruns agree.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
_BREAKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer blockquote pre hr main aside form dd dt dl body".split())
#: Elements whose content is not text; what stands in a head is skipped up to the first tag that cannot stand there.
_SKIPPED = frozenset(("script", "style", "noscript", "template"))
_IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template object".split())
_TAG = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>|<[!?][^>]*>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_END = {name: re.compile("</" + name, re.I | re.A) for name in (*_SKIPPED, "title")}
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)
_SPACE = re.compile(r"[^\S\n]+")


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers).encode("utf-8", "replace")
        return VERSION + b"\r\n" + head + b"\r\n" + self.block + b"\r\n\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, block: bytes, content_type: str, extra: list[tuple[str, str]]) -> Record:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *extra, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return Record([(k, " ".join(v.split())) for k, v in head], block)


def members(data: bytes) -> bytes:
    """The plain bytes of a file of gzip members, each of a record as a rule; other bytes as they are.

    A torn or broken member ends the file with what came out of it.
    """
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(31)
        try:
            out.append(unpack.decompress(data))
            out.append(unpack.flush())
        except zlib.error:
            break
        data = unpack.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[Record]:
    """Records of a WARC file, plain or gzipped; a torn last record is left out.

    A record without a length that is a number cannot be parted from the next: it is left out, and reading goes on at the
    next line that begins a record.
    """
    data, at = members(data), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)]
        length = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not (length.isascii() and length.isdigit()):
            at = data.find(b"\nWARC/", end)
            if at < 0:
                return
            at += 1
            continue
        block = data[end + 4 : end + 4 + int(length)]
        if len(block) < int(length):
            return
        yield Record(headers, block)
        at = end + 4 + int(length)


def response(page_id: int | None, url: str | None, body: str | None, date: str) -> Record:
    """The response record that a fetched page stands for; its id derives from the page's id, address and content."""
    payload = (body or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    marked = digest(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url or ''} {marked}")
    return record("response", f"<urn:uuid:{name}>", block, "application/http; msgtype=response", [("WARC-Target-URI", url or ""), ("WARC-Date", date), ("WARC-Payload-Digest", marked)])


@dataclass
class Page:
    """What one pass over a page's markup gives."""

    text: str = ""
    title: str = ""
    language: str = ""
    links: list[str] = field(default_factory=list)


def scan(body: str) -> Page:
    """Reads a page once from left to right, in time linear in its length.

    Comments, scripts, styles, templates and heads are no text; a tag without its end is text; block tags part lines. A
    head that is not closed ends at the first tag that cannot stand in one.
    """
    page, parts, at, n = Page(), [], 0, len(body)
    in_head, unclosed = False, set()
    # Behind the last sign that ends a tag there is none; so the pattern below never searches in vain twice.
    last, comments = body.rfind(">") + 1, body.rfind("-->")
    while (m := _TAG.search(body, at, last)) is not None:
        opened, closed = m.span()
        if opened > at and not in_head:
            parts.append(body[at:opened])
        at, name = closed, m[2]
        if name is None:
            if m[0] == "<!--":
                end = body.find("-->", closed) if closed <= comments else -1
                at = n if end < 0 else end + 3
                if not in_head:
                    parts.append(" ")
            continue
        name, closing = name.lower(), m[1]
        if in_head and (name == "head" if closing else name not in _IN_HEAD):
            in_head = False
        if closing:
            if name in _BREAKS and not in_head:
                parts.append("\n")
        elif name == "a":
            href = next((v for k, *v in _ATTRIBUTE.findall(m[0], m.end(2) - opened) if k.lower() == "href" and any(v)), None)
            if href:
                page.links.append(html.unescape("".join(href)))
        elif name in _BREAKS:
            if not in_head:
                parts.append("\n")
        elif name == "html" and not page.language:
            page.language = next(("".join(v) for k, *v in _ATTRIBUTE.findall(m[0], m.end(2) - opened) if k.lower() == "lang"), "")
        elif name == "head":
            in_head = True
            parts.append(" ")
        elif name in _SKIPPED or name == "title":
            ending = None if name in unclosed else _END[name].search(body, at)
            end = -1 if ending is None else ending.start()
            if ending is None:  # nor will a later one be closed
                unclosed.add(name)
            if name == "title" and not page.title:
                page.title = html.unescape(body[at : n if end < 0 else end])
            if name in _SKIPPED or in_head:
                stop = n if end < 0 else body.find(">", end)
                at = n if stop < 0 else stop + (end >= 0)
                if not in_head:
                    parts.append(" ")
    if not in_head:
        parts.append(body[at:])
    lines = (_SPACE.sub(" ", line).strip() for line in html.unescape("".join(parts)).split("\n"))
    page.text = "\n".join(line for line in lines if line)
    return page


def plain_text(body: str) -> str:
    """The visible text of a page, a line per block."""
    return scan(body).text


def _decoded(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The payload without chunks and compression; bytes that do not hold what the headers say stay as they are."""
    said = lambda name: next((v.lower() for k, v in headers if k.lower() == name), "")
    if "chunked" in said("transfer-encoding"):
        out, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            size = payload[at:end].split(b";")[0].strip()
            try:
                n = int(size, 16)
            except ValueError:
                out = [payload] if not out else [*out, payload[at:]]
                break
            if n <= 0:
                break
            out.append(payload[end + 2 : end + 2 + n])
            at = end + 2 + n + 2
        else:
            out = out or [payload]
        payload = b"".join(out)
    for coding in reversed([c.strip() for c in said("content-encoding").split(",")]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            unpack = zlib.decompressobj(bits)
            try:
                payload = unpack.decompress(payload) + unpack.flush()
                break
            except zlib.error:
                continue
    return payload


def _text(payload: bytes, charset: str) -> tuple[str, str]:
    """(charset, text); an unknown or unfit charset counts as UTF-8."""
    try:
        if codecs.lookup(charset)._is_text_encoding:
            return charset, payload.decode(charset, "replace")
    except (LookupError, ValueError):  # of the latter are all errors of Unicode
        pass
    return "utf-8", payload.decode("utf-8", "replace")


def derive(source: Record) -> tuple[Record, Record] | None:
    """(metadata, conversion) of a response record; None for any other record."""
    if (source.get("WARC-Type") or "").lower() != "response":
        return None
    head, _, payload = source.block.partition(b"\r\n\r\n")
    status, *http = head.decode("latin-1").split("\r\n")
    http_headers = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in http) if k]
    content_type = next((v for k, v in http_headers if k.lower() == "content-type"), "")
    payload_digest = source.get("WARC-Payload-Digest") or digest(payload)
    plain = _decoded(payload, http_headers)
    charset = (_CHARSET.search(content_type) or _CHARSET.search(plain[:1024].decode("latin-1")) or [None, "utf-8"])[1]
    charset, body = _text(plain, charset)
    page = scan(body)
    source_id, uri, date = (source.get(n) or "" for n in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    linked = [("WARC-Refers-To", source_id), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    fields = [
        ("sourceStatus", status), *((f"sourceHeader-{k}", v) for k, v in http_headers), ("sourcePayloadDigest", payload_digest), ("sourceBlockDigest", source.get("WARC-Block-Digest") or digest(source.block)),
        ("charset", charset), ("title", page.title), ("language", page.language), *(("outlink", link) for link in page.links),
    ]
    listed = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode("utf-8", "replace")
    text = page.text.encode("utf-8", "replace")
    named = lambda kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source_id}')}>"
    metadata = record("metadata", named("metadata"), listed, "application/warc-fields", linked)
    conversion = record("conversion", named("conversion"), text, "text/plain; charset=utf-8", [*linked, ("WARC-Source-Payload-Digest", payload_digest)])
    return metadata, conversion


_COLUMNS = ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "source_payload_digest", "block_digest")
SCHEMA = "key long, " + ", ".join(f"{c} string" for c in _COLUMNS) + ", content_length long, block string, record binary"
#: Bytes of records that a task holds before it passes them on.
_HELD = 8 << 20


def _row(source: Record, r: Record, with_record: bool) -> tuple:
    names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type")
    source_digest = source.get("WARC-Payload-Digest") or digest(source.block.partition(b"\r\n\r\n")[2])
    return (*(r.get(n) for n in names), source_digest, r.get("WARC-Block-Digest"), len(r.block), r.block.decode("utf-8", "replace"), r.to_bytes() if with_record else None)


def _derived(with_record: bool, date: str | None):
    names = ["key", *_COLUMNS, "content_length", "block", "record"]
    types = [pa.int64(), *[pa.string()] * len(_COLUMNS), pa.int64(), pa.string(), pa.binary()]

    def emit(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                sources = parse(row[1] or b"") if date is None else [response(*row, date)]
                for source in sources:
                    for r in derive(source) or ():
                        out.append((row[0], *_row(source, r, with_record)))
                        held += len(r.block)
                        if len(out) >= 2000 or held > _HELD:
                            yield emit(out)
                            out, held = [], 0
            if out:
                yield emit(out)

    return run


def derivatives(warcs: DataFrame, key_col: str = "key", warc_col: str = "content", with_record: bool = True) -> DataFrame:
    """Derived records of WARC bytes, plain or gzipped (as the ``binaryFile`` source reads them), two rows per response.

    ``record`` is the whole derived WARC record. Null and empty bytes, records other than responses, records without a
    length and a torn last record give nothing; bodies are taken out of chunks, gzip and deflate.
    """
    return warcs.select(F.col(key_col).cast("long"), F.col(warc_col).cast("binary")).mapInArrow(_derived(with_record, None), SCHEMA)


def page_derivatives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", with_record: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Derived records of the response record that each page stands for: two rows per row of ``pages``.

    A null id, url or html counts as empty. Record ids derive from all three: pages that differ in any have their own,
    rows repeated in all give equal records. An empty table gives none.
    """
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    derived = rows.mapInArrow(_derived(with_record, date), SCHEMA).withColumnRenamed("key", "page_id")
    return derived if with_record else derived.drop("record")
