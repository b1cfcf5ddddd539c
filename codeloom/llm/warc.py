"""WARC derivatives: response records become linked metadata and plain-text conversion records.

``responses`` stores pages as WARC/1.1 response records; ``derive`` reads response records of any origin and makes
two records of each: a ``metadata`` record (application/warc-fields: title, charset, outlinks, the HTTP status and
headers of the source, its digests and whether they hold) and a ``conversion`` record (text/plain). Both refer to
the response by WARC-Refers-To and keep its target URI and date; the metadata record names the conversion by
WARC-Concurrent-To. Record ids are name-based, so a task that runs again writes the same records. Records are
handled one by one, in the partitions in which they are read: no shuffle.

A page is read by one scanner that looks for nothing twice in vain, so its time is in proportion to the page's
length, whatever is left open in it.

Defined cases: a null html is an empty payload, a null url gives records without WARC-Target-URI, a null page_id
counts as the empty string in the record id; bytes that aren't a WARC record give one row of kind ``error`` with the
reason, and so do a damaged or torn compressed record, a payload in an unknown encoding or not in the one it is said to
be in (damaged, or no chunk size where one is due), and a compressed payload that unfolds to more than ``MOST_BYTES``
(a guard of the worker's memory); a payload that ends early, in its compression or its chunks, gives records of what
there is, with WARC-Truncated; equal rows give equal records; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html as htmllib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, text_batches

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:codeloom:warc")
#: What one compressed payload may unfold to; one of more is an error, not a prefix.
MOST_BYTES = 512 << 20
BATCH_BYTES = 8 << 20

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def write_record(headers: Headers, block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> tuple[str, Headers]:
    """First line and fields; a line that begins with a blank goes on with the field before."""
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    out: list[tuple[str, list[str]]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1][1].append(line.strip())
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), [v.strip()]))
    return lines[0], [(k, " ".join(v)) for k, v in out]


def get(headers: Headers, name: str, default: str | None = None) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), default)


def _split(data: bytes) -> tuple[bytes, bytes]:
    m = re.search(rb"\r?\n\r?\n", data)
    return (data[: m.start()], data[m.end():]) if m else (data, b"")


def read_record(data: bytes) -> tuple[Headers, bytes]:
    head, rest = _split(data)
    first, headers = _fields(head)
    if not first.startswith("WARC/"):
        raise ValueError("no WARC version line")
    length = get(headers, "Content-Length")
    if length is None or not length.isdigit():
        raise ValueError("no Content-Length")
    if int(length) > len(rest):
        raise ValueError(f"block ends {int(length) - len(rest)} bytes early")
    return headers, rest[: int(length)]


def response(page_id: str, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url or "", digest(payload)))]
    headers += [("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url))] if url is not None else []
    headers += [("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload))]
    return write_record(headers, block)


def _unfold(body: bytes, bits: int) -> tuple[bytes, bool]:
    """All members of a compressed payload, and whether its last one is complete."""
    out, size, rest, whole = [], 0, body, True
    while rest and whole:
        member = zlib.decompressobj(bits)
        try:
            part = member.decompress(rest, MOST_BYTES - size + 1)
        except zlib.error:
            if not out:
                raise
            raise ValueError(f"member {len(out) + 1} of the compressed payload is damaged") from None
        size += len(part)
        if size > MOST_BYTES:
            raise ValueError(f"the compressed payload unfolds to more than {MOST_BYTES} bytes")
        out.append(part)
        whole, rest = member.eof, member.unused_data
        if rest[:2] != b"\x1f\x8b":  # padding, or foreign bytes
            break
    return b"".join(out), whole


_CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]+)[ \t]*(?:;[^\n]*)?\r?\n")
_TORN_SIZE = re.compile(rb"[ \t]*(?:[0-9A-Fa-f]+[ \t]*(?:;[^\n]*)?\r?)?\Z")


def _unchunked(body: bytes) -> tuple[bytes, bool]:
    """The chunks' content, and whether the last one and its end are there."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        n, at = int(m[1], 16), m.end()
        if not n:
            return b"".join(out), True
        out.append(body[at:at + n])
        at += n
        if at > len(body):
            break
        at += 2 if body[at:at + 2] == b"\r\n" else body[at:at + 1] == b"\n"
    if at < len(body) and not _TORN_SIZE.match(body, at):
        raise ValueError(f"no chunk size at byte {at} of the payload")
    return b"".join(out), False


def _body(headers: Headers, body: bytes) -> tuple[bytes, bool]:
    """The payload without transfer and content encodings, the last one first, and whether it is whole. An encoding
    that is unknown, or that the payload isn't in, is an error."""
    named = ",".join(v for name in ("Content-Encoding", "Transfer-Encoding") for k, v in headers if k.lower() == name.lower())
    whole = True
    for kind in reversed([x.strip().lower() for x in named.split(",")]):
        if kind in ("", "identity"):
            continue
        if kind == "chunked":
            body, complete = _unchunked(body)
        elif kind in ("gzip", "x-gzip", "deflate"):
            for bits in (31,) if kind != "deflate" else (47, -15):
                try:
                    body, complete = _unfold(body, bits)
                    break
                except zlib.error as e:
                    wrong = e
            else:
                raise ValueError(f"the payload is no {kind}, or damaged: {wrong}")
        else:
            raise ValueError(f"unknown encoding {kind}")
        whole = whole and complete
    return body, whole


#: Codecs of Python that no page is written in, or that don't decode in linear time.
_NO_CHARSETS = {"idna", "punycode", "raw-unicode-escape", "undefined", "unicode-escape"}
_HIDDEN = {"noscript", "script", "style", "template", "title"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "header", "footer",
           "blockquote", "pre", "hr", "body", "main", "aside", "form", "dd", "dt", "dl"}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/][^\s=>/]*|=)(?:\s*=\s*(["']?))?""")
_UNQUOTED, _SPACE_RUN = re.compile(r"[^\s>]*"), re.compile(r"[\s/]*")


class Page:
    """What a page shows, its title and its links, by one pass over its characters.

    A comment, and the content of an element that isn't shown, is hidden if it is closed; a tag ends at the first
    ``>`` outside a quoted value; ``<`` before anything but a tag is text.
    """

    def __init__(self, html: str):
        self.html, self.title = html, None
        self.links: list[str] = []
        self._missing: dict[str, int] = {}
        self._unclosed: set[str] = set()
        self._endless: set[int] = set()
        pieces, at = [], 0
        while (i := html.find("<", at)) >= 0:
            pieces.append(html[at:i])
            at = self._markup(i, pieces)
        pieces.append(html[at:])
        text = htmllib.unescape("".join(pieces))
        lines = (" ".join(line.split()) for line in text.split("\n"))
        self.text = "\n".join(line for line in lines if line)

    def _find(self, sign: str, at: int) -> int:
        """Like find; where the sign is known to be missing from some place on, it is looked for before that place only."""
        known = self._missing.get(sign, len(self.html))
        found = self.html.find(sign, at, known + len(sign) - 1) if at < known else -1
        if found < 0:
            self._missing[sign] = min(at, known)
        return found

    def _markup(self, i: int, pieces: list[str]) -> int:
        """What begins with the ``<`` at i goes to ``pieces`` and links; where it ends."""
        html = self.html
        if html.startswith("<!--", i) and (end := self._find("-->", i + 4)) >= 0:
            pieces.append(" ")
            return end + 3
        follows = html[i + 1:i + 2]  # before the search for an end, which for a mere sign would be in vain
        end = self._find(">", i) if follows in ("!", "?", "/") or "a" <= follows.lower() <= "z" else -1
        if end < 0:
            pieces.append("<")
            return i + 1
        m = _NAME.match(html, i + 1)
        name = m[1].lower() if m else ""
        opens = m is not None and html[i + 1] != "/"
        if opens and (name == "a" or '"' in (tag := html[i:end]) or "'" in tag):
            end = self._attributes(m.end(), end, name == "a")
        if opens and name in _HIDDEN and (close := self._closing(name, end + 1)):
            if name == "title" and self.title is None:
                self.title = html[end + 1:close[0]]
            pieces.append(" ")
            return close[1]
        pieces.append("\n" if name in _BREAKS else " " if html.startswith("<!", i) else "")
        return end + 1

    def _closing(self, name: str, at: int) -> tuple[int, int] | None:
        """Where the element's closing tag begins and ends."""
        if name in self._unclosed:  # each is looked for further on than the one before
            return None
        m = _CLOSING[name].search(self.html, at)
        if m is None:
            self._unclosed.add(name)
            return None
        return m.start(), m.end()

    def _attributes(self, at: int, first: int, link: bool) -> int:
        """Where the tag ends whose attributes begin at ``at``; the first ``>`` if its quotes never end, and then only
        what stands before it are its attributes. From where attributes were once read in vain, they are read up to
        the first ``>`` only, for the link."""
        html, target, target_end, begins, vain = self.html, None, 0, [], False
        while True:
            vain = vain or at in self._endless
            if vain and (not link or at >= first or target is not None):
                break
            m = _ATTRIBUTE.match(html, at)
            if m is None:
                break
            if not vain:
                begins.append(at)
            at = m.end()
            if m[2]:
                end = self._find(m[2], at)
                if end < 0:
                    at = len(html)
                    break
                value, at = html[at:end], end + 1
            elif m[2] == "":
                value = _UNQUOTED.match(html, at)[0]
                at += len(value)
            else:
                continue
            if link and target is None and m[1].lower() == "href":
                target, target_end = value, at
        ends = first if vain else _SPACE_RUN.match(html, at).end()
        if vain or html[ends:ends + 1] != ">":
            self._endless.update(begins)
            ends = first
        if target is not None and target_end <= ends:
            target = re.sub(r"\s+", "%20", htmllib.unescape(target).strip())
            if target:
                self.links.append(target)
        return ends


_CLOSING = {name: re.compile(rf"(?i)</{name}\s*>") for name in _HIDDEN}


def plain_text(html: str) -> str:
    """Visible text: a line per block element, blanks run together, character references resolved."""
    return Page(html).text


def outlinks(html: str) -> list[str]:
    return list(dict.fromkeys(Page(html).links))


def _decoded(payload: bytes, charset: str) -> str:
    try:
        known = codecs.lookup(charset).name not in _NO_CHARSETS
        return payload.decode(charset if known else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def derive_record(data: bytes) -> list[bytes]:
    """A response record -> its metadata and its conversion record."""
    source, block = read_record(data)
    if (get(source, "WARC-Type") or "").lower() != "response":
        raise ValueError(f"a {get(source, 'WARC-Type')} record")
    head, body = _split(block)
    status, http = _fields(head)
    payload, whole = _body(http, body)
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", get(http, "Content-Type") or "", re.I)
    charset = m[1] if m else "utf-8"
    page = Page(_decoded(payload, charset))
    origin = get(source, "WARC-Record-ID", "")
    meta_id, conv_id = record_id("metadata", origin), record_id("conversion", origin)
    kept = [(k, get(source, k)) for k in ("WARC-Target-URI", "WARC-Date")]
    links: Headers = [("WARC-Refers-To", origin), *((k, v) for k, v in kept if v is not None)]
    if kept[0][1] is not None:
        links.append(("WARC-Refers-To-Target-URI", kept[0][1]))
    if kept[1][1] is not None:
        links.append(("WARC-Refers-To-Date", kept[1][1]))
    if not whole:
        links.append(("WARC-Truncated", get(source, "WARC-Truncated") or "unspecified"))
    fields: Headers = [("title", re.sub(r"\s+", " ", htmllib.unescape(page.title or "")).strip()), ("charset", charset), ("http-status", status)]
    fields += [("http-header", f"{k}: {v}") for k, v in http]
    for name, content in (("Block", block), ("Payload", body)):
        said = get(source, f"WARC-{name}-Digest")
        if said is not None:
            fields += [(f"source-{name.lower()}-digest", said), (f"source-{name.lower()}-digest-holds", str(said == digest(content)).lower())]
    fields += [("outlink", x) for x in dict.fromkeys(page.links)]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    text = page.text.encode("utf-8", "replace")
    metadata = [("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *links, ("WARC-Concurrent-To", conv_id), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(about))]
    conversion = [("WARC-Type", "conversion"), ("WARC-Record-ID", conv_id), *links, ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(text))]
    return [write_record(metadata, about), write_record(conversion, text)]


# --- Spark --------------------------------------------------------------------------------------

_RECORD = "page_id long, record binary"
_ROW = ("page_id long, kind string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, "
        "content_type string, content_length long, block_digest string, block string, record binary")
_ARROW = pa.schema([("page_id", pa.int64()), *((k, pa.string()) for k in ("kind", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type")),
                    ("content_length", pa.int64()), ("block_digest", pa.string()), ("block", pa.string()), ("record", pa.binary())])


def _respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html", BATCH_BYTES):
        part = [response("" if p is None else str(p), u, h) for p, u, h in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, type=pa.binary())], ["page_id", "record"])


def _inflated(record: bytes) -> bytes:
    """A record, which may be compressed."""
    if record[:2] != b"\x1f\x8b":
        return record
    try:
        data, whole = _unfold(record, 31)
    except zlib.error as e:
        raise ValueError(f"the compressed record is damaged: {e}") from None
    if not whole:
        raise ValueError("the compressed record ends early")
    return data


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Concurrent-To", "WARC-Target-URI", "WARC-Date", "Content-Type")
    rows, held = [], 0
    for batch in batches:
        for page, record in zip(batch.column(0), batch.column(1)):
            page = page.as_py()
            try:
                made = derive_record(_inflated(record.as_py() or b""))
            except ValueError as e:
                rows.append(dict(page_id=page, kind="error", block=str(e)))
                continue
            for out in made:
                headers, block = read_record(out)  # what the row says is read back from the record
                rows.append(dict(zip(_ARROW.names, (page, *(get(headers, k) for k in names), len(block), get(headers, "WARC-Block-Digest"), block.decode(), out))))
                held += 2 * len(out)
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, record): WARC response records."""
    text_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_respond, _RECORD)


def derive(records: DataFrame) -> DataFrame:
    """(page_id, record) -> two rows each: the metadata and the conversion record, with their headers as columns."""
    return records.select("page_id", "record").mapInArrow(_derive, _ROW)


# --- op3 ----------------------------------------------------------------------------------------

def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("record")
