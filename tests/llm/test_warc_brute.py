"""The WARC deriver against a plain one: pages of any soup of markup, and payloads in any encoding."""

import gzip
import html as htmllib
import os
import random
import re
import zlib

import pytest

from codeloom.llm import warc

SF = "/root/testdata/sf0.001"
HIDDEN = ("noscript", "script", "style", "template", "title")
BREAKS = ("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer blockquote pre hr body main aside form dd dt dl").split()


def attributes(html, at):
    """[(name, value, where it ends)] from ``at``, and where the tag ends: None if a quote or the page never ends."""
    out = []
    while True:
        while html[at:at + 1].isspace() or html[at:at + 1] == "/":
            at += 1
        if at >= len(html):
            return out, None
        if html[at] == ">":
            return out, at
        end = at + 1
        while html[at] != "=" and end < len(html) and not html[end].isspace() and html[end] not in "=>/":
            end += 1
        name, at = html[at:end], end
        after = at
        while html[after:after + 1].isspace():
            after += 1
        if html[after:after + 1] != "=":
            continue
        at = after + 1
        while html[at:at + 1].isspace():
            at += 1
        if html[at:at + 1] in ("'", '"'):
            close = html.find(html[at], at + 1)
            if close < 0:
                return out, None
            value, at = html[at + 1:close], close + 1
        else:
            end = at
            while end < len(html) and not html[end].isspace() and html[end] != ">":
                end += 1
            value, at = html[at:end], end
        out.append((name, value, at))


def plain_page(html):
    """(text, title, links), looking for everything from every place anew."""
    pieces, links, title, i = [], [], None, 0
    while i < len(html):
        if html[i] != "<":
            pieces.append(html[i])
            i += 1
            continue
        if html.startswith("<!--", i) and html.find("-->", i + 4) >= 0:
            pieces.append(" ")
            i = html.find("-->", i + 4) + 3
            continue
        first = html.find(">", i)
        if first < 0 or not re.match(r"[!?/a-zA-Z]", html[i + 1:i + 2]):
            pieces.append("<")
            i += 1
            continue
        m = re.match(r"/?([a-zA-Z][^\s/>]*)", html[i + 1:])
        name, end = m[1].lower() if m else "", first
        if m and html[i + 1] != "/" and (name == "a" or "'" in html[i:first] or '"' in html[i:first]):
            found, end = attributes(html, i + 1 + m.end())
            end = first if end is None else end
            href = [(v, e) for n, v, e in found if n.lower() == "href"][:1] if name == "a" else []
            links += [x for v, e in href if e <= end and (x := re.sub(r"\s+", "%20", htmllib.unescape(v).strip()))]
        close = re.compile(rf"(?i)</{name}\s*>").search(html, end + 1) if m and html[i + 1] != "/" and name in HIDDEN else None
        if close:
            title = html[end + 1:close.start()] if name == "title" and title is None else title
            pieces.append(" ")
            i = close.end()
            continue
        pieces.append("\n" if name in BREAKS else " " if html[i + 1] == "!" else "")
        i = end + 1
    lines = (" ".join(line.split()) for line in htmllib.unescape("".join(pieces)).split("\n"))
    return "\n".join(line for line in lines if line), title, links


SIGNS = ["<a", "<a ", "<p", "<b ", "<", ">", ">", "'", '"', " ", "=", "=", "-", "!", "/", "x", "1", "href=", " href='k", ' href="q>r', "<!--", "-->", "<title>", "</title>", "<script", "</script >",
         "\n", "&amp;", "</a>", "<style>", "</"]


@pytest.mark.parametrize("seed", range(4))
def test_pages_of_random_soup(seed):
    rng = random.Random(seed)
    signs = [SIGNS, list("<a>'\" =-!/"), ["<a ", "x='", 'x="', ">", "'", '"', " href=k ", " ", "<b "], SIGNS][seed]
    for _ in range(12_000):
        page = "".join(rng.choices(signs, k=rng.randrange(1, 24)))
        got = warc.Page(page)
        assert (got.text, got.title, got.links) == plain_page(page), page


def test_a_broken_tag_hides_nothing_that_follows():
    piece, rest = "<p z='q>r'>2", "<a x=\"1>" + "{}" + "\" y='"
    assert warc.Page(piece).text == "2"
    for page in (rest.format(piece), rest.format("<a href='/k?q>r'>k</a>"), "<a x=\"1>\" <a href=/k z=' >t"):
        got = warc.Page(page)
        assert (got.text, got.title, got.links) == plain_page(page)
    assert "z=" not in warc.Page(rest.format(piece)).text
    assert warc.Page(rest.format("<a href='/k?q>r'>k</a>")).links == ["/k?q>r"] and warc.Page("<a x=\"1>\" <a href=/k z=' >t").links == ["/k"]


def made(headers, body):
    head = "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    return warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], head.encode() + b"\r\n" + body)


def chunked(data, rng, end=b"0\r\n\r\n"):
    out = b""
    while data:
        n = rng.randrange(1, 9)
        out, data = out + b"%x%s\r\n" % (len(data[:n]), rng.choice([b"", b";a=b", b" "])) + data[:n] + b"\r\n", data[n:]
    return out + end


PLAIN = {"gzip": gzip.compress, "x-gzip": gzip.compress, "deflate": zlib.compress, "identity": lambda b: b, "": lambda b: b}


def test_encodings_are_taken_off_in_order():
    rng = random.Random(3)
    for _ in range(150):
        page = f"<p>text {rng.random()}</p>".encode() * rng.randrange(1, 4)
        kinds = [rng.choice([*PLAIN]) for _ in range(rng.randrange(0, 4))]
        body = page
        for k in kinds:
            body = PLAIN[k](body)
        headers = [("Content-Encoding", ", ".join(kinds))] if rng.random() < 0.5 else [("content-encoding", k) for k in kinds]
        if rng.random() < 0.5:
            body = chunked(body, rng)
            headers.append(("Transfer-Encoding", "chunked"))
        about, text = map(warc.read_record, warc.derive_record(made(headers, body)))
        assert text[1].decode() == plain_page(page.decode())[0] and warc.get(about[0], "WARC-Truncated") is None


def test_payloads_that_are_not_what_they_are_said_to_be():
    page, rng = b"<p>hello</p>" * 40, random.Random(4)
    damaged = bytearray(gzip.compress(page))
    damaged[10] = 7  # no kind of block
    bad = [([("Content-Encoding", "gzip")], bytes(damaged), "gzip"), ([("Content-Encoding", "br")], page, "unknown encoding br"), ([("Content-Encoding", "gzip, zstd")], page, "zstd"),
           ([("Content-Encoding", "gzip, gzip")], gzip.compress(page), "gzip"), ([("Content-Encoding", "gzip")], page, "gzip"), ([("Content-Encoding", "deflate")], page, "deflate"),
           ([("Transfer-Encoding", "chunked")], page, "chunk size at byte 0"), ([("Transfer-Encoding", "chunked")], b"3\r\nabc\r\nzz\r\n", "chunk size at byte 8")]
    for headers, body, reason in bad:
        with pytest.raises(ValueError, match=reason):
            warc.derive_record(made(headers, body))
    whole = chunked(page, rng)
    cut = [whole[:n] for n in (0, 1, 2, 5, 60, len(whole) - 5)] + [chunked(page, rng, b""), b"5\r\nab"]
    for body in cut:
        about, text = map(warc.read_record, warc.derive_record(made([("Transfer-Encoding", "chunked")], body)))
        assert warc.get(about[0], "WARC-Truncated") == "unspecified" == warc.get(text[0], "WARC-Truncated")
    assert warc.read_record(warc.derive_record(made([("Transfer-Encoding", "chunked")], b"5\r\nab"))[1])[1] == b"ab"
    both = warc.derive_record(made([("Content-Encoding", "gzip"), ("Transfer-Encoding", "chunked")], chunked(gzip.compress(page), rng)[:-40]))
    assert warc.get(warc.read_record(both[1])[0], "WARC-Truncated") == "unspecified"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_derivatives_of_all_pages(spark):
    """op3's rows for the given pages, as the plain deriver has them."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = warc.op3_warc_derivatives(spark, SF).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        own = pages[r.page_id]
        text, title, links = plain_page(own.html or "")
        assert r.target_uri == own.url
        if r.kind == "conversion":
            assert r.block == text
        else:
            fields = [line.partition(": ")[::2] for line in r.block.split("\r\n")]
            assert [v for k, v in fields if k == "outlink"] == list(dict.fromkeys(links))
            assert dict(fields)["title"] == " ".join(htmllib.unescape(title or "").split())
