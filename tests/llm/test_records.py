"""WARC, MPEG audio, chat formatting and mixing: round trips and brute force."""

import base64
import gzip
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import chat_format, mixing, mpeg_audio, warc

# --- WARC ---------------------------------------------------------------------------------------

HTML = ("<!DOCTYPE html><html><head><title>A &amp;\n B</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- no -->"
        "<p>One <b>two</b>&nbsp;three<br>four</p><a href='/x'>link</a><a href=\"/x\">again</a><a href=y>z</a> 1 < 2</body></html>")


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_derivatives():
    record = warc.response("7", "http://example.com/a", HTML)
    source, block = warc.read_record(record)
    assert warc.get(source, "warc-payload-digest") == sha1(HTML.encode()) and warc.get(source, "WARC-Block-Digest") == sha1(block)
    meta, conv = (warc.read_record(r) for r in warc.derive_record(record))
    origin = warc.get(source, "WARC-Record-ID")
    for headers, body in (meta, conv):
        assert warc.get(headers, "WARC-Refers-To") == origin and warc.get(headers, "WARC-Target-URI") == "http://example.com/a"
        assert warc.get(headers, "WARC-Block-Digest") == sha1(body) and warc.get(headers, "WARC-Date") == warc.DATE
    assert warc.get(meta[0], "WARC-Concurrent-To") == warc.get(conv[0], "WARC-Record-ID") != origin
    fields = meta[1].decode().split("\r\n")
    assert "title: A & B" in fields and "outlink: /x" in fields and "outlink: y" in fields and fields.count("outlink: /x") == 1
    assert "source-payload-digest-holds: true" in fields and "source-block-digest-holds: true" in fields
    assert "http-header: Content-Type: text/html; charset=utf-8" in fields and "http-status: HTTP/1.1 200 OK" in fields
    assert conv[1].decode() == "One two three\nfour\nlinkagainz 1 < 2"
    assert warc.derive_record(record) == warc.derive_record(record)


def made(http, body, **more):
    block = http.encode() + b"\r\n\r\n" + body
    return warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), *more.items()], block)


@pytest.mark.parametrize("http, body", [
    ("HTTP/1.1 200 OK\r\nContent-Encoding: gzip", gzip.compress(b"<p>hi</p>")), ("HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked", b"4\r\n<p>h\r\n5\r\ni</p>\r\n0\r\n\r\n"),
    ("HTTP/1.1 200 OK\r\nContent-Type: text/html;\r\n charset=latin-1", "<p>hi</p>".encode("latin-1")), ("HTTP/1.1 200 OK\r\nContent-Type: x; charset=nonsense", b"<p>hi</p>"),
    ("HTTP/1.1 200 OK\r\nContent-Encoding: deflate", zlib.compress(b"<p>hi</p>"))])
def test_warc_encodings(http, body):
    assert warc.read_record(warc.derive_record(made(http, body))[1])[1] == b"hi"


def test_compressed_payloads_are_read_whole_or_told(monkeypatch):
    http, page = "HTTP/1.1 200 OK\r\nContent-Encoding: gzip", b"<p>hi</p>" * 20
    two = [warc.read_record(r) for r in warc.derive_record(made(http, gzip.compress(page) + gzip.compress(b"<p>you</p><a href=z>") + b"\0" * 8))]
    assert two[1][1] == b"hi\n" * 20 + b"you" and b"outlink: z" in two[0][1] and warc.get(two[0][0], "WARC-Truncated") is None
    for headers, _ in map(warc.read_record, warc.derive_record(made(http, gzip.compress(page)[:-12]))):
        assert warc.get(headers, "WARC-Truncated") == "unspecified"
    rows = lambda body: next(warc._derive(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([made(http, body)])], ["page_id", "record"])]))).to_pylist()
    monkeypatch.setattr(warc, "MOST_BYTES", len(page))
    assert [r["kind"] for r in rows(gzip.compress(page))] == ["metadata", "conversion"]
    for body in (gzip.compress(page + b"x"), gzip.compress(page) + gzip.compress(b"x"), gzip.compress(b"x") + b"\x1f\x8bjunk" * 9):
        assert [(r["kind"], "compressed payload" in r["block"]) for r in rows(body)] == [("error", True)]
    assert warc.read_record(warc.derive_record(made(http, b""))[1])[1] == b""


def rows_of(record):
    return [r for b in warc._derive(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([record], type=pa.binary())], ["page_id", "record"])])) for r in b.to_pylist()]


def test_torn_and_damaged_compressed_records_are_error_rows():
    whole = gzip.compress(made("HTTP/1.1 200 OK", b"<p>hi</p>" * 50))
    assert [r["kind"] for r in rows_of(whole)] == ["metadata", "conversion"]
    half = made("HTTP/1.1 200 OK", b"<p>hi</p>")
    assert [r["kind"] for r in rows_of(gzip.compress(half[:60]) + gzip.compress(half[60:]))] == ["metadata", "conversion"]
    for bad in (whole[:-12], whole[:20], whole[:2], whole[:10] + b"junk" * 20, whole[:-6] + b"\0" * 6, whole[:40] + b"\xff" * 9 + whole[49:]):
        got = rows_of(bad)
        assert [r["kind"] for r in got] == ["error"] and "compressed record" in got[0]["block"]


def test_a_payload_over_64_mb_is_read_whole():
    page = b"<p>" + b"word " * (14 << 20) + b"</p><a href=last>end</a>"
    for http, body in (("HTTP/1.1 200 OK\r\nContent-Encoding: gzip", gzip.compress(page, 1)), ("HTTP/1.1 200 OK", page)):
        about, text = (warc.read_record(r) for r in warc.derive_record(made(http, body)))
        assert len(text[1]) == len(b"word ") * (14 << 20) - 1 + len(b"\nend") and b"outlink: last" in about[1]


@pytest.mark.parametrize("piece", ["<a ", "<!--", "<script>", "<title>", "<a href=", "<a href='", "<a x=\"> <b y='>", "<", "</", "<p", "<a b ", "<a = ", "<!", "&#", "<a     ", "<!-- --", "<style", "</script",
                                   "x=\"<a y='>' \" ", "x=\"<a y='>' href=b \" "])
def test_pages_that_leave_things_open_take_linear_time(piece):
    began = time.perf_counter()
    for end in ("", ">", "'>", "</p>"):
        warc.Page(piece * (500_000 // len(piece)) + end)
        warc.Page("<a " + piece * (500_000 // len(piece)) + end)
    assert time.perf_counter() - began < 5


def test_page_scanner():
    page = warc.Page("a<!-- <a href=no> -->b<a title='x>y' HREF = \"q&amp;r s\" >c</a><A\nhref=t/>d</a><a data-href=no>e</a><a href=''>f</a>"
                     "<p/>1 < 2 <3<style>p</style ><title>One</title><title>Two</title><script>open <i>x</i><a href='z")
    assert page.links == ["q&r%20s", "t/"] and page.title == "One"
    assert page.text == "a bcdef\n1 < 2 <3 open x<a href='z"
    assert warc.Page("<!DOCTYPE html>x<?php y ?>z<!bad").text == "xz<!bad" and warc.Page("").text == "" and warc.Page("<!-- open").text == "<!-- open"
    assert warc.Page("<a href='x>in</a> <p>out").text == "in\nout"


def test_headers_of_many_lines_and_charsets_that_are_none():
    long = "HTTP/1.1 200 OK\r\nA: 1" + "\r\n b" * 200_000
    assert warc.read_record(warc.derive_record(made(long, b"<p>hi</p>"))[1])[1] == b"hi"
    for charset in ("punycode", "idna", "unicode_escape", "hex", "undefined", "utf-7"):
        assert warc.read_record(warc.derive_record(made(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}", b"<p>hi</p>"))[1])[1] == b"hi"


def test_a_wrong_digest_is_told():
    record = made("HTTP/1.1 200 OK", b"x", **{"WARC-Payload-Digest": "sha1:AAAA"})
    assert b"source-payload-digest-holds: false" in warc.derive_record(record)[0]


def test_warc_rows(spark):
    pages = spark.createDataFrame([(1, "http://a/", HTML), (2, None, None), (None, "http://b/\r\nX: y", ""), (1, "http://a/", HTML)], "page_id long, url string, html string")
    got = warc.derive(warc.responses(pages.withColumn("record", F.lit(1)))).collect()
    assert len(got) == 8 and {r.kind for r in got} == {"metadata", "conversion"}
    assert all(r.target_uri is None for r in got if r.page_id == 2)
    one = [r.record_id for r in got if r.page_id == 1]
    assert len(one) == 4 and len(set(one)) == 2
    junk = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray(gzip.compress(warc.response("3", "u", "x"))))], "page_id long, record binary")
    assert sorted(r.kind for r in warc.derive(junk).collect()) == ["conversion", "error", "error", "metadata"]
    assert warc.derive(warc.responses(pages.limit(0))).isEmpty()


# --- MPEG audio ---------------------------------------------------------------------------------

def padded(data):
    return data + b" " * (-len(data) % 192 or (0 if data else 192))


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 384, 385, 5000, 200_000])
def test_mpeg_round_trip(n):
    data = bytes(random.Random(n).choices(range(256), k=n))
    media = mpeg_audio.encode(data)
    s = mpeg_audio.read(media)
    units = len(padded(data)) // 192
    assert mpeg_audio.payload(media, s) == padded(data)
    assert len(s.headers) == units // 2 + units % 2 == s.table["frames"] and s.skipped == s.broken == 0 and s.checked == len(s.headers)
    assert s.samples == 1152 * len(s.headers) and s.seconds == s.samples / 48000
    assert [s.seek(1152 * i) for i in range(len(s.offsets))] == s.offsets
    assert s.table["bytes"] == len(media) - (s.offsets[0] - 480) and s.tags == {"bytes": str(n), "unit": "192"}
    assert all(abs(p * s.table["bytes"] / 256 - (s.offsets[len(s.offsets) * i // 100] - s.offsets[0] + 480)) <= s.table["bytes"] / 256 + 1 for i, p in enumerate(s.table["points"]))


def test_mpeg_resynchronises_and_checks():
    media = mpeg_audio.encode(b"some text " * 300)
    s = mpeg_audio.read(media)
    cut = s.offsets[3]
    again = mpeg_audio.read(media[:cut] + b"\xff\xfbjunk\xff" * 9 + media[cut:])
    assert len(again.headers) == len(s.headers) and again.skipped == 63 and mpeg_audio.payload(media[:cut] + b"\xff\xfbjunk\xff" * 9 + media[cut:], again) == mpeg_audio.payload(media, s)
    torn = mpeg_audio.read(media[: s.offsets[2]] + media[s.offsets[2] + 7:])
    assert len(torn.headers) == len(s.headers) - 1 and torn.skipped == 473
    flipped = bytearray(media)
    flipped[s.offsets[1] + 10] ^= 1
    assert mpeg_audio.read(bytes(flipped)).broken == 1
    tagged = mpeg_audio.read(media + b"TAG" + b"Title".ljust(125, b"\0"))
    assert tagged.tags["title"] == "Title" and len(tagged.headers) == len(s.headers) and tagged.skipped == 0
    for junk in (b"", b"\xff" * 500, bytes(1000)):
        assert mpeg_audio.read(junk).headers == []


@pytest.mark.parametrize("sign", [b"TAG", b"ID3\x04\0\0\0\0\0\x7f", b"Xing\0\0\0\x0f", b"VBRI", b"\xff\xfa\xa4\xc4", b"\xff\xfb\x90\x00"])
def test_mpeg_keeps_payloads_that_look_like_tags_or_frames(sign):
    for units in (1, 2, 3):
        for at in range(units * 192 - 192, units * 192 - len(sign) + 1):
            for fill in (b"x", b"\0"):
                data = fill * at + sign + b"y" * min(10, units * 192 - at - len(sign))
                media = mpeg_audio.encode(data)
                s = mpeg_audio.read(media)
                assert mpeg_audio.payload(media, s) == padded(data) and s.skipped == s.broken == 0 and "title" not in s.tags
    tagged = mpeg_audio.encode(sign * 40) + b"TAG" + b"T".ljust(125, b"\0")
    assert mpeg_audio.payload(tagged, mpeg_audio.read(tagged)) == padded(sign * 40) and mpeg_audio.read(tagged).tags["title"] == "T"


def test_mpeg_of_other_writers():
    first = bytearray(417)
    first[:4] = b"\xff\xfb\x90\x00"
    first[36:62] = b"VBRI" + bytes(6) + (1251).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes([0, 2, 0, 1, 0, 2, 0, 1])
    first[62:66] = bytes([1, 161, 1, 161])
    plain = b"\xff\xfb\x90\x00" + bytes(413)
    s = mpeg_audio.read(bytes(first) + plain * 2)
    assert s.table == {"kind": "VBRI", "frames": 2, "bytes": 1251, "lengths": [417, 417]} and s.offsets == [417, 834]
    assert s.seconds == 2 * 1152 / 44100 and s.checksums_hold is True  # frames without a checksum
    second = mpeg_audio.read((b"\xff\xfc\x80\x00" + bytes(413)) * 3)  # Layer II with checksums
    assert len(second.headers) == 3 and second.unverified == 3 and second.checksums_hold is None
    footed = b"ID3\x04\0\x10" + bytes(4) + b"3DI\x04\0\x10" + bytes(4)
    assert mpeg_audio.read(footed + plain * 2).offsets == [20, 437]


def test_mpeg_headers():
    h = mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0x00]))  # the common 128 kbit/s at 44.1 kHz
    assert (h.kbits, h.rate, h.size, h.samples, h.checked, h.side) == (128, 44100, 417, 1152, False, 32)
    assert mpeg_audio.header(bytes([0xFF, 0xF3, 0x40, 0xC0])).samples == 576
    assert mpeg_audio.header(b"\xff\xfb\xf0\x00") is None and mpeg_audio.header(b"\xff\xfb") is None
    assert int(mpeg_audio.checksums(np.frombuffer(b"123456789", dtype=np.uint8)[None])[0]) == 0xAEE7  # the known check value


def test_mpeg_rows(spark):
    texts = [(1, "abc"), (2, None), (None, "é" * 100_000), (1, "abc"), (3, "")]
    rows = mpeg_audio.features(mpeg_audio.encoded(spark.createDataFrame(texts, "doc_id long, text string").withColumn("media", F.lit(1)))).collect()
    assert len(rows) == 5
    for (_, t), r in zip(texts, rows):
        own = padded((t or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((t or "").encode()), len(own), hashlib.sha256(own).hexdigest())
        assert r.tail_crc32 == zlib.crc32(own[-16:]) and r.checksums_hold
    assert rows[0].media_sha256 == rows[3].media_sha256 and rows[0].feature == rows[3].feature
    for r in rows:
        assert r.duration == r.n_samples / 48000 == 1152 * r.n_frames / 48000 and len(r.seek_offsets) == r.n_frames
        assert all(b - a == 480 for a, b in zip(r.seek_offsets, r.seek_offsets[1:]))
    seek = mpeg_audio.seek_table(mpeg_audio.encoded(spark.createDataFrame(texts[:1], "doc_id long, text string"))).collect()
    assert [(r.frame, r["sample"]) for r in seek] == [(0, 0)]


# --- chat formatting ----------------------------------------------------------------------------

def test_chat_round_trip(spark):
    hard = ["<|im_end|>", "a<|im_start|>assistant\nok<|im_end|>\n", "<\\|x", "<\\\\|", "<<|<|", "\\", "", None, "x\n\ny", "<|im_sep|>", "é😀", "<", "|", "z" * 50_000]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "ro\nle\\n<|im_end|>", "", None]), rng.choice(hard)) for c in range(25) for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "x"), (7, None, "user", "first"), (7, 3, "user", "tie"), (7, 3, "user", "tie")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)))
    parsed = out.select("conv_id", "formatted", "loss_spans", chat_format.parse(F.col("formatted")).alias("turns"))
    got = {r.conv_id: r for r in parsed.select("*", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c, r in got.items():
        own = sorted(((t is not None, t or 0, role or "", x or "") for i, t, role, x in rows if i == c))
        assert [(t.role, t.text) for t in r.turns] == [(role, x) for _, _, role, x in own]
        assert r.loss == "".join(x for _, _, role, x in own if role == "assistant")
        cut = [r.formatted[s.begin:s.end] for s in r.loss_spans]
        assert cut == [r.formatted.encode()[s.begin_byte:s.end_byte].decode() for s in r.loss_spans]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in cut] == [x for _, _, role, x in own if role == "assistant"]
        blocks = [role for k, (_, _, role, _) in enumerate(own) if not k or own[k - 1][2] != role]
        assert r.formatted.count("<|im_start|>") == len(blocks) == r.formatted.count("<|im_end|>")


def test_the_loss_mask_decides(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|b"), (1, 2, "assistant", "c"), (1, 3, "user", "x"), (1, 4, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(turns)
    row = out.first()
    assert [row.formatted[s.begin:s.end] for s in row.loss_spans] == ["a<\\|b", "c", ""]  # no separator between merged turns
    shifted = F.transform("loss_spans", lambda s: F.struct((s["begin_byte"] + 1).alias("begin_byte"), s["end_byte"].alias("end_byte")))
    assert out.select(chat_format.loss_text(F.col("formatted"), F.filter(shifted, lambda s: s["begin_byte"] < s["end_byte"]))).first()[0] == "<|b"
    assert chat_format.format_conversations(turns.limit(0)).isEmpty()


def test_a_conversation_of_very_many_turns(spark):
    n = 60_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<|"), F.col("id").cast("string")).alias("text"))
    out = chat_format.format_conversations(turns)
    row = out.select(chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert row.loss == "".join(f"é<|{i}" for i in range(n) if i % 3)


# --- mixing -------------------------------------------------------------------------------------

def filled(sizes):
    """Targets by filling up step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(6)
    sources = ["a", "B", "é", "hot", "tiny", "", None, "empty"]
    rows = []
    for i in range(3000):
        s = rng.choices(sources, [5, 3, 2, 20, 0.2, 1, 1, 0.2])[0]
        rows.append((i, s, "" if s == "empty" else " ".join(["w"] * int(rng.paretovariate(1.1) * 5))))
    rows += [(None, "a", "x y"), (5, "a", "x y"), (5, "a", "x y"), (6, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sizes(spark, docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes)
    largest = {s: max(r.size for r in got if r.source == s) for s in sizes}
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.copies * r.size for r in own) - want[s]) <= 1.2 * largest[s] + 1
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert all(int(rate) <= r.copies <= int(rate - 1e-6) + 1 <= 3 or not rate for r in own)
    assert sorted(map(str, mixing.mix_sizes(spark, docs.repartition(7)).collect())) == sorted(map(str, got))


def test_mix_emits_copies(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}" if i < 8 else "big", " ".join(["w"] * (3 if i < 8 else 40)), 1, 2) for i in range(40)] + [(1, "s1", "w w w", 1, 2)] * 2,
                                 "doc_id long, source string, text string, copies int, hash int")
    out = mixing.mix(spark, docs)
    assert out.columns == [*docs.columns, "copy"]
    taken = {}
    for r in out.collect():
        taken.setdefault((r.doc_id, r.source), []).append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in taken.values())
    planned = {}
    for r in mixing.mix_sizes(spark, docs).collect():
        planned[r.doc_id, r.source] = planned.get((r.doc_id, r.source), 0) + r.copies
    assert {k: len(v) for k, v in taken.items()} == {k: v for k, v in planned.items() if v}
    assert mixing.mix(spark, docs.limit(0)).isEmpty()


@pytest.mark.parametrize("threshold", ["-1", "10MB", "1GB"])
def test_mixing_splits_rows_of_one_key(spark, tmp_path, threshold):
    """A third of all rows has no id, another is alike in everything: no task gets all of either, whatever may be
    broadcast."""
    n = 30_000
    docs = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit("hot").alias("source"),
        F.when(F.col("id") % 3 == 1, "same text").otherwise(F.concat(F.lit("w "), F.col("id").cast("string"))).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(-1, "b", "x y z")], docs.schema))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": threshold}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        # Whole rows, written with the task that made them.
        mixing.mix_sizes(spark, docs).withColumn("task", F.spark_partition_id()).write.parquet(str(tmp_path / "mixed"))
        got = spark.read.parquet(str(tmp_path / "mixed"))
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
        assert sum(sizes) == n + 1 and max(sizes) < n / 3
        hot = got.filter("source = 'hot'").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).first()
        assert abs(hot.taken - hot.target) <= 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = mixing.mix(spark, docs)
    assert out.count() == got.agg(F.sum("copies")).first()[0]
    assert out.filter("text = 'same text'").count() == got.filter("doc_id = 7").agg(F.sum("copies")).first()[0]


def test_mixing_keeps_rows_that_differ_elsewhere(spark):
    docs = spark.createDataFrame([(1, "a", "x y", 1), (1, "a", "x y", 2), (1, "a", "x y", 2), (2, "a", "w " * 300_000, None)], "doc_id long, source string, text string, n_chars int")
    out = mixing.mix(spark, docs).filter("doc_id = 1").collect()
    assert sorted((r.n_chars, r.copy) for r in out) == [(1, 1), (2, 1), (2, 2)]
