"""MPEG audio as a media column: frames written and read back, with tags, checksums, durations and seek offsets.

``encode`` stores bytes in an MPEG-1 Layer III stream, mono at 48 kHz: an ID3v2 tag, a frame with a table of
variable bit rate (frames, bytes, 100 seek points), and audio frames of 160 and 80 kbit/s whose main data carry 384
and 192 payload bytes; each frame has its checksum. ``read`` parses any such stream: it takes ID3v2 tags at the
front, and an ID3v1 tag at the end where no frame covers it; it finds the next frame where bytes are missing or
foreign (a header counts if another header, the last tag or the end follows its frame), reads a table of variable
bit rate (Xing, Info or VBRI), verifies the checksums of Layer III (the other layers are told as unverified), and
gives exact durations (samples over rate) and the offset of each frame. Streams are made and read in the partitions
of their rows: no shuffle.

Defined cases: null texts count as empty; an empty payload is padded to one unit; bytes without a frame are read as
a stream of no frames; payloads may hold tags, headers and tables of their own; equal texts have equal streams; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, text_batches

UNIT = 192

# Fixed values of the MPEG audio format.
_KBITS = {  # by (version 1?, layer): bit rates of the indices 1 to 14
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by version bits


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    layer: int
    checked: bool
    kbits: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


_SEEN: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if four in _SEEN:
        return _SEEN[four]
    out = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
        rate, bits = four[2] >> 2 & 3, four[2] >> 4
        if version != 1 and layer != 4 and rate != 3 and bits not in (0, 15) and four[3] & 3 != 2:
            hz, kbits, pad = _RATES[version][rate], _KBITS[version == 3, layer][bits - 1], four[2] >> 1 & 1
            samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
            size = (12 * kbits * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hz + pad
            out = Header(version, layer, not four[1] & 1, kbits, hz, four[3] >> 6 == 3, size, samples)
    if len(_SEEN) < 1 << 16:
        _SEEN[four] = out
    return out


def _crc_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table[i] = c
    return table


_CRC = _crc_table()


def checksums(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes, as frames carry it."""
    crc = np.full(len(rows), 0xFFFF, dtype=np.uint16)
    for k in range(rows.shape[1]):
        crc = (crc << np.uint16(8)) ^ _CRC[(crc >> np.uint16(8)).astype(np.uint8) ^ rows[:, k]]
    return crc


# --- writing ------------------------------------------------------------------------------------

_HEADS = {2: bytes([0xFF, 0xFA, 10 << 4 | 1 << 2, 0xC4]), 1: bytes([0xFF, 0xFA, 6 << 4 | 1 << 2, 0xC4])}  # by payload units
_SIDE = 17
_DATA = 4 + 2 + _SIDE


def _frames(units: int, n: int) -> np.ndarray:
    four = _HEADS[units]
    out = np.zeros((n, header(four).size), dtype=np.uint8)
    out[:, :4] = np.frombuffer(four, dtype=np.uint8)
    if n:
        crc = int(checksums(np.concatenate([out[:1, 2:4], out[:1, 6:_DATA]], axis=1))[0])
        out[:, 4:6] = crc >> 8, crc & 0xFF
    return out


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _tag(texts: dict[str, str]) -> bytes:
    body = b""
    for name, text in texts.items():
        own = b"\x03" + name.encode() + b"\0" + text.encode()
        body += b"TXXX" + _syncsafe(len(own)) + b"\0\0" + own
    return b"ID3\x04\0\0" + _syncsafe(len(body)) + body


def encode(data: bytes) -> bytes:
    payload = data + b" " * (-len(data) % UNIT or (0 if data else UNIT))
    raw = np.frombuffer(payload, dtype=np.uint8)
    units = len(raw) // UNIT
    big, small = _frames(2, units // 2), _frames(1, units % 2)
    big[:, _DATA:_DATA + 2 * UNIT] = raw[: units // 2 * 2 * UNIT].reshape(-1, 2 * UNIT)
    small[:, _DATA:_DATA + UNIT] = raw[units // 2 * 2 * UNIT:].reshape(-1, UNIT)
    audio = big.tobytes() + small.tobytes()
    n, table = len(big) + len(small), _frames(2, 1)[0]
    total = len(audio) + len(table)
    at = [len(table) + min(i * n // 100, n) * big.shape[1] for i in range(100)]
    own = b"Xing" + struct.pack(">III", 0xF, n, total) + bytes(min(255, a * 256 // total) for a in at) + struct.pack(">I", 100)
    table[_DATA:_DATA + len(own)] = np.frombuffer(own, dtype=np.uint8)
    return _tag({"bytes": str(len(data)), "unit": str(UNIT)}) + table.tobytes() + audio


# --- reading ------------------------------------------------------------------------------------

@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    skipped: int = 0  # bytes that belong to no frame or tag
    checked: int = 0
    broken: int = 0  # frames whose checksum doesn't hold
    unverified: int = 0  # frames of other layers that carry a checksum

    @property
    def checksums_hold(self) -> bool | None:
        """None where checksums weren't verified, and none of the others is wrong."""
        return False if self.broken else None if self.unverified else True

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def seconds(self) -> float:
        return sum(h.samples / h.rate for h in self.headers) if len({h.rate for h in self.headers}) > 1 else (self.samples / self.headers[0].rate if self.headers else 0.0)

    def seek(self, samples: int) -> int:
        """Offset of the frame that holds a sample."""
        past = 0
        for at, h in zip(self.offsets, self.headers):
            past += h.samples
            if samples < past:
                return at
        return self.offsets[-1] if self.offsets else 0


def _syncsafe_at(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _read_tag(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of an ID3v2 tag at the front, and its texts."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}
    version, flags, size = data[3], data[5], _syncsafe_at(data[6:10])
    end, at, out = min(len(data), 10 + size), 10, {}
    if flags & 0x40 and version >= 3 and end >= 14:  # an extended header; from version 4 on its length includes itself
        at += _syncsafe_at(data[10:14]) if version >= 4 else 4 + int.from_bytes(data[10:14], "big")
    while version >= 3 and at + 10 <= end and data[at] != 0:
        raw = data[at + 4:at + 8]
        n = _syncsafe_at(raw) if version >= 4 else int.from_bytes(raw, "big")
        name, own = data[at:at + 4].decode("latin-1"), data[at + 10:min(end, at + 10 + n)]
        if name[0] == "T" and own:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(own[0], "latin-1")
            text = own[1:].decode(code, "replace").rstrip("\0")
            key, _, text = text.partition("\0") if name == "TXXX" else (name, "", text)
            out[key] = text
        at += 10 + n
    return min(len(data), end + 10 * (version >= 4 and flags & 0x10 != 0)), out  # a footer repeats the header


def _read_table(frame: bytes, h: Header) -> dict | None:
    """The Xing, Info or VBRI table of a first frame."""
    if h.layer != 3:
        return None
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, n, scale, width = struct.unpack(">IIHHH", frame[46:60])
        points = [int.from_bytes(frame[62 + i * width:62 + (i + 1) * width], "big") * scale for i in range(n) if 62 + (i + 1) * width <= len(frame)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "lengths": points}
    at = 4 + 2 * h.checked + h.side
    if frame[at:at + 4] not in (b"Xing", b"Info"):
        return None
    flags, at2, out = int.from_bytes(frame[at + 4:at + 8], "big"), at + 8, {"kind": frame[at:at + 4].decode()}
    for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "points", 100), (8, "quality", 4)):
        if flags & bit and at2 + n <= len(frame):
            own = frame[at2:at2 + n]
            out[name] = list(own) if n == 100 else int.from_bytes(own, "big")
            at2 += n
    return out


def read(data: bytes) -> Stream:
    """Frames from the front on. What stands within a frame is its payload, whatever it looks like."""
    out = Stream()
    at, out.tags = _read_tag(data)
    end = len(data)
    last = end - 128 if data[end - 128:end - 125] == b"TAG" and end >= 128 else end  # an ID3v1 tag, if no frame covers it
    first = True
    while at < end:
        if at == last:
            out.tags.setdefault("title", data[at + 3:at + 33].rstrip(b"\0 ").decode("latin-1"))
            break
        h = header(data[at:at + 4])
        after = at + h.size if h else 0
        if h is None or after > end or not (after == end or after == last or header(data[after:after + 4]) or (out.headers and _alike(h, out.headers[-1]))):
            following = data.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            if at < last < following:
                following = last
            out.skipped += following - at
            at = following
            continue
        table = _read_table(data[at:after], h) if first else None
        if table:
            out.table = table
        else:
            out.offsets.append(at)
            out.headers.append(h)
        first = False
        at = after
    _verify(data, out)
    return out


def _alike(a: Header, b: Header) -> bool:
    return (a.version, a.layer, a.rate, a.mono) == (b.version, b.layer, b.rate, b.mono)


def _verify(data: bytes, out: Stream) -> None:
    """Checksums of Layer III frames: over half of the header and the side information."""
    raw = np.frombuffer(data, dtype=np.uint8)
    groups: dict[int, list[int]] = {}
    for at, h in zip(out.offsets, out.headers):
        if h.checked and h.layer == 3:
            groups.setdefault(h.side, []).append(at)
        elif h.checked:
            out.unverified += 1
    for side, offsets in groups.items():
        at = np.array(offsets)[:, None]
        rows = np.concatenate([raw[at + np.arange(2, 4)], raw[at + np.arange(6, 6 + side)]], axis=1)
        said = raw[at[:, 0] + 4].astype(np.uint16) << np.uint16(8) | raw[at[:, 0] + 5]
        out.checked += len(offsets)
        out.broken += int((checksums(rows) != said).sum())


def payload(data: bytes, stream: Stream) -> bytes:
    """What ``encode`` stored: the payload bytes of the frames, padding included."""
    return b"".join(
        data[at + _DATA:at + _DATA + (2 * UNIT if h.kbits == 160 else UNIT)] for at, h in zip(stream.offsets, stream.headers))


def feature(stream: Stream, size: int) -> str:
    rates = sorted({h.kbits for h in stream.headers})
    told = stream.table is not None and stream.table.get("frames") == len(stream.headers)
    hz = stream.headers[0].rate if stream.headers else 0
    return (f"frames={len(stream.headers)};samples={stream.samples};hz={hz};kbits={'/'.join(map(str, rates))};"
            f"checked={stream.checked};broken={stream.broken};unverified={stream.unverified};skipped={stream.skipped};table={str(told).lower()};"
            f"bytes={size}")


# --- Spark --------------------------------------------------------------------------------------

def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        media = [encode((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, type=pa.binary())], ["doc_id", "media"])


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, media): each whole text as an MPEG audio stream."""
    text_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encode, "doc_id long, media binary")


_FEATURES = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
             "feature string, n_frames long, n_samples long, duration double, checksums_hold boolean, seek_offsets array<long>")
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.int64()))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "media"):
        rows = []
        for media in batch.column(1):
            data = media.as_buffer().to_pybytes() if media.is_valid else b""
            s = read(data)
            own = payload(data, s)
            n = s.tags.get("bytes", "")
            rows.append((int(n) if n.isdigit() else len(own), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]), len(data),
                         hashlib.sha256(data).hexdigest(), feature(s, len(data)), len(s.headers), s.samples, s.seconds, s.checksums_hold, np.array(s.offsets, dtype=np.int64)))
        columns = [pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(_KINDS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [x.split()[0] for x in _FEATURES.split(", ")])


def features(media: DataFrame) -> DataFrame:
    """(doc_id, media) -> what the stored bytes hold, one row per stream: digests of its payload, the exact duration
    (n_samples over the rate) and where each frame begins (seek_offsets: frame i starts at i times a frame's samples)."""
    return media.select("doc_id", "media").mapInArrow(_features, _FEATURES)


def seek_table(media: DataFrame) -> DataFrame:
    """(doc_id, media) -> (doc_id, frame, sample, offset): where each frame begins."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media"):
            for doc, one in zip(batch.column(0), batch.column(1).to_pylist()):
                s = read(one or b"")
                n = len(s.offsets)
                samples = np.cumsum([0, *(h.samples for h in s.headers)])[:n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * n, type=pa.int64()), pa.array(np.arange(n)), pa.array(samples.astype(np.int64)), pa.array(s.offsets, type=pa.int64())],
                    ["doc_id", "frame", "sample", "offset"])

    return media.select("doc_id", "media").mapInArrow(table, "doc_id long, frame long, sample long, offset long")


# --- op8 ----------------------------------------------------------------------------------------

def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")))
