"""MPEG audio columns: frame headers resynchronised, tags and variable-bitrate tables parsed, checksums verified, exact durations and
seek offsets stored.

read() takes any bytes as an MPEG-1/2/2.5 stream, layers I to III, free format included, and never fails. Durations are exact: samples
of all frames, less the delay and padding that an encoder's tag states. write() makes a valid Layer III stream that carries a payload
without loss: each frame's side information announces no coded samples (it plays as silence), and the payload fills the frame's
ancillary bytes, an ID3v2 tag keeps its length and checksum, and a first frame holds the Xing table of a variable-bitrate stream.

Defined cases: null is empty; empty bytes give no frames and duration 0; bytes between frames are skipped and counted; a truncated
last frame is not a frame; very long texts make streams of many frames, each of its own, so nothing but the stream grows; a stream without a payload tag (or with one that is no number) gives an empty payload; a payload that lost
or changed bytes is given as it is and marked as not intact; repeated and null doc_ids are documents like any other; an empty table
gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.columns import id_field, narrow

# Fixed values of the MPEG audio standards: kbit/s by index, Hz by index, samples of a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

#: A seek point is stored for every so many frames.
SEEK_EVERY = 16


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mono: bool
    #: Subbands of joint stereo that are coded apart (layers I and II); 32 where all are.
    bound: int = 32
    #: Bytes of a frame in free format, which the header does not tell.
    free: int = 0

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def length(self) -> int:
        if self.free:
            return self.free
        if self.layer == 1:
            return (12 * self.bitrate * 1000 // self.rate + self.padding) * 4
        return self.samples // 8 * self.bitrate * 1000 // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information, Layer III alone."""
        return 0 if self.layer != 3 else (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def body(self) -> int:
        """Where the side information begins."""
        return 6 if self.protected else 4


@lru_cache(4096)
def header(four: bytes, free: int = 0) -> Header | None:
    """A frame header, or None for reserved values. free: the length of frames in free format; without it they are none."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    if version is None or layer == 4 or four[2] >> 4 == 15 or four[2] >> 2 & 3 == 3 or (four[2] >> 4 == 0 and not free):
        return None
    pad, mode = four[2] >> 1 & 1, four[3] >> 6
    own = (free + pad * (4 if layer == 1 else 1)) * (four[2] >> 4 == 0)
    return Header(version, layer, not four[1] & 1, BITRATES[1 if version == 1 else 2, layer][four[2] >> 4], RATES[version][four[2] >> 2 & 3], pad, mode == 3, 4 * (four[3] >> 4 & 3) + 4 if mode == 1 else 32, own)


#: Bytes that a frame in free format has at most.
FREE_MOST = 6000


def _free_length(data: bytes, at: int, end: int) -> int:
    """Bytes of the frame in free format at that place, padding left out: up to the next header of the same kind, which a third one
    follows as far on. 0 if there is none."""
    if data[at] != 0xFF or data[at + 2] >> 4:
        return 0
    same = lambda p: p + 4 <= end and data[p] == 0xFF and data[p + 1] == data[at + 1] and data[p + 2] & 0xFC == data[at + 2] & 0xFC
    unit = 4 if 4 - (data[at + 1] >> 1 & 3) == 1 else 1
    p = data.find(b"\xff", at + 24, min(end, at + FREE_MOST))
    while p > 0:
        if same(p):
            bare = p - at - unit * (data[at + 2] >> 1 & 1)
            after = p + bare + unit * (data[p + 2] >> 1 & 1)
            if after == end or same(after):
                return bare
        p = data.find(b"\xff", p + 1, min(end, at + FREE_MOST))
    return 0


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


_CRC = _crc_table()


def crc16(data: bytes, bits: int | None = None) -> int:
    """The frame checksum: polynomial 0x8005, from 0xFFFF, highest bit first, over all bytes or so many bits."""
    bits = 8 * len(data) if bits is None else bits
    crc = 0xFFFF
    for byte in data[: bits // 8]:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ byte]
    for k in range(bits % 8):
        crc ^= (data[bits // 8] >> 7 - k & 1) << 15
        crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _allocation_bits(h: Header) -> list[int]:
    """Layer II: bits of the allocation of each subband. Fixed values of the standards: (subbands, bits) by rate and bitrate."""
    per = h.bitrate // (1 if h.mono else 2)
    if h.version != 1:
        runs = ((4, 4), (7, 3), (19, 2))
    elif h.bitrate and per < 56:
        runs = ((2, 4), (10, 3)) if h.rate == 32000 else ((2, 4), (6, 3))
    else:
        runs = ((11, 4), (12, 3), (4, 2)) if h.rate == 48000 or (h.bitrate and per <= 80) else ((11, 4), (12, 3), (7, 2))
    return [bits for n, bits in runs for _ in range(n)]


def protected_bits(h: Header, body: bytes) -> int:
    """Bits after the checksum that it covers: side information (III), allocation (I), allocation and scale selection (II)."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 128 if h.mono else 4 * (min(h.bound, 32) + 32)
    value, at, chosen = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 0, 0
    for k, bits in enumerate(_allocation_bits(h)):
        for _ in range(1 if h.mono or k >= h.bound else 2):
            used = value >> 512 - at - bits & (1 << bits) - 1
            chosen += 2 * bool(used) * (2 if k >= h.bound and not h.mono else 1)
            at += bits
    return at + chosen


@dataclass
class Stream:
    """What read() finds."""

    frames: list[tuple[int, Header]] = field(default_factory=list)
    duration: Fraction = Fraction(0)
    checked: int = 0
    damaged: int = 0
    resyncs: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    bitrates: set[int] = field(default_factory=set)

    @property
    def duration_us(self) -> int:
        return int(self.duration * 1_000_000)

    @property
    def payload_bytes(self) -> int:
        """The length that the payload's tag states."""
        stated = self.tags.get("TXXX:payload", "")
        return int(stated) if stated.isascii() and stated.isdigit() and len(stated) < 19 else 0

    @property
    def seek(self) -> list[int]:
        return [at for at, _ in self.frames[::SEEK_EVERY]]

    @property
    def feature(self) -> str:
        first = self.frames[0][1] if self.frames else None
        kind = f"mpeg{first.version:g}/layer{first.layer}/{first.rate}" if first else "none"
        kbps = f"{min(self.bitrates)}-{max(self.bitrates)}" if self.bitrates else "0"
        return f"{kind};frames={len(self.frames)};us={self.duration_us};kbps={kbps};crc={self.checked - self.damaged}/{self.checked};resync={self.resyncs};table={self.table.get('kind', 'none')}:{self.table.get('frames', 0)};seek={','.join(map(str, self.seek))}"


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads text frames; returns the end of the tag."""
    major, flags, size = data[at + 3], data[at + 5], _synchsafe(data[at + 6 : at + 10])
    end, p = min(len(data), at + 10 + size), at + 10
    if flags & 0x40 and p + 4 <= end:
        p += _synchsafe(data[p : p + 4]) if major == 4 else int.from_bytes(data[p : p + 4], "big") + 4
    while major >= 3 and p + 10 <= end and data[p]:
        name, n = data[p : p + 4].decode("latin1"), _synchsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        value = data[p + 10 : min(end, p + 10 + n)]
        if name[0] == "T" and value:
            text = value[1:].decode(("latin1", "utf-16", "utf-16-be", "utf-8")[value[0] & 3], "replace").rstrip("\0")
            key, _, rest = text.partition("\0")
            tags[f"{name}:{key}" if name == "TXXX" else name] = rest if name == "TXXX" else text
        p += 10 + n
    return end + 10 * bool(flags & 0x10)


def _table(data: bytes, at: int, h: Header) -> dict[str, object]:
    """The Xing, Info or VBRI table of a first frame, if it is one."""
    p, end = at + h.body + h.side, at + h.length
    if h.layer == 3 and data[p : p + 4] in (b"Xing", b"Info"):
        kind, flags, p, out = data[p : p + 4].decode(), int.from_bytes(data[p + 4 : p + 8], "big"), p + 8, {}
        out["kind"] = kind
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit and p + size <= end:
                out[name] = list(data[p : p + size]) if name == "toc" else int.from_bytes(data[p : p + size], "big")
                p += size
        if data[p : p + 4] in (b"LAME", b"Lavf", b"Lavc", b"GOGO") and p + 24 <= end:  # the encoder's own tag
            out["delay"], out["padding"] = data[p + 21] << 4 | data[p + 22] >> 4, (data[p + 22] & 15) << 8 | data[p + 23]
        return out
    p = at + 36
    if h.layer == 3 and data[p : p + 4] == b"VBRI" and p + 26 <= end:
        _, _, quality, size, frames, n, scale, width, per = struct.unpack(">HHHIIHHHH", data[p + 4 : p + 26])
        sums, offset = [], 0
        for k in range(n):
            offset += int.from_bytes(data[p + 26 + k * width : p + 26 + (k + 1) * width], "big") * scale
            sums.append(offset)
        return {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "toc": sums, "per": per}
    return {}


def read(data: bytes) -> Stream:
    """Walks a stream from header to header. After damage it looks for the next header that another one, or the end, follows."""
    s, n, at, lost, audio_end, ticks, free = Stream(), len(data), 0, False, len(data), {}, 0
    if n >= 128 and data[-128:-125] == b"TAG":
        audio_end = n - 128
        for name, i, j in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if value := data[n - 128 + i : n - 128 + j].rstrip(b"\0 ").decode("latin1"):
                s.tags.setdefault(name, value)
    while at + 4 <= audio_end:
        if data[at : at + 3] == b"ID3" and at + 10 <= audio_end:
            at = _id3v2(data, at, s.tags)
            continue
        h = header(data[at : at + 4], free)
        if h is None and not free and header(data[at : at + 4], 1):
            free = _free_length(data, at, audio_end)
            h = header(data[at : at + 4], free)
        if h is not None and lost:  # a chance pattern is not followed by another header
            after = at + h.length
            h = h if after == audio_end or (header(data[after : after + 4], free) is not None and after < audio_end) else None
        if h is None or at + h.length > audio_end:
            if not lost:
                lost, s.resyncs = True, s.resyncs + 1
            nxt = data.find(b"\xff", at + 1, audio_end)
            s.skipped += (nxt if nxt > 0 else audio_end) - at
            at = nxt if nxt > 0 else audio_end
            continue
        lost = False
        if h.protected:
            body = data[at + 6 : at + h.length]
            bits = protected_bits(h, body)
            s.checked += 1
            s.damaged += bits > 8 * len(body) or crc16(data[at + 2 : at + 4] + body[: bits // 8 + 1], 16 + bits) != int.from_bytes(data[at + 4 : at + 6], "big")
        if not s.frames and not s.table and (t := _table(data, at, h)):
            s.table = t  # holds no sound
        else:
            s.frames.append((at, h))
            s.bitrates.add(h.bitrate)
            ticks[h.rate] = ticks.get(h.rate, 0) + h.samples
        at += h.length
    s.skipped += max(0, audio_end - at)
    s.duration = sum((Fraction(v, k) for k, v in ticks.items()), Fraction(0))
    if s.frames and "delay" in s.table:
        s.duration = max(Fraction(0), s.duration - Fraction(s.table["delay"] + s.table["padding"], s.frames[0][1].rate))
    return s


_RATE, _PROTECTED = 2, 0xFA  # 32 kHz, MPEG-1 Layer III with checksum


@lru_cache(32)
def _silent(index: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information of a mono frame; ancillary bytes after them."""
    head = bytes([0xFF, _PROTECTED, index << 4 | _RATE << 2, 0xC4])
    side = bytes(17)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side, header(head).length - 23


def write(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """A stream whose frames carry the payload."""
    largest, parts, p, sizes = _silent(14), [], 0, []
    while p < len(payload):
        left = len(payload) - p
        index = 14 if left >= largest[1] else next(i for i in range(1, 15) if _silent(i)[1] >= left)
        head, room = _silent(index)
        chunk = payload[p : p + room]
        parts.append(head + chunk + bytes(room - len(chunk)))
        sizes.append(len(parts[-1]))
        p += room
    head, room = _silent(next(i for i in range(1, 15) if _silent(i)[1] >= 120))
    total = sum(sizes) + len(head) + room
    places, at = [], len(head) + room
    for size in sizes:
        places.append(at)
        at += size
    toc = bytes(min(255, (places[k * len(places) // 100] if places else 0) * 256 // total) for k in range(100))
    first = head + b"Xing" + struct.pack(">III", 15, len(sizes), total) + toc + struct.pack(">I", 100)
    first += bytes(len(head) + room - len(first))
    texts = {"TXXX:payload": str(len(payload)), "TXXX:payload-crc32": f"{zlib.crc32(payload):08x}"} | (tags or {})
    body = b""
    for name, value in texts.items():
        raw = b"\x03" + (f"{name[5:]}\0{value}" if name.startswith("TXXX:") else value).encode()
        body += name[:4].encode() + _safe(len(raw)) + b"\0\0" + raw
    return b"".join([b"ID3\x04\0\0", _safe(len(body)), body, first, *parts])


def _safe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def payload(data: bytes, s: Stream | None = None) -> bytes:
    """The ancillary bytes that write() stored."""
    s = s or read(data)
    room = memoryview(data)
    out = b"".join(room[at + h.body + h.side : at + h.length] for at, h in s.frames)
    return out[: s.payload_bytes]


def intact(body: bytes, s: Stream) -> bool:
    """Whether a payload read back is the one that was stored."""
    return len(body) == s.payload_bytes and s.tags.get("TXXX:payload-crc32") == f"{zlib.crc32(body):08x}"


def padded(raw: bytes, unit: int = 64) -> bytes:
    """Zeros up to a positive multiple of the unit."""
    return raw + bytes(unit - len(raw) if len(raw) < unit else -len(raw) % unit)


def _rows(iterator: Iterator[pa.RecordBatch], column: int, step: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of some MB at a time."""
    for batch in iterator:
        sizes, held, begin = batch.column(column).cast(pa.binary()), 0, 0
        for i in range(len(batch)):
            held += len(sizes[i].as_buffer()) if sizes[i].is_valid else 0
            if held >= step or i + 1 == len(batch):
                part = batch.slice(begin, i + 1 - begin)
                yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]
                held, begin = 0, i + 1


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded, as a stream."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _rows(iterator, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, f"{id_field(docs)}, n_bytes long, media binary")


def store(media: DataFrame, path: str) -> DataFrame:
    """Writes doc_id, n_bytes, media to a table and gives that table as it is read back: what follows sees stored bytes alone."""
    media.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(media.schema).parquet(path)


INSPECTED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, frames long, seek_offsets array<long>, damaged long, resyncs long, intact boolean"


def inspect(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from media."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, streams in _rows(iterator, 2):
            out: list[tuple] = []
            for data in streams:
                s = read(data)
                body = payload(data, s)
                out.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest(), s.feature, s.duration_us, len(s.frames), s.seek, s.damaged, s.resyncs, intact(body, s)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_())
            names = ["doc_id", *(x.split()[0] for x in INSPECTED.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{id_field(media)}, {INSPECTED}")
