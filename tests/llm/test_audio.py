from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import audio


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(raw):
    body = audio.padded(raw)
    data = audio.write(body)
    s = audio.read(data)
    assert audio.payload(data, s) == body and len(body) % 64 == 0 and len(body) >= 64
    assert s.damaged == s.skipped == s.resyncs == 0 and s.checked == len(s.frames) + 1
    assert s.table["frames"] == len(s.frames) and s.table["kind"] == "Xing"
    assert s.duration == Fraction(1152 * len(s.frames), 32000)


def test_damage_and_garbage():
    rng = random.Random(1)
    data = audio.write(bytes(rng.randrange(256) for _ in range(20_000)))
    frames = audio.read(data).frames
    at = frames[3][0]
    noisy = data[:at] + b"\x00\xff\xfb\x12garbage\xff" * 3 + data[at:]
    s = audio.read(noisy)
    assert s.resyncs == 1 and s.skipped == 36 and len(s.frames) == len(frames)
    broken = bytearray(data)
    broken[frames[5][0] + 8] ^= 1  # side information
    assert audio.read(bytes(broken)).damaged == 1
    assert len(audio.read(data[:-10]).frames) == len(frames) - 1


def test_tags_and_tables():
    title = b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + bytes(65)
    data = audio.write(bytes(64), {"TIT2": "Lied"}) + title
    s = audio.read(data)
    assert s.tags["TIT2"] == "Lied" and s.tags["TPE1"] == "Band" and s.skipped == 0
    head = bytes([0xFF, 0xFB, 0x90, 0x00])  # 128 kbit/s, 44.1 kHz, stereo, no checksum: 417 bytes
    vbri = (head + bytes(32) + b"VBRI" + bytes.fromhex("0001 0000 004b 00000341 00000002 0002 0001 0002 0001".replace(" ", "")) + bytes.fromhex("01a101a1")).ljust(417, b"\0")
    s = audio.read(vbri + (head.ljust(417, b"\0")) * 2)
    assert s.table["kind"] == "VBRI" and s.table["toc"] == [417, 834] and len(s.frames) == 2
    assert audio.header(bytes([0xFF, 0xFF, 0x14, 0])).layer == 1 and audio.header(b"\xff\xe0\x00\x00") is None and audio.header(b"") is None


def test_documents(docs, documents):
    got = {r.doc_id: r for r in audio.inspect(audio.encode(docs.withColumn("media", F.lit("clash")))).collect()}
    assert len(got) == len(documents)
    for i, text, *_ in documents:
        raw = (text or "").encode()
        body = raw + bytes(64 - len(raw) if len(raw) < 64 else -len(raw) % 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))


def test_media_are_stored_and_read_back(docs, documents, tmp_path):
    media = audio.encode(docs)
    stored = audio.store(media, f"file://{tmp_path}/media")
    assert "MapInArrow" not in stored._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted((r.doc_id, r.payload_sha256, r.media_sha256) for r in audio.inspect(df).collect())
    assert key(stored) == key(media) and stored.count() == len(documents)


def test_empty(empty):
    assert audio.inspect(audio.encode(empty)).count() == 0
    assert audio.read(b"").feature.startswith("none;frames=0")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=40), st.sampled_from([b"ID3\x04\0\0\0\0\0\x7f", b"\xff\xfb\x90\x00", b"\xff\xfa\x00\x00", b"\xff\xfd\x14\xc0" * 60, b"Xing\0\0\0\x0f", b"VBRI", b"TXXX\0\0\0\x0e\0\0\x03payload\0-1x", bytes(420)])), max_size=12))
def test_any_bytes_are_read(parts):
    data = b"".join(parts)
    s = audio.read(data)
    audio.payload(data, s)
    assert s.feature and all(at + h.length <= len(data) for at, h in s.frames)


def test_checksum_of_bits():
    assert audio.crc16(b"123456789") == 0xAEE7  # the published check value of this polynomial and start
    slow = 0xFFFF
    for bit in f"{0xABCDE:020b}":
        slow = ((slow << 1 & 0xFFFF) ^ 0x8005) if (slow >> 15) ^ int(bit) else slow << 1 & 0xFFFF
    assert audio.crc16(bytes([0xAB, 0xCD, 0xE0]), 20) == slow


def test_layers_one_and_two_are_checked():
    """Frames made by hand: 192 kbit/s Layer II (table of 30 subbands) and 192 kbit/s Layer I, both at 44.1 kHz with checksums."""
    two = bytes([0xFF, 0xFC, 0xA0, 0x00])
    h = audio.header(two)
    assert (h.layer, h.bitrate, h.length, h.samples) == (2, 192, 626, 1152)
    bits = "0001" + "0010" + "0000" * 20 + "000" * 24 + "00" * 14 + "01" + "10"  # two channels use subband 0; scales of both chosen
    body = int(bits.ljust(640, "0"), 2).to_bytes(80, "big")
    assert audio.protected_bits(h, body) == 22 * 4 + 24 * 3 + 14 * 2 + 4
    crc = audio.crc16(two[2:] + body, 16 + 192)
    frame = (two + crc.to_bytes(2, "big") + body).ljust(626, b"\0")
    s = audio.read(frame * 3)
    assert (s.checked, s.damaged, len(s.frames)) == (3, 0, 3) and s.duration == Fraction(3 * 1152, 44100)
    assert audio.read(frame + frame[:6] + bytes([frame[6] ^ 1]) + frame[7:] + frame).damaged == 1
    assert audio.read(frame[:500] + bytes([1]) + frame[501:]).damaged == 0  # samples are not covered
    one = bytes([0xFF, 0xFE, 0x60, 0xC0])
    h = audio.header(one)
    assert (h.layer, h.mono, h.length, h.samples) == (1, True, (12 * 192000 // 44100) * 4, 384) and audio.protected_bits(h, b"") == 128
    frame = (one + audio.crc16(one[2:] + bytes(16)).to_bytes(2, "big")).ljust(h.length, b"\0")
    assert audio.read(frame * 2).damaged == 0 and audio.read(frame[:9] + b"\1" + frame[10:]).damaged == 1


def test_free_format_delay_and_padding():
    free = bytes([0xFF, 0xFB, 0x00, 0xC0])
    s = audio.read(free.ljust(700, b"\0") * 4)
    assert [at for at, _ in s.frames] == [0, 700, 1400, 2100] and s.duration == Fraction(4 * 1152, 44100) and not s.skipped
    head = bytes([0xFF, 0xFB, 0x90, 0x00])
    tag = b"LAME3.100" + bytes(12) + bytes([576 >> 4, (576 & 15) << 4 | 1104 >> 8, 1104 & 255])
    info = (head + bytes(32) + b"Info" + (15).to_bytes(4, "big") + (2).to_bytes(4, "big") + (1251).to_bytes(4, "big") + bytes(104) + tag).ljust(417, b"\0")
    s = audio.read(info + head.ljust(417, b"\0") * 2)
    assert (s.table["delay"], s.table["padding"]) == (576, 1104) and s.duration == Fraction(2 * 1152 - 576 - 1104, 44100)


def test_damaged_payloads_are_told():
    data = audio.write(bytes(range(256)) * 20)
    s = audio.read(data)
    assert audio.intact(audio.payload(data, s), s)
    at = s.frames[1][0] + 100
    flipped = data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :]
    f = audio.read(flipped)
    assert f.damaged == 0 and not audio.intact(audio.payload(flipped, f), f)
    lost = data[: s.frames[1][0]] + b"\0" + data[s.frames[1][0] + 1 :]
    f = audio.read(lost)
    assert not audio.intact(audio.payload(lost, f), f)
    odd = data.replace(b"payload\x005120", b"payload\x00-12x")
    assert audio.payload(odd) == b"" and not audio.intact(b"", audio.read(odd))
