import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import media


def test_header_fields():
    h = media.header(bytes([0xFF, 0xFB, 0x90, 0x00]))
    assert (h.version, h.layer, h.bitrate, h.rate, h.protected, h.length, h.samples) == (3, 3, 128, 44100, False, 417, 1152)
    assert media.header(bytes([0xFF, 0xFB, 0x92, 0x00])).length == 418
    assert media.header(bytes([0xFF, 0xF3, 0x40, 0xC0])).side == 9  # MPEG-2, mono
    assert [media.header(x) for x in (b"\xff\xff\xff\xff", b"\xff\xe8\x90\0", b"abcd", b"\xff\xfb\x00\0", b"\xff\xfb\x9c\0")] == [None] * 5


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 1151, 1152, 5000, 200_000])
def test_round_trip(size):
    payload = media.pad(random.Random(size).randbytes(size))
    assert len(payload) % media.UNIT == 0 and len(payload) >= media.UNIT
    raw = media.store(payload)
    s = media.parse(raw)
    assert media.payload_of(raw, s) == payload and s.bad == 0 and s.skipped == 0
    n = len(payload) // media.UNIT
    assert s.duration == Fraction(1152 * n, 48000) and s.vbr["frames"] == n and s.vbr["kind"] == "Xing"
    assert s.seek(0) == s.offsets[0] and s.seek(1e9) == s.offsets[-1]
    assert s.tags["TLEN"] == str(round(n * 24))


def test_payload_that_looks_like_tags_and_frames():
    for k in range(media.UNIT - 3):
        block = bytearray(b"\xff\xfa\xc4\x00" * (media.UNIT // 4))
        block[k : k + 3] = b"TAG"
        assert media.payload_of(media.store(bytes(block))) == bytes(block)


def test_resynchronises_and_verifies():
    payload = media.pad(b"text " * 2000)
    raw = media.store(payload)
    clean = media.parse(raw)
    noisy = b"junk\xff\xfb" * 5 + raw[: clean.offsets[3]] + b"\xff\x00noise" + raw[clean.offsets[3] :] + b"TAG" + b"title".ljust(125, b"\0")
    s = media.parse(noisy)
    assert media.payload_of(noisy, s) == payload
    assert s.skipped == 30 + 7 and s.tags["v1"] == "title" and s.duration == clean.duration
    broken = bytearray(raw)
    broken[clean.offsets[2] + 10] ^= 1
    assert media.parse(bytes(broken)).bad == 1
    assert len(media.parse(raw[:-5]).offsets) == len(clean.offsets) - 1
    assert media.parse(b"").offsets == [] and media.parse(b"no audio at all").skipped == 15


def test_crc_by_bits():
    def slow(raw):
        c = 0xFFFF
        for byte in raw:
            for k in range(7, -1, -1):
                c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15 ^ byte >> k) & 1 else 0)
        return c

    for n in range(40):
        raw = random.Random(n).randbytes(n)
        assert media.crc16(raw) == slow(raw)


def test_vbri():
    h = bytes([0xFF, 0xFB, 0x90, 0x00])
    info = (h + bytes(32) + b"VBRI" + (1).to_bytes(2) + bytes(2) + (75).to_bytes(2) + (834).to_bytes(4) + (1).to_bytes(4) + (1).to_bytes(2) + (1).to_bytes(2) + (2).to_bytes(2) + (1).to_bytes(2) + (417).to_bytes(2)).ljust(417, b"\0")
    s = media.parse(info + h.ljust(417, b"\0"))
    assert s.vbr["kind"] == "VBRI" and s.vbr["frames"] == 1 and s.vbr["toc"] == [417] and len(s.offsets) == 1


def test_columns(odd, clashing, nothing):
    want = {}
    for r in odd.collect():
        text = (r["text"] or "").encode()
        want[text] = (len(text), len(media.pad(text)), hashlib.sha256(media.pad(text)).hexdigest(), zlib.crc32(media.pad(text)[-32:]))
    rows = media.columns(clashing).collect()
    assert sorted(tuple(r)[1:5] for r in rows) == sorted(want[(r["text"] or "").encode()] for r in odd.collect())
    assert media.columns(nothing).collect() == []
    full = media.columns(odd, keep_media=True).collect()
    assert all(len(r["media"]) == r["media_bytes"] and len(r["frame_offsets"]) * media.UNIT == r["payload_bytes"] for r in full)


def walk(raw: bytes):
    """A small parser of the stored form alone: the tag's size, then frames by their lengths, the first one informing."""
    at = 10 + (raw[6] << 21 | raw[7] << 14 | raw[8] << 7 | raw[9])
    offsets, kbps = [], []
    while at < len(raw):
        assert raw[at] == 0xFF and raw[at + 1] == 0xFA
        rate = {0xC4: 224, 0xD4: 256}[raw[at + 2]]
        offsets.append(at)
        kbps.append(rate)
        at += 144000 * rate // 48000
    assert at == len(raw) and b"Xing" in raw[offsets[0] : offsets[1]]
    return offsets[1:], kbps[1:]


def test_columns_by_another_parser(odd):
    for r in media.columns(odd, keep_media=True).collect():
        offsets, kbps = walk(r["media"])
        n = len(offsets)
        assert r["frame_offsets"] == offsets and Fraction(r["seconds_num"], r["seconds_den"]) == Fraction(n * 1152, 48000)
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        want = f"mpeg1l3;seconds={r['seconds_num']}/{r['seconds_den']};frames={n};kbps={sum(kbps) / n:.3f};vbr=Xing:{n};seek={','.join(str(offsets[i * n // 4]) for i in range(4))};bad=0;skipped=0"
        assert r["feature"] == want


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 3000), st.integers(0, 3000))
def test_no_bytes_make_the_parser_fail(noise, a, b):
    whole = media.store(media.pad(b"x" * 700))
    cut = whole[min(a, b) : max(a, b)]
    vbri = b"\xff\xfb\x90\x00" + bytes(32) + b"VBRI" + noise
    for raw in (noise, cut, cut + noise, noise + cut, b"ID3\x04\0\0\0\0\x7f\x7f" + noise, b"ID3\x04\0\0\0\0\0\x0bTIT2\0\0\0\x09\0\0", vbri, vbri.ljust(417, b"\xff"), noise + b"TAG".ljust(128, b"z")):
        s = media.parse(raw)
        assert len(s.offsets) == len(s.headers) and s.skipped <= len(raw)
        media.feature(s)
