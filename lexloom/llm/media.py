"""Media columns: MPEG audio streams, written and parsed without loss.

``store`` puts a payload into MPEG-1 Layer III frames: an ID3v2 tag with the payload's length, an information frame
with a variable-bitrate table (frames, bytes and 100 seek points), then frames that carry 576 payload bytes each as
ancillary data behind empty side information, protected by CRC-16, at bitrates that alternate. Such a stream is
silence to a player and a container here. ``parse`` resynchronises on frame headers, skipping whatever lies between,
reads tags and the variable-bitrate table, verifies the checksums of Layer III (those of Layers I and II cover bit
allocations, which aren't read here: such frames are counted as unverified), and gives exact durations and frame offsets.

Null texts are empty; an empty text is one block of padding. Equal texts, and so repeated rows, give equal streams and
features. Very long texts are streams of many frames. Only doc_id and text are read, so that other columns may have any
names. An empty table gives an empty result. Bytes that are no MPEG audio parse to a stream without frames; a cut or
damaged frame counts as skipped or bad, and no bytes make the parser fail.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexloom.llm.common import as_bytes, slices

UNIT = 576
_BITRATES = {  # kbit/s by (version 1?, layer)
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by version bits: 1, 2, 2.5
#: Writer: 48 kHz, stereo, protected; 224 and 256 kbit/s in turn.
_WRITE = (bytes([0xFF, 0xFA, 0xC4, 0x00]), bytes([0xFF, 0xFA, 0xD4, 0x00]))
_SIDE = 32


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1 & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(raw: bytes) -> int:
    c = 0xFFFF
    for b in raw:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: int  # bits: 3 is MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    length: int  # bytes of the frame
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (Layer III)."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


_headers: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    """What four bytes say; None if they are no frame header (free-format bitrates are none here)."""
    if raw not in _headers:
        if len(_headers) > 4096:
            _headers.clear()
        _headers[raw] = _header(raw)
    return _headers[raw]


def _header(raw: bytes) -> Header | None:
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    b, r = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or b in (0, 15) or r == 3:
        return None
    first = version == 3
    bitrate, rate, pad = _BITRATES[first, layer][b], _RATES[version][r], raw[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12000 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * bitrate // rate + pad
    return Header(version, layer, not raw[1] & 1, bitrate, rate, raw[3] >> 6 == 3, length, samples)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def tag(frames: dict[str, str]) -> bytes:
    """An ID3v2.4 tag of text frames."""
    body = b"".join(k.encode() + _synchsafe(len(v.encode()) + 1) + b"\0\0\x03" + v.encode() for k, v in frames.items())
    return b"ID3\x04\0\0" + _synchsafe(len(body)) + body


def _protect(head: bytes, side: bytes) -> bytes:
    return head + struct.pack(">H", crc16(head[2:4] + side)) + side


_OPENINGS = [_protect(h, bytes(_SIDE)) for h in _WRITE]


def store(payload: bytes, info: dict[str, str] | None = None) -> bytes:
    """The payload, a multiple of UNIT bytes, as an MPEG audio stream."""
    if len(payload) % UNIT:
        raise ValueError("the payload isn't a multiple of the unit")
    n = len(payload) // UNIT
    lengths = [header(h).length for h in _WRITE]
    rows = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    pair = sum(lengths)
    audio = np.zeros(n // 2 * pair + n % 2 * lengths[0], np.uint8)
    for k in range(2):
        mine = rows[k::2]
        start = k * lengths[0]
        for opening in (np.frombuffer(_OPENINGS[k], np.uint8),):
            whole = audio[: n // 2 * pair].reshape(-1, pair)
            m = len(whole)
            whole[:, start : start + len(opening)] = opening
            whole[:, start + len(opening) : start + len(opening) + UNIT] = mine[:m]
            if len(mine) > m:
                audio[n // 2 * pair : n // 2 * pair + len(opening)] = opening
                audio[n // 2 * pair + len(opening) : n // 2 * pair + len(opening) + UNIT] = mine[m]
    first = lengths[0]
    total = first + len(audio)
    at = [(i // 2) * pair + i % 2 * lengths[0] for i in (j * n // 100 for j in range(100))]
    seek = bytes(min(255, 256 * (first + a) // total) for a in at)
    vbr = b"Xing" + struct.pack(">III", 7, n, total) + seek
    return tag({"TLEN": str(round(n * 1152 * 1000 / 48000)), **(info or {})}) + (_OPENINGS[0] + vbr).ljust(first, b"\0") + audio.tobytes()


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, object] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of each audio frame, for seeking
    headers: list[Header] = field(default_factory=list)
    skipped: int = 0  # bytes that belong to no frame or tag
    bad: int = 0  # frames whose checksum is wrong
    unverified: int = 0  # frames with a checksum that isn't verified: protected ones of Layers I and II

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        by_rate: dict[int, int] = {}
        for h in self.headers:
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        return sum((Fraction(n, r) for r, n in by_rate.items()), Fraction(0))

    def seek(self, seconds: float) -> int:
        """Offset of the frame that sounds at this time, the last one beyond the end; -1 without frames."""
        t = Fraction(0)
        for h, at in zip(self.headers, self.offsets, strict=True):
            t += Fraction(h.samples, h.rate)
            if seconds < t:
                return at
        return self.offsets[-1] if self.offsets else -1


def _read_tag(raw: bytes, at: int, out: Stream) -> int:
    """The end of an ID3v2 tag that begins here, its text frames read."""
    version, size = raw[at + 3], _unsafe(raw[at + 6 : at + 10])
    end, p = min(len(raw), at + 10 + size), at + 10
    while p + 10 <= end and raw[p]:
        n = _unsafe(raw[p + 4 : p + 8]) if version >= 4 else int.from_bytes(raw[p + 4 : p + 8])
        name = raw[p : p + 4].decode("latin-1")
        if name[0] == "T" and n and p + 10 < end:
            kind, text = raw[p + 10], raw[p + 11 : min(p + 10 + n, end)]
            out.tags[name] = text.decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(kind, "utf-8"), "replace").rstrip("\0")
        p += 10 + n
    return end


def _read_vbr(raw: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame is an information frame: Xing or Info behind the side information, or VBRI. What would reach
    beyond the frame is none."""
    end = at + h.length
    p = at + 4 + 2 * h.protected + h.side
    kind = raw[p : p + 4]
    if kind in (b"Xing", b"Info"):
        flags, p = int.from_bytes(raw[p + 4 : p + 8]), p + 8
        if p + sum(size for bit, size in ((1, 4), (2, 4), (4, 100), (8, 4)) if flags & bit) > end:
            return False
        out.vbr["kind"] = kind.decode()
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out.vbr[name] = list(raw[p : p + size]) if size == 100 else int.from_bytes(raw[p : p + size])
                p += size
        return True
    p = at + 4 + 32
    if raw[p : p + 4] == b"VBRI" and p + 26 <= end:
        _, _, quality, size, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", raw[p + 4 : p + 26])
        if p + 26 + entries * width > end:
            return False
        toc = [int.from_bytes(raw[p + 26 + i * width : p + 26 + (i + 1) * width]) * scale for i in range(entries)]
        out.vbr |= {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "toc": toc, "frames_per_entry": per}
        return True
    return False


_sums: dict[bytes, int] = {}


def _checked(raw: bytes, at: int, h: Header) -> bool:
    """Whether the checksum of a protected Layer III frame is right, which is over the header's last two bytes and the
    side information; True for all others, which parse() counts as unverified if they are protected."""
    if not h.protected or h.layer != 3:
        return True
    covered = raw[at + 2 : at + 4] + raw[at + 6 : at + 6 + h.side]
    if (c := _sums.get(covered)) is None:
        if len(_sums) > 4096:
            _sums.clear()
        c = _sums[covered] = crc16(covered)
    return c == raw[at + 4] << 8 | raw[at + 5]


def parse(raw: bytes) -> Stream:
    """Walk the stream; where no header stands, go on to the next sync bytes that two frames in a row confirm."""
    out, at, locked = Stream(), 0, False
    end = len(raw)
    while at + 4 <= end:
        if at == len(raw) - 128 and raw[at : at + 3] == b"TAG":  # an ID3v1 tag, which stands where a frame would
            out.tags["v1"] = raw[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1")
            return out
        if raw[at : at + 3] == b"ID3" and at + 10 <= end:
            at, locked = _read_tag(raw, at, out), False
            continue
        h = header(raw[at : at + 4])
        if h and at + h.length <= end:
            after = at + h.length
            confirmed = locked or after == end or raw[after : after + 3] == b"TAG" or (after + 4 <= end and header(raw[after : after + 4]) is not None)
            if confirmed:
                if not out.offsets and not out.vbr and h.layer == 3 and _read_vbr(raw, at, h, out):
                    pass
                else:
                    out.offsets.append(at)
                    out.headers.append(h)
                out.bad += not _checked(raw, at, h)
                out.unverified += h.protected and h.layer != 3
                at, locked = after, True
                continue
        step = raw.find(b"\xff", at + 1, end)
        step = end if step < 0 else step
        if (tagged := raw.find(b"ID3", at + 1, step)) >= 0:
            step = tagged
        if at < len(raw) - 128 < step and raw[-128:-125] == b"TAG":
            step = len(raw) - 128
        out.skipped += step - at
        at, locked = step, False
    out.skipped += max(0, end - at)
    return out


def payload_of(raw: bytes, stream: Stream | None = None) -> bytes:
    """The ancillary bytes that ``store`` put into the frames."""
    s = stream or parse(raw)
    view, skip = memoryview(raw), len(_OPENINGS[0])
    return b"".join([view[a + skip : a + skip + UNIT] for a in s.offsets])


def pad(text: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def feature(s: Stream) -> str:
    """Exact duration, frames, mean bitrate, frame offsets at the quarters of the stream, and how clean it was; frames with
    checksums that aren't verified, if there are any."""
    d, n = s.duration, len(s.headers)
    mean = sum(h.bitrate for h in s.headers) / n if n else 0.0
    quarters = ",".join(str(s.offsets[i * n // 4]) for i in range(4)) if n else ""
    layer = f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[s.headers[0].version] }l{s.headers[0].layer}" if n else "none"
    return f"{layer};seconds={d.numerator}/{d.denominator};frames={n};kbps={mean:.3f};vbr={s.vbr.get('kind', '')}:{s.vbr.get('frames', 0)};seek={quarters};bad={s.bad};skipped={s.skipped}" + f";unverified={s.unverified}" * (s.unverified > 0)


def columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, the exact duration as seconds_num / seconds_den, and frame_offsets; with ``keep_media`` the
    stream itself too."""
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string").add("seconds_num", "long").add("seconds_den", "long").add("frame_offsets", T.ArrayType(T.LongType()))
    if keep_media:
        schema = schema.add("media", "binary")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in as_bytes(batch.column(1)):
                media = store(pad(text))
                s = parse(media)
                back = payload_of(media, s)
                d = s.duration
                row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), d.numerator, d.denominator, s.offsets)
                rows.append((*row, media) if keep_media else row)
            arrays = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)] if rows else [pa.array([], k) for k in kinds[: len(schema) - 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
