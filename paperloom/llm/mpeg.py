"""MPEG audio columns: write bytes into layer III frames, and parse any MPEG audio stream.

The parser skips ID3v2 and APE tags in front and ID3v1 at the end, resynchronises on frame headers (a header counts
if the next one, or the end, stands where it says), reads Xing/Info and VBRI tables, verifies CRC-16 where a frame has
one, and gives the exact duration (samples and rate), each frame's byte offset and the ancillary bytes of layer III
frames. The writer stores a payload losslessly: frames of silence whose side information is zero, so the rest of each
frame is ancillary data, protected by CRC-16, after an ID3v2 tag with the payload's length and an Info frame with a
seek table.

Nulls: a null text counts as empty, a null id is kept; empty texts give one block of 64 zero bytes. Equal texts give
equal files. Streams with no frame parse to no frames and a duration of 0.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_rows, texts

# Fixed values of the MPEG audio format: kbit/s by index for (version 1 or 2, layer), Hz by index for each version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
CRC_TABLE = []
for _b in range(256):
    _r = _b << 8
    for _ in range(8):
        _r = (_r << 1 ^ 0x8005 if _r & 0x8000 else _r << 1) & 0xFFFF
    CRC_TABLE.append(_r)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 of the format (polynomial 0x8005, start 0xFFFF)."""
    r = 0xFFFF
    for b in data:
        r = (r << 8 & 0xFFFF) ^ CRC_TABLE[r >> 8 ^ b]
    return r


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mono: bool
    mode: int
    extension: int

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 3 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12 * self.bitrate // self.rate + self.padding) * 4
        return self.samples // 8 * self.bitrate // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of a layer III frame's side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The meaning of a frame header, or None if it isn't one (free-format frames, of unknown size, count as none)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    at, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or at in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbit = BITRATES[(1 if version == 3 else 2, layer)][at]
    return Header(version, layer, not four[1] & 1, kbit * 1000, RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6 == 3, four[3] >> 6, four[3] >> 4 & 3)


@dataclass
class Stream:
    """What parsing found; offsets are of audio frames, without the table frame."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    version: str = ""
    layer: int = 0
    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    crc_checked: int = 0
    crc_failed: int = 0
    skipped: int = 0
    ancillary: list[bytes] = field(default_factory=list)


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Read an ID3v2 tag's text frames; the offset after it."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return at
    major, end = data[at + 3], at + 10 + _synchsafe(data[at + 6 : at + 10])
    after = end + 10 * bool(data[at + 5] & 0x10)
    p = at + 10
    if data[at + 5] & 0x40 and end >= p + 4:  # an extended header, whose size counts itself from version 4 on
        p += _synchsafe(data[p : p + 4]) if major >= 4 else 4 + int.from_bytes(data[p : p + 4], "big")
    while p + 10 <= min(end, len(data)) and data[p : p + 4].strip(b"\0"):
        size = _synchsafe(data[p + 4 : p + 8]) if major >= 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        body = data[p + 10 : p + 10 + size]
        if data[p : p + 1] == b"T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            name, _, value = text.partition("\0") if data[p : p + 4] == b"TXXX" else (data[p : p + 4].decode("latin-1"), "", text)
            tags[name] = value.rstrip("\0")
        p += 10 + size
    return after


def _table(frame: bytes, h: Header) -> dict | None:
    """A Xing/Info or VBRI table inside a frame."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        found: dict = {"kind": frame[at : at + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found[name] = int.from_bytes(frame[p : p + 4], "big")
                p += 4
        if flags & 4:
            found["toc"] = list(frame[p : p + 100])
        return found
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": toc, "frames_per_entry": per}
    return None


def _covered(data: bytes, at: int, h: Header) -> bytes | None:
    """What a frame's CRC covers; None for layer II, whose bit allocation has no fixed size."""
    if h.layer == 3:
        return data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]
    if h.layer == 1:
        bound = 32 if h.mode != 1 else 4 * (h.extension + 1)
        bits = 128 if h.mono else 4 * (bound + 32)
        return data[at + 2 : at + 4] + data[at + 6 : at + 6 + bits // 8]
    return None


def parse(data: bytes) -> Stream:
    """Parse a whole stream."""
    s = Stream()
    at, end = _id3v2(data, 0, s.tags), len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        s.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    for place in (at, end - 32):
        if place >= 0 and data[place : place + 8] == b"APETAGEX":
            size = int.from_bytes(data[place + 12 : place + 16], "little")
            if place == at:
                at = place + 32 + size
            else:
                end = max(at, end - size)
    first = True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        # in sync: the frame ends the stream, or another header follows
        if not h or after > end or (after + 4 <= end and header(data[after : after + 4]) is None):
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            s.skipped += step - at
            at = step
            continue
        table = _table(data[at:after], h) if first and h.layer == 3 else None
        first = False
        if h.protected:
            covered = _covered(data, at, h)
            if covered is not None:
                s.crc_checked += 1
                s.crc_failed += crc16(covered) != int.from_bytes(data[at + 4 : at + 6], "big")
        if table:
            s.table = table
        else:
            s.offsets.append(at)
            s.samples += h.samples
            s.version, s.layer, s.rate = VERSIONS[h.version], h.layer, h.rate
            if h.layer == 3:
                s.ancillary.append(data[at + 4 + 2 * h.protected + h.side : after])
        at = after
    return s


# The writer's frames: version 1, layer III, 48 kHz mono with CRC; at 48 kHz no frame needs padding.
RATE, SAMPLES, SIDE = 48000, 1152, 17
SIZES = {k: SAMPLES // 8 * kbit * 1000 // RATE for k, kbit in enumerate(BITRATES[(1, 3)]) if k}
LEAD = 4 + 2 + SIDE


@lru_cache(maxsize=16)
def _lead(index: int) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    return head + crc16(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


def write(payload: bytes) -> bytes:
    """The payload as an MPEG audio file."""
    room = SIZES[14] - LEAD
    frames = []
    for i in range(0, len(payload), room):
        part = payload[i : i + room]
        index = next(k for k, size in SIZES.items() if size - LEAD >= len(part))
        frames.append(_lead(index) + part + bytes(SIZES[index] - LEAD - len(part)))
    audio = b"".join(frames)
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    size = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    tag = b"TXXX" + size(len(text)) + b"\0\0" + text
    total = len(audio) + SIZES[9]
    # 100 steps of the playing time: the byte offset, in 256ths of the whole, of the frame that plays then
    toc = bytes(min(255, (SIZES[9] + (k * len(frames) // 100) * SIZES[14]) * 256 // total) for k in range(100))
    info = _lead(9) + b"Info" + struct.pack(">III", 7, len(frames), total) + toc
    return b"ID3\x04\0\0" + size(len(tag)) + tag + info + bytes(SIZES[9] - len(info)) + audio


def read_payload(s: Stream) -> bytes:
    return b"".join(s.ancillary)[: int(s.tags["payload_bytes"])]


def padded(text: str | None) -> tuple[int, bytes]:
    """A text's bytes, padded with zeros to a positive multiple of 64, and their number before."""
    b = (text or "").encode()
    return len(b), b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, sample_rate long, samples long, n_frames long, seek_offsets array<long>"
FULL = DIGEST + ", media binary"


def audio_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Store each whole text as MPEG audio, parse the stored bytes and return digests (and file, duration, offsets)."""
    ddl = FULL if with_media else DIGEST

    def rows(ids, found):
        out = []
        for i, t in zip(ids, found):
            n, payload = padded(t)
            media = write(payload)
            s = parse(media)
            back = read_payload(s)
            seek = zlib.crc32(struct.pack(f"<{len(s.offsets)}Q", *s.offsets))
            feature = f"mpeg{s.version} layer{s.layer} {s.rate}Hz frames={len(s.offsets)} duration={s.samples}/{s.rate} table={s.table['kind']}:{s.table['frames']} crc={s.crc_checked - s.crc_failed}/{s.crc_checked} skipped={s.skipped} seek={seek:08x}"
            row = (i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.rate, s.samples, len(s.offsets), s.offsets)
            out.append(row + ((media,) if with_media else ()))
        return dict(zip((c.split()[0] for c in ddl.split(", ")), zip(*out)))

    return map_rows(texts(docs, id_col, text_col), rows, ddl)
