"""MPEG audio columns: frames written around any payload, and a parser that resynchronises.

Writing: every 576 payload bytes fill one MPEG-2 Layer III frame (16 kHz, mono, 144 kbit/s, CRC on),
whose side information declares no audio data, so a player decodes silence and the payload rides as
ancillary bytes.  The stream begins with an ID3v2 tag and a Xing/Info table frame and ends in an ID3v1 tag, so
no payload byte can be taken for one.

Reading: skip tags, find frame headers (each must lead to another one, or to the end), read the
variable-bitrate table, verify checksums, and give exact durations and frame seek offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm import textcore

# Fixed values of the format: bit rates in kbit/s by index 1..14 and sampling rates in Hz.
BIT_RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

UNIT = 576
HEADER = bytes([0xFF, 0xF2, 13 << 4 | 2 << 2, 0xC0])  # MPEG-2, Layer III, CRC; 144 kbit/s, 16 kHz; mono
FRAME = 648
SIDE = 9
BODY = 4 + 2 + SIDE


def crc16(data: bytes, start: int = 0xFFFF) -> int:
    """The format's checksum: polynomial 0x8005, most significant bit first."""
    for byte in data:
        start ^= byte << 8
        for _ in range(8):
            start = (start << 1 ^ 0x8005 if start & 0x8000 else start << 1) & 0xFFFF
    return start


@dataclass
class Header:
    version: float
    layer: int
    has_crc: bool
    bit_rate: int
    rate: int
    padding: int
    mono: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12 * self.bit_rate // self.rate + self.padding) * 4
        return self.samples // 8 * self.bit_rate // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information in a Layer III frame."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


def read_header(data: bytes, at: int) -> Header | None:
    """The frame header at a place, or None where there is none (free format counts as none)."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b, c, d = data[at + 1], data[at + 2], data[at + 3]
    version = {0: 2.5, 2: 2, 3: 1}.get(b >> 3 & 3)
    layer = {1: 3, 2: 2, 3: 1}.get(b >> 1 & 3)
    if version is None or layer is None or c >> 4 in (0, 15) or c >> 2 & 3 == 3:
        return None
    kbit = BIT_RATES[1 if version == 1 else 2, layer][(c >> 4) - 1]
    return Header(version, layer, not b & 1, kbit * 1000, SAMPLE_RATES[version][c >> 2 & 3], c >> 1 & 1, d >> 6 == 3)


def allocation_bytes(data: bytes, at: int, head: Header) -> int:
    """Bytes of the bit allocation of a Layer I frame: four bits a subband, shared ones once."""
    mode, extension = data[at + 3] >> 6, data[at + 3] >> 4 & 3
    own = 0 if head.mono else 4 * (extension + 1) if mode == 1 else 32
    return (2 * own + 32 - own) // 2


@dataclass
class Stream:
    tags: dict = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    table_seek: list[int] = field(default_factory=list)
    seek: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    checked: int = 0
    crc_errors: int = 0
    skipped: int = 0

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def read_tags(data: bytes) -> tuple[dict, int, int]:
    """Tag texts (ID3v2 frames, else ID3v1 fields), and where the audio begins and ends."""
    tags, at, end = {}, 0, len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            tags[name] = data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip()
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        major, flags, size = data[at + 3], data[at + 5], _synchsafe(data[at + 6 : at + 10])
        stop, place = min(at + 10 + size, end), at + 10
        while major >= 3 and place + 10 <= stop and data[place : place + 4].strip(b"\0"):
            raw = data[place + 4 : place + 8]
            length = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
            body = data[place + 10 : min(place + 10 + length, stop)]
            if data[place : place + 1] == b"T" and body:
                coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                tags[data[place : place + 4].decode("latin-1")] = body[1:].decode(coding, "replace").rstrip("\0")
            place += 10 + length
        at = stop + 10 * bool(flags & 0x10)
    return tags, min(at, end), end


def _table(data: bytes, at: int, head: Header, out: Stream) -> bool:
    """Whether the frame holds a variable-bitrate table; notes what it says."""
    for place, kinds in ((at + 4 + head.side, (b"Xing", b"Info")), (at + 6 + head.side, (b"Xing", b"Info")), (at + 36, (b"VBRI",))):
        kind = data[place : place + 4]
        if kind not in kinds:
            continue
        out.table = kind.decode()
        if kind == b"VBRI":
            if place + 18 <= len(data):
                out.table_bytes, out.table_frames = struct.unpack_from(">II", data, place + 10)
            if place + 26 <= len(data):
                entries, scale, width, _ = struct.unpack_from(">HHHH", data, place + 18)
                ends = range(place + 26, min(place + 26 + entries * width, len(data) - width + 1), max(1, width))
                steps = [int.from_bytes(data[e : e + width], "big") * scale for e in ends] if 0 < width <= 4 else []
                out.table_seek = np.cumsum(steps).tolist()
            return True
        flags = int.from_bytes(data[place + 4 : place + 8], "big")
        place += 8
        for bit, name in ((1, "table_frames"), (2, "table_bytes")):
            if flags & bit and place + 4 <= len(data):
                setattr(out, name, int.from_bytes(data[place : place + 4], "big"))
                place += 4
        if flags & 4 and place + 100 <= len(data) and out.table_bytes:
            out.table_seek = [b * out.table_bytes // 256 for b in data[place : place + 100]]
        return True
    return False


def _old_tag(data: bytes, at: int, end: int) -> bool:
    """Whether a further ID3v1 tag fills the rest, as in a stream that was tagged twice."""
    return end - at == 128 and data[at : at + 3] == b"TAG"


def parse(data: bytes) -> Stream:
    """Frames, tags, table, checksums and durations of an MPEG audio stream; never raises on junk."""
    out = Stream()
    out.tags, at, end = read_tags(data)
    first = True
    known: dict[bytes, int] = {}
    while at < end:
        if not first and _old_tag(data, at, end):
            break
        head = read_header(data, at)
        after = at + head.size if head else 0
        if not head or head.size < 4 or after > end or (after < end and not read_header(data, after) and not _old_tag(data, after, end)):
            # Resynchronise: go on to the next byte that can begin a header.
            found = data.find(b"\xff", at + 1, end)
            out.skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        if first and head.layer == 3 and _table(data, at, head, out):
            first, at = False, after
            out.rate = out.rate or head.rate
            continue
        first = False
        if head.has_crc and head.layer != 2:  # Layer II's checksum covers a stretch of bits that depends on tables not held here
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + (head.side if head.layer == 3 else allocation_bytes(data, at, head))]
            if covered not in known:
                known[covered] = crc16(covered)
            out.checked += 1
            out.crc_errors += known[covered] != int.from_bytes(data[at + 4 : at + 6], "big")
        out.seek.append(at)
        out.sizes.append(head.size)
        out.samples += head.samples
        out.rate = out.rate or head.rate
        at = after
    return out


def pad(payload: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the unit."""
    return payload + b"\xff" * (-len(payload) % UNIT if payload else UNIT)


def _tag(title: str) -> bytes:
    text = b"\x03" + title.encode()
    frame = b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text
    size = len(frame)
    return b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + frame


def _table_frame(frames: int, size: int) -> bytes:
    steps = bytes(min(255, 256 * i // 100) for i in range(100))
    side = bytes(SIDE)
    body = b"Info" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + size.to_bytes(4, "big") + steps
    head = HEADER + crc16(HEADER[2:] + side).to_bytes(2, "big") + side + body
    return head + bytes(FRAME - len(head))


def write(payload: bytes, title: str = "payload") -> bytes:
    """A stream around a payload whose length is a positive multiple of the unit."""
    count = len(payload) // UNIT
    side = bytes(SIDE)
    frames = np.zeros((count, FRAME), np.uint8)
    frames[:, :BODY] = np.frombuffer(HEADER + crc16(HEADER[2:] + side).to_bytes(2, "big") + side, np.uint8)
    frames[:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(count, UNIT)
    last = b"TAG" + title.encode("latin-1", "replace")[:30].ljust(30, b"\0") + bytes(94) + b"\xff"
    return _tag(title) + _table_frame(count, (count + 1) * FRAME) + frames.tobytes() + last


def read_payload(data: bytes, stream: Stream) -> bytes:
    """The payload of a stream that write() made, from its frames' places."""
    raw = np.frombuffer(data, np.uint8)
    at = np.array(stream.seek, np.int64)
    if not len(at):
        return b""
    if (np.diff(at) == FRAME).all():
        return raw[at[0] : at[0] + FRAME * len(at)].reshape(-1, FRAME)[:, BODY : BODY + UNIT].tobytes()
    return b"".join(data[a + BODY : a + BODY + UNIT] for a in at)


def parse_regular(data: bytes) -> Stream:
    """parse(), but runs of like frames (same header and side bytes) are walked with array steps."""
    tags, at, end = read_tags(data)
    head = read_header(data, at)
    if head and head.layer == 3 and (end - at) % head.size == 0 and head.size > BODY:
        raw = np.frombuffer(data, np.uint8)[at:end].reshape(-1, head.size)
        fixed = raw[:, : 6 + head.side]
        probe = Stream(tags)
        if len(raw) > 1 and (fixed == fixed[0]).all() and _table(data, at, head, probe) and head.has_crc:
            probe.rate = head.rate
            covered = fixed[0, 2:4].tobytes() + fixed[0, 6:].tobytes()
            probe.checked = len(raw) - 1
            probe.crc_errors = probe.checked * (crc16(covered) != int.from_bytes(fixed[0, 4:6].tobytes(), "big"))
            probe.seek = (at + head.size * np.arange(1, len(raw))).tolist()
            probe.sizes = [head.size] * (len(raw) - 1)
            probe.samples = head.samples * (len(raw) - 1)
            return probe
    return parse(data)


def feature(stream: Stream) -> str:
    """Exact duration, frames, checksum result, table and a digest of the seek offsets, as text."""
    table = f"{stream.table or 'none'}:{stream.table_frames}" if stream.table else "none"
    seek = zlib.crc32(np.array(stream.seek, "<u8").tobytes())
    return f"samples={stream.samples};rate={stream.rate};frames={len(stream.seek)};crc={stream.checked - stream.crc_errors}/{stream.checked};table={table};skipped={stream.skipped};seek={seek:08x}"


def encode_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, padded, as an MPEG audio stream.

    Null and empty texts give one frame of padding; null keys, ties and repeated rows stay, one row
    each; other columns do not matter, whatever their names; an empty table gives an empty one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in textcore.text_groups(batch, 1):
                texts = [x.tobytes() for x in texts]
                media = pa.array([write(pad(x)) for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), media], ["k", "n_bytes", "media"])

    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return slim.mapInArrow(textcore.lean(encode), f"k {slim.schema['k'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("k", key)


DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest_column(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each stored stream: what its payload reads back as, and its features.  Null media count as empty."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                data = value.as_py() or b""
                stream = parse_regular(data)
                payload = read_payload(data, stream)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(stream)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["k", "n_bytes", *[x.split()[0] for x in DIGESTS.split(", ")]])

    slim = media.select(F.col(key).alias("k"), "n_bytes", "media")
    return slim.mapInArrow(textcore.lean(digest), f"k {slim.schema['k'].dataType.simpleString()}, n_bytes long, {DIGESTS}").withColumnRenamed("k", key)


INDEX = "seconds double, samples long, rate int, frames int, seek array<long>, table string, table_frames long, table_seek array<long>, checked int, crc_errors int, skipped long, tags map<string,string>"


def index_column(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, exact duration, frame seek offsets, table, checksums, tags) of each stored stream.

    Null or broken streams have no frames and last 0 seconds; null keys and repeated rows stay, one
    row each; other columns do not matter; an empty table gives an empty one.
    """
    names = [x.split()[0] for x in INDEX.split(", ")]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()))
        for batch in batches:
            rows = []
            for value in batch.column(1):
                s = parse_regular(value.as_py() or b"")
                rows.append((s.seconds, s.samples, s.rate, len(s.seek), s.seek, s.table, s.table_frames, s.table_seek, s.checked, s.crc_errors, s.skipped, list(s.tags.items())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], ["k", *names])

    slim = media.select(F.col(key).alias("k"), F.col(column).alias("m"))
    return slim.mapInArrow(textcore.lean(index), f"k {slim.schema['k'].dataType.simpleString()}, {INDEX}").withColumnRenamed("k", key)
