"""Media columns: MPEG-1 Layer III streams that carry payload bytes losslessly, and their parser.

A stream is an ID3v2 tag, a Xing frame (frame count, bytes, seek table), audio frames at 48 kHz mono and
an ID3v1 tag. Each audio frame is silent (empty granules) and carries 192 payload bytes or a multiple of
it as ancillary data, so the stored unit is the frame's data byte; the bitrate varies with what is left.
Frames are protected: a CRC-16 over the last two header bytes and the side information.

The parser needs nothing but bytes: it skips tags, finds the next frame header that another header
follows (resynchronising after damage), reads the variable-bitrate table, checks every checksum, and
gives exact durations (samples over rate) and the byte offset of every frame.

Edge cases: null text is empty and is stored as 192 spaces; broken media gives what frames it has;
an empty table gives no rows; other columns are ignored; equal texts give equal streams.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of the format: bitrates (kbit/s) by index for MPEG-1 Layer III, sampling rates by index.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
UNIT = 192
SIDE = {True: 17, False: 32}  # bytes of side information: mono, two channels


@dataclass(frozen=True)
class Header:
    length: int
    rate: int
    mono: bool
    protected: bool
    kbits: int

    @property
    def data_at(self) -> int:
        return 4 + 2 * self.protected + SIDE[self.mono]


_headers: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    """The frame header in four bytes; None if they are no header of MPEG-1 Layer III."""
    if raw in _headers:
        return _headers[raw]
    found = None
    if len(raw) == 4 and raw[0] == 0xFF and raw[1] & 0xFE == 0xFA:
        kbits, rate = raw[2] >> 4, raw[2] >> 2 & 3
        if 0 < kbits < 15 and rate < 3:
            length = 144_000 * BITRATES[kbits] // RATES[rate] + (raw[2] >> 1 & 1)
            found = Header(length, RATES[rate], raw[3] >> 6 == 3, not raw[1] & 1, BITRATES[kbits])
    if len(_headers) < 4096:
        _headers[raw] = found
    return found


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x8005, table << 1) & 0xFFFF
    return table


CRC_TABLE = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (8005, from FFFF) of each row of bytes."""
    out = np.full(len(rows), 0xFFFF, np.uint32)
    for c in range(rows.shape[1]):
        out = (out << 8 & 0xFFFF) ^ CRC_TABLE[(out >> 8) ^ rows[:, c]]
    return out


def _frame_prefix(kbits: int) -> bytes:
    """Header, checksum and empty side information of a protected mono frame at 48 kHz."""
    head = bytes([0xFF, 0xFA, BITRATES.index(kbits) << 4 | 1 << 2, 3 << 6])
    side = bytes(SIDE[True])
    crc = int(crc16(np.frombuffer(head[2:] + side, np.uint8)[None, :])[0])
    return head + crc.to_bytes(2, "big") + side


LARGE, SMALL = 320, 80
PREFIX = {k: _frame_prefix(k) for k in (LARGE, SMALL)}
LENGTH = {k: 3 * k for k in (LARGE, SMALL)}  # 144 * kbits / 48
CARRIES = {k: (LENGTH[k] - len(PREFIX[k])) // UNIT * UNIT for k in (LARGE, SMALL)}


def _frames(payload: bytes, kbits: int) -> bytes:
    n = len(payload) // CARRIES[kbits]
    out = np.zeros((n, LENGTH[kbits]), np.uint8)
    out[:, : len(PREFIX[kbits])] = np.frombuffer(PREFIX[kbits], np.uint8)
    out[:, len(PREFIX[kbits]) : len(PREFIX[kbits]) + CARRIES[kbits]] = np.frombuffer(payload, np.uint8).reshape(n, CARRIES[kbits])
    return out.tobytes()


def padded(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def encode(text: bytes) -> bytes:
    """A stream that carries ``text`` and the spaces up to the unit."""
    payload = padded(text)
    cut = len(payload) // CARRIES[LARGE] * CARRIES[LARGE]
    audio = _frames(payload[:cut], LARGE) + _frames(payload[cut:], SMALL)
    large, small = cut // CARRIES[LARGE], (len(payload) - cut) // CARRIES[SMALL]
    total = LENGTH[SMALL] + len(audio)
    frames = large + small
    # the seek table: byte position, in 256ths, of each hundredth of the time
    at = np.arange(100) * frames // 100
    byte = LENGTH[SMALL] + np.minimum(at, large) * LENGTH[LARGE] + np.maximum(at - large, 0) * LENGTH[SMALL]
    toc = np.minimum(255, byte * 256 // total).astype(np.uint8).tobytes()
    xing = PREFIX[SMALL] + b"Xing" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    note = b"\x00n_bytes\x00" + str(len(text)).encode()
    frame = b"TXXX" + len(note).to_bytes(4, "big") + b"\x00\x00" + note
    size = bytes(len(frame) >> s & 0x7F for s in (21, 14, 7, 0))
    return b"ID3\x03\x00\x00" + size + frame + xing.ljust(LENGTH[SMALL], b"\x00") + audio + b"TAG" + bytes(124) + b"\xff"


@dataclass
class Stream:
    n_bytes: int | None = None
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    skipped: int = 0
    checked: int = 0
    sound: int = 0

    @property
    def duration(self) -> tuple[int, int]:
        """Exact seconds as a fraction: samples and rate."""
        return len(self.offsets) * SAMPLES, self.headers[0].rate if self.headers else RATES[1]


def _tag(media: bytes, out: Stream) -> int:
    """Read the ID3v2 tag, if there is one; where the audio begins."""
    if media[:3] != b"ID3" or len(media) < 10:
        return 0
    end = 10 + sum((b & 0x7F) << s for b, s in zip(media[6:10], (21, 14, 7, 0)))
    at = 10
    while at + 10 <= end and media[at : at + 4].strip(b"\x00"):
        size = int.from_bytes(media[at + 4 : at + 8], "big")
        body = media[at + 10 : at + 10 + size]
        if media[at : at + 4] == b"TXXX" and body[1:9] == b"n_bytes\x00" and body[9:].isdigit():
            out.n_bytes = int(body[9:])
        at += 10 + size
    return end


def parse(media: bytes) -> Stream:
    out = Stream()
    at, end = _tag(media, out), len(media) - (128 if media[-128:-125] == b"TAG" else 0)
    while at + 4 <= end:
        head = header(media[at : at + 4])
        after = at + head.length if head else 0
        if head is None or after > end or after + 4 <= end and header(media[after : after + 4]) is None:
            step = media.find(b"\xff", at + 1, end)  # resynchronise at the next candidate
            step = end if step < 0 else step
            out.skipped += step - at
            at = step
            continue
        mark = at + head.data_at
        if not out.offsets and out.vbr_frames is None and media[mark : mark + 4] == b"Xing":
            flags, mark = int.from_bytes(media[mark + 4 : mark + 8], "big"), mark + 8
            out.vbr_frames = 0
            if flags & 1:
                out.vbr_frames, mark = int.from_bytes(media[mark : mark + 4], "big"), mark + 4
            if flags & 2:
                out.vbr_bytes, mark = int.from_bytes(media[mark : mark + 4], "big"), mark + 4
            if flags & 4:
                out.toc = media[mark : mark + 100]
        else:
            out.offsets.append(at)
            out.headers.append(head)
        at = after
    _verify(media, out)
    return out


def _verify(media: bytes, out: Stream) -> None:
    raw = np.frombuffer(media, np.uint8)
    for mono in (True, False):
        at = np.array([o for o, h in zip(out.offsets, out.headers) if h.protected and h.mono == mono], np.int64)
        if len(at):
            rows = np.concatenate([raw[at[:, None] + np.arange(2, 4)], raw[at[:, None] + np.arange(6, 6 + SIDE[mono])]], axis=1)
            stored = raw[at + 4].astype(np.uint32) << 8 | raw[at + 5]
            out.checked += len(at)
            out.sound += int((crc16(rows) == stored).sum())


def payload_of(media: bytes, stream: Stream) -> bytes:
    parts = []
    for at, head in zip(stream.offsets, stream.headers):
        begin = at + head.data_at
        parts.append(media[begin : begin + (head.length - head.data_at) // UNIT * UNIT])
    return b"".join(parts)


def seek(stream: Stream, second: float) -> int | None:
    """Byte offset of the frame that sounds at ``second``; None outside the stream."""
    rate = stream.duration[1]
    at = int(second * rate // SAMPLES)
    return stream.offsets[at] if 0 <= at < len(stream.offsets) else None


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, media: each whole text stored as a stream."""
    common.bounded_batches(docs.sparkSession, 128)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = common.columns_of(batch, "doc_id", "text")
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([encode(t) for t in texts], pa.binary())], names=["doc_id", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(made, "doc_id long, media binary")


PROPERTIES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def properties(stored: DataFrame, offsets: bool = False) -> DataFrame:
    """What the parser finds in each stored stream; with ``offsets``, also every frame's byte offset."""
    common.bounded_batches(stored.sparkSession, 128)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, media in zip(*common.columns_of(batch, "doc_id", "media")):
                stream = parse(media or b"")
                payload = payload_of(media or b"", stream)
                samples, rate = stream.duration
                places = np.array(stream.offsets, "<u4")
                level = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64))
                feature = f"frames={len(places)};samples={samples};rate={rate};vbr={stream.vbr_frames};sound={stream.sound}/{stream.checked};skipped={stream.skipped};seek={zlib.crc32(places.tobytes())};toc={zlib.crc32(stream.toc)};level={level}"
                row = (doc_id, stream.n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), feature)
                rows.append((*row, stream.offsets) if offsets else row)
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PROPERTIES.split(", ")] + ["offsets"] * offsets)

    return stored.select("doc_id", "media").mapInArrow(read, PROPERTIES + (", offsets array<long>" if offsets else ""))
