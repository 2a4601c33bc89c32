"""Media columns in Ogg: a multiplexer and a demultiplexer.

A text's bytes, padded with zeros to a positive multiple of 64, are 8-bit samples of the logical stream AUDIO; the stream
NOTES has one packet for each audio packet, with its sample count. Pages of both are interleaved. Reading verifies the
checksum of each page, checks the page sequence of each stream, joins packets from lacing values across pages, and derives
times from granule positions, which count samples (the sample rate is in the audio stream's first packet).

The checksum of Ogg is CRC-32 with polynomial 0x04c11db7, most significant bit first, from 0. It is computed by zlib's
CRC-32, which has the same polynomial and goes the other way, on bytes with their bits reversed.

Cases: a null or empty text gives 64 zero samples. Equal texts give equal files. Texts of any length are read and written
whole. A stored value that is null or no whole Ogg file is described by its size and digest, nulls, and what is wrong in the column
error, which is null otherwise. Rows are independent: repeated rows, null doc_ids and empty tables need no care; other columns are
left behind.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batch_of, column, pieces, raw_text

AUDIO, NOTES = 1, 2
RATE, UNIT, PACKET = 8000, 64, 8192
CONTINUED, FIRST, LAST = 1, 2, 4
MAGIC, NOTE_MAGIC = b"PCM8    ", b"NOTE    "
HEADER = struct.Struct("<4sBBqIIIB")
_reversed_bits = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


class Corrupt(ValueError):
    """The bytes are not a whole Ogg file."""


def checksum(page: bytes) -> int:
    x = zlib.crc32(page.translate(_reversed_bits), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_reversed_bits), "big")


def page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    blank = HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return blank[:22] + checksum(blank).to_bytes(4, "little") + blank[26:]


def stream_pages(serial: int, packets: list[tuple[bytes, int]], segments: int = 255) -> list[bytes]:
    """The pages of one logical stream, of at most ``segments`` lacing values. The first packet has the first page alone."""
    out, lacing, body, ends, flags, sequence = [], bytearray(), bytearray(), -1, FIRST, 0

    def flush(more: int = 0) -> None:
        nonlocal lacing, body, ends, flags, sequence
        out.append(page(serial, sequence, flags | more, ends, bytes(lacing), bytes(body)))
        lacing, body, ends, flags, sequence = bytearray(), bytearray(), -1, 0, sequence + 1

    for k, (data, granule) in enumerate(packets):
        values = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        for j, value in enumerate(values):
            if len(lacing) == segments:
                flush()
                flags = CONTINUED if j else 0
            lacing.append(value)
            body += data[at : at + value]
            at += value
        ends = granule
        if k == 0 and len(packets) > 1:
            flush()
    flush(LAST)
    return out


def encode(samples: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg file with the samples and their notes."""
    parts = [samples[a : a + packet] for a in range(0, len(samples), packet)]
    audio, notes, done = [(MAGIC + struct.pack("<IBB", rate, 1, 8), 0)], [(NOTE_MAGIC, 0)], 0
    for x in parts:
        done += len(x)
        audio.append((x, done))
        notes.append((struct.pack("<I", len(x)), done))
    a, b = stream_pages(AUDIO, audio), stream_pages(NOTES, notes)
    first, rest = [a[0], b[0]], [a[1:], b[1:]]
    for k in range(max(map(len, rest))):
        first += [x[k] for x in rest if k < len(x)]
    return b"".join(first)


def demultiplex(data: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """The packets of each logical stream by serial number, each with its page's granule position if it is the last that ends on the page, else None."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise Corrupt("a page is cut short")
        magic, version, flags, granule, serial, sequence, crc, count = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < count or end > len(data):
            raise Corrupt("no whole page where one should begin")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise Corrupt(f"a checksum is wrong in stream {serial}, page {sequence}")
        s = streams.setdefault(serial, {"next": 0, "open": None, "packets": [], "over": False})
        if sequence != s["next"] or s["over"] or bool(flags & FIRST) != (sequence == 0):
            raise Corrupt(f"pages of stream {serial} are missing or out of order")
        if bool(flags & CONTINUED) != (s["open"] is not None):
            raise Corrupt(f"a packet of stream {serial} is broken")
        s["next"] += 1
        s["over"] = bool(flags & LAST)
        place, begun, ended = at + 27 + count, at + 27 + count, 0
        for value in lacing:
            place += value
            if value < 255:
                s["packets"].append(((s["open"] or b"") + data[begun:place], None))
                s["open"], begun, ended = None, place, ended + 1
        if place > begun or (count and lacing[-1] == 255):
            s["open"] = (s["open"] or b"") + data[begun:place]
        if ended:
            s["packets"][-1] = (s["packets"][-1][0], granule)
        at = end
    for serial, s in streams.items():
        if s["open"] is not None or not s["over"]:
            raise Corrupt(f"stream {serial} doesn't end")
    return {serial: s["packets"] for serial, s in streams.items()}


def decode(data: bytes) -> tuple[bytes, list[float]]:
    """The samples, and the end of each audio packet in seconds: a page's granule position is where the last packet that ends on it
    ends, the packets before it are placed by their lengths. The first position may lie above 0, the last may trim the end."""
    streams = demultiplex(data)
    if not streams.get(AUDIO) or not streams.get(NOTES) or not streams[AUDIO][0][0].startswith(MAGIC) or streams[NOTES][0][0] != NOTE_MAGIC:
        raise Corrupt("a stream is missing")
    (head, _), *audio = streams[AUDIO]
    if len(head) < len(MAGIC) + 6 or not (rate := struct.unpack_from("<I", head, 8)[0]):
        raise Corrupt("the sample rate is missing")
    if not audio or [x for x, _ in streams[NOTES][1:]] != [struct.pack("<I", len(x)) for x, _ in audio]:
        raise Corrupt("the notes don't fit the samples")
    ends, waiting, before, over = [], [], None, 0
    for k, (x, granule) in enumerate(audio):
        waiting.append(len(x))
        if granule is None:
            continue
        last = k == len(audio) - 1
        if before is None:
            before = granule - sum(waiting)
            if last:
                before = max(before, 0)
        over = before + sum(waiting) - granule
        if before < 0 or granule < before or over < 0 or (over and not last):
            raise Corrupt("a granule position doesn't fit the samples")
        ends += [min(before + n, granule) for n in accumulate(waiting)]
        before, waiting = granule, []
    samples = b"".join(x for x, _ in audio)
    if over >= len(samples):
        raise Corrupt("no samples are left")
    return samples[: len(samples) - over], [e / rate for e in ends]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def features(samples: bytes, times: list[float]) -> str:
    """Duration, mean, root mean square, peak and zero crossings of the samples around 128, as text."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int16) - 128
    wide = x.astype(np.int64)
    crossings = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    return f"packets={len(times)};seconds={times[-1]:.6f};mean={wide.mean():.6f};rms={np.sqrt((wide * wide).mean()):.6f};peak={int(np.abs(x).max())};crossings={crossings}"


STORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


def _store(batches):
    for batch in pieces(batches):
        texts = [x or b"" for x in column(batch, "text")]
        yield batch_of(STORED, [batch.column(0), [len(x) for x in texts], [encode(padded(x)) for x in texts]])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and media: an Ogg file with the text's bytes as samples."""
    return raw_text(docs).mapInArrow(_store, STORED)


READ = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        *(T.StructField(n, k) for n, k in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("error", T.StringType()))),
    ]
)


def _read(batches):
    for batch in pieces(batches, column="media"):
        rows = []
        for doc, n, media in zip(*(column(batch, c) for c in STORED.names), strict=True):
            if media is None:
                rows.append((doc, n, *[None] * 6, "no media"))
                continue
            stored = len(media), hashlib.sha256(media).hexdigest()
            try:
                samples, times = decode(media)
                rows.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), *stored, features(samples, times), None))
            except Corrupt as e:
                rows.append((doc, n, None, None, None, *stored, None, str(e)))
        yield batch_of(READ, list(zip(*rows, strict=True)) or [[]] * len(READ))


def described(stored: DataFrame) -> DataFrame:
    """Digests and features of stored media, computed from what is read back."""
    return stored.select(*STORED.names).mapInArrow(_read, READ)
