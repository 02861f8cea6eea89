"""Ogg media columns: pages with verified checksums, packets from lacing values, logical streams and granule times.

The format's parts that must be as they are: a page is "OggS", version 0, a header type (1 continued packet, 2 first page
of a stream, 4 last), the granule position (signed 64 bits, -1: no packet ends here), serial number, page number, CRC-32
(polynomial 0x04C11DB7, no reflection, initial and final value 0, over the page with this field zero), the number of
segments and their lacing values; a packet ends at the first lacing value under 255.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

FRAME = 576
RATE = 8000
PACKET = 4 * FRAME
STREAMS = 2
_HEADER = struct.Struct("<4sBBqIIIB")
#: Each byte with its bits in the opposite order: the checksum is the common reflected one over such bytes.
_MIRROR = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def checksum(data: bytes) -> int:
    """The page CRC-32, by way of zlib's: its bits are mirrored, and it starts and ends with all ones instead of zero."""
    return int(f"{zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def pages_of(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """A logical stream's pages. The first packet, the stream's header, has a page of its own; the others run on over
    page ends."""
    made = [_page(2 | 4 * (len(packets) == 1), 0, serial, 0, bytes([len(packets[0])]), packets[0])]
    lacing, ends = bytearray(), []  # of all other packets; the number of the segment that ends each
    for packet in packets[1:]:
        lacing += b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        ends.append(len(lacing) - 1)
    body, at, number, k, open_packet = b"".join(packets[1:]), 0, 1, 0, False
    for first in range(0, len(lacing), 255):
        part = bytes(lacing[first : first + 255])
        size, granule = sum(part), -1
        while k < len(ends) and ends[k] < first + len(part):
            granule = granules[k]
            k += 1
        last = first + 255 >= len(lacing)
        made.append(_page(open_packet | 4 * last, granule, serial, number, part, body[at : at + size]))
        at, number, open_packet = at + size, number + 1, part[-1] == 255
    return made


def encode(samples: bytes, packet: int = PACKET, streams: int = STREAMS, rate: int = RATE) -> bytes:
    """An Ogg file of unsigned 8-bit samples: the packets are dealt to the logical streams in turn, and a packet's
    granule position is the number of samples up to its end in the whole signal."""
    cuts = [samples[k : k + packet] for k in range(0, len(samples), packet)]
    ends = np.minimum(np.arange(1, len(cuts) + 1) * packet, len(samples)).tolist()
    head = [b"PCM8" + struct.pack("<III", rate, packet, streams) + bytes([s]) for s in range(streams)]
    made = [pages_of(s + 1, [head[s], *cuts[s::streams]], ends[s::streams]) for s in range(streams)]
    turns = sorted((n, s) for s, pages in enumerate(made) for n in range(len(pages)))
    return b"".join(made[s][n] for n, s in turns)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    times: list[float | None] = field(default_factory=list)  # seconds at the end of each packet, as far as known
    pages: int = 0
    next_page: int = 0  # the number that the stream's next page should have
    ended: bool = False
    open: bytes | None = None


@dataclass
class Decoded:
    streams: dict[int, Stream]
    bad_pages: int
    lost_packets: int
    missing_pages: int = 0


def decode(data: bytes, rate: int = RATE) -> Decoded:
    """Pages in any order of streams, each verified. A page with a wrong checksum is counted and skipped; a gap in a
    stream's page numbers is counted as missing pages, and a packet that was open before it, or that the page after it
    continues, as lost; so is what is cut off at the end. A page's granule position times its last packet; the
    sizes of the packets time those before it on the page."""
    found, bad, lost, missing, at = {}, 0, 0, 0, 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > len(data):
            bad += 1
            break
        _, version, kind, granule, serial, number, crc, n = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        start, size = at + 27 + n, sum(lacing)
        page = data[at : start + size]
        if len(page) < 27 + n + size or version or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad, at = bad + 1, at + 4
            continue
        stream = found.setdefault(serial, Stream())
        stream.pages += 1
        if number > stream.next_page:
            missing += number - stream.next_page
            lost += stream.open is not None
            stream.open = None
        stream.next_page = number + 1
        if kind & 2:
            stream.open = None
        part = stream.open if kind & 1 else None
        skip = bool(kind & 1) and part is None  # the packet began on a page that is missing
        lost += skip + (stream.open is not None and not kind & 1)
        part, stream.open, ended = part or b"", None, 0
        offset = start
        pieces = [part] if part else []
        for value in lacing:
            pieces.append(data[offset : offset + value])
            offset += value
            if value < 255:
                if skip:
                    skip = False
                else:
                    stream.packets.append(b"".join(pieces))
                    stream.times.append(None)
                    ended += 1
                pieces = []
        if n and lacing[-1] == 255:
            stream.open = None if skip else b"".join(pieces)
        if ended and granule >= 0:
            back, end = _spacing(stream, rate), granule
            for k in range(1, ended + 1):
                if k > 1:
                    end -= len(stream.packets[1 - k]) + back
                if end >= 0 and (k == 1 or len(stream.packets) - k > 0):  # the header has no time of its own
                    stream.times[-k] = end / rate
        stream.ended |= bool(kind & 4)
        at = start + size
    return Decoded(found, bad, lost + sum(s.open is not None for s in found.values()), missing)


def _spacing(stream: Stream, rate: int) -> int:
    """Samples of the other streams between two packets of this one, as its header tells."""
    head = stream.packets[0] if stream.packets else b""
    if len(head) != 17 or head[:4] != b"PCM8":
        return 0
    _, packet, streams = struct.unpack_from("<III", head, 4)
    return packet * (streams - 1)


def samples_of(media: Decoded) -> bytes:
    """The signal: the streams' packets, taken in turn; what a damaged file has lost is left out."""
    dealt = [media.streams[s].packets[1:] for s in sorted(media.streams)]
    return b"".join(packet for turn in zip_longest(*dealt, fillvalue=b"") for packet in turn)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 with bytes 255 up to a positive multiple of FRAME, and its length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw)), len(raw)


def _slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's rows of a few megabytes (or one row)."""
    first = size = 0
    for k in range(batch.num_rows):
        n = len(batch.column(column)[k].as_buffer() or b"") if batch.column(column)[k].is_valid else 0
        if k > first and size + n > most:
            yield first, k
            first, size = k, 0
        size += n
    if batch.num_rows:
        yield first, batch.num_rows


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as an Ogg file of 8-bit samples."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch, 1):
                payloads = [payload_of(x.as_py()) for x in batch.column(1).slice(a, b - a)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n_bytes": pa.array([n for _, n in payloads], pa.int64()), "media": pa.array([encode(x) for x, _ in payloads], pa.binary())})

    return common.documents(docs).mapInArrow(make, "doc_id long, n_bytes long, media binary")


def feature_of(media: Decoded, samples: bytes) -> str:
    """Pages, packets and seconds of each logical stream, and the mean and root mean square of the signal about 128."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float64) - 128.0
    mean, rms = (float(x.mean()), float(np.sqrt((x * x).mean()))) if len(x) else (0.0, 0.0)
    told = [f"{s}:{m.pages}p{len(m.packets) - 1}k{max((t for t in m.times if t is not None), default=0.0):.3f}s" for s, m in sorted(media.streams.items())]
    return f"streams={','.join(told)};bad={media.bad_pages};lost={media.lost_packets};mean={mean:.4f};rms={rms:.4f}"


def features(media: DataFrame) -> DataFrame:
    """What the stored files hold: the payload's length and hashes, the file's, and the feature text."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            if not batch.num_rows:
                continue
            for value in batch.column(2):
                data = value.as_py() or b""
                found = decode(data)
                samples = samples_of(found)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(found, samples)))
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": batch.column(1)} | dict(zip(names, zip(*rows))))

    return media.mapInArrow(look, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored(docs: DataFrame) -> DataFrame:
    """Every document's text stored as an Ogg file in a table of the shared folder, read back and described.

    A null or empty text is one frame of 255s; repeated rows give repeated rows with equal values; null doc_ids stay;
    texts of any length are one file each; an empty table gives an empty result.
    """
    return features(common.written(media_table(docs), "ogg-media"))
