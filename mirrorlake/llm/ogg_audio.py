"""Ogg containers in a binary column: writing, verified reading and features.

Reading walks the pages of a physical stream: the capture pattern, the page checksum (CRC-32, polynomial
0x04c11db7, unreflected, over the page with its checksum field zero), then the lacing values, from which
packets are put together, over page borders where a page ends in a value of 255.  Pages are dealt to
their logical streams by serial number, each stream's page sequence is checked, and the time of a
packet's end is derived from the granule position of the page where it ends.

The payload of the query is stored as unsigned 8-bit samples of one logical stream (PCM, one granule a
sample); a second logical stream carries an index (the byte where each packet ends), its pages between
those of the first.  The layout of the first packet of each stream is this module's own: "PCM8" with
version, channels and rate; "INDX" with version.

``store`` writes a media column, ``streams`` reads one, a row for each logical stream; a file that is damaged, or
null, is one row with the reason as its status, and the others aren't touched by it.

Null and empty texts give the least payload (64 zero bytes); texts of any length are stored whole.  Repeated rows are
stored each, equal texts give equal bytes; a null doc_id stays null; an empty table gives no rows; extra columns
are ignored, whatever their names.
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

from .common import batches

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_pages long, n_packets long, seconds double"
)
RATE, PACKET, BLOCK = 8000, 4096, 64
#: Fixed values of the format: flags of a page, the header up to the lacing values.
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The unreflected CRC, got from the reflected one by mirroring the bits of every byte and of the result."""
    reflected = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Writer:
    """Pages of one logical stream: packets go in with the granule position of their end."""

    serial: int
    sequence: int = 0
    lacing: list[int] = field(default_factory=list)
    data: list[bytes] = field(default_factory=list)
    granule: int = -1
    continued: bool = False

    def put(self, packet: bytes, granule: int) -> Iterator[bytes]:
        """Add a packet; gives pages as they fill."""
        at, left = 0, len(packet)
        while True:
            if len(self.lacing) == 255:
                yield self.page()
                self.continued = at > 0
            value = min(left, 255)
            self.lacing.append(value)
            self.data.append(packet[at : at + value])
            at += value
            left -= value
            if value < 255:
                break
        self.granule = granule

    def page(self, last: bool = False) -> bytes:
        flags = CONTINUED * self.continued | FIRST * (self.sequence == 0) | LAST * last
        page = HEAD.pack(b"OggS", 0, flags, self.granule, self.serial, self.sequence, 0, len(self.lacing)) + bytes(self.lacing) + b"".join(self.data)
        page = page[:22] + struct.pack("<I", page_crc(page)) + page[26:]
        self.sequence += 1
        self.lacing, self.data, self.granule, self.continued = [], [], -1, False
        return page


def write(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """A physical stream of two logical streams: the samples and their index."""
    serial = zlib.crc32(payload)
    sound, index = Writer(serial), Writer(serial ^ 0xFFFFFFFF)
    out = [*sound.put(struct.pack("<4sBBI", b"PCM8", 1, 1, rate), 0), sound.page(), *index.put(struct.pack("<4sB", b"INDX", 1), 0), index.page()]
    for at in range(0, len(payload), packet):
        part = payload[at : at + packet]
        out += sound.put(part, at + len(part))
        out += index.put(struct.pack("<Q", at + len(part)), at + len(part))
    out += [sound.page(last=True), index.page(last=True)]
    return b"".join(out)


@dataclass
class Stream:
    """One logical stream as read: packets, the time of each one's end where known, and page counts."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    rest: list[bytes] = field(default_factory=list)


def read(media: bytes) -> dict[int, Stream]:
    """Demultiplex a physical stream; verifies every page."""
    at, streams = 0, {}
    while at < len(media):
        if len(media) - at < HEAD.size or media[at : at + 4] != b"OggS":
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, n = HEAD.unpack_from(media, at)
        lacing = media[at + HEAD.size : at + HEAD.size + n]
        size = HEAD.size + n + sum(lacing)
        page = media[at : at + size]
        if version or len(lacing) < n or len(page) < size:
            raise ValueError(f"the page at byte {at} is cut short or of another version")
        if page_crc(page[:22] + bytes(4) + page[26:]) != crc:
            raise ValueError(f"the page at byte {at} has a wrong checksum")
        if (serial not in streams) != bool(flags & FIRST):
            raise ValueError(f"the page at byte {at} begins no new stream, or begins one again")
        stream = streams.setdefault(serial, Stream(serial))
        if sequence != stream.pages or stream.ended:
            raise ValueError(f"the page at byte {at} is out of order")
        if bool(flags & CONTINUED) != bool(stream.rest):
            raise ValueError(f"the page at byte {at} continues a packet that isn't open, or leaves one open")
        body, first_end = HEAD.size + n, len(stream.packets)
        for value in lacing:
            stream.rest.append(page[body : body + value])
            body += value
            if value < 255:
                stream.packets.append(b"".join(stream.rest))
                stream.granules.append(None)
                stream.rest = []
        if len(stream.packets) > first_end:
            stream.granules[-1] = granule  # the position belongs to the last packet that ends on the page
        stream.pages += 1
        stream.ended = bool(flags & LAST)
        at += size
    for stream in streams.values():
        if not stream.ended or stream.rest:
            raise ValueError(f"the stream {stream.serial} isn't complete")
    return streams


def payload_of(streams: dict[int, Stream]) -> tuple[bytes, Stream, int, list[float]]:
    """Samples, their stream, the rate, and the end of each sound packet in seconds.

    Only the last packet that ends on a page has a granule position; those before it lie back by the
    samples of the packets after them.
    """
    sound, index = (next((s for s in streams.values() if s.packets and s.packets[0][:4] == kind), None) for kind in (b"PCM8", b"INDX"))
    if sound is None or index is None:
        raise ValueError("there is no stream of samples, or no index")
    rate = struct.unpack_from("<I", sound.packets[0], 6)[0]
    packets, known = sound.packets[1:], sound.granules[1:]
    ends, follow = [0] * len(packets), None
    for i in range(len(packets) - 1, -1, -1):
        ends[i] = known[i] if known[i] is not None else follow
        follow = ends[i] - len(packets[i])
    if ends != [struct.unpack("<Q", p)[0] for p in index.packets[1:]]:
        raise ValueError("the granule positions and the index disagree")
    return b"".join(packets), sound, rate, [e / rate for e in ends]


def padded(data: bytes, block: int = BLOCK) -> bytes:
    return data + bytes(-len(data) % block if data else block)


def feature(payload: bytes, seconds: float) -> str:
    """Level and movement of the samples: mean, deviation, crossings of the middle, loudest of 8 spans."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    energy = np.add.reduceat(x.astype(np.int64) ** 2, np.arange(8) * len(x) // 8)
    return f"{x.mean():.4f};{x.std():.4f};{crossings};{int(energy.argmax())};{seconds:.6f}"


def store(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Per document: its payload written as Ogg, read back from those bytes, and features of what was read."""
    batches(docs.sparkSession)
    columns = SCHEMA + (", media binary" if with_media else "")
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                media = write(padded(data))
                streams = read(media)
                back, sound, _, ends = payload_of(streams)
                sha = hashlib.sha256
                row = [doc, len(data), len(back), sha(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), sha(media).hexdigest(), feature(back, ends[-1]), sum(s.pages for s in streams.values()), len(sound.packets) - 1, ends[-1]]
                rows.append([*row, media] if with_media else row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    stored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, columns)
    return stored.select(*names)


STREAMS = "doc_id long, status string, serial long, n_pages long, n_packets long, granule long, kind binary, packet_bytes array<long>, data binary"


def streams(media: DataFrame, column: str = "media") -> DataFrame:
    """The logical streams of Ogg files in a column beside doc_id: status "ok", pages, packets, the last granule
    position, the first four bytes, and the packets (their sizes and their bytes end to end).  Files that can't be
    read are one row with the reason as status and nulls."""
    batches(media.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("status", pa.string()), *((n, pa.int64()) for n in ("serial", "n_pages", "n_packets", "granule")), ("kind", pa.binary()), ("packet_bytes", pa.list_(pa.int64())), ("data", pa.binary())])

    def rows_of(doc: int | None, raw: bytes | None) -> Iterator[list]:
        if raw is None:
            yield [doc, "no media", *[None] * 7]
            return
        try:
            found = read(raw)
        except (ValueError, struct.error) as error:
            yield [doc, str(error), *[None] * 7]
            return
        for s in found.values():
            granule = next((g for g in reversed(s.granules) if g is not None), None)
            yield [doc, "ok", s.serial, s.pages, len(s.packets), granule, (s.packets or [b""])[0][:4], list(map(len, s.packets)), b"".join(s.packets)]

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(rows_of(doc, raw.as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return media.select(F.col("doc_id").cast("long"), F.col(column).cast("binary")).mapInArrow(work, STREAMS)
