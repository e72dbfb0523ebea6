"""Operator 9: media columns as Ogg streams.

A payload of 8-bit samples is cut into packets that go to `streams` logical streams in turn, each
with its own serial number.  Reading verifies every page's checksum, reassembles packets from lacing
values (also across pages), demultiplexes the streams and derives times from granule positions, which
count samples.

Written form: each stream opens with a page that holds one header packet, `audio8` and the sample
rate; packets are put on pages of at most 255 lacing values; a packet that doesn't fit goes on with
the next page, marked as continued; the granule position of a page is the number of samples up to the
end of the last packet that ends on it, or -1 if none does; the last page of a stream has the end flag.

Defined results: null text is empty, and an empty payload is 64 zero bytes; equal texts give equal
files; a damaged file is read up to its damage and counted in `bad_pages`; rows are independent; an
empty table gives an empty table; extra columns pass through, the media column replaces one of the
same name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from cutplan.llm import kernels as K
from cutplan.llm.shared import with_column

PACKET, RATE, STREAMS = 1000, 8000, 2
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 0x04C11DB7, most significant bit first, no inversion.  That is zlib's CRC
    of the bytes with their bits reversed, without its inversions, reversed again."""
    mirrored = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    blank = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:]


def write_stream(serial: int, packets: list[tuple[int, bytes]]) -> list[bytes]:
    """Pages of one logical stream; packets are (granule position at its end, data)."""
    pages = [page(FIRST | (0 if packets else LAST), 0, serial, 0, bytes([11]), b"audio8\0" + struct.pack("<I", RATE))]
    lacing, body, granule, continued = bytearray(), bytearray(), -1, False

    def flush(last: bool, open_packet: bool) -> None:
        nonlocal lacing, body, granule, continued
        flags = (CONTINUED if continued else 0) | (LAST if last else 0)
        pages.append(page(flags, granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing, body, granule, continued = bytearray(), bytearray(), -1, open_packet

    for k, (end, data) in enumerate(packets):
        values, at = [255] * (len(data) // 255) + [len(data) % 255], 0
        for j, v in enumerate(values):
            lacing.append(v)
            body += data[at : at + v]
            at += v
            if j == len(values) - 1:
                granule = end
            if len(lacing) == 255:
                flush(k == len(packets) - 1 and j == len(values) - 1, j < len(values) - 1)
    if lacing:
        flush(True, False)
    return pages


def write(payload: bytes, streams: int = STREAMS, packet: int = PACKET) -> bytes:
    """One file; packet i of the payload goes to stream i mod `streams`, and pages of the streams alternate."""
    dealt: list[list[tuple[int, bytes]]] = [[] for _ in range(streams)]
    for i, at in enumerate(range(0, len(payload), packet)):
        data = payload[at : at + packet]
        dealt[i % streams].append((at + len(data), data))
    pages = [write_stream(n + 1, packets) for n, packets in enumerate(dealt)]
    most = max(map(len, pages))
    return b"".join(p[i] for i in range(most) for p in pages if i < len(p))


@dataclass
class Stream:
    """A logical stream as it is read: (granule position or None, data) of finished packets."""

    packets: list[tuple[int | None, bytes]] = field(default_factory=list)
    partial: bytes | None = None
    rate: int = 0
    number: int = 0
    pages: int = 0
    last_granule: int = 0
    ended: bool = False


def read(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of pages that fail their checksum, are cut off or
    are missing by their sequence numbers; a packet that goes on from a missing page is left out."""
    streams: dict[int, Stream] = {}
    bad = missing = at = 0
    while (at := data.find(b"OggS", at)) >= 0:
        if len(data) < at + HEAD.size:
            bad += 1
            break
        _, _, flags, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        lacing = data[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(lacing)
        whole = data[at:end]
        if end > len(data) or checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            bad, at = bad + 1, at + 4
            continue
        stream = streams.setdefault(serial, Stream())
        if number != stream.number:
            missing, stream.partial = missing + max(1, number - stream.number), None
        stream.number = number + 1
        if not flags & CONTINUED:
            stream.partial = None
        first = len(stream.packets)
        pieces, place = ([stream.partial] if stream.partial is not None else []), HEAD.size + n
        skip = bool(flags & CONTINUED) and stream.partial is None
        for v in lacing:
            pieces.append(whole[place : place + v])
            place += v
            if v < 255:
                if not skip:
                    stream.packets.append((None, b"".join(pieces)))
                pieces, skip = [], False
        stream.partial = b"".join(pieces) if pieces and not skip else None
        if len(stream.packets) > first:
            stream.packets[-1] = (granule, stream.packets[-1][1])
        if flags & FIRST and stream.packets:
            stream.rate = struct.unpack_from("<I", stream.packets.pop(0)[1], 7)[0]
        stream.pages += 1
        stream.last_granule = max(stream.last_granule, granule)
        stream.ended |= bool(flags & LAST)
        at = end
    # a page that fails its checksum is missing from its stream as well and counts once
    return streams, max(bad, missing)


def payload_of(streams: dict[int, Stream]) -> bytes:
    """The payload: packets of all streams in turn, in order of their serial numbers."""
    order = [streams[s].packets for s in sorted(streams)]
    return b"".join(p[i][1] for i in range(max(map(len, order), default=0)) for p in order if i < len(p))


def seconds(stream: Stream, total_streams: int, packet: int = PACKET) -> list[float]:
    """End time of each packet: from its page's granule position, or counted back from the next one."""
    ends: list[int] = [0] * len(stream.packets)
    known = 0
    for i in range(len(stream.packets) - 1, -1, -1):
        granule, data = stream.packets[i]
        if granule is not None and granule >= 0:
            known = granule
        ends[i] = known
        known -= len(data) + packet * (total_streams - 1)
    return [e / stream.rate if stream.rate else 0.0 for e in ends]


def features(data: bytes) -> tuple[bytes, str]:
    """Payload and feature string of a file: streams, pages, packets, bad pages, duration, mean and peak."""
    streams, bad = read(data)
    payload = payload_of(streams)
    times = [t for s in streams.values() for t in seconds(s, len(streams))]
    loud = sum(payload) / len(payload) if payload else 0.0
    counts = [len(streams), sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values()), bad]
    names = ["streams", "pages", "packets", "bad_pages"]
    parts = [f"{k}={v}" for k, v in zip(names, counts, strict=True)]
    parts += [f"ended={sum(s.ended for s in streams.values())}", f"seconds={max(times, default=0.0):.6f}", f"mean={loud:.4f}", f"peak={max(payload, default=0)}"]
    return payload, ";".join(parts)


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def encode(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """All columns of `docs` plus `out`, the Ogg file of the text's padded UTF-8 bytes."""
    names = [c for c in docs.columns if c != out]
    at = names.index(text)
    schema = with_column(docs.select(*names), out, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.as_bytes(batch.column(at))
            for lo, hi in K.blocks(texts, 8 * K.BLOCK):
                part = batch.slice(lo, hi - lo)
                media = pa.array([write(padded(t)) for t in texts[lo:hi]], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, media], names=[*names, out])

    return docs.select(*names).mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """From (doc_id, n_bytes, media): what is read back from each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in DIGEST.split(", ")]
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                payload, feature = features(data)
                sha = hashlib.sha256
                rows.append((len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), sha(data).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names
            )

    return media.mapInArrow(run, DIGEST)


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the query; everything but doc_id and n_bytes is read back from the files."""
    media = encode(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", "CAST(octet_length(coalesce(text, '')) AS BIGINT) AS n_bytes"))
    return describe(media.select("doc_id", "n_bytes", "media"))
