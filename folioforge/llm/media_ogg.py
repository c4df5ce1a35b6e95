"""Ogg containers in binary columns.

`mux` stores a byte payload as unsigned 8-bit mono samples in an Ogg file with
two logical streams: samples (packets of PACKET bytes, granule position = number
of samples up to the page's last finished packet) and an index that carries the
payload's length before padding. `demux` verifies every page's checksum,
reassembles packets from lacing values (over page borders), separates the logical
streams by serial number and derives timestamps from granule positions.

Defined cases: a null text is the empty text; the empty text is one block of
64 zero bytes; equal texts give equal files. A page with a wrong checksum is
counted in `bad_pages` and skipped, the reader looks for the next capture
pattern, and a packet with a missing part is dropped; `lost_packets` counts these and gaps in page numbers.
A null media value is an empty file. A file without a sample stream has an
empty payload. Repeated rows each give a row, null ids are kept, an empty table gives an empty result, extra columns are left out.

Each row is independent of the others: no shuffle, memory bounded by one batch
of rows, and a lost task is simply run again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, lean, text_of

RATE = 8000
PACKET = 1024
SEGMENTS = 255
BLOCK = 64
SAMPLES_SERIAL, INDEX_SERIAL = 0x53414D50, 0x494E4458
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")

#: Bits of a byte in reverse order: Ogg's CRC-32 takes bits from the top, zlib's from the bottom.
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, bits from the top, start and final xor 0."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def pad(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of BLOCK."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes((size % 255,))


def _page(flags: int, granule: int, serial: int, number: int, laces: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(laces)) + laces
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _stream_pages(serial: int, first: bytes, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream; packets: (bytes, granule position at its end)."""
    yield _page(FIRST, 0, serial, 0, lacing(len(first)), first)
    laces = bytearray()
    ends: list[tuple[int, int]] = []  # (number of lacing values up to the packet's end, granule)
    for data, granule in packets:
        laces += lacing(len(data))
        ends.append((len(laces), granule))
    body = b"".join(data for data, _ in packets)
    at = read = done = 0
    number, inside = 1, False
    while at < len(laces):
        part = bytes(laces[at : at + SEGMENTS])
        at += len(part)
        granule = -1
        while done < len(ends) and ends[done][0] <= at:
            granule = ends[done][1]
            done += 1
        size = sum(part)
        yield _page(CONTINUED * inside | LAST * (at == len(laces)), granule, serial, number, part, body[read : read + size])
        read += size
        number, inside = number + 1, part[-1] == 255


def mux(payload: bytes, n_bytes: int, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg file of the payload's bytes as 8-bit samples, and of its length before padding."""
    data = [(payload[i : i + packet], min(i + packet, len(payload))) for i in range(0, len(payload), packet)]
    samples = list(_stream_pages(SAMPLES_SERIAL, struct.pack("<4sIBB", b"pcm8", rate, 1, 8), data))
    index = list(_stream_pages(INDEX_SERIAL, struct.pack("<4sI", b"indx", rate), [(struct.pack("<QQ", n_bytes, len(payload)), len(payload))]))
    return b"".join([samples[0], index[0], index[1], *samples[1:]])


def demux(media: bytes) -> dict:
    """Logical streams by serial: packets as (bytes, granule position or -1); and counts of pages."""
    streams: dict[int, dict] = {}
    at = pages = bad = lost = 0
    while (at := media.find(b"OggS", at)) >= 0:
        if at + HEAD.size > len(media):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        laces = media[at + HEAD.size : at + HEAD.size + n]
        start = at + HEAD.size + n
        end = start + sum(laces)
        page = media[at:end]
        if version or len(laces) < n or end > len(media) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad, at = bad + 1, at + 4
            continue
        pages, at = pages + 1, end
        s = streams.setdefault(serial, {"packets": [], "next": number, "open": None, "granule": 0, "ended": False})
        if number != s["next"]:
            lost += 1  # pages are missing, and with them a packet at least
            s["open"] = None
        s["next"], skip = number + 1, False
        if flags & CONTINUED:
            skip = s["open"] is None  # its start is missing
            lost += skip
        elif s["open"] is not None:
            s["open"], lost = None, lost + 1
        parts = s["open"] if s["open"] is not None else []
        s["open"] = None
        finished = 0
        for lace in laces:
            parts.append(media[start : start + lace])
            start += lace
            if lace < 255:
                if not skip:
                    s["packets"].append((b"".join(parts), -1))
                    finished += 1
                parts, skip = [], False
        if laces and laces[-1] == 255 and not skip:
            s["open"] = parts
        if finished and granule >= 0:
            s["packets"][-1] = (s["packets"][-1][0], granule)
        if granule >= 0:
            s["granule"] = max(s["granule"], granule)
        s["ended"] |= bool(flags & LAST)
    lost += sum(s["open"] is not None for s in streams.values())
    return {"streams": streams, "pages": pages, "bad_pages": bad, "lost_packets": lost}


def timestamps(packets: list[tuple[bytes, int]], rate: int) -> list[float]:
    """Seconds at the end of each packet; inside a page, counted back from the page's granule position by packet sizes."""
    times = [0.0] * len(packets)
    end = None
    for i in range(len(packets) - 1, -1, -1):
        if packets[i][1] >= 0:
            end = packets[i][1]
        times[i] = (end or 0) / rate
        end = None if end is None else end - len(packets[i][0])
    return times


def _read(media: bytes | None) -> tuple:
    got = demux(media or b"")
    payload, n_bytes, rate, stamps = b"", None, RATE, []
    for serial in got["streams"]:
        packets = got["streams"][serial]["packets"]
        if packets and packets[0][0][:4] == b"pcm8":
            rate = struct.unpack_from("<I", packets[0][0], 4)[0]
            payload = b"".join(p for p, _ in packets[1:])
            stamps = timestamps(packets[1:], rate)
        elif len(packets) > 1 and packets[0][0][:4] == b"indx":
            n_bytes = struct.unpack_from("<Q", packets[1][0])[0]
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128.0
    n = max(len(x), 1)
    return {
        "payload": payload, "n_bytes": len(payload) if n_bytes is None else n_bytes, "streams": len(got["streams"]), "pages": got["pages"],
        "packets": sum(len(s["packets"]) for s in got["streams"].values()), "bad_pages": got["bad_pages"], "lost_packets": got["lost_packets"],
        "duration_s": max((s["granule"] for s in got["streams"].values()), default=0) / rate, "packet_times": stamps,
        "mean": round(float(x.sum()) / n, 6), "rms": round(float(np.sqrt((x * x).sum() / n)), 6),
        "crossings": int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1]))),
    }


_READ_TYPE = pa.struct([("payload", pa.binary()), ("n_bytes", pa.int64()), ("streams", pa.int32()), ("pages", pa.int32()), ("packets", pa.int32()), ("bad_pages", pa.int32()), ("lost_packets", pa.int32()), ("duration_s", pa.float64()), ("packet_times", pa.list_(pa.float64())), ("mean", pa.float64()), ("rms", pa.float64()), ("crossings", pa.int64())])
_READ_SQL = "struct<payload:binary,n_bytes:bigint,streams:int,pages:int,packets:int,bad_pages:int,lost_packets:int,duration_s:double,packet_times:array<double>,mean:double,rms:double,crossings:bigint>"


def _encode(texts: pa.Array) -> pa.Array:
    lean()
    out = []
    for t in texts:
        data = (t.as_py() or "").encode()
        out.append(mux(pad(data), len(data)))
    return pa.array(out, pa.binary())


def _decode(media: pa.Array) -> pa.Array:
    lean()
    return pa.array([_read(m.as_py()) for m in media], _READ_TYPE)


def encode_column(text):
    """Column of Ogg files of a text column's UTF-8 bytes."""
    return F.arrow_udf(_encode, "binary")(text)


def decode_column(media):
    """Column of structs read from Ogg files: payload, counts, timestamps and sample statistics."""
    return F.arrow_udf(_decode, _READ_SQL)(media)


def ogg_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, media (the file) and got (what was read back from it); other columns are left out."""
    bounded_batches(docs.sparkSession)
    stored = docs.select(docs[id_col].alias("doc_id"), encode_column(text_of(docs, text_col)).alias("media"))
    return stored.select("doc_id", "media", decode_column(F.col("media")).alias("got"))
