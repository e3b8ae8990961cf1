"""MPEG transport streams as a media column: mux, parse and digest.

Layout by the public standard (ISO/IEC 13818-1): 188-byte packets, a program association table on
PID 0, one program map table, and one private-data elementary stream cut into packetised elementary
packets with presentation timestamps; every such packet starts at a random-access point.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm._frames import documents, small_batches, to_batch

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID = 0x1000, 0x0100
#: Private data in PES packets; stream id private_stream_1.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Payload bytes of one PES packet (its 16-bit length also counts 8 header bytes), and 90 kHz ticks between two.
PES_PAYLOAD, PES_TICKS = 60_000, 3600
BLOCK = 64

_CRC: list[int] = []


def mpeg_crc32(data: bytes) -> int:
    """The CRC of program tables: polynomial 0x04C11DB7, not reflected, all ones at first."""
    if not _CRC:
        for i in range(256):
            c = i << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
            _CRC.append(c)
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ b]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + mpeg_crc32(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + section).ljust(PACKET, b"\xff")


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E]) + (pts >> 14 & 0xFFFE | 1).to_bytes(2, "big") + (pts << 1 & 0xFFFE | 1).to_bytes(2, "big")


TABLES = _table_packet(0, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload`` losslessly."""
    out, counter = [TABLES], 0
    pid = DATA_PID.to_bytes(2, "big")
    heads = [bytes([SYNC]) + pid + bytes([0x10 | c]) for c in range(16)]
    for number, at in enumerate(range(0, len(payload), PES_PAYLOAD)):
        data = payload[at : at + PES_PAYLOAD]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(number * PES_TICKS & 0x1FFFFFFFF) + data
        # The first packet carries the random-access flag in an adaptation field; a short rest is stuffed there too.
        first = pes[:182]
        start = bytes([SYNC]) + (0x4000 | DATA_PID).to_bytes(2, "big") + bytes([0x30 | counter])
        out.append(start + bytes([183 - len(first), 0x40]) + b"\xff" * (182 - len(first)) + first)
        counter = counter + 1 & 15
        full = 182 + (len(pes) - 182) // 184 * 184 if len(pes) > 182 else len(pes)
        for i in range(182, full, 184):
            out.append(heads[counter] + pes[i : i + 184])
            counter = counter + 1 & 15
        if full < len(pes):
            rest = pes[full:]
            room = 183 - len(rest)
            out.append(bytes([SYNC]) + pid + bytes([0x30 | counter, room]) + (b"\x00" + b"\xff" * (room - 1) if room else b"") + rest)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Program:
    """What a transport stream says: tables, elementary packets, timestamps and faults."""

    pmt_pids: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    payload: dict[int, list[bytes]] = field(default_factory=dict)
    #: PID -> [(pts or -1, packet index of its start, random access?)]
    access: dict[int, list[tuple[int, int, bool]]] = field(default_factory=dict)
    packets: int = 0
    lost: int = 0
    damaged: int = 0


def _tables(stream: Program, pid: int, data: bytes) -> None:
    section = data[1 + data[0] :] if data else b""
    length = 3 + (int.from_bytes(section[1:3], "big") & 0xFFF)
    if len(section) < length or length < 12 or mpeg_crc32(section[:length]):
        stream.damaged += 1
    elif pid == 0 and section[0] == 0:
        for i in range(8, length - 4, 4):
            number = int.from_bytes(section[i : i + 2], "big")
            if number:
                stream.pmt_pids[int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF] = number
    elif section[0] == 2:
        at = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
        while at + 5 <= length - 4:
            stream.streams[int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF] = section[at]
            at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0xFFF)


def _elementary(stream: Program, pid: int, pes: bytes, packet: int, random: bool) -> None:
    if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
        stream.damaged += 1
        return
    length, header = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
    data = pes[header : 6 + length] if length else pes[header:]
    if length and len(pes) < 6 + length:
        stream.damaged += 1
    pts = -1
    if pes[7] & 0x80 and len(pes) >= 14:
        pts = (pes[9] >> 1 & 7) << 30 | (int.from_bytes(pes[10:12], "big") >> 1) << 15 | int.from_bytes(pes[12:14], "big") >> 1
    stream.payload.setdefault(pid, []).append(data)
    stream.access.setdefault(pid, []).append((pts, packet, random))


def demux(data: bytes) -> Program:
    """Parse a transport stream; damage is counted, never raised.

    Packets without the sync byte and broken tables or elementary packets count as damaged, a jump
    of a continuity counter as lost; a repeated packet is skipped.
    """
    stream = Program()
    counters: dict[int, int] = {}
    open_pes: dict[int, tuple[list[bytes], int, bool]] = {}
    stream.damaged += len(data) % PACKET > 0
    for index in range(len(data) // PACKET):
        at = index * PACKET
        b1, b3 = data[at + 1], data[at + 3]
        stream.packets += 1
        if data[at] != SYNC or b1 & 0x80:
            stream.damaged += 1
            continue
        pid = (b1 & 0x1F) << 8 | data[at + 2]
        if not b3 & 0x10 or pid == 0x1FFF:
            continue
        last = counters.get(pid)
        if last is not None and b3 & 15 != last + 1 & 15:
            if b3 & 15 == last:
                continue
            stream.lost += 1
        counters[pid] = b3 & 15
        begin, random = at + 4, False
        if b3 & 0x20:
            size = data[begin]
            random = size > 0 and bool(data[begin + 1] & 0x40)
            begin += 1 + size
        part = data[begin : at + PACKET]
        if pid == 0 or pid in stream.pmt_pids:
            if b1 & 0x40:
                _tables(stream, pid, part)
        elif pid in stream.streams:
            if b1 & 0x40:
                if pid in open_pes:
                    parts, start, flag = open_pes[pid]
                    _elementary(stream, pid, b"".join(parts), start, flag)
                open_pes[pid] = ([part], index, random)
            elif pid in open_pes:
                open_pes[pid][0].append(part)
    for pid, (parts, start, flag) in open_pes.items():
        _elementary(stream, pid, b"".join(parts), start, flag)
    return stream


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of 64 bytes."""
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\x00")


def feature(stream: Program) -> str:
    """Counts of packets, elementary packets and faults, the first and last timestamps and all random-access packet numbers' checksum."""
    access = stream.access.get(DATA_PID, [])
    points = [packet for _, packet, random in access if random]
    check = zlib.crc32(",".join(map(str, points)).encode())
    return f"packets={stream.packets};pes={len(access)};streams={len(stream.streams)};lost={stream.lost};damaged={stream.damaged};pts={access[0][0] if access else -1}-{access[-1][0] if access else -1};access={len(points)}:{check}"


def with_media(df: DataFrame, data: str, out: str = "media") -> DataFrame:
    """Add a binary column with a transport stream of ``data`` (binary or string; null stays null)."""
    return df.withColumn(out, F.pandas_udf(lambda s: s.map(lambda x: None if x is None else mux(x if isinstance(x, bytes) else x.encode())), "binary")(F.col(data)))


PARSED_DDL = "struct<payload: binary, streams: map<int,int>, packets: int, lost: int, damaged: int, access: array<struct<pts: long, packet: int, random: boolean>>>"


def with_parsed(df: DataFrame, media: str, out: str = "parsed") -> DataFrame:
    """Add what the transport stream in ``media`` holds: payload of all streams in order of PID, tables, faults and access points.

    A null stream holds nothing; damage is counted, never raised; an existing ``out`` is replaced.
    """
    import pandas as pd

    @F.pandas_udf(PARSED_DDL)
    def parse(values):  # a series of streams to a frame of what they hold
        rows = [demux(v or b"") for v in values]
        return pd.DataFrame(
            {
                "payload": [b"".join(b"".join(s.payload[p]) for p in sorted(s.payload)) for s in rows],
                "streams": [s.streams for s in rows],
                "packets": [s.packets for s in rows],
                "lost": [s.lost for s in rows],
                "damaged": [s.damaged for s in rows],
                "access": [[{"pts": a, "packet": b, "random": c} for p in sorted(s.access) for a, b, c in s.access[p]] for s in rows],
            }
        )

    return df.withColumn(out, parse(F.col(media)))


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as a transport stream, read it back and digest both.

    Null and empty texts are one block of zeros.  Rows are independent: repeated rows give equal
    rows, an empty table gives none, other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            out: dict[str, list] = {f.name: [] for f in DIGEST}
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (value or "").encode()
                media = mux(pad(raw))
                stream = demux(media)
                back = b"".join(stream.payload.get(DATA_PID, []))
                row = (doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream))
                for name, x in zip(out, row, strict=True):
                    out[name].append(x)
            yield to_batch(out, DIGEST)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(documents(spark, sf_dir))
