"""Media columns: MPEG transport streams.

``mux`` stores a payload as one elementary stream of private data: program tables,
then one packetised unit for every ``UNIT`` bytes, each with its presentation
timestamp; every ``GROUP``-th unit is marked as a random-access point and carries a
clock reference. ``demux`` reads any such stream back: it parses and checks the
program tables, checks the continuity counters, drops repeated packets, reassembles
the elementary packets and lists units with timestamps and random-access points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rupaka.llm.common import id_text, table

PACKET, SYNC = 188, 0x47
BLOCK, UNIT, GROUP = 576, 576 * 16, 8
#: Ticks of the 90 kHz clock between two units.
TICKS = 3600
MAP_PID, DATA_PID, PRIVATE = 0x1000, 0x0100, 0x06


@lru_cache(maxsize=1)
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return tuple(out)


def section_crc(data: bytes) -> int:
    """The checksum of program tables; 0 over a section that holds its own."""
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ t[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    s = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    return s + section_crc(s).to_bytes(4, "big")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    programs = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))
    streams = _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return b"".join((bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + s).ljust(PACKET, b"\xff") for pid, s in ((0, programs), (MAP_PID, streams)))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


_HEADS = [[bytes([SYNC]) + (start << 14 | DATA_PID).to_bytes(2, "big") + bytes([adapt << 4 | cc]) for cc in range(16)] for start in (0, 1) for adapt in (1, 3)]


def mux(payload: bytes) -> bytes:
    """``payload`` as a transport stream."""
    out, cc = [_tables()], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], (k * TICKS) & 0x1FFFFFFFF
        pes = b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        # the first packet of a random-access unit has the flag and a clock reference
        field_ = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big") if k % GROUP == 0 else b""
        i, start = 0, 2
        while i < len(pes):
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            part = pes[i : i + room]
            if len(part) < room and not field_:
                stuff = room - len(part) - 1
                field_ = b"\x00" + b"\xff" * (stuff - 1) if stuff else b""
                out.append(_HEADS[start + 1][cc] + bytes([len(field_)]) + field_ + part)
            elif field_:
                field_ += b"\xff" * (room - len(part))
                out.append(_HEADS[start + 1][cc] + bytes([len(field_)]) + field_ + part)
            else:
                out.append(_HEADS[start][cc] + part)
            i, cc, start, field_ = i + len(part), (cc + 1) & 15, 0, b""
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. units: (pid, timestamp or None, random-access, offset in that stream's payload, bytes)."""

    programs: dict[int, int] = field(default_factory=dict)
    kinds: dict[int, int] = field(default_factory=dict)
    payloads: dict[int, bytes] = field(default_factory=dict)
    units: list[tuple[int, int | None, bool, int, int]] = field(default_factory=list)
    packets: int = 0
    repeated: int = 0
    gaps: int = 0
    damaged: int = 0


def _sections(data: bytearray) -> Iterator[bytes]:
    """Complete sections at the start of ``data``, which loses them."""
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
        if len(data) < size:
            return
        yield bytes(data[:size])
        del data[:size]


def demux(data: bytes) -> Stream:
    """Parses a transport stream; damage is counted, not raised. Bytes after the last whole packet count as damaged."""
    s, last, open_units, tables = Stream(), {}, {}, {}
    parts: dict[int, list[bytes]] = {}
    sizes: dict[int, int] = {}

    def close(pid: int) -> None:
        chunks, random = open_units.pop(pid)
        pes = b"".join(chunks)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            s.damaged += 1
            return
        pts = None
        if pes[7] & 0x80 and len(pes) >= 14:
            a = pes[9:14]
            pts = (a[0] & 0x0E) << 29 | a[1] << 22 | (a[2] & 0xFE) << 14 | a[3] << 7 | a[4] >> 1
        size, body = int.from_bytes(pes[4:6], "big"), pes[9 + pes[8] :]
        if size:
            if len(pes) < 6 + size:
                s.damaged += 1
            body = pes[9 + pes[8] : 6 + size]
        s.units.append((pid, pts, random, sizes.get(pid, 0), len(body)))
        parts.setdefault(pid, []).append(body)
        sizes[pid] = sizes.get(pid, 0) + len(body)

    whole = len(data) // PACKET * PACKET
    s.damaged += len(data) != whole
    for at in range(0, whole, PACKET):
        s.packets += 1
        if data[at] != SYNC or data[at + 1] & 0x80:
            s.damaged += 1
            continue
        pid, control, cc = (data[at + 1] & 0x1F) << 8 | data[at + 2], data[at + 3] >> 4 & 3, data[at + 3] & 15
        if not control & 1 or pid == 0x1FFF:
            continue
        i, random, jump = at + 4, False, False
        if control & 2:
            if n := data[i]:
                random, jump = bool(data[i + 1] & 0x40), bool(data[i + 1] & 0x80)
            i += 1 + n
        if (before := last.get(pid)) is not None and not jump:
            if cc == before[0] and data[i : at + PACKET] == before[1]:
                s.repeated += 1
                continue
            s.gaps += cc != (before[0] + 1) & 15  # with the counter of the packet before, sixteen or more are lost
        last[pid] = cc, data[i : at + PACKET]
        start, body = data[at + 1] & 0x40, data[i : at + PACKET]
        if pid == 0 or pid in s.programs.values():
            if start:
                tables[pid] = bytearray(body[1 + body[0] :] if body else b"")
            elif pid in tables:
                tables[pid] += body
            for x in _sections(tables.get(pid, bytearray())):
                if section_crc(x):
                    s.damaged += 1
                elif x[0] == 0:
                    s.programs |= {p: int.from_bytes(x[j + 2 : j + 4], "big") & 0x1FFF for j in range(8, len(x) - 4, 4) if (p := int.from_bytes(x[j : j + 2], "big"))}
                elif x[0] == 2:
                    j = 12 + (int.from_bytes(x[10:12], "big") & 0xFFF)
                    while j + 5 <= len(x) - 4:
                        s.kinds[int.from_bytes(x[j + 1 : j + 3], "big") & 0x1FFF] = x[j]
                        j += 5 + (int.from_bytes(x[j + 3 : j + 5], "big") & 0xFFF)
        elif pid in s.kinds:
            if start:
                if pid in open_units:
                    close(pid)
                open_units[pid] = ([body], random)
            elif pid in open_units:
                open_units[pid][0].append(body)
    for pid in list(open_units):
        close(pid)
    s.payloads = {pid: b"".join(x) for pid, x in parts.items()}
    return s


def padded(text: str | None) -> bytes:
    """UTF-8 bytes, filled with 255 to a positive multiple of BLOCK."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\xff")


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (size, values) as batches of about ``most`` bytes."""
    group, size = [], 0
    for n, values in rows:
        group.append(values)
        size += n
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*group), schema.types)], schema=schema)
            group, size = [], 0
    if group:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*group), schema.types)], schema=schema)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stored stream ``media`` of every row's text. Null and empty texts give one block of filling."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    t = t.as_py()
                    m = mux(padded(t))
                    yield len(m), (i, len((t or "").encode()), m)

        yield from _in_batches(rows(), schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """The payload and the structure of each stored stream in ``media`` (doc_id, n_bytes, media).

    Adds payload binary, program int, pid int, stream_type int, packets, repeated,
    gaps, damaged long, timestamps and random_access (a timestamp and a flag for
    each unit). Null media and streams without units have a null payload and no units. If a stream
    holds several elementary streams, the one with the lowest pid is given.
    """
    extra = [("payload", pa.binary()), ("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), *((n, pa.int64()) for n in ("packets", "repeated", "gaps", "damaged")), ("timestamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.bool_()))]
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, n, m in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media")):
                    m = m.as_py()
                    s = demux(m or b"")
                    pid = min(s.payloads, default=None)
                    units = [u for u in s.units if u[0] == pid]
                    yield 2 * len(m or b""), (i, n, m, s.payloads.get(pid), min(s.programs, default=None), pid, s.kinds.get(pid), s.packets, s.repeated, s.gaps, s.damaged, [u[1] for u in units], [u[2] for u in units])

        yield from _in_batches(rows(), schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, program int, pid int, stream_type int, packets long, repeated long, gaps long, damaged long, timestamps array<long>, random_access array<boolean>")


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of what from_media() gives."""
    points = F.size(F.filter("random_access", lambda x: x))
    feature = F.format_string(
        "program=%d;pid=%d;type=%d;packets=%d;repeated=%d;gaps=%d;damaged=%d;units=%d;points=%d;first=%d;last=%d;crc=%d",
        "program", "pid", "stream_type", "packets", "repeated", "gaps", "damaged", F.size("timestamps"), points, F.array_min("timestamps"), F.array_max("timestamps"), F.crc32("payload"),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(from_media(to_media(table(spark, sf_dir, "documents"))))


QUERIES = {"op7_transport_streams": op7_transport_streams}
ORACLES: dict[str, str] = {}
