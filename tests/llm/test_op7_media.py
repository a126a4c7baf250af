import hashlib
import os
import zlib

from rupaka.llm import op7_media as op7


def test_round_trip_of_all_lengths():
    for n in [0, 1, 575, 576, 577, 9215, 9216, 9217, 100000, *range(2000, 2200, 3), *range(1, 9500, 97)]:
        p = os.urandom(n)
        m = op7.mux(p)
        s = op7.demux(m)
        assert len(m) % 188 == 0 and s.payloads.get(op7.DATA_PID, b"") == p and (s.gaps, s.repeated, s.damaged) == (0, 0, 0)
        assert s.programs == {1: op7.MAP_PID} and s.kinds == {op7.DATA_PID: op7.PRIVATE}


def test_units_and_damage():
    m = op7.mux(b"b" * 100000)
    s = op7.demux(m)
    assert [u[1] for u in s.units] == [k * op7.TICKS for k in range(11)] and [u[2] for u in s.units] == [k % 8 == 0 for k in range(11)]
    assert op7.demux(m[: 188 * 5] + m[188 * 6 :]).gaps == 1
    assert op7.demux(m[: 188 * 5] + m[188 * 4 :]).repeated == 1
    assert op7.demux(m[:190]).damaged == 1
    assert op7.demux(bytes([m[0]]) + m[1:8] + b"\x55" + m[9:]).damaged >= 1


def test_query_and_edges(spark, sf):
    df = spark.createDataFrame([(1, None, b"z"), (2, "é" * 700, b"z"), (3, "é" * 700, b"z")], "doc_id long, text string, media binary")
    out = {r.doc_id: r for r in op7.digests(op7.from_media(op7.to_media(df))).collect()}
    p = op7.padded("é" * 700)
    assert out[2].payload_sha256 == hashlib.sha256(p).hexdigest() and out[2].tail_crc32 == zlib.crc32(p[-32:]) and out[2].n_bytes == 1400 and out[2].payload_bytes == 1728
    assert out[2].media_sha256 == hashlib.sha256(op7.mux(p)).hexdigest() and out[2][1:] == out[3][1:]
    assert (out[1].n_bytes, out[1].payload_bytes) == (0, 576)
    assert op7.digests(op7.from_media(op7.to_media(df.limit(0)))).count() == 0
    broken = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"xx"))], "doc_id long, n_bytes long, media binary")
    assert [r.payload for r in op7.from_media(broken).collect()] == [None, None]
    assert op7.op7_transport_streams(spark, sf).count() == 200


def packet(hexes, fill=b"\xff"):
    return bytes.fromhex(hexes).ljust(188, fill)


#: Packets written out by hand after ISO/IEC 13818-1: a program table (program 1 in PID 0x1000), a program map
#: (H.264 in 0x100, AAC in 0x101), and a video packet whose adaptation field has the random-access flag and a clock,
#: with a timestamp of 1.4 s (126,000 ticks).
PROGRAMS = packet("47400010 00 00B00D0001C100000001F0002AB104B2")
MAP = packet("47500010 00 02B0170001C10000E100F0001BE100F0000FE101F0002F44B99B")
HEAD = bytes.fromhex("000001E0 0000 808005 2100 07D861")


def video(cc, start, body, random=False):
    """A packet of PID 0x100, filled by an adaptation field."""
    n = 183 - len(body)
    field = bytes([n]) + (bytes([0x40 if random else 0]) + b"\xff" * (n - 1) if n else b"")
    return bytes([0x47, 0x41 if start else 0x01, 0x00, 0x30 | cc]) + field + body


def test_golden_packets():
    body = bytes(range(200)) * 2
    units = HEAD + body
    packets = [PROGRAMS, MAP, video(0, True, units[:150], True), video(1, False, units[150:300]), video(2, False, units[300:])]
    s = op7.demux(b"".join(packets))
    assert s.programs == {1: 0x1000} and s.kinds == {0x100: 0x1B, 0x101: 0x0F}
    assert s.payloads == {0x100: body} and [(u[0], u[1], u[2]) for u in s.units] == [(0x100, 126000, True)]
    assert (s.packets, s.repeated, s.gaps, s.damaged) == (5, 0, 0, 0)
    assert op7.demux(b"".join([*packets[:4], packets[3], packets[4]])).repeated == 1
    again = op7.demux(b"".join([*packets[:4], video(1, False, b"z" * 150), packets[4]]))  # the counter stands still, the payload doesn't
    assert (again.repeated, again.gaps) == (0, 1)
    assert op7.demux(PROGRAMS[:10] + b"\x00" + PROGRAMS[11:] + MAP).damaged == 1


def by_the_book(data):
    """A second, minimal reader: the elementary bytes and timestamps of PID ``pid`` by the header fields alone."""
    out, times, points, pid, counters = b"", [], [], None, {}
    for p in (data[i : i + 188] for i in range(0, len(data), 188)):
        head = int.from_bytes(p[:4], "big")
        assert head >> 24 == 0x47 and not head >> 23 & 1
        own, start, adaptation, payload, cc = head >> 8 & 0x1FFF, head >> 22 & 1, head >> 5 & 1, head >> 4 & 1, head & 15
        assert payload and counters.setdefault(own, cc) == cc
        counters[own] = (cc + 1) % 16
        rest = p[5 + p[4] :] if adaptation else p[4:]
        if own == 0:
            section = rest[1 + rest[0] :]
            pmt = (section[10] & 31) << 8 | section[11]
        elif own == pmt:
            section = rest[1 + rest[0] :]
            pid = (section[13] & 31) << 8 | section[14]
        else:
            assert own == pid
            if start:
                assert rest[:3] == b"\x00\x00\x01" and rest[7] >> 7
                b = rest[9:14]
                times.append(((b[0] >> 1 & 7) << 30) + ((b[1] << 7 | b[2] >> 1) << 15) + (b[3] << 7 | b[4] >> 1))
                points.append(bool(adaptation and p[4] and p[5] & 0x40))
                rest = rest[9 + rest[8] :]
            out += rest
    return out, times, points


def test_against_a_second_reader():
    for n in (0, 1, 576, 9216, 70001):
        p = os.urandom(n)
        m = op7.mux(p)
        s = op7.demux(m)
        assert by_the_book(m) == (p, [u[1] for u in s.units], [u[2] for u in s.units])
