"""Media columns: bytes carried in an MPEG transport stream, and read back from it.

mux() writes a programme association table, a programme map table and one private elementary
stream; each access unit is a packetised elementary stream packet with a 90 kHz presentation time
stamp, its first transport packet carries a clock reference and the random-access mark where one
is due. demux() parses the tables (sections of any number of packets, several in one), checks every
continuity counter, reassembles the elementary packets (of given or, as in video, open length) and
lists the time stamps with the packet numbers of the random-access points.

Null and empty: the empty payload (padded like any other). Equal payloads give equal streams, also
for repeated rows. Very long texts: a worker holds one text and its stream at a time. Empty table: no
rows. Other columns, whatever their names, do not matter. Damaged streams: one repetition of a packet,
which the standard allows, is dropped; a packet whose counter does not follow is counted in `gaps`, unless
it carries the discontinuity mark; a unit with a gap in it keeps what came before the gap and counts as
`damaged`, like one of wrong length; a stream without tables gives no programme and an empty payload.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from framewright.llm import common

PACKET, UNIT = 188, 192
PMT_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x0100, 0x0101, 0x06, 0xBD
#: 192-byte units in an access unit, access units between random-access points, samples a second.
UNITS, GOP, RATE = 16, 4, 8000


@functools.cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return tuple(out)


def section_crc(data: bytes) -> int:
    """The CRC-32 of table sections (most significant bit first, no final inversion)."""
    t, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = (c << 8 ^ t[c >> 24 ^ b]) & 0xFFFFFFFF
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


@functools.cache
def _tables() -> bytes:
    """The two packets with the tables, as every stream of ours begins."""
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
    out = b""
    for pid, section in ((0, pat), (PMT_PID, pmt)):
        body = b"\x00" + section
        out += b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10" + body.ljust(184, b"\xff")
    return out


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29) & 0x0E | 1]) + ((t >> 14) & 0xFFFE | 1).to_bytes(2, "big") + ((t << 1) & 0xFFFE | 1).to_bytes(2, "big")


def mux(payload: bytes) -> bytes:
    """A transport stream of whole 188-byte packets that carries payload."""
    out, counter, size = [_tables()], 0, UNIT * UNITS
    for k, at in enumerate(range(0, len(payload), size)):
        unit = payload[at : at + size]
        pts = 90000 * at // RATE & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(2, pts) + unit
        pcr = (pts << 15 | 0x7E00).to_bytes(6, "big")
        field, pos = bytes([0x50 if k % GOP == 0 else 0x10]) + pcr, 0
        while pos < len(pes):
            room = 184 - (len(field) + 1 if field else 0)
            part = pes[pos : pos + room]
            if len(part) < room:
                stuffing = room - len(part)
                field = field + b"\xff" * stuffing if field else (b"" if stuffing == 1 else b"\x00" + b"\xff" * (stuffing - 2))
                adapted = bytes([len(field)]) + field
            else:
                adapted = bytes([len(field)]) + field if field else b""
            out.append(b"\x47" + ((0x4000 if pos == 0 else 0) | STREAM_PID).to_bytes(2, "big") + bytes([(0x30 if adapted else 0x10) | counter]) + adapted + part)
            counter, field, pos = counter + 1 & 15, b"", pos + len(part)
    return b"".join(out)


@dataclass
class Stream:
    """What demux() finds."""

    payload: bytes = b""
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    gaps: int = 0
    damaged: int = 0
    stamps: list[int] = field(default_factory=list)
    #: (time stamp, number of the packet) of each random-access point
    access: list[tuple[int, int]] = field(default_factory=list)


class Sections:
    """Table sections of one packet identifier, over any number of packets; those with a wrong CRC are left out."""

    def __init__(self) -> None:
        self.held: bytearray | None = None

    def feed(self, body: bytes, start: bool) -> list[bytes]:
        out = []
        if start:
            point = 1 + body[0] if body else 0
            if self.held is not None:  # the end of a section that began in an earlier packet
                self.held += body[1:point]
                out += self._whole()
            self.held = bytearray(body[point:])
        elif self.held is not None:
            self.held += body
        return out + self._whole()

    def _whole(self) -> list[bytes]:
        out = []
        while self.held is not None and len(self.held) >= 3:
            if self.held[0] == 0xFF:  # stuffing up to the packet's end
                self.held = None
                break
            n = 3 + (int.from_bytes(self.held[1:3], "big") & 0xFFF)
            if len(self.held) < n:
                break
            s = bytes(self.held[:n])
            if section_crc(s) == 0:
                out.append(s)
            del self.held[:n]
        return out


def demux(data: bytes) -> Stream:
    """Parse tables, check counters, reassemble the first elementary stream."""
    out, last, tables, chunks = Stream(), {}, {}, []
    unit, access, broken, target = bytearray(), None, False, None

    def flush() -> None:
        if not unit:
            return
        if unit[:3] != b"\x00\x00\x01" or len(unit) < 9:
            out.damaged += 1
            return
        want, begin = int.from_bytes(unit[4:6], "big"), 9 + unit[8]
        end = 6 + want if want else len(unit)  # no length: up to the next unit
        out.damaged += len(unit) != end or (broken and not want)
        if unit[7] & 0x80 and len(unit) >= 14:
            t = unit[9:14]
            pts = (t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1
            out.stamps.append(pts)
            if access is not None:
                out.access.append((pts, access))
        chunks.append(bytes(unit[begin:end]))

    for at in range(0, len(data) - PACKET + 1, PACKET):
        p = data[at : at + PACKET]
        number, out.packets = out.packets, out.packets + 1
        if p[0] != 0x47 or p[1] & 0x80:
            out.damaged += 1
            continue
        pid, start, control, counter = (p[1] & 0x1F) << 8 | p[2], bool(p[1] & 0x40), p[3] >> 4 & 3, p[3] & 15
        begin, random, fresh = 4, False, False
        if control & 2:
            begin += 1 + p[4]
            random, fresh = p[4] > 0 and bool(p[5] & 0x40), p[4] > 0 and bool(p[5] & 0x80)
        if not control & 1:
            continue
        body = p[begin:]
        gap = False
        if pid in last and not fresh:
            old, held, again = last[pid]
            if counter == old and body == held and not again:
                last[pid] = (old, held, True)
                continue
            gap = counter != old + 1 & 15
            out.gaps += gap
        last[pid] = (counter, body, False)
        if pid == 0 or pid in out.programs.values():
            own = tables.setdefault(pid, Sections())
            if gap:
                own.held = None
            for s in own.feed(body, start):
                s = s[3:-4][5:]
                if pid == 0:
                    out.programs |= {int.from_bytes(s[i : i + 2], "big"): int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(s) - 3, 4) if s[i : i + 2] != b"\0\0"}
                    continue
                i = 4 + (int.from_bytes(s[2:4], "big") & 0xFFF)
                while i + 5 <= len(s):
                    out.streams[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                    i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
                target = next(iter(out.streams), None)
        elif pid == target:
            broken |= gap
            if start:
                flush()
                unit.clear()
                access, broken = number if random else None, False
            if not broken:
                unit += body
    flush()
    out.payload = b"".join(chunks)
    return out


def padded(text: bytes) -> bytes:
    """text with blanks up to a positive multiple of 192 bytes."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its stream in column `media`, with the unpadded size n_bytes."""
    out = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                raw = [t.encode() if t is not None else b"" for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array([mux(padded(t)) for t in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    return out.mapInArrow(common.trimmed(run), f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests, time stamps and random-access points, computed from the stored bytes alone."""
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, gaps long, damaged long, n_stamps long, access array<struct<pts:long,packet:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())]))
        for b in batches:
            rows = []
            for m in b.column(2):
                data = m.as_py() or b""
                s = demux(data)
                feature = f"programs={len(s.programs)};streams={','.join(f'{p}:{t}' for p, t in s.streams.items())};packets={s.packets};units={len(s.stamps)};last_pts={max(s.stamps, default=-1)};access={len(s.access)};gaps={s.gaps};damaged={s.damaged}"
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.gaps, s.damaged, len(s.stamps), [{"pts": p, "packet": n} for p, n in s.access]))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), kind]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, "n_bytes", *(f.split(" ")[0] for f in fields.split(", "))])

    return media.select(id_col, "n_bytes", "media").mapInArrow(common.trimmed(run), f"{id_col} {media.schema[id_col].dataType.simpleString()}, n_bytes long, {fields}")
