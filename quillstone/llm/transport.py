"""MPEG transport streams as a media column.

A payload becomes an elementary stream of access units, each in a PES packet with a presentation time, cut into 188-byte transport
packets behind a program association and a program map table. Reading parses the tables, checks continuity counters, reassembles
the PES packets, and stores times and random-access points.
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

from ._scratch import small_batches

PACKET, BODY = 188, 184
PAT_PID, PMT_PID, MEDIA_PID, PROGRAM, PRIVATE = 0, 0x100, 0x101, 1, 0x06
UNIT, EVERY, TICKS = 2304, 4, 3600

_table = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _table.append(_c)


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) ^ _table[(c >> 24) ^ b]) & 0xFFFFFFFF
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _psi(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_HEAD = _psi(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _psi(
    PMT_PID, _section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\0")
)


def _time(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | (t >> 29) & 14 | 1, t >> 22 & 255, (t >> 14) & 254 | 1, t >> 7 & 255, (t << 1) & 254 | 1])


def _read_time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def write_ts(payload: bytes, unit: int = UNIT, every: int = EVERY, ticks: int = TICKS) -> bytes:
    """A transport stream of the payload: an access unit each ``unit`` bytes, one in ``every`` of them a random-access point."""
    out, counter = [_HEAD], 0
    for k, a in enumerate(range(0, len(payload), unit)):
        t = k * ticks
        part = payload[a : a + unit]
        pes = b"\0\0\1\xbd" + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\5" + _time(2, t) + part
        # the first packet carries a clock reference, and says whether decoding can begin here
        clock = bytes([7, 0x10 | 0x40 * (k % every == 0)]) + (t << 15 | 0x7E00).to_bytes(6, "big")
        at, first = 0, True
        while at < len(pes):
            field = clock if first else b""
            room = BODY - len(field)
            if len(pes) - at < room:
                stuffing = room - (len(pes) - at)
                if not field:
                    field = b"\0" if stuffing == 1 else bytes([stuffing - 1, 0]) + b"\xff" * (stuffing - 2)
                else:
                    field = bytes([field[0] + stuffing]) + field[1:] + b"\xff" * stuffing
                room = len(pes) - at
            out.append(bytes([0x47, 0x40 * first | MEDIA_PID >> 8, MEDIA_PID & 255, (0x30 if field else 0x10) | counter]) + field + pes[at : at + room])
            at, counter, first = at + room, (counter + 1) & 15, False
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds: programs {number: {pid: stream type}}, payload of the first elementary stream, times of its
    access units, indexes of those where decoding can begin, clock references, and counts of what is wrong."""

    programs: dict = field(default_factory=dict)
    payload: bytes = b""
    times: list = field(default_factory=list)
    access: list = field(default_factory=list)
    clocks: list = field(default_factory=list)
    packets: int = 0
    discontinuities: int = 0
    errors: int = 0


def _body(section: bytes) -> bytes | None:
    size = ((section[1] & 15) << 8 | section[2]) + 3 if len(section) > 3 else 0
    return section[8 : size - 4] if 12 <= size <= len(section) and crc32_mpeg(section[:size]) == 0 else None


def read_ts(data: bytes) -> Stream:
    """Parses a stream. Packets without the sync byte, with the error flag, or repeated are passed over and counted; a unit that lost
    packets is left out and counted as an error. Sections must fit in one packet, as those that are written here do."""
    s = Stream()
    s.packets = len(data) // PACKET
    s.errors += len(data) % PACKET > 0
    where: dict[int, int] = {}
    last: dict[int, int] = {}
    media, unit, units, broken = None, None, [], False

    def close() -> None:
        nonlocal unit
        if unit is None:
            return
        whole, rap = b"".join(unit[0]), unit[1]
        size = int.from_bytes(whole[4:6], "big") if len(whole) >= 9 else 0
        if len(whole) < 9 or whole[:3] != b"\0\0\1" or broken or size and len(whole) != size + 6:
            s.errors += 1
        else:
            if rap:
                s.access.append(len(units))
            s.times.append(_read_time(whole[9:14]) if whole[7] & 0x80 else None)
            units.append(whole[9 + whole[8] :])
        unit = None

    for o in range(0, s.packets * PACKET, PACKET):
        p = data[o : o + PACKET]
        if p[0] != 0x47 or p[1] & 0x80:
            s.errors += 1
            continue
        pid, starts, kind, counter = (p[1] & 31) << 8 | p[2], p[1] & 0x40, p[3] >> 4 & 3, p[3] & 15
        at, rap = 4, False
        if kind & 2:
            n = p[4]
            if n and p[5] & 0x40:
                rap = True
            if n >= 7 and p[5] & 0x10 and pid == media:
                s.clocks.append(int.from_bytes(p[6:12], "big") >> 15)
            at = 5 + n
        if not kind & 1 or at > PACKET:
            continue
        if pid in last and counter != (last[pid] + 1) & 15 and not (kind & 2 and p[4] and p[5] & 0x80):
            if counter == last[pid]:
                continue
            s.discontinuities += 1
            broken = broken or pid == media
        last[pid] = counter
        if pid == PAT_PID and starts:
            body = _body(p[at + 1 + p[at] :])
            s.errors += body is None
            for i in range(0, len(body or b"") - 3, 4):
                if number := int.from_bytes(body[i : i + 2], "big"):
                    where[(body[i + 2] & 31) << 8 | body[i + 3]] = number
        elif pid in where and starts:
            body = _body(p[at + 1 + p[at] :])
            s.errors += body is None
            if body:
                i, streams = 4 + ((body[2] & 15) << 8 | body[3]), {}
                while i + 5 <= len(body):
                    streams[(body[i + 1] & 31) << 8 | body[i + 2]] = body[i]
                    i += 5 + ((body[i + 3] & 15) << 8 | body[i + 4])
                s.programs[where[pid]] = streams
                media = next(iter(streams), None) if media is None else media
        elif pid == media:
            if starts:
                if broken and unit is None:
                    broken = False
                close()
                broken, unit = False, ([], rap)
            if unit is not None:
                unit[0].append(p[at:])
    close()
    s.payload = b"".join(units)
    return s


def padded(text: str | None, multiple: int = 576) -> tuple[bytes, int]:
    """(UTF-8 bytes followed by bytes 255 up to a positive multiple, their length without these)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // multiple)) * multiple - len(raw)), len(raw)


def describe(s: Stream) -> str:
    known = [t for t in s.times if t is not None]
    streams = ",".join(f"{n}:{pid:#x}={kind:#x}" for n, m in sorted(s.programs.items()) for pid, kind in m.items())
    return f"programs={streams};packets={s.packets};units={len(s.times)};pts={min(known, default=-1)}..{max(known, default=-1)};access={','.join(map(str, s.access))};lost={s.discontinuities};errors={s.errors}"


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """(id, n_bytes, media, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, times, access).

    The payload is a text's UTF-8 bytes padded by 255 to a positive multiple of 576; everything after ``media`` is computed from the
    stored bytes as read back. Null and empty texts give 576 bytes 255. Null ids and repeated rows stay; equal texts give equal
    values; an empty table gives no rows. With keep_media=False the stored bytes are not returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 1024):
                b = big.slice(i, 1024)
                out = []
                for text in b.column(1):
                    payload, n = padded(text.as_py())
                    media = write_ts(payload)
                    s = read_ts(media)
                    got = s.payload
                    out.append((n, media if keep_media else None, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(s), s.times, s.access))
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(zip(*out), kinds))], names)

    names = ["id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "access"]
    small_batches(df.sparkSession)
    data = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = data.schema["id"].dataType.simpleString()
    return data.mapInArrow(run, f"id {kind}, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<long>, access array<long>").withColumnRenamed("id", id_col)
