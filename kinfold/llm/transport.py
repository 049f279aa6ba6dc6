"""Media columns: MPEG transport streams (ISO/IEC 13818-1) in a binary column.

The parser finds packets of 188 bytes by their sync bytes, follows the program association table to
the program map tables (with CRC check), checks continuity counters, reassembles the packets of each
elementary stream and stores their time stamps and random-access points. The writer makes such
streams out of payloads, for tests and round trips.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import words as W

PACKET = 188
SYNC = 0x47
VIDEO_PID, MAP_PID, PROGRAM = 0x100, 0x1000, 1
#: Stream ids whose packets have no optional header: map, padding, private 2, ECM, EMM, DSM-CC, type E, directory.
BARE = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))
#: What the writer makes: bytes of an elementary packet, ticks of 90 kHz between them, how many to a random-access point.
PES_BYTES, TICKS, GROUP = 4096, 3600, 12


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


class Pes(NamedTuple):
    """One elementary packet."""

    pts: int | None
    dts: int | None
    random_access: bool
    packet: int
    payload: bytes
    stream_id: int | None


class Stream(NamedTuple):
    """One elementary stream of a program."""

    program: int
    pid: int
    kind: int
    continuity_errors: int
    pes: list[Pes]
    pcr: list[int]


def packets(data: bytes) -> tuple[np.ndarray, int]:
    """Rows of 188 bytes, and how many bytes were in none.

    A packet is a sync byte that another follows 188 bytes later, or that ends the data; where that
    fails, the next such place is looked for.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw) // PACKET
    if len(raw) == n * PACKET and n and (raw[::PACKET] == SYNC).all():
        return raw.reshape(n, PACKET), 0
    starts, at = [], 0
    syncs = np.flatnonzero(raw == SYNC)
    good = syncs[(syncs + PACKET <= len(raw))]
    follows = np.zeros(len(raw) + 1, bool)
    follows[syncs] = True
    follows[len(raw)] = True
    ok = np.zeros(len(raw) + 1, bool)
    ok[good] = follows[good + PACKET]
    where = np.flatnonzero(ok)
    while True:
        if at < len(raw) and ok[at]:
            starts.append(at)
            at += PACKET
            continue
        if at + PACKET <= len(raw) and follows[at] and starts and starts[-1] + PACKET == at:  # the last before a break
            starts.append(at)
            at += PACKET
            continue
        k = np.searchsorted(where, at)
        if k == len(where):
            break
        at = int(where[k])
    rows = raw[np.array(starts, dtype=np.int64)[:, None] + np.arange(PACKET)] if starts else np.zeros((0, PACKET), np.uint8)
    return rows, len(raw) - rows.size


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _sections(rows: np.ndarray, payload_at: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """Sections of one table PID whose CRC is right."""
    waiting = b""
    for row, at, start in zip(rows, payload_at.tolist(), starts.tolist()):
        body = row[at:].tobytes()
        if start:
            pointer = body[0] if body else 0
            waiting += body[1 : 1 + pointer]
            yield from _cut(waiting)
            waiting = body[1 + pointer :]
        elif waiting:
            waiting += body
    yield from _cut(waiting)


def _cut(data: bytes) -> Iterator[bytes]:
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + ((data[1] & 0x0F) << 8 | data[2])
        if len(data) < size:
            return
        if crc(data[:size]) == 0:
            yield data[:size]
        data = data[size:]


def parse(data: bytes) -> tuple[list[Stream], int]:
    """Elementary streams by program and PID, and the number of bytes outside packets.

    Packets with the error indicator count for nothing. Null packets (PID 8191) are skipped, and so are
    sections that aren't current yet. A packet that repeats counter and payload of the one before is a
    duplicate and dropped; any other counter that isn't the next is a continuity error, unless the
    discontinuity indicator announces it, and ends the elementary packet in progress, which is kept as far
    as it came. A stream that several programs list is there for each of them.
    """
    rows, lost = packets(data)
    rows = rows[(rows[:, 1] & 0x80) == 0] if len(rows) else rows
    if not len(rows):
        return [], lost
    pid = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    start = (rows[:, 1] & 0x40) != 0
    control = rows[:, 3] >> 4 & 3
    counter = rows[:, 3] & 15
    has_field, has_payload = (control & 2) != 0, (control & 1) != 0
    size = np.where(has_field, rows[:, 4].astype(np.int64), -1)
    payload_at = np.minimum(np.where(has_field, 5 + size, 4), PACKET)
    flags = np.where(has_field & (size > 0), rows[:, 5], 0)

    def of(p: int) -> np.ndarray:
        return np.flatnonzero((pid == p) & has_payload)

    def tables(p: int, kind: int) -> Iterator[bytes]:
        k = of(p)
        return (x for x in _sections(rows[k], payload_at[k], start[k]) if x[0] == kind and len(x) >= 12 and x[5] & 1)

    maps: dict[int, int] = {}  # program -> PID of its map
    for section in tables(0, 0):
        for i in range(8, len(section) - 4, 4):
            if number := section[i] << 8 | section[i + 1]:
                maps[number] = (section[i + 2] & 0x1F) << 8 | section[i + 3]
    kinds: dict[tuple[int, int], int] = {}
    clocks: dict[int, int] = {}
    for number, p in maps.items():
        for section in tables(p, 2):
            if (section[3] << 8 | section[4]) == number:
                clocks[number] = (section[8] & 0x1F) << 8 | section[9]
                i = 12 + ((section[10] & 0x0F) << 8 | section[11])
                while i + 5 <= len(section) - 4:
                    kinds[number, (section[i + 1] & 0x1F) << 8 | section[i + 2]] = section[i]
                    i += 5 + ((section[i + 3] & 0x0F) << 8 | section[i + 4])
    clocked = np.flatnonzero((flags & 0x10 != 0) & (size >= 7))
    out = []
    for (number, p), kind in sorted(kinds.items()):
        k = of(p)
        step = (counter[k][1:].astype(int) - counter[k][:-1]) % 16
        same = np.append(False, step == 0)
        for i in np.flatnonzero(same).tolist():
            same[i] = not same[i - 1] and rows[k[i], payload_at[k[i]] :].tobytes() == rows[k[i - 1], payload_at[k[i - 1]] :].tobytes()
        jump = np.append(False, step != 1) & ~same & ((flags[k] & 0x80) == 0)
        pes: list[Pes] = []
        parts: list[bytes] = []
        first = -1
        for i, again, jumped, begins in zip(k.tolist(), same.tolist(), jump.tolist(), start[k].tolist()):
            if again:
                continue
            if (jumped or begins) and parts:
                pes.append(_pes(parts, first, bool(flags[first] & 0x40)))
                parts = []
            if begins:
                first = i
            if begins or parts:
                parts.append(rows[i, payload_at[i] :].tobytes())
        if parts:
            pes.append(_pes(parts, first, bool(flags[first] & 0x40)))
        pcr = [_clock(rows[i]) for i in clocked[pid[clocked] == p].tolist()] if clocks.get(number) == p else []
        out.append(Stream(number, p, kind, int(jump.sum()), pes, pcr))
    return out, lost


def _clock(row: np.ndarray) -> int:
    """Program clock reference of a packet, in ticks of 27 MHz."""
    b = row[6:12].tolist()
    return (b[0] << 25 | b[1] << 17 | b[2] << 9 | b[3] << 1 | b[4] >> 7) * 300 + ((b[4] & 1) << 8 | b[5])


def _pes(parts: list[bytes], first: int, random_access: bool) -> Pes:
    data = b"".join(parts)
    if len(data) < 6 or data[:3] != b"\0\0\1":
        return Pes(None, None, random_access, first, data, None)
    size = data[4] << 8 | data[5]
    end = 6 + size if size else len(data)
    if data[3] in BARE:
        return Pes(None, None, random_access, first, data[6:end], data[3])
    if len(data) < 9:
        return Pes(None, None, random_access, first, b"", data[3])
    pts = _stamp(data[9:14]) if data[7] & 0x80 and len(data) >= 14 else None
    dts = _stamp(data[14:19]) if data[7] & 0x40 and len(data) >= 19 else pts
    return Pes(pts, dts, random_access, first, data[9 + data[8] : end], data[3])


def _table(section: bytes, pid: int) -> bytes:
    body = section + crc(section).to_bytes(4, "big")
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + body).ljust(PACKET, b"\xff")


_PAT = _table(bytes([0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, PROGRAM, 0xE0 | MAP_PID >> 8, MAP_PID & 255]), 0)
_PMT = _table(bytes([2, 0xB0, 18, 0, PROGRAM, 0xC1, 0, 0, 0xE0 | VIDEO_PID >> 8, VIDEO_PID & 255, 0xF0, 0, 0x1B, 0xE0 | VIDEO_PID >> 8, VIDEO_PID & 255, 0xF0, 0]), MAP_PID)


def _stamped(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def mux(payload: bytes, pes_bytes: int = PES_BYTES, ticks: int = TICKS, group: int = GROUP) -> bytes:
    """A stream of one program with one elementary stream that carries the payload."""
    out, counter = [_PAT, _PMT], 0
    for n, at in enumerate(range(0, len(payload), pes_bytes)):
        body = payload[at : at + pes_bytes]
        stamps = _stamped(2, n * ticks & (1 << 33) - 1)
        data = b"\0\0\1\xe0" + (3 + len(stamps) + len(body)).to_bytes(2, "big") + bytes([0x80, 0x80, len(stamps)]) + stamps + body
        i = 0
        while i < len(data):
            flag = 0x40 if i == 0 and n % group == 0 else 0
            room = PACKET - 4 - (2 if flag else 0)
            part = data[i : i + room]
            fill = PACKET - 4 - len(part)
            field = b"" if not fill else bytes([fill - 1]) + (bytes([flag]) + b"\xff" * (fill - 2) if fill > 1 else b"")
            out.append(bytes([SYNC, (0x40 if i == 0 else 0) | VIDEO_PID >> 8, VIDEO_PID & 255, (0x30 if fill else 0x10) | counter]) + field + part)
            i, counter = i + len(part), counter + 1 & 15
    return b"".join(out)


def _muxed(key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in W.slices(big, text):
                media = [None if t is None else mux(t.encode("utf-8", "surrogatepass")) for t in W.column(batch, text).to_pylist()]
                yield pa.RecordBatch.from_arrays([W.column(batch, key), pa.array(media, pa.binary())], [key, "media"])

    return run


def mux_table(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, media)``: the text of each row as a transport stream.

    A null text has null media, an empty one a stream of tables alone; null keys and repeated rows stay,
    an empty table gives an empty one, and only the two columns are read.
    """
    return rows.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(_muxed(key, text), f"{key} long, media binary")


_FIELDS = {
    "program": pa.int32(), "pid": pa.int32(), "stream_type": pa.int32(), "n_pes": pa.int64(), "n_bytes": pa.int64(), "digest": pa.string(),
    "continuity_errors": pa.int64(), "stray_bytes": pa.int64(), "pts": pa.list_(pa.int64()), "dts": pa.list_(pa.int64()), "random_access": pa.list_(pa.int64()), "packet": pa.list_(pa.int64()), "pcr": pa.list_(pa.int64()),
}


def _parsed(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, media in zip(W.column(batch, key).to_pylist(), W.column(batch, "media")):
                if (media := media.as_py()) is None:
                    continue
                found, lost = parse(media)
                for s in found:
                    keys.append(k)
                    payload = b"".join(p.payload for p in s.pes)
                    rows.append((s.program, s.pid, s.kind, len(s.pes), len(payload), hashlib.md5(payload).hexdigest(), s.continuity_errors, lost, [p.pts for p in s.pes], [p.dts for p in s.pes], [i for i, p in enumerate(s.pes) if p.random_access], [p.packet for p in s.pes], s.pcr))
            columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, _FIELDS.values()))], [key, *_FIELDS])

    return run


def streams(table: DataFrame, key: str) -> DataFrame:
    """One row per elementary stream of the ``media`` column: its program, PID and type, figures, MD5 of its bytes, and lists.

    ``pts`` and ``dts`` are the time stamps by elementary packet (90 kHz), ``random_access`` the numbers
    of those that start at a random-access point, ``packet`` the transport packet where each starts (to
    seek by), ``pcr`` the program's clock references that this stream carries (27 MHz). Null and empty media, and such without a program table, have no row; a null key stays
    null; repeated rows are parsed each by itself; an empty table gives an empty one; only the key and
    ``media`` are read. No shuffle.
    """
    names = "program int, pid int, stream_type int, n_pes long, n_bytes long, digest string, continuity_errors long, stray_bytes long, pts array<long>, dts array<long>, random_access array<long>, packet array<long>, pcr array<long>"
    return table.select(F.col(key).cast("long").alias(key), "media").mapInArrow(_parsed(key), f"{key} long, {names}")
