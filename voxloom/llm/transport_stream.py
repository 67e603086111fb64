"""Media columns: MPEG transport streams (188-byte packets).

Reading parses the program tables, checks continuity counters, reassembles the
elementary packets of a stream, and gives its timestamps with the random-access
points. A writer stores any payload losslessly in the same format."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format (ISO/IEC 13818-1).
PACKET = 188
SYNC = 0x47
PAT_PID = 0
NULL_PID = 0x1FFF
PRIVATE_STREAM_1 = 0xBD
PRIVATE_DATA = 0x06
CLOCK = 90_000

PMT_PID = 0x1000
DATA_PID = 0x0100
PROGRAM = 1
#: Payload bytes of an elementary packet, and clock ticks between two of them (25 a second).
UNIT_BYTES = 32 << 10
UNIT_TICKS = CLOCK // 25
_HEADER = 14


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The 32-bit checksum of program tables."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(ticks: int) -> bytes:
    """A 33-bit timestamp as the five bytes of a PTS field."""
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | (t >> 29) & 0x0E, t >> 22 & 0xFF, 0x01 | (t >> 14) & 0xFE, t >> 7 & 0xFF, 0x01 | (t << 1) & 0xFE])


def write_stream(payload: bytes, unit_bytes: int = UNIT_BYTES) -> bytes:
    """``payload`` as a transport stream of one program with one private-data stream.

    Each elementary packet holds up to ``unit_bytes``, carries a timestamp and is a
    random-access point with its own copy of the program tables."""
    data, out, counter = np.frombuffer(payload, np.uint8), [], 0
    for unit, at in enumerate(range(0, max(1, len(data)), unit_bytes)):
        part = data[at : at + unit_bytes]
        ticks = unit * UNIT_TICKS
        length = len(part) + _HEADER - 6
        head = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (length if length < 65536 else 0).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks)
        body = np.concatenate([np.frombuffer(head, np.uint8), part])
        n = 1 + max(0, -(-(len(body) - 176) // 184))
        packets = np.full((n + 2, PACKET), 0xFF, np.uint8)
        packets[0], packets[1] = _PAT, _PMT
        packets[:2, 3] = 0x10 | unit & 15
        es = packets[2:]
        es[:, 0], es[:, 1], es[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        es[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        first = min(176, len(body))
        es[0, 1] |= 0x40
        es[0, 3] |= 0x20
        es[0, 4] = 183 - first
        es[0, 5] = 0x50  # random access, and a clock reference
        base = ticks & (1 << 33) - 1
        es[0, 6:12] = np.frombuffer((base << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        es[0, PACKET - first :] = body[:first]
        rest = body[first:]
        whole = len(rest) // 184
        es[1 : 1 + whole, 4:] = rest[: whole * 184].reshape(whole, 184)
        tail = len(rest) - whole * 184
        if tail:
            es[-1, 3] |= 0x20
            es[-1, 4] = 183 - tail
            if tail < 183:
                es[-1, 5] = 0
            es[-1, PACKET - tail :] = rest[whole * 184 :]
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """One elementary stream: its units' timestamps (-1: none), places in ``data`` and random-access flags."""

    pid: int
    program: int
    kind: int
    pts: list[int] = field(default_factory=list)
    dts: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    data: bytes = b""
    lost: int = 0
    repeated: int = 0


@dataclass
class Report:
    streams: list[Stream]
    packets: int
    skipped_bytes: int
    bad_sections: int
    errors: int


def _aligned(data: np.ndarray) -> tuple[np.ndarray, int]:
    """(packets, 188) of all packets, and the bytes outside them; after lost sync the next run of packets is found."""
    n = len(data) // PACKET
    if n * PACKET == len(data) and (data[::PACKET] == SYNC).all():
        return data.reshape(n, PACKET), 0
    marks = np.flatnonzero(data == SYNC)
    is_mark = np.zeros(len(data) + PACKET, bool)
    is_mark[marks] = True
    starts, at = [], 0
    while at + PACKET <= len(data):
        if is_mark[at] and (is_mark[at + PACKET] or at + PACKET == len(data) or (starts and starts[-1] == at - PACKET)):
            starts.append(at)
            at += PACKET
        else:
            k = int(np.searchsorted(marks, at + 1))
            if k == len(marks):
                break
            at = int(marks[k])
    rows = np.array(starts, np.int64)
    return data[rows[:, None] + np.arange(PACKET)] if len(rows) else np.zeros((0, PACKET), np.uint8), len(data) - len(rows) * PACKET


def _sections(packets: np.ndarray, begin: np.ndarray) -> tuple[list[bytes], int]:
    """Complete sections of one table's packets, in order, and how many failed their checksum."""
    buffer, found, bad = b"", [], 0
    for row, at in zip(packets, begin.tolist(), strict=True):
        body = row[at:].tobytes()
        if row[1] & 0x40:
            pointer = body[0] if body else 0
            parts = [buffer + body[1 : 1 + pointer] if buffer else b"", body[1 + pointer :]]
        else:
            parts = [buffer + body] if buffer else []
        for part in parts:
            while len(part) >= 3 and part[0] != 0xFF:
                size = 3 + (int.from_bytes(part[1:3], "big") & 0xFFF)
                if len(part) < size:
                    break
                if section_crc(part[:size]) == 0:
                    found.append(part[:size])
                else:
                    bad += 1
                part = part[size:]
            buffer = part if part and part[0] != 0xFF else b""
    return found, bad


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def read_stream(media: bytes) -> Report:
    """Demultiplexes a transport stream.

    Packets with the error flag or of the null PID don't count. A packet repeated at once
    with its counter is dropped; any other jump of a counter that isn't announced counts
    as a loss. Bytes of a stream before its first elementary packet are dropped."""
    packets, skipped = _aligned(np.frombuffer(media, np.uint8))
    flagged = (packets[:, 1] & 0x80) != 0 if len(packets) else np.zeros(0, bool)
    good = packets[~flagged]
    pids = (good[:, 1].astype(np.int64) & 0x1F) << 8 | good[:, 2]
    control = good[:, 3] >> 4 & 3
    begin = np.where(control & 2, 5 + good[:, 4].astype(np.int64), 4)
    has = ((control & 1) != 0) & (begin < PACKET)
    bad = 0
    programs: dict[int, int] = {}
    pick = (pids == PAT_PID) & has
    known: dict[bytes, bool] = {}
    sections, failed = _sections(good[pick], begin[pick])
    bad += failed
    for s in sections:
        if s[0] == 0 and s not in known:
            known[s] = True
            for k in range(8, len(s) - 4, 4):
                number = int.from_bytes(s[k : k + 2], "big")
                if number:
                    programs[int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF] = number
    streams: dict[int, Stream] = {}
    for pid, number in programs.items():
        pick = (pids == pid) & has
        sections, failed = _sections(good[pick], begin[pick])
        bad += failed
        for s in sections:
            if s[0] != 2 or s in known:
                continue
            known[s] = True
            at = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while at + 5 <= len(s) - 4:
                es = int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF
                streams.setdefault(es, Stream(es, number, s[at]))
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0xFFF)
    for stream in streams.values():
        _fill(stream, *(x[(pids == stream.pid) & has] for x in (good, begin)))
    return Report([streams[k] for k in sorted(streams)], len(packets), skipped, bad, int(flagged.sum()))


def _fill(stream: Stream, packets: np.ndarray, begin: np.ndarray) -> None:
    if not len(packets):
        return
    counters = packets[:, 3] & 15
    step = (counters[1:].astype(int) - counters[:-1]) & 15
    adapted = (packets[:, 3] & 0x20) != 0
    announced = adapted & (packets[:, 4] > 0) & ((packets[:, 5] & 0x80) != 0)
    repeat = np.zeros(len(packets), bool)
    for k in np.flatnonzero(step == 0) + 1:
        repeat[k] = not announced[k] and np.array_equal(packets[k], packets[k - 1])
    stream.repeated = int(repeat.sum())
    packets, begin, counters, announced, adapted = (x[~repeat] for x in (packets, begin, counters, announced, adapted))
    stream.lost = int((((counters[1:].astype(int) - counters[:-1]) & 15 != 1) & ~announced[1:]).sum())
    sizes = PACKET - begin
    data = packets[np.arange(PACKET) >= begin[:, None]]
    places = np.cumsum(sizes) - sizes
    heads = np.flatnonzero(packets[:, 1] & 0x40)
    ends = np.append(places[heads[1:]], len(data)) if len(heads) else np.zeros(0, np.int64)
    parts, at = [], 0
    for head, stop in zip(heads.tolist(), ends.tolist(), strict=True):
        unit = data[places[head] : stop]
        if len(unit) < 9 or unit[0] or unit[1] or unit[2] != 1:
            stream.lost += 1
            continue
        length = int(unit[4]) << 8 | int(unit[5])
        unit = unit[: 6 + length] if length else unit
        flags, skip = int(unit[7]) >> 6, 9 + int(unit[8])
        stream.pts.append(_read_stamp(unit[9:14].tobytes()) if flags & 2 else -1)
        stream.dts.append(_read_stamp(unit[14:19].tobytes()) if flags == 3 else stream.pts[-1])
        stream.random_access.append(bool(adapted[head] and packets[head, 4] and packets[head, 5] & 0x40))
        stream.offsets.append(at)
        stream.sizes.append(len(unit) - skip)
        parts.append(unit[skip:].tobytes())
        at += len(parts[-1])
    stream.data = b"".join(parts)


_UNITS = "id long, program int, pid int, kind int, unit int, pts long, dts long, random_access boolean, offset long, size long, data binary"


def access_units(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per elementary packet of every stream of a binary column: its program, pid,
    stream type, number, timestamps, random-access flag, place in the stream, and bytes.

    A null or empty value, and one without readable tables, gives no rows; rows repeated
    with one id give their units each. Only the two columns named are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not media.is_valid:
                    continue
                for s in read_stream(media.as_buffer().to_pybytes()).streams:
                    n = len(s.sizes)
                    if n:
                        data = [s.data[a : a + b] for a, b in zip(s.offsets, s.sizes, strict=True)]
                        fixed = [pa.array([x] * n, t) for x, t in ((i, pa.int64()), (s.program, pa.int32()), (s.pid, pa.int32()), (s.kind, pa.int32()))]
                        own = [pa.array(range(n), pa.int32()), pa.array(s.pts, pa.int64()), pa.array(s.dts, pa.int64()), pa.array(s.random_access), pa.array(s.offsets, pa.int64()), pa.array(s.sizes, pa.int64()), pa.array(data, pa.binary())]
                        yield pa.RecordBatch.from_arrays(fixed + own, [f.split()[0] for f in _UNITS.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, _UNITS).withColumnRenamed("id", id_col)


def padded(text: bytes, unit: int = 64) -> bytes:
    """``text`` with zero bytes appended up to a positive multiple of ``unit``."""
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\0")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text (null: empty) stored as a transport stream: ``id_col``, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x.as_buffer().to_pybytes() for x in part.column(1)]
                media = [write_stream(padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def describe_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", bytes_col: str = "n_bytes") -> DataFrame:
    """What is read back from stored streams: ``id_col``, n_bytes, payload_bytes, payload_sha256,
    tail_crc32 (of the last 64 payload bytes), media_bytes, media_sha256 and feature, which
    names the streams found, their units, random-access points, last timestamp and losses.

    A null value counts as an empty stream without programs. The payload is that of the
    stream with the lowest pid. Equal media give equal values; only the columns named are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            out = []
            for media in batch.column(2):
                raw = media.as_buffer().to_pybytes() if media.is_valid else b""
                report = read_stream(raw)
                payload = report.streams[0].data if report.streams else b""
                told = [f"packets={report.packets};skipped={report.skipped_bytes};bad_sections={report.bad_sections};errors={report.errors}"]
                for s in report.streams:
                    told.append(f"program={s.program};pid={s.pid};type={s.kind};units={len(s.sizes)};random_access={sum(s.random_access)};last_pts={max(s.pts, default=-1)};lost={s.lost};repeated={s.repeated}")
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), "|".join(told)))
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))], names)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(bytes_col).cast("long").alias("n_bytes"), F.col(media_col).cast("binary").alias("media"))
    return rows.mapInArrow(
        run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    ).withColumnRenamed("id", id_col)
