"""Byte payloads as MPEG transport streams, and back.

The writer makes a single-program stream: a program association table, a program
map table, and one private elementary stream with an access unit of 576 payload
bytes a PES packet, each with a presentation timestamp, a clock reference and
the random-access flag.  The reader finds the streams of any program through the
tables, checks continuity counters, leaves out repeated and wrong packets, puts
PES packets together, marks those with missing data, and lists timestamps with
the packets they start at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
#: Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID, STUFFING = 188, 0x47, 0, 0xFF
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CLOCK = 90_000

PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
#: 25 access units a second.
STEP = CLOCK // 25
SLICE_BYTES = 1 << 22
PES_HEADER = 14
#: Payload bytes of the four packets of an access unit: clock reference in the first, stuffing in the last.
ROOM = (176, 184, 184, PES_HEADER + UNIT - 544)


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    """CRC-32/MPEG-2 by bytes: polynomial 0x04C11DB7, not reflected."""
    table = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        table = np.where(table & np.uint64(1 << 31), (table << np.uint64(1)) ^ np.uint64(0x04C11DB7), table << np.uint64(1)) & np.uint64(0xFFFFFFFF)
    return table


def crc_mpeg(data: bytes) -> int:
    table, crc = _crc_table(), 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ int(table[(crc >> 24) ^ byte])
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, len(body) + 9 & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, bytes([STUFFING]))


@lru_cache(maxsize=1)
def program_tables() -> bytes:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    streams = bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + streams)
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


@lru_cache(maxsize=1)
def _template() -> np.ndarray:
    """The four packets of an access unit without counters, times and payload."""
    unit = np.full((4, PACKET), STUFFING, np.uint8)
    unit[:, 0], unit[:, 1], unit[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
    unit[0, 1] |= 0x40
    unit[:, 3] = (0x30, 0x10, 0x10, 0x30)
    unit[0, 4:6] = 7, 0x50  # random access, clock reference
    unit[3, 4:6] = PACKET - 5 - ROOM[3], 0
    length = PES_HEADER - 6 + UNIT
    unit[0, 12:21] = 0, 0, 1, PRIVATE_STREAM, length >> 8, length & 0xFF, 0x84, 0x80, 5
    return unit


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """A transport stream of a payload whose size is a positive multiple of ``unit``."""
    if unit != UNIT or not payload or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    data = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = np.arange(len(data), dtype=np.int64)
    out = np.repeat(_template()[None], len(data), axis=0)
    out[:, :, 3] |= ((4 * n[:, None] + np.arange(4)) & 15).astype(np.uint8)
    base, pts = n * STEP & (1 << 33) - 1, (n + 1) * STEP & (1 << 33) - 1
    for k, shift in enumerate((25, 17, 9, 1)):
        out[:, 0, 6 + k] = base >> shift & 0xFF
    out[:, 0, 10], out[:, 0, 11] = (base & 1) << 7 | 0x7E, 0
    out[:, 0, 21] = 0x21 | (pts >> 30 & 7) << 1
    out[:, 0, 22], out[:, 0, 23] = pts >> 22 & 0xFF, 1 | (pts >> 15 & 0x7F) << 1
    out[:, 0, 24], out[:, 0, 25] = pts >> 7 & 0xFF, 1 | (pts & 0x7F) << 1
    at = ROOM[0] - PES_HEADER
    out[:, 0, 12 + PES_HEADER :] = data[:, :at]
    out[:, 1, 4:], out[:, 2, 4:] = data[:, at : at + 184], data[:, at + 184 : at + 368]
    out[:, 3, PACKET - ROOM[3] :] = data[:, at + 368 :]
    return program_tables() + out.tobytes()


@dataclass
class Stream:
    """An elementary stream as read: its payload, and of each PES packet the time, first TS packet, random-access flag and whether data of it are missing."""

    pid: int
    payload: bytes
    pts: np.ndarray
    packet: np.ndarray
    random_access: np.ndarray
    broken: np.ndarray
    continuity_errors: int


def _payload_begin(rows: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins; PACKET if it has none."""
    begin = np.where(rows[:, 3] & 0x20 > 0, 5 + rows[:, 4].astype(np.int64), 4)
    return np.minimum(np.where(rows[:, 3] & 0x10 > 0, begin, PACKET), PACKET)


def _sections(packets: np.ndarray, pid: int, pids: np.ndarray, table_id: int) -> Iterator[bytes]:
    """Whole sections of a table, which may lie in one packet or run over several."""
    held, counter = None, None
    rows = packets[pids == pid]
    for row, begin in zip(rows, _payload_begin(rows).tolist()):
        if begin >= PACKET or row[1] & 0x80:
            continue
        number = int(row[3]) & 15
        if counter is not None and number == counter:
            continue  # a duplicate
        if counter is not None and number != (counter + 1) & 15:
            held = None
        counter, data = number, row[begin:].tobytes()
        if row[1] & 0x40:
            rest, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            if held is not None:
                yield from _whole(held + rest, table_id)[0]
            held = b""
        if held is not None:
            found, held = _whole(held + data, table_id)
            yield from found


def _whole(data: bytes, table_id: int) -> tuple[list[bytes], bytes | None]:
    """(the whole sections of the table at the start of ``data``, what follows them; None if that is stuffing)."""
    found = []
    while data and data[0] != STUFFING:
        if len(data) < 3 or len(data) < (size := 3 + ((data[1] & 0x0F) << 8 | data[2])):
            return found, data
        section, data = data[:size], data[size:]
        if section[0] == table_id:
            if crc_mpeg(section):
                raise ValueError(f"table {table_id}: wrong checksum")
            found.append(section)
    return found, None if data else b""


def _table(packets: np.ndarray, pid: int, pids: np.ndarray, table_id: int) -> list[bytes]:
    """The sections of the first version of a table that is in force, by their numbers; as many as there are."""
    found, version = {}, None
    for section in _sections(packets, pid, pids, table_id):
        if not section[5] & 1 or version not in (None, section[5]):
            continue
        version = section[5]
        found.setdefault(section[6], section)
        if len(found) == section[7] + 1:
            break
    return [found[k] for k in sorted(found)]


def _stream_pids(packets: np.ndarray, pids: np.ndarray) -> list[int]:
    pat = _table(packets, PAT_PID, pids, 0)
    if not pat:
        raise ValueError("no program association table")
    found = []
    for at, section in ((at, s) for s in pat for at in range(8, len(s) - 4, 4)):
        number, pmt_pid = section[at] << 8 | section[at + 1], (section[at + 2] & 0x1F) << 8 | section[at + 3]
        for pmt in _table(packets, pmt_pid, pids, 2) if number else ():
            place = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
            while place < len(pmt) - 4:
                found.append((pmt[place + 1] & 0x1F) << 8 | pmt[place + 2])
                place += 5 + ((pmt[place + 3] & 0x0F) << 8 | pmt[place + 4])
    return found


def demux(media: bytes) -> list[Stream]:
    """The elementary streams of all programs, in the tables' order."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("sync byte missing")
    pids = (packets[:, 1].astype(np.uint16) & 0x1F) << 8 | packets[:, 2]
    return [_elementary(packets, pids, pid) for pid in _stream_pids(packets, pids)]


def _continuity(rows: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(duplicates, breaks) of packets with payload: a packet sent twice in a row, and one before which others are missing.

    A packet may be repeated once, with the same payload; any further repeat is
    an error and no data.  A discontinuity indicator allows any counter.
    """
    counter = rows[:, 3].astype(np.int16) & 15
    step = np.concatenate([[1], (counter[1:] - counter[:-1]) % 16])
    told = (rows[:, 3] & 0x20 > 0) & (rows[:, 4] > 0) & (rows[:, 5] & 0x80 > 0)
    same = np.zeros(len(rows), bool)
    for i in np.flatnonzero((step == 0) & ~told):
        same[i] = begin[i] == begin[i - 1] and bool((rows[i, begin[i] :] == rows[i - 1, begin[i] :]).all())
    again = same & np.concatenate([[False], same[:-1]])
    return same, (step != 1) & ~told & ~same | again


def _elementary(packets: np.ndarray, pids: np.ndarray, pid: int) -> Stream:
    where = np.flatnonzero(pids == pid)
    begin = _payload_begin(packets[where])
    where, begin = where[begin < PACKET], begin[begin < PACKET]
    rows = packets[where]
    same, lost = _continuity(rows, begin)
    bad = rows[:, 1] & 0x80 > 0  # the transport says that the packet is wrong
    errors = int((lost | bad).sum())
    kept = ~same & ~bad
    damaged = np.flatnonzero(lost | bad)
    data = rows[kept[:, None] & (np.arange(PACKET) >= begin[:, None])]
    ends = np.cumsum(np.where(kept, PACKET - begin, 0))
    units = np.flatnonzero(kept & (rows[:, 1] & 0x40 > 0))
    first = (ends - (PACKET - begin))[units]
    after = np.append(first[1:], len(data))
    access = (rows[units, 3] & 0x20 > 0) & (rows[units, 4] > 0) & (rows[units, 5] & 0x40 > 0)
    # What is lost before a packet is missing from the unit before it, and from its own unless it begins one.
    broken = np.zeros(len(units) + 1, bool)
    broken[np.searchsorted(units, damaged - 1, "right")] = True
    broken[np.searchsorted(units, damaged, "right")[~np.isin(damaged, units)]] = True
    broken = broken[1:]

    whole = after - first >= 9
    field = lambda k: np.where(whole, data[np.minimum(first + k, len(data) - 1)], 0).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    whole &= (field(0) == 0) & (field(1) == 0) & (field(2) == 1)
    head = 9 + field(8)
    whole &= after - first >= head
    length = field(4) << 8 | field(5)
    ends = np.where(length > 0, first + 6 + length, after)
    broken |= ~whole | (ends > after)
    timed = whole & (field(7) & 0x80 > 0) & (field(8) >= 5)
    pts = (field(9) >> 1 & 7) << 30 | field(10) << 22 | field(11) >> 1 << 15 | field(12) << 7 | field(13) >> 1
    view = memoryview(data)
    payload = b"".join([view[a:b] for a, b, ok in zip((first + head).tolist(), np.minimum(ends, after).tolist(), whole.tolist()) if ok])
    return Stream(pid, payload, np.where(timed, pts, -1), where[units], access, broken, errors)


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\xff")


def byte_slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one row that is larger."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, last in byte_slices(b.column(2).to_pylist()):
            part = b.slice(first, last - first)
            media = pa.array([mux(padded(x or b"")) for x in part.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), media], ["id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text's UTF-8, padded with bytes 255, as a transport stream; null is empty.

    Rows with null or repeated ids give a row each; other columns are not read;
    an empty table gives an empty result.
    """
    raw = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("raw"), F.coalesce(F.octet_length(raw), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(_store, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary")


def index_points(stream: Stream) -> list[dict]:
    """Times and first packets of the PES packets that a reader may start at."""
    at = np.flatnonzero(stream.random_access & (stream.pts >= 0))
    return [{"pts": int(stream.pts[i]), "packet": int(stream.packet[i])} for i in at]


POINTS = "array<struct<pts: bigint, packet: bigint>>"


def _read(media: bytes | None) -> tuple[Stream | None, str | None]:
    """(the first elementary stream, why there is none)."""
    if media is None:
        return None, "no media"
    try:
        streams = demux(media)
    except ValueError as e:
        return None, str(e)
    return (streams[0], None) if streams else (None, "no elementary stream")


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    point = pa.list_(pa.struct({"pts": pa.int64(), "packet": pa.int64()}))
    names = ["id", "n_bytes", "media", "payload", "points", "continuity_errors", "broken_units", "sample_sum", "sample_energy", "problem"]
    for b in batches:
        sizes = pc.binary_length(b.column(2)).fill_null(0).to_pylist()
        for first, last in byte_slices(sizes):
            part = b.slice(first, last - first)
            read = [_read(x) for x in part.column(2).to_pylist()]
            of = lambda f, kind: pa.array([None if s is None else f(s) for s, _ in read], kind)  # noqa: B023, E731
            counts = [np.bincount(np.frombuffer(s.payload, np.uint8), minlength=256) if s else None for s, _ in read]
            sums = [pa.array([None if c is None else int(c @ np.arange(256) ** power) for c in counts], pa.int64()) for power in (1, 2)]
            columns = [of(lambda s: s.payload, pa.binary()), of(index_points, point), of(lambda s: s.continuity_errors, pa.int64()), of(lambda s: int(s.broken.sum()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns, *sums, pa.array([why for _, why in read], pa.string())], names)


def load(stored: DataFrame) -> DataFrame:
    """``stored`` (id, n_bytes, media) with what its media hold.

    That is: payload, random-access points, continuity errors, PES packets with
    missing data, sum and energy of the 8-bit samples, and ``problem``: why a row
    has none of these (null media, no packets, no tables, no stream).  Rows with
    null or repeated ids give a row each; other columns are not read; an empty
    table gives an empty result.
    """
    kind = stored.schema["id"].dataType.simpleString()
    found = f"id {kind}, n_bytes bigint, media binary, payload binary, points {POINTS}, continuity_errors bigint, broken_units bigint, sample_sum bigint, sample_energy bigint, problem string"
    return stored.select("id", "n_bytes", "media").mapInArrow(_load, found)
