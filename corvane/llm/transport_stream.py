"""Media columns: MPEG transport streams (ISO/IEC 13818-1), written and read.

``write_streams`` stores bytes as one program with one private elementary stream:
program association and map tables, packetised units with presentation times,
each unit a random-access point with a clock reference.  ``read_streams`` parses
any stream column: it finds packet sync, checks table checksums, follows the
tables to the elementary streams, checks continuity counters, drops duplicate
packets, reassembles elementary packets and lists their times and random-access
points.  A stream is a row's value and is parsed as a whole by NumPy over its
packets; rows are independent, so nothing is shuffled.

Defined results: null or empty media has no packets, no tables, no units and an
empty payload; bytes outside packets count as lost sync; a unit that misses a
packet is marked damaged and its bytes so far are kept; repeated rows get equal
results; an empty table gives an empty result.  Only the id and the media column
are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

# Fixed values of the format.
PACKET, SYNC, PAT_PID, PMT_PID, MEDIA_PID, NULL_PID = 188, 0x47, 0, 0x1000, 0x0100, 0x1FFF
PRIVATE_TYPE, PRIVATE_ID = 0x06, 0xBD
NO_HEADER_IDS = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}
#: Bytes of media in a unit, and ticks of the 90 kHz clock between units.
UNIT_BYTES, UNIT_TICKS, FIRST_TICKS = 4032, 3600, 90_000
ALIGN, FILL = 192, 32


def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        v = b << 24
        for _ in range(8):
            v = ((v << 1) ^ 0x04C11DB7 if v & 0x80000000 else v << 1) & 0xFFFFFFFF
        table.append(v)
    return table


CRC_TABLE = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of table sections; over a whole section with its CRC it is 0."""
    v = 0xFFFFFFFF
    for b in data:
        v = ((v << 8) & 0xFFFFFFFF) ^ CRC_TABLE[(v >> 24) ^ b]
    return v


def _table_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    section = head + section_crc(head).to_bytes(4, "big")
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, 0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])) + _table_packet(
    PMT_PID, 2, 1, bytes([0xE0 | MEDIA_PID >> 8, MEDIA_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 255, 0xF0, 0])
)


def _stamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | (t >> 29 & 14) | 1, t >> 22 & 255, (t >> 14 & 254) | 1, t >> 7 & 255, (t << 1 & 254) | 1])


def write_stream(media: bytes) -> bytes:
    """One program, one stream of units of UNIT_BYTES."""
    out, counter = [TABLES], 0
    for n, start in enumerate(range(0, len(media), UNIT_BYTES)):
        data, time = media[start : start + UNIT_BYTES], FIRST_TICKS + n * UNIT_TICKS
        unit = b"\x00\x00\x01" + bytes([PRIVATE_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(2, time) + data
        first = min(len(unit), 176)
        rest = len(unit) - first
        k = 1 + -(-rest // 184)
        p = np.zeros((k, PACKET), np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255
        p[0, 1] |= 0x40
        p[:, 3] = 0x10 | (counter + np.arange(k)) & 15
        counter = (counter + k) & 15
        clock = time - UNIT_TICKS
        p[0, 3] |= 0x20
        p[0, 4:12] = np.frombuffer(bytes([183 - first, 0x50, *(clock << 15 | 0x7E00).to_bytes(6, "big")]), np.uint8)
        p[0, 12 : PACKET - first] = 0xFF
        bytes_of = np.frombuffer(unit, np.uint8)
        p[0, PACKET - first :] = bytes_of[:first]
        full = rest // 184
        if full:
            p[1 : 1 + full, 4:] = bytes_of[first : first + full * 184].reshape(full, 184)
        if last := rest - full * 184:
            fill = 184 - last
            p[-1, 3] |= 0x20
            p[-1, 4] = fill - 1
            p[-1, 5 : 4 + fill] = 0xFF
            if fill > 1:
                p[-1, 5] = 0
            p[-1, PACKET - last :] = bytes_of[-last:]
        out.append(p.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What a stream holds."""

    n_packets: int = 0
    lost_bytes: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    crc_errors: int = 0
    programs: list[dict] = field(default_factory=list)
    units: list[dict] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)
    payload: bytes = b""


def _packets(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Packets with sync, their byte offsets, and the bytes outside them.

    The places of sync bytes are found once, and the other places once for each
    offset from a packet's start, so that many losses cost no more than few.
    """
    raw = np.frombuffer(data, np.uint8)
    found, at = [], []
    pos, pairs, others = 0, None, {}
    while pos + PACKET <= len(raw):
        n, offset = (len(raw) - pos) // PACKET, pos % PACKET
        if offset not in others:
            others[offset] = np.flatnonzero(raw[offset::PACKET] != SYNC) * PACKET + offset
        i = int(np.searchsorted(others[offset], pos))
        run = min(n, (int(others[offset][i]) - pos) // PACKET) if i < len(others[offset]) else n
        if run and not (run == 1 and pos + 2 * PACKET <= len(raw) and found and run < n):
            found.append(raw[pos : pos + run * PACKET].reshape(run, PACKET))
            at.append(pos + PACKET * np.arange(run))
            pos += run * PACKET
        else:
            pos += 1
        if pos + PACKET > len(raw):
            break
        if raw[pos] != SYNC:  # look for two sync bytes a packet apart
            if pairs is None:
                later = np.flatnonzero(raw == SYNC)
                pairs = later[((later + PACKET >= len(raw)) | (raw[np.minimum(later + PACKET, len(raw) - 1)] == SYNC)) & (later + PACKET <= len(raw))]
            i = int(np.searchsorted(pairs, pos))
            if i == len(pairs):
                break
            pos = int(pairs[i])
    packets = np.concatenate(found) if found else np.zeros((0, PACKET), np.uint8)
    return packets, np.concatenate(at) if at else np.zeros(0, np.int64), len(raw) - packets.size


def _sections(parts: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Whole sections from the payloads of one PID."""
    held: bytes | None = None
    for start, payload in parts:
        if start and payload:
            skip = payload[0]
            if held is not None:
                held += payload[1 : 1 + skip]
                yield from _cut(held)
            held = payload[1 + skip :]
        elif held is not None:
            held += payload
    if held:
        yield from _cut(held)


def _cut(held: bytes) -> Iterator[bytes]:
    while len(held) >= 3 and held[0] != 0xFF:
        size = 3 + ((held[1] & 15) << 8 | held[2])
        if len(held) < size:
            return
        yield held[:size]
        held = held[size:]


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def read_stream(data: bytes) -> Stream:
    s = Stream()
    p, at, s.lost_bytes = _packets(data)
    s.n_packets = len(p)
    if not len(p):
        return s
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    start, has = (p[:, 1] & 0x40) > 0, (p[:, 3] & 0x10) > 0
    adapts, counter = (p[:, 3] & 0x20) > 0, (p[:, 3] & 15).astype(np.int32)
    usable = ((p[:, 1] & 0x80) == 0) & ((p[:, 3] & 0xC0) == 0) & (pid != NULL_PID)
    flags = np.where(adapts & (p[:, 4] > 0), p[:, 5], 0)
    begin = np.where(adapts, 5 + p[:, 4].astype(np.int32), 4)
    has &= usable & (begin < PACKET)
    for i in np.flatnonzero((flags & 0x10) > 0).tolist():
        c = int.from_bytes(p[i, 6:12].tobytes(), "big")
        s.clocks.append((c >> 15) * 300 + (c & 511))
    # Continuity: among the packets of a PID that carry payload, in order.
    broken, repeat = np.zeros(len(p), bool), np.zeros(len(p), bool)
    rows = np.flatnonzero(has)
    rows = rows[np.argsort(pid[rows], kind="stable")]
    if len(rows) > 1:
        a, b = rows[:-1], rows[1:]
        same = pid[a] == pid[b]
        step = (counter[b] - counter[a]) & 15
        twin = same & (step == 0)
        twin[twin] = (p[a[twin], 4:] == p[b[twin], 4:]).all(1)
        repeat[b[twin]] = True
        broken[b[same & (step != 1) & ~twin & ((flags[b] & 0x80) == 0)]] = True
    s.duplicates, s.continuity_errors = int(repeat.sum()), int(broken.sum())
    keep = has & ~repeat

    def parts(wanted: int) -> list[tuple[bool, bytes]]:
        return [(bool(start[i]), p[i, begin[i] :].tobytes()) for i in np.flatnonzero(keep & (pid == wanted)).tolist()]

    def good(wanted: int, table: int) -> Iterator[bytes]:
        for x in _sections(parts(wanted)):
            if x[0] == table and len(x) >= 12:
                if section_crc(x):
                    s.crc_errors += 1
                else:
                    yield x

    maps = {}
    for x in good(PAT_PID, 0):
        for i in range(8, len(x) - 4, 4):
            if number := x[i] << 8 | x[i + 1]:
                maps[number] = (x[i + 2] & 31) << 8 | x[i + 3]
    media: list[int] = []
    for number, where in sorted(maps.items()):
        streams, clock = {}, None
        for x in good(where, 2):
            if x[3] << 8 | x[4] != number:
                continue
            clock = (x[8] & 31) << 8 | x[9]
            i = 12 + ((x[10] & 15) << 8 | x[11])
            while i + 5 <= len(x) - 4:
                streams[(x[i + 1] & 31) << 8 | x[i + 2]] = x[i]
                i += 5 + ((x[i + 3] & 15) << 8 | x[i + 4])
        s.programs.append({"program": number, "map_pid": where, "clock_pid": clock, "streams": [{"pid": k, "kind": v} for k, v in sorted(streams.items())]})
        media += [k for k in sorted(streams) if k not in media]
    payload = []
    for wanted in media:
        rows = np.flatnonzero(keep & (pid == wanted))
        firsts = np.flatnonzero(start[rows])
        for a, b in zip(firsts, [*firsts[1:], len(rows)][: len(firsts)], strict=True):
            of = rows[a:b]
            whole = begin[of] == 4
            if b - a > 2 and whole[1:-1].all():  # all between the first and last are full
                raw = p[of[0], begin[of[0]] :].tobytes() + p[of[1:-1], 4:].tobytes() + p[of[-1], begin[of[-1]] :].tobytes()
            else:
                raw = b"".join(p[i, begin[i] :].tobytes() for i in of.tolist())
            unit = {"pid": wanted, "stream_id": None, "pts": None, "dts": None, "random_access": bool(flags[of[0]] & 0x40), "at": int(at[of[0]]), "n_bytes": 0, "damaged": bool(broken[of[1:]].any())}
            if len(raw) < 6 or raw[:3] != b"\x00\x00\x01":
                s.units.append(unit | {"damaged": True})
                continue
            size, body = raw[4] << 8 | raw[5], raw[6:]
            if size:
                unit["damaged"] |= len(body) < size
                body = body[:size]
            unit["stream_id"] = raw[3]
            if raw[3] not in NO_HEADER_IDS:
                if len(body) < 3 or len(body) < 3 + body[2]:
                    s.units.append(unit | {"damaged": True})
                    continue
                if body[1] & 0x80 and body[2] >= 5:
                    unit["pts"] = _time(body[3:8])
                if body[1] & 0xC0 == 0xC0 and body[2] >= 10:
                    unit["dts"] = _time(body[8:13])
                body = body[3 + body[2] :]
            unit["n_bytes"] = len(body)
            s.units.append(unit)
            payload.append(body)
    s.payload = b"".join(payload)
    return s


def padded(text: bytes) -> bytes:
    return text.ljust(max(ALIGN, -(-len(text) // ALIGN) * ALIGN), bytes([FILL]))


def write_streams(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (of the text), media (the stream that stores the padded text)."""
    narrow = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1):
            media = [write_stream(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["k", "n_bytes", "media"])

    made = narrow.mapInArrow(run, f"k {narrow.schema['k'].dataType.simpleString()}, n_bytes long, media binary")
    return made.withColumnRenamed("k", id_col)


UNIT = "struct<pid:int,stream_id:int,pts:bigint,dts:bigint,random_access:boolean,at:bigint,n_bytes:bigint,damaged:boolean>"
PROGRAM = "struct<program:int,map_pid:int,clock_pid:int,streams:array<struct<pid:int,kind:int>>>"
UNIT_TYPE = pa.struct([("pid", pa.int32()), ("stream_id", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("at", pa.int64()), ("n_bytes", pa.int64()), ("damaged", pa.bool_())])
PROGRAM_TYPE = pa.struct([("program", pa.int32()), ("map_pid", pa.int32()), ("clock_pid", pa.int32()), ("streams", pa.list_(pa.struct([("pid", pa.int32()), ("kind", pa.int32())])))])


def read_streams(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns ``keep``, then packets, errors, programs, units, clocks and payload."""
    narrow = df.select(F.col(media_col).alias("m"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kept = [f"k{i}" for i in range(len(keep))]
    counts = ["n_packets", "lost_bytes", "continuity_errors", "duplicates", "crc_errors"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, media in slices(batches, 0):
            read = [read_stream(m) for m in media]
            arrays = [part.column(1 + i) for i in range(len(kept))]
            arrays += [pa.array([getattr(s, c) for s in read], pa.int64()) for c in counts]
            arrays += [pa.array([s.programs for s in read], pa.list_(PROGRAM_TYPE)), pa.array([s.units for s in read], pa.list_(UNIT_TYPE)), pa.array([s.clocks for s in read], pa.list_(pa.int64())), pa.array([s.payload for s in read], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *counts, "programs", "units", "clocks", "payload"])

    types = [f"{k} {narrow.schema[k].dataType.simpleString()}" for k in kept] + [f"{c} long" for c in counts]
    made = narrow.mapInArrow(run, ", ".join([*types, f"programs array<{PROGRAM}>, units array<{UNIT}>, clocks array<bigint>, payload binary"]))
    return made.toDF(*keep, *made.columns[len(keep) :])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = write_streams(documents(spark, sf_dir)).withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    read = read_streams(stored, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    accessible = F.filter("units", lambda u: u["random_access"])
    feature = F.concat_ws(
        ";", F.concat(F.lit("packets="), F.col("n_packets")), F.concat(F.lit("programs="), F.size("programs")), F.concat(F.lit("units="), F.size("units")), F.concat(F.lit("random_access="), F.size(accessible)),
        F.concat(F.lit("first_pts="), F.get("units", F.lit(0))["pts"]), F.concat(F.lit("last_pts="), F.element_at("units", -1)["pts"]), F.concat(F.lit("last_clock="), F.element_at("clocks", -1)),
        F.concat(F.lit("errors="), F.col("continuity_errors") + F.col("crc_errors") + F.col("lost_bytes")),
    )
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )
