"""MPEG transport streams: payloads as 8-bit samples in packetized elementary packets.

`mux` writes a program association table, a program map table and one elementary stream: packets of
`PES_BYTES` samples with a presentation time (90 kHz clock, 8000 samples a second), a clock reference
and the random-access flag on every `ACCESS`-th, before which both tables stand again, so that `tail` reads
from there on without what comes before. `demux` knows nothing of what was written: it parses
the program tables (and their checksums), follows the continuity counter of each packet id, takes
adaptation fields off, reassembles the elementary packets and reads times and random-access points.

Defined cases: null text is empty; an empty payload becomes one block of padding; a stream that is
no multiple of 188 bytes, lacks a sync byte, or has no program is an error; a break in the
continuity counter is counted, not hidden; equal payloads give equal streams, so there are no ties; a
long text is one stream, up to the 2 GB of a cell; an empty table gives an empty result; other columns are kept
by `mux_column` and `demux_column` and never read.
"""

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._work import Workspace, read, tidy

BLOCK = 576
STORED = 256  # streams in one batch on their way to the files
PACKET = 188
PES_BYTES = 16 * BLOCK
ACCESS = 8
PMT_PID, DATA_PID = 0x100, 0x101
STREAM_TYPE, STREAM_ID, PROGRAM = 0x06, 0xBD, 1
TICKS = 90_000 / 8_000


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


ASSOCIATION = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
MAP = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _tables(turn: int) -> bytes:
    return b"".join((bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10 | turn & 15, 0]) + section).ljust(PACKET, b"\xff") for pid, section in ((0, ASSOCIATION), (PMT_PID, MAP)))


def _time(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A whole transport stream of one program."""
    out, counter = [] if payload else [_tables(0)], 0
    for k, low in enumerate(range(0, len(payload), PES_BYTES)):
        data = payload[low : low + PES_BYTES]
        ticks = int(low * TICKS) & ((1 << 33) - 1)
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(ticks) + data
        first = bytes([7, 0x50 if k % ACCESS == 0 else 0x10]) + (ticks << 15 | 0x7E00).to_bytes(6, "big")
        body = np.frombuffer(pes, np.uint8)
        room = PACKET - 4 - len(first)
        rest = max(0, len(body) - room)
        n = 1 + -(-rest // (PACKET - 4))
        if k % ACCESS == 0:
            out.append(_tables(k // ACCESS))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        counter = (counter + n) & 15
        packets[0, 3] |= 0x20
        own = body[:room]
        spare = room - len(own)
        packets[0, 4 : 4 + len(first)] = np.frombuffer(first, np.uint8)
        packets[0, 4] += spare  # stuffing
        packets[0, PACKET - len(own) :] = own
        full = rest // (PACKET - 4)
        packets[1 : 1 + full, 4:] = body[room : room + full * (PACKET - 4)].reshape(full, PACKET - 4)
        if last := rest - full * (PACKET - 4):
            stuff = PACKET - 4 - last
            packets[-1, 3] |= 0x20
            packets[-1, 4] = stuff - 1
            if stuff > 1:
                packets[-1, 5] = 0
            packets[-1, 4 + stuff :] = body[len(body) - last :]
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    data: bytes = b""
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program to the id of its map
    streams: dict[int, int] = field(default_factory=dict)  # packet id to stream type
    breaks: int = 0
    times: list[int] = field(default_factory=list)  # of each elementary packet
    access: list[int] = field(default_factory=list)  # indices of those that can be started from
    starts: list[int] = field(default_factory=list)  # packet numbers of the tables before them

    def feature(self) -> str:
        span = f"{self.times[0]}-{self.times[-1]}" if self.times else "-"
        kinds = ",".join(f"{pid:x}:{kind:x}" for pid, kind in sorted(self.streams.items()))
        return f"packets={self.packets};programs={len(self.programs)};streams={kinds};pes={len(self.times)};pts={span};access={len(self.access)};breaks={self.breaks}"


def _parse_section(packet: bytes, table: int) -> bytes:
    at = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
    at += 1 + packet[at]
    size = 3 + ((packet[at + 1] & 0x0F) << 8 | packet[at + 2])
    section = packet[at : at + size]
    if section[0] != table or crc32_mpeg(section):
        raise ValueError("damaged program table")
    return section[8:-4]


def demux(media: bytes) -> Stream:
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("sync byte lost")
    out = Stream(packets=len(p))
    pids = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    begins = (p[:, 1] & 0x40) > 0
    tables = np.flatnonzero((pids == 0) & begins)
    if not len(tables):
        raise ValueError("no program association table")
    body = _parse_section(p[tables[0]].tobytes(), 0)
    out.programs = {body[i] << 8 | body[i + 1]: (body[i + 2] & 0x1F) << 8 | body[i + 3] for i in range(0, len(body), 4) if body[i] << 8 | body[i + 1]}
    for pid in out.programs.values():
        body = _parse_section(p[np.flatnonzero((pids == pid) & begins)[0]].tobytes(), 2)
        at = 4 + ((body[2] & 0x0F) << 8 | body[3])
        while at < len(body):
            out.streams[(body[at + 1] & 0x1F) << 8 | body[at + 2]] = body[at]
            at += 5 + ((body[at + 3] & 0x0F) << 8 | body[at + 4])
    parts = []
    for pid in sorted(out.streams):
        spots = np.flatnonzero(pids == pid)
        own = p[spots]
        if not len(own):
            continue
        holds = (own[:, 3] & 0x10) > 0
        count = own[:, 3] & 15
        out.breaks += int(((count[1:] - count[:-1] - holds[1:]) & 15 != 0).sum())
        field_on = (own[:, 3] & 0x20) > 0
        skip = 4 + np.where(field_on, 1 + own[:, 4].astype(np.int64), 0)
        skip[~holds] = PACKET
        data = own[np.arange(PACKET)[None, :] >= skip[:, None]]
        ends = np.cumsum(PACKET - skip)
        first = np.flatnonzero((own[:, 1] & 0x40) > 0)
        starts = ends[first] - (PACKET - skip[first])
        flags = np.where(field_on & (own[:, 4] > 0), own[:, 5], 0)
        for k, (low, high) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(data)], strict=True)):
            head = data[low : low + 14].tobytes()
            if head[:3] != b"\x00\x00\x01":
                raise ValueError("damaged elementary packet")
            size = head[4] << 8 | head[5]
            if head[7] & 0x80:
                t = head[9:14]
                out.times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
            if flags[first[k]] & 0x40:
                out.access.append(k)
                out.starts.append(int(tables[np.searchsorted(tables, spots[first[k]]) - 1]))
            parts.append(data[low + 9 + head[8] : min(high, low + 6 + size) if size else high])
    out.data = np.concatenate(parts).tobytes() if parts else b""
    return out


def tail(media: bytes, stream: Stream, point: int) -> Stream:
    """What can be read from a random-access point on, from the bytes there alone."""
    return demux(media[stream.starts[point] * PACKET :])


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % BLOCK if text else BLOCK)


def mux_column(df: DataFrame, payload: str, into: str) -> DataFrame:
    """Adds a binary column with the stream of each payload (nulls stay null)."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else mux(payload_of(bytes(x))))

    return df.withColumn(into, pandas_udf(run, "binary")(F.col(payload)))


def demux_column(df: DataFrame, media: str, into: str) -> DataFrame:
    """Adds a struct: data, packets, breaks, times, access."""

    def run(s: pd.Series) -> pd.DataFrame:
        got = [Stream() if x is None else demux(bytes(x)) for x in s]
        return pd.DataFrame({"data": [g.data for g in got], "packets": [g.packets for g in got], "breaks": [g.breaks for g in got], "times": [g.times for g in got], "access": [g.access for g in got]})

    return df.withColumn(into, pandas_udf(run, "data binary, packets int, breaks int, times array<long>, access array<int>")(F.col(media)))


def store(docs: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, n_bytes, media): the streams as written and read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, STORED):
                texts = [x.as_py() or b"" for x in batch.column(1).slice(low, STORED)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, STORED), pa.array(map(len, texts), pa.int64()), pa.array([mux(payload_of(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return work.save(slim.mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary"), "streams", "zstd")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: its stream is written, read back from the files, and described."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(2):
                media = x.as_py()
                back = demux(media)
                rows.append((len(back.data), hashlib.sha256(back.data).hexdigest(), zlib.crc32(back.data[-32:]), len(media), hashlib.sha256(media).hexdigest(), back.feature()))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    streams = store(docs, Workspace(docs.sparkSession, "media"))
    return streams.mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
