"""Packet captures: a Spark data source for classic PCAP and PCAPNG files, and writers of one file or of one for each task.

    spark.dataSource.register(CaptureSource)
    spark.read.format("capture").load(path)

An index pass over record headers finds whole batches of BATCH_PACKETS packets, so partitions are runs of batches with
known ordinals and a damaged tail costs its batch alone.  A damaged capture still gives its whole batches; the failure is in
inspect().  Files are opened through pyarrow's file systems (local paths and URIs).
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import wire
from ..operators.decode import DECODED
from ..schemas import BATCH_PACKETS, MESSAGE_KEYS, PACKETS

#: First four bytes of classic captures: byte order and ticks per microsecond.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
PCAPNG = b"\x0a\x0d\x0d\x0a"
LINK_ETHERNET, RESERVED_LINK_BITS = 1, 0x0BFF0000
READ_BYTES, RUN = 4 << 20, 4096
#: Header of the little-endian microsecond captures written here.
HEAD = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262_144, LINK_ETHERNET)


class CaptureError(ValueError):
    pass


class NonMonotonicCaptureError(CaptureError):
    """Its text names the first regression; `reordercap` can put such a capture in order."""


@dataclass
class Batch:
    offset: int
    first: int
    packets: int
    max_ts: int
    state: tuple = ()


@dataclass
class Index:
    kind: str
    order: str = "<"
    ticks: int = 1
    batches: list[Batch] = field(default_factory=list)
    packets: int = 0
    regressions: int = 0
    sample: tuple | None = None
    failure: str | None = None


def _place(path: str):
    """(file system, path within it)"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_file(path: str):
    system, inner = _place(path)
    return system.open_input_file(inner)


def _create_file(path: str):
    system, inner = _place(path)
    return system.open_output_stream(inner, buffer_size=READ_BYTES)


class _Stream:
    """Sequential reading with a place."""

    def __init__(self, f, at: int = 0):
        self.f, self.at, self.held, self.from_ = f, at, b"", 0
        f.seek(at)

    def take(self, n: int) -> bytes:
        while len(self.held) - self.from_ < n:
            more = self.f.read(max(READ_BYTES, n))
            if not more:
                break
            self.held, self.from_ = self.held[self.from_ :] + more, 0
        out = self.held[self.from_ : self.from_ + n]
        self.from_ += len(out)
        self.at += len(out)
        return out


class Window(NamedTuple):
    """Whole records of a classic capture in one buffer.

    starts: places of the record headers and of what follows the last; at: place of the buffer in the file."""

    data: bytes
    starts: np.ndarray
    ts: np.ndarray
    at: int


def classic_windows(f, at: int, order: str, ticks: int) -> Iterator[Window]:
    """Records from a place on, in windows of about READ_BYTES; raises behind the last whole record if one is cut short."""
    unpack, end = struct.Struct(order + "I").unpack_from, f.size()
    word = np.dtype(order + "u4")
    wanted = READ_BYTES
    while at < end:
        if end - at < 16:
            raise CaptureError("a record header is cut short")
        f.seek(at)
        data = f.read(wanted)
        held, place, starts = len(data), 0, []
        while place + 16 <= held:
            starts.append(place)
            place += 16 + unpack(data, place + 8)[0]
        if place > held:  # the last record goes on behind the window
            size, place = place - starts[-1], starts.pop()
            if at + place + size > end:
                wanted = 0
            elif not starts:
                wanted = size
                continue
        if starts:
            starts = np.array([*starts, place], np.int64)
            head = np.frombuffer(data, np.uint8)[starts[:-1, None] + np.arange(8)].view(word).astype(np.int64)
            yield Window(data, starts, head[:, 0] * 1_000_000 + head[:, 1] // ticks, at)
        at += place
        if not wanted:
            raise CaptureError("a record is cut short")
        wanted = READ_BYTES


def check_link(field_: int) -> None:
    if field_ & RESERVED_LINK_BITS or field_ & 0xFFFF != LINK_ETHERNET:
        raise CaptureError(f"link type field {field_:#x} is not Ethernet")


def _resolution(options: bytes, order: str) -> tuple[int, int]:
    """(numerator, denominator) of a tick in microseconds."""
    at = 0
    while at + 4 <= len(options):
        code, n = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and n:
            v = options[at + 4]
            return (1_000_000, 1 << (v & 127)) if v & 128 else (1_000_000, 10**v)
        at += 4 + (n + 3) // 4 * 4
    return 1, 1


def pcapng_packets(s: _Stream, state: list | None = None) -> Iterator[tuple[int, bytes]]:
    """state: [byte order, interfaces as (link type, tick)], kept up to date for a later restart."""
    state = state if state is not None else ["<", []]
    while True:
        head = s.take(8)
        if not head:
            return
        if len(head) < 8:
            raise CaptureError("a block header is cut short")
        if head[:4] == PCAPNG:
            magic = s.take(4)
            order = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}.get(magic)
            if order is None:
                raise CaptureError("a section header has no byte-order magic")
            state[0], state[1] = order, []
            (size,) = struct.unpack(order + "I", head[4:])
            rest = size - 12
            body = b""
        else:
            order = state[0]
            (size,) = struct.unpack(order + "I", head[4:])
            rest, body = size - 8, None
        if size < 12 or size % 4:
            raise CaptureError("a block has an impossible length")
        data = s.take(rest)
        if len(data) < rest:
            raise CaptureError("a block is cut short")
        if body is not None:
            continue
        (kind,) = struct.unpack(order + "I", head[:4])
        data = data[:-4]
        if kind == 1:
            state[1] = [*state[1], (struct.unpack_from(order + "H", data)[0], _resolution(data[8:], order))]
        elif kind in (2, 6):
            if len(data) < 20:
                raise CaptureError("a packet block is cut short")
            if kind == 6:
                face, hi, lo, n, _ = struct.unpack_from(order + "5I", data)
            else:
                face, _, hi, lo, n, _ = struct.unpack_from(order + "HHIIII", data)
            if face >= len(state[1]):
                raise CaptureError(f"interface {face} is not described")
            link, (num, den) = state[1][face]
            if link != LINK_ETHERNET:
                raise CaptureError(f"link type {link} of interface {face} is not Ethernet")
            if len(data) < 20 + n:
                raise CaptureError("a packet is cut short")
            yield min((hi << 32 | lo) * num // den, (1 << 63) - 1), data[20 : 20 + n]
        elif kind == 3:
            raise CaptureError("a simple packet block has no timestamp")


def start(f) -> Index:
    magic = f.read(4)
    if magic in MAGICS:
        order, ticks = MAGICS[magic]
        head = f.read(20)
        if len(head) < 20:
            raise CaptureError("the file header is cut short")
        check_link(struct.unpack(order + "I", head[16:])[0])
        return Index("classic", order, ticks)
    if magic == PCAPNG:
        return Index("pcapng")
    raise CaptureError("not a capture: " + ("fewer than four bytes" if len(magic) < 4 else f"unknown magic {magic.hex()}"))


def _timed(f, index: Index, batch_packets: int) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    """Times of packets in runs, the places behind them, and the state there (a PCAPNG run ends where a batch does)."""
    if index.kind == "classic":
        for w in classic_windows(f, 24, index.order, index.ticks):
            yield w.ts, w.at + w.starts[1:], ("<", ())
        return
    state, s, seen, times, ends = ["<", []], _Stream(f), 0, [], []
    packets, failure = pcapng_packets(s, state), None
    while failure is None:
        try:
            ts, _ = next(packets)
            seen += 1
            times.append(ts)
            ends.append(s.at)
        except (StopIteration, CaptureError) as e:
            failure = e
        if times and (failure or seen % batch_packets == 0 or len(times) == RUN):
            yield np.array(times), np.array(ends), (state[0], tuple(state[1]))
            times, ends = [], []
    if isinstance(failure, CaptureError):
        raise failure


def inspect(path: str, batch_packets: int = BATCH_PACKETS, monotonic: bool = False) -> Index:
    """Whole batches, regressions of time against the packet before, and what ended the reading, if it did not end well."""
    with open_file(path) as f:
        index = start(f)
        at, held = 24 if index.kind == "classic" else 0, ("<", ())
        n, top, seen, before = 0, 0, 0, None
        regressions, sample = 0, None

        def close() -> None:
            index.batches.append(Batch(at, seen - n, n, top, held))
            index.packets, index.regressions, index.sample = seen, regressions, sample

        try:
            for times, ends, state in _timed(f, index, batch_packets):
                done = 0
                while done < len(times):
                    ts = times[done : done + batch_packets - n]
                    earlier = np.flatnonzero(np.diff(ts, prepend=ts[0] if before is None else before) < 0)
                    if len(earlier):
                        k = int(earlier[0])
                        first = (seen + k - 1, int(ts[k - 1]) if k else before, seen + k, int(ts[k]))
                        if monotonic:
                            raise NonMonotonicCaptureError(f"packet {first[2]} at {first[3]} us follows packet {first[0]} at {first[1]} us; put the capture in order with reordercap")
                        regressions, sample = regressions + len(earlier), sample or first
                    top = max(top, int(ts.max())) if n else int(ts.max())
                    before, n, seen, done = int(ts[-1]), n + len(ts), seen + len(ts), done + len(ts)
                    if n == batch_packets:
                        close()
                        at, n, held = int(ends[done - 1]), 0, state
        except NonMonotonicCaptureError:
            raise
        except CaptureError as e:
            index.failure = str(e)
            return index
        if n:
            close()
        return index


def as_option(found: dict[str, Index]) -> str:
    """The reader's option `index`: what inspect() found by path, so that planning need not read the captures again."""
    return json.dumps({path: asdict(index) for path, index in found.items()})


def _from_option(text: str) -> dict[str, Index]:
    return {path: Index(**x | {"batches": [Batch(**b) for b in x["batches"]]}) for path, x in json.loads(text).items()}


class _Part(InputPartition):
    """base: batches of the captures before this one, which come first in processing order; before: packets of the sections before this one."""

    def __init__(self, path: str, kind: str, order: str, ticks: int, batches: list[Batch], size: int, base: int = 0, before: int = 0):
        self.path, self.kind, self.order, self.ticks, self.batches, self.size, self.base, self.before = path, kind, order, ticks, batches, size, base, before


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.size = int(options.get("batchPackets", BATCH_PACKETS))
        self.per_partition = int(options.get("batchesPerPartition", 0))
        self.monotonic = options.get("monotonic", "false").lower() == "true"
        self.known = _from_option(options.get("index") or "{}")
        self.content = options.get("content", "packets")
        self.sections = options.get("sections", "false").lower() == "true"
        if not self.paths:
            raise CaptureError("no path")

    def partitions(self) -> list[InputPartition]:
        out, base, before = [], 0, 0
        for path in self.paths:
            index = self.known.get(path) or inspect(path, self.size, self.monotonic)
            # a small capture gives a partition a batch, a large one at least 64 partitions
            step = self.per_partition or max(1, min(64, len(index.batches) // 64))
            for k in range(0, len(index.batches), step):
                out.append(_Part(path, index.kind, index.order, index.ticks, index.batches[k : k + step], self.size, base, before))
            if not self.sections:
                base += len(index.batches)
            elif index.failure:
                raise CaptureError(f"{path}: {index.failure}; the sections behind it have no place")
            else:
                before += index.packets
        return out or [_Part("", "classic", "<", 1, [], self.size)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.batches:
            return
        names: dict[bytes, str] = {}
        ordinal, left = partition.before + partition.batches[0].first, sum(b.packets for b in partition.batches)
        with open_file(partition.path) as f:
            for ts, frames, skip in self._frames(f, partition, left):
                ordinals = np.arange(ordinal, ordinal + len(ts))
                ordinal += len(ts)
                keys = [ordinals, partition.base + ordinals // partition.size, ts]
                if self.content == "messages":
                    yield _messages(partition.path, keys, frames, skip, names)
                else:
                    buf, begin, size = wire.column(frames)
                    data = wire.cut(buf, begin + skip, size - skip, pa.binary())
                    yield pa.RecordBatch.from_arrays([_same(partition.path, len(ts)), *map(pa.array, keys), data], names=_names(PACKETS))

    def _frames(self, f, partition: _Part, left: int) -> Iterator[tuple[np.ndarray, pa.Array, int]]:
        """Times and frames of the partition's packets, and how many bytes of a header precede each frame."""
        first = partition.batches[0]
        if partition.kind == "classic":
            for w in classic_windows(f, first.offset, partition.order, partition.ticks):
                n = min(left, len(w.ts))
                left -= n
                yield w.ts[:n], pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(w.starts[: n + 1].astype(np.int32)), pa.py_buffer(w.data)]), 16
                if not left:
                    return
        packets = pcapng_packets(_Stream(f, first.offset), [first.state[0], list(first.state[1])])
        while left:
            got, size = [], 0
            while left and size < READ_BYTES:
                got.append(next(packets))
                size, left = size + len(got[-1][1]) + 1, left - 1
            yield np.array([t for t, _ in got]), pa.array([d for _, d in got], pa.binary()), 0


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _same(text: str, n: int) -> pa.Array:
    return pa.array([text]).take(pa.array(np.zeros(n, np.int64)))


def _messages(path: str, keys: list[np.ndarray], frames: pa.Array, skip: int, names: dict) -> pa.RecordBatch:
    """The decoded DNS messages of frames."""
    buf, begin, size = wire.column(frames)
    found = wire.dns_frames(buf, begin + skip, size - skip)
    row = found["row"]
    decoded = wire.decode_batch(buf, found["start"], found["size"], found["is_response"], names)
    cols = [_same(path, len(row)), *(pa.array(k[row]) for k in keys), *(pa.array(found[c]) for c in ("is_response", "client_ip", "client_port", "resolver_ip"))]
    return pa.RecordBatch.from_arrays([*cols, *decoded], names=[*_names(MESSAGE_KEYS), "outcome", "id", "questions", "rcode", "rcode_ctx"])


class CaptureSource(DataSource):
    """Format `capture`; options path, batchPackets, batchesPerPartition, monotonic, index, sections (true: the files are sections of one
    capture, whose ordinals and batches go on from file to file), and content: `packets`, or
    `messages` for the DNS messages in them, decoded (what decode_messages(dns_messages(packets)) gives, without the way
    of all payloads through the JVM)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return f"{MESSAGE_KEYS}, {DECODED}" if self.options.get("content") == "messages" else PACKETS

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options)


def write_classic(rows, path: str) -> int:
    """Writes (ts_us, bytes) pairs in their order as a little-endian microsecond capture; returns their number."""
    n = 0
    with _create_file(path) as f:
        f.write(HEAD)
        for ts, data in rows:
            f.write(struct.pack("<4I", ts // 1_000_000, ts % 1_000_000, len(data), len(data)) + bytes(data))
            n += 1
    return n


def _records(b: pa.RecordBatch) -> bytes:
    """Rows (ts_us, data) as records of a classic capture."""
    if b.column(0).null_count or b.column(1).null_count:
        raise CaptureError("a packet has no time or no bytes")
    ts = b.column(0).to_numpy()
    if ts.min() < 0 or ts.max() >= 1_000_000 << 32:
        raise CaptureError("a packet's time does not fit a capture")
    buf, _, size = wire.column(b.column(1))
    ends = np.cumsum(size + 16)
    out, body = np.zeros(ends[-1], np.uint8), np.ones(ends[-1], bool)
    heads = (ends - size - 16)[:, None] + np.arange(16)
    out[heads] = np.stack([ts // 1_000_000, ts % 1_000_000, size, size], axis=1).astype("<u4").view(np.uint8)
    body[heads] = False
    out[body] = buf[: size.sum()]
    return out.tobytes()


def write_sections(packets: DataFrame, folder: str) -> dict[str, Index]:
    """Writes packets (ts_us, data) in the order they are in as sections of a capture, each partition its own in a new folder
    that the driver and all executors see; returns their indexes by path, in order.  No packet passes through the driver."""
    system, inner = _place(folder)
    system.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = f"{folder}/{uuid.uuid4().hex}.pcap", None  # a task that runs again writes another file
        try:
            for b in batches:
                if b.num_rows:
                    if f is None:
                        f = _create_file(path)
                        f.write(HEAD)
                    f.write(_records(b))
        finally:
            if f is not None:
                f.close()
        if f is not None:
            yield pa.RecordBatch.from_arrays([pa.array([as_option({path: inspect(path)})])], names=["found"])

    found: dict[str, Index] = {}
    for r in packets.select("ts_us", "data").mapInArrow(run, "found string").collect():  # in the order of the partitions
        found |= _from_option(r.found)
    if not found:
        write_classic((), f"{folder}/none.pcap")
        found[f"{folder}/none.pcap"] = inspect(f"{folder}/none.pcap")
    return found
