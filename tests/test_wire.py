"""The vectorised decoder against the general one, and the frame rules in NumPy against those in expressions."""

import random

import numpy as np
import pyarrow as pa
from test_capture import classic, put
from test_decode import A, EX, NS, message, opt, tsig

from nameflow.operators import decode, encode, frames, wire
from nameflow.plans.run import packets
from nameflow.sources import pcap


def samples(n=4000, seed=5):
    """Messages of plain and odd names, of several questions, with additional records, and with bytes changed or cut off."""
    rng = random.Random(seed)
    names = [EX, b"\0", b"\x01a\0", b"\x03-ab\0", b"\x03a-b\x02cd\0", b"\x02*a\0", b"\x03a.b\0", b"\x01_\0", b"\xc0\x0c", (b"\x3f" + b"x" * 63) * 3 + b"\x3d" + b"y" * 61 + b"\0", (b"\x3f" + b"x" * 63) * 4 + b"\0", b"\x01a" * 127 + b"\0"]
    for _ in range(n):
        asked = [(rng.choice(names), rng.choice((1, 28, 65535))) for _ in range(rng.choice((0, 1, 1, 1, 1, 2)))]
        more = rng.choice(([], [], [opt(1)], [tsig(16)]))
        m = bytearray(message(*asked, flags=rng.choice((0x0100, 0x8183)), counts=(0, 0, len(more)), rest=b"".join(more)))
        for _ in range(rng.choice((0, 0, 0, 1, 3))):
            m[rng.randrange(len(m))] = rng.randrange(256)
        yield bytes(m[: rng.choice((len(m), len(m), len(m), rng.randrange(len(m) + 1)))]), rng.random() < 0.5


def general(m, response):
    try:
        ident, found, code, context = decode.decode(m, response)
    except decode.Oversized:
        return decode.OVERSIZED, None, None, None, None
    except decode.Malformed:
        return decode.INVALID, None, None, None, None
    return decode.RECORDS, ident, [{"name": n, "qtype": t} for n, t in found], code if response else None, context if response else None


def test_messages_as_one_by_one():
    rows = list(samples())
    data = pa.array([m for m, _ in rows], pa.binary())
    want = [general(m, r) for m, r in rows]
    kinds = [k for k, *_ in want]
    assert min(kinds.count(k) for k in (decode.RECORDS, decode.OVERSIZED, decode.INVALID)) > 50
    for first, last in ((0, len(rows)), (7, 8), (1000, 1003), (5, 5)):
        part = data.slice(first, last - first)
        got = wire.decode_batch(*wire.column(part), np.array([r for _, r in rows[first:last]], bool), {})
        assert list(zip(*(c.to_pylist() for c in got), strict=True)) == want[first:last]


def test_most_messages_take_the_short_way(monkeypatch):
    monkeypatch.setattr(decode, "decode", None)
    data = pa.array([message((EX, 1)), message((b"\x01a\x02-b"[:2] + b"\x02b-\0", 28))], pa.binary())
    got = wire.decode_batch(*wire.column(data), np.array([True, False]), {})
    assert got[2].to_pylist() == [[{"name": "example.com", "qtype": 1}], [{"name": "a.b-", "qtype": 28}]]


def test_frames_as_in_expressions(spark, tmp_path):
    """Frames with bytes changed or cut off, of both versions, through the reader and through the plan."""
    rng = random.Random(8)
    good = [encode.frame(A, NS, 53000, 53, message((EX, 1))), encode.frame(NS, A, 53, 53000, message((EX, 1), flags=0x8180))]
    good += [bytes(12) + b"\x86\xdd" + b"\x60\0\0\0" + bytes([0, len(g) - 34, 17, 64]) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + g[34:] for g in good]
    rows = []
    for k in range(3000):
        f = bytearray(rng.choice(good))
        for _ in range(rng.choice((0, 1, 1, 2))):
            f[rng.randrange(12, 60)] = rng.choice((0, 1, 5, 17, 53, 0x45, 0x46, 0x60, rng.randrange(256)))
        rows.append((k * 10, bytes(f[: rng.choice((len(f), len(f), rng.randrange(len(f) + 1)))] + bytes(rng.choice((0, 0, 9))))))
    path = put(tmp_path, classic(rows))
    there = decode.decode_messages(frames.dns_messages(packets(spark, path, 700)))
    here = packets(spark, path, 700, content="messages")
    assert here.schema.simpleString() == there.schema.simpleString()
    got, want = ({r.packet_ordinal: tuple(r) for r in df.collect()} for df in (here, there))
    assert got == want and 1000 < len(got) < 2900


def test_windows_of_any_size(tmp_path, monkeypatch):
    """Records that do not fit a window, that end at one's edge, and a record or header cut short behind whole ones."""
    rng = random.Random(3)
    rows = [(k, bytes(rng.randrange(200))) for k in range(300)]
    data = classic(rows)
    for size in (16, 17, 64, 100, 1000, 1 << 20):
        monkeypatch.setattr(pcap, "READ_BYTES", size)
        for tail, failure in ((b"", None), (b"abc", "header"), (b"\0" * 8 + b"\x05\0\0\0" * 2 + b"abc", "record")):
            index = pcap.inspect(put(tmp_path, data + tail), 64)
            assert (index.failure is None) if failure is None else failure in index.failure
            assert [b.packets for b in index.batches] == [64] * 4 + [44] * (failure is None)
            ends = np.cumsum([24] + [16 + len(d) for _, d in rows])
            assert [b.offset for b in index.batches] == ends[::64][: len(index.batches)].tolist()
