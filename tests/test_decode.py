"""Frames and messages, fixture by fixture."""

import struct

import pytest

from nameflow.operators import encode
from nameflow.operators.decode import Malformed, Oversized, decode, decode_messages, events
from nameflow.operators.frames import dns_messages

A, NS = bytes([10, 0, 0, 1]), bytes([8, 8, 8, 8])


def name(*labels):
    return b"".join(bytes([len(s)]) + s for s in labels) + b"\0"


EX = name(b"example", b"com")


def message(*questions, flags=0x0100, counts=(0, 0, 0), rest=b""):
    return struct.pack(">6H", 0x1234, flags, len(questions), *counts) + b"".join(q + struct.pack(">HH", t, 1) for q, t in questions) + rest


def rr(owner, kind, ttl=0, data=b"", cls=1):
    return owner + struct.pack(">HHIH", kind, cls, ttl, len(data)) + data


def tsig(error):
    return rr(name(b"key"), 250, 0, name(b"hmac") + b"\0" * 8 + struct.pack(">H", 0) + struct.pack(">HHH", 1, error, 0), 255)


def opt(high):
    return rr(b"\0", 41, high << 24)


def test_questions():
    two = message((EX, 1), (b"\x03www\xc0\x0c", 28))
    assert decode(two, False)[1] == [("example.com", 1), ("www.example.com", 28)]
    assert decode(two, True)[1] == [("example.com", 1)]
    assert decode(message(), False)[1] == []
    assert decode(message((EX, 1), flags=0x8183), True)[2:] == (3, "Header")


@pytest.mark.parametrize(("labels", "want"), [
    ((b"WWW", b"example", b"COM"), "WWW.example.COM"), ((), "."), ((b"*", b"example", b"com"), "*.example.com"), ((b"_sip", b"_tcp"), "_sip._tcp"), ((b"a-b",), "a-b"), ((b"-a",), "\\-a"),
    ((b"bad.char",), "bad\\.char"), ((b"exa*mple",), "exa\\*mple"), ((b"\x01",), "\\001"), (("täst".encode(),), "t\\303\\244st"),
])
def test_presentation(labels, want):
    assert decode(message((name(*labels), 1)), False)[1] == [(want, 1)]


def test_name_limits():
    long = [b"\x01" * 63] * 3
    assert len(decode(message((name(*long, b"\x01" * 61), 1)), False)[1][0][0]) == 1003
    with pytest.raises(Oversized):
        decode(message((name(*long, b"\x01" * 62), 1)), False)
    with pytest.raises(Malformed):
        decode(message((b"\x05ab", 1)), False)
    for pointer in (b"\xc0\x0c", b"\xc0\x40"):  # to itself, and forwards
        with pytest.raises(Malformed):
            decode(message((pointer, 1)), False)
    with pytest.raises(Malformed):
        decode(message((EX, 1), (b"\x05ab", 1)), False)


@pytest.mark.parametrize(("more", "want"), [([opt(1)], (16, "EdnsOpt")), ([tsig(16)], (16, "Tsig")), ([opt(1), tsig(0)], (16, "EdnsOpt")), ([opt(1), tsig(16)], (16, "Tsig"))])
def test_extended_codes(more, want):
    assert decode(message((EX, 1), flags=0x8180, counts=(0, 0, len(more)), rest=b"".join(more)), True)[2:] == want


def test_extended_code_of_both():
    assert decode(message((EX, 1), flags=0x8183, counts=(0, 0, 1), rest=opt(2)), True)[2:] == (35, "EdnsOpt")


@pytest.mark.parametrize("more", [[opt(0), opt(0)], [rr(EX, 41)], [tsig(0), opt(0)], [tsig(0), tsig(0)], [rr(EX, 250)], []])
def test_rejected_additionals(more):
    bad = message((EX, 1), flags=0x8180, counts=(0, 0, max(1, len(more))), rest=b"".join(more))
    with pytest.raises(Malformed):
        decode(bad, True)
    assert decode(bad, False)[1] == [("example.com", 1)]  # queries are not read that far


def edited(at, value, frame=None):
    f = bytearray(frame or encode.frame(A, NS, 53000, 53, message((EX, 1))))
    f[at : at + len(value)] = value
    return bytes(f)


def test_frames(spark):
    good = encode.frame(A, NS, 53000, 53, message((EX, 1)))
    back = encode.frame(NS, A, 53, 53000, message((EX, 1), flags=0x8180))
    total = struct.unpack(">H", good[16:18])[0]
    v6 = bytes(12) + b"\x86\xdd" + b"\x60\0\0\0" + struct.pack(">HBB", len(good) - 34, 17, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + good[34:]
    cases = {
        "query": (good, 1), "response": (back, 1), "padded": (good + bytes(32), 1), "v6": (v6, 1), "v6 short": (edited(18, struct.pack(">H", 8), v6), 0), "port": (edited(36, struct.pack(">H", 123)), 0),
        "total 28": (edited(16, struct.pack(">H", 28)), 0), "total 19": (edited(16, struct.pack(">H", 19)), 0), "total too long": (edited(16, struct.pack(">H", total + 1)), 0), "udp 7": (edited(38, struct.pack(">H", 7)), 0),
        "udp too long": (edited(38, struct.pack(">H", total - 19)), 0), "udp 20": (edited(38, struct.pack(">H", 20)), 1), "fragment": (edited(20, b"\x20\0"), 0), "offset": (edited(20, b"\0\x01"), 0), "tcp": (edited(23, b"\x06"), 0), "vlan": (edited(12, b"\x81\0"), 0), "tiny": (b"abc", 0), "empty": (b"", 0),
    }
    df = spark.createDataFrame([(k, i, 0, 0, bytearray(d)) for i, (k, (d, _)) in enumerate(cases.items())], "case string, packet_ordinal long, batch_id long, ts_us long, data binary")
    got = {r.case: r for r in dns_messages(df).collect()}
    assert {k: int(k in got) for k in cases} == {k: n for k, (_, n) in cases.items()}
    for k in ("query", "response"):
        assert (bytes(got[k].client_ip), got[k].client_port, bytes(got[k].resolver_ip)) == (A, 53000, NS)
    assert got["response"].is_response and not got["query"].is_response and bytes(got["padded"].dns) == message((EX, 1))
    seen = {r.case: r.outcome for r in decode_messages(dns_messages(df)).collect()}
    assert seen["udp 20"] == "invalid" and seen["query"] == "records"
    assert events(decode_messages(dns_messages(df.drop("case")))).count() == 4
