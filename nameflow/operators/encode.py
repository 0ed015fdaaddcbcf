"""DNS messages and Ethernet frames as binary expressions, for generated traffic and round trips."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.scalars import wire_name


def hex_number(x: Column, digits: int) -> Column:
    return F.lpad(F.hex(x.cast("bigint")), digits, "0")


def query(ident: Column, name: Column, qtype: Column) -> Column:
    """One question, class IN, recursion desired."""
    head = F.unhex(F.concat(hex_number(ident, 4), F.lit("0100" + "0001" + "0000" * 3)))
    return F.concat(head, wire_name(name), F.unhex(F.concat(hex_number(qtype, 4), F.lit("0001"))))


def response(ident: Column, name: Column, qtype: Column, rcode: Column, address: Column | None = None) -> Column:
    """The question again, and an A record through a pointer to it if an address is given and the code is 0."""
    with_answer = (address.isNotNull() & (rcode == 0)) if address is not None else F.lit(False)
    head = F.unhex(F.concat(hex_number(ident, 4), hex_number(F.lit(0x8180) + rcode, 4), F.lit("0001"), F.when(with_answer, "0001").otherwise("0000"), F.lit("0000" * 2)))
    body = F.concat(head, wire_name(name), F.unhex(F.concat(hex_number(qtype, 4), F.lit("0001"))))
    if address is None:
        return body
    return F.when(with_answer, F.concat(body, F.unhex(F.lit("C00C" + "0001" + "0001" + "0000012C" + "0004")), address)).otherwise(body)


def checksum(data: bytes) -> int:
    """RFC 1071."""
    if len(data) % 2:
        data += b"\0"
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def frame(src: bytes, dst: bytes, src_port: int, dst_port: int, payload: bytes) -> bytes:
    """Ethernet, IPv4 (don't fragment) and UDP around a payload."""
    udp = struct.pack(">4H", src_port, dst_port, 8 + len(payload), 0) + payload
    pseudo = src + dst + struct.pack(">BBH", 0, 17, len(udp))
    udp = udp[:6] + struct.pack(">H", checksum(pseudo + udp) or 0xFFFF) + udp[8:]
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0x4000, 64, 17, 0, src, dst)
    ip = ip[:10] + struct.pack(">H", checksum(ip)) + ip[12:]
    return bytes(range(6)) + bytes(range(6, 12)) + b"\x08\x00" + ip + udp


@F.pandas_udf(BinaryType())
def frame_udf(src: pd.Series, dst: pd.Series, src_port: pd.Series, dst_port: pd.Series, payload: pd.Series) -> pd.Series:
    return pd.Series([frame(bytes(a), bytes(b), int(p), int(q), bytes(d)) for a, b, p, q, d in zip(src, dst, src_port, dst_port, payload, strict=True)])


def bare_frame(src: Column, dst: Column, src_port: Column, dst_port: Column, payload: Column) -> Column:
    """The same without checksums, in the JVM."""
    n = F.octet_length(payload)
    head = F.concat(F.lit("000102030405060708090A0B080045" + "00"), hex_number(n + 28, 4), F.lit("00004000" + "4011" + "0000"))
    return F.concat(F.unhex(head), src, dst, F.unhex(F.concat(hex_number(src_port, 4), hex_number(dst_port, 4), hex_number(n + 8, 4), F.lit("0000"))), payload)
