"""Ethernet, IPv4/IPv6 and UDP headers in built-in expressions: which packets carry DNS, and whose.

Frames that are not applicable (other EtherTypes, fragments, protocols, ports) and malformed ones are dropped alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import u8, u16
from ..schemas import DNS_PORT

ETHERNET, UDP = 14, 17


def dns_messages(packets: DataFrame) -> DataFrame:
    """packets' keys with is_response, client_ip, client_port, resolver_ip and the declared DNS bytes."""
    keys = [c for c in packets.columns if c != "data"]
    # cheap tests come first, so that most other traffic is not looked at any further
    kind = F.substring("data", 13, 2)
    p = packets.where(F.octet_length("data") >= ETHERNET).where(kind.isin(bytearray(b"\x08\x00"), bytearray(b"\x86\xdd")))
    p = p.withColumn("_v4", kind == F.lit(bytearray(b"\x08\x00"))).withColumn("_n", F.octet_length("data") - ETHERNET)
    first = u8(F.col("data"), ETHERNET)
    p = p.withColumn("_head", F.when(F.col("_v4"), F.when(F.shiftright(first, 4) == 4, first.bitwiseAND(15) * 4)).otherwise(F.when(F.shiftright(first, 4) == 6, F.lit(40))))
    p = p.where((F.col("_head") >= F.when(F.col("_v4"), 20).otherwise(40)) & (F.col("_head") <= F.col("_n")))
    protocol = F.when(F.col("_v4"), u8(F.col("data"), ETHERNET + 9)).otherwise(u8(F.col("data"), ETHERNET + 6))
    whole = ~F.col("_v4") | (u16(F.col("data"), ETHERNET + 6).bitwiseAND(0x3FFF) == 0)
    p = p.where((protocol == UDP) & whole)
    length = F.when(F.col("_v4"), u16(F.col("data"), ETHERNET + 2)).otherwise(u16(F.col("data"), ETHERNET + 4) + 40)
    p = p.withColumn("_len", length).where((F.col("_len") >= F.col("_head")) & (F.col("_len") <= F.col("_n")))
    at = F.lit(ETHERNET) + F.col("_head")
    p = p.withColumns({"_payload": F.col("_len") - F.col("_head"), "_sp": u16(F.col("data"), at), "_dp": u16(F.col("data"), at + 2), "_udp": u16(F.col("data"), at + 4)})
    p = p.where((F.col("_payload") >= 8) & ((F.col("_sp") == DNS_PORT) | (F.col("_dp") == DNS_PORT)))
    p = p.where((F.col("_udp") >= 8) & (F.col("_udp") <= F.col("_payload")) & (F.col("_udp") - 8 >= 12))
    source = F.when(F.col("_v4"), F.substring("data", ETHERNET + 13, 4)).otherwise(F.substring("data", ETHERNET + 9, 16))
    target = F.when(F.col("_v4"), F.substring("data", ETHERNET + 17, 4)).otherwise(F.substring("data", ETHERNET + 25, 16))
    p = p.withColumns({"_src": source, "_dst": target, "is_response": F.col("_sp") == DNS_PORT})
    return p.select(*keys, "is_response", *flow_key("_src", "_sp", "_dst", "_dp"), F.substring(F.col("data"), at + 9, F.col("_udp") - 8).alias("dns"))


def flow_key(src: str, src_port: str, dst: str, dst_port: str):
    """client_ip, client_port, resolver_ip: the side at port 53 is the resolver; a source port of 53 makes a response."""
    answer = F.col(src_port) == DNS_PORT
    return (
        F.when(answer, F.col(dst)).otherwise(F.col(src)).alias("client_ip"),
        F.when(answer, F.col(dst_port)).otherwise(F.col(src_port)).alias("client_port"),
        F.when(answer, F.col(src)).otherwise(F.col(dst)).alias("resolver_ip"),
    )
