"""Captures, sinks, settings and the whole run."""

import io
import struct

import pyarrow.parquet as pq
import pytest

from nameflow import cli, config, sinks
from nameflow.operators import anonymize, catalog, encode
from nameflow.plans.run import packets, run
from nameflow.sources import pcap

from test_decode import A, EX, NS, message


def classic(rows, order="<", magic=0xA1B2C3D4, link=1, ticks=1):
    head = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, link)
    return head + b"".join(struct.pack(order + "4I", t // 1_000_000, t % 1_000_000 * ticks, len(d), len(d)) + d for t, d in rows)


def block(kind, body):
    body += b"\0" * (-len(body) % 4)
    n = struct.pack("<I", len(body) + 12)
    return struct.pack("<I", kind) + n + body + n


def pcapng(*blocks, link=1):
    return block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", link, 0, 65535)) + b"".join(blocks)


def epb(ts, data, face=0):
    return block(6, struct.pack("<5I", face, ts >> 32, ts & 0xFFFFFFFF, len(data), len(data)) + data)


Q = encode.frame(A, NS, 53000, 53, message((EX, 1)))
R = encode.frame(NS, A, 53, 53000, message((EX, 1), flags=0x8180))


def put(tmp_path, data, name="c.pcap"):
    p = tmp_path / name
    p.write_bytes(data)
    return str(p)


@pytest.mark.parametrize(("order", "magic", "ticks"), [("<", 0xA1B2C3D4, 1), (">", 0xA1B2C3D4, 1), ("<", 0xA1B23C4D, 1000), (">", 0xA1B23C4D, 1000)])
def test_magics(spark, tmp_path, order, magic, ticks):
    path = put(tmp_path, classic([(1_000_000, Q), (1_200_007, R)], order, magic, ticks=ticks))
    assert [(r.packet_ordinal, r.batch_id, r.ts_us, bytes(r.data)) for r in packets(spark, path).orderBy("packet_ordinal").collect()] == [(0, 0, 1_000_000, Q), (1, 0, 1_200_007, R)]


def test_batches_span_partitions(spark, tmp_path):
    path = put(tmp_path, classic([(k, bytes([k])) for k in range(20)]))
    spark.dataSource.register(pcap.CaptureSource)
    df = spark.read.format("capture").options(batchPackets=3, batchesPerPartition=2).load(path)
    assert [(r.packet_ordinal, r.batch_id, r.data[0]) for r in df.orderBy("packet_ordinal").collect()] == [(k, k // 3, k) for k in range(20)] and df.rdd.getNumPartitions() == 4


@pytest.mark.parametrize("data", [b"\0\0\0", b"abcdefgh", classic([], link=101), classic([], link=1 | 0x08000000), pcapng(epb(1, Q), link=101), pcapng(block(3, struct.pack("<I", 4) + b"abcd")), pcapng(epb(1, Q, 5))])
def test_rejected(tmp_path, data):
    try:
        found = pcap.inspect(put(tmp_path, data))
    except pcap.CaptureError:
        return
    assert found.failure and not found.batches


def test_link_bits_of_checksums_are_accepted(tmp_path):
    assert pcap.inspect(put(tmp_path, classic([], link=1 | 0x14000000))).failure is None


def test_pcapng(spark, tmp_path):
    legacy = block(2, struct.pack("<HHIIII", 0, 0, 0, 1_200_000, len(R), len(R)) + R)
    path = put(tmp_path, pcapng(epb(1_000_000, Q), block(5, b"stat"), legacy))
    assert [(r.ts_us, bytes(r.data)) for r in packets(spark, path).orderBy("packet_ordinal").collect()] == [(1_000_000, Q), (1_200_000, R)]


def test_regressions(tmp_path):
    found = pcap.inspect(put(tmp_path, classic([(3_000_000, b""), (2_000_000, b""), (1_000_000, b"")])))
    assert (found.regressions, found.sample) == (2, (0, 3_000_000, 1, 2_000_000))
    with pytest.raises(pcap.NonMonotonicCaptureError, match="reordercap"):
        pcap.inspect(put(tmp_path, classic([(2, b""), (1, b"")])), monotonic=True)


def test_golden_rows(spark, tmp_path):
    late = encode.frame(bytes([10, 0, 0, 2]), NS, 53001, 53, struct.pack(">6H", 0xBEEF, 0x0100, 1, 0, 0, 0) + b"\x07example\x03org\0\0\x01\0\x01")
    path = put(tmp_path, classic([(1_000_000, Q), (1_200_000, R), (2_500_000, late)]))
    out = io.StringIO()
    run(spark, config.Config(path, "-", canonical_order=True), out)
    assert out.getvalue() == sinks.HEADER + "\n1000000,1200000,10.0.0.1,53000,4660,example.com,A,No Error\n2500000,,10.0.0.2,53001,48879,example.org,A,\n"
    got = run(spark, config.Config(path, str(tmp_path / "out"), format="parquet", zstd=True, parquet_v2=True))
    m = got["metrics"]
    shown = ("total_packets_processed", "total_dns_queries_processed", "total_matched_query_response_pairs", "timed_out_queries", "timed_out_query_ratio", "average_matched_rtt_ms")
    assert tuple(m[k] for k in shown) == (3, 2, 1, 1, 0.5, 200.0) and m["max_memory_usage_kib"] > 10_000 and m["total_runtime_seconds"] > 0
    assert list(got) == ["build", "config", "execution", "metrics", "warnings"] and got["warnings"]["non_monotonic_capture_timestamps"] is None
    assert sinks.summary_json(got).endswith("\n") and "elapsed: 00:" in sinks.summary_text(got)
    table = pq.read_table(str(tmp_path / "out"))
    assert str(table.schema.field("request_timestamp").type) == "timestamp[us, tz=UTC]" and table.column("response_code").to_pylist().count(None) == 1
    meta = pq.ParquetFile(next((tmp_path / "out").glob("*.parquet"))).schema.column(0)
    assert meta.physical_type == "INT64"


def test_captures_in_a_row(spark, tmp_path):
    """Batches of a later capture come after those of the one before it, and a known index is not read again."""
    from nameflow.plans.run import packets

    one, two = (put(tmp_path, classic([(k * 10 + j, Q) for j in range(5)]), f"{k}.pcap") for k in (2, 1))
    got = sorted(map(tuple, packets(spark, f"{one},{two}", batch_packets=2).select("batch_id", "ts_us").collect()))
    assert got == [(0, 20), (0, 21), (1, 22), (1, 23), (2, 24), (3, 10), (3, 11), (4, 12), (4, 13), (5, 14)]
    index = pcap.inspect(one, 2)
    index.batches = index.batches[:1]
    assert packets(spark, one, batch_packets=2, index=index).count() == 2


def test_sections(spark, tmp_path):
    """A capture written by tasks reads as the same capture in one file, with equal times on both sides of a cut and empty tasks."""
    from nameflow.plans.run import sections

    rows = [(4_000_000_000_000_007 + k // 5, k, bytes([k]) * (k % 7)) for k in range(100)]
    packets_ = spark.createDataFrame(rows, "ts_us long, k int, data binary").repartitionByRange(8, "k").sortWithinPartitions("k")
    found = pcap.write_sections(packets_.where("k < 30 or k > 60"), str(tmp_path / "all"))
    assert len(found) > 3 and all(x.failure is None for x in found.values())
    whole = str(tmp_path / "one.pcap")
    assert pcap.write_classic(((t, d) for t, k, d in rows if k < 30 or k > 60), whole) == 69
    shown = lambda df: [(r.packet_ordinal, r.batch_id, r.ts_us, bytes(r.data)) for r in df.orderBy("packet_ordinal").collect()]
    assert shown(sections(spark, found, 3)) == shown(packets(spark, whole, 3))
    assert sections(spark, pcap.write_sections(packets_.where("k < 0"), f"file://{tmp_path}/none"), 3).count() == 0
    for bad in ("cast(-1 as long)", "cast(null as long)", "4294967296000000L"):
        with pytest.raises(Exception, match="a packet"):
            pcap.write_sections(spark.range(1).selectExpr(f"{bad} as ts_us", "X'00' as data"), str(tmp_path / "bad"))
    next(iter(found.values())).failure = "cut short"
    with pytest.raises(Exception, match="no place"):
        sections(spark, found, 3).count()


def test_damaged_tail(spark, tmp_path, monkeypatch):
    """Whole batches are written, pending queries of them are not, and the run ends in an error."""
    rows = [(1_000_000, Q), (1_100_000, R), (1_200_000, Q)]
    path = put(tmp_path, classic(rows) + struct.pack("<4I", 2, 0, 64, 64) + b"abc")
    real = pcap.inspect
    monkeypatch.setattr(pcap, "inspect", lambda p, batch_packets=3, monotonic=False: real(p, 3, monotonic))
    monkeypatch.setattr("nameflow.plans.run.packets", lambda s, p, **kw: packets(s, p, 3, **kw))
    out = io.StringIO()
    with pytest.raises(pcap.CaptureError, match="cut short"):
        run(spark, config.Config(path, "-"), out)
    assert out.getvalue().splitlines()[1:] == ["1000000,1100000,10.0.0.1,53000,4660,example.com,A,No Error"]


def test_csv_escapes(spark, tmp_path):
    text = 'exa,mple"name\nwrapped\rline'
    rows = spark.createDataFrame([(1, None, "10.0.0.1", 5, 6, text, "A", None)], "request_timestamp long, response_timestamp long, source_ip string, source_port int, id int, name string, query_type string, response_code string")
    want = '1,,10.0.0.1,5,6,"exa,mple""name\nwrapped\rline",A,\n'
    assert list(sinks.csv_lines(rows))[1] == want
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().decode() == sinks.HEADER + "\n" + want


def test_pseudonyms(spark, tmp_path):
    from pyspark.sql import functions as F

    key = anonymize.derive_key("secret")
    ips = [bytes([0, 0, 56, 87]), bytes([0, 0, 201, 251]), bytes(range(16))]
    got = [bytes(r[0]) for r in spark.createDataFrame([(bytearray(x),) for x in ips], "ip binary").coalesce(1).select(anonymize.pseudonym(F.col("ip"), key)).collect()]
    assert got[0] == got[1] == bytes.fromhex("6AAA783E") and len(got[2]) == 16
    f = tmp_path / "key"
    f.write_text("secret-passphrase\n")
    assert anonymize.read_passphrase(str(f)) == "secret-passphrase"
    f.write_text(" \n")
    with pytest.raises(ValueError, match="empty"):
        anonymize.read_passphrase(str(f))
    with pytest.raises(FileNotFoundError):
        anonymize.read_passphrase(str(tmp_path / "none"))


def test_settings(tmp_path):
    path = put(tmp_path, classic([]))
    assert config.parse([path], {}).output == "dns_output.csv" and config.parse([path, "--format", "pq"], {}).output == "dns_output.parquet"
    env = {"NAMEFLOW_MATCH_TIMEOUT_MS": "7", "NAMEFLOW_MONOTONIC_CAPTURE": "Yes"}
    assert config.parse([path], env).timeout_us == 7000 and config.parse([path], env).monotonic and config.parse([path, "--match-timeout-ms", "9"], env).timeout_ms == 9
    for bad in (["--match-timeout-ms", "0"], ["--match-timeout-ms", "5001"], ["--match-timeout-ms", "x"], ["--zstd"], [path], ["-", "--format", "parquet"], ["-", "--report-format", "json"]):
        with pytest.raises(config.ConfigError):
            config.parse([path, *bad], {})
    with pytest.raises(config.ConfigError):
        config.parse([str(tmp_path)], {})
    assert cli.main([str(tmp_path / "missing")]) == 2
    assert sinks.duration(3661.5) == "01:01:01.500"


def test_catalog(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text("id,name\n1,www.google.com\n2,WWW.google.com \n3,.\n4,api.vk.com\n5,example.com\n6,bank.example\n")
    rows = catalog.read_records(spark, str(f))
    assert tuple(catalog.summary(rows, substrings=["bank"]).first()) == (6, 5, 1, 4)
    out = tmp_path / "c.tsv"
    assert catalog.write_catalog(catalog.top(rows, substrings=["bank"]), str(out)) == 4
    assert out.read_text() == "2\twww.google.com\n1\t.\n1\tapi.vk.com\n1\texample.com\n"
    assert catalog.load_catalog(spark, str(out)).count() == 4
    f.write_text("id,host\n1,x\n")
    with pytest.raises(ValueError, match="name"):
        catalog.read_records(spark, str(f))
    with pytest.raises(ValueError, match="positive"):
        catalog.top(rows, 0)
