"""Registered queries against their SQL, generator and stream."""

import os

import pandas as pd
import pytest

import __spark_entry__
from nameflow import contract
from nameflow.generator import traffic
from nameflow.operators import matching
from nameflow.schemas import EVENTS

SF = "/root/testdata/sf0.001"


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if pd.isna(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def as_rows(df):
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(contract.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    assert as_rows(contract.QUERIES[name](spark, SF).toPandas()) == as_rows(con.sql(contract.SQL[name]).df())


@pytest.mark.parametrize("parts", [1, 5])
def test_regressions_of_repeated_ordinals(spark, parts):
    """Every packet has one packet before it, whatever repeats and wherever blocks are cut."""
    from nameflow.operators import metrics

    rows = [(k % 12, (k * 7919) % 101) for k in range(120)] + [(5, 3)] * 4 + [(40, 50), (None, 1), (None, 2), (7, None)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)
    order = sorted(rows, key=key)
    bad = [(*a, *b) for a, b in zip(order, order[1:], strict=False) if None not in (a[1], b[1]) and a[1] > b[1]]
    df = spark.createDataFrame(rows, "packet_ordinal long, ts_us long").repartition(parts)
    for block in (1, 4, 1000):
        assert tuple(metrics.regressions(df, block=block).first()) == (len(bad), *bad[0])
    late = metrics.regressions(spark.createDataFrame([(1, 2), (None, 1)], "packet_ordinal long, ts_us long"), block=4)
    assert tuple(late.first()) == (1, 1, 2, None, 1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_packets_do_not_pass_the_driver(spark, tmp_path):
    """Of 20,000 events, nearly 4 MB as packets, the driver gets less than 0.5 MB: no more than so many tasks report."""
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    sent = lambda: sum(s.resultSize() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())))
    spark.range(20).crossJoin(spark.read.parquet(f"{SF}/events.parquet")).selectExpr("event_id + id * 1000000 as event_id", "ts", "user_id", "event_type").write.parquet(str(tmp_path / "events.parquet"))
    before = sent()
    contract.capture_records(spark, str(tmp_path))
    assert sent() - before < 500_000


def test_no_regressions(spark, tmp_path):
    """As SQL has it: no row, not a row of nothing."""
    import duckdb

    spark.sql("select 1L as event_id, timestamp_ntz'2024-01-01 00:00:00' as ts, 1L as user_id, 'view' as event_type").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert contract.non_monotonic_scan(spark, str(tmp_path)).collect() == con.sql(contract.SQL["non_monotonic_scan"]).fetchall() == []


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() > 0


def test_traffic_is_the_same_however_partitioned(spark):
    names = spark.createDataFrame([(10, "example.com"), (8, "www.example.org"), (1, ".")], "weight int, name string")
    make = lambda seed: sorted(map(tuple, traffic.transactions(spark, traffic.DEFAULT, names, 300, seed, qps=100.0, clients=12, resolvers=3).collect()))
    a = make(7)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = make(7)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b and a != make(8) and len(a) == 300
    t = traffic.transactions(spark, traffic.DEFAULT, names, 300, 7)
    times = [r.ts_us for r in traffic.frames(traffic.packets(t, traffic.DEFAULT, 7)).collect()]
    assert times == sorted(times)


def test_generated_traffic_comes_back(spark):
    want = contract.generate_traffic(spark, "").first()
    got = contract.generated_round_trip(spark, "").first()
    assert got.dns_responses == want.response_packets and got.dns_queries == want.query_packets and got.matched <= want.response_packets


def test_stream_equals_batch(spark, tmp_path):
    from nameflow.streaming.matcher import stream_outcomes, with_event_time

    rows = []
    for k in range(40):
        for i, (ts, q) in enumerate([(0, True), (300_000, True), (500_000 + k, False), (3_000_000, True), (9_000_000, True), (9_000_100, False)]):
            rows.append((0, 1_000_000 * (k + 1) + ts, 10 * k + i, 0, q, k, "n", 1, b"\1", 1, b"\2", None if q else 0, None if q else "Header"))
    df = spark.createDataFrame(rows, EVENTS).orderBy("ts_us")
    last = 10**9
    end = spark.createDataFrame([(0, last + j * 10**7, 10**6 + j, 0, True, -1, "end", 1, b"\1", 1, b"\2", None, None) for j in range(2)], EVENTS)
    for i, lo in enumerate(range(0, 60_000_000, 20_000_000)):
        df.where(f"ts_us >= {lo} and ts_us < {lo + 20_000_000}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    for j in range(2):
        end.where(f"packet_ordinal = {10**6 + j}").coalesce(1).write.parquet(str(tmp_path / "in" / f"9{j}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_outcomes(with_event_time(stream), 1_200_000).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(repr((r.id, r.request_us, r.response_us)) for r in spark.table("pairs").where("id >= 0").collect())
    want = sorted(repr((r.id, r.request_us, r.response_us)) for r in matching.outcomes(df, 1_200_000).collect())
    assert got == want
