"""Aggregates over outcomes and packets: latency statistics, capture quality, decoding counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.95, 0.99, 0.999)


def outcome_classes(rows: DataFrame, request: str = "request_us", response: str = "response_us") -> DataFrame:
    """total, ok, timeout (no response), invalid (no request, or answered before it)"""
    q, r = F.col(request), F.col(response)
    bad = q.isNull() | F.coalesce(r < q, F.lit(False))
    return rows.agg(F.count("*").alias("total"), F.count_if(~bad & r.isNotNull()).alias("ok"), F.count_if(q.isNotNull() & r.isNull()).alias("timeout"), F.count_if(bad).alias("invalid"))


def latency(rows: DataFrame, request: str = "request_us", response: str = "response_us") -> DataFrame:
    """Matched rows' n, mean_us and median_us."""
    d = rows.where(F.col(response) >= F.col(request)).select((F.col(response) - F.col(request)).alias("d"))
    return d.agg(F.count("*").alias("n"), (F.sum("d").cast("double") / F.count("*")).alias("mean_us"), F.median("d").alias("median_us"))


def percentiles(rows: DataFrame, points=PERCENTILES, request: str = "request_us", response: str = "response_us") -> DataFrame:
    """Nearest-rank percentiles of matched latencies, a row each: the value at rank ceil(p * n).

    Values are counted first, and ranks run over counts of distinct values by power of two and then within one, so no task sorts all rows."""
    d = rows.where(F.col(response) >= F.col(request)).groupBy((F.col(response) - F.col(request)).alias("d")).agg(F.count("*").alias("c"))
    d = d.withColumn("band", F.floor(F.log2(F.col("d").cast("double") + 1)).cast("int"))
    bands = d.groupBy("band").agg(F.sum("c").alias("bc"))  # at most 64 rows
    before = bands.select("band", (F.sum("bc").over(W.orderBy("band")) - F.col("bc")).alias("before"), F.sum("bc").over(W.partitionBy()).alias("n"))
    ranked = d.join(F.broadcast(before), "band").withColumn("upto", F.col("before") + F.sum("c").over(W.partitionBy("band").orderBy("d")))
    # numerators of per-mille points avoid rounding in p * n
    wanted = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("p"), F.lit(round(p * 1000)).alias("m")) for p in points)))
    hit = ranked.select("d", "c", "upto", "n", wanted.alias("w")).withColumn("rank", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("w.m") * F.col("n") / 1000)))
    return hit.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c"))).select(F.col("w.p").alias("p"), F.col("d").alias("latency_us"))


def regressions(packets: DataFrame, ts: str = "ts_us", ordinal: str = "packet_ordinal", capture: Column | None = None, block: int = 65_536) -> DataFrame:
    """Packets earlier than the one before them: their count and the first as (previous ordinal, time, ordinal, time).

    Packets of one ordinal follow in order of time, those without an ordinal come last, so the result is the same however rows are dealt.
    The order is cut into blocks of ordinals; a block's first packet meets the last of the block before through a window over block ends."""
    p = packets.select(F.col(ordinal).alias("o"), F.col(ts).alias("t"))
    cut = p.withColumn("b", F.floor(F.col("o") / block))
    within = W.partitionBy("b").orderBy("o", "t")
    here = cut.select(F.lag("o").over(within).alias("po"), F.lag("t").over(within).alias("pt"), "o", "t")
    ends = cut.groupBy("b").agg(F.min(F.struct("o", "t")).alias("s"), F.max(F.struct("o", "t")).alias("e"))
    # the block before need not be the next lower number
    link = ends.select("s", F.lag("e").over(W.orderBy(F.asc_nulls_last("b"))).alias("l"))
    firsts = link.select(F.col("l.o").alias("po"), F.col("l.t").alias("pt"), F.col("s.o").alias("o"), F.col("s.t").alias("t"))
    found = here.union(firsts).where("pt > t")
    first = F.min(F.struct(F.col("o").isNull().alias("last"), "o", "po", "pt", "t")).alias("f")
    return found.agg(F.count("*").alias("regressions"), first).select("regressions", F.col("f.po").alias("previous_ordinal"), F.col("f.pt").alias("previous_ts"), F.col("f.o").alias("ordinal"), F.col("f.t").alias("ts"))


def decode_counts(decoded: DataFrame, questions: bool = False) -> DataFrame:
    """Messages by outcome; questions: also the numbers of questions in queries and in responses."""
    kinds = [F.count_if(F.col("outcome") == k).alias(n) for k, n in (("records", "decoded_msgs"), ("oversized_qname", "oversized_qname_msgs"), ("invalid", "invalid_msgs"))]
    if questions:
        asked = F.coalesce(F.size("questions"), F.lit(0)) * (F.col("outcome") == "records").cast("int")
        kinds += [
            F.coalesce(F.sum(F.when(side, asked)), F.lit(0)).cast("bigint").alias(n)
            for side, n in ((~F.col("is_response"), "dns_queries"), (F.col("is_response"), "dns_responses"))
        ]
    return decoded.agg(*kinds)


def record_counts(request: str = "request_timestamp", response: str = "response_timestamp") -> list[Column]:
    """Aggregates of records: matched, timeouts, matched_rtt_sum_us."""
    rtt = F.greatest(F.col(response) - F.col(request), F.lit(0).cast("bigint"))
    return [
        F.count(response).alias("matched"), F.count_if(F.col(response).isNull()).alias("timeouts"),
        F.coalesce(F.sum(rtt), F.lit(0)).cast("bigint").alias("matched_rtt_sum_us"),
    ]


def packets_per_second(packets: int, seconds: float) -> int:
    return int(packets / max(seconds, 2.2250738585072014e-308))
