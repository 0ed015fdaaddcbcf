"""Pairing of queries with responses: a range-bounded, one-to-one temporal match with retry deduplication.

Within an identity events are taken in processing order (batch, time, packet, record).  A query repeats a pending one
within the timeout (the earlier key stays); otherwise it takes the first waiting response in [q, q+T], or waits.  A
response takes the last waiting query in [r-T, r], or waits.  Queries left at the end are timeouts; responses left are
counted only.

Events more than the timeout apart never meet, whatever their order, so an identity is first cut into sessions at
such gaps; the cut and the grouping share one shuffle on the identity.  A session of one query and at most one
response needs no fold.  Where processing order is time order a fold of one open query suffices, as a
higher-order function in the JVM.  Other sessions, and very long ones, go through the general fold in Arrow
batches.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import IDENTITY

#: Events of a session beyond which the fold runs in Python, where appending is cheap.
LONG_SESSION = 2048
_OUT = "array<struct<q_ts:bigint,q_packet:bigint,q_record:int,q_batch:bigint,r_ts:bigint,rcode:int,rcode_ctx:string>>"
_CUR = "struct<batch:bigint,ts:bigint,packet:bigint,record:int>"


def sessions(events: DataFrame, timeout_us: int, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """identity, e: array of events in processing order, n_q, n_r, in_time_order - one row per session."""
    by_time = W.partitionBy(*identity).orderBy("ts_us")
    gap = F.col("ts_us") - F.lag("ts_us").over(by_time) > timeout_us
    cut = events.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int"))
    cut = cut.withColumn("_session", F.sum("_new").over(by_time.rangeBetween(W.unboundedPreceding, W.currentRow)))
    one = F.struct(F.col("batch_id").alias("batch"), F.col("ts_us").alias("ts"), F.col("packet_ordinal").alias("packet"), F.col("record_ordinal").alias("record"), F.col("is_query").alias("q"), F.col("rcode").alias("rcode"), F.col("rcode_ctx").alias("ctx"))
    grouped = cut.groupBy(*identity, "_session").agg(F.array_sort(F.collect_list(one)).alias("e"), F.count_if("is_query").alias("n_q"), F.count_if(~F.col("is_query")).alias("n_r"))
    keys = F.transform("e", lambda x: F.struct(x["ts"].alias("ts"), x["packet"].alias("packet"), x["record"].alias("record")))
    return grouped.withColumn("in_time_order", keys == F.array_sort(keys))


def _emit(q: Column, ts: Column, rcode: Column, ctx: Column) -> Column:
    return F.struct(q["ts"].alias("q_ts"), q["packet"].alias("q_packet"), q["record"].alias("q_record"), q["batch"].alias("q_batch"), ts.alias("r_ts"), rcode.alias("rcode"), ctx.alias("rcode_ctx"))


def _timeout(q: Column) -> Column:
    return _emit(q, F.lit(None).cast("bigint"), F.lit(None).cast("int"), F.lit(None).cast("string"))


def fold_in_time_order(e: Column, timeout_us: int) -> Column:
    """struct(out, dup) of events whose processing order is their time order."""
    none = F.lit(None).cast(_CUR)
    waiting = "array<struct<ts:bigint,rcode:int,ctx:string>>"
    zero = F.struct(none.alias("cur"), F.array().cast(waiting).alias("orph"), F.lit(0).cast("bigint").alias("dup"), F.array().cast(_OUT).alias("out"))

    def step(a: Column, x: Column) -> Column:
        me = F.struct(x["batch"].alias("batch"), x["ts"].alias("ts"), x["packet"].alias("packet"), x["record"].alias("record"))
        orph = F.filter(a["orph"], lambda o: o["ts"] == x["ts"])  # only responses of this very time can still match
        open_ = a["cur"].isNotNull() & (x["ts"] - a["cur"]["ts"] <= timeout_us)
        state = lambda cur, orph, dup, out: F.struct(cur.cast(_CUR).alias("cur"), orph.alias("orph"), dup.alias("dup"), out.cast(_OUT).alias("out"))
        flushed = F.when(a["cur"].isNotNull(), F.array_append(a["out"], _timeout(a["cur"]))).otherwise(a["out"])
        first = F.try_element_at(orph, F.lit(1))
        mine = F.struct(x["ts"].alias("ts"), x["rcode"].alias("rcode"), x["ctx"].alias("ctx"))
        return (
            F.when(x["q"] & open_, state(a["cur"], orph, a["dup"] + 1, a["out"]))
            .when(x["q"] & (F.size(orph) > 0), state(none, F.slice(orph, 2, F.greatest(F.size(orph), F.lit(1))), a["dup"], F.array_append(flushed, _emit(me, first["ts"], first["rcode"], first["ctx"]))))
            .when(x["q"], state(me, orph, a["dup"], flushed))
            .when(open_, state(none, orph, a["dup"], F.array_append(a["out"], _emit(a["cur"], x["ts"], x["rcode"], x["ctx"]))))
            .otherwise(state(a["cur"], F.array_append(orph, mine), a["dup"], a["out"]))
        )

    end = lambda a: F.struct(F.when(a["cur"].isNotNull(), F.array_append(a["out"], _timeout(a["cur"]))).otherwise(a["out"]).cast(_OUT).alias("out"), a["dup"].alias("dup"))
    return F.aggregate(e, zero, step, end)


def fast_lane(e: Column, timeout_us: int) -> Column:
    """struct(out, dup) of one query and at most one response, in either order."""
    q = F.element_at(F.filter(e, lambda x: x["q"]), 1)
    r = F.try_element_at(F.filter(e, lambda x: ~x["q"]), F.lit(1))
    hit = r.isNotNull() & (r["ts"] - q["ts"]).between(0, timeout_us)
    return F.struct(F.array(F.when(hit, _emit(q, r["ts"], r["rcode"], r["ctx"])).otherwise(_timeout(q))).cast(_OUT).alias("out"), F.lit(0).cast("bigint").alias("dup"))


def general_fold(events: list[dict], timeout_us: int) -> tuple[list[dict], int]:
    """The fold for any processing order, over sorted lists of waiting queries and responses."""
    queries: list[tuple] = []
    responses: list[tuple] = []
    out, dup = [], 0
    done = lambda q, r: {"q_ts": q[0], "q_packet": q[1], "q_record": q[2], "q_batch": q[3], "r_ts": r[0] if r else None, "rcode": r[3] if r else None, "rcode_ctx": r[4] if r else None}
    for x in events:
        t = x["ts"]
        key = (t, x["packet"], x["record"])
        if x["q"]:
            at = bisect_left(queries, (t - timeout_us,))
            if at < len(queries) and queries[at][0] <= t + timeout_us:
                dup += 1
                if queries[at][:3] <= key:
                    continue
                queries.pop(at)
            at = bisect_left(responses, (t,))
            if at < len(responses) and responses[at][0] <= t + timeout_us:
                out.append(done((*key, x["batch"]), responses.pop(at)))
            else:
                insort(queries, (*key, x["batch"]))
        else:
            at = bisect_left(queries, (t + 1,)) - 1
            if at >= 0 and queries[at][0] >= t - timeout_us:
                out.append(done(queries.pop(at), (*key, x["rcode"], x["ctx"])))
            else:
                insort(responses, (*key, x["rcode"], x["ctx"]), key=lambda r: r[:3])
    return out + [done(q, None) for q in queries], dup


def _general(timeout_us: int, n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [general_fold(e, timeout_us) for e in b.column(n_keys).to_pylist()]
            out = pa.list_(pa.struct([("q_ts", pa.int64()), ("q_packet", pa.int64()), ("q_record", pa.int32()), ("q_batch", pa.int64()), ("r_ts", pa.int64()), ("rcode", pa.int32()), ("rcode_ctx", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_keys)), pa.array([o for o, _ in got], out), pa.array([d for _, d in got], pa.int64()), b.column(n_keys + 1)], names=[*b.schema.names[:n_keys], "out", "dup", "n_r"])

    return run


def fold(events: DataFrame, timeout_us: int, identity: Sequence[str] = IDENTITY, lane: str = "auto") -> DataFrame:
    """identity, out, dup, n_r - a row per session.  lane: auto, or `general` for the general fold throughout."""
    cut = sessions(events, timeout_us, identity)
    native = (F.col("in_time_order") | ((F.col("n_q") == 1) & (F.col("n_r") <= 1))) & (F.col("n_q") + F.col("n_r") <= LONG_SESSION)
    if lane == "general":
        native = F.lit(False)
    small = (F.col("n_q") == 1) & (F.col("n_r") <= 1)
    orphans = F.struct(F.array().cast(_OUT).alias("out"), F.lit(0).cast("bigint").alias("dup"))
    folded = F.when(F.col("n_q") == 0, orphans).when(small, fast_lane(F.col("e"), timeout_us)).otherwise(fold_in_time_order(F.col("e"), timeout_us))
    here = cut.where(native).select(*identity, folded.alias("f"), "n_r").select(*identity, "f.out", "f.dup", "n_r")
    rest = cut.where(~native).select(*identity, "e", "n_r")
    types = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in identity)
    there = rest.mapInArrow(_general(timeout_us, len(identity)), f"{types}, out {_OUT}, dup bigint, n_r bigint")
    return here.union(there) if lane != "general" else there


def outcomes(events: DataFrame, timeout_us: int, identity: Sequence[str] = IDENTITY, lane: str = "auto") -> DataFrame:
    """One row per canonical query: identity, request_us, response_us, rcode, rcode_ctx; null response of a timeout."""
    folded = fold(events, timeout_us, identity, lane)
    # of a plain explode Catalyst infers filters on `out`, which repeat the whole fold in the plan
    rows = folded.select(*identity, F.explode_outer("out").alias("o")).where(F.col("o").isNotNull())
    return rows.select(*identity, F.col("o.q_batch").alias("batch_id"), F.col("o.q_packet").alias("packet_ordinal"), F.col("o.q_record").alias("record_ordinal"), F.col("o.q_ts").alias("request_us"), F.col("o.r_ts").alias("response_us"), F.col("o.rcode").alias("rcode"), F.col("o.rcode_ctx").alias("rcode_ctx"))


def counters(events: DataFrame, timeout_us: int, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """One row: dns_queries, dup_queries, dns_responses, matched, timeouts, matched_rtt_sum_us."""
    folded = fold(events, timeout_us, identity)
    hits = F.filter("out", lambda o: o["r_ts"].isNotNull())
    rtt = F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, o: a + F.greatest(o["r_ts"] - o["q_ts"], F.lit(0).cast("bigint")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return folded.agg(
        total(F.size("out") + F.col("dup")).alias("dns_queries"), total("dup").alias("dup_queries"), total("n_r").alias("dns_responses"),
        total(F.size(hits)).alias("matched"), total(F.size("out") - F.size(hits)).alias("timeouts"), total(rtt).alias("matched_rtt_sum_us"),
    )


def ratios(counts: DataFrame) -> DataFrame:
    """counts with timed_out_query_ratio (over all query records) and average_rtt_ms (null without matches)."""
    return counts.withColumns({
        "timed_out_query_ratio": F.coalesce(F.try_divide(F.col("timeouts").cast("double"), F.col("dns_queries").cast("double")), F.lit(0.0)),
        "average_rtt_ms": F.try_divide(F.col("matched_rtt_sum_us").cast("double"), F.col("matched").cast("double")) / 1000.0,
    })


def evicted(outcome: DataFrame, watermark_us: Column | int, timeout_us: int) -> DataFrame:
    """Timeouts that a batch's watermark settles: pending queries strictly before watermark - timeout."""
    mark = F.lit(watermark_us) if isinstance(watermark_us, int) else watermark_us
    return outcome.where(F.col("response_us").isNull() & (F.col("request_us") < mark - timeout_us))
