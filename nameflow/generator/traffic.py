"""Synthetic DNS traffic as a plan over a range of transactions.

Every draw is a hash of the seed, the transaction and the draw's name, so a seed gives the same traffic whatever the
partitioning.  Arrival times are a running sum over blocks of transactions: sums of blocks first, then within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dims import RECORD_TYPES
from ..functions.scalars import is_reverse, is_root
from ..operators.encode import frame_udf, query, response
from .profile import CODES, Profile

BLOCK = 4096
#: Names without records, for NXDOMAIN answers.
NEGATIVE = ("missing.invalid", "no-such-host.invalid", "gone.example.invalid", "unknown.test.invalid", "nothing.invalid")
MAX_CLIENTS, MAX_RESOLVERS = 4_161_536, 51_968


def uniform(seed: int, *what) -> Column:
    """A number in (0, 1) that depends on its arguments alone."""
    h = F.xxhash64(F.lit(seed), *(F.lit(w) if isinstance(w, (str, int)) else w for w in what))
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


def below(u: Column, n: int) -> Column:
    return F.least(F.floor(u * n), F.lit(n - 1)).cast("bigint")


def between(u: Column, lo: Column | int, hi: Column | int) -> Column:
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (lo, hi))
    return (lo + F.least(F.floor(u * (hi - lo + 1)), hi - lo)).cast("bigint")


def weighted(u: Column, choices: list[tuple], value=F.lit) -> Column:
    """A choice (value, weight) by cumulated weights."""
    total, at, out = sum(w for _, w in choices), 0, None
    for v, w in choices[:-1]:
        at += w
        test = u < at / total
        out = F.when(test, value(v)) if out is None else out.when(test, value(v))
    return value(choices[-1][0]) if out is None else out.otherwise(value(choices[-1][0]))


def transactions(spark: SparkSession, p: Profile, catalog: DataFrame, n: int, seed: int, qps: float | None = None, clients: int | None = None, resolvers: int | None = None, start_us: int = 0) -> DataFrame:
    """One row per logical transaction, its first query's time in base_us."""
    qps, clients, resolvers = qps or p.qps, clients or p.clients, resolvers or p.resolvers
    if not (n > 0 and qps > 0 and 0 < clients <= MAX_CLIENTS and 0 < resolvers <= MAX_RESOLVERS):
        raise ValueError("transactions, rate, clients or resolvers are out of range")
    t = spark.range(n).withColumnRenamed("id", "tx")
    u = lambda what: uniform(seed, what, F.col("tx"))
    wait = F.greatest(F.lit(1), F.round(-F.log(u("arrival")) * (1_000_000 / qps))).cast("bigint")
    t = t.withColumns({"wait": wait, "block": F.expr(f"tx div {BLOCK}")})
    sums = t.groupBy("block").agg(F.sum("wait").alias("s"))
    before = sums.select("block", (F.sum("s").over(W.orderBy("block")) - F.col("s")).alias("before"))  # a row per block
    t = t.join(before, "block").withColumn("base_us", F.col("before") + F.sum("wait").over(W.partitionBy("block").orderBy("tx")) + start_us)
    code = weighted(u("code"), [(CODES[k], w) for k, w in p.response_codes.items() if w])
    count = F.least(weighted(u("retries"), p.retry_counts), F.lit(p.duplicate_max))
    t = t.withColumns({
        "client": below(u("client"), clients), "resolver": below(u("resolver"), resolvers), "port": between(u("port"), 49152, 65000).cast("int"), "ident": below(u("ident"), 65536).cast("int"),
        "timed_out": u("timeout") < p.timeout_rate, "rcode": code, "retries": F.when(u("duplicate") < p.duplicate_rate, count).otherwise(0),
    })
    # a weighted pick from the catalog is a range join on cumulated weights, bucketed by equal steps of the range
    total = catalog.agg(F.sum("weight")).first()[0]
    spans = catalog.select("name", F.col("weight").cast("bigint").alias("weight")).withColumn("upto", F.sum("weight").over(W.orderBy(F.desc("weight"), "name")))  # a catalog has at most its top k names
    spans = spans.withColumn("lo", F.col("upto") - F.col("weight"))
    step = max(1, total // 1024)
    spans = spans.withColumn("slot", F.explode(F.sequence(F.expr(f"lo div {step}"), F.expr(f"(upto - 1) div {step}"))))
    t = t.withColumn("pick", below(u("name"), total)).withColumn("slot", F.expr(f"pick div {step}"))
    t = t.join(spans.select("slot", "lo", "upto", F.col("name").alias("picked")), (F.col("pick") >= F.col("lo")) & (F.col("pick") < F.col("upto")) & (t.slot == spans.slot)).drop("slot")
    name = F.when(F.col("rcode") == 3, F.element_at(F.array(*map(F.lit, NEGATIVE)), (below(u("negative"), len(NEGATIVE)) + 1).cast("int"))).otherwise(F.col("picked"))
    numbers = {v: k for k, v in RECORD_TYPES.items()}
    kind = lambda k: weighted(u("qtype"), [(numbers[x], w) for x, w in p.query_types[k]])
    t = t.withColumn("name", name)
    qtype = F.when(F.col("rcode") == 3, kind("negative")).when(is_root(F.col("name")), kind("root")).when(is_reverse(F.col("name")), kind("reverse")).otherwise(kind("positive"))
    return t.withColumn("qtype", qtype).select("tx", "base_us", "client", "resolver", "port", "ident", "timed_out", "rcode", "retries", "name", "qtype")


def packets(t: DataFrame, p: Profile, seed: int) -> DataFrame:
    """Packets (ts_us, tx, step, is_response, retry) of transactions: queries, retries and responses, not yet in order."""
    u = lambda what, *more: uniform(seed, what, F.col("tx"), *more)

    def gap(steps: list[tuple[int, int]], i: Column) -> Column:
        out = None
        for k, (lo, hi) in enumerate(steps):
            if k == len(steps) - 1:
                out = between(u("gap", i), lo, hi) if out is None else out.otherwise(between(u("gap", i), lo, hi))
            else:
                out = F.when(i == k + 1, between(u("gap", i), lo, hi)) if out is None else out.when(i == k + 1, between(u("gap", i), lo, hi))
        return out

    many = F.col("retries") > 0
    gaps = F.when(many, F.transform(F.sequence(F.lit(1), F.greatest("retries", F.lit(1))), lambda i: F.when(F.col("timed_out"), gap(p.unanswered_steps, i)).otherwise(gap(p.answered_steps, i)))).otherwise(F.array().cast("array<bigint>"))
    times = F.aggregate(gaps, F.array(F.col("base_us")), lambda a, g: F.array_append(a, F.element_at(a, -1) + g))
    slow = F.col("rcode").isin(1, 2, 4, 5)
    pick = lambda rows, what: weighted(u(what), [((lo, hi), w) for w, lo, hi in rows], lambda r: between(u(what + "-in"), r[0], r[1]))
    delay = F.when(slow, pick(p.servfail_delay, "slow")).otherwise(pick(p.normal_delay, "normal"))
    t = t.withColumn("times", times).withColumn("answer", F.when(~F.col("timed_out"), F.element_at("times", -1) + delay))
    asked = t.select("*", F.posexplode("times").alias("step", "ts_us")).withColumn("is_response", F.lit(False))
    told = t.where("answer is not null").withColumns({"step": F.size("times"), "ts_us": F.col("answer"), "is_response": F.lit(True)})
    return asked.unionByName(told).drop("times", "answer")


def frames(rows: DataFrame) -> DataFrame:
    """ts_us and data of packets, in capture order."""
    number = lambda base, x: F.unhex(F.lpad(F.hex((F.lit(base) + x).cast("bigint")), 8, "0"))
    client, resolver = number(0x0A000001, F.col("client")), number(0xC6120001, F.col("resolver"))
    address = number(0xCB007100, F.pmod(F.xxhash64("name"), F.lit(256)))
    payload = F.when(F.col("is_response"), response(F.col("ident"), F.col("name"), F.col("qtype"), F.col("rcode"), F.when(F.col("qtype") == 1, address))).otherwise(query(F.col("ident"), F.col("name"), F.col("qtype")))
    r = F.col("is_response")
    data = frame_udf(F.when(r, resolver).otherwise(client), F.when(r, client).otherwise(resolver), F.when(r, 53).otherwise(F.col("port")), F.when(r, F.col("port")).otherwise(53), payload)
    return rows.select("ts_us", "tx", "step", data.alias("data")).orderBy("ts_us", "tx", "step").select("ts_us", "data")


def summary(t: DataFrame, rows: DataFrame) -> DataFrame:
    """logical, query, duplicate and response packets, timeouts, answers by code, first and last time"""
    a = t.agg(F.count("*").alias("logical"), F.count_if("timed_out").alias("timeouts"))
    r = F.col("is_response")
    b = rows.agg(
        F.count_if(~r).alias("query_packets"), F.count_if(~r & (F.col("step") > 0)).alias("duplicate_packets"), F.count_if(r).alias("response_packets"), F.count_if(r & (F.col("rcode") == 0)).alias("noerror"),
        F.count_if(r & (F.col("rcode") == 2)).alias("servfail"), F.count_if(r & (F.col("rcode") == 3)).alias("nxdomain"), F.min("ts_us").alias("first_ts"), F.max("ts_us").alias("last_ts"),
    )
    return a.crossJoin(b).withColumn("span_us", F.col("last_ts") - F.col("first_ts"))  # a row each


#: Used where no profile is given.
DEFAULT = Profile(
    "default", "", 1000.0, 2048, 3, 3, 0.01, 0.02, {"positive": [("A", 70), ("AAAA", 25), ("HTTPS", 5)], "negative": [("A", 60), ("AAAA", 40)], "reverse": [("PTR", 1)], "root": [("NS", 1)]},
    [(1, 80), (2, 15), (3, 5)], {"formerr": 1, "noerror": 970, "nxdomain": 20, "notimp": 1, "refused": 3, "servfail": 5}, [(900, 20, 400), (100, 400, 40_000)], [(1000, 1000, 90_000)],
    [(100_000, 400_000), (400_000, 600_000)], [(900_000, 1_100_000)],
)
