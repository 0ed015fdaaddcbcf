"""The engine's queries over the driver's tables, each with the same in DuckDB SQL where SQL can say it.

The tables have no DNS traffic, so adapters derive it: `events` become matcher events (view, click and signup are
queries; the user is the identity; the timeout is six hours); names come from keys, hosts and names of other tables;
frames are built from keys, with faults chosen by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions import scalars
from .generator import traffic
from .operators import anonymize, catalog, decode, encode, frames, matching, metrics

T_US = 6 * 3600 * 1_000_000
ID = ("user_id",)
SHARED = "/tmp/checkpoints"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    micros = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.lit("UTC"))) if spark.conf.get("spark.sql.session.timeZone") == "UTC" else F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return e.select(
        F.lit(0).cast("bigint").alias("batch_id"), micros.alias("ts_us"), F.col("event_id").alias("packet_ordinal"), F.lit(0).alias("record_ordinal"), F.col("event_type").isin("view", "click", "signup").alias("is_query"),
        "user_id", F.when(F.col("event_type") == "error", 2).otherwise(0).alias("rcode"), F.lit("Header").alias("rcode_ctx"),
    )


#: One row per event and user in order: the open query, what the event emits.
_FOLD = f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) AS t, event_type IN ('view','click','signup') AS q, CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS rc,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (
  SELECT user_id, rn, CASE WHEN q THEN t END AS cur, CASE WHEN q THEN event_id END AS cur_ord, CAST(NULL AS BIGINT) AS em, CAST(NULL AS BIGINT) AS em_ord, CAST(NULL AS BIGINT) AS resp, CAST(NULL AS INTEGER) AS rc, 0 AS dup
  FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn,
    CASE WHEN e.q AND f.cur IS NOT NULL AND e.t - f.cur <= {T_US} THEN f.cur WHEN e.q THEN e.t WHEN f.cur IS NOT NULL AND e.t - f.cur <= {T_US} THEN NULL ELSE f.cur END,
    CASE WHEN e.q AND f.cur IS NOT NULL AND e.t - f.cur <= {T_US} THEN f.cur_ord WHEN e.q THEN e.event_id WHEN f.cur IS NOT NULL AND e.t - f.cur <= {T_US} THEN NULL ELSE f.cur_ord END,
    CASE WHEN f.cur IS NULL THEN NULL WHEN e.q AND e.t - f.cur <= {T_US} THEN NULL WHEN e.q THEN f.cur WHEN e.t - f.cur <= {T_US} THEN f.cur END,
    CASE WHEN f.cur IS NULL THEN NULL WHEN e.q AND e.t - f.cur <= {T_US} THEN NULL WHEN e.q THEN f.cur_ord WHEN e.t - f.cur <= {T_US} THEN f.cur_ord END,
    CASE WHEN NOT e.q AND f.cur IS NOT NULL AND e.t - f.cur <= {T_US} THEN e.t END,
    CASE WHEN NOT e.q AND f.cur IS NOT NULL AND e.t - f.cur <= {T_US} THEN e.rc END,
    CASE WHEN e.q AND f.cur IS NOT NULL AND e.t - f.cur <= {T_US} THEN 1 ELSE 0 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1),
o AS (
  SELECT user_id, em_ord AS packet_ordinal, em AS request_us, resp AS response_us, rc AS rcode FROM f WHERE em IS NOT NULL
  UNION ALL
  SELECT f.user_id, f.cur_ord, f.cur, CAST(NULL AS BIGINT), CAST(NULL AS INTEGER) FROM f JOIN (SELECT user_id, max(rn) AS rn FROM e GROUP BY user_id) m ON m.user_id = f.user_id AND m.rn = f.rn WHERE f.cur IS NOT NULL)
"""
_SHOWN = ["user_id", "packet_ordinal", "request_us", "response_us", "rcode"]
_OUTCOMES = f"{_FOLD} SELECT user_id, packet_ordinal, request_us, response_us, rcode FROM o"


def match_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.outcomes(_events(spark, sf_dir), T_US, ID).select(*_SHOWN)


def match_outcomes_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.outcomes(_events(spark, sf_dir), T_US, ID, lane="general").select(*_SHOWN)


def match_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ratios(matching.counters(_events(spark, sf_dir), T_US, ID))


_COUNTERS = f"""{_FOLD} SELECT *, CASE WHEN dns_queries = 0 THEN 0.0 ELSE timeouts::DOUBLE / dns_queries::DOUBLE END AS timed_out_query_ratio,
  CASE WHEN matched = 0 THEN NULL ELSE matched_rtt_sum_us::DOUBLE / matched::DOUBLE / 1000.0 END AS average_rtt_ms FROM (SELECT
  (SELECT count(*) FROM e WHERE q)::BIGINT AS dns_queries, (SELECT coalesce(sum(dup), 0) FROM f)::BIGINT AS dup_queries, (SELECT count(*) FROM e WHERE NOT q)::BIGINT AS dns_responses,
  (SELECT count(*) FROM o WHERE response_us IS NOT NULL)::BIGINT AS matched, (SELECT count(*) FROM o WHERE response_us IS NULL)::BIGINT AS timeouts,
  (SELECT coalesce(sum(response_us - request_us), 0) FROM o WHERE response_us IS NOT NULL)::BIGINT AS matched_rtt_sum_us)"""


def retry_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.fold(_events(spark, sf_dir), T_US, ID).groupBy("user_id").agg(F.sum("dup").alias("dup_queries")).where("dup_queries > 0")


def timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_outcomes(spark, sf_dir).where("response_us is null").select("user_id", "packet_ordinal", "request_us")


def orphan_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.size(F.filter("out", lambda o: o["r_ts"].isNotNull()))
    return matching.fold(_events(spark, sf_dir), T_US, ID).groupBy("user_id").agg(F.sum(F.col("n_r") - hit).alias("orphans")).where("orphans > 0")


_ORPHANS = f"""{_FOLD}, r AS (SELECT user_id, count(*) AS n FROM e WHERE NOT q GROUP BY user_id), m AS (SELECT user_id, count(*) AS n FROM o WHERE response_us IS NOT NULL GROUP BY user_id)
SELECT r.user_id, (r.n - coalesce(m.n, 0))::BIGINT AS orphans FROM r LEFT JOIN m ON m.user_id = r.user_id WHERE r.n > coalesce(m.n, 0)"""


def monotonic_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeouts settled before the end: those the last event's time has passed."""
    e = _events(spark, sf_dir)
    mark = e.agg(F.max("ts_us").alias("m"))
    found = matching.outcomes(e, T_US, ID).select(*_SHOWN)
    return found.join(F.broadcast(mark)).where(F.col("response_us").isNull() & (F.col("request_us") < F.col("m") - T_US)).select("user_id", "packet_ordinal", "request_us")  # mark is one row


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = match_outcomes(spark, sf_dir)
    return metrics.outcome_classes(o).crossJoin(metrics.latency(o))  # a row each


_LATENCY = f"""{_FOLD} SELECT (SELECT count(*) FROM o)::BIGINT AS total, (SELECT count(*) FROM o WHERE response_us IS NOT NULL)::BIGINT AS ok, (SELECT count(*) FROM o WHERE response_us IS NULL)::BIGINT AS timeout, 0::BIGINT AS invalid,
  count(*)::BIGINT AS n, sum(response_us - request_us)::DOUBLE / count(*)::DOUBLE AS mean_us, median(response_us - request_us)::DOUBLE AS median_us FROM o WHERE response_us IS NOT NULL"""


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(match_outcomes(spark, sf_dir))


_PERCENTILES = f"""{_FOLD}, d AS (SELECT response_us - request_us AS d, row_number() OVER (ORDER BY response_us - request_us) AS rn, count(*) OVER () AS n FROM o WHERE response_us IS NOT NULL),
p AS (SELECT unnest([0.5, 0.95, 0.99, 0.999])::DOUBLE AS p, unnest([500, 950, 990, 999]) AS m)
SELECT p.p, d.d::BIGINT AS latency_us FROM p JOIN d ON d.rn = greatest(1, (p.m * d.n + 999) // 1000)"""


def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("ts_us", (F.col("packet_ordinal") * 7919 % 1_000_003).alias("packet_ordinal"), F.col("packet_ordinal").alias("event_id"))


def non_monotonic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row where no packet is earlier than the one before it."""
    return metrics.regressions(_shuffled(spark, sf_dir), block=4096).where("regressions > 0")


_REGRESSIONS = """WITH p AS (SELECT event_id * 7919 % 1000003 AS o, epoch_us(ts) AS t FROM events), l AS (SELECT o, t, lag(o) OVER (ORDER BY o) AS po, lag(t) OVER (ORDER BY o) AS pt FROM p),
b AS (SELECT * FROM l WHERE pt > t) SELECT (SELECT count(*) FROM b)::BIGINT AS regressions, po AS previous_ordinal, pt AS previous_ts, o AS ordinal, t AS ts FROM b ORDER BY o LIMIT 1"""


def batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing order within batches of 1024."""
    from pyspark.sql import Window as W

    p = _shuffled(spark, sf_dir).withColumn("batch_id", F.expr("packet_ordinal div 1024"))
    return p.select("event_id", "batch_id", F.row_number().over(W.partitionBy("batch_id").orderBy("ts_us", "packet_ordinal")).cast("bigint").alias("place"))


def flow_key_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    port = lambda c: F.when(c % 3 == 0, 53).otherwise(1024 + c % 5).cast("int")
    p = li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), port(F.col("l_partkey")).alias("sp"), port(F.col("l_suppkey")).alias("dp")).where("sp = 53 or dp = 53")
    return p.select((F.col("sp") == 53).alias("is_response"), *frames.flow_key("src", "sp", "dst", "dp")).groupBy("is_response", "client_port", "resolver_ip").agg(F.count("*").alias("packets"), F.min("client_ip").alias("least_client"))


_FLOWS = """WITH p AS (SELECT l_suppkey AS src, l_partkey AS dst, CASE WHEN l_partkey % 3 = 0 THEN 53 ELSE 1024 + l_partkey % 5 END::INTEGER AS sp, CASE WHEN l_suppkey % 3 = 0 THEN 53 ELSE 1024 + l_suppkey % 5 END::INTEGER AS dp FROM lineitem)
SELECT sp = 53 AS is_response, CASE WHEN sp = 53 THEN dp ELSE sp END AS client_port, CASE WHEN sp = 53 THEN src ELSE dst END AS resolver_ip, count(*)::BIGINT AS packets, min(CASE WHEN sp = 53 THEN dst ELSE src END) AS least_client
FROM p WHERE sp = 53 OR dp = 53 GROUP BY 1, 2, 3"""
_HOST = "^[a-z]+://([^/?#]+)"


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", _HOST, 1).alias("name"))


def catalog_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.top(_hosts(spark, sf_dir), 10)


_ODD = "len(list_filter(string_split({0}, '.'), lambda s: length(s) >= 12 AND (length(regexp_replace(s, '[^0-9]', '', 'g')) >= 6 OR length(regexp_replace(s, '[^0-9A-Fa-f]', '', 'g')) >= 10))) > 0"
_NAMES = f"WITH h AS (SELECT lower(trim(regexp_extract(url, '{_HOST}', 1))) AS name FROM pages), c AS (SELECT name, count(*) AS n FROM h WHERE name <> '' GROUP BY name)"


def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.summary(_hosts(spark, sf_dir), 10, substrings=["7"])


_CATALOG_SUMMARY = f"""{_NAMES}, b AS (SELECT name, ({_ODD.format('name')}) OR contains(name, '7') AS bad FROM c)
SELECT (SELECT count(*) FROM pages)::BIGINT AS rows_read, count(*)::BIGINT AS unique_domains, (count(*) FILTER (WHERE bad))::BIGINT AS filtered_domains, least(10, count(*) FILTER (WHERE NOT bad))::BIGINT AS emitted_domains FROM b"""


def disallowed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page hosts outside the blocked zones: an anti-join on dot suffixes."""
    blocked = _hosts(spark, sf_dir).where("page_id % 7 = 0").select(F.col("name").alias("token"))
    return catalog.without_blocked(_hosts(spark, sf_dir), blocked).groupBy("name").agg(F.count("*").alias("pages"))


_BLOCKED = f"""WITH h AS (SELECT page_id, regexp_extract(url, '{_HOST}', 1) AS name FROM pages), b AS (SELECT DISTINCT lower(name) AS t FROM h WHERE page_id % 7 = 0),
n AS (SELECT DISTINCT name FROM h), bad AS (SELECT DISTINCT n.name FROM n JOIN b ON lower(n.name) = b.t OR ends_with(lower(n.name), '.' || b.t)) SELECT name, count(*)::BIGINT AS pages FROM h WHERE name NOT IN (SELECT name FROM bad) GROUP BY name"""


def _opaque(df: DataFrame) -> DataFrame:
    """df behind a barrier, so that filters see a column rather than the expression that made it, as with a scan."""
    return df.mapInArrow(lambda batches: batches, df.schema)


def _raw_name(name: Column) -> Column:
    """One label of the name's bytes, unescaped, on the wire."""
    return F.concat(F.unhex(encode.hex_number(F.octet_length(name), 2)), F.encode(name, "UTF-8"), F.unhex(F.lit("00")))


def _question(ident: Column, wire: Column, qtype: int = 1) -> Column:
    return F.concat(F.unhex(F.concat(encode.hex_number(ident, 4), F.lit("0100" + "0001" + "0000" * 3))), wire, F.unhex(F.concat(encode.hex_number(F.lit(qtype), 4), F.lit("0001"))))


def qname_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names as labels, through frames, headers and the message decoder."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    ip = lambda x: F.unhex(encode.hex_number(F.lit(0x0A000000) + x, 8))
    data = encode.bare_frame(ip(F.col("c_custkey")), ip(F.lit(1)), F.lit(40000), F.lit(53), _question(F.col("c_custkey") % 65536, _raw_name(F.col("c_name"))))
    packets = c.select("c_custkey", F.col("c_custkey").alias("packet_ordinal"), F.lit(0).cast("bigint").alias("batch_id"), F.lit(0).cast("bigint").alias("ts_us"), data.alias("data"))
    found = decode.events(decode.decode_messages(frames.dns_messages(_opaque(packets.drop("c_custkey")))))
    return found.select(F.col("packet_ordinal").alias("c_custkey"), "name", "qtype")


_PRESENTATION = r"SELECT c_custkey, regexp_replace(left(c_name, 1), '([^0-9A-Za-z_*])', '\\\1') || regexp_replace(substr(c_name, 2), '([^0-9A-Za-z_-])', '\\\1', 'g') AS name, 1 AS qtype FROM customer"


def l2l4_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from supplier keys with a fault of the key modulo 10: 0-3 none, then EtherType, fragment, protocol, port, UDP length, total length."""
    s = _table(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    fault = k % 10
    payload = _question(k % 65536, scalars.wire_name(F.concat(F.lit("s"), k.cast("string"), F.lit(".example"))))
    n = F.octet_length(payload)
    two = lambda x: encode.hex_number(x, 4)
    head = F.concat(
        F.lit("000102030405060708090A0B"), F.when(fault == 4, "8100").otherwise("0800"), F.lit("4500"), two(F.when(fault == 9, n + 29).otherwise(n + 28)), F.lit("0000"), F.when(fault == 5, "2000").otherwise("4000"), F.lit("40"),
        F.when(fault == 6, "06").otherwise("11"), F.lit("0000"), encode.hex_number(F.lit(0x0A000000) + k, 8), F.lit("08080808"), F.lit("9C40"), F.when(fault == 7, "007B").otherwise("0035"), two(F.when(fault == 8, F.lit(7)).otherwise(n + 8)), F.lit("0000"),
    )
    packets = s.select(k.alias("packet_ordinal"), F.concat(F.unhex(head), payload).alias("data"))
    return frames.dns_messages(_opaque(packets)).select(F.col("packet_ordinal").alias("s_suppkey"), "is_response", scalars.ip_text(F.col("client_ip")).alias("client"), "client_port", F.octet_length("dns").cast("bigint").alias("dns_bytes"))


_L2L4 = """SELECT s_suppkey, FALSE AS is_response, concat('10.', (s_suppkey // 65536) % 256, '.', (s_suppkey // 256) % 256, '.', s_suppkey % 256) AS client, 40000 AS client_port,
  (12 + 1 + 1 + length(s_suppkey::VARCHAR) + 8 + 1 + 4)::BIGINT AS dns_bytes FROM supplier WHERE s_suppkey % 10 < 4"""


def rcode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 30).cast("int").alias("code"), F.when(F.col("p_partkey") % 2 == 0, "EdnsOpt").otherwise("Header").alias("ctx"))
    return p.select("p_partkey", scalars.rcode_text(F.col("code"), F.col("ctx")).alias("response_code"))


def rcode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*(F.lit(x) for x in _CODE_TEXTS))
    p = _table(spark, sf_dir, "part").select("p_partkey", F.element_at(texts, (F.col("p_partkey") % len(_CODE_TEXTS) + 1).cast("int")).alias("text"))
    return p.select("p_partkey", "text", scalars.rcode_parse(F.col("text")).alias("code"))


#: Texts of codes and the numbers they stand for, written out for the oracle.
_CODES_OF_TEXTS = (
    ("No Error", 0), ("NXDOMAIN", 3), ("serv_fail", 2), ("Form-Err", 1), ("Not Implemented", 4), ("REFUSED", 5), ("16", 16), ("65535", 65535), ("65536", None), ("what", None),
    ("BADVERS", 16), ("Query Refused", 5), ("Name not in zone", 10), ("Bad Option Versions", 16), ("name not contained in zone", None), ("Bad-Server_Cookie", 23), ("RR Set does not exist", 8), ("TSIG Failure", 16),
)
_CODE_TEXTS = tuple(text for text, _ in _CODES_OF_TEXTS)
#: Texts of the codes 0 to 29 and names of the record types 0 to 299, written out for the oracle.
_TEXTS_OF_CODES = (
    "No Error|Form Error|Server Failure|Non-Existent Domain|Not Implemented|Query Refused|Name should not exist|RR Set should not exist|RR Set does not exist|Not authorized|Name not in zone"
    "|11|12|13|14|15|TSIG Failure|Key not recognized|Signature out of time window|Bad TKEY mode|Duplicate key name|Algorithm not supported|Bad truncation|Bad server cookie|24|25|26|27|28|29"
)
_NAMES_OF_TYPES = (
    "Unknown A NS MD MF CNAME SOA MB MG MR NULL WKS PTR HINFO MINFO MX TXT RP AFSDB X25 ISDN RT NSAP NSAP-PTR SIG KEY PX GPOS AAAA LOC NXT EID NIMLOC SRV ATMA NAPTR KX CERT A6 DNAME SINK OPT APL DS"
    " SSHFP IPSECKEY RRSIG NSEC DNSKEY DHCID NSEC3 NSEC3PARAM TLSA SMIMEA Unknown HIP NINFO RKEY TALINK CDS CDNSKEY OPENPGPKEY CSYNC ZONEMD SVCB HTTPS"
)
_LATER_TYPES = "CASE p_partkey % 300 WHEN 99 THEN 'SPF' WHEN 108 THEN 'EUI48' WHEN 109 THEN 'EUI64' WHEN 249 THEN 'TKEY' WHEN 250 THEN 'TSIG' WHEN 251 THEN 'IXFR' WHEN 252 THEN 'AXFR' WHEN 253 THEN 'MAILB' WHEN 254 THEN 'MAILA' WHEN 255 THEN 'ANY' WHEN 256 THEN 'URI' WHEN 257 THEN 'CAA' ELSE 'Unknown' END"


def _case(column: str, entries: dict, other: str) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in entries.items()) + f" ELSE {other} END"


def qtype_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", scalars.qtype_text((F.col("p_partkey") % 300).cast("int")).alias("query_type"))


def oversized_qname_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of as many 31-byte labels as the key modulo 12 says: eight and more are too long."""
    p = _table(spark, sf_dir, "part").select("p_partkey")
    name = F.array_join(F.array_repeat(F.lit("a" * 31), (F.col("p_partkey") % 12).cast("int")), ".")
    m = p.select(F.col("p_partkey").alias("packet_ordinal"), F.lit(False).alias("is_response"), _question(F.col("p_partkey") % 65536, scalars.wire_name(F.when(name == "", ".").otherwise(name))).alias("dns"))
    return metrics.decode_counts(decode.decode_messages(m))


def anonymize_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.unhex(encode.hex_number(F.lit(0x0A000000) + F.col("c_custkey"), 8)).alias("ip"))
    return c.select("c_custkey", scalars.ip_text(anonymize.pseudonym(F.col("ip"), anonymize.derive_key("secret"))).alias("pseudonym"))


def _traffic(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    names = spark.createDataFrame([(10, "example.com"), (8, "www.example.org"), (1, "."), (1, "1.2.0.192.in-addr.arpa")], "weight int, name string")
    t = traffic.transactions(spark, traffic.DEFAULT, names, 5000, seed=7, qps=100.0, clients=12, resolvers=3)
    return t, traffic.packets(t, traffic.DEFAULT, 7)


def generate_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.summary(*_traffic(spark))


def generated_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated packets, framed, decoded and matched: the counters of the run."""
    _, rows = _traffic(spark)
    framed = traffic.frames(rows).withColumn("packet_ordinal", F.monotonically_increasing_id()).withColumn("batch_id", F.lit(0).cast("bigint"))
    events = decode.events(decode.decode_messages(frames.dns_messages(_opaque(framed))))
    return matching.counters(events, 1_200_000)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = match_outcomes(spark, sf_dir)
    own = o.select(
        F.unhex(encode.hex_number(F.lit(0x0A000000) + F.col("user_id"), 8)).alias("client_ip"), (F.col("user_id") % 65536).cast("int").alias("client_port"), (F.col("packet_ordinal") % 65536).cast("int").alias("id"),
        F.concat(F.lit("u,"), F.col("user_id").cast("string"), F.lit('\\".example')).alias("name"), F.lit(1).alias("qtype"), "request_us", "response_us", "rcode", F.lit("Header").alias("rcode_ctx"),
    )
    return sinks.records(own)


def _round_trip(spark: SparkSession, sf_dir: str, parquet: bool) -> DataFrame:
    import uuid

    from .plans.run import round_trip

    base = spark.conf.get("spark.checkpoint.dir", None) or SHARED
    return round_trip(_records(spark, sf_dir), f"{base}/sink-{uuid.uuid4().hex}", parquet)


def sink_roundtrip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, False)


def sink_roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, True)


def capture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as DNS packets in a capture, in time order, a section for each task, read back in batches of 1,024, decoded and matched."""
    import uuid

    from .plans import run
    from .sources import pcap

    e = _events(spark, sf_dir)
    client, resolver, port = F.unhex(encode.hex_number(F.lit(0x0A000000) + F.col("user_id"), 8)), F.unhex(F.lit("08080808")), 1024 + F.col("user_id") % 60000
    ident, name, one = F.col("user_id") % 65536, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example")), F.lit(1)
    asked = encode.bare_frame(client, resolver, port, F.lit(53), encode.query(ident, name, one))
    told = encode.bare_frame(resolver, client, F.lit(53), port, encode.response(ident, name, one, F.col("rcode"), resolver))
    packets = e.select("ts_us", "packet_ordinal", F.when(F.col("is_query"), asked).otherwise(told).alias("data")).orderBy("ts_us", "packet_ordinal")
    found = pcap.write_sections(packets, f"{spark.conf.get('spark.checkpoint.dir', None) or SHARED}/capture-{uuid.uuid4().hex}")
    events = decode.events(run.sections(spark, found, batch_packets=1024, content="messages"))
    return sinks.records(matching.outcomes(events, T_US))


_CAPTURE = f"""{_FOLD} SELECT request_us AS request_timestamp, response_us AS response_timestamp, concat('10.', (user_id // 65536) % 256, '.', (user_id // 256) % 256, '.', user_id % 256) AS source_ip, (1024 + user_id % 60000)::INTEGER AS source_port,
  (user_id % 65536)::INTEGER AS id, concat('u', user_id, '.example') AS name, 'A' AS query_type, CASE rcode WHEN 0 THEN 'No Error' WHEN 2 THEN 'Server Failure' END AS response_code FROM o"""

_SINK = f"""{_FOLD} SELECT request_us AS request_timestamp, response_us AS response_timestamp, concat('10.', (user_id // 65536) % 256, '.', (user_id // 256) % 256, '.', user_id % 256) AS source_ip, (user_id % 65536)::INTEGER AS source_port,
  (packet_ordinal % 65536)::INTEGER AS id, concat('u,', user_id, '\\".example') AS name, 'A' AS query_type, CASE rcode WHEN 0 THEN 'No Error' WHEN 2 THEN 'Server Failure' END AS response_code FROM o"""

QUERIES = {
    f.__name__: f
    for f in (
        match_outcomes, match_outcomes_general, match_counters, retry_dedup, timeouts, orphan_responses, monotonic_eviction, latency_summary, latency_percentiles, non_monotonic_scan, batch_order, flow_key_rollup,
        catalog_topk, catalog_summary, disallowed_domains, qname_presentation, l2l4_filter, rcode_text, rcode_parse, qtype_text, oversized_qname_count, anonymize_ip, generate_traffic, generated_round_trip,
        sink_roundtrip_csv, sink_roundtrip_parquet, capture_records,
    )
}
SQL = {
    "match_outcomes": _OUTCOMES,
    "match_outcomes_general": _OUTCOMES,
    "match_counters": _COUNTERS,
    "retry_dedup": f"{_FOLD} SELECT user_id, sum(dup)::BIGINT AS dup_queries FROM f GROUP BY user_id HAVING sum(dup) > 0",
    "timeouts": f"{_FOLD} SELECT user_id, packet_ordinal, request_us FROM o WHERE response_us IS NULL",
    "orphan_responses": _ORPHANS,
    "monotonic_eviction": f"{_FOLD} SELECT user_id, packet_ordinal, request_us FROM o WHERE response_us IS NULL AND request_us < (SELECT max(t) FROM e) - {T_US}",
    "latency_summary": _LATENCY,
    "latency_percentiles": _PERCENTILES,
    "non_monotonic_scan": _REGRESSIONS,
    "batch_order": "WITH p AS (SELECT event_id, epoch_us(ts) AS t, event_id * 7919 % 1000003 AS o FROM events) SELECT event_id, (o // 1024)::BIGINT AS batch_id, (row_number() OVER (PARTITION BY o // 1024 ORDER BY t, o))::BIGINT AS place FROM p",
    "flow_key_rollup": _FLOWS,
    "catalog_topk": f"{_NAMES} SELECT name, n::BIGINT AS \"count\" FROM c WHERE NOT ({_ODD.format('name')}) ORDER BY n DESC, name LIMIT 10",
    "catalog_summary": _CATALOG_SUMMARY,
    "disallowed_domains": _BLOCKED,
    "qname_presentation": _PRESENTATION,
    "l2l4_filter": _L2L4,
    "rcode_text": f"SELECT p_partkey, CASE WHEN p_partkey % 30 = 16 AND p_partkey % 2 = 0 THEN 'EDNS_BADVERS' ELSE string_split('{_TEXTS_OF_CODES}', '|')[p_partkey % 30 + 1] END AS response_code FROM part",
    "rcode_parse": f"SELECT p_partkey, {_case(f'p_partkey % {len(_CODE_TEXTS)}', dict(enumerate(_CODE_TEXTS)), 'NULL')} AS text, ({_case(f'p_partkey % {len(_CODE_TEXTS)}', {k: 'NULL' if n is None else n for k, (_, n) in enumerate(_CODES_OF_TEXTS)}, 'NULL')})::INTEGER AS code FROM part".replace("'NULL'", "NULL"),
    "qtype_text": f"SELECT p_partkey, CASE WHEN p_partkey % 300 <= 65 THEN string_split('{_NAMES_OF_TYPES}', ' ')[p_partkey % 300 + 1] ELSE {_LATER_TYPES} END AS query_type FROM part",
    "oversized_qname_count": "SELECT (count(*) FILTER (WHERE p_partkey % 12 < 8))::BIGINT AS decoded_msgs, (count(*) FILTER (WHERE p_partkey % 12 >= 8))::BIGINT AS oversized_qname_msgs, 0::BIGINT AS invalid_msgs FROM part",
    "capture_records": _CAPTURE,
    "sink_roundtrip_csv": _SINK,
    "sink_roundtrip_parquet": _SINK,
}
