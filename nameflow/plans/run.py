"""The engine's plan: capture -> packets -> messages -> events -> outcomes -> records, and its summary."""

from __future__ import annotations

import os
import platform
import resource
import time
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..config import Config
from ..operators import anonymize, decode, frames, matching, metrics
from ..schemas import BATCH_PACKETS
from ..sources import pcap


def packets(spark: SparkSession, path: str, batch_packets: int = BATCH_PACKETS, monotonic: bool = False, index: pcap.Index | None = None, content: str = "packets") -> DataFrame:
    """index: what inspect() found with the same batch_packets, where it is known.  content: `packets` or `messages`."""
    spark.dataSource.register(pcap.CaptureSource)
    known = pcap.as_option({path: index}) if index else ""
    return spark.read.format("capture").options(batchPackets=batch_packets, monotonic=str(monotonic).lower(), index=known, content=content).load(path)


def sections(spark: SparkSession, found: dict[str, pcap.Index], batch_packets: int = BATCH_PACKETS, content: str = "packets") -> DataFrame:
    """One capture in the sections that write_sections() found, read as packets() would read it from one file."""
    spark.dataSource.register(pcap.CaptureSource)
    return spark.read.format("capture").options(batchPackets=batch_packets, sections="true", index=pcap.as_option(found), content=content).load(",".join(found))


def decoded(raw: DataFrame) -> DataFrame:
    return decode.decode_messages(frames.dns_messages(raw))


def outcomes(events: DataFrame, timeout_us: int, index: pcap.Index | None = None, monotonic: bool = False) -> DataFrame:
    """Outcomes of a capture; if its reading failed, its end settles nothing: pending queries are left out, but for
    those that monotonic eviction had settled with the last whole batch."""
    found = matching.outcomes(events, timeout_us)
    if index is None or not index.failure:
        return found
    settled = found.where("response_us is not null")
    if monotonic and index.batches:
        settled = settled.union(matching.evicted(found, index.batches[-1].max_ts, timeout_us))
    return settled


def run(spark: SparkSession, c: Config, stdout=None) -> dict:
    """Runs a configuration and returns its summary.  A damaged capture is written as far as it is whole, then raised.

    Counters of the match are observed on the records as they are written, behind any sort, so that each counts once;
    where records are streamed or left out, the match runs again for them."""
    began = time.time()
    index = pcap.inspect(c.input, monotonic=c.monotonic)
    key = anonymize.derive_key(anonymize.read_passphrase(c.key_file), Path(c.salt_file).read_bytes() if c.salt_file else anonymize.SALT) if c.key_file else None
    messages = packets(spark, c.input, index=index, content="messages").persist()
    try:
        events = decode.events(messages)
        found = outcomes(events, c.timeout_us, index, c.monotonic)
        rows = sinks.records(found, key)
        if c.canonical_order:
            rows = rows.orderBy("request_timestamp", "id", "name", "source_ip", "source_port", "query_type")
        wrote, seen = time.time(), Observation()
        if c.output != "-":
            rows = rows.observe(seen, *metrics.record_counts())
        if c.output == "-":
            for line in sinks.csv_lines(rows):
                stdout.write(line)
        elif c.format == "csv":
            sinks.write_csv(rows, c.output)
        else:
            sinks.write_parquet(rows, c.output, c.zstd, c.parquet_v2)
        tail = time.time() - wrote
        counts = metrics.decode_counts(messages, questions=True).first().asDict()
        if c.output == "-" or index.failure:
            counts |= matching.ratios(matching.counters(events, c.timeout_us)).first().asDict()
        else:  # each query is a record, or repeats one: the records say what the match came to
            counts |= seen.get
            counts["dup_queries"] = counts["dns_queries"] - counts["matched"] - counts["timeouts"]
            counts["timed_out_query_ratio"] = counts["timeouts"] / counts["dns_queries"] if counts["dns_queries"] else 0.0
            counts["average_rtt_ms"] = counts["matched_rtt_sum_us"] / counts["matched"] / 1000.0 if counts["matched"] else None
        if index.failure:
            counts["timeouts"] = found.where("response_us is null").count()
    finally:
        messages.unpersist()
    seconds = time.time() - began
    summary = {
        "build": {"name": "nameflow", "os": platform.system().lower(), "arch": platform.machine(), "pid": os.getpid()},
        "config": asdict(c),
        "execution": {"available_cpus": os.cpu_count(), "model": "spark", "master": spark.sparkContext.master, "default_parallelism": spark.sparkContext.defaultParallelism},
        "metrics": {
            # fixed names of the summary's metrics
            "total_packets_processed": index.packets,
            "dns_messages_rejected_oversized_qname": counts["oversized_qname_msgs"],
            "total_dns_queries_processed": counts["dns_queries"],
            "deduplicated_duplicate_queries": counts["dup_queries"],
            "total_dns_responses_processed": counts["dns_responses"],
            "total_matched_query_response_pairs": counts["matched"],
            "timed_out_queries": counts["timeouts"],
            "timed_out_query_ratio": counts["timed_out_query_ratio"],
            "average_matched_rtt_ms": counts["average_rtt_ms"],
            "processing_seconds": max(seconds - tail, 0.0),
            "processing_speed_pps": metrics.packets_per_second(index.packets, seconds),
            "final_write_post_processing_seconds": tail,
            "max_memory_usage_kib": peak_kib(spark),
            "total_runtime_seconds": seconds,
            "decoded_messages": counts["decoded_msgs"],
            "invalid_messages": counts["invalid_msgs"],
        },
        "warnings": {"non_monotonic_capture_timestamps": regressions(index), "graceful_signal_shutdown": False},
    }
    if index.failure:
        raise pcap.CaptureError(f"{c.input}: {index.failure}; {index.packets} packets of whole batches were processed")
    return summary


def regressions(index: pcap.Index) -> dict | None:
    """The warning of packets that are earlier than the one before them: their number, and the first."""
    if not index.regressions:
        return None
    before, before_ts, packet, ts = index.sample
    return {
        "count": index.regressions, "previous_packet_ordinal": before, "previous_timestamp_micros": before_ts, "current_packet_ordinal": packet,
        "current_timestamp_micros": ts, "recommendation": "put the capture in order with reordercap",
    }


def peak_kib(spark: SparkSession) -> int:
    """Peak resident memory of the driver: this process and its JVM (in local mode that is all but Python workers)."""
    own = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    try:
        status = Path(f"/proc/{spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()}/status").read_text()
    except OSError:
        return own
    return own + sum(int(line.split()[1]) for line in status.splitlines() if line.startswith("VmHWM:"))


def round_trip(rows: DataFrame, folder: str, parquet: bool) -> DataFrame:
    """Records written and read again."""
    spark = rows.sparkSession
    if parquet:
        sinks.write_parquet(rows, folder)
        back = spark.read.parquet(folder)
        return back.withColumns({c: F.unix_micros(c) for c in ("request_timestamp", "response_timestamp")})
    sinks.write_csv(rows, folder)
    kinds = "request_timestamp BIGINT, response_timestamp BIGINT, source_ip STRING, source_port INT, id INT, name STRING, query_type STRING, response_code STRING"
    return spark.read.schema(kinds).options(header=True, quote='"', escape='"', multiLine=True).csv(folder)
