"""Record sinks: CSV and Parquet with the engine's schema, a stream of CSV lines, and the run summary."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import ip_text, qtype_text, rcode_text
from .operators.anonymize import pseudonym
from .schemas import RECORD_COLUMNS

HEADER = ",".join(RECORD_COLUMNS)
PARQUET_ROWS = 65_536


def records(outcome: DataFrame, key: bytes | None = None) -> DataFrame:
    """Outcomes as exported rows, times in microseconds; with a key client addresses are pseudonyms."""
    ip = pseudonym(F.col("client_ip"), key) if key else F.col("client_ip")
    return outcome.select(
        F.col("request_us").alias("request_timestamp"), F.col("response_us").alias("response_timestamp"), ip_text(ip).alias("source_ip"), F.col("client_port").alias("source_port"), "id", "name",
        qtype_text(F.col("qtype")).alias("query_type"), F.when(F.col("response_us").isNotNull(), rcode_text(F.col("rcode"), F.col("rcode_ctx"))).alias("response_code"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.select(*RECORD_COLUMNS).write.options(header=True, quote='"', escape='"', nullValue="", emptyValue="", lineSep="\n").csv(path)


def write_parquet(rows: DataFrame, path: str, zstd: bool = False, v2: bool = False) -> None:
    spark = rows.sparkSession
    name, before = "spark.sql.parquet.outputTimestampType", spark.conf.get("spark.sql.parquet.outputTimestampType")
    spark.conf.set(name, "TIMESTAMP_MICROS")
    try:
        typed = rows.withColumns({c: F.timestamp_micros(c) for c in ("request_timestamp", "response_timestamp")}).select(*RECORD_COLUMNS)
        options = {"compression": "zstd" if zstd else "snappy", "parquet.writer.version": "v2" if v2 else "v1", "parquet.block.row.count.limit": str(PARQUET_ROWS), "parquet.enable.dictionary": "false"}
        options |= {f"parquet.enable.dictionary#{c}": "true" for c in ("query_type", "response_code")}
        if zstd:
            options["parquet.compression.codec.zstd.level"] = "10"
        typed.write.options(**options).parquet(path)
    finally:
        spark.conf.set(name, before)


def csv_field(value) -> str:
    s = "" if value is None else str(value)
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n\r') else s


def csv_lines(rows: DataFrame) -> Iterator[str]:
    """Lines for a stream; rows come partition by partition."""
    yield HEADER + "\n"
    for r in rows.select(*RECORD_COLUMNS).toLocalIterator(prefetchPartitions=True):
        yield ",".join(map(csv_field, r)) + "\n"


def summary_json(summary: dict) -> str:
    return json.dumps(summary, separators=(",", ":")) + "\n"


def summary_text(summary: dict) -> str:
    m = summary["metrics"]
    lines = [f"{k.replace('_', ' ')}: {v:,}" if isinstance(v, int) else f"{k.replace('_', ' ')}: {'n/a' if v is None else format(v, '.6f')}" for k, v in m.items()]
    lines.append(f"elapsed: {duration(m['total_runtime_seconds'])}")
    if late := summary["warnings"]["non_monotonic_capture_timestamps"]:
        lines.append("warning: " + ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in late.items()))
    return "\n".join(lines) + "\n"


def duration(seconds: float) -> str:
    ms = round(seconds * 1000)
    return f"{ms // 3_600_000:02}:{ms // 60_000 % 60:02}:{ms // 1000 % 60:02}.{ms % 1000:03}"
