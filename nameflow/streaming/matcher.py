"""The matcher as a stateful stream: queries and responses pair across micro-batches.

State per identity is its waiting queries and responses.  An event-time timer settles what the watermark has passed: queries
strictly earlier than the watermark less the timeout become timeouts, responses so old are dropped.  Timers and watermarks have
milliseconds, so the microseconds are compared again when a timer fires.  On input in time order the rows are those of the
batch plan; events at or
before the watermark are late and not taken.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.matching import general_fold
from ..schemas import EVENT_ORDER, IDENTITY


def _advance(state: list[dict], new: list[dict], timeout_us: int, watermark_us: int | None) -> tuple[list[dict], list[dict]]:
    """(rows settled now, what still waits): the fold over waiting and new events; outcomes without a response are
    still waiting unless the watermark has passed them."""
    out, _ = general_fold(state + new, timeout_us)
    done = [o for o in out if o["r_ts"] is not None]
    taken = {(o["q_ts"], o["q_packet"], o["q_record"]) for o in done}
    open_ = {(o["q_ts"], o["q_packet"], o["q_record"]): o for o in out if o["r_ts"] is None}
    used: dict[int, int] = {}
    for o in done:
        used[o["r_ts"]] = used.get(o["r_ts"], 0) + 1
    wait, late = [], []
    for e in state + new:
        old = watermark_us is not None and e["ts"] < watermark_us - timeout_us
        key = (e["ts"], e["packet"], e["record"])
        if e["q"]:
            if key in open_:
                (late if old else wait).append(open_[key] if old else e)
        elif used.get(e["ts"], 0):
            used[e["ts"]] -= 1
        elif not old:
            wait.append(e)
    assert not taken & set(open_)
    return done + late, wait


def stream_outcomes(events: DataFrame, timeout_us: int, identity: Sequence[str] = IDENTITY, delay: str = "0 seconds") -> DataFrame:
    """Outcomes of a stream of events with a column event_time (timestamp of ts_us); append mode."""
    keys = list(identity)
    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in keys)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        new: list[dict] = []
        for f in frames:
            for r in f.sort_values(list(EVENT_ORDER)).itertuples():
                new.append({"batch": int(r.batch_id), "ts": int(r.ts_us), "packet": int(r.packet_ordinal), "record": int(r.record_ordinal), "q": bool(r.is_query), "rcode": None if pd.isna(r.rcode) else int(r.rcode), "ctx": r.rcode_ctx if isinstance(r.rcode_ctx, str) else None})
        mark = state.getCurrentWatermarkMs() * 1000 or None
        rows, left = _advance(held, sorted(new, key=lambda e: (e["ts"], e["packet"], e["record"])), timeout_us, mark)
        if left:
            state.update((json.dumps(left),))
            due = (min(e["ts"] for e in left) + timeout_us) // 1000 + 2
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([[*key, o["q_ts"], o["q_packet"], o["q_record"], o["r_ts"], o["rcode"], o["rcode_ctx"]] for o in rows], columns=[*keys, "request_us", "packet_ordinal", "record_ordinal", "response_us", "rcode", "rcode_ctx"]).astype({"response_us": "Int64", "rcode": "Int32"})

    marked = events.withWatermark("event_time", delay)
    schema = f"{kinds}, request_us bigint, packet_ordinal bigint, record_ordinal int, response_us bigint, rcode int, rcode_ctx string"
    return marked.groupBy(*keys).applyInPandasWithState(run, schema, "waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_micros("ts_us"))
