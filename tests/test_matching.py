"""The matcher's rules, and its lanes against each other."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nameflow.operators.matching import counters, evicted, general_fold, outcomes, ratios
from nameflow.schemas import EVENTS

T = 1_200_000


def event(ts, q, packet=0, record=0, batch=0, rcode=0):
    return {"batch": batch, "ts": ts, "packet": packet, "record": record, "q": q, "rcode": None if q else rcode, "ctx": None if q else "Header"}


def rows(events, name="example.com", port=53000, resolver=b"\x08" * 4):
    return [(e["batch"], e["ts"], e["packet"], e["record"], e["q"], 42, name, 1, b"\x0a\0\0\x01", port, resolver, e["rcode"], e["ctx"]) for e in events]


CASES = {
    "retry": ([event(1000, True, 0), event(1300, True, 1), event(1500, False, 2)], T, [(1000, 1500)], 1),
    "earlier key stays though it comes later": ([event(1300, True, 0), event(1000, True, 1, batch=1)], T, [(1000, None)], 1),
    "boundary counts": ([event(1_000_000, True), event(2_200_000, False, 1)], T, [(1_000_000, 2_200_000)], 0),
    "last query within the timeout": ([event(1_000_000, True), event(1_300_000, True, 1), event(1_500_000, False, 2)], 200_000, [(1_000_000, None), (1_300_000, 1_500_000)], 0),
    "lone query": ([event(5, True)], T, [(5, None)], 0),
    "response first": ([event(1500, False, 0), event(1000, True, 1, batch=1)], T, [(1000, 1500)], 0),
    "orphan": ([event(1500, False)], T, [], 0),
    "same time": ([event(7, False, 0), event(7, True, 1)], T, [(7, 7)], 0),
}


@pytest.mark.parametrize("name", CASES)
def test_rules(name):
    events, timeout, want, dup = CASES[name]
    got, n = general_fold(sorted(events, key=lambda e: (e["batch"], e["ts"], e["packet"], e["record"])), timeout)
    assert sorted((o["q_ts"], o["r_ts"]) for o in got) == sorted(want, key=lambda x: x[0]) and n == dup


def test_rules_as_plans(spark):
    for i, (events, timeout, want, dup) in enumerate(CASES.values()):
        df = spark.createDataFrame(rows(events, f"n{i}"), EVENTS)
        got = sorted((r.request_us, r.response_us) for r in outcomes(df, timeout).collect())
        assert got == sorted(want, key=lambda x: x[0])
        c = counters(df, timeout).first()
        assert (c.dup_queries, c.dns_queries) == (dup, sum(e["q"] for e in events)) and c.dns_queries == c.matched + c.timeouts + c.dup_queries


def test_identities_are_apart(spark):
    a = rows([event(1000, True, 0), event(1200, False, 3)], resolver=b"\x01" * 4)
    b = rows([event(1050, True, 1), event(1100, False, 2)], resolver=b"\x02" * 4)
    got = sorted((r.request_us, r.response_us) for r in outcomes(spark.createDataFrame(a + b, EVENTS), T).collect())
    assert got == [(1000, 1200), (1050, 1100)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.booleans(), st.integers(0, 1)), max_size=12), st.integers(1, 12))
def test_sessions_do_not_change_the_fold(events, timeout):
    es = sorted((event(t, q, i, batch=b) for i, (t, q, b) in enumerate(events)), key=lambda e: (e["batch"], e["ts"], e["packet"]))
    whole, dup = general_fold(es, timeout)
    times, cut = sorted({e["ts"] for e in es}), {}
    for a, b in zip([None, *times], times, strict=False):
        cut[b] = 0 if a is None else cut[a] + (b - a > timeout)
    parts, dups = [], 0
    for s in set(cut.values()):
        o, d = general_fold([e for e in es if cut[e["ts"]] == s], timeout)
        parts, dups = parts + o, dups + d
    assert sorted(map(repr, whole)) == sorted(map(repr, parts)) and dup == dups
    assert sum(e["q"] for e in es) == len(whole) + dup
    assert all(o["r_ts"] is None or 0 <= o["r_ts"] - o["q_ts"] <= timeout for o in whole)


def test_lanes_agree(spark):
    import random

    r, data = random.Random(3), []
    for k in range(400):
        ts, es = 0, []
        for i in range(r.randint(1, 9)):
            ts = ts + r.choice([0, 0, 1, 2, 5, 30]) if k % 3 else r.randint(0, 40)
            es.append(event(ts, r.random() < 0.55, i, batch=0 if k % 3 else i % 2))
        data += rows(es, f"n{k}")
    df = spark.createDataFrame(data, EVENTS)
    key = lambda d: sorted(map(repr, d.collect()))
    want = key(outcomes(df, 10, lane="general"))
    assert key(outcomes(df, 10)) == want and key(outcomes(df.repartition(3), 10)) == want


def test_empty_and_ratios(spark):
    none = spark.createDataFrame([], EVENTS)
    assert outcomes(none, T).count() == 0
    c = ratios(counters(none, T)).first()
    assert c.dns_queries == 0 and c.timed_out_query_ratio == 0.0 and c.average_rtt_ms is None


def test_eviction_is_strict(spark):
    df = outcomes(spark.createDataFrame(rows([event(1_000_000, True)]), EVENTS), T)
    assert evicted(df, 2_200_000, T).count() == 0 and evicted(df, 2_500_000, T).count() == 1
