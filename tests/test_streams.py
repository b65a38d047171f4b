"""Streams with state of their own against plain loops, over batches and restarts."""

import datetime
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import Row, functions as F

from vouch.streaming import feeds, stateful

T0 = datetime.datetime(2024, 1, 1)
H = datetime.timedelta(hours=1)


def frames(spark, rows, schema, cuts, time=lambda r: r[2]):
    """Rows dealt into parts at the cuts."""
    edges = [datetime.datetime.min, *cuts, datetime.datetime.max]
    return [spark.createDataFrame([r for r in rows if a <= time(r) < b], schema) for a, b in zip(edges, edges[1:])]


CODES = "number long, id long, ts timestamp, kind string, code string, expires_at timestamp, most int"


def code_rows(seed, n=240):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ts = T0 + datetime.timedelta(minutes=rng.randrange(6000), microseconds=i)
        kind = "issue" if rng.random() < 0.3 else "attempt"
        rows.append((rng.randrange(6), i, ts, kind, rng.choice("abc"), ts + rng.choice([1, 5, 20]) * H if kind == "issue" else None, 2))
    return sorted(rows, key=lambda r: r[2])


def codes_by_loops(rows, upto):
    """Event by event; codes that are open at the end expire by the clock `upto`."""
    held, out = {}, []
    for number, i, ts, kind, code, expires, most in [*rows, *[(k, None, None, "end", None, None, 0) for k in {r[0] for r in rows}]]:
        own = held.get(number)
        if own and own["status"] == "open" and (own["expires"] <= ts if ts else own["expires"] < upto):
            out.append((number, None, "expire", own["tries"], own["expires"]))
            own["status"] = "expired"
        if kind == "end":
            continue
        if kind == "issue":
            held[number] = {"code": code, "expires": expires, "most": most, "tries": 0, "status": "open"}
            out.append((number, i, "issued", 0, ts))
        elif own is None:
            out.append((number, i, "not_found", 0, ts))
        elif own["status"] != "open":
            out.append((number, i, {"verified": "already_used", "expired": "expired"}[own["status"]], own["tries"], ts))
        elif own["tries"] >= own["most"]:
            out.append((number, i, "max_attempts_exceeded", own["tries"], ts))
        else:
            own["tries"] += 1
            if code == own["code"]:
                own["status"] = "verified"
            out.append((number, i, "verified" if code == own["code"] else "invalid_code", own["tries"], ts))
    return sorted(out, key=str)


@pytest.mark.parametrize("cuts", [[], [T0 + 30 * H, T0 + 31 * H, T0 + 70 * H]])
def test_codes(spark, tmp_path, cuts):
    """However events are dealt into batches, each code expires once, by a timer where no event of its number follows."""
    rows = code_rows(1)
    rows.append((99, 1000, T0, "issue", "a", T0 + H, 2))  # nothing but the clock ends this one
    rows.sort(key=lambda r: r[2])
    found = stateful.drain_parts(frames(spark, rows, CODES, cuts), f"file://{tmp_path}", stateful.code_events)
    told = sorted(((r.number, r.id, r.status, r.attempts, r.happened_at) for r in found.collect()), key=str)
    assert told == codes_by_loops(rows, rows[-1][2] - H)
    assert (99, None, "expire", 0, T0 + H) in told and {t[2] for t in told} >= {"not_found", "verified", "invalid_code", "max_attempts_exceeded", "expired", "already_used"}


def test_codes_are_forgotten(spark, tmp_path):
    """Past its end and what it is kept for, a code is not found any more."""
    rows = [(1, 0, T0, "issue", "a", T0 + H, 2), (2, 1, T0 + 5 * H, "attempt", "a", None, 2), (1, 2, T0 + 6 * H, "attempt", "a", None, 2), (2, 3, T0 + 40 * H, "attempt", "a", None, 2), (1, 4, T0 + 41 * H, "attempt", "a", None, 2)]
    parts = frames(spark, rows, CODES, [T0 + 2 * H, T0 + 6 * H, T0 + 30 * H, T0 + 41 * H])
    found = stateful.drain_parts(parts, f"file://{tmp_path}", lambda s: stateful.code_events(s, forget="10 hours"))
    assert {r.id: r.status for r in found.collect() if r.number == 1} == {0: "issued", None: "expire", 2: "expired", 4: "not_found"}


@pytest.mark.parametrize("cuts", [[], [T0 + 20 * H, T0 + 90 * H, T0 + 91 * H]])
def test_cache(spark, tmp_path, cuts):
    rng = random.Random(2)
    rows = [(rng.choice("pq"), rng.choice(["x", "y", None]), T0 + datetime.timedelta(minutes=rng.randrange(9000), microseconds=i), i) for i in range(150)]
    parts = frames(spark, rows, "query string, provider string, ts timestamp, id long", cuts)
    found = {r.id: (r.hit, r.cached_at) for r in stateful.drain_parts(parts, f"file://{tmp_path}", lambda s: stateful.cached_requests(s, 24)).collect()}
    at, expected = {}, {}
    for q, p, ts, i in sorted(rows, key=lambda r: r[2]):
        hit = (q, p) in at and ts - at[q, p] < 24 * H
        if not hit:
            at[q, p] = ts
        expected[i] = (hit, at[q, p])
    assert found == expected and len({h for h, _ in found.values()}) == 2


JOBS = "job_id long, n int, ts timestamp, status string, retry_count int, max_retries int, server string, started_at timestamp"


def test_recovery(spark, tmp_path):
    """One run equals one that is stopped and taken up twice; what is tracked at first goes in only once it has ended."""
    rng, rows = random.Random(3), []
    for i in range(200):
        ts = T0 + datetime.timedelta(minutes=7 * i)
        status = rng.choice(["pending", "pending", "processing", "done", "failed"])
        rows.append((rng.randrange(15), i, ts, status, rng.randrange(4), 3, rng.choice(["s", "s", None]), ts - rng.randrange(40) * H if status == "processing" else None))
    as_of = T0 + 10 * H
    tracked = spark.createDataFrame([(0,), (1,), (1,), (None,)], "job_id long")
    runs = []
    for k, cuts in enumerate([[], [T0 + 5 * H, T0 + 6 * H]]):
        found = stateful.drain_parts(frames(spark, rows, JOBS, cuts), f"file://{tmp_path}/{k}", lambda s: stateful.recovered_jobs(s, tracked, as_of, 12))
        runs.append(sorted(map(tuple, found.collect())))
    within, expected = {0, 1}, []
    for job, _, ts, status, retries, most, server, started in rows:
        if status in ("done", "failed"):
            within.discard(job)
        elif (status == "pending" or started < as_of - 12 * H) and retries < most and server and job not in within:
            within.add(job)
            expected.append((job, ts, retries))
    assert runs[0] == runs[1] == sorted(expected) and expected


def test_changes(spark, tmp_path):
    """Keys that go and come back, stay, change or are new; the first snapshot is no change."""
    rng = random.Random(4)
    states = [{k: rng.choice(["a", "b", None]) for k in range(30) if rng.random() < 0.6} for _ in range(5)]
    times = [T0 + 24 * i * H for i in range(5)]
    parts = [spark.createDataFrame([(k, v, t) for k, v in s.items()], "key long, value string, ts timestamp") for s, t in zip(states, times)]
    found = stateful.drain_parts(parts, f"file://{tmp_path}", stateful.change_feed)
    expected = []
    for old, new, t in zip(states, states[1:], times[1:]):
        for k in old.keys() | new.keys():
            if k not in old:
                expected.append((k, "insert", None, new[k], t))
            elif k not in new:
                expected.append((k, "delete", old[k], None, t))
            elif old[k] != new[k]:
                expected.append((k, "update", old[k], new[k], t))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_provider_is_given_back(spark):
    before = spark.conf.get(stateful.PROVIDER)
    with stateful.with_rocksdb(spark):
        assert spark.conf.get(stateful.PROVIDER) == stateful.ROCKSDB
    assert spark.conf.get(stateful.PROVIDER) == before


class Held:
    """One key's value and timers, without a store."""

    def __init__(self):
        self.value, self.timers = None, []
        self.get, self.exists = lambda: self.value, lambda: self.value is not None

    def getValueState(self, name, schema):
        return self

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_key_of_few_rows_costs_little():
    """Many keys with a row or two in a batch: rows go in and out, and no frame is made for each key."""
    codes, row = stateful.Codes(1000), Row("number", "id", "ts", "kind", "code", "most", "at", "expires")
    began = time.perf_counter()
    for k in range(5000):
        codes.init(held := Held())
        given = [row(k, 2, T0 + H, "attempt", "a", 3, 2_000_000, stateful.NO_TIME), row(k, 1, T0, "issue", "a", 3, 1_000_000, 9_000_000)]
        made = list(codes.handleInputRows((k,), iter(given), None))
        assert [tuple(m) for m in made] == [(k, 1, "issued", 0, 1_000_000), (k, 2, "verified", 1, 2_000_000)] and held.timers == [10_000]
    assert time.perf_counter() - began < 3


def test_stale_by_the_sessions_time(spark, tmp_path):
    """as_of is a time of the session's zone, like others given without one."""
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        rows = [(i, i, T0, "processing", 0, 3, "s", T0 - d * H) for i, d in enumerate([1, 3])]
        jobs = spark.createDataFrame([(*r[:2], str(r[2]), *r[3:7], str(r[7])) for r in rows], "job_id long, n int, ts string, status string, retry_count int, max_retries int, server string, started_at string")
        jobs = jobs.withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "started_at")})
        found = stateful.drain_parts([jobs], f"file://{tmp_path}", lambda s: stateful.recovered_jobs(s, spark.createDataFrame([], "job_id long"), T0, 2))
        assert [(r.job_id, r.ts) for r in found.select("job_id", F.col("ts").cast("string").alias("ts")).collect()] == [(1, str(T0))]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
