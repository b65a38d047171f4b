"""Streams with state of their own kind: values and maps by key, timers of event time, and state handed over.

The processors keep their state in Spark's state store by key, so it is partitioned, checkpointed and restored by
Spark. They need the RocksDB provider, which with_rocksdb sets for the streams that are started in it. A batch's
rows of a key are handled in the order of time, so results do not depend on how rows are dealt into batches. Most keys
have a few rows in a batch, so processors take and give rows, times among them as microseconds, and no frame for each key.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started in here keep their state in RocksDB; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


#: Microseconds that stand for a time that is missing.
NO_TIME = -(2**63) // 1000


def _micros(time: str) -> Column:
    return F.coalesce(F.unix_micros(time), F.lit(NO_TIME))


def _sorted(rows: Iterator[Row], by: str | None = None) -> list[Row]:
    """Rows by time and then by another column; those without come last."""
    return sorted(rows, key=lambda r: (r.ts is None, r.at) if by is None else (r.ts is None, r.at, r[by] is None, r[by] or 0))


def _timed(out: DataFrame, *times: str) -> DataFrame:
    """out with these columns of microseconds as times."""
    return out.withColumns({c: F.timestamp_micros(c) for c in times})


class Codes(StatefulProcessor):
    """One-time codes by number: what is open, how often it was tried, when it expires."""

    OUT, MADE = "number long, id long, status string, attempts int, happened_at long", Row("number", "id", "status", "attempts", "happened_at")

    def __init__(self, forget_ms: int):
        self.forget = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("code", "code string, expires long, most int, attempts int, status string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        code, expires, most, attempts, status, timer = self.held.get() or (None, 0, 0, 0, "none", -1)
        made, first = [], timer
        for r in _sorted(rows, "id"):
            now = r.at
            if status == "open" and now >= expires:
                made.append(self.MADE(key[0], None, "expire", attempts, expires))
                status, timer = "expired", expires // 1000 + self.forget
            if r.kind == "issue":
                code, expires, most, attempts, status = r.code, r.expires, r.most, 0, "open"
                timer = expires // 1000 + 1
                made.append(self.MADE(key[0], r.id, "issued", 0, now))
                continue
            told = {"none": "not_found", "verified": "already_used", "expired": "expired"}.get(status)
            if told is None and attempts >= most:
                told = "max_attempts_exceeded"
            elif told is None:
                attempts += 1
                told = "verified" if r.code == code else "invalid_code"
                if told == "verified":
                    status, timer = "verified", expires // 1000 + self.forget
            made.append(self.MADE(key[0], r.id, told, attempts, now))
        if status != "none":
            if timer != first:
                if first >= 0:
                    self.handle.deleteTimer(first)
                self.handle.registerTimer(timer)
            self.held.update((code, expires, most, attempts, status, timer))
        return iter(made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        made = []
        if held := self.held.get():
            code, expires, most, attempts, status, timer = held
            if timer <= expiredTimerInfo.getExpiryTimeInMs():
                if status == "open":
                    made.append(self.MADE(key[0], None, "expire", attempts, expires))
                    timer = expires // 1000 + self.forget
                    self.handle.registerTimer(timer)
                    self.held.update((code, expires, most, attempts, "expired", timer))
                else:
                    self.held.clear()
        return iter(made)

    def close(self) -> None:
        pass


def code_events(stream: DataFrame, delay: str = "1 hour", forget: str = "30 days") -> DataFrame:
    """What happens to one-time codes: number, id, status, attempts, happened_at.

    stream has number, id, ts, kind, code, expires_at and most. An `issue` opens a code for its number in place
    of the one before; an `attempt` is not_found without a code, verified or invalid_code while it is open and
    fewer than `most` attempts were made, else max_attempts_exceeded, expired or already_used. A code that is open at
    its expires_at gives an `expire` without an id at that time: from a timer once the watermark, `delay`
    behind the newest event, has passed it, or before the number's next event. A code is forgotten `forget` after its end.
    """
    ms = int(pd.Timedelta(forget) / pd.Timedelta("1ms"))
    rows = stream.select("number", "id", "ts", "kind", "code", "most", _micros("ts").alias("at"), _micros("expires_at").alias("expires")).withWatermark("ts", delay)
    return _timed(rows.groupBy("number").transformWithState(Codes(ms), Codes.OUT, "Append", "EventTime"), "happened_at")


class Cache(StatefulProcessor):
    """When each provider's answer to a query was fetched."""

    OUT, MADE = "query string, provider string, id long, hit boolean, cached_at long", Row("query", "provider", "id", "hit", "cached_at")

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "provider string", "cached_at long")

    def _later(self, times: list[int]) -> None:
        """One timer, for when the first of these answers ends."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer((min(times) + self.ttl) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = {p[0]: at[0] for p, at in self.answers.iterator()} if self.answers.exists() else {}
        before, made = dict(known), []
        for r in _sorted(rows, "id"):
            now = r.at
            hit = r.provider in known and now - known[r.provider] < self.ttl
            if not hit:
                known[r.provider] = now
            made.append(self.MADE(key[0], r.provider, r.id, hit, known[r.provider]))
        for p, at in known.items():
            if before.get(p) != at:
                self.answers.updateValue((p,), (at,))
        if before != known:
            self._later(list(known.values()))
        return iter(made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        left = []
        for p, at in list(self.answers.iterator()):
            if (at[0] + self.ttl) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
                self.answers.removeKey(p)
            else:
                left.append(at[0])
        self._later(left)
        return iter([])

    def close(self) -> None:
        pass


def cached_requests(stream: DataFrame, hours: float = 24, delay: str = "1 hour") -> DataFrame:
    """Requests (query, provider, id, ts) with whether the cache answers them: query, provider, id, hit, cached_at.

    A request that no answer younger than `hours` is there for is a miss and fills the cache at its own time; a hit
    does not make an answer younger. Answers go from the state once the watermark has passed their end.
    """
    rows = stream.select(F.col("query").cast("string").alias("query"), F.coalesce(F.col("provider").cast("string"), F.lit("")).alias("provider"), "id", "ts", _micros("ts").alias("at")).withWatermark("ts", delay)
    return _timed(rows.groupBy("query").transformWithState(Cache(int(hours * 3_600_000_000)), Cache.OUT, "Append", "EventTime"), "cached_at")


class Queue(StatefulProcessor):
    """Whether a job is in the queue."""

    OUT, MADE = "job_id long, ts long, retry_count int", Row("job_id", "ts", "retry_count")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracked = handle.getValueState("tracked", "since long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.tracked.update((0,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tracked = before = self.tracked.exists()
        made, since = [], 0
        for r in _sorted(rows):
            if r.status in ("done", "failed"):
                tracked = False
                continue
            if (r.status == "pending" or r.status == "processing" and r.stale) and r.retry_count is not None and r.max_retries is not None and r.retry_count < r.max_retries and r.server is not None and not tracked:
                tracked, since = True, r.at
                made.append(self.MADE(key[0], since, r.retry_count))
        if tracked and made:
            self.tracked.update((since,))
        elif before and not tracked:
            self.tracked.clear()
        return iter(made)

    def close(self) -> None:
        pass


def recovered_jobs(stream: DataFrame, tracked: DataFrame, as_of: datetime.datetime, hours: float = 1) -> DataFrame:
    """Jobs that go into the queue: job_id, ts, retry_count, each once until it is done or failed.

    stream has job_id, ts, status, retry_count, max_retries, server and started_at, a row for each state of a job.
    Pending jobs go in, and jobs that are processing since before `hours` ahead of as_of, where retries are left and
    a server is told. tracked (job_id) are the jobs that are in the queue at the first start: their state is handed
    over then; on later starts the checkpoint's state counts.
    """
    oldest = F.unix_micros(F.lit(str(as_of)).cast("timestamp")) - int(hours * 3_600_000_000)
    rows = stream.select("job_id", "ts", "status", "retry_count", "max_retries", "server", _micros("ts").alias("at"), (F.unix_micros("started_at") < oldest).alias("stale"))
    first = tracked.select("job_id").filter("job_id is not null").distinct().groupBy("job_id")
    return _timed(rows.groupBy("job_id").transformWithState(Queue(), Queue.OUT, "Append", "None", first), "ts")


class Versions(StatefulProcessor):
    """The last version of a key, and the snapshot that had it."""

    OUT, MADE = "key long, change_type string, old_value string, new_value string, happened_at long", Row("key", "change_type", "old_value", "new_value", "happened_at")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value string, seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        made, upto = [], timerValues.getCurrentWatermarkInMs() * 1000
        value, seen = self.last.get() or (None, -1)
        first = seen
        for r in _sorted(rows):
            now, new = r.at, r.value
            if 0 <= seen < upto < now:
                # It was not in the snapshot before this one.
                made.append(self.MADE(key[0], "delete", value, None, upto))
                seen = -1
            if seen < 0:
                # Before the first snapshot has been passed, what is there is no change.
                if upto > 0:
                    made.append(self.MADE(key[0], "insert", None, new, now))
            elif new != value:
                made.append(self.MADE(key[0], "update", value, new, now))
            value, seen = new, now
        if seen != first:
            if first >= 0:
                self.handle.deleteTimer(first // 1000 + 1)
            self.handle.registerTimer(seen // 1000 + 1)
        self.last.update((value, seen))
        return iter(made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        made = []
        if last := self.last.get():
            value, seen = last
            if seen // 1000 < expiredTimerInfo.getExpiryTimeInMs():
                made.append(self.MADE(key[0], "delete", value, None, timerValues.getCurrentWatermarkInMs() * 1000))
                self.last.clear()
        return iter(made)

    def close(self) -> None:
        pass


def change_feed(snapshots: DataFrame) -> DataFrame:
    """Changes from snapshot to snapshot: key, change_type (insert, update, delete), old_value, new_value, happened_at.

    snapshots has key, value and ts, the snapshot's time in whole milliseconds; each batch brings one snapshot, whole,
    a row for each key. The first one is what is there and gives no change. A key that a snapshot lacks is told as
    deleted at that snapshot's time once it has passed, by a timer or, where the key is back, before its insert.
    """
    rows = snapshots.select("key", F.col("value").cast("string").alias("value"), "ts", _micros("ts").alias("at")).withWatermark("ts", "0 seconds")
    return _timed(rows.groupBy("key").transformWithState(Versions(), Versions.OUT, "Append", "EventTime"), "happened_at")


def drain_parts(parts: list[DataFrame], path: str, make) -> DataFrame:
    """Runs a stream over parts that come one after another: each is written to the feed, then the stream is started
    again from its checkpoint and takes up what is new as one batch. Returns all that it has given."""
    from vouch.streaming.feeds import drain

    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{path}/feed")
        with with_rocksdb(part.sparkSession):
            out = drain(make(part.sparkSession.readStream.schema(part.schema).parquet(f"{path}/feed")), path)
    return out


def between(df: DataFrame, column: str, low: str | None, high: str | None) -> DataFrame:
    """Rows from low on and before high; null is open."""
    keep: Column = F.lit(True)
    if low is not None:
        keep = keep & (F.col(column) >= F.lit(low).cast("timestamp"))
    return df.filter(keep if high is None else keep & (F.col(column) < F.lit(high).cast("timestamp")))
