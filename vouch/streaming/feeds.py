"""Streams: change feeds, routing, running means, limits, matching and triggers.

Every operator takes and gives a streaming DataFrame, or is a function for foreachBatch. Those with state of
their own keep it by key with applyInPandasWithState, so it is partitioned, checkpointed and restored by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from vouch.sources.scratch import children, exists, remove, written


def job_feed(spark: SparkSession, path: str, schema: str, name: str | None = None) -> DataFrame:
    """Rows that are there and then rows that come, from Parquet files below a folder, of one name where given."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", name) if name else reader).parquet(path)


def otp_feed(spark: SparkSession, path: str, schema: str, since: str, name: str | None = None) -> DataFrame:
    """Changes from `since` on alone."""
    return job_feed(spark, path, schema, name).filter(F.col("ts") >= F.lit(since).cast("timestamp"))


def publish_events(df: DataFrame, instance: str, kind: str, as_of: Column) -> DataFrame:
    """Rows as events for other instances: event_type, instance_id, ts (the column as_of), payload (JSON of all columns)."""
    return df.select(F.lit(kind).alias("event_type"), F.lit(instance).alias("instance_id"), as_of.cast("timestamp").alias("ts"), F.to_json(F.struct("*")).alias("payload"))


def latest_change(batch: DataFrame, key: str) -> DataFrame:
    """The last change of each key in a batch, by ts and seq."""
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    return batch.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def apply_otp_events(target: DataFrame, batch: DataFrame, me: str) -> DataFrame:
    """target after a batch of events of other instances: deletes take a number's row away, others set it.

    Both have number and share; a null share leaves the one that is there. batch also has event_type,
    instance_id, ts and seq.
    """
    others = latest_change(batch.filter(F.col("instance_id") != me), "number")
    change = others.select("number", F.col("event_type").alias("_kind"), F.col("share").alias("_share"))
    joined = target.join(change, "number", "full_outer").filter(F.col("_kind").isNull() | (F.col("_kind") != "delete"))
    return joined.select("number", F.coalesce("_share", "share").alias("share"))


#: Parts of a kept target, by a hash of the key; a batch rewrites those that it touches.
BUCKETS = 64


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int] | None:
    """For each part of the target the version that holds it after so many batches, from one small table; null where there is none."""
    if not exists(spark, f"{path}/manifest/{version}/_SUCCESS"):
        return None
    return {r.bucket: r.held for r in spark.read.parquet(f"{path}/manifest/{version}").collect()}


def _read(spark: SparkSession, path: str, held: dict[int, int], schema: StructType) -> DataFrame:
    """The parts named, each of its version."""
    folders = [f"{path}/data/version={v}/bucket={k}" for k, v in sorted(held.items()) if exists(spark, f"{path}/data/version={v}/bucket={k}")]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("number"), F.lit(buckets))


def _keep(rows: DataFrame, path: str, version: int, held: dict[int, int]) -> None:
    """Writes parts of a version, and then the table that makes it valid."""
    rows.withColumn("bucket", _bucket(len(held))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    told = rows.sparkSession.createDataFrame(sorted(held.items()), "bucket long, held long")
    told.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{version}")


def keep_applied(target: DataFrame, path: str, me: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that applies each batch of events to the target as the batch before left it.

    The target is kept below path in parts by its key, as many as at the first start. A batch reads and writes only the parts that its events
    touch, as a version named by the batch, and ends with a table of the version that holds each part; until that is
    there the batch has not happened. A batch that is run again after a failure reads the same versions as before, and
    versions that neither this batch nor the one before it needs are deleted.
    """
    spark, schema = target.sparkSession, target.schema
    if not any(exists(spark, f"{path}/manifest/{name}/_SUCCESS") for name in children(spark, f"{path}/manifest")):
        _keep(target, path, -1, {k: -1 for k in range(buckets)})

    def apply(batch: DataFrame, batch_id: int) -> None:
        held = _manifest(spark, path, batch_id - 1)
        if held is None:
            raise RuntimeError(f"batch {batch_id - 1} has not been applied")
        batch = written(batch, "batch")
        touched = [r.bucket for r in batch.filter(F.col("instance_id") != me).select(_bucket(len(held)).alias("bucket")).distinct().collect()]
        before = _read(spark, path, {k: held[k] for k in touched}, schema)
        now = held | {k: batch_id for k in touched}
        _keep(apply_otp_events(before, batch, me), path, batch_id, now)
        for name in children(spark, f"{path}/data"):
            if name.startswith("version=") and int(name.removeprefix("version=")) not in {*held.values(), *now.values()}:
                remove(spark, f"{path}/data/{name}")
        remove(spark, f"{path}/manifest/{batch_id - 2}")

    return apply


def last_version(spark: SparkSession, path: str, schema: StructType, batches: int | None = None) -> DataFrame:
    """The target after so many batches, or after the last one; as it was at first where there was none."""
    if batches is None:
        batches = max((int(name) for name in children(spark, f"{path}/manifest") if exists(spark, f"{path}/manifest/{name}/_SUCCESS")), default=-1) + 1
    held = _manifest(spark, path, batches - 1)
    if held is None:
        raise ValueError(f"no version of {batches} batches below {path}")
    return _read(spark, path, held, schema)


def route_jobs(stream: DataFrame, instance: str, delay: str = "1 hour") -> DataFrame:
    """Pending jobs of this instance, each job_id once; created_at bounds what is remembered."""
    own = stream.filter((F.col("status") == "pending") & (F.col("instance") == instance))
    return own.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["job_id"])


#: State of a key that no event has touched for so long, by event time, is dropped.
FORGET = "30 days"


def _stateful(stream: DataFrame, key: str, step: Callable, out: str, state: str, forget: str, time: str = "ts") -> DataFrame:
    """step(key, rows, state tuple or None) gives output rows and the new state, for each key of each batch.

    State goes once the watermark, which lies `forget` behind the newest event, has passed the key's last event by as much.
    """
    micros = int(pd.Timedelta(forget) / pd.Timedelta("1us"))

    def run(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True)
        made, new = step(name[0], rows, held.get if held.exists else None)
        held.update(new)
        last = int(rows[time].max().timestamp() * 1000)
        held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + micros // 1000)
        yield made

    return stream.withWatermark(time, forget).groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def running_mean(stream: DataFrame, forget: str = FORGET) -> DataFrame:
    """Mean seconds of each document_type after each batch (document_type, ts, seconds): document_type, mean_seconds, n.

    A type without a job for `forget` begins anew.
    """

    def step(key, rows, held):
        n, total = held or (0, 0.0)
        seconds = rows["seconds"].dropna()
        n, total = n + len(seconds), total + float(seconds.sum())
        return pd.DataFrame({"document_type": [key], "mean_seconds": [total / n if n else None], "n": [n]}), (n, total)

    return _stateful(stream, "document_type", step, "document_type string, mean_seconds double, n long", "n long, total double", forget)


def rate_gate(stream: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """Whether each request (user_id, id, ts) stays below every limit (seconds, earlier requests): user_id, id, allowed.

    All earlier requests count, allowed or not, as in the batch form; times at one microsecond do not count each
    other. State holds the times of the longest window, and goes when that has passed. A batch's requests are
    sorted once and counted by binary search, so a busy user costs no more for each of its requests.
    """
    longest = max(s for s, _ in limits) * 1_000_000

    def step(key, rows, held):
        rows = rows.sort_values(["ts", "id"])
        now = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        times = np.r_[np.array(held[0] if held else [], dtype=np.int64), now]
        times.sort(kind="stable")
        upto = np.searchsorted(times, now, side="left")
        allowed = np.ones(len(now), dtype=bool)
        for seconds, most in limits:
            allowed &= upto - np.searchsorted(times, now - seconds * 1_000_000, side="left") < most
        made = pd.DataFrame({"user_id": np.full(len(now), key), "id": rows["id"].to_numpy(), "allowed": allowed})
        return made, (times[times >= times[-1] - longest].tolist(),)

    return _stateful(stream, "user_id", step, "user_id long, id long, allowed boolean", "times array<long>", f"{longest // 1_000_000} seconds")


def replay_gate(stream: DataFrame, future: int = 60, past: int = 300) -> DataFrame:
    """Requests (request_id, ts, seen_at) that are fresh and not seen before."""
    age = F.unix_timestamp("seen_at") - F.unix_timestamp("ts")
    return stream.filter(age.between(-future, past)).withWatermark("ts", f"{past} seconds").dropDuplicatesWithinWatermark(["request_id"])


def match_otp(jobs: DataFrame, otps: DataFrame, window: int = 300, outage: str = "1 day") -> DataFrame:
    """Jobs (number, code, job_id, created_at) with a code (number, otp_code, otp_created_at) of that time: job_id, number.

    The watermarks are of the outage to live through, so a late code still meets its job by the job's time.
    """
    a = jobs.withWatermark("created_at", outage).alias("a")
    b = otps.withWatermark("otp_created_at", outage).alias("b")
    near = F.expr(f"b.otp_created_at BETWEEN a.created_at - INTERVAL {window} SECONDS AND a.created_at + INTERVAL {window} SECONDS")
    return a.join(b, (F.col("a.number") == F.col("b.number")) & (F.col("a.code") == F.col("b.otp_code")) & near).select("a.job_id", "a.number")


def otp_state(stream: DataFrame, most: int = 3, forget: str = FORGET) -> DataFrame:
    """State of each number after each attempt (number, id, ts, right): number, id, attempts, status.

    A right code verifies; `most` wrong ones lock, and nothing changes a number that is verified or locked, until
    there was no attempt for `forget`.
    """

    def step(key, rows, held):
        attempts, status = held or (0, "open")
        made = []
        for row in rows.sort_values(["ts", "id"]).itertuples():
            if status == "open":
                attempts += 1
                status = "verified" if row.right else "locked" if attempts >= most else "open"
            made.append((key, row.id, attempts, status))
        return pd.DataFrame(made, columns=["number", "id", "attempts", "status"]), (attempts, status)

    return _stateful(stream, "number", step, "number long, id long, attempts int, status string", "attempts int, status string", forget)


def hold_trigger(stream: DataFrame, n: int = 5, hold: float = 5.0, forget: str = FORGET) -> DataFrame:
    """Fires (key, id) after n hits in a row of (key, id, ts, hit); then nothing counts for `hold` seconds. A key without rows for `forget` begins anew."""

    def step(key, rows, held):
        run, free = held or (0, 0.0)
        made = []
        for row in rows.sort_values(["ts", "id"]).itertuples():
            now = row.ts.timestamp()
            if now < free:
                continue
            run = run + 1 if row.hit else 0
            if run >= n:
                made.append((key, row.id))
                run, free = 0, now + hold
        return pd.DataFrame(made, columns=["key", "id"]).astype({"key": "int64", "id": "int64"}), (run, free)

    return _stateful(stream, "key", step, "key long, id long", "run int, free double", forget)


def retry_policy(batch: DataFrame) -> DataFrame:
    """Failed jobs of a batch become pending again while they have retries left, else failed for good."""
    left = F.col("retry_count") < F.col("max_retries")
    return batch.filter("status = 'error'").withColumn("status", F.when(left, "pending").otherwise("failed")).withColumn("retry_count", F.when(left, F.col("retry_count") + 1).otherwise(F.col("retry_count")))


def recover(jobs: DataFrame, tracked: DataFrame, as_of, hours: float = 1) -> DataFrame:
    """After a restart: stale jobs are pending again, and pending jobs that are not tracked are given."""
    from vouch.operators.lifecycle import reset_stale

    return reset_stale(jobs, as_of, hours).filter("status = 'pending'").join(tracked.select("job_id"), "job_id", "left_anti")


def cached(requests: DataFrame, cache: DataFrame, as_of, hours: float = 24) -> tuple[DataFrame, DataFrame]:
    """Requests that the cache (query, cached_at) answers within its time to live, and those that it does not."""
    import datetime

    live = cache.filter(F.col("cached_at") > F.lit(as_of - datetime.timedelta(hours=hours))).select("query").distinct()
    return requests.join(live, "query", "left_semi"), requests.join(live, "query", "left_anti")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, to Parquet below path, and reads the result; its checkpoint lies beside.

    In append mode Spark's file sink keeps a log of the batches that are in; in other modes each batch writes a folder
    of its own. Either way a batch that is run again after a failure is there once.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/data").start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/data/batch={n}")).start()
    query.awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
    return out.select(*stream.columns)
