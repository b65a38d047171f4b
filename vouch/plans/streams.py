"""Queries of the streaming operators: the given events as a stream, with the SQL of their batch twins for DuckDB."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from vouch.plans.tables import table
from vouch.sources.scratch import scratch_dir
from vouch.streaming import feeds, stateful

Q, O = {}, {}
AS_OF = datetime.datetime(2024, 1, 31)
RUNS = "r AS (SELECT user_id AS key, event_id AS id, ts, value >= 20 AS hit FROM events)"


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return add


def _path(spark, label):
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return feeds.job_feed(spark, sf_dir, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("s13_job_feed", "SELECT event_id, event_type FROM events")
def s13(spark, sf_dir):
    return feeds.drain(_stream(spark, sf_dir).select("event_id", "event_type"), _path(spark, "s13"))


@query("s14_otp_feed", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def s14(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return feeds.drain(feeds.otp_feed(spark, sf_dir, schema, "2024-01-15", "events.parquet").select("event_id"), _path(spark, "s14"))


@query("s15_publish_events", "SELECT 'create' AS event_type, 'me' AS instance_id, event_id FROM events")
def s15(spark, sf_dir):
    sent = feeds.drain(feeds.publish_events(_stream(spark, sf_dir).select("event_id", "value", "ts"), "me", "create", F.col("ts")), _path(spark, "s15"))
    return sent.select("event_type", "instance_id", F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"))


CUTS = ["2024-01-08", "2024-01-16", "2024-01-24"]
#: The state of a number after each batch: null without a row, '' for a row without a share.
_fold = lambda i: f"s{i} AS (SELECT s.number, CASE WHEN l.kind IS NULL THEN s.state WHEN l.kind = 'error' THEN NULL WHEN l.kind = 'click' THEN coalesce(s.state, '') ELSE l.kind END AS state FROM {f's{i - 1}' if i else 'u'} s LEFT JOIN l ON l.number = s.number AND l.batch = {i})"


def _parts(frame, column="ts"):
    """frame in four parts of time, as they would come."""
    return [stateful.between(frame, column, low, high) for low, high in zip((None, *CUTS), (*CUTS, None))]


@query("t1s_apply_otp_events", f"""WITH e AS (SELECT user_id AS number, event_type AS kind, CASE {' '.join(f"WHEN ts < TIMESTAMP '{c}' THEN {i}" for i, c in enumerate(CUTS))} ELSE 3 END AS batch, ts, event_id FROM events WHERE event_id % 7 <> 0),
    l AS (SELECT number, batch, arg_max(kind, (ts, event_id)) AS kind FROM e GROUP BY 1, 2), u AS (SELECT DISTINCT user_id AS number, CASE WHEN user_id % 2 = 0 THEN 'old' END AS state FROM events), {', '.join(_fold(i) for i in range(4))} SELECT number, nullif(state, '') AS share FROM s3 WHERE state IS NOT NULL""")
def t1s(spark, sf_dir):
    """Each batch is applied to the target as the one before left it, with `error` as delete and `click` without a share.

    The events come in four parts by time; each start of the stream takes up the next.
    """
    path = _path(spark, "t1s")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    target = events.filter("user_id % 2 = 0").select(F.col("user_id").alias("number"), F.lit("old").alias("share")).distinct()
    apply = feeds.keep_applied(target, f"{path}/target", "me", 8)
    for part in _parts(events):
        part.write.mode("append").parquet(f"{path}/feed")
        changes = spark.readStream.schema(events.schema).parquet(f"{path}/feed").select(
            F.col("user_id").alias("number"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("share"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("event_type"),
            F.when(F.col("event_id") % 7 == 0, "me").otherwise("other").alias("instance_id"), "ts", F.col("event_id").alias("seq"),
        )
        changes.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
    return feeds.last_version(spark, f"{path}/target", target.schema)


@query("t2s_route_jobs", "SELECT event_id AS job_id FROM events WHERE event_id % 4 = 0 AND user_id % 7 = 3")
def t2s(spark, sf_dir):
    status = F.when(F.col("event_id") % 4 == 0, "pending").otherwise("done")
    jobs = _stream(spark, sf_dir).select(F.col("event_id").alias("job_id"), status.alias("status"), (F.col("user_id") % 7).cast("string").alias("instance"), F.col("ts").alias("created_at"))
    twice = jobs.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")
    return feeds.drain(feeds.route_jobs(twice, "3").select("job_id"), _path(spark, "t2s"))


@query("t3s_running_mean", "SELECT event_type AS document_type, round(avg(value), 6) AS mean_seconds, count(value) AS n FROM events GROUP BY 1")
def t3s(spark, sf_dir):
    """The last mean of each type."""
    means = feeds.drain(feeds.running_mean(_stream(spark, sf_dir).select(F.col("event_type").alias("document_type"), F.col("value").alias("seconds"), "ts")), _path(spark, "t3s"))
    last = means.groupBy("document_type").agg(F.max_by("mean_seconds", "n").alias("mean_seconds"), F.max("n").alias("n"))
    return last.withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("t4s_rate_gate", """SELECT user_id, event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) < 2
    AND count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) < 8 AS allowed FROM events""")
def t4s(spark, sf_dir):
    requests = _stream(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), "ts")
    return feeds.drain(feeds.rate_gate(requests, [(3600, 2), (86400, 8)]), _path(spark, "t4s"))


@query("t5s_replay_gate", "SELECT event_id AS request_id FROM events WHERE floor(value) <= 30")
def t5s(spark, sf_dir):
    seen = F.timestamp_micros(F.unix_micros("ts") + F.floor("value") * 1_000_000)
    requests = _stream(spark, sf_dir).select(F.col("event_id").alias("request_id"), "ts", seen.alias("seen_at"))
    twice = requests.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")
    return feeds.drain(feeds.replay_gate(twice, past=30).select("request_id"), _path(spark, "t5s"))


@query("t6s_match_otp", """SELECT a.event_id AS job_id, a.user_id AS number FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id % 3 = b.event_id % 3
    WHERE a.event_type = 'purchase' AND b.event_type = 'signup' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000""")
def t6s(spark, sf_dir):
    jobs = _stream(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("number"), (F.col("event_id") % 3).alias("code"), F.col("ts").alias("created_at"))
    otps = _stream(spark, sf_dir).filter("event_type = 'signup'").select(F.col("user_id").alias("number"), (F.col("event_id") % 3).alias("otp_code"), F.col("ts").alias("otp_created_at"))
    return feeds.drain(feeds.match_otp(jobs, otps, 86400, "40 days"), _path(spark, "t6s"))


@query("t7s_otp_state", """WITH r AS (SELECT user_id AS number, event_id AS id, row_number() OVER w AS n, event_id % 5 = 0 AS ok FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    f AS (SELECT *, coalesce(min(CASE WHEN ok THEN n END) OVER (PARTITION BY number), 99999999) AS hit FROM r)
    SELECT number, id, CAST(least(n, hit, 3) AS INTEGER) AS attempts, CASE WHEN hit <= 3 AND n >= hit THEN 'verified' WHEN n >= 3 THEN 'locked' ELSE 'open' END AS status FROM f""")
def t7s(spark, sf_dir):
    attempts = _stream(spark, sf_dir).select(F.col("user_id").alias("number"), F.col("event_id").alias("id"), "ts", (F.col("event_id") % 5 == 0).alias("right"))
    return feeds.drain(feeds.otp_state(attempts), _path(spark, "t7s"))


@query("t8s_hold_trigger")
def t8s(spark, sf_dir):
    """What comes after a trigger depends on it, step by step; tested by brute force."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", (F.col("value") >= 20).alias("hit"))
    return feeds.drain(feeds.hold_trigger(rows, 3, 86400.0), _path(spark, "t8s"))


@query("t9s_retry_policy", "SELECT event_id AS job_id, CASE WHEN event_id % 5 < 3 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN event_id % 5 < 3 THEN event_id % 5 + 1 ELSE event_id % 5 END AS retry_count FROM events WHERE event_type = 'error'")
def t9s(spark, sf_dir):
    jobs = _stream(spark, sf_dir).select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), (F.col("event_id") % 5).alias("retry_count"), F.lit(3).alias("max_retries"))
    return feeds.drain(feeds.retry_policy(jobs).select("job_id", "status", "retry_count"), _path(spark, "t9s"))


@query("t10s_recover", "SELECT event_id AS job_id FROM events WHERE (event_id % 4 = 0 OR (event_id % 4 = 1 AND ts < TIMESTAMP '2024-01-29')) AND event_id % 3 <> 0")
def t10s(spark, sf_dir):
    status = F.when(F.col("event_id") % 4 == 0, "pending").when(F.col("event_id") % 4 == 1, "processing").otherwise("done")
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("started_at"))
    return feeds.recover(jobs, jobs.filter("job_id % 3 = 0"), AS_OF, 48).select("job_id")


@query("t11s_cached", "SELECT page_id, page_id % 10 IN (SELECT user_id % 10 FROM events WHERE ts > TIMESTAMP '2024-01-30 23:00:00') AS hit FROM pages")
def t11s(spark, sf_dir):
    requests = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 10).alias("query"))
    cache = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("query"), F.col("ts").cast("timestamp").alias("cached_at"))
    hit, miss = feeds.cached(requests, cache, AS_OF, 1)
    return hit.select("page_id", F.lit(True).alias("hit")).unionByName(miss.select("page_id", F.lit(False).alias("hit")))


#: The watermark's time in milliseconds once all events are in; timers that lie at or before it have fired.
_mark = lambda hours: f"(SELECT epoch_us(max(ts)) // 1000 - {hours * 3_600_000} FROM events)"


@query("t7s_code_events", f"""
    WITH e AS (SELECT user_id AS number, event_id AS id, ts, event_type = 'signup' AS issue, event_id % 4 AS code, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
    i AS (SELECT number, turn, code, ts + INTERVAL 36 HOUR AS expires_at, lead(ts) OVER (PARTITION BY number ORDER BY turn) AS next FROM e WHERE issue),
    a AS (SELECT e.number, e.id, e.ts, e.turn, e.ts < i.expires_at AS alive, e.code = i.code AS ok, row_number() OVER (PARTITION BY e.number, e.turn ORDER BY e.ts, e.id) AS n, i.number IS NULL AS lost
          FROM e LEFT JOIN i ON i.number = e.number AND i.turn = e.turn WHERE NOT e.issue),
    f AS (SELECT *, min(CASE WHEN ok AND alive AND n <= 3 THEN n END) OVER (PARTITION BY number, turn) AS hit, count(*) FILTER (alive) OVER (PARTITION BY number, turn) AS tried FROM a),
    tries AS (SELECT number, id, CASE WHEN lost THEN 'not_found' WHEN n > hit THEN 'already_used' WHEN NOT alive THEN 'expired' WHEN n = hit THEN 'verified' WHEN n > 3 THEN 'max_attempts_exceeded' ELSE 'invalid_code' END AS status,
              CASE WHEN lost THEN 0 ELSE least(n, coalesce(hit, 3), 3, tried) END AS attempts, ts AS happened_at FROM f),
    ends AS (SELECT i.number, CAST(NULL AS BIGINT) AS id, 'expire' AS status, (SELECT least(count(*), 3) FROM a WHERE a.number = i.number AND a.turn = i.turn AND a.alive) AS attempts, i.expires_at AS happened_at
             FROM i WHERE (next IS NULL OR next >= expires_at) AND NOT EXISTS (SELECT 1 FROM f WHERE f.number = i.number AND f.turn = i.turn AND hit IS NOT NULL)
             AND (epoch_us(expires_at) // 1000 + 1 <= {_mark(1)} OR EXISTS (SELECT 1 FROM e WHERE e.number = i.number AND e.ts >= i.expires_at)))
    SELECT number, id, status, CAST(attempts AS INTEGER) AS attempts, happened_at FROM (SELECT * FROM tries UNION ALL SELECT * FROM ends UNION ALL SELECT number, id, 'issued', 0, ts FROM e WHERE issue)""")
def t7s_codes(spark, sf_dir):
    """Signups open a code for 36 hours, every other event of a user is an attempt; four batches."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("number"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "signup", "issue").otherwise("attempt").alias("kind"),
        (F.col("event_id") % 4).cast("string").alias("code"), (F.col("ts") + F.expr("INTERVAL 36 HOURS")).cast("timestamp").alias("expires_at"), F.lit(3).alias("most"),
    )
    return stateful.drain_parts(_parts(rows), _path(spark, "t7s-codes"), stateful.code_events)


@query("t11s_cached_stream", """
    WITH RECURSIVE r AS (SELECT CAST(user_id % 50 AS VARCHAR) AS query, event_type AS provider, event_id AS id, ts FROM events),
    fills AS (SELECT query, provider, min(ts) AS filled FROM r GROUP BY 1, 2 UNION ALL
              SELECT f.query, f.provider, (SELECT min(ts) FROM r WHERE r.query = f.query AND r.provider = f.provider AND r.ts >= f.filled + INTERVAL 24 HOUR) AS filled FROM fills f WHERE f.filled IS NOT NULL),
    spans AS (SELECT query, provider, filled, lead(filled) OVER (PARTITION BY query, provider ORDER BY filled) AS upto FROM fills WHERE filled IS NOT NULL)
    SELECT r.query, r.provider, r.id, r.ts <> s.filled AS hit, s.filled AS cached_at FROM r JOIN spans s ON s.query = r.query AND s.provider = r.provider AND r.ts >= s.filled AND (s.upto IS NULL OR r.ts < s.upto)""")
def t11s_stream(spark, sf_dir):
    """Each event asks its provider for one of fifty queries; four batches."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("query"), F.col("event_type").alias("provider"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return stateful.drain_parts(_parts(rows), _path(spark, "t11s-stream"), stateful.cached_requests)


@query("t10s_recovered_stream", """
    WITH j AS (SELECT event_id % 499 AS job_id, event_id, ts, event_type, event_id % 4 AS retry_count, event_type IN ('error', 'view') AS ended,
                      (event_type IN ('signup', 'purchase') OR (event_type = 'click' AND ts < TIMESTAMP '2024-01-21')) AND event_id % 4 < 3 AND event_id % 11 <> 0 AS goes FROM events),
    g AS (SELECT *, coalesce(sum(CAST(ended AS INTEGER)) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS turn FROM j),
    n AS (SELECT *, row_number() OVER (PARTITION BY job_id, turn ORDER BY ts) AS nth FROM g WHERE goes)
    SELECT job_id, ts, CAST(retry_count AS INTEGER) AS retry_count FROM n WHERE nth = 1 AND NOT (turn = 0 AND job_id % 3 = 0)""")
def t10s_stream(spark, sf_dir):
    """Four starts of one stream, each from the checkpoint of the one before; every third job is in the queue at the first."""
    kind = F.when(F.col("event_type").isin("error", "view"), "done").when(F.col("event_type") == "click", "processing").otherwise("pending")
    rows = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 499).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("status"), (F.col("event_id") % 4).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"),
        F.when(F.col("event_id") % 11 != 0, "server").alias("server"), F.col("ts").cast("timestamp").alias("started_at"),
    )
    tracked = rows.filter("job_id % 3 = 0").select("job_id")
    return stateful.drain_parts(_parts(rows), _path(spark, "t10s-stream"), lambda feed: stateful.recovered_jobs(feed, tracked, AS_OF, 240))


SNAPS = ["2024-01-08", "2024-01-16", "2024-01-24", "2024-01-31"]
_snap = lambda i: f"s{i} AS (SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value FROM events WHERE ts < TIMESTAMP '{SNAPS[i]}' GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'error')"
_step = lambda i: f"""SELECT coalesce(n.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'insert' WHEN n.key IS NULL THEN 'delete' ELSE 'update' END AS change_type, o.value AS old_value, n.value AS new_value, TIMESTAMP '{SNAPS[i]}' AS happened_at
    FROM s{i} n FULL JOIN s{i - 1} o ON o.key = n.key WHERE o.value IS DISTINCT FROM n.value"""  # noqa: E731


@query("s14_change_types", f"WITH {', '.join(_snap(i) for i in range(4))} {' UNION ALL '.join(_step(i) for i in range(1, 4))}")
def s14_types(spark, sf_dir):
    """Four snapshots of each user's last event; a user whose last one is an error is not in a snapshot."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))

    def snapshot(at):
        last = stateful.between(events, "ts", None, at).groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("value"))
        return last.filter("value <> 'error'").withColumn("ts", F.lit(at).cast("timestamp"))

    return stateful.drain_parts([snapshot(at) for at in SNAPS], _path(spark, "s14-types"), stateful.change_feed)
