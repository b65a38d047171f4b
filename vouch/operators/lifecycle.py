"""State of records over time: filters on live rows, table maintenance, queues, limits, statistics."""

from __future__ import annotations

import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from vouch.operators.extract import small

#: Document types and the forms they are given in: fixed values.
DOC_TYPES = {"id card": "id_card", "idcard": "id_card", "id": "id_card", "bank statement": "bank_statement", "bankstatement": "bank_statement", "passport": "passport", "selfie": "selfie"}
KNOWN_TYPES = ("selfie", "passport", "id_card", "bank_statement")
#: Submissions allowed in an hour and a day: fixed values.
PER_HOUR, PER_DAY = 10, 30


def valid_otps(df: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """Codes that are not used and not expired at as_of; one without expiry does not expire."""
    return df.filter(~F.col("is_verified") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of))))


def unverified_otps(df: DataFrame) -> DataFrame:
    """Codes that are not used, expired or not."""
    return df.filter(~F.col("is_verified"))


def pending_for(jobs: DataFrame, instance: str, path: str = "$.target_server_public_key") -> DataFrame:
    """Pending jobs whose request, a JSON text, names the instance."""
    return jobs.filter((F.col("status") == "pending") & (F.get_json_object("request_data", path) == instance))


def in_progress(jobs: DataFrame, key: str, limit: int) -> DataFrame:
    """The newest `limit` jobs of each key that are pending or processing."""
    order = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.filter(F.col("status").isin("pending", "processing")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit)


def keys_for_identity(keys: DataFrame, api_url: str | None = None) -> DataFrame:
    """Keys that hold a share, of one API where given."""
    held = keys.filter(F.col("encrypted_secret_share").isNotNull())
    return held if api_url is None else held.filter(F.col("api_url") == api_url)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows of the given values; a DataFrame as value stands for all values of its column of that name."""
    for name, value in keys.items():
        df = df.join(value.select(name).distinct(), name, "left_semi") if isinstance(value, DataFrame) else df.filter(F.col(name) == value)
    return df


def normalize_doc_type(column: Column) -> Column:
    """The known name of a document type in any of its forms; others stay, in lower case."""
    low = F.lower(F.trim(column))
    return F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in DOC_TYPES.items()], low)


def valid_submission(column: Column) -> Column:
    """Whether a document type is known."""
    return F.coalesce(normalize_doc_type(column).isin(*KNOWN_TYPES), F.lit(False))


def statement_fresh(date: Column, as_of: datetime.date, days: int = 90) -> Column:
    return F.coalesce(F.datediff(F.lit(as_of), date).between(0, days), F.lit(False))


def id_valid(expiry: Column, as_of: datetime.date, days: int = 180) -> Column:
    return F.coalesce(F.datediff(expiry, F.lit(as_of)) >= days, F.lit(False))


def age(born: Column, as_of: datetime.date) -> Column:
    """Whole years."""
    return F.floor(F.months_between(F.lit(as_of), born) / 12).cast("int")


def min_age(born: Column, as_of: datetime.date, years: int = 18) -> Column:
    return F.coalesce(age(born, as_of) >= years, F.lit(False))


def fresh_request(ts: Column, as_of: Column, future: int = 60, past: int = 300) -> Column:
    """Whether a request lies at most `future` seconds ahead and `past` seconds back."""
    return F.coalesce((F.unix_timestamp(as_of) - F.unix_timestamp(ts)).between(-future, past), F.lit(False))


def latest_key(df: DataFrame, by: str) -> DataFrame:
    """The newest row of each value of `by`, by created_at and id."""
    order = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("id"))
    return df.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def latest_per_type(df: DataFrame) -> DataFrame:
    """The newest submission of each user and document type, by submitted_at and id."""
    order = Window.partitionBy("user_id", "document_type").orderBy(F.desc("submitted_at"), F.desc("id"))
    return df.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def key_embeddings(keys: DataFrame, faces: DataFrame) -> DataFrame:
    """For each key the vectors of its identity, newest first: key_id, vectors (ids); an empty list without any."""
    newest = F.sort_array(F.collect_list(F.struct("created_at", "vec_id")), asc=False)
    listed = faces.groupBy("identity").agg(F.transform(newest, lambda x: x["vec_id"]).alias("vectors"))
    return with_identity(keys, listed).select("key_id", F.coalesce("vectors", F.array().cast("array<long>")).alias("vectors"))


#: Parts into which the keys of one identity are dealt.
KEY_PARTS = 32


def with_identity(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """keys with the one row of listed of their identity, where there is one; an identity's keys are dealt into parts, each with a copy of its row."""
    dealt = keys.withColumn("part", F.pmod(F.xxhash64("key_id"), F.lit(KEY_PARTS)).cast("int"))
    copies = listed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(KEY_PARTS - 1))))
    return dealt.join(copies, ["identity", "part"], "left").drop("part")


def validate_otp(jobs: DataFrame, otps: DataFrame, window: int = 300) -> DataFrame:
    """Status of each job's code by the times of job and code: job_id, otp_status.

    jobs has job_id, number, code, created_at; otps one row for each number: number, otp_code, is_verified,
    attempts, max_attempts, otp_created_at. A row without a time on either side passes the window.
    """
    joined = jobs.join(otps, "number", "left")
    apart = F.abs(F.unix_micros("created_at") - F.unix_micros("otp_created_at")) > window * 1_000_000
    status = (
        F.when(F.col("created_at").isNull(), "job_not_found").when(F.col("is_verified").isNull(), "not_found").when(F.col("is_verified"), "already_used")
        .when(F.col("attempts") >= F.col("max_attempts"), "max_attempts_exceeded").when(~F.col("otp_code").eqNullSafe(F.col("code")), "invalid_code").when(F.coalesce(apart, F.lit(False)), "window_exceeded").otherwise("verified")
    )
    return joined.select("job_id", status.alias("otp_status"))


def type_averages(jobs: DataFrame, as_of: datetime.datetime, days: int = 30) -> DataFrame:
    """Mean processing seconds and number of completed jobs of each type in the days before as_of."""
    recent = jobs.filter(F.col("completed_at").between(F.lit(as_of - datetime.timedelta(days=days)), F.lit(as_of)) & F.col("seconds").isNotNull())
    return recent.groupBy("document_type").agg(F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.count(F.lit(1)).alias("jobs"))


def queue_eta(queue: DataFrame, averages: DataFrame, default: float = 60.0) -> DataFrame:
    """Adds position and expected seconds of each queued job: the means of those before it and its own.

    queue has instance, job_id, created_at, document_type. The order is of one instance's queue.
    """
    timed = queue.join(small(averages.select("document_type", "mean_seconds")), "document_type", "left").withColumn("own", F.coalesce("mean_seconds", F.lit(default)))
    order = Window.partitionBy("instance").orderBy("created_at", "job_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return timed.withColumn("position", F.row_number().over(order)).withColumn("eta_seconds", F.round(F.sum("own").over(upto), 4)).drop("own", "mean_seconds")


def queue_stats(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """One row: jobs in all and of each status."""
    return jobs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def pending_stats(df: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """One row: pending keys, age of the oldest in hours, and those of the last hour."""
    hours = lambda c: (F.lit(as_of).cast("timestamp").cast("double") - c.cast("timestamp").cast("double")) / 3600
    return df.agg(F.count(F.lit(1)).alias("total"), F.round(hours(F.min("created_at")), 4).alias("oldest_hours"), F.count_if(hours(F.col("created_at")) <= 1).alias("last_hour"))


def max_state(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.max("state").alias("state"))


def rate_limit(df: DataFrame, per_hour: int = PER_HOUR, per_day: int = PER_DAY) -> DataFrame:
    """Adds last_hour, last_day (earlier submissions of the user, this one not counted) and allowed.

    Rows of a user at the same microsecond do not count each other.
    """
    back = Window.partitionBy("user_id").orderBy(F.unix_micros("submitted_at"))
    count = lambda seconds: F.count(F.lit(1)).over(back.rangeBetween(-seconds * 1_000_000, -1))
    counted = df.withColumn("last_hour", count(3600)).withColumn("last_day", count(86400))
    return counted.withColumn("allowed", (F.col("last_hour") < per_hour) & (F.col("last_day") < per_day))


def fifo(jobs: DataFrame, n: int) -> DataFrame:
    """The n oldest pending jobs."""
    return jobs.filter("status = 'pending'").orderBy("created_at", "job_id").limit(n)


def upsert(target: DataFrame, updates: DataFrame, key: str, keep_null: bool = True) -> DataFrame:
    """target with the rows of updates: new keys are added, values replaced; with keep_null a null leaves the old value.

    updates has one row for each key and a part of the target's columns.
    """
    changed = [c for c in updates.columns if c != key]
    new = updates.select(key, F.lit(True).alias("_found"), *[F.col(c).alias(f"_{c}") for c in changed])
    joined = target.join(new, key, "full_outer")
    value = lambda c: F.coalesce(f"_{c}", c) if keep_null else F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c))
    return joined.select(*[value(c).alias(c) if c in changed else F.col(c) for c in target.columns])


def promote(pending: DataFrame, active: DataFrame, verified: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Active rows with those of pending that were verified, and what stays pending."""
    return active.unionByName(pending.join(verified, key, "left_semi"), allowMissingColumns=True), pending.join(verified, key, "left_anti")


def expire(df: DataFrame, as_of: datetime.datetime, hours: float, column: str = "created_at") -> DataFrame:
    """Rows that are not older than so many hours; those without a time stay."""
    return df.filter(F.col(column).isNull() | (F.col(column) >= F.lit(as_of - datetime.timedelta(hours=hours))))


def state_by_expiry(identities: DataFrame, as_of: datetime.date) -> DataFrame:
    """Sets state 1 where the passport expires within six months, then 2 where the statement is older than six; the second wins."""
    soon = F.col("passport_expiry_date") <= F.add_months(F.lit(as_of), 6)
    old = F.col("bank_statement_date") < F.add_months(F.lit(as_of), -6)
    return identities.withColumn("state", F.when(old, 2).when(soon, 1).otherwise(F.col("state")))


def reset_stale(jobs: DataFrame, as_of: datetime.datetime, hours: float = 1) -> DataFrame:
    """Jobs that have been processing for longer become pending again."""
    stale = (F.col("status") == "processing") & (F.col("started_at") < F.lit(as_of - datetime.timedelta(hours=hours)))
    return jobs.withColumns({"started_at": F.when(~F.coalesce(stale, F.lit(False)), F.col("started_at")), "status": F.when(stale, "pending").otherwise(F.col("status"))})


def transition(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """jobs with new states (job_id, new_status, at): a start sets started_at, an end completed_at."""
    joined = jobs.join(updates, "job_id", "left")
    ended = F.col("new_status").isin("completed", "failed")
    return joined.select(
        *[c for c in jobs.columns if c not in ("status", "started_at", "completed_at")],
        F.coalesce("new_status", "status").alias("status"),
        F.when(F.col("new_status") == "processing", F.col("at")).otherwise(F.col("started_at")).alias("started_at"),
        F.when(ended, F.col("at")).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def increment_state(df: DataFrame, ids: DataFrame, key: str, most: int = 3) -> DataFrame:
    """state of the given ids one higher, at most `most`."""
    found = ids.select(key).distinct().withColumn("_found", F.lit(True))
    return df.join(found, key, "left").withColumn("state", F.when(F.col("_found"), F.least(F.col("state") + 1, F.lit(most))).otherwise(F.col("state"))).drop("_found")


def deactivate_old(df: DataFrame, strategy: str = "replace") -> DataFrame:
    """Adds is_active and replaced_by: of a user's submissions of one type all but the newest are replaced by it.

    With any other strategy than `replace` the history is kept: all stay active.
    """
    if strategy != "replace":
        return df.withColumn("is_active", F.lit(True)).withColumn("replaced_by", F.lit(None).cast(df.schema["id"].dataType))
    whole = Window.partitionBy("user_id", "document_type")
    order = whole.orderBy(F.desc("submitted_at"), F.desc("id"))
    ranked = df.withColumn("nth", F.row_number().over(order)).withColumn("newest", F.first("id").over(order))
    return ranked.withColumn("is_active", F.col("nth") == 1).withColumn("replaced_by", F.when(F.col("nth") > 1, F.col("newest"))).drop("nth", "newest")


def erase_subject(tables: dict[str, tuple[DataFrame, str]], subjects: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables (name to table and its key column) without the subjects' rows, and a report: table, erased."""
    left, counts = {}, []
    for name, (df, column) in tables.items():
        ids = subjects.select(F.col(key).alias(column)).distinct()
        left[name] = df.join(ids, column, "left_anti")
        counts.append(df.join(ids, column, "left_semi").agg(F.count(F.lit(1)).alias("erased")).select(F.lit(name).alias("table"), "erased"))
    return left, reduce(DataFrame.unionByName, counts)


def link_jobs(jobs: DataFrame, links: DataFrame) -> DataFrame:
    """jobs with the identity given in links (job_id, identity) where they have none or another."""
    return upsert(jobs, links.join(jobs.select("job_id"), "job_id", "left_semi"), "job_id")


def delete_jobs(jobs: DataFrame, ids: DataFrame, completed_only: bool = False) -> DataFrame:
    """jobs without the given ones, or without those of them that are completed."""
    gone = ids.select("job_id").distinct().withColumn("_gone", F.lit(True))
    drop = F.col("_gone").isNotNull() & (F.col("status") == "completed") if completed_only else F.col("_gone").isNotNull()
    return jobs.join(gone, "job_id", "left").filter(~F.coalesce(drop, F.lit(False))).drop("_gone")


def add_faces(faces: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """faces with the new ones that it does not have."""
    return faces.unionByName(new.join(faces.select(key), key, "left_anti"), allowMissingColumns=True)


def drop_faces(faces: DataFrame, identities: DataFrame) -> DataFrame:
    """faces without those of the given identities."""
    return faces.join(identities.select("identity").distinct(), "identity", "left_anti")


def inventory_diff(current: DataFrame, stored: DataFrame, key: str = "path", hash_: str = "hash") -> DataFrame:
    """Changes from stored to current: key and change (new, removed, replaced)."""
    a = current.select(key, F.col(hash_).alias("a"))
    b = stored.select(key, F.col(hash_).alias("b"))
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "replaced")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def unindexed(source: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows of source whose key the index lacks."""
    return source.join(index.select(key).distinct(), key, "left_anti")


def append_submissions(df: DataFrame, large: list[str], limit: int = 1000) -> DataFrame:
    """Replaces values of the map `request` that are named as large, or long, by a marker of their length."""
    marked = F.transform_values("request", lambda k, v: F.when(k.isin(*large) | (F.length(v) > limit), F.concat(F.lit("<"), F.length(v).cast("string"), F.lit(" characters>"))).otherwise(v))
    return df.withColumn("request", marked)


def bootstrap_from_peers(local: DataFrame, peers: list[DataFrame], key: str, order: str) -> DataFrame:
    """local with the newest of all peers' rows of each key that it lacks or has older."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [local, *peers])
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return every.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")
