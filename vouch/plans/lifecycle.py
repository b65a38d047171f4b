"""Queries of the lifecycle, verification and series operators over the given tables, with their SQL for DuckDB."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from vouch.operators import lifecycle as L, series as S, verify as V
from vouch.plans.tables import table

Q, O = {}, {}
AS_OF = datetime.datetime(2024, 1, 31)
T = "TIMESTAMP '2024-01-31'"


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return add


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


OTPS = """otps AS (SELECT event_id, user_id AS number, ts AS created_at, CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 20 DAY END AS expires_at, event_id % 4 = 0 AS is_verified, event_id % 6 AS attempts, 4 AS max_attempts, event_id % 3 AS code FROM events WHERE event_type = 'signup')"""


def _otps(spark, sf_dir):
    e = _events(spark, sf_dir).filter("event_type = 'signup'")
    id_ = F.col("event_id")
    expires = F.when(id_ % 5 != 0, F.col("ts") + F.expr("INTERVAL 20 DAYS"))
    return e.select("event_id", F.col("user_id").alias("number"), F.col("ts").alias("created_at"), expires.alias("expires_at"), (id_ % 4 == 0).alias("is_verified"), (id_ % 6).alias("attempts"), F.lit(4).alias("max_attempts"), (id_ % 3).alias("code"))


@query("p6_valid_otps", f"WITH {OTPS} SELECT event_id FROM otps WHERE NOT is_verified AND (expires_at IS NULL OR expires_at > {T})")
def p6(spark, sf_dir):
    return L.valid_otps(_otps(spark, sf_dir), AS_OF).select("event_id")


@query("p7_unverified_otps", f"WITH {OTPS} SELECT event_id FROM otps WHERE NOT is_verified")
def p7(spark, sf_dir):
    return L.unverified_otps(_otps(spark, sf_dir)).select("event_id")


JOBS = """jobs AS (SELECT event_id AS job_id, user_id, event_type AS document_type, ts AS created_at, props AS request_data, value AS seconds, user_id % 7 AS instance,
    ['pending', 'processing', 'completed', 'failed'][1 + event_id % 4] AS status, ts + INTERVAL 1 MINUTE AS started_at, CASE WHEN event_id % 4 = 2 THEN ts + INTERVAL 2 MINUTE END AS completed_at FROM events)"""


def _jobs(spark, sf_dir):
    e, id_ = _events(spark, sf_dir), F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ["pending", "processing", "completed", "failed"])), (1 + id_ % 4).cast("int"))
    return e.select(
        id_.alias("job_id"), "user_id", F.col("event_type").alias("document_type"), F.col("ts").alias("created_at"), F.col("props").alias("request_data"), F.col("value").alias("seconds"), (F.col("user_id") % 7).alias("instance"),
        status.alias("status"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("started_at"), F.when(id_ % 4 == 2, F.col("ts") + F.expr("INTERVAL 2 MINUTES")).alias("completed_at"),
    )


@query("p8_pending_for", f"WITH {JOBS} SELECT job_id FROM jobs WHERE status = 'pending' AND request_data->>'$.k' = '7'")
def p8(spark, sf_dir):
    return L.pending_for(_jobs(spark, sf_dir), "7", "$.k").select("job_id")


@query("p9_in_progress", f"WITH {JOBS} SELECT user_id, job_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id DESC) AS nth FROM jobs WHERE status IN ('pending', 'processing')) WHERE nth <= 3")
def p9(spark, sf_dir):
    return L.in_progress(_jobs(spark, sf_dir), "user_id", 3).select("user_id", "job_id", "nth")


@query("p10_keys_for_identity", "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'MACHINERY'")
def p10(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("api_url"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("encrypted_secret_share"))
    return L.keys_for_identity(keys, "MACHINERY").select("id")


@query("p11_strip_meta", """SELECT o_orderkey, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT o_orderkey, unnest(['priority', '_status', o_orderstatus, '_' || o_orderpriority]) AS k FROM orders) WHERE k[1:1] <> '_' GROUP BY 1""")
def p11(spark, sf_dir):
    fields = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("_status"), F.col("o_orderstatus"), F.col("o_orderstatus"), F.lit("x"), F.concat(F.lit("_"), F.col("o_orderpriority")), F.lit("y"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(F.map_keys(V.strip_meta(fields))), ",").alias("names"))


@query("p12_high_confidence", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity / 50 >= 0.8")
def p12(spark, sf_dir):
    return V.high_confidence(table(spark, sf_dir, "lineitem").withColumn("confidence", F.col("l_quantity").cast("double") / 50)).select("l_orderkey", "l_linenumber")


@query("p13_normalize_doc_type", "SELECT event_id, CASE event_type WHEN 'view' THEN 'id_card' WHEN 'click' THEN 'bank_statement' WHEN 'error' THEN 'passport' ELSE event_type END AS document_type, event_type IN ('view', 'click', 'error') AS known FROM events")
def p13(spark, sf_dir):
    kind = F.col("event_type")
    given = F.when(kind == "view", " ID Card").when(kind == "click", "Bank Statement").when(kind == "error", "PASSPORT").otherwise(kind)
    return _events(spark, sf_dir).select("event_id", L.normalize_doc_type(given).alias("document_type"), L.valid_submission(given).alias("known"))


@query("p15_freshness", """SELECT o_orderkey, date_diff('day', o_orderdate, DATE '1998-06-01') BETWEEN 0 AND 90 AS fresh, date_diff('day', DATE '1998-06-01', o_orderdate) >= 180 AS valid,
    date_part('year', age(DATE '2016-06-01', o_orderdate)) >= 18 AS of_age FROM orders""")
def p15(spark, sf_dir):
    day, later, date = datetime.date(1998, 6, 1), datetime.date(2016, 6, 1), F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", L.statement_fresh(date, day).alias("fresh"), L.id_valid(date, day).alias("valid"), L.min_age(date, later).alias("of_age"))


@query("p16_fresh_request", "SELECT event_id, epoch(date_trunc('second', ts + to_seconds(CAST(floor(value) AS BIGINT)))) - epoch(date_trunc('second', ts)) BETWEEN -60 AND 30 AS fresh FROM events")
def p16(spark, sf_dir):
    seen = F.timestamp_micros(F.unix_micros("ts") + F.floor("value") * 1_000_000)
    return _events(spark, sf_dir).select("event_id", L.fresh_request(F.col("ts"), seen, past=30).alias("fresh"))


@query("p17_lookup", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def p17(spark, sf_dir):
    owing = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return L.lookup(table(spark, sf_dir, "orders"), o_orderstatus="F", o_custkey=owing).select("o_orderkey")


@query("p18_liveness", "SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN value END / 100 >= 0.7, false) AS live FROM events")
def p18(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", V.liveness_ok(F.when(F.col("event_id") % 3 != 0, F.col("value") / 100)).alias("live"))


@query("p19_drop_failed", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'a,b' END AS names FROM orders")
def p19(spark, sf_dir):
    failed = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("b"))).otherwise(F.array(F.lit("c")))
    fields = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.map_keys(V.drop_failed(fields, failed)), ",").alias("names"))


@query("j9_key_embeddings", "SELECT c_custkey AS key_id, array_to_string(list(vec_id ORDER BY vec_id DESC) FILTER (vec_id IS NOT NULL), ',') AS vectors FROM customer LEFT JOIN embeddings ON label = c_custkey % 20 GROUP BY 1".replace("AS vectors FROM", "AS v FROM").replace("SELECT c_custkey", "SELECT key_id, coalesce(v, '') AS vectors FROM (SELECT c_custkey") + ")")
def j9(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_id"), (F.col("c_custkey") % 20).cast("int").alias("identity"))
    faces = table(spark, sf_dir, "embeddings").select(F.col("label").alias("identity"), "vec_id", F.col("vec_id").alias("created_at"))
    # Each identity's list is written out once, not for each of its keys.
    listed = L.key_embeddings(keys.select("identity", F.col("identity").alias("key_id")).distinct(), faces)
    listed = listed.select(F.col("key_id").alias("identity"), F.array_join(F.col("vectors").cast("array<string>"), ",").alias("vectors"))
    return L.with_identity(keys, listed).select("key_id", "vectors")


@query("j10_validate_otp", f"""WITH {OTPS}, o AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY created_at DESC, event_id DESC) AS n FROM otps),
    j AS (SELECT event_id AS job_id, user_id AS number, event_id % 3 AS asked, ts FROM events WHERE event_type = 'purchase')
    SELECT job_id, CASE WHEN is_verified IS NULL THEN 'not_found' WHEN is_verified THEN 'already_used' WHEN attempts >= max_attempts THEN 'max_attempts_exceeded' WHEN code <> asked THEN 'invalid_code'
           WHEN abs(epoch_us(ts) - epoch_us(created_at)) > 604800000000 THEN 'window_exceeded' ELSE 'verified' END AS otp_status
    FROM j LEFT JOIN (SELECT * FROM o WHERE n = 1) USING (number)""")
def j10(spark, sf_dir):
    latest = L.latest_key(_otps(spark, sf_dir).withColumnRenamed("event_id", "id"), "number")
    otps = latest.select("number", F.col("code").alias("otp_code"), "is_verified", "attempts", "max_attempts", F.col("created_at").alias("otp_created_at"))
    jobs = _events(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("number"), (F.col("event_id") % 3).alias("code"), F.col("ts").alias("created_at"))
    return L.validate_otp(jobs, otps, 7 * 86400)


@query("j11_latest_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY 1")
def j11(spark, sf_dir):
    return L.latest_key(_events(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("created_at")), "user_id").select("user_id", "id")


@query("j12_verify_fields", """SELECT o_orderkey AS doc_id, 3 AS asked, CAST(o_orderstatus = 'F' AS INTEGER) + CAST(o_orderkey % 2 = 0 AS INTEGER) AS agreeing, 1 AS missing,
    CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'address,' END || 'country' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ',name' END AS disagreeing FROM orders""")
def j12(spark, sf_dir):
    id_, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    expected = orders.select(id_.alias("doc_id"), F.create_map(F.lit("name"), F.lit("Jo Lee"), F.lit("address"), F.lit("1 Low Road"), F.lit("country"), F.lit("x"), F.lit("_meta"), F.lit("x")).alias("fields"))
    found = orders.select(id_.alias("doc_id"), F.create_map(F.lit("name"), F.when(id_ % 2 == 0, F.lit("JO  LEE")).otherwise("other"), F.lit("address"), F.when(F.col("o_orderstatus") == "F", F.lit("1 low road")).otherwise("2")).alias("fields"))
    return V.verify_fields(expected, found).withColumn("disagreeing", F.array_join("disagreeing", ","))


@query("j17_unindexed", "SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0")
def j17(spark, sf_dir):
    store = table(spark, sf_dir, "embeddings").select("vec_id")
    return L.unindexed(store, store.filter("vec_id % 3 = 0"), "vec_id")


EXTRACTED = """p AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS f, max(l_quantity) * 2 AS pc FROM lineitem GROUP BY 1, 2), s AS (SELECT l_orderkey AS doc_id, l_linenumber % 4 AS f, max(l_tax) * 1000 AS sc FROM lineitem GROUP BY 1, 2)"""


@query("j22_merge_extractions", f"""WITH {EXTRACTED}, j AS (SELECT coalesce(p.doc_id, s.doc_id) AS doc_id, coalesce(p.f, s.f) AS f, pc, sc FROM p FULL JOIN s ON p.doc_id = s.doc_id AND p.f = s.f),
    m AS (SELECT *, (coalesce(pc >= 50, false) AND f <> 2) OR (sc IS NULL AND f <> 2 AND pc IS NOT NULL) AS one FROM j), v AS (SELECT doc_id, f, CASE WHEN one THEN 'primary' ELSE 'secondary' END AS source, round(CASE WHEN one THEN pc ELSE coalesce(sc, 0) END, 4) AS confidence FROM m)
    SELECT doc_id, 'f' || f AS field, source, confidence, round(coalesce(avg(CASE WHEN f IN (0, 1) AND confidence > 0 THEN confidence END) OVER (PARTITION BY doc_id), 0), 2) AS overall FROM v""")
def j22(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    side = lambda m, c: lines.groupBy(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), (F.col("l_linenumber") % m).cast("string")).alias("field")).agg(F.round(F.max(c).cast("double"), 4).alias("confidence")).withColumn("value", F.lit("v"))
    merged = V.merge_extractions(side(3, F.col("l_quantity") * 2), side(4, F.col("l_tax") * 1000), ["f0", "f1"], ["f2"])
    return merged.select("doc_id", "field", "source", "confidence", "overall")


@query("j23_merge_keys", "WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS k FROM lineitem WHERE l_tax > 0.02), b AS (SELECT l_orderkey AS doc_id, l_linenumber AS k FROM lineitem WHERE l_discount > 0.05) SELECT doc_id, k AS key_name, 'layout' AS origin FROM b UNION ALL SELECT doc_id, k, 'pattern' FROM a WHERE (doc_id, k) NOT IN (SELECT doc_id, k FROM b)")
def j23(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("key_name"), F.lit("v").alias("value"), F.lit(0.5).alias("confidence"), "l_tax", "l_discount")
    return V.merge_keys(keys.filter("l_tax > 0.02"), keys.filter("l_discount > 0.05")).select("doc_id", "key_name", "origin")


@query("a8_consistency")
def a8(spark, sf_dir):
    """Rests on Jaro-Winkler, which SQL rounds differently; tested by brute force."""
    return V.consistency(table(spark, sf_dir, "part"), "p_brand", "p_name")


@query("a9_all_equal", "SELECT l_orderkey, count(DISTINCT l_returnflag) <= 1 AS equal FROM lineitem GROUP BY 1")
def a9(spark, sf_dir):
    return V.all_equal(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("a10_cross_validate", """WITH d AS (SELECT l_orderkey AS identity, l_returnflag AS name, l_linestatus AS address, l_quantity + 40 AS face, l_tax > 0.05 AS otp FROM lineitem)
    SELECT identity, count(DISTINCT name) <= 1 AS names, count(DISTINCT address) <= 1 AS addresses, bool_and(face >= 70) AS faces, bool_or(otp) AS otp,
           count(DISTINCT name) <= 1 AND count(DISTINCT address) <= 1 AND bool_and(face >= 70) AND bool_or(otp) AS passed FROM d GROUP BY 1""")
def a10(spark, sf_dir):
    docs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("identity"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("address"), (F.col("l_quantity").cast("double") + 40).alias("face_score"), (F.col("l_tax") > 0.05).alias("otp_verified"))
    return V.cross_validate(docs)


CHECKS = "c AS (SELECT o_custkey AS identity, CASE o_orderstatus WHEN 'F' THEN 'passport' WHEN 'O' THEN 'selfie' ELSE 'other' END AS document_type, (o_orderkey % 10) / 10.0 AS score FROM orders)"


def _checks(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "passport").when(F.col("o_orderstatus") == "O", "selfie").otherwise("other")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("identity"), kind.alias("document_type"), ((F.col("o_orderkey") % 10) / 10.0).alias("score"), F.lit(None).cast("double").alias("threshold"))


@query("a11_docs_auth_score", f"""WITH {CHECKS}, s AS (SELECT identity, document_type, count(*) AS n, count(*) FILTER (score < 0.5) AS ok FROM c WHERE document_type IN ('passport', 'selfie', 'id_card') GROUP BY 1, 2),
    w AS (SELECT DISTINCT identity, unnest(['passport', 'selfie', 'id_card']) AS document_type FROM c) SELECT identity, round(sum(coalesce(ok, 0)) / sum(coalesce(n, 1)) * 100, 2) AS docs_auth_score FROM w LEFT JOIN s USING (identity, document_type) GROUP BY 1""")
def a11(spark, sf_dir):
    return V.docs_auth_score(_checks(spark, sf_dir), ["passport", "selfie", "id_card"])


@query("a11_id_veri_score", f"""WITH {CHECKS}, s AS (SELECT identity, least(count(*) FILTER (score < 0.5), CASE document_type WHEN 'passport' THEN 4 ELSE 3 END) AS ok FROM c WHERE document_type IN ('passport', 'selfie') GROUP BY identity, document_type),
    t AS (SELECT identity, sum(ok) AS ok FROM s GROUP BY 1) SELECT identity, round(coalesce(ok, 0) / 8.0 * 100, 2) AS id_veri_score FROM (SELECT DISTINCT identity FROM c) LEFT JOIN t USING (identity)""")
def a11b(spark, sf_dir):
    return V.id_veri_score(_checks(spark, sf_dir).withColumn("passed", F.col("score") < 0.5), {"passport": 4, "selfie": 3, "id_card": 1})


@query("a12_type_averages", f"WITH {JOBS} SELECT document_type, round(avg(seconds), 4) AS mean_seconds, count(*) AS jobs FROM jobs WHERE completed_at BETWEEN {T} - INTERVAL 30 DAY AND {T} GROUP BY 1")
def a12(spark, sf_dir):
    return L.type_averages(_jobs(spark, sf_dir), AS_OF)


@query("w8_queue_eta", f"""WITH {JOBS}, a AS (SELECT document_type, round(avg(seconds), 4) AS m FROM jobs WHERE completed_at BETWEEN {T} - INTERVAL 30 DAY AND {T} GROUP BY 1)
    SELECT job_id, row_number() OVER w AS position, round(sum(m) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS eta_seconds FROM jobs JOIN a USING (document_type) WHERE status = 'pending' WINDOW w AS (PARTITION BY instance ORDER BY created_at, job_id)""")
def w8(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return L.queue_eta(jobs.filter("status = 'pending'"), L.type_averages(jobs, AS_OF)).select("job_id", "position", "eta_seconds")


@query("a13_queue_stats", f"WITH {JOBS} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed FROM jobs")
def a13(spark, sf_dir):
    return L.queue_stats(_jobs(spark, sf_dir), ["pending", "failed"])


@query("a14_pending_stats", f"SELECT count(*) AS total, round((epoch_us({T}) - epoch_us(min(ts))) / 3.6e9, 4) AS oldest_hours, count(*) FILTER ((epoch_us({T}) - epoch_us(ts)) / 3.6e9 <= 1) AS last_hour FROM events")
def a14(spark, sf_dir):
    return L.pending_stats(_events(spark, sf_dir).withColumn("created_at", F.col("ts")), AS_OF)


@query("a15_max_state", "SELECT user_id, max(event_id % 5) AS state FROM events GROUP BY 1")
def a15(spark, sf_dir):
    return L.max_state(_events(spark, sf_dir).withColumn("state", F.col("event_id") % 5), "user_id")


SCORES = "s AS (SELECT l_orderkey AS doc_id, 'm' || l_linenumber AS method, CAST(l_discount AS DOUBLE) * 5 AS score FROM lineitem), t AS (SELECT 'm' || i AS method, CAST(i AS DOUBLE) / 10 AS threshold FROM range(1, 8) r(i))"


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("method"), (F.col("l_discount").cast("double") * 5).alias("score"))


def _limits(spark):
    return spark.range(1, 8).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("method"), (F.col("id") / 10).alias("threshold"))


@query("a17_forgery_summary", f"WITH {SCORES} SELECT doc_id, count(*) AS methods, count(*) FILTER (score > 0.1) AS detections, round(avg(score), 6) AS probability, count(*) FILTER (score > 0.1) >= 3 AS rejected FROM s GROUP BY 1")
def a17(spark, sf_dir):
    return V.forgery_summary(_scores(spark, sf_dir))


@query("a18_method_bands", f"""WITH {SCORES}, e AS (SELECT doc_id, count(*) FILTER (score < threshold / 2) AS low, count(*) FILTER (score >= threshold / 2 AND score < threshold) AS medium, count(*) FILTER (score >= threshold) AS high, count(*) AS n FROM s JOIN t USING (method) GROUP BY 1)
    SELECT doc_id, low, medium, high, round(high / n, 6) AS share, CASE WHEN high = 0 THEN 'authentic' WHEN high / n <= 0.3 THEN 'minor' WHEN high / n <= 0.7 THEN 'mixed' ELSE 'strong' END AS summary FROM e""")
def a18(spark, sf_dir):
    return V.method_bands(_scores(spark, sf_dir), _limits(spark))


@query("a19_threshold_status", f"""WITH {SCORES} SELECT doc_id, method, CASE WHEN score >= threshold + CASE WHEN method = 'm3' AND doc_id % 2 = 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END THEN 'problem' WHEN score >= threshold / 2 THEN 'warning' ELSE 'ok' END AS status FROM s JOIN t USING (method)""")
def a19(spark, sf_dir):
    general = _limits(spark).select(F.lit("default").alias("document_type"), "method", F.col("threshold").alias("problem"), (F.col("threshold") * 0.5).alias("warning"))
    own = general.filter("method = 'm3'").withColumn("document_type", F.lit("even")).withColumn("problem", F.col("problem") + 0.1)
    scores = _scores(spark, sf_dir).withColumn("document_type", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    return V.threshold_status(scores, general.unionByName(own)).select("doc_id", "method", "status")


KEYS = "k AS (SELECT l_orderkey AS doc_id, 'k' || l_linenumber AS key_name, CAST(l_quantity AS DOUBLE) / 50 AS confidence, l_linenumber <= 3 AS required FROM lineitem)"


def _keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("key_name"), (F.col("l_quantity").cast("double") / 50).alias("confidence"), (F.col("l_linenumber") <= 3).alias("required"))


@query("a20_extraction_summary", f"WITH {KEYS} SELECT doc_id, count(*) AS keys, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.7 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.7) AS low, count(*) FILTER (required) AS required, count(*) FILTER (NOT required) AS optional FROM k GROUP BY 1")
def a20(spark, sf_dir):
    return V.extraction_summary(_keys(spark, sf_dir))


@query("a21_completeness", f"""WITH {KEYS}, b AS (SELECT doc_id, key_name, max(confidence) AS c FROM k GROUP BY 1, 2), w AS (SELECT DISTINCT doc_id, unnest(['k1', 'k2', 'k3']) AS key_name FROM k),
    j AS (SELECT doc_id, coalesce(string_agg(key_name, ',' ORDER BY key_name) FILTER (c IS NULL), '') AS missing, coalesce(string_agg(key_name, ',' ORDER BY key_name) FILTER (c < 0.7), '') AS low FROM w LEFT JOIN b USING (doc_id, key_name) GROUP BY 1) SELECT *, missing = '' AND low = '' AS complete FROM j""")
def a21(spark, sf_dir):
    return V.completeness(_keys(spark, sf_dir), ["k1", "k2", "k3"]).withColumns({c: F.array_join(c, ",") for c in ("missing", "low")})


@query("a32_identity_progress", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE '' END || CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN ',' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN 'b' ELSE '' END AS completed, round((CAST(event_id % 2 = 0 AS INTEGER) + CAST(event_id % 3 = 0 AS INTEGER)) / 3 * 100, 2) AS percent FROM events")
def a32(spark, sf_dir):
    id_ = F.col("event_id")
    steps = _events(spark, sf_dir).select("event_id", F.when(id_ % 2 == 0, 1).alias("a"), F.when(id_ % 3 == 0, 1).alias("b"), F.lit(None).cast("int").alias("c"))
    return V.identity_progress(steps, ["a", "b", "c"]).select("event_id", F.array_join("completed", ",").alias("completed"), "percent")


@query("a34_record_confidence", "SELECT l_orderkey, l_linenumber, least(50.0 + 5 * l_linenumber, 85.0) AS card, greatest(0, least(100, 100 - 20 * l_linenumber + 5 * CAST(l_quantity AS INTEGER))) AS id FROM lineitem")
def a34(spark, sf_dir):
    n, q = F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.record_confidence(n).alias("card"), V.id_confidence(n, q).alias("id"))


@query("n2_adaptive_threshold", "SELECT l_orderkey, l_linenumber, round(greatest(0.1, least(0.9, 0.5 * (CAST(l_quantity AS DOUBLE) / 25) * (1 - CAST(l_discount AS DOUBLE)))), 6) AS threshold FROM lineitem")
def n2(spark, sf_dir):
    base = V.adaptive_threshold(F.lit(0.5), F.col("l_quantity").cast("double") / 25, 1 - F.col("l_discount").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(base, 6).alias("threshold"))


SUBS = "subs AS (SELECT event_id AS id, user_id, event_type AS document_type, ts AS submitted_at FROM events)"


def _subs(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("document_type"), F.col("ts").alias("submitted_at"))


@query("w1_latest_per_type", f"WITH {SUBS} SELECT user_id, document_type, arg_max(id, (submitted_at, id)) AS id FROM subs GROUP BY 1, 2")
def w1(spark, sf_dir):
    return L.latest_per_type(_subs(spark, sf_dir)).select("user_id", "document_type", "id")


@query("w9_rate_limit", f"""WITH {SUBS}, c AS (SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(submitted_at) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS last_hour,
    count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(submitted_at) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS last_day FROM subs) SELECT *, last_hour < 2 AND last_day < 8 AS allowed FROM c""")
def w9(spark, sf_dir):
    return L.rate_limit(_subs(spark, sf_dir), 2, 8).select("id", "last_hour", "last_day", "allowed")


@query("o3_fifo", f"WITH {JOBS} SELECT job_id FROM jobs WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 20")
def o3(spark, sf_dir):
    return L.fifo(_jobs(spark, sf_dir), 20).select("job_id")


@query("d1_upsert", "SELECT c_custkey, CASE WHEN o.k IS NOT NULL AND o.n > 5 THEN 'busy' ELSE c_mktsegment END AS c_mktsegment, coalesce(CAST(o.n AS DOUBLE), c_acctbal) AS c_acctbal FROM customer FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON k = c_custkey")
def d1(spark, sf_dir):
    updates = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")).select("c_custkey", F.when(F.col("n") > 5, "busy").alias("c_mktsegment"), F.col("n").cast("double").alias("c_acctbal"))
    return L.upsert(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), updates, "c_custkey")


@query("d2_promote", "SELECT event_id, event_type IN ('view') OR event_id % 3 = 0 AS active FROM events WHERE event_type IN ('signup', 'view')")
def d2(spark, sf_dir):
    e = _events(spark, sf_dir)
    active, pending = L.promote(e.filter("event_type = 'signup'"), e.filter("event_type = 'view'"), e.filter("event_id % 3 = 0").select("event_id"), "event_id")
    return active.select("event_id", F.lit(True).alias("active")).unionByName(pending.select("event_id", F.lit(False).alias("active")))


@query("d3_expire", f"SELECT event_id FROM events WHERE ts >= {T} - INTERVAL 168 HOUR")
def d3(spark, sf_dir):
    return L.expire(_events(spark, sf_dir), AS_OF, 168, "ts").select("event_id")


@query("d4_state_by_expiry", "SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 30 DAY < DATE '1997-12-01' THEN 2 WHEN o_orderdate <= DATE '1998-12-01' THEN 1 ELSE 0 END AS state FROM orders")
def d4(spark, sf_dir):
    day = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("passport_expiry_date"), F.date_add(day, 30).alias("bank_statement_date"), F.lit(0).alias("state"))
    return L.state_by_expiry(rows, datetime.date(1998, 6, 1)).select("o_orderkey", "state")


@query("d5_reset_stale", f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'processing' AND started_at < {T} - INTERVAL 48 HOUR THEN 'pending' ELSE status END AS status FROM jobs")
def d5(spark, sf_dir):
    return L.reset_stale(_jobs(spark, sf_dir), AS_OF, 48).select("job_id", "status")


@query("d6_transition", f"WITH {JOBS} SELECT job_id, CASE WHEN job_id % 6 = 0 THEN 'processing' WHEN job_id % 6 = 1 THEN 'completed' ELSE status END AS status, CASE WHEN job_id % 6 = 0 THEN {T} ELSE started_at END AS started_at, CASE WHEN job_id % 6 = 1 THEN {T} ELSE completed_at END AS completed_at FROM jobs")
def d6(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).select("job_id", "status", "started_at", "completed_at")
    updates = jobs.filter("job_id % 6 < 2").select("job_id", F.when(F.col("job_id") % 6 == 0, "processing").otherwise("completed").alias("new_status"), F.lit(AS_OF).cast("timestamp").alias("at"))
    return L.transition(jobs, updates)


@query("d7_increment_state", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN least(event_id % 4 + 1, 3) ELSE event_id % 4 END AS state FROM events")
def d7(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", (F.col("event_id") % 4).alias("state"))
    return L.increment_state(rows, rows.filter("event_id % 2 = 0"), "event_id")


@query("d8_deactivate_old", f"WITH {SUBS}, r AS (SELECT id, first_value(id) OVER (PARTITION BY user_id, document_type ORDER BY submitted_at DESC, id DESC) AS newest FROM subs) SELECT id, id = newest AS is_active, CASE WHEN id <> newest THEN newest END AS replaced_by FROM r")
def d8(spark, sf_dir):
    return L.deactivate_old(_subs(spark, sf_dir)).select("id", "is_active", "replaced_by")


@query("d9_erase_subject", "SELECT 'customer' AS \"table\", count(*) AS erased FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900)")
def d9(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return L.erase_subject({"customer": (customers, "c_custkey"), "orders": (table(spark, sf_dir, "orders"), "o_custkey")}, customers.filter("c_acctbal < -900"), "c_custkey")[1]


@query("d10_delete_jobs", f"WITH {JOBS} SELECT job_id FROM jobs WHERE NOT (job_id % 5 = 0 AND status = 'completed')")
def d10(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return L.delete_jobs(jobs, jobs.filter("job_id % 5 = 0"), completed_only=True).select("job_id")


@query("d10_link_jobs", f"WITH {JOBS} SELECT job_id, CASE WHEN job_id % 5 = 0 THEN user_id + 1000 ELSE user_id END AS identity FROM jobs")
def d10b(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).select("job_id", F.col("user_id").alias("identity"))
    return L.link_jobs(jobs, jobs.filter("job_id % 5 = 0").select("job_id", (F.col("identity") + 1000).alias("identity")))


@query("d11_faces", "SELECT vec_id FROM embeddings WHERE label <> 3")
def d11(spark, sf_dir):
    faces = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("identity"))
    whole = L.add_faces(faces.filter("vec_id % 2 = 0"), faces.filter("vec_id % 3 <> 0 or vec_id % 2 <> 0"))
    return L.drop_faces(whole, faces.filter("identity = 3")).select("vec_id")


@query("d11_checked_faces", """
    WITH RECURSIVE e AS (SELECT vec_id, label, vec_id % 2 AS model, vec_id % 3 = 1 AS fresh, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
    near AS (SELECT a.vec_id, b.vec_id AS other, b.fresh, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM e a JOIN e b ON a.fresh AND a.model = b.model AND a.label <> b.label
             WHERE (NOT b.fresh OR b.vec_id < a.vec_id) AND round(1 - list_cosine_similarity(a.v, b.v), 6) < 0.62),
    own AS (SELECT e.vec_id, row_number() OVER (ORDER BY e.vec_id) AS nth, coalesce(bool_or(NOT near.fresh), false) AS there, coalesce(list(near.other) FILTER (near.fresh), []) AS before
            FROM e LEFT JOIN near ON near.vec_id = e.vec_id WHERE e.fresh GROUP BY e.vec_id),
    step AS (SELECT 0::BIGINT AS nth, []::BIGINT[] AS taken UNION ALL
             SELECT own.nth, CASE WHEN there OR list_has_any(before, taken) THEN taken ELSE list_append(taken, own.vec_id) END FROM step JOIN own ON own.nth = step.nth + 1),
    taken AS (SELECT unnest(arg_max(taken, nth)) AS vec_id FROM step),
    dup AS (SELECT vec_id, min(distance) AS distance, arg_min(other, (distance, other)) AS other FROM near WHERE NOT fresh OR other IN (SELECT vec_id FROM taken) GROUP BY vec_id)
    SELECT own.vec_id, CASE WHEN dup.vec_id IS NULL THEN 'accepted' ELSE 'duplicate' END AS status, other AS of_id, distance FROM own LEFT JOIN dup ON dup.vec_id = own.vec_id""")
def d11_checked(spark, sf_dir):
    """Every third vector is new; those too near to another identity's, there or accepted before, are told and not added."""
    from vouch.operators import vectors

    faces = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("identity"), (F.col("vec_id") % 2).alias("model"), "embedding")
    return vectors.checked_faces(faces.filter("vec_id % 3 <> 1"), faces.filter("vec_id % 3 = 1"), 0.62).withColumnRenamed("of", "of_id")


@query("d12_update_columns", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_name END AS s_name FROM supplier")
def d12(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_name")
    changes = rows.filter("s_suppkey % 2 = 0").select("s_suppkey", (F.col("s_acctbal") + 1).alias("s_acctbal"), F.lit(None).cast("string").alias("s_name"))
    return L.upsert(rows, changes, "s_suppkey", keep_null=False)


@query("u2_inventory_diff", "SELECT vec_id AS path, CASE WHEN vec_id % 4 = 0 THEN 'new' WHEN vec_id % 4 = 1 THEN 'removed' ELSE 'replaced' END AS change FROM embeddings WHERE vec_id % 4 < 3")
def u2(spark, sf_dir):
    files = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), F.sha2(F.col("embedding").cast("string"), 256).alias("hash"))
    stored = files.withColumn("hash", F.when(F.col("path") % 4 == 2, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")))
    return L.inventory_diff(files.filter("path % 4 <> 1"), stored.filter("path % 4 <> 0"))


@query("s5_register_embeddings", "SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0")
def s5(spark, sf_dir):
    from vouch.sources.stores import register_embeddings

    faces = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("face"), "embedding")
    return register_embeddings(faces, faces.filter("vec_id % 3 = 0"))[0].select("vec_id")


@query("s12_append_submissions", "SELECT doc_id, CASE WHEN length(text) > 500 THEN '<' || length(text) || ' characters>' ELSE text END AS text, lang FROM documents")
def s12(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("text"), F.col("text"), F.lit("lang"), F.col("lang")).alias("request"))
    return L.append_submissions(rows, [], 500).select("doc_id", F.col("request")["text"].alias("text"), F.col("request")["lang"].alias("lang"))


@query("s16_bootstrap_from_peers", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_id % 5 < 3 GROUP BY 1")
def s16(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return L.bootstrap_from_peers(e.filter("event_id % 5 = 0"), [e.filter("event_id % 5 = 1"), e.filter("event_id % 5 = 2")], "user_id", "at").select("user_id", "event_id")


FRAMES = "f AS (SELECT conv_id AS video_id, turn AS frame_idx, length(role) AS value, (turn % 10) / 10.0 AS confidence FROM conversations), e AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_idx, event_id % 2 AS value, (event_id % 10) / 10.0 AS confidence FROM events), g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, value ORDER BY frame_idx) AS island FROM e), r AS (SELECT *, count(*) OVER (PARTITION BY video_id, value, island) AS size, min(frame_idx) OVER (PARTITION BY video_id, value, island) AS first FROM g)"


def _frames(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf_dir).select(F.col("user_id").alias("video_id"), F.row_number().over(order).alias("frame_idx"), (F.col("event_id") % 2).alias("value"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))


@query("w4_stable_runs", f"WITH {FRAMES} SELECT video_id, frame_idx, value FROM r WHERE size >= 3")
def w4(spark, sf_dir):
    return S.stable_runs(_frames(spark, sf_dir)).select("video_id", "frame_idx", "value")


@query("w5_segments", f"WITH {FRAMES} SELECT video_id, value, min(frame_idx) AS first, max(frame_idx) AS last, round(count(*) / 30, 4) AS seconds, round(avg(confidence), 6) AS confidence FROM r WHERE size >= 3 GROUP BY video_id, value, island")
def w5(spark, sf_dir):
    return S.segments(_frames(spark, sf_dir)).drop("run").withColumn("confidence", F.round("confidence", 6))


@query("w5_decode", f"WITH {FRAMES}, s AS (SELECT video_id, value, first, avg(confidence) AS c FROM r WHERE size >= 3 GROUP BY video_id, value, first) SELECT video_id, string_agg(value, '' ORDER BY first) AS code, round(avg(c), 6) AS confidence, count(*) = 6 AS valid FROM s GROUP BY 1")
def w5b(spark, sf_dir):
    return S.decode(S.segments(_frames(spark, sf_dir)), 6)


@query("w3_date_sequence", "WITH b AS (SELECT o_custkey AS doc_id, CAST(o_orderdate AS DATE) < lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS back FROM orders) SELECT doc_id, count(*) FILTER (back) AS inversions, count(*) FILTER (back) <= greatest(1.0, count(*) * 0.1) AS ok FROM b GROUP BY 1")
def w3(spark, sf_dir):
    return S.date_sequence_ok(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("nth"), F.col("o_orderdate").alias("date")))
