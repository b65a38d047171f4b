"""Verification across fields and documents: agreement, completeness, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vouch.operators.extract import small

#: Least distances and percentages of the verdict: fixed values.
VERDICT = {"name": 80.0, "face": 70.0, "document": 70.0, "address": 80.0, "otp": 80.0}


def ensemble_vote(votes: DataFrame, threshold: float) -> DataFrame:
    """For each pair the models' vote: matched by half of them at least, mean confidence, and the distance that stands for all.

    That is the greatest distance of the matching models if matched, else the mean of all.
    """
    hit = F.col("distance") <= threshold
    return votes.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("models"), F.count_if(hit).alias("hits"), F.round(F.avg(F.greatest(F.lit(0.0), 1 - F.col("distance"))), 3).alias("confidence"), F.max(F.when(hit, F.col("distance"))).alias("worst"), F.avg("distance").alias("mean")
    ).select("pair_id", "models", (F.col("hits") >= F.col("models") / 2).alias("matched"), "confidence", F.round(F.when(F.col("hits") >= F.col("models") / 2, F.col("worst")).otherwise(F.col("mean")), 4).alias("distance"))


def plain(value: Column) -> Column:
    """A value for comparison: lower case without white space."""
    return F.regexp_replace(F.lower(value), r"\s+", "")


def compare_values(expected: Column, found: Column) -> Column:
    """Whether two texts agree but for case and white space; two nulls agree, one does not."""
    return F.coalesce(plain(expected).eqNullSafe(plain(found)), F.lit(False))


def contains_all(expected: Column, found: Column) -> Column:
    """Whether every item of one array is in the other, compared as compare_values does."""
    return F.size(F.array_except(F.transform(expected, plain), F.transform(found, plain))) == 0


def verify_fields(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each document: fields asked for, agreeing, missing, and the names of those that disagree.

    Both sides have doc_id and fields, a map; names that begin with an underscore are no fields.
    """
    asked = expected.select("doc_id", F.explode(strip_meta(F.col("fields"))).alias("field", "expected"))
    given = found.select("doc_id", F.explode(strip_meta(F.col("fields"))).alias("field", "found"))
    joined = asked.join(given, ["doc_id", "field"], "left").withColumn("agrees", compare_values(F.col("expected"), F.col("found")))
    return joined.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("asked"), F.count_if("agrees").alias("agreeing"), F.count_if(F.col("found").isNull()).alias("missing"), F.array_sort(F.collect_list(F.when(~F.col("agrees"), F.col("field")))).alias("disagreeing")
    )


def strip_meta(fields: Column) -> Column:
    """A map without the entries whose name begins with an underscore."""
    return F.map_filter(fields, lambda k, _: ~k.startswith("_"))


def drop_failed(fields: Column, failed: Column) -> Column:
    """A map without the entries named in an array."""
    return F.map_filter(fields, lambda k, _: ~F.array_contains(failed, k))


def high_confidence(df: DataFrame, least: float = 0.8) -> DataFrame:
    """Rows of at least this confidence."""
    return df.filter(F.col("confidence") >= least)


def consistency(df: DataFrame, key: str, value: str) -> DataFrame:
    """For each key the mean similarity of its values, pair by pair, in percent; 100 for a single value.

    Pairs are made of the distinct values of a key, which are few: spellings of one name or address.
    """
    from vouch.functions.names import fuzzy_names

    values = df.select(key, F.col(value).alias("x")).filter("x is not null").groupBy(key, "x").agg(F.count(F.lit(1)).alias("n"))
    other = values.select(key, F.col("x").alias("y"), F.col("n").alias("m"))
    # Equal values are alike by 1; pairs of different ones are compared once and counted as often as they occur.
    pairs = values.join(other, key).filter(F.col("x") < F.col("y")).withColumn("s", fuzzy_names(F.col("x"), F.col("y")) * F.col("n") * F.col("m"))
    unlike = pairs.groupBy(key).agg(F.sum("s").alias("s"))
    sizes = values.groupBy(key).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("alike"))
    total = F.col("rows") * (F.col("rows") - 1) / 2
    score = F.when(F.col("rows") < 2, 100.0).otherwise((F.coalesce("s", F.lit(0.0)) + F.col("alike")) / F.when(total > 0, total) * 100)
    return sizes.join(unlike, key, "left").select(key, F.round(score, 2).alias("consistency"))


def all_equal(df: DataFrame, key: str, value: str) -> DataFrame:
    """For each key whether its values agree but for case and white space; nulls are left out."""
    return df.groupBy(key).agg((F.count_distinct(plain(F.col(value))) <= 1).alias("equal"))


def cross_validate(df: DataFrame, face: float = 70.0) -> DataFrame:
    """Verdict of each identity over its documents: names and addresses agree, each face score is enough, a code was verified."""
    return df.groupBy("identity").agg(
        (F.count_distinct(plain(F.col("name"))) <= 1).alias("names"), (F.count_distinct(plain(F.col("address"))) <= 1).alias("addresses"), F.coalesce(F.bool_and(F.col("face_score") >= face), F.lit(False)).alias("faces"), F.coalesce(F.bool_or("otp_verified"), F.lit(False)).alias("otp")
    ).withColumn("passed", F.col("names") & F.col("addresses") & F.col("faces") & F.col("otp"))


def docs_auth_score(checks: DataFrame, required: list[str]) -> DataFrame:
    """Percentage of forgery checks below their threshold for each identity; a required document without checks is one failed check.

    checks has identity, document_type, score and threshold (0.5 where null).
    """
    passed = F.col("score") < F.coalesce("threshold", F.lit(0.5))
    seen = checks.filter(F.col("document_type").isin(required)).groupBy("identity", "document_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("ok"))
    wanted = checks.select("identity").distinct().withColumn("document_type", F.explode(F.array(*map(F.lit, required))))
    joined = wanted.join(seen, ["identity", "document_type"], "left")
    return joined.groupBy("identity").agg(F.round(F.sum(F.coalesce("ok", F.lit(0))) / F.sum(F.coalesce("n", F.lit(1))) * 100, 2).alias("docs_auth_score"))


def id_veri_score(checks: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Percentage of validation checks passed for each identity; a missing document counts as its number of failed checks."""
    seen = checks.filter(F.col("document_type").isin(*expected)).groupBy("identity", "document_type").agg(F.count_if("passed").alias("ok"))
    each = seen.withColumn("ok", F.least(F.col("ok"), F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[F.col("document_type")]))
    total = sum(expected.values())
    return checks.select("identity").distinct().join(each.groupBy("identity").agg(F.sum("ok").alias("ok")), "identity", "left").select("identity", F.round(F.coalesce("ok", F.lit(0)) / total * 100, 2).alias("id_veri_score"))


def forgery_summary(scores: DataFrame, detected: float = 0.1, reject: int = 3) -> DataFrame:
    """For each document methods run, methods that found something, mean score, and whether enough found something to reject it."""
    hits = F.count_if(F.col("score") > detected)
    return scores.groupBy("doc_id").agg(F.count(F.lit(1)).alias("methods"), hits.alias("detections"), F.round(F.avg("score"), 6).alias("probability"), (hits >= reject).alias("rejected"))


def method_bands(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """For each document the checks in each band (low below half the threshold, medium below it, high), their share, and a summary.

    thresholds has method and threshold, one row for each method.
    """
    joined = scores.join(small(thresholds), "method")
    low, high = F.col("score") < F.col("threshold") * 0.5, F.col("score") >= F.col("threshold")
    each = joined.groupBy("doc_id").agg(F.count_if(low).alias("low"), F.count_if(~low & ~high).alias("medium"), F.count_if(high).alias("high"), F.count(F.lit(1)).alias("n"))
    share = F.col("high") / F.col("n")
    text = F.when(F.col("high") == 0, "authentic").when(share <= 0.3, "minor").when(share <= 0.7, "mixed").otherwise("strong")
    return each.select("doc_id", "low", "medium", "high", F.round(share, 6).alias("share"), text.alias("summary"))


def threshold_status(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds status: problem, warning or ok by the thresholds of document type and method, else by those of the type `default`."""
    own = thresholds.select("document_type", "method", F.struct("problem", "warning").alias("own"))
    general = thresholds.filter("document_type = 'default'").select("method", F.struct("problem", "warning").alias("general"))
    limit = F.coalesce("own", "general")
    status = F.when(F.col("score") >= limit["problem"], "problem").when(F.col("score") >= limit["warning"], "warning").otherwise("ok")
    return scores.join(small(own), ["document_type", "method"], "left").join(small(general), "method", "left").withColumn("status", status).drop("own", "general")


def extraction_summary(keys: DataFrame, high: float = 0.8, medium: float = 0.7) -> DataFrame:
    """For each document its keys by confidence band, and how many required and optional ones it has."""
    c = F.col("confidence")
    return keys.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(c >= high).alias("high"), F.count_if((c >= medium) & (c < high)).alias("medium"), F.count_if(c < medium).alias("low"), F.count_if("required").alias("required"), F.count_if(~F.col("required")).alias("optional")
    )


def completeness(keys: DataFrame, required: list[str], least: float = 0.7) -> DataFrame:
    """For each document the required keys that it lacks, those of low confidence, and whether it is complete."""
    best = keys.groupBy("doc_id", "key_name").agg(F.max("confidence").alias("confidence"))
    wanted = keys.select("doc_id").distinct().withColumn("key_name", F.explode(F.array(*map(F.lit, required))))
    joined = wanted.join(best, ["doc_id", "key_name"], "left")
    named = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("key_name"))))
    out = joined.groupBy("doc_id").agg(named(F.col("confidence").isNull()).alias("missing"), named(F.col("confidence") < least).alias("low"))
    return out.withColumn("complete", (F.size("missing") == 0) & (F.size("low") == 0))


def missing_fields(required: Column, found: Column) -> Column:
    """Names of one array that the other lacks, in order."""
    return F.array_sort(F.array_except(required, found))


def dedupe_fields(df: DataFrame) -> DataFrame:
    """The extraction of greatest confidence for each field of a document; ties by value."""
    order = Window.partitionBy("doc_id", "field").orderBy(F.desc("confidence"), "value")
    return df.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def dedupe_keys(df: DataFrame, top: float = 0.3, more: float = 1.1) -> DataFrame:
    """The key of greatest confidence for each field of a document, where a company's name beats a person's.

    df has doc_id, field, value, confidence and y1. In a document with a company_name, a full_name stays only if it
    stands in the uppermost part of the page and its confidence is over `more` times the company's; ties by value.
    """
    company = F.max(F.when(F.col("field") == "company_name", F.col("confidence"))).over(Window.partitionBy("doc_id"))
    judged = df.withColumn("_company", company)
    beaten = (F.col("field") == "full_name") & F.col("_company").isNotNull() & ~((F.col("y1") < top) & (F.col("confidence") > F.col("_company") * more))
    return dedupe_fields(judged.filter(~F.coalesce(beaten, F.lit(False))).drop("_company"))


def merge_extractions(primary: DataFrame, secondary: DataFrame, core: list[str], always_second: list[str], least: float = 50.0, parts: dict[str, list[str]] | None = None) -> DataFrame:
    """Fields of two extractors of one document: the primary's from `least` confidence on, else the secondary's.

    Both sides have doc_id, field, value and confidence; fields of always_second come from the secondary alone.
    `parts` names fields that travel with another: where that one comes from the secondary, so do they if it has them.
    The result has source and, for each document, overall, the mean of the core fields' non-zero confidences.
    """
    p = primary.select("doc_id", "field", F.col("value").alias("pv"), F.col("confidence").alias("pc"))
    s = secondary.select("doc_id", "field", F.col("value").alias("sv"), F.col("confidence").alias("sc"))
    joined = p.join(s, ["doc_id", "field"], "full_outer")
    second = F.col("field").isin(always_second) if always_second else F.lit(False)
    first = F.coalesce((F.col("pc") >= least) & ~second, F.lit(False)) | (F.col("sv").isNull() & ~second & F.col("pv").isNotNull())
    for whole, names in (parts or {}).items():
        led = F.max(F.when((F.col("field") == whole) & ~first & F.col("sv").isNotNull(), 1)).over(Window.partitionBy("doc_id"))
        joined = joined.withColumn(f"_{whole}", led)
        first = first & ~F.coalesce((F.col(f"_{whole}") == 1) & F.col("field").isin(names) & F.col("sv").isNotNull(), F.lit(False))
    merged = joined.select("doc_id", "field", F.when(first, F.col("pv")).otherwise(F.col("sv")).alias("value"), F.when(first, F.col("pc")).otherwise(F.coalesce("sc", F.lit(0.0))).alias("confidence"), F.when(first, "primary").otherwise("secondary").alias("source"))
    counted = F.when(F.col("field").isin(core) & (F.col("confidence") > 0), F.col("confidence"))
    return merged.withColumn("overall", F.round(F.coalesce(F.avg(counted).over(Window.partitionBy("doc_id")), F.lit(0.0)), 2))


def merge_keys(pattern: DataFrame, layout: DataFrame, account: str = "account_number") -> DataFrame:
    """Keys found by layout, and those found by patterns alone: doc_id, key_name, value, confidence, origin.

    An account number of 8 to 20 digits that a pattern found takes the place of the layout's. rank puts such numbers
    first, then keys by confidence, then by origin and name.
    """
    columns = ["doc_id", "key_name", "value", "confidence"]
    numeric = (F.col("key_name").cast("string") == account) & F.coalesce(F.col("value"), F.lit("")).rlike(r"^\d{8,20}$")
    numbers = pattern.filter(numeric).select(*columns, F.lit("number").alias("origin"))
    own = layout.join(numbers.select("doc_id", F.col("key_name")).distinct(), ["doc_id", "key_name"], "left_anti")
    extra = pattern.filter(~numeric).join(layout.select("doc_id", "key_name").distinct(), ["doc_id", "key_name"], "left_anti")
    merged = numbers.unionByName(own.select(*columns, F.lit("layout").alias("origin"))).unionByName(extra.select(*columns, F.lit("pattern").alias("origin")))
    order = Window.partitionBy("doc_id").orderBy((F.col("origin") == "number").cast("int").desc(), F.desc("confidence"), "origin", "key_name", "value")
    return merged.withColumn("rank", F.row_number().over(order))


def verification_verdict(df: DataFrame, age_least: int = 21) -> DataFrame:
    """Adds passed: every score reaches its least value and the person is old enough; a null score is 0."""
    ok = F.coalesce(F.col("age") >= age_least, F.lit(False))
    for name, least in VERDICT.items():
        ok = ok & (F.coalesce(F.col(f"{name}_score"), F.lit(0.0)) >= least)
    return df.withColumn("passed", ok)


def identity_progress(df: DataFrame, steps: list[str]) -> DataFrame:
    """Adds completed, the steps whose column is not null, and their percentage."""
    done = F.array_compact(F.array(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in steps]))
    return df.withColumn("completed", done).withColumn("percent", F.round(F.size("completed") / len(steps) * 100, 2))


#: Weights of an identity document's fields, and those without which it loses 15: fixed values.
DOCUMENT_WEIGHTS = {"passport_number": 0.15, "full_name": 0.20, "date_of_birth": 0.10, "nationality": 0.05, "sex": 0.05, "date_of_expiry": 0.15, "passport_country": 0.10, "place_of_birth": 0.10, "issuing_authority": 0.10}
CRITICAL = ["passport_number", "full_name", "date_of_birth"]


def record_confidence(present: Column, kind: str = "card", given: Column | None = None) -> Column:
    """Confidence of a record in percent.

    A card: the mean of `given` confidences, times 100 if it is 1 or less, else 50 and 5 for each of `present` fields
    up to 85; without fields 0 where confidences are looked for. A document: `present` is an array of the names of its
    fields; each counts 75 by its weight, less 15 for each critical one that is missing, not below 0.
    """
    if kind == "document":
        weight = lambda names: F.aggregate(names, F.lit(0.0), lambda s, n: s + F.coalesce(F.create_map(*[F.lit(x) for kv in DOCUMENT_WEIGHTS.items() for x in kv])[n], F.lit(0.0)))
        names = F.array_intersect(present, F.array(*map(F.lit, DOCUMENT_WEIGHTS)))
        mean = F.when(F.size(names) > 0, 75.0 * weight(names) / weight(names)).otherwise(0.0)
        return F.round(F.greatest(F.lit(0.0), mean - 15.0 * F.size(F.array_except(F.array(*map(F.lit, CRITICAL)), present))), 2)
    if kind != "card":
        raise ValueError(f"kind is card or document, not {kind}")
    by_count = F.least(50.0 + 5.0 * present, F.lit(85.0))
    if given is None:
        return by_count
    total = F.aggregate(given, F.lit(0.0), lambda s, x: s + x) / F.when(F.size(given) > 0, F.size(given))
    return F.round(F.when(F.size(given) > 0, F.when(total <= 1.0, total * 100).otherwise(total)).when(present > 0, by_count).otherwise(0.0), 2)


def id_confidence(missing: Column, important: Column) -> Column:
    """100 less 20 for each missing field and 5 more for each important one that is there, within 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - 20 * missing + 5 * important))


def adaptive_threshold(base: Column, quality: Column, confidence: Column) -> Column:
    """base times both factors, within 0.1 to 0.9."""
    return F.greatest(F.lit(0.1), F.least(F.lit(0.9), base * quality * confidence))


def liveness_ok(score: Column, threshold: float = 0.7) -> Column:
    """Whether a score is there and reaches the threshold."""
    return F.coalesce(score >= threshold, F.lit(False))
