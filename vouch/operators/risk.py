"""Adverse news and risk verdicts."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Keywords of a search result by severity: fixed values.
SEVERITY = {
    "critical": ["fraud", "scam", "money laundering", "embezzlement", "bribery", "corruption", "terrorist", "terrorism", "sanctioned", "convicted", "arrested", "indicted", "charged", "lawsuit", "criminal", "ponzi", "pyramid scheme", "identity theft", "cybercrime", "hacking"],
    "high": ["investigation", "probe", "audit", "complaint", "lawsuit", "allegation", "accused", "sued", "settled", "controversy", "misconduct", "violation", "penalty", "fine", "regulator"],
    "medium": ["dispute", "conflict", "issue", "concern", "problem", "failure", "bankrupt", "liquidation", "delisted", "warning"],
}
#: Points and recency multiplier of a severity: fixed values.
POINTS = {"critical": (50.0, 2.0), "high": (30.0, 1.5), "medium": (10.0, 1.0)}
#: Points of an event type, times its confidence: fixed values.
EVENT_POINTS = {"conviction": 50.0, "investigation": 30.0, "civil_lawsuit": 10.0, "allegation": 15.0}
#: Phrases of each event type, in the order in which types are tried: fixed values.
EVENTS = {
    "civil_lawsuit": ["civil lawsuit", "civil action", "civil litigation", "civil suit", "civil case"],
    "conviction": ["convicted", "pleaded guilty", "found guilty", "sentenced", "criminal conviction"],
    "cleared": ["cleared", "acquitted", "exonerated", "charges dropped", "not guilty"],
    "investigation": ["investigation", "probe", "investigating", "under investigation"],
    "allegation": ["accused", "alleged", "allegations", "charged with", "sued"],
}
#: Keywords of the risk score: those of search results without the word that tells of civil matters.
RISK_KEYWORDS = {level: [w for w in words if w != "lawsuit"] for level, words in SEVERITY.items()}
#: Component weights: fixed values; the verdict itself takes the largest component.
WEIGHTS = {"news_risk": 0.29, "criminal_risk": 0.15, "sanctions_risk": 0.22, "pep_risk": 0.29}
#: Confidence from which a classified event stays negative: fixed values.
EVENT_LEAST = {"conviction": 0.7, "investigation": 0.5, "allegation": 0.4}


def _holds(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))


def severity(text: Column, keywords: dict[str, list[str]] = SEVERITY) -> Column:
    """The gravest severity whose keywords the text contains; null if none."""
    out = F.lit(None).cast("string")
    for level in reversed(list(keywords)):
        out = F.when(_holds(text, keywords[level]), F.lit(level)).otherwise(out)
    return out


def keyword_score(text: Column, keywords: dict[str, list[str]] = RISK_KEYWORDS) -> Column:
    """Points of the gravest severity, 0 if none."""
    level = severity(text, keywords)
    return F.coalesce(*[F.when(level == k, F.lit(points)) for k, (points, _) in POINTS.items()], F.lit(0.0))


def news_analysis(text: Column, published: Column, as_of: datetime.date, keywords: dict[str, list[str]] = RISK_KEYWORDS) -> Column:
    """Struct of level (none without keywords), keywords found, and points of all of them, more if published within a year; at most 100."""
    low = F.lower(F.coalesce(text, F.lit("")))
    recent = F.coalesce(F.datediff(F.lit(as_of), published) < 365, F.lit(False))
    found = {k: F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w)) for k, words in keywords.items()}
    points = sum((F.size(found[k]) * F.when(recent, p * more).otherwise(p) for k, (p, more) in POINTS.items()), F.lit(0.0))
    level = F.coalesce(severity(text, keywords), F.lit("none"))
    return F.struct(level.alias("level"), F.concat(*found.values()).alias("keywords"), F.least(points, F.lit(100.0)).alias("points"))


def event_type(text: Column, events: dict[str, list[str]] = EVENTS) -> Column:
    """The first event type of which the text has a phrase, else `unknown`."""
    out = F.lit("unknown")
    for kind in reversed(list(events)):
        out = F.when(_holds(text, events[kind]), F.lit(kind)).otherwise(out)
    return out


def relevant(title: Column, body: Column, name: Column) -> Column:
    """Whether the name stands in the title or in the first 200 characters of the body."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return low(title).contains(low(name)) | F.left(low(body), F.lit(200)).contains(low(name))


def domain(url: Column) -> Column:
    """The host of a url without http, https and www; a text without protocol is cut at the first slash."""
    bare = F.regexp_replace(url, r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)/.*$", ""), r"^www\.", "")


def news_risk(results: DataFrame) -> DataFrame:
    """For each subject the sum of its negative results' points, at most 100: subject_id, news_risk.

    A result counts by its event type and confidence, else by its sentiment, else by keyword_points.
    """
    event = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(p)) for k, p in EVENT_POINTS.items()], F.lit(0.0)) * F.coalesce("confidence", F.lit(0.5))
    mood = F.when(F.col("compound") < -0.5, 30.0).when(F.col("compound") < -0.3, 15.0).when(F.col("compound") < -0.1, 5.0).otherwise(0.0)
    points = F.when(F.col("event_type").isNotNull(), event).when(F.col("compound").isNotNull(), mood).otherwise(F.coalesce("keyword_points", F.lit(0.0)))
    counted = F.when(F.col("risk_level") == "negative", points).otherwise(0.0)
    return results.groupBy("subject_id").agg(F.least(F.sum(counted), F.lit(100.0)).alias("news_risk"))


def classify_results(results: DataFrame) -> DataFrame:
    """Adds risk_level and excluded: negative by severity or sentiment, about the subject, name score and country fitting.

    Needs negative, relevant, name_score, country_ok, compound, event_type and confidence. A negative result
    whose event type is known stays so only above that type's least confidence.
    """
    negative = F.col("negative") & F.col("relevant") & (F.col("name_score") >= 0.5) & F.col("country_ok")
    enough = F.coalesce(*[F.when(F.col("event_type") == k, F.col("confidence") >= least) for k, least in EVENT_LEAST.items()], F.lit(False))
    excluded = negative & F.col("event_type").isNotNull() & ~enough
    mild = ~(F.col("negative") & F.col("relevant")) & (F.col("compound") < 0)
    level = F.when(negative & ~excluded, F.lit("negative")).when(mild, F.lit("low_risk"))
    return results.withColumn("risk_level", level).withColumn("excluded", excluded)


def deep_budget(results: DataFrame, n: int = 5) -> DataFrame:
    """The first n negative results of each subject in order of arrival, column arrival."""
    order = Window.partitionBy("subject_id").orderBy("arrival")
    return results.filter("risk_level = 'negative'").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)


def merge_results(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All results with one row for each url, the first by arrival."""
    every = first
    for df in more:
        every = every.unionByName(df)
    order = Window.partitionBy("url").orderBy("arrival")
    return every.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def news_summary(results: DataFrame) -> DataFrame:
    """For each subject: results, negative ones, their average sentiment, and the sources in order."""
    negative = F.col("risk_level") == "negative"
    return results.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("results"), F.count_if(negative).alias("negatives"), F.avg(F.when(negative, F.col("compound"))).alias("sentiment"), F.array_sort(F.collect_set("source")).alias("sources")
    )


def component_scores(df: DataFrame) -> DataFrame:
    """Adds criminal_risk, sanctions_risk, pep_risk and footprint to screened subjects.

    criminal_records and court_cases are booleans, footprint_level is high, low or none.
    """
    criminal = F.least(F.when(F.col("criminal_records"), 60.0).otherwise(0.0) + F.when(F.col("court_cases"), 30.0).otherwise(0.0), F.lit(100.0))
    office = F.when(F.col("current_pep"), 60.0).when(F.col("former_pep"), 30.0).otherwise(0.0)
    share = F.when(F.col("pep_confidence") >= 0.98, 1.0).when(F.col("pep_confidence") >= 0.65, 0.8).when(F.col("pep_confidence") > 0, 0.5).otherwise(0.0)
    seen = F.when(F.col("footprint_level") == "high", 30.0).when(F.col("footprint_level") == "low", 20.0).otherwise(0.0)
    return df.withColumns({"criminal_risk": criminal, "sanctions_risk": F.col("sanctions_confidence") * 100, "pep_risk": office * share, "footprint": seen})


def risk_verdict(df: DataFrame) -> DataFrame:
    """Adds result, reason, overall_score, risk_category and weighted_score to component scores.

    FAIL by sanctions confidence of 0.65, else by office confidence of 0.65, else by news of 50 points.
    """
    listed, office, news = F.col("sanctions_confidence") >= 0.65, (F.col("current_pep") | F.col("former_pep")) & (F.col("pep_confidence") >= 0.65), F.col("news_risk") >= 50
    highest = F.greatest("news_risk", "criminal_risk", "sanctions_risk", "pep_risk", "footprint")
    score = F.when(listed, F.col("sanctions_risk")).when(office, F.col("pep_risk")).when(news, F.greatest("news_risk", F.lit(60.0))).otherwise(highest)
    reason = F.when(listed, "sanctions").when(office, "pep").when(news, "news").otherwise("within thresholds")
    failed = listed | office | news
    weighted = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    out = df.withColumn("result", F.when(failed, "FAIL").otherwise("PASS")).withColumn("reason", reason).withColumn("overall_score", F.round(score, 2))
    category = F.when(F.col("result") == "PASS", "LOW").when(F.col("overall_score") >= 75, "CRITICAL").otherwise("HIGH")
    return out.withColumn("risk_category", category).withColumn("weighted_score", F.round(weighted, 2))


def match_details(matches: DataFrame) -> DataFrame:
    """For each subject its matches in rank order, with the fields that each step of the ladder stands for."""
    fields = F.when(F.col("confidence") >= 0.98, "name, country, date of birth").when(F.col("confidence") >= 0.65, "name, country").otherwise("name")
    detail = F.struct("rank", "entry_id", "source_key", fields.alias("fields"))
    return matches.groupBy("subject_id").agg(F.array_sort(F.collect_list(detail)).alias("details"))


def strict_gate(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Adds gate: failed_screen at the risk threshold or a commercial match, failed_news at over 2 negatives or sentiment below -0.5, else passed."""
    gate = F.when((F.col("overall_score") >= threshold) | F.coalesce(F.col("commercial_match"), F.lit(False)), "failed_screen").when((F.col("negatives") > 2) | (F.col("sentiment") < -0.5), "failed_news").otherwise("passed")
    return df.withColumn("gate", gate)
