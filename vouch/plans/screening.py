"""Queries of the screening and news operators over the given tables, with their SQL for DuckDB."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from vouch.functions import names
from vouch.operators import risk, watch
from vouch.plans import tables
from vouch.plans.tables import SQL, table

#: Words of the given texts that stand for news keywords, which these texts do not have.
WORDS = {"critical": ["idiot", "scum"], "high": ["stupid", "clown"], "medium": ["trash", "moron"]}
EVENT_WORDS = {"civil_lawsuit": ["worthless"], "conviction": ["idiot"], "cleared": ["pathetic"], "investigation": ["stupid"], "allegation": ["clown", "trash"]}
AS_OF = datetime.date(2024, 6, 1)
Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return add


_score = "CASE WHEN len(st) = 0 OR len(wt) = 0 THEN 0.0 ELSE len(list_intersect(st, wt)) / len(st) * 0.7 + len(list_intersect(st, wt)) / (len(st) + len(wt) - len(list_intersect(st, wt))) * 0.3 END"
PAIRS = f"""
spair AS (
    SELECT s.*, w.* EXCLUDE (wt), {_score} AS raw, list_filter(regexp_split_to_array(countries, '[;,]'), lambda c: true) AS listed
    FROM stok s JOIN wtok w ON len(list_intersect(st, wt)) > 0),
smatch AS (
    SELECT *, CASE WHEN country IS NULL THEN true ELSE coalesce(len(list_filter(listed, lambda c: contains(lower(trim(c)), country) OR contains(country, lower(trim(c))))) > 0, false) END AS country_matched,
           CASE WHEN date_of_birth IS NULL THEN true
                WHEN birth_date IS NULL THEN false
                WHEN birth_date LIKE '% to %' THEN CAST(date_of_birth[1:4] AS INTEGER) BETWEEN CAST(birth_date[1:4] AS INTEGER) AND CAST(birth_date[9:12] AS INTEGER)
                ELSE starts_with(date_of_birth, birth_date) END AS dob_matched
    FROM spair WHERE raw >= 0.5),
sscored AS (
    SELECT *, CASE WHEN country_matched AND dob_matched THEN 0.99 WHEN country_matched THEN 0.66 ELSE 0.33 END AS confidence,
           CASE WHEN raw >= 1.0 THEN 'exact' WHEN raw >= 0.7 THEN 'strong' ELSE 'partial' END AS match_type, round(raw, 3) AS name_score
    FROM smatch),
sranked AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, name_score DESC, entry_id) AS rank FROM sscored),
ppair AS (
    SELECT s.subject_id, s.date_of_birth, s.country, w.country AS office_country, w.* EXCLUDE (wt, country), {_score} AS raw
    FROM stok s JOIN ptok w ON len(list_intersect(st, wt)) > 0),
pmatch AS (
    SELECT *, coalesce(lower(country) = lower(office_country), false) AS country_matched,
           coalesce(CAST(date_of_birth[1:4] AS INTEGER) = birth_year, false) AS dob_matched
    FROM ppair WHERE raw >= 0.5),
pscored AS (
    SELECT *, CASE WHEN country_matched AND dob_matched THEN 0.99 WHEN country_matched THEN 0.66 ELSE 0.33 END AS confidence,
           CASE WHEN raw >= 1.0 THEN 'exact' WHEN raw >= 0.7 THEN 'strong' ELSE 'partial' END AS match_type, round(raw, 3) AS name_score
    FROM pmatch),
pranked AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, name_score DESC, entry_id) AS rank FROM pscored)"""
_level = lambda words: "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in words.items())
NEWS = f"""
raw_news AS (
    SELECT doc_id, doc_id - doc_id % 20 AS subject_id, source, text, CASE WHEN doc_id % 4 = 0 THEN ({_level(EVENT_WORDS)} ELSE 'unknown' END) END AS event_type,
           CASE WHEN doc_id % 4 = 1 THEN (doc_id * 13 % 21 - 15) / 20.0 END AS compound, (doc_id * 7 % 10) / 10.0 AS confidence,
           {_level(WORDS)} END AS level
    FROM documents),
news AS (
    SELECT *, CASE WHEN level IS NOT NULL THEN 'negative' END AS risk_level, CASE level WHEN 'critical' THEN 50.0 WHEN 'high' THEN 30.0 WHEN 'medium' THEN 10.0 ELSE 0.0 END AS keyword_points
    FROM raw_news),
nrisk AS (
    SELECT subject_id, least(sum(CASE WHEN risk_level = 'negative' THEN
        CASE WHEN event_type IS NOT NULL THEN CASE event_type WHEN 'conviction' THEN 50.0 WHEN 'investigation' THEN 30.0 WHEN 'civil_lawsuit' THEN 10.0 WHEN 'allegation' THEN 15.0 ELSE 0.0 END * confidence
             WHEN compound IS NOT NULL THEN CASE WHEN compound < -0.5 THEN 30.0 WHEN compound < -0.3 THEN 15.0 WHEN compound < -0.1 THEN 5.0 ELSE 0.0 END
             ELSE keyword_points END ELSE 0.0 END), 100.0) AS news_risk
    FROM news GROUP BY subject_id)"""
SCREENED = """
listed AS (SELECT subject_id, max(confidence) AS sanctions_confidence, count(*) AS sanctions_matches FROM sranked WHERE rank <= 10 GROUP BY subject_id),
offices AS (
    SELECT subject_id, max(confidence) AS pep_confidence, bool_or(status = 'current') AS current_pep, bool_or(status = 'former') AS former_pep, list_sort(list(DISTINCT position)) AS positions
    FROM pranked WHERE rank <= 10 GROUP BY subject_id),
screened AS (
    SELECT s.subject_id, coalesce(sanctions_confidence, 0) AS sanctions_confidence, coalesce(sanctions_matches, 0) AS sanctions_matches, coalesce(pep_confidence, 0) AS pep_confidence,
           coalesce(current_pep, false) AS current_pep, coalesce(former_pep, false) AS former_pep, positions, coalesce(news_risk, 0) AS news_risk,
           s.subject_id % 50 = 0 AS criminal_records, s.subject_id % 30 = 0 AS court_cases, CASE s.subject_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'none' END AS footprint_level
    FROM subjects s LEFT JOIN listed USING (subject_id) LEFT JOIN offices USING (subject_id) LEFT JOIN nrisk USING (subject_id)),
scores AS (
    SELECT *, least(CASE WHEN criminal_records THEN 60.0 ELSE 0 END + CASE WHEN court_cases THEN 30.0 ELSE 0 END, 100.0) AS criminal_risk, sanctions_confidence * 100 AS sanctions_risk,
           CASE WHEN current_pep THEN 60.0 WHEN former_pep THEN 30.0 ELSE 0.0 END * CASE WHEN pep_confidence >= 0.98 THEN 1.0 WHEN pep_confidence >= 0.65 THEN 0.8 WHEN pep_confidence > 0 THEN 0.5 ELSE 0 END AS pep_risk,
           CASE footprint_level WHEN 'high' THEN 30.0 WHEN 'low' THEN 20.0 ELSE 0.0 END AS footprint
    FROM screened),
verdict AS (
    SELECT *, CASE WHEN sanctions_confidence >= 0.65 THEN 'sanctions' WHEN (current_pep OR former_pep) AND pep_confidence >= 0.65 THEN 'pep' WHEN news_risk >= 50 THEN 'news' ELSE 'within thresholds' END AS reason,
           round(CASE WHEN sanctions_confidence >= 0.65 THEN sanctions_risk WHEN (current_pep OR former_pep) AND pep_confidence >= 0.65 THEN pep_risk WHEN news_risk >= 50 THEN greatest(news_risk, 60.0)
                ELSE greatest(news_risk, criminal_risk, sanctions_risk, pep_risk, footprint) END, 2) AS overall_score
    FROM scores)"""


def _sanctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.screen_sanctions(tables.subjects(spark, sf_dir), tables.watch(spark, sf_dir))


def _offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.screen_pep(tables.subjects(spark, sf_dir), tables.pep(spark, sf_dir))


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search results of a subject; event types, sentiments and confidences stand for what models would give."""
    level = risk.severity(F.col("text"), WORDS)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.col("doc_id") - F.col("doc_id") % 20).alias("subject_id"),
        "source",
        "text",
        F.when(F.col("doc_id") % 4 == 0, risk.event_type(F.col("text"), EVENT_WORDS)).alias("event_type"),
        F.when(F.col("doc_id") % 4 == 1, (F.col("doc_id") * 13 % 21 - 15) / 20.0).alias("compound"),
        ((F.col("doc_id") * 7 % 10) / 10.0).alias("confidence"),
        F.when(level.isNotNull(), "negative").alias("risk_level"),
        risk.keyword_score(F.col("text"), WORDS).alias("keyword_points"),
    )


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = watch.screen(tables.subjects(spark, sf_dir), _sanctions(spark, sf_dir), _offices(spark, sf_dir), risk.news_risk(_news(spark, sf_dir)))
    id_ = F.col("subject_id")
    level = F.when(id_ % 3 == 0, "high").when(id_ % 3 == 1, "low").otherwise("none")
    return whole.withColumns({"criminal_records": id_ % 50 == 0, "court_cases": id_ % 30 == 0, "footprint_level": level})



FROM_PEOPLE = f"WITH {SQL} "
FROM_PAIRS = f"WITH {SQL}, {PAIRS} "
FROM_NEWS = f"WITH {NEWS} "
FROM_ALL = f"WITH {SQL}, {PAIRS}, {NEWS}, {SCREENED} "


@query("p1_filter_watch", FROM_PEOPLE + r"""
    SELECT entry_id, source_key, normalized_name FROM watch
    WHERE (contains(normalized_name, 'the') OR contains(normalized_name, 'la')) AND list_contains(regexp_split_to_array(countries, '[;,]'), 'nation_3')""")
def p1(spark, sf_dir):
    return watch.filter_watch(tables.watch(spark, sf_dir), tokens=["the", "la"], country="nation_3").select("entry_id", "source_key", "normalized_name")


@query("p2_filter_pep", FROM_PEOPLE + "SELECT entry_id, source_key, status FROM pep WHERE (contains(normalized_name, 'the') OR contains(normalized_name, 'de')) AND status = 'current' AND source_key IN ('src0', 'src1', 'src3')")
def p2(spark, sf_dir):
    return watch.filter_pep(tables.pep(spark, sf_dir), tokens=["the", "de"], status="current", sources=["src0", "src1", "src3"]).select("entry_id", "source_key", "status")


@query("p3_lookup_name", FROM_PEOPLE + "SELECT entry_id, name FROM watch WHERE normalized_name = (SELECT min(normalized_name) FROM watch WHERE crime_type = 'other') AND crime_type = 'other'")
def p3(spark, sf_dir):
    entries = tables.watch(spark, sf_dir)
    name = entries.filter("crime_type = 'other'").agg(F.min("normalized_name")).first()[0]
    return watch.lookup_name(entries, name, crime="other").select("entry_id", "name")


@query("p4_lookup_sanctioned", FROM_PEOPLE + "SELECT entry_id, crime_type FROM watch WHERE normalized_name = (SELECT max(normalized_name) FROM watch WHERE crime_type <> 'other') AND crime_type IN ('sanctions_evasion', 'financial_crime', 'corruption')")
def p4(spark, sf_dir):
    entries = tables.watch(spark, sf_dir)
    name = entries.filter("crime_type <> 'other'").agg(F.max("normalized_name")).first()[0]
    return watch.lookup_sanctioned(entries, name).select("entry_id", "crime_type")


@query("p5_lookup_pep", FROM_PEOPLE + "SELECT entry_id, position FROM pep WHERE normalized_name = (SELECT min(normalized_name) FROM pep WHERE country = 'nation_7') AND country = 'nation_7'")
def p5(spark, sf_dir):
    entries = tables.pep(spark, sf_dir)
    name = entries.filter("country = 'nation_7'").agg(F.min("normalized_name")).first()[0]
    return watch.lookup_pep(entries, name or "", "nation_7").select("entry_id", "position")


@query("s3_source_counts", FROM_PEOPLE + "SELECT source_key, count(*) AS entries FROM watch GROUP BY source_key")
def s3(spark, sf_dir):
    from vouch.sources.lists import source_counts

    return source_counts(tables.watch(spark, sf_dir))


_MATCH = "subject_id, entry_id, {}, match_type, name_score, country_matched, dob_matched, confidence, rank"


@query("j1_screen_sanctions", FROM_PAIRS + "SELECT " + _MATCH.format("source_key") + " FROM sranked WHERE rank <= 10")
def j1(spark, sf_dir):
    return _sanctions(spark, sf_dir)


@query("j1_screen_sanctions_strict", FROM_PAIRS + """, strict AS (
    SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, name_score DESC, entry_id) AS nth FROM sscored
    WHERE (country IS NULL OR list_contains(regexp_split_to_array(countries, '[;,]'), country)) AND (date_of_birth IS NULL OR CAST(date_of_birth[1:4] AS INTEGER) = birth_year))
    SELECT """ + _MATCH.format("source_key").replace("rank", "nth AS rank") + " FROM strict WHERE nth <= 10")
def j1_strict(spark, sf_dir):
    return watch.screen_sanctions(tables.subjects(spark, sf_dir), tables.watch(spark, sf_dir), prefilter="strict")


@query("j2_screen_pep", FROM_PAIRS + "SELECT " + _MATCH.format("position, status") + " FROM pranked WHERE rank <= 10")
def j2(spark, sf_dir):
    return _offices(spark, sf_dir)


@query("j3_dob_match", FROM_PEOPLE + """
    SELECT subject_id, entry_id FROM subjects JOIN watch ON entry_id = subject_id + 1 WHERE
        CASE WHEN date_of_birth IS NULL THEN false WHEN birth_date IS NULL THEN false
             WHEN birth_date LIKE '% to %' THEN CAST(date_of_birth[1:4] AS INTEGER) BETWEEN CAST(birth_date[1:4] AS INTEGER) AND CAST(birth_date[9:12] AS INTEGER)
             ELSE starts_with(date_of_birth, birth_date) END""")
def j3(spark, sf_dir):
    pairs = tables.subjects(spark, sf_dir).join(tables.watch(spark, sf_dir), F.col("entry_id") == F.col("subject_id") + 1)
    return pairs.filter(watch.dob_match(F.col("date_of_birth"), F.col("birth_date"), missing="nomatch")).select("subject_id", "entry_id")


@query("j4_country_exact", FROM_PEOPLE + """
    SELECT subject_id, entry_id, coalesce(list_contains(regexp_split_to_array(countries, '[;,]'), country), false) AS exact
    FROM subjects JOIN watch ON entry_id = subject_id + 25 WHERE country IS NOT NULL""")
def j4(spark, sf_dir):
    pairs = tables.subjects(spark, sf_dir).join(tables.watch(spark, sf_dir), F.col("entry_id") == F.col("subject_id") + 25).filter("country is not null")
    return pairs.select("subject_id", "entry_id", watch.country_match(F.col("country"), watch.split_countries(F.col("countries")), "exact").alias("exact"))


_SCREENED = ["subject_id", "sanctions_confidence", "sanctions_matches", "pep_confidence", "current_pep", "former_pep", "positions", "news_risk"]


@query("j5_screen", FROM_ALL + f"SELECT {', '.join(_SCREENED)} FROM screened")
def j5(spark, sf_dir):
    return _screened(spark, sf_dir).select(*_SCREENED)


@query("a1_pep_summary", FROM_ALL + "SELECT subject_id, pep_confidence, current_pep, former_pep, positions FROM offices")
def a1(spark, sf_dir):
    return watch.pep_summary(_offices(spark, sf_dir))


@query("a2_news_risk", FROM_NEWS + "SELECT * FROM nrisk")
def a2(spark, sf_dir):
    return risk.news_risk(_news(spark, sf_dir))


@query("a4_component_scores", FROM_ALL + "SELECT subject_id, criminal_risk, sanctions_risk, pep_risk, footprint FROM scores")
def a4(spark, sf_dir):
    return risk.component_scores(_screened(spark, sf_dir)).select("subject_id", "criminal_risk", "sanctions_risk", "pep_risk", "footprint")


@query("a5_risk_verdict", FROM_ALL + """
    SELECT subject_id, CASE WHEN reason = 'within thresholds' THEN 'PASS' ELSE 'FAIL' END AS result, reason, overall_score,
           CASE WHEN reason = 'within thresholds' THEN 'LOW' WHEN overall_score >= 75 THEN 'CRITICAL' ELSE 'HIGH' END AS risk_category,
           round(0.29 * news_risk + 0.15 * criminal_risk + 0.22 * sanctions_risk + 0.29 * pep_risk, 2) AS weighted_score FROM verdict""")
def a5(spark, sf_dir):
    return risk.risk_verdict(risk.component_scores(_screened(spark, sf_dir))).select("subject_id", "result", "reason", "overall_score", "risk_category", "weighted_score")


@query("a7_match_details", FROM_PAIRS + """
    SELECT subject_id, string_agg(rank || ':' || entry_id || ':' || source_key || ':' || CASE WHEN confidence >= 0.98 THEN 'name, country, date of birth' WHEN confidence >= 0.65 THEN 'name, country' ELSE 'name' END, ';' ORDER BY rank) AS details
    FROM sranked WHERE rank <= 10 GROUP BY subject_id""")
def a7(spark, sf_dir):
    found = risk.match_details(_sanctions(spark, sf_dir))
    return found.select("subject_id", F.array_join(F.transform("details", lambda d: F.concat_ws(":", d["rank"], d["entry_id"], d["source_key"], d["fields"])), ";").alias("details"))


@query("a35_strict_gate", FROM_ALL + """, summary AS (SELECT subject_id, count(*) FILTER (risk_level = 'negative') AS negatives, avg(CASE WHEN risk_level = 'negative' THEN compound END) AS sentiment FROM news GROUP BY subject_id)
    SELECT subject_id, CASE WHEN overall_score >= 50 OR subject_id % 70 = 0 THEN 'failed_screen' WHEN negatives > 2 OR sentiment < -0.5 THEN 'failed_news' ELSE 'passed' END AS gate
    FROM verdict LEFT JOIN summary USING (subject_id)""")
def a35(spark, sf_dir):
    verdicts = risk.risk_verdict(risk.component_scores(_screened(spark, sf_dir))).withColumn("commercial_match", F.col("subject_id") % 70 == 0)
    return risk.strict_gate(verdicts.join(risk.news_summary(_news(spark, sf_dir)), "subject_id", "left")).select("subject_id", "gate")


@query("f8_severity", "SELECT doc_id, " + _level(WORDS) + " END AS severity FROM documents")
def f8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", risk.severity(F.col("text"), WORDS).alias("severity"))


_count = lambda ws: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in ws)


@query("f9_news_analysis", f"""
    SELECT doc_id, coalesce({_level(WORDS)} END, 'none') AS level,
           least(({_count(WORDS['critical'])}) * 50 * CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END + ({_count(WORDS['high'])}) * 30 * CASE WHEN doc_id % 2 = 0 THEN 1.5 ELSE 1 END + ({_count(WORDS['medium'])}) * 10, 100) AS points
    FROM documents""")
def f9(spark, sf_dir):
    published = F.when(F.col("doc_id") % 2 == 0, F.lit(datetime.date(2024, 1, 1))).otherwise(F.lit(datetime.date(2020, 1, 1)))
    found = table(spark, sf_dir, "documents").select("doc_id", risk.news_analysis(F.col("text"), published, AS_OF, WORDS).alias("a"))
    return found.select("doc_id", "a.level", "a.points")


@query("f10_event_type", "SELECT doc_id, " + _level(EVENT_WORDS) + " ELSE 'unknown' END AS event_type FROM documents")
def f10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", risk.event_type(F.col("text"), EVENT_WORDS).alias("event_type"))


@query("f11_relevant", FROM_PEOPLE + ", d AS (SELECT d.doc_id, d.text, p.name FROM documents d JOIN people p ON p.doc_id = d.doc_id - d.doc_id % 2) SELECT doc_id, contains(lower(substring(text, 1, 200)), lower(split_part(name, ' ', 1))) AS relevant FROM d")
def f11(spark, sf_dir):
    who = tables.people(spark, sf_dir).select(F.col("doc_id").alias("who"), "name")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") - F.col("doc_id") % 2).alias("who"))
    return docs.join(who, "who").select("doc_id", risk.relevant(F.lit(""), F.col("text"), F.split("name", " ")[0]).alias("relevant"))


_class = """, c AS (SELECT *, doc_id % 3 <> 0 AS about, (doc_id * 11 % 10) / 10.0 AS name_score, doc_id % 7 <> 0 AS country_ok FROM news),
    n AS (SELECT *, coalesce(risk_level = 'negative', false) AS negative, CASE event_type WHEN 'conviction' THEN confidence >= 0.7 WHEN 'investigation' THEN confidence >= 0.5 WHEN 'allegation' THEN confidence >= 0.4 ELSE false END AS enough FROM c),
    r AS (SELECT *, negative AND about AND name_score >= 0.5 AND country_ok AS hit FROM n)"""


def _classified(spark, sf_dir):
    results = _news(spark, sf_dir).withColumn("negative", F.coalesce(F.col("risk_level") == "negative", F.lit(False)))
    return risk.classify_results(results.withColumns({"relevant": F.col("doc_id") % 3 != 0, "name_score": (F.col("doc_id") * 11 % 10) / 10.0, "country_ok": F.col("doc_id") % 7 != 0}))


@query("f13_classify_results", FROM_NEWS + _class + """
    SELECT doc_id, CASE WHEN hit AND NOT (event_type IS NOT NULL AND NOT enough) THEN 'negative' WHEN NOT (negative AND about) AND compound < 0 THEN 'low_risk' END AS risk_level,
           hit AND event_type IS NOT NULL AND NOT enough AS excluded FROM r""")
def f13(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "risk_level", "excluded")


@query("o5_deep_budget", FROM_NEWS + "SELECT * FROM (SELECT subject_id, doc_id, row_number() OVER (PARTITION BY subject_id ORDER BY doc_id) AS nth FROM news WHERE risk_level = 'negative') WHERE nth <= 2")
def o5(spark, sf_dir):
    return risk.deep_budget(_news(spark, sf_dir).withColumn("arrival", F.col("doc_id")), 2).select("subject_id", "doc_id", "nth")


@query("a29_news_summary", FROM_NEWS + "SELECT subject_id, count(*) AS results, count(*) FILTER (risk_level = 'negative') AS negatives, avg(CASE WHEN risk_level = 'negative' THEN compound END) AS sentiment, list_sort(list(DISTINCT source)) AS sources FROM news GROUP BY subject_id")
def a29(spark, sf_dir):
    return risk.news_summary(_news(spark, sf_dir))


@query("f14_domain", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '/.*$', '', 's'), '^www\.', '') AS domain FROM pages")
def f14(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", risk.domain(F.col("url")).alias("domain"))


@query("u1_merge_results", r"""
    WITH e AS (SELECT page_id AS arrival, regexp_replace(url, '[?#].*$', '') AS url FROM pages UNION ALL SELECT page_id + 1000000, regexp_replace(url, '[?#].*$', '') FROM pages WHERE page_id % 2 = 0)
    SELECT min(arrival) AS arrival, url FROM e GROUP BY url""")
def u1(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("arrival"), F.regexp_replace("url", r"[?#].*$", "").alias("url"))
    again = pages.filter("arrival % 2 = 0").withColumn("arrival", F.col("arrival") + 1000000)
    return risk.merge_results(pages, again)


@query("f1_name_tokens", FROM_PEOPLE + r"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(name), '\s+'), lambda t: t <> ''))) AS tokens FROM people")
def f1(spark, sf_dir):
    return tables.people(spark, sf_dir).select("doc_id", F.array_sort(names.name_tokens(F.col("name"))).alias("tokens"))


def _next_names(spark, sf_dir):
    who = tables.people(spark, sf_dir).select("doc_id", "name")
    return who.join(who.select((F.col("doc_id") - 1).alias("doc_id"), F.col("name").alias("other")), "doc_id")


@query("f2_jaro_winkler")  # the SQL function halves odd numbers of transpositions downwards; tested by brute force
def f2(spark, sf_dir):
    return _next_names(spark, sf_dir).select("doc_id", F.round(names.jaro_winkler(F.lower("name"), F.lower("other")), 4).alias("similarity"))


@query("f3_fuzzy_names")
def f3(spark, sf_dir):
    return _next_names(spark, sf_dir).select("doc_id", names.fuzzy_names(F.col("name"), F.col("other")).alias("similarity"))


@query("f4_clean_name", FROM_PEOPLE + r"SELECT doc_id, nullif(trim(regexp_replace(split_part(name, ' ', 1) || ' ' || CASE WHEN contains(name, ' ') THEN split_part(name, ' ', 2) ELSE split_part(name, ' ', 1) END, '\s+', ' ', 'g')), '') AS name FROM people")
def f4(spark, sf_dir):
    parts = F.split("name", " ")
    stored = F.concat(F.lit("Mr. null "), F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.lit(" S/O "), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)), F.lit("x")))
    return tables.people(spark, sf_dir).select("doc_id", names.clean_name(stored).alias("name"))


@query("f12_text_name_score", FROM_PEOPLE + r""", t AS (SELECT d.doc_id, st, list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(replace(text, ',', ' '))), '\s+'), lambda t: t <> '')) AS wt
        FROM documents d JOIN stok ON subject_id = d.doc_id - d.doc_id % 2) SELECT doc_id, round(""" + _score + ", 6) AS score FROM t")
def f12(spark, sf_dir):
    """Tokens are taken before the join, so each text's are worked out once; they are shuffled in place of the texts."""
    who = tables.subjects(spark, sf_dir).select(F.col("subject_id").alias("who"), names.name_tokens(F.col("full_name")).alias("asked"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") - F.col("doc_id") % 2).alias("who"), names.name_tokens(F.col("text")).alias("told"))
    return docs.join(who, "who").select("doc_id", F.round(names.token_score(F.col("asked"), F.col("told")), 6).alias("score"))


@query("u7_expand_queries", FROM_PEOPLE + """
    SELECT subject_id, unnest([full_name, '"' || full_name || '"', full_name || ' fraud', full_name || ' court']) AS query FROM subjects""")
def u7(spark, sf_dir):
    name = F.col("full_name")
    variants = F.array(name, F.concat(F.lit('"'), name, F.lit('"')), F.concat(name, F.lit(" fraud")), F.concat(name, F.lit(" court")))
    return tables.subjects(spark, sf_dir).select("subject_id", F.explode(variants).alias("query"))
