"""Queries of rules that decide by many cases, and of sources that are written and read back, with their SQL for DuckDB.

Rules on text are run over every row of a given table, whose number picks one of the cases; the expected value of each
case is stated beside it, so that each branch of a rule has one.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from vouch.functions import text as X
from vouch.operators import extract as E, fields as D, layout as Y, lifecycle as L, metrics as M, verify as V
from vouch.plans.extraction import BLOCKS, TERMS, TERM_SQL, _blocks, _docs, _terms
from vouch.plans.tables import SQL as PEOPLE, scratch_dir, table, watch, pep
from vouch.sources import lists, stores

Q, O = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return add


def _pick(key, values, kind="string"):
    """The case of a row, by its number."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _told(key, values, kind="VARCHAR"):
    """The same choice in SQL."""
    literal = lambda v: "NULL" if v is None else str(v) if not isinstance(v, (str, datetime.date)) else "'" + str(v).replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN CAST({literal(v)} AS {kind})" for i, v in enumerate(values)) + " END"


day = datetime.date
DATES = [
    ("on 2024-03-05", day(2024, 3, 5), "2024-03-05"), ("2024.3.5 or so", day(2024, 3, 5), "2024.3.5"), ("paid 13/05/2024", day(2024, 5, 13), "13/05/2024"), ("paid 05/13/2024", day(2024, 5, 13), "05/13/2024"),
    ("both 05-04-2024", day(2024, 4, 5), "05-04-2024"), ("short 5.4.24", day(2024, 4, 5), "5.4.24"), ("old 5/4/45", day(1945, 4, 5), "5/4/45"), ("us short 12/31/29", day(2029, 12, 31), "12/31/29"),
    ("March 5, 2024 here", day(2024, 3, 5), "March 5, 2024"), ("Sept 7 2021", day(2021, 9, 7), "Sept 7 2021"), ("the 15 jan 1999", day(1999, 1, 15), "15 jan 1999"), ("99/99/2024 then 1 May 2020", day(2020, 5, 1), "1 May 2020"),
    ("31/02/2024", None, None), ("1/2-2024", None, None), ("year 1850-01-01", None, None), ("Smarch 3, 2020", None, None), ("no date", None, None), (None, None, None), ("10 may 2020, 2021-01-02", day(2021, 1, 2), "2021-01-02"),
]


@query("d5f_find_date", f"SELECT o_orderkey, {_told('o_orderkey', [d for _, d, _ in DATES], 'DATE')} AS date, {_told('o_orderkey', [w for *_, w in DATES])} AS words FROM orders")
def d5f(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.find_date(_pick("o_orderkey", [t for t, *_ in DATES])).alias("d")).select("o_orderkey", "d.date", "d.words")


DAY = day(2026, 6, 1)
NAMED = [("Issued January 18, 2026", day(2026, 1, 18)), ("18 JANUARY 2026 and MAY 3, 2025", day(2026, 1, 18)), ("30 Nov. 2025", day(2025, 11, 30)), ("03JAN2026", day(2026, 1, 3)), ("2026/02/03, 01-03-2026", day(2026, 3, 1)), ("December 31, 2026", None), ("March 1, 2020", None), ("", None)]


@query("d2f_dates_by_name", f"SELECT o_orderkey, {_told('o_orderkey', [d for _, d in NAMED], 'DATE')} AS date FROM orders")
def d2f(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.statement_date(_pick("o_orderkey", [t for t, _ in NAMED]), DAY).alias("date"))


COUNTRY = [("sg", ["singapore", "sgp", "sg"]), ("us", ["united states", "usa", "us", "america"]), ("uk", ["united kingdom", "uk", "gb", "great britain", "england"]), ("my", ["malaysia", "my"]), ("th", ["thailand", "th"]), ("id", ["indonesia", "id"]), ("ph", ["philippines", "ph"]), ("in", ["india", "in"])]
ASKED = ["SG", "america", " England ", "india", "Thailand", "france", "", None, "zz", "GB", "PH"]


@query("f12_mentions_country", f"WITH a AS (SELECT doc_id, lower(text) AS low, {_told('doc_id', ASKED)} AS country FROM documents) SELECT doc_id, coalesce(low, '') = '' OR coalesce(country, '') = '' OR contains(low, trim(lower(country)))"
       + "".join(f" OR (trim(lower(country)) IN ({', '.join(repr(w) for w in ways)}) AND ({' OR '.join(f'contains(low, {w!r})' for w in ways)}))" for _, ways in COUNTRY) + " AS mentioned FROM a")
def f12(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.mentions_country(F.col("text"), _pick("doc_id", ASKED)).alias("mentioned"))


URLS = [("https://www.LinkedIn.com/in/a", "social_media"), ("http://x.com/b", "social_media"), ("https://a.org/team/c", "company_website"), ("https://bbc.co.uk/about/", "company_website"), ("https://news.example.com/", "news"), ("https://reddit.com/r", "forum"), ("https://instagram.com/cnn", "social_media"), ("https://a.net/", "other"), ("", "other"), (None, "other")]


@query("f14_source_type", f"SELECT page_id, {_told('page_id', [k for _, k in URLS])} AS picked, CASE WHEN contains(lower(url), 'x.com/') OR contains(lower(url), 'facebook.com/') THEN 'social_media' WHEN contains(lower(url), '/team/') OR contains(lower(url), '/about/') THEN 'company_website' WHEN regexp_matches(lower(url), 'cnn|bbc|reuters|bloomberg|news') THEN 'news' WHEN regexp_matches(lower(url), 'reddit|quora|stackexchange') THEN 'forum' ELSE 'other' END AS own FROM pages")
def f14(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.source_type(_pick("page_id", [u for u, _ in URLS])).alias("picked"), X.source_type(F.col("url")).alias("own"))


CODES, PREFIXES = {"US": "USA", "GB": "GBR", "SG": "SGP"}, {"US": "+1", "GB": "+44", "SG": "+65"}
GIVEN = [("us", True, "+1"), ("GBR", True, None), (" sg ", True, "+65"), ("XX", False, None), ("USAX", False, None), ("+49", False, "+49"), ("", False, None), (None, False, None), ("SGP", True, None)]


@query("f15_country_codes", f"SELECT s_suppkey, {_told('s_suppkey', [v for _, v, _ in GIVEN], 'BOOLEAN')} AS valid, {_told('s_suppkey', [d for *_, d in GIVEN])} AS prefix FROM supplier")
def f15(spark, sf_dir):
    code = _pick("s_suppkey", [c for c, *_ in GIVEN])
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.valid_iso(code, CODES).alias("valid"), X.dial_prefix(code, PREFIXES).alias("prefix"))


MONEY = {"USD": ["dollar", "US dollar"], "THB": ["baht"], "INR": ["rupee", "rupees"]}
NAMES = [("usd", "USD", True), ("Baht", "THB", False), (" us DOLLAR ", "USD", False), ("Rupees", "INR", False), ("THB", "THB", True), ("franc", None, False), ("", None, False), (None, None, False)]


@query("f19_currency_iso", f"SELECT c_custkey, {_told('c_custkey', [i for _, i, _ in NAMES])} AS iso, {_told('c_custkey', [v for *_, v in NAMES], 'BOOLEAN')} AS valid FROM customer")
def f19(spark, sf_dir):
    name = _pick("c_custkey", [n for n, *_ in NAMES])
    return table(spark, sf_dir, "customer").select("c_custkey", X.currency_iso(name, MONEY).alias("iso"), D.valid_currency(name, MONEY).alias("valid"))


TYPES = {"letter": ["the", "of", "and", "ing"], "list": ["und", "die", "keit"], "note": ["les", "queau", "oux"]}
LANDS = {"EN": (["the", "thing"], ["ing", "tion", "erand"]), "DE": (["die", "und"], ["keit", "zzz"]), "FR": (["les", "la"], [])}
OWNERS = {"north": ["than", "token"], "south": ["license", "apache", "rights"], "east": ["zzzz"]}
_hits = lambda ws: "(" + " + ".join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in ws) + ")"
_best = lambda groups, what: "CASE " + " ".join(f"WHEN {_hits(ws)} = greatest({', '.join(_hits(w) for w in groups.values())}) AND {_hits(ws)} > 0 THEN {what(n, ws)}" for n, ws in groups.items()) + " END"


@query("f21_detect_parts", rf"""WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
    b AS (SELECT doc_id, {_best(TYPES, lambda n, ws: f"'{n}'")} AS type, coalesce({_best(TYPES, lambda n, ws: f"least({_hits(ws)} / {len(ws)} * CASE WHEN {_hits(ws)} >= 3 THEN 1.2 ELSE 1.0 END, 1.0)")}, 0) AS tc,
          {_best(OWNERS, lambda n, ws: f"'{n}'")} AS entity, coalesce({_best(OWNERS, lambda n, ws: f"least(least({_hits(ws)} / 3, 1) * CASE WHEN {_hits(ws)} >= 2 THEN 1.2 ELSE 1.0 END, 1.0)")}, 0) AS ec,
          CASE {' '.join(rf"WHEN regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(ns)})($|[^\p{{L}}\p{{N}}_])') THEN '{c}'" for c, (ns, _) in LANDS.items())} END AS country,
          CASE {' '.join(rf"WHEN regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(ns)})($|[^\p{{L}}\p{{N}}_])') THEN least(0.7 + 0.1 * {_hits(ws) if ws else 0}, 1.0)" for ns, ws in LANDS.values())} ELSE 0 END AS cc FROM a)
    SELECT doc_id, type, country, entity, round(CAST(tc AS DOUBLE), 6) AS type_confidence, round(CAST(cc AS DOUBLE), 6) AS country_confidence, round(CAST(ec AS DOUBLE), 6) AS entity_confidence, round(CAST(tc * 0.4 + cc * 0.3 + ec * 0.3 AS DOUBLE), 6) AS confidence FROM b""")
def f21(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", E.detect_parts(F.col("text"), TYPES, LANDS, OWNERS).alias("d")).select("doc_id", "d.*")


PLACED = [
    ("12 High Street, London", True, False), ("Ocean Tower, Level 3", False, True), ("Unit 5, 310145 Somewhere", True, False), ("Savings bank, Mill Road 4", True, True), ("Savings bank on a hill", False, False),
    ("road", False, False), ("page 3 of the road map", False, False), ("Branch office 12345", True, True), ("", False, False), (None, False, False),
]


@query("f25_is_address", f"SELECT s_suppkey, {_told('s_suppkey', [a for _, a, _ in PLACED], 'BOOLEAN')} AS address, {_told('s_suppkey', [b for *_, b in PLACED], 'BOOLEAN')} AS bank FROM supplier")
def f25(spark, sf_dir):
    text = _pick("s_suppkey", [t for t, *_ in PLACED])
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.is_address(text, ["street", "road", "avenue"], ["^page"]).alias("address"), X.is_bank_address(text).alias("bank"))


SCRIPTS = [("ถนนสุขุมวิท 21", True, False), ("12 High Street", False, False), ("Straße der Ärzte", False, False), ("บ้าน abcdefg hijklmn", False, False), ("Bcdfghjklmnp qrst", False, True), ("averyveryverylongwordindeed here", False, True), ("12345", False, False), (None, False, False)]


@query("f25_scripts", f"SELECT s_suppkey, {_told('s_suppkey', [a for _, a, _ in SCRIPTS], 'BOOLEAN')} AS foreign_script, {_told('s_suppkey', [b for *_, b in SCRIPTS], 'BOOLEAN')} AS unreadable FROM supplier")
def f25s(spark, sf_dir):
    text = _pick("s_suppkey", [t for t, *_ in SCRIPTS])
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.is_non_latin(text).alias("foreign_script"), X.is_unreadable(text).alias("unreadable"))


STATES = {"Selangor": "MY", "Kerala": "IN", "Texas": "US"}
PLACES = [("kuala lumpur", "city"), ("austin", "city"), ("new delhi", "city"), ("selangor", "state"), ("kerala", "state"), ("texas", "state"), ("india", "country"), ("malaysia", "country")]
ADDRESSES = [
    ("12 Jalan Ampang, Kuala Lumpur, 50450 Selangor", "12", "Jalan Ampang", "kuala lumpur", "50450", "selangor", "MY"), ("7B Lake View, Austin, Texas", "7B", "Lake View", "austin", None, "texas", "US"),
    ("Hill House, New Delhi 110001, India", None, "Hill House", "new delhi", "110001", None, "india"), ("5 Plain Road", "5", "Plain Road", None, None, None, None), ("Beach, KERALA, India", None, "Beach", None, None, "kerala", "india"), (None, None, "", None, None, None, None),
]


@query("f39_parse_addresses", "SELECT s_suppkey AS doc_id, " + ", ".join(f"{_told('s_suppkey', [a[i + 1] for a in ADDRESSES])} AS {n}" for i, n in enumerate(("number", "street", "city", "postal", "state", "country"))) + " FROM supplier")
def f39(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), _pick("s_suppkey", [a[0] for a in ADDRESSES]).alias("address"))
    return D.parse_addresses(rows, spark.createDataFrame(PLACES, "term string, kind string"), STATES)


LAND_OF = [("Selangor", "MY"), (" kerala ", "IN"), ("TEXAS", "US"), ("Bavaria", None), ("", None), (None, None)]


@query("f27_country_from_state", f"SELECT s_suppkey, {_told('s_suppkey', [c for _, c in LAND_OF])} AS country FROM supplier")
def f27(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.country_from_state(_pick("s_suppkey", [s for s, _ in LAND_OF]), STATES).alias("country"))


LABELS = [("Full Name", True, None), ("Nationality / name", False, None), ("12 NOV 1992", False, day(1992, 11, 12)), ("3jan2001", False, day(2001, 1, 3)), ("12/11/1992", False, day(1992, 11, 12)), ("1992-2-3", False, day(1992, 2, 3)), ("31-04-2000", False, None), ("12 NOV 1992 x", False, None), ("", False, None), (None, False, None)]


@query("f40_recognisers", f"SELECT c_custkey, {_told('c_custkey', [n for _, n, _ in LABELS], 'BOOLEAN')} AS name_label, {_told('c_custkey', [d for *_, d in LABELS], 'DATE')} AS date FROM customer")
def f40(spark, sf_dir):
    text = _pick("c_custkey", [t for t, *_ in LABELS])
    return table(spark, sf_dir, "customer").select("c_custkey", X.is_name_label(text).alias("name_label"), X.date_text(text).alias("date"))


@query("f38_field_by_pattern", r"""SELECT doc_id, CASE WHEN regexp_matches(text, 'token = "([0-9a-f ]+)"') THEN replace(regexp_extract(text, 'token = "([0-9a-f ]+)"', 1), ' ', '') END AS value, CASE WHEN regexp_matches(text, 'token = "([0-9a-f ]+)"') THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
    coalesce(regexp_matches(text, 'token = "([0-9a-f ]+)"'), false) AS matched, CASE WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN regexp_extract(text, '[0-9]{3}-[0-9]{4}') END AS phone FROM documents""")
def f38(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.field_by_pattern(F.col("text"), r'token = "([0-9a-f ]+)"', True).alias("f"), X.field_by_pattern(F.col("text"), r"[0-9]{3}-[0-9]{4}", False)["value"].alias("phone")).select("doc_id", "f.*", "phone")


FACTORS = """WITH k AS (SELECT l_orderkey, l_linenumber, 0.6 + l_linenumber * 0.06 AS found, CAST(l_quantity AS DOUBLE) / 53 AS ocr, ['1l1 ab1', 'clean-1', NULL, 'x1o2!', ''][1 + l_linenumber % 5] AS value, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_discount AS DOUBLE) * 9 END AS vc,
        0.1 AS x1, 0.2 AS y1, 0.1 + (l_linenumber % 4) * 0.1 AS x2, 0.3 AS y2, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber % 3 = 1 END AS fits, l_linenumber % 2 = 0 AS required, ['^(ab)', 'ab', '(ab)', NULL][1 + l_linenumber % 4] AS pattern FROM lineitem),
    f AS (SELECT l_orderkey, l_linenumber,
        least(ocr * CASE WHEN found > 0.9 THEN 1.05 WHEN found < 0.7 THEN 0.9 ELSE 1 END * CASE value WHEN '1l1 ab1' THEN 0.9 * 0.95 * 1.02 WHEN 'clean-1' THEN 1.02 WHEN 'x1o2!' THEN 0.9 ELSE 1 END, 1) AS a,
        least(coalesce(vc, 0) * CASE WHEN x2 > x1 + 0.00001 THEN 1.1 ELSE 1 END, 1) AS b, CASE WHEN coalesce(value, '') = '' THEN 0 WHEN fits IS NULL THEN 0.8 WHEN fits THEN 1 ELSE 0.3 END AS c, CASE WHEN required THEN 1 ELSE 0.7 END AS d,
        CASE pattern WHEN '^(ab)' THEN least(0.85 * 1.1 * 1.05, 1) WHEN 'ab' THEN 0.85 WHEN '(ab)' THEN 0.85 * 1.1 ELSE 0.5 END AS e, CASE WHEN value = 'clean-1' AND l_linenumber % 2 = 0 THEN 1 WHEN value = '1l1 ab1' THEN 0.8 + 0.2 * 1 / 2 ELSE 0 END AS g FROM k)
    SELECT l_orderkey, l_linenumber, round(CAST(least(a * 0.25 + b * 0.25 + c * 0.2 + d * 0.15 + e * 0.1 + g * 0.05, 1) AS DOUBLE), 6) AS confidence FROM f"""


@query("f24_confidence_factors", FACTORS)
def f24(spark, sf_dir):
    n = F.col("l_linenumber")
    value = F.element_at(F.array(*map(F.lit, ["1l1 ab1", "clean-1", None, "x1o2!", ""])), (n % 5 + 1).cast("int"))
    pattern = F.element_at(F.array(*map(F.lit, ["^(ab)", "ab", "(ab)", None])), (n % 4 + 1).cast("int"))
    box = F.struct(F.lit(0.1).alias("x1"), F.lit(0.2).alias("y1"), (0.1 + (n % 4) * 0.1).alias("x2"), F.lit(0.3).alias("y2"))
    others = F.when((value == "clean-1") & (n % 2 == 0), F.array(F.lit("clean-1"), F.lit("b"))).when(value == "1l1 ab1", F.array(F.lit("1l1"), F.lit("zzz"))).otherwise(F.array().cast("array<string>"))
    factors = X.confidence_factors(0.6 + n * 0.06, F.col("l_quantity").cast("double") / 53, value, F.when(n % 3 > 0, F.col("l_discount").cast("double") * 9), box, F.when(n % 3 > 0, n % 3 == 1), n % 2 == 0, F.lit(0.85), pattern, others)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.enhanced_confidence(factors), 6).alias("confidence"))


@query("j13_tag_substrings", f"""WITH {TERM_SQL}, f AS (SELECT doc_id, term, kind, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, term DESC, kind DESC) AS n FROM documents JOIN t ON contains(lower(coalesce(text, '')), term)) SELECT doc_id, term, kind FROM f WHERE n = 1""")
def j13(spark, sf_dir):
    return E.tag_dictionary(_docs(spark, sf_dir), _terms(spark, TERMS), mode="substring")


@query("j21_date_confidence", f"""WITH {BLOCKS}, d AS (SELECT doc_id, text AS value FROM b WHERE block_id = 0), w AS (SELECT d.doc_id, value, text, 50 + block_id AS c FROM d JOIN b USING (doc_id))
    SELECT doc_id, 'issue_date' AS field, CAST(round(coalesce(max(CASE WHEN len(list_filter(regexp_split_to_array(lower(trim(value)), '\\s+'), lambda x: length(x) > 1 AND contains(lower(trim(text)), x))) > 0 THEN c END), 85), 4) AS DOUBLE) AS confidence FROM w GROUP BY 1""")
def j21(spark, sf_dir):
    blocks = _blocks(spark, sf_dir).withColumn("confidence", (F.col("block_id") + 50).cast("double"))
    return Y.field_confidence(blocks.filter("block_id = 0").select("doc_id", F.lit("issue_date").alias("field"), F.col("text").alias("value")), blocks)


KEYS = """a AS (SELECT l_orderkey AS doc_id, ['account_number', 'name', 'bank', 'branch'][1 + l_linenumber % 4] AS key_name, CASE WHEN l_linenumber % 4 = 0 AND l_partkey % 2 = 0 THEN '12345678' ELSE 'v' || l_linenumber END AS value, CAST(l_discount AS DOUBLE) AS confidence FROM lineitem WHERE l_tax > 0.02),
    b AS (SELECT l_orderkey AS doc_id, ['account_number', 'name', 'bank', 'branch'][1 + l_linenumber % 4] AS key_name, 'w' || l_linenumber AS value, CAST(l_tax AS DOUBLE) AS confidence FROM lineitem WHERE l_discount > 0.05)"""


@query("j23_numbers_first", f"""WITH {KEYS}, n AS (SELECT * FROM a WHERE key_name = 'account_number' AND value = '12345678'),
    m AS (SELECT *, 'number' AS origin FROM n UNION ALL SELECT *, 'layout' FROM b WHERE NOT (key_name = 'account_number' AND doc_id IN (SELECT doc_id FROM n)) UNION ALL SELECT *, 'pattern' FROM a WHERE NOT (key_name = 'account_number' AND value = '12345678') AND (doc_id, key_name) NOT IN (SELECT doc_id, key_name FROM b))
    SELECT doc_id, key_name, value, confidence, origin, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY origin <> 'number', confidence DESC, origin, key_name, value) AS INTEGER) AS rank FROM m""")
def j23(spark, sf_dir):
    n = F.col("l_linenumber")
    name = F.element_at(F.array(*map(F.lit, ["account_number", "name", "bank", "branch"])), (n % 4 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").withColumn("key_name", name)
    value = F.when((n % 4 == 0) & (F.col("l_partkey") % 2 == 0), "12345678").otherwise(F.concat(F.lit("v"), n.cast("string")))
    pattern = lines.filter("l_tax > 0.02").select(F.col("l_orderkey").alias("doc_id"), "key_name", value.alias("value"), F.col("l_discount").cast("double").alias("confidence"))
    layout = lines.filter("l_discount > 0.05").select(F.col("l_orderkey").alias("doc_id"), "key_name", F.concat(F.lit("w"), n.cast("string")).alias("value"), F.col("l_tax").cast("double").alias("confidence"))
    return V.merge_keys(pattern, layout)


FIELDS = "['address', 'city', 'postal', 'name', 'bank'][1 + l_linenumber % 5]"


@query("j22_parts_together", f"""WITH p AS (SELECT l_orderkey AS doc_id, {FIELDS} AS field, max(CAST(l_quantity AS DOUBLE) * 2) AS pc FROM lineitem WHERE l_linenumber < 6 GROUP BY 1, 2), s AS (SELECT l_orderkey AS doc_id, {FIELDS} AS field, max(CAST(l_tax AS DOUBLE) * 1000) AS sc FROM lineitem WHERE l_linenumber < 6 AND l_partkey % 3 > 0 GROUP BY 1, 2),
    j AS (SELECT coalesce(p.doc_id, s.doc_id) AS doc_id, coalesce(p.field, s.field) AS field, pc, sc FROM p FULL JOIN s ON p.doc_id = s.doc_id AND p.field = s.field), f AS (SELECT *, coalesce(pc >= 50, false) OR (sc IS NULL AND pc IS NOT NULL) AS one FROM j),
    l AS (SELECT *, bool_or(field = 'address' AND NOT one AND sc IS NOT NULL) OVER (PARTITION BY doc_id) AS led FROM f), r AS (SELECT *, one AND NOT (led AND field IN ('city', 'postal') AND sc IS NOT NULL) AS own FROM l)
    SELECT doc_id, field, CASE WHEN own THEN 'p' ELSE 's' END AS value, CASE WHEN own THEN 'primary' ELSE 'secondary' END AS source FROM r""")
def j22(spark, sf_dir):
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber < 6").withColumn("field", F.element_at(F.array(*map(F.lit, ["address", "city", "postal", "name", "bank"])), (n % 5 + 1).cast("int")))
    side = lambda df, c, v: df.groupBy(F.col("l_orderkey").alias("doc_id"), "field").agg(F.max(c).alias("confidence")).withColumn("value", F.lit(v))
    merged = V.merge_extractions(side(lines, F.col("l_quantity").cast("double") * 2, "p"), side(lines.filter("l_partkey % 3 > 0"), F.col("l_tax").cast("double") * 1000, "s"), ["name", "bank"], [], parts={"address": ["city", "postal"]})
    return merged.select("doc_id", "field", "value", "source")


@query("w10_dedupe_keys", """WITH k AS (SELECT l_orderkey AS doc_id, ['company_name', 'full_name', 'bank'][1 + l_partkey % 3] AS field, 'v' || l_linenumber AS value, CAST(l_quantity AS DOUBLE) AS confidence, CAST(l_discount AS DOUBLE) * 5 AS y1 FROM lineitem),
    c AS (SELECT *, max(confidence) FILTER (field = 'company_name') OVER (PARTITION BY doc_id) AS company FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, value) AS n FROM c WHERE NOT (field = 'full_name' AND company IS NOT NULL AND NOT (y1 < 0.3 AND confidence > company * 1.1)))
    SELECT doc_id, field, value, confidence FROM r WHERE n = 1""")
def w10(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["company_name", "full_name", "bank"])), (F.col("l_partkey") % 3 + 1).cast("int"))
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), kind.alias("field"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("value"), F.col("l_quantity").cast("double").alias("confidence"), (F.col("l_discount").cast("double") * 5).alias("y1"))
    return V.dedupe_keys(keys).select("doc_id", "field", "value", "confidence")


SETS = [(["passport_number", "full_name", "date_of_birth"], 75.0), (["full_name", "date_of_birth", "sex"], 60.0), (["sex"], 30.0), (["passport_number", "x"], 45.0), ([], 0.0), (["x"], 0.0)]
SHARES = [([0.5, 0.7], 60.0), ([50.0, 90.0], 70.0), ([], None), ([1.0], 100.0)]


@query("a34_record_kinds", f"SELECT l_orderkey, l_linenumber, {_told('l_linenumber', [c for _, c in SETS], 'DOUBLE')} AS document, coalesce({_told('l_orderkey', [c for _, c in SHARES], 'DOUBLE')}, least(50.0 + 5 * l_linenumber, 85.0)) AS card FROM lineitem")
def a34(spark, sf_dir):
    kinds = F.element_at(F.array(*[F.array(*map(F.lit, names)).cast("array<string>") for names, _ in SETS]), (F.col("l_linenumber") % len(SETS) + 1).cast("int"))
    given = F.element_at(F.array(*[F.array(*map(F.lit, c)).cast("array<double>") for c, _ in SHARES]), (F.col("l_orderkey") % len(SHARES) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.record_confidence(kinds, "document").alias("document"), V.record_confidence(F.col("l_linenumber"), "card", given).alias("card"))


MOMENTS = "v{0} AS (SELECT avg({0}) AS m FROM p), s{0} AS (SELECT avg(power({0} - m, 2)) AS var, avg(power({0} - m, 3)) / power(avg(power({0} - m, 2)), 1.5) AS skew, avg(power({0} - m, 4)) / power(avg(power({0} - m, 2)), 2) - 3 AS kurt FROM p, v{0})"


@query("a27_aligned_similarity", f"""WITH p AS (SELECT CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) / 2000 AS b FROM lineitem), {MOMENTS.format('a')}, {MOMENTS.format('b')},
    ha AS (SELECT least(floor(a / 50 * 32), 31) AS slot, count(*) AS n FROM p WHERE a BETWEEN 0 AND 50 GROUP BY 1), hb AS (SELECT least(floor(b / 50 * 32), 31) AS slot, count(*) AS n FROM p WHERE b BETWEEN 0 AND 50 GROUP BY 1),
    o AS (SELECT sum(least(ha.n / (SELECT sum(n) FROM ha), hb.n / (SELECT sum(n) FROM hb))) AS x FROM ha JOIN hb USING (slot)), f AS (SELECT ((SELECT corr(a, b) FROM p) + 1) / 2 AS c,
    (least(sa.var, sb.var) / (greatest(sa.var, sb.var) + 1e-10) + 1 - least(abs(sa.skew - sb.skew), 2) / 2 + 1 - least(abs(sa.kurt - sb.kurt), 10) / 10) / 3 AS t, x AS h FROM sa, sb, o)
    SELECT round(c, 6) AS correlation, round(t, 6) AS texture, round(h, 6) AS histogram, round((0.5 * c + 0.3 * t + 0.2 * h) / 1.0, 6) AS overall FROM f""")
def a27(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice").cast("double") / 2000).alias("b"))
    return M.aligned_similarity(pairs, 0.0, 50.0, {"correlation": 0.5, "texture": 0.3, "histogram": 0.2})


@query("d8_keep_history", "SELECT event_id AS id, true AS is_active, CAST(NULL AS BIGINT) AS replaced_by FROM events")
def d8(spark, sf_dir):
    subs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("document_type"), F.col("ts").alias("submitted_at"))
    return L.deactivate_old(subs, "keep").select("id", "is_active", "replaced_by")


#: A page of blocks for each supplier: text, x1, y1, and the group that content_blocks makes.
PAGE = [
    ("Statement", 0.1, 0.01, 0), ("BLK 12 Hill", 0.1, 0.10, 1), ("#03-11", 0.6, 0.20, 1), ("SINGAPORE 310145", 0.1, 0.40, 1), ("John Tan", 0.5, 0.60, 2), ("12 HIGH Street", 0.52, 0.67, 2), ("note", 0.9, 0.68, 3), ("#04-01", 0.1, 0.80, 4), ("near", 0.12, 0.82, 4), ("AVENUE 5", 0.9, 0.95, 5),
]


def _pages(spark, sf_dir, texts=PAGE):
    blocks = F.array(*[F.struct(F.lit(i).alias("block_id"), F.lit(t).alias("text"), F.lit(x).alias("x1"), F.lit(y).alias("y1"), F.lit(round(x + 0.05, 3)).alias("x2"), F.lit(round(y + 0.02, 3)).alias("y2")) for i, (t, x, y, *_) in enumerate(texts)])
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.explode(blocks).alias("b")).select("doc_id", "b.*")


@query("w6_content_blocks", "WITH b(g, i, t) AS (VALUES " + ", ".join(f"({g}, {i}, '{t}')" for i, (t, _, _, g) in enumerate(PAGE)) + "), s AS (SELECT g, count(*) AS n, string_agg(t, ' ' ORDER BY i) AS t FROM b GROUP BY g) SELECT s_suppkey AS doc_id, CAST(g AS BIGINT) AS \"group\", n AS boxes, t AS text FROM supplier, s")
def w6(spark, sf_dir):
    return Y.content_blocks(_pages(spark, sf_dir)).select("doc_id", "group", "boxes", "text")


#: Addresses of a page: text, x1, y1, and whose they are, with the holder at the top and the bank at the bottom.
OWNED = [("5 Mill Lane", 0.1, 0.1, "holder"), ("Ocean Tower 3", 0.1, 0.12, "bank"), ("8 Dock Lane", 0.1, 0.9, "bank"), ("ถนนสุขุมวิท", 0.1, 0.85, "holder")]


@query("l6_address_owners", "SELECT s_suppkey AS doc_id, CAST(i AS INTEGER) AS block_id, CASE WHEN i = 3 AND s_suppkey % 2 = 1 THEN 'bank' ELSE o END AS owner FROM supplier, (VALUES " + ", ".join(f"({i}, '{o}')" for i, (*_, o) in enumerate(OWNED)) + ") v(i, o)")
def l6(spark, sf_dir):
    """Thai pages and others: there the address in another script goes to the nearer anchor."""
    addresses = _pages(spark, sf_dir, OWNED)
    anchors = _pages(spark, sf_dir, [("Holder", 0.1, 0.05), ("Bank", 0.1, 0.95)]).withColumn("block_id", F.col("block_id") + 10)
    return Y.address_owners(addresses, anchors.filter("block_id = 10"), anchors.filter("block_id = 11"), F.when(F.col("doc_id") % 2 == 0, "TH").otherwise("FR"))


@query("l6_single_address", "SELECT s_suppkey AS doc_id, 0 AS block_id, CASE WHEN s_suppkey % 2 = 0 THEN 'bank' ELSE 'holder' END AS owner FROM supplier")
def l6s(spark, sf_dir):
    pages = _pages(spark, sf_dir, [("x", 0.1, 0.5)]).withColumn("text", F.when(F.col("doc_id") % 2 == 0, "Head office").otherwise("Mill Lane"))
    return Y.address_owners(pages, pages.limit(0), pages.withColumn("block_id", F.col("block_id") + 1))


TOPS = [("SG" if i % 4 == 0 else "IN" if i % 4 == 1 else None) for i in range(4)]


@query("l5_topmost_country", "SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'SG' WHEN 1 THEN 'IN' END AS country FROM supplier WHERE s_suppkey % 4 < 2")
def l5(spark, sf_dir):
    """Singapore in the second block, India by a short name in the third; a fourth block comes too late, and a short name must be all of it."""
    k = F.col("doc_id") % 4
    pages = _pages(spark, sf_dir, [("a", 0.1, 0.1), ("b", 0.1, 0.2), ("c", 0.1, 0.3), ("d", 0.1, 0.4)])
    text = F.when((k == 0) & (F.col("block_id") == 1), "12 Road, Singapore").when((k == 1) & (F.col("block_id") == 2), "bharat").when((k == 2) & (F.col("block_id") == 3), "India").when((k == 3) & (F.col("block_id") == 1), "in Bharat").otherwise(F.col("text"))
    return Y.topmost_country(pages.withColumn("text", text), {"IN": ["India", "Bharat"], "SG": ["Singapore"]})


def _folder(spark, label):
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("s1_read_watch", f"WITH {PEOPLE} SELECT entry_id, source_key, name FROM watch WHERE source_key = 'src3'")
def s1(spark, sf_dir):
    path = _folder(spark, "watch")
    watch(spark, sf_dir).write.parquet(path)
    return lists.read_watch(spark, path, "src3").select("entry_id", "source_key", "name")


@query("s2_read_pep", f"WITH {PEOPLE} SELECT entry_id, source_key, position FROM pep WHERE source_key = 'src1'")
def s2(spark, sf_dir):
    path = _folder(spark, "pep")
    pep(spark, sf_dir).write.parquet(path)
    return lists.read_pep(spark, path, "src1").select("entry_id", "source_key", "position")


def _vectors(spark, sf_dir):
    n = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("m"), (n % 2).cast("string")).alias("model_name"), F.lit("d").alias("detector_backend"), (n % 3 == 0).alias("aligned"), F.lit(True).alias("l2_normalized"))


@query("s4_read_embeddings", "SELECT vec_id, len(embedding) AS dimensions FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 3 = 0")
def s4(spark, sf_dir):
    path = _folder(spark, "embeddings")
    stores.write_embeddings(_vectors(spark, sf_dir), path)
    return stores.read_embeddings(spark, path, model_name="m1", aligned=True).select("vec_id", F.size("embedding").cast("long").alias("dimensions"))


@query("s6_write_index", "SELECT vec_id, vec_id % 7 AS bucket, 'm' || (vec_id % 2) AS model FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def s6(spark, sf_dir):
    """The buckets of one model are written twice; the second time takes the place of the first, the other model's stay."""
    path = _folder(spark, "index")
    buckets = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("bucket"))
    stores.write_index(buckets.filter("vec_id % 2 = 0"), path, {"model": "m0"})
    stores.write_index(buckets.filter("vec_id % 2 = 1"), path, {"model": "m1"})
    stores.write_index(buckets.filter("vec_id % 2 = 1 and vec_id % 3 = 0"), path, {"model": "m1"})
    return spark.read.parquet(path).select("vec_id", "bucket", "model")


@query("s7_file_inventory", "SELECT 'txt' AS extension, sha256(n_name || chr(10)) AS hash, CAST(length(n_name) + 1 AS BIGINT) AS length FROM nation")
def s7(spark, sf_dir):
    """A file for each nation."""
    path = _folder(spark, "files")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nations.repartition(25, "n_nationkey").select(F.col("n_name").alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(path)
    return lists.file_inventory(spark, path).filter("extension = 'txt'").select("extension", "hash", "length")


@query("s8_read_ground_truth", "SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_brand AS annotation FROM part")
def s8(spark, sf_dir):
    path = _folder(spark, "truth")
    table(spark, sf_dir, "part").select(F.to_json(F.create_map(F.col("p_partkey").cast("string"), F.col("p_brand"))).alias("value")).write.text(path)
    return lists.read_ground_truth(spark, path)


@query("s9_read_pairs", "SELECT 'a' || c_custkey || '.jpg' AS file_x, c_name || ', \"x\"' AS file_y, CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS decision FROM customer")
def s9(spark, sf_dir):
    path = _folder(spark, "pairs")
    pairs = table(spark, sf_dir, "customer").select(F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit(".jpg")).alias("file_x"), F.concat("c_name", F.lit(', "x"')).alias("file_y"), F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise("No").alias("decision"))
    pairs.write.option("header", True).option("escape", '"').csv(path)
    return lists.read_pairs(spark, path)


@query("s10_read_dictionaries", "SELECT DISTINCT lower(n_name) AS term, CAST(n_regionkey AS VARCHAR) AS kind FROM nation")
def s10(spark, sf_dir):
    path = _folder(spark, "dictionaries")
    kinds = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("kind")).agg(F.collect_list("n_name").alias("terms"))
    kinds.select(F.to_json(F.create_map("kind", "terms")).alias("value")).write.text(path)
    return lists.read_dictionaries(spark, path)


ALIKE = [("Alpha", " alpha ", True), ("alphabet soup", "soup", True), ("cat", "concatenate", True), ("Johnson", "johnsen", True), ("Kingston", "Livingston", True), ("abcd", "abce", False), ("hello", "world", False), ("abcdeX", "abcdeY", True), (None, "x", False), ("x", None, False)]


@query("f7_partial_cases", f"SELECT c_custkey, {_told('c_custkey', [v for *_, v in ALIKE], 'BOOLEAN')} AS alike FROM customer")
def f7(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.partial_match(_pick("c_custkey", [a for a, *_ in ALIKE]), _pick("c_custkey", [b for _, b, _ in ALIKE])).alias("alike"))


CLEANED = [
    ("12 Low Road, Springfield, 12345", "Springfield", "12345", "12 low road"), ("A, b ,a,  B  c", None, None, "a, b, b c"), ("Mill  Lane,SPRINGFIELD", "springfield", None, "mill lane"), ("12345", None, "12345", ""), ("", "x", "y", ""), ("no parts here", "zz", None, "no parts here"), (None, "x", None, None),
]


@query("f26_clean_cases", f"SELECT s_suppkey, {_told('s_suppkey', [c for *_, c in CLEANED])} AS clean FROM supplier")
def f26(spark, sf_dir):
    of = lambda k: _pick("s_suppkey", [c[k] for c in CLEANED])
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.clean_address(of(0), of(1), of(2)).alias("clean"))


SIGNS = [
    ("ab12345", True, False, False), ("12345", False, False, False), ("ABCDEFG12345678", False, False, False), ("A1B2C3D4E5", True, False, False), ("SGP", False, True, False), ("sgp", False, False, False), (" usa ", False, False, False), (" USA ", False, True, False),
    ("m", False, False, True), ("Female", False, False, True), ("X", False, False, True), ("Z", False, False, False), ("", False, False, False), (None, False, False, False),
]


@query("f28_recogniser_cases", "SELECT c_custkey, " + ", ".join(f"{_told('c_custkey', [s[k] for s in SIGNS], 'BOOLEAN')} AS {n}" for k, n in ((1, "passport"), (2, "country"), (3, "sex"))) + " FROM customer")
def f28(spark, sf_dir):
    text = _pick("c_custkey", [s[0] for s in SIGNS])
    return table(spark, sf_dir, "customer").select("c_custkey", D.is_passport_number(text).alias("passport"), D.is_country_code(text).alias("country"), D.is_sex(text).alias("sex"))


#: Fields of a record, those that failed, those required, and what is left and what is missing.
RECORDS = [("a b c", "b", "a d", "a c", "d"), ("a b", "", "b a", "a b", ""), ("a", "a", "", "", ""), ("", "x", "z y", "", "y z"), ("c a", "z", "c", "a c", "")]


@query("p19_u3_records", f"SELECT p_partkey, {_told('p_partkey', [r[3] for r in RECORDS])} AS kept, {_told('p_partkey', [r[4] for r in RECORDS])} AS missing FROM part")
def p19(spark, sf_dir):
    of = lambda k: F.filter(F.split(_pick("p_partkey", [r[k] for r in RECORDS]), " "), lambda x: x != "")
    fields = F.map_from_arrays(of(0), F.transform(of(0), lambda x: F.upper(x)))
    kept = F.array_join(F.array_sort(F.map_keys(V.drop_failed(fields, of(1)))), " ")
    return table(spark, sf_dir, "part").select("p_partkey", kept.alias("kept"), F.array_join(V.missing_fields(of(2), of(0)), " ").alias("missing"))


VERIFIED = """WITH o AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 5 = 4 THEN '_m' ELSE 'f' || l_linenumber END AS field, max(l_partkey) AS p FROM lineitem WHERE l_linenumber < 6 GROUP BY 1, 2),
    e AS (SELECT doc_id, field, CASE p % 4 WHEN 0 THEN 'Same' WHEN 1 THEN 'sa me' WHEN 2 THEN 'Other' END AS expected, p % 3 AS k FROM o),
    j AS (SELECT *, CASE WHEN k > 0 THEN 'SAME' END AS found, CASE WHEN k > 0 THEN coalesce(lower(replace(expected, ' ', '')) = 'same', false) ELSE expected IS NULL END AS agrees FROM e WHERE field <> '_m')
    SELECT doc_id, count(*) AS asked, count(*) FILTER (agrees) AS agreeing, count(*) FILTER (found IS NULL) AS missing, coalesce(string_agg(field, ' ' ORDER BY field) FILTER (NOT agrees), '') AS disagreeing FROM j GROUP BY 1"""


@query("j12_verify_cases", VERIFIED)
def j12(spark, sf_dir):
    """Values that agree but for case and spaces, that differ, that are null on one side or both, and names that are no fields."""
    n, k = F.col("l_linenumber"), F.col("k")
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber < 6").groupBy(F.col("l_orderkey").alias("doc_id"), F.when(n % 5 == 4, "_m").otherwise(F.concat(F.lit("f"), n.cast("string"))).alias("field")).agg(F.max("l_partkey").alias("k"))
    lines = lines.select("doc_id", "field", F.when(k % 4 == 0, "Same").when(k % 4 == 1, "sa me").when(k % 4 == 2, "Other").alias("expected"), "k")
    as_map = lambda df, c: df.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", c))).alias("fields"))
    found = as_map(lines.filter("k % 3 > 0").withColumn("found", F.lit("SAME")), "found")
    return V.verify_fields(as_map(lines, "expected"), found).select("doc_id", "asked", "agreeing", "missing", F.array_join("disagreeing", " ").alias("disagreeing"))
