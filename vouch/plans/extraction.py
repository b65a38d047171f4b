"""Queries of the extraction and layout operators over the given tables, with their SQL for DuckDB."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from vouch.functions import text as X
from vouch.operators import extract as E, layout as Y
from vouch.plans.tables import table

Q, O = {}, {}
DAY = datetime.date(1998, 8, 1)


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return add


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@query("d1f_parse_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def d1f(spark, sf_dir):
    """Each order's date in one of six forms; forms that read day before month are given only where that is sure."""
    date, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 6
    sure = F.dayofmonth(date) > 12
    given = (
        F.when(k == 0, F.date_format(date, "yyyy-MM-dd")).when(k == 1, F.upper(F.date_format(date, "d MMM yyyy"))).when(k == 2, F.date_format(date, "yyyyMMdd"))
        .when(k == 3, F.date_format(date, "dd/MM/yyyy")).when((k == 4) & sure, F.date_format(date, "MM/dd/yyyy")).otherwise(F.date_format(date, "dd-MM-yyyy"))
    )
    return _orders(spark, sf_dir).select("o_orderkey", X.parse_date(given).alias("date"))


@query("d2f_statement_date", """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '1998-08-01' AS t FROM orders)
    SELECT o_orderkey, CASE WHEN d < t - 730 THEN NULL WHEN d <= t THEN d WHEN d - 30 <= t THEN d - 30 END AS statement_date FROM d""")
def d2f(spark, sf_dir):
    date = F.to_date("o_orderdate")
    text = F.concat(F.lit("from "), F.date_format(F.date_sub(date, 30), "dd/MM/yyyy"), F.lit(" to "), F.date_format(date, "d MMMM yyyy"), F.lit(", page 1"))
    return _orders(spark, sf_dir).select("o_orderkey", F.when(date >= F.lit(DAY) - F.expr("INTERVAL 730 DAYS"), X.statement_date(text, DAY)).alias("statement_date"))


@query("d3f_split_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, 'paid on at ' || o_orderpriority AS rest FROM orders")
def d3f(spark, sf_dir):
    text = F.concat(F.lit("paid on "), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("  at "), F.col("o_orderpriority"))
    return _orders(spark, sf_dir).select("o_orderkey", X.split_dates(text).alias("s")).select("o_orderkey", F.col("s.dates")[0].alias("date"), "s.rest")


@query("d4f_format_date", "SELECT o_orderkey, upper(strftime(o_orderdate, '%d %b %Y')) AS date FROM orders")
def d4f(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", X.format_date(F.col("o_orderdate")).alias("date"))


@query("d6f_age", "SELECT o_orderkey, CAST(date_part('year', age(DATE '2024-06-01', CAST(o_orderdate AS DATE))) AS INTEGER) AS age FROM orders")
def d6f(spark, sf_dir):
    from vouch.operators.lifecycle import age

    return _orders(spark, sf_dir).select("o_orderkey", age(F.to_date("o_orderdate"), datetime.date(2024, 6, 1)).alias("age"))


@query("n1_parse_amount", "SELECT c_custkey, round(c_acctbal, 2) AS amount FROM customer")
def n1(spark, sf_dir):
    said = F.concat(F.when(F.col("c_acctbal") < 0, "(").otherwise(""), F.lit("$ "), F.format_number(F.abs("c_acctbal"), 2), F.when(F.col("c_acctbal") < 0, ")").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(X.parse_amount(said), 2).alias("amount"))


@query("n3_rotate", "SELECT l_orderkey, l_linenumber, round(1 - l_tax, 6) AS x, round(l_discount, 6) AS y FROM lineitem")
def n3(spark, sf_dir):
    x, y = X.rotate(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), 90)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("f15_composite_hash", "SELECT c_custkey, sha256(c_name || '_' || c_nationkey) AS hash, CASE c_nationkey % 3 WHEN 0 THEN 'USA' WHEN 1 THEN 'GBR' END AS alpha3 FROM customer")
def f15(spark, sf_dir):
    code = F.element_at(F.array(F.lit("us"), F.lit("gbr"), F.lit("zz")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.composite_hash(F.col("c_name"), F.col("c_nationkey").cast("string")).alias("hash"), X.alpha3(code, {"US": "USA", "GB": "GBR"}).alias("alpha3"))


@query("f16_validate_account", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'masked' WHEN 1 THEN 'not_digits' WHEN 2 THEN 'length' WHEN 3 THEN 'empty' END AS refused FROM orders""")
def f16(spark, sf_dir):
    k = F.col("o_orderkey")
    number = F.when(k % 5 == 0, "XXXX-1234").when(k % 5 == 1, "12A45678").when(k % 5 == 2, "1234567").when(k % 5 == 3, " ").otherwise(F.lpad((k + 100000000).cast("string"), 10, "7"))
    return _orders(spark, sf_dir).select("o_orderkey", X.validate_account(number, F.lit(8), F.lit(12)).alias("refused"))


@query("f17_extract_account", r"SELECT doc_id, nullif(regexp_extract(regexp_replace(coalesce(text, ''), '([0-9])[ \-]([0-9])', '\1\2', 'g'), '(^|[^0-9])([0-9]{8,15})([^0-9]|$)', 2), '') IS NOT NULL AS found FROM documents WHERE false")
def f17(spark, sf_dir):
    """Boundaries that look aside are not in the other dialect; tested on a fixture."""
    return _docs(spark, sf_dir).select("doc_id", X.extract_account(F.col("text")).alias("account"))


del O["f17_extract_account"]


@query("f7_partial_match", "SELECT p_partkey, p_name = p_brand OR contains(lower(p_name), lower(p_type[1:3])) OR contains(lower(p_type[1:3]), lower(p_name)) AS alike FROM part")
def f7(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.partial_match(F.col("p_name"), F.left("p_type", F.lit(3))).alias("alike"))


@query("f24_enhanced_confidence", "SELECT l_orderkey, l_linenumber, round(least(greatest(l_quantity / 50 * 0.25 + (1 - l_discount) * 0.25 + l_tax * 0.2 + 0.5 * 0.15, 0), 1), 6) AS confidence FROM lineitem")
def f24(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    parts = {"ocr": d("l_quantity") / 50, "spatial": 1 - d("l_discount"), "format": d("l_tax"), "key_importance": F.lit(0.5)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.enhanced_confidence(parts), 6).alias("confidence"))


@query("f26_clean_address", "SELECT c_custkey, '1 low road' AS address FROM customer")
def f26(spark, sf_dir):
    given = F.concat(F.lit("1 Low  Road, "), F.col("c_mktsegment"), F.lit(",1 low road, "), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.clean_address(given, F.col("c_mktsegment"), F.col("c_name")).alias("address"))


@query("f30_fix_terms", "SELECT doc_id, replace(replace(text, 'th', 'ht'), 'er', 're') AS text FROM documents")
def f30(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.fix_terms(F.col("text"), {"th": "ht", "er": "re"}).alias("text"))


@query("f31_extract_code", "SELECT event_id, lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '1') AS code, event_id % 2 = 0 AS named FROM events")
def f31(spark, sf_dir):
    code = F.lpad((F.col("event_id") % 1000000).cast("string"), 6, "1")
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Your OTP: "), code)).otherwise(F.concat(F.lit("see "), code, F.lit(".")))
    return table(spark, sf_dir, "events").select("event_id", X.extract_code(said).alias("c")).select("event_id", "c.code", "c.named")


@query("f32_metadata_score", "SELECT c_custkey, greatest(100 - CASE WHEN c_nationkey % 2 = 0 THEN 40 ELSE 0 END - CASE WHEN c_nationkey % 3 = 0 THEN 20 ELSE 0 END - CASE WHEN c_nationkey % 5 = 0 THEN 10 WHEN c_nationkey % 7 = 0 THEN 20 ELSE 0 END, 0) AS score FROM customer")
def f32(spark, sf_dir):
    k = F.col("c_nationkey")
    day = lambda d: F.lit(d).cast("date")
    score = X.metadata_score(F.when(k % 2 == 0, "editor"), F.when(k % 3 != 0, "camera"), F.when(k % 5 != 0, day("2024-01-02")), F.when(k % 7 == 0, day("2024-01-01")).otherwise(day("2024-01-03")))
    return table(spark, sf_dir, "customer").select("c_custkey", score.alias("score"))


@query("f33_tax_score", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 40.0 ELSE 0 END + CASE WHEN 2010 + c_nationkey BETWEEN 2014 AND 2024 THEN 20.0 ELSE 0 END + CASE WHEN c_acctbal > 0 AND c_acctbal <= 5000 THEN 20.0 ELSE 0 END + 10.0 + least(10.0, c_nationkey / 10) AS score FROM customer")
def f33(spark, sf_dir):
    k = F.col("c_nationkey")
    score = X.tax_score(k % 2 == 0, (k + 2010).cast("string"), F.lit(5000.0), F.col("c_acctbal"), F.lit("office"), F.array(k.cast("double"), k.cast("double")), datetime.date(2024, 6, 1))
    return table(spark, sf_dir, "customer").select("c_custkey", score.alias("score"))


@query("f34_amounts_ok", "SELECT o_custkey AS doc_id, count(*) AS amounts, CASE WHEN count(*) < 3 THEN true ELSE min(o_totalprice) >= 0 AND max(o_totalprice) <= 400000 END AS ok FROM orders GROUP BY 1")
def f34(spark, sf_dir):
    each = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("amounts"), F.bool_and(F.col("o_totalprice").between(0, 400000)).alias("fine"))
    return each.select("doc_id", "amounts", ((F.col("amounts") < 3) | F.col("fine")).alias("ok"))


@query("f37_mask_phone", "SELECT c_custkey, '****' || right(c_name, 4) AS masked FROM customer")
def f37(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.mask_phone(F.col("c_name")).alias("masked"))


WORDS = r"w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS word FROM documents)"
TERMS = [("the", "article"), ("erthe", "odd"), ("of the", "phrase"), ("de la", "phrase"), ("und den", "phrase"), ("la", "article"), ("die", "article"), ("in", "preposition"), ("de", "preposition"), ("idiot", "insult")]
SINGLE = [t for t in TERMS if " " not in t[0]]
TERM_SQL = "t(term, kind) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TERMS) + ")"
SINGLE_SQL = "t(word, kind) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SINGLE) + ")"


def _terms(spark, listed=TERMS):
    return spark.createDataFrame(listed, "term string, kind string")


@query("j13_tag_dictionary", f"""WITH {TERM_SQL}, p AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS line FROM documents),
    f AS (SELECT doc_id, term, kind, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, term DESC, kind DESC) AS n FROM p JOIN t ON contains(line, ' ' || term || ' ')) SELECT doc_id, term, kind FROM f WHERE n = 1""")
def j13(spark, sf_dir):
    return E.tag_dictionary(_docs(spark, sf_dir), _terms(spark), longest=2)


@query("f21_detect_document", f"""WITH {WORDS}, {SINGLE_SQL}, h AS (SELECT doc_id, kind, count(*) AS hits FROM w JOIN t USING (word) GROUP BY 1, 2), z AS (SELECT kind, count(*) AS size FROM t GROUP BY 1),
    r AS (SELECT doc_id, kind, round(hits / size, 6) AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY round(hits / size, 6) DESC, kind) AS n FROM h JOIN z USING (kind)) SELECT doc_id, kind, confidence FROM r WHERE n = 1""")
def f21(spark, sf_dir):
    return E.detect_document(_docs(spark, sf_dir), _terms(spark, SINGLE))


SCHEMAS = {"english": ["the", "with", "from"], "french": ["les", "queau"], "german": ["und", "keit", "schaft", "zzz"]}
_share = lambda ws: "(" + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INTEGER)" for w in ws) + f") / {len(ws)}"
RANKED = "s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS schema, {_share(ws)} AS score, {len(ws)} AS size FROM documents" for n, ws in SCHEMAS.items()) + "), k AS (SELECT doc_id, schema, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, size DESC, schema) AS rank FROM s)"


@query("f22_schema_score", f"SELECT doc_id, round({_share(SCHEMAS['english'])}, 6) AS score FROM documents")
def f22(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(E.schema_score(F.col("text"), SCHEMAS["english"]), 6).alias("score"))


@query("o4_rank_schemas", f"WITH {RANKED} SELECT * FROM k WHERE rank <= 2")
def o4(spark, sf_dir):
    return E.rank_schemas(_docs(spark, sf_dir), SCHEMAS, 2)


@query("j15_select_schema", """SELECT c_custkey AS doc_id, CASE WHEN c_nationkey = 3 AND c_mktsegment = 'MACHINERY' THEN 'bank:3:MACHINERY' WHEN c_nationkey < 9 THEN 'bank:' || c_nationkey WHEN c_mktsegment = 'HOUSEHOLD' THEN 'bank:HOUSEHOLD' ELSE 'bank' END AS schema,
    CASE WHEN c_nationkey = 3 AND c_mktsegment = 'MACHINERY' THEN 0 WHEN c_nationkey < 9 THEN 1 WHEN c_mktsegment = 'HOUSEHOLD' THEN 2 ELSE 3 END AS step FROM customer""")
def j15(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    detected = customers.select(F.col("c_custkey").alias("doc_id"), F.lit("bank").alias("type"), F.col("c_nationkey").cast("string").alias("country"), F.col("c_mktsegment").alias("entity"))
    countries = customers.select(F.concat(F.lit("bank:"), F.col("c_nationkey").cast("string")).alias("schema")).filter("length(schema) = 6 and schema < 'bank:9'")
    registry = spark.createDataFrame([("bank:3:MACHINERY",), ("bank:HOUSEHOLD",), ("bank",)], "schema string").unionByName(countries)
    return E.select_schema(detected, registry)


@query("o8_suggest_schema", f"""WITH {WORDS}, {SINGLE_SQL}, {RANKED}, h AS (SELECT doc_id, kind, count(*) AS hits FROM w JOIN t USING (word) GROUP BY 1, 2), z AS (SELECT kind, count(*) AS size FROM t GROUP BY 1),
    r AS (SELECT doc_id, kind, round(hits / size, 6) AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY round(hits / size, 6) DESC, kind) AS n FROM h JOIN z USING (kind))
    SELECT k.doc_id, CASE WHEN confidence > 0.7 THEN kind ELSE schema END AS schema, CASE WHEN confidence > 0.7 THEN 'detected' ELSE 'text' END AS origin FROM k LEFT JOIN (SELECT * FROM r WHERE n = 1) d USING (doc_id) WHERE rank = 1""")
def o8(spark, sf_dir):
    return E.suggest_schema(E.detect_document(_docs(spark, sf_dir), _terms(spark, SINGLE)), E.rank_schemas(_docs(spark, sf_dir), SCHEMAS, 1))


@query("j14_bank_info", "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'own' || c_nationkey ELSE CASE c_mktsegment WHEN 'MACHINERY' THEN 'general' END END AS code FROM customer WHERE c_nationkey >= 5 OR c_mktsegment = 'MACHINERY' OR true".replace("CASE WHEN c_nationkey < 5", "CASE WHEN c_nationkey < 5 AND c_mktsegment = 'MACHINERY'"))
def j14(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    own = customers.select(F.col("c_nationkey").alias("country")).distinct().filter("country < 5").select(F.lit("MACHINERY").alias("bank"), "country", F.concat(F.lit("own"), F.col("country").cast("string")).alias("code"))
    banks = own.unionByName(spark.createDataFrame([("MACHINERY", None, "general")], "bank string, country int, code string"))
    return E.bank_info(customers.select("c_custkey", F.col("c_mktsegment").alias("bank"), F.col("c_nationkey").alias("country")), banks).select("c_custkey", "code")


LINES = "l AS (SELECT doc_id, unnest(range(0, len(s))) AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))"


def _lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


@query("f23_extract_keys", rf"""WITH {LINES} SELECT doc_id, line_no, 'token' AS key_name, regexp_extract(line, 'token = "([0-9a-f]+)"', 1) AS value, round(least(0.8 * CASE WHEN starts_with(line, 'token') THEN 1.1 ELSE 1 END * 1.05, 1), 6) AS confidence FROM l WHERE regexp_matches(line, 'token = "([0-9a-f]+)"')
    UNION ALL SELECT doc_id, line_no, 'phone', regexp_extract(line, '\([0-9]{{3}}\) [0-9]{{3}}-[0-9]{{4}}'), round(0.6 * CASE WHEN regexp_matches(line, '^\([0-9]{{3}}\) [0-9]{{3}}-[0-9]{{4}}') THEN 1.1 ELSE 1 END, 6) FROM l WHERE regexp_matches(line, '\([0-9]{{3}}\) [0-9]{{3}}-[0-9]{{4}}')""")
def f23(spark, sf_dir):
    return E.extract_keys(_lines(spark, sf_dir), {"token": (r'token = "([0-9a-f]+)"', 0.8), "phone": (r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.6)})


@query("f29_name_line_score", rf"""WITH {LINES} SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^[\p{{L}} .,''\-/]+$') THEN 30 ELSE 0 END + CASE WHEN len(regexp_split_to_array(trim(line), '\s+')) BETWEEN 2 AND 5 THEN 20 ELSE 0 END + CASE WHEN upper(line) = line THEN 10 ELSE 0 END
    + CASE WHEN line_no < 5 THEN 20 WHEN line_no < 15 THEN 10 ELSE 0 END - CASE WHEN regexp_matches(line, '[0-9]') THEN 30 ELSE 0 END - CASE WHEN contains(line, ':') THEN 10 ELSE 0 END AS score FROM l""")
def f29(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", E.name_line_score(F.col("line"), F.col("line_no")).alias("score"))


@query("a31_pattern_report", """SELECT source AS entity, count(*) AS documents, round(count(*) FILTER (contains(text, 'token')) / count(*), 6) AS name_share, round(count(*) FILTER (contains(text, 'example.com')) / count(*), 6) AS url_share,
    CASE WHEN count(*) FILTER (contains(text, 'token')) = 0 AND count(*) FILTER (contains(text, 'example.com')) = 0 THEN 'none' WHEN count(*) FILTER (contains(text, 'token')) >= count(*) FILTER (contains(text, 'example.com')) THEN 'name' ELSE 'url' END AS recommended FROM documents GROUP BY 1""")
def a31(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("entity"), "text")
    return E.pattern_report(docs.select("doc_id", "entity"), docs.filter(F.col("text").contains("token")), docs.filter(F.col("text").contains("example.com")))


@query("s11_pages_to_articles")
def s11(spark, sf_dir):
    """A parser of pages is not in SQL; tested on fixtures."""
    return E.pages_to_articles(table(spark, sf_dir, "pages"))


@query("a30_entities_to_record", """WITH e AS (SELECT l_orderkey AS doc_id, ['name', 'email', 'skill', 'location'][1 + l_linenumber % 4] AS kind, 'v' || l_partkey AS value, l_tax AS confidence, l_linenumber AS position FROM lineitem),
    m AS (SELECT doc_id, arg_min(value, (position, value)) FILTER (kind = 'name') AS name, arg_max(value, (confidence, value)) FILTER (kind = 'email') AS email, coalesce(array_to_string(list_sort(list(DISTINCT value) FILTER (kind = 'skill')), ','), '') AS skills,
          coalesce(array_to_string((list(value ORDER BY position, value) FILTER (kind = 'location'))[1:3], ','), '') AS places, round(avg(confidence), 6) AS confidence FROM e GROUP BY 1) SELECT * FROM m""")
def a30(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["name", "email", "skill", "location"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), kind.alias("kind"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("value"), F.col("l_tax").alias("confidence"), F.col("l_linenumber").alias("position"))
    return E.entities_to_record(found).withColumns({c: F.array_join(c, ",") for c in ("skills", "places")})


#: Lines of documents as blocks of pages of forty.
BLOCKS = f"{LINES}, b AS (SELECT doc_id * 100000 + line_no // 40 AS doc_id, line_no % 40 AS block_id, line AS text, (line_no * 37 % 60) / 100 AS x1, (line_no % 40) * 25 / 1000 AS y1, (line_no * 37 % 60 + 30) / 100 AS x2, ((line_no % 40) * 25 + 20) / 1000 AS y2 FROM l)"
PAIRS = BLOCKS + ", p AS (SELECT k.doc_id, k.block_id AS k_id, k.x1 AS kx1, k.y1 AS ky1, k.x2 AS kx2, k.y2 AS ky2, v.block_id AS v_id, v.text AS v_text, v.x1 AS vx1, v.y1 AS vy1, v.x2 AS vx2, v.y2 AS vy2, (v.x1 + v.x2) / 2 - (k.x1 + k.x2) / 2 AS dx, (v.y1 + v.y2) / 2 - (k.y1 + k.y2) / 2 AS dy FROM b k JOIN b v ON k.doc_id = v.doc_id AND k.block_id <> v.block_id AND k.block_id % 8 = 3)"


def _blocks(spark, sf_dir):
    n = F.col("line_no")
    return _lines(spark, sf_dir).select(
        (F.col("doc_id") * 100000 + F.expr("line_no div 40")).alias("doc_id"), (n % 40).alias("block_id"), F.col("line").alias("text"),
        ((n * 37 % 60) / 100).alias("x1"), ((n % 40) * 25 / 1000).alias("y1"), ((n * 37 % 60 + 30) / 100).alias("x2"), (((n % 40) * 25 + 20) / 1000).alias("y2"),
    )


def _keyed(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return blocks.filter("block_id % 8 = 3"), blocks


NEAR = "CASE WHEN sqrt(dx * dx + dy * dy) > 0.3 THEN 0.1 ELSE 1 - sqrt(dx * dx + dy * dy) / 0.3 END"


@query("l1_spatial_pairs", f"""WITH {PAIRS}, s AS (SELECT *, CASE WHEN abs(dy) < 0.05 AND dx > 0 THEN 'right' WHEN abs(dy) < 0.05 THEN 'left' WHEN abs(dx) < 0.1 AND dy > 0 THEN 'below' WHEN abs(dx) < 0.1 THEN 'above' ELSE 'diagonal' END AS relation FROM p),
    c AS (SELECT *, round(({NEAR}) * CASE relation WHEN 'right' THEN 1.0 WHEN 'left' THEN 0.8 WHEN 'below' THEN 0.95 WHEN 'above' THEN 0.7 ELSE 0.5 END, 6) AS confidence FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k_id ORDER BY confidence DESC, v_id) AS n FROM c WHERE confidence > 0.3) SELECT doc_id, k_id AS key_block, v_id AS value_block, relation, confidence FROM r WHERE n = 1""")
def l1(spark, sf_dir):
    return Y.spatial_pairs(*_keyed(spark, sf_dir))


@query("l2_nearby_value", f"""WITH {PAIRS}, s AS (SELECT *, round(CASE WHEN regexp_matches(v_text, '[0-9]') THEN 1.0 ELSE 0.5 END * 0.7 + (1 - sqrt(dx * dx + dy * dy) / 0.2) * 0.3, 6) AS score FROM p WHERE sqrt(dx * dx + dy * dy) <= 0.2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k_id ORDER BY score DESC, v_id) AS n FROM s) SELECT doc_id, k_id AS key_block, v_id AS value_block, score FROM r WHERE n = 1""")
def l2(spark, sf_dir):
    return Y.nearby_value(*_keyed(spark, sf_dir))


@query("l3_block_below", f"WITH {PAIRS} SELECT doc_id, k_id AS key_block, arg_min(v_id, (vy1, vx1, v_id)) AS value_block FROM p WHERE vy1 >= ky2 AND vx1 < kx2 AND vx2 > kx1 GROUP BY 1, 2")
def l3(spark, sf_dir):
    return Y.block_below(*_keyed(spark, sf_dir))


@query("l3_block_right", f"WITH {PAIRS} SELECT doc_id, k_id AS key_block, arg_min(v_id, (round(vx1 - kx2 + 2 * abs(vy1 - ky1), 6), v_id)) AS value_block FROM p WHERE vx1 >= kx2 GROUP BY 1, 2")
def l3r(spark, sf_dir):
    return Y.block_right(*_keyed(spark, sf_dir))


@query("l4_label_value", f"""WITH {PAIRS}, t AS (SELECT *, CASE WHEN vy1 < ky2 AND vy2 > ky1 AND vx1 >= kx2 THEN 0 WHEN vy1 >= ky2 AND vy1 - ky2 <= 0.06 THEN 1 END AS tier FROM p WHERE regexp_matches(v_text, '[aeiou]'))
    SELECT doc_id, k_id AS key_block, arg_min(v_id, (tier, CASE WHEN tier = 0 THEN vx1 ELSE vy1 END, vx1, v_id)) AS value_block FROM t WHERE tier IS NOT NULL GROUP BY 1, 2""")
def l4(spark, sf_dir):
    return Y.label_value(*_keyed(spark, sf_dir), "[aeiou]")


@query("l5_nearest_in_height", f"WITH {PAIRS} SELECT doc_id, k_id AS key_block, arg_min(v_id, (round(abs(vy1 - ky1), 6), v_id)) AS value_block FROM p GROUP BY 1, 2")
def l5(spark, sf_dir):
    return Y.nearest_in_height(*_keyed(spark, sf_dir))


@query("l6_classify_addresses", f"""WITH {PAIRS}, d AS (SELECT doc_id, k_id, round(min(sqrt(dx * dx + dy * dy)) FILTER (v_id % 10 = 1), 6) AS h, round(min(sqrt(dx * dx + dy * dy)) FILTER (v_id % 10 = 6), 6) AS k FROM p GROUP BY 1, 2)
    SELECT b.doc_id, block_id, CASE WHEN coalesce(k < h, k IS NOT NULL AND h IS NULL) THEN 'bank' ELSE 'holder' END AS owner FROM b LEFT JOIN d ON d.doc_id = b.doc_id AND k_id = block_id WHERE block_id % 8 = 3""")
def l6(spark, sf_dir):
    keys, blocks = _keyed(spark, sf_dir)
    return Y.classify_addresses(keys, blocks.filter("block_id % 10 = 1"), blocks.filter("block_id % 10 = 6"))


@query("l7_assemble_lines", f"WITH {BLOCKS} SELECT doc_id, round(y1, 1) AS y, string_agg(text, ' ' ORDER BY x1, block_id, text) AS line FROM b GROUP BY 1, 2")
def l7(spark, sf_dir):
    return Y.assemble_lines(_blocks(spark, sf_dir))


@query("l8_block_type", rf"""WITH {BLOCKS} SELECT doc_id, block_id, CASE WHEN y1 < 0.25 THEN 'header' WHEN y1 > 0.8 THEN 'footer' ELSE 'body' END AS zone,
    CASE WHEN contains(lower(text), 'bank') THEN 'bank' WHEN regexp_matches(lower(text), 'account|[0-9]{{8,15}}') THEN 'account' WHEN regexp_matches(lower(text), 'street|road|avenue|(^|[^0-9a-z_])[0-9]{{5,6}}($|[^0-9a-z_])') THEN 'address' WHEN regexp_matches(text, '^[\p{{L}} .''-]+$') THEN 'name'
         WHEN regexp_matches(lower(text), 'statement|summary|consolidated|as at|period') THEN 'info' WHEN regexp_matches(text, '[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{2,4}}') THEN 'date' WHEN regexp_matches(lower(text), 'balance|[0-9]+\.[0-9]{{2}}($|[^0-9a-z_])') THEN 'balance' ELSE 'unknown' END AS block_type FROM b""")
def l8(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "block_id", Y.zone(F.col("y1")).alias("zone"), Y.block_type(F.col("text")).alias("block_type"))


@query("l9_expand_address", f"""WITH {BLOCKS}, m AS (SELECT *, CAST(contains(lower(text), 'token') OR contains(lower(text), 'zz') AS INTEGER) AS stop FROM b), i AS (SELECT *, sum(stop) OVER (PARTITION BY doc_id ORDER BY y1, x1, block_id) AS island FROM m),
    k AS (SELECT *, bool_or(contains(lower(text), 'wh') AND x1 < 0.5) OVER w AS l, bool_or(contains(lower(text), 'wh') AND x1 >= 0.5) OVER w AS r FROM i WHERE stop = 0 WINDOW w AS (PARTITION BY doc_id, island)),
    s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island, text ORDER BY y1, x1, block_id) AS n FROM k WHERE (l OR r) AND (x1 < 0.5 OR NOT (l AND r))) SELECT doc_id, block_id, island FROM s WHERE n = 1""")
def l9(spark, sf_dir):
    return Y.expand_address(_blocks(spark, sf_dir), ["wh"], ["token", "zz"])


@query("l10_marker_box", f"WITH {BLOCKS} SELECT doc_id, greatest(min(x1) - 0.1, 0) AS x1, greatest(min(y1) - 0.1, 0) AS y1, max(x2) + 0.1 AS x2, max(y2) + 0.1 AS y2 FROM b WHERE contains(text, 'token') GROUP BY 1")
def l10(spark, sf_dir):
    return Y.marker_box(_blocks(spark, sf_dir), "token", 0.1)


@query("l11_pair_labels", f"WITH {PAIRS}, r AS (SELECT *, round(sqrt(dx * dx + dy * dy), 6) AS distance FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k_id ORDER BY distance, v_id) AS n FROM r WHERE distance < 0.15) SELECT doc_id, k_id AS key_block, v_id AS value_block, distance FROM n WHERE n = 1")
def l11(spark, sf_dir):
    return Y.pair_labels(*_keyed(spark, sf_dir))


GROUPS = BLOCKS + """, f AS (SELECT *, y1 - lag(y1) OVER w > 0.04 OR abs(x1 - lag(x1) OVER w) > {} AS far FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY y1, x1, block_id)), g AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y1, x1, block_id) AS "group" FROM f)"""


@query("w6_layout_blocks", f"WITH {GROUPS.format('0.3')} SELECT doc_id, \"group\", count(*) AS boxes, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM g GROUP BY 1, 2")
def w6(spark, sf_dir):
    return Y.layout_blocks(_blocks(spark, sf_dir))


@query("w7_merge_lines", f"WITH {GROUPS.format('0.25')} SELECT doc_id, \"group\", string_agg(text, ', ' ORDER BY y1, x1, block_id) AS text FROM g GROUP BY 1, 2")
def w7(spark, sf_dir):
    return Y.merge_lines(_blocks(spark, sf_dir), dx=0.25)


@query("a28_line_spacing", f"WITH {BLOCKS} SELECT doc_id, round(median(y2 - y1), 6) AS spacing FROM b GROUP BY 1")
def a28(spark, sf_dir):
    return Y.line_spacing(_blocks(spark, sf_dir)).withColumn("spacing", F.round("spacing", 6))


@query("j21_field_confidence", f"""WITH {BLOCKS}, f AS (SELECT doc_id, 'first' AS field, text AS value FROM b WHERE block_id = 0 UNION ALL SELECT doc_id, 'none', 'zzzzzz' FROM b WHERE block_id = 0),
    s AS (SELECT f.doc_id, f.field, lower(trim(value)) AS v, lower(trim(text)) AS t, 50 + block_id AS c FROM f JOIN b USING (doc_id))
    SELECT doc_id, field, round(coalesce(max(CASE WHEN v = t THEN c END), max(CASE WHEN contains(t, v) AND length(t) > 0 AND length(v) / length(t) > 0.7 THEN c * length(v) / length(t) END), 85), 4) AS confidence FROM s GROUP BY 1, 2""")
def j21(spark, sf_dir):
    blocks = _blocks(spark, sf_dir).withColumn("confidence", (F.col("block_id") + 50).cast("double"))
    first = blocks.filter("block_id = 0")
    fields = first.select("doc_id", F.lit("first").alias("field"), F.col("text").alias("value")).unionByName(first.select("doc_id", F.lit("none").alias("field"), F.lit("zzzzzz").alias("value")))
    return Y.field_confidence(fields, blocks)
