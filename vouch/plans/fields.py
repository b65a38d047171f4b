"""Queries of the field operators over the given tables, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouch.functions.names import name_similarity, token_overlap
from vouch.operators import fields as D, risk, verify as V
from vouch.plans import screening, tables
from vouch.plans.tables import table

Q, O = {}, {}
CURRENCIES = {"OUR": ["the"], "THR": ["que"], "AND": ["und"]}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return add


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("f5_name_similarity")
def f5(spark, sf_dir):
    """Rests on Jaro-Winkler; tested by brute force."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(name_similarity(F.col("p_name"), F.col("p_type")), 4).alias("similarity"))


@query("f18_bank_from_iban", "SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 'bank ' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') END AS bank FROM customer")
def f18(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    code = F.lpad(F.col("c_nationkey").cast("string"), 4, "0")
    banks = customers.filter("c_nationkey < 10").select(code.alias("code")).distinct().withColumn("bank", F.concat(F.lit("bank "), F.col("code")))
    return D.bank_from_iban(customers.select("c_custkey", F.concat(F.lit("GB82"), code, F.lpad(F.col("c_custkey").cast("string"), 14, "0")).alias("iban")), banks).select("c_custkey", "bank")


_word = lambda w, i="": f"regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])'{i})"


@query("f19_find_currency", "SELECT doc_id, CASE " + " ".join(f"WHEN {_word(c)} OR {_word(n[0], chr(44) + chr(39) + 'i' + chr(39))} THEN '{c}'" for c, n in CURRENCIES.items()) + " END AS currency FROM documents")
def f19(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", D.find_currency(F.col("text"), CURRENCIES).alias("currency"))


@query("f20_country_in_text", r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS term FROM documents), t(term, country, tier) AS (VALUES ('the', 'uk', 2), ('of', 'us', 2), ('le', 'france', 1), ('von', 'germany', 1), ('para', 'spain', 0), ('est', 'france', 0))
    SELECT doc_id, arg_min(country, (tier, -length(term), term, country)) AS country FROM w JOIN t USING (term) GROUP BY 1""")
def f20(spark, sf_dir):
    places = spark.createDataFrame([("the", "uk", 2), ("of", "us", 2), ("le", "france", 1), ("von", "germany", 1), ("para", "spain", 0), ("est", "france", 0)], "term string, country string, tier int")
    return D.country_in_text(_docs(spark, sf_dir), places)


@query("f25_normalize_address", r"""SELECT doc_id, array_to_string(list_transform(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda w: CASE regexp_replace(w, '\.$', '') WHEN 'st' THEN 'street' WHEN 'the' THEN 'THE' ELSE w END), ' ') AS address FROM documents""")
def f25(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", D.normalize_address(F.col("text"), {"st": "street", "the": "THE"}).alias("address"))


@query("f25_is_garbled", r"WITH l AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, regexp_matches(t, '@@@@') OR length(regexp_replace(t, '[^\p{L}\p{N} ]', '', 'g')) < length(t) / 2 AS garbled FROM l".replace("regexp_matches(t, '@@@@')", "(" + " OR ".join(f"contains(t, '{c * 4}')" for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ!?.,#$%&*-_=+:;éèêçàñóíúáüöäß ÉÈÊÇÀÑÓÍÚÁÜÖÄ") + ")"))
def f25g(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", D.is_garbled(F.col("text")).alias("garbled"))


@query("f27_address_missing", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN CASE WHEN c_acctbal < 0 THEN 'city' ELSE '' END ELSE CASE WHEN c_acctbal < 0 THEN 'city,postal' ELSE 'postal' END END AS missing FROM customer")
def f27(spark, sf_dir):
    parts = F.create_map(F.lit("street"), F.col("c_name"), F.lit("city"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), F.lit("postal"), F.lit(" "))
    missing = D.address_missing(parts, F.col("c_nationkey").cast("string"), {"*": ["street", "city", "postal"], "3": ["street", "city"]})
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(missing, ",").alias("missing"))


@query("f28_recognisers", "SELECT c_custkey, c_custkey >= 10000 AS passport, c_nationkey % 2 = 0 AS code, c_nationkey % 3 = 0 AS sex FROM customer")
def f28(spark, sf_dir):
    number, code = F.concat(F.lit("K"), F.col("c_custkey").cast("string")), F.when(F.col("c_nationkey") % 2 == 0, "GBR").otherwise("gb")
    sex = F.when(F.col("c_nationkey") % 3 == 0, " f").otherwise("q")
    return table(spark, sf_dir, "customer").select("c_custkey", D.is_passport_number(number).alias("passport"), D.is_country_code(code).alias("code"), D.is_sex(sex).alias("sex"))


@query("f36_verification_verdict", "SELECT l_orderkey, l_linenumber, l_quantity * 2 >= 80 AND coalesce(l_quantity + 50, 0) >= 70 AND 20 + l_linenumber >= 21 AND l_tax <= 0.05 AS passed FROM lineitem")
def f36(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q * 2).alias("name_score"), (q + 50).alias("face_score"), (q + 50).alias("document_score"), F.lit(80.0).alias("address_score"), F.when(F.col("l_tax") <= 0.05, 100.0).alias("otp_score"), (F.col("l_linenumber") + 20).alias("age"))
    return V.verification_verdict(rows).select("l_orderkey", "l_linenumber", "passed")


@query("f38_text_match")
def f38(spark, sf_dir):
    """Rests on matching blocks; tested by brute force."""
    return table(spark, sf_dir, "part").select("p_partkey", D.text_match(F.col("p_name"), F.lit("widgat")).alias("match"))


@query("f39_parse_address", "SELECT c_custkey, CAST(c_custkey % 900 + 1 AS VARCHAR) AS number, lpad(CAST(c_custkey % 90000 AS VARCHAR), 5, '1') AS postal, 'Low Road, ' || c_mktsegment AS rest FROM customer")
def f39(spark, sf_dir):
    k = F.col("c_custkey")
    given = F.concat_ws(", ", F.concat((k % 900 + 1).cast("string"), F.lit(" Low Road")), F.lpad((k % 90000).cast("string"), 5, "1"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", D.parse_address(given).alias("a")).select("c_custkey", "a.*")


@query("f40_label_match")
def f40(spark, sf_dir):
    """Rests on matching blocks; tested by brute force."""
    return table(spark, sf_dir, "part").select("p_partkey", D.label_match(F.col("p_name"), F.lit("gidget")).alias("alike"))


@query("j6_true_matches")
def j6(spark, sf_dir):
    """Rests on Jaro-Winkler; tested by brute force."""
    results = screening._sanctions(spark, sf_dir).join(tables.watch(spark, sf_dir).select("entry_id", F.col("name").alias("matched_name")), "entry_id")
    status = F.when(F.col("entry_id") % 3 == 0, "NOT_MATCHED").otherwise("MATCHED")
    results = results.select("subject_id", F.col("entry_id").alias("result_id"), F.col("name_score").alias("strength"), "matched_name", F.array(F.struct(F.lit("dob").alias("field"), status.alias("status"))).alias("secondary"))
    return D.true_matches(results, tables.subjects(spark, sf_dir), 0.5, 0.6)


@query("j7_attach_face", """WITH m AS (SELECT url, page_id / 1000 AS similarity, 1 AS arrival FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 0.5, 2 FROM pages WHERE page_id % 2 = 0),
    f AS (SELECT url, arg_min(similarity, (arrival, similarity)) AS face_similarity FROM m GROUP BY url)
    SELECT page_id, pages.url, face_similarity FROM pages LEFT JOIN f ON f.url = pages.url""")
def j7(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = pages.filter("page_id % 2 = 0")
    matches = found.select("url", (F.col("page_id") / 1000).alias("similarity"), F.lit(1).alias("arrival")).unionByName(found.select("url", F.lit(0.5).alias("similarity"), F.lit(2).alias("arrival")))
    return D.attach_face(pages, matches)


@query("a6_risk_breakdown", screening.FROM_ALL + """, m AS (SELECT subject_id, string_agg(entry_id, ',' ORDER BY rank) AS matches FROM sranked WHERE rank <= 3 GROUP BY 1)
    SELECT subject_id, 'sanctions' AS "check", round(sanctions_risk, 2) AS score, sanctions_confidence >= 0.65 AS failed, matches FROM scores LEFT JOIN m USING (subject_id)
    UNION ALL SELECT subject_id, 'pep', round(pep_risk, 2), pep_confidence >= 0.65, NULL FROM scores UNION ALL SELECT subject_id, 'news', round(news_risk, 2), news_risk >= 50, NULL FROM scores""")
def a6(spark, sf_dir):
    scores = risk.component_scores(screening._screened(spark, sf_dir))
    return D.risk_breakdown(scores, screening._sanctions(spark, sf_dir)).withColumn("matches", F.array_join(F.col("matches").cast("array<string>"), ","))


@query("a23_registry_stats", "SELECT p_brand AS type, count(*) AS schemas, count(DISTINCT p_type) AS countries, round(avg(p_size), 4) AS fields FROM part GROUP BY 1")
def a23(spark, sf_dir):
    return D.registry_stats(table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.col("p_type").alias("country"), F.col("p_size").alias("fields")))


@query("o6_schemas_for", "SELECT p_partkey AS schema, row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_brand = 'Brand#2'")
def o6(spark, sf_dir):
    registry = table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.col("p_partkey").alias("schema"), F.col("p_size").alias("specificity"), F.col("p_retailprice").alias("priority"))
    return D.schemas_for(registry, "Brand#2").select("schema", "rank")


@query("o7_prioritize_required", "SELECT l_orderkey AS doc_id, l_linenumber AS field, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax > 0.04 DESC, l_quantity DESC, l_linenumber) AS rank FROM (SELECT l_orderkey, l_linenumber, max(l_tax) AS l_tax, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)")
def o7(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("field")).agg(F.max("l_tax").alias("t"), F.max("l_quantity").alias("confidence"))
    return D.prioritize_required(lines.withColumn("required", F.col("t") > 0.04)).select("doc_id", "field", "rank")


@query("w10_dedupe_fields", "SELECT doc_id, field, value, confidence FROM (SELECT l_orderkey AS doc_id, l_returnflag AS field, l_partkey AS value, l_quantity AS confidence, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC, l_partkey) AS n FROM lineitem) WHERE n = 1")
def w10(spark, sf_dir):
    return V.dedupe_fields(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("field"), F.col("l_partkey").alias("value"), F.col("l_quantity").alias("confidence")))


@query("a33_validate_statement", """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'account_masked,' ELSE '' END || CASE WHEN c_acctbal < 0 THEN 'address_city,' ELSE '' END || CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'bank_unknown,' ELSE '' END || CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE 'statement_old,' END AS errors FROM customer""")
def a33(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.when(k % 2 == 0, "XXXX1234").otherwise("1234567890").alias("account"), F.col("c_mktsegment").alias("bank"), F.when(F.col("c_acctbal") >= 0, "x").alias("city"), (F.col("c_nationkey") % 3 == 0).alias("fresh"))
    found = D.validate_statement(rows, 8, 12, spark.createDataFrame([("MACHINERY",)], "bank string"), F.col("fresh"), ["city"])
    return found.select("doc_id", F.concat_ws("", F.transform("errors", lambda e: F.concat(e, F.lit(",")))).alias("errors"))


@query("u3_missing_fields", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'b' ELSE 'b,c' END AS missing FROM orders")
def u3(spark, sf_dir):
    found = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(V.missing_fields(F.array(F.lit("c"), F.lit("b"), F.lit("a")), found), ",").alias("missing"))


@query("u5_token_overlap", "WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS b FROM part) SELECT p_partkey, len(list_intersect(a, b)) AS both, len(a) + len(b) - len(list_intersect(a, b)) AS either FROM p")
def u5(spark, sf_dir):
    a, b = F.array_distinct(F.split("p_name", " ")), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))
    both, either = token_overlap(a, b)
    return table(spark, sf_dir, "part").select("p_partkey", both.alias("both"), either.alias("either"))


@query("u6_contains_all", "SELECT p_partkey, contains(' ' || p_name || ' ', ' red ') AND contains(' ' || p_name || ' ', ' widget ') AS both FROM part")
def u6(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", V.contains_all(F.array(F.lit("Red"), F.lit("widget ")), F.split("p_name", " ")).alias("both"))


@query("v9_fit_confidence")
def v9(spark, sf_dir):
    """The fit's coefficients and ranges as one row; tested for order and range."""
    from vouch.operators.vectors import fit_confidence
    from vouch.plans.evaluation import _distance_counts

    return fit_confidence(_distance_counts(spark, sf_dir))
