"""Queries of the rules for statements over columns derived from the given tables, with SQL that works the rules out again."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from vouch.functions import text as X
from vouch.operators import fields as D, statements as S
from vouch.plans.tables import table

Q, O = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return add


_norm = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
_item = lambda x: f"list_transform(json_extract({x}, '$[*]'), lambda i: CASE WHEN json_type(i) = 'VARCHAR' THEN 't:' || {_norm('(i->>' + chr(39) + '$' + chr(39) + ')')} ELSE 'v:' || CAST(i AS VARCHAR) END)"


@query("f6_values_agree", f"""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN to_json(o_orderpriority) WHEN 1 THEN to_json(o_custkey) WHEN 2 THEN json_array(o_orderstatus, o_orderpriority, o_custkey) WHEN 3 THEN CASE WHEN o_custkey % 2 = 0 THEN to_json(o_orderstatus) END
        WHEN 4 THEN to_json(o_orderpriority) ELSE json_array(o_custkey % 3, o_orderstatus) END AS e,
    CASE o_orderkey % 6 WHEN 0 THEN to_json('  ' || upper(replace(o_orderpriority, ' ', '   ')) || ' ') WHEN 1 THEN to_json(CAST(o_custkey + CAST(o_custkey % 3 = 0 AS INTEGER) AS VARCHAR)) WHEN 2 THEN json_array(o_custkey, lower(o_orderpriority), 'x', CASE WHEN o_custkey % 4 <> 0 THEN o_orderstatus END)
        WHEN 3 THEN CASE WHEN o_custkey % 3 = 0 THEN to_json(o_orderstatus) END WHEN 4 THEN to_json(replace(o_orderpriority, '-', '')) ELSE json_array(o_custkey % 2, upper(o_orderstatus), CAST(o_custkey % 3 AS VARCHAR)) END AS f FROM orders)
    SELECT o_orderkey, coalesce(CASE WHEN e IS NULL THEN f IS NULL WHEN f IS NULL THEN false WHEN json_type(e) = 'ARRAY' AND json_type(f) = 'ARRAY' THEN list_has_all({_item('f')}, {_item('e')}) ELSE {_norm("(e->>'$')")} = {_norm("(f->>'$')")} END, false) AS agrees FROM v""")
def f6(spark, sf_dir):
    k, c, s, p = (F.col(f"o_{n}") for n in ("orderkey", "custkey", "orderstatus", "orderpriority"))
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    many = lambda *xs: F.concat(F.lit("["), F.concat_ws(",", *xs), F.lit("]"))
    number = lambda x: x.cast("string")
    by = lambda *xs: F.when(k % 6 == 0, xs[0]).when(k % 6 == 1, xs[1]).when(k % 6 == 2, xs[2]).when(k % 6 == 3, xs[3]).when(k % 6 == 4, xs[4]).otherwise(xs[5])
    expected = by(text(p), number(c), many(text(s), text(p), number(c)), F.when(c % 2 == 0, text(s)), text(p), many(number(c % 3), text(s)))
    found = by(
        text(F.concat(F.lit("  "), F.upper(F.replace(p, F.lit(" "), F.lit("   "))), F.lit(" "))), text(number(c + (c % 3 == 0).cast("int"))), many(number(c), text(F.lower(p)), F.lit('"x"'), F.when(c % 4 != 0, text(s)).otherwise("null")),
        F.when(c % 3 == 0, text(s)), text(F.replace(p, F.lit("-"), F.lit(""))), many(number(c % 2), text(F.upper(s)), text(number(c % 3))),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", S.values_agree(expected, found).alias("agrees"))


@query("f17_account_values", """WITH t AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Account No. ' || (1000000000 + c_custkey) WHEN 1 THEN '12-3456-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') WHEN 2 THEN 'Acct # 12' WHEN 3 THEN 'ref x12 ' || (100000 + c_custkey) WHEN 4 THEN c_name
        WHEN 5 THEN CAST(c_custkey AS VARCHAR) || '-34' ELSE lpad(CAST(c_custkey AS VARCHAR), 16, '7') END AS t FROM customer),
    j AS (SELECT *, replace(replace(t, '-', ''), ' ', '') AS j, lower(trim(t)) AS low FROM t)
    SELECT c_custkey, CASE WHEN regexp_full_match(j, '[0-9]{8,15}') THEN j END AS account, NOT (contains(low, 'account no') OR contains(low, 'account number') OR contains(low, 'acct no') OR contains(low, 'acct number') OR contains(low, 'account #') OR contains(low, 'acct #') OR contains(low, 'number'))
        AND (regexp_full_match(j, '[0-9]{8,15}') OR length(regexp_replace(t, '[^0-9]', '', 'g')) >= 6) AS valid FROM j""")
def f17(spark, sf_dir):
    k = F.col("c_custkey")
    t = (
        F.when(k % 7 == 0, F.concat(F.lit("Account No. "), (k + 1_000_000_000).cast("string"))).when(k % 7 == 1, F.concat(F.lit("12-3456-"), F.lpad(k.cast("string"), 6, "0"))).when(k % 7 == 2, "Acct # 12")
        .when(k % 7 == 3, F.concat(F.lit("ref x12 "), (k + 100_000).cast("string"))).when(k % 7 == 4, F.col("c_name")).when(k % 7 == 5, F.concat(k.cast("string"), F.lit("-34"))).otherwise(F.lpad(k.cast("string"), 16, "7"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", S.account_number(t).alias("account"), S.is_account(t).alias("valid"))


_list = lambda xs: ", ".join("'" + x + "'" for x in xs)


@query("f29_holder_names", rf"""WITH t AS (SELECT c_custkey // 6 AS doc_id, c_custkey % 6 AS line_no, CASE c_custkey % 9 WHEN 0 THEN 'Ravi S/O ' || c_mktsegment WHEN 1 THEN c_mktsegment || ' Trading Sdn Bhd' WHEN 2 THEN 'Statement period ' || c_mktsegment WHEN 3 THEN c_name WHEN 4 THEN 'Jane ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:])
        WHEN 5 THEN c_mktsegment || ' HOLDINGS' WHEN 6 THEN lower(c_mktsegment) || ' and others of this place' WHEN 7 THEN c_mktsegment ELSE 'Total: ' || c_mktsegment END AS t, c_custkey % 4 / 4 AS x, c_custkey % 11 / 11 AS y FROM customer),
    w AS (SELECT *, lower(t) AS low, len(regexp_split_to_array(t, '\s+')) AS n, upper(t) = t AND lower(t) <> t AS caps FROM t),
    s AS (SELECT doc_id, line_no, CASE WHEN low IN ({_list(S.STATEMENT_LABELS)}) OR regexp_matches(low, '^({"|".join(S.STATEMENT_LABELS)})[: ]') OR n < 2 OR regexp_matches(t, '[0-9]') THEN 0 ELSE
        CASE WHEN y < 0.5 THEN 10 ELSE 0 END + CASE WHEN y < 0.2 AND x < 0.5 THEN 15 ELSE 0 END + CASE WHEN y > 0.1 AND y < 0.2 THEN 15 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)\s(S/O|D/O|A/L)\.?\s') THEN 40 ELSE 0 END
        + CASE WHEN n BETWEEN 2 AND 3 AND NOT caps AND regexp_matches(t, '^[^\p{{L}}]*(\p{{Lu}}\p{{Ll}}*[^\p{{L}}]+)*(\p{{Lu}}\p{{Ll}}*)?$') THEN 25 ELSE 0 END + CASE WHEN n <= 4 AND caps THEN 10 ELSE 0 END
        + CASE WHEN len(list_filter([{_list(S.ENTITY_SUFFIXES)}], lambda e: ends_with(upper(t), e))) > 0 THEN 30 ELSE 0 END + CASE WHEN regexp_full_match(t, '[\p{{L}}\p{{N}}\s/\-.&'']*') THEN 15 ELSE 0 END END AS score FROM w)
    SELECT doc_id, line_no, CAST(score AS INTEGER) AS score, score >= 30 AS likely, score >= 30 AND row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) = 1 AS best FROM s""")
def f29(spark, sf_dir):
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    line = (
        F.when(k % 9 == 0, F.concat(F.lit("Ravi S/O "), m)).when(k % 9 == 1, F.concat(m, F.lit(" Trading Sdn Bhd"))).when(k % 9 == 2, F.concat(F.lit("Statement period "), m)).when(k % 9 == 3, F.col("c_name")).when(k % 9 == 4, F.concat(F.lit("Jane "), F.initcap(m)))
        .when(k % 9 == 5, F.concat(m, F.lit(" HOLDINGS"))).when(k % 9 == 6, F.concat(F.lower(m), F.lit(" and others of this place"))).when(k % 9 == 7, m).otherwise(F.concat(F.lit("Total: "), m))
    )
    lines = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 6").alias("doc_id"), (k % 6).alias("line_no"), line.alias("line"), (k % 4 / 4).alias("left"), (k % 11 / 11).alias("middle"))
    return S.holder_names(lines).select("doc_id", "line_no", "score", "likely", "best")


@query("j15_schema_confidence", """WITH d AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 17 <> 0 THEN CASE WHEN c_custkey % 13 = 0 THEN 'visa' ELSE 'bank' END END AS type, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS country, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS entity, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 100 / 100 END AS confidence FROM customer),
    n AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS m FROM customer),
    r AS (SELECT DISTINCT 'bank:' || k || ':' || m AS schema, CAST(k AS VARCHAR) AS country, m AS entity, k AS priority, m <> 'BUILDING' AS enabled FROM n WHERE k < 4 UNION SELECT 'bank:' || k, CAST(k AS VARCHAR), NULL, 10, k <> 5 FROM n WHERE k < 9 UNION SELECT 'bank:__entity__:' || m, NULL, lower(m), 40, true FROM n WHERE m = 'HOUSEHOLD' UNION SELECT 'bank', NULL, NULL, 0, true),
    c AS (SELECT doc_id, 0 AS step, 'exact_match' AS method, type || ':' || country || ':' || entity AS schema FROM d UNION ALL SELECT doc_id, 1, 'country_match', type || ':' || country FROM d UNION ALL SELECT doc_id, 2, 'entity_match', type || ':__entity__:' || entity FROM d UNION ALL SELECT doc_id, 3, 'generic', type FROM d),
    b AS (SELECT c.doc_id, step, method, r.*, row_number() OVER (PARTITION BY c.doc_id ORDER BY step) AS nth FROM c JOIN r ON r.schema = c.schema WHERE enabled),
    s AS (SELECT d.*, b.schema, method, priority, 0.5::DOUBLE + CASE WHEN lower(b.entity) = lower(d.entity) THEN 0.3 ELSE 0 END + CASE WHEN lower(b.country) = lower(d.country) THEN 0.2 ELSE 0 END AS sure FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND nth = 1)
    SELECT doc_id, schema, coalesce(method, CASE WHEN type IS NULL THEN 'no_type' ELSE 'none' END) AS method, CASE WHEN schema IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0.0, least(1.0, CASE WHEN confidence IS NULL THEN sure ELSE sure * 0.6 + confidence * 0.4 END + least(priority / 200, 0.1::DOUBLE))), 6) END AS confidence FROM s""")
def j15(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    k, n, m = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    kind = F.when(k % 17 != 0, F.when(k % 13 == 0, "visa").otherwise("bank"))
    detected = customers.select(k.alias("doc_id"), kind.alias("type"), F.when(k % 5 != 0, n.cast("string")).alias("country"), F.when(k % 3 != 0, m).alias("entity"), F.when(k % 2 == 0, k % 100 / 100).alias("confidence"))
    pairs, none = customers.select("c_nationkey", "c_mktsegment").distinct(), F.lit(None).cast("string")
    row = lambda df, schema, country, entity, priority, enabled: df.select(schema.alias("schema"), country.alias("country"), entity.alias("entity"), priority.alias("priority"), enabled.alias("enabled")).distinct()
    registry = row(pairs.filter("c_nationkey < 4"), F.concat_ws(":", F.lit("bank"), n.cast("string"), m), n.cast("string"), m, n.cast("int"), m != "BUILDING")
    registry = registry.unionByName(row(pairs.filter("c_nationkey < 9"), F.concat_ws(":", F.lit("bank"), n.cast("string")), n.cast("string"), none, F.lit(10), n != 5))
    registry = registry.unionByName(row(pairs.filter("c_mktsegment = 'HOUSEHOLD'"), F.concat(F.lit("bank:__entity__:"), m), none, F.lower(m), F.lit(40), F.lit(True)))
    registry = registry.unionByName(row(pairs, F.lit("bank"), none, none, F.lit(0), F.lit(True)))
    return S.select_schema(detected, registry)


LINES = "l AS (SELECT doc_id, i AS line_no, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"
#: A word, with letters of any alphabet as its bounds.
LES = r"(?:^|[^\p{L}])les(?:[^\p{L}]|$)"
_value = lambda name, pattern, good, group, fits: f"SELECT doc_id, line_no, '{name}' AS key_name, CASE WHEN {good} THEN {group} ELSE nullif(after, '') END AS value, CASE WHEN {good} THEN 0.9 WHEN {fits} THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence FROM (SELECT *, trim(regexp_replace(line, '^.*?(?:{pattern})', '', 's')) AS after FROM l WHERE regexp_matches(line, '{pattern}')) WHERE {good} OR after <> ''"


@query("f23_key_values", rf"""WITH {LINES}
    {_value('token', 'token = "([0-9a-f]+)"', "regexp_matches(regexp_extract(line, 'token = \"([0-9a-f]+)\"', 1), '^[0-9a-f]{20}')", "regexp_extract(line, 'token = \"([0-9a-f]+)\"', 1)", "regexp_matches(after, '^[0-9a-f]{20}')")}
    UNION ALL {_value('article', LES, 'false', "''", "regexp_matches(after, '^[a-z]+ [a-z]+ ')")}""")
def f23(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")
    return S.key_values(lines, {"token": S.Key('token = "([0-9a-f]+)"', 1, "[0-9a-f]{20}"), "article": S.Key(LES, 0, "[a-z]+ [a-z]+ ")})


PATTERNS = {"SG": [r"\bS\s?\d{6}\b", r"\b\d{6}\b"], "UK": [r"\b[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b"], "MY": [r"\b\d{5}\b"]}
OPTIONAL, UNITS = ["HK", "AE"], {"IN": [r"\d{4}", "[1-3]\\d{5}"]}
_first = lambda p, i=0: f"nullif(regexp_extract(a, '{p}', {i}), '')"
_box = r"(?i)(?:P\.?O\.?\s*(?:BOX)?\s*|BOX\s*|POST\s+OFFICE\s*BOX)\s*\d+"


def _plain(n):
    code = _first(rf"\b(\d{{{n}}})\b", 1)
    unit = " OR ".join(f"c = '{c}' AND regexp_full_match({code}, '{p}')" for c, them in UNITS.items() for p in them)
    return f"CASE WHEN NOT (coalesce(list_contains(regexp_extract_all(regexp_extract(a, '{_box}'), '\\d+'), {code}), false) OR coalesce({unit}, false) OR regexp_matches(a, '(?i)(?:TELEPHONE|TEL|PHONE|MOBILE|FAX|CONTACT|\\+971|\\+65|\\+91)\\s*:?\\s*\\d{{{n}}}')) THEN {code} END"


@query("f39_postal_by_country", rf"""WITH p AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'SG' WHEN 1 THEN 'UK' WHEN 2 THEN 'MY' WHEN 3 THEN 'HK' WHEN 4 THEN 'IN' WHEN 5 THEN 'FR' END AS c,
        c_custkey % 90 || ' Low Road, ' || CASE c_custkey % 8 WHEN 0 THEN 'S ' || (100000 + c_custkey) WHEN 1 THEN 'sw1a ' || c_custkey % 9 || 'AA' WHEN 2 THEN 'PO Box ' || (10000 + c_custkey) || ', ' || (2000 + c_custkey % 900) WHEN 3 THEN 'Tel: ' || (600000 + c_custkey) || ', ' || (50000 + c_custkey) WHEN 4 THEN '' || (100000 + c_custkey * 100)
        WHEN 5 THEN 'unit ' || (1000 + c_custkey % 900) || ', ' || (40000 + c_custkey) WHEN 6 THEN c_mktsegment ELSE c_mktsegment || ' ' || (70000 + c_custkey) END AS a FROM customer)
    SELECT c_custkey, CASE WHEN c IN ('HK', 'AE') THEN NULL ELSE coalesce(CASE c {' '.join(f"WHEN '{c}' THEN coalesce({', '.join(_first('(?i)' + x) for x in them)})" for c, them in PATTERNS.items())} END, {_plain(6)}, {_plain(5)}, {_plain(4)}) END AS postal FROM p""")
def f39(spark, sf_dir):
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    s = lambda x: x.cast("string")
    country = F.when(k % 7 == 0, "SG").when(k % 7 == 1, "UK").when(k % 7 == 2, "MY").when(k % 7 == 3, "HK").when(k % 7 == 4, "IN").when(k % 7 == 5, "FR")
    place = (
        F.when(k % 8 == 0, F.concat(F.lit("S "), s(k + 100_000))).when(k % 8 == 1, F.concat(F.lit("sw1a "), s(k % 9), F.lit("AA"))).when(k % 8 == 2, F.concat(F.lit("PO Box "), s(k + 10_000), F.lit(", "), s(k % 900 + 2000)))
        .when(k % 8 == 3, F.concat(F.lit("Tel: "), s(k + 600_000), F.lit(", "), s(k + 50_000))).when(k % 8 == 4, s(k * 100 + 100_000)).when(k % 8 == 5, F.concat(F.lit("unit "), s(k % 900 + 1000), F.lit(", "), s(k + 40_000)))
        .when(k % 8 == 6, m).otherwise(F.concat(m, F.lit(" "), s(k + 70_000)))
    )
    address = F.concat(s(k % 90), F.lit(" Low Road, "), place)
    return table(spark, sf_dir, "customer").select("c_custkey", S.postal_code(address, country, PATTERNS, OPTIONAL, UNITS).alias("postal"))


@query("d5f_order_dates", """WITH d AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
    p AS (SELECT *, day(d) AS dd, month(d) AS mm, year(d) AS yy FROM d),
    w AS (SELECT *, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%d/%m/%Y') WHEN 2 THEN strftime(d, '%m/%d/%Y') WHEN 3 THEN strftime(d, '%d.%m.%y') WHEN 4 THEN strftime(d, '%B %d, %Y') WHEN 5 THEN strftime(d, '%d %b %Y') WHEN 6 THEN strftime(d, '%Y/%m') || '/45' ELSE '99/99/' || yy || ' or ' || strftime(d, '%m-%d-%y') END AS words,
        CASE WHEN k IN (2, 7) THEN CASE WHEN mm <= 31 AND dd <= 12 THEN make_date(yy, dd, mm) ELSE d END WHEN k = 6 THEN NULL ELSE d END AS date FROM p)
    SELECT o_orderkey, date, CASE WHEN date IS NOT NULL THEN CASE WHEN k = 7 THEN strftime(d, '%m-%d-%y') ELSE words END END AS words FROM w""")
def d5f(spark, sf_dir):
    """Each order's date in one of eight forms within a sentence; where month stands before day, a day of up to 12 is read as the month."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 8
    form = lambda f: F.date_format(d, f)
    words = (
        F.when(k == 0, form("yyyy-MM-dd")).when(k == 1, form("dd/MM/yyyy")).when(k == 2, form("MM/dd/yyyy")).when(k == 3, form("dd.MM.yy")).when(k == 4, form("MMMM dd, yyyy")).when(k == 5, form("dd MMM yyyy"))
        .when(k == 6, F.concat(form("yyyy/MM"), F.lit("/45"))).otherwise(F.concat(F.lit("99/99/"), F.year(d).cast("string"), F.lit(" or "), form("MM-dd-yy")))
    )
    found = X.find_date(F.concat(F.lit("ordered on "), words, F.lit(" and sent.")))
    return table(spark, sf_dir, "orders").select("o_orderkey", found["date"].alias("date"), found["words"].alias("words"))


AS_OF = datetime.date(1997, 6, 30)


@query("d2f_order_dates", f"""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
    l AS (SELECT o_orderkey, [d, d + CAST(o_orderkey % 400 AS INTEGER), d - CAST(o_orderkey % 90 AS INTEGER)] AS dates FROM d)
    SELECT o_orderkey, list_max(list_filter(dates, lambda x: x <= DATE '{AS_OF}' AND x >= DATE '{AS_OF}' - 730)) AS date FROM l""")
def d2f(spark, sf_dir):
    """The latest date of a statement that names an order's date and two that follow from it, each in another form."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    later, before = F.date_add(d, (k % 400).cast("int")), F.date_sub(d, (k % 90).cast("int"))
    text = F.concat_ws(" ", F.lit("Issued"), F.date_format(d, "MMMM d, yyyy"), F.lit("due"), F.upper(F.date_format(later, "dd MMM yyyy")), F.lit("for the time from"), F.date_format(before, "dd/MM/yyyy"), F.lit("on, page 3/4"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.statement_date(text, AS_OF).alias("date"))


#: Codes of the 25 nations by their number, of two and of three letters, and their dialling prefixes.
CODES = {f"{chr(65 + i)}N": f"{chr(65 + i)}NX" for i in range(25)}
PREFIXES = {two: f"+{40 + i}" for i, two in enumerate(CODES)}


@query("f15_nation_codes", """WITH c AS (SELECT c_custkey, c_custkey % 5 AS k, c_nationkey AS n, chr(65 + c_nationkey) || 'N' AS two FROM customer)
    SELECT c_custkey, CASE WHEN k IN (0, 1, 2) THEN two || 'X' END AS three, k IN (0, 1, 2) AS valid, CASE WHEN k IN (0, 1) THEN '+' || (40 + n) END AS prefix FROM c""")
def f15(spark, sf_dir):
    """Each customer's nation by its code: of two letters, in small letters with white space, of three letters, with a letter too many, by a number."""
    k, n = F.col("c_custkey") % 5, F.col("c_nationkey")
    two = F.concat(F.char(n + 65), F.lit("N"))
    code = F.when(k == 0, two).when(k == 1, F.concat(F.lit(" "), F.lower(two), F.lit(" "))).when(k == 2, F.concat(two, F.lit("X"))).when(k == 3, F.concat(two, F.lit("XX"))).otherwise(n.cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.alpha3(code, CODES).alias("three"), X.valid_iso(code, CODES).alias("valid"), X.dial_prefix(code, PREFIXES).alias("prefix"))


#: A currency for each market, by its code and the names that it goes by.
MONEY = {f"{m[:2]}Q": [m.lower(), f"{m.lower()} note"] for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")}


@query("f19_market_currency", """WITH c AS (SELECT c_custkey, c_custkey % 4 AS k, c_mktsegment AS m FROM customer)
    SELECT c_custkey, CASE WHEN m IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') AND k < 3 THEN left(m, 2) || 'Q' END AS iso, coalesce(m IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') AND k = 0, false) AS valid FROM c""")
def f19(spark, sf_dir):
    """The currency of a customer's market, given by code, by name, by a longer name, or by a name that none has."""
    k, m = F.col("c_custkey") % 4, F.col("c_mktsegment")
    name = F.when(k == 0, F.concat(F.lower(F.left(m, F.lit(2))), F.lit("q "))).when(k == 1, m).when(k == 2, F.concat(F.lit(" "), m, F.lit(" Note"))).otherwise(F.concat(m, F.lit("s")))
    return table(spark, sf_dir, "customer").select("c_custkey", X.currency_iso(name, MONEY).alias("iso"), D.valid_currency(name, MONEY).alias("valid"))


@query("f25_document_scripts", r"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN translate(coalesce(text, ''), 'aeiounrst', 'аеиоунрст') WHEN 2 THEN translate(left(coalesce(text, ''), 60), 'aeiouAEIOU', 'xxxxxxxxxx') WHEN 3 THEN left(coalesce(text, ''), 25) ELSE coalesce(text, '') END AS t FROM documents),
    n AS (SELECT *, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{L}]|[\x{00}-\x{24F}]', '', 'g')) AS beyond, length(regexp_replace(t, '[^aeiouAEIOU]', '', 'g')) AS vowels FROM t)
    SELECT doc_id, letters > 0 AND beyond / letters > 0.3 AS foreign_script, length(t) >= 5 AND ((letters > 10 AND vowels / letters < 0.1)
        OR len(list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda w: length(regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) > 20)) > 0) AS unreadable FROM n""")
def f25(spark, sf_dir):
    """Script and readability of whole texts: as they are, with half of their letters in another script, without vowels, and their first words."""
    k, text = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    t = F.when(k == 1, F.translate(text, "aeiounrst", "аеиоунрст")).when(k == 2, F.translate(F.left(text, F.lit(60)), "aeiouAEIOU", "xxxxxxxxxx")).when(k == 3, F.left(text, F.lit(25))).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", X.is_non_latin(t).alias("foreign_script"), X.is_unreadable(t).alias("unreadable"))


@query("f27_nation_states", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN n_name[-1:] || 'N' END AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def f27(spark, sf_dir):
    """The country of a supplier's nation taken as a state's name: as it stands, in small letters within white space, and with a word more."""
    k = F.col("s_suppkey") % 3
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    state = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).otherwise(F.concat("n_name", F.lit(" land")))
    return joined.select("s_suppkey", X.country_from_state(state, {f"Nation_{i}": f"{i % 10}N" for i in range(25)}).alias("country"))
