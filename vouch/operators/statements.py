"""Rules for what is read from statements: values that agree, account numbers, holders' names, schemas, keys, postal codes."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from vouch.operators.extract import small

#: Labels that are no account number: fixed values.
ACCOUNT_LABELS = ["account no", "account number", "acct no", "acct number", "account #", "acct #", "number"]
#: Labels of a statement that are no name: fixed values.
STATEMENT_LABELS = [
    "account statement", "statement period", "requested date", "account type", "branch", "account number", "account name", "bank statement", "statement", "summary", "details", "transaction", "debit", "credit",
    "balance", "amount", "date", "description", "reference", "page", "total", "opening balance", "closing balance", "current balance", "statement date", "period", "from", "to", "currency",
]
#: What companies' names end with: fixed values.
ENTITY_SUFFIXES = [
    "PTY LTD", "PTY. LTD.", "PTY. LTD", "PT LTD", "PTE LTD", "LTD", "LIMITED", "INC", "INCORPORATED", "LLC", "LLP", "SDN BHD", "SDN. BHD.", "BERHAD", "BHD", "GMBH", "AG", "SA", "SPA", "SRL", "BV", "NV", "PLC", "PCL", "CORP",
    "CORPORATION", "CO.", "COMPANY",
]
#: Score from which a line is likely a name: fixed value.
LIKELY = 30


def _any(parts: list[Column]) -> Column:
    return reduce(or_, parts, F.lit(False))


def squeezed(text: Column) -> Column:
    """Lower case, white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def values_agree(expected: Column, found: Column) -> Column:
    """Whether two values, as JSON texts, agree.

    Two nulls do, one does not. Texts are compared without regard to case and number of spaces; of two lists each item
    expected must be among those found, in any order, texts compared like texts and others by value; all else as text.
    """
    e, f = F.try_parse_json(expected), F.try_parse_json(found)
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    told = lambda v: squeezed(F.try_variant_get(v, "$", "string"))
    item = lambda v: F.when(kind(v) == "STRING", F.concat(F.lit("t:"), told(v))).otherwise(F.concat(F.lit("v:"), F.to_json(v)))
    items = lambda v: F.transform(F.try_variant_get(v, "$", "array<variant>"), item)
    lists = kind(e).startswith("ARRAY") & kind(f).startswith("ARRAY")
    return (
        F.when(kind(e) == "VOID", kind(f) == "VOID").when(kind(f) == "VOID", F.lit(False))
        .when(lists, F.size(F.array_except(items(e), items(f))) == 0).otherwise(F.coalesce(told(e) == told(f), F.lit(False)))
    )


def account_number(text: Column) -> Column:
    """The digits of a text that is nothing but an account number of 8 to 15 digits, hyphens and spaces; else null."""
    joined = F.regexp_replace(text, "[- ]", "")
    return F.when(joined.rlike("^[0-9]{8,15}$"), joined)


def is_account(text: Column) -> Column:
    """Whether a text may be an account number: no label, and 8 to 15 digits alone, or six digits at least among misread ones."""
    low = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    label = _any([low.contains(x) for x in ACCOUNT_LABELS])
    digits = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", ""))
    return ~label & (account_number(text).isNotNull() | (digits >= 6))


def holder_score(line: Column, left: Column, middle: Column) -> Column:
    """How likely a line is an account holder's name; LIKELY or more tells one.

    left and middle say where it begins and how far down it stands, as parts of the page. Labels, single words and lines
    with digits score nothing; place, patronymics, title case, capitals, a company's suffix and clean letters count.
    """
    text = F.trim(F.coalesce(line, F.lit("")))
    low, words = F.lower(text), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    label = low.isin(STATEMENT_LABELS) | low.rlike("^(?:" + "|".join(STATEMENT_LABELS) + ")[: ]")
    capitals = (F.upper(text) == text) & (low != text)
    title = text.rlike(r"^[^\p{L}]*(?:\p{Lu}\p{Ll}*[^\p{L}]+)*(?:\p{Lu}\p{Ll}*)?$") & ~capitals
    points = [
        (middle < 0.5, 10), ((middle < 0.2) & (left < 0.5), 15), ((middle > 0.1) & (middle < 0.2), 15), (text.rlike(r"(?i)\s(?:S/O|D/O|A/L)\.?\s"), 40), (words.between(2, 3) & title, 25),
        ((words <= 4) & capitals, 10), (_any([F.upper(text).endswith(x) for x in ENTITY_SUFFIXES]), 30), (text.rlike(r"^[\p{L}\p{N}\s/\-.&']*$"), 15),
    ]
    score = reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in points])
    return F.when(label | (words < 2) | text.rlike("[0-9]"), 0).otherwise(score)


def holder_names(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line, left, middle) with score, likely, and best: whether it is the document's likely line of most points, the first of equals."""
    scored = lines.withColumn("score", holder_score(F.col("line"), F.col("left"), F.col("middle"))).withColumn("likely", F.col("score") >= LIKELY)
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "line_no")
    return scored.withColumn("best", F.col("likely") & (F.row_number().over(order) == 1))


def select_schema(detected: DataFrame, registry: DataFrame) -> DataFrame:
    """The first enabled schema for type, country and entity, for type and country, for type and entity, or for the type: doc_id, schema, method, confidence.

    detected has doc_id, type, country, entity and confidence (null where nothing was detected), registry schema,
    country, entity, priority and enabled. A schema's own entity and country raise the confidence where they agree; it
    is mixed with the detection's, and priority adds a little. Without a schema the confidence is 0.
    """
    tried = [("exact_match", F.concat_ws(":", "type", "country", "entity")), ("country_match", F.concat_ws(":", "type", "country")), ("entity_match", F.concat_ws(":", "type", F.lit("__entity__"), "entity")), ("generic", F.col("type"))]
    given = [F.col("country").isNotNull() & F.col("entity").isNotNull(), F.col("country").isNotNull(), F.col("entity").isNotNull(), F.lit(True)]
    steps = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(i).alias("step"), F.lit(m).alias("method"), s.alias("schema"))) for i, ((m, s), ok) in enumerate(zip(tried, given))]))
    asked = detected.filter("type is not null").select("doc_id", "country", "entity", "confidence", F.explode(steps).alias("s")).select("*", "s.*").drop("s")
    known = registry.filter("enabled").select("schema", F.col("country").alias("own_country"), F.col("entity").alias("own_entity"), "priority")
    same = lambda a, b: F.coalesce(F.lower(a) == F.lower(b), F.lit(False))
    sure = 0.5 + F.when(same(F.col("own_entity"), F.col("entity")), 0.3).otherwise(0.0) + F.when(same(F.col("own_country"), F.col("country")), 0.2).otherwise(0.0)
    mixed = F.when(F.col("confidence").isNull(), sure).otherwise(sure * 0.6 + F.col("confidence") * 0.4) + F.least(F.col("priority") / 200, F.lit(0.1))
    told = F.round(F.greatest(F.lit(0.0), F.least(mixed, F.lit(1.0))), 6)
    best = asked.join(small(known), "schema").groupBy("doc_id").agg(F.min(F.struct("step", "schema", "method", told.alias("told"))).alias("b"))
    return detected.join(best, "doc_id", "left").select("doc_id", "b.schema", F.coalesce("b.method", F.when(F.col("type").isNull(), "no_type").otherwise("none")).alias("method"), F.coalesce("b.told", F.lit(0.0)).alias("confidence"))


class Key(NamedTuple):
    """A key's pattern, how many groups it has, and the format that its value should have, if any."""

    pattern: str
    groups: int = 0
    format: str | None = None


def key_values(lines: DataFrame, keys: dict[str, Key]) -> DataFrame:
    """Values of keys in lines (doc_id, line_no, line): doc_id, line_no, key_name, value, confidence.

    The last group of a pattern is the value, at 0.9, if it has the key's format. Else it is what follows the key on
    the line, at 0.85 if that has the format and at 0.7 if not; where nothing follows there is no value.
    """
    found = []
    for name, key in keys.items():
        fits = lambda v: v.rlike(f"^(?:{key.format})") if key.format else F.lit(True)  # noqa: B023, E731
        group = F.trim(F.regexp_extract("line", key.pattern, key.groups)) if key.groups else F.lit("")
        after = F.trim(F.regexp_replace("line", f"(?s)^.*?(?:{key.pattern})", ""))
        good = (group != "") & fits(group)
        value = F.when(good, group).otherwise(F.nullif(after, F.lit("")))
        sure = F.when(good, 0.9).when(fits(after), 0.85).otherwise(0.7)
        found.append(F.when(F.col("line").rlike(key.pattern) & value.isNotNull(), F.struct(F.lit(name).alias("key_name"), value.alias("value"), sure.alias("confidence"))))
    return lines.select("doc_id", "line_no", F.explode(F.array_compact(F.array(*found))).alias("k")).select("doc_id", "line_no", "k.*")


def postal_code(address: Column, country: Column, patterns: dict[str, list[str]], optional: list[str], units: dict[str, list[str]]) -> Column:
    """The postal code of an address by its country's patterns, in order; null without one.

    Countries in `optional` without a pattern have none. Where no pattern fits, the first number of six, then of
    five, then of four digits counts, but for numbers of a post box, unit numbers of the country (whole patterns), and
    lengths that a number beside a word for a telephone has.
    """

    def rule(text: Column, country: Column) -> Column:
        first = lambda p, i=0: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
        own = F.lit(None).cast("string")
        for code, them in patterns.items():
            own = F.when(country == code, F.coalesce(*[first(f"(?i){p}") for p in them])).otherwise(own)
        boxes = F.regexp_extract_all(first(r"(?i)(?:P\.?O\.?\s*(?:BOX)?\s*|BOX\s*|POST\s+OFFICE\s*BOX)\s*\d+"), F.lit(r"(\d+)"))

        def plain(n: int) -> Column:
            code = first(rf"\b(\d{{{n}}})\b", 1)
            unit = _any([(country == c) & code.rlike(f"^(?:{p})$") for c, them in units.items() for p in them])
            phone = text.rlike(rf"(?i)(?:TELEPHONE|TEL|PHONE|MOBILE|FAX|CONTACT|\+971|\+65|\+91)\s*:?\s*\d{{{n}}}")
            return F.when(~(F.coalesce(F.array_contains(boxes, code), F.lit(False)) | F.coalesce(unit, F.lit(False)) | phone), code)

        unused = country.isin([c for c in optional if not patterns.get(c)])
        return F.when(~F.coalesce(unused, F.lit(False)), F.coalesce(own, plain(6), plain(5), plain(4)))

    # Bound once, however long the expressions of address and country are.
    bound = F.array(F.struct(F.coalesce(address, F.lit("")).alias("text"), country.alias("country")))
    return F.get(F.transform(bound, lambda x: rule(x["text"], x["country"])), F.lit(0))
