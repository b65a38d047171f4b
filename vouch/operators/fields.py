"""Recognisers of single fields, address parts, matches of labels, and reports over records."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vouch.functions import likeness
from vouch.functions.names import jaro_winkler, name_similarity
from vouch.functions.text import postal_code, validate_account


def find_currency(text: Column, codes: dict[str, list[str]]) -> Column:
    """The first currency, in the order given, whose code stands in a text as a word, or one of whose names does."""
    out, whole = F.lit(None).cast("string"), F.coalesce(text, F.lit(""))
    for code, names in reversed(list(codes.items())):
        pattern = rf"\b{code}\b" + "".join(rf"|(?i:\b{n}\b)" for n in names)
        out = F.when(whole.rlike(pattern), F.lit(code)).otherwise(out)
    return out


def valid_currency(code: Column, codes: dict[str, list[str]]) -> Column:
    return F.coalesce(F.upper(F.trim(code)).isin(*codes), F.lit(False))


def bank_from_iban(rows: DataFrame, banks: DataFrame) -> DataFrame:
    """Adds bank to rows with iban, by the four characters after its check digits; banks has code and bank."""
    keyed = rows.withColumn("_code", F.substring("iban", 5, 4))
    return keyed.join(banks.select(F.col("code").alias("_code"), "bank"), "_code", "left").drop("_code")


def country_in_text(texts: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id and country of the best place word in a text: names before codes before towns (tier), then the longest, then by name.

    places has term (one word), country and tier.
    """
    words = texts.select("doc_id", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))).alias("term"))
    found = words.join(places.select(F.lower("term").alias("term"), "country", "tier").distinct(), "term")
    best = F.min_by("country", F.struct("tier", -F.length("term"), "term", "country"))
    return found.groupBy("doc_id").agg(best.alias("country"))


def is_passport_number(text: Column) -> Column:
    """Six to twelve letters and digits, five digits or more."""
    plain = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return plain.rlike("^[A-Z0-9]{6,12}$") & (F.regexp_count(plain, F.lit("[0-9]")) >= 5)


def is_country_code(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")).rlike("^[A-Z]{3}$")


def is_sex(text: Column) -> Column:
    return F.upper(F.trim(F.coalesce(text, F.lit("")))).isin("M", "F", "X", "MALE", "FEMALE")


def normalize_address(text: Column, short: dict[str, str]) -> Column:
    """Lower case, abbreviations written out word by word, white space squeezed."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " ")
    known = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(known[F.regexp_replace(w, r"\.$", "")], w)), " ")


def is_garbled(text: Column) -> Column:
    """Whether a line is noise: one character four times in a row, or fewer than half of its characters letters or digits."""
    whole = F.coalesce(text, F.lit(""))
    good = F.length(F.regexp_replace(whole, r"[^\p{L}\p{N} ]", ""))
    return whole.rlike(r"(.)\1{3,}") | (good < F.length(whole) / 2)


def address_missing(fields: Column, country: Column, required: dict[str, list[str]]) -> Column:
    """Parts of an address (a map) that its country asks for and that are missing or empty, in order; the entry `*` holds for others."""
    asked = F.array(*map(F.lit, required["*"]))
    for code, parts in required.items():
        if code != "*":
            asked = F.when(country == code, F.array(*map(F.lit, parts))).otherwise(asked)
    given = F.map_keys(F.map_filter(fields, lambda _, v: F.coalesce(F.trim(v), F.lit("")) != ""))
    return F.array_sort(F.array_except(asked, given))


def parse_address(address: Column) -> Column:
    """Struct of street number, postal code, and the rest without them."""
    whole = F.coalesce(address, F.lit(""))
    number = F.nullif(F.regexp_extract(whole, r"^\s*(\d{1,4}[A-Za-z]?)\b", 1), F.lit(""))
    post = postal_code(whole)
    rest = F.regexp_replace(F.regexp_replace(whole, r"^\s*\d{1,4}[A-Za-z]?\b[ ,]*", ""), r"\b\d{5,6}\b", "")
    return F.struct(number.alias("number"), post.alias("postal"), F.trim(F.regexp_replace(F.regexp_replace(rest, r"(\s*,\s*)+", ", "), r"^, |, $", "")).alias("rest"))


def parse_addresses(rows: DataFrame, places: DataFrame, states: dict[str, str], longest: int = 3) -> DataFrame:
    """doc_id, number, street, city, postal, state and country of each address (doc_id, address).

    places has term and kind (city, state or country); of each kind the longest that stands in an address as words is
    taken, and a country that is not named follows from the state. street is what is left before the first of them.
    """
    from vouch.functions.text import country_from_state
    from vouch.operators.extract import tag_dictionary

    out = rows.select("doc_id", "address", parse_address(F.col("address")).alias("p"))
    texts = rows.select("doc_id", F.col("address").alias("text"))
    for kind in ("city", "state", "country"):
        told = tag_dictionary(texts, places.filter(F.col("kind") == kind), longest).select("doc_id", F.col("term").alias(kind))
        out = out.join(told, "doc_id", "left")
    street = F.col("p.rest")
    for kind in ("city", "state", "country"):
        place = F.col(kind)
        street = F.when(place.isNotNull(), F.regexp_replace(street, F.concat(F.lit(r"(?i)(^|[^\p{L}\p{N}])"), place, F.lit(r"([^\p{L}\p{N}]|$)")), F.lit("$1$2"))).otherwise(street)
    tidy = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(street, r"\s+", " ")), r"( ?, ?)+", ", "), r"^, |,? ?$", "")
    country = F.coalesce("country", country_from_state(F.col("state"), states))
    return out.select("doc_id", "p.number", tidy.alias("street"), "city", "p.postal", "state", country.alias("country"))


@F.pandas_udf(T.StringType())
def closest_word(text: pd.Series, target: pd.Series) -> pd.Series:
    """The word of each text most like the target by matching blocks, at 0.3 or more; null without one.

    The distinct words of a batch are bounded together, and only words that may be the closest are compared.
    """
    words = [(x or "").lower().split() for x in text]
    goals = target.fillna("").str.lower()
    near = {t: likeness.Words(t, itertools.chain.from_iterable(w for w, own in zip(words, goals) if own == t)) for t in set(goals)}
    return pd.Series([near[t].closest(w, 0.3) for w, t in zip(words, goals)], dtype=object)


def text_match(text: Column, target: Column) -> Column:
    """Percentage to which a target stands in a text: 100 if it does, else by the closest word's Jaro-Winkler similarity."""
    inside = F.lower(F.coalesce(text, F.lit(""))).contains(F.lower(target))
    near = jaro_winkler(F.coalesce(closest_word(text, target), F.lit("")), F.lower(target))
    return F.when(inside, 100.0).otherwise(F.round(near * 100, 2))


def has_window(least: float):
    """Whether the shorter of a text and a label is by matching blocks, in percent, `least` or more like a window of its length in the longer one.

    The distinct texts of a batch are looked at together.
    """

    @F.pandas_udf(T.BooleanType())
    def found(text: pd.Series, label: pd.Series) -> pd.Series:
        low, goals = text.fillna("").str.lower(), label.fillna("").str.lower()
        out = pd.Series(False, index=text.index)
        for goal, same in low.groupby(goals, sort=False):
            out[same.index] = same.map(likeness.have_window(same.unique().tolist(), goal, least)).astype(bool)
        return out

    return found


def label_match(text: Column, label: Column, least: float = 75.0) -> Column:
    """Whether a text contains a label, or a part of it is like it."""
    return F.lower(F.coalesce(text, F.lit(""))).contains(F.lower(label)) | has_window(least)(text, label)


def true_matches(results: DataFrame, subjects: DataFrame, strength: float, similarity: float) -> DataFrame:
    """Results of a commercial list that hold: strong enough, the name similar enough, no secondary field that fails.

    results has subject_id, result_id, strength, matched_name and secondary, an array of (field, status).
    """
    joined = results.join(subjects.select("subject_id", "full_name"), "subject_id")
    fails = F.exists("secondary", lambda s: s["status"] == "NOT_MATCHED")
    scored = joined.filter((F.col("strength") >= strength) & ~F.coalesce(fails, F.lit(False))).withColumn("similarity", F.round(name_similarity(F.col("full_name"), F.col("matched_name")), 4))
    return scored.filter(F.col("similarity") >= similarity).select("subject_id", "result_id", "strength", "similarity")


def attach_face(results: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds face_similarity to results by url, of several matches the first by arrival; ties by the lesser similarity."""
    first = matches.groupBy("url").agg(F.min_by("similarity", F.struct("arrival", "similarity")).alias("face_similarity"))
    return results.join(first, "url", "left")


def risk_breakdown(verdicts: DataFrame, matches: DataFrame, top: int = 3) -> DataFrame:
    """For each subject a row for each check (check, score, failed), with its first matches where it has any."""
    first = matches.filter(F.col("rank") <= top).groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entry_id"))).alias("m"))
    checks = F.array(*[F.struct(F.lit(n).alias("check"), F.round(F.col(c), 2).alias("score"), failed.alias("failed")) for n, c, failed in (
        ("sanctions", "sanctions_risk", F.col("sanctions_confidence") >= 0.65), ("pep", "pep_risk", F.col("pep_confidence") >= 0.65), ("news", "news_risk", F.col("news_risk") >= 50))])
    rows = verdicts.join(first, "subject_id", "left").select("subject_id", "m", F.explode(checks).alias("c"))
    return rows.select("subject_id", "c.check", "c.score", "c.failed", F.when(F.col("c.check") == "sanctions", F.transform("m", lambda x: x["entry_id"])).alias("matches"))


def registry_stats(registry: DataFrame) -> DataFrame:
    """Schemas of each type, with their countries and average number of fields."""
    return registry.groupBy("type").agg(F.count(F.lit(1)).alias("schemas"), F.count_distinct("country").alias("countries"), F.round(F.avg("fields"), 4).alias("fields"))


def schemas_for(registry: DataFrame, kind: str) -> DataFrame:
    """Schemas of a type, the most specific first, then by priority and name: their rank."""
    order = Window.partitionBy("type").orderBy(F.desc("specificity"), F.desc("priority"), "schema")
    return registry.filter(F.col("type") == kind).withColumn("rank", F.row_number().over(order))


def prioritize_required(fields: DataFrame) -> DataFrame:
    """Rank of a document's fields: required ones first, then by confidence and name."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("required"), F.desc("confidence"), "field")
    return fields.withColumn("rank", F.row_number().over(order))


def validate_statement(df: DataFrame, low: int, high: int, banks: DataFrame, fresh: Column, required: list[str]) -> DataFrame:
    """All errors of each statement (doc_id, account, bank and the required parts of its address), in the order of the checks."""
    known = df.join(banks.select("bank").distinct().withColumn("_known", F.lit(True)), "bank", "left")
    why = validate_account(F.col("account"), F.lit(low), F.lit(high))
    lacking = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"address_{c}")) for c in required]
    errors = F.array_compact(F.array(F.when(why.isNotNull(), F.concat(F.lit("account_"), why)), *lacking, F.when(F.col("_known").isNull(), F.lit("bank_unknown")), F.when(~fresh, F.lit("statement_old"))))
    return known.select("doc_id", errors.alias("errors"))
