"""Column functions for dates, amounts and fields in text."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, functions as F

#: Formats in the order in which they decide an ambiguous date: day before month, then the other way. Fixed values.
DATE_FORMATS = ["yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd", "dd/MM/yyyy", "yyyyMMdd", "ddMMyyyy", "MM/dd/yyyy", "MM-dd-yyyy"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
LONG_MONTHS = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"]
#: Dates in running text: a month by name after the day or, in full and with a comma, before it, or three numbers.
DATE_IN_TEXT = r"(?i)\b((?:" + "|".join(LONG_MONTHS) + r")\s+\d{1,2},\s+\d{4}|\d{1,2}\s*(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\.?\s*\d{4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})\b"


def _to_date(text: Column, fmt: str) -> Column:
    """A date of exactly this format; null for anything else."""
    shape = "^" + fmt.replace("yyyy", r"\d{4}").replace("MM", r"\d{1,2}" if not fmt.isalpha() else r"\d{2}").replace("dd", r"\d{1,2}" if not fmt.isalpha() else r"\d{2}") + "$"
    loose = fmt if fmt.isalpha() else fmt.replace("MM", "M").replace("dd", "d")
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(loose)).cast("date"))


def parse_date(text: Column) -> Column:
    """A date given as day, month name and year, or in one of eight formats, the first that fits; else null."""
    up = F.upper(F.trim(text))
    named = r"^(\d{1,2})\s*([A-Z]{3})\s*(\d{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(up, named, 2))
    number = lambda n: F.nullif(F.regexp_extract(up, named, n), F.lit("")).cast("int")
    by_name = F.when(month > 0, F.try_make_timestamp(number(3), month.cast("int"), number(1), F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    return F.coalesce(by_name, *[_to_date(up, f) for f in DATE_FORMATS])


def parse_text_date(text: Column) -> Column:
    """parse_date for dates as they stand in text: month names in full, dots, and the month first are allowed."""
    turned = F.regexp_replace(F.upper(F.trim(text)), r"^([A-Z]{3})[A-Z]*\s+(\d{1,2}),\s+(\d{4})$", "$2 $1 $3")
    return parse_date(F.regexp_replace(turned, r"^(\d{1,2})\s*([A-Z]{3})[A-Z]*\.?\s*(\d{4})$", "$1 $2 $3"))


#: Names of months by which find_date knows them: in full, by three letters, and one by four. Fixed values.
MONTH_NUMBERS = {name.lower(): i + 1 for names in (LONG_MONTHS, MONTHS) for i, name in enumerate(names)} | {"sept": 9}


def _calendar(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers, null where there is none or it lies outside 1900 to 2100."""
    y, m, d = (part.try_cast("int") for part in (year, month, day))
    return F.when(y.between(1900, 2100), F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date"))


def find_date(text: Column) -> Column:
    """Struct of the first date in a text and the words it stands in; null without one.

    Shapes are tried in turn over the whole text: year first; three numbers with a year of four digits, then of two
    (up to 29 in the 2000s), each with the day first where that is a date, else the month; month by name, day, year;
    day, month by name, year.
    """
    months = F.create_map(*[F.lit(x) for kv in MONTH_NUMBERS.items() for x in kv])
    numbers = r"\b(\d{1,2})([/.-])(\d{1,2})\2(\d{%d})\b"

    def either(m: Column, shape: str, short: bool) -> Column:
        a, b, y = (F.regexp_extract(m, shape, i) for i in (1, 3, 4))
        short_year = y.try_cast("int")
        year = F.when(short_year < 30, short_year + 2000).otherwise(short_year + 1900) if short else y
        return F.coalesce(_calendar(year, b, a), _calendar(year, a, b))

    def named(m: Column, shape: str, month: int, day: int) -> Column:
        return _calendar(F.regexp_extract(m, shape, 3), months[F.lower(F.regexp_extract(m, shape, month))], F.regexp_extract(m, shape, day))

    shapes = [
        (r"\b(\d{4})([/.-])(\d{1,2})\2(\d{1,2})\b", lambda m, p: _calendar(*(F.regexp_extract(m, p, i) for i in (1, 3, 4)))),
        (numbers % 4, lambda m, p: either(m, p, False)),
        (numbers % 2, lambda m, p: either(m, p, True)),
        (r"\b([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})\b", lambda m, p: named(m, p, 1, 2)),
        (r"\b(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\b", lambda m, p: named(m, p, 2, 1)),
    ]

    def of_shape(pattern: str, parse) -> Column:
        found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda m: F.struct(parse(m, pattern).alias("date"), m.alias("words")))
        return F.filter(found, lambda d: d["date"].isNotNull())

    return F.get(F.concat(*(of_shape(p, f) for p, f in shapes)), F.lit(0))


#: Ways of writing a country in text, by code: fixed values.
COUNTRY_NAMES = {
    "sg": ["singapore", "sgp", "sg"],
    "us": ["united states", "usa", "us", "america"],
    "uk": ["united kingdom", "uk", "gb", "great britain", "england"],
    "my": ["malaysia", "my"],
    "th": ["thailand", "th"],
    "id": ["indonesia", "id"],
    "ph": ["philippines", "ph"],
    "in": ["india", "in"],
}


def _empty(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) == ""


def mentions_country(text: Column, country: Column) -> Column:
    """Whether a text contains a country's name or code, or another way of writing it; true where either is missing."""
    low, asked = F.lower(text), F.trim(F.lower(country))
    told = low.contains(asked)
    for ways in COUNTRY_NAMES.values():
        told = told | (asked.isin(ways) & low.rlike("|".join(ways)))
    return _empty(text) | _empty(country) | told


#: Parts of a url that tell its kind, in the order in which they are tried: fixed values.
URL_KINDS = {
    "social_media": ["linkedin.com/in/", "facebook.com/", "x.com/", "twitter.com/", "instagram.com/"],
    "company_website": ["/team/", "/about/"],
    "news": ["cnn", "bbc", "reuters", "bloomberg", "news"],
    "forum": ["reddit", "quora", "stackexchange"],
}


def source_type(url: Column) -> Column:
    """The kind of a url by the first part that it contains, else `other`."""
    out, low = F.lit("other"), F.lower(F.coalesce(url, F.lit("")))
    for kind, parts in reversed(URL_KINDS.items()):
        hit = F.lit(False)
        for part in parts:
            hit = hit | low.contains(part)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def _lookup(entries: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])[key]


def valid_iso(code: Column, codes: dict[str, str]) -> Column:
    """Whether a country code is one of two or of three letters, by a map from one to the other."""
    up = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return up.isin(*codes) & (F.length(up) == 2) | up.isin(*codes.values()) & (F.length(up) == 3)


def dial_prefix(code: Column, prefixes: dict[str, str]) -> Column:
    """The telephone prefix of a country code; one that is a prefix already stays, an unknown one gives null."""
    up = F.upper(F.trim(code))
    return F.when(up.startswith("+"), up).otherwise(_lookup(prefixes, up))


def currency_iso(name: Column, codes: dict[str, list[str]]) -> Column:
    """The code of a currency given by code or by one of its names; null for others."""
    plain = F.trim(name)
    return F.when(F.upper(plain).isin(*codes), F.upper(plain)).otherwise(_lookup({n.lower(): c for c, names in codes.items() for n in names}, F.lower(plain)))


def country_from_state(state: Column, states: dict[str, str]) -> Column:
    """The country of a state, whose name is compared but for case and white space around it."""
    return _lookup({k.lower(): v for k, v in states.items()}, F.lower(F.trim(state)))


def is_name_label(text: Column) -> Column:
    """Whether a label asks for a name; one for a nationality does not."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.contains("name") & ~low.contains("nationality")


def date_text(text: Column) -> Column:
    """The date that a text is, and nothing else: day, month of three letters, year; day, month, year; year, month, day."""
    up = F.upper(F.trim(text))
    by_name, day_first, year_first = r"^(\d{1,2})\s*([A-Z]{3})\s*(\d{4})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"
    of = lambda p, *groups: [F.regexp_extract(up, p, g) for g in groups]
    year, month, day = of(by_name, 3, 2, 1)
    dates = [_calendar(year, _lookup({m: i + 1 for i, m in enumerate(MONTHS)}, month), day), _calendar(*of(day_first, 3, 2, 1)), _calendar(*of(year_first, 1, 2, 3))]
    return F.coalesce(*dates)


def field_by_pattern(text: Column, pattern: str, group: bool) -> Column:
    """Struct of what a pattern finds first (its group without spaces, or all of it), confidence and matched."""
    value = F.regexp_replace(F.regexp_extract(text, pattern, 1), " ", "") if group else F.regexp_extract(text, pattern, 0)
    hit = F.coalesce(text.rlike(pattern), F.lit(False))
    return F.struct(F.when(hit, value).alias("value"), F.when(hit, 100.0).otherwise(0.0).alias("confidence"), hit.alias("matched"))


#: Words of a bank's address, and those that count only with a word of a street: fixed values.
BANK_PLACES = ["branch", "head office", "h.o.", "hq", "operations center", "corporate office", "registered office", "business center", "tower", "plaza", "complex", "centre", "center"]
BANK_WORDS, STREET_WORDS = ["bank", "financial", "credit", "investment", "capital"], ["road", "street", "building", "tower"]


def _contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def is_bank_address(text: Column) -> Column:
    """Whether an address is more likely a bank's than a person's."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _contains_any(low, BANK_PLACES) | (_contains_any(low, BANK_WORDS) & _contains_any(low, STREET_WORDS))


def is_address(text: Column, keywords: list[str], negative: list[str], postal: str = r"\b\d{5,6}\b", length: int = 10, words: int = 2) -> Column:
    """Whether a text is an address: long enough, matching none of the negative patterns, with a postal code or an address word."""
    whole = F.coalesce(text, F.lit(""))
    low = F.lower(F.trim(whole))
    refused = F.lit(False)
    for pattern in negative:
        refused = refused | low.rlike(pattern)
    enough = (F.length(whole) >= length) & (F.size(F.filter(F.split(whole, r"\s+"), lambda w: w != "")) >= words)
    return enough & ~refused & (whole.rlike(f"(?i){postal}") | _contains_any(F.lower(whole), keywords))


def is_non_latin(text: Column) -> Column:
    """Whether more than three tenths of a text's letters lie beyond Latin script."""
    letters = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{L}"))
    beyond = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}&&[^\u0000-\u024F]]"))
    return (letters > 0) & (beyond / F.when(letters > 0, letters) > 0.3)


def is_unreadable(text: Column) -> Column:
    """Whether a text is garbled: a word of over 20 characters, or of over ten letters fewer than a tenth vowels."""
    whole = F.coalesce(text, F.lit(""))
    letters, vowels = F.regexp_count(whole, F.lit(r"\p{L}")), F.regexp_count(whole, F.lit("[aeiouAEIOU]"))
    punctuation = r"[!-/:-@\[-`{-~]+"
    long = F.exists(F.split(whole, r"\s+"), lambda w: F.length(F.regexp_replace(w, f"^{punctuation}|{punctuation}$", "")) > 20)
    return (F.length(whole) >= 5) & (long | ((letters > 10) & (vowels / F.when(letters > 10, letters) < 0.1)))

def all_dates(text: Column, as_of: datetime.date, days: int = 730) -> Column:
    """Dates in a text, in order, that are not after as_of nor older than so many days."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DATE_IN_TEXT), 1), parse_text_date)
    return F.filter(found, lambda d: d.isNotNull() & F.datediff(F.lit(as_of), d).between(0, days))


def statement_date(text: Column, as_of: datetime.date, days: int = 730) -> Column:
    """The latest of all_dates."""
    return F.array_max(all_dates(text, as_of, days))


def split_dates(text: Column) -> Column:
    """Struct of the dates in a text and what is left of it, white space squeezed."""
    whole = F.coalesce(text, F.lit(""))
    rest = F.trim(F.regexp_replace(F.regexp_replace(whole, DATE_IN_TEXT, " "), r"\s+", " "))
    dates = F.filter(F.transform(F.regexp_extract_all(whole, F.lit(DATE_IN_TEXT), 1), parse_text_date), lambda d: d.isNotNull())
    return F.struct(dates.alias("dates"), rest.alias("rest"))


def format_date(date: Column, fmt: str = "dd MMM yyyy") -> Column:
    """A date for display, in capitals."""
    return F.upper(F.date_format(date, fmt))


def parse_amount(text: Column) -> Column:
    """The number in a balance: signs of currency and thousands are dropped, brackets mean below zero; else null."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9.\-()]", "")
    digits = F.regexp_replace(plain, r"[()\-]", "")
    number = F.when(digits.rlike(r"^\d+(\.\d+)?$"), digits.cast("double"))
    return F.when(plain.rlike(r"^\(.*\)$|^-|-$"), -number).otherwise(number)


def alpha3(code: Column, codes: dict[str, str]) -> Column:
    """The three-letter form of a country code, by a map from two letters; three-letter codes stay, others give null."""
    up = F.upper(F.trim(code))
    known = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(known[up], F.when(up.isin(*codes.values()), up))


def composite_hash(*parts: Column) -> Column:
    """SHA-256 of parts joined by underscores."""
    return F.sha2(F.concat_ws("_", *parts), 256)


def mask_phone(number: Column) -> Column:
    return F.concat(F.lit("****"), F.right(number, F.lit(4)))


def validate_account(number: Column, low: Column, high: Column) -> Column:
    """Why an account number is refused: empty, masked, not_digits, length, credit_card; null if it is good.

    low and high are the digits that its currency asks for.
    """
    clean = F.regexp_replace(number, r"[\s\-]", "")
    card = (F.length(clean) == 16) & F.luhn_check(clean) if hasattr(F, "luhn_check") else (F.length(clean) == 16) & F.call_function("luhn_check", clean)
    return (
        F.when(F.coalesce(F.trim(number), F.lit("")) == "", "empty").when(clean.rlike(r"[Xx*•_#]"), "masked").when(~clean.rlike(r"^\d+$"), "not_digits")
        .when(~F.length(clean).between(low, high), "length").when(card, "credit_card")
    )


def extract_account(text: Column) -> Column:
    """The first run of 8 to 15 digits, spaces and hyphens between them dropped; null without one."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d)[ \-](?=\d)", "")
    return F.nullif(F.regexp_extract(joined, r"(?<!\d)(\d{8,15})(?!\d)", 1), F.lit(""))


def extract_iban(text: Column) -> Column:
    """The first international account number, without spaces; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b", 1), " ", ""), F.lit(""))


def extract_code(text: Column) -> Column:
    """Struct of the first six-digit code, and whether a word that tells of a code stands before it."""
    whole = F.coalesce(text, F.lit(""))
    named = F.regexp_extract(whole, r"(?i)(?:OTP|Verification|Code)[:\s]*([0-9]{6})(?![0-9])", 1)
    plain = F.regexp_extract(whole, r"\b([0-9]{6})\b", 1)
    return F.struct(F.nullif(F.when(named != "", named).otherwise(plain), F.lit("")).alias("code"), (named != "").alias("named"))


def partial_match(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or the same first or last five characters, upper and lower case alike."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    long = (F.length(x) >= 5) & (F.length(y) >= 5)
    ends = (F.left(x, F.lit(5)) == F.left(y, F.lit(5))) | (F.right(x, F.lit(5)) == F.right(y, F.lit(5)))
    return F.coalesce((x == y) | x.contains(y) | y.contains(x) | (long & ends), F.lit(False))


def fix_terms(text: Column, terms: dict[str, str]) -> Column:
    """Replaces misread terms, in the order given."""
    for wrong, right in terms.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


#: Weights of the parts of an extraction's confidence: fixed values.
CONFIDENCE_WEIGHTS = {"ocr": 0.25, "spatial": 0.25, "format": 0.20, "key_importance": 0.15, "pattern_specificity": 0.10, "cross_validation": 0.05}


def enhanced_confidence(parts: dict[str, Column]) -> Column:
    """Weighted sum of six confidences, within 0 and 1; one that is missing is 0."""
    total = sum((F.coalesce(parts.get(k, F.lit(0.0)), F.lit(0.0)) * w for k, w in CONFIDENCE_WEIGHTS.items()), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def confidence_factors(found: Column, ocr: Column, value: Column, value_confidence: Column, box: Column, fits: Column, required: Column, weight: Column, pattern: Column, others: Column) -> dict[str, Column]:
    """The six confidences of an extracted field that enhanced_confidence weighs.

    found is the key's confidence, ocr that of the text read, box a struct of x1, y1, x2, y2, fits whether the value
    has the form asked for (null without one), weight and pattern those that the key was found by, others the same
    field's values in other documents.
    """
    clean, given = F.trim(value), ~_empty(value)
    quality = (
        F.when(value.rlike("[0-9]l[0-9]"), 0.9).otherwise(1.0) * F.when(value.rlike("[0-9]o[0-9]"), 0.9).otherwise(1.0)
        * F.when(value.rlike("[a-z]{2,}[0-9]+") & value.rlike("[01ol]"), 0.95).otherwise(1.0) * F.when(value.rlike(r"^[a-zA-Z0-9\s\-.]+$"), 1.02).otherwise(1.0)
    )
    inside = F.lit(True)
    for name in ("x1", "y1", "x2", "y2"):
        inside = inside & box[name].between(0.0, 1.0)
    area = (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])
    sound = inside & (box["x2"] > box["x1"]) & (box["y2"] > box["y1"]) & area.between(0.0001, 0.5)
    alike = F.size(F.filter(others, lambda o: partial_match(clean, o)))
    special = F.when(pattern.contains("(") & pattern.contains(")"), 1.1).otherwise(1.0) * F.when(pattern.contains("^") | pattern.contains("$"), 1.05).otherwise(1.0)
    most = lambda c: F.least(c, F.lit(1.0))
    return {
        "ocr": most(ocr * F.when(found > 0.9, 1.05).when(found < 0.7, 0.9).otherwise(1.0) * F.when(given, quality).otherwise(1.0)),
        "spatial": most(F.coalesce(value_confidence, F.lit(0.0)) * F.when(sound, 1.1).otherwise(1.0)),
        "format": F.when(~given, 0.0).when(fits.isNull(), 0.8).when(fits, 1.0).otherwise(0.3),
        "key_importance": F.when(required, 1.0).otherwise(0.7),
        "pattern_specificity": F.when(pattern.isNull(), 0.5).otherwise(most(weight * special)),
        "cross_validation": F.when(~given | (F.coalesce(F.size(others), F.lit(0)) <= 0), 0.0).when(F.array_contains(others, clean), 1.0).when(alike > 0, 0.8 + 0.2 * alike / F.size(others)).otherwise(0.0),
    }


def tax_score(required: Column, year: Column, gross: Column, taxable: Column, authority: Column, confidences: Column, as_of: datetime.date) -> Column:
    """Score of a tax record: 40 for all required fields, 20 for a plausible year, 20 for amounts, 10 for the authority, up to 10 for confidence."""
    number = F.nullif(F.regexp_extract(year, r"^\s*(\d{4})", 1), F.lit("")).cast("int")
    mean = F.aggregate(confidences, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(confidences), F.lit(0))
    parts = [
        F.when(required, 40.0), F.when(number.between(as_of.year - 10, as_of.year), 20.0), F.when((gross > 0) & (taxable > 0) & (taxable <= gross), 20.0),
        F.when(F.coalesce(authority, F.lit("")) != "", 10.0), F.least(F.lit(10.0), mean / 10),
    ]
    return sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))


def postal_code(text: Column, pattern: str = r"\b(\d{5,6})\b") -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))


def clean_address(address: Column, *parts: Column) -> Column:
    """An address without the given parts, each part between commas once, in order."""
    for p in parts:
        address = F.replace(F.lower(address), F.lower(F.coalesce(p, F.lit("\0"))), F.lit(""))
    pieces = F.filter(F.transform(F.split(F.lower(address), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.array_join(F.array_distinct(pieces), ", ")


def metadata_score(editor: Column, device: Column, taken: Column, changed: Column) -> Column:
    """100, less 40 for an editor, 20 without a device, 20 if changed before it was taken, 10 without a time; not below 0."""
    score = F.lit(100) - F.when(F.coalesce(editor, F.lit("")) != "", 40).otherwise(0) - F.when(F.coalesce(device, F.lit("")) == "", 20).otherwise(0)
    return F.greatest(score - F.when(taken.isNull(), 10).when(changed < taken, 20).otherwise(0), F.lit(0))


def rotate(x: Column, y: Column, angle: int) -> tuple[Column, Column]:
    """Coordinates between 0 and 1 after a turn by 0, 90, 180 or 270 degrees clockwise."""
    return {0: (x, y), 90: (1 - y, x), 180: (1 - x, 1 - y), 270: (y, 1 - x)}[angle]
