"""Column functions for names: tokens, normal forms, Jaro-Winkler similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Latin letters with one accent or more, and their base letters, by Unicode decomposition.
ACCENTED = {chr(c): base for c in range(0xC0, 0x250) if (base := unicodedata.normalize("NFD", chr(c))[0]) != chr(c)}
#: Titles that are no part of a name: fixed values.
TITLES = r"\b(H\.E\.|Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s?"


def strip_accents(text: Column) -> Column:
    """Text without the accents of Latin letters and without combining marks."""
    return F.regexp_replace(F.translate(text, "".join(ACCENTED), "".join(ACCENTED.values())), r"\p{Mn}", "")


def name_tokens(name: Column) -> Column:
    """Distinct lower-case words of a name in either order, without accents, titles and commas; null gives none."""
    plain = F.regexp_replace(strip_accents(F.coalesce(name, F.lit(""))), TITLES, "")
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(plain, ",", " ")), r"\s+"), lambda t: t != ""))


def token_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of the intersection and the union of two token sets."""
    both = F.size(F.array_intersect(a, b))
    return both, F.size(a) + F.size(b) - both


def token_score(a: Column, b: Column) -> Column:
    """0.7 of the share of a's tokens found and 0.3 of the Jaccard similarity; 0 where either has none."""
    both, either = token_overlap(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(a) * 0.7 + both / either * 0.3)


def token_bound(most: Column, a: Column, b: Column) -> Column:
    """The greatest score of sets of a and b tokens that have `most` in common."""
    return most / a * 0.7 + most / (a + b - most) * 0.3 + 1e-9


def for_matching(name: Column) -> Column:
    """Lower case with the marks , . - _ ' " ` / and white space as single spaces, trimmed; null gives the empty text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[,.\-_'\"`/\s]+", " "))


def alphanumeric(name: Column) -> Column:
    """Only letters, digits and white space, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}\s]", ""))


#: Titles and honorifics that a stored name may begin with: fixed values.
HONORIFICS = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Rev", "Hon", "Sr", "Jr", "Smt", "Shri", "Kum", "Sri", "Shrimati"]


def clean_name(name: Column) -> Column:
    """A name as it is stored: honorifics and `null` at its start go, marks such as S/O between two names too; empty gives null.

    An honorific ends at a dot or a space, so that names which only begin like one stay whole.
    """
    text = F.trim(F.coalesce(name, F.lit("")))
    text = F.regexp_replace(text, rf"(?i)^((?:{'|'.join(sorted(HONORIFICS, key=len, reverse=True))})(?:\.\s*|\s+))+", "")
    text = F.regexp_replace(text, r"(?i)^null\s+", "")
    text = F.regexp_replace(text, r"(?i)\s+(?:S/O|D/O|A/L|B/O)(?:\.\s*|\s+)", " ")
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(hits, (c for c, unused in zip(b, free) if not unused))) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity; a null counts as empty. Spark has no built-in for it, so pairs go through Arrow."""
    return pd.Series([_jaro(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def jaro_winkler(a: Column, b: Column, scale: float = 0.1) -> Column:
    """Jaro similarity raised for a common beginning of up to four letters, upper and lower case alike, at any score."""
    same = F.lit(0)
    for n in range(4, 0, -1):
        same = F.when((F.lower(F.left(a, F.lit(n))) == F.lower(F.left(b, F.lit(n)))) & (F.length(a) >= n) & (F.length(b) >= n) & (same == 0), F.lit(n)).otherwise(same)
    score = jaro(a, b)
    return F.least(score + same * F.lit(scale) * (1 - score), F.lit(1.0))


def fuzzy_names(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity of two names in their matching form, with four decimals."""
    return F.round(jaro_winkler(for_matching(a), for_matching(b)), 4)


def name_similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity of two names without punctuation."""
    return jaro_winkler(alphanumeric(a), alphanumeric(b))
