"""Inputs of the queries, derived from the given tables; the same derivations as SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from vouch.functions import names
from vouch.sources.scratch import exists, scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the people of a folder are written, by application and folder: screening reads them several times in one query.
_WRITTEN: dict[tuple[str, str], str] = {}


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person for each document, as described below; written once in an application, and again if the table is gone."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN or not exists(spark, f"{_WRITTEN[key]}/_SUCCESS"):
        path = f"{scratch_dir(spark)}/people-{uuid.uuid4().hex}"
        derived_people(spark, sf_dir).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def derived_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person for each document: its first four words as name, a nation, a date of birth, its source as list."""
    docs = table(spark, sf_dir, "documents")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("country"))
    # Up to four words from the beginning of a text; what comes after is not looked at.
    head = F.regexp_extract("text", r"^\P{L}*(\p{L}+(?:\P{L}+\p{L}+){0,3})", 1)
    words = F.when(F.col("text").isNotNull(), F.regexp_replace(head, r"\P{L}+", " "))
    born = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("doc_id") * 37 % 20000).cast("int"))
    who = docs.select("doc_id", names.strip_accents(words).alias("name"), (F.col("doc_id") % 25).alias("k"), born.cast("string").alias("dob"), "source")
    # Nations are a fixed list.
    return who.join(F.broadcast(nation), "k", "left").drop("k")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with even numbers; every third lacks a date of birth, every fifth a country."""
    who = people(spark, sf_dir).filter("doc_id % 2 = 0")
    return who.select(
        F.col("doc_id").alias("subject_id"),
        F.col("name").alias("full_name"),
        F.when(F.col("doc_id") % 3 != 0, F.col("dob")).alias("date_of_birth"),
        F.when(F.col("doc_id") % 5 != 0, F.col("country")).alias("country"),
    )


def watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with odd numbers as list entries: some births as a year, some as a range, some countries missing or two."""
    who = people(spark, sf_dir).filter("doc_id % 2 = 1")
    year = F.substring("dob", 1, 4)
    kind = F.col("doc_id") % 7
    birth = F.when(kind == 0, year).when(kind == 1, F.concat(year, F.lit(" to "), (year.cast("int") + 5).cast("string"))).when(kind != 2, F.col("dob"))
    return who.select(
        F.col("doc_id").alias("entry_id"),
        F.col("source").alias("source_key"),
        "name",
        F.lower(F.trim("name")).alias("normalized_name"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("financial_crime")).when(F.col("doc_id") % 11 == 1, F.lit("corruption")).otherwise(F.lit("other")).alias("crime_type"),
        birth.alias("birth_date"),
        year.cast("int").alias("birth_year"),
        F.when(F.col("doc_id") % 9 != 0, F.when(F.col("doc_id") % 4 == 3, F.concat("country", F.lit(";atlantis"))).otherwise(F.col("country"))).alias("countries"),
    )


def pep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with odd numbers as holders of offices, current and former."""
    who = people(spark, sf_dir).filter("doc_id % 2 = 1")
    return who.select(
        F.col("doc_id").alias("entry_id"),
        F.col("source").alias("source_key"),
        "name",
        F.lower(F.trim("name")).alias("normalized_name"),
        F.concat(F.lit("office "), (F.col("doc_id") % 6).cast("string")).alias("position"),
        "country",
        F.when(F.col("doc_id") % 7 != 2, F.substring("dob", 1, 4).cast("int")).alias("birth_year"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("current")).otherwise(F.lit("former")).alias("status"),
    )


#: The same tables as common table expressions; every one may be followed by others.
SQL = r"""
people AS (
    SELECT doc_id, strip_accents(array_to_string(regexp_extract_all(text, '\p{L}+')[1:4], ' ')) AS name,
           CAST(DATE '1950-01-01' + CAST(doc_id * 37 % 20000 AS INTEGER) AS VARCHAR) AS dob, source, lower(n_name) AS country
    FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 25),
subjects AS (
    SELECT doc_id AS subject_id, name AS full_name, CASE WHEN doc_id % 3 <> 0 THEN dob END AS date_of_birth,
           CASE WHEN doc_id % 5 <> 0 THEN country END AS country
    FROM people WHERE doc_id % 2 = 0),
watch AS (
    SELECT doc_id AS entry_id, source AS source_key, name, lower(trim(name)) AS normalized_name,
           CASE doc_id % 11 WHEN 0 THEN 'financial_crime' WHEN 1 THEN 'corruption' ELSE 'other' END AS crime_type,
           CASE WHEN doc_id % 7 = 0 THEN dob[1:4] WHEN doc_id % 7 = 1 THEN dob[1:4] || ' to ' || (CAST(dob[1:4] AS INTEGER) + 5) WHEN doc_id % 7 <> 2 THEN dob END AS birth_date,
           CAST(dob[1:4] AS INTEGER) AS birth_year,
           CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN doc_id % 4 = 3 THEN country || ';atlantis' ELSE country END END AS countries
    FROM people WHERE doc_id % 2 = 1),
pep AS (
    SELECT doc_id AS entry_id, source AS source_key, name, lower(trim(name)) AS normalized_name, 'office ' || (doc_id % 6) AS position, country,
           CASE WHEN doc_id % 7 <> 2 THEN CAST(dob[1:4] AS INTEGER) END AS birth_year,
           CASE WHEN doc_id % 3 = 0 THEN 'current' ELSE 'former' END AS status
    FROM people WHERE doc_id % 2 = 1),
stok AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(full_name), '\s+'), lambda t: t <> '')) AS st FROM subjects),
wtok AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(name), '\s+'), lambda t: t <> '')) AS wt FROM watch),
ptok AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(name), '\s+'), lambda t: t <> '')) AS wt FROM pep)
"""
