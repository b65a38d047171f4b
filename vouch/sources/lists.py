"""Reading watch lists, office lists, vectors, pairs and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_watch(spark: SparkSession, path: str, source_key: str | None = None) -> DataFrame:
    """A watch list stored as Parquet; the filter on the source reaches the scan."""
    entries = spark.read.parquet(path)
    return entries if source_key is None else entries.filter(F.col("source_key") == source_key)


def read_pep(spark: SparkSession, path: str, source_key: str | None = None) -> DataFrame:
    """A list of office holders, read as read_watch does."""
    return read_watch(spark, path, source_key)


def source_counts(entries: DataFrame) -> DataFrame:
    """Entries of each source."""
    return entries.groupBy("source_key").agg(F.count(F.lit(1)).alias("entries"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs from CSV with a header: file_x, file_y, decision (Yes or No). Quotes inside a field are doubled."""
    return spark.read.csv(path, header=True, escape='"', schema="file_x string, file_y string, decision string")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects of items and their annotations as rows: item_id, annotation (its JSON text).

    A file holds one object on each line, so a large one is read by many tasks; a single object over several lines is
    read by read_ground_truth_file.
    """
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("item_id", "annotation"))


def read_ground_truth_file(spark: SparkSession, path: str) -> DataFrame:
    """read_ground_truth for files that are one object each, of as many lines as it takes; a file is one row."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("item_id", "annotation"))


def read_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects of kinds and their terms, one on each line, as rows: kind, term in lower case."""
    kinds = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("kind", "terms"))
    return kinds.select("kind", F.explode("terms").alias("term")).select("kind", F.lower("term").alias("term")).distinct()


def file_inventory(spark: SparkSession, path: str, largest: int = 256 * 2**20) -> DataFrame:
    """Every file below a folder with its length, extension and the SHA-256 of its content; files of over `largest` bytes have none.

    Spark hands a file over as one value, so its size is bounded; the paths and lengths of larger ones are told all the same.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    every = files.select("path", "length")
    hashes = files.filter(F.col("length") <= largest).select("path", F.sha2("content", 256).alias("hash"))
    return every.join(hashes, "path", "left").select("path", "length", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "hash")
