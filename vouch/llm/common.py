"""Helpers shared by the operators of this package: columns, scratch tables, Arrow batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space that the contracts name: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Maps A-Z to a-z and leaves every other byte alone.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of UTF-8 text to lower-case words: ASCII letters, digits and all non-ASCII bytes stay, the rest become spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def text_of(name: str = "text") -> Column:
    """A text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, a folder under /tmp for a local
    master alone, since there the driver is the only machine; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/vouch-scratch"


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one, for this package alone."""
    return f"{shared_dir(spark)}/vouch-llm-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared scratch folder: lineage is cut, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a lookup table up to which it is sent to all tasks; beyond, the join is by hash.
SMALL = 200_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, marked for broadcast if it has few enough rows; it should be written already, for it is counted here."""
    return F.broadcast(df) if df.count() <= rows else df


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a table has been written there to its end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def discard(df: DataFrame) -> None:
    """Deletes the scratch table that df, a result of materialize, reads; nothing may still depend on it."""
    files = df.inputFiles()
    if files:
        folder = files[0].rsplit("/", 1)[0]
        if not folder.rsplit("/", 2)[-2].startswith("vouch-"):
            raise ValueError(f"{folder} is no scratch table")
        _remove(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Deletes this application's scratch tables of this package; results that still read them must be written first."""
    _remove(spark, scratch_dir(spark))


#: Parts into which the rows of one key are dealt in joins, so that a key with a third of all rows is no single task's.
SALTS = 32


def with_range(rows: DataFrame, key: str, spread: str, *values: str, salts: int = SALTS) -> DataFrame:
    """rows with low_v and high_v for each v of `values`: the least and the greatest of each key.

    Parts of a key, dealt by a hash of `spread`, are aggregated first and combined then; the results go back to
    each part, so no key's rows meet in one task. Rows with a null key are left out.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(*[how(v).alias(f"{side}_{v}") for v in values for side, how in (("low", F.min), ("high", F.max))])
    both = [how(f"{side}_{v}").alias(f"{side}_{v}") for v in values for side, how in (("low", F.min), ("high", F.max))]
    whole = parts.groupBy(key).agg(*both, F.collect_set("salt").alias("salts"))
    return salted.join(whole.withColumn("salt", F.explode("salts")).drop("salts"), [key, "salt"]).drop("salt")


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches cut small, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def held_out(column: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo folds, is fold. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(folds)) == fold


def sampled(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` rows, those of the least hashes of `key`, the same ones on every run.

    Hashes above twice the share that is wanted are left out before the sort, so that tasks do not each pass
    `bound` rows on.
    """
    digest = F.xxhash64(key)
    share = 2.0 * bound / max(1, rows.count())
    if share < 1.0:
        rows = rows.filter(digest < F.lit(int((2 * share - 1) * 2**63)))
    return rows.orderBy(digest, key).limit(bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, bound: int) -> DataFrame:
    """doc_id and label of at most `bound` labelled documents outside the held-out fold, the same ones on every run.

    Null ids and labels, and labels of documents that docs does not have, are left out; of repeated ids the largest
    label counts.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(~held_out(F.col("doc_id"), folds, fold))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    present = one.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    return sampled(materialize(present, "labelled"), "doc_id", bound)
