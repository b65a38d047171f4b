"""Stores of embedding vectors and their index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Columns that a vector store is partitioned by; a read for one configuration prunes to its folders.
CONFIGURATION = ["model_name", "detector_backend", "aligned", "l2_normalized"]


def write_embeddings(df: DataFrame, path: str) -> None:
    """Appends vectors to a store, partitioned by configuration."""
    df.write.mode("append").partitionBy(*CONFIGURATION).parquet(path)


def read_embeddings(spark: SparkSession, path: str, **configuration) -> DataFrame:
    """Vectors of one configuration; a column that is not given is not filtered."""
    store = spark.read.parquet(path)
    for name, value in configuration.items():
        store = store.filter(F.col(name) == value)
    return store


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("face_hash", F.sha2("face", 256)).withColumn("embedding_hash", F.sha2(F.to_json(F.struct("embedding")), 256))


def register_embeddings(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New vectors to append, and those left out as duplicates; unique by the hashes of face and vector.

    Both sides have vec_id, face and embedding; of equal new vectors the smallest vec_id is taken.
    """
    hashes = ["face_hash", "embedding_hash"]
    coming = _hashed(new)
    first = coming.groupBy(*hashes).agg(F.min("vec_id").alias("vec_id"))
    fresh = coming.join(first, [*hashes, "vec_id"], "left_semi").join(_hashed(existing).select(*hashes).distinct(), hashes, "left_anti")
    return fresh, coming.join(fresh.select("vec_id"), "vec_id", "left_anti")


def write_index(buckets: DataFrame, path: str, configuration: dict) -> None:
    """Replaces the bucket table of one configuration and leaves the others as they are."""
    for name, value in configuration.items():
        buckets = buckets.withColumn(name, F.lit(value))
    buckets.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*configuration).parquet(path)
