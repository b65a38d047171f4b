"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Texts are equal when they are identical once the six ASCII white-space characters are deleted. Each map task
first combines its own copies, salted groups are merged after one shuffle, and the winners of the salts are
combined after a second one. All three stages group by the digest and by the full normalised content, so a
digest collision never merges different texts. No stage holds a group's rows together: a group of any size
is one row for each salt after the first combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACES, materialize, small, text_of

#: Equal rows that are given back together.
STRETCH = 10_000


def normalised(text: Column) -> Column:
    """text without the characters of [\\x20\\x09-\\x0D]."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def exact_groups(docs: DataFrame, salts: int = 32, digest_hex: int = 64) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts are one group. Of equal texts the row with the most code points
    stays, then the smallest doc_id; a null doc_id comes after all others. Of rows that repeat the winner's
    doc_id and length exactly one is kept. An empty table gives an empty result; other columns are ignored.
    Texts are grouped by the first `digest_hex` digits of their SHA-256 and by content, so a short digest costs
    time but never changes the groups.
    """
    norm = normalised(F.col("text"))
    keyed = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .select("doc_id", F.char_length("text").alias("len"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), norm.alias("norm"))
        .withColumn("sha", F.sha2("norm", 256))
        .withColumn("key", F.substring("sha", 1, digest_hex))
    )
    # The winner is the largest of (length, ~doc_id); ~ turns the order round and cannot overflow, and null is smallest.
    best = F.struct(F.col("len"), F.bitwise_not("doc_id").alias("not_id"))
    merged = keyed.groupBy("key", "salt", "norm").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n"))
    total = merged.groupBy("key", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    facts = ["key", F.col("best.len").alias("keep_len"), F.bitwise_not("best.not_id").alias("keep_id"), "group_size", "salts"]
    groups = materialize(total.select(*facts), "exact-groups")
    shared = groups.groupBy("key").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("key")

    rows = _counted(keyed, "key")
    if shared.isEmpty():
        return _labelled(rows.join(_by_salt(groups), ["key", "salt"], "left"))
    # Different contents share a digest: their rows are told apart by content, all others by the digest.
    shared = materialize(shared, "exact-shared")
    apart = total.join(shared, "key", "left_semi").select(*facts, "norm")
    plain = rows.join(shared, "key", "left_anti").join(_by_salt(groups.join(shared, "key", "left_anti")), ["key", "salt"], "left")
    close = _counted(keyed.join(shared, "key", "left_semi"), "key", "norm").join(_by_salt(apart, "norm"), ["key", "salt", "norm"], "left").drop("norm")
    return _labelled(plain.unionByName(close.select(plain.columns)))


def _counted(keyed: DataFrame, *content: str) -> DataFrame:
    """Rows that nothing tells apart, as one row with their number: a null or repeated doc_id is no hot key of the joins."""
    return keyed.groupBy("doc_id", "len", "salt", "sha", *content).agg(F.count(F.lit(1)).alias("times"))


def _by_salt(groups: DataFrame, *content: str) -> DataFrame:
    """Groups of two rows or more, once for each salt that has some of their rows: no key of the join is hot."""
    return groups.filter("group_size > 1").select("key", F.explode("salts").alias("salt"), "keep_len", "keep_id", "group_size", *content)


def _labelled(joined: DataFrame) -> DataFrame:
    alone = F.col("group_size").isNull()
    winner = alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len")))
    # Rows that repeat the winner are given back one by one, in stretches of bounded length, and the first is kept.
    stretches = joined.withColumn("past", F.explode(F.expr(f"sequence(0L, times - 1, {STRETCH}L)")))
    return stretches.withColumn("nth", F.explode(F.expr(f"sequence(past + 1, least(times, past + {STRETCH}))"))).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (winner & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_groups does not keep; all columns stay as they are.

    Rows are told apart by doc_id and text digest, so where doc_ids repeat only true copies go; of rows equal in
    both one stays. Texts are not shuffled while what goes is few enough rows to be sent to all tasks.
    """
    flags = materialize(exact_groups(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")), "exact-flags")
    sha = F.sha2(normalised(text_of()), 256)
    whole = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("row_id"), sha.alias("row_sha"), F.char_length(text_of()).alias("len"))
    same = F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_sha") == F.col("text_sha256"))
    left = whole.join(small(flags.filter("not stays").select("doc_id", "text_sha256")), same, "left_anti")
    again = flags.filter("stays and n > 1").select("doc_id", "text_sha256")
    if not again.isEmpty():
        repeats = Window.partitionBy("row_id", "row_sha").orderBy(F.col("len").desc())
        first = left.join(again, same, "left_semi").withColumn("nth", F.row_number().over(repeats)).filter("nth = 1").drop("nth")
        left = left.join(again, same, "left_anti").unionByName(first)
    return left.select("whole.*")
