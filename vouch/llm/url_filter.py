"""URL filters as a sort-merge range join of pages with nested host rules.

A host is turned round label by label (`a.example.net` becomes `net.example.a.`), so a rule's host is a prefix
of the keys of itself and all its subdomains: an interval of the sorted keys. Intervals of such prefixes are
nested or apart. Pages are dealt by ranges of (key, path, id); each range sweeps its sorted pages and rules
together and keeps the rules whose interval holds the present key on a stack. The rules of one host that
differ in their path lie in one stack entry; the longest whose path fits is taken, from the top down. Rows are
read as sorted Arrow batches, so a task holds one batch and the stack, whatever the size of its range.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Host, path and verdict of the rules used by default.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Sampled keys for each range, from which the ranges' bounds are taken.
SAMPLE = 40
#: Sorts after every character of a key.
LAST = "\U0010ffff"
OUT = "page_id long, host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty where it is null or has no `://`. Only A-Z is lower-cased."""
    rest = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, rest, n), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def host_key(host: Column) -> Column:
    """Labels of a host in reverse, each followed by a dot; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Sweep:
    """Verdicts along the sorted rows of one range after another: active rules on a stack, rules before pages."""

    def __init__(self, default: str):
        self.default, self.range, self.stack = default, None, []

    def verdict(self, at: int, key: str, path: str, rule: str | None, verdict: str | None) -> tuple[str | None, str] | None:
        """Takes the next row: a rule (no result) or a page."""
        if at != self.range:
            self.range, self.stack = at, []
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        if rule is not None:
            if not self.stack or self.stack[-1][0] != key:
                self.stack.append((key, []))
            self.stack[-1][1].append((len(path), path, rule, verdict))
            return None
        for _, rules in reversed(self.stack):
            fits = [r for r in rules if path.startswith(r[1])]
            if fits:
                return max(fits)[2:]
        return None, self.default

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("range", "key", "path", "rule", "verdict")]
            found = [self.verdict(*row) for row in zip(*columns)]
            pages = [i for i, f in enumerate(found) if f is not None]
            kept = batch.take(pa.array(pages, pa.int64()))
            told = [pa.array([found[i][k] for i in pages], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("page_id", "host", "path")), *told], ["page_id", "host", "path", "rule", "verdict"])


def url_verdicts(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """The longest rule that fits each page's url: page_id, host, path, rule, verdict.

    `rules` has host, path and verdict; a rule fits its host and all subdomains where the url's path starts
    with the rule's, and of several the one of the longest host, then path, wins (of equal ones with different
    verdicts, block). Pages without a rule get `default`. Null urls have an empty host and path; rules with a
    null in host or path are ignored. Every row of pages gives one row, repeated ones too; an empty table gives
    an empty result; a url of any length is one row. Other columns are ignored. `ranges` is the number of ranges
    that pages are dealt into, that of shuffle partitions by default; memory does not depend on it.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("url"))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("key", host_key(F.col("host"))).withColumn("tie", F.xxhash64("page_id", F.lit(3)))

    # Bounds of the ranges: a sample of SAMPLE keys for each, so that what is collected depends on their number alone.
    bounds = []
    if ranges > 1:
        share = min(1.0, SAMPLE * ranges / max(1, pages.count()))
        taken = sorted(tuple(r) for r in keyed.filter(F.rand(7) < share).select("key", "path", "tie").limit(4 * SAMPLE * ranges).collect())
        bounds = sorted({taken[i * len(taken) // ranges] for i in range(1, ranges)}) if taken else []
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, path: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(shared.value, x) for x in zip(key, path, tie)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(key: pd.Series) -> pd.Series:
        first = [bisect_right(shared.value, (k, "", -(2**63))) for k in key]
        last = [bisect_left(shared.value, (k + LAST, "", -(2**63))) for k in key]
        return pd.Series([np.arange(a, b + 1, dtype="int32") for a, b in zip(first, last)])

    usable = rules.select("host", "path", "verdict").filter("host is not null and path is not null")
    lowered = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = usable.select(host_key(lowered).alias("key"), "path", F.concat(lowered, F.col("path")).alias("rule"), "verdict")
    one = named.groupBy("key", "path", "rule").agg(F.max("verdict").alias("verdict"))
    # A rule goes to every range that its interval meets: one or two, but for those of a large host's few rules.
    opened = one.select(F.explode(ranges_of("key")).alias("range"), F.lit(0).alias("page"), "key", "path", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"), "rule", "verdict")
    dealt = keyed.select(range_of("key", "path", "tie").alias("range"), F.lit(1).alias("page"), "key", "path", "page_id", "host", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    # Each range is one partition; its rows come sorted, a rule before the pages of its own key.
    lined = opened.unionByName(dealt).repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key", "page", "path")
    return lined.mapInArrow(lambda batches: Sweep(default).run(batches), OUT)
