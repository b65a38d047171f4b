"""Mixing of sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, read once or more. A copy of a document begins and ends
at virtual times: words of its source up to it, divided by the source's target. One global sort by the time of
ending is the mix; it is cut where the words so far reach the budget, and what is in service then is taken as far
as it has been served, so every source is within a word of its target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, slices
from .scans import scan

#: Weights of sources in the order of their names, over and over; share of all words that is wanted; readings of a document at most.
WEIGHTS, SHARE, READINGS = (3, 1, 2), 1.5, 2


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, named (whether there is a source), source and size of every row: words between ASCII white space, of the whole text; null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes = np.fromiter((len(t.split()) if t else 0 for t in part.column(3).to_pylist()), np.int64, part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sizes)], ["doc_id", "named", "source", "size"])

    source = F.col("source").cast("string")
    # Bytes are split at just the six white-space characters.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.isNotNull().cast("long").alias("named"), F.coalesce(source, F.lit("")).alias("source"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, named long, source string, size long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, readings: int = READINGS) -> DataFrame:
    """named, source, weight, source_size and target of each source.

    Sources in the order of their names by code point, null last, weigh weights[0], weights[1], ... over and over. They
    share `share` of all words by weight; a target stops at `readings` times its source's size, and what is over
    is shared again by weight. The level at which that ends is found in one sorted pass: sources that stop are
    those with the least words for their weight.
    """
    each = sizes.groupBy("named", "source").agg(F.sum("size").alias("source_size"))
    ordered = scan(each.select("source", "source_size", (-F.col("named")).alias("last"), F.lit(1).cast("long").alias("one")), [], ["last", "source"], ["one"], label="mix-sources")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod(F.col("sum_one") - 1, F.lit(len(weights))) + 1).cast("int"))
    known = materialize(ordered.select((-F.col("last")).alias("named"), "source", "source_size", weight.alias("weight"), (readings * F.col("source_size")).alias("most")).withColumn("ratio", F.col("most") / F.col("weight")), "mix-known")
    summed = materialize(scan(known, [], ["ratio", "named", "source"], ["most", "weight"], label="mix-levels"), "mix-summed")
    total, heavy = summed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget = share * total
    # Words shared out were the level at this source's ratio: all up to it stop, the others get by weight.
    out = F.col("sum_most") + F.col("ratio") * (F.lit(heavy) - F.col("sum_weight"))
    stopped, weighed = summed.filter(out < budget).agg(F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (budget - stopped) / (heavy - weighed) if heavy > weighed else float("inf")
    target = F.least(F.col("most").cast("double"), F.lit(float(level)) * F.col("weight"))
    return summed.select("named", "source", "weight", "source_size", target.alias("target"))


def shuffled(seed: str, doc_id: Column) -> Column:
    """The key by which documents of a source are shuffled: the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, readings: int = READINGS, seed: str = "0") -> DataFrame:
    """The copies of documents in the order of the mix: doc_id, named, source, nth, size, source_size, target, reading, taken, upto.

    nth numbers the documents of a source in shuffled order; a document that is not taken has one row, of
    reading 0. taken is its words in this copy, and upto the words of the mix up to and with it. docs has doc_id,
    source and text; null text has no words, null sources are one source, rows that repeat are documents of their
    own, an empty table gives an empty result, and other columns are ignored. No source is one task's: what a
    document needs of its source comes to it in the sorted scan that counts the words before it.
    """
    sizes = materialize(sized(docs), "mix-sizes")
    each = materialize(targets(sizes, weights, share, readings), "mix-targets")
    zero = F.lit(0).cast("long")
    # A source's own row stands before its documents in the sort.
    heads = each.select("named", "source", zero.alias("member"), F.lit("").alias("key"), F.lit(None).cast("long").alias("doc_id"), zero.alias("size"), "source_size", "target")
    rows = sizes.select("named", "source", F.lit(1).cast("long").alias("member"), shuffled(seed, F.col("doc_id")).alias("key"), "doc_id", "size", zero.alias("source_size"), F.lit(0.0).alias("target"))
    queued = scan(heads.unionByName(rows), ["named", "source"], ["member", "key", "doc_id", "size"], ["member", "size"], ["source_size", "target"], label="mix-queues").filter("member = 1")
    queued = queued.select("doc_id", "named", "source", F.col("sum_member").alias("nth"), "size", F.col("sum_size").alias("words"), F.col("head_source_size").alias("source_size"), F.col("head_target").alias("target"))
    copies = queued.withColumn("reading", F.explode(F.sequence(F.lit(0), F.lit(readings - 1))))
    before = F.col("reading") * F.col("source_size") + F.col("words") - F.col("size")
    # At virtual time 1 a source has been served its target.
    due = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - before)).cast("long")
    copies = copies.withColumn("served", due).filter("reading = 0 or served > 0")
    ends = F.when(F.col("target") > 0, (before + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    copies = copies.withColumn("ends", F.when(F.col("served") < F.col("size"), F.greatest(ends, F.lit(1.0))).otherwise(ends))
    total = scan(copies, [], ["ends", "named", "source", "nth", "reading"], ["served"], label="mix-order")
    budget = int(share * (sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]))
    over = F.greatest(F.lit(0), F.col("sum_served") - F.lit(budget))
    taken = F.greatest(F.lit(0), F.col("served") - over).cast("long")
    return total.select("doc_id", "named", "source", "nth", "size", "source_size", "target", "reading", taken.alias("taken"), F.least("sum_served", F.lit(budget)).cast("long").alias("upto"))


def taken_words(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, readings: int = READINGS, seed: str = "0") -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs, its copies in the mix together; see mix."""
    rows = mix(docs, weights, share, readings, seed)
    document = ["named", "source", "nth", "doc_id", "size", "source_size", "target"]
    return rows.groupBy(*document).agg(F.sum("taken").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")
