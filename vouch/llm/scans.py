"""Running sums over sorted rows, in which no key is ever the rows of one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import materialize


def _scanned(batches: Iterator[pa.RecordBatch], keys: list[int], sums: list[int], heads: list[int], schema: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range with row number, whether the range begins with their key, sums and heads so far."""
    last, done, seen = None, 0, 0
    total, held = [0] * len(sums), [0] * len(heads)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, dtype=bool)
        for k in keys:
            c = batch.column(k)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = tuple(batch.column(k)[0].as_py() for k in keys) != last
        last = tuple(batch.column(k)[n - 1].as_py() for k in keys)
        part, starts = np.cumsum(new), np.flatnonzero(new)
        added = [pa.array(np.arange(done, done + n)), pa.array(seen + part == 1)]
        for i, k in enumerate(sums):
            v = batch.column(k).to_numpy(zero_copy_only=False)
            c = np.cumsum(v)
            own = c - np.r_[-total[i], c[starts] - v[starts]][part]
            total[i] = own[-1]
            added.append(pa.array(own))
        for i, k in enumerate(heads):
            v = batch.column(k).to_numpy(zero_copy_only=False)
            own = np.r_[np.array([held[i]], dtype=v.dtype), v[starts]][part]
            held[i] = own[-1]
            added.append(pa.array(own))
        done, seen = done + n, seen + int(part[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema)


def scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), heads: Sequence[str] = (), label: str = "scan") -> DataFrame:
    """rows with sum_v, the sum of v over the rows of the same keys up to and with this one in `order`, and head_v, the key's first v.

    keys and order must not be null but for columns of order that are no keys; sums are of longs, heads of longs or
    doubles, neither null. Rows are dealt by ranges of keys and order and written with the sums of their own range.
    What a range must add is the end of the ranges before it, one row each, which the driver adds up: it grows with
    the number of partitions alone. A key of any size thus spreads over many ranges.
    """
    spark = rows.sparkSession
    names = [*rows.columns, "scan_part", "scan_nth", "scan_lead", *[f"sum_{v}" for v in sums], *[f"head_{v}" for v in heads]]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    added = [StructField("scan_part", LongType()), StructField("scan_nth", LongType()), StructField("scan_lead", BooleanType())]
    added += [StructField(f"sum_{v}", LongType()) for v in sums] + [StructField(f"head_{v}", kinds[v]) for v in heads]
    place = {c: i for i, c in enumerate(rows.columns)}
    at = [[place[c] for c in them] for them in (keys, sums, heads)]
    by = [*keys, *[c for c in order if c not in keys]]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("scan_part", F.spark_partition_id().cast("long"))
    ranged = materialize(dealt.mapInArrow(lambda b: _scanned(b, *at, names), StructType([*rows.schema.fields, *added])), label)

    carried = [f"sum_{v}" for v in sums] + [f"head_{v}" for v in heads]
    end = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *carried, "scan_lead")
    start = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(1).alias("one"))
    ends = ranged.groupBy("scan_part").agg(F.max_by(end, "scan_nth").alias("end"), F.min_by(start, "scan_nth").alias("start")).collect()
    before, rest = None, []
    for row in sorted(ends):
        first, last = tuple(row.start)[: len(keys)], tuple(row.end)[: len(keys)]
        goes_on = before is not None and before[0] == first
        carry = before[1] if goes_on else None
        if goes_on:
            rest.append((row.scan_part, *carry))
        now = [row.end[c] for c in carried]
        if goes_on and row.end["scan_lead"]:
            now = [a + b for a, b in zip(carry[: len(sums)], now)] + list(carry[len(sums) :])
        before = (last, now)
    out = [c for c in ranged.columns if not c.startswith("scan_")]
    if not rest:
        return ranged.select(*out)
    more = spark.createDataFrame(rest, StructType([StructField("scan_part", LongType()), *[StructField(f"more_{c}", ranged.schema[c].dataType) for c in carried]]))
    met = ranged.join(F.broadcast(more), "scan_part", "left")  # one row for each range at most
    lead = F.col("scan_lead") & F.col(f"more_{carried[0]}").isNotNull()
    told = {f"sum_{v}": F.when(lead, F.col(f"sum_{v}") + F.col(f"more_sum_{v}")).otherwise(F.col(f"sum_{v}")) for v in sums}
    told |= {f"head_{v}": F.when(lead, F.col(f"more_head_{v}")).otherwise(F.col(f"head_{v}")) for v in heads}
    return met.withColumns(told).select(*out)
