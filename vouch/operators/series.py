"""Ordered series: runs of equal values, decoded codes, order of dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def with_runs(frames: DataFrame, key: str = "video_id", order: str = "frame_idx", value: str = "value") -> DataFrame:
    """Adds run, the number of the run of equal values that a frame is in."""
    by = Window.partitionBy(key).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(by))).cast("int")
    return frames.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(by)).drop("_changed")


def stable_runs(frames: DataFrame, n: int = 3) -> DataFrame:
    """Frames (video_id, frame_idx, value, confidence) that are in a run of n equal values or more."""
    runs = with_runs(frames)
    size = F.count(F.lit(1)).over(Window.partitionBy("video_id", "run"))
    return runs.withColumn("size", size).filter(F.col("size") >= n).drop("size")


def segments(frames: DataFrame, n: int = 3, fps: float = 30.0) -> DataFrame:
    """Stable runs as segments: video_id, run, value, first, last, seconds, confidence; a value below 0 is no segment."""
    return stable_runs(frames, n).filter("value >= 0").groupBy("video_id", "run").agg(
        F.first("value").alias("value"), F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), F.round(F.count(F.lit(1)) / fps, 4).alias("seconds"), F.avg("confidence").alias("confidence")
    )


def decode(segments_: DataFrame, length: int | None = None) -> DataFrame:
    """The code that a video's segments spell: video_id, code, confidence, valid (of the right length where given)."""
    out = segments_.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("run", F.col("value").cast("string").alias("v")))).alias("s"), F.round(F.avg("confidence"), 6).alias("confidence"))
    code = F.array_join(F.transform("s", lambda x: x["v"]), "")
    valid = (F.length("code") == length) if length is not None else F.length("code") > 0
    return out.select("video_id", code.alias("code"), "confidence").withColumn("valid", valid)


def date_sequence_ok(transactions: DataFrame, key: str = "doc_id", order: str = "nth", date: str = "date") -> DataFrame:
    """For each key the number of dates that lie before the one before them, and whether these are few: one, or a tenth."""
    by = Window.partitionBy(key).orderBy(order)
    back = (F.to_date(date) < F.to_date(F.lag(date).over(by))).cast("int")
    counted = transactions.filter(F.col(date).isNotNull()).withColumn("_back", F.coalesce(back, F.lit(0))).groupBy(key).agg(F.sum("_back").alias("inversions"), F.count(F.lit(1)).alias("n"))
    return counted.select(key, "inversions", (F.col("inversions") <= F.greatest(F.lit(1.0), F.col("n") * 0.1)).alias("ok"))
