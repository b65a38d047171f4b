"""Metrics of predictions and reports on methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vouch.operators.vectors import running_counts


def _cells(threshold: float) -> list[Column]:
    hit, real = F.col("pred") >= threshold, F.col("target") == 1
    return [F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & ~real).alias("tn"), F.count_if(~hit & real).alias("fn")]


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def _from_cells() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "f1": _share(2 * tp, 2 * tp + fp + fn),
        "iou": _share(tp, tp + fp + fn), "mcc": _share(tp * tn - fp * fn, root), "fpr": _share(fp, fp + tn),
    }


def metrics(df: DataFrame, names: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """The named metrics of pred and target at a threshold, in one aggregation: precision, recall, f1, iou, mcc, fpr."""
    known = _from_cells()
    return df.agg(*_cells(threshold)).select(*[known[n].alias(n) for n in names or known])


def binary_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, IoU and MCC; a metric without a denominator is 0."""
    return metrics(df, ["precision", "recall", "f1", "iou", "mcc"], threshold)


def fpr(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of the negatives that are predicted positive, 0 without negatives."""
    return metrics(df, ["fpr"], threshold)


def roc(df: DataFrame) -> DataFrame:
    """Points of the ROC curve, one for each distinct prediction from the highest: pred, tpr, fpr."""
    steps = df.groupBy("pred").agg(F.count_if(F.col("target") == 1).alias("t"), F.count_if(F.col("target") != 1).alias("f"))
    totals = df.agg(F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") != 1).alias("neg"))
    summed = running_counts(steps, "pred", ["t", "f"], descending=True).crossJoin(F.broadcast(totals))
    return summed.select("pred", F.round(_share(F.col("cum_t").cast("double"), F.col("pos").cast("double")), 6).alias("tpr"), F.round(_share(F.col("cum_f").cast("double"), F.col("neg").cast("double")), 6).alias("fpr"))


def _area(t: Column, below: Column, f: Column) -> Column:
    """Pairs that a group of equal predictions orders rightly: its positives over negatives below, half of those beside."""
    return t * (below + f / 2)


def auroc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve over all rows, 0 with a single class: one row auroc."""
    steps = df.groupBy("pred").agg(F.count_if(F.col("target") == 1).alias("t"), F.count_if(F.col("target") != 1).alias("f"))
    summed = running_counts(steps, "pred", ["f"])
    area = F.sum(_area(F.col("t"), F.col("cum_f") - F.col("f"), F.col("f")))
    return summed.agg(F.round(_share(area.cast("double"), (F.sum("t") * F.sum("f")).cast("double")), 6).alias("auroc"))


def mean_auroc(df: DataFrame) -> DataFrame:
    """Mean over images of each image's area, 0 for an image of a single class: one row mean_auroc."""
    from pyspark.sql import Window

    steps = df.groupBy("image_id", "pred").agg(F.count_if(F.col("target") == 1).alias("t"), F.count_if(F.col("target") != 1).alias("f"))
    below = F.sum("f").over(Window.partitionBy("image_id").orderBy("pred").rowsBetween(Window.unboundedPreceding, -1))
    each = steps.withColumn("below", F.coalesce(below, F.lit(0))).groupBy("image_id").agg(_share(F.sum(_area(F.col("t"), F.col("below"), F.col("f"))).cast("double"), (F.sum("t") * F.sum("f")).cast("double")).alias("a"))
    return each.agg(F.round(F.coalesce(F.avg("a"), F.lit(0.0)), 6).alias("mean_auroc"))


def _soft() -> list[Column]:
    p, y = F.col("pred"), F.col("target").cast("double")
    return [F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"), F.sum((1 - p) * (1 - y)).alias("tn"), F.sum((1 - p) * y).alias("fn")]


def _weighted(df: DataFrame, value: Column, mode: str, name: str) -> DataFrame:
    """mode mean averages the images' values, mode pooled takes the value of all rows together; 0 without rows."""
    if mode == "mean":
        return df.groupBy("image_id").agg(*_soft()).agg(F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6).alias(name))
    return df.agg(*_soft()).select(F.round(F.coalesce(value, F.lit(0.0)), 6).alias(name))


def weighted_f1(df: DataFrame, mode: str = "mean") -> DataFrame:
    """F1 with predictions as weights."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _weighted(df, _share(2 * tp, 2 * tp + fp + fn), mode, "f1_weighted")


def weighted_iou(df: DataFrame, mode: str = "mean") -> DataFrame:
    """Intersection over union with predictions as weights."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _weighted(df, _share(tp, tp + fp + fn), mode, "iou_weighted")


def weighted_mcc(df: DataFrame, mode: str = "mean") -> DataFrame:
    """Matthews correlation with predictions as weights; 1 if all is right, -1 if all is wrong."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    value = F.when((tp + tn != 0) & (fp + fn == 0), 1.0).when((tp + tn == 0) & (fp + fn != 0), -1.0).otherwise(_share(tp * tn - fp * fn, root))
    return _weighted(df, value, mode, "mcc_weighted")


def score_predictions(scores: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """item_id, method, score, is_forged, predicted and correct of scores whose item has a ground truth."""
    joined = scores.join(truth, "item_id")
    predicted = F.col("score") > threshold
    return joined.select("item_id", "method", "score", "is_forged", predicted.alias("predicted"), (predicted == F.col("is_forged")).alias("correct"))


def reference_metrics(scored: DataFrame) -> DataFrame:
    """The approximate metrics of a method: accuracy, which stands for precision, recall and F1 too, and the mean score as AUC."""
    accuracy = F.avg(F.col("correct").cast("double"))
    return scored.groupBy("method").agg(*[F.round(accuracy, 6).alias(n) for n in ("accuracy", "precision", "recall", "f1")], F.round(F.avg("score"), 6).alias("auc"))


def method_report(results: DataFrame) -> DataFrame:
    """For each method mean, population deviation, least and greatest score, mean time, consistency, and rank by mean."""
    from pyspark.sql import Window

    each = results.groupBy("method").agg(
        F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"), F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.avg("processing_time"), 6).alias("time")
    )
    # Methods are few; the window is over one row for each.
    return each.withColumn("consistency", F.round(1 - F.col("std"), 6)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "method")))


def setting_impact(df: DataFrame) -> DataFrame:
    """For each model the greatest difference of accuracy between settings of one detector: model, impact."""
    spread = df.groupBy("model", "detector").agg((F.max("accuracy") - F.min("accuracy")).alias("d"))
    return spread.groupBy("model").agg(F.round(F.max("d"), 6).alias("impact"))


def best_scores(df: DataFrame) -> DataFrame:
    """For each model its best accuracy and the detector that gives it, the first by name of several."""
    best = df.groupBy("model").agg(F.max("accuracy").alias("accuracy"))
    return best.join(df.select("model", "accuracy", "detector"), ["model", "accuracy"]).groupBy("model", "accuracy").agg(F.min("detector").alias("detector"))


def profile_similarity(sample: DataFrame, reference: DataFrame, low: float, high: float, bins: int = 32) -> DataFrame:
    """How alike two columns `value` are distributed: variance ratio, differences of skewness and kurtosis, histogram overlap."""

    def facts(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.var_pop("value").alias(f"var_{tag}"), F.skewness("value").alias(f"skew_{tag}"), F.kurtosis("value").alias(f"kurt_{tag}"), F.count("value").alias(f"n_{tag}"))

    def histogram(df: DataFrame, tag: str) -> DataFrame:
        slot = F.least(F.greatest(F.floor((F.col("value") - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
        return df.filter("value is not null").groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias(f"c_{tag}"))

    both = facts(sample, "a").crossJoin(facts(reference, "b"))
    shared = histogram(sample, "a").join(histogram(reference, "b"), "slot").crossJoin(F.broadcast(both))
    overlap = F.sum(F.least(F.col("c_a") / F.col("n_a"), F.col("c_b") / F.col("n_b")))
    return both.crossJoin(shared.agg(F.coalesce(overlap, F.lit(0.0)).alias("overlap"))).select(
        F.round(F.least("var_a", "var_b") / F.greatest("var_a", "var_b"), 6).alias("variance_ratio"), F.round(F.abs(F.col("skew_a") - F.col("skew_b")), 4).alias("skew_difference"), F.round(F.abs(F.col("kurt_a") - F.col("kurt_b")), 4).alias("kurtosis_difference"), F.round("overlap", 6).alias("overlap")
    )


#: Weights of the parts of aligned_similarity: correlation, texture, histogram.
ALIKE = {"correlation": 1.0, "texture": 1.0, "histogram": 1.0}


def aligned_similarity(pairs: DataFrame, low: float, high: float, weights: dict[str, float] | None = None, bins: int = 32, least: int = 100) -> DataFrame:
    """How alike two columns a and b are, row by row and as distributions: correlation, texture, histogram, overall.

    correlation is Pearson's, moved to 0 to 1; texture the mean of the variances' ratio and of what the differences
    of skewness and excess kurtosis, up to 2 and 10, leave of 1; histogram the overlap of `bins` shares; overall their
    weighted mean. With fewer than `least` rows, or (correlation) without spread, each is 0.5.
    """
    both = pairs.filter("a is not null and b is not null")
    weights = weights or ALIKE
    slot = lambda c: F.least(F.floor((F.col(c) - low) / (high - low) * bins), F.lit(bins - 1))
    inside = lambda c: F.col(c).between(low, high)
    facts = both.agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("r"), *[f(c).alias(f"{name}_{c}") for c in ("a", "b") for name, f in (("var", F.var_pop), ("skew", F.skewness), ("kurt", F.kurtosis))])
    counts = [both.filter(inside(c)).select(slot(c).alias("slot"), F.lit(c).alias("side")) for c in ("a", "b")]
    shares = counts[0].unionByName(counts[1]).groupBy("slot").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    # One row for each bin: the totals of all bins are a window over at most `bins` rows.
    total = Window.partitionBy(F.lit(1))
    overlap = shares.withColumn("ta", F.sum("a").over(total)).withColumn("tb", F.sum("b").over(total)).agg(F.sum(F.least(F.col("a") / F.col("ta"), F.col("b") / F.col("tb"))).alias("overlap"))
    enough = F.col("n") >= least
    texture = (F.least("var_a", "var_b") / (F.greatest("var_a", "var_b") + 1e-10) + 1 - F.least(F.abs(F.col("skew_a") - F.col("skew_b")), F.lit(2.0)) / 2 + 1 - F.least(F.abs(F.col("kurt_a") - F.col("kurt_b")), F.lit(10.0)) / 10) / 3
    spread = (F.col("var_a") > 1e-20) & (F.col("var_b") > 1e-20)
    parts = {"correlation": F.when(enough & spread, (F.col("r") + 1) / 2), "texture": F.when(enough, texture), "histogram": F.when(enough, F.coalesce("overlap", F.lit(0.0)))}
    parts = {k: F.coalesce(v, F.lit(0.5)) for k, v in parts.items()}
    overall = sum((v * weights.get(k, 0.0) for k, v in parts.items()), F.lit(0.0)) / (sum(weights.get(k, 0.0) for k in parts) or 1.0)
    return facts.crossJoin(overlap).select(*[F.round(v, 6).alias(k) for k, v in parts.items()], F.round(overall, 6).alias("overall"))
