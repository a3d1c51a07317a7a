"""Forecast accuracy and classification scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aisle.functions.exprs import beside, ratio
from aisle.operators.ordering import exact_percentiles, running_totals
from aisle.session import checkpointed


def _error(actual: str, prediction: str) -> Column:
    return F.abs(F.col(prediction) - F.col(actual))


def accuracy(actual: str, prediction: str) -> list[Column]:
    """Forecast accuracy 1 − Σ|p−a|/Σa and bias Σ(p−a)/Σa; null where nothing was sold."""
    return [
        (1 - ratio(F.sum(_error(actual, prediction)), F.sum(actual))).alias("fa"),
        ratio(F.sum(F.col(prediction) - F.col(actual)), F.sum(actual)).alias("fb"),
    ]


def accuracy_by(df: DataFrame, keys: Sequence[str], actual: str, prediction: str) -> DataFrame:
    return df.groupBy(*keys).agg(*accuracy(actual, prediction))


def row_accuracy(actual: str, prediction: str) -> Column:
    """Accuracy of one row; a zero actual is divided by actual + 1."""
    a = F.col(actual)
    return 1 - _error(actual, prediction) / F.when(a == 0, a + 1).otherwise(a)


def method_table(df: DataFrame, keys: Sequence[str], actual: str, methods: Sequence[str]) -> DataFrame:
    """Accuracy, error, sums, MAE and RMSE per key and method."""
    long = df.unpivot([*keys, actual], list(methods), "method", "prediction")
    miss = F.coalesce("prediction", F.lit(0.0)) - F.col(actual)
    return long.groupBy(*keys, "method").agg(
        (1 - ratio(F.sum(F.abs(miss)), F.sum(actual))).alias("fa"), F.sum(F.abs(miss)).alias("error"),
        F.sum(actual).alias("sum_actual"), F.sum("prediction").alias("sum_predict"), F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"))


def best_method(table: DataFrame, keys: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """Method with the highest positive accuracy per key, else BLANK.

    Accuracies equal to nine digits count as equal; the first listed method wins.
    """
    place = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    candidate = F.struct(F.round("fa", 9).alias("fa"), (-place).alias("place"), F.col("method").alias("method"))
    best = table.groupBy(*keys).agg(F.max(F.when(F.col("fa") > 0, candidate)).alias("best"))
    return best.select(
        *keys, F.coalesce("best.method", F.lit("BLANK")).alias("method"), F.coalesce("best.fa", F.lit(0.0)).alias("fa"))


def with_best_method(df: DataFrame, keys: Sequence[str], actual: str, methods: Sequence[str]) -> DataFrame:
    """``df`` with the ``method`` and ``fa`` that ``best_method`` gives its key, from windows over the key."""
    whole = Window.partitionBy(*keys)
    total = F.sum(actual).over(whole)
    scored = df.select("*", *[
        F.round(1 - ratio(F.sum(F.abs(F.coalesce(m, F.lit(0.0)) - F.col(actual))).over(whole), total), 9).alias(f"_fa_{m}")
        for m in methods])
    best = F.array_max(F.array(*[
        F.when(F.col(f"_fa_{m}") > 0, F.struct(F.col(f"_fa_{m}").alias("fa"), F.lit(-i).alias("place"), F.lit(m).alias("method")))
        for i, m in enumerate(methods)]))
    return scored.withColumn("_best", best).select(
        *df.columns, F.coalesce("_best.method", F.lit("BLANK")).alias("method"),
        F.coalesce("_best.fa", F.lit(0.0)).alias("fa"))


def bias_report(df: DataFrame, segment: Column, actual: str, prediction: str) -> DataFrame:
    """Rows, volume, share, means and the negative and positive bias per segment."""
    gap = F.col(prediction) - F.col(actual)
    grouped = df.groupBy(segment.alias("segment")).agg(
        F.count(actual).alias("records"), F.sum(actual).alias("volume"), F.avg(actual).alias("mean_actual"),
        F.avg(prediction).alias("mean_predicted"), F.sum(F.least(gap, F.lit(0.0))).alias("negative_bias"),
        F.sum(F.greatest(gap, F.lit(0.0))).alias("positive_bias"))
    total = grouped.agg(F.sum("volume").alias("_total"))
    return beside(grouped, total).select(
        *grouped.columns, ratio("volume", "_total").alias("contribution"))


def accuracy_matrix(
    df: DataFrame, keys: Sequence[str], bucket: str, buckets: Sequence, actual: str, prediction: str
) -> DataFrame:
    """Accuracy (``fa``) and bias (``fb``) with one column of each per bucket."""
    here = lambda b, c: F.sum(F.when(F.col(bucket) == b, c))
    miss, sold = F.col(prediction) - F.col(actual), F.col(actual)
    return df.groupBy(*keys).agg(
        *[(1 - ratio(here(b, _error(actual, prediction)), here(b, sold))).alias(f"fa_{b}") for b in buckets],
        *[ratio(here(b, miss), here(b, sold)).alias(f"fb_{b}") for b in buckets])


def accuracy_levels(df: DataFrame, levels: Sequence[str], actual: str, prediction: str) -> DataFrame:
    """Accuracy and bias of each value of several levels in one table."""
    parts = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("value")) for c in levels])
    long = df.select(actual, prediction, F.inline(parts))
    return long.groupBy("level", "value").agg(*accuracy(actual, prediction))


def precision_table(df: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Precision of several (label, prediction) pairs per key, 0 where nothing was predicted."""
    out = []
    for name, (label, predicted) in pairs.items():
        hits = F.sum((label & predicted).cast("int"))
        out.append(F.coalesce(ratio(hits, F.sum(predicted.cast("int"))), F.lit(0.0)).alias(name))
    return df.groupBy(*keys).agg(*out)


def classification_scores(df: DataFrame, keys: Sequence[str], label: Column, predicted: Column) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1."""
    counted = df.groupBy(*keys).agg(
        F.count_if(label & predicted).alias("tp"), F.count_if(~label & predicted).alias("fp"),
        F.count_if(label & ~predicted).alias("fn"), F.count_if(~label & ~predicted).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(
        "*", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def threshold_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """True and false positives at every distinct score, highest first.

    Rows collapse to one per score before the running totals.
    """
    counted = checkpointed(df.groupBy(score).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("_neg")))
    curve = running_totals(counted, [F.col(score).desc()], {"tp": "_pos", "fp": "_neg"}, number="_row")
    total = counted.agg(F.sum("_pos").alias("_all_pos"), F.sum("_neg").alias("_all_neg"))
    return beside(curve, total).select(
        score, "tp", "fp", "_pos", "_neg",
        ratio("tp", "_all_pos").alias("tpr"), ratio("fp", "_all_neg").alias("fpr"),
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), F.col("_all_pos"), F.col("_all_neg"))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC and precision-recall points."""
    return threshold_curve(df, score, label).select(score, "tpr", "fpr", "precision")


def areas_under_curves(df: DataFrame, score: str, label: str) -> DataFrame:
    """Areas under the ROC and precision-recall curves by the trapezoid rule, as sums over the points.

    A point's predecessor is known from its own counts, so no neighbour look-up
    is needed; the precision-recall curve starts at recall 0 and precision 1.
    """
    c = threshold_curve(df, score, label)
    tp0, fp0 = F.col("tp") - F.col("_pos"), F.col("fp") - F.col("_neg")
    before = F.coalesce(ratio(tp0, tp0 + fp0), F.lit(1.0))
    roc = F.sum(F.col("_neg") * (F.col("tp") + tp0) / 2)
    pr = F.sum(F.col("_pos") * (F.col("precision") + before) / 2)
    return c.agg(
        ratio(roc, F.max("_all_pos") * F.max("_all_neg")).alias("roc_auc"), ratio(pr, F.max("_all_pos")).alias("pr_auc"))


def best_threshold(df: DataFrame, score: str, label: str, steps: Sequence[float]) -> DataFrame:
    """Grid threshold with the highest F1, the last among equals."""
    y = F.col(label) == 1
    cells = []
    for step in steps:
        hit = F.col(score) >= F.lit(step)
        cells.append(F.struct(
            ratio(2 * F.count_if(y & hit), F.count_if(y) + F.count_if(hit)).alias("f1"),
            F.lit(step).alias("threshold")))
    best = df.agg(F.array_max(F.array(*cells)).alias("best"))
    return best.select("best.threshold", "best.f1")


def regression_scores(df: DataFrame, keys: Sequence[str], actual: str, prediction: str) -> DataFrame:
    """R², mean squared and mean absolute error."""
    miss = F.col(actual) - F.col(prediction)
    return df.groupBy(*keys).agg(
        (1 - ratio(F.sum(miss * miss), F.var_pop(actual) * F.count(actual))).alias("r2"),
        F.avg(miss * miss).alias("mse"), F.avg(F.abs(miss)).alias("mae"))


def select_model(table: DataFrame, keys: Sequence[str], limit: float = 0.2) -> DataFrame:
    """Best accuracy among methods whose bias is below ``limit``; else best accuracy, marked FAIL."""
    passes = F.abs("fb") < limit
    candidate = F.struct(
        F.coalesce(passes, F.lit(False)).alias("ok"), F.col("fa").alias("fa"), F.col("method").alias("method"),
        F.col("fb").alias("fb"))
    best = table.groupBy(*keys).agg(F.max(candidate).alias("best"))
    return best.select(
        *keys, "best.method", "best.fa", "best.fb",
        F.when(F.col("best.ok"), "PASS").otherwise("FAIL").alias("fb_check"))


def group_accuracy(
    df: DataFrame, group: str, key: str, actual: str, methods: Sequence[str]
) -> DataFrame:
    """Best method on the group total, and median and sales-weighted mean of the keys' best accuracies."""
    per_key = best_method(method_table(df, [group, key], actual, methods), [group, key], methods)
    sales = df.groupBy(group, key).agg(F.sum(actual).alias("_sales"))
    joined = per_key.withColumnRenamed("fa", "_fa").join(sales, [group, key])
    weighted = joined.groupBy(group).agg(
        ratio(F.sum(F.col("_fa") * F.col("_sales")), F.sum("_sales")).alias("weighted_fa"))
    median = exact_percentiles(joined, [group], "_fa", {"median_fa": 0.5})
    total = best_method(method_table(df, [group], actual, methods), [group], methods)
    return total.join(median, group).join(weighted, group)
