"""Joins, keyed de-duplication and mapping steps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in the given order.

    The filter on ``row_number`` lets Spark keep one row per key inside every
    task before the shuffle, so a hot key costs one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def merge_features(frames: Sequence[DataFrame], keys: Sequence[str], how: str = "full") -> DataFrame:
    """Join several frames on the same keys."""
    return reduce(lambda left, right: left.join(right, list(keys), how), frames)


def apply_migration(fact: DataFrame, migration: DataFrame, code: str, old: str, new: str) -> DataFrame:
    """Replace old codes by their successor; codes without one stay."""
    mapping = migration.select(F.col(old).alias(code), F.col(new).alias("_new"))
    return fact.join(mapping, code, "left").withColumn(code, F.coalesce("_new", code)).drop("_new")


def first_mapping(mapping: DataFrame, key: str, order: Sequence[Column | str], *values: str) -> DataFrame:
    """One mapping row per key, ready to be joined without fan-out."""
    return dedupe(mapping.select(key, *values), [key], order)


def grid(keys: DataFrame, values: Column, name: str) -> DataFrame:
    """Every key with every element of an array column (a date sequence, a list of types).

    The list is expanded inside each key row, so no join or shuffle is needed.
    """
    return keys.withColumn(name, F.explode(values))


def cumulative_calendar(days: DataFrame, date: str, flag: str) -> DataFrame:
    """Running total of a day flag; ``days`` is a calendar."""
    window = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return days.select(date, F.sum(F.col(flag).cast("long")).over(window).alias("_until"), F.col(flag).alias("_flag"))


def sum_between(df: DataFrame, days: DataFrame, start: str, end: str, date: str, flag: str, name: str) -> DataFrame:
    """Sum of a day flag from start to end, both included, by two look-ups of a running total."""
    running = cumulative_calendar(days, date, flag)
    first = running.select(F.col(date).alias(start), (F.col("_until") - F.col("_flag").cast("long")).alias("_before"))
    last = running.select(F.col(date).alias(end), F.col("_until").alias("_through"))
    return (
        df.join(first, start, "left").join(last, end, "left")
        .withColumn(name, F.col("_through") - F.col("_before")).drop("_through", "_before")
    )


def resolve_return_date(
    returns: DataFrame, invoices: DataFrame, invoice: str, reference: str, date: str
) -> DataFrame:
    """Returns take the date of the invoice they refer to, else keep their own."""
    dates = invoices.groupBy(F.col(invoice).alias(reference)).agg(F.min(date).alias("_reference_date"))
    return (
        returns.join(dates, reference, "left")
        .withColumn("effective_date", F.coalesce("_reference_date", date))
        .drop("_reference_date")
    )


def year_ago(df: DataFrame, keys: Sequence[str], date: str, measure: str, start: Column, end: Column) -> DataFrame:
    """Total of a period and of the same period twelve months before, from one scan."""
    current = F.col(date).between(start, end)
    before = F.col(date).between(F.add_months(start, -12), F.add_months(end, -12))
    return (
        df.where(current | before).groupBy(*keys)
        .agg(F.sum(F.when(current, F.col(measure))).alias("current"),
             F.sum(F.when(before, F.col(measure))).alias("last_year"))
        .where("current is not null and last_year is not null")
    )


def main_quarter(start: str, end: str) -> Column:
    """Number of the quarter an interval is booked on.

    It is the quarter of the end; an interval over exactly one quarter edge
    belongs to the side with more days.
    """
    edge = F.trunc(end, "quarter")
    first = F.year(start) * 4 + F.quarter(start) - 1
    last = F.year(end) * 4 + F.quarter(end) - 1
    mostly_before = F.datediff(edge, F.col(start)) >= F.datediff(F.col(end), edge)
    return F.when((last - first == 1) & mostly_before, first).otherwise(last)


def class_asof(promotions: DataFrame, classes: DataFrame, start: str, end: str) -> DataFrame:
    """Class valid in the quarter a promotion is booked on; else its own class.

    ``classes`` has one row per product and quarter number.
    """
    keyed = promotions.withColumn("quarter_no", main_quarter(start, end))
    valid = classes.select("product", "quarter_no", F.col("class").alias("_quarter_class"))
    return (
        keyed.join(valid, ["product", "quarter_no"], "left")
        .withColumn("class", F.coalesce("_quarter_class", "class"))
        .drop("_quarter_class")
    )
