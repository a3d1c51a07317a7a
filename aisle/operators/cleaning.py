"""Projections, filters and cleaning steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from aisle.functions.exprs import beside, col, safe_div


def product_hierarchy(df: DataFrame, material: str, levels: Mapping[str, str]) -> DataFrame:
    """Hierarchy rows with the right-most eight characters as code and a four-character category code.

    ``levels`` maps source columns to level names; the first level gives the category code.
    """
    first = next(iter(levels))
    return df.select(
        F.substring(F.col(material), -8, 8).alias("product_code"),
        F.substring(F.col(first), 1, 4).alias("category_code"),
        *[F.col(source).alias(name) for source, name in levels.items()],
    )


def normalize_keys(df: DataFrame, columns: Sequence[str], case: str = "upper") -> DataFrame:
    """Trimmed upper- or lower-case key columns."""
    change = F.upper if case == "upper" else F.lower
    return df.withColumns({c: change(F.trim(F.col(c))) for c in columns})


def split_fixed(text: Column | str, layout: Sequence[tuple[str, int]], rest: str) -> list[Column]:
    """Cut a fixed-layout code into named parts; what follows them goes to ``rest``."""
    text, out, start = col(text), [], 1
    for name, width in layout:
        out.append(F.substring(text, start, width).alias(name))
        start += width
    return [*out, F.substr(text, F.lit(start)).alias(rest)]


def split_key(key: Column | str, names: Sequence[str], sep: str = "|") -> list[Column]:
    """Parts of a composite key as named columns."""
    parts = F.split(col(key), f"[{sep}]")
    return [F.try_element_at(parts, F.lit(i + 1)).alias(name) for i, name in enumerate(names)]


def convert_units(pieces: Column | str, per_case: Column | str, kg_per_case: Column | str) -> list[Column]:
    """Cases, kilograms, tonnes and thousand pieces from pieces and master factors."""
    cases = safe_div(pieces, per_case)
    kg = cases * col(kg_per_case)
    return [
        cases.alias("cases"), kg.alias("kg"), (kg / 1000).alias("ton"), (col(pieces) / 1000).alias("kpcs"),
    ]


def category_measure(category: Column | str, case_in: Sequence[str], kpcs_in: Sequence[str]) -> Column:
    """Cases for some categories, thousand pieces for some, tonnes for the rest."""
    category = col(category)
    return (
        F.when(category.isin(*case_in), F.col("cases"))
        .when(category.isin(*kpcs_in), F.col("kpcs"))
        .otherwise(F.col("ton"))
    )


def drop_inactive(df: DataFrame, keys: Sequence[str], date: str, today: Column, days: int) -> DataFrame:
    """Rows of the series whose last date lies within ``days`` before ``today``."""
    last = df.groupBy(*keys).agg(F.max(date).alias("_last"))
    active = last.where(F.datediff(today, "_last") <= days).select(*keys)
    return df.join(active, list(keys), "left_semi")


def keep_long_series(df: DataFrame, keys: Sequence[str], week_no: str, weeks: int) -> DataFrame:
    """Rows of the series that span at least ``weeks`` weeks from first to last."""
    span = df.groupBy(*keys).agg((F.max(week_no) - F.min(week_no) + 1).alias("_span"))
    return df.join(span.where(F.col("_span") >= weeks).select(*keys), list(keys), "left_semi")


def drop_zero_series(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Rows of the series whose total is positive."""
    total = df.groupBy(*keys).agg(F.sum(measure).alias("_total"))
    return df.join(total.where("_total > 0").select(*keys), list(keys), "left_semi")


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without nulls in all or the listed columns."""
    return df.na.drop(subset=list(columns) if columns else None)


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


def in_period(df: DataFrame, date: str, period: DataFrame) -> DataFrame:
    """Rows between ``start_date`` and ``end_date`` of a one-row period table."""
    inside = beside(df, period).where(F.col(date).between(F.col("start_date"), F.col("end_date")))
    return inside.drop("start_date", "end_date")
