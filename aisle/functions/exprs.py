"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """Columns of a one-row frame next to every row, as a scalar subquery instead of a join."""
    packed = row.select(F.struct("*").alias("_row")).scalar()
    return df.withColumn("_row", packed).select(*df.columns, "_row.*")


def safe_div(num: Column | str, den: Column | str, default: float | None = 0.0) -> Column:
    """``num / den``; ``default`` where the denominator is zero or null."""
    num, den = col(num), col(den)
    return F.when(den != 0, num / den).otherwise(F.lit(default).cast("double"))


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``, null where the denominator is zero."""
    return F.try_divide(col(num), col(den))


def clip_lower(c: Column | str, floor: float = 0.0) -> Column:
    return F.greatest(col(c), F.lit(floor))


def cap(c: Column | str, low: Column, high: Column) -> Column:
    """``c`` held inside [low, high]; a null bound leaves the value as it is."""
    c = col(c)
    return F.when(c > high, high).when(c < low, low).otherwise(c)


def recode(c: Column | str, mapping: Mapping, default: Column | None = None) -> Column:
    """Replace listed values; others keep their value or take ``default``."""
    c = col(c)
    out = None
    for old, new in mapping.items():
        out = F.when(c == F.lit(old), F.lit(new)) if out is None else out.when(c == F.lit(old), F.lit(new))
    rest = c if default is None else default
    return rest if out is None else out.otherwise(rest)


def tier(c: Column | str, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    """First label whose lower bound the value reaches; ``steps`` run from high to low."""
    c = col(c)
    out = None
    for bound, label in steps:
        test = c >= F.lit(bound)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(rest))


def decile_edge_bin(c: Column | str) -> Column:
    """Right-closed tenths ``(0, 0.1], …``; 0 and 1 and null are classes of their own."""
    c = col(c)
    upper = F.ceil(F.round(c * 10, 6)) / 10
    return (
        F.when(c.isNull(), F.lit("null"))
        .when(c == 0, F.lit("0"))
        .when(c == 1, F.lit("1"))
        .when((c < 0) | (c > 1), F.lit("outside"))
        .otherwise(F.concat(F.lit("<="), F.format_number(upper, 1)))
    )


def row_median(*cols: Column | str) -> Column:
    """Median of the non-null values of one row."""
    kept = F.array_sort(F.array_compact(F.array(*[col(c).cast("double") for c in cols])))
    n = F.size(kept)
    low = F.try_element_at(kept, ((n + 1) / 2).cast("int"))
    high = F.try_element_at(kept, (n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2)


def row_mean(*cols: Column | str) -> Column:
    """Mean of the non-null values of one row."""
    parts = [col(c).cast("double") for c in cols]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    count = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.try_divide(total, count)


def boxcox_half(c: Column | str) -> Column:
    """Box-Cox transform with lambda 0.5."""
    return (F.sqrt(col(c)) - 1) / 0.5


def boxcox_half_inverse(c: Column | str) -> Column:
    return F.pow(col(c) * 0.5 + 1, F.lit(2.0))
