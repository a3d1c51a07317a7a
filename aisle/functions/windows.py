"""Column builders for lag, rolling, range and fill features.

They are meant for series already aggregated to their period, where one key has
at most one row per period of the calendar. A hot key is then no larger than
any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec, functions as F

from aisle.functions.exprs import col

STATS = {
    "sum": F.sum,
    "mean": F.avg,
    "median": lambda c: F.percentile(c, 0.5),
    "max": F.max,
    "min": F.min,
}


def series(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def lags(c: str, spec: WindowSpec, steps: Sequence[int], name: str | None = None) -> list[Column]:
    """Values of earlier rows; a negative step looks ahead."""
    name = name or c
    return [F.lag(c, n).over(spec).alias(f"{name}_lag_{n}" if n >= 0 else f"{name}_lead_{-n}") for n in steps]


def rolling_range(
    c: str, spec: WindowSpec, pairs: Sequence[tuple[int, int]], stats: Sequence[str] = ("sum", "mean", "median", "max")
) -> list[Column]:
    """Statistics of the ``roll`` periods that end ``lag + 1`` periods before the row.

    ``spec`` orders by a running period number, so gaps count as periods.
    """
    out = []
    for lag, roll in pairs:
        frame = spec.rangeBetween(-(lag + roll), -(lag + 1))
        out += [STATS[s](c).over(frame).alias(f"{c}_lag_{lag}_roll_{roll}_{s}") for s in stats]
    return out


def trailing_range(c: str, spec: WindowSpec, spans: Sequence[int], stats: Sequence[str]) -> list[Column]:
    """Statistics of the last n periods before the row, the row excluded."""
    return [
        STATS[s](c).over(spec.rangeBetween(-n, -1)).alias(f"{c}_last_{n}_{s}") for n in spans for s in stats
    ]


def expanding(c: str, spec: WindowSpec, stats: Sequence[str]) -> list[Column]:
    """Statistics of all earlier periods, and the number of them with a positive value."""
    frame = spec.rangeBetween(Window.unboundedPreceding, -1)
    out = [STATS[s](c).over(frame).alias(f"{c}_before_{s}") for s in stats]
    return [*out, F.count(F.when(F.col(c) > 0, 1)).over(frame).alias(f"{c}_before_positive")]


def rolling_full(c: Column | str, spec: WindowSpec, n: int, stat) -> Column:
    """Statistic of the last n rows, null until n rows exist."""
    frame = spec.rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.lit(1)).over(frame) >= n, stat(col(c)).over(frame))


def forward_fill(c: str, spec: WindowSpec, limit: int | None = None) -> Column:
    """Last known value, at most ``limit`` rows back."""
    start = Window.unboundedPreceding if limit is None else -limit
    return F.last(c, ignorenulls=True).over(spec.rowsBetween(start, 0))


def backward_fill(c: str, spec: WindowSpec) -> Column:
    return F.first(c, ignorenulls=True).over(spec.rowsBetween(0, Window.unboundedFollowing))


def running_sum(c: Column | str, spec: WindowSpec) -> Column:
    return F.sum(col(c)).over(spec.rowsBetween(Window.unboundedPreceding, 0))


def difference(c: str, spec: WindowSpec, step: int = 1) -> Column:
    return F.col(c) - F.lag(c, step).over(spec)
