"""Dates, weeks and calendars. ISO, simple and calendar week systems are kept apart."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aisle.functions.exprs import col

#: Public holidays as month-day codes.
HOLIDAYS = ("0101", "0430", "0501", "0902")


def week_start(d: Column | str) -> Column:
    """Monday of the ISO week."""
    return F.trunc(col(d), "week")


def iso_yearweek(d: Column | str) -> Column:
    """``yyyyww`` with the ISO year, so the turn of the year stays consistent."""
    d = col(d)
    return (F.extract(F.lit("YEAROFWEEK"), d) * 100 + F.weekofyear(d)).cast("int")


def simple_yearweek(d: Column | str) -> Column:
    """``yyyyww`` with weeks of seven days counted from 1 January (53 per year)."""
    d = col(d)
    return (F.year(d) * 100 + F.ceil(F.dayofyear(d) / 7)).cast("int")


def calendar_yearweek(d: Column | str) -> Column:
    """Calendar year with ISO week; early January days of week 52/53 go to the year before."""
    d = col(d)
    week = F.weekofyear(d)
    return (
        F.when((F.month(d) == 1) & (week >= 52), (F.year(d) - 1) * 100 + week)
        .otherwise(F.year(d) * 100 + week)
        .cast("int")
    )


def yearweek_to_date(yw: Column | str, weekday: int = 1) -> Column:
    """Date of a weekday (1 = Monday) in an ISO ``yyyyww``; 4 January is always in week 1."""
    yw = col(yw)
    year = F.floor(yw / 100).cast("int")
    first_monday = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
    return F.date_add(first_monday, ((yw % 100) - 1).cast("int") * 7 + (weekday - 1))


def week_index(d: Column | str) -> Column:
    """Running number of the ISO week: differences count weeks across any year edge."""
    return F.floor(F.datediff(F.trunc(col(d), "week"), F.lit("1970-01-05").cast("date")) / 7).cast("int")


def yearweek_index(yw: Column | str) -> Column:
    return week_index(yearweek_to_date(yw))


def yearweek_diff(later: Column | str, earlier: Column | str) -> Column:
    """Whole weeks between two ISO ``yyyyww`` values."""
    return yearweek_index(later) - yearweek_index(earlier)


def yearweek_shift(yw: Column | str, weeks: int | Column) -> Column:
    """ISO ``yyyyww`` moved by a number of weeks."""
    step = F.lit(weeks) if isinstance(weeks, int) else weeks
    return iso_yearweek(F.date_add(yearweek_to_date(yw), (step * 7).cast("int")))


def half_week(d: Column | str) -> Column:
    """``first_half`` Monday to Wednesday, ``last_half`` Thursday to Sunday."""
    return F.when(F.weekday(col(d)) <= 2, F.lit("first_half")).otherwise(F.lit("last_half"))


def quarter_number(d: Column | str) -> Column:
    """Running number of the quarter."""
    d = col(d)
    return F.year(d) * 4 + F.quarter(d) - 1


def week_of_month(d: Column | str) -> Column:
    """Seven-day block of the month, from 1."""
    return (F.floor((F.dayofmonth(col(d)) - 1) / 7) + 1).cast("int")


def week_of_quarter(d: Column | str) -> Column:
    """Seven-day block of the quarter, from 1."""
    d = col(d)
    return (F.floor(F.datediff(d, F.trunc(d, "quarter")) / 7) + 1).cast("int")


def season(d: Column | str) -> Column:
    month = F.month(col(d))
    return (
        F.when(month.between(2, 4), F.lit("spring"))
        .when(month.between(5, 7), F.lit("summer"))
        .when(month.between(8, 10), F.lit("autumn"))
        .otherwise(F.lit("winter"))
    )


def cyclic(value: Column, period: float, name: str) -> list[Column]:
    """Sine and cosine of a position in a cycle."""
    angle = value * F.lit(2.0) * F.pi() / F.lit(float(period))
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def day_frame(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day from start to end, both included."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("date")
    )


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Calendar dimension: date parts, week numbers, start/end flags, leap year, season, holiday."""
    d = F.col("date")
    return day_frame(spark, start, end).select(
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.dayofweek(d).alias("dayofweek"),
        F.dayofyear(d).alias("dayofyear"),
        F.weekofyear(d).alias("weekofyear"),
        calendar_yearweek(d).alias("yearweek"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
        (d == F.trunc(d, "month")).alias("is_month_start"),
        (d == F.last_day(d)).alias("is_month_end"),
        (d == F.trunc(d, "quarter")).alias("is_quarter_start"),
        (d == F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)).alias("is_quarter_end"),
        (d == F.trunc(d, "year")).alias("is_year_start"),
        (d == F.date_sub(F.add_months(F.trunc(d, "year"), 12), 1)).alias("is_year_end"),
        (F.dayofyear(F.last_day(F.make_date(F.year(d), F.lit(12), F.lit(1)))) == 366).alias("is_leap_year"),
        season(d).alias("season"),
        F.date_format(d, "MMdd").isin(*HOLIDAYS).alias("is_holiday"),
    )


def working_days(week: Column | str) -> Column:
    """Working days (Monday to Saturday without holidays) of the week that starts at ``week``, in any year."""
    days = [F.date_format(F.date_add(col(week), i), "MMdd") for i in range(6)]
    return reduce(add, [(~d.isin(*HOLIDAYS)).cast("int") for d in days])


def week_calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per ISO week: index, yearweek, working days (Monday to Saturday without holidays)."""
    d = F.col("date")
    working = (F.dayofweek(d) != 1) & ~F.date_format(d, "MMdd").isin(*HOLIDAYS)
    return (
        day_frame(spark, start, end)
        .groupBy(week_start(d).alias("week"))
        .agg(F.count_if(working).cast("int").alias("working_days"))
        .select(
            "week",
            week_index("week").alias("week_no"),
            iso_yearweek("week").alias("yearweek"),
            "working_days",
        )
    )


def _periods(run_date: date) -> list[Column]:
    day = F.lit(run_date)
    yesterday = F.date_sub(day, 1)
    month_start = F.trunc(yesterday, "month")
    spans = [
        ("yesterday", yesterday, yesterday),
        ("previous_day", F.date_sub(day, 2), F.date_sub(day, 2)),
        ("last_7_days", F.date_sub(day, 7), yesterday),
        ("previous_7_days", F.date_sub(day, 14), F.date_sub(day, 8)),
        ("last_30_days", F.date_sub(day, 30), yesterday),
        ("previous_30_days", F.date_sub(day, 60), F.date_sub(day, 31)),
        ("month_to_date", month_start, yesterday),
        ("previous_month_to_date", F.add_months(month_start, -1), F.add_months(yesterday, -1)),
    ]
    return [F.struct(F.lit(n).alias("period"), s.alias("start_date"), e.alias("end_date")) for n, s, e in spans]


def period_table(spark: SparkSession, run_date: date) -> DataFrame:
    """Eight reporting periods as of a run date, one row each.

    The previous month-to-date ends on the same day of month, clamped to the
    month's last day by ``add_months``.
    """
    return spark.range(1).select(F.inline(F.array(*_periods(run_date))))


def periods_of(d: Column | str, run_date: date) -> Column:
    """Array of the reporting periods a date falls into; explode it to book a fact on all of them."""
    d = col(d)
    return F.filter(F.array(*_periods(run_date)), lambda p: d.between(p["start_date"], p["end_date"]))


def nth_weekday(year: Column, month: int, weekday: int, nth: int) -> Column:
    """Date of the n-th weekday (1 = Monday) of a month; counted from the month's end if ``nth`` is negative."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if nth > 0:
        return F.date_add(first, ((weekday - 1 - F.weekday(first) + 7) % 7 + 7 * (nth - 1)).cast("int"))
    last = F.last_day(first)
    return F.date_sub(last, ((F.weekday(last) - (weekday - 1) + 7) % 7 + 7 * (-nth - 1)).cast("int"))


def easter_sunday(year: Column) -> Column:
    """Western Easter: the Sunday after the church's full moon on or after 21 March."""
    century = F.floor(year / 100)
    golden = year % 19
    # Age of the moon, with the leap days and moon days that whole centuries drop.
    moon = (century - F.floor(century / 4) - F.floor((8 * century + 13) / 25) + 19 * golden + 15) % 30
    late = F.when((moon == 29) | ((moon == 28) & (golden > 10)), 1).otherwise(0)
    full = F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(21)), (moon - late).cast("int"))
    return F.date_add(full, (7 - (F.weekday(full) + 1) % 7).cast("int"))


def holiday_dimension(
    years: DataFrame, fixed: Sequence[tuple[str, str, str]], movable: Sequence[tuple[str, str, Column]],
    intervals: DataFrame | None = None,
) -> DataFrame:
    """One row per holiday and day: date, country, name, movable.

    ``years`` has a column ``year``. ``fixed``: country, name, month and day
    (``MMdd``); 29 February is left out of other years. ``movable``: country,
    name and the date as a column of ``year``. ``intervals`` (country, name,
    start_date, end_date) lists holidays that no rule gives, such as those of a
    lunar calendar; all their days count.
    """
    year = F.col("year")
    on = lambda code: F.try_to_date(F.concat(year.cast("string"), F.lit(code)), "yyyyMMdd")
    cell = lambda d, country, name, moves: F.struct(
        d.alias("date"), F.lit(country).alias("country"), F.lit(name).alias("name"), F.lit(moves).alias("movable"))
    cells = [*[cell(on(code), c, n, False) for c, n, code in fixed], *[cell(d, c, n, True) for c, n, d in movable]]
    out = years.select("year").distinct().select(F.inline(F.array(*cells))).where("date IS NOT NULL")
    if intervals is not None:
        days = intervals.where("start_date <= end_date").select(
            F.explode(F.sequence("start_date", "end_date")).alias("date"), "country", "name", F.lit(True).alias("movable"))
        out = out.unionByName(days).distinct()
    return out


def mapped_holiday(d: Column | str, names: dict[str, str]) -> Column:
    """Holiday name by month and day, else ``Non-Holiday``."""
    code = F.date_format(col(d), "MMdd")
    out = F.lit("Non-Holiday")
    for month_day, name in names.items():
        out = F.when(code == month_day, F.lit(name)).otherwise(out)
    return out


def start_end_flags(start: str, end: str, week: str) -> list[Column]:
    """Position flags of a promotion seen from one ISO week (its Monday), and duration buckets."""
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    out = [flag(F.trunc(start, "week") == F.trunc(end, "week")).alias("start_end_same_week")]
    for side, name in ((start, "start"), (end, "end")):
        here = F.trunc(side, "week") == F.col(week)
        quarter_week = iso_yearweek(side) % 100 % 13
        out += [
            flag(here).alias(f"{name}_current_week"),
            flag(here & (week_of_month(side) == 1)).alias(f"{name}_first_week_of_month"),
            flag(here & (week_of_month(side) > 3)).alias(f"{name}_last_week_of_month"),
            flag(here & (quarter_week == 1)).alias(f"{name}_first_week_of_quarter"),
            flag(here & (quarter_week == 0)).alias(f"{name}_last_week_of_quarter"),
        ]
    days = F.datediff(end, start) + 1
    return [
        *out, flag(days < 8).alias("duration_1_week"), flag(days.between(8, 14)).alias("duration_2_weeks"),
        flag(days < 31).alias("duration_under_1_month"), flag(days > 30).alias("duration_over_1_month"),
    ]


def distance_flags(week: str, start: str, end: str) -> list[Column]:
    """Is the start or end of a promotion one or two weeks ahead or behind a date."""
    out = []
    for side, name in ((start, "start"), (end, "end")):
        days = F.datediff(week, side)
        out += [
            days.between(-7, -1).cast("int").alias(f"{name}_next_week"),
            days.between(-14, -8).cast("int").alias(f"{name}_next_2_weeks"),
            days.between(1, 7).cast("int").alias(f"{name}_last_week"),
            days.between(8, 14).cast("int").alias(f"{name}_last_2_weeks"),
        ]
    return out
