"""Data-quality profiles, contracts and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from aisle.functions.exprs import beside, ratio
from aisle.operators.ordering import exact_percentiles


#: Verdicts and ages of a series, and states of a reconciled key.
VERDICTS = ("ABSOLUTELY_NOT", "MAYBE", "ABSOLUTELY")
AGES = ("NEW", "INACTIVE", "OLD BUT LACKING SALES", "OLD AND ACTIVE")
KEY_STATES = ("NOT_EXPECTED", "NO LE RECORD", "NO ERROR")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column, one row per column, from one pass."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.unpivot([], names, "column", "nulls")


def summary(df: DataFrame, columns: Sequence[str], percentiles: dict[str, float]) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles, one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    # Every column has a row in both, also one without values.
    return stats.join(exact_percentiles(long, ["column"], "value", percentiles), "column")


@dataclass(frozen=True)
class Rule:
    """Contract of one text column."""

    name: str
    kind: str  # "number", "datetime" or "object"
    fmt: str = ""  # regular expression of a number, date pattern of a datetime
    nullable: bool = True
    low: float | None = None
    high: float | None = None
    type_message: str = "wrong type"
    null_message: str = "missing"
    range_message: str = "out of range"

    def errors(self) -> Column:
        """All messages of one value joined by a space; a nullable missing value counts as 0."""
        raw = F.col(self.name)
        value = F.coalesce(raw, F.lit("0")) if self.nullable else raw
        found = []
        if not self.nullable:
            found.append(F.when(raw.isNull(), self.null_message))
        if self.kind == "number":
            found.append(F.when(value.isNull() | ~value.rlike(f"^(?:{self.fmt})"), self.type_message))
        elif self.kind == "datetime":
            found.append(F.when(F.try_to_date(raw, self.fmt).isNull(), self.type_message))
        if self.low is not None:
            number = value.try_cast("double")
            inside = F.coalesce(number.between(self.low, self.high), F.lit(False))
            found.append(F.when(~inside, self.range_message))
        return F.concat_ws(" ", *found)


def validate(df: DataFrame, contract: Sequence[Rule]) -> DataFrame:
    """Per-column error texts, their summary and a fail mark for every row."""
    checks = []
    for rule in contract:
        errors = rule.errors()
        checks.append(F.when(errors != "", F.concat(F.lit(f"{rule.name}:"), errors)).alias(f"{rule.name}_check"))
    marked = df.select("*", *checks)
    text = F.concat_ws(",", *[f"{rule.name}_check" for rule in contract])
    return marked.withColumn("summary_check", text).withColumn(
        "fail_case", F.when(F.col("summary_check") != "", "x").otherwise(""))


def series_eligibility(df: DataFrame, keys: Sequence[str], week_no: str, measure: str, run_week: int) -> DataFrame:
    """Weeks with sales, recency and the verdict whether a series can be forecast."""
    stats = df.where(F.col(week_no) <= run_week).groupBy(*keys).agg(
        F.count_distinct(week_no).alias("week_count"), F.max(week_no).alias("last_week"),
        F.min(week_no).alias("first_week"), F.sum(measure).alias("total"), F.avg(measure).alias("mean"),
        F.max(measure).alias("highest"), F.min(measure).alias("lowest"),
    )
    gap, age = F.lit(run_week) - F.col("last_week"), F.lit(run_week) - F.col("first_week")
    never, maybe, fit = VERDICTS
    verdict = F.when((F.col("week_count") < 26) | (gap > 26), never).when(F.col("week_count") < 52, maybe).otherwise(fit)
    new, inactive, thin, active = AGES
    life = F.when(age < 26, new).when(gap > 26, inactive).when(F.col("week_count") < 52, thin).otherwise(active)
    return stats.select("*", gap.alias("cutoff_gap"), verdict.alias("verdict"), life.alias("age_class"))


def _flagged_series(df: DataFrame, keys: Sequence[str], week_no: str) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.count(week_no).alias("weeks"), F.max(week_no).alias("last"))
    latest = stats.agg(F.max("last").alias("_latest"))
    weeks = F.col("weeks")
    return beside(stats, latest).select(
        *keys, (weeks <= 26).alias("short"), weeks.between(26, 52).alias("warn"),
        (F.col("last") <= F.col("_latest") - 26).alias("stale"))


def validate_series(df: DataFrame, keys: Sequence[str], week_no: str) -> tuple[DataFrame, DataFrame]:
    """Rows of usable series, and a one-row count report.

    Dropped are series of at most 26 weeks and series that ended 26 or more
    weeks before the newest one; 26 to 52 weeks only warn.
    """
    flags = _flagged_series(df, keys, week_no)
    usable = flags.where(~F.col("short") & ~F.col("stale")).select(*keys)
    report = flags.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("short") & ~F.col("stale")).alias("usable"),
        F.count_if(F.col("short")).alias("up_to_26_weeks"),
        F.count_if(F.col("warn")).alias("up_to_52_weeks"), F.count_if(F.col("stale")).alias("stale"))
    return df.join(usable, list(keys), "left_semi"), report


def reconcile(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State of every key that is expected or present."""
    a = actual.select(*keys).distinct().withColumn("_actual", F.lit(True))
    e = expected.select(*keys).distinct().withColumn("_expected", F.lit(True))
    unexpected, missing, fine = KEY_STATES
    state = F.when(F.col("_expected").isNull(), unexpected).when(F.col("_actual").isNull(), missing).otherwise(fine)
    return a.join(e, list(keys), "full").select(*keys, state.alias("status"))


def coverage_profile(df: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Null, zero, one and present periods per key, and the share of nulls."""
    c = F.col(value)
    return df.groupBy(*keys).agg(
        F.count_if(c.isNull()).alias("null_count"), F.count_if(c == 0).alias("zero_count"),
        F.count_if(c == 1).alias("one_count"), F.count(value).alias("present_count"),
        F.count(period).alias("total_count"),
    ).withColumn("null_share", F.round(F.col("null_count") / F.col("total_count"), 2))


def split_by_quality(
    df: DataFrame, profile: DataFrame, keys: Sequence[str], limit: float
) -> tuple[DataFrame, DataFrame]:
    """Rows of the keys with at most ``limit`` nulls, and the other rows."""
    good = profile.where(F.col("null_share") <= limit).select(*keys)
    return df.join(good, list(keys), "left_semi"), df.join(good, list(keys), "left_anti")


def dup_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def promo_rules(df: DataFrame, master: DataFrame, open_states: Sequence[str]) -> DataFrame:
    """Rule flags of promotion lines (1 = violated).

    Needs scheme, product, post, status, start_date, end_date, mechanic, gift,
    tts and bmi; ``master`` lists the allowed (mechanic, gift) pairs.
    """
    days = F.datediff("end_date", "start_date")
    by_product = df.groupBy("post", "product").agg(
        F.datediff(F.max("end_date"), F.min("start_date")).alias("_product_days"))
    allowed = master.select("mechanic", "gift").distinct().withColumn("_known", F.lit(True))
    valid = lambda c: (F.col(c) == 0) | F.col(c).between(0.02, 0.8)
    flag = lambda test: test.cast("int")
    needs_tts, needs_bmi = F.col("mechanic").contains("discount"), F.col("mechanic").contains("gift")
    return (
        df.join(by_product, ["post", "product"], "left").join(allowed, ["mechanic", "gift"], "left")
        .select(
            "scheme", flag(~F.col("status").isin(*open_states)).alias("status_check"),
            flag(days <= 0).alias("duration_check"), flag(F.col("_product_days") < 7).alias("product_duration_check"),
            flag(F.col("_known").isNull()).alias("mapping_check"), flag(~valid("tts")).alias("tts_check"),
            flag(~valid("bmi")).alias("bmi_check"), flag(needs_tts & (F.col("tts") == 0)).alias("tts_missing"),
            flag(needs_bmi & (F.col("bmi") == 0)).alias("bmi_missing"),
        )
    )


def promo_conflicts(df: DataFrame, keys: Sequence[str], mechanic: Sequence[str]) -> DataFrame:
    """Per key: repeated lines, one mechanic at several times, one time with several mechanics."""
    how, when = F.struct(*mechanic), F.struct("start_date", "end_date")
    lines = df.groupBy(*keys, how.alias("_how"), when.alias("_when")).agg(F.count(F.lit(1)).alias("_n"))
    by_how = lines.groupBy(*keys, "_how").agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_times"))
    by_when = lines.groupBy(*keys, "_when").agg(F.count(F.lit(1)).alias("_mechanics"))
    first = by_how.groupBy(*keys).agg(
        (F.max("_n") > 1).cast("int").alias("duplicate_line"),
        (F.max("_times") > 1).cast("int").alias("same_mechanic_other_time"))
    second = by_when.groupBy(*keys).agg((F.max("_mechanics") > 1).cast("int").alias("same_time_other_mechanic"))
    return first.join(second, list(keys))


def interval_overlaps(df: DataFrame, keys: Sequence[str], mechanic: Sequence[str]) -> DataFrame:
    """Overlap flags of the mechanics of one key; both rows of an overlap are marked.

    Lines collapse to one interval per key and mechanic first, so the window
    holds no more rows than there are mechanics.
    """
    spans = df.groupBy(*keys, *mechanic).agg(
        F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))
    spec = Window.partitionBy(*keys).orderBy("start_date", "end_date", *mechanic)
    gap = F.datediff(F.lead("start_date").over(spec), "end_date")
    how = F.struct(*mechanic)
    same = F.lead(how).over(spec) == how
    marked = spans.select(
        *keys, *mechanic, "start_date", "end_date", F.coalesce(gap, F.lit(0)).alias("gap_to_next"),
        F.coalesce((gap < 0) & same, F.lit(False)).cast("int").alias("_same"),
        F.coalesce((gap < 0) & ~same, F.lit(False)).cast("int").alias("_other"))
    both = lambda c: F.greatest(F.col(c), F.coalesce(F.lag(c).over(spec), F.lit(0)))
    return marked.withColumns({"overlap_same": both("_same"), "overlap_other": both("_other")}).drop("_same", "_other")


def fact_consistency(a: DataFrame, b: DataFrame, keys: Sequence[str], group: Sequence[str], measure: str) -> DataFrame:
    """Two facts side by side with period counts and totals of each per group."""
    both = a.select(*keys, F.col(measure).alias("a_value")).join(
        b.select(*keys, F.col(measure).alias("b_value")), list(keys), "full")
    spec = Window.partitionBy(*group)
    return both.select(
        *keys, F.coalesce("a_value", F.lit(0.0)).alias("a_value"), F.coalesce("b_value", F.lit(0.0)).alias("b_value"),
        F.count("a_value").over(spec).alias("a_count"), F.count("b_value").over(spec).alias("b_count"),
        F.sum("a_value").over(spec).alias("a_total"), F.sum("b_value").over(spec).alias("b_total"))


def outlier_grid(
    df: DataFrame, measure: str, median: str, floors: Sequence[float], factors: Sequence[float]
) -> DataFrame:
    """Share of rows and of volume above ``factor * max(median, floor)``, for every setting, in one pass."""
    value = F.col(measure)
    cells, names = [], []
    for floor in floors:
        for factor in factors:
            hit = value / F.greatest(F.col(median), F.lit(float(floor))) >= factor
            name = f"{floor}|{factor}"
            names.append((floor, factor, name))
            cells += [F.count_if(hit).alias(f"n|{name}"), F.sum(F.when(hit, value).otherwise(0.0)).alias(f"v|{name}")]
    totals = df.agg(F.count(value).alias("rows"), F.sum(value).alias("volume"), *cells)
    rows = F.array(*[
        F.struct(
            F.lit(floor).alias("threshold"), F.lit(factor).alias("multiplier"),
            F.try_divide(F.col(f"n|{name}"), F.col("rows")).alias("record_share"),
            F.try_divide(F.col(f"v|{name}"), F.col("volume")).alias("volume_share"))
        for floor, factor, name in names
    ])
    return totals.select(F.inline(rows))


def flag_peak(measure: str, median: str, floor: float = 2.0, factor: float = 3.0) -> Column:
    """Value at least ``factor`` times its median, the median not below ``floor``."""
    return F.coalesce(F.col(measure) / F.greatest(F.col(median), F.lit(floor)) >= factor, F.lit(False))


def membership_gap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and share of each fact whose key the other fact does not know."""
    key = list(keys)
    out = None
    for name, this, other in (("first", a, b), ("second", b, a)):
        known = other.select(*key).distinct().withColumn("_known", F.lit(True))
        counted = this.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).join(known, key, "left")
        outside = F.sum(F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0))
        row = counted.agg(
            F.lit(name).alias("fact"), F.sum("_n").alias("rows"), outside.alias("outside_rows"),
            ratio(outside, F.sum("_n")).alias("outside_share"))
        out = row if out is None else out.unionByName(row)
    return out


def incomplete_months(df: DataFrame, keys: Sequence[str], week: str, least: int = 4) -> DataFrame:
    """Months of a series with fewer than ``least`` weeks."""
    return (
        df.groupBy(*keys, F.trunc(week, "month").alias("month")).agg(F.count(week).alias("weeks"))
        .where(F.col("weeks") < least)
    )
