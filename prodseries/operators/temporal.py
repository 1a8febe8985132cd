"""Dates, coverage, gaps and presence of the daily rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from prodseries.functions.expr import count_where, dealt_by_month, rounded_ratio
from prodseries.operators.checks import ReviewRules
from prodseries.operators.views import with_names


def parse_date(c) -> F.Column:
    """Date of a text or date column; unreadable text becomes NULL."""
    return F.col(c).try_cast("date") if isinstance(c, str) else c.try_cast("date")


def date_integrity(df: DataFrame, column: str) -> DataFrame:
    """One row: range of the readable dates, NULLs, and text that is not a date."""
    parsed = parse_date(column)
    return df.agg(
        F.count("*").alias("total_rows"), F.count(parsed).alias("parsed_rows"),
        count_where(F.col(column).isNull()).alias("missing_dates"),
        count_where(F.col(column).isNotNull() & parsed.isNull()).alias("invalid_dates"),
        F.min(parsed).alias("earliest_date"), F.max(parsed).alias("latest_date"),
    )


def field_coverage(fact: DataFrame) -> DataFrame:
    """Calendar span (inclusive), days with any record, days with none."""
    days = fact.where(F.col("day").isNotNull()).select("day").distinct()
    span = F.datediff("last_date", "first_date") + 1
    return days.agg(
        F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.count("*").alias("dates_represented")
    ).withColumn("calendar_span_days", span).withColumn(
        "dates_without_records", F.col("calendar_span_days") - F.col("dates_represented")
    )


def _with_gaps(fact: DataFrame) -> DataFrame:
    """Distinct entity days with the previous recorded day. Distinct first, so an
    entity window is bounded by the calendar even where the key is not unique."""
    days = fact.where(F.col("day").isNotNull()).select("entity", "day").distinct()
    previous = F.lag("day").over(Window.partitionBy("entity").orderBy("day"))
    return days.withColumn("previous_day", previous).withColumn("gap_days", F.datediff("day", "previous_day"))


def coverage(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Span, recorded days, coverage share and gaps per entity."""
    per = _with_gaps(fact).groupBy("entity").agg(
        F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.count("*").alias("recorded_days"),
        F.coalesce(F.max("gap_days"), F.lit(0)).alias("max_gap_days"),
        *[count_where(F.col("gap_days") > n).alias(f"gaps_gt_{n}") for n in (1, 7, 30)],
    ).withColumn("calendar_span_days", F.datediff("last_date", "first_date") + 1)
    return with_names(per, dim).select(
        "entity", "entity_name", "first_date", "last_date", "calendar_span_days", "recorded_days",
        (F.col("calendar_span_days") - F.col("recorded_days")).alias("unrecorded_calendar_days"),
        rounded_ratio("recorded_days", "calendar_span_days", 2, 100, even=True).alias("coverage_pct"),
        "max_gap_days", "gaps_gt_1", "gaps_gt_7", "gaps_gt_30",
    )


def gaps(fact: DataFrame, dim: DataFrame, threshold: int = 7) -> DataFrame:
    """Gaps longer than the threshold, longest first."""
    long = _with_gaps(fact).where(F.col("gap_days") > threshold)
    return with_names(long, dim).select(
        "entity", "entity_name", F.col("previous_day").alias("previous_record_date"),
        F.col("day").alias("next_record_date"), "gap_days",
    ).orderBy(F.desc("gap_days"), "entity", "previous_record_date")


def shared_gaps(fact: DataFrame, threshold: int = 7) -> DataFrame:
    """The same gap window on more than one entity."""
    long = _with_gaps(fact).where(F.col("gap_days") > threshold)
    return long.groupBy(F.col("previous_day").alias("previous_record_date"), F.col("day").alias("next_record_date"),
                        "gap_days").agg(F.count("*").alias("entities")).where(F.col("entities") > 1)


def boundary(fact: DataFrame, rules: ReviewRules) -> DataFrame:
    """Rows outside the documented operating window."""
    after = F.lit(False) if rules.window_end is None else F.col("day") > F.lit(rules.window_end)
    return fact.agg(
        count_where(F.col("day") < F.lit(rules.window_start)).alias("rows_before"), count_where(after).alias("rows_after")
    )


def boundary_rows(fact: DataFrame, rules: ReviewRules) -> DataFrame:
    outside = F.col("day") < F.lit(rules.window_start)
    if rules.window_end is not None:
        outside = outside | (F.col("day") > F.lit(rules.window_end))
    return fact.where(outside).select("entity", "day", "state", "mode", "hours")


def _distinct_days() -> F.Column:
    """Distinct days among the rows of one month, as the bits of one number: no group a day is held."""
    return F.coalesce(F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.day("day") - 1))).cast("long"), F.lit(0).cast("long"))


def presence(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Days of each entity's span by what is recorded; the four counts add up to the span.

    Days without a record are the span minus the rest, so no calendar grid is built.
    """
    h, counted = F.col("hours"), ("active_days", "inactive_days", "hours_missing_days")
    months = dealt_by_month(fact).groupBy("entity", "year", "month").agg(
        F.min("day").alias("first"), F.max("day").alias("last"), _distinct_days().alias("days"),
        count_where(h > 0).alias("active_days"), count_where(h == 0).alias("inactive_days"),
        count_where(h.isNull()).alias("hours_missing_days"),
    )
    per = months.groupBy("entity").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), *[F.sum(c).alias(c) for c in ("days", *counted)]
    )
    return with_names(per, dim).select(
        "entity", "entity_name",
        (F.datediff("last", "first") + 1 - F.col("days")).alias("no_record_days"),
        "active_days", "inactive_days", "hours_missing_days",
    )


def presence_by_month(fact: DataFrame) -> DataFrame:
    """The grid variant per (entity, month): calendar days of the month against recorded days."""
    per = dealt_by_month(fact).groupBy("entity", "year", "month").agg(_distinct_days().alias("recorded_days")).select(
        "entity", F.make_date("year", "month", F.lit(1)).alias("month_start"), "recorded_days")
    bounds = per.groupBy("entity").agg(F.min("month_start").alias("first"), F.max("month_start").alias("last"))
    grid = bounds.select("entity", F.explode(F.expr("sequence(first, last, interval 1 month)")).alias("month_start"))
    return grid.join(per, ["entity", "month_start"], "left").select(
        "entity", "month_start", F.day(F.last_day("month_start")).alias("calendar_days"),
        F.coalesce("recorded_days", F.lit(0).cast("long")).alias("recorded_days"),
    )


def temporal_verdict(fact: DataFrame, dim: DataFrame, rules: ReviewRules) -> DataFrame:
    """FAIL on missing dates, REVIEW on gaps or rows outside the window, else PASS."""
    dates = date_integrity(fact.select("day"), "day").select(
        F.lit("bad_dates").alias("k"), (F.col("missing_dates") + F.col("invalid_dates")).alias("v"))
    outside = boundary(fact, rules).select(
        F.lit("outside_window").alias("k"), (F.col("rows_before") + F.col("rows_after")).alias("v"))
    cov = coverage(fact, dim).agg(
        count_where(F.col("gaps_gt_1") > 0).alias("entities_with_gaps"),
        F.max("max_gap_days").cast("long").alias("largest_gap_days"),
    ).unpivot([], ["entities_with_gaps", "largest_gap_days"], "k", "v")
    one = dates.unionByName(outside).unionByName(cov).groupBy().agg(
        *[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k)
          for k in ("bad_dates", "outside_window", "entities_with_gaps", "largest_gap_days")]
    )
    review = (F.col("entities_with_gaps") > 0) | (F.col("outside_window") > 0)
    return one.withColumn(
        "verdict", F.when(F.col("bad_dates") > 0, "FAIL").when(review, "PASS WITH REVIEW").otherwise("PASS")
    )
