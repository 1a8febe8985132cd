"""Daily rows against an independent monthly extract."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window, functions as F

from prodseries.functions.expr import count_where, days_in_month, dealt_by_month, holds, pct, rounded_ratio, total
from prodseries.spec import TOTAL

METRICS = ("hours", "oil", "gas", "water", "injection")
KEY = ("entity", "year", "month")


def monthly_totals(fact: DataFrame, metrics=METRICS) -> DataFrame:
    return dealt_by_month(fact).groupBy("entity", "year", "month").agg(
        *[total(m).alias(m) for m in metrics], F.count("*").alias("daily_rows")
    )


def _both_sides(fact: DataFrame, monthly: DataFrame, metrics) -> DataFrame:
    d = monthly_totals(fact, metrics).select(
        *KEY, F.lit(True).alias("in_daily"), "daily_rows", *[F.col(m).alias(f"d_{m}") for m in metrics]
    )
    m = monthly.select(
        *KEY, F.lit(True).alias("in_monthly"), *[F.col(c).cast(TOTAL).alias(f"m_{c}") for c in metrics]
    )
    return d.join(m, list(KEY), "full_outer")


def reconcile(fact: DataFrame, monthly: DataFrame, metrics=METRICS, tolerance: float = 1e-6) -> DataFrame:
    """One row per entity-month and metric with both values and the outcome.

    DAILY_ONLY / MONTHLY_ONLY: the entity-month exists on one side. MATCH: equal
    within the tolerance. NULL_CONVENTION: the monthly side leaves blank what the
    daily side sums to nothing or to zero. MISMATCH: everything else.
    """
    tol = F.lit(tolerance).cast(TOTAL)
    sides = _both_sides(fact, monthly, metrics)
    long = sides.select(
        *KEY, "in_daily", "in_monthly", "daily_rows",
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(f"d_{m}").alias("daily_value"), F.col(f"m_{m}").alias("monthly_value"))
            for m in metrics
        ])),
    )
    zero = F.lit(0).cast(TOTAL)
    both = F.col("in_daily") & F.col("in_monthly")
    diff = F.when(both, (F.coalesce("daily_value", zero) - F.col("monthly_value")).cast(TOTAL))
    blank = F.col("monthly_value").isNull() & (F.abs(F.coalesce("daily_value", zero)) < tol)
    return long.select(
        *KEY, "metric", "daily_value", "monthly_value", "daily_rows",
        diff.alias("abs_diff"),
        pct(diff, F.abs("monthly_value")).alias("pct_diff"),
        F.when(F.col("in_monthly").isNull(), "DAILY_ONLY")
        .when(F.col("in_daily").isNull(), "MONTHLY_ONLY")
        .when(holds(F.abs(diff) < tol), "MATCH")
        .when(blank, "NULL_CONVENTION")
        .otherwise("MISMATCH").alias("outcome"),
    )


def mismatch_counts(
    fact: DataFrame, monthly: DataFrame, tolerance: float = 1e-6, metrics=("oil", "gas", "water", "injection"),
) -> DataFrame:
    """The three reconciliation checks: one-sided entity-months and values that differ
    on any of the metrics (four volumes), a missing side counting as zero."""
    tol, zero = F.lit(tolerance).cast(TOTAL), F.lit(0).cast(TOTAL)
    off = None
    for m in metrics:
        differs = F.abs(F.coalesce(f"d_{m}", zero) - F.coalesce(f"m_{m}", zero)) > tol
        off = differs if off is None else off | differs
    return _both_sides(fact, monthly, metrics).agg(
        count_where(F.col("in_monthly").isNull()).alias("QC-014"),
        count_where(F.col("in_daily").isNull()).alias("QC-015"),
        count_where(off).alias("QC-016"),
    )


def summary(detail: DataFrame) -> DataFrame:
    """Outcome counts per metric over the entity-months found on both sides."""
    is_ = lambda o: F.col("outcome") == o
    counts = detail.groupBy("metric").agg(
        count_where(is_("MATCH") | is_("NULL_CONVENTION") | is_("MISMATCH")).alias("n_comparable"),
        count_where(is_("MATCH")).alias("match_count"),
        count_where(is_("NULL_CONVENTION")).alias("null_convention"),
        count_where(is_("MISMATCH")).alias("mismatch"),
        count_where(is_("DAILY_ONLY")).alias("daily_only"),
        count_where(is_("MONTHLY_ONLY")).alias("monthly_only"),
        F.max(F.when(is_("MATCH"), F.abs("abs_diff"))).alias("max_abs_diff_among_matches"),
    )
    accounted = F.col("match_count") + F.col("null_convention")
    return counts.withColumn("accounted_for_rate", rounded_ratio(accounted, "n_comparable", 2, 100, even=True))


def by_entity(detail: DataFrame) -> DataFrame:
    """Median and largest percentage difference per entity and metric (a group holds
    at most one row per calendar month). The median is exact: the middle two are halved as decimals."""
    both = detail.where(F.col("outcome").isin("MATCH", "NULL_CONVENTION", "MISMATCH"))
    ordered = both.groupBy("entity", "metric").agg(
        F.count("*").alias("n_months"), F.sort_array(F.collect_list("pct_diff")).alias("v"), F.max(F.abs("pct_diff")).alias("max_abs_pct_diff"),
    )
    n = F.size("v")
    middle = F.get("v", F.floor((n - 1) / 2).cast("int")) + F.get("v", F.floor(n / 2).cast("int"))
    median = (middle * F.lit(Decimal("0.5"))).cast(TOTAL)
    return ordered.select("entity", "metric", "n_months", median.alias("median_pct_diff"), "max_abs_pct_diff")


def top_differences(detail: DataFrame, n: int = 3) -> DataFrame:
    """Largest differences per metric with the month's missing days. The rank limit is
    applied inside every input partition before rows are brought together."""
    w = Window.partitionBy("metric").orderBy(F.desc(F.abs("abs_diff")), *KEY)
    expected = days_in_month(F.make_date("year", "month", F.lit(1)))
    return (
        detail.where(F.col("abs_diff").isNotNull())
        .withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
        .select(
            "metric", "position", *KEY, "daily_value", "monthly_value", "abs_diff", "pct_diff", "daily_rows",
            expected.alias("expected_days_in_month"),
            (F.col("daily_rows") - expected).alias("daily_rows_vs_expected"),
        )
    )


def verdict(detail: DataFrame) -> DataFrame:
    """PASS at 99 % without one-sided months, REVIEW at 90 %, otherwise FAIL."""
    rates = summary(detail)
    overall = rates.agg(
        F.avg(F.col("accounted_for_rate").cast("double")).alias("r"),
        F.max(F.col("daily_only") + F.col("monthly_only")).alias("coverage_gaps"),
        F.sum("mismatch").alias("total_mismatches"),
    )
    return overall.select(
        F.col("r").cast(TOTAL).alias("avg_accounted_for_rate"), "coverage_gaps", "total_mismatches",
        F.when((F.col("coverage_gaps") == 0) & (F.col("r") >= 99), "PASS")
        .when(F.col("r") >= 90, "PASS WITH REVIEW").otherwise("FAIL").alias("verdict"),
    )
