"""Record states: what a daily record says about itself, taking all columns together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prodseries.functions.expr import any_positive, count_where, holds, rounded_ratio
from prodseries.operators.checks import ReviewRules
from prodseries.spec import VOLUMES

COHERENT = ("TRANSITION_STATE", "BLANK_STATE_RECORD", "INACTIVE_RECORDED", "ACTIVE_PRODUCTION", "ACTIVE_INJECTION")


def state_label() -> Column:
    """Seven states, the first that applies; NULL only for negative hours."""
    hours = F.col("hours")
    producing, injecting = any_positive(VOLUMES), holds(F.col("injection") > 0)
    return (
        F.when(holds((F.col("state") == "WI") & (F.col("mode") == "production")), "TRANSITION_STATE")
        .when(hours.isNull(), "BLANK_STATE_RECORD")
        .when((hours == 0) & (producing | injecting), "INCONSISTENT")
        .when(hours == 0, "INACTIVE_RECORDED")
        .when((hours > 0) & producing, "ACTIVE_PRODUCTION")
        .when((hours > 0) & injecting, "ACTIVE_INJECTION")
        .when(hours > 0, "REVIEW")
    )


def record_state(fact: DataFrame) -> DataFrame:
    return fact.withColumn("record_state", state_label())


def state_summary(fact: DataFrame) -> DataFrame:
    """Rows and share per state; the total is the sum over seven rows."""
    counts = record_state(fact).groupBy("record_state").agg(F.count("*").alias("row_count"))
    n = counts.agg(F.sum("row_count")).scalar()
    return counts.select(
        "record_state", "row_count", rounded_ratio("row_count", n, 2, 100, even=True).alias("pct"),
        F.col("record_state").isin(*COHERENT).alias("coherent"),
    )


def coherence(fact: DataFrame) -> DataFrame:
    good = F.col("record_state").isin(*COHERENT)
    return record_state(fact).agg(
        F.count("*").alias("total_rows"), count_where(good).alias("coherent_rows"),
        count_where(~good).alias("to_interpret"), count_where(F.col("record_state").isNull()).alias("unclassified"),
    ).withColumn("coherent_pct", rounded_ratio("coherent_rows", "total_rows", 2, 100, even=True))


def _explanations(rules: ReviewRules, recovery_days=()) -> dict[str, Column]:
    issues = rules.conditions()
    on_day = F.lit(False)
    for entity, day in recovery_days:
        on_day = on_day | ((F.col("entity") == entity) & (F.col("day") == F.lit(day)))
    small = (F.col("hours") == 0) & (F.col("injection") > 0) & (F.col("injection") <= rules.injection_floor)
    return {
        "DQ-005": holds(issues["DQ-005"]),
        "DQ-006": holds(issues["DQ-006"]),
        "shutdown recovery": on_day,
        "small idle injection": holds(small),
    }


def inconsistent_breakdown(fact: DataFrame, rules: ReviewRules, recovery_days=()) -> DataFrame:
    """How many INCONSISTENT records each known explanation covers, and how many none does.

    An explanation counts every record it covers, so a record may count twice;
    the last row counts records no explanation covers.
    """
    why = _explanations(rules, recovery_days)
    uncovered = ~F.greatest(*why.values())
    counted = record_state(fact).where(F.col("record_state") == "INCONSISTENT").agg(
        F.count("*").alias("n"), *[count_where(c).alias(f"w{i}") for i, c in enumerate(why.values())],
        count_where(uncovered).alias("none"),
    )
    rows = [F.struct(F.lit(k).alias("explained_by"), F.col(f"w{i}").alias("row_count")) for i, k in enumerate(why)]
    rows = [F.struct(F.lit("total").alias("explained_by"), F.col("n").alias("row_count")), *rows]
    rows.append(F.struct(F.lit("not covered").alias("explained_by"), F.col("none").alias("row_count")))
    return counted.select(F.inline(F.array(*rows)))


def uncovered_rows(fact: DataFrame, rules: ReviewRules, recovery_days=()) -> DataFrame:
    """INCONSISTENT records that no known explanation covers."""
    why = _explanations(rules, recovery_days)
    rows = record_state(fact).where((F.col("record_state") == "INCONSISTENT") & ~F.greatest(*why.values()))
    return rows.select("entity", "day", "state", "mode", "hours", "oil", "gas", "water", "injection")


def review_breakdown(fact: DataFrame) -> DataFrame:
    """REVIEW records by entity, state and mode."""
    return record_state(fact).where(F.col("record_state") == "REVIEW").groupBy("entity", "state", "mode").agg(
        F.count("*").alias("row_count")
    )
