"""Populations by run: what earlier runs counted, as the prior that drift checks compare with.

A population is a count that may grow from run to run (rows, entities, records of a known issue), named by its check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prodseries.functions.expr import count_where, dealt_by_month
from prodseries.operators.checks import ReviewRules


def issue_conditions(rules: ReviewRules) -> dict[str, Column]:
    """Known issue -> condition on a fact row."""
    return rules.conditions() | {"DQ-002": rules.in_gap()}


def populations(
    fact: DataFrame, monthly: DataFrame, rules: ReviewRules,
    raw_daily: DataFrame | None = None, raw_monthly: DataFrame | None = None, raw_day: str = "day",
) -> DataFrame:
    """One row per calendar month (`month`, its first day) with what that month adds to each population.

    An entity counts in its first month. Rows without a date or month are in the row whose month is NULL. Raw rows are
    counted if they are given. Every source is read once, and summed to months before it meets the others.
    """
    first = lambda c: F.trunc(c, "MM").alias("month")
    dated = F.make_date("year", "month", F.lit(1)).alias("month")
    issues = issue_conditions(rules)
    # one chain: rows to the months of an entity, which bound its window, and those to months
    held = dealt_by_month(fact).groupBy("entity", "year", "month").agg(F.count("*").alias("QC-002"), *[count_where(c).alias(i) for i, c in issues.items()])
    held = held.select("entity", dated, "QC-002", *[F.col(f"`{i}`") for i in issues])
    starts = F.col("entity").isNotNull() & (F.col("month") == F.min("month").over(Window.partitionBy("entity")))
    held = held.withColumn("QC-003", F.when(starts, 1).otherwise(0))
    counted = ["QC-002", "QC-003", *issues]
    parts = [
        held.groupBy("month").agg(*[F.sum(f"`{c}`").alias(c) for c in counted]),
        monthly.groupBy(dated).agg(F.count("*").alias("QC-005")),
    ]
    if raw_daily is not None:
        parts.append(raw_daily.groupBy(first(raw_day)).agg(F.count("*").alias("QC-001")))
    if raw_monthly is not None:
        parts.append(raw_monthly.groupBy(dated).agg(F.count("*").alias("QC-004")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    names = sorted(c for c in rows.columns if c != "month")
    return rows.groupBy("month").agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in names])


def _long(rows: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    return rows.unpivot(keep, [F.col(f"`{c}`") for c in names], "check_id", "actual")


def month_end_runs(months: DataFrame) -> DataFrame:
    """(run, check_id, actual): the populations that a run after each month would have counted.

    `months` is a result of populations(): one row per calendar month, which bounds the running sum of each check. Undated
    rows count in every run.
    """
    names = [c for c in months.columns if c != "month"]
    so_far = Window.partitionBy("check_id").orderBy(F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    added = _long(months.withColumnRenamed("month", "run"), ["run"], names)
    return added.withColumn("actual", F.sum("actual").over(so_far)).where(F.col("run").isNotNull())


def month_end_prior(months: DataFrame) -> DataFrame:
    """(check_id, actual) of the last run but one of month_end_runs(): everything except the last month's share."""
    names = [c for c in months.columns if c != "month"]
    before = lambda c: F.sum(f"`{c}`") - F.coalesce(F.max_by(f"`{c}`", "month"), F.lit(0))
    return _long(months.agg(*[F.coalesce(before(c), F.lit(0)).cast("long").alias(c) for c in names]), [], names)

