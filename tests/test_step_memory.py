"""Rows are dealt by entity and month ahead of sums by these, and no task holds wide groups a day."""

import datetime as dt
import re
from decimal import Decimal

import pytest

from prodseries.operators import checks, profile, temporal
from prodseries.plans import registry

SF = "/root/testdata/sf0.001"
FACT = "entity long, day date, hours decimal(18,6), oil decimal(18,6), gas decimal(18,6), water decimal(18,6), injection decimal(18,6)"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, *keys):
    """A row a key (entity, day, hours) with one of each volume."""
    one = Decimal(1)
    return spark.createDataFrame([(e, d, None if h is None else Decimal(h), one, one, one, one) for e, d, h in keys], FACT)


DAYS = [(1, dt.date(2020, 1, 1), 5), (1, dt.date(2020, 1, 1), 0), (1, dt.date(2020, 1, 1), None), (1, dt.date(2020, 1, 31), 0),
        (1, dt.date(2020, 2, 1), 1), (1, None, 1), (1, None, 1), (2, dt.date(2020, 1, 31), 1), (None, dt.date(2020, 1, 31), 1),
        (None, dt.date(2020, 1, 31), 1)]


@pytest.mark.parametrize("name", ["qc_results", "nq_assessment", "vw_monthly", "vw_field_monthly", "load_monthly_core", "nq_presence", "nq_presence_by_month"])
def test_months_are_dealt_before_they_are_summed(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert re.search(r"hashpartitioning\(entity#\d+L?, year#\d+, month#\d+, \d+\), REPARTITION_BY_COL", text)


def test_no_wide_group_a_day(spark):
    flags = checks.row_flags(rows(spark, *DAYS).selectExpr("*", "'OP' AS state", "'production' AS mode"), checks.ReviewRules())
    fact, monthly = rows(spark, *DAYS).selectExpr("*", "'OP' AS state", "'production' AS mode"), spark.createDataFrame([], "entity long, year int, month int, oil int, gas int, water int, injection int")
    text = plan(checks.entity_months(fact, monthly, flags)[0])
    assert not re.search(r"HashAggregate\(keys=\[entity#\d+L?, day#\d+\]", text)


def test_entity_months_count_repeated_days_once(spark):
    fact = rows(spark, *DAYS)
    monthly = spark.createDataFrame([(1, 2020, 1, 4, 4, 4, 4), (1, 2020, 1, 9, 4, 4, 4)], "entity long, year int, month int, oil int, gas int, water int, injection int")
    held, names = checks.entity_months(fact, monthly, {"no hours": fact.hours.isNull(), "idle": fact.hours == 0})
    found = [r.asDict() for r in held.collect()]
    total = {n: sum(r[n] for r in found) for n in names}
    # a NULL entity or day is no key; the monthly key comes twice, and what was counted stays with its first row
    assert total == {"QC-002": 10, "QC-005": 2, "QC-006": 1, "QC-007": 1, "QC-014": 4, "QC-015": 0, "QC-016": 5, "no hours": 1, "idle": 2}


def test_presence_counts_days_not_rows(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "entity long, entity_name string")
    got = {r.entity: tuple(r)[2:] for r in temporal.presence(rows(spark, *DAYS), dim).collect()}
    assert got == {1: (29, 4, 2, 1), 2: (0, 1, 0, 0)}  # no record, active, inactive, hours missing
    months = {(r.entity, str(r.month_start)): r.recorded_days for r in temporal.presence_by_month(rows(spark, *DAYS).where("entity = 1")).collect()}
    assert months == {(1, "2020-01-01"): 2, (1, "2020-02-01"): 1}


def test_grain_summary_groups_by_key_alone(spark):
    df = rows(spark, *DAYS)
    got = profile.grain_summary(df, ["entity", "day"]).first()
    assert tuple(got) == (1, 3, False)
    assert tuple(profile.grain_summary(df.limit(0), ["entity", "day"]).first()) == (0, 0, True)
    assert "hours" not in plan(profile.grain_summary(registry.QUERIES["load_daily_core"](spark, SF), ["npd_well_bore_code", "production_date"]))
    assert plan(profile.grain_summary(df, ["entity", "day"])).count("Exchange hashpartitioning") == 1
