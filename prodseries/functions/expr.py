"""Column expressions. NULL means "not measured" and is never turned into 0 here."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from prodseries.spec import TOTAL


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def holds(cond: Column) -> Column:
    """Two-valued condition: unknown counts as not holding."""
    return F.coalesce(cond, F.lit(False))


def any_of(conds) -> Column:
    return reduce(or_, conds)


def all_of(conds) -> Column:
    return reduce(and_, conds)


def any_positive(cols) -> Column:
    """At least one of the columns is above zero; NULLs never count."""
    return any_of(holds(F.col(c) > 0) for c in cols)


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as DECIMAL(28,6); NULL when den is 0 or either side is NULL."""
    d = col(den).cast("double")
    return (col(num).cast("double") / F.nullif(d, F.lit(0.0))).cast(TOTAL)


def pct(num: str | Column, den: str | Column) -> Column:
    """100 * num / den as DECIMAL(28,6); NULL when den is 0 or either side is NULL."""
    d = col(den).cast("double")
    return (F.lit(100.0) * col(num).cast("double") / F.nullif(d, F.lit(0.0))).cast(TOTAL)


def rounded_ratio(num: str | Column, den: str | Column, dp: int, times: int = 1, even: bool = False) -> Column:
    """times * num / den with dp decimals, rounded once from the exact quotient of the two decimals.

    Halves go away from zero, or with ``even`` to the even neighbour. NULL when den is 0 or either side is NULL.
    """
    n, d = col(num).cast(TOTAL), F.nullif(col(den).cast(TOTAL), F.lit(0).cast(TOTAL))
    top, low = F.abs(n) * F.lit(times * 10**dp), F.abs(d)
    whole = F.call_function("div", top, low)
    twice = (top % low) * F.lit(2)
    up = F.when(twice > low, 1).when(twice == low, whole % 2 if even else F.lit(1)).otherwise(0)
    sign = F.when((n < 0) != (d < 0), -1).otherwise(1)
    return (((whole + up) * sign).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-dp))).cast(f"decimal(28,{dp})")


def rounded(c: str | Column, dp: int) -> Column:
    """Round half away from zero on the decimal value."""
    return F.round(col(c), dp).cast(f"decimal(28,{dp})")


def rounded_even(c: str | Column, dp: int) -> Column:
    """Round half to even, the convention of the profiling reports."""
    return F.bround(col(c), dp).cast(f"decimal(28,{dp})")


def total(c: str | Column) -> Column:
    """Sum that stays NULL when every value is NULL."""
    return F.sum(col(c)).cast(TOTAL)


def mean(c: str | Column) -> Column:
    return ratio(F.sum(col(c)), F.count(col(c)))


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def month_start(c: str | Column) -> Column:
    return F.trunc(col(c), "MM")


def dealt_by_month(fact: DataFrame) -> DataFrame:
    """The rows with their `year` and `month`, dealt by entity, year and month ahead of sums by these.

    Where an entity has a row a day at most, partial sums by month save next to nothing on rows that lie dealt by
    (entity, day): a place has one or two days of a month. They would hold a wide group for nearly every row, beside the
    groups of the step that made the rows. Dealt first, a month is summed in one place, which holds a group a month.
    """
    return fact.withColumns({"year": F.year("day"), "month": F.month("day")}).repartition("entity", "year", "month")


def clock_change_day(year: str | Column) -> Column:
    """Last Sunday of October of the year."""
    last = F.make_date(col(year), F.lit(10), F.lit(31))
    return F.next_day(F.date_sub(last, 7), "SUN")


def days_in_month(c: str | Column) -> Column:
    return F.day(F.last_day(col(c)))


def unpivot(df: DataFrame, keep, columns, name="column", value="value") -> DataFrame:
    """Wide to long: one row per (row, column)."""
    return df.unpivot([F.col(c) for c in keep], [F.col(c) for c in columns], name, value)


def pairs(columns: dict[str, Column], name: str, value: str) -> Column:
    """Array of (name, value) structs, to be exploded into one row per pair."""
    return F.array(*[F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in columns.items()])
