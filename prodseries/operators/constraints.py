"""Integrity rules as validation jobs: each returns the violating rows.

Not constrained on purpose, reviewed instead: water below zero, hours above 24,
choke above 100, downhole below wellhead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from prodseries.functions.expr import any_of, count_where, holds
from prodseries.spec import MODES, STATES, SeriesSpec


def unique(df: DataFrame, keys) -> DataFrame:
    """Keys held by more than one row, with the row count. NULL keys are not grouped
    here; they are reported by :func:`not_null`."""
    complete = df.where(~any_of(F.col(k).isNull() for k in keys))
    return complete.groupBy(*keys).agg(F.count("*").alias("row_count")).where(F.col("row_count") > 1)


def not_null(df: DataFrame, cols) -> DataFrame:
    return df.where(any_of(F.col(c).isNull() for c in cols))


def foreign_key(df: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose key is missing from the parent; a NULL key does not violate."""
    parents = parent.select(F.col(parent_key or key).alias(key))
    return df.where(F.col(key).isNotNull()).join(parents, key, "left_anti")


def domain(df: DataFrame, column: str, allowed) -> DataFrame:
    return df.where(~F.col(column).isin(list(allowed)))


def non_negative(df: DataFrame, cols) -> DataFrame:
    return df.where(any_of(holds(F.col(c) < 0) for c in cols))


def check(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows where the predicate is false; unknown passes, as in a CHECK constraint."""
    return df.where(~predicate)


@dataclass(frozen=True)
class CandidateRule:
    """A rule that might be enforced, with the condition a violating row meets."""

    name: str
    violated: Column
    confirmed: bool = True  # False: the meaning of the column is not confirmed


def daily_rules(fact: DataFrame, spec: SeriesSpec) -> list[CandidateRule]:
    """Candidate rules of the daily fact, enforced or deliberately not."""
    rules = [
        CandidateRule("state in {OP, WI}", ~F.col("state").isin(*STATES)),
        CandidateRule("mode in {production, injection}", ~F.col("mode").isin(*MODES)),
    ]
    bounded = ["hours", "oil", "gas", "water", "injection", *spec.sensors]
    rules += [CandidateRule(f"{c} >= 0", F.col(c) < 0) for c in bounded if c in fact.columns]
    if "choke_unit" in fact.columns:
        rules.append(CandidateRule("choke_unit is % or NULL", F.col("choke_unit") != "%"))
    rules.append(CandidateRule("hours <= 24", F.col("hours") > 24, confirmed=False))
    if spec.choke in fact.columns:
        rules.append(CandidateRule(f"{spec.choke} <= 100", F.col(spec.choke) > 100, confirmed=False))
    rules += [
        CandidateRule(f"{hi} >= {lo}", F.col(hi) < F.col(lo), confirmed=False)
        for hi, lo in spec.ordered_sensors
        if hi in fact.columns and lo in fact.columns
    ]
    return rules


def propose_constraints(df: DataFrame, rules: list[CandidateRule]) -> DataFrame:
    """Violations per candidate rule in one scan. Only a confirmed rule with no
    violation becomes a hard constraint."""
    counted = df.agg(*[count_where(r.violated).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = [
        F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("violations"), F.lit(r.confirmed).alias("confirmed"))
        for i, r in enumerate(rules)
    ]
    enforce = F.col("confirmed") & (F.col("violations") == 0)
    return counted.select(F.inline(F.array(*rows))).select(
        "rule", "violations", F.when(enforce, "ENFORCE").otherwise("DO NOT ENFORCE").alias("decision")
    )
