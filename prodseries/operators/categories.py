"""Category values: inventory, stability over time and agreement with activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prodseries.functions.expr import all_of, count_where, holds, rounded_ratio
from prodseries.spec import FLUIDS


def inventory(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per value; NULL is a value of its own."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("row_count"))
    n = counts.agg(F.sum("row_count")).scalar()
    return counts.select(
        F.lit(column).alias("column"), "value", "row_count", rounded_ratio("row_count", n, 2, 100, even=True).alias("pct")
    )


def normalisation(df: DataFrame, columns) -> DataFrame:
    """Would trimming or lower-casing merge values? Worked out on distinct values only."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ]))).where(F.col("value").isNotNull()).distinct()
    trimmed = F.trim("value")
    per = long.groupBy("column").agg(
        F.count("*").alias("raw_distinct"), F.countDistinct(trimmed).alias("trimmed_distinct"),
        F.countDistinct(F.lower(trimmed)).alias("folded_distinct"),
    )
    return per.withColumn("would_merge", F.col("folded_distinct") < F.col("raw_distinct"))


def spans(fact: DataFrame, column: str) -> DataFrame:
    """Days and first/last day of each value per entity."""
    return fact.groupBy("entity", F.col(column).alias("value")).agg(
        F.count("*").alias("row_count"), F.min("day").alias("first_date"), F.max("day").alias("last_date")
    )


def stability(fact: DataFrame, column: str) -> DataFrame:
    """Distinct values per entity; more than one is REVIEW. The list holds category labels only."""
    return spans(fact, column).groupBy("entity").agg(
        F.count("value").alias("distinct_count"),
        F.array_join(F.sort_array(F.collect_set("value")), ",").alias("value_list"),
    ).withColumn("status", F.when(F.col("distinct_count") > 1, "REVIEW").otherwise("PASS"))


def _steps(fact: DataFrame, column: str) -> DataFrame:
    w = Window.partitionBy("entity").orderBy("day")
    return (
        fact.where(F.col("day").isNotNull()).select("entity", "day", F.col(column).alias("current"))
        .withColumn("previous", F.lag("current").over(w)).where(F.col("previous").isNotNull())
    )


def transition_tally(fact: DataFrame, column: str) -> DataFrame:
    """Counts of ``a->b`` over consecutive records, unchanged pairs included."""
    label = F.concat(F.col("previous"), F.lit("->"), F.col("current"))
    return _steps(fact, column).groupBy(label.alias("transition")).agg(F.count("*").alias("row_count"))


def changes(fact: DataFrame, column: str) -> DataFrame:
    """Actual changes only, with their date."""
    return _steps(fact, column).where(~F.col("previous").eqNullSafe(F.col("current"))).select(
        "entity", "previous", "current", F.col("day").alias("transition_date")
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair with totals, and each cell's share of all rows."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    # totals are built from the pair counts, not from the rows
    cells = pairs.cube(a, b).agg(F.sum("n").alias("row_count"))
    n = pairs.agg(F.sum("n")).scalar()
    return cells.select(
        F.coalesce(a, F.lit("Total")).alias(a), F.coalesce(b, F.lit("Total")).alias(b), "row_count",
        rounded_ratio("row_count", n, 2, 100, even=True).alias("pct"),
    )


def activity(fact: DataFrame, groups=("state", "mode")) -> DataFrame:
    """Positive, all-zero and all-NULL volumes per state and mode."""
    return fact.groupBy(*groups).agg(
        F.count("*").alias("row_count"),
        *[count_where(F.col(c) > 0).alias(f"{c}_gt_0") for c in FLUIDS],
        count_where(all_of(holds(F.col(c) == 0) for c in FLUIDS)).alias("all_volumes_zero"),
        count_where(all_of(F.col(c).isNull() for c in FLUIDS)).alias("all_volumes_null"),
    )


def attribute_classes(fact: DataFrame, temporal=("state", "mode"), constant=()) -> DataFrame:
    """TEMPORAL when the value of some entity changes, STATIC when it never does; a label
    column is STATIC with at most one value and UNCLEAR otherwise."""
    out = None
    for c in temporal:
        n = changes(fact, c).agg(F.count("*").alias("evidence_count"))
        row = n.select(
            F.lit(c).alias("attribute"), "evidence_count",
            F.when(F.col("evidence_count") > 0, "TEMPORAL").otherwise("STATIC").alias("classification"),
        )
        out = row if out is None else out.unionByName(row)
    for c in constant:
        n = fact.agg(F.countDistinct(c).alias("evidence_count"))
        row = n.select(
            F.lit(c).alias("attribute"), "evidence_count",
            F.when(F.col("evidence_count") <= 1, "STATIC").otherwise("UNCLEAR").alias("classification"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def label(column: str | Column, names: dict[str, str]) -> Column:
    """Display label of a code; an unknown code is its own label."""
    c = F.col(column) if isinstance(column, str) else column
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(mapping[c], c)
