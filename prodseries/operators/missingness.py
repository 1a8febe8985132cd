"""Where values are missing and what the absence follows.

Each report makes one pass over the rows that counts NULLs of every column at
once; everything after works on those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prodseries.functions.expr import count_where, rounded_ratio


def _null_counts(df: DataFrame, columns, groups: dict[str, Column]) -> DataFrame:
    """Rows and missing values per group and column, in long form."""
    wide = df.groupBy(*[c.alias(n) for n, c in groups.items()]).agg(
        F.count("*").alias("_rows"), *[count_where(F.col(c).isNull()).alias(f"_m_{i}") for i, c in enumerate(columns)]
    )
    long = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m_{i}").alias("missing_count")) for i, c in enumerate(columns)
    ])
    return wide.select(*groups, F.col("_rows").alias("total_rows"), F.inline(long))


def _share(missing="missing_count", total="total_rows"):
    return rounded_ratio(missing, total, 2, 100, even=True)


def overview(df: DataFrame, columns=None) -> DataFrame:
    """Missing and present values per column."""
    counts = _null_counts(df, columns or df.columns, {})
    return counts.select(
        "column", "total_rows", "missing_count", _share().alias("missing_pct"),
        (F.col("total_rows") - F.col("missing_count")).alias("non_missing_count"),
    )


def hours_status() -> Column:
    h = F.col("hours")
    return F.when(h.isNull(), "hours_missing").when(h == 0, "inactive").otherwise("active")


CONTEXTS = {
    "entity": lambda: F.col("entity").cast("string"),
    "year": lambda: F.year("day").cast("string"),
    "state": lambda: F.col("state"),
    "mode": lambda: F.col("mode"),
    "hours_status": hours_status,
}


def by_group(df: DataFrame, columns, context: str) -> DataFrame:
    """Missing share per column within each value of one context."""
    counts = _null_counts(df, columns, {"group_value": CONTEXTS[context]()})
    return counts.select(
        F.lit(context).alias("context"), "group_value", "column", "total_rows", "missing_count", _share().alias("missing_pct")
    )


def by_contexts(df: DataFrame, columns, contexts=tuple(CONTEXTS)) -> DataFrame:
    """Missing share per column within each value of several contexts, from one pass.

    Rows are counted once per combination of context values; each context is then
    summed from those cells.
    """
    cells = df.groupBy(*[CONTEXTS[c]().alias(c) for c in contexts]).agg(
        F.count("*").alias("_rows"), *[count_where(F.col(c).isNull()).alias(f"_m_{i}") for i, c in enumerate(columns)]
    )
    tags = F.array(*[F.struct(F.lit(c).alias("context"), F.col(c).alias("group_value")) for c in contexts])
    sums = cells.select("_rows", *[f"_m_{i}" for i in range(len(columns))], F.inline(tags)).groupBy("context", "group_value").agg(
        F.sum("_rows").alias("total_rows"), *[F.sum(f"_m_{i}").alias(f"_m_{i}") for i in range(len(columns))]
    )
    long = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m_{i}").alias("missing_count")) for i, c in enumerate(columns)
    ])
    return sums.select("context", "group_value", "total_rows", F.inline(long)).withColumn("missing_pct", _share())


def by_combination(df: DataFrame, columns) -> DataFrame:
    """Missing share per column for each state and mode together."""
    counts = _null_counts(df, columns, {"state": F.col("state"), "mode": F.col("mode")})
    return counts.select("state", "mode", "column", "total_rows", "missing_count", _share().alias("missing_pct"))


def separation(df: DataFrame, columns) -> DataFrame:
    """Does state and mode separate present from missing: every combination below 1 % or above 99 %."""
    p = F.col("missing_pct")
    return by_combination(df, columns).groupBy("column").agg(
        F.min(p).alias("min_pct"), F.max(p).alias("max_pct"), F.bool_and((p < 1) | (p > 99)).alias("cleanly_separated")
    )


def _spreads(df: DataFrame, columns, threshold: int = 50) -> DataFrame:
    """Overall share and its spread across states and across modes, per column; ``wide``: a spread above the threshold.

    The threshold is held against the counts themselves, not against the rounded spread.
    """
    combos = _null_counts(df, columns, {"state": F.col("state"), "mode": F.col("mode")})

    def spread(key):
        per = combos.groupBy("column", key).agg(F.sum("missing_count").alias("m"), F.sum("total_rows").alias("n"))
        s, counts, share = _share("m", "n"), F.struct("m", "n"), F.col("m") / F.col("n")
        found = per.groupBy("column").agg((F.max(s) - F.min(s)).alias(f"{key}_spread"), F.max_by(counts, share).alias("x"), F.min_by(counts, share).alias("y"))
        exact = lambda c: F.col(c).cast("decimal(18,0)")
        above = 100 * (exact("x.m") * exact("y.n") - exact("y.m") * exact("x.n")) > threshold * exact("x.n") * exact("y.n")
        return found.withColumn(f"{key}_wide", above).drop("x", "y")

    total = combos.groupBy("column").agg(F.sum("missing_count").alias("missing_count"), F.sum("total_rows").alias("total_rows"))
    # one row per column of the table
    joined = total.join(F.broadcast(spread("state")), "column").join(F.broadcast(spread("mode")), "column")
    return joined.withColumn("missing_pct", _share()).withColumn("wide", F.col("state_wide") | F.col("mode_wide")).withColumn(
        "spread_pp", F.greatest("state_spread", "mode_spread").cast("decimal(28,2)")
    )


def classification(df: DataFrame, columns, structural=(), measurement=("hours",), threshold=50) -> DataFrame:
    """STRUCTURAL, CONTEXTUAL or MEASUREMENT per column."""
    c = F.col("column")
    kind = (
        F.when(c.isin(*structural), "STRUCTURAL")
        .when(c.isin(*measurement), "MEASUREMENT")
        .when(F.col("missing_pct") == 0, "STRUCTURAL")
        .when(F.col("wide"), "CONTEXTUAL")
        .otherwise("MEASUREMENT")
    )
    return _spreads(df, columns, threshold).select("column", "missing_pct", "spread_pp", kind.alias("classification"))


def patterns(df: DataFrame, columns, known: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """What the missing values of a column follow: mode, a few entities, one year, or nothing.

    The two largest entities are picked with a rank limit that runs inside each
    input partition first.
    """
    known = known or {}
    cells = _null_counts(df, columns, {"entity": F.col("entity"), "year": F.year("day")}).where(F.col("missing_count") > 0)

    def top(key, n, name):
        per = cells.groupBy("column", key).agg(F.sum("missing_count").alias("m"))
        order = Window.partitionBy("column").orderBy(F.desc("m"), key)
        kept = per.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
        return kept.groupBy("column").agg(F.sum("m").alias(name))

    facts = (
        _spreads(df, columns)
        .join(F.broadcast(top("entity", 2, "top2_entities")), "column", "left")
        .join(F.broadcast(top("year", 1, "top_year")), "column", "left")
    )
    # shares of 0.7 and 0.5, as products of counts
    few, one = F.col("top2_entities") * 10 > F.col("missing_count") * 7, F.col("top_year") * 2 > F.col("missing_count")
    label = F.when(F.col("missing_count") == 0, "none")
    status = F.when(F.col("missing_count") == 0, "PASS")
    for col, (pattern, issue) in known.items():
        label = label.when(F.col("column") == col, pattern)
        status = status.when(F.col("column") == col, issue)
    label = (
        label.when(F.col("wide"), "follows operating mode")
        .when(few & one, "concentrated by entity and time")
        .when(few, "concentrated by entity")
        .when(one, "concentrated by time")
        .otherwise("spread broadly")
    )
    return facts.select("column", "missing_pct", label.alias("pattern"), status.otherwise("REVIEW").alias("status"))
