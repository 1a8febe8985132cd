"""Source profiling: shape, dates, identifiers, categories, missingness, grain, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from prodseries.functions.expr import any_of, count_where, ratio
from prodseries.functions.order_stats import exact_percentiles
from prodseries.operators import missingness
from prodseries.spec import TOTAL, SeriesSpec, role_of

# The numeric columns profiled by default, where present.
NUMERIC_CANDIDATES = (
    "hours", "downhole_pressure", "downhole_temperature", "tubing_dp", "annulus_pressure", "choke_size",
    "wellhead_pressure", "wellhead_temperature", "choke_dp", "oil", "gas", "water", "injection",
)


def shape(df: DataFrame, name: str) -> DataFrame:
    """Row count with every column's position and type."""
    cols = [
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count", F.inline(F.array(*cols))
    )


def schema_diff(expected: T.StructType, df: DataFrame) -> DataFrame:
    """Missing, unexpected, retyped and case-renamed columns against an expected schema.

    Duplicate names are reported too; this reads no data.
    """
    want = {f.name: f.dataType.simpleString() for f in expected.fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    folded = {n.lower().replace(" ", "_"): n for n in have if n not in want}
    rows = []
    for n, t in want.items():
        if n in have:
            if have[n] != t:
                rows.append((n, "retyped", t, have[n]))
        elif n.lower().replace(" ", "_") in folded:
            rows.append((n, "renamed", t, folded.pop(n.lower().replace(" ", "_"))))
        else:
            rows.append((n, "missing", t, None))
    rows += [(n, "unexpected", None, have[n]) for n in folded.values()]
    names = [f.name for f in df.schema.fields]
    rows += [(n, "duplicate", want.get(n), None) for n in sorted({n for n in names if names.count(n) > 1})]
    return df.sparkSession.createDataFrame(rows, "column string, finding string, expected string, found string")


def type_drift(df: DataFrame, columns) -> DataFrame:
    """Values of text columns that do not read as numbers, and whether the rest are whole."""
    outs = []
    for i, c in enumerate(columns):
        n = F.col(c).try_cast("double")
        outs.append(count_where(F.col(c).isNotNull() & n.isNull()).alias(f"bad_{i}"))
        outs.append(count_where(n.isNotNull() & (n != F.floor(n))).alias(f"frac_{i}"))
        outs.append(F.count(n).alias(f"num_{i}"))
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"num_{i}").alias("numeric_values"),
                 F.col(f"bad_{i}").alias("non_numeric_values"), F.col(f"frac_{i}").alias("fractional_values"))
        for i, c in enumerate(columns)
    ]
    return df.agg(*outs).select(F.inline(F.array(*rows)))


def identifiers(df: DataFrame, columns) -> DataFrame:
    """Missing values, distinct values and case/whitespace collisions per identifier."""
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ]))).groupBy("column", "value").agg(F.count("*").alias("n"))
    v = F.col("value")
    folded = values.groupBy("column", F.lower(F.trim(v)).alias("folded")).agg(
        F.count(v).alias("spellings"), F.sum("n").alias("n"),
        F.sum(F.when(v != F.trim(v), F.col("n")).otherwise(0)).alias("padded"),
    )
    present = F.col("folded").isNotNull()
    return folded.groupBy("column").agg(
        F.sum(F.when(~present, F.col("n")).otherwise(0)).alias("missing_values"),
        F.sum("padded").alias("padded_values"),
        F.sum("spellings").alias("raw_distinct"),
        count_where(present).alias("normalised_distinct"),
    ).withColumn("collisions", F.col("raw_distinct") - F.col("normalised_distinct"))


def mapping_violations(df: DataFrame, pairs) -> DataFrame:
    """For each (a, b): how many values of a come with more than one b."""
    out = None
    for a, b in pairs:
        multi = mapping_detail(df, a, b).agg(F.count("*").alias("violations"))
        row = multi.select(F.lit(f"{a} -> {b}").alias("mapping"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def mapping_detail(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of a with more than one distinct b."""
    distinct = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()
    return distinct.groupBy(a).agg(F.count("*").alias("distinct_count")).where(F.col("distinct_count") > 1)


def mapping_check(df: DataFrame, a: str, b: str) -> DataFrame:
    """Each distinct (a, b) pair with how many distinct b its a has."""
    pairs = df.select(a, b).distinct()
    counts = pairs.groupBy(a).agg(F.count(b).alias("distinct_count"))
    return pairs.join(counts, a).where(F.col(a).isNotNull()).select(a, b, "distinct_count")


def crosswalk(df: DataFrame, columns) -> DataFrame:
    return df.select(*columns).distinct()


def expected_pairs(df: DataFrame, a: str, b: str, expected) -> DataFrame:
    """Distinct pairs with whether each is one of the expected ones."""
    known = any_of((F.col(a).eqNullSafe(F.lit(x)) & F.col(b).eqNullSafe(F.lit(y))) for x, y in expected)
    return crosswalk(df, [a, b]).withColumn("expected", known)


def stability(df: DataFrame, entity: str, column: str) -> DataFrame:
    """Entities with more than one value of an attribute that should not change."""
    return mapping_detail(df, entity, column)


def identifier_verdict(df: DataFrame, columns, pairs) -> DataFrame:
    """NOT CONFIRMED on a mapping violation, REQUIRES REVIEW on missing or colliding values."""
    found = identifiers(df, columns).agg(
        F.sum("missing_values").alias("missing_values"), F.sum("padded_values").alias("padded_values"),
        F.sum("collisions").alias("collisions"),
    ).unpivot([], ["missing_values", "padded_values", "collisions"], "k", "v")
    maps = mapping_violations(df, pairs).agg(F.sum("violations").alias("v")).select(F.lit("mapping_violations").alias("k"), "v")
    one = found.unionByName(maps).groupBy().agg(*[
        F.max(F.when(F.col("k") == k, F.col("v"))).alias(k)
        for k in ("missing_values", "padded_values", "collisions", "mapping_violations")
    ])
    soft = (F.col("missing_values") > 0) | (F.col("padded_values") > 0) | (F.col("collisions") > 0)
    return one.withColumn("verdict", F.when(F.col("mapping_violations") > 0, "NOT CONFIRMED")
                          .when(soft, "REQUIRES REVIEW").otherwise("CONFIRMED"))


def cross_source(daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """Per entity code: is it in both sources, and do the names agree as sets."""
    d = daily.where(F.col("entity").isNotNull()).select("entity", "entity_name").distinct()
    m = monthly.where(F.col("entity").isNotNull()).select("entity", "entity_name").distinct()
    both = d.select("entity", "entity_name", F.lit(1).alias("d"), F.lit(0).alias("m")).unionByName(
        m.select("entity", "entity_name", F.lit(0).alias("d"), F.lit(1).alias("m"))
    ).groupBy("entity", "entity_name").agg(F.max("d").alias("d"), F.max("m").alias("m"))
    return both.groupBy("entity").agg(
        (F.max("d") == 1).alias("in_daily"), (F.max("m") == 1).alias("in_monthly"),
        F.bool_and(F.col("d") == F.col("m")).alias("names_match"),
    )


def cross_source_summary(daily: DataFrame, monthly: DataFrame) -> DataFrame:
    d, m = F.col("in_daily"), F.col("in_monthly")
    one = cross_source(daily, monthly).agg(
        count_where(d).alias("daily_codes"), count_where(m).alias("monthly_codes"), count_where(d & m).alias("common_codes"),
        count_where(d & ~m).alias("only_in_daily"), count_where(m & ~d).alias("only_in_monthly"),
        count_where(d & m & ~F.col("names_match")).alias("naming_mismatches"),
    )
    one_sided = (F.col("only_in_daily") > 0) | (F.col("only_in_monthly") > 0)
    return one.withColumn("verdict", F.when(one_sided, "NOT CONFIRMED")
                          .when(F.col("naming_mismatches") > 0, "REQUIRES REVIEW").otherwise("CONFIRMED"))


def grain(df: DataFrame, keys) -> DataFrame:
    """Is the key unique? Counts of incomplete, distinct and duplicated keys, exact and
    conflicting duplicate rows, and the verdict.

    Identical rows are counted first, so a key shared by a third of the rows is
    already one row per distinct content when keys are grouped.
    """
    incomplete = any_of(F.col(k).isNull() for k in keys)
    contents = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    per_key = contents.groupBy(*keys).agg(
        F.sum("_n").alias("_rows"), F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("_exact")
    )
    dup = ~incomplete & (F.col("_rows") > 1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    one = per_key.agg(
        zero(F.sum("_rows")).alias("total_rows"),
        zero(F.sum(F.when(incomplete, F.col("_rows")))).alias("missing_key_rows"),
        count_where(~incomplete).alias("distinct_keys"),
        count_where(dup).alias("duplicated_keys"),
        zero(F.sum(F.when(dup, F.col("_rows")))).alias("duplicate_rows"),
        zero(F.sum(F.when(dup, F.col("_exact")))).alias("exact_duplicate_rows"),
    ).withColumn("conflicting_duplicate_rows", F.col("duplicate_rows") - F.col("exact_duplicate_rows"))
    return one.withColumn("verdict", F.when(F.col("duplicated_keys") > 0, "NOT CONFIRMED")
                          .when(F.col("missing_key_rows") > 0, "REQUIRES REVIEW").otherwise("CONFIRMED"))


def grain_summary(df: DataFrame, keys) -> DataFrame:
    """The part of grain() that needs no contents: rows are counted by key alone, so the other columns are not even read."""
    dup = ~any_of(F.col(k).isNull() for k in keys) & (F.col("_rows") > 1)
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return per_key.agg(
        count_where(dup).alias("duplicated_combinations"),
        F.coalesce(F.sum(F.when(dup, F.col("_rows"))), F.lit(0)).alias("rows_involved_in_duplicates"),
        (count_where(dup) == 0).alias("grain_is_unique"),
    )


#: Join keys over which the rows of a shared key are spread, and the rows of a key from which it is.
SALTS, HEAVY = 64, 100_000


def duplicate_rows(df: DataFrame, keys, columns=None) -> DataFrame:
    """Rows whose key is shared, unchanged. NULL keys count as equal, as in the profile report.

    A key with a NULL in it meets its count in a join of its own, and a key of HEAVY rows or more, or with a NULL, is
    spread over SALTS join keys; its one count row is copied to each of them. Both are found by the counts, which Spark
    takes before the shuffle.
    """
    named = {k: f"_{k}" for k in keys}
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    dup = counts.select(*[F.col(k).alias(named[k]) for k in keys], "_n")
    absent = lambda columns: any_of(F.col(c).isNull() for c in columns)
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    heavy = dup.where((F.col("_n") >= HEAVY) | absent(named.values())).select(*named.values(), F.explode(every).alias("_salt"))
    light = dup.where((F.col("_n") < HEAVY) & ~absent(named.values())).drop("_n")
    same = lambda: [F.col(k).eqNullSafe(F.col(named[k])) for k in keys]
    # the light keys by themselves: rows of others are met by nothing here, those with a NULL do not even take part
    plain = df.where(~absent(keys)).join(light, [F.col(k) == F.col(named[k]) for k in keys], "left_semi")
    salted = df.withColumn("_own", F.floor(F.rand(7) * SALTS).cast("int"))
    spread = salted.join(heavy, [*same(), F.col("_own") == F.col("_salt")], "left_semi").drop("_own")
    return plain.unionByName(spread).select(*(columns or df.columns))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Number of rows identical to another in every column."""
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("exact_duplicate_rows"))


def _long(df: DataFrame, columns) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns
    ])))


def numeric(df: DataFrame, columns, probs=None) -> DataFrame:
    """Counts, range, mean and exact percentiles per column; one long pass for all columns."""
    probs = probs or {"median": 0.5}
    long = _long(df, columns)
    v = F.col("value")
    # sums and counts are taken before the shuffle; the percentiles only shuffle the values next to them
    basic = long.groupBy("column").agg(
        F.count(v).alias("value_count"), count_where(v.isNull()).alias("missing_count"),
        count_where(v == 0).alias("zero_count"), count_where(v < 0).alias("negative_count"), count_where(v > 0).alias("positive_count"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        ratio(F.sum(v), F.count(v)).alias("mean"),
    )
    # one row per column of the table
    quant = exact_percentiles(long, ["column"], "value", probs)
    return basic.join(F.broadcast(quant), "column", "left").select(
        *basic.columns, *[F.col(k).cast(TOTAL).alias(k) for k in probs]
    )


def describe(df: DataFrame, columns) -> DataFrame:
    """Count, mean, sample standard deviation, range and quartiles per column."""
    long = _long(df, columns).withColumn("value", F.col("value").cast("double"))
    v = F.col("value")
    basic = long.groupBy("column").agg(
        F.count(v).alias("value_count"), F.avg(v).cast("decimal(28,4)").alias("mean"),
        F.stddev_samp(v).cast("decimal(28,4)").alias("std"), F.min(v).cast(TOTAL).alias("min"), F.max(v).cast(TOTAL).alias("max"),
    )
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    quant = exact_percentiles(long, ["column"], "value", probs)
    return basic.join(F.broadcast(quant), "column", "left").select(
        *basic.columns, *[F.col(k).cast(TOTAL).alias(k) for k in probs]
    )


def recon(df: DataFrame, columns, examples: int = 3) -> DataFrame:
    """Distinct values and a few smallest examples per identifier-like column.

    The rank limit for the examples runs inside each input partition first.
    """
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ]))).where(F.col("value").isNotNull()).distinct()
    counts = values.groupBy("column").agg(F.count("*").alias("distinct_values"))
    w = Window.partitionBy("column").orderBy("value")
    few = values.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples)
    shown = few.groupBy("column").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]), ", ").alias("examples")
    )
    return counts.join(F.broadcast(shown), "column", "left")


def monthly_summary(monthly: DataFrame, keys=("entity", "year", "month")) -> DataFrame:
    """One row on the monthly extract: size, span, duplicates and rows without any key."""
    blank = F.lit(True)
    for k in keys:
        blank = blank & F.col(k).isNull()
    month = F.when(F.col("year").isNotNull() & F.col("month").isNotNull(), F.col("year") * 100 + F.col("month"))
    label = lambda c: F.concat((F.floor(c / 100)).cast("string"), F.lit("-"), F.lpad((c % 100).cast("string"), 2, "0"))
    has_key = ~any_of(F.col(k).isNull() for k in keys)
    # rows to keys to entities: one scan, and the entities are counted on the way
    per_key = monthly.groupBy(*keys).agg(F.count("*").alias("n"))
    many = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    per_entity = per_key.groupBy("entity").agg(
        F.sum("n").alias("n"), F.min(month).alias("first"), F.max(month).alias("last"), count_where(has_key & (F.col("n") > 1)).alias("dup"),
        many(F.col("n") > 1).alias("dup_rows"), many(blank).alias("blank"),
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_entity.agg(
        F.sum("n").alias("row_count"),
        F.lit(len(monthly.columns)).alias("column_count"),
        label(F.min("first")).alias("earliest_year_month"), label(F.max("last")).alias("latest_year_month"),
        zero("dup").alias("duplicated_combinations"), zero("dup_rows").alias("rows_involved_in_duplicates"),
        zero("blank").alias("rows_with_all_key_columns_null"), F.count("entity").alias("unique_entities"),
    )


def text_columns(df: DataFrame, keys) -> list[str]:
    """Non-key columns held as text."""
    return [c for c, t in df.dtypes if t == "string" and c not in keys]


def source_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct key values found in both, only left, only right."""
    sides = (
        left.where(F.col(key).isNotNull()).select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.where(F.col(key).isNotNull()).select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    return sides.agg(
        count_where((F.col("l") == 1) & (F.col("r") == 1)).alias("common"),
        count_where(F.col("r") == 0).alias("only_left"), count_where(F.col("l") == 0).alias("only_right"),
    )


def summary(daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """Run summary as (metric, value) rows, from one scan of each table."""
    whole = F.col("entity").isNotNull() & F.col("day").isNotNull()
    per_key = daily.groupBy("entity", "day").agg(F.count("*").alias("n"))
    per_entity = per_key.groupBy("entity").agg(
        F.sum("n").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), count_where(whole & (F.col("n") > 1)).alias("dup"))
    dup = F.coalesce(F.sum("dup"), F.lit(0))
    d = per_entity.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("daily rows"), F.min("first").alias("earliest date"), F.max("last").alias("latest date"),
        F.count("entity").alias("entities"), (dup == 0).alias("grain is unique"), dup.alias("duplicate combinations"))
    m = monthly_summary(monthly).select(
        F.col("row_count").alias("monthly rows"), F.col("unique_entities").alias("monthly entities"),
        F.col("duplicated_combinations").alias("monthly duplicate combinations"))
    parts = [df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "metric", "value") for df in (d, m)]
    return parts[0].unionByName(parts[1])


def column_roles(spark: SparkSession, df: DataFrame, spec: SeriesSpec) -> DataFrame:
    rows = [(c, role_of(c, spec)) for c in df.columns]
    return spark.createDataFrame(rows, "column string, role string")


def run_profile(daily: DataFrame, names: DataFrame, monthly: DataFrame) -> dict[str, DataFrame]:
    """The six profile reports, lazily; ``names`` are raw (entity, entity_name) rows."""
    numbers = [c for c in NUMERIC_CANDIDATES if c in daily.columns]
    return {
        "missing_values_daily": missingness.overview(daily),
        "numeric_profile_daily": numeric(daily, numbers),
        "duplicate_wellbore_dates": duplicate_rows(daily, ["entity", "day"]),
        "wellbore_identifier_check": mapping_check(names, "entity", "entity_name"),
        "monthly_profile": monthly_summary(monthly),
        "missing_values_monthly": missingness.overview(monthly),
    }


def head_per_entity(df: DataFrame, n: int) -> DataFrame:
    """First n rows by day of each entity."""
    w = Window.partitionBy("entity").orderBy("day")
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Seeded row sample."""
    return df.sample(fraction=fraction, seed=seed)
