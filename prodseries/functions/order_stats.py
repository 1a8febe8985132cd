"""Exact ranks and percentiles over whole tables, without a single-task sort and without a job before the query runs.

Values are dealt into BINS ordered bins between the least and the greatest of their group, on a logarithmic scale. The
bin of a value follows from these two bounds alone, which are exact, so every branch of a plan and every retried task
deals alike, and any bounds give exact results: they only balance the work. Bin totals (a fixed number of rows) are all
that is accumulated in one place; the rest runs bin by bin.

Percentiles shuffle the values of those bins only in which a wanted position lies. Ranks work on distinct values, so that
a value shared by a third of the rows is one row before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Ordered bins of a group, join keys that a hot value is spread over, and the share of a group's rows from which it is hot.
BINS, SALTS, HOT = 1024, 32, 1 / 64
#: Bins of NULL, of -Infinity, and of Infinity and NaN.
NULL_BIN, FIRST_BIN, LAST_BIN = -2, -1, BINS


def frequencies(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """One row per group and distinct value, with its count ``n``."""
    return df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def _scaled(value: Column) -> Column:
    """A double that never falls where the value rises."""
    number = value.cast("double")
    return F.signum(number) * F.log1p(F.abs(number))


def _finite(df: DataFrame, value: str) -> Column:
    v = F.col(value)
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return v


def _dealt(df: DataFrame, groups: list[str], value: str, n: Column | None = None) -> DataFrame:
    """df with the `bin` of each value, and `_all`, the rows of its group. One row per label is broadcast, hence ``groups``
    must be a fixed set of labels (metric names, states), never an entity key."""
    fine = _finite(df, value)
    count = F.sum(n) if n is not None else F.count(F.lit(1))
    bounds = df.groupBy(*[F.col(g).alias(f"_b_{g}") for g in groups]).agg(
        _scaled(F.min(fine)).alias("_low"), _scaled(F.max(fine)).alias("_high"), count.alias("_all"))
    if groups:
        both = df.join(F.broadcast(bounds), _same(df, bounds, [(g, f"_b_{g}") for g in groups]))
    else:
        both = df.withColumns({c: bounds.select(c).scalar() for c in ("_low", "_high", "_all")})
    place = F.when(F.col("_high") > F.col("_low"), F.floor((_scaled(fine) - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS)).otherwise(0)
    bin_ = F.when(fine.isNotNull(), F.least(place.cast("int"), F.lit(BINS - 1)))
    bin_ = F.when(F.col(value).isNull(), NULL_BIN).otherwise(F.coalesce(bin_, F.when(F.col(value) < 0, FIRST_BIN).otherwise(LAST_BIN)))
    return both.withColumn("bin", bin_).drop("_low", "_high", *[f"_b_{g}" for g in groups])


def _same(left: DataFrame, right: DataFrame, pairs) -> list[Column]:
    return [left[a].eqNullSafe(right[b]) for a, b in pairs]


def exact_percentiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles, one row per group, one column per name in ``probs``.

    ``groups`` is a small fixed set of labels; NULL values are ignored.
    """
    rows = df.where(F.col(value).isNotNull()).select(*groups, value)
    binned = _dealt(rows, groups, value).drop("_all")
    by_group = Window.partitionBy(*groups, "q") if groups else Window.partitionBy("q")
    # at most BINS + 2 rows per group and probability, counted before the shuffle
    targets = F.explode(
        F.array(*[F.struct(F.lit(k).alias("q"), F.lit(float(p)).alias("p")) for k, p in probs.items()])
    )
    totals = (
        binned.groupBy(*groups, "bin")
        .agg(F.count(F.lit(1)).alias("bin_n"))
        .withColumn("t", targets)
        .select(*groups, "bin", "bin_n", "t.q", "t.p")
        .withColumn("upto", F.sum("bin_n").over(by_group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("pos", F.col("p") * (F.sum("bin_n").over(by_group) - 1))
        .withColumn("lo", F.floor("pos"))
        .withColumn("hi", F.ceil("pos"))
        .withColumn("start", F.col("upto") - F.col("bin_n"))
    )
    inside = lambda k: (F.col(k) >= F.col("start")) & (F.col(k) < F.col("upto"))
    # at most two bins per group and probability
    wanted = totals.where(inside("lo") | inside("hi")).select(
        *[F.col(g).alias(f"_{g}") for g in groups], F.col("bin").alias("_bin"), "q", "pos", "lo", "hi", "start"
    )
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups] + [F.col("bin") == F.col("_bin")]
    in_bin = Window.partitionBy(*groups, "q", "bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    # the values of the wanted bins only, counted before the shuffle as well
    bins = wanted.select(*[f"_{g}" for g in groups], "_bin").distinct()
    inside_values = frequencies(binned.join(F.broadcast(bins), on, "left_semi"), [*groups, "bin"], value)
    picked = (
        inside_values.join(F.broadcast(wanted), on)
        .withColumn("last", F.col("start") + F.sum("n").over(in_bin))
        .withColumn("first", F.col("last") - F.col("n"))
    )
    at = lambda k: F.max(F.when((F.col(k) >= F.col("first")) & (F.col(k) < F.col("last")), F.col(value)).cast("double"))
    named = picked.groupBy(*groups, "q").agg(
        at("lo").alias("v_lo"), at("hi").alias("v_hi"), F.max(F.col("pos") - F.col("lo")).alias("w")
    )
    interpolated = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("w")
    return named.groupBy(*groups).agg(
        *[F.max(F.when(F.col("q") == k, interpolated)).alias(k) for k in probs]
    )


def global_ranks(df: DataFrame, groups: list[str], value: str, rank: str, dense: str | None = None) -> DataFrame:
    """Add descending RANK (and DENSE_RANK) over each label group; NULLs rank last, tied.

    Ranks are worked out on distinct values and joined back by value. Rows of a hot
    value, and of NULL, are spread over ``SALTS`` join keys; the one rank row of
    such a value is copied to each of them.
    """
    binned = _dealt(frequencies(df, groups, value), groups, value, F.col("n"))
    hot = binned.where(F.col(value).isNull() | (F.col("n") >= HOT * F.col("_all"))).select(*groups, F.col(value).alias("_hot"))
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    ahead = by_group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    # bin totals: a fixed number of rows per group
    offsets = (
        binned.groupBy(*groups, "bin")
        .agg(F.sum("n").alias("bin_n"), F.count(F.lit(1)).alias("bin_d"))
        .withColumn("ahead_n", F.coalesce(F.sum("bin_n").over(ahead), F.lit(0)))
        .withColumn("ahead_d", F.coalesce(F.sum("bin_d").over(ahead), F.lit(0)))
        .select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("bin").alias("_bin"), "ahead_n", "ahead_d")
    )
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups] + [F.col("bin") == F.col("_bin")]
    in_bin = Window.partitionBy(*groups, "bin").orderBy(F.desc(value))
    before = F.coalesce(F.sum("n").over(in_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = binned.join(F.broadcast(offsets), on).select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        F.col(value).alias("_value"),
        (F.col("ahead_n") + before + 1).alias(rank),
        (F.col("ahead_d") + F.row_number().over(in_bin)).cast("long").alias(dense or "_dense"),
    )
    # at most 1 / HOT hot values per label, and NULL
    hot = F.broadcast(hot.withColumnsRenamed({g: f"_h_{g}" for g in groups}).withColumn("_is_hot", F.lit(True)))
    named = [(g, f"_h_{g}") for g in groups]
    rows = df.join(hot, _same(df, hot, [*named, (value, "_hot")]), "left").withColumn(
        "_salt", F.when(F.col("_is_hot"), F.pmod(F.xxhash64(*[df[c] for c in df.columns]), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    )
    named = [(f"_g_{g}", f"_h_{g}") for g in groups]
    first, last = F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")
    copies = F.when(F.col("_is_hot"), F.sequence(first, last)).otherwise(F.array(first))
    ranks = ranked.join(hot, _same(ranked, hot, [*named, ("_value", "_hot")]), "left").select(
        *ranked.columns, F.explode(copies).alias("_copy")
    )
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    on += [F.col(value).eqNullSafe(F.col("_value")), F.col("_salt") == F.col("_copy")]
    keep = df.columns + [rank] + ([dense] if dense else [])
    return rows.select(*df.columns, "_salt").join(ranks, on).select(*keep)
