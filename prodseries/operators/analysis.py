"""Engineering questions on the daily fact and its views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from prodseries.functions.expr import month_start, ratio, rounded_ratio, total
from prodseries.functions.order_stats import global_ranks
from prodseries.operators import views
from prodseries.operators.episodes import downtime_episodes, transition_counts
from prodseries.operators.views import with_names

# Month tables hold one row per calendar month, so an unpartitioned window over
# them is bounded by the calendar (1,200 rows a century).
def by_month():
    return Window.orderBy("month_start")


def _rank_totals(lifetime: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Rank every metric over all entities: one long table, one pass, pivoted back."""
    long = lifetime.unpivot(
        ["entity", "entity_name"], [F.col(c) for c in metrics], "metric", "value"
    )
    ranked = global_ranks(long, ["metric"], "value", "rank", "dense")
    outs = []
    for c, how in metrics.items():
        here = F.col("metric") == c
        outs.append(F.max(F.when(here, F.col("value"))).alias(c))
        outs.append(F.max(F.when(here, F.col("dense" if how == "dense" else "rank"))).alias(f"_rank_{c}"))
    return ranked.groupBy("entity", "entity_name").agg(*outs)


def oil_rank(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Entities by total oil; those that never measured oil rank last."""
    ranked = _rank_totals(views.lifetime(fact, dim), {"total_oil": "rank"})
    return ranked.select("entity_name", "total_oil", F.col("_rank_total_oil").alias("oil_rank")).orderBy(
        "oil_rank", "entity_name"
    )


def gas_water_rank(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Gas by RANK, water by DENSE_RANK."""
    ranked = _rank_totals(views.lifetime(fact, dim), {"total_gas": "rank", "total_water": "dense"})
    return ranked.select(
        "entity_name",
        "total_gas", F.col("_rank_total_gas").alias("gas_rank"),
        "total_water", F.col("_rank_total_water").alias("water_rank"),
    ).orderBy("gas_rank", "entity_name")


def ranking(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Oil, gas, water (dense) and injection ranks over the whole fleet."""
    ranked = _rank_totals(
        views.lifetime(fact, dim),
        {"total_oil": "rank", "total_gas": "rank", "total_water": "dense", "total_water_injection": "rank"},
    )
    return ranked.select(
        "entity", "entity_name",
        "total_oil", F.col("_rank_total_oil").alias("oil_rank"),
        "total_gas", F.col("_rank_total_gas").alias("gas_rank"),
        "total_water", F.col("_rank_total_water").alias("water_rank"),
        "total_water_injection", F.col("_rank_total_water_injection").alias("injection_rank"),
    )


def first_oil(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """First day with positive oil; entities that never produce keep a NULL."""
    first = fact.where(F.col("oil") > 0).groupBy("entity").agg(F.min("day").alias("first_positive_oil_date"))
    return (
        dim.select("entity", "entity_name").join(first, "entity", "left")
        .select("entity_name", "first_positive_oil_date")
        .orderBy(F.asc_nulls_last("first_positive_oil_date"), "entity_name")
    )


def _peak(fact: DataFrame) -> DataFrame:
    """Highest oil day per entity, the earliest on ties; combines map-side."""
    top = F.max(F.struct(F.col("oil").alias("v"), (-F.unix_date("day")).alias("neg")))
    return (
        fact.where(F.col("oil").isNotNull()).groupBy("entity").agg(top.alias("top"))
        .select("entity", F.date_from_unix_date(-F.col("top.neg")).alias("peak_date"), F.col("top.v").alias("peak_volume"))
    )


def peak_oil(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Peak day and volume; entities with no oil record are absent."""
    return with_names(_peak(fact), dim).select(
        "entity_name", F.col("peak_date").alias("peak_oil_date"), F.col("peak_volume").alias("peak_oil_volume")
    ).orderBy(F.desc("peak_oil_volume"), "entity_name")


def peak_checkpoints(fact: DataFrame, dim: DataFrame, checkpoints=(30, 90, 365), entities=None) -> DataFrame:
    """Oil exactly n days after the peak, and how far below the peak it is.

    The look-ups are conditional maxima inside one pass per entity: (entity, day)
    is unique, so at most one row matches each checkpoint.
    """
    rows = fact.where(F.col("oil").isNotNull()).select("entity", "day", "oil")
    if entities is not None:
        rows = rows.where(F.col("entity").isin(list(entities)))
    whole = Window.partitionBy("entity")
    top = F.max(F.struct(F.col("oil").alias("v"), (-F.unix_date("day")).alias("neg"))).over(whole)
    marked = rows.withColumn("top", top).withColumn("peak_date", F.date_from_unix_date(-F.col("top.neg")))
    at = [
        F.max(F.when(F.col("day") == F.date_add("peak_date", n), F.col("oil"))).alias(f"oil_{n}_days_after_peak")
        for n in checkpoints
    ]
    found = marked.groupBy("entity").agg(
        F.first("peak_date").alias("peak_date"), F.first("top.v").alias("peak_volume"), *at
    )
    outs = ["entity", "entity_name", "peak_date", "peak_volume"]
    for n in checkpoints:
        v = f"oil_{n}_days_after_peak"
        outs += [v, rounded_ratio(F.col("peak_volume") - F.col(v), "peak_volume", 1, 100).alias(f"pct_decline_{n}_days")]
    return with_names(found, dim).select(*outs)


def water_oil_ratio(fact: DataFrame) -> DataFrame:
    """Field water/oil ratio by month, months with oil only."""
    return views.field_monthly(fact).where(F.col("oil_volume").isNotNull()).select(
        "month_start", "oil_volume", "water_volume",
        rounded_ratio("water_volume", "oil_volume", 3).alias("water_oil_ratio"),
    ).orderBy("month_start")


def cumulative_injection(fact: DataFrame) -> DataFrame:
    running = F.sum("water_injection_volume").over(by_month().rowsBetween(Window.unboundedPreceding, 0))
    return views.field_monthly(fact).select(
        "month_start", "water_injection_volume", running.cast("decimal(28,6)").alias("cumulative_water_injection")
    ).orderBy("month_start")


def top_months(fact: DataFrame, limit: int = 10) -> DataFrame:
    """Months with most oil. The cut is by rank, then month."""
    by_oil = Window.orderBy(F.desc("oil_volume"))
    return (
        views.field_monthly(fact).where(F.col("oil_volume").isNotNull())
        .select("month_start", "oil_volume", F.rank().over(by_oil).cast("long").alias("oil_rank"))
        .orderBy("oil_rank", "month_start").limit(limit)
    )


def yearly_share(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Share of each entity in the oil of the year."""
    by_entity = fact.where(F.col("oil").isNotNull()).groupBy(F.year("day").alias("year"), "entity").agg(
        total("oil").alias("oil_volume")
    )
    by_year = by_entity.groupBy("year").agg(total("oil_volume").alias("year_total_oil"))
    # one row per calendar year
    shared = by_entity.join(F.broadcast(by_year), "year")
    return with_names(shared, dim).select(
        "year", "entity_name", "oil_volume", "year_total_oil",
        rounded_ratio("oil_volume", "year_total_oil", 1, 100).alias("pct_of_year_total"),
    ).orderBy("year", F.desc_nulls_last("pct_of_year_total"), "entity_name")


def active_by_month(fact: DataFrame) -> DataFrame:
    return views.field_monthly(fact).select("month_start", "active_wells").orderBy("month_start")


def transition_ranking(fact: DataFrame, dim: DataFrame) -> DataFrame:
    return transition_counts(fact, dim).select(
        "entity_name", "shutdowns", "restarts", "total_transitions"
    ).orderBy(F.desc("total_transitions"), "entity_name")


def episode_listing(fact: DataFrame, dim: DataFrame) -> DataFrame:
    return downtime_episodes(fact, dim).drop("entity").orderBy("entity_name", "shutdown_date")


def entry_effect(fact: DataFrame, dim: DataFrame, k: int = 3) -> DataFrame:
    """Field oil averaged over the k month rows before and after each entity's entry month.

    The frames count rows of the month table, so a month without records moves
    the frame, as in the published definition.
    """
    def over(first, last):
        w = by_month().rowsBetween(first, last)
        return ratio(F.sum("oil_volume").over(w), F.count("oil_volume").over(w))

    months = views.field_monthly(fact).select(
        "month_start", "oil_volume", over(-k, -1).alias("before"), over(1, k).alias("after")
    )
    entries = fact.where((F.col("oil") > 0) | (F.col("injection") > 0)).groupBy("entity").agg(
        month_start(F.min("day")).alias("entry_month_start")
    )
    # the month table is bounded by the calendar
    joined = entries.join(F.broadcast(months), F.col("entry_month_start") == F.col("month_start"))
    return with_names(joined, dim).select(
        "entity_name", "entry_month_start",
        F.col("before").alias(f"avg_field_oil_{k}mo_before"),
        F.col("oil_volume").alias("field_oil_entry_month"),
        F.col("after").alias(f"avg_field_oil_{k}mo_after"),
    ).orderBy("entry_month_start", "entity_name")
