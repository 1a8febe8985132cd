"""Report queries over the views. Set-based: each takes all entities unless told otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prodseries.functions.expr import count_where, month_start, pct, ratio, rounded_ratio, total
from prodseries.operators import analysis, checks, episodes, views
from prodseries.operators.categories import label
from prodseries.operators.views import with_names
from prodseries.spec import STATE_LABELS


def only(df: DataFrame, entities) -> DataFrame:
    """Rows of the chosen entities: None keeps all, an empty choice keeps the columns only."""
    if entities is None:
        return df
    entities = list(entities)
    return df.where(F.col("entity").isin(entities)) if entities else df.where(F.lit(False))


def _dominant(fact: DataFrame) -> DataFrame:
    """Most frequent state per entity; the first in alphabetical order on ties."""
    counts = fact.groupBy("entity", "state").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("state")))
    return counts.groupBy("entity").agg(best.alias("b")).select("entity", F.col("b.state").alias("state"))


def wells(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Entities with their dominant state and its label."""
    return with_names(_dominant(fact), dim).select(
        "entity", "entity_name", "state", label("state", STATE_LABELS).alias("state_label")
    ).orderBy("entity_name", "entity")


def field_kpis(fact: DataFrame) -> DataFrame:
    """Totals, span, and the best day of the whole field, from one row per day."""
    days = fact.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("oil", "gas", "water", "injection")])
    best = F.max(F.when(F.col("oil").isNotNull(), F.struct(F.col("oil").alias("v"), (-F.unix_date("day")).alias("neg"))))
    one = days.agg(
        total("oil").alias("total_oil"), total("gas").alias("total_gas"), total("water").alias("total_water"),
        total("injection").alias("total_water_injection"), F.min("day").alias("first_record_date"),
        F.max("day").alias("last_record_date"), best.alias("best"),
    )
    return one.select(
        "total_oil", "total_gas", "total_water", "total_water_injection", "first_record_date", "last_record_date",
        F.date_from_unix_date(-F.col("best.neg")).alias("peak_date"),
        F.col("best.v").cast("decimal(28,6)").alias("peak_oil_rate"),
        ratio(F.datediff("last_record_date", "first_record_date"), F.lit(365.25)).alias("field_life_years"),
    )


def _availability(hours: Column, days: Column) -> Column:
    return pct(hours, days * 24)


def availability_by_month(fact: DataFrame) -> DataFrame:
    """Hours as a share of possible hours over days with known hours."""
    return fact.where(F.col("hours").isNotNull()).groupBy(month_start("day").alias("month_start")).agg(
        total("hours").alias("total_hours"), F.count("*").alias("known_hours_days")
    ).withColumn("availability_pct", _availability(F.col("total_hours"), F.col("known_hours_days"))).orderBy("month_start")


def availability(fact: DataFrame, entities=None) -> DataFrame:
    """Per entity; NULL when no day has known hours."""
    return only(fact, entities).groupBy("entity").agg(
        total("hours").alias("total_hours"), F.count("hours").alias("known_hours_days")
    ).withColumn("availability_pct", _availability(F.col("total_hours"), F.col("known_hours_days")))


def well_summary(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """First oil, peak, availability, total and share of the field, from one grouped pass."""
    peak = F.max(F.when(F.col("oil").isNotNull(), F.struct(F.col("oil").alias("v"), (-F.unix_date("day")).alias("neg"))))
    per = fact.groupBy("entity").agg(
        total("oil").alias("total_oil"), F.min(F.when(F.col("oil") > 0, F.col("day"))).alias("first_oil_date"),
        peak.alias("p"), F.sum("hours").alias("h"), F.count("hours").alias("d"),
    )
    field = fact.agg(F.sum("oil")).scalar()
    return with_names(per, dim).select(
        "entity", "entity_name", "total_oil", "first_oil_date",
        F.date_from_unix_date(-F.col("p.neg")).alias("peak_date"), F.col("p.v").alias("peak_oil"),
        rounded_ratio("h", F.col("d") * 24, 1, 100).alias("availability_pct"),
        pct("total_oil", field).alias("oil_pct_of_field"),
    ).orderBy(F.desc_nulls_last("total_oil"), "entity_name")


def never_producers(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("total_oil").isNull()).select("entity_name")


def contribution(summary: DataFrame) -> DataFrame:
    """Share of the field of entities that have one."""
    return summary.where(F.col("oil_pct_of_field").isNotNull()).select("entity_name", "total_oil", "oil_pct_of_field")


def field_monthly(fact: DataFrame) -> DataFrame:
    return views.field_monthly(fact).drop("year", "month").orderBy("month_start")


def active_by_type(fact: DataFrame, dim: DataFrame, independent_minima: bool = False) -> DataFrame:
    """Active entities per month and dominant state, zero where there are none.

    The grid is months x labels, so it is bounded by the calendar. It starts at the
    first recorded month; with ``independent_minima`` at the smallest month number
    of any year in the first year, as the published report does.
    """
    typed = wells(fact, dim).select("entity", "state_label")
    active = fact.where(F.col("hours") > 0).select("entity", month_start("day").alias("month_start")).distinct()
    counts = active.join(typed, "entity").groupBy("month_start", "state_label").agg(F.count("*").alias("n"))
    first = (
        F.make_date(F.min(F.year("day")), F.min(F.month("day")), F.lit(1)) if independent_minima
        else F.trunc(F.min("day"), "MM")
    )
    start, end = fact.agg(first).scalar(), fact.agg(F.max("day")).scalar()
    months = F.explode(F.sequence(start, end, F.expr("interval 1 month")))
    grid = typed.select("state_label").distinct().select("state_label", months.alias("month_start"))
    return grid.join(counts, ["month_start", "state_label"], "left").select(
        "month_start", F.col("state_label").alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("active_wells")
    )


def active_totals(by_type: DataFrame) -> DataFrame:
    return by_type.groupBy("month_start").agg(F.sum("active_wells").alias("active_wells"))


def last_active_month(fact: DataFrame) -> DataFrame:
    return views.field_monthly(fact).where(F.col("active_wells") > 0).agg(
        F.max("month_start").alias("month_start"), F.max_by("active_wells", "month_start").alias("active_wells")
    )


def well_daily(fact: DataFrame, entities=None, extra=()) -> DataFrame:
    return only(fact, entities).select(
        "entity", "day", "oil", "gas", "water", "injection", "hours", (F.col("hours") > 0).alias("is_active"), *extra
    )


def well_monthly(fact: DataFrame, dim: DataFrame, entities=None) -> DataFrame:
    return views.monthly(only(fact, entities), dim)


def well_lifetime(fact: DataFrame, dim: DataFrame, entities=None) -> DataFrame:
    return views.lifetime(only(fact, entities), dim)


def snapshot(fact: DataFrame, entities=None) -> DataFrame:
    """Last record with known hours, and the first oil day; no smoothing."""
    last = F.max(F.when(F.col("hours").isNotNull(), F.struct("day", "oil", (F.col("hours") > 0).alias("active"))))
    return only(fact, entities).groupBy("entity").agg(
        last.alias("l"), F.min(F.when(F.col("oil") > 0, F.col("day"))).alias("first_oil_date")
    ).where(F.col("l").isNotNull()).select(
        "entity", F.col("l.day").alias("latest_record_date"), F.col("l.oil").alias("latest_oil_rate"),
        F.col("l.active").alias("latest_is_active"), "first_oil_date",
    )


def well_transitions(fact: DataFrame, entities=None) -> DataFrame:
    return episodes.transitions(only(fact, entities))


def well_episodes(fact: DataFrame, dim: DataFrame, entities=None) -> DataFrame:
    return episodes.downtime_episodes(only(fact, entities), dim)


def outage_kpis(fact: DataFrame, dim: DataFrame, entities=None) -> DataFrame:
    return episodes.outage_kpis(well_episodes(fact, dim, entities))


def profiles(fact: DataFrame, dim: DataFrame, entities=None, smooth: int | None = None) -> DataFrame:
    """Oil as a share of the entity's own peak, by days since its first oil.

    ``smooth`` adds a trailing mean over that many rows (rows, not days).
    """
    whole = Window.partitionBy("entity")
    rows = only(fact, entities).where(F.col("oil").isNotNull()).select("entity", "day", "oil")
    marked = rows.withColumn("first", F.min(F.when(F.col("oil") > 0, F.col("day"))).over(whole)).withColumn(
        "peak", F.max("oil").over(whole)
    ).where(F.col("day") >= F.col("first"))
    out = marked.select(
        "entity", "day", F.datediff("day", "first").alias("days_since_first_oil"), "oil",
        rounded_ratio("oil", "peak", 1, 100).alias("pct_of_peak"),
    )
    if smooth:
        w = whole.orderBy("day").rowsBetween(1 - smooth, 0)
        out = out.withColumn("pct_of_peak_smoothed", ratio(F.sum("pct_of_peak").over(w), F.count("pct_of_peak").over(w)))
    return with_names(out, dim)


def monthly_production(fact: DataFrame, dim: DataFrame, entities=None) -> DataFrame:
    return views.monthly(only(fact, entities), dim).select(
        "entity_name", F.make_date("year", "month", F.lit(1)).alias("month_start"),
        "oil_volume", "gas_volume", "water_volume", "water_injection_volume",
    ).orderBy("entity_name", "month_start")


def water_trends(fact: DataFrame, dim: DataFrame, entities=None) -> DataFrame:
    return views.monthly(only(fact, entities), dim).select(
        "entity_name", F.make_date("year", "month", F.lit(1)).alias("month_start"), "water_volume", "oil_volume",
        rounded_ratio("water_volume", "oil_volume", 3).alias("water_oil_ratio"),
    ).orderBy("entity_name", "month_start")


def latest_ratio(trends: DataFrame) -> DataFrame:
    """Latest month with a ratio per entity."""
    return trends.where(F.col("water_oil_ratio").isNotNull()).groupBy("entity_name").agg(
        F.max("month_start").alias("month_start"), F.max_by("water_oil_ratio", "month_start").alias("water_oil_ratio")
    )


def decline(fact: DataFrame, dim: DataFrame, entities=None, checkpoints=(30, 90, 365)) -> DataFrame:
    return analysis.peak_checkpoints(fact, dim, checkpoints, entities)


def decline_long(wide: DataFrame, checkpoints=(30, 90, 365)) -> DataFrame:
    """One row per entity and checkpoint."""
    items = [
        F.struct(F.lit(n).alias("days_after_peak"), F.col(f"oil_{n}_days_after_peak").alias("oil"),
                 F.col(f"pct_decline_{n}_days").alias("pct_decline")) for n in checkpoints
    ]
    return wide.select("entity", "entity_name", "peak_date", "peak_volume", F.inline(F.array(*items)))


def ranking_by_type(fact: DataFrame, dim: DataFrame, state_label: str) -> DataFrame:
    """Fleet-wide ranks of the entities of one dominant state: ranked first, filtered after."""
    chosen = wells(fact, dim).where(F.col("state_label") == state_label).select("entity", "state_label")
    return analysis.ranking(fact, dim).join(chosen, "entity")


def field_cumulative(fact: DataFrame) -> DataFrame:
    """Running injection (blank where the month is blank) and running oil (a blank month adds nothing)."""
    upto = Window.orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0)
    oil = F.sum(F.coalesce("oil_volume", F.lit(0).cast("decimal(28,6)"))).over(upto)
    injection = F.when(F.col("water_injection_volume").isNotNull(), F.sum("water_injection_volume").over(upto))
    # one row per calendar month
    return views.field_monthly(fact).select(
        "month_start", oil.cast("decimal(28,6)").alias("cumulative_oil"),
        injection.cast("decimal(28,6)").alias("cumulative_water_injection"),
    )


def cumulative_oil(fact: DataFrame, entities=None) -> DataFrame:
    upto = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.coalesce("oil", F.lit(0).cast("decimal(18,6)"))).over(upto)
    return only(fact, entities).select("entity", "day", running.cast("decimal(28,6)").alias("cumulative_oil"))


def field_ratio(fact: DataFrame) -> DataFrame:
    """Water/oil ratio by month, unrounded; NULL when there is no oil."""
    return views.field_monthly(fact).select("month_start", ratio("water_volume", "oil_volume").alias("water_oil_ratio"))


def capabilities(fact: DataFrame) -> DataFrame:
    """What an entity's record has at all."""
    sensors = [c for c in fact.columns if c not in ("entity", "day", "state", "mode", "hours", "oil", "gas", "water", "injection")]
    some = F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in sensors], F.lit(False)) if sensors else F.lit(False)
    return fact.groupBy("entity").agg(
        F.bool_or(F.col("oil").isNotNull()).alias("has_oil"),
        F.bool_or(F.coalesce(F.col("injection") > 0, F.lit(False))).alias("has_injection"),
        F.bool_or(F.col("water").isNotNull()).alias("has_water"), F.bool_or(some).alias("has_sensors"),
    )


# --- single-answer questions -------------------------------------------------


def _top(value: str, name: str = "entity_name") -> Column:
    """Name with the largest value, the first name on ties; NULL values never win."""
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("neg"), F.col(name).alias("name"))))
    return best["name"]


def _records(fact: DataFrame, dim: DataFrame, rules: checks.ReviewRules, after: int = 90) -> DataFrame:
    """All that is asked of an entity's whole record, a row an entity, from one pass over its days."""
    whole = Window.partitionBy("entity")
    earlier = whole.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    active = F.col("hours") > 0
    top = F.max(F.when(F.col("oil").isNotNull(), F.struct(F.col("oil").alias("v"), (-F.unix_date("day")).alias("neg")))).over(whole)
    days = fact.select(
        "entity", "day", "oil", "gas", "injection", top.alias("top"),
        (active != F.last(active, ignorenulls=True).over(earlier)).alias("flipped"),  # against the last known day
        rules.conditions()["DQ-004"].alias("over"),
    )
    later = F.col("day") == F.date_add(F.date_from_unix_date(-F.col("top.neg")), after)
    some = lambda n: F.when(n > 0, n)  # noqa: E731  who has none is not asked about
    per = days.groupBy("entity").agg(
        total("oil").alias("total_oil"), total("gas").alias("total_gas"), total("injection").alias("total_water_injection"),
        F.min(F.when(F.col("oil") > 0, F.col("day"))).alias("first_oil"), F.first("top.v").alias("peak"),
        F.max(F.when(later, F.col("oil"))).alias("later"), some(count_where(F.col("flipped"))).alias("transitions"),
        some(count_where(F.col("over"))).alias("over"),
    )
    return with_names(per, dim).withColumn("decline", rounded_ratio(F.col("peak") - F.col("later"), "peak", 1, 100))


def answers(fact: DataFrame, dim: DataFrame, rules: checks.ReviewRules) -> DataFrame:
    """The reference questions as (question, answer) rows, computed live: one pass by entity, one by month."""
    first = F.min(F.when(F.col("first_oil").isNotNull(), F.struct("first_oil", "entity_name")))
    by_entity = _records(fact, dim, rules).agg(
        _top("total_oil").alias("top_oil"), _top("total_gas").alias("top_gas"), _top("peak").alias("top_peak_oil"),
        F.min(F.when(F.col("total_oil").isNull(), F.col("entity_name"))).alias("no_oil"),
        total("total_water_injection").cast("string").alias("total_injection"), first["entity_name"].alias("earliest_oil"),
        _top("decline").alias("largest_decline_90"), _top("transitions").alias("most_transitions"), _top("over").alias("most_over_24"),
    )
    best = F.min(F.when(F.col("oil_volume").isNotNull(), F.struct((-F.col("oil_volume")).alias("neg"), F.col("month_start").alias("m"))))
    by_month = views.field_monthly(fact).agg(
        best["m"].cast("string").alias("highest_oil_month"), F.max("active_wells").cast("string").alias("max_active"))
    parts = [df.unpivot([], df.columns, "question", "answer") for df in (by_entity, by_month)]
    return parts[0].unionByName(parts[1])


def top_oil_by_year(fact: DataFrame, dim: DataFrame, year: int | None = None) -> DataFrame:
    """The entity with most oil in each year, or in one."""
    m = views.monthly(fact, dim)
    if year is not None:
        m = m.where(F.col("year") == year)
    per = m.groupBy("year", "entity_name").agg(total("oil_volume").alias("oil_volume"))
    best = F.min(F.when(F.col("oil_volume").isNotNull(), F.struct((-F.col("oil_volume")).alias("neg"), F.col("entity_name").alias("name"))))
    return per.groupBy("year").agg(best.alias("b")).where(F.col("b").isNotNull()).select(
        "year", F.col("b.name").alias("entity_name"), (-F.col("b.neg")).cast("decimal(28,6)").alias("oil_volume"))


def history(fact: DataFrame, dim: DataFrame, name: str | None = None) -> DataFrame:
    """Daily production history of a named entity, or of all."""
    chosen = dim if name is None else dim.where(F.col("entity_name") == name)
    return with_names(fact, chosen).select("entity_name", "day", "oil", "gas", "water", "injection", "hours").orderBy("entity_name", "day")


def active_in_year(fact: DataFrame, year: int | None = None) -> DataFrame:
    """Active entities per month, of one year or of all."""
    f = views.field_monthly(fact)
    return (f if year is None else f.where(F.col("year") == year)).select("month_start", "active_wells").orderBy("month_start")
