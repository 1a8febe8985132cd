"""Analytical views: daily, monthly, lifetime and fleet by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prodseries.functions.expr import any_positive, count_where, dealt_by_month, total
from prodseries.spec import FLUIDS, ROLE_NOTES, VOLUMES, SeriesSpec, role_of


def with_names(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Inner join to the dimension. Its size decides the strategy at run time."""
    return df.join(dim.select("entity", "entity_name"), "entity")


def daily(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per (entity, day). ``is_active`` is NULL when hours are NULL."""
    named = with_names(fact, dim)
    sensors = [c for c in fact.columns if c not in SeriesSpec.FACT_ROLES]
    return named.select(
        "day", F.year("day").alias("year"), F.month("day").alias("month"),
        "entity", "entity_name", "state", "mode", "hours", *FLUIDS, *sensors,
        (F.col("hours") > 0).alias("is_active"),
    )


def _volume_sums():
    return [
        total("hours").alias("on_stream_hours"),
        total("oil").alias("oil_volume"),
        total("gas").alias("gas_volume"),
        total("water").alias("water_volume"),
        total("injection").alias("water_injection_volume"),
    ]


def monthly(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per (entity, year, month); the name is joined after the sums."""
    sums = dealt_by_month(fact).groupBy("entity", "year", "month").agg(
        *_volume_sums(),
        count_where(any_positive(VOLUMES)).alias("producing_days"),
        F.count("*").alias("calendar_records"),
    )
    return with_names(sums, dim)


def lifetime(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per entity over its whole record."""
    sums = fact.groupBy("entity").agg(
        F.min("day").alias("first_record_date"),
        F.max("day").alias("last_record_date"),
        F.count("*").alias("recorded_days"),
        total("hours").alias("total_on_stream_hours"),
        total("oil").alias("total_oil"),
        total("gas").alias("total_gas"),
        total("water").alias("total_water"),
        total("injection").alias("total_water_injection"),
        F.max("oil").alias("peak_daily_oil"),
        F.max("gas").alias("peak_daily_gas"),
        F.max("water").alias("peak_daily_water"),
        count_where(any_positive(VOLUMES)).alias("number_of_production_days"),
        count_where(F.col("injection") > 0).alias("number_of_injection_days"),
    )
    return with_names(sums, dim)


def field_monthly(fact: DataFrame) -> DataFrame:
    """One row per calendar month over all entities.

    Entity-months are summed first, so counting distinct active entities needs no
    second pass over the daily rows.
    """
    by_entity = dealt_by_month(fact).groupBy("entity", "year", "month").agg(
        *_volume_sums(), F.max(F.col("hours") > 0).alias("active")
    )
    return by_entity.groupBy("year", "month").agg(
        count_where(F.col("active")).alias("active_wells"),
        *[
            total(c).alias(c)
            for c in ("oil_volume", "gas_volume", "water_volume", "water_injection_volume", "on_stream_hours")
        ],
    ).select(
        "year", "month", F.make_date("year", "month", F.lit(1)).alias("month_start"),
        "active_wells", "oil_volume", "gas_volume", "water_volume", "water_injection_volume", "on_stream_hours",
    )


VIEW_GRAIN = {
    "vw_daily_well_performance": "one row per entity and day",
    "vw_monthly_well_performance": "one row per entity, year and month",
    "vw_well_lifetime_summary": "one row per entity",
    "vw_field_monthly_summary": "one row per calendar month, all entities",
    "vw_downtime_episodes": "one row per shutdown episode",
    "vw_data_quality_review": "one row per flagged record and issue",
}


def all_views(fact: DataFrame, dim: DataFrame, rules=None) -> dict[str, DataFrame]:
    """The six views by name, lazily."""
    from prodseries.operators.checks import ReviewRules, review, review_listing
    from prodseries.operators.episodes import downtime_episodes

    return {
        "vw_daily_well_performance": daily(fact, dim),
        "vw_monthly_well_performance": monthly(fact, dim),
        "vw_well_lifetime_summary": lifetime(fact, dim),
        "vw_field_monthly_summary": field_monthly(fact),
        "vw_downtime_episodes": downtime_episodes(fact, dim),
        "vw_data_quality_review": review_listing(review(fact, rules or ReviewRules())),
    }


def register_views(spark: SparkSession, core: dict[str, DataFrame], spec: SeriesSpec, rules=None) -> list[str]:
    """Register the views as temp views under the column names of ``spec``.

    ``core`` holds ``daily_production`` and ``wellbore``; afterwards any SQL over
    the views runs through ``spark.sql``, with bound parameters in ``args``.
    """
    fact, dim = spec.fact(core["daily_production"]), spec.dimension(core["wellbore"])
    views = all_views(fact, dim, rules)
    for name, df in views.items():
        published = spec.publish(df)
        published.select(*[_commented(published, df, c, p) for c, p in zip(df.columns, published.columns)]
                         ).createOrReplaceTempView(name)
    return list(views)


def _commented(published, df, role, name):
    note = ROLE_NOTES.get(role)
    comment = f"{note[0]}; NULL: {note[2]}" if note else role.replace("_", " ")
    return F.col(name).alias(name, metadata={"comment": comment})


def describe_views(spark: SparkSession, views: dict[str, DataFrame], spec: SeriesSpec) -> DataFrame:
    """Catalogue of the views: grain, column, type, role, unit and meaning of NULL."""
    rows = [
        (v, VIEW_GRAIN.get(v, ""), i, f.name, f.dataType.simpleString(), role_of(f.name, spec),
         ROLE_NOTES.get(f.name, ("", "", ""))[1], ROLE_NOTES.get(f.name, ("", "", ""))[2])
        for v, df in views.items()
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(
        rows, "view string, grain string, position int, column string, type string, role string, unit string, null_meaning string"
    )


def schema_inventory(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Column count per table, named ``layer.table``."""
    rows = [(*name.split(".", 1), len(df.schema)) for name, df in sorted(tables.items())]
    return spark.createDataFrame(rows, "layer string, table_name string, columns int")
