"""Activity runs per entity: shutdowns, restarts and downtime episodes.

Every window here is partitioned by entity and ordered by day. The fact has one
row per (entity, day), so a partition is at most the length of the calendar,
whatever share of all rows an entity holds. All windows share one exchange and
one sort; there is no join back to the fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from prodseries.functions.expr import count_where, rounded_ratio
from prodseries.operators.views import with_names

def by_day():
    return Window.partitionBy("entity").orderBy("day")



def known_days(fact: DataFrame) -> DataFrame:
    """Days with recorded hours, with their own and the previous known state.

    The oil of the calendar day before is looked up before blank days are
    dropped; the previous state is looked up after, so a blank day neither ends
    nor starts a run.
    """
    before = F.when(F.datediff("day", F.lag("day").over(by_day())) == 1, F.lag("oil").over(by_day()))
    return (
        fact.select("entity", "day", "hours", "oil")
        .withColumn("oil_day_before", before)
        .where(F.col("hours").isNotNull())
        .withColumn("is_active", F.col("hours") > 0)
        .withColumn("was_active", F.lag("is_active").over(by_day()))
    )


def transitions(fact: DataFrame) -> DataFrame:
    """One row per state flip between consecutive known records."""
    flipped = known_days(fact).where(F.col("is_active") != F.col("was_active"))
    kind = F.when(F.col("is_active"), "restart").otherwise("shutdown")
    return flipped.select("entity", F.col("day"), kind.alias("transition_type"))


def transition_counts(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Shutdowns, restarts and total flips per entity that has any."""
    counts = transitions(fact).groupBy("entity").agg(
        count_where(F.col("transition_type") == "shutdown").alias("shutdowns"),
        count_where(F.col("transition_type") == "restart").alias("restarts"),
        F.count("*").alias("total_transitions"),
    )
    return with_names(counts, dim)


def downtime_episodes(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per inactive run that follows an observed active record.

    Keeping only the first row of every run makes the next run the next row, so
    its day is the restart and its oil the value on the restart day. A run still
    open at the end of the record keeps a NULL restart.
    """
    starts = known_days(fact).where(
        F.col("was_active").isNull() | (F.col("is_active") != F.col("was_active"))
    )
    shutdowns = (
        starts.withColumn("restart_date", F.lead("day").over(by_day()))
        .withColumn("oil_after", F.lead("oil").over(by_day()))
        .where(~F.col("is_active") & F.col("was_active").isNotNull())
    )
    named = with_names(shutdowns, dim)
    return named.select(
        "entity", "entity_name",
        F.col("day").alias("shutdown_date"),
        "restart_date",
        F.datediff("restart_date", "day").alias("offline_days"),
        F.col("oil_day_before").alias("oil_before"),
        "oil_after",
        rounded_ratio("oil_after", "oil_day_before", 1, 100).alias("recovery_pct"),
    )


def outage_kpis(episodes: DataFrame) -> DataFrame:
    """Completed and open outages per entity; open ones do not count towards the days."""
    done = F.col("restart_date").isNotNull()
    return episodes.groupBy("entity", "entity_name").agg(
        count_where(done).alias("completed_outages"),
        count_where(~done).alias("still_down"),
        F.sum("offline_days").alias("total_offline_days"),
        F.max("offline_days").alias("longest_outage"),
        F.percentile("offline_days", F.lit(0.5)).cast("decimal(18,6)").alias("median_outage"),
        count_where(done).alias("restarts"),
    )
