"""Hours, volumes, sensors and choke: validity, contradictions, rates and abrupt changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from prodseries.functions.expr import (
    all_of, any_of, any_positive, clock_change_day, count_where, holds, pct, ratio, rounded_ratio, total,
)
from prodseries.operators import profile
from prodseries.operators.checks import ReviewRules
from prodseries.operators.views import with_names
from prodseries.spec import FLUIDS, TOTAL, VOLUMES

REPORT = ["entity", "day", "state", "mode", "hours", *FLUIDS]


def hours_buckets(fact: DataFrame) -> DataFrame:
    """One row of counts and the basic status of the hours column."""
    h = F.col("hours")
    one = fact.agg(
        F.count("*").alias("total_rows"), F.count(h).alias("non_null"), count_where(h.isNull()).alias("null_rows"),
        count_where(h == 0).alias("zero"), count_where((h > 0) & (h <= 24)).alias("valid_range"),
        count_where(h < 0).alias("negative"), count_where(h > 24).alias("above_24"),
    )
    bad = (F.col("negative") > 0) | (F.col("above_24") > 0)
    return one.withColumn("status", F.when(bad, "FAIL").when(F.col("null_rows") > 0, "REVIEW").otherwise("PASS"))


def null_hours_breakdown(fact: DataFrame) -> DataFrame:
    """Rows without hours by entity, state, mode and year, from one grouped pass."""
    cells = fact.where(F.col("hours").isNull()).groupBy("entity", "state", "mode", F.year("day").alias("year")).agg(
        F.count("*").alias("n")
    )
    contexts = F.array(*[
        F.struct(F.lit(c).alias("context"), F.col(c).cast("string").alias("group_value"))
        for c in ("entity", "state", "mode", "year")
    ])
    return cells.select("n", F.inline(contexts)).groupBy("context", "group_value").agg(F.sum("n").alias("null_hours"))


def null_hours_overlap(fact: DataFrame, rules: ReviewRules) -> DataFrame:
    """How rows without hours and rows before the window overlap, and what they carry."""
    before, blank = F.col("day") < F.lit(rules.window_start), F.col("hours").isNull()
    some = any_positive(FLUIDS)
    return fact.agg(
        count_where(before).alias("before_window"), count_where(blank).alias("null_hours"),
        count_where(before & blank).alias("before_window_and_null_hours"),
        count_where(blank & some).alias("null_hours_with_volume"), count_where(blank & ~some).alias("null_hours_blank"),
    )


def zero_hours_volumes(fact: DataFrame) -> DataFrame:
    """Positive volumes recorded on zero-hour days, per fluid and overall."""
    idle = F.col("hours") == 0
    return fact.agg(
        *[count_where(idle & (F.col(c) > 0)).alias(f"{c}_gt_0") for c in FLUIDS],
        count_where(idle & any_positive(VOLUMES)).alias("any_production"),
        count_where(idle & any_positive(FLUIDS)).alias("any_volume"),
    )


def zero_hours_rows(fact: DataFrame) -> DataFrame:
    return fact.where((F.col("hours") == 0) & any_positive(FLUIDS)).select(*REPORT)


def active_without_volume(fact: DataFrame) -> DataFrame:
    """Positive hours with all four volumes exactly zero, by state and mode."""
    none = all_of(holds(F.col(c) == 0) for c in FLUIDS)
    return fact.where((F.col("hours") > 0) & none).groupBy("state", "mode").agg(F.count("*").alias("row_count"))


def hours_verdict(fact: DataFrame) -> DataFrame:
    h = F.col("hours")
    none = all_of(holds(F.col(c) == 0) for c in FLUIDS)
    one = fact.agg(
        count_where((h < 0) | (h > 24)).alias("out_of_range"), count_where(h.isNull()).alias("null_rows"),
        count_where((h == 0) & any_positive(VOLUMES)).alias("zero_hours_production"),
        count_where((h == 0) & (F.col("injection") > 0)).alias("zero_hours_injection"),
        count_where((h > 0) & none).alias("active_without_volume"),
    )
    return one.withColumn("verdict", verdict(one, ["out_of_range"]))


def verdict(one_row: DataFrame, fail_on=()) -> F.Column:
    """FAIL when a hard count is above zero, REVIEW when any other is, else PASS."""
    review = [c for c in one_row.columns if c not in fail_on]
    out = F.when(any_of(F.col(c) > 0 for c in fail_on), "FAIL") if fail_on else F
    return out.when(any_of(F.col(c) > 0 for c in review), "PASS WITH REVIEW").otherwise("PASS")


def distribution(fact: DataFrame, column: str, probs=None, groups=("entity",)) -> DataFrame:
    """Counts, range and percentiles per entity. A group holds at most one value per
    calendar day, so the built-in exact percentile is bounded."""
    probs = probs or {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    v = F.col(column)
    return fact.groupBy(*groups).agg(
        F.lit(column).alias("column"), F.count(v).alias("value_count"), count_where(v.isNull()).alias("null_count"),
        count_where(v == 0).alias("zero_count"), F.min(v).alias("min"), F.max(v).alias("max"),
        ratio(F.sum(v), F.count(v)).alias("mean"), total(v).alias("total"),
        *[F.percentile(v, F.lit(p)).cast(TOTAL).alias(k) for k, p in probs.items()],
    )


def characterise(fact: DataFrame, population: F.Column) -> DataFrame:
    """Who makes up a flagged population and whether its rows carry values."""
    return fact.where(population).groupBy("entity", "state", "mode").agg(
        F.count("*").alias("row_count"), F.min("day").alias("first_date"), F.max("day").alias("last_date"),
        count_where(F.col("hours").isNull()).alias("null_hours"),
        *[count_where(F.col(c) != 0).alias(f"{c}_nonzero") for c in FLUIDS],
    )


def clock_change_checks(fact: DataFrame, limit: int = 24) -> DataFrame:
    """Four testable parts of the hypothesis that days above 24 hours are clock changes."""
    over = F.col("hours") > limit
    change = F.col("day") == clock_change_day(F.year("day"))
    # days first: at most one row per calendar day goes into the last step
    days = fact.groupBy("day").agg(
        count_where(over).alias("over"), count_where(F.col("hours") == limit + 1).alias("exact"),
        F.count("*").alias("reporting"), F.max(change).alias("is_change"),
    ).where(F.col("over") > 0)
    one = days.agg(
        F.coalesce(F.sum("over"), F.lit(0)).alias("n_over"), F.coalesce(F.sum("exact"), F.lit(0)).alias("n_exact"),
        F.count("*").alias("n_days"), count_where(F.col("is_change")).alias("n_change_days"),
        count_where(F.col("over") == F.col("reporting")).alias("n_uniform"),
        F.coalesce(F.sum(F.when(~F.col("is_change"), F.col("over"))), F.lit(0)).alias("n_elsewhere"),
    )
    c = F.col
    rows = [
        (1, "every value is exactly one hour above the day", c("n_exact"), c("n_over"),
         F.when(c("n_exact") == c("n_over"), "CONFIRMED").otherwise("PARTIALLY SUPPORTED")),
        (2, "every such day is the clock-change day of its year", c("n_change_days"), c("n_days"),
         F.when(c("n_change_days") == c("n_days"), "CONFIRMED").otherwise("NOT CONFIRMED")),
        (3, "all reporting entities show it on such a day", c("n_uniform"), c("n_days"),
         F.when(c("n_uniform") == c("n_days"), "CONFIRMED").otherwise("NOT CONFIRMED")),
        (4, "no such value on any other day", c("n_elsewhere"), c("n_over"),
         F.when(c("n_elsewhere") == 0, "CONFIRMED").otherwise("NOT CONFIRMED")),
    ]
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("check_order"), F.lit(n).alias("check_name"), a.alias("supporting"), b.alias("tested"), o.alias("outcome"))
        for i, n, a, b, o in rows
    ])))


def clock_change_days(fact: DataFrame, limit: int = 24) -> DataFrame:
    """Reporting and exceeding entities on each day with a value above the limit."""
    return fact.groupBy("day").agg(
        F.count("*").alias("entities_reporting"), count_where(F.col("hours") > limit).alias("entities_exceeding"),
    ).where(F.col("entities_exceeding") > 0).withColumn("expected_day", clock_change_day(F.year("day")))


def sign_counts(fact: DataFrame, columns=FLUIDS, groups=()) -> DataFrame:
    """NULL, zero, positive and negative values, kept apart, per column."""
    outs = []
    for c in columns:
        v = F.col(c)
        outs += [count_where(v.isNull()).alias(f"{c}_0"), count_where(v == 0).alias(f"{c}_1"),
                 count_where(v > 0).alias(f"{c}_2"), count_where(v < 0).alias(f"{c}_3")]
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_0").alias("null_count"), F.col(f"{c}_1").alias("zero_count"),
                 F.col(f"{c}_2").alias("positive_count"), F.col(f"{c}_3").alias("negative_count"))
        for c in columns
    ]
    return fact.groupBy(*groups).agg(*outs).select(*groups, F.inline(F.array(*rows)))


def negative_volumes(fact: DataFrame) -> DataFrame:
    return fact.where(any_of(holds(F.col(c) < 0) for c in VOLUMES)).select(*REPORT)


def contradictions(fact: DataFrame) -> DataFrame:
    """Volumes that contradict the recorded mode or state, as one row of counts."""
    made, injected = any_positive(VOLUMES), holds(F.col("injection") > 0)
    moving = (F.col("state") == "WI") & (F.col("mode") == "production")
    return fact.agg(
        count_where((F.col("mode") == "injection") & made).alias("injection_mode_with_production"),
        count_where((F.col("state") == "WI") & made).alias("injector_with_production"),
        count_where(moving & made).alias("of_which_in_transition"),
        count_where(injected & ((F.col("state") == "OP") | (F.col("mode") == "production"))).alias("injection_outside_injection_state"),
        count_where(injected & F.col("hours").isNull()).alias("injection_without_hours"),
    )


def contradiction_rows(fact: DataFrame) -> DataFrame:
    made, injected = any_positive(VOLUMES), holds(F.col("injection") > 0)
    producing_injector = (F.col("state") == "WI") & made
    odd_injection = injected & ((F.col("state") == "OP") | (F.col("mode") == "production"))
    return fact.where(producing_injector | odd_injection).select(
        *REPORT, producing_injector.alias("injector_with_production"), odd_injection.alias("injection_outside_injection_state")
    )


def with_rates(fact: DataFrame, columns=FLUIDS) -> DataFrame:
    """Volume per hour where hours are positive; NULL elsewhere."""
    h = F.when(F.col("hours") > 0, F.col("hours").cast("double"))
    rates = [(F.col(c).cast("double") / h).alias(f"{c}_rate") for c in columns if c != "injection"]
    if "injection" in columns:
        positive = F.when(F.col("injection") > 0, F.col("injection").cast("double"))
        rates.append((positive / h).alias("injection_rate"))
    return fact.select("entity", "day", *rates)


def rate_overview(fact: DataFrame, columns=FLUIDS) -> DataFrame:
    return profile.describe(with_rates(fact, columns), [f"{c}_rate" for c in columns])


def rate_by_entity(fact: DataFrame, column: str) -> DataFrame:
    v = F.col(f"{column}_rate")
    return with_rates(fact, (column,)).groupBy("entity").agg(
        F.count(v).alias("value_count"), F.avg(v).cast("decimal(28,4)").alias("mean"),
        F.percentile(v, F.lit(0.5)).cast(TOTAL).alias("median"), F.percentile(v, F.lit(0.95)).cast(TOTAL).alias("p95"),
        F.max(v).cast(TOTAL).alias("max"),
    )


def changes(fact: DataFrame, columns, guard: str = "positive") -> DataFrame:
    """Each value with the previous non-NULL value of the same entity and column.

    Previous values of all columns come from one window over the entity's days,
    so rows are shuffled once however many columns are asked for; they are turned
    into one row per column only afterwards. ``guard``: percentage change needs a
    previous value that is ``positive`` or ``nonzero``.
    """
    before = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    context = [c for c in ("hours", "mode", "state") if c in fact.columns]
    # kept together, so a column that is also context is not read twice
    wide = fact.select("entity", "day", *context, *[c for c in columns if c not in context])
    for c in columns:
        here = F.when(F.col(c).isNotNull(), F.struct("day", F.col(c).alias("v")))
        wide = wide.withColumn(f"_p_{c}", F.last(here, ignorenulls=True).over(before))
    long = wide.select("entity", "day", *context, F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"_p_{c}.day").alias("previous_date"),
            F.col(f"_p_{c}.v").alias("previous_value"), F.col(c).alias("current_value"),
        ) for c in columns
    ]))).where(F.col("previous_value").isNotNull() & F.col("current_value").isNotNull())
    base = F.col("previous_value")
    usable = base > 0 if guard == "positive" else base != 0
    diff = F.col("current_value") - base
    return long.select(
        "column", "entity", "previous_date", F.col("day").alias("current_date"), "previous_value", "current_value",
        diff.cast(TOTAL).alias("abs_change"), F.when(usable, pct(diff, base)).alias("pct_change"),
        usable.alias("has_baseline"), *context,
    )


def _beyond(pct_threshold, floor):
    """|change| above the share of the baseline, and at least the floor; no division."""
    change = F.abs("abs_change")
    large = change * 100 > F.abs("previous_value") * pct_threshold
    return F.col("has_baseline") & large & (change >= floor)


def abrupt_changes(fact: DataFrame, columns, pct_threshold=200, floor=0, guard="positive") -> DataFrame:
    """Changes above the percentage threshold and at least the absolute floor."""
    return changes(fact, columns, guard).where(_beyond(pct_threshold, floor)).drop("has_baseline")


def abrupt_listing(fact: DataFrame, dim: DataFrame, columns, pct_threshold=200, floor=0, guard="positive") -> DataFrame:
    """The same with the entity's name, the largest change first."""
    found = abrupt_changes(fact, columns, pct_threshold, floor, guard)
    return with_names(found, dim).orderBy(F.desc(F.abs("pct_change")), "entity_name", "column", "current_date")


def largest_changes(fact: DataFrame, columns, n: int, guard="positive") -> DataFrame:
    """The n changes of largest size, as a top-n report."""
    return changes(fact, columns, guard).drop("has_baseline").orderBy(
        F.desc(F.abs("abs_change")), "column", "entity", "current_date"
    ).limit(n)


def floor_sensitivity(fact: DataFrame, columns, floors, pct_threshold=200, guard="positive") -> DataFrame:
    """Flags left per column as the absolute floor rises; one pass for all floors."""
    counted = changes(fact, columns, guard).groupBy("column").agg(
        F.count("*").alias("comparisons"), *[count_where(_beyond(pct_threshold, f)).alias(f"f{i}") for i, f in enumerate(floors)]
    )
    rows = [F.struct(F.lit(f).alias("floor"), F.col(f"f{i}").alias("flags")) for i, f in enumerate(floors)]
    return counted.select("column", "comparisons", F.inline(F.array(*rows)))


def transition_support(fact: DataFrame) -> DataFrame:
    """Injector rows in production mode by which label their volumes support."""
    moving = (F.col("state") == "WI") & (F.col("mode") == "production")
    return fact.where(moving).groupBy(
        any_positive(VOLUMES).alias("supports_production"), holds(F.col("injection") > 0).alias("supports_injection")
    ).agg(F.count("*").alias("row_count"))


def transition_rows(fact: DataFrame) -> DataFrame:
    return fact.where((F.col("state") == "WI") & (F.col("mode") == "production")).select(
        *REPORT, any_positive(VOLUMES).alias("supports_production"), holds(F.col("injection") > 0).alias("supports_injection")
    )


def injection_by_state(fact: DataFrame) -> DataFrame:
    v = F.col("injection")
    return fact.groupBy("state", "mode").agg(
        F.count("*").alias("row_count"), count_where(v.isNull()).alias("null_count"), count_where(v == 0).alias("zero_count"),
        count_where(v > 0).alias("positive_count"), count_where(v < 0).alias("negative_count"), total(v).alias("total_injected"),
    )


def magnitude_bins(fact: DataFrame) -> DataFrame:
    """Zero-hour injection by size: [0,1), [1,100), [100,inf)."""
    v = F.col("injection")
    size = F.when(v < 1, "trace").when(v < 100, "moderate").otherwise("large")
    return fact.where((F.col("hours") == 0) & (v > 0)).groupBy(size.alias("magnitude")).agg(F.count("*").alias("row_count"))


def large_idle_injection(fact: DataFrame, floor=100) -> DataFrame:
    """Zero-hour injection strictly above the floor."""
    return fact.where((F.col("hours") == 0) & (F.col("injection") > floor)).select(*REPORT)


def idle_rate(fact: DataFrame) -> DataFrame:
    """Share of positive-volume rows that have zero hours, production against injection."""
    idle, made, injected = F.col("hours") == 0, any_positive(VOLUMES), holds(F.col("injection") > 0)
    one = fact.agg(
        count_where(made).alias("p"), count_where(made & idle).alias("pz"),
        count_where(injected).alias("i"), count_where(injected & idle).alias("iz"),
    )
    rows = [
        F.struct(F.lit(n).alias("kind"), F.col(a).alias("positive_rows"), F.col(b).alias("zero_hours_rows"),
                 rounded_ratio(b, a, 3, 100).alias("rate_pct"))
        for n, a, b in (("production", "p", "pz"), ("injection", "i", "iz"))
    ]
    return one.select(F.inline(F.array(*rows)))


def hours_by_activity(fact: DataFrame) -> DataFrame:
    """Hours when producing against hours when injecting."""
    split = fact.select(
        F.when(any_positive(VOLUMES), F.col("hours")).alias("producing"),
        F.when(F.col("injection") > 0, F.col("hours")).alias("injecting"),
    )
    return profile.describe(split, ["producing", "injecting"])


def blank_records(fact: DataFrame, rules: ReviewRules) -> DataFrame:
    """Do records before the window or without hours carry any positive volume?"""
    flagged = (F.col("day") < F.lit(rules.window_start)) | F.col("hours").isNull()
    some = any_positive(FLUIDS)
    return fact.where(flagged).agg(
        F.count("*").alias("flagged_rows"), count_where(some).alias("with_measurement"), count_where(~some).alias("blank")
    )


def sensor_validity(fact: DataFrame, sensors) -> DataFrame:
    return profile.numeric(fact, list(sensors), {"median": 0.5, "p95": 0.95})


def sensor_by_activity(fact: DataFrame, sensors) -> DataFrame:
    """Missing sensor share by activity; a row may be in several states."""
    h = F.col("hours")
    states = {
        "active_production": any_positive(VOLUMES), "active_injection": holds(F.col("injection") > 0),
        "zero_hours": holds(h == 0), "null_hours": h.isNull(),
        "all_zero_volume": all_of(holds(F.col(c) == 0) for c in FLUIDS),
    }
    outs, rows = [], []
    for i, (name, active) in enumerate(states.items()):
        outs.append(count_where(active).alias(f"n{i}"))
        for j, c in enumerate(sensors):
            outs.append(count_where(active & F.col(c).isNull()).alias(f"m{i}_{j}"))
            rows.append(F.struct(
                F.lit(name).alias("activity"), F.lit(c).alias("column"), F.col(f"n{i}").alias("total_rows"),
                F.col(f"m{i}_{j}").alias("missing_count"), rounded_ratio(f"m{i}_{j}", f"n{i}", 2, 100, even=True).alias("missing_pct"),
            ))
    return fact.agg(*outs).select(F.inline(F.array(*rows)))


def sensor_relations(fact: DataFrame, pairs, non_negative=()) -> DataFrame:
    """Rows with both sensors, rows where the first is below the second, and negatives."""
    outs, rows = [], []
    for i, (hi, lo) in enumerate(pairs):
        outs += [count_where(F.col(hi).isNotNull() & F.col(lo).isNotNull()).alias(f"b{i}"),
                 count_where(F.col(hi) < F.col(lo)).alias(f"v{i}")]
        rows.append((f"{hi} < {lo}", f"b{i}", f"v{i}"))
    for i, c in enumerate(non_negative):
        outs += [F.count(c).alias(f"nb{i}"), count_where(F.col(c) < 0).alias(f"nv{i}")]
        rows.append((f"{c} < 0", f"nb{i}", f"nv{i}"))
    return fact.agg(*outs).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("relation"), F.col(b).alias("compared_rows"), F.col(v).alias("review_rows"),
                 F.when(F.col(v) > 0, "REVIEW").otherwise("PASS").alias("status"))
        for n, b, v in rows
    ])))


def sensor_relation_rows(fact: DataFrame, hi: str, lo: str) -> DataFrame:
    return fact.where(F.col(hi) < F.col(lo)).select("entity", "day", "state", "mode", "hours", hi, lo)


def sensors_around_issues(fact: DataFrame, rules: ReviewRules, sensors) -> DataFrame:
    """Sensor values on records of the known issues and at the edges of the documented gap."""
    conds = {"DQ-002": rules.gap_edges(), **{k: v for k, v in rules.conditions().items() if k in ("DQ-004", "DQ-005", "DQ-006")}}
    tags = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in conds.items()]))
    return fact.where(any_of(holds(c) for c in conds.values())).select(
        "entity", "day", F.explode(tags).alias("dq_issue"), *sensors
    )


def choke_ranges(fact: DataFrame, choke: str) -> DataFrame:
    """Range, activity and hours findings for a choke-like opening, one row."""
    v, h = F.col(choke), F.col("hours")
    return fact.agg(
        count_where(v < 0).alias("below_0"), count_where(v == 0).alias("exactly_0"),
        count_where((v > 0) & (v < 100)).alias("between_0_and_100"), count_where(v == 100).alias("exactly_100"),
        count_where(v > 100).alias("above_100"), count_where(v.isNull()).alias("null_rows"), F.count("*").alias("total_rows"),
        count_where((v == 0) & any_positive(VOLUMES)).alias("zero_with_production"),
        count_where((v == 0) & (F.col("injection") > 0)).alias("zero_with_injection"),
        count_where((v > 0) & (h == 0)).alias("open_with_zero_hours"),
        count_where((v > 0) & h.isNull()).alias("open_without_hours"),
    )


def choke_correlation(fact: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with both values and their correlation."""
    both = fact.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(
        F.count("*").alias("row_count"),
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).cast("decimal(18,6)").alias("correlation"),
    )


def zero_agreement(fact: DataFrame, a: str, b: str) -> DataFrame:
    """Do both openings read zero together?"""
    both = fact.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy((F.col(a) == 0).alias("first_zero"), (F.col(b) == 0).alias("second_zero")).agg(
        F.count("*").alias("row_count")
    )
