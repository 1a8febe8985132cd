"""Findings brought together: evidence per variable, issue register, rule set and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prodseries.functions.expr import any_of, any_positive, count_where, holds
from prodseries.operators import checks, measures as ms
from prodseries.operators.checks import Check, ReviewRules
from prodseries.spec import FLUIDS, MODES, STATES, VOLUMES, SeriesSpec


def outlier_evidence(fact: DataFrame, columns, floor) -> DataFrame:
    """Per variable: negatives, zero-hour positives, and abrupt changes with and without a floor.

    An unusual value is evidence for review, never an error by itself.
    """
    outs, rows = [], []
    for c in columns:
        outs += [count_where(F.col(c) < 0).alias(f"{c}_neg"), count_where((F.col("hours") == 0) & (F.col(c) > 0)).alias(f"{c}_idle")]
        rows.append(F.struct(F.lit(c).alias("variable"), F.col(f"{c}_neg").alias("negative_values"), F.col(f"{c}_idle").alias("zero_hours_positive")))
    signs = fact.agg(*outs).select(F.inline(F.array(*rows)))
    jumps = ms.floor_sensitivity(fact, list(columns), [0, floor]).groupBy("column").agg(
        F.max(F.when(F.col("floor") == 0, F.col("flags"))).alias("abrupt_changes"),
        F.max(F.when(F.col("floor") == floor, F.col("flags"))).alias("abrupt_changes_above_floor"),
    )
    # one row per variable on both sides
    joined = signs.join(F.broadcast(jumps), F.col("variable") == F.col("column"), "left")
    counts = ["negative_values", "zero_hours_positive", "abrupt_changes", "abrupt_changes_above_floor"]
    filled = joined.select("variable", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    return filled.withColumn("status", F.when(any_of(F.col(c) > 0 for c in counts), "REVIEW").otherwise("PASS"))


# Fixed wording of the register.
REGISTER = (
    ("DQ-001", "Low", "Keep as recorded; flag on load", True, "Open"),
    ("DQ-002", "Low", "No action on data; document the gap", True, "Open"),
    ("DQ-003", "Low", "Load hours as nullable; do not fill", True, "Open"),
    ("DQ-004", "Low-Medium", "No upper bound on hours until confirmed", True, "Open"),
    ("DQ-005", "Low", "Keep as recorded; no lower bound on water", True, "Open"),
    ("DQ-006", "Medium", "Keep as recorded; flag on load", True, "Open"),
)


def issue_register(fact: DataFrame, rules: ReviewRules) -> DataFrame:
    """Documented issues with the number of records they cover now. Flags overlap, so the
    counts may add up to more than the distinct records."""
    register = fact.sparkSession.createDataFrame(
        list(REGISTER), "issue_id string, severity string, treatment string, needs_domain_input boolean, issue_status string"
    )
    live = checks.review(fact, rules).groupBy("dq_issue").agg(F.count("*").alias("affected_records"))
    # six rows, and at most one row per issue
    joined = register.join(F.broadcast(live), F.col("issue_id") == F.col("dq_issue"), "left")
    return joined.select(*register.columns, F.coalesce("affected_records", F.lit(0)).cast("long").alias("affected_records"))


def severity_counts(register: DataFrame) -> DataFrame:
    return register.groupBy("severity").agg(F.count("*").alias("issues"), F.sum("affected_records").alias("affected_records"))


def flag_overlap(fact: DataFrame, rules: ReviewRules) -> DataFrame:
    """Flags raised against distinct flagged records."""
    per_record = checks.review(fact, rules).groupBy("entity", "day").agg(F.count("*").alias("n"))
    return per_record.agg(F.sum("n").alias("flags"), F.count("*").alias("flagged_records"),
                          count_where(F.col("n") > 1).alias("records_with_several_flags"))


def section_findings(fact: DataFrame, rules: ReviewRules, spec: SeriesSpec, floors: dict[str, float]) -> DataFrame:
    """Findings per measurement group as (section, finding, count) rows.

    Row findings come from one aggregate, change findings from one window pass.
    """
    made, injected = any_positive(VOLUMES), holds(F.col("injection") > 0)
    h, moving = F.col("hours"), (F.col("state") == "WI") & (F.col("mode") == "production")
    sensors = list(spec.sensors)
    found = {
        ("production", "negative volume"): any_of(holds(F.col(c) < 0) for c in VOLUMES),
        ("production", "production in injection mode"): (F.col("mode") == "injection") & made,
        ("production", "unexplained injector production"): (F.col("state") == "WI") & made & ~moving,
        ("production", "production with zero hours"): (h == 0) & made,
        ("injection", "negative injection"): F.col("injection") < 0,
        ("injection", "injection outside injection state"): injected & ((F.col("state") == "OP") | (F.col("mode") == "production")),
        ("injection", "blank record with measurement"): ((F.col("day") < F.lit(rules.window_start)) | h.isNull()) & any_positive(FLUIDS),
        ("injection", "large injection with zero hours"): (h == 0) & (F.col("injection") > rules.injection_floor),
        **{("sensors", f"{hi} below {lo}"): F.col(hi) < F.col(lo) for hi, lo in spec.ordered_sensors},
        **{("sensors", f"negative {c}"): F.col(c) < 0 for c in sensors},
    }
    if spec.choke:
        v = F.col(spec.choke)
        found |= {
            ("choke", "above 100"): v > 100, ("choke", "zero with production"): (v == 0) & made,
            ("choke", "zero with injection"): (v == 0) & injected, ("choke", "open with zero hours"): (v > 0) & (h == 0),
            ("choke", "open without hours"): (v > 0) & h.isNull(),
        }
    one = fact.agg(*[count_where(c).alias(f"f{i}") for i, c in enumerate(found.values())])
    rows = one.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(f).alias("finding"), F.col(f"f{i}").alias("row_count"))
        for i, (s, f) in enumerate(found)
    ])))
    group = F.when(F.col("column").isin(*VOLUMES), "production").when(F.col("column") == spec.choke, "choke").otherwise("sensors")
    floor = F.lit(None)
    for c, f in floors.items():
        floor = F.when(F.col("column") == c, F.lit(f)).otherwise(floor)
    kept = ms.changes(fact, [*VOLUMES, *sensors], guard="nonzero").where(ms._beyond(200, F.coalesce(floor, F.lit(0))))
    jumps = kept.groupBy(group.alias("section")).agg(F.count("*").alias("row_count")).select(
        "section", F.lit("abrupt change").alias("finding"), "row_count")
    return rows.unionByName(jumps)


def section_verdicts(findings: DataFrame) -> DataFrame:
    """PASS WITH REVIEW for a section with any finding; nothing here is a hard failure."""
    per = findings.groupBy("section").agg(count_where(F.col("row_count") > 0).alias("open_findings"))
    return per.withColumn("verdict", F.when(F.col("open_findings") > 0, "PASS WITH REVIEW").otherwise("PASS"))


def assessment_checks() -> list[Check]:
    """The 24 automated checks: hard rules fail, the others ask for review."""
    S, R = "structure", "measurement"
    return [
        Check("AC-01", S, "Daily source is readable"),
        Check("AC-02", S, "Monthly source is readable"),
        Check("AC-03", S, "Required columns are present"),
        Check("AC-04", S, "Dates are present and readable"),
        Check("AC-05", S, "Daily key is unique"),
        Check("AC-06", S, "Monthly key is unique"),
        Check("AC-07", S, "Monthly rows without any key", hard=False),
        Check("AC-08", S, "Code and name map one to one"),
        Check("AC-09", S, "Both sources hold the same entities"),
        Check("AC-10", R, "Hours are not negative"),
        Check("AC-11", R, "Hours above 24", hard=False),
        Check("AC-12", R, "State is a known value"),
        Check("AC-13", R, "Mode is a known value"),
        Check("AC-14", R, "Oil and gas are not negative"),
        Check("AC-15", R, "Water is not negative", hard=False),
        Check("AC-16", R, "Injection is not negative"),
        Check("AC-17", R, "Injection outside the injection state", hard=False),
        Check("AC-18", R, "Sensors of pressure are not negative"),
        Check("AC-19", R, "Sensors of temperature are not negative"),
        Check("AC-20", R, "Choke is not negative"),
        Check("AC-21", R, "Choke above 100", hard=False),
        Check("AC-22", "reconciliation", "Daily sums match the monthly source", hard=False),
        Check("AC-23", "drift", "Row counts outside the range around the prior run", hard=False),
        Check("AC-24", "drift", "Dates outside the operating window", hard=False),
    ]


def run_assessment(
    raw_daily: DataFrame, fact: DataFrame, raw_monthly: DataFrame, monthly: DataFrame,
    rules: ReviewRules, spec: SeriesSpec, expected_daily: int | None = None, expected_monthly: int | None = None,
    required=(), drift: float = 0.02, prior: DataFrame | None = None, month_end: bool = False,
) -> DataFrame:
    """Evaluate the 24 checks on the check engine; daily and monthly rows are read once for all that is asked of them.

    ``required``: columns the raw daily rows must have. ``drift``: how far, as a share, the daily and the monthly row
    count may each be from those of the prior run: ``prior`` (check_id, actual; its QC-002 and QC-005), or the two
    numbers where it is not given, or, with ``month_end``, the run that would have followed the last month but one.
    """
    missing = [c for c in required if c not in raw_daily.columns]
    if prior is None:
        sizes = [("QC-002", expected_daily), ("QC-005", expected_monthly)]
        prior = fact.sparkSession.createDataFrame(sizes, "check_id string, actual long")
    kinds = {k: [s for s in spec.sensors if k in s] for k in ("pressure", "temperature")}
    if not any(kinds.values()):
        kinds["pressure"] = [s for s in spec.sensors if s != spec.choke]
    below = lambda cols: any_of([F.lit(False), *[holds(F.col(c) < 0) for c in cols]])
    odd = holds(F.col("injection") > 0) & ((F.col("state") == "OP") & (F.col("mode") == "production"))
    after = F.lit(False) if rules.window_end is None else F.col("day") > F.lit(rules.window_end)
    choke = [spec.choke] if spec.choke in fact.columns else []
    flags = {
        "AC-04": F.col("day").isNull(), "AC-10": F.col("hours") < 0, "AC-11": F.col("hours") > 24,
        "AC-12": ~F.col("state").isin(*STATES), "AC-13": ~F.col("mode").isin(*MODES),
        "AC-14": below(["oil", "gas"]), "AC-15": below(["water"]), "AC-16": below(["injection"]), "AC-17": odd,
        "AC-18": below(kinds["pressure"]), "AC-19": below(kinds["temperature"]), "AC-20": below(choke),
        "AC-21": F.col(choke[0]) > 100 if choke else F.lit(False),
        "AC-24": (F.col("day") < F.lit(rules.window_start)) | after,
    }
    held, _ = checks.entity_months(fact, monthly, flags)
    sized = F.col("check_id").isin("QC-002", "QC-005")
    counts = checks.month_totals(checks.by_month(held.drop("entity", "held")), ["QC-002", "QC-005"])
    if not month_end:
        before = prior.where(sized).select("check_id", F.col("actual").cast("long").alias("before"))
        counts = counts.drop("before").join(F.broadcast(before), "check_id", "left")  # two rows
    far = F.abs(F.col("actual") - F.col("before")) > F.floor(F.lit(drift) * F.col("before"))
    named = F.create_map(*map(F.lit, ("QC-002", "AC-23", "QC-005", "AC-23", "QC-006", "AC-05", "QC-007", "AC-06",
                                      "QC-014", "AC-22", "QC-015", "AC-22", "QC-016", "AC-22")))
    found = F.struct(F.coalesce(F.try_element_at(named, F.col("check_id")), "check_id").alias("check_id"),
                     F.when(sized, F.when(far, 1).otherwise(0)).otherwise(F.col("actual")).cast("long").alias("actual"))
    empty = F.struct(F.lit("AC-01").alias("check_id"), F.when(F.col("actual") == 0, 1).otherwise(0).cast("long").alias("actual"))
    counts = counts.select(F.inline(F.when(F.col("check_id") == "QC-002", F.array(found, empty)).otherwise(F.array(found))))
    blank = F.col("entity").isNull() & F.col("year").isNull() & F.col("month").isNull()
    stray = raw_monthly.agg(count_where(blank).alias("AC-07"), F.lit(len(missing)).alias("AC-03"))
    ids = checks.identity_counts(raw_daily, raw_monthly).select(
        (F.col("QC-010") + F.col("QC-011")).alias("AC-08"), (F.col("QC-012") + F.col("QC-013")).alias("AC-09"),
        F.when(F.col("QC-004") == 0, 1).otherwise(0).alias("AC-02"),
    )
    counts = counts.unionByName(checks.long_counts(stray)).unionByName(checks.long_counts(ids))
    counts = counts.groupBy("check_id").agg(F.sum("actual").alias("actual"))
    return checks.evaluate(fact.sparkSession, assessment_checks(), counts)


def outcome_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("checks"))
