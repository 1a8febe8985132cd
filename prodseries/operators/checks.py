"""Review flags on records and the declarative check engine."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from prodseries.functions.expr import any_of, count_where, dealt_by_month, holds, total
from prodseries.spec import MODES, STATES, TOTAL

# Wording of the review reasons.
ISSUE_REASONS = {
    "DQ-001": "Record before the start of the operating window",
    "DQ-003": "Hours not recorded: blank measurement record, not a zero",
    "DQ-004": "More than 24 hours recorded: possible clock change, not confirmed",
    "DQ-005": "Negative water, or unexplained positive volume on a documented day",
    "DQ-006": "Substantial injection recorded with zero hours",
}
ISSUE_EXPLANATIONS = {
    "DQ-001": "Record before the start of the operating window.",
    "DQ-002": "Reporting gap shared by several entities: a missing interval, so there is no record to flag.",
    "DQ-003": "Hours are NULL, which is a different state from hours = 0.",
    "DQ-004": "Hours above 24: plausible clock change, no upper bound is enforced.",
    "DQ-005": "Negative water, or unexplained positive volume recorded with zero hours.",
    "DQ-006": "Substantial injection recorded with zero hours and no sensor readings.",
}


@dataclass(frozen=True)
class ReviewRules:
    """Parameters of the known issues; entity lists of None mean every entity."""

    window_start: dt.date = dt.date(2008, 1, 1)
    window_end: dt.date | None = None
    hours_limit: float = 24
    injection_floor: float = 100
    injection_entities: tuple | None = None
    exceptions: tuple[tuple[int, dt.date], ...] = ()
    gap_entities: tuple | None = None
    gap_from: dt.date | None = None
    gap_to: dt.date | None = None

    def conditions(self) -> dict[str, Column]:
        """Issue -> condition on a fact row. A shared gap has no row, so it is absent."""
        odd_days = [(F.col("entity") == e) & (F.col("day") == F.lit(d)) for e, d in self.exceptions]
        idle_injection = (F.col("hours") == 0) & (F.col("injection") > self.injection_floor)
        if self.injection_entities is not None:
            idle_injection &= F.col("entity").isin(list(self.injection_entities))
        return {
            "DQ-001": F.col("day") < F.lit(self.window_start),
            "DQ-003": F.col("hours").isNull(),
            "DQ-004": F.col("hours") > self.hours_limit,
            "DQ-005": any_of([F.col("water") < 0, *odd_days]),
            "DQ-006": idle_injection,
        }

    def in_gap(self) -> Column:
        """Rows strictly inside the documented gap (none are expected)."""
        if self.gap_from is None:
            return F.lit(False)
        inside = (F.col("day") > F.lit(self.gap_from)) & (F.col("day") < F.lit(self.gap_to))
        if self.gap_entities is not None:
            inside &= F.col("entity").isin(list(self.gap_entities))
        return inside

    def gap_edges(self) -> Column:
        """Rows on the last day before and the first day after the documented gap."""
        if self.gap_from is None:
            return F.lit(False)
        edge = F.col("day").isin(self.gap_from, self.gap_to)
        if self.gap_entities is not None:
            edge &= F.col("entity").isin(list(self.gap_entities))
        return edge


# The known issues of the documented snapshot.
SNAPSHOT_RULES = ReviewRules(
    window_start=dt.date(2008, 1, 1),
    window_end=dt.date(2016, 12, 31),
    hours_limit=24,
    injection_floor=100,
    injection_entities=(5693, 5769),
    exceptions=((7078, dt.date(2015, 1, 17)),),
    gap_entities=(5351, 5599),
    gap_from=dt.date(2012, 1, 2),
    gap_to=dt.date(2012, 1, 14),
)


def review(fact: DataFrame, rules: ReviewRules) -> DataFrame:
    """One row per (record, issue) in one scan; a record may carry several issues."""
    conds = rules.conditions()
    flags = [
        F.when(c, F.struct(F.lit(i).alias("dq_issue"), F.lit(ISSUE_REASONS[i]).alias("review_reason")))
        for i, c in conds.items()
    ]
    return (
        fact.where(any_of(F.coalesce(c, F.lit(False)) for c in conds.values()))
        .select("entity", "day", F.explode(F.array_compact(F.array(*flags))).alias("flag"))
        .select("entity", "day", "flag.dq_issue", "flag.review_reason")
    )


def review_listing(flags: DataFrame) -> DataFrame:
    """The flagged records by day, then entity."""
    return flags.orderBy("day", "entity", "dq_issue")


def review_summary(flags: DataFrame) -> DataFrame:
    """Records, entities and date span per issue; entities are counted after one
    pre-aggregation, so a hot issue is never held in one place."""
    per_entity = flags.groupBy("dq_issue", "entity").agg(
        F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last")
    )
    return per_entity.groupBy("dq_issue").agg(
        F.sum("n").alias("record_count"), F.count("*").alias("affected_wells"),
        F.min("first").alias("earliest_date"), F.max("last").alias("latest_date"),
    )


def review_detail(flags: DataFrame, dim: DataFrame, issue: str) -> DataFrame:
    hit = flags.where(F.col("dq_issue") == issue)
    return hit.join(dim.select("entity", "entity_name"), "entity").select("entity_name", "day", "review_reason").orderBy("day", "entity_name")


def review_by_entity(flags: DataFrame, dim: DataFrame) -> DataFrame:
    counts = flags.groupBy("dq_issue", "entity").agg(F.count("*").alias("record_count"))
    return counts.join(dim.select("entity", "entity_name"), "entity").select("dq_issue", "entity_name", "record_count")


def review_by_month(flags: DataFrame) -> DataFrame:
    return flags.groupBy("dq_issue", F.trunc("day", "MM").alias("month")).agg(F.count("*").alias("record_count"))


def issue_explanations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ISSUE_EXPLANATIONS.items()), "dq_issue string, explanation string")


# --- check engine -----------------------------------------------------------

ZERO, EQUALS, KNOWN = "zero_violations", "count_equals", "known_population"


@dataclass(frozen=True)
class Check:
    """A named count compared with an expected count.

    ``known_population``: a match is REVIEW (the documented exception is still
    there, unchanged) and anything else is FAIL (it drifted). ``drift`` is the share
    of the expected count that the actual one may be away from it; 0 is exact.
    """

    check_id: str
    category: str
    check_name: str
    kind: str = ZERO
    expected: int = 0
    hard: bool = True
    drift: float = 0.0


@dataclass(frozen=True)
class Expected:
    """Documented sizes of one snapshot; the defaults are the fixed values of the documented one."""

    raw_daily: int = 15634
    daily: int = 15634
    entities: int = 7
    raw_monthly: int = 527
    monthly: int = 526
    issues: dict[str, int] = field(
        default_factory=lambda: {"DQ-001": 244, "DQ-002": 0, "DQ-003": 285, "DQ-004": 20, "DQ-005": 5, "DQ-006": 2}
    )


def standard_checks(expected: Expected) -> list[Check]:
    """The 27 checks in report order."""
    rows, grain, fk = "Row counts", "Grain uniqueness", "Dimension coverage"
    ident, recon, known, cons = (
        "Identifier consistency", "Daily/monthly reconciliation", "Known DQ issues", "Constraint-sensitive",
    )
    n = expected.issues
    return [
        Check("QC-001", rows, "Raw daily row count", EQUALS, expected.raw_daily),
        Check("QC-002", rows, "Core daily row count", EQUALS, expected.daily),
        Check("QC-003", rows, "Core entity count", EQUALS, expected.entities),
        Check("QC-004", rows, "Raw monthly row count", EQUALS, expected.raw_monthly),
        Check("QC-005", rows, "Core monthly row count", EQUALS, expected.monthly),
        Check("QC-006", grain, "Duplicate (entity, day) keys"),
        Check("QC-007", grain, "Duplicate (entity, year, month) keys"),
        Check("QC-008", fk, "Daily rows without a dimension row"),
        Check("QC-009", fk, "Monthly rows without a dimension row"),
        Check("QC-010", ident, "Entity codes with more than one name (raw)"),
        Check("QC-011", ident, "Entity names with more than one code (raw)"),
        Check("QC-012", ident, "Entity codes in raw daily only"),
        Check("QC-013", ident, "Entity codes in raw monthly only"),
        Check("QC-014", recon, "Entity-months in the daily rows only"),
        Check("QC-015", recon, "Entity-months in the monthly rows only"),
        Check("QC-016", recon, "Value mismatches beyond the tolerance"),
        Check("DQ-001", known, "Records before the operating window", KNOWN, n["DQ-001"]),
        Check("DQ-002", known, "Records inside the documented gap", KNOWN, n["DQ-002"]),
        Check("DQ-003", known, "Records without hours", KNOWN, n["DQ-003"]),
        Check("DQ-004", known, "Records above 24 hours", KNOWN, n["DQ-004"]),
        Check("DQ-005", known, "Negative water and documented odd days", KNOWN, n["DQ-005"]),
        Check("DQ-006", known, "Injection with zero hours", KNOWN, n["DQ-006"]),
        Check("QC-017", cons, "Negative oil, gas or injection"),
        Check("QC-018", cons, "Negative hours or sensor values"),
        Check("QC-019", cons, "Unknown state values"),
        Check("QC-020", cons, "Unknown mode values"),
        Check("QC-021", cons, "Unknown choke unit values"),
    ]


def long_counts(one_row: DataFrame) -> DataFrame:
    """A one-row aggregate turned into (check_id, actual) rows."""
    return one_row.select(*[F.col(f"`{c}`").cast("long").alias(c) for c in one_row.columns]).unpivot(
        [], [F.col(f"`{c}`") for c in one_row.columns], "check_id", "actual"
    )


def duplicate_keys(df: DataFrame, keys, check_id: str) -> DataFrame:
    return df.groupBy(*keys).count().agg(count_where(F.col("count") > 1).alias(check_id))


def presence(left: DataFrame, right: DataFrame, key: str, left_only: str, right_only: str) -> DataFrame:
    """Distinct non-NULL keys found on one side only, both directions in one pass."""
    sides = (
        left.where(F.col(key).isNotNull()).select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.where(F.col(key).isNotNull()).select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    return sides.agg(
        count_where(F.col("r") == 0).alias(left_only), count_where(F.col("l") == 0).alias(right_only)
    )


def identity_counts(raw_daily: DataFrame, raw_monthly: DataFrame) -> DataFrame:
    """Row counts and identifier checks of both raw sources, one row.

    Rows collapse to one per (code, name) before anything else, so a code holding a
    third of the rows is a single row when codes and names are compared.
    """
    pairs = raw_daily.groupBy("entity", "entity_name").agg(F.count("*").alias("n"))
    full = F.when(F.col("entity").isNotNull() & F.col("entity_name").isNotNull(), 1).otherwise(0)
    daily = pairs.select("n", full.alias("pair"), F.inline(F.array(
        F.struct(F.lit("code").alias("kind"), F.col("entity").cast("string").alias("key")),
        F.struct(F.lit("name").alias("kind"), F.col("entity_name").alias("key")),
    ))).select("kind", "key", "pair", F.col("n").alias("d"), F.lit(0).cast("long").alias("m"))
    monthly = raw_monthly.groupBy(F.col("entity").cast("string").alias("key")).agg(F.count("*").alias("m")).select(
        F.lit("code").alias("kind"), "key", F.lit(0).alias("pair"), F.lit(0).cast("long").alias("d"), "m"
    )
    per = daily.unionByName(monthly).groupBy("kind", "key").agg(
        F.sum("pair").alias("partners"), F.sum("d").alias("d"), F.sum("m").alias("m")
    )
    code, known = F.col("kind") == "code", F.col("key").isNotNull()
    rows = lambda c: F.coalesce(F.sum(F.when(code, F.col(c))), F.lit(0))
    return per.agg(
        rows("d").alias("QC-001"), rows("m").alias("QC-004"),
        count_where(code & (F.col("partners") > 1)).alias("QC-010"),
        count_where(~code & (F.col("partners") > 1)).alias("QC-011"),
        count_where(code & known & (F.col("d") > 0) & (F.col("m") == 0)).alias("QC-012"),
        count_where(code & known & (F.col("d") == 0) & (F.col("m") > 0)).alias("QC-013"),
    )


def keyed_counts(
    df: DataFrame, keys, flags: dict[str, Column], parent: DataFrame | None, rows: str, dups: str, orphans: str, entities: str | None = None,
) -> DataFrame:
    """Row count, duplicate keys, rows without a parent, any row flags and (if named) the entities of one table, one row.

    One chain: rows to keys, keys to entities, entities against the parent. The
    parent is met by one row per entity, however many rows an entity has. Duplicates
    are counted among complete keys only.
    """
    names = {f"f{i}": c for i, c in enumerate(flags)}
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[count_where(flags[c]).alias(a) for a, c in names.items()]
    )
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    per_entity = per_key.groupBy("entity").agg(
        F.sum("n").alias("n"), count_where(whole & (F.col("n") > 1)).alias("dup"), *[F.sum(a).alias(a) for a in names]
    )
    lost = F.lit(0)
    if parent is not None:
        known = parent.select(F.col("entity").alias("_parent")).distinct()  # a repeated parent is no second row
        per_entity = per_entity.join(known, F.col("entity") == F.col("_parent"), "left")
        lost = F.when(F.col("_parent").isNull() & F.col("entity").isNotNull(), F.col("n")).otherwise(0)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    distinct = [] if entities is None else [F.count("entity").alias(entities)]
    return per_entity.agg(
        zero("n").alias(rows), zero("dup").alias(dups), zero(lost).alias(orphans), *[zero(a).alias(c) for a, c in names.items()], *distinct
    )


def row_flags(fact: DataFrame, rules: ReviewRules) -> dict[str, Column]:
    """All row-level checks on the core daily rows, as conditions a violating row meets."""
    issues = rules.conditions()
    sensors = [c for c, t in fact.dtypes if t.startswith("decimal") and c not in ("oil", "gas", "water", "injection", "hours")]
    below = lambda cols: any_of(F.coalesce(F.col(c) < 0, F.lit(False)) for c in cols)
    return {
        "DQ-001": issues["DQ-001"],
        "DQ-002": rules.in_gap(),
        **{i: issues[i] for i in ("DQ-003", "DQ-004", "DQ-005", "DQ-006")},
        "QC-017": below(["oil", "gas", "injection"]),
        "QC-018": below(["hours", *sensors]),
        "QC-019": ~F.col("state").isin(*STATES),
        "QC-020": ~F.col("mode").isin(*MODES),
        "QC-021": (F.col("choke_unit") != "%") if "choke_unit" in fact.columns else F.lit(False),
    }


def entity_months(fact: DataFrame, monthly: DataFrame, flags: dict[str, Column], tolerance: float = 1e-6) -> tuple[DataFrame, list[str]]:
    """What each entity-month adds to the checks on the core tables, and the names of these checks.

    `flags` are conditions on a daily row, by check.

    Daily rows are summed to months before they meet the monthly rows; every monthly row is a row of the result, and so
    is every entity-month that only the daily rows have. Both tables are read once. A repeated monthly key meets the
    daily sums again, as a row of a join would, but their counts stay with its first row. The flags of a row travel as
    the bits of one number, and its second row tells that a day is repeated: no wide group a day is held.
    """
    from prodseries.operators.reconcile import KEY

    volumes = ("oil", "gas", "water", "injection")
    names = {f"f{i}": c for i, c in enumerate(flags)}
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(flags.values())), F.lit(0)).cast("long")
    rows = dealt_by_month(fact.select("entity", "day", bits.alias("bits"), *volumes))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY, "day").orderBy(F.lit(0))))
    repeated = F.col("entity").isNotNull() & F.col("day").isNotNull() & (F.col("nth") == 2)
    flagged = {a: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0 for i, a in enumerate(names)}
    daily = rows.groupBy(*KEY).agg(
        F.count("*").alias("n"), count_where(repeated).alias("dup"), *[count_where(c).alias(a) for a, c in flagged.items()], *[total(v).alias(f"d_{v}") for v in volumes])
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))
    given = monthly.select(*KEY, *[F.col(v).cast(TOTAL).alias(f"m_{v}") for v in volumes]).withColumn("place", place)
    both = daily.join(given, list(KEY), "full_outer")

    in_daily, in_monthly, one = F.col("n").isNotNull(), F.col("place").isNotNull(), lambda c: c.cast("long")
    first = F.coalesce(F.col("place") == 1, F.lit(True))
    whole = F.col("entity").isNotNull() & F.col("year").isNotNull() & F.col("month").isNotNull()
    count = lambda c: F.when(first, F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    tol, zero = F.lit(tolerance).cast(TOTAL), F.lit(0).cast(TOTAL)
    off = any_of(F.abs(F.coalesce(f"d_{v}", zero) - F.coalesce(f"m_{v}", zero)) > tol for v in volumes)
    added = {
        "QC-002": count("n"), "QC-005": one(in_monthly), "QC-006": count("dup"), "QC-007": one(whole & (F.col("place") == 2)),
        "QC-014": one(~in_monthly), "QC-015": one(~in_daily), "QC-016": one(off), **{c: count(a) for a, c in names.items()},
    }
    dated = F.make_date("year", "month", F.lit(1))
    held = both.select("entity", dated.alias("month"), (in_daily & first).alias("held"), *[F.coalesce(v.cast("long"), F.lit(0)).alias(c) for c, v in added.items()])
    return held, list(added)


def by_month(rows: DataFrame) -> DataFrame:
    """The sums of all columns by calendar month."""
    return rows.groupBy("month").agg(*[F.sum(f"`{c}`").alias(c) for c in rows.columns if c != "month"])


def month_counts(
    raw_daily: DataFrame, fact: DataFrame, dim: DataFrame, raw_monthly: DataFrame, monthly: DataFrame,
    rules: ReviewRules, tolerance: float = 1e-6, raw_day: str | None = None,
) -> DataFrame:
    """One row per calendar month with what it adds to each of the 27 checks; `starts` counts the entities that begin in it.

    What belongs to no month, such as the identifier checks, is in the row whose month is NULL; so are raw rows, unless
    the date column of the daily ones is named (the monthly ones have year and month). Each of the four sources is read
    once, and an entity holds one row per calendar month when it meets its window and the dimension.
    """
    held, names = entity_months(fact, monthly, row_flags(fact, rules), tolerance)
    known = dim.select(F.col("entity").alias("_parent")).distinct()  # a repeated parent is no second row
    begin = F.min(F.when(F.col("held"), F.col("month"))).over(Window.partitionBy("entity"))
    held = held.withColumn("starts", F.when(F.col("held") & F.col("entity").isNotNull() & (F.col("month") == begin), 1).otherwise(0))
    held = held.join(known, F.col("entity") == F.col("_parent"), "left")
    lost = F.col("_parent").isNull() & F.col("entity").isNotNull()
    orphans = {"QC-008": "QC-002", "QC-009": "QC-005"}
    held = held.select("month", "starts", *[F.col(f"`{c}`") for c in names], *[F.when(lost, F.col(f"`{n}`")).otherwise(0).alias(c) for c, n in orphans.items()])
    undated = F.lit(None).cast("date")
    parts = [
        held,
        _identities(raw_daily, raw_monthly, undated if raw_day is None else F.trunc(raw_day, "MM"), undated if raw_day is None else F.make_date("year", "month", F.lit(1))),
        dim.agg(F.count("entity").alias("QC-003")).withColumn("month", undated),
    ]
    rows = by_month(parts[0]).unionByName(by_month(parts[1]), allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return rows.groupBy("month").agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in rows.columns if c != "month"])


def _identities(raw_daily: DataFrame, raw_monthly: DataFrame, daily_month: Column, monthly_month: Column) -> DataFrame:
    """Row counts and identifier checks of both raw sources, dealt to their months.

    Rows collapse to one per code, name and month first, and these to codes, names and months. A code has more than
    one name if its least and greatest name differ.
    """
    code, name = F.col("entity").cast("string"), F.col("entity_name").cast("string")
    entry = lambda kind, key, other, month: F.struct(F.lit(kind).alias("kind"), key.alias("key"), other.alias("other"), month.alias("month"))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("date")
    paired = lambda c: F.when(code.isNotNull() & name.isNotNull(), c)
    daily = raw_daily.withColumn("_month", daily_month).groupBy("entity", "entity_name", "_month").agg(F.count("*").alias("d"))
    daily = daily.select("d", F.lit(0).cast("long").alias("m"), F.inline(F.array(
        entry("code", code, paired(name), nothing), entry("name", name, paired(code), nothing), entry("month", none, none, F.col("_month")))))
    given = raw_monthly.withColumn("_month", monthly_month).groupBy("entity", "_month").agg(F.count("*").alias("m"))
    given = given.select(F.lit(0).cast("long").alias("d"), "m", F.inline(F.array(
        entry("code", code, none, nothing), entry("month", none, none, F.col("_month")))))
    per = daily.unionByName(given).groupBy("kind", "key", "month").agg(
        F.sum("d").alias("d"), F.sum("m").alias("m"), holds(F.min("other") != F.max("other")).alias("several"))
    is_ = lambda kind: F.col("kind") == kind
    code_known = is_("code") & F.col("key").isNotNull()
    rows = lambda c: F.when(is_("month"), F.col(c)).otherwise(0)
    one = lambda c: c.cast("long")
    return per.select(
        "month", rows("d").alias("QC-001"), rows("m").alias("QC-004"),
        one(is_("code") & F.col("several")).alias("QC-010"), one(is_("name") & F.col("several")).alias("QC-011"),
        one(code_known & (F.col("d") > 0) & (F.col("m") == 0)).alias("QC-012"),
        one(code_known & (F.col("d") == 0) & (F.col("m") > 0)).alias("QC-013"),
    )


def month_totals(months: DataFrame, drifting: list[str]) -> DataFrame:
    """(check_id, actual, before): each check over all months, and the populations as of the last month but one.

    `before` is what a run would have counted that had everything except the last month; NULL for checks that do not
    compare with an earlier run.
    """
    ids = [c for c in months.columns if c not in ("month", "starts")]
    # entities are those of the dimension; those that had begun before are known by their first month
    source = lambda c: "starts" if c == "QC-003" and "starts" in months.columns else f"`{c}`"
    zero = F.lit(0).cast("long")
    before = {c: F.coalesce(F.sum(source(c)), zero) - F.coalesce(F.max_by(source(c), "month"), zero) for c in drifting}
    one = months.agg(
        *[F.coalesce(F.sum(f"`{c}`"), zero).alias(f"a{i}") for i, c in enumerate(ids)], *[before[c].alias(f"b{i}") for i, c in enumerate(ids) if c in before])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("check_id"), F.col(f"a{i}").alias("actual"), (F.col(f"b{i}") if c in before else F.lit(None).cast("long")).alias("before"))
        for i, c in enumerate(ids)])))


def evaluate(spark: SparkSession, checks: list[Check], counts: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Join counts to check definitions (a few dozen rows) and give each a status.

    With a ``prior`` (check_id, actual: a row a check) or a column ``before`` of the counts, checks of a count or a known
    population expect what the prior run counted, within their drift; where it counted nothing of the kind, expected is NULL and the status REVIEW.
    """
    rows = [
        (i, c.check_id, c.category, c.check_name, c.kind, c.expected, c.hard, c.drift) for i, c in enumerate(checks, 1)
    ]
    defs = spark.createDataFrame(
        rows, "sort_order int, check_id string, category string, check_name string, kind string, want long, hard boolean, drift double"
    )
    # one row per check on each side
    met_by = F.broadcast(defs).join(counts, "check_id")
    if prior is not None:
        before = prior.select("check_id", F.col("actual").cast("long").alias("before"))
        met_by = met_by.drop("before").join(F.broadcast(before), "check_id", "left")
    if prior is not None or "before" in counts.columns:
        met_by = met_by.withColumn("want", F.when(F.col("kind") == ZERO, F.col("want")).otherwise(F.col("before")))
    met = F.abs(F.col("actual") - F.col("want")) <= F.floor(F.col("drift") * F.col("want"))
    status = (
        F.when(F.col("want").isNull(), "REVIEW")
        .when(F.col("kind") == KNOWN, F.when(met, "REVIEW").otherwise("FAIL"))
        .when(met, "PASS")
        .when(F.col("hard"), "FAIL")
        .otherwise("REVIEW")
    )
    return met_by.select(
        "sort_order", "check_id", "category", "check_name",
        F.col("want").cast("string").alias("expected"),
        F.col("actual").cast("string").alias("actual"),
        status.alias("status"),
    ).orderBy("sort_order")


def run_checks(
    raw_daily: DataFrame, fact: DataFrame, dim: DataFrame, raw_monthly: DataFrame, monthly: DataFrame,
    rules: ReviewRules, expected: Expected | None = None, tolerance: float = 1e-6,
    prior: DataFrame | None = None, drift: float = 0.0, raw_day: str | None = None,
) -> DataFrame:
    """The 27 checks. Each source is read once, and all checks come from one table of calendar months.

    Sizes are compared with ``expected``; with what a ``prior`` run counted (check_id, actual), within the share
    ``drift``; or, if ``raw_day`` names the date column of the raw daily rows, with the run that would have followed the
    last month but one, within that share. One of the three is needed.
    """
    if sum(given is not None for given in (expected, prior, raw_day)) != 1:
        raise ValueError("Give either expected sizes, a prior run, or the date column of the raw rows")
    standard = standard_checks(expected or Expected())
    months = month_counts(raw_daily, fact, dim, raw_monthly, monthly, rules, tolerance, raw_day)
    counts = month_totals(months, [c.check_id for c in standard if c.kind != ZERO])
    checks = [c if c.kind == ZERO else replace(c, drift=drift) for c in standard]
    return evaluate(fact.sparkSession, checks, counts if raw_day else counts.drop("before"), prior)


def rollup(results: DataFrame) -> DataFrame:
    """One row: totals by status and the overall status."""
    by = {s: count_where(F.col("status") == s) for s in ("PASS", "REVIEW", "FAIL")}
    overall = F.when(F.col("fail_count") > 0, "FAIL").when(F.col("review_count") > 0, "PASS WITH REVIEW").otherwise("PASS")
    return results.agg(
        F.count("*").alias("total_checks"), by["PASS"].alias("pass_count"),
        by["REVIEW"].alias("review_count"), by["FAIL"].alias("fail_count"),
    ).withColumn("overall_status", overall)
