"""Raw -> core load: stage, validate, then publish by recording the version.

A run writes only under its own folders. Readers see a run once its row is in the
version log, so a failed or lost run changes nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from prodseries.functions.expr import any_of, holds
from prodseries.operators.checks import ReviewRules, keyed_counts, long_counts
from prodseries.operators.history import issue_conditions
from prodseries.sources.extracts import LoadError, exact_number, narrowed, read_daily, read_monthly
from prodseries.sources.versions import VersionLog
from prodseries.spec import EXACT, MEASURE, MODES, STATES, SeriesSpec, exactly

# Columns of the core tables, and how monthly measures are named there.
WELLBORE = (
    "npd_well_bore_code", "npd_well_bore_name", "well_bore_code",
    "npd_field_code", "npd_field_name", "npd_facility_code", "npd_facility_name",
)
DAILY = (
    "npd_well_bore_code", "production_date", "well_type", "flow_kind", "on_stream_hrs",
    "avg_downhole_pressure", "avg_downhole_temperature", "avg_dp_tubing", "avg_annulus_press",
    "avg_choke_size_p", "avg_choke_uom", "avg_whp_p", "avg_wht_p", "dp_choke_size",
    "bore_oil_vol", "bore_gas_vol", "bore_wat_vol", "bore_wi_vol",
)
NON_NEGATIVE = (
    "on_stream_hrs", "avg_downhole_pressure", "avg_downhole_temperature", "avg_dp_tubing", "avg_annulus_press",
    "avg_choke_size_p", "avg_whp_p", "avg_wht_p", "dp_choke_size", "bore_oil_vol", "bore_gas_vol", "bore_wi_vol",
)
MONTHLY_KEYS = ("npdcode", "year", "month")
MONTHLY_MEASURES = {
    "on_stream": "on_stream_hrs", "oil": "oil_vol", "gas": "gas_vol",
    "water": "water_vol", "gi": "gas_injection_vol", "wi": "water_injection_vol",
}


def build_wellbore(raw_daily: DataFrame) -> DataFrame:
    """Distinct attribute sets; a second set for a code is caught by the key check."""
    return raw_daily.where(F.col("npd_well_bore_code").isNotNull()).select(*WELLBORE).distinct()


def build_daily(raw_daily: DataFrame, measure: T.DecimalType = MEASURE) -> DataFrame:
    """Rename and type: no row is filtered, so a bad row fails the constraints instead."""
    rows = raw_daily.withColumnRenamed("dateprd", "production_date").select(*DAILY)
    return narrowed(rows, [c for c in DAILY if c.startswith(("avg_", "bore_", "dp_", "on_")) and c != "avg_choke_uom"], measure)


def _unkeyed():
    return any_of(F.col(k).isNull() for k in MONTHLY_KEYS)


def _unreadable(measure: T.DecimalType = MEASURE):
    """Text that is no number, or one that the measure type does not hold exactly."""
    wide, typed = (lambda c: F.col(c).try_cast(EXACT)), (lambda c: F.col(c).try_cast(measure))
    return any_of(F.col(c).isNotNull() & ~F.coalesce(wide(c) == typed(c), F.lit(False)) for c in MONTHLY_MEASURES)


def build_monthly(raw_monthly: DataFrame, quarantine: bool = False, measure: T.DecimalType = MEASURE) -> DataFrame:
    """Keyed rows with text measures as numbers. Text that is no number, or has too many decimals,
    stops the load; with ``quarantine`` such rows are set aside instead."""
    keyed = raw_monthly.where(~_unkeyed())
    if quarantine:
        keyed = keyed.where(~_unreadable(measure))
    return keyed.select(
        F.col("npdcode").alias("npd_well_bore_code"),
        F.col("year").alias("reference_year"),
        F.col("month").alias("reference_month"),
        *[exactly(exact_number(F.col(c), T.StringType()), EXACT, measure).alias(name) for c, name in MONTHLY_MEASURES.items()],
    )


def excluded_monthly(raw_monthly: DataFrame, quarantine: bool = False, measure: T.DecimalType = MEASURE) -> DataFrame:
    """Rows left out of core, unchanged, with the reason."""
    reason = F.when(_unkeyed(), "monthly key is incomplete")
    if quarantine:
        reason = reason.when(_unreadable(measure), "measure is not a number")
    return raw_monthly.withColumn("reason", reason).where(F.col("reason").isNotNull())


def core_violations(core: dict[str, DataFrame]) -> DataFrame:
    """Violation count per constraint of the three core tables."""
    counts = core_counts(core).where(~F.col("check_id").endswith(ROWS) & (F.col("check_id") != ENTITIES))
    return counts.withColumnsRenamed({"check_id": "constraint_name", "actual": "violations"})


#: What the row counts of core_counts() end in, its count of the entities that have daily rows, and the columns of the
#: daily core table that the rules of the known issues call by their roles.
ROWS, ENTITIES = ": rows", "daily_production: entities"
ROLES = {"day": "production_date", "hours": "on_stream_hrs", "water": "bore_wat_vol", "injection": "bore_wi_vol"}


def core_counts(core: dict[str, DataFrame], rules: ReviewRules | None = None) -> DataFrame:
    """(check_id, actual): rows and violations of each constraint, one chain of aggregates and one scan per table.

    With ``rules``, the records of each known issue are counted in the same chain, under the id of the issue.
    """
    w, d, m = core["wellbore"], core["daily_production"], core["monthly_reference"]
    parent = w.select(F.col("npd_well_bore_code").alias("entity"))
    null = lambda cols: any_of(F.col(c).isNull() for c in cols)

    unique = ("npd_well_bore_code", "npd_well_bore_name", "well_bore_code")
    keys = w.select(null(WELLBORE).alias("bad"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in unique
    ]))).groupBy("kind", "key").agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
    shared = F.col("key").isNotNull() & (F.col("n") > 1)
    wellbore = keys.agg(
        *[F.count(F.when((F.col("kind") == c) & shared, 1)).alias(f"wellbore: unique {c}") for c in unique],
        F.coalesce(F.sum(F.when(F.col("kind") == unique[0], F.col("bad"))), F.lit(0)).alias("wellbore: not null"),
        F.coalesce(F.sum(F.when(F.col("kind") == unique[0], F.col("n"))), F.lit(0)).alias("wellbore" + ROWS),
    )

    name = "daily_production: "
    entities = d.withColumnRenamed("npd_well_bore_code", "entity")
    issues = {}
    if rules is not None:
        entities, issues = entities.withColumns({r: F.col(c) for r, c in ROLES.items()}), issue_conditions(rules)
    daily = keyed_counts(
        entities, ["entity", "production_date"],
        {
            **issues,
            name + "not null": null(["entity", "production_date", "well_type", "flow_kind"]),
            name + "well_type": ~F.col("well_type").isin(*STATES),
            name + "flow_kind": ~F.col("flow_kind").isin(*MODES),
            name + "avg_choke_uom": F.col("avg_choke_uom") != "%",
            name + "non-negative": any_of(holds(F.col(c) < 0) for c in NON_NEGATIVE),
        },
        parent, "daily_production" + ROWS, name + "unique key", name + "known wellbore", ENTITIES,
    )
    name = "monthly_reference: "
    month = ["entity", "reference_year", "reference_month"]
    monthly = keyed_counts(
        m.withColumnRenamed("npd_well_bore_code", "entity"), month,
        {name + "not null": null(month), name + "month 1-12": ~F.col("reference_month").between(1, 12)},
        parent, "monthly_reference" + ROWS, name + "unique key", name + "known wellbore",
    )
    parts = [long_counts(p) for p in (wellbore, daily, monthly)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@dataclass(frozen=True)
class Snapshot:
    """Documented size of the snapshot being loaded; None takes the source as it is: its rows, and the entities that
    have any."""

    daily_rows: int | None = None
    wellbores: int | None = None


def load_counts(raw: dict[str, DataFrame], core: dict[str, DataFrame]) -> DataFrame:
    """Row counts per target, one row."""
    monthly = raw["monthly"]
    parts = [core[k].agg(F.count("*").alias(k)) for k in ("wellbore", "daily_production", "monthly_reference")]
    excluded = F.count(F.when(_unkeyed() | _unreadable(), 1))
    parts.insert(2, monthly.agg(F.count("*").alias("raw_monthly_rows"), excluded.alias("excluded_monthly_rows")))
    counts = None
    for one in parts:
        rows = one.unpivot([], one.columns, "target", "row_count")
        counts = rows if counts is None else counts.unionByName(rows)
    return counts


def validate_load(
    source: dict[str, DataFrame], raw: dict[str, DataFrame], core: dict[str, DataFrame], snapshot: Snapshot
) -> DataFrame:
    """The eight post-load checks. All are evaluated before any failure is raised."""
    def numbers(df, **aggs):
        row = df.agg(*[a.cast("decimal(38,6)").alias(k) for k, a in aggs.items()])
        return row.unpivot([], [F.col(k) for k in aggs], "k", "v")

    n = F.count("*")
    d, m = core["daily_production"], core["monthly_reference"]
    parent = core["wellbore"].select(F.col("npd_well_bore_code").alias("entity"))
    keys = d.withColumnRenamed("npd_well_bore_code", "entity")
    keyed = keyed_counts(keys, ["entity", "production_date"], {}, parent, "core_daily", "duplicates", "orphans", "entities")
    parts = [
        numbers(source["daily"], source_daily=n),
        numbers(source["monthly"], source_monthly=n),
        numbers(raw["daily"], raw_daily=n, **_sums("r")),
        numbers(raw["monthly"], raw_monthly=n, excluded=F.count(F.when(_unkeyed() | _unreadable(), 1))),
        numbers(d, **_sums("c")),
        numbers(core["wellbore"], wellbores=n),
        numbers(m, core_monthly=n),
        # rows, keys and entities in one chain: however many rows an entity has, one row meets the parent
        numbers(keyed, **{k: F.max(k) for k in keyed.columns}),
    ]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return _checked(long.groupBy().agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in NUMBERS]), snapshot)


#: What the post-load checks compare; r0-r3 and c0-c3 are the sums of VOLUMES in raw and core.
NUMBERS = ("source_daily", "source_monthly", "raw_daily", "raw_monthly", "excluded", "core_daily", "wellbores",
           "core_monthly", "duplicates", "orphans", "entities", *[f"r{i}" for i in range(4)], *[f"c{i}" for i in range(4)])
VOLUMES = ("bore_oil_vol", "bore_gas_vol", "bore_wat_vol", "bore_wi_vol")


def _sums(prefix: str) -> dict[str, F.Column]:
    return {f"{prefix}{i}": F.sum(v) for i, v in enumerate(VOLUMES)}


def _checked(row: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The eight checks on one row of NUMBERS."""
    c = F.col
    whole = lambda x: x.cast("long").cast("string")
    want_daily = F.lit(snapshot.daily_rows) if snapshot.daily_rows is not None else c("source_daily")
    want_wells = F.lit(snapshot.wellbores) if snapshot.wellbores is not None else c("entities")
    same = c("r0").eqNullSafe(c("c0"))
    for i in range(1, 4):
        same = same & c(f"r{i}").eqNullSafe(c(f"c{i}"))
    vs = lambda a, b: F.concat(whole(a), F.lit(" vs "), whole(b))
    listing = lambda p: F.concat_ws(", ", *[F.coalesce(c(f"{p}{i}").cast("string"), F.lit("NULL")) for i in range(4)])
    checks = [
        ("raw daily rows = source daily rows", c("raw_daily") == c("source_daily"), vs(c("raw_daily"), c("source_daily"))),
        ("core daily rows as expected", c("core_daily") == want_daily, vs(c("core_daily"), want_daily)),
        ("core wellbores as expected", c("wellbores") == want_wells, vs(c("wellbores"), want_wells)),
        ("core daily key is unique", c("duplicates") == 0, whole(c("duplicates"))),
        ("every core daily row has a wellbore", c("orphans") == 0, whole(c("orphans"))),
        ("raw monthly rows = source monthly rows", c("raw_monthly") == c("source_monthly"), vs(c("raw_monthly"), c("source_monthly"))),
        ("core monthly rows = raw monthly rows - excluded", c("core_monthly") == c("raw_monthly") - c("excluded"),
         vs(c("core_monthly"), c("raw_monthly") - c("excluded"))),
        ("volume sums: raw = core", same, F.concat(F.lit("raw "), listing("r"), F.lit("; core "), listing("c"))),
    ]
    rows = [
        F.struct(F.lit(i).alias("check_order"), F.lit(name).alias("check_name"), ok.alias("passed"), detail.alias("detail"))
        for i, (name, ok, detail) in enumerate(checks, 1)
    ]
    return row.select(F.inline(F.array(*rows)))


def layout(out: str, run_id: str) -> dict[str, str]:
    return {
        "raw_daily": f"{out}/raw/{run_id}/daily_production_source",
        "raw_monthly": f"{out}/raw/{run_id}/monthly_production_source",
        "wellbore": f"{out}/core/{run_id}/wellbore",
        "daily_production": f"{out}/core/{run_id}/daily_production",
        "monthly_reference": f"{out}/core/{run_id}/monthly_reference",
        "quarantine": f"{out}/core/{run_id}/monthly_quarantine",
        "versions": f"{out}/versions",
    }


def load(
    spark: SparkSession, daily_path: str, monthly_path: str, out: str,
    snapshot: Snapshot = Snapshot(), fmt: str = "csv", quarantine: bool = False, measure: T.DecimalType = MEASURE,
    rules: ReviewRules = ReviewRules(),
) -> dict[str, int]:
    """Run the whole load and return row counts per target, or raise LoadError and publish nothing.

    The published entry keeps the populations of the run: rows, entities, and records of each known issue by ``rules``;
    history() and prior() read them.

    What is counted and summed of source and core rows is observed while they are written. Read again are the row
    counts of raw (from its footers), and core once, for keys, parents and constraints.
    """
    run_id = uuid.uuid4().hex
    at = layout(out, run_id)
    seen = {k: Observation(k) for k in ("daily", "monthly", "core")}
    n = F.count("*").alias("n")
    unkeyed = F.count(F.when(_unkeyed() | _unreadable(), 1))
    sums = lambda p: [a.alias(k) for k, a in _sums(p).items()]
    read_daily(spark, daily_path, fmt).observe(seen["daily"], n, *sums("r")).write.parquet(at["raw_daily"])
    read_monthly(spark, monthly_path, fmt).observe(seen["monthly"], n, unkeyed.alias("excluded")).write.parquet(at["raw_monthly"])
    raw = {"daily": spark.read.parquet(at["raw_daily"]), "monthly": spark.read.parquet(at["raw_monthly"])}

    commented(build_wellbore(raw["daily"])).write.parquet(at["wellbore"])
    # clustered by year, then entity: date filters prune folders, entity filters prune row groups
    daily = commented(build_daily(raw["daily"], measure)).withColumn("production_year", F.year("production_date"))
    (
        daily.repartitionByRange("production_year", "npd_well_bore_code", "production_date")
        .sortWithinPartitions("production_year", "npd_well_bore_code", "production_date")
        .observe(seen["core"], *sums("c"))  # above the exchange, whose sampling runs what is below it once more
        .write.partitionBy("production_year").parquet(at["daily_production"])
    )
    build_monthly(raw["monthly"], quarantine, measure).write.parquet(at["monthly_reference"])
    excluded_monthly(raw["monthly"], quarantine, measure).write.parquet(at["quarantine"])
    core = {k: spark.read.parquet(at[k]) for k in ("wellbore", "daily_production", "monthly_reference")}

    counts = {r.check_id: r.actual for r in core_counts(core, rules).collect()}  # a row a constraint or issue
    source = {k: seen[k].get for k in ("daily", "monthly", "core")}
    numbers = {
        "source_daily": source["daily"]["n"], "source_monthly": source["monthly"]["n"],
        "raw_daily": raw["daily"].count(), "raw_monthly": raw["monthly"].count(), "excluded": source["monthly"]["excluded"],
        "core_daily": counts["daily_production" + ROWS], "wellbores": counts["wellbore" + ROWS], "core_monthly": counts["monthly_reference" + ROWS],
        "duplicates": counts["daily_production: unique key"], "orphans": counts["daily_production: known wellbore"],
        "entities": counts[ENTITIES],
        **{k: source["daily"][k] for k in _sums("r")}, **{k: source["core"][k] for k in _sums("c")},
    }
    typed = T.StructType([T.StructField(k, T.DecimalType(38, 6)) for k in NUMBERS])
    exact = [None if numbers[k] is None else Decimal(numbers[k]) for k in NUMBERS]
    failed = [r.check_name for r in _checked(spark.createDataFrame([exact], typed), snapshot).where(~F.col("passed")).collect()]
    known = issue_conditions(rules)
    failed += [k for k, v in counts.items() if not k.endswith(ROWS) and k != ENTITIES and k not in known and v > 0]
    if failed:
        raise LoadError(f"Validation failed: {failed}")
    sizes = {"QC-001": "raw_daily", "QC-002": "core_daily", "QC-003": "wellbores", "QC-004": "raw_monthly", "QC-005": "core_monthly"}
    publish(spark, out, run_id, {k: int(numbers[n]) for k, n in sizes.items()} | {k: int(counts[k]) for k in known})
    return {
        "wellbore": numbers["wellbores"], "daily_production": numbers["core_daily"], "raw_monthly_rows": numbers["raw_monthly"],
        "excluded_monthly_rows": numbers["excluded"], "monthly_reference": numbers["core_monthly"],
    }


def commented(df: DataFrame) -> DataFrame:
    """Attach the column comments; Parquet keeps them with the table."""
    notes = SeriesSpec().comments()
    return df.select(*[
        F.col(c).alias(c, metadata={"comment": notes[c]}) if c in notes else F.col(c) for c in df.columns
    ])


def publish(spark: SparkSession, out: str, run_id: str, counts: dict[str, int] | None = None) -> int:
    """Make the run the one that readers see; returns its number. Of two at the same time, one gets the next number.

    ``counts`` (check id -> count) become the run's part of the history: a run and its counts appear together or not.
    """
    return VersionLog(spark, layout(out, run_id)["versions"]).append(lambda seen: {"run_id": run_id, "counts": counts or {}})


def history(spark: SparkSession, out: str) -> DataFrame:
    """(run, run_id, check_id, actual) of every published run, oldest first; a dozen rows a run."""
    log = VersionLog(spark, f"{out}/versions").entries()
    rows = [(n, e["run_id"], k, v) for n, e in log for k, v in sorted(e.get("counts", {}).items())]
    return spark.createDataFrame(rows, "run int, run_id string, check_id string, actual long")


def prior(spark: SparkSession, out: str, run: int | None = None) -> DataFrame:
    """(check_id, actual) of the run before the given number, by default before the current one.

    Runs published without counts are passed over; without any earlier run the result is empty.
    """
    log = VersionLog(spark, f"{out}/versions").entries()
    last = run if run is not None else max((n for n, _ in log), default=0)
    earlier = [e["counts"] for n, e in log if n < last and e.get("counts")]
    return spark.createDataFrame(sorted(earlier[-1].items()) if earlier else [], "check_id string, actual long")


def current_run(spark: SparkSession, out: str) -> str:
    """The run with the largest number."""
    seen = VersionLog(spark, f"{out}/versions").entries()
    if not seen:
        raise LoadError(f"Nothing has been published at {out}")
    return seen[-1][1]["run_id"]


def core_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The published core tables."""
    at = layout(out, current_run(spark, out))
    names = ("wellbore", "daily_production", "monthly_reference", "quarantine")
    return {k: spark.read.parquet(at[k]) for k in names}


def create_layers(spark: SparkSession, layers=("raw", "core", "analytics")) -> list[str]:
    """Create the three databases if they are missing; returns those that exist after."""
    for name in layers:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    return [name for name in layers if spark.catalog.databaseExists(name)]
