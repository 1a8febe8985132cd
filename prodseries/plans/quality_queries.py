"""Profiling, temporal, missingness, category and measurement quality on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prodseries.operators import categories as cat, measures as ms, missingness as mis, profile as pf, temporal as tm
from prodseries.plans.load_queries import CONDS, RAWD, RULES, raw_pairs
from prodseries.plans.sql import POS, POS_ANY, dec, pct, query, ratio, rratio, tot
from prodseries.sources.driver_tables import daily_fact as F_, dimension as D_, raw_daily, raw_monthly, table

FACT_COLUMNS = ["entity", "day", "state", "mode", "hours", "oil", "gas", "water", "injection", "downhole", "wellhead"]
MEASURES = FACT_COLUMNS[4:]
FLUIDS = ["oil", "gas", "water", "injection"]
VOLUMES = FLUIDS[:3]
SENSORS = ["downhole", "wellhead"]
TEXTS = ["on_stream", "oil", "gas", "water", "gi", "wi"]
STRUCTURAL = ("entity", "day", "state", "mode")
FLOORS = [0, 10, 25, 50]


def lines(s, d):
    """Raw order lines with the key of the daily series: many lines share a key."""
    return table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("day"), "l_returnflag", "l_quantity"
    )


def date_text(s, d):
    """Month of each raw monthly row as date text; the stray row's unit word is not a date."""
    text = F.coalesce(F.concat_ws("-", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"), F.lit("01")), F.lit(""))
    return raw_monthly(s, d).select(F.when(F.col("year").isNotNull(), text).otherwise(F.col("on_stream")).alias("month_text"))


def pair_columns(s, d):
    return raw_pairs(s, d)


PAIRS = [("entity", "entity_name"), ("entity_name", "entity"), ("well_bore_code", "entity"), ("entity", "well_bore_code")]
ATTRS = [("npd_field_code", "npd_field_name"), ("npd_field_name", "npd_field_code"),
         ("npd_facility_code", "npd_facility_name"), ("npd_facility_name", "npd_facility_code"),
         ("npd_field_name", "npd_facility_name"), ("npd_facility_name", "npd_field_name")]
IDS = ["entity", "entity_name", "well_bore_code"]


def union(*dfs):
    out = dfs[0]
    for x in dfs[1:]:
        out = out.unionByName(x)
    return out


QUERIES = {
    # profiling
    "pf_shape": lambda s, d: pf.shape(F_(s, d), "daily"),
    "pf_dates": lambda s, d: tm.date_integrity(date_text(s, d), "month_text"),
    "pf_identifier": lambda s, d: pf.mapping_check(raw_pairs(s, d), "entity", "entity_name"),
    "pf_categorical": lambda s, d: union(*[cat.inventory(F_(s, d), c) for c in ("state", "mode")]),
    "pf_category_nulls": lambda s, d: cat.inventory(raw_monthly(s, d), "year"),
    "pf_state_stability": lambda s, d: pf.stability(F_(s, d), "entity", "state"),
    "pf_missingness": lambda s, d: mis.overview(F_(s, d), FACT_COLUMNS),
    "pf_missingness_monthly": lambda s, d: mis.overview(raw_monthly(s, d)),
    "pf_grain": lambda s, d: pf.grain_summary(F_(s, d), ["entity", "day"]),
    "pf_duplicate_rows": lambda s, d: pf.duplicate_rows(lines(s, d), ["entity", "day"]),
    "pf_numeric": lambda s, d: pf.numeric(F_(s, d), MEASURES),
    "pf_describe": lambda s, d: pf.describe(F_(s, d), MEASURES),
    "pf_monthly": lambda s, d: pf.monthly_summary(raw_monthly(s, d)),
    "pf_run_summary": lambda s, d: pf.summary(F_(s, d), raw_monthly(s, d)),
    "pf_recon": lambda s, d: pf.recon(raw_pairs(s, d), IDS),
    "pf_source_overlap": lambda s, d: pf.source_overlap(F_(s, d), raw_monthly(s, d), "entity"),
    # grain, identity, schema
    "nq_type_drift": lambda s, d: pf.type_drift(raw_monthly(s, d), TEXTS),
    "nq_grain": lambda s, d: pf.grain(lines(s, d), ["entity", "day"]),
    "nq_grain_monthly": lambda s, d: pf.grain(raw_monthly(s, d), ["entity", "year", "month"]),
    "nq_exact_duplicates": lambda s, d: pf.exact_duplicates(lines(s, d)),
    "nq_identifiers": lambda s, d: pf.identifiers(raw_pairs(s, d), IDS),
    "nq_identifier_mappings": lambda s, d: pf.mapping_violations(raw_pairs(s, d), PAIRS),
    "nq_identifier_verdict": lambda s, d: pf.identifier_verdict(raw_pairs(s, d), IDS, PAIRS),
    "nq_crosswalk": lambda s, d: pf.crosswalk(raw_pairs(s, d), IDS),
    "nq_cross_source": lambda s, d: pf.cross_source(raw_pairs(s, d), raw_monthly(s, d)),
    "nq_cross_source_summary": lambda s, d: pf.cross_source_summary(raw_pairs(s, d), raw_monthly(s, d)),
    "nq_attribute_mappings": lambda s, d: pf.mapping_violations(raw_pairs(s, d), ATTRS),
    "nq_attribute_multi": lambda s, d: pf.mapping_detail(raw_pairs(s, d), "npd_facility_name", "npd_field_name"),
    "nq_attribute_expected": lambda s, d: pf.expected_pairs(raw_pairs(s, d), "npd_facility_code", "npd_facility_name", [(0, "AFRICA"), (1, "AMERICA")]),
    # temporal
    "nq_field_coverage": lambda s, d: tm.field_coverage(F_(s, d)),
    "nq_coverage": lambda s, d: tm.coverage(F_(s, d), D_(s, d)),
    "nq_gaps": lambda s, d: tm.coverage(F_(s, d), D_(s, d)).select("entity", "max_gap_days", "gaps_gt_1", "gaps_gt_7", "gaps_gt_30"),
    "nq_gap_list": lambda s, d: tm.gaps(F_(s, d), D_(s, d)),
    "nq_shared_gaps": lambda s, d: tm.shared_gaps(F_(s, d)),
    "nq_boundary": lambda s, d: tm.boundary(F_(s, d), RULES),
    "nq_boundary_rows": lambda s, d: tm.boundary_rows(F_(s, d), RULES),
    "nq_presence": lambda s, d: tm.presence(F_(s, d), D_(s, d)),
    "nq_presence_by_month": lambda s, d: tm.presence_by_month(F_(s, d)),
    "nq_temporal_verdict": lambda s, d: tm.temporal_verdict(F_(s, d), D_(s, d), RULES),
    # hours
    "nq_hours_buckets": lambda s, d: ms.hours_buckets(F_(s, d)),
    "nq_null_hours": lambda s, d: ms.null_hours_breakdown(F_(s, d)),
    "nq_null_hours_overlap": lambda s, d: ms.null_hours_overlap(F_(s, d), RULES),
    "nq_zero_hours_volumes": lambda s, d: ms.zero_hours_volumes(F_(s, d)),
    "nq_zero_hours_rows": lambda s, d: ms.zero_hours_rows(F_(s, d)),
    "nq_active_without_volume": lambda s, d: ms.active_without_volume(F_(s, d)),
    "nq_hours_distribution": lambda s, d: ms.distribution(F_(s, d), "hours"),
    "nq_hours_verdict": lambda s, d: ms.hours_verdict(F_(s, d)),
    "nq_population": lambda s, d: ms.characterise(F_(s, d), (F.col("hours").isNull()) | (F.col("day") < F.lit(RULES.window_start))),
    "nq_population_head": lambda s, d: pf.head_per_entity(F_(s, d).where(F.col("hours").isNull()).select("entity", "day", "state", "mode"), 10),
    "nq_clock_change": lambda s, d: ms.clock_change_checks(F_(s, d)),
    "nq_clock_change_days": lambda s, d: ms.clock_change_days(F_(s, d)),
    # missingness
    "nq_missing_by_group": lambda s, d: mis.by_contexts(F_(s, d), MEASURES),
    "nq_missing_by_year": lambda s, d: mis.by_group(F_(s, d), MEASURES, "year"),
    "nq_missing_by_combination": lambda s, d: mis.by_combination(F_(s, d), MEASURES),
    "nq_missing_class": lambda s, d: mis.classification(F_(s, d), FACT_COLUMNS, STRUCTURAL),
    "nq_missing_pattern": lambda s, d: mis.patterns(F_(s, d), FACT_COLUMNS, {"hours": ("blank records", "DQ-003")}),
    "nq_separation": lambda s, d: mis.separation(F_(s, d), MEASURES),
    "nq_null_vs_zero": lambda s, d: ms.sign_counts(F_(s, d)),
    "nq_null_vs_zero_by_state": lambda s, d: ms.sign_counts(F_(s, d), ("injection",), ("state",)),
    # categories
    "nq_category_inventory": lambda s, d: cat.inventory(table(s, d, "events"), "event_type"),
    "nq_normalisation": lambda s, d: cat.normalisation(raw_pairs(s, d).withColumn("mixed", F.when(F.col("entity") % 2 == 0, F.lower("entity_name")).otherwise(F.concat(F.upper("well_type"), F.lit(" ")))), ["entity_name", "well_type", "mixed"]),
    "nq_category_spans": lambda s, d: cat.spans(F_(s, d), "state"),
    "nq_category_stability": lambda s, d: cat.stability(F_(s, d), "state"),
    "nq_transitions": lambda s, d: cat.transition_tally(F_(s, d), "state"),
    "nq_changes": lambda s, d: cat.changes(F_(s, d), "mode"),
    "nq_contingency": lambda s, d: cat.contingency(F_(s, d), "state", "mode"),
    "nq_activity": lambda s, d: cat.activity(F_(s, d)),
    "nq_attribute_classes": lambda s, d: cat.attribute_classes(raw_daily(s, d).select(
        F.col("npd_well_bore_code").alias("entity"), F.col("dateprd").alias("day"), F.col("well_type").alias("state"),
        F.col("flow_kind").alias("mode"), F.col("npd_field_name").alias("group_name"), "avg_choke_uom"),
        ("state", "mode", "group_name"), ("avg_choke_uom", "group_name")),
    # volumes
    "nq_negative_volumes": lambda s, d: ms.negative_volumes(F_(s, d)),
    "nq_volume_distribution": lambda s, d: union(*[ms.distribution(F_(s, d), c, {"median": 0.5, "p95": 0.95}) for c in VOLUMES]),
    "nq_contradictions": lambda s, d: ms.contradictions(F_(s, d)),
    "nq_contradiction_rows": lambda s, d: ms.contradiction_rows(F_(s, d)),
    "nq_rates": lambda s, d: ms.rate_overview(F_(s, d)),
    "nq_rate_by_entity": lambda s, d: ms.rate_by_entity(F_(s, d), "oil"),
    "nq_injection_rate_by_entity": lambda s, d: ms.rate_by_entity(F_(s, d), "injection"),
    "nq_abrupt_changes": lambda s, d: ms.abrupt_changes(F_(s, d), VOLUMES),
    "nq_abrupt_listing": lambda s, d: ms.abrupt_listing(F_(s, d), D_(s, d), VOLUMES),
    "nq_abrupt_sensor_changes": lambda s, d: ms.abrupt_changes(F_(s, d), SENSORS, floor=50, guard="nonzero"),
    "nq_floor_sensitivity": lambda s, d: ms.floor_sensitivity(F_(s, d), [*FLUIDS, *SENSORS], FLOORS),
    "nq_largest_changes": lambda s, d: ms.largest_changes(F_(s, d), ["injection"], 15),
    "nq_transition_rows": lambda s, d: ms.transition_rows(F_(s, d)),
    "nq_transition_support": lambda s, d: ms.transition_support(F_(s, d)),
    "nq_injection_by_state": lambda s, d: ms.injection_by_state(F_(s, d)),
    "nq_magnitude_bins": lambda s, d: ms.magnitude_bins(F_(s, d)),
    "nq_large_idle_injection": lambda s, d: ms.large_idle_injection(F_(s, d), RULES.injection_floor),
    "nq_idle_rate": lambda s, d: ms.idle_rate(F_(s, d)),
    "nq_hours_by_activity": lambda s, d: ms.hours_by_activity(F_(s, d)),
    "nq_blank_records": lambda s, d: ms.blank_records(F_(s, d), RULES),
    # sensors
    "nq_sensor_validity": lambda s, d: ms.sensor_validity(F_(s, d), SENSORS),
    "nq_sensor_by_activity": lambda s, d: ms.sensor_by_activity(F_(s, d), SENSORS),
    "nq_sensor_relations": lambda s, d: ms.sensor_relations(F_(s, d), [("downhole", "wellhead")], SENSORS),
    "nq_sensor_relation_rows": lambda s, d: ms.sensor_relation_rows(F_(s, d), "downhole", "wellhead"),
    "nq_sensors_around_issues": lambda s, d: ms.sensors_around_issues(F_(s, d), RULES, SENSORS),
    "nq_choke": lambda s, d: ms.choke_ranges(F_(s, d), "wellhead"),
    "nq_correlation": lambda s, d: ms.choke_correlation(F_(s, d), "oil", "gas"),
    "nq_zero_agreement": lambda s, d: ms.zero_agreement(F_(s, d), "oil", "injection"),
}

# --- check SQL ---------------------------------------------------------------

TYPES = {"entity": "bigint", "day": "date", "state": "string", "mode": "string"}
RAW = {**RAWD, "rawn": "SELECT entity, npd_well_bore_name AS entity_name, well_bore_code, npd_field_code, npd_field_name, "
       "npd_facility_code, npd_facility_name, state AS well_type, mode AS flow_kind FROM rawd"}
LINES = {"li": "SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS day, l_returnflag, l_quantity FROM lineitem"}
BIG = lambda x: f"CAST({x} AS BIGINT)"
QC = lambda x, p: f"quantile_cont(CAST({x} AS DOUBLE), {p})"


def alls(parts):
    return " UNION ALL ".join(parts)


def miss(src, cols, group_cols="", group_sql=""):
    """Long missing counts of each column, optionally per group."""
    g = f"{group_sql}, " if group_sql else ""
    by = f" GROUP BY {group_cols}" if group_cols else ""
    return alls(
        f"SELECT {g}'{c}' AS \"column\", COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
        f"{rratio(f'COUNT(*) FILTER (WHERE {c} IS NULL)', 'COUNT(*)', 2, 100, even=True)} AS missing_pct FROM {src}{by}"
        for c in cols
    )


def numbers(src, cols, probs):
    quants = ", ".join(f"{dec(QC('v', p))} AS {k}" for k, p in probs.items())
    return alls(
        f"""SELECT '{c}' AS "column", COUNT(v) AS value_count, COUNT(*) FILTER (WHERE v IS NULL) AS missing_count,
        COUNT(*) FILTER (WHERE v = 0) AS zero_count, COUNT(*) FILTER (WHERE v < 0) AS negative_count,
        COUNT(*) FILTER (WHERE v > 0) AS positive_count, MIN(v) AS min, MAX(v) AS max, {ratio('SUM(v)', 'COUNT(v)')} AS mean, {quants}
        FROM (SELECT {c} AS v FROM {src})""" for c in cols
    )


def described(src, cols):
    return alls(
        f"""SELECT '{c}' AS "column", COUNT(v) AS value_count, CAST(AVG(v) AS DECIMAL(28,4)) AS mean,
        CAST(STDDEV_SAMP(v) AS DECIMAL(28,4)) AS std, {dec('MIN(v)')} AS min, {dec('MAX(v)')} AS max,
        {dec(QC('v', 0.25))} AS p25, {dec(QC('v', 0.5))} AS p50, {dec(QC('v', 0.75))} AS p75
        FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {src})""" for c in cols
    )


def dist(c, probs):
    quants = ", ".join(f"{dec(QC(c, p))} AS {k}" for k, p in probs.items())
    return f"""SELECT entity, '{c}' AS "column", COUNT({c}) AS value_count, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count,
        COUNT(*) FILTER (WHERE {c} = 0) AS zero_count, MIN({c}) AS min, MAX({c}) AS max, {ratio(f'SUM({c})', f'COUNT({c})')} AS mean,
        {tot(c)} AS total, {quants} FROM fact GROUP BY entity"""


def mapping(a, b):
    return f"SELECT {a} FROM rawn WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a} HAVING COUNT(DISTINCT {b}) > 1"


def mappings(pairs):
    return alls(f"SELECT '{a} -> {b}' AS mapping, COUNT(*) AS violations FROM ({mapping(a, b)})" for a, b in pairs)


IDENT = alls(
    f"""SELECT '{c}' AS "column", {BIG('COUNT(*) FILTER (WHERE v IS NULL)')} AS missing_values,
    {BIG('COUNT(*) FILTER (WHERE v <> trim(v))')} AS padded_values, COUNT(DISTINCT v) AS raw_distinct,
    COUNT(DISTINCT lower(trim(v))) AS normalised_distinct, COUNT(DISTINCT v) - COUNT(DISTINCT lower(trim(v))) AS collisions
    FROM (SELECT CAST({c} AS VARCHAR) AS v FROM rawn)""" for c in IDS
)


def grain_sql(src, keys, cols):
    k, null = ", ".join(keys), " OR ".join(f"{x} IS NULL" for x in keys)
    return {
        "contents": f"SELECT {', '.join(cols)}, COUNT(*) AS n FROM {src} GROUP BY ALL",
        "per_key": f"SELECT {k}, SUM(n) AS r, SUM(CASE WHEN n > 1 THEN n ELSE 0 END) AS e FROM contents GROUP BY {k}",
        "grained": f"""SELECT {BIG('SUM(r)')} AS total_rows, {BIG(f'coalesce(SUM(r) FILTER (WHERE {null}), 0)')} AS missing_key_rows,
            COUNT(*) FILTER (WHERE NOT ({null})) AS distinct_keys, COUNT(*) FILTER (WHERE r > 1 AND NOT ({null})) AS duplicated_keys,
            {BIG(f'coalesce(SUM(r) FILTER (WHERE r > 1 AND NOT ({null})), 0)')} AS duplicate_rows,
            {BIG(f'coalesce(SUM(e) FILTER (WHERE r > 1 AND NOT ({null})), 0)')} AS exact_duplicate_rows FROM per_key""",
    }


GRAIN_OUT = """SELECT *, duplicate_rows - exact_duplicate_rows AS conflicting_duplicate_rows,
    CASE WHEN duplicated_keys > 0 THEN 'NOT CONFIRMED' WHEN missing_key_rows > 0 THEN 'REQUIRES REVIEW' ELSE 'CONFIRMED' END AS verdict
    FROM grained"""
MONTHLY_COLS = ["entity_name", "entity", "year", "month", *TEXTS]
GAP = {
    "gapped": "SELECT entity, day, LAG(day) OVER (PARTITION BY entity ORDER BY day) AS previous_day FROM fact",
    "gap": "SELECT *, CAST(day - previous_day AS INTEGER) AS gap_days FROM gapped",
    "cov": f"""SELECT g.entity, entity_name, MIN(day) AS first_date, MAX(day) AS last_date,
        CAST(MAX(day) - MIN(day) + 1 AS INTEGER) AS calendar_span_days, COUNT(*) AS recorded_days,
        MAX(day) - MIN(day) + 1 - COUNT(*) AS unrecorded_calendar_days,
        {rratio('COUNT(*)', '(MAX(day) - MIN(day) + 1)', 2, 100, even=True)} AS coverage_pct, coalesce(MAX(gap_days), 0) AS max_gap_days,
        COUNT(*) FILTER (WHERE gap_days > 1) AS gaps_gt_1, COUNT(*) FILTER (WHERE gap_days > 7) AS gaps_gt_7,
        COUNT(*) FILTER (WHERE gap_days > 30) AS gaps_gt_30
        FROM gap g JOIN dim d ON d.entity = g.entity GROUP BY 1, 2""",
}
OUT_WINDOW = "(day < DATE '1995-07-01' OR day > DATE '2001-06-30')"
CHANGE = "make_date(year(day), 10, 31) - CAST(dayofweek(make_date(year(day), 10, 31)) AS INTEGER)"
CLOCK = {
    "clock": f"""SELECT day, COUNT(*) FILTER (WHERE hours > 24) AS over, COUNT(*) FILTER (WHERE hours = 25) AS exact,
        COUNT(*) AS reporting, day = {CHANGE} AS is_change FROM fact GROUP BY day HAVING COUNT(*) FILTER (WHERE hours > 24) > 0""",
    "clock1": """SELECT CAST(SUM(over) AS BIGINT) AS n_over, CAST(SUM(exact) AS BIGINT) AS n_exact, COUNT(*) AS n_days,
        COUNT(*) FILTER (WHERE is_change) AS n_change_days, COUNT(*) FILTER (WHERE over = reporting) AS n_uniform,
        CAST(coalesce(SUM(over) FILTER (WHERE NOT is_change), 0) AS BIGINT) AS n_elsewhere FROM clock""",
}
CTX = {"entity": "CAST(entity AS VARCHAR)", "year": "CAST(year(day) AS VARCHAR)", "state": "state", "mode": "mode",
       "hours_status": "CASE WHEN hours IS NULL THEN 'hours_missing' WHEN hours = 0 THEN 'inactive' ELSE 'active' END"}
SPREAD = {
    "tot_miss": miss("fact", FACT_COLUMNS),
    "st_miss": miss("fact", FACT_COLUMNS, "state", "state"),
    "md_miss": miss("fact", FACT_COLUMNS, "mode", "mode"),
    "spread": """SELECT t."column" AS c, t.missing_pct, t.missing_count,
        CAST(greatest((SELECT MAX(missing_pct) - MIN(missing_pct) FROM st_miss s WHERE s."column" = t."column"),
                 (SELECT MAX(missing_pct) - MIN(missing_pct) FROM md_miss m WHERE m."column" = t."column")) AS DECIMAL(28,2)) AS spread_pp
        FROM tot_miss t""",
    "en_miss": miss("fact", FACT_COLUMNS, "entity", "entity"),
    "yr_miss": miss("fact", FACT_COLUMNS, "year(day)", "year(day) AS yr"),
    "top2": """SELECT "column" AS c, SUM(missing_count) AS m2 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY missing_count DESC, entity) AS r
        FROM en_miss WHERE missing_count > 0) WHERE r <= 2 GROUP BY 1""",
    "top1": 'SELECT "column" AS c, MAX(missing_count) AS m1 FROM yr_miss GROUP BY 1',
}
FEW, ONE = "CAST(m2 AS DOUBLE) / missing_count > 0.7", "CAST(m1 AS DOUBLE) / missing_count > 0.5"
SIGNS = lambda c: f"""COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, COUNT(*) FILTER (WHERE {c} = 0) AS zero_count,
    COUNT(*) FILTER (WHERE {c} > 0) AS positive_count, COUNT(*) FILTER (WHERE {c} < 0) AS negative_count"""  # noqa: E731
MOVES = lambda c: f"""SELECT entity, day, {c} AS current, LAG({c}) OVER (PARTITION BY entity ORDER BY day) AS previous FROM fact"""
REP = "entity, day, state, mode, hours, oil, gas, water, injection"
INJ_ODD = "coalesce(injection > 0 AND (state = 'OP' OR mode = 'production'), false)"


def inv(src, c):
    return f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, COUNT(*) AS row_count,
        {rratio('COUNT(*)', f'(SELECT COUNT(*) FROM {src})', 2, 100, even=True)} AS pct FROM {src} GROUP BY {c}"""


RATES = {
    "rates": """SELECT entity, day, CASE WHEN hours > 0 THEN CAST(oil AS DOUBLE) / CAST(hours AS DOUBLE) END AS oil_rate,
        CASE WHEN hours > 0 THEN CAST(gas AS DOUBLE) / CAST(hours AS DOUBLE) END AS gas_rate,
        CASE WHEN hours > 0 THEN CAST(water AS DOUBLE) / CAST(hours AS DOUBLE) END AS water_rate,
        CASE WHEN hours > 0 AND injection > 0 THEN CAST(injection AS DOUBLE) / CAST(hours AS DOUBLE) END AS injection_rate FROM fact"""
}


def rate_by(c):
    return f"""SELECT entity, COUNT({c}_rate) AS value_count, CAST(AVG({c}_rate) AS DECIMAL(28,4)) AS mean,
        {dec(QC(c + '_rate', 0.5))} AS median, {dec(QC(c + '_rate', 0.95))} AS p95, {dec(f'MAX({c}_rate)')} AS max FROM rates GROUP BY entity"""


def change_cte(cols, guard):
    return {
        "chg": alls(
            f"""SELECT '{c}' AS "column", entity, LAG(day) OVER w AS previous_date, day AS "current_date",
            LAG({c}) OVER w AS previous_value, {c} AS current_value, hours, mode, state
            FROM fact WHERE {c} IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY day)""" for c in cols
        ),
        "diffs": f"""SELECT *, {dec('current_value - previous_value')} AS abs_change,
            CASE WHEN previous_value {guard} 0 THEN {pct('(current_value - previous_value)', 'previous_value')} END AS pct_change,
            previous_value {guard} 0 AS ok FROM chg WHERE previous_value IS NOT NULL""",
    }


BEYOND = "ok AND abs(abs_change) * 100 > abs(previous_value) * 200"

ORACLES = {
    "pf_shape": query(
        alls(
            f"SELECT 'daily' AS table_name, (SELECT COUNT(*) FROM fact) AS row_count, CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", "
            f"'{TYPES.get(c, 'decimal(18,6)')}' AS type" for i, c in enumerate(FACT_COLUMNS, 1)
        )),
    "pf_dates": query(
        """SELECT COUNT(*) AS total_rows, COUNT(TRY_CAST(t AS DATE)) AS parsed_rows, COUNT(*) FILTER (WHERE t IS NULL) AS missing_dates,
        COUNT(*) FILTER (WHERE t IS NOT NULL AND TRY_CAST(t AS DATE) IS NULL) AS invalid_dates,
        MIN(TRY_CAST(t AS DATE)) AS earliest_date, MAX(TRY_CAST(t AS DATE)) AS latest_date
        FROM (SELECT CASE WHEN year IS NOT NULL THEN year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '-01' ELSE on_stream END AS t FROM raw_monthly)"""),
    "pf_identifier": query(
        """SELECT a.*, c.n AS distinct_count FROM (SELECT DISTINCT entity, entity_name FROM rawn WHERE entity IS NOT NULL) a
        JOIN (SELECT entity, COUNT(DISTINCT entity_name) AS n FROM rawn GROUP BY 1) c ON c.entity = a.entity""", RAW),
    "pf_categorical": query(alls([inv("fact", "state"), inv("fact", "mode")])),
    "pf_category_nulls": query(inv("raw_monthly", "year")),
    "pf_state_stability": query(
        "SELECT entity, COUNT(DISTINCT state) AS distinct_count FROM fact GROUP BY 1 HAVING COUNT(DISTINCT state) > 1"),
    "pf_missingness": query(
        f"SELECT *, total_rows - missing_count AS non_missing_count FROM m", {"m": miss("fact", FACT_COLUMNS)}),
    "pf_missingness_monthly": query(
        f"SELECT *, total_rows - missing_count AS non_missing_count FROM m", {"m": miss("raw_monthly", MONTHLY_COLS)}),
    "pf_grain": query(
        """SELECT duplicated_keys AS duplicated_combinations, duplicate_rows AS rows_involved_in_duplicates,
        duplicated_keys = 0 AS grain_is_unique FROM grained""", grain_sql("fact", ["entity", "day"], FACT_COLUMNS)),
    "pf_duplicate_rows": query(
        "SELECT * FROM li WHERE (entity, day) IN (SELECT (entity, day) FROM li GROUP BY entity, day HAVING COUNT(*) > 1)", LINES),
    "pf_numeric": query(numbers("fact", MEASURES, {"median": 0.5})),
    "pf_describe": query(described("fact", MEASURES)),
    "pf_monthly": query(
        f"""SELECT {BIG('COUNT(*)')} AS row_count, CAST(10 AS INTEGER) AS column_count, COUNT(DISTINCT entity) AS unique_entities,
        strftime(MIN(make_date(year, month, 1)), '%Y-%m') AS earliest_year_month, strftime(MAX(make_date(year, month, 1)), '%Y-%m') AS latest_year_month,
        (SELECT COUNT(*) FROM (SELECT entity, year, month FROM raw_monthly WHERE entity IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) > 1)) AS duplicated_combinations,
        {BIG('(SELECT coalesce(SUM(n), 0) FROM (SELECT COUNT(*) AS n FROM raw_monthly GROUP BY entity, year, month HAVING COUNT(*) > 1))')} AS rows_involved_in_duplicates,
        {BIG('COUNT(*) FILTER (WHERE entity IS NULL AND year IS NULL AND month IS NULL)')} AS rows_with_all_key_columns_null FROM raw_monthly"""),
    "pf_run_summary": query(
        """SELECT 'daily rows' AS metric, CAST(COUNT(*) AS VARCHAR) AS value FROM fact
        UNION ALL SELECT 'earliest date', CAST(MIN(day) AS VARCHAR) FROM fact UNION ALL SELECT 'latest date', CAST(MAX(day) AS VARCHAR) FROM fact
        UNION ALL SELECT 'entities', CAST(COUNT(DISTINCT entity) AS VARCHAR) FROM fact
        UNION ALL SELECT 'grain is unique', CASE WHEN COUNT(*) = COUNT(DISTINCT (entity, day)) THEN 'true' ELSE 'false' END FROM fact
        UNION ALL SELECT 'duplicate combinations', CAST(COUNT(*) AS VARCHAR) FROM (SELECT entity, day FROM fact GROUP BY 1, 2 HAVING COUNT(*) > 1)
        UNION ALL SELECT 'monthly rows', CAST(COUNT(*) AS VARCHAR) FROM raw_monthly
        UNION ALL SELECT 'monthly entities', CAST(COUNT(DISTINCT entity) AS VARCHAR) FROM raw_monthly
        UNION ALL SELECT 'monthly duplicate combinations', CAST(COUNT(*) AS VARCHAR)
            FROM (SELECT entity, year, month FROM raw_monthly WHERE entity IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) > 1)"""),
    "pf_recon": query(
        alls(
            f"""SELECT '{c}' AS "column", (SELECT COUNT(DISTINCT {c}) FROM rawn) AS distinct_values,
            (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM rawn WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS examples"""
            for c in IDS
        ), RAW),
    "pf_source_overlap": query(
        """SELECT COUNT(*) FILTER (WHERE l AND r) AS common, COUNT(*) FILTER (WHERE l AND NOT r) AS only_left, COUNT(*) FILTER (WHERE r AND NOT l) AS only_right
        FROM (SELECT a.entity IS NOT NULL AS l, b.entity IS NOT NULL AS r FROM (SELECT DISTINCT entity FROM fact) a
              FULL JOIN (SELECT DISTINCT entity FROM raw_monthly WHERE entity IS NOT NULL) b ON a.entity = b.entity)"""),
    "nq_type_drift": query(
        alls(
            f"""SELECT '{c}' AS "column", COUNT(TRY_CAST({c} AS DOUBLE)) AS numeric_values,
            COUNT(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) AS non_numeric_values,
            COUNT(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) <> floor(TRY_CAST({c} AS DOUBLE))) AS fractional_values FROM raw_monthly"""
            for c in TEXTS
        )),
    "nq_grain": query(GRAIN_OUT, {**LINES, **grain_sql("li", ["entity", "day"], ["entity", "day", "l_returnflag", "l_quantity"])}),
    "nq_grain_monthly": query(GRAIN_OUT, grain_sql("raw_monthly", ["entity", "year", "month"], MONTHLY_COLS)),
    "nq_exact_duplicates": query(
        f"SELECT {BIG('coalesce(SUM(n), 0)')} AS exact_duplicate_rows FROM (SELECT COUNT(*) AS n FROM li GROUP BY entity, day, l_returnflag, l_quantity) WHERE n > 1", LINES),
    "nq_identifiers": query(IDENT, RAW),
    "nq_identifier_mappings": query(mappings(PAIRS), RAW),
    "nq_identifier_verdict": query(
        f"""SELECT m AS missing_values, p AS padded_values, c AS collisions, v AS mapping_violations,
        CASE WHEN v > 0 THEN 'NOT CONFIRMED' WHEN m > 0 OR p > 0 OR c > 0 THEN 'REQUIRES REVIEW' ELSE 'CONFIRMED' END AS verdict
        FROM (SELECT {BIG('SUM(missing_values)')} AS m, {BIG('SUM(padded_values)')} AS p, {BIG('SUM(collisions)')} AS c,
              (SELECT {BIG('SUM(violations)')} FROM maps) AS v FROM ident)""", {**RAW, "ident": IDENT, "maps": mappings(PAIRS)}),
    "nq_crosswalk": query("SELECT DISTINCT entity, entity_name, well_bore_code FROM rawn", RAW),
    "nq_cross_source": query("SELECT * FROM xs", {**RAW, "xs": (XS := """
        SELECT coalesce(a.entity, b.entity) AS entity, BOOL_OR(a.entity IS NOT NULL) AS in_daily, BOOL_OR(b.entity IS NOT NULL) AS in_monthly,
            BOOL_AND(a.entity IS NOT NULL AND b.entity IS NOT NULL) AS names_match
        FROM (SELECT DISTINCT entity, entity_name FROM rawn WHERE entity IS NOT NULL) a
        FULL JOIN (SELECT DISTINCT entity, entity_name FROM raw_monthly WHERE entity IS NOT NULL) b
            ON a.entity = b.entity AND a.entity_name IS NOT DISTINCT FROM b.entity_name GROUP BY 1""")}),
    "nq_cross_source_summary": query(
        """SELECT *, CASE WHEN only_in_daily > 0 OR only_in_monthly > 0 THEN 'NOT CONFIRMED' WHEN naming_mismatches > 0 THEN 'REQUIRES REVIEW' ELSE 'CONFIRMED' END AS verdict
        FROM (SELECT COUNT(*) FILTER (WHERE in_daily) AS daily_codes, COUNT(*) FILTER (WHERE in_monthly) AS monthly_codes,
            COUNT(*) FILTER (WHERE in_daily AND in_monthly) AS common_codes, COUNT(*) FILTER (WHERE in_daily AND NOT in_monthly) AS only_in_daily,
            COUNT(*) FILTER (WHERE in_monthly AND NOT in_daily) AS only_in_monthly,
            COUNT(*) FILTER (WHERE in_daily AND in_monthly AND NOT names_match) AS naming_mismatches FROM xs)""", {**RAW, "xs": XS}),
    "nq_attribute_mappings": query(mappings(ATTRS), RAW),
    "nq_attribute_multi": query(
        """SELECT npd_facility_name, COUNT(DISTINCT npd_field_name) AS distinct_count FROM rawn WHERE npd_facility_name IS NOT NULL
        GROUP BY 1 HAVING COUNT(DISTINCT npd_field_name) > 1""", RAW),
    "nq_attribute_expected": query(
        """SELECT DISTINCT npd_facility_code, npd_facility_name,
        (npd_facility_code = 0 AND npd_facility_name = 'AFRICA') OR (npd_facility_code = 1 AND npd_facility_name = 'AMERICA') AS expected FROM rawn""", RAW),
    "nq_field_coverage": query(
        """SELECT MIN(day) AS first_date, MAX(day) AS last_date, COUNT(DISTINCT day) AS dates_represented,
        CAST(MAX(day) - MIN(day) + 1 AS INTEGER) AS calendar_span_days, MAX(day) - MIN(day) + 1 - COUNT(DISTINCT day) AS dates_without_records FROM fact"""),
    "nq_coverage": query("SELECT * FROM cov", GAP),
    "nq_gaps": query("SELECT entity, max_gap_days, gaps_gt_1, gaps_gt_7, gaps_gt_30 FROM cov", GAP),
    "nq_gap_list": query(
        """SELECT g.entity, entity_name, previous_day AS previous_record_date, day AS next_record_date, gap_days
        FROM gap g JOIN dim d ON d.entity = g.entity WHERE gap_days > 7""", GAP),
    "nq_shared_gaps": query(
        """SELECT previous_day AS previous_record_date, day AS next_record_date, gap_days, COUNT(*) AS entities
        FROM gap WHERE gap_days > 7 GROUP BY 1, 2, 3 HAVING COUNT(*) > 1""", GAP),
    "nq_boundary": query(
        """SELECT COUNT(*) FILTER (WHERE day < DATE '1995-07-01') AS rows_before, COUNT(*) FILTER (WHERE day > DATE '2001-06-30') AS rows_after FROM fact"""),
    "nq_boundary_rows": query(f"SELECT entity, day, state, mode, hours FROM fact WHERE {OUT_WINDOW}"),
    "nq_presence": query(
        """SELECT f.entity, entity_name, MAX(day) - MIN(day) + 1 - COUNT(DISTINCT day) AS no_record_days, COUNT(*) FILTER (WHERE hours > 0) AS active_days,
        COUNT(*) FILTER (WHERE hours = 0) AS inactive_days, COUNT(*) FILTER (WHERE hours IS NULL) AS hours_missing_days
        FROM fact f JOIN dim d ON d.entity = f.entity GROUP BY 1, 2"""),
    "nq_presence_by_month": query(
        """SELECT g.entity, g.month_start, CAST(day(last_day(g.month_start)) AS INTEGER) AS calendar_days, coalesce(n, 0) AS recorded_days
        FROM (SELECT entity, CAST(unnest(generate_series(MIN(date_trunc('month', day)), MAX(date_trunc('month', day)), INTERVAL 1 MONTH)) AS DATE) AS month_start
              FROM fact GROUP BY entity) g
        LEFT JOIN (SELECT entity, CAST(date_trunc('month', day) AS DATE) AS month_start, COUNT(*) AS n FROM fact GROUP BY 1, 2) r
        ON r.entity = g.entity AND r.month_start = g.month_start"""),
    "nq_temporal_verdict": query(
        f"""SELECT CAST(0 AS BIGINT) AS bad_dates, o AS outside_window, g AS entities_with_gaps, m AS largest_gap_days,
        CASE WHEN g > 0 OR o > 0 THEN 'PASS WITH REVIEW' ELSE 'PASS' END AS verdict
        FROM (SELECT (SELECT COUNT(*) FROM fact WHERE {OUT_WINDOW}) AS o, COUNT(*) FILTER (WHERE gaps_gt_1 > 0) AS g,
              {BIG('MAX(max_gap_days)')} AS m FROM cov)""", GAP),
    "nq_hours_buckets": query(
        """SELECT *, CASE WHEN negative > 0 OR above_24 > 0 THEN 'FAIL' WHEN null_rows > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM (
        SELECT COUNT(*) AS total_rows, COUNT(hours) AS non_null, COUNT(*) FILTER (WHERE hours IS NULL) AS null_rows,
        COUNT(*) FILTER (WHERE hours = 0) AS zero, COUNT(*) FILTER (WHERE hours > 0 AND hours <= 24) AS valid_range,
        COUNT(*) FILTER (WHERE hours < 0) AS negative, COUNT(*) FILTER (WHERE hours > 24) AS above_24 FROM fact)"""),
    "nq_null_hours": query(
        alls(f"SELECT '{k}' AS context, {CTX[k]} AS group_value, COUNT(*) AS null_hours FROM fact WHERE hours IS NULL GROUP BY {CTX[k]}"
             for k in ("entity", "state", "mode", "year"))),
    "nq_null_hours_overlap": query(
        f"""SELECT COUNT(*) FILTER (WHERE {CONDS['DQ-001']}) AS before_window, COUNT(*) FILTER (WHERE hours IS NULL) AS null_hours,
        COUNT(*) FILTER (WHERE {CONDS['DQ-001']} AND hours IS NULL) AS before_window_and_null_hours,
        COUNT(*) FILTER (WHERE hours IS NULL AND {POS_ANY}) AS null_hours_with_volume,
        COUNT(*) FILTER (WHERE hours IS NULL AND NOT {POS_ANY}) AS null_hours_blank FROM fact"""),
    "nq_zero_hours_volumes": query(
        "SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE hours = 0 AND {c} > 0) AS {c}_gt_0" for c in FLUIDS)
        + f", COUNT(*) FILTER (WHERE hours = 0 AND {POS}) AS any_production, COUNT(*) FILTER (WHERE hours = 0 AND {POS_ANY}) AS any_volume FROM fact"),
    "nq_zero_hours_rows": query(f"SELECT {REP} FROM fact WHERE hours = 0 AND {POS_ANY}"),
    "nq_active_without_volume": query(
        "SELECT state, mode, COUNT(*) AS row_count FROM fact WHERE hours > 0 AND "
        + " AND ".join(f"{c} = 0" for c in FLUIDS) + " GROUP BY 1, 2"),
    "nq_hours_distribution": query(dist("hours", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})),
    "nq_hours_verdict": query(
        f"""SELECT *, CASE WHEN out_of_range > 0 THEN 'FAIL' WHEN null_rows + zero_hours_production + zero_hours_injection + active_without_volume > 0
        THEN 'PASS WITH REVIEW' ELSE 'PASS' END AS verdict FROM (
        SELECT COUNT(*) FILTER (WHERE hours < 0 OR hours > 24) AS out_of_range, COUNT(*) FILTER (WHERE hours IS NULL) AS null_rows,
        COUNT(*) FILTER (WHERE hours = 0 AND {POS}) AS zero_hours_production, COUNT(*) FILTER (WHERE hours = 0 AND injection > 0) AS zero_hours_injection,
        COUNT(*) FILTER (WHERE hours > 0 AND oil = 0 AND gas = 0 AND water = 0 AND injection = 0) AS active_without_volume FROM fact)"""),
    "nq_population": query(
        f"""SELECT entity, state, mode, COUNT(*) AS row_count, MIN(day) AS first_date, MAX(day) AS last_date, COUNT(*) FILTER (WHERE hours IS NULL) AS null_hours, """
        + ", ".join(f"COUNT(*) FILTER (WHERE {c} <> 0) AS {c}_nonzero" for c in FLUIDS)
        + f" FROM fact WHERE hours IS NULL OR {CONDS['DQ-001']} GROUP BY 1, 2, 3"),
    "nq_population_head": query(
        """SELECT entity, day, state, mode FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY day) AS r FROM fact WHERE hours IS NULL) WHERE r <= 10"""),
    "nq_clock_change": query(
        """SELECT CAST(1 AS INTEGER) AS check_order, 'every value is exactly one hour above the day' AS check_name, n_exact AS supporting, n_over AS tested,
            CASE WHEN n_exact = n_over THEN 'CONFIRMED' ELSE 'PARTIALLY SUPPORTED' END AS outcome FROM clock1
        UNION ALL SELECT 2, 'every such day is the clock-change day of its year', n_change_days, n_days, CASE WHEN n_change_days = n_days THEN 'CONFIRMED' ELSE 'NOT CONFIRMED' END FROM clock1
        UNION ALL SELECT 3, 'all reporting entities show it on such a day', n_uniform, n_days, CASE WHEN n_uniform = n_days THEN 'CONFIRMED' ELSE 'NOT CONFIRMED' END FROM clock1
        UNION ALL SELECT 4, 'no such value on any other day', n_elsewhere, n_over, CASE WHEN n_elsewhere = 0 THEN 'CONFIRMED' ELSE 'NOT CONFIRMED' END FROM clock1""", CLOCK),
    "nq_clock_change_days": query(
        f"SELECT day, reporting AS entities_reporting, over AS entities_exceeding, CAST({CHANGE} AS DATE) AS expected_day FROM clock", CLOCK),
    "nq_missing_by_group": query(
        alls(f"SELECT '{k}' AS context, * FROM (" + miss("fact", MEASURES, g, f"{g} AS group_value") + ")" for k, g in CTX.items())),
    "nq_missing_by_year": query(
        "SELECT 'year' AS context, * FROM (" + miss("fact", MEASURES, CTX["year"], f"{CTX['year']} AS group_value") + ")"),
    "nq_missing_by_combination": query(miss("fact", MEASURES, "state, mode", "state, mode")),
    "nq_missing_class": query(
        """SELECT c AS "column", missing_pct, spread_pp, CASE WHEN c IN ('entity', 'day', 'state', 'mode') THEN 'STRUCTURAL'
        WHEN c = 'hours' THEN 'MEASUREMENT' WHEN missing_pct = 0 THEN 'STRUCTURAL' WHEN spread_pp > 50 THEN 'CONTEXTUAL' ELSE 'MEASUREMENT' END AS classification
        FROM spread""", SPREAD),
    "nq_missing_pattern": query(
        f"""SELECT s.c AS "column", missing_pct, CASE WHEN missing_count = 0 THEN 'none' WHEN s.c = 'hours' THEN 'blank records'
        WHEN spread_pp > 50 THEN 'follows operating mode' WHEN {FEW} AND {ONE} THEN 'concentrated by entity and time'
        WHEN {FEW} THEN 'concentrated by entity' WHEN {ONE} THEN 'concentrated by time' ELSE 'spread broadly' END AS pattern,
        CASE WHEN missing_count = 0 THEN 'PASS' WHEN s.c = 'hours' THEN 'DQ-003' ELSE 'REVIEW' END AS status
        FROM spread s LEFT JOIN top2 ON top2.c = s.c LEFT JOIN top1 ON top1.c = s.c""", SPREAD),
    "nq_separation": query(
        """SELECT "column", MIN(missing_pct) AS min_pct, MAX(missing_pct) AS max_pct, BOOL_AND(missing_pct < 1 OR missing_pct > 99) AS cleanly_separated
        FROM combos GROUP BY 1""", {"combos": miss("fact", MEASURES, "state, mode", "state, mode")}),
    "nq_null_vs_zero": query(alls(f"SELECT '{c}' AS \"column\", {SIGNS(c)} FROM fact" for c in FLUIDS)),
    "nq_null_vs_zero_by_state": query(f"SELECT state, 'injection' AS \"column\", {SIGNS('injection')} FROM fact GROUP BY state"),
    "nq_category_inventory": inv("events", "event_type"),
    "nq_normalisation": query(
        alls(
            f"""SELECT '{c}' AS "column", COUNT(DISTINCT v) AS raw_distinct, COUNT(DISTINCT trim(v)) AS trimmed_distinct,
            COUNT(DISTINCT lower(trim(v))) AS folded_distinct, COUNT(DISTINCT lower(trim(v))) < COUNT(DISTINCT v) AS would_merge
            FROM (SELECT {e} AS v FROM rawn)""" for c, e in
            (("entity_name", "entity_name"), ("well_type", "well_type"),
             ("mixed", "CASE WHEN entity % 2 = 0 THEN lower(entity_name) ELSE upper(well_type) || ' ' END"))
        ), RAW),
    "nq_category_spans": query(
        "SELECT entity, state AS value, COUNT(*) AS row_count, MIN(day) AS first_date, MAX(day) AS last_date FROM fact GROUP BY 1, 2"),
    "nq_category_stability": query(
        """SELECT entity, COUNT(DISTINCT state) AS distinct_count, string_agg(DISTINCT state, ',' ORDER BY state) AS value_list,
        CASE WHEN COUNT(DISTINCT state) > 1 THEN 'REVIEW' ELSE 'PASS' END AS status FROM fact GROUP BY 1"""),
    "nq_transitions": query(
        "SELECT previous || '->' || current AS transition, COUNT(*) AS row_count FROM moves WHERE previous IS NOT NULL GROUP BY 1", {"moves": MOVES("state")}),
    "nq_changes": query(
        "SELECT entity, previous, current, day AS transition_date FROM moves WHERE previous IS NOT NULL AND previous <> current", {"moves": MOVES("mode")}),
    "nq_contingency": query(
        f"""SELECT coalesce(state, 'Total') AS state, coalesce(mode, 'Total') AS mode, COUNT(*) AS row_count,
        {rratio('COUNT(*)', '(SELECT COUNT(*) FROM fact)', 2, 100, even=True)} AS pct FROM fact GROUP BY CUBE (state, mode)"""),
    "nq_activity": query(
        "SELECT state, mode, COUNT(*) AS row_count, " + ", ".join(f"COUNT(*) FILTER (WHERE {c} > 0) AS {c}_gt_0" for c in FLUIDS)
        + ", COUNT(*) FILTER (WHERE " + " AND ".join(f"{c} = 0" for c in FLUIDS) + ") AS all_volumes_zero, COUNT(*) FILTER (WHERE "
        + " AND ".join(f"{c} IS NULL" for c in FLUIDS) + ") AS all_volumes_null FROM fact GROUP BY 1, 2"),
    "nq_attribute_classes": query(
        """SELECT 'state' AS attribute, n AS evidence_count, CASE WHEN n > 0 THEN 'TEMPORAL' ELSE 'STATIC' END AS classification
            FROM (SELECT COUNT(*) AS n FROM moves_s WHERE previous <> current)
        UNION ALL SELECT 'mode', n, CASE WHEN n > 0 THEN 'TEMPORAL' ELSE 'STATIC' END FROM (SELECT COUNT(*) AS n FROM moves_m WHERE previous <> current)
        UNION ALL SELECT 'group_name', 0, 'STATIC'
        UNION ALL SELECT 'avg_choke_uom', 0, 'STATIC'
        UNION ALL SELECT 'group_name', n, CASE WHEN n <= 1 THEN 'STATIC' ELSE 'UNCLEAR' END FROM (SELECT COUNT(DISTINCT npd_field_name) AS n FROM rawn)""",
        {**RAW, "moves_s": MOVES("state"), "moves_m": MOVES("mode")}),
    "nq_negative_volumes": query(f"SELECT {REP} FROM fact WHERE oil < 0 OR gas < 0 OR water < 0"),
    "nq_volume_distribution": query(alls(dist(c, {"median": 0.5, "p95": 0.95}) for c in VOLUMES)),
    "nq_contradictions": query(
        f"""SELECT COUNT(*) FILTER (WHERE mode = 'injection' AND {POS}) AS injection_mode_with_production,
        COUNT(*) FILTER (WHERE state = 'WI' AND {POS}) AS injector_with_production,
        COUNT(*) FILTER (WHERE state = 'WI' AND mode = 'production' AND {POS}) AS of_which_in_transition,
        COUNT(*) FILTER (WHERE {INJ_ODD}) AS injection_outside_injection_state,
        COUNT(*) FILTER (WHERE injection > 0 AND hours IS NULL) AS injection_without_hours FROM fact"""),
    "nq_contradiction_rows": query(
        f"""SELECT {REP}, state = 'WI' AND {POS} AS injector_with_production, {INJ_ODD} AS injection_outside_injection_state
        FROM fact WHERE (state = 'WI' AND {POS}) OR {INJ_ODD}"""),
    "nq_rates": query(described("rates", [f"{c}_rate" for c in FLUIDS]), RATES),
    "nq_rate_by_entity": query(rate_by("oil"), RATES),
    "nq_injection_rate_by_entity": query(rate_by("injection"), RATES),
    "nq_abrupt_changes": query(f"SELECT * EXCLUDE (ok) FROM diffs WHERE {BEYOND}", change_cte(VOLUMES, ">")),
    "nq_abrupt_listing": query(
        f"SELECT diffs.* EXCLUDE (ok), entity_name FROM diffs JOIN dim ON dim.entity = diffs.entity WHERE {BEYOND}", change_cte(VOLUMES, ">")),
    "nq_abrupt_sensor_changes": query(f"SELECT * EXCLUDE (ok) FROM diffs WHERE {BEYOND} AND abs(abs_change) >= 50", change_cte(SENSORS, "<>")),
    "nq_floor_sensitivity": query(
        alls(f"""SELECT "column", COUNT(*) AS comparisons, CAST({f} AS INTEGER) AS floor, COUNT(*) FILTER (WHERE {BEYOND} AND abs(abs_change) >= {f}) AS flags FROM diffs GROUP BY 1"""
             for f in FLOORS), change_cte([*FLUIDS, *SENSORS], ">")),
    "nq_largest_changes": query(
        'SELECT * EXCLUDE (ok) FROM diffs ORDER BY abs(abs_change) DESC, "column", entity, "current_date" LIMIT 15', change_cte(["injection"], ">")),
    "nq_transition_rows": query(
        f"SELECT {REP}, {POS} AS supports_production, coalesce(injection > 0, false) AS supports_injection FROM fact WHERE state = 'WI' AND mode = 'production'"),
    "nq_transition_support": query(
        f"""SELECT {POS} AS supports_production, coalesce(injection > 0, false) AS supports_injection, COUNT(*) AS row_count
        FROM fact WHERE state = 'WI' AND mode = 'production' GROUP BY 1, 2"""),
    "nq_injection_by_state": query(
        f"SELECT state, mode, COUNT(*) AS row_count, {SIGNS('injection')}, {tot('injection')} AS total_injected FROM fact GROUP BY 1, 2"),
    "nq_magnitude_bins": query(
        """SELECT CASE WHEN injection < 1 THEN 'trace' WHEN injection < 100 THEN 'moderate' ELSE 'large' END AS magnitude, COUNT(*) AS row_count
        FROM fact WHERE hours = 0 AND injection > 0 GROUP BY 1"""),
    "nq_large_idle_injection": query(f"SELECT {REP} FROM fact WHERE hours = 0 AND injection > 40"),
    "nq_idle_rate": query(
        f"""SELECT 'production' AS kind, p AS positive_rows, z AS zero_hours_rows, {rratio('z', 'p', 3, 100)} AS rate_pct
        FROM (SELECT COUNT(*) FILTER (WHERE {POS}) AS p, COUNT(*) FILTER (WHERE {POS} AND hours = 0) AS z FROM fact)
        UNION ALL SELECT 'injection', p, z, {rratio('z', 'p', 3, 100)}
        FROM (SELECT COUNT(*) FILTER (WHERE injection > 0) AS p, COUNT(*) FILTER (WHERE injection > 0 AND hours = 0) AS z FROM fact)"""),
    "nq_hours_by_activity": query(
        described("act", ["producing", "injecting"]),
        {"act": f"SELECT CASE WHEN {POS} THEN hours END AS producing, CASE WHEN injection > 0 THEN hours END AS injecting FROM fact"}),
    "nq_blank_records": query(
        f"""SELECT COUNT(*) AS flagged_rows, COUNT(*) FILTER (WHERE {POS_ANY}) AS with_measurement, COUNT(*) FILTER (WHERE NOT {POS_ANY}) AS blank
        FROM fact WHERE hours IS NULL OR {CONDS['DQ-001']}"""),
    "nq_sensor_validity": query(numbers("fact", SENSORS, {"median": 0.5, "p95": 0.95})),
    "nq_sensor_by_activity": query(
        alls(
            f"SELECT '{k}' AS activity, * FROM (" + miss(f"(SELECT * FROM fact WHERE {w})", SENSORS) + ")"
            for k, w in {"active_production": POS, "active_injection": "injection > 0", "zero_hours": "hours = 0", "null_hours": "hours IS NULL",
                         "all_zero_volume": " AND ".join(f"{c} = 0" for c in FLUIDS)}.items()
        ) ),
    "nq_sensor_relations": query(
        alls(
            f"SELECT '{n}' AS relation, b AS compared_rows, v AS review_rows, CASE WHEN v > 0 THEN 'REVIEW' ELSE 'PASS' END AS status "
            f"FROM (SELECT COUNT(*) FILTER (WHERE {b}) AS b, COUNT(*) FILTER (WHERE {v}) AS v FROM fact)"
            for n, b, v in (("downhole < wellhead", "downhole IS NOT NULL AND wellhead IS NOT NULL", "downhole < wellhead"),
                            ("downhole < 0", "downhole IS NOT NULL", "downhole < 0"), ("wellhead < 0", "wellhead IS NOT NULL", "wellhead < 0"))
        )),
    "nq_sensor_relation_rows": query("SELECT entity, day, state, mode, hours, downhole, wellhead FROM fact WHERE downhole < wellhead"),
    "nq_sensors_around_issues": query(
        alls(f"SELECT entity, day, '{i}' AS dq_issue, downhole, wellhead FROM fact WHERE {c}" for i, c in
             {"DQ-002": "day IN (DATE '1999-01-02', DATE '1999-01-14')", **{k: CONDS[k] for k in ("DQ-004", "DQ-005", "DQ-006")}}.items())),
    "nq_choke": query(
        f"""SELECT COUNT(*) FILTER (WHERE wellhead < 0) AS below_0, COUNT(*) FILTER (WHERE wellhead = 0) AS exactly_0,
        COUNT(*) FILTER (WHERE wellhead > 0 AND wellhead < 100) AS between_0_and_100, COUNT(*) FILTER (WHERE wellhead = 100) AS exactly_100,
        COUNT(*) FILTER (WHERE wellhead > 100) AS above_100, COUNT(*) FILTER (WHERE wellhead IS NULL) AS null_rows, COUNT(*) AS total_rows,
        COUNT(*) FILTER (WHERE wellhead = 0 AND {POS}) AS zero_with_production, COUNT(*) FILTER (WHERE wellhead = 0 AND injection > 0) AS zero_with_injection,
        COUNT(*) FILTER (WHERE wellhead > 0 AND hours = 0) AS open_with_zero_hours, COUNT(*) FILTER (WHERE wellhead > 0 AND hours IS NULL) AS open_without_hours FROM fact"""),
    "nq_correlation": query(
        """SELECT COUNT(*) AS row_count, CAST(corr(CAST(oil AS DOUBLE), CAST(gas AS DOUBLE)) AS DECIMAL(18,6)) AS correlation
        FROM fact WHERE oil IS NOT NULL AND gas IS NOT NULL"""),
    "nq_zero_agreement": query(
        """SELECT oil = 0 AS first_zero, injection = 0 AS second_zero, COUNT(*) AS row_count FROM fact
        WHERE oil IS NOT NULL AND injection IS NOT NULL GROUP BY 1, 2"""),
}
