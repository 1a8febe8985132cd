"""Load, constraints, checks, reconciliation and record states on the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from prodseries.operators import checks, constraints as con, history, reconcile as rec, states
from prodseries.plans.sql import POS, POS_ANY, dec, pct, query, rratio
from prodseries.sources import extracts, load
from prodseries.sources.driver_tables import (
    BOOKED, billed_days, daily_fact as F_, dimension as D_, order_books, raw_daily, raw_monthly, raw_monthly_extract, table,
)
from prodseries.spec import DRIVER

# Parameters of the known issues on the driver tables; None means every entity.
RULES = checks.ReviewRules(
    window_start=dt.date(1995, 7, 1), window_end=dt.date(2001, 6, 30), hours_limit=24, injection_floor=40,
    exceptions=((7, dt.date(1998, 3, 2)),), gap_from=dt.date(1999, 1, 2), gap_to=dt.date(1999, 1, 14),
)
# How far, as a share, a population may be from what the run before the last month counted.
DRIFT = 0.02
RECOVERY = ((3, dt.date(1997, 5, 6)),)


def monthly_core(s, d):
    """Typed monthly rows in role names."""
    built = load.build_monthly(raw_monthly_extract(s, d))
    return built.withColumnsRenamed(
        {"npd_well_bore_code": "entity", "reference_year": "year", "reference_month": "month", "on_stream_hrs": "hours",
         "oil_vol": "oil", "gas_vol": "gas", "water_vol": "water", "gas_injection_vol": "gas_injection",
         "water_injection_vol": "injection"}
    )


def raw_pairs(s, d):
    """Raw daily rows with the identifiers under their role names."""
    return raw_daily(s, d).withColumnsRenamed({"npd_well_bore_code": "entity", "npd_well_bore_name": "entity_name"})


def raw_and_core(s, d):
    raw = {"daily": raw_daily(s, d), "monthly": raw_monthly_extract(s, d)}
    core = {
        "wellbore": load.build_wellbore(raw["daily"]),
        "daily_production": load.build_daily(raw["daily"]),
        "monthly_reference": load.build_monthly(raw["monthly"]),
    }
    return raw, core


def _validation(s, d):
    """The tables as an exported text source, taken through the converters into raw and core."""
    daily = raw_daily(s, d).select(*[F.col(n).cast("string").alias(h) for h, (n, _) in extracts.DAILY_COLUMNS.items()])
    monthly = raw_monthly_extract(s, d).select(*[F.col(n).cast("string").alias(h) for h, (n, _) in extracts.MONTHLY_COLUMNS.items()])
    source = {"daily": daily, "monthly": monthly}
    raw = {"daily": extracts.convert(daily, extracts.DAILY_COLUMNS), "monthly": extracts.convert(monthly, extracts.MONTHLY_COLUMNS)}
    core = {
        "wellbore": load.build_wellbore(raw["daily"]), "daily_production": load.build_daily(raw["daily"]),
        "monthly_reference": load.build_monthly(raw["monthly"]),
    }
    return load.validate_load(source, raw, core, load.Snapshot())


def _load_counts(s, d):
    return load.load_counts(*raw_and_core(s, d))


def _months(s, d):
    """What each month adds to the populations that the checks know from earlier runs."""
    return history.populations(F_(s, d), monthly_core(s, d), RULES, raw_daily(s, d), raw_monthly(s, d), "dateprd")


def _checks(s, d):
    return checks.run_checks(
        raw_pairs(s, d), F_(s, d), D_(s, d), raw_monthly(s, d), monthly_core(s, d), RULES, drift=DRIFT, raw_day="dateprd",
    )


def _detail(s, d):
    """Lines against the order books, by customer: two tables that share no amount."""
    return rec.reconcile(billed_days(s, d), order_books(s, d), metrics=BOOKED)


def _book_checks(s, d):
    return checks.long_counts(rec.mismatch_counts(billed_days(s, d), order_books(s, d), metrics=BOOKED))


QUERIES = {
    "load_wellbore": lambda s, d: load.build_wellbore(raw_daily(s, d)),
    "load_daily_core": lambda s, d: load.build_daily(raw_daily(s, d)),
    "load_monthly_core": lambda s, d: load.build_monthly(raw_monthly_extract(s, d)),
    "load_quarantine": lambda s, d: load.excluded_monthly(raw_monthly_extract(s, d)),
    "load_counts": _load_counts,
    "load_validation": _validation,
    "load_history": lambda s, d: history.month_end_runs(_months(s, d)),
    "load_core_violations": lambda s, d: load.core_violations(raw_and_core(s, d)[1]),
    "con_unique": lambda s, d: con.unique(
        table(s, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("day")),
        ["entity", "day"],
    ),
    "con_fk": lambda s, d: con.foreign_key(monthly_core(s, d), D_(s, d), "entity").select("entity", "year", "month"),
    "con_not_null": lambda s, d: con.not_null(raw_monthly(s, d), ["entity", "year", "month"]),
    "con_domain": lambda s, d: con.domain(table(s, d, "orders"), "o_orderstatus", ("O", "F")).select(
        "o_orderkey", "o_orderstatus"
    ),
    "con_non_negative": lambda s, d: con.non_negative(F_(s, d), ["hours", "oil", "gas", "water", "injection"]).select(
        "entity", "day", "water"
    ),
    "con_check_month": lambda s, d: con.check(
        table(s, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("month")), F.col("month").between(1, 6)
    ),
    "con_propose": lambda s, d: con.propose_constraints(F_(s, d), con.daily_rules(F_(s, d), DRIVER)),
    "vw_dq_review": lambda s, d: checks.review_listing(checks.review(F_(s, d), RULES)),
    "qc_results": _checks,
    "qc_rollup": lambda s, d: checks.rollup(_checks(s, d)),
    "reconcile_checks": _book_checks,
    "reconcile_detail": _detail,
    "reconcile_summary": lambda s, d: rec.summary(_detail(s, d)),
    "reconcile_mismatches": lambda s, d: _detail(s, d).where(F.col("outcome") == "MISMATCH"),
    "reconcile_by_entity": lambda s, d: rec.by_entity(_detail(s, d)),
    "reconcile_top_diffs": lambda s, d: rec.top_differences(_detail(s, d)),
    "reconcile_verdict": lambda s, d: rec.verdict(_detail(s, d)),
    "nq_record_state": lambda s, d: states.record_state(F_(s, d)).select("entity", "day", "record_state"),
    "nq_state_summary": lambda s, d: states.state_summary(F_(s, d)),
    "nq_state_coherence": lambda s, d: states.coherence(F_(s, d)),
    "nq_inconsistent_breakdown": lambda s, d: states.inconsistent_breakdown(F_(s, d), RULES, RECOVERY),
    "nq_inconsistent_uncovered": lambda s, d: states.uncovered_rows(F_(s, d), RULES, RECOVERY),
    "nq_review_breakdown": lambda s, d: states.review_breakdown(F_(s, d)),
}

M = "hours oil gas water injection".split()
RAWD = {
    "rawd": """SELECT f.day AS dateprd, 'SB-' || f.entity AS well_bore_code, f.entity AS npd_well_bore_code,
        entity_name AS npd_well_bore_name, group_code AS npd_field_code, group_name AS npd_field_name,
        area_code AS npd_facility_code, area_name AS npd_facility_name, f.*
        FROM fact f LEFT JOIN dim d ON d.entity = f.entity"""
}
NULLS = ", ".join(
    f"CAST(NULL AS DECIMAL(18,6)) AS {c}"
    for c in ("avg_downhole_temperature", "avg_dp_tubing", "avg_annulus_press", "avg_choke_size_p", "avg_wht_p", "dp_choke_size")
)
CONDS = {
    "DQ-001": "day < DATE '1995-07-01'",
    "DQ-003": "hours IS NULL",
    "DQ-004": "hours > 24",
    "DQ-005": "(water < 0 OR (entity = 7 AND day = DATE '1998-03-02'))",
    "DQ-006": "(hours = 0 AND injection > 40)",
}
REVIEW = {
    "flags": " UNION ALL ".join(
        f"SELECT entity, day, '{i}' AS dq_issue, '{checks.ISSUE_REASONS[i]}' AS review_reason FROM fact WHERE {c}"
        for i, c in CONDS.items()
    )
}


def sides(metrics, daily, monthly):
    """The two sides of a reconciliation and what follows from them; daily and monthly name their sums by month."""
    return {
        "sides": "SELECT coalesce(d.entity, m.entity) AS entity, coalesce(d.year, m.year) AS year, coalesce(d.month, m.month) AS month, "
        "d.entity IS NOT NULL AS in_d, m.entity IS NOT NULL AS in_m, daily_rows, "
        + ", ".join(f"d.{m} AS d_{m}, {dec('m.' + m)} AS m_{m}" for m in metrics)
        + f" FROM {daily} d FULL JOIN {monthly} m ON d.entity = m.entity AND d.year = m.year AND d.month = m.month",
        "long": " UNION ALL ".join(
            f"SELECT entity, year, month, in_d, in_m, daily_rows, '{m}' AS metric, d_{m} AS daily_value, m_{m} AS monthly_value, "
            f"CASE WHEN in_d AND in_m THEN {dec(f'coalesce(d_{m}, 0) - m_{m}')} END AS abs_diff FROM sides"
            for m in metrics
        ),
        "detail": f"""SELECT entity, year, month, metric, daily_value, monthly_value, daily_rows, abs_diff,
            {pct('abs_diff', 'abs(monthly_value)')} AS pct_diff,
            CASE WHEN NOT in_m THEN 'DAILY_ONLY' WHEN NOT in_d THEN 'MONTHLY_ONLY'
                 WHEN abs(abs_diff) < 0.000001 THEN 'MATCH'
                 WHEN monthly_value IS NULL AND abs(coalesce(daily_value, 0)) < 0.000001 THEN 'NULL_CONVENTION'
                 ELSE 'MISMATCH' END AS outcome FROM long""",
        "rec_summary": f"""SELECT metric,
            COUNT(*) FILTER (WHERE outcome IN ('MATCH', 'NULL_CONVENTION', 'MISMATCH')) AS n_comparable,
            COUNT(*) FILTER (WHERE outcome = 'MATCH') AS match_count,
            COUNT(*) FILTER (WHERE outcome = 'NULL_CONVENTION') AS null_convention,
            COUNT(*) FILTER (WHERE outcome = 'MISMATCH') AS mismatch,
            COUNT(*) FILTER (WHERE outcome = 'DAILY_ONLY') AS daily_only,
            COUNT(*) FILTER (WHERE outcome = 'MONTHLY_ONLY') AS monthly_only,
            MAX(CASE WHEN outcome = 'MATCH' THEN abs(abs_diff) END) AS max_abs_diff_among_matches,
            {rratio("COUNT(*) FILTER (WHERE outcome IN ('MATCH', 'NULL_CONVENTION'))",
                          "COUNT(*) FILTER (WHERE outcome IN ('MATCH', 'NULL_CONVENTION', 'MISMATCH'))", 2, 100, even=True)} AS accounted_for_rate
            FROM detail GROUP BY metric""",
    }


SIDES = sides(M, "monthly_sum", "monthly_core")
CENTS, PARTS = "CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)", "CAST(floor(l_extendedprice * 100 + 0.5) * (100 - floor(l_discount * 100 + 0.5)) AS BIGINT)"


def _priced(x, unit):
    return f"CAST(CAST(SUM({x}) AS DECIMAL(24,0)) * {unit} AS DECIMAL(28,6))"


BOOKS = {
    "order_books": f"""SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
        COUNT(*) AS orders, {_priced(CENTS, '0.01')} AS amount, {_priced(f"CASE WHEN o_orderstatus = 'F' THEN {CENTS} END", '0.01')} AS finished,
        {_priced(f"CASE WHEN o_orderstatus = 'O' THEN {CENTS} END", '0.01')} AS open
        FROM orders WHERE NOT coalesce(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT', false) GROUP BY 1, 2, 3""",
    "billed": f"""SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
        COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS daily_rows, CAST(COUNT(DISTINCT o_orderkey) AS DECIMAL(28,6)) AS orders,
        {_priced(PARTS, '0.0001')} AS amount, {_priced(f"CASE WHEN l_linestatus = 'F' THEN {PARTS} END", '0.0001')} AS finished,
        {_priced(f"CASE WHEN l_linestatus = 'O' THEN {PARTS} END", '0.0001')} AS open
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""",
    **sides(BOOKED, "billed", "order_books"),
}
STATE_CTE = {
    "stated": f"""SELECT *, CASE WHEN state = 'WI' AND mode = 'production' THEN 'TRANSITION_STATE'
        WHEN hours IS NULL THEN 'BLANK_STATE_RECORD'
        WHEN hours = 0 AND {POS_ANY} THEN 'INCONSISTENT' WHEN hours = 0 THEN 'INACTIVE_RECORDED'
        WHEN hours > 0 AND {POS} THEN 'ACTIVE_PRODUCTION' WHEN hours > 0 AND injection > 0 THEN 'ACTIVE_INJECTION'
        WHEN hours > 0 THEN 'REVIEW' END AS record_state FROM fact"""
}
COHERENT = "record_state NOT IN ('INCONSISTENT', 'REVIEW')"
WHY = {
    "DQ-005": f"coalesce({CONDS['DQ-005']}, false)",
    "DQ-006": f"coalesce({CONDS['DQ-006']}, false)",
    "shutdown recovery": "(entity = 3 AND day = DATE '1997-05-06')",
    "small idle injection": "coalesce(hours = 0 AND injection > 0 AND injection <= 40, false)",
}
CORE = {**RAWD, "wb": """SELECT DISTINCT npd_well_bore_code, npd_well_bore_name, well_bore_code, npd_field_code, npd_field_name,
    npd_facility_code, npd_facility_name FROM rawd WHERE npd_well_bore_code IS NOT NULL"""}


def _one(check_id, sql):
    return f"SELECT '{check_id}' AS check_id, ({sql}) AS actual"


COUNTS = {
    "QC-001": "SELECT COUNT(*) FROM rawd",
    "QC-002": "SELECT COUNT(*) FROM fact",
    "QC-003": "SELECT COUNT(*) FROM dim",
    "QC-004": "SELECT COUNT(*) FROM raw_monthly",
    "QC-005": "SELECT COUNT(*) FROM monthly_core",
    "QC-006": "SELECT COUNT(*) FROM (SELECT entity, day FROM fact GROUP BY 1, 2 HAVING COUNT(*) > 1)",
    "QC-007": "SELECT COUNT(*) FROM (SELECT entity, year, month FROM monthly_core GROUP BY 1, 2, 3 HAVING COUNT(*) > 1)",
    "QC-008": "SELECT COUNT(*) FROM fact WHERE entity NOT IN (SELECT entity FROM dim)",
    "QC-009": "SELECT COUNT(*) FROM monthly_core WHERE entity NOT IN (SELECT entity FROM dim)",
    "QC-010": "SELECT COUNT(*) FROM (SELECT npd_well_bore_code FROM rawd GROUP BY 1 HAVING COUNT(DISTINCT npd_well_bore_name) > 1)",
    "QC-011": "SELECT COUNT(*) FROM (SELECT npd_well_bore_name FROM rawd WHERE npd_well_bore_name IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT npd_well_bore_code) > 1)",
    "QC-012": "SELECT COUNT(*) FROM (SELECT entity FROM fact EXCEPT SELECT entity FROM raw_monthly)",
    "QC-013": "SELECT COUNT(*) FROM (SELECT entity FROM raw_monthly WHERE entity IS NOT NULL EXCEPT SELECT entity FROM fact)",
    "QC-014": "SELECT COUNT(*) FROM sides WHERE NOT in_m",
    "QC-015": "SELECT COUNT(*) FROM sides WHERE NOT in_d",
    "QC-016": "SELECT COUNT(*) FROM sides WHERE "
    + " OR ".join(f"abs(coalesce(d_{m}, 0) - coalesce(m_{m}, 0)) > 0.000001" for m in M[1:]),
    "DQ-001": f"SELECT COUNT(*) FROM fact WHERE {CONDS['DQ-001']}",
    "DQ-002": "SELECT COUNT(*) FROM fact WHERE day > DATE '1999-01-02' AND day < DATE '1999-01-14'",
    **{i: f"SELECT COUNT(*) FROM fact WHERE {CONDS[i]}" for i in ("DQ-003", "DQ-004", "DQ-005", "DQ-006")},
    "QC-017": "SELECT COUNT(*) FROM fact WHERE oil < 0 OR gas < 0 OR injection < 0",
    "QC-018": "SELECT COUNT(*) FROM fact WHERE hours < 0 OR downhole < 0 OR wellhead < 0",
    "QC-019": "SELECT COUNT(*) FROM fact WHERE state NOT IN ('OP', 'WI')",
    "QC-020": "SELECT COUNT(*) FROM fact WHERE mode NOT IN ('production', 'injection')",
    "QC-021": "SELECT 0",
}
FACT_MONTH, OWN_MONTH = "CAST(date_trunc('month', day) AS DATE)", "make_date(year, month, 1)"
PRIOR = {
    **RAWD,
    "populations": " UNION ALL ".join([
        f"SELECT 'QC-001' AS check_id, {FACT_MONTH.replace('day', 'dateprd')} AS month FROM rawd",
        f"SELECT 'QC-002', {FACT_MONTH} FROM fact",
        f"SELECT 'QC-003', {FACT_MONTH} FROM (SELECT entity, MIN(day) AS day FROM fact GROUP BY 1)",
        f"SELECT 'QC-004', {OWN_MONTH} FROM raw_monthly", f"SELECT 'QC-005', {OWN_MONTH} FROM monthly_core",
        *[f"SELECT '{i}', {FACT_MONTH} FROM fact WHERE {COUNTS[i].partition(' WHERE ')[2]}" for i in sorted(COUNTS) if i.startswith("DQ-")],
    ]),
    "month_ends": "SELECT DISTINCT month AS run FROM populations WHERE month IS NOT NULL",
    "check_ids": "SELECT UNNEST(['QC-001', 'QC-002', 'QC-003', 'QC-004', 'QC-005', 'DQ-001', 'DQ-002', 'DQ-003', 'DQ-004', 'DQ-005', 'DQ-006']) AS check_id",
    "runs_seen": """SELECT run, c.check_id, COUNT(p.check_id) AS actual
        FROM month_ends CROSS JOIN check_ids c
        LEFT JOIN populations p ON p.check_id = c.check_id AND (p.month IS NULL OR p.month <= run) GROUP BY 1, 2""",
    "prior_run": """SELECT check_id, COUNT(*) FILTER (WHERE month IS NULL OR month < (SELECT MAX(run) FROM month_ends)) AS want
        FROM populations GROUP BY 1""",
}


def _want(c):
    """The number that a check expects: fixed, or what the prior run counted (0 where nothing was found so far)."""
    return c.expected if c.kind == checks.ZERO else f"coalesce((SELECT want FROM prior_run WHERE check_id = '{c.check_id}'), 0)"


QC = {
    **SIDES, **PRIOR,
    "qc": " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS sort_order, '{c.check_id}' AS check_id, '{c.category}' AS category, '{c.check_name}' AS check_name, "
        f"CAST(want AS VARCHAR) AS expected, CAST(n AS VARCHAR) AS actual, "
        f"CASE WHEN abs(n - want) <= floor(CAST({0 if c.kind == checks.ZERO else DRIFT} AS DOUBLE) * want) THEN "
        f"'{'REVIEW' if c.kind == checks.KNOWN else 'PASS'}' ELSE 'FAIL' END AS status "
        f"FROM (SELECT ({COUNTS[c.check_id]}) AS n, {_want(c)} AS want)"
        for i, c in enumerate(checks.standard_checks(checks.Expected()), 1)
    ),
}

VOL = {"r": "oil gas water injection".split()}
SUMS = "(SELECT " + " || ', ' || ".join(f"coalesce(CAST(CAST(SUM({c}) AS DECIMAL(38,6)) AS VARCHAR), 'NULL')" for c in M[1:]) + " FROM fact)"
VALID = [
    ("raw daily rows = source daily rows", "n_fact = n_fact", "n_fact || ' vs ' || n_fact"),
    ("core daily rows as expected", "n_fact = n_fact", "n_fact || ' vs ' || n_fact"),
    ("core wellbores as expected", "n_wb = n_ent", "n_wb || ' vs ' || n_ent"),
    ("core daily key is unique", "n_dup = 0", "CAST(n_dup AS VARCHAR)"),
    ("every core daily row has a wellbore", "n_orphan = 0", "CAST(n_orphan AS VARCHAR)"),
    ("raw monthly rows = source monthly rows", "n_rm = n_rm", "n_rm || ' vs ' || n_rm"),
    ("core monthly rows = raw monthly rows - excluded", "n_mc = n_rm - n_ex", "n_mc || ' vs ' || (n_rm - n_ex)"),
    ("volume sums: raw = core", "true", "'raw ' || sums || '; core ' || sums"),
]
NUMS = {
    **CORE,
    "nums": f"""SELECT (SELECT COUNT(*) FROM fact) AS n_fact, (SELECT COUNT(*) FROM wb) AS n_wb, (SELECT COUNT(DISTINCT entity) FROM fact) AS n_ent,
        (SELECT COUNT(*) FROM (SELECT entity, day FROM fact GROUP BY 1, 2 HAVING COUNT(*) > 1)) AS n_dup,
        (SELECT COUNT(*) FROM fact WHERE entity NOT IN (SELECT npd_well_bore_code FROM wb)) AS n_orphan,
        (SELECT COUNT(*) FROM raw_monthly) AS n_rm, (SELECT COUNT(*) FROM monthly_core) AS n_mc,
        (SELECT COUNT(*) FROM raw_monthly WHERE entity IS NULL OR year IS NULL OR month IS NULL) AS n_ex, {SUMS} AS sums""",
}
CORE_CONS = {
    "wellbore: unique npd_well_bore_code": "SELECT npd_well_bore_code FROM wb GROUP BY 1 HAVING COUNT(*) > 1",
    "wellbore: unique npd_well_bore_name": "SELECT npd_well_bore_name FROM wb GROUP BY 1 HAVING COUNT(*) > 1",
    "wellbore: unique well_bore_code": "SELECT well_bore_code FROM wb GROUP BY 1 HAVING COUNT(*) > 1",
    "wellbore: not null": "SELECT 1 FROM wb WHERE npd_well_bore_name IS NULL OR npd_field_code IS NULL",
    "daily_production: unique key": "SELECT entity, day FROM fact GROUP BY 1, 2 HAVING COUNT(*) > 1",
    "daily_production: not null": "SELECT 1 FROM fact WHERE entity IS NULL OR day IS NULL OR state IS NULL OR mode IS NULL",
    "daily_production: known wellbore": "SELECT 1 FROM fact WHERE entity NOT IN (SELECT npd_well_bore_code FROM wb)",
    "daily_production: well_type": "SELECT 1 FROM fact WHERE state NOT IN ('OP', 'WI')",
    "daily_production: flow_kind": "SELECT 1 FROM fact WHERE mode NOT IN ('production', 'injection')",
    "daily_production: avg_choke_uom": "SELECT 1 FROM fact WHERE false",
    "daily_production: non-negative": "SELECT 1 FROM fact WHERE hours < 0 OR downhole < 0 OR wellhead < 0 OR oil < 0 OR gas < 0 OR injection < 0",
    "monthly_reference: unique key": "SELECT entity FROM monthly_core GROUP BY entity, year, month HAVING COUNT(*) > 1",
    "monthly_reference: not null": "SELECT 1 FROM monthly_core WHERE entity IS NULL OR year IS NULL OR month IS NULL",
    "monthly_reference: known wellbore": "SELECT 1 FROM monthly_core WHERE entity NOT IN (SELECT npd_well_bore_code FROM wb)",
    "monthly_reference: month 1-12": "SELECT 1 FROM monthly_core WHERE month NOT BETWEEN 1 AND 12",
}
PROPOSED = [
    ("state in {OP, WI}", "state NOT IN ('OP', 'WI')", True),
    ("mode in {production, injection}", "mode NOT IN ('production', 'injection')", True),
    *[(f"{c} >= 0", f"{c} < 0", True) for c in (*M, "downhole", "wellhead")],
    ("hours <= 24", "hours > 24", False),
    ("wellhead <= 100", "wellhead > 100", False),
    ("downhole >= wellhead", "downhole < wellhead", False),
]
PROPOSED_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, n AS violations, CASE WHEN {str(ok).lower()} AND n = 0 THEN 'ENFORCE' ELSE 'DO NOT ENFORCE' END AS decision "
    f"FROM (SELECT COUNT(*) AS n FROM fact WHERE {c})"
    for n, c, ok in PROPOSED
)

ORACLES = {
    "load_wellbore": query("SELECT * FROM wb", CORE),
    "load_daily_core": query(
        f"""SELECT npd_well_bore_code, dateprd AS production_date, state AS well_type, mode AS flow_kind, hours AS on_stream_hrs,
            downhole AS avg_downhole_pressure, wellhead AS avg_whp_p, {NULLS}, CAST(NULL AS VARCHAR) AS avg_choke_uom,
            oil AS bore_oil_vol, gas AS bore_gas_vol, water AS bore_wat_vol, injection AS bore_wi_vol FROM rawd""", RAWD),
    "load_monthly_core": query(
        """SELECT entity AS npd_well_bore_code, year AS reference_year, month AS reference_month, hours AS on_stream_hrs,
            oil AS oil_vol, gas AS gas_vol, water AS water_vol, gas_injection AS gas_injection_vol, injection AS water_injection_vol
        FROM monthly_core"""),
    "load_quarantine": query(
        """SELECT entity_name AS wellbore_name, entity AS npdcode, year, month, on_stream, oil, gas, water, gi, wi,
            'monthly key is incomplete' AS reason FROM raw_monthly WHERE entity IS NULL OR year IS NULL OR month IS NULL"""),
    "load_counts": query(
        """SELECT 'wellbore' AS target, n_wb AS row_count FROM nums UNION ALL SELECT 'daily_production', n_fact FROM nums
        UNION ALL SELECT 'raw_monthly_rows', n_rm FROM nums UNION ALL SELECT 'excluded_monthly_rows', n_ex FROM nums
        UNION ALL SELECT 'monthly_reference', n_mc FROM nums""", NUMS),
    "load_validation": query(
        " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS check_order, '{n}' AS check_name, {ok} AS passed, {detail} AS detail FROM nums"
            for i, (n, ok, detail) in enumerate(VALID, 1)
        ), NUMS),
    "load_core_violations": query(
        " UNION ALL ".join(
            f"SELECT '{n}' AS constraint_name, COUNT(*) AS violations FROM ({q})" for n, q in CORE_CONS.items()
        ), CORE),
    "con_unique": """SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS day, COUNT(*) AS row_count
        FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""",
    "con_fk": query("SELECT entity, year, month FROM monthly_core WHERE entity NOT IN (SELECT entity FROM dim)"),
    "con_not_null": query("SELECT * FROM raw_monthly WHERE entity IS NULL OR year IS NULL OR month IS NULL"),
    "con_domain": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')",
    "con_non_negative": query(
        "SELECT entity, day, water FROM fact WHERE hours < 0 OR oil < 0 OR gas < 0 OR water < 0 OR injection < 0"),
    "con_check_month": """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders
        WHERE month(o_orderdate) NOT BETWEEN 1 AND 6""",
    "con_propose": query(PROPOSED_SQL),
    "vw_dq_review": query("SELECT * FROM flags", REVIEW),
    "load_history": query("SELECT run, check_id, actual FROM runs_seen", PRIOR),
    "qc_results": query("SELECT * FROM qc", QC),
    "qc_rollup": query(
        """SELECT COUNT(*) AS total_checks, COUNT(*) FILTER (WHERE status = 'PASS') AS pass_count,
            COUNT(*) FILTER (WHERE status = 'REVIEW') AS review_count, COUNT(*) FILTER (WHERE status = 'FAIL') AS fail_count,
            CASE WHEN COUNT(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL'
                 WHEN COUNT(*) FILTER (WHERE status = 'REVIEW') > 0 THEN 'PASS WITH REVIEW' ELSE 'PASS' END AS overall_status
        FROM qc""", QC),
    "reconcile_checks": query(
        "SELECT 'QC-014' AS check_id, COUNT(*) AS actual FROM sides WHERE NOT in_m UNION ALL SELECT 'QC-015', COUNT(*) FROM sides WHERE NOT in_d "
        "UNION ALL SELECT 'QC-016', COUNT(*) FROM sides WHERE " + " OR ".join(f"abs(coalesce(d_{m}, 0) - coalesce(m_{m}, 0)) > 0.000001" for m in BOOKED), BOOKS),
    "reconcile_detail": query("SELECT * FROM detail", BOOKS),
    "reconcile_summary": query("SELECT * FROM rec_summary", BOOKS),
    "reconcile_mismatches": query("SELECT * FROM detail WHERE outcome = 'MISMATCH'", BOOKS),
    "reconcile_by_entity": query(
        """SELECT entity, metric, n_months, CAST((v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) * 0.5 AS DECIMAL(28,6)) AS median_pct_diff, max_abs_pct_diff
        FROM (SELECT entity, metric, COUNT(*) AS n_months, list_sort(list(pct_diff) FILTER (pct_diff IS NOT NULL)) AS v, MAX(abs(pct_diff)) AS max_abs_pct_diff
              FROM detail WHERE outcome IN ('MATCH', 'NULL_CONVENTION', 'MISMATCH') GROUP BY 1, 2)""", BOOKS),
    "reconcile_top_diffs": query(
        """SELECT metric, CAST(rn AS INTEGER) AS position, entity, year, month, daily_value, monthly_value, abs_diff, pct_diff, daily_rows,
            CAST(day(last_day(make_date(year, month, 1))) AS INTEGER) AS expected_days_in_month,
            daily_rows - day(last_day(make_date(year, month, 1))) AS daily_rows_vs_expected
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY abs(abs_diff) DESC, entity, year, month) AS rn
              FROM detail WHERE abs_diff IS NOT NULL) WHERE rn <= 3""", BOOKS),
    "reconcile_verdict": query(
        f"""SELECT {dec('r')} AS avg_accounted_for_rate, g AS coverage_gaps, CAST(m AS BIGINT) AS total_mismatches,
            CASE WHEN g = 0 AND r >= 99 THEN 'PASS' WHEN r >= 90 THEN 'PASS WITH REVIEW' ELSE 'FAIL' END AS verdict
        FROM (SELECT AVG(CAST(accounted_for_rate AS DOUBLE)) AS r, MAX(daily_only + monthly_only) AS g, SUM(mismatch) AS m
              FROM rec_summary)""", BOOKS),
    "nq_record_state": query("SELECT entity, day, record_state FROM stated", STATE_CTE),
    "nq_state_summary": query(
        f"""SELECT record_state, COUNT(*) AS row_count, {rratio('COUNT(*)', '(SELECT COUNT(*) FROM stated)', 2, 100, even=True)} AS pct,
            {COHERENT} AS coherent FROM stated GROUP BY record_state""", STATE_CTE),
    "nq_state_coherence": query(
        f"""SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE {COHERENT}) AS coherent_rows,
            COUNT(*) FILTER (WHERE NOT ({COHERENT})) AS to_interpret, COUNT(*) FILTER (WHERE record_state IS NULL) AS unclassified,
            {rratio(f'COUNT(*) FILTER (WHERE {COHERENT})', 'COUNT(*)', 2, 100, even=True)} AS coherent_pct FROM stated""", STATE_CTE),
    "nq_inconsistent_breakdown": query(
        " UNION ALL ".join(
            f"SELECT '{k}' AS explained_by, COUNT(*) FILTER (WHERE {c}) AS row_count FROM stated WHERE record_state = 'INCONSISTENT'"
            for k, c in {"total": "true", **WHY, "not covered": f"NOT ({' OR '.join(WHY.values())})"}.items()
        ), STATE_CTE),
    "nq_inconsistent_uncovered": query(
        f"""SELECT entity, day, state, mode, hours, oil, gas, water, injection FROM stated
        WHERE record_state = 'INCONSISTENT' AND NOT ({' OR '.join(WHY.values())})""", STATE_CTE),
    "nq_review_breakdown": query(
        "SELECT entity, state, mode, COUNT(*) AS row_count FROM stated WHERE record_state = 'REVIEW' GROUP BY 1, 2, 3", STATE_CTE),
}
