"""Dashboard reports, single-answer questions, register and verdicts on the driver tables."""

from __future__ import annotations

from prodseries.operators import categories as cat, checks, dashboards as db, temporal as tm, verdicts as vd, views
from prodseries.plans.load_queries import COUNTS, CONDS, DRIFT, PRIOR, REVIEW, RULES, SIDES, monthly_core, raw_pairs
from prodseries.plans.quality_queries import OUT_WINDOW, RAW, alls, change_cte, mapping
from prodseries.plans.sql import POS, POS_ANY, dec, pct, query, ratio, rratio, tot
from prodseries.sources.driver_tables import (
    ORDERS, customer_dimension, daily_fact as F_, dimension as D_, event_days, orders_series, raw_monthly,
)
from prodseries.spec import DRIVER

FLUIDS = ["oil", "gas", "water", "injection"]
COLUMNS = [*FLUIDS, "downhole", "wellhead"]
FLOORS = {"downhole": 10, "wellhead": 5}
# The columns of the raw daily rows, and the entities of a chosen report.
REQUIRED = ("dateprd", "entity", "entity_name", "well_bore_code", "on_stream_hrs", "bore_oil_vol", "bore_gas_vol", "bore_wat_vol",
            "bore_wi_vol", "flow_kind", "well_type")
CHOSEN = (3, 7, 12, -5)


def R_(s, d):
    return checks.review(F_(s, d), RULES)


def _assessment(s, d):
    return vd.run_assessment(
        raw_pairs(s, d), F_(s, d), raw_monthly(s, d), monthly_core(s, d), RULES, DRIVER, required=REQUIRED, drift=DRIFT, month_end=True
    )


def orders(s, d):
    """The order series in role names, with its dimension."""
    return ORDERS.fact(orders_series(s, d)), ORDERS.dimension(customer_dimension(s, d))


QUERIES = {
    "port_orders_monthly": lambda s, d: views.monthly(*orders(s, d)),
    "port_orders_coverage": lambda s, d: tm.coverage(*orders(s, d)),
    "port_orders_decline": lambda s, d: db.decline(*orders(s, d), checkpoints=(30,)),
    "port_event_transitions": lambda s, d: cat.transition_tally(event_days(s, d), "event_type"),
    "port_event_spans": lambda s, d: cat.spans(event_days(s, d), "event_type"),
    # the choice of entities is the feature of these: a list (with an unknown code) and an empty one
    "dash_well_monthly": lambda s, d: db.well_monthly(F_(s, d), D_(s, d), CHOSEN),
    "dash_well_lifetime": lambda s, d: db.well_lifetime(F_(s, d), D_(s, d), CHOSEN),
    "dash_well_episodes": lambda s, d: db.well_episodes(F_(s, d), D_(s, d), CHOSEN),
    "dash_profiles_chosen": lambda s, d: db.profiles(F_(s, d), D_(s, d), CHOSEN),
    "dash_decline_chosen": lambda s, d: db.decline(F_(s, d), D_(s, d), CHOSEN),
    "dash_snapshot_none": lambda s, d: db.snapshot(F_(s, d), []),
    "dash_wells": lambda s, d: db.wells(F_(s, d), D_(s, d)),
    "dash_field_kpis": lambda s, d: db.field_kpis(F_(s, d)),
    "dash_availability_month": lambda s, d: db.availability_by_month(F_(s, d)),
    "dash_well_summary": lambda s, d: db.well_summary(F_(s, d), D_(s, d)),
    "dash_contribution": lambda s, d: db.contribution(db.well_summary(F_(s, d), D_(s, d))),
    "dash_never_producers": lambda s, d: db.never_producers(db.well_summary(F_(s, d), D_(s, d))),
    "dash_field_monthly": lambda s, d: db.field_monthly(F_(s, d)),
    "dash_top_months": lambda s, d: db.analysis.top_months(F_(s, d), 25),
    "dash_active_by_type": lambda s, d: db.active_by_type(F_(s, d), D_(s, d)),
    "dash_active_totals": lambda s, d: db.active_totals(db.active_by_type(F_(s, d), D_(s, d), independent_minima=True)),
    "dash_last_active_month": lambda s, d: db.last_active_month(F_(s, d)),
    "dash_well_daily": lambda s, d: db.well_daily(F_(s, d), extra=("downhole", "wellhead")),
    "dash_well_transitions": lambda s, d: db.well_transitions(F_(s, d)),
    "dash_snapshot": lambda s, d: db.snapshot(F_(s, d)),
    "dash_availability": lambda s, d: db.availability(F_(s, d)),
    "dash_ranking": lambda s, d: db.analysis.ranking(F_(s, d), D_(s, d)),
    "dash_ranking_producers": lambda s, d: db.ranking_by_type(F_(s, d), D_(s, d), "Producer"),
    "dash_profiles": lambda s, d: db.profiles(F_(s, d), D_(s, d)),
    "dash_profiles_smoothed": lambda s, d: db.profiles(F_(s, d), D_(s, d), smooth=30),
    "dash_monthly_production": lambda s, d: db.monthly_production(F_(s, d), D_(s, d)),
    "dash_water_trends": lambda s, d: db.water_trends(F_(s, d), D_(s, d)),
    "dash_latest_ratio": lambda s, d: db.latest_ratio(db.water_trends(F_(s, d), D_(s, d))),
    "dash_decline": lambda s, d: db.decline(F_(s, d), D_(s, d)),
    "dash_decline_long": lambda s, d: db.decline_long(db.decline(F_(s, d), D_(s, d))),
    "dash_outage_kpis": lambda s, d: db.outage_kpis(F_(s, d), D_(s, d)),
    "dash_cumulative": lambda s, d: db.cumulative_oil(F_(s, d)),
    "dash_field_cumulative": lambda s, d: db.field_cumulative(F_(s, d)),
    "dash_field_ratio": lambda s, d: db.field_ratio(F_(s, d)),
    "dash_capabilities": lambda s, d: db.capabilities(F_(s, d)),
    "dash_dq_summary": lambda s, d: checks.review_summary(R_(s, d)),
    "dash_dq_detail": lambda s, d: checks.review_detail(R_(s, d), D_(s, d), "DQ-004"),
    "dash_dq_by_entity": lambda s, d: checks.review_by_entity(R_(s, d), D_(s, d)),
    "dash_dq_by_month": lambda s, d: checks.review_by_month(R_(s, d)),
    "gt_answers": lambda s, d: db.answers(F_(s, d), D_(s, d), RULES),
    "gt_top_oil_by_year": lambda s, d: db.top_oil_by_year(F_(s, d), D_(s, d)),
    "gt_history": lambda s, d: db.history(F_(s, d), D_(s, d)),
    "gt_active_in_year": lambda s, d: db.active_in_year(F_(s, d)),
    "nq_outlier_evidence": lambda s, d: vd.outlier_evidence(F_(s, d), COLUMNS, 25),
    "nq_issue_register": lambda s, d: vd.issue_register(F_(s, d), RULES),
    "nq_severity_counts": lambda s, d: vd.severity_counts(vd.issue_register(F_(s, d), RULES)),
    "nq_flag_overlap": lambda s, d: vd.flag_overlap(F_(s, d), RULES),
    "nq_section_findings": lambda s, d: vd.section_findings(F_(s, d), RULES, DRIVER, FLOORS),
    "nq_section_verdicts": lambda s, d: vd.section_verdicts(vd.section_findings(F_(s, d), RULES, DRIVER, FLOORS)),
    "nq_assessment": _assessment,
    "nq_assessment_outcomes": lambda s, d: vd.outcome_distribution(_assessment(s, d)),
}

# --- check SQL ---------------------------------------------------------------

MS = "CAST(date_trunc('month', day) AS DATE)"
AV = lambda h, n: pct(h, f"({n} * 24)")
DOM = {
    "dominant": """SELECT entity, state FROM (SELECT entity, state, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY COUNT(*) DESC, state) AS r
        FROM fact GROUP BY 1, 2) WHERE r = 1""",
    "wells": """SELECT d.entity, entity_name, state, CASE state WHEN 'OP' THEN 'Producer' WHEN 'WI' THEN 'Injector' ELSE state END AS state_label
        FROM dominant x JOIN dim d ON d.entity = x.entity""",
}
GRID = lambda start: {
    **DOM,
    "grid": f"""SELECT state_label, CAST(m AS DATE) AS month_start FROM (SELECT DISTINCT state_label FROM wells) CROSS JOIN
        (SELECT unnest(generate_series({start}, (SELECT CAST(MAX(day) AS TIMESTAMP) FROM fact), INTERVAL 1 MONTH)) AS m)""",
    "acts": f"""SELECT month_start, state_label, COUNT(*) AS n FROM (SELECT DISTINCT {MS} AS month_start, entity FROM fact WHERE hours > 0) a
        JOIN wells w ON w.entity = a.entity GROUP BY 1, 2""",
    "typed": """SELECT g.month_start, g.state_label AS state, coalesce(n, 0) AS active_wells FROM grid g
        LEFT JOIN acts a ON a.month_start = g.month_start AND a.state_label = g.state_label""",
}
FIRST = "(SELECT date_trunc('month', CAST(MIN(day) AS TIMESTAMP)) FROM fact)"
INDEP = "(SELECT CAST(make_date(MIN(year(day)), MIN(month(day)), 1) AS TIMESTAMP) FROM fact)"
SUMM = {
    "wsum": f"""SELECT l.entity, l.entity_name, total_oil, f.first_oil_date, peak_date, peak_volume AS peak_oil, av AS availability_pct,
        {pct('total_oil', '(SELECT SUM(total_oil) FROM lifetime)')} AS oil_pct_of_field FROM lifetime l
        LEFT JOIN (SELECT entity, MIN(day) AS first_oil_date FROM fact WHERE oil > 0 GROUP BY 1) f ON f.entity = l.entity
        LEFT JOIN peaks p ON p.entity = l.entity
        LEFT JOIN (SELECT entity, {rratio('SUM(hours)', '(COUNT(*) * 24)', 1, 100)} AS av FROM fact WHERE hours IS NOT NULL GROUP BY 1) a ON a.entity = l.entity"""
}
RANKED = {
    "ranked": """SELECT entity, entity_name, total_oil, RANK() OVER (ORDER BY total_oil DESC NULLS LAST) AS oil_rank,
        total_gas, RANK() OVER (ORDER BY total_gas DESC NULLS LAST) AS gas_rank, total_water, DENSE_RANK() OVER (ORDER BY total_water DESC NULLS LAST) AS water_rank,
        total_water_injection, RANK() OVER (ORDER BY total_water_injection DESC NULLS LAST) AS injection_rank FROM lifetime"""
}
PROF = {
    "prof": f"""SELECT f.entity, day, CAST(day - first AS INTEGER) AS days_since_first_oil, oil, {rratio('oil', 'peak', 1, 100)} AS pct_of_peak, entity_name
        FROM fact f JOIN (SELECT entity, MIN(day) FILTER (WHERE oil > 0) AS first, MAX(oil) AS peak FROM fact GROUP BY 1) b ON b.entity = f.entity
        JOIN dim d ON d.entity = f.entity WHERE oil IS NOT NULL AND day >= first"""
}
TREND = {
    "trend": f"""SELECT entity_name, make_date(year, month, 1) AS month_start, water_volume, oil_volume,
        {rratio('water_volume', 'oil_volume', 3)} AS water_oil_ratio FROM monthly"""
}
REG = {
    **REVIEW,
    "reg0": alls(f"SELECT '{a}' AS issue_id, '{b}' AS severity, '{c}' AS treatment, {str(e).lower()} AS needs_domain_input, '{f}' AS issue_status" for a, b, c, e, f in vd.REGISTER),
    "reg": "SELECT *, (SELECT COUNT(*) FROM flags WHERE dq_issue = issue_id) AS affected_records FROM reg0",
}


def top(src, value, name="entity_name"):
    return f"(SELECT {name} FROM {src} WHERE {value} IS NOT NULL ORDER BY {value} DESC, {name} LIMIT 1)"


ANSWERS = {
    "top_oil": top("lifetime", "total_oil"),
    "top_gas": top("lifetime", "total_gas"),
    "top_peak_oil": top("lifetime", "peak_daily_oil"),
    "no_oil": "(SELECT MIN(entity_name) FROM lifetime WHERE total_oil IS NULL)",
    "total_injection": f"(SELECT CAST({tot('total_water_injection')} AS VARCHAR) FROM lifetime)",
    "earliest_oil": "(SELECT entity_name FROM daily WHERE oil > 0 GROUP BY entity_name ORDER BY MIN(day), entity_name LIMIT 1)",
    "largest_decline_90": top("decline", "pct_decline_90_days"),
    "highest_oil_month": "(SELECT CAST(month_start AS VARCHAR) FROM field_monthly WHERE oil_volume IS NOT NULL ORDER BY oil_volume DESC, month_start LIMIT 1)",
    "max_active": "(SELECT CAST(MAX(active_wells) AS VARCHAR) FROM field_monthly)",
    "most_transitions": top("flip_counts", "total_transitions"),
    "most_over_24": "(SELECT entity_name FROM flags x JOIN dim d ON d.entity = x.entity WHERE dq_issue = 'DQ-004' GROUP BY entity_name ORDER BY COUNT(*) DESC, entity_name LIMIT 1)",
}
BEYOND = "ok AND abs(abs_change) * 100 > abs(previous_value) * 200"
EVID = {
    **change_cte(COLUMNS, ">"),
    "evid": "SELECT v.*, coalesce(a, 0) AS abrupt_changes, coalesce(b, 0) AS abrupt_changes_above_floor FROM ("
    + alls(f"SELECT '{c}' AS variable, COUNT(*) FILTER (WHERE {c} < 0) AS negative_values, COUNT(*) FILTER (WHERE hours = 0 AND {c} > 0) AS zero_hours_positive FROM fact" for c in COLUMNS)
    + f""") v LEFT JOIN (SELECT "column" AS c, COUNT(*) FILTER (WHERE {BEYOND}) AS a, COUNT(*) FILTER (WHERE {BEYOND} AND abs(abs_change) >= 25) AS b FROM diffs GROUP BY 1) j ON j.c = v.variable""",
}
MOVING = "(state = 'WI' AND mode = 'production')"
FOUND = [
    ("production", "negative volume", "oil < 0 OR gas < 0 OR water < 0"),
    ("production", "production in injection mode", f"mode = 'injection' AND {POS}"),
    ("production", "unexplained injector production", f"state = 'WI' AND {POS} AND NOT {MOVING}"),
    ("production", "production with zero hours", f"hours = 0 AND {POS}"),
    ("injection", "negative injection", "injection < 0"),
    ("injection", "injection outside injection state", "injection > 0 AND (state = 'OP' OR mode = 'production')"),
    ("injection", "blank record with measurement", f"({CONDS['DQ-001']} OR hours IS NULL) AND {POS_ANY}"),
    ("injection", "large injection with zero hours", CONDS["DQ-006"]),
    ("sensors", "downhole below wellhead", "downhole < wellhead"),
    ("sensors", "negative downhole", "downhole < 0"),
    ("sensors", "negative wellhead", "wellhead < 0"),
    ("choke", "above 100", "wellhead > 100"),
    ("choke", "zero with production", f"wellhead = 0 AND {POS}"),
    ("choke", "zero with injection", "wellhead = 0 AND injection > 0"),
    ("choke", "open with zero hours", "wellhead > 0 AND hours = 0"),
    ("choke", "open without hours", "wellhead > 0 AND hours IS NULL"),
]
SECT = {
    **change_cte(["oil", "gas", "water", "downhole", "wellhead"], "<>"),
    "sect": alls(f"SELECT '{s}' AS section, '{f}' AS finding, COUNT(*) FILTER (WHERE {c}) AS row_count FROM fact" for s, f, c in FOUND)
    + f""" UNION ALL SELECT CASE WHEN "column" IN ('oil', 'gas', 'water') THEN 'production' WHEN "column" = 'wellhead' THEN 'choke' ELSE 'sensors' END,
        'abrupt change', COUNT(*) FROM diffs WHERE {BEYOND}
        AND abs(abs_change) >= CASE "column" WHEN 'downhole' THEN 10 WHEN 'wellhead' THEN 5 ELSE 0 END GROUP BY 1""",
}
AC = {
    "AC-01": "SELECT CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END FROM fact",
    "AC-02": "SELECT CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END FROM raw_monthly",
    "AC-03": "SELECT 0",
    "AC-04": "SELECT COUNT(*) FROM fact WHERE day IS NULL",
    "AC-05": COUNTS["QC-006"], "AC-06": COUNTS["QC-007"],
    "AC-07": "SELECT COUNT(*) FROM raw_monthly WHERE entity IS NULL AND year IS NULL AND month IS NULL",
    "AC-08": f"SELECT (SELECT COUNT(*) FROM ({mapping('entity', 'entity_name')})) + (SELECT COUNT(*) FROM ({mapping('entity_name', 'entity')}))",
    "AC-09": f"SELECT ({COUNTS['QC-012']}) + ({COUNTS['QC-013']})",
    "AC-10": "SELECT COUNT(*) FROM fact WHERE hours < 0",
    "AC-11": "SELECT COUNT(*) FROM fact WHERE hours > 24",
    "AC-12": COUNTS["QC-019"], "AC-13": COUNTS["QC-020"],
    "AC-14": "SELECT COUNT(*) FROM fact WHERE oil < 0 OR gas < 0",
    "AC-15": "SELECT COUNT(*) FROM fact WHERE water < 0",
    "AC-16": "SELECT COUNT(*) FROM fact WHERE injection < 0",
    "AC-17": "SELECT COUNT(*) FROM fact WHERE injection > 0 AND state = 'OP' AND mode = 'production'",
    "AC-18": "SELECT COUNT(*) FROM fact WHERE downhole < 0",
    "AC-19": "SELECT 0",
    "AC-20": "SELECT COUNT(*) FROM fact WHERE wellhead < 0",
    "AC-21": "SELECT COUNT(*) FROM fact WHERE wellhead > 100",
    "AC-22": f"SELECT ({COUNTS['QC-014']}) + ({COUNTS['QC-015']}) + ({COUNTS['QC-016']})",
    "AC-23": " + ".join(
        f"(SELECT CASE WHEN abs(COUNT(*) - want) > floor(CAST({DRIFT} AS DOUBLE) * want) THEN 1 ELSE 0 END "
        f"FROM {t}, (SELECT want FROM prior_run WHERE check_id = '{i}') GROUP BY want)"
        for i, t in (("QC-002", "fact"), ("QC-005", "monthly_core"))
    ),
    "AC-24": f"SELECT COUNT(*) FROM fact WHERE {OUT_WINDOW}",
}
ASSESS = {
    **RAW, **SIDES, **PRIOR,
    "ac": alls(
        f"SELECT CAST({i} AS INTEGER) AS sort_order, '{c.check_id}' AS check_id, '{c.category}' AS category, '{c.check_name}' AS check_name, "
        f"'{c.expected}' AS expected, CAST(n AS VARCHAR) AS actual, CASE WHEN n = {c.expected} THEN 'PASS' ELSE '{'FAIL' if c.hard else 'REVIEW'}' END AS status "
        f"FROM (SELECT ({AC[c.check_id]}) AS n)"
        for i, c in enumerate(vd.assessment_checks(), 1)
    ),
}
DEC_LONG = alls(
    f"SELECT entity, entity_name, peak_date, peak_volume, CAST({n} AS INTEGER) AS days_after_peak, oil_{n}_days_after_peak AS oil, pct_decline_{n}_days AS pct_decline FROM decline"
    for n in (30, 90, 365)
)

ORD = {
    "ofact": """SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS day, CAST(COUNT(*) AS DECIMAL(18,6)) AS n,
        CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,6)) AS price,
        CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'O') AS DECIMAL(18,6)) AS open_price FROM orders GROUP BY 1, 2""",
    "ogap": "SELECT entity, day, CAST(day - LAG(day) OVER (PARTITION BY entity ORDER BY day) AS INTEGER) AS gap_days FROM ofact",
    "opeak": "SELECT entity, day AS peak_date, price AS peak_volume FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY price DESC, day) AS r FROM ofact) WHERE r = 1",
}
EVT = {
    "eday": """SELECT entity, day, event_type FROM (SELECT user_id AS entity, CAST(ts AS DATE) AS day, event_type,
        ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""",
    "emove": "SELECT event_type AS current, LAG(event_type) OVER (PARTITION BY entity ORDER BY day) AS previous FROM eday",
}
ORACLES = {
    "port_orders_monthly": query(
        f"""SELECT entity, c_name AS entity_name, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, {tot('n')} AS on_stream_hours,
        {tot('price')} AS oil_volume, {tot('price')} AS gas_volume, {tot('n')} AS water_volume, {tot('open_price')} AS water_injection_volume,
        COUNT(*) AS producing_days, COUNT(*) AS calendar_records FROM ofact JOIN customer ON c_custkey = entity GROUP BY 1, 2, 3, 4""", ORD),
    "port_orders_coverage": query(
        f"""SELECT entity, c_name AS entity_name, MIN(day) AS first_date, MAX(day) AS last_date, CAST(MAX(day) - MIN(day) + 1 AS INTEGER) AS calendar_span_days,
        COUNT(*) AS recorded_days, MAX(day) - MIN(day) + 1 - COUNT(*) AS unrecorded_calendar_days,
        {rratio('COUNT(*)', '(MAX(day) - MIN(day) + 1)', 2, 100, even=True)} AS coverage_pct, coalesce(MAX(gap_days), 0) AS max_gap_days,
        COUNT(*) FILTER (WHERE gap_days > 1) AS gaps_gt_1, COUNT(*) FILTER (WHERE gap_days > 7) AS gaps_gt_7, COUNT(*) FILTER (WHERE gap_days > 30) AS gaps_gt_30
        FROM ogap JOIN customer ON c_custkey = entity GROUP BY 1, 2""", ORD),
    "port_orders_decline": query(
        f"""SELECT p.entity, c_name AS entity_name, peak_date, peak_volume, f.price AS oil_30_days_after_peak,
        {rratio('(peak_volume - f.price)', 'peak_volume', 1, 100)} AS pct_decline_30_days
        FROM opeak p JOIN customer ON c_custkey = p.entity LEFT JOIN ofact f ON f.entity = p.entity AND f.day = peak_date + 30""", ORD),
    "port_event_transitions": query(
        "SELECT previous || '->' || current AS transition, COUNT(*) AS row_count FROM emove WHERE previous IS NOT NULL GROUP BY 1", EVT),
    "port_event_spans": query(
        "SELECT entity, event_type AS value, COUNT(*) AS row_count, MIN(day) AS first_date, MAX(day) AS last_date FROM eday GROUP BY 1, 2", EVT),
    "dash_well_monthly": query(f"SELECT * FROM monthly WHERE entity IN {CHOSEN}"),
    "dash_well_lifetime": query(f"SELECT * FROM lifetime WHERE entity IN {CHOSEN}"),
    "dash_well_episodes": query(f"SELECT * FROM episodes WHERE entity IN {CHOSEN}"),
    "dash_profiles_chosen": query(f"SELECT * FROM prof WHERE entity IN {CHOSEN}", PROF),
    "dash_decline_chosen": query(f"SELECT * FROM decline WHERE entity IN {CHOSEN}"),
    "dash_snapshot_none": query(
        """SELECT entity, day AS latest_record_date, oil AS latest_oil_rate, hours > 0 AS latest_is_active, day AS first_oil_date
        FROM fact WHERE false"""),
    "dash_wells": query("SELECT * FROM wells", DOM),
    "dash_field_kpis": query(
        f"""SELECT {tot('oil')} AS total_oil, {tot('gas')} AS total_gas, {tot('water')} AS total_water, {tot('injection')} AS total_water_injection,
        MIN(day) AS first_record_date, MAX(day) AS last_record_date, (SELECT day FROM days ORDER BY v DESC, day LIMIT 1) AS peak_date,
        (SELECT MAX(v) FROM days) AS peak_oil_rate, {ratio('(MAX(day) - MIN(day))', '365.25')} AS field_life_years FROM fact""",
        {"days": f"SELECT day, {tot('oil')} AS v FROM fact WHERE oil IS NOT NULL GROUP BY day"}),
    "dash_availability_month": query(
        f"SELECT {MS} AS month_start, {tot('hours')} AS total_hours, COUNT(*) AS known_hours_days, {AV('SUM(hours)', 'COUNT(*)')} AS availability_pct FROM fact WHERE hours IS NOT NULL GROUP BY 1"),
    "dash_well_summary": query("SELECT * FROM wsum", SUMM),
    "dash_contribution": query("SELECT entity_name, total_oil, oil_pct_of_field FROM wsum WHERE oil_pct_of_field IS NOT NULL", SUMM),
    "dash_never_producers": query("SELECT entity_name FROM wsum WHERE total_oil IS NULL", SUMM),
    "dash_field_monthly": query("SELECT * EXCLUDE (year, month) FROM field_monthly"),
    "dash_top_months": query(
        """SELECT month_start, oil_volume, RANK() OVER (ORDER BY oil_volume DESC) AS oil_rank FROM field_monthly
        WHERE oil_volume IS NOT NULL ORDER BY oil_rank, month_start LIMIT 25"""),
    "dash_active_by_type": query("SELECT * FROM typed", GRID(FIRST)),
    "dash_active_totals": query("SELECT month_start, CAST(SUM(active_wells) AS BIGINT) AS active_wells FROM typed GROUP BY 1", GRID(INDEP)),
    "dash_last_active_month": query("SELECT month_start, active_wells FROM field_monthly WHERE active_wells > 0 ORDER BY month_start DESC LIMIT 1"),
    "dash_well_daily": query("SELECT entity, day, oil, gas, water, injection, hours, hours > 0 AS is_active, downhole, wellhead FROM fact"),
    "dash_well_transitions": query("SELECT * FROM flips"),
    "dash_snapshot": query(
        """SELECT k.entity, day AS latest_record_date, oil AS latest_oil_rate, is_active AS latest_is_active, first_oil_date
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY day DESC) AS r FROM known) k
        LEFT JOIN (SELECT entity, MIN(day) AS first_oil_date FROM fact WHERE oil > 0 GROUP BY 1) f ON f.entity = k.entity WHERE r = 1"""),
    "dash_availability": query(
        f"SELECT entity, {tot('hours')} AS total_hours, COUNT(hours) AS known_hours_days, {AV('SUM(hours)', 'COUNT(hours)')} AS availability_pct FROM fact GROUP BY 1"),
    "dash_ranking": query("SELECT * FROM ranked", RANKED),
    "dash_ranking_producers": query(
        "SELECT r.*, state_label FROM ranked r JOIN wells w ON w.entity = r.entity WHERE state_label = 'Producer'", {**RANKED, **DOM}),
    "dash_profiles": query("SELECT * FROM prof", PROF),
    "dash_profiles_smoothed": query(
        f"""SELECT *, {ratio('SUM(pct_of_peak) OVER w', 'COUNT(pct_of_peak) OVER w')} AS pct_of_peak_smoothed FROM prof
        WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""", PROF),
    "dash_monthly_production": query(
        "SELECT entity_name, make_date(year, month, 1) AS month_start, oil_volume, gas_volume, water_volume, water_injection_volume FROM monthly"),
    "dash_water_trends": query("SELECT * FROM trend", TREND),
    "dash_latest_ratio": query(
        """SELECT entity_name, month_start, water_oil_ratio FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_name ORDER BY month_start DESC) AS r
        FROM trend WHERE water_oil_ratio IS NOT NULL) WHERE r = 1""", TREND),
    "dash_decline": query("SELECT * FROM decline"),
    "dash_decline_long": query(f"SELECT * FROM decline_long", {"decline_long": DEC_LONG}),
    "dash_outage_kpis": query(
        """SELECT entity, entity_name, COUNT(restart_date) AS completed_outages, COUNT(*) FILTER (WHERE restart_date IS NULL) AS still_down,
        CAST(SUM(offline_days) AS BIGINT) AS total_offline_days, MAX(offline_days) AS longest_outage,
        CAST(quantile_cont(CAST(offline_days AS DOUBLE), 0.5) AS DECIMAL(18,6)) AS median_outage, COUNT(restart_date) AS restarts FROM episodes GROUP BY 1, 2"""),
    "dash_cumulative": query(
        f"SELECT entity, day, {dec('SUM(coalesce(oil, 0)) OVER (PARTITION BY entity ORDER BY day ROWS UNBOUNDED PRECEDING)')} AS cumulative_oil FROM fact"),
    "dash_field_cumulative": query(
        f"""SELECT month_start, {dec('SUM(coalesce(oil_volume, 0)) OVER (ORDER BY month_start)')} AS cumulative_oil,
        CASE WHEN water_injection_volume IS NOT NULL THEN {dec('SUM(water_injection_volume) OVER (ORDER BY month_start)')} END AS cumulative_water_injection FROM field_monthly"""),
    "dash_field_ratio": query(f"SELECT month_start, {ratio('water_volume', 'oil_volume')} AS water_oil_ratio FROM field_monthly"),
    "dash_capabilities": query(
        """SELECT entity, BOOL_OR(oil IS NOT NULL) AS has_oil, BOOL_OR(coalesce(injection > 0, false)) AS has_injection, BOOL_OR(water IS NOT NULL) AS has_water,
        BOOL_OR(downhole IS NOT NULL OR wellhead IS NOT NULL) AS has_sensors FROM fact GROUP BY 1"""),
    "dash_dq_summary": query(
        """SELECT dq_issue, COUNT(*) AS record_count, COUNT(DISTINCT entity) AS affected_wells, MIN(day) AS earliest_date, MAX(day) AS latest_date
        FROM flags GROUP BY 1""", REVIEW),
    "dash_dq_detail": query("SELECT entity_name, day, review_reason FROM flags x JOIN dim d ON d.entity = x.entity WHERE dq_issue = 'DQ-004'", REVIEW),
    "dash_dq_by_entity": query("SELECT dq_issue, entity_name, COUNT(*) AS record_count FROM flags x JOIN dim d ON d.entity = x.entity GROUP BY 1, 2", REVIEW),
    "dash_dq_by_month": query(f"SELECT dq_issue, {MS} AS month, COUNT(*) AS record_count FROM flags GROUP BY 1, 2", REVIEW),
    "gt_answers": query(alls(f"SELECT '{k}' AS question, {v} AS answer" for k, v in ANSWERS.items()), REVIEW),
    "gt_top_oil_by_year": query(
        """SELECT year, entity_name, oil_volume FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY year ORDER BY oil_volume DESC, entity_name) AS r FROM (
            SELECT year, entity_name, CAST(SUM(oil_volume) AS DECIMAL(28,6)) AS oil_volume FROM monthly GROUP BY 1, 2) WHERE oil_volume IS NOT NULL) WHERE r = 1"""),
    "gt_history": query("SELECT entity_name, day, oil, gas, water, injection, hours FROM daily"),
    "gt_active_in_year": query("SELECT month_start, active_wells FROM field_monthly"),
    "nq_outlier_evidence": query(
        """SELECT *, CASE WHEN negative_values + zero_hours_positive + abrupt_changes + abrupt_changes_above_floor > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM evid""", EVID),
    "nq_issue_register": query("SELECT * FROM reg", REG),
    "nq_severity_counts": query("SELECT severity, COUNT(*) AS issues, CAST(SUM(affected_records) AS BIGINT) AS affected_records FROM reg GROUP BY 1", REG),
    "nq_flag_overlap": query(
        """SELECT CAST(SUM(n) AS BIGINT) AS flags, COUNT(*) AS flagged_records, COUNT(*) FILTER (WHERE n > 1) AS records_with_several_flags
        FROM (SELECT COUNT(*) AS n FROM flags GROUP BY entity, day)""", REVIEW),
    "nq_section_findings": query("SELECT * FROM sect", SECT),
    "nq_section_verdicts": query(
        """SELECT section, COUNT(*) FILTER (WHERE row_count > 0) AS open_findings,
        CASE WHEN COUNT(*) FILTER (WHERE row_count > 0) > 0 THEN 'PASS WITH REVIEW' ELSE 'PASS' END AS verdict FROM sect GROUP BY 1""", SECT),
    "nq_assessment": query("SELECT * FROM ac", ASSESS),
    "nq_assessment_outcomes": query("SELECT status, COUNT(*) AS checks FROM ac GROUP BY 1", ASSESS),
}
