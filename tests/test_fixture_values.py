"""Known values of the two-entity fixture, through the published load."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from prodseries import SeriesSpec
from prodseries.operators import analysis, checks, constraints, dashboards as db, episodes, profile, reconcile, states, verdicts, views

D = dt.date
A, B = 90001, 90002


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_daily_keeps_unknown_activity(fixture):
    got = rows(views.daily(*fixture), "entity", "day")
    assert len(got) == 20
    assert got[A, D(2020, 1, 5)].is_active is False and got[A, D(2020, 1, 5)].oil == 0
    assert got[A, D(2020, 1, 6)].is_active is None and got[A, D(2020, 1, 6)].oil is None


def test_lifetime(fixture):
    got = rows(views.lifetime(*fixture), "entity")
    assert (got[A].total_oil, got[A].peak_daily_oil, got[A].recorded_days) == (888, 120, 10)
    assert (got[B].total_oil, got[B].total_water_injection, got[B].recorded_days) == (None, 2010, 10)
    assert (got[A].number_of_production_days, got[B].number_of_injection_days) == (8, 10)


def test_episodes(fixture):
    got = rows(episodes.downtime_episodes(*fixture), "entity")
    a, b = got[A], got[B]
    assert (a.shutdown_date, a.restart_date, a.offline_days) == (D(2020, 1, 5), D(2020, 1, 7), 2)
    assert (a.oil_before, a.oil_after, a.recovery_pct) == (108, 112, Decimal("103.7"))
    assert (b.shutdown_date, b.restart_date, b.offline_days) == (D(2020, 1, 5), D(2020, 1, 6), 1)
    assert (b.oil_before, b.oil_after, b.recovery_pct) == (None, None, None)


def test_transitions_and_outages(fixture):
    counts = rows(episodes.transition_counts(*fixture), "entity")
    assert [(counts[e].shutdowns, counts[e].restarts, counts[e].total_transitions) for e in (A, B)] == [(1, 1, 2)] * 2
    kpi = rows(db.outage_kpis(*fixture), "entity")[A]
    assert (kpi.completed_outages, kpi.still_down, kpi.total_offline_days, kpi.median_outage) == (1, 0, 2, 2)


def test_dominant_state_and_ranks(fixture):
    assert {k: r.state_label for k, r in rows(db.wells(*fixture), "entity").items()} == {A: "Producer", B: "Injector"}
    got = rows(analysis.ranking(*fixture), "entity")
    assert (got[A].oil_rank, got[B].oil_rank, got[B].injection_rank, got[A].injection_rank) == (1, 2, 1, 2)
    injectors = db.ranking_by_type(*fixture, "Injector").collect()
    assert [(r.entity, r.oil_rank) for r in injectors] == [(B, 2)]


def test_active_by_type(fixture):
    got = {(r.month_start, r.state): r.active_wells for r in db.active_by_type(*fixture).collect()}
    assert got == {(D(2020, 1, 1), "Producer"): 1, (D(2020, 1, 1), "Injector"): 1}


def test_field_kpis(fixture):
    r = db.field_kpis(fixture[0]).first()
    assert (r.total_oil, r.peak_oil_rate, r.peak_date) == (888, 120, D(2020, 1, 10))
    assert r.total_water_injection == 2010


def test_availability(fixture):
    got = rows(db.availability(fixture[0]), "entity")
    assert (got[A].known_hours_days, got[B].known_hours_days) == (9, 10)
    assert got[A].availability_pct == Decimal("88.888889") and got[B].availability_pct == Decimal("90.000000")


def test_selection(fixture):
    assert db.well_daily(fixture[0], [A]).count() == 10
    none = db.profiles(*fixture, entities=[])
    assert none.count() == 0 and "pct_of_peak" in none.columns
    assert db.decline(*fixture, entities=[B]).count() == 0
    assert db.history(*fixture, "15/9-TEST-A").count() == 10
    assert db.top_oil_by_year(*fixture, 2020).first().entity_name == "15/9-TEST-A"
    assert db.active_in_year(fixture[0], 2019).count() == 0


def test_profile_rows(fixture):
    got = {r.day.day: r for r in db.profiles(*fixture, [A], smooth=3).collect()}
    assert got[10].pct_of_peak == 100 and got[1].pct_of_peak == Decimal("83.3") and got[1].days_since_first_oil == 0
    # rows, not days: the blank day is skipped
    assert got[7].pct_of_peak_smoothed == Decimal("61.100000")


def test_reconciliation_matches(loaded, fixture):
    m = loaded[1]["monthly_reference"].withColumnsRenamed({
        "npd_well_bore_code": "entity", "reference_year": "year", "reference_month": "month", "on_stream_hrs": "hours",
        "oil_vol": "oil", "gas_vol": "gas", "water_vol": "water", "water_injection_vol": "injection"})
    detail = reconcile.reconcile(fixture[0], m)
    assert {(r.entity, r.metric): r.outcome for r in detail.collect()} == {
        (A, "hours"): "MATCH", (A, "oil"): "MATCH", (A, "gas"): "MATCH", (A, "water"): "MATCH", (A, "injection"): "NULL_CONVENTION",
        (B, "hours"): "MATCH", (B, "oil"): "NULL_CONVENTION", (B, "gas"): "NULL_CONVENTION", (B, "water"): "NULL_CONVENTION", (B, "injection"): "MATCH"}
    assert reconcile.verdict(detail).first().verdict == "PASS"


def test_checks_on_the_clean_fixture(loaded, fixture, spark):
    fact, dim = fixture
    core = loaded[1]
    m = core["monthly_reference"].withColumnsRenamed({
        "npd_well_bore_code": "entity", "reference_year": "year", "reference_month": "month", "on_stream_hrs": "hours",
        "oil_vol": "oil", "gas_vol": "gas", "water_vol": "water", "water_injection_vol": "injection"})
    raw = core["daily_production"].join(core["wellbore"], "npd_well_bore_code").withColumnsRenamed(
        {"npd_well_bore_code": "entity", "npd_well_bore_name": "entity_name"})
    expected = checks.Expected(20, 20, 2, 2, 2, {"DQ-001": 0, "DQ-002": 0, "DQ-003": 1, "DQ-004": 0, "DQ-005": 0, "DQ-006": 1})
    results = checks.run_checks(raw, fact, dim, m, m, checks.ReviewRules(), expected)
    assert {r.check_id: r.status for r in results.collect() if r.status == "FAIL"} == {}
    r = checks.rollup(results).first()
    assert (r.total_checks, r.pass_count, r.review_count, r.fail_count, r.overall_status) == (27, 21, 6, 0, "PASS WITH REVIEW")
    drift = checks.run_checks(raw, fact, dim, m, m, checks.ReviewRules(), checks.Expected())
    assert checks.rollup(drift).first().overall_status == "FAIL"
    ac = verdicts.run_assessment(raw, fact, m, m, checks.ReviewRules(), SeriesSpec(), 20, 2)
    assert ac.count() == 24 and {r.status for r in ac.collect()} == {"PASS"}


def test_states_and_review(fixture):
    got = {(r.entity, r.day.day): r.record_state for r in states.record_state(fixture[0]).collect()}
    assert (got[A, 1], got[A, 5], got[A, 6]) == ("ACTIVE_PRODUCTION", "INACTIVE_RECORDED", "BLANK_STATE_RECORD")
    assert (got[B, 1], got[B, 5]) == ("ACTIVE_INJECTION", "INCONSISTENT")
    flags = checks.review(fixture[0], checks.ReviewRules())
    assert {(r.entity, r.day.day, r.dq_issue) for r in flags.collect()} == {(A, 6, "DQ-003"), (B, 5, "DQ-006")}


def test_proposed_constraints(fixture):
    got = {r.rule: (r.violations, r.decision) for r in
           constraints.propose_constraints(fixture[0], constraints.daily_rules(fixture[0], SeriesSpec())).collect()}
    assert got["oil >= 0"] == (0, "ENFORCE")
    # zero violations is not enough where the meaning is not confirmed
    assert got["hours <= 24"] == (0, "DO NOT ENFORCE") and got["choke_size <= 100"] == (0, "DO NOT ENFORCE")


def test_views_answer_sql(spark, loaded):
    core = loaded[1]
    names = views.register_views(spark, core, SeriesSpec())
    assert len(names) == 6
    top = spark.sql("SELECT wellbore_name, total_oil FROM vw_well_lifetime_summary ORDER BY total_oil DESC NULLS LAST LIMIT 1").first()
    assert tuple(top) == ("15/9-TEST-A", 888)
    bound = spark.sql(
        "SELECT count(*) FROM vw_daily_well_performance WHERE array_contains(:codes, npd_well_bore_code) AND on_stream_hrs > 0",
        args={"codes": F.array(F.lit(A), F.lit(B))},
    ).first()[0]
    assert bound == 17
    comment = spark.table("vw_daily_well_performance").schema["bore_oil_vol"].metadata["comment"]
    assert "different from 0" in comment


def test_catalogue_and_inventory(spark, fixture, loaded):
    cat = views.describe_views(spark, views.all_views(*fixture), SeriesSpec()).collect()
    assert {r.view for r in cat} == set(views.VIEW_GRAIN)
    assert [r.null_meaning for r in cat if r.view == "vw_daily_well_performance" and r.column == "is_active"][0].startswith("hours not measured")
    inv = {r.table_name: r["columns"] for r in views.schema_inventory(spark, {f"core.{k}": v for k, v in loaded[1].items()}).collect()}
    assert inv["wellbore"] == 7 and inv["daily_production"] == 19
    roles = {r.column: r.role for r in profile.column_roles(spark, fixture[0], SeriesSpec()).collect()}
    assert roles["oil"] == "volume" and roles["downhole_pressure"] == "pressure" and roles["choke_unit"] == "unit label"


def test_run_profile(fixture, loaded, tmp_path, spark):
    from prodseries.sources.extracts import write_reports

    fact, dim = fixture
    raw = loaded[1]["monthly_reference"].withColumnsRenamed(
        {"npd_well_bore_code": "entity", "reference_year": "year", "reference_month": "month"})
    reports = profile.run_profile(fact, fact.join(dim, "entity").select("entity", "entity_name"), raw)
    assert len(write_reports(reports, str(tmp_path))) == 6
    numbers = {r.column: r for r in reports["numeric_profile_daily"].collect()}
    assert (numbers["oil"].value_count, numbers["oil"].zero_count, numbers["oil"].median) == (9, 1, 110)
    assert "choke_dp" in numbers


def test_explanations_and_gt(spark, fixture):
    assert checks.issue_explanations(spark).count() == 6
    got = {r.question: r.answer for r in db.answers(*fixture, checks.ReviewRules()).collect()}
    assert (got["top_oil"], got["no_oil"], got["max_active"]) == ("15/9-TEST-A", "15/9-TEST-B", "2")
    assert got["total_injection"] == "2010.000000" and got["most_over_24"] is None
