"""Shape of the physical plans."""

import re

import pytest

from prodseries.operators import analysis, checks, episodes, measures, profile, reconcile
from prodseries.plans import registry
from prodseries.sources import driver_tables as dt

SF = "/root/testdata/sf0.001"
# running totals and ranks over a table with one row per calendar month
BY_MONTH = {"a7_cumulative_injection", "a8_top_months", "a12_entry_effect", "dash_top_months", "dash_field_cumulative"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_python_no_cross_product(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "Scan ExistingRDD lineitem"):
        assert node not in text, node
    if name not in BY_MONTH:
        assert "SinglePartition" not in text or not re.search(r"\+- Window [^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", text)


def test_every_query_has_check_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_scan_reads_only_what_is_used(spark):
    text = plan(registry.QUERIES["nq_boundary"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert re.fullmatch(r"l_suppkey:bigint,l_shipdate:timestamp\w*", schema)


def test_filters_reach_the_scan(spark):
    fact = dt.daily_fact(spark, SF).where("entity = 7")
    assert "EqualTo(l_suppkey,7)" in plan(fact)
    # an entity filter passes below the windows, which are partitioned by entity
    chosen = episodes.downtime_episodes(dt.daily_fact(spark, SF), dt.dimension(spark, SF)).where("entity = 7")
    assert "EqualTo(l_suppkey,7)" in plan(chosen)


def test_episodes_share_one_exchange_and_never_join_the_fact(spark):
    stored = spark.read.parquet(SF + "/lineitem.parquet").selectExpr(
        "l_suppkey entity", "cast(l_shipdate as date) day", "cast(l_quantity as decimal(18,6)) hours", "cast(l_tax as decimal(18,6)) oil")
    text = plan(episodes.known_days(stored))
    assert text.count("Exchange") == 1 and "Join" not in text


def test_changes_shuffle_once_for_any_number_of_columns(spark):
    stored = dt.daily_fact(spark, SF)
    one, many = (plan(measures.changes(stored, c)) for c in (["oil"], ["oil", "gas", "water", "injection"]))
    assert one.count("Exchange") == many.count("Exchange") == 2


def test_rank_limits_run_before_the_shuffle(spark):
    fact = dt.daily_fact(spark, SF)
    monthly = reconcile.monthly_totals(fact).drop("daily_rows")
    assert "WindowGroupLimit" in plan(reconcile.top_differences(reconcile.reconcile(fact, monthly)))
    assert "WindowGroupLimit" in plan(profile.head_per_entity(fact, 3))


#: The most scans of lineitem in a query that asks several things of it, as it ran: what Spark reuses counts once.
SCANS = {"gt_answers": 2, "pf_run_summary": 3, "pf_monthly": 2, "nq_record_state": 1, "vw_lifetime": 1, "pf_duplicate_rows": 3, "a1_oil_rank": 2, "pf_numeric": 2, "qc_results": 4}


@pytest.mark.parametrize("name", SCANS)
def test_scans_are_limited(spark, name):
    df = registry.QUERIES[name](spark, SF)
    df.collect()
    ran = plan(df).split("Initial Plan")[0]
    assert "isFinalPlan=true" in ran and ran.count("l_suppkey:bigint") <= SCANS[name]


def test_review_is_one_scan(spark):
    assert plan(checks.review(dt.daily_fact(spark, SF), checks.ReviewRules())).count("FileScan") == 1


def test_peak_is_combined_before_the_shuffle(spark):
    text = plan(analysis.peak_oil(dt.daily_fact(spark, SF), dt.dimension(spark, SF)))
    assert "partial_max(struct" in text or "partial_max(named_struct" in text
