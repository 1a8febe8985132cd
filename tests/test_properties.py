"""Operators against plain Python on random series with gaps, blanks, zeros, ties and one hot entity."""

import datetime as dt
import random
import tempfile
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from prodseries.functions.expr import clock_change_day, days_in_month
from prodseries.functions.order_stats import exact_percentiles, global_ranks
from prodseries.operators import analysis, categories, checks, dashboards as db, episodes, measures, missingness, profile, reconcile, states, temporal, views

SCHEMA = ("entity bigint, day date, state string, mode string, hours decimal(18,6), oil decimal(18,6), gas decimal(18,6), "
          "water decimal(18,6), injection decimal(18,6), downhole decimal(18,6), wellhead decimal(18,6)")
START = dt.date(2019, 11, 3)


def make_rows(seed=7, entities=25):
    rnd = random.Random(seed)
    out = []
    for e in range(entities):
        # entity 0 holds about a third of all rows
        for n in range(900 if e == 0 else 120):
            if rnd.random() < 0.25:
                continue
            pick = lambda *xs: Decimal(rnd.choice(xs)) if (x := rnd.random()) > 0.25 else None
            hours = rnd.choice([None, 0, 0, 24, 24, 25, 12])
            out.append((
                e, START + dt.timedelta(days=n), rnd.choice(["OP", "OP", "WI"]), rnd.choice(["production", "injection"]),
                None if hours is None else Decimal(hours), None if e == 3 else pick(0, 1, 5, 40, 40), pick(0, 7, 900), pick(-2, 0, 3),
                pick(0, 60, 150), pick(10, 20), pick(15, 0),
            ))
    return out


ROWS = make_rows()


@pytest.fixture(scope="module")
def fact(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([(e, f"E{e:02d}") for e in range(26)], "entity bigint, entity_name string")


def series():
    by = defaultdict(list)
    for r in sorted(ROWS):
        by[r[0]].append(r)
    return by


def brute_episodes():
    out = []
    for e, rs in series().items():
        oil = {r[1]: r[5] for r in rs}
        known = [(r[1], r[4] > 0) for r in rs if r[4] is not None]
        runs = []
        for day, active in known:
            if not runs or runs[-1][1] != active:
                runs.append((day, active))
        for i, (day, active) in enumerate(runs):
            if i == 0 or active:
                continue
            back = runs[i + 1][0] if i + 1 < len(runs) else None
            out.append((e, day, back, oil.get(day - dt.timedelta(days=1)), oil.get(back)))
    return sorted(out, key=str)


def test_episodes(fact, dim):
    got = [(r.entity, r.shutdown_date, r.restart_date, r.oil_before, r.oil_after) for r in episodes.downtime_episodes(fact, dim).collect()]
    assert sorted(got, key=str) == brute_episodes()


def test_transitions_match_episodes(fact, dim):
    counts = {r.entity: r for r in episodes.transition_counts(fact, dim).collect()}
    downs = Counter(e for e, *_ in brute_episodes())
    for e, r in counts.items():
        assert r.total_transitions == r.shutdowns + r.restarts and abs(r.shutdowns - r.restarts) <= 1
        assert r.shutdowns == downs.get(e, 0)


def test_checkpoints(fact, dim):
    want = {}
    for e, rs in series().items():
        oil = {r[1]: r[5] for r in rs if r[5] is not None}
        if not oil:
            continue
        top = max(oil.values())
        day = min(d for d, v in oil.items() if v == top)
        want[e] = (day, top, *[oil.get(day + dt.timedelta(days=n)) for n in (30, 90)])
    got = {r.entity: (r.peak_date, r.peak_volume, r.oil_30_days_after_peak, r.oil_90_days_after_peak)
           for r in analysis.peak_checkpoints(fact, dim, (30, 90)).collect()}
    assert got == want


def test_zero_peak_has_no_percentage(spark, dim):
    f = spark.createDataFrame([(1, START + dt.timedelta(days=n), "OP", "production", None, Decimal(0), None, None, None, None, None)
                               for n in (0, 30)], SCHEMA)
    r = analysis.peak_checkpoints(f, dim, (30,)).first()
    assert (r.peak_date, r.oil_30_days_after_peak, r.pct_decline_30_days) == (START, 0, None)


@pytest.mark.parametrize("guard", ["positive", "nonzero"])
def test_abrupt_changes(fact, guard):
    want = set()
    for e, rs in series().items():
        for col, i in (("oil", 5), ("water", 7)):
            prev = None
            for r in rs:
                if r[i] is None:
                    continue
                if prev is not None:
                    usable = prev[i] > 0 if guard == "positive" else prev[i] != 0
                    if usable and abs((r[i] - prev[i]) / prev[i] * 100) > 200 and abs(r[i] - prev[i]) >= 3:
                        want.add((col, e, prev[1], r[1]))
                prev = r
    got = measures.abrupt_changes(fact, ["oil", "water"], floor=3, guard=guard).collect()
    assert {(r.column, r.entity, r.previous_date, r.current_date) for r in got} == want and len(got) == len(want)
    flags = {(r.column, r.floor): r.flags for r in measures.floor_sensitivity(fact, ["oil", "water"], [0, 3], guard=guard).collect()}
    assert flags["oil", 3] == sum(w[0] == "oil" for w in want) and flags["oil", 0] >= flags["oil", 3]


def test_states_partition_the_rows(fact):
    counts = {r.record_state: r.row_count for r in states.state_summary(fact).collect()}
    assert sum(counts.values()) == len(ROWS) and None not in counts
    assert counts["TRANSITION_STATE"] == sum(r[2] == "WI" and r[3] == "production" for r in ROWS)


def test_presence_adds_up_to_the_span(fact, dim):
    for r in temporal.presence(fact, dim).collect():
        days = [x[1] for x in ROWS if x[0] == r.entity]
        assert r.no_record_days + r.active_days + r.inactive_days + r.hours_missing_days == (max(days) - min(days)).days + 1


def test_gaps(fact, dim):
    want = set()
    for e, rs in series().items():
        want |= {(e, a[1], b[1]) for a, b in zip(rs, rs[1:]) if (b[1] - a[1]).days > 3}
    assert {(r.entity, r.previous_record_date, r.next_record_date) for r in temporal.gaps(fact, dim, 3).collect()} == want


def test_sums_agree(fact, dim):
    oil = sum(r[5] for r in ROWS if r[5] is not None)
    assert views.monthly(fact, dim).agg(F.sum("oil_volume")).first()[0] == oil
    assert views.field_monthly(fact).agg(F.sum("oil_volume")).first()[0] == oil
    shares = analysis.yearly_share(fact, dim).groupBy("year").agg(F.sum("pct_of_year_total").alias("s")).collect()
    assert all(abs(r.s - 100) <= Decimal("1.5") for r in shares)
    lonely = views.lifetime(fact, dim).where(F.col("entity") == 3).first()
    assert lonely.total_oil is None and lonely.peak_daily_oil is None


def test_dominant_state_ties_and_snapshot(spark, dim):
    day = lambda n: START + dt.timedelta(days=n)
    rows = [(1, day(0), "WI", "injection", Decimal(24), *[None] * 6), (1, day(1), "OP", "production", None, *[None] * 6),
            (2, day(0), "WI", "injection", None, *[None] * 6)]
    f = spark.createDataFrame(rows, SCHEMA)
    assert {r.entity: r.state for r in db.wells(f, dim).collect()} == {1: "OP", 2: "WI"}
    snap = db.snapshot(f).collect()
    assert [(r.entity, r.latest_record_date) for r in snap] == [(1, day(0))]
    assert {r.entity: r.availability_pct for r in db.availability(f).collect()}[2] is None


def test_grid_start_options(spark, dim):
    f = spark.createDataFrame([(1, dt.date(2018, 11, 5), "OP", "production", Decimal(24), *[None] * 6),
                               (1, dt.date(2019, 2, 5), "OP", "production", Decimal(24), *[None] * 6)], SCHEMA)
    months = [(r.month_start.month, r.active_wells) for r in db.active_by_type(f, dim).orderBy("month_start").collect()]
    assert months == [(11, 1), (12, 0), (1, 0), (2, 1)]
    first = db.active_by_type(f, dim, independent_minima=True).agg(F.min("month_start")).first()[0]
    assert first == dt.date(2018, 2, 1)


def test_magnitude_edges(spark):
    f = spark.createDataFrame([(1, START, "WI", "injection", Decimal(0), None, None, None, Decimal(v), None, None)
                               for v in ("0.5", "1", "99.9", "100", "100.1")], SCHEMA)
    assert {r.magnitude: r.row_count for r in measures.magnitude_bins(f).collect()} == {"trace": 1, "moderate": 2, "large": 2}
    # exactly 100 is in the large bin and still not flagged
    assert measures.large_idle_injection(f).count() == 1
    assert {r.injection for r in checks.review(f, checks.ReviewRules()).join(f, "entity").select("injection").distinct().collect()}


def test_documented_rules(spark):
    day = dt.date
    blank = [None] * 3
    f = spark.createDataFrame([
        (5693, day(2011, 6, 18), "WI", "injection", Decimal(0), *blank, Decimal("6263.69"), None, None),
        (5351, day(2011, 6, 18), "WI", "injection", Decimal(0), *blank, Decimal("6263.69"), None, None),
        (7078, day(2015, 1, 17), "OP", "production", Decimal(0), Decimal(1026), None, None, None, None, None),
        (7078, day(2015, 1, 18), "OP", "production", Decimal(0), Decimal(1026), None, None, None, None, None),
        (5351, day(2012, 1, 2), "OP", "production", Decimal(24), *blank, None, None, None),
        (5351, day(2012, 1, 3), "OP", "production", Decimal(24), *blank, None, None, None),
        (9999, day(2012, 1, 3), "OP", "production", Decimal(24), *blank, None, None, None),
        (9999, day(2007, 12, 31), "OP", "production", Decimal(24), *blank, None, None, None),
    ], SCHEMA)
    rules = checks.SNAPSHOT_RULES
    assert {(r.entity, r.dq_issue) for r in checks.review(f, rules).collect()} == {(5693, "DQ-006"), (7078, "DQ-005"), (9999, "DQ-001")}
    assert f.where(rules.in_gap()).count() == 1
    edges = measures.sensors_around_issues(f, rules, ["downhole"]).where("dq_issue = 'DQ-002'").collect()
    assert [(r.entity, r.day) for r in edges] == [(5351, day(2012, 1, 2))]


def test_shared_days_and_dates(spark):
    years = spark.createDataFrame([(y,) for y in (2008, 2009, 2010, 2013, 2014)], "y int")
    got = {r.y: r.d for r in years.select("y", clock_change_day("y").alias("d")).collect()}
    assert got == {2008: dt.date(2008, 10, 26), 2009: dt.date(2009, 10, 25), 2010: dt.date(2010, 10, 31),
                   2013: dt.date(2013, 10, 27), 2014: dt.date(2014, 10, 26)}
    assert spark.range(1).select(days_in_month(F.lit(dt.date(2020, 2, 3)))).first()[0] == 29


def test_date_integrity(spark):
    df = spark.createDataFrame([("2020-01-01",), ("not a date",), (None,), ("2020-02-30",)], "d string")
    r = temporal.date_integrity(df, "d").first()
    assert (r.parsed_rows, r.missing_dates, r.invalid_dates) == (1, 1, 2)


def test_reconcile_modes(spark, fact):
    m = reconcile.monthly_totals(fact).drop("daily_rows")
    near = m.withColumn("oil", (F.col("oil") + F.lit(Decimal("0.000001"))).cast("decimal(28,6)"))
    # the check flags differences above the tolerance, the report accepts only those below it
    assert reconcile.mismatch_counts(fact, near).first()["QC-016"] == 0
    detail = reconcile.reconcile(fact, near, metrics=("oil",))
    both = m.where(F.col("oil").isNotNull()).count()
    assert detail.where(F.col("outcome") == "MISMATCH").count() == both
    assert reconcile.reconcile(fact, near, metrics=("oil",), tolerance=0.01).where(F.col("outcome") == "MATCH").count() == both


def test_order_books_are_a_source_of_their_own(spark):
    """Lines against heads of orders, by plain Python; no row is planted."""
    from collections import defaultdict

    from prodseries.sources import driver_tables as tables

    sf = "/root/testdata/sf0.001"
    heads = {r.o_orderkey: r for r in tables.table(spark, sf, "orders").collect()}
    cents = lambda x: int(x * 100 + 0.5)
    lines, books = defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list))
    for r in tables.table(spark, sf, "lineitem").collect():
        head = heads[r.l_orderkey]
        key, price = (head.o_custkey, head.o_orderdate.year, head.o_orderdate.month), Decimal(cents(r.l_extendedprice) * (100 - cents(r.l_discount))) / 10000
        lines[key]["orders"].append(r.l_orderkey)
        lines[key]["days"].append(head.o_orderdate.date())
        for name in ("amount", {"F": "finished", "O": "open"}[r.l_linestatus]):
            lines[key][name].append(price)
    for r in heads.values():
        if (r.o_orderstatus, r.o_orderpriority) != ("P", "1-URGENT"):
            key = r.o_custkey, r.o_orderdate.year, r.o_orderdate.month
            books[key]["orders"].append(r.o_orderkey)
            for name in {"F": ("amount", "finished"), "O": ("amount", "open"), "P": ("amount",)}[r.o_orderstatus]:
                books[key][name].append(Decimal(cents(r.o_totalprice)) / 100)
    number = lambda side, name: None if name not in side else len(set(side[name])) if name == "orders" else sum(side[name])
    want = {
        (*key, name): (number(lines[key], name) if key in lines else None, number(books[key], name) if key in books else None, key in lines, key in books)
        for key in {*lines, *books} for name in tables.BOOKED}
    found = reconcile.reconcile(tables.billed_days(spark, sf), tables.order_books(spark, sf), metrics=tables.BOOKED)
    detail = found.collect()
    assert {(r.entity, r.year, r.month, r.metric): (r.daily_value, r.monthly_value, r.outcome != "MONTHLY_ONLY", r.outcome != "DAILY_ONLY") for r in detail} == want
    assert {r.outcome for r in detail} == {"MATCH", "NULL_CONVENTION", "MISMATCH", "DAILY_ONLY", "MONTHLY_ONLY"}
    assert {r.abs_diff > 0 for r in detail if r.outcome == "MISMATCH" and r.abs_diff is not None} == {True, False}
    medians = {(r.entity, r.metric): r.median_pct_diff for r in reconcile.by_entity(found).collect()}
    for at in list(medians)[:40]:
        v = sorted(r.pct_diff for r in detail if (r.entity, r.metric) == at and r.abs_diff is not None and r.pct_diff is not None)
        assert medians[at] == (((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2).quantize(Decimal("0.000001"), "ROUND_HALF_UP") if v else None)


def test_grain_and_duplicates(spark):
    rows = [(1, START, 1.0)] * 40 + [(1, START, 2.0), (2, START, 1.0), (None, START, 1.0), (None, START, 1.0)]
    df = spark.createDataFrame(rows, "entity bigint, day date, v double")
    r = profile.grain(df, ["entity", "day"]).first()
    assert (r.total_rows, r.missing_key_rows, r.distinct_keys, r.duplicated_keys) == (44, 2, 2, 1)
    assert (r.duplicate_rows, r.exact_duplicate_rows, r.conflicting_duplicate_rows, r.verdict) == (41, 40, 1, "NOT CONFIRMED")
    # the row listing treats NULL keys as equal
    assert profile.duplicate_rows(df, ["entity", "day"]).count() == 43
    assert profile.exact_duplicates(df).first()[0] == 42


def test_identifiers(spark):
    df = spark.createDataFrame([("a ", 1), ("A", 1), ("b", 2), (None, 3), ("b", 4)], "entity_name string, entity bigint")
    r = {x.column: x for x in profile.identifiers(df, ["entity_name", "entity"]).collect()}["entity_name"]
    assert (r.missing_values, r.padded_values, r.raw_distinct, r.normalised_distinct, r.collisions) == (1, 1, 3, 2, 1)
    found = {x.mapping: x.violations for x in profile.mapping_violations(df, [("entity", "entity_name"), ("entity_name", "entity")]).collect()}
    assert found == {"entity -> entity_name": 1, "entity_name -> entity": 1}
    assert profile.identifier_verdict(df, ["entity_name"], [("entity", "entity_name")]).first().verdict == "NOT CONFIRMED"


def test_missing_patterns(spark):
    rows = [(e, dt.date(2015 + e % 5, 1, 1 + i), "OP" if i % 2 else "WI", "production", None if e == 1 else 1.0, None if i % 2 else 1.0)
            for e in range(6) for i in range(20)]
    f = spark.createDataFrame(rows, "entity bigint, day date, state string, mode string, one double, by_mode double")
    got = {r.column: (r.pattern, r.status) for r in missingness.patterns(f, ["one", "by_mode", "state"]).collect()}
    assert got == {"one": ("concentrated by entity and time", "REVIEW"), "by_mode": ("follows operating mode", "REVIEW"), "state": ("none", "PASS")}


def test_category_changes(fact):
    want = Counter()
    for rs in series().values():
        want.update(f"{a[2]}->{b[2]}" for a, b in zip(rs, rs[1:]))
    assert {r.transition: r.row_count for r in categories.transition_tally(fact, "state").collect()} == dict(want)
    assert categories.changes(fact, "state").count() == want["OP->WI"] + want["WI->OP"]


def test_run_heads_and_samples(fact):
    assert profile.head_per_entity(fact, 2).groupBy("entity").count().where("count <> 2").count() == 0
    assert profile.sample(fact, 0.5, 3).collect() == profile.sample(fact, 0.5, 3).collect()


# --- order statistics: one value holds a third of the rows -----------------------


def hot_values(n=6000, seed=1):
    rnd = np.random.default_rng(seed)
    return [42.0 if i % 3 == 0 else None if i % 50 == 1 else round(float(rnd.lognormal(3, 2)), 2) for i in range(n)]


@pytest.mark.parametrize("kind", ["double", "decimal(18,2)"])
def test_percentiles(spark, kind):
    values = hot_values()
    df = spark.createDataFrame([("a" if i % 4 else "b", v) for i, v in enumerate(values)], "g string, v double").select("g", F.col("v").cast(kind).alias("v"))
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for r in exact_percentiles(df, ["g"], "v", probs).collect():
        mine = [v for i, v in enumerate(values) if v is not None and ("a" if i % 4 else "b") == r.g]
        np.testing.assert_allclose([r[k] for k in probs], np.quantile(mine, list(probs.values())), rtol=1e-12)
    total = exact_percentiles(df, [], "v", probs).first()
    np.testing.assert_allclose([total[k] for k in probs], np.quantile([v for v in values if v is not None], list(probs.values())), rtol=1e-12)


def test_percentiles_of_little(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None)], "g string, v double")
    assert [tuple(r) for r in exact_percentiles(df, ["g"], "v", {"m": 0.5}).collect()] == [("a", 3.0)]
    # without groups it behaves as a global aggregate: one row, NULL when there is nothing
    assert [tuple(r) for r in exact_percentiles(df.where("v > 5"), [], "v", {"m": 0.5}).collect()] == [(None,)]


def test_ranks(spark):
    values = hot_values()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v double")
    present = sorted((v for v in values if v is not None), reverse=True)
    first = {}
    for i, v in enumerate(present, 1):
        first.setdefault(v, i)
    dense = {v: i for i, v in enumerate(sorted(set(present), reverse=True), 1)}
    got = global_ranks(df, [], "v", "r", "d").collect()
    assert len(got) == len(values)
    for r in got:
        assert (r.r, r.d) == ((first[r.v], dense[r.v]) if r.v is not None else (len(present) + 1, len(dense) + 1))


def test_no_job_before_the_query_runs(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(50)], "g int, v double")
    spark.sparkContext.setJobGroup("plans", "plans")
    try:
        exact_percentiles(df, ["g"], "v", {"m": 0.5})
        global_ranks(df, ["g"], "v", "r", "d")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def shuffled(df):
    """Rows written by the exchanges of a query that has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes, total = [plan], 0
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        if "QueryStage" in name:
            nodes.append(node.plan())
        if name == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.length())]
    return total


def test_percentiles_shuffle_only_their_brackets(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.exp(F.randn(3) * 2).alias("v")).repartition(4)
    df.write.mode("overwrite").parquet(path := tempfile.mkdtemp(prefix="run-"))
    stored = spark.read.parquet(path)
    got = exact_percentiles(stored, ["g"], "v", {"p50": 0.5, "p95": 0.95})
    assert shuffled(got) < 20_000  # bin totals of each task and the values of a few bins, of 200,000
    values = np.array([r.v for r in stored.select("v").collect()])
    np.testing.assert_allclose([*got.first()][1:], np.quantile(values, [0.5, 0.95]), rtol=1e-12)


def test_heavy_and_absent_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(profile, "HEAVY", 1000)
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id"))
    df = spark.range(9000).select(key.cast("long").alias("k"), (F.col("id") % 2).alias("j"), "id").unionByName(spark.sql("SELECT 5L AS k, 1L AS j, 77777L AS id"))
    got = profile.duplicate_rows(df, ["k", "j"])
    assert got.columns == df.columns
    rows = [tuple(r) for r in df.collect()]
    counts = Counter(r[:2] for r in rows)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(r) for r in rows if counts[r[:2]] > 1)
    one = profile.duplicate_rows(df, ["k"])
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        parts = [len(p) for p in profile.duplicate_rows(df, ["k"]).rdd.glom().collect()]
        assert sum(parts) == one.count() and max(parts) < sum(parts) / 6  # a third each without spreading
    finally:
        spark.conf.set(conf, before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ranks_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id bigint, v double")
    assert {(r.id, r.r) for r in global_ranks(df, [], "v", "r").collect()} == {(1, 1), (2, 1)}


def test_ratios_are_rounded_once(spark):
    """Against exact fractions, at and next to halves."""
    from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal
    from fractions import Fraction

    from prodseries.functions.expr import rounded_ratio

    pairs = [("49999.96", "100000000"), ("5", "100"), ("-5", "100"), ("15", "100"), ("25", "100"), ("1", "3"), ("2", "-3"), ("0", "7"),
             ("1", "0"), ("0.000001", "2"), ("333333.333333", "0.7"), ("50000", "100000000"), ("149999.999999", "100000000"), ("1250000", "100000000")]
    df = spark.createDataFrame([(Decimal(a), Decimal(b)) for a, b in pairs], "a decimal(28,6), b decimal(28,6)")
    for dp, times in ((1, 100), (2, 100), (3, 1)):
        for even, mode in ((False, ROUND_HALF_UP), (True, ROUND_HALF_EVEN)):
            got = [r[0] for r in df.select(rounded_ratio("a", "b", dp, times, even)).collect()]
            for (a, b), value in zip(pairs, got):
                if Decimal(b) == 0:
                    assert value is None
                    continue
                exact = Fraction(a) * times / Fraction(b) * 10**dp
                low, rest = divmod(abs(exact), 1)
                up = rest > Fraction(1, 2) or rest == Fraction(1, 2) and (mode is ROUND_HALF_UP or low % 2 == 1)
                assert value == Decimal(int(low) + up).scaleb(-dp) * (-1 if exact < 0 else 1), (a, b, dp, times, even)


@pytest.mark.parametrize("name,keys", [
    ("dash_availability_month", ["month_start"]), ("dash_field_monthly", ["month_start"]), ("gt_history", ["entity_name", "day"]),
    ("gt_active_in_year", ["month_start"]), ("vw_dq_review", ["day", "entity", "dq_issue"]),
])
def test_reports_come_in_their_order(spark, name, keys):
    from prodseries.plans import registry

    rows = [tuple(r[k] for k in keys) for r in registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()]
    assert len(rows) > 10 and rows == sorted(rows)


def test_abrupt_changes_are_listed_by_size(fact, dim):
    rows = measures.abrupt_listing(fact, dim, ["oil"]).collect()
    assert len(rows) > 3 and all(r.entity_name for r in rows)
    assert [abs(r.pct_change) for r in rows] == sorted((abs(r.pct_change) for r in rows), reverse=True)


@pytest.mark.parametrize("few,label", [(7_000_000, "spread broadly"), (7_000_004, "concentrated by entity")])
def test_thresholds_are_held_against_counts(spark, few, label):
    """A share of 0.7000004, which six decimals do not show, is above 0.7; exactly 0.7 is not."""
    rest = 10_000_000 - few
    rows = [(1, "2020-01-01", few // 2), (2, "2021-01-01", few - few // 2)] + [(3 + i, f"{2022 + i}-01-01", rest // 4 + (i < rest % 4)) for i in range(4)]
    counts = spark.createDataFrame(rows, "entity bigint, day string, n bigint")
    df = counts.select("entity", F.to_date("day").alias("day"), F.lit("OP").alias("state"), F.lit("production").alias("mode"),
                       F.lit(None).cast("decimal(18,6)").alias("oil"), F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("i")).drop("i")
    assert missingness.patterns(df, ["oil"]).first().pattern == label


def test_a_spread_just_above_the_threshold_is_wide(spark):
    make = lambda blank: spark.range(2_000_000).select(
        F.lit(1).alias("entity"), F.lit("2020-01-01").cast("date").alias("day"), F.when(F.col("id") < 1_000_000, "OP").otherwise("WI").alias("state"),
        F.lit("production").alias("mode"), F.when(F.col("id") >= blank, F.lit(1).cast("decimal(18,6)")).alias("oil"))
    kind = lambda blank: missingness.classification(make(blank), ["oil"]).first().classification
    assert (kind(500_000), kind(500_001)) == ("MEASUREMENT", "CONTEXTUAL")
