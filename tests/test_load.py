import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from fixture_rows import daily_rows, write_csv, write_extracts
from prodseries.sources import load as ld
from prodseries.sources.extracts import (
    DAILY_COLUMNS, LoadError, clean, measure_to_text, narrowed, open_extract, read_daily, read_monthly, require_columns, write_reports,
)

D = dt.date


def one(spark, value, schema, expr):
    df = spark.createDataFrame([(value,)], f"v {schema}")
    return df.select(expr(F.col("v"), df.schema["v"].dataType)).first()[0]


@pytest.mark.parametrize("value,schema,text", [
    (float("nan"), "double", None), (None, "double", None), (192.0, "double", "192.0"), (5, "int", "5.0"),
    (25000000.0, "double", "25000000.0"), (0.5, "double", "0.5"), ("hrs", "string", "hrs"), ("192.0", "string", "192.0"), ("NaN", "string", None),
])
def test_measure_to_text(spark, value, schema, text):
    assert one(spark, value, schema, measure_to_text) == text


@pytest.mark.parametrize("value,schema,kind,result", [
    (float("nan"), "double", "measure", None), ("", "string", "string", None), ("NaT", "string", "date", None),
    ("2020-01-05 00:00:00", "string", "date", D(2020, 1, 5)), ("9000.0", "string", "int", 9000), (12, "bigint", "int", 12),
    ("0", "string", "measure", Decimal("0.000000")), ("x", "string", "string", "x"),
])
def test_clean(spark, value, schema, kind, result):
    assert one(spark, value, schema, lambda c, t: clean(c, t, kind)) == result


def test_bad_number_is_not_silently_dropped(spark):
    with pytest.raises(PySparkException):
        one(spark, "12x", "string", lambda c, t: clean(c, t, "measure"))


def test_missing_source_and_columns(spark, tmp_path):
    with pytest.raises(LoadError, match="not found"):
        open_extract(spark, str(tmp_path / "nowhere.csv"))
    path = write_csv(tmp_path / "short.csv", ["DATEPRD"], [])
    with pytest.raises(LoadError, match="WELL_TYPE"):
        read_daily(spark, path)
    with pytest.raises(LoadError, match=r"\['x'\]"):
        require_columns(spark.range(1), ["id", "x"])


def test_columns_are_taken_by_name(spark, tmp_path):
    order = list(reversed(DAILY_COLUMNS)) + ["EXTRA"]
    rows = [{**r, "EXTRA": 1} for r in daily_rows()]
    df = read_daily(spark, write_csv(tmp_path / "d.csv", order, rows))
    assert df.columns == [n for n, _ in DAILY_COLUMNS.values()]
    assert df.agg(F.sum("bore_oil_vol")).first()[0] == Decimal("888")


def test_parquet_source(spark, extracts, tmp_path):
    csv = open_extract(spark, extracts[0])
    typed = csv.select(*[F.col(c).cast("double").alias(c) if k == "measure" else F.col(c) for c, (_, k) in DAILY_COLUMNS.items()])
    typed.write.parquet(str(tmp_path / "d"))
    assert sorted(read_daily(spark, str(tmp_path / "d"), "parquet").collect()) == sorted(read_daily(spark, extracts[0]).collect())


def test_counts_and_exclusion(loaded):
    counts, core = loaded
    assert counts == {
        "wellbore": 2, "daily_production": 20, "raw_monthly_rows": 3, "excluded_monthly_rows": 1, "monthly_reference": 2,
    }
    row = core["quarantine"].first()
    assert (row.on_stream, row.oil, row.npdcode, row.reason) == ("hrs", "Sm3", None, "monthly key is incomplete")


def test_zero_and_null_survive(loaded):
    d = loaded[1]["daily_production"]
    a5 = d.where((F.col("npd_well_bore_code") == 90001) & (F.col("production_date") == D(2020, 1, 5))).first()
    a6 = d.where((F.col("npd_well_bore_code") == 90001) & (F.col("production_date") == D(2020, 1, 6))).first()
    b5 = d.where((F.col("npd_well_bore_code") == 90002) & (F.col("production_date") == D(2020, 1, 5))).first()
    assert (a5.on_stream_hrs, a5.bore_oil_vol) == (0, 0)
    assert (a6.on_stream_hrs, a6.bore_oil_vol, a6.avg_downhole_pressure) == (None, None, None)
    assert (b5.on_stream_hrs, b5.bore_wi_vol) == (0, 180)
    b = d.where(F.col("npd_well_bore_code") == 90002)
    assert b.where("bore_oil_vol is not null or bore_gas_vol is not null or bore_wat_vol is not null").count() == 0


def test_tables_carry_comments(loaded):
    field = loaded[1]["daily_production"].schema["bore_wat_vol"]
    assert field.metadata["comment"] == "volume in Sm3; NULL: not applicable or not measured; may be negative"


def test_monthly_equals_daily_sum(loaded):
    core = loaded[1]
    daily = core["daily_production"].groupBy("npd_well_bore_code").agg(F.sum("bore_oil_vol").alias("oil"))
    got = {r.npd_well_bore_code: (r.oil, r.oil_vol) for r in daily.join(core["monthly_reference"], "npd_well_bore_code").collect()}
    assert got == {90001: (Decimal(888), Decimal(888)), 90002: (None, None)}


def test_dimension_holds_every_attribute(loaded):
    rows = {r.npd_well_bore_code: r for r in loaded[1]["wellbore"].collect()}
    assert rows[90001].well_bore_code == "TB-A" and rows[90002].npd_facility_name == "TESTFACILITY"


def changed(**values):
    def change(row):
        if row["NPD_WELL_BORE_CODE"] == 90001 and row["DATEPRD"] == "2020-01-03":
            row.update(values)
        return row

    return change


@pytest.mark.parametrize("values,complaint", [
    ({"WELL_TYPE": "XX"}, "well_type"), ({"FLOW_KIND": "gas"}, "flow_kind"), ({"BORE_OIL_VOL": -1}, "non-negative"),
    ({"AVG_CHOKE_UOM": "mm"}, "avg_choke_uom"), ({"DATEPRD": "2020-01-04"}, "unique key"),
    ({"DATEPRD": ""}, "not null"), ({"NPD_WELL_BORE_NAME": "other"}, "unique npd_well_bore_code"),
])
def test_a_violation_publishes_nothing(spark, extracts, tmp_path, values, complaint):
    out = str(tmp_path / "store")
    ld.load(spark, *extracts, out)
    before = ld.current_run(spark, out)
    bad = tmp_path / "bad"
    bad.mkdir()
    with pytest.raises(LoadError, match=complaint):
        ld.load(spark, *write_extracts(bad, changed(**values)), out)
    assert ld.current_run(spark, out) == before


def test_unenforced_on_purpose(spark, tmp_path):
    odd = changed(BORE_WAT_VOL=-3, ON_STREAM_HRS=25, AVG_CHOKE_SIZE_P=120, AVG_DOWNHOLE_PRESSURE=1)
    counts = ld.load(spark, *write_extracts(tmp_path, odd), str(tmp_path / "store"))
    assert counts["daily_production"] == 20
    row = ld.core_tables(spark, str(tmp_path / "store"))["daily_production"].where("bore_wat_vol < 0").first()
    assert (row.bore_wat_vol, row.on_stream_hrs) == (-3, 25)


def test_snapshot_size_is_checked(spark, extracts, tmp_path):
    with pytest.raises(LoadError, match="core daily rows.*core wellbores"):
        ld.load(spark, *extracts, str(tmp_path), ld.Snapshot(daily_rows=21, wellbores=7))
    with pytest.raises(LoadError, match="published"):
        ld.core_tables(spark, str(tmp_path))


def test_reload_replaces_what_readers_see(spark, extracts, tmp_path):
    out = str(tmp_path / "store")
    ld.load(spark, *extracts, out)
    ld.load(spark, *write_extracts(tmp_path, changed(BORE_OIL_VOL=1110)), out)
    assert ld.core_tables(spark, out)["daily_production"].count() == 20
    assert ld.core_tables(spark, out)["daily_production"].agg(F.sum("bore_oil_vol")).first()[0] == 1888


def test_bad_monthly_text(spark, extracts, tmp_path):
    raw = read_monthly(spark, extracts[1])
    bad = raw.withColumn("oil", F.when(F.col("npdcode") == 90001, "n/a").otherwise(F.col("oil")))
    with pytest.raises(PySparkException):
        ld.build_monthly(bad).collect()
    assert ld.build_monthly(bad, quarantine=True).count() == 1
    assert {r.reason for r in ld.excluded_monthly(bad, quarantine=True).collect()} == {
        "monthly key is incomplete", "measure is not a number"}


def test_reports_and_layers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, t string")
    assert write_reports({"r": df}, str(tmp_path)) == ["r"]
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).collect() == [("1", "a")]
    assert ld.create_layers(spark) == ["raw", "core", "analytics"]
    assert ld.create_layers(spark) == ["raw", "core", "analytics"]


def test_schema_diff(spark):
    from prodseries.operators.profile import schema_diff

    want = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("on_stream", T.DoubleType()), T.StructField("z", T.DateType())])
    have = spark.createDataFrame([], "a bigint, `On Stream` double, extra string")
    found = {(r.column, r.finding) for r in schema_diff(want, have).collect()}
    assert found == {("a", "retyped"), ("on_stream", "renamed"), ("z", "missing"), ("extra", "unexpected")}


@pytest.mark.parametrize("value,schema,kind", [
    ("2020-01-01XYZ", "string", "date"), ("2020-01-01 25", "string", "date"), ("01.02.2020", "string", "date"), ("9000.7", "string", "int"),
    (9000.7, "double", "int"), ("1.0000000000000000001", "string", "measure"), ("1e-19", "string", "measure"), ("9e3x", "string", "measure"),
])
def test_nothing_is_cut(spark, value, schema, kind):
    with pytest.raises(PySparkException):
        one(spark, value, schema, lambda c, t: clean(c, t, kind))


@pytest.mark.parametrize("value,schema,kind,result", [
    ("0.0000004", "string", "measure", Decimal("4e-7")), ("4E-7", "string", "measure", Decimal("4e-7")), (4e-7, "double", "measure", Decimal("4e-7")),
    ("2020-01-05T10:30:00.5", "string", "date", D(2020, 1, 5)), ("-12.000", "string", "int", -12), (9000.0, "double", "int", 9000), ("1e3", "string", "measure", Decimal(1000)),
])
def test_whole_values_are_kept(spark, value, schema, kind, result):
    assert one(spark, value, schema, lambda c, t: clean(c, t, kind)) == result


def test_measure_type_is_chosen_and_never_rounds(spark):
    raw = spark.createDataFrame([(Decimal("4e-7"),)], "v decimal(38,18)")
    fine = T.DecimalType(28, 10)
    assert narrowed(raw, ["v"], fine).first().v == Decimal("4e-7")
    with pytest.raises(PySparkException, match="does not fit"):
        narrowed(raw, ["v"]).collect()
    from prodseries import SeriesSpec

    names = {r: r for r in ("entity", "day", "hours", "state", "mode", "oil", "gas", "water", "injection")}
    spec = SeriesSpec(**names, sensors={}, labels={}, choke=None, measure=fine)
    row = raw.selectExpr("1 AS entity", "current_date() AS day", "'OP' AS state", "'production' AS mode", *[f"v AS {c}" for c in ("hours", "oil", "gas", "water", "injection")])
    assert spec.fact(row).first().oil == Decimal("4e-7")


def test_monthly_text_that_does_not_fit(spark):
    row = ("A", 1, 2020, 1, "1", "0.0000004", None, None, None, None)
    raw = spark.createDataFrame([row], "wellbore_name string, npdcode int, year int, month int, on_stream string, oil string, gas string, water string, gi string, wi string")
    with pytest.raises(PySparkException, match="does not fit"):
        ld.build_monthly(raw).collect()
    assert ld.build_monthly(raw, quarantine=True).count() == 0 and ld.excluded_monthly(raw, quarantine=True).count() == 1
    assert ld.build_monthly(raw, measure=T.DecimalType(28, 10)).first().oil_vol == Decimal("4e-7")


def test_files_are_lined_up_by_name(spark, tmp_path):
    import gzip

    for name, text in (("a.csv", "A,B\n1,2\n"), ("b.csv", "B,A\n4,3\n"), ("c d.csv", '"X, y",A,B\n9,5,6\n'), ("e.csv", ""), ("f.csv", "A,B\n")):
        (tmp_path / name).write_text(text)
    with gzip.open(tmp_path / "g.csv.gz", "wt") as f:
        f.write("B,A\n8,7\n")
    df = open_extract(spark, str(tmp_path), columns=["A", "B"])
    assert sorted(tuple(r) for r in df.select("A", "B", "X, y").collect()) == [("1", "2", None), ("3", "4", None), ("5", "6", "9"), ("7", "8", None)]
    assert open_extract(spark, str(tmp_path / "[ab].csv")).select("A").count() == 2


def test_a_file_without_a_column_is_named_before_any_row_is_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,B\n1,2\n")
    (tmp_path / "bad.csv").write_text("A,C\n1,2\n")
    with pytest.raises(LoadError, match=r"\['B'\] in .*bad.csv"):
        open_extract(spark, str(tmp_path), columns=["A", "B"])
    (tmp_path / "bad.csv").write_text("A,A,B\n1,2,3\n")
    with pytest.raises(LoadError, match=r"\['A'\] more than once in .*bad.csv"):
        open_extract(spark, str(tmp_path), columns=["A", "B"])
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "a.csv").write_text("")
    with pytest.raises(LoadError, match="No header"):
        open_extract(spark, str(empty))


def test_daily_rows_in_three_layouts(spark, tmp_path):
    names = list(DAILY_COLUMNS)
    for i, order in enumerate((names, names[::-1], [*names[5:], "EXTRA", *names[:5]])):
        write_csv(tmp_path / f"{i}.csv", order, [{c: r.get(c, "") for c in order} for r in list(daily_rows())[i::3]])
    assert read_daily(spark, str(tmp_path)).agg(F.sum("bore_oil_vol")).first()[0] == Decimal("888")


@pytest.mark.parametrize("value,schema,text", [
    (Decimal("12345678901234567.123456"), "decimal(23,6)", "12345678901234567.123456"), (1e-20, "double", "1e-20"), (2.5e16, "double", "2.5e+16"),
    (0.1, "double", "0.1"), (-0.00012345678901234567, "double", "-0.00012345678901234567"), (1 / 3, "double", "0.3333333333333333"), (0.0, "double", "0.0"),
    (9007199254740993, "bigint", "9007199254740993.0"), (Decimal("5.000000"), "decimal(18,6)", "5.0"), (Decimal("7"), "decimal(10,0)", "7.0"),
    (9999999999999998.0, "double", "9999999999999998.0"), (5e-324, "double", "4.9e-324"),
])
def test_numbers_keep_their_value_as_text(spark, value, schema, text):
    got = one(spark, value, schema, measure_to_text)
    assert got == text and (Decimal(got) == value if isinstance(value, (Decimal, int)) else float(got) == value)


def test_two_loaders_that_publish_at_once(spark, tmp_path):
    out = str(tmp_path / "store")
    log = ld.VersionLog(spark, f"{out}/versions")
    assert ld.publish(spark, out, "first") == 1
    raced = []

    def make(seen):
        """Another loader publishes after this one has looked."""
        if not raced:
            raced.append(ld.publish(spark, out, "other"))
        return {"run_id": "late", "after": len(seen)}

    assert log.append(make) == 3 and raced == [2]
    assert [(n, e["run_id"]) for n, e in log.entries()] == [(1, "first"), (2, "other"), (3, "late")]
    assert log.entries()[-1][1]["after"] == 2 and ld.current_run(spark, out) == "late"
    assert not log.put(2, {"run_id": "again"}) and log.entries()[1][1]["run_id"] == "other"
    assert log.append(lambda seen: None) is None and len(log.entries()) == 3
    assert not [f for f in (tmp_path / "store" / "versions").iterdir() if f.name.startswith("draft")]


def test_counts_come_with_the_writes(spark, extracts, tmp_path):
    """Jobs of a load: the two raw writes, the four core writes with their shuffles, the counts of raw, and one for the core."""
    spark.sparkContext.setJobGroup("load", "load")
    try:
        ld.load(spark, *extracts, str(tmp_path / "store"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("load")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 34


def _frames(spark, **change):
    """A source, raw and core that agree, with some frames changed."""
    day = "date'2020-01-01' AS production_date"
    daily = spark.sql(f"SELECT 1 AS npd_well_bore_code, {day}, 5.0 AS bore_oil_vol, 1.0 AS bore_gas_vol, 1.0 AS bore_wat_vol, 1.0 AS bore_wi_vol")
    monthly = spark.sql("SELECT 1 AS npdcode, 2020 AS year, 1 AS month, '1' AS on_stream, '1' AS oil, '1' AS gas, '1' AS water, '1' AS gi, '1' AS wi")
    all_ = {"source_daily": daily, "source_monthly": monthly, "raw_daily": daily, "raw_monthly": monthly, "daily_production": daily,
            "monthly_reference": monthly, "wellbore": spark.sql("SELECT 1 AS npd_well_bore_code")} | change
    pick = lambda *names: {n.removeprefix("source_").removeprefix("raw_"): all_[n] for n in names}
    return pick("source_daily", "source_monthly"), pick("raw_daily", "raw_monthly"), {k: all_[k] for k in ("wellbore", "daily_production", "monthly_reference")}


@pytest.mark.parametrize("change,failed", [
    ({}, []), ({"source_daily": "twice"}, [1, 2]), ({"daily_production": "none"}, [2, 8]), ({"wellbore": "twice"}, [3]),
    ({"daily_production": "twice"}, [2, 4, 8]), ({"wellbore": "other"}, [5]), ({"source_monthly": "none"}, [6]), ({"monthly_reference": "none"}, [7]),
    ({"daily_production": "more oil"}, [8]),
])
def test_each_load_check_can_fail(spark, change, failed):
    base = _frames(spark)
    flat = {"source_daily": base[0]["daily"], "source_monthly": base[0]["monthly"], **base[2]}
    how = {
        "twice": lambda df: df.unionByName(df), "none": lambda df: df.limit(0), "other": lambda df: df.selectExpr("2 AS npd_well_bore_code"),
        "more oil": lambda df: df.withColumn("bore_oil_vol", F.lit(6.0).cast("decimal(2,1)")),
    }
    changed = {k: how[v](flat[k]) for k, v in change.items()}
    rows = ld.validate_load(*_frames(spark, **changed), ld.Snapshot(wellbores=1)).collect()
    assert [r.check_order for r in rows if not r.passed] == failed
