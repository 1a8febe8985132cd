"""The driver tables seen as a daily series, its dimension and its monthly text extract."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from prodseries.functions.expr import dealt_by_month
from prodseries.spec import MEASURE, TOTAL, SeriesSpec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def booked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as far as the monthly books have them: urgent orders that are still pending follow later."""
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(pending.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")


#: What the order books and the lines of the orders both say.
BOOKED = ("orders", "amount", "finished", "open")


def order_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly books by (customer, year, month), from the heads of the orders alone: their number and total prices.

    Urgent orders that are still pending are not booked yet.
    """
    cents, status = F.floor(F.col("o_totalprice") * 100 + 0.5), F.col("o_orderstatus")
    heads = table(spark, sf_dir, "orders").where("NOT coalesce(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT', false)")
    price = lambda c: (F.sum(c) * F.lit(Decimal("0.01"))).cast(TOTAL)
    return heads.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.count("*").alias("orders"), price(cents).alias("amount"),
        price(F.when(status == "F", cents)).alias("finished"), price(F.when(status == "O", cents)).alias("open"),
    )


def billed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines by (customer, order day): orders that have any, and discounted prices of all, finished and open lines.

    Lines are summed to their order first, with partial sums, so orders meet one row of lines each; the order gives the
    customer and the day, and every amount comes from the lines.
    """
    parts = F.floor(F.col("l_extendedprice") * 100 + 0.5) * (100 - F.floor(F.col("l_discount") * 100 + 0.5))
    status = F.col("l_linestatus")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(parts).alias("amount"), F.sum(F.when(status == "F", parts)).alias("finished"), F.sum(F.when(status == "O", parts)).alias("open"))
    heads = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"))
    price = lambda c: (F.sum(c) * F.lit(Decimal("0.0001"))).cast(TOTAL).alias(c)
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("entity", "day").agg(
        F.count("*").alias("orders"), price("amount"), price("finished"), price("open"))


def daily_fact(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Order lines (all, unless told otherwise) summed to one row per (supplier, ship date).

    Partial sums run before the shuffle, and the shuffle key is (entity, day), so
    a supplier holding a third of all lines is spread over its days. After this
    step an entity has at most one row per calendar day, which bounds every
    per-entity window downstream by the length of the calendar.
    """
    li = table(spark, sf_dir, "lineitem") if lines is None else lines
    qty, flag, status = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus")
    # prices are whole cents: summed as integers, so the sum is exact in any order
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    voided = F.col("l_tax") == 0.08
    reversed_ = (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0)
    measured = F.col("l_suppkey") % 10 != 9
    made = (flag == "A") & measured

    def total(c):
        return F.sum(c).cast(MEASURE)

    summed = li.groupBy(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("day")).agg(
        total(F.when(status == "F", qty).when((status == "O") & (flag == "R"), 0.0)).alias("hours"),
        total(F.when(made, F.when(voided, 0.0).otherwise(qty))).alias("oil"),
        (F.sum(F.when(made, F.when(voided, 0).otherwise(cents))) / F.lit(100.0)).cast(MEASURE).alias("gas"),
        total(F.when((flag == "N") & measured, F.when(reversed_, -qty).otherwise(qty))).alias("water"),
        total(F.when(flag == "R", F.when(voided, 0.0).otherwise(qty))).alias("injection"),
        total(F.when(status == "F", qty)).alias("downhole"),
        total(F.when(status == "O", qty)).alias("wellhead"),
    )
    injecting = F.col("injection").isNotNull()
    state = F.when(injecting & (F.col("oil").isNull() | (F.col("injection") > F.col("oil"))), "WI").otherwise("OP")
    mode = F.when(injecting & F.col("oil").isNull() & F.col("water").isNull(), "injection").otherwise("production")
    return summed.select(
        "entity", "day", state.alias("state"), mode.alias("mode"),
        "hours", "oil", "gas", "water", "injection", "downhole", "wellhead",
    )


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier with its nation and region, in the shape of the core dimension."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("entity"),
            F.col("s_name").alias("entity_name"),
            F.col("n_nationkey").alias("group_code"),
            F.col("n_name").alias("group_name"),
            F.col("r_regionkey").alias("area_code"),
            F.col("r_name").alias("area_name"),
        )
    )


def raw_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly extract with text measures, from the books: lines joined with their orders.

    It lags behind the daily rows by what is not booked yet, so months are missing or smaller; one entity exists
    here only, and one stray row carries unit words and no keys.
    """
    summed = (
        dealt_by_month(daily_fact(spark, sf_dir, booked_lines(spark, sf_dir)))
        .groupBy("entity", "year", "month")
        .agg(*[F.sum(c).cast(TOTAL).alias(c) for c in ("hours", "oil", "gas", "water", "injection")])
    )
    named = summed.join(
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), "s_name"), "entity", "left"
    )
    text = named.select(
        F.col("s_name").alias("entity_name"), "entity", "year", "month",
        F.col("hours").cast("string").alias("on_stream"),
        F.col("oil").cast("string").alias("oil"),
        F.col("gas").cast("string").alias("gas"),
        F.col("water").cast("string").alias("water"),
        F.lit(None).cast("string").alias("gi"),
        F.col("injection").cast("string").alias("wi"),
    )
    extra = spark.createDataFrame(
        [
            ("Unlisted", -1, 2000, 1, "24.0", "10.0", "20.0", "1.0", None, None),
            (None, None, None, None, "hrs", "Sm3", "Sm3", "Sm3", "Sm3", "Sm3"),
        ],
        text.schema,
    )
    return text.unionByName(extra)


def raw_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series in the shape of the raw daily extract (24 columns)."""
    sensor = {"avg_downhole_pressure": "downhole", "avg_whp_p": "wellhead"}
    blank = (
        "avg_downhole_temperature", "avg_dp_tubing", "avg_annulus_press", "avg_choke_size_p", "avg_wht_p", "dp_choke_size",
    )
    joined = daily_fact(spark, sf_dir).join(dimension(spark, sf_dir), "entity", "left")
    return joined.select(
        F.col("day").alias("dateprd"),
        F.concat(F.lit("SB-"), F.col("entity").cast("string")).alias("well_bore_code"),
        F.col("entity").alias("npd_well_bore_code"),
        F.col("entity_name").alias("npd_well_bore_name"),
        F.col("group_code").alias("npd_field_code"),
        F.col("group_name").alias("npd_field_name"),
        F.col("area_code").alias("npd_facility_code"),
        F.col("area_name").alias("npd_facility_name"),
        F.col("hours").alias("on_stream_hrs"),
        *[F.col(c).alias(n) for n, c in sensor.items()],
        *[F.lit(None).cast(MEASURE).alias(n) for n in blank],
        F.lit(None).cast("string").alias("avg_choke_uom"),
        F.col("oil").alias("bore_oil_vol"),
        F.col("gas").alias("bore_gas_vol"),
        F.col("water").alias("bore_wat_vol"),
        F.col("injection").alias("bore_wi_vol"),
        F.col("mode").alias("flow_kind"),
        F.col("state").alias("well_type"),
    )


def raw_monthly_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly text series in the shape of the raw monthly extract."""
    return raw_monthly(spark, sf_dir).withColumnsRenamed({"entity_name": "wellbore_name", "entity": "npdcode"})


# A second series with its own column names: orders of a customer by day.
ORDERS = SeriesSpec(
    entity="o_custkey", entity_name="c_name", day="order_day", hours="order_count", state="last_status", mode="last_status",
    oil="total_price", gas="total_price", water="order_count", injection="open_price",
    sensors={}, labels={}, ordered_sensors=(), choke=None, choke_partner=None,
)


def orders_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders summed to one row per (customer, order date), under their own names."""
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    return table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("order_day")).agg(
        F.count("*").alias("order_count"), F.max("o_orderstatus").alias("last_status"),
        (F.sum(cents) / F.lit(100.0)).alias("total_price"),
        (F.sum(F.when(F.col("o_orderstatus") == "O", cents)) / F.lit(100.0)).alias("open_price"),
    )


def customer_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event type of each (user, day): one row per day, whatever the number of events."""
    first = F.min(F.struct("ts", "event_id", "event_type"))["event_type"]
    return table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("entity"), F.to_date("ts").alias("day")
    ).agg(first.alias("event_type"))
