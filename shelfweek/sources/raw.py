"""Raw retail entities derived from the order/line-item/part test tables.

Each function is a plain projection or one grouped aggregate over the base tables, so columns and
filters reach the Parquet scan and everything is pre-aggregated to its weekly or daily grain before
any later shuffle. Fiscal weeks run Sunday to Saturday, 52 a year, from 1995-01-01.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.functions.numeric import MONEY, half_up_cents

# Fixed values of the derived calendar.
EPOCH = "1995-01-01"
CALENDAR_WEEKS = 416
HOLIDAY_WEEKS = {"national": (1, 35, 51, 52), "public": (13, 22, 51, 52)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def week_number(day) -> Column:
    return F.call_function("div", F.datediff(F.to_date(day), F.lit(EPOCH).cast("date")), F.lit(7))


def fiscal_columns(n="n") -> list[Column]:
    n = F.col(n)
    return [
        (F.lit(1995) + F.call_function("div", n, F.lit(52))).cast("int").alias("fiscal_year"),
        (F.lit(1) + n % 52).cast("int").alias("fiscal_week"),
    ]


def _cents(c) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def cal(spark: SparkSession) -> DataFrame:
    """One row per fiscal week: its Saturday twice (plain and end-of-period) and fiscal fields."""
    week = F.col("id").cast("int")
    saturday = F.date_add(F.lit("1995-01-07").cast("date"), (week * 7).cast("int"))
    return spark.range(CALENDAR_WEEKS).select(
        saturday.alias("calendar_date"),
        saturday.alias("eop_calendar_date"),
        (F.lit(1995) + F.call_function("div", week, F.lit(52))).cast("int").alias("fiscal_year"),
        F.least(F.lit(12), 1 + F.call_function("div", week % 52, F.lit(4))).cast("int").alias("fiscal_month"),
        (1 + week % 52).cast("int").alias("fiscal_week"),
    )


def macro_weekly(spark: SparkSession) -> DataFrame:
    n = F.col("id").cast("double")
    return spark.range(CALENDAR_WEEKS).select(
        *fiscal_columns("id"),
        (5.0 + F.abs(n % 52 - 26) * 0.5).alias("avg_temp"),
        (20.0 + n % 13).alias("rain"),
        (100000.0 + n * 25).alias("gdp_millions"),
        (n % 17 / 16).alias("inflation_pct"),
        (450.0 + n * 0.25).alias("earnings_all"),
        (300.0 + n * 0.125).alias("earnings_retail"),
    )


def holidays(spark: SparkSession) -> DataFrame:
    week = F.col("fiscal_week")
    return spark.range(CALENDAR_WEEKS).select(*fiscal_columns("id")).select(
        "fiscal_year",
        "fiscal_week",
        week.isin(*HOLIDAY_WEEKS["national"]).cast("int").alias("national_events"),
        week.isin(*HOLIDAY_WEEKS["public"]).cast("int").alias("public_holidays"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    kept = F.col("l_returnflag") != "R"
    units = F.col("l_quantity").cast("bigint")
    cents = _cents("l_extendedprice")
    weekly = (
        line.withColumn("n", week_number("l_shipdate"))
        .groupBy("l_partkey", "n")
        .agg(
            F.sum(units).alias("gross"),
            F.coalesce(F.sum(F.when(kept, units)), F.lit(0)).alias("net"),
            F.coalesce(F.sum(F.when(F.col("l_linestatus") == "F", units)), F.lit(0)).alias("pos"),
            F.sum(cents).alias("gross_cents"),
            F.coalesce(F.sum(F.when(kept, cents)), F.lit(0)).alias("net_cents"),
            F.coalesce(F.sum(F.when(F.col("l_linestatus") == "F", cents)), F.lit(0)).alias("pos_cents"),
            F.count(F.lit(1)).alias("line_count"),
        )
    )
    retail = half_up_cents("gross_cents", "gross")
    return weekly.select(
        F.col("l_partkey").alias("merchandise_key"),
        F.lit("AA").alias("location_key"),
        *fiscal_columns(),
        F.col("net").cast("int").alias("net_sales_units"),
        (F.col("net_cents").cast("decimal(16,0)") / 100).cast(MONEY).alias("net_sales_dollars"),
        F.col("gross").cast("int").alias("gross_sales_units"),
        (F.col("gross_cents").cast("decimal(16,0)") / 100).cast(MONEY).alias("gross_sales_dollars"),
        F.col("pos").cast("int").alias("pos_sales_units"),
        (F.col("pos_cents").cast("decimal(16,0)") / 100).cast(MONEY).alias("pos_sales_dollars"),
        (F.col("gross") * 2).cast("int").alias("eop_inventory_units"),
        F.col("gross").cast("int").alias("eop_on_order_units"),
        F.col("line_count").cast("int").alias("store_num_with_inventory"),
        F.col("line_count").cast("int").alias("store_num_with_onorder"),
        retail.alias("current_retail"),
        retail.alias("current_inventory_price"),
    )


def dci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouse inventory. The fact-to-fact join is on the order key; AQE splits a hot order."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    units = F.col("l_quantity").cast("bigint")
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .withColumn("n", week_number("o_orderdate"))
        .groupBy("l_partkey", "n")
        .agg(F.sum(units).alias("units"))
        .select(
            F.col("l_partkey").alias("merchandise_key"),
            *fiscal_columns(),
            (F.col("units") * 2).cast("int").alias("eop_dc_inventory_units"),
            F.col("units").cast("int").alias("eop_dc_on_order_units"),
        )
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    receipts = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.to_date(F.min("l_shipdate")).alias("first_receipt_date"),
            F.to_date(F.max("l_shipdate")).alias("last_receipt_date"),
        )
    )
    cents = _cents("p_retailprice")
    return part.join(receipts, part.p_partkey == receipts.l_partkey, "left").select(
        F.col("p_partkey").alias("merchandise_key"),
        F.lit("AA").alias("location_key"),
        "first_receipt_date",
        "last_receipt_date",
        half_up_cents(cents * 60, F.lit(100)).alias("unit_cost"),
        half_up_cents(cents * 2, F.lit(1)).alias("full_price"),
    )


def items_cda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("merchandise_key"),
        F.lit("AA").alias("location_key"),
        F.when(F.col("p_size") % 5 == 0, F.lit("NULL"))
        .when(F.col("p_size") % 7 == 0, F.lit(""))
        .otherwise(F.col("p_name"))
        .alias("attribute1"),
        F.lit(None).cast("string").alias("attribute3"),
        (F.col("p_size") * 8).cast("int").alias("attribute3_number"),
    )


def mh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand, department (part type), category (type and brand) and line (the part itself)."""
    category = F.concat_ws("|", "p_type", "p_brand")
    part = read(spark, sf_dir, "part")
    levels = {1: F.col("p_brand"), 3: F.col("p_type"), 4: category}
    columns = [
        value.alias(f"hierarchy{level}_{suffix}")
        for level, value in levels.items()
        for suffix in ("id", "key", "desc")
    ]
    return part.select(
        *columns,
        F.col("p_partkey").alias("hierarchy7_id"),
        F.col("p_partkey").alias("hierarchy7_key"),
        F.col("p_name").alias("hierarchy7_desc"),
    )


def mdtaken(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").filter(F.col("l_discount") >= 0.08)
    paid = _cents("l_extendedprice") * (100 - F.round(F.col("l_discount") * 100).cast("bigint"))
    return (
        line.select(
            F.col("l_partkey").alias("merchandise_key"),
            F.to_date("l_shipdate").alias("effective_date"),
            half_up_cents(paid, F.col("l_quantity").cast("bigint") * 100).alias("price"),
        )
        .groupBy("merchandise_key", "effective_date")
        .agg(F.min("price").alias("price_point"))
        .select("merchandise_key", F.lit("AA").alias("location_key"), "effective_date", "price_point")
    )


def promo(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").filter(F.col("l_tax") >= 0.06)
    start = F.to_date("l_shipdate")
    price = half_up_cents(_cents("l_extendedprice") * 90, F.col("l_quantity").cast("bigint") * 100)
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("promo_key"),
        F.col("l_partkey").alias("merchandise_key"),
        F.lit("AA").alias("location_key"),
        start.alias("promo_start_date"),
        F.date_add(start, F.col("l_linenumber") * 3).alias("promo_end_date"),
        price.cast("double").alias("promo_price"),
        F.concat_ws("-", "l_linestatus", "l_returnflag").alias("promo_desc"),
    )


# ---- inputs that the analyses read but do not build; derived from the part table ----------------


def _category() -> Column:
    return F.concat_ws("|", "p_type", "p_brand")


def cluster_cat_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, pricing group) -> cluster number 1..3."""
    cda = items_cda(spark, sf_dir)
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    from shelfweek.functions.numeric import link_line

    return (
        part.join(cda, part.p_partkey == cda.merchandise_key)
        .groupBy(_category().alias("cat_key"), link_line("attribute1", "merchandise_key").alias("link_line"))
        .agg((1 + F.sum("p_size") % 3).cast("int").alias("cluster_number"))
    )


def product_current_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("p_size") <= 15, "Growth").when(F.col("p_size") <= 35, "Maturity").otherwise("Decline")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("merchandise_key"), stage.alias("stage"))


def category_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category inflection ages; categories whose size total divides by 6 have none."""
    total = F.sum("p_size")
    return (
        read(spark, sf_dir, "part")
        .groupBy(_category().alias("cat_key"))
        .agg(total.alias("size_total"))
        .filter(F.col("size_total") % 6 != 0)
        .select(
            "cat_key",
            (F.col("size_total") / 1000).cast("double").alias("phi1"),
            (F.col("size_total") % 200).cast("double").alias("phi2"),
            (1 + F.col("size_total") % 30).cast("double").alias("phi3"),
            (40 + F.col("size_total") % 60).cast("int").alias("infl1"),
            (120 + F.col("size_total") % 110).cast("int").alias("infl2"),
        )
    )


def all_cats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(_category().alias("all_categories")).distinct()


def elasticities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw coefficients per (department, category, cluster); some valid, some out of bounds."""
    total, count = F.sum("p_partkey"), F.count(F.lit(1))
    return (
        read(spark, sf_dir, "part")
        .groupBy(
            F.col("p_type").alias("dept_key"),
            _category().alias("cat_key"),
            (1 + F.col("p_size") % 3).cast("string").alias("cluster_key"),
        )
        .agg(total.alias("t"), count.alias("c"))
        .select(
            "dept_key",
            "cat_key",
            "cluster_key",
            ((F.col("t") * 7 + F.col("c")) % 97 / 1000).cast("double").alias("pos_pe"),
            ((F.col("t") * 5 + F.col("c")) % 211 / 1000).cast("double").alias("first_pe"),
            F.when(F.col("t") % 4 != 0, ((F.col("t") * 3) % 499 / 1000).cast("double")).alias("further_pe"),
        )
    )
