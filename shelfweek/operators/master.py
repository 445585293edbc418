"""Weekly master table and its price, launch and markdown features."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfweek.functions.numeric import MONEY, dbl, money
from shelfweek.functions.weeks import WEEKS_PER_YEAR, calendar_ranks, pack_week, packed_week, packed_year, sunday_weeks

PERIOD = ["fiscal_year", "fiscal_week"]


def weekly_master(
    sales: DataFrame,
    dci: DataFrame,
    mh: DataFrame,
    items_cda: DataFrame,
    md_spans: DataFrame,
    promo_week: DataFrame,
    items: DataFrame,
    cal: DataFrame,
    location: str = "AA",
    partitions: int | None = None,
) -> DataFrame:
    """Sales joined with warehouse inventory, hierarchy, attributes, markdowns, promotions and items.

    ``md_spans`` comes from ``prep.markdown_spans`` and ``promo_week`` from ``prep.promo_week_price``.
    Markdowns and promotions belong to the sales side only. Promotions share (product, year, week) with the full
    join; markdowns join once rows lie by product, where a row finds the spans around its calendar rank: a
    product's spans meet its own weeks only. ``product_key`` is the never-NULL key of a row; the
    reference's ``merchandise_key`` is NULL on weeks with warehouse inventory only. ``partitions`` is the number of
    partitions by product, shuffle partitions if None.
    """
    key = ["merchandise_key", *PERIOD]
    sales = sales.filter(F.col("location_key") == location)
    markdown = md_spans.select(
        F.col("merchandise_key").alias("marked_key"),
        "start_rank",
        "last_rank",
        "price_point",
        F.col("key_num").alias("md_taken_flag"),
        sunday_weeks("effective_date", "end_date").alias("md_taken_period"),
    )
    promotion = promo_week.select(
        "merchandise_key",
        F.col("year_start").alias("fiscal_year"),
        F.col("fw").alias("fiscal_week"),
        "promo_price",
        F.when(F.col("max_promo_desc") == F.col("min_promo_desc"), F.col("max_promo_desc"))
        .otherwise(F.concat_ws("; ", "max_promo_desc", "min_promo_desc"))
        .alias("promo_desc"),
    )
    sold = sales.join(promotion, key, "left")
    warehouse = dci.select(
        F.col("merchandise_key").alias("inve_merchandise_key"),
        F.col("fiscal_year").alias("inv_fiscal_year"),
        F.col("fiscal_week").alias("inv_fiscal_week"),
        "eop_dc_inventory_units",
        "eop_dc_on_order_units",
    )
    same = (
        (F.col("merchandise_key") == F.col("inve_merchandise_key"))
        & (F.col("fiscal_year") == F.col("inv_fiscal_year"))
        & (F.col("fiscal_week") == F.col("inv_fiscal_week"))
    )
    both = sold.join(warehouse, same, "full").withColumn(
        "product_key", F.coalesce("merchandise_key", "inve_merchandise_key")
    )
    hierarchy = (
        mh.select(*[f"hierarchy{lv}_{s}" for lv in (1, 3, 4, 7) for s in ("id", "key", "desc")])
        .distinct()
        .withColumn("product_key", F.col("hierarchy7_key"))
    )
    attributes = items_cda.filter(F.col("location_key") == location).select(
        F.col("merchandise_key").alias("product_key"), "attribute1", "attribute3", "attribute3_number"
    )
    cost = items.filter(F.col("location_key") == location).select(
        F.col("merchandise_key").alias("product_key"), "unit_cost", "full_price"
    )
    in_force = (
        (F.col("product_key") == F.col("marked_key"))
        & F.col("merchandise_key").isNotNull()
        & F.col("week_rank").between(F.col("start_rank"), F.col("last_rank"))
    )
    return (
        both.repartition(*([partitions] if partitions else []), "product_key")
        .join(F.broadcast(calendar_ranks(cal)), PERIOD, "left")
        .join(markdown, in_force, "left")
        .drop("marked_key", "week_rank", "start_rank", "last_rank")
        .join(hierarchy, "product_key", "left")
        .join(attributes, "product_key", "left")
        .join(cost, "product_key", "left")
    )


def _tagged(df: DataFrame) -> DataFrame:
    return df if "has_sales" in df.columns else df.withColumn("has_sales", F.col("merchandise_key").isNotNull())


def _untagged(df: DataFrame, source: DataFrame) -> DataFrame:
    return df if "has_sales" in source.columns else df.drop("has_sales")


def _series(*extra):
    """Window key of one product's sales weeks.

    Inventory-only weeks share a NULL merchandise key in the reference; keyed by product they form
    bounded groups of their own (their prices are NULL anyway).
    """
    return Window.partitionBy("product_key", "has_sales", *extra)


RENAMED = {
    "attribute1": "pricing_group",
    "attribute3": "exit_date",
    "attribute3_number": "no_wk_business",
    **{
        f"hierarchy{level}_{suffix}": name if suffix == "id" else f"{name}_{suffix}"
        for level, name in ((1, "brand"), (3, "dept"), (4, "cat"), (7, "line"))
        for suffix in ("id", "key", "desc")
    },
}


def price_features(master: DataFrame) -> DataFrame:
    """Final price, promotion discount, price before markdown, regular prices and discounts.

    The windows are ordered so that rows are sorted twice only: by week, then by markdown and week.
    """
    by_week = _series().orderBy(*PERIOD)
    by_flag_week = _series("md_taken_flag").orderBy(*PERIOD)
    retail, promo, point = F.col("current_retail"), F.col("promo_price"), F.col("price_point")
    marked = F.col("md_taken_flag").isNotNull()
    df = (
        _tagged(master.withColumnsRenamed(RENAMED))
        .withColumns(
            {"previous": F.lag(retail).over(by_week), "first_week": F.row_number().over(by_week) == 1}
        )
        .withColumn("previous_same", F.lag(retail).over(by_flag_week))
        .withColumn(
            "md_price",
            F.coalesce(
                F.when(point.isNotNull(), F.col("previous_same"))
                .when(F.col("first_week"), retail)
                .otherwise(F.col("previous")),
                F.col("previous"),
            ).cast(MONEY),
        )
        .drop("previous", "first_week", "previous_same")
        .withColumn("top_in_markdown", F.max("md_price").over(_series("md_taken_flag")))
        .withColumn("top_marked", F.max(F.when(marked, F.col("md_price"))).over(_series()))
    )
    base = F.when(promo > dbl(retail), dbl("full_price")).otherwise(dbl(retail))
    df = df.withColumns(
        {
            "final_price": F.coalesce(money(promo), point, retail).cast(MONEY),
            "promo_discount": F.try_divide((base - promo) * 100.0, base),
            "running_regular_price": F.when(marked, F.col("top_in_markdown")).otherwise(F.col("md_price")),
            "regular_price": F.when(marked, F.col("top_marked")).otherwise(F.col("md_price")),
        }
    )
    run, regular = dbl("running_regular_price"), dbl("regular_price")
    df = df.withColumns(
        {
            "promo_price": money("promo_price"),
            "md_discount_run": F.try_divide((run - dbl(point)) * 100.0, run),
            "md_discount": F.try_divide((regular - dbl(point)) * 100.0, regular),
        }
    )
    return _untagged(df.drop("top_in_markdown", "top_marked"), master)


def _sales_week():
    return F.when(F.col("has_sales"), F.row_number().over(_series().orderBy(*PERIOD)))


def launch_and_inventory(f: DataFrame, wk_per_year: int = WEEKS_PER_YEAR) -> DataFrame:
    """Total inventory, weeks seen, last period, markdown week number and launch period.

    Launch is cast back from the last week by the weeks in business when those exceed the weeks seen,
    else the first period seen. Rows without sales carry NULL counters (the reference counts across
    every such row of every product, which has no meaning per product).
    """
    units = [F.coalesce(c, F.lit(0)) for c in ("eop_dc_inventory_units", "eop_inventory_units", "eop_on_order_units")]
    keyed = F.col("has_sales")
    period = pack_week("fiscal_year", "fiscal_week")
    back = F.col("no_wk_business") - packed_week("max_period")
    cast_back = (packed_year("max_period") - (F.floor(back / wk_per_year) + 1)) * 100 + (
        wk_per_year - F.pmod(back, F.lit(wk_per_year))
    )
    df = (
        _tagged(f)
        .withColumn("inventory", units[0] + units[1] + units[2])
        .withColumn("base_md", F.when(keyed, F.row_number().over(_series("md_taken_flag").orderBy(*PERIOD))))
        .withColumns(
            {
                "cnt": F.when(keyed, F.count(F.lit(1)).over(_series())).cast("int"),
                "max_period": F.max(period).over(_series()),
                "min_period": F.min(period).over(_series()),
            }
        )
        .withColumn("no_sales_wk", F.col("no_sales_wk") if "no_sales_wk" in f.columns else _sales_week())
        .withColumn(
            "launch_date",
            F.when(F.col("no_wk_business") > F.col("cnt"), cast_back)
            .when(F.col("no_wk_business") <= F.col("cnt"), F.col("min_period"))
            .cast("int"),
        )
        .drop("min_period")
    )
    return _untagged(df, f)


def markdown_flag(f: DataFrame, floor: float = 0.02) -> DataFrame:
    """'First' / 'Further' markdown weeks; 'Further' needs inventory above a share of the first week's."""
    number = F.col("md_taken_flag")
    opening = F.when((number == 1) & (F.col("base_md") == 1), F.col("inventory") + F.col("net_sales_units"))
    share = F.max(opening).over(_series()) * F.lit(Decimal(str(floor)))
    first = (number == 1) & (F.coalesce(F.col("promo_price"), F.lit(0)) != F.col("final_price"))
    df = _tagged(f).withColumn(
        "md_flag", F.when(first, "First").when((number > 1) & (F.col("inventory") > share), "Further")
    )
    return _untagged(df, f)


# Columns the feature steps read; every other column only rides along.
USED = (
    "product_key", "merchandise_key", "fiscal_year", "fiscal_week", "net_sales_units", "current_retail",
    "full_price", "promo_price", "price_point", "md_taken_flag", "no_wk_business", "eop_inventory_units",
    "eop_on_order_units", "eop_dc_inventory_units",
)


def features(master: DataFrame) -> DataFrame:
    """The full feature table: prices, launch, inventory and markdown flag.

    Columns that no window reads travel as one struct, so sorting copies few fields per row. Weeks are numbered first:
    the next step wants that order too, and what follows sorts rows once more, by markdown and week.
    """
    named = _tagged(master.withColumnsRenamed(RENAMED))
    riders = [c for c in named.columns if c not in (*USED, "has_sales")]
    df = named.select(*USED, "has_sales", F.struct(*riders).alias("riders")).withColumn("no_sales_wk", _sales_week())
    df = markdown_flag(launch_and_inventory(price_features(df))).drop("has_sales")
    return df.select(*[c for c in df.columns if c != "riders"], "riders.*")
