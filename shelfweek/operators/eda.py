"""Weekly exploratory metrics and their long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfweek.functions.numeric import dbl

WEEK = ("fiscal_year", "fiscal_week")
# Fixed measure list of the long form, in report order (md_price_weight is not reported).
METRIC_MEASURES = (
    "sales", "revenue", "unit_cost_weight", "current_retail_weight", "full_price_weight",
    "final_price_weight", "promo_price_weight", "price_point_weight", "returns_1", "mark_up_weight",
    "new_lower_price_weight", "distinct_products_sold", "promo_discount", "md_discount",
)
MACRO_MEASURES = ("avg_temp", "rain", "gdp_millions", "inflation_pct", "earnings_all", "earnings_retail")
HOLIDAY_MEASURES = ("national_events", "public_holidays")


def eda_metrics(
    f: DataFrame,
    group_cols: Sequence[str] = WEEK,
    guard: bool = False,
    measures: Sequence[str] | None = None,
) -> DataFrame:
    """Units, revenue, unit-weighted prices, returns, products sold and discount depth per group.

    ``guard=True`` divides by 1 where the group sold nothing (department grain); otherwise such a
    group yields NULL. Promotion and markdown prices are weighted over all units of the group.
    One aggregate covers every grain; partial sums are taken before the shuffle.
    """
    units = F.col("gross_sales_units")
    unmarked = F.col("price_point").isNull()
    rows = f.filter(F.col("merchandise_key").isNotNull()).withColumns(
        {
            "mark_up": F.when(
                unmarked & (F.col("full_price") < F.col("current_retail")),
                F.col("current_retail") - F.col("full_price"),
            ),
            "new_lower_price": F.when(
                unmarked & (F.col("full_price") > F.col("current_retail")),
                F.col("full_price") - F.col("current_retail"),
            ),
        }
    )
    weighted = (
        "unit_cost", "current_retail", "full_price", "final_price", "md_price", "promo_price",
        "price_point", "mark_up", "new_lower_price",
    )
    sums = {c: F.sum(F.col(c) * units).alias(f"s_{c}") for c in weighted}
    aggs = [
        F.sum(units).alias("sales"),
        F.sum("gross_sales_dollars").alias("revenue"),
        F.sum(units - F.col("net_sales_units")).alias("returns_1"),
        F.count_distinct(F.when(units > 0, F.col("merchandise_key"))).alias("distinct_products_sold"),
        F.sum(F.when(F.col("promo_price").isNotNull(), F.col("md_price") * units)).alias("s_promo_base"),
        F.sum(F.when(F.col("price_point").isNotNull(), F.col("regular_price") * units)).alias("s_md_base"),
        *sums.values(),
    ]
    total = dbl("sales")
    divisor = F.when(total == 0, F.lit(1.0)).otherwise(total) if guard else total

    def depth(base: str, paid: str):
        before, after = F.try_divide(dbl(base), divisor), F.try_divide(dbl(paid), divisor)
        scale = F.when(before == 0, F.lit(1.0)).otherwise(before) if guard else before
        return F.try_divide((before - after) * 100.0, scale)

    out = {f"{c}_weight": F.try_divide(dbl(f"s_{c}"), divisor) for c in weighted}
    out["promo_discount"] = depth("s_promo_base", "s_promo_price")
    out["md_discount"] = depth("s_md_base", "s_price_point")
    order = [
        "sales", "revenue", "unit_cost_weight", "current_retail_weight", "full_price_weight",
        "final_price_weight", "md_price_weight", "promo_price_weight", "price_point_weight", "returns_1",
        "mark_up_weight", "new_lower_price_weight", "distinct_products_sold", "promo_discount", "md_discount",
    ]
    keep = list(measures) if measures is not None else order
    return rows.groupBy(*group_cols).agg(*aggs).withColumns(out).select(*group_cols, *keep)


def with_context(metrics: DataFrame, macro: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Join weekly macro measures and, at the overall grain, holiday flags (both one row per week)."""
    df = metrics.join(F.broadcast(macro), list(WEEK), "left")
    return df if holidays is None else df.join(F.broadcast(holidays), list(WEEK), "left")


def eda_long(
    metrics: DataFrame,
    macro: DataFrame,
    holidays: DataFrame | None,
    ids: Sequence[str] = WEEK,
    measures: Sequence[str] | None = None,
) -> DataFrame:
    """Metrics with their weekly context, one row per (ids, measure); NULL values are dropped."""
    if measures is None:
        measures = METRIC_MEASURES + MACRO_MEASURES + (HOLIDAY_MEASURES if holidays is not None else ())
    wide = with_context(metrics, macro, holidays).select(*ids, *[dbl(m).alias(m) for m in measures])
    return wide.unpivot(list(ids), list(measures), "measure", "measure_value").filter(
        F.col("measure_value").isNotNull()
    )
