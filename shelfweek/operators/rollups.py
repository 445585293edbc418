"""Elasticity data sets: discount types, ages, cycle types, cluster keys and weekly roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfweek.functions.numeric import dbl, exact_avg, link_line, ratio, trunc_avg
from shelfweek.functions.order_stats import second_quartile_max
from shelfweek.functions.weeks import calendar_ranks, pack_week, packed_week, packed_year, year_week_text

YW = ["fiscal_year", "fiscal_week"]


def discount_type(
    f: DataFrame, items_cda: DataFrame, clusters: DataFrame, stages: DataFrame | None = None, location: str = "AA"
) -> DataFrame:
    """Discount type per product week, with pricing group, current stage and cluster number.

    'POS' is an unmarked week within two recorded weeks of a markdown.
    """
    ordered = Window.partitionBy("product_key").orderBy(*YW)
    groups = items_cda.filter(F.col("location_key") == location).select(
        "merchandise_key", link_line("attribute1", "merchandise_key").alias("link_line")
    )
    df = (
        f.filter(F.col("merchandise_key").isNotNull())
        .withColumn("pos_flag_lead", F.lead("md_taken_flag", 2).over(ordered))
        .join(groups, "merchandise_key", "left")
    )
    if stages is not None:
        df = df.join(stages.select("merchandise_key", "stage"), "merchandise_key", "left")
    kind = (
        F.when(F.col("md_taken_flag").isNull() & F.col("pos_flag_lead").isNotNull(), "POS")
        .when(F.col("md_flag").isin("First", "Further"), F.col("md_flag"))
        .otherwise("None")
    )
    clusters = clusters.select("cat_key", "link_line", "cluster_number")
    return df.withColumn("disc_type_flag", kind).join(clusters, ["cat_key", "link_line"], "left")


def fiscal_week_rank(cal: DataFrame) -> DataFrame:
    """Calendar with yyyyww text and its overall rank (one row per fiscal week, bounded by time)."""
    text = year_week_text("fiscal_year", "fiscal_week")
    return cal.withColumn("year_week", text).withColumn(
        "overall_rank", F.rank().over(Window.orderBy("year_week"))
    )


def launches(ages: DataFrame) -> DataFrame:
    """Distinct (product, category, final launch) from ``lifecycle.product_age``."""
    return ages.select("merchandise_key", "cat_key", "final_launch_date").distinct()


def age_table(launch: DataFrame, cal: DataFrame, last_rank: int = 136) -> DataFrame:
    """Every week from launch to calendar rank ``last_rank`` with the age in weeks (1 at launch).

    The ``rank >= start`` join becomes an explode of a rank sequence.
    """
    ranks = calendar_ranks(cal)
    start = F.broadcast(
        ranks.select(pack_week(*YW).alias("final_launch_date"), F.col("week_rank").alias("overall_rank"))
    )
    return (
        launch.join(start, "final_launch_date")
        .filter(F.col("overall_rank") <= last_rank)
        .withColumn("week_rank", F.explode(F.sequence("overall_rank", F.lit(last_rank))))
        .join(F.broadcast(ranks), "week_rank")
        .withColumn("age_weeks", F.col("week_rank") - F.col("overall_rank") + 1)
        .select("merchandise_key", "cat_key", "final_launch_date", "overall_rank", "week_rank", *YW, "age_weeks")
    )


def inflection_fallback(all_cats: DataFrame, mh: DataFrame, fit: DataFrame) -> DataFrame:
    """Inflection ages per category, from the department's truncated average where not fitted."""
    levels = mh.select(
        F.col("hierarchy4_id").alias("cat_key"), F.col("hierarchy3_id").alias("dept_key"),
        F.col("hierarchy3_desc").alias("dept_desc"),
    ).distinct()
    fit = fit.select("cat_key", "infl1", "infl2")
    dept = (
        levels.join(fit, "cat_key")
        .select("dept_key", "cat_key", "infl1", "infl2")
        .distinct()
        .groupBy("dept_key")
        .agg(trunc_avg("infl1").alias("dept_infl1"), trunc_avg("infl2").alias("dept_infl2"))
    )
    cats = (
        all_cats.select(F.col("all_categories").alias("cat_key"))
        .distinct()
        .join(levels.select("cat_key", "dept_key").distinct(), "cat_key")
        .join(fit, "cat_key", "left")
    )
    return cats.join(dept, "dept_key", "left").select(
        "cat_key",
        F.coalesce("infl1", "dept_infl1").alias("infl1"),
        F.coalesce("infl2", "dept_infl2").alias("infl2"),
    )


def cycle_type(age: str = "age_weeks", strict: bool = False):
    """G / M / D / None from an age and the inflections; ``strict`` makes both bounds exclusive."""
    a = F.col(age)
    grown = a < F.col("infl1") if strict else a <= F.col("infl1")
    mature = a < F.col("infl2") if strict else a <= F.col("infl2")
    known1, known2 = F.col("infl1").isNotNull() & a.isNotNull(), F.col("infl2").isNotNull() & a.isNotNull()
    return (
        F.when(known1 & grown, "G")
        .when(known1 & known2 & ~grown & mature, "M")
        .when(known2 & ~mature, "D")
        .otherwise("None")
    )


def product_level(
    typed: DataFrame,
    launch: DataFrame,
    cal: DataFrame,
    infl: DataFrame,
    last_rank: int = 136,
    columns: Sequence[str] = ("dept_desc", "dept_key", "cat_desc"),
    strict: bool = False,
) -> DataFrame:
    """Product weeks with age, inflections and cycle type.

    Only rows with an age remain (the reference's left join is filtered on its right side). The age is
    computed from calendar ranks, so the product x week age table is not built or joined.
    """
    ranks = calendar_ranks(cal)
    here = F.broadcast(ranks)
    start = F.broadcast(
        ranks.select(pack_week(*YW).alias("final_launch_date"), F.col("week_rank").alias("overall_rank"))
    )
    keep = [
        *columns, "merchandise_key", "cat_key", *YW, "age_weeks", "gross_sales_units", "regular_price",
        "final_price", "eop_dc_on_order_units", "inventory", "link_line", "cluster_number", "disc_type_flag",
        "infl1", "infl2",
    ]
    return (
        typed.join(launch, ["merchandise_key", "cat_key"])
        .join(start, "final_launch_date")
        .join(here, YW)
        .filter((F.col("week_rank") >= F.col("overall_rank")) & (F.col("week_rank") <= last_rank))
        .withColumn("age_weeks", F.col("week_rank") - F.col("overall_rank") + 1)
        .join(infl.select("cat_key", "infl1", "infl2"), "cat_key", "left")
        .select(*keep)
        .withColumn("cycle_type", cycle_type(strict=strict))
    )


def cluster_key(p: DataFrame, lo: int = 10, mid_hi: int = 19) -> DataFrame:
    """Pool small categories: < lo groups -> department, lo..mid_hi -> category, more -> cluster.

    The second version of the reference uses ``mid_hi=20``. The distinct count runs on pre-aggregated
    (department, category, pricing group) rows.
    """
    size = p.groupBy("dept_key", "cat_key").agg(F.count_distinct("link_line").alias("no_link_lines"))
    n = F.col("no_link_lines")
    cluster = F.coalesce(F.col("cluster_number").cast("string"), F.lit(""))
    key = (
        F.when(n < lo, F.concat_ws("_", "dept_key", F.lit("1")))
        .when(n.between(lo, mid_hi), F.concat_ws("_", "cat_key", F.lit("1")))
        .when(n > mid_hi, F.concat_ws("_", F.col("cat_key"), cluster))
    )
    return p.join(size, ["dept_key", "cat_key"]).withColumn("cluster_key", key)


def category_cluster_map(keyed: DataFrame) -> DataFrame:
    return keyed.select("cat_key", "cluster_key").distinct()


def product_cluster_map(keyed: DataFrame) -> DataFrame:
    return keyed.select("merchandise_key", "cluster_key").distinct()


def rollup(
    p: DataFrame,
    holidays: DataFrame,
    cal: DataFrame | None,
    group_cols: Sequence[str],
    weighting: str = "fallback",
    shares: str | None = "with_none",
    lag_by: Sequence[str] | None = None,
    rank_by: Sequence[str] | None = None,
    dense: bool = False,
    flag_at: float | None = None,
    flag_name: str = "high_discount_flag",
    holiday: str | None = "max",
) -> DataFrame:
    """Weekly roll-up of product weeks to ``group_cols``.

    ``weighting``: 'fallback' uses the plain average price where no units sold (NULL when the sum is
    negative); 'nullif' leaves it NULL and truncates the average age. ``shares``: discount-type shares
    over all four types, over the three discounted ones ('without_none'), or none. ``lag_by`` adds last
    week's inventory ratio and inventory; ``rank_by`` the weeks since launch; ``flag_at`` a discount
    flag; ``holiday`` combines the two holiday columns by 'max' or 'any'. The windows run over weekly
    rows of one group, whose number time bounds.
    """
    units = F.col("gross_sales_units")
    total = F.sum(units)

    def weighted(price: str):
        mean = ratio(F.sum(units * F.col(price)), total)
        if weighting == "nullif":
            return mean
        return F.when(total > 0, mean).when(total == 0, exact_avg(price))

    def tally(column: str, value: str):
        return F.count(F.when(F.col(column) == value, F.col("merchandise_key"))).cast("bigint")

    age = trunc_avg("age_weeks") if weighting == "nullif" else F.avg(dbl("age_weeks"))
    aggs = [
        total.alias("gross_sales_units"),
        weighted("regular_price").alias("weighted_regular_price"),
        weighted("final_price").alias("weighted_final_price"),
        F.sum("eop_dc_on_order_units").alias("eop_dc_on_order_units"),
        F.sum("inventory").alias("inventory"),
        age.alias("age_weeks"),
        tally("cycle_type", "D").alias("decline"),
        tally("cycle_type", "G").alias("growth"),
        tally("cycle_type", "M").alias("maturity"),
    ]
    kinds = {"pos": "POS", "first_mk": "First", "further": "Further", "none_": "None"}
    if shares == "without_none":
        kinds.pop("none_")
    if shares:
        aggs += [tally("disc_type_flag", value).alias(name) for name, value in kinds.items()]
    df = p.groupBy(*group_cols, *YW).agg(*aggs)

    cycles = F.col("decline") + F.col("growth") + F.col("maturity")
    regular, final = F.col("weighted_regular_price"), F.col("weighted_final_price")
    derived = {
        "md_discount": F.try_divide(regular - final, regular) * 100,
        "inventory_ratio": ratio("inventory", "gross_sales_units"),
        "decline_perc": ratio("decline", cycles),
        "growth_perc": ratio("growth", cycles),
        "maturity_perc": ratio("maturity", cycles),
    }
    if shares:
        counted = sum((F.col(name) for name in kinds), F.lit(0))
        names = {"pos": "pos_perc", "first_mk": "first_perc", "further": "further_perc", "none_": "regular_perc"}
        derived |= {names[name]: ratio(name, counted) for name in kinds}
    df = df.withColumns(derived).join(F.broadcast(holidays), YW, "left")
    if cal is not None:
        month = cal.select(*YW, F.col("fiscal_month").alias("month_flag"))
        df = df.join(F.broadcast(month), YW, "left")
    if lag_by:
        ordered = Window.partitionBy(*lag_by).orderBy(*YW)
        df = df.withColumns(
            {
                "inventory_ratio_lag": F.lag("inventory_ratio", 1, 0.0).over(ordered),
                "inventory_lag": F.lag("inventory", 1, 0).over(ordered),
            }
        )
    if rank_by:
        ordered = Window.partitionBy(*rank_by).orderBy(*YW)
        df = df.withColumn("weeks_since_launch", (F.dense_rank() if dense else F.rank()).over(ordered))
    if flag_at is not None:
        df = df.withColumn(flag_name, F.when(F.col("md_discount") >= flag_at, 1).otherwise(0))
    national, public = F.col("national_events"), F.col("public_holidays")
    if holiday == "max":
        df = df.withColumn("holiday_flag", F.when(national > public, national).otherwise(public))
    elif holiday == "any":
        df = df.withColumn("holiday_flag", F.when((national >= 1) | (public >= 1), 1).otherwise(0))
    return df


def rollup_type1(keyed: DataFrame, holidays: DataFrame, cal: DataFrame) -> DataFrame:
    by = ["dept_desc", "cluster_key"]
    return rollup(keyed, holidays, cal, by, lag_by=by, rank_by=by)


def rollup_type2(keyed: DataFrame, holidays: DataFrame, cal: DataFrame) -> DataFrame:
    by = ["dept_desc", "cluster_key"]
    return rollup(
        keyed, holidays, cal, [*by, "disc_type_flag"], shares=None, lag_by=[*by, "disc_type_flag"],
        rank_by=by, dense=True, flag_at=40, holiday="any",
    )


def rollup_seasonality(p: DataFrame, holidays: DataFrame, cal: DataFrame) -> DataFrame:
    by = ["dept_desc", "cat_key"]
    return rollup(p, holidays, cal, by, lag_by=by, rank_by=by, flag_at=40)


def rollup_interim(p: DataFrame, holidays: DataFrame, by_type: bool = False, with_dept: bool = True) -> DataFrame:
    """Earlier roll-ups by category and cluster number, optionally by discount type, with a >= 60 flag."""
    group = (["dept_desc", "cat_key", "cat_desc"] if with_dept else ["cat_key"]) + ["cluster_number"]
    return rollup(
        p, holidays, None, group + (["disc_type_flag"] if by_type else []), weighting="nullif",
        shares=None if by_type else "without_none", flag_at=60, flag_name="discount_flag", holiday=None,
    )


def high_discount(r: DataFrame) -> DataFrame:
    """Flag weeks discounted deeper than the department's second-quartile maximum; share x discount terms."""
    middle = second_quartile_max(r, ["dept_desc"], "md_discount", "median_disc")
    return r.join(middle, "dept_desc").withColumns(
        {
            "high_disc_flag": F.when(F.col("md_discount") > F.col("median_disc"), 1).otherwise(0),
            "pos_disc": F.col("pos_perc") * F.col("md_discount"),
            "first_disc": F.col("first_perc") * F.col("md_discount"),
            "further_disc": F.col("further_perc") * F.col("md_discount"),
            "holiday": F.when(F.col("holiday_flag") >= 1, 1).otherwise(0),
        }
    ).drop("median_disc")


def category_phase(r: DataFrame, mapping: DataFrame, infl: DataFrame) -> DataFrame:
    """Cycle type of each roll-up week from the truncated average inflections of its cluster key."""
    bounds = (
        mapping.join(infl.select("cat_key", "infl1", "infl2"), "cat_key")
        .groupBy("cluster_key")
        .agg(trunc_avg("infl1").alias("infl1"), trunc_avg("infl2").alias("infl2"))
    )
    return r.join(bounds, "cluster_key").withColumn("phase_for_category", cycle_type())
