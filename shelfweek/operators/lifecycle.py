"""Product life cycle: spines, cumulative sell-through, ages, stages and growth curves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfweek.functions.curves import fit_logistic
from shelfweek.functions.numeric import ratio, ratio_or, trunc_avg
from shelfweek.functions.weeks import pack_week, packed_week, packed_year, week_array, week_gap, week_places

LINE = ["dept_key", "dept_desc", "cat_key", "cat_desc", "line"]
CATEGORY = ["dept_key", "dept_desc", "cat_key", "cat_desc"]
YW = ["fiscal_year", "fiscal_week"]


def _periods(f: DataFrame) -> DataFrame:
    return f.filter(F.col("fiscal_year").isNotNull() & F.col("fiscal_week").isNotNull())


def week_line_spine(f: DataFrame) -> DataFrame:
    """Every line with every fiscal week seen. Weeks travel as one array, so there is no cross join."""
    lines = f.filter(F.col("line").isNotNull()).select(*LINE).distinct()
    weeks = week_array(_periods(f).select(*YW).distinct(), *YW)
    return lines.withColumn("w", F.explode(weeks)).select(*LINE, "w.fiscal_year", "w.fiscal_week")


def first_week_inventory(f: DataFrame, partitions: int | None = None) -> DataFrame:
    """Opening inventory plus inferred replenishment, and the last regular / markdown period per line.

    The previous inventory is taken over weeks with sales only, so that it is well defined. ``partitions`` deals lines
    over so many partitions, shuffle partitions if None; ``line_life_cycle`` goes on in the same ones.
    """
    if partitions:
        f = f.repartition(partitions, "line")
    by_line = Window.partitionBy("line")
    ordered = by_line.orderBy(*YW)
    status = F.when(F.col("md_flag").isNull(), "Reg").otherwise("MD")
    expected = F.coalesce("lag_inv", "inventory") - F.col("net_sales_units")
    gained = F.when(expected - F.col("inventory") < 0, F.col("inventory") - expected).otherwise(0)
    keep = [
        *LINE, *YW, "launch_date", "md_flag", "md_taken_flag", "store_num_with_inventory",
        "store_num_with_onorder", "gross_sales_units", "net_sales_units", "eop_dc_inventory_units",
        "eop_dc_on_order_units", "eop_inventory_units", "eop_on_order_units",
    ]
    return (
        _periods(f)
        .withColumn("lag_inv", F.lag("inventory").over(ordered))
        .withColumn("first_wk_inv", F.first("inventory").over(ordered) + F.sum(gained).over(by_line))
        .withColumn(
            "md_max_date", F.max(pack_week(*YW)).over(Window.partitionBy("line", status))
        )
        .select(*keep, "first_wk_inv", "md_max_date")
        .distinct()
    )


def line_life_cycle(inv: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Zero-filled weeks of each line from launch to end of life, with cumulative measures.

    A line ends at its last markdown week if it was ever marked down, else at its last regular week.
    Recorded weeks are put in order once and know the next one and the sales to date; each then opens into itself and the
    weeks without record that follow it (the first one also into those from the launch on). So neither a line x week spine
    nor a join is needed, and no row is sorted or summed that was not recorded. ``seen`` has the weeks of ``inv`` (fiscal_year,
    fiscal_week) and is read for them in its place.
    """
    zero = [
        "store_num_with_inventory", "store_num_with_onorder", "gross_sales_units", "net_sales_units",
        "eop_dc_inventory_units", "eop_dc_on_order_units", "eop_inventory_units", "eop_on_order_units",
    ]
    recorded = inv.withColumn("yw", pack_week(*YW))
    weeks, place = week_places(_periods(inv if seen is None else seen).select(pack_week(*YW).alias("yw")).distinct())
    ordered = Window.partitionBy("line").orderBy("yw")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked, of_line = F.col("md_flag").isNotNull(), [c for c in LINE if c != "line"]
    ends = F.coalesce(*[F.max(F.when(kind, F.col("md_max_date"))).over(whole) for kind in (marked, ~marked)])
    alive = F.col("yw").between(F.col("launch_date"), F.col("md_max_date"))
    net = F.coalesce("net_sales_units", F.lit(0))
    last, i, at = F.size(weeks) - 1, F.col("i"), F.col("at")
    until = F.when(F.col("next").isNull(), last).when(F.col("next") == F.col("yw"), at).otherwise(place("next") - 1)
    own = i == at
    return (
        recorded.select(
            "line", "yw", *zero, "md_flag", "md_taken_flag",
            *[F.max(c).over(whole).alias(c) for c in (*of_line, "launch_date", "first_wk_inv")], ends.alias("md_max_date"),
            F.lead("yw").over(ordered).alias("next"), (F.row_number().over(ordered) == 1).alias("first"),
        )
        .withColumn(
            "to_date", F.sum(F.when(alive, net).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        )
        .withColumn("at", place("yw"))
        .withColumns(
            {
                "since": F.when(F.col("first"), F.coalesce(place("launch_date"), F.lit(0))).otherwise(at),
                "until": F.least(until, F.coalesce(place("md_max_date"), last)),
            }
        )
        .filter(F.col("since") <= F.col("until"))
        .withColumn("i", F.explode(F.sequence("since", "until")))
        .withColumns({**{c: F.when(own, F.coalesce(c, F.lit(0))).otherwise(0) for c in zero}, "yw": F.get(weeks, i)})
        .filter(alive)
        .select(
            *LINE, packed_year("yw").alias("fiscal_year"), packed_week("yw").alias("fiscal_week"), "launch_date", *zero,
            *[F.when(own, F.col(c)).alias(c) for c in ("md_flag", "md_taken_flag")], "md_max_date", "first_wk_inv",
            F.when(i >= at, F.col("to_date")).otherwise(0).alias("cum_sales"),
        )
        .withColumns(
            {
                "check_out_rate": ratio_or("net_sales_units", "first_wk_inv"),
                "cum_str": ratio_or("cum_sales", "first_wk_inv"),
                "age_in_weeks": week_gap("fiscal_year", "fiscal_week", "launch_date") + 1,
            }
        )
    )


def category_life_cycle(line: DataFrame) -> DataFrame:
    """Category x age totals with the running sell-through against the largest opening inventory."""
    by_age = Window.partitionBy("cat_key").orderBy("age_in_weeks").rowsBetween(Window.unboundedPreceding, 0)
    return (
        line.groupBy(*CATEGORY, "age_in_weeks")
        .agg(
            F.sum("net_sales_units").alias("net_sales_units"),
            F.sum("cum_sales").alias("cum_sales"),
            F.sum("first_wk_inv").alias("first_wk_inv"),
        )
        .withColumns(
            {
                "calc_cum_sales": F.sum("net_sales_units").over(by_age),
                "max_inv": F.max("first_wk_inv").over(Window.partitionBy("cat_key")),
            }
        )
        .withColumns(
            {
                "check_out_rate": ratio_or("net_sales_units", "max_inv"),
                "cst": ratio_or("calc_cum_sales", "max_inv"),
            }
        )
    )


def life_cycle_label(line: DataFrame, fit: DataFrame) -> DataFrame:
    """Stage of each line week from the category's inflection ages."""
    age = F.col("age_in_weeks")
    stage = (
        F.when(F.col("infl1").isNull(), "NA")
        .when(age <= F.col("infl1"), "Growth")
        .when(age <= F.col("infl2"), "Maturity")
        .otherwise("Decline")
    )
    fit = fit.select("cat_key", "phi1", "phi2", "phi3", "infl1", "infl2")
    return line.join(fit, "cat_key", "left").withColumn("plc_stage", stage)


def sell_through(f: DataFrame, key_col: str = "cat_key", as_of: tuple[int, int] = (2016, 37)) -> DataFrame:
    """Running sell-through against opening inventory, with the age at a fixed week.

    Works per category (weeks summed over products, ages averaged with integer truncation) or per
    merchandise. Totals are taken per key, also for merchandise.
    """
    sold = f.filter(F.col("merchandise_key").isNotNull())
    year, week = as_of
    launch = F.col("launch_date")
    product_age = (
        sold.groupBy(*dict.fromkeys([key_col, "merchandise_key"]))
        .agg(
            ((year - F.max(packed_year(launch))) * 52 + (week - F.max(packed_week(launch)))).alias("age_weeks"),
        )
    )
    if key_col == "merchandise_key":
        ages, weekly = product_age, sold.select(key_col, *YW, "net_sales_units", "inventory")
    else:
        ages = product_age.groupBy(key_col).agg(trunc_avg("age_weeks").alias("age_weeks"))
        weekly = sold.groupBy(key_col, *YW).agg(
            F.sum("net_sales_units").alias("net_sales_units"), F.sum("inventory").alias("inventory")
        )
    whole = Window.partitionBy(key_col)
    ordered = whole.orderBy(*YW)
    last = F.max(F.when(F.col("row_n") == 1, F.col("inventory")).otherwise(-1)).over(whole)
    return (
        weekly.withColumns(
            {
                "row_n": F.row_number().over(whole.orderBy(F.desc("fiscal_year"), F.desc("fiscal_week"))),
                "units": F.sum("net_sales_units").over(ordered),
            }
        )
        .withColumn("first_inv", last + F.sum("net_sales_units").over(whole))
        .withColumns(
            {
                "strt_week_inv": F.col("first_inv") - F.coalesce(F.lag("units").over(ordered), F.lit(0)),
                "sell_tr": ratio("units", "first_inv"),
            }
        )
        .join(ages, key_col, "left")
    )


def product_age(f: DataFrame, min_launch: int = 201400, max_years: int | None = None) -> DataFrame:
    """Weekly rows with the final launch period (launch or first sale, the earlier) and the age.

    ``max_years`` (2 in the reference) leaves ages beyond that many fiscal-year steps NULL.
    """
    rows = (
        f.filter(F.col("merchandise_key").isNotNull() & (F.col("launch_date") > min_launch))
        .select(
            "product_key", "merchandise_key", "cat_key", F.col("net_sales_units").alias("sales"),
            F.col("inventory").alias("inv"), pack_week(*YW).alias("yr_wk"), "launch_date", *YW,
        )
        .withColumn(
            "sales_1wk",
            F.min(F.when(F.col("sales") != 0, F.col("yr_wk"))).over(Window.partitionBy("product_key")),
        )
        .withColumn(
            "final_launch_date",
            F.when(F.col("sales_1wk") < F.col("launch_date"), F.col("sales_1wk")).otherwise(F.col("launch_date")),
        )
    )
    age = week_gap("fiscal_year", "fiscal_week", "final_launch_date")
    if max_years is not None:
        step = F.abs(F.col("fiscal_year") - packed_year("final_launch_date"))
        age = F.when(step <= max_years, F.col("yr_wk") - F.col("final_launch_date") - 48 * step)
    return rows.withColumn("age", age.cast("int")).drop("product_key")


def category_age(ages: DataFrame) -> DataFrame:
    """Sales and inventory per (category, age)."""
    return ages.groupBy("cat_key", "age").agg(F.sum("sales").alias("sales"), F.sum("inv").alias("inv"))


def dense_cst(cat_age: DataFrame, max_age: int | None = 135) -> DataFrame:
    """Category x every age 0..max_age (None: the largest there is), running sales over initial inventory."""
    top = cat_age.agg(F.greatest(F.max("age"), F.lit(0)).cast("int").alias("top")) if max_age is None else None
    spine = cat_age.select("cat_key").distinct()
    spine = spine.join(F.broadcast(top)) if max_age is None else spine.withColumn("top", F.lit(max_age))
    spine = spine.select("cat_key", F.explode(F.sequence(F.lit(0), "top")).alias("age"))
    whole = Window.partitionBy("cat_key")
    running = whole.orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    stocked = F.col("inv").isNotNull()
    return (
        spine.join(cat_age, ["cat_key", "age"], "left")
        .fillna(0, subset=["sales"])
        .withColumns(
            {
                "csales": F.sum("sales").over(running),
                "tot_sales": F.sum("sales").over(whole),
                "max_age": F.max(F.when(stocked, F.col("age"))).over(whole),
                "last_inv": F.max_by("inv", F.when(stocked, F.col("age"))).over(whole),
            }
        )
        .withColumn("initial_inv", F.col("tot_sales") + F.col("last_inv"))
        .withColumn("cst", ratio("csales", "initial_inv"))
    )


def quadratic_stage(
    df: DataFrame,
    key: str = "cat_key",
    y: str = "check_out_rate",
    x: str = "cst",
    order: str = "age_in_weeks",
    hi: float = 0.07,
    lo: float = -0.07,
    step: float = 0.005,
) -> DataFrame:
    """Stage G / M / D from the slope of y[t] ~ x[t+1] + x[t+1]^2.

    The fit needs nine power sums per key (partial aggregation, no group is collected). Its slope on
    the grid 0, step, 2*step ... max(x) is linear, so the last or first step within a bound is a division.
    Growth ends at the largest slope <= ``hi``, decline starts at the smallest slope >= ``lo``.
    """
    pairs = df.select(
        key,
        F.col(y).cast("double").alias("y"),
        F.lead(F.col(x).cast("double")).over(Window.partitionBy(key).orderBy(order)).alias("x"),
    ).filter("x IS NOT NULL AND y IS NOT NULL")
    mean = pairs.groupBy(key).agg(F.avg("x").alias("mx"), F.max("x").alias("top"))
    # Powers are centred on the mean of x to keep the 2x2 system well conditioned.
    u = F.col("x") - F.col("mx")
    sums = (
        pairs.join(mean, key)
        .groupBy(key, "mx", "top")
        .agg(
            F.count("*").alias("n"), F.sum(u).alias("s1"), F.sum(u**2).alias("s2"), F.sum(u**3).alias("s3"),
            F.sum(u**4).alias("s4"), F.sum("y").alias("t0"), F.sum(u * F.col("y")).alias("t1"),
            F.sum(u**2 * F.col("y")).alias("t2"),
        )
    )
    c = F.col
    s11 = c("s2") - c("s1") * c("s1") / c("n")
    s12 = c("s3") - c("s1") * c("s2") / c("n")
    s22 = c("s4") - c("s2") * c("s2") / c("n")
    t1 = c("t1") - c("s1") * c("t0") / c("n")
    t2 = c("t2") - c("s2") * c("t0") / c("n")
    det = s11 * s22 - s12 * s12
    fit = (
        sums.withColumns({"det": det, "d1": t1 * s22 - t2 * s12, "d2": s11 * t2 - s12 * t1})
        .withColumns({"g1": F.try_divide("d1", "det"), "g2": F.try_divide("d2", "det")})
        .withColumn("b1", c("g1") - c("g2") * c("mx") * 2)
        .withColumn("last", F.floor(c("top") / step) - 1)
    )
    # slope number i is b1 + g2 * (2i + 1) * step, so the number at which it passes a bound is one division
    passes = lambda bound: (F.try_divide(F.lit(bound) - c("b1"), c("g2") * step) - 1) / 2
    upto = lambda bound: F.least(F.floor(passes(bound)), c("last"))
    since = lambda bound: F.greatest(F.ceil(passes(bound)), F.lit(0))
    number = {
        "growth_end": F.when(c("g2") > 0, upto(hi)).when(c("g2") < 0, since(hi)).when(c("b1") <= hi, 0),
        "decline_start": F.when(c("g2") > 0, since(lo)).when(c("g2") < 0, upto(lo)).when(c("b1") >= lo, 0),
    }
    fit = fit.select(
        key, *[F.when(i.between(0, c("last")), i * step).alias(name) for name, i in number.items()]
    )
    stage = (
        F.when(c(x) >= c("decline_start"), "D").when(c(x) <= c("growth_end"), "G").otherwise("M")
    )
    return df.join(fit, key, "left").withColumn("stage", stage).drop("growth_end", "decline_start")


def logistic_growth(df: DataFrame, key: str = "cat_key", y: str = "cst", x: str = "age_in_weeks") -> DataFrame:
    """Three-parameter logistic per key with the ages where its curvature turns and bottoms out.

    A group is one category's curve: at most one row per age in weeks. Failures give a status row.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        row = fit_logistic(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))
        return pd.DataFrame([{key: pdf[key].iloc[0], **row}])

    field = df.schema[key].dataType.simpleString()
    schema = f"{key} {field}, phi1 double, phi2 double, phi3 double, infl1 int, infl2 int, status string"
    points = df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    # One row per (key, age) whatever the input grain: bounds the group handed to Python.
    points = points.groupBy(key, "x").agg(F.avg("y").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return points.groupBy(key).applyInPandas(fit, schema)
