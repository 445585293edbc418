"""Forecast validation: base table, forecast chain, error buckets and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfweek.functions.numeric import dbl, ratio
from shelfweek.operators.rollups import cycle_type

YW = ["fiscal_year", "fiscal_week"]
MODELS = ("es", "ma", "med")


@dataclass(frozen=True)
class Season:
    """A hold-out season: its weeks, the week before (prior state) and the week of its baseline."""

    name: str
    year: int
    first: int
    last: int

    @property
    def prior(self) -> int:
        return self.first - 1

    @property
    def baseline(self) -> int:
        return self.first


# Fixed hold-out seasons.
SEASONS = (
    Season("AW2015", 2015, 17, 21),
    Season("SS2014", 2014, 42, 48),
    Season("SS2015", 2015, 42, 47),
    Season("AW2014", 2014, 16, 21),
)


def _season(seasons: Sequence[Season], bounds) -> Column:
    flag = None
    for s in seasons:
        low, high = bounds(s)
        hit = (F.col("fiscal_year") == s.year) & F.col("fiscal_week").between(low, high)
        flag = F.when(hit, s.name) if flag is None else flag.when(hit, s.name)
    return flag


def validation_base(
    p: DataFrame,
    cal: DataFrame,
    holidays: DataFrame,
    product_map: DataFrame,
    coefs: DataFrame,
    factors: DataFrame,
    si: DataFrame,
    base_es: DataFrame,
    base_ma: DataFrame,
    seasons: Sequence[Season] = SEASONS,
) -> DataFrame:
    """Season weeks of each product with stage, discounts, coefficients, factors and baselines.

    Season weeks are filtered first, so every join below runs on the hold-out rows only.
    """
    staged = p.withColumn("stage", cycle_type(strict=True)).withColumn(
        "discount", ratio(F.col("regular_price") - F.col("final_price"), "regular_price")
    )
    rows = staged.withColumn("season_flag", _season(seasons, lambda s: (s.first, s.last))).filter(
        "season_flag IS NOT NULL"
    )
    rows = rows.select(
        "dept_key", "cat_key", "merchandise_key", *YW, "season_flag", "gross_sales_units", "disc_type_flag",
        F.col("age_weeks").alias("age"), F.col("stage").alias("current_plc"), "discount",
    )
    before = (
        staged.withColumn("season_flag", _season(seasons, lambda s: (s.prior, s.prior)))
        .filter("season_flag IS NOT NULL")
        .select(
            "merchandise_key", "season_flag", F.col("age_weeks").alias("baseline_wsl_first"),
            F.col("stage").alias("prev_plc_stage"), F.col("discount").alias("cd"),
        )
    )

    def baseline(df: DataFrame, **columns: str) -> DataFrame:
        flag = _season(seasons, lambda s: (s.baseline, s.baseline))
        return (
            df.withColumn("season_flag", flag)
            .filter("season_flag IS NOT NULL")
            .select(
                "cat_key", "merchandise_key", "season_flag", *[dbl(c).alias(name) for name, c in columns.items()]
            )
        )

    month = cal.select(*YW, "fiscal_month")
    holiday = F.when((F.col("national_events") >= 1) | (F.col("public_holidays") >= 1), 1).otherwise(0)
    price = coefs.select(
        F.concat_ws("_", "cat_key", "cluster_key").alias("cluster_key"),
        dbl("final_co_eff_md_discount").alias("pe"),
        *[dbl(f"final_co_eff_{k}").alias(f"pe_{k}") for k in ("pos", "first", "further")],
    )
    slope = factors.select(
        "cluster_key", dbl("age_weeks").alias("age_coefficient"), dbl("final_g_coeff").alias("final_g_coeff"),
        dbl("final_m_coeff").alias("final_m_coeff"),
    )
    season_index = si.select("cat_key", F.col("period").alias("fiscal_month"), dbl("new_ssn_exp").alias("si"))
    es = baseline(base_es, base_es="es_fcast", holiday_coefficient="holiday_coefficient")
    ma = baseline(base_ma, base_ma="es_ma", base_med="es_med")
    keys = ["cat_key", "merchandise_key", "season_flag"]
    df = (
        rows.join(F.broadcast(month), YW)
        .join(F.broadcast(holidays), YW, "left")
        .join(product_map, "merchandise_key", "left")
        .join(price, "cluster_key", "left")
        .join(slope, "cluster_key", "left")
        .join(season_index, ["cat_key", "fiscal_month"], "left")
        .join(before, ["merchandise_key", "season_flag"], "left")
        .join(es, keys, "left")
        .join(ma, keys, "left")
        .withColumns({"holiday": holiday, "holiday_factor": F.exp("holiday_coefficient")})
        .drop("national_events", "public_holidays", "holiday_coefficient")
        .distinct()
    )
    by_season = Window.partitionBy("merchandise_key", "season_flag").orderBy(*YW)
    kind = F.col("disc_type_flag")
    return df.withColumns(
        {
            "baseline_wsl": F.coalesce("baseline_wsl_first", F.min("age").over(by_season) - 1),
            "disc_change": F.col("discount") - F.coalesce("cd", "discount"),
            "pe_final": F.when(kind == "POS", F.col("pe_pos"))
            .when(kind == "First", F.col("pe_first"))
            .when(kind == "Further", F.col("pe_further"))
            .otherwise(F.col("pe")),
            "si_final": F.when(F.col("holiday") == 1, F.col("si") * F.col("holiday_factor")).otherwise(F.col("si")),
        }
    )


def forecast_chain(base: DataFrame) -> DataFrame:
    """Age factor -> stage factor -> seasonal index -> price effect, for the three baselines.

    The forecast is the last step that is known; errors and their buckets follow.
    """
    change = F.col("age").cast("int") - F.col("baseline_wsl").cast("int")

    def stage(column: str) -> Column:
        return (
            F.when(F.col(column) == "D", 0.0)
            .when(F.col(column) == "G", F.col("final_g_coeff"))
            .when(F.col(column) == "M", F.col("final_m_coeff"))
        )

    steps: list[dict[str, Column]] = [
        {
            "change_in_wsl": change,
            "current_coeff": stage("current_plc"),
            "prev_plc_coeff": stage("prev_plc_stage"),
        },
        {f"age_{m}": F.col(f"base_{m}") * F.exp(F.col("change_in_wsl") * F.col("age_coefficient")) for m in MODELS},
        {f"stage_{m}": F.exp("current_coeff") / F.exp("prev_plc_coeff") * F.col(f"age_{m}") for m in MODELS},
        {f"si_{m}": F.col("si_final") * F.col(f"stage_{m}") for m in MODELS},
        {f"pe_sales_{m}": F.exp(F.col("pe_final") * F.col("disc_change") * 100) * F.col(f"si_{m}") for m in MODELS},
        {f"final_pred_{m}": F.coalesce(f"pe_sales_{m}", f"si_{m}", f"stage_{m}", f"age_{m}") for m in MODELS},
        {f"mape_{m}": ratio(F.col(f"final_pred_{m}") - F.col("gross_sales_units"), "gross_sales_units") for m in MODELS},
        {f"mape_bucket_{m}": error_bucket(f"mape_{m}") for m in MODELS},
    ]
    for step in steps:
        base = base.withColumns(step)
    return base


def error_bucket(error, null_bucket: int | None = None) -> Column:
    """-3, -2, -1, 1, 2, 3 by the signed error share; NULL goes to 3, or to ``null_bucket``."""
    e = F.col(error) if isinstance(error, str) else error
    bucket = (
        F.when(e < -0.5, -3).when(e < -0.3, -2).when(e < 0, -1).when(e < 0.3, 1).when(e < 0.5, 2).otherwise(3)
    )
    return bucket if null_bucket is None else F.when(e.isNull(), null_bucket).otherwise(bucket)


def validation_summary(v: DataFrame, grain: str, departments: Sequence[str] | None = None) -> DataFrame:
    """Summaries of the forecast chain.

    ``grain``: 'dept_season_totals', 'season_buckets', 'buckets', 'total', 'season', 'dept_season',
    'products'. Bucket grains count products per baseline (long form: baseline, bucket, products).
    """
    if departments is not None:
        v = v.filter(F.col("dept_key").isin(list(departments)))
    preds = [F.sum(f"final_pred_{m}").alias(f"final_pred_{m}") for m in MODELS]
    units = F.sum("gross_sales_units").alias("gross_sales_units")
    if grain == "products":
        return v.agg(F.count_distinct("merchandise_key").alias("products"))
    if grain == "dept_season_totals":
        return v.groupBy("dept_key", "season_flag").agg(*preds)
    groups = {"total": [], "season": ["season_flag"], "dept_season": ["dept_key", "season_flag"]}
    if grain in groups:
        by = groups[grain]
        sums = v.groupBy(*by).agg(units, *preds)
        errors = [
            ratio(F.col(f"final_pred_{m}") - F.col("gross_sales_units"), "gross_sales_units").alias(f"mape_{m}")
            for m in MODELS
        ]
        return sums.select(*by, *errors)
    if grain not in ("season_buckets", "buckets"):
        raise ValueError(f"unknown grain: {grain}")
    by = ["season_flag"] if grain == "season_buckets" else []
    sums = v.groupBy(*by, "merchandise_key").agg(units, *preds)
    sold = F.col("gross_sales_units")
    columns = {}
    for m in MODELS:
        error = F.when(sold == 0, 0.0)
        if by:
            error = error.when(F.col(f"final_pred_{m}").isNull(), -1.0)
        error = error.otherwise(ratio(F.col(f"final_pred_{m}") - sold, sold))
        columns[m] = error_bucket(error, null_bucket=0)
    return (
        sums.select(*by, "merchandise_key", *[c.alias(m) for m, c in columns.items()])
        .unpivot([*by, "merchandise_key"], list(MODELS), "baseline", "bucket")
        .groupBy(*by, "baseline", "bucket")
        .agg(F.count_distinct("merchandise_key").alias("products"))
    )
