"""Registered queries: name, output columns, Spark builder and, where SQL can say it, the check."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfweek.functions.weeks import sunday_weeks, week_ending
from shelfweek.operators import (
    baseline,
    eda,
    elasticity,
    lifecycle,
    prep,
    quality,
    returns,
    rollups,
    segments,
    validate,
)
from shelfweek.plans import oracle_models as models
from shelfweek.plans import oracle_tables as sql
from shelfweek.plans.context import MIN_LAUNCH, Context
from shelfweek.session import shared_dir
from shelfweek.sources import files

# Parameters of the return-rate analyses on the derived calendar.
RR_WEEKS = (2001, 17, 32)
HOLDOUT_YEARS = (1999, 2000)
HOLDOUT_WEEKS_NEEDED = 1
SCALE = {"d": 10_000, "f": 1_000_000}
THREE = ("sales", "price", "checkout_rate")


@dataclass(frozen=True)
class Query:
    """``columns`` lists name:kind with kind i (whole number), d or f (4 or 6 decimal places) or s (text)."""

    name: str
    columns: str
    build: Callable[[Context], DataFrame]
    check: str | None = None

    def fields(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def run(self, spark, sf_dir: str) -> DataFrame:
        df = self.build(Context.of(spark, sf_dir))
        out = []
        for name, kind in self.fields():
            c = F.col(name)
            if kind == "i":
                c = c.cast("bigint")
            elif kind in SCALE:
                c = F.floor(c.cast("double") * SCALE[kind] + 0.5) / float(SCALE[kind])
            else:
                c = c.cast("string")
            out.append(c.alias(name))
        return df.select(*out)

    def sql(self) -> str | None:
        if self.check is None:
            return None
        parts = []
        for name, kind in self.fields():
            if kind == "i":
                e = f'CAST("{name}" AS BIGINT)'
            elif kind in SCALE:
                e = f'floor(CAST("{name}" AS DOUBLE) * {SCALE[kind]} + 0.5) / {SCALE[kind]}'
            else:
                e = f'CAST("{name}" AS VARCHAR)'
            parts.append(f'{e} AS "{name}"')
        body = self.check if self.check.lstrip().upper().startswith("SELECT") else f"SELECT * FROM {self.check}"
        return sql.compose(f"SELECT {', '.join(parts)} FROM ({body}) result")


QUERIES: dict[str, Query] = {}


def add(name: str, columns: str, build: Callable[[Context], DataFrame], check: str | None = None) -> None:
    QUERIES[name] = Query(name, columns, build, check)


CAT = "dept_desc:s cat_key:s cat_desc:s"
YW = "fiscal_year:i fiscal_week:i"
PERIODS = "wknd_start:s wknd_end:s year_start:i week_start:i year_end:i week_end:i"

# ---- calendar, items, markdowns, promotions --------------------------------------------------------

add(
    "d01_week_ending",
    "merchandise_key:i first_week_end:s last_week_end:s weeks_between:i",
    lambda c: c.items.select(
        "merchandise_key",
        week_ending("first_receipt_date").alias("first_week_end"),
        week_ending("last_receipt_date").alias("last_week_end"),
        sunday_weeks("first_receipt_date", "last_receipt_date").alias("weeks_between"),
    ),
    f"""SELECT merchandise_key, {sql.week_end('first_receipt_date')} AS first_week_end,
    {sql.week_end('last_receipt_date')} AS last_week_end,
    ({sql.week_end('last_receipt_date')} - {sql.week_end('first_receipt_date')}) // 7 AS weeks_between FROM items""",
)
add(
    "d02_items_with_period",
    f"merchandise_key:i first_receipt_date:s last_receipt_date:s {PERIODS} unit_cost:d full_price:d",
    lambda c: prep.with_period(c.items, c.cal, "first_receipt_date", "last_receipt_date"),
    "items_period",
)
add(
    "d03_markdown_intervals",
    f"merchandise_key:i effective_date:s end_date:s price_point:d {PERIODS}",
    lambda c: c.markdowns(),
    "md_period",
)
add(
    "d04_markdown_sequence",
    "merchandise_key:i effective_date:s key_num:i keys:i week_end:i chngd_week_end:i",
    lambda c: c.markdowns(),
    "md_final",
)
add(
    "d05_promo_with_period",
    f"promo_key:i merchandise_key:i promo_start_date:s promo_end_date:s promo_price:d promo_desc:s {PERIODS}",
    lambda c: c.promo_period(),
    "promo_period",
)
add(
    "d06_promo_week_price",
    "year_start:i fw:i merchandise_key:i promo_price:d max_promo_desc:s min_promo_desc:s",
    lambda c: c.promo_weeks(),
    "promo_lookup",
)

# ---- master and features ----------------------------------------------------------------------------

add(
    "d07_weekly_master",
    f"product_key:i merchandise_key:i {YW} net_sales_units:i gross_sales_units:i pos_sales_units:i "
    "net_sales_dollars:d gross_sales_dollars:d eop_inventory_units:i eop_on_order_units:i current_retail:d "
    "unit_cost:d full_price:d promo_price:d promo_desc:s price_point:d md_taken_flag:i md_taken_period:i "
    "attribute1:s attribute3_number:i hierarchy1_id:s hierarchy3_id:s hierarchy4_id:s hierarchy7_id:i "
    "inve_merchandise_key:i inv_fiscal_year:i inv_fiscal_week:i eop_dc_inventory_units:i eop_dc_on_order_units:i",
    lambda c: c.master(),
    "SELECT *, promo_raw AS promo_price, pricing_group AS attribute1, no_wk_business AS attribute3_number, "
    "brand AS hierarchy1_id, dept AS hierarchy3_id, cat AS hierarchy4_id, line AS hierarchy7_id FROM master",
)
PRICES = (
    "final_price:d promo_price:d promo_discount:d md_price:d running_regular_price:d regular_price:d "
    "md_discount_run:d md_discount:d"
)
add(
    "d08_price_features",
    f"product_key:i merchandise_key:i {YW} inv_fiscal_year:i inv_fiscal_week:i md_taken_flag:i {PRICES}",
    lambda c: c.features,
    "priced",
)
add(
    "d09_launch_and_inventory",
    f"product_key:i merchandise_key:i {YW} inv_fiscal_year:i inv_fiscal_week:i inventory:i cnt:i no_sales_wk:i "
    "base_md:i no_wk_business:i launch_date:i",
    lambda c: c.features,
    "SELECT *, CASE WHEN merchandise_key IS NOT NULL THEN max_period END AS mp FROM launched",
)
add(
    "d10_markdown_flag",
    f"merchandise_key:i {YW} md_taken_flag:i inventory:i max_period:i md_flag:s",
    lambda c: c.features,
    "feat",
)

# ---- exploratory metrics ------------------------------------------------------------------------------

METRICS = " ".join(
    ["sales:i", "revenue:d"]
    + [f"{m}:d" for m in eda.METRIC_MEASURES if m.endswith("_weight")]
    + ["md_price_weight:d", "returns_1:i", "distinct_products_sold:i", "promo_discount:d", "md_discount:d"]
)
DEPT_WEEK = ("fiscal_year", "fiscal_week", "dept_desc")
add("d11a_eda_overall", f"{YW} {METRICS}", lambda c: eda.eda_metrics(c.features), "eda_week")
add(
    "d11b_eda_department",
    f"{YW} dept_desc:s {METRICS}",
    lambda c: eda.eda_metrics(c.features, DEPT_WEEK, guard=True),
    "eda_dept",
)
add(
    "d11c_eda_year_department",
    "fiscal_year:i dept_desc:s full_price_weight:d final_price_weight:d md_discount:d",
    lambda c: eda.eda_metrics(
        c.features, ("fiscal_year", "dept_desc"), True, ("full_price_weight", "final_price_weight", "md_discount")
    ),
    "eda_year",
)
add(
    "d12a_eda_long_overall",
    f"{YW} measure:s measure_value:d",
    lambda c: eda.eda_long(eda.eda_metrics(c.features), c.macro, c.holidays),
    sql.long_form(
        "eda_week",
        ["fiscal_year", "fiscal_week"],
        [*eda.METRIC_MEASURES, *eda.MACRO_MEASURES, *eda.HOLIDAY_MEASURES],
        True,
    ),
)
add(
    "d12b_eda_long_department",
    f"{YW} dept_desc:s measure:s measure_value:d",
    lambda c: eda.eda_long(eda.eda_metrics(c.features, DEPT_WEEK, guard=True), c.macro, None, DEPT_WEEK),
    sql.long_form("eda_dept", list(DEPT_WEEK), [*eda.METRIC_MEASURES, *eda.MACRO_MEASURES], False),
)

# ---- life cycle ---------------------------------------------------------------------------------------

LINE = "dept_key:s dept_desc:s cat_key:s cat_desc:s line:i"
add("d13_week_line_spine", f"{LINE} {YW}", lambda c: lifecycle.week_line_spine(c.features), "spine")
add(
    "d14_first_week_inventory",
    f"{LINE} {YW} launch_date:i md_flag:s md_taken_flag:i net_sales_units:i first_wk_inv:i md_max_date:i",
    lambda c: lifecycle.first_week_inventory(c.features, c.partitions),
    "line_inv",
)
LIFE = (
    f"{LINE} {YW} launch_date:i gross_sales_units:i net_sales_units:i eop_dc_inventory_units:i md_flag:s "
    "md_max_date:i first_wk_inv:i cum_sales:i check_out_rate:d cum_str:d age_in_weeks:i"
)
add("d15_line_life_cycle", LIFE, lambda c: c.lines(), "line_life")
add(
    "d16_category_life_cycle",
    "dept_key:s dept_desc:s cat_key:s cat_desc:s age_in_weeks:i net_sales_units:i cum_sales:i calc_cum_sales:i "
    "first_wk_inv:i max_inv:i check_out_rate:d cst:d",
    lambda c: lifecycle.category_life_cycle(c.lines()),
    "cat_life",
)
add(
    "d17_life_cycle_label",
    f"line:i {YW} age_in_weeks:i phi1:d phi2:d phi3:d infl1:i infl2:i plc_stage:s",
    lambda c: lifecycle.life_cycle_label(c.lines(), c.category_results),
    """SELECT a.*, b.phi1, b.phi2, b.phi3, b.infl1, b.infl2, CASE WHEN b.infl1 IS NULL THEN 'NA'
    WHEN a.age_in_weeks <= b.infl1 THEN 'Growth' WHEN a.age_in_weeks <= b.infl2 THEN 'Maturity' ELSE 'Decline' END AS plc_stage
    FROM line_life a LEFT JOIN cat_results b ON a.cat_key = b.cat_key""",
)
THROUGH = f"{YW} net_sales_units:i inventory:i row_n:i units:i first_inv:i strt_week_inv:i sell_tr:d age_weeks:i"
add(
    "d18a_sell_through_category",
    f"cat_key:s {THROUGH}",
    lambda c: lifecycle.sell_through(c.features, "cat_key", c.as_of_week),
    "sell_cat",
)
add(
    "d18b_sell_through_merchandise",
    f"merchandise_key:i {THROUGH}",
    lambda c: lifecycle.sell_through(c.features, "merchandise_key", c.as_of_week),
    "sell_merch",
)
AGE = f"merchandise_key:i cat_key:s {YW} sales:i inv:i launch_date:i sales_1wk:i final_launch_date:i age:i"
add("d19_product_age", AGE, lambda c: c.ages(), "aged")
add(
    "d19_product_age_two_years",
    AGE,
    lambda c: lifecycle.product_age(c.features, MIN_LAUNCH, max_years=2),
    "SELECT merchandise_key, cat_key, fiscal_year, fiscal_week, sales, inv, launch_date, sales_1wk, final_launch_date, "
    "age_ref AS age FROM aged",
)
add(
    "d19_category_age",
    "cat_key:s age:i sales:i inv:i",
    lambda c: lifecycle.category_age(c.ages()),
    "cat_age",
)
add(
    "d20_dense_cst",
    "cat_key:s age:i sales:i inv:i csales:i tot_sales:i max_age:i last_inv:i initial_inv:i cst:d",
    lambda c: lifecycle.dense_cst(lifecycle.category_age(c.ages()), None),
    "dense",
)
add(
    "d21_quadratic_stage",
    "cat_key:s age_in_weeks:i stage:s",
    lambda c: lifecycle.quadratic_stage(c.category_life),
    """SELECT a.cat_key, a.age_in_weeks, CASE WHEN a.cst >= b.decline_start THEN 'D' WHEN a.cst <= b.growth_end THEN 'G'
    ELSE 'M' END AS stage FROM cat_life a LEFT JOIN quad_bounds b ON a.cat_key = b.cat_key""",
)
add(
    "d22_logistic_growth",
    "cat_key:s phi1:d phi2:d phi3:d infl1:i infl2:i status:s",
    lambda c: lifecycle.logistic_growth(c.category_life),
)

# ---- baselines ----------------------------------------------------------------------------------------

SERIES = f"{YW} period:i merchandise_key:i cat_key:s gross_sales_units:i"


def series(c: Context) -> DataFrame:
    return c.series()


add("d23_period_sales", SERIES, series, "series")
add(
    "d24_seasonal_index",
    f"{SERIES} product_ts:d s_r_forecast:d",
    lambda c: c.seasoned(),
    "seasoned",
)
SMOOTH = "es_fcast:d err:d alpha:d"
add(
    "d25_adaptive_smoothing",
    f"merchandise_key:i period:i s_r_forecast:d {SMOOTH}",
    lambda c: baseline.adaptive_smoothing(c.seasoned()),
    "SELECT *, y AS s_r_forecast FROM smooth_season",
)
add(
    "d25_adaptive_smoothing_units",
    f"merchandise_key:i period:i y:d {SMOOTH}",
    lambda c: c.smoothed_units().withColumnRenamed("s_r_forecast", "y"),
    "smooth_units",
)

# ---- return rates ---------------------------------------------------------------------------------------

RATE = f"{CAT} {YW} gross_sales:i return_units:i return_rate:d"
add("d26_return_rate", RATE, lambda c: returns.return_rate(c.features, RR_WEEKS), "rr")
add(
    "d27a_return_rate_ma_error",
    f"{RATE} pred_ma:d perc_rr:d",
    lambda c: returns.return_rate_ma_error(returns.return_rate(c.features, RR_WEEKS)),
    """SELECT *, (return_rate - pred_ma) / NULLIF(return_rate, 0) * 100 AS perc_rr FROM (
    SELECT *, AVG(return_rate) OVER (PARTITION BY cat_key, fiscal_year ORDER BY fiscal_week ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)
    AS pred_ma FROM rr) WHERE fiscal_week IN (31, 32)""",
)
add(
    "d27b_return_rate_pooled",
    f"{RATE} pred_ma:d pred_next:d",
    lambda c: returns.return_rate_pooled(returns.return_rate(c.features, RR_WEEKS)),
    """SELECT *, CAST(SUM(return_units) OVER (w ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS DOUBLE)
      / NULLIF(SUM(gross_sales) OVER (w ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING), 0) AS pred_ma,
    CAST(SUM(return_units) OVER (w ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS DOUBLE)
      / NULLIF(SUM(gross_sales) OVER (w ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS pred_next
    FROM rr WINDOW w AS (PARTITION BY cat_key, fiscal_year ORDER BY fiscal_week)""",
)
MA = f"{CAT} {YW} gross_sales:i return_units:i min_ld:i wkly_rr:d ma_n_wk_rr:d pred_rr:d"
MA_POST = MA + " returns_post_2wk:i"
add("d28a_return_rate_ma", MA, lambda c: returns.return_rate_ma(c.features), "ma13")
add(
    "d28b_return_rate_ma_carried",
    MA_POST,
    lambda c: returns.return_rate_ma(c.features, carry_shift=2),
    "ma13",
)


def mape_sql(low: int, high: int) -> str:
    return f"""SELECT dept_desc, cat_key, cat_desc, AVG(CASE WHEN wkly_rr = 0 THEN 0 ELSE abs(wkly_rr - ma_n_wk_rr) / wkly_rr END) AS mape
    FROM ma13 WHERE fiscal_year = 2001 AND fiscal_week BETWEEN {low} AND {high} AND gross_sales > 0 GROUP BY 1, 2, 3"""


add(
    "d29a_mape_last_10_weeks",
    f"{CAT} mape:d",
    lambda c: returns.return_rate_mape(returns.return_rate_ma(c.features), (2001, 23, 32)),
    mape_sql(23, 32),
)
add(
    "d29b_mape_last_week",
    f"{CAT} mape:d",
    lambda c: returns.return_rate_mape(returns.return_rate_ma(c.features), (2001, 32, 32)),
    mape_sql(32, 32),
)
add(
    "d30_next_week_rate",
    f"{CAT} min_ld:i gross_sales:i wkly_rr:d ma_n_wk_rr:d pred_rr:d",
    lambda c: returns.next_week_rate(returns.return_rate_ma(c.features), (RR_WEEKS[0], RR_WEEKS[2])),
    "SELECT * FROM ma13 WHERE fiscal_year = 2001 AND fiscal_week = 32",
)
add(
    "d31_returns_shift",
    f"merchandise_key:i {YW} gross_sales_units:i net_sales_units:i returns_post_2wk:i",
    lambda c: returns.returns_shift(c.features),
    "rbase",
)
add("d32_ma_shifted_category", MA_POST, lambda c: returns.return_rate_ma(c.features, shift=2), "ma13_post")
add(
    "d33_ma_shifted_line",
    MA_POST + " line:i",
    lambda c: returns.return_rate_ma(c.features, grain="line", shift=2),
    "ma13_line",
)
add(
    "d33_ma_shifted_line_by_category",
    MA_POST + " line:i",
    lambda c: returns.return_rate_ma(c.features, grain="line", shift=2, partition="category", partitions=c.partitions),
    "ma13_line_by_category",
)
add("d34_ma_shifted_6wk", MA_POST, lambda c: returns.return_rate_ma(c.features, n=6, shift=2), "ma6_post")
MDREG = (
    f"{CAT} md_period_flag:i weeks_in_sales:i net_sales_units:i gross_sales_units:i return_units:i "
    "md_disc_weighted:d avg_price:d weighted_full_price:d"
)
add("d35_md_vs_regular", MDREG, lambda c: returns.md_vs_regular(c.features, shift=False), "overall")
add("d36_md_vs_regular_shifted", MDREG + " returns_post_2wk:i rr:d", lambda c: returns.md_vs_regular(c.features), "overall")
add(
    "d37_md_vs_regular_6_weeks",
    MDREG + " returns_post_2wk:i",
    lambda c: returns.md_vs_regular(c.features, last_first=6),
    "overall6",
)
add(
    "d38_returns_base",
    f"merchandise_key:i {YW} md_taken_flag:i pos_flag:i returns_post_2wk:i md_period_flag:i",
    lambda c: returns.returns_base(c.features),
    "rbase",
)


def _holdout(method: int, year: int, partition: str | None = None):
    def build(c: Context) -> DataFrame:
        ma = None
        if method != 1:
            grain, n = ("line" if method == 4 else "category"), (6 if method == 5 else 13)
            at = (year, returns.RATE_WEEK)
            ma = returns.return_rate_ma(c.features, grain=grain, n=n, shift=2, partition=partition, at=at)
        return returns.holdout(
            returns.returns_base(c.features), returns.md_vs_regular(c.features), ma, method, year,
            wk_cnt=HOLDOUT_WEEKS_NEEDED,
        )

    return build


for _method in (1, 2, 3, 4, 5):
    for _year in HOLDOUT_YEARS:
        _rates = {1: "reg_rr:d md_rr:d", 2: "pred_rr:d"}.get(_method, "reg_rr:d md_rr:d pred_rr:d")
        add(
            f"d{38 + _method}_holdout_method{_method}_{_year}",
            f"line:i cat_key:s gross_sales_units:i returns_post_2wk:i wk_cnt:i md_taken_flag:i {_rates} adj_rr:d "
            "pred_returns:d error:d",
            _holdout(_method, _year),
            sql.holdout(_method, _year, HOLDOUT_WEEKS_NEEDED),
        )
for _year in HOLDOUT_YEARS:
    add(
        f"d42_holdout_method4_by_category_{_year}",
        "line:i cat_key:s gross_sales_units:i returns_post_2wk:i wk_cnt:i md_taken_flag:i reg_rr:d md_rr:d pred_rr:d adj_rr:d "
        "pred_returns:d error:d",
        _holdout(4, _year, "category"),
        sql.holdout(4, _year, HOLDOUT_WEEKS_NEEDED, "ma13_line_by_category"),
    )

# ---- elasticity data sets -----------------------------------------------------------------------------------

add(
    "d44_discount_type",
    f"merchandise_key:i {YW} link_line:s stage:s md_taken_flag:i pos_flag_lead:i disc_type_flag:s cluster_number:i",
    lambda c: c.typed(),
    "typed",
)
add(
    "d45_fiscal_week_rank",
    "fiscal_year:i fiscal_week:i year_week:s overall_rank:i n_products:i",
    lambda c: rollups.fiscal_week_rank(c.cal).join(
        c.features.groupBy("fiscal_year", "fiscal_week").agg(
            F.count_distinct("merchandise_key").alias("n_products")
        ),
        ["fiscal_year", "fiscal_week"],
    ),
    """SELECT a.fiscal_year, a.fiscal_week, CAST(a.fiscal_year AS VARCHAR) || lpad(CAST(a.fiscal_week AS VARCHAR), 2, '0') AS year_week,
    a.overall_rank, b.n AS n_products
    FROM (SELECT *, RANK() OVER (ORDER BY fiscal_year, fiscal_week) AS overall_rank FROM cal) a
    JOIN (SELECT yw, COUNT(DISTINCT merchandise_key) AS n FROM sold GROUP BY 1) b ON a.period = b.yw""",
)
add(
    "d46_age_table",
    f"merchandise_key:i cat_key:s final_launch_date:i overall_rank:i week_rank:i {YW} age_weeks:i",
    lambda c: rollups.age_table(rollups.launches(c.ages()), c.cal, c.last_rank),
    "ages",
)
add("d47_inflection_fallback", "cat_key:s infl1:i infl2:i", lambda c: c.inflections(), "infl")
LEVEL = (
    f"merchandise_key:i cat_key:s {YW} age_weeks:i gross_sales_units:i regular_price:d final_price:d "
    "eop_dc_on_order_units:i inventory:i link_line:s cluster_number:i disc_type_flag:s infl1:i infl2:i cycle_type:s"
)
add("d48a_product_level", f"dept_desc:s dept_key:s cat_desc:s {LEVEL}", lambda c: c.build_product_level("a"), "plevel")
add("d48b_product_level_fitted", f"dept_desc:s cat_desc:s {LEVEL}", lambda c: c.build_product_level("b"), "plevel_b")
add("d48c_product_level_no_dept", LEVEL, lambda c: c.build_product_level("c"), "plevel")
KEYED = f"merchandise_key:i cat_key:s {YW} link_line:s cluster_number:i no_link_lines:i cluster_key:s"
add("d49a_cluster_key", KEYED, lambda c: c.keyed(19), "keyed19")
add("d49b_cluster_key_20", KEYED, lambda c: c.keyed(20), "keyed20")
add(
    "d49c_category_cluster_map",
    "cat_key:s cluster_key:s",
    lambda c: rollups.category_cluster_map(c.keyed(19)),
    "SELECT DISTINCT cat_key, cluster_key FROM keyed19",
)
add(
    "d49d_product_cluster_map",
    "merchandise_key:i cluster_key:s",
    lambda c: rollups.product_cluster_map(c.keyed(20)),
    "SELECT DISTINCT merchandise_key, cluster_key FROM keyed20",
)
ROLL = (
    f"{YW} gross_sales_units:i weighted_regular_price:d weighted_final_price:d eop_dc_on_order_units:i inventory:i "
    "age_weeks:d decline:i growth:i maturity:i md_discount:d inventory_ratio:d decline_perc:d growth_perc:d "
    "maturity_perc:d national_events:i public_holidays:i"
)
SHARES = "pos:i first_mk:i further:i pos_perc:d first_perc:d further_perc:d"
LAGS = "month_flag:i inventory_ratio_lag:d inventory_lag:i weeks_since_launch:i holiday_flag:i"
TYPE1 = f"dept_desc:s cluster_key:s {ROLL} {SHARES} none_:i regular_perc:d {LAGS}"
add("d50_rollup_type1", TYPE1, lambda c: c.build_type1(), "type1")
HIGH = TYPE1 + " high_disc_flag:i pos_disc:d first_disc:d further_disc:d holiday:i"
add("d51_high_discount", HIGH, lambda c: c.high(), "high")
add(
    "d52_category_phase",
    f"dept_desc:s cluster_key:s {YW} age_weeks:d infl1:i infl2:i phase_for_category:s",
    lambda c: rollups.category_phase(
        c.type1, rollups.category_cluster_map(c.keyed(19)), c.inflections()
    ),
    f"""SELECT *, {sql.cycle(False)} AS phase_for_category FROM (SELECT a.*, b.infl1, b.infl2 FROM type1 a
    JOIN (SELECT m.cluster_key, CAST(trunc(AVG(i.infl1)) AS BIGINT) AS infl1, CAST(trunc(AVG(i.infl2)) AS BIGINT) AS infl2
          FROM (SELECT DISTINCT cat_key, cluster_key FROM keyed19) m JOIN infl i ON m.cat_key = i.cat_key GROUP BY 1) b
      ON a.cluster_key = b.cluster_key)""",
)
add(
    "d53_rollup_type2",
    f"dept_desc:s cluster_key:s disc_type_flag:s {ROLL} {LAGS} high_discount_flag:i",
    lambda c: rollups.rollup_type2(c.keyed(20), c.holidays, c.cal),
    "type2",
)
add(
    "d54a_rollup_seasonality",
    f"dept_desc:s cat_key:s {ROLL} {SHARES} none_:i regular_perc:d {LAGS} high_discount_flag:i",
    lambda c: rollups.rollup_seasonality(c.product_level, c.holidays, c.cal),
    "seasonality",
)
INTERIM = "dept_desc, cat_key, cat_desc, cluster_number"
for _id, _variant, _by_type, _dept in (
    ("b", "b", False, True), ("c", "c", False, False), ("d", "b", True, True), ("e", "c", True, False),
):
    _group = INTERIM if _dept else "cat_key, cluster_number"
    _text = {"cluster_number": "i"}
    add(
        f"d54{_id}_rollup_interim",
        " ".join(f"{g}:{_text.get(g, 's')}" for g in _group.split(", "))
        + (" disc_type_flag:s" if _by_type else "")
        + f" {ROLL} " + ("" if _by_type else SHARES) + " discount_flag:i",
        (lambda v, t, d: lambda c: rollups.rollup_interim(c.build_product_level(v), c.holidays, t, d))(
            _variant, _by_type, _dept
        ),
        sql.interim("plevel_b" if _variant == "b" else "plevel", _group, _by_type),
    )

# ---- segmentation ---------------------------------------------------------------------------------------------

FEATURES = ("sales", "price")
add(
    "d55_segmentation_features",
    "cat_key:s link_line:s rank:i sales:i price:f checkout_rate:f age_weeks:i",
    lambda c: c.build_segmentation(),
    "seg",
)
add(
    "d56_winsorize",
    "cat_key:s link_line:s sales:f price:f",
    lambda c: segments.winsorize(
        segments.large_groups(c.segmentation, ["cat_key"], sql.SEG_ROWS), ["cat_key"], FEATURES
    ),
    "winsorized",
)
add("d57_standardise", "cat_key:s link_line:s sales:d price:d", lambda c: c.scaled, "scaled")
add(
    "d58_elbow_k1",
    "cat_key:s k:i wss:d",
    lambda c: segments.elbow(c.scaled, ks=(1,)),
    """SELECT cat_key, 1 AS k, (COUNT(*) - 1) * (COALESCE(var_samp(sales), 0) + COALESCE(var_samp(price), 0)) AS wss
    FROM scaled GROUP BY 1""",
)
add("d58_elbow", "cat_key:s k:i wss:d", lambda c: segments.elbow(c.scaled), "SELECT cat_key, k, wss FROM elbows_best")
add(
    "d59a_kmeans_four_on_three",
    "cat_key:s link_line:s cluster_number:i",
    lambda c: segments.kmeans_by_group(
        segments.prepared(c.segmentation, cols=THREE, fraction=None, min_rows=sql.SEG_ROWS), cols=THREE, k=4,
        k_single=None,
    ),
    models.kmeans_labels("fours", 3),
)
add(
    "d59b_kmeans_three",
    "cat_key:s link_line:s cluster_number:i",
    lambda c: segments.kmeans_by_group(c.scaled, k=3, k_single=None),
    models.kmeans_labels("threes", 2),
)
add(
    "d59c_kmeans_three_or_two",
    "cat_key:s link_line:s cluster_number:i",
    lambda c: segments.kmeans_by_group(c.scaled),
    models.kmeans_labels("usual", 2),
)
add(
    "d60_kmedoids",
    "cat_key:s link_line:s cluster_number:i",
    lambda c: segments.kmedoids_by_group(c.scaled),
    models.MEDOIDS,
)
add(
    "d60_silhouette",
    "cat_key:s link_line:s cluster_number:i silhouette_width:d",
    lambda c: segments.silhouette_by_group(
        c.scaled.join(c.cluster_cat_mapping, ["cat_key", "link_line"])
    ),
    "silhouette",
)
add(
    "d61_best_segmentation",
    "cat_key:s link_line:s rank:i sales:i price:f cluster_number:i silhouette_width:d type:s",
    lambda c: segments.best_segmentation(c.segmentation, min_rows=sql.SEG_ROWS),
    models.BEST,
)
add(
    "d62_cluster_sweep",
    "cat_key:s method:s k:i silhouette:d dunn:d wss:d",
    lambda c: segments.cluster_sweep(c.segmentation, ks=(2, 3, 4, 5, 6), min_rows=sql.SEG_ROWS),
    models.SWEEP,
)

# ---- elasticity -------------------------------------------------------------------------------------------------

add(
    "d63_elasticity_prep",
    f"cluster_key:s {YW} gross_sales_units:i md_discount:d log_units:d capped_units:d train:i",
    lambda c: c.prepped,
    "SELECT cluster_key, fiscal_year, fiscal_week, gross_sales_units, disc AS md_discount, log_units, capped_units, train FROM prepped",
)
FIT = "cluster_key:s n:i intercept:d slope:d slope_se:d rsq:d status:s"


def one_regressor(cook: bool):
    def build(c: Context) -> DataFrame:
        fit = elasticity.ols_by_key(c.prepped.filter("train"), "cluster_key", "log_units", ["md_discount"], cook)
        known = lambda c: F.when(~F.isnan(c), F.col(c))
        value = lambda v, col: F.max(F.when(F.col("variable") == v, known(col)))
        return fit.groupBy("cluster_key").agg(
            F.max("n").alias("n"),
            value("(Intercept)", "estimate").alias("intercept"),
            value("md_discount", "estimate").alias("slope"),
            value("md_discount", "std_error").alias("slope_se"),
            F.max(known("rsq")).alias("rsq"),
            F.max("status").alias("status"),
        )

    return build


def one_regressor_sql(fit: str) -> str:
    return f"""SELECT cluster_key, n, a AS intercept, b AS slope, sqrt(s2 / sxx) AS slope_se,
      1 - greatest(syy - COALESCE(b * sxy, 0), 0) / NULLIF(syy, 0) AS rsq,
      CASE WHEN n > terms THEN 'ok' ELSE 'no residual degrees of freedom' END AS status
    FROM {fit}"""


add("d64_ols_one_regressor", FIT, one_regressor(False), one_regressor_sql("fit1"))
add("d64_ols_one_regressor_cook", FIT, one_regressor(True), one_regressor_sql("fit2"))
add(
    "d64_ols_by_key",
    "cluster_key:s variable:s estimate:d std_error:d t:d p:d adj_rsq:d rsq:d vif:d n:i status:s",
    lambda c: elasticity.ols_by_key(
        c.prepped.filter("train"), "cluster_key", "log_units", elasticity.REGRESSORS, terms=elasticity.TERMS
    ),
)
add(
    "d65_elasticity_results",
    "cluster_key:s variable:s estimate:d std_error:d t:d p:d adj_rsq:d rsq:d vif:d insample_mape:d outsample_mape:d",
    lambda c: c.elasticity[0],
)
add(
    "d65_elasticity_coefficients",
    "cluster_key:s intercept:d md_discount:d age_weeks:d pos_disc:d first_disc:d further_disc:d holiday:d avg_sales:d "
    "positive_sales:i correlation:d",
    lambda c: c.elasticity[1],
)
add(
    "d65_sales_measures",
    "cluster_key:s avg_sales:d positive_sales:i correlation:d",
    lambda c: c.elasticity[1],
    """SELECT * FROM (SELECT cluster_key, AVG(capped_units) AS avg_sales, COUNT(CASE WHEN capped_units > 0 THEN 1 END) AS positive_sales,
    CASE WHEN var_pop(disc) > 0 AND var_pop(log_units) > 0 THEN corr(log_units, disc) END AS correlation FROM prepped GROUP BY 1)""",
)
add(
    "d66_reassign_coefficients",
    "cat_key:s cluster_key:s final_co_eff_pos:d final_co_eff_first:d final_co_eff_further:d",
    lambda c: elasticity.reassign_coefficients(c.elasticities),
    "final_coefs",
)

# ---- validation ---------------------------------------------------------------------------------------------------

VBASE = (
    f"dept_key:s cat_key:s merchandise_key:i {YW} season_flag:s gross_sales_units:i disc_type_flag:s age:i current_plc:s "
    "discount:d baseline_wsl:i prev_plc_stage:s fiscal_month:i cluster_key:s holiday:i pe:d pe_pos:d pe_first:d pe_further:d "
    "si:d holiday_factor:d cd:d base_es:d base_ma:d base_med:d age_coefficient:d final_g_coeff:d final_m_coeff:d "
    "disc_change:d pe_final:d si_final:d"
)
add("d67_validation_base", VBASE, lambda c: c.validation_base(), "vbase")
CHAIN = " ".join(f"{s}_{m}:d" for m in validate.MODELS for s in ("age", "stage", "si", "pe_sales", "final_pred", "mape"))
add(
    "d68_forecast_chain",
    f"merchandise_key:i season_flag:s {YW} change_in_wsl:i current_coeff:d prev_plc_coeff:d {CHAIN}",
    lambda c: c.forecast,
    "vfinal",
)
add(
    "d69_error_bucket",
    f"merchandise_key:i season_flag:s {YW} " + " ".join(f"mape_bucket_{m}:i" for m in validate.MODELS),
    lambda c: c.forecast,
    "vfinal",
)
ERRORS = " ".join(f"mape_{m}:d" for m in validate.MODELS)
for _id, _grain, _columns, _check in (
    (
        "a", "dept_season_totals", "dept_key:s season_flag:s " + " ".join(f"final_pred_{m}:d" for m in validate.MODELS),
        "SELECT dept_key, season_flag, SUM(final_pred_es) AS final_pred_es, SUM(final_pred_ma) AS final_pred_ma, "
        "SUM(final_pred_med) AS final_pred_med FROM vfinal GROUP BY 1, 2",
    ),
    ("b", "season_buckets", "season_flag:s baseline:s bucket:i products:i", sql.bucket_summary(True)),
    ("c", "buckets", "baseline:s bucket:i products:i", sql.bucket_summary(False)),
    ("d", "total", ERRORS, sql.error_summary("")),
    ("e", "season", f"season_flag:s {ERRORS}", sql.error_summary("season_flag")),
    ("f", "dept_season", f"dept_key:s season_flag:s {ERRORS}", sql.error_summary("dept_key, season_flag")),
    ("g", "products", "products:i", "SELECT COUNT(DISTINCT merchandise_key) AS products FROM vfinal"),
):
    add(
        f"d70{_id}_summary_{_grain}",
        _columns,
        (lambda g: lambda c: validate.validation_summary(c.forecast, g))(_grain),
        _check,
    )

# ---- checks -------------------------------------------------------------------------------------------------------

add(
    "d71_quality_checks",
    "check:s key:s value:i",
    lambda c: quality.quality_checks(
        c.features, ["product_key", "fiscal_year"], ["merchandise_key", "launch_date", "md_flag"], ["cat_key"], 400,
        ["net_sales_units"],
    ),
    """SELECT 'duplicate' AS "check", CAST(product_key AS VARCHAR) || COALESCE('|' || CAST(fiscal_year AS VARCHAR), '') AS key,
    COUNT(*) AS value FROM feat GROUP BY product_key, fiscal_year HAVING COUNT(*) > 1
    UNION ALL SELECT 'null', 'merchandise_key', COUNT(*) - COUNT(merchandise_key) FROM feat
    UNION ALL SELECT 'null', 'launch_date', COUNT(*) - COUNT(CASE WHEN merchandise_key IS NOT NULL THEN launch_date END) FROM feat
    UNION ALL SELECT 'null', 'md_flag', COUNT(*) - COUNT(md_flag) FROM feat
    UNION ALL SELECT 'coverage<400', cat_key, COUNT(*) FROM feat GROUP BY cat_key HAVING COUNT(*) < 400
    UNION ALL SELECT 'negative', 'net_sales_units', COUNT(CASE WHEN net_sales_units < 0 THEN 1 END) FROM feat""",
)
add(
    "d71_analysis_checks",
    "check:s key:s value:i",
    lambda c: quality.analysis_checks(
        returns.return_rate(c.features, RR_WEEKS), returns.return_rate_ma(c.features),
        rollups.age_table(rollups.launches(c.ages()), c.cal, c.last_rank),
    ),
    """SELECT 'weeks<16' AS "check", cat_key AS "key", COUNT(DISTINCT (fiscal_year, fiscal_week)) AS value FROM rr GROUP BY cat_key HAVING value < 16
    UNION ALL SELECT 'weeks<32', cat_key, COUNT(DISTINCT (fiscal_year, fiscal_week)) AS n FROM ma13 GROUP BY cat_key HAVING n < 32
    UNION ALL SELECT 'negative', 'age_weeks', COUNT(*) FILTER (age_weeks < 0) FROM ages""",
)
add(
    "d71_lines_per_category",
    "cat_key:s cat_desc:s lines:i",
    lambda c: quality.lines_per_category(c.features),
    "SELECT cat_key, cat_desc, COUNT(DISTINCT line) AS lines FROM feat GROUP BY 1, 2",
)
add(
    "d71_distinct_counts",
    "check:s key:s value:i",
    lambda c: quality.distinct_counts(
        c.features.withColumn("week", F.col("fiscal_year") * 100 + F.col("fiscal_week")), "cat_key", ("week", "line")
    ),
    """SELECT 'distinct' AS "check", concat_ws('|', cat_key, 'week') AS "key", COUNT(DISTINCT fiscal_year * 100 + fiscal_week) AS value
    FROM feat GROUP BY cat_key
    UNION ALL SELECT 'distinct', concat_ws('|', cat_key, 'line'), COUNT(DISTINCT line) FROM feat GROUP BY cat_key""",
)


# ---- files and tables: the category ages go out through a sink and come back through a source ----

CAT_AGE = "cat_key:s age:i sales:i inv:i"
CAT_AGE_FILE = "cat_key string, age long, sales long, inv long"


def _file(c: Context, kind: str) -> str:
    return f"{shared_dir(c.spark).rstrip('/')}/shelfweek_files/{c.spark.sparkContext.applicationId}/{kind}_{uuid.uuid4().hex[:12]}"


def _through_csv(c: Context) -> DataFrame:
    path = _file(c, "csv")
    files.write_csv(lifecycle.category_age(c.ages()), path)
    return files.read_csv(c.spark, path, CAT_AGE_FILE)


def _through_headerless_csv(c: Context) -> DataFrame:
    path = _file(c, "plain")
    lifecycle.category_age(c.ages()).write.csv(path, header=False)
    return files.read_headerless_csv(c.spark, path, CAT_AGE_FILE)


def _through_tsv(c: Context) -> DataFrame:
    path = _file(c, "tsv")
    lifecycle.category_age(c.ages()).write.csv(path, header=True, sep="\t")
    return files.read_tsv(c.spark, path, CAT_AGE_FILE)


def _through_table(c: Context) -> DataFrame:
    name = f"category_age_{uuid.uuid4().hex[:12]}"
    files.save_table(lifecycle.category_age(c.ages()), name)
    return files.read_table(c.spark, name, ("cat_key", "age", "sales", "inv"))


add("s4_csv", CAT_AGE, _through_csv, "cat_age")
add("s5_headerless_csv", CAT_AGE, _through_headerless_csv, "cat_age")
add("s6_tsv", CAT_AGE, _through_tsv, "cat_age")
add("s9_table", CAT_AGE, _through_table, "cat_age")

add(
    "o2_top_product_weeks",
    f"merchandise_key:i {YW} gross_sales_units:i",
    lambda c: quality.top_rows(
        c.features.filter("merchandise_key IS NOT NULL"),
        [F.desc("gross_sales_units"), "merchandise_key", "fiscal_year", "fiscal_week"],
        200,
    ),
    "SELECT * FROM sold ORDER BY gross_sales_units DESC, merchandise_key, fiscal_year, fiscal_week LIMIT 200",
)
