"""Time the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR and print one JSON line.

The shared feature table is timed on its own (``features``); the other queries read it, as they would
on a cluster. Results go to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "d06_promo_week_price", "d07_weekly_master", "d11a_eda_overall", "d11b_eda_department", "d15_line_life_cycle",
    "d16_category_life_cycle", "d18b_sell_through_merchandise", "d20_dense_cst", "d22_logistic_growth",
    "d24_seasonal_index", "d25_adaptive_smoothing", "d28a_return_rate_ma", "d33_ma_shifted_line",
    "d36_md_vs_regular_shifted", "d37_md_vs_regular_6_weeks", "d41_holdout_method3_2000", "d46_age_table",
    "d48a_product_level", "d50_rollup_type1", "d51_high_discount", "d53_rollup_type2", "d55_segmentation_features",
    "d59c_kmeans_three_or_two", "d60_kmedoids", "d60_silhouette", "d64_ols_by_key", "d66_reassign_coefficients",
    "d68_forecast_chain", "d70f_summary_dept_season",
)


def main(names: list[str]) -> None:
    from shelfweek.plans.context import Context
    from shelfweek.plans.queries import QUERIES
    from shelfweek.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        f"local[{cpus}]", "shelfweek-bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"), spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def timed(name: str, job) -> None:
        started = time.perf_counter()
        job()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)

    timed("features", lambda: Context.of(spark, sf_dir).features)
    for name in names:
        timed(name, lambda: QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or list(HEADLINE))
