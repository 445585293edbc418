"""Dense product series, seasonal index and adaptive-rate smoothing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfweek.functions.numeric import dbl
from shelfweek.functions.weeks import pack_week, week_array
from shelfweek.session import few_rows_a_batch, materialise

YW = ["fiscal_year", "fiscal_week"]


def _numbered(cal: DataFrame, last: tuple[int, int]) -> Column:
    """The calendar weeks up to ``last`` as one array of (period, fiscal_year, fiscal_week)."""
    weeks = (
        cal.filter(pack_week(*YW) <= last[0] * 100 + last[1])
        .select(*YW)
        .withColumn("period", F.row_number().over(Window.orderBy(*YW)))
    )
    return week_array(weeks, "period", *YW)


def _packed_sales(f: DataFrame, *keys: str) -> DataFrame:
    """(keys, sold): units of the recorded weeks of each group as one map, bounded by the calendar."""
    sold = f.filter(F.col("merchandise_key").isNotNull())
    if "product_key" in f.columns:  # the same key where there are sales; the feature table is bucketed by it
        sold = sold.withColumn("merchandise_key", F.col("product_key"))
    weekly = sold.groupBy(*keys, pack_week(*YW).alias("yw")).agg(F.sum("gross_sales_units").alias("units"))
    return weekly.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("yw", "units"))).alias("sold"))


def _units_in(year, week) -> Column:
    return F.coalesce(F.try_element_at("sold", pack_week(year, week)), F.lit(0))


def period_sales(cal: DataFrame, f: DataFrame, last: tuple[int, int] = (2016, 32)) -> DataFrame:
    """Every product with every numbered calendar week up to ``last``; missing sales are zero."""
    # A product's recorded weeks become one map; the numbered weeks are read off it, so there is no product x week
    # join. Rows stay partitioned by product from the feature table on.
    return (
        _packed_sales(f, "merchandise_key", "cat_key")
        .withColumn("w", F.explode(_numbered(cal, last)))
        .select(
            "w.fiscal_year", "w.fiscal_week", "w.period", "merchandise_key", "cat_key",
            _units_in("w.fiscal_year", "w.fiscal_week").alias("gross_sales_units"),
        )
    )


def category_sales(cal: DataFrame, f: DataFrame, last: tuple[int, int] = (2016, 32)) -> DataFrame:
    """``category_weeks`` of ``period_sales``, from recorded weeks alone: the sums are the same."""
    return (
        _packed_sales(f, "cat_key")
        .withColumn("w", F.explode(_numbered(cal, last)))
        .select(
            "w.fiscal_year", "w.fiscal_week", "w.period", "cat_key",
            _units_in("w.fiscal_year", "w.fiscal_week").alias("sale_unit_gross"),
        )
    )


def category_weeks(series: DataFrame) -> DataFrame:
    return series.groupBy(*YW, "period", "cat_key").agg(F.sum("gross_sales_units").alias("sale_unit_gross"))


def seasonal_index(
    series: DataFrame, key: str = "cat_key", period: int = 52, weekly: DataFrame | None = None
) -> DataFrame:
    """Classical multiplicative seasonal index per category week, and de-seasonalised product units.

    Ratio to the centred moving average (half weights at both ends), mean per phase, scaled to mean 1.
    Categories shorter than two full periods get index 1 and status 'short'. A zero index becomes 1. ``weekly`` has the
    category weeks of ``series`` where they come cheaper. The index (a row a category and week) is written once, so that the
    series is read for its own rows only.
    """
    weekly = category_weeks(series) if weekly is None else weekly
    half = period // 2
    by_key = Window.partitionBy(key)
    ordered = by_key.orderBy("period")
    inner = F.sum("sale_unit_gross").over(ordered.rowsBetween(-(half - 1), half - 1))
    ends = F.lag("sale_unit_gross", half).over(ordered) + F.lead("sale_unit_gross", half).over(ordered)
    trended = weekly.withColumns(
        {
            "phase": F.pmod(F.row_number().over(ordered) - 1, F.lit(period)),
            "n_weeks": F.count(F.lit(1)).over(by_key),
            "trend": dbl(inner * 2 + ends) / (2.0 * period),
        }
    ).withColumn("detrended", F.try_divide(dbl("sale_unit_gross"), F.col("trend")))
    trended = materialise(trended, "category_weeks")
    figure = trended.groupBy(key, "phase").agg(F.avg("detrended").alias("figure"))
    # At most ``period`` rows per key.
    figure = figure.withColumn("seasonal", F.try_divide("figure", F.avg("figure").over(by_key)))
    short = F.col("n_weeks") < 2 * period
    index = (
        trended.join(figure.select(key, "phase", "seasonal"), [key, "phase"], "left")
        .withColumn(
            "product_ts",
            F.when(short | F.col("seasonal").isNull() | (F.col("seasonal") == 0), 1.0).otherwise(F.col("seasonal")),
        )
        .select(key, "period", "product_ts", F.when(short, "short").otherwise("ok").alias("season_status"))
    )
    return series.join(index, [key, "period"], "left").withColumn(
        "s_r_forecast", F.col("gross_sales_units") / F.col("product_ts")
    )


_STEPS = "struct<es_fcast:array<double>,err:array<double>,alpha:array<double>>"
#: Series of one vector step; their weeks are one matrix, so this bounds the memory of a Python worker.
SERIES_ROWS = 256


def _trigg_leach(series: pd.Series, const: float) -> pd.DataFrame:
    """Run the recurrence for a few series at once: one vector step per period, three packed arrays per series."""
    lengths = series.map(len).to_numpy()
    steps = int(lengths.max()) if len(lengths) else 0
    y = np.zeros((len(series), steps))
    for i, values in enumerate(series):
        y[i, : len(values)] = values
    fcast, err = np.zeros_like(y), np.zeros_like(y)
    alpha = np.ones_like(y)
    smooth, absolute = np.zeros(len(series)), np.zeros(len(series))
    if steps:
        err[:, 0] = y[:, 0]
    for t in range(1, steps):
        fcast[:, t] = alpha[:, t - 1] * y[:, t - 1] + (1 - alpha[:, t - 1]) * fcast[:, t - 1]
        err[:, t] = y[:, t] - fcast[:, t]
        smooth = const * err[:, t] + (1 - const) * smooth
        absolute = const * np.abs(err[:, t]) + (1 - const) * absolute
        known = absolute != 0
        alpha[known, t] = np.abs(smooth[known] / absolute[known])
    found = {"es_fcast": fcast, "err": err, "alpha": alpha}
    return pd.DataFrame({name: [row[:n] for row, n in zip(rows, lengths)] for name, rows in found.items()})


def adaptive_smoothing(
    df: DataFrame, key: str = "merchandise_key", const: float = 0.2, value: str = "s_r_forecast",
    at: Sequence[int] | None = None,
) -> DataFrame:
    """Adaptive-rate exponential smoothing per series; one extra row past the end holds the forecast.

    f1 = 0, f[t] = alpha[t-1] y[t-1] + (1 - alpha[t-1]) f[t-1]; A and M smooth the error and its size,
    alpha = |A / M| (1 where M is 0). The appended row has zero sales and the last row's week. A series
    has one value per calendar week, so an array per key is bounded; Arrow batches hold ``SERIES_ROWS`` series. ``at`` gives
    the rows of these periods only, without the appended one: series are run whole, but other rows are not opened again.
    """
    carried = [c for c in df.columns if c != key]
    tail = F.struct(
        *[
            (F.col("last.period") + 1).alias(c)
            if c == "period"
            else F.lit(0).cast(df.schema[c].dataType).alias(c)
            if c in ("gross_sales_units", "product_ts", value)
            else F.col(f"last.{c}").alias(c)
            for c in ["period", *[c for c in carried if c != "period"]]
        ]
    )

    few_rows_a_batch(df.sparkSession, SERIES_ROWS)

    @F.pandas_udf(_STEPS)
    def smooth(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), SERIES_ROWS):
                yield _trigg_leach(batch.iloc[first : first + SERIES_ROWS], const)

    @F.pandas_udf(_STEPS)
    def smooth_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), SERIES_ROWS):
                part = batch.iloc[first : first + SERIES_ROWS]
                found = _trigg_leach(part["y"], const)
                yield found.apply(lambda steps: [row[places] for row, places in zip(steps, part["places"])])

    item = F.struct("period", *[c for c in carried if c != "period"])
    opened = [key, *[F.col(f"z.rows.{c}") for c in carried], "z.es_fcast", "z.err", "z.alpha"]
    zipped = F.explode(F.arrays_zip("rows", "steps.es_fcast", "steps.err", "steps.alpha"))
    if at is not None:
        asked = F.when(F.col("period").isin([int(p) for p in at]), item)
        place = lambda r: (F.array_position("y.period", r["period"]) - 1).cast("int")
        return (
            df.groupBy(key)
            .agg(
                F.sort_array(F.collect_list(F.struct("period", F.col(value).cast("double").alias("y")))).alias("y"),
                F.sort_array(F.collect_list(asked)).alias("rows"),
            )
            .withColumn("steps", smooth_at(F.struct(F.col("y.y").alias("y"), F.transform("rows", place).alias("places"))))
            .withColumn("z", zipped)
            .select(*opened)
        )
    return (
        df.groupBy(key)
        .agg(F.sort_array(F.collect_list(item)).alias("rows"))
        .withColumn("last", F.element_at("rows", -1))
        .withColumn("rows", F.concat("rows", F.array(tail)))
        .withColumn("steps", smooth(F.transform("rows", lambda r: r[value].cast("double"))))
        .withColumn("z", zipped)
        .select(*opened)
    )


def trailing_baselines(series: DataFrame, n: int = 13, at: Sequence[int] | None = None) -> DataFrame:
    """Moving-average and median baselines per product week, from the ``n`` weeks before it.

    ``at`` gives the rows of these periods only. A product has a row in every week, so no rows but theirs and the ``n``
    before each are framed.
    """
    if at is not None:
        near = F.lit(False)
        for p in at:
            near = near | F.col("period").between(int(p) - n, int(p))
        series = series.filter(near)
    frame = Window.partitionBy("merchandise_key").orderBy("period").rowsBetween(-n, -1)
    units = F.col("gross_sales_units").cast("double")
    values = F.sort_array(F.collect_list(units).over(frame))
    size = F.size(values)
    low, high = F.floor((size + 1) / 2).cast("int"), F.floor(size / 2).cast("int") + 1
    median = F.when(size > 0, (F.get(values, low - 1) + F.get(values, high - 1)) / 2)
    asked = F.lit(True) if at is None else F.col("period").isin([int(p) for p in at])
    return series.select(
        "cat_key",
        "merchandise_key",
        *YW,
        asked.alias("asked"),
        F.try_divide(F.sum(units).over(frame), F.count(units).over(frame).cast("double")).alias("es_ma"),
        median.alias("es_med"),
    ).filter("asked").drop("asked")
