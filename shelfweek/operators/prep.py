"""Item, markdown and promotion preparation."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfweek.functions.numeric import ratio
from shelfweek.functions.weeks import calendar_ranks, week_ending

EXACT = "decimal(28,8)"


def with_period(
    df: DataFrame, cal: DataFrame, start: str, end: str, cal_col: str = "calendar_date", location: str | None = "AA"
) -> DataFrame:
    """Add week-ending dates and fiscal periods of two date columns (calendar joined in two roles).

    The calendar holds one row per week, a size bounded by time, hence the broadcast.
    """
    if location is not None:
        df = df.filter(F.col("location_key") == location)
    df = df.withColumns({"wknd_start": week_ending(start), "wknd_end": week_ending(end)})
    for role in ("start", "end"):
        week = cal.select(
            F.col(cal_col).alias(f"wknd_{role}"),
            F.col("fiscal_year").alias(f"year_{role}"),
            F.col("fiscal_week").alias(f"week_{role}"),
        )
        df = df.join(F.broadcast(week), f"wknd_{role}", "left")
    return df


def markdown_intervals(
    md: DataFrame, cal: DataFrame, as_of: str | datetime.date | None = None, location: str | None = "AA"
) -> DataFrame:
    """Close each markdown at the next one of the product, the last at ``as_of`` (today if None)."""
    if location is not None:
        md = md.filter(F.col("location_key") == location)
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    series = Window.partitionBy("merchandise_key", "location_key").orderBy("effective_date")
    md = md.withColumn("end_date", F.coalesce(F.lead("effective_date").over(series), today))
    return with_period(md, cal, "effective_date", "end_date", "eop_calendar_date", location=None)


def markdown_sequence(intervals: DataFrame) -> DataFrame:
    """Number the markdowns of a product; all but the last end one week earlier.

    ``chngd_week_end`` may be 0 when an interval ends in week 1; period comparison still orders it.
    """
    ordered = Window.partitionBy("merchandise_key").orderBy("effective_date")
    whole = Window.partitionBy("merchandise_key")
    return (
        intervals.withColumn("key_num", F.row_number().over(ordered))
        .withColumn("date_rank", F.dense_rank().over(ordered))
        .withColumn("keys", F.max("date_rank").over(whole))
        .drop("date_rank")
        .withColumn(
            "chngd_week_end",
            F.when(F.col("key_num") == F.col("keys"), F.col("week_end")).otherwise(F.col("week_end") - 1),
        )
    )


def markdown_spans(markdowns: DataFrame, cal: DataFrame) -> DataFrame:
    """Markdowns in force for a week or longer, with the calendar ranks of their first and last week.

    Rows stay partitioned by product; the master joins them by product and looks for the week between the ranks, so
    the weeks of a markdown are never written out.
    """
    ranks = calendar_ranks(cal)
    start = F.broadcast(ranks.toDF("year_start", "week_start", "start_rank"))
    end = F.broadcast(ranks.toDF("year_end", "week_end", "end_rank"))
    shortened = F.col("end_rank") - F.when(F.col("chngd_week_end") < F.col("week_end"), 1).otherwise(0)
    return (
        markdowns.join(start, ["year_start", "week_start"])
        .join(end, ["year_end", "week_end"])
        .withColumn("last_rank", shortened)
        .filter(F.col("start_rank") <= F.col("last_rank"))
        .select(
            "merchandise_key",
            "start_rank",
            "last_rank",
            "price_point",
            "key_num",
            "effective_date",
            "end_date",
        )
    )


def markdown_weeks(markdowns: DataFrame, cal: DataFrame) -> DataFrame:
    """One row per product and fiscal week in which a markdown is in force.

    Consecutive intervals make the row count about (weeks + markdowns) per product.
    """
    return (
        markdown_spans(markdowns, cal)
        .withColumn("week_rank", F.explode(F.sequence("start_rank", "last_rank")))
        .join(F.broadcast(calendar_ranks(cal)), "week_rank")
        .select(
            "merchandise_key",
            "fiscal_year",
            "fiscal_week",
            "price_point",
            "key_num",
            "effective_date",
            "end_date",
        )
    )


def promo_week_price(promo: DataFrame) -> DataFrame:
    """Day-weighted promotion price per product and fiscal week, from ``with_period`` output.

    Intervals that cross the year end have start week > end week; they match no week and stay as one
    row with a NULL week. Intervals are aggregated by their day pattern before they are exploded. Sums
    run in decimals, so a price does not depend on the order in which partitions arrive.
    """
    same_week = F.col("wknd_start") == F.col("wknd_end")
    whole = F.datediff("promo_end_date", "promo_start_date") + 1
    intervals = (
        promo.withColumns(
            {
                "days_end": F.when(same_week, whole).otherwise(F.datediff("promo_end_date", "wknd_end") + 7),
                "days_start": F.when(same_week, whole).otherwise(F.datediff("wknd_start", "promo_start_date") + 1),
            }
        )
        .groupBy("merchandise_key", "year_start", "week_end", "week_start", "days_end", "days_start")
        .agg(
            ratio(F.sum(F.col("promo_price").cast(EXACT)), F.count("promo_price")).alias("price"),
            F.max("promo_desc").alias("desc_max"),
            F.min("promo_desc").alias("desc_min"),
        )
    )
    first = F.coalesce("week_start", "week_end")
    weeks = F.when(first <= F.col("week_end"), F.sequence(first, F.col("week_end")))
    days = (
        F.when(F.col("fw") == F.col("week_start"), F.col("days_start"))
        .when(F.col("fw") == F.col("week_end"), F.col("days_end"))
        .when(F.col("fw").isNotNull(), 7)
    )
    return (
        intervals.withColumn("fw", F.explode_outer(weeks))
        .withColumn("days", days)
        .groupBy("year_start", "fw", "merchandise_key")
        .agg(
            ratio(F.sum((F.col("price") * F.col("days")).cast(EXACT)), F.sum("days")).alias("promo_price"),
            F.max("desc_max").alias("max_promo_desc"),
            F.min("desc_min").alias("min_promo_desc"),
        )
    )
