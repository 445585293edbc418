"""Exact order statistics per group without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfweek.session import materialise

SPLITS = 64


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows per distinct value and group (``by``, v, c), NULL included; written once for several passes."""
    return materialise(df.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")), "value_counts")


def values_at_ranks(counts: DataFrame, by: Sequence[str], wanted: DataFrame, splits: int = SPLITS) -> DataFrame:
    """The values at given 1-based ascending ranks (NULLs left out) per group: ``by``, rank, value.

    ``counts`` comes from ``value_counts``, ``wanted`` holds (``by``, rank). Approximate percentiles cut
    the distinct values of each group into ``splits`` slices, slice totals (a bounded number of rows per
    group) locate the slice of every rank, and only inside a slice are values ordered. Slices of a hot
    group are therefore spread over tasks, and the result is exact whatever the error of the percentiles.
    """
    by = list(by)
    counts = counts.filter("v IS NOT NULL")
    cuts = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    edges = counts.groupBy(*by).agg(F.approx_percentile("v", cuts, F.lit(1000)).alias("edges"))
    slice_id = F.size(F.filter("edges", lambda e: e < F.col("v")))
    sliced = counts.join(edges, by).withColumn("slice", slice_id).drop("edges")
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        sliced.groupBy(*by, "slice")
        .agg(F.sum("c").alias("slice_n"))
        .withColumn("ahead", F.coalesce(F.sum("slice_n").over(before), F.lit(0)))
    )
    rank = F.col("rank")
    target = (
        totals.join(wanted.select(*by, rank.cast("bigint").alias("rank")).distinct(), by)
        .filter((rank > F.col("ahead")) & (rank <= F.col("ahead") + F.col("slice_n")))
        .select(*by, "slice", "rank", (rank - F.col("ahead")).alias("position"))
    )
    running = Window.partitionBy(*by, "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("upto")
    return (
        sliced.join(target.select(*by, "slice").distinct(), [*by, "slice"], "left_semi")
        .withColumn("upto", F.sum("c").over(running))
        .join(target, [*by, "slice"])
        .filter((F.col("position") <= upto) & (F.col("position") > upto - F.col("c")))
        .select(*by, "rank", F.col("v").alias("value"))
    )


def second_quartile_max(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Largest value in the second of four equal buckets per group (ntile(4) order, NULLs first).

    With n rows the second bucket ends at rank 2 * (n div 4) + min(n mod 4, 2); groups of one row have
    no second bucket and are left out. NULL rows sort first and shift the rank among known values.
    """
    by = list(by)
    counts = value_counts(df, by, value)
    size = counts.groupBy(*by).agg(
        F.sum("c").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)).alias("nulls")
    )
    end = F.call_function("div", F.col("rows"), F.lit(4)) * 2 + F.least(F.col("rows") % 4, F.lit(2))
    wanted = size.filter("rows >= 2").select(*by, (end - F.col("nulls")).alias("rank"))
    found = values_at_ranks(counts, by, wanted).select(*by, F.col("value").alias(name))
    return wanted.select(*by).join(found, by, "left")


def quantiles(df: DataFrame, by: Sequence[str], values: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles (type 7) of several columns per group, in long form.

    Returns ``by``, variable, prob, quantile. The columns are unpivoted, so that all share one pass.
    """
    keys = [*by, "variable"]
    long = (
        df.select(*by, *[F.col(v).cast("double").alias(v) for v in values])
        .unpivot(list(by), list(values), "variable", "x")
        .filter("x IS NOT NULL")
    )
    counts = value_counts(long, keys, "x")
    n = F.col("n")
    wanted = (
        counts.groupBy(*keys)
        .agg(F.sum("c").alias("n"))
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("lo", F.floor((n - 1) * F.col("prob")).cast("bigint") + 1)
        .withColumn("hi", F.least(F.col("lo") + 1, n))
    )
    ranks = wanted.select(*keys, F.explode(F.array("lo", "hi")).alias("rank"))
    at = materialise(values_at_ranks(counts, keys, ranks), "ranked_values")
    low = at.select(*keys, F.col("rank").alias("lo"), F.col("value").alias("v_lo"))
    high = at.select(*keys, F.col("rank").alias("hi"), F.col("value").alias("v_hi"))
    weight = (n - 1) * F.col("prob") - (F.col("lo") - 1)
    return (
        wanted.join(low, [*keys, "lo"])
        .join(high, [*keys, "hi"])
        .select(*keys, "prob", (F.col("v_lo") + weight * (F.col("v_hi") - F.col("v_lo"))).alias("quantile"))
    )
