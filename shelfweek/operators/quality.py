"""Data checks: duplicates, missing keys, coverage, negative ages, distinct counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _report(df: DataFrame, check: str, key, value) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), key.cast("string").alias("key"), value.cast("bigint").alias("value")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    return _report(groups, "duplicate", F.concat_ws("|", *keys), F.col("rows"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a missing value, per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot([], list(columns), "column", "rows")
    return _report(long, "null", F.col("column"), F.col("rows"))


def coverage(df: DataFrame, by: Sequence[str], min_rows: int) -> DataFrame:
    """Groups with fewer than ``min_rows`` rows."""
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") < min_rows)
    return _report(groups, f"coverage<{min_rows}", F.concat_ws("|", *by), F.col("rows"))


def week_coverage(df: DataFrame, by: Sequence[str], min_weeks: int) -> DataFrame:
    """Groups with fewer than ``min_weeks`` different weeks, however many rows a week has; a missing week counts for none."""
    week = F.struct("fiscal_year", "fiscal_week")
    known = F.when(F.col("fiscal_year").isNotNull() & F.col("fiscal_week").isNotNull(), week)
    groups = df.groupBy(*by).agg(F.count_distinct(known).alias("weeks")).filter(F.col("weeks") < min_weeks)
    return _report(groups, f"weeks<{min_weeks}", F.concat_ws("|", *by), F.col("weeks"))


def negative_values(df: DataFrame, column: str) -> DataFrame:
    return _report(
        df.agg(F.count_if(F.col(column) < 0).alias("rows")), "negative", F.lit(column), F.col("rows")
    )


def analysis_checks(rates: DataFrame, trailing: DataFrame, ages: DataFrame) -> DataFrame:
    """Categories with under 16 weeks of rates or 32 weeks of trailing rates, and the number of ages below zero."""
    return (
        week_coverage(rates, ["cat_key"], 16)
        .unionByName(week_coverage(trailing, ["cat_key"], 32))
        .unionByName(negative_values(ages, "age_weeks"))
    )


def distinct_counts(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column per group (counts as long rows)."""
    counts = df.groupBy(by).agg(*[F.count_distinct(c).alias(c) for c in columns])
    long = counts.unpivot([by], list(columns), "column", "n")
    return _report(long, "distinct", F.concat_ws("|", by, "column"), F.col("n"))


def top_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """First ``n`` rows in a total order, for looking at data; Spark keeps n rows per task."""
    return df.orderBy(*order).limit(n)


def lines_per_category(df: DataFrame) -> DataFrame:
    """Number of lines in each category."""
    return df.groupBy("cat_key", "cat_desc").agg(F.count_distinct("line").alias("lines"))


def quality_checks(
    df: DataFrame,
    keys: Sequence[str],
    required: Sequence[str] = (),
    by: Sequence[str] = (),
    min_rows: int = 16,
    non_negative: Sequence[str] = (),
) -> DataFrame:
    """All requested checks in one (check, key, value) table."""
    parts = [duplicate_keys(df, keys)]
    if required:
        parts.append(null_counts(df, required))
    if by:
        parts.append(coverage(df, by, min_rows))
    parts += [negative_values(df, c) for c in non_negative]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
