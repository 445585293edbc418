"""File and table sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column layout of the headerless smoothing extract.
SMOOTHING_INPUT = (
    "fiscal_year int, fiscal_week int, period int, merchandise_key bigint, cat_key string, gross_sales_units int"
)
# Column layout of the segmentation extract.
SEGMENTATION_INPUT = (
    "cat_key string, link_line string, rank int, sales double, price double, checkout_rate double, age_weeks double"
)
# Column layout of the tab-separated category-age extract.
CATEGORY_AGE_INPUT = "cat_key string, age int, sales double, inv double"


def read_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None, location: str | None = None):
    """Catalog table scan; the location filter is pushed into the scan."""
    df = spark.table(name)
    if location is not None:
        df = df.filter(F.col("location_key") == location)
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, location: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("location_key") == location) if location is not None else df


def read_departments(df: DataFrame, departments: Sequence[str], column: str = "dept_desc") -> DataFrame:
    """Server-side ``IN`` restriction; pushed to the source."""
    return df.filter(F.col(column).isin(list(departments)))


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Remote query scan; credentials and driver come from the caller's options."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def read_headerless_csv(spark: SparkSession, path: str, schema: str = SMOOTHING_INPUT) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=False)


def read_tsv(spark: SparkSession, path: str, schema: str = CATEGORY_AGE_INPUT) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep="\t")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def save_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table with the frame (drop-and-recreate in one step)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def save_jdbc(df: DataFrame, url: str, name: str, **options) -> None:
    df.write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", name).options(**options).save()


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def use_database(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentDatabase(name)
