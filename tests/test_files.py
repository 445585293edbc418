"""Sources and sinks."""

import pytest

from shelfweek.session import materialise
from shelfweek.sources import files


def test_csv_tsv_and_headerless(spark, tmp_path):
    df = spark.createDataFrame([("c1", 0, 5.0, 7.0), ("c1", 1, 2.0, None)], files.CATEGORY_AGE_INPUT)
    path = str(tmp_path / "csv")
    files.write_csv(df, path)
    assert sorted(map(tuple, files.read_csv(spark, path, files.CATEGORY_AGE_INPUT).collect())) == [
        ("c1", 0, 5.0, 7.0), ("c1", 1, 2.0, None),
    ]
    (tmp_path / "t.tsv").write_text("cat_key\tage\tsales\tinv\nc2\t3\t1.5\t2\n")
    assert tuple(files.read_tsv(spark, str(tmp_path / "t.tsv")).first()) == ("c2", 3, 1.5, 2.0)
    (tmp_path / "plain.csv").write_text("2014,1,1,10,c1,4\n")
    assert files.read_headerless_csv(spark, str(tmp_path / "plain.csv")).first().gross_sales_units == 4


def test_tables(spark, tmp_path):
    files.use_database(spark, "default")
    df = spark.createDataFrame([(1, "AA", "x"), (2, "BB", "y")], "merchandise_key int, location_key string, dept_desc string")
    name = "shelfweek_table_test"
    files.drop_table(spark, name)
    try:
        files.save_table(df, name)
        files.save_table(df, name)
        assert files.read_table(spark, name, ["merchandise_key"], "AA").collect()[0][0] == 1
        assert files.read_departments(spark.table(name), ["y"]).count() == 1
    finally:
        files.drop_table(spark, name)


def test_bucketed_stage_windows_without_shuffle(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(1000).withColumn("product_key", F.col("id") % 50)
    stage = materialise(df, "bucket_test", bucket_by="product_key")
    counted = stage.withColumn("n", F.count("*").over(Window.partitionBy("product_key")))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert counted.filter("n <> 20").count() == 0


def test_parquet_location_filter_is_pushed(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "AA"), (2, "BB")], "k int, location_key string").write.parquet(path)
    df = files.read_parquet(spark, path, "AA")
    assert df.count() == 1
    assert "PushedFilters: [IsNotNull(location_key), EqualTo(location_key,AA)]" in df._jdf.queryExecution().toString()


def test_unknown_summary_grain(spark):
    from shelfweek.operators.validate import validation_summary

    with pytest.raises(ValueError):
        validation_summary(spark.range(1), "nope")


def test_worker_functions_travel_by_value(tmp_path):
    """A Python worker without this package on its path can load the functions it is sent."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from shelfweek.functions.linear import two_sided_p

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(two_sided_p))
    code = "import pickle; from pyspark import cloudpickle; print(pickle.load(open('f.pkl', 'rb'))(0.0, 3))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "1.0", out.stderr
