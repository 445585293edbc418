"""Shared folders and small numeric rules."""

import types

import pytest
from pyspark.sql import functions as F

from shelfweek.functions.numeric import half_up_cents, money
from shelfweek.plans.context import Context
from shelfweek.session import clear_stages, materialise, shared_dir


def test_no_local_folder_on_a_cluster():
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        shared_dir(cluster)


def test_a_context_does_not_outlive_its_stages(spark):
    before = Context.of(spark, "/root/testdata/sf0.001")
    assert Context.of(spark, "/root/testdata/sf0.001") is before
    clear_stages(spark)
    assert Context.of(spark, "/root/testdata/sf0.001") is not before


def test_halves_round_away_from_zero(spark):
    row = spark.range(1).select(
        money(F.lit(-1.125)).alias("a"), money(F.lit(1.125)).alias("b"), half_up_cents(F.lit(-5), F.lit(2)).alias("c"), half_up_cents(F.lit(5), F.lit(2)).alias("d")
    ).first()
    assert [float(v) for v in row] == [-1.13, 1.13, -0.03, 0.03]


def test_stages_are_written_with_zstd(spark):
    import glob

    import pyarrow.parquet as pq

    for bucketed in ({}, {"bucket_by": "id", "buckets": 2}):
        stage = materialise(spark.range(100).withColumn("v", F.col("id") % 7), "codec", **bucketed)
        files = [f.removeprefix("file://").removeprefix("file:") for f in stage.inputFiles()]
        assert stage.count() == 100 and files
        assert {pq.ParquetFile(g).metadata.row_group(0).column(0).compression for f in files for g in glob.glob(f)} == {"ZSTD"}


def test_stages_leave_no_shuffle_files(spark):
    import time

    store = spark._jsc.sc().env().blockManager().diskBlockManager()
    listed = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    files = lambda: {f for f in map(str, listed(store.getAllFiles())) if "/shuffle_" in f}
    held, setting = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    for bucketed in ({}, {"bucket_by": "v", "buckets": 3}):
        summed = spark.range(1000).groupBy((F.col("id") % 7).alias("v")).agg(F.sum("id").alias("s"))
        stage = materialise(summed, "shuffled", **bucketed)
        for _ in range(50):
            if not (left := files() - held):
                break
            time.sleep(0.1)
        assert not left and spark.conf.get(setting) == before
        assert stage.count() == 7
        held |= files()
