"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import itertools
import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the ASCII controls from tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"
#: Rows of one Arrow batch. Texts may be very long, so batches are small; memory follows the longest texts.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the rows of an Arrow batch few: a batch of whole texts must fit beside the executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shipped(spark: SparkSession, model) -> Broadcast:
    """Broadcast a bounded model for ``unpacked``. Its class travels with it, so executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def unpacked(held: Broadcast):
    """The model of a broadcast of ``shipped``; to be called once in a task."""
    return pickle.loads(held.value)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairwise_sorted(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs of different values."""
    return frame.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def windows(seq, n: int):
    """The runs of n neighbours of a sequence."""
    return zip(*(itertools.islice(seq, k, None) for k in range(n)))
