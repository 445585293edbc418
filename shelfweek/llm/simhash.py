"""SimHash fingerprints and near duplicates through a grid of per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.llm.base import small_batches, table
from shelfweek.llm.components import components
from shelfweek.session import materialise

SEED = 42
SEGMENTS = 16  # of four bits each: one hexadecimal digit of the packed bit counts


def shingle_hashes(text: str | None, words: int):
    """XXH64 of every shingle of a text, in order, repeats included; fewer words give one shingle, none none."""
    import numpy as np
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    whole = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype=np.uint64)
    starts = [0, *(ends[: len(tokens) - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())], dtype=np.uint64)


def fingerprint(hashes) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    import numpy as np

    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, words: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fp``: the fingerprint of the text as a long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(shingle_hashes(t, words)) for t in batch], dtype="int64")

    return docs.withColumn("fp", of(F.col(text)))


def bit_counts(fp: Column) -> Column:
    """The embedding: set bits of each of the 16 segments, packed as one hexadecimal digit each.

    The Manhattan distance of two embeddings is at most the number of differing bits.
    """
    odd = F.lit(0x5555555555555555)
    pairs = F.lit(0x3333333333333333)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    two = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    return two.bitwiseAND(pairs) + F.shiftrightunsigned(two, 2).bitwiseAND(pairs)


def _digit(packed: Column, segment: int) -> Column:
    return F.shiftrightunsigned(packed, 4 * segment).bitwiseAND(F.lit(15))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) that connect exactly those at two or fewer differing bits.

    Range join: a fingerprint is put into the cells of the grid within Manhattan distance 1 of its embedding.
    Fingerprints within distance 2 share a cell, so cells with one member hold no link and go. In the cells that
    are left the check is exact and needs no pairs: a fingerprint emits the bit patterns at Hamming distance 1
    or less whose embedding is that cell (four at most). Two fingerprints meet in a pattern exactly if they
    differ in two bits or fewer, and all that meet are tied to the smallest. A group of any size costs at most
    65 rows for each member; the result has the same components as all pairs would have.
    """
    fp = F.col("fp")
    spots = [F.struct(F.col("grid").alias("cell"), F.lit(-1).alias("segment"), F.lit(0).alias("step"))]
    for k in range(SEGMENTS):
        for step in (1, -1):
            inside = _digit(F.col("grid"), k) != F.lit(4 if step > 0 else 0)
            spots.append(
                F.when(inside, F.struct((F.col("grid") + F.lit(step << 4 * k)).alias("cell"), F.lit(k).alias("segment"), F.lit(step).alias("step")))
            )
    rows = (
        prints.select("fp").withColumn("grid", bit_counts(fp))
        .select("fp", F.explode(F.array_compact(F.array(*spots))).alias("s"))
        .select("fp", "s.cell", "s.segment", "s.step")
    )
    crowded = rows.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell")
    near = rows.join(crowded, "cell", "left_semi")
    flips = F.transform(
        F.filter(
            F.array(*(F.lit(b) for b in range(4))),
            lambda b: F.get(_bits(), b) == F.when(F.col("step") > 0, F.lit(0)).otherwise(F.lit(1)),
        ),
        lambda b: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("segment") * 4 + b)),
    )
    patterns = near.select("fp", F.explode(F.when(F.col("segment") < 0, F.array(fp)).otherwise(flips)).alias("pattern"))
    roots = patterns.groupBy("pattern").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z")
    return patterns.join(roots, "pattern").filter("fp != a").select(F.col("a"), F.col("fp").alias("b")).distinct()


def _bits() -> Column:
    """The four bits of the column ``segment`` of ``fp``, lowest first."""
    return F.array(*(F.expr(f"cast(shiftrightunsigned(fp, segment * 4 + {b}) & 1 as int)") for b in range(4)))


def named_fingerprints(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``prints`` (doc_id, fp).

    ``root`` names the component by its smallest fingerprint, component_id by its smallest known doc_id.
    """
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = components(fingerprint_links(classes), "a", "b")
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lows, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, words: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    Fingerprints with two or fewer differing bits are linked; component_id is the smallest doc_id that can be
    reached, the document's own included. Null and empty texts and texts without words have fingerprint zero and
    are linked like any other. Repeated rows keep their repeats; a null doc_id gets the smallest known id of its
    component (null if there is none). An empty table gives no rows. Other columns are neither read nor returned.
    """
    prints = materialise(with_fingerprints(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), words, "text").select("doc_id", "fp"), "prints")
    return prints.join(named_fingerprints(prints), "fp").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of each component of ``docs`` (columns doc_id, text and any others): the one of the smallest doc_id.

    Components are those of ``simhash_components``: texts whose fingerprints of ``words``-word shingles are linked by
    two or fewer differing bits; texts without words are one component. Rows are judged, not ids: a null doc_id comes
    after every known one, and of several rows of the smallest doc_id in one component the smallest by all its columns
    stays, so the choice is the same after a lost executor. Columns must be orderable. An empty table gives no rows.
    """
    rows = with_fingerprints(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), words).select("doc_id", "fp", "row")
    rows = materialise(rows, "prints")
    first = rows.select("doc_id", "fp").join(named_fingerprints(rows.select("doc_id", "fp")), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = materialise(first.groupBy("doc_id", "fp", "root").agg(F.count("*").alias("n")), "first")
    tied = first.groupBy("root").agg(F.sum("n").alias("n")).filter("n > 1").select("root")
    mine = rows.alias("r").join(first.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.fp") == F.col("f.fp"))).select("row", "root")
    if tied.isEmpty():
        return mine.select("row.*")
    alone = mine.join(tied, "root", "left_anti").select("row")
    several = mine.join(tied, "root", "left_semi").groupBy("root").agg(F.min("row").alias("row")).select("row")
    return alone.unionByName(several).select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
