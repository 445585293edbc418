"""Importance resampling of documents towards a target text by hashed features of one to three words.

A feature's bucket is the CRC-32 of its bytes, and CRC-32 is linear: the CRC of a run of words follows from the CRC of the
run before it, its own, and the number of bytes between. So a word's CRC is all that is needed of it. Words and
neighbouring pairs that hold a fixed share of the corpus are looked up in broadcast tables, whose size that share bounds;
every other word takes its CRC from its bytes. The tables save work only: buckets are the same without them.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.llm.base import small_batches, table
from shelfweek.llm.words import byte_table, encode, split_column
from shelfweek.session import materialise

BUCKETS = 10_000
SEED = 42
MIN_WORDS = 20
HEAD_WORDS = 1 << 17  # a word is frequent from this fraction of all words on, so there are at most as many
PAIR_WORDS = 1 << 10  # the most frequent of them, whose pairs are counted
HEAD_PAIRS = 1 << 18  # a pair is frequent from this fraction of all words on
SLICE_WORDS = 1 << 21  # words that a task counts together
LONGEST = 255  # bytes of a word that the shift tables serve; longer words continue a CRC byte by byte
#: What separates words becomes a space and A-Z lower case; bytes of other than ASCII characters are word bytes.
WORD_BYTES = byte_table(b"abcdefghijklmnopqrstuvwxyz0123456789")


def shift_tables(longest: int = LONGEST) -> np.ndarray:
    """``out[n, k, b]``: what byte k of a CRC, valued b, becomes when n more zero bytes pass; the parts are XORed."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    out = np.empty((longest + 1, 4, 256), dtype=np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, longest + 1):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out


class Buckets:
    """Buckets of all runs of one to three words, from the frequent words' CRCs and the frequent pairs' buckets."""

    def __init__(self, words: list[bytes], crcs: np.ndarray, pairs: np.ndarray, pair_crcs: np.ndarray):
        self.place = {w: i for i, w in enumerate(words)}
        self.crcs = np.append(crcs, np.uint32(0))
        self.sizes = np.array([len(w) for w in words] + [0], dtype=np.int64)
        self.pair_at = np.full((PAIR_WORDS + 1, PAIR_WORDS + 1), -1, dtype=np.int32)
        self.pair_at[pairs // PAIR_WORDS, pairs % PAIR_WORDS] = np.arange(len(pairs))
        self.pair_crcs = np.append(pair_crcs, np.uint32(0))  # the last stands for every other pair
        self.pair_buckets = self.pair_crcs % BUCKETS
        self.shift = shift_tables().ravel()
        self.space = np.uint32(zlib.crc32(b" "))

    def _after(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        at, out = size * 1024, self.shift
        return (
            out[at + (crc & 255)] ^ out[at + 256 + (crc >> 8 & 255)] ^ out[at + 512 + (crc >> 16 & 255)]
            ^ out[at + 768 + (crc >> 24)]
        )

    def _extended(self, crc: np.ndarray, crcs: np.ndarray, sizes: np.ndarray, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        """CRC of each run in ``crc``, a space, and the word of the same place."""
        spaced = self._after(crc, np.ones(len(crc), dtype=np.int64)) ^ self.space
        out = self._after(spaced, np.minimum(sizes, LONGEST)) ^ crcs
        for i in np.flatnonzero(sizes > LONGEST).tolist():
            out[i] = zlib.crc32(words[ids[i]], int(spaced[i]))
        return out

    def of(self, words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the runs of one, two and three words, each by the place of its first word.

        ``words`` are the different words as an Arrow array, ``ids`` the text's words as numbers among them.
        """
        words = words.cast("binary").to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter((self.place.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        crcs, sizes = self.crcs[place], self.sizes[place]
        for i in np.flatnonzero(place < 0).tolist():
            crcs[i], sizes[i] = zlib.crc32(words[i]), len(words[i])
        near = np.where((place < 0) | (place >= PAIR_WORDS), PAIR_WORDS, place)[ids]
        crcs, sizes = crcs[ids], sizes[ids]
        known = self.pair_at[near[:-1], near[1:]]
        rest = np.flatnonzero(known < 0)
        twos, buckets = self.pair_crcs[known], self.pair_buckets[known]
        twos[rest] = self._extended(crcs[rest], crcs[rest + 1], sizes[rest + 1], words, ids[rest + 1])
        buckets[rest] = twos[rest] % BUCKETS
        threes = self._extended(twos[:-1], crcs[2:], sizes[2:], words, ids[2:])
        return crcs % BUCKETS, buckets, threes % BUCKETS


def _inside(sizes: np.ndarray, run: int) -> np.ndarray:
    """Which places start a run of so many words that does not leave its text."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    return text[: max(len(text) - run + 1, 0)] == text[run - 1 :]


def head(docs: DataFrame, text: str = "text") -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Frequent words with their CRCs, and frequent pairs (first place x ``PAIR_WORDS`` + second) with theirs.

    A word or pair that holds a share of all words holds it in some slice of the corpus, so tasks hand on those that
    do in their slice; of these the ones whose counted places reach the share are kept. The share bounds both tables.
    """
    def count_words(batches):
        import pyarrow as pa

        held: list = []

        def emit():
            words, ids, sizes = encode([w for w, _ in held], np.concatenate([n for _, n in held]))
            n = np.bincount(ids, minlength=len(words))
            kept = np.flatnonzero((n > 0) & (n * HEAD_WORDS >= len(ids)))
            held.clear()
            yield pa.RecordBatch.from_pydict({"word": [""], "n": [len(ids)]})
            yield pa.RecordBatch.from_arrays([words.take(pa.array(kept)), pa.array(n[kept])], ["word", "n"])

        for batch in batches:
            held.append(split_column(batch.column("text"), WORD_BYTES))
            if sum(len(w) for w, _ in held) > SLICE_WORDS:
                yield from emit()
        if held:
            yield from emit()

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = materialise(rows.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word_counts")
    total = counted.filter("word = ''").agg(F.sum("n")).first()[0] or 0
    frequent = counted.filter((F.col("word") != "") & (F.col("n") * HEAD_WORDS >= total)).toPandas()
    frequent = frequent.sort_values(["n", "word"], ascending=[False, True])
    words = [w.encode() for w in frequent["word"]]
    near = docs.sparkSession.sparkContext.broadcast(words[:PAIR_WORDS])

    def count_pairs(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        first = pa.array(near.value, pa.binary()).cast(pa.string())
        seen, n = np.zeros(PAIR_WORDS * PAIR_WORDS, dtype=np.int64), 0
        for batch in batches:
            words, sizes = split_column(batch.column("text"), WORD_BYTES)
            words, ids, sizes = encode([words], sizes)
            if len(ids) < 2:
                n += len(ids)
                continue
            at = pc.index_in(words, first).fill_null(-1).to_numpy().astype(np.int64)[ids]
            both = _inside(sizes, 2) & (at[:-1] >= 0) & (at[1:] >= 0)
            pairs, times = np.unique(at[:-1][both] * PAIR_WORDS + at[1:][both], return_counts=True)
            seen[pairs] += times
            n += len(ids)
        kept = np.flatnonzero(seen * HEAD_PAIRS >= max(n, 1))
        yield pa.RecordBatch.from_pydict({"pair": kept, "n": seen[kept]})

    pairs = rows.mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = np.array(sorted(r[0] for r in pairs.filter(F.col("n") * HEAD_PAIRS >= total).select("pair").toLocalIterator()), dtype=np.int64)
    crcs = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
    joined = [zlib.crc32(words[p // PAIR_WORDS] + b" " + words[p % PAIR_WORDS]) for p in pairs.tolist()]
    return words, crcs, pairs, np.array(joined, dtype=np.uint32)


def bucket_totals(docs: DataFrame, known, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        import pyarrow as pa

        buckets, seen = Buckets(*known.value), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            words, sizes = split_column(batch.column("text"), WORD_BYTES)
            words, ids, sizes = encode([words], sizes)
            if len(ids):
                for run, found in enumerate(buckets.of(words, ids), 1):
                    seen += np.bincount(found[_inside(sizes, run)], minlength=BUCKETS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": seen[at]})

    counted = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).toLocalIterator():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of smoothed shares, target to source, in whole thousandths."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())],
        dtype=np.int64,
    )


def weights(docs: DataFrame, known, gain: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    worth = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        import pyarrow as pa

        buckets, gain = Buckets(*known.value), worth.value
        for batch in batches:
            words, sizes = split_column(batch.column("text"), WORD_BYTES)
            words, ids, sizes = encode([words], sizes)
            stops = np.cumsum(sizes)
            value = np.zeros(len(ids) + 1, dtype=np.int64)
            if len(ids):
                for run, found in enumerate(buckets.of(words, ids), 1):
                    inside = _inside(sizes, run)
                    value[1 : len(inside) + 1] += np.where(inside, gain[found], 0)
            value = np.cumsum(value)
            features = sizes + np.maximum(sizes - 1, 0) + np.maximum(sizes - 2, 0)
            columns = [pa.array(a) for a in (sizes, features, value[stops] - value[stops - sizes])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = MIN_WORDS, text: str = "text",
    key: str = "doc_id", target_text: str = "text",
) -> DataFrame:
    """Every document with its weight towards ``target``, its score, and its rank if it is drawn.

    Scores add Gumbel noise, hashed from the id, to the weights; the highest scores of ``percent`` % of the documents with
    ``min_words`` words or more are drawn, ties to the smaller id. Ranks come from a range partitioning that is
    written once and from the sizes of its parts, so no task orders more than its own part.

    A null or empty text has no words, no features and weight 0. A null id is hashed as an empty one and ranks behind
    others of its score; repeated ids are rows of their own, equal scores among them ordered by features and weight. An
    empty target makes all its counts zero; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(head(docs, text))
    gain = gains(bucket_totals(docs, known, text), bucket_totals(target, known, target_text))
    weighed = materialise(weights(docs, known, gain, text, key), "importance_weights")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    scored = weighed.withColumn(
        "score", F.col("weight") + F.floor(-1000 * F.log(-F.log((noise.cast("double") + 0.5) / 4294967296.0)))
    ).withColumn("open", F.col("n_words") >= min_words)
    order = [F.desc("open"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = materialise(
        scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()),
        "importance_order",
    )
    part = F.shiftright("place", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*"), F.count_if("open")).collect())  # one row a part
    drawn = sum(n for _, _, n in sizes) * percent // 100
    before = np.cumsum([0] + [n for _, n, _ in sizes]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _, _), b in zip(sizes, before)], "part int, before long")
    rank = F.col("before") + (F.col("place") - F.shiftleft(F.col("part").cast("long"), 33)) + 1
    return (
        placed.withColumn("part", part.cast("int")).join(F.broadcast(starts), "part")
        .select("doc_id", "n_features", "weight", "score", F.when(F.col("open") & (rank <= drawn), rank).alias("rank"))
    )


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
