"""Toxicity by class-conditional Kneser-Ney models of how words are spelt."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.llm.base import shipped, small_batches, table, unpacked

LEVELS = (6, 4, 2, 0)  # characters of context, from the class models' order down the shared backoff
DISCOUNT = 0.9
TOXIC_ROWS, ORDINARY_ROWS = 2000, 4000  # at most so many labelled rows are fitted on, the first by hash of their id
CALIBRATION_PART = 4  # every fourth of them, by hash, fits the scale of the score instead of the counts
#: A word's log-likelihood ratio counts between these for the mean; above STRONG it is an expression of the class.
FLOOR, STRONG, CEILING = -2.0, 3.0, 5.0
VERY, ENOUGH = 4.0, 0.015  # the share of words above VERY counts up to ENOUGH
THRESHOLD = 0.7
WORDS = re.compile(r"\w+")
CACHE_WORDS = 600_000
FIT_WORDS = 30_000  # words taken apart at a time


def _grams(words: list[str]):
    """Hashes of every character with its longest context, of the contexts alone, and the index of its word."""
    import numpy as np

    top = LEVELS[0]
    pad = "\x02" * top
    flat = np.frombuffer("".join(pad + w + "\x03" for w in words).encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + top + 1
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    real = np.arange(len(flat)) - begin[owner] >= top
    out = {}
    with np.errstate(over="ignore"):
        for level in LEVELS:
            context = np.full(len(flat), level + 1, dtype=np.uint64)
            for k in range(level, 0, -1):
                context = (context * np.uint64(0x9E3779B97F4A7C15)) ^ np.roll(flat, k)
                context ^= context >> np.uint64(29)
            gram = (context + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) ^ flat * np.uint64(0x94D049BB133111EB)
            out[level] = gram[real], context[real]
    return out, owner[real]


@dataclass
class Spelling:
    """Log-likelihood ratios of characters after their context, precomputed for all that either class has shown."""

    grams: object
    gram_ratio: object
    contexts: object
    context_ratio: object

    @classmethod
    def fit(cls, words: list[str], toxic, ordinary) -> "Spelling":
        """Counts of the words by class. Class models hold the longest contexts; what lies below is shared by both."""
        import numpy as np

        if not words:
            none = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.float32)
            return cls(*none, *none)
        parts, sums = [], []
        for at in range(0, len(words), FIT_WORDS):  # different grams only are kept, so memory follows those
            hashes, owner = _grams(words[at : at + FIT_WORDS])
            _, first, where = np.unique(hashes[LEVELS[0]][0], return_index=True, return_inverse=True)
            parts.append(np.array([h[first] for level in LEVELS for h in hashes[level]]))
            sums.append(np.array([np.bincount(where, weights=c[at : at + FIT_WORDS][owner], minlength=len(first)) for c in (toxic, ordinary)]))
        parts, sums = np.concatenate(parts, axis=1), np.concatenate(sums, axis=1)
        grams, first, where = np.unique(parts[0], return_index=True, return_inverse=True)
        counts = [np.bincount(where, weights=c, minlength=len(grams)) for c in sums]
        parts = parts[:, first]
        context_of = parts[1]
        # shared backoff: how many different longer grams end in this one
        chain, keep = [], np.arange(len(grams))
        for k in range(1, len(LEVELS)):
            gram, context = parts[2 * k][keep], parts[2 * k + 1][keep]
            _, at, inverse, n = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
            own, cinv = np.unique(context[at], return_inverse=True)
            total = np.bincount(cinv, weights=n, minlength=len(own))
            kinds = np.bincount(cinv, minlength=len(own))
            chain.append((inverse, n, total[cinv], kinds[cinv]))
            keep = keep[at]
        shared = np.full(len(keep), 1e-4)
        for inverse, n, total, kinds in reversed(chain):
            shared = ((np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * shared) / total)[inverse]  # for the grams one level up
        contexts, cinv = np.unique(context_of, return_inverse=True)
        ratio, back = np.zeros(len(grams)), np.zeros(len(contexts))
        for sign, n in zip((1, -1), counts):
            total = np.bincount(cinv, weights=n, minlength=len(contexts))
            kinds = np.bincount(cinv, weights=n > 0, minlength=len(contexts))
            left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1e-9), 1.0)
            seen = np.maximum(n - DISCOUNT, 0) / np.maximum(total[cinv], 1e-9)
            ratio += sign * np.log(seen + left[cinv] * shared)
            back += sign * np.log(left)
        return cls(grams, ratio.astype(np.float32), contexts, back.astype(np.float32))

    def of(self, words: list[str]):
        """Ratio of each word: the sum over its characters and its end."""
        import numpy as np

        if not words or not len(self.grams):
            return np.zeros(len(words))
        hashes, owner = _grams(words)
        gram, context = hashes[LEVELS[0]]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        value = np.where(known, self.gram_ratio[at], 0.0)
        rest = ~known
        at = np.minimum(np.searchsorted(self.contexts, context[rest]), len(self.contexts) - 1)
        value[rest] = np.where(self.contexts[at] == context[rest], self.context_ratio[at], 0.0)
        return np.bincount(owner, weights=value, minlength=len(words))


class Scorer:
    """Per text, by its number of words: the mean ratio, the share of very strong words, the excess of strong ones."""

    def __init__(self, spelling: Spelling):
        self.spelling, self.known = spelling, {}

    def features(self, texts):
        import numpy as np

        words = [WORDS.findall((t or "").lower()) for t in texts]
        new = list(set().union(*words).difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {}
            new = list(set().union(*words))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.known.update(zip(part, self.spelling.of(part).tolist()))
        get, out = self.known.__getitem__, np.zeros((len(words), 3))
        for i, w in enumerate(words):
            if w:
                r = np.fromiter(map(get, w), dtype=np.float64, count=len(w))
                out[i] = np.clip(r, FLOOR, CEILING).mean(), min((r > VERY).mean(), ENOUGH), np.clip(r - STRONG, 0, CEILING - STRONG).mean()
        return out


def fit_logistic(x, y, ridge: float = 0.003, turns: int = 60):
    """(centre, spread, weights with the intercept last) of a ridge logistic regression by Newton steps."""
    import numpy as np

    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.append(np.zeros(x.shape[1]), np.log(rate / (1 - rate)))
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    w, keep = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z / len(z) + np.diag(keep), z.T @ (p - y) / len(z) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return centre, spread, w


@dataclass
class ToxicModel:
    spelling: Spelling
    scale: tuple

    def scores(self, scorer: Scorer, texts):
        import numpy as np

        centre, spread, w = self.scale
        z = (scorer.features(texts) - centre) / spread
        return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> ToxicModel:
    """Fit on a bounded sample of the labelled rows: ``labels`` has doc_id and toxic (0 or 1; null rows are left out).

    The sampled ids are bounded by the two parameters and broadcast; words are counted where the texts lie, and only
    the counts of distinct words come together. No labels, or one class only, give a constant score.
    """
    import numpy as np

    small_batches(docs.sparkSession)
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picks = [known.filter(f"toxic = {v}").orderBy(order, "doc_id").limit(n) for v, n in ((1, toxic_rows), (0, ordinary_rows))]
    sample = picks[0].unionByName(picks[1]).withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CALIBRATION_PART)) == 0)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        for batch in batches:
            for toxic, part in batch.groupby("toxic"):
                found = Counter()
                for t in part["text"]:
                    found.update(WORDS.findall((t or "").lower()))
                yield pd.DataFrame({"word": list(found), "toxic": int(toxic), "n": list(found.values())})

    counts = (
        rows.filter("NOT aside").mapInPandas(count, "word string, toxic int, n long")
        .groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("o"))
        .toPandas().sort_values("word")
    )
    spelling = Spelling.fit(counts["word"].tolist(), counts["t"].to_numpy(dtype=float), counts["o"].to_numpy(dtype=float))
    held = shipped(docs.sparkSession, spelling)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(unpacked(held))
        for batch in batches:
            x = scorer.features(batch["text"])
            yield pd.DataFrame({"toxic": batch["toxic"], "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})

    seen = rows.filter("aside").mapInPandas(measure, "toxic int, a double, b double, c double").toPandas().sort_values(["a", "b", "c", "toxic"])
    return ToxicModel(spelling, fit_logistic(seen[["a", "b", "c"]].to_numpy(dtype=float).reshape(-1, 3), seen["toxic"].to_numpy(dtype=float)))


def with_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``, a score from 0 to 1, of every whole text; one pass, no shuffle.

    A text without words (null, empty) has its features at zero and so gets the score of an unremarkable text. The
    model is bounded by its sample and broadcast. Rows are scored one by one: repeats and ties get equal scores; other
    columns stay, a column called ``toxicity`` is replaced; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    held = shipped(docs.sparkSession, model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = unpacked(held)
        scorer = Scorer(model.spelling)
        for batch in batches:
            yield pd.Series(model.scores(scorer, batch), dtype="float64")

    return docs.withColumn("toxicity", run(F.col(text)))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = with_toxicity(docs, fit(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )
