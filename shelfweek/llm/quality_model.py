"""Quality classifier from weak labels: labellers are weighed by expectation-maximisation, a linear scorer learns from them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.llm.base import shipped, small_batches, table, unpacked

#: Frequent function words of the languages at hand.
STOPWORDS = frozenset(
    "the of and to in is that for it with as was on are by this be or an from at not "
    "der die das und ist nicht mit von zu den im ein eine auf für dem des "
    "le la les et des en un une du que est pour dans qui sur pas par avec au "
    "el los de y que una por con para las se al lo del no".split()
)
LABELLERS = ("symbols", "shouting", "navigation", "repetition", "stopwords", "sentences", "lines")
GOOD, BAD, SILENT = 1, 0, 2
EM_TURNS, EM_STEP = 500, 1e-10
BAD_ONLY = frozenset(("symbols", "shouting", "navigation", "repetition"))
#: First guess of the chances of the votes bad, good and silent, for a bad and for a good text.
START = {True: ((0.25, 1e-9, 0.75), (0.005, 1e-9, 0.995)), False: ((0.4, 0.3, 0.3), (0.02, 0.7, 0.28))}
START_SHARE, PRIOR = 0.85, 0.1
FIT_ROWS = 6000  # documents that the scorer is fitted on at most, the first by hash of their id
SHARDS = 8  # tasks that fit on parts of them; their weights are averaged
BITS = 16
CACHE_WORDS = 400_000  # words whose features a task remembers
PASSES, RATE, RIDGE = 6, 0.5, 1e-5
THRESHOLD = 0.5


def votes(text: str | None) -> list[int]:
    """One vote of each labeller: good, bad, or silent where it cannot tell. The first four know bad texts only."""
    text = text or ""
    words = text.split()
    n = len(words)
    if n < 5:
        return [SILENT] * len(LABELLERS)
    marks = sum(map(text.count, "#*$%&<>"))
    upper = sum(map(str.isupper, words))
    bars = sum(map(text.count, "|»›•"))
    windows = set(zip(words, words[1:], words[2:]))
    fresh = len(windows) / (n - 2)
    stops = sum(w.rstrip(".,") in STOPWORDS for w in words) / n
    ends = len(re.findall(r"[.!?](?=\s|$)", text))
    lines = [x for x in text.split("\n") if x.strip()]
    once = len(set(lines)) / max(len(lines), 1)
    vote = lambda bad, good: BAD if bad else GOOD if good else SILENT
    return [
        vote(marks > 0.15 * n, False),
        vote(upper > 0.4 * n or text.count("!!") > 0.1 * n, False),
        vote(bars > 0.15 * n, False),
        vote(fresh < 0.6, False),
        vote(stops < 0.04, stops > 0.12),
        vote(ends < n / 80 or ends > n / 2, n / 40 < ends < n / 3),
        vote(once < 0.7, once > 0.98 and len(lines) > 2),
    ]


def expectation_maximisation(patterns: list[tuple[list[int], int]]) -> tuple[float, list]:
    """(share of good texts, chance of each vote given a bad and a good text by labeller) from counted vote patterns.

    Labellers count as independent given the class. Their accuracies start at ``START``, which also weighs as much as
    ``PRIOR`` of the texts: labellers overlap little, so without it one kind of bad text would take a class for itself.
    No patterns give a half and the start.
    """
    import numpy as np

    start = np.array([START[name in BAD_ONLY] for name in LABELLERS])
    chance, share = start.copy(), 0.5
    if patterns:
        v = np.array([p for p, _ in patterns])
        n = np.array([c for _, c in patterns], dtype=float)
        share = START_SHARE
        for _ in range(EM_TURNS):
            good = _posterior(share, chance, v)
            new = start * (PRIOR * n.sum())
            for c, w in ((1, n * good), (0, n * (1 - good))):
                for vote in (BAD, GOOD, SILENT):
                    new[:, c, vote] += ((v == vote) * w[:, None]).sum(0)
            new /= new.sum(2, keepdims=True)
            new_share = float(np.clip((n * good).sum() / n.sum(), 1e-3, 1 - 1e-3))
            moved = max(np.abs(new - chance).max(), abs(new_share - share))
            chance, share = new, new_share
            if moved < EM_STEP:
                break
    return share, chance.tolist()


def _posterior(share: float, chance, v):
    """Chance of being good for each row of votes."""
    import numpy as np

    chance = np.asarray(chance)
    ratio = math.log(share / (1 - share)) + sum(np.log(chance[k, 1, v[:, k]] / chance[k, 0, v[:, k]]) for k in range(len(chance)))
    return 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))


def features(text: str | None, known: dict | None = None):
    """(indexes, values) of hashed features: words and their shapes, by root of their count, with unit length, and one constant."""
    import zlib
    from collections import Counter

    import numpy as np

    found: dict[int, float] = {}
    if known is None or len(known) > CACHE_WORDS:
        known = {} if known is None else known
        known.clear()
    for w, c in Counter((text or "").split()).items():
        pair = known.get(w)
        if pair is None:
            low = w.lower().strip(".,;:")
            shape = "a" if low.isalpha() else re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", low))
            shape += "U" if len(w) > 1 and w.isupper() else ""
            mask = (1 << BITS) - 1
            pair = known[w] = zlib.crc32(low.encode()) & mask, zlib.crc32(b"\x01" + shape.encode()) & mask
        found[pair[0]] = found.get(pair[0], 0.0) + c
        found[pair[1]] = found.get(pair[1], 0.0) + c
    own = np.fromiter(found.keys(), dtype=np.int64, count=len(found))
    value = np.sqrt(np.fromiter(found.values(), dtype=np.float64, count=len(found)))
    own, value = np.append(own, 1 << BITS), np.append(value / (np.sqrt((value**2).sum()) or 1.0), 1.0)
    return own, value


@dataclass
class QualityModel:
    share: float
    chance: list
    weights: object

    def score(self, text: str | None, known: dict | None = None) -> float:
        own, value = features(text, known)
        return 1 / (1 + math.exp(-min(max(float(self.weights[own] @ value), -30), 30)))


def with_votes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``votes``, an array of the labellers' votes (1 good, 0 bad, 2 silent)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([votes(t) for t in batch])

    return docs.withColumn("votes", run(F.col(text)))


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> QualityModel:
    """Weigh the labellers over the votes of all documents, then fit the scorer to posterior labels of a bounded sample.

    Only the counts of different vote patterns (at most 3 to the number of labellers) reach the driver. The sample is
    split into shards that fit in parallel; their weights are averaged. No documents give a scorer of zeros.
    """
    import numpy as np

    voted = with_votes(docs.select("doc_id", "text"))
    counted = voted.groupBy("votes").count().collect()
    share, chance = expectation_maximisation(sorted((list(r.votes), r["count"]) for r in counted))
    chosen = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SHARDS)).cast("int"))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("doc_id").sort_values("doc_id")
        v = np.array([votes(t) for t in part["text"]])
        goal = _posterior(share, chance, v)
        rows = [features(t) for t in part["text"]]
        w = np.zeros((1 << BITS) + 1)
        rng = np.random.default_rng(1)
        for turn in range(PASSES):
            for k in rng.permutation(len(rows)):
                own, value = rows[k]
                p = 1 / (1 + np.exp(-np.clip(w[own] @ value, -30, 30)))
                w[own] -= RATE / (1 + turn) * ((p - goal[k]) * value + RIDGE * w[own])
        return pd.DataFrame({"n": [len(part)], "weights": [w.tolist()]})

    shards = sample.groupBy("shard").applyInPandas(learn, "n long, weights array<double>").collect()
    weights = np.zeros((1 << BITS) + 1)
    for r in sorted(shards, key=lambda r: (r.n, r.weights[-1])):
        weights += np.array(r.weights) * r.n
    return QualityModel(share, chance, (weights / max(sum(r.n for r in shards), 1)).astype(np.float32))


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``quality_model``: votes, posterior (of the weak labels) and score (of the linear scorer).

    Null and empty texts and texts under five words get silent votes; their posterior follows from silence and their
    score from the intercept. Rows are scored one by one, so repeats get equal scores; an empty table gives an empty
    result; other columns stay, a column called ``quality_model`` is replaced.
    """
    small_batches(docs.sparkSession)
    held = shipped(docs.sparkSession, model)

    @F.pandas_udf("votes array<int>, posterior double, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        m, known = unpacked(held), {}
        for batch in batches:
            v = [votes(t) for t in batch]
            posterior = _posterior(m.share, m.chance, np.array(v)) if v else []
            yield pd.DataFrame({"votes": v, "posterior": posterior, "score": [m.score(t, known) for t in batch]})

    return docs.withColumn("quality_model", run(F.col(text)))


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(docs, fit(docs))
    return scored.select(
        "doc_id", F.col("quality_model.posterior").alias("posterior"), F.col("quality_model.score").alias("score"),
        (F.col("quality_model.score") >= THRESHOLD).alias("kept"),
    )
