"""Masked pseudo-likelihood: a window network predicts every word from both sides.

The network predicts ids. Frequent words have one of their own; a word of a shared id has the id's chance times its share
of the id's occurrences in the corpus, so that no two words are taken for one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.llm.base import small_batches, table
from shelfweek.llm.licenses import words_of
from shelfweek.session import materialise

OFFSETS = (-2, -1, 1, 2)  # places around a word that its prediction sees
WIDTH = 16
FREQUENT = 448  # most frequent words that have an id of their own
REST = 128  # ids that all other words share, by their last three bytes
FAN = 24  # words of a class: a word's chance is its class's times its own within the class
RATE, BATCH = 0.1, 8192
CHUNK = 4096  # weights of a row while they are averaged
SPREAD = 64  # first step of the averaging, by task
SIZE = FREQUENT + REST
CLASSES = SIZE // FAN
KNOWN = 131_072  # words at most whose counts every task holds, the most frequent; counts of all others are joined
UNIT = 10**9  # joined logarithms are added as whole numbers, so that a sum does not depend on the order of its rows


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; each task sums up its own before the shuffle."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        seen: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                seen.update(words_of(t))
            if len(seen) > 200_000:
                yield pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())})

    return docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shared_id(word: bytes) -> int:
    import zlib

    return FREQUENT + zlib.crc32(word[-3:]) % REST


class Ids:
    """Ids of words: the frequent ones by rank, the rest by a hash of how they end; ``others`` are hashed only once."""

    def __init__(self, frequent: list[str], others: Iterable[str] = ()):
        import numpy as np

        self.slots = {w.encode(): k for k, w in enumerate(frequent)}
        for w in others:
            self.slots.setdefault(w.encode(), len(self.slots))
        own = [k if k < len(frequent) else _shared_id(w) for w, k in self.slots.items()]
        self.ids = np.array([*own, SIZE], dtype=np.int64)  # the last one for words without a slot

    def of(self, words: list[bytes]):
        """(ids, slots); a word that is not held has slot -1."""
        import numpy as np

        get = self.slots.get
        slots = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        ids = self.ids[slots]
        for i in np.flatnonzero(slots < 0).tolist():
            ids[i] = _shared_id(words[i])
        return ids, slots

    def stream(self, texts: list[list[bytes]]):
        """(ids with the outside id between texts, places of words, text of each word, slot of each word)."""
        import numpy as np

        pad = max(OFFSETS)
        outside = np.full(pad, SIZE, dtype=np.int64)
        parts, places, owner, held, at = [outside], [], [], [], pad
        for k, words in enumerate(texts):
            ids, slots = self.of(words)
            parts += [ids, outside]
            places.append(np.arange(at, at + len(ids)))
            owner.append(np.full(len(ids), k))
            held.append(slots)
            at += len(ids) + pad
        none = [np.empty(0, dtype=np.int64)]
        return np.concatenate(parts), np.concatenate(places or none), np.concatenate(owner or none), np.concatenate(held or none)


class Network:
    """Embeddings by place, summed and squashed; a softmax over classes and one within the word's class."""

    def __init__(self, weights: dict | None = None):
        import numpy as np

        if weights is None:
            rng = np.random.default_rng(8)
            weights = {
                "embed": rng.normal(0, 0.1, (len(OFFSETS), SIZE + 1, WIDTH)), "bias": np.zeros(WIDTH),
                "cls": rng.normal(0, 0.1, (WIDTH, CLASSES)), "cls_bias": np.zeros(CLASSES),
                "own": rng.normal(0, 0.1, (CLASSES, WIDTH, FAN)), "own_bias": np.zeros((CLASSES, FAN)),
            }
        self.w = {k: np.asarray(v, dtype=np.float32) for k, v in weights.items()}
        self.steps = {k: np.full(v.shape, 1e-3, dtype=np.float32) for k, v in self.w.items()}

    def log_chances(self, ids, places, learn: bool = False):
        """Log-probability of the word at each place given its neighbours; with ``learn`` one step of descent after it."""
        import numpy as np

        w, n = self.w, len(places)
        around = [ids[places + o] for o in OFFSETS]
        hidden = np.tile(w["bias"], (n, 1))
        for k, a in enumerate(around):
            hidden += w["embed"][k][a]
        np.tanh(hidden, out=hidden)
        target = ids[places]
        kind, inner = np.divmod(target, FAN)
        rows = np.arange(n)
        chances = _softmax(hidden @ w["cls"] + w["cls_bias"])
        out = np.log(chances[rows, kind] + 1e-30)
        order = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        if learn:
            chances[rows, kind] -= 1
            back = chances @ w["cls"].T
            grads = {"cls": hidden.T @ chances, "cls_bias": chances.sum(0), "own": np.zeros_like(w["own"]), "own_bias": np.zeros_like(w["own_bias"])}
        for c in range(CLASSES):
            mine = order[bounds[c] : bounds[c + 1]]
            if not len(mine):
                continue
            h, i, r = hidden[mine], inner[mine], np.arange(len(mine))
            p = _softmax(h @ w["own"][c] + w["own_bias"][c])
            out[mine] += np.log(p[r, i] + 1e-30)
            if learn:
                p[r, i] -= 1
                grads["own"][c], grads["own_bias"][c] = h.T @ p, p.sum(0)
                back[mine] += p @ w["own"][c].T
        if learn:
            back *= 1 - hidden * hidden
            grads["bias"] = back.sum(0)
            grads["embed"] = np.stack([_summed(a, back) for a in around])
            for k, g in grads.items():
                g /= n
                self.steps[k] += g * g
                w[k] -= RATE * g / np.sqrt(self.steps[k])
        return out

    def flat(self):
        import numpy as np

        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    @classmethod
    def from_flat(cls, flat):
        net, at = cls(), 0
        for k in sorted(net.w):
            size = net.w[k].size
            net.w[k] = flat[at : at + size].reshape(net.w[k].shape).astype("float32")
            at += size
        return net


def _softmax(x):
    import numpy as np

    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _summed(ids, rows):
    """Sum of the rows of each id."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    own = ids[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    out = np.zeros((SIZE + 1, rows.shape[1]), dtype=np.float32)
    out[own[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def frequent_words(docs: DataFrame, text: str = "text", counts: DataFrame | None = None) -> list[str]:
    counted = word_counts(docs, text) if counts is None else counts
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]


def train(docs: DataFrame, frequent: list[str], text: str = "text") -> Network:
    """One pass over every word of all documents: each task descends from the same start, the weights are averaged.

    Weights travel in chunks that are averaged by task first and then over all, weighted by the words behind them; only
    the average, of fixed size, reaches the driver. No words give the untrained network.
    """
    import numpy as np

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids_of, net, seen = Ids(frequent), Network(), 0
        for batch in batches:
            ids, places, _, _ = ids_of.stream([words_of(t) for t in batch["text"]])
            places = np.random.default_rng(len(places)).permutation(places)
            for at in range(0, len(places), BATCH):
                net.log_chances(ids, places[at : at + BATCH], learn=True)
            seen += len(places)
        if seen:
            flat = net.flat()
            parts = [flat[at : at + CHUNK] for at in range(0, len(flat), CHUNK)]
            yield pd.DataFrame({"chunk": range(len(parts)), "slot": TaskContext.get().partitionId() % SPREAD, "n": seen, "weights": [p * float(seen) for p in parts]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(part["weights"].iloc[0]))
        for x in part["weights"]:
            total += np.asarray(x)
        return pd.DataFrame({"chunk": [int(part["chunk"].iloc[0])], "n": [int(part["n"].sum())], "weights": [total]})

    rows = docs.select(F.col(text).alias("text")).mapInPandas(run, "chunk int, slot int, n long, weights array<double>")
    some = rows.groupBy("chunk", "slot").applyInPandas(add, "chunk int, n long, weights array<double>")
    whole = some.groupBy("chunk").applyInPandas(add, "chunk int, n long, weights array<double>").collect()
    if not whole:
        return Network()
    return Network.from_flat(np.concatenate([np.array(r.weights) / r.n for r in sorted(whole, key=lambda r: r.chunk)]))


def _least_known(counts: DataFrame) -> int:
    """The count from which on words are held by every task: ``KNOWN`` words at most, all of equal count or none."""
    words = 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():  # one row for each count
        words += r.words
        if words > KNOWN:
            return r.n + 1
    return 1


def _id_totals(counts: DataFrame, frequent: list[str]) -> list[int]:
    """Occurrences of all words of each id that is shared; none for the ids of frequent words."""
    rest = counts.filter(~F.col("word").isin(frequent))
    shared = F.crc32(F.expr("substring(CAST(word AS BINARY), -3, 3)")) % REST + FREQUENT
    totals = [0] * SIZE
    for r in rest.groupBy(shared.alias("id")).agg(F.sum("n").alias("n")).collect():
        totals[r.id] = r.n
    return totals


def with_scores(
    docs: DataFrame, net: Network, frequent: list[str], text: str = "text", counts: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with a struct ``lm``: n_words, log_likelihood (the sum over all words) and score (its mean).

    A word's chance is its id's, times its share of the id: of N occurrences of the words of the id in ``counts`` (word,
    n; by default those of ``docs`` itself) its own n of N + 1, and one of N + 1 for any word that is not counted. Tasks hold
    the counts of the ``KNOWN`` most frequent words; other words leave their task with the row and meet their counts in a join.

    A text without words (null, empty) has a sum of zero and a null score. The longest text bounds the memory: words go
    through the network in fixed batches. Rows are scored one by one, so repeats get equal scores; an empty table gives
    an empty result; other columns (of them those in ``keep``, if given) stay, a column called ``lm`` is replaced. The
    scored rows are written once as a stage.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns = [c for c in docs.columns if keep is None or c in keep or c == "lm"]
    if counts is None:
        counts = materialise(word_counts(docs, text), "masked_lm_words")
    least = _least_known(counts)
    known = [(r.word, r.n) for r in counts.filter(F.col("n") >= least).collect()]
    held = spark.sparkContext.broadcast((net.w, frequent, known, _id_totals(counts, frequent)))

    @F.pandas_udf("n_words long, log_likelihood double, joined string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        weights, frequent, known, totals = held.value
        model, ids_of = Network(weights), Ids(frequent, [w for w, _ in known])
        whole = np.log1p(np.array([*totals, 0], dtype=float))
        own = np.zeros(len(ids_of.ids))  # of a word without a slot: joined below
        for w, n in known:
            own[ids_of.slots[w.encode()]] = n
        own[: len(frequent)] = 1
        own = np.log(np.maximum(own, 1)) - whole[ids_of.ids]
        for batch in batches:
            texts = [words_of(t) for t in batch]
            ids, places, owner, slots = ids_of.stream(texts)
            found = [model.log_chances(ids, places[at : at + BATCH]) for at in range(0, len(places), BATCH)]
            share = np.where(slots < 0, -whole[ids[places]], own[slots])
            n = np.bincount(owner, minlength=len(batch))
            total = np.bincount(owner, weights=np.concatenate(found) + share if found else None, minlength=len(batch)).astype(float)
            ends = np.cumsum(n)
            joined = [b" ".join([words[i] for i in np.flatnonzero(slots[e - len(words) : e] < 0).tolist()]).decode() for words, e in zip(texts, ends)]
            yield pd.DataFrame({"n_words": n, "log_likelihood": total, "joined": joined})

    rest = [c for c in columns if c != "lm"]
    rows = docs.select(F.struct(*rest).alias("doc"), run(F.col(text)).alias("lm"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "masked_lm")
    words = rows.filter("lm.joined != ''").select("row", F.explode(F.split("lm.joined", " ")).alias("word"))
    # The logarithm of a word that occurs once is zero, as that of a word that is not counted.
    logs = counts.filter((F.col("n") > 1) & (F.col("n") < least)).select("word", F.round(F.log("n") * UNIT).cast("long").alias("log"))
    sums = words.join(logs, "word").groupBy("row").agg(F.sum("log").alias("log"))
    total = F.col("lm.log_likelihood") + F.coalesce(F.col("log"), F.lit(0)) / F.lit(float(UNIT))
    scored = rows.join(sums, "row", "left").select("doc", "lm.n_words", total.alias("total"))
    score = F.when(F.col("n_words") > 0, F.col("total") / F.col("n_words"))
    lm = F.struct("n_words", F.col("total").alias("log_likelihood"), score.alias("score")).alias("lm")
    ordered = columns if "lm" in columns else [*columns, "lm"]
    return scored.select(*(lm if c == "lm" else F.col("doc").getField(c).alias(c) for c in ordered))


def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = materialise(word_counts(docs), "masked_lm_words")
    frequent = frequent_words(docs, counts=counts)
    scored = with_scores(docs, train(docs, frequent), frequent, counts=counts, keep=["doc_id"])
    return scored.select("doc_id", "lm.n_words", "lm.log_likelihood", "lm.score")
