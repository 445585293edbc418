"""Benchmark decontamination: training passages query a BM25 index of the test items with block-max WAND."""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.llm.base import shipped, small_batches, table, unpacked, windows
from shelfweek.llm.licenses import words_of

K1, B = 1.2, 0.75
THRESHOLD = 0.4  # of the score an item has against itself
QUESTION, ANSWER = 0.6, 0.6  # least share of the question's and the answer's word runs that the passage must hold
WHOLE = 0.6  # or of all runs of the item, however they fall on the two
RUN = 3  # words of a run
LEAST = 7  # words of an answer; shorter ones reach back into the question, up to half of the item
BLOCK = 16  # postings of a block
GROUPS = 64  # groups of items for the first bound of a passage, at least
BOUNDS = 1 << 21  # bounds by term and group that an index may hold to have more groups, up to one for each item
ITEMS = 20_000  # items of one index; more are searched for in several passes
PASSAGE = 100  # least words of a passage; longer items make it longer
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, start long"


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer: the answer is the last sentence, or the last third of a single one.

    A short answer has one run or two, which one changed word takes away; it is extended backwards to ``LEAST`` words.
    """
    parts = [w for p in re.split(r"(?<=[.!?])\s+|\n", text or "") if (w := words_of(p))]
    words = [w for p in parts for w in p]
    last = len(parts[-1]) if len(parts) > 1 else len(words) // 3
    cut = len(words) - max(last, min(LEAST, len(words) // 2))
    return words[:cut], words[cut:]


def runs(words: list[bytes]) -> set:
    return set(windows(words, RUN)) if len(words) >= RUN else ({tuple(words)} if words else set())


class Index:
    """Postings by term, in order of item; weights are shares of the item's score against itself."""

    def __init__(self, items: list[tuple[int, str]], document_count: int, frequency: dict[bytes, int]):
        import numpy as np

        self.ids = [i for i, _ in items]
        self.sides = [question_and_answer(t) for _, t in items]
        words = [q + a for q, a in self.sides]
        self.runs = [(runs(q), runs(a), runs(q + a)) for q, a in self.sides]
        self.longest = max(map(len, words), default=0)
        mean = sum(map(len, words)) / max(len(words), 1) or 1.0
        self.postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for n, w in enumerate(words):
            weights = {
                t: math.log(1 + (document_count - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean))
                for t, c in Counter(w).items()
            }
            total = sum(weights.values()) or 1.0
            for t, v in weights.items():
                self.postings[t].append((n, v / total))
        self.words = list(self.postings)
        self.term = {t: k for k, t in enumerate(self.words)}
        wide = max(GROUPS, BOUNDS // max(len(self.term), 1))
        self.groups = np.zeros((len(self.term), min(wide, max(len(items), 1))), dtype=np.float32)
        for t, k in self.term.items():
            for n, v in self.postings[t]:
                g = n * self.groups.shape[1] // len(items)
                self.groups[k, g] = max(self.groups[k, g], v)
        at = [n * self.groups.shape[1] // max(len(items), 1) for n in range(len(items))]
        self.ranges = [(at.index(g), len(at) - at[::-1].index(g)) for g in range(self.groups.shape[1])] if items else [(0, 0)]
        self.most = {t: max(v for _, v in p) for t, p in self.postings.items()}
        self.places = {t: [n for n, _ in p] for t, p in self.postings.items()}
        self.blocks = {t: [(p[min(k + BLOCK, len(p)) - 1][0], max(v for _, v in p[k : k + BLOCK])) for k in range(0, len(p), BLOCK)] for t, p in self.postings.items()}

    def search(self, terms: set[bytes], threshold: float = THRESHOLD, group: int | None = None) -> list[tuple[int, float]]:
        """All items (of one group, or of all) whose score for these query terms reaches the threshold, by block-max WAND.

        Cursors are kept in order of their item. The first item at which the summed upper bounds can reach the
        threshold is the pivot; if the bounds of the blocks that hold it cannot, all skip to the end of those blocks.
        """
        low, high = (0, len(self.ids)) if group is None else self.ranges[group]
        at, most = {}, {}
        for t in terms:
            places = self.places.get(t, ())
            k = bisect_left(places, low)
            if k < len(places) and places[k] < high:
                at[t], most[t] = k, self.most[t] if group is None else float(self.groups[self.term[t], group])
        found = []
        while True:
            live = sorted((n, t) for t, k in at.items() if k < len(self.places[t]) and (n := self.places[t][k]) < high)
            bound, pivot = 0.0, None
            for k, (n, t) in enumerate(live):
                bound += most[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = live[pivot][0]
            reach = [t for n, t in live if n <= item]
            ends, block_bound = [], 0.0
            for t in reach:
                blocks = self.blocks[t]
                b = at[t] // BLOCK
                while b < len(blocks) and blocks[b][0] < item:
                    b += 1
                if b < len(blocks):
                    block_bound += blocks[b][1]
                    ends.append(blocks[b][0])
            if block_bound < threshold:
                after = [n for n, _ in live if n > item]
                goal = max(item + 1, min([min(ends, default=item) + 1, *after[:1]]))
                for t in reach:
                    at[t] = bisect_left(self.places[t], goal, at[t])
                continue
            parts = []
            for t in reach:
                at[t] = k = bisect_left(self.places[t], item, at[t])
                if k < len(self.places[t]) and self.places[t][k] == item:
                    parts.append(self.postings[t][k][1])
                    at[t] = k + 1
            score = math.fsum(parts)  # whatever the order of the cursors
            if score >= threshold:
                found.append((item, score))

    def leaks(self, words: list[bytes], threshold: float = THRESHOLD) -> dict[int, tuple]:
        """item -> (score, question overlap, answer overlap, first word of the passage) for the best passage of each.

        Passages overlap by half and hold twice the longest item, so an item lies whole in one of them. A passage is
        searched for only if its words can reach the threshold together for one of the groups of items, and there only by
        the words that the group has.
        """
        import numpy as np

        half = max(PASSAGE // 2, self.longest)
        get = self.term.get
        terms_at = np.fromiter(map(get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
        places = np.flatnonzero(terms_at >= 0)
        if not len(places):
            return {}
        each = np.unique(places // half * len(self.term) + terms_at[places])  # a term counts once in a half
        halves, own = np.divmod(each, len(self.term))
        first = np.flatnonzero(np.diff(halves, prepend=-1))
        sums = np.zeros((int(halves[-1]) + 2, self.groups.shape[1]), dtype=np.float32)
        some = max(1, BOUNDS // (half * self.groups.shape[1]))  # halves at a time, however long the text is
        for k in range(0, len(first), some):
            at = first[k : k + some]
            end = first[k + some] if k + some < len(first) else len(own)
            sums[halves[at]] = np.add.reduceat(self.groups[own[at[0] : end]], at - at[0])
        sums[:-1] += sums[1:]
        best: dict[int, tuple] = {}
        for k in np.flatnonzero(sums.max(axis=1) >= threshold * 0.999).tolist():
            low = k * half
            passage = words[low : low + 2 * half]
            known = np.unique(terms_at[low : low + 2 * half])
            known = known[known >= 0]
            near, hits = None, []
            for g in np.flatnonzero(sums[k] >= threshold * 0.999).tolist():
                here = known[self.groups[known, g] > 0]
                hits += self.search({self.words[t] for t in here.tolist()}, threshold, g)
            for n, score in hits:
                near = near if near is not None else set(windows(passage, RUN))
                *shares, whole = (sum(_has(r, near, passage) for r in side) / len(side) if side else 1.0 for side in self.runs[n])
                held = whole >= WHOLE or (shares[0] >= QUESTION and shares[1] >= ANSWER)
                if held and (n not in best or (score, *shares) > best[n][:3]):
                    best[n] = (score, *shares, low)
        return best


def _has(run: tuple, near: set, passage: list[bytes]) -> bool:
    if len(run) == RUN:
        return run in near
    n = len(run)
    return any(tuple(passage[i : i + n]) == run for i in range(len(passage) - n + 1))


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, start): every test item found in a document.

    ``items`` has item_id and text. Every passage of every whole text is a query; every item above the threshold is
    retrieved and then verified by the shares of its question's and answer's word runs, or of all its runs. The index is built from at
    most ``ITEMS`` items at a time, so what is broadcast is bounded; document frequencies are counted over all items.

    Null or empty texts hold nothing; items without words and a null item_id are left out; a null doc_id is returned as
    null. Repeated rows are answered row by row, items with equal texts are all found. Empty tables give no rows.
    Other columns are not read.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for held in _indexes(items):

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = unpacked(held)
            for batch in batches:
                found = []
                for doc_id, t in zip(batch["doc_id"], batch["text"]):
                    for n, (score, q, a, low) in index.leaks(words_of(t)).items():
                        found.append((None if pd.isna(doc_id) else int(doc_id), index.ids[n], min(score, 1.0), q, a, low))
                yield pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"doc_id": "Int64"})

        hits = own.mapInPandas(run, FOUND)
        out = hits if out is None else out.unionByName(hits)
    return out


def _indexes(items: DataFrame) -> list[Broadcast]:
    """Indexes of at most ``ITEMS`` items each, one at least; document frequencies are counted over all items."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    total = items.count()
    passes = max(1, math.ceil(total / ITEMS))

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(w.decode(), p) for t, p in zip(batch["text"], batch["part"]) for w in sorted(set(words_of(t)))]
            yield pd.DataFrame(pairs, columns=["word", "part"])

    parted = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(passes)).cast("int"))
    counted = parted.select("text", "part").mapInPandas(terms, "word string, part int")
    frequency = counted.groupBy("word").count()
    out = []
    for part in range(passes):
        rows = sorted((r.item_id, r.text) for r in parted.filter(F.col("part") == part).collect() if words_of(r.text))
        mine = counted.filter(F.col("part") == part).select("word").distinct()
        index = Index(rows, total, {r.word.encode(): r["count"] for r in frequency.join(mine, "word").collect()})
        out.append(shipped(items.sparkSession, index))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which ``contaminated`` finds no test item; one pass for each index, no shuffle of texts.

    Every row is judged by its own text, whatever its doc_id: null ids and repeated ids with different texts included.
    """
    small_batches(docs.sparkSession)
    for held in _indexes(items):
        docs = docs.filter(_clean(held)(F.col(text)))
    return docs


def _clean(held: Broadcast):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = unpacked(held)
        for batch in batches:
            yield pd.Series([not index.leaks(words_of(t)) for t in batch], dtype="bool")

    return clean


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
