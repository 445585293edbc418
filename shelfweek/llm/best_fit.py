"""Packing of tokenised documents into few sequences by a configuration linear program.

Only a histogram of piece lengths (at most ``window`` numbers) decides how sequences are filled, so the program runs on the
driver at the same cost for any amount of text. Texts are tokenised once; from then on rows carry numbers, and each piece
finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfweek.llm.base import small_batches, table
from shelfweek.llm.tokens import ByteTokenizer
from shelfweek.session import materialise

WINDOW = 2048
END_ID = 0
STEP = 0.25  # share of its scarcest length that a configuration gains at a time
RATE = 0.5  # learning rate of the multiplicative weights
SLACK = 0.01  # a configuration is good enough if it is worth at most this share less than the best
COLUMNS_A_TURN = 32  # configurations taken from one solution of the knapsack
TURNS = 400  # solutions of the knapsack, half of them to learn prices only
COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fills(value: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to the window the greatest total value of lengths that fit it, and one length of such a filling
    (0: none): unbounded knapsack by dynamic programming.

    ``value[l]`` is a length's worth, minus infinity where it is not on offer.
    """
    best, taken = np.zeros(window + 1), np.zeros(window + 1, dtype=np.int64)
    for room in range(1, window + 1):
        worth = value[1 : room + 1] + best[room - 1 :: -1][:room]
        at = int(worth.argmax())
        if worth[at] > best[room - 1]:
            best[room], taken[room] = worth[at], at + 1
        else:
            best[room] = best[room - 1]
    return best, taken


def priced(value: np.ndarray, window: int) -> Iterator[dict[int, int]]:
    """Configurations (length: copies) worth the most, and after it those of every other first length that are worth at
    most ``SLACK`` less."""
    best, taken = best_fills(value, window)
    worth = value[1:] + best[window - 1 :: -1][:window]
    order = np.argsort(-worth, kind="stable")[:COLUMNS_A_TURN]
    for first in order[worth[order] >= (1 - SLACK) * best[window]].tolist():
        made, room = {first + 1: 1}, window - first - 1
        while room:
            length = int(taken[room])
            if length:
                made[length] = made.get(length, 0) + 1
            room -= length or 1
        yield made


def configurations(counts: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Multiplicities of configurations for ``counts[l]`` pieces of each length l, and the pieces they leave.

    The covering program "each length as often as it occurs, by as few configurations as possible" is solved by
    multiplicative weights: a length's price is its tokens times ``exp(-RATE * its coverage)``, the knapsack finds the
    configurations of the greatest price, and each is used until its scarcest length gained ``STEP`` of its count. Lengths
    that fit badly with others lag and grow dear until they come first. The average of the later turns, divided by the median
    coverage and rounded down within what is left of every length, is the answer; what it leaves is for best fit.
    """
    offered = counts > 0
    offered[0] = False
    left = counts.astype(np.int64).copy()
    if not offered.any():
        return [], left
    tokens, full = np.arange(window + 1, dtype=np.float64), np.maximum(counts, 1)
    covered, learnt, used = np.zeros(window + 1), np.zeros(window + 1), {}
    for turn in range(TURNS):
        if turn == TURNS // 2:
            learnt, used = covered.copy(), {}
        price = tokens * np.exp(-RATE * (covered - covered[offered].min()))
        for made in priced(np.where(offered, price, -np.inf), window):
            lengths, copies = np.array(list(made)), np.array(list(made.values()))
            times = (STEP * full[lengths] / copies).min()
            covered[lengths] += times * copies / full[lengths]
            key = tuple(sorted(made.items(), reverse=True))
            used[key] = used.get(key, 0.0) + times
    scale = max(float(np.median((covered - learnt)[offered])), STEP)
    out = []
    for key, share in sorted(used.items(), key=lambda u: (-u[1], u[0])):
        lengths, copies = np.array(key).T
        times = min(int(share / scale), int((left[lengths] // copies).min()))
        if times:
            left[lengths] -= times * copies
            out.append((dict(key), times))
    return out, left


def fill_best_fit(made: list[tuple[dict[int, int], int]], left: np.ndarray, window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Add the remaining pieces, longest first, each to the fullest sequence with room; equal sequences move together,
    so the work follows the number of different sequences and not the number of pieces."""
    rooms: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(window + 1)]
    filled = np.zeros(window + 1, dtype=bool)

    def put(content: dict[int, int], room: int, times: int) -> None:
        if times:
            rooms[room].append((content, times))
            filled[room] = True

    for content, times in made:
        put(content, window - sum(length * n for length, n in content.items()), times)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = length + int(filled[length:].argmax())
            if filled[at]:
                content, times = rooms[at].pop()
                filled[at] = bool(rooms[at])
            else:
                content, times, at = {}, n, window
            copies = at // length
            whole = min(times, n // copies)
            put(content | {length: copies}, at - copies * length, whole)
            n -= whole * copies
            rest = min(n, copies) if whole < times else 0
            if rest:
                put(content | {length: rest}, at - rest * length, 1)
                n -= rest
            if content:
                put(content, at, times - whole - (rest > 0))
    return [group for groups in rooms for group in groups]


def places(groups: list[tuple[dict[int, int], int]], window: int = WINDOW) -> dict[str, np.ndarray]:
    """Ranges of ranks by length and where they go; the number of ranges follows the different sequences."""
    rank = np.zeros(window + 1, dtype=np.int64)
    rows, base = [], 0
    for content, times in groups:
        offset = 0
        for length, copies in content.items():
            rows.append((length, int(rank[length]), base, times, offset))
            rank[length] += copies * times
            offset += copies * length
        base += times
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "base", "times", "offset"), columns))


def pieces(docs: DataFrame, tokenizer: str, window: int, text: str, key: str) -> DataFrame:
    """One row a piece, with its partition and its number among that partition's pieces of its length."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        from pyspark import TaskContext

        words, part = ByteTokenizer(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch["doc_id"], batch["text"]):
                ids = np.append(words.encode(value), np.uint32(END_ID)).astype("<u4")
                doc_id, first = None if pd.isna(doc_id) else int(doc_id), len(ids) % window
                stops = list(range(first or window, len(ids) + 1, window))
                for piece, (start, stop) in enumerate(zip([0, *stops], stops)):
                    length = stop - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start:stop].tobytes()), part, seen[length]))
                    seen[length] += 1
            yield pd.DataFrame(
                rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"]
            ).astype({"doc_id": "Int64", "piece": "int32"})

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"{COLUMNS}, part int, number long")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of all documents with the sequence and offset they are packed at.

    A document is its ids and an end id; one longer than the window is cut into pieces of the window's length, of which
    the first may be shorter. Pieces are numbered inside (partition, length), and the sums of those numbers over the
    partitions before give each piece its rank among all of its length: no length, however frequent, meets in one task.
    The pieces are written once, so that numbers stay as they are when an executor is lost.

    A null or empty text is one token (the end id). Null and repeated doc_ids are packed row by row; an empty table
    gives no rows. Other columns are not read. Sequence ids run from 0 without gaps.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, window, text, key), "pieces")
    by_part = materialise(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece_counts")
    counts = np.zeros(window + 1, dtype=np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).toLocalIterator():
        counts[length] = n
    made, left = configurations(counts, window)
    where = spark.sparkContext.broadcast(places(fill_best_fit(made, left, window), window))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("rows_before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = where.value
        order = known["length"] << 48 | known["rank"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch.pop("rank").to_numpy()
            at = np.searchsorted(order, length << 48 | rank, side="right") - 1
            copy, turn = np.divmod(rank - known["rank"][at], known["times"][at])
            batch["sequence_id"] = known["base"][at] + turn
            batch["offset"] = known["offset"][at] + copy * length
            yield batch

    names = [c.split()[0] for c in COLUMNS.split(", ")]
    ranked = cut.join(offsets, ["part", "length"]).select(*names, (F.col("rows_before") + F.col("number")).alias("rank"))
    return ranked.mapInPandas(run, f"{COLUMNS}, sequence_id long, offset long")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
