"""Order-preserving packing of tokenised documents into sequences."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.llm.base import small_batches, table
from shelfweek.llm.tokens import WordTokenizer

WINDOW = 2048
END_ID = 1
BLOCK = 1 << 19  # tokens that one run of the dynamic programme looks at; its last window is carried over
CHARACTERS = 12_000_000  # of text that are taken apart together
SENTENCE_PENALTY, INNER_PENALTY, SEQUENCE_COST = 2, 48, 4  # in padding tokens
INNER_STEP = 256  # distance of the cuts offered inside text without a sentence end
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(cuts: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """Indexes into ``cuts`` (ascending, from 0; neighbours at most ``window`` apart) of the cheapest chain from first to last.

    A chain link costs its padding (none at the window or its half or quarter), the penalty of the cut it ends at and a little for
    being a sequence. The best start of a padded link is the least ``cost + position`` among the cuts in reach,
    kept in a monotone queue, so each cut enters and leaves it once.
    """
    n = len(cuts)
    cost, back = [0] * n, [0] * n
    at = {c: i for i, c in enumerate(cuts)}
    powers = [window >> k for k in range(3) if window >> k]
    queue: deque[tuple[int, int]] = deque([(cuts[0], 0)])
    for j in range(1, n):
        here = cuts[j]
        while cuts[queue[0][1]] < here - window:
            queue.popleft()
        key, i = queue[0]
        best = key + window - here
        for p in powers:
            k = at.get(here - p)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        cost[j] = best = best + penalties[j] + SEQUENCE_COST
        back[j] = i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    chain = [n - 1]
    while chain[-1]:
        chain.append(back[chain[-1]])
    return chain[::-1]


class Packer:
    """Packs one partition's documents in their order; holds about one block of tokens."""

    def __init__(self, first_sequence: int, ends, window: int = WINDOW):
        self.sequence, self.ends, self.window = first_sequence, ends, window
        self.docs: list[list] = []  # doc_id, ids not yet packed, start of those in the document, tokens of the document
        self.tokens = 0

    def add(self, doc_id, ids) -> list[tuple]:
        self.docs.append([doc_id, ids, 0, len(ids)])
        self.tokens += len(ids)
        return self.flush(False) if self.tokens >= BLOCK else []

    def _offered(self) -> tuple[list[int], list[int]]:
        import numpy as np

        cuts, penalties, base, step = [0], [0], 0, min(INNER_STEP, self.window)
        for _, ids, _, _ in self.docs:
            stops = np.flatnonzero(self.ends[ids[:-1]]) + 1 if len(ids) > 1 else np.empty(0, dtype=np.int64)
            stops = np.append(stops[stops < len(ids) - 1], len(ids)).tolist()
            last = 0
            for stop in stops:
                for inner in range(last + step, stop, step):
                    cuts.append(base + inner)
                    penalties.append(INNER_PENALTY)
                cuts.append(base + stop)
                penalties.append(SENTENCE_PENALTY)
                last = stop
            penalties[-1] = 0
            base += len(ids)
        return cuts, penalties

    def flush(self, final: bool) -> list[tuple]:
        """Pieces of the finished windows. The last window waits for more text unless ``final``; then it is cut at
        powers of two, which need no padding."""
        import zlib

        if not self.docs:
            return []
        cuts, penalties = self._offered()
        marks = [cuts[i] for i in best_cuts(cuts, penalties, self.window)]
        if final:
            low, left = marks.pop(-2) if len(marks) > 1 else 0, 0
            left = marks.pop() - low
            marks.append(low)
            while left:
                part = min(1 << left.bit_length() - 1, self.window)
                marks.append(marks[-1] + part)
                left -= part
        else:
            marks.pop()
        out, base, m = [], 0, 0
        kept: list[list] = []
        for doc in self.docs:
            doc_id, ids, start, total = doc
            taken = 0
            while taken < len(ids) and m + 1 < len(marks):
                length = min(marks[m + 1] - base, len(ids)) - taken
                piece = ids[taken : taken + length]
                out.append((doc_id, start + taken, length, zlib.crc32(piece.tobytes()), total, self.sequence + m, base + taken - marks[m]))
                taken += length
                if base + taken == marks[m + 1]:
                    m += 1
            if taken < len(ids):
                kept.append([doc_id, ids[taken:], start + taken, total])
            base += len(ids)
        self.sequence += m
        self.docs, self.tokens = kept, sum(len(d[1]) for d in kept)
        return out


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches joined up to ``CHARACTERS``: the more text at once, the fewer words are new."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(batch["text"].str.len().sum())
        if size > CHARACTERS:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``window`` tokens (a power of two).

    Documents are packed in the order of their input partitions, each partition on its own, so nothing is
    shuffled and a lost task repeats with the same result. Window cuts are chosen by dynamic programming at
    document ends, sentence ends or, inside long text without either, at penalised inner places. The ends of
    blocks of ``BLOCK`` tokens carry their last window over; a partition's last window is cut at powers of two.

    A null or empty text is one token (the end id). Null and repeated doc_ids are packed row by row; an empty
    table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from pyspark import TaskContext

        words = WordTokenizer(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, words.ends, window)
        names = [c.split()[0] for c in PIECES.split(", ")]
        end = np.array([END_ID], dtype="<u4")
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
        for batch in _together(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"], words.encode(batch["text"])):
                rows += packer.add(None if pd.isna(doc_id) else int(doc_id), np.concatenate([ids, end]))
            if rows:
                yield frame(rows)
        rows = packer.flush(True)
        if rows:
            yield frame(rows)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, PIECES)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
