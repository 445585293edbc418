"""License scan through a positional index of rare licence words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.llm.base import small_batches, table


@dataclass(frozen=True)
class Template:
    """A licence text to look for. Exact ones need every word; others a share of the words and the key phrase."""

    label: str
    text: str
    key: str
    exact: bool = False


BASE = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
)
OWN = (
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-nc-4", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "to the extent possible under law the author has waived all copyright cc0", "waived all copyright"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
)
ANCHORS = 3  # rarest words of a template that the index holds
SHARE = 0.6  # of a template's words, by weight, that must stand at their places
#: Every byte that is no letter, digit or part of a non-ASCII character becomes a space; A-Z become a-z.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_FOLD).split()


class Index:
    """Postings (template, place) of each template's rarest words, and the weights of all template words."""

    def __init__(self, templates: Sequence[Template], weight: Mapping[str, float]):
        self.templates = [(t, words_of(t.text), words_of(t.key)) for t in templates]
        self.weight = {w.encode(): v for w, v in weight.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for n, (t, words, _) in enumerate(self.templates):
            rarest = sorted(range(len(words)), key=lambda i: (-self.weight[words[i]], i))
            for i in rarest[: 1 if t.exact else ANCHORS]:
                self.postings[words[i]].append((n, i))

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, bool, float]]:
        """(label, start, words, exact, share) of each template at each place, in order of place."""
        postings, votes = self.postings, set()
        for at in [i for i, w in enumerate(words) if w in postings]:
            votes.update((n, at - i) for n, i in postings[words[at]])  # equal relative positions meet in one start
        found = []
        for n, start in votes:
            t, own, key = self.templates[n]
            if t.exact:
                if start >= 0 and words[start : start + len(own)] == own:
                    found.append((t.label, start, len(own), True, 1.0))
                continue
            low = max(start, 0)
            hits = [own[i - start] == words[i] for i in range(low, min(start + len(own), len(words)))]
            weights = [self.weight[w] for w in own]
            share = sum(w for w, h in zip(weights[low - start :], hits) if h) / (sum(weights) or 1.0)
            if share >= SHARE and _holds(words[low : start + len(own)], key):
                found.append((t.label, low, len(own) - (low - start), False, share))
        return sorted(found, key=lambda m: (m[1], m[0], m[2]))


def _holds(words: list[bytes], phrase: list[bytes]) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i in range(len(words) - n + 1))


def word_weights(docs: DataFrame, templates: Sequence[Template], text: str = "text") -> dict[str, float]:
    """Inverse document frequency of every template word, over all documents; the words are a fixed small list."""
    small_batches(docs.sparkSession)
    wanted = frozenset(w for t in templates for w in words_of(t.text))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        seen, n = Counter(), 0
        for batch in batches:
            n += len(batch)
            for t in batch["text"]:
                seen.update(wanted.intersection(words_of(t)))
        yield pd.DataFrame({"word": ["", *(w.decode() for w in seen)], "n": [n, *seen.values()]})

    rows = docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    seen = {r.word: r.n for r in rows}
    total = seen.get("", 0)
    import math

    return {w.decode(): math.log((total + 1) / (seen.get(w.decode(), 0) + 0.5)) for w in wanted}


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + OWN, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``licence``: n_words and matches (label, start, length, exact, share), in order of place.

    A document's rarest licence words are looked up in the index; postings at equal relative positions give a place,
    where the template's words are compared: exact templates whole, others by weighted share and mandatory key phrase.
    A null or empty text has no words and no matches. Repeated rows give equal results; an empty table gives none;
    other columns stay, a column called ``licence`` is replaced. The index is a fixed short list in the plan.
    """
    small_batches(docs.sparkSession)
    index = Index(templates, word_weights(docs, templates, text))

    @F.pandas_udf("n_words long, matches array<struct<label:string,start:long,length:long,exact:boolean,share:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("label", "start", "length", "exact", "share")
        for batch in batches:
            words = [words_of(t) for t in batch]
            found = [[dict(zip(names, m)) for m in index.matches(w)] for w in words]
            yield pd.DataFrame({"n_words": [len(w) for w in words], "matches": found})

    return docs.withColumn("licence", run(F.col(text)))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    matches = F.col("licence.matches")
    base = F.filter(matches, lambda m: m["exact"])
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return found.select("doc_id", "licence").select(
        "doc_id", "licence.n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(matches).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform(matches, lambda m: m["share"])), F.lit(0.0))).alias("score"),
    )
