"""How far the sources of a language differ in their words: exact distances of all pairs, and the terms behind them.

Terms are rows of counts by source. Their nonzero counts, in a fixed order of the sources, are paths of a frequent-pattern
tree in which terms that agree on their first sources share nodes. A pair of sources differs on a term as if both lacked
it, plus what one of them having it changes, plus a correction where both do; the last is summed over the tree, once for
each node and ancestor, times the terms that share them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfweek.llm.base import small_batches, table
from shelfweek.llm.words import byte_table, encode, split_column
from shelfweek.session import materialise

MIN_DOCS = 30
SMOOTHING = 5
TOP_TERMS = 50
SALTS = 32
TREE_CELLS = 1 << 20  # path elements of one tree, and node-ancestor combinations looked at together
HELD_WORDS = 1 << 22  # words that a task counts together
HELD = 1 << 19  # pairs of sources that a task holds before it hands them on
ROWS_OUT = 1 << 15  # of one record batch
#: Everything but letters and bytes of other than ASCII characters becomes a space; A-Z become lower case.
TERM_BYTES = byte_table(b"abcdefghijklmnopqrstuvwxyz")


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 * (count + 5) / (total + 5 * terms))``, three digits at a time so that nothing overflows."""
    below = total + SMOOTHING * terms
    rest, out = (count + SMOOTHING).cast("long"), F.lit(0).cast("long")
    for _ in range(3):
        digits = F.call_function("div", rest * 1000, below)
        rest = rest * 1000 - digits * below
        out = out * 1000 + digits
    return out + 1


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and how often each occurs."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, dtype=np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


class _Counted:
    """Some texts' words, to be counted together."""

    def __init__(self):
        self.words: list = []
        self.sizes: list[np.ndarray] = []
        self.langs: list[str] = []
        self.sources: list[str] = []
        self.held = 0

    def add(self, langs: list[str], sources: list[str], texts) -> None:
        words, sizes = split_column(texts, TERM_BYTES)
        self.words.append(words)
        self.sizes.append(sizes)
        self.langs += langs
        self.sources += sources
        self.held += len(words)

    def rows(self):
        """Record batches of (lang, term, docs, row), and a fresh start."""
        import pyarrow as pa

        if not self.words:
            return
        words, ids, sizes = encode(self.words, np.concatenate(self.sizes))
        langs, lang = np.unique(np.array(self.langs, dtype=object), return_inverse=True)
        sources, source = np.unique(np.array(self.sources, dtype=object), return_inverse=True)
        self.__init__()
        term_bits, source_bits = len(words).bit_length(), len(sources).bit_length()
        doc = np.repeat(np.arange(len(sizes)), sizes)
        once, _ = _runs(doc << term_bits | ids)
        term, docs = _runs(lang[once >> term_bits] << term_bits | once & (1 << term_bits) - 1)
        pair, n = _runs((lang[doc] << term_bits | ids) << source_bits | source[doc])
        start = np.append(np.searchsorted(pair >> source_bits, term), len(pair))
        labels, names = pa.array(langs, pa.string()), pa.array(sources, pa.string())
        for low in range(0, len(term), ROWS_OUT):
            high = min(low + ROWS_OUT, len(term))
            inner = slice(start[low], start[high])
            cells = pa.StructArray.from_arrays([names.take(pa.array(pair[inner] & (1 << source_bits) - 1)), pa.array(n[inner])], ["source", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    labels.take(pa.array(term[low:high] >> term_bits)),
                    words.take(pa.array(term[low:high] & (1 << term_bits) - 1)), pa.array(docs[low:high]),
                    pa.ListArray.from_arrays(pa.array((start[low : high + 1] - start[low]).astype(np.int32)), cells),
                ],
                ["lang", "term", "docs", "row"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, row): documents and, by source, occurrences, as far as one task has counted them together."""
    small_batches(docs.sparkSession)

    def run(batches):
        counted = _Counted()
        for batch in batches:
            counted.add(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"))
            if counted.held > HELD_WORDS:
                yield from counted.rows()
        yield from counted.rows()

    return docs.select("lang", "source", "text").mapInArrow(
        run, "lang string, term string, docs long, row array<struct<source: string, n: long>>"
    )


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n): counts of the terms in at least ``min_docs`` documents of their language.

    Texts are counted once and the counts written; most of them are rare terms, which only their documents are read of.
    """
    counts = materialise(term_counts(docs), "term_counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    held = counts.select("lang", "term", "row").join(kept.select("lang", "term"), ["lang", "term"])
    return (
        held.select("lang", "term", F.inline("row")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    )


def group_sizes(docs: DataFrame, entries: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, place, total, terms, lang_total, base) of every occurring group.

    ``place`` orders the sources of a language for the tree, those with most terms first, and ``base`` is the share of
    a term the group lacks. Without kept terms, totals are 0 and ``base`` is null.
    """
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total", "terms", "lang_total", "held")}
    order = Window.partitionBy("lang").orderBy(F.desc("held"), "source")
    return groups.withColumns(zero).select(
        "lang", "source", F.row_number().over(order).cast("long").alias("place"), "total", "terms", "lang_total",
        F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).alias("base"),
    )


def _nodes(lang: np.ndarray, start: np.ndarray, size: np.ndarray, times: np.ndarray, cells: dict[str, np.ndarray]):
    """Nodes of the tree of some sorted paths, level by level: (depth, first path through each node, terms below it)."""
    same = np.append(False, lang[1:] == lang[:-1])
    for depth in range(int(size.max(initial=0))):
        alive = size > depth
        at = np.where(alive, start + depth, 0)
        for column in ("place", "n"):
            value = np.where(alive, cells[column][at], -1)
            same[1:] &= (value[1:] == value[:-1]) & alive[1:]
        rows = np.flatnonzero(alive)
        first = np.flatnonzero(~same[rows])
        yield depth, rows[first], np.add.reduceat(times[rows], first)


def corrections(lang: np.ndarray, start: np.ndarray, size: np.ndarray, times: np.ndarray, cells: dict[str, np.ndarray]) -> pd.DataFrame:
    """(lang, a, b, fix): summed corrections of pairs of sources that share terms, from one tree of sorted paths.

    ``cells`` holds the paths' elements one after another: the source's place, the count n, its share p and the base of
    the source. Each combination of a node and one of its ancestors is looked at once.
    """
    out = []
    for depth, rows, terms in _nodes(lang, start, size, times, cells):
        if not depth:
            continue
        for part in np.array_split(np.arange(len(rows)), len(rows) * depth // TREE_CELLS + 1):
            above = start[rows[part]][:, None] + np.arange(depth)
            here = start[rows[part]][:, None] + depth
            p, base = cells["p"], cells["base"]
            fix = np.abs(p[above] - p[here]) - np.abs(p[above] - base[here])
            fix += np.abs(base[above] - base[here]) - np.abs(base[above] - p[here])
            fix *= terms[part][:, None]
            out.append(_summed(np.repeat(lang[rows[part]], depth), cells["place"][above].ravel(), np.repeat(cells["place"][here[:, 0]], depth), fix.ravel()))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "fix": []}, dtype=np.int64)


def _summed(lang, a, b, fix) -> pd.DataFrame:
    if not len(lang):
        return pd.DataFrame({"lang": lang, "a": a, "b": b, "fix": fix})
    order = np.lexsort((b, a, lang))
    lang, a, b, fix = lang[order], a[order], b[order], fix[order]
    first = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return pd.DataFrame({"lang": lang[first], "a": a[first], "b": b[first], "fix": np.add.reduceat(fix, first)})


def _tree_sums(batches):
    """Corrections of one sorted partition, tree after tree; a tree takes up to ``TREE_CELLS`` path elements."""
    import pyarrow as pa

    names: dict[str, int] = {}

    def one(held: list) -> pd.DataFrame:
        rows = pa.Table.from_batches(held).combine_chunks()
        path = rows["path"].combine_chunks()
        if isinstance(path, pa.ChunkedArray):
            path = pa.concat_arrays(path.chunks)
        offsets = path.offsets.to_numpy()
        inner = path.values
        cells = {c: inner.field(c).to_numpy(zero_copy_only=False) for c in ("place", "n", "p", "base")}
        lang = np.array([names.setdefault(v, len(names)) for v in rows["lang"].to_pylist()], dtype=np.int64)
        return corrections(lang, offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64), rows["times"].to_numpy(), cells)

    def handed(found: pd.DataFrame):
        known = np.array(list(names), dtype=object)
        return pa.RecordBatch.from_pydict({
            "lang": pa.array(known[found["lang"].to_numpy(np.int64)].tolist() if len(found) else [], pa.string()),
            **{c: pa.array(found[c].to_numpy(np.int64)) for c in ("a", "b", "fix")},
        })

    held, cells, sums = [], 0, None
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            cells += len(batch.column("path").values)
        if cells > TREE_CELLS:
            found = one(held)
            sums = found if sums is None else _summed(*(np.concatenate([sums[c], found[c]]) for c in ("lang", "a", "b", "fix")))
            held, cells = [], 0
            if len(sums) > HELD:
                yield handed(sums)
                sums = None
    for found in ([one(held)] if held else []) + ([sums] if sums is not None else []):
        yield handed(found)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every occurring (lang, source).

    Part ``pair``: each other source of the language, by the sum over kept terms of the difference of both shares; 0 where
    the language keeps no term. Part ``term``: the kept terms that the group holds a larger share of than its
    language, by that difference, the first ``top_terms``. Ranks go by value downwards, then by item.

    Null text, lang and source are read as empty; a text without letters has no terms; repeated rows count as
    documents of their own. An empty table gives no rows. Other columns are not read.

    Counts are combined in tasks before each shuffle, a term's row is as long as its sources are many, and equal paths
    are counted before they are ordered, so neither a hot source nor a hot term meets in one task.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = materialise(kept_terms(docs, min_docs), "kept_counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    sizes = materialise(group_sizes(docs, counts, terms), "term_groups")
    entries = materialise(
        counts.join(terms.withColumnRenamed("n", "lang_n"), ["lang", "term"]).join(sizes, ["lang", "source"])
        .select(
            "lang", "source", "term", "place", "n", "base", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
        ),
        "term_shares",
    )
    pairs = pair_distances(entries, sizes)
    names = sizes.select("lang", "place", "source")
    pairs = (
        pairs.join(names.withColumnRenamed("place", "a"), ["lang", "a"])
        .join(names.select("lang", F.col("place").alias("b"), F.col("source").alias("item")), ["lang", "b"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    above = entries.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = above.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(ranked)


def pair_distances(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, a, b, value) for all ordered pairs of places of a language."""
    paths = materialise(
        entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "n", "p", "base"))).alias("path"))
        .groupBy("lang", "path").agg(F.count("*").alias("times")),
        "term_paths",
    )
    fixes = (
        paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
        .mapInArrow(_tree_sums, "lang string, a long, b long, fix long")
    )
    salted = sizes.select("lang", "place", "base", "terms", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = salted.select("lang", "salt", F.col("place").alias("b"), F.col("base").alias("other"), "terms")

    def against(rows: DataFrame, salt: Column) -> DataFrame:
        return rows.withColumn("salt", F.pmod(F.hash(salt), F.lit(SALTS))).join(salted, ["lang", "salt"]).filter("a != b")

    both_lack = against(sizes.select("lang", F.col("place").alias("a"), "base"), F.col("a")).select(
        "lang", "a", "b", F.coalesce(F.col("terms") * F.abs(F.col("base") - F.col("other")), F.lit(0)).alias("value")
    )
    counted = entries.groupBy("lang", F.col("place").alias("a"), "base", "p").agg(F.count("*").alias("times"))
    one_has = against(counted, F.col("p")).select(
        "lang", "a", "b",
        (F.col("times") * (F.abs(F.col("p") - F.col("other")) - F.abs(F.col("base") - F.col("other")))).alias("value"),
    ).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both_have = fixes.groupBy("lang", "a", "b").agg(F.sum("fix").alias("value"))
    turned = lambda rows: rows.unionByName(rows.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    parts = both_lack.unionByName(turned(one_has)).unionByName(turned(both_have))
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


#: The same by plain joins of all groups with all kept terms of their language.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
  FROM grp g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
sized AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(lang_n) OVER (PARTITION BY lang, source) AS lang_total,
         count(*) OVER (PARTITION BY lang, source) AS terms
  FROM dense),
shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * terms) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * terms) AS q
  FROM sized),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
above AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
WHERE part = 'pair' OR rank <= 50
"""
