"""Line-first quality rules: clean line by line, then judge the document by what is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.llm.base import SPACE, table

# Patterns are plain enough for Java's and DuckDB's expressions alike; \n, \t and so on are characters here.
WORD = f"[^{SPACE}]+"
SYMBOL = "[#*$%&|<>]"
SEPARATOR = "[|»›•]"
NOISE = "[#*$%&<>]"
SHOUT = "!!"
ENDED = "[.!?…:;][)\"'”’»]*[\\x20\\x09-\\x0D]*$"
BOILERPLATE = (
    "(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|sign (in|up)|"
    "log in|subscribe|click here|read more|share this|lorem ipsum|copyright|©)"
)
#: A line fails a rule at so many words to one mark.
NAVIGATION_WORDS, NOISE_WORDS, SHOUT_WORDS = 4, 3, 3
UNENDED_WORDS = 12  # a line without closing punctuation fails if it has fewer words
BOILERPLATE_WORDS = 25  # a line with a set phrase fails if it has fewer words
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_KEPT_PERCENT = 50, 50, 50


MARKED = "[|»›•#*$%&<>]|!!"  # texts without any of these need no look at marks in their lines


def fragment(line: Column) -> Column:
    """Whether a line is an unfinished fragment or boilerplate. Blank lines are not."""
    words = F.regexp_count(line, F.lit(WORD))
    return (~line.rlike(ENDED) & words.between(1, UNENDED_WORDS - 1)) | ((words < BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))


def line_fails(line: Column) -> Column:
    """Whether a line is navigation, noise, shouting, a fragment or boilerplate. Blank lines pass.

    The word count stands last in each rule: it is only made for lines with marks.
    """
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    words, marks, noise, shouts = count(WORD), count(SEPARATOR), count(NOISE), count(SHOUT)
    return (
        ((marks >= 2) & (marks * NAVIGATION_WORDS >= words))
        | ((noise >= 2) & (noise * NOISE_WORDS >= words))
        | ((shouts >= 2) & (shouts * SHOUT_WORDS >= words))
        | fragment(line)
    )


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``quality``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    clean_text (the lines that pass, joined as they were) and kept.

    kept is false for texts under 50 words or with over half of their words in repeated 3-word windows, and for
    those that lose over half of their words with the lines that fail. A null text counts as empty (no words, not
    kept, clean_text empty). Rows are judged one by one, so repeated rows and ties need no rule; other columns stay
    as they are, also if they are called like a field of the struct; an empty table gives an empty result. A
    column called ``quality`` is replaced.

    Everything runs in arrays of the row itself: nothing is exploded or shuffled, and the longest text bounds the
    memory. Windows are told apart by 64-bit hashes; only texts with an equal pair are sorted to find the places.
    """
    whole = "__quality_"
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumns({
        whole + "text": body,
        whole + "words": F.when(F.btrim(body, F.lit(" \t\n\x0b\x0c\r")) == "", F.array().cast("array<string>"))
        .otherwise(F.split(F.btrim(body, F.lit(" \t\n\x0b\x0c\r")), f"[{SPACE}]+")),
        whole + "lines": F.split(body, "\n"),
    })
    words, lines = F.col(whole + "words"), F.col(whole + "lines")
    n = F.size(words)
    step = step.withColumns({
        whole + "windows": F.when(
            n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        ).otherwise(F.array().cast("array<bigint>")),
        whole + "said": F.filter(lines, lambda x: x.rlike(WORD)),
        whole + "clean": F.when(F.col(whole + "text").rlike(MARKED), F.filter(lines, lambda x: ~line_fails(x)))
        .otherwise(F.filter(lines, lambda x: ~fragment(x))),
        whole + "n_lines": F.size(lines),
    })
    windows = F.col(whole + "windows")
    step = step.withColumn(
        whole + "sorted",
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    ordered = F.col(whole + "sorted")
    step = step.withColumn(
        whole + "places",
        F.sort_array(F.array_compact(F.transform(
            ordered,
            lambda x, i: F.when(
                ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])) | (F.get(ordered, i + 1)["h"] == x["h"]), x["i"]
            ),
        ))),
    )
    places = F.col(whole + "places")
    covered = F.aggregate(
        F.transform(places, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x
    )
    whole_lines = F.size(F.col(whole + "clean")) == F.col(whole + "n_lines")
    said, clean = F.col(whole + "said"), F.col(whole + "clean")
    step = step.withColumns({
        whole + "n": n.cast("long"),
        whole + "repeat": F.coalesce(covered, F.lit(0)).cast("long"),
        whole + "kept_text": F.when(whole_lines, F.col(whole + "text")).otherwise(F.array_join(clean, "\n")),
        whole + "whole": whole_lines,
    })
    total, repeat, kept_text = F.col(whole + "n"), F.col(whole + "repeat"), F.col(whole + "kept_text")
    failed = (total < MIN_WORDS) | (repeat * 100 > total * MAX_REPEAT_PERCENT)
    verdict = F.struct(
        total.alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col(whole + "text"), F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size(said) - F.size(F.array_distinct(said))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
        kept_text.alias("clean_text"),
        (~failed & (F.col(whole + "whole") | (F.regexp_count(kept_text, F.lit(WORD)) * 100 >= total * MIN_KEPT_PERCENT))).alias("kept"),
    )
    # one row from one: a filter on the verdict stays above this step instead of repeating all of it below
    return step.select(*(c for c in docs.columns if c != "quality"), F.explode(F.array(verdict)).alias("quality"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col("quality")[f].alias(f) for f in fields))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_quoted(pattern)}))"


#: DuckDB: words and lines are unnested and grouped, not worked on in place.
OP7_SQL = f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents),
told AS (
  SELECT *, {_count('line', WORD)} AS w, {_count('line', SEPARATOR)} AS nav, {_count('line', NOISE)} AS noise,
         {_count('line', SHOUT)} AS shout, regexp_matches(line, {_quoted(ENDED)}) AS ended,
         regexp_matches(line, {_quoted(BOILERPLATE)}) AS boiler FROM line),
line_sums AS (
  SELECT doc_id, count(*) FILTER (w > 0) - count(DISTINCT CASE WHEN w > 0 THEN line END) AS n_dup_lines,
         coalesce(sum(w) FILTER (NOT (nav >= 2 AND nav * {NAVIGATION_WORDS} >= w
           OR noise >= 2 AND noise * {NOISE_WORDS} >= w OR shout >= 2 AND shout * {SHOUT_WORDS} >= w
           OR w < {UNENDED_WORDS} AND NOT ended OR w < {BOILERPLATE_WORDS} AND boiler)), 0) AS clean_words
  FROM told GROUP BY doc_id),
word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(WORD)}) AS ws FROM documents WHERE text IS NOT NULL)),
run AS (
  SELECT doc_id, pos, word, lead(word) OVER w AS second, lead(word, 2) OVER w AS third FROM word
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
again AS (
  SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n FROM run WHERE third IS NOT NULL)
  WHERE n > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
word_sums AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM word GROUP BY doc_id),
base AS (
  SELECT d.doc_id, coalesce(s.n, 0) AS n_words, coalesce(s.chars, 0) AS word_chars,
         {_count("coalesce(d.text, '')", SYMBOL)} AS n_symbols, l.n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, l.clean_words
  FROM documents d LEFT JOIN word_sums s USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN line_sums l USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND clean_words * 100 >= n_words * {MIN_KEPT_PERCENT} AS kept
FROM base"""
