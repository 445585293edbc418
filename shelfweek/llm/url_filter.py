"""URL rules that reach aliases over redirect and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.llm.base import ascii_lower, table
from shelfweek.llm.components import components
from shelfweek.session import materialise

#: (action, host, path): fits the host and its subdomains where the path starts so.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical[\"'\s>/][^>]*>?"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh[\"'\s>/][^>]*>?"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a resource: host, path and query; the scheme and the fragment do not. Null without a host."""
    rest = F.regexp_extract(_rest(url), "^[^#]*", 0)
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.substring(rest, F.length(host) + 1, F.length(rest))))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. Of equal ones block wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("verdict")),
        )
        for action, h, p in ordered
    ]
    return F.coalesce(*fits)


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): a page's node and the node its canonical link or refresh redirect names (absolute or from the root)."""
    url, html = F.col("url"), F.col("html")
    goes = F.array(
        F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1),
        F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1),
    )
    found = pages.filter(html.rlike(CANONICAL) | html.rlike(REFRESH)).select(
        host_of(url).alias("host"), node_of(url).alias("a"), F.explode(goes).alias("to")
    )
    rooted = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).when(
        F.col("to").startswith("/"), F.concat(F.lit("http://"), "host", "to")
    ).otherwise(F.col("to"))
    return found.select("a", node_of(rooted).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, links: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``pages`` (url, html) with a struct ``judged``: host, path, rule (null if none fits), verdict.

    A rule's verdict stands. A url without a rule takes its verdict from its aliases, the resources that redirect
    and canonical links connect (from the pages' html, or ``links`` with nodes a and b): allow if an explicit allow
    rule fits any of them, else block if a block rule does, else ``default``. Linked resources need not be pages.

    A null url or one without ``://`` has empty host and path, no rule and the default. Null html has no links.
    Repeated rows and repeated urls get the same answer; an empty table gives none; other columns stay, a column
    called ``judged`` is replaced. ``rules`` is a short list kept in the plan.
    """
    edges = materialise((page_links(pages) if links is None else links).distinct(), "url_links")
    member = components(edges, "a", "b")
    as_url = F.concat(F.lit("http://"), F.col("node"))
    seeds = member.withColumn("fit", rule_for(host_of(as_url), path_of(as_url), rules))
    said = seeds.groupBy("root").agg(F.min("fit.verdict").alias("alias_verdict")).filter("alias_verdict IS NOT NULL")
    aliases = member.join(said, "root").select("node", "alias_verdict")  # 'allow' sorts before 'block'
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    whole = pages.withColumns({"__host": host, "__path": path, "__fit": rule_for(host, path, rules)})
    whole = whole.withColumn("__node", F.when(F.col("__fit").isNull(), node_of(F.col("url"))))
    joined = whole.join(aliases.select(F.col("node").alias("__node"), F.col("alias_verdict").alias("__alias")), "__node", "left")
    judged = F.struct(
        F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__fit.rule").alias("rule"),
        F.coalesce(F.col("__fit.verdict"), F.col("__alias"), F.lit(default)).alias("verdict"),
    )
    return joined.withColumn("judged", judged).select(*(c for c in pages.columns if c != "judged"), "judged")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_parts(url: str) -> str:
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"coalesce({host}, '') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract({rest}, '^[^/?#]*([^#]*)', 1) AS tail"


OP5_SQL = f"""
WITH RECURSIVE rules(action, rhost, rpath) AS (VALUES {', '.join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)}),
page AS (SELECT page_id, html, {_sql_parts('url')} FROM pages),
raw_link AS (
  SELECT host, host || tail AS a, unnest([
    regexp_extract(regexp_extract(html, {_sql_text(CANONICAL)}), {_sql_text(HREF)}, 1),
    regexp_extract(regexp_extract(html, {_sql_text(REFRESH)}), {_sql_text(TARGET)}, 1)]) AS goal FROM page WHERE host != ''),
target AS (
  SELECT a, CASE WHEN starts_with(goal, '//') THEN 'http:' || goal WHEN starts_with(goal, '/') THEN 'http://' || host || goal ELSE goal END AS url
  FROM raw_link),
link AS (SELECT DISTINCT a, host || tail AS b FROM (SELECT a, {_sql_parts('url')} FROM target) WHERE host != '' AND a != host || tail),
step AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM step UNION SELECT r.a, s.b FROM reach r JOIN step s ON r.b = s.a),
spot AS (SELECT DISTINCT b AS node, {_sql_parts("('http://' || b)")} FROM reach),
fit AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM page UNION SELECT DISTINCT host, path FROM spot), rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
alias AS (
  SELECT r.a AS node, min(f.action) AS action FROM reach r JOIN spot s ON s.node = r.b JOIN fit f USING (host, path) GROUP BY r.a)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, l.action, 'allow') AS verdict
FROM page p LEFT JOIN fit f USING (host, path) LEFT JOIN alias l ON l.node = p.host || p.tail"""
