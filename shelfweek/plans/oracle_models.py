"""DuckDB statements of the fitted models: recursive tables that repeat an algorithm step by step on small groups."""

from __future__ import annotations

from shelfweek.operators.kmeans import CHAINS, SAMPLES
from shelfweek.plans.oracle_tables import SEG_ROWS, TABLES


def _square(a: str, b: str, dims: int) -> str:
    return " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, dims + 1))


def kmeans_tables(name: str, rows: str, features: tuple[str, ...], problems: str, kmax: int) -> None:
    """Adds ``{name}_points`` and ``{name}_best`` (cat_key, k, wss, centres).

    ``rows`` is a table with cat_key, link_line and the features, ``problems`` a select of (cat_key, k). Starts are four
    farthest-first chains and the samples by hash; every start runs until its labels stay the same.
    """
    dims = len(features)
    x = ", ".join(f"COALESCE(CAST({f} AS DOUBLE), 0)" for f in features)
    mean = ", ".join(f"AVG(x[{i}])" for i in range(1, dims + 1))
    centre = ", ".join(f"list_avg(list_transform(list_filter(cells, lambda c: c.l = j), lambda c: c.x[{i}]))" for i in range(1, dims + 1))
    numbers = ", ".join(str(n) for n in SAMPLES)
    TABLES[f"{name}_points"] = f"""
SELECT cat_key, link_line AS ident, [{x}] AS x, CAST('0x' || substr(md5(link_line), 1, 15) AS BIGINT) AS h FROM {rows}"""
    TABLES[f"{name}_chains"] = f"""
WITH RECURSIVE middle AS (SELECT cat_key, [{mean}] AS m FROM {name}_points GROUP BY 1),
ends AS (
  SELECT cat_key, [list(x ORDER BY off, ident)[1], list(x ORDER BY off DESC, ident DESC)[1],
    list(x ORDER BY x[1], ident)[1], list(x ORDER BY x[1] DESC, ident DESC)[1]] AS e
  FROM (SELECT p.*, {_square('p.x', 'm', dims)} AS off FROM {name}_points p JOIN middle USING (cat_key)) GROUP BY 1),
chains AS (
  SELECT cat_key, CAST(s AS BIGINT) AS start, [e[s + 1]] AS chain FROM ends, range({CHAINS}) r(s)
  UNION ALL
  SELECT cat_key, start, list_append(any_value(chain), list(x ORDER BY near DESC, ident DESC)[1])
  FROM (SELECT c.cat_key, c.start, c.chain, p.x, p.ident, list_min(list_transform(c.chain, lambda q: {_square('p.x', 'q', dims)})) AS near
        FROM chains c JOIN {name}_points p USING (cat_key) WHERE len(c.chain) < {kmax})
  GROUP BY cat_key, start),
drawn AS (
  SELECT cat_key, {CHAINS} + s AS start, list(x ORDER BY xor(h, number), ident) AS xs
  FROM {name}_points, (SELECT generate_subscripts(n, 1) - 1 AS s, unnest(n) AS number FROM (SELECT [{numbers}] AS n)) GROUP BY 1, 2)
SELECT cat_key, start, chain FROM chains WHERE len(chain) = {kmax}
UNION ALL
SELECT cat_key, start, list_transform(range({kmax}), lambda i: xs[1 + i % len(xs)]) FROM drawn"""
    TABLES[f"{name}_ends"] = f"""
WITH RECURSIVE turns AS (
  SELECT cat_key, CAST(k AS BIGINT) AS k, start, 0 AS turn, chain[1:k] AS centres, '' AS labels FROM {name}_chains JOIN ({problems}) USING (cat_key)
  UNION ALL
  SELECT cat_key, k, start, turn + 1,
    list_transform(range(1, k + 1), lambda j: CASE WHEN len(list_filter(cells, lambda c: c.l = j)) = 0 THEN centres[j] ELSE [{centre}] END), now
  FROM (
    SELECT cat_key, k, start, turn, any_value(centres) AS centres, any_value(labels) AS labels,
      list({{'l': l, 'x': x}}) AS cells, string_agg(l, ',' ORDER BY ident) AS now
    FROM (SELECT *, list_position(d, list_min(d)) AS l FROM (
      SELECT t.*, p.x, p.ident, list_transform(t.centres, lambda q: {_square('p.x', 'q', dims)}) AS d
      FROM turns t JOIN {name}_points p USING (cat_key)))
    GROUP BY cat_key, k, start, turn)
  WHERE now <> labels AND turn < 500)
SELECT cat_key, k, start, list(centres ORDER BY turn DESC)[1] AS centres FROM turns GROUP BY 1, 2, 3"""
    TABLES[f"{name}_best"] = f"""
SELECT cat_key, k, list(wss ORDER BY round(wss, 9), start)[1] AS wss, list(centres ORDER BY round(wss, 9), start)[1] AS centres
FROM (SELECT cat_key, k, start, any_value(centres) AS centres, SUM(list_min(list_transform(centres, lambda q: {_square('x', 'q', dims)}))) AS wss
      FROM {name}_ends JOIN {name}_points USING (cat_key) GROUP BY 1, 2, 3)
GROUP BY 1, 2"""


def kmeans_labels(name: str, dims: int) -> str:
    return f"""SELECT cat_key, ident AS link_line, list_position(d, list_min(d)) AS cluster_number
    FROM (SELECT p.cat_key, p.ident, list_transform(b.centres, lambda q: {_square('p.x', 'q', dims)}) AS d
          FROM {name}_points p JOIN {name}_best b USING (cat_key))"""


def _every(k: str, rows: str) -> str:
    return f"SELECT cat_key, {k} AS k FROM {rows} GROUP BY 1"


_three = ("sales", "price", "checkout_rate")
_scaled = ", ".join(
    f"CASE WHEN MIN({c}) OVER w < MAX({c}) OVER w THEN (CAST({c} AS DOUBLE) - AVG(CAST({c} AS DOUBLE)) OVER w) / stddev_samp(CAST({c} AS DOUBLE)) OVER w END AS {c}"
    for c in _three
)
TABLES["scaled_three"] = f"""
SELECT cat_key, link_line, {_scaled} FROM seg
WHERE cat_key IN (SELECT cat_key FROM seg GROUP BY 1 HAVING COUNT(*) >= {SEG_ROWS}) WINDOW w AS (PARTITION BY cat_key)"""
kmeans_tables("elbows", "scaled", ("sales", "price"), f"SELECT * FROM ({_every('0', 'scaled')}) CROSS JOIN range(1, 11) r(n)".replace("SELECT *", "SELECT cat_key, n AS k"), 10)
kmeans_tables("fours", "scaled_three", _three, _every("4", "scaled_three"), 4)
kmeans_tables("threes", "scaled", ("sales", "price"), _every("3", "scaled"), 3)
_left = "CASE WHEN least(COUNT(sales), 1) + least(COUNT(price), 1) < 2 THEN 2 ELSE 3 END"
kmeans_tables("usual", "scaled", ("sales", "price"), _every(_left, "scaled"), 3)


# ---- medoids, silhouettes and sweeps ----


def medoid_tables(name: str, problems: str) -> None:
    """Adds ``{name}_medoids`` (cat_key, k, medoids): positions in ``medoid_rows`` after greedy building and best swaps."""
    TABLES[f"{name}_built"] = f"""
WITH RECURSIVE build AS (
  SELECT cat_key, CAST(k AS BIGINT) AS k, 0 AS step, CAST([] AS BIGINT[]) AS medoids FROM ({problems})
  UNION ALL
  SELECT cat_key, k, step + 1, list_append(any_value(medoids), list(a ORDER BY round(cost, 9), a)[1])
  FROM (
    SELECT cat_key, k, step, any_value(medoids) AS medoids, a, SUM(least(ds[a], near)) AS cost
    FROM (SELECT b.*, r.ds, unnest(range(1, len(r.ds) + 1)) AS a,
            COALESCE(list_min(list_transform(b.medoids, lambda m: r.ds[m])), CAST('inf' AS DOUBLE)) AS near
          FROM build b JOIN medoid_rows r USING (cat_key) WHERE b.step < least(b.k, len(r.ds)))
    GROUP BY cat_key, k, step, a)
  GROUP BY cat_key, k, step)
SELECT cat_key, k, list(medoids ORDER BY step DESC)[1] AS medoids FROM build GROUP BY 1, 2"""
    TABLES[f"{name}_medoids"] = f"""
WITH RECURSIVE swaps AS (
  SELECT cat_key, k, 0 AS turn, medoids FROM {name}_built
  UNION ALL
  SELECT cat_key, k, turn + 1, list_transform(range(1, len(medoids) + 1), lambda j: CASE WHEN j = best[2] THEN CAST(best[3] AS BIGINT) ELSE medoids[j] END)
  FROM (
    SELECT cat_key, k, turn, any_value(medoids) AS medoids, list([cost, place, a] ORDER BY round(cost, 9), place, a)[1] AS best
    FROM (
      SELECT cat_key, k, turn, any_value(medoids) AS medoids, place, a,
        SUM(CASE WHEN near = place THEN least(ds[a], d2) - d1 ELSE least(ds[a] - d1, 0) END) AS cost
      FROM (SELECT *, unnest(range(1, len(ds) + 1)) AS a FROM (
        SELECT *, unnest(range(1, len(medoids) + 1)) AS place FROM (
          SELECT *, list_min(dl) AS d1, list_position(dl, list_min(dl)) AS near,
            CASE WHEN len(dl) > 1 THEN list_sort(dl)[2] ELSE dl[1] END AS d2
          FROM (SELECT s.*, r.ds, list_transform(s.medoids, lambda m: r.ds[m]) AS dl
                FROM swaps s JOIN medoid_rows r USING (cat_key)))))
      GROUP BY cat_key, k, turn, place, a)
    GROUP BY cat_key, k, turn)
  WHERE round(best[1], 9) < -1e-9 AND turn < 500)
SELECT cat_key, k, list(medoids ORDER BY turn DESC)[1] AS medoids FROM swaps GROUP BY 1, 2"""


def medoid_labels(name: str) -> str:
    return f"""SELECT cat_key, k, ident AS link_line, list_position(dl, list_min(dl)) AS cluster_number
    FROM (SELECT m.cat_key, m.k, r.ident, list_transform(m.medoids, lambda m: r.ds[m]) AS dl FROM {name}_medoids m JOIN medoid_rows r USING (cat_key))"""


def quality_tables(name: str, labels: str) -> None:
    """Adds ``{name}_pairs``, ``{name}_widths`` and ``{name}_within`` of ``labels`` (cat_key, method, k, link_line, cluster_number)."""
    TABLES[f"{name}_labels"] = f"""
SELECT l.*, p.x FROM ({labels}) l JOIN usual_points p ON p.cat_key = l.cat_key AND p.ident = l.link_line"""
    TABLES[f"{name}_pairs"] = f"""
SELECT a.cat_key, a.method, a.k, a.link_line, a.cluster_number AS own, b.cluster_number AS other, sqrt({_square('a.x', 'b.x', 2)}) AS d
FROM {name}_labels a JOIN {name}_labels b ON a.cat_key = b.cat_key AND a.method = b.method AND a.k = b.k"""
    TABLES[f"{name}_widths"] = f"""
SELECT cat_key, method, k, link_line, own AS cluster_number,
  CASE WHEN MAX(n) FILTER (own = other) = 1 THEN 0
    ELSE COALESCE((MIN(total / n) FILTER (own <> other) - MAX(total / NULLIF(n - 1, 0)) FILTER (own = other))
      / NULLIF(greatest(MIN(total / n) FILTER (own <> other), MAX(total / NULLIF(n - 1, 0)) FILTER (own = other)), 0), 0) END AS silhouette_width
FROM (SELECT cat_key, method, k, link_line, own, other, SUM(d) AS total, COUNT(*) AS n FROM {name}_pairs GROUP BY ALL)
GROUP BY 1, 2, 3, 4, 5"""
    TABLES[f"{name}_within"] = f"""
SELECT cat_key, method, k, SUM(n * (var_pop_x + var_pop_y)) AS wss
FROM (SELECT cat_key, method, k, cluster_number, COUNT(*) AS n, var_pop(x[1]) AS var_pop_x, var_pop(x[2]) AS var_pop_y FROM {name}_labels GROUP BY 1, 2, 3, 4)
GROUP BY 1, 2, 3"""


def _off(c: str) -> str:
    return f"COALESCE((CAST({c} AS DOUBLE) - {c}_m) / NULLIF({c}_a, 0), 0)"


TABLES["medoid_points"] = f"""
SELECT cat_key, link_line AS ident, [{_off('sales')}, {_off('price')}] AS x
FROM (SELECT *, AVG(abs(sales - sales_m)) OVER w AS sales_a, AVG(abs(price - price_m)) OVER w AS price_a
      FROM (SELECT *, AVG(sales) OVER w AS sales_m, AVG(price) OVER w AS price_m FROM scaled WINDOW w AS (PARTITION BY cat_key))
      WINDOW w AS (PARTITION BY cat_key))"""
TABLES["medoid_rows"] = f"""
SELECT a.cat_key, a.ident, list(sqrt({_square('a.x', 'b.x', 2)}) ORDER BY b.ident) AS ds
FROM medoid_points a JOIN medoid_points b USING (cat_key) GROUP BY 1, 2"""
medoid_tables("pam", _every(_left, "scaled"))
MEDOIDS = f"SELECT cat_key, link_line, cluster_number FROM ({medoid_labels('pam')})"
quality_tables(
    "rival",
    f"SELECT cat_key, 'k-means' AS method, 0 AS k, link_line, cluster_number FROM ({kmeans_labels('usual', 2)}) "
    f"UNION ALL SELECT cat_key, 'pam', 0, link_line, cluster_number FROM ({medoid_labels('pam')})",
)
TABLES["winners"] = """
SELECT cat_key, CASE WHEN MAX(m) FILTER (method = 'k-means') > MAX(m) FILTER (method = 'pam') THEN 'k-means' ELSE 'pam' END AS method
FROM (SELECT cat_key, method, round(AVG(silhouette_width), 12) AS m FROM rival_widths GROUP BY 1, 2) GROUP BY 1"""
BEST = """SELECT s.*, r.cluster_number, r.silhouette_width, r.method AS type
FROM seg s JOIN rival_widths r ON r.cat_key = s.cat_key AND r.link_line = s.link_line
JOIN winners w ON w.cat_key = r.cat_key AND w.method = r.method"""

_sweep = "SELECT cat_key, n AS k FROM (SELECT DISTINCT cat_key FROM scaled) CROSS JOIN range(2, 7) r(n)"
kmeans_tables("sweep", "scaled", ("sales", "price"), _sweep, 6)
medoid_tables("sweeps", _sweep)
quality_tables(
    "swept",
    f"SELECT cat_key, 'k-means' AS method, k, ident AS link_line, list_position(d, list_min(d)) AS cluster_number "
    f"FROM (SELECT p.cat_key, b.k, p.ident, list_transform(b.centres, lambda q: {_square('p.x', 'q', 2)}) AS d "
    f"FROM sweep_points p JOIN sweep_best b USING (cat_key)) "
    f"UNION ALL SELECT cat_key, 'pam', k, link_line, cluster_number FROM ({medoid_labels('sweeps')})",
)
SWEEP = """SELECT w.cat_key, w.method, w.k, w.silhouette, d.dunn, i.wss
FROM (SELECT cat_key, method, k, AVG(silhouette_width) AS silhouette FROM swept_widths GROUP BY 1, 2, 3) w
JOIN (SELECT cat_key, method, k, MIN(d) FILTER (own <> other) / NULLIF(MAX(d) FILTER (own = other), 0) AS dunn FROM swept_pairs GROUP BY 1, 2, 3) d
  ON d.cat_key = w.cat_key AND d.method = w.method AND d.k = w.k
JOIN swept_within i ON i.cat_key = w.cat_key AND i.method = w.method AND i.k = w.k"""
