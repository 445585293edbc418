"""Model operators against closed forms and brute force on small fixtures."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfweek.functions.linear import two_sided_p
from shelfweek.functions.order_stats import quantiles, second_quartile_max
from shelfweek.operators import baseline, elasticity, lifecycle, returns, segments, validate
from shelfweek.session import materialise


def test_adaptive_smoothing_known_series(spark):
    rows = [(1, 2000, i + 1, i + 1, 1, 1.0, float(v)) for i, v in enumerate([10, 12, 9, 14, 13])]
    df = spark.createDataFrame(
        rows, "merchandise_key int, fiscal_year int, fiscal_week int, period int, gross_sales_units int, "
        "product_ts double, s_r_forecast double",
    )
    out = {r.period: r for r in baseline.adaptive_smoothing(df).collect()}
    expected = [0, 10, 12, 11.0870, 11.8792]
    assert [round(out[i + 1].es_fcast, 4) for i in range(5)] == expected
    assert len(out) == 6 and out[6].s_r_forecast == 0 and out[6].fiscal_week == 5


def test_smoothing_keeps_its_steps_packed():
    series = pd.Series([np.arange(358.0) + i for i in range(300)])
    tracemalloc.start()
    found = baseline._trigg_leach(series, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 300 and peak < 120 * 300 * 358


def test_smoothing_of_more_series_than_one_batch(spark):
    n = baseline.SERIES_ROWS * 2 + 3
    rows = [(k, 2000, w, w, 1, float(k + w)) for k in range(n) for w in (1, 2, 3)]
    schema = "merchandise_key int, fiscal_year int, fiscal_week int, period int, gross_sales_units int, s_r_forecast double"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    out = baseline.adaptive_smoothing(df).collect()
    assert len(out) == 4 * n
    assert all(r.es_fcast == r.merchandise_key + 1 for r in out if r.period == 2)


def test_dense_series_start_without_a_shuffle_of_the_feature_table(spark):
    rows = [(k, k, "c", 2000, w, 1) for k in range(9) for w in (1, 3)]
    schema = "product_key int, merchandise_key int, cat_key string, fiscal_year int, fiscal_week int, gross_sales_units int"
    f = materialise(spark.createDataFrame(rows, schema), "few", bucket_by="product_key")
    cal = spark.createDataFrame([(2000, w) for w in (1, 2, 3)], "fiscal_year int, fiscal_week int")
    series = baseline.period_sales(cal, f, (2000, 3))
    smoothed = baseline.adaptive_smoothing(series.withColumn("s_r_forecast", F.col("gross_sales_units").cast("double")))
    plan = smoothed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(merchandise_key" not in plan
    assert smoothed.count() == 36


def test_seasonal_index_mean_one_and_short_series(spark):
    rows = [(2000 + t // 52, 1 + t % 52, t + 1, 1, "long", 100 + 40 * int(t % 52 < 26)) for t in range(156)]
    rows += [(2000 + t // 52, 1 + t % 52, t + 1, 2, "short", 5) for t in range(60)]
    df = spark.createDataFrame(
        rows, "fiscal_year int, fiscal_week int, period int, merchandise_key int, cat_key string, gross_sales_units int"
    )
    out = baseline.seasonal_index(df).collect()
    figure = {r.fiscal_week: r.product_ts for r in out if r.cat_key == "long"}
    assert abs(sum(figure.values()) / 52 - 1) < 1e-12
    assert abs(figure[1] / figure[40] - 1.4) < 1e-9
    assert {(r.product_ts, r.season_status) for r in out if r.cat_key == "short"} == {(1.0, "short")}


def test_baselines_of_some_periods_equal_those_of_all(spark):
    """Rows of single periods, early ones and missing ones too, without opening or framing the others."""
    draw = random.Random(4)
    rows = [(key, "c", 2000 + (p - 1) // 52, 1 + (p - 1) % 52, p, draw.choice([0, 0, 3, 7])) for key in range(5) for p in range(1 + key % 2, 61)]
    df = spark.createDataFrame(rows, "merchandise_key int, cat_key string, fiscal_year int, fiscal_week int, period int, gross_sales_units int")
    df = df.withColumn("s_r_forecast", F.col("gross_sales_units") / 2.0)
    at, n = [1, 2, 9, 30, 33, 60, 61], 13
    weeks = [(2000 + (p - 1) // 52, 1 + (p - 1) % 52) for p in at]
    smooth = baseline.adaptive_smoothing(df).filter(F.col("period") <= 60)
    some = baseline.adaptive_smoothing(df, at=at)
    assert some.columns == smooth.columns
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, smooth.filter(F.col("period").isin(at)).collect()))
    trailing = lambda f: sorted(map(str, f.collect()))
    whole = baseline.trailing_baselines(df, n)
    of = [r for r in whole.collect() if (r.fiscal_year, r.fiscal_week) in weeks]
    near = baseline.trailing_baselines(df, n, at=at)
    assert near.columns == whole.columns and trailing(near) == sorted(map(str, of)) and len(of) == 28


def test_seasonal_index_opens_the_series_once(spark):
    """Category weeks come from recorded weeks, equal to the sums of the dense series, which is opened for its rows only."""
    from shelfweek.plans.context import Context

    c = Context(spark, "/root/testdata/sf0.001")
    c.__dict__["features"] = Context.of(spark, c.sf_dir).features
    dense = baseline.category_weeks(c.series())
    sums = baseline.category_sales(c.cal, c.features, c.last_week)
    assert sorted(map(tuple, sums.select(*dense.columns).collect())) == sorted(map(tuple, dense.collect()))
    plan = c.seasoned()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_logistic_growth_recovers_parameters(spark):
    p1, p2, p3 = 0.9, 40.0, 8.0
    rows = [("a", t, p1 / (1 + math.exp((p2 - t) / p3))) for t in range(137)] + [("b", t, 1.0) for t in range(30)]
    df = spark.createDataFrame(rows, "cat_key string, age_in_weeks int, cst double")
    out = {r.cat_key: r for r in lifecycle.logistic_growth(df).collect()}
    a = out["a"]
    assert a.status == "ok" and abs(a.phi1 - p1) < 1e-6 and abs(a.phi2 - p2) < 1e-5 and abs(a.phi3 - p3) < 1e-5
    assert abs(a.infl1 - p2) <= 2 and abs(a.infl2 - (p2 + p3 * math.log(2 + math.sqrt(3)))) <= 2
    assert out["b"].status.startswith("failed")


def test_quadratic_stage(spark):
    n, x = 41, np.linspace(0, 1, 41)
    y = [0.2 + 0.4 * v - 0.5 * v * v for v in [*x[1:], 1.0]]
    df = spark.createDataFrame(
        [("a", i, float(x[i]), float(y[i])) for i in range(n)], "cat_key string, age_in_weeks int, cst double, check_out_rate double"
    )
    out = sorted(lifecycle.quadratic_stage(df).collect(), key=lambda r: r.age_in_weeks)
    # slope 0.4 - x: growth ends near x = .33, decline starts near .47
    for r in out:
        want = "D" if r.cst >= 0.4675 else "G" if r.cst <= 0.33 else "M"
        assert r.stage == want, (r.cst, r.stage)


# ---- order statistics ----


def test_quantiles_and_quartile_against_numpy(spark):
    rng = random.Random(3)
    data = {"hot": [rng.choice([1.0, 2.0, rng.random() * 100]) for _ in range(3000)], "tiny": [5.0], "two": [3.0, 1.0],
            "ties": [4.0] * 50}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("hot", None)] * 7 + [("two", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.prob): r.quantile for r in quantiles(df, ["g"], ["v"], [0.01, 0.5, 0.99]).collect()}
    for g, vs in data.items():
        for p in (0.01, 0.5, 0.99):
            assert abs(got[g, p] - np.quantile(vs, p)) < 1e-9
    mid = {r.g: r.m for r in second_quartile_max(df, ["g"], "v", "m").collect()}
    for g in data:
        values = sorted([v for k, v in rows if k == g], key=lambda v: (v is not None, v or 0))
        n = len(values)
        sizes = [n // 4 + (i < n % 4) for i in range(4)]
        bucket = [v for v in values[sizes[0] : sizes[0] + sizes[1]] if v is not None]
        if sizes[1] == 0:
            assert g not in mid
        else:
            assert mid[g] == (max(bucket) if bucket else None)


# ---- clustering ----


def cloud(n_groups=2, n=24, seed=5):
    rng = random.Random(seed)
    rows = []
    for g in range(n_groups):
        for i in range(n):
            cx = [0, 8, 16][i % 3]
            rows.append((f"g{g}", f"p{i:03d}", cx + rng.random(), (cx * 7) % 5 + rng.random()))
    return rows


SCHEMA = "cat_key string, link_line string, sales double, price double"


def partition(rows, label):
    groups = {}
    for r in rows:
        groups.setdefault((r.cat_key, r[label]), set()).add(r.link_line)
    return sorted((k[0], tuple(sorted(v))) for k, v in groups.items())


def test_kmeans_and_medoids_find_clouds(spark):
    df = spark.createDataFrame(cloud(), SCHEMA)
    want = sorted((f"g{g}", tuple(f"p{i:03d}" for i in range(c, 24, 3))) for g in range(2) for c in range(3))
    assert partition(segments.kmeans_by_group(df).collect(), "cluster_number") == want
    assert partition(segments.kmedoids_by_group(df).collect(), "cluster_number") == want
    best = segments.best_segmentation(df).collect()
    assert len(best) == 48 and {r.type for r in best} == {"pam"}  # equal silhouettes go to the medoids


def brute_pam(x, k):
    """Cheapest medoid set by exhaustive search."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return min(d[list(c)].min(0).sum() for c in itertools.combinations(range(len(x)), k))


@pytest.mark.parametrize("block", [4, 2048])
def test_medoid_cost_is_near_optimal_and_paths_agree(spark, block):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(18, 2))
    df = spark.createDataFrame([("g", f"p{i:02d}", float(a), float(b)) for i, (a, b) in enumerate(x)], SCHEMA)
    out = segments.kmedoids_by_group(df, k=3, block=block).collect()
    z = (x - x.mean(0)) / np.abs(x - x.mean(0)).mean(0)
    labels = {r.link_line: r.cluster_number for r in out}
    cost = 0.0
    for c in set(labels.values()):
        members = z[[i for i in range(18) if labels[f"p{i:02d}"] == c]]
        d = np.sqrt(((members[:, None] - members[None]) ** 2).sum(-1))
        cost += d.sum(1).min()
    assert cost <= brute_pam(z, 3) * 1.05
    if block == 4:
        other = segments.kmedoids_by_group(df, k=3, block=2048).collect()
        assert partition(out, "cluster_number") == partition(other, "cluster_number")


@pytest.mark.parametrize("block", [5, 2048])
def test_silhouette_and_sweep_brute_force(spark, block):
    rows = cloud(1, 21)
    labelled = [(*r, 1 + (i % 3) if i != 20 else 4) for i, r in enumerate(rows)]
    df = spark.createDataFrame(labelled, SCHEMA + ", cluster_number int")
    got = {r.link_line: r.silhouette_width for r in segments.silhouette_by_group(df, block=block).collect()}
    for r in labelled:
        dist = {}
        for s in labelled:
            if s[1] != r[1]:
                dist.setdefault(s[4], []).append(math.dist(r[2:4], s[2:4]))
        if r[4] not in dist:
            assert got[r[1]] == 0.0
            continue
        a, b = np.mean(dist[r[4]]), min(np.mean(v) for k, v in dist.items() if k != r[4])
        assert abs(got[r[1]] - (b - a) / max(a, b)) < 1e-9
    sweep = segments.cluster_sweep(spark.createDataFrame(rows, SCHEMA), ks=(2, 3), block=block).collect()
    assert {(r.method, r.k) for r in sweep} == {(m, k) for m in ("k-means", "pam") for k in (2, 3)}
    best = max(sweep, key=lambda r: r.silhouette)
    assert best.k == 3 and best.dunn > 1


def test_kmeans_matches_best_of_exhaustive_split(spark):
    x = [0.0, 0.5, 1.0, 4.0, 4.2, 9.0, 9.1, 9.9]
    df = spark.createDataFrame([("g", f"p{i}", v, 0.0) for i, v in enumerate(x)], SCHEMA)
    wss = {r.k: r.wss for r in segments.elbow(df, ks=(1, 2, 3)).collect()}

    def best(k):
        cuts = itertools.combinations(range(1, len(x)), k - 1)
        parts = [[x[a:b] for a, b in zip((0, *c), (*c, len(x)))] for c in cuts]
        return min(sum(np.var(p) * len(p) for p in split) for split in parts)

    for k in (1, 2, 3):
        assert abs(wss[k] - best(k)) < 1e-9


def test_constant_feature_is_dropped_and_uses_two_clusters(spark):
    rows = [("g", f"p{i:02d}", float(i % 2) * 10 + i * 0.01, 3.0) for i in range(20)]
    scaled = segments.prepared(spark.createDataFrame(rows, SCHEMA), fraction=None)
    assert {r.price for r in scaled.collect()} == {None}
    assert {r.cluster_number for r in segments.kmeans_by_group(scaled).collect()} == {1, 2}


def test_winsorize_rejects_bad_fraction_and_category_rank(spark):
    df = spark.createDataFrame(cloud(), SCHEMA)
    for bad in (-0.1, 0.6, [0.1, 0.2]):
        with pytest.raises(ValueError):
            segments.winsorize(df, ["cat_key"], ["sales"], bad)
    ranks = {r.cat_key: r["rank"] for r in segments.category_rank(df).collect()}
    assert ranks == {"g0": 1, "g1": 2}


# ---- least squares ----


def test_ols_matches_numpy_with_collinear_and_constant_columns(spark):
    rng = np.random.default_rng(2)
    rows, truth = [], {}
    for key in ("a", "b"):
        x = rng.normal(size=(60, 2))
        y = 1.5 + 2 * x[:, 0] - x[:, 1] + rng.normal(scale=0.3, size=60)
        design = np.column_stack([np.ones(60), x])
        beta = np.linalg.lstsq(design, y, rcond=None)[0]
        resid = y - design @ beta
        cov = resid @ resid / 57 * np.linalg.inv(design.T @ design)
        truth[key] = (beta, np.sqrt(np.diag(cov)))
        rows += [(key, float(v), float(p), float(q), float(2 * p), 7.0) for v, (p, q) in zip(y, x)]
    df = spark.createDataFrame(rows, "key string, y double, x1 double, x2 double, twice double, flat double")
    out = elasticity.ols_by_key(df, "key", "y", ["x1", "x2", "twice", "flat"], cook=False).collect()
    got = {(r.key, r.variable): r for r in out}
    for key, (beta, se) in truth.items():
        for name, b, s in zip(("(Intercept)", "x1", "x2"), beta, se):
            assert abs(got[key, name].estimate - b) < 1e-9 and abs(got[key, name].std_error - s) < 1e-9
        assert got[key, "twice"].estimate is None and got[key, "flat"].estimate is None
    r2 = np.corrcoef([r[2] for r in rows if r[0] == "a"], [r[3] for r in rows if r[0] == "a"])[0, 1] ** 2
    assert abs(got["a", "x1"].vif - 1 / (1 - r2)) < 1e-9


def test_cook_filter_drops_the_outlier(spark):
    rows = [("k", float(i), 2.0 * i + (-1) ** i * 0.1) for i in range(20)] + [("k", 30.0, -50.0)]
    df = spark.createDataFrame(rows, "key string, x double, y double")
    fit = {r.variable: r for r in elasticity.ols_by_key(df, "key", "y", ["x"]).collect()}
    assert fit["x"].n == 20 and abs(fit["x"].estimate - 2) < 0.01


def test_t_distribution():
    # Fixed values of two-sided tail probabilities of Student's t.
    for t, df, p in ((12.7062, 1, 0.05), (4.30265, 2, 0.05), (2.57058, 5, 0.05), (2.22814, 10, 0.05), (1.0, 1, 0.5), (0.0, 7, 1.0)):
        assert abs(two_sided_p(t, df) - p) < 1e-5


def test_elasticity_results_shape(spark):
    rng = np.random.default_rng(4)
    rows = []
    for w in range(80):
        disc = float(rng.uniform(0, 50))
        rows.append(("D", "D_1", 2000 + w // 52, 1 + w % 52, int(np.exp(3 + 0.02 * disc) + 5), disc, w + 1.0, 1 + w % 12, w + 1))
    df = spark.createDataFrame(
        rows, "dept_desc string, cluster_key string, fiscal_year int, fiscal_week int, gross_sales_units int, "
        "md_discount double, age_weeks double, month_flag int, weeks_since_launch int",
    )
    zero = {c: F.lit(0.0) for c in ("pos_disc", "first_disc", "further_disc", "holiday")}
    prepped = elasticity.elasticity_prep(df.withColumns(zero))
    assert prepped.filter("train").count() == 60
    results, wide = elasticity.elasticity_results(prepped)
    by = {r.variable: r for r in results.collect()}
    assert 0.01 < by["md_discount"].estimate < 0.03 and by["md_discount"].insample_mape is not None
    assert by["pos_disc"].estimate is None and wide.first().positive_sales == 80


def test_cascade_levels(spark):
    rows = [
        ("d", "c1", "1", 0.02), ("d", "c1", "2", 0.9), ("d", "c2", "1", 0.04), ("d", "c3", "1", 0.5), ("e", "c4", "1", None),
    ]
    df = spark.createDataFrame([(a, b, c, v, v, v) for a, b, c, v in rows],
                               "dept_key string, cat_key string, cluster_key string, pos_pe double, first_pe double, further_pe double")
    got = {(r.cat_key, r.cluster_key): r.final_co_eff_pos for r in elasticity.reassign_coefficients(df).collect()}
    # own; category average; own; department's second-quartile maximum; nothing valid
    assert got == {("c1", "1"): 0.02, ("c1", "2"): 0.02, ("c2", "1"): 0.04, ("c3", "1"): 0.04, ("c4", "1"): -1.0}


def test_error_buckets(spark):
    df = spark.createDataFrame([(v,) for v in (-0.6, -0.5, -0.3, 0.0, 0.3, 0.5, None)], "e double")
    assert [r[0] for r in df.select(validate.error_bucket("e")).collect()] == [-3, -2, -1, 1, 2, 3, 3]
    assert [r[0] for r in df.select(validate.error_bucket("e", 0)).collect()][-1] == 0


def tied_groups(spark, groups=4):
    """Small whole-number grids: many equal points and equal distances."""
    rng = np.random.default_rng(11)
    rows = [(f"g{g}", f"i{i:03d}", float(rng.integers(0, 4)), float(rng.integers(0, 5)), 0) for g in range(groups) for i in range(30 + 7 * g)]
    return spark.createDataFrame(rows, "cat_key string, link_line string, sales double, price double, cluster_number int")


def test_kmeans_blocks_equal_one_block(spark):
    """Groups cut into blocks and solved by turns give what one task gives, settled at its own end."""
    rng = np.random.default_rng(2)
    rows = [(f"g{g}", f"i{i:03d}", float(rng.normal(2 * (i % 3))), float(rng.normal(g))) for g in range(3) for i in range(60 + 25 * g)]
    df = spark.createDataFrame(rows, "cat_key string, link_line string, sales double, price double")
    whole, cut = ({(r.cat_key, r.k): r for r in segments.elbow(df, ks=(1, 2, 4), block=b).collect()} for b in (2048, 20))
    assert whole.keys() == cut.keys() and len(whole) == 9
    for key, row in whole.items():
        assert row.converged and cut[key].converged
        assert row.wss == pytest.approx(cut[key].wss, abs=1e-8)
    for block in (2048, 20):  # a run that is stopped says so
        assert not all(r.converged for r in segments.elbow(df, ks=(4,), iters=1, block=block).collect())
    one, many = ({(r.cat_key, r.link_line): r.cluster_number for r in segments.kmeans_by_group(df, block=b).collect()} for b in (2048, 20))
    assert one == many


def test_starts_of_blocks_equal_those_of_one_block(spark):
    """Blocks tell a few of their own points, ties between blocks included; an empty place of a small group stays short."""
    from shelfweek.operators import blocks, kmeans

    draw = np.random.default_rng(5)
    rows = [("a", i, [float(v) for v in draw.integers(0, 6, 2)]) for i in range(90)] + [("b", i, [float(i % 3), 1.0]) for i in range(9)]
    points = spark.createDataFrame(rows, "g string, ident long, x array<double>").repartition(5)
    packed = blocks.packed(points, ["g"], 8)
    assert packed.filter("g = 'a'").count() > 5
    problems = spark.createDataFrame([("a", 4), ("a", 1), ("b", 4)], "g string, k int")
    found = {(r.g, r.k, r.start): r.centres for r in kmeans._first_centres(packed, points, problems, ["g"], 2, 4).collect()}
    assert len(found) == 3 * kmeans.STARTS
    for g, k in (("a", 4), ("a", 1), ("b", 4)):
        row = blocks.packed(points.filter(F.col("g") == g), ["g"]).first()
        x, hashes = np.array([c["x"] for c in row["cells"]]), np.array([c["h"] for c in row["cells"]])
        assert [found[g, k, s] for s in range(kmeans.STARTS)] == kmeans._starts(x, hashes, k).tolist()


def test_a_turn_holds_no_points_by_problems_by_centres():
    from shelfweek.operators import kmeans

    draw = np.random.default_rng(6)
    x, centres = draw.normal(size=(2048, 2)), draw.normal(size=(20, 10, 2))
    tracemalloc.start()
    labels, n, sums, squares = kmeans._turn(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 8 * 2048 * 20 * 10 / 2
    every = ((x[None, :, None] - centres[:, None]) ** 2).sum(axis=3)
    assert (labels == every.argmin(axis=2)).all() and (n.sum(axis=1) == 2048).all()
    assert np.allclose(squares, every.min(axis=2).sum(axis=1)) and np.allclose(sums.sum(axis=1), x.sum(axis=0))


def test_compared_blocks_against_brute_force_with_ties(spark):
    from shelfweek.operators import blocks

    df = tied_groups(spark)
    rng = np.random.default_rng(4)
    data = [(r.cat_key, r.link_line, [r.sales, r.price], rng.integers(1, 4, 2).tolist()) for r in df.collect()]
    points = spark.createDataFrame(data, "cat_key string, ident string, x array<double>, labels array<int>")
    for block in (2048, 9):
        found = blocks.compared(points, ["cat_key"], 3, block).cache()
        widths = {(r.cat_key, r.which, r.ident): r.silhouette_width for r in blocks.silhouettes(found, ["cat_key"]).collect()}
        ratios = {(r.cat_key, r.which): r.dunn for r in blocks.dunn(found, ["cat_key"]).collect()}
        for group in {d[0] for d in data}:
            mine = [d for d in data if d[0] == group]
            x = np.array([d[2] for d in mine])
            dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
            for which in range(2):
                labels = np.array([d[3][which] for d in mine])
                same = labels[:, None] == labels[None]
                assert ratios[group, which] == pytest.approx(dist[~same].min() / dist[same].max())
                for i, d in enumerate(mine):
                    own = same[i].sum()
                    a = dist[i][same[i]].sum() / (own - 1) if own > 1 else 0
                    b = min(dist[i][labels == c].mean() for c in set(labels.tolist()) - {labels[i]})
                    want = 0 if own == 1 or max(a, b) == 0 else (b - a) / max(a, b)
                    assert widths[group, which, d[1]] == pytest.approx(want)


def test_medoids_of_all_k_share_one_matrix():
    """Solving several k from one matrix gives what each k gives alone, also where points and distances tie."""
    from shelfweek.operators.blocks import distances

    rng = np.random.default_rng(6)
    for _ in range(20):
        x = rng.integers(0, 4, (25, 2)).astype(float)
        dist = distances(x, x)
        assert segments._pam(dist, [1, 2, 3, 4], 500) == [segments._pam(dist, [k], 500)[0] for k in (1, 2, 3, 4)]


@pytest.mark.parametrize("block_rows", [4, 7, 4096])
def test_row_frames_over_blocks(spark, block_rows):
    """Frames over blocks equal one window: a hot group over many slices, a null group, slices of one row."""
    from shelfweek.functions.frames import row_frame_sums

    rng = np.random.default_rng(3)
    rows = [("hot", w, i, int(v)) for w in range(30) for i, v in enumerate(rng.integers(-5, 50, 1 + w % 9))]
    rows += [(None, w, 0, w) for w in range(11)] + [("one", 1, 1, None)]
    df = spark.createDataFrame(rows, "g string, week int, line int, v int").repartition(7)
    got = {(r.g, r.week, r.line): (r.past, r.upto) for r in row_frame_sums(df, ["g"], ["week"], ["line"], {"past": ("v", -4, -1), "upto": ("v", -2, 0)}, block_rows).collect()}
    assert len(got) == len(rows)
    for g in ("hot", None, "one"):
        own = sorted(r[1:] for r in rows if r[0] == g)
        for i, (week, line, _) in enumerate(own):
            total = lambda part: sum(known) if (known := [v for *_, v in part if v is not None]) else None
            assert got[g, week, line] == (total(own[max(i - 4, 0) : i]), total(own[max(i - 2, 0) : i + 1]))
    with pytest.raises(ValueError):
        row_frame_sums(df, ["g"], ["week"], ["line"], {"x": ("v", -1, 1)})


@pytest.mark.parametrize("grain, partition, n", [("category", None, 6), ("line", None, 13), ("line", "category", 4)])
def test_rates_of_one_week_equal_those_of_all_weeks(spark, grain, partition, n):
    draw = random.Random(n)
    rows = [
        (str(line % 3), line, *divmod(week, 100), draw.choice([199901, 199905, 0]), draw.randint(0, 9), draw.randint(0, 4))
        for line in range(9) for week in range(199901, 199931) if draw.random() < 0.4
    ]
    f = spark.createDataFrame(
        [(cat, cat, cat, *rest) for cat, *rest in rows],
        "dept_desc string, cat_key string, cat_desc string, line int, fiscal_year int, fiscal_week int, launch_date int, "
        "gross_sales_units int, net_sales_units int",
    )
    whole = returns.return_rate_ma(f, grain, n, shift=2, partition=partition)
    for week in (1, 3, 17, 29, 30, 40):
        one = returns.return_rate_ma(f, grain, n, shift=2, partition=partition, at=(1999, week)).collect()
        assert sorted(one) == sorted(whole.filter(f"fiscal_week = {week}").collect())
        assert one or week in (40,)


def test_week_coverage_counts_weeks(spark):
    from shelfweek.operators.quality import week_coverage

    rows = [("a", 2016, 1 + i % 3) for i in range(50)] + [("b", 2016, 1 + i) for i in range(16)] + [("c", None, 4), (None, 2016, 9)]
    df = spark.createDataFrame(rows, "cat_key string, fiscal_year int, fiscal_week int")
    assert {(r.check, r.key, r.value) for r in week_coverage(df, ["cat_key"], 16).collect()} == {("weeks<16", "a", 3), ("weeks<16", "c", 0), ("weeks<16", "", 1)}


@pytest.mark.parametrize("block_lines, shift", [(1, 2), (5, 0), (128, 2)])
def test_rates_over_lines_of_a_category_in_blocks(spark, monkeypatch, block_lines, shift):
    """Frames over packed lines equal the rows in order: categories of one, a few and many lines, an unknown department."""
    draw = random.Random(block_lines)
    sizes = {"a": 1, "b": 3, "c": 23}
    rows = [
        (None if cat == "b" else cat, cat, cat, f"{cat}{line:02}", *divmod(week, 100), 200003, draw.randint(0, 9), draw.randint(0, 4))
        for cat, size in sizes.items() for line in range(size) for week in range(200001, 200013) if draw.random() < 0.5 or week < 200003
    ]
    f = spark.createDataFrame(
        rows, "dept_desc string, cat_key string, cat_desc string, line string, fiscal_year int, fiscal_week int, launch_date int, "
        "gross_sales_units int, net_sales_units int",
    )
    monkeypatch.setattr(returns._rows_by_category, "__defaults__", (block_lines,))
    rates = returns.return_rate_ma(f, "line", 5, shift=shift, partition="category", partitions=3)
    plan = [x.lstrip(" +-") for x in rates._jdf.queryExecution().executedPlan().toString().splitlines()]
    plan = [x.split(" ")[0] for x in plan if not x.startswith(":")]  # without the subquery of weeks
    assert "Window" in plan and "Exchange" not in plan[: plan.index("Generate")]  # rows of line and week are not shuffled
    got = {(r.line, r.fiscal_week): r for r in rates.collect()}
    assert len(got) == sum(sizes.values()) * 10
    sold = {(r[3], r[5]): r[7:] for r in rows}
    for cat, size in sizes.items():
        own = [(f"{cat}{line:02}", week) for week in range(3, 13) for line in range(size)]
        back = lambda line, week: (lambda s: s[0] - s[1])(sold.get((line, week), (0, 0))) if week <= 12 else None
        values = [(back(line, week + shift), sold.get((line, week), (0, 0))[0]) for line, week in own]
        for k, key in enumerate(own):
            assert got[key].gross_sales == values[k][1] and got[key].return_units == back(*key)
            for name, part in (("ma_n_wk_rr", values[max(k - 5, 0) : k]), ("pred_rr", values[max(k - 4, 0) : k + 1])):
                known, gross = [v for v, _ in part if v is not None], sum(g for _, g in part)
                expected = None if not part else 0.0 if gross == 0 else sum(known) / gross if known else None
                assert getattr(got[key], name) == expected


@pytest.mark.parametrize("shift, carry", [(2, None), (0, None), (0, 3), (12, None)])
def test_rates_of_lines_are_differences_of_totals(spark, shift, carry):
    """Rates of a line equal the sums of its rows in order, and no window runs over rows of line and week. With a line of
    two products, one without sales, one without weeks, a late launch and an unknown department."""
    draw, n, last = random.Random(shift), 5, 12
    launches = {"a": 200001, "b": 200004, "c": 200012, "d": 200101}
    rows = [
        (None if cat == "b" else cat, cat, cat, f"{cat}{line}", *divmod(week, 100), launch, draw.randint(0, 9), draw.randint(0, 4))
        for cat, launch in launches.items() for line in range(3) for _ in range(1 + line) for week in range(200001, 200001 + last)
        if draw.random() < 0.4 or (cat, line) == ("a", 0)
    ]
    rows += [("a", "a", "a", "a9", None, None, 200001, None, None), ("a", "a", "a", "a0", None, 7, 200001, 9, 4), ("b", "b", "b", None, 2000, 1, 200004, 9, 4), (None, None, None, "x", 2000, 2, 200001, 1, 0)]
    rows += [("a", "a", "a", "a8", 2000, 3, 200001, None, None)]
    f = spark.createDataFrame(
        rows, "dept_desc string, cat_key string, cat_desc string, line string, fiscal_year int, fiscal_week int, launch_date int, "
        "gross_sales_units int, net_sales_units int",
    )
    rates = returns.return_rate_ma(f, "line", n, shift=shift, carry_shift=carry)
    plan = [x.lstrip(" +-") for x in rates._jdf.queryExecution().executedPlan().toString().splitlines()]
    plan = [x.split(" ")[0] for x in plan if not x.startswith(":")]
    assert "Window" not in plan[: plan.index("Generate")] and "Exchange" not in plan[: plan.index("Generate")]
    got = {(r.cat_key, r.line, r.fiscal_week): r for r in rates.collect()}
    lines = {(r[1], r[3], r[0]) for r in rows if r[1] and r[3]}
    sold = {}
    for dept, cat, _, line, year, week, _, gross, net in rows:
        if year and week:
            g, t = sold.get((cat, line, week), (0, 0))
            sold[cat, line, week] = (g + (gross or 0), t + (net or 0))
    weeks = lambda cat: range(launches[cat] - 200000, last + 1)
    assert set(got) == {(cat, line, week) for cat, line, _ in lines for week in weeks(cat)}
    moved = shift or carry
    for cat, line, dept in lines:
        back = lambda week: (lambda s: s[0] - s[1])(sold.get((cat, line, week), (0, 0))) if week <= last else None
        values = [(back(week + shift), sold.get((cat, line, week), (0, 0))[0]) for week in weeks(cat)]
        for k, week in enumerate(weeks(cat)):
            row = got[cat, line, week]
            assert (row.dept_desc, row.fiscal_year, row.min_ld) == (dept, 2000, launches[cat])
            assert (row.gross_sales, row.return_units) == (values[k][1], back(week))
            assert not moved or row.returns_post_2wk == back(week + moved)
            for name, part in (("ma_n_wk_rr", values[max(k - n, 0) : k]), ("pred_rr", values[max(k - n + 1, 0) : k + 1]), ("wkly_rr", values[k : k + 1])):
                known, gross = [v for v, _ in part if v is not None], sum(g for _, g in part)
                expected = None if not part else 0.0 if gross == 0 else sum(known) / gross if known else None
                assert getattr(row, name) == expected, (name, cat, line, week)


def test_pair_costs_of_all_k_against_whole_distances():
    """Both directions and all k come from one pass over a pair's distances."""
    from shelfweek.operators.blocks import distances

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(150, 2)), rng.normal(size=(70, 2))
    problems = [rng.normal(size=(k, 2)).tolist() for k in (2, 4)]
    cost_a, cost_b = segments._pair_costs(a, b, problems, True, True)
    for x, y, cost in ((a, b, cost_a), (b, a, cost_b)):
        want = []
        for medoids in problems:
            ds = distances(np.array(medoids), y)
            order = np.sort(ds, axis=0)
            want.append(segments._swap_cost(distances(x, y), order[0], order[1], ds.argmin(axis=0), len(medoids)))
        assert np.allclose(cost, np.hstack(want))
    built = segments._pair_costs(a, b, [[], problems[0]], False, True)
    assert np.allclose(built[0][:, 0], distances(a, b).sum(axis=1)) and built[1].shape == (70, 2)


def test_large_groups_keep_sums_and_medoids_packed(spark):
    """A pair of blocks gives one row a block, not one a point and cluster; medoids of all k are those of one matrix."""
    from shelfweek.operators import blocks

    rng = np.random.default_rng(9)
    data = [("g", f"p{i:02d}", x, [1 + i % 3, 1 + i % 2]) for i, x in enumerate(rng.integers(0, 6, (40, 2)).astype(float).tolist())]
    points = spark.createDataFrame(data, "cat_key string, ident string, x array<double>, labels array<int>")
    made = blocks.packed(points, ["cat_key"], 20).count()
    assert blocks.compared(points, ["cat_key"], 3, 20).count() == made * made
    problems = points.select("cat_key").distinct().withColumn("k", F.explode(F.array(F.lit(2), F.lit(3))))
    plain = points.select("cat_key", "ident", "x")
    small, large = (
        {r.k: [m.ident for m in r.medoids] for r in segments._medoids(plain, problems, ["cat_key"], 2, 3, 500, block).collect()}
        for block in (2048, 20)
    )
    assert small == large and sorted(small) == [2, 3]


def test_silhouettes_without_extremes_stay_the_same(spark):
    from shelfweek.operators import blocks

    df = tied_groups(spark)
    rng = np.random.default_rng(5)
    data = [(r.cat_key, r.link_line, [r.sales, r.price], rng.integers(1, 4, 2).tolist()) for r in df.collect()]
    points = spark.createDataFrame(data, "cat_key string, ident string, x array<double>, labels array<int>")
    for block in (2048, 9):
        whole, bare = (blocks.compared(points, ["cat_key"], 3, block, ends=ends).cache() for ends in (True, False))
        assert bare.count() == whole.count() and bare.filter("apart IS NOT NULL OR wide IS NOT NULL").isEmpty()
        widths = [{(r.cat_key, r.which, r.ident, r.own): r.silhouette_width for r in blocks.silhouettes(f, ["cat_key"]).collect()} for f in (whole, bare)]
        assert widths[0].keys() == widths[1].keys() and all(abs(widths[1][k] - v) < 1e-12 for k, v in widths[0].items())
