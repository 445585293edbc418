"""Price elasticity: regression data, least squares per key, results and coefficient cascade."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfweek.functions.linear import solve_centred, two_sided_p
from shelfweek.functions.order_stats import second_quartile_max
from shelfweek.session import materialise

# Columns whose missing values count as zero in the regression.
ZERO_FILL = (
    "md_discount", "growth_perc", "maturity_perc", "decline_perc", "pos_disc", "first_disc", "further_disc",
    "holiday", "inventory_ratio_lag",
)
MONTHS = tuple(range(2, 13))  # month 1 is the base level
REGRESSORS = (
    "md_discount", *[f"month_{m}" for m in MONTHS], "age_weeks", "pos_disc", "first_disc", "further_disc", "holiday",
)
TERMS = 7  # the month factor counts as one term in the outlier bound


def elasticity_prep(
    r: DataFrame,
    departments: Sequence[str] | None = None,
    cap: float = 0.99,
    frac: float = 0.75,
    key: str = "cluster_key",
) -> DataFrame:
    """Zero-fill, log target, units capped per key and the first ``frac`` of weeks marked ``train``.

    The log target uses uncapped units; the cap reaches only error measures and average sales. A key
    has one row per fiscal week, so its exact percentile and its window are bounded.
    """
    if departments is not None:
        r = r.filter(F.col("dept_desc").isin(list(departments)))
    limit = r.groupBy(key).agg(F.percentile("gross_sales_units", F.lit(cap)).alias("unit_cap"))
    weeks = Window.partitionBy(key)
    position = F.row_number().over(weeks.orderBy("weeks_since_launch", "fiscal_year", "fiscal_week"))
    units = F.col("gross_sales_units")
    return (
        r.fillna(0, subset=[c for c in ZERO_FILL if c in r.columns])
        .join(limit, key)
        .withColumns(
            {
                "log_units": F.log1p(units.cast("double")),
                "capped_units": F.least(units.cast("double"), F.col("unit_cap")),
                "train": position <= F.floor(F.count(F.lit(1)).over(weeks) * frac),
                **{f"month_{m}": (F.col("month_flag") == m).cast("double") for m in MONTHS},
            }
        )
        .drop("unit_cap")
    )


# ---- least squares by key -------------------------------------------------------------------------


def _rows(df: DataFrame, key: str, y: str, X: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    vector = F.array(*[F.col(c).cast("double") for c in X])
    return df.select(F.col(key), F.col(y).cast("double").alias("y"), vector.alias("x"), *extra).filter(
        F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull())
    )


def _summed(rows: DataFrame, key: str, values: Column) -> DataFrame:
    """Element-wise sums of an array column per key: ``key``, n, ``sums``.

    Elements are summed as (key, position) rows, which partial aggregation folds before the shuffle; one
    aggregate with hundreds of columns would outgrow generated code.
    """
    return (
        rows.select(key, F.posexplode(values).alias("pos", "v"))
        .groupBy(key, "pos")
        .agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
        .groupBy(key)
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("pairs"))
        .select(key, "n", F.col("pairs.v").alias("sums"))
    )


def _moments(rows: DataFrame, key: str, p: int) -> DataFrame:
    """n, means and centred cross-products (upper triangle, target last) per key, in two passes."""
    z = F.concat("x", F.array("y"))
    mean = _summed(rows, key, z).select(
        key, "n", F.transform("sums", lambda s: s / F.col("n")).alias("means")
    )
    centred = rows.join(mean, key).select(key, F.zip_with(z, "means", lambda a, m: a - m).alias("d"))
    products = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(p)),
            lambda i: F.transform(F.slice("d", i + 1, p + 1 - i), lambda v: v * F.get("d", i)),
        )
    )
    cross = _summed(centred, key, products).select(key, F.col("sums").alias("cross"))
    return mean.join(cross, key)


def _solve(moments: DataFrame, key: str, p: int) -> DataFrame:
    """Solve every key's normal equations: one input row per model, Arrow batches of models."""
    key_type = moments.schema[key].dataType.simpleString()
    fields = {
        key: key_type, "n": "bigint", "rank": "int", "intercept": "double", "beta": "array<double>",
        "se": "array<double>", "intercept_se": "double", "vif": "array<double>", "kept": "array<boolean>",
        "inverse": "array<double>", "mx": "array<double>", "sigma2": "double", "rsq": "double",
        "adj_rsq": "double", "status": "string",
    }
    upper = np.triu_indices(p + 1)

    def model(name, n: int, means: np.ndarray, packed: np.ndarray) -> dict:
        full = np.zeros((p + 1, p + 1))
        full[upper] = packed
        full = full + full.T - np.diag(np.diag(full))
        cross, xy, yy = full[:p, :p], full[:p, p], full[p, p]
        mx, my = means[:p], means[p]
        beta, inverse, kept = solve_centred(cross, xy)
        rank = len(kept) + 1
        rss = max(float(yy - beta @ xy), 0.0)
        free = n - rank
        s2 = rss / free if free > 0 else float("nan")
        rsq = 1 - rss / yy if yy > 0 else float("nan")
        return {
            key: name, "n": n, "rank": rank, "intercept": float(my - beta @ mx), "beta": beta.tolist(),
            "se": np.sqrt(s2 * np.diag(inverse)).tolist(),
            "intercept_se": float(np.sqrt(s2 * (1 / n + mx @ inverse @ mx))),
            "vif": (np.diag(inverse) * np.diag(cross)).tolist(),
            "kept": np.isin(np.arange(p), kept).tolist(), "inverse": inverse.ravel().tolist(), "mx": mx.tolist(),
            "sigma2": s2, "rsq": rsq,
            "adj_rsq": 1 - (1 - rsq) * (n - 1) / free if free > 0 else float("nan"),
            "status": "ok" if free > 0 else "no residual degrees of freedom",
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                model(k, int(n), np.asarray(m, float), np.asarray(c, float))
                for k, n, m, c in zip(batch[key], batch["n"], batch["means"], batch["cross"])
            ]
            yield pd.DataFrame(rows, columns=list(fields))

    return moments.mapInPandas(run, ", ".join(f"{name} {kind}" for name, kind in fields.items()))


def _predict(x: Column) -> Column:
    return F.col("intercept") + F.aggregate(
        F.zip_with(x, "beta", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
    )


def drop_influential(rows: DataFrame, fit: DataFrame, key: str, p: int, terms: int) -> DataFrame:
    """Rows whose Cook's distance is at most 4 / (n - terms - 1); undefined distances are kept."""

    @F.pandas_udf("double")
    def quadratic(d: pd.Series, inverse: pd.Series) -> pd.Series:
        if d.empty:
            return pd.Series([], dtype=float)
        rows = np.stack(d.to_numpy())
        matrices = np.stack(inverse.to_numpy()).reshape(-1, p, p)
        return pd.Series(np.einsum("ni,nij,nj->n", rows, matrices, rows))

    centred = F.zip_with("x", "mx", lambda a, b: a - b)
    leverage = F.lit(1.0) / F.col("n") + F.col("q")
    distance = F.try_divide(
        F.col("e") * F.col("e") * F.col("h"),
        F.col("rank") * F.col("sigma2") * (1 - F.col("h")) * (1 - F.col("h")),
    )
    bound = F.try_divide(F.lit(4.0), F.col("n") - terms - 1)
    return (
        rows.join(fit.select(key, "n", "rank", "intercept", "beta", "inverse", "mx", "sigma2"), key)
        .withColumn("q", quadratic(centred, "inverse"))
        .withColumns({"h": leverage, "e": F.col("y") - _predict(F.col("x"))})
        .filter(F.coalesce(F.isnan(distance) | ~(distance > bound), F.lit(True)))
        .select(*rows.columns)
    )


def _fit(rows: DataFrame, key: str, p: int, cook: bool, terms: int) -> tuple[DataFrame, DataFrame]:
    """(model rows, rows used by the model)."""
    fit = _solve(_moments(rows, key, p), key, p)
    if cook:
        fit = materialise(fit, "first_models")
        rows = materialise(drop_influential(rows, fit, key, p, terms), "fit_rows")
        fit = _solve(_moments(rows, key, p), key, p)
    return materialise(fit, "models"), rows


def _long(fit: DataFrame, key: str, X: Sequence[str]) -> DataFrame:
    """One row per coefficient; coefficients left out of the model are NULL, as aliased ones are."""
    p = len(X)

    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else two_sided_p(float(a), int(b)) for a, b in zip(t, df)])

    first = F.struct(
        F.lit("(Intercept)").alias("variable"), F.col("intercept").alias("estimate"),
        F.col("intercept_se").alias("std_error"), F.lit(None).cast("double").alias("vif"),
    )
    rest = [
        F.struct(
            F.lit(X[i]).alias("variable"),
            F.when(F.col("kept")[i], F.col("beta")[i]).alias("estimate"),
            F.when(F.col("kept")[i], F.col("se")[i]).alias("std_error"),
            F.when(F.col("kept")[i], F.col("vif")[i]).alias("vif"),
        )
        for i in range(p)
    ]
    return (
        fit.withColumn("c", F.explode(F.array(first, *rest)))
        .select(key, "n", "rank", "c.variable", "c.estimate", "c.std_error", "rsq", "adj_rsq", "c.vif", "status")
        .withColumn("t", F.try_divide("estimate", "std_error"))
        .withColumn("p", p_value("t", F.col("n") - F.col("rank")))
        .select(
            key, "variable", "estimate", "std_error", "t", "p", "adj_rsq", "rsq", "vif", "n", "status"
        )
    )


def ols_by_key(
    df: DataFrame, key: str, y: str, X: Sequence[str], cook: bool = True, terms: int | None = None
) -> DataFrame:
    """Least squares for every key at once, optionally refitted without influential rows.

    Returns key, variable, estimate, std_error, t, p, adj_rsq, rsq, vif, n and status.
    """
    rows = materialise(_rows(df, key, y, X), "ols_rows")
    fit, _ = _fit(rows, key, len(X), cook, len(X) if terms is None else terms)
    return _long(fit, key, X)


def _mape(rows: DataFrame, fit: DataFrame, key: str, name: str) -> DataFrame:
    """Mean absolute error share over weeks above 10 units, in the reference's form and corrected."""
    units, pred = F.col("capped_units"), F.exp(_predict(F.col("x")))
    return (
        rows.filter(units > 10)
        .join(fit.select(key, "intercept", "beta"), key)
        .groupBy(key)
        .agg(
            F.avg(F.abs(pred - units + 1) / units).alias(name),
            F.avg(F.abs(pred - units - 1) / units).alias(f"{name}_minus"),
        )
    )


def elasticity_results(
    prepped: DataFrame, key: str = "cluster_key", X: Sequence[str] = REGRESSORS, terms: int = TERMS
) -> tuple[DataFrame, DataFrame]:
    """(results, coefficients): long coefficient table with errors, wide table with sales measures."""
    data = materialise(_rows(prepped, key, "log_units", X, ("capped_units", "train", "md_discount")), "elasticity")
    fit, used = _fit(data.filter("train"), key, len(X), True, terms)
    long = _long(fit, key, X)
    results = long.join(_mape(used, fit, key, "insample_mape"), key, "left").join(
        _mape(data.filter("NOT train"), fit, key, "outsample_mape"), key, "left"
    )
    sales = data.groupBy(key).agg(
        F.avg("capped_units").alias("avg_sales"),
        F.count_if(F.col("capped_units") > 0).alias("positive_sales"),
        F.corr("y", "md_discount").alias("correlation"),
    )
    wide = long.groupBy(key).pivot("variable", ["(Intercept)", *X]).agg(F.first("estimate")).join(sales, key)
    return results, wide.withColumnRenamed("(Intercept)", "intercept")


# ---- cascade ------------------------------------------------------------------------------------


def reassign_coefficients(
    coefs: DataFrame,
    lo: float = 0.005,
    hi: float = 0.05,
    kinds: Sequence[str] = ("pos", "first", "further"),
) -> DataFrame:
    """Own coefficient if within [lo, hi], else the category's average valid one, else the
    department's second-quartile maximum of valid ones, else -1."""
    df = coefs
    for kind in kinds:
        raw = f"{kind}_pe"
        valid = coefs.filter(F.col(raw).between(lo, hi))
        category = valid.groupBy("cat_key").agg(F.avg(raw).alias(f"cat_{kind}"))
        department = second_quartile_max(valid, ["dept_key"], raw, f"dept_{kind}")
        df = df.join(category, "cat_key", "left").join(department, "dept_key", "left")
        final = F.lit(None).cast("double")
        pick = F.when(F.col(raw).between(lo, hi), F.col(raw))
        for fallback in (f"cat_{kind}", f"dept_{kind}"):
            pick = pick.when(F.col(fallback).between(lo, hi), F.col(fallback))
        df = df.withColumn(f"final_co_eff_{kind}", F.coalesce(pick, final, F.lit(-1.0)))
    return df.select("cat_key", "cluster_key", *[f"final_co_eff_{k}" for k in kinds])
