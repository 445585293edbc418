"""Segmentation within categories: features, scaling, k-means, medoids, silhouette and sweeps.

Every operator works on all groups at once. Centroids and medoids are small tables (a few rows per
group) joined to the points; distances between points are needed only as sums, minima or maxima and
are computed block against block: a group is cut into blocks of bounded size by a hash of the point,
each pair of blocks is one Spark group, and only per-point partial results leave a task. A group of
any size is thus spread over many tasks, nothing is sampled or capped, and no pair rows are emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfweek.functions.numeric import exact_avg, fixed_avg, link_line, ratio, trunc_avg
from shelfweek.functions.order_stats import quantiles
from shelfweek.functions.weeks import packed_week, packed_year
from shelfweek.operators.blocks import BLOCK, PAIR_ROWS, compared, distances, dunn, matrix, packed, pairs, rows, silhouettes
from shelfweek.operators.kmeans import best_centres, square
from shelfweek.session import checkpointed, materialise


def segmentation_features(
    f: DataFrame, items_cda: DataFrame, as_of: tuple[int, int] = (2016, 37), location: str = "AA"
) -> DataFrame:
    """Per (category, pricing group): units, average price, check-out rate and age, category rank."""
    year, week = as_of
    total = F.col("inventory") + F.col("net_sales_units")
    launch = F.col("launch_date")
    products = (
        f.filter(F.col("merchandise_key").isNotNull() & (total != 0))
        .groupBy("cat_key", "merchandise_key")
        .agg(
            F.sum("gross_sales_units").alias("sales"),
            exact_avg("regular_price").alias("price"),
            fixed_avg(ratio("gross_sales_units", total)).alias("checkout_rate"),
            ((year - F.max(packed_year(launch))) * 52 + (week - F.max(packed_week(launch)))).alias("age_weeks"),
        )
        .filter(F.col("age_weeks") > 0)
    )
    groups = items_cda.filter(F.col("location_key") == location).select(
        "merchandise_key", link_line("attribute1", "merchandise_key").alias("link_line")
    )
    out = (
        products.join(groups, "merchandise_key")
        .groupBy("cat_key", "link_line")
        .agg(
            F.sum("sales").alias("sales"),
            fixed_avg("price").alias("price"),
            fixed_avg("checkout_rate").alias("checkout_rate"),
            trunc_avg("age_weeks").alias("age_weeks"),
        )
    )
    return out.join(category_rank(out), "cat_key").select(
        "cat_key", "link_line", "rank", "sales", "price", "checkout_rate", "age_weeks"
    )


def category_rank(df: DataFrame, key: str = "cat_key") -> DataFrame:
    """Dense rank of the distinct keys over the whole table, without a one-task window.

    Sorted keys are numbered inside their range partition and shifted by the sizes of the partitions
    before. The sorted list is checkpointed, so both passes see the same partitions; the offsets are
    one row per partition.
    """
    spark = df.sparkSession
    ordered = checkpointed(df.select(key).distinct().orderBy(key)).withColumn("pid", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("pid").orderBy(key))
    sizes = ordered.groupBy("pid").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("pid", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead"))
    return ordered.withColumn("pos", within).join(F.broadcast(offsets), "pid").select(
        key, (F.col("pos") + F.col("ahead")).cast("int").alias("rank")
    )


def winsorize(df: DataFrame, by: Sequence[str], cols: Sequence[str], fraction: float = 0.01) -> DataFrame:
    """Clip columns to their ``fraction`` and ``1 - fraction`` quantiles within each group."""
    if not isinstance(fraction, (int, float)) or not 0 <= fraction <= 0.5:
        raise ValueError("fraction must be a single number between 0 and 0.5")
    by = list(by)
    limits = quantiles(df, by, cols, [fraction, 1 - fraction])
    bound = [
        F.max(F.when((F.col("variable") == c) & (F.col("prob") == p), F.col("quantile"))).alias(f"{side}_{c}")
        for c in cols
        for side, p in (("lo", fraction), ("hi", 1 - fraction))
    ]
    limits = limits.groupBy(*by).agg(*bound)
    clipped = {
        c: F.when(F.col(c) < F.col(f"lo_{c}"), F.col(f"lo_{c}"))
        .when(F.col(c) > F.col(f"hi_{c}"), F.col(f"hi_{c}"))
        .otherwise(F.col(c).cast("double"))
        for c in cols
    }
    return df.join(limits, by).withColumns(clipped).select(*df.columns)


def standardise(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """z-scores per group with the sample deviation; a column constant in its group becomes NULL."""
    by = list(by)
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in cols],
        *[(F.min(c) < F.max(c)).alias(f"v_{c}") for c in cols],
    )
    scaled = {c: F.when(F.col(f"v_{c}"), ratio(F.col(c) - F.col(f"m_{c}"), f"s_{c}")) for c in cols}
    return df.join(stats, by).withColumns(scaled).select(*df.columns)


def large_groups(df: DataFrame, by: Sequence[str], min_rows: int = 20) -> DataFrame:
    """Rows of groups with at least ``min_rows`` rows."""
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    return df.join(size.select(*by), list(by))


# ---- points and distances -----------------------------------------------------------------------


def _points(df: DataFrame, by: list[str], ident: str, cols: Sequence[str]) -> DataFrame:
    """(by, ident, x) with dropped features as 0, which adds nothing to any distance."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    return df.select(*by, F.col(ident).alias("ident"), x.alias("x"))


def _default_k(df: DataFrame, by: list[str], cols: Sequence[str], k: int, k_single: int | None) -> DataFrame:
    """(by, k): ``k_single`` clusters where a single feature is left."""
    left = sum((F.max(F.col(c).isNotNull().cast("int")) for c in cols), F.lit(0))
    pick = F.lit(k) if k_single is None else F.when(left < 2, k_single).otherwise(k)
    return df.groupBy(*by).agg(pick.cast("int").alias("k"))


def _assign(points: DataFrame, centres: DataFrame, by: list[str], dims: int) -> DataFrame:
    x = F.col("x")
    squares = F.transform("centres", lambda c: square(x, c, dims))
    return (
        points.join(centres, by)
        .withColumn("squares", squares)
        .withColumn("d2", F.array_min("squares"))
        .withColumn("cluster", F.array_position("squares", F.col("d2")).cast("int"))
        .drop("squares")
    )


def kmeans_by_group(
    df: DataFrame,
    by: Sequence[str] = ("cat_key",),
    cols: Sequence[str] = ("sales", "price"),
    k: int = 3,
    k_single: int | None = 2,
    iters: int = 500,
    ident: str = "link_line",
    block: int = BLOCK,
) -> DataFrame:
    """Input rows with ``cluster_number`` from k-means in every group at once; ``converged`` is false where labels still
    moved after ``iters`` turns."""
    by = list(by)
    points = materialise(_points(df, by, ident, cols), "points")
    problems = _default_k(df, by, cols, k, k_single)
    best = best_centres(points, problems, by, len(cols), k, iters, block)
    labels = _assign(points, best.select(*by, "centres", "converged"), by, len(cols)).select(
        *by, F.col("ident").alias(ident), F.col("cluster").alias("cluster_number"), "converged"
    )
    return df.join(labels, [*by, ident])


def elbow(
    df: DataFrame,
    by: Sequence[str] = ("cat_key",),
    cols: Sequence[str] = ("sales", "price"),
    ks: Sequence[int] = tuple(range(1, 11)),
    iters: int = 500,
    ident: str = "link_line",
    block: int = BLOCK,
) -> DataFrame:
    """Within-cluster sum of squares per group and k, and whether its labels came to rest; k = 1 is (n - 1) times the
    summed variances."""
    by = list(by)
    points = materialise(_points(df, by, ident, cols), "points")
    problems = df.select(*by).distinct().withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    return best_centres(points, problems, by, len(cols), max(ks), iters, block).select(*by, "k", "wss", "converged")


# ---- block against block ------------------------------------------------------------------------


def _key_schema(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


def silhouette_by_group(
    df: DataFrame,
    by: Sequence[str] = ("cat_key",),
    label: str = "cluster_number",
    cols: Sequence[str] = ("sales", "price"),
    ident: str = "link_line",
    block: int = BLOCK,
) -> DataFrame:
    """Input rows with ``silhouette_width`` (Euclidean; 0 for a cluster of one)."""
    by = list(by)
    labels = df.select(*by, F.col(ident).alias("ident"), F.array(F.col(label).cast("int")).alias("labels"))
    points = _points(df, by, ident, cols).join(labels, [*by, "ident"])
    kmax = df.agg(F.max(F.col(label).cast("int"))).first()[0] or 1
    width = silhouettes(compared(points, by, kmax, block, ends=False), by)
    return df.join(width.select(*by, F.col("ident").alias(ident), "silhouette_width"), [*by, ident])


def _mad_scaled(df: DataFrame, by: list[str], cols: Sequence[str]) -> DataFrame:
    """Centre by the mean, divide by the mean absolute deviation, per group."""
    mean = df.groupBy(*by).agg(*[F.avg(c).alias(f"m_{c}") for c in cols])
    df2 = df.join(mean, by)
    mad = df2.groupBy(*by).agg(*[F.avg(F.abs(F.col(c) - F.col(f"m_{c}"))).alias(f"a_{c}") for c in cols])
    scaled = {c: ratio(F.col(c) - F.col(f"m_{c}"), f"a_{c}") for c in cols}
    return df2.join(mad, by).withColumns(scaled).select(*df.columns)


def _nearest_two(points: DataFrame, medoids: DataFrame, keys: list[str], dims: int, more: Sequence[str] = ()) -> DataFrame:
    """Distance to and index of the nearest medoid, and the distance to the second nearest."""
    x = F.col("x")
    dist = F.transform("medoids", lambda m: F.sqrt(square(x, m["x"], dims)))
    return (
        points.join(medoids.select(*keys, *more, "medoids"), keys)
        .withColumn("ds", dist)
        .withColumn("d1", F.array_min("ds"))
        .withColumn("near", (F.array_position("ds", F.col("d1")) - 1).cast("int"))
        .withColumn("d2", F.when(F.size("ds") > 1, F.element_at(F.array_sort("ds"), 2)).otherwise(F.col("d1")))
        .drop("ds", "medoids")
    )


def _build_cost(dist: np.ndarray, d1: np.ndarray) -> np.ndarray:
    """Total distance to the nearest medoid if each row's point became one more medoid."""
    return np.minimum(dist, d1[None, :]).sum(axis=1)


def _swap_cost(dist: np.ndarray, d1: np.ndarray, d2: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Change of the total if each row's point replaced medoid 0..k-1 (one column per medoid)."""
    gain = np.minimum(dist - d1[None, :], 0.0)
    lost = np.minimum(dist, d2[None, :]) - d1[None, :]
    base = gain.sum(axis=1)
    return np.stack([base + (lost[:, near == m] - gain[:, near == m]).sum(axis=1) for m in range(k)], axis=1)


def _pam(dist: np.ndarray, ks: list[int], iters: int) -> list[list[int]]:
    """Medoid rows for each k: greedy building, which is the same for all of them, then best swaps; same tie rules as the
    block-pair path."""
    built: list[int] = []
    d1 = np.full(len(dist), np.inf)
    for _ in range(min(max(ks), len(dist))):
        built.append(int(np.argmin(np.round(_build_cost(dist, d1), 9))))
        d1 = np.minimum(d1, dist[built[-1]])
    out = []
    for k in ks:
        chosen = built[:k]
        for _ in range(iters):
            ds = dist[chosen]
            order = np.sort(ds, axis=0)
            cost = np.round(
                _swap_cost(dist, order[0], order[1] if len(chosen) > 1 else order[0], ds.argmin(axis=0), len(chosen)), 9
            )
            pos, row = divmod(int(np.argmin(cost.T)), len(dist))
            if cost[row, pos] >= -1e-9:
                break
            chosen[pos] = row
        out.append(chosen)
    return out


def _medoids(points: DataFrame, problems: DataFrame, by: list[str], dims: int, kmax: int, iters: int, block: int) -> DataFrame:
    """Partitioning around medoids, exactly: greedy build, then best swaps until none improves.

    A group of one block is solved in one task for all its k, from one matrix of distances; larger groups take one
    block-pair job per step for all their k. Returns by, k and ``medoids`` (ident, x).
    """
    keys, schema_keys = [*by, "k"], f"{_key_schema(points, by)}, k int"
    ident_type = points.schema["ident"].dataType.simpleString()
    blocks = materialise(packed(points, by, block), "blocks")
    ks = problems.groupBy(*by).agg(F.array_sort(F.collect_set("k")).alias("ks"))

    def solve(batches):
        import pyarrow as pa

        for row in rows(batches):
            cells, wanted = row.column("cells").flatten(), row.column("ks")[0].as_py()
            x = matrix(cells)
            for k, chosen in zip(wanted, _pam(distances(x, x), wanted, iters)):
                held = [{"ident": cells[c]["ident"].as_py(), "x": x[c].tolist()} for c in chosen]
                kind = pa.list_(pa.struct([("ident", cells.field("ident").type), ("x", pa.list_(pa.float64()))]))
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in by), pa.array([k], pa.int32()), pa.array([held], kind)], [*keys, "medoids"]
                )

    medoid = f"struct<ident:{ident_type},x:array<double>>"
    small = blocks.filter("blocks = 1").join(ks, by).select(*by, "cells", "ks").mapInArrow(solve, f"{schema_keys}, medoids array<{medoid}>")
    large = blocks.filter("blocks > 1")
    if large.isEmpty():
        return materialise(small, "medoids")
    return materialise(small.unionByName(_medoids_by_blocks(large, ks, by, dims, kmax, iters)), "medoids")


def _near_medoids(x: np.ndarray, medoids: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances to the nearest and second nearest medoid, and membership of each point, one column per medoid."""
    if not medoids:
        none = np.full(len(x), np.inf)
        return none, none, np.zeros((len(x), 0))
    ds = distances(np.array(medoids), x)
    order = np.sort(ds, axis=0)
    member = np.zeros((len(x), len(medoids)))
    member[np.arange(len(x)), ds.argmin(axis=0)] = 1.0
    return order[0], order[1] if len(medoids) > 1 else order[0], member


def _pair_costs(a: np.ndarray, b: np.ndarray, problems: list[list], swap: bool, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """What the points of one block add to the cost of each candidate of the other, for both directions: building has one
    column a problem, swapping one a medoid that the candidate would replace. Distances are computed once for all."""
    near_a, near_b = ([_near_medoids(x, m) for m in problems] for x in (a, b))
    width = sum(len(m) for m in problems) if swap else len(problems)
    cost_a, cost_b = np.zeros((len(a), width)), np.zeros((len(b), width))
    for first in range(0, len(a), PAIR_ROWS):
        part = slice(first, first + PAIR_ROWS)
        dist = distances(a[part], b)
        low, more = np.empty_like(dist), np.empty_like(dist)
        at = 0
        for (a1, a2, of_a), (b1, b2, of_b) in zip(near_a, near_b):
            np.minimum(dist, b1, out=low)
            to = at + (of_a.shape[1] if swap else 1)
            if swap:
                np.subtract(np.minimum(dist, b2, out=more), low, out=more)
                cost_a[part, at:to] = (low.sum(axis=1) - b1.sum())[:, None] + more @ of_b
            else:
                cost_a[part, at] = low.sum(axis=1)
            if both:
                own, other = a1[part, None], a2[part, None]
                np.minimum(dist, own, out=low)
                if swap:
                    np.subtract(np.minimum(dist, other, out=more), low, out=more)
                    cost_b[:, at:to] += (low.sum(axis=0) - own.sum())[:, None] + (more.T @ of_a[part])
                else:
                    cost_b[:, at] += low.sum(axis=0)
            at = to
    return cost_a, cost_b


def _medoids_by_blocks(blocks: DataFrame, ks: DataFrame, by: list[str], dims: int, kmax: int, iters: int) -> DataFrame:
    """Medoids of groups of several blocks. Pairs of blocks are written once; each step reads them beside the medoids of
    all unsettled k of the group, so a distance is computed once a step, and a block's costs leave a task as one row."""
    keys = [*by, "k"]
    many = 4 * blocks.sparkSession.sparkContext.defaultParallelism
    flat = blocks.select(*by, "blocks", "blk", F.flatten("cells.x").alias("cells"))
    paired = materialise(pairs(flat, by).repartition(many, *by, "lo", "hi"), "block_pairs")
    cells = blocks.select(*by, "blk", F.col("cells.ident").alias("ident"), F.col("cells.x").alias("x"))
    parts, found = f"{_key_schema(blocks, by)}, blk int, ks array<int>, cost binary", f"{_key_schema(blocks, by)}, blk int, k int, at int, pos int, cost double"

    def cheapest(held: DataFrame, swap: bool) -> DataFrame:
        """(by, k, b): the cheapest candidate of each problem in ``held``, (by, held: k and medoids)."""

        def costs(batches):
            import pyarrow as pa

            for row in rows(batches):
                problems = row.column("held")[0].as_py()
                chosen = [[m["x"] for m in p["medoids"]] for p in problems]
                a, b = (row.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) for c in ("a", "b"))
                lo, hi = row.column("lo")[0].as_py(), row.column("hi")[0].as_py()
                for blk, cost in list(zip((lo, hi), _pair_costs(a, b, chosen, swap, lo != hi)))[: 1 + (lo != hi)]:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.concat_arrays([row.column(c)]) for c in by), pa.array([blk], pa.int32()),
                         pa.array([[p["k"] for p in problems]], pa.list_(pa.int32())), pa.array([cost.tobytes()], pa.binary())],
                        [*by, "blk", "ks", "cost"],
                    )

        def best(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            wanted = [int(k) for k in part["ks"].iloc[0]]
            widths = wanted if swap else [1] * len(wanted)
            total = np.zeros(len(part["cost"].iloc[0]) // 8)
            for cost in part["cost"]:
                total += np.frombuffer(cost)
            total = np.round(total.reshape(-1, sum(widths)), 9)
            out, first = [], 0
            for k, width in zip(wanted, widths):
                pos, at = divmod(int(np.argmin(total[:, first : first + width].T)), len(total))
                out.append((*key, k, at, pos, total[at, first + pos]))
                first += width
            return pd.DataFrame(out, columns=[*by, "blk", "k", "at", "pos", "cost"])

        summed = paired.join(held, by).select(*by, "lo", "hi", "a", "b", "held").mapInArrow(costs, parts)
        picked = summed.groupBy(*by, "blk").applyInPandas(best, found).join(cells, [*by, "blk"])
        place = F.struct(F.get("ident", F.col("at")).alias("ident"), F.get("x", F.col("at")).alias("x"), "pos", "cost")
        return picked.select(*keys, place.alias("b")).groupBy(*keys).agg(F.min_by("b", F.struct("b.cost", "b.pos", "b.ident")).alias("b"))

    groups = blocks.select(*by).distinct()
    medoid = F.struct("b.ident", "b.x")
    ident_type = cells.schema["ident"].dataType.elementType.simpleString()
    built = groups.select(*by, F.array().cast(f"array<struct<ident:{ident_type},x:array<double>>>").alias("medoids"))
    for _ in range(kmax):  # greedy building does not depend on k
        built = materialise(built, "built")
        held = built.select(*by, F.array(F.struct(F.lit(1).alias("k"), "medoids")).alias("held"))
        new = cheapest(held, False).select(*by, "b")
        built = built.join(new, by).select(*by, F.concat("medoids", F.array(medoid)).alias("medoids"))
    active = materialise(
        built.join(ks, by).select(*by, "medoids", F.explode("ks").alias("k")).select(*keys, F.slice("medoids", 1, F.col("k")).alias("medoids")),
        "medoids",
    )
    settled = []
    for _ in range(iters):
        held = materialise(active.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "medoids"))).alias("held")), "held")
        better = F.col("b.cost") < -1e-9
        replaced = F.transform("medoids", lambda m, i: F.when(i == F.col("b.pos"), medoid).otherwise(m))
        turn = materialise(
            active.join(cheapest(held, True), keys).select(
                *keys, F.when(better, replaced).otherwise(F.col("medoids")).alias("medoids"), better.alias("moved")
            ),
            "swaps",
        )
        settled.append(turn.filter(~F.col("moved")).select(*keys, "medoids"))
        active = turn.filter("moved").select(*keys, "medoids")
        if active.isEmpty():
            break
    else:
        settled.append(active)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def kmedoids_by_group(
    df: DataFrame,
    by: Sequence[str] = ("cat_key",),
    cols: Sequence[str] = ("sales", "price"),
    k: int = 3,
    k_single: int | None = 2,
    ident: str = "link_line",
    iters: int = 500,
    block: int = BLOCK,
) -> DataFrame:
    """Input rows with ``cluster_number`` from k-medoids on deviation-scaled columns."""
    by = list(by)
    problems = _default_k(df, by, cols, k, k_single)
    return _kmedoids(df, problems, by, cols, k, ident, iters, block).drop("k")


def _kmedoids(df, problems, by, cols, kmax, ident, iters, block) -> DataFrame:
    keys = [*by, "k"]
    points = materialise(_points(_mad_scaled(df, by, cols), by, ident, cols), "points")
    medoids = _medoids(points, problems, by, len(cols), kmax, iters, block)
    labels = _nearest_two(points, medoids, by, len(cols), ["k"]).select(
        *keys, F.col("ident").alias(ident), (F.col("near") + 1).alias("cluster_number")
    )
    return df.join(labels, [*by, ident])


def prepared(
    seg: DataFrame,
    by: Sequence[str] = ("cat_key",),
    cols: Sequence[str] = ("sales", "price"),
    fraction: float | None = 0.01,
    min_rows: int = 20,
    ident: str = "link_line",
) -> DataFrame:
    """Groups of enough rows, winsorised (unless ``fraction`` is None) and standardised."""
    df = large_groups(seg, by, min_rows).select(*by, ident, *[F.col(c).cast("double").alias(c) for c in cols])
    if fraction is not None:
        df = winsorize(df, by, cols, fraction)
    return standardise(df, by, cols)


def best_segmentation(
    seg: DataFrame,
    by: Sequence[str] = ("cat_key",),
    cols: Sequence[str] = ("sales", "price"),
    k: int = 3,
    k_single: int | None = 2,
    fraction: float | None = 0.01,
    min_rows: int = 20,
    ident: str = "link_line",
) -> DataFrame:
    """k-means or medoids per group, whichever has the higher mean silhouette (ties: medoids)."""
    by = list(by)
    df = materialise(prepared(seg, by, cols, fraction, min_rows, ident), "scaled")
    kinds = ("k-means", "pam")
    runs = (kmeans_by_group(df, by, cols, k, k_single, ident=ident), kmedoids_by_group(df, by, cols, k, k_single, ident=ident))
    labelled = None
    for which, run in enumerate(runs):
        part = run.select(*by, F.col(ident).alias("ident"), F.lit(which).alias("which"), F.col("cluster_number").cast("int").alias("label"))
        labelled = part if labelled is None else labelled.unionByName(part)
    found = compared(_with_labels(_points(df, by, ident, cols), labelled, by), by, max(k, k_single or k), ends=False)
    both = materialise(
        silhouettes(found, by).select(
            *by, F.col("ident").alias(ident), F.col("own").alias("cluster_number"), "silhouette_width",
            F.element_at(F.array(*map(F.lit, kinds)), F.col("which") + 1).alias("type"),
        ),
        "labels",
    )
    mean = both.groupBy(*by, "type").agg(F.avg("silhouette_width").alias("mean_width"))
    winner = mean.groupBy(*by).agg(
        F.when(
            F.max(F.when(F.col("type") == "k-means", F.round("mean_width", 12)))
            > F.max(F.when(F.col("type") == "pam", F.round("mean_width", 12))),
            "k-means",
        )
        .otherwise("pam")
        .alias("type")
    )
    return seg.join(both.join(winner, [*by, "type"]), [*by, ident])


def cluster_sweep(
    seg: DataFrame,
    by: Sequence[str] = ("cat_key",),
    cols: Sequence[str] = ("sales", "price"),
    ks: Sequence[int] = (2, 3, 4, 5, 6),
    fraction: float | None = 0.01,
    min_rows: int = 20,
    ident: str = "link_line",
    block: int = BLOCK,
) -> DataFrame:
    """Mean silhouette, Dunn index and within-SS per group, method and k; all k run together."""
    by = list(by)
    dims = len(cols)
    df = materialise(prepared(seg, by, cols, fraction, min_rows, ident), "scaled")
    problems = df.select(*by).distinct().withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    points = materialise(_points(df, by, ident, cols), "points")
    centres = best_centres(points, problems, by, dims, max(ks), 500, block).select(*by, "k", "centres")
    means = _assign(points, centres, by, dims).select(*by, "ident", "k", F.col("cluster").alias("label"))
    medoids = _kmedoids(df, problems, by, cols, max(ks), ident, 500, block).select(
        *by, F.col(ident).alias("ident"), "k", F.col("cluster_number").alias("label")
    )
    kinds = [(method, int(k)) for method in ("k-means", "pam") for k in sorted(set(ks))]
    which = lambda method: F.array_position(F.array(*[F.lit(n) for m, n in kinds if m == method]), F.col("k")).cast("int") - 1
    labelled = materialise(
        means.withColumn("which", which("k-means")).unionByName(medoids.withColumn("which", which("pam") + len(kinds) // 2)), "labels"
    )
    found = materialise(compared(_with_labels(points, labelled, by), by, max(ks), block), "compared")
    keys = [*by, "which"]
    silhouette = silhouettes(found, by).groupBy(*keys).agg(F.avg("silhouette_width").alias("silhouette"))
    tagged = labelled.join(points, [*by, "ident"])
    centre = tagged.groupBy(*keys, "label").agg(
        F.array(*[F.avg(F.col("x")[i]) for i in range(dims)]).alias("centre")
    )
    within = (
        tagged.join(centre, [*keys, "label"])
        .groupBy(*keys)
        .agg(F.sum(square(F.col("x"), F.col("centre"), dims)).alias("wss"))
    )
    at = F.col("which") + 1
    return silhouette.join(dunn(found, by), keys).join(within, keys).select(
        *by, F.element_at(F.array(*[F.lit(m) for m, _ in kinds]), at).alias("method"),
        F.element_at(F.array(*[F.lit(n) for _, n in kinds]), at).alias("k"), "silhouette", "dunn", "wss",
    )


def _with_labels(points: DataFrame, labelled: DataFrame, by: list[str]) -> DataFrame:
    """Points with their labels in all labelings, in the order of ``which``."""
    listed = F.array_sort(F.collect_list(F.struct("which", "label")))
    return points.join(labelled.groupBy(*by, "ident").agg(listed["label"].alias("labels")), [*by, "ident"])
