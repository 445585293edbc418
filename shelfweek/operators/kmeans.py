"""k-means of many groups, many k and many starts at once, each problem run to its own end.

A problem is (group, k, start). Points lie packed in block rows of bounded size. A group of one block is solved in one task,
all its problems side by side. For larger groups a turn joins each block row with one row that packs the centres of the
group's unsettled problems, so a point is read once a turn however many problems look at it; partial sums by
(problem, cluster) leave the task. A problem is settled when its labels stop moving, and then leaves the scan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfweek.operators.blocks import BLOCK, matrix, packed, rows
from shelfweek.session import materialise

CHAINS = 4
#: One sample of start points each: those whose hashes come first after a bitwise XOR with the number.
SAMPLES = tuple(((2 * s + 1) * 0x9E3779B97F4A7C1) % (1 << 60) for s in range(16))
STARTS = CHAINS + len(SAMPLES)


def square(a: Column, b: Column, dims: int) -> Column:
    parts = [(a[i] - b[i]) * (a[i] - b[i]) for i in range(dims)]
    return sum(parts[1:], parts[0])


def _square(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of every point to one centre of each problem, problems by points."""
    total = x[None, :, 0] - centres[:, 0, None]
    np.square(total, out=total)
    for d in range(1, x.shape[1]):
        part = x[None, :, d] - centres[:, d, None]
        total += np.square(part, out=part)
    return total


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squared distance and label of the first such centre, problems by points; one centre after the other."""
    least = _square(x, centres[:, 0])
    labels = np.zeros(least.shape, dtype=np.int64)
    for j in range(1, centres.shape[1]):
        other = _square(x, centres[:, j])
        labels[other < least] = j
        np.minimum(least, other, out=least)
    return least, labels


def _last(values: np.ndarray) -> int:
    """Place of the largest value, the last of equal ones."""
    return len(values) - 1 - int(values[::-1].argmax())


def _ends(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Squared distances to the mean, and the points nearest to and farthest from it and at both ends of the first feature."""
    off = _square(x, mean[None])[0]
    return off, [int(off.argmin()), _last(off), int(x[:, 0].argmin()), _last(x[:, 0])]


def _sample(hashes: np.ndarray, number: int, k: int) -> np.ndarray:
    """Places of the at most ``k`` points that one sample takes, in its order."""
    return np.argsort(hashes ^ number, kind="stable")[:k]


def _starts(x: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Start centres (``STARTS``, k, dims) of points in the order of their identity."""
    out = []
    for first in _ends(x, x.mean(axis=0))[1]:
        chain = [first]
        while len(chain) < k:
            chain.append(_last(_nearest(x, x[chain][None])[0][0]))
        out.append(x[chain])
    for number in SAMPLES:
        out.append(x[np.resize(_sample(hashes, number, k), k)])
    return np.stack(out)


def _turn(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each problem: labels (problems, points), cluster sizes and sums, and the summed squares."""
    least, labels = _nearest(x, centres)
    problems, k = centres.shape[:2]
    cell = (labels + np.arange(problems)[:, None] * k).ravel()
    n = np.bincount(cell, minlength=problems * k).reshape(problems, k)
    sums = [np.bincount(cell, np.tile(x[:, d], problems), problems * k).reshape(problems, k) for d in range(x.shape[1])]
    return labels, n, np.stack(sums, axis=2), least.sum(axis=1)


def _moved(centres: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Means of the clusters; an empty one keeps its centre."""
    return np.where(n[..., None] > 0, sums / np.maximum(n, 1)[..., None], centres)


def solve_block(x: np.ndarray, hashes: np.ndarray, k: int, iters: int) -> tuple[float, np.ndarray, bool]:
    """Best summed squares, its centres, and whether that start came to rest within ``iters`` turns."""
    centres = _starts(x, hashes, k)
    active = np.arange(len(centres))
    before = np.full((len(centres), len(x)), -1)
    for _ in range(iters):
        labels, n, sums, _ = _turn(x, centres[active])
        still = (labels != before[active]).any(axis=1)
        before[active] = labels
        active = active[still]
        if not len(active):
            break
        centres[active] = _moved(centres[active], n[still], sums[still])
    wss = _nearest(x, centres)[0].sum(axis=1)
    best = int(np.round(wss, 9).argmin())
    return float(wss[best]), centres[best], best not in active


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def best_centres(
    points: DataFrame, problems: DataFrame, by: list[str], dims: int, kmax: int, iters: int = 500, block: int = BLOCK
) -> DataFrame:
    """(by, k, wss, centres, converged): the best of ``STARTS`` starts for each row (by, k) of ``problems``.

    Starts are farthest-first chains from the points nearest to and farthest from the mean and from both ends of the
    first feature, and sixteen samples chosen by hash. Starts that end in the same optimum differ by rounding only; the first
    is taken. ``converged`` tells whether labels came to rest before ``iters`` turns.
    """
    blocks = materialise(packed(points, by, block), "blocks")
    ks = problems.groupBy(*by).agg(F.array_sort(F.collect_set("k")).alias("ks"))
    schema = f"{_fields(points, by)}, k int, wss double, centres array<array<double>>, converged boolean"

    def small(batches):
        import pyarrow as pa

        for row in rows(batches):
            cells = row.column("cells").flatten()
            x, hashes = matrix(cells), cells.field("h").to_numpy(zero_copy_only=False)
            for k in row.column("ks")[0].as_py():
                wss, centres, done = solve_block(x, hashes, k, iters)
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in by), pa.array([k], pa.int32()), pa.array([wss]), pa.array([centres.tolist()]), pa.array([done])],
                    [*by, "k", "wss", "centres", "converged"],
                )

    out = blocks.filter("blocks = 1").join(ks, by).select(*by, "cells", "ks").mapInArrow(small, schema)
    large = blocks.filter("blocks > 1")
    if not large.isEmpty():
        long = points.join(large.select(*by).distinct(), by, "left_semi")
        out = out.unionByName(_by_turns(large, long, problems, by, dims, kmax, iters))
    return materialise(out, "centres")


def _first_centres(blocks: DataFrame, points: DataFrame, problems: DataFrame, by: list[str], dims: int, kmax: int) -> DataFrame:
    """(by, k, start, centres) of groups in block rows; the same starts as ``_starts`` gives.

    A block tells its own nearest, farthest and first points only, so a few rows of each block are compared, not points.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema["cells"].dataType.elementType.fields}
    found = f"{_fields(points, by)}, start int, place double, draw long, ident {kinds['ident']}, x array<double>"
    names = [*by, "start", "place", "draw", "ident", "x"]

    def chosen(row, cells, x, starts, at, place, draw):
        import pyarrow as pa

        at, none = np.asarray(at, dtype=np.int64), pa.array(np.zeros(len(at), dtype=np.int64))
        return pa.RecordBatch.from_arrays(
            [*(row.column(c).take(none) for c in by), pa.array(starts, pa.int32()), pa.array(place, pa.float64()), pa.array(draw, pa.int64()),
             cells.field("ident").take(pa.array(at)), pa.array(x[at].tolist(), pa.list_(pa.float64()))], names,
        )

    def firsts(batches):
        for row in rows(batches):
            cells = row.column("cells").flatten()
            x, hashes = matrix(cells), cells.field("h").to_numpy(zero_copy_only=False)
            off, at = _ends(x, np.array(row.column("mean")[0].as_py()))
            yield chosen(row, cells, x, range(CHAINS), at, [*off[at[:2]], *x[at[2:], 0]], [None] * CHAINS)
            for s, number in enumerate(SAMPLES):
                at = _sample(hashes, number, kmax)
                yield chosen(row, cells, x, [CHAINS + s] * len(at), at, [None] * len(at), hashes[at] ^ number)

    def farthest(batches):
        for row in rows(batches):
            cells = row.column("cells").flatten()
            x, held = matrix(cells), row.column("held")[0].as_py()
            least = [_nearest(x, np.array([h["chain"]]))[0][0] for h in held]
            at = [_last(near) for near in least]
            yield chosen(row, cells, x, [h["start"] for h in held], at, [near[i] for near, i in zip(least, at)], [None] * len(at))

    mean = points.groupBy(*by).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(dims)]).alias("mean"))
    first = materialise(blocks.join(mean, by).select(*by, "cells", "mean").mapInArrow(firsts, found), "firsts")
    order = F.struct("place", "ident")
    ends = first.filter(F.col("start") < CHAINS).groupBy(*by, "start").agg(F.min_by("x", order).alias("low"), F.max_by("x", order).alias("high"))
    chain = ends.select(*by, "start", F.array(F.when(F.col("start") % 2 == 0, F.col("low")).otherwise(F.col("high"))).alias("chain"))
    for _ in range(kmax - 1):
        chain = materialise(chain, "chains")
        held = chain.groupBy(*by).agg(F.collect_list(F.struct("start", "chain")).alias("held"))
        next_point = (
            blocks.join(held, by).select(*by, "cells", "held").mapInArrow(farthest, found)
            .groupBy(*by, "start").agg(F.max_by("x", order).alias("p"))
        )
        chain = chain.join(next_point, [*by, "start"]).select(*by, "start", F.concat("chain", F.array("p")).alias("chain"))
    drawn = F.row_number().over(Window.partitionBy(*by, "start").orderBy("draw", "ident"))
    sample = (
        first.filter(F.col("start") >= CHAINS).withColumn("n", drawn).filter(F.col("n") <= kmax)
        .groupBy(*by, "start").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("s"))
        .select(*by, "start", F.col("s.x").alias("chain"))
    )
    return chain.unionByName(sample).join(problems, by).select(
        *by, "k", "start", F.slice("chain", 1, F.col("k")).alias("centres")
    )


def _by_turns(blocks: DataFrame, points: DataFrame, problems: DataFrame, by: list[str], dims: int, kmax: int, iters: int) -> DataFrame:
    keys = [*by, "k", "start"]
    parts = f"{_fields(points, by)}, k int, start int, j int, n long, s array<double>, mark long, squares double"

    def sums(batches):
        import pyarrow as pa

        for row in rows(batches):
            cells = row.column("cells").flatten()
            x, hashes = matrix(cells), cells.field("h").to_numpy(zero_copy_only=False)
            held = row.column("held")[0].as_py()
            for k in sorted({p["k"] for p in held}):
                mine = [p for p in held if p["k"] == k]
                labels, n, total, squares = _turn(x, np.array([p["centres"] for p in mine]))
                # 31 bits of each hash, so that a sum over any number of blocks stays whole
                marks = ((labels + 1) * (hashes & 0x7FFFFFFF)).sum(axis=1)
                cases = len(mine) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.concat_arrays([row.column(c)] * cases) for c in by), pa.array(np.full(cases, k, dtype=np.int32)),
                        pa.array(np.repeat([p["start"] for p in mine], k).astype(np.int32)),
                        pa.array(np.tile(np.arange(k, dtype=np.int32), len(mine))), pa.array(n.ravel().astype(np.int64)),
                        pa.array(total.reshape(cases, -1).tolist()), pa.array(np.repeat(marks, k)), pa.array(np.repeat(squares, k)),
                    ],
                    [*keys, "j", "n", "s", "mark", "squares"],
                )

    def summed(active: DataFrame) -> DataFrame:
        held = active.groupBy(*by).agg(F.collect_list(F.struct("k", "start", "centres")).alias("held"))
        found = blocks.join(held, by).select(*by, "cells", "held").mapInArrow(sums, parts)
        total = F.array(*[F.sum(F.col("s")[i]) for i in range(dims)])
        by_cluster = found.groupBy(*keys, "j").agg(
            F.sum("n").alias("n"), total.alias("s"), F.sum("mark").alias("mark"), F.sum("squares").alias("squares")
        )
        return by_cluster.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("j", "n", "s"))).alias("sums"), F.max("mark").alias("now"), F.max("squares").alias("squares")
        )

    active = materialise(_first_centres(blocks, points, problems, by, dims, kmax).withColumn("mark", F.lit(None).cast("long")), "starts")
    settled = []
    for turn in range(iters + 1):
        mean = lambda c, i: F.when(
            c["n"] > 0, F.transform(c["s"], lambda v: v / c["n"])
        ).otherwise(F.get("centres", i))
        rest = F.col("now").eqNullSafe(F.col("mark"))
        state = materialise(
            active.join(summed(active), keys).select(
                *keys, F.when(rest, F.col("centres")).otherwise(F.transform("sums", mean)).alias("centres"),
                F.col("now").alias("mark"), F.col("squares").alias("wss"), rest.alias("converged"), F.col("centres").alias("old"),
            ),
            "turn",
        )
        last = turn == iters
        done = state if last else state.filter("converged")
        settled.append(done.select(*keys, "wss", F.col("old").alias("centres"), "converged"))
        active = state.filter(~F.col("converged")).select(*keys, "centres", "mark")
        if last or active.isEmpty():
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    order = F.struct(F.round("wss", 9), F.col("start"))
    return out.groupBy(*by, "k").agg(
        F.min_by("wss", order).alias("wss"), F.min_by("centres", order).alias("centres"), F.min_by("converged", order).alias("converged")
    )
