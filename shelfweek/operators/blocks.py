"""Points of a group packed in rows of bounded size, and distances of all pairs of such rows.

A group of any size is cut into hash blocks of about ``BLOCK`` points. Each unordered pair of blocks is one row that holds both, so its
distances are computed once, for all labelings that are to be judged; only sums by point, and extremes, leave a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
#: Points of one block that meet the other at a time: their distances then stay in a processor's cache.
PAIR_ROWS = 64


def point_hash(ident: Column) -> Column:
    """60 bits of a point's identity, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(ident.cast("string")), 1, 15), 16, 10).cast("long")


def packed(points: DataFrame, by: list[str], block: int = BLOCK, extra: tuple[str, ...] = ()) -> DataFrame:
    """(by, blocks, blk, cells): points (ident, h, x and ``extra``) in hash blocks, in the order of ident."""
    size = points.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    cell = F.struct("ident", point_hash(F.col("ident")).alias("h"), "x", *extra)
    return (
        points.join(size, by).withColumn("blk", F.pmod(F.xxhash64("ident"), F.col("blocks")).cast("int"))
        .groupBy(*by, "blocks", "blk").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    )


def pairs(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi, a, b): every unordered pair of blocks of a group once, also each block with itself."""
    low = blocks.select(*by, F.col("blk").alias("lo"), F.explode(F.sequence("blk", F.col("blocks") - 1)).alias("hi"), F.col("cells").alias("a"))
    high = blocks.select(*by, F.explode(F.sequence(F.lit(0), "blk")).alias("lo"), F.col("blk").alias("hi"), F.col("cells").alias("b"))
    return low.join(high, [*by, "lo", "hi"])


def rows(batches):
    """Rows of Arrow batches, one at a time: a row holds whole blocks."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1)


def matrix(cells, field: str = "x", kind=np.float64) -> np.ndarray:
    """A list field of all cells of one row, a line for each."""
    values = cells.field(field)
    return values.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(values), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = np.subtract.outer(np.ascontiguousarray(a[:, d]), np.ascontiguousarray(b[:, d]))
        total += np.multiply(gap, gap, out=gap)
    return np.sqrt(total, out=total)


def compared(points: DataFrame, by: list[str], kmax: int, block: int = BLOCK, ends: bool = True) -> DataFrame:
    """What all pairs of points of a group tell about its labelings, one row for each block and block it met.

    ``points`` has ident, x and ``labels``, an array with a label from 1 to ``kmax`` for each labeling. ``total`` packs the summed
    distances from each point of the block to the points of each cluster (points, labelings, ``kmax``), ``n`` how many those were
    (labelings, ``kmax``). The row of a block with itself has its points' ``ident`` and ``labels``; one row of a pair has, by
    labeling, the least distance between clusters, ``apart``, and the largest within, ``wide``; only the Dunn index needs these,
    and without ``ends`` they are NULL.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + f", blk int, kmax int, ident array<{kinds['ident']}>, labels array<array<int>>"
    schema += ", total binary, n array<long>, apart array<double>, wide array<double>"
    names = [*by, "blk", "kmax", "ident", "labels", "total", "n", "apart", "wide"]
    many = 4 * points.sparkSession.sparkContext.defaultParallelism

    def member(labels):
        """One column for each cluster of each labeling."""
        out = np.zeros((len(labels), labels.shape[1] * kmax))
        out[np.arange(len(labels))[:, None], np.arange(labels.shape[1]) * kmax + labels - 1] = 1.0
        return out

    def run(batches):
        import pyarrow as pa

        def batch(row, blk, cells, labels, total, n, apart, wide):
            ident = pa.nulls(1, pa.list_(kind)) if cells is None else pa.ListArray.from_arrays([0, len(cells)], cells.field("ident"))
            doubles = lambda v: pa.array([v], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays(
                [*(pa.concat_arrays([row.column(c)]) for c in by), pa.array([blk], pa.int32()), pa.array([kmax], pa.int32()), ident,
                 pa.array([None if cells is None else labels.tolist()], pa.list_(pa.list_(pa.int32()))), pa.array([total.tobytes()], pa.binary()),
                 pa.array([n.astype(np.int64)], pa.list_(pa.int64())), doubles(apart), doubles(wide)], names,
            )

        for row in rows(batches):
            a, b = row.column("a").flatten(), row.column("b").flatten()
            kind = a.field("ident").type
            la, lb = matrix(a, "labels", np.int64), matrix(b, "labels", np.int64)
            xa, xb = matrix(a), matrix(b)
            in_a, in_b = member(la), member(lb)
            lo, hi = row.column("lo")[0].as_py(), row.column("hi")[0].as_py()
            from_a, from_b = np.zeros((len(la), in_b.shape[1])), np.zeros((len(lb), in_a.shape[1]))
            apart, wide = (np.full(la.shape[1], np.inf), np.full(la.shape[1], -np.inf)) if ends else (None, None)
            for first in range(0, len(la), PAIR_ROWS):
                part = slice(first, first + PAIR_ROWS)
                dist = distances(xa[part], xb)
                from_a[part] = dist @ in_b
                if lo != hi:
                    from_b += dist.T @ in_a[part]
                for which in range(la.shape[1] if ends else 0):
                    same = la[part, which, None] == lb[None, :, which]
                    apart[which] = min(apart[which], np.where(same, np.inf, dist).min())
                    wide[which] = max(wide[which], np.where(same, dist, -np.inf).max())
            extremes = [end if end is None else [float(v) if np.isfinite(v) else None for v in end] for end in (apart, wide)]
            yield batch(row, lo, a if lo == hi else None, la, from_a, in_b.sum(axis=0), *extremes)
            if lo != hi:
                yield batch(row, hi, None, lb, from_b, in_a.sum(axis=0), None, None)

    return pairs(packed(points, by, block, ("labels",)), by).repartition(many, *by, "lo", "hi").mapInArrow(run, schema)


def silhouettes(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, which, ident, own, silhouette_width) from ``compared``; 0 for a cluster of one."""
    kinds = {f.name: f.dataType for f in found.schema.fields}
    schema = ", ".join(f"{c} {kinds[c].simpleString()}" for c in by)
    schema += f", which int, ident {kinds['ident'].elementType.simpleString()}, own int, silhouette_width double"

    def widths(key, part):
        import pandas as pd

        home = part[part["ident"].notna()].iloc[0]
        own, kmax = np.stack([np.asarray(v) for v in home["labels"]]) - 1, int(home["kmax"])
        points, labelings = own.shape
        total, n = np.zeros(points * labelings * kmax), np.zeros(labelings * kmax, dtype=np.int64)
        for sums, sizes in zip(part["total"], part["n"]):
            total += np.frombuffer(sums)
            n += np.asarray(sizes)
        total, n = total.reshape(points, labelings, kmax), n.reshape(labelings, kmax)
        every, which = np.arange(points)[:, None], np.arange(labelings)[None, :]
        own_n = n[which, own]
        a = total[every, which, own] / np.maximum(own_n - 1, 1)
        mean = np.where(n > 0, total / np.maximum(n, 1), np.inf)
        mean[every, which, own] = np.inf
        b = mean.min(axis=2)
        most = np.where(np.isfinite(b), np.maximum(a, b), 0.0)
        known = (own_n > 1) & (most > 0)
        width = np.where(known, np.where(known, b - a, 0.0) / np.where(known, most, 1.0), 0.0)
        out = {c: key[i] for i, c in enumerate(by)} | {
            "which": np.tile(np.arange(labelings), points), "ident": np.repeat(np.asarray(home["ident"], dtype=object), labelings),
            "own": own.ravel() + 1, "silhouette_width": width.ravel(),
        }
        return pd.DataFrame(out)

    packed_sums = found.select(*by, "blk", "kmax", "ident", "labels", "total", "n")
    return packed_sums.groupBy(*by, "blk").applyInPandas(widths, schema)


def dunn(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, which, dunn): smallest distance between clusters over the largest within one."""
    ends = found.filter("apart IS NOT NULL").select(*by, F.posexplode(F.arrays_zip("apart", "wide")).alias("which", "z"))
    return ends.groupBy(*by, "which").agg(F.try_divide(F.min("z.apart"), F.max("z.wide")).alias("dunn"))
