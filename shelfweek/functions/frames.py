"""Row frames over groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def row_frame_sums(
    df: DataFrame, by: Sequence[str], slices: Sequence[str], within: Sequence[str],
    sums: Mapping[str, tuple[str, int, int]], block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` with sums over row frames of each group ``by``, ordered by ``slices`` and then ``within``.

    ``sums`` maps a result to (column, first row, last row), both relative to the current row and none after it. The
    order must be total within a group. No task holds a group: rows are counted by slice (a few hundred per group, such
    as its weeks), which gives each row its position in the group; positions are cut into blocks of ``block_rows``, the
    last rows of a block, as many as the longest frame reaches back, ride along with the next block, and the frames run
    within blocks. Null keys are a group like any other. The result equals one window over the whole group.
    """
    reach = max(-first for _, first, _ in sums.values())
    if reach > block_rows or any(last > 0 for _, _, last in sums.values()):
        raise ValueError("frames end at the current row and reach back one block at most")
    keys = [*by, *slices]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(c).alias(f"__{c}") for c in keys], F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    placed = df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*within)) - 1)
    placed = placed.join(starts, same).withColumn("__at", F.col("__at") + F.col("__before"))
    block = F.call_function("div", F.col("__at"), F.lit(block_rows))
    carried = F.col("__at") % block_rows >= block_rows - reach
    dealt = placed.withColumn("__home", block).withColumn(
        "__block", F.explode(F.when(carried, F.array(block, block + 1)).otherwise(F.array(block)))
    )
    frame = Window.partitionBy(*by, "__block").orderBy("__at")
    summed = dealt.withColumns(
        {name: F.sum(c).over(frame.rowsBetween(first, last)) for name, (c, first, last) in sums.items()}
    )
    return summed.filter("__block = __home").select(*df.columns, *sums)
