"""Return rates: weekly, moving-average, markdown versus regular, and hold-out tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfweek.functions.frames import row_frame_sums
from shelfweek.functions.numeric import dbl, ratio, ratio_or, trunc_avg
from shelfweek.functions.weeks import pack_week, packed_week, packed_year, week_array, week_filter, week_places
from shelfweek.session import materialise

CAT = ["dept_desc", "cat_key", "cat_desc"]
YW = ["fiscal_year", "fiscal_week"]
RATE_WEEK = 38
NO_LAUNCH = 999999  # fixed sentinel: a missing launch period sorts after every real one
BLOCK_LINES = 128  # neighbouring lines of a category whose weeks are framed together


def _sold(f: DataFrame) -> DataFrame:
    return f.filter(F.col("merchandise_key").isNotNull())


def return_rate(f: DataFrame, weeks: tuple[int, int, int] = (2016, 17, 32)) -> DataFrame:
    """Category x week gross units, returned units and rate, for weeks with sales."""
    return (
        _sold(f)
        .filter(week_filter(weeks))
        .groupBy(*CAT, *YW)
        .agg(
            F.sum("gross_sales_units").alias("gross_sales"),
            (F.sum("gross_sales_units") - F.sum("net_sales_units")).alias("return_units"),
        )
        .filter(F.col("gross_sales") > 0)
        .withColumn("return_rate", ratio("return_units", "gross_sales"))
    )


def return_rate_ma_error(rr: DataFrame, n: int = 13, weeks: Sequence[int] = (31, 32)) -> DataFrame:
    """Mean of the previous ``n`` weekly rates of the year and its percentage error at given weeks."""
    frame = Window.partitionBy(*CAT, "fiscal_year").orderBy("fiscal_week").rowsBetween(-n, -1)
    return (
        rr.withColumn("pred_ma", F.avg("return_rate").over(frame))
        .filter(F.col("fiscal_week").isin(list(weeks)))
        .withColumn("perc_rr", ratio(F.col("return_rate") - F.col("pred_ma"), "return_rate") * 100)
    )


def return_rate_pooled(rr: DataFrame, n: int = 13) -> DataFrame:
    """Pooled rate of the previous ``n`` weeks and of the last ``n`` (the next-week forecast)."""
    base = Window.partitionBy(*CAT, "fiscal_year").orderBy("fiscal_week")

    def pooled(low: int, high: int):
        frame = base.rowsBetween(low, high)
        return ratio(F.sum("return_units").over(frame), F.sum("gross_sales").over(frame))

    return rr.withColumns({"pred_ma": pooled(-n, -1), "pred_next": pooled(1 - n, 0)})


def category_launch(f: DataFrame) -> DataFrame:
    """Earliest launch period per category; 0 counts as missing."""
    launch = F.col("launch_date")
    return f.groupBy("cat_key").agg(F.min(F.when(launch == 0, NO_LAUNCH).otherwise(launch)).alias("min_ld"))


def _weeks_around(weeks: DataFrame, at: tuple[int, int], before: int, after: int) -> Column:
    """The weeks seen from ``before`` weeks ahead of ``at`` to ``after`` weeks past it; none if ``at`` was not seen."""
    here = F.array_position("w", F.lit(at[0] * 100 + at[1])).cast("int")
    first = F.greatest(here - before, F.lit(1))
    near = F.when(here > 0, F.slice("w", first, here + after - first + 1)).otherwise(F.slice("w", 1, 0))
    return weeks.agg(F.sort_array(F.collect_set("yw")).alias("w")).select(near).scalar()


def _packed_weeks(f: DataFrame, grain: Sequence[str], yw: Column) -> DataFrame:
    """(grain, sold): the recorded weeks of each group as one map from week to gross and net units."""
    week = F.struct(F.col("gross"), F.col("net"))
    return (
        f.filter(F.col("line").isNotNull())
        .groupBy(*grain, yw.alias("yw"))
        .agg(F.sum("gross_sales_units").alias("gross"), F.sum("net_sales_units").alias("net"))
        .groupBy(*grain)
        .agg(
            F.map_from_entries(
                F.collect_list(F.when(F.col("yw").isNotNull(), F.struct(F.col("yw"), week)))
            ).alias("sold")
        )
    )


def _dense_weeks(
    f: DataFrame, grain: Sequence[str], around: tuple[tuple[int, int], int, int] | None = None
) -> DataFrame:
    """Gross and returned units per (grain, week) over every week seen, zero-filled.

    Units are summed before the weeks are filled in, so the line x week spine of the reference is
    never built for category results: the sums are the same and the spine is weeks x categories.
    A group's weeks (bounded by the calendar) are packed into one map, and the dense weeks are read off
    it: no spine join, and the rows stay partitioned by group for the windows that follow. ``around`` (week,
    weeks before, weeks after) builds only these weeks, for every group; sums of other weeks are not kept.
    """
    seen = f.filter(F.col("fiscal_year").isNotNull() & F.col("fiscal_week").isNotNull())
    weeks = seen.select(pack_week(*YW).alias("yw")).distinct()
    yw = pack_week(*YW)
    if around is None:
        weeks = week_array(weeks, "yw")
    else:
        weeks = _weeks_around(weeks, *around)
        yw = F.when(F.array_contains(weeks, yw), yw)
    return (
        _packed_weeks(f, grain, yw)
        .withColumn("yw", F.explode(weeks))
        .withColumn("s", F.try_element_at("sold", F.col("yw")))
        .select(
            *grain,
            packed_year("yw").alias("fiscal_year"),
            packed_week("yw").alias("fiscal_week"),
            F.coalesce("s.gross", F.lit(0)).alias("gross_sales"),
            (F.coalesce("s.gross", F.lit(0)) - F.coalesce("s.net", F.lit(0))).alias("return_units"),
        )
    )


def _launch_index(f: DataFrame, weeks: Column) -> DataFrame:
    """``category_launch`` with the place of its first week among ``weeks``; their number if no week is that late."""
    late = F.size(F.filter("weeks", lambda w: w < F.col("min_ld")))
    place = F.when(F.col("min_ld").isNull(), F.size("weeks")).otherwise(late)
    return category_launch(f).withColumn("weeks", weeks).withColumn("from", place).drop("weeks")


def _totals_to_date(f: DataFrame, weeks: Column, place: Callable[[Column], Column]) -> DataFrame:
    """(line, category, gross, returned): each line's totals up to and including every week of ``weeks``, as two arrays.

    Recorded weeks are summed up in order, and a total stands until the next recorded week; other weeks are no rows. Rows
    without a week keep their line, with nothing sold.
    """
    keys = ["line", *CAT]
    by_line = Window.partitionBy(*keys).orderBy(F.col("yw").asc_nulls_first())
    to_date = by_line.rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("yw").isNotNull()
    gross, net = (F.when(known, F.coalesce(c, F.lit(0))).otherwise(0) for c in ("gross", "net"))
    recorded = (
        f.filter(F.col("line").isNotNull())
        .groupBy(*keys, pack_week(*YW).alias("yw"))
        .agg(F.sum("gross_sales_units").alias("gross"), F.sum("net_sales_units").alias("net"))
        .repartition(*keys)
        .withColumn("at", F.when(known, place("yw")).otherwise(0))
        .select(
            *keys, "at", (F.lead("at", 1).over(by_line)).alias("next"),
            F.sum(gross).over(to_date).alias("gross"), F.sum(gross - net).over(to_date).alias("returned"),
        )
        .withColumn("n", F.coalesce("next", F.size(weeks)) - F.col("at"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("at", "n", "gross", "returned"))).alias("r"))
        .withColumn("before", F.array(F.array_repeat(F.lit(0).cast("long"), F.get("r", F.lit(0))["at"])))
    )
    dense = lambda c: F.flatten(F.concat("before", F.transform("r", lambda r: F.array_repeat(r[c], r["n"]))))
    return recorded.select(*keys, dense("gross").alias("gross"), dense("returned").alias("returned"))


def _rows_by_line(f: DataFrame, spans: dict[str, tuple[int, int]], moved: int, shifted: bool) -> DataFrame:
    """Every line in every week from its category's launch, with the sums ``__{span}_{column}`` over rows of the line.

    A line's weeks follow one another, so the sum of a frame is the difference of two totals to date: no window runs over the
    rows of line and week, and they are neither sorted nor shuffled. ``moved`` counts returns that many weeks later;
    ``shifted`` sums these.
    """
    seen = f.filter(F.col("fiscal_year").isNotNull() & F.col("fiscal_week").isNotNull())
    weeks, place = week_places(seen.select(pack_week(*YW).alias("yw")).distinct())
    i, last, start = F.col("i"), F.size(weeks) - 1, F.col("from")
    to = lambda c, j: F.coalesce(F.get(c, j), F.lit(0))  # noqa: E731  up to week j; nothing before the first
    between = lambda c, a, b: to(c, b) - to(c, a - 1)
    values = {"gross_sales": between("gross", i, i), "return_units": between("returned", i, i)}
    if moved:
        values["returns_post_2wk"] = F.when(i + moved <= last, between("returned", i + moved, i + moved))
    for name, (low, high) in spans.items():
        a, b, by = F.greatest(start, i + low), i + high, moved if shifted else 0
        values[f"__{name}_gross_sales"] = F.when(a <= b, between("gross", a, b))
        values[f"__{name}_{'returns_post_2wk' if shifted else 'return_units'}"] = F.when(
            (a <= b) & (a + by <= last), between("returned", a + by, F.least(b + by, last))
        )
    return (
        _totals_to_date(f, weeks, place)
        .join(_launch_index(f, weeks), "cat_key")
        .filter(start <= last)
        .withColumn("i", F.explode(F.sequence(start, last)))
        .withColumn("yw", F.get(weeks, i))
        .select(
            "cat_key", "line", "dept_desc", "cat_desc", packed_year("yw").alias("fiscal_year"),
            packed_week("yw").alias("fiscal_week"), *[c.alias(name) for name, c in values.items()], "min_ld",
        )
    )


def _line_places(f: DataFrame, partitions: int) -> DataFrame:
    """Every line once: its map of weeks, the category's launch, number of lines (``size``) and its own place among
    them (``place``, from 0, in the order of line).

    Lines are sorted over range partitions and written once; the number of a row in its partition, and the sizes of the
    category's earlier partitions (one row for each), give the place, so no task holds a category.
    """
    lines = _packed_weeks(f, ["line", *CAT], pack_week(*YW)).join(category_launch(f), "cat_key")
    ordered = materialise(
        lines.repartitionByRange(partitions, *CAT, "line").sortWithinPartitions(*CAT, "line")
        .withColumn("at", F.monotonically_increasing_id()),
        "line_places",
    ).withColumn("part", F.shiftrightunsigned("at", 33))
    by_cat = Window.partitionBy(*[f"c_{c}" for c in CAT])
    earlier = by_cat.orderBy("c_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*CAT, "part"]
    starts = (
        ordered.groupBy(*keys).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own"))
        .select(*[F.col(c).alias(f"c_{c}") for c in keys], "first", "own")
        .select(
            "*", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("ahead"), F.sum("own").over(by_cat).alias("size"),
            F.min("first").over(by_cat).alias("cat_no"),
        )
    )
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    return ordered.join(F.broadcast(starts), same).select(
        "cat_key", "line", "dept_desc", "cat_desc", "min_ld", "sold", "cat_no", "size",
        (F.col("at") - F.col("first") + F.col("ahead")).alias("place"),
    )


def _rows_by_category(
    f: DataFrame, sums: dict[str, tuple[str, int, int]], moved: int, partitions: int, block_lines: int = BLOCK_LINES
) -> DataFrame:
    """Every line in every week from the category's launch, with ``sums`` (column, first row, last row) over the rows of
    the category, ordered by week and then line.

    Every line has every week, so the rows before one are those of its neighbours, and of the category's last
    lines a week earlier. Lines are dealt packed: a block holds ``block_lines`` neighbours and the last ones of the block
    before, the first block also the lines that its frames reach in earlier weeks. Weeks are opened inside a block and
    framed there, so rows of line and week are never shuffled.
    """
    reach = max(-first for _, first, _ in sums.values())
    lines = max(block_lines, reach)
    seen = f.filter(F.col("fiscal_year").isNotNull() & F.col("fiscal_week").isNotNull())
    weeks = week_array(seen.select(pack_week(*YW).alias("yw")).distinct(), "yw")
    place, size = F.col("place"), F.col("size")
    home = F.call_function("div", place, F.lit(lines))
    far = F.call_function("div", place + reach, size)  # a line's row so many weeks back is still reached
    copy = lambda block, back: F.struct(block.cast("long").alias("block"), back.cast("long").alias("back"))
    none = F.slice(F.array(copy(home, F.lit(0))), 1, 0)
    copies = F.concat(
        F.array(copy(home, F.lit(0))),
        F.when((place % lines >= lines - reach) & ((home + 1) * lines < size), F.array(copy(home + 1, F.lit(0)))).otherwise(none),
        F.when(far >= 1, F.transform(F.sequence(F.lit(1).cast("long"), far), lambda d: copy(F.lit(0), d))).otherwise(none),
    )

    here = (F.col("i") - F.col("back")).cast("int")  # the week whose sales stand in week i of the block
    seen_at = {"from": F.get(weeks, here), "own": F.try_element_at("sold", F.get(weeks, here))}
    returns = lambda c: F.coalesce(f"{c}.gross", F.lit(0)) - F.coalesce(f"{c}.net", F.lit(0))
    values = {"gross_sales": F.coalesce("own.gross", F.lit(0)), "return_units": returns("own")}
    if moved:
        seen_at |= {"to": F.get(weeks, here + moved), "post": F.try_element_at("sold", F.get(weeks, here + moved))}
        values["returns_post_2wk"] = F.when(F.col("to").isNotNull(), returns("post"))
    rows = (
        _line_places(f, partitions)
        .withColumn("copy", F.explode(copies))
        .select("*", "copy.block", "copy.back", (F.col("copy.block").eqNullSafe(home) & (F.col("copy.back") == 0)).alias("home"))
        .repartition(partitions, "cat_no", "block")
        .filter(F.col("back") < F.size(weeks))
        .withColumn("i", F.explode(F.sequence(F.col("back").cast("int"), F.size(weeks) - 1)))
        .withColumns(seen_at)
        .filter(F.col("from") >= F.col("min_ld"))
        .select(
            "cat_key", "line", "dept_desc", "cat_desc", packed_year("from").alias("fiscal_year"), packed_week("from").alias("fiscal_week"),
            *[c.alias(name) for name, c in values.items()], "min_ld", "cat_no", "block", "i", "back", "place", "home",
        )
    )
    frame = Window.partitionBy("cat_no", "block", "i").orderBy(F.desc("back"), "place")
    summed = rows.withColumns({name: F.sum(c).over(frame.rowsBetween(*span)) for name, (c, *span) in sums.items()})
    return summed.filter("home").drop("cat_no", "block", "i", "back", "place", "home")


def return_rate_ma(
    f: DataFrame, grain: str = "category", n: int = 13, shift: int = 0, carry_shift: int | None = None,
    partition: str | None = None, at: tuple[int, int] | None = None, partitions: int | None = None,
) -> DataFrame:
    """Weekly return rate with trailing ``n``-week rates before and including the week.

    ``shift`` weeks: returns are counted that many weeks after the sale week and the rates use them.
    ``carry_shift`` only carries the shifted sum along. ``grain`` is 'category' or 'line'; at line
    grain the frames run per line. With ``partition`` 'category' they run over the ``n`` rows before of all
    lines of the category instead, in the order of week and then line, which makes the order total.
    Weeks start at the category's earliest launch. ``at`` gives the rows of one (year, week) only: a frame reaches
    back ``n`` rows and every line has a row a week, so no week further back than ``n`` is built. Frames over a category's
    lines in all weeks are dealt over ``partitions`` (as many as shuffles have by default).
    """
    if partition not in (None, grain, "category"):
        raise ValueError(f"frames of {grain} rows cannot run by {partition}")
    keys = (["line"] if grain == "line" else []) + CAT
    by_key = Window.partitionBy(*keys).orderBy(*YW)
    moved = shift or carry_shift
    returned = "returns_post_2wk" if shift else "return_units"
    spans = {"ma": (-n, -1), "pred": (1 - n, 0)}
    sums = {f"__{k}_{c}": (c, *span) for k, span in spans.items() for c in (returned, "gross_sales")}
    rates = [
        ratio_or(F.col(f"__{k}_{returned}"), F.col(f"__{k}_gross_sales")).alias(name)
        for k, name in (("ma", "ma_n_wk_rr"), ("pred", "pred_rr"))
    ]
    by_category = grain == "line" and partition == "category"
    if grain == "line" and not at:
        if by_category:
            partitions = partitions or int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            out = _rows_by_category(f, sums, moved or 0, partitions)
        else:
            out = _rows_by_line(f, spans, moved or 0, bool(shift))
        return out.select(*[c for c in out.columns if c not in sums], ratio_or(returned, "gross_sales").alias("wkly_rr"), *rates)
    df = _dense_weeks(f, keys, (at, n, moved or 0) if at else None)
    if moved:
        df = df.withColumn("returns_post_2wk", F.lead("return_units", moved).over(by_key))
    df = df.join(category_launch(f), "cat_key").filter(pack_week(*YW) >= F.col("min_ld"))
    if at:
        df = df.filter(pack_week(*YW) <= at[0] * 100 + at[1])
    asked = week_filter((at[0], at[1], at[1])) if at else F.lit(True)
    if by_category:
        return row_frame_sums(df, CAT, YW, ["line"], sums).filter(asked).select(
            *df.columns, ratio_or(returned, "gross_sales").alias("wkly_rr"), *rates
        )

    def rate(low: int, high: int):
        frame = by_key.rowsBetween(low, high)
        return ratio_or(F.sum(returned).over(frame), F.sum("gross_sales").over(frame))

    return df.withColumns(
        {
            "wkly_rr": ratio_or(returned, "gross_sales"),
            "ma_n_wk_rr": rate(-n, -1),
            "pred_rr": rate(1 - n, 0),
        }
    ).filter(asked)


def return_rate_mape(ma: DataFrame, weeks: tuple[int, int, int] = (2016, 23, 32)) -> DataFrame:
    """Mean absolute percentage error of the trailing rate per category, weeks with sales only."""
    error = ratio_or(F.abs(F.col("wkly_rr") - F.col("ma_n_wk_rr")), "wkly_rr")
    return ma.filter(week_filter(weeks) & (F.col("gross_sales") > 0)).groupBy(*CAT).agg(F.avg(error).alias("mape"))


def next_week_rate(ma: DataFrame, week: tuple[int, int] = (2016, 32), categories: Sequence[str] | None = None):
    """Forecast rate for the week after ``week``."""
    df = ma.filter((F.col("fiscal_year") == week[0]) & (F.col("fiscal_week") == week[1]))
    if categories is not None:
        df = df.filter(F.col("cat_key").isin(list(categories)))
    return df.select(*CAT, "min_ld", "gross_sales", "wkly_rr", "ma_n_wk_rr", "pred_rr")


def returns_shift(f: DataFrame, by: str = "product_key", n: int = 2) -> DataFrame:
    """Returns ``n`` recorded weeks later, credited to the sale week."""
    ordered = Window.partitionBy(by).orderBy(*YW)
    returned = F.col("gross_sales_units") - F.col("net_sales_units")
    return _sold(f).withColumn("returns_post_2wk", F.lead(returned, n).over(ordered))


def returns_base(f: DataFrame, by: str = "product_key", n: int = 2) -> DataFrame:
    """Sales rows with shifted returns and the markdown-period flag (marked down now or within n weeks)."""
    ordered = Window.partitionBy(by).orderBy(*YW)
    return (
        returns_shift(f, by, n)
        .withColumn("pos_flag", F.lead("md_taken_flag", n).over(ordered))
        .withColumn("md_period_flag", F.coalesce("md_taken_flag", "pos_flag").isNotNull().cast("int"))
    )


def md_vs_regular(f: DataFrame, shift: bool = True, last_first: int | None = None) -> DataFrame:
    """Returns and prices in markdown versus regular weeks, rolled up line -> category.

    ``shift`` adds the shifted returns and their rate. ``last_first`` keeps only each product's last k
    regular and first k markdown weeks: two plain rank filters, each limited before the shuffle.
    """
    base = returns_base(f)
    if last_first is not None:
        by_product = Window.partitionBy("product_key")
        latest = by_product.orderBy(F.desc("fiscal_year"), F.desc("fiscal_week"))
        regular = base.filter("md_period_flag = 0").withColumn("rnk", F.rank().over(latest))
        marked = base.filter("md_period_flag = 1").withColumn("rnk", F.rank().over(by_product.orderBy(*YW)))
        limit = F.col("rnk") <= last_first
        base = regular.filter(limit).unionByName(marked.filter(limit)).drop("rnk")
    units = F.col("gross_sales_units")

    def counted(c: str):
        return F.sum(F.when(F.col(c).isNull() | (F.col(c) == 0), 0).otherwise(units))

    lines = base.groupBy(*CAT, "line", "md_period_flag").agg(
        # A line's weeks are bounded by the calendar: one set per line instead of an extra shuffle.
        F.size(F.collect_set(pack_week(*YW))).alias("weeks_in_sales"),
        F.sum("net_sales_units").alias("net"),
        F.sum(units).alias("gross"),
        F.sum("returns_post_2wk").alias("post"),
        F.sum("gross_sales_dollars").alias("dollars"),
        F.sum(units * F.coalesce("md_discount", F.lit(0.0))).alias("disc_weighted"),
        counted("md_discount").alias("md_units"),
        F.sum(units * F.coalesce("full_price", F.lit(0))).alias("full_weighted"),
        counted("full_price").alias("full_units"),
    )
    out = lines.groupBy(*CAT, "md_period_flag").agg(
        trunc_avg("weeks_in_sales").alias("weeks_in_sales"),
        F.sum("net").alias("net_sales_units"),
        F.sum("gross").alias("gross_sales_units"),
        (F.sum("gross") - F.sum("net")).alias("return_units"),
        F.sum("post").alias("returns_post_2wk"),
        ratio_or(F.sum("disc_weighted"), F.sum("md_units")).alias("md_disc_weighted"),
        ratio_or(F.sum("dollars"), F.sum("gross")).alias("avg_price"),
        ratio_or(F.sum("full_weighted"), F.sum("full_units")).alias("weighted_full_price"),
        ratio_or(F.sum("post"), F.sum("gross")).alias("rr"),
    )
    if not shift:
        return out.drop("returns_post_2wk", "rr")
    return out.drop("rr") if last_first is not None else out


def holdout(
    base: DataFrame,
    overall: DataFrame,
    ma: DataFrame | None,
    method: int = 1,
    year: int = 2014,
    weeks: tuple[int, int] = (39, 44),
    flag_week: int = 41,
    rate_week: int = RATE_WEEK,
    wk_cnt: int | None = None,
) -> DataFrame:
    """Predicted versus observed returns of lines over a hold-out window.

    Method 1: markdown or regular category rate. 2: trailing category rate at ``rate_week``.
    3: method 2 scaled by MD_RR/Reg_RR when marked down. 4: like 3 with a line-grain ``ma``.
    5: like 3 with a 6-week ``ma``. Only rates of (year, rate_week) are read, so ``ma`` may be built at that week
    alone. Lines need ``wk_cnt`` weeks in the window (all of them by
    default). A line with two markdown numbers in the flag week gives two rows, as in the reference.
    """
    need = wk_cnt if wk_cnt is not None else weeks[1] - weeks[0] + 1
    lines = (
        base.filter(week_filter((year, *weeks)))
        .groupBy("line", "cat_key")
        .agg(
            F.sum("gross_sales_units").alias("gross_sales_units"),
            F.sum("returns_post_2wk").alias("returns_post_2wk"),
            F.count(F.lit(1)).alias("wk_cnt"),
        )
        .filter((F.col("wk_cnt") >= need) & (F.col("gross_sales_units") > 0))
    )
    flags = base.filter(week_filter((year, flag_week, flag_week))).select("line", "md_taken_flag").distinct()
    df = lines.join(flags, "line")
    marked = F.col("md_taken_flag").isNotNull()
    extra: list[str] = []
    if method != 2:
        pivot = overall.groupBy("cat_key").agg(
            F.sum(F.when(F.col("md_period_flag") == 0, F.col("rr"))).alias("reg_rr"),
            F.sum(F.when(F.col("md_period_flag") == 1, F.col("rr"))).alias("md_rr"),
        )
        df = df.join(pivot, "cat_key")
        extra += ["reg_rr", "md_rr"]
    if method != 1:
        on = "line" if method == 4 else "cat_key"
        rates = ma.filter(week_filter((year, rate_week, rate_week))).select(on, "pred_rr")
        df = df.join(rates, on)
        extra.append("pred_rr")
    if method == 1:
        rate = F.when(marked, F.col("md_rr")).otherwise(F.col("reg_rr"))
    elif method == 2:
        rate = F.col("pred_rr")
    else:
        rate = F.when(marked, F.col("pred_rr") * ratio("md_rr", "reg_rr")).otherwise(F.col("pred_rr"))
    seen = dbl("returns_post_2wk")
    return (
        df.withColumn("adj_rr", rate)
        .withColumn("pred_returns", F.col("gross_sales_units") * F.col("adj_rr"))
        .withColumn("error", ratio_or(F.abs(seen - F.col("pred_returns")), seen))
        .select(
            "line", "cat_key", "gross_sales_units", "returns_post_2wk", "wk_cnt", "md_taken_flag", *extra,
            "adj_rr", "pred_returns", "error",
        )
    )
