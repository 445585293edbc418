"""Edge cases of calendar, markdown, promotion and feature rules."""

import datetime as dt

from pyspark.sql import functions as F

from shelfweek.functions.weeks import sunday_weeks, week_ending, week_gap
from shelfweek.operators import lifecycle, master, prep
from shelfweek.plans import context
from shelfweek.plans.context import Context
from shelfweek.sources import raw

D = dt.date


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()[0]


def test_week_ending_is_saturday(spark):
    days = spark.createDataFrame([(D(1995, 1, 1) + dt.timedelta(i),) for i in range(14)], "d date")
    got = [r[0] for r in days.select(week_ending("d")).collect()]
    assert got == [D(1995, 1, 7)] * 7 + [D(1995, 1, 14)] * 7


def test_sunday_weeks_counts_boundaries(spark):
    a, b = F.lit("1995-01-07").cast("date"), F.lit("1995-01-08").cast("date")
    assert one(spark, sunday_weeks(a, b)) == 1
    assert one(spark, sunday_weeks(b, a)) == -1
    assert one(spark, sunday_weeks(a, a)) == 0


def test_week_gap_uses_52_week_years(spark):
    assert one(spark, week_gap(F.lit(2016), F.lit(1), F.lit(201552))) == 1
    assert one(spark, week_gap(F.lit(2014), F.lit(10), F.lit(201512))) == -54


def test_markdown_chain(spark):
    md = spark.createDataFrame(
        [(1, "AA", D(1995, 1, 3), 9.0), (1, "AA", D(1995, 1, 20), 8.0), (1, "AA", D(1995, 2, 10), 7.0),
         (1, "BB", D(1995, 1, 5), 1.0)],
        "merchandise_key bigint, location_key string, effective_date date, price_point double",
    )
    cal = raw.cal(spark)
    seq = prep.markdown_sequence(prep.markdown_intervals(md, cal, "1995-03-01"))
    rows = sorted(tuple(r) for r in seq.select("key_num", "keys", "end_date", "week_end", "chngd_week_end").collect())
    assert rows == [
        (1, 3, D(1995, 1, 20), 3, 2), (2, 3, D(1995, 2, 10), 6, 5), (3, 3, D(1995, 3, 1), 9, 9),
    ]
    weeks = sorted(tuple(r) for r in prep.markdown_weeks(seq, cal).select("fiscal_week", "key_num").collect())
    assert weeks == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 3), (7, 3), (8, 3), (9, 3)]


def test_markdown_spans_hold_the_weeks_and_the_master_does_not_write_them_out(spark):
    md = spark.createDataFrame(
        [(1, "AA", D(1995, 1, 3), 9.0), (1, "AA", D(1995, 1, 20), 8.0), (1, "AA", D(1995, 1, 21), 7.0)],
        "merchandise_key bigint, location_key string, effective_date date, price_point double",
    )
    cal = raw.cal(spark)
    seq = prep.markdown_sequence(prep.markdown_intervals(md, cal, "1995-03-01"))
    spans = prep.markdown_spans(seq, cal)
    assert sorted(tuple(r) for r in spans.select("key_num", "start_rank", "last_rank").collect()) == [(1, 1, 2), (3, 3, 9)]
    plan = Context(spark, "/root/testdata/sf0.001").master()._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(start_rank" not in plan


def test_feature_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(context, "FEATURE_ROWS", 1000)
    c = Context(spark, "/root/testdata/sf0.001")
    rows = 2 * raw.read(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert c.partitions == -(-rows // 1000) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = c.build_features()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(product_key#" in plan and f", {c.partitions}), REPARTITION_BY_NUM" in plan


def test_lines_are_dealt_over_the_partitions_of_the_features(spark, monkeypatch):
    monkeypatch.setattr(context, "FEATURE_ROWS", 1000)
    c = Context(spark, "/root/testdata/sf0.001")
    plan = c.lines()._jdf.queryExecution().executedPlan().toString()
    exchanges = [e for e in plan.split("\n") if "Exchange hashpartitioning(line#" in e]
    assert exchanges and all(f", {c.partitions}), REPARTITION_BY_NUM" in e for e in exchanges)


def test_life_cycle_opens_recorded_weeks_in_order(spark):
    """Weeks of a life come from the records around them; no window runs over the rows of line and week."""
    zero = [
        "store_num_with_inventory", "store_num_with_onorder", "gross_sales_units", "net_sales_units",
        "eop_dc_inventory_units", "eop_dc_on_order_units", "eop_inventory_units", "eop_on_order_units",
    ]
    lines = {  # launch, then (week, net units, flag) of each record
        "early": (199952, [(200002, 3, None), (200004, 2, None), (200009, 1, None)]),
        "late": (200003, [(200001, 5, None), (200004, 2, "First"), (200004, 4, "Further"), (200006, None, None), (200008, 7, None)]),
        "unknown": (None, [(200002, 1, None)]),
        "over": (200007, [(200003, 1, "First"), (200005, 2, None)]),
        "far": (200151, [(200001, 2, None), (200110, 6, "First"), (200111, 6, None)]),
        "between": (200003, [(200002, 9, None), (200008, 1, "First")]),
    }
    rows, weeks = [], sorted({w for _, recorded in lines.values() for w, *_ in recorded})
    ends = {}
    for line, (launch, recorded) in lines.items():
        last = {kind: max((w for w, _, f in recorded if (f is None) == kind), default=None) for kind in (True, False)}
        ends[line] = last[False] or last[True]
        for w, net, flag in recorded:
            units = [net if c == "net_sales_units" else w % 10 for c in zero]
            rows.append(("d", "d", "c", "c", line, *divmod(w, 100), launch, *units, flag, 1 if flag else None, 20, last[flag is None]))
    schema = "dept_key string, dept_desc string, cat_key string, cat_desc string, line string, fiscal_year int, fiscal_week int, launch_date int, "
    inv = spark.createDataFrame(rows, schema + " int, ".join(zero) + " int, md_flag string, md_taken_flag int, first_wk_inv long, md_max_date int")
    out = lifecycle.line_life_cycle(inv)
    plan = [x.lstrip(" +-").split(" ")[0] for x in out._jdf.queryExecution().executedPlan().toString().splitlines()]
    assert "Window" not in plan[: plan.index("Generate")] and "Sort" not in plan[: plan.index("Generate")]
    got = {}
    for r in out.collect():
        got.setdefault((r.line, r.fiscal_year * 100 + r.fiscal_week), []).append(r)
    want = {(line, w) for line, (launch, _) in lines.items() for w in weeks if launch and launch <= w <= ends[line]}
    assert set(got) == want and ("late", 200004) in want and ("early", 200003) in want and ("between", 200004) in want
    for (line, w), found in got.items():
        launch, recorded = lines[line]
        own = [(net or 0, flag) for week, net, flag in recorded if week == w] or [(0, None)]
        assert sorted((r.net_sales_units, str(r.md_flag)) for r in found) == sorted((n, str(f)) for n, f in own)
        assert all(r.eop_inventory_units == (w % 10 if any(week == w for week, *_ in recorded) else 0) for r in found)
        total = sum(n or 0 for week, n, _ in recorded if launch <= week <= min(w, ends[line]))
        assert max(r.cum_sales for r in found) == total and {r.md_max_date for r in found} == {ends[line]}
        assert {r.cum_str for r in found if r.cum_sales == total} == {total / 20} and {r.launch_date for r in found} == {launch}
        assert {r.age_in_weeks for r in found} == {(w // 100 - launch // 100) * 52 + w % 100 - launch % 100 + 1}


def test_stages_of_a_life_cycle_read_it_once(spark):
    from shelfweek.plans.queries import QUERIES

    plan = QUERIES["d21_quadratic_stage"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "category_life" in str(Context.of(spark, "/root/testdata/sf0.001").__dict__.keys())


def promo_rows(spark, start, end, price=10.0):
    df = spark.createDataFrame(
        [(1, 7, "AA", start, end, price, "x")],
        "promo_key int, merchandise_key int, location_key string, promo_start_date date, promo_end_date date, "
        "promo_price double, promo_desc string",
    )
    return prep.with_period(df, raw.cal(spark), "promo_start_date", "promo_end_date")


def test_promo_within_one_week_and_across_year_end(spark):
    week = prep.promo_week_price(promo_rows(spark, D(1995, 1, 3), D(1995, 1, 5))).collect()
    assert [(r.fw, r.promo_price) for r in week] == [(1, 10.0)]
    crossing = prep.promo_week_price(promo_rows(spark, D(1995, 12, 20), D(1996, 1, 10))).collect()
    assert [(r.fw, r.promo_price) for r in crossing] == [(None, None)]


def test_promo_day_weights(spark):
    a = promo_rows(spark, D(1995, 1, 3), D(1995, 1, 17), 10.0)
    b = promo_rows(spark, D(1995, 1, 8), D(1995, 1, 14), 20.0).withColumn("promo_key", F.lit(2))
    got = {r.fw: r.promo_price for r in prep.promo_week_price(a.unionByName(b)).collect()}
    assert got == {1: 10.0, 2: 15.0, 3: 10.0}


MASTER = (
    "product_key bigint, merchandise_key bigint, fiscal_year int, fiscal_week int, net_sales_units int, "
    "current_retail decimal(18,2), full_price decimal(18,2), promo_price double, price_point decimal(18,2), "
    "md_taken_flag int, no_wk_business int, eop_inventory_units int, eop_on_order_units int, eop_dc_inventory_units int"
)


def master_row(week, retail, promo=None, point=None, flag=None, business=0, inv=10, key=1):
    from decimal import Decimal

    dec = lambda v: None if v is None else Decimal(str(v))
    return (1, key, 2000, week, 5, dec(retail), dec(40), promo, dec(point), flag, business, inv, 0, 0)


def test_price_rules(spark):
    rows = [
        master_row(1, 20.0), master_row(2, 18.0, promo=30.0), master_row(3, 15.0, point=12.0, flag=1),
        master_row(4, 12.0, point=12.0, flag=1, promo=9.0), master_row(5, 10.0, point=8.0, flag=2),
    ]
    df = master.features(spark.createDataFrame(rows, MASTER))
    got = {r.fiscal_week: r for r in df.collect()}
    assert float(got[1].md_price) == 20.0  # first week keeps its own retail
    assert float(got[2].md_price) == 20.0 and got[2].promo_discount == 25.0  # promo above retail: against full price
    assert float(got[3].final_price) == 12.0 and float(got[4].final_price) == 9.0
    assert float(got[3].md_price) == 18.0  # no earlier week in this markdown: previous retail of the product
    assert float(got[5].regular_price) == 18.0 and float(got[5].running_regular_price) == 12.0
    assert got[3].md_flag == "First" and got[4].md_flag is None and got[5].md_flag == "Further"
    assert got[1].md_discount is None and abs(got[3].md_discount - 100 / 3) < 1e-9


def test_launch_back_cast(spark):
    for business, expected in ((2, 200010), (3, 200010), (15, 199949), (70, 199846)):
        rows = [master_row(w, 20.0, business=business) for w in (10, 11, 12)]
        df = master.features(spark.createDataFrame(rows, MASTER))
        assert {r.launch_date for r in df.collect()} == {expected}, business


def test_inventory_only_weeks_do_not_group_together(spark):
    rows = [master_row(1, 20.0), (1, None, None, None, None, None, None, None, None, None, 3, None, None, 4)]
    got = master.features(spark.createDataFrame(rows, MASTER)).collect()
    lone = next(r for r in got if r.merchandise_key is None)
    assert lone.inventory == 4 and lone.cnt is None and lone.launch_date is None and lone.md_price is None
