"""Entities and shared stages of one data set, built lazily."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.operators import baseline, elasticity, lifecycle, master, prep, rollups, segments, validate
from shelfweek.session import materialise, stage_generation
from shelfweek.sources import raw

# Parameters that fit the analyses to the derived calendar (1995w01 .. 2002w52). The last week comes from the data.
AS_OF_DATE = "2001-11-30"
MIN_LAUNCH = 199500
SEG_ROWS = 6
#: Rows of the feature table in one partition: its sorts must fit a task's memory, or they spill several times over.
FEATURE_ROWS = 100_000
SEASONS = (
    validate.Season("AW2000", 2000, 17, 21),
    validate.Season("SS1999", 1999, 42, 48),
    validate.Season("SS2000", 2000, 42, 47),
    validate.Season("AW1999", 1999, 16, 21),
)


class Context:
    """Lazy access to raw entities and the feature table of ``sf_dir``.

    The feature table feeds nearly every analysis; it is written once, bucketed by product, and read
    back with only the columns a query needs.
    """

    _live: dict[tuple[str, str, int], "Context"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Context":
        key = (spark.sparkContext.applicationId, str(sf_dir), stage_generation())
        if key not in cls._live:
            cls._live[key] = cls(spark, str(sf_dir))
        return cls._live[key]

    def _raw(self, name: str) -> DataFrame:
        return getattr(raw, name)(self.spark, self.sf_dir)

    @cached_property
    def cal(self) -> DataFrame:
        return raw.cal(self.spark)

    @cached_property
    def macro(self) -> DataFrame:
        return raw.macro_weekly(self.spark)

    @cached_property
    def holidays(self) -> DataFrame:
        return raw.holidays(self.spark)

    @cached_property
    def _end(self) -> tuple:
        """The last week with sales and its calendar rank, and the week after it, as of which ages count."""
        last = tuple(self.sales.agg(F.max(F.struct("fiscal_year", "fiscal_week")).alias("w")).select("w.*").first())
        rank = self._weeks.index(last) + 1
        return last, rank, self._weeks[rank]

    @cached_property
    def _weeks(self) -> list[tuple[int, int]]:
        return sorted(map(tuple, self.cal.select("fiscal_year", "fiscal_week").distinct().collect()))  # one row a week

    def periods(self, weeks: list[tuple[int, int]]) -> list[int]:
        """The numbers that ``series`` gives these weeks of the calendar."""
        return [self._weeks.index(week) + 1 for week in weeks]

    @property
    def last_week(self) -> tuple[int, int]:
        return self._end[0]

    @property
    def last_rank(self) -> int:
        return self._end[1]

    @property
    def as_of_week(self) -> tuple[int, int]:
        return self._end[2]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not hasattr(raw, name):
            raise AttributeError(name)
        return self._raw(name)

    # ---- preparation ----

    def markdowns(self) -> DataFrame:
        return prep.markdown_sequence(prep.markdown_intervals(self.mdtaken, self.cal, AS_OF_DATE))

    def promo_period(self) -> DataFrame:
        return prep.with_period(self.promo, self.cal, "promo_start_date", "promo_end_date")

    def promo_weeks(self) -> DataFrame:
        return prep.promo_week_price(self.promo_period())

    def master(self) -> DataFrame:
        return master.weekly_master(
            self.sales,
            self.dci,
            self.mh,
            self.items_cda,
            prep.markdown_spans(self.markdowns(), self.cal),
            self.promo_weeks(),
            self.items,
            self.cal,
            partitions=self.partitions,
        )

    @cached_property
    def partitions(self) -> int:
        """Partitions by product: as many as shuffles have, more where line items (two rows each at most) need them."""
        rows = 2 * raw.read(self.spark, self.sf_dir, "lineitem").count()
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // FEATURE_ROWS))

    def build_features(self) -> DataFrame:
        return master.features(self.master())

    @cached_property
    def features(self) -> DataFrame:
        return materialise(self.build_features(), "features", bucket_by="product_key", buckets=self.partitions)

    # ---- life cycle ----

    def lines(self) -> DataFrame:
        inventory = lifecycle.first_week_inventory(self.features, self.partitions)
        return lifecycle.line_life_cycle(inventory, self.features)

    @cached_property
    def category_life(self) -> DataFrame:
        """Category x age totals, written once (a row for each age in weeks): fits pass over them repeatedly."""
        return materialise(lifecycle.category_life_cycle(self.lines()), "category_life")

    def ages(self) -> DataFrame:
        return lifecycle.product_age(self.features, MIN_LAUNCH)

    # ---- elasticity data ----

    def typed(self) -> DataFrame:
        return rollups.discount_type(
            self.features, self.items_cda, self.cluster_cat_mapping, self.product_current_stage
        )

    def inflections(self) -> DataFrame:
        return rollups.inflection_fallback(self.all_cats, self.mh, self.category_results)

    def build_product_level(self, variant: str = "a") -> DataFrame:
        """a: with fallback inflections; b: fitted categories only; c: without department columns."""
        infl = self.category_results if variant == "b" else self.inflections()
        columns = {"a": ("dept_desc", "dept_key", "cat_desc"), "b": ("dept_desc", "cat_desc"), "c": ()}[variant]
        return rollups.product_level(
            self.typed(), rollups.launches(self.ages()), self.cal, infl, self.last_rank, columns
        )

    @cached_property
    def product_level(self) -> DataFrame:
        """Product weeks of the elasticity data, written once: roll-ups pass over them repeatedly."""
        return materialise(self.build_product_level(), "product_level")

    def keyed(self, mid_hi: int = 19) -> DataFrame:
        return rollups.cluster_key(self.product_level, mid_hi=mid_hi)

    def build_type1(self) -> DataFrame:
        return rollups.rollup_type1(self.keyed(), self.holidays, self.cal)

    @cached_property
    def type1(self) -> DataFrame:
        return materialise(self.build_type1(), "type1")

    def high(self) -> DataFrame:
        return rollups.high_discount(self.type1)

    # ---- baselines ----

    def series(self) -> DataFrame:
        return baseline.period_sales(self.cal, self.features, self.last_week)

    def seasoned(self) -> DataFrame:
        weekly = baseline.category_sales(self.cal, self.features, self.last_week)
        return baseline.seasonal_index(self.series(), weekly=weekly)

    def smoothed_units(self, at: list[int] | None = None) -> DataFrame:
        units = F.col("gross_sales_units").cast("double")
        return baseline.adaptive_smoothing(self.series().withColumn("s_r_forecast", units), at=at)

    # ---- segmentation ----

    def build_segmentation(self) -> DataFrame:
        return segments.segmentation_features(self.features, self.items_cda, self.as_of_week)

    @cached_property
    def segmentation(self) -> DataFrame:
        return materialise(self.build_segmentation(), "segmentation")

    @cached_property
    def scaled(self) -> DataFrame:
        """Winsorised, standardised features, written once: clustering passes over them many times."""
        return materialise(segments.prepared(self.segmentation, min_rows=SEG_ROWS), "scaled")

    # ---- elasticity and validation ----

    @cached_property
    def prepped(self) -> DataFrame:
        return materialise(elasticity.elasticity_prep(self.high()), "prepped")

    @cached_property
    def elasticity(self) -> tuple[DataFrame, DataFrame]:
        return elasticity.elasticity_results(self.prepped)

    def validation_base(self) -> DataFrame:
        keyed = self.keyed(20)
        final = elasticity.reassign_coefficients(self.elasticities)
        kinds = [F.col(f"final_co_eff_{k}") for k in ("pos", "first", "further")]
        final = final.withColumn("final_co_eff_md_discount", (kinds[0] + kinds[1] + kinds[2]) / 3)
        size = keyed.groupBy("cluster_key").agg(F.count_distinct("merchandise_key").alias("n"))
        factors = size.select(
            "cluster_key",
            (-(F.col("n") % 7) / 1000).alias("age_weeks"),
            ((F.col("n") % 5) / 10).alias("final_g_coeff"),
            ((F.col("n") % 3) / 10).alias("final_m_coeff"),
        )
        months = (
            self.features.filter("merchandise_key IS NOT NULL")
            .join(F.broadcast(self.cal.select("fiscal_year", "fiscal_week", "fiscal_month")), ["fiscal_year", "fiscal_week"])
            .groupBy("cat_key", F.col("fiscal_month").alias("period"))
            .agg(F.sum("gross_sales_units").alias("units"))
        )
        total = months.groupBy("cat_key").agg(F.sum("units").alias("total"))
        si = months.join(total, "cat_key").select(
            "cat_key", "period", F.try_divide((F.col("units") * 12).cast("double"), F.col("total")).alias("new_ssn_exp")
        )
        of_seasons = self.periods([(s.year, s.baseline) for s in SEASONS])  # no other week of the baselines is read
        es = self.smoothed_units(of_seasons).filter(F.col("period") <= self.last_rank).select(
            "cat_key", "merchandise_key", "fiscal_year", "fiscal_week", "es_fcast",
            ((F.col("merchandise_key") % 5) / 10).alias("holiday_coefficient"),
        )
        return validate.validation_base(
            self.product_level, self.cal, self.holidays, rollups.product_cluster_map(keyed), final, factors, si,
            es, baseline.trailing_baselines(self.series(), at=of_seasons), SEASONS,
        )

    @cached_property
    def forecast(self) -> DataFrame:
        return materialise(validate.forecast_chain(self.validation_base()), "forecast")
