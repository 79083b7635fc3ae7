"""Rolling-origin back-test: splits, weights, fits, predictions, outliers.

The list of train and test tables becomes columns of one table: ``set_index``,
``set_first_date`` and ``set_type``. All splits and groups are fitted by the
same jobs; there is no loop over splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions import metrics
from tillweave.functions.maths import logistic, row_sum, safe_log
from tillweave.operators import rolling
from tillweave.operators.mixture import fit_mixtures, mixture_memberships, mixture_memberships_by_group
from tillweave.operators.quantiles import quantile_tails
from tillweave.operators.regression import solve_models
from tillweave.operators.relational import quoted, struct_fields, unnest_struct
from tillweave.operators.reshape import list_of, unpivot_columns
from tillweave.operators.windows import linear_ramp
from tillweave.session import ensure_checkpoint_dir, scratch_folder

# Training and test length, penalty, mixture size, weights.
TRAIN_DAYS = 3 * 365
TEST_DAYS = 30
LASSO_ALPHA = 0.0001
TREND_COMPONENTS = 12
RAMP = (0.2, 1.0)
LOGISTIC_STEEPNESS = 0.01
OVER = ["state_id", "store_id"]
# Fixed names: struct columns of the panel that hold regressors.
DAY_STRUCTS = ["year_month_trigonometric", "holiday_bool", "holiday_pre_post_guassian_splines"]


@dataclass(frozen=True)
class Splits:
    """First test date, last date, and lengths in days."""

    start: Column
    end: Column
    train_days: int = TRAIN_DAYS
    test_days: int = TEST_DAYS

    def count(self) -> Column:
        """Number of splits whose test window ends by the last date."""
        return F.greatest(F.floor(F.datediff(self.end, self.start) / self.test_days), F.lit(0)).cast("int")

    def _range(self, first: Column, last: Column) -> Column:
        lo = F.greatest(first.cast("int"), F.lit(0))
        hi = F.least(last.cast("int"), self.count() - 1)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    def train_of(self, day: Column) -> Column:
        """Indexes of the splits that train on a date."""
        offset = F.datediff(day, self.start)
        return self._range(
            F.floor(offset / self.test_days) + 1, F.floor((offset + self.train_days) / self.test_days)
        )

    def test_of(self, day: Column) -> Column:
        """Index of the split that tests on a date, as a list of at most one."""
        index = F.floor(F.datediff(day, self.start) / self.test_days)
        return self._range(index, index)

    def window_of(self, day: Column) -> Column:
        """Splits whose closed window [train start, test end] holds a date."""
        offset = F.datediff(day, self.start)
        return self._range(
            F.ceil(offset / self.test_days) - 1, F.floor((offset + self.train_days) / self.test_days)
        )

    def first_date(self, index: Column) -> Column:
        return F.date_add(self.start, index * self.test_days)


def splits_to_the_end(panel: DataFrame) -> Splits:
    """Splits from the first date with a whole training window before it to the last date."""
    dates = panel.select("date")
    return Splits(F.date_add(dates.agg(F.min("date")).scalar(), TRAIN_DAYS), dates.agg(F.max("date")).scalar())


def rolling_splits(df: DataFrame, splits: Splits, date_col: str = "date") -> DataFrame:
    """Copy each row to the splits it belongs to.

    Membership follows from the date by arithmetic: no range join, no shuffle.
    """
    day, columns = F.col(date_col), [F.col(quoted(c)) for c in df.columns]
    member = F.array(
        F.struct(F.lit("train").alias("set_type"), splits.train_of(day).alias("indexes")),
        F.struct(F.lit("pred").alias("set_type"), splits.test_of(day).alias("indexes")),
    )
    return (
        df.withColumn("_set", F.explode(member))
        .select(*columns, "_set.set_type", F.explode("_set.indexes").alias("set_index"))
        .withColumn("set_first_date", splits.first_date(F.col("set_index")))
    )


def split_windows(dates: DataFrame, splits: Splits, *others: str) -> DataFrame:
    """(set_index, date, trend, others) for the closed window of each split."""
    return dates.select("date", "trend", *others, F.explode(splits.window_of(F.col("date"))).alias("set_index"))


def trend_midpoints(panel_windows: DataFrame, count_col: str | None = None) -> DataFrame:
    """Median trend of the rows of each split; the values are day numbers.

    With ``count_col`` a row stands for that many.
    """
    if count_col is None:
        return panel_windows.groupBy("set_index").agg(F.median("trend").alias("trend_midpoint"))
    ordered = Window.partitionBy("set_index").orderBy("trend")
    counted = panel_windows.groupBy("set_index", "trend").agg(F.sum(count_col).alias("_n"))
    reached = counted.withColumns(
        {"_so_far": F.sum("_n").over(ordered), "_all": F.sum("_n").over(Window.partitionBy("set_index"))}
    )
    low = F.min(F.when(2 * F.col("_so_far") >= F.col("_all"), F.col("trend")))
    high = F.min(F.when(2 * F.col("_so_far") > F.col("_all"), F.col("trend")))
    return reached.groupBy("set_index").agg(((low + high) / 2).alias("trend_midpoint"))


def sample_weights(
    dates: DataFrame, midpoints: DataFrame, splits: Splits, holiday_columns: Sequence[str]
) -> DataFrame:
    """Three weights per split and training date; 1 on dates with a holiday.

    ``dates`` has one row per date with its trend and 0/1 holiday columns.
    """
    holiday = row_sum(F.col(quoted(c)) for c in holiday_columns) > 0
    train = dates.select(
        "date", "trend", holiday.alias("_holiday"), F.explode(splits.train_of(F.col("date"))).alias("set_index")
    )
    ramp = linear_ramp(*RAMP, "set_index", "date")
    shifted = logistic(F.col("trend"), F.col("trend_midpoint"), LOGISTIC_STEEPNESS)

    def unless_holiday(weight: Column) -> Column:
        return F.when(F.col("_holiday"), F.lit(1.0)).otherwise(weight)

    return (
        train.withColumn("_ramp", ramp)
        .join(midpoints, "set_index")
        .select(
            "set_index",
            "date",
            unless_holiday(F.col("_ramp")).alias("sample_weights"),
            unless_holiday(F.col("_ramp") * F.col("_ramp")).alias("sample_weights_x2"),
            unless_holiday(shifted).alias("sample_weights_shifted_logistic"),
        )
    )


def trend_regimes_per_split(
    dates: DataFrame, splits: Splits, components: int = TREND_COMPONENTS, count_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Mixture of the trend refitted in every split: parameters and memberships.

    Fitted on the rows of train and test dates together, so a date with more
    stores weighs more; only date and trend enter. With ``count_col`` a row
    stands for that many.
    """
    windows = split_windows(dates, splits, *([count_col] if count_col else []))
    params = fit_mixtures(windows, "trend", components, ["set_index"], count_col=count_col)
    return params, mixture_memberships_by_group(windows, "trend", components, ["set_index"], params=params)


def split_days(
    dates: DataFrame, splits: Splits, holiday_columns: Sequence[str], components: int = TREND_COMPONENTS
) -> DataFrame:
    """What a split needs to know of its dates: (set_index, set_first_date, date, trend memberships, weights).

    ``dates`` has one row per date with its trend, its 0/1 holiday columns and ``rows``, the number of panel rows. The
    result grows with the calendar only.
    """
    _, regimes = trend_regimes_per_split(dates, splits, components, "rows")
    midpoints = trend_midpoints(split_windows(dates, splits, "rows"), "rows")
    weights = sample_weights(dates, midpoints, splits, holiday_columns)
    known = unnest_struct(regimes, "trend_guassian_splines").drop("rows", "trend")
    return known.join(weights, ["set_index", "date"], "left").withColumn("set_first_date", splits.first_date(F.col("set_index")))


def backtest_panel(
    panel: DataFrame,
    splits: Splits,
    alpha: float = LASSO_ALPHA,
    components: int = TREND_COMPONENTS,
) -> tuple[DataFrame, DataFrame]:
    """Fit a lasso and a weighted lasso per split, state and store, and predict
    train and test rows. Returns (rows with predictions, coefficients).

    ``panel`` is the store panel: one row per date, state and store. It is
    written, narrow, beside the features of its dates and states, as several
    passes read it and none should start from the sales facts again. All splits
    of a store are fitted from cumulative sums of products, so rows are copied
    to splits only when they are predicted.
    """
    spark = panel.sparkSession
    ensure_checkpoint_dir(spark)
    folder = scratch_folder(spark, "backtest")
    structs = ["wday_guassian_splines", "weekday_bool", *DAY_STRUCTS]
    by_day = {s: struct_fields(panel, s) for s in structs}
    panel.select("date", *OVER, "sales", "trend", *structs).write.parquet(f"{folder}/panel")
    panel = spark.read.parquet(f"{folder}/panel")
    holiday_columns = by_day["holiday_bool"]
    dates = (
        panel.select("date", "trend", "holiday_bool")
        .groupBy("date")
        .agg(F.any_value("trend").alias("trend"), F.any_value("holiday_bool").alias("holiday_bool"), F.count(F.lit(1)).alias("rows"))
        .select("date", "trend", "rows", "holiday_bool.*")
    )
    trend = [f"trend_{k}" for k in range(1, components + 1)]
    weight = "sample_weights_shifted_logistic"
    known = split_days(dates, splits, holiday_columns, components)
    windows = rolling.collect_windows(known, [*trend, weight], splits.train_days, splits.test_days)
    common = [f for s in DAY_STRUCTS for f in by_day[s]]
    wday, weekday = by_day["wday_guassian_splines"], by_day["weekday_bool"]
    features = [*wday, *weekday, *common]
    models = {"lasso": [*trend, *wday, *common], "weigthed_lasso": [*trend, *weekday, *common]}
    flat = unnest_struct(panel, *structs)
    grams = rolling.window_grams(flat, OVER, features, "sales", windows, trend, {"lasso": None, "weigthed_lasso": weight})
    # A store is one group here, but its windows are solved apart.
    dealt = grams.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "set_index", "model", *OVER)
    # One short row per model and group: kept, as several passes read it.
    coefficients = solve_models(dealt, ["set_index", *OVER], [*trend, *features], models, alpha).checkpoint()
    return rolling.window_predictions(flat, coefficients, OVER, features, "sales", windows, trend, models), coefficients


BACKTEST_COLUMNS = [
    "date",
    *OVER,
    "set_index",
    "set_type",
    "set_first_date",
    "sales",
    "rolling_row_std",
    "lasso_prediction",
    "lasso_residual",
    "weigthed_lasso_prediction",
    "weigthed_lasso_residual",
]


MODELS = ("lasso", "weigthed_lasso")


def error_metrics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """WAPE, RMSE and bias of both models per group."""
    measures = []
    for model in MODELS:
        y, f = F.col("sales"), F.col(f"{model}_prediction")
        measures += [getattr(metrics, name)(y, f).alias(f"{model}_{name}") for name in ("wape", "rmse", "bias")]
    return rows.groupBy(*by).agg(*measures)


def forecast_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], store: str | None = None
) -> DataFrame:
    """Predictions, residuals and sales melted to (ids, variable, value), sorted."""
    if store is not None:
        df = df.where(F.col("store_id") == store)
    cells = [F.col(quoted(c)).cast("double").alias(c) for c in values]
    return unpivot_columns(df.select(*ids, *cells), ids, values).orderBy(*ids, "variable")


def outlier_days(
    df: DataFrame, residual: str = "residual", store_col: str = "store_id", tails: tuple[float, float] = (0.01, 0.99)
) -> DataFrame:
    """Residual tails by month and day of month.

    At most 366 rows, each with the distinct dates and stores behind it.
    """
    size = F.abs(F.col(residual))
    return (
        df.transform(quantile_tails, residual, *tails)
        .withColumns({"month": F.month("date"), "day_month": F.dayofmonth("date")})
        .groupBy("month", "day_month")
        .agg(
            F.count(F.lit(1)).alias("residual_count"),
            safe_log(F.sum(size)).alias("residual_sum"),
            safe_log(F.avg(size)).alias("residual_mean"),
            list_of("date", distinct=True).alias("dates"),
            list_of(store_col, distinct=True).alias("stores"),
        )
    )


def outlier_clusters(outliers: DataFrame, components: int = 3) -> DataFrame:
    """Mixture memberships and labels of the three residual measures.

    The outlier days, 366 at most, are checkpointed, so no fit starts from the
    facts again.
    """
    ensure_checkpoint_dir(outliers.sparkSession)
    outliers = outliers.checkpoint()
    for column in ("residual_sum", "residual_mean", "residual_count"):
        outliers = mixture_memberships(outliers, column, components, name=f"{column}_regimes", cluster=True)
    return outliers


def outlier_events(outliers: DataFrame, flags: DataFrame) -> DataFrame:
    """Names of events that fall on an outlier day (by month and day)."""
    names = struct_fields(flags, "holiday_bool")
    cells = unpivot_columns(flags.select("date", "holiday_bool.*"), ["date"], names)
    held = cells.where(F.col("value") == 1).select(
        F.month("date").alias("month"), F.dayofmonth("date").alias("day_month"), "variable"
    )
    return held.join(outliers.select("month", "day_month"), ["month", "day_month"], "left_semi").select("variable").distinct()
