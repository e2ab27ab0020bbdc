"""Moving windows, ensembles and summaries of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.quantiles import bounded_quantile, sorted_quantiles
from tidegrid.functions.sizing import calendar_side
from tidegrid.functions.stats import correlation_t, pearson, t_pvalue


def centred_mean(df: DataFrame, keys: list[str], width: int = 3, x: str = "month_idx", value: str = "value") -> DataFrame:
    """Centred moving mean along an integer axis; NULL where the window is incomplete."""
    half = width // 2
    w = Window.partitionBy(*keys).orderBy(x).rangeBetween(-half, width - 1 - half)
    return df.withColumn(value, F.when(F.count(value).over(w) == width, F.avg(value).over(w)))


def trailing_sum(df: DataFrame, keys: list[str], width: int = 24, x: str = "month_idx", value: str = "value") -> DataFrame:
    """Sum of the last ``width`` steps; NULL until all are there."""
    w = Window.partitionBy(*keys).orderBy(x).rangeBetween(1 - width, 0)
    return df.withColumn(value, F.when(F.count(value).over(w) == width, F.sum(value).over(w)))


def fill_gaps(df: DataFrame, keys: list[str], x: str = "lat", value: str = "value") -> DataFrame:
    """Linear interpolation of NULLs in coordinate space, never beyond the outermost values."""
    back = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(x).rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(value).alias("v")))
    df = df.withColumns({"_l": F.last(point, True).over(back), "_r": F.first(point, True).over(ahead)})
    share = F.try_divide(F.col(x) - F.col("_l.x"), F.col("_r.x") - F.col("_l.x"))
    between = F.col("_l.v") + share * (F.col("_r.v") - F.col("_l.v"))
    return df.withColumn(value, F.coalesce(F.col(value), between)).drop("_l", "_r")


def gradient(df: DataFrame, keys: list[str], x: str = "lon", value: str = "value") -> DataFrame:
    """Second-order derivative estimate on uneven spacing, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(x)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    hs, hd = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    here = F.col(value)
    central = F.try_divide(hs * hs * after + (hd * hd - hs * hs) * here - hd * hd * before, hs * hd * (hs + hd))
    return df.withColumn("gradient", F.when(hs.isNull(), F.try_divide(after - here, hd)).when(hd.isNull(), F.try_divide(here - before, hs)).otherwise(central))


def band_difference(df: DataFrame, by: list[str], first: tuple[float, float], second: tuple[float, float], axis: str = "lat") -> DataFrame:
    """Mean of one coordinate band minus the mean of another."""
    def mean(band):
        return F.avg(F.when(F.col(axis).between(*band), F.col("value")))

    return df.groupBy(*by).agg((mean(first) - mean(second)).alias("difference"))


# -- folds ---------------------------------------------------------------------------------


def fold_axis(df: DataFrame, n_folds: int = 5) -> DataFrame:
    """Fold of each month: every ``n_folds``-th month of the time axis belongs to the same one.

    Only the axis is ranked (one row per month of the calendar), not the table.
    """
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("month_idx")) - 1
    return df.select("month_idx").distinct().select("month_idx", (rank % n_folds).cast("int").alias("fold"))


def assign_folds(df: DataFrame, n_folds: int = 5) -> DataFrame:
    return df.join(calendar_side(fold_axis(df, n_folds)), "month_idx")


def training_folds(df: DataFrame, n_folds: int = 5) -> DataFrame:
    """All leave-one-fold-out samples in one table: ``split`` is the fold left out."""
    return df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).filter(F.col("split") != F.col("fold"))


def resplit_training(df: DataFrame, n_batches: int = 4) -> DataFrame:
    """Batch number of each training month inside its split: every ``n_batches``-th month again."""
    axis = df.select("split", "month_idx").distinct()
    order = Window.partitionBy("split").orderBy("month_idx")
    ranked = axis.withColumn("batch", ((F.row_number().over(order) - 1) % n_batches).cast("int"))
    return df.join(ranked, ["split", "month_idx"])


# -- ensembles -----------------------------------------------------------------------------


def ensemble_mean(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("value").alias("value"))


def ensemble_band(df: DataFrame, by: list[str], level: float = 0.05, member: str = "initialization") -> DataFrame:
    """Mean and central ``1 - level`` band over the fits of an ensemble.

    Reduced to one value per fit first, so a group is as large as the ensemble.
    """
    one = df.groupBy(*by, member).agg(F.avg("value").alias("value"))
    return one.groupBy(*by).agg(
        F.avg("value").alias("mean"),
        bounded_quantile("value", level / 2).alias("lower"),
        bounded_quantile("value", 1 - level / 2).alias("upper"),
    )


def stitch_folds(val: DataFrame, test: DataFrame, by: list[str]) -> DataFrame:
    """Held-out folds side by side, the test period averaged over the splits."""
    cols = [*by, "month_idx"]
    return val.select(*cols, "value").unionByName(test.groupBy(*cols).agg(F.avg("value").alias("value")))


def centred_indices(parts: dict[str, DataFrame]) -> DataFrame:
    """Benchmark index set: labelled series, each minus its own time mean."""
    rows = None
    for name, df in parts.items():
        part = df.filter(F.col("value").isNotNull()).select(F.lit(name).alias("mode"), "month_idx", "value")
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("mode")))


# -- summaries -----------------------------------------------------------------------------


def distribution(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean, median and extremes, as a violin shows them; exact for groups of any size."""
    median = sorted_quantiles(df, by, value, [0.5]).select(*by, F.col("quantile").alias("median"))
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).join(median, by)


def symmetric_range(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Colour limits symmetric about zero."""
    return df.groupBy(*by).agg(F.greatest(F.abs(F.min(value)), F.abs(F.max(value))).alias("limit"))


def correlation(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*by).agg(pearson(a, b).alias("r"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"))


def plateau_test(metrics: DataFrame, keys: list[str], patience: int, x: str = "epoch", value: str = "value") -> DataFrame:
    """Trend of the last ``patience`` moving means of a metric: slope and its p-value."""
    w = Window.partitionBy(*keys).orderBy(x).rowsBetween(0, patience - 1)
    back = Window.partitionBy(*keys).orderBy(F.col(x).desc())
    means = metrics.withColumns({"_m": F.avg(value).over(w), "_k": F.row_number().over(back)})
    # windows that start in the stretch before the last `patience` steps
    used = means.filter(F.col("_k").between(patience + 1, 2 * patience)).withColumn("_i", 2 * patience - F.col("_k"))
    fit = used.groupBy(*keys).agg(
        F.regr_slope("_m", "_i").alias("slope"), pearson("_m", "_i").alias("r"), F.count("*").alias("n")
    )
    p = t_pvalue(correlation_t(F.col("r"), F.col("n")), F.col("n") - 2)
    return fit.select(*keys, "slope", "n", p.alias("p_value"))


def best_step(metrics: DataFrame, keys: list[str], x: str = "epoch", value: str = "value") -> DataFrame:
    """Step with the lowest metric, the first one on ties."""
    return metrics.groupBy(*keys).agg(F.min_by(x, F.struct(value, x)).alias(x), F.min(value).alias(value))


def ranked(df: DataFrame, by: list[str], order: Column, labels: tuple[str, ...] = ()) -> DataFrame:
    """Rank 1.. inside each group, with optional labels by rank."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return out.withColumn("label", F.try_element_at(F.lit(list(labels)), F.col("rank"))) if labels else out
