"""Forecasts of hourly series, and their errors.

Series are built, extended and given their Fourier columns by Spark. A grouped
function then sees one aggregated series at a time: its rows are hours, never
passages.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peagelens.functions.calendar import days, epoch_days, hours
from peagelens.functions.scalars import clip, half_even, slug
from peagelens.operators.numeric import (
    CHANGEPOINT_PRIOR,
    fit_series,
    roll_out,
)
from peagelens.operators.features import (
    TARGET,
    feature_table,
    fourier_features,
    minmax_bounds,
    minmax_scale,
    sequences,
)
from peagelens.operators.product import fit_product, product_parts
from peagelens.operators.series import (
    chrono_split,
    hourly_counts,
    hourly_series,
    last_rows,
    series_stats,
    series_window,
)
from peagelens.schema import (
    BAND_Z,
    CAP_FACTOR,
    FORECAST_HOURS,
    HISTORY_HOURS,
    LOOKBACK_HOURS,
    NOISE_SHARE,
    NOISE_STD,
    SEASONS,
    TRAIN_RATIO,
)
from peagelens.session import settle

MAPE_EPSILON = 1e-8


def error_metrics(
    df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE and MAPE of any prediction column; a zero truth is kept by a tiny offset."""
    miss = F.col(truth) - F.col(predicted)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        (F.avg(F.abs(miss / (F.col(truth) + MAPE_EPSILON))) * 100.0).alias("mape"),
    )


def holdout(
    series: DataFrame, keys: Sequence[str] = (), at: str = "ds", ratio: float = TRAIN_RATIO
) -> DataFrame:
    """Rows after the first ``ratio`` of each series."""
    return chrono_split(series, keys, at, ratio, 0.0).where(F.col("part") == "test").drop("part")


def lag_forecast_metrics(
    tx: DataFrame, lag: int = LOOKBACK_HOURS, keys: Sequence[str] = ("gare",)
) -> DataFrame:
    """Hold-out errors of the simplest forecast: the value ``lag`` hours before."""
    series = hourly_series(tx, keys)
    naive = F.lag("y", lag).over(series_window(keys)).cast("double")
    test = holdout(series.withColumn("yhat", naive), keys).where(F.col("yhat").isNotNull())
    return error_metrics(test, "y", "yhat", keys)


# --- one additive model per series -------------------------------------------------


_FIT_COLUMNS = ("yhat", "yhat_lower", "yhat_upper", "yhat_holdout", "trend", "noise", "bend_rate", "bend_size")
#: Futures drawn for each station to find its band.
DRAWS = 400


def fit_additive(
    rows: DataFrame,
    keys: Sequence[str] = ("gare",),
    seasons: Sequence[tuple[str, float, int]] = SEASONS,
    train_ratio: float = TRAIN_RATIO,
) -> DataFrame:
    """Fit each series and predict all its rows; rows with null ``y`` are the future.

    Adds the prediction with its 95 % band, the prediction of a fit on the first
    ``train_ratio`` for the rows after it, the trend and seasonal parts, and the noise, bends an
    hour and mean size of a bend. The trend has at most 25 bends, or one less than a series has
    hours, of which few are used; a series of a single hour has no hold-out prediction. The band is
    that of the noise; see :func:`widened` for the future.
    """
    names = [name for name, _, _ in seasons]
    kept = [*keys, "ds", "y"]
    wide = fourier_features(rows.select(*kept), "ds", seasons).withColumn(
        "_days", epoch_days(F.col("ds"))
    )
    key_types = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    numbers = ", ".join(f"{c} double" for c in [*_FIT_COLUMNS, *names])
    schema = f"{key_types}ds timestamp_ntz, y double, {numbers}"
    wide = wide.withColumn("y", F.col("y").cast("double"))
    return wide.groupBy(*keys).applyInPandas(fit_series(list(keys), names, train_ratio), schema)


def extend_hours(series: DataFrame, n: int, keys: Sequence[str] = ("gare",)) -> DataFrame:
    """The series and ``n`` further hours with null ``y``."""
    ends = series.groupBy(*keys).agg(F.max("ds").alias("_end"))
    end = F.col("_end")
    future = F.sequence(end + hours(1), end + hours(n), hours(1))
    rows = ends.select(*keys, F.explode(future).alias("ds"), F.lit(None).cast("bigint").alias("y"))
    return series.select(*keys, "ds", "y").unionByName(rows)


def station_fit(tx: DataFrame, horizon: int = FORECAST_HOURS) -> DataFrame:
    """Fitted history and future of every station, settled in the shared folder.

    Several results are read from it, so neither the passages are scanned nor
    the models fitted again.
    """
    series = settle(hourly_series(tx, ["gare"]), "station-series")
    return settle(fit_additive(extend_hours(series, horizon)), "station-fit")


def _uniform(digest: Column, first: int) -> Column:
    """A number above 0 and below 1 from 12 hexadecimal digits."""
    return (F.conv(F.substring(digest, first, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def future_offsets(
    future: DataFrame, keys: Sequence[str] = ("gare",), draws: int = DRAWS, seed: int = 0
) -> DataFrame:
    """``off_lower, off_upper`` for each row of ``future``: the 2.5 % and 97.5 % quantiles of drawn deviations.

    future has the keys (texts), ``step`` (1 for the first hour ahead), ``bend_rate``, ``bend_size`` and
    ``noise``. In each draw every hour may bend the trend, at the rate of the fitted bends and with a
    Laplace size of their mean; the slopes add up, so the band widens with the distance. Draws depend
    only on seed, key, number and hour. A window sees one draw of one series.
    """
    drawn = future.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    told = F.concat_ws("|", F.lit(f"bend|{seed}"), *keys, F.col("draw").cast("string"), F.col("step").cast("string"))
    digest = F.md5(told.cast("binary"))
    side = _uniform(digest, 13) - 0.5
    size = -F.col("bend_size") * F.signum(side) * F.log(1.0 - 2.0 * F.abs(side))
    bend = F.when(_uniform(digest, 1) < F.col("bend_rate"), size).otherwise(0.0)
    run = Window.partitionBy(*keys, "draw").orderBy("step")
    until = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    noise = F.col("noise") * normal_noise(seed, *map(F.col, keys), F.col("draw").cast("string"), F.col("step").cast("string"))
    moved = drawn.withColumn("slope", F.sum(bend).over(until))
    moved = moved.withColumn("off", F.coalesce(F.sum("slope").over(before), F.lit(0.0)) + noise)
    return moved.groupBy(*keys, "step").agg(
        F.percentile("off", 0.025).alias("off_lower"), F.percentile("off", 0.975).alias("off_upper")
    )


def widened(fit: DataFrame, keys: Sequence[str] = ("gare",), draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """The fit with the band of its future rows taken from drawn futures, see :func:`future_offsets`."""
    ahead = fit.where(F.col("y").isNull()).withColumn("step", F.row_number().over(series_window(keys)))
    offsets = future_offsets(ahead.select(*keys, "step", "bend_rate", "bend_size", "noise"), keys, draws, seed)
    bands = ahead.join(offsets, [*keys, "step"]).withColumns(
        {"yhat_lower": F.col("yhat") + F.col("off_lower"), "yhat_upper": F.col("yhat") + F.col("off_upper")}
    )
    return fit.where(F.col("y").isNotNull()).unionByName(bands.select(*fit.columns))


def lag_band(
    series: DataFrame, bend_rate: float, bend_size: float, lag: int = LOOKBACK_HOURS, draws: int = DRAWS, seed: int = 0
) -> DataFrame:
    """The next ``lag`` hours of each station repeat the last ones, with the band of drawn futures of given bends."""
    last = last_rows(series, lag, ["gare"])
    ahead = last.select("gare", (F.col("ds") + hours(lag)).alias("ds"), F.col("y").cast("double").alias("yhat"))
    noise = series.groupBy("gare").agg(F.stddev_samp("y").alias("noise"))
    ahead = ahead.withColumn("step", F.row_number().over(series_window(["gare"]))).join(noise, "gare")
    told = ahead.withColumns({"bend_rate": F.lit(bend_rate), "bend_size": F.lit(bend_size)})
    offsets = future_offsets(told.select("gare", "step", "bend_rate", "bend_size", "noise"), draws=draws, seed=seed)
    return ahead.join(offsets, ["gare", "step"]).select(
        "gare", "ds", "step", "yhat",
        (F.col("yhat") + F.col("off_lower")).alias("yhat_lower"), (F.col("yhat") + F.col("off_upper")).alias("yhat_upper"),
    )


def normal_noise(seed: int, *parts: Column) -> Column:
    """A standard normal number that depends only on the seed and the given texts.

    Two uniform numbers are taken from an MD5 digest and turned by the Box-Muller rule,
    so a task that runs again draws the same, and SQL can draw it too.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))

    def uniform(first: int) -> Column:
        return F.conv(F.substring(digest, first, 12), 16, 10).cast("double")

    size = float(1 << 48)
    radius = F.sqrt(F.lit(-2.0) * F.log((uniform(1) + 1.0) / size))
    return radius * F.cos(F.lit(2.0 * math.pi) * (uniform(13) / size))


def finish_forecast(
    future: DataFrame, noise_std: float = NOISE_STD, seed: int = 0
) -> DataFrame:
    """Rounded future hours with a 95 % band, clipped to ``[0, cap]``.

    ``future`` has gare, ds, yhat, yhat_lower, yhat_upper, y_std and cap. The same noise,
    scaled to the station's deviation, is added to prediction and band; ``noise_std=0``
    adds none.
    """
    scale = F.coalesce("y_std", F.lit(0.0)) * (noise_std * NOISE_SHARE)
    when = F.date_format("ds", "yyyy-MM-dd HH:mm:ss")
    noise = normal_noise(seed, F.col("gare"), when) * scale if noise_std else F.lit(0.0)

    def noisy(name: str) -> Column:
        return half_even(clip(F.col(name) + noise, 0.0, F.col("cap")), 2)

    return future.select(
        "gare",
        F.col("ds").alias("datetime"),
        noisy("yhat").alias("predicted"),
        noisy("yhat_lower").alias("lower_95"),
        noisy("yhat_upper").alias("upper_95"),
    )


def station_limits(history: DataFrame) -> DataFrame:
    """Deviation and upper limit of each station's series ``gare, y``."""
    return history.groupBy("gare").agg(
        F.stddev_samp("y").alias("y_std"), (F.max("y") * CAP_FACTOR).alias("cap")
    )


def station_forecast(
    fit: DataFrame, noise_std: float = NOISE_STD, seed: int = 0
) -> DataFrame:
    """Future hours per station with a band that widens, see :func:`widened` and :func:`finish_forecast`."""
    limits = station_limits(fit.where(F.col("y").isNotNull()))
    future = widened(fit).where(F.col("y").isNull()).join(limits, "gare")
    return finish_forecast(future, noise_std, seed)


def lag_forecast(
    series: DataFrame, lag: int = LOOKBACK_HOURS, noise_std: float = NOISE_STD, seed: int = 0
) -> DataFrame:
    """The next ``lag`` hours of each station repeat the last ones, with noise, a band of
    one deviation, and the usual limits: the simplest forecast in its final form."""
    last = last_rows(series, lag, ["gare"])
    ahead = last.select("gare", (F.col("ds") + hours(lag)).alias("ds"), F.col("y").cast("double").alias("yhat"))
    bands = ahead.join(station_limits(series), "gare").withColumns(
        {"yhat_lower": F.col("yhat") - F.col("y_std"), "yhat_upper": F.col("yhat") + F.col("y_std")}
    )
    return finish_forecast(bands, noise_std, seed)


def station_metrics(fit: DataFrame) -> DataFrame:
    """Hold-out errors per station, rounded as reports show them."""
    tested = fit.where(F.col("yhat_holdout").isNotNull())
    errors = error_metrics(tested, "y", "yhat_holdout", ["gare"])
    return errors.select(
        "gare",
        "n_test",
        half_even(F.col("mae"), 3).alias("mae"),
        half_even(F.col("rmse"), 3).alias("rmse"),
        half_even(F.col("mape"), 2).alias("mape"),
    )


def station_components(fit: DataFrame, history: int = 90) -> DataFrame:
    """Actual, predicted, band and parts from ``history`` days before the end of history."""
    ends = fit.where(F.col("y").isNotNull()).groupBy("gare").agg(F.max("ds").alias("_end"))
    recent = F.col("ds") >= F.col("_end") - days(history)
    seasons = [name for name, _, _ in SEASONS]
    return widened(fit).join(ends, "gare").where(recent).select(
        "gare", "ds", "y", "yhat", "yhat_lower", "yhat_upper", "trend", *seasons
    )


def model_registry(
    fit: DataFrame, horizon: int = FORECAST_HOURS, noise_std: float = NOISE_STD
) -> DataFrame:
    """One record per station: name, settings, data range and errors."""
    history = fit.where(F.col("y").isNotNull()).select("gare", "ds", "y")
    stats = series_stats(history, ["gare"], TRAIN_RATIO)
    orders = F.struct(*[F.lit(order).alias(name) for name, _, order in SEASONS])
    safe = slug(F.col("gare"))
    return stats.join(station_metrics(fit), "gare", "left").select(
        F.concat(F.lit("additive_gare_"), safe).alias("name"),
        "gare",
        safe.alias("gare_safe"),
        F.lit("additive_sparse").alias("model_type"),
        F.lit(horizon).alias("future_hours"),
        F.lit(float(noise_std)).alias("noise_std"),
        F.lit(TRAIN_RATIO).alias("train_ratio"),
        F.lit("additive").alias("seasonality_mode"),
        F.lit(CHANGEPOINT_PRIOR).alias("changepoint_prior_scale"),
        orders.alias("fourier_orders"),
        "data_start",
        "data_end",
        "n_hours_train",
        half_even(F.col("y_mean"), 3).alias("y_mean"),
        half_even(F.col("y_std"), 3).alias("y_std"),
        half_even(F.col("y_max").cast("double"), 3).alias("y_max"),
        F.struct("mae", "rmse", "mape").alias("metrics"),
    )


def registry_index(registry: DataFrame) -> DataFrame:
    """The short form of the registry: where each station's model stands."""
    return registry.select("gare", "name", "future_hours", "noise_std", "metrics")


GLOBAL_SEASONS = (("daily", 1.0, 4), ("weekly", 7.0, 3), ("yearly", 365.25, 10))


def global_forecast(
    tx: DataFrame, periods: int = 30, step: str = "INTERVAL '1' DAY", draws: int = DRAWS, seed: int = 0
) -> DataFrame:
    """The network's next ``periods`` steps with multiplicative seasons and a 95 % band.

    Fitted to the known ids of the hours that have passages, see :func:`fit_product`; only sums of the size
    of the model come to the driver. The band comes from drawn futures of :func:`future_offsets`,
    with the chance and the size of a bend taken for a whole step. No passages give no rows.
    """
    series = settle(hourly_counts(tx, what="id_transaction"), "network-series")
    one = F.expr(step)
    last = series.agg(F.max("ds").alias("_end")).where(F.col("_end").isNotNull())
    steps = F.sequence(F.col("_end") + one, F.col("_end") + one * periods, one)
    future = last.select(F.posexplode(steps).alias("step", "ds")).select((F.col("step") + 1).alias("step"), "ds")
    model = fit_product(series, GLOBAL_SEASONS)
    if model is None:
        nothing = F.lit(None).cast("double")
        return future.select("ds", *[nothing.alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")])

    ahead = product_parts(future, model).select("step", "ds", "season", "yhat")
    wide = F.unix_micros((F.lit("1970-01-01").cast("timestamp_ntz") + one).cast("timestamp"))
    hours_a_step = (wide - F.unix_micros(F.lit("1970-01-01").cast("timestamp_ntz").cast("timestamp"))) / 3.6e9
    told = future.select(
        F.lit("network").alias("series"),
        "step",
        F.least(model.bend_rate * hours_a_step, F.lit(1.0)).alias("bend_rate"),
        (model.bend_size * hours_a_step).alias("bend_size"),
        F.lit(model.noise).alias("noise"),
    )
    offsets = future_offsets(told, ["series"], draws, seed)
    return ahead.join(offsets, "step").select(
        "ds", "yhat",
        (F.col("yhat") + F.col("off_lower")).alias("yhat_lower"), (F.col("yhat") + F.col("off_upper")).alias("yhat_upper"),
    )


# --- autoregressive roll-out --------------------------------------------------------


@dataclass(frozen=True)
class AutoRegression:
    """A linear model of the next hour: one weight per lag, on values scaled by ``low, high``."""

    weights: tuple[float, ...]
    bias: float
    low: float
    high: float


def fit_autoregression(
    series: DataFrame,
    lookback: int = LOOKBACK_HOURS,
    train_ratio: float = TRAIN_RATIO,
    ridge: float = 0.01,
) -> AutoRegression:
    """Fit on the first ``train_ratio`` of the windows of a gap-free series ``ds, y``.

    Values are scaled by the bounds of the first ``train_ratio`` of the hours. Settle the
    series first, it is read several times. The fit is distributed over the windows; only
    the weights come to the driver.
    """
    hours_known = series.count()
    if int((hours_known - lookback) * train_ratio) < 1:
        raise ValueError(f"{hours_known} hours are too few to fit on windows of {lookback}")
    early = chrono_split(series, at="ds", train=train_ratio, val=0.0).where(F.col("part") == "train")
    scaled = minmax_scale(series, ["y"], early)
    labelled = chrono_split(
        sequences(scaled, "y_scaled", lookback, "y_scaled"), at="ds", train=train_ratio, val=0.0
    )
    train = labelled.where(F.col("part") == "train")
    model = LinearRegression(
        featuresCol="features", labelCol="y", solver="normal", regParam=ridge,
        elasticNetParam=0.0, standardization=False,
    ).fit(train.select(array_to_vector("x").alias("features"), "y"))
    ends = minmax_bounds(early, ["y"]).first()
    weights = tuple(float(w) for w in model.coefficients)
    return AutoRegression(weights, float(model.intercept), ends["y_min"], ends["y_max"])


def autoregression_metrics(
    series: DataFrame, model: AutoRegression, train_ratio: float = TRAIN_RATIO
) -> DataFrame:
    """Errors of the next hour's prediction over the windows after the first ``train_ratio``."""
    windows = sequences(series, "y", len(model.weights), "y")
    test = chrono_split(windows, at="ds", train=train_ratio, val=0.0).where(F.col("part") == "test")
    width = (model.high - model.low) or 1.0
    weighted = F.zip_with(
        "x", F.array(*map(F.lit, model.weights)), lambda x, w: (x - model.low) / width * w
    )
    ahead = F.aggregate(weighted, F.lit(model.bias), lambda a, v: a + v) * width + model.low
    return error_metrics(test.withColumn("yhat", F.greatest(ahead, F.lit(0.0))), "y", "yhat")


def autoregressive_forecast(
    series: DataFrame,
    model: AutoRegression,
    horizon: int = FORECAST_HOURS,
    noise_std: float = NOISE_STD,
    seed: int = 0,
) -> DataFrame:
    """Next ``horizon`` hours of the network series ``ds, y``, hour by hour.

    Only the last hours the model looks at leave the series. Noise acts on the
    values fed back, never on those returned.
    """
    tail = last_rows(series.select("ds", "y"), len(model.weights))
    roll = roll_out(
        np.array(model.weights), model.bias, model.low, model.high, horizon, noise_std, seed
    )
    return tail.withColumn("_series", F.lit(0)).groupBy("_series").applyInPandas(
        roll, "hour int, ds timestamp_ntz, predicted double"
    )


def forecast_rows(forecast: DataFrame) -> DataFrame:
    """Hour number, time and whole predicted vehicles."""
    whole = F.rint("predicted").cast("bigint")
    return forecast.select("hour", F.col("ds").alias("date"), whole.alias("predicted_vehicles"))


def forecast_summary(
    forecast: DataFrame, noise_std: float = NOISE_STD, lookback: int = LOOKBACK_HOURS
) -> DataFrame:
    """Settings and whole mean, minimum and maximum of a forecast."""
    return forecast.agg(
        F.count(F.lit(1)).alias("future_hours"),
        F.lit(float(noise_std)).alias("noise_std"),
        F.lit(lookback).alias("lookback_hours"),
        F.rint(F.avg("predicted")).cast("bigint").alias("mean_prediction"),
        F.rint(F.min("predicted")).cast("bigint").alias("min_prediction"),
        F.rint(F.max("predicted")).cast("bigint").alias("max_prediction"),
    )


def with_history(
    series: DataFrame, forecast: DataFrame, hours: int = HISTORY_HOURS
) -> DataFrame:
    """The last ``hours`` of history and the forecast as labelled rows of one frame."""
    past = last_rows(series, hours).select(
        F.lit("history").alias("kind"), "ds", F.col("y").cast("double").alias("value")
    )
    ahead = forecast.select(
        F.lit("forecast").alias("kind"), "ds", F.col("predicted").alias("value")
    )
    return past.unionByName(ahead)


# --- regression on the feature table ------------------------------------------------


def _regression_rows(table: DataFrame) -> DataFrame:
    """``part``, ``y`` and the feature vector of a split feature table."""
    inputs = [c for c in table.columns if c not in ("date", TARGET, "part")]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(
        table.select("part", F.col(TARGET).cast("double").alias("y"), *inputs)
    )


def regress_hourly(tx: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> DataFrame:
    """Errors of a random forest on the feature table, for the validation and test parts."""
    ready = _regression_rows(settle(chrono_split(feature_table(tx), at="date"), "features"))
    forest = RandomForestRegressor(
        featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed
    ).fit(ready.where(F.col("part") == "train"))
    scored = forest.transform(ready.where(F.col("part") != "train"))
    return error_metrics(scored, "y", "prediction", ["part"])


def fit_boosted(
    ready: DataFrame, most: int = 40, depth: int = 4, rate: float = 0.2, patience: float = 0.01, seed: int = 7
) -> GBTRegressionModel:
    """Boosted trees of rows ``part, y, features`` whose number the validation part chooses.

    Trees are grown on the ``train`` rows one after the other; growing ends at ``most``, or when a tree
    lowers the squared error on the ``val`` rows by less than the share ``patience``, and the trees after the
    best number are dropped. Other parts are not read. Without ``val`` rows all ``most`` trees stay.
    """
    marked = ready.where(F.col("part").isin("train", "val")).withColumn("_held", F.col("part") == "val")
    trees = GBTRegressor(
        featuresCol="features", labelCol="y", maxIter=most, maxDepth=depth, stepSize=rate, seed=seed,
        validationTol=patience,
    )
    if not marked.where("_held").isEmpty():
        trees = trees.setValidationIndicatorCol("_held")
    return trees.fit(marked)


def regress_boosted(tx: DataFrame, most: int = 40, depth: int = 4, seed: int = 7) -> DataFrame:
    """Errors of boosted trees on the feature table for the validation and test parts, and their number ``trees``.

    The validation part decides when growing ends, see :func:`fit_boosted`; the test part is only scored.
    """
    ready = _regression_rows(settle(chrono_split(feature_table(tx), at="date"), "features"))
    model = fit_boosted(ready, most, depth, seed=seed)
    scored = model.transform(ready.where(F.col("part") != "train"))
    return error_metrics(scored, "y", "prediction", ["part"]).withColumn("trees", F.lit(model.getNumTrees))
