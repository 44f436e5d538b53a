"""Supervised features of an hourly series: calendar, lags, rolling, Fourier, sequences, scaling."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peagelens.functions.calendar import epoch_days, time_features
from peagelens.operators.series import hourly_series, series_window
from peagelens.schema import FEATURE_LAGS, FEATURE_WINDOWS, SEASONS

TARGET = "nb_vehicules"


def with_time_features(series: DataFrame, at: str = "date") -> DataFrame:
    """Adds hour, weekday, day, month, weekend flag and cyclic codes."""
    kept = [c for c in series.columns if c not in _TIME_NAMES]
    return series.select(*kept, *time_features(F.col(at)))


_TIME_NAMES = (
    "heure", "jour_semaine", "jour_mois", "mois", "est_weekend",
    "heure_sin", "heure_cos", "mois_sin", "mois_cos",
)


def lag_columns(
    value: str, lags: Sequence[int], keys: Sequence[str] = (), at: str = "date"
) -> dict[str, Column]:
    in_time = series_window(keys, at)
    return {f"{value}_lag{k}": F.lag(value, k).over(in_time).cast("double") for k in lags}


def rolling_columns(
    value: str, windows: Sequence[int], keys: Sequence[str] = (), at: str = "date"
) -> dict[str, Column]:
    """Mean, sample deviation and maximum of the rows before; null until there are enough."""
    columns = {}
    for w in windows:
        frame = series_window(keys, at).rowsBetween(-w, -1)
        full = F.count(value).over(frame) == w
        for name, agg in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max)):
            rolled = F.when(full, agg(value).over(frame)).cast("double")
            columns[f"{value}_roll_{name}_{w}"] = rolled
    return columns


def add_lags_rolling(
    series: DataFrame,
    value: str,
    lags: Sequence[int],
    windows: Sequence[int],
    keys: Sequence[str] = (),
    at: str = "date",
) -> DataFrame:
    """Lags and rolling figures; rows without a full past are dropped.

    A second call on its own result replaces columns of the same name.
    """
    added = {**lag_columns(value, lags, keys, at), **rolling_columns(value, windows, keys, at)}
    return series.withColumns(added).dropna(how="any")


def feature_table(
    tx: DataFrame,
    lags: Sequence[int] = FEATURE_LAGS,
    windows: Sequence[int] = FEATURE_WINDOWS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Target, the number of known ids, and features per hour of the gap-free series."""
    series = hourly_series(tx, keys, "date", TARGET, "id_transaction")
    return add_lags_rolling(with_time_features(series), TARGET, lags, windows, keys)


def fourier_features(
    series: DataFrame,
    at: str = "ds",
    seasons: Sequence[tuple[str, float, int]] = SEASONS,
) -> DataFrame:
    """Sine and cosine columns ``<season>_sin_<k>`` and ``<season>_cos_<k>``."""
    days = epoch_days(F.col(at))
    waves = []
    for name, period, order in seasons:
        for k in range(1, order + 1):
            angle = days * (2.0 * math.pi * k / period)
            waves.append(F.sin(angle).alias(f"{name}_sin_{k}"))
            waves.append(F.cos(angle).alias(f"{name}_cos_{k}"))
    return series.select("*", *waves)


def sequences(
    series: DataFrame,
    columns: str | Sequence[str],
    length: int,
    target: str,
    keys: Sequence[str] = (),
    at: str = "ds",
) -> DataFrame:
    """The ``length`` rows before each row as array ``x``, and the row's target as ``y``.

    One column gives an array of values, several give an array of arrays. The
    first ``length`` rows of a series have no full past and are dropped.
    """
    if isinstance(columns, str):
        item = F.col(columns)
    else:
        item = F.array(*[F.col(c).cast("double") for c in columns])
    past = series_window(keys, at).rowsBetween(-length, -1)
    windows = series.withColumn("_x", F.collect_list(item).over(past))
    return windows.where(F.size("_x") == length).select(
        *keys, at, F.col("_x").alias("x"), F.col(target).alias("y")
    )


def minmax_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``<column>_min`` and ``<column>_max``."""
    bounds = []
    for c in columns:
        bounds.append(F.min(c).cast("double").alias(f"{c}_min"))
        bounds.append(F.max(c).cast("double").alias(f"{c}_max"))
    return df.agg(*bounds)


def minmax_scale(
    df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None
) -> DataFrame:
    """Scale columns to [0, 1] as ``<column>_scaled``; a constant column becomes 0.

    ``fit_on`` names the rows that give the bounds, such as the training part.
    """
    bounds = minmax_bounds(df if fit_on is None else fit_on, columns)
    span = bounds.select(F.struct(*bounds.columns)).scalar()
    scaled = {}
    for c in columns:
        low, high = span[f"{c}_min"], span[f"{c}_max"]
        width = F.when(high > low, high - low).otherwise(F.lit(1.0))
        scaled[f"{c}_scaled"] = (F.col(c).cast("double") - low) / width
    return df.withColumns(scaled)


def minmax_inverse(scaled: Column, low: Column | float, high: Column | float) -> Column:
    """Back from [0, 1] to the range of the fitted column."""
    return scaled * (high - low) + low
