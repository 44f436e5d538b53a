"""Hourly series: sparse counts, gap filling, tails and splits.

Passages are first reduced to one row per key and hour. Every window below runs
on such a series, whose length is the number of hours in its range and does not
depend on the number of passages.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from peagelens.functions.calendar import days, hour_start, hours


def series_window(keys: Sequence[str], at: str = "ds") -> WindowSpec:
    """Rows of one series in time order; without keys the one network series."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(at)


def hourly_counts(
    tx: DataFrame,
    keys: Sequence[str] = (),
    at: str = "ds",
    count: str = "y",
    what: str | None = None,
) -> DataFrame:
    """Passages per hour, only hours that have any. Null times and keys are left out.

    ``what`` names a column whose known values are counted instead of rows.
    """
    kept = tx.where(F.col("date_heure").isNotNull())
    for key in keys:
        kept = kept.where(F.col(key).isNotNull())
    hour = hour_start(F.col("date_heure")).alias(at)
    return kept.groupBy(*keys, hour).agg(
        F.count(F.lit(1) if what is None else F.col(what)).alias(count)
    )


def fill_gaps(
    sparse: DataFrame, keys: Sequence[str] = (), at: str = "ds", count: str = "y"
) -> DataFrame:
    """One row for every hour from the first to the last of each series, 0 where empty.

    Each row is stretched to the hour before the next one, so no calendar is
    joined and each series keeps its own bounds.
    """
    following = F.lead(at).over(series_window(keys, at))
    bounded = sparse.withColumn("_last", F.coalesce(following - hours(1), F.col(at)))
    slots = bounded.withColumn("_slot", F.explode(F.sequence(at, "_last", hours(1))))
    value = F.when(F.col("_slot") == F.col(at), F.col(count)).otherwise(F.lit(0))
    return slots.select(*keys, F.col("_slot").alias(at), value.cast("bigint").alias(count))


def hourly_series(
    tx: DataFrame,
    keys: Sequence[str] = (),
    at: str = "ds",
    count: str = "y",
    what: str | None = None,
) -> DataFrame:
    """Gap-free passages per hour, see :func:`hourly_counts`."""
    return fill_gaps(hourly_counts(tx, keys, at, count, what), keys, at, count)


def last_rows(
    series: DataFrame, n: int, keys: Sequence[str] = (), at: str = "ds"
) -> DataFrame:
    """The ``n`` latest rows of each series."""
    if not keys:
        return series.orderBy(F.desc(at)).limit(n)
    latest_first = Window.partitionBy(*keys).orderBy(F.desc(at))
    ranked = series.withColumn("_rank", F.row_number().over(latest_first))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def last_days(
    series: DataFrame, n: int = 90, keys: Sequence[str] = (), at: str = "ds"
) -> DataFrame:
    """Rows within ``n`` days of the end of each series."""
    if not keys:
        return series.where(F.col(at) >= series.agg(F.max(at)).scalar() - days(n))
    end = F.max(at).over(Window.partitionBy(*keys))
    return series.withColumn("_end", end).where(F.col(at) >= F.col("_end") - days(n)).drop("_end")


def with_position(
    series: DataFrame, keys: Sequence[str] = (), at: str = "ds"
) -> DataFrame:
    """Adds ``_row`` (from 1) and ``_rows``, the length of the series."""
    in_time = series_window(keys, at)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    return series.withColumns(
        {"_row": F.row_number().over(in_time), "_rows": F.count(F.lit(1)).over(whole)}
    )


def rows_of_share(total: Column, ratio: float) -> Column:
    """``int(total * ratio)``."""
    return F.floor(total * F.lit(float(ratio))).cast("bigint")


def chrono_split(
    series: DataFrame,
    keys: Sequence[str] = (),
    at: str = "ds",
    train: float = 0.70,
    val: float = 0.15,
    name: str = "part",
) -> DataFrame:
    """Label rows ``train``, ``val`` or ``test`` in time order. ``val=0`` gives two parts."""
    placed = with_position(series, keys, at)
    n_train = rows_of_share(F.col("_rows"), train)
    n_val = rows_of_share(F.col("_rows"), val)
    part = (
        F.when(F.col("_row") <= n_train, "train")
        .when(F.col("_row") <= n_train + n_val, "val")
        .otherwise("test")
    )
    return placed.withColumn(name, part).drop("_row", "_rows")


def series_stats(
    series: DataFrame, keys: Sequence[str] = ("gare",), train_ratio: float = 0.8
) -> DataFrame:
    """Range, length, and mean, deviation and maximum of each series."""
    return series.groupBy(*keys).agg(
        F.min("ds").alias("data_start"),
        F.max("ds").alias("data_end"),
        F.count(F.lit(1)).alias("n_hours"),
        rows_of_share(F.count(F.lit(1)), train_ratio).alias("n_hours_train"),
        F.avg("y").alias("y_mean"),
        F.stddev_samp("y").alias("y_std"),
        F.max("y").alias("y_max"),
    )
