"""A nonlinear model of the next hour: an echo-state network.

A fixed random reservoir carries a state from hour to hour; only a linear readout of that state is fitted. A state
forgets where it began, so the series is cut into pieces of ``SPAN`` hours that begin ``WARM`` hours early: pieces
are run side by side, and the readout comes from their summed Gram matrices, some thousand numbers whatever the length.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from peagelens.functions.calendar import epoch_days
from peagelens.operators.features import minmax_bounds
from peagelens.operators.forecast import error_metrics
from peagelens.operators.numeric import (
    Reservoir,
    echo_predictions,
    echo_roll_out,
    echo_sums,
    make_reservoir,
)
from peagelens.operators.series import chrono_split, last_rows
from peagelens.schema import FORECAST_HOURS, NOISE_STD, TRAIN_RATIO

#: Own hours of a piece, and hours before them that only warm the state.
SPAN, WARM = 672, 168
UNITS, PERIODS, RADIUS, LEAK, LINKS = 80, (24.0, 168.0), 0.9, 0.8, 8


@dataclass(frozen=True)
class EchoModel:
    """A reservoir, its readout over 1, the inputs and the states, and the bounds that scale the values."""

    reservoir: Reservoir
    readout: tuple[float, ...]
    low: float
    high: float


def _hour_number() -> Column:
    """Hours of the wall clock since 1970, whatever the session's time zone."""
    return F.round(epoch_days(F.col("ds")) * 24).cast("long").alias("hour")


def _pieces(series: DataFrame, low: float, high: float, warm: int) -> GroupedData:
    """Groups of scaled hours: a piece's own and the ``warm`` before it."""
    u = ((F.col("y") - low) / ((high - low) or 1.0)).alias("u")
    rows = series.select(_hour_number(), u).withColumn("home", F.floor(F.col("hour") / SPAN))
    late = F.col("hour") >= (F.col("home") + 1) * SPAN - warm

    def of(piece: Column, own: bool) -> Column:
        return F.struct(piece.alias("piece"), F.lit(own).alias("own"))

    both = F.array(of(F.col("home"), True), of(F.col("home") + 1, False))
    return rows.select("hour", "u", F.inline(F.when(late, both).otherwise(F.slice(both, 1, 1)))).groupBy("piece")


def fit_reservoir(
    series: DataFrame, reservoir: Reservoir | None = None, train_ratio: float = TRAIN_RATIO, ridge: float = 1e-6,
    warm: int = WARM, seed: int = 3,
) -> EchoModel:
    """Fit the readout to the first ``train_ratio`` of a gap-free series ``ds, y``; the series is read three times.

    ``ridge`` is per hour. The first ``warm`` hours only warm the state; with no hour beyond them an error is raised.
    ``warm`` is at most SPAN.
    """
    if not 0 < warm <= SPAN:
        raise ValueError(f"warm is {warm}, but must lie between 1 and {SPAN}")
    reservoir = reservoir or make_reservoir(UNITS, PERIODS, RADIUS, LEAK, LINKS, seed)
    early = chrono_split(series, at="ds", train=train_ratio, val=0.0).where(F.col("part") == "train")
    ends = minmax_bounds(early, ["y"]).first()
    if ends["y_min"] is None:
        raise ValueError("the series has no hours to fit on")
    low, high = float(ends["y_min"]), float(ends["y_max"])
    found = _pieces(early, low, high, warm).applyInPandas(echo_sums(reservoir, warm), "row int, sums array<double>")
    cells = found.select("row", F.posexplode("sums").alias("at", "x")).groupBy("row", "at").agg(F.sum("x").alias("x"))
    n = reservoir.n_features
    table = np.zeros((n + 1, n))
    for r in cells.toLocalIterator():
        table[r["row"], r["at"]] = r["x"]
    gram, moment = table[:n], table[n]
    if gram[0, 0] == 0:
        raise ValueError(f"no hours beyond the {warm} that warm the state")
    penalty = np.full(n, ridge * gram[0, 0])
    penalty[0] = 0.0
    readout = np.linalg.solve(gram + np.diag(penalty), moment)
    return EchoModel(reservoir, tuple(map(float, readout)), low, high)


def next_hour(series: DataFrame, model: EchoModel, train_ratio: float = TRAIN_RATIO, warm: int = WARM) -> DataFrame:
    """(ds, y, part, yhat) of each hour but the first ``warm``, told from the hours before it."""
    parted = chrono_split(series, at="ds", train=train_ratio, val=0.0)
    told = _pieces(parted, model.low, model.high, warm).applyInPandas(
        echo_predictions(model.reservoir, model.readout, warm), "hour long, v double"
    )
    width = (model.high - model.low) or 1.0
    yhat = F.greatest(F.col("v") * width + model.low, F.lit(0.0)).alias("yhat")
    return parted.select("ds", "y", "part", _hour_number()).join(told, "hour").select("ds", "y", "part", yhat)


def reservoir_metrics(series: DataFrame, model: EchoModel, train_ratio: float = TRAIN_RATIO) -> DataFrame:
    """Errors of the next hour over the hours after the first ``train_ratio``."""
    return error_metrics(next_hour(series, model, train_ratio).where(F.col("part") == "test"), "y", "yhat")


def reservoir_forecast(
    series: DataFrame, model: EchoModel, horizon: int = FORECAST_HOURS, noise_std: float = NOISE_STD, seed: int = 0,
    warm: int = WARM,
) -> DataFrame:
    """Next ``horizon`` hours ``hour, ds, predicted``; the last ``warm`` hours set the state, then each prediction is fed back.

    Noise acts on the values fed back, never on those returned. An empty series gives no rows.
    """
    tail = last_rows(series.select("ds", "y"), warm).select("ds", "y", _hour_number())
    roll = echo_roll_out(model.reservoir, model.readout, model.low, model.high, horizon, noise_std, seed)
    return tail.withColumn("_series", F.lit(0)).groupBy("_series").applyInPandas(
        roll, "hour int, ds timestamp_ntz, predicted double"
    )
