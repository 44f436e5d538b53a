"""The echo-state reservoir against a plain loop, a linear model and a planted series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peagelens.operators import forecast, reservoir
from peagelens.operators.numeric import make_reservoir

SMALL = make_reservoir(12, (24.0,), 0.8, 0.6, 4, 1)


def frame(spark, y):
    rows = pd.DataFrame({"ds": pd.date_range("2024-01-01", periods=len(y), freq="h"), "y": y})
    return spark.createDataFrame(rows).withColumn("ds", F.col("ds").cast("timestamp_ntz"))


def henon(n):
    """A series that two hours decide, by a square: no linear model can follow it."""
    z = [0.1, 0.3]
    while len(z) < n:
        z.append(1 - 1.4 * z[-1] ** 2 + 0.3 * z[-2])
    return 600 + 400 * np.array(z)


def plain_features(y, low, high, res, first_hour):
    """Features of every next hour by one uncut loop, the state carried from the first hour on."""
    x, out = np.zeros(len(res.bias)), []
    for k, value in enumerate(y):
        angle = 2 * np.pi * (first_hour + k + 1) / np.array(res.periods)
        seen = [2 * (value - low) / (high - low) - 1, *np.sin(angle), *np.cos(angle)]
        drive = np.array(res.inner) @ x + np.array(res.inputs) @ seen + np.array(res.bias)
        x = (1 - res.leak) * x + res.leak * np.tanh(drive)
        out.append([1.0, *seen, *x])
    return np.array(out)


HOUR = int(pd.Timestamp("2024-01-01").timestamp() // 3600)


def test_readout_is_that_of_one_uncut_loop(spark):
    rng = np.random.default_rng(2)
    y = 200 + 80 * np.sin(np.arange(2000) / 4) + rng.normal(0, 10, 2000)
    model = reservoir.fit_reservoir(frame(spark, y), SMALL, ridge=1e-3)
    early = y[:1600]
    assert (model.low, model.high) == (early.min(), early.max())
    features = plain_features(early, early.min(), early.max(), SMALL, HOUR)[167:-1]
    target = (early[168:] - early.min()) / (early.max() - early.min())
    penalty = np.diag([0.0] + [1e-3 * len(target)] * (features.shape[1] - 1))
    readout = np.linalg.solve(features.T @ features + penalty, features.T @ target)
    assert np.allclose(model.readout, readout, atol=1e-8)
    told = reservoir.next_hour(frame(spark, y), model).orderBy("ds").toPandas()
    every = plain_features(y, model.low, model.high, SMALL, HOUR)[167:-1] @ np.array(model.readout)
    assert len(told) == 2000 - 168 and np.allclose(told.y, y[168:])
    assert np.allclose(told.yhat, np.maximum(every * (model.high - model.low) + model.low, 0), atol=1e-5)
    assert (told.part == "test").sum() == 400


def test_roll_out_is_that_of_a_plain_loop(spark):
    y = list(200 + 80 * np.sin(np.arange(700) / 4))
    model = reservoir.fit_reservoir(frame(spark, y), SMALL)
    got = reservoir.reservoir_forecast(frame(spark, y), model, horizon=30, noise_std=0.0).orderBy("hour").toPandas()
    tail, width, told = y[-168:], model.high - model.low, []
    for _ in range(30):
        v = plain_features(tail, model.low, model.high, SMALL, HOUR + 700 - 168)[-1] @ np.array(model.readout)
        told.append(max(v * width + model.low, 0))
        tail.append(min(max(v, 0), 1) * width + model.low)
    assert np.allclose(got.predicted, told) and list(got.hour) == list(range(30))
    assert got.ds[0] == pd.Timestamp("2024-01-01") + pd.Timedelta(hours=700)


def test_beats_the_linear_model_on_a_nonlinear_series(spark):
    series = frame(spark, henon(3000)).checkpoint()
    linear = forecast.autoregression_metrics(series, forecast.fit_autoregression(series)).first().rmse
    echo = reservoir.reservoir_metrics(series, reservoir.fit_reservoir(series)).first().rmse
    assert echo < 0.2 * linear


@pytest.mark.parametrize("y", [[], [5.0] * 100])
def test_too_short_series_is_an_error(spark, y):
    rows = spark.createDataFrame([], "ds timestamp_ntz, y double") if not y else frame(spark, y)
    with pytest.raises(ValueError):
        reservoir.fit_reservoir(rows, SMALL)


def test_level_series_stays_level(spark):
    series = frame(spark, [7.0] * 400)
    model = reservoir.fit_reservoir(series, SMALL)
    got = reservoir.reservoir_forecast(series, model, noise_std=0.0).toPandas()
    assert np.allclose(got.predicted, 7.0)
