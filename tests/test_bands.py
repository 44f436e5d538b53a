"""Sparse bends of the trend and bands that widen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peagelens.operators import forecast, numeric


def daily(days):
    return np.column_stack([f(2 * np.pi * k * days) for k in range(1, 11) for f in (np.sin, np.cos)])


@pytest.mark.parametrize("seed", range(4))
def test_two_breaks_give_few_bends(seed):
    rng = np.random.default_rng(seed)
    n = 2000
    t, days = np.arange(n) / n, 19_700 + np.arange(n) / 24
    trend = 100 + 60 * t - 150 * np.maximum(t - 0.32, 0) + 220 * np.maximum(t - 0.576, 0)
    fit = numeric.AdditiveFit(days, daily(days), trend + 8 * np.sin(2 * np.pi * days) + rng.normal(0, 2, n))
    bends = fit.beta[2 : 2 + numeric.CHANGEPOINTS]
    assert 2 <= np.count_nonzero(bends) <= 4
    assert np.abs(fit.trend(days) - trend).max() < 2.0
    assert fit.bend_rate == pytest.approx(np.count_nonzero(bends) / (0.8 * (n - 1)))
    assert 0 < fit.bend_size < 220 / n


@pytest.mark.parametrize("seed", range(3))
def test_descent_reaches_the_least_objective(seed):
    """Against a slow proximal gradient on all weights, which knows nothing of the reduction."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(200, 9)) @ rng.normal(size=(9, 9))
    y = x @ np.array([1, 0, 2, 0, 0, -1, 0, 0, 0.5]) + rng.normal(size=200)
    gram, moment, bends = x.T @ x, x.T @ y, np.array([1, 2, 4, 5, 7])
    ridge, penalty = rng.uniform(0.1, 2, 9), rng.uniform(5, 60, 5)
    found = numeric.sparse_bends(gram, moment, ridge, bends, penalty)
    square = np.where(np.isin(np.arange(9), bends), 0.0, ridge)
    step, beta = 1.0 / (np.linalg.eigvalsh(gram).max() + 2), np.zeros(9)
    for _ in range(300_000):
        beta = beta - step * (gram @ beta - moment + square * beta)
        beta[bends] = np.sign(beta[bends]) * np.maximum(np.abs(beta[bends]) - step * penalty, 0.0)
    want, got = (numeric.penalised(b, gram, moment, ridge, bends, penalty) for b in (beta, found))
    assert got <= want + 1e-6 and abs(got - want) < 1e-6
    assert (found[bends] == 0).any()


def test_series_without_bends_to_fit():
    days = np.array([19_700.0])
    fit = numeric.AdditiveFit(days, daily(days), np.array([4.0]))
    assert (fit.bend_rate, fit.bend_size) == (0.0, 0.0)
    assert fit.predict(days, daily(days)) == pytest.approx([4.0], abs=0.1)


def steps(spark, rate, size, noise, n=168, gares=("A", "B")):
    rows = [(g, k, rate, size, noise) for g in gares for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "gare string, step int, bend_rate double, bend_size double, noise double")


def test_band_widens_with_the_bends(spark):
    off = forecast.future_offsets(steps(spark, 0.05, 0.4, 2.0)).where("gare = 'A'").orderBy("step").collect()
    width = [r.off_upper - r.off_lower for r in off]
    assert len(off) == 168 and width[0] == pytest.approx(4 * 1.96, rel=0.25)
    assert width[167] > 5 * width[0] and width[80] < width[167]
    flat = forecast.future_offsets(steps(spark, 0.0, 0.4, 2.0)).orderBy("step").collect()
    assert max(r.off_upper - r.off_lower for r in flat) < 1.4 * 4 * 1.96
    again = forecast.future_offsets(steps(spark, 0.05, 0.4, 2.0).repartition(7)).where("gare = 'A'").orderBy("step").collect()
    assert again == off


def test_band_covers_a_walk_with_breaks(spark):
    """Held-out hours of 400 series whose slope breaks at the rate and size that the band is told."""
    rng = np.random.default_rng(5)
    off = {r.step: (r.off_lower, r.off_upper) for r in forecast.future_offsets(steps(spark, 0.05, 0.4, 2.0, gares=("A",))).collect()}
    inside = []
    for _ in range(400):
        slope = np.cumsum(np.where(rng.random(168) < 0.05, rng.laplace(0, 0.4, 168), 0.0))
        walk = np.concatenate([[0.0], np.cumsum(slope)[:-1]]) + rng.normal(0, 2.0, 168)
        inside += [off[k + 1][0] <= v <= off[k + 1][1] for k, v in enumerate(walk)]
    assert 0.9 <= np.mean(inside) <= 0.99


def test_station_fit_uses_the_widened_band(spark):
    from test_forecast import hourly

    n = 1200
    t = np.arange(n) / n
    y = 200 + 300 * t - 700 * np.maximum(t - 0.32, 0) + 900 * np.maximum(t - 0.576, 0) + np.random.default_rng(2).normal(0, 3, n)
    rows = forecast.extend_hours(hourly(spark, y, "A"), 168)
    fit = forecast.widened(forecast.fit_additive(rows, seasons=(("daily", 1.0, 3),)))
    ahead = fit.where(F.col("y").isNull()).orderBy("ds").collect()
    assert fit.count() == n + 168 and len(ahead) == 168
    width = [r.yhat_upper - r.yhat_lower for r in ahead]
    assert width[167] > 1.5 * width[0]
    past = fit.where(F.col("y").isNotNull()).first()
    assert past.yhat_upper - past.yhat_lower == pytest.approx(2 * 1.96 * past.noise)
