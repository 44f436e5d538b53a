"""The multiplicative fit against a planted series and a direct minimisation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peagelens.functions.calendar import epoch_days
from peagelens.operators import product
from peagelens.operators.numeric import _optimum, penalised, sparse_bends

SEASONS = (("daily", 1.0, 2), ("weekly", 7.0, 1))


def planted(hours):
    days = (pd.date_range("2024-01-01", periods=hours, freq="h") - pd.Timestamp("1970-01-01")).total_seconds() / 86400
    days, t = days.to_numpy(), np.arange(hours) / (hours - 1)
    trend = 200 + 150 * t - 260 * np.maximum(t - 0.32, 0) + 200 * np.maximum(t - 0.64, 0)
    season = 0.4 * np.sin(2 * np.pi * days) + 0.15 * np.cos(4 * np.pi * days) + 0.2 * np.sin(2 * np.pi * days / 7)
    return trend, season


def frame(spark, y):
    rows = pd.DataFrame({"ds": pd.date_range("2024-01-01", periods=len(y), freq="h"), "y": y})
    return spark.createDataFrame(rows).withColumn("ds", F.col("ds").cast("timestamp_ntz"))


def test_planted_product_is_recovered(spark):
    trend, season = planted(2400)
    y = trend * (1 + season) + np.random.default_rng(5).normal(0, 6, 2400)
    model = product.fit_product(frame(spark, y), SEASONS)
    got = product.product_parts(frame(spark, y), model).orderBy("ds").toPandas()
    assert np.mean(np.abs(got.yhat - trend * (1 + season)) / (trend * (1 + season))) < 0.01
    assert np.mean(np.abs(got.trend - trend) / trend) < 0.01
    assert np.abs(got.season - season).max() < 0.02
    assert model.noise == pytest.approx(6, rel=0.1)
    assert 1 <= len(model.bends) <= 4


def test_exact_product_has_no_bias(spark):
    """A log transform would miss the mean; here its error is that of rounding."""
    trend, season = planted(1200)
    model = product.fit_product(frame(spark, trend * (1 + season)), SEASONS)
    got = product.product_parts(frame(spark, trend * (1 + season)), model)
    assert got.agg(F.max(F.abs(F.col("yhat") / F.col("y") - 1))).first()[0] < 1e-4


def test_sums_do_not_depend_on_partitions(spark):
    trend, season = planted(600)
    series = frame(spark, trend * (1 + season))
    one, many = (product.fit_product(series.repartition(k), SEASONS) for k in (1, 7))
    assert one.waves == pytest.approx(many.waves, abs=1e-9)
    assert one.trend == pytest.approx(many.trend, abs=1e-6)


def test_odd_series(spark):
    empty = frame(spark, [1.0]).where("y > 1")
    assert product.fit_product(empty, SEASONS) is None
    one = product.fit_product(frame(spark, [7.0]), SEASONS)
    assert product.product_parts(frame(spark, [7.0]), one).first().yhat == pytest.approx(7, rel=0.05)
    gaps = frame(spark, [5.0, None, 5.0, 5.0]).withColumn("y", F.nanvl("y", F.lit(None)))
    model = product.fit_product(gaps.withColumn("trend_of_other", F.lit(1)), SEASONS)
    assert model.trend[0] > 0
    flat = product.fit_product(frame(spark, [0.0] * 50), SEASONS)
    assert flat.bends == () and product.product_parts(frame(spark, [0.0]), flat).first().yhat == pytest.approx(0)


def test_finish_of_the_descent_is_the_optimum():
    rng = np.random.default_rng(2)
    t = np.linspace(0, 1, 400)
    x = np.column_stack([np.ones(400), t, *[np.maximum(t - c, 0) for c in np.linspace(0, 0.8, 13)[1:]]])
    y = 3 + t - 4 * np.maximum(t - 0.4, 0) + rng.normal(0, 0.05, 400)
    gram, moment, ridge = x.T @ x, x.T @ y, np.full(14, 1e-4)
    bends, penalty = np.arange(2, 14), np.full(12, 0.3)
    best = sparse_bends(gram, moment, ridge, bends, penalty)
    least = penalised(best, gram, moment, ridge, bends, penalty)
    for _ in range(400):
        other = best + rng.normal(0, 10.0 ** rng.uniform(-6, 0), 14)
        assert penalised(other, gram, moment, ridge, bends, penalty) >= least - 1e-9
    assert _optimum(np.eye(2), np.array([5.0, 5.0]), np.ones(2), np.array([1.0, 0.0])) is None


def test_days_of_the_model_start_with_the_series(spark):
    series = frame(spark, [1.0, 2.0, 3.0])
    first = series.agg(F.min(epoch_days(F.col("ds")))).first()[0]
    assert product.fit_product(series, SEASONS).start == first
