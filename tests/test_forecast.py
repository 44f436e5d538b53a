from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from peagelens.operators import features, forecast, series
from peagelens.operators.numeric import roll_out
from peagelens.schema import FACT


def wave(hours):
    return 100 + 40 * np.sin(2 * np.pi * np.arange(hours) / 24)


def hourly(spark, values, gare=None):
    start = pd.Timestamp("2024-01-01")
    times = [(start + pd.Timedelta(hours=i)).to_pydatetime() for i in range(len(values))]
    rows = [(t, float(v)) for t, v in zip(times, values)]
    df = spark.createDataFrame(rows, "ds timestamp_ntz, y double")
    return df if gare is None else df.withColumn("gare", F.lit(gare))


def passages(spark, per_hour):
    """As many passages in each hour as told, per station."""
    start = pd.Timestamp("2024-01-01")
    rows, number = [], 0
    for gare, counts in per_hour.items():
        for hour, count in enumerate(counts):
            for i in range(count):
                when = (start + pd.Timedelta(hours=hour, minutes=i)).to_pydatetime()
                rows.append((number, when, gare, 1, "VL", 1.0, 1.0, "Cash", "Non", "Standard", None))
                number += 1
    return spark.createDataFrame(rows, FACT)


@pytest.fixture(scope="module")
def fit(spark):
    counts = np.round(8 + 5 * np.sin(2 * np.pi * np.arange(480) / 24)).astype(int)
    return forecast.station_fit(passages(spark, {"A": counts, "B-C": counts[::-1]}), 48)


def test_daily_wave_is_recovered(spark):
    rows = forecast.extend_hours(hourly(spark, wave(720), "A"), 48)
    fitted = forecast.fit_additive(rows).where(F.col("y").isNull()).orderBy("ds").collect()
    truth = wave(768)[720:]
    assert len(fitted) == 48
    assert np.abs(np.array([r.yhat for r in fitted]) - truth).max() < 2.0
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in fitted)
    parts = [r.trend + r.daily + r.weekly + r.yearly for r in fitted]
    assert parts == pytest.approx([r.yhat for r in fitted])


def test_station_forecast_bounds(fit):
    rows = forecast.station_forecast(fit, noise_std=0.0).collect()
    assert len(rows) == 2 * 48
    assert all(0 <= r.lower_95 <= r.predicted <= r.upper_95 <= 13 * 1.3 + 1e-9 for r in rows)
    assert min(r.datetime for r in rows) == datetime(2024, 1, 21)


def test_noise_repeats_with_its_seed(fit):
    def run(seed, parts):
        rows = forecast.station_forecast(fit.repartition(parts), 0.8, seed).collect()
        return {(r.gare, r.datetime): r.predicted for r in rows}

    assert run(1, 2) == run(1, 5)
    assert run(1, 2) != run(2, 2)


def test_station_metrics_and_registry(fit):
    metrics = {r.gare: r for r in forecast.station_metrics(fit).collect()}
    assert set(metrics) == {"A", "B-C"}
    assert metrics["A"].n_test == 96 and metrics["A"].mae < 1.0
    registry = {r.gare: r for r in forecast.model_registry(fit, 48).collect()}
    record = registry["B-C"]
    assert record.gare_safe == "b_c" and record.n_hours_train == 384
    assert record.fourier_orders.asDict() == {"daily": 10, "weekly": 5, "yearly": 8}
    assert record.metrics.mae == metrics["B-C"].mae
    index = forecast.registry_index(forecast.model_registry(fit, 48)).orderBy("gare").collect()
    assert [r.name for r in index] == ["additive_gare_a", "additive_gare_b_c"]
    components = forecast.station_components(fit, 2)
    assert components.where("y is null").count() == 96
    assert components.where("y is not null").count() == 2 * 49


def test_error_metrics(spark):
    df = spark.createDataFrame([(2.0, 1.0), (4.0, 7.0)], "y double, p double")
    row = forecast.error_metrics(df, "y", "p").first()
    assert (row.n_test, row.mae) == (2, 2.0)
    assert row.rmse == pytest.approx(np.sqrt(5))
    assert row.mape == pytest.approx((0.5 + 0.75) / 2 * 100)


def test_roll_out_feeds_values_back():
    tail = pd.DataFrame(
        {
            "ds": pd.date_range("2024-01-01", periods=3, freq="h"),
            "y": [12.0, 14.0, 19.0],
        }
    )
    out = roll_out(np.array([0.5, 0.0, 0.6]), 0.1, 10.0, 20.0, 4, 0.0, 0)(tail)
    window, expected = [0.2, 0.4, 0.9], []
    for _ in range(4):
        value = 0.5 * window[0] + 0.6 * window[2] + 0.1
        expected.append(max(value * 10 + 10, 0))
        window = [*window[1:], min(max(value, 0.0), 1.0)]
    assert list(out.predicted) == pytest.approx(expected)
    assert out.ds.iloc[0] == pd.Timestamp("2024-01-01 03:00")


def test_autoregression_continues_a_wave(spark):
    df = hourly(spark, wave(600)).withColumn("y", F.col("y").cast("bigint"))
    model = forecast.fit_autoregression(df, 48, ridge=1e-6)
    ahead = forecast.autoregressive_forecast(df, model, 48, noise_std=0.0)
    rows = ahead.orderBy("hour").collect()
    assert [r.hour for r in rows] == list(range(48))
    assert np.abs(np.array([r.predicted for r in rows]) - wave(648)[600:]).max() < 5.0
    summary = forecast.forecast_summary(ahead, 0.0, 48).first()
    assert summary.future_hours == 48
    assert summary.min_prediction <= summary.mean_prediction <= summary.max_prediction
    both = forecast.with_history(df, ahead, 100)
    assert both.groupBy("kind").count().count() == 2 and both.count() == 148


def test_noise_is_fed_back_but_not_returned(spark):
    df = hourly(spark, wave(400)).withColumn("y", F.col("y").cast("bigint"))
    model = forecast.fit_autoregression(df, 24)
    runs = [forecast.autoregressive_forecast(df, model, 5, s, 3) for s in (0.0, 0.5, 0.5)]
    calm, rough, again = [[r.predicted for r in run.orderBy("hour").collect()] for run in runs]
    assert rough == again
    assert calm[0] == rough[0] and calm[1:] != rough[1:]


def test_global_forecast_steps_by_day(spark):
    counts = np.round(8 + 5 * np.sin(2 * np.pi * np.arange(400) / 24)).astype(int)
    rows = forecast.global_forecast(passages(spark, {"A": counts}), 30).orderBy("ds").collect()
    assert len(rows) == 30
    assert rows[0].ds == datetime(2024, 1, 18, 15) and rows[1].ds == datetime(2024, 1, 19, 15)
    assert all(r.yhat_lower < r.yhat < r.yhat_upper for r in rows)


def test_lag_metrics_use_only_the_holdout(spark):
    counts = [1] * 200 + [3] * 50
    row = forecast.lag_forecast_metrics(passages(spark, {"A": counts}), 168).first()
    assert row.n_test == 50 and row.mae == 2.0


def test_fourier_width(spark):
    wide = features.fourier_features(hourly(spark, [1.0, 2.0]))
    assert len(wide.columns) == 2 + 46


def test_holdout(spark):
    test = series.chrono_split(hourly(spark, range(10)), train=0.8, val=0.0)
    assert sorted(r.y for r in test.where("part = 'test'").collect()) == [8.0, 9.0]
    assert sorted(r.y for r in forecast.holdout(hourly(spark, range(10))).collect()) == [8.0, 9.0]


def test_short_series_says_so(spark):
    df = hourly(spark, range(30)).withColumn("y", F.col("y").cast("bigint"))
    with pytest.raises(ValueError, match="too few"):
        forecast.fit_autoregression(df, 30)


def test_autoregression_errors_on_unseen_hours(spark):
    df = hourly(spark, wave(600)).withColumn("y", F.col("y").cast("bigint"))
    row = forecast.autoregression_metrics(df, forecast.fit_autoregression(df, 48, ridge=1e-6)).first()
    assert row.n_test == 552 - int(552 * 0.8) and row.mae < 3.0


def test_noise_is_normal(spark):
    drawn = spark.range(4000).select(
        forecast.normal_noise(3, F.col("id").cast("string")).alias("z")
    )
    z = np.array([r.z for r in drawn.collect()])
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05 and np.abs(z).max() < 6


def test_global_forecast_of_nothing(spark):
    assert forecast.global_forecast(passages(spark, {"A": []}), 3).count() == 0


def test_global_forecast_follows_the_daily_wave(spark):
    counts = np.round(20 + 10 * np.sin(2 * np.pi * np.arange(600) / 24)).astype(int)
    ahead = forecast.global_forecast(passages(spark, {"A": counts}), 24, "INTERVAL '1' HOUR")
    got = np.array([r.yhat for r in ahead.orderBy("ds").collect()])
    truth = 20 + 10 * np.sin(2 * np.pi * np.arange(600, 624) / 24)
    assert np.abs(got - truth).mean() < 3.0


def split_rows(spark, target, noise, n=900):
    """Rows of three inputs in time order: 70 % to learn from, 15 % to stop by, 15 % unseen."""
    rng = np.random.default_rng(11)
    x = rng.uniform(-1, 1, (n, 3))
    y = target(x) + noise * rng.normal(size=n)
    part = np.where(np.arange(n) < 0.7 * n, "train", np.where(np.arange(n) < 0.85 * n, "val", "test"))
    rows = spark.createDataFrame(pd.DataFrame({"part": part, "y": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    return rows.select("part", "y", array_to_vector(F.array("a", "b", "c")).alias("features")).coalesce(2)


def test_validation_part_chooses_the_number_of_trees(spark):
    def bent(x):
        return 5 * np.sin(3 * x[:, 0]) * (x[:, 1] > 0) + 2 * x[:, 2]

    clear, blurred = (split_rows(spark, bent, noise) for noise in (0.05, 4.0))
    many, few = (forecast.fit_boosted(rows, 30) for rows in (clear, blurred))
    assert few.getNumTrees < many.getNumTrees <= 30

    def error(model, rows, part):
        scored = model.transform(rows.where(F.col("part") == part))
        return scored.agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]

    all_trees = forecast.fit_boosted(blurred.where("part != 'val'"), 30)
    assert all_trees.getNumTrees == 30
    assert error(few, blurred, "val") < error(all_trees, blurred, "val")
    assert error(few, blurred, "test") < error(all_trees, blurred, "test")
    again = forecast.fit_boosted(blurred.where("part != 'test'"), 30)
    assert again.toDebugString.split("\n")[1:] == few.toDebugString.split("\n")[1:]
