import numpy as np
import pytest
from pyspark.sql import functions as F

from peagelens.operators import quantiles
from peagelens.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def check(spark, groups, buckets):
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {
        r["k"]: (r["n"], r["quantiles"])
        for r in exact_quantiles(df, "v", PROBS, ["k"], buckets).collect()
    }
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key][0] == len(values)
        assert got[key][1] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12)


@pytest.mark.parametrize("buckets", [2, 8, 256])
def test_matches_brute_force(spark, buckets):
    rng = np.random.default_rng(1)
    check(
        spark,
        {
            "uniform": np.round(rng.uniform(0, 500, 1500), 2),
            "heavy_tail": rng.pareto(0.4, 700),
            "one": [3.5],
            "two": [1.0, 2.0],
            "negative": -rng.integers(0, 30, 400),
        },
        buckets,
    )


def test_one_value_holds_most_rows(spark):
    rng = np.random.default_rng(2)
    check(spark, {"hot": [7.0] * 3000 + list(rng.normal(7, 3, 800)), "cold": [1.0, 9.0, 4.0]}, 16)


def test_without_keys_and_nulls(spark):
    df = spark.range(1001).select(
        F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("v")
    )
    row = exact_quantiles(df, "v", [0.5, 0.9], buckets=8).first()
    values = np.arange(0, 1001, 2)
    assert row["n"] == len(values)
    assert row["quantiles"] == pytest.approx(list(np.quantile(values, [0.5, 0.9])))


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert exact_quantiles(df, "v", [0.5], ["k"]).collect() == []


def test_buckets_follow_the_distinct_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKETS", 2)
    monkeypatch.setattr(quantiles, "PER_BUCKET", 8)
    seen = []
    place = quantiles._place
    monkeypatch.setattr(quantiles, "_place", lambda f, b: seen.append(b) or place(f, b))
    rng = np.random.default_rng(6)
    check(spark, {"a": rng.normal(size=900), "b": rng.normal(size=300)}, None)
    assert seen == [256]
