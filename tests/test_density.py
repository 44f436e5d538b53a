"""The binned density beside the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peagelens.operators.distribution import binned_density, density


def test_binned_density_is_near_the_exact_one(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(50, 8, 3000), rng.exponential(30, 2000), [900.0, -5.0], np.repeat(60.0, 400)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    exact = {r.point: r for r in density(df, "v").collect()}
    rows = {r.point: r for r in binned_density(df, "v").collect()}
    assert set(rows) == set(exact) == set(range(200))
    peak = max(r.density for r in exact.values())
    for k, r in rows.items():
        assert r.x == pytest.approx(exact[k].x)
        assert abs(r.density - exact[k].density) < 1e-4 * peak
        assert r.expected_count == pytest.approx(exact[k].expected_count, abs=1e-3 * len(values) * peak)


def test_no_python_worker_and_no_spread(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("v"))
    text = binned_density(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "InPandas" not in text and "Cartesian" not in text and "NestedLoop" not in text
    for none in (df.limit(0), df.select(F.lit(3.0).alias("v")), df.limit(1), df.select(F.lit(None).cast("double").alias("v"))):
        assert binned_density(none, "v").collect() == []
