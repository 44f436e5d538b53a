"""The physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from peagelens.operators import distribution, etl, forecast, quantiles, series, traffic
from peagelens.plans import reports
from peagelens.plans.queries import RUN_TS
from peagelens.session import settle
from peagelens.sources import bindings, fact
from peagelens.sources.fact import paid, write_fact


def plan(df):
    """The physical plan with its subqueries, as first made and as run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan as run, for queries without subqueries."""
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def tx(spark, data_dir):
    return bindings.tx_events(spark, data_dir)


@pytest.fixture(scope="module")
def stored(spark, tx, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fact"))
    write_fact(tx, path)
    return spark.read.parquet(path)


CROSS = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize(
    "name",
    ["kpi_summary", "class_amount_stats", "box_outliers", "kde_amount", "histogram_all",
     "minmax_scaled", "revenue_growth", "payment_share", "last_90_days", "forecast_station"],
)
def test_no_cross_join(spark, data_dir, name):
    text = plan(queries()[name](spark, data_dir))
    assert not any(word in text for word in CROSS)


def test_loading_is_one_stage(spark, data_dir):
    text = final_plan(etl.transform(bindings.raw_events(spark, data_dir), RUN_TS))
    assert "Exchange" not in text and "WholeStageCodegen" not in text.replace("*(1)", "")


def test_filters_and_columns_reach_the_scan(stored):
    text = final_plan(traffic.revenue_by(paid(stored), "gare"))
    scan = text[text.index("FileScan") :]
    assert "GreaterThan(montant_net,0.0)" in scan
    assert "ReadSchema: struct<gare:string,montant_net:double>" in scan


def test_growth_bound_reaches_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    text = plan(traffic.revenue_growth(paid(stored)))
    filters = [part.split("Format:")[0] for part in text.split("DataFilters: ")[1:]]
    assert any("date_heure#" in f and ">=" in f and "ubquery" in f for f in filters)


def test_shares_read_once(tx):
    text = plan(traffic.share_by(tx, "gare"))
    assert "ReusedExchange" in text.split("== Initial Plan ==")[0]


def test_breakdowns_expand_only_the_cube(tx):
    text = final_plan(traffic.breakdowns(traffic.hourly_cube(paid(tx))))
    assert text.count("FileScan") == 1
    # Plans print top down: the shuffle below the Expand belongs to the cube.
    assert "Exchange hashpartitioning" in text[text.index("Expand") :]


def test_fences_go_to_the_tasks(tx):
    text = final_plan(distribution.box_outliers(tx, "montant_paye"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning") == 0


@pytest.fixture
def counted_reads(spark, data_dir):
    """Number of passages that a query reads from the fact, in passes over the table."""
    total = bindings.table(spark, data_dir, "events").count()

    def passes(make):
        seen = spark.sparkContext.accumulator(0)

        def tick(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        tx = bindings.tx_events(spark, data_dir)
        make(tx.mapInArrow(tick, tx.schema)).collect()
        return seen.value / total

    return passes


@pytest.mark.parametrize(
    ("most", "make"),
    [
        (1, distribution.amount_stats),
        (1, lambda tx: distribution.describe(tx, ["montant_paye", "montant_net"])),
        (1, distribution.box_stats),
        (1, lambda tx: distribution.box_stats(tx, key=None)),
        (2, lambda tx: distribution.box_outliers(tx, "montant_paye")),
        (2, traffic.kpi_summary),
        (1, distribution.pivot_mean_amount),
    ],
)
def test_passes_over_the_fact(counted_reads, most, make):
    assert counted_reads(make) <= most


def test_report_passes(counted_reads):
    """The cube, then ranges of amounts and of days, here counted as whole reads; nothing else."""
    assert counted_reads(lambda tx: reports.long_form(reports.traffic_stats(tx))) <= 3


def test_median_reads_a_range(spark, tx, tmp_path):
    """The scan for the median carries the ends of one cell as filters; the value is that of all amounts."""
    path = str(tmp_path / "fact")
    fact.write_fact(tx, path)
    stored = fact.paid(fact.read_fact(spark, path))
    cube = settle(traffic.hourly_cube(stored, cells=True), "cube")
    counted, seen = quantiles.value_counts, []
    traffic.value_counts = lambda df, *a, **k: (seen.append(df), counted(df, *a, **k))[1]
    try:
        median = traffic.median_of_cube(cube, stored)
    finally:
        traffic.value_counts = counted
    exact = quantiles.exact_quantiles(stored, "montant_net", [0.5]).first().quantiles[0]
    assert spark.range(1).select(median.alias("m")).first().m == exact
    text = plan(seen[0])
    assert "GreaterThanOrEqual(montant_net" in text[text.index("PushedFilters") :]
    assert re.search(r"montant_net#\d+ <= ", text)
    assert seen[0].count() < stored.count() / 2


def test_global_forecast_has_no_group(tx):
    text = plan(forecast.global_forecast(tx, 3))
    assert "FlatMapGroups" not in text and "Python" not in text


def test_windows_run_on_hours(tx):
    text = final_plan(series.hourly_series(tx, ["gare"]))
    window = text[text.index("Window") :]
    assert "HashAggregate" in window


def test_quantile_plan_does_not_multiply(spark, tx):
    df = quantiles.exact_quantiles(tx, "montant_net", [0.25, 0.5, 0.75], ["gare"])
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("percentile_approx") <= 4
    assert df.where(F.col("n") > 0).count() == 6
