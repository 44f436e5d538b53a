"""Small frames that pin down null, tie, gap and edge rules."""

from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peagelens.functions.calendar import day_period, hour_start, weekday_label
from peagelens.functions.scalars import clip_low, growth_pct, slug, to_number_or_null
from peagelens.operators import distribution, features, series, traffic
from peagelens.plans import reports
from peagelens.schema import FACT, WEEKDAYS_FR


def passages(spark, rows):
    """Fact rows from (id, time, station, class, amount[, payment, status])."""
    full = []
    for r in rows:
        number, at, gare, classe, amount, payment, status = (*r, "Carte", "Non")[:7]
        net = None if amount is None else max(amount, 0.0)
        full.append((number, at, gare, 1, classe, amount, net, payment, status, "Standard", None))
    return spark.createDataFrame(full, FACT)


def at(hour, day=1, minute=0):
    return datetime(2024, 1, day, hour, minute)


@pytest.fixture(scope="module")
def gap(spark):
    return passages(
        spark,
        [
            (1, at(0), "A", "VL", 5.0),
            (2, at(3), "A", "VL", 5.0),
            (3, at(3, minute=59), "B", None, 5.0),
            (4, None, "A", "PL", 5.0),
            (5, at(5), None, "PL", -2.0),
        ],
    )


def test_hours_dense_and_sparse(gap):
    sparse = series.hourly_counts(gap).collect()
    assert {(r.ds.hour, r.y) for r in sparse} == {(0, 1), (3, 2), (5, 1)}
    dense = series.hourly_series(gap).orderBy("ds").collect()
    assert [r.y for r in dense] == [1, 0, 0, 2, 0, 1]


def test_each_series_keeps_its_bounds(gap):
    rows = series.hourly_series(gap, ["gare"]).orderBy("gare", "ds").collect()
    assert [(r.gare, r.ds.hour, r.y) for r in rows] == [
        ("A", 0, 1), ("A", 1, 0), ("A", 2, 0), ("A", 3, 1), ("B", 3, 1),
    ]


def test_null_keys_are_dropped(gap):
    assert {r.gare for r in traffic.count_by(gap, "gare").collect()} == {"A", "B"}
    shares = {r.classe_vehicule: r.pct for r in traffic.share_by(gap, "classe_vehicule").collect()}
    assert shares == {"VL": 50.0, "PL": 50.0}


def test_hour_ignores_session_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 31, 2, 30),)], "t timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        assert df.select(hour_start(F.col("t"))).first()[0] == datetime(2024, 3, 31, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ties_go_to_the_first_key(spark):
    tx = passages(
        spark,
        [(1, at(9), "B", "VL", 4.0), (2, at(8), "A", "VL", 1.0), (3, at(10), "A", "VL", 3.0),
         (4, at(7), "B", "VL", 0.0)],
    )
    assert traffic.top_by_revenue(tx, 1).first().gare == "A"
    assert traffic.top_by_count(tx, 1).first().gare == "A"
    best = {r.kind: r.label for r in traffic.peaks(traffic.hourly_cube(tx)).collect()}
    assert best == {"jour": "2024-01-01", "heure": "7", "gare": "A"}


def test_hour_peak_ties_by_number_not_text(spark):
    tx = passages(spark, [(1, at(10), "A", "VL", 1.0), (2, at(9), "A", "VL", 1.0)])
    best = {r.kind: r.label for r in traffic.peaks(traffic.hourly_cube(tx)).collect()}
    assert best["heure"] == "9"


def test_best_and_worst_day(spark):
    tx = passages(
        spark,
        [(1, at(1, 3), "A", "VL", 5.0), (2, at(1, 2), "A", "VL", 5.0), (3, at(1, 4), "A", "VL", 1.0),
         (4, at(1, 5), "A", "VL", 1.0)],
    )
    days = {r.kind: (r.jour, r.amount) for r in traffic.best_worst_day(traffic.daily(tx)).collect()}
    assert days == {"best": (date(2024, 1, 2), 5.0), "worst": (date(2024, 1, 4), 1.0)}


def test_day_periods_are_left_closed(spark):
    df = spark.createDataFrame([(h,) for h in (0, 5, 6, 11, 12, 17, 18, 23)], "h int")
    names = [r[0] for r in df.orderBy("h").select(day_period(F.col("h"))).collect()]
    assert names == ["Nuit"] * 2 + ["Matin"] * 2 + ["Après-midi"] * 2 + ["Soir"] * 2


def test_all_day_periods_and_weekdays_appear(gap):
    periods = {r.periode: r.transactions for r in traffic.day_period_counts(gap).collect()}
    assert periods == {"Nuit": 4, "Matin": 0, "Après-midi": 0, "Soir": 0}
    week = traffic.weekday_counts(gap).collect()
    assert [r.jour_semaine for r in week] == list(WEEKDAYS_FR)
    assert [r.transactions for r in week] == [4, 0, 0, 0, 0, 0, 0]


def test_weekday_label(spark):
    df = spark.range(7).select(weekday_label(F.col("id").cast("int")))
    assert sorted(r[0] for r in df.collect()) == sorted(WEEKDAYS_FR)


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (2.0,)], "x double")
    assert [r[0] for r in df.select(clip_low(F.col("x"))).collect()] == [0.0, None, 2.0]


def test_numbers_from_text(spark):
    texts = ["1", " 2.5 ", "N/A", "1d", "3f", "1e2", "-4", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(to_number_or_null(F.col("t"))).collect()]
    assert got == [1.0, 2.5, None, None, None, 100.0, -4.0, None]


def test_guarded_growth(spark):
    df = spark.createDataFrame([(5.0, 0.0), (3.0, 2.0), (1.0, -1.0)], "c double, p double")
    assert [r[0] for r in df.select(growth_pct(F.col("c"), F.col("p"))).collect()] == [0.0, 50.0, 0.0]


def test_growth_windows_end_an_hour_after_the_last_passage(spark):
    tx = passages(
        spark,
        [
            (1, datetime(2024, 1, 31, 12), "A", "VL", 10.0),
            (2, datetime(2024, 1, 24, 13), "A", "VL", 7.0),
            (3, datetime(2024, 1, 24, 12, 59), "A", "VL", 4.0),
            (4, datetime(2024, 1, 17, 12, 59), "A", "VL", 100.0),
        ],
    )
    rows = {r.window_days: r for r in traffic.revenue_growth(tx).collect()}
    assert (rows[7].current_revenue, rows[7].previous_revenue) == (17.0, 4.0)
    assert rows[7].growth_pct == pytest.approx(325.0)
    assert (rows[30].current_revenue, rows[30].previous_revenue) == (121.0, 0.0)
    assert rows[30].growth_pct == 0.0


def test_channels_may_overlap(spark):
    tx = passages(
        spark,
        [(1, at(1), "A", "VL", 10.0, " ESPECES ", "OUI"), (2, at(1), "A", "VL", 5.0, None, None),
         (3, at(1), "A", "VL", 2.0, "Badge", "Non")],
    )
    got = {r.canal: r.revenue for r in traffic.subscription_breakdown(tx).collect()}
    assert got == {"Abonnés": 12.0, "Cash": 10.0, "Autres": 0.0}


def test_empty_contract(spark):
    empty = passages(spark, [])
    row = traffic.kpi_summary(empty).first()
    assert set(row.asDict().values()) == {0}
    assert traffic.count_by(empty, "gare").collect() == []
    assert [r.growth_pct for r in traffic.revenue_growth(empty).collect()] == [0.0, 0.0]
    assert traffic.best_worst_day(traffic.daily(empty)).collect() == []
    assert traffic.peaks(traffic.hourly_cube(empty)).collect() == []
    assert series.hourly_series(empty).collect() == []
    assert distribution.histogram(empty, "montant_net", 4).collect() == []
    assert distribution.density(empty, "montant_net").collect() == []


def test_kpi(spark):
    tx = passages(
        spark,
        [(1, at(1), "A", "VL", 1.0), (2, at(1, 2), "A", "VL", 2.0), (3, at(2, 2), "A", "VL", 6.0)],
    )
    row = traffic.kpi_summary(tx).first()
    assert (row.total_transactions, row.total_revenue, row.active_days) == (3, 9.0, 2)
    assert (row.avg_ticket, row.median_ticket) == (3.0, 2.0)
    assert (row.avg_transactions_per_day, row.avg_revenue_per_day) == (1.5, 4.5)


@pytest.mark.parametrize(
    "amounts",
    [
        [3.0], [1.0, 2.0], [1.0, 1.0, 9.0, 9.0], [2.0, 1e9], [-5.0, 0.0, 7.0], [-8.0, -7.99, -2.0, -1.0], [None, 4.0, None],
        [5.0] * 7 + [5.01, 5.02, 900.0], [float("-inf"), 1.0, 2.0, float("inf")], [None], [],
    ],
)
def test_median_of_cube(spark, amounts):
    tx = passages(spark, [(k, at(k % 5, 1 + k % 3), "AB"[k % 2], "VL", x) for k, x in enumerate(amounts)])
    tx = tx.withColumn("montant_net", F.col("montant_paye"))
    known = sorted(x for x in amounts if x is not None)
    got = spark.range(1).select(traffic.median_of_cube(traffic.hourly_cube(tx, cells=True), tx).alias("m")).first().m
    assert got == (float(np.median(known)) if known else None)


def test_cells_change_no_sum(spark):
    tx = passages(spark, [(k, at(k % 5, 1 + k % 3), "AB"[k % 2], "VL", k * 1.5) for k in range(40)])
    plain, fine = traffic.hourly_cube(tx), traffic.hourly_cube(tx, cells=True)
    for make in (traffic.breakdowns, traffic.peaks, traffic.period_of_cube, traffic.channels_of, traffic.weekdays_of_cube):
        assert sorted(map(repr, make(plain).collect())) == sorted(map(repr, make(fine).collect()))


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 4.0)], "x double")
    assert [r["count"] for r in distribution.histogram(df, "x", 4).orderBy("bin").collect()] == [1] * 4
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    bins = distribution.histogram(same, "x", 2).orderBy("bin").collect()
    assert [(r["low"], r["count"]) for r in bins] == [(2.5, 0), (3.0, 2)]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(4)
    values = np.round(rng.uniform(-5, 50, 2000), 1)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    counts = [r["count"] for r in distribution.histogram(df, "x", 70).orderBy("bin").collect()]
    assert counts == list(np.histogram(values, 70)[0])


def test_density_matches_formula(spark):
    values = np.array([1.0, 1.0, 2.0, 5.0, 9.0])
    df = spark.createDataFrame([(v,) for v in values.tolist()], "x double")
    rows = distribution.density(df, "x", 10, 50).orderBy("point").collect()
    h = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(1, 9, 50)
    expected = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(1)
    expected /= len(values) * h * np.sqrt(2 * np.pi)
    assert [r.density for r in rows] == pytest.approx(list(expected))
    assert [r.x for r in rows] == pytest.approx(list(grid))


def test_box_and_outliers(spark):
    amounts = [10.0, 11.0, 12.0, 13.0, 14.0, 100.0]
    tx = passages(spark, [(i, at(1), "A", "VL", v) for i, v in enumerate(amounts)])
    row = distribution.box_stats(tx).first()
    assert (row.q1, row.median, row.q3) == (11.25, 12.5, 13.75)
    assert (row.whisker_low, row.whisker_high, row.n_outliers) == (10.0, 14.0, 1)
    assert [r.id_transaction for r in distribution.box_outliers(tx).collect()] == [5]


def test_correlation_skips_missing_pairs(spark):
    frame = pd.DataFrame({"a": [1.0, 2, None, 4, 7], "b": [2.0, 1, 5, 9, None], "c": [1.0, 3, 2, 4, 4]})
    df = spark.createDataFrame(
        [tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.to_numpy()],
        "a double, b double, c double",
    )
    got = {r.variable: (r.a, r.b, r.c) for r in distribution.correlation_matrix(df, "abc").collect()}
    for name, line in frame.corr().iterrows():
        assert got[name] == pytest.approx(tuple(line))


def test_pivots(spark):
    tx = passages(
        spark,
        [(1, datetime(2023, 2, 1), "A", "VL", 2.0, "Cash", "Oui"),
         (2, datetime(2024, 2, 1), "A", "VL", 4.0, "Cash", "Non"),
         (3, datetime(2024, 3, 1), "A", "VL", 6.0, "Badge", None)],
    )
    mean = {r.type_paiement: (r["Non"], r["Oui"]) for r in distribution.pivot_mean_amount(tx).collect()}
    assert mean == {"Cash": (4.0, 2.0)}
    count = distribution.pivot_month_year(tx, "count").orderBy("mois_num").collect()
    assert [(r.mois, r["2023"], r["2024"]) for r in count] == [("February", 1, 1), ("March", None, 1)]


def test_profile_and_duplicates(spark):
    df = spark.createDataFrame(
        [(1, None), (1, None), (1, "x"), (2, "x"), (2, "x"), (2, "x")], "a int, b string"
    )
    known = {r["column"]: (r.dtype, r.non_null, r.nulls) for r in distribution.profile(df).collect()}
    assert known == {"a": ("int", 6, 0), "b": ("string", 4, 2)}
    row = distribution.duplicate_rows(df).first()
    assert (row.n_rows, row.n_distinct, row.n_duplicates) == (6, 3, 3)
    row = distribution.duplicate_rows(df.distinct()).first()
    assert (row.n_rows, row.n_distinct, row.n_duplicates) == (3, 3, 0)


def hourly(spark, values):
    start = pd.Timestamp("2024-01-01")
    rows = [((start + pd.Timedelta(hours=i)).to_pydatetime(), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ds timestamp_ntz, y bigint")


def test_rolling_excludes_the_current_row(spark):
    df = hourly(spark, [1, 2, 4, 8, 16])
    rows = df.withColumns(features.rolling_columns("y", [3], at="ds")).orderBy("ds").collect()
    assert [r.y_roll_mean_3 for r in rows][:3] == [None] * 3
    assert [r.y_roll_mean_3 for r in rows][3:] == pytest.approx([7 / 3, 14 / 3])
    assert [r.y_roll_std_3 for r in rows][3:] == pytest.approx([1.527525, 3.055050], abs=1e-6)
    assert [r.y_roll_max_3 for r in rows][3:] == [4.0, 8.0]


def test_lags_and_sequences(spark):
    df = hourly(spark, list(range(6)))
    lags = df.withColumns(features.lag_columns("y", [1, 2], at="ds")).orderBy("ds").collect()
    assert [r.y_lag2 for r in lags] == [None, None, 0.0, 1.0, 2.0, 3.0]
    windows = features.sequences(df, "y", 4, "y").orderBy("ds").collect()
    assert [(r.x, r.y) for r in windows] == [([0, 1, 2, 3], 4), ([1, 2, 3, 4], 5)]
    wide = df.withColumn("z", F.col("y") * 10)
    many = features.sequences(wide, ["y", "z"], 2, "y").orderBy("ds").first()
    assert many.x == [[0.0, 0.0], [1.0, 10.0]]


def test_second_pass_replaces_columns(spark):
    start = pd.Timestamp("2024-01-01")
    tx = passages(
        spark, [(i, (start + pd.Timedelta(hours=i)).to_pydatetime(), "A", "VL", 1.0) for i in range(200)]
    )
    first = features.feature_table(tx)
    assert len(first.columns) == 25 and first.count() == 200 - 168
    second = features.add_lags_rolling(first, features.TARGET, [1, 2, 3, 7], [3, 7, 14])
    assert second.count() == 200 - 168 - 14
    assert len(second.columns) == 25 + 1 + 6


def test_scaling(spark):
    df = hourly(spark, [2, 4, 6])
    rows = features.minmax_scale(df, ["y"]).orderBy("ds").collect()
    assert [r.y_scaled for r in rows] == [0.0, 0.5, 1.0]
    back = features.minmax_scale(df, ["y"]).select(
        features.minmax_inverse(F.col("y_scaled"), F.lit(2.0), F.lit(6.0)).alias("v")
    )
    assert sorted(r.v for r in back.collect()) == [2.0, 4.0, 6.0]
    train = df.where(F.col("y") < 5)
    assert [r.y_scaled for r in features.minmax_scale(df, ["y"], train).orderBy("ds").collect()] == [
        0.0, 1.0, 2.0,
    ]
    flat = features.minmax_scale(hourly(spark, [5, 5]), ["y"]).collect()
    assert [r.y_scaled for r in flat] == [0.0, 0.0]


def test_splits_floor_and_add_up(spark):
    df = hourly(spark, list(range(11)))
    rows = series.chrono_split(df).orderBy("ds").collect()
    assert [r.part for r in rows] == ["train"] * 7 + ["val"] + ["test"] * 3


def test_tails(spark):
    df = hourly(spark, list(range(100)))
    assert sorted(r.y for r in series.last_rows(df, 3).collect()) == [97, 98, 99]
    keyed = df.withColumn("k", F.col("y") % 2)
    assert sorted(r.y for r in series.last_rows(keyed, 2, ["k"]).collect()) == [96, 97, 98, 99]
    assert series.last_days(df, 1).count() == 25
    assert series.last_days(keyed, 1, ["k"]).groupBy("k").count().collect()[0][1] == 13


def test_anomalies(gap):
    assert [r.id_transaction for r in traffic.anomalies(gap).collect()] == [5]
    assert traffic.anomaly_rate(gap).first().pct == 20.0


def test_slug(spark):
    df = spark.createDataFrame([("Porto-Novo Est",)], "g string")
    assert df.select(slug(F.col("g"))).first()[0] == "porto_novo_est"


def test_reports_agree(spark, gap):
    stats = reports.traffic_stats(gap)
    total = stats["summary"].first().total_transactions
    assert total == 4
    by_class = stats["breakdowns"].where("dimension = 'heure'").agg(F.sum("transactions")).first()[0]
    assert by_class == 3  # one passage has no time
    assert stats["daily"].agg(F.sum("transactions")).first()[0] == 3
    assert stats["weekdays"].agg(F.sum("transactions")).first()[0] == 3
    hours = reports.global_analysis(gap)["hourly"]
    assert hours.agg(F.sum("count")).first()[0] == 4 and hours.count() == 6
    for report in (reports.class_analysis(gap), reports.station_analysis(gap)):
        assert report["summary"].count() == 2
        assert report["hourly"].count() > 0
