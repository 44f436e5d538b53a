"""Named queries: each takes a session and a table folder and returns a DataFrame.

Amounts and ratios are rounded here, at the edge, because the order in which
doubles are added is free; the operators themselves return full precision.
"""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peagelens.functions.calendar import calendar_parts, epoch_days
from peagelens.functions.scalars import half_even, slug
from peagelens.operators import distribution, etl, features, forecast, product, reservoir, series, traffic
from peagelens.operators.numeric import Reservoir
from peagelens.plans import reports
from peagelens.schema import (
    FEATURE_LAGS,
    FEATURE_WINDOWS,
    HISTORY_HOURS,
    LOOKBACK_HOURS,
    SECOND_PASS_LAGS,
    SECOND_PASS_WINDOWS,
)
from peagelens.session import fresh_path, remove, settle
from peagelens.sources import bindings, cube, exports, fact, raw

Query = Callable[[SparkSession, str], DataFrame]

RUN_TS = datetime(2024, 2, 1)
KDE_POINTS = 200


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round columns; none named means every double column."""
    names = columns or tuple(n for n, t in df.dtypes if t == "double")
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in columns})


def _events(spark: SparkSession, d: str) -> DataFrame:
    return bindings.tx_events(spark, d)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return bindings.tx_orders(spark, d)


def _paid(spark: SparkSession, d: str) -> DataFrame:
    return fact.paid(_events(spark, d))


def _paid_orders(spark: SparkSession, d: str) -> DataFrame:
    return fact.paid(_orders(spark, d))


def _fact_rows(spark: SparkSession, d: str) -> DataFrame:
    return etl.transform(bindings.raw_events(spark, d), RUN_TS)


def etl_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Write the untidy export, load it into a fact table, and scan that table."""
    csv_path, fact_path = fresh_path(spark, "raw"), fresh_path(spark, "fact")
    raw.write_raw(bindings.raw_events(spark, d), csv_path)
    etl.run_etl(spark, csv_path, fact_path, RUN_TS)
    remove(spark, csv_path)
    return fact.read_fact(spark, fact_path)


def etl_report(spark: SparkSession, d: str) -> DataFrame:
    """What loading the untidy export counts and loses, through a CSV file."""
    csv_path = fresh_path(spark, "raw")
    raw.write_raw(bindings.raw_events(spark, d), csv_path)
    report = settle(etl.load_report(raw.read_raw(spark, csv_path)), "load-report")
    remove(spark, csv_path)
    return report


def calendar_table(spark: SparkSession, d: str) -> DataFrame:
    tx = _events(spark, d)
    parts = calendar_parts(F.col("date_heure"))
    return as_text(tx.select("id_transaction", *parts), "date")


def kpi_empty(spark: SparkSession, d: str) -> DataFrame:
    """Key figures of a station without passages."""
    return traffic.kpi_summary(_paid(spark, d).where(F.col("gare") == "Aucune gare"))


def repeats(spark: SparkSession, d: str) -> DataFrame:
    """Repeated rows over all columns, and over what one lane records in an hour."""
    tx = _events(spark, d)
    hour = series.hour_start(F.col("date_heure")).alias("ds")
    lane = tx.select(hour, "gare", "voie", "classe_vehicule", "type_paiement")
    scopes = {"row": tx, "lane_hour": lane}
    whole, by_lane = [
        distribution.duplicate_rows(df).select(F.lit(scope).alias("scope"), "*")
        for scope, df in scopes.items()
    ]
    return whole.unionByName(by_lane)


def correlation(spark: SparkSession, d: str) -> DataFrame:
    tx = _events(spark, d).select(
        "montant_paye",
        F.hour("date_heure").alias("heure"),
        "montant_net",
        F.col("montant_net").alias("ca"),
    )
    return distribution.correlation_matrix(tx, tx.columns)


def calendar_feature_table(spark: SparkSession, d: str) -> DataFrame:
    hourly = series.hourly_series(_events(spark, d), (), "date", features.TARGET, "id_transaction")
    return features.with_time_features(hourly)


def lag_table(spark: SparkSession, d: str) -> DataFrame:
    hourly = series.hourly_series(_events(spark, d), (), "date", features.TARGET, "id_transaction")
    return hourly.withColumns(features.lag_columns(features.TARGET, FEATURE_LAGS))


def rolling_table(spark: SparkSession, d: str) -> DataFrame:
    hourly = series.hourly_series(_events(spark, d), (), "date", features.TARGET, "id_transaction")
    return hourly.withColumns(features.rolling_columns(features.TARGET, FEATURE_WINDOWS))


def second_pass(spark: SparkSession, d: str) -> DataFrame:
    first = features.feature_table(_events(spark, d))
    return features.add_lags_rolling(
        features.with_time_features(first), features.TARGET, SECOND_PASS_LAGS, SECOND_PASS_WINDOWS
    )


def sequence_windows(spark: SparkSession, d: str) -> DataFrame:
    hourly = series.hourly_series(_events(spark, d))
    windows = features.sequences(hourly, "y", LOOKBACK_HOURS, "y")
    return windows.withColumn("x", F.array_join(F.col("x").cast("array<string>"), ","))


def splits(spark: SparkSession, d: str) -> DataFrame:
    hourly = series.hourly_series(_events(spark, d))
    three = series.chrono_split(hourly, name="part_70_15_15")
    return series.chrono_split(three, train=0.8, val=0.0, name="part_80_20")


def last_90_days(spark: SparkSession, d: str) -> DataFrame:
    return series.last_days(series.hourly_series(_orders(spark, d)), 90)


def _network(spark: SparkSession, d: str) -> DataFrame:
    return settle(series.hourly_series(_events(spark, d)), "network-hours")


def _autoregressive(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    hourly = _network(spark, d)
    model = forecast.fit_autoregression(hourly)
    return hourly, forecast.autoregressive_forecast(hourly, model, noise_std=0.0)


#: Bends an hour and their mean size in the band of fixed bends.
BEND_RATE, BEND_SIZE = 0.02, 0.05
#: A fixed model of the next hour: 0.6 of the hour a week before, 0.4 of the day before.
FIXED_WEIGHTS = tuple(0.6 if k == 0 else 0.4 if k == LOOKBACK_HOURS - 24 else 0.0 for k in range(LOOKBACK_HOURS))


def _fixed_rollout(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    hourly = _network(spark, d)
    ends = features.minmax_bounds(hourly, ["y"]).first()
    model = forecast.AutoRegression(FIXED_WEIGHTS, 0.0, ends["y_min"], ends["y_max"])
    return hourly, forecast.autoregressive_forecast(hourly, model, noise_std=0.0)


#: A reservoir of three units with one daily wave, and its readout over 1, the three inputs and the states.
FIXED_RESERVOIR = Reservoir(
    inner=((0.5, -0.3, 0.0), (0.2, 0.4, -0.5), (0.0, 0.6, 0.3)),
    inputs=((0.8, 0.1, -0.2), (-0.5, 0.3, 0.2), (0.4, -0.2, 0.1)),
    bias=(0.1, -0.2, 0.3), leak=0.7, periods=(24.0,),
)
FIXED_READOUT = (0.45, 0.1, -0.12, -0.15, 0.2, -0.15, 0.1)


def _reservoir(spark: SparkSession, d: str) -> tuple[DataFrame, reservoir.EchoModel]:
    hourly = _network(spark, d)
    return hourly, reservoir.fit_reservoir(hourly)


def reservoir_fixed(spark: SparkSession, d: str) -> DataFrame:
    """The fixed reservoir rolled forward for a week from the network's last hours."""
    hourly = _network(spark, d)
    ends = features.minmax_bounds(hourly, ["y"]).first()
    model = reservoir.EchoModel(FIXED_RESERVOIR, FIXED_READOUT, ends["y_min"], ends["y_max"])
    ahead = reservoir.reservoir_forecast(hourly, model, noise_std=0.0)
    return rounded(ahead, 6)


#: Trend and season of a fixed multiplicative model: level and slope, bends, seasons and the weights of their waves.
FIXED_TREND, FIXED_BENDS = (40.0, 6.0), ((0.25, -9.5), (0.5, 12.0))
FIXED_SEASONS, FIXED_WAVES = (("daily", 1.0, 2), ("weekly", 7.0, 1)), (0.3, -0.2, 0.1, 0.05, -0.15, 0.08)


def product_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Trend, season and value of a fixed multiplicative model for every hour of the network."""
    hourly = _network(spark, d)
    days = epoch_days(F.col("ds"))
    ends = hourly.agg(F.min(days).alias("start"), F.max(days).alias("end")).first()
    model = product.ProductModel(
        ends.start, ends.end - ends.start, FIXED_TREND, FIXED_BENDS, FIXED_SEASONS, FIXED_WAVES
    )
    return rounded(product.product_parts(hourly, model), 6)


#: Passages from this day on are loaded after the first refresh of the stored cube.
SECOND_LOAD = datetime(1997, 6, 1)


def _stored_cube(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A fact table and its stored cube, refreshed after each of two loads."""
    tx = _orders(spark, d)
    early = F.coalesce(F.col("date_heure") < F.lit(str(SECOND_LOAD)).cast("timestamp_ntz"), F.lit(True))
    path, stored = fresh_path(spark, "fact"), fresh_path(spark, "stored-cube")
    fact.write_fact(tx.where(early), path)
    cube.refresh_cube(spark, path, stored)
    fact.append_fact(tx.where(~early), path)
    return fact.read_fact(spark, path), cube.read_cube(spark, path, stored)


def kpi_of_stored_cube(spark: SparkSession, d: str) -> DataFrame:
    """Key figures from the stored cube; for the median, amounts of one cell are read from the fact table."""
    tx, kept = _stored_cube(spark, d)
    return rounded(traffic.kpi_of_cube(kept, traffic.median_of_cube(kept, fact.paid(tx))), 4)


def cube_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Passages and revenue by month and class from a stored cube, refreshed after each of two loads."""
    by_month = _stored_cube(spark, d)[1].groupBy(
        F.date_format("ds", "yyyy-MM").alias("annee_mois"), "classe_vehicule"
    )
    sums = by_month.agg(*[F.sum(c).alias(c) for c in ("rows", "transactions", "revenue", "amounts")])
    return rounded(sums, 2)


def autoregressive_metrics(spark: SparkSession, d: str) -> DataFrame:
    hourly = _network(spark, d)
    return rounded(forecast.autoregression_metrics(hourly, forecast.fit_autoregression(hourly)), 2)


def fixed_metrics(spark: SparkSession, d: str) -> DataFrame:
    model = forecast.AutoRegression(FIXED_WEIGHTS, 0.0, 0.0, 1.0)
    return rounded(forecast.autoregression_metrics(_network(spark, d), model), 6)


def sequence_windows_features(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 24 hours by 23 scaled features, split in time order, as sums and corners."""
    table = settle(features.feature_table(_events(spark, d)), "features")
    inputs = [c for c in table.columns if c not in ("date", features.TARGET)]
    scaled = features.minmax_scale(table, [*inputs, features.TARGET])
    windows = features.sequences(
        scaled, [f"{c}_scaled" for c in inputs], 24, f"{features.TARGET}_scaled", at="date"
    )
    parts = series.chrono_split(windows, at="date")
    x = F.flatten("x")
    return rounded(
        parts.select(
            "date", "part", "y", F.size(x).alias("n_values"),
            F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("x_sum"),
            F.element_at(x, 1).alias("x_first"), F.element_at(x, -1).alias("x_last"),
        ),
        6,
    )


def _stats_of_stations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.series_stats(series.hourly_series(_events(spark, d), ["gare"])), 6)


def stats_as_json(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the stations, written as JSON lines and read again."""
    stats, path = _stats_of_stations(spark, d), fresh_path(spark, "stats-json")
    exports.write_json(stats, path)
    return spark.read.schema(stats.schema).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").json(path)


def stats_as_documents(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the stations as result documents, and what these say."""
    stats = _stats_of_stations(spark, d)
    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    return exports.as_documents(stats).select(F.from_json("document", stats.schema, options).alias("r")).select("r.*")


def forecast_as_csv(spark: SparkSession, d: str) -> DataFrame:
    """The simplest forecast of each station, written as CSV files and read again."""
    ahead = forecast.lag_forecast(series.hourly_series(_events(spark, d), ["gare"]))
    path = fresh_path(spark, "forecast-csv")
    exports.write_forecast_csv(ahead, path)
    fields = "datetime timestamp_ntz, predicted double, lower_95 double, upper_95 double, gare_safe string"
    return spark.read.schema(fields).option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
    ).csv(path)


def registry_facts(spark: SparkSession, d: str) -> DataFrame:
    """What a model record says of its station's data, without a model."""
    stats = series.series_stats(series.hourly_series(_events(spark, d), ["gare"]))
    return stats.select(
        "gare", slug(F.col("gare")).alias("gare_safe"), "data_start", "data_end", "n_hours_train",
        half_even(F.col("y_mean"), 3).alias("y_mean"), half_even(F.col("y_std"), 3).alias("y_std"), "y_max",
    )


def forecast_summary(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast_summary(_autoregressive(spark, d)[1], noise_std=0.0)


def forecast_with_history(spark: SparkSession, d: str) -> DataFrame:
    return forecast.with_history(*_autoregressive(spark, d))


def _report(make: Callable[[DataFrame], reports.Report]) -> Query:
    return lambda s, d: rounded(reports.long_form(make(_events(s, d))), 4)


QUERIES: dict[str, Query] = {
    # scans and loading
    "scan_paid": lambda s, d: _paid(s, d),
    "scan_all": lambda s, d: fact.all_passages(_events(s, d)),
    "etl_transform": _fact_rows,
    "etl_csv_roundtrip": etl_csv_roundtrip,
    "etl_report": etl_report,
    "calendar_parts": calendar_table,
    # counts
    "count_by_payment": lambda s, d: traffic.count_by(_paid(s, d), "type_paiement"),
    "count_by_class": lambda s, d: traffic.count_by(_paid(s, d), "classe_vehicule"),
    "count_by_gare": lambda s, d: traffic.count_by(_paid(s, d), "gare"),
    "payment_share": lambda s, d: rounded(traffic.share_by(_events(s, d), "type_paiement"), 6),
    "class_share": lambda s, d: rounded(traffic.share_by(_events(s, d), "classe_vehicule"), 6),
    "gare_share": lambda s, d: rounded(traffic.share_by(_events(s, d), "gare"), 6),
    "hourly_profile": lambda s, d: traffic.hourly_profile(_paid(s, d)),
    "weekday_counts": lambda s, d: traffic.weekday_counts(_paid(s, d)),
    "day_period_counts": lambda s, d: traffic.day_period_counts(_events(s, d)),
    "daily_counts": lambda s, d: as_text(
        traffic.daily(_paid(s, d)).select("jour", "transactions"), "jour"
    ),
    "distinct_classes": lambda s, d: traffic.distinct_values(_paid(s, d), "classe_vehicule"),
    # revenue
    "daily_revenue": lambda s, d: rounded(
        as_text(traffic.daily(_paid(s, d)).select("jour", "revenue"), "jour"), 4
    ),
    "daily_revenue_first31": lambda s, d: rounded(
        as_text(traffic.daily(_paid_orders(s, d)).select("jour", "revenue").limit(31), "jour"), 4
    ),
    "revenue_by_gare": lambda s, d: rounded(traffic.revenue_by(_paid(s, d), "gare"), 4),
    "revenue_by_class": lambda s, d: rounded(traffic.revenue_by(_paid(s, d), "classe_vehicule"), 4),
    "revenue_by_payment": lambda s, d: rounded(traffic.revenue_by(_paid(s, d), "type_paiement"), 4),
    "weekday_revenue": lambda s, d: rounded(traffic.weekday_revenue(_paid(s, d)), 4),
    "monthly_revenue_by_payment": lambda s, d: rounded(
        traffic.monthly_revenue_by_payment(_paid_orders(s, d)), 4
    ),
    "mean_amount_by_class": lambda s, d: rounded(
        traffic.mean_amount_by(_events(s, d), "classe_vehicule"), 6
    ),
    "revenue_growth": lambda s, d: rounded(traffic.revenue_growth(_paid_orders(s, d)), 4),
    "subscription_breakdown": lambda s, d: rounded(traffic.subscription_breakdown(_paid(s, d)), 4),
    "breakdowns_one_pass": lambda s, d: rounded(
        traffic.breakdowns(traffic.hourly_cube(_paid(s, d))), 4
    ),
    # key figures and rankings
    "kpi_summary": lambda s, d: rounded(traffic.kpi_summary(_paid(s, d)), 4),
    "kpi_empty": kpi_empty,
    "anomaly_rate": lambda s, d: rounded(traffic.anomaly_rate(_events(s, d)), 6),
    "eda_summary": lambda s, d: rounded(traffic.headline_shares(_events(s, d)), 4),
    "peaks": lambda s, d: traffic.peaks(traffic.hourly_cube(_paid(s, d))),
    "best_worst_day": lambda s, d: rounded(
        as_text(traffic.best_worst_day(traffic.daily(_paid_orders(s, d))), "jour"), 4
    ),
    "top10_gares_revenue": lambda s, d: rounded(traffic.top_by_revenue(_paid_orders(s, d), 10), 4),
    "top3_gares_revenue": lambda s, d: rounded(traffic.top_by_revenue(_orders(s, d), 3), 4),
    "top10_gares_count": lambda s, d: traffic.top_by_count(_orders(s, d), 10),
    "top15_amounts": lambda s, d: traffic.frequent_amounts(_events(s, d), 15),
    "class_summary": lambda s, d: traffic.entity_summary(_events(s, d), "classe_vehicule"),
    "gare_summary": lambda s, d: traffic.entity_summary(_events(s, d), "gare"),
    "global_summary": lambda s, d: traffic.global_summary(_events(s, d)),
    # dashboard reports
    "report_traffic_stats": _report(reports.traffic_stats),
    "report_class": _report(reports.class_analysis),
    "report_station": _report(reports.station_analysis),
    "report_global": _report(reports.global_analysis),
    # distributions
    "class_amount_stats": lambda s, d: rounded(distribution.amount_stats(_paid(s, d)), 4),
    "box_stats": lambda s, d: rounded(distribution.box_stats(_paid(s, d)), 4),
    "box_stats_all": lambda s, d: rounded(distribution.box_stats(_events(s, d), key=None), 4),
    "box_stats_paid_by_class": lambda s, d: rounded(
        distribution.box_stats(_events(s, d), "montant_paye"), 4
    ),
    "box_outliers": lambda s, d: distribution.box_outliers(_events(s, d), "montant_paye"),
    "describe_amount": lambda s, d: rounded(
        distribution.describe(_events(s, d), ["montant_paye", "montant_net"]), 4
    ),
    "describe_numeric": lambda s, d: rounded(
        distribution.describe(_events(s, d), distribution.numeric_columns(_events(s, d))), 4
    ),
    "histogram_amount": lambda s, d: rounded(
        distribution.histogram(_paid(s, d), "montant_net", 80), 6
    ),
    "histogram_all": lambda s, d: rounded(
        distribution.histogram(_events(s, d), "montant_net", 100), 6
    ),
    "histogram_zoom": lambda s, d: rounded(
        distribution.histogram(
            _orders(s, d).where(F.col("montant_net") <= 3000), "montant_net", 60
        ),
        6,
    ),
    "kde_amount": lambda s, d: rounded(
        distribution.density(_events(s, d), "montant_net", 100, KDE_POINTS), 7
    ),
    "kde_amount_binned": lambda s, d: rounded(
        distribution.binned_density(_events(s, d), "montant_net", 100, KDE_POINTS), 7
    ),
    "kde_amount_zoom": lambda s, d: rounded(
        distribution.density(
            _events(s, d).where(F.col("montant_net") <= 60), "montant_net", 60, KDE_POINTS
        ),
        7,
    ),
    "correlation_matrix": lambda s, d: rounded(correlation(s, d), 8),
    "pivot_amount": lambda s, d: rounded(
        distribution.pivot_mean_amount(_events(s, d)), 6
    ),
    "pivot_month_year_count": lambda s, d: distribution.pivot_month_year(_orders(s, d), "count"),
    "pivot_month_year_revenue": lambda s, d: rounded(
        distribution.pivot_month_year(_orders(s, d), "revenue"), 4
    ),
    "profile_nulls": lambda s, d: distribution.profile(_fact_rows(s, d)),
    "duplicate_rows": repeats,
    # hourly series
    "hourly_counts_sparse": lambda s, d: series.hourly_counts(
        _events(s, d), count="nombre_voitures"
    ),
    "hourly_counts_dense": lambda s, d: series.hourly_series(
        _events(s, d), count="nombre_voitures"
    ),
    "hourly_counts_dense_by_gare": lambda s, d: series.hourly_series(_events(s, d), ["gare"]),
    "class_hourly": lambda s, d: series.hourly_counts(
        _events(s, d), ["classe_vehicule"], count="count"
    ),
    "gare_hourly": lambda s, d: series.hourly_counts(_events(s, d), ["gare"], count="count"),
    "series_stats": lambda s, d: rounded(
        series.series_stats(series.hourly_series(_events(s, d), ["gare"])), 6
    ),
    "history_tail": lambda s, d: series.last_rows(
        series.hourly_series(_events(s, d)), HISTORY_HOURS
    ),
    "last_90_days": last_90_days,
    "chrono_split": splits,
    # features
    "calendar_features": lambda s, d: rounded(calendar_feature_table(s, d), 10),
    "lag_features": lag_table,
    "rolling_features": lambda s, d: rounded(rolling_table(s, d), 6),
    "feature_table": lambda s, d: rounded(features.feature_table(_events(s, d)), 6),
    "feature_table_second_pass": lambda s, d: rounded(second_pass(s, d), 6),
    "fourier_features": lambda s, d: rounded(
        features.fourier_features(series.hourly_series(_events(s, d))), 8
    ),
    "sequence_windows": sequence_windows,
    "sequence_windows_features": sequence_windows_features,
    "minmax_scaled": lambda s, d: rounded(
        features.minmax_scale(series.hourly_series(_events(s, d)), ["y"]), 10
    ),
    "cube_by_month": cube_by_month,
    "kpi_of_stored_cube": kpi_of_stored_cube,
    # forecasts
    "forecast_metrics": lambda s, d: rounded(forecast.lag_forecast_metrics(_events(s, d)), 2),
    "forecast_station": lambda s, d: forecast.station_forecast(
        forecast.station_fit(_events(s, d)), noise_std=0.0
    ),
    "forecast_station_metrics": lambda s, d: forecast.station_metrics(
        forecast.station_fit(_events(s, d))
    ),
    "forecast_components": lambda s, d: forecast.station_components(
        forecast.station_fit(_events(s, d))
    ),
    "forecast_registry": lambda s, d: forecast.model_registry(forecast.station_fit(_events(s, d))),
    "forecast_product_fixed": product_fixed,
    "forecast_global": lambda s, d: rounded(forecast.global_forecast(_events(s, d)), 6),
    "forecast_autoregressive": lambda s, d: forecast.forecast_rows(_autoregressive(s, d)[1]),
    "forecast_summary": forecast_summary,
    "forecast_with_history": forecast_with_history,
    "rollout_fixed": lambda s, d: forecast.forecast_rows(_fixed_rollout(s, d)[1]),
    "rollout_fixed_summary": lambda s, d: forecast.forecast_summary(
        _fixed_rollout(s, d)[1], noise_std=0.0
    ),
    "rollout_fixed_with_history": lambda s, d: rounded(
        forecast.with_history(*_fixed_rollout(s, d)), 6
    ),
    "reservoir_fixed": reservoir_fixed,
    "forecast_reservoir": lambda s, d: forecast.forecast_rows(
        reservoir.reservoir_forecast(*_reservoir(s, d), noise_std=0.0)
    ),
    "reservoir_metrics": lambda s, d: rounded(reservoir.reservoir_metrics(*_reservoir(s, d)), 3),
    "autoregressive_metrics": autoregressive_metrics,
    "autoregressive_metrics_fixed": fixed_metrics,
    "forecast_noisy": lambda s, d: forecast.lag_forecast(series.hourly_series(_events(s, d), ["gare"])),
    "forecast_band_fixed": lambda s, d: rounded(
        forecast.lag_band(series.hourly_series(_events(s, d), ["gare"]), BEND_RATE, BEND_SIZE), 6
    ),
    "forecast_as_csv": forecast_as_csv,
    "stats_as_json": stats_as_json,
    "stats_as_documents": stats_as_documents,
    "registry_facts": registry_facts,
    "regress_boosted": lambda s, d: rounded(forecast.regress_boosted(_events(s, d)), 6),
    "regress_hourly": lambda s, d: forecast.regress_hourly(_events(s, d)),
}
