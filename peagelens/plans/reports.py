"""The reports behind the dashboard pages, as named frames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peagelens.operators import series, traffic
from peagelens.session import settle
from peagelens.sources.fact import all_passages, paid

Report = dict[str, DataFrame]


def traffic_stats(tx: DataFrame) -> Report:
    """Key figures, growth, period, peaks, breakdowns and revenue of paying passages.

    The fact table is reduced once to an hourly cube. Only ranges of it are read again: the amounts of the
    cell that holds the median, and the days of the growth windows, which do not follow hours.
    """
    paying = paid(tx)
    cube = settle(traffic.hourly_cube(paying, cells=True), "cube")
    per_day = traffic.daily_of_cube(cube)
    return {
        "summary": traffic.kpi_of_cube(cube, traffic.median_of_cube(cube, paying)),
        "growth": traffic.revenue_growth(paying, end=traffic.last_of_cube(cube)),
        "period": traffic.period_of_cube(cube),
        "peaks": traffic.peaks(cube),
        "breakdowns": traffic.breakdowns(cube),
        "weekdays": traffic.weekdays_of_cube(cube),
        "daily": per_day,
        "best_worst_day": traffic.best_worst_day(per_day),
        "channels": traffic.channels_of(cube),
    }


_LABELS = (
    "window_days", "kind", "dimension", "label", "jour_num", "jour", "canal", "periode",
    "classe_vehicule", "gare", "ds",
)


def long_form(report: Report) -> DataFrame:
    """(section, label, measure, value): every figure of a report as one frame.

    Times count as seconds since 1970; a label names the row within its section.
    """
    out = None
    for section, frame in report.items():
        labels = [c for c in frame.columns if c in _LABELS]
        figures = [n for n, t in frame.dtypes if n not in labels and t != "string"]
        kinds = dict(frame.dtypes)
        numbers = [
            (F.unix_micros(F.col(n).cast("timestamp")) / 1e6 if kinds[n].startswith("timestamp") else F.col(n))
            .cast("double")
            .alias(n)
            for n in figures
        ]
        label = F.concat_ws("|", *[F.col(c).cast("string") for c in labels]).alias("label")
        rows = frame.select(label, *numbers).unpivot(["label"], figures, "measure", "value")
        rows = rows.select(F.lit(section).alias("section"), "label", "measure", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def _entity_analysis(tx: DataFrame, key: str) -> Report:
    every = all_passages(tx)
    return {
        "summary": traffic.entity_summary(every, key),
        "hourly": series.hourly_counts(every, [key], count="count"),
    }


def class_analysis(tx: DataFrame) -> Report:
    """Totals, range and hourly counts of each vehicle class, over every passage."""
    return _entity_analysis(tx, "classe_vehicule")


def station_analysis(tx: DataFrame) -> Report:
    """Totals, range and hourly counts of each station, over every passage."""
    return _entity_analysis(tx, "gare")


def global_analysis(tx: DataFrame) -> Report:
    """Total, range, gap-free hourly counts and parts of the day, over every passage."""
    every = all_passages(tx)
    return {
        "summary": traffic.global_summary(every),
        "hourly": series.hourly_series(every, count="count"),
        "day_periods": traffic.day_period_counts(every),
    }
