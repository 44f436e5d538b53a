"""Calendar column expressions on zone-free timestamps."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from peagelens.schema import DAY_PERIODS, WEEKDAYS_FR


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' HOUR")


def days(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' DAY")


def hour_start(ts: Column) -> Column:
    """Truncate to the hour without going through the session time zone."""
    midnight = ts.cast("date").cast("timestamp_ntz")
    return F.timestamp_add("HOUR", F.hour(ts), midnight)


def weekday_label(number: Column) -> Column:
    """French name of weekday 0 (Monday) to 6."""
    names = F.array(*[F.lit(name) for name in WEEKDAYS_FR])
    return F.get(names, number)


def month_key(ts: Column) -> Column:
    """``YYYY-MM``."""
    return F.date_format(ts, "yyyy-MM")


def day_period(hour: Column) -> Column:
    """Left-closed part of the day of an hour."""
    label = F.lit(None).cast("string")
    for name, start, end in reversed(DAY_PERIODS):
        label = F.when((hour >= start) & (hour < end), F.lit(name)).otherwise(label)
    return label


def calendar_parts(ts: Column) -> list[Column]:
    """Date, hour, English day and month names, year and part of the day."""
    return [
        F.to_date(ts).alias("date"),
        F.hour(ts).alias("heure"),
        F.date_format(ts, "EEEE").alias("jour_semaine"),
        F.date_format(ts, "MMMM").alias("mois"),
        F.year(ts).alias("annee"),
        day_period(F.hour(ts)).alias("periode_jour"),
    ]


def time_features(ts: Column) -> list[Column]:
    """The nine calendar features of the regression table."""
    hour, month, weekday = F.hour(ts), F.month(ts), F.weekday(ts)
    turn = 2.0 * math.pi
    return [
        hour.alias("heure"),
        weekday.alias("jour_semaine"),
        F.dayofmonth(ts).alias("jour_mois"),
        month.alias("mois"),
        (weekday >= 5).cast("int").alias("est_weekend"),
        F.sin(hour * (turn / 24)).alias("heure_sin"),
        F.cos(hour * (turn / 24)).alias("heure_cos"),
        F.sin(month * (turn / 12)).alias("mois_sin"),
        F.cos(month * (turn / 12)).alias("mois_cos"),
    ]


def epoch_days(ts: Column) -> Column:
    """Days since 1970-01-01, fractional, to the second and free of time zones."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.unix_date(F.to_date(ts)) + seconds / 86400.0
