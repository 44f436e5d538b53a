"""Counts, revenue, key figures, rankings and peaks.

All aggregates are built in and combine on the map side, so a station that holds
a third of all passages sends one row per task to the shuffle.
"""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peagelens.functions.calendar import (
    day_period,
    days,
    hour_start,
    hours,
    month_key,
    weekday_label,
)
from peagelens.functions.scalars import growth_pct, is_cash, is_subscriber
from peagelens.operators.quantiles import exact_quantiles, quantiles_of, value_counts
from peagelens.schema import CHANNELS, DAY_PERIODS


def transactions() -> Column:
    return F.count("id_transaction").alias("transactions")


def revenue(name: str = "revenue") -> Column:
    return F.coalesce(F.sum("montant_net"), F.lit(0.0)).alias(name)


def keyed(tx: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are all known."""
    for key in keys:
        tx = tx.where(F.col(key).isNotNull())
    return tx


def count_by(tx: DataFrame, key: str) -> DataFrame:
    """Transactions per value of ``key``, most first."""
    counted = keyed(tx, key).groupBy(key).agg(transactions())
    return counted.orderBy(F.desc("transactions"), key)


def revenue_by(tx: DataFrame, key: str) -> DataFrame:
    """Revenue per value of ``key``, highest first."""
    summed = keyed(tx, key).groupBy(key).agg(revenue())
    return summed.orderBy(F.desc("revenue"), key)


def mean_amount_by(tx: DataFrame, key: str) -> DataFrame:
    """Mean net amount per value of ``key``, highest first."""
    mean = keyed(tx, key).groupBy(key).agg(F.avg("montant_net").alias("mean_amount"))
    return mean.orderBy(F.desc("mean_amount"), key)


def share_by(tx: DataFrame, key: str) -> DataFrame:
    """Transactions per value of ``key`` and their percentage.

    The total is a scalar subquery over the same counts; Spark reuses their
    shuffle, so the fact table is read once.
    """
    counts = keyed(tx, key).groupBy(key).agg(F.count(F.lit(1)).alias("transactions"))
    total = counts.agg(F.sum("transactions")).scalar()
    return counts.withColumn("pct", F.col("transactions") * F.lit(100.0) / total)


def top_by_revenue(tx: DataFrame, n: int, key: str = "gare") -> DataFrame:
    return revenue_by(tx, key).limit(n)


def top_by_count(tx: DataFrame, n: int, key: str = "gare") -> DataFrame:
    return count_by(tx, key).limit(n)


def frequent_amounts(tx: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most frequent net amounts."""
    counts = (
        keyed(tx, "montant_net").groupBy("montant_net").agg(F.count(F.lit(1)).alias("transactions"))
    )
    return counts.orderBy(F.desc("transactions"), "montant_net").limit(n)


def distinct_values(tx: DataFrame, key: str) -> DataFrame:
    return keyed(tx, key).select(key).distinct().orderBy(key)


def daily(tx: DataFrame) -> DataFrame:
    """Transactions and revenue per day, in date order."""
    day = F.to_date("date_heure").alias("jour")
    per_day = (
        keyed(tx, "date_heure")
        .groupBy(day)
        .agg(transactions(), revenue())
    )
    return per_day.orderBy("jour")


def hourly_profile(tx: DataFrame) -> DataFrame:
    """Passages per hour of day; hours without any are absent."""
    hour = F.hour("date_heure").alias("heure")
    counts = keyed(tx, "date_heure").groupBy(hour).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("heure", F.col("n").alias("nombre_transactions")).orderBy("heure")


def weekday_counts(tx: DataFrame) -> DataFrame:
    """Transactions for each of the seven weekdays, 0 where none."""
    number = F.weekday("date_heure").alias("jour_num")
    return _week(keyed(tx, "date_heure").groupBy(number).agg(transactions()))


def weekdays_of_cube(cube: DataFrame) -> DataFrame:
    """:func:`weekday_counts` from the cube."""
    number = F.weekday("ds").alias("jour_num")
    return _week(keyed(cube, "ds").groupBy(number).agg(F.sum("transactions").alias("transactions")))


def _week(counts: DataFrame) -> DataFrame:
    week = counts.sparkSession.range(7).select(F.col("id").cast("int").alias("jour_num"))
    return week.join(counts, "jour_num", "left").select(
        "jour_num",
        weekday_label(F.col("jour_num")).alias("jour_semaine"),
        F.coalesce("transactions", F.lit(0)).cast("bigint").alias("transactions"),
    ).orderBy("jour_num")


def weekday_revenue(tx: DataFrame) -> DataFrame:
    """Revenue per weekday that occurs, Monday first."""
    number = F.weekday("date_heure").alias("jour_num")
    summed = keyed(tx, "date_heure").groupBy(number).agg(revenue("montant_net"))
    label = weekday_label(F.col("jour_num")).alias("jour_semaine")
    return summed.select("jour_num", label, "montant_net").orderBy("jour_num")


def monthly_revenue_by_payment(tx: DataFrame) -> DataFrame:
    month = month_key(F.col("date_heure")).alias("mois")
    summed = (
        keyed(tx, "date_heure", "type_paiement")
        .groupBy(month, "type_paiement")
        .agg(revenue("montant_net"))
    )
    return summed.orderBy("mois", "type_paiement")


def day_period_counts(tx: DataFrame) -> DataFrame:
    """Passages in each of the four parts of the day, 0 where none; one aggregate."""
    period = day_period(F.hour("date_heure"))
    names = [name for name, _, _ in DAY_PERIODS]
    counts = tx.agg(*[F.count_if(period == name).alias(name) for name in names])
    return _long(counts, names, "periode", "transactions")


def _long(wide: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Columns of a one-row frame as rows."""
    return wide.unpivot([], list(columns), name, value)


def entity_summary(tx: DataFrame, key: str) -> DataFrame:
    """Transactions and first and last time per value of ``key``."""
    return keyed(tx, key).groupBy(key).agg(
        transactions().alias("total_transactions"),
        F.min("date_heure").alias("first_transaction"),
        F.max("date_heure").alias("last_transaction"),
    ).orderBy(key)


def global_summary(tx: DataFrame) -> DataFrame:
    return tx.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.min("date_heure").alias("start"),
        F.max("date_heure").alias("end"),
    )


def kpi_summary(tx: DataFrame) -> DataFrame:
    """One row of key figures; all zero when there are no passages.

    Passages are reduced to days in one pass and to counted amounts in another. The
    median is exact, without holding all amounts in one task.
    """
    per_day = tx.groupBy(F.to_date("date_heure").alias("jour")).agg(
        F.count(F.lit(1)).alias("rows"),
        transactions(),
        F.sum("montant_net").alias("revenue"),
        F.count("montant_net").alias("amounts"),
    )
    return _key_figures(per_day, median_amount(tx))


def kpi_of_cube(cube: DataFrame, median: Column) -> DataFrame:
    """:func:`kpi_summary` from the cube and the median amount."""
    per_day = cube.groupBy(F.to_date("ds").alias("jour")).agg(
        *[F.sum(c).alias(c) for c in ("rows", "transactions", "revenue", "amounts")]
    )
    return _key_figures(per_day, median)


def median_amount(tx: DataFrame) -> Column:
    """The exact median of the net amounts."""
    return exact_quantiles(tx, "montant_net", [0.5]).select(F.col("quantiles")[0]).scalar()


def median_of_cube(cube: DataFrame, tx: DataFrame) -> Column:
    """The exact median of the net amounts of ``tx`` from its :func:`hourly_cube` with cells.

    The cells' counts, exact in the cube and mergeable over hours and months, tell which cell holds the median;
    only amounts between that cell's ends are read from ``tx``, a range that reaches the scan as a filter.
    How the amounts lie decides what that saves: an amount that a third of all rows share has to be read.
    """
    cells = cube.where(F.col("amounts") > 0).groupBy("amount_cell").agg(
        F.sum("amounts").alias("c"), F.min("least_amount").alias("low"), F.max("largest_amount").alias("high")
    )
    # One row per cell, so the window holds at most some thousand rows, whatever the number of passages.
    every = Window.partitionBy(F.lit(0))
    upto = F.sum("c").over(every.orderBy("amount_cell").rowsBetween(Window.unboundedPreceding, 0))
    placed = cells.withColumns({"upto": upto, "n": F.sum("c").over(every)})
    middle = (F.col("n") - 1) / 2
    holds = (F.col("upto") > F.floor(middle)) & (F.col("upto") - F.col("c") <= F.ceil(middle))
    found = placed.where(holds).agg(
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.min(F.col("upto") - F.col("c")).alias("below"), F.max("n").alias("n"), F.max("upto").alias("upto"),
    ).first()
    if found.n is None:
        return F.lit(None).cast("double")
    near = tx.where(F.col("montant_net").between(found.low, found.high))
    outside = [(float("-inf"), found.below), (float("inf"), found.n - found.upto)]
    ends = tx.sparkSession.createDataFrame([x for x in outside if x[1]], "_v double, _c bigint")
    counts = value_counts(near, "montant_net", kept="median-range").select("_v", "_c").unionByName(ends)
    return quantiles_of(counts, [0.5]).select(F.col("quantiles")[0]).scalar()


def _key_figures(per_day: DataFrame, median: Column) -> DataFrame:
    dated = F.col("jour").isNotNull()
    figures = per_day.agg(
        F.sum("rows").alias("total_transactions"),
        F.sum("revenue").alias("total_revenue"),
        (F.sum("revenue") / F.nullif(F.sum("amounts"), F.lit(0))).alias("avg_ticket"),
        F.avg(F.when(dated, F.col("transactions"))).alias("avg_transactions_per_day"),
        F.avg(F.when(dated, F.coalesce("revenue", F.lit(0.0)))).alias("avg_revenue_per_day"),
        F.count_if(dated).alias("active_days"),
    )
    zero = F.lit(0.0)
    return figures.select(
        F.coalesce("total_transactions", F.lit(0)).cast("bigint").alias("total_transactions"),
        F.coalesce("total_revenue", zero).alias("total_revenue"),
        F.coalesce("avg_ticket", zero).alias("avg_ticket"),
        F.coalesce(median, zero).alias("median_ticket"),
        F.coalesce("avg_transactions_per_day", zero).alias("avg_transactions_per_day"),
        F.coalesce("avg_revenue_per_day", zero).alias("avg_revenue_per_day"),
        "active_days",
    )


def last_of_cube(cube: DataFrame) -> Column:
    """The time of the last passage, as a scalar subquery of the cube."""
    return cube.agg(F.max("last")).scalar()


def revenue_growth(tx: DataFrame, windows: Iterable[int] = (7, 30), end: Column | None = None) -> DataFrame:
    """Revenue of the last ``d`` days against the ``d`` days before, per window.

    The windows end one hour after the last passage, whose time ``end`` may give if it is known. The end is a
    scalar subquery, so it also reaches the scan as a filter and prunes older data.
    """
    windows = list(windows)
    at = F.col("date_heure")
    end = (tx.agg(F.max("date_heure")).scalar() if end is None else end) + hours(1)

    def before_end(n: int) -> Column:
        return end - days(n)

    def within(start: Column, stop: Column) -> Column:
        inside = (at >= start) & (at < stop)
        return F.coalesce(F.sum(F.when(inside, F.col("montant_net"))), F.lit(0.0))

    sums = []
    for d in windows:
        sums.append(within(before_end(d), end).alias(f"current_{d}"))
        sums.append(within(before_end(2 * d), before_end(d)).alias(f"previous_{d}"))
    row = tx.where(at >= before_end(2 * max(windows))).agg(*sums)
    pieces = F.array(
        *[
            F.struct(
                F.lit(d).alias("window_days"),
                F.col(f"current_{d}").alias("current_revenue"),
                F.col(f"previous_{d}").alias("previous_revenue"),
                growth_pct(F.col(f"current_{d}"), F.col(f"previous_{d}")).alias("growth_pct"),
            )
            for d in windows
        ]
    )
    return row.select(F.inline(pieces))


def _channel_sums() -> list[Column]:
    amount = F.col("montant_net")
    subscriber = is_subscriber(F.col("statut_abonnement"), F.col("type_paiement"))
    cash = is_cash(F.col("type_paiement"))
    return [
        F.sum(F.when(subscriber, amount)).alias("subscribed"),
        F.sum(F.when(cash, amount)).alias("cash"),
        F.sum(amount).alias("revenue"),
    ]


def subscription_breakdown(tx: DataFrame) -> DataFrame:
    """Revenue of subscribers, of cash, and the rest (never below 0). The first two may overlap."""
    return channels_of(tx.agg(*_channel_sums()))


def channels_of(cube: DataFrame) -> DataFrame:
    """:func:`subscription_breakdown` of rows with subscribed, cash and revenue, such as the cube's."""
    zero = F.lit(0.0)
    sums = cube.agg(
        F.coalesce(F.sum("subscribed"), zero).alias(CHANNELS[0]),
        F.coalesce(F.sum("cash"), zero).alias(CHANNELS[1]),
        F.coalesce(F.sum("revenue"), zero).alias("_total"),
    )
    rest = F.greatest(F.col("_total") - F.col(CHANNELS[0]) - F.col(CHANNELS[1]), zero)
    return _long(sums.withColumn(CHANNELS[2], rest), CHANNELS, "canal", "revenue")


def anomaly_rate(tx: DataFrame) -> DataFrame:
    """Passages paid zero or less, and their share of all."""
    bad = F.count_if(F.col("montant_paye") <= 0)
    total = F.count(F.lit(1))
    return tx.agg(
        bad.alias("anomalies"), total.alias("total"), (bad * F.lit(100.0) / total).alias("pct")
    )


def anomalies(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("montant_paye") <= 0)


def headline_shares(tx: DataFrame) -> DataFrame:
    """Totals, mean amount, share of subscribers and of standard passages, exempted count."""

    def pct(column: str, value: str) -> Column:
        known = F.count(column)
        return F.count_if(F.col(column) == value) * F.lit(100.0) / known

    return tx.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        revenue("total_ca"),
        F.avg("montant_net").alias("ca_moyen"),
        pct("statut_abonnement", "Oui").alias("pct_abonnes"),
        pct("type_transaction", "Standard").alias("pct_standard"),
        F.count_if(F.col("type_transaction") == "Exonere").alias("n_exonere"),
    )


CUBE_KEYS = ("gare", "classe_vehicule", "type_paiement")


def amount_cell(amount: Column) -> Column:
    """The cell of an amount on a logarithmic grid, some 4 % wide beyond 1; null for null.

    Cells never fall where amounts rise, negative ones included; NaN is above all. No column of
    doubles has more than 33,000 cells.
    """
    cell = F.signum(amount) * F.floor(F.log2(F.abs(amount) + 1.0) * 16)
    return F.when(F.isnan(amount), F.lit(1 << 20)).otherwise(F.least(F.greatest(cell, F.lit(-1 << 19)), F.lit(1 << 19)).cast("int"))


def hourly_cube(tx: DataFrame, cells: bool = False) -> DataFrame:
    """One row per hour, station, class and payment: the base of every breakdown.

    One scan of the fact table with map-side combining; what follows works on
    this far smaller table. With ``cells``, rows are also apart by :func:`amount_cell` and tell the least
    and the largest amount; sums over the cube stay the same, and :func:`median_of_cube` can use it.
    """
    hour = hour_start(F.col("date_heure")).alias("ds")
    amount = F.col("montant_net")
    more_keys = [amount_cell(amount).alias("amount_cell")] if cells else []
    ends = [F.min(amount).alias("least_amount"), F.max(amount).alias("largest_amount")] if cells else []
    return tx.groupBy(hour, *CUBE_KEYS, *more_keys).agg(
        *ends,
        transactions(),
        *_channel_sums(),
        F.count(F.lit(1)).alias("rows"),
        F.count("montant_net").alias("amounts"),
        F.min("date_heure").alias("first"),
        F.max("date_heure").alias("last"),
    )


def period_of_cube(cube: DataFrame) -> DataFrame:
    return cube.agg(F.min("first").alias("start"), F.max("last").alias("end"))


def daily_of_cube(cube: DataFrame) -> DataFrame:
    """:func:`daily` from the cube."""
    per_day = keyed(cube, "ds").groupBy(F.to_date("ds").alias("jour")).agg(
        F.sum("transactions").alias("transactions"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
    )
    return per_day.orderBy("jour")


def breakdowns(cube: DataFrame, only: Sequence[str] = ()) -> DataFrame:
    """Transactions and revenue by station, class, payment, weekday, hour and day.

    Grouping sets over the cube: one shuffle for all six breakdowns, or for
    those named.
    """
    dims = {
        "gare": F.col("gare"),
        "classe": F.col("classe_vehicule"),
        "paiement": F.col("type_paiement"),
        "jour_semaine": F.weekday("ds").cast("string"),
        "heure": F.hour("ds").cast("string"),
        "jour": F.date_format("ds", "yyyy-MM-dd"),
    }
    dims = {name: column for name, column in dims.items() if not only or name in only}
    wide = cube.select(
        *[column.alias(f"_{name}") for name, column in dims.items()], "transactions", "revenue"
    )
    columns = [F.col(f"_{name}") for name in dims]
    sets = wide.groupingSets([[c] for c in columns], *columns).agg(
        F.sum("transactions").alias("transactions"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
        *[F.grouping(f"_{name}").alias(f"_g_{name}") for name in dims],
    )
    dimension = F.coalesce(*[F.when(F.col(f"_g_{n}") == 0, F.lit(n)) for n in dims])
    label = F.coalesce(*columns)
    return sets.select(
        dimension.alias("dimension"), label.alias("label"), "transactions", "revenue"
    ).where(F.col("label").isNotNull())


def peaks(cube: DataFrame) -> DataFrame:
    """Busiest day, hour of day and station; the first in key order wins a tie."""
    rows = breakdowns(cube, ["jour", "heure", "gare"])
    order = F.when(F.col("dimension") == "heure", F.lpad("label", 2, "0")).otherwise(F.col("label"))
    best = F.min(F.struct((-F.col("transactions")).alias("n"), order.alias("o"), "label"))
    return rows.groupBy("dimension").agg(best.alias("best")).select(
        F.col("dimension").alias("kind"),
        F.col("best.label").alias("label"),
        (-F.col("best.n")).alias("transactions"),
    )


def best_worst_day(per_day: DataFrame) -> DataFrame:
    """Of :func:`daily` rows, those of highest and lowest revenue; the earlier wins a tie."""
    top = per_day.agg(
        F.min(F.struct((-F.col("revenue")).alias("r"), "jour")).alias("best"),
        F.min(F.struct(F.col("revenue").alias("r"), "jour")).alias("worst"),
    )
    pieces = F.array(
        F.struct(
            F.lit("best").alias("kind"),
            F.col("best.jour").alias("jour"),
            (-F.col("best.r")).alias("amount"),
        ),
        F.struct(
            F.lit("worst").alias("kind"),
            F.col("worst.jour").alias("jour"),
            F.col("worst.r").alias("amount"),
        ),
    )
    return top.select(F.inline(pieces)).where(F.col("jour").isNotNull())
