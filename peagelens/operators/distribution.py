"""Distributions: spread, boxes, histograms, density, correlation, pivots, profile."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peagelens.operators.numeric import kernel_sums
from peagelens.operators.quantiles import quantiles_of, value_counts
from peagelens.operators.traffic import keyed, revenue
from peagelens.session import settle

FENCE = 1.5


def _stats(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean, minimum, maximum and sample deviation of :func:`value_counts`.

    The deviation sums squared differences from the mean, so large means cost no digits.
    """
    known = F.col("_v").isNotNull()
    n = F.coalesce(F.sum(F.when(known, F.col("_c"))), F.lit(0))
    plain = counts.groupBy(*keys).agg(
        n.alias("count"),
        (F.sum(F.col("_v") * F.col("_c")) / F.nullif(n, F.lit(0))).alias("mean"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )
    means = plain.select(*keys, F.col("mean").alias("_mean"))
    if keys:
        off = counts.join(means, list(keys))
    else:
        off = counts.withColumn("_mean", means.scalar())
    gap = F.col("_v") - F.col("_mean")
    spread = off.groupBy(*keys).agg(F.sum(gap * gap * F.col("_c")).alias("_ss"))
    if keys:
        joined = plain.join(spread, list(keys))
    else:
        joined = plain.withColumn("_ss", spread.scalar())
    std = F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / (F.col("count") - 1)))
    return joined.withColumn("std", std).drop("_ss")


def amount_stats(
    tx: DataFrame, key: str = "classe_vehicule", value: str = "montant_net"
) -> DataFrame:
    """Count, mean, exact median, minimum, maximum and sample deviation per key; one pass."""
    counts = value_counts(tx, value, [key], "amounts")
    median = quantiles_of(counts, [0.5], [key])
    joined = _stats(counts, [key]).join(
        median.select(key, F.col("quantiles")[0].alias("median")), key, "left"
    )
    return joined.select(key, "count", "mean", "median", "min", "max", "std")


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")]


def describe(tx: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, one row per column; one pass."""
    long = tx.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "variable", "value"
    )
    counts = value_counts(long, "value", ["variable"], "described")
    quartiles = quantiles_of(counts, [0.25, 0.5, 0.75], ["variable"])
    cut = quartiles.select("variable", *_named(["p25", "p50", "p75"]))
    return _stats(counts, ["variable"]).join(cut, "variable", "left").select(
        "variable", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def _named(names: Sequence[str]) -> list[Column]:
    return [F.col("quantiles")[i].alias(name) for i, name in enumerate(names)]


def _fences(counts: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    cut = quantiles_of(counts, [0.25, 0.5, 0.75], keys)
    iqr = F.col("q3") - F.col("q1")
    return cut.select(*keys, *_named(["q1", "median", "q3"])).withColumns(
        {"low_fence": F.col("q1") - iqr * reach, "high_fence": F.col("q3") + iqr * reach}
    )


def fences(
    tx: DataFrame,
    value: str = "montant_net",
    key: str | None = "classe_vehicule",
    reach: float = FENCE,
) -> DataFrame:
    """Quartiles per key and the fences ``reach`` inter-quartile ranges outside them.

    ``key=None`` takes all passages together.
    """
    keys = [key] if key else []
    return _fences(value_counts(tx, value, keys, "amounts"), keys, reach)


def _with_fences(rows: DataFrame, bounds: DataFrame, key: str | None) -> DataFrame:
    """Rows with the fences of their key.

    The fences are settled first: the planner sees their real size and sends
    them to the tasks when they are small, so the larger side does not move.
    """
    bounds = settle(bounds, "fences")
    if key:
        return rows.join(bounds, key)
    box = bounds.select(F.struct(*bounds.columns)).scalar()
    return rows.withColumn("_box", box).select("*", "_box.*").drop("_box")


def box_outliers(
    tx: DataFrame, value: str = "montant_net", key: str | None = "classe_vehicule"
) -> DataFrame:
    """Passages outside the fences of their key."""
    outside = (F.col(value) < F.col("low_fence")) | (F.col(value) > F.col("high_fence"))
    rows = keyed(tx, *([key] if key else []), value)
    fenced = _with_fences(rows, fences(tx, value, key), key).where(outside)
    return fenced.select("id_transaction", *([key] if key else []), value)


def box_stats(
    tx: DataFrame, value: str = "montant_net", key: str | None = "classe_vehicule"
) -> DataFrame:
    """Quartiles, whiskers (extremes inside the fences) and number of outliers per key.

    All from one pass: whiskers and outliers come from the counted values too.
    """
    keys = [key] if key else []
    counts = value_counts(tx, value, keys, "amounts")
    fenced = _with_fences(counts.where(F.col("_v").isNotNull()), _fences(counts, keys, FENCE), key)
    inside = F.col("_v").between(F.col("low_fence"), F.col("high_fence"))
    box = ["q1", "median", "q3"]
    return fenced.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in box],
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_c"))), F.lit(0)).alias("n_outliers"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Rows per equal-width bin; the last bin is closed; empty bins are kept.

    A value is held against the bin edges after the division, so a value on an
    edge is always counted in the bin it opens.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    bounds = known.agg(F.min("_v").alias("low"), F.max("_v").alias("high")).select(
        F.struct(
            F.when(F.col("low") < F.col("high"), F.col("low"))
            .otherwise(F.col("low") - 0.5)
            .alias("low"),
            F.when(F.col("low") < F.col("high"), F.col("high"))
            .otherwise(F.col("high") + 0.5)
            .alias("high"),
        )
    )
    span = bounds.scalar()
    low, high = span["low"], span["high"]
    width = (high - low) / bins

    def edge(i: Column) -> Column:
        return low + i * width

    guess = F.floor((F.col("_v") - low) / width)
    fixed = (
        F.when(F.col("_v") < edge(guess), guess - 1)
        .when(F.col("_v") >= edge(guess + 1), guess + 1)
        .otherwise(guess)
    )
    bin_no = F.least(F.greatest(fixed, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = known.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("low"),
        edge(F.col("bin") + 1).alias("high"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    ).where(F.col("low").isNotNull())


def density(df: DataFrame, value: str, bins: int = 100, points: int = 200) -> DataFrame:
    """Gaussian kernel density at ``points`` even steps from minimum to maximum.

    Bandwidth is deviation times ``n ** -0.2``. ``expected_count`` is the density
    on the scale of a histogram of ``bins`` bins. Equal values are merged first;
    a task sums the kernel over its Arrow batches and hands on one row per grid
    point, so values never meet the grid as rows.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    shape = known.agg(
        F.struct(
            F.min("_v").alias("low"),
            F.max("_v").alias("high"),
            F.count(F.lit(1)).alias("n"),
            (F.stddev_samp("_v") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h"),
        )
    ).scalar()
    low, high, n, h = (shape[name] for name in ("low", "high", "n", "h"))
    step = (high - low) / (points - 1)
    freq = known.groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    scaled = freq.select("_c", ((F.col("_v") - low) / h).alias("_z"), (step / h).alias("_dz"))

    partial = scaled.mapInPandas(kernel_sums(points), "point int, s double")
    rows = partial.groupBy("point").agg(F.sum("s").alias("s"))
    value_at = F.col("s") / (n * h * math.sqrt(2.0 * math.pi))
    return rows.select(
        "point",
        (low + F.col("point") * step).alias("x"),
        value_at.alias("density"),
        (value_at * n * (high - low) / bins).alias("expected_count"),
    ).where(F.col("x").isNotNull())


#: Cells of the binned density are this part of the bandwidth wide, and a cell is felt so many bandwidths away.
CELL, REACH = 1 / 50, 9.0


def binned_density(df: DataFrame, value: str, bins: int = 100, points: int = 200) -> DataFrame:
    """:func:`density` from cells a fiftieth of the bandwidth wide: within 1e-4 of the peak, without Python workers.

    Each value is split over the two cells beside it, in proportion to its distance from them, while it is
    aggregated; only occupied cells are rows, and each adds its kernel to the grid points within its reach. So the kernel
    is worked out for cells, not for distinct values. No values, or values without spread, give no rows.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    shape = known.agg(
        F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("n"), F.stddev_samp("_v").alias("std")
    ).first()
    if not shape.n or not shape.std:
        nothing = known.select(F.lit(0).alias("point"), *[F.col("_v").alias(c) for c in ("x", "density", "expected_count")])
        return nothing.limit(0)
    low, high, n = shape.low, shape.high, shape.n
    h = shape.std * n**-0.2
    step, cell = (high - low) / (points - 1), h * CELL
    at = (F.col("_v") - low) / cell
    split = known.select(F.floor(at).alias("cell"), (at - F.floor(at)).alias("part"))
    halves = split.groupBy("cell").agg(F.sum(1.0 - F.col("part")).alias("w"), F.sum("part").alias("next"))
    cells = halves.select("cell", "w").unionByName(halves.select((F.col("cell") + 1).alias("cell"), F.col("next").alias("w")))
    placed = cells.groupBy("cell").agg(F.sum("w").alias("w")).withColumn("at", F.col("cell") * cell)
    first = F.greatest(F.ceil((F.col("at") - REACH * h) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("at") + REACH * h) / step), F.lit(points - 1)).cast("int")
    felt = placed.where(first <= last).select("w", "at", F.explode(F.sequence(first, last)).alias("point"))
    z = (F.col("at") - F.col("point") * step) / h
    zero = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"), F.lit(0.0).alias("k"))
    kernels = felt.select("point", (F.col("w") * F.exp(-0.5 * z * z)).alias("k")).unionByName(zero)
    value_at = F.sum("k") / (n * h * math.sqrt(2.0 * math.pi))
    rows = kernels.groupBy("point").agg(value_at.alias("density"))
    return rows.select(
        "point", (low + F.col("point") * step).alias("x"), "density",
        (F.col("density") * n * (high - low) / bins).alias("expected_count"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations over rows where both values are known; one aggregate."""
    columns = list(columns)
    pairs = {(a, b): F.corr(a, b) for i, a in enumerate(columns) for b in columns[i:]}
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    row = typed.agg(*[F.struct(*[c.alias(f"{a}|{b}") for (a, b), c in pairs.items()]).alias("_m")])

    def cell(a: str, b: str) -> Column:
        name = f"{a}|{b}" if (a, b) in pairs else f"{b}|{a}"
        return F.col("_m").getField(name).alias(b)

    lines = [F.struct(F.lit(a).alias("variable"), *[cell(a, b) for b in columns]) for a in columns]
    return row.select(F.inline(F.array(*lines)))


def pivot_mean_amount(tx: DataFrame) -> DataFrame:
    """Mean net amount by payment type (rows) and every subscription status found (columns).

    Passages are reduced to sums by payment and status first, so finding the statuses and
    the pivot are passes over that small result.
    """
    known = keyed(tx, "type_paiement", "statut_abonnement", "montant_net")
    sums = known.groupBy("type_paiement", "statut_abonnement").agg(
        F.sum("montant_net").alias("s"), F.count(F.lit(1)).alias("n")
    )
    cells = settle(sums, "pivot-cells").select(
        "type_paiement", "statut_abonnement", (F.col("s") / F.col("n")).alias("mean")
    )
    return cells.groupBy("type_paiement").pivot("statut_abonnement").agg(F.first("mean"))


def pivot_month_year(tx: DataFrame, measure: str, years: Sequence[int] | None = None) -> DataFrame:
    """``count`` or ``revenue`` by month (rows) and year (columns).

    Passages are reduced to months first, so finding the years is a pass over
    that small result, and so is the pivot.
    """
    at = F.col("date_heure")
    months = keyed(tx, "date_heure").groupBy(
        F.month(at).alias("mois_num"),
        F.date_format(at, "MMMM").alias("mois"),
        F.year(at).alias("annee"),
    ).agg(F.count(F.lit(1)).alias("count"), revenue())
    if years is None:
        months = settle(months, "months")
    pivoted = months.groupBy("mois_num", "mois").pivot("annee", years)
    return pivoted.agg(F.first(measure, ignorenulls=True))


def profile(df: DataFrame) -> DataFrame:
    """Type, known values and missing values of every column; one aggregate."""
    counts = [F.count(F.col(c)).alias(c) for c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), F.struct(*counts).alias("_known"))
    lines = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("dtype"),
            F.col("_known").getField(name).alias("non_null"),
            (F.col("_rows") - F.col("_known").getField(name)).alias("nulls"),
        )
        for name, kind in df.dtypes
    ]
    return row.select(F.inline(F.array(*lines)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and repeats; nulls equal each other.

    Only a 64-bit hash per row is shuffled at first. Rows whose hash is alone
    are distinct; the others are compared in full, so a collision cannot
    falsify the result. The shared hashes are settled: while they are few they
    go to the tasks and the full rows do not move, else Spark joins by shuffle.
    """
    hashed = df.withColumn("_h", F.xxhash64(*df.columns))
    by_hash = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_c"))
    shared = settle(by_hash.where(F.col("_c") > 1).select("_h"), "shared-hashes")
    groups = hashed.join(shared, "_h", "left_semi").groupBy(*df.columns).agg(
        F.count(F.lit(1)).alias("_c")
    )
    repeats = groups.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("repeats")).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        (F.col("n_rows") - repeats).alias("n_distinct"),
        F.coalesce(repeats, F.lit(0)).alias("n_duplicates"),
    )
