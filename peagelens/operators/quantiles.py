"""Exact quantiles per group without holding a group in one task.

Spark's ``percentile`` keeps every distinct value of a group in the memory of
one task. Here all values are cut at approximate quantiles into buckets, ranks
are counted per key and bucket, and only the few buckets that contain a wanted
rank are put in order. The cut points need not be good for the result to be
exact: they only even out the work.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peagelens.session import settle

BUCKETS = 256  # a power of two
PER_BUCKET = 1 << 14  # distinct values of a bucket, about, once there are more buckets


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = (), kept: str = "values") -> DataFrame:
    """How often each value ``_v`` occurs per key, ``_c``; null values count, null keys do not.

    Equal values are merged before the shuffle, so a value or key that holds a third of
    all rows costs one row per task. The result is settled: quantiles, deviations,
    whiskers and counts all come from it without another pass over the rows.
    """
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    counts = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    return settle(counts, kept)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """``n`` and ``quantiles`` (linear interpolation, in the order of ``probs``) per key.

    Rows with a null value or key are left out.
    """
    return quantiles_of(value_counts(df, value, keys), probs, keys, buckets)


def quantiles_of(
    counts: DataFrame, probs: Sequence[float], keys: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """:func:`exact_quantiles` of :func:`value_counts`.

    The number of buckets follows the number of distinct values, so one task never
    orders much more than ``PER_BUCKET`` of them.
    """
    keys = list(keys)
    freq = counts.where(F.col("_v").isNotNull())
    if buckets is None:
        buckets = BUCKETS
        distinct = freq.count()
        while buckets * PER_BUCKET < distinct:
            buckets *= 2
    placed = _place(freq, buckets)
    hot = _hot_buckets(placed, keys, probs)
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_v")
    upto = F.col("_before") + F.sum("_c").over(
        in_bucket.rowsBetween(Window.unboundedPreceding, 0)
    )
    ordered = placed.join(hot, [*keys, "_b"]).withColumn("_upto", upto)
    found = ordered.groupBy(*keys).agg(
        F.max("_n").alias("n"), *[c for i, p in enumerate(probs) for c in _at_ranks(i, p)]
    )
    quantiles = [_between(i, p) for i, p in enumerate(probs)]
    return found.select(*keys, "n", F.array(*quantiles).alias("quantiles"))


def _place(freq: DataFrame, buckets: int) -> DataFrame:
    """Adds ``_b``, the number of cut points below the value, by halving steps.

    The cut points split the values of all keys together, so no key's share of
    a bucket is larger than the bucket.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = freq.agg(F.percentile_approx("_v", shares, 4 * buckets)).scalar()
    placed = freq.withColumns({"_cuts": cuts, "_b": F.lit(0)})
    step = buckets // 2
    while step:
        cut = F.get("_cuts", F.col("_b") + (step - 1))
        placed = placed.withColumn("_b", F.col("_b") + F.when(cut < F.col("_v"), step).otherwise(0))
        step //= 2
    return placed.drop("_cuts")


def _hot_buckets(placed: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """Keys and buckets that hold a wanted rank, with the number of rows before and in all."""
    totals = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"))
    # One row per key and bucket, so at most `buckets` rows in a window.
    per_key = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.sum("_c").over(per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    ranked = totals.withColumns(
        {"_before": F.coalesce(before, F.lit(0)), "_n": F.sum("_c").over(per_key)}
    )
    wanted = F.lit(False)
    for p in probs:
        for rank in _ranks(F.col("_n"), p)[:2]:
            wanted |= (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_c"))
    return ranked.where(wanted).select(*keys, "_b", "_before", "_n")


def _ranks(n: Column, p: float) -> tuple[Column, Column, Column]:
    """Ranks (from 0) below and above the quantile, and the position between."""
    position = (n - 1) * F.lit(float(p))
    return F.floor(position), F.ceil(position), position


def _at_ranks(i: int, p: float) -> list[Column]:
    low, high, _ = _ranks(F.col("_n"), p)

    def value_at(rank: Column) -> Column:
        start = F.col("_upto") - F.col("_c")
        return F.max(F.when((start <= rank) & (rank < F.col("_upto")), F.col("_v")))

    return [value_at(low).alias(f"_low{i}"), value_at(high).alias(f"_high{i}")]


def _between(i: int, p: float) -> Column:
    low, _, position = _ranks(F.col("n"), p)
    share = position - low
    return F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * share
