"""Mixing sources to target weights by hash thresholds, without sorting documents.

Each document has a 60-bit hash of its id and text. A source's target is met by
whole passes over the source and one partial pass: every document whose hash is
at most the source's cut. The cut comes from nested histograms of words by
leading hash bits; each level looks only into the bucket where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peagelens.session import settle

HASH_BITS = 60
#: Leading bits of the hash that each level tells apart; the last tells single hashes.
LEVELS = (10, 20, 30, HASH_BITS)
#: A source gives at most so many times its own size.
MOST = 3


def words(text: Column) -> Column:
    """Number of runs of characters other than the space and 0x09-0x0D; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_key(doc_id: Column, text: Column) -> Column:
    """The leading 60 bits of the MD5 of id and text; nulls count as empty."""
    blank = F.lit("")
    whole = F.concat(F.coalesce(doc_id.cast("string"), blank), F.lit("\x1f"), F.coalesce(text, blank))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows with source and size.

    Weights 1, 2, 3 repeat over the sources by code point, null last. Sources whose
    limit is reached first are limited first: a source is limited if the level of
    those after it, words for each unit of weight, lies above its own limit. The
    windows see one row per source, never documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn(
        "w", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1
    )
    limit = F.col("source_size") * MOST
    everything = Window.partitionBy(F.lit(0))
    by_limit = everything.orderBy(limit / F.col("w"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    units = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    capped = ranked.withColumn("capped", left / units > limit / F.col("w"))
    free = F.sum("source_size").over(everything) - F.coalesce(
        F.sum(F.when(F.col("capped"), limit)).over(everything), F.lit(0)
    )
    free_units = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    target = F.when(F.col("capped"), limit.cast("double")).otherwise(free / free_units * F.col("w"))
    return capped.select("source", "source_size", target.alias("target"))


def plan(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, cut): how each source is mixed.

    ``sizes`` has source, size and key. A document is taken ``passes`` times, and once
    more if its key is at most ``cut``. The documents of the boundary hash join the
    partial pass if that brings the source nearer to its target.
    """
    goal = targets(sizes)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("passes", passes.cast("long"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    goal = settle(goal.withColumn("budget", rest), "mix-targets")
    edge = goal.where(F.col("budget") > 0).select(
        F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("held"),
    )
    known = 0
    for bits in LEVELS:
        inside = sizes.join(
            edge.drop("held"),
            sizes["source"].eqNullSafe(edge["s"])
            & (F.shiftright(sizes["key"], HASH_BITS - known) == edge["prefix"]),
        )
        bucket = F.shiftright("key", HASH_BITS - bits)
        summed = inside.groupBy("s", "budget", "before", bucket.alias("bucket")).agg(F.sum("size").alias("held"))
        so_far = Window.partitionBy("s").orderBy("bucket")
        below = F.col("before") + F.sum("held").over(so_far) - F.col("held")
        edge = (
            summed.withColumn("below", below)
            .where((F.col("below") < F.col("budget")) & (F.col("below") + F.col("held") >= F.col("budget")))
            .select("s", "budget", F.col("bucket").alias("prefix"), F.col("below").alias("before"), "held")
        )
        known = bits
    over = F.col("before") + F.col("held") - F.col("budget")
    cut = F.when(over < F.col("budget") - F.col("before"), F.col("prefix")).otherwise(F.col("prefix") - 1)
    cuts = edge.select("s", cut.alias("cut"))
    joined = goal.join(cuts, goal["source"].eqNullSafe(cuts["s"]), "left")
    return settle(
        joined.select(
            "source", "source_size", "target", "passes", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut")
        ),
        "mix-plan",
    )


def apply_plan(rows: DataFrame, mixed: DataFrame, source: str, size: str, key: str) -> DataFrame:
    """``rows`` with _source_size, _target and _taken; named columns hold source, size and key."""
    p = mixed.select(
        F.col("source").alias("_p_source"), F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"), F.col("passes").alias("_passes"), F.col("cut").alias("_cut"),
    )
    joined = rows.join(p, rows[source].eqNullSafe(p["_p_source"]))
    taken = rows[size] * (F.col("_passes") + (rows[key] <= F.col("_cut")).cast("long"))
    return joined.withColumn("_taken", taken).drop("_p_source", "_passes", "_cut")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key) for each row of docs."""
    return docs.select(
        "doc_id", "source", words(F.col("text")).alias("size"), hash_key(F.col("doc_id"), F.col("text")).alias("key")
    )


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs.

    A null text has size 0; null sources are one source, the last; rows alike in id and
    text have one hash and are taken alike; empty tables give no rows. Other columns
    of docs are not looked at.
    """
    sizes = settle(measured(docs), "mix-sizes")
    done = apply_plan(sizes, plan(sizes), "source", "size", "key")
    return done.select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )
