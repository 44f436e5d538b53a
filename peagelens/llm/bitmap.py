"""A map of bounded size that tells most rows without a partner, so that they need not be shuffled."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map; it is broadcast, at most a 64th of them as rows.
BITS = 1 << 24


def marked(rows: DataFrame, value: Column, wanted: DataFrame, mark: str) -> DataFrame:
    """rows with a column ``mark``: true if the hash ``value`` is in ``wanted`` (one column of hashes), and for some others.

    More wanted hashes let more others pass, so an exact join has to follow on the marked rows.
    """
    bit = F.expr("shiftleft(1L, cast(__at % 64 as int))")
    held = wanted.select(F.pmod(F.col(wanted.columns[0]), F.lit(BITS)).alias("__at"))
    words = held.groupBy(F.shiftright("__at", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    at = rows.withColumn("__at", F.pmod(value, F.lit(BITS))).withColumn("__word", F.shiftright("__at", 6))
    found = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return at.join(F.broadcast(words), "__word", "left").select(*rows.columns, found.alias(mark))


def likely(rows: DataFrame, value: Column, wanted: DataFrame) -> DataFrame:
    """The marked rows alone."""
    return marked(rows, value, wanted, "__likely").where("__likely").drop("__likely")
