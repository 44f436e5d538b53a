"""Scalar column expressions: coercion, clipping, growth, text."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from peagelens.schema import CASH_PAYMENTS, NA_MARKERS, SUBSCRIBER_PAYMENTS, SUBSCRIBER_STATUS


def known_text(text: Column) -> Column:
    """Null for the texts that stand for a missing value."""
    return F.when(~text.isin(*NA_MARKERS), text)


def to_timestamp_or_null(text: Column, formats: Sequence[str] = ()) -> Column:
    """ISO text with a full date, else the first of the given patterns that fits."""
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), text).try_cast("timestamp_ntz")
    others = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(iso, *others)


def to_number_or_null(text: Column) -> Column:
    """Numeric text to double; a Java type suffix (``1d``) is no number, nor is NaN."""
    number = F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text).try_cast("double")
    return F.when(~F.isnan(number), number)


def to_whole_or_null(text: Column, kind: str) -> Column:
    """Text of a whole number, ``2.0`` too, to an integer type; a fraction becomes null."""
    number = text.try_cast("decimal(38,6)")
    return F.when(number == F.floor(number), number).try_cast(kind)


def clip_low(x: Column, low: float = 0.0) -> Column:
    """Raise to ``low``; null stays null (``greatest`` would drop it)."""
    return F.when(x < low, F.lit(low)).otherwise(x)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """Clamp a non-null value to ``[low, high]``."""
    low = F.lit(low) if isinstance(low, (int, float)) else low
    high = F.lit(high) if isinstance(high, (int, float)) else high
    return F.least(F.greatest(x, low), high)


def growth_pct(current: Column, previous: Column) -> Column:
    """Growth in percent; 0 when there is nothing positive to compare with."""
    return F.when(previous <= 0, F.lit(0.0)).otherwise((current - previous) / previous * 100.0)


def folded(text: Column) -> Column:
    """Lower case without white space of any kind at the ends."""
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def is_subscriber(status: Column, payment: Column) -> Column:
    by_status = F.coalesce(folded(status) == SUBSCRIBER_STATUS, F.lit(False))
    by_payment = F.coalesce(folded(payment).isin(*SUBSCRIBER_PAYMENTS), F.lit(False))
    return by_status | by_payment


def is_cash(payment: Column) -> Column:
    return F.coalesce(folded(payment).isin(*CASH_PAYMENTS), F.lit(False))


def slug(name: Column) -> Column:
    """File-safe lower-case name."""
    return F.regexp_replace(F.lower(name), "[- ]", "_")


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)
