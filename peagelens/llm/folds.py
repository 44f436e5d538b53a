"""Folds of labelled documents and bounded samples for fitting."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def labelled(labels: DataFrame, label: str, n: int, held: int) -> DataFrame:
    """(__id, __label) of the rows outside fold ``held`` with a known id and label.

    An id that is labelled more than once counts once, by the larger label.
    """
    rows = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label"))
    rows = rows.where(F.col("__label").isin(0, 1) & (remainder(F.col("__id"), n) != held))
    return rows.groupBy("__id").agg(F.max("__label").alias("__label"))


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows for each label, always the same ones: the smallest hashes."""
    parts = [
        rows.where(F.col("__label") == k).orderBy(F.xxhash64("__id"), "__id").limit(limit) for k in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def texts_of(docs: DataFrame, sample: DataFrame, text_col: str = "text") -> DataFrame:
    """(__id, __label, __text) of the sampled documents; repeated rows of an id stay."""
    texts = docs.select(F.col("doc_id").alias("__id"), F.col(text_col).alias("__text"))
    return texts.join(sample, "__id")
