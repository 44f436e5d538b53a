"""CSV files of passages: scan, and the writer that makes such a file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peagelens.functions.scalars import known_text

#: Holds the whole text of a row whose number of fields is not that of the header.
BAD_RECORD = "_bad_record"
#: Quotes inside a quoted field are doubled; values keep their blanks.
_DIALECT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_raw(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as text, matched to the header by name, missing markers as null.

    Whole lines are split among tasks, so one huge file still reads in parallel.
    ``multiline=True`` is for files with line breaks inside quoted fields; each file
    is then read by one task. ``BAD_RECORD`` is null for rows of the right number of fields.
    """
    reader = spark.read.options(**_DIALECT, multiLine=multiline)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, BAD_RECORD]])
    # Without pruning every row is parsed in full, so a wrong number of fields is noticed.
    raw = reader.options(
        mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_RECORD, enforceSchema=False, columnPruning=False
    ).csv(path, schema=schema)
    return raw.select(*[known_text(F.col(f"`{c}`")).alias(c) for c in names], BAD_RECORD)


def write_raw(df: DataFrame, path: str) -> None:
    """Write text columns as CSV without trimming a header or a value."""
    df.write.mode("overwrite").options(**_DIALECT).csv(path)
