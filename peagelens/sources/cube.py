"""The hourly cube of the fact table, stored by month and kept current.

Each month has one state, named after the month's fact files. A refresh aggregates only the months whose
files are new or changed since; the cube is the months' current states side by side, because no hour belongs to
two months. A state counts only once its marker stands, so a refresh that dies is simply done again. Refreshes must
not overlap with each other or with a load.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peagelens.operators.traffic import hourly_cube
from peagelens.session import remove
from peagelens.sources.fact import MONTH, _STORED, _system, current_version, paid

STATE = "state"
#: Begins the name of each state; another layout of the cube needs another one, so that older states do not count.
_LAYOUT = "cells"
#: Spark's folder name for rows without a time.
_UNDATED = "__HIVE_DEFAULT_PARTITION__"
_DONE = "_done"


def _root(spark: SparkSession, path: str) -> str:
    version = current_version(spark, path)
    return f"{path}/{version}" if version else path


def month_states(spark: SparkSession, path: str) -> dict[str, str]:
    """The state of each month of the fact table at ``path``: number and bytes of its files, and a digest of their
    names, sizes and times. Spark lists the files and opens none; one row for each month comes back."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_root(spark, path))
    month = F.regexp_extract("path", f"{MONTH}=([^/]+)/", 1)
    told = F.xxhash64(F.substring_index("path", "/", -1), "length", F.unix_micros("modificationTime"))
    digest = F.hex(F.bit_xor(told))
    states = (
        files.where(F.col("path").endswith(".parquet"))
        .groupBy(month.alias("month"))
        .agg(F.concat_ws("-", F.lit(_LAYOUT), F.count(F.lit(1)), F.sum("length"), digest).alias("state"))
    )
    return {r.month: r.state for r in states.collect()}


def _stored(spark: SparkSession, cube_path: str) -> set[tuple[str, str]]:
    """(month, state) of every state whose marker stands."""
    files, there = _system(spark, cube_path)
    done = there(f"{cube_path}/{_DONE}")
    if not files.exists(done):
        return set()
    return {tuple(e.getPath().getName().split("@", 1)) for e in files.listStatus(done)}


def _folder(cube_path: str, month: str, state: str) -> str:
    return f"{cube_path}/{MONTH}={month}/{STATE}={state}"


def changed_rows(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """Rows of the given months of the fact table; no other month is listed or read."""
    root = _root(spark, path)
    reader = spark.read.schema(_STORED).option("basePath", root)
    return reader.parquet(*[f"{root}/{MONTH}={m}" for m in months])


def refresh_cube(spark: SparkSession, path: str, cube_path: str) -> list[str]:
    """Bring the cube of paying passages up to date; the months that were aggregated, in order.

    One scan of the changed months, reduced on the map side. No fact files give no months.
    """
    states = month_states(spark, path)
    have = _stored(spark, cube_path)
    missing = sorted(m for m, state in states.items() if (m, state) not in have)
    if not missing:
        return []
    files, there = _system(spark, cube_path)
    for month in missing:  # what a refresh that died may have left
        files.delete(there(_folder(cube_path, month, states[month])), True)
    # The month is part of the key, but an hour has one month: the groups are those of the cube.
    rows = changed_rows(spark, path, missing)
    named = F.create_map(*[F.lit(x) for m in missing for x in (m, states[m])])
    cube = hourly_cube(paid(rows), cells=True).withColumn(MONTH, F.date_format("ds", "yyyy-MM"))
    cube = cube.withColumn(STATE, named[F.coalesce(F.col(MONTH), F.lit(_UNDATED))])
    cube.hint("rebalance", MONTH).write.mode("append").partitionBy(MONTH, STATE).parquet(cube_path)
    for month in missing:
        files.create(there(f"{cube_path}/{_DONE}/{month}@{states[month]}"), True).close()
    return missing


def read_cube(spark: SparkSession, path: str, cube_path: str) -> DataFrame:
    """The cube of the fact table as it is now, refreshed first; see :func:`traffic.hourly_cube` with cells for its columns.

    Months without a paying passage have no rows. An empty fact table gives an empty cube.
    """
    refresh_cube(spark, path, cube_path)
    files, there = _system(spark, cube_path)
    folders = [_folder(cube_path, m, s) for m, s in sorted(month_states(spark, path).items())]
    schema = hourly_cube(paid(spark.createDataFrame([], _STORED)), cells=True).schema
    present = [f for f in folders if files.exists(there(f))]
    if not present:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*present)


def drop_stale(spark: SparkSession, path: str, cube_path: str) -> int:
    """Remove states that are no longer current; how many. Frames read before from them cannot be read again."""
    current = set(month_states(spark, path).items())
    old = _stored(spark, cube_path) - current
    for month, state in old:
        remove(spark, f"{cube_path}/{_DONE}/{month}@{state}")
        remove(spark, _folder(cube_path, month, state))
    return len(old)
