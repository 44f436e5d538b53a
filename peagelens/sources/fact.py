"""The fact table: write, read, and the two standard scans."""

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peagelens.functions.calendar import month_key
from peagelens.schema import FACT

MONTH = "annee_mois"
#: The file that names the current version of the table.
POINTER = "_CURRENT"
_STORED = T.StructType([*FACT.fields, T.StructField(MONTH, T.StringType())])
PAID_COLUMNS = [
    "id_transaction", "date_heure", "gare", "voie", "classe_vehicule", "montant_paye",
    "montant_net", "type_paiement", "statut_abonnement", "type_transaction",
]


def _by_month(df: DataFrame, rebalance: bool = True) -> DataFrame:
    """Rows of a month together, in files of advisory size.

    The rebalance step splits a month that holds far more rows than the others
    and merges small ones, so neither one task nor many tiny files result.
    """
    dated = df.withColumn(MONTH, month_key(F.col("date_heure")))
    return dated.hint("rebalance", MONTH) if rebalance else dated


def _system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the class of its paths."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return there(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder, within the table's, that readers use now; None for a table without versions."""
    files, there = _system(spark, path)
    pointer = there(f"{path}/{POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Make a written version the current one: the pointer is written aside and renamed over the old one."""
    files, there = _system(spark, path)
    aside = there(f"{path}/{POINTER}-{version}")
    stream = files.create(aside, True)
    stream.writeUTF(version)
    stream.close()
    options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    swap = spark.sparkContext._gateway.new_array(options, 1)
    swap[0] = options.OVERWRITE
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    context.rename(context.makeQualified(aside), context.makeQualified(there(f"{path}/{POINTER}")), swap)


def write_fact(df: DataFrame, path: str, rebalance: bool = True) -> None:
    """Full refresh of the fact table, one folder per month.

    The new table is written beside the old one; then one small pointer file is swapped. A load that fails
    or is killed leaves the old table current, and readers that hold it go on reading it: it is removed by the refresh
    after this one. One writer at a time. ``rebalance=False`` writes without a shuffle; right
    for exports that are already in time order, where each task sees one or two months.
    """
    spark, version = df.sparkSession, f"version-{uuid.uuid4().hex}"
    before = current_version(spark, path)
    _by_month(df, rebalance).write.partitionBy(MONTH).parquet(f"{path}/{version}")
    _point(spark, path, version)
    files, there = _system(spark, path)
    for entry in files.listStatus(there(path)):
        name = entry.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            files.delete(entry.getPath(), True)


def append_fact(df: DataFrame, path: str, rebalance: bool = True) -> None:
    """Add passages to the current version of the fact table; files of other months are not touched.

    Spark's commit moves the new files in at the end of the job. Nothing tells a repeated load from
    new rows: loads that may repeat belong in :func:`write_fact`.
    """
    version = current_version(df.sparkSession, path)
    target = f"{path}/{version}" if version else path
    _by_month(df, rebalance).write.mode("append").partitionBy(MONTH).parquet(target)


def save_fact_table(df: DataFrame, name: str) -> None:
    """Full refresh of a catalog table, partitioned by month."""
    (
        _by_month(df).write.mode("overwrite").format("parquet").partitionBy(MONTH)
        .saveAsTable(name)
    )


def read_fact(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """The fact table, optionally only ``[start, end)``, reading only those months."""
    version = current_version(spark, path)
    df = spark.read.schema(_STORED).parquet(f"{path}/{version}" if version else path)
    at = F.col("date_heure")
    if start is not None:
        df = df.where((F.col(MONTH) >= f"{start:%Y-%m}") & (at >= _ntz(start)))
    if end is not None:
        df = df.where((F.col(MONTH) <= f"{end:%Y-%m}") & (at < _ntz(end)))
    return df.drop(MONTH)


def _ntz(moment: datetime):
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def paid(tx: DataFrame) -> DataFrame:
    """Paying passages; null and zero amounts are left out."""
    return tx.where(F.col("montant_net") > 0).select(*PAID_COLUMNS)


def all_passages(tx: DataFrame) -> DataFrame:
    """Every passage, with the columns that counting needs."""
    return tx.select("date_heure", "id_transaction", "gare", "classe_vehicule")
