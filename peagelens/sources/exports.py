"""Sinks for forecasts, model records and result documents."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peagelens.functions.scalars import slug


def file_names(forecast: DataFrame) -> DataFrame:
    """(gare, gare_safe): each station's file-safe name; further stations of one name get ``~2``, ``~3`` and so on."""
    same = Window.partitionBy("_slug").orderBy("gare")
    stations = forecast.select("gare").distinct().select("gare", slug(F.col("gare")).alias("_slug"))
    place = F.row_number().over(same)
    number = F.when(place > 1, F.concat(F.lit("~"), place.cast("string"))).otherwise("")
    return stations.select("gare", F.concat("_slug", number).alias("gare_safe"))


def write_forecast_csv(forecast: DataFrame, path: str) -> None:
    """One CSV file per station, in a folder of its own file-safe name; a row per future hour."""
    names = file_names(forecast).withColumnRenamed("gare", "_gare")
    (
        forecast.join(names, F.col("gare").eqNullSafe(F.col("_gare")))
        .select("gare_safe", *forecast.columns)
        .repartition("gare_safe")
        .sortWithinPartitions("gare_safe", "datetime")
        .drop("gare")
        .write.mode("overwrite")
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .partitionBy("gare_safe")
        .csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines."""
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").json(path)


def as_documents(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, times in ISO form."""
    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"}
    return df.select(F.to_json(F.struct("*"), options).alias("document"))
