"""Bindings of the given tables to the canonical fact."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peagelens.functions.scalars import clip_low

# How the `events` table stands in for toll passages.
STATIONS = ("Cotonou-Nord", "Allada", "Houegbo", "Porto-Novo", "Epke", "Parakou")
CLASSES = {"click": "MOTO", "view": "VL", "purchase": "PL"}
OTHER_CLASS = "BUS"
PAYMENTS = ("Especes", "\tBadge", " Abonné ", "Mobile Money", "Carte")


# Columns used of the given tables. Naming them spares a job that reads file footers.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: Column, labels: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in labels]), (number % len(labels)).cast("int"))


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with real times of day, from `events`. Some have no id, some no status."""
    return _passages(table(spark, sf_dir, "events"))


def _passages(ev: DataFrame, *further: str) -> DataFrame:
    vehicle = F.lit(OTHER_CLASS)
    for kind, label in CLASSES.items():
        vehicle = F.when(F.col("event_type") == kind, F.lit(label)).otherwise(vehicle)
    paid = (
        F.when(F.col("event_id") % 97 == 0, -F.col("value"))
        .when(F.col("event_id") % 89 == 0, F.lit(0.0))
        .otherwise(F.col("value"))
    )
    return ev.select(
        *further,
        F.when(F.col("event_id") % 83 != 0, F.col("event_id")).alias("id_transaction"),
        F.col("ts").alias("date_heure"),
        _pick(F.col("user_id"), STATIONS).alias("gare"),
        (F.col("event_id") % 4 + 1).cast("int").alias("voie"),
        vehicle.alias("classe_vehicule"),
        paid.alias("montant_paye"),
        clip_low(paid).alias("montant_net"),
        _pick(F.col("event_id"), PAYMENTS).alias("type_paiement"),
        F.when(F.col("event_id") % 79 == 0, None)
        .when(F.col("event_id") % 73 == 0, "Suspendu")
        .when(F.col("user_id") % 3 == 0, "Oui")
        .otherwise("Non")
        .alias("statut_abonnement"),
        F.when(F.col("event_id") % 89 == 0, "Exonere")
        .otherwise("Standard")
        .alias("type_transaction"),
    )


def tx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages over several years and many stations, from `orders`.

    No join hint: Spark broadcasts a side only when its files are small enough,
    and adaptive execution splits skewed customers otherwise.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    amount = F.round(F.col("o_totalprice") - 50000.0, 2)
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.col("o_orderkey").alias("id_transaction"),
            F.col("o_orderdate").alias("date_heure"),
            F.col("n_name").alias("gare"),
            (F.col("o_orderkey") % 4 + 1).cast("int").alias("voie"),
            F.col("c_mktsegment").alias("classe_vehicule"),
            amount.alias("montant_paye"),
            clip_low(amount).alias("montant_net"),
            F.col("o_orderpriority").alias("type_paiement"),
            F.when(F.col("c_acctbal") < 0, "Oui").otherwise("Non").alias("statut_abonnement"),
            F.when(F.col("o_orderstatus") == "P", "Exonere")
            .otherwise("Standard")
            .alias("type_transaction"),
        )
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as an untyped export: all text, untidy headers, some bad fields, names with
    commas and quotes, whole numbers with a decimal point."""
    tx = _passages(table(spark, sf_dir, "events"), "event_id")
    number = F.col("event_id")
    id_text = F.col("id_transaction").cast("string")
    when_text = F.when(number % 101 == 0, "bad-date").otherwise(
        F.date_format("date_heure", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    station = F.when(number % 109 == 0, 'Porto "Nord", A').otherwise(F.col("gare"))
    lane = F.col("voie").cast("string")
    amount_text = (
        F.when(number % 103 == 0, "N/A")
        .when(number % 127 == 0, " NaN")
        .otherwise(F.col("montant_paye").cast("string"))
    )
    return tx.select(
        F.when(number % 113 == 0, F.concat(id_text, F.lit(".0"))).otherwise(id_text).alias("ID_transaction"),
        when_text.alias(" Date Heure "),
        F.when(number % 107 != 0, station).alias("Gare"),
        F.when(number % 131 == 0, "2.5")
        .when(number % 137 == 0, F.concat(lane, F.lit(".0")))
        .otherwise(lane)
        .alias("Voie"),
        F.col("classe_vehicule").alias("Classe vehicule"),
        amount_text.alias("Montant_paye "),
        F.col("type_paiement").alias("Type_paiement"),
        F.col("statut_abonnement").alias("Statut Abonnement"),
        F.col("type_transaction").alias("Type_transaction"),
    )
