"""The canonical fact schema and the fixed vocabulary of the domain."""

from pyspark.sql import types as T

FACT = T.StructType(
    [
        T.StructField("id_transaction", T.LongType()),
        T.StructField("date_heure", T.TimestampNTZType()),
        T.StructField("gare", T.StringType()),
        T.StructField("voie", T.IntegerType()),
        T.StructField("classe_vehicule", T.StringType()),
        T.StructField("montant_paye", T.DoubleType()),
        T.StructField("montant_net", T.DoubleType()),
        T.StructField("type_paiement", T.StringType()),
        T.StructField("statut_abonnement", T.StringType()),
        T.StructField("type_transaction", T.StringType()),
        T.StructField("load_timestamp", T.TimestampNTZType()),
    ]
)

# Labels and spellings that results must carry exactly.
WEEKDAYS_FR = ("Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche")
DAY_PERIODS = (("Nuit", 0, 6), ("Matin", 6, 12), ("Après-midi", 12, 18), ("Soir", 18, 24))
SUBSCRIBER_STATUS = "oui"
SUBSCRIBER_PAYMENTS = ("abonne", "abonné", "badge")
CASH_PAYMENTS = ("especes", "espèces", "cash")
CHANNELS = ("Abonnés", "Cash", "Autres")

# Texts that a CSV field may hold to mean "missing".
NA_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Forecasting set-up.
LOOKBACK_HOURS = 168
FORECAST_HOURS = 168
HISTORY_HOURS = 4 * 7 * 24
NOISE_STD = 0.8
NOISE_SHARE = 0.15
CAP_FACTOR = 1.3
TRAIN_RATIO = 0.8
BAND_Z = 1.96
SEASONS = (("daily", 1.0, 10), ("weekly", 7.0, 5), ("yearly", 365.25, 8))
FEATURE_LAGS = (1, 2, 3, 24, 168)
FEATURE_WINDOWS = (3, 6, 24)
SECOND_PASS_LAGS = (1, 2, 3, 7)
SECOND_PASS_WINDOWS = (3, 7, 14)
