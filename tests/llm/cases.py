"""Small tables with the oddities every operator must take."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score double, held_out string, size string, target string, fp string, rule string, taken string, "
    "hits string, items string, key string, component_id string, n_words string, kept string"
)
PROSE = "The river runs past the old mill and the small stone bridge where children play in summer. "


def row(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, len(text or ""), 0.5, *["extra"] * 12)


def odd_docs(spark):
    """Null id, null text and source, empty and blank texts, a very long one, ties and repeated rows,
    columns whose names clash with those the operators make."""
    rows = [
        row(1, ""),
        row(2, None, None, None),
        row(None, PROSE * 3),
        row(3, PROSE * 20_000, "b"),
        row(4, PROSE * 2, "b"),
        row(5, PROSE * 2, "c"),
        row(5, PROSE * 2, "c"),
        row(6, " \t\r\n\x0b\x0c ", "é"),
        row(7, "Ünï©ode wörds 🙂 and\x00nul", "\U0001f642"),
        row(8, "one two three", "c"),
        row(9, 'token = "abcdef123456"\nAll rights reserved.', "d"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc(doc_id, n):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % n
