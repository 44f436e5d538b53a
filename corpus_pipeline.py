"""A corpus pipeline of five stages over ``documents``; each calls one operator of peagelens.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peagelens.llm import bitmap, decontaminate, mixing, secret_scan, simhash, toxicity
from peagelens.session import fresh_path, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates share at least so much of their sets of runs of so many words.
SHINGLE, SIMILARITY = 5, "0.8"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on these documents' labels, does not reject.

    Null, empty and blank texts hold no term and stay, as does every row of a repeated or null id; without
    labels no model is learnt and all rows stay. Columns other than those of documents go.
    """
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    keep = {c: c for c in COLUMNS}
    return toxicity.score_column_rows(docs, model, keep).where(F.col("score") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the smallest id, then text hash, then columns; null ids are last.

    A group is what pairs of at least SIMILARITY join; SimHash and band keys propose them, whole sets decide. Rows
    are told by id and text hash, so other texts of a repeated or null id stay. Texts without words, null
    ones too, are one group. Of equal rows one stays. No rows give no rows; columns other than those of documents go.
    """
    groups = simhash.similar_rows(docs, shingle=SHINGLE, similarity=SIMILARITY)
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    best = groups.groupBy("root").agg(F.min(rank).alias("best"))
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    others = groups.join(settle(best, "near-duplicates-best"), "root").where(~same).select("doc_id", "text_key").distinct()
    repeated = groups.groupBy("doc_id", "text_key").count().where(F.col("count") > 1).select("doc_id", "text_key")
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("__key"))

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"))
        return rows.join(keys, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__t")), how)

    others = settle(others, "near-duplicates-others")
    repeated = settle(repeated, "near-duplicates-repeated")
    named = others.union(repeated).select(F.xxhash64("doc_id", "text_key"))
    rows = bitmap.marked(rows, F.xxhash64("doc_id", "__key"), named, "__named")
    alone, rows = rows.where(~F.col("__named")).select(*COLUMNS), rows.where("__named")
    left = among(rows, others, "left_anti")
    several = among(left, repeated, "left_semi").groupBy("doc_id", "__key")
    one = several.agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return alone.unionByName(among(left, repeated, "left_anti").select(*COLUMNS)).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination.

    Null and empty texts have no words and stay. Rows that repeat an id are judged each by its own text. An empty
    benchmark rejects nothing. Columns other than those of documents go.
    """
    return decontaminate.clean(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mask; n_chars follows the new text.

    Null and empty texts stay as they are, with their n_chars. Columns other than those of documents go.
    """
    masked = secret_scan.redact(docs.select(*COLUMNS))
    changed = F.when(F.col("text").contains(secret_scan.MASK), F.length("text").cast("long"))
    return masked.withColumn("n_chars", F.coalesce(changed, F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, and the words taken.

    Null, empty and blank texts have size 0 and are never taken; a null source is a source, the last one.
    Rows that repeat id and text share a hash and are taken together. No rows give no rows.
    """
    sizes = settle(mixing.measured(docs), "mix-sizes")
    rows = docs.select(
        *COLUMNS, mixing.words(F.col("text")).alias("size"),
        mixing.hash_key(F.col("doc_id"), F.col("text")).alias("__key"),
    )
    done = mixing.apply_plan(rows, mixing.plan(sizes), "source", "size", "__key").where(F.col("_taken") > 0)
    return done.select(
        *COLUMNS, "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", redact_secrets),
    ("mixing", mix_sources),
]

#: The stages learn a model and hash with XXH64; SQL cannot express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    folder = fresh_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
