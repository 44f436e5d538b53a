"""Importance resampling of documents toward the word and word-pair distribution of a target.

Features are hashed into buckets. Counts of the buckets in the corpus and in the target give each
bucket a gain, the gains are an array of fixed length, and a document's weight is the mean gain of
its features. Seeded Gumbel noise on the weights draws without replacement. Where the draw ends is
found by bracketing: a quantile sketch proposes two scores, exact counts outside them say whether the
cut lies between, a bracket that misses it is widened, and only the rows inside are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peagelens.llm.wordscan import ALNUM, PIECE, measure_texts, pieces
from peagelens.session import settle

BUCKETS = 10_000
#: Features are runs of 1 to so many words.
ORDER = 2
SHARE = 25, 100
MIN_WORDS = 20
SEED = 7
#: Half width of the first bracket, as a share of the rows, and how much wider the next one is.
BRACKET, WIDEN = 0.005, 4

#: A-Z lower-cased, bytes outside words turned into spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if ALNUM[b] else 32 for b in range(256))


def feature_hashes(text: bytes, order: int = ORDER, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(words, crc32 of the features that end in them) for each piece of a text.

    A text is worked off in pieces cut between words; the last hashes are carried over, so
    features across a cut are found too.
    """
    flat = text.translate(_WORD_BYTES)
    at, last = 0, [None] * (order - 1)
    while at < len(flat):
        end = flat.find(b" ", at + piece)
        end = len(flat) if end < 0 else end
        words = flat[at:end].split()
        at = end
        if not words:
            continue
        hashes = list(map(crc32, words))
        found = [hashes]
        spaced = [b" " + w for w in words]
        for k in range(order - 1):
            before = [last[k], *hashes[:-1]]
            last[k] = hashes[-1]
            # A run of k + 1 words that ends before this one may not exist at the start of the text.
            skip = next((i for i, h in enumerate(before) if h is not None), len(before))
            hashes = [None] * skip + list(map(crc32, spaced[skip:], before[skip:]))
            found.append(hashes[skip:])
        yield len(words), np.concatenate([np.array(f, np.int64) for f in found])


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(bucket, n): features of all texts in each bucket; each task counts into one array first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                for text in part.column(0).to_pylist():
                    for _, hashes in feature_hashes(text or b"", order):
                        total += np.bincount(hashes % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, one for each bucket, from two tables of counts."""
    none = F.lit(0)
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    held = settle(both.select("bucket", F.coalesce("s", none).alias("s"), F.coalesce("t", none).alias("t")), "buckets")
    all_s, all_t = held.agg(F.coalesce(F.sum("s"), none), F.coalesce(F.sum("t"), none)).first()
    rows = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(held, "bucket", "left")
    s, t = (F.coalesce(c, none).cast("double") for c in ("s", "t"))
    ratio = ((t + 1.0) * (float(all_s) + buckets)) / ((s + 1.0) * (float(all_t) + buckets))
    rows = rows.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))
    out = np.zeros(buckets, np.int64)
    for bucket, gain in rows.collect():  # one row for each bucket, whatever the corpus
        out[bucket] = gain
    return out


def weights(docs: DataFrame, keep: dict[str, str], gain: np.ndarray, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The columns ``keep`` (new name: old name), n_words, n_features and weight of each row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def measure(texts: list[bytes]) -> list[np.ndarray]:
        out = np.zeros((3, len(texts)), np.int64)
        array = held.value
        for k, text in enumerate(texts):
            total = 0
            for n, hashes in feature_hashes(text, order):
                out[0, k] += n
                out[1, k] += len(hashes)
                total += int(array[hashes % len(array)].sum())
            if out[1, k]:
                out[2, k] = total // int(out[1, k])
        return list(out)

    return measure_texts(docs, keep, text_col, "n_words long, n_features long, weight long", measure)


def noise(id_column: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number that depends only on the seed and the id; a null id counts as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


@dataclass(frozen=True)
class Cut:
    """The last row drawn: its score, id and row number; ``rows`` are drawn in all."""

    score: int
    id: object
    row: int
    rows: int


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place, from 1, in an order without ties.

    Rows are dealt by ranges, sorted within each and written with their place there; the
    number of rows in the ranges before is added. Only one count for each range meets in a task.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = settle(dealt.withColumns({"__part": F.spark_partition_id(), "__at": place}), "ranked")
    sizes = held.groupBy("__part").count().collect()  # one row for each range
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in sizes):
        offsets.append((part, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets, "__part int, __before long")
    joined = held.join(table, "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]


def cutoff(scored: DataFrame, share: tuple[int, int] = SHARE, width: float = BRACKET) -> Cut | None:
    """Where the best ``share`` of the rows (score, id, row) end; None if that is no row.

    The sketch's error is a quarter of the bracket's width; exact counts decide whether the bracket
    holds the cut, and it is widened until it does.
    """
    n = scored.count()
    wanted = n * share[0] // share[1]
    if not wanted:
        return None
    goal = 1.0 - wanted / n
    while True:
        ends = [max(goal - width, 0.0), min(goal + width, 1.0)]
        sketch = F.percentile_approx("score", ends, int(4 / width) + 1)
        low, high = scored.agg(sketch).first()[0]
        score = F.col("score")
        above, inside = scored.agg(
            F.coalesce(F.sum((score > high).cast("long")), F.lit(0)),
            F.coalesce(F.sum(score.between(low, high).cast("long")), F.lit(0)),
        ).first()
        if above < wanted <= above + inside:
            break
        width *= WIDEN
    inner = ranked(scored.where(F.col("score").between(low, high)), _order())
    row = inner.where(F.col("rank") == wanted - above).select("score", "id", "row").first()
    return Cut(row.score, row.id, row.row, wanted)


def drawn(cut: Cut | None) -> Column:
    """Whether a row (score, id, row) comes no later than the cut."""
    if cut is None:
        return F.lit(False)
    known, same = F.col("id").isNotNull(), F.col("id").eqNullSafe(F.lit(cut.id))
    earlier = known if cut.id is None else known & (F.col("id") < F.lit(cut.id))
    tie = earlier | (same & (F.col("row") <= cut.row))
    return (F.col("score") > cut.score) | ((F.col("score") == cut.score) & F.coalesce(tie, F.lit(False)))


def _scored(
    docs: DataFrame, target: DataFrame, keep: dict[str, str], id_col: str, text_col: str, buckets: int, seed: int
) -> DataFrame:
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets), buckets)
    rows = weights(docs, {"id": id_col, **keep}, gain, text_col)
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return settle(rows.withColumn("row", F.monotonically_increasing_id()), "scored")


def draw(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: tuple[int, int] = SHARE,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs; rank is null for rows not drawn.

    Null and empty texts have no features and weight 0; they are never drawn, but scored. A null id
    is hashed as an empty one and comes last among equal scores. Rows that repeat an id are drawn
    each on its own; equal rows have neighbouring ranks. With an empty target each feature tells only how
    frequent it is in docs; with empty docs there are no rows. Other columns are not looked at.
    """
    scored = _scored(docs, target, {}, id_col, text_col, buckets, seed)
    fit = scored.where(F.col("n_words") >= min_words)
    cut = cutoff(fit.select("score", "id", "row"), share)
    taken = drawn(cut) & (F.col("n_words") >= min_words)
    places = ranked(scored.where(taken), _order())
    rest = scored.where(~taken).withColumn("rank", F.lit(None).cast("long"))
    both = places.select(*scored.columns, "rank").unionByName(rest)
    return both.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def sample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: tuple[int, int] = SHARE,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """The drawn rows of docs, whole, with ``_weight`` and ``_score``; see :func:`draw`.

    docs is written once to the shared folder on the way. Columns of docs of those two names are replaced.
    """
    held = [c for c in docs.columns if c not in ("_weight", "_score")]
    keep = {f"__{k}": c for k, c in enumerate(held)}
    scored = _scored(docs, target, keep, id_col, text_col, buckets, seed)
    fit = scored.where(F.col("n_words") >= min_words)
    cut = cutoff(fit.select("score", "id", "row"), share)
    named = [F.col(k).alias(c) for k, c in keep.items()]
    return fit.where(drawn(cut)).select(*named, F.col("weight").alias("_weight"), F.col("score").alias("_score"))
