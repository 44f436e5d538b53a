"""Quality scores by Bradley-Terry ranking of preference pairs.

A document of label 1 is preferred to one of label 0. Weights of text statistics
are fitted by logistic loss on the difference of the two documents' features, over
all pairs of all labelled documents outside the held-out fold; the threshold is the
score below which the labelled share of label 0 lies, exact over the same documents.

The pairs are never made: a pass over the documents adds up the features by label
and narrow bin of score, and pairs of bins stand for pairs of documents. A bin of
``1 / BINS`` logits, stood for by its mean, changes the loss by some 1e-5 at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peagelens.llm import folds
from peagelens.llm.logistic import minimise, sigmoid
from peagelens.llm.textstats import ratios, text_counts
from peagelens.session import scratch, settle

#: Bins of score in a logit, and parts into which ranks narrow the scores in a pass.
BINS, PARTS = 64, 1024
PENALTY = 1e-3
FOLDS, HELD_OUT = 3, 1


def features() -> dict[str, Column]:
    """Text statistics on comparable scales."""
    out = dict(ratios())
    for long_tailed in ("word_length", "line_words", "symbol_share", "punct_share", "mark_share"):
        out[long_tailed] = F.log1p(out[long_tailed])
    return out | {"log_words": F.log1p("n_words")}


@dataclass(frozen=True)
class Ranker:
    centre: dict[str, float]
    scale: dict[str, float]
    weight: dict[str, float]
    threshold: float

    def margin(self, columns: dict[str, Column] | None = None) -> Column:
        """Score above the threshold, in logits; each feature counts up to 8 deviations."""
        parts = []
        for k, x in (columns or features()).items():
            z = F.least(F.greatest((x - self.centre[k]) / self.scale[k], F.lit(-8.0)), F.lit(8.0))
            parts.append(z * self.weight[k])
        return sum(parts[1:], parts[0]) - self.threshold


def _gap(scores: DataFrame, rank: int) -> float:
    """The middle between the values of rank ``rank`` (from 1) and the next of the column s; the last one at the end."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    before = 0
    while low < high:
        part = F.least(F.floor((F.col("s") - low) / ((high - low) / PARTS)), F.lit(PARTS - 1))
        counts = scores.where(F.col("s").between(low, high)).groupBy(part.alias("part"))
        for r in sorted(counts.agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect()):
            if before + r.n >= rank:
                low, high = r.lo, r.hi
                break
            before += r.n
    upto = F.sum((F.col("s") <= low).cast("long"))
    n, after = scores.agg(upto, F.min(F.when(F.col("s") > low, F.col("s")))).first()
    return low if n > rank or after is None else (low + after) / 2


def _binned(rows: DataFrame, names: list[str], centre: np.ndarray, scale: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """For label 0, then 1: (number, sums of scaled features) of the documents in each bin of score."""
    fields = [f"x{k}" for k in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            z = np.clip((x - centre) / scale, -8, 8)
            keys = np.column_stack([batch.column(0).to_numpy(), np.floor((z @ w) * BINS).astype(np.int64)])
            found, of = np.unique(keys, axis=0, return_inverse=True)
            of = of.ravel()
            sums = [np.bincount(of, minlength=len(found)), *(np.bincount(of, v, len(found)) for v in z.T)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, 0]), pa.array(found[:, 1]), *(pa.array(v.astype(float)) for v in sums)],
                ["label", "bin", "n", *fields],
            )

    schema = "label long, bin long, n double, " + ", ".join(f"{f} double" for f in fields)
    made = rows.select(F.col("__label").cast("long"), *names).mapInArrow(run, schema)
    sums = made.groupBy("label", "bin").agg(*(F.sum(f).alias(f) for f in ("n", *fields))).orderBy("label", "bin").collect()
    return [np.array([r[2:] for r in sums if r.label == k], float) for k in (0, 1)]


def _pair_loss(bins: list[np.ndarray], w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss, and its slope, over all pairs of a document of label 1 and one of label 0."""
    bad, good = bins
    mean_bad, mean_good = bad[:, 1:] / bad[:, :1], good[:, 1:] / good[:, :1]
    value, slope = 0.0, np.zeros(len(w))
    for k in range(0, len(good), 256):
        part = slice(k, k + 256)
        ahead = (mean_good[part] @ w)[:, None] - (mean_bad @ w)[None, :]
        weight = good[part, :1] * bad[:, 0]
        value += float((weight * np.logaddexp(0.0, -ahead)).sum())
        pull = weight * sigmoid(-ahead)
        slope -= pull.sum(axis=1) @ mean_good[part] - pull.sum(axis=0) @ mean_bad
    pairs = good[:, 0].sum() * bad[:, 0].sum()
    return value / pairs + 0.5 * PENALTY * float(w @ w), slope / pairs + PENALTY * w


def fit(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Learn from all labelled rows outside the held-out fold.

    With one label only, or none, every document scores 0.5.
    """
    known = folds.labelled(labels, "quality", FOLDS, HELD_OUT)
    learnt = docs.where(folds.remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    names = [*features()]
    zero = dict.fromkeys(names, 0.0)
    with scratch(docs.sparkSession):
        counts = text_counts(learnt, {"__id": "doc_id"}, "text")
        stats = counts.select("__id", F.struct(*(c.alias(k) for k, c in features().items())).alias("s")).join(known, "__id")
        rows = settle(stats.groupBy("__id", "__label").agg(F.min("s").alias("s")).select("__label", "s.*"), "ranker-rows")
        found = rows.agg(
            F.count("*"), F.coalesce(F.sum("__label"), F.lit(0)), *map(F.avg, names), *map(F.stddev_pop, names)
        ).first()
        n, n_good = found[:2]
        if not 0 < n_good < n:
            return Ranker(zero, dict.fromkeys(names, 1.0), zero, 0.0)
        centre, scale = np.array(found[2:], float).reshape(2, -1)
        scale = np.maximum(scale, 1e-6)
        w = minimise(lambda w: _pair_loss(_binned(rows, names, centre, scale, w), w), np.zeros(len(names)))
        named = lambda v: dict(zip(names, map(float, v)))
        raw = Ranker(named(centre), named(scale), named(w), 0.0)
        scores = settle(rows.select(raw.margin({k: F.col(k) for k in names}).alias("s")), "ranker-scores")
        return Ranker(raw.centre, raw.scale, raw.weight, _gap(scores, n - n_good))


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    A null text scores as an empty one; a null id is in no fold and counts as not held
    out; repeated rows score alike; other columns of docs are not looked at.
    """
    rows = text_counts(docs, {"doc_id": id_col}, text_col)
    p = 1 / (1 + F.exp(-ranker.margin()))
    held = F.coalesce(folds.remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), p.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
