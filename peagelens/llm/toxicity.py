"""Toxicity by weak supervision.

Voters look for lexicons and patterns: fixed lists of insults, groups of word forms
and word beginnings that labelled toxic texts use more than clean ones, and density
and repetition of all of these. A generative label model (expectation maximisation)
estimates how often each voter fires on toxic and on clean texts and how voters
correlate within a class; correlated voters are discounted. Its posterior labels, on
labelled and unlabelled texts, train a linear classifier of term densities, which
scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peagelens.llm import folds
from peagelens.llm.logistic import fit_sparse, sigmoid
from peagelens.llm.wordscan import Piece, byte_set, measure_texts, pieces

#: Labelled documents of each label, unlabelled ones, and terms, at most.
SAMPLE, UNLABELLED, TERMS = 2500, 3000, 800
#: Groups that the learned terms are dealt into, each a voter.
GROUPS = 24
#: Bytes of the word beginnings that count as terms, besides whole words.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: A term counts in full from one word in so many.
FULL = 50
FOLDS, HELD_OUT = 5, 0

# Common insults, a list for each language.
LEXICONS = {
    "en": "idiot moron stupid scum loser trash pathetic worthless disgusting clown dumb fool filthy vermin bastard",
    "de": "idiot dumm trottel abschaum versager dreck erbärmlich wertlos widerlich arschloch mistkerl",
    "fr": "idiot crétin stupide ordure minable pathétique salaud connard dégoûtant imbécile",
    "es": "idiota estúpido basura imbécil patético asqueroso escoria cabrón tonto inútil",
}

#: Letters: a-z and every byte of a longer character, after lower-casing A-Z.
_LETTER = byte_set(lambda b: b >= 0x80 or 97 <= b <= 122)


def _terms(p: Piece) -> Iterator[np.ndarray]:
    """Hashes of the words, then of their beginnings of each length; 0 where shorter."""
    hashed, long = p.hasher(), p.ends - p.starts
    yield hashed(p.starts, p.ends)
    for k in PREFIXES:
        # one more byte in the length keeps a beginning apart from the equal whole word
        h = hashed(p.starts, np.minimum(p.starts + k, p.ends)) ^ np.uint64(0x5BD1E995)
        yield np.where(long >= k, h, np.uint64(0))


def _scan(texts: list[bytes]) -> Piece:
    return Piece.of([t.lower() for t in texts], _LETTER)


def seed_terms() -> dict[str, np.ndarray]:
    out = {}
    for name, listed in LEXICONS.items():
        p = _scan([listed.encode()])
        out[name] = p.hasher()(p.starts, p.ends)
    return out


def _densities(p: Piece, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the sorted vocabulary, count) of the terms that occur."""
    n = len(vocabulary)
    cells = []
    for h in _terms(p):
        at = np.minimum(np.searchsorted(vocabulary, h), n - 1)
        some = np.flatnonzero(vocabulary[at] == h)
        cells.append(p.text[some] * n + at[some])
    cell, count = np.unique(np.concatenate(cells), return_counts=True)
    return cell // n, cell % n, count


def _value(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Density of a term, 1 from one word in FULL."""
    return np.minimum(count * FULL / np.maximum(words, 1), 1.0)


def learn_terms(texts: DataFrame, most: int = TERMS) -> np.ndarray:
    """Terms whose mean density is clearly larger in toxic texts (__label 1) than in others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                label = part.column(0).to_numpy()
                p = _scan([t or b"" for t in part.column(1).to_pylist()])
                sums = []
                for h in _terms(p):
                    order = np.lexsort((h, p.text))
                    t, h = p.text[order], h[order]
                    new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])])[: len(h)])
                    x = _value(np.diff(np.append(new, len(h))), p.n_words[t[new]])
                    sums.append((h[new], label[t[new]], x))
                h, y, x = (np.concatenate(c) for c in zip(*sums))
                terms, place = np.unique(h, return_inverse=True)
                add = lambda v: np.bincount(place, weights=v, minlength=len(terms))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms.view(np.int64)), *(pa.array(add(v)) for v in (y, x * y, x * x * y, x * (1 - y), x * x * (1 - y)))],
                    ["h", "d1", "s1", "q1", "s0", "q0"],
                )

    sizes = {r["__label"]: r["count"] for r in texts.groupBy("__label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    summed = (
        texts.select("__label", F.col("__text").cast("binary"))
        .mapInArrow(run, "h long, d1 double, s1 double, q1 double, s0 double, q0 double")
        .groupBy("h")
        .agg(*(F.sum(c).alias(c) for c in ("d1", "s1", "q1", "s0", "q0")))
    )
    mean1, mean0 = F.col("s1") / n1, F.col("s0") / n0
    spread = (F.col("q1") / n1 - mean1 * mean1) / n1 + (F.col("q0") / n0 - mean0 * mean0) / n0
    z = (mean1 - mean0) / F.sqrt(F.greatest(spread, F.lit(1e-12)))
    best = (
        summed.where((F.col("h") != 0) & (F.col("d1") >= 3))
        .select("h", z.alias("z"))
        .where((F.col("z") > 3) & (mean1 > 4 * mean0))
        .orderBy(F.desc("z"), "h")
        .limit(most)
    )
    return np.array([r.h for r in best.collect()], np.int64).view(np.uint64)


def votes(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, groups: list[np.ndarray]) -> np.ndarray:
    """Which voters fire on which of n texts: a voter for each group of terms at two
    densities, then patterns over all terms."""
    out = []
    total = np.bincount(rows, weights=values, minlength=n)
    kinds = np.bincount(rows, minlength=n)
    for g in groups:
        mass = np.bincount(rows, weights=values * np.isin(cols, g), minlength=n)
        out += [mass > 0, mass > 0.2]
    out += [total > 0.2, total > 0.5, total > 1.0, kinds >= 2, kinds >= 4]
    return np.column_stack(out)


def label_model(fired: np.ndarray, known: np.ndarray, weight: np.ndarray, steps: int = 40) -> np.ndarray:
    """Posterior chance that each text is toxic; known is 1, 0 or -1 where unlabelled.

    Each voter has a rate of firing on toxic and one on clean texts. A voter's say is
    divided by one plus the sum of its positive correlations, within a class, with the
    other voters. Labelled texts keep their label.
    """
    n, m = fired.shape
    given = known >= 0
    post = np.where(given, known, 0.05 + 0.9 * (fired.mean(1) > 0.3) if m else 0.05).astype(float)
    v = fired.astype(float)
    for _ in range(steps):
        rates, overlap = [], np.zeros((m, m))
        for share in (weight * post, weight * (1 - post)):
            total = share.sum()
            rate = (share @ v + 0.5) / (total + 1.0)
            gap = (v - rate) * np.sqrt(share / max(total, 1e-9))[:, None]
            cov = gap.T @ gap
            dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            overlap += np.clip(cov / dev / dev[:, None], 0, 1) / 2
            rates.append(np.clip(rate, 1e-4, 1 - 1e-4))
        say = 1.0 / np.maximum(overlap.sum(1), 1.0)
        toxic, clean = rates
        prior = np.clip((weight @ post) / weight.sum(), 0.001, 0.5)
        logit = np.log(prior / (1 - prior)) + v @ (say * np.log(toxic / clean)) + (1 - v) @ (
            say * np.log((1 - toxic) / (1 - clean))
        )
        new = np.where(given, known, sigmoid(logit))
        if np.abs(new - post).max() < 1e-4:
            break
        post = new
    return post


@dataclass(frozen=True)
class Model:
    terms: np.ndarray
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Train on labels outside the held-out fold; without any the fixed lexicons vote alone."""
    known = folds.labelled(labels, "toxic", FOLDS, HELD_OUT)
    sizes = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    sample = folds.bounded(known, limit)
    texts = folds.texts_of(docs, F.broadcast(sample))
    learned = learn_terms(texts)
    seeds = seed_terms()
    vocabulary = np.unique(np.concatenate([learned, *seeds.values()]))
    place = lambda h: np.searchsorted(vocabulary, np.unique(h))
    dealt = (learned >> np.uint64(7)) % np.uint64(GROUPS)
    groups = [place(h) for h in seeds.values()]
    groups += [place(learned[dealt == g]) for g in range(GROUPS) if (dealt == g).any()]

    ids = docs.select(F.col("doc_id").alias("__id")).where(F.col("__id").isNotNull() & (folds.remainder(F.col("__id"), FOLDS) != HELD_OUT))
    others = ids.orderBy(F.xxhash64("__id", F.lit("unlabelled")), "__id").limit(UNLABELLED).distinct()
    others = others.join(known.select("__id"), "__id", "left_anti").withColumn("__label", F.lit(-1))
    drawn = sample.unionByName(others)
    rows = _matrix(folds.texts_of(docs, F.broadcast(drawn)), vocabulary)
    label = np.array([r["__label"] for r in rows], int)
    if not len(rows):
        return Model(vocabulary, np.zeros(len(vocabulary)), -3.0)
    at = np.repeat(np.arange(len(rows)), [len(r.cell) for r in rows])
    cols = np.array([c for r in rows for c in r.cell], np.int64)
    values = np.array([x for r in rows for x in r.x], float)
    share = {k: sizes.get(k, 0) / max(1, int((label == k).sum())) for k in (0, 1)} | {-1: 1.0}
    weight = np.array([share[k] for k in label.tolist()])
    post = label_model(votes(at, cols, values, len(rows), groups), label, weight)
    w, b = fit_sparse(at, cols, values, post, weight, len(vocabulary), 2e-5)
    return Model(vocabulary, w, b)


def _matrix(texts: DataFrame, vocabulary: np.ndarray) -> list:
    """Rows (__label, cell, x) of the sampled texts, one for each id."""

    def measure(batch: list[bytes]) -> list:
        p = _scan(batch)
        text, at, count = _densities(p, vocabulary)
        x, cut = _value(count, p.n_words[text]), np.searchsorted(text, np.arange(1, len(batch)))
        return [pa.array(np.split(at, cut), pa.list_(pa.int64())), pa.array(np.split(x, cut), pa.list_(pa.float64()))]

    made = measure_texts(
        texts, {"__id": "__id", "__label": "__label"}, "__text", "cell array<long>, x array<double>", measure
    )
    one = made.groupBy("__id", "__label").agg(F.min(F.struct("cell", "x")).alias("s"))
    return one.orderBy(F.xxhash64("__id"), "__id").select("__label", "s.cell", "s.x").collect()


def score_column_rows(docs: DataFrame, model: Model, keep: dict[str, str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (new name: old name) and score, one row per row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def measure(texts: list[bytes]) -> list[np.ndarray]:
        m, p = held.value, _scan(texts)
        text, at, count = _densities(p, m.terms)
        logit = np.bincount(text, weights=m.weights[at] * _value(count, p.n_words[text]), minlength=len(texts))
        return [sigmoid(logit + m.bias)]

    return measure_texts(docs, keep, text_col, "score double", measure)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    A null or empty text scores as one without any term; a null id counts as not held
    out; repeated rows score alike; other columns of docs are not looked at.
    """
    rows = score_column_rows(docs, model, {"doc_id": id_col}, text_col)
    held: Column = F.coalesce(folds.remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
