"""Quality rules: a decision list learned by sequential covering.

Rules that reject are grown one threshold at a time on two thirds of a labelled
sample (by FOIL gain), pruned on the last third, and kept while they are precise
there. The list becomes one ordered conditional expression of Spark.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peagelens.llm import folds
from peagelens.llm.textstats import ratios, text_counts

#: Rows of each label that the list is fitted on at most.
SAMPLE = 2000
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, stats: dict[str, Column]) -> Column:
        x = stats[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


Rule = tuple[Condition, ...]


def _fires(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(lambda a, c: a & c.holds(table), rule, np.ones(n, bool))


def _best(table: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The threshold with the largest FOIL gain among the rows inside the rule so far."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    best, gain = None, 1e-9
    for name, x in table.items():
        order = np.argsort(x[inside], kind="stable")
        v, b = x[inside][order], bad[inside][order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        p, n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
        for above in (True, False):
            ps, ns = (p0 - p, n0 - n) if above else (p, n)
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - np.log2(p0 / (p0 + n0))), 0.0)
            if len(g) and g.max() > gain:
                k = cut[int(g.argmax())]
                gain, best = float(g.max()), Condition(name, above, float((v[k] + v[k + 1]) / 2))
    return best


def learn(
    table: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int = 4, precision: float = 0.9, least: int = 3
) -> list[Rule]:
    """Rules whose rows are to be rejected, in the order of their learning.

    Every third row prunes. A rule stays if at least ``least`` bad rows of the pruning
    part, or of all rows when that part has fewer bad ones, fall under it with the
    precision asked for. A table of one class gives no rule.
    """
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    while (bad & left).any() and (~bad).any():
        rule: Rule = ()
        while len(rule) < max_conditions:
            inside = _fires(rule, table, n) & left & ~prune
            if not (bad & inside).any() or (rule and not (~bad & inside).any()):
                break
            step = _best(table, bad, inside)
            if step is None:
                break
            rule += (step,)
        if not rule:
            break

        def worth(r: Rule) -> float:
            hit = _fires(r, table, n) & left & prune
            p, m = (bad & hit).sum(), (~bad & hit).sum()
            return (p - m) / (p + m) if p + m else -1.0

        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: (worth(r), -len(r)))
        hit = _fires(rule, table, n) & left
        right, wrong = int((bad & hit).sum()), int((~bad & hit).sum())
        if right < least or right < precision * (right + wrong) or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> list[Rule]:
    """Learn from at most ``limit`` rows of each label outside the held-out fold."""
    sample = folds.bounded(folds.labelled(labels, "quality", FOLDS, HELD_OUT), limit)
    counts = text_counts(
        folds.texts_of(docs, F.broadcast(sample)), {"__id": "__id", "__label": "__label"}, "__text"
    )
    stats = counts.select("__id", "__label", F.struct(*(c.alias(k) for k, c in ratios().items())).alias("s"))
    rows = stats.groupBy("__id", "__label").agg(F.min("s").alias("s")).orderBy(F.xxhash64("__id"), "__id").collect()
    table = {f: np.array([r.s[f] for r in rows], float) for f in ratios()}
    return learn(table, np.array([r["__label"] == 0 for r in rows], bool))


def expression(rules: list[Rule]) -> Column:
    """Number of the first rule that fires, from 1; null if none does."""
    stats, out = ratios(), None
    for k, rule in enumerate(rules, 1):
        fires = reduce(lambda a, b: a & b, (c.column(stats) for c in rule))
        out = F.when(fires, F.lit(k)) if out is None else out.when(fires, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base statistics and verdict for each row of docs.

    A null text counts as an empty one, which fails the base; a null id stays null;
    repeated rows are judged one by one; other columns of docs are not looked at.
    """
    counts = text_counts(docs, {"doc_id": id_col}, text_col)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = counts.withColumn("base_failed", failed).withColumn("rule", expression(rules))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule",
    )
