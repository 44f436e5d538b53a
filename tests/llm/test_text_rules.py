"""Quality rules and classifier, toxicity: statistics by brute force, accuracy on held-out rows."""

import re
from collections import Counter

import numpy as np
import pytest
from cases import PROSE, crc, labels, no_docs, odd_docs, table
from pyspark.sql import functions as F

from peagelens.llm import decision_list, pairwise, toxicity
from peagelens.llm.logistic import fit_differences, fit_sparse

BIG = "/root/testdata/sf0.1"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, dups, len(inside)


def test_base_statistics(spark, data_dir):
    docs = table(spark, data_dir, "documents").select("doc_id", "text").union(odd_docs(spark).select("doc_id", "text"))
    texts = Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    got = decision_list.judge(docs, [])
    assert Counter(tuple(r)[:6] for r in got.collect()) == texts
    for r in got.collect():
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed)


def test_rules_cover_and_prune():
    rng = np.random.default_rng(1)
    a, b = rng.random(600), rng.random(600)
    bad = (a > 0.8) | ((b < 0.1) & (a > 0.3))
    rules = decision_list.learn({"a": a, "b": b}, bad)
    hit = np.zeros(600, bool)
    for rule in rules:
        hit |= decision_list._fires(rule, {"a": a, "b": b}, 600)
    assert (hit == bad).mean() > 0.97 and 1 <= len(rules) <= 6
    assert "a >" in str(rules[0][0])


def test_rules_need_both_classes():
    x = {"a": np.arange(5.0)}
    assert decision_list.learn(x, np.zeros(5, bool)) == []
    assert decision_list.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_list_is_ordered_and_conditional(spark):
    rules = [
        (decision_list.Condition("pipe_share", True, 0.4),),
        (decision_list.Condition("upper_share", True, 0.5), decision_list.Condition("mark_share", True, 0.5)),
    ]
    rows = [(1, "| a " * 20), (2, "A!! " * 5 + "B!! C!! D!! E!! F!! G!! H!!"), (3, PROSE)]
    got = {r.doc_id: r.rule for r in decision_list.judge(spark.createDataFrame(rows, "doc_id long, text string"), rules).collect()}
    assert got == {1: 1, 2: 2, 3: None}


@pytest.fixture(scope="module")
def big(spark):
    return table(spark, BIG, "documents"), table(spark, BIG, "labels")


def confusion(scored, labelled, label, predicted):
    rows = scored.join(labelled, "doc_id").groupBy(label, predicted).count().collect()
    return {(r[0], int(r[1])): r["count"] for r in rows}


def test_rules_on_held_out_rows(spark, big):
    docs, known = big
    judged = decision_list.judge(docs, decision_list.fit(docs, known))
    held = judged.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    got = confusion(held.where("not base_failed"), known, "quality", "kept")
    assert got.get((1, 0), 0) <= 0.01 * got[1, 1]
    assert got.get((0, 1), 0) <= 0.05 * (got.get((0, 0), 0) + 1)


def test_ranker_on_held_out_rows(spark, big):
    docs, known = big
    scored = pairwise.score(docs, pairwise.fit(docs, known))
    got = confusion(scored.where("held_out"), known, "quality", "predicted")
    assert got.get((1, 0), 0) <= 0.01 * got[1, 1]
    assert got.get((0, 1), 0) <= 0.05 * got[0, 0]


def test_toxicity_on_held_out_rows(spark, big):
    docs, known = big
    scored = toxicity.score(docs, toxicity.fit(docs, known))
    got = confusion(scored.where("held_out"), known, "toxic", "predicted")
    assert got.get((0, 1), 0) <= 0.005 * got[0, 0]
    assert got.get((1, 0), 0) <= 0.12 * got[1, 1]


def test_folds(spark):
    docs = odd_docs(spark)
    for scored, n, held in (
        (pairwise.score(docs, pairwise.fit(docs, labels(spark))), 3, 1),
        (toxicity.score(docs, toxicity.fit(docs, labels(spark))), 5, 0),
    ):
        rows = scored.collect()
        assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
        for r in rows:
            assert r.held_out == (r.doc_id is not None and crc(r.doc_id, n) == held)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_odd_labels_and_empty_tables(spark):
    docs, known = odd_docs(spark), labels(spark, [(4, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (8, None, None), (99, 1, 1)])
    for module in (decision_list, pairwise, toxicity):
        use = module.judge if module is decision_list else module.score
        assert use(docs, module.fit(docs, known)).count() == docs.count()
        nothing = no_docs(spark)
        assert use(nothing, module.fit(nothing, known)).count() == 0


def test_held_out_labels_do_not_matter(spark, big):
    docs, known = big
    flipped = known.withColumn(
        "toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    a, b = toxicity.fit(docs, known), toxicity.fit(docs, flipped)
    assert np.array_equal(a.terms, b.terms) and np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(3)
    truth = rng.random(2000) < 0.2
    flip = lambda hit, false: np.where(truth, rng.random(2000) < hit, rng.random(2000) < false)
    copy = flip(0.7, 0.3)
    fired = np.column_stack([flip(0.9, 0.02), flip(0.85, 0.05), flip(0.8, 0.05), copy, copy, copy])
    known = np.where(np.arange(2000) < 100, truth, -1).astype(int)
    post = toxicity.label_model(fired, known, np.ones(2000))
    assert ((post > 0.5) == truth).mean() > 0.96


def test_logistic_fits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.5 > 0).astype(float)
    rows, cols = np.divmod(np.arange(1500), 3)
    w, b = fit_sparse(rows, cols, x.ravel(), y, np.ones(500), 3, 1e-3)
    assert (((x @ w + b) > 0) == (y > 0.5)).mean() > 0.98
    d = fit_differences(x[y == 1][:100], x[y == 0][:100], 1e-3)
    assert d[0] > 0 > d[1]
    assert fit_sparse(rows[:0], cols[:0], x.ravel()[:0], y[:0], np.ones(0), 3, 1e-3)[1] == 0.0


def mirrored(n):
    """Two texts of n letters that sums modulo 2 ** 64 cannot tell apart: the Thue-Morse word and its mirror."""
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[o] for o in ones), "".join("ba"[o] for o in ones)


def test_long_regular_words_and_lines_are_told_apart(spark):
    one, other = mirrored(2048)
    texts = [f"{one}\n{other}", f"{one}\n{one}", " ".join([one, "x y z w", other, "x y z w"]), f"{one} {other} " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in decision_list.judge(docs, []).collect()}
    assert got == {k: base(t) for k, t in enumerate(texts)}
    assert got[0][3] == 0 and got[1][3] == 1


def test_ranker_learns_from_all_pairs(spark):
    """Weights and threshold equal those of the loss over every pair, made in full by numpy."""
    import numpy as np

    from peagelens.llm.logistic import fit_differences
    from peagelens.llm.textstats import text_counts

    def text(k):
        good = "The old mill stands by the river, and children play there in summer. " * (1 + k % 5)
        return good + "buy NOW!!! $$ | " * (k * 7 % 11) + "so so " * (k * 5 % 4)

    docs = spark.createDataFrame([(k, text(k)) for k in range(200)], "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([(k, int((k * 7 % 11) < 4 + k % 3), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    ranker = pairwise.fit(docs, known)
    counts = text_counts(docs, {"doc_id": "doc_id"}, "text")
    exprs = pairwise.features()
    rows = counts.join(known, "doc_id").select("doc_id", "quality", *(c.alias(k) for k, c in exprs.items())).collect()
    rows = [r for r in rows if crc(r.doc_id, 3) != 1]
    x, y = np.array([[r[k] for k in exprs] for r in rows], float), np.array([r.quality for r in rows])
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -8, 8)
    good, bad = z[y == 1], z[y == 0]
    w = fit_differences(np.repeat(good, len(bad), 0), np.tile(bad, (len(good), 1)), 1e-3)
    got = np.array([ranker.weight[k] for k in exprs])
    off = np.abs(got - w).max() / np.abs(w).max()
    assert off < 1e-3, off
    s = np.sort(z @ got)
    assert abs(ranker.threshold - (s[len(bad) - 1] + s[len(bad)]) / 2) < 1e-9


def test_ranks_of_scores(spark):
    values = sorted([0.0] * 40 + [1e-12, 1.0, 1.0, -3.0, 1e6] + [k / 7 for k in range(100)])
    scores = spark.createDataFrame([(v,) for v in values], "s double").repartition(3)
    for rank in (1, 2, 30, 41, 42, 100, len(values) - 1):
        assert pairwise._gap(scores, rank) == (values[rank - 1] + values[rank]) / 2
    assert pairwise._gap(scores, len(values)) == values[-1]
