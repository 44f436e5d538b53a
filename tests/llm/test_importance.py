"""Importance resampling against a plain version, the SQL equivalent, odd tables, and the bracket."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from cases import no_docs, odd_docs, table
from pyspark.sql import functions as F

from peagelens.llm import importance
from peagelens.llm.queries import ORACLES
from tests.parity import compare, connect


def features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_draw(docs, target, buckets=importance.BUCKETS, share=importance.SHARE):
    """A list of (id, n_features, weight, score, rank), ids without nulls."""
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            counts.update(crc32(f.encode()) % buckets for f in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))

    rows = []
    for key, text in docs:
        words, found = features(text)
        weight = sum(gain(crc32(f.encode()) % buckets) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    fit = sorted((r for r in rows if r[5] >= importance.MIN_WORDS), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(fit[: len(fit) * share[0] // share[1]]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def as_tuples(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_plain_version(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["É", "x9", "tail"]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice((0, 1, 19, 20, 60))))) for k in range(700)]
    docs += [(5, docs[5][1])] * 40
    target = [" ".join(rng.choices(words[:60], k=50)) for _ in range(30)]
    got = importance.draw(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame([(t,) for t in target], "text string"),
    )
    assert as_tuples(got) == sorted(plain_draw(docs, target), key=repr)


def test_sql(spark, data_dir):
    rows = importance.draw(table(spark, data_dir, "documents"), table(spark, data_dir, "benchmark"))
    assert compare(rows, connect(data_dir), ORACLES["op13_importance_resampling"]) == ""


def test_pieces_of_a_text_give_the_same_features():
    text = "Uno dos, tres_quatro 55 " * 3000 + "É"
    for order in (1, 2, 3):
        whole = list(importance.feature_hashes(text.encode(), order))
        cut = list(importance.feature_hashes(text.encode(), order, 17))
        assert len(whole) == 1 and len(cut) > 1000
        assert sum(n for n, _ in cut) == whole[0][0]
        assert sorted(h for _, hs in cut for h in hs) == sorted(whole[0][1])
        assert sum(len(h) for _, h in cut) == order * whole[0][0] - (order - 1) * order // 2
    assert list(importance.feature_hashes(b"", 2)) == [] == list(importance.feature_hashes(b" ,. ", 2, 1))


@pytest.mark.parametrize("width", [1e-6, 0.005, 1.0])
def test_cut_whatever_the_bracket(spark, width):
    rng = random.Random(3)
    rows = [(rng.choice((5, 5, 5, 7, 900)) if k % 2 else rng.randrange(10_000), k % 90 or None, k) for k in range(3000)]
    scored = spark.createDataFrame(rows, "score long, id long, row long")
    for share in ((1, 100), (25, 100), (60, 100), (100, 100)):
        cut = importance.cutoff(scored, share, width)
        best = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))[: 3000 * share[0] // share[1]]
        assert (cut.score, cut.id, cut.row, cut.rows) == (*best[-1], len(best))
        assert {tuple(r) for r in scored.where(importance.drawn(cut)).collect()} == set(best)
    assert importance.cutoff(scored.limit(0)) is None and importance.cutoff(scored.limit(3)) is None


def test_odd_tables(spark):
    docs, target = odd_docs(spark), odd_docs(spark).select("text")
    rows = as_tuples(importance.draw(docs, target))
    assert len(rows) == docs.count()
    by_id = {r[0]: r for r in rows}
    assert by_id[1][1:3] == by_id[2][1:3] == by_id[6][1:3] == (0, 0) and by_id[1][4] is None
    fit = [r for r in rows if r[1] >= 39]
    assert sorted(r[4] for r in fit if r[4]) == list(range(1, len(fit) * 25 // 100 + 1))
    assert importance.draw(no_docs(spark), target).collect() == []
    none = importance.draw(docs, no_docs(spark)).collect()
    assert len(none) == docs.count()
    assert as_tuples(importance.draw(docs, target)) == rows


def test_sample_returns_whole_rows(spark):
    docs = odd_docs(spark).withColumn("_score", F.lit("replaced"))
    share = (60, 100)
    drawn = {r.doc_id for r in importance.draw(docs, docs, share=share).where("rank is not null").collect()}
    rows = importance.sample(docs, docs, share=share)
    assert rows.columns == [*(c for c in docs.columns if c != "_score"), "_weight", "_score"]
    whole = {(r.doc_id, r.text, r.hits) for r in docs.collect()}
    got = rows.collect()
    assert {r.doc_id for r in got} == drawn and drawn
    assert all((r.doc_id, r.text, r.hits) in whole for r in got)
