"""Spelling variants against all pairs of words, the SQL equivalent, and odd tables."""

import random

import pytest
from cases import no_docs, odd_docs, table

from peagelens.llm import spelling
from peagelens.llm.queries import ORACLES
from tests.parity import compare, connect


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_groups(words, ratio=spelling.RATIO):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def made_words(seed, n, letters, sizes):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))): rng.choice((2, 3, 20, 400, 9000)) for _ in range(n)}
    for w in list(words)[: n // 2]:
        at, c = rng.randrange(len(w) + 1), rng.choice(letters)
        words.setdefault(rng.choice((w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :])), rng.choice((2, 40)))
    words.pop("", None)
    return words


@pytest.mark.parametrize(
    ("letters", "sizes", "levels"),
    [("ab", (7, 8, 9), 48), ("abcé", (1, 2, 3, 4, 12), 48), ("abc", (5, 6, 30, 31), 6), ("aÿ×", (7, 8, 20), 9)],
)
def test_all_pairs(spark, letters, sizes, levels):
    words = made_words(len(letters) + levels, 160, letters, sizes)
    if levels < 48:
        words |= {"a" * 400: 5, "a" * 401: 70, "a" * 402: 4, "b" + "a" * 400: 3, "a" * 200 + "b" + "a" * 200: 2, "a" * 400 + "b": 9}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = spelling.grouped(table, levels=levels).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows} == plain_groups(words)
    assert len(rows) == len(words)


def test_sql(spark, data_dir):
    rows = spelling.variants(table(spark, data_dir, "documents"))
    assert compare(rows, connect(data_dir), ORACLES["op12_spelling_variants"]) == ""


def test_odd_tables(spark):
    assert spelling.variants(no_docs(spark)).collect() == []
    rows = {r.word: r for r in spelling.variants(odd_docs(spark), drop_every=0).collect()}
    assert set(rows) == {"children"} and rows["children"].n == 20_000 + 3 + 2 * 3
    assert (rows["children"].n_near, rows["children"].form, rows["children"].root) == (0, None, "children")


def test_long_words_and_texts(spark):
    long = "x" * 50_000
    docs = spark.createDataFrame([(1, f"{long} {long}y {long} {long}y"), (2, "prefixes " * 300_000)], "doc_id long, text string")
    rows = {r.word: r for r in spelling.variants(docs, drop_every=0).collect()}
    assert set(rows) == {long, long + "y", "prefixes"}
    assert rows[long].n_near == rows[long + "y"].n_near == 1
    assert rows["prefixes"].n == 300_000


def test_characters_left_out(spark):
    from zlib import crc32

    run = "bookshelf"
    ids = [i for i in range(200)]
    docs = spark.createDataFrame([(i, f"{run} {run.upper()}") for i in ids], "doc_id long, text string")
    want = {}
    for i in ids:
        h = crc32(f"{i}:{run}".encode())
        word = run[: h % 9] + run[h % 9 + 1 :] if h % 31 == 0 else run
        want[word] = want.get(word, 0) + 2
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == want
