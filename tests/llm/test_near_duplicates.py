"""SimHash, BK-trees and components against brute force."""

import random
import re

import numpy as np
import xxhash
from cases import no_docs, odd_docs, table

from peagelens.llm import components, simhash


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(links, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_fingerprints(spark, data_dir):
    docs = table(spark, data_dir, "documents").limit(60).select("text").union(odd_docs(spark).where("doc_id <> 3 or doc_id is null").select("text"))
    for r in docs.collect():
        assert simhash.fingerprint((r.text or "").encode()) == fingerprint(r.text)


def test_components_of_documents(spark, data_dir):
    docs = table(spark, data_dir, "documents")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {k: int(r.fingerprint, 16) for k, r in got.items()}
    assert len(got) == docs.count()
    ids = sorted(prints)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {k: r.component_id for k, r in got.items()} == classes(near, ids)


def test_chains_hot_shards_and_parts(spark):
    rng = random.Random(4)
    prints, x = [], rng.getrandbits(64)
    for _ in range(60):
        prints.append(x)
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
    prints += [rng.getrandbits(20) for _ in range(150)] + [0, 1, (1 << 64) - 1]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), part=7)
    rows = links.collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in rows)
    assert classes([tuple(r) for r in rows], signed) == classes(near, signed)


def test_tree_follows_only_near_edges():
    rng = random.Random(1)
    members = [rng.getrandbits(64) for _ in range(300)] + [5, 5]
    tree = simhash.BKTree(members)
    for q in [*members[:20], 7]:
        assert sorted(tree.within(q, 8)) == sorted(m for m in members if (m ^ q).bit_count() <= 8)
    assert list(simhash.BKTree([]).within(3, 64)) == []


def test_components_settle(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(80)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for e in links if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in classes(links, {x for e in links for x in e}).items() if k in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    zero = "0" * 16
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[6].fingerprint == zero
    assert by_id[1].component_id == by_id[2].component_id == by_id[6].component_id == 1
    assert by_id[4].component_id == by_id[5].component_id == 3 or by_id[5].component_id == 4
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(nulls).collect()] == [None, None]


def test_word_hashes_tell_words_apart():
    from peagelens.llm.wordscan import SOLID, Piece

    words = sorted({f"{a}{b}" for a in "abcdefgh" for b in range(400)})
    p = Piece.of([" ".join(words).encode(), b"", b"a0 a0"], SOLID)
    h = p.hasher()(p.starts, p.ends)
    assert len(np.unique(h[: len(words)])) == len(words)
    assert h[-1] == h[-2] == h[words.index("a0")]
    assert p.n_words.tolist() == [len(words), 0, 2]


def exact_classes(texts, size=5):
    """Components of the texts by brute-force Jaccard of at least 4/5."""
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[k] = {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(sets)
    near = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    return classes(near, ids), sets, near


def test_similar_sets_are_found_beyond_the_radius(spark, data_dir):
    rng = random.Random(9)
    texts = {r.doc_id: r.text for r in table(spark, data_dir, "documents").collect()}
    words = [f"w{i}" for i in range(3000)]
    for g in range(25):
        base, at = rng.choices(words, k=rng.randrange(8, 150)), 10**6 + 100 * g
        for k in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            tail = ["one", "very", "common", "line", "that", "all", "of", "them", "hold"] if k % 2 else []
            texts[at + k] = " ".join(copy + tail)
    want, sets, near = exact_classes(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = simhash.near_duplicates(docs, shingle=5, similarity="0.8").collect()
    assert {r.doc_id: r.component_id for r in got} == want
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    assert all(prints[k] == simhash.fingerprint(t.encode(), 5) for k, t in texts.items())
    far = [(a, b) for a, b in near if (prints[a] ^ prints[b]).bit_count() > 4]
    assert len(far) > 100


def test_similar_sets_of_odd_rows(spark):
    got = simhash.near_duplicates(odd_docs(spark), shingle=5, similarity="0.8").collect()
    assert len(got) == odd_docs(spark).count()
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[1] == by_id[2] == by_id[6] == 1 and by_id[7] == 7 and by_id[8] == 8
    assert simhash.near_duplicates(no_docs(spark), shingle=5, similarity="0.8").count() == 0


def test_pipeline_drops_similar_documents(spark, data_dir):
    """The stage keeps the smallest id of each group that brute-force Jaccard at five words gives."""
    import corpus_pipeline

    docs = table(spark, data_dir, "documents")
    want, _, _ = exact_classes({r.doc_id: r.text for r in docs.collect()})
    left = corpus_pipeline.drop_near_duplicates(spark, docs, data_dir)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_pipeline_dedups_by_row(spark):
    import corpus_pipeline

    texts = [
        (1, "a b c d e f g"), (2, "a b c d e f g"), (2, "only here and in no other row"), (3, "first text of three it is"),
        (3, "second text of three is longer"), (None, "a b c d e f g"), (None, "x y z u v w"), (None, "x y z u v w"), (None, "x  y z u v w"),
        (None, "another text of a null id"), (None, None), (5, ""), (6, "same row twice it is"), (6, "same row twice it is"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, " ".join(r.text.split())) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    want = [
        (1, "a b c d e f g"), (2, "only here and in no other row"), (3, "first text of three it is"),
        (3, "second text of three is longer"), (None, "x y z u v w"), (None, "another text of a null id"), (5, ""), (6, "same row twice it is"),
    ]
    assert sorted(left, key=repr) == sorted(want, key=repr)


def crowded():
    """Groups of two similar texts in a crowd that shares half of its words: all of them meet in a few buckets."""
    rng = random.Random(3)
    words, passage, texts = [f"w{i}" for i in range(5000)], [f"p{i}" for i in range(60)], {}
    for g in range(150):
        own = rng.choices(words, k=24)
        texts[2 * g] = " ".join(passage + own)
        texts[2 * g + 1] = " ".join(passage + own[:-8] + rng.choices(words, k=8 + g % 3))
    return texts


def test_pairs_in_crowded_buckets_are_found(spark):
    texts = crowded()
    want, _, near = exact_classes(texts)
    assert len(near) > 140 and len(set(want.values())) > 140
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = simhash.near_duplicates(docs, shingle=5, similarity="0.8").collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_similar_texts_whose_repeated_lines_differ(spark):
    """Fingerprints weigh repeats, sets do not: one of two lines said often turns over about half of the bits."""
    rng = random.Random(8)
    own = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    one, two = [f"l{i}" for i in range(12)], [f"m{i}" for i in range(12)]
    texts = {1: " ".join(own + one * 200 + two), 2: " ".join(own[:-4] + ["x", "y", "z", "v"] + one + two * 200)}
    want, _, _ = exact_classes(texts)
    assert want == {1: 1, 2: 1}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = simhash.near_duplicates(docs, shingle=5, similarity="0.8").collect()
    assert (int(got[0].fingerprint, 16) ^ int(got[1].fingerprint, 16)).bit_count() > 26
    assert {r.doc_id: r.component_id for r in got} == want


def test_places_of_any_size_find_the_same(spark):
    from fractions import Fraction

    from pyspark.sql import functions as F

    from peagelens.llm import bands

    texts = {**crowded(), **{1000 + k: f"{k} a b c d e f g h i j k l m n o p q r s t" for k in range(30)}, 2000: "", 2001: None, 2002: "one"}

    def shingles(text):
        return np.unique(simhash.shingle_hashes(text, 5).astype(np.uint64).view(np.int64))

    sets = {k: shingles((t or "").encode()) for k, t in texts.items()}
    docs = spark.createDataFrame([*texts.items(), *texts.items()], "doc_id long, text string").repartition(3)
    keys = {k: (bands.identity(s), len(s), bands.band_keys(s).tolist()) for k, s in sets.items()}
    rows = spark.createDataFrame([(k, *v) for k, v in keys.items()] * 2, "doc_id long, sig long, n long, keys array<long>")
    rows = rows.join(docs.distinct(), "doc_id").withColumn("text_key", F.xxhash64("text")).drop("text")
    near = spark.createDataFrame([], "key long, sig long")
    by_key = {}
    for sig, _, of in keys.values():
        for key in of:
            by_key.setdefault(key, set()).add(sig)
    of_sig = {keys[k][0]: {int(x) for x in s} for k, s in sets.items()}
    links = {
        (a, b) for group in by_key.values() for a in group for b in group
        if a < b and 5 * len(of_sig[a] & of_sig[b]) >= 4 * len(of_sig[a] | of_sig[b])
    }
    want = {k: v for k, v in classes(sorted(links), set(of_sig)).items() if any(k in e for e in links)}
    for sizes in ((250_000, 2048, 3), (1500, 2048, 3), (250_000, 7, 1), (250_000, 2048, 0)):
        got = bands.similar(rows, docs, "doc_id", "text", shingles, Fraction(4, 5), near, *sizes)
        assert {r.node: r.root for r in got.collect()} == want
