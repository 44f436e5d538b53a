"""WARC round trips; mixing; the pipeline stage by stage."""

import gzip
import hashlib
import io
import re
from collections import defaultdict

import duckdb
import pytest
from cases import no_docs, odd_docs, row, table
from pyspark.sql import functions as F
from test_near_duplicates import exact_classes

import corpus_pipeline
from peagelens.llm import decontaminate, mixing, secret_scan, toxicity, warc
from peagelens.llm.queries import ORACLES

LONG = "x" * 150
PAGES = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (3, "http://a/3", LONG), (9, None, LONG), (1, "u\r\nx", "short"),
    (2, "u", "short"), (4, "http://ä", None), (6, "", ""), (7, "h", "é" * 49), (8, "h", "é" * 50), (10, "h", "é" * 50),
    (None, "n", LONG), (None, "n", "only nulls" * 20), (None, "n", "only nulls" * 20), (11, "b", "\r\n\r\nWARC/1.1\r\n\x00" * 20),
    (12, "big", "0123456789" * 300_000),
]


def plain(pages):
    groups = defaultdict(list)
    for page, _, html in pages:
        groups[(html or "").encode()].append(page)
    out = []
    for payload, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        ordered = known + [None] * (len(ids) - len(known))
        for k, page in enumerate(ordered):
            again = len(payload) >= 100 and k > 0
            out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ordered[0] if again else None))
    return sorted(out, key=repr)


def pages_frame(spark, rows=PAGES):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return frame.withColumn("digest", F.lit("clash")).withColumn("shard", F.lit("clash")).withColumn("kind", F.lit(0))


def test_round_trip(spark):
    got = warc.round_trip(pages_frame(spark))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(PAGES)
    assert warc.round_trip(pages_frame(spark).limit(0)).count() == 0


def test_files_are_deterministic_and_rolled(spark, data_dir, tmp_path):
    pages = table(spark, data_dir, "pages").select("page_id", "url", "html")
    small = {"roll": 20_000, "shard_bytes": 60_000}
    one = warc.write_warc(pages, str(tmp_path / "one"), **small)
    two = warc.write_warc(pages.repartition(7), str(tmp_path / "two"), **small)
    facts = lambda m: sorted(tuple(r)[:8] for r in m.collect())
    assert facts(one) == facts(two) and len(facts(one)) > 3
    rows = sorted(one.collect(), key=lambda r: (r.shard, r.file))
    assert all(a.last_page < b.first_page for a, b in zip(rows, rows[1:]))
    assert all(r.bytes >= 20_000 for r, s in zip(rows, rows[1:]) if r.shard == s.shard)
    for r in rows:
        raw = (tmp_path / "one" / r.name).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (r.bytes, r.sha256)
        assert gzip.GzipFile(fileobj=io.BytesIO(raw)).read().count(b"WARC/1.1\r\nWARC-Type: ") == r.records
    texts = {r.page_id: r.html for r in pages.collect()}
    for r in warc.read_warc(one).where("record_type = 'response'").collect():
        assert bytes(r.payload).decode() == texts[r.page_id]


def test_damage_is_noticed(spark, tmp_path):
    manifest = warc.write_warc(pages_frame(spark), str(tmp_path / "w"))
    name = manifest.first()["name"]
    member = gzip.compress(warc.record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None))
    (tmp_path / "w" / name).write_bytes(member)
    with pytest.raises(Exception, match="wrong digest"):
        warc.read_warc(manifest.where(F.col("name") == name)).count()
    (tmp_path / "w" / name).write_bytes(member[:-20])
    with pytest.raises(Exception, match="ends inside|damaged|incomplete"):
        warc.read_warc(manifest.where(F.col("name") == name)).count()


def test_shards_follow_bytes(spark):
    rows = [(i, "d", 10) for i in range(1000)] + [(10**12 + i, "d", 10) for i in range(1000)]
    bounds = warc.shard_bounds(spark.createDataFrame(rows, "page_id long, digest string, bytes long"), 1000)
    ids = [r[0] for r in rows]
    sizes = [sum(10 for i in ids if a <= i < b) for a, b in zip([0, *bounds], [*bounds, 10**13])]
    assert sum(sizes) == 20_000 and max(sizes) <= 1000 and len(sizes) >= 20
    few = warc.shard_bounds(spark.createDataFrame(rows, "page_id long, digest string, bytes long"), 1000, 5)
    assert 3 <= len(few) <= 9
    far = [(-(2**63), "d", 5), (2**63 - 1, "d", 5), (0, "d", 5)]
    a, b = warc.shard_bounds(spark.createDataFrame(far, "page_id long, digest string, bytes long"), 5)
    assert -(2**63) < a <= 0 < b <= 2**63 - 1


MIX = [
    [("a", 10)] * 50 + [("b", 7)] * 300 + [("c", 1)] * 3,
    [(None, 5)] * 20 + [("z", 1000)] + [("y", 1)] * 2,
    [("a", 0)] * 3 + [("b", 0)],
    [("only", 3)] * 4,
]


@pytest.mark.parametrize("rows", MIX)
def test_mix_meets_targets(spark, rows):
    docs = [(i, "w " * n, s) for i, (s, n) in enumerate(rows)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(frame).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        source = docs[r.doc_id][2]
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
        assert r.size == len(docs[r.doc_id][1].split()) and 0 <= r.taken <= 3 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        capped |= {s: 3 * sizes[s] for s in over}
    for s in order:
        assert target[s] == pytest.approx(capped.get(s, level * weight[s]))
        largest = max(n for t, n in rows if t == s)
        assert abs(taken[s] - target[s]) <= largest


def test_mix_of_odd_rows(spark):
    docs = odd_docs(spark)
    first, again = (sorted(map(repr, mixing.mix(docs.repartition(n)).collect())) for n in (1, 5))
    assert first == again and len(first) == docs.count()
    assert mixing.mix(no_docs(spark)).count() == 0


def test_hash_threshold_is_the_sorted_prefix(spark, data_dir):
    """The nested histograms choose what a full sort by hash would choose."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data_dir}/documents.parquet')")
    want = sorted(map(repr, con.sql(ORACLES["op10_mixing"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in mixing.mix(table(spark, data_dir, "documents")).collect()) == want


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_pipeline_stages(spark, data_dir, tmp_path):
    docs = table(spark, data_dir, "documents")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data_dir).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((name, docs, after))
        docs = after
    columns = corpus_pipeline.COLUMNS
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, d5) = seen
    assert all(x.columns == columns for x in (d1, d2, d3, d4))
    scores = by_id(toxicity.score(d0, toxicity.fit(d0, table(spark, data_dir, "labels"))))
    assert set(by_id(d1)) == {k for k, r in scores.items() if r.predicted == 0}
    groups, _, near = exact_classes({k: r.text for k, r in by_id(d1).items()})
    assert set(by_id(d2)) == set(groups.values()) and near
    hit = by_id(decontaminate.report(d2, table(spark, data_dir, "benchmark")))
    assert set(by_id(d3)) == {k for k, r in hit.items() if not r.contaminated}
    before, after = by_id(d3), by_id(d4)
    assert set(before) == set(after)
    for k, r in after.items():
        assert not secret_scan.base_spans(r.text) and (secret_scan.base_spans(before[k].text) or r == before[k])
        assert r.n_chars == len(r.text)
    final = by_id(d5)
    mixed = by_id(mixing.mix(d4))
    assert {k: r.taken for k, r in final.items()} == {k: r.taken for k, r in mixed.items() if r.taken}
    assert all(r.text == after[k].text for k, r in final.items())


def test_pipeline_takes_odd_rows(spark, tmp_path):
    rows = [row(1, "a b c d e f"), row(1, "a b c d e f"), row(None, None), row(2, None), row(3, "a b c d e f"), row(4, 'secret: "hunter2hunter2"')]
    docs = odd_docs(spark).unionByName(spark.createDataFrame(rows, odd_docs(spark).schema))
    for name, frame in {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], frame).write.parquet(str(tmp_path / f"{name}.parquet"))
    for source in (docs, docs.limit(0)):
        left = source
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{source is docs}-{k}")
            stage(spark, left, str(tmp_path)).write.parquet(path)
            left = spark.read.parquet(path)
        ids = [r.doc_id for r in left.collect()]
        assert len([i for i in ids if i is not None]) == len(set(ids) - {None})
        assert (len(ids) > 0) == (source is docs)
        assert not re.search("hunter2", str(left.collect()))
