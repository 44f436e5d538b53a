"""Near duplicates by 64-bit SimHash and BK-trees.

Two fingerprints within ``RADIUS`` bits agree on at least one of ``RADIUS + 1``
blocks of their bits, so fingerprints are dealt into shards by (block, its bits) and
no link is lost. Within a shard, parts of bounded size become BK-trees: children
hang under their parent by integer Hamming distance, and a search follows only edges
whose distance lies within the radius of the query's distance. A tree is sent to the
tasks that hold queries of its shard: by broadcast while the trees' true size is below
Spark's limit, else by a shuffle on the shard. Each (tree, queries) unit gives a
spanning forest of its links, at most one link for each fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peagelens.llm import bands
from peagelens.llm.components import components
from peagelens.llm.wordscan import measure_texts
from peagelens.session import fresh_path, scratch, settle

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints in one tree, and in one batch of queries, at most about so many.
PART = 1024


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of words, or of all words if they are fewer: words between white space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, ">u8")
    flat = b" ".join(words)
    digest, n = xxhash.xxh64_digest, max(1, len(words) - shingle + 1)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(flat)]
    return np.frombuffer(b"".join([digest(flat[a:b], SEED) for a, b in zip(starts, ends)]), ">u8")


def _fold(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        raw = np.ascontiguousarray(hashes[k : k + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        counts += np.add.reduce(np.unpackbits(raw, axis=1), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the whole text."""
    return _fold(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row of docs; fp holds the 64 bits as a signed long."""

    def measure(texts: list[bytes]) -> list[np.ndarray]:
        return [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return measure_texts(docs, {"doc_id": id_col}, text_col, "fp long", measure)


class BKTree:
    """Numbers in a tree whose edges carry integer Hamming distances."""

    def __init__(self, members: list[int]):
        self.children: list[dict[int, int]] = []
        self.members: list[int] = []
        for x in members:
            self.add(x)

    def add(self, x: int) -> None:
        at, new = 0, len(self.members)
        while self.members:
            d = (self.members[at] ^ x).bit_count()
            below = self.children[at].setdefault(d, new)
            if below == new:
                break
            at = below
        self.members.append(x)
        self.children.append({})

    def within(self, x: int, radius: int) -> Iterator[int]:
        """Members at most ``radius`` bits away."""
        todo, members, children = [0] if self.members else [], self.members, self.children
        while todo:
            at = todo.pop()
            d = (members[at] ^ x).bit_count()
            if d <= radius:
                yield members[at]
            below = children[at]
            if below:
                todo += [c for e, c in below.items() if d - radius <= e <= d + radius]


def forest(tree: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join everything which the links between tree and queries join."""
    index, up, out = BKTree(tree), {}, []

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for q in queries:
        for m in index.within(q, radius):
            a, b = top(q), top(m)
            if a != b:
                up[a] = b
                out.append((q, m))
    return out


def _blocks(parts: int) -> list[tuple[int, int]]:
    """(shift, mask) of each block of the 64 bits."""
    edges = [64 * k // parts for k in range(parts + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def links(prints: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all within the radius.

    A shard of more than ``part`` fingerprints is split by hash into trees of about
    that size, each met by all query parts of the shard, so no single task holds a hot
    shard and nothing in it is left out.
    """
    shards = F.array(*(
        F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask)) * F.lit(64) + F.lit(k)
        for k, (shift, mask) in enumerate(_blocks(radius + 1))
    ))
    dealt = prints.select("fp", F.explode(shards).alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    cut = dealt.join(sizes, "shard").select(
        "shard", "fp", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / part)).cast("int").alias("part")
    )
    trees = settle(cut.groupBy("shard", "part").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "bk-shards")
    left = trees.select("shard", F.col("part").alias("tree_part"), F.col("fps").alias("tree"))
    right = trees.select("shard", F.col("part").alias("query_part"), F.col("fps").alias("queries"))
    units = left.join(right, "shard").where(F.col("tree_part") <= F.col("query_part")).select("tree", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = (1 << 64) - 1
        for batch in batches:
            found: list[tuple[int, int]] = []
            for tree, queries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found += forest([x & full for x in tree], [x & full for x in queries], radius)
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    return units.mapInArrow(run, "a long, b long")


def similar_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    similarity: str = "0.8",
) -> DataFrame:
    """(doc_id, text_key, fp, root) for each row of docs; rows of one root are joined by similar sets of shingles.

    Chains of fingerprints within the radius and equal band keys (see ``bands``) propose pairs; each is checked on
    the whole sets. The result is settled; everything settled on the way to it is removed.
    """
    share, spark = Fraction(similarity), docs.sparkSession

    def shingle_set(text: bytes) -> np.ndarray:
        return np.unique(shingle_hashes(text, shingle).astype(np.uint64).view(np.int64))

    def measure(texts: list[bytes]) -> list:
        prints, sigs, sizes, keys = [], [], [], []
        for t in texts:
            hashes = shingle_hashes(t, shingle)
            one = np.unique(hashes.astype(np.uint64).view(np.int64))
            prints.append(_fold(hashes))
            sigs.append(bands.identity(one))
            sizes.append(len(one))
            keys.append(bands.band_keys(one))
        return [np.array(prints, np.uint64).view(np.int64), sigs, sizes, pa.array(keys, pa.list_(pa.int64()))]

    path = fresh_path(spark, "similar-rows")
    with scratch(spark):
        keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
        keep = {"doc_id": "doc_id", "text_key": "text_key"}
        rows = settle(measure_texts(keyed, keep, "text", "fp long, sig long, n long, keys array<long>", measure), "simhash")
        sets = settle(rows.groupBy("sig").agg(F.min("fp").alias("fp")), "simhash-sets")
        least = settle(sets.groupBy("fp").agg(F.min("sig").alias("b")), "simhash-distinct")
        same = sets.join(least, "fp").select(F.col("sig").alias("a"), "b")
        near = links(least.select("fp"), radius)
        near = near.join(least.select(F.col("fp").alias("a"), F.col("b").alias("x")), "a").join(
            least.select(F.col("fp").alias("b"), F.col("b").alias("y")), "b"
        )
        near = settle(same.union(near.select("x", "y")).where(F.col("a") != F.col("b")), "simhash-links")
        near = components(near).select(F.col("root").alias("key"), F.col("node").alias("sig"))
        roots = bands.similar(rows, docs, id_col, text_col, shingle_set, share, near)
        of_set = sets.join(roots, sets["sig"] == roots["node"], "left").select("sig", F.coalesce("root", "sig").alias("root"))
        found = rows.select("doc_id", "text_key", "fp", "sig").join(of_set, "sig").drop("sig")
        found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    similarity: str | None = None,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Links join fingerprints at most ``radius`` bits apart. With a ``similarity`` (a decimal
    or fraction as text) links are pairs of rows whose sets of shingles have at least that
    Jaccard similarity, found by fingerprints within the radius and by band keys (``bands``).

    component_id is the smallest id among the rows that a chain of links reaches. Texts
    without words, null ones too, have fingerprint zero and are linked like any other.
    A null id is never the smallest; a component of null ids only has none. Repeated
    rows and ids each give a row. Other columns of docs are not looked at.
    """
    if similarity is not None:
        found = similar_rows(docs, id_col, text_col, shingle, radius, similarity)
        by_root = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        out = found.join(settle(by_root, "simhash-components"), "root")
        return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    rows = settle(fingerprints(docs, id_col, text_col, shingle), "simhash")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = settle(least, "simhash-distinct")
    roots = components(links(least.select("fp"), radius))
    linked = roots.join(least, roots["node"] == least["fp"]).select("fp", "root", "least")
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = linked.select("fp", "root").join(by_root, "root").select(F.col("fp").alias("f"), "component_id")
    of_fp = least.join(joined, least["fp"] == joined["f"], "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")
    )
    out = rows.join(settle(of_fp, "simhash-components"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
