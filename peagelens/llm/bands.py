"""Pairs of texts whose sets of word shingles have at least a given Jaccard similarity, by MinHash bands.

Each set has a fixed number of band keys, whatever its length: each key is a hash of the least values of
``ROWS`` hash functions. Two sets of similarity s share one of ``BANDS`` keys with probability
1 - (1 - s ** ROWS) ** BANDS, over 0.9999 at 0.8. Every two sets of equal keys are compared on the whole
sets: sets that keys bring together go to the same place, and a place, or two places that share a key, are
compared within one task. A place is of bounded size; a crowded bucket has several, and all of them meet.
Each comparison hands on links that span what it found, never all pairs. Sets are told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peagelens.llm.bitmap import likely
from peagelens.llm.components import components
from peagelens.llm.wordscan import measure_texts
from peagelens.session import settle

BANDS, ROWS = 20, 4
#: Shingles, and sets, of one place at most, about.
PLACE_SHINGLES, PLACE_SETS = 250_000, 2048
#: Steps by which the least set spreads over those that share keys, so that they come to one place.
STEPS = 3

_FACTORS = np.random.Generator(np.random.PCG64(8)).integers(1, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(
    2
) + np.uint64(1)
_BLOCK = 4096


def identity(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set of shingles."""
    return int(np.array(xxhash.xxh64_intdigest(shingles.tobytes(), 7), np.uint64).view(np.int64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of a set of 64-bit shingle hashes; an empty set has none."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    values = shingles.view(np.uint64)
    for at in range(0, len(values), _BLOCK):
        mixed = values[at : at + _BLOCK, None] * _FACTORS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def spanning(left: list, right: list, share: Fraction) -> list[tuple[int, int]]:
    """Links that join what all similar pairs of a set in ``left`` and one in ``right`` join.

    A set is (sig, sorted array of distinct shingles); whole intersections are counted.
    """
    sizes = np.array([len(s) for _, s in right], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *(s for _, s in right)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(right)), sizes)[order]
    up: dict[int, int] = {}
    out = []

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for sig, one in left:
        begin, end = np.searchsorted(flat, one, "left"), np.searchsorted(flat, one, "right")
        n = end - begin
        at = np.repeat(end - np.cumsum(n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(right))
        alike = both * (share.numerator + share.denominator) >= share.numerator * (len(one) + sizes)
        for k in np.flatnonzero(alike).tolist():
            a, b = top(sig), top(right[k][0])
            if a != b:
                up[a] = b
                out.append((sig, right[k][0]))
    return out


def _links(places: DataFrame, columns: list[str], share: Fraction) -> DataFrame:
    """(a, b) that span the similar pairs of one column of sets with itself, or of two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for column in batch.columns:
                    sets = {m["sig"]: m["shingles"] for m in column[k].as_py()}
                    sides.append([(sig, np.frombuffer(raw, np.int64)) for sig, raw in sets.items()])
                ends = np.array(spanning(sides[0], sides[-1], share), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    return places.select(*columns).mapInArrow(run, "a long, b long")


def similar(
    rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingles, share: Fraction, near: DataFrame,
    place_shingles: int = PLACE_SHINGLES, place_sets: int = PLACE_SETS, steps: int = STEPS,
) -> DataFrame:
    """(node, root) of the components of sets (sig) of at least the given similarity.

    rows holds (doc_id, text_key, sig, n, keys) of each row of docs; ``near`` holds (key, sig) of sets to be
    compared besides those of equal band keys. Every two sets of a key are compared, however many a key has.
    """
    entries = rows.select(F.explode("keys").alias("key"), "sig")
    ends = entries.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where(F.col("lo") < F.col("hi"))
    shared = settle(ends.select("key"), "band-keys")
    kept = likely(entries, F.col("key"), shared).join(shared, "key")
    kept = settle(kept.union(near.select("key", "sig")).distinct(), "band-entries")

    # A set's name is the least set that some steps over common keys reach: neighbours mostly share it.
    named = kept.withColumn("name", F.col("sig"))
    for _ in range(steps):
        least = named.groupBy("key").agg(F.min("name").alias("name"))
        names = settle(kept.join(least, "key").groupBy("sig").agg(F.min("name").alias("name")), "band-names")
        named = kept.join(names, "sig")
    if not steps:
        names = kept.select("sig", F.col("sig").alias("name")).distinct()
    first = F.min(F.struct("doc_id", "text_key")).alias("row")
    members = settle(rows.join(names, "sig").groupBy("sig", "name").agg(first, F.max("n").alias("n")), "band-members")
    parts = F.greatest(F.ceil(F.sum("n") / place_shingles), F.ceil(F.count("*") / place_sets), F.lit(1))
    sizes = members.groupBy("name").agg(parts.alias("parts"))
    place = F.xxhash64("name", F.pmod(F.xxhash64("sig"), F.col("parts")))
    placed = settle(members.join(sizes, "name").select("sig", place.alias("place"), "row.*"), "band-places")

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    texts = likely(texts, F.xxhash64("id", "key"), placed.select(F.xxhash64("doc_id", "text_key")))
    texts = texts.join(placed, texts["id"].eqNullSafe(placed["doc_id"]) & (texts["key"] == placed["text_key"]))

    def measure(raw: list[bytes]) -> list:
        return [pa.array([shingles(t).tobytes() for t in raw], pa.binary())]

    sets = measure_texts(texts, {"place": "place", "sig": "sig"}, "text", "shingles binary", measure)
    places = settle(sets.groupBy("place").agg(F.collect_set(F.struct("sig", "shingles")).alias("sets")), "band-sets")
    found = _links(places, ["sets"], share)

    of_key = kept.join(placed, "sig").select("key", "place").distinct()
    one, two = of_key.withColumnRenamed("place", "p"), of_key.withColumnRenamed("place", "q")
    across = settle(one.join(two, "key").where(F.col("p") < F.col("q")).select("p", "q").distinct(), "band-across")
    meet = likely(places, F.col("place"), across.select("p").union(across.select("q")))
    left, right = (meet.select(F.col("place").alias(x), F.col("sets").alias(f"{x}_sets")) for x in "pq")
    found = found.union(_links(across.join(left, "p").join(right, "q"), ["p_sets", "q_sets"], share))
    return components(settle(found, "band-links"))
