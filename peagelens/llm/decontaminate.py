"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item becomes windows of 13 words; a window is the set of its 3-word
shingles. Shingles are ordered by rarity in the corpus. A window is contained in a
document only if its rarest shingle is, so that one shingle is the necessary prefix:
occurrences of prefix shingles in documents are the candidates. The shingle's
place in the window gives the only possible start; a candidate that would begin
before or end after the document is dropped (length and position bounds), and the
rest are verified word by word over the item-sized window.

The benchmark is the stated query set. Its windows are sent to the tasks in blocks of
bounded size, each block against all documents; the documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType

from peagelens.llm.wordscan import ALNUM, Piece, pieces
from peagelens.session import settle

WINDOW = 13
SHINGLE = 3
#: Windows sent to the tasks at once: at some 150 bytes each about 15 MB.
BLOCK = 100_000
#: A text is contaminated if its hit words are at least one in so many.
SHARE = 20


def _words(texts: list[bytes]) -> tuple[Piece, np.ndarray]:
    p = Piece.of([t.lower() for t in texts], ALNUM)
    return p, p.hasher()(p.starts, p.ends)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, words) for each distinct window: hashes of its words, as a list.

    An item of fewer words is one window; one without words, or of null text, has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                p, h = _words([t or b"" for t in part.column(1).to_pylist()])
                h = h.view(np.int64)
                ids, spans = [], []
                for item, a, b in zip(part.column(0).to_pylist(), p.first.tolist(), p.first[1:].tolist()):
                    for k in range(a, max(a + 1, b - size + 1)) if b > a else ():
                        ids.append(item)
                        spans.append(h[k : min(b, k + size)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field(0).type), pa.array(spans, pa.list_(pa.int64()))],
                    ["item_id", "words"],
                )

    items = benchmark.select("item_id", benchmark["text"].cast("binary").alias("__text"))
    schema = items.drop("__text").schema.add("words", ArrayType(LongType()))
    return items.mapInArrow(run, schema).distinct()


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` words of one list, as ``Piece.windows`` makes them."""
    alone = Piece(np.zeros(0, np.uint8), np.zeros(2), words, words, np.zeros(len(words), np.int64), np.zeros(2))
    return alone.windows(words, size)[1]


class Block:
    """Windows of one block, by the hash of their prefix shingle.

    Windows of fewer than SHINGLE words take the whole window as their only shingle.
    """

    def __init__(self, rows: list, rarity: dict[int, int]):
        self.items = [r["item_id"] for r in rows]
        lists = [np.array(r["words"], np.int64).view(np.uint64) for r in rows]
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.concatenate([*lists, np.zeros(0, np.uint64)])
        key, place = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.int64)
        for k, x in enumerate(lists):
            sh = _shingles(x, min(SHINGLE, len(x)))
            place[k] = min(range(len(sh)), key=lambda i: (rarity.get(int(sh[i]), 0), int(sh[i])))
            key[k] = sh[place[k]]
        self.order = np.argsort(key, kind="stable")
        self.keys, self.place = key[self.order], place[self.order]

    def matches(self, p: Piece, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence of a window."""
        found_at, found = [], []
        for size in np.unique(np.minimum(self.sizes, SHINGLE)).tolist():
            at, h = p.windows(hashes, size)
            low = np.searchsorted(self.keys, h)
            some = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == h)
            at, h, low = at[some], h[some], low[some]
            many = np.searchsorted(self.keys, h, "right") - low
            which = np.repeat(low, many) + _ramp(many)
            start = np.repeat(at, many) - self.place[which]
            text = np.repeat(p.text[at], many)
            window = self.order[which]
            n = self.sizes[window]
            fits = (
                (np.minimum(n, SHINGLE) == size) & (start >= p.first[text]) & (start + n <= p.first[text + 1])
            )
            start, window = start[fits], window[fits]
            same = np.ones(len(start), bool)
            for k in range(WINDOW):
                live = np.flatnonzero(same & (self.sizes[window] > k))
                same[live] = hashes[start[live] + k] == self.words[self.begin[window[live]] + k]
            found_at.append(start[same])
            found.append(window[same])
        return np.concatenate([*found_at, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.int64)])


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _rarity(docs: DataFrame, wanted: np.ndarray, sizes: list[int], text_col: str) -> dict[int, int]:
    """How often each of the wanted shingles, at most a block's, occurs in the corpus."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                p, h = _words([t or b"" for t in part.column(0).to_pylist()])
                for size in sizes:
                    sh = p.windows(h, size)[1]
                    at = np.minimum(np.searchsorted(wanted, sh), len(wanted) - 1)
                    which, n = np.unique(at[wanted[at] == sh], return_counts=True)
                    total[which] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[seen].view(np.int64)), pa.array(total[seen])], ["h", "n"])

    counted = docs.select(docs[text_col].cast("binary")).mapInArrow(run, "h long, n long")
    return {r.h % (1 << 64): r.n for r in counted.groupBy("h").agg(F.sum("n").alias("n")).collect()}


def _search(docs: DataFrame, block: Block | None, item_type: DataType, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_words, hits) for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(block)
    hits_type = ArrayType(
        StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("item", item_type)])
    )
    keys = docs.select(
        docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_key"),
        docs[text_col].cast("binary").alias("text"),
    )
    schema = keys.drop("text").schema.add("n_words", "long").add("hits", hits_type)
    arrow_type = to_arrow_type(hits_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        for batch in batches:
            for part in pieces(batch, 2):
                p, h = _words([t or b"" for t in part.column(2).to_pylist()])
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                start, window = b.matches(p, h) if b else (np.zeros(0, np.int64),) * 2
                last: dict = {}
                for s, w in sorted(zip(start.tolist(), window.tolist())):
                    text = int(p.text[s])
                    e, item = s + int(b.sizes[w]), b.items[w]
                    open_span = last.get((text, item))
                    base = int(p.first[text])
                    if open_span and open_span["end"] >= s - base:
                        open_span["end"] = max(open_span["end"], e - base)
                    else:
                        last[text, item] = {"start": s - base, "end": e - base, "item": item}
                        spans[text].append(last[text, item])
                columns = [part.column(0), part.column(1), pa.array(p.n_words), pa.array(spans, arrow_type)]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return keys.mapInArrow(run, schema)


def overlaps(
    docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items) for each row of docs.

    n_hit counts the words inside any occurrence of a window, items lists the items
    whose windows occur. A null text has no words; rows alike in id and text are judged
    alike; an empty or wordless benchmark hits nothing; a null item_id counts for
    n_hit and is not listed. Other columns are not looked at.
    """
    known = settle(windows(benchmark), "benchmark-windows")
    kind = known.schema["item_id"].dataType
    n_blocks = max(1, -(-known.count() // block))
    counts, spans = None, None
    for k in range(n_blocks):
        rows = known.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == k).orderBy("words", "item_id").collect()
        ready = None
        if rows:
            lists = [np.array(r["words"], np.int64).view(np.uint64) for r in rows]
            sizes = sorted({min(SHINGLE, len(x)) for x in lists})
            wanted = np.unique(np.concatenate([_shingles(x, min(SHINGLE, len(x))) for x in lists]))
            ready = Block(rows, _rarity(docs, wanted, sizes, text_col))
        elif k:
            continue
        found = settle(_search(docs, ready, kind, id_col, text_col), "benchmark-hits")
        counts = found.select("doc_id", "text_key", "n_words") if counts is None else counts
        mine = found.where(F.size("hits") > 0).select("doc_id", "text_key", F.inline("hits"))
        spans = mine if spans is None else spans.unionByName(mine)
    hit = spans.distinct().groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )
    reach = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto"),
        ),
    )
    hit = hit.select(
        F.col("doc_id").alias("d"), F.col("text_key").alias("t"), reach["n"].alias("n_hit"), "items"
    )
    same = counts["doc_id"].eqNullSafe(hit["d"]) & (counts["text_key"] == hit["t"])
    return counts.join(hit, same, "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated() -> Column:
    """The rule over n_words and n_hit."""
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs."""
    return overlaps(docs, benchmark, **options).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    found = overlaps(docs, benchmark, **options).where(contaminated()).select(
        F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")
    )
    bad = settle(found.distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_t"]), "left_anti")
