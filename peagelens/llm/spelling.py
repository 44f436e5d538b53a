"""Spelling variants: words of a vocabulary that one inserted, deleted or replaced character sets apart.

The vocabulary is a trie whose edges lie in a distributed table. A search is a frontier of states
(word, position, trie node, edits) that a join with the edges of one level takes to the next level, level by
level; a state with one edit that ends on the end of a word is a neighbour. Two neighbours share
either the first half of the one or its second half, so searches begin at the node of the first
half, and in a second trie of reversed words at the node of the second half. No search passes
the few crowded nodes near the root, and a node has no more edges than the alphabet has letters.

Only states that replace by a greater character or insert one are searched; deletions and the other
replacements are the same pairs read backwards.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peagelens.llm.wordscan import PIECE
from peagelens.session import fresh_path, remove, settle

MIN_LENGTH = 7
MIN_COUNT = 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: A run is read with one character missing if this divides its hash; 0 reads every run as it stands.
DROP_EVERY = 31
#: Levels walked one by one. What is left of a longer word is one edge, told by the hash of its characters.
LEVELS = 48
#: Words that a task counts before it hands its counts on.
HELD = 200_000

_PRIME = (1 << 61) - 1
_BASE = 0x1A2B_3C4D_5E6F_7081 % _PRIME
#: Hashes of the roots of the trie and of the reversed trie.
_ROOTS = 11, 13
_END = -(1 << 63)


def _runs(text: str, letters: re.Pattern) -> Counter:
    if len(text) <= PIECE:
        return Counter(letters.findall(text))
    return Counter(m.group() for m in letters.finditer(text))


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    drop_every: int = DROP_EVERY,
) -> DataFrame:
    """(word, n): runs of letters of at least ``min_length`` characters found at least ``min_count`` times."""
    letters = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([*total.values()], pa.int64())], ["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for key, raw in zip(batch.column(0), batch.column(1)):
                start = crc32(f"{key.as_py() or ''}:".encode())
                for word, n in _runs((raw.as_py() or b"").lower().decode(errors="replace"), letters).items():
                    if drop_every:
                        h = crc32(word.encode(), start)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                    total[word] += n
                if len(total) >= HELD:
                    yield hand_on()
        yield hand_on()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.repartition(parts, "word").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _prefixes(word: str, root: int) -> list[int]:
    """Hashes of the prefixes of a word, from the empty one."""
    out = [root]
    for c in word:
        root = (root * _BASE + ord(c) + 1) % _PRIME
        out.append(root)
    return out


def _suffixes(word: str) -> list[int]:
    """Hashes of the suffixes of a word, from the whole one."""
    out = [0]
    for c in reversed(word):
        out.append((out[-1] * _BASE + ord(c) + 1) % _PRIME)
    return out[::-1]


def _bit(word: str, at: int) -> int:
    """One of 64 bits for the character at a place, the last for the end of the word."""
    return 1 << ord(word[at]) % 63 if at < len(word) else _END


_PATH = (
    "id long, node long, ch string, child long, rest string, left int, here long, ahead long, before string, "
    "seed boolean, inserts boolean, tail long, tail_inserted long, suffix long, depth int"
)
_PATH_NAMES = [f.split()[0] for f in _PATH.split(", ")]
_PATH_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _path_rows(word: str, levels: int) -> Iterator[tuple]:
    """A row for each place of the second half of a word, and the edge that leaves it, in both tries."""
    size, half = len(word), len(word) // 2
    ident = 0
    for forward, root in zip((True, False), _ROOTS):
        r, start = (word, half) if forward else (word[::-1], size - half)
        nodes = _prefixes(r, root)
        ident = nodes[-1] if forward else ident
        suffixes = _suffixes(r) if size >= levels - 1 else None
        for p in range(max(start - 1, 0), size + 1):
            deep = p >= levels
            tail = tail_inserted = suffix = None
            if suffixes:
                after = p + 1 if deep else levels
                tail = suffixes[after] if after <= size else None
                tail_inserted = suffixes[after - 1] if after - 1 <= size else None
                suffix = suffixes[p] if deep else None
            yield (
                ident, nodes[p], r[p] if p < size else None, nodes[p + 1] if p < size else None,
                r[p:levels], size - p, _bit(r, p), _bit(r, p + 1) if p < size else None,
                (r[p] if p < size else "") if forward else (r[p - 1] if p else ""),
                p >= start, p >= start and (forward or p > start), tail, tail_inserted, suffix, min(p, levels),
            )


def paths(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The tries of ``word``: a row for each place where a search may branch, with the edge to the next."""
    types = [_PATH_TYPES[f.split()[1]] for f in _PATH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word in batch.column(0).to_pylist():
                for row in _path_rows(word, levels):
                    rows.append(row)
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _PATH_NAMES)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _PATH_NAMES)

    return words.select("word").mapInArrow(run, _PATH)


def named(words: DataFrame) -> DataFrame:
    """word, n, and the hashes of its ends in both tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            ends = [pa.array([_prefixes(w[::step], root)[-1] for w in texts], pa.int64()) for step, root in zip((1, -1), _ROOTS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *ends], ["word", "n", "id", "mirror"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, id long, mirror long")


def _advance(states: DataFrame, edges: DataFrame) -> DataFrame:
    """One level: states (edits 0 or 1) joined with the edges of their nodes."""
    e = edges.select("node", F.col("ch").alias("e_ch"), "e_child", "e_ahead")
    follow = (F.col("edits") == 1) & (F.col("e_ch") == F.col("ch"))
    replace = (F.col("edits") == 0) & (F.col("e_ch") > F.col("ch")) & (F.col("e_ahead").bitwiseAND(F.col("ahead")) != 0)
    insert = (
        (F.col("edits") == 0) & F.col("inserts") & (F.col("e_ch") != F.col("before"))
        & (F.col("e_ahead").bitwiseAND(F.col("here")) != 0)
    )

    def state(rest, left, tail):
        return F.struct(rest.alias("rest"), left.alias("left"), tail.alias("tail"))

    next_char = state(F.expr("substring(rest, 2)"), F.col("left") - 1, F.col("tail"))
    same_char = state(F.col("rest"), F.col("left"), F.col("tail_inserted"))
    made = F.array_compact(F.array(F.when(follow | replace, next_char), F.when(insert, same_char)))
    moved = states.join(e, "node").where(follow | replace | insert)
    return moved.select("id", F.col("e_child").alias("node"), F.explode(made).alias("s")).select("id", "node", "s.*")


_STATE = ["id", "node", "ch", "rest", "left", "here", "ahead", "before", "inserts", "tail", "tail_inserted"]


def _seeds(level: DataFrame) -> DataFrame:
    return level.where("seed").select(*_STATE, F.lit(0).alias("edits"))


def _edges(level: DataFrame) -> DataFrame:
    """One row for each edge; ``e_ahead`` has the bits of all characters that follow it."""
    found = level.where(F.col("ch").isNotNull()).select("node", "ch", "child", "ahead").repartition("node")
    return found.groupBy("node", "ch").agg(F.first("child").alias("e_child"), F.bit_or("ahead").alias("e_ahead"))


def near_pairs(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(word, n, other, other_n): all pairs of distinct ``word`` (with n) one edit apart, both ways round.

    words is read several times; settle it first. Paths and frontier are written level by level and
    removed at the end. Hashes only choose candidates; each pair is checked on the words themselves.
    """
    spark = words.sparkSession
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    folder = fresh_path(spark, "trie")
    paths(words, levels).write.partitionBy("depth").parquet(f"{folder}/paths")
    trie = spark.read.schema(_PATH).parquet(f"{folder}/paths")
    first = words.agg(F.min(F.length("word"))).first()[0] or 0
    state_schema = "id long, node long, rest string, left int, tail long"
    at = max(first // 2 - 1, 0)
    state = None
    done = []
    while at < min(longest, levels):
        level = trie.where(F.col("depth") == at)
        states = _seeds(level)
        if state is not None:
            blank = {c: F.lit(None) for c in ("here", "ahead", "before", "inserts", "tail_inserted")}
            going = state.where("left > 0").withColumns({"ch": F.expr("substring(rest, 1, 1)"), "edits": F.lit(1), **blank})
            states = states.unionByName(going.select(*states.columns))
        path = f"{folder}/level-{at + 1}"
        _advance(states, _edges(level)).write.parquet(path)
        state = spark.read.schema(state_schema).parquet(path)
        done.append(path)
        at += 1
    pairs = spark.createDataFrame([], "id long, node long")
    if done:
        pairs = spark.read.schema(state_schema).parquet(*done).where("left = 0").select("id", "node")
    if longest >= levels:
        deep = trie.where(F.col("depth") == levels)
        going = _advance(_seeds(deep), _edges(deep))
        if state is not None:
            going = going.unionByName(state.where("left > 0"))
        ends = deep.select("node", "left", F.col("suffix").alias("tail"), F.col("id").alias("end"))
        pairs = pairs.unionByName(going.join(ends, ["node", "left", "tail"]).select("id", F.col("end").alias("node")))
    known = settle(named(words), "words")
    ends = known.select(F.col("id").alias("node"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    mirrored = known.select(F.col("mirror").alias("node"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    found = pairs.join(ends.unionByName(mirrored), "node").join(known.select("id", "word", "n"), "id")
    found = found.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")
    found = settle(found, "near-words")
    remove(spark, folder)
    back = found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.unionByName(back)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): the form's form, and so on. Chains are halved each round.

    A form is ``RATIO`` times as frequent, so no chain is longer than the digits of a count.
    """
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = now.join(after, "root", "left")
        changed = stepped.where(F.col("further").isNotNull()).limit(1).count()
        if not changed:
            return now
        now = settle(stepped.select("word", F.coalesce("further", "root").alias("root")), "roots")


def grouped(words: DataFrame, ratio: int = RATIO, levels: int = LEVELS) -> DataFrame:
    """word, n, n_near, form, form_n, root for a table of distinct ``word`` with its count ``n``."""
    near = near_pairs(words, levels)
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    joined = words.join(best, "word", "left")
    strong = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    rows = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    rows = settle(rows, "forms")
    roots = _roots(rows.where(F.col("form").isNotNull()))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    drop_every: int = DROP_EVERY,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of the texts.

    form is the most frequent near word (ties: the first by code point) if it is ``ratio`` times as
    frequent as the word, else null; root follows forms to the last. Words are runs of the
    letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Null and empty texts have none; no words
    give no rows. A null id counts as an empty one. Repeated rows and ids are counted each time. Words of any
    length are compared whole. Other columns are not looked at.
    """
    words = settle(vocabulary(docs, id_col, text_col, min_length, min_count, drop_every), "vocabulary")
    return grouped(words, ratio)
