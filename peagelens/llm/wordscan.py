"""Word spans and hashes of many texts at once, by numpy over their UTF-8 bytes.

A batch of texts arrives in a task through Arrow and is worked off in pieces of
about ``PIECE`` bytes, so memory is some 60 bytes for each byte of a piece or of
the longest single text, whatever the size of the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PIECE = 1 << 20
PIECE_ROWS = 2048
#: Spans of more bytes are hashed one by one.
LONG = 256

_U = np.uint64
_SEED = np.random.Generator(np.random.PCG64(20_240_601))
#: One odd 64-bit factor for each byte value, so that runs of bytes hash apart.
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD6E8FEB86659FD93)


def byte_set(wanted: Callable[[int], bool]) -> np.ndarray:
    """A table of 256 flags."""
    return np.array([wanted(b) for b in range(256)])


#: Every byte but the space and 0x09-0x0D; bytes of longer characters are included.
SOLID = byte_set(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ASCII digits and letters, and every byte of a longer character.
ALNUM = byte_set(lambda b: b >= 0x80 or chr(b).isalnum())


def _powers(n: int, base: int, known: dict = {}) -> np.ndarray:  # noqa: B006
    """base ** 0..n-1 modulo 2 ** 64, kept for the next piece unless very long."""
    have = known.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 4096), base, _U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        if n <= 4 * PIECE:
            known[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = (h ^ (h >> _U(32))) * _STEP
    h = (h ^ (h >> _U(29))) * _STEP
    return h ^ (h >> _U(32))


@dataclass
class Piece:
    """Texts side by side, a line break behind each, and the spans of their words."""

    buf: np.ndarray
    begin: np.ndarray  # first byte of each text; one more entry for the end
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # the text that each word belongs to
    first: np.ndarray  # first word of each text; one more entry for the end

    @classmethod
    def of(cls, texts: list[bytes], inside: np.ndarray) -> Piece:
        """Words are the longest runs of bytes for which ``inside`` is set."""
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        solid = inside[buf]
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if solid[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        first = np.searchsorted(starts, begin)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        return cls(buf, begin, starts, ends, text, first)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def byte_counts(self) -> np.ndarray:
        """How often each of the 256 bytes occurs in each text, the added line breaks too."""
        n = len(self.begin) - 1
        cell = np.repeat(np.arange(n) * 256, np.diff(self.begin)) + self.buf
        return np.bincount(cell, minlength=256 * n).reshape(n, 256)

    def hasher(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function from byte spans to 64-bit hashes of their bytes.

        Sums modulo 2 ** 64 can be made to collide by long regular texts, so spans beyond LONG bytes get XXH64.
        """
        run = np.zeros(len(self.buf) + 1, _U)
        np.cumsum(_BYTE[self.buf] * _powers(len(self.buf), _BASE), dtype=_U, out=run[1:])
        back = _powers(len(self.buf) + 1, _INVERSE)
        whole = memoryview(self.buf)

        def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            h = (run[ends] - run[starts]) * back[starts]
            h = mix(h + (ends - starts).astype(_U) * _STEP)
            long = np.flatnonzero(ends - starts > LONG)
            h[long] = [xxhash.xxh64_intdigest(whole[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            return h

        return of

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of ``size`` words inside one text."""
        if len(hashes) < size:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        last = len(hashes) - size + 1
        h = np.zeros(last, _U)
        for k in range(size):
            h = h * _U(_BASE) + hashes[k : k + last]
        at = np.flatnonzero(self.text[:last] == self.text[size - 1 :])
        return at, mix(h[at])


def repeated(group: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is equal to another of its group, is so but not the one counted as first) for each hash."""
    again, later = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    key = hashes ^ mix(group.astype(_U) + _U(1))
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    later[order[same + 1]] = True
    again[order[same]] = again[order[same + 1]] = True
    return again, later


def covered(n: int, at: np.ndarray, size) -> np.ndarray:
    """Which of n places lie in one of the spans that begin at ``at``."""
    step = np.bincount(at, minlength=n + 1) - np.bincount(at + size, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut wherever about PIECE bytes or PIECE_ROWS rows are reached."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    which = (np.cumsum(sizes.astype(np.int64)) // PIECE) * batch.num_rows + np.arange(batch.num_rows) // PIECE_ROWS
    cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def measure_texts(
    docs: DataFrame,
    keep: dict[str, str],
    text_col: str,
    schema: str,
    measure: Callable[[list[bytes]], list],
) -> DataFrame:
    """One row per row of docs: the columns ``keep`` (new name: old name), then
    what ``measure`` makes of the texts, in the order of ``schema``.

    ``measure`` takes texts as UTF-8 (null counts as empty) and returns a column
    for each further field.
    """
    names = [*keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, len(names)):
                made = measure([t or b"" for t in part.column(len(names)).to_pylist()])
                columns = [*part.columns[:-1], *(c if isinstance(c, pa.Array) else pa.array(c) for c in made)]
                yield pa.RecordBatch.from_arrays(columns, [*names, *fields])

    inner = docs.select(
        *(docs[old].alias(new) for new, old in keep.items()), docs[text_col].cast("binary").alias("__text")
    )
    kept = inner.drop("__text").schema
    made = StructType.fromDDL(schema)
    fields = made.fieldNames()
    for f in made:
        kept = kept.add(f)
    return inner.mapInArrow(run, kept)


def ascii_lower(text_col) -> F.Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text_col, upper, upper.lower())
