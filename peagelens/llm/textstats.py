"""Statistics of whole texts, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peagelens.llm.wordscan import SOLID, Piece, byte_set, covered, measure_texts, repeated

WINDOW = 5

_SYMBOLS = byte_set(lambda b: b < 128 and chr(b) in "#*$%&|<>")
_UPPER = byte_set(lambda b: 65 <= b <= 90)
_LOWER = byte_set(lambda b: 97 <= b <= 122)
_DIGIT = byte_set(lambda b: 48 <= b <= 57)
_PUNCT = byte_set(lambda b: 33 <= b <= 126 and not chr(b).isalnum())
_MARK = byte_set(lambda b: b < 128 and chr(b) in "!?")
_PIPE = byte_set(lambda b: b == 124)
_LEAD = byte_set(lambda b: b & 0xC0 != 0x80)
_STOP = byte_set(lambda b: b < 128 and chr(b) in ".,;:")

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
    "n_lower", "n_digits", "n_punct", "n_marks", "n_pipes", "n_stops", "n_distinct", "n_stutter",
)


def measure(texts: list[bytes]) -> list[np.ndarray]:
    """COUNTS of each text, as numpy columns."""
    p = Piece.of(texts, SOLID)
    hashed = p.hasher()
    words, n = hashed(p.starts, p.ends), len(texts)

    def by_text(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of[flags], minlength=n)

    at, window = p.windows(words, WINDOW)
    again, _ = repeated(p.text[at], window)
    in_repeat = covered(len(words), at[again], WINDOW)

    line_end = np.flatnonzero(p.buf == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    has_word = np.searchsorted(p.starts, line_end) > np.searchsorted(p.starts, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_text = np.searchsorted(p.begin, line_start, "right") - 1
    _, dup_line = repeated(line_text, hashed(line_start, line_end))

    _, seen = repeated(p.text, words)
    stutter = np.zeros(len(words), bool)
    stutter[1:] = (words[1:] == words[:-1]) & (p.text[1:] == p.text[:-1])
    counts = p.byte_counts()
    kind = lambda table: counts @ table.astype(np.int64)
    return [
        p.n_words,
        kind(SOLID & _LEAD),
        kind(_SYMBOLS),
        by_text(dup_line, line_text),
        by_text(in_repeat, p.text),
        np.bincount(line_text, minlength=n),
        *(kind(t) for t in (_UPPER, _LOWER, _DIGIT, _PUNCT, _MARK, _PIPE, _STOP)),
        p.n_words - by_text(seen, p.text),
        by_text(stutter, p.text),
    ]


def text_counts(docs: DataFrame, keep: dict[str, str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (new name: old name) and COUNTS, one row per row of docs."""
    return measure_texts(docs, keep, text_col, ", ".join(f"{c} long" for c in COUNTS), measure)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def ratios() -> dict[str, Column]:
    """Size-free statistics over COUNTS; all are defined for an empty text."""
    return {
        "symbol_share": _share("n_symbols", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "upper_share": F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)),
        "digit_share": _share("n_digits", "word_chars"),
        "punct_share": _share("n_punct", "word_chars"),
        "mark_share": _share("n_marks", "n_words"),
        "pipe_share": _share("n_pipes", "n_words"),
        "stop_share": _share("n_stops", "n_words"),
        "distinct_share": _share("n_distinct", "n_words"),
        "stutter_share": _share("n_stutter", "n_words"),
        "word_length": _share("word_chars", "n_words"),
        "line_words": _share("n_words", "n_lines"),
    }
