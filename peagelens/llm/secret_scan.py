"""Secrets in whole texts: three fixed patterns and a token-efficiency test.

Random strings fall apart into many tokens of a vocabulary made for language, so few
characters for each token expose them. The test looks at long runs of the characters
that keys are made of: at the whole run if it has letters and digits or often changes case,
and at each long piece of letters alone. It leaves out what is random but no secret:
digests of the usual lengths, UUIDs, and names, paths and dates made of short plain pieces.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peagelens.llm.wordscan import measure_texts

#: Ranked byte-pair vocabulary, read by the driver and sent to the tasks (under 1 MB).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A candidate is a secret below so many characters for each token.
RATIO = 2.0
#: Characters that a run, or a piece of one, has at least to be tested.
LEAST = 20
#: The ratio of letters of upper case only is this part of RATIO, as words in capitals have more tokens.
UPPER = 0.875
#: What a found span is replaced by.
MASK = "[REDACTED]"

# The patterns of the base rules.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "token")

_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
# Names, paths and dates: pieces of letters in one case or of digits only.
_NAME = re.compile(r"(?:[a-z]*|[A-Z]*|[A-Z][a-z]+|[0-9]+)(?:[/_+-]+(?:[a-z]*|[A-Z]*|[A-Z][a-z]+|[0-9]+))*={0,2}")
_LETTERS = re.compile(r"[A-Za-z]{%d,}" % LEAST)
_SWITCH = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")
# Fixed value: the pattern that splits text before the merges of this vocabulary.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ready: dict[int, tiktoken.Encoding] = {}


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file's content, built once in each process."""
    key = hash(vocabulary)
    if key not in _ready:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ready[key] = tiktoken.Encoding("secrets", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ready[key]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the fixed patterns, in code points."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def looks_random(run: str, tokens: tiktoken.Encoding, ratio: float) -> bool:
    """Whether a run of key characters is token-inefficient and not a known identifier."""
    if _DIGEST.fullmatch(run) or _UUID.fullmatch(run):
        return False
    mixed = any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
    if (mixed or len(_SWITCH.findall(run)) >= 4) and not _NAME.fullmatch(run):
        if len(run) < ratio * len(tokens.encode_ordinary(run)):
            return True
    return any(
        len(x) < ratio * (UPPER if x.isupper() else 1) * len(tokens.encode_ordinary(x)) for x in _LETTERS.findall(run)
    )


def _cuts_string(text: str, a: int, b: int, kind: str) -> bool:
    """Whether a base span is a part of a longer string and not a known digest or whole word."""
    left = a > 0 and text[a - 1].isalnum() and text[a].isalnum()
    right = b < len(text) and text[b - 1].isalnum() and text[b].isalnum()
    return left or right or (kind == "hex" and not _DIGEST.fullmatch(text, a, b))


def token_spans(text: str, taken: list[tuple[int, int, str]], tokens: tiktoken.Encoding, ratio: float) -> list:
    """(start, end, "token") of random-looking runs, in order.

    A run that lies in taken spans is none. One that touches some is tested as a whole
    if such a span cuts through a string, and otherwise, or if that is not random, piece by
    piece outside the spans.
    """
    out = []
    for m in _RUN.finditer(text):
        start, end = m.span()
        touched = [s for s in taken if s[0] < end and start < s[1]]
        at, pieces = start, []
        for a, b, _ in sorted(touched):
            if a > at:
                pieces.append((at, a))
            at = max(at, b)
        if at < end:
            pieces.append((at, end))
        if pieces and any(_cuts_string(text, *s) for s in touched) and looks_random(m[0], tokens, ratio):
            pieces = [(start, end)]
        elif touched:
            pieces = [(a, b) for a, b in pieces if b - a >= LEAST and looks_random(text[a:b], tokens, ratio)]
        elif not looks_random(m[0], tokens, ratio):
            pieces = []
        out += [(a, b, "token") for a, b in pieces]
    return out


def _scanner(docs: DataFrame, vocabulary: str, ratio: float):
    """A function for the tasks: text to (base spans, token spans), each in order."""
    with open(vocabulary, "rb") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    order = {k: i for i, k in enumerate(KINDS)}

    def scan(text: str) -> tuple[list, list]:
        base = sorted(base_spans(text), key=lambda s: (s[0], order[s[2]]))
        return base, token_spans(text, base, encoding(held.value), ratio)

    return scan, order


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_token, base_spans, spans) for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start, then kind, joined
    by commas. A null text counts as empty; a null id stays null; repeated rows
    are scanned one by one; other columns of docs are not looked at.
    """
    find, order = _scanner(docs, vocabulary, ratio)

    def joined(spans: list) -> str:
        return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    def measure(texts: list[bytes]) -> list:
        counts, base_text, all_text = np.zeros((4, len(texts)), np.int64), [], []
        for i, raw in enumerate(texts):
            base, more = find(_text(raw))
            for _, _, kind in base + more:
                counts[order[kind], i] += 1
            base_text.append(joined(base))
            all_text.append(joined(sorted(base + more, key=lambda s: (s[0], order[s[2]]))))
        return [*counts, pa.array(base_text, pa.string()), pa.array(all_text, pa.string())]

    schema = "n_assign long, n_access long, n_hex long, n_token long, base_spans string, spans string"
    return measure_texts(docs, {"doc_id": id_col}, text_col, schema, measure)


def report(docs: DataFrame, **options) -> DataFrame:
    """The scan with the SHA-256 of the base spans in place of their list."""
    return scan(docs, **options).select(
        "doc_id", "n_assign", "n_access", "n_hex", "n_token", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


def redact(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """docs with every found span replaced by MASK; spans that overlap become one.

    Null texts stay null, all other columns and their order stay.
    """
    find, _ = _scanner(docs, vocabulary, ratio)

    def masked(raw: bytes) -> str:
        text = _text(raw)
        base, more = find(text)
        out, at = [], 0
        for a, b, _ in sorted(base + more):
            if a >= at:
                out += [text[at:a], MASK]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def measure(texts: list[bytes]) -> list:
        return [pa.array([masked(t) for t in texts], pa.string())]

    flagged = docs.withColumn("__null", F.col(text_col).isNull())
    keep = {c: c for c in flagged.columns if c != text_col}
    made = measure_texts(flagged, keep, text_col, "__masked string", measure)
    text = F.when(~F.col("__null"), F.col("__masked")).alias(text_col)
    return made.select(*(text if c == text_col else F.col(c) for c in docs.columns))
