"""URL filter: domain rules first, then logistic regression on hashed character n-grams.

The regression is trained from a small labelled table of URLs and judges every URL
that no rule decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peagelens.llm.logistic import fit_sparse, sigmoid
from peagelens.llm.wordscan import ascii_lower, mix

#: The rules, a verdict and a host with a path; the longest that fits wins.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Labelled rows that the regression is trained on at most, and its hash buckets.
SAMPLE, BUCKETS = 20_000, 1 << 16
SIZES = (3, 4, 5)
PATH = 0.5
#: Block from this score on; above one half, as most sites are harmless.
THRESHOLD = 0.7
_DIGITS = re.compile(r"[0-9]+")

# The small labelled table, hosts with paths by verdict.
BLOCKED = (
    "casino-royal.example.com/slots casino.bonus-win.example.net/en/5512 online-casino.example.org/en/12 "
    "poker-win.example.com/de/9021.html win-jackpot.example.net/spin lucky-slots.example.org/fr/4410/ "
    "cheap-pills.example.org/buy pills-online.example.net/es/731 cheap-meds.example.com/en/88 "
    "viagra-shop.example.com/pills diet-pills.example.com/de/6407 cheap-replica.example.net/fr/15 "
    "adult-videos.example.com/en/2210 adult-cams.example.net/live xxx-tube.example.org/es/3301.html "
    "porn-x.example.com/free adult-dating.example.org/de/4 m.adult-x.example.org/en/1907 "
    "free-bets.example.org/odds sport-bets.example.net/en/640/ best-bets.example.com/fr/7118 "
    "bets-now.example.com/es/29 spam-mail.example.com/click link-farm.example.net/en/5140 "
    "content-farm.example.org/de/8003 spam-links.example.org/fr/66 ads-server.example.com/banner "
    "track-clicks.example.net/en/9313 ad-track.example.org/px ads-track.example.net/de/1250 "
    "click-ads.example.com/es/4077 free-money.example.com/en/31 get-rich.example.net/fast "
    "crack-keygen.example.org/download warez-free.example.com/fr/2986 payday-loans.example.net/apply "
    "www.casino-vegas.example.org/fr/8112 www.free-spins.example.com/en/57 blog.cheap-viagra.example.net/en/903 "
    "www.adult-shop.example.com/es/3418 m.win-bets.example.org/de/26 blog.spam-offers.example.com/en/4471"
).split()
ALLOWED = (
    "docs.python.example.org/en/3/library news.example.com/en/2024/economy library.example.org/books/12 "
    "university.example.net/de/forschung museum.example.org/fr/visite garden.example.com/en/plants "
    "weather.example.net/es/madrid recipes.example.com/fr/soupe history.example.org/en/4021 wiki.example.net/de/8123 "
    "blog.travel.example.com/en/3312 m.journal.example.org/es/9911 www.school.example.net/en/77.html "
    "www.theatre.example.org/de/4520 river.example.com/en/6512 mountain.example.net/fr/1442 "
    "station.example.org/en/5517/ therapist.example.com/en/981 another.example.net/de/65 thinking.example.org/en/7003 "
    "blog.northern.example.com/de/123 m.thornton.example.net/en/87 www.attention.example.org/fr/5 "
    "weather.therapy.example.org/en/4 there.example.com/es/6380 thistle.example.net/en/7788.html "
    "nation.example.org/en/17 tension.example.net/en/91 edition.example.com/de/3 theory.example.org/fr/8 "
    "thread.example.net/es/51 anthem.example.com/en/2 method.example.org/de/77 others.example.net/en/308 "
    "bakery.example.com/menu hospital.example.org/opening-hours council.example.net/minutes/2023 "
    "theatre.example.org/en/1 thirteen.example.com/en/22 north.example.net/en/5 thorn.example.org/en/9 "
    "the-others.example.net/en/4 blog.tionsville.example.com/en/61 tionesta.example.org/de/8 earth.example.net/en/30 "
    "code.example.com/project/readme shop.example.org/garden-tools open-data.example.net/census"
).split()


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#``; then up to ``?``, ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    pattern = r"^([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(rest, pattern, 1)), F.regexp_extract(rest, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, tail = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(strings: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the character n-grams of each string, its ends marked."""
    flat = "".join(f"\x02{s}\x03" for s in strings).encode("utf-32-le", "surrogatepass")
    chars = np.frombuffer(flat, np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(strings)), [len(s) + 2 for s in strings])
    rows, cells = [], []
    for n in SIZES:
        if len(chars) < n:
            continue
        last = len(chars) - n + 1
        h = np.full(last, n * 64 + salt, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + chars[k : k + last]
        own = np.flatnonzero(row[:last] == row[n - 1 :])
        rows.append(row[own])
        cells.append(mix(h[own]) % np.uint64(BUCKETS))
    return np.concatenate([*rows, np.zeros(0, int)]), np.concatenate([*cells, np.zeros(0, np.uint64)]).astype(np.int64)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): n-grams of the host, of length one together, and of the path,
    of length PATH. Digits of paths are alike: they number pages and say nothing."""
    parts = []
    for strings, salt, length in ((hosts, 1, 1.0), ([_DIGITS.sub("0", p) for p in paths], 2, PATH)):
        row, cell = _grams(strings, salt)
        size = np.bincount(row, minlength=len(strings))
        parts.append((row, cell, length / np.sqrt(size[row])))
    return tuple(np.concatenate(c) for c in zip(*parts))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        row, cell, value = features(hosts, paths)
        return sigmoid(np.bincount(row, weights=self.weights[cell] * value, minlength=len(hosts)) + self.bias)


def labelled_urls(spark) -> DataFrame:
    """The small labelled table: (url, label), label 1 where blocked."""
    rows = [(f"https://{u}", 1) for u in BLOCKED] + [(f"https://{u}", 0) for u in ALLOWED]
    return spark.createDataFrame(rows, "url string, label int")


def train(labelled: DataFrame, limit: int = SAMPLE, penalty: float = 3e-4) -> Model:
    """Fit on at most ``limit`` labelled URLs, those of the smallest hashes; rows without
    a label of 0 or 1 are left out, and without any row every URL scores 0.5."""
    host, path = parse(F.col("url"))
    known = labelled.where(F.col("label").isin(0, 1)).orderBy(F.xxhash64("url"), "url", "label").limit(limit)
    rows = known.select(host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label")).collect()
    target = np.array([r["label"] for r in rows], float)
    row, cell, value = features([r.host for r in rows], [r.path for r in rows])
    share = target.mean() if len(rows) else 0.5
    weight = np.where(target == 1, 1 / max(share, 1e-9), 1 / max(1 - share, 1e-9))
    return Model(*fit_sparse(row, cell, value, target, weight, BUCKETS, penalty))


def judge(pages: DataFrame, model: Model, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages.

    A null url, or one without ``://``, has an empty host and path and is judged by the
    regression alone, as every url without a fitting rule; repeated rows are judged
    alike; other columns of pages are not looked at. score is the regression's, 1: block.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(host.tolist(), path.tolist()))

    host, path = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("score", scored("host", "path"))
    method = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "score"
    )
