"""URL filter: allow and block rules, and a logistic regression for the rest.

The regression sees hashed character n-grams of host and path and is trained on a
small labelled table of URLs that comes with the call; its weights are a vector
of fixed length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values: (verdict, host, start of the path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# A small labelled table for training: words that sites of each label are named after.
# Prefixes, endings and the plain paths are the same for both labels, so that only the
# words tell them apart.
_GOOD_WORDS = (
    "library", "news", "garden", "docs", "museum", "university", "weather", "history", "science", "railway", "recipes",
    "cinema", "theatre", "bakery", "school", "travel", "parliament", "hospital", "orchestra", "archive", "geology", "botany",
    "chess", "sailing", "pottery", "bridge", "harbour", "village", "research", "journal", "atlas", "gazette",
)
_BAD_WORDS = (
    "pills", "meds", "spam", "casino", "money", "xxx", "clicks", "loans", "replica", "bonus", "jackpot", "adult", "lottery",
    "dating", "bets", "prizes", "ads", "tracker", "viagra", "poker", "escort", "payday", "crypto-doubler", "slots", "porn",
    "warez", "keygen", "cheap", "free-gifts", "win-big", "webcam", "banner",
)
_SHAPES = ("{a}.invalid", "www.{a}-{b}.test", "{a}{b}.com", "{b}.{a}.net", "m.{a}-{b}.org", "{a}-online.info")
_PLAIN_PATHS = ("", "/", "/index.html", "/about", "/2021/07/19", "/p/8841", "/a/b/c")


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled URLs: (url, bad). Every word meets two others of its label."""
    rows = []
    for bad, words in enumerate((_GOOD_WORDS, _BAD_WORDS)):
        for k, a in enumerate(words):
            for step in (1, 7):
                b = words[(k + step) % len(words)]
                shape = _SHAPES[(k + step) % len(_SHAPES)]
                rows += [(f"https://{shape.format(a=a, b=b)}{path}", bad) for path in (*_PLAIN_PATHS, f"/{a}/{b}", f"/{b}?q={a}")]
    return spark.createDataFrame(rows, "url string, bad int")


@dataclass(frozen=True)
class Settings:
    size: int = 1 << 14
    shortest: int = 3
    longest: int = 5
    steps: int = 200
    rate: float = 0.5
    penalty: float = 1e-4
    threshold: float = 0.5


def host_path(url: str | Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for a null URL and one without ``://``."""
    column = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.locate("://", column)
    rest = F.when(at > 0, F.substring(column, at + 3, F.length(column))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule), or null.

    A rule fits its host and all hosts below it, if the path starts with the
    rule's. ``rules`` is a short list of the caller's.
    """
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule")),
        )
        for verdict, h, p in rules
    ]
    return fits[0] if len(fits) == 1 else F.greatest(*fits)


def grams(host: str, path: str, s: Settings) -> list[int]:
    """Hashed character n-grams of the host and of the path."""
    out = []
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in range(s.shortest, s.longest + 1):
            out += [zlib.crc32((mark + part[i : i + n]).encode()) % s.size for i in range(len(part) - n + 1)]
    return out


def fit(urls: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights, the last one the bias, from a small labelled table (url, bad).

    The table is small by contract: it is labelled by hand.
    """
    host, path = host_path("url")
    rows = urls.filter(F.col("bad").isin(0, 1)).select(host.alias("h"), path.alias("p"), "bad").orderBy("h", "p", "bad").collect()
    weights = np.zeros(settings.size + 1)
    if not rows:
        return weights
    each = [np.unique(grams(r.h, r.p, settings)) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in each])
    column = np.concatenate(each).astype(int)
    scale = np.array([1 / np.sqrt(max(1, len(x))) for x in each])
    y = np.array([r.bad for r in rows], float)
    for _ in range(settings.steps):
        z = np.bincount(row, weights[column], len(rows)) * scale + weights[-1]
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        step = np.bincount(column, (g * scale)[row], settings.size)
        weights[:-1] -= settings.rate * len(rows) / 10 * (step + settings.penalty * weights[:-1])
        weights[-1] -= settings.rate * g.sum()
    return weights


def judge(pages: DataFrame, weights: np.ndarray, settings: Settings = Settings(), rules=RULES, id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every URL.

    The longest rule decides; where none fits, a score of ``threshold`` or more
    blocks. A null URL has an empty host and path and is scored as such; repeated
    rows stay repeated; other columns are left out.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w = shared.value
        for hosts, paths in batches:
            out = []
            for h, p in zip(hosts, paths, strict=True):
                found = list(set(grams(h, p, settings)))
                z = w[found].sum() / np.sqrt(max(1, len(found))) + w[-1]
                out.append(1 / (1 + np.exp(-z)))
            yield pd.Series(out, dtype=float)

    score = F.pandas_udf(run, "double")
    host, path = host_path("url")
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("score", score("host", "path"))
    return ruled.select(
        id_col, "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("score") >= settings.threshold, "block").otherwise("allow")).alias("verdict"),
        "score",
    )


