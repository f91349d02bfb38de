"""Language identification by words first, backing off to shorter character n-grams.

A known word counts with its log frequency in each language. A word that no
training text holds is taken apart: its longest n-grams that any language knows
speak for it; if none is known, the next shorter ones do. Languages are whatever
values the training rows carry.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
MARK = "\x02"  # stands before and after a word in its n-grams


@dataclass(frozen=True)
class Settings:
    """Bounds of the model; they do not depend on the size of the input."""

    sample_texts: int = 2_000  # training texts per language, those of least text hash
    words: int = 30_000  # known words per language, the most frequent
    grams: int = 8_000  # known n-grams per language and order
    longest: int = 5
    languages: int = 10_000  # languages whose bounds may be broadcast; more are joined by shuffle
    smoothing: float = 0.5
    weight: float = 0.25  # of one word's evidence in the posterior: neighbours are not independent


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int] = field(default_factory=dict)  # rows of the table
    grams: list[dict[str, int]] = field(default_factory=list)  # by order, from 1
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # log frequency by language
    settings: Settings = Settings()

    def vector(self, word: str) -> np.ndarray:
        """Log frequency of a word in every language."""
        known = self.words.get(word)
        if known is not None:
            return self.table[known]
        marked = MARK + word + MARK
        for n in range(min(self.settings.longest, len(marked)), 0, -1):
            rows = self.grams[n - 1]
            found = [rows[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in rows]
            if found:
                return self.table[found].mean(axis=0)
        return np.zeros(len(self.languages))


class Evidence(dict):
    """Row numbers of words in a matrix of their vectors, emptied when it is full."""

    def __init__(self, model: Model, limit: int):
        super().__init__()
        self.model, self.limit = model, limit
        self.matrix = np.zeros((limit // 4, len(model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        if row >= len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[row] = self.model.vector(word)
        return row

    def total(self, words: list[str]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.matrix[rows].sum(axis=0, dtype=np.float64)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() or any(map(str.isalpha, w)) for w in words)


def least_hashes(hashes: DataFrame, n: int, salts: int = 64) -> DataFrame:
    """The n least different ``h`` of each ``lang``: first of each part of a language,
    so that no task ranks more than ``salts`` times n of them for a whole one."""
    parts = Window.partitionBy("lang", "salt").orderBy("h")
    whole = Window.partitionBy("lang").orderBy("h")
    first = hashes.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(salts)))
    first = first.withColumn("r", F.row_number().over(parts)).filter(F.col("r") <= n).select("lang", "h")
    return first.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= n).select("lang", "h")


def _sample(training: DataFrame, settings: Settings) -> DataFrame:
    """At most ``sample_texts`` different texts per language, whole, by least hash."""
    hashed = training.select("lang", "text", F.xxhash64("text").alias("h"))
    bounds = least_hashes(hashed, settings.sample_texts).groupBy("lang").agg(F.max("h").alias("bound"))
    # a row per language, as many as the model has; without the broadcast all texts would be dealt out by language
    bounds = small(staged(bounds, "language-bounds"), settings.languages)
    chosen = hashed.join(bounds, "lang").filter("h <= bound").dropDuplicates(["lang", "h"])
    return staged(chosen.select("lang", "text"), "language-sample")


def fit(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """A model from the rows of ``docs`` that have a text and a language.

    It learns from a bounded sample, ``settings.sample_texts`` texts of each
    language; counting, ranking and cutting run on Spark, and only the tables of
    the model, bounded by ``settings``, come to the driver. No rows: a model
    without languages.
    """
    training = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("lang"):
                counts = Counter()
                for t in group["text"]:
                    counts.update(words_of(t))
                yield pd.DataFrame({"lang": name, "item": list(counts.keys()), "n": list(counts.values())})

    longest = settings.longest

    def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("lang"):
                counts = Counter()
                for word, n in zip(group["item"], group["n"], strict=True):
                    marked = MARK + word + MARK
                    for k in range(1, min(longest, len(marked)) + 1):
                        for i in range(len(marked) - k + 1):
                            counts[marked[i : i + k]] += n
                yield pd.DataFrame({"lang": name, "item": list(counts.keys()), "n": list(counts.values())})

    shape = "lang string, item string, n long"
    words = staged(
        _sample(training, settings).mapInPandas(count_words, shape)
        .groupBy("lang", "item").agg(F.sum("n").alias("n")).withColumn("size", F.lit(0)),
        "language-words",
    )
    grams = (
        words.select("lang", "item", "n").mapInPandas(count_grams, shape)
        .groupBy("lang", "item").agg(F.sum("n").alias("n")).withColumn("size", F.length("item"))
    )
    by = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "item")
    limit = F.when(F.col("size") == 0, settings.words).otherwise(settings.grams)
    both = staged(words.unionByName(grams), "language-counts")
    totals = both.groupBy("lang", "size").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    top = (
        both.withColumn("r", F.row_number().over(by))
        .filter(F.col("r") <= max(settings.words, settings.grams)).filter(F.col("r") <= limit)
        .select("lang", "item", "n", "size")
    )
    sums = {(r.lang, r.size): (r.total, r.kinds) for r in totals.collect()}
    languages = sorted({k[0] for k in sums})
    model = Model(languages, {}, [{} for _ in range(longest)], settings=settings)
    if not languages:
        return model
    a = settings.smoothing
    floors = [
        np.array([np.log(a / (t + a * k)) for t, k in (sums.get((name, s), (0, 1)) for name in languages)])
        for s in range(longest + 1)
    ]
    place = {name: i for i, name in enumerate(languages)}
    table = top.toArrow()  # bounded by the settings; columns, as rows of it would be ten times as large
    items, sizes = table.column("item").to_pylist(), table.column("size").to_numpy()
    at, size_of = np.empty(len(items), np.int64), []
    for k, (item, size) in enumerate(zip(items, sizes.tolist(), strict=True)):
        known = model.words if size == 0 else model.grams[size - 1]
        at[k] = row = known.setdefault(item, len(size_of))
        if row == len(size_of):
            size_of.append(size)
    model.table = np.array(floors, np.float32)[size_of]
    counts = [sums[name, size] for name, size in zip(table.column("lang").to_pylist(), sizes.tolist(), strict=True)]
    total, kinds = np.array(counts, float).T
    column = np.array([place[name] for name in table.column("lang").to_pylist()])
    model.table[at, column] = np.log((table.column("n").to_numpy() + a) / (total + a * kinds))
    return model


def predictor(docs: DataFrame, model: Model):
    """A column function: text to struct(lang_pred, score).

    ``score`` is the posterior of the language among the learned ones. A null
    text, one without a letter, or a model without languages gives ``und`` and 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        evidence = Evidence(m, 120_000)
        for batch in batches:
            names, scores = [], []
            for text in batch:
                found = words_of(text) if text else []
                if not m.languages or not has_letter(found):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = evidence.total(found) * m.settings.weight
                best = int(total.argmax())
                names.append(m.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    # the annotations are looked up by Spark
    return F.pandas_udf(run, "lang_pred string, score double")


def identify(docs: DataFrame, model: Model, text: str | Column = "text") -> DataFrame:
    """``docs`` with a struct column ``language`` (lang_pred, score) added last;
    a column of that name is replaced."""
    column = F.col(text) if isinstance(text, str) else text
    return docs.withColumn("language", predictor(docs, model)(column))
