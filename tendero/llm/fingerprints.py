"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch keeps the k least of the different 48-bit shingle hashes of a text. Two
sketches of parts merge into the sketch of the whole by keeping the k least of
both; they estimate resemblance (Jaccard), containment and the number of
different shingles, and are exact for texts with at most k shingles.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts
from .hashing import U64, shingle_sets

SPACE = 1 << 48


@dataclass(frozen=True)
class Settings:
    k: int = 128
    words: int = 5


def sketch(shingles: np.ndarray, k: int) -> np.ndarray:
    """The k least different 48-bit values of 64-bit shingle hashes, sorted."""
    values = shingles >> U64(16)
    # sorted input stays sorted; equal neighbours only by a clash of the upper bits
    return np.unique(values[: 2 * k])[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int) -> float:
    """Estimated number of different shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * SPACE / float(a[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).mean())


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    size = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / size) if size else 1.0


def pack(a: np.ndarray) -> str:
    """Base64 of the values, six bytes each, most significant first."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(six), 2), np.uint8), six], axis=1).reshape(-1).view(">u8").astype(U64)


def fingerprints(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a text without words has an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), settings.words)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": [pack(sketch(s, settings.k)) for s in sets]})

    source = texts(docs)
    return source.mapInPandas(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def merge_fingerprints(parts: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """(key, fingerprint) of all parts with one key, such as a source.

    Values are parted, made distinct and cut to the k least per key, inside the map
    tasks first, so no task holds more than k values per key and input task.
    """

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("key", dropna=False):
                least = np.zeros(0, U64)
                for text in group["fingerprint"]:
                    least = merge(least, unpack(text), settings.k)
                yield pd.DataFrame({"key": name, "value": least.astype(np.int64)})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "fingerprint": [pack(np.sort(np.array(v, U64))) for v in batch["v"]]})

    source = parts.select(F.col(key).cast("string").alias("key"), "fingerprint").filter("fingerprint is not null")
    least = Window.partitionBy("key").orderBy("value")
    return (
        source.mapInPandas(values, "key string, value long").distinct()
        .withColumn("r", F.row_number().over(least)).filter(F.col("r") <= settings.k)
        .groupBy("key").agg(F.collect_list("value").alias("v"))  # k values at most
        .mapInPandas(packed, "key string, fingerprint string").withColumnRenamed("key", key)
    )


def _pages(docs: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt into pages of neighbouring ids, each page whole and in descending
    order in one task, followed by the first row of the page that comes next.

    The page ends are quantiles of the ids, a few per task, and each is an id that
    occurs; so the first row of each page is known by its id alone.
    """
    shares = [float(x) for x in np.linspace(0, 1, 4 * tasks + 1)[1:]]
    found = docs.agg(F.percentile_approx("doc_id", F.lit(shares), 10 * len(shares)).alias("q"), F.max("doc_id").alias("m")).first()
    ends = np.unique(np.array([*(found.q or []), *([] if found.m is None else [found.m])], dtype=np.int64))

    def page(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64)), dtype="int32")

    first_of_next = F.when(F.col("doc_id").isin(ends.tolist()), (F.col("page") + 1) % max(1, len(ends)))
    at = F.array(
        F.struct(F.col("page").alias("page"), F.lit(0).alias("tail")),
        F.struct(first_of_next.cast("int").alias("page"), F.lit(1).alias("tail")),
    )
    return (
        docs.withColumn("page", F.pandas_udf(page, "int")("doc_id"))
        .select("doc_id", "text", F.explode(F.filter(at, lambda x: x["page"].isNotNull())).alias("at"))
        .select("doc_id", "text", "at.page", "at.tail")
        .repartition(tasks, "page")
        .sortWithinPartitions("page", "tail", F.desc_nulls_last("doc_id"), "text")
    )


def edited_fingerprints(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fingerprints of every whole text, of an edited text and of the next one.

    The next document is the one with the next lower id; after the last comes the
    first; rows with one id follow each other by text, a null id stands last. The
    edited text has its last floor(n_chars / 2) code points replaced by the first
    as many, or all, of the next document's. Returns (doc_id, n_chars, edited,
    fingerprint, edited_fingerprint, near_edited, near_next). Texts cross the
    network once.
    """
    k = settings.k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first = None, None  # the row that waits for its successor; the first row of its page

        def flush(rows):
            ids = [r[0] for r in rows]
            own = [r[1] for r in rows]
            after = [r[2] for r in rows]
            cut = [len(t) // 2 for t in own]
            edited = [t[: len(t) - m] + n[:m] for t, n, m in zip(own, after, cut, strict=True)]
            a, b, c = ([sketch(s, k) for s in shingle_sets(x, settings.words)] for x in (own, edited, after))
            return pd.DataFrame(
                {
                    "doc_id": pd.array(ids, "Int64"), "n_chars": [len(t) for t in own], "edited": edited,
                    "fingerprint": list(map(pack, a)), "edited_fingerprint": list(map(pack, b)),
                    "near_edited": [resemblance(x, y, k) for x, y in zip(a, b, strict=True)],
                    "near_next": [resemblance(x, y, k) for x, y in zip(a, c, strict=True)],
                }
            )

        for batch in batches:
            rows = []
            ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            for i, text, page, tail in zip(ids, batch["text"], batch["page"], batch["tail"], strict=True):
                if held is not None and held[2] != page:
                    rows.append((held[0], held[1], first))
                    held = None
                if held is not None:
                    rows.append((held[0], held[1], text))
                elif not tail:
                    first = text
                held = None if tail else (i, text, page)
            if rows:
                yield flush(rows)
        if held is not None:
            yield flush([(held[0], held[1], first)])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = (
        "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return _pages(texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")), tasks).mapInPandas(run, shape)


def digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``edited_fingerprints`` with a digest in place of the edited text. Ids are integers;
    one of another type is cast, and what is no number is an error (null outside ANSI mode)."""
    return edited_fingerprints(docs, settings).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )
