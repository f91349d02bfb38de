"""Benchmark decontamination with DataFrame operations only.

The windows of the benchmark are hashed into a set; every document, in its own
row, slides over its words and keeps the places whose window hash is in the set;
only those places leave the row, and are verified word by word against the
windows. The set is part of the plan while it has at most ``broadcast`` hashes;
a larger one is joined instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: a word is a run of digits, a-z and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    window: int = 10
    broadcast: int = 100_000  # hashes that may stand in the plan (8 bytes each)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the short way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def window_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.get(words, at + k) for k in range(length)))


def window_words(words: Column, at: Column, length: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), length - 1), lambda k: F.get(words, at + k))


def starts(words: Column, length: int) -> Column:
    """Places at which a window of the length begins."""
    n = F.size(words)
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(hash, length, window, item_id): all windows of all items.

    An item of fewer words than a window, but not none, is one window; a null text
    has none.
    """
    worded = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.explode(F.array(words_of(F.col("text")))).alias("words"))

    length = F.least(F.size("words"), F.lit(s.window))

    def window(i: Column) -> Column:
        hashes = [F.when(length == k, window_hash(F.col("words"), i, k)) for k in range(1, s.window + 1)]
        return F.struct(F.coalesce(*hashes).alias("hash"), window_words(F.col("words"), i, length).alias("window"))

    each = F.transform(F.sequence(F.lit(0), F.size("words") - length), window)
    every = worded.filter(F.size("words") > 0).select("item_id", length.alias("length"), F.explode(each).alias("w"))
    return every.select("w.hash", "length", "w.window", "item_id").distinct()


def hits(docs: DataFrame, windows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Verified hits beside every document: (doc_id, version, copy, n_words, at, length,
    item), one row per place and item, which is a struct as its item_id may be null; a
    document without hits has one row of nulls. ``version`` tells texts of one id apart, ``copy`` numbers nothing: it is
    true in one row per row of the input.
    """
    kinds = windows.groupBy("length").agg(F.countDistinct("hash").alias("n")).collect()  # ten rows at most
    total = sum(r.n for r in kinds)
    base = docs.select("doc_id", F.xxhash64("text").alias("version"), words_of(F.col("text")).alias("words"))

    sets: dict[int, list[int]] = {}
    if total <= s.broadcast:
        for r in windows.select("length", "hash").distinct().collect():  # bounded by s.broadcast
            sets.setdefault(r.length, []).append(r.hash)

    def places(words: Column, length: int) -> Column:
        """Places of one window length whose hash is in the set; all without one."""
        every = starts(words, length)
        if length in sets:
            every = F.filter(every, lambda i: window_hash(words, i, length).isin(sets[length]))
        return F.transform(every, lambda i: F.struct(
            i.alias("at"), F.lit(length).alias("length"), window_hash(words, i, length).alias("hash"),
            window_words(words, i, F.lit(length)).alias("window"),
        ))

    def found(words: Column) -> Column:
        none = F.array().cast("array<struct<at: int, length: int, hash: bigint, window: array<string>>>")
        return F.concat(none, *(places(words, r.length) for r in kinds))

    in_row = base.select(
        "doc_id", "version", let(F.col("words"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), found(w).alias("found"))).alias("r")
    )
    placed = in_row.select("doc_id", "version", "r.n_words", F.posexplode_outer("r.found").alias("place", "hit"))
    placed = placed.select(
        "doc_id", "version", "n_words", (F.coalesce("place", F.lit(0)) == 0).alias("copy"),
        "hit.at", "hit.length", "hit.hash", "hit.window",
    )
    items = windows.select("hash", "length", "window", F.struct("item_id").alias("item"))
    return placed.join(items, ["hash", "length", "window"], "left").select(
        "doc_id", "version", "copy", "n_words", "at", "length", "item"
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, version, n_words, spans, items): every document with the hash of its text,
    the words hit, as struct(first, last) runs, and the benchmark items found in it,
    sorted as strings. Items without an id are one item, a null that comes last.

    A null text has no words. Rows of one id and text give as many equal rows;
    columns other than doc_id and text are left out. Without a benchmark nothing is
    hit.
    """
    windows = benchmark_windows(benchmark, s)
    each = hits(docs, windows, s)
    # copies: rows that count as the first of their document; items multiply them, so they are counted per place
    one = each.groupBy("doc_id", "version", "n_words", "at", "length", "copy").agg(
        F.collect_set("item").alias("items"), F.count("*").alias("rows")
    )
    by_doc = one.groupBy("doc_id", "version", "n_words").agg(
        F.sum(F.when(F.col("copy"), F.col("rows") / F.greatest(F.size("items"), F.lit(1)))).cast("int").alias("copies"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("items"))), lambda x: x["item_id"])).alias("items"),
        F.array_sort(F.collect_set(F.when(F.size("items") > 0, F.struct("at", (F.col("at") + F.col("length") - 1).alias("last"))))).alias("places"),
    )
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["last"])))))

    def runs(at: Column) -> Column:
        first = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) < x - 1))
        last = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > x + 1))
        return F.arrays_zip(first, last)

    return by_doc.select(
        "doc_id", "version", "n_words", let(covered, runs).cast("array<struct<first: int, last: int>>").alias("spans"), "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")
    ).drop("copy")


def digests(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Counts of words hit and items found, and a digest of the items that have ids."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return decontaminated(docs, benchmark, s).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows whose text is contaminated, whatever their id; all
    columns stay. Of several texts of one id only the contaminated ones go."""
    hit = decontaminated(docs, benchmark, s).filter(F.size("spans") > 0)
    hit = hit.select(F.col("doc_id").alias("__hit"), F.col("version").alias("__version")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__hit")) & (F.xxhash64("text") == F.col("__version"))
    return docs.join(hit, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with the words hit cut out of the texts; what stands between words
    stays. All columns and rows stay; several texts of one id are cut each for itself."""
    spans = decontaminated(docs, benchmark, s).filter(F.size("spans") > 0)
    spans = spans.select(F.col("doc_id").alias("__hit"), F.col("version").alias("__version"), F.col("spans").alias("__spans")).dropDuplicates(["__hit", "__version"])
    same = F.col("doc_id").eqNullSafe(F.col("__hit")) & (F.xxhash64("text") == F.col("__version"))
    words = F.regexp_extract_all(F.col("text"), F.lit(RAW_WORD), F.lit(0))
    gaps = F.split("text", RAW_WORD)

    def cut(parts: Column) -> Column:
        kept = F.transform(parts["words"], lambda w, i: F.when(
            F.exists(F.col("__spans"), lambda x: (x["first"] <= i) & (i <= x["last"])), F.lit("")
        ).otherwise(w))
        return F.array_join(F.zip_with(parts["gaps"], kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")

    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(let(F.struct(words.alias("words"), gaps.alias("gaps")), cut))
    return docs.join(spans, same, "left").withColumn("text", text).drop("__hit", "__version", "__spans")
