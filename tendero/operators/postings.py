"""Trigram postings of names, stored once and added to as names come.

A search over stored names cuts its needles alone: their rare trigrams lead to the
names that have them, and only those names are compared. Every batch of names has a
folder of its own, so that a batch that is written again replaces itself; counts
are kept beside the postings and summed over the batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..session import children
from .current import first_per
from .search import code, needed_prefix, top_candidates

LONGEST_PIECE = 3


def coded_grams(name: Column | str) -> Column:
    """The different trigrams of a text as numbers."""
    return F.transform(tx.trigrams(name), code)


def pieces(text: Column, length: int) -> Column:
    """The different substrings of a length."""
    last = F.length(text) - length + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(length))))


def _parts(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """Folders of the finished batches, all or those below one."""
    numbers = [int(c.split("=")[1]) for c in children(spark, path) if c.startswith("batch=")]
    fine = [n for n in sorted(numbers) if (before is None or n < before) and "_SUCCESS" in children(spark, f"{path}/batch={n}/names")]
    return [f"{path}/batch={n}" for n in fine]


def add_names(names: DataFrame, path: str, batch: int = 0) -> None:
    """Store the postings of the ``name`` s that no earlier batch has.

    ``names`` is written last: a batch without it is not read. Null names are left
    out; an empty name has no trigrams and is only known as stored.
    """
    spark = names.sparkSession
    new = names.select("name").filter(F.col("name").isNotNull()).distinct()
    if earlier := [f"{p}/names" for p in _parts(spark, path, batch)]:
        new = new.join(spark.read.parquet(*earlier), "name", "left_anti")
    at = f"{path}/batch={batch}"
    # written first under another name: postings and counts come from the same rows
    new.write.mode("overwrite").parquet(f"{at}/new")
    new = spark.read.parquet(f"{at}/new")
    grams = new.select("name", coded_grams("name").alias("g")).select(F.explode("g").alias("gram"), "name", F.size("g").alias("size"))
    every = F.flatten(F.array(*(pieces(F.col("name"), n) for n in range(1, LONGEST_PIECE + 1))))
    cut = new.select(F.explode(every).alias("piece"), "name")
    for label, rows, key in (("grams", grams, "gram"), ("pieces", cut, "piece")):
        # sorted by key: a reader skips row groups that hold none of the wanted ones
        rows.repartitionByRange(key, "name").sortWithinPartitions(key, "name").write.mode("overwrite").parquet(f"{at}/{label}")
        counted = spark.read.parquet(f"{at}/{label}").groupBy(key).agg(F.count("*").alias("n"))
        counted.write.mode("overwrite").parquet(f"{at}/{label}-counts")
    new.write.mode("overwrite").parquet(f"{at}/names")


@dataclass(frozen=True)
class Postings:
    """The stored names of a folder, as of its finished batches."""

    spark: SparkSession
    path: str

    def _read(self, label: str) -> DataFrame:
        parts = _parts(self.spark, self.path)
        if not parts:
            raise ValueError(f"no postings in {self.path}")
        return self.spark.read.parquet(*(f"{p}/{label}" for p in parts))

    def names(self) -> DataFrame:
        return self._read("names")

    def _counts(self, label: str, key: str) -> DataFrame:
        return self._read(f"{label}-counts").groupBy(key).agg(F.sum("n").alias("n"))

    def similar(self, needles: DataFrame, min_sim: float = lx.SIMILARITY_THRESHOLD, column: str = "needle") -> DataFrame:
        """Distinct (needle, name, similarity) with similarity >= min_sim, exactly.

        A name as similar has one of the first trigrams of the needle, from rare to
        frequent; a pair is compared at the first one they share.
        """
        if not 0 < min_sim <= 1:
            raise ValueError("min_sim must lie in (0, 1]")
        cut = needles.select(column).distinct().select(column, F.explode(coded_grams(column)).alias("gram"))
        ranked = cut.join(self._counts("grams", "gram"), "gram", "left").groupBy(column).agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g")
        )
        ordered = ranked.select(column, F.col("g.gram").alias("grams"), F.transform(
            F.filter(needed_prefix(F.col("g"), min_sim), lambda x: x["n"] > 0), lambda x: x["gram"]
        ).alias("prefix"))
        asked = ordered.select("*", F.explode("prefix").alias("gram"))
        allowance = F.lit(min_sim - 1e-9)
        lengths = (F.col("size") >= F.size("grams") * allowance) & (F.size("grams") >= F.col("size") * allowance)
        met = asked.join(self._read("grams"), "gram").filter(lengths)
        compared = met.withColumn("other", coded_grams("name"))
        first = F.get(F.filter("prefix", lambda g: F.array_contains("other", g)), F.lit(0))
        score = tx.jaccard(F.col("grams"), F.col("other"))
        return compared.filter((first == F.col("gram")) & (score >= F.lit(min_sim))).select(column, "name", score.alias("similarity"))

    def containing(self, needles: DataFrame, column: str = "needle") -> DataFrame:
        """Distinct (needle, name) where the name contains the needle, looked up under the
        needle's rarest piece."""
        wanted = needles.select(column).distinct().filter(F.col(column) != "")
        own = F.when(F.length(column) >= LONGEST_PIECE, pieces(F.col(column), LONGEST_PIECE)).otherwise(F.array(F.col(column)))
        options = wanted.select(column, F.explode(own).alias("piece"))
        rarest = options.join(self._counts("pieces", "piece"), "piece", "left").groupBy(column).agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))["piece"].alias("piece")
        )
        return rarest.join(self._read("pieces"), "piece").filter(F.contains("name", F.col(column))).select(column, "name")

    def matching_names(self, needles: DataFrame, min_sim: float = lx.SIMILARITY_THRESHOLD) -> DataFrame:
        """(needle, name, similarity): similar enough, or containing the needle."""
        wanted = needles.select(tx.normalize_text("needle").alias("needle")).filter(F.col("needle") != "")
        inside = self.containing(wanted).select("needle", "name", tx.similarity("needle", "name").alias("similarity"))
        both = self.similar(wanted, min_sim).unionByName(inside)
        return both.groupBy("needle", "name").agg(F.max("similarity").alias("similarity"))

    def similar_candidates(
        self, listings: DataFrame, catalog: DataFrame, k: int = lx.CANDIDATES_PER_LISTING, min_sim: float = lx.SIMILARITY_THRESHOLD
    ) -> DataFrame:
        """The k most similar catalog products of each distinct listing title; the names of
        the catalog are the stored ones."""
        titles = listings.filter(F.col("normalized_title") != "").select("normalized_title")
        pairs = self.similar(titles, min_sim, "normalized_title").withColumnRenamed("name", "normalized_name")
        order = [F.asc("name"), F.asc("product_id")]
        first_k = first_per(catalog.select("product_id", "name", "normalized_name"), ["normalized_name"], order, k)
        return top_candidates(pairs.join(first_k, "normalized_name"), k)
