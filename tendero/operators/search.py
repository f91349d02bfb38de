"""Fuzzy text search with trigrams, without comparing all pairs.

A similarity join finds its candidates through shared trigrams. Two texts with
similarity >= t must share a trigram among the first ``n - ceil(t n) + 1`` of
each side, in any fixed order; ordered from rare to frequent, the trigrams that
half of all texts contain drop out of that prefix. A pair is checked where its
first common prefix trigram meets, inside the join, so it is found once and only
true matches leave the join. This is exact: no candidate is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as lx
from ..functions import text as tx
from .catalog import ProductFilter, product_summary
from .current import first_per


def code(gram: Column) -> Column:
    """A trigram as one number, three code points of 21 bits: exact, and arrays of
    numbers intersect faster than arrays of strings."""

    def point(i: int) -> Column:
        return F.ascii(F.substring(gram, i, 1)).cast("bigint")

    return F.shiftleft(point(1), 42) + F.shiftleft(point(2), 21) + point(3)


def _ordered_grams(texts: DataFrame, frequency: DataFrame, column: str) -> DataFrame:
    """Texts with their trigrams (``grams``, codes) from rare to frequent."""
    grams = texts.select(column, F.explode(tx.trigrams(column)).alias("gram"))
    coded = grams.select(column, code(F.col("gram")).alias("gram"))
    ranked = coded.join(frequency, "gram", "left").groupBy(column).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g")
    )
    # trigrams of no right text are in the order, but lead nowhere
    known = F.size(F.filter("g", lambda x: x["n"] > 0))
    return ranked.select(column, F.col("g.gram").alias("grams"), (F.size("g") - known).alias("unknown"))


def needed_prefix(grams: Column, min_sim: float) -> Column:
    """As many of the first trigrams as a text that is similar enough cannot avoid."""
    size = F.size(grams)
    # the small allowance keeps 0.3 * 10 from being rounded up past 3
    needed = F.ceil(size * F.lit(min_sim) - F.lit(1e-9)).cast("int")
    return F.slice(grams, F.lit(1), size - needed + 1)


def trigram_join(
    left: DataFrame, right: DataFrame, min_sim: float = lx.SIMILARITY_THRESHOLD,
    left_text: str = "needle", right_text: str = "name",
) -> DataFrame:
    """Distinct (left text, right text, similarity) pairs with similarity >= min_sim."""
    if not 0 < min_sim <= 1:
        raise ValueError("min_sim must lie in (0, 1]")
    lefts = left.select(left_text).distinct()
    rights = right.select(right_text).distinct()
    frequency = (
        rights.select(F.explode(tx.trigrams(right_text)).alias("gram"))
        .select(code(F.col("gram")).alias("gram"))
        .groupBy("gram")
        .agg(F.count("*").alias("n"))
    )

    def side(texts: DataFrame, column: str, alias: str) -> DataFrame:
        prefixed = _ordered_grams(texts, frequency, column).withColumn(
            "prefix", needed_prefix(F.col("grams"), min_sim)
        )
        return prefixed.select(
            column,
            F.col("grams").alias(f"{alias}_grams"),
            F.col("prefix").alias(f"{alias}_prefix"),
            F.explode(F.slice("prefix", F.col("unknown") + 1, F.size("prefix"))).alias(f"{alias}_gram"),
        )

    l, r = side(lefts, left_text, "l"), side(rights, right_text, "r")
    first_common = F.get(F.array_intersect("l_prefix", "r_prefix"), F.lit(0))
    lengths = (F.size("r_grams") >= F.size("l_grams") * F.lit(min_sim - 1e-9)) & (
        F.size("l_grams") >= F.size("r_grams") * F.lit(min_sim - 1e-9)
    )
    score = tx.jaccard(F.col("l_grams"), F.col("r_grams"))
    meet = (F.col("l_gram") == F.col("r_gram")) & lengths & (first_common == F.col("l_gram"))
    return (
        l.join(r, meet & (score >= F.lit(min_sim)))
        .select(left_text, right_text, score.alias("similarity"))
    )


def contains_join(
    left: DataFrame, right: DataFrame, left_text: str = "needle", right_text: str = "name"
) -> DataFrame:
    """Distinct (left text, right text) pairs where the right contains the left.

    A text that contains a needle contains every three letters of it. Each
    needle looks under its rarest such piece only (shorter needles under the
    whole needle), and the containment is checked inside the join.
    """

    def pieces(c: str, length: Column) -> Column:
        last = F.greatest(F.length(c) - length + 1, F.lit(0))
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(c), i, length)))

    needles = left.select(left_text).distinct().filter(F.col(left_text) != "")
    texts = right.select(right_text).distinct()
    sizes = [F.lit(1), F.lit(2), F.lit(3)]
    under = texts.select(
        right_text, F.explode(F.flatten(F.array(*[pieces(right_text, n) for n in sizes]))).alias("piece")
    )
    frequency = under.groupBy("piece").agg(F.count("*").alias("n"))
    width = F.least(F.length(left_text), F.lit(3))
    options = needles.select(left_text, F.explode(pieces(left_text, width)).alias("piece"))
    rarest = (
        options.join(frequency, "piece")
        .groupBy(left_text)
        .agg(F.min(F.struct("n", "piece"))["piece"].alias("piece"))
    )
    return (
        rarest.join(under, "piece")
        .filter(F.contains(right_text, F.col(left_text)))
        .select(left_text, right_text)
    )


def matching_names(names: DataFrame, needles: DataFrame, min_sim: float) -> DataFrame:
    """(needle, name, similarity): similar enough, or containing the needle."""
    wanted = needles.select(tx.normalize_text("needle").alias("needle")).filter(F.col("needle") != "")
    similar = trigram_join(wanted, names, min_sim)
    inside = contains_join(wanted, names).select(
        "needle", "name", tx.similarity("needle", "name").alias("similarity")
    )
    return similar.unionByName(inside).groupBy("needle", "name").agg(
        F.max("similarity").alias("similarity")
    )


def search(
    tables, needles: DataFrame, min_sim: float = lx.SIMILARITY_THRESHOLD,
    store: str | None = None, limit: int | None = None, offset: int = 0, postings=None,
) -> DataFrame:
    """Products matching each needle with their store summary, best first.

    ``place`` numbers the products of a needle when a limit is given. With stored
    ``postings`` of the catalog's names none of these is cut into trigrams again.
    """
    products = product_summary(tables, ProductFilter(store=store))
    # all catalog names, priced or not: the join to the summaries drops the rest,
    # and the names need no prices
    names = tables.products.select(F.col("normalized_name").alias("name"))
    found = matching_names(names, needles, min_sim) if postings is None else postings.matching_names(needles, min_sim)
    found = found.withColumnRenamed("name", "normalized_name")
    if limit is None:
        return products.join(found, "normalized_name")
    # products of one name are equally similar: the first of each name are enough for a page
    products = first_per(products, ["normalized_name"], [F.asc("name"), F.asc("product_id")], offset + limit)
    rows = products.join(found, "normalized_name")
    order = Window.partitionBy("needle").orderBy(F.desc("similarity"), "name", "product_id")
    return (
        rows.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= offset + limit)
        .filter(F.col("place") > offset)
    )


def search_totals(
    tables, needles: DataFrame, min_sim: float = lx.SIMILARITY_THRESHOLD, store: str | None = None
) -> DataFrame:
    """(needle, total): how many products a search finds, counted by name."""
    products = product_summary(tables, ProductFilter(store=store)).groupBy("normalized_name").agg(F.count("*").alias("n"))
    names = tables.products.select(F.col("normalized_name").alias("name"))
    found = matching_names(names, needles, min_sim).withColumnRenamed("name", "normalized_name")
    return products.join(found, "normalized_name").groupBy("needle").agg(F.sum("n").alias("total"))


def similar_candidates(
    listings: DataFrame, catalog: DataFrame, k: int = lx.CANDIDATES_PER_LISTING,
    min_sim: float = lx.SIMILARITY_THRESHOLD,
) -> DataFrame:
    """The k most similar catalog products of each distinct listing title.

    Never links anything. Products of one name are equally similar, so no more
    than the first k of a name can be among the best k: those are kept per name
    before the names meet the titles, which keeps the result exact.
    """
    titles = listings.filter(F.col("normalized_title") != "").select("normalized_title").distinct()
    first_k = first_per(
        catalog.select("product_id", "name", "normalized_name"),
        ["normalized_name"], [F.asc("name"), F.asc("product_id")], k,
    )
    pairs = trigram_join(
        titles, catalog, min_sim, left_text="normalized_title", right_text="normalized_name"
    )
    return top_candidates(pairs.join(first_k, "normalized_name"), k)


def top_candidates(pairs: DataFrame, k: int = lx.CANDIDATES_PER_LISTING) -> DataFrame:
    order = [F.desc("similarity"), F.asc("name"), F.asc("product_id")]
    window = Window.partitionBy("normalized_title").orderBy(*order)
    return pairs.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= k)
