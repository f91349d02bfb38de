"""Price history: series, daily points, summaries and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as lx
from ..functions.dates import parse_date
from ..functions.money import mean_money, pct
from ..sources.tables import Tables
from .catalog import observations
from .current import between_dates, daily_last_price, first_per, lookback
from .parts import numbered_rows, parts_of, sorted_rows


def series_points(rows: DataFrame) -> DataFrame:
    """Scraped lines with a price as series points keyed by link, else by name.

    The day is the line's own, else that of its time of scraping, else the file's.
    """
    blank = F.lit("")
    scraped = F.col("scraped_at") if "scraped_at" in rows.columns else F.lit(None).cast("string")
    return (
        rows.filter(F.col("price").isNotNull())
        .withColumn("key", F.coalesce(F.nullif("url", blank), F.coalesce("name", blank)))
        .withColumn("date", F.coalesce("scraped_date", parse_date(scraped), F.to_date("snapshot_ts")))
    )


def daily_series(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per key and day: last, mean, lowest and highest price and samples.

    Points of one day are ordered by price, so the last one is the highest.
    """
    return points.groupBy(*(keys or ["key"]), "date").agg(
        F.max("price").alias("price_cop"),
        mean_money("price").alias("avg_price_cop"),
        F.min("price").alias("min_price_cop"),
        F.max("price").alias("max_price_cop"),
        F.count("*").alias("samples"),
    )


def series_summary(points: DataFrame) -> DataFrame:
    """One row per key over its points in (date, price) order.

    The remaining columns of the order only settle points equal in both. Sorted points
    have a number that tells the same order.
    """
    blank = F.lit("")
    number = ["_row"] if "_row" in points.columns else []
    order = F.struct(*number, "date", "price", "name", "category", "store_name", "url")

    def last_or_first(name: str):
        last, first = F.col("last")[name], F.col("first")[name]
        return F.coalesce(F.nullif(last, blank), F.nullif(first, blank), blank).alias(name)

    grouped = points.groupBy("key").agg(
        F.min(order).alias("first"),
        F.max(order).alias("last"),
        F.count("*").alias("count"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        mean_money("price").alias("avg_price"),
    )
    delta = F.col("last.price") - F.col("first.price")
    return grouped.select(
        "key",
        last_or_first("name"),
        last_or_first("category"),
        last_or_first("store_name"),
        last_or_first("url"),
        "count", "min_price", "max_price", "avg_price",
        F.col("first.date").alias("first_date"),
        F.col("last.date").alias("last_date"),
        F.col("first.price").alias("first_price"),
        F.col("last.price").alias("last_price"),
        delta.cast("decimal(18,2)").alias("delta_cop"),
        F.round(
            F.try_divide(delta * 100, F.col("first.price")), 4
        ).cast("decimal(18,4)").alias("delta_pct"),
    )


def top_products(summary: DataFrame, n: int = 20) -> DataFrame:
    return summary.orderBy(
        F.desc("last_date"), F.desc("count"), F.desc("name"), F.desc("key")
    ).limit(n)


POINT_ORDER = ["key", "date", "price", "name", "category", "store_name", "url"]


def series_histories(points: DataFrame, chunk: int = 10_000) -> DataFrame:
    """(key, part, history[]) with every point of every key, ``chunk`` to a part.

    Parts are numbered in order, so that no task holds all of a long history.
    """
    return _histories(sorted_points(points), chunk)


def sorted_points(points: DataFrame) -> DataFrame:
    """Points as a history has them, sorted by key and written once. Such points stay as they are."""
    if "_row" in points.columns:
        return points
    return sorted_rows(points.select(*POINT_ORDER), ["key"], POINT_ORDER[1:])


def _histories(placed: DataFrame, chunk: int) -> DataFrame:
    value = ["date", F.col("price").alias("price_cop"), "name", "category", "url", "store_name"]
    return parts_of(placed, ["key"], value, chunk, "history")


def series_export(points: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Nested export: summary, history[] and daily_series[] of every key.

    ``daily_series`` is bounded by days and stands in the first part. All three read
    the sorted points, which are formed once and lie together by key after one exchange.
    """
    placed = numbered_rows(sorted_points(points), ["key"])
    day = F.struct(
        "date", "price_cop", "avg_price_cop", "min_price_cop", "max_price_cop", "samples"
    )
    days = (
        daily_series(placed).groupBy("key").agg(F.array_sort(F.collect_list(day)).alias("daily_series"))
    )
    return (
        series_summary(placed)
        .join(days, "key")
        .join(_histories(placed, chunk), "key")
        .withColumn("daily_series", F.when(F.col("part") == 1, F.col("daily_series")))
    )


def oldest_points(points: DataFrame, n: int) -> DataFrame:
    """The limit of a history keeps its oldest points.

    They are found per product and day first, so that a product with most of all
    points does not send n of them from every task to one.
    """
    if n < 1:
        raise ValueError("limit must be positive")
    order = [F.asc("captured_at"), F.asc("price_id"), F.asc("price"), F.asc("listing_id")]
    daily = first_per(points.withColumn("_day", F.to_date("captured_at")), ["product_id", "_day"], order, n)
    return first_per(daily.drop("_day"), ["product_id"], order, n)


def history_stats(points: DataFrame) -> DataFrame:
    return points.groupBy("product_id").agg(
        F.count("*").alias("points"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        mean_money("price").alias("avg_price"),
    )


def product_history(
    tables: Tables, store: str | None = None, lo=None, hi=None,
    limit: int | None = None,
) -> DataFrame:
    """Observations of every product; with a ``limit`` the oldest so many of each."""
    points = between_dates(observations(tables), lo, hi)
    if store is not None:
        points = points.filter(F.col("store_slug") == store)
    points = points.filter(F.col("product_id").isNotNull())
    if limit is not None:
        points = oldest_points(points, limit)
    return points.select(
        "product_id", "store_slug", "price", "list_price", "available", "captured_at",
        "price_id", "listing_id",
    )


def history_array(tables: Tables, as_of, days: int | None = lx.HISTORY_DAYS) -> DataFrame:
    """``history`` array per listing: one point per day from ``days`` before ``as_of`` on, or all days with None."""
    daily = daily_last_price(tables.prices if days is None else lookback(tables.prices, as_of, days))
    return collect_history(daily, ["listing_id"])


def collect_history(daily: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Daily points (one per key and day) gathered into a sorted array."""
    point = F.struct(F.col(day).alias("date"), "price")
    return daily.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("history"))


def attach_history(rows: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their history, an empty array where there is none."""
    empty = F.array().cast("array<struct<date:date,price:decimal(18,2)>>")
    return rows.join(history, keys, "left").withColumn(
        "history", F.coalesce("history", empty)
    )


def history_deltas(rows: DataFrame) -> DataFrame:
    """Latest, previous and week-ago point of a ``history`` array, with the change.

    Counts points, not days: week-ago is the eighth from the end, else the
    first. Without history the latest price is the row's own ``price``.
    """
    at = lambda n: F.try_element_at("history", F.lit(n))["price"]
    enough = lambda n: F.size("history") >= n
    shaped = rows.select(
        "*",
        F.coalesce(at(-1), F.col("price")).alias("latest"),
        F.when(enough(2), at(-2)).alias("previous"),
        F.when(enough(8), at(-8)).otherwise(at(1)).alias("week_ago"),
    )
    change = F.col("latest") - F.col("week_ago")
    return shaped.select(
        "*",
        change.cast("decimal(18,2)").alias("variance_cop"),
        pct(change, F.col("week_ago")).alias("variance_pct"),
    )
