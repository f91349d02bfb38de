"""Latest observations, first-seen deduplication and row filters.

Latest-of and first-of are ``row_number() <= 1`` windows: Spark puts a group
limit before the exchange, so each task sends at most one row per key and a
hot key does not pile up.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of every key, cut before the exchange whatever n is."""
    conf = df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT)) < n:
        conf.set(GROUP_LIMIT, str(n))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= n).drop("_n")


def current_prices(prices: DataFrame) -> DataFrame:
    """The newest observation of every listing; the rest of the order settles ties."""
    newest = [F.desc("captured_at"), F.desc("price_id"), F.asc("price"), F.asc("list_price")]
    return first_per(prices, ["listing_id"], newest)


def first_by_sku(rows: DataFrame, order: list[Column]) -> DataFrame:
    """First sighting of a sku of a store, over all its categories."""
    return first_per(rows, ["store_slug", "sku"], order)


def valid_snapshot_rows(rows: DataFrame) -> DataFrame:
    """Lines with a name, a price and a link, trimmed."""
    return (
        rows.withColumn("name", tx.strip("name"))
        .withColumn("url", tx.strip(F.coalesce("url", F.lit(""))))
        .filter((F.col("name") != "") & F.col("price").isNotNull() & (F.col("url") != ""))
    )


def first_by_url(rows: DataFrame, per: Iterable[str] = ("snapshot_store", "snapshot_ts")) -> DataFrame:
    """First line of every link within a snapshot (or within other keys)."""
    return first_per(rows, [*per, "url"], [F.asc("line_order")])


def category_sightings(rows: DataFrame) -> DataFrame:
    """Per store and category: lines seen and distinct links among them."""
    per_link = rows.groupBy("snapshot_store", "category", "url").agg(F.count("*").alias("seen"))
    return per_link.groupBy("snapshot_store", "category").agg(
        F.sum("seen").alias("visible"), F.count("*").alias("new")
    )


def restrict(df: DataFrame, ids: DataFrame | None = None, stores: DataFrame | None = None) -> DataFrame:
    """Rows whose product and store are listed. The planner sizes the lists."""
    if ids is not None:
        df = df.join(ids, "product_id", "left_semi")
    if stores is not None:
        df = df.join(stores, "store_id", "left_semi")
    return df


DAY_FOLDER = "day"  # partition column of prices written by ``append_prices``


def _from_day(df: DataFrame, bound: Column, column: str) -> DataFrame:
    """A lower bound of the stamp as one of the day folders too, where there are any."""
    foldered = column == "captured_at" and DAY_FOLDER in df.columns
    return df.filter(F.col(DAY_FOLDER) >= F.to_date(bound)) if foldered else df


def between_dates(
    df: DataFrame, lo: date | datetime | str | None = None, hi: date | datetime | str | None = None,
    column: str = "captured_at",
) -> DataFrame:
    """Both ends included. Day folders outside the range are not read."""
    if lo is not None:
        bound = F.lit(lo).cast("timestamp")
        df = _from_day(df.filter(F.col(column) >= bound), bound, column)
    if hi is not None:
        bound = F.lit(hi).cast("timestamp")
        df = df.filter(F.col(column) <= bound)
        if column == "captured_at" and DAY_FOLDER in df.columns:
            df = df.filter(F.col(DAY_FOLDER) <= F.to_date(bound))
    return df


def lookback(df: DataFrame, as_of: datetime | str, days: int, column: str = "captured_at") -> DataFrame:
    """Rows of the days before ``as_of``; older day folders are not read."""
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return _from_day(df.filter(F.col(column) >= start), start, column)


def on_days(df: DataFrame, days: DataFrame, column: str = "captured_at") -> DataFrame:
    """Rows whose day is in ``days`` (day). Over day folders the list prunes the scan
    when the query runs, as it is a semi join on the folder column."""
    if DAY_FOLDER in df.columns:
        return df.join(days.select(DAY_FOLDER).distinct(), DAY_FOLDER, "left_semi")
    return df.join(days.select(F.col(DAY_FOLDER).alias("_day")).distinct(), F.to_date(column) == F.col("_day"), "left_semi")


def daily_last_price(prices: DataFrame) -> DataFrame:
    """Last price of every listing and day: (listing_id, day, price)."""
    return (
        prices.groupBy("listing_id", F.to_date("captured_at").alias("day"))
        .agg(
            F.max_by(
                "price", F.struct("captured_at", "price_id", -F.col("price"))
            ).alias("price")
        )
    )


def daily_last_by_snapshot(rows: DataFrame) -> DataFrame:
    """Last price per (store, url, name, day): later snapshot, then later line, wins."""
    return (
        rows.withColumn("name", tx.strip("name"))
        .withColumn("url", tx.strip(F.coalesce("url", F.lit(""))))
        .filter((F.col("name") != "") & F.col("price").isNotNull())
        .groupBy("snapshot_store", "url", "name", F.col("snapshot_day").alias("day"))
        .agg(F.max_by("price", F.struct("snapshot_ts", "line_order")).alias("price"))
    )
