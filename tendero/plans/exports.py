"""Assembled catalogs: from snapshot files and from the tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.dates import holiday_calendar
from ..functions.money import clean_list_price
from ..operators.catalog import export_rows, exported_prices
from ..operators.current import daily_last_by_snapshot, first_by_url, lookback, valid_snapshot_rows
from ..operators.discount import pricing_context
from ..operators.history import attach_history, collect_history, history_array
from ..sources.files import chosen_files, latest_snapshots, newest_snapshots, priced_lines, scan_files
from ..sources.tables import Tables

SNAPSHOT_KEYS = ["snapshot_store", "url", "name"]


def first_products(newest: DataFrame) -> DataFrame:
    """Catalog rows of the lines of newest snapshots: valid, first per link."""
    lines = first_by_url(valid_snapshot_rows(newest))
    store = F.trim(F.coalesce("store", F.lit("")))
    return lines.select(
        tx.stable_id(store, "url").alias("id"),
        F.col("name").alias("title"),
        store.alias("store"),
        F.trim(F.coalesce(F.nullif("store_name", F.lit("")), "store", F.lit(""))).alias("store_name"),
        tx.title_case("category").alias("category"),
        "price",
        clean_list_price(F.col("price"), F.col("list_price")).alias("list_price"),
        F.col("image_url").alias("img"),
        "url",
        "scraped_date",
        "name",
        "snapshot_store",
    )


def snapshot_products(rows: DataFrame) -> DataFrame:
    """Catalog rows of the newest snapshot per store."""
    return first_products(latest_snapshots(rows, 1))


def line_history(lines: DataFrame) -> DataFrame:
    """Daily history per (store, link, name) over the given snapshot lines."""
    return collect_history(daily_last_by_snapshot(lines), SNAPSHOT_KEYS)


def snapshot_history(rows: DataFrame, n: int = lx.HISTORY_SNAPSHOTS) -> DataFrame:
    """Daily history per (store, link, name) over the newest n snapshots."""
    return line_history(latest_snapshots(rows, n))


def _file_catalog(products: DataFrame, history: DataFrame, years: DataFrame, matches: DataFrame) -> DataFrame:
    """``years`` are those of the snapshots that the histories come from."""
    with_history = attach_history(products, history, SNAPSHOT_KEYS)
    return pricing_context(with_history, matches, holiday_calendar(years)).drop("name", "snapshot_store")


def snapshot_catalog(rows: DataFrame, matches: DataFrame, n: int = lx.HISTORY_SNAPSHOTS) -> DataFrame:
    """The catalog of the file path, from scanned lines."""
    # the histories lie in the days of these snapshots; their list is there already
    years = newest_snapshots(rows, n).select(F.year("snapshot_ts").alias("year")).filter(F.col("year").isNotNull())
    return _file_catalog(snapshot_products(rows), snapshot_history(rows, n), years, matches)


def snapshot_folder_catalog(
    spark: SparkSession, path: str | list[str], matches: DataFrame, n: int = lx.HISTORY_SNAPSHOTS
) -> DataFrame:
    """The catalog of the file path, from a folder of snapshots: the newest one per store
    is read for the products and the newest n for the histories, older ones never."""
    chosen = chosen_files(spark, path, n)
    newest = scan_files(spark, path, [r.path for r in chosen if r.place == 1])
    lines = scan_files(spark, path, [r.path for r in chosen])
    days = sorted({r.snapshot_ts.year for r in chosen if r.snapshot_ts})
    years = spark.range(1).select(F.explode(F.lit(days).cast("array<int>")).alias("year"))
    return _file_catalog(first_products(priced_lines(newest)), line_history(priced_lines(lines)), years, matches)


def table_catalog(
    tables: Tables, matches: DataFrame, as_of: date | datetime, days: int = lx.HISTORY_DAYS
) -> DataFrame:
    """The catalog of the table path, with the history of the days up to ``as_of``.

    Observations after ``as_of`` count too; the calendar has the years of the points.
    """
    prices = attach_history(exported_prices(tables), history_array(tables, as_of, days), ["listing_id"])
    with_history = export_rows(tables, prices).select(
        tx.stable_id("store", "url").alias("id"),
        "title", "store", "store_name", "category", "price",
        clean_list_price(F.col("price"), F.col("list_price")).alias("list_price"),
        "img", "url", "barcode", "brand",
        F.to_date("captured_at").alias("scraped_date"),
        "history",
    )
    years = lookback(tables.prices, as_of, days).select(F.year("captured_at").alias("year"))
    return pricing_context(with_history, matches, holiday_calendar(years))
