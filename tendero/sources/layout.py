"""Tables laid out by listing: prices and listings in the same buckets.

The joins and latest-of windows by listing_id then read bucket by bucket, without
an exchange of the price history. The bucket count is fixed when the tables are
written; it should be a multiple of the cores that read them, and is the same for
both, so that bucket n of one meets bucket n of the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

BY_LISTING = ("listings", "prices")
PLAIN = ("stores", "brands", "categories", "products", "runs")


class BucketedTables(Tables):
    """The normalized tables of a catalog database."""

    def __init__(self, spark: SparkSession, database: str):
        super().__init__(spark, database)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.directory}.{name}")


def buckets_of(prices: DataFrame, least: int, rows: int) -> int:
    """A number of buckets that follows the prices, a multiple of ``least``: a task sorts one
    bucket when it is written and again when it is joined, and with a fixed number
    both sorts go to disk once the table has grown."""
    return least * max(1, -(-prices.count() // (least * rows)))


def write_by_listing(tables: Tables, database: str, path: str, buckets: int) -> BucketedTables:
    """Write all tables under ``path`` and register them in ``database``.

    Rows are dealt to the buckets before they are written, so that each bucket is one
    sorted file per write and not one per task. A listing with a large share of the
    prices makes its bucket as large as its history; its rows stay in order in it.
    """
    spark = tables.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{path}'")
    for name in BY_LISTING:
        rows = getattr(tables, name).repartition(buckets, "listing_id")
        writer = rows.write.bucketBy(buckets, "listing_id").sortBy("listing_id").option("path", f"{path}/{name}")
        writer.mode("errorifexists").saveAsTable(f"{database}.{name}")
    for name in PLAIN:
        getattr(tables, name).write.option("path", f"{path}/{name}").mode("errorifexists").saveAsTable(f"{database}.{name}")
    return BucketedTables(spark, database)
