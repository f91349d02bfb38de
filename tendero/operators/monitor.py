"""Health of catalog and ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..sources.tables import Tables
from .catalog import by_store_slug, last_finished_run, newest_runs, order_by_name, runs_with_store


def runs(tables: Tables, store: str | None = None, limit: int = lx.RUN_LIMIT_DEFAULT) -> DataFrame:
    """Newest runs, of one store or all."""
    rows = runs_with_store(tables)
    if store is not None:
        rows = rows.filter(F.col("store_slug") == store)
    return newest_runs(rows, limit)


def catalog_counts(tables: Tables) -> DataFrame:
    """One row of counts. Each table is counted by itself; the counts are stacked
    and turned into columns, so no table meets another."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    linked = tables.listing_keys.filter(F.col("product_id").isNotNull())
    stores_of = linked.groupBy("product_id", "store_id").agg(F.lit(1).alias("x"))
    multi = stores_of.groupBy("product_id").agg(F.count("*").alias("s")).filter(F.col("s") > 1)
    parts = {
        "stores": tables.stores.filter("active"),
        "products": tables.products,
        "store_products": tables.listing_keys,
        "prices": tables.prices,
        "products_multi_store": multi,
        "needs_review": tables.listings.filter("needs_review"),
    }
    stacked = None
    for name, df in parts.items():
        part = one(df, name)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.agg(
        *[F.sum(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in parts]
    )


def catalog_stats(tables: Tables) -> DataFrame:
    """The counts with the last finished run."""
    last = last_finished_run(runs_with_store(tables)).select(
        F.struct("store_slug", "status", "finished_at", "products_found").alias("last_ingest")
    )
    counts = catalog_counts(tables)
    stacked = counts.withColumn("last_ingest", F.lit(None).cast(last.schema[0].dataType)).unionByName(
        last, allowMissingColumns=True
    )
    return stacked.agg(
        *[F.max(c).alias(c) for c in counts.columns], F.any_value("last_ingest", True).alias("last_ingest")
    )


def suspicious_runs(rows: DataFrame) -> DataFrame:
    """A completed run without products is as suspicious as a failed one."""
    empty = (F.col("status") == "completed") & (F.col("products_found") == 0)
    return rows.withColumn("suspicious", (F.col("status") == "failed") | empty)


def freshness(
    stores: DataFrame, rows: DataFrame, as_of: Column, minutes: int = lx.REFRESH_MINUTES
) -> DataFrame:
    """Last good run per store and whether the next one is due; never run is due."""
    last = (
        rows.filter(F.col("status") == "completed")
        .groupBy("store_id")
        .agg(F.max("finished_at").alias("last_run_at"))
    )
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return stores.join(last, "store_id", "left").select(
        "slug",
        "last_run_at",
        F.coalesce(F.col("last_run_at") + step, as_of).alias("next_run_at"),
        F.coalesce(as_of - F.col("last_run_at") >= step, F.lit(True)).alias("due"),
    )


def export_manifest(
    catalog: DataFrame, source: str, as_of: Column, ttl: int = lx.CACHE_TTL_MINUTES
) -> DataFrame:
    """One row about an export: when, from what, how much, and until when it is fresh."""
    return catalog.agg(F.count("*").alias("product_count")).select(
        as_of.alias("generated_at"),
        F.lit(source).alias("source"),
        "product_count",
        F.lit(ttl).alias("ttl_minutes"),
        (as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(ttl))).alias("next_refresh_at"),
    )


def stores(tables: Tables, active_only: bool = True) -> DataFrame:
    rows = tables.stores.filter("active") if active_only else tables.stores
    return order_by_name(rows)


def store(tables: Tables, slug: str) -> DataFrame:
    return tables.stores.filter(F.col("slug") == slug)
