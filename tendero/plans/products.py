"""Product queries: listing, detail, prices, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.money import discount_pct
from ..operators.catalog import (
    ProductFilter,
    listing_prices,
    nest,
    page,
    prices_array,
    product_summary,
    sort_products,
    sorted_prices,
    total,
)
from ..sources.tables import Tables


def products(
    tables: Tables, filters: ProductFilter | None = None, sort: str = "name",
    limit: int = lx.PAGE_LIMIT_DEFAULT, offset: int = 0,
) -> DataFrame:
    """One page of the product list."""
    return page(sort_products(product_summary(tables, filters), sort), limit, offset)


def products_total(tables: Tables, filters: ProductFilter | None = None) -> DataFrame:
    """Number of products the same filters leave."""
    return total(product_summary(tables, filters))


def shaped(summary: DataFrame) -> DataFrame:
    """Product rows with brand and category nested."""
    rows = nest(summary, "brand", ["id", "slug", "name"])
    return nest(rows, "category", ["id", "slug", "name", "parent_id"])


def product_prices(tables: Tables) -> DataFrame:
    """Current price of every linked listing with its discount."""
    return (
        listing_prices(tables)
        .filter(F.col("product_id").isNotNull())
        .withColumn("discount_pct", discount_pct(F.col("price"), F.col("list_price")))
    )


def product_detail(tables: Tables, most: int = 1_000) -> DataFrame:
    """Every priced product with all its prices ascending, in parts of ``most``.

    The first part has the ``cheapest`` offer. The summary reads the sorted prices, so
    that listings and current prices meet once.
    """
    placed = sorted_prices(listing_prices(tables))
    arrays = prices_array(placed, most)
    cheapest = F.when(F.col("part") == 1, F.get("prices", F.lit(0)))
    return product_summary(tables, offers=placed).join(arrays, "product_id").withColumn("cheapest", cheapest)


def compare_products(tables: Tables) -> DataFrame:
    """Per product the cheapest and the dearest offer and what lies between them."""
    offer = F.struct("price", "store_slug", "listing_id")
    names = tables.products.select("product_id", "name", "barcode")
    # grouped by (product, store) first: a product with very many listings is
    # reduced to its stores before one task sees all of it
    per_store = (
        listing_prices(tables)
        .filter(F.col("product_id").isNotNull())
        .groupBy("product_id", "store_slug")
        .agg(F.min(offer).alias("low"), F.max(offer).alias("high"), F.count("*").alias("n"))
    )
    grouped = per_store.groupBy("product_id").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("n").alias("listings_compared"),
        F.count("*").alias("stores_compared"),
    )
    saving = F.col("high.price") - F.col("low.price")
    return names.join(grouped, "product_id").select(
        "product_id", "name", "barcode",
        F.col("low.store_slug").alias("cheapest_store"),
        F.col("low.price").alias("cheapest_price"),
        F.col("high.store_slug").alias("dearest_store"),
        F.col("high.price").alias("dearest_price"),
        F.when(saving > 0, saving).cast("decimal(18,2)").alias("saving"),
        "listings_compared", "stores_compared",
    )


def store_catalog(tables: Tables, slug: str, **paging) -> DataFrame:
    return products(tables, ProductFilter(store=slug), **paging)
