"""Catalog joins, facets, summaries, sorting and paging.

Aggregates over listings run before the join to the product table: a product
with a huge number of listings shrinks to one row per store inside the map
tasks, and the join that follows has one row per product on either side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.money import discount_pct
from ..sources.tables import Tables
from .current import current_prices
from .parts import parts_of, sorted_rows


@dataclass(frozen=True)
class ProductFilter:
    """Filters of a product query; all given ones must hold, before grouping."""

    store: str | None = None
    category: str | None = None
    brand: str | None = None
    barcode: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    multi_store: bool = False


# --- joins ------------------------------------------------------------------


def with_dimensions(products: DataFrame, tables: Tables) -> DataFrame:
    """Products with their brand and category, where they have one."""
    brands = tables.brands.select(
        "brand_id", F.col("slug").alias("brand_slug"), F.col("name").alias("brand_name")
    )
    categories = tables.categories.select(
        "category_id",
        F.col("slug").alias("category_slug"),
        F.col("name").alias("category_name"),
        F.col("parent_id").alias("category_parent_id"),
    )
    return products.join(brands, "brand_id", "left").join(categories, "category_id", "left")


def by_store_slug(df: DataFrame, stores: DataFrame, slug: str) -> DataFrame:
    """Rows of the store with this slug."""
    return df.join(stores.filter(F.col("slug") == slug).select("store_id"), "store_id", "left_semi")


def priced_listings(tables: Tables) -> DataFrame:
    """Listing keys with the current price, no text columns."""
    return tables.listing_keys.join(current_prices(tables.prices), "listing_id")


def product_star(tables: Tables, filters: ProductFilter | None = None) -> DataFrame:
    """Product x listing x current price rows with brand and category."""
    f = filters or ProductFilter()
    offers = filter_offers(priced_listings(tables), tables.stores, f)
    products = filter_catalog(with_dimensions(tables.products, tables), f)
    return offers.filter(F.col("product_id").isNotNull()).join(products, "product_id")


def listing_prices(tables: Tables) -> DataFrame:
    """Current price of every listing with its store and link."""
    stores = tables.stores.select(
        "store_id",
        F.col("slug").alias("store_slug"),
        F.col("name").alias("store_name"),
        F.col("country_code").alias("store_country"),
        F.col("website").alias("store_website"),
        F.col("active").alias("store_active"),
    )
    listings = tables.listings.select("listing_id", "store_id", "product_id", "url")
    return listings.join(stores, "store_id").join(current_prices(tables.prices), "listing_id")


def observations(tables: Tables) -> DataFrame:
    """Every price observation with product and store."""
    stores = tables.stores.select("store_id", F.col("slug").alias("store_slug"))
    return tables.prices.join(tables.listing_keys, "listing_id").join(stores, "store_id")


def exported_prices(tables: Tables) -> DataFrame:
    """The positive current prices: one row per listing that a catalog shows."""
    return current_prices(tables.prices).filter(F.col("price") > 0)


def export_rows(tables: Tables, prices: DataFrame | None = None) -> DataFrame:
    """One row per listing with a positive current price, ready for the catalog file.

    Given ``prices`` are ``exported_prices`` with further columns by listing, which are
    carried on: they meet the listings in the exchange of the prices.
    """
    listings = tables.listings.select(
        "listing_id", "store_id", "product_id", "title", "url", "image_url", "store_category_path"
    )
    stores = tables.stores.select(
        "store_id", F.col("slug").alias("store"), F.col("name").alias("store_name")
    )
    products = with_dimensions(tables.products, tables).select(
        "product_id", "barcode", "quantity", "unit", "brand_name", "category_name",
        F.col("name").alias("product_name"), F.col("image_url").alias("product_image"),
    )
    shown = exported_prices(tables)
    more = [] if prices is None else [c for c in prices.columns if c not in shown.columns]
    # the names of the stores come last, when the rows have crossed the network
    return (
        listings.join(shown if prices is None else prices, "listing_id")
        .join(products, "product_id", "left")
        .join(stores, "store_id")
        .select(
            "listing_id", "store", "store_name",
            prefer(F.col("product_name"), F.col("title")).alias("title"),
            "price", "list_price", "currency", "available",
            prefer(F.col("image_url"), F.col("product_image")).alias("img"),
            "url",
            display_category(F.col("category_name"), F.col("store_category_path")).alias("category"),
            "barcode", "quantity", "unit",
            F.col("brand_name").alias("brand"),
            "captured_at",
            *more,
        )
    )


def prefer(first: Column, second: Column) -> Column:
    return F.coalesce(first, second)


def display_category(name: Column, path: Column) -> Column:
    """Category name, else first segment of the store's path, else the catch-all."""
    return F.coalesce(name, F.split_part(path, F.lit("/"), F.lit(1)), F.lit(lx.OTHER_CATEGORY))


def brand_products(tables: Tables) -> DataFrame:
    return tables.brands.join(tables.products.select("product_id", "brand_id"), "brand_id")


def category_products(tables: Tables) -> DataFrame:
    return tables.categories.join(
        tables.products.select("product_id", "category_id"), "category_id", "left"
    )


def runs_with_store(tables: Tables) -> DataFrame:
    stores = tables.stores.select("store_id", F.col("slug").alias("store_slug"))
    return tables.runs.join(stores, "store_id")


# --- filters ----------------------------------------------------------------


def filter_offers(offers: DataFrame, stores: DataFrame, f: ProductFilter) -> DataFrame:
    """The listing side of the filters: store and price range."""
    if f.store is not None:
        offers = by_store_slug(offers, stores, f.store)
    if f.min_price is not None:
        offers = offers.filter(F.col("price") >= F.lit(f.min_price))
    if f.max_price is not None:
        offers = offers.filter(F.col("price") <= F.lit(f.max_price))
    return offers


def filter_catalog(products: DataFrame, f: ProductFilter) -> DataFrame:
    """The product side of the filters: category, brand, barcode."""
    if f.category is not None:
        products = products.filter(F.col("category_slug") == f.category)
    if f.brand is not None:
        products = products.filter(F.col("brand_slug") == f.brand)
    if f.barcode is not None:
        products = products.filter(F.col("barcode") == f.barcode)
    return products


# --- summaries --------------------------------------------------------------


def store_product_min(offers: DataFrame) -> DataFrame:
    """Lowest price of a product in a store; a store may list it several times."""
    return (
        offers.filter(F.col("product_id").isNotNull())
        .groupBy("product_id", "store_id")
        .agg(F.min("price").alias("price"), F.max("price").alias("highest"), F.count("*").alias("rows"))
    )


def offer_summary(offers: DataFrame, multi_store: bool = False) -> DataFrame:
    """Stores, lowest and highest price per product id, in two grouping steps."""
    summary = (
        store_product_min(offers)
        .groupBy("product_id")
        .agg(
            F.count("*").alias("store_count"),
            F.min("price").alias("min_price"),
            F.max("highest").alias("max_price"),
        )
    )
    return summary.filter(F.col("store_count") > 1) if multi_store else summary


def product_summary(tables: Tables, filters: ProductFilter | None = None, offers: DataFrame | None = None) -> DataFrame:
    """Products with their stores and price range, filters applied before grouping.

    ``offers`` are the priced listings, where they are there already.
    """
    f = filters or ProductFilter()
    offers = filter_offers(priced_listings(tables) if offers is None else offers, tables.stores, f)
    products = filter_catalog(with_dimensions(tables.products, tables), f)
    return products.join(offer_summary(offers, f.multi_store), "product_id")


def only_multi_store(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col("store_count") > 1)


def total(df: DataFrame) -> DataFrame:
    """One row with the number of rows."""
    return df.agg(F.count("*").alias("total"))


def brand_facet(tables: Tables) -> DataFrame:
    counts = (
        tables.products.filter(F.col("brand_id").isNotNull())
        .groupBy("brand_id")
        .agg(F.count_distinct("product_id").alias("product_count"))
    )
    return tables.brands.join(counts, "brand_id")


def brand_total(tables: Tables) -> DataFrame:
    return tables.products.agg(F.count_distinct("brand_id").alias("total"))


def category_facet(tables: Tables) -> DataFrame:
    """Every category with its number of products, empty ones with 0."""
    counts = tables.products.groupBy("category_id").agg(
        F.count_distinct("product_id").alias("product_count")
    )
    return tables.categories.join(counts, "category_id", "left").withColumn(
        "product_count", F.coalesce("product_count", F.lit(0))
    )


def promo_counts(catalog: DataFrame) -> DataFrame:
    """Products and promotions of every store of a catalog."""
    return catalog.groupBy("store").agg(
        F.count("*").alias("products"),
        F.count_if(F.col("list_price").isNotNull()).alias("promotions"),
    )


def store_facet(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("store").agg(F.count("*").alias("products"))


# --- order and paging -------------------------------------------------------

# sort mode -> (column, ascending)
SORT_MODES = {
    "name": [("name", True)],
    "price_asc": [("min_price", True)],
    "price_desc": [("min_price", False)],
    "stores": [("store_count", False), ("name", True)],
}


def sort_products(df: DataFrame, mode: str = "name") -> DataFrame:
    """Sorted with the product id as last key, so that pages do not overlap."""
    keys = [*SORT_MODES.get(mode, SORT_MODES["name"]), ("product_id", True)]
    return df.orderBy([name for name, _ in keys], ascending=[up for _, up in keys])


def page(df: DataFrame, limit: int = lx.PAGE_LIMIT_DEFAULT, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= lx.PAGE_LIMIT_MAX:
        raise ValueError(f"limit must lie in 1..{lx.PAGE_LIMIT_MAX}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def _behind(name: str, up: bool, value) -> Column:
    """Rows that come after a value in Spark's order: nulls first going up, last going down."""
    column = F.col(name)
    if up:
        return column.isNotNull() if value is None else F.coalesce(column > F.lit(value), F.lit(False))
    return F.lit(False) if value is None else column.isNull() | (column < F.lit(value))


def page_after(df: DataFrame, last: dict, mode: str = "name", limit: int = lx.PAGE_LIMIT_DEFAULT) -> DataFrame:
    """The page that follows the row ``last`` (a mapping of the sort keys, such as the last
    row of the page before). What lies before it is filtered out and never sorted, so
    a deep page costs no more than the second one."""
    if not 1 <= limit <= lx.PAGE_LIMIT_MAX:
        raise ValueError(f"limit must lie in 1..{lx.PAGE_LIMIT_MAX}")
    keys = [*SORT_MODES.get(mode, SORT_MODES["name"]), ("product_id", True)]
    after, same = F.lit(False), F.lit(True)
    for name, up in keys:
        after = after | (same & _behind(name, up, last[name]))
        same = same & F.col(name).eqNullSafe(F.lit(last[name]))
    return sort_products(df.filter(after), mode).limit(limit)


def top_brands(facet: DataFrame, limit: int = lx.BRAND_LIMIT_DEFAULT, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= lx.BRAND_LIMIT_MAX:
        raise ValueError(f"limit must lie in 1..{lx.BRAND_LIMIT_MAX}")
    ordered = facet.orderBy(F.desc("product_count"), F.asc("name"), F.asc("brand_id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def order_by_name(df: DataFrame) -> DataFrame:
    return df.orderBy("name")


# --- shaping ----------------------------------------------------------------


def nest(df: DataFrame, prefix: str, fields: list[str]) -> DataFrame:
    """Columns ``prefix_*`` as one struct, NULL where the id is."""
    names = [f"{prefix}_{f}" for f in fields]
    inner = F.struct(*[F.col(n).alias(f) for n, f in zip(names, fields)])
    return df.withColumn(prefix, F.when(F.col(names[0]).isNotNull(), inner)).drop(*names)


PRICE_ORDER = ["price", "store_slug", "url", "listing_id"]


def sorted_prices(rows: DataFrame) -> DataFrame:
    """The prices of every product ascending, written once; they can be read for more."""
    linked = rows.filter(F.col("product_id").isNotNull()).select(
        "product_id", *[c for c in ("store_id",) if c in rows.columns], *PRICE_ORDER, "list_price", "available",
    )
    return sorted_rows(linked, ["product_id"], PRICE_ORDER)


def prices_array(rows: DataFrame, most: int = 1_000) -> DataFrame:
    """(product_id, part, prices[], listings): every listing's price, ascending.

    Products come in arrays of ``most`` prices, numbered from 1; ``listings`` counts
    those of the part. Rows of ``sorted_prices`` are taken as they lie.
    """
    placed = rows if "_row" in rows.columns else sorted_prices(rows)
    discount = discount_pct(F.col("price"), F.col("list_price")).alias("discount_pct")
    value = ["price", "store_slug", "list_price", discount, "available", "url", "listing_id"]
    parts = parts_of(placed, ["product_id"], value, most, "prices")
    return parts.withColumn("listings", F.size("prices").cast("bigint"))


def side_by_side(
    catalog: DataFrame, ids: list[str], most: int = lx.COMPARE_MAX_LISTINGS
) -> DataFrame:
    """The first ``most`` distinct chosen listings, in the order they were chosen."""
    chosen = list(dict.fromkeys(ids))[:most]
    place = F.array_position(F.array(*[F.lit(i) for i in chosen]), F.col("id"))
    return catalog.filter(F.col("id").isin(chosen)).withColumn("place", place.cast("int"))


def newest_runs(runs: DataFrame, limit: int = lx.RUN_LIMIT_DEFAULT) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def last_finished_run(runs: DataFrame) -> DataFrame:
    return (
        runs.filter(F.col("finished_at").isNotNull())
        .orderBy(F.desc("finished_at"), F.desc("run_id"))
        .limit(1)
    )
