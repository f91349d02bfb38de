"""Current prices, filters, joins, facets, paging and product comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import clean_list_price, discount_pct, has_discount
from ..operators import catalog as cat
from ..operators import current as cur
from ..operators.catalog import ProductFilter
from ..plans import exports, products as plans
from ..sources.layout import BucketedTables, buckets_of, write_by_listing
from .base import ORACLES, pct, query
from .staging import staged

PRODUCT = ["product_id", "name", "brand_slug", "category_slug", "store_count", "min_price", "max_price"]


def summary_sql(where: str = "true", having: str = "true", tail: str = "") -> str:
    return f"""
        SELECT product_id, any_value(name) AS name, any_value(brand_slug) AS brand_slug,
               any_value(category_slug) AS category_slug, count(DISTINCT store_id) AS store_count,
               min(price) AS min_price, max(price) AS max_price
        FROM star WHERE {where} GROUP BY product_id HAVING {having} {tail}"""


@query(
    "d1_current_prices",
    "SELECT listing_id, price_id, price, list_price, available, CAST(captured_at AS DATE) AS day FROM current_prices",
    "current_prices",
)
def _(t):
    return cur.current_prices(t.prices).select(
        "listing_id", "price_id", "price", "list_price", "available", F.to_date("captured_at").alias("day")
    )


D2 = {
    "store": (ProductFilter(store="nation_9"), "store_id = (SELECT store_id FROM stores WHERE slug = 'nation_9')"),
    "category": (ProductFilter(category="economy/brand-2"), "category_slug = 'economy/brand-2'"),
    "brand": (ProductFilter(brand="brand-7"), "brand_slug = 'brand-7'"),
    "barcode": (ProductFilter(barcode="7700000000100"), "barcode = '7700000000100'"),
    "price_range": (ProductFilter(min_price=900, max_price=2000), "price BETWEEN 900 AND 2000"),
    "all": (
        ProductFilter(store="nation_9", brand="brand-7", min_price=500, max_price=90000),
        "store_id = (SELECT store_id FROM stores WHERE slug = 'nation_9') AND brand_slug = 'brand-7' AND price BETWEEN 500 AND 90000",
    ),
}
for _name, (_filter, _where) in D2.items():

    @query(f"d2_products_by_{_name}", summary_sql(_where), "star", "stores")
    def _(t, f=_filter):
        return cat.product_summary(t, f).select(*PRODUCT)


@query("d3_multi_store_products", summary_sql(having="count(DISTINCT store_id) > 1"), "star")
def _(t):
    return cat.only_multi_store(cat.product_summary(t)).select(*PRODUCT)


@query(
    "d4_first_by_sku",
    """SELECT store_slug, sku, category, line FROM (
           SELECT store AS store_slug, url AS sku, category, price AS line,
                  row_number() OVER (PARTITION BY store, url ORDER BY category, line_order) AS rn
           FROM snapshot_rows WHERE url <> '') WHERE rn = 1""",
    "snapshot_rows",
)
def _(t):
    rows = t.snapshot_rows.filter("url <> ''").select(
        F.col("store").alias("store_slug"), F.col("url").alias("sku"), "category",
        F.col("price").alias("line"), "line_order",
    )
    return cur.first_by_sku(rows, [F.asc("category"), F.asc("line_order")]).drop("line_order")


@query(
    "d5_first_by_url",
    """SELECT snapshot_store, snapshot_day, url, name, price FROM (
           SELECT *, row_number() OVER (PARTITION BY snapshot_store, snapshot_day, url ORDER BY line_order) AS rn
           FROM snapshot_rows WHERE name <> '' AND price IS NOT NULL AND url <> '') WHERE rn = 1""",
    "snapshot_rows",
)
def _(t):
    return cur.first_by_url(cur.valid_snapshot_rows(t.snapshot_rows)).select(
        "snapshot_store", "snapshot_day", "url", "name", "price"
    )


@query(
    "d6_category_sightings",
    """SELECT snapshot_store, category, count(*) AS visible, count(DISTINCT url) AS new
       FROM snapshot_rows GROUP BY ALL""",
    "snapshot_rows",
)
def _(t):
    return cur.category_sightings(t.snapshot_rows)


@query(
    "d7_restrict_to_lists",
    """SELECT listing_id, product_id, store_id FROM listings
       WHERE product_id IN (SELECT product_id FROM products WHERE quantity > 40)
         AND store_id IN (SELECT store_id FROM stores WHERE active)""",
    "listings", "products",
)
def _(t):
    ids = t.products.filter("quantity > 40").select("product_id")
    return cur.restrict(t.listing_keys, ids, t.stores.filter("active").select("store_id")).select(
        "listing_id", "product_id", "store_id"
    )


@query(
    "d8_between_dates",
    """SELECT listing_id, price_id, price FROM prices
       WHERE captured_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'""",
    "prices",
)
def _(t):
    return cur.between_dates(t.prices, "1996-01-01", "1997-06-30").select("listing_id", "price_id", "price")


@query(
    "d9_lookback",
    """SELECT listing_id, price_id, price FROM prices
       WHERE captured_at >= TIMESTAMP '2001-11-05' - INTERVAL 30 DAY""",
    "prices",
)
def _(t):
    return cur.lookback(t.prices, "2001-11-05", 30).select("listing_id", "price_id", "price")


@query(
    "d10_row_predicates",
    """SELECT count(*) FILTER (price > 0) AS positive, count(*) FILTER (available) AS available,
              count(*) FILTER (list_price IS NOT NULL) AS promoted FROM prices""",
    "prices",
)
def _(t):
    return t.prices.agg(
        F.count_if(F.col("price") > 0).alias("positive"),
        F.count_if("available").alias("available"),
        F.count_if(F.col("list_price").isNotNull()).alias("promoted"),
    )


@query(
    "d11_title_contains",
    """SELECT listing_id, title FROM listings
       WHERE contains(lower(title), 'red w') AND store_id = (SELECT store_id FROM stores WHERE slug = 'nation_9')""",
    "listings", "stores",
)
def _(t):
    from ..functions.text import title_contains

    rows = cat.by_store_slug(t.listings, t.stores, "nation_9")
    return rows.filter(title_contains("title", "Red W")).select("listing_id", "title")


@query(
    "e1_product_star",
    "SELECT product_id, listing_id, store_id, name, brand_slug, category_slug, price, list_price FROM star",
    "star",
)
def _(t):
    return cat.product_star(t).select(
        "product_id", "listing_id", "store_id", "name", "brand_slug", "category_slug", "price", "list_price"
    )


@query(
    "e2_listing_prices",
    "SELECT listing_id, product_id, store_slug, store_name, store_website, store_active, price, available, url FROM listing_prices",
    "listing_prices",
)
def _(t):
    return cat.listing_prices(t).select(
        "listing_id", "product_id", "store_slug", "store_name", "store_website", "store_active", "price",
        "available", "url",
    )


@query(
    "e3_observations",
    """SELECT p.listing_id, product_id, slug AS store_slug, price_id, price FROM prices p
       JOIN listings l USING (listing_id) JOIN stores USING (store_id)""",
    "prices", "listings",
)
def _(t):
    return cat.observations(t).select("listing_id", "product_id", "store_slug", "price_id", "price")


BUCKETS = 16  # at least; more where a bucket would hold more than so many prices
BUCKET_ROWS = 250_000


def by_listing(t) -> BucketedTables:
    """The tables in buckets by listing, in a database named after their folder."""

    def name_of(path: str) -> str:
        return path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")

    def write(path: str) -> None:
        write_by_listing(t, name_of(path), path, buckets_of(t.prices, BUCKETS, BUCKET_ROWS))

    path = staged(t, "by-listing", write)
    return BucketedTables(t.spark, name_of(path))


@query("d1_bucketed_current_prices", ORACLES["d1_current_prices"])
def _(t):
    """As d1_current_prices, without an exchange."""
    return cur.current_prices(by_listing(t).prices).select(
        "listing_id", "price_id", "price", "list_price", "available", F.to_date("captured_at").alias("day")
    )


@query("e2_bucketed_listing_prices", ORACLES["e2_listing_prices"])
def _(t):
    """As e2_listing_prices, without an exchange by listing."""
    return cat.listing_prices(by_listing(t)).select(
        "listing_id", "product_id", "store_slug", "store_name", "store_website", "store_active", "price",
        "available", "url",
    )


@query("e3_bucketed_observations", ORACLES["e3_observations"])
def _(t):
    """As e3_observations, without an exchange."""
    return cat.observations(by_listing(t)).select("listing_id", "product_id", "store_slug", "price_id", "price")


@query(
    "e5_export_rows",
    "SELECT * EXCLUDE (captured_at), CAST(captured_at AS DATE) AS day FROM export_rows",
    "export_rows",
)
def _(t):
    return cat.export_rows(t).withColumn("day", F.to_date("captured_at")).drop("captured_at")


@query(
    "e6_brand_and_category_products",
    """SELECT 'brand' AS kind, slug, count(product_id) AS n FROM brands JOIN products USING (brand_id) GROUP BY slug
       UNION ALL
       SELECT 'category', slug, count(product_id) FROM categories LEFT JOIN products USING (category_id) GROUP BY slug""",
    "brands", "categories", "products",
)
def _(t):
    count = F.count("product_id").alias("n")
    brands = cat.brand_products(t).groupBy(F.lit("brand").alias("kind"), "slug").agg(count)
    return brands.unionByName(
        cat.category_products(t).groupBy(F.lit("category").alias("kind"), "slug").agg(count)
    )


@query(
    "e7_runs_with_store",
    "SELECT run_id, slug AS store_slug, status, products_found FROM runs JOIN stores USING (store_id)",
    "runs", "stores",
)
def _(t):
    return cat.runs_with_store(t).select("run_id", "store_slug", "status", "products_found")


@query(
    "e10_by_store_slug",
    "SELECT listing_id FROM listings WHERE store_id = (SELECT store_id FROM stores WHERE slug = 'nation_9')",
    "listings",
)
def _(t):
    return cat.by_store_slug(t.listing_keys, t.stores, "nation_9").select("listing_id")


@query("f1_product_summary", summary_sql(), "star")
def _(t):
    return cat.product_summary(t).select(*PRODUCT)


@query(
    "f2_brand_facet",
    """SELECT slug, b.name AS name, count(DISTINCT product_id) AS product_count
       FROM brands b JOIN products USING (brand_id) GROUP BY slug, b.name""",
    "brands", "products",
)
def _(t):
    return cat.brand_facet(t).select("slug", "name", "product_count")


@query("f2_brand_total", "SELECT count(DISTINCT brand_id) AS total FROM products", "products")
def _(t):
    return cat.brand_total(t)


@query(
    "f3_category_facet",
    """SELECT slug, any_value(c.name) AS name, count(DISTINCT product_id) AS product_count
       FROM categories c LEFT JOIN products USING (category_id) GROUP BY slug""",
    "categories", "products",
)
def _(t):
    return cat.category_facet(t).select("slug", "name", "product_count")


@query(
    "f4_filtered_total",
    f"SELECT count(*) AS total FROM ({summary_sql('price >= 2000', 'count(DISTINCT store_id) > 1')})",
    "star",
)
def _(t):
    return plans.products_total(t, ProductFilter(min_price=2000, multi_store=True))


@query(
    "f10_promo_counts",
    """SELECT store, count(*) AS products, count(*) FILTER (list_price > price) AS promotions
       FROM export_rows GROUP BY store""",
    "export_rows",
)
def _(t):
    rows = cat.export_rows(t)
    return cat.promo_counts(
        rows.withColumn("list_price", clean_list_price(F.col("price"), F.col("list_price")))
    )


@query("f11_store_facet", "SELECT store, count(*) AS products FROM export_rows GROUP BY store", "export_rows")
def _(t):
    return cat.store_facet(cat.export_rows(t))


@query(
    "f13_store_product_min",
    """SELECT product_id, store_id, min(price) AS price, max(price) AS highest, count(*) AS rows
       FROM listings JOIN current_prices USING (listing_id) WHERE product_id IS NOT NULL
       GROUP BY product_id, store_id""",
    "listings", "current_prices",
)
def _(t):
    return cat.store_product_min(cat.priced_listings(t))


ORDERS = {
    "name": "name, product_id",
    "price_asc": "min_price, product_id",
    "price_desc": "min_price DESC, product_id",
    "stores": "store_count DESC, name, product_id",
}
for _mode, _order in ORDERS.items():

    @query(f"g1_sort_{_mode}", summary_sql(tail=f"ORDER BY {_order} LIMIT 50"), "star")
    def _(t, mode=_mode):
        return cat.page(cat.sort_products(cat.product_summary(t), mode)).select(*PRODUCT)


@query("g2_page", summary_sql(tail="ORDER BY name, product_id LIMIT 20 OFFSET 40"), "star")
def _(t):
    return cat.page(cat.sort_products(cat.product_summary(t)), 20, 40).select(*PRODUCT)


@query("g2_page_after_key", summary_sql(tail="ORDER BY name, product_id LIMIT 20 OFFSET 40"), "star")
def _(t):
    """As g2_page, by the last key of the page before."""
    summary = cat.product_summary(t)
    last = cat.page(cat.sort_products(summary.select("name", "product_id")), 40).collect()[-1]
    return cat.page_after(summary, last.asDict(), "name", 20).select(*PRODUCT)


@query(
    "g3_top_brands",
    """SELECT slug, b.name AS name, count(DISTINCT product_id) AS product_count
       FROM brands b JOIN products USING (brand_id) GROUP BY slug, b.name, brand_id
       ORDER BY product_count DESC, b.name, brand_id LIMIT 10""",
    "brands", "products",
)
def _(t):
    return cat.top_brands(cat.brand_facet(t), 10).select("slug", "name", "product_count")


@query(
    "g4_latest_runs",
    """SELECT * FROM (SELECT run_id, 'latest' AS kind FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 50)
       UNION ALL
       SELECT * FROM (SELECT run_id, 'finished' FROM runs WHERE finished_at IS NOT NULL
                      ORDER BY finished_at DESC, run_id DESC LIMIT 1)""",
    "runs",
)
def _(t):
    latest = cat.newest_runs(t.runs).select("run_id", F.lit("latest").alias("kind"))
    return latest.unionByName(cat.last_finished_run(t.runs).select("run_id", F.lit("finished").alias("kind")))


@query(
    "g8_prices_array",
    """SELECT product_id, CAST((rn - 1) // 10 + 1 AS INT) AS part,
              string_agg(price || '@' || store_slug || '=' || url, ' ' ORDER BY rn) AS prices, count(*) AS listings
       FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, store_slug, url, listing_id) AS rn
             FROM listing_prices WHERE product_id IS NOT NULL)
       GROUP BY ALL""",
    "listing_prices",
)
def _(t):
    text = F.transform(
        "prices", lambda p: F.concat(p["price"].cast("string"), F.lit("@"), p["store_slug"], F.lit("="), p["url"])
    )
    return cat.prices_array(cat.listing_prices(t), 10).select(
        "product_id", "part", F.array_join(text, " ").alias("prices"), "listings"
    )


@query(
    "g9_order_by_name",
    """SELECT 'store' AS kind, slug, name FROM stores UNION ALL SELECT 'category', slug, name FROM categories""",
    "stores", "categories",
)
def _(t):
    stores = t.stores.select(F.lit("store").alias("kind"), "slug", "name")
    return cat.order_by_name(stores.unionByName(t.categories.select(F.lit("category").alias("kind"), "slug", "name")))


@query(
    "k1_products",
    summary_sql("price >= 1000", "count(DISTINCT store_id) > 1", "ORDER BY store_count DESC, name, product_id LIMIT 50"),
    "star",
)
def _(t):
    return plans.products(t, ProductFilter(min_price=1000, multi_store=True), "stores").select(*PRODUCT)


@query(
    "k2_product_detail",
    """SELECT product_id, part, prices, cheapest_price, cheapest_store, store_count FROM (
           SELECT product_id, CAST((rn - 1) // 10 + 1 AS INT) AS part, string_agg(price || '@' || store_slug, ' ' ORDER BY rn) AS prices,
                  min(price) FILTER (rn = 1) AS cheapest_price, min(store_slug) FILTER (rn = 1) AS cheapest_store
           FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, store_slug, url, listing_id) AS rn
                 FROM listing_prices JOIN products USING (product_id)) GROUP BY ALL)
       JOIN (SELECT product_id, count(DISTINCT store_id) AS store_count FROM listing_prices GROUP BY product_id) USING (product_id)""",
    "listing_prices", "products",
)
def _(t):
    text = F.transform("prices", lambda p: F.concat(p["price"].cast("string"), F.lit("@"), p["store_slug"]))
    return plans.product_detail(t, 10).select(
        "product_id", "part",
        F.array_join(text, " ").alias("prices"),
        F.col("cheapest.price").alias("cheapest_price"),
        F.col("cheapest.store_slug").alias("cheapest_store"),
        "store_count",
    )


@query(
    "k3_product_prices",
    f"""SELECT listing_id, product_id, store_slug, price, list_price,
               CASE WHEN list_price > price THEN {pct('(list_price - price)', 'list_price')} END AS discount_pct, url
        FROM listing_prices WHERE product_id IS NOT NULL""",
    "listing_prices",
)
def _(t):
    return plans.product_prices(t).select(
        "listing_id", "product_id", "store_slug", "price", "list_price", "discount_pct", "url"
    )


@query(
    "c11_c12_list_price_and_discount",
    f"""SELECT price_id, listing_id, price, list_price, list_price IS NOT NULL AS has_discount,
               CASE WHEN list_price > price THEN {pct('(list_price - price)', 'list_price')} END AS discount_pct
        FROM prices""",
    "prices",
)
def _(t):
    price, listed = F.col("price"), F.col("list_price")
    return t.prices.select(
        "price_id", "listing_id", "price",
        clean_list_price(price, listed).alias("list_price"),
        has_discount(price, listed).alias("has_discount"),
        discount_pct(price, listed).alias("discount_pct"),
    )


@query(
    "k4_compare_products",
    """SELECT product_id, any_value(name) AS name, any_value(barcode) AS barcode,
              arg_min(store_slug, (price, store_slug, listing_id)) AS cheapest_store, min(price) AS cheapest_price,
              arg_max(store_slug, (price, store_slug, listing_id)) AS dearest_store, max(price) AS dearest_price,
              CASE WHEN max(price) > min(price) THEN CAST(max(price) - min(price) AS DECIMAL(18,2)) END AS saving,
              count(*) AS listings_compared, count(DISTINCT store_slug) AS stores_compared
       FROM listing_prices JOIN products USING (product_id) GROUP BY product_id""",
    "listing_prices", "products",
)
def _(t):
    return plans.compare_products(t)


@query(
    "k5_store_catalog",
    summary_sql("store_id = (SELECT store_id FROM stores WHERE slug = 'nation_9')", tail="ORDER BY name, product_id LIMIT 50"),
    "star",
)
def _(t):
    return plans.store_catalog(t, "nation_9").select(*PRODUCT)


CHOSEN = [
    "nation_1-cd4a04a13b9b6bd2", "nation_0-2701a0b0a97ce9c6", "nation_1-cd4a04a13b9b6bd2",
    "nation_0-72a67250e98cabaf", "nation_1-68a93346aacd03d5", "nation_0-3a5592f99a23a224",
]


@query(
    "k11_side_by_side",
    f"""SELECT store || '-' || substr(sha1(url), 1, 16) AS id, title, price,
               CAST(list_position({list(dict.fromkeys(CHOSEN))[:4]}, store || '-' || substr(sha1(url), 1, 16)) AS INT) AS place
        FROM export_rows WHERE list_contains({list(dict.fromkeys(CHOSEN))[:4]}, store || '-' || substr(sha1(url), 1, 16))""",
    "export_rows",
)
def _(t):
    from ..functions.text import stable_id

    rows = cat.export_rows(t).withColumn("id", stable_id("store", "url"))
    return cat.side_by_side(rows, CHOSEN).select("id", "title", "price", "place")


@query(
    "j7_nested_product",
    """SELECT product_id, brand_slug || '/' || brand_name AS brand, category_slug || '<' || category_parent_id AS category
       FROM product_rows""",
    "product_rows",
)
def _(t):
    return plans.shaped(cat.with_dimensions(t.products, t)).select(
        "product_id",
        F.concat("brand.slug", F.lit("/"), "brand.name").alias("brand"),
        F.concat("category.slug", F.lit("<"), F.col("category.parent_id").cast("string")).alias("category"),
    )


@query(
    "c22_c23_display_values",
    """SELECT listing_id, coalesce(split_part(store_category_path, '/', 1), 'Otros') AS category,
              coalesce(l.image_url, p.image_url) AS img
       FROM listings l LEFT JOIN products p USING (product_id)""",
    "listings", "products",
)
def _(t):
    products = t.products.select("product_id", F.col("image_url").alias("product_image"))
    nameless = F.lit(None).cast("string")
    return t.listings.join(products, "product_id", "left").select(
        "listing_id",
        cat.display_category(nameless, F.col("store_category_path")).alias("category"),
        cat.prefer(F.col("image_url"), F.col("product_image")).alias("img"),
    )
