"""Relational table sets the operators work on."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import brand_slug


class Tables:
    """The normalized tables, one parquet folder each.

    ``stores(store_id, slug, name, country_code, website, active)``
    ``brands(brand_id, slug, name)``
    ``categories(category_id, parent_id, slug, name)``
    ``products(product_id, barcode, brand_id, category_id, name, normalized_name,
    quantity, unit, image_url)``
    ``listings(listing_id, store_id, product_id, sku, title, normalized_title, url,
    image_url, store_category_path, barcode, needs_review)``
    ``prices(listing_id, price_id, price, list_price, currency, available, captured_at)``
    ``runs(run_id, store_id, adapter, status, started_at, finished_at,
    products_found, products_new, prices_written, errors, notes)``
    """

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory.rstrip('/')}/{name}")

    @cached_property
    def stores(self) -> DataFrame:
        return self.read("stores")

    @cached_property
    def brands(self) -> DataFrame:
        return self.read("brands")

    @cached_property
    def categories(self) -> DataFrame:
        return self.read("categories")

    @cached_property
    def products(self) -> DataFrame:
        return self.read("products")

    @cached_property
    def listings(self) -> DataFrame:
        return self.read("listings")

    @cached_property
    def listing_keys(self) -> DataFrame:
        """Only the keys of a listing, for jobs that need no text of it."""
        return self.listings.select("listing_id", "store_id", "product_id")

    @cached_property
    def prices(self) -> DataFrame:
        return self.read("prices")

    @cached_property
    def runs(self) -> DataFrame:
        return self.read("runs")


class JdbcTables(Tables):
    """The same tables read from a database, split on a numeric column.

    ``bounds`` maps a table to ``(column, lower, upper, partitions)``; without
    bounds a table is read through one connection, so give them for the facts.
    """

    def __init__(self, spark: SparkSession, url: str, bounds: dict[str, tuple] | None = None, **options: str):
        super().__init__(spark, url)
        self.bounds, self.options = bounds or {}, options

    def read(self, name: str) -> DataFrame:
        reader = self.spark.read.format("jdbc").options(
            url=self.directory, dbtable=name, **self.options
        )
        if name in self.bounds:
            column, lower, upper, partitions = self.bounds[name]
            reader = reader.options(
                partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions
            )
        return reader.load()


class GivenTables(Tables):
    """The same tables derived from the order/part/supplier star schema.

    A store is a nation and a listing a (part, supplier) pair, so a store may
    list one product several times. Observations are line items: unit price as
    list price, discounted unit price as the price charged. Money is computed
    in whole cents.
    """

    def __init__(self, spark: SparkSession, directory: str):
        super().__init__(spark, directory)
        self._opened: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._opened:
            path = f"{self.directory.rstrip('/')}/{name}.parquet"
            df = self.spark.read.parquet(path)
            self._opened[name] = df
        return self._opened[name]

    @cached_property
    def stores(self) -> DataFrame:
        slugged = self.read("nation").withColumn("slug", tx.slugify("n_name"))
        return slugged.selectExpr(
            "n_nationkey AS store_id", "slug", "n_name AS name", "'CO' AS country_code",
            "concat('https://', slug, '.example.com') AS website", "n_regionkey != 4 AS active",
        )

    @cached_property
    def brands(self) -> DataFrame:
        names = self.read("part").select("p_brand").distinct()
        return names.withColumn("slug", tx.slugify("p_brand")).selectExpr(
            f"{BRAND_ID} AS brand_id", "slug", "p_brand AS name"
        )

    @cached_property
    def categories(self) -> DataFrame:
        """Two levels, part type over brand. Parts hang on the leaves."""
        pairs = self.read("part").select("p_type", "p_brand").distinct()
        slugged = pairs.withColumns({"top": tx.slugify("p_type"), "leaf": tx.slugify("p_brand")})
        nodes = f"""inline(array(
            struct({TYPE_ID} AS category_id, CAST(NULL AS INT) AS parent_id, top AS slug, p_type AS name),
            struct({LEAF_ID} AS category_id, {TYPE_ID} AS parent_id,
                   concat(top, '/', leaf) AS slug, p_brand AS name)))"""
        return slugged.selectExpr(nodes).distinct()

    @cached_property
    def products(self) -> DataFrame:
        normal = self.read("part").withColumn("normalized_name", tx.normalize_text("p_name"))
        return normal.selectExpr(
            "p_partkey AS product_id",
            "CASE WHEN p_partkey % 2 = 0 THEN concat('77', lpad(CAST(p_partkey AS STRING), 11, '0')) END AS barcode",
            f"{BRAND_ID} AS brand_id",
            f"{LEAF_ID} AS category_id",
            "p_name AS name",
            "normalized_name",
            "CAST(p_size AS DECIMAL(18,3)) AS quantity",
            "'ml' AS unit",
            "CASE WHEN p_partkey % 4 != 0 THEN concat('https://img.example.com/', p_partkey) END AS image_url",
        )

    @cached_property
    def _pairs(self) -> DataFrame:
        pairs = self.read("lineitem").select("l_partkey", "l_suppkey").distinct()
        suppliers = self.read("supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey AS store_id")
        return pairs.join(suppliers, "l_suppkey")

    @cached_property
    def listing_keys(self) -> DataFrame:
        return self._pairs.selectExpr(
            f"{LISTING_ID} AS listing_id", "store_id", f"{LINKED_PRODUCT} AS product_id"
        )

    @cached_property
    def listings(self) -> DataFrame:
        parts = self.read("part").selectExpr(
            "p_partkey AS l_partkey", "p_name", "p_size", "p_type", "p_brand"
        )
        stores = self.stores.select("store_id", "website")
        rows = self._pairs.join(parts, "l_partkey").join(stores, "store_id").selectExpr(
            "*",
            "concat(l_partkey, '-', l_suppkey) AS sku",
            "concat(initcap(p_name), ' (', p_size * 10, '  ML) x', l_suppkey % 12 + 1) AS title",
        )
        return rows.withColumn("normalized_title", tx.normalize_text("title")).selectExpr(
            f"{LISTING_ID} AS listing_id",
            "store_id",
            f"{LINKED_PRODUCT} AS product_id",
            "sku",
            "title",
            "normalized_title",
            "concat(website, '/', sku, '/p') AS url",
            "CASE WHEN l_suppkey % 7 != 0 THEN concat('https://img.example.com/s/', sku) END AS image_url",
            "CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_suppkey % 13 = 0 THEN '' "
            "ELSE concat(p_type, '/', p_brand) END AS store_category_path",
            "CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 2 = 0 "
            "THEN concat('77', lpad(CAST(l_partkey AS STRING), 11, '0')) END AS barcode",
            "(l_partkey + l_suppkey) % 10 = 0 AS needs_review",
        )

    @cached_property
    def prices(self) -> DataFrame:
        rows = self.read("lineitem").selectExpr(
            f"{LISTING_ID} AS listing_id",
            "l_orderkey * 8 + l_linenumber AS price_id",
            f"{UNIT_CENTS} AS list_cents",
            "CAST(round(l_discount * 100) AS INT) AS discount",
            "l_linestatus = 'O' AS available",
            "CAST(l_shipdate AS TIMESTAMP) AS captured_at",
        )
        return rows.selectExpr(
            "listing_id",
            "price_id",
            f"{_money('list_cents * (100 - discount) div 100')} AS price",
            # a list price counts only above the price charged
            "CASE WHEN list_cents > list_cents * (100 - discount) div 100 "
            f"THEN {_money('list_cents')} END AS list_price",
            "'COP' AS currency",
            "available",
            "captured_at",
        )

    @cached_property
    def runs(self) -> DataFrame:
        found = "IF(o_orderkey % 10 = 0, 0, CAST(floor(o_totalprice / 1000) AS INT))"
        return (
            self.read("orders")
            .selectExpr("*", f"{found} AS found", "CAST(o_orderdate AS TIMESTAMP) AS started_at")
            .selectExpr(
                "o_orderkey AS run_id",
                "CAST(o_custkey % 25 AS INT) AS store_id",
                "'vtex' AS adapter",
                "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END AS status",
                "started_at",
                "CASE WHEN o_orderstatus != 'P' "
                "THEN started_at + make_dt_interval(0, 0, CAST(o_orderkey % 55 + 5 AS INT)) END AS finished_at",
                "found AS products_found",
                "CAST(found div 7 AS INT) AS products_new",
                "CAST(found div IF(o_orderstatus = 'F', 2, 1) AS INT) AS prices_written",
                "CAST(o_orderkey % 3 AS INT) AS errors",
                "CASE WHEN o_orderstatus = 'F' THEN 'connection lost' END AS notes",
            )
        )

    # --- inputs beyond the relational tables --------------------------------

    @cached_property
    def carts(self) -> DataFrame:
        """(cart_id, product_id, quantity): an order is a shopping list."""
        return self.read("lineitem").selectExpr(
            "l_orderkey AS cart_id", "l_partkey AS product_id", "CAST(l_quantity AS INT) AS quantity"
        )

    @cached_property
    def points(self) -> DataFrame:
        """(key, ts, date, price) series of the events table."""
        return self.read("events").selectExpr(
            "concat(user_id, '/', event_type) AS key",
            "event_id",
            "CAST(ts AS TIMESTAMP) AS ts",
            "CAST(ts AS DATE) AS date",
            f"{_money('CAST(round(value * 100) AS BIGINT)')} AS price",
        )

    @cached_property
    def snapshot_rows(self) -> DataFrame:
        """Scraped lines: each store has one snapshot per half year of ship dates."""
        lines = self.read("lineitem").selectExpr(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "CAST(round(l_extendedprice * 100) AS BIGINT) AS cents",
            f"{UNIT_CENTS} AS unit",
            "CAST(round(l_discount * 100) AS INT) AS discount",
            "CAST(l_shipdate AS DATE) AS day",
        )
        suppliers = self.read("supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey AS store_id")
        parts = self.read("part").selectExpr("p_partkey AS l_partkey", "p_name", "p_type")
        stores = self.stores.selectExpr("store_id", "website", "name AS store_name")
        half = "make_date(year(day), IF(month(day) <= 6, 6, 12), 30)"
        return (
            lines.join(suppliers, "l_suppkey")
            .join(stores, "store_id")
            .join(parts, "l_partkey")
            .selectExpr(
                "concat('nation-', store_id) AS store",
                "store_name",
                "p_name AS name",
                # every 40th line came without a price, every 45th without a link
                f"CASE WHEN l_orderkey % 40 != 0 THEN {_money('unit * (100 - discount) div 100')} END AS price",
                f"{_money('unit')} AS list_price",
                "IF(l_orderkey % 45 != 0, concat(website, '/', l_partkey, '-', l_suppkey, '/p'), '') AS url",
                "concat('https://img.example.com/s/', l_partkey, '-', l_suppkey) AS image_url",
                "concat(lower(p_type), '_goods') AS category",
                "day AS scraped_date",
                "concat('nation-', store_id) AS snapshot_store",
                f"CAST({half} AS TIMESTAMP) AS snapshot_ts",
                f"{half} AS snapshot_day",
                "struct(l_orderkey, l_linenumber, cents, l_partkey, l_suppkey) AS line_order",
            )
        )

    @cached_property
    def titles(self) -> DataFrame:
        """Product titles as shops write them, several styles."""
        words = (
            "array('Whisky', 'Ron añejo', 'Cerveza', 'Agua mineral', 'Galletas', 'Vaso de vino', "
            "'Champaña', 'Gaseosa cola', 'Crema de whisky', 'Chocolate', 'Licor de café')"
        )
        size = """CASE p_size % 6 WHEN 0 THEN concat(' ', p_size, ',5 Litros')
            WHEN 1 THEN concat(' (', p_size, '0  ml)')
            WHEN 2 THEN concat(' ', p_size, 'gr X6 Unds')
            WHEN 3 THEN concat(' ', p_size, '0 CC ', p_size, ' pack')
            WHEN 4 THEN concat(' ', p_size, ' kg x', p_size)
            ELSE ' x999' END"""
        return self.read("part").selectExpr(
            "p_partkey AS product_id", "p_brand", "p_type", "p_size", "p_retailprice",
            f"concat({words}[p_size % 11], ' ', upper(p_name), {size}) AS title",
        )

    @cached_property
    def matches(self) -> DataFrame:
        """A match calendar, one a day: the last event of the day."""
        days = self.read("events").groupBy(F.to_date("ts").alias("date")).agg(F.max("event_id").alias("event_id"))
        return days.selectExpr(
            "date",
            "concat('match ', event_id) AS label",
            "CAST(NULL AS STRING) AS opponent",
            "CASE event_id % 3 WHEN 0 THEN 'Estadio local' WHEN 1 THEN 'Norte' END AS venue",
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        """Listing observations as a shop delivers them: a line item each.

        Some lack a title, a price, a brand or a barcode, some have a bad price.
        """
        lines = self.read("lineitem").selectExpr(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{UNIT_CENTS} AS cents",
            "l_linestatus = 'O' AS available",
            "CAST(l_shipdate AS TIMESTAMP) + make_dt_interval(0, l_linenumber, CAST(l_orderkey % 60 AS INT)) AS captured_at",
        )
        suppliers = self.read("supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey")
        parts = self.read("part").selectExpr(
            "p_partkey AS l_partkey", "p_name", "p_size", "p_type", "p_brand"
        )
        money = _money("IF(l_orderkey % 83 = 0, -cents, cents)")
        return (
            lines.join(suppliers, "l_suppkey")
            .join(parts, "l_partkey")
            .selectExpr(
                "concat('nation-', s_nationkey) AS store_slug",
                "concat(l_partkey, '-', l_suppkey) AS sku",
                "CAST(l_partkey AS STRING) AS store_product_id",
                f"IF(l_orderkey % 97 = 0, '', {PART_TITLE}) AS title",
                "concat('https://nation-', s_nationkey, '.example.com/', l_partkey, '-', l_suppkey, '/p') AS url",
                f"{PART_BARCODE} AS barcode",
                f"{PART_BRAND} AS brand",
                "concat('/', p_type, '/', p_brand) AS category_path",
                "IF(l_suppkey % 7 = 0 OR l_orderkey % 4 = 0, NULL, concat('https://img.example.com/', l_partkey)) AS image_url",
                f"IF(l_orderkey % 89 = 0, NULL, {money}) AS price",
                "CAST(NULL AS DECIMAL(18,2)) AS list_price",
                "'COP' AS currency",
                "available",
                "'[]' AS teasers",
                "captured_at",
            )
        )

    @cached_property
    def known_products(self) -> DataFrame:
        """Products known before a delivery: all but the promotional parts."""
        parts = self.read("part").selectExpr("*", "p_partkey AS l_partkey").filter("p_type != 'PROMO'")
        titled = parts.selectExpr(
            "p_partkey AS product_id", f"{PART_BARCODE} AS barcode", f"{PART_BRAND} AS brand",
            f"{PART_TITLE} AS name", "CAST(p_size * 10 AS DOUBLE) AS quantity", "'ml' AS unit",
        )
        return titled.select(
            "*", brand_slug(F.col("brand")).alias("brand_slug"), tx.normalize_text("name").alias("normalized_name")
        )


# Column expressions of the star schema that several tables share.
LISTING_ID = "l_partkey * 4294967296 + l_suppkey"
# a fiftieth of the listings is not linked to a product yet
LINKED_PRODUCT = "CASE WHEN (l_partkey + l_suppkey) % 50 != 0 THEN l_partkey END"
PART_TITLE = "concat(initcap(p_name), ' ', p_size * 10, ' ml')"
PART_BARCODE = "CASE WHEN l_partkey % 3 = 0 THEN concat('77', lpad(CAST(l_partkey AS STRING), 11, '0')) END"
PART_BRAND = "CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN ' ' ELSE p_brand END"
UNIT_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT) div CAST(l_quantity AS BIGINT)"
BRAND_ID = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT)"
TYPE_ID = "(ascii(p_type) * 100 + length(p_type))"
LEAF_ID = f"({TYPE_ID} * 1000 + {BRAND_ID})"


def _money(cents: str) -> str:
    """Whole cents as DECIMAL(18,2), without a division."""
    return f"CAST(CAST({cents} AS DECIMAL(18,0)) * 0.01BD AS DECIMAL(18,2))"
