"""Registry of named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from ..sources.tables import GivenTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NORMAL = r"trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^\pL\pN_]+', ' ', 'g'))"


def norm(expression: str) -> str:
    return NORMAL.format(expression)


def slug(expression: str) -> str:
    return f"coalesce(nullif(replace({norm(expression)}, ' ', '-'), ''), 'sin-nombre')"


def cents(expression: str) -> str:
    return f"CAST(({expression}) * 0.01 AS DECIMAL(18,2))"


def pct(part: str, whole: str, digits: int = 2) -> str:
    """100 * part / whole rounded half up, computed in whole units of the last digit."""
    w = f"CAST(abs({whole}) * 100 AS HUGEINT)"
    units = f"(CAST(abs({part}) * 100 AS HUGEINT) * {200 * 10**digits} + {w}) // (2 * {w})"
    last = "0." + "0" * (digits - 1) + "1"
    return (
        f"CASE WHEN ({whole}) <> 0 THEN "
        f"CAST(CAST(sign({part}) AS INT) * ({units}) * {last} AS DECIMAL(18,{digits})) END"
    )


def avg2(column: str) -> str:
    """Mean of a money column, two decimals half up, without floating point."""
    total, n = f"CAST(sum(CAST({column} * 100 AS BIGINT)) AS HUGEINT)", f"count({column})"
    return f"CAST(((2 * {total} + {n}) // (2 * {n})) * 0.01 AS DECIMAL(18,2))"


# The derived tables, spelled for DuckDB. Each names what it needs first.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "stores": ((), f"""
        SELECT n_nationkey AS store_id, {slug('n_name')} AS slug, n_name AS name,
               'CO' AS country_code, 'https://' || {slug('n_name')} || '.example.com' AS website,
               n_regionkey <> 4 AS active
        FROM nation"""),
    "brands": ((), f"""
        SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS brand_id,
               {slug('p_brand')} AS slug, p_brand AS name
        FROM part"""),
    "categories": ((), f"""
        SELECT DISTINCT ascii(p_type) * 100 + length(p_type) AS category_id,
               CAST(NULL AS INT) AS parent_id, {slug('p_type')} AS slug, p_type AS name
        FROM part
        UNION
        SELECT DISTINCT (ascii(p_type) * 100 + length(p_type)) * 1000
                   + CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT),
               ascii(p_type) * 100 + length(p_type),
               {slug('p_type')} || '/' || {slug('p_brand')}, p_brand
        FROM part"""),
    "products": ((), f"""
        SELECT p_partkey AS product_id,
               CASE WHEN p_partkey % 2 = 0 THEN '77' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') END AS barcode,
               CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS brand_id,
               (ascii(p_type) * 100 + length(p_type)) * 1000
                   + CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS category_id,
               p_name AS name, {norm('p_name')} AS normalized_name,
               CAST(p_size AS DECIMAL(18,3)) AS quantity, 'ml' AS unit,
               CASE WHEN p_partkey % 4 <> 0 THEN 'https://img.example.com/' || p_partkey END AS image_url
        FROM part"""),
    "listings": (("stores",), f"""
        SELECT l_partkey * 4294967296 + l_suppkey AS listing_id, store_id,
               CASE WHEN (l_partkey + l_suppkey) % 50 <> 0 THEN l_partkey END AS product_id,
               l_partkey || '-' || l_suppkey AS sku,
               t.title, {norm('t.title')} AS normalized_title,
               website || '/' || l_partkey || '-' || l_suppkey || '/p' AS url,
               CASE WHEN l_suppkey % 7 <> 0 THEN 'https://img.example.com/s/' || l_partkey || '-' || l_suppkey END AS image_url,
               CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_suppkey % 13 = 0 THEN ''
                    ELSE p_type || '/' || p_brand END AS store_category_path,
               CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 2 = 0
                    THEN '77' || lpad(CAST(l_partkey AS VARCHAR), 11, '0') END AS barcode,
               (l_partkey + l_suppkey) % 10 = 0 AS needs_review
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) k
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN part ON l_partkey = p_partkey
        JOIN stores ON s_nationkey = store_id,
        LATERAL (SELECT array_to_string(list_transform(string_split(p_name, ' '),
                     lambda w: upper(w[1]) || lower(w[2:])), ' ')
                 || ' (' || (p_size * 10) || '  ML) x' || (l_suppkey % 12 + 1) AS title) t"""),
    "prices": ((), f"""
        SELECT listing_id, price_id, {cents('price_cents')} AS price,
               CASE WHEN list_cents > price_cents THEN {cents('list_cents')} END AS list_price,
               'COP' AS currency, available, captured_at
        FROM (
            SELECT l_partkey * 4294967296 + l_suppkey AS listing_id,
                   l_orderkey * 8 + l_linenumber AS price_id,
                   CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS list_cents,
                   (CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT))
                       * (100 - CAST(round(l_discount * 100) AS INT)) // 100 AS price_cents,
                   l_linestatus = 'O' AS available, l_shipdate AS captured_at
            FROM lineitem)"""),
    "current_prices": (("prices",), """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY listing_id
                ORDER BY captured_at DESC, price_id DESC, price, list_price NULLS FIRST) AS rn
            FROM prices) WHERE rn = 1"""),
    "runs": ((), """
        SELECT o_orderkey AS run_id, CAST(o_custkey % 25 AS INT) AS store_id, 'vtex' AS adapter,
               CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END AS status,
               o_orderdate AS started_at,
               CASE WHEN o_orderstatus <> 'P'
                    THEN o_orderdate + to_minutes(CAST(o_orderkey % 55 + 5 AS BIGINT)) END AS finished_at,
               CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 1000) AS INT) END AS products_found,
               CAST((CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 1000) AS INT) END) // 7 AS INT) AS products_new,
               CAST((CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 1000) AS INT) END)
                   // (CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END) AS INT) AS prices_written,
               CAST(o_orderkey % 3 AS INT) AS errors,
               CASE WHEN o_orderstatus = 'F' THEN 'connection lost' END AS notes
        FROM orders"""),
    "carts": ((), """
        SELECT l_orderkey AS cart_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity
        FROM lineitem"""),
    "points": ((), f"""
        SELECT user_id || '/' || event_type AS key, event_id, ts, CAST(ts AS DATE) AS date,
               {cents('CAST(round(value * 100) AS BIGINT)')} AS price
        FROM events"""),
    "matches": ((), """
        SELECT date, 'match ' || event_id AS label,
               CASE event_id % 3 WHEN 0 THEN 'Estadio local' WHEN 1 THEN 'Norte' END AS venue
        FROM (SELECT CAST(ts AS DATE) AS date, max(event_id) AS event_id FROM events GROUP BY 1)"""),
    "snapshot_rows": (("stores",), f"""
        SELECT 'nation-' || store_id AS store, s.name AS store_name, p_name AS name,
               CASE WHEN l_orderkey % 40 <> 0 THEN {cents('''
                   (CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT))
                   * (100 - CAST(round(l_discount * 100) AS INT)) // 100''')} END AS price,
               {cents('CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)')} AS list_price,
               CASE WHEN l_orderkey % 45 <> 0
                    THEN website || '/' || l_partkey || '-' || l_suppkey || '/p' ELSE '' END AS url,
               'https://img.example.com/s/' || l_partkey || '-' || l_suppkey AS image_url,
               lower(p_type) || '_goods' AS category, CAST(l_shipdate AS DATE) AS scraped_date,
               'nation-' || store_id AS snapshot_store,
               make_date(year(l_shipdate), CASE WHEN month(l_shipdate) <= 6 THEN 6 ELSE 12 END, 30) AS snapshot_day,
               row_number() OVER (ORDER BY l_orderkey, l_linenumber,
                   CAST(round(l_extendedprice * 100) AS BIGINT), l_partkey, l_suppkey) AS line_order
        FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN stores s ON s_nationkey = store_id
        JOIN part ON l_partkey = p_partkey"""),
    "titles": ((), """
        SELECT p_partkey AS product_id, p_brand, p_type, p_size, p_retailprice,
               ['Whisky', 'Ron añejo', 'Cerveza', 'Agua mineral', 'Galletas', 'Vaso de vino', 'Champaña',
                'Gaseosa cola', 'Crema de whisky', 'Chocolate', 'Licor de café'][p_size % 11 + 1]
               || ' ' || upper(p_name)
               || CASE p_size % 6 WHEN 0 THEN ' ' || p_size || ',5 Litros'
                                  WHEN 1 THEN ' (' || p_size || '0  ml)'
                                  WHEN 2 THEN ' ' || p_size || 'gr X6 Unds'
                                  WHEN 3 THEN ' ' || p_size || '0 CC ' || p_size || ' pack'
                                  WHEN 4 THEN ' ' || p_size || ' kg x' || p_size
                                  ELSE ' x999' END AS title
        FROM part"""),
    "product_rows": (("products", "brands", "categories"), """
        SELECT p.*, b.slug AS brand_slug, b.name AS brand_name, c.slug AS category_slug,
               c.name AS category_name, c.parent_id AS category_parent_id
        FROM products p LEFT JOIN brands b USING (brand_id) LEFT JOIN categories c USING (category_id)"""),
    "star": (("product_rows", "listings", "current_prices"), """
        SELECT p.*, l.listing_id, l.store_id, cp.price, cp.list_price, cp.captured_at
        FROM product_rows p JOIN listings l USING (product_id)
        JOIN current_prices cp USING (listing_id)"""),
    "listing_prices": (("listings", "stores", "current_prices"), """
        SELECT l.listing_id, l.product_id, l.url, s.store_id, s.slug AS store_slug, s.name AS store_name,
               s.country_code AS store_country, s.website AS store_website, s.active AS store_active,
               cp.price, cp.list_price, cp.currency, cp.available, cp.captured_at
        FROM listings l JOIN stores s USING (store_id) JOIN current_prices cp USING (listing_id)"""),
    "export_rows": (("product_rows", "listings", "stores", "current_prices"), """
        SELECT l.listing_id, s.slug AS store, s.name AS store_name, coalesce(p.name, l.title) AS title,
               cp.price, cp.list_price, cp.currency, cp.available,
               coalesce(l.image_url, p.image_url) AS img, l.url,
               coalesce(p.category_name, split_part(l.store_category_path, '/', 1), 'Otros') AS category,
               p.barcode, p.quantity, p.unit, p.brand_name AS brand, cp.captured_at
        FROM listings l JOIN stores s USING (store_id) JOIN current_prices cp USING (listing_id)
        LEFT JOIN product_rows p USING (product_id)
        WHERE cp.price > 0"""),
}


def oracle(body: str, *needed: str) -> str:
    """SQL text with the derived tables it needs in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    body = body.strip()
    if not order:
        return body
    head = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order)
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None, *needed: str):
    """Register a query over the given tables under ``name``."""

    def register(build: Callable[[GivenTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return build(GivenTables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, *needed)
        return build

    return register
