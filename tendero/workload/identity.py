"""Identity resolution, dimensions, merges, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import catalog as cat
from ..operators import identity as idn
from ..operators import ingest as ing
from ..sources import keyed
from ..streaming.feeds import prepare_listings
from .base import CTES, ORACLES, cents, norm, query, slug
from .staging import staged

AS_OF = "2002-01-01"
CUT = "1999-01-01"

TITLE = """array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || p_size * 10 || ' ml'"""
CODE = "CASE WHEN p_partkey % 3 = 0 THEN '77' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') END"
BRAND = "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_brand END"
UNIT = "CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)"

CTES["deliveries"] = (
    (),
    f"""SELECT 'nation-' || s_nationkey AS store_slug, l_partkey || '-' || l_suppkey AS sku, CAST(l_partkey AS VARCHAR) AS store_product_id,
               CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE {TITLE} END AS title,
               'https://nation-' || s_nationkey || '.example.com/' || l_partkey || '-' || l_suppkey || '/p' AS url,
               {CODE} AS barcode, {BRAND} AS brand, '/' || p_type || '/' || p_brand AS category_path,
               CASE WHEN l_suppkey % 7 <> 0 AND l_orderkey % 4 <> 0 THEN 'https://img.example.com/' || l_partkey END AS image_url,
               CASE WHEN l_orderkey % 89 <> 0 THEN {cents(f'CASE WHEN l_orderkey % 83 = 0 THEN -1 ELSE 1 END * ({UNIT})')} END AS price,
               l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) + to_minutes(CAST(l_orderkey % 60 AS BIGINT)) AS captured_at
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey""",
)
CTES["good"] = (("deliveries",), "SELECT * FROM deliveries WHERE title <> '' AND price >= 0")
CTES["latest"] = (
    ("good",),
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY store_slug, sku ORDER BY captured_at DESC, price, title, url) AS rn
       FROM good) WHERE rn = 1""",
)


def identity_sql(source: str) -> str:
    """Adds brand_slug, normalized_title, identity_kind and identity to delivered rows."""
    return f"""
        SELECT *, CASE WHEN barcode IS NOT NULL THEN 'barcode' WHEN brand_slug IS NOT NULL THEN 'attributes' ELSE 'listing' END AS identity_kind,
               coalesce(barcode, brand_slug || '|' || regexp_extract(title, '([0-9]+) ml', 1) || '|ml|' || normalized_title, store_slug || '|' || sku) AS identity
        FROM (SELECT *, CASE WHEN trim(coalesce(brand, '')) <> '' THEN {slug('brand')} END AS brand_slug, {norm('title')} AS normalized_title FROM {source})"""


CTES["identified"] = (("latest",), identity_sql("latest"))
CTES["known"] = (
    (),
    f"""SELECT identity_kind, identity, min(known_id) AS known_id FROM (
            SELECT CAST(product_id AS VARCHAR) AS known_id, identity_kind, identity FROM ({identity_sql(
        f"(SELECT p_partkey AS product_id, {CODE} AS barcode, {BRAND} AS brand, {TITLE} AS title, '' AS store_slug, '' AS sku FROM part WHERE p_type <> 'PROMO')"
    )}) WHERE identity_kind <> 'listing') GROUP BY ALL""",
)
CTES["resolved"] = (
    ("identified", "known"),
    """SELECT *, CASE WHEN identity_kind = 'barcode' THEN 'barcode'
                       WHEN identity_kind = 'attributes' AND (known_id IS NOT NULL OR nth > 1) THEN 'attributes' END AS match_method
       FROM (SELECT *, row_number() OVER (PARTITION BY identity_kind, identity ORDER BY store_slug, sku) AS nth
             FROM identified LEFT JOIN known USING (identity_kind, identity))""",
)


def delivered(t):
    """Newest good delivery of each listing, normalized."""
    return prepare_listings(ing.latest_update(ing.good_rows(ing.quarantine(t.deliveries)))).drop(
        "product_id", "identity_kind", "identity", "brand_slug"
    )


@query(
    "m1_match_barcode",
    """SELECT store_slug, sku, identity, known_id FROM identified LEFT JOIN known USING (identity_kind, identity)
       WHERE identity_kind = 'barcode'""",
    "identified", "known",
)
def _(t):
    return idn.match_barcode(delivered(t), t.known_products).select("store_slug", "sku", "identity", "known_id")


@query(
    "m2_match_attributes",
    """SELECT store_slug, sku, identity, known_id FROM identified LEFT JOIN known USING (identity_kind, identity)
       WHERE identity_kind = 'attributes'""",
    "identified", "known",
)
def _(t):
    return idn.match_attributes(delivered(t), t.known_products).select("store_slug", "sku", "identity", "known_id")


@query(
    "m3_unmatched",
    "SELECT store_slug, sku, identity_kind, identity FROM resolved WHERE match_method IS NULL",
    "resolved",
)
def _(t):
    return idn.unmatched(idn.resolve(delivered(t), t.known_products)).select(
        "store_slug", "sku", "identity_kind", "identity"
    )


@query(
    "m1_m3_e12_resolve",
    """SELECT store_slug, sku, identity_kind, coalesce(known_id, sha1(identity_kind || ':' || identity)) AS product_id, match_method,
              CASE match_method WHEN 'barcode' THEN 1.0::DOUBLE WHEN 'attributes' THEN 0.8::DOUBLE END AS match_confidence,
              match_method IS NULL AS needs_review, known_id IS NULL AS is_new_product FROM resolved""",
    "resolved",
)
def _(t):
    return idn.resolve(delivered(t), t.known_products).select(
        "store_slug", "sku", "identity_kind", "product_id", "match_method", "match_confidence", "needs_review",
        "is_new_product",
    )


@query(
    "m4_new_canonicals",
    """SELECT sha1(identity_kind || ':' || identity) AS product_id, barcode, brand_slug, ltrim(category_path, '/') AS category_path,
              title AS name, normalized_title AS normalized_name, CAST(regexp_extract(title, '([0-9]+) ml', 1) AS DOUBLE) AS quantity, image_url
       FROM resolved WHERE nth = 1 AND known_id IS NULL""",
    "resolved",
)
def _(t):
    return idn.new_canonicals(delivered(t), t.known_products).drop("unit")


@query(
    "m5_build_brands",
    f"""SELECT {slug('name')} AS slug, arg_max(name, (captured_at, name)) AS name FROM (
            SELECT trim(brand) AS name, captured_at FROM deliveries) WHERE name <> '' GROUP BY 1""",
    "deliveries",
)
def _(t):
    return idn.build_brands(t.deliveries)


@query(
    "m6_j9_build_categories",
    f"""SELECT slug, arg_max(name, (captured_at, name)) AS name, any_value(parent_slug) AS parent_slug, CAST(any_value(depth) AS INT) AS depth FROM (
            SELECT {slug("split_part(category_path, '/', 2)")} AS slug, split_part(category_path, '/', 2) AS name, captured_at, NULL AS parent_slug, 1 AS depth FROM deliveries
            UNION ALL
            SELECT {slug("split_part(category_path, '/', 2)")} || '/' || {slug("split_part(category_path, '/', 3)")}, split_part(category_path, '/', 3), captured_at,
                   {slug("split_part(category_path, '/', 2)")}, 2 FROM deliveries) GROUP BY slug""",
    "deliveries",
)
def _(t):
    return idn.build_categories(t.deliveries)


@query(
    "m7_review_queue",
    """SELECT listing_id, coalesce(options, '') AS options FROM listings LEFT JOIN (
           SELECT normalized_title, string_agg(place || ':' || product_id, ' ' ORDER BY place) AS options FROM title_candidates GROUP BY 1) USING (normalized_title)
       WHERE needs_review""",
    "listings", "title_candidates",
)
def _(t):
    options = F.transform(
        "candidates", lambda c: F.concat(c["place"].cast("string"), F.lit(":"), c["product_id"].cast("string"))
    )
    return idn.review_queue(t.listings, t.products).select(
        "listing_id", F.coalesce(F.array_join(options, " "), F.lit("")).alias("options")
    )


# --- N ----------------------------------------------------------------------


def stored(t):
    """Listings as stored before the cut: the newest delivery of each up to then."""
    early = ing.latest_update(ing.good_rows(ing.quarantine(t.deliveries)).filter(F.col("captured_at") < CUT))
    return early.select(
        "store_slug", "sku", "store_product_id", "title", tx.normalize_text("title").alias("normalized_title"),
        "url", "category_path", "image_url", "barcode",
        F.to_json(F.struct("sku")).alias("raw"),
        F.col("captured_at").alias("first_seen_at"), F.col("captured_at").alias("last_seen_at"),
        F.sha1(F.concat("store_slug", F.lit("/"), "sku")).alias("product_id"), F.lit("manual").alias("match_method"),
        F.lit(0.5).alias("match_confidence"), F.lit(False).alias("needs_review"),
    )


def updates(t):
    late = ing.good_rows(ing.quarantine(t.deliveries)).filter(F.col("captured_at") >= CUT)
    return late.select(
        "*", tx.normalize_text("title").alias("normalized_title"), F.to_json(F.struct("sku")).alias("raw")
    )


def latest_sql(where: str) -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY store_slug, sku ORDER BY captured_at DESC, price, title, url) AS rn
               FROM good WHERE {where}) WHERE rn = 1"""


@query(
    "n1_merge_listings",
    f"""SELECT coalesce(u.store_slug, s.store_slug) AS store_slug, coalesce(u.sku, s.sku) AS sku, coalesce(u.title, s.title) AS title,
               coalesce(u.image_url, s.image_url) AS image_url, coalesce(u.barcode, s.barcode) AS barcode,
               coalesce(s.store_product_id, u.store_product_id) AS store_product_id,
               CASE WHEN s.sku IS NULL THEN DATE '{AS_OF}' ELSE CAST(s.captured_at AS DATE) END AS first_seen,
               CASE WHEN u.sku IS NOT NULL THEN DATE '{AS_OF}' ELSE CAST(s.captured_at AS DATE) END AS last_seen, s.sku IS NULL AS inserted,
               CASE WHEN s.sku IS NOT NULL THEN sha1(s.store_slug || '/' || s.sku) END AS product_id,
               CASE WHEN s.sku IS NOT NULL THEN 'manual' END AS match_method
        FROM ({latest_sql(f"captured_at < TIMESTAMP '{CUT}'")}) s
        FULL JOIN ({latest_sql(f"captured_at >= TIMESTAMP '{CUT}'")}) u ON s.store_slug = u.store_slug AND s.sku = u.sku""",
    "good",
)
def _(t):
    merged = ing.merge_listings(stored(t), updates(t), F.lit(AS_OF).cast("timestamp"))
    return merged.select(
        "store_slug", "sku", "title", "image_url", "barcode", "store_product_id",
        F.to_date("first_seen_at").alias("first_seen"), F.to_date("last_seen_at").alias("last_seen"), "inserted",
        "product_id", "match_method",
    )


@query("n1_merge_key_folders", f"SELECT * EXCLUDE (inserted) FROM ({ORACLES['n1_merge_listings']})")
def _(t):
    """As n1_merge_listings, into a table of key folders; the delivery comes in twice."""

    def merge(old, new):
        return ing.merge_listings(old, new, F.lit(AS_OF).cast("timestamp"))

    def write(path: str) -> None:
        keyed.write_keyed(stored(t), path, ing.LISTING_KEY)
        for _ in range(2):
            keyed.merge_keyed(t.spark, path, updates(t), merge, 1, by_key=True)

    return keyed.read_keyed(t.spark, staged(t, "listing-folders", write)).select(
        "store_slug", "sku", "title", "image_url", "barcode", "store_product_id",
        F.to_date("first_seen_at").alias("first_seen"), F.to_date("last_seen_at").alias("last_seen"),
        "product_id", "match_method",
    )


@query(
    "n2_link_listings",
    f"""SELECT s.store_slug, s.sku, s.title,
              CASE WHEN r.sku IS NULL THEN sha1(s.store_slug || '/' || s.sku) ELSE coalesce(known_id, sha1(identity_kind || ':' || identity)) END AS product_id,
              CASE WHEN r.sku IS NULL THEN 'manual' ELSE r.match_method END AS match_method,
              r.sku IS NOT NULL AND r.match_method IS NULL AS needs_review
       FROM ({latest_sql(f"captured_at < TIMESTAMP '{CUT}'")}) s
       LEFT JOIN (SELECT * FROM resolved WHERE captured_at >= TIMESTAMP '{CUT}') r ON s.store_slug = r.store_slug AND s.sku = r.sku""",
    "good", "resolved",
)
def _(t):
    # only the listings that were delivered again have a match
    matches = idn.resolve(delivered(t), t.known_products).filter(F.col("captured_at") >= CUT)
    return ing.link_listings(stored(t), matches).select(
        "store_slug", "sku", "title", "product_id", "match_method", "needs_review"
    )


@query(
    "n3_merge_stores",
    """SELECT slug, store_id, name, active, website FROM (
           SELECT slug, store_id, name || ' SA' AS name, active, 'moved' AS website FROM stores WHERE store_id % 2 = 0
           UNION ALL SELECT slug, store_id, name, active, website FROM stores WHERE store_id % 2 <> 0
           UNION ALL SELECT 'region-' || r_regionkey, 1000 + r_regionkey, r_name, true, NULL FROM region)""",
    "stores",
)
def _(t):
    # a configuration knows neither the id nor whether the store is active, and comes twice
    renamed = t.stores.filter("store_id % 2 = 0").withColumns(
        {"name": F.concat("name", F.lit(" SA")), "store_id": F.lit(-1).cast(t.stores.schema["store_id"].dataType), "active": F.lit(True), "website": F.lit("moved")}
    )
    renamed = renamed.unionByName(renamed)
    opened = t.read("region").selectExpr(
        "1000 + r_regionkey AS store_id", "concat('region-', r_regionkey) AS slug", "r_name AS name",
        "'CO' AS country_code", "CAST(NULL AS STRING) AS website", "true AS active",
    )
    return ing.merge_stores(t.stores, renamed.unionByName(opened)).select("slug", "store_id", "name", "active", "website")


CTES["counters"] = (
    ("deliveries", "good", "resolved"),
    f"""SELECT d.store_slug, found AS products_found, coalesce(new, 0) AS products_new, written AS prices_written, found - written AS errors,
               coalesce(matched, 0) AS matched, coalesce(needs_review, 0) AS needs_review
        FROM (SELECT store_slug, count(*) AS found, count(*) FILTER (title <> '' AND price >= 0) AS written FROM deliveries GROUP BY 1) d
        LEFT JOIN (SELECT store_slug, count(*) AS new FROM (
                SELECT store_slug, sku FROM good WHERE captured_at >= TIMESTAMP '{CUT}' EXCEPT
                SELECT store_slug, sku FROM good WHERE captured_at < TIMESTAMP '{CUT}') GROUP BY 1) n USING (store_slug)
        LEFT JOIN (SELECT store_slug, count(match_method) AS matched, count(*) - count(match_method) AS needs_review FROM resolved GROUP BY 1) m USING (store_slug)""",
)


def counters(t):
    merged = ing.merge_listings(stored(t), updates(t), F.lit(AS_OF).cast("timestamp"))
    return ing.run_counters(
        ing.quarantine(t.deliveries), merged, idn.resolve(delivered(t), t.known_products)
    )


@query("f12_run_counters", "SELECT * FROM counters", "counters")
def _(t):
    return counters(t)


@query(
    "f12_run_totals",
    """SELECT CAST(sum(products_found) AS BIGINT) AS products_found, CAST(sum(prices_written) AS BIGINT) AS prices_written,
              CAST(sum(needs_review) AS BIGINT) AS needs_review, CAST(sum(errors) AS BIGINT) AS errors FROM counters""",
    "counters",
)
def _(t):
    return ing.run_totals(counters(t))


@query(
    "n4_run_record",
    f"""SELECT sha1(store_slug || ':{AS_OF} 00:00:00') AS run_id, store_slug, 'vtex' AS adapter, 'completed' AS status, products_found,
               products_new, prices_written, errors, CAST(NULL AS VARCHAR) AS notes FROM counters""",
    "counters",
)
def _(t):
    as_of = F.lit(AS_OF).cast("timestamp")
    return ing.run_record(counters(t), F.lit("vtex"), as_of, as_of).drop("started_at", "finished_at")


@query(
    "n5_quarantine",
    """SELECT store_slug, sku, captured_at::DATE AS day, concat_ws(',', CASE WHEN title = '' THEN 'no title' END,
              CASE WHEN price IS NULL THEN 'no price' END, CASE WHEN price < 0 THEN 'negative price' END) AS errors
       FROM deliveries WHERE title = '' OR price IS NULL OR price < 0""",
    "deliveries",
)
def _(t):
    return ing.bad_rows(ing.quarantine(t.deliveries)).select(
        "store_slug", "sku", F.to_date("captured_at").alias("day"), F.array_join("errors", ",").alias("errors")
    )


@query(
    "n7_audit_constraints",
    " UNION ALL ".join(
        [
            f"SELECT '{table}' AS table_name, 'unique {', '.join(key)}' AS rule, count(*) AS violations FROM (SELECT 1 FROM {table} WHERE {' AND '.join(k + ' IS NOT NULL' for k in key)} GROUP BY {', '.join(key)} HAVING count(*) > 1)"
            for table, key in [
                ("stores", ["slug"]), ("brands", ["slug"]), ("categories", ["slug"]), ("products", ["barcode"]),
                ("listings", ["store_id", "sku"]),
            ]
        ]
        + [
            f"SELECT '{table}', '{rule}', count(*) FILTER ({bad}) FROM {table}"
            for table, rule, bad in [
                *[("stores", f"{c} required", f"{c} IS NULL") for c in ("slug", "name")],
                *[("products", f"{c} required", f"{c} IS NULL") for c in ("name", "normalized_name")],
                *[("stores", f"{c} required", f"{c} IS NULL") for c in ("country_code", "active")],
                *[(x, f"{c} required", f"{c} IS NULL") for x in ("brands", "categories") for c in ("slug", "name")],
                *[("listings", f"{c} required", f"{c} IS NULL") for c in ("store_id", "sku", "title", "normalized_title", "url", "needs_review")],
                *[("prices", f"{c} required", f"{c} IS NULL") for c in ("listing_id", "price", "currency", "available", "captured_at")],
                ("prices", "price >= 0", "price < 0"),
                ("prices", "list_price >= 0", "list_price < 0"),
                *[
                    ("runs", f"{c} required", f"{c} IS NULL")
                    for c in ("store_id", "adapter", "started_at", "status", "products_found", "products_new", "prices_written", "errors")
                ],
                ("runs", "status", "status NOT IN ('running', 'completed', 'failed')"),
            ]
        ]
        + [
            f"SELECT '{table}', '{key} exists', count(*) FROM {table} t WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = t.{key})"
            for table, key, parent, pk in [
                ("listings", "store_id", "stores", "store_id"), ("listings", "product_id", "products", "product_id"),
                ("prices", "listing_id", "listings", "listing_id"), ("products", "brand_id", "brands", "brand_id"),
                ("products", "category_id", "categories", "category_id"), ("categories", "parent_id", "categories", "category_id"),
                ("runs", "store_id", "stores", "store_id"),
            ]
        ]
    ),
    "stores", "brands", "categories", "products", "listings", "prices", "runs",
)
def _(t):
    return ing.audit_constraints(t)


@query(
    "n7_audit_matches",
    """SELECT 'listings' AS table_name, 'match_method' AS rule, count(*) FILTER (match_method NOT IN ('barcode', 'attributes')) AS violations FROM resolved
       UNION ALL SELECT 'listings', 'match_confidence in 0..1',
                        count(*) FILTER (CASE match_method WHEN 'barcode' THEN 1.0 WHEN 'attributes' THEN 0.8 END NOT BETWEEN 0 AND 1) FROM resolved""",
    "resolved",
)
def _(t):
    return ing.audit_matches(idn.resolve(delivered(t), t.known_products))


def scaled(t):
    """Priced listings, some of them below the floor and some above the ceiling."""
    factor = F.when(F.col("listing_id") % 50 == 0, 0.0001).when(F.col("listing_id") % 50 == 1, 1_000_000.0).otherwise(1.0)
    return cat.priced_listings(t).withColumn("price", (F.col("price") * factor).cast("decimal(18,2)"))


RANGES = ing.range_tree(lx.PRICE_FLOOR, lx.PRICE_CEILING, lx.RANGE_DEPTH)
INNER = {n for n, *_ in RANGES if any(m == 2 * n for m, *_ in RANGES)}


@query(
    "n8_price_partitions",
    f"""WITH ranges(node, depth, lo, hi, final) AS (VALUES (-1, 0, NULL, {lx.PRICE_FLOOR}, true), (-2, 0, {lx.PRICE_CEILING}, NULL, true), {', '.join(f"({n}, {d}, {a}, {b}, {str(n not in INNER).lower()})" for n, d, a, b in RANGES)}),
       sized AS (SELECT store_id, node, depth, lo, hi, final, count(*) AS n FROM (SELECT store_id, CAST(price * CASE listing_id % 50 WHEN 0 THEN 0.0001 WHEN 1 THEN 1000000.0 ELSE 1.0 END AS DECIMAL(18,2)) AS price FROM listings JOIN current_prices USING (listing_id))
                 JOIN ranges ON CASE node WHEN -1 THEN price < hi WHEN -2 THEN price > lo ELSE price BETWEEN lo AND hi END GROUP BY ALL)
       SELECT s.store_id, s.depth, CAST(s.lo AS BIGINT) AS lo, CAST(s.hi AS BIGINT) AS hi, s.n, s.n > 300 AS oversized FROM sized s
       LEFT JOIN sized p ON p.store_id = s.store_id AND p.node = s.node // 2
       WHERE (s.n <= 300 OR s.final) AND (s.node <= 1 OR p.n > 300)""",
    "listings", "current_prices",
)
def _(t):
    # some prices scaled out of the range at either end
    return ing.price_partitions(scaled(t), cap=300)
