"""Runs, statistics and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import monitor as mon
from .base import query

AS_OF = "2001-08-01 00:00:00"
STAMP = "yyyy-MM-dd HH:mm:ss"


def shown(name: str):
    return F.date_format(name, STAMP).alias(name)


@query(
    "p1_runs",
    """SELECT run_id, slug AS store_slug, status, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, products_found, errors
       FROM runs JOIN stores USING (store_id) WHERE slug = 'nation_9' ORDER BY runs.started_at DESC, run_id DESC LIMIT 50""",
    "runs", "stores",
)
def _(t):
    return mon.runs(t, "nation_9").select(
        "run_id", "store_slug", "status", shown("started_at"), "products_found", "errors"
    )


COUNTS = """(SELECT count(*) FROM stores WHERE active) AS stores, (SELECT count(*) FROM products) AS products,
    (SELECT count(*) FROM listings) AS store_products, (SELECT count(*) FROM prices) AS prices,
    (SELECT count(*) FROM (SELECT product_id FROM listings WHERE product_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT store_id) > 1)) AS products_multi_store,
    (SELECT count(*) FROM listings WHERE needs_review) AS needs_review"""


@query("f9_catalog_counts", f"SELECT {COUNTS}", "stores", "products", "listings", "prices")
def _(t):
    return mon.catalog_counts(t)


@query(
    "p2_catalog_stats",
    f"""SELECT {COUNTS}, slug AS last_store, status AS last_status, products_found AS last_found
        FROM (SELECT * FROM runs JOIN (SELECT store_id, slug FROM stores) USING (store_id) WHERE finished_at IS NOT NULL
              ORDER BY finished_at DESC, run_id DESC LIMIT 1)""",
    "stores", "products", "listings", "prices", "runs",
)
def _(t):
    stats = mon.catalog_stats(t)
    return stats.select(
        *[c for c in stats.columns if c != "last_ingest"],
        F.col("last_ingest.store_slug").alias("last_store"),
        F.col("last_ingest.status").alias("last_status"),
        F.col("last_ingest.products_found").alias("last_found"),
    )


@query(
    "p3_suspicious_runs",
    "SELECT run_id, status, products_found, status = 'failed' OR (status = 'completed' AND products_found = 0) AS suspicious FROM runs",
    "runs",
)
def _(t):
    return mon.suspicious_runs(t.runs).select("run_id", "status", "products_found", "suspicious")


@query(
    "p4_freshness",
    f"""SELECT slug, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_run_at,
               strftime(coalesce(last + INTERVAL 180 MINUTE, TIMESTAMP '{AS_OF}'), '%Y-%m-%d %H:%M:%S') AS next_run_at,
               coalesce(TIMESTAMP '{AS_OF}' - last >= INTERVAL 180 MINUTE, true) AS due
        FROM stores LEFT JOIN (SELECT store_id, max(finished_at) AS last FROM runs WHERE status = 'completed' GROUP BY 1) USING (store_id)""",
    "stores", "runs",
)
def _(t):
    rows = mon.freshness(t.stores, t.runs, F.lit(AS_OF).cast("timestamp"))
    return rows.select("slug", shown("last_run_at"), shown("next_run_at"), "due")


@query(
    "p5_export_manifest",
    f"""SELECT '{AS_OF}' AS generated_at, 'tables' AS source, count(*) AS product_count, CAST(30 AS INT) AS ttl_minutes,
               '2001-08-01 00:30:00' AS next_refresh_at FROM export_rows""",
    "export_rows",
)
def _(t):
    rows = mon.export_manifest(cat.export_rows(t), "tables", F.lit(AS_OF).cast("timestamp"))
    return rows.select(shown("generated_at"), "source", "product_count", "ttl_minutes", shown("next_refresh_at"))


@query(
    "p6_stores",
    """SELECT slug, name, website, active, 'list' AS kind FROM stores WHERE active
       UNION ALL SELECT slug, name, website, active, 'detail' FROM stores WHERE slug = 'nation_9'""",
    "stores",
)
def _(t):
    columns = ["slug", "name", "website", "active"]
    listed = mon.stores(t).select(*columns, F.lit("list").alias("kind"))
    return listed.unionByName(mon.store(t, "nation_9").select(*columns, F.lit("detail").alias("kind")))
