"""File sources and sinks: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.money import clean_list_price, money
from ..operators import catalog as cat
from ..operators import current as cur
from ..operators import history as his
from ..operators import ingest as ing
from ..plans import exports
from ..schemas import CATALOG_FILE_ROW
from ..sources import files, keyed as tables, sinks
from ..sources.tables import Tables
from .base import CTES, ORACLES, query
from .staging import snapshot_folder, staged
from .texts import ENTRY

AS_OF = "2001-08-01 00:00:00"
def as_of():
    return F.lit(AS_OF).cast("timestamp")


def text_lines(df):
    return lambda path: df.write.options(**sinks.PACKED).text(path)


# --- A ----------------------------------------------------------------------


def snapshot_files(t):
    return files.scan_snapshots(t.spark, snapshot_folder(t))


@query(
    "a1_scan_snapshots",
    """SELECT snapshot_store, snapshot_day, store_name, name, url, price, list_price, category, CAST(scraped_date AS VARCHAR) AS scraped_date
       FROM snapshot_rows""",
    "snapshot_rows",
)
def _(t):
    return snapshot_files(t).select(
        "snapshot_store", "snapshot_day", "store_name", "name", "url",
        money(F.col("price_cop")).alias("price"), money(F.col("list_price_cop")).alias("list_price"),
        "category", "scraped_date",
    )


@query(
    "a1_first_line_of_files",
    """SELECT snapshot_store, snapshot_day, url, price FROM (
           SELECT *, row_number() OVER (PARTITION BY snapshot_store, snapshot_day, url ORDER BY line_order) AS rn
           FROM snapshot_rows WHERE price IS NOT NULL AND url <> '') WHERE rn = 1""",
    "snapshot_rows",
)
def _(t):
    rows = snapshot_files(t).withColumn("price", money(F.col("price_cop")))
    return cur.first_by_url(cur.valid_snapshot_rows(rows)).select(
        "snapshot_store", "snapshot_day", "url", "price"
    )


LATEST = """SELECT snapshot_store, snapshot_day, url, name, price, line_order FROM (
    SELECT *, dense_rank() OVER (PARTITION BY snapshot_store ORDER BY snapshot_day DESC) AS age FROM snapshot_rows) WHERE age <= 3"""


@query("a2_latest_snapshots", LATEST.replace(", line_order FROM", " FROM"), "snapshot_rows")
def _(t):
    return files.latest_snapshots(t.snapshot_rows, 3).select(
        "snapshot_store", "snapshot_day", "url", "name", "price"
    )


@query(
    "b8_retain_snapshots",
    f"SELECT snapshot_store, snapshot_day, count(*) AS rows FROM ({LATEST}) GROUP BY ALL",
    "snapshot_rows",
)
def _(t):
    return files.retain_snapshots(t.snapshot_rows).groupBy("snapshot_store", "snapshot_day").agg(
        F.count("*").alias("rows")
    )


@query("a2_newest_snapshot_files", LATEST.replace(", line_order FROM", " FROM"), "snapshot_rows")
def _(t):
    """As a2_latest_snapshots, from written snapshots: only the chosen files are read."""
    rows = files.priced_lines(files.scan_newest_snapshots(t.spark, snapshot_folder(t), 3))
    return rows.select("snapshot_store", "snapshot_day", "url", "name", "price")


@query(
    "b8_expired_snapshot_files",
    """SELECT snapshot_store, snapshot_day FROM (
           SELECT DISTINCT snapshot_store, snapshot_day FROM snapshot_rows)
       QUALIFY dense_rank() OVER (PARTITION BY snapshot_store ORDER BY snapshot_day DESC) > 5""",
    "snapshot_rows",
)
def _(t):
    """Snapshots that a retention of five would remove, by their names alone."""
    expired = files.expired_files(files.list_snapshots(t.spark, snapshot_folder(t)), 5)
    return expired.select("snapshot_store", F.to_date("snapshot_ts").alias("snapshot_day")).distinct()


@query(
    "a3_scan_catalog_json",
    """SELECT CAST(p_partkey AS VARCHAR) AS product, p_name AS name, CASE WHEN p_size % 8 = 0 THEN 0 ELSE 2 END AS categories, 2 AS items,
              CASE WHEN p_size % 10 = 0 THEN 0.0 ELSE p_retailprice END AS price FROM part""",
)
def _(t):
    lines = t.read("part").select(F.to_json(F.expr(ENTRY)).alias("value"))
    path = staged(t, "catalog-json", text_lines(lines))
    entries = files.scan_catalog_json(t.spark, path)
    return entries.select(
        F.col("productId").alias("product"),
        F.col("productName").alias("name"),
        F.size("categories").alias("categories"),
        F.size("items").alias("items"),
        F.expr("filter(items[0].sellers, s -> s.commertialOffer.Price is not null)[0].commertialOffer.Price").alias("price"),
    )


EXPORT_ITEM = """to_json(named_struct('id', IF(p_partkey % 11 = 0, NULL, CAST(p_partkey AS STRING)), 'title', IF(p_size % 3 = 0, '', p_name), 'name', IF(p_size % 9 = 0, NULL, upper(p_name)),
    'store', IF(p_size % 10 = 0, ' \t', concat('\t s', p_size, '\n')), 'store_name', IF(p_size % 2 = 0, NULL, p_type), 'category', IF(p_size % 4 = 0, NULL, p_brand),
    'price', IF(p_size % 5 = 0, NULL, p_retailprice), 'price_cop', IF(p_size % 7 = 0, NULL, p_retailprice + 1), 'img', IF(p_size % 2 = 0, 'a', NULL),
    'image', 'b', 'url', concat('https://shop.example.com/', p_partkey), 'updated_at', '2024-01-01'))"""


def documents(t, wrap: str, per_document: int = 200):
    """Parts as JSON documents of at most ``per_document`` products each."""
    number = F.floor(F.col("p_partkey") / per_document)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))), lambda x: x["item"]), ",")
    lists = t.read("part").select(number.alias("d"), "p_partkey", F.expr(EXPORT_ITEM).alias("item")).groupBy("d").agg(joined.alias("items"))
    if wrap == "mixed":
        bare = F.concat(F.lit("["), "items", F.lit("]"))
        inside = F.concat(F.lit('{"source":"x","products":['), "items", F.lit("]}"))
        return lists.select(F.when(F.col("d") % 2 == 0, bare).otherwise(inside).alias("value"))
    return lists.select(
        F.concat(F.lit('window.__CATALOG__ = {"products":['), "items", F.lit("]};")).alias("value")
    )


@query(
    "a4_scan_export",
    """SELECT CAST(CASE WHEN p_partkey % 11 = 0 THEN place ELSE p_partkey END AS VARCHAR) AS id, CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END AS title, 's' || p_size AS store,
              CASE WHEN p_size % 2 = 0 THEN 's' || p_size ELSE p_type END AS store_name, CASE WHEN p_size % 4 = 0 THEN 'Otros' ELSE p_brand END AS category,
              CASE WHEN p_size % 5 <> 0 THEN p_retailprice ELSE p_retailprice + 1 END AS price, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS img,
              'https://shop.example.com/' || p_partkey AS url, '2024-01-01' AS scraped_date
       FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey) - 1 AS place FROM part)
       WHERE p_size % 9 <> 0 AND p_size % 10 <> 0 AND NOT (p_size % 5 = 0 AND p_size % 7 = 0)""",
)
def _(t):
    path = staged(t, "exports", text_lines(documents(t, "mixed")))
    return files.scan_export(t.spark, path, per_line=True)


@query(
    "a5_scan_wrapped_catalog",
    """SELECT CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS id, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS title,
              CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS price, 'https://shop.example.com/' || p_partkey AS url FROM part""",
)
def _(t):
    path = staged(t, "wrapped", text_lines(documents(t, "script")))
    return files.scan_wrapped_catalog(t.spark, path, per_line=True).select("id", "title", "price", "url")


def one_document(t, label: str, head: str, tail: str) -> str:
    """All parts as records of one document in one file."""

    def write(path: str) -> None:
        parts = t.read("part")
        first, last = parts.agg(F.min("p_partkey"), F.max("p_partkey")).first()
        key = F.col("p_partkey")
        lead, end = F.when(key == first, head).otherwise(""), F.when(key == last, tail).otherwise(",")
        lines = parts.select("p_partkey", F.concat(lead, F.expr(EXPORT_ITEM), end).alias("value"))
        lines.coalesce(1).sortWithinPartitions("p_partkey").select("value").write.text(path)

    return staged(t, label, write)


@query(
    "a4_scan_large_export",
    ORACLES["a4_scan_export"].replace("PARTITION BY p_partkey // 200 ORDER BY p_partkey", "ORDER BY p_partkey"),
)
def _(t):
    """As a4_scan_export, from one document that is cut at its records."""
    return files.scan_large_exports(t.spark, one_document(t, "one-export", "[", "]"))


@query("a5_scan_large_catalog", ORACLES["a5_scan_wrapped_catalog"])
def _(t):
    """As a5_scan_wrapped_catalog, from one script that is cut at its records."""
    path = one_document(t, "one-script", 'window.__CATALOG__ = {"products":[', "]};")
    return files.scan_large_catalogs(t.spark, path).select("id", "title", "price", "url")


def write_tables(t, path: str) -> None:
    for name in ("stores", "brands", "categories", "products", "listings", "prices", "runs"):
        getattr(t, name).write.parquet(f"{path}/{name}")


@query(
    "a6_table_scans",
    """SELECT product_id, count(DISTINCT store_id) AS store_count, min(price) AS min_price, max(price) AS max_price
       FROM star GROUP BY product_id""",
    "star",
)
def _(t):
    path = staged(t, "tables", lambda p: write_tables(t, p))
    return cat.product_summary(Tables(t.spark, path)).select(
        "product_id", "store_count", "min_price", "max_price"
    )


@query(
    "a7_scan_matches",
    """SELECT CAST(ts AS DATE) AS date, CASE event_id % 4 WHEN 0 THEN 'Real Cartagena local' WHEN 1 THEN 'Rival ' || user_id ELSE 'Copa ' || user_id END AS label,
              CASE WHEN event_id % 4 IN (1, 3) THEN 'Rival ' || user_id END AS opponent, CASE event_id % 4 WHEN 3 THEN 'Norte' END AS venue
       FROM events WHERE NOT (event_id % 4 = 2 AND event_id % 3 = 0)""",
)
def _(t):
    # calendar documents of at most 500 events, entries as bare dates or objects, some without a date
    item = F.expr(
        """CASE event_id % 4
            WHEN 0 THEN concat('"', date_format(ts, 'yyyy-MM-dd'), '"')
            WHEN 1 THEN to_json(named_struct('date', date_format(ts, 'yyyy-MM-dd'), 'opponent', concat('Rival ', user_id)))
            WHEN 2 THEN to_json(named_struct('date', IF(event_id % 3 = 0, 'por definir', date_format(ts, 'yyyy-MM-dd')), 'label', concat('Copa ', user_id), 'venue', ' '))
            ELSE to_json(named_struct('date', date_format(ts, 'yyyy-MM-dd'), 'label', concat('Copa ', user_id), 'opponent', concat('Rival ', user_id), 'venue', 'Norte')) END"""
    )
    rows = t.read("events").select(F.floor(F.col("event_id") / 500).alias("d"), item.alias("item"))
    calendars = rows.groupBy("d").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit("]")).alias("value")
    )
    path = staged(t, "matches", text_lines(calendars.select("value")))
    return files.scan_matches(t.spark, path, per_line=True)


# --- B ----------------------------------------------------------------------


def catalog(t):
    rows = cat.export_rows(t)
    return rows.select(
        tx.stable_id("store", "url").alias("id"),
        "title", "store", "store_name", "category", "price",
        clean_list_price(F.col("price"), F.col("list_price")).alias("list_price"),
        "img", "url",
        F.to_date("captured_at").cast("string").alias("scraped_date"),
    )


CTES["mart"] = (
    ("export_rows",),
    """SELECT store || '-' || substr(sha1(url), 1, 16) AS id, title, store, store_name, category, price,
              CASE WHEN list_price > price THEN list_price END AS list_price, img, url, CAST(CAST(captured_at AS DATE) AS VARCHAR) AS scraped_date
       FROM export_rows""",
)


def catalog_files(t):
    return staged(t, "catalog", lambda p: sinks.write_catalog(catalog(t), p, "tables", as_of()))


@query("b1_write_catalog", "SELECT * FROM mart", "mart")
def _(t):
    path = catalog_files(t)
    return t.spark.read.schema(catalog(t).schema).json(f"{path}/products")


@query(
    "b1_catalog_manifest",
    "SELECT 'tables' AS source, count(*) AS product_count, CAST(30 AS INT) AS ttl_minutes FROM mart",
    "mart",
)
def _(t):
    schema = "source STRING, product_count BIGINT, ttl_minutes INT"
    return t.spark.read.schema(schema).json(f"{catalog_files(t)}/manifest")


@query("b1_wrapped_catalog", "SELECT id, title, store, category, CAST(price AS DOUBLE) AS price, url FROM mart", "mart")
def _(t):
    path = staged(t, "scripts", text_lines(sinks.wrapped_catalog(catalog(t), 200)))
    return files.scan_wrapped_catalog(t.spark, path, per_line=True).select(
        "id", "title", "store", "category", "price", "url"
    )


@query(
    "b2_write_history_csv",
    """SELECT key, name, CAST("count" AS VARCHAR) AS "count", CAST(min_price AS VARCHAR) AS min_price, CAST(avg_price AS VARCHAR) AS avg_price,
              CAST(last_date AS VARCHAR) AS last_date, CAST(delta_cop AS VARCHAR) AS delta_cop, CAST(delta_pct AS VARCHAR) AS delta_pct FROM series_summary""",
    "series_summary",
)
def _(t):
    summary = his.series_summary(his.series_points(t.snapshot_rows))
    path = staged(t, "csv", lambda p: sinks.write_history_csv(summary, p))
    schema = ", ".join(f"`{c}` STRING" for c in sinks.SUMMARY_COLUMNS)
    return t.spark.read.schema(schema).option("header", True).csv(path).select(
        "key", "name", "count", "min_price", "avg_price", "last_date", "delta_cop", "delta_pct"
    )


@query(
    "b3_write_history_json",
    """SELECT (SELECT CAST(count(DISTINCT (snapshot_store, snapshot_day)) AS INT) FROM snapshot_rows) AS files_analyzed, (SELECT count(*) FROM series) AS records_loaded, (SELECT count(*) FROM series_summary) AS product_count,
              (SELECT count(*) FROM series) AS points_written""",
    "series", "series_summary", "snapshot_rows",
)
def _(t):
    def write(p: str) -> None:
        points = his.sorted_points(his.series_points(t.snapshot_rows))
        sinks.write_history_json(his.series_export(points), points, p, t.snapshot_rows)

    path = staged(t, "history-json", write)
    header = t.spark.read.schema("files_analyzed INT, records_loaded BIGINT, product_count BIGINT").json(f"{path}/header")
    written = t.spark.read.schema("history ARRAY<STRUCT<date: DATE>>").json(f"{path}/products")
    counted = written.agg(F.sum(F.size("history")).alias("points_written"))
    stacked = header.unionByName(counted, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def stored_catalog(t):
    """The catalog written once, in files by id, for what needs all its columns more than once."""
    rows = catalog(t)
    path = staged(t, "catalog-rows", lambda p: tables.write_dealt(rows, p, ["id"]))
    return t.spark.read.schema(rows.schema).parquet(path)


def older_mart(t, rows=catalog):
    """A mart of an earlier day: dearer, without one store, with products gone since."""
    gone = t.titles.selectExpr(
        "concat('nation_1-gone', product_id) AS id", "title", "IF(p_size % 2 = 0, 'nation_1', 'nation_77') AS store",
        "'x' AS store_name", "p_type AS category", "CAST(1 AS DECIMAL(18,2)) AS price",
        "CAST(NULL AS DECIMAL(18,2)) AS list_price", "CAST(NULL AS STRING) AS img", "'u' AS url", "'2000-01-01' AS scraped_date",
    )
    old = rows(t).filter("store != 'nation_2'").withColumn("price", money(F.col("price") + 1))
    return old.unionByName(gone)


CTES["older_mart"] = (
    ("mart", "titles"),
    """SELECT id, store, CAST(price + 1 AS DECIMAL(18,2)) AS price FROM mart WHERE store <> 'nation_2'
       UNION ALL SELECT 'nation_1-gone' || product_id, CASE WHEN p_size % 2 = 0 THEN 'nation_1' ELSE 'nation_77' END, 1.00::DECIMAL(18,2) FROM titles""",
)


@query(
    "b4_upsert",
    """SELECT id, store, price FROM mart UNION ALL SELECT id, store, price FROM older_mart WHERE id NOT IN (SELECT id FROM mart)""",
    "older_mart",
)
def _(t):
    return ing.upsert(older_mart(t), catalog(t), ["id"]).select("id", "store", "price")


def keyed(t, label: str, rows, key: list[str], updates, merge) -> str:
    """Rows and then updates, both stored in files by key, as a table in key folders."""

    def write(path: str) -> None:
        tables.write_keyed(rows(t), path, key, dealt=True)
        tables.merge_keyed(t.spark, path, updates(t), merge, 1, by_key=True, stored=True)

    return staged(t, label, write)


@query(
    "b4_upsert_key_folders",
    """SELECT id, store, price FROM mart UNION ALL SELECT id, store, price FROM older_mart WHERE id NOT IN (SELECT id FROM mart)""",
    "older_mart",
)
def _(t):
    """As b4_upsert, into a table of key folders."""
    older = lambda t: older_mart(t, stored_catalog)
    path = keyed(t, "mart-folders", older, ["id"], stored_catalog, lambda old, new: ing.upsert(old, new, ["id"]))
    return tables.read_keyed(t.spark, path).select("id", "store", "price")


@query("b5_prune_global", "SELECT id, store, price FROM older_mart WHERE id IN (SELECT id FROM mart)", "older_mart")
def _(t):
    return ing.prune_global(older_mart(t), catalog(t)).select("id", "store", "price")


@query(
    "b5_e11_stale_rows",
    "SELECT id, store FROM older_mart WHERE id NOT IN (SELECT id FROM mart)",
    "older_mart",
)
def _(t):
    return ing.stale_rows(older_mart(t), catalog(t)).select("id", "store")


@query(
    "b6_prune_by_store",
    """SELECT id, store, price FROM older_mart WHERE store NOT IN (SELECT store FROM mart) OR id IN (SELECT id FROM mart)""",
    "older_mart",
)
def _(t):
    return ing.prune_by_store(older_mart(t), catalog(t)).select("id", "store", "price")


@query(
    "b6_removed_by_store",
    """SELECT store, count(*) AS removed FROM older_mart WHERE store IN (SELECT store FROM mart) AND id NOT IN (SELECT id FROM mart) GROUP BY store""",
    "older_mart",
)
def _(t):
    return ing.removed_by_store(older_mart(t), catalog(t))


@query("j10_ids_by_store", "SELECT DISTINCT store, id FROM mart", "mart")
def _(t):
    return ing.ids_by_store(catalog(t), 500).select("store", F.explode("ids").alias("id"))


@query(
    "b7_append_prices",
    """SELECT date AS day, 2 * count(*) AS rows, CAST(2 * sum(price) AS DECIMAL(18,2)) AS total FROM points GROUP BY date""",
    "points",
)
def _(t):
    rows = t.points.select(F.col("key").alias("listing_id"), "price", F.col("ts").alias("captured_at"))

    def twice(path: str) -> None:
        sinks.append_prices(rows, path)
        sinks.append_prices(rows, path)

    path = staged(t, "prices", twice)
    written = t.spark.read.parquet(path)
    return written.groupBy("day").agg(
        F.count("*").alias("rows"), F.sum("price").cast("decimal(18,2)").alias("total")
    )


def price_points(t):
    return t.points.select(F.col("key").alias("listing_id"), "event_id", "price", F.col("ts").alias("captured_at"))


def price_folder(t) -> str:
    """Prices in two batches, the second one delivered three times."""

    def write(path: str) -> None:
        rows = price_points(t)
        sinks.append_prices(rows.filter("event_id % 3 = 0"), path, batch=0)
        for _ in range(3):
            sinks.append_prices(rows.filter("event_id % 3 <> 0"), path, batch=1)

    return staged(t, "price-batches", write)


@query(
    "b7_n6_append_batch_once",
    "SELECT date AS day, count(*) AS rows, CAST(sum(price) AS DECIMAL(18,2)) AS total FROM points GROUP BY date",
    "points",
)
def _(t):
    written = t.spark.read.parquet(price_folder(t))
    return written.groupBy("day").agg(F.count("*").alias("rows"), F.sum("price").cast("decimal(18,2)").alias("total"))


@query(
    "d9_lookback_day_folders",
    """SELECT key AS listing_id, event_id, price FROM points
       WHERE ts >= (SELECT max(ts) FROM points) - INTERVAL 7 DAY""",
    "points",
)
def _(t):
    """The last week of prices; older day folders are not read."""
    newest = t.points.agg(F.max("ts")).first()[0]
    return cur.lookback(t.spark.read.parquet(price_folder(t)), newest, 7).select("listing_id", "event_id", "price")


@query(
    "d9_prices_on_busy_days",
    """SELECT key AS listing_id, event_id, price FROM points SEMI JOIN (
           SELECT date FROM points GROUP BY date HAVING count(*) > (SELECT count(*) / count(DISTINCT date) FROM points)) USING (date)""",
    "points",
)
def _(t):
    """Prices of days with more points than the mean: the days prune the scan at run time."""
    days = t.points.groupBy(F.col("date").alias("day")).agg(F.count("*").alias("n"))
    mean = t.points.agg(F.count("*") / F.count_distinct("date")).first()[0]
    busy = days.filter(F.col("n") > F.lit(mean)).select("day")
    return cur.on_days(t.spark.read.parquet(price_folder(t)), busy).select("listing_id", "event_id", "price")


@query(
    "b9_to_mart_rows",
    """SELECT CASE WHEN p_size % 3 = 0 THEN p_type || '-' || p_partkey ELSE 'id' || p_partkey END AS id, p_type AS store, title, p_retailprice AS price,
              title AS raw_title, CAST(p_partkey AS VARCHAR) AS raw_sku FROM titles JOIN (SELECT p_partkey FROM part) p ON p_partkey = product_id""",
    "titles",
)
def _(t):
    rows = t.titles.selectExpr(
        "IF(p_size % 3 = 0, '', concat('id', product_id)) AS id", "CAST(product_id AS STRING) AS sku",
        "p_type AS store", "title", "p_retailprice AS price",
    )
    return ing.to_mart_rows(rows).select(
        "id", "store", "title", "price",
        F.get_json_object("raw", "$.title").alias("raw_title"),
        F.get_json_object("raw", "$.sku").alias("raw_sku"),
    )
