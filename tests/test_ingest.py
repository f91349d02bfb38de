"""Merges, pruning, identity, quarantine, price ranges."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from tendero.operators import identity as idn
from tendero.operators import ingest as ing
from tendero.sources import nested
from tendero.schemas import CATALOG_ENTRY

LISTING = (
    "store_slug STRING, sku STRING, title STRING, normalized_title STRING, barcode STRING, brand STRING, "
    "quantity DOUBLE, unit STRING, category_path STRING, image_url STRING, captured_at TIMESTAMP"
)
CATALOG = "product_id BIGINT, barcode STRING, brand_slug STRING, quantity DOUBLE, unit STRING, normalized_name STRING"


def listing(store, sku, title, barcode=None, brand="Old Parr", quantity=750.0, unit="ml"):
    return (store, sku, title, title.lower(), barcode, brand, quantity, unit, "A/B", None, datetime(2024, 1, 1))


ROWS = [
    listing("a", "1", "Whisky", "7700000000001"),
    listing("b", "1", "Whisky otro", "7700000000001"),
    listing("a", "2", "Ron"),
    listing("b", "2", "Ron"),
    listing("c", "2", "Ron"),
    listing("a", "3", "Conocido"),
    listing("a", "4", "Sin marca", brand=" "),
    listing("b", "4", "Sin marca", brand=None),
    listing("a", "5", "Codigo conocido", "7700000000009"),
]
KNOWN = [(10, None, "old-parr", 750.0, "ml", "conocido"), (11, "7700000000009", None, None, None, "x"), (12, "7700000000002", "old-parr", 750.0, "ml", "ron")]


def resolve(spark, rows, known):
    return idn.resolve(spark.createDataFrame(rows, LISTING), spark.createDataFrame(known, CATALOG))


def test_cascade(spark):
    got = {(r.store_slug, r.sku): r for r in resolve(spark, ROWS, KNOWN).collect()}
    assert len(got) == len(ROWS)
    assert got["a", "1"].product_id == got["b", "1"].product_id and got["a", "1"].match_method == "barcode"
    # a barcoded product is never matched by attributes; the first of a new group waits for review
    assert [got[s, "2"].match_method for s in "abc"] == [None, "attributes", "attributes"]
    assert len({got[s, "2"].product_id for s in "abc"}) == 1 and got["a", "2"].needs_review
    assert (got["a", "3"].product_id, got["a", "3"].match_method, got["a", "3"].match_confidence) == ("10", "attributes", 0.8)
    assert got["a", "4"].product_id != got["b", "4"].product_id and got["a", "4"].needs_review
    assert (got["a", "5"].product_id, got["a", "5"].is_new_product) == ("11", False)


def test_order_does_not_matter(spark):
    def ids(rows):
        return {(r.store_slug, r.sku): (r.product_id, r.match_method) for r in resolve(spark, rows, KNOWN).collect()}

    shuffled = ROWS[:]
    random.Random(1).shuffle(shuffled)
    assert ids(ROWS) == ids(shuffled)


def test_new_products_cover_all_new_keys(spark):
    listings, known = spark.createDataFrame(ROWS, LISTING), spark.createDataFrame(KNOWN, CATALOG)
    made = {r.product_id for r in idn.new_canonicals(listings, known).collect()}
    fresh = {r.product_id for r in idn.resolve(listings, known).filter("is_new_product").collect()}
    assert made == fresh and len(made) == 4


def test_merge_keeps_and_overwrites(spark):
    schema = (
        "store_slug STRING, sku STRING, store_product_id STRING, title STRING, normalized_title STRING, url STRING, "
        "category_path STRING, image_url STRING, barcode STRING, raw STRING, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP"
    )
    old, now = datetime(2023, 1, 1), datetime(2024, 2, 1)
    target = spark.createDataFrame(
        [("a", "1", "p1", "Viejo", "viejo", "u", "A", "img", "777", "{}", old, old), ("a", "2", "p2", "Queda", "queda", "u", "A", None, None, "{}", old, old)],
        schema,
    )
    updates = spark.sql(
        """SELECT * FROM VALUES
        ('a','1','px','Primero','primero','u1','B',CAST(NULL AS STRING),CAST(NULL AS STRING),'{1}',CAST(1 AS DECIMAL(18,2)),TIMESTAMP'2023-01-01'),
        ('a','1','px','Nuevo','nuevo','u2',NULL,NULL,'888','{2}',CAST(1 AS DECIMAL(18,2)),TIMESTAMP'2024-01-01'),
        ('b','1','p3','Otro','otro','u3','C','i',NULL,'{}',CAST(1 AS DECIMAL(18,2)),TIMESTAMP'2024-01-01')
        AS t(store_slug,sku,store_product_id,title,normalized_title,url,category_path,image_url,barcode,raw,price,captured_at)"""
    )
    merged = ing.merge_listings(target, updates, F.lit(now))
    rows = {(r.store_slug, r.sku): r for r in merged.collect()}
    a = rows["a", "1"]
    assert (a.title, a.url, a.category_path, a.raw) == ("Nuevo", "u2", None, "{2}")
    assert (a.image_url, a.barcode, a.store_product_id, a.first_seen_at, a.last_seen_at, a.inserted) == ("img", "888", "p1", old, now, False)
    assert rows["a", "2"].last_seen_at == old and rows["b", "1"].inserted and rows["b", "1"].first_seen_at == now
    again = ing.merge_listings(merged.drop("inserted"), updates, F.lit(now)).collect()
    assert {(r.store_slug, r.sku, r.title, r.first_seen_at) for r in again} == {(r.store_slug, r.sku, r.title, r.first_seen_at) for r in rows.values()}


def test_prune_scopes(spark):
    target = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id STRING, store STRING")
    now = spark.createDataFrame([("1", "a"), ("4", "a")], "id STRING, store STRING")
    assert {r.id for r in ing.prune_global(target, now).collect()} == {"1"}
    assert {r.id for r in ing.prune_by_store(target, now).collect()} == {"1", "3"}
    assert {r.id for r in ing.stale_rows(target, now).collect()} == {"2", "3"}


def test_price_partitions_against_recursion(spark):
    rng = random.Random(4)
    edges = [a for _, _, a, _ in ing.range_tree(1, 10**8, 6)]
    prices = [int(10 ** rng.uniform(-0.5, 7)) for _ in range(3000)] + [rng.choice(edges) for _ in range(300)]
    rows = spark.createDataFrame([(1, p) for p in prices], "store_id INT, p BIGINT").select("store_id", F.col("p").cast("decimal(18,2)").alias("price"))
    every = ing.price_partitions(rows, cap=150).collect()
    got = {(r.lo, r.hi, r.n, r.depth) for r in every if r.lo is not None and r.hi is not None}
    outside = {(r.lo, r.hi): r.n for r in every if r.lo is None or r.hi is None}
    below, above = rows.filter("price < 1").count(), rows.filter("price > 100000000").count()
    assert outside == {k: n for k, n in {(None, 1): below, (10**8, None): above}.items() if n}

    def walk(lo, hi, depth):
        n = sum(lo <= p <= hi for p in prices)
        middle = ing._cut(lo, hi)
        if n > 150 and depth < 6 and lo < middle < hi:
            return walk(lo, middle, depth + 1) | walk(middle, hi, depth + 1)
        return {(lo, hi, n, depth)} if n else set()

    assert got == walk(1, 10**8, 0)


def test_quarantine_names_reasons(spark):
    rows = spark.sql("SELECT 'a' AS store_slug, '' AS sku, 't' AS title, 'u' AS url, CAST(-1 AS DECIMAL(18,2)) AS price, CAST(NULL AS DECIMAL(18,2)) AS list_price")
    assert ing.quarantine(rows).collect()[0].errors == ["no sku", "negative price"]


def test_flatten_catalog_cases(spark):
    import json

    def entry(**offer):
        base = {"Price": 168000.0, "ListPrice": 210000.0, "AvailableQuantity": 100} | offer
        ean = base.pop("ean", "5000196003774")
        return {
            "productId": "2391082", "productName": "Whisky", "brand": "Buchanan'S", "linkText": "whisky-750-ml",
            "categories": ["/Supermercado/Licores/Whisky/", "/Supermercado/"],
            "items": [{"itemId": "728209", "ean": ean, "nameComplete": "Whisky Master 750 Ml", "images": [{"imageUrl": "i"}], "sellers": [{"commertialOffer": base}]}],
        }

    entries = [entry(), entry(ListPrice=168000.0), entry(Price=None), entry(Price=0.0), entry(ean="0"), entry(AvailableQuantity=0)]
    lines = spark.createDataFrame([(json.dumps(e),) for e in entries], "v STRING")
    parsed = lines.select(F.from_json("v", CATALOG_ENTRY).alias("e")).select("e.*")
    rows = nested.flatten_catalog(parsed, "https://shop.example.com/", "shop").collect()
    assert len(rows) == 4
    r = rows[0]
    assert (r.sku, r.barcode, r.quantity, r.unit, r.category_path) == ("728209", "5000196003774", 750.0, "ml", "Supermercado/Licores/Whisky")
    assert (float(r.price), float(r.list_price), r.url) == (168000, 210000, "https://shop.example.com/whisky-750-ml/p")
    assert rows[1].list_price is None and rows[2].barcode is None and rows[3].available is False


def test_links_survive_a_batch_that_does_not_cover_them(spark):
    listings = spark.createDataFrame(
        [("s", "1", "p1", "manual", 0.9, False), ("s", "2", "p2", "manual", 0.9, False), ("s", "3", None, None, None, True)],
        "store_slug string, sku string, product_id string, match_method string, match_confidence double, needs_review boolean",
    )
    matches = spark.createDataFrame(
        [("s", "2", "q", "barcode", 1.0, False)],
        "store_slug string, sku string, product_id string, match_method string, match_confidence double, needs_review boolean",
    )
    got = {r.sku: (r.product_id, r.match_method) for r in ing.link_listings(listings, matches).collect()}
    assert got == {"1": ("p1", "manual"), "2": ("q", "barcode"), "3": (None, None)}


def test_upsert_keeps_one_row_per_key(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "y"), (2, "x"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, ing.upsert(target, updates, ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "z")]


def test_upsert_orders_updates_only_where_keys_repeat(spark):
    target = spark.createDataFrame([(1, "a", "x"), (None, "n", "x")], "k int, v string, w string")
    once = spark.createDataFrame([(1, "b", "y"), (2, "c", "y"), (None, "m", "y")], "k int, v string, w string")
    out = ing.upsert(target, once, ["k"]).select("k")
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "to_json" not in text
    assert sorted(map(repr, out.collect())) == sorted(["Row(k=1)", "Row(k=2)", "Row(k=None)", "Row(k=None)"])
    twice = once.unionByName(once.withColumn("v", F.lit("a")))
    assert sorted(map(repr, map(tuple, ing.upsert(target, twice, ["k"]).collect()))) == sorted(
        map(repr, [(1, "a", "y"), (2, "a", "y"), (None, "a", "y"), (None, "n", "x")])
    )
