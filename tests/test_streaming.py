"""The feed in several batches, with late and repeated rows and a rerun batch."""

import os
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tendero.operators.ingest import latest_update
from tendero.session import scratch_dir
from tendero.sources.tables import GivenTables
from tendero.streaming import feeds
from tendero.workload import streams

SCHEMA = "key STRING, event_id BIGINT, ts TIMESTAMP, price DECIMAL(18,2)"
START = datetime(2024, 1, 1)


def write(spark, folder, n, rows):
    data = [(k, i, START + timedelta(hours=h), None) for k, i, h, _ in rows]
    prices = {i: p for _, i, _, p in rows}
    df = spark.createDataFrame(data, SCHEMA)
    table = F.create_map(*[F.lit(x) for pair in prices.items() for x in pair])
    df.withColumn("price", F.element_at(table, F.col("event_id")).cast("decimal(18,2)")).coalesce(1).write.parquet(f"{folder}/{n}")


def stream(spark, folder):
    return (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    )


def test_current_price_over_batches(spark):
    folder = scratch_dir(spark, "feed")
    out, checkpoint = f"{folder}/state", f"{folder}/checkpoint"
    write(spark, f"{folder}/in", 1, [("a", 1, 0, 100), ("a", 2, 5, 90), ("b", 3, 1, 50)])
    feeds.stream_current(stream(spark, f"{folder}/in"), out, checkpoint)
    # a late row must not replace the newer price, but may raise the highest one
    write(spark, f"{folder}/in", 2, [("a", 4, 2, 200), ("b", 5, 9, 49.5)])
    feeds.stream_current(stream(spark, f"{folder}/in"), out, checkpoint)

    def state(path):
        return {r.key: (float(r.price), float(r.highest)) for r in feeds.read_current(spark, path).collect()}

    assert state(out) == {"a": (90, 200), "b": (49.5, 50)}
    assert [r.key for r in feeds.stream_drops(feeds.read_current(spark, out)).collect()] == ["a"]
    # a batch that runs again replaces its own delta
    again = spark.read.schema(SCHEMA).parquet(f"{folder}/in/2")
    feeds.write_batch(feeds.price_delta(again), f"{out}/delta", 1)
    assert state(out) == {"a": (90, 200), "b": (49.5, 50)}
    before = state(out)
    feeds.compact(spark, out)
    feeds.compact(spark, out)
    assert state(out) == before


def test_daily_closes_days_by_watermark(spark):
    folder = scratch_dir(spark, "daily")
    write(spark, f"{folder}/in", 1, [("a", 1, 1, 10), ("a", 2, 20, 30), ("a", 3, 30, 7)])
    daily = feeds.stream_daily(stream(spark, f"{folder}/in"))
    feeds.run_to_end(daily, f"{folder}/out", f"{folder}/checkpoint")
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert [(str(r.day), float(r.last_price), float(r.min_price), float(r.avg_price), r.samples) for r in rows] == [
        ("2024-01-01", 30, 10, 20, 2)
    ]


def test_dedup_over_batches(spark):
    folder = scratch_dir(spark, "dedup")
    for n in (1, 2):
        write(spark, f"{folder}/in", n, [("a", 1, 1, 10), ("a", 2, 2, 11)])
    unique = feeds.stream_dedup(stream(spark, f"{folder}/in"), ["key", "event_id"])
    feeds.run_to_end(unique, f"{folder}/out", f"{folder}/checkpoint")
    assert spark.read.parquet(f"{folder}/out").count() == 2


def test_ingest_batch_rerun_adds_nothing(spark):
    path = scratch_dir(spark, "ingest")
    batch = spark.sql(
        """SELECT * FROM VALUES
        ('a','1','p','Ron 750 ml','u',CAST(NULL AS STRING),'Viejo','A/B','img',CAST(10 AS DECIMAL(18,2)),CAST(NULL AS DECIMAL(18,2)),'COP',true,'[]',TIMESTAMP'2024-01-01'),
        ('a','1','p','Ron 750 ml','u',NULL,'Viejo','A/B',NULL,CAST(9 AS DECIMAL(18,2)),NULL,'COP',true,'[]',TIMESTAMP'2024-01-02'),
        ('a','2','p','','u',NULL,'Viejo','A/B',NULL,CAST(9 AS DECIMAL(18,2)),NULL,'COP',true,'[]',TIMESTAMP'2024-01-02')
        AS t(store_slug,sku,store_product_id,title,url,barcode,brand,category_path,image_url,price,list_price,currency,available,teasers,captured_at)"""
    )
    for _ in range(2):
        feeds.write_ingest_batch(batch, path, 0)
    assert spark.read.parquet(f"{path}/prices").count() == 2
    assert spark.read.parquet(f"{path}/rejected").count() == 1
    [r] = feeds.read_listings(spark, path).collect()
    assert (r.image_url, r.first_seen_at, r.last_seen_at) == ("img", datetime(2024, 1, 1), datetime(2024, 1, 2))


def plain_alerts(batches, ratio=98):
    """Crossings, one point after the other."""
    out, state = [], {}
    for batch in batches:
        for key, i, h, p in sorted(batch, key=lambda r: (r[2], r[1])):
            highest, newest, below = state.get(key, (0, None, False))
            highest = max(highest, p)
            newest = max(newest, (h, i, p)) if newest else (h, i, p)
            now = 100 * newest[2] < ratio * highest
            if now and not below:
                out.append((key, i, newest[2], highest))
            state[key] = (highest, newest, now)
    return sorted(out)


def test_alerts_over_batches(spark):
    """One alert per crossing, late points, several crossings in one batch and a fold of the state."""
    rng = random.Random(5)
    prices = [100, 99, 97, 90, 103, 80]
    batches = [[("abc"[rng.randrange(3)], 100 * n + k, rng.randrange(60) + 40 * n, rng.choice(prices)) for k in range(60)] for n in range(6)]
    batches[0] += [("x", 9001, 0, 100), ("x", 9002, 5, 90), ("x", 9003, 6, 89), ("x", 9004, 7, 99), ("x", 9005, 8, 90)]
    batches[1] += [("y", 9006, 50, 50)]
    batches[2] += [("y", 9007, 20, 60), ("x", 9008, 90, 85)]  # y: a late point raises the highest price
    folder = scratch_dir(spark, "alerts")
    for n, batch in enumerate(batches):
        write(spark, f"{folder}/in", n, batch)
        feeds.stream_alerts(stream(spark, f"{folder}/in"), folder, f"{folder}/checkpoint", fold_every=2)
    got = sorted((r.key, r.event_id, float(r.price), float(r.highest)) for r in spark.read.parquet(f"{folder}/alerts").collect())
    want = plain_alerts(batches)
    assert got == want
    assert [r[1] for r in want if r[0] in "xy"] == [9002, 9005, 9007]
    # a batch that runs again sees the state before it and writes the same alerts
    points = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/in/5")
    again = feeds.crossings(points, feeds.price_deltas(folder).state(spark, 5))
    assert sorted(r.event_id for r in again.collect()) == sorted(r[1] for r in want if r[1] // 100 == 5)


def test_files_read_do_not_grow_with_batches(spark):
    folder = scratch_dir(spark, "folds")
    for n in range(14):
        batch = spark.createDataFrame([("a", n, START + timedelta(hours=n))], "key STRING, event_id BIGINT, ts TIMESTAMP").withColumn(
            "price", F.lit(100 - n).cast("decimal(18,2)")
        )
        deltas = feeds.price_deltas(folder)
        deltas.write(feeds.price_delta(batch), n)
        deltas.compact_if_due(spark, n, 3)
        [r] = feeds.read_current(spark, folder).collect()
        assert (float(r.price), float(r.highest)) == (100 - n, 100)
        paths, _ = deltas._parts(spark, None)
        assert len(paths) <= 5 and len(os.listdir(f"{folder}/delta")) <= 9
        # the state before the newest batch stays readable: it may run again
        if n:
            assert float(deltas.state(spark, n).first().newest.price) == 101 - n
    assert len(os.listdir(f"{folder}/base")) <= 2


def test_known_products_are_keyed_once_for_all_batches(spark, tmp_path, monkeypatch):
    t = GivenTables(spark, "/root/testdata/sf0.001")
    calls, seen = [], []
    monkeypatch.setattr(feeds, "write_ingest_batch", lambda batch, path, n, products, every: (calls.append(n), seen.append(products.columns)))
    t.deliveries.limit(40).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = feeds.file_stream(spark, str(tmp_path / "in"), t.deliveries.schema, files_per_trigger=1)
    feeds.stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), t.known_products)
    assert calls == [0, 1, 2, 3]
    assert all(c == ["identity_kind", "identity", "known_id"] for c in seen)


OBSERVED = """store_slug STRING, sku STRING, store_product_id STRING, title STRING, url STRING, barcode STRING, brand STRING,
    category_path STRING, image_url STRING, price DECIMAL(18,2), list_price DECIMAL(18,2), currency STRING, available BOOLEAN,
    teasers STRING, captured_at TIMESTAMP"""


def observed(spark, *rows):
    """(sku, title, barcode, image, price, hour) as observations of one store."""
    at = lambda h: None if h is None else START + timedelta(hours=h)
    full = [("a", s, "p", t, "u", c, "Viejo", "A/B", i, Decimal(p), None, "COP", True, "[]", at(h)) for s, t, c, i, p, h in rows]
    return spark.createDataFrame(full, OBSERVED)


def test_observations_of_one_moment_follow_the_batch_rule(spark):
    """The cheaper one stands, then the first title, in one batch or in two, also without a stamp."""
    rows = [
        ("1", "Ron 1 ml", None, "x", 9, 5), ("1", "Ron 2 ml", None, None, 8, 5), ("1", "Ron 3 ml", "7701234567890", None, 8, 4),
        ("2", "Vino 1 ml", None, None, 7, 5), ("2", "Vino 2 ml", None, None, 7, 5), ("3", "Gin 1 ml", None, None, 7, None),
        ("3", "Gin 2 ml", None, None, 7, 1),
    ]
    want = {r.sku: r.title for r in latest_update(observed(spark, *rows)).collect()}
    assert want == {"1": "Ron 2 ml", "2": "Vino 1 ml", "3": "Gin 2 ml"}
    for cut in (0, 1, 4, 6):
        path = scratch_dir(spark, "ties")
        for n, part in enumerate([rows[cut:], rows[:cut]]):
            feeds.write_ingest_batch(observed(spark, *part), path, n)
        got = {r.sku: r for r in feeds.read_listings(spark, path).collect()}
        assert {k: r.title for k, r in got.items()} == want
        assert (got["1"].image_url, got["1"].barcode, got["1"].quantity) == ("x", "7701234567890", 2)
        assert (got["1"].first_seen_at, got["1"].last_seen_at) == (START + timedelta(hours=4), START + timedelta(hours=5))
        assert got["3"].first_seen_at == got["3"].last_seen_at == START + timedelta(hours=1)


def test_products_are_looked_up_once_per_listing(spark):
    t = GivenTables(spark, "/root/testdata/sf0.001")
    delta = feeds.listing_delta(t.deliveries, t.known_products)
    text = delta._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join LeftOuter") < text.index("Aggregate [sku")  # the tree starts at its top
    counts = feeds.delivery_counts(feeds.quarantine(t.deliveries), delta, t.known_products)
    assert "LeftOuter, ((store_slug" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_a_delivery_is_written_in_row_groups_that_tasks_share(spark, tmp_path):
    rows = spark.range(400_000).select(F.sha2(F.col("id").cast("string"), 256).alias("title"))
    rows.coalesce(1).write.options(**streams.DELIVERED).parquet(str(tmp_path / "in"))
    [file] = (tmp_path / "in").glob("*.parquet")
    assert pq.ParquetFile(file).num_row_groups >= 2
