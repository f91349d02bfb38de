"""Key folders, batches written twice, and scans of day folders."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tendero.operators import current as cur
from tendero.operators import history as his
from tendero.operators import ingest as ing
from tendero.session import scratch_dir
from tendero.sources import keyed, sinks
from tendero.sources.tables import GivenTables, Tables
from tendero.workload.files import older_mart, stored_catalog

from .test_scale import plan


def rows(spark, n, price, start=0):
    return spark.range(start, start + n).selectExpr("concat('k', id) AS id", f"CAST({price} AS INT) AS price", "IF(id % 5 = 0, NULL, id) AS other")


def content(df):
    return sorted(map(tuple, df.select("id", "price", "other").collect()), key=repr)


def upsert(old, new):
    return ing.upsert(old, new, ["id"])


def test_a_merge_writes_the_touched_folders_alone(spark):
    path = scratch_dir(spark, "keyed")
    keyed.write_keyed(rows(spark, 2000, 1), path, ["id"], 64)
    assert len(os.listdir(f"{path}/data/version=0")) >= 64
    one = rows(spark, 1, 7, 42)
    assert len(keyed.merge_keyed(spark, path, one, upsert, 1)) == 1
    assert [d for d in os.listdir(f"{path}/data/version=1") if d.startswith("folder=")] and len(
        [d for d in os.listdir(f"{path}/data/version=1") if d.startswith("folder=")]
    ) == 1
    assert content(keyed.read_keyed(spark, path)) == content(upsert(rows(spark, 2000, 1), one))
    # new keys, known keys, a batch that comes again, and one without rows
    more = rows(spark, 300, 9, 1900)
    keyed.merge_keyed(spark, path, more, upsert, 2)
    want = content(upsert(upsert(rows(spark, 2000, 1), one), more))
    assert content(keyed.read_keyed(spark, path)) == want
    assert keyed.merge_keyed(spark, path, rows(spark, 5, 0), upsert, 2) == []
    assert keyed.merge_keyed(spark, path, rows(spark, 0, 0), upsert, 3) == []
    assert content(keyed.read_keyed(spark, path)) == want
    # a merge that removes all rows of its folders
    keyed.merge_keyed(spark, path, one, lambda old, new: old.join(new.select("id"), "id", "left_anti"), 4)
    assert content(keyed.read_keyed(spark, path)) == [r for r in want if r[0] != "k42"]
    before = content(keyed.read_keyed(spark, path))
    assert keyed.vacuum(spark, path, 1) > 0 and keyed.vacuum(spark, path, 1) == 0
    assert content(keyed.read_keyed(spark, path)) == before


def test_folders_are_packed(spark):
    path = scratch_dir(spark, "keyed")
    keyed.write_keyed(rows(spark, 100, 1), path, ["id"], 2)
    keyed.merge_keyed(spark, path, rows(spark, 10, 2), upsert, 1)
    files = [f for _, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_old_and_new_rows_read_the_catalog_as_written(spark):
    t = GivenTables(spark, "/root/testdata/sf0.001")
    text = plan(older_mart(t, stored_catalog).unionByName(stored_catalog(t)))
    assert "catalog-rows" in text and "lineitem" not in text


def test_a_failed_merge_is_not_seen_and_can_run_again(spark):
    path = scratch_dir(spark, "keyed")
    keyed.write_keyed(rows(spark, 100, 1), path, ["id"], 8)
    with pytest.raises(ValueError):
        keyed.write_keyed(rows(spark, 1, 1), path, ["id"], 8)
    before = content(keyed.read_keyed(spark, path))

    def broken(old, new):
        return upsert(old, new).withColumn("price", F.raise_error("lost").cast("int"))

    with pytest.raises(Exception, match="lost"):
        keyed.merge_keyed(spark, path, rows(spark, 50, 2), broken, 1)
    assert content(keyed.read_keyed(spark, path)) == before
    keyed.merge_keyed(spark, path, rows(spark, 50, 2), upsert, 1)
    assert content(keyed.read_keyed(spark, path)) == content(upsert(rows(spark, 100, 1), rows(spark, 50, 2)))


def test_an_exchange_by_key_deals_rows_to_their_folders(spark):
    for key in (["id"], ["id", "other"]):
        dealt = rows(spark, 3000, 1).repartition(24, *key)
        same = dealt.select(F.pmod(F.spark_partition_id(), F.lit(8)) == keyed.folder_of(key, 8))
        assert [r[0] for r in same.distinct().collect()] == [True]
    before = spark.conf.get(keyed.PARTITIONS)
    with keyed._exchanges_by_folder(spark, 64):
        assert int(spark.conf.get(keyed.PARTITIONS)) % 64 == 0
    assert spark.conf.get(keyed.PARTITIONS) == before


def test_rows_in_files_by_key_need_no_other_exchange(spark):
    path = scratch_dir(spark, "keyed")
    keyed.write_dealt(rows(spark, 2000, 1), f"{path}/old", ["id"], 8)
    keyed.write_dealt(rows(spark, 900, 2, 1500), f"{path}/new", ["id"], 8)
    old, new = spark.read.parquet(f"{path}/old"), spark.read.parquet(f"{path}/new")
    keyed.write_keyed(old, f"{path}/table", ["id"], 8, dealt=True)
    assert content(keyed.read_keyed(spark, f"{path}/table")) == content(old) == content(rows(spark, 2000, 1))
    keyed.merge_keyed(spark, f"{path}/table", new, upsert, 1, by_key=True, stored=True)
    assert content(keyed.read_keyed(spark, f"{path}/table")) == content(upsert(rows(spark, 2000, 1), rows(spark, 900, 2, 1500)))


def outer(old, new):
    """New rows beside old ones, by the key."""
    price = F.coalesce(new["price"], old["price"]).alias("price")
    return old.join(new, "id", "full_outer").select("id", price, F.coalesce(new["other"], old["other"]).alias("other"))


@pytest.mark.parametrize("by", [keyed.HASH, None])
@pytest.mark.parametrize("by_key", [True, False])
def test_merges_by_key_and_tables_of_the_old_hash(spark, by, by_key):
    path = scratch_dir(spark, "keyed")
    old, new = rows(spark, 500, 1), rows(spark, 300, 2, 400)
    if by:
        keyed.write_keyed(old, path, ["id"], 8)
    else:  # as it was written before: xxhash64, and a manifest that names no hash
        old.limit(0).write.parquet(f"{path}/schema")
        held = keyed._write(old, path, ["id"], 8, 0, keyed.OLD_HASH)
        keyed._commit(spark, path, dict.fromkeys(held, 0), ["id"], 8, 0, None)
    keyed.merge_keyed(spark, path, new, outer, 1, by_key=by_key)
    want = sorted([(f"k{i}", 2 if i >= 400 else 1, None if i % 5 == 0 else i) for i in range(700)], key=repr)
    assert content(keyed.read_keyed(spark, path)) == want
    # a second merge finds every key in its folder
    keyed.merge_keyed(spark, path, rows(spark, 700, 3), upsert, 2)
    assert content(keyed.read_keyed(spark, path)) == content(rows(spark, 700, 3))


def test_stored_updates_are_not_written_again(spark, monkeypatch):
    path = scratch_dir(spark, "keyed")
    rows(spark, 50, 2).write.parquet(f"{path}/new")
    keyed.write_keyed(rows(spark, 100, 1), f"{path}/table", ["id"], 8)
    monkeypatch.setattr(keyed, "scratch_dir", None)
    stored = spark.read.parquet(f"{path}/new")
    keyed.merge_keyed(spark, f"{path}/table", stored, upsert, 1, stored=True)
    assert content(keyed.read_keyed(spark, f"{path}/table")) == content(upsert(rows(spark, 100, 1), stored))
    assert stored.count() == 50


def test_empty_tables(spark):
    path = scratch_dir(spark, "keyed")
    keyed.write_keyed(rows(spark, 0, 1), path, ["id"], 8)
    assert keyed.read_keyed(spark, path).count() == 0
    keyed.merge_keyed(spark, path, rows(spark, 3, 1), upsert, 1)
    assert content(keyed.read_keyed(spark, path)) == content(rows(spark, 3, 1))


def observations(spark):
    return spark.range(400).selectExpr(
        "id % 10 AS listing_id", "id AS price_id", "CAST(id AS DECIMAL(18,2)) AS price",
        "CAST(NULL AS DECIMAL(18,2)) AS list_price", "TIMESTAMP'2024-01-01 12:00:00' + make_dt_interval(CAST(id / 10 AS INT)) AS captured_at",
    )


def test_a_batch_appended_twice_is_stored_once(spark):
    path = scratch_dir(spark, "prices")
    for _ in range(2):
        sinks.append_prices(observations(spark).filter("price_id < 20"), path, batch=1)  # two days
    sinks.append_prices(observations(spark).filter("price_id >= 20"), path, batch=2)
    stored = spark.read.parquet(path)
    assert stored.count() == 400 and stored.filter("batch = 1").select("day").distinct().count() == 2


def test_old_day_folders_are_not_read(spark):
    directory = scratch_dir(spark, "tables")
    sinks.append_prices(observations(spark), f"{directory}/prices", batch=0)
    tables = Tables(spark, directory)
    recent = his.history_array(tables, "2024-02-05", 10)
    assert re.search(r"PartitionFilters: \[.*day#\d+ >= 2024-01-26", plan(recent))
    assert sorted(map(repr, recent.collect())) == sorted(map(repr, his.collect_history(
        cur.daily_last_price(observations(spark).filter("captured_at >= TIMESTAMP'2024-01-26'")), ["listing_id"]).collect()))
    between = cur.between_dates(tables.prices, "2024-01-05", "2024-01-07")
    assert re.search(r"PartitionFilters: \[.*day#\d+ >= 2024-01-05.*day#\d+ <= 2024-01-07", plan(between))
    assert between.count() == cur.between_dates(observations(spark), "2024-01-05", "2024-01-07").count() == 20
    days = spark.range(40).selectExpr("DATE'2024-01-01' + CAST(id AS INT) AS day", "id AS n").write
    days.parquet(f"{directory}/days")
    few = spark.read.parquet(f"{directory}/days").filter("n IN (3, 4)")
    pruned = cur.on_days(tables.prices, few)
    assert "dynamicpruning" in plan(pruned)
    assert pruned.count() == cur.on_days(observations(spark), few).count() == 20
