"""Snapshot files as a scraper leaves them, and the catalog built from them."""

import json
import os

from pyspark.sql import functions as F

from tendero.operators.current import daily_last_by_snapshot, first_by_url, valid_snapshot_rows
from tendero.plans import exports
from tendero.session import scratch_dir
from tendero.sources import files, sinks


def snapshot(folder, store, stamp, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{store}_{stamp}.jsonl", "w") as out:
        for r in rows:
            out.write((json.dumps(r) if r else "") + "\n")


def row(name, price, url, **more):
    return {"store": "exito", "name": name, "price_cop": price, "url": url, "scraped_date": "2024-01-01"} | more


def scan(spark, folder):
    rows = files.scan_snapshots(spark, folder)
    return rows.select(
        "*", F.col("price_cop").cast("decimal(18,2)").alias("price"), F.col("list_price_cop").cast("decimal(18,2)").alias("list_price")
    )


def test_snapshots(spark):
    folder = scratch_dir(spark, "raw")
    for day in range(1, 11):
        snapshot(folder, "exito", f"202401{day:02d}T080000Z", [row("Ron", 100 + day, "u1")])
    snapshot(
        folder, "exito", "20240110T200000Z",
        [row("Ron", 80, "u1", list_price_cop=120, category="ron_viejo"), None, row("Ron", 75, "u1"), row("Sin precio", None, "u2"), row("Sin url", 5, ""), row("Igual", 5, "u3", list_price_cop=5)],
    )
    snapshot(folder, "d1", "20240105T000000Z", [row("Agua", 3, "u9", store="d1")])
    rows = scan(spark, folder)
    assert rows.count() == 16
    assert {(r.snapshot_store, str(r.snapshot_ts)) for r in files.newest_snapshots(rows, 1).collect()} == {
        ("exito", "2024-01-10 20:00:00"), ("d1", "2024-01-05 00:00:00"),
    }
    assert files.latest_snapshots(rows, 8).filter("snapshot_store = 'exito'").select("snapshot_ts").distinct().count() == 8
    assert files.retain_snapshots(rows, 0).count() == 16
    first = {(r.url, float(r.price)) for r in first_by_url(valid_snapshot_rows(files.latest_snapshots(rows, 1))).collect()}
    assert first == {("u1", 80), ("u3", 5), ("u9", 3)}
    # the later snapshot of a day and its last line win
    days = {str(r.day): float(r.price) for r in daily_last_by_snapshot(rows).filter("url = 'u1'").collect()}
    assert days["2024-01-10"] == 75 and days["2024-01-03"] == 103

    no_matches = files.scan_matches(spark, f"{folder}/none.json")
    assert no_matches.count() == 0
    catalog = {r.title: r for r in exports.snapshot_catalog(rows, no_matches).collect()}
    ron = catalog["Ron"]
    assert (float(ron.price), float(ron.list_price), ron.category, len(ron.history)) == (80, 120, "Ron Viejo", 7)
    assert ron.pricing_context.has_discount and float(ron.pricing_context.current_price) == 75
    assert catalog["Igual"].list_price is None and catalog["Igual"].category == "Otros"


def test_matches_of_both_shapes(spark):
    folder = scratch_dir(spark, "matches")
    os.makedirs(folder)
    items = ["2026-01-10", {"date": "2026-01-12T10:00", "opponent": "Rival", "venue": " "}, {"date": "pronto"}, "nada", {"date": "2026-02-01", "label": " Final "}]
    with open(f"{folder}/m.json", "w") as out:
        json.dump(items, out, indent=1)
    rows = sorted((str(r.date), r.label, r.venue) for r in files.scan_matches(spark, f"{folder}/m.json").collect())
    assert rows == [("2026-01-10", "Real Cartagena local", None), ("2026-01-12", "Rival", None), ("2026-02-01", "Final", None)]


def test_exports_of_both_shapes(spark):
    folder = scratch_dir(spark, "exports")
    os.makedirs(folder)
    items = [{"id": 1, "name": " A ", "store": "s", "price_cop": 5}, {"title": "B", "store": "s"}, {"title": "C", "price": 1}]
    for name, body in {"list": items, "object": {"products": items}}.items():
        with open(f"{folder}/{name}.json", "w") as out:
            json.dump(body, out, indent=1)
    rows = files.scan_export(spark, folder).collect()
    assert [(r.title, r.store_name, r.category, r.price) for r in rows] == [("A", "s", "Otros", 5.0)] * 2
    with open(f"{folder}/c.js", "w") as out:
        out.write("window.__CATALOG__ = " + json.dumps({"products": [{"id": "x", "title": "T;}", "price": 2}]}) + ";\n")
    assert [(r.id, r.title) for r in files.scan_wrapped_catalog(spark, f"{folder}/c.js").collect()] == [("x", "T;}")]


def test_only_the_newest_snapshots_are_read(spark):
    folder = scratch_dir(spark, "raw")
    for store in ("exito", "d1"):
        for day in range(1, 13):
            snapshot(folder, store, f"202401{day:02d}T080000Z", [row("Ron", 100 + day, "u1", store=store), row("Vino", 50 + day, "u2", store=store)])
    with open(f"{folder}/notes.jsonl", "w") as out:  # no snapshot by its name
        out.write(json.dumps(row("Otro", 1, "u3")) + "\n")

    newest = files.scan_newest_snapshots(spark, folder, 3)
    names = {os.path.basename(f) for f in newest.inputFiles()}
    assert names == {f"{s}_202401{d}T080000Z.jsonl" for s in ("exito", "d1") for d in (10, 11, 12)}
    every = scan(spark, folder)
    assert sorted(map(tuple, newest.select("snapshot_store", "snapshot_ts", "url", "price_cop").collect())) == sorted(
        map(tuple, files.latest_snapshots(every, 3).select("snapshot_store", "snapshot_ts", "url", "price_cop").collect())
    )
    none = files.scan_matches(spark, f"{folder}/none.json")
    pruned = exports.snapshot_folder_catalog(spark, folder, none, 4)
    read = {os.path.basename(f) for f in pruned.inputFiles() if f.endswith("Z.jsonl")}
    assert read == {f"{s}_202401{d:02d}T080000Z.jsonl" for s in ("exito", "d1") for d in (9, 10, 11, 12)}
    whole = exports.snapshot_catalog(every, none, 4)
    assert sorted(map(repr, pruned.collect())) == sorted(map(repr, whole.collect())) and pruned.count() == 4

    listing = files.list_snapshots(spark, folder)
    assert files.expired_files(listing, 0).count() == 0 and files.expired_files(listing, 8).count() == 8
    assert files.remove_expired(spark, folder, 8) == 8
    assert sorted(os.listdir(folder))[:2] == ["d1_20240105T080000Z.jsonl", "d1_20240106T080000Z.jsonl"] and "notes.jsonl" in os.listdir(folder)
    empty = scratch_dir(spark, "raw")
    snapshot(empty, "x", "later", [])
    assert files.scan_newest_snapshots(spark, empty, 2).count() == 0


def test_large_documents_are_read_by_several_tasks(spark):
    folder = scratch_dir(spark, "large")
    os.makedirs(folder)
    items = [{"id": k if k % 5 else None, "title": f"T {k} " + "x" * 50, "store": "s", "price": k} for k in range(400)]
    odd = [{"id": 1, "title": 'has "},{" inside', "store": "s", "price": 1}, {"title": "b", "store": "s", "price": 2}]
    documents = {
        "list": items, "object": {"source": "x", "products": items}, "odd": odd, "more": {"products": items[:3], "total": 3}, "empty": [],
        "none": {"products": []}, "one": [{"title": "only", "store": "s", "price": 3}],
        "nested": [{"title": "n", "store": "s", "price": 4, "products": [{"title": "no"}, {"title": "no"}]}, {"title": "m", "store": "s", "price": 5}],
    }
    for name, body in documents.items():
        for indent in (None, 1):
            with open(f"{folder}/{name}-{indent}.json", "w") as out:
                json.dump(body, out, indent=indent)
    with open(f"{folder}/broken.json", "w") as out:
        out.write('[{"title": "lost", "store": "s", "price": 3},')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        whole = files.scan_export(spark, folder)
        cut, left = files.split_records(spark, folder, files.EXPORT_ROW)
        names = {os.path.basename(f) for f in left}
        assert {n for n in names if not n.startswith(("odd", "more", "empty", "none", "nested", "broken"))} == set() and "odd-None.json" in names
        assert cut.rdd.getNumPartitions() > 4
        got = files.scan_large_exports(spark, folder)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect())) and got.count() > 1500
        script = f"{folder}/c.js"
        with open(script, "w") as out:
            out.write("window.__CATALOG__ = " + json.dumps({"products": items}) + ";\n")
        assert sorted(map(repr, files.scan_large_catalogs(spark, script).collect())) == sorted(
            map(repr, files.scan_wrapped_catalog(spark, script).collect())
        )
        assert len({(r.file, r.block) for r in spark.read.option("lineSep", "},").text(script).selectExpr("_metadata.file_path AS file", "_metadata.file_block_start AS block").collect()}) > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_files_are_packed_and_keep_their_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 7)  # several files of a task
    rows = spark.range(50).selectExpr(
        "'s' AS store", "concat('n', id) AS name", "CAST(id AS DECIMAL(18,2)) AS price", "concat('u', id) AS url", "'' AS image_url",
        "'c' AS category", "'S' AS store_name", "DATE '2024-01-31' AS scraped_date", "CAST(id AS DECIMAL(18,2)) AS list_price",
        "'my-shop' AS snapshot_store", "TIMESTAMP '2024-01-31 10:00:00' AS snapshot_ts", "id AS line_order",
    )
    path = str(tmp_path / "snapshots")
    sinks.write_snapshots(rows, path)
    written = [p.name for p in tmp_path.rglob("part-*")]
    assert len(written) > 7 and all(n.endswith(".json.gz") for n in written)
    lines = files.scan_snapshots(spark, path)
    assert [r.name for r in lines.orderBy("line_order").collect()] == [f"n{i}" for i in range(50)]
    assert lines.select("snapshot_store", "snapshot_day").distinct().collect()[0][0] == "my-shop"
    sinks.write_catalog(rows.drop("line_order"), str(tmp_path / "catalog"), "x", F.lit("2024-01-31").cast("timestamp"))
    assert all(p.name.endswith(".gz") for p in (tmp_path / "catalog" / "products").glob("part-*"))


def test_snapshot_names_in_long_paths(spark):
    import re

    old = r"([^/_=]+)_([0-9]{8}T[0-9]{6}Z)\.jsonl"
    names = ["/a/b_c/snapshot=x-y_20240131T235959Z.jsonl/part-0.json", "/d_20240131T235959Z.jsonl", "_20240131T235959Z.jsonl",
             "/a_b_20240131T235959Z.jsonl", "/s_2024.jsonl", "/q_20240131T235959Z_20230131T235959Z.jsonl", "", "/a=b_20240131T235959Z.jsonl"]
    for n in names:
        want = re.search(old, n)
        got = spark.sql("SELECT 1").select(F.regexp_extract(F.lit(n), files.SNAPSHOT_NAME, 1), F.regexp_extract(F.lit(n), files.SNAPSHOT_NAME, 2)).first()
        assert tuple(got) == (want.groups() if want else ("", ""))
    assert "++" in files.SNAPSHOT_NAME  # no step back within a word


def test_documents_of_a_catalog_follow_its_size(spark, tmp_path):
    """At most so many products in each, whatever the ids; every product once, with its nulls left out."""
    rows = spark.range(1000).selectExpr("concat('n', id) AS id", "IF(id % 3 = 0, NULL, 'T\"];') AS title", "CAST(id AS DECIMAL(18,2)) AS price")
    documents = [r.value for r in sinks.wrapped_catalog(rows, 20).collect()]
    head, tail = 'window.__CATALOG__ = {"products":', "};"
    assert all(d.startswith(head + "[") and d.endswith("]" + tail) for d in documents)
    products = [json.loads(d[len(head) : -len(tail)]) for d in documents]
    assert max(map(len, products)) <= 20 and len(products) <= 50 + 8
    assert sorted(p["id"] for d in products for p in d) == sorted(f"n{i}" for i in range(1000))
    assert all(("title" in p) == (int(p["id"][1:]) % 3 != 0) for d in products for p in d)
    assert sinks.wrapped_catalog(rows.limit(0)).count() == 0
    rows_again = files.parse_wrapped_catalog(sinks.wrapped_catalog(rows, 20))
    assert rows_again.count() == 1000
