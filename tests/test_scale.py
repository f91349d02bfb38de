"""Plans and results under skew."""

import re

import pytest
from pyspark.sql import functions as F

from tendero.operators import cart, current, history, parts
from tendero.plans import products
from tendero.sources.layout import buckets_of
from tendero.sources.tables import GivenTables
from tendero.workload import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Small, bounded inputs are the only ones that may be broadcast by a nested loop.
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "Scan ExistingRDD"):
        if word == "Scan ExistingRDD" and name == "n8_price_partitions":
            continue
        assert word not in text, word


def test_latest_price_is_limited_before_the_exchange(spark):
    text = plan(current.current_prices(GivenTables(spark, SF).prices))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_filters_and_columns_reach_the_scan(spark):
    t = GivenTables(spark, SF)
    text = plan(t.read("lineitem").filter("l_quantity > 40").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    text = plan(cart.cart_checks(t.carts))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text


def test_bucketed_tables_meet_without_an_exchange(spark):
    before, threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "20k"  # stores are small, listings are not
    for name in ("d1_bucketed_current_prices", "e3_bucketed_observations", "e2_bucketed_listing_prices"):
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            text = plan(QUERIES[name](spark, SF))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert not re.search(r"Exchange hashpartitioning\(listing_id", text), name
        assert "SelectedBucketsCount: 16 out of 16" in text, name


def test_buckets_follow_the_prices(spark):
    assert [buckets_of(spark.range(n), 16, 10) for n in (0, 1, 160, 161, 4000)] == [16, 16, 16, 32, 400]


def hot_points(spark, n):
    """A series with far more points than all others together."""
    key = F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(n).select(
        key.alias("key"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("date"),
        (F.col("id") % 7 + 1).cast("decimal(18,2)").alias("price"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"),
        F.lit("c").alias("category"), F.lit("s").alias("store_name"), F.lit("u").alias("url"),
    )


def test_long_history_comes_in_parts_and_stays_whole(spark):
    points = hot_points(spark, 9000)
    rows = history.series_histories(points, chunk=500).orderBy("key", "part").collect()
    parts = {}
    for r in rows:
        assert len(r.history) <= 500
        parts.setdefault(r.key, []).append(r)
    assert len(parts["hot"]) >= 12 and all(len(p) == 1 for k, p in parts.items() if k != "hot")
    assert [r.part for r in parts["hot"]] == list(range(1, len(parts["hot"]) + 1))
    got = {k: [(p.date, p.price_cop, p.name) for r in v for p in r.history] for k, v in parts.items()}
    want = {}
    for r in points.collect():
        want.setdefault(r.key, []).append((r.date, r.price, r.name))
    assert got == {k: sorted(v) for k, v in want.items()}


def test_the_export_forms_its_points_once(spark):
    points = hot_points(spark, 900)
    out = history.series_export(points, 500)
    assert "Range (" in plan(points) and "Range (" not in plan(out)
    hot = out.filter("key = 'hot'").orderBy("part").collect()
    assert [len(r.history) for r in hot] == [500, 100] and hot[1].daily_series is None
    whole = history.series_summary(points).filter("key = 'hot'").first()
    assert [hot[0][c] for c in whole.asDict()] == list(whole)
    days = history.daily_series(points).filter("key = 'hot'").orderBy("date").collect()
    assert [tuple(d) for d in hot[0].daily_series] == [tuple(d)[1:] for d in days]


def exchanges(df) -> list[str]:
    """The columns of the hash exchanges of a plan, without their numbers."""
    return [re.sub(r"#\d+L?", "", e) for e in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan(df))]


def test_sorted_rows_are_numbered_over_the_whole_table(spark):
    placed = parts.sorted_rows(hot_points(spark, 3000).select("key", "date", "price"), ["key"], ["date", "price"])
    got = [tuple(r) for r in placed.orderBy("_row").select("key", "date", "price").collect()]
    assert [r[0] for r in placed.select("_row").orderBy("_row").collect()] == list(range(3000)) and got == sorted(got)
    assert placed.inputFiles()[0].endswith(".zstd.parquet") and len(placed.inputFiles()) > 1
    empty = parts.in_parts(hot_points(spark, 0).select("key", "date"), ["key"], ["date"], ["date"], 5, "days")
    assert empty.count() == 0


def test_the_export_crosses_the_network_by_key_alone(spark):
    with_threshold(spark, "-1")
    try:
        by = exchanges(history.series_export(hot_points(spark, 900), 500))
        assert "key" in by and not [e for e in by if "date" in e or "part" in e or "_split" in e]
    finally:
        with_threshold(spark, None)


def with_threshold(spark, value):
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_long_history_is_split_by_aqe(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "30k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    points = hot_points(spark, 60_000)
    placed = history.sorted_points(points)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sizes = [F.size("history").alias("n"), F.size("daily_series").alias("days")]
        out = history.series_export(placed, 1000).select("key", "part", "count", *sizes)
        rows = out.collect()
        assert "skew=true" in plan(out)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    hot = sorted((r for r in rows if r.key == "hot"), key=lambda r: r.part)
    assert [r.n for r in hot] == [1000] * 40 and hot[0]["count"] == 40_000 and hot[0].days == 600
    assert sum(r.n for r in rows) == 60_000


def test_listings_and_prices_meet_once_in_a_detail(spark):
    t = GivenTables(spark, SF)
    assert "lineitem" not in plan(products.product_detail(t, 10))


def test_histories_join_where_the_prices_lie(spark):
    """Prices, the pairs of listings and the points cross by listing; whole catalog rows do not."""
    with_threshold(spark, "-1")
    try:
        by_listing = [e for e in exchanges(QUERIES["q2_table_catalog"](spark, SF)) if e == "listing_id"]
    finally:
        with_threshold(spark, None)
    assert len(by_listing) == 3


def test_hot_product_is_split_by_aqe(spark):
    """A product in most carts: the join to its offers runs as a skew join."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "30k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        hot = F.when(F.col("id") % 3 != 0, F.lit(7)).otherwise(F.col("id") % 1000)
        # several scan tasks, so that the hot partition has several blocks to split at
        lines = spark.range(0, 200000, 1, 16).select(
            F.floor(F.col("id") / 2).alias("cart_id"), hot.cast("bigint").alias("product_id"), F.lit(1).alias("quantity")
        )
        offers = spark.range(1000).select(
            F.col("id").alias("product_id"),
            F.array(F.struct(F.lit("s").alias("store_slug"), F.lit(2).cast("decimal(18,2)").alias("price"))).alias("offers"),
            F.struct(F.lit(2).cast("decimal(18,2)").alias("price"), F.lit("s").alias("store_slug")).alias("cheapest"),
        )
        priced = cart.priced_lines(lines, offers)
        out = cart.cart_comparison(priced)
        rows = out.collect()
        assert "skew=true" in plan(out)
        bad = lines.groupBy("cart_id", "product_id").count().filter("count > 1").select("cart_id").distinct().count()
        assert len(rows) == 100000 - bad
        assert {(r.best_total, r.cherry_pick_total) for r in rows} == {(4, 4)}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
