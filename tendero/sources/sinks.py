"""Sinks: catalog and history exports, appends, replacing writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.monitor import export_manifest

# JSON repeats its field names in every line; readers unpack by the file's ending.
PACKED = {"compression": "gzip"}
# A packed file is read by one task, so a large task writes several.
FILE_ROWS = 1_000_000


def write_catalog(catalog: DataFrame, path: str, source: str, as_of: Column) -> None:
    """Products as JSON lines under ``products/``, a one-row ``manifest/`` beside them.

    The manifest counts what was written, so it is built from the written files.
    """
    catalog.write.mode("errorifexists").options(**PACKED, maxRecordsPerFile=FILE_ROWS).json(f"{path}/products")
    written = catalog.sparkSession.read.schema(catalog.schema).json(f"{path}/products")
    export_manifest(written, source, as_of).write.mode("errorifexists").json(f"{path}/manifest")


def wrapped_catalog(catalog: DataFrame, rows: int = 10_000) -> DataFrame:
    """The catalog as script text, split by id over assignments of at most ``rows`` each.

    One document would gather every row in one task. Products are dealt by id to as many
    heaps as an exchange has partitions and each heap is cut in the order of its ids, so
    the documents follow the size of the catalog without a count, and products travel
    once, as rows and not as text.
    """
    heaps = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.row_number().over(Window.partitionBy("_heap").orderBy("id"))
    dealt = catalog.withColumn("_heap", F.pmod(F.xxhash64("id"), F.lit(heaps)))
    return (
        dealt.withColumn("_document", F.floor((place - 1) / rows))
        .groupBy("_heap", "_document")
        .agg(
            F.concat(
                F.lit('window.__CATALOG__ = {"products":'),
                F.to_json(F.collect_list(F.struct(*catalog.columns))),
                F.lit("};"),
            ).alias("value")
        )
        .select("value")
    )


SUMMARY_COLUMNS = [
    "key", "name", "category", "store_name", "url", "count", "min_price", "max_price",
    "avg_price", "first_date", "last_date", "first_price", "last_price", "delta_cop", "delta_pct",
]


def csv_rows(summary: DataFrame) -> DataFrame:
    """Series summary as text: money with 2 decimals, percent with 4, '' for NULL."""

    def fixed(name: str, digits: int) -> Column:
        text = F.col(name).cast(f"decimal(38,{digits})").cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    money = ["min_price", "max_price", "avg_price", "first_price", "last_price", "delta_cop"]
    shaped = {name: fixed(name, 2) for name in money}
    shaped["delta_pct"] = fixed("delta_pct", 4)
    return summary.select(
        *[shaped.get(n, F.col(n).cast("string").alias(n)) for n in SUMMARY_COLUMNS]
    )


def write_history_csv(summary: DataFrame, path: str) -> None:
    csv_rows(summary).write.mode("errorifexists").option("header", True).option(
        "emptyValue", ""
    ).csv(path)


def write_history_json(export: DataFrame, points: DataFrame, path: str, scanned: DataFrame) -> None:
    """Nested series as JSON lines and a one-row header with the counts.

    ``scanned`` are the snapshot lines the points come from; the snapshots among
    them are counted as files.
    """
    export.write.mode("errorifexists").options(**PACKED, maxRecordsPerFile=FILE_ROWS).json(f"{path}/products")
    files = scanned.agg(F.count_distinct("snapshot_store", "snapshot_day").alias("files_analyzed"))
    counts = points.agg(F.count("*").alias("records_loaded"), F.count_distinct("key").alias("product_count"))
    both = files.unionByName(counts, allowMissingColumns=True)  # two rows
    header = both.agg(*[F.max(c).alias(c) for c in both.columns])
    header.write.mode("errorifexists").json(f"{path}/header")


def append_prices(prices: DataFrame, path: str, day: str = "captured_at", batch: int | None = None) -> None:
    """Append observations, one folder per day.

    Rows are rebalanced by day: AQE splits a day that holds a large share of
    the rows over many tasks and packs small days together. With a ``batch``
    number the rows lie under it, and the same batch written again replaces
    what it wrote before, so that a retry stores nothing twice.
    """
    dated = prices.withColumn("day", F.to_date(day)).hint("rebalance", "day")
    if batch is None:
        dated.write.mode("append").partitionBy("day").parquet(path)
    else:
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")


def write_snapshots(rows: DataFrame, path: str) -> None:
    """Scraped lines as snapshot folders named store_stamp.jsonl.

    Lines keep their order within a snapshot; a range exchange spreads a large
    snapshot over several part files, which sort by name in the same order.
    """
    stamp = F.date_format("snapshot_ts", "yyyyMMdd'T'HHmmss'Z'")
    named = rows.withColumn(
        "snapshot", F.concat("snapshot_store", F.lit("_"), stamp, F.lit(".jsonl"))
    )
    columns = [
        "store", "name", F.col("price").cast("double").alias("price_cop"), "url", "image_url",
        "category", "store_name", F.col("scraped_date").cast("string").alias("scraped_date"),
        F.col("list_price").cast("double").alias("list_price_cop"),
    ]
    ordered = named.repartitionByRange("snapshot", "line_order").sortWithinPartitions(
        "snapshot", "line_order"
    )
    packed = ordered.select("snapshot", *columns).write.options(**PACKED, maxRecordsPerFile=FILE_ROWS)
    packed.mode("errorifexists").partitionBy("snapshot").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version of a table; never the folder that is being read."""
    df.write.mode("errorifexists").parquet(path)
