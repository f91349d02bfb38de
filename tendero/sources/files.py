"""File sources: snapshots, nested catalogs, exports, wrapped catalogs, matches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import dates, lexicon as lx
from ..functions import text as tx
from ..functions.money import money
from ..schemas import CATALOG_ENTRY, CATALOG_FILE_ROW, EXPORT_ROW, MATCH, SNAPSHOT_ROW
from ..session import remove

# A snapshot is a file, or a folder written by Spark, of this name.
# The store is tried from the start of a word only and without a step back: a path is
# searched for every line, and no other start can match more.
SNAPSHOT_NAME = r"(?<![^/_=])([^/_=]++)_([0-9]{8}T[0-9]{6}Z)\.jsonl"


def scan_snapshots(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Product lines of snapshot files with their store, stamp, day and line order.

    ``line_order`` sorts the lines of one snapshot as they stand in its files:
    part file, block within the file, row within the block.
    """
    # `store` in the row is the scraper's own; the file name's wins for grouping
    lines = (
        spark.read.schema(SNAPSHOT_ROW)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json*")
        .json(path)
    )
    file = F.col("_metadata.file_path")
    return lines.select(
        "*",
        F.regexp_extract(file, SNAPSHOT_NAME, 1).alias("snapshot_store"),
        dates.parse_stamp(F.regexp_extract(file, SNAPSHOT_NAME, 2)).alias("snapshot_ts"),
        F.struct(
            file.alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_order"),
    ).withColumn("snapshot_day", F.to_date("snapshot_ts"))


def priced_lines(lines: DataFrame) -> DataFrame:
    """Scanned lines with ``price`` and ``list_price`` as money."""
    return lines.withColumns({"price": money(F.col("price_cop")), "list_price": money(F.col("list_price_cop"))})


def list_snapshots(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, snapshot_store, snapshot_ts) of snapshot files, by their names.

    No file is opened: only the listing is read, which Spark spreads over tasks
    for large folders.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json*")
        .load(path)
        .select("path", "length")
    )
    return files.select(
        "*",
        F.regexp_extract("path", SNAPSHOT_NAME, 1).alias("snapshot_store"),
        dates.parse_stamp(F.regexp_extract("path", SNAPSHOT_NAME, 2)).alias("snapshot_ts"),
    )


def newest_files(listing: DataFrame, n: int) -> DataFrame:
    """Listed files of the newest n snapshots per store."""
    return listing.join(newest_snapshots(listing, n), ["snapshot_store", "snapshot_ts"], "left_semi")


def expired_files(listing: DataFrame, keep: int = lx.KEEP_SNAPSHOTS) -> DataFrame:
    """Listed files of older snapshots than the newest ``keep``; none for 0 or less.
    A file whose name has no store and stamp is no snapshot and does not expire."""
    named = listing.filter(F.col("snapshot_ts").isNotNull())
    if keep <= 0:
        return named.filter(F.lit(False))
    return named.join(newest_snapshots(named, keep), ["snapshot_store", "snapshot_ts"], "left_anti")


def remove_expired(spark: SparkSession, path: str | list[str], keep: int = lx.KEEP_SNAPSHOTS) -> int:
    """Remove the files of expired snapshots; the number removed."""
    return sum(remove(spark, r["path"]) for r in expired_files(list_snapshots(spark, path), keep).select("path").toLocalIterator())


def chosen_files(spark: SparkSession, path: str | list[str], n: int) -> list:
    """(path, snapshot_ts, place) of the files of the newest n snapshots per store, newest
    first. They come to the driver, which holds the paths of every scan anyway."""
    listing = list_snapshots(spark, path)
    keys = ["snapshot_store", "snapshot_ts"]
    chosen = listing.join(numbered_snapshots(listing).filter(F.col("place") <= n), keys)
    return chosen.select("path", "snapshot_ts", "place").orderBy("place", "path").collect()


def scan_files(spark: SparkSession, path: str | list[str], paths: list[str]) -> DataFrame:
    """``scan_snapshots`` of these files of ``path``, which may be none."""
    return scan_snapshots(spark, paths) if paths else scan_snapshots(spark, path).filter(F.lit(False))


def scan_newest_snapshots(spark: SparkSession, path: str | list[str], n: int = 1) -> DataFrame:
    """``scan_snapshots`` of the newest n snapshots per store; no other file is read."""
    return scan_files(spark, path, [r.path for r in chosen_files(spark, path, n)])


def numbered_snapshots(rows: DataFrame) -> DataFrame:
    """(snapshot_store, snapshot_ts, place): snapshots with their place per store, newest first."""
    newest_first = Window.partitionBy("snapshot_store").orderBy(F.desc("snapshot_ts"))
    return rows.select("snapshot_store", "snapshot_ts").distinct().withColumn("place", F.row_number().over(newest_first))


def newest_snapshots(rows: DataFrame, n: int) -> DataFrame:
    """(snapshot_store, snapshot_ts) of the newest n snapshots per store."""
    return numbered_snapshots(rows).filter(F.col("place") <= n).drop("place")


def latest_snapshots(rows: DataFrame, n: int = 1) -> DataFrame:
    """Rows of the newest n snapshots per store.

    The kept list has one row per snapshot, not per product; whether it is
    broadcast is left to the size check of the planner.
    """
    return rows.join(newest_snapshots(rows, n), ["snapshot_store", "snapshot_ts"], "left_semi")


def retain_snapshots(rows: DataFrame, keep: int = lx.KEEP_SNAPSHOTS) -> DataFrame:
    """What is left after dropping all but the newest ``keep``; 0 or less keeps all."""
    return rows if keep <= 0 else latest_snapshots(rows, keep)


def scan_catalog_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Nested catalog entries, one JSON object per line."""
    return spark.read.schema(CATALOG_ENTRY).json(path)


# What stands before and behind the records of a list, an object or a script.
LIST_HEAD = r'\A\s*(?:window\.__CATALOG__\s*=\s*)?(?:\{[^\[\]]*?"products"\s*:\s*)?\['
LIST_TAIL = r"\]\s*(?:\}\s*)?(?:;\s*)?\z"
RECORD_END = "},"


def split_records(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, list[str]]:
    """(file, place, p): the records of JSON lists, cut at the ends of objects by the reader,
    so that a large document is read by several tasks; and the files that cannot be
    cut so. A file can if every piece of it is an object by itself, which no piece of
    a nested object or of a text is: where one does not parse, the file is left out
    and has to be read whole.
    """
    pieces = spark.read.option("lineSep", RECORD_END).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    # one row per block of a file: where its pieces begin
    blocks = pieces.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    blocks = blocks.select(
        "file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("pieces")
    )
    placed = pieces.join(blocks, ["file", "block"]).withColumn("place", F.col("before") + F.col("row") - F.col("first"))
    is_last = F.col("place") == F.col("pieces") - 1
    body = F.when(F.col("place") == 0, F.regexp_replace("value", LIST_HEAD, "")).otherwise(F.col("value"))
    body = tx.strip(F.when(is_last, F.regexp_replace(body, LIST_TAIL, "")).otherwise(F.concat(body, F.lit("}"))))
    headed = (F.col("place") > 0) | F.col("value").rlike(LIST_HEAD)
    tailed = ~is_last | F.col("value").rlike(LIST_TAIL)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = placed.select(
        "file", F.col("place").cast("int").alias("place"), F.from_json(body, f"{schema}, _bad STRING", options).alias("p"),
        (headed & tailed & F.startswith(body, F.lit("{"))).alias("fine"),
    )
    broken = parsed.filter(~F.col("fine") | F.col("p").isNull() | F.col("p._bad").isNotNull()).select("file").distinct()
    files = [r.file for r in broken.collect()]  # paths of files, which the driver lists for every scan
    return parsed.filter(~F.col("file").isin(files)) if files else parsed, files


def parse_export(documents: DataFrame, column: str = "value") -> DataFrame:
    """Products of JSON export documents: a list, or an object with ``products``."""
    body = F.trim(F.col(column))
    wrapped = F.from_json(body, f"products ARRAY<STRUCT<{EXPORT_ROW}>>")["products"]
    bare = F.from_json(body, f"ARRAY<STRUCT<{EXPORT_ROW}>>")
    items = F.when(F.startswith(body, F.lit("[")), bare).otherwise(wrapped)
    return export_rows(documents.select(F.posexplode(items).alias("place", "p")))


def export_rows(records: DataFrame) -> DataFrame:
    """Products of parsed export records (place, p)."""
    # an entry without an id is numbered by its place in the document
    p = records.select("place", "p.*")
    own = F.when(F.coalesce("id", F.lit("")).isin("", "0"), F.col("place").cast("string")).otherwise(F.col("id"))

    def first_text(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])

    return p.select(
        own.alias("id"),
        tx.strip(first_text("title", "name")).alias("title"),
        tx.strip("store").alias("store"),
        tx.strip(first_text("store_name", "store")).alias("store_name"),
        tx.strip(F.coalesce(first_text("category"), F.lit(lx.OTHER_CATEGORY))).alias("category"),
        F.coalesce("price", "price_cop").alias("price"),
        first_text("img", "image_url", "image").alias("img"),
        tx.strip(F.coalesce("url", F.lit(""))).alias("url"),
        first_text("scraped_date", "updated_at").alias("scraped_date"),
    ).filter((F.col("title") != "") & (F.col("store") != "") & F.col("price").isNotNull())


def scan_export(spark: SparkSession, path: str | list[str], per_line: bool = False) -> DataFrame:
    """Products of export files, one document per file (or per line)."""
    return parse_export(spark.read.text(path, wholetext=not per_line))


def scan_large_exports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``scan_export`` of one document per file, a large document read by several tasks."""
    records, whole = split_records(spark, path, EXPORT_ROW)
    rows = export_rows(records)
    return rows.unionByName(scan_export(spark, whole)) if whole else rows


def scan_large_catalogs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``scan_wrapped_catalog`` of one script per file, a large one read by several tasks."""
    records, whole = split_records(spark, path, CATALOG_FILE_ROW)
    names = StructType.fromDDL(CATALOG_FILE_ROW).names
    rows = records.select(*(F.col(f"p.{c}").alias(c) for c in names))
    return rows.unionByName(scan_wrapped_catalog(spark, whole)) if whole else rows


def parse_wrapped_catalog(documents: DataFrame, column: str = "value") -> DataFrame:
    """Products of ``window.__CATALOG__ = {...};`` scripts."""
    body = F.regexp_extract(
        F.col(column), r"(?s)window\.__CATALOG__\s*=\s*(\{.*\})\s*;\s*$", 1
    )
    schema = f"products ARRAY<STRUCT<{CATALOG_FILE_ROW}>>"
    return documents.select(F.explode(F.from_json(body, schema)["products"]).alias("p")).select(
        "p.*"
    )


def scan_wrapped_catalog(
    spark: SparkSession, path: str | list[str], per_line: bool = False
) -> DataFrame:
    return parse_wrapped_catalog(spark.read.text(path, wholetext=not per_line))


def parse_matches(documents: DataFrame, column: str = "value") -> DataFrame:
    """Match calendar rows; items are date strings or objects, bad dates are dropped."""
    items = documents.select(F.explode(F.from_json(F.col(column), "ARRAY<STRING>")).alias("item"))
    is_object = F.startswith(F.ltrim("item"), F.lit("{"))
    entry = F.when(is_object, F.from_json("item", MATCH))
    text = lambda name: F.nullif(F.trim(F.col("m")[name]), F.lit(""))
    rows = items.select("item", entry.alias("m"))
    return rows.select(
        dates.parse_date(F.when(F.col("m").isNull(), F.col("item")).otherwise(F.col("m.date"))).alias(
            "date"
        ),
        F.coalesce(text("label"), text("opponent"), F.lit(lx.DEFAULT_MATCH_LABEL)).alias("label"),
        text("opponent").alias("opponent"),
        text("venue").alias("venue"),
    ).filter(F.col("date").isNotNull())


def scan_matches(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Match calendar of JSON files, a folder or a pattern; where nothing is, an empty calendar."""
    try:
        text = spark.read.text(path, wholetext=not per_line)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "date DATE, label STRING, opponent STRING, venue STRING")
    return parse_matches(text)
