"""Price observations as an unbounded feed.

State that outlives a batch is kept as small per-batch deltas (one row per key
touched), written under the batch's number: a batch that runs again after a
failure replaces its own delta, and a batch costs what it touches, not what is
stored. Readers merge the deltas; every so many batches they are folded into a
base, readers take the newest base and the deltas after it, and what two bases
cover is removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.money import from_cents, is_drop, mean_money
from ..operators.identity import catalog_keys, new_product_id, resolve, with_identity
from ..operators.ingest import bad_rows, good_rows, quarantine
from ..session import children, remove

FOLD_EVERY = 16  # batches between two bases


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
    files_per_trigger: int = 1000,
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def as_points(events: DataFrame) -> DataFrame:
    """Raw events as price points. The stamp is cast: a watermark needs a zoned one."""
    return events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("key"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        from_cents(F.round(F.col("value") * 100)).alias("price"),
    )


def stream_dedup(points: DataFrame, keys: list[str], delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Drop observations delivered again within the delay."""
    return points.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_daily(points: DataFrame, delay: str = "1 hour", key: str = "key") -> DataFrame:
    """Last, lowest, highest and mean price per key and day, once the day is closed."""
    last = F.max_by("price", F.struct("ts", "event_id"))
    return (
        points.withWatermark("ts", delay)
        .groupBy(key, F.window("ts", "1 day").alias("w"))
        .agg(
            last.alias("last_price"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            mean_money("price").alias("avg_price"),
            F.count("*").alias("samples"),
        )
        .select(key, F.to_date("w.start").alias("day"), "last_price", "min_price", "max_price", "avg_price", "samples")
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into parquet files and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, write, checkpoint: str) -> None:
    """Process what is there through ``write(batch, batch_id)`` and stop."""
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


PACKED = {"compression": "zstd"}  # deltas are written, read and folded: fewer bytes are worth the time


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch's rows under its number, so that a retry does not add them twice."""
    df.write.mode("overwrite").options(**PACKED).parquet(f"{path}/batch_id={batch_id}")


@dataclass(frozen=True)
class Deltas:
    """Per-batch deltas in ``deltas`` and their folds in ``bases``; ``merge`` makes one
    row per key of any number of them, in any order."""

    deltas: str
    bases: str
    merge: Callable[[DataFrame], DataFrame]

    def _numbers(self, spark: SparkSession, path: str, name: str) -> list[int]:
        there = [int(c.split("=")[1]) for c in children(spark, path) if c.startswith(f"{name}=")]
        return sorted(n for n in there if "_SUCCESS" in children(spark, f"{path}/{name}={n}"))

    def _parts(self, spark: SparkSession, before: int | None) -> tuple[list[str], int]:
        """The folders that hold the state of all batches (below ``before``), and the newest
        batch among them. A base that holds later batches does not count."""
        fine = [n for n in self._numbers(spark, self.bases, "upto") if before is None or n < before]
        base = max(fine, default=-1)
        later = [n for n in self._numbers(spark, self.deltas, "batch_id") if n > base and (before is None or n < before)]
        paths = [f"{self.bases}/upto={base}"] if base >= 0 else []
        return paths + [f"{self.deltas}/batch_id={n}" for n in later], max([base, *later])

    def write(self, df: DataFrame, batch_id: int) -> None:
        write_batch(df, self.deltas, batch_id)

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The delta of one batch."""
        return spark.read.parquet(f"{self.deltas}/batch_id={batch_id}")

    def state(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """One row per key after all batches, or after those below ``before``; None without any."""
        paths, _ = self._parts(spark, before)
        if not paths:
            return None
        rows = spark.read.parquet(*paths)
        return rows if len(paths) == 1 else self.merge(rows)  # a single part is merged already

    def compact(self, spark: SparkSession, before: int | None = None) -> None:
        """Fold all batches (below ``before``) into a new base, and remove what the base
        before it covers: a reader that took that one still finds all it needs."""
        paths, upto = self._parts(spark, before)
        bases = self._numbers(spark, self.bases, "upto")
        if len(paths) < 2 and (upto in bases or not paths):
            return
        self.merge(spark.read.parquet(*paths)).write.mode("overwrite").options(**PACKED).parquet(f"{self.bases}/upto={upto}")
        previous = max((n for n in bases if n < upto), default=None)
        if previous is not None:
            for n in self._numbers(spark, self.deltas, "batch_id"):
                if n <= previous:
                    remove(spark, f"{self.deltas}/batch_id={n}")
            for n in bases:
                if n < previous:
                    remove(spark, f"{self.bases}/upto={n}")

    def compact_if_due(self, spark: SparkSession, batch_id: int, every: int | None) -> None:
        """Fold the batches below this one, which may run again, once ``every`` lie beyond
        the newest base. None: never."""
        paths, _ = self._parts(spark, batch_id)
        if every is not None and sum("/batch_id=" in p for p in paths) >= every:
            self.compact(spark, batch_id)


# --- current price and drops ------------------------------------------------


def price_delta(points: DataFrame, key: str = "key") -> DataFrame:
    """Per key the newest point and the highest price of a batch."""
    newest = F.max(F.struct("ts", "event_id", "price"))
    return points.groupBy(key).agg(newest.alias("newest"), F.max("price").alias("highest"))


def merge_deltas(deltas: DataFrame, key: str = "key") -> DataFrame:
    """Deltas of any number and order as one. An old stamp never replaces a newer one."""
    return deltas.groupBy(key).agg(F.max("newest").alias("newest"), F.max("highest").alias("highest"))


def price_deltas(path: str, key: str = "key") -> Deltas:
    return Deltas(f"{path}/delta", f"{path}/base", lambda rows: merge_deltas(rows, key))


def stream_current(points: DataFrame, path: str, checkpoint: str, key: str = "key", fold_every: int | None = FOLD_EVERY) -> None:
    """Maintain the current and the highest price of every key."""
    deltas = price_deltas(path, key)

    def write(batch: DataFrame, batch_id: int) -> None:
        deltas.write(price_delta(batch, key), batch_id)
        deltas.compact_if_due(batch.sparkSession, batch_id, fold_every)

    run_batches(points, write, checkpoint)


def read_current(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """Current and highest price of every key: the base and the deltas after it."""
    state = price_deltas(path, key).state(spark)
    if state is None:
        raise ValueError(f"no batch in {path}")
    return state.select(
        key,
        F.col("newest.price").alias("price"),
        F.col("newest.ts").alias("captured_at"),
        "highest",
    )


def compact(spark: SparkSession, path: str, key: str = "key") -> None:
    """Fold the base and all deltas so far into a new base; the stream must not run."""
    price_deltas(path, key).compact(spark)


def stream_drops(current: DataFrame, ratio: float = lx.DROP_RATIO) -> DataFrame:
    """Keys whose current price lies below ``ratio`` of the highest seen."""
    return current.filter(is_drop(F.col("price"), F.col("highest"), ratio))


def crossings(
    points: DataFrame, state: DataFrame | None = None, key: str = "key", ratio: float = lx.DROP_RATIO, slot: str = "hour"
) -> DataFrame:
    """(key, ts, event_id, price, highest): the points at which a key's current price comes
    to lie below ``ratio`` of the highest seen; none while it stays there.

    Points follow each other by stamp after what ``state`` (key, newest, highest) has
    seen. A late point does not become the current price, but may raise the highest
    and so bring the crossing about; ``price`` is the current one. Points without a
    price do not count. A key is cut into slots of time that carry on from each
    other, so that no task sorts all points of a key.
    """
    at = F.struct("ts", "event_id", "price")
    slotted = points.filter(F.col("price").isNotNull()).select(key, "ts", "event_id", "price", F.date_trunc(slot, "ts").alias("_slot"))
    slots = slotted.groupBy(key, "_slot").agg(F.max(at).alias("newest"), F.max("price").alias("highest"))
    known = slots if state is None else slots.unionByName(
        state.join(slots.select(key).distinct(), key, "left_semi").select(key, F.lit(None).cast("timestamp").alias("_slot"), "newest", "highest")
    )
    before = Window.partitionBy(key).orderBy(F.asc_nulls_first("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    carried = known.select(key, "_slot", F.max("newest").over(before).alias("_newest"), F.max("highest").over(before).alias("_highest"))
    inside = Window.partitionBy(key, "_slot").orderBy("ts", "event_id", "price")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (
        slotted.join(carried.filter(F.col("_slot").isNotNull()), [key, "_slot"])
        .withColumn("current", F.greatest("_newest", F.max(at).over(so_far)))
        .withColumn("highest", F.greatest("_highest", F.max("price").over(so_far)))
    )
    below = running.withColumn("_below", is_drop(F.col("current.price"), F.col("highest"), ratio))
    carried_below = F.coalesce(is_drop(F.col("_newest.price"), F.col("_highest"), ratio), F.lit(False))
    was = F.coalesce(F.lag("_below").over(inside), carried_below)
    crossed = below.withColumn("_was", was).filter(F.col("_below") & ~F.col("_was"))
    return crossed.select(key, "ts", "event_id", F.col("current.price").alias("price"), "highest")


def stream_alerts(
    points: DataFrame, path: str, checkpoint: str, key: str = "key", ratio: float = lx.DROP_RATIO, fold_every: int | None = FOLD_EVERY
) -> None:
    """Maintain the current prices as ``stream_current`` does, and write an alert under
    ``alerts`` whenever a key crosses the ratio. A batch that runs again starts from
    the state before it and replaces its own alerts."""
    deltas = price_deltas(path, key)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch(crossings(batch, deltas.state(spark, batch_id), key, ratio), f"{path}/alerts", batch_id)
        deltas.write(price_delta(batch, key), batch_id)
        deltas.compact_if_due(spark, batch_id, fold_every)

    run_batches(points, write, checkpoint)


# --- ingest -----------------------------------------------------------------


def normalized(observations: DataFrame) -> DataFrame:
    """Good observations with normalized title and size."""
    return tx.with_quantity(observations.withColumn("normalized_title", tx.normalize_text("title")))


def prepare_listings(observations: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Good observations with normalized title, size and their product.

    Known ``products`` are matched by the identity key as in a batch; for a key that
    matches none the product id is a function of the key alone, so a stream needs
    no look at what it has stored to link a listing.
    """
    identified = with_identity(normalized(observations))
    created = new_product_id(F.col("identity_kind"), F.col("identity"))
    if products is None:
        return identified.withColumn("product_id", created)
    known = identified.join(catalog_keys(products), ["identity_kind", "identity"], "left")
    return known.withColumn("product_id", F.coalesce("known_id", created)).drop("known_id")


# The newest observation is the first of this order, as in ``ingest.latest_update``.
LISTING_ORDER = ["age", "price", "title", "url"]
LISTING_SEEN = ["category_path", "store_product_id", "barcode", "brand"]
LISTING_MADE = ["normalized_title", "quantity", "unit", "product_id", "identity_kind"]
NO_STAMP = 2**63 - 1  # the age of an observation without a stamp


def newest_observations(observations: DataFrame) -> DataFrame:
    """Per listing the newest observation as ``newest``, the newest known ``image`` and
    ``code`` and the age of the first sight.

    All stamps are ages: equal numbers side by side take little room on the network.
    """

    def known(c: str):
        return F.min(F.when(F.col(c).isNotNull(), F.struct("age", c)))

    aged = observations.withColumn("age", F.coalesce(-F.unix_micros(F.col("captured_at").cast("timestamp")), F.lit(NO_STAMP)))
    # the sku comes first: it tells more rows apart when they are sorted
    return aged.groupBy("sku", "store_slug").agg(
        F.min(F.struct(*LISTING_ORDER, *LISTING_SEEN)).alias("newest"),
        known("image_url").alias("image"),
        known("barcode").alias("code"),
        F.max(F.nullif("age", F.lit(NO_STAMP))).alias("first_age"),
    )


def listing_delta(observations: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """One row per listing of good observations, its newest one linked to a product.

    Titles are normalized and products looked up for the newest observations alone.
    """

    def stamp(age):
        return F.timestamp_micros(-F.nullif(age, F.lit(NO_STAMP)))

    def known(value: str, c: str):
        found = F.struct(stamp(F.col(f"{value}.age")).alias("captured_at"), F.col(f"{value}.{c}"))
        return F.when(F.col(value).isNotNull(), found).alias(c)

    newest = newest_observations(observations)
    rest = [c for c in newest.columns if c != "newest"]
    return prepare_listings(newest.select(*rest, "newest.*"), products).select(
        "store_slug", "sku",
        F.struct(*LISTING_ORDER, *LISTING_SEEN, *LISTING_MADE).alias("newest"),
        known("image", "image_url"), known("code", "barcode"),
        stamp(F.col("first_age")).alias("first_seen_at"), stamp(F.col("age")).alias("last_seen_at"),
    )


def delivery_counts(checked: DataFrame, listings: DataFrame, products: DataFrame | None) -> DataFrame:
    """Counts of one delivery per store; with known products also the new, matched and
    unsure ones among its ``listings`` (a ``listing_delta``)."""
    counts = checked.groupBy("store_slug").agg(
        F.count("*").alias("products_found"),
        F.count_if(F.size("errors") == 0).alias("prices_written"),
        F.count_if(F.size("errors") > 0).alias("errors"),
    )
    if products is None:
        return counts
    keys = ["barcode", "brand", "normalized_title", "quantity", "unit"]
    resolved = resolve(listings.select("store_slug", "sku", *[f"newest.{c}" for c in keys]), products)
    matches = resolved.groupBy("store_slug").agg(
        F.count_if("is_new_product").alias("products_new"),
        F.count_if(~F.col("needs_review")).alias("matched"),
        F.count_if("needs_review").alias("needs_review"),
    )
    names = ["products_new", "matched", "needs_review"]
    return counts.join(matches, "store_slug", "left").select(
        *counts.columns, *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in names]
    )


def merge_listing_deltas(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sku", "store_slug").agg(
        F.min("newest").alias("newest"), *[F.max(c).alias(c) for c in ("image_url", "barcode")],
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )


LISTING_TEXT = [
    "title", "url", "normalized_title", "category_path", "quantity", "unit", "store_product_id", "product_id", "identity_kind",
]


def listing_deltas(path: str) -> Deltas:
    return Deltas(f"{path}/listings", f"{path}/listings-base", merge_listing_deltas)


def write_ingest_batch(
    batch: DataFrame, path: str, batch_id: int, products: DataFrame | None = None, fold_every: int | None = FOLD_EVERY
) -> None:
    """Listings, prices, rejected rows and counts of one delivery.

    The checked batch is kept while its four outputs are written, as far as it fits in
    memory; what does not fit, or is lost with an executor, is read again from the source.
    """
    spark = batch.sparkSession
    checked = quarantine(batch).persist(StorageLevel.MEMORY_ONLY)
    try:
        good = good_rows(checked)
        listings = listing_deltas(path)
        listings.write(listing_delta(good, products), batch_id)
        prices = good.select(
            "store_slug", "sku", "price", "list_price", "currency", "available", "teasers", "captured_at"
        )
        write_batch(prices, f"{path}/prices", batch_id)
        write_batch(bad_rows(checked), f"{path}/rejected", batch_id)
        write_batch(delivery_counts(checked, listings.read(spark, batch_id), products), f"{path}/runs", batch_id)
        listings.compact_if_due(spark, batch_id, fold_every)
    finally:
        checked.unpersist()


def stream_ingest(
    observations: DataFrame, path: str, checkpoint: str, products: DataFrame | None = None, fold_every: int | None = FOLD_EVERY
) -> None:
    """Deliveries to the end of the stream. The keys of known ``products`` are formed once
    for all batches, which then read one narrow row per key."""
    if products is not None:
        spark, at = products.sparkSession, f"{path}/known"
        catalog_keys(products).write.mode("overwrite").parquet(at)
        products = spark.read.parquet(at)
    run_batches(observations, lambda batch, n: write_ingest_batch(batch, path, n, products, fold_every), checkpoint)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings over all deliveries."""
    merged = listing_deltas(path).state(spark)
    if merged is None:
        raise ValueError(f"no delivery in {path}")
    return merged.select(
        "store_slug", "sku",
        *[F.col(f"newest.{c}").alias(c) for c in LISTING_TEXT],
        F.col("image_url.image_url").alias("image_url"),
        F.col("barcode.barcode").alias("barcode"),
        "first_seen_at", "last_seen_at",
    )
