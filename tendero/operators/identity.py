"""The same product across shops: barcode, then attributes, then a new product.

The rule does not depend on the order in which listings arrive. A listing's
identity key is its barcode; without one its brand, quantity, unit and
normalized title if all are known; else the listing itself. Known products are
matched first. Every key that matches none becomes one new product whose id is
a digest of the key, so a second run over the same listings changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from .current import first_per
from .search import similar_candidates

LISTING_ORDER = ["store_slug", "sku"]


def exact_quantity(quantity: Column) -> Column:
    """A quantity as text with all its digits, three decimals at most, without zeros at the end."""
    text = quantity.cast("decimal(28,3)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def _attributes(listing: DataFrame) -> Column:
    present = (
        F.col("brand_slug").isNotNull()
        & (F.coalesce("quantity", F.lit(0.0)) != 0)
        & (F.coalesce("unit", F.lit("")) != "")
        & (F.col("normalized_title") != "")
    )
    return F.when(
        present,
        F.concat_ws(
            "|", "brand_slug", exact_quantity(F.col("quantity")), "unit",
            "normalized_title",
        ),
    )


def with_identity(listings: DataFrame) -> DataFrame:
    """Listings with the kind and text of their identity key."""
    keyed = listings.withColumn("brand_slug", tx.brand_slug("brand")).withColumn(
        "_attributes", _attributes(listings)
    )
    kind = (
        F.when(F.col("barcode").isNotNull(), "barcode")
        .when(F.col("_attributes").isNotNull(), "attributes")
        .otherwise("listing")
    )
    own = F.concat_ws("|", "store_slug", "sku")
    return keyed.select(
        *listings.columns,
        "brand_slug",
        kind.alias("identity_kind"),
        F.coalesce("barcode", "_attributes", own).alias("identity"),
    )


def new_product_id(kind: Column, key: Column) -> Column:
    """A 160 bit digest: no collisions among any number of products."""
    return F.sha1(F.concat_ws(":", kind, key))


def catalog_keys(catalog: DataFrame) -> DataFrame:
    """(identity_kind, identity, known_id) of known products with a usable key.

    A product with a barcode is never matched by attributes. Should two known
    products share a key, the smaller id stands for it. Keys made before stay as they are.
    """
    if "known_id" in catalog.columns:
        return catalog
    slugged = catalog.select(
        F.col("product_id").cast("string").alias("known_id"),
        "barcode",
        "brand_slug",
        F.col("quantity").cast("double").alias("quantity"),
        "unit",
        F.col("normalized_name").alias("normalized_title"),
    )
    key = F.coalesce("barcode", _attributes(slugged))
    kind = F.when(F.col("barcode").isNotNull(), "barcode").otherwise("attributes")
    return (
        slugged.select(kind.alias("identity_kind"), key.alias("identity"), "known_id")
        .filter(F.col("identity").isNotNull())
        .groupBy("identity_kind", "identity")
        .agg(F.min("known_id").alias("known_id"))
    )


def match_barcode(listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Listings with a barcode and the known product of that barcode, if any."""
    keys = catalog_keys(catalog).filter(F.col("identity_kind") == "barcode").drop("identity_kind")
    coded = with_identity(listings).filter(F.col("identity_kind") == "barcode")
    return coded.join(keys, "identity", "left")


def match_attributes(listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Listings without a barcode and the known product of the same attributes, if any."""
    keys = catalog_keys(catalog).filter(F.col("identity_kind") == "attributes").drop("identity_kind")
    described = with_identity(listings).filter(F.col("identity_kind") == "attributes")
    return described.join(keys, "identity", "left")


def seeds(identified: DataFrame) -> DataFrame:
    """The first listing of every identity key; each task sends one row per key."""
    rest = [c for c in identified.columns if c not in ("identity_kind", "identity")]
    first = first_per(identified, ["identity_kind", "identity"], [F.asc(c) for c in LISTING_ORDER])
    return first.select("identity_kind", "identity", *[c for c in LISTING_ORDER], *[c for c in rest if c not in LISTING_ORDER])


def resolve(listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every listing with product_id, match_method, match_confidence, needs_review.

    The known products and a key's first listing, found by aggregation, have one row per
    key each, so the listings cross the network once, by key, to meet both.
    """
    identified = with_identity(listings)
    key = ["identity_kind", "identity"]
    described = identified.filter(F.col("identity_kind") == "attributes")
    firsts = described.groupBy(*key).agg(F.min(F.struct(*LISTING_ORDER)).alias("seed"))
    rows = identified.join(catalog_keys(catalog), key, "left").join(firsts, key, "left")
    kind, known = F.col("identity_kind"), F.col("known_id").isNotNull()
    is_seed = F.coalesce((F.col("seed.store_slug") == F.col("store_slug")) & (F.col("seed.sku") == F.col("sku")), F.lit(False))
    by_attributes = (kind == "attributes") & (known | ~is_seed)
    method = F.when(kind == "barcode", "barcode").when(by_attributes, "attributes")
    confidence = F.when(kind == "barcode", lx.BARCODE_CONFIDENCE).when(
        by_attributes, lx.ATTRIBUTE_CONFIDENCE
    )
    return rows.select(
        *identified.columns,
        F.coalesce("known_id", new_product_id(kind, F.col("identity"))).alias("product_id"),
        method.alias("match_method"),
        confidence.alias("match_confidence"),
        method.isNull().alias("needs_review"),
        (~known).alias("is_new_product"),
    )


def unmatched(resolved: DataFrame) -> DataFrame:
    """Listings without evidence; they wait for review."""
    return resolved.filter(F.col("needs_review"))


def new_canonicals(listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Products to create: one per unmatched key, described by its first listing."""
    identified = with_identity(listings)
    fresh = seeds(identified).join(
        catalog_keys(catalog), ["identity_kind", "identity"], "left_anti"
    )
    return fresh.select(
        new_product_id(F.col("identity_kind"), F.col("identity")).alias("product_id"),
        "barcode",
        "brand_slug",
        F.regexp_replace("category_path", "^/+|/+$", "").alias("category_path"),
        F.col("title").alias("name"),
        F.col("normalized_title").alias("normalized_name"),
        "quantity",
        "unit",
        "image_url",
    )


def build_brands(listings: DataFrame) -> DataFrame:
    """One row per brand slug; the name written last stands, then the greater one."""
    named = listings.select(F.trim("brand").alias("name"), "captured_at").filter(
        F.coalesce(F.col("name"), F.lit("")) != ""
    )
    return (
        named.withColumn("slug", tx.slugify("name"))
        .groupBy("slug")
        .agg(F.max_by("name", F.struct("captured_at", "name")).alias("name"))
    )


def build_categories(listings: DataFrame) -> DataFrame:
    """One row per prefix of the category paths: slug, parent_slug, name, depth."""
    # many listings share a path: reduce to distinct paths before unfolding them
    paths = (
        listings.filter(F.coalesce("category_path", F.lit("")) != "")
        .groupBy("category_path")
        .agg(F.max("captured_at").alias("captured_at"))
    )
    nodes = paths.select("captured_at", F.explode(tx.path_prefixes("category_path")).alias("n"))
    return (
        nodes.select("captured_at", "n.*")
        .groupBy("slug")
        .agg(
            F.max_by("name", F.struct("captured_at", "name")).alias("name"),
            F.min("parent_slug").alias("parent_slug"),
            F.min("depth").alias("depth"),
        )
    )


def review_queue(listings: DataFrame, catalog: DataFrame, k: int = lx.CANDIDATES_PER_LISTING) -> DataFrame:
    """Listings that need review with their candidates (bounded by k each)."""
    waiting = listings.filter(F.col("needs_review"))
    best = similar_candidates(waiting, catalog, k)
    option = F.struct("place", F.col("product_id"), "name", "similarity")
    arrays = best.groupBy("normalized_title").agg(
        F.array_sort(F.collect_list(option)).alias("candidates")
    )
    return waiting.join(arrays, "normalized_title", "left")
