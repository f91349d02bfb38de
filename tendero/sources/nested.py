"""Flattening of nested catalog entries and extraction from product pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.money import clean_list_price, money


def _present(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def flatten_catalog(entries: DataFrame, base_url: str, store_slug: str) -> DataFrame:
    """One listing per sellable item of a catalog entry.

    The first seller that carries an offer sets the price; items without a sku,
    an offer or a positive price are left out.
    """
    items = entries.select(
        F.col("productId").alias("store_product_id"),
        _present(F.col("brand")).alias("brand"),
        # the API sorts categories from the most specific to the most general
        F.regexp_replace(F.get("categories", F.lit(0)), "^/+|/+$", "").alias("category_path"),
        "productName", "link", "linkText",
        F.explode("items").alias("item"),
    )
    offer = F.get(
        # an empty offer counts as none
        F.filter("item.sellers", lambda s: s["commertialOffer"].isNotNull() & (F.to_json(s["commertialOffer"]) != "{}")), F.lit(0)
    )["commertialOffer"]
    priced = (
        items.withColumn("sku", _present(F.col("item.itemId")))
        .withColumn("offer", offer)
        .filter(F.col("sku").isNotNull() & (F.col("offer.Price") > 0))
    )
    listed = priced.select(
        F.lit(store_slug).alias("store_slug"),
        "sku",
        _present(F.col("store_product_id")).alias("store_product_id"),
        F.trim(
            F.coalesce(
                F.nullif(F.col("item.nameComplete"), F.lit("")),
                F.nullif(F.col("item.name"), F.lit("")),
                F.trim("productName"),
            )
        ).alias("title"),
        tx.absolute_url(
            F.lit(base_url), F.coalesce(F.nullif("link", F.lit("")), "linkText"), F.col("linkText")
        ).alias("url"),
        tx.clean_barcode("item.ean").alias("barcode"),
        "brand",
        "category_path",
        F.get("item.images", F.lit(0))["imageUrl"].alias("image_url"),
        money(F.col("offer.Price")).alias("price"),
        money(clean_list_price(F.col("offer.Price"), F.col("offer.ListPrice"))).alias("list_price"),
        (F.coalesce("offer.AvailableQuantity", F.lit(0)) != 0).alias("available"),
        F.coalesce("offer.Teasers", F.lit("[]")).alias("teasers"),
    )
    size = tx.parse_quantity("title")
    return listed.select(
        "*",
        tx.normalize_text("title").alias("normalized_title"),
        size["quantity"].alias("quantity"),
        size["unit"].alias("unit"),
    )


def extract_jsonld(pages: DataFrame, html: str = "html") -> DataFrame:
    """Price and image of the first JSON-LD product of each page.

    Pages without one keep their row, with NULLs.
    """
    blocks = F.regexp_extract_all(
        F.col(html), F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1)
    )
    product = F.get(
        F.filter(blocks, lambda b: F.get_json_object(b, "$.@type") == "Product"), F.lit(0)
    )

    def at(path: str) -> Column:
        value = F.get_json_object("_ld", path)
        kind = F.schema_of_variant(F.try_variant_get("_variant", path, "variant"))
        # an empty text and a zero number count as absent, a text "0" is a price
        zero = (kind != "STRING") & (F.coalesce(value.try_cast("double"), F.lit(0.0)) == 0)
        return F.when(~zero, F.nullif(value, F.lit("")))

    first = F.coalesce(F.get_json_object("_ld", "$.image[0]"), F.get_json_object("_ld", "$.image"))
    # an image given as an object has no link
    image = F.when(~F.substring(first, 1, 1).isin("{", "["), first)
    return (
        pages.withColumn("_ld", product)
        .withColumn("_variant", F.try_parse_json("_ld"))
        .select(
            *pages.columns,
            F.coalesce(
                at("$.offers.price"), at("$.offers.lowPrice"), at("$.offers.highPrice"),
                at("$.offers.offers[0].price"), at("$.offers.offers[0].listPrice"),
            ).alias("offer_price"),
            image.alias("image_url"),
        )
    )
