"""Declared schemas (DDL) of everything read from JSON. Nothing is inferred."""

from __future__ import annotations

# One scraped product per line of a snapshot file.
SNAPSHOT_ROW = """
    store STRING, name STRING, price_cop DOUBLE, url STRING, image_url STRING,
    category STRING, subcategory STRING, store_name STRING, source_page_url STRING,
    scraped_at STRING, scraped_date STRING, list_price_cop DOUBLE, raw STRING"""

# Nested entry of a store's catalog API. Field spelling is the API's own.
CATALOG_ENTRY = """productId STRING, productName STRING, brand STRING, link STRING, linkText STRING,
    categories ARRAY<STRING>,
    items ARRAY<STRUCT<itemId: STRING, ean: STRING, nameComplete: STRING, name: STRING,
        images: ARRAY<STRUCT<imageUrl: STRING>>,
        sellers: ARRAY<STRUCT<commertialOffer: STRUCT<Price: DOUBLE, ListPrice: DOUBLE,
            AvailableQuantity: INT, Teasers: STRING>>>>>"""

# One product of a JSON export, with every spelling its fields come in.
EXPORT_ROW = """id STRING, title STRING, name STRING, store STRING, store_name STRING,
    category STRING, price DOUBLE, price_cop DOUBLE, img STRING, image_url STRING,
    image STRING, url STRING, scraped_date STRING, updated_at STRING"""

# One product of the catalog file written for the web page.
CATALOG_FILE_ROW = """id STRING, sku STRING, title STRING, store STRING, store_name STRING,
    category STRING, price DOUBLE, list_price DOUBLE, img STRING, url STRING,
    scraped_date STRING"""

# One entry of the match calendar.
MATCH = "date STRING, label STRING, opponent STRING, venue STRING"

# One delivered listing observation, the unit of the ingest job.
OBSERVATION = """store_slug STRING, sku STRING, store_product_id STRING, title STRING, url STRING,
    barcode STRING, brand STRING, category_path STRING, image_url STRING,
    price DECIMAL(18,2), list_price DECIMAL(18,2), currency STRING, available BOOLEAN,
    teasers STRING, captured_at TIMESTAMP"""
