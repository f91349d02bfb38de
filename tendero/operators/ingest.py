"""Table maintenance: merges, pruning, quarantine, audits, price ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..sources.tables import Tables
from .current import first_per

LISTING_KEY = ["store_slug", "sku"]


# --- merges -----------------------------------------------------------------


def upsert(target: DataFrame, updates: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Target with updated rows replaced whole and new rows added.

    Of updates that share a key the first by ``order`` counts; without an order
    their own text decides, so that the result does not depend on arrival. Whether any
    share one is counted first, on the keys alone: without such, no update has to be
    ordered, and only columns that are asked for cross the network.
    """
    repeated = updates.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    one = updates
    if not repeated.isEmpty():
        one = first_per(updates, key, order or [F.asc(F.to_json(F.struct(*updates.columns)))])
    return one.unionByName(target.join(updates.select(*key).distinct(), key, "left_anti"))


def prune_global(target: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """Target rows that are still in the current catalog."""
    return target.join(current.select(key), key, "left_semi")


def stale_rows(target: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """Target rows that are not in the current catalog any more."""
    return target.join(current.select(key), key, "left_anti")


def prune_by_store(target: DataFrame, current: DataFrame) -> DataFrame:
    """Target without the stale rows of the stores that the catalog covers.

    The covered stores and the kept ids meet the target as two semi joins on
    flags, so the target is read once.
    """
    covered = current.filter(F.col("store").isNotNull()).select("store").distinct()
    kept = current.select("store", "id").distinct()
    return (
        target.join(covered.withColumn("_covered", F.lit(True)), "store", "left")
        .join(kept.withColumn("_kept", F.lit(True)), ["store", "id"], "left")
        .filter(F.col("_covered").isNull() | F.col("_kept").isNotNull())
        .select(*target.columns)
    )


def stale_by_store(target: DataFrame, current: DataFrame) -> DataFrame:
    """Rows that ``prune_by_store`` drops; ``removed_by_store`` counts them."""
    covered = current.filter(F.col("store").isNotNull()).select("store").distinct()
    kept = current.select("store", "id").distinct()
    return target.join(covered, "store", "left_semi").join(kept, ["store", "id"], "left_anti").select(*target.columns)


def removed_by_store(target: DataFrame, current: DataFrame) -> DataFrame:
    return stale_by_store(target, current).groupBy("store").agg(F.count("*").alias("removed"))


def ids_by_store(catalog: DataFrame, most: int = 10_000) -> DataFrame:
    """(store, part, ids[]): each store's ids in arrays of about ``most``.

    The number of parts follows the store's size, so a store with most of the
    catalog is spread over many arrays.
    """
    parts = catalog.groupBy("store").agg(F.ceil(F.count("*") / most).alias("parts"))
    return (
        catalog.select("store", "id")
        .join(parts, "store")
        .groupBy("store", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
        .agg(F.collect_set("id").alias("ids"))
    )


def latest_update(updates: DataFrame) -> DataFrame:
    """One update per listing, the last delivered; each task sends one row per listing."""
    order = [F.desc("captured_at"), F.asc("price"), F.asc("title"), F.asc("url")]
    return first_per(updates, LISTING_KEY, order)


def merge_listings(target: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Listings after a delivery, with ``inserted`` for the new ones.

    Title, link, path and raw are overwritten; image and barcode keep their old
    value when the update has none; first_seen_at and store_product_id stay, and so
    do the link to a product and whatever else the target carries.
    """
    new = latest_update(updates)
    t, u = target.alias("t"), new.alias("u")
    both = t.join(u, LISTING_KEY, "full_outer")
    updated = F.col("u.title").isNotNull()
    known = F.col("t.title").isNotNull()
    overwritten = [
        F.when(updated, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
        for c in ["title", "normalized_title", "url", "category_path", "raw"]
    ]
    filled = [
        F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}")).alias(c) for c in ["image_url", "barcode"]
    ]
    merged = {
        *LISTING_KEY, "title", "normalized_title", "url", "category_path", "raw", "image_url", "barcode",
        "store_product_id", "first_seen_at", "last_seen_at", "inserted",
    }
    carried = [F.col(f"t.{c}").alias(c) for c in target.columns if c not in merged]
    return both.select(
        *LISTING_KEY,
        *carried,
        *overwritten,
        *filled,
        F.when(known, F.col("t.store_product_id"))
        .otherwise(F.col("u.store_product_id"))
        .alias("store_product_id"),
        F.when(known, F.col("t.first_seen_at")).otherwise(as_of).alias("first_seen_at"),
        F.when(updated, as_of).otherwise(F.col("t.last_seen_at")).alias("last_seen_at"),
        (~known).alias("inserted"),
    )


def link_listings(listings: DataFrame, matches: DataFrame) -> DataFrame:
    """Listings with the product, method, confidence and review flag of their match.

    A listing without a match in this batch keeps the link it has.
    """
    link = ["product_id", "match_method", "match_confidence", "needs_review"]
    found = matches.select(*LISTING_KEY, *[F.col(c).alias(f"_{c}") for c in link], F.lit(True).alias("_matched"))
    both = listings.join(found, LISTING_KEY, "left")

    def linked(c: str) -> Column:
        new = F.when(F.col("_matched"), F.col(f"_{c}"))
        return (new.otherwise(F.col(c)) if c in listings.columns else new).alias(c)

    return both.select(*[c for c in listings.columns if c not in link], *map(linked, link))


def merge_stores(target: DataFrame, configs: DataFrame) -> DataFrame:
    """Stores after a change of their configuration, one row per slug.

    A known store keeps its id, country, creation time and active flag and takes
    what else the configuration says; a new one is added as it stands.
    """
    kept = ["store_id", "country_code", "created_at", "active"]
    new = first_per(configs.select(*target.columns), ["slug"], [F.asc("store_id")])
    t, u = target.alias("t"), new.alias("u")
    known = F.col("t.store_id").isNotNull()

    def merged(c: str) -> Column:
        old, now = F.col(f"t.{c}"), F.col(f"u.{c}")
        stays = known if c in kept else F.col("u.store_id").isNull()
        return F.when(stays, old).otherwise(now).alias(c)

    return t.join(u, "slug", "full_outer").select(
        *["slug" if c == "slug" else merged(c) for c in target.columns]
    )


def to_mart_rows(rows: DataFrame) -> DataFrame:
    """Catalog rows shaped for the product mart, the whole row kept as ``raw``.

    History and pricing context go in as JSON. A row without an id is named after
    its store and sku.
    """
    blank = F.lit("")
    number = F.col("sku") if "sku" in rows.columns else F.lit(None).cast("string")
    fallback = F.concat_ws("-", "store", number)
    wanted = ["store", "store_name", "title", "price", "list_price", "img", "url", "category"]
    columns = [c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in wanted]
    nested = [
        (F.to_json(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in ("pricing_context", "history")
    ]
    return rows.select(
        F.coalesce(F.nullif("id", blank), fallback).alias("id"),
        *columns,
        *nested,
        F.to_json(F.struct(*rows.columns)).alias("raw"),
    )


# --- quality ----------------------------------------------------------------


def quarantine(rows: DataFrame) -> DataFrame:
    """Rows with ``errors``: the reasons a row cannot be written, empty when it can."""
    blank = F.lit("")
    checks = {
        "no store": F.coalesce("store_slug", blank) == "",
        "no sku": F.coalesce("sku", blank) == "",
        "no title": F.coalesce("title", blank) == "",
        "no url": F.coalesce("url", blank) == "",
        "no price": F.col("price").isNull(),
        "negative price": F.coalesce(F.col("price") < 0, F.lit(False)),
        "negative list price": F.coalesce(F.col("list_price") < 0, F.lit(False)),
    }
    reasons = F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])
    return rows.withColumn("errors", F.array_compact(reasons))


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def bad_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0)


def run_counters(checked: DataFrame, merged: DataFrame, linked: DataFrame) -> DataFrame:
    """Counts of one delivery per store: found, new, matched, needs_review, prices, errors."""
    good = F.size("errors") == 0
    zero = F.lit(0).cast("bigint")

    def part(df: DataFrame, **counts: Column) -> DataFrame:
        names = ["products_found", "products_new", "prices_written", "errors", "matched", "needs_review"]
        return df.groupBy("store_slug").agg(*[counts.get(n, F.max(zero)).alias(n) for n in names])

    parts = [
        part(
            checked,
            products_found=F.count("*"),
            prices_written=F.count_if(good),
            errors=F.count_if(~good),
        ),
        part(merged, products_new=F.count_if("inserted")),
        part(linked, matched=F.count_if(~F.col("needs_review")), needs_review=F.count_if("needs_review")),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = [c for c in union.columns if c != "store_slug"]
    return union.groupBy("store_slug").agg(*[F.sum(n).alias(n) for n in names])


def run_totals(counters: DataFrame) -> DataFrame:
    names = ["products_found", "prices_written", "needs_review", "errors"]
    return counters.agg(*[F.sum(n).alias(n) for n in names])


def run_record(
    counters: DataFrame, adapter: Column, started_at: Column, finished_at: Column,
    status: str = "completed", notes: str | None = None,
) -> DataFrame:
    """Closed run rows, one per store of a delivery."""
    if status not in lx.RUN_STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return counters.select(
        F.sha1(F.concat_ws(":", "store_slug", started_at.cast("string"))).alias("run_id"),
        "store_slug",
        adapter.alias("adapter"),
        F.lit(status).alias("status"),
        started_at.alias("started_at"),
        finished_at.alias("finished_at"),
        "products_found", "products_new", "prices_written", "errors",
        F.lit(notes).cast("string").alias("notes"),
    )


def _violations(df: DataFrame, table: str, checks: dict[str, Column]) -> DataFrame:
    """(table_name, rule, violations) of row checks, one pass over the table."""
    counted = df.agg(*[F.count_if(bad).alias(f"c{i}") for i, bad in enumerate(checks.values())])
    pairs = [
        F.struct(F.lit(rule).alias("rule"), F.col(f"c{i}").alias("violations"))
        for i, rule in enumerate(checks)
    ]
    return counted.select(
        F.lit(table).alias("table_name"), F.explode(F.array(*pairs)).alias("r")
    ).select("table_name", "r.*")


def _required(*names: str) -> dict[str, Column]:
    return {f"{n} required": F.col(n).isNull() for n in names}


def _domain(column: str, allowed) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(*allowed)


def match_domains() -> dict[str, Column]:
    confidence = F.col("match_confidence")
    return {
        "match_method": _domain("match_method", lx.MATCH_METHODS),
        "match_confidence in 0..1": confidence.isNotNull() & ~confidence.between(0, 1),
    }


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rule(df: DataFrame, table: str, rule: str, keys: list[str], *more: Column) -> DataFrame:
    """(table_name, rule, high, low, ...) of the rows that have all parts of a key. Two
    hashes name a key: rows stay narrow and fixed in size whatever the keys are."""
    present = df.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    parts = [F.col(k).cast("string") for k in keys]
    return present.select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
        F.xxhash64(*parts).alias("high"), F.xxhash64(F.lit("low"), *parts).alias("low"), *more,
    )


def _repeated(uses: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Keys of all unique rules that occur more than once, in one grouping."""
    every = _union([_rule(df, table, f"unique {', '.join(keys)}", keys) for table, df, keys in uses])
    counted = every.groupBy("table_name", "rule", "high", "low").agg(F.count("*").alias("n"))
    return counted.groupBy("table_name", "rule").agg(F.count_if(F.col("n") > 1).alias("violations"))


def _orphans(uses: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows of all reference rules that point at no parent, in one grouping; a hot key
    is one row per task."""
    parts = []
    for table, df, key, parent, parent_key in uses:
        rule = f"{key} exists"
        parts.append(_rule(df, table, rule, [key], F.lit(1).alias("n"), F.lit(0).alias("parent")))
        parts.append(_rule(parent, table, rule, [parent_key], F.lit(0).alias("n"), F.lit(1).alias("parent")))
    keyed = _union(parts).groupBy("table_name", "rule", "high", "low").agg(F.sum("n").alias("n"), F.max("parent").alias("parent"))
    lost = F.when(F.col("parent") == 0, F.col("n")).otherwise(0)
    return keyed.groupBy("table_name", "rule").agg(F.sum(lost).alias("violations"))


def audit_constraints(t: Tables) -> DataFrame:
    """Violations of every declared rule: keys, required values, domains, references.

    One pass over each table for the rules of single rows, one grouping for all
    unique keys and one for all references. Rules about columns that a table does
    not carry are left out.
    """
    required = {
        "stores": (t.stores, ["country_code", "slug", "name", "platform", "config", "active", "created_at"]),
        "brands": (t.brands, ["slug", "name"]),
        "categories": (t.categories, ["slug", "name"]),
        "products": (t.products, ["name", "normalized_name"]),
        "listings": (t.listings, ["store_id", "sku", "title", "normalized_title", "url", "needs_review", "first_seen_at", "last_seen_at"]),
        "prices": (t.prices, ["listing_id", "price", "currency", "available", "captured_at"]),
        "runs": (
            t.runs,
            ["store_id", "adapter", "started_at", "status", "products_found", "products_new", "prices_written", "errors"],
        ),
    }
    domains = {
        "listings": [("match_method", match_domains())],
        "prices": [("price", {"price >= 0": F.coalesce(F.col("price") < 0, F.lit(False))}),
                   ("list_price", {"list_price >= 0": F.coalesce(F.col("list_price") < 0, F.lit(False))})],
        "runs": [("status", {"status": _domain("status", lx.RUN_STATUSES)})],
    }
    reports = []
    for table, (df, names) in required.items():
        checks = _required(*[n for n in names if n in df.columns])
        for column, rules in domains.get(table, []):
            if column in df.columns:
                checks |= rules
        reports.append(_violations(df, table, checks))
    unique = [
        ("stores", t.stores, ["slug"]), ("brands", t.brands, ["slug"]), ("categories", t.categories, ["slug"]),
        ("products", t.products, ["barcode"]), ("listings", t.listings, ["store_id", "sku"]),
    ]
    references = [
        ("listings", t.listings, "store_id", t.stores, "store_id"),
        ("listings", t.listings, "product_id", t.products, "product_id"),
        ("prices", t.prices, "listing_id", t.listing_keys, "listing_id"),
        ("products", t.products, "brand_id", t.brands, "brand_id"),
        ("products", t.products, "category_id", t.categories, "category_id"),
        ("categories", t.categories, "parent_id", t.categories, "category_id"),
        ("runs", t.runs, "store_id", t.stores, "store_id"),
    ]
    if "run_id" in t.prices.columns:
        references.append(("prices", t.prices, "run_id", t.runs, "run_id"))
    rules = [(table, f"unique {', '.join(keys)}") for table, _, keys in unique] + [(u[0], f"{u[2]} exists") for u in references]
    listed = F.explode(F.array(*[F.struct(F.lit(a).alias("table_name"), F.lit(b).alias("rule")) for a, b in rules]))
    none = t.spark.range(1).select(listed.alias("r")).select("r.*", F.lit(0).cast("bigint").alias("violations"))
    both = _union([none, _repeated(unique), _orphans(references)])  # an empty table has no rows to count
    return _union([*reports, both.groupBy("table_name", "rule").agg(F.sum("violations").alias("violations"))])


def audit_matches(resolved: DataFrame) -> DataFrame:
    """Domain rules of resolved listings."""
    return _violations(resolved, "listings", match_domains())


# --- price ranges -----------------------------------------------------------


def _cut(lo: int, hi: int) -> int:
    """Geometric middle of a price range, since prices crowd its low end."""
    middle = int((max(lo, lx.SPLIT_FLOOR) * hi) ** 0.5)
    return middle if lo < middle < hi else (lo + hi) // 2


def range_tree(lo: int, hi: int, depth: int) -> list[tuple[int, int, int, int]]:
    """All ranges of repeated splitting: (node, depth, lo, hi); node 1 is the root."""
    nodes, todo = [], [(1, 0, lo, hi)]
    while todo:
        node, level, a, b = todo.pop()
        nodes.append((node, level, a, b))
        middle = _cut(a, b)
        if level < depth and a < middle < b:
            todo += [(2 * node, level + 1, a, middle), (2 * node + 1, level + 1, middle, b)]
    return sorted(nodes)


def price_partitions(
    rows: DataFrame, cap: int = lx.RANGE_CAP, depth: int = lx.RANGE_DEPTH,
    lo: int = lx.PRICE_FLOOR, hi: int = lx.PRICE_CEILING,
) -> DataFrame:
    """Price ranges of at most ``cap`` rows per group of ``store_id``.

    Where the cuts fall does not depend on the data, only whether they are made
    does. Prices are counted once per distinct value of a few leaf ranges; a
    range is kept if it fits (or cannot be split) and its parent does not fit.
    Both ends of a range belong to it; ``oversized`` tells what stays too big.
    Prices below the floor and above the ceiling are in a range of their own with
    one end NULL, which is not split.
    """
    if depth > 10:
        raise ValueError("the table of ranges doubles with every level; depth may be 10 at most")
    spark = rows.sparkSession
    tree = range_tree(lo, hi, depth)
    split = {n for n, *_ in tree if 2 * n in {m for m, *_ in tree}}
    leaves = [(n, a, b) for n, _, a, b in tree if n not in split]
    edges = sorted({a for _, a, _ in leaves} | {b for _, _, b in leaves})
    # the price's slot: -k on edge k itself, else k between edges k and k+1
    below = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("price")))
    on_edge = F.array_contains(F.array(*[F.lit(e).cast("decimal(18,2)") for e in edges]), F.col("price"))
    counts = (
        rows.filter(F.col("price").isNotNull())
        .groupBy("store_id", F.when(on_edge, -below).otherwise(below).alias("slot"))
        .agg(F.count("*").alias("n"))
    )
    members = []
    for node, level, a, b in tree:
        i, j = edges.index(a) + 1, edges.index(b) + 1
        slots = list(range(i, j)) + [-k for k in range(i, j + 1)]
        members += [(node, level, a, b, node not in split, s) for s in slots]
    members += [(-1, 0, None, lo, True, 0), (-2, 0, hi, None, True, len(edges))]
    ranges = spark.createDataFrame(
        members, "node INT, depth INT, lo BIGINT, hi BIGINT, final BOOLEAN, slot INT"
    )
    # at most 2^(depth+1) ranges x their slots: a fixed table of a few hundred rows
    sized = (
        counts.join(F.broadcast(ranges), "slot")
        .groupBy("store_id", "node", "depth", "lo", "hi", "final")
        .agg(F.sum("n").alias("n"))
    )
    too_big = sized.filter((F.col("n") > cap) & ~F.col("final"))
    split_parents = too_big.select("store_id", F.col("node").alias("parent"))
    kept = sized.join(too_big.select("store_id", "node"), ["store_id", "node"], "left_anti")
    parent = F.floor(F.col("node") / 2).cast("int")
    return (
        kept.withColumn("parent", parent)
        .join(split_parents.withColumn("_split", F.lit(True)), ["store_id", "parent"], "left")
        .filter(F.col("_split").isNotNull() | (F.col("node") <= 1))
        .select("store_id", "depth", "lo", "hi", "n", (F.col("n") > cap).alias("oversized"))
    )
