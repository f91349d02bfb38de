"""Text normalization, parsing, classification and fuzzy search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.money import money, resolve_price
from ..operators import search as se
from ..sources import files, nested
from ..operators.postings import Postings, add_names
from .base import CTES, ORACLES, norm, query, slug
from .staging import staged

alternatives = "|".join


@query(
    "c1_strip_accents",
    "SELECT doc_id, md5(strip_accents(text)) AS bare, length(strip_accents(text)) AS n FROM documents",
)
def _(t):
    bare = tx.strip_accents("text")
    return t.read("documents").select(
        "doc_id", F.md5(bare).alias("bare"), F.length(bare).cast("bigint").alias("n")
    )


@query("c2_normalize_text", f"SELECT doc_id, md5({norm('text')}) AS normal FROM documents")
def _(t):
    return t.read("documents").select("doc_id", F.md5(tx.normalize_text("text")).alias("normal"))


@query(
    "c2_normalize_titles",
    f"SELECT product_id, {norm('title')} AS normal FROM titles",
    "titles",
)
def _(t):
    return t.titles.select("product_id", tx.normalize_text("title").alias("normal"))


@query(
    "c3_slugify",
    f"SELECT product_id, {slug('title')} AS slug, {slug('CASE WHEN p_size % 2 = 0 THEN title END')} AS half FROM titles",
    "titles",
)
def _(t):
    half = F.when(F.col("p_size") % 2 == 0, F.col("title"))
    return t.titles.select("product_id", tx.slugify("title").alias("slug"), tx.slugify(half).alias("half"))


UNITS = alternatives(sorted([*lx.CONTENT_UNITS, *lx.COUNT_UNITS], key=len, reverse=True))
FACTORS = "MAP {" + ", ".join(f"'{u}': {float(f)}" for u, (_, f) in lx.CONTENT_UNITS.items()) + "}"
CANON = "MAP {" + ", ".join(f"'{u}': '{c}'" for u, (c, _) in lx.CONTENT_UNITS.items()) + "}"


def quantity_sql(table: str, key: str, text: str) -> str:
    # every separator is doubled, so that a match may use up the one beside it
    flat = f"regexp_replace(lower(strip_accents({text})), '([^\\pL\\pN_.,])', '\\1\\1', 'g')"
    pattern = f"(?:^|[^\\pL\\pN_.])([0-9]+(?:[.,][0-9]+)?)\\s*({UNITS})(?:[^a-z]|$)"
    return f"""
        SELECT {key}, CAST(replace(hit.v, ',', '.') AS DOUBLE) * {FACTORS}[hit.u] AS quantity, {CANON}[hit.u] AS unit
        FROM (SELECT {key}, list_filter(list_transform(
                  list_zip(regexp_extract_all({flat}, '{pattern}', 1), regexp_extract_all({flat}, '{pattern}', 2)),
                  lambda z: {{v: z[1], u: z[2]}}), lambda m: NOT list_contains({lx.COUNT_UNITS}, m.u))[-1] AS hit
              FROM {table})"""


@query("c4_parse_quantity", quantity_sql("titles", "product_id", "title"), "titles")
def _(t):
    return t.titles.select("product_id", tx.parse_quantity("title").alias("q")).select("product_id", "q.*")


@query("c4_parse_quantity_documents", quantity_sql("documents", "doc_id", "text"))
def _(t):
    return t.read("documents").select("doc_id", tx.parse_quantity("text").alias("q")).select("doc_id", "q.*")


PACK = r"\bx\s*([0-9]{1,2})\b|\b([0-9]{1,2})\s*pack\b"


@query(
    "c5_parse_pack_size",
    f"""SELECT product_id, CASE WHEN n BETWEEN 2 AND 48 THEN n ELSE 1 END AS pack FROM (
            SELECT product_id, TRY_CAST(coalesce(nullif(regexp_extract(f, '{PACK}', 1), ''), nullif(regexp_extract(f, '{PACK}', 2), '')) AS INT) AS n
            FROM (SELECT product_id, lower(strip_accents(title)) AS f FROM titles))""",
    "titles",
)
def _(t):
    return t.titles.select("product_id", tx.parse_pack_size("title").alias("pack"))


@query(
    "c6_clean_barcode",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN length(d) BETWEEN 8 AND 14 AND NOT regexp_matches(d, '^0+$') THEN d END AS barcode
       FROM (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM (
           SELECT l_orderkey, l_linenumber, l_extendedprice,
                  CASE l_partkey % 5 WHEN 0 THEN '770-' || lpad(CAST(l_orderkey AS VARCHAR), 6, '0') || '-' || l_linenumber
                       WHEN 1 THEN CAST(l_orderkey AS VARCHAR) WHEN 2 THEN '000000000000'
                       WHEN 3 THEN 'EAN ' || lpad(CAST(l_orderkey AS VARCHAR), 13, '7') END AS raw FROM lineitem))""",
)
def _(t):
    raw = F.expr(
        """CASE l_partkey % 5 WHEN 0 THEN concat('770-', lpad(CAST(l_orderkey AS STRING), 6, '0'), '-', l_linenumber)
           WHEN 1 THEN CAST(l_orderkey AS STRING) WHEN 2 THEN '000000000000'
           WHEN 3 THEN concat('EAN ', lpad(CAST(l_orderkey AS STRING), 13, '7')) END"""
    )
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", tx.clean_barcode(raw).alias("barcode")
    )


@query(
    "c7_identity_key",
    f"""SELECT product_id, coalesce(nullif({norm("CASE WHEN p_size % 5 <> 0 THEN p_brand END")}, ''), 'sin-marca') || '|' ||
               CASE WHEN p_size % 7 <> 0 THEN printf('%g', p_size * p_retailprice) || 'ml' ELSE 'sin-cantidad' END || '|' || {norm('title')} AS key
        FROM titles""",
    "titles",
)
def _(t):
    brand = F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))
    quantity = F.when(F.col("p_size") % 7 != 0, F.col("p_size") * F.col("p_retailprice"))
    return t.titles.select(
        "product_id", tx.identity_key(brand, quantity, F.lit("ml"), F.col("title")).alias("key")
    )


# Prices the way shops print them, from the order totals.
PRINTED = """CASE o_orderkey % 6
    WHEN 0 THEN concat('$ ', CAST(floor(o_totalprice) AS INT) // 1000, '.', lpad(CAST(CAST(floor(o_totalprice) AS INT) % 1000 AS VARCHAR), 3, '0'))
    WHEN 1 THEN concat(CAST(floor(o_totalprice) AS INT) // 1000, '.', lpad(CAST(CAST(floor(o_totalprice) AS INT) % 1000 AS VARCHAR), 3, '0'), ',50')
    WHEN 2 THEN concat(' COP ', CAST(floor(o_totalprice) AS INT), ' ')
    WHEN 3 THEN 'precio no disponible'
    WHEN 4 THEN concat('Antes $ ', CAST(o_custkey AS INT), ' ahora $', CAST(floor(o_totalprice) AS INT) // 1000, '.000,99')
    END"""
PRINTED_SPARK = PRINTED.replace("//", "div").replace("VARCHAR", "STRING")
BARE = r"regexp_replace(trim(regexp_replace(printed, '\$|COP|\x{00A0}', '', 'g')), '\.', '', 'g')"


@query(
    "c8_parse_cop_price",
    f"""SELECT o_orderkey, CASE WHEN regexp_matches(n, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(n AS DOUBLE) END AS price
        FROM (SELECT o_orderkey, replace({BARE}, ',', '.') AS n FROM (SELECT o_orderkey, {PRINTED} AS printed FROM orders))""",
)
def _(t):
    rows = t.read("orders").select("o_orderkey", F.expr(PRINTED_SPARK).alias("printed"))
    return rows.select("o_orderkey", tx.parse_cop_price("printed").alias("price"))


MONEY_RE = r"\$\s*[0-9.]+(?:,[0-9]{2})?"


@query(
    "c9_extract_price",
    f"""SELECT o_orderkey, nullif(regexp_extract(printed, '{MONEY_RE}', 0), '') AS first,
               list_reverse_sort(list_transform(regexp_extract_all(printed, '{MONEY_RE}'), lambda m, i:
                   {{g: CAST(contains(m, '.') AS INT), d: length(regexp_replace(m, '[^0-9]', '', 'g')), e: -i, m: m}}))[1].m AS best
        FROM (SELECT o_orderkey, {PRINTED} AS printed FROM orders)""",
)
def _(t):
    rows = t.read("orders").select("o_orderkey", F.expr(PRINTED_SPARK).alias("printed"))
    return rows.select(
        "o_orderkey",
        tx.extract_price("printed").alias("first"),
        tx.extract_price("printed", "best").alias("best"),
    )


@query(
    "c9_extract_price_documents",
    f"""SELECT doc_id, nullif(regexp_extract(text, '{MONEY_RE}', 0), '') AS first,
               len(regexp_extract_all(text, '{MONEY_RE}')) > 0 AS has_price FROM documents""",
)
def _(t):
    return t.read("documents").select(
        "doc_id",
        tx.extract_price("text").alias("first"),
        tx.extract_price("text", "best").isNotNull().alias("has_price"),
    )


@query(
    "c9_pick_price_text",
    r"""SELECT o_orderkey, coalesce(
            list_filter(texts, lambda x: regexp_matches(x, '\$\s*(?:[0-9]{1,3}(?:[.,][0-9]{3})+|[0-9]{4,})'))[1],
            list_filter(texts, lambda x: contains(x, '$') AND regexp_matches(x, '[0-9]'))[1]) AS picked
        FROM (SELECT o_orderkey, list_filter(['  ', trim('$ ' || (o_custkey % 900)), trim(printed), '$ 5'], lambda x: x <> '') AS texts
              FROM (SELECT o_orderkey, o_custkey, coalesce(PRINTED, '') AS printed FROM orders))""".replace("PRINTED", PRINTED),
)
def _(t):
    printed = F.coalesce(F.expr(PRINTED_SPARK), F.lit(""))
    small = F.concat(F.lit("$ "), (F.col("o_custkey") % 900).cast("string"))
    texts = F.array(F.lit("  "), small, printed, F.lit("$ 5"))
    return t.read("orders").select("o_orderkey", tx.pick_price_text(texts).alias("picked"))


@query(
    "c10_resolve_price",
    """SELECT o_orderkey, coalesce(s, d, l) AS price, CASE WHEN coalesce(s, d) IS NOT NULL AND l > coalesce(s, d) THEN l END AS list_price
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS DECIMAL(18,2)) END AS s,
                    CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey + 10 AS DECIMAL(18,2)) END AS d,
                    CASE WHEN o_orderkey % 2 = 0 THEN CAST(500 AS DECIMAL(18,2)) END AS l FROM orders)""",
)
def _(t):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    price = resolve_price(
        F.when(key % 3 == 0, money(customer)),
        F.when(key % 5 == 0, money(customer + 10)),
        F.when(key % 2 == 0, money(F.lit(500))),
    )
    return t.read("orders").select("o_orderkey", price.alias("p")).select("o_orderkey", "p.*")


# --- nested entries and pages -----------------------------------------------

ENTRY = """named_struct(
    'productId', CAST(p_partkey AS STRING), 'productName', p_name,
    'brand', IF(p_size % 9 = 0, ' ', p_brand),
    'link', IF(p_size % 4 = 0, concat('https://shop.example.com/x/', p_partkey), NULL),
    'linkText', IF(p_size % 6 = 1, NULL, replace(p_name, ' ', '-')),
    'categories', IF(p_size % 8 = 0, array(), array(concat('/', p_type, '/', p_brand, '/'), concat('/', p_type, '/'))),
    'items', array(
        named_struct('itemId', CAST(p_partkey * 10 AS STRING), 'ean', IF(p_size % 3 = 0, '0', concat('77', lpad(CAST(p_partkey AS STRING), 11, '0'))),
            'nameComplete', concat(p_name, ' ', p_size, '0 ml'), 'name', p_name,
            'images', IF(p_size % 5 = 0, array(), array(named_struct('imageUrl', concat('https://img.example.com/', p_partkey)))),
            'sellers', array(named_struct('commertialOffer', IF(p_size % 2 = 0, NULL, named_struct('Price', CAST(NULL AS DOUBLE), 'ListPrice', CAST(NULL AS DOUBLE),
                    'AvailableQuantity', CAST(NULL AS INT), 'Teasers', CAST(NULL AS STRING)))),
                named_struct('commertialOffer', named_struct('Price', IF(p_size % 10 = 0, 0D, p_retailprice), 'ListPrice', p_retailprice + p_size % 3 * 100 - 50,
                    'AvailableQuantity', p_size % 4, 'Teasers', CAST(NULL AS STRING))))),
        named_struct('itemId', IF(p_size % 2 = 0, '', concat(p_partkey * 10 + 1)), 'ean', NULL, 'nameComplete', NULL, 'name', NULL,
            'images', NULL,
            'sellers', IF(p_size % 7 = 0, array(), array(named_struct('commertialOffer', named_struct('Price', p_retailprice * 2, 'ListPrice', p_retailprice,
                    'AvailableQuantity', CAST(NULL AS INT), 'Teasers', '[1]')))))))"""


def entries(t):
    """Catalog entries as JSON text derived from the parts, parsed again."""
    from ..schemas import CATALOG_ENTRY

    lines = t.read("part").select(F.to_json(F.expr(ENTRY)).alias("value"))
    return lines.select(F.from_json("value", CATALOG_ENTRY).alias("e")).select("e.*")


FLAT_SQL = f"""
    SELECT CAST(p_partkey AS VARCHAR) AS store_product_id, sku, i.title, i.barcode, i.image_url, i.available, i.teasers,
           CASE WHEN p_size % 9 <> 0 THEN p_brand END AS brand,
           CASE WHEN p_size % 8 <> 0 THEN p_type || '/' || p_brand END AS category_path,
           CASE WHEN p_size % 4 = 0 THEN 'https://shop.example.com/x/' || p_partkey
                WHEN p_size % 6 = 1 THEN 'https://shop.example.com'
                ELSE 'https://shop.example.com/' || replace(p_name, ' ', '-') || '/p' END AS url,
           CAST(i.price AS DECIMAL(18,2)) AS price, CASE WHEN i.list_price > i.price THEN CAST(i.list_price AS DECIMAL(18,2)) END AS list_price,
           CASE WHEN i.first THEN p_size * 10.0::DOUBLE END AS quantity, CASE WHEN i.first THEN 'ml' END AS unit
    FROM part,
    LATERAL (SELECT true AS first, CAST(p_partkey * 10 AS VARCHAR) AS sku, p_name || ' ' || p_size || '0 ml' AS title,
                    CASE WHEN p_size % 3 <> 0 THEN '77' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') END AS barcode,
                    CASE WHEN p_size % 5 <> 0 THEN 'https://img.example.com/' || p_partkey END AS image_url,
                    p_size % 4 <> 0 AS available, '[]' AS teasers, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_retailprice END AS price,
                    p_retailprice + p_size % 3 * 100 - 50 AS list_price
             UNION ALL
             SELECT false, CASE WHEN p_size % 2 <> 0 THEN CAST(p_partkey * 10 + 1 AS VARCHAR) END, p_name, NULL, NULL, false, '[1]',
                    CASE WHEN p_size % 7 <> 0 THEN p_retailprice * 2 END, p_retailprice) i
    WHERE sku IS NOT NULL AND i.price > 0"""
FLAT_COLUMNS = (
    "store_product_id sku title barcode image_url available teasers brand category_path url price list_price quantity unit"
).split()


@query("c13_flatten_catalog", FLAT_SQL)
def _(t):
    flat = nested.flatten_catalog(entries(t), "https://shop.example.com", "shop")
    return flat.select(*FLAT_COLUMNS)


# Product pages: the given pages with a JSON-LD block about the part of the same
# number put into the head, in the shapes shops use.
LD_SPARK = """CASE p_size % 8
    WHEN 0 THEN concat('{"@type":"Product","image":["https://img.example.com/', p_partkey, '"],"offers":{"price":', p_size, '}}')
    WHEN 1 THEN concat('{"@type":"Product","image":"https://img.example.com/', p_partkey, '","offers":{"lowPrice":"', p_size, '.5"}}')
    WHEN 2 THEN concat('{"@type":"Product","offers":{"price":"","offers":[{"price":', p_size, '},{"price":1}]}}')
    WHEN 3 THEN concat('{"@type":"BreadcrumbList","offers":{"price":', p_size, '}}')
    WHEN 4 THEN concat('{"@type":"Product","offers":{"offers":[{"listPrice":', p_size, '}]}}')
    WHEN 5 THEN concat('{"@type":"Product","image":{"url":"x"},"offers":{"price":"0","lowPrice":', p_size, '}}')
    WHEN 6 THEN concat('{"@type":"Product","image":[{"url":"x"}],"offers":{"price":0.0,"lowPrice":', p_size, '}}')
    ELSE concat('{"@type":"Product","image":[],"offers":{"price":0,"lowPrice":"","highPrice":', p_size, '}}') END"""
OPEN, CLOSE = '<script type="application/ld+json">', "</script>"


@query(
    "a8_c14_extract_jsonld",
    f"""SELECT page_id, CASE p_size % 8 WHEN 1 THEN p_size || '.5' WHEN 5 THEN '0' WHEN 3 THEN NULL
                   ELSE CAST(nullif(p_size, 0) AS VARCHAR) END AS offer_price,
               CASE WHEN p_size % 8 IN (0, 1) THEN 'https://img.example.com/' || p_partkey END AS image_url, length(html) AS n
        FROM pages LEFT JOIN part ON p_partkey = page_id""",
)
def _(t):
    parts = t.read("part").selectExpr("p_partkey AS page_id", "p_partkey", "p_size")
    block = F.concat(
        F.lit(OPEN + '{"@type":"Organization"}' + CLOSE + OPEN), F.expr(LD_SPARK), F.lit(CLOSE + "</head>")
    )
    pages = t.read("pages").join(parts, "page_id", "left").select(
        "page_id",
        F.length("html").cast("bigint").alias("n"),
        F.expr("html").alias("plain"),
        F.coalesce(F.replace("html", F.lit("</head>"), block), "html").alias("html"),
    )
    return nested.extract_jsonld(pages).select("page_id", "offer_price", "image_url", "n")


@query(
    "c15_best_image",
    """SELECT p_partkey, coalesce(list_filter(u, lambda x: contains(lower(x), 'vtexassets.com') OR contains(lower(x), '/arquivos/ids/'))[1],
                  list_filter(u, lambda x: NOT regexp_matches(lower(x), 'sellos|cucarda|imprecionantes|cloudfront[.]net'))[1], u[1]) AS image
       FROM (SELECT p_partkey, list_filter(['https://d1.cloudfront.net/' || p_partkey, CASE WHEN p_size % 2 = 0 THEN 'https://x.example.com/Sellos/' || p_size ELSE '' END,
                    CASE WHEN p_size % 3 = 0 THEN 'https://x.example.com/a' || p_size ELSE '' END,
                    CASE WHEN p_size % 5 = 0 THEN 'https://x.VTEXassets.com/arquivos/ids/' || p_size ELSE '' END], lambda x: x <> '') AS u FROM part)""",
)
def _(t):
    urls = F.expr(
        """array(concat('https://d1.cloudfront.net/', p_partkey), IF(p_size % 2 = 0, concat('https://x.example.com/Sellos/', p_size), ''),
                 IF(p_size % 3 = 0, concat('https://x.example.com/a', p_size), ''),
                 IF(p_size % 5 = 0, concat('https://x.VTEXassets.com/arquivos/ids/', p_size), ''))"""
    )
    return t.read("part").select("p_partkey", tx.best_image(urls).alias("image"))


@query(
    "c16_absolute_url",
    """SELECT page_id, CASE WHEN url LIKE 'http%' AND page_id % 3 = 0 THEN url
                            WHEN page_id % 3 = 1 THEN 'https://shop.example.com/p' || page_id || '/p' ELSE 'https://shop.example.com/' END AS entry,
              CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://shop.example.com//a' || page_id END AS href
       FROM pages""",
)
def _(t):
    base = F.lit("https://shop.example.com/")
    link = F.expr("CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'p' END")
    link_text = F.expr("CASE page_id % 3 WHEN 1 THEN concat('p', page_id) WHEN 2 THEN '' END")
    href = F.expr("CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat('/a', page_id) ELSE '' END")
    return t.read("pages").select(
        "page_id",
        tx.absolute_url(base, link, link_text).alias("entry"),
        tx.absolute_href(base, href).alias("href"),
    )


@query(
    "c17_stable_id",
    "SELECT page_id, 'shop-' || substr(sha1(url), 1, 16) AS id FROM pages",
)
def _(t):
    return t.read("pages").select("page_id", tx.stable_id(F.lit("shop"), "url").alias("id"))


@query(
    "c18_title_case",
    """SELECT p_partkey, CASE WHEN trim(coalesce(v, '')) = '' THEN 'Otros' ELSE array_to_string(list_transform(list_filter(
              string_split(regexp_replace(v, '[\\s_-]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS label
       FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN upper(p_type) || '_' || p_name WHEN 1 THEN '  ' WHEN 2 THEN 'vinos-y  ' || p_brand END AS v FROM part)""",
)
def _(t):
    value = F.expr(
        "CASE p_size % 4 WHEN 0 THEN concat(upper(p_type), '_', p_name) WHEN 1 THEN '  ' WHEN 2 THEN concat('vinos-y  ', p_brand) END"
    )
    return t.read("part").select("p_partkey", tx.title_case(value).alias("label"))


@query(
    "c19_looks_like_liquor",
    f"""SELECT product_id, regexp_matches(lower(title), '{alternatives(lx.LIQUOR_WORDS)}')
               AND NOT regexp_matches(lower(title), '{alternatives(lx.LIQUOR_NOISE)}') AS liquor FROM titles""",
    "titles",
)
def _(t):
    return t.titles.select("product_id", tx.looks_like_liquor("title").alias("liquor"))


@query(
    "c20_matches_category",
    "SELECT product_id, category, CASE category "
    + " ".join(
        f"WHEN '{c}' THEN regexp_matches(lower(title), '(^|[^\\pL\\pN_])({alternatives(w)})([^\\pL\\pN_]|$)')"
        for c, w in lx.CATEGORY_WORDS.items()
    )
    + f" END AND NOT regexp_matches(lower(title), '{alternatives(lx.CATEGORY_NOISE)}') AS fits "
    + f"FROM titles, LATERAL (SELECT unnest({list(lx.CATEGORY_WORDS)}) AS category)",
    "titles",
)
def _(t):
    labels = F.array(*[F.lit(c) for c in lx.CATEGORY_WORDS])
    rows = t.titles.withColumn("category", F.explode(labels))
    return rows.select("product_id", "category", tx.matches_category("title", "category").alias("fits"))


@query(
    "c21_filter_dump_category",
    f"""SELECT count(*) AS total, count(*) FILTER (regexp_matches(lower(c), '{alternatives(lx.DUMP_CATEGORY_WORDS)}')) AS drinks
        FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'Vinos y Licores' WHEN 1 THEN p_type END AS c FROM part)""",
)
def _(t):
    category = F.expr("CASE p_size % 3 WHEN 0 THEN 'Vinos y Licores' WHEN 1 THEN p_type END")
    rows = t.read("part").select(category.alias("c"))
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(tx.contains_any("c", lx.DUMP_CATEGORY_WORDS)).alias("drinks"),
    )


# --- L ----------------------------------------------------------------------

GRAMS = (
    "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^\\pL\\pN]+', ' ', 'g'), ' '), lambda w: w <> ''), "
    "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
)


def grams(expression: str) -> str:
    return GRAMS.format(expression)


def similar(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CAST({shared} AS DOUBLE) / (len({a}) + len({b}) - {shared})"


@query(
    "l1_trigram_similarity",
    f"SELECT p_partkey, len(ga) AS n, round({similar('ga', 'gb')}, 9) AS similarity "
    f"FROM (SELECT p_partkey, {grams('p_name')} AS ga, {grams('''replace(p_name, 'e', 'i') || '_' || p_type''')} AS gb FROM part)",
)
def _(t):
    other = F.concat(F.replace("p_name", F.lit("e"), F.lit("i")), F.lit("_"), "p_type")
    return t.read("part").select(
        "p_partkey",
        F.size(tx.trigrams("p_name")).cast("bigint").alias("n"),
        F.round(tx.similarity(F.col("p_name"), other), 9).alias("similarity"),
    )


CTES["needles"] = (
    (),
    """SELECT DISTINCT needle FROM (SELECT replace(p_name, 'e', 'i') AS needle FROM part
       UNION ALL SELECT left(p_name, 2) FROM part UNION ALL SELECT substr(p_name, 2, 6) FROM part)""",
)


def needles(t):
    names = t.read("part")
    parts = F.array(
        F.replace("p_name", F.lit("e"), F.lit("i")), F.substring("p_name", 1, 2), F.substring("p_name", 2, 6)
    )
    return names.select(F.explode(parts).alias("needle")).distinct()


CTES["found"] = (
    ("needles", "products"),
    f"""SELECT needle, name, sim FROM (
            SELECT needle, name, ga, gb, {similar('ga', 'gb')} AS sim
            FROM (SELECT DISTINCT needle, {grams('needle')} AS ga FROM (SELECT {norm('needle')} AS needle FROM needles) WHERE needle <> ''),
                 (SELECT DISTINCT normalized_name AS name, {grams('normalized_name')} AS gb FROM products))
        WHERE sim >= 0.3 OR contains(name, needle)""",
)


@query(
    "l2_matching_names",
    "SELECT needle, name, round(sim, 9) AS similarity FROM found",
    "found",
)
def _(t):
    names = t.products.select(F.col("normalized_name").alias("name"))
    return se.matching_names(names, needles(t), lx.SIMILARITY_THRESHOLD).withColumn(
        "similarity", F.round("similarity", 9)
    )


@query(
    "l2_search_products",
    """SELECT needle, product_id, store_count, min_price, max_price, CAST(place AS INT) AS place FROM (
           SELECT f.needle, p.product_id, store_count, min_price, max_price,
                  row_number() OVER (PARTITION BY f.needle ORDER BY sim DESC, p.name, p.product_id) AS place
           FROM found f JOIN products p ON p.normalized_name = f.name
           JOIN (SELECT product_id, count(DISTINCT store_id) AS store_count, min(price) AS min_price, max(price) AS max_price
                 FROM star GROUP BY product_id) s USING (product_id)) WHERE place <= 50""",
    "found", "star",
)
def _(t):
    rows = se.search(t, needles(t), limit=lx.PAGE_LIMIT_DEFAULT)
    return rows.select("needle", "product_id", "store_count", "min_price", "max_price", "place")


@query(
    "l2_search_totals",
    """SELECT f.needle, count(*) AS total FROM found f JOIN products p ON p.normalized_name = f.name
       WHERE p.product_id IN (SELECT product_id FROM star) GROUP BY f.needle""",
    "found", "star",
)
def _(t):
    return se.search_totals(t, needles(t))


CTES["title_candidates"] = (
    ("listings", "products"),
    f"""SELECT normalized_title, product_id, name, sim, place FROM (
            SELECT normalized_title, product_id, name, sim,
                   row_number() OVER (PARTITION BY normalized_title ORDER BY sim DESC, name, product_id) AS place
            FROM (SELECT t.normalized_title, n.normalized_name, {similar('ga', 'gb')} AS sim
                  FROM (SELECT DISTINCT normalized_title, {grams('normalized_title')} AS ga FROM listings WHERE needs_review) t,
                       (SELECT DISTINCT normalized_name, {grams('normalized_name')} AS gb FROM products) n) s
            JOIN products USING (normalized_name) WHERE sim >= 0.3) WHERE place <= 5""",
)


@query(
    "l3_e13_g7_similar_candidates",
    "SELECT normalized_title, product_id, name, round(sim, 9) AS similarity, CAST(place AS INT) AS place FROM title_candidates",
    "title_candidates",
)
def _(t):
    waiting = t.listings.filter("needs_review")
    return se.similar_candidates(waiting, t.products).select(
        "normalized_title", "product_id", "name", F.round("similarity", 9).alias("similarity"), "place"
    )


def stored_postings(t) -> Postings:
    """Postings of the catalog's names, written in two batches, the second one twice."""

    def write(path: str) -> None:
        names = t.products.select(F.col("normalized_name").alias("name"), "product_id")
        add_names(names.filter("product_id % 2 = 0"), path, 0)
        for _ in range(2):
            add_names(names, path, 1)

    return Postings(t.spark, staged(t, "postings", write))


@query("l2_stored_matching_names", ORACLES["l2_matching_names"])
def _(t):
    """As l2_matching_names, from stored postings."""
    found = stored_postings(t).matching_names(needles(t))
    return found.withColumn("similarity", F.round("similarity", 9))


@query("l2_search_stored_products", ORACLES["l2_search_products"])
def _(t):
    """As l2_search_products, from stored postings."""
    rows = se.search(t, needles(t), limit=lx.PAGE_LIMIT_DEFAULT, postings=stored_postings(t))
    return rows.select("needle", "product_id", "store_count", "min_price", "max_price", "place")


@query("l3_stored_candidates", ORACLES["l3_e13_g7_similar_candidates"])
def _(t):
    """As l3_e13_g7_similar_candidates, from stored postings."""
    waiting = t.listings.filter("needs_review")
    return stored_postings(t).similar_candidates(waiting, t.products).select(
        "normalized_title", "product_id", "name", F.round("similarity", 9).alias("similarity"), "place"
    )
