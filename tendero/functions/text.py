"""Text normalization and parsing as column expressions (no UDF)."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as lx


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(words: list[str]) -> str:
    """Regex alternation of literal words (the lists hold letters only)."""
    return "|".join(words)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Letters of the basic plane whose decomposition is one letter plus marks.

    Derived from the Unicode tables, so the two strings stay aligned with the
    interpreter's Unicode version. Letters that decompose into several letters
    (Hangul syllables) stay as they are.
    """
    source, target = [], []
    for code in range(0xA0, min(0x10000, sys.maxunicode)):
        char = chr(code)
        if unicodedata.category(char)[0] != "L":
            continue
        bare = "".join(
            c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"
        )
        if len(bare) == 1 and bare != char and ord(bare) < 0x10000:
            source.append(char)
            target.append(bare)
    return "".join(source), "".join(target)


def strip(c: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_accents(c: Column | str) -> Column:
    source, target = _accent_table()
    text = _col(c)
    # a text of as many bytes as characters is ASCII and has nothing to strip
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, text).otherwise(F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), source, target))


def normalize_text(c: Column | str) -> Column:
    """Lower case, no accents, words separated by one blank; NULL gives ''."""
    bare = F.lower(strip_accents(F.coalesce(_col(c), F.lit(""))))
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}_]+", " "))


def slugify(c: Column | str) -> Column:
    dashed = F.regexp_replace(normalize_text(c), " ", "-")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit(lx.NO_NAME_SLUG))


def brand_slug(brand: Column | str) -> Column:
    """Slug of a brand name, NULL for a blank one."""
    named = F.trim(F.coalesce(_col(brand), F.lit(""))) != ""
    return F.when(named, slugify(brand))


def _unit_map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _last_size(c: Column | str) -> Column:
    """``struct(amount, unit)``, as written, of the last content size in a title."""
    units = list(lx.CONTENT_UNITS) + lx.COUNT_UNITS
    pattern = lx.QUANTITY_PATTERN.format(units=_words(units))
    flat = F.lower(strip_accents(c))
    found = F.arrays_zip(
        F.regexp_extract_all(flat, F.lit(pattern), F.lit(1)).alias("amount"),
        F.regexp_extract_all(flat, F.lit(pattern), F.lit(2)).alias("unit"),
    )
    content = F.filter(found, lambda m: ~m["unit"].isin(lx.COUNT_UNITS))
    return F.try_element_at(content, F.lit(-1))


def _size_of(last: Column) -> Column:
    factor = _unit_map({k: float(v[1]) for k, v in lx.CONTENT_UNITS.items()})
    canonical = _unit_map({k: v[0] for k, v in lx.CONTENT_UNITS.items()})
    amount = F.regexp_replace(last["amount"], ",", ".").cast("double")
    return F.struct(
        (amount * F.try_element_at(factor, last["unit"])).alias("quantity"),
        F.try_element_at(canonical, last["unit"]).alias("unit"),
    )


def parse_quantity(c: Column | str) -> Column:
    """``struct(quantity DOUBLE, unit STRING)`` of the last content size in a title."""
    return _size_of(_last_size(c))


def with_quantity(df: DataFrame, title: str = "title") -> DataFrame:
    """Rows with the ``quantity`` and ``unit`` of ``parse_quantity``. The title is searched
    once, in a column of its own that both are read from."""
    size = _size_of(F.col("_last_size"))
    found = df.withColumn("_last_size", _last_size(title))
    return found.withColumns({"quantity": size["quantity"], "unit": size["unit"]}).drop("_last_size")


def parse_pack_size(c: Column | str) -> Column:
    """Pieces in a pack: 'x6' or '6 pack' within 2..48, otherwise 1."""
    pattern = lx.PACK_PATTERN
    flat = F.lower(strip_accents(c))
    digits = F.coalesce(
        F.nullif(F.regexp_extract(flat, pattern, 1), F.lit("")),
        F.nullif(F.regexp_extract(flat, pattern, 2), F.lit("")),
    )
    size = digits.cast("int")
    return F.when(size.between(lx.PACK_MIN, lx.PACK_MAX), size).otherwise(F.lit(1))


def clean_barcode(c: Column | str) -> Column:
    digits = F.regexp_replace(_col(c), "[^0-9]", "")
    usable = F.length(digits).between(lx.BARCODE_MIN_DIGITS, lx.BARCODE_MAX_DIGITS)
    return F.when(usable & ~digits.rlike("^0+$"), digits)


def format_general(c: Column | str) -> Column:
    """A number with six significant digits, as C's ``%g`` prints it."""
    value = _col(c)
    size = F.abs(value)

    def masked(mask: str) -> Column:
        return F.call_function("format_number", value, F.lit(mask))

    power = F.regexp_replace(masked("0.#####E00"), "E(?=[0-9])", "e+")
    scientific = F.regexp_replace(power, "E-", "e-")
    # values that round up into the fixed range, or out of it, change notation
    small = F.when(scientific == "1e-04", F.lit("0.0001")).otherwise(scientific)
    whole = F.when(masked("0") == "1000000", scientific).otherwise(masked("0"))
    out = F.when(size == 0, F.lit("0")).when(size < 1e-4, small)
    for decimals in range(9, 0, -1):
        out = out.when(size < 10.0 ** (6 - decimals), masked("0." + "#" * decimals))
    return out.when(size < 1e6, whole).otherwise(scientific)


def identity_key(brand: Column, quantity: Column, unit: Column, title: Column) -> Column:
    """``brand|quantity|title`` key for products without a barcode."""
    quantity = _col(quantity).cast("double")
    unit = _col(unit)
    sized = F.concat(format_general(quantity), unit)
    present = quantity.isNotNull() & (quantity != 0) & unit.isNotNull() & (unit != "")
    return F.concat_ws(
        "|",
        F.coalesce(F.nullif(normalize_text(brand), F.lit("")), F.lit(lx.NO_BRAND)),
        F.when(present, sized).otherwise(F.lit(lx.NO_QUANTITY)),
        normalize_text(title),
    )


def title_case(c: Column | str) -> Column:
    """Category label: words capitalized, '_' and '-' read as blanks."""
    trimmed = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)^\s+|\s+$", "")
    words = F.trim(F.regexp_replace(trimmed, r"(?U)[\s_-]+", " "))
    return F.when(trimmed == "", F.lit(lx.OTHER_CATEGORY)).otherwise(F.initcap(words))


def looks_like_liquor(c: Column | str) -> Column:
    """Substring classifier; a noise word vetoes."""
    text = F.lower(_col(c))
    return text.rlike(_words(lx.LIQUOR_WORDS)) & ~text.rlike(_words(lx.LIQUOR_NOISE))


def matches_category(name: Column | str, category: Column | str) -> Column:
    """Whole-word classifier per category; an unknown category matches nothing."""
    text, category = F.lower(_col(name)), _col(category)
    hit = F.lit(False)
    for label, words in lx.CATEGORY_WORDS.items():
        pattern = r"(?U)\b(?:" + _words(words) + r")\b"
        hit = F.when(category == label, text.rlike(pattern)).otherwise(hit)
    return hit & ~text.rlike(_words(lx.CATEGORY_NOISE))


def contains_any(c: Column | str, words: list[str]) -> Column:
    """Case-insensitive: does the text contain one of the literal words?"""
    text = F.lower(_col(c))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def title_contains(c: Column | str, needle: str) -> Column:
    return F.contains(F.lower(_col(c)), F.lit(needle.lower()))


# --- prices written in text -------------------------------------------------

_NUMBER, _MONEY = lx.NUMBER_PATTERN, lx.MONEY_PATTERN


def parse_cop_price(c: Column | str) -> Column:
    """'$ 45.900,50' -> 45900.5: dots group thousands, a comma starts decimals.

    Takes a string column; a numeric column needs no parsing, only a cast.
    """
    bare = F.trim(F.regexp_replace(_col(c), "\\$|COP|\u00a0", ""))
    undotted = F.regexp_replace(bare, r"\.", "")
    number = F.when(
        F.contains(bare, F.lit(",")), F.regexp_replace(undotted, ",", ".")
    ).otherwise(undotted)
    return F.when(number.rlike(_NUMBER), number.try_cast("double"))


def extract_price(c: Column | str, mode: str = "first") -> Column:
    """The price text inside a longer text.

    ``first``: the first amount after a '$'. ``best``: among all of them the one
    with a thousands dot, then with most digits, the earlier on a tie.
    """
    text = _col(c)
    if mode == "first":
        return F.nullif(F.regexp_extract(text, _MONEY, 0), F.lit(""))
    if mode != "best":
        raise ValueError(f"unknown mode {mode!r}")
    amounts = F.regexp_extract_all(text, F.lit(_MONEY), F.lit(0))
    scored = F.transform(
        amounts,
        lambda m, i: F.struct(
            F.contains(m, F.lit(".")).cast("int").alias("grouped"),
            F.length(F.regexp_replace(m, "[^0-9]", "")).alias("digits"),
            (-i).alias("earlier"),
            m.alias("amount"),
        ),
    )
    return F.array_max(scored)["amount"]


def pick_price_text(texts: Column | str) -> Column:
    """First text with a grouped or 4+ digit amount, else the first with any amount."""
    trimmed = F.filter(
        F.transform(_col(texts), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")),
        lambda t: t != "",
    )
    proper = F.filter(
        trimmed, lambda t: t.rlike(lx.PRICE_TEXT_PATTERN)
    )
    any_amount = F.filter(trimmed, lambda t: F.contains(t, F.lit("$")) & t.rlike("[0-9]"))
    return F.coalesce(F.get(proper, F.lit(0)), F.get(any_amount, F.lit(0)))


# --- links ------------------------------------------------------------------


def best_image(urls: Column | str) -> Column:
    """A product photo if there is one, else the first that is no seal or banner."""
    urls = F.filter(_col(urls), lambda u: F.trim(u) != "")
    photo = F.filter(urls, lambda u: contains_any(u, lx.ASSET_MARKERS))
    clean = F.filter(urls, lambda u: ~contains_any(u, lx.BLOCKED_IMAGE_MARKERS))
    first = F.lit(0)
    return F.coalesce(F.get(photo, first), F.get(clean, first), F.get(urls, first))


def absolute_url(base: Column, link: Column, link_text: Column) -> Column:
    """Product page of a catalog entry."""
    page = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), link_text, F.lit("/p"))
    return (
        F.when(F.startswith(link, F.lit("http")), link)
        .when(F.coalesce(link_text, F.lit("")) != "", page)
        .otherwise(base)
    )


def absolute_href(base: Column, href: Column) -> Column:
    """Link found on a page: absolute as it is, otherwise below the site's address."""
    return F.when(
        F.coalesce(href, F.lit("")) != "",
        F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(base, href)),
    )


def stable_id(store: Column | str, url: Column | str) -> Column:
    """The same listing keeps its id over every run."""
    return F.concat(_col(store), F.lit("-"), F.substring(F.sha1(_col(url)), 1, 16))


def path_prefixes(path: Column | str) -> Column:
    """'A/B/C' -> [{1,'A','a','',..}, ...]: every prefix of a category path, root first."""
    names = F.filter(
        F.transform(F.split(_col(path), "/"), lambda s: F.trim(s)), lambda s: s != ""
    )
    slugs = F.transform(names, slugify)
    return F.transform(
        names,
        lambda name, i: F.struct(
            (i + 1).alias("depth"),
            name.alias("name"),
            F.array_join(F.slice(slugs, F.lit(1), i + 1), "/").alias("slug"),
            F.nullif(F.array_join(F.slice(slugs, F.lit(1), i), "/"), F.lit("")).alias(
                "parent_slug"
            ),
        ),
    )


# --- trigrams ---------------------------------------------------------------


def trigrams(c: Column | str) -> Column:
    """Distinct trigrams of each word, padded with two blanks before and one after."""
    words = F.filter(
        F.split(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", " "), " "),
        lambda w: w != "",
    )
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two distinct arrays; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(trigrams(a), trigrams(b))
