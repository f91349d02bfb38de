"""Case tables of the text and price functions."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tendero.functions import text as tx
from tendero.functions.money import discount_pct, mean_money, resolve_price


def apply(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


CASES = [
    (
        tx.normalize_text,
        {
            "Whisky OLD PARR 12 años": "whisky old parr 12 anos",
            "Agua  MANANTIAL  (1500  ml)": "agua manantial 1500 ml",
            None: "",
            "": "",
            " a_b-c!": "a_b c",
        },
    ),
    (tx.slugify, {"Vinos y Licores": "vinos-y-licores", "Éxito": "exito", "": "sin-nombre", None: "sin-nombre"}),
    (
        tx.parse_quantity,
        {
            "Whisky Buchanan's Master Deluxe 750 Ml": (750.0, "ml"),
            "Agua MANANTIAL sin gas botella (1500  ml)": (1500.0, "ml"),
            "Pasabocas DETODITO mixto (165  gr)": (165.0, "g"),
            "Arroz Diana 500gr": (500.0, "g"),
            "Ron Medellin 1 Litro": (1000.0, "ml"),
            "VINO BAG IN BOX 3 L": (3000.0, "ml"),
            "Leche 1,1 lt": (1100.0, "ml"),
            "Arroz 2 kg": (2000.0, "g"),
            "Cerveza Club Colombia Lata 330 Ml X6 Unds": (330.0, "ml"),
            "Jugo 500g 300ml": (300.0, "ml"),
            "Whisky sin medida": (None, None),
            "modelo a5 g": (None, None),
            None: (None, None),
        },
    ),
    (
        tx.parse_pack_size,
        {
            "Cerveza Lata 330 Ml X6 Unds": 6, "Gaseosa 12 pack": 12, "Whisky Old Parr 750 Ml": 1, None: 1,
            "Producto x999": 1, "x1": 1, "x 48": 48, "x49": 1,
        },
    ),
    (
        tx.clean_barcode,
        {
            "0039383006507": "0039383006507", "770-2004-003539": "7702004003539", None: None, "": None, "0": None,
            "123": None, "000000000000": None, "abc": None, "123456789012345": None,
        },
    ),
    (
        tx.parse_cop_price,
        {
            "$ 45.900": 45900.0, "$45.900": 45900.0, "45900": 45900.0, "$ 1.234.567": 1234567.0, "45.900,50": 45900.5,
            "1.234,99": 1234.99, "$ 999": 999.0, None: None, "precio no disponible": None, "": None,
            "1,234,567": None, "COP 12.000": 12000.0, "1d": None, "NaN": None,
        },
    ),
    (
        tx.title_case,
        {"vinos_y-licores": "Vinos Y Licores", None: "Otros", "  ": "Otros", "DULCES": "Dulces"},
    ),
    (lambda c: tx.extract_price(c, "best"), {"a $ 900 b $ 12.500 c $ 99999": "$ 12.500", "nada": None, "$5 $ 77": "$ 77"}),
    (tx.looks_like_liquor, {"Vino tinto": True, "Vaso de vino": False, "Pan": False, "Ron añejo": True}),
]


@pytest.mark.parametrize("build,cases", CASES)
def test_cases(spark, build, cases):
    got = apply(spark, list(cases), build)
    for value, expected, out in zip(cases, cases.values(), got):
        assert (tuple(out) if isinstance(expected, tuple) else out) == expected, value


def test_accents_match_the_unicode_tables(spark):
    rng = random.Random(7)
    letters = [chr(c) for c in range(0x20, 0x250)] + [chr(c) for c in range(0x1E00, 0x1F00)] + ["é", "̧"]
    texts = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(300)]
    want = ["".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") for t in texts]
    assert apply(spark, texts, tx.strip_accents) == want


def test_format_general_is_printf_g(spark):
    values = [0.0, 1500.0, 0.5, 1e6, 1234567.0, 999999.5, 12345.678, 0.0001, 0.00002, 330.25, 1e12, 99999.95]
    values += [random.Random(3).uniform(0, 10 ** random.Random(i).randint(-6, 9)) for i in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE")
    got = [r.g for r in df.select("i", tx.format_general("v").alias("g")).orderBy("i").collect()]
    assert got == [f"{v:g}" for v in values]


def test_identity_key(spark):
    rows = [("Old Parr", 750.0, "ml", "Whisky OLD PARR 12 años (750 ml)"), ("OLD PARR", 750.0, "ml", "WHISKY OLD PARR 12 AÑOS 750 ML"),
            ("Old Parr", 1000.0, "ml", "Whisky Old Parr"), (None, None, None, "Producto suelto")]
    df = spark.createDataFrame(rows, "b STRING, q DOUBLE, u STRING, t STRING")
    a, b, c, d = [r.k for r in df.select(tx.identity_key(F.col("b"), F.col("q"), F.col("u"), F.col("t")).alias("k")).collect()]
    assert a == b == "old parr|750ml|whisky old parr 12 anos 750 ml" and c != a
    assert d == "sin-marca|sin-cantidad|producto suelto"


def test_whole_word_categories(spark):
    rows = [("Ron Viejo", "licores", True), ("Jarrón", "licores", False), ("Agua con gas", "bebidas", True),
            ("Aguacate", "bebidas", False), ("Crema de whisky", "licores", False), ("Ron", "otra", False), ("Champaña", "vinos", True)]
    df = spark.createDataFrame(rows, "n STRING, c STRING, want BOOLEAN")
    for r in df.select("*", tx.matches_category("n", "c").alias("got")).collect():
        assert r.got == r.want, r


def test_trigrams_like_pg_trgm(spark):
    [r] = spark.sql("SELECT 'Old_Par 12' AS a, 'old parr' AS b").select(
        tx.trigrams("a").alias("g"), tx.similarity("a", "b").alias("s")
    ).collect()

    def grams(text):
        return {f"  {w} "[i:i + 3] for w in re.findall(r"[a-z0-9]+", text) for i in range(len(w) + 1)}

    a, b = grams("old par 12"), grams("old parr")
    assert set(r.g) == a and len(r.g) == len(a)
    assert r.s == pytest.approx(len(a & b) / len(a | b))


def test_money_rules(spark):
    df = spark.sql("SELECT CAST(168000 AS DECIMAL(18,2)) AS p, CAST(210000 AS DECIMAL(18,2)) AS l, CAST(NULL AS DECIMAL(18,2)) AS n")
    p, l, n = F.col("p"), F.col("l"), F.col("n")
    [r] = df.select(
        discount_pct(p, l).alias("d"), discount_pct(l, p).alias("none"),
        resolve_price(n, p, l).alias("detail"), resolve_price(n, n, l).alias("listed"), resolve_price(l, n, p).alias("low"),
    ).collect()
    assert float(r.d) == 20.0 and r.none is None
    assert (float(r.detail.price), float(r.detail.list_price)) == (168000, 210000)
    assert (float(r.listed.price), r.listed.list_price) == (210000, None)
    assert r.low.list_price is None
    [m] = spark.sql("SELECT CAST(v AS DECIMAL(18,2)) AS v FROM VALUES (0.01), (0.02) AS t(v)").agg(mean_money("v").alias("m")).collect()
    assert str(m.m) == "0.02"


def test_titles_are_searched_for_a_size_once(spark):
    rows = spark.createDataFrame([("Ron añejo 750 ML",), ("Agua 1,5 L x6 unds",), ("Té",), (None,)], "title STRING")
    sized = tx.with_quantity(rows)
    want = rows.select("title", tx.parse_quantity("title").alias("q")).select("title", "q.*")
    assert sized.collect() == want.collect()
    plan = sized._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # the amount and the unit, each once


def test_plain_text_skips_the_accent_table(spark):
    rows = spark.createDataFrame([("Canción",), ("plain",), ("é",), ("",), (None,)], "t STRING")
    assert [r[0] for r in rows.select(tx.strip_accents("t")).collect()] == ["Cancion", "plain", "e", "", None]
    assert "octet_length" in rows.select(tx.strip_accents("t"))._jdf.queryExecution().analyzed().toString()
