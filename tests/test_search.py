"""Similarity and containment joins against all pairs."""

import random
import re

import pytest

from tendero.operators import catalog as cat
from tendero.operators import search as se
from tendero.operators.postings import Postings, add_names
from tendero.session import scratch_dir

from .test_scale import plan


def grams(text):
    return {f"  {w} "[i:i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)}


def texts(rng, n):
    words = ["ron", "viejo", "old", "parr", "par", "vino", "tinto", "año", "x", "agua", "aguardiente", "mineral", "12", "ab"]
    made = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(n)}
    return sorted({"".join(c for c in t if rng.random() < 0.93) for t in made} | made)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_trigram_join_is_exact(spark, threshold):
    rng = random.Random(int(threshold * 10))
    left, right = texts(rng, 60), texts(rng, 90)
    got = {
        (r.needle, r.name): r.similarity
        for r in se.trigram_join(
            spark.createDataFrame([(t,) for t in left], "needle STRING"),
            spark.createDataFrame([(t,) for t in right], "name STRING"),
            threshold,
        ).collect()
    }
    want = {}
    for a in left:
        for b in right:
            ga, gb = grams(a), grams(b)
            if ga | gb and len(ga & gb) / len(ga | gb) >= threshold:
                want[a, b] = len(ga & gb) / len(ga | gb)
    assert got == want


def test_each_pair_once(spark):
    names = spark.createDataFrame([("ron viejo",), ("ron viejo de caldas",)], "name STRING")
    needles = spark.createDataFrame([("ron viejo",), ("ron viejo",)], "needle STRING")
    assert se.trigram_join(needles, names).count() == 2


def test_contains_join_is_exact(spark):
    rng = random.Random(5)
    right = texts(rng, 120)
    left = sorted({t[a:a + n] for t in right for a, n in [(rng.randrange(len(t) + 1), rng.randrange(0, 9))]} | {"o", "zz", "12"})
    found = se.contains_join(
        spark.createDataFrame([(t,) for t in left], "needle STRING"), spark.createDataFrame([(t,) for t in right], "name STRING")
    )
    got = sorted((r.needle, r.name) for r in found.collect())
    assert got == sorted((a, b) for a in left if a for b in right if a in b)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_stored_postings_find_what_a_search_finds(spark):
    rng = random.Random(9)
    every = [t for t in texts(rng, 150) if t]
    needles = spark.createDataFrame([(t,) for t in texts(rng, 40) + every[:5] + ["", "o", "zz", "12"]], "needle STRING")
    path = scratch_dir(spark, "postings")
    with pytest.raises(ValueError):
        Postings(spark, path).names()
    stored = []
    for batch, part in enumerate((every[:60], every[40:110], [], every[100:] + [None])):
        names = spark.createDataFrame([(t,) for t in part + part[:3]], "name STRING")
        for _ in range(1 + batch % 2):  # some batches are written twice
            add_names(names, path, batch)
        stored = sorted({*stored, *(t for t in part if t is not None)})
        index = Postings(spark, path)
        assert pairs(index.names(), "name") == [(t,) for t in stored]
        right = spark.createDataFrame([(t,) for t in stored], "name STRING")
        assert pairs(index.similar(needles, 0.3), "needle", "name", "similarity") == pairs(se.trigram_join(needles, right, 0.3), "needle", "name", "similarity")
        assert pairs(index.containing(needles), "needle", "name") == pairs(se.contains_join(needles, right), "needle", "name")
    text = plan(index.similar(needles, 0.5))
    assert text.count("names") == 0 and "PushedFilters: [IsNotNull(gram)]" in text


@pytest.mark.parametrize("mode", ["name", "price_asc", "price_desc", "stores"])
def test_pages_by_the_last_key(spark, mode):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", None, "c"]), rng.choice([1, 2, 3, None]), rng.choice([1, 2, None])) for k in range(60)]
    df = spark.createDataFrame(rows, "product_id LONG, name STRING, min_price INT, store_count INT").repartition(4)
    whole = [tuple(r) for r in cat.sort_products(df, mode).collect()]
    got = [tuple(r) for r in cat.page(cat.sort_products(df, mode), 7).collect()]
    while len(got) < len(whole):
        last = dict(zip(df.columns, got[-1]))
        following = cat.page_after(df, last, mode, 7)
        assert "TakeOrderedAndProject" in plan(following)
        got += [tuple(r) for r in following.collect()]
    assert got == whole
    assert cat.page_after(df, dict(zip(df.columns, got[-1])), mode, 7).count() == 0
    with pytest.raises(ValueError):
        cat.page_after(df, last, mode, 0)
