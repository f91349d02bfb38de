"""Collocations, whitening and MinHash dedup against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tendero.llm import collocations, minhash_dedup, whitening
from tendero.llm.common import read
from tendero.llm.hashing import U64, mix
from tendero.llm.queries import QUERIES

from .conftest import table, words
from .test_operators import SF, same

# --- 11 -----------------------------------------------------------------------


def plain_collocations(rows, s):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, s.longest + 1):
                    if i + m <= len(w):
                        counts.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= s.least}
        best = []
        for p, a in found.items():
            n, cuts = totals[lang], []
            for k in range(1, len(p)):
                left, right = f[p[:k]], f[p[k:]]
                cuts.append((1000 * a * n // (left * right), k, left, right))
            inside = any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            if not inside:
                score, _, left, right = min(cuts)
                best.append((-score, -a, " ".join(p).encode(), left, right, n))
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(best)[: s.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    stock = ["The", "the", "of", "Ünder", "a", "b", "cat", "𝒳", "new", "york", "city", "re-do"]
    rows = []
    for k in range(120):
        text = "".join(rng.choice(stock) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for _ in range(rng.randint(0, 90)))
        rows.append((rng.choice(["en", "en", "fr", None]), text + "new york city" * (k % 3)))
    rows += [("en", None), ("fr", ""), ("de", " .,\n "), ("de", "one"), ("en", "a a a a a a a a a"), ("en", "the of " * 3000), (None, "x y. x y")]
    return rows + rows[:9]


def phrases(spark, rows):
    full = [(i, t, lang, 1, "w", 2, 3.0, "p") for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, f int, words string, n int, score double, phrase string").repartition(3)


@pytest.mark.parametrize("s", [
    collocations.Settings(least=4), collocations.Settings(least=3, top=7, broadcast=0), collocations.Settings(least=5, shard=50, chunk=200, span=100),
])
def test_collocations(spark, prose, s):
    want = plain_collocations(prose, s)
    assert len(want) > 20
    same(collocations.collocations(phrases(spark, prose), s).collect(), want)


def test_collocations_of_a_whole_table(spark):
    docs = [(r.lang, r.text) for r in read(spark, SF, "documents").collect()]
    same(QUERIES["op11_collocations"](spark, SF).collect(), plain_collocations(docs, collocations.Settings()))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(phrases(spark, [])).count() == 0
    assert collocations.collocations(phrases(spark, [("en", None), ("en", "")])).count() == 0
    assert collocations.collocations(phrases(spark, [("en", "rare words only")])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, left, right = 9_007_199_254_740, 7 * 10**17 + 3, 9_007_199_254_741 * 3, 999_999_999_999_989
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert df.select(collocations.exact_score("a", "n", "l", "r").alias("s")).first().s == 1000 * a * n // (left * right)


def test_transducers_give_back_their_windows():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5000):
        hashes = mix(rng.integers(0, 60, n).astype(U64))
        runs = np.cumsum(rng.random(n) < 0.2)
        c = collocations.windows_of(hashes, runs, 5)
        back = collocations.unpacked(collocations.packed(c))
        named = [np.concatenate([[U64(0)], x.words])[x.windows.astype(int)] for x in (c, back)]
        assert np.array_equal(named[0], named[1]) and np.array_equal(c.weights, back.weights)
        both = collocations.united([c, back])
        assert np.array_equal(both.weights, 2 * c.weights)


# --- 12 -----------------------------------------------------------------------


def plain_whitening(rows, s):
    """(id, x) of remaining vectors and the fit list's numbers by a dense decomposition."""
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = Counter(map(len, {tuple(np.floor(np.float64(np.float32(v)) * s.scale)) for _, v in fine})).most_common(1)[0][0]
    x = [(i, [int(np.floor(np.float64(np.float32(c)) * s.scale)) for c in v]) for i, v in fine if len(v) == dims]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit.astype(float) - sums.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[: s.components]
    deviation = {i: int(sum((n * c - t) ** 2 for c, t in zip(v, sums))) for i, v in x}
    projected = {i: (np.array(v, float) - sums.astype(float) / n) @ vectors[:, order] / np.sqrt(values[order]) for i, v in x}
    return n, deviation, projected, values[order] / values.sum()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, n int, component int, whitened double").repartition(4)


@pytest.fixture(scope="module")
def embeddings():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 20)) * np.linspace(3, 0.2, 20)
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, base[0].tolist()) for k in range(150)]  # copies count once
    rows += [(2000, None), (2001, [None] + base[1].tolist()[1:]), (2002, [float("nan")] * 20), (2003, [float("inf")] * 20), (2004, []), (2005, [1.0, 2.0])]
    rows += [(2006, [-0.0] * 20), (2007, [0.0] * 20), (None, base[2].tolist()), (5, base[5].tolist()), (2008, [-0.001] + [0.0] * 19)]
    return rows


def test_whitening(spark, embeddings):
    s = whitening.Settings(extra=4, block=64)
    df = vectors(spark, embeddings)
    model = whitening.fit(df, s)
    n, deviation, projected, explained = plain_whitening(embeddings, s)
    rows = whitening.whitened(df, model).collect()
    kept = [i for i, v in embeddings if i in projected and (v is not None)]
    assert Counter((r.vec_id, r.component) for r in rows) == Counter((i, c) for i in kept for c in range(1, 5))
    signs = {}
    for r in rows:
        want = projected[r.vec_id][r.component - 1]
        sign = signs.setdefault(r.component, np.sign(r.whitened * want) if abs(want) > 0.1 else None)
        if sign is None:
            del signs[r.component]
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert abs(abs(r.whitened) - abs(want)) < 1e-8 and (not sign or abs(sign * r.whitened - want) < 1e-8)


def test_whitening_of_a_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, SF, "embeddings").collect()]
    n, deviation, _, explained = plain_whitening(rows, whitening.Settings())
    got = QUERIES["op12_whitening"](spark, SF).collect()
    assert len(got) == 4 * len(deviation)
    assert all(r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9 for r in got)
    assert all(abs(r.explained / explained[r.component - 1] - 1) < 1e-9 for r in got)


def test_whitening_of_close_eigenvalues():
    """Clustered spectrum, as of noise: still double precision, by products alone."""
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    values = np.concatenate([[1704, 1665, 1092, 1081.06, 1080.9], np.linspace(1074, 925, 59)])
    matrix = (q * values) @ q.T
    calls = []
    got, found = whitening.leading(lambda x: (calls.append(x.shape), matrix @ x)[1], 64, whitening.Settings())
    assert np.allclose(got, values[:4], rtol=1e-13) and np.abs(np.abs(np.sum(found * q[:, :4], axis=0)) - 1).max() < 1e-12
    assert np.linalg.norm(matrix @ found - found * got) < 1e-10 and len(calls) < 120


def test_whitening_of_little(spark):
    def run(rows, **s):
        df = vectors(spark, rows)
        return whitening.whitened(df, whitening.fit(df, whitening.Settings(**s))).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [])]) == []
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # one different vector has no spread
    rows = run([(1, [1.0, 0.0, 5.0]), (2, [2.0, 0.0, 5.0]), (3, [4.0, 0.0, 5.0])])
    assert {r.component for r in rows} == {1} and len(rows) == 3 and abs(rows[0].explained - 1) < 1e-12
    huge = run([(1, [1e12]), (2, [-1e12]), (3, [3e30])])
    assert len(huge) == 2 and all(r.deviation is None for r in huge)


def test_exact_sums(spark):
    x = np.array([[2**62, -3], [2**62, 5], [-(2**61), 7]], dtype=object)
    rows = [(1, c) for c in whitening.encoded(x.astype(np.int64))]
    fit = spark.createDataFrame([(2, bytearray(c)) for _, c in rows], "dims int, code binary")
    n, sums, squares = whitening.moments(whitening.packed(fit, 2, whitening.Settings(block=2)), 2)
    assert (n, sums, squares) == (3, x.sum(axis=0).tolist(), (x * x).sum(axis=0).tolist())


# --- 13 -----------------------------------------------------------------------


def plain_components(rows, percent=85):
    def shingles(t):
        w = re.findall(r"[^ \t\n\r\f\v]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    for k, (i, _) in enumerate(rows):
        c = least.get(top(k)) if sets[k] else i
        yield i, len(sets[k]), c, i is not None and i == c


@pytest.fixture(scope="module")
def family():
    """Copies edited again and again: chains, cliques, and relatives below the threshold."""
    rng = random.Random(11)
    rows = []
    for f in range(4):
        parts = words(rng, 120).split(" ")
        for k in range(25):
            rows.append((f * 100 + k, " ".join(parts)))
            if k % 6 == 5:
                parts[: 14 + f * 4] = words(rng, 14 + f * 4).split(" ")
            else:
                parts[rng.randrange(len(parts))] = f"w{k}"
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("s", [minhash_dedup.Settings(), minhash_dedup.Settings(rounds=0, block=3), minhash_dedup.Settings(rounds=1, block=4, broadcast=0)])
def test_minhash_dedup(spark, rows, family, s):
    every = rows + [(i + 5000, t) for i, t in family] + [(7, rows[9][1]), (9000, (rows[10][1] or "").upper().replace(" ", "\n"))]
    got = minhash_dedup.digests(table(spark, every).repartition(5), s).collect()
    want = list(plain_components(every))
    assert len({c for _, _, c, _ in want}) < len({i for i, *_ in want}) - 60
    same(got, want)


def test_minhash_dedup_of_nothing_and_columns(spark, docs, rows, no_docs):
    assert minhash_dedup.digests(no_docs).count() == 0
    assert minhash_dedup.digests(table(spark, [(1, None), (2, ""), (None, " ")])).count() == 3
    kept = minhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    gone = {i for i, _, c, _ in plain_components(rows) if i is not None and i != c}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None and i not in gone)


def test_bins_agree_as_often_as_sets_are_similar():
    s = minhash_dedup.Settings()
    ask = minhash_dedup.probes(s.bins)
    rng = np.random.default_rng(2)
    for n in (8, 40, 400):
        agree = []
        for _ in range(150):
            a = rng.integers(1, 1 << 62, n).astype(U64)
            b = np.concatenate([a[: n * 3 // 4], rng.integers(1, 1 << 62, n // 4).astype(U64)])
            agree.append((minhash_dedup.one_permutation(a, s.bins, ask) == minhash_dedup.one_permutation(b, s.bins, ask)).mean())
        assert abs(np.mean(agree) - 0.6) < 0.03
