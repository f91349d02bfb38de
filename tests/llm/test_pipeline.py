"""Each stage of the pipeline against a plain version of it, on its own input."""

import corpus_pipeline as cp
from tendero.llm.common import read

from .conftest import table
from .test_operators import plain_decontaminate, plain_line_dedup, plain_ngram_join, sha
from tendero.llm import line_dedup

SF = "/root/testdata/sf0.001"


def pairs(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect())


def test_stages(spark):
    docs = read(spark, SF, "documents")
    bench = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    at = docs
    for name, stage in cp.STAGES[:-1]:
        rows = [(r.doc_id, r.text) for r in at.select("doc_id", "text").collect()]
        got = stage(spark, at, SF)
        assert got.columns == docs.columns, name
        kept = {r.doc_id: r for r in got.collect()}
        if name == "language":
            assert len(kept) >= 0.98 * len(rows)
        elif name == "lines":
            want = plain_line_dedup(rows, line_dedup.CORPUS)
            for i, t in rows:
                if want[i, t][1] == 0:
                    assert kept[i].text == t
                elif i in kept:
                    assert sha(kept[i].text) == want[i, t][2] and kept[i].n_chars == len(kept[i].text)
                else:
                    assert want[i, t][2] in {sha("\n" * k) for k in range(want[i, t][0])}, t
        elif name == "near_duplicates":
            assert set(kept) == {c for _, c, *_ in plain_ngram_join(rows)}
        elif name == "contamination":
            assert set(kept) == {i for i, *_, hit in plain_decontaminate(rows, bench, 10) if not hit}
        at = spark.createDataFrame(list(kept.values()), docs.schema)
    last = cp.STAGES[-1][1](spark, at, SF)
    assert last.count() == at.count()


def test_edges(spark, docs, no_docs):
    at = docs
    for name, stage in cp.STAGES:
        at = stage(spark, at, SF)
        if name != cp.STAGES[-1][0]:
            assert at.columns == docs.columns
            at = table(spark, []).unionByName(at).cache()
        assert at.count() > 0, name
    for name, stage in cp.STAGES:
        assert stage(spark, no_docs, SF).count() == 0, name


def test_lines_cut_equal_short_lines_and_two_edits(spark):
    texts = ["Les.\nfirst of many lines", "And.\nLes.\nfirst af many line", "Les.", "And.\n\nAnd"]
    got = cp.lines(spark, table(spark, list(enumerate(texts))), SF).select("doc_id", "text", "n_chars").collect()
    assert sorted(map(tuple, got)) == [(0, texts[0], len(texts[0])), (1, "And.", 4), (3, "\nAnd", 4)]


def test_stages_after_whole_lines(spark):
    """What follows the stage lines, on its own output."""
    bench = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    docs = cp.lines(spark, read(spark, SF, "documents"), SF).cache()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = {r.doc_id for r in cp.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert kept == {c for _, c, *_ in plain_ngram_join(rows)}
    kept = {r.doc_id for r in cp.contamination(spark, docs, SF).select("doc_id").collect()}
    assert kept == {i for i, *_, hit in plain_decontaminate(rows, bench, 10) if not hit}
