"""The text operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, collocations, decontaminate, fingerprints, langid, line_dedup, minhash_dedup, ngram_join, oracles, quality, secrets,
    suffix_dedup, url_filter, whitening,
)
from .common import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def vocabulary_path() -> str:
    """The byte-level vocabulary file installed on the machine that plans the job."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_suffix_dedup", oracles.SUFFIX_DEDUP)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read(spark, sf_dir, "documents"))


@query("op2_bpe_round_trip")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), vocabulary_path())


@query("op3_secret_spans")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read(spark, sf_dir, "documents"))


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2))
    return langid.identify(docs, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score"
    )


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    scored = quality.score(docs, quality.fit(docs, labels, "quality"))
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digests(read(spark, sf_dir, "documents"))


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(read(spark, sf_dir, "documents"), line_dedup.CORPUS)


@query("op9_url_verdicts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.fit(url_filter.labelled(spark))
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), weights)


@query("op7_decontaminate", oracles.DECONTAMINATE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op10_ngram_join", oracles.NGRAM_JOIN)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


@query("op11_collocations", oracles.COLLOCATIONS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, whitening.fit(vectors))


@query("op13_minhash_dedup", oracles.MINHASH_DEDUP)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.digests(read(spark, sf_dir, "documents"))
