"""A training corpus from raw documents, in stages written and read again.

Language ID drops what has no language, line dedup cuts repeated lines, the n-gram
join keeps one document of each group of near copies, decontamination drops
documents with benchmark passages, and byte-level BPE turns the rest into tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendero.llm import bpe, decontaminate, langid, line_dedup, ngram_join
from tendero.llm.common import fold, prepare, read, staged
from tendero.llm.queries import vocabulary_path

LEAST_SCORE = 0.5  # posterior of the language below which a document is rejected


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: a text without letters, a null text and one
    without a likely language go. The model learns from three quarters of the rows."""
    prepare(spark)
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2))
    known = docs.withColumn("__language", langid.predictor(docs, model)("text"))
    known = known.filter((F.col("__language.lang_pred") != langid.UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE))
    return known.select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document or line has; a document that
    is left without a text goes."""
    prepare(spark)
    kept = line_dedup.dedup(docs, line_dedup.CORPUS).filter((F.col("__removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar to 0.8."""
    prepare(spark)
    return ngram_join.keep_one(docs).select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with the benchmark."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    prepare(spark)
    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("tokens", tokens),
]

# Models, similarity classes and token ids have no SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
