"""Corpus pipeline over documents: each stage reads what the one before it kept.

language    drops documents without a language ('und'), of a doubtful one (score under LEAST_SCORE), or
            too unlike the texts of their language (fit under LEAST_FIT: languages that were not learned,
            no language at all)
near_dedup  keeps the document with the smallest doc_id of each near-duplicate class
benchmark   drops documents that hold a benchmark window
pii         puts each span of personal data as its kind in brackets, and counts n_chars anew
mixing      chooses documents by the weights of domain, language and source; adds its columns

Stages but the last return the columns that they were given, whatever the names of extra ones; mixing
replaces columns named as its results. Rows of one doc_id (null is one) stay together, if any of them is
to stay. Null texts have no language and go in the first stage. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import decontam, langid, mixing, near_dup, pii
from quillmere.llm.shared import free_prefix, table, written

LEAST_SCORE, LEAST_FIT = 0.5, -20.0


def _where(docs: DataFrame, verdicts: DataFrame, condition: str) -> DataFrame:
    """Rows of docs whose doc_id has a verdict that meets the condition; null is a doc_id like others.

    Every row has a verdict, so what goes is known by the ids of which no verdict meets it. Those ids alone
    meet the texts: Spark broadcasts their stored table if it is under its threshold, and exchanges both sides beyond."""
    stays = F.max(F.coalesce(F.expr(condition), F.lit(False)))
    lost = verdicts.groupBy("doc_id").agg(stays.alias("stays")).where("not stays").select(F.col("doc_id").alias("lost_id"))
    lost = written(lost, "rejected")
    return docs.join(lost, docs["doc_id"].eqNullSafe(lost["lost_id"]), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _where(docs, langid.trained_on(docs).predict(docs), f"lang_pred <> 'und' and score >= {LEAST_SCORE} and fit >= {LEAST_FIT}")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _where(docs, near_dup.classes(docs), "kept")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _where(docs, decontam.contamination(docs, table(spark, sf_dir, "benchmark")), "not contaminated")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Each column is used twice by the next, so that every step is evaluated once and stays small.
    spans = free_prefix(docs) + "_spans"
    found = docs.withColumn(spans, pii.spans_of(F.col("text"), pii.SpanClassifier().fit(docs)))
    text = F.when(F.size(spans) > 0, pii.redacted(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).drop(spans)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("benchmark", benchmark), ("pii", private), ("mixing", mixture)]
#: Trained language and span models decide which rows stay and what they hold: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
