"""Evaluation rows put together from answers, expected groups, retrieved chunks, traces and feedback.

Everything is an equi-join on question, chunk or trace; what is collected for one question is its
retrieved list, which has at most the retrieval limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import QUOTE_CHARS
from . import metrics

# Providers whose traces are real runs, the hops of a call, and the scores a judge may give.
REAL_PROVIDERS = ("litellm", "gemini")
HOPS = ("primary", "secondary", "tertiary", "local")
RUBRIC = (0.0, 0.5, 1.0)
SCORES = ("faithfulness", "answer_relevance", "context_relevance")


def run_questions(items: DataFrame, answers: DataFrame, groups: DataFrame, retrieved: DataFrame, k: int = 5) -> DataFrame:
    """items (question_id, category, requires_refusal), answers (question_id, refusal, cited), groups
    (question_id, group_no, chunk_id), retrieved (question_id, chunk_id, rank, score) -> an evaluation row
    for each item. Metrics are null without groups; an item without an answer counts as a refusal."""
    cited = answers.where(~F.col("refusal")).select("question_id", F.explode("cited").alias("chunk_id"))
    parts = [
        metrics.retrieval_metrics(retrieved, groups, k),
        metrics.share_relevant(retrieved.where(F.col("rank") <= k), groups, "context_precision"),
        metrics.share_relevant(cited, groups, "citation_accuracy"),
    ]
    out = items.join(answers.select("question_id", "refusal"), "question_id", "left").withColumn("refusal", F.coalesce("refusal", F.lit(True)))
    for p in parts:
        out = out.join(p, "question_id", "left")
    return out.withColumn("refusal_correct", F.col("requires_refusal") == F.col("refusal"))


def judge_contexts(answers: DataFrame, retrieved: DataFrame, texts: DataFrame) -> DataFrame:
    """(question_id, context) of answers that are no refusals: the retrieved texts in order, a blank line between."""
    met = answers.where(~F.col("refusal")).select("question_id").join(retrieved, "question_id").join(texts.select("chunk_id", "text"), "chunk_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return met.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("context"))


def judge_key(question: Column, answer: Column, context: Column) -> Column:
    """The key of a judged pair in every cache; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in (question, answer, context))), 256), 1, 24)


def respond(answers: DataFrame, retrieved: DataFrame, fixed: dict[str, str], preview: int = QUOTE_CHARS) -> DataFrame:
    """Responses: answers (request_id, debug, ...) as they are but for debug, plus, where debug asks for it and null elsewhere,
    retrieved_chunks, an array of (chunk_id, score, section, document_id, text_preview) in order of rank, and the values of fixed.
    retrieved (request_id, rank, chunk_id, score, section, document_id, text); texts of other requests are not gathered."""
    asked = answers.where("debug").select("request_id")
    row = F.struct("rank", "chunk_id", "score", "section", "document_id", F.substring("text", 1, preview).alias("text_preview"))
    shown = retrieved.join(asked, "request_id", "left_semi").groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("_r"))
    out = answers.join(shown, "request_id", "left")
    told = F.transform(F.coalesce("_r", F.array().cast(shown.schema["_r"].dataType)), lambda c: F.struct(*(c[n].alias(n) for n in ("chunk_id", "score", "section", "document_id", "text_preview"))))
    only = lambda x: F.when(F.col("debug"), x)
    return out.withColumns({"retrieved_chunks": only(told), **{k: only(F.lit(v)) for k, v in fixed.items()}}).drop("_r", "debug")


def parsed_scores(reply: Column) -> Column:
    """The scores in a judge's reply; a reply without them, or with others than the rubric's, raises."""
    fields = ", ".join(f"{s} double" for s in SCORES)
    found = F.from_json(reply, f"{fields}, hallucination boolean")
    good = F.coalesce(found["hallucination"].isNotNull(), F.lit(False))
    for s in SCORES:
        good = good & F.coalesce(found[s].isin(*RUBRIC), F.lit(False))
    return F.when(good, found).otherwise(F.raise_error(F.concat(F.lit("no scores in the judge's reply: "), F.coalesce(reply, F.lit("(none)")))).cast(f"struct<{', '.join(f'{s}:double' for s in SCORES)}, hallucination:boolean>"))


def judge(pairs: DataFrame, cache: DataFrame, call: Column) -> tuple[DataFrame, DataFrame]:
    """pairs (question_id, question, answer, context), cache (key, scores) -> (question_id, key, scores,
    cached) and the new cache. call makes the reply of a judge from pairs; only pairs that the cache lacks are called for."""
    keyed = pairs.withColumn("key", judge_key(F.col("question"), F.col("answer"), F.col("context")))
    new = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]).select("key", parsed_scores(call).alias("scores"))
    every = cache.select("key", "scores", F.lit(True).alias("cached")).unionByName(new.withColumn("cached", F.lit(False)))
    return keyed.join(every, "key").select("question_id", "key", "scores", "cached"), every.drop("cached")


def real_traces(traces: DataFrame) -> DataFrame:
    return traces.where(F.col("model_provider").isin(*REAL_PROVIDERS))


def golden_of_traces(traces: DataFrame, golden: DataFrame, order: str = "id") -> DataFrame:
    """Traces with the golden item of their question; of items with one question the last counts."""
    last = Window.partitionBy("question").orderBy(F.desc(order))
    items = golden.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return traces.join(items, "question")


def questions_of_feedback(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """Feedback with the question of its trace, null where the trace is gone."""
    return feedback.join(traces.select("trace_id", "question").dropDuplicates(["trace_id"]), "trace_id", "left")


def calibration_populations(matched: DataFrame, groups: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(trace_id, population, score): the best score of each matched trace (trace_id, id, requires_refusal)
    with retrieved rows (trace_id, chunk_id, score), groups (id, chunk_id). Without groups an item counts as one to answer."""
    best = retrieved.groupBy("trace_id").agg(F.max("score").alias("score"))
    met = matched.select("trace_id", "id").join(retrieved.select("trace_id", "chunk_id"), "trace_id").join(groups.select("id", "chunk_id").distinct(), ["id", "chunk_id"])
    hit = met.select("trace_id").distinct().withColumn("hit", F.lit(True))
    known = groups.select("id").distinct().withColumn("has", F.lit(True))
    out = matched.join(best, "trace_id").join(hit, "trace_id", "left").join(known, "id", "left")
    kind = F.when(F.col("requires_refusal"), "should_refuse").when(F.coalesce("hit", F.lit(False)) | F.col("has").isNull(), "should_answer").otherwise("should_answer_miss")
    return out.select("trace_id", kind.alias("population"), "score")


def route(available: Column, hops: tuple[str, ...] = HOPS) -> Column:
    """The first hop, in order, that is in an array of those that answer; null if none does."""
    return F.coalesce(*(F.when(F.array_contains(available, h), F.lit(h)) for h in hops))


def precision_recall(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """(label, tp, n_expected, n_actual, precision, recall) for each label, null where there is nothing to divide by."""
    pairs = rows.groupBy(expected, actual).agg(F.count("*").alias("n"))
    every = pairs.select(F.explode(F.array(F.struct(F.col(expected).alias("label"), F.col("n").alias("e"), F.lit(0).cast("long").alias("a")), F.struct(F.col(actual).alias("label"), F.lit(0).cast("long").alias("e"), F.col("n").alias("a")))).alias("x"), F.when(F.col(expected) == F.col(actual), F.col("n")).otherwise(0).alias("same"))
    out = every.groupBy("x.label").agg(F.sum(F.when(F.col("x.e") > 0, F.col("same")).otherwise(0)).alias("tp"), F.sum("x.e").alias("n_expected"), F.sum("x.a").alias("n_actual"))
    ratio = lambda n: F.when(F.col(n) > 0, F.col("tp") / F.col(n))
    return out.select("label", "tp", "n_expected", "n_actual", ratio("n_actual").alias("precision"), ratio("n_expected").alias("recall"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows chosen by a seeded hash of their key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
