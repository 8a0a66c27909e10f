"""Optimisation toggles as rows: one retrieval, and every configuration answers every question from it.

A configuration is a row of switches (cache, warm, compression, dynamic_k, routing), so a further one is a row more
and not another run. What does not depend on the switches (ranks, contexts in both sizes, tiers, cache neighbours)
is worked out once a question and joined; questions times configurations is all that is multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONTEXT_CHARS
from . import policy

CONFIG = "config_id string, cache boolean, warm boolean, compression boolean, dynamic_k boolean, routing boolean"
# The configurations that are compared; the fallback rate and the feedback-improved prompt are read from their runs.
CONFIGS = [
    ("O1_baseline", False, False, False, False, False), ("O2_cache_pass1_cold", True, False, False, False, False), ("O2_cache_pass2_warm", True, True, False, False, False),
    ("O3_compression", False, False, True, False, False), ("O4_dynamic_top_k", False, False, False, True, False), ("O5_routing", False, False, False, False, True), ("O7_combined", True, False, True, True, True),
]
#: Dollars for a million tokens of context, by tier; a parameter of the reports.
PRICES = {"cheap": 0.10, "balanced": 0.30, "strong": 1.25}


def contexts(questions: DataFrame, retrieved: DataFrame, texts: DataFrame) -> DataFrame:
    """(question_id, chunk_id, rank, whole, short): characters that a chunk adds to its question's context, cut and compressed."""
    met = retrieved.join(texts.select("chunk_id", "text"), "chunk_id").join(questions.select("question_id", "question"), "question_id")
    whole = F.least(F.length("text"), F.lit(CONTEXT_CHARS))
    return met.select("question_id", "chunk_id", "rank", F.coalesce(whole, F.lit(0)).alias("whole"), F.coalesce(F.least(F.length(policy.compress(F.col("text"), F.col("question"))), F.lit(CONTEXT_CHARS)), F.lit(0)).alias("short"))


def answered(configs: DataFrame, questions: DataFrame, retrieved: DataFrame, texts: DataFrame, relevant: DataFrame, alike: DataFrame, limit: int = 5, widest: int = 8) -> DataFrame:
    """A row for each configuration and question: k, refusal, refusal_correct, cache_result, fallback_hop, tier, chars, cost_usd, context_precision.

    configs (CONFIG), questions (question_id, seq, question, requires_refusal, hop: the provider that answers), retrieved (question_id,
    chunk_id, rank, score), relevant (question_id, chunk_id), alike (question_id, other): questions that a cache takes for the same.
    A cold cache knows the questions asked before, in order of seq, that were not refused; a warm one all of them."""
    scores = retrieved.groupBy("question_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("_s"))
    q = questions.join(scores, "question_id", "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<double>")))
    level = policy.complexity(F.col("question"))
    q = q.select("question_id", "seq", "requires_refusal", "hop", policy.dynamic_k(F.col("_s"), limit).alias("_k"), policy.refusal_reason(F.size("_s"), F.get("_s", 0)).isNotNull().alias("refusal"), policy.tier(F.lit("auto"), level).alias("_tier"))
    known = alike.join(q.where("not refusal").select(F.col("question_id").alias("other"), F.col("seq").alias("_at")), "other")
    earlier = known.join(q.select("question_id", "seq"), "question_id").groupBy("question_id").agg(F.max((F.col("_at") < F.col("seq")).cast("int")).alias("_cold"), F.lit(1).alias("_warm"))
    q = q.join(earlier, "question_id", "left")
    good = relevant.select("question_id", "chunk_id").distinct().withColumn("_good", F.lit(1.0))
    cells = contexts(questions, retrieved.where(F.col("rank") <= widest), texts).join(good, ["question_id", "chunk_id"], "left")
    cells = cells.groupBy("question_id").agg(F.collect_list(F.struct("rank", "whole", "short", F.coalesce("_good", F.lit(0.0)).alias("good"))).alias("_c"))
    every = q.join(cells, "question_id", "left").crossJoin(F.broadcast(configs))  # configurations are a few rows
    k = F.when(F.col("dynamic_k"), F.col("_k")).otherwise(F.lit(limit))
    tier = F.when(F.col("routing"), F.col("_tier")).otherwise("balanced")
    hit = F.col("cache") & ~F.col("refusal") & (F.coalesce(F.when(F.col("warm"), F.col("_warm")).otherwise(F.col("_cold")), F.lit(0)) == 1)
    every = every.withColumns({"k": k, "tier": tier, "_hit": hit}).withColumn("_c", F.filter(F.coalesce("_c", F.array().cast("array<struct<rank:int,whole:int,short:int,good:double>>")), lambda c: c["rank"] <= F.col("k")))
    add = lambda field: F.aggregate("_c", F.lit(0.0), lambda s, c: s + c[field].cast("double"))
    called = ~F.col("_hit") & ~F.col("refusal")
    chars = F.when(called, F.when(F.col("compression"), add("short")).otherwise(add("whole"))).otherwise(0.0)
    price = F.element_at(F.create_map(*(F.lit(x) for pair in PRICES.items() for x in pair)), F.col("tier"))
    return every.select(
        "config_id", "question_id", "k", "refusal", (F.col("refusal") == F.col("requires_refusal")).alias("refusal_correct"), F.when(F.col("cache"), F.when(F.col("_hit"), "hit").otherwise("miss")).alias("cache_result"),
        F.when(F.col("_hit"), "cache").when(F.col("refusal"), "n/a").otherwise(F.col("hop")).alias("fallback_hop"), "tier", chars.alias("chars"), (chars / 4 / 1e6 * price).alias("cost_usd"),
        F.when(F.size("_c") > 0, add("good") / F.size("_c")).alias("context_precision"),
    )


def passive(hop: Column) -> Column:
    """Share of provider calls that the primary did not serve."""
    return F.avg(F.when(hop.isNotNull() & ~hop.isin("cache", "n/a"), (hop != "primary").cast("double")))


def grid(rows: DataFrame) -> DataFrame:
    """A row for each configuration: means, cache hits of lookups, and the fallback rate over the calls of all."""
    out = rows.groupBy("config_id").agg(
        F.count("*").alias("n"), F.avg("context_precision").alias("context_precision"), F.avg(F.col("refusal_correct").cast("double")).alias("refusal_accuracy"), F.avg("k").alias("mean_k"), F.avg("chars").alias("mean_chars"),
        F.avg("cost_usd").alias("avg_cost_usd"), F.count(F.when(F.col("cache_result") == "hit", 1)).alias("cache_hits"), F.count("cache_result").alias("cache_lookups"),
    )
    return out.crossJoin(F.broadcast(rows.agg(passive(F.col("fallback_hop")).alias("passive_fallback_rate"))))  # one row
