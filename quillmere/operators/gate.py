"""The quality gate: thresholds and regressions of metrics, to BLOCK, WARN or PASS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The bounds of the gate. (metric, severity, least, most)
BOUNDS = [
    ("recall_at_5", "critical", 0.85, None),
    ("faithfulness", "critical", 0.85, None),
    ("answer_relevance", "critical", 0.80, None),
    ("hallucination_rate", "critical", None, 0.05),
    ("refusal_accuracy", "critical", 0.90, None),
    ("p95_latency_seconds", "critical", None, 6.0),
    ("error_rate", "critical", None, 0.02),
    ("citation_accuracy", "warning", 0.85, None),
    ("cost_per_request_usd", "warning", None, 0.005),
]
MAX_DROP = 0.03


def bounds(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or BOUNDS, "metric string, severity string, least double, most double")


def metric_rows(summaries: DataFrame, key: str) -> DataFrame:
    """Summaries, a row for each key, as (key, metric, value) under the gate's names."""
    named = {
        "recall_at_5": "recall", "faithfulness": "faithfulness", "answer_relevance": "answer_relevance", "hallucination_rate": "hallucination_rate", "refusal_accuracy": "refusal_accuracy",
        "p95_latency_seconds": "p95_latency_ms / 1000D", "error_rate": "error_rate", "citation_accuracy": "citation_accuracy", "cost_per_request_usd": "avg_cost_usd",
    }
    pairs = ", ".join(f"'{k}', cast({v} as double)" for k, v in named.items())
    return summaries.select(key, F.expr(f"stack({len(named)}, {pairs})").alias("metric", "value"))


def violations(current: DataFrame, baseline: DataFrame, config: DataFrame, key: str, max_drop: float = MAX_DROP) -> DataFrame:
    """(key, metric, severity, value, baseline, reason): every configured metric of every key; a missing
    value violates, and a threshold failure leaves regression and baseline out. Drops are absolute."""
    keys = current.select(key).distinct()
    base = baseline.select("metric", F.col("value").alias("baseline"))
    rows = keys.join(F.broadcast(config)).join(current, [key, "metric"], "left").join(base, "metric", "left")
    v, drop = F.col("value"), F.when(F.col("least").isNotNull(), F.col("baseline") - F.col("value")).otherwise(F.col("value") - F.col("baseline"))
    bound = F.when(v.isNull(), "missing").when((v < F.col("least")) | (v > F.col("most")), "threshold")
    bad = F.coalesce(bound, F.when((F.col("severity") == "critical") & (drop > max_drop), "regression"))
    return rows.select(key, "metric", "severity", "value", F.when(bound.isNull() & (F.col("severity") == "critical"), F.col("baseline")).alias("baseline"), bad.alias("reason"))


def decide(checked: DataFrame, key: str) -> DataFrame:
    """(key, status, critical, warning): sorted metric:reason texts."""
    told = lambda s: F.array_join(F.array_sort(F.collect_list(F.when((F.col("severity") == s) & F.col("reason").isNotNull(), F.concat_ws(":", "metric", "reason")))), ",")
    out = checked.groupBy(key).agg(told("critical").alias("critical"), told("warning").alias("warning"))
    return out.withColumn("status", F.when(F.col("critical") != "", "BLOCK").when(F.col("warning") != "", "WARN").otherwise("PASS"))


def exit_code(status: str) -> int:
    return int(status == "BLOCK")
