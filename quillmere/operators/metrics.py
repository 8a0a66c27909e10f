"""Retrieval and answer metrics, percentiles, agreement, confusion. Nothing to score is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUALITY = ("context_precision", "citation_accuracy", "faithfulness", "answer_relevance", "context_relevance")
NOT_FALLBACK = ("primary", "n/a", "unknown")


def retrieval_metrics(retrieved: DataFrame, groups: DataFrame, k: int = 5) -> DataFrame:
    """retrieved (question_id, chunk_id, rank), groups (question_id, group_no, chunk_id) -> per question
    of groups: recall, hit, mrr, ndcg. Groups may share chunks: a fold over the ranked chunks gives a
    gain to each chunk and group once, in the order of the groups."""
    g = groups.where("chunk_id is not null").select("question_id", "group_no", "chunk_id").distinct()
    n = g.groupBy("question_id").agg(F.count_distinct("group_no").alias("n_groups"))
    met = retrieved.select("question_id", "chunk_id", "rank").join(g, ["question_id", "chunk_id"])
    got = met.groupBy("question_id").agg(
        F.count_distinct(F.when(F.col("rank") <= k, F.col("group_no"))).alias("covered"),
        F.min("rank").alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "group_no")))).alias("hits"),
    )
    zero = F.struct(F.lit(0).alias("rank"), F.array().cast("array<bigint>").alias("used"), F.lit(0.0).alias("dcg"))

    def step(acc: Column, h: Column) -> Column:
        take = (h["rank"] > acc["rank"]) & ~F.array_contains(acc["used"], h["group_no"].cast("bigint"))
        return F.struct(
            F.when(take, h["rank"]).otherwise(acc["rank"]).cast("int").alias("rank"),
            F.when(take, F.concat(acc["used"], F.array(h["group_no"].cast("bigint")))).otherwise(acc["used"]).alias("used"),
            (acc["dcg"] + F.when(take, F.lit(1.0) / F.log2(h["rank"] + 1.0)).otherwise(0.0)).alias("dcg"),
        )

    dcg = F.aggregate("hits", zero, step, lambda acc: acc["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_groups"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1.0))
    out = groups.select("question_id").distinct().join(n, "question_id", "left").join(got, "question_id", "left")
    some = F.col("n_groups") > 0
    return out.select(
        "question_id",
        F.when(some, F.coalesce("covered", F.lit(0)) / F.col("n_groups")).alias("recall"),
        F.when(some, (F.coalesce("covered", F.lit(0)) > 0).cast("double")).alias("hit"),
        F.when(some, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(some, F.coalesce(dcg, F.lit(0.0)) / ideal).alias("ndcg"),
    )


def mean_metrics(per_question: DataFrame) -> DataFrame:
    """One row: n scored questions and the means."""
    return per_question.where("recall is not null").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("recall", "hit", "mrr", "ndcg")))


def share_relevant(items: DataFrame, relevant: DataFrame, name: str) -> DataFrame:
    """Share of a question's items (question_id, chunk_id) that are relevant (question_id, chunk_id);
    null for questions without items or without relevant chunks. Context precision over retrieved
    chunks, citation accuracy over cited ones."""
    r = relevant.where("chunk_id is not null").select("question_id", "chunk_id").distinct()
    has = r.select("question_id").distinct().withColumn("_has", F.lit(True))
    met = items.join(r.withColumn("_rel", F.lit(1.0)), ["question_id", "chunk_id"], "left").groupBy("question_id").agg(F.avg(F.coalesce("_rel", F.lit(0.0))).alias("_p"))
    return met.join(has, "question_id", "left").select("question_id", F.when(F.col("_has"), F.col("_p")).alias(name))


def percentiles(rows: DataFrame, by: list[str], x: Column, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(by..., a column for each of wanted: (definition, p)), over non-null x, null for groups without one:
    a  sorted[max(0, int(n p) - 1)], round 1    b  the median, else as a, not rounded
    c  sorted[min(n - 1, int(n p))]             d  sorted[n // 2] for the median, else sorted[int(n p) - 1]
    e  sorted[int(n p) - 1], where -1 is the last.
    Values are counted first (combined before the exchange), and places are found on the running counts
    of a group's distinct values: no group's rows are gathered."""
    counts = rows.select(*by, x.alias("_x")).groupBy(*by, "_x").agg(F.count("_x").alias("_n"))
    every = Window.partitionBy(*by)
    up = F.sum("_n").over(every.orderBy(F.col("_x").asc_nulls_first()))
    counts = counts.withColumn("_up", up).withColumn("_all", F.sum("_n").over(every))
    n = F.col("_all")

    def value(kind: str, p: float) -> Column:
        at = F.floor(n * F.lit(p))
        before = F.when(at < 1, n - 1).otherwise(at - 1)
        place = {"a": F.greatest(F.lit(0), at - 1), "b": F.greatest(F.lit(0), at - 1), "c": F.least(n - 1, at), "d": F.floor(n / 2) if p == 0.5 else before, "e": before}[kind]
        get = lambda k: F.min(F.when((F.col("_up") > k) & (F.col("_n") > 0), F.col("_x")))
        if kind == "b" and p == 0.5:
            return (get(F.floor((n - 1) / 2)) + get(F.floor(n / 2))) / 2
        return F.round(get(place), 1) if kind == "a" else get(place)

    return counts.groupBy(*by).agg(*(value(k, p).alias(name) for name, (k, p) in wanted.items()))


def evaluation_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Means that skip nulls, by the given columns: quality, refusals, judge, latency, cost, fallback, errors.

    rows: the QUALITY metrics, recall, hit, mrr, ndcg, requires_refusal, refusal, hallucination, judged,
    latency_ms, cost_usd, fallback_hop, n_errors."""
    judged = lambda c: F.avg(F.when(F.col("judged"), F.col(c)))
    timed = F.when(F.col("latency_ms") > 0, F.col("latency_ms").cast("double"))
    hop = F.col("fallback_hop")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        *(F.avg(c).alias(c) for c in ("recall", "hit", "mrr", "ndcg", "context_precision", "citation_accuracy")),
        *(judged(c).alias(c) for c in ("faithfulness", "answer_relevance", "context_relevance")),
        judged("hallucination").alias("hallucination_rate"),
        F.sum(F.col("judged").cast("long")).alias("n_judged"),
        F.avg((F.col("requires_refusal") == F.col("refusal")).cast("double")).alias("refusal_accuracy"),
        F.avg("cost_usd").alias("avg_cost_usd"),
        F.avg((F.coalesce(hop, F.lit("n/a")).isin(*NOT_FALLBACK) == F.lit(False)).cast("double")).alias("fallback_rate"),
        F.avg((F.col("n_errors") > 0).cast("double")).alias("error_rate"),
    )
    late = percentiles(rows, [*by], timed, {"p50_latency_ms": ("a", 0.5), "p95_latency_ms": ("a", 0.95)})
    if not by:
        return out.crossJoin(F.broadcast(late))  # one row each
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"l.{c}"))
    return out.alias("o").join(late.alias("l"), same).select("o.*", "p50_latency_ms", "p95_latency_ms")


def passive_fallback_rate() -> Column:
    """Share of real provider calls that the primary did not serve; cache, n/a and null are no calls."""
    hop = F.col("fallback_hop")
    return F.avg(F.when(hop.isNotNull() & ~hop.isin("cache", "n/a"), (hop != "primary").cast("double")))


def agreement(a: str, b: str) -> list[Column]:
    """Of two judges' scores where both are there: pairs, mean absolute difference, exact matches; round 3."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return [
        F.sum(both.cast("long")).alias("n_pairs"),
        F.round(F.avg(F.when(both, F.abs(F.col(a) - F.col(b)))), 3).alias("mean_abs_diff"),
        F.round(F.avg(F.when(both, (F.col(a) == F.col(b)).cast("double"))), 3).alias("exact_match_rate"),
    ]


def inter_judge(rows: DataFrame, *by: str) -> DataFrame:
    """rows (by..., judge, judge2), both null or (faithfulness, answer_relevance, context_relevance, hallucination) -> of the pairs that both
    judged: n_pairs, by score the mean absolute difference and exact matches, and how often they agree on hallucination; round 3."""
    both = rows.where("judge is not null and judge2 is not null")
    told = [F.count("*").alias("n_pairs")]
    for c in ("faithfulness", "answer_relevance", "context_relevance"):
        a, b = F.col(f"judge.{c}"), F.col(f"judge2.{c}")
        told += [F.round(F.avg(F.abs(a - b)), 3).alias(f"{c}_mean_abs_diff"), F.round(F.avg((a == b).cast("double")), 3).alias(f"{c}_exact_match_rate")]
    same = F.col("judge.hallucination") == F.col("judge2.hallucination")
    return both.groupBy(*by).agg(*told, F.round(F.avg(same.cast("double")), 3).alias("hallucination_agreement_rate"))


def target_verdict(metric: Column, value: Column, target: Column) -> Column:
    """PASS or FAIL against a target, blank without a value; hallucination and p95 should be at most it."""
    low = F.contains(metric, F.lit("hallucination")) | F.contains(metric, F.lit("p95"))
    return F.when(value.isNull(), "").when(F.when(low, value <= target).otherwise(value >= target), "PASS").otherwise("FAIL")


def confusion(rows: DataFrame, expected: str, actual: str, classes: list[str]) -> DataFrame:
    return rows.groupBy(expected).pivot(actual, classes).count().na.fill(0, classes)


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, share), most common first when sorted; the share is of all rows."""
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def failed(least: float = 1.0) -> Column:
    """A failed question: refusal wrong, hallucination, citation or context below 1; nulls do not fail."""
    false = F.lit(False)
    return (
        F.coalesce(F.col("requires_refusal") != F.col("refusal"), false)
        | F.coalesce(F.col("hallucination") > 0, false)
        | F.coalesce(F.col("citation_accuracy") < least, false)
        | F.coalesce(F.col("faithfulness") < least, false)
    )


def failure_reasons() -> Column:
    """All reasons of a report for a question to have failed, joined by '; ', empty if there is none.
    Columns: requires_refusal, refusal, hit, citation_accuracy, judged, judge_error, faithfulness,
    hallucination, ambiguity_handled, error_labels; nulls give no reason. The words are fixed values."""
    told = lambda b: F.when(b, "True").otherwise("False")
    refusal = F.format_string("refusal_sai (kỳ vọng refusal=%s, thực tế=%s)", told(F.col("requires_refusal")), told(F.col("refusal")))
    judged = F.col("judged") & ~F.col("judge_error")
    return F.concat_ws(
        "; ",
        F.when(F.col("requires_refusal") != F.col("refusal"), refusal),
        F.when(F.col("hit") == 0, "retrieval_miss (hit@k=0)"),
        F.when(F.col("citation_accuracy") < 1, F.format_string("citation_sai (%.2f)", "citation_accuracy")),
        F.when(judged & (F.col("faithfulness") < 1), F.concat(F.lit("faithfulness="), F.col("faithfulness").cast("string"))),
        F.when(judged & (F.col("hallucination") > 0), "hallucination"),
        F.when(F.col("judged") & F.col("judge_error"), "judge_error"),
        F.when(~F.col("ambiguity_handled"), "ambiguity_unhandled (chốt 1 nhánh, không hỏi lại/bao quát)"),
        F.when(F.size("error_labels") > 0, F.concat(F.lit("trace_error:"), F.array_join("error_labels", ","))),
    )
