"""Comparisons of configurations, and the joins between traces, golden items and evaluation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import stored
from . import metrics, scan, search, windows

MODES = ("cheap", "balanced", "strong", "auto")
SEED_CATEGORIES = ("multi_hop", "ambiguous")
QUESTION_CHARS = (3, 2000)


def retrieval_grid(configs: list[dict], query: str, doc: str, dense: DataFrame, sparse: DataFrame, groups: DataFrame, k: int = 5) -> DataFrame:
    """A row of mean metrics for each configuration (config_id, mode, prefetch); all share the two score tables."""

    def run(c: dict) -> DataFrame:
        found = search.retrieve(c["mode"], query, doc, dense, sparse, limit=c.get("limit", k), prefetch=c.get("prefetch", search.PREFETCH))
        ranked = found.select(F.col(query).alias("question_id"), F.col(doc).alias("chunk_id"), "rank")
        return metrics.mean_metrics(metrics.retrieval_metrics(ranked, groups, k)).withColumns({"config_id": F.lit(c["config_id"]), "mode": F.lit(c["mode"])})

    return reduce(DataFrame.unionByName, map(run, configs))


def compare_corpora(texts: DataFrame, questions: DataFrame, groups: DataFrame, k: int = 5, by: tuple[str, ...] = ("config_id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One retrieval over several corpora, such as the chunkings of one collection: texts (by..., chunk_id, document_id, text), questions
    (question_id, text), groups (question_id, group_no, chunk_id) where chunk_id is a document.

    Returns ranked (by..., question_id, chunk_id, document_id, score, rank), means (by..., n, recall, hit, mrr, ndcg) and misses (by..., question_id,
    best), the questions with groups of which no document is among the k best, with the document ranked first. Terms, statistics and ranks are keyed by corpus,
    so a corpus more is rows more, not a job more; each text is tokenised once. A document found by several chunks counts at its best rank."""
    return _compared(*scan.sparse_corpora(texts, "chunk_id", questions, "question_id", k, by=by, carry=("document_id",)), groups, k, by)


def compare_windows(documents: DataFrame, sizes: dict[str, tuple[int, int]], questions: DataFrame, groups: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """compare_corpora of windows of words of the documents (document_id, text); sizes has the (size, overlap) of each config_id. No window is made a row."""
    return _compared(*windows.top_windows(documents, "document_id", sizes, questions, "question_id", k), groups, k, ("config_id",))


def _compared(best: DataFrame, runs: DataFrame, groups: DataFrame, k: int, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    ranked = stored(best.select(*by, "question_id", "chunk_id", "document_id", "score", "rank"), "ranked")
    runs = stored(runs, "corpora")
    pair = F.to_json(F.struct(*by, "question_id"), {"ignoreNullFields": "false"})
    firsts = ranked.groupBy(*by, "question_id", "document_id").agg(F.min("rank").alias("rank")).select(pair.alias("question_id"), F.col("document_id").alias("chunk_id"), "rank")
    wanted = runs.crossJoin(groups).select(pair.alias("question_id"), "group_no", "chunk_id")
    keys = runs.crossJoin(groups.select("question_id").distinct()).select(*by, "question_id", pair.alias("_pair"))
    each = metrics.retrieval_metrics(firsts, wanted, k).withColumnRenamed("question_id", "_pair").join(keys, "_pair").drop("_pair")
    each = stored(each, "per-question")
    means = each.where("recall is not null").groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("recall", "hit", "mrr", "ndcg")))
    misses = each.where("hit = 0").select(*by, "question_id").join(ranked.where("rank = 1").select(*by, "question_id", F.col("document_id").alias("best")), [*by, "question_id"], "left")
    return ranked, means, misses


def prompt_stats(rows: DataFrame, version: str = "prompt_version") -> DataFrame:
    """rows (prompt_version, parse_ok, requires_refusal, refusal, citation_valid, grounded, tokens, latency_ms)."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy(version).agg(F.count("*").alias("n"), mean("parse_ok").alias("parse_ok"), F.avg((F.col("requires_refusal") == F.col("refusal")).cast("double")).alias("refusal_accuracy"), mean("citation_valid").alias("citation_valid"), mean("grounded").alias("grounded"), mean("tokens").alias("tokens"), mean("latency_ms").alias("latency_ms"))


def best_prompt(stats: DataFrame, version: str = "prompt_version") -> DataFrame:
    """The best version by refusal accuracy plus grounding, then valid citations, then few tokens; null counts as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return stats.orderBy(F.desc(F.round(zero("refusal_accuracy") + zero("grounded"), 9)), F.desc(F.round(zero("citation_valid"), 9)), F.round(zero("tokens"), 9), version).limit(1)


def earliest(traces: DataFrame, key: str, *order: str) -> DataFrame:
    """The first trace of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return traces.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def seed_feedback(rows: DataFrame, golden: DataFrame, traces: DataFrame) -> DataFrame:
    """Evaluation rows that should become feedback: of two categories, with partly wrong citations, served by
    the primary; joined to their question and its first trace. missing says what was not found."""
    picked = rows.where(F.col("category").isin(*SEED_CATEGORIES) & (F.col("citation_accuracy") >= 0) & (F.col("citation_accuracy") < 1) & (F.col("fallback_hop") == "primary"))
    met = picked.join(golden.select("question_id", "question"), "question_id", "left")
    first = earliest(traces, "question", "created_at", "trace_id").select("question", "trace_id")
    met = met.join(first, "question", "left")
    return met.select("question_id", "trace_id", F.when(F.col("question").isNull(), "golden").when(F.col("trace_id").isNull(), "trace").alias("missing"))


def valid_request(question: Column, mode: Column) -> Column:
    """Null for a good request, else what is wrong with it."""
    n = F.length(F.coalesce(question, F.lit("")))
    return F.when((n < QUESTION_CHARS[0]) | (n > QUESTION_CHARS[1]), "question").when(~F.coalesce(mode.isin(*MODES), F.lit(False)), "mode")


def select_items(items: DataFrame, mode: str, category: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """The golden items of a run: full, targeted (one category) or listed (in the order of the list)."""
    if mode == "full":
        return items
    if mode == "targeted":
        found = items.where(F.col("category") == category)
        if not found.limit(1).count():
            raise ValueError(f"no item of category {category!r}")
        return found
    if mode == "listed":
        order = F.array_position(F.array(*map(F.lit, ids or [])), F.col("id"))
        return items.withColumn("_at", order).where("_at > 0").orderBy("_at").drop("_at")
    raise ValueError(f"unknown mode {mode!r}")
