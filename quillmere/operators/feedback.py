"""Feedback: labels, clusters with diverse samples, backlog, store with checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import jaccard, tokens
from ..sources.stored import stored

# The taxonomy of feedback.
TYPES = ("thumbs_up", "thumbs_down", "wrong_answer", "missing_citation", "outdated_information", "slow_response", "unsafe_answer")
DIRECT = {"missing_citation": "citation_error", "outdated_information": "stale_data", "slow_response": "cost_latency_issue", "unsafe_answer": "refusal_error"}
FIXES = {
    "retrieval_failure": "retrieval",
    "context_insufficient": "retrieval",
    "hallucination": "prompt",
    "citation_error": "prompt",
    "refusal_error": "prompt",
    "stale_data": "data",
    "prompt_injection": "prompt",
    "provider_error": "routing",
    "cost_latency_issue": "routing",
}
SOURCES, STATUSES = ("user", "eval_seed"), ("open", "reviewed", "actioned")
SIMILAR, SAMPLES = 0.8, 3


def error_label(kind: Column, errors: Column, invalid: Column, refusal: Column, hop: Column) -> Column:
    """The label of a feedback by its type, else by its trace; null for praise."""
    out = F.when(kind == "thumbs_up", F.lit(None).cast("string"))
    for k, label in DIRECT.items():
        out = out.when(kind == k, label)
    errors = F.coalesce(errors, F.array().cast("array<string>"))
    out = out.when((F.size(F.coalesce(invalid, F.array().cast("array<string>"))) > 0) | F.array_contains(errors, "invalid_citations_dropped"), "citation_error")
    out = out.when(F.coalesce(refusal, F.lit(False)), "refusal_error").when(hop.isNotNull() & ~hop.isin("primary", "n/a"), "provider_error")
    return out.when(F.array_contains(errors, "low_score") | F.array_contains(errors, "no_context"), "retrieval_failure").otherwise("hallucination")


def suggested_fix(label: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in FIXES.items() for x in kv))
    return F.coalesce(F.element_at(known, label), F.lit("review"))


def diverse(texts: Column, similar: float = SIMILAR, most: int = SAMPLES) -> Column:
    """Up to most texts of a short list, each unlike those before it: a fold in their order. For clusters, `with_samples`."""

    def step(kept: Column, t: Column) -> Column:
        like = F.exists(kept, lambda k: jaccard(F.array_distinct(tokens(k, unicode=False)), F.array_distinct(tokens(t, unicode=False))) > similar)
        return F.when((F.size(kept) >= most) | like, kept).otherwise(F.concat(kept, F.array(t)))

    return F.aggregate(texts, F.array().cast("array<string>"), step)


def clusters(feedback: DataFrame, order: str = "seq") -> DataFrame:
    """feedback (feedback_id, error_label, category, question, seq) -> a row for each label and category
    (nulls are a value): size, first seq, ids in order. Largest first when sorted by (size desc, first).
    The ids of a cluster are its row's; `review_queue` has them as rows, for clusters beyond one row's size."""
    rows = F.array_sort(F.collect_list(F.struct(order, "feedback_id")))
    out = feedback.groupBy("error_label", "category").agg(F.count("*").alias("size"), F.min(order).alias("first"), rows.alias("_r"))
    return out.select("error_label", "category", "size", "first", F.transform("_r", lambda x: x["feedback_id"]).alias("feedback_ids"))


def with_samples(feedback: DataFrame, order: str = "seq", similar: float = SIMILAR, most: int = SAMPLES) -> DataFrame:
    """(error_label, category, samples) of the clusters: of its questions in order (feedback_id on a tie), each that is unlike all taken before
    it, most of them; null and empty questions are passed over, a cluster without any has none.

    A round finds the next sample of every cluster: the first question after the last one taken whose token overlap (Jaccard) with each taken is
    at most similar. What was rejected once stays so, as the taken ones only grow. A round is a join with the few taken rows and a minimum, combined
    on the map side, so a cluster of any size is never in one place. The tokens are stored once, when this is called."""
    keys = ["error_label", "category"]
    rows = feedback.where("question <> ''").select(*keys, F.struct(order, "feedback_id").alias("at"), "question", F.array_distinct(tokens(F.col("question"))).alias("terms"))
    rows = stored(rows, "questions")
    every = feedback.select(*keys).distinct()
    taken = every.select(*keys, F.lit(None).cast(rows.schema["at"].dataType).alias("last"), F.array().cast("array<struct<question:string,terms:array<string>>>").alias("taken"))
    same = F.col("r.error_label").eqNullSafe(F.col("t.error_label")) & F.col("r.category").eqNullSafe(F.col("t.category"))
    for _ in range(most):
        unlike = ~F.exists("t.taken", lambda k: jaccard(k["terms"], F.col("r.terms")) > similar)
        found = rows.alias("r").join(taken.alias("t"), same).where((F.col("t.last").isNull() & (F.size("t.taken") == 0)) | (F.col("r.at") > F.col("t.last"))).where(unlike)
        found = found.groupBy(F.col("t.error_label").alias("error_label"), F.col("t.category").alias("category")).agg(F.min(F.struct(F.col("r.at").alias("at"), F.col("r.question").alias("question"), F.col("r.terms").alias("terms"))).alias("next"))
        step = F.col("t.error_label").eqNullSafe(F.col("n.error_label")) & F.col("t.category").eqNullSafe(F.col("n.category"))
        more = F.when(F.col("n.next").isNotNull(), F.concat("t.taken", F.array(F.struct(F.col("n.next.question").alias("question"), F.col("n.next.terms").alias("terms"))))).otherwise(F.col("t.taken"))
        taken = taken.alias("t").join(found.alias("n"), step, "left").select("t.error_label", "t.category", F.coalesce("n.next.at", "t.last").alias("last"), more.alias("taken"))
        taken = stored(taken, "samples")
    return taken.select(*keys, F.transform("taken", lambda x: x["question"]).alias("samples"))


def backlog(found: DataFrame, min_size: int = 1) -> DataFrame:
    """Numbered tickets, largest cluster first; a report, so its numbering is one sorted list of clusters."""
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "first"))
    return found.where(F.col("size") >= min_size).select(F.format_string("TICKET-%03d", n).alias("ticket"), "error_label", "category", "size", suggested_fix(F.col("error_label")).alias("fix"))


def review_queue(feedback: DataFrame, order: str = "seq") -> DataFrame:
    """(cluster, place, feedback_id): feedback in order of its cluster, largest first, and within it; the
    clusters, as many as label and category have values, are numbered in one list, their feedback is not gathered."""
    sizes = feedback.groupBy("error_label", "category").agg(F.count("*").alias("_size"), F.min(order).alias("_first"))
    numbered = sizes.withColumn("cluster", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_size"), "_first"))).alias("c")
    same = F.col("f.error_label").eqNullSafe(F.col("c.error_label")) & F.col("f.category").eqNullSafe(F.col("c.category"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(order, "feedback_id"))
    return feedback.alias("f").join(numbered, same).select("cluster", "feedback_id", order).select("cluster", place.alias("place"), "feedback_id")


def create(store: DataFrame, row: DataFrame) -> DataFrame:
    """The store with new rows; rows that break a rule, or an id that is there, raise."""
    broken = broken_rules(row).first()
    if broken:
        raise ValueError(f"{broken.rule} of {broken.feedback_id}")
    if store.join(row.select("feedback_id"), "feedback_id", "left_semi").limit(1).count():
        raise KeyError("feedback_id exists")
    return store.unionByName(row)


def get(store: DataFrame, feedback_id: str) -> dict:
    """One row of the store; an unknown id raises."""
    row = store.where(F.col("feedback_id") == feedback_id).first()
    if row is None:
        raise KeyError(feedback_id)
    return row.asDict()


def listed(store: DataFrame, status: str | None = None) -> DataFrame:
    return store if status is None else store.where(F.col("status") == status)


def broken_rules(row: DataFrame) -> DataFrame:
    """Rows of the feedback store that break its rules, with the first rule they break."""
    label = F.col("error_label")
    rule = (
        F.when(~F.col("feedback_type").isin(*TYPES), "feedback_type")
        .when(label.isNotNull() & ~label.isin(*FIXES), "error_label")
        .when(~F.col("source").isin(*SOURCES), "source")
        .when(~F.col("status").isin(*STATUSES), "status")
    )
    return row.withColumn("rule", rule).where("rule is not null")


def mark_reviewed(store: DataFrame, feedback_id: str, label: str | None, reviewer: str, note: str = "") -> DataFrame:
    """The store with one row reviewed; an unknown id raises."""
    if store.where(F.col("feedback_id") == feedback_id).limit(1).count() == 0:
        raise KeyError(feedback_id)
    this = F.col("feedback_id") == feedback_id
    return store.withColumns({
        "status": F.when(this, "reviewed").otherwise(F.col("status")), "error_label": F.when(this & F.lit(label is not None), F.lit(label)).otherwise(F.col("error_label")),
        "reviewed_by": F.when(this, reviewer).otherwise(F.col("reviewed_by")), "review_note": F.when(this, note).otherwise(F.col("review_note")),
    })
