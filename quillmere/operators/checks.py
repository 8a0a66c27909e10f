"""Data-quality checks of chunks, documents and golden sets; merges and approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import numbers, strip_space

# The rules' bounds and the values that golden items may have.
MIN_TOKENS, MAX_TOKENS = 15, 1200
NO_SECTION = ("fixed", "recursive")
REQUIRED = ("id", "question", "ground_truth", "relevant_chunks", "relevant_documents", "expected_citations", "category", "difficulty", "requires_refusal", "requires_clarification", "risk_tags", "review_status")
CATEGORIES = ("factoid", "procedural", "multi_hop", "adversarial", "ambiguous", "out_of_scope")
DIFFICULTIES = ("easy", "medium", "hard")
REVIEWS = ("pending_review", "approved", "rejected")


def _blank(c: str) -> Column:
    return F.coalesce(strip_space(F.col(c)) == "", F.lit(True))


def check_chunks(chunks: DataFrame, order: str = "seq") -> DataFrame:
    """chunks (chunk_id, document_id, section, strategy, text, token_count, seq) -> (rule, severity,
    chunk_id), a row for each finding. An empty text skips the other rules."""
    repeat = F.row_number().over(Window.partitionBy("chunk_id").orderBy(order)) > 1
    full = chunks.withColumn("_repeat", repeat)
    empty = _blank("text")
    found = F.array(
        F.when(empty, F.struct(F.lit("empty_text").alias("rule"), F.lit("critical").alias("severity"))),
        F.when(~empty & F.coalesce(F.col("document_id") == "", F.lit(True)), F.struct(F.lit("missing_document_id").alias("rule"), F.lit("critical").alias("severity"))),
        F.when(~empty & F.coalesce(F.col("section") == "", F.lit(True)) & ~F.col("strategy").isin(*NO_SECTION), F.struct(F.lit("missing_section").alias("rule"), F.lit("warning").alias("severity"))),
        F.when(~empty & F.col("_repeat"), F.struct(F.lit("duplicate_chunk_id").alias("rule"), F.lit("critical").alias("severity"))),
        F.when(~empty & (F.col("token_count") < MIN_TOKENS), F.struct(F.lit("chunk_too_short").alias("rule"), F.lit("warning").alias("severity"))),
        F.when(~empty & (F.col("token_count") > MAX_TOKENS), F.struct(F.lit("chunk_too_long").alias("rule"), F.lit("warning").alias("severity"))),
    )
    return full.select("chunk_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("f.rule", "f.severity", "chunk_id")


def duplicate_content(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(sha256, size, first): groups of equal texts, null texts left out. first is the smallest key."""
    return rows.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("sha256")).agg(F.count("*").alias("size"), F.min(key).alias("first")).where("size > 1")


def assert_clean(findings: DataFrame) -> None:
    """Raises if there is a critical finding."""
    n = findings.where("severity = 'critical'").count()
    if n:
        raise ValueError(f"{n} critical findings")


def check_golden(items: DataFrame, order: str = "seq") -> DataFrame:
    """(id, error): every broken rule of every golden item. Null required fields end an item's checks."""
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(c).isNull(), c) for c in REQUIRED)), lambda x: x.isNotNull()), ",")
    again = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(order)) > 1
    x = items.withColumns({"_missing": missing, "_id": again(F.col("id")), "_q": again(F.lower(strip_space(F.col("question"))))})
    rules = F.array(
        F.when(F.col("_id"), "duplicate id"),
        F.when(F.col("_q"), "duplicate question"),
        F.when(~F.col("category").isin(*CATEGORIES), "category"),
        F.when(~F.col("difficulty").isin(*DIFFICULTIES), "difficulty"),
        F.when(~F.col("review_status").isin(*REVIEWS), "review_status"),
        F.when(_blank("question"), "empty question"),
        F.when(_blank("ground_truth"), "empty ground_truth"),
        F.when(~F.col("requires_refusal") & (F.size("relevant_documents") == 0), "no document"),
        F.when(F.col("requires_refusal") & (F.size("expected_citations") > 0), "citations of a refusal"),
    )
    errors = F.when(F.col("_missing") != "", F.array(F.concat(F.lit("missing "), "_missing"))).otherwise(F.filter(rules, lambda r: r.isNotNull()))
    return x.select("id", F.explode(errors).alias("error"))


def unknown_documents(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, document_id) that golden items name and documents lack."""
    return items.select("id", F.explode("relevant_documents").alias("document_id")).join(documents.select("document_id"), "document_id", "left_anti").select("id", "document_id")


def article_in_source(article: Column, text: Column) -> Column:
    """Whether a text has the article as a heading, 'Điều N.' or 'Điều N:'."""
    name = F.concat(F.lit("Điều "), article.cast("string"))
    return F.contains(text, F.concat(name, F.lit("."))) | F.contains(text, F.concat(name, F.lit(":")))


def unsupported_numbers(ground_truth: Column, source: Column, refusal: Column) -> Column:
    """Numbers of two characters or more that the source lacks; none for refusals."""
    lacking = F.filter(numbers(ground_truth), lambda n: (F.length(n) >= 2) & ~F.contains(source, n))
    return F.when(refusal, F.array().cast("array<string>")).otherwise(lacking)


def approve(items: DataFrame, ids: list[str] | None, reviewer: str, at: str, note: str = "") -> DataFrame:
    """Items with the selected ones (None: all pending) approved; invalid items raise before any change."""
    if check_golden(items).limit(1).count():
        raise ValueError("the golden set has errors")
    pick = F.col("review_status") == "pending_review" if ids is None else F.col("id").isin(*ids)
    return items.withColumns({"review_status": F.when(pick, "approved").otherwise(F.col("review_status")), "reviewer": F.when(pick, reviewer), "reviewed_at": F.when(pick, at), "review_note": F.when(pick, note)})


def merge_seed(seed: DataFrame, old: DataFrame) -> DataFrame:
    """Seed items; review_status, reviewer and non-empty relevant_chunks of old items win."""
    o = old.select("id", F.col("review_status").alias("_s"), F.col("relevant_chunks").alias("_c"))
    out = seed.join(o, "id", "left")
    return out.withColumns({"review_status": F.coalesce("_s", "review_status"), "relevant_chunks": F.when(F.size("_c") > 0, F.col("_c")).otherwise(F.col("relevant_chunks"))}).drop("_s", "_c")


def template_variables(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"(?<!\{)\{(\w+)\}(?!\})"), F.lit(1)))


def check_template(template: Column, declared: Column) -> Column:
    """(missing, undeclared): declared names a template lacks, and names it uses undeclared."""
    used = template_variables(template)
    return F.struct(F.array_except(declared, used).alias("missing"), F.array_except(used, declared).alias("undeclared"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """old with rows of new put in by key: of several new rows of a key the last in order wins, without
    order (and among ties) the greatest by its columns' JSON; columns in keep stay as they were. Keys
    that are null meet each other."""
    by = [F.desc(order)] if order else []
    w = Window.partitionBy(*keys).orderBy(*by, F.to_json(F.struct(*new.columns)).desc())
    last = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    both = old.withColumn("_old", F.lit(True)).alias("o").join(last.withColumn("_new", F.lit(True)).alias("n"), same, "full_outer")
    there = F.coalesce("_new", F.lit(False))
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    own = [F.when(F.col("_old"), F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in keys]
    return both.select(*own, *(pick(c).alias(c) for c in old.columns if c not in keys))


# How many items of each group a full golden set has.
TARGETS = {"answerable": 200, "no_answer": 30, "adversarial": 20, "multi_hop": 30, "ambiguous": 20}


def golden_counts(items: DataFrame) -> DataFrame:
    """(kind, value, n): items by category, difficulty, review status and risk tag, in one pass; an item counts once for each of its tags."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    single = F.array(*(pair(k, F.col(k)) for k in ("category", "difficulty", "review_status")))
    tags = F.transform(F.coalesce("risk_tags", F.array().cast("array<string>")), lambda t: pair("risk_tag", t))
    return items.select(F.explode(F.concat(single, tags)).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def golden_targets(items: DataFrame) -> DataFrame:
    """(group, n, target, share): how much of each target group is there. An item may count in several groups; out of scope counts as
    adversarial, and a refusal has no answer if it is tagged as a data gap."""
    c, refusal = F.col("category"), F.coalesce("requires_refusal", F.lit(False))
    belongs = {
        "answerable": ((c == "factoid") & ~refusal) | (c == "procedural"), "no_answer": refusal & F.coalesce(F.array_contains("risk_tags", "data_gap"), F.lit(False)),
        "adversarial": c.isin("adversarial", "out_of_scope"), "multi_hop": c == "multi_hop", "ambiguous": c == "ambiguous",
    }
    n = items.agg(*(F.coalesce(F.sum(F.coalesce(x, F.lit(False)).cast("long")), F.lit(0)).alias(k) for k, x in belongs.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("group"), F.col(k).alias("n"), F.lit(t).alias("target")) for k, t in TARGETS.items()))
    return n.select(F.explode(rows).alias("x")).select("x.*", (F.col("x.n") / F.col("x.target")).alias("share"))
