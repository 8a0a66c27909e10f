"""Quality checks, the gate, feedback, prompts and observability over documents, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly, checks, feedback, gate, metrics, observability, policy, prompts
from ..sources import files
from ..sources.stored import stored
from ..sources.tables import table
from ..streaming import sessions
from .answers import _E, _LAT, _pct, eval_rows


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks: every fifth id repeats its neighbour's, some lack document, section or text."""
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.format_string("chunk_%d", F.when(i % 5 == 4, i - 1).otherwise(i)).alias("chunk_id"), F.when(i % 50 == 7, "").otherwise(F.col("source")).alias("document_id"), F.when(i % 9 == 0, F.lit(None).cast("string")).otherwise("Điều 1").alias("section"),
        F.when(i % 4 == 0, "fixed").otherwise("structure_aware").alias("strategy"), F.when(i % 97 == 0, " \n").otherwise(F.col("text")).alias("text"), T.count_tokens(F.col("text")).alias("token_count"), i.alias("seq"),
    )


def chunk_checks(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_chunks(_chunks(spark, sf))


def chunk_check_counts(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_chunks(_chunks(spark, sf)).groupBy("rule", "severity").agg(F.count("*").alias("n"))


def duplicate_documents(spark: SparkSession, sf: str) -> DataFrame:
    return checks.duplicate_content(table(spark, sf, "documents"), "doc_id")


def documents_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))


def _golden(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    cites = F.when(i % 8 == 5, F.array(F.struct(F.lit("d").alias("document_id"), F.lit("Điều 1").alias("section")))).otherwise(F.array().cast("array<struct<document_id:string,section:string>>"))
    return table(spark, sf, "benchmark").select(
        F.format_string("q%03d", F.when(i % 20 == 19, i - 1).otherwise(i)).alias("id"), F.when(i % 13 == 1, " ").otherwise(F.col("text")).alias("question"), F.when(i % 11 == 1, F.lit(None).cast("string")).otherwise(F.col("text")).alias("ground_truth"),
        F.array().cast("array<string>").alias("relevant_chunks"), F.when(i % 6 == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src"), (i % 25).cast("string")))).alias("relevant_documents"), cites.alias("expected_citations"),
        F.when(i % 7 == 3, "other").otherwise("factoid").alias("category"), F.lit("easy").alias("difficulty"), (i % 8 == 5).alias("requires_refusal"), F.lit(False).alias("requires_clarification"), F.array(F.lit("data_gap")).alias("risk_tags"), F.lit("pending_review").alias("review_status"), i.alias("seq"),
    )


def golden_checks(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_golden(_golden(spark, sf))


def golden_unknown_documents(spark: SparkSession, sf: str) -> DataFrame:
    return checks.unknown_documents(_golden(spark, sf), table(spark, sf, "documents").select(F.col("source").alias("document_id")).distinct())


def golden_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by category and difficulty with their totals, by grouping sets."""
    g = _golden(spark, sf).rollup("category", "difficulty").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("difficulty", F.lit("all")).alias("difficulty"), "n")


def number_support(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of each document that the document after it lacks."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    n = checks.unsupported_numbers(F.col("text"), F.col("other"), F.lit(False))
    return both.select("doc_id", F.size(n).cast("long").alias("n_unsupported"))


def template_check(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("item_id") % 2 == 0, "Q {question} {{x}} C {context}").otherwise("Q {question} {more}")
    c = checks.check_template(t, F.array(F.lit("question"), F.lit("context")))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(c["missing"], ",").alias("missing"), F.array_join(c["undeclared"], ",").alias("undeclared"))


def template_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = prompts.unified_diff(F.lit("a\nb"), F.concat(F.lit("a\n"), F.col("item_id").cast("string")))
    return table(spark, sf, "benchmark").select("item_id", d.alias("diff"))


def document_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Even documents put in again with another source: n_chars keeps its old value, source changes."""
    old = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    new = old.where("doc_id % 2 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 1_000_000).otherwise(0)).alias("doc_id"), F.lit("new").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    return checks.upsert(old, new, ["doc_id"], keep=("n_chars",))


def extraction_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """New extractions against old ones of which every third came from OCR; long old texts are kept."""
    d = table(spark, sf, "documents")
    new = d.select("doc_id", F.col("source").alias("file"), F.lit("html").alias("method"), F.length(files.guarded_text(F.col("text"), F.substring("text", 1, 300))).cast("long").alias("n_chars"))
    old = d.select("doc_id", F.col("source").alias("file"), F.when(F.col("doc_id") % 3 == 0, "ocr").otherwise("html").alias("method"), F.lit(7).cast("long").alias("n_chars"))
    return files.merge_manifest(new, old)


def document_registry(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    registry = d.select(F.col("doc_id").alias("document_id"), F.format_string("f%d", F.col("doc_id")).alias("file"), F.lit("t").alias("title"))
    manifest = d.where("doc_id % 2 = 0").select(F.format_string("f%d", F.col("doc_id")).alias("file"), F.lit("ocr").alias("method"))
    return files.load_registry(registry, manifest, d.select(F.col("doc_id").alias("document_id"), "text")).select("document_id", "char_count", "sha256", "source_type")


def gate_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Each event type's evaluation against that of all."""
    rows = eval_rows(spark, sf)
    current = gate.metric_rows(metrics.evaluation_summary(rows, "category"), "category")
    base = gate.metric_rows(metrics.evaluation_summary(rows).withColumn("key", F.lit("all")), "key")
    return gate.decide(gate.violations(current, base, gate.bounds(spark), "category"), "category")


def gate_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation of all events, brought within the gate's bounds, and changed in one metric at a time: a small harm, a breach, a missing value."""
    bounds = gate.bounds(spark)
    all_ = gate.metric_rows(metrics.evaluation_summary(eval_rows(spark, sf)).withColumn("key", F.lit("all")), "key")
    low, high = F.col("least"), F.col("most")
    within = F.when(low.isNotNull(), F.least(F.lit(1.0), F.greatest(F.col("value"), low + 0.05))).otherwise(F.least(F.col("value"), high * 0.5))
    good = stored(all_.join(bounds, "metric").select("metric", within.alias("value"), low, high), "gate-base")
    kinds = spark.createDataFrame([("none",), ("small",), ("breach",), ("missing",)], "kind string")
    sign = F.when(high.isNotNull(), 1).otherwise(-1)
    harmed = F.when(F.col("kind") == "small", F.col("value") + sign * 0.01).when(F.col("kind") == "breach", F.coalesce(high, low) + sign * 0.01).when(F.col("kind") == "none", F.col("value"))
    pairs = bounds.select(F.col("metric").alias("of")).crossJoin(kinds).crossJoin(good)  # the gate's few metrics
    current = pairs.select(F.concat_ws("/", "of", "kind").alias("scenario"), "metric", F.when(F.col("metric") == F.col("of"), harmed).otherwise(F.col("value")).alias("value"))
    return gate.decide(gate.violations(current, good.select("metric", "value"), bounds, "scenario"), "scenario")


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as feedback: types, traces and categories follow from the ids."""
    i, n = F.col("conv_id") + F.col("turn"), len(feedback.TYPES)
    none = F.array().cast("array<string>")
    kind = F.get(F.array(*map(F.lit, feedback.TYPES)), (i % n).cast("int"))
    errors = F.when(i % 11 == 0, F.array(F.lit("low_score"))).otherwise(none)
    label = feedback.error_label(kind, errors, F.when(i % 13 == 0, F.array(F.lit("x"))).otherwise(none), i % 17 == 0, F.when(i % 5 == 0, "local").otherwise("primary"))
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.select(F.format_string("f_%d_%d", "conv_id", "turn").alias("feedback_id"), kind.alias("feedback_type"), label.alias("error_label"), F.when(i % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("c"), (i % 2).cast("string"))).alias("category"), F.col("text").alias("question"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))


def feedback_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _feedback(spark, sf).select("feedback_id", "feedback_type", "error_label", "category")


def feedback_clusters(spark: SparkSession, sf: str) -> DataFrame:
    c = feedback.clusters(_feedback(spark, sf).where("error_label is not null"))
    return c.select("error_label", "category", "size", "first", F.md5(F.array_join("feedback_ids", ",")).alias("ids_md5"))


def feedback_backlog(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.backlog(feedback.clusters(_feedback(spark, sf).where("error_label is not null")), 2)


def feedback_queue(spark: SparkSession, sf: str) -> DataFrame:
    q = feedback.review_queue(_feedback(spark, sf).where("error_label is not null"))
    return q.select(F.col("cluster").cast("long").alias("cluster"), F.col("place").cast("long").alias("place"), "feedback_id")


def feedback_samples(spark: SparkSession, sf: str) -> DataFrame:
    s = feedback.with_samples(_feedback(spark, sf).where("error_label is not null"))
    return s.select("error_label", "category", F.size("samples").alias("n_samples"), F.md5(F.array_join("samples", "\n")).alias("md5"))


def _traces(spark: SparkSession, sf: str) -> DataFrame:
    """Events as traces: value / 100 is the latency in seconds."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    none = F.array().cast("array<string>")
    return e.select(
        F.col("event_id").alias("trace_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), F.concat(F.lit("p"), (i % 3).cast("string")).alias("prompt_version"), (i % 10 == 0).alias("refusal"), (i % 100).alias("input_tokens"), (i % 50).alias("output_tokens"),
        (F.col("value") / 100).alias("cost_usd"), F.when(F.col("event_type") == "error", F.array(F.lit("parse"), F.lit("budget"))).otherwise(none).alias("error_labels"), F.when(i % 4 == 0, "local").otherwise("primary").alias("fallback_hop"),
        F.when(i % 5 == 0, "hit").when(i % 5 == 1, "miss").alias("cache_result"), F.lit("litellm").alias("model_provider"), F.concat(F.lit("m"), (i % 2).cast("string")).alias("model_name"), (F.col("value") / 10).alias("latency_s"),
        F.when(F.col("event_type") == "error", 2).otherwise(0).cast("long").alias("n_errors"), (i % 4 == 0).alias("fallback"), F.lit("balanced").alias("tier"), F.col("ts").cast("timestamp").alias("created_at"),
    )


def request_counters(spark: SparkSession, sf: str) -> DataFrame:
    c = observability.counters(observability.metric_rows(_traces(spark, sf)))
    return c.select("metric", "label", F.round("value", 4).alias("value"))


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    b = _traces(spark, sf).groupBy("prompt_version").agg(observability.buckets(F.col("latency_s"), observability.LATENCY_BUCKETS).alias("b"))
    q = lambda p: F.round(observability.quantile(F.col("b"), observability.LATENCY_BUCKETS, p), 9)
    return b.select("prompt_version", F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("buckets"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


def metric_rates(spark: SparkSession, sf: str) -> DataFrame:
    r = observability.rates(observability.metric_rows(_traces(spark, sf)).where("metric in ('requests', 'errors')"), "1 hour", "30 minutes", 3600.0)
    return r.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "metric", "label", "increase", F.round("rate", 9).alias("rate"))


def window_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = observability.window_stats(_traces(spark, sf), "1 hour", None)
    return s.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "requests", *(F.round(c, 6).alias(c) for c in ("p95", "error_ratio", "fallback_ratio", "cost")))


def alert_windows(spark: SparkSession, sf: str) -> DataFrame:
    a = observability.alerts(observability.window_stats(_traces(spark, sf), "1 hour", None), pending=180)
    return a.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "high_p95", "high_errors", "high_fallback", "cost_spike")


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(_traces(spark, sf), "session_id", "6 hours")
    return s.select("session_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


def recent_traces(spark: SparkSession, sf: str) -> DataFrame:
    return observability.recent(_traces(spark, sf)).select("trace_id")


def data_age(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("event_id") % 3 == 0, "other").otherwise(files.version_id(F.col("ts").cast("timestamp")))
    return table(spark, sf, "events").select("event_id", observability.data_age_days(v, F.to_date(F.lit("2030-01-01"))).alias("days"), files.index_id(v, F.lit("e5-base_v1.0")).alias("index_id"))


def budget_downgrades(spark: SparkSession, sf: str) -> DataFrame:
    b = policy.budget(_traces(spark, sf).where("cost_usd is not null"), daily=40.0, by="session_id")
    return b.select("trace_id", "tier", "downgraded", "budget_warning", F.round("spent_before", 4).alias("spent_before"))


def trace_labels(spark: SparkSession, sf: str) -> DataFrame:
    hop = policy.hop(F.concat(F.lit("group-"), F.when(F.col("trace_id") % 7 == 0, "other").otherwise(F.col("fallback_hop"))))
    none = F.array().cast("array<string>")
    labels = policy.error_labels(F.when(F.col("trace_id") % 9 == 0, "parse"), F.when(F.col("trace_id") % 8 == 0, F.array(F.lit("x"))).otherwise(none), hop, F.col("trace_id") % 6 == 0, F.col("trace_id") % 12 == 0)
    return _traces(spark, sf).select("trace_id", hop.alias("hop"), F.array_join(labels, ",").alias("labels"))


def judge_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", assembly.judge_key(F.col("item_id").cast("string"), F.col("text"), F.lit("c")).alias("key"))


_G = r"""(SELECT item_id, 'q' || lpad((CASE WHEN item_id % 20 = 19 THEN item_id - 1 ELSE item_id END)::VARCHAR, 3, '0') AS id, CASE WHEN item_id % 13 = 1 THEN ' ' ELSE text END AS question, item_id % 11 = 1 AS no_truth, item_id % 6 = 1 AS no_docs, item_id % 8 = 5 AS refusal, item_id % 7 = 3 AS bad_category FROM benchmark)"""
_C = r"""c AS (SELECT doc_id, 'chunk_' || (CASE WHEN doc_id % 5 = 4 THEN doc_id - 1 ELSE doc_id END) AS chunk_id, doc_id % 97 = 0 OR trim(text, E' \n\t\r') = '' AS empty, doc_id % 50 = 7 OR source IS NULL AS no_doc, doc_id % 9 = 0 AND doc_id % 4 <> 0 AS no_section, len(regexp_extract_all(text, '[^\s]+')) AS n,
  row_number() OVER (PARTITION BY CASE WHEN doc_id % 5 = 4 THEN doc_id - 1 ELSE doc_id END ORDER BY doc_id) > 1 AS again FROM documents),
f AS (SELECT 'empty_text' AS rule, 'critical' AS severity, chunk_id FROM c WHERE empty UNION ALL SELECT 'missing_document_id', 'critical', chunk_id FROM c WHERE NOT empty AND no_doc UNION ALL SELECT 'missing_section', 'warning', chunk_id FROM c WHERE NOT empty AND no_section
  UNION ALL SELECT 'duplicate_chunk_id', 'critical', chunk_id FROM c WHERE NOT empty AND again UNION ALL SELECT 'chunk_too_short', 'warning', chunk_id FROM c WHERE NOT empty AND n < 15 UNION ALL SELECT 'chunk_too_long', 'warning', chunk_id FROM c WHERE NOT empty AND n > 1200)"""
_FB = """fb AS (SELECT *, CASE WHEN kind = 'thumbs_up' THEN NULL WHEN kind = 'missing_citation' THEN 'citation_error' WHEN kind = 'outdated_information' THEN 'stale_data' WHEN kind = 'slow_response' THEN 'cost_latency_issue' WHEN kind = 'unsafe_answer' THEN 'refusal_error'
  WHEN i % 13 = 0 THEN 'citation_error' WHEN i % 17 = 0 THEN 'refusal_error' WHEN i % 5 = 0 THEN 'provider_error' WHEN i % 11 = 0 THEN 'retrieval_failure' ELSE 'hallucination' END AS error_label FROM (
  SELECT conv_id + turn AS i, 'f_' || conv_id || '_' || turn AS feedback_id, conv_id * 1000 + turn AS seq, (['thumbs_up', 'thumbs_down', 'wrong_answer', 'missing_citation', 'outdated_information', 'slow_response', 'unsafe_answer'])[((conv_id + turn) % 7) + 1] AS kind,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN NULL ELSE 'c' || ((conv_id + turn) % 2) END AS category, text AS question FROM conversations WHERE role = 'user')),
cl AS (SELECT error_label, category, count(*) AS size, min(seq) AS first, md5(string_agg(feedback_id, ',' ORDER BY seq, feedback_id)) AS ids_md5 FROM fb WHERE error_label IS NOT NULL GROUP BY ALL)"""
_LIKE = "(len({0}.t) > 0 AND len({1}.t) > 0 AND len(list_intersect({0}.t, {1}.t)) / nullif(len({0}.t) + len({1}.t) - len(list_intersect({0}.t, {1}.t)), 0) > 0.8::DOUBLE)"
_FIX = "CASE error_label WHEN 'retrieval_failure' THEN 'retrieval' WHEN 'hallucination' THEN 'prompt' WHEN 'citation_error' THEN 'prompt' WHEN 'refusal_error' THEN 'prompt' WHEN 'stale_data' THEN 'data' WHEN 'provider_error' THEN 'routing' WHEN 'cost_latency_issue' THEN 'routing' ELSE 'review' END"
_BK = (0.5, 1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 30, 60)
_CUM = "[" + ", ".join(f"count(*) FILTER (WHERE value / 10 <= {b})" for b in _BK) + ", count(value)]"


def _quantile(q: float) -> str:
    les = f"{list(map(float, _BK))}"
    return f"(SELECT CASE WHEN b[14] = 0 THEN NULL WHEN pos >= 13 THEN 60.0 ELSE round(coalesce(les[pos], 0) + (les[pos + 1] - coalesce(les[pos], 0)) * (b[14] * {q}::DOUBLE - coalesce(b[pos], 0)) / (b[pos + 1] - coalesce(b[pos], 0)), 9) END FROM (SELECT {les}::DOUBLE[] AS les, len(list_filter(b[1:13], lambda c: c < b[14] * {q}::DOUBLE)) AS pos))"


_W = f"""w AS (SELECT date_trunc('hour', ts) AS start, count(*) AS requests, {_CUM} AS b, sum(CASE WHEN event_type = 'error' THEN 2 ELSE 0 END) AS errors, sum((event_id % 4 = 0)::INT) AS fallbacks, sum(value / 100) AS cost FROM events GROUP BY 1),
s AS (SELECT start, requests, {_quantile(0.95)} AS p95, (errors / 3600) / greatest(requests / 3600, 1) AS error_ratio, (fallbacks / 3600) / greatest(requests / 3600, 1) AS fallback_ratio, cost FROM w)"""
_M = """m AS (SELECT ts, 'requests' AS metric, 'p' || (event_id % 3) || '|' || (event_id % 10 = 0)::VARCHAR AS label, 1.0 AS value FROM events UNION ALL SELECT ts, 'tokens', 'input', event_id % 100 FROM events UNION ALL SELECT ts, 'tokens', 'output', event_id % 50 FROM events UNION ALL SELECT ts, 'cost_usd', '', value / 100 FROM events
UNION ALL SELECT ts, 'fallback', 'local', 1 FROM events WHERE event_id % 4 = 0 UNION ALL SELECT ts, 'cache', CASE WHEN event_id % 5 = 0 THEN 'hit' ELSE 'miss' END, 1 FROM events WHERE event_id % 5 < 2 UNION ALL SELECT ts, 'usage', 'litellm|m' || (event_id % 2), 1 FROM events
UNION ALL SELECT ts, 'errors', x, 1 FROM events, (SELECT unnest(['parse', 'budget']) AS x) WHERE event_type = 'error')"""
_GATE = f"""s AS (SELECT category, avg(recall) AS recall_at_5, avg(faithfulness) FILTER (WHERE judged) AS faithfulness, avg(answer_relevance) FILTER (WHERE judged) AS answer_relevance, avg(hallucination) FILTER (WHERE judged) AS hallucination_rate, avg((requires_refusal = refusal)::INT) AS refusal_accuracy,
  {_pct('a', 0.95, _LAT)} / 1000 AS p95_latency_seconds, avg((n_errors > 0)::INT) AS error_rate, avg(citation_accuracy) AS citation_accuracy, avg(cost_usd) AS cost_per_request_usd FROM (SELECT * REPLACE (coalesce(category, '') AS category) FROM e UNION ALL SELECT * REPLACE ('(all)' AS category) FROM e) GROUP BY category),
l AS (UNPIVOT s ON COLUMNS(* EXCLUDE category) INTO NAME metric VALUE value),
b (metric, severity, least, most) AS (VALUES ('recall_at_5', 'critical', 0.85::DOUBLE, NULL::DOUBLE), ('faithfulness', 'critical', 0.85, NULL), ('answer_relevance', 'critical', 0.8, NULL), ('hallucination_rate', 'critical', NULL, 0.05), ('refusal_accuracy', 'critical', 0.9, NULL), ('p95_latency_seconds', 'critical', NULL, 6), ('error_rate', 'critical', NULL, 0.02), ('citation_accuracy', 'warning', 0.85, NULL), ('cost_per_request_usd', 'warning', NULL, 0.005)),
v AS (SELECT l.category, metric, severity, CASE WHEN l.value IS NULL THEN 'missing' WHEN l.value < least OR l.value > most THEN 'threshold' WHEN severity = 'critical' AND CASE WHEN least IS NOT NULL THEN z.value - l.value ELSE l.value - z.value END > 0.03::DOUBLE THEN 'regression' END AS reason FROM l JOIN b USING (metric) LEFT JOIN (SELECT metric, value FROM l WHERE category = '(all)') z USING (metric) WHERE l.category <> '(all)')"""
_TOLD = "coalesce(string_agg(metric || ':' || reason, ',' ORDER BY metric || ':' || reason) FILTER (WHERE severity = '{}' AND reason IS NOT NULL), '')"
QUERIES = {f.__name__: f for f in (
    chunk_checks, chunk_check_counts, duplicate_documents, documents_by_source, golden_checks, golden_unknown_documents, golden_stats, number_support, template_check, template_diff, document_upsert, extraction_manifest, document_registry,
    gate_decisions, gate_scenarios, feedback_labels, feedback_clusters, feedback_backlog, feedback_queue, feedback_samples, request_counters, latency_histogram, metric_rates, window_stats, alert_windows, user_sessions, recent_traces, data_age, budget_downgrades, trace_labels, judge_keys,
)}
SQL = {
    "chunk_checks": f"WITH {_C} SELECT * FROM f",
    "chunk_check_counts": f"WITH {_C} SELECT rule, severity, count(*) AS n FROM f GROUP BY ALL",
    "duplicate_documents": "SELECT sha256(text) AS sha256, count(*) AS size, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "documents_by_source": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "golden_checks": f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY item_id) > 1 AS dup, row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY item_id) > 1 AS dupq FROM {_G})
SELECT id, 'missing ground_truth' AS error FROM g WHERE no_truth UNION ALL SELECT id, 'duplicate id' FROM g WHERE NOT no_truth AND dup UNION ALL SELECT id, 'duplicate question' FROM g WHERE NOT no_truth AND dupq UNION ALL SELECT id, 'category' FROM g WHERE NOT no_truth AND bad_category
UNION ALL SELECT id, 'empty question' FROM g WHERE NOT no_truth AND trim(question) = '' UNION ALL SELECT id, 'no document' FROM g WHERE NOT no_truth AND no_docs AND NOT refusal UNION ALL SELECT id, 'citations of a refusal' FROM g WHERE NOT no_truth AND refusal""",
    "golden_unknown_documents": f"SELECT id, 'src' || (item_id % 25) AS document_id FROM {_G} WHERE NOT no_docs AND 'src' || (item_id % 25) NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)",
    "golden_stats": f"SELECT coalesce(c, 'all') AS category, coalesce(d, 'all') AS difficulty, count(*) AS n FROM (SELECT CASE WHEN bad_category THEN 'other' ELSE 'factoid' END AS c, 'easy' AS d FROM {_G}) GROUP BY ROLLUP (c, d)",
    "number_support": "SELECT a.doc_id, len(list_filter(list_distinct(list_transform(regexp_extract_all(a.text, '[0-9][0-9.,]*[0-9]|[0-9]'), lambda n: trim(n, '.,'))), lambda n: length(n) >= 2 AND NOT contains(b.text, n))) AS n_unsupported FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1",
    "template_check": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '' ELSE 'context' END AS missing, CASE WHEN item_id % 2 = 0 THEN '' ELSE 'more' END AS undeclared FROM benchmark",
    "template_diff": "SELECT item_id, '--- old' || chr(10) || '+++ new' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' a' || chr(10) || '-b' || chr(10) || '+' || item_id AS diff FROM benchmark",
    "document_upsert": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <> 0 THEN 'new' ELSE source END AS source, n_chars FROM documents UNION ALL SELECT doc_id + 1000000, 'new', 0 FROM documents WHERE doc_id % 10 = 0",
    "extraction_manifest": "SELECT doc_id, source AS file, CASE WHEN doc_id % 3 = 0 THEN 'ocr' ELSE 'html' END AS method, CASE WHEN doc_id % 3 = 0 THEN 7 WHEN length(text) > 2 * least(300, length(text)) AND length(text) > 500 THEN length(text) ELSE least(300, length(text)) END::BIGINT AS n_chars FROM documents",
    "document_registry": "SELECT doc_id AS document_id, length(text)::INT AS char_count, sha256(text) AS sha256, CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'html' END AS source_type FROM documents",
    "gate_scenarios": f"""WITH {_E}, {_GATE},
y AS (SELECT metric, b.severity, b.least AS lo, b.most AS hi, CASE WHEN b.least IS NOT NULL THEN least(1.0::DOUBLE, greatest(l.value, b.least + 0.05::DOUBLE)) ELSE least(l.value, b.most * 0.5::DOUBLE) END AS good FROM l JOIN b USING (metric) WHERE l.category = '(all)'),
u AS (SELECT o.metric || '/' || kind AS scenario, y.metric, y.severity, lo, hi, good, CASE WHEN y.metric <> o.metric OR kind = 'none' THEN good WHEN kind = 'small' THEN good + CASE WHEN hi IS NULL THEN -0.01::DOUBLE ELSE 0.01::DOUBLE END WHEN kind = 'breach' THEN coalesce(hi, lo) + CASE WHEN hi IS NULL THEN -0.01::DOUBLE ELSE 0.01::DOUBLE END END AS value
  FROM (SELECT metric FROM b) o, (SELECT unnest(['none', 'small', 'breach', 'missing']) AS kind), y),
f AS (SELECT *, CASE WHEN value IS NULL THEN 'missing' WHEN value < lo OR value > hi THEN 'threshold' WHEN severity = 'critical' AND CASE WHEN lo IS NOT NULL THEN good - value ELSE value - good END > 0.03::DOUBLE THEN 'regression' END AS reason FROM u),
r AS (SELECT scenario, {_TOLD.format('critical')} AS critical, {_TOLD.format('warning')} AS warning FROM f GROUP BY scenario)
SELECT scenario, critical, warning, CASE WHEN critical <> '' THEN 'BLOCK' WHEN warning <> '' THEN 'WARN' ELSE 'PASS' END AS status FROM r""",
    "gate_decisions": f"WITH {_E}, {_GATE}, d AS (SELECT category, {_TOLD.format('critical')} AS critical, {_TOLD.format('warning')} AS warning FROM v GROUP BY category) SELECT category, critical, warning, CASE WHEN critical <> '' THEN 'BLOCK' WHEN warning <> '' THEN 'WARN' ELSE 'PASS' END AS status FROM d",
    "feedback_labels": f"WITH {_FB} SELECT feedback_id, kind AS feedback_type, error_label, category FROM fb",
    "feedback_samples": f"""WITH {_FB}, y AS MATERIALIZED (SELECT error_label, category, seq, feedback_id, question, list_distinct(regexp_extract_all(lower(nfc_normalize(question)), '[\\p{{L}}\\p{{N}}_]+')) AS t, row_number() OVER (PARTITION BY error_label, category ORDER BY seq, feedback_id) AS n FROM fb WHERE error_label IS NOT NULL AND question <> ''),
a AS (SELECT * FROM y WHERE n = 1),
b AS (SELECT * FROM (SELECT y.*, row_number() OVER (PARTITION BY y.error_label, y.category ORDER BY y.n) AS m FROM y JOIN a ON y.error_label = a.error_label AND y.category IS NOT DISTINCT FROM a.category WHERE y.n > a.n AND NOT {_LIKE.format('a', 'y')}) WHERE m = 1),
c AS (SELECT * FROM (SELECT y.*, row_number() OVER (PARTITION BY y.error_label, y.category ORDER BY y.n) AS m FROM y JOIN a ON y.error_label = a.error_label AND y.category IS NOT DISTINCT FROM a.category JOIN b ON y.error_label = b.error_label AND y.category IS NOT DISTINCT FROM b.category WHERE y.n > b.n AND NOT {_LIKE.format('a', 'y')} AND NOT {_LIKE.format('b', 'y')}) WHERE m = 1),
s AS (SELECT error_label, category, count(*)::INT AS n_samples, md5(string_agg(question, chr(10) ORDER BY n)) AS md5 FROM (SELECT error_label, category, question, n FROM a UNION ALL SELECT error_label, category, question, n FROM b UNION ALL SELECT error_label, category, question, n FROM c) GROUP BY 1, 2)
SELECT error_label, category, n_samples, md5 FROM s UNION ALL SELECT DISTINCT error_label, category, 0, md5('') FROM fb WHERE error_label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.error_label = fb.error_label AND s.category IS NOT DISTINCT FROM fb.category)""",
    "feedback_clusters": f"WITH {_FB} SELECT * FROM cl",
    "feedback_queue": f"WITH {_FB}, n AS (SELECT *, row_number() OVER (ORDER BY size DESC, first) AS cluster FROM cl) SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY seq, feedback_id) AS place, feedback_id FROM fb JOIN n ON fb.error_label IS NOT DISTINCT FROM n.error_label AND fb.category IS NOT DISTINCT FROM n.category WHERE fb.error_label IS NOT NULL",
    "feedback_backlog": f"WITH {_FB} SELECT 'TICKET-' || lpad(row_number() OVER (ORDER BY size DESC, first)::VARCHAR, 3, '0') AS ticket, error_label, category, size, {_FIX} AS fix FROM cl WHERE size >= 2",
    "request_counters": f"WITH {_M} SELECT metric, label, round(sum(value)::DOUBLE, 4) AS value FROM m GROUP BY ALL",
    "latency_histogram": f"WITH h AS (SELECT 'p' || (event_id % 3) AS prompt_version, {_CUM} AS b FROM events GROUP BY 1) SELECT prompt_version, array_to_string(b, ',') AS buckets, {_quantile(0.5)} AS p50, {_quantile(0.95)} AS p95, {_quantile(0.99)} AS p99 FROM h",
    "metric_rates": f"WITH {_M}, x AS (SELECT metric, label, value, time_bucket(INTERVAL 30 MINUTES, ts) AS t FROM m WHERE metric IN ('requests', 'errors')), y AS (SELECT metric, label, value, t FROM x UNION ALL SELECT metric, label, value, t - INTERVAL 30 MINUTES FROM x) SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS start, metric, label, sum(value)::DOUBLE AS increase, round(sum(value)::DOUBLE / 3600, 9) AS rate FROM y GROUP BY ALL",
    "window_stats": f"WITH {_W} SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, requests, round(p95, 6) AS p95, round(error_ratio, 6) AS error_ratio, round(fallback_ratio, 6) AS fallback_ratio, round(cost, 6) AS cost FROM s",
    "alert_windows": f"WITH {_W} SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, bool_and(coalesce(p95 > 6, FALSE)) OVER h AS high_p95, bool_and(error_ratio > 0.05::DOUBLE) OVER h AS high_errors, bool_and(fallback_ratio > 0.2::DOUBLE) OVER h AS high_fallback, cost > 1 AS cost_spike FROM s WINDOW h AS (ORDER BY start RANGE BETWEEN INTERVAL 180 MINUTES PRECEDING AND CURRENT ROW)",
    "user_sessions": "WITH a AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER p > INTERVAL 6 HOURS, TRUE)::INT AS n FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT user_id AS session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM b GROUP BY user_id, g",
    "recent_traces": "SELECT event_id AS trace_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "data_age": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN date_diff('day', ts::DATE, DATE '2030-01-01')::INT END AS days, 'idx_' || CASE WHEN event_id % 3 = 0 THEN 'other' ELSE strftime(ts, '%Y%m%d') END || '_e5basev10' AS index_id FROM events",
    "budget_downgrades": "WITH c AS (SELECT event_id AS trace_id, value / 100 AS cost, coalesce(sum(value / 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events WHERE value IS NOT NULL) SELECT trace_id, CASE WHEN spent >= 40 THEN 'cheap' ELSE 'balanced' END AS tier, spent >= 40 AS downgraded, spent + cost > 40 AS budget_warning, round(spent, 4) AS spent_before FROM c",
    "trace_labels": "SELECT trace_id, hop, concat_ws(',', CASE WHEN trace_id % 9 = 0 THEN 'parse' END, CASE WHEN trace_id % 8 = 0 THEN 'invalid_citations_dropped' END, CASE WHEN hop = 'local' THEN 'served_by_fallback:local' END, CASE WHEN trace_id % 6 = 0 THEN 'budget_warning' END, CASE WHEN trace_id % 12 = 0 THEN 'budget_downgrade' END) AS labels FROM (SELECT event_id AS trace_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 4 = 0 THEN 'local' ELSE 'primary' END AS hop FROM events)",
    "judge_keys": "SELECT item_id, substr(sha256(item_id || '|' || text || '|' || 'c'), 1, 24) AS key FROM benchmark",
}
