"""Citations, metrics and query-time policies over tables made from documents, benchmark and events.

Conventions: a chunk is a document (its source is the document it belongs to), a question is a
benchmark item, its retrieved list the BM25 top ten. Its relevant groups are found in the texts of two
sources, by section or token overlap, whatever retrieval finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import citations, metrics, policy, search
from ..sources.stored import stored
from ..sources.tables import table
from .retrieval import _T, _ranked, _sparse


def _retrieved(spark: SparkSession, sf: str) -> DataFrame:
    """Ten rows a question, stored for the plans that read them several times."""
    r = search.retrieve("sparse", "item_id", "doc_id", sparse=_sparse(spark, sf), limit=10)
    return stored(r.select(F.col("item_id").alias("question_id"), F.col("doc_id").alias("chunk_id"), "rank", "score"), "retrieved")


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    """Two groups a question: what its citation matches, and the best chunk of another source; groups without a chunk have no row."""
    c = _citations(spark, sf)
    other = c.select("question_id", (F.col("group_no") + 1).alias("group_no"), F.concat(F.lit("src"), ((F.col("question_id") + 7) % 20).cast("string")).alias("document_id"), F.lit("Phụ lục").alias("section"), "ground_truth", "requires_refusal")
    m = citations.match_citations(c.unionByName(other), _chunks(spark, sf), least=0.2)
    return stored(m.where("chunk_id is not null").select("question_id", "group_no", F.col("chunk_id").cast("long").alias("chunk_id")), "groups")


def retrieval_quality(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.retrieval_metrics(_retrieved(spark, sf), _groups(spark, sf))
    return m.select("question_id", *(F.round(c, 9).alias(c) for c in ("recall", "hit", "mrr", "ndcg")))


def retrieval_means(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.mean_metrics(metrics.retrieval_metrics(_retrieved(spark, sf), _groups(spark, sf)))
    return m.select("n", *(F.round(c, 9).alias(c) for c in ("recall", "hit", "mrr", "ndcg")))


def context_precision(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.share_relevant(_retrieved(spark, sf).where("rank <= 5"), _groups(spark, sf), "context_precision")
    return m.select("question_id", F.round("context_precision", 9).alias("context_precision"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    section = F.concat(F.lit("Điều "), (F.col("doc_id") % 7 + 1).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(", Khoản "), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), (F.col("doc_id") % 3 + 2).cast("string"))).otherwise(""))
    return table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("seq"), section.alias("section"), "text")


def _citations(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    section = F.when(i % 5 == 4, "Phụ lục").otherwise(F.concat(F.lit("Điều "), (i % 9 + 1).cast("string"), F.when(i % 2 == 0, F.concat(F.lit(", Khoản "), (i % 4 + 1).cast("string"))).otherwise("")))
    return table(spark, sf, "benchmark").select(i.alias("question_id"), F.lit(0).cast("long").alias("group_no"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("document_id"), section.alias("section"), F.col("text").alias("ground_truth"), (i % 10 == 9).alias("requires_refusal"))


def citation_match(spark: SparkSession, sf: str) -> DataFrame:
    return citations.match_citations(_citations(spark, sf), _chunks(spark, sf), least=0.2)


def citation_links(spark: SparkSession, sf: str) -> DataFrame:
    m = citations.link_relevant(citations.match_citations(_citations(spark, sf), _chunks(spark, sf), least=0.2))
    return m.select("question_id", F.size("relevant_chunks").cast("long").alias("n_chunks"), "n_structural", "n_lexical", "n_none")


def answer_parsing(spark: SparkSession, sf: str) -> DataFrame:
    """Model outputs of four forms by question: fenced JSON, a short suffix, a made-up id, no JSON."""
    q = F.col("item_id")
    first = F.format_string("chunk_%03d", q)
    raw = (
        F.when(q % 4 == 0, F.concat(F.lit('```json\n{"answer": "yes", "refusal": false, "citations": ["'), first, F.lit('", "'), first, F.lit('"]}\n```')))
        .when(q % 4 == 1, F.concat(F.lit('Here: {"answer": "yes", "citations": ["'), F.substring(first, -3, 3), F.lit('"]} end')))
        .when(q % 4 == 2, F.lit('{"answer": "yes", "citations": ["made_up"]}'))
        .otherwise("no json here")
    )
    a = table(spark, sf, "benchmark").select(q.alias("id"), raw.alias("raw"), F.array(first, F.lit("other")).alias("retrieved"))
    p = citations.parse_answers(a)
    return p.select("id", "refusal", F.array_join("citations", ",").alias("citations"), F.array_join("invalid", ",").alias("invalid"), "error")


def query_policy(spark: SparkSession, sf: str) -> DataFrame:
    level = policy.complexity(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", level.alias("complexity"), policy.tier(F.lit("auto"), level).alias("tier"), policy.ambiguity_handled(F.concat("text", F.lit(" nếu A, hoặc B"))).alias("ambiguity_handled"))


def retrieval_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Dynamic k, refusal check and confidence of each question's scores over 100."""
    r = _retrieved(spark, sf).groupBy(F.col("question_id").alias("item_id")).agg(F.transform(F.sort_array(F.collect_list(F.round(F.col("score") / 100, 6)), asc=False), lambda x: x).alias("s"))
    best = F.get("s", 0)
    reason = policy.refusal_reason(F.size("s"), best)
    conf = policy.confidence(reason.isNotNull(), best, F.lit(1), F.lit(2), F.lit(False))
    return r.select("item_id", policy.dynamic_k(F.col("s"), 5).cast("long").alias("k"), reason.alias("reason"), conf.alias("confidence"))


def compressed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = policy.compress(F.col("text"), F.lit("the of and en la"))
    return table(spark, sf, "documents").select("doc_id", F.length(c).cast("long").alias("n_chars"), (F.length(c) <= policy.MAX_CHARS).alias("fits"))


def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    r = _retrieved(spark, sf).where("rank <= 3").join(table(spark, sf, "documents"), F.col("chunk_id") == F.col("doc_id"))
    rows = r.select("question_id", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), F.lit(None).cast("string").alias("title"), F.col("lang").alias("section"), "text")
    c = policy.context(rows, "question_id")
    prompt = policy.render("Q {question} {{json}}\n{context}", question=F.col("question_id"), context=F.col("context"))
    return c.select("question_id", F.md5(prompt).alias("prompt_md5"))


def mock_generation(spark: SparkSession, sf: str) -> DataFrame:
    prompt = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("x [chunk_"), F.col("item_id").cast("string"), F.lit("] y"))).otherwise(F.lit("none"))
    return table(spark, sf, "benchmark").select("item_id", policy.mock_answer(prompt).alias("answer"))


def eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation rows made of events: the type is the category, value the latency in seconds."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    part = lambda m, d: F.when(i % m == 0, F.lit(None).cast("double")).otherwise((i % d) / (d - 1))
    return e.select(
        i.alias("question_id"), F.col("event_type").alias("category"), part(7, 3).alias("recall"), part(7, 2).alias("hit"), part(7, 5).alias("mrr"), part(7, 4).alias("ndcg"), part(11, 3).alias("context_precision"), part(13, 3).alias("citation_accuracy"),
        part(5, 3).alias("faithfulness"), part(5, 4).alias("answer_relevance"), part(5, 5).alias("context_relevance"), (i % 9 == 0).cast("double").alias("hallucination"), (i % 3 != 0).alias("judged"),
        (i % 10 == 0).alias("requires_refusal"), (i % 12 == 0).alias("refusal"), F.floor(F.col("value") * 10).cast("long").alias("latency_ms"), (F.col("value") / 100000).alias("cost_usd"),
        F.when(i % 6 == 0, "secondary").when(i % 8 == 0, "cache").when(i % 9 == 1, F.lit(None).cast("string")).otherwise("primary").alias("fallback_hop"), (i % 4 == 0).cast("int").alias("n_errors"),
        part(17, 3).alias("judge2_faithfulness"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.evaluation_summary(eval_rows(spark, sf)))


def evaluation_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.evaluation_summary(eval_rows(spark, sf), "category"))


def evaluation_by_primary(spark: SparkSession, sf: str) -> DataFrame:
    rows = eval_rows(spark, sf).withColumn("is_primary", F.coalesce(F.col("fallback_hop") == "primary", F.lit(False)))
    return _rounded(metrics.evaluation_summary(rows, "is_primary").select("is_primary", "n", "recall", "citation_accuracy", "error_rate", "p95_latency_ms"))


def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("latency_ms").cast("double")
    wanted = {"a_50": ("a", 0.5), "a_95": ("a", 0.95), "b_50": ("b", 0.5), "b_95": ("b", 0.95), "c_05": ("c", 0.05), "c_95": ("c", 0.95), "d_50": ("d", 0.5), "d_95": ("d", 0.95), "e_95": ("e", 0.95)}
    return metrics.percentiles(eval_rows(spark, sf), ["category"], x, wanted)


def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return eval_rows(spark, sf).groupBy("category").agg(*metrics.agreement("faithfulness", "judge2_faithfulness"), F.round(metrics.passive_fallback_rate(), 6).alias("passive_fallback_rate"))


def failures(spark: SparkSession, sf: str) -> DataFrame:
    """Failed questions with their reasons, the first thirty in order: a report."""
    i = F.col("question_id")
    rows = eval_rows(spark, sf).withColumns({
        "judge_error": i % 23 == 0, "ambiguity_handled": F.when(i % 6 == 1, i % 4 != 1),
        "error_labels": F.when(F.col("n_errors") > 0, F.array(F.lit("timeout"), F.when(i % 8 == 0, "gateway").otherwise("reranker"))).otherwise(F.array().cast("array<string>")),
    })
    return rows.select("question_id", metrics.failure_reasons().alias("reasons")).where("reasons <> ''").orderBy("question_id").limit(30)


def refusal_confusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = eval_rows(spark, sf).select(F.when(F.col("requires_refusal"), "refuse").otherwise("answer").alias("expected"), F.when(F.col("refusal"), "refuse").otherwise("answer").alias("actual"))
    return metrics.confusion(rows, "expected", "actual", ["answer", "refuse"])


def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = metrics.distribution(table(spark, sf, "events"), "event_type")
    return d.select("event_type", "n", F.round("share", 9).alias("share"))


def target_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of each category against targets, in long form."""
    s = metrics.evaluation_summary(eval_rows(spark, sf), "category")
    long = s.select("category", F.expr("stack(3, 'recall', recall, 0.4D, 'hallucination_rate', hallucination_rate, 0.05D, 'p95_latency_ms', p95_latency_ms, 6000.0D)").alias("metric", "value", "target"))
    return long.select("category", "metric", metrics.target_verdict(F.col("metric"), F.col("value"), F.col("target")).alias("verdict"))


def score_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Best scores by whether the best document of the list is relevant: percentiles, as for a least score."""
    top = _retrieved(spark, sf).where("rank = 1")
    g = _groups(spark, sf).select("question_id", "chunk_id").distinct().withColumn("hit", F.lit(True))
    rows = top.join(g, ["question_id", "chunk_id"], "left").select(F.coalesce("hit", F.lit(False)).alias("hit"), "score")
    return rows.groupBy("hit").agg(F.count("*").alias("n")).join(metrics.percentiles(rows, ["hit"], F.col("score"), {"p05": ("c", 0.05), "p50": ("c", 0.5)}), "hit")


def best_config(spark: SparkSession, sf: str) -> DataFrame:
    """Two retrieval configurations compared, the better one by recall, then nDCG: a report of one row."""
    r, g, out = _retrieved(spark, sf), _groups(spark, sf), None
    for n, (name, k) in enumerate((("sparse_3", 3), ("sparse_5", 5))):
        m = metrics.mean_metrics(metrics.retrieval_metrics(r.where(F.col("rank") <= k), g, k)).withColumns({"config": F.lit(name), "seq": F.lit(n)})
        out = m if out is None else out.unionByName(m)
    return out.orderBy(F.desc("recall"), F.desc("ndcg"), "seq").limit(1).select("config", F.round("recall", 9).alias("recall"))


def stratified_sample(spark: SparkSession, sf: str, size: int = 50) -> DataFrame:
    """A sample by language: each has its share of size, one at least; members by a seeded hash."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    quota = d.groupBy("lang").agg(F.count("*").alias("n")).withColumn("quota", F.greatest(F.lit(1), F.bround(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))) * size, 0).cast("int")))
    order = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))))
    quota = quota.select(F.col("lang").alias("of"), "quota")
    picked = d.withColumn("_n", F.row_number().over(order)).join(quota, F.col("lang").eqNullSafe(F.col("of"))).where("_n <= quota")
    return picked.orderBy("doc_id").limit(size).select("doc_id", "lang")


_FIRST = """, h AS (SELECT question_id, group_no, rank FROM t JOIN g USING (question_id, chunk_id) WHERE rank <= {k}),
m0 AS (SELECT question_id, min(rank) FILTER (WHERE group_no = 0) AS a, min(rank) FILTER (WHERE group_no = 1) AS b FROM h GROUP BY 1),
alt AS (SELECT question_id, min(rank) FILTER (WHERE rank > m0.a AND group_no = 1) AS b2 FROM h JOIN m0 USING (question_id) GROUP BY 1),
q AS (SELECT question_id, count(DISTINCT group_no) AS n FROM g GROUP BY 1),
f AS (SELECT question_id, min(rank) AS first FROM t JOIN g USING (question_id, chunk_id) GROUP BY 1),
c AS (SELECT question_id, count(DISTINCT group_no) AS c FROM h GROUP BY 1),
x AS (SELECT q.question_id, n, coalesce(c, 0) / n AS recall, (coalesce(c, 0) > 0)::INT::DOUBLE AS hit, coalesce(1 / first, 0) AS mrr,
  (coalesce(1 / log2(a + 1), 0) + coalesce(1 / log2(CASE WHEN b = a THEN b2 ELSE b END + 1), 0)) / CASE n WHEN 1 THEN 1 ELSE 1 + 1 / log2(3) END AS ndcg
  FROM q LEFT JOIN c USING (question_id) LEFT JOIN f USING (question_id) LEFT JOIN m0 USING (question_id) LEFT JOIN alt USING (question_id))"""
_E = """e AS (SELECT event_id AS question_id, event_type AS category, {parts},
(event_id % 9 = 0)::INT::DOUBLE AS hallucination, event_id % 3 <> 0 AS judged, event_id % 10 = 0 AS requires_refusal, event_id % 12 = 0 AS refusal, floor(value * 10)::BIGINT AS latency_ms, value / 100000 AS cost_usd,
CASE WHEN event_id % 6 = 0 THEN 'secondary' WHEN event_id % 8 = 0 THEN 'cache' WHEN event_id % 9 = 1 THEN NULL ELSE 'primary' END AS fallback_hop, (event_id % 4 = 0)::INT AS n_errors FROM events)""".format(
    parts=", ".join(f"CASE WHEN event_id % {m} = 0 THEN NULL ELSE (event_id % {d}) / {d - 1} END AS {n}" for n, m, d in (("recall", 7, 3), ("hit", 7, 2), ("mrr", 7, 5), ("ndcg", 7, 4), ("context_precision", 11, 3), ("citation_accuracy", 13, 3), ("faithfulness", 5, 3), ("answer_relevance", 5, 4), ("context_relevance", 5, 5), ("judge2_faithfulness", 17, 3)))
)
_P = "CASE WHEN count({x}) = 0 THEN NULL ELSE list({x} ORDER BY {x})[{i}] END"


def _pct(kind: str, p: float, x: str = "latency_ms::DOUBLE") -> str:
    n = f"count({x})"
    at = f"floor({n} * {p}::DOUBLE)::BIGINT"
    place = {"a": f"greatest(0, {at} - 1)", "b": f"greatest(0, {at} - 1)", "c": f"least({n} - 1, {at})", "d": f"{n} // 2" if p == 0.5 else f"CASE WHEN {at} < 1 THEN {n} - 1 ELSE {at} - 1 END", "e": f"CASE WHEN {at} < 1 THEN {n} - 1 ELSE {at} - 1 END"}[kind]
    if kind == "b" and p == 0.5:
        return f"median({x})"
    value = f"list({x} ORDER BY {x}) FILTER (WHERE {x} IS NOT NULL)"
    out = f"({value})[({place}) + 1]"
    return f"round({out}, 1)" if kind == "a" else out


_LAT = "(CASE WHEN latency_ms > 0 THEN latency_ms::DOUBLE END)"
_SUMMARY = f"""count(*) AS n, {", ".join(f"round(avg({c}), 6) AS {c}" for c in ("recall", "hit", "mrr", "ndcg", "context_precision", "citation_accuracy"))},
{", ".join(f"round(avg({c}) FILTER (WHERE judged), 6) AS {c}" for c in ("faithfulness", "answer_relevance", "context_relevance"))}, round(avg(hallucination) FILTER (WHERE judged), 6) AS hallucination_rate, count(*) FILTER (WHERE judged) AS n_judged,
round(avg((requires_refusal = refusal)::INT), 6) AS refusal_accuracy, {_pct('a', 0.5, _LAT)} AS p50_latency_ms, {_pct('a', 0.95, _LAT)} AS p95_latency_ms, round(avg(cost_usd), 6) AS avg_cost_usd,
round(avg((coalesce(fallback_hop, 'n/a') NOT IN ('primary', 'n/a', 'unknown'))::INT), 6) AS fallback_rate, round(avg((n_errors > 0)::INT), 6) AS error_rate"""
_FAILED = "(coalesce(requires_refusal <> refusal, FALSE) OR coalesce(hallucination > 0, FALSE) OR coalesce(citation_accuracy < 1, FALSE) OR coalesce(faithfulness < 1, FALSE))"
_WB = r"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{})(?:$|[^\p{{L}}\p{{N}}_])"
_CITES = r"""ch AS (SELECT source AS document_id, doc_id, doc_id % 7 + 1 AS dieu, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 + 1 END AS lo, text FROM documents),
hs AS (SELECT question_id, group_no, doc_id::VARCHAR AS chunk_id, 'structural' AS method FROM ci JOIN ch ON ci.document_id = ch.document_id AND ci.dieu = ch.dieu AND (lo IS NULL OR khoan IS NULL OR khoan BETWEEN lo AND lo + 1)),
re AS (SELECT question_id, group_no, document_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS gt FROM ci WHERE (question_id, group_no) NOT IN (SELECT (question_id, group_no) FROM hs)),
sc AS (SELECT question_id, group_no, doc_id, len(list_intersect(gt, regexp_extract_all(lower(ch.text), '[\p{L}\p{N}_]+'))) / len(gt) AS score FROM re JOIN ch USING (document_id)),
be AS (SELECT *, row_number() OVER (PARTITION BY question_id, group_no ORDER BY score DESC, doc_id) AS rn FROM sc),
lx AS (SELECT question_id, group_no, doc_id::VARCHAR AS chunk_id, 'lexical' AS method FROM be WHERE rn = 1 AND score >= 0.2::DOUBLE),
mm AS (SELECT * FROM hs UNION ALL SELECT * FROM lx UNION ALL SELECT question_id, group_no, NULL, 'none' FROM re WHERE (question_id, group_no) NOT IN (SELECT (question_id, group_no) FROM lx))"""
_CITED = "SELECT item_id AS question_id, 0::BIGINT AS group_no, 'src' || (item_id % 20) AS document_id, CASE WHEN item_id % 5 = 4 THEN NULL ELSE item_id % 9 + 1 END AS dieu, CASE WHEN item_id % 5 <> 4 AND item_id % 2 = 0 THEN item_id % 4 + 1 END AS khoan, text FROM benchmark WHERE item_id % 10 <> 9"
_CITE = f"ci AS ({_CITED}), {_CITES}"
_GROUPS = f"ci AS ({_CITED} UNION ALL SELECT item_id, 1::BIGINT, 'src' || ((item_id + 7) % 20), NULL, NULL, text FROM benchmark WHERE item_id % 10 <> 9), {_CITES}, g AS (SELECT question_id, group_no, chunk_id::BIGINT AS chunk_id FROM mm WHERE chunk_id IS NOT NULL)"
_R = f"{_T} {_ranked('sp', 'r')}, t AS MATERIALIZED (SELECT item_id AS question_id, doc_id AS chunk_id, rank, score FROM r WHERE rank <= 10), {_GROUPS}"
QUERIES = {f.__name__: f for f in (
    retrieval_quality, retrieval_means, context_precision, citation_match, citation_links, answer_parsing, query_policy, retrieval_policy, compressed_chunks, prompt_context, mock_generation,
    evaluation_summary, evaluation_by_category, evaluation_by_primary, percentiles, judge_agreement, failures, refusal_confusion, label_distribution, target_verdicts, score_calibration, best_config, stratified_sample,
)}
SQL = {
    "retrieval_quality": f"WITH {_R} {_FIRST.format(k=5)} SELECT question_id, round(recall, 9) AS recall, round(hit, 9) AS hit, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg FROM x",
    "retrieval_means": f"WITH {_R} {_FIRST.format(k=5)} SELECT count(*) AS n, round(avg(recall), 9) AS recall, round(avg(hit), 9) AS hit, round(avg(mrr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg FROM x",
    "context_precision": f"WITH {_R} SELECT question_id, CASE WHEN question_id IN (SELECT question_id FROM g) THEN round(avg(((question_id, chunk_id) IN (SELECT (question_id, chunk_id) FROM g))::INT), 9) END AS context_precision FROM t WHERE rank <= 5 GROUP BY question_id",
    "citation_match": f"WITH {_CITE} SELECT * FROM mm",
    "citation_links": f"WITH {_CITE} SELECT question_id, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT group_no) FILTER (WHERE method = 'structural') AS n_structural, count(DISTINCT group_no) FILTER (WHERE method = 'lexical') AS n_lexical, count(DISTINCT group_no) FILTER (WHERE method = 'none') AS n_none FROM mm GROUP BY question_id",
    "answer_parsing": "SELECT item_id AS id, item_id % 4 > 1 AS refusal, CASE WHEN item_id % 4 < 2 THEN format('chunk_{:03d}', item_id) ELSE '' END AS citations, CASE WHEN item_id % 4 = 2 THEN 'made_up' ELSE '' END AS invalid, CASE item_id % 4 WHEN 2 THEN 'answer_without_valid_citation' WHEN 3 THEN 'unparseable_model_output' END AS error FROM benchmark",
    "query_policy": f"SELECT item_id, complexity, CASE complexity WHEN 'simple' THEN 'cheap' WHEN 'medium' THEN 'balanced' ELSE 'strong' END AS tier, TRUE AS ambiguity_handled FROM (SELECT item_id, CASE WHEN regexp_matches(lower(text), '{_WB.format('|'.join(policy.CONNECTORS))}') THEN 'hard' WHEN length(text) <= 60 THEN 'simple' ELSE 'medium' END AS complexity FROM benchmark)",
    "retrieval_policy": f"WITH {_R}, s AS (SELECT question_id AS item_id, count(*) AS n, max(round(score / 100, 6)) AS b FROM t GROUP BY 1), z AS (SELECT *, CASE WHEN n < 2 THEN 'no_context' WHEN b < 1.1::DOUBLE THEN 'low_score' END AS reason FROM s) SELECT item_id, CASE WHEN b - 1.1::DOUBLE <= 0.3::DOUBLE THEN 8 WHEN b - 1.1::DOUBLE >= 1.0 THEN 3 ELSE 5 END::BIGINT AS k, reason, CASE WHEN reason IS NULL THEN round_even(0.5::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (b - 1.1::DOUBLE) / 1.1::DOUBLE)) + 0.3::DOUBLE * 0.5::DOUBLE + 0.2::DOUBLE, 2) END AS confidence FROM z",
    "prompt_context": f"WITH {_R}, p AS (SELECT question_id, rank, '[' || chunk_id || '] (' || source || ' - ' || lang || ')' || chr(10) || substr(text, 1, 2500) AS x FROM t JOIN documents ON doc_id = chunk_id WHERE rank <= 3) SELECT question_id, md5('Q ' || question_id || ' {{json}}' || chr(10) || string_agg(x, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS prompt_md5 FROM p GROUP BY question_id".replace("{{json}}", "{json}"),
    "mock_generation": """SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '{"answer":"mock","citations":["chunk_' || item_id || '"],"refusal":false}' ELSE '{"answer":"mock","citations":[],"refusal":true}' END AS answer FROM benchmark""",
    "evaluation_summary": f"WITH {_E} SELECT {_SUMMARY} FROM e",
    "evaluation_by_category": f"WITH {_E} SELECT category, {_SUMMARY} FROM e GROUP BY category",
    "evaluation_by_primary": f"WITH {_E} SELECT coalesce(fallback_hop = 'primary', FALSE) AS is_primary, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(citation_accuracy), 6) AS citation_accuracy, round(avg((n_errors > 0)::INT), 6) AS error_rate, {_pct('a', 0.95, _LAT)} AS p95_latency_ms FROM e GROUP BY 1",
    "percentiles": f"WITH {_E} SELECT category, {', '.join(f'{_pct(k, p)} AS {n}' for n, k, p in (('a_50', 'a', 0.5), ('a_95', 'a', 0.95), ('b_50', 'b', 0.5), ('b_95', 'b', 0.95), ('c_05', 'c', 0.05), ('c_95', 'c', 0.95), ('d_50', 'd', 0.5), ('d_95', 'd', 0.95), ('e_95', 'e', 0.95)))} FROM e GROUP BY category",
    "judge_agreement": f"WITH {_E} SELECT category, count(*) FILTER (WHERE b) AS n_pairs, round(avg(abs(faithfulness - judge2_faithfulness)), 3) AS mean_abs_diff, round(avg((faithfulness = judge2_faithfulness)::INT), 3) AS exact_match_rate, round(avg(CASE WHEN fallback_hop IS NOT NULL AND fallback_hop NOT IN ('cache', 'n/a') THEN (fallback_hop <> 'primary')::INT END), 6) AS passive_fallback_rate FROM (SELECT *, faithfulness IS NOT NULL AND judge2_faithfulness IS NOT NULL AS b FROM e) GROUP BY category",
    "failures": rf"""WITH {_E}, f AS (SELECT question_id, concat_ws('; ',
  CASE WHEN requires_refusal <> refusal THEN format('refusal_sai (kỳ vọng refusal={{}}, thực tế={{}})', CASE WHEN requires_refusal THEN 'True' ELSE 'False' END, CASE WHEN refusal THEN 'True' ELSE 'False' END) END,
  CASE WHEN hit = 0 THEN 'retrieval_miss (hit@k=0)' END,
  CASE WHEN citation_accuracy < 1 THEN format('citation_sai ({{:.2f}})', citation_accuracy) END,
  CASE WHEN judged AND question_id % 23 <> 0 AND faithfulness < 1 THEN format('faithfulness={{:.1f}}', faithfulness) END,
  CASE WHEN judged AND question_id % 23 <> 0 AND hallucination > 0 THEN 'hallucination' END,
  CASE WHEN judged AND question_id % 23 = 0 THEN 'judge_error' END,
  CASE WHEN question_id % 6 = 1 AND question_id % 4 = 1 THEN 'ambiguity_unhandled (chốt 1 nhánh, không hỏi lại/bao quát)' END,
  CASE WHEN n_errors > 0 THEN 'trace_error:timeout,' || CASE WHEN question_id % 8 = 0 THEN 'gateway' ELSE 'reranker' END END) AS reasons FROM e)
SELECT question_id, reasons FROM f WHERE reasons <> '' ORDER BY question_id LIMIT 30""",
    "refusal_confusion": f"WITH {_E} SELECT CASE WHEN requires_refusal THEN 'refuse' ELSE 'answer' END AS expected, count(*) FILTER (WHERE NOT refusal) AS answer, count(*) FILTER (WHERE refusal) AS refuse FROM e GROUP BY 1",
    "label_distribution": "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY event_type",
    "target_verdicts": f"WITH {_E}, s AS (SELECT category, avg(recall) AS r, avg(hallucination) FILTER (WHERE judged) AS h, {_pct('a', 0.95, _LAT)} AS p FROM e GROUP BY category) SELECT category, 'recall' AS metric, CASE WHEN r >= 0.4::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s UNION ALL SELECT category, 'hallucination_rate', CASE WHEN h <= 0.05::DOUBLE THEN 'PASS' ELSE 'FAIL' END FROM s UNION ALL SELECT category, 'p95_latency_ms', CASE WHEN p <= 6000 THEN 'PASS' ELSE 'FAIL' END FROM s",
    "score_calibration": f"WITH {_R}, y AS (SELECT (question_id, chunk_id) IN (SELECT (question_id, chunk_id) FROM g) AS hit, score FROM t WHERE rank = 1) SELECT hit, count(*) AS n, {_pct('c', 0.05, 'score')} AS p05, {_pct('c', 0.5, 'score')} AS p50 FROM y GROUP BY hit",
    "best_config": f"WITH {_R}, y AS ({' UNION ALL '.join(f"SELECT 'sparse_{k}' AS config, {k} AS seq, avg(recall) AS recall, avg(ndcg) AS ndcg FROM (WITH {_FIRST.format(k=k)[1:]} SELECT * FROM x)" for k in (3, 5))}) SELECT config, round(recall, 9) AS recall FROM y ORDER BY y.recall DESC, ndcg DESC, seq LIMIT 1",
    "stratified_sample": "WITH n AS (SELECT lang, greatest(1, round_even(count(*) / sum(count(*)) OVER () * 50, 0)::INT) AS quota FROM documents GROUP BY lang), p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id)) AS rn FROM documents) SELECT doc_id, lang FROM p JOIN n USING (lang) WHERE rn <= quota ORDER BY doc_id LIMIT 50",
}
