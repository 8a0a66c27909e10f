"""Reports: optimisation grid, responses, agreement of judges, golden-set targets, models, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, checks, chunking, metrics, observability, optimization, policy, search
from ..sources import markdown
from ..sources.tables import table
from .answers import _E, _R, _SUMMARY, _groups, _retrieved, eval_rows
from .answers import _WB as _WORD_BOUNDS
from .evaluation import _answers, _items
from .experiments import CHUNKINGS, _windows


def _alike(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose vectors (of vec_id = item_id / 2, so that each has a twin) reach the cache's least cosine."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    items = table(spark, sf, "benchmark").select("item_id", F.floor(F.col("item_id") / 2).alias("vec_id")).join(v, "vec_id")
    q, d = items.select(F.col("item_id").alias("question_id"), F.col("embedding").alias("q_vec")), items.select(F.col("item_id").alias("other"), F.col("embedding").alias("d_vec"))
    return search.dense_scores(q, d, "question_id", "other").where(F.col("score") >= search.CACHE_HIT).select("question_id", "other")


def optimisation_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Seven configurations over the same items; scores over 100, as the policies' bounds ask."""
    i = F.col("item_id")
    hop = F.when(i % 11 == 0, "secondary").otherwise("primary")
    questions = table(spark, sf, "benchmark").select(i.alias("question_id"), i.alias("seq"), F.col("text").alias("question"), (i % 10 == 9).alias("requires_refusal"), hop.alias("hop"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    retrieved = _retrieved(spark, sf).withColumn("score", F.round(F.col("score") / 100, 6))
    rows = optimization.answered(spark.createDataFrame(optimization.CONFIGS, optimization.CONFIG), questions, retrieved, texts, _groups(spark, sf), _alike(spark, sf))
    g = optimization.grid(rows)
    return g.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in g.dtypes))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to items as responses; every second one asks for debug."""
    items, r = _items(spark, sf), _retrieved(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("lang").alias("section"), "text")
    a = _answers(r, items).select(F.col("question_id").alias("request_id"), F.when(~F.col("refusal"), "yes").otherwise("no").alias("answer"), "cited", "refusal", (F.col("question_id") % 2 == 0).alias("debug"))
    out = assembly.respond(a, r.withColumnRenamed("question_id", "request_id").join(d, "chunk_id"), {"prompt_version": "p1", "retrieval_config_id": "c1", "data_version": "d1", "index_version": "i1"})
    shown = F.transform("retrieved_chunks", lambda c: F.concat_ws("|", c["chunk_id"].cast("string"), c["document_id"], c["section"], c["text_preview"]))
    return out.select("request_id", "answer", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"), "refusal", F.md5(F.array_join(shown, "\n")).alias("chunks_md5"), "prompt_version", "index_version")


def _two_judges(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("question_id")
    part = lambda m, d: F.when(i % m == 0, F.lit(None).cast("double")).otherwise((i % d) / (d - 1))
    second = F.when(i % 19 != 0, F.struct(F.coalesce(part(17, 3), F.lit(0.0)).alias("faithfulness"), part(1000003, 4).alias("answer_relevance"), ((i % 5) / 4).alias("context_relevance"), (i % 8 == 0).alias("hallucination")))
    first = F.when(F.col("judged"), F.struct(F.coalesce("faithfulness", F.lit(0.0)).alias("faithfulness"), F.coalesce("answer_relevance", F.lit(0.0)).alias("answer_relevance"), F.coalesce("context_relevance", F.lit(0.0)).alias("context_relevance"), (F.col("hallucination") > 0).alias("hallucination")))
    return eval_rows(spark, sf).select("category", first.alias("judge"), second.alias("judge2"))


def inter_judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.inter_judge(_two_judges(spark, sf), "category")


def _golden(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    category = F.element_at(F.array(*map(F.lit, ("factoid", "procedural", "multi_hop", "ambiguous", "adversarial", "out_of_scope"))), (i % 6 + 1).cast("int"))
    tags = F.concat(F.when(i % 9 == 0, F.array(F.lit("data_gap"))).otherwise(F.array().cast("array<string>")), F.when(i % 2 == 0, F.array(F.lit("fees"))).otherwise(F.array().cast("array<string>")))
    return table(spark, sf, "benchmark").select(i.alias("id"), category.alias("category"), F.when(i % 3 == 0, "hard").otherwise("easy").alias("difficulty"), (i % 4 == 1).alias("requires_refusal"), tags.alias("risk_tags"), F.when(i % 5 == 0, "approved").otherwise("pending_review").alias("review_status"))


def golden_counts(spark: SparkSession, sf: str) -> DataFrame:
    return checks.golden_counts(_golden(spark, sf))


def golden_targets(spark: SparkSession, sf: str) -> DataFrame:
    t = checks.golden_targets(_golden(spark, sf))
    return t.select("group", "n", "target", F.round("share", 9).alias("share"))


def evaluation_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation of each provider and model."""
    rows = eval_rows(spark, sf).withColumns({"provider": F.when(F.col("question_id") % 2 == 0, "gemini").otherwise("litellm"), "model": F.concat(F.lit("m"), (F.col("question_id") % 3).cast("string"))})
    s = metrics.evaluation_summary(rows, "provider", "model")
    return s.select("provider", "model", "n", *(F.round(c, 6).alias(c) for c in ("refusal_accuracy", "citation_accuracy", "faithfulness", "hallucination_rate", "avg_cost_usd", "p95_latency_ms", "fallback_rate")), "n_judged")


def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks and tokens of each strategy over one collection."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.chunk_fixed_all(d, "doc_id", CHUNKINGS).groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))


def retrieval_histograms(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval seconds and chunks a request, as cumulative buckets with quantiles."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    rows = e.select(F.concat(F.lit("p"), (i % 3).cast("string")).alias("prompt_version"), (F.col("value") / 40).alias("retrieval_s"), (i % 12).cast("double").alias("n_chunks"))
    h = observability.request_histograms(rows, "prompt_version")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return h.select("prompt_version", text(F.col("retrieval")).alias("retrieval"), text(F.col("chunks")).alias("chunks"), F.round("retrieval_p95", 6).alias("retrieval_p95"), F.round("chunks_p50", 6).alias("chunks_p50"))


def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation by category as a Markdown table, best recall first."""
    s = metrics.evaluation_summary(eval_rows(spark, sf), "category").select("category", "n", F.round("recall", 6).alias("recall"), F.round("citation_accuracy", 6).alias("citation_accuracy"))
    return markdown.lines(s, [F.desc("recall"), F.col("category")], {"category": "Nhóm", "n": "Số câu"})


_RB, _CB = observability.RETRIEVAL_BUCKETS, observability.CHUNK_BUCKETS


def _quantile(b: str, bounds: tuple, q: float) -> str:
    n, les = len(bounds), f"({[float(x) for x in bounds]}::DOUBLE[])"
    return f"""(SELECT CASE WHEN {b}[{n + 1}] = 0 THEN NULL WHEN pos >= {n} THEN {float(bounds[-1])} ELSE round(coalesce({les}[pos], 0) + ({les}[pos + 1] - coalesce({les}[pos], 0)) * ({b}[{n + 1}] * {q}::DOUBLE - coalesce({b}[pos], 0)) / ({b}[pos + 1] - coalesce({b}[pos], 0)), 6) END
FROM (SELECT len(list_filter({b}[1:{n}], lambda y: y < {b}[{n + 1}] * {q}::DOUBLE)) AS pos))"""


def _cumulative(x: str, bounds: tuple) -> str:
    return "[" + ", ".join(f"count(*) FILTER (WHERE {x} <= {float(b)}::DOUBLE)" for b in bounds) + f", count({x})]"


_TIER = f"CASE WHEN regexp_matches(lower(text), '{_WORD_BOUNDS.format('|'.join(policy.CONNECTORS))}') THEN 'strong' WHEN length(text) <= 60 THEN 'cheap' ELSE 'balanced' END"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
_GRID = rf"""{_R},
qs AS (SELECT item_id AS question_id, text, item_id % 10 = 9 AS requires_refusal, CASE WHEN item_id % 11 = 0 THEN 'secondary' ELSE 'primary' END AS hop, {_TIER} AS auto FROM benchmark),
bq AS (SELECT question_id, count(*) AS n, max(round(score / 100, 6)) AS b FROM t GROUP BY 1),
qq AS (SELECT qs.*, coalesce(n, 0) < 2 OR b < 1.1::DOUBLE AS refusal, CASE WHEN n IS NULL THEN 5 WHEN b - 1.1::DOUBLE <= 0.3::DOUBLE THEN 8 WHEN b - 1.1::DOUBLE >= 1.0 THEN 3 ELSE 5 END AS dk FROM qs LEFT JOIN bq USING (question_id)),
al AS (SELECT a.item_id AS question_id, o.item_id AS other FROM benchmark a JOIN embeddings x ON x.vec_id = a.item_id // 2, benchmark o JOIN embeddings y ON y.vec_id = o.item_id // 2 WHERE round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) >= 0.97::DOUBLE),
kn AS (SELECT al.question_id, bool_or(other < al.question_id) AS cold FROM al JOIN qq ON qq.question_id = other WHERE NOT refusal GROUP BY 1),
ck AS (SELECT question_id, chunk_id, rank, d.text AS ct, qs.text AS qt, length(d.text) AS size FROM t JOIN documents d ON d.doc_id = chunk_id JOIN qs USING (question_id) WHERE rank <= 8),
sn AS (SELECT question_id, chunk_id, qt, list_filter(list_transform(string_split(regexp_replace(regexp_replace(ct, '([.!?;])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM ck WHERE size > {policy.MAX_CHARS}),
su AS (SELECT question_id, chunk_id, qt, unnest(range(len(p))) AS pos, unnest(p) AS x FROM sn),
sk AS (SELECT question_id, chunk_id, pos, length(x) AS n, len(list_intersect({_TOKENS.format('x')}, {_TOKENS.format('qt')})) AS shared FROM su),
sr AS (SELECT question_id, chunk_id, n, row_number() OVER o AS rn, sum(n) OVER o AS total FROM sk WINDOW o AS (PARTITION BY question_id, chunk_id ORDER BY shared DESC, pos)),
sz AS (SELECT question_id, chunk_id, sum(n) + count(*) - 1 AS n FROM sr WHERE rn = 1 OR total <= {policy.MAX_CHARS} GROUP BY ALL),
ch2 AS (SELECT ck.question_id, rank, coalesce(least(size, 2500), 0) AS whole, coalesce(least(coalesce(sz.n, size), 2500), 0) AS short, ((ck.question_id, ck.chunk_id) IN (SELECT (question_id, chunk_id) FROM g))::INT AS good FROM ck LEFT JOIN sz ON sz.question_id = ck.question_id AND sz.chunk_id = ck.chunk_id),
cf (config_id, cache, warm, compression, dynamic_k, routing) AS (VALUES {', '.join(str(tuple(c)) for c in optimization.CONFIGS)}),
ev AS (SELECT config_id, qq.question_id, cache, compression, refusal, requires_refusal, hop, CASE WHEN dynamic_k THEN dk ELSE 5 END AS k, CASE WHEN routing THEN auto ELSE 'balanced' END AS tier, cache AND NOT refusal AND CASE WHEN warm THEN kn.question_id IS NOT NULL ELSE coalesce(cold, FALSE) END AS hit FROM qq CROSS JOIN cf LEFT JOIN kn ON kn.question_id = qq.question_id),
sm AS (SELECT config_id, ev.question_id, sum(whole) AS whole, sum(short) AS short, avg(good) AS good FROM ev JOIN ch2 ON ch2.question_id = ev.question_id AND rank <= k GROUP BY 1, 2),
rw AS (SELECT ev.*, CASE WHEN hit OR refusal THEN 0.0::DOUBLE ELSE coalesce(CASE WHEN compression THEN short ELSE whole END, 0)::DOUBLE END AS chars, good, CASE WHEN hit THEN 'cache' WHEN refusal THEN 'n/a' ELSE hop END AS fh FROM ev LEFT JOIN sm ON sm.config_id = ev.config_id AND sm.question_id = ev.question_id)
SELECT config_id, count(*) AS n, round(avg(good), 9) AS context_precision, round(avg((refusal = requires_refusal)::INT), 9) AS refusal_accuracy, round(avg(k), 9) AS mean_k, round(avg(chars), 9) AS mean_chars,
round(avg(chars / 4 / 1e6::DOUBLE * CASE tier WHEN 'cheap' THEN 0.1::DOUBLE WHEN 'balanced' THEN 0.3::DOUBLE ELSE 1.25::DOUBLE END), 9) AS avg_cost_usd, count(*) FILTER (WHERE cache AND hit) AS cache_hits, count(*) FILTER (WHERE cache) AS cache_lookups,
(SELECT round(avg((fh <> 'primary')::INT), 9) FROM rw WHERE fh NOT IN ('cache', 'n/a')) AS passive_fallback_rate FROM rw GROUP BY config_id"""
_GS = "gs AS (SELECT item_id AS id, (['factoid', 'procedural', 'multi_hop', 'ambiguous', 'adversarial', 'out_of_scope'])[item_id % 6 + 1] AS category, CASE WHEN item_id % 3 = 0 THEN 'hard' ELSE 'easy' END AS difficulty, item_id % 4 = 1 AS refusal, item_id % 9 = 0 AS gap, item_id % 2 = 0 AS fees, CASE WHEN item_id % 5 = 0 THEN 'approved' ELSE 'pending_review' END AS status FROM benchmark)"
QUERIES = {f.__name__: f for f in (optimisation_grid, responses, inter_judge_agreement, golden_counts, golden_targets, evaluation_by_model, chunk_counts, retrieval_histograms, markdown_report)}
SQL = {
    "markdown_report": f"""WITH {_E}, s AS (SELECT category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(citation_accuracy), 6) AS cited FROM e GROUP BY category)
SELECT 0 AS line, '| Nhóm | Số câu | recall | citation_accuracy |' AS text UNION ALL SELECT 1, '|---|---:|---:|---:|' UNION ALL
SELECT (row_number() OVER (ORDER BY recall DESC, category) + 1)::INT, format('| {{}} | {{}} | {{:.3f}} | {{:.3f}} |', category, n, recall, cited) FROM s""",
    "optimisation_grid": f"WITH {_GRID}",
    "responses": f"""WITH {_R}, an AS (SELECT item_id AS request_id, item_id % 10 IN (3, 9) AS refusal FROM benchmark),
ct AS (SELECT question_id AS request_id, string_agg(chunk_id, ',' ORDER BY chunk_id) AS cited FROM t WHERE rank <= 3 AND chunk_id % 2 = 0 GROUP BY 1),
dx AS (SELECT question_id AS request_id, md5(string_agg(concat_ws('|', chunk_id, source, lang, substr(text, 1, 200)), chr(10) ORDER BY rank)) AS m FROM t JOIN documents ON doc_id = chunk_id WHERE question_id % 2 = 0 GROUP BY 1)
SELECT request_id, CASE WHEN refusal THEN 'no' ELSE 'yes' END AS answer, coalesce(cited, '') AS cited, refusal, CASE WHEN request_id % 2 = 0 THEN coalesce(m, md5('')) END AS chunks_md5, CASE WHEN request_id % 2 = 0 THEN 'p1' END AS prompt_version, CASE WHEN request_id % 2 = 0 THEN 'i1' END AS index_version
FROM an LEFT JOIN ct USING (request_id) LEFT JOIN dx USING (request_id)""",
    "inter_judge_agreement": f"""WITH {_E}, p AS (SELECT category, coalesce(faithfulness, 0) AS f, coalesce(answer_relevance, 0) AS a, coalesce(context_relevance, 0) AS c, hallucination > 0 AS h, CASE WHEN question_id % 17 = 0 THEN 0 ELSE (question_id % 3) / 2 END AS f2, CASE WHEN question_id % 1000003 = 0 THEN NULL ELSE (question_id % 4) / 3 END AS a2, (question_id % 5) / 4 AS c2, question_id % 8 = 0 AS h2 FROM e WHERE judged AND question_id % 19 <> 0)
SELECT category, count(*) AS n_pairs, {', '.join(f"round(avg(abs({x} - {x}2)), 3) AS {n}_mean_abs_diff, round(avg(({x} = {x}2)::INT), 3) AS {n}_exact_match_rate" for x, n in (('f', 'faithfulness'), ('a', 'answer_relevance'), ('c', 'context_relevance')))}, round(avg((h = h2)::INT), 3) AS hallucination_agreement_rate FROM p GROUP BY category""",
    "golden_counts": f"WITH {_GS} SELECT 'category' AS kind, category AS value, count(*) AS n FROM gs GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty, count(*) FROM gs GROUP BY 2 UNION ALL SELECT 'review_status', status, count(*) FROM gs GROUP BY 2 UNION ALL SELECT 'risk_tag', 'data_gap', count(*) FROM gs WHERE gap HAVING count(*) > 0 UNION ALL SELECT 'risk_tag', 'fees', count(*) FROM gs WHERE fees HAVING count(*) > 0",
    "golden_targets": f"""WITH {_GS}, c AS (SELECT 'answerable' AS "group", count(*) FILTER (WHERE category = 'factoid' AND NOT refusal OR category = 'procedural') AS n, 200 AS target FROM gs UNION ALL SELECT 'no_answer', count(*) FILTER (WHERE refusal AND gap), 30 FROM gs UNION ALL SELECT 'adversarial', count(*) FILTER (WHERE category IN ('adversarial', 'out_of_scope')), 20 FROM gs UNION ALL SELECT 'multi_hop', count(*) FILTER (WHERE category = 'multi_hop'), 30 FROM gs UNION ALL SELECT 'ambiguous', count(*) FILTER (WHERE category = 'ambiguous'), 20 FROM gs)
SELECT "group", n, target, round(n / target, 9) AS share FROM c""",
    "evaluation_by_model": f"WITH {_E} SELECT provider, model, n, refusal_accuracy, citation_accuracy, faithfulness, hallucination_rate, avg_cost_usd, p95_latency_ms, fallback_rate, n_judged FROM (SELECT CASE WHEN question_id % 2 = 0 THEN 'gemini' ELSE 'litellm' END AS provider, 'm' || (question_id % 3) AS model, {_SUMMARY} FROM e GROUP BY 1, 2)",
    "chunk_counts": f"SELECT config_id AS strategy, count(*) AS n_chunks, sum(len(string_split(text, ' ')))::BIGINT AS n_tokens FROM ({' UNION ALL '.join(_windows(n, *x) for n, x in CHUNKINGS.items())}) GROUP BY 1",
    "retrieval_histograms": f"WITH h AS (SELECT 'p' || (event_id % 3) AS prompt_version, {_cumulative('value / 40', _RB)} AS r, {_cumulative('event_id % 12', _CB)} AS c FROM events GROUP BY 1) SELECT prompt_version, array_to_string(r, ',') AS retrieval, array_to_string(c, ',') AS chunks, {_quantile('r', _RB, 0.95)} AS retrieval_p95, {_quantile('c', _CB, 0.5)} AS chunks_p50 FROM h",
}
