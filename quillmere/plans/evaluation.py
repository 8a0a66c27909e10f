"""Evaluation rows as joins: benchmark items, their retrieved documents and expected groups, answers
that cite retrieved documents, traces and feedback about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, metrics
from ..sources.tables import table
from .answers import _FIRST, _R, _groups, _retrieved


def _items(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(i.alias("question_id"), F.format_string("c%d", i % 4).alias("category"), (i % 10 == 9).alias("requires_refusal"))


def _answers(retrieved: DataFrame, items: DataFrame) -> DataFrame:
    """An answer cites the documents of rank 3 or better with an even id; items of 9 and 3 modulo 10 are refused."""
    q = F.col("question_id")
    cited = retrieved.where("rank <= 3 and chunk_id % 2 = 0").groupBy("question_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("cited"))
    out = items.join(cited, "question_id", "left")
    return out.select("question_id", ((q % 10 == 9) | (q % 10 == 3)).alias("refusal"), F.coalesce("cited", F.array().cast("array<bigint>")).alias("cited"))


def evaluation_run(spark: SparkSession, sf: str) -> DataFrame:
    items, r = _items(spark, sf), _retrieved(spark, sf)
    out = assembly.run_questions(items, _answers(r, items), _groups(spark, sf), r)
    rounded = [F.round(c, 9).alias(c) for c in ("recall", "hit", "mrr", "ndcg", "context_precision", "citation_accuracy")]
    return out.select("question_id", "category", "requires_refusal", "refusal", "refusal_correct", *rounded)


def judge_contexts(spark: SparkSession, sf: str) -> DataFrame:
    items, r = _items(spark, sf), _retrieved(spark, sf)
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    c = assembly.judge_contexts(_answers(r, items), r.where("rank <= 5"), texts)
    return c.select("question_id", F.md5("context").alias("context_md5"), F.length("context").alias("n_chars"))


def judge_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Every third pair is in the cache; a stand-in judge answers the others by their length."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.concat(F.lit("a"), F.col("item_id").cast("string")).alias("answer"), F.lit("ctx").alias("context"))
    key = assembly.judge_key(F.col("question"), F.col("answer"), F.col("context"))
    score = F.element_at(F.array(*map(F.lit, assembly.RUBRIC)), (F.length("question") % 3 + 1).cast("int"))
    given = F.struct(score.alias("faithfulness"), F.lit(1.0).alias("answer_relevance"), F.lit(0.5).alias("context_relevance"), (F.length("question") % 2 == 0).alias("hallucination"))
    cache = b.where("question_id % 3 = 0").select(key.alias("key"), given.alias("scores"))
    out, _ = assembly.judge(b, cache, F.to_json(given))
    return out.select("question_id", "key", "cached", "scores.faithfulness", "scores.hallucination")


def _traces(spark: SparkSession, sf: str) -> DataFrame:
    """A trace for each question and one of a provider that does not count, for every second one."""
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    one = b.select(F.format_string("t%d", "item_id").alias("trace_id"), "item_id", "question", F.when(F.col("item_id") % 2 == 0, "gemini").otherwise("litellm").alias("model_provider"))
    return one.unionByName(b.where("item_id % 2 = 0").select(F.format_string("m%d", "item_id").alias("trace_id"), "item_id", "question", F.lit("mock").alias("model_provider")))


def _golden(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf, "benchmark").where(i % 7 != 0).select(i.alias("id"), F.col("text").alias("question"), (i % 10 == 9).alias("requires_refusal"))


def trace_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Three populations of best scores over real traces, their percentiles and the least score that follows."""
    matched = assembly.golden_of_traces(assembly.real_traces(_traces(spark, sf)), _golden(spark, sf))
    r = _retrieved(spark, sf)
    scored = matched.select("trace_id", F.col("item_id").alias("question_id")).join(r, "question_id").select("trace_id", "chunk_id", "score")
    p = assembly.calibration_populations(matched, _groups(spark, sf).withColumnRenamed("question_id", "id"), scored)
    each = metrics.percentiles(p, ["population"], F.col("score"), {f"p{int(100 * q):02d}": ("c", q) for q in (0.01, 0.05, 0.1, 0.25, 0.5)})
    each = each.select("population", *(F.round(c, 4).alias(c) for c in each.columns[1:]))
    told = p.groupBy("population").agg(F.count("*").alias("n")).join(each, "population")
    least = told.where("population = 'should_answer'").select(F.col("p05").alias("suggested"))  # one row
    caught = p.where("population = 'should_refuse'").join(F.broadcast(least)).agg(F.sum((F.col("score") < F.col("suggested")).cast("long")).alias("caught"), F.max("suggested").alias("suggested"))
    return told.crossJoin(F.broadcast(caught))


def feedback_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback on every event about a trace; traces of some items are gone."""
    f = table(spark, sf, "events").select(F.col("event_id").alias("feedback_id"), F.format_string("t%d", F.col("event_id") % 300).alias("trace_id"))
    return assembly.questions_of_feedback(f, _traces(spark, sf)).select("feedback_id", "trace_id", F.md5("question").alias("question_md5"))


def fallback_routing(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    up = F.filter(F.array(*(F.when(i % m != 0, F.lit(h)) for h, m in zip(assembly.HOPS, (2, 3, 5, 7), strict=True))), lambda h: h.isNotNull())
    return table(spark, sf, "events").select("event_id", assembly.route(up).alias("hop")).groupBy("hop").agg(F.count("*").alias("n"))


def label_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Three classes by the event's value and its type's length."""
    e = table(spark, sf, "events").select(F.element_at(F.array(*map(F.lit, ("low", "mid", "high"))), (F.floor(F.col("value")) % 3 + 1).cast("int")).alias("expected"), F.element_at(F.array(*map(F.lit, ("low", "mid", "high"))), (F.length("event_type") % 3 + 1).cast("int")).alias("actual"))
    p = assembly.precision_recall(e, "expected", "actual")
    return p.select("label", "tp", "n_expected", "n_actual", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def failure_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty-five documents that a seed chooses: the feature is the sample."""
    return assembly.seeded_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 25, 42)


_GOLD = "gold AS (SELECT question, max(item_id) AS id FROM (SELECT item_id, text AS question FROM benchmark WHERE item_id % 7 <> 0) GROUP BY question)"
_A = "a AS (SELECT item_id AS question_id, item_id % 10 IN (3, 9) AS refusal FROM benchmark)"
QUERIES = {f.__name__: f for f in (evaluation_run, judge_contexts, judge_scoring, trace_calibration, feedback_questions, fallback_routing, label_precision, failure_sample)}
SQL = {
    "evaluation_run": f"""WITH {_R} {_FIRST.format(k=5)}, {_A},
rel AS (SELECT DISTINCT question_id, chunk_id, TRUE AS ok FROM g), has AS (SELECT DISTINCT question_id FROM g),
cp AS (SELECT question_id, avg(coalesce(ok, FALSE)::INT) AS p FROM t LEFT JOIN rel USING (question_id, chunk_id) WHERE rank <= 5 GROUP BY question_id),
ca AS (SELECT question_id, avg(coalesce(ok, FALSE)::INT) AS p FROM t JOIN a USING (question_id) LEFT JOIN rel USING (question_id, chunk_id) WHERE rank <= 3 AND chunk_id % 2 = 0 AND NOT refusal GROUP BY question_id)
SELECT a.question_id, 'c' || (a.question_id % 4) AS category, a.question_id % 10 = 9 AS requires_refusal, refusal, (a.question_id % 10 = 9) = refusal AS refusal_correct,
  round(recall, 9) AS recall, round(hit, 9) AS hit, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg,
  CASE WHEN a.question_id IN (FROM has) THEN round(cp.p, 9) END AS context_precision, CASE WHEN a.question_id IN (FROM has) THEN round(ca.p, 9) END AS citation_accuracy
FROM a LEFT JOIN x ON x.question_id = a.question_id LEFT JOIN cp ON cp.question_id = a.question_id LEFT JOIN ca ON ca.question_id = a.question_id""",
    "judge_contexts": f"""WITH {_R}, {_A}, c AS (SELECT question_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM t JOIN a USING (question_id) JOIN documents ON doc_id = chunk_id WHERE rank <= 5 AND NOT refusal GROUP BY question_id)
SELECT question_id, md5(context) AS context_md5, length(context) AS n_chars FROM c""",
    "judge_scoring": "SELECT item_id AS question_id, substr(sha256(text || '|a' || item_id || '|ctx'), 1, 24) AS key, item_id % 3 = 0 AS cached, [0.0, 0.5, 1.0][length(text) % 3 + 1]::DOUBLE AS faithfulness, length(text) % 2 = 0 AS hallucination FROM benchmark",
    "trace_calibration": f"""WITH {_R}, {_GOLD},
best AS (SELECT question_id, max(score) AS score FROM t GROUP BY 1),
m AS (SELECT item_id AS question_id, id FROM benchmark JOIN gold ON gold.question = benchmark.text),
p AS (SELECT CASE WHEN id % 10 = 9 THEN 'should_refuse' WHEN EXISTS (SELECT 1 FROM t JOIN g ON g.chunk_id = t.chunk_id WHERE t.question_id = m.question_id AND g.question_id = m.id) OR id NOT IN (SELECT question_id FROM g) THEN 'should_answer' ELSE 'should_answer_miss' END AS population, score FROM m JOIN best USING (question_id)),
l AS (SELECT population, count(*) AS n, list(score ORDER BY score) AS s FROM p GROUP BY 1),
k AS (SELECT population, n, {", ".join(f"round(s[least(n - 1, floor(n * {q}::DOUBLE)::BIGINT) + 1], 4) AS p{int(100 * q):02d}" for q in (0.01, 0.05, 0.1, 0.25, 0.5))} FROM l),
u AS (SELECT p05 AS suggested FROM k WHERE population = 'should_answer')
SELECT k.*, (SELECT sum((score < suggested)::INT)::BIGINT FROM p, u WHERE population = 'should_refuse') AS caught, (SELECT max(suggested) FROM p, u WHERE population = 'should_refuse') AS suggested FROM k""",
    "feedback_questions": "SELECT event_id AS feedback_id, 't' || (event_id % 300) AS trace_id, md5(text) AS question_md5 FROM events LEFT JOIN benchmark ON item_id = event_id % 300",
    "fallback_routing": "SELECT CASE WHEN event_id % 2 <> 0 THEN 'primary' WHEN event_id % 3 <> 0 THEN 'secondary' WHEN event_id % 5 <> 0 THEN 'tertiary' WHEN event_id % 7 <> 0 THEN 'local' END AS hop, count(*) AS n FROM events GROUP BY 1",
    "label_precision": """WITH e AS (SELECT ['low', 'mid', 'high'][(floor(value)::BIGINT % 3) + 1] AS a, ['low', 'mid', 'high'][length(event_type) % 3 + 1] AS b FROM events), l AS (SELECT a AS label FROM e UNION SELECT b FROM e)
SELECT label, tp, n_expected, n_actual, round(tp / nullif(n_actual, 0), 9) AS precision, round(tp / nullif(n_expected, 0), 9) AS recall FROM (SELECT label, (SELECT count(*) FROM e WHERE a = label AND b = label) AS tp, (SELECT count(*) FROM e WHERE a = label) AS n_expected, (SELECT count(*) FROM e WHERE b = label) AS n_actual FROM l)""",
    "failure_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 25",
}
