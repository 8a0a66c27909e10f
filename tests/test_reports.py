"""Optimisation grid, responses, agreement and golden targets on small fixtures."""

from pyspark.sql import functions as F

from quillmere.operators import assembly, checks, experiments, feedback, metrics, observability, optimization, prompts
from quillmere.sources import adapters


def test_optimisation_switches(spark):
    long = "The first sentence says little. Fees are due in May. " + "Nothing else matters here at all. " * 40
    questions = spark.createDataFrame([(1, 1, "fees in May", False, "primary"), (2, 2, "fees in May", False, "secondary"), (3, 3, "nếu A hoặc B", True, "primary"), (4, 4, "x" * 70, False, None)], "question_id long, seq long, question string, requires_refusal boolean, hop string")
    retrieved = spark.createDataFrame([(q, c, c, 2.0 - 0.1 * c) for q in (1, 2, 4) for c in range(1, 9)] + [(3, 1, 1, 0.2)], "question_id long, chunk_id long, rank int, score double")
    texts = spark.createDataFrame([(1, long), (2, "short"), *((c, f"text {c}") for c in range(3, 8)), (8, None)], "chunk_id long, text string")
    relevant = spark.createDataFrame([(1, 1), (1, 2), (2, 7)], "question_id long, chunk_id long")
    alike = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 1), (3, 3), (4, 4)], "question_id long, other long")
    configs = spark.createDataFrame(optimization.CONFIGS, optimization.CONFIG)
    rows = {(r.config_id, r.question_id): r for r in optimization.answered(configs, questions, retrieved, texts, relevant, alike).collect()}
    assert len(rows) == 28
    base, small, wide = rows["O1_baseline", 1], rows["O3_compression", 1], rows["O4_dynamic_top_k", 1]
    assert base.k == 5 and base.context_precision == 0.4 and base.cache_result is None and base.chars == len(long) + 5 + 18 and base.tier == "balanced"
    assert small.chars < 900 and small.context_precision == 0.4
    assert wide.k == 5 and rows["O4_dynamic_top_k", 3].k == 8  # the best score of 3 is under the least one
    assert [rows["O2_cache_pass1_cold", q].cache_result for q in (1, 2, 3, 4)] == ["miss", "hit", "miss", "miss"]
    assert [rows["O2_cache_pass2_warm", q].fallback_hop for q in (1, 2, 3, 4)] == ["cache", "cache", "n/a", "cache"]
    assert rows["O3_compression", 3].refusal and rows["O3_compression", 3].refusal_correct and rows["O3_compression", 3].cost_usd == 0
    assert [rows["O5_routing", q].tier for q in (1, 3, 4)] == ["cheap", "strong", "balanced"]
    assert abs(rows["O5_routing", 1].cost_usd / base.cost_usd - 1 / 3) < 1e-9
    g = {r.config_id: r for r in optimization.grid(optimization.answered(configs, questions, retrieved, texts, relevant, alike)).collect()}
    assert g["O2_cache_pass2_warm"].cache_hits == 3 and g["O2_cache_pass2_warm"].cache_lookups == 4 and g["O1_baseline"].cache_lookups == 0 and g["O1_baseline"].refusal_accuracy == 1
    assert len({r.passive_fallback_rate for r in g.values()}) == 1 and 0 < g["O1_baseline"].passive_fallback_rate < 1


def test_responses_show_chunks_for_debug_alone(spark):
    answers = spark.createDataFrame([("a", True, "x"), ("b", False, "y"), ("c", True, "z")], "request_id string, debug boolean, answer string")
    retrieved = spark.createDataFrame([("a", 2, "k2", 0.5, None, "d", "t" * 300), ("a", 1, "k1", 0.7, "s", "d", None), ("b", 1, "k3", 0.1, "s", "d", "u")], "request_id string, rank int, chunk_id string, score double, section string, document_id string, text string")
    got = {r.request_id: r for r in assembly.respond(answers, retrieved, {"prompt_version": "p7", "data_version": "d"}).collect()}
    assert [(c.chunk_id, c.text_preview) for c in got["a"].retrieved_chunks] == [("k1", None), ("k2", "t" * 200)]
    assert got["b"].retrieved_chunks is None and got["b"].prompt_version is None and got["c"].retrieved_chunks == [] and got["c"].data_version == "d"
    assert "debug" not in got["a"].asDict()


def test_agreement_of_judges(spark):
    kind = "struct<faithfulness:double,answer_relevance:double,context_relevance:double,hallucination:boolean>"
    rows = spark.createDataFrame([("a", (1.0, 0.5, 0.0, True), (1.0, 1.0, 0.0, True)), ("a", (0.0, 0.5, 0.0, False), (0.5, 0.5, 1.0, True)), ("a", None, (1.0, 1.0, 1.0, True)), ("b", (1.0, 1.0, 1.0, False), None)], f"c string, judge {kind}, judge2 {kind}")
    (r,) = metrics.inter_judge(rows, "c").collect()
    assert (r.n_pairs, r.faithfulness_mean_abs_diff, r.faithfulness_exact_match_rate, r.context_relevance_mean_abs_diff, r.hallucination_agreement_rate) == (2, 0.25, 0.5, 0.5, 0.5)


def test_golden_targets_and_counts(spark):
    rows = spark.createDataFrame([("factoid", False, ["a"]), ("factoid", True, ["data_gap"]), ("procedural", True, None), ("out_of_scope", True, []), ("adversarial", None, ["a", "data_gap"]), (None, None, None)], "category string, requires_refusal boolean, risk_tags array<string>")
    rows = rows.withColumns({"difficulty": F.lit("easy"), "review_status": F.lit("approved")})
    assert {r.group: r.n for r in checks.golden_targets(rows).collect()} == {"answerable": 2, "no_answer": 1, "adversarial": 2, "multi_hop": 0, "ambiguous": 0}
    assert {r.value: r.n for r in checks.golden_counts(rows).where("kind = 'risk_tag'").collect()} == {"a": 2, "data_gap": 2}
    assert {r.group: r.share for r in checks.golden_targets(rows.limit(0)).collect()}["ambiguous"] == 0


def test_histograms(spark):
    rows = spark.createDataFrame([(0.004, 0.0), (0.3, 5.0), (99.0, 11.0)], "retrieval_s double, n_chunks double").withColumn("v", F.lit("p"))
    (r,) = observability.request_histograms(rows, "v").collect()
    assert r.retrieval[0] == 1 and r.retrieval[-1] == 3 and r.chunks[:6] == [1, 1, 1, 1, 1, 2] and r.chunks[-2:] == [2, 3] and r.retrieval_p95 == 10


def test_one_judge_key(spark):
    row = spark.createDataFrame([("q", None, "c")], "q string, a string, c string")
    import hashlib

    assert row.select(assembly.judge_key(F.col("q"), F.col("a"), F.col("c"))).first()[0] == hashlib.sha256(b"q||c").hexdigest()[:24]
    assert not hasattr(adapters, "judge_key")


def test_items_of_a_run(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, category string")
    assert experiments.select_items(items, "full").count() == 3 and [r.id for r in experiments.select_items(items, "listed", ids=["c", "a"]).collect()] == ["c", "a"]
    assert {r.id for r in experiments.select_items(items, "targeted", "x").collect()} == {"a", "c"}
    assert feedback.listed(items.withColumn("status", F.lit("open")), "open").count() == 3 and prompts is not None
