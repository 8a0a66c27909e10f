"""Files, configurations, prompts and checks that no query exercises."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quillmere.functions import text as T
from quillmere.operators import checks, prompts
from quillmere.sources import files, markdown


def test_trace_log_is_appended_and_stamped(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "2024-01-01T00:00:00Z")], "trace_id string, created_at string")
    for _ in range(2):
        files.append_traces(rows, str(tmp_path / "log"))
    got = files.read_jsonl(spark, str(tmp_path / "log")).collect()
    assert len(got) == 4 and all(r.created_at for r in got) and sum(r.created_at == "2024-01-01T00:00:00Z" for r in got) == 2


def test_latest_file_counts(spark, tmp_path):
    for name, n in (("run_20240101.json", 1), ("run_20240301.json", 3), ("run_20240201.json", 2)):
        (tmp_path / name).write_text(json.dumps({"n": n}))
    assert [r.n for r in files.latest(files.read_json(spark, str(tmp_path / "run_*.json"))).collect()] == [3]


def test_configurations(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("retrieval_config_id: r1\nk: 5\n")
    (tmp_path / "b.yaml").write_text("- a list\n")
    (tmp_path / "c.json").write_text('{"id": "c1"}')
    assert files.load_config(spark, str(tmp_path / "a.yaml"), "retrieval_config_id")["k"] == 5
    with pytest.raises(ValueError, match="mapping"):
        files.load_config(spark, str(tmp_path / "b.yaml"))
    with pytest.raises(ValueError, match="lacks"):
        files.load_config(spark, str(tmp_path / "a.yaml"), "other_id")
    with pytest.raises(Exception):  # noqa: B017, PT011  Spark's own error of a missing path
        files.load_config(spark, str(tmp_path / "none.yaml"))
    paths = {str(tmp_path / n): f for n, f in (("a.yaml", "retrieval_config_id"), ("b.yaml", "id"), ("c.json", "id"), ("none.yaml", "id"))}
    assert [r.id for r in files.config_ids(spark, paths).orderBy("file").collect()] == ["r1", "missing", "c1", "missing"]


def test_evaluation_csv(spark, tmp_path):
    rows = spark.createDataFrame([("q1", 0.5, ["a", "b"], "x")], "question_id string, recall_at_5 double, error_labels array<string>, other string").coalesce(1)
    files.write_eval_csv(rows, str(tmp_path / "e"))
    head, line = "\n".join(p.read_text() for p in (tmp_path / "e").glob("*.csv")).strip().split("\n")
    assert tuple(head.split(",")) == files.EVAL_COLUMNS and len(line.split(",")) == 24 and line.startswith("q1,") and line.endswith(",a|b") and ",0.5," in line


def test_points_fit_their_vectors(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    vectors = lambda *rows: spark.createDataFrame(rows, "chunk_id string, vector array<double>")
    assert files.checked_points(chunks, vectors(("a", [1.0, 2.0]), ("b", [0.0, 1.0])), 2).count() == 2
    for rows, told in ((vectors(("a", [1.0, 2.0])), "no vector for b"), (vectors(("a", [1.0, 2.0]), ("b", [1.0])), "a width other than 2 in b"), (vectors(("a", [1.0, 2.0]), ("b", [0.0, 0.0]), ("c", [0.0, 0.0])), "no chunk for the vector of c")):
        with pytest.raises(Exception, match=told):
            files.checked_points(chunks, rows, 2).collect()


def test_trace_ids(spark):
    ids = [r[0] for r in spark.range(500).select(files.trace_id("req")).collect()]
    assert len(set(ids)) == 500 and all(re.fullmatch(r"req_\d{8}_\d{6}_[0-9a-f]{8}", i) for i in ids)


def test_markdown(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 1, 0.5, ["x", "y"]), ("c", 2, None, None)], "name string, n int, score double, tags array<string>")
    table = markdown.lines(rows, [F.desc("n")], {"name": "Name"})
    markdown.write([("One", table), ("Two", table)], str(tmp_path / "r"))
    text = "\n".join(p.read_text() for p in (tmp_path / "r").glob("*.txt"))
    part = "## {}\n\n| Name | n | score | tags |\n|---|---:|---:|---|\n| c | 2 | n/a |  |\n| a\\|b | 1 | 0.500 | x, y |\n\n"
    assert text == part.format("One") + part.format("Two")


def seeds(spark):
    rows = [("p", f"p{k}", "Q {question} C {context}", ["question", "context"], f"v{k}") for k in range(3)]
    df = spark.createDataFrame(rows, "prompt_id string, prompt_version string, template string, variables array<string>, change_summary string")
    at = F.lit("2024-01-01").cast("timestamp")
    return df.select("prompt_id", "prompt_version", "template", "variables", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("parent_version"), "change_summary", F.lit(None).cast("string").alias("eval_result_id"), at.alias("created_at"), F.lit(None).cast("timestamp").alias("activated_at"), F.lit(None).cast("string").alias("activated_by"))


def test_prompts_are_seeded_once(spark):
    first = prompts.seed(prompts.empty(spark), seeds(spark), "p2", "seed", "2024-01-02")
    got = {r.prompt_version: r for r in first.collect()}
    assert {v: r.status for v, r in got.items()} == {"p0": "testing", "p1": "testing", "p2": "active"} and "bootstrap" in got["p2"].change_summary
    again = prompts.seed(first, seeds(spark), "p0", "seed", "2024-01-03")
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    told = prompts.set_result(first, "p", "p1", "eval_7")
    assert {r.prompt_version: r.eval_result_id for r in told.collect()} == {"p0": None, "p1": "eval_7", "p2": None}
    with pytest.raises(KeyError):
        prompts.set_result(first, "p", "p9", "eval_7")


def test_golden_review_and_seed(spark):
    item = lambda i, q, s="pending_review", c=(): (i, q, "truth", list(c), ["d"], [], "factoid", "easy", False, False, [], s, 1)
    kind = "id string, question string, ground_truth string, relevant_chunks array<string>, relevant_documents array<string>, expected_citations array<string>, category string, difficulty string, requires_refusal boolean, requires_clarification boolean, risk_tags array<string>, review_status string, seq int"
    items = spark.createDataFrame([item("a", "qa"), item("b", "qb")], kind)
    assert {r.id: r.review_status for r in checks.approve(items, ["a"], "me", "2024").collect()} == {"a": "approved", "b": "pending_review"}
    assert checks.approve(items, None, "me", "2024").where("review_status = 'approved' and reviewer = 'me'").count() == 2
    with pytest.raises(ValueError, match="errors"):
        checks.approve(items.unionByName(items), None, "me", "2024")
    old = spark.createDataFrame([item("a", "old", "approved", ["c1"]), item("z", "gone")], kind)
    merged = {r.id: r for r in checks.merge_seed(items, old).collect()}
    assert set(merged) == {"a", "b"} and merged["a"].review_status == "approved" and merged["a"].relevant_chunks == ["c1"] and merged["a"].question == "qa" and merged["b"].relevant_chunks == []


def test_articles_and_pages(spark):
    row = spark.createDataFrame([("Điều 1. A\nĐiều 12: B", "--- Trang 3 ---\nx  y\n\n\n\nz")], "t string, p string")
    found = row.select(*(checks.article_in_source(F.lit(n), F.col("t")) for n in (1, 2, 12)), T.clean_keep_pages(F.col("p"))).first()
    assert tuple(found) == (True, False, True, "[PG:3]\nx y\n\nz")
