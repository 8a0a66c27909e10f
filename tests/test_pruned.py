"""Pruned searches give the rows of full ones, and skip what they say."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.functions import text as T
from quillmere.operators import blockmax, citations, index, pivots, search
from quillmere.plans import retrieval


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_block_max_equals_full_scoring(spark):
    """Documents of one topic and many common words: half of the postings and more are never met."""
    rng = random.Random(2)
    common, rare = [f"w{k}" for k in range(40)], [f"r{k}" for k in range(300)]
    texts = [(k, " ".join(rng.choices(common, k=rng.randint(5, 60)) + rng.choices(rare, k=6))) for k in range(1500)] + [(9000 + k, t) for k, t in enumerate(("", None, "only unseen"))]
    queries = [(k, " ".join(rng.sample(rare, 3) + rng.sample(common, 12))) for k in range(40)] + [(98, "nothing known"), (99, " ".join(common)), (100, "")]
    d, q = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    parts = index.pruned_scores_input(d, "doc_id", q, "item_id")
    full = search.top_k(search.sparse_scores(*parts, "item_id", "doc_id"), 5, "item_id", "doc_id")
    best, counts = blockmax.block_max_top_k(*parts, "item_id", "doc_id")
    assert rows(best.select("item_id", "doc_id", "score", "rank")) == rows(full.select("item_id", "doc_id", "score", "rank"))
    c = counts.first()
    assert 0 < c["first"] + c["summed"] + c["completed"] + c["blocks"] < 0.5 * c["full"]


@pytest.mark.parametrize("k", [1, 3, 10_000])
def test_block_max_ties_and_few_documents(spark, k):
    d = spark.createDataFrame([(i, "a b c" if i % 2 else "a b", ) for i in range(200)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a"), (2, "c a"), (3, "b c"), (4, "")], "item_id long, text string")
    parts = index.pruned_scores_input(d, "doc_id", q, "item_id")
    full = search.top_k(search.sparse_scores(*parts, "item_id", "doc_id"), k, "item_id", "doc_id")
    best, _ = blockmax.block_max_top_k(*parts, "item_id", "doc_id", k)
    assert rows(best.select("item_id", "doc_id", "score", "rank")) == rows(full.select("item_id", "doc_id", "score", "rank"))
    none = index.pruned_scores_input(d.limit(0), "doc_id", q, "item_id")
    assert blockmax.block_max_top_k(*none, "item_id", "doc_id", k)[0].count() == 0


def test_block_max_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    texts, items = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    _, counts = blockmax.block_max_top_k(*index.pruned_scores_input(texts, "doc_id", items, "item_id"), "item_id", "doc_id")
    c = counts.first()
    assert c["first"] + c["summed"] + c["completed"] + c["blocks"] < 0.5 * c["full"]


def test_tokens_are_made_once(spark, folder):
    """No Python and no tokenising in a filter that Spark infers from explode."""
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    plan = index.token_table(texts, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("+- ArrowEvalPython") == 1
    assert not [line for line in plan.split("\n") if "Filter" in line and "regexp" in line]
    plan = retrieval.bm25_top5(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "documents.parquet" not in plan  # tokens were stored


def test_composed_texts_pass_python(spark):
    texts = ["plain", "é", "é", "Việt", "Việt", "Å", "漢", None, ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.composed(F.col("t"))).collect()
    assert [r[0] for r in got] == ["plain", "é", "é", "Việt", "Việt", "Å", "漢", None, ""]


def test_pivots_on_clusters(spark):
    """Twenty clusters: under 30 % of the pairs are scored, and the rows are those of the scan."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 32))
    data = centres[rng.integers(0, 20, 2000)] + 0.15 * rng.normal(size=(2000, 32))
    d = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(data)] + [(5000, [0.0] * 32, 0), (5001, None, 0), (5002, data[0].tolist(), 0)], "doc_id long, d_vec array<float>, label int")
    q = spark.createDataFrame([(k, (data[k] + 0.05 * rng.normal(size=32)).tolist(), k % 4) for k in range(60)], "item_id long, q_vec array<float>, label int")
    good = d.where("doc_id not in (5000, 5001)")
    best, counts = pivots.nearest(q, d, "item_id", "doc_id")
    want = search.top_k(search.dense_scores(q, good, "item_id", "doc_id"), 5, "item_id", "doc_id")
    assert rows(best.select("item_id", "doc_id", "score", "rank")) == rows(want.select("item_id", "doc_id", "score", "rank"))
    c = counts.first()
    assert c["full"] == 60 * 2001 and c["first"] + c["met"] < 0.3 * c["full"]
    best, _ = pivots.nearest(q, d, "item_id", "doc_id", k=2, by=("label",))
    met = search.dense_scores(q, good, "item_id", "doc_id").join(q.select("item_id", "label"), "item_id").join(d.select("doc_id", F.col("label").alias("l")), "doc_id").where("label = l")
    assert rows(best.select("item_id", "doc_id", "score", "rank")) == rows(search.top_k(met, 2, "item_id", "doc_id").select("item_id", "doc_id", "score", "rank"))
    assert pivots.nearest(q, d.limit(0), "item_id", "doc_id")[0].count() == 0 and pivots.nearest(q.limit(0), d, "item_id", "doc_id")[0].count() == 0


def test_best_overlap_against_every_pair(spark):
    rng = random.Random(6)
    words = [f"w{min(int(rng.expovariate(0.08)), 60)}" for _ in range(4000)]
    chunks = [(f"d{k % 4}", f"c{k:03d}", k, " ".join(rng.sample(words, rng.randint(3, 40)))) for k in range(240)] + [("d0", "empty", 999, None)]
    asked = [(k, 0, f"d{k % 5}", " ".join(rng.sample(words, rng.randint(1, 25))) if k % 9 else None) for k in range(80)]
    a, c = spark.createDataFrame(asked, "question_id long, group_no int, document_id string, ground_truth string"), spark.createDataFrame(chunks, "document_id string, chunk_id string, seq long, text string")
    for least in (0.2, 0.45, 0.9):
        got = {r.question_id: (r.chunk_id, round(r.score, 9)) for r in citations.best_overlap(a, c, ["question_id", "group_no"], least).collect()}
        want = {}
        for q, _, d, t in asked:
            gt = set((t or "").split())
            all_of = [(-len(gt & set((x or "").split())) / len(gt), s, i) for e, i, s, x in chunks if e == d] if gt else []
            if all_of and -min(all_of)[0] >= least:
                want[q] = (min(all_of)[2], round(-min(all_of)[0], 9))
        assert got == want
    assert Counter(x[0] for x in got.values())
