"""Index and retrieval queries: benchmark items against documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blockmax, index, pivots, scan, search
from ..sources.stored import spread, stored
from ..sources.tables import table


def _index(spark: SparkSession, sf: str) -> index.Bm25Index:
    return index.Bm25Index.build(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def _sparse(spark: SparkSession, sf: str, k: int = search.PREFETCH_PRODUCTION) -> DataFrame:
    """Scores of the k best documents of each item, as many as any plan here reads."""
    texts, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text")
    return stored(scan.sparse_top_k(texts, "doc_id", items, "item_id", k).drop("rank"), "sparse")


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """By convention an item's vector is that of vec_id = item_id, a document's that of vec_id = doc_id."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = table(spark, sf, "benchmark").join(v, F.col("item_id") == F.col("vec_id")).select("item_id", F.col("embedding").alias("q_vec"))
    d = table(spark, sf, "documents").join(v, F.col("doc_id") == F.col("vec_id")).select("doc_id", F.col("embedding").alias("d_vec"))
    return q, d


def _dense(spark: SparkSession, sf: str, k: int = search.PREFETCH_PRODUCTION) -> DataFrame:
    return stored(scan.dense_top_k(*_vectors(spark, sf), "item_id", "doc_id", k).drop("rank"), "dense")


def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    return index.corpus_stats(table(spark, sf, "documents")).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_doc_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).vectors.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def bm25_query_weights(spark: SparkSession, sf: str) -> DataFrame:
    ix = _index(spark, sf)
    return index.query_vectors(table(spark, sf, "benchmark"), "item_id", ix.terms.select("term", "idf")).select("item_id", "term", F.round("weight", 6).alias("weight"))


def bm25_top5(spark: SparkSession, sf: str) -> DataFrame:
    return search.retrieve("sparse", "item_id", "doc_id", sparse=_sparse(spark, sf)).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_block_max(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of bm25_top5 without scoring every document that shares a term."""
    texts, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text")
    best, _ = blockmax.block_max_top_k(*index.pruned_scores_input(texts, "doc_id", items, "item_id"), "item_id", "doc_id")
    return best.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_by_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """All corpora of one table in one job: languages stand for chunking strategies."""
    docs = table(spark, sf, "documents").select(F.col("lang").alias("strategy"), "doc_id", "text")
    terms = index.term_stats(index.distinct_terms(spread(docs), "doc_id", by=("strategy",)), index.corpus_stats(docs, by=("strategy",)), by=("strategy",))
    return terms.groupBy("strategy").agg(F.count("*").alias("n_terms"), F.round(F.sum("idf"), 3).alias("sum_idf"), F.max("df").alias("max_df"))


def dense_top5(spark: SparkSession, sf: str) -> DataFrame:
    return search.retrieve("dense", "item_id", "doc_id", dense=_dense(spark, sf)).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def dense_pivots(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of dense_top5, by blocks around pivots."""
    best, _ = pivots.nearest(*_vectors(spark, sf), "item_id", "doc_id")
    return best.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def semantic_cache_pivots(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of semantic_cache, by blocks around pivots within each prompt version."""
    q, c = _cache(spark, sf)
    best, _ = pivots.nearest(q, c, "query_id", "entry_id", k=1, by=("prompt_version",))
    return q.select("query_id").join(best.drop("rank"), "query_id", "left").withColumn("hit", F.coalesce(F.col("score") >= search.CACHE_HIT, F.lit(False)))


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return search.retrieve("hybrid_rrf", "item_id", "doc_id", _dense(spark, sf), _sparse(spark, sf)).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def hybrid_dbsf(spark: SparkSession, sf: str) -> DataFrame:
    out = search.retrieve("hybrid_dbsf", "item_id", "doc_id", _dense(spark, sf), _sparse(spark, sf), prefetch=search.PREFETCH_PRODUCTION)
    return out.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def rerank_order(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in answer ('3, 1, 9, 1') applied to a pool of ten, cut to five."""
    pool = search.retrieve("sparse", "item_id", "doc_id", sparse=_sparse(spark, sf), limit=search.RERANK_POOL)
    ids = pool.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    order = F.slice(search.listwise_order(F.lit("[3, 1, 99, 1]"), F.col("ids")), 1, search.TOP_K)
    return ids.select("item_id", F.concat_ws(",", order.cast("array<string>")).alias("order"))


def _cache(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with an id divisible by 20 are looked up among all; the label stands for the prompt version."""
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("prompt_version"), F.col("embedding").alias("q_vec"))
    c = v.select(F.col("vec_id").alias("entry_id"), F.col("label").alias("prompt_version"), F.col("embedding").alias("d_vec"))
    return q, c


def semantic_cache(spark: SparkSession, sf: str) -> DataFrame:
    return search.cache_lookup(*_cache(spark, sf), "query_id", "entry_id")


_T = r"""
tok AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[\p{L}\p{N}_]+') AS t FROM documents),
cnt AS MATERIALIZED (SELECT doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM tok) GROUP BY doc_id, len(t), term),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM tok),
te AS MATERIALIZED (SELECT term, count(*) AS df, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(avgdl) AS avgdl FROM cnt, st GROUP BY term),
dw AS MATERIALIZED (SELECT doc_id, term, idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS weight FROM cnt JOIN te USING (term)),
qw AS (SELECT item_id, term, idf * count(*) AS weight FROM (SELECT item_id, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+')) AS term FROM benchmark) JOIN te USING (term) GROUP BY item_id, term, idf),
sp AS MATERIALIZED (SELECT item_id, doc_id, round(sum(qw.weight * dw.weight), 6) AS score FROM qw JOIN dw USING (term) GROUP BY ALL),
"""
_D = r"""
de AS MATERIALIZED (SELECT item_id, doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id, documents JOIN embeddings d ON d.vec_id = doc_id),
"""


def _ranked(source: str, name: str) -> str:
    return f"{name} AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM {source})"


_TOP = "SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5"
_SCALED = "SELECT item_id, doc_id, CASE WHEN stddev_samp(score) OVER w > 0 THEN (score - (avg(score) OVER w - 3 * stddev_samp(score) OVER w)) / (6 * stddev_samp(score) OVER w) ELSE 0.5 END AS s FROM {} WHERE rank <= 40 WINDOW w AS (PARTITION BY item_id)"

QUERIES = {
    "bm25_stats": bm25_stats, "bm25_terms": bm25_terms, "bm25_doc_weights": bm25_doc_weights, "bm25_query_weights": bm25_query_weights, "bm25_top5": bm25_top5, "bm25_block_max": bm25_block_max, "bm25_by_strategy": bm25_by_strategy,
    "dense_top5": dense_top5, "dense_pivots": dense_pivots, "semantic_cache_pivots": semantic_cache_pivots, "hybrid_rrf": hybrid_rrf, "hybrid_dbsf": hybrid_dbsf, "rerank_order": rerank_order, "semantic_cache": semantic_cache,
}
SQL = {
    "bm25_stats": f"WITH {_T} x AS (SELECT 1) SELECT n_docs, round(avgdl, 6) AS avgdl FROM st",
    "bm25_terms": f"WITH {_T} x AS (SELECT 1) SELECT term, df, round(idf, 6) AS idf FROM te",
    "bm25_doc_weights": f"WITH {_T} x AS (SELECT 1) SELECT doc_id, term, round(weight, 6) AS weight FROM dw",
    "bm25_query_weights": f"WITH {_T} x AS (SELECT 1) SELECT item_id, term, round(weight, 6) AS weight FROM qw",
    "bm25_top5": f"WITH {_T} {_ranked('sp', 'r')} {_TOP}",
    "bm25_block_max": f"WITH {_T} {_ranked('sp', 'r')} {_TOP}",
    "bm25_by_strategy": r"""WITH tok AS (SELECT lang AS strategy, doc_id, regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[\p{L}\p{N}_]+') AS t FROM documents),
n AS (SELECT strategy, count(*) AS n FROM tok GROUP BY strategy),
d AS (SELECT strategy, term, count(*) AS df FROM (SELECT DISTINCT strategy, doc_id, unnest(t) AS term FROM tok) GROUP BY ALL)
SELECT strategy, count(*) AS n_terms, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5))), 3) AS sum_idf, max(df) AS max_df FROM d JOIN n USING (strategy) GROUP BY strategy""",
    "dense_top5": f"WITH {_D} {_ranked('de', 'r')} {_TOP}",
    "dense_pivots": f"WITH {_D} {_ranked('de', 'r')} {_TOP}",
    "hybrid_rrf": f"WITH {_T} {_D} {_ranked('sp', 'a')}, {_ranked('de', 'b')}, f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (rank + 60)), 6) AS score FROM (SELECT * FROM a WHERE rank <= 20 UNION ALL SELECT * FROM b WHERE rank <= 20) GROUP BY ALL), {_ranked('f', 'r')} {_TOP}",
    "hybrid_dbsf": f"WITH {_T} {_D} {_ranked('sp', 'a')}, {_ranked('de', 'b')}, f AS (SELECT item_id, doc_id, round(sum(s), 6) AS score FROM ({_SCALED.format('a')} UNION ALL {_SCALED.format('b')}) GROUP BY ALL), {_ranked('f', 'r')} {_TOP}",
    "rerank_order": f"WITH {_T} {_ranked('sp', 'r')}, i AS (SELECT item_id, list(doc_id ORDER BY rank) AS ids FROM r WHERE rank <= 10 GROUP BY item_id) SELECT item_id, array_to_string(list_transform(list_filter([3, 1, 2, 4, 5, 6, 7, 8, 9, 10], lambda i: i <= len(ids))[1:5], lambda i: ids[i]), ',') AS \"order\" FROM i",
    "semantic_cache": "WITH m AS (SELECT q.vec_id AS query_id, c.vec_id AS entry_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rk FROM m) SELECT vec_id AS query_id, entry_id, score, coalesce(score >= 0.97, FALSE) AS hit FROM embeddings LEFT JOIN r ON query_id = vec_id AND rk = 1 WHERE vec_id % 20 = 0",
}
SQL["semantic_cache_pivots"] = SQL["semantic_cache"]
