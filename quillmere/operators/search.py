"""Retrieval: sparse, dense and hybrid search for a batch of queries, rerank parsing, semantic cache.

Scores are rounded to six decimals before ranking and ties go to the smaller id, so results do not
depend on the order of sums. Top-k is a filter on row_number, which Spark turns into a group limit
before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
#: Queries that are sent to every block of documents at a time.
QUERY_BLOCK = 10_000
TOP_K, PREFETCH, PREFETCH_PRODUCTION, RERANK_POOL, CACHE_HIT = 5, 20, 40, 10, 0.97
MODES = ("dense", "sparse", "hybrid_rrf", "hybrid_dbsf")


def top_k(scored: DataFrame, k: int | Column, query: str | list[str], doc: str) -> DataFrame:
    """The k best of each query with rank from 1; query may be several columns, such as a corpus and a question."""
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(doc))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_scores(queries: DataFrame, documents: DataFrame, query: str, doc: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Dot products of sparse vectors (by..., query, term, weight) and (by..., doc, term, weight) that share a term, and the corpus in by."""
    q = queries.select(*by, query, "term", F.col("weight").alias("_qw"))
    met = q.join(documents, [*by, "term"]).groupBy(*by, query, doc)
    return met.agg(F.round(F.sum(F.col("_qw") * F.col("weight")), 6).alias("score"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_scores(queries: DataFrame, documents: DataFrame, query: str, doc: str, q_vec: str = "q_vec", d_vec: str = "d_vec") -> DataFrame:
    """Cosine of each query with each document: an exact scan of a stated query set against all
    documents. The queries go to every block of documents, at most QUERY_BLOCK of them at a time; a
    vector's norm is taken once, for the scan and not for each pair."""
    norm = lambda v: F.sqrt(_dot(v, v))
    q = queries.select(query, F.col(q_vec).alias("_q"), norm(F.col(q_vec)).alias("_qn"))
    d = documents.select(doc, F.col(d_vec).alias("_d"), norm(F.col(d_vec)).alias("_dn"))
    n = queries.count()
    blocks = [q] if n <= QUERY_BLOCK else [q.where(F.pmod(F.xxhash64(query), F.lit(-(-n // QUERY_BLOCK))) == k) for k in range(-(-n // QUERY_BLOCK))]
    met = [d.join(F.broadcast(b)).select(query, doc, F.round(_dot(F.col("_q"), F.col("_d")) / (F.col("_qn") * F.col("_dn")), 6).alias("score")) for b in blocks]
    return reduce(DataFrame.unionByName, met)


def rrf(branches: list[DataFrame], query: str, doc: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked branches: sum of 1 / (k + rank)."""
    parts = [b.select(query, doc, (F.lit(1.0) / (F.col("rank") + k)).alias("s")) for b in branches]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(query, doc).agg(F.round(F.sum("s"), 6).alias("score"))


def dbsf(branches: list[DataFrame], query: str, doc: str) -> DataFrame:
    """Distribution-based fusion: each branch's scores scaled by mean and three sample deviations, not
    clamped, then summed; a branch of one row, or of equal scores, gives 0.5."""
    w = Window.partitionBy(query)
    parts = []
    for b in branches:
        m, s = F.avg("score").over(w), F.stddev_samp("score").over(w)
        scaled = F.when(s > 0, (F.col("score") - (m - 3 * s)) / (6 * s)).otherwise(0.5)
        parts.append(b.select(query, doc, scaled.alias("s")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(query, doc).agg(F.round(F.sum("s"), 6).alias("score"))


def retrieve(mode: str, query: str, doc: str, dense: DataFrame | None = None, sparse: DataFrame | None = None, limit: int = TOP_K, prefetch: int = PREFETCH, fetch_limit: int | None = None) -> DataFrame:
    """Chooses a sub-plan by mode from the score tables of the branches; fetch_limit 0 or None means limit."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    need = {"dense": [dense], "sparse": [sparse]}.get(mode, [dense, sparse])
    if any(x is None for x in need):
        raise ValueError(f"mode {mode!r} lacks a vector branch")
    cut = fetch_limit or limit
    if len(need) == 1:
        return top_k(need[0], cut, query, doc)
    ranked = [top_k(x, prefetch, query, doc) for x in need]
    return top_k((rrf if mode == "hybrid_rrf" else dbsf)(ranked, query, doc), cut, query, doc)


def listwise_order(answer: Column, ids: Column) -> Column:
    """The order of ids that a reranker's text names: 1-based numbers, invalid and repeated ones
    ignored, what it leaves out appended in order. Null or empty text keeps the order."""
    n = F.size(ids)
    named = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\d{1,9}"), F.lit(0)), lambda x: x.cast("int"))
    valid = F.array_distinct(F.filter(named, lambda x: (x >= 1) & (x <= n)))
    everything = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array_union(valid, everything), lambda i: F.get(ids, i - 1))


def cache_lookup(queries: DataFrame, cache: DataFrame, query: str, entry: str, least: float = CACHE_HIT) -> DataFrame:
    """Nearest cached answer of the same prompt version for each query (query, prompt_version, q_vec);
    hit where the cosine reaches least. Vectors of another length are a miss."""
    from .scan import alike_top_k  # it ranks by top_k

    best = alike_top_k(queries, cache, query, entry, "prompt_version", 1)
    return queries.select(query).join(best.drop("rank"), query, "left").withColumn("hit", F.coalesce(F.col("score") >= least, F.lit(False)))


def cache_store(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with entries put in by vector and prompt version; a new entry replaces an equal one, and
    of several new ones that with the greatest JSON stays."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
    key = F.sha2(F.concat_ws(",", F.transform("d_vec", lambda x: x.cast("string"))), 256)
    w = Window.partitionBy(key, "prompt_version").orderBy(F.col("_new").desc(), F.to_json(F.struct(*cache.columns)).desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")
