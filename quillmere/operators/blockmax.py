"""Exact top-k by sparse vectors without scoring every document: block-max pruning over batches.

1. First pass: each query meets the postings of its rarest terms only; the k-th best of those partial
   scores is a threshold that no document of the true k best is under (weights are positive).
2. Terms whose largest weights, added from the smallest, stay under the threshold are left for later: a
   document with those alone cannot be among the best. All others are summed: partial scores.
3. A document that could still reach the threshold is a candidate. Postings lie in blocks of documents, each with the largest
   weight of its term: the bound of what is left is the sum of those of the candidate's block.
4. Only candidates within that bound meet their left terms, and are ranked.

Scores are compared with a slack above the rounding of scores, so rows and ties equal those of full
scoring. Every step is an equi-join and an aggregate; the queries' side is small and measured by Spark
from its stored table. Jobs run when the function is called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import stored
from .search import TOP_K, top_k

BLOCK_DOCS, FIRST = 64, 0.1
_SLACK = 2e-6


def _reaches(bound: Column, threshold: Column) -> Column:
    return bound * (1 + 1e-9) + _SLACK >= threshold


def _kth(scores: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """(query, threshold): the k-th best score, 0 where there are fewer."""
    best = top_k(scores, k, query, doc)
    return best.groupBy(query).agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("threshold"))


def block_max_top_k(queries: DataFrame, documents: DataFrame, query: str, doc: str, k: int = TOP_K, block_docs: int = BLOCK_DOCS, first: float = FIRST) -> tuple[DataFrame, DataFrame]:
    """The k best (query, doc, score, rank) by dot products of sparse vectors (query, term, weight) and (doc, term, weight > 0), as
    `search.sparse_scores` and `search.top_k` give them; and one row of counts: postings that full scoring meets (full), that the
    passes met (first, summed, completed), block entries read (blocks), candidates.

    Null ids and repeated (doc, term) are not expected. Queries without a known term have no rows."""
    d = stored(documents.select(doc, "term", "weight"), "postings")
    blocks_of = F.pmod(F.xxhash64(doc), F.lit(max(1, d.select(doc).distinct().count() // block_docs)))
    blocks = stored(d.groupBy("term", blocks_of.alias("block")).agg(F.max("weight").alias("top"), F.count("*").alias("n")), "blocks")
    terms = blocks.groupBy("term").agg(F.max("top").alias("top"), F.sum("n").alias("df"))
    q = queries.join(terms, "term").select(query, "term", F.col("weight").alias("qw"), "df", (F.col("weight") * F.col("top")).alias("most"))
    rare, small, each = Window.partitionBy(query).orderBy("df", "term"), Window.partitionBy(query).orderBy("most", "term"), Window.partitionBy(query)
    q = q.withColumn("early", (F.row_number().over(rare) == 1) | (F.sum("df").over(rare) <= first * F.sum("df").over(each))).withColumn("under", F.sum("most").over(small))
    q = stored(q, "query-terms")

    def summed(part: DataFrame) -> DataFrame:
        return part.join(d, "term").groupBy(query, doc).agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))

    threshold = _kth(summed(q.where("early")), query, doc, k)
    q = q.join(threshold, query, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    q = stored(q.withColumn("left", ~_reaches(F.col("under"), F.col("threshold"))), "query-terms")
    partial = stored(summed(q.where("not left")), "partial")
    bound = q.groupBy(query).agg(F.max("threshold").alias("threshold"), F.coalesce(F.sum(F.when(F.col("left"), F.col("most"))), F.lit(0.0)).alias("rest"))
    second = _kth(partial, query, doc, k).withColumnRenamed("threshold", "second")
    bound = bound.join(second, query, "left").select(query, "rest", F.greatest("threshold", F.coalesce("second", F.lit(0.0))).alias("threshold"))
    near = partial.join(bound, query).where(_reaches(F.col("score") + F.col("rest"), F.col("threshold"))).select(query, doc, blocks_of.alias("block"), "score", "threshold")
    near = stored(near, "near")
    alive = near.select(query, "block").distinct()
    rest = q.where("left").join(blocks, "term").join(alive, [query, "block"], "left_semi").groupBy(query, "block").agg(F.sum(F.col("qw") * F.col("top")).alias("rest"), F.count("*").alias("n"))
    rest = stored(rest, "block-bounds")
    met = near.join(rest.drop("n"), [query, "block"], "left").where(_reaches(F.col("score") + F.coalesce("rest", F.lit(0.0)), F.col("threshold"))).select(query, doc, "score")
    met = stored(met, "candidates")
    more = met.select(query, doc).join(q.where("left").select(query, "term", "qw"), query).join(d, [doc, "term"])
    more = stored(more.groupBy(query, doc).agg(F.sum(F.col("qw") * F.col("weight")).alias("more"), F.count("*").alias("n")), "completed")
    scored = met.join(more.drop("n"), [query, doc], "left").select(query, doc, F.round(F.col("score") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))
    count = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    counts = q.agg(count(F.sum("df")).alias("full"), count(F.sum(F.when(F.col("early"), F.col("df")))).alias("first"), count(F.sum(F.when(~F.col("left"), F.col("df")))).alias("summed"))
    counts = counts.crossJoin(more.agg(count(F.sum("n")).alias("completed"))).crossJoin(rest.agg(count(F.sum("n")).alias("blocks"))).crossJoin(met.agg(count(F.count("*")).alias("candidates")))
    return top_k(scored, k, query, doc), counts
