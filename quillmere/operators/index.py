"""Sparse index: BM25 statistics, document and query weights, state round trip.

Terms are strings, not hashed numbers, so no two terms share a document frequency by accident.
Every aggregate is keyed by corpus as well (by default one), so all chunking strategies are one job.
Texts are cut into tokens once, to a token table, from which counts and statistics both come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.stored import spread, stored

K1, B, TERMS = 1.5, 0.75, 1_000_000


def token_table(texts: DataFrame, key: str, text: str = "text", by: tuple[str, ...] = (), wanted: DataFrame | None = None) -> DataFrame:
    """(by..., key, dl, term, tf): a row for each term of each text, and one with a null term for each text, whose
    tf is the number of texts of that key and length. wanted (term) restricts the terms, not the texts.

    The rows come from explode_outer: an inner explode makes Spark infer a filter that tokenises again."""
    t = texts.select(*by, key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    t = t.select(*by, key, F.size("_t").alias("dl"), F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), F.col("_t"))).alias("term"))
    if wanted is not None:
        t = t.join(wanted.select("term", F.lit(True).alias("_asked")), "term", "left").where("term is null or _asked").drop("_asked")
    return t.groupBy(*by, key, "dl", "term").agg(F.count("*").alias("tf"))


def terms_of(table: DataFrame) -> DataFrame:
    return table.where("term is not null")


def stats_of(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n_docs, avgdl) of a token table; texts without terms count."""
    return table.where("term is null").groupBy(*by).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))


def term_counts(texts: DataFrame, key: str, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, dl, term, tf): a row for each term of each text; texts without terms give none."""
    return terms_of(token_table(texts, key, text, by))


def distinct_terms(texts: DataFrame, key: str, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., term): a row for each term of each text, from which document frequencies come, as from terms_of a token table. Only texts that share
    a key are exchanged; a small job finds them when this is called."""
    own = [*by, key]
    several = stored(texts.groupBy(F.xxhash64(*own).alias("_h")).agg(F.count("*").alias("n")).where("n > 1").select("_h"), "several")
    once = texts
    if several.count():
        marked = texts.withColumn("_h", F.xxhash64(*own))
        once = marked.join(several, "_h", "left_anti")
        shared = terms_of(token_table(marked.join(several, "_h", "left_semi"), key, text, by)).select(*by, "term")
    found = once.select(*by, F.explode_outer(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("term")).where("term is not null")
    return found if once is texts else found.unionByName(shared)


def corpus_stats(texts: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n_docs, avgdl); texts without terms count."""
    return texts.groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("avgdl"))


def term_stats(counts: DataFrame, stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., term, df, idf) with idf = ln(1 + (n - df + 0.5) / (df + 0.5))."""
    df = counts.groupBy(*by, "term").agg(F.count("*").alias("df"))
    df = df.join(stats, [*by]) if by else df.crossJoin(F.broadcast(stats))  # one row
    return df.select(*by, "term", "df", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")


def doc_weight(tf: Column, idf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return idf * (tf * (k1 + 1.0)) / (tf + k1 * (F.lit(1.0) - b + F.lit(b) * dl / avgdl))


def postings(counts: DataFrame, terms: DataFrame, key: str, by: tuple[str, ...] = (), k1: float = K1, b: float = B) -> DataFrame:
    """(by..., key, term, weight): the sparse vectors of documents, terms of idf > 0."""
    met = counts.join(terms, [*by, "term"]).where("idf > 0")
    return met.select(*by, key, "term", doc_weight(F.col("tf"), F.col("idf"), F.col("dl"), F.col("avgdl"), k1, b).alias("weight"))


def query_vectors(queries: DataFrame, key: str, terms: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, term, weight) with weight idf * qtf; unseen terms are dropped. The idf stands on both sides of a score.
    The corpora of terms, if several, are all asked."""
    return term_counts(queries, key, text).join(terms, "term").select(*by, key, "term", (F.col("idf") * F.col("tf")).alias("weight"))


def pruned_scores_input(texts: DataFrame, key: str, queries: DataFrame, query: str, text: str = "text", by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(query vectors, document vectors) for a batch of queries without an index at hand: statistics cover
    all texts, but only terms that a query has are counted, weighed and exchanged. The texts are read once, when
    this is called: what is left of them goes to a token table in the shared folder. The queries' terms
    are broadcast while a count finds at most TERMS of them, else they meet the texts' terms by an exchange."""
    asked = stored(term_counts(queries, query, text), "asked")
    wanted = asked.select("term").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= TERMS else wanted
    table = stored(token_table(spread(texts.select(*by, key, text)), key, text, by, wanted), "tokens")
    counts = terms_of(table)
    terms = term_stats(counts, stats_of(table, by), by)
    weighed = asked.join(terms, "term").select(*by, query, "term", (F.col("idf") * F.col("tf")).alias("weight"))
    return weighed, postings(counts, terms, key, by)


class Bm25Index:
    """The three tables of an index; saved and loaded as parquet, never changed in place."""

    def __init__(self, stats: DataFrame, terms: DataFrame, vectors: DataFrame) -> None:
        self.stats, self.terms, self.vectors = stats, terms, vectors

    @classmethod
    def build(cls, texts: DataFrame, key: str, text: str = "text") -> Bm25Index:
        """Reads the texts once, when it is called, to a token table in the shared folder."""
        table = stored(token_table(spread(texts.select(key, text)), key, text), "tokens")
        counts, stats = terms_of(table), stats_of(table)
        terms = term_stats(counts, stats)
        return cls(stats, terms, postings(counts, terms, key))

    def save(self, path: str) -> None:
        for name, df in vars(self).items():
            df.write.mode("errorifexists").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: object, path: str) -> Bm25Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("stats", "terms", "vectors")))
