"""Exact nearest vectors by cosine without meeting every pair: pivot blocks and the triangle inequality of angles.

Each document lies in the block of the pivot nearest to it; a block is known by the least and largest angle between its
documents and the pivot. Angles between vectors are a metric, so a query at angle a from the pivot is at least
max(a - largest, least - a) from every document of the block. A first pass scores the nearest blocks
that hold k documents; the k-th score is a threshold. Blocks that cannot reach it are not
met at all, and in the others documents whose own angle to the pivot rules them out are not scored.

How much is skipped depends on the vectors: clustered ones skip most pairs; uniformly random ones of many dimensions, whose
angles are all near 90 degrees, skip next to nothing whatever the pivots. Results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import stored
from .search import TOP_K, _dot, top_k

PIVOTS = 64
#: Angles are compared with this slack, far above their rounding and that of scores.
_SLACK = 1e-5


def _angles(pivots: np.ndarray, nearest: bool):
    """An Arrow function of vectors: (pivot, angle) of the nearest pivot, or the angles to all."""
    unit = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
            flat = flat if len(vectors) else np.zeros((0, unit.shape[1]))
            angle = np.arccos(np.clip(flat / np.linalg.norm(flat, axis=1, keepdims=True) @ unit.T, -1, 1))
            if nearest:
                best = angle.argmin(axis=1)
                yield pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(angle[np.arange(len(angle)), best], pa.float64())], ["pivot", "angle"])
            else:
                yield pa.array(angle.tolist(), pa.list_(pa.float64()))

    return F.arrow_udf(run, "pivot int, angle double" if nearest else "array<double>")


def nearest(queries: DataFrame, documents: DataFrame, query: str, doc: str, k: int = TOP_K, by: tuple[str, ...] = (), pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """The k best (query, doc, score, rank) of queries (query, by..., q_vec) and documents (doc, by..., d_vec) that agree in by, as
    `search.dense_scores` and `search.top_k` give them; and one row of counts: all pairs (full), pairs scored by the passes (first, met).

    Vectors that are null or of norm 0 have no cosine and no row; all must be of one width. The pivots, at most so many vectors, are
    documents chosen by a hash of their id; they are the only rows that the driver sees. Jobs run when this is called."""
    norm = lambda v: F.sqrt(_dot(v, v))
    d = documents.select(*by, doc, F.col("d_vec").cast("array<double>").alias("d_vec")).withColumn("dn", norm(F.col("d_vec"))).where("dn > 0")
    q = queries.select(*by, query, F.col("q_vec").cast("array<double>").alias("q_vec")).withColumn("qn", norm(F.col("q_vec"))).where("qn > 0")
    chosen = [r.d_vec for r in d.select("d_vec", F.xxhash64(doc).alias("h"), doc).orderBy("h", doc).limit(pivots).collect()]
    q = q if chosen else q.limit(0)
    centre = np.array(chosen or [[1.0]])
    d = d.withColumn("_p", _angles(centre, True)("d_vec")).select(*by, doc, "d_vec", "dn", F.col("_p.pivot").alias("pivot"), F.col("_p.angle").alias("angle"))
    d = stored(d, "pivot-blocks")
    blocks = stored(d.groupBy(*by, "pivot").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n")), "blocks")
    q = stored(q.withColumn("angles", _angles(centre, False)("q_vec")), "queries")
    far = q.select(*by, query, F.posexplode("angles").alias("pivot", "a")).join(blocks, [*by, "pivot"])
    far = far.withColumn("least", F.greatest(F.lit(0.0), F.col("a") - F.col("hi"), F.col("lo") - F.col("a")))
    before = Window.partitionBy(query).orderBy("a", "pivot").rowsBetween(Window.unboundedPreceding, -1)
    far = stored(far.withColumn("early", F.coalesce(F.sum("n").over(before), F.lit(0)) < k), "query-blocks")

    def scored(pairs: DataFrame, threshold: DataFrame | None) -> DataFrame:
        met = pairs.select(*by, query, "pivot", "a").join(q.select(query, "q_vec", "qn"), query)
        if threshold is not None:
            met = met.join(threshold, query)
        met = met.join(d, [*by, "pivot"])
        if threshold is not None:
            met = met.where(F.abs(F.col("a") - F.col("angle")) <= F.col("within"))
        return met.select(query, doc, F.round(_dot(F.col("q_vec"), F.col("d_vec")) / (F.col("qn") * F.col("dn")), 6).alias("score"))

    first = stored(scored(far.where("early"), None), "first")
    best = top_k(first, k, query, doc).groupBy(query).agg(F.when(F.count("*") == k, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.min("score") - 1e-6)))).otherwise(4.0).alias("within"))
    within = stored(q.select(query).join(best, query, "left").select(query, (F.coalesce("within", F.lit(4.0)) + _SLACK).alias("within")), "threshold")
    rest = far.where("not early").join(within, query).where("least <= within").drop("within")
    met = stored(scored(rest, within), "met")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    counts = far.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("full")).crossJoin(count(first, "first")).crossJoin(count(met, "met"))
    return top_k(first.unionByName(met), k, query, doc), counts
