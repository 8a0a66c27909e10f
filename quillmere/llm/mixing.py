"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A token budget flows down from the root by weight; a node never
gets more than its subtree can give (its tokens times EPOCHS), and what it can't take goes to its
siblings by their weights. A node's capacity sums its children's, so a shortage is met among siblings
first and reaches the next ancestor only when the whole subtree is short. Each leaf then reads its
documents in seeded epochs, one random order for each epoch, up to the last document that fits its
budget: whole epochs first, then a prefix of the next.

The prefix takes no sort of a leaf: tokens are summed by leaf and hash bin (BINS a leaf, combined on
the map side), bins below the one where the budget ends are taken whole, and only documents of that
bin, one in BINS of a leaf, are ordered. Budgets are a row for each leaf, in a written table whose
size decides whether Spark broadcasts it.

Defined cases: null language or source is the leaf level '(none)'; levels without a weight get the
default weight. A null text has 0 tokens; documents of 0 tokens before the end of the prefix come
along. Repeated rows are separate documents, ordered by id and text, then by their other columns. Empty
tables give no rows. Extra columns pass through whatever their names; only a column with the name of a
result column (RESULT) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free_prefix, split_words, table, written

LEVELS = ("domain", "language", "origin")
RESULT = (*LEVELS, "n_tokens", "epoch")
SHARE, EPOCHS, BINS, SEED = 0.6, 4, 4096, 17
DEFAULT = 0.05
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"web": 0.5, "reference": 0.3, "forum": 0.2},
    "language": {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1},
    "origin": {},
}
NONE = "(none)"
WORD_GAP = r"[\x20\x09-\x0D]+"


def default_domain(source: Column) -> Column:
    """By the number at the end of a source's name: under 10 web, under 15 reference, else forum; no number: other."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    n = F.when(digits != "", digits).cast("int")
    return F.when(n < 10, "web").when(n < 15, "reference").when(n.isNotNull(), "forum").otherwise("other")


def _weight(level: str, weights: dict) -> Column:
    known = [F.lit(x) for k, w in weights.get(level, {}).items() for x in (k, float(w))]
    return F.coalesce(F.element_at(F.create_map(*known), F.col(level)), F.lit(DEFAULT)) if known else F.lit(1.0)


def allocate(leaves: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: dict | None = None) -> DataFrame:
    """leaves (LEVELS, tokens) -> leaves plus budget, in tokens."""
    weights = WEIGHTS if weights is None else weights
    out = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("double"))
    total = leaves.agg((F.lit(share) * F.coalesce(F.sum("tokens"), F.lit(0))).alias("given"))  # one row
    out = out.crossJoin(F.broadcast(total))
    for depth, level in enumerate(LEVELS):
        parent, node = LEVELS[:depth], LEVELS[: depth + 1]
        nodes = out.groupBy(*node).agg(F.sum("cap").alias("c"), F.first("given").alias("b")).withColumn("w", _weight(level, weights))
        among = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        before = among.orderBy(F.col("c") / F.col("w"), level).rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumn("rest_w", F.sum("w").over(among) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        nodes = nodes.withColumn("rest_b", F.col("b") - F.coalesce(F.sum("c").over(before), F.lit(0.0)))
        nodes = nodes.withColumn("full", F.col("c") * F.col("rest_w") <= F.col("w") * F.col("rest_b"))
        taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(among), F.lit(0.0))
        open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(among)
        nodes = nodes.withColumn("got", F.when(F.col("full"), F.col("c")).otherwise(F.col("w") * (F.col("b") - taken) / open_w))
        out = out.drop("given").join(nodes.select(*node, F.col("got").alias("given")), [*node])
    return out.select(*LEVELS, "tokens", F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))


def _order(epoch: Column, seed: int) -> Column:
    """A random hexadecimal order of documents for each epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))


def mix(docs: DataFrame, domain: Column | None = None, share: float = SHARE, epochs: int = EPOCHS, weights: dict | None = None, seed: int = SEED) -> DataFrame:
    """documents (doc_id, text, lang, source, ...) -> the rows chosen, one for each document and epoch,
    with RESULT: domain, language, origin, n_tokens, epoch (from 0)."""
    domain = default_domain(F.col("source")) if domain is None else domain
    docs = docs.withColumns({
        "domain": domain, "language": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)), "origin": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        "n_tokens": F.size(split_words(F.col("text"), WORD_GAP)).cast("long"),
    }).drop("epoch")
    own = free_prefix(docs)
    names = ("whole", "left", "key", "bin", "end", "over", "last", "base", "run", "tie")
    whole, left, key, bin_, end, over, last_, base, run, tie = (f"{own}_{x}" for x in names)
    leaves = written(docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    budgets = allocate(leaves, share, epochs, weights)
    times = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    plan = written(budgets.withColumn(whole, times).select(*LEVELS, whole, (F.col("budget") - F.col(whole) * F.col("tokens")).alias(left)), "budgets")
    dealt = docs.join(plan, [*LEVELS]).withColumn(key, _order(F.col(whole), seed))
    dealt = dealt.withColumn(bin_, (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % BINS).cast("int"))
    bins = dealt.groupBy(*LEVELS, bin_, left).agg(F.sum("n_tokens").alias("n"))
    up_to = Window.partitionBy(*LEVELS).orderBy(bin_)
    bins = bins.withColumn(end, F.sum("n").over(up_to)).withColumn(over, F.col(end) > F.col(left))
    last = bins.groupBy(*LEVELS).agg(F.min(F.when(F.col(over), F.col(bin_))).alias(last_), F.coalesce(F.max(F.when(~F.col(over), F.col(end))), F.lit(0)).alias(base))
    dealt = dealt.join(written(last, "last-bins"), [*LEVELS])
    kept = docs.columns
    none = F.array().cast("array<bigint>")
    part = F.when(F.col(last_).isNull() | (F.col(bin_) < F.col(last_)), F.array(whole)).otherwise(none)
    full = F.when(F.col(whole) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(whole) - 1)).otherwise(none)
    sure = dealt.withColumn("epoch", F.explode(F.concat(full, part))).select(*kept, F.col("epoch").cast("int").alias("epoch"))
    edge = dealt.where(F.col(bin_) == F.col(last_)).withColumn(tie, F.md5(F.to_json(F.struct(*kept))))
    in_order = Window.partitionBy(*LEVELS).orderBy(key, tie).rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn(run, F.sum("n_tokens").over(in_order)).where(F.col(base) + F.col(run) <= F.col(left))
    return sure.unionByName(edge.select(*kept, F.col(whole).cast("int").alias("epoch")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", *RESULT)


OP3_SQL = r"""
WITH d AS (
  SELECT *, CASE WHEN num < 10 THEN 'web' WHEN num < 15 THEN 'reference' WHEN num IS NOT NULL THEN 'forum' ELSE 'other' END AS domain FROM (
  SELECT doc_id, coalesce(lang, '(none)') AS language, coalesce(source, '(none)') AS origin, md5(coalesce(text, '')) AS m,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_tokens,
    TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1), '') AS INT) AS num FROM documents)),
l AS (SELECT domain, language, origin, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * 4 AS cap FROM d GROUP BY ALL),
a1 AS (SELECT *, 0.6::DOUBLE * (SELECT sum(tokens) FROM l)::DOUBLE AS b, CASE domain WHEN 'web' THEN 0.5 WHEN 'reference' THEN 0.3 WHEN 'forum' THEN 0.2 ELSE 0.05 END::DOUBLE AS w FROM (SELECT domain, sum(cap) AS c FROM l GROUP BY domain)),
b1 AS (SELECT *, c * (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) <= w * (b - coalesce(sum(c) OVER p, 0)) AS f FROM a1 WINDOW p AS (ORDER BY c / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g1 AS (SELECT domain, CASE WHEN f THEN c ELSE w * (b - coalesce(sum(CASE WHEN f THEN c END) OVER (), 0)) / sum(CASE WHEN NOT f THEN w END) OVER () END AS g FROM b1),
a2 AS (SELECT x.*, g AS b, CASE language WHEN 'en' THEN 0.5 WHEN 'fr' THEN 0.2 WHEN 'de' THEN 0.2 WHEN 'es' THEN 0.1 ELSE 0.05 END::DOUBLE AS w FROM (SELECT domain, language, sum(cap) AS c FROM l GROUP BY ALL) x JOIN g1 USING (domain)),
b2 AS (SELECT *, c * (sum(w) OVER q - coalesce(sum(w) OVER p, 0)) <= w * (b - coalesce(sum(c) OVER p, 0)) AS f FROM a2 WINDOW p AS (PARTITION BY domain ORDER BY c / w, language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY domain)),
g2 AS (SELECT domain, language, CASE WHEN f THEN c ELSE w * (b - coalesce(sum(CASE WHEN f THEN c END) OVER q, 0)) / sum(CASE WHEN NOT f THEN w END) OVER q END AS g FROM b2 WINDOW q AS (PARTITION BY domain)),
a3 AS (SELECT l.*, cap AS c, g AS b, 1.0::DOUBLE AS w FROM l JOIN g2 USING (domain, language)),
b3 AS (SELECT *, c * (sum(w) OVER q - coalesce(sum(w) OVER p, 0)) <= w * (b - coalesce(sum(c) OVER p, 0)) AS f FROM a3 WINDOW p AS (PARTITION BY domain, language ORDER BY c / w, origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY domain, language)),
g3 AS (SELECT domain, language, origin, tokens, floor(CASE WHEN f THEN c ELSE w * (b - coalesce(sum(CASE WHEN f THEN c END) OVER q, 0)) / sum(CASE WHEN NOT f THEN w END) OVER q END + 1e-6)::BIGINT AS budget FROM b3 WINDOW q AS (PARTITION BY domain, language)),
k AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM g3),
r AS (SELECT d.*, whole, budget - whole * tokens AS rest, md5('17:' || whole::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '') || ':' || m) AS o FROM d JOIN k USING (domain, language, origin)),
z AS (SELECT *, (('0x' || substr(o, 1, 8))::BIGINT % 4096) AS bin FROM r),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY bin, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM z)
SELECT doc_id, domain, language, origin, n_tokens, e::INT AS epoch FROM (SELECT *, unnest(range(whole)) AS e FROM r)
UNION ALL SELECT doc_id, domain, language, origin, n_tokens, whole::INT FROM u WHERE run <= rest
"""
