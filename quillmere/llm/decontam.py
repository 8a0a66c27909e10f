"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Both sides become shingles of SHINGLE words, known by a 64-bit hash. Exact containment asks for all
shingles of a window of ITEM_WINDOW words, so its necessary prefix is one shingle: the rarest, by
counts over all documents. Document shingles meet only those prefixes; the place of the shingle
gives the window's place (positional bound) and the text must hold all of it (length bound). What
is left is verified by comparing the words of the whole window, in the texts that have such places
alone: other texts are not exchanged.

The small side of a join (hashes, prefixes, keys of texts with places) is broadcast while it holds at
most BROADCAST_ROWS rows of a few longs (a count decides). Beyond that the same join is an exchange, and
a bitmap of FILTER_BITS bits of its hashes, broadcast as one row of that size, drops most of the other
rows first.

Defined cases: a null or word-less text has no words and is never hit; a null or word-less item has
no windows; repeated items are reported under each of their ids, and an item without an id hits
words but is not listed. Rows with one doc_id are judged each by its own text. Other columns are not
read. Empty documents give no rows; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fold, let, split_words, table, written

ITEM_WINDOW, SHINGLE = 10, 3
BROADCAST_ROWS, FILTER_BITS = 500_000, 1 << 26
#: Everything that is no word character, after A-Z are folded; and a word of a text that is not folded.
#: The commonest characters come first in a class, and runs are possessive: fewer tests a character, same matches.
GAP = r"[^a-z\x{80}-\x{10FFFF}0-9]++"
WORD = r"[a-z\x{80}-\x{10FFFF}A-Z0-9]++"
_RUNS = "array<struct<place:int,h:bigint>>"


def item_words(text: Column) -> Column:
    return split_words(fold(text), GAP)


def _shingles(words: Column, used: dict[int, Column]) -> Column:
    """Array of (0-based place, hash) of all runs of each size whose condition holds."""

    def of(w: Column, size: int) -> Column:
        one = lambda i: F.struct((i - 1).alias("place"), F.xxhash64(F.lit(size), *(F.get(w, i + (k - 1)) for k in range(size))).alias("h"))
        return F.when(used[size] & (F.size(w) >= size), F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), one)).otherwise(F.array().cast(_RUNS))

    return let(words, lambda w: F.concat(*(of(w, size) for size in used)))


def _bitmap(hashes: DataFrame) -> DataFrame:
    """One row: FILTER_BITS bits as longs, those set that a hash h falls on."""
    size = FILTER_BITS // 64
    on = hashes.select(F.pmod("h", F.lit(size)).cast("long").alias("i"), F.expr("shiftleft(1L, cast(shiftright(h, 40) & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    every = hashes.sparkSession.range(size).join(on, F.col("id") == F.col("i"), "left").select(F.struct("id", F.coalesce("b", F.lit(0)).alias("b")).alias("x"))
    return every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]).alias("bits"))


def _near(rows: DataFrame, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows and side for an equi-join on h: side broadcast if it is small, else rows thinned by its bitmap."""
    if side.count() <= BROADCAST_ROWS:
        return rows, F.broadcast(side)
    bits = written(_bitmap(side.select("h")), "bitmap")
    on = "shiftright(element_at(bits, cast(pmod(h, size(bits)) + 1 as int)), cast(shiftright(h, 40) & 63 as int)) & 1 = 1"
    return rows.crossJoin(F.broadcast(bits)).where(on).drop("bits"), side  # one row


def identified(docs: DataFrame) -> DataFrame:
    """docs with h and g, two hashes that together stand for an id and its text: 128 bits, of seeds that differ by the text itself."""
    return docs.withColumns({"h": F.xxhash64("doc_id", "text"), "g": F.xxhash64("text", "doc_id")})


def _places(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(h, g, start, n, win_id): places in the texts of docs (h, g, text) where a window (win_id, n, win) may be."""
    own = windows.select("win_id", "n", F.explode(_shingles(F.col("win"), {s: F.least("n", F.lit(SHINGLE)) == s for s in sizes})).alias("x"))
    own = written(own.select("win_id", "n", "x.*"), "item-shingles")
    # Flat columns: a struct would be copied for every shingle. An inner explode would make Spark infer a filter that makes all shingles once more.
    runs = docs.select(F.col("h").alias("doc_h"), F.col("g").alias("doc_g"), item_words(F.col("text")).alias("w"))
    runs = runs.select("doc_h", "doc_g", F.size("w").alias("n_words"), F.explode_outer(_shingles(F.col("w"), {s: F.lit(True) for s in sizes})).alias("x")).select("doc_h", "doc_g", "n_words", "x.*")
    seen, known = _near(runs.select("h"), written(own.select("h").distinct(), "item-hashes"))
    counts = written(seen.join(known, "h", "left_semi").groupBy("h").agg(F.count("*").alias("seen")), "rarity")
    rare = Window.partitionBy("win_id").orderBy(F.coalesce("seen", F.lit(0)), "place", "h")
    prefix = own.join(counts, "h", "left").withColumn("_r", F.row_number().over(rare)).where("_r = 1 and seen is not null")
    near, prefix = _near(runs, written(prefix.select("h", F.col("place").alias("at"), "n", "win_id"), "prefixes"))
    met = near.join(prefix, "h").where("place >= at and place - at + n <= n_words")
    return met.select(F.col("doc_h").alias("h"), F.col("doc_g").alias("g"), (F.col("place") - F.col("at")).alias("start"), "n", "win_id").distinct()


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(h, g, start, n, win_id) of the windows (win_id, n, win) that the texts of docs (h, g, text) hold."""
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(SHINGLE)).alias("s")).distinct().collect())
    if not sizes:
        return docs.sparkSession.createDataFrame([], "h long, g long, start int, n int, win_id long")
    places = written(_places(docs, windows, sizes), "places")
    near, keys = _near(docs, written(places.select("h", "g").distinct(), "keys"))
    words = near.join(keys, ["h", "g"], "left_semi").distinct().select("h", "g", item_words(F.col("text")).alias("w"))
    grouped = places.groupBy("h", "g").agg(F.collect_list(F.struct("start", "n", "win_id")).alias("x"))
    part = lambda w, c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["win_id"].alias("win_id"), F.slice(w, c["start"] + 1, c["n"]).alias("win"))
    cut = words.join(grouped, ["h", "g"]).select("h", "g", F.explode(let(F.col("w"), lambda w: F.transform("x", lambda c: part(w, c)))).alias("x"))
    return cut.select("h", "g", "x.*").join(windows.drop("n"), ["win_id", "win"]).select("h", "g", "start", "n", "win_id")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """documents (doc_id, text), benchmark (item_id, text) -> a row per document: doc_id, n_words,
    n_hit, n_items, items_sha256, contaminated, and spans, the hit word ranges (start, end)."""
    docs = identified(docs.select("doc_id", "text"))
    bench = items.select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(ITEM_WINDOW))
    every = bench.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("win"))
    every = written(every.select("item_id", F.xxhash64("win").alias("win_id"), "win").distinct(), "windows")
    hits = written(_hits(docs.select("h", "g", "text"), every.select("win_id", F.size("win").alias("n"), "win").distinct()), "hits")
    end = F.col("start") + F.col("n")
    spans = hits.groupBy("h", "g").agg(F.array_sort(F.collect_set(F.struct("start", end.alias("end")))).alias("spans"))
    named = hits.select("h", "g", "win_id").distinct().join(every.where("item_id is not null").select("win_id", "item_id").distinct(), "win_id")
    ids = named.groupBy("h", "g").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    found = spans.join(ids, ["h", "g"], "left")
    # Only ids and counts of the texts meet their hits.
    out = docs.select("doc_id", "h", "g", (F.size(F.split(F.coalesce("text", F.lit("")), WORD, -1)) - 1).cast("long").alias("n_words")).join(found, ["h", "g"], "left")
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    out = out.select("doc_id", "n_words", F.when(F.col("spans").isNull(), 0).otherwise(covered).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), "spans")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
g AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS s FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, ns WHERE len(ws) >= n)),
o AS MATERIALIZED (SELECT doc_id, p, g.n, item_id FROM g JOIN bw ON g.s = bw.s AND g.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM o) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
