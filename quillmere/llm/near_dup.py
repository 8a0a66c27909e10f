"""MinHash near-duplicate classes by tensored banding.

Two collections of SIDE half-bands, ROWS MinHashes each, are computed; every table key joins one
half-band of the left with one of the right, so SIDE * SIDE tables need 2 * SIDE * ROWS hash
functions instead of 2 * ROWS * SIDE * SIDE. Texts with equal shingle sets are first folded into
one representative (its smallest doc_id), so groups of copies never enter a table.

Candidates: (1) in each bucket, each member with the bucket's first and with the member before it;
what is confirmed gives first classes; (2) pairs of one bucket whose classes still differ, each made
only in the first table that its two members share. Pairs inside one class are never made: they could
not change the result. Both kinds pass a length bound and a bound on a sketch of 1,024 one-bit
MinHashes, made for bucket members alone (a true link fails it about once in 100,000 times), and every
link is confirmed on the full shingle sets of both texts.

Defined cases: a null or empty text, or one of white space alone, has no shingles, is linked with
nothing and is its own class. A null doc_id keeps its row, with a null class if no other text has
its set. Rows with the same doc_id are each judged by their own text. A text with fewer than SHINGLE
words is one shingle. Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wordhash as wh
from .shared import components, prepare, table, written

SHINGLE, SIDE, ROWS, PERCENT = 5, 16, 3, 75
SKETCH_LONGS = 16
#: Of 1,024 one-bit MinHashes, those that a pair at the least similarity has in common less 4.4 standard deviations.
SKETCH_LEAST = 849
_TABLE = wh.byte_table(101, fold=True)
_SEEDS = wh.mix(np.arange(1, 2 * SIDE * ROWS + 64 * SKETCH_LONGS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_ODD = wh.mix(_SEEDS) | np.uint64(1)
_SETS = "doc_id {}, n_shingles long, sig_a long, sig_b long, halves array<long>"
_BITS = [f"s{k}" for k in range(SKETCH_LONGS)]
_MARKS = "rep {}, " + ", ".join(f"{x} long" for x in _BITS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j in wh.chunks(offsets):
        found = wh.words(data, offsets[i : j + 1], _TABLE)
        win = wh.windows(found.hash, SHINGLE)
        for s, e in zip(found.offset[:-1].tolist(), found.offset[1:].tolist(), strict=True):
            if e - s >= SHINGLE:
                yield np.unique(win[s : e - SHINGLE + 1])
            else:
                yield wh.windows(found.hash[s:e], e - s) if e > s else np.zeros(0, np.uint64)


def _minima(sets: list[np.ndarray], k: slice) -> np.ndarray:
    """MinHashes k of each set, in blocks that stay in the cache."""
    filled = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), len(_SEEDS[k])), np.uint64)
    if filled:
        flat = np.concatenate([sets[i] for i in filled])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in filled])[:-1]])
        for c, (seed, odd) in enumerate(zip(_SEEDS[k], _ODD[k], strict=True)):
            out[filled, c] = np.minimum.reduceat((flat ^ seed) * odd, at)
    return out


def _some_sets(batch: pa.RecordBatch, most: int = 200_000) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch with the shingle sets of their texts, about most shingles at a time."""
    sets_of, row = shingle_sets(*wh.text_buffer(batch.column("text"))), 0
    while row < batch.num_rows:
        sets, total = [], 0
        while row + len(sets) < batch.num_rows and total < most:
            sets.append(next(sets_of))
            total += len(sets[-1])
        yield batch.slice(row, len(sets)), sets
        row += len(sets)


def _hashed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, signature and half-bands of each text's set."""
    for batch in batches:
        for part, sets in _some_sets(batch):
            low = _minima(sets, slice(0, 2 * SIDE * ROWS)).reshape(len(sets), 2 * SIDE, ROWS)
            halves = wh.mix(wh.mix(wh.mix(low[:, :, 0]) + low[:, :, 1]) + low[:, :, 2]).view(np.int64)
            sig = [np.array([np.add.reduce(wh.mix(s + np.uint64(c))) if len(s) else 0 for s in sets], np.uint64).view(np.int64) for c in (7, 77)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * 2 * SIDE, pa.int32()), pa.array(halves.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array([len(s) for s in sets], np.int64)), *map(pa.array, sig), lists], names=[x.split()[0] for x in _SETS.split(", ")])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one-bit MinHashes of each text's set."""
    for batch in batches:
        for part, sets in _some_sets(batch):
            bits = wh.mix(_minima(sets, slice(2 * SIDE * ROWS, None))) & np.uint64(1)
            packed = np.packbits(bits.astype(np.uint8), axis=1).reshape(len(sets), SKETCH_LONGS, 8).copy().view(np.int64)[:, :, 0]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(packed[:, c]) for c in range(SKETCH_LONGS))], names=["rep", *_BITS])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of the SIDE * SIDE table keys of each representative."""
    cell = wh.mix(np.arange(1, SIDE * SIDE + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)).reshape(1, SIDE, SIDE)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            half = part.column("halves").flatten().to_numpy().view(np.uint64).reshape(-1, 2, SIDE)
            key = wh.mix(wh.mix(half[:, 0, :, None] + cell) + half[:, 1, None, :])
            rep = part.column("rep").take(pa.array(np.repeat(np.arange(len(part)), SIDE * SIDE)))
            cells = np.tile(np.arange(SIDE * SIDE, dtype=np.int32), len(part))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(cells), rep], names=["key", "cell", "rep"])


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key has another row; holds one batch and one row."""
    held: pa.RecordBatch | None = None
    held_used = False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        key = batch.column("key").to_numpy()
        same = key[1:] == key[:-1]
        used = np.zeros(len(key), bool)
        used[1:] |= same
        used[:-1] |= same
        used[0] |= held_used
        held, held_used = batch.slice(len(key) - 1), bool(used[-1])
        used[-1] = False
        yield batch.filter(pa.array(used))
    if held is not None and held_used:
        yield held


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [shingle_sets(*wh.text_buffer(batch.column(c))) for c in ("text_a", "text_b")]
        hit = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(*sides, strict=True)):
            both = len(np.intersect1d(a, b, assume_unique=True))
            hit[i] = both and 100 * both >= PERCENT * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(hit)), batch.column("b").filter(pa.array(hit))], names=["u", "v"])


def _alike() -> str:
    """The bounds on length and sketch of a pair a, b."""
    differ = " + ".join(f"bit_count(a.{x} ^ b.{x})" for x in _BITS)
    return f"100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) and {64 * SKETCH_LONGS} - ({differ}) >= {SKETCH_LEAST}"


def _first_table() -> str:
    """Whether no table before this one, in rows and columns of the grid of tables, holds both a and b."""
    apart = "not exists(zip_with(slice(a.halves, {0}, {1}), slice(b.halves, {0}, {1}), (p, q) -> p = q), r -> r)"
    return f"{apart.format('1', f'cast(cell div {SIDE} as int)')} and {apart.format(SIDE + 1, f'cast(cell % {SIDE} as int)')}"


def classes(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, n_shingles, component_id, kept), one row per input row."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    sets = written(docs.mapInArrow(_hashed_sets, _SETS.format(kind)), "sets")
    sig = ["sig_a", "sig_b", "n_shingles"]
    groups = sets.where("n_shingles > 0 and doc_id is not null").groupBy(*sig).agg(F.min(F.struct("doc_id", "halves")).alias("x"))
    groups = written(groups.select(*sig, F.col("x.doc_id").alias("rep"), F.col("n_shingles").alias("n"), "x.halves"), "representatives")
    row = f"key long, cell int, rep {kind}"
    keyed = groups.select("rep", "halves").mapInArrow(_keys, row)
    bucket = written(keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_shared_keys, row), "buckets")
    texts = written(docs.join(bucket.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    marks = written(texts.mapInArrow(_marks, _MARKS.format(kind)).join(groups.select("rep", "n", "halves"), "rep"), "marks")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        both = a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, f"u {kind}, v {kind}")

    order = Window.partitionBy("key").orderBy("rep")
    near = bucket.select("rep", F.first("rep").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("f"), F.lag("rep").over(order).alias("p"))
    pairs = near.where("p is not null").select(F.explode(F.array_distinct(F.array("f", "p"))).alias("x"), F.col("rep").alias("y")).where("x <> y").distinct()
    sized = marks.drop("halves")
    tried = pairs.join(sized.alias("a"), F.col("x") == F.col("a.rep")).join(sized.alias("b"), F.col("y") == F.col("b.rep")).where(_alike())
    tried = written(tried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "first-pairs")
    links = written(confirmed(tried), "links")
    first = components(links)
    labelled = bucket.join(first, bucket["rep"] == first["node"], "left").select("key", "cell", "rep", F.coalesce("root", "rep").alias("c"))
    mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    open_ = labelled.join(mixed, "key", "left_semi")
    side = lambda x: open_.join(marks, "rep").select("key", *(["cell"] if x == "a" else []), F.struct("rep", "n", "halves", *_BITS).alias(x), F.col("c").alias(f"c{x}"))
    a, b = side("a"), side("b")
    met = a.join(b, (a["key"] == b["key"]) & F.expr("ca < cb and " + _alike() + " and " + _first_table()))
    rest = met.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()
    more = confirmed(rest.join(tried, ["a", "b"], "left_anti"))
    last = components(links.unionByName(more))
    named = groups.select(*sig, "rep").join(last, groups["rep"] == last["node"], "left").select(*sig, F.coalesce("root", "rep").alias("class_id"))
    out = sets.select("doc_id", *sig).join(named, sig, "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, hash(x) AS h FROM (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT g.b, r.c FROM r JOIN both_ways g ON g.a = r.d WHERE r.c < g.b),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, documents.doc_id = c AS kept
FROM documents JOIN m ON m.d = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""
