"""Exact duplicates by an index of live digests behind cuckoo filters.

The digest of a text is the SHA-256 of the text with each run of white space made one space; texts of
one digest are equal. The index is split by digest into units of some UNIT_KEYS live digests. A unit
has a cuckoo filter (four 16-bit fingerprints a bucket, two buckets a digest) and its stored content: for each
live digest the row that stays and the number of rows. A unit's task reads its filter, its content
and the changes. A digest that the filter misses is new and is inserted at once; one that it hits is
verified against the content, and inserted if it was only a fingerprint alike. A digest whose last row is deleted
leaves the filter. Where an insertion finds no place after KICKS moves, the filter is made anew at
double its size from the stored digests; where the index outgrows its units, it is dealt anew over
more of them, from the stored digests too.

Texts are read once and never exchanged: a row is a digest, an id and its place. Rows of equal digest are combined in the map
task, COMBINE rows at a time, so a group of a third of all rows reaches its unit as a few rows. The
verdicts go back by a join on the digest, which AQE splits at hot digests. A state is a table in the shared folder;
every change writes a new one and reads the one before.

Defined cases: a null text counts as empty. A null doc_id comes after all others; rows that repeat a
doc_id and a text come in the order of insertion, then of their place in the stored table, so exactly one row of a group stays. Other columns
are not carried. An empty table gives an empty index. Deleting takes away all rows of the given doc_id and
equal text; rows that the index does not hold are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import prepare, table, written
from .wordhash import mix

UNIT_KEYS, KICKS, COMBINE, SLOTS, LOAD = 4096, 500, 50_000, 4, 0.9
#: Kinds of the rows that a unit's task reads, in this order; it puts out the first two.
FILTER, CONTENT, CHANGE, PROBE = 0, 1, 2, 3


class CuckooFilter:
    """Fingerprints of 64-bit hashes, with deletion; a power of two of buckets."""

    def __init__(self, buckets: int = 64, cells: np.ndarray | None = None) -> None:
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells.reshape(-1, SLOTS).copy()

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets of each hash; either bucket gives the other."""
        mark = np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(len(self.cells) - 1)).astype(np.int64)
        return mark, first, first ^ self.apart(mark)

    def apart(self, mark: np.ndarray) -> np.ndarray:
        return (mix(mark.astype(np.uint64)) & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(h)
        return ((self.cells[a] == mark[:, None]) | (self.cells[b] == mark[:, None])).any(axis=1)

    def _put(self, todo: np.ndarray, at: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Replaces one cell that holds old by new in bucket at, for each of todo; returns those without such a cell.

        Of several for one bucket, one is served in each round."""
        left = []
        while len(todo):
            fits = self.cells[at[todo]] == old[todo][:, None]
            some = fits.any(axis=1)
            left.append(todo[~some])
            todo, fits = todo[some], fits[some]
            _, one = np.unique(at[todo], return_index=True)
            self.cells[at[todo[one]], fits[one].argmax(axis=1)] = new[todo[one]]
            todo = np.delete(todo, one)
        return np.concatenate([*left, todo])

    def insert(self, h: np.ndarray) -> bool:
        """Whether all found a place; if not, the filter must be made anew."""
        mark, a, b = self.places(h)
        none = np.zeros(len(h), np.uint16)
        left = self._put(self._put(np.arange(len(h)), a, none, mark), b, none, mark)
        for k in left.tolist():
            held, at = mark[k], int(b[k])
            for turn in range(KICKS):
                cell = (turn * 7 + at) % SLOTS
                held, self.cells[at, cell] = self.cells[at, cell], held
                at ^= int(self.apart(np.array([held]))[0])
                free = np.flatnonzero(self.cells[at] == 0)
                if len(free):
                    self.cells[at, free[0]] = held
                    break
            else:
                return False
        return True

    def delete(self, h: np.ndarray) -> None:
        """Takes away one fingerprint of each; all must have been inserted."""
        mark, a, b = self.places(h)
        none = np.zeros(len(h), np.uint16)
        self._put(self._put(np.arange(len(h)), a, mark, none), b, mark, none)


def hashes(digests: list[bytes]) -> np.ndarray:
    """The last 64 bits of each digest."""
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4)[:, 3].astype(np.uint64)


class Unit:
    """Filter and content of one unit: digest -> [id, batch, place, rows]."""

    def __init__(self) -> None:
        self.filter, self.content, self.verified, self.resized = CuckooFilter(), {}, 0, 0

    def present(self, digests: list[bytes]) -> list[bool]:
        """Whether each is live: what the filter hits is verified against the content."""
        hit = self.filter.contains(hashes(digests)).tolist()
        self.verified += sum(hit)
        return [h and d in self.content for h, d in zip(hit, digests, strict=True)]

    def resize(self) -> None:
        """Makes the filter anew from the stored digests, at double size until all have a place."""
        stored, buckets = hashes(list(self.content)), len(self.filter.cells)
        while True:
            buckets *= 2
            self.resized += 1
            self.filter = CuckooFilter(buckets)
            if len(stored) <= LOAD * SLOTS * buckets and self.filter.insert(stored):
                return

    def change(self, rows: list[tuple]) -> None:
        """Changes (digest, id, batch, place, rows): adds rows. After a deletion, a negative number of rows stands for
        what is left in all, and a null place for nothing."""
        digests = list(dict.fromkeys(r[0] for r in rows))
        known = dict(zip(digests, self.present(digests), strict=True))
        fresh, gone = [], []
        for d, key, batch, place, n in rows:
            if place is None:  # the digest's last row was deleted
                if known[d]:
                    gone.append(d)
                    del self.content[d]
                    known[d] = False
            elif not known[d]:
                fresh.append(d)
                self.content[d], known[d] = [key, batch, place, abs(n)], True
            elif n < 0:  # what a deletion left
                self.content[d] = [key, batch, place, -n]
            else:
                now = self.content[d]
                first = min((now[0] is None, now[0] if now[0] is not None else 0, *now[1:3]), (key is None, key if key is not None else 0, batch, place))
                self.content[d] = [None if first[0] else first[1], first[2], first[3], now[3] + n]
        if gone:
            self.filter.delete(hashes(gone))
        if fresh and not (len(self.content) <= LOAD * self.filter.cells.size and self.filter.insert(hashes(fresh))):
            self.resize()


def _state(unit: int, u: Unit, kind_of_id: pa.DataType) -> Iterator[pa.RecordBatch]:
    yield _batch([unit], [FILTER], [None], [None], [None], [None], [len(u.content)], [u.filter.cells.tobytes()], kind_of_id)
    items = list(u.content.items())
    for k in range(0, len(items), 10_000):
        d, rows = zip(*items[k : k + 10_000], strict=True)
        n = len(d)
        yield _batch([unit] * n, [CONTENT] * n, list(d), *map(list, zip(*rows, strict=True)), [None] * n, kind_of_id)


def _batch(unit: list, kind: list, digest: list, key: list, batch: list, place: list, n: list, cells: list, kind_of_id: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), kind_of_id, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((unit, kind, digest, key, batch, place, n, cells), kinds, strict=True)], names=["unit", "kind", "digest", "id", "batch", "place", "n", "cells"])


def _unit_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit and kind; one unit at a time is in memory. Probes are answered with the rows that stay,
    and then a unit puts out no state."""
    held, u, probed, kind_of_id = None, None, False, None
    for batch in batches:
        kind_of_id = batch.schema.field("id").type
        edges = pc.add(pc.multiply(batch.column("unit").cast(pa.int64()), 8), batch.column("kind").cast(pa.int64())).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], edges[1:] != edges[:-1]])).tolist() if len(edges) else []
        for i, j in zip(starts, [*starts[1:], len(edges)], strict=True):
            unit, kind = divmod(int(edges[i]), 8)
            if unit != held:
                if held is not None and not probed:
                    yield from _state(held, u, kind_of_id)
                held, u, probed = unit, Unit(), False
            part = batch.slice(i, j - i)
            if kind == FILTER:
                u.filter = CuckooFilter(cells=np.frombuffer(part.column("cells")[0].as_py(), np.uint16))
                continue
            rows = list(zip(*(part.column(c).to_pylist() for c in ("digest", "id", "batch", "place", "n")), strict=True))
            if kind == CONTENT:
                u.content.update((r[0], list(r[1:])) for r in rows)
            elif kind == CHANGE:
                u.change(rows)
            else:
                probed = True
                found = [(r[0], *u.content[r[0]]) for r, yes in zip(rows, u.present([r[0] for r in rows]), strict=True) if yes]
                if found:
                    n = len(found)
                    yield _batch([unit] * n, [PROBE] * n, *map(list, zip(*found, strict=True)), [None] * n, kind_of_id)
    if held is not None and not probed:
        yield from _state(held, u, kind_of_id)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of every COMBINE rows: its first row, and the number of rows."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        order = pc.sort_indices(t, sort_keys=[("digest", "ascending"), ("id", "ascending"), ("batch", "ascending"), ("place", "ascending")])  # nulls come last
        t = t.take(order)
        d = t.column("digest").combine_chunks()
        new = np.concatenate([[True], pc.not_equal(d[1:], d[:-1]).to_numpy(zero_copy_only=False)])
        at = np.flatnonzero(new)
        n = np.add.reduceat(t.column("n").to_numpy(), at)
        t = t.take(pa.array(at))
        return t.set_column(t.schema.get_field_index("n"), "n", pa.array(n, pa.int64())).combine_chunks().to_batches()[0]

    parts, size = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            size += batch.num_rows
        if size >= COMBINE:
            yield flush(parts)
            parts, size = [], 0
    if parts:
        yield flush(parts)


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """The 32 bytes that stand for a text."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """Live digests of the rows inserted so far. ids are of one type, fixed at the first insertion."""

    def __init__(self, spark: SparkSession, unit_keys: int = UNIT_KEYS) -> None:
        prepare(spark)
        self.spark, self.unit_keys, self.units, self.batches = spark, unit_keys, 1, 0
        self.rows: DataFrame | None = None
        self.state: DataFrame | None = None

    def _read(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """The rows (digest, id, batch, place) of docs, stored: texts are read no more."""
        self.batches += 1
        read = docs.select(digest(F.col(text)).alias("digest"), F.col(key).alias("id"), F.lit(self.batches).alias("batch"), F.monotonically_increasing_id().alias("place"))
        return written(read, "digests")

    def _unit(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.units)).cast("int")

    def _tasks(self, rows: DataFrame, kind: int, state: DataFrame | None) -> DataFrame:
        """What the units' tasks put out for rows (digest, id, batch, place, n)."""
        given = rows.select(self._unit().alias("unit"), F.lit(kind).alias("kind"), "digest", "id", "batch", "place", "n", F.lit(None).cast("binary").alias("cells"))
        if state is not None:
            given = state.unionByName(given)
        return given.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(_unit_tasks, given.schema)

    def _combine(self, rows: DataFrame) -> DataFrame:
        counted = rows.select("digest", "id", "batch", "place", F.lit(1).cast("long").alias("n"))
        return counted.mapInArrow(_combined, counted.schema)

    def _grow(self, more: int) -> None:
        """Deals the stored digests anew over more units, where the units would hold too many."""
        live = self.state.where(F.col("kind") == FILTER).agg(F.sum("n")).first()[0] or 0 if self.state is not None else 0
        need = -(-(live + more) // self.unit_keys)
        if need <= self.units or need <= 1:
            return
        self.units = max(need, 2 * self.units)
        if self.state is not None:
            stored = self.state.where(F.col("kind") == CONTENT).select("digest", "id", "batch", "place", "n")
            self.state = written(self._tasks(stored, CHANGE, None), "index")

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Inserts all rows of docs; returns their verdicts, as `verdicts` does."""
        rows = self._read(docs, key, text)
        self._grow(rows.count())
        self.state = written(self._tasks(self._combine(rows), CHANGE, self.state), "index")
        self.rows = rows if self.rows is None else self.rows.unionByName(rows)
        return self._verdicts(rows)

    def delete(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Deletes the rows with the id and an equal text of each row of docs; where the row that stayed goes, the next one stays."""
        if self.rows is None:
            return
        gone = docs.select(digest(F.col(text)).alias("digest"), F.col(key).alias("gone")).distinct()
        same = (self.rows["digest"] == gone["digest"]) & self.rows["id"].eqNullSafe(gone["gone"])
        touched = self.rows.join(gone, same, "left_semi").select("digest").distinct()
        left = written(self.rows.join(gone, same, "left_anti"), "digests")
        remaining = left.join(touched, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "batch", "place")).alias("first"), F.count("*").alias("n"))
        changes = touched.join(remaining, "digest", "left").select("digest", "first.id", "first.batch", "first.place", (-F.col("n")).alias("n"))
        self.state, self.rows = written(self._tasks(changes, CHANGE, self.state), "index"), left

    def lookup(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, keep_id, group_size) of the rows of docs, whether or not they were inserted; null and 0 where no live text is equal."""
        rows = self._read(docs, key, text)
        found = rows.select("digest", F.col("id").alias("doc_id"))
        if self.state is None:
            return found.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size")).withColumn("keep_id", F.when(F.lit(False), F.col("keep_id")))
        live = self._tasks(self._combine(rows), PROBE, self.state).select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size")).distinct()
        return found.join(live, "digest", "left").select("doc_id", "keep_id", F.coalesce("group_size", F.lit(0)).alias("group_size"))

    def _verdicts(self, rows: DataFrame) -> DataFrame:
        live = self.state.where(F.col("kind") == CONTENT).select("digest", F.col("id").alias("keep_id"), F.col("batch").alias("keep_batch"), F.col("place").alias("keep_place"), F.col("n").alias("group_size"))
        kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == F.col("keep_batch")) & (F.col("place") == F.col("keep_place"))
        return rows.join(live, "digest").select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), "digest")

    def verdicts(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, digest) of every live row."""
        if self.rows is None:
            raise ValueError("nothing was inserted")
        return self._verdicts(self.rows)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = DigestIndex(spark).insert(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = r"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM digests
"""
