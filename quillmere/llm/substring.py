"""Removal of word sequences that an earlier document has, found by difference-cover anchors.

With the cover COVER modulo PERIOD, any two positions have a common shift below PERIOD that takes
both to cover positions. So two equal windows of WINDOW words always share an aligned anchor, a run
of ANCHOR = WINDOW - PERIOD + 1 words that starts at a cover position in both texts. Only anchors
are exchanged for the whole corpus (3 of 7 positions, 8 bytes each); windows of WINDOW words around
an anchor that two documents have are then compared by 96-bit hashes, and the matches extend over
every word they cover.

Exchanges carry one packed array for each unit of rows and hash bucket, not a row for each anchor. A
unit is what a task has read when it holds UNIT anchors or windows. An anchor or window that several
documents of a unit have is sent once for the unit, so a passage that a third of all documents hold
stays an entry for every unit; the unit's other documents get their verdict at once. The number of
buckets follows the bytes of text without end, so that a bucket holds the anchors of about
BUCKET_TEXT bytes. Texts cross one exchange, by doc_id, which both reads of them share; nothing is
written between.

Defined cases: null or white-space texts have no words and keep the digest of the empty string. A
null doc_id is never smaller or larger than another: its row loses nothing and takes nothing away.
Rows with one doc_id are judged alike, each on its own text. Texts of fewer than WINDOW words stay
whole. The order of rows must be the same if a lost partition is read again, as that of tables is.
Other columns are not read. Empty tables give no rows. Texts are hashed in chunks of a few MB,
or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import prepare, table

WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: Anchors or windows of a unit; texts of a unit (their places have 16 bits); bytes of text behind a bucket.
UNIT, UNIT_TEXTS, BUCKET_TEXT = 1 << 20, 60_000, 128 << 20
_TABLE = wh.byte_table(404, fold=False)
_MANY = 0xFFFF
_PACKED = "bucket int, batch long, ids binary, data binary"
_HIT = "doc_id long, hashes binary"
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8")])
_PAIR = np.dtype([("doc", "<i8"), ("a", "<u8")])
_PLACED = np.dtype([("hash", "<u4"), ("place", "<u2")])
_SHARED = np.dtype([("hash", "<u8"), ("place", "<u2")])
_CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _bits(docs: DataFrame) -> int:
    """Bits of the bucket's number, by the bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(30, max(8, (size // BUCKET_TEXT).bit_length()))


def _anchors(found: wh.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, text, hash) of the anchors of texts that have a window."""
    win, ok = wh.windows(found.hash, ANCHOR), wh.window_starts(found.offset, ANCHOR)
    doc = found.doc()[: len(win)]
    cover = np.isin(np.arange(PERIOD), COVER)
    local = np.arange(len(win)) - found.offset[doc]
    at = np.flatnonzero(ok & cover[local % PERIOD] & (found.counts[doc] >= WINDOW))
    return at, doc[at], win[at]


def _edges(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]]) if len(sorted_) else np.zeros(1, np.int64)


def _parts(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary for each range of values between consecutive edges: first all their first bytes, then
    all their second bytes and so on, so that the exchange's compression finds what they have in common."""
    width = values.dtype.itemsize
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width)
    out = np.concatenate([np.zeros(0, np.uint8), *(flat[a:b].T.reshape(-1) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))])
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(out)])


def _sent(bucket: np.ndarray, batch: np.ndarray, ids: pa.Array | None, data: pa.Array) -> pa.RecordBatch:
    ids = pa.nulls(len(data), pa.binary()) if ids is None else ids
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(batch.astype(np.int64)), ids, data], names=_names(_PACKED))


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each key; the input is sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy()
        edges = _edges(keys)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if held and keys[a] != last:
                yield int(last), pa.concat_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(last), pa.concat_batches(held)


def _values(column: pa.Array, kind: object) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of _parts, and how many each row has."""
    data, offsets = wh.text_buffer(column)
    width = np.dtype(kind).itemsize
    rows = [data[a:b].reshape(width, -1).T for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) if b > a]
    flat = np.concatenate([np.zeros((0, width), np.uint8), *rows])
    return np.ascontiguousarray(flat).view(kind).reshape(-1), np.diff(offsets) // width


def _each_chunk(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, wh.Words]]:
    data, offsets = wh.text_buffer(batch.column("text"))
    for i, j in wh.chunks(offsets):
        yield batch.slice(i, j - i), data, wh.words(data, offsets[i : j + 1], _TABLE)


def _known(full: np.ndarray, bits: int) -> np.ndarray:
    """What an exchange tells of an anchor's hash: its bucket and the 32 bits below. Anchors that only
    look alike in these cost a few windows more, no wrong verdict."""
    return full >> np.uint64(32 - bits)


def _above(bits: int, serial: int) -> np.ndarray:
    """A bucket above the others, one of as many."""
    return np.array([(1 << bits) + (serial + (serial >> 32)) % (1 << bits)])


def _send_anchors(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Anchors by bucket, with the text's place in the unit; the unit's doc_ids, with the anchors it
    shares within itself, travel in a bucket above the others."""
    serial = TaskContext.get().partitionId() << 32
    ids: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    rows = size = 0

    def unit() -> Iterator[pa.RecordBatch]:
        nonlocal serial, rows, size
        doc, known = np.concatenate(docs), _known(np.concatenate(hashes), bits)
        order = np.argsort(known, kind="stable")
        doc, known = doc[order], known[order]
        first = np.ones(len(known), bool)
        first[1:] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
        doc, known = doc[first], known[first]
        edges = _edges(known)
        count = np.diff(edges)
        sent = np.empty(len(count), _PLACED)
        sent["hash"], sent["place"] = known[edges[:-1]] & np.uint64(0xFFFFFFFF), np.where(count > 1, _MANY, doc[edges[:-1]])
        bucket = known[edges[:-1]] >> np.uint64(32)
        cut = _edges(bucket)
        if len(sent):
            yield _sent(bucket[cut[:-1]], np.full(len(cut) - 1, serial), None, _parts(sent, cut))
        many = np.repeat(count > 1, count)
        own = np.empty(int(many.sum()), _SHARED)
        own["hash"], own["place"] = known[many], doc[many]
        every = np.concatenate(ids)
        yield _sent(_above(bits, serial), np.array([serial]), _parts(every, np.array([0, len(every)])), _parts(own, np.array([0, len(own)])))
        serial += 1
        rows = size = 0
        for held in (ids, docs, hashes):
            held.clear()

    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid())
        for part, _, found in _each_chunk(batch):
            if rows and (rows + part.num_rows > _MANY or size > UNIT or rows > UNIT_TEXTS):
                yield from unit()
            _, doc, full = _anchors(found)
            ids.append(part.column("doc_id").to_numpy())
            docs.append(doc + rows)
            hashes.append(full)
            rows, size = rows + part.num_rows, size + len(full)
    if rows:
        yield from unit()


def _meet_anchors(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Sends back to each unit those of its anchors that another text has."""
    for bucket, rows in _groups(batches, "bucket"):
        if bucket >> bits:
            yield rows
            continue
        met, count = _values(rows.column("data"), _PLACED)
        source = np.repeat(np.arange(len(count), dtype=np.int32), count)
        order = np.argsort(met["hash"], kind="stable")
        met, source = met[order], source[order]
        same = met["hash"][1:] == met["hash"][:-1]
        shared = np.zeros(len(met), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared &= met["place"] != _MANY
        met, source = met[shared], source[shared]
        order = np.argsort(source, kind="stable")
        met, source = met[order], source[order]
        if len(met):
            back = np.empty(len(met), _SHARED)
            back["hash"], back["place"] = met["hash"].astype(np.uint64) | np.uint64(bucket << 32), met["place"]
            edges = _edges(source)
            batch = rows.column("batch").to_numpy()[source[edges[:-1]]]
            yield _sent(np.full(len(batch), bucket), batch, None, _parts(back, edges))


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the verdicts of a unit to those of its documents."""
    for _, rows in _groups(batches, "batch"):
        own = rows.filter(rows.column("ids").is_valid())
        ids, _ = _values(own.column("ids"), np.int64)
        back, _ = _values(rows.column("data"), _SHARED)
        back = back[np.argsort(back["place"], kind="stable")]
        edges = _edges(back["place"])
        if len(back):
            yield pa.RecordBatch.from_arrays([pa.array(ids[back["place"][edges[:-1]]]), _plain(back["hash"], edges)], names=_names(_HIT))


def _plain(hashes: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(hashes))])


def _blobs(column: pa.Array) -> list[bytes]:
    return [b"".join(x) if x else b"" for x in column.to_pylist()]


def _second(found: wh.Words) -> np.ndarray:
    return (wh.windows(wh.mix(found.hash + np.uint64(0x5851F42D4C957F2D)), WINDOW) >> np.uint64(32)).astype(np.uint32)


def _send_windows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Packed windows around shared anchors by bucket, each with the unit's smallest doc_id that has
    it; what the unit's other documents lose by it is known at once and travels above the buckets."""
    serial = TaskContext.get().partitionId() << 32
    held: list[np.ndarray] = []
    size = 0

    def unit() -> Iterator[pa.RecordBatch]:
        nonlocal serial, size
        e = np.concatenate(held)
        held.clear()
        size = 0
        e = e[np.lexsort((e["doc"], e["b"], e["a"]))]
        run = np.ones(len(e), bool)
        run[1:] = (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])
        first, rest = e[run], e[~run]
        rest = rest[rest["doc"] > first["doc"][np.cumsum(run) - 1][~run]]
        bucket = first["a"] >> np.uint64(64 - bits)
        cut = _edges(bucket)
        if len(first):
            yield _sent(bucket[cut[:-1]], np.full(len(cut) - 1, serial), None, _parts(first, cut))
        if len(rest):
            yield _sent(_above(bits, serial), np.array([serial]), None, _parts(_pairs(rest), np.array([0, len(rest)])))
        serial += 1

    for batch in batches:
        batch = batch.filter(batch.column("hashes").is_valid())
        for part, _, found in _each_chunk(batch):
            at, doc, full = _anchors(found)
            # An anchor that one text of the chunk shares is shared by every other text that has it.
            hashes = np.unique(np.frombuffer(b"".join(_blobs(part.column("hashes"))), np.uint64))
            hit = np.isin(_known(full, bits), hashes)
            at, doc = at[hit], doc[hit]
            change = np.zeros(len(found.hash) + 1, np.int32)
            np.add.at(change, np.maximum(at - PERIOD + 1, found.offset[doc]), 1)
            np.add.at(change, np.minimum(at + 1, found.offset[doc + 1] - WINDOW + 1), -1)
            spot = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            if len(spot):
                e = np.empty(len(spot), _ENTRY)
                e["a"], e["b"] = wh.windows(found.hash, WINDOW)[spot], _second(found)[spot]
                e["doc"] = part.column("doc_id").to_numpy()[found.doc()[spot]]
                held.append(e)
                size += len(e)
            if size > UNIT:
                yield from unit()
    if held:
        yield from unit()


def _pairs(entries: np.ndarray) -> np.ndarray:
    out = np.empty(len(entries), _PAIR)
    out["doc"], out["a"] = entries["doc"], entries["a"]
    return out


def _meet_windows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Sends back to each unit those of its windows that a document with a smaller doc_id has."""
    for bucket, rows in _groups(batches, "bucket"):
        if bucket >> bits:
            yield rows
            continue
        e, count = _values(rows.column("data"), _ENTRY)
        source = np.repeat(np.arange(len(count), dtype=np.int32), count)
        order = np.lexsort((e["doc"], e["b"], e["a"]))
        e, source = e[order], source[order]
        run = np.ones(len(e), bool)
        run[1:] = (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])
        lost = e["doc"] > e["doc"][run][np.cumsum(run) - 1]
        e, source = e[lost], source[lost]
        order = np.argsort(source, kind="stable")
        e, source = e[order], source[order]
        if len(e):
            edges = _edges(source)
            batch = rows.column("batch").to_numpy()[source[edges[:-1]]]
            yield _sent(np.full(len(batch), bucket), batch, None, _parts(_pairs(e), edges))


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hashes of the windows that it loses), from the verdicts of a unit."""
    for _, rows in _groups(batches, "batch"):
        pairs, _ = _values(rows.column("data"), _PAIR)
        pairs = pairs[np.argsort(pairs["doc"], kind="stable")]
        edges = _edges(pairs["doc"])
        yield pa.RecordBatch.from_arrays([pa.array(pairs["doc"][edges[:-1]]), _plain(pairs["a"], edges)], names=_names(_HIT))


def _joined(data: np.ndarray, found: wh.Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of all texts, each text's joined by one space; and the ends of the texts."""
    first, last = (int(found.start[0]), int(found.end[-1])) if len(found.start) else (0, 0)
    own = data[first:last]
    plain = np.where(wh.SPACE[own], np.uint8(0x20), own)
    s, e, doc = found.start[keep] - first, found.end[keep] - first, found.doc()[keep]
    stop = e + 1
    if len(doc):  # the byte after a word is its space, but not after a text's last
        stop[np.append(np.flatnonzero(doc[1:] != doc[:-1]), len(doc) - 1)] -= 1
    change = np.zeros(len(own) + 2, np.int8)
    change[s] += 1
    change[stop] -= 1
    sizes = np.bincount(doc, weights=stop - s, minlength=len(found.offset) - 1).astype(np.int64)
    return plain[np.cumsum(change[: len(own)], dtype=np.int8) > 0].tobytes(), np.cumsum(sizes)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its words without those under a window that it loses."""
    for batch in batches:
        for part, data, found in _each_chunk(batch):
            win = wh.windows(found.hash, WINDOW)
            keep = np.ones(len(found.hash), bool)
            for k, blob in enumerate(_blobs(part.column("hashes"))):
                s, e = int(found.offset[k]), int(found.offset[k + 1])
                if blob and e - s >= WINDOW:
                    hit = np.flatnonzero(np.isin(win[s : e - WINDOW + 1], np.frombuffer(blob, np.uint64)))
                    change = np.zeros(e - s + 1, np.int32)
                    change[hit] += 1
                    change[hit + WINDOW] -= 1
                    keep[s:e] = np.cumsum(change[:-1]) == 0
            total = np.zeros(len(keep) + 1, np.int64)
            np.cumsum(~keep, out=total[1:])
            removed = np.diff(total[found.offset])
            text, ends = _joined(data, found, keep)
            kept = [text[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
            digests = [hashlib.sha256(t).hexdigest() for t in kept]
            told = [t.decode(errors="replace") if r else None for t, r in zip(kept, removed, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.counts.astype(np.int64)), pa.array(removed), pa.array(digests, pa.string()), pa.array(told, pa.string())], names=_names(_CUT))


def _gathered(df: DataFrame, key: str, how: Callable, schema: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(how, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256, kept_text), one row per
    input row; kept_text is null where nothing was removed."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    if dict(docs.dtypes)["doc_id"] != "bigint":  # an alias would keep the two reads from sharing one exchange
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    bits = _bits(docs)
    told = docs.where("doc_id is not null")

    def by_doc(hits: DataFrame) -> DataFrame:
        """The texts with what was found for their doc_id; both times the same exchange of texts."""
        return told.join(hits.groupBy("doc_id").agg(F.collect_list("hashes").alias("hashes")), "doc_id", "left")

    sent = docs.mapInArrow(partial(_send_anchors, bits=bits), _PACKED)
    met = _gathered(sent, "bucket", partial(_meet_anchors, bits=bits), _PACKED)
    anchors = _gathered(met, "batch", _by_document, _HIT)
    windows = by_doc(anchors).mapInArrow(partial(_send_windows, bits=bits), _PACKED)
    verdicts = _gathered(_gathered(windows, "bucket", partial(_meet_windows, bits=bits), _PACKED), "batch", _lost, _HIT)
    nameless = docs.where("doc_id is null").withColumn("hashes", F.lit(None).cast("array<binary>"))
    return by_doc(verdicts).unionByName(nameless).mapInArrow(_cut, _CUT)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 12], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
f AS MATERIALIZED (SELECT h, min(doc_id) AS d FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM g JOIN f USING (h) WHERE f.d < g.doc_id),
k AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
