"""Exact top k of a batch of queries over windows of words, several chunkings at once, where no window is a row or a text of its own.

Each text is cut into tokens once, to a row with the words that hold a term of any query. Which windows a word lies in is arithmetic, and so are
their number, their lengths and the document frequencies of terms. A task then looks only at windows that can still be among the k best: those with a term
that matters, as all others of a query together could not reach its k-th best score so far (MaxScore). What is left is scored in full, as `scan` does.

The queries' side goes to every task, up to scan.LIMIT rows of terms; more of them, and texts that share a key, take windows that are rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.places import Places, spans
from ..sources.stored import spread, stored
from . import chunking, index, scan, search

#: Known tokens that are looked at together: few at first, as scores that others must reach come from them.
FIRST, RUN = 1 << 13, 1 << 16
#: The part of a query's k-th best score that the terms left for later may add at most (below 1): less of it leaves fewer windows to score, and more terms to meet.
SHARE = 0.5
#: Of a text the number of words, the places of its known tokens and the words that hold them, and the words of no token or several and how many those have.
_COLUMNS = ("words", "terms", "at", "odd", "sizes")
#: Places of counts that are not those of a term.
_WINDOWS, _LENGTH = -1, -2


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values.astype(np.int32)))


def _placed(batches: Iterator[pa.RecordBatch], known: Places) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, end, f in known.find(b.column(1).to_pylist()):
            have = np.flatnonzero(f.place >= 0)
            have = have[np.lexsort((f.place[have], f.text[have]))]
            own = np.cumsum(np.bincount(f.text[have], minlength=end - first))
            odd = np.flatnonzero(f.sizes != 1)
            last = np.cumsum(f.words)
            text = np.searchsorted(last, odd, side="right")
            odds = np.cumsum(np.bincount(text, minlength=end - first))
            columns = [b.column(0).slice(first, end - first), pa.array(f.words.astype(np.int32)), _lists(own, f.place[have]), _lists(own, f.word[have]), _lists(odds, odd - (last - f.words)[text]), _lists(odds, f.sizes[odd])]
            yield pa.RecordBatch.from_arrays(columns, names=[b.schema.names[0], *_COLUMNS])


class _Texts:
    """Some rows of the table as arrays: of each known token its text, term and word, by text and term; of each text its words, and the tokens before each word."""

    def __init__(self, b: pa.RecordBatch) -> None:
        length = lambda x: pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        _, words, terms, at, odd, sizes = b.columns
        self.words = words.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text, self.place, self.word = np.repeat(np.arange(len(b)), length(terms)), flat(terms), flat(at)
        self.base = np.cumsum(self.words) - self.words
        tokens = np.ones(self.words.sum(), np.int64)
        tokens[np.repeat(self.base, length(odd)) + flat(odd)] = flat(sizes)
        self.before = np.r_[0, np.cumsum(tokens)]


class _Cut:
    """The windows of some texts, numbered through: each has size words, step further on than the one before; the one that reaches the end is the last."""

    def __init__(self, texts: _Texts, size: int, step: int) -> None:
        self.texts, self.size, self.step = texts, size, step
        self.count = np.where(texts.words > 0, 1 + np.maximum(0, -((size - texts.words) // step)), 0)
        self.end = np.cumsum(self.count)

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last window, counted in its text, in which each token lies."""
        word = self.texts.word[tokens]
        return np.maximum(0, -((self.size - 1 - word) // self.step)), np.minimum(word // self.step, self.count[self.texts.text[tokens]] - 1)

    def bounds(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each window its text, place in it, first word and end."""
        text = np.searchsorted(self.end, windows, side="right")
        place = windows - (self.end - self.count)[text]
        return text, place, place * self.step, np.minimum(place * self.step + self.size, self.texts.words[text])

    def lengths(self, text: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        base, before = self.texts.base[text], self.texts.before
        return before[base + end] - before[base + first]


def _counts(batches: Iterator[pa.RecordBatch], shapes: list[tuple[int, int]], terms: int) -> Iterator[pa.RecordBatch]:
    """(corpus, place, n): windows that hold each term, and under _WINDOWS and _LENGTH their number and the sum of their lengths."""
    found, whole = np.zeros((len(shapes), terms), np.int64), np.zeros((len(shapes), 2), np.int64)
    for t in (_Texts(part) for b in batches for part in _runs(b, RUN)):
        again = np.r_[False, (t.text[1:] == t.text[:-1]) & (t.place[1:] == t.place[:-1])] if len(t.text) else np.zeros(0, bool)
        for c, shape in enumerate(shapes):
            cut = _Cut(t, *shape)
            first, last = cut.of(np.arange(len(t.text)))
            seen = np.where(again, np.r_[-1, last[:-1]] if len(last) else last, -1)
            found[c] += np.bincount(t.place, last - np.maximum(first, seen + 1) + 1, minlength=terms).astype(np.int64)
            text, _, start, end = cut.bounds(np.arange(cut.count.sum()))
            whole[c] += len(text), cut.lengths(text, start, end).sum()
    for c in range(len(shapes)):
        at = np.flatnonzero(found[c])
        places, n = np.r_[_WINDOWS, _LENGTH, at], np.r_[whole[c], found[c, at]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c, np.int32)), pa.array(places.astype(np.int32)), pa.array(n)], names=["corpus", "place", "n"])


def _cuts(cost: np.ndarray, windows: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """(first, end) of runs that cost about scan.CELLS together; none parts the rows of a window."""
    run = np.cumsum(cost)
    cuts = np.searchsorted(run, np.arange(scan.CELLS, run[-1], scan.CELLS)) if len(run) else np.zeros(0, np.int64)
    cuts = cuts if windows is None else np.searchsorted(windows, windows[cuts])
    cuts = np.unique(np.r_[0, cuts, len(cost)])
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


class _Corpus:
    """The queries' terms against the windows of one chunking, and the best so far."""

    def __init__(self, shape: tuple[int, int], number: np.ndarray, place: np.ndarray, weight: np.ndarray, idf: np.ndarray, avgdl: float) -> None:
        order = np.lexsort((weight * idf[place], number))  # by query, what matters least first
        self.shape, self.idf, self.avgdl = shape, idf, avgdl
        self.number, self.place, self.weight = number[order], place[order], weight[order]
        most = self.weight * idf[self.place] * (index.K1 + 1.0)
        run = np.cumsum(most)
        start = np.flatnonzero(np.r_[True, self.number[1:] != self.number[:-1]]) if len(run) else np.zeros(0, np.int64)
        self.most = run - np.repeat((run - most)[start], np.diff(np.r_[start, len(run)]))

    def weights(self, place: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return self.idf[place] * (tf * (index.K1 + 1.0)) / (tf + index.K1 * (1.0 - index.B + index.B * dl / self.avgdl))

    def candidates(self, texts: _Texts, best: scan.Best, n: int) -> Iterator[tuple[_Cut, np.ndarray, np.ndarray, np.ndarray]]:
        """(cut, windows, queries, scores) of the pairs that may be among the best, about scan.CELLS sums at a time."""
        bar = np.maximum(best.least, 0.0) * (1 - 1e-9) - 1e-6
        matters = self.most >= SHARE * bar[self.number]
        rest, late = np.zeros(n), np.flatnonzero(~matters)
        np.maximum.at(rest, self.number[late], self.most[late])
        late_start = np.searchsorted(self.number[late], np.arange(n + 1))
        early = np.flatnonzero(matters)
        early = early[np.argsort(self.place[early], kind="stable")]
        start = np.searchsorted(self.place[early], np.arange(len(self.idf) + 1))
        times = np.diff(start)
        cut = _Cut(texts, *self.shape)
        tokens = np.flatnonzero(times[texts.place] > 0)
        first, last = cut.of(tokens)
        every = last - first + 1
        windows = spans((cut.end - cut.count)[texts.text[tokens]] + first, every)
        pairs, tf = np.unique(windows * len(self.idf) + np.repeat(texts.place[tokens], every), return_counts=True)
        windows, place = pairs // max(1, len(self.idf)), pairs % max(1, len(self.idf))
        text, _, begin, end = cut.bounds(windows)
        w = self.weights(place, tf, cut.lengths(text, begin, end))
        for a, b in _cuts(times[place], windows):
            t = times[place[a:b]]
            row = early[spans(start[place[a:b]], t)]
            cell, at = np.unique(np.repeat(windows[a:b], t) * n + self.number[row], return_inverse=True)
            s = np.bincount(at, self.weight[row] * np.repeat(w[a:b], t), minlength=len(cell))
            near = s + rest[cell % n] >= bar[cell % n]
            cell, s = cell[near], s[near]
            found, q = cell // n, cell % n
            t = np.diff(late_start)[q]
            for x, y in _cuts(t):
                more = self._late(cut, found[x:y], late[spans(late_start[q[x:y]], t[x:y])], t[x:y])
                yield cut, found[x:y], q[x:y], s[x:y] + more

    def _late(self, cut: _Cut, windows: np.ndarray, row: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The sums of the rows, times[i] of them for the i-th window: each term is counted between the window's first word and end."""
        t = cut.texts
        terms, width = np.int64(max(1, len(self.idf))), np.int64(t.words.max(initial=0) + 1)
        own = np.repeat(np.arange(len(windows)), times)
        text, _, begin, end = cut.bounds(windows)
        dl = cut.lengths(text, begin, end)
        sorted_at = (t.text * terms + t.place) * width + t.word
        at = (text[own] * terms + self.place[row]) * width
        tf = np.searchsorted(sorted_at, at + end[own]) - np.searchsorted(sorted_at, at + begin[own])
        have = np.flatnonzero(tf)
        own, row = own[have], row[have]
        return np.bincount(own, self.weight[row] * self.weights(self.place[row], tf[have], dl[own]), minlength=len(windows))


def _runs(b: pa.RecordBatch, seen: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of as many known tokens as were seen before, between FIRST and RUN, or one text."""
    size = np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
    a, done = 0, 0
    while a < len(b):
        end = max(a + 1, int(np.searchsorted(size, done + min(RUN, max(FIRST, seen + done)), side="right")))
        yield b.slice(a, end - a)
        a, done = end, int(size[end - 1])


def _best(batches: Iterator[pa.RecordBatch], corpora: dict[tuple, _Corpus], ids: pa.Table, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    best = {c: scan.Best(k, len(ids)) for c in corpora}
    seen = 0
    for b in batches:
        for part in _runs(b, seen):
            texts = _Texts(part)
            seen += len(texts.text)
            key = part.column(0)
            names = pc.fill_null(pc.cast(key, pa.string()), "null")
            for c, corpus in corpora.items():
                for cut, windows, q, s in corpus.candidates(texts, best[c], len(ids)):
                    good = best[c].among(q, s)
                    text, place, _, _ = cut.bounds(windows[good])
                    chunk = pc.binary_join_element_wise(names.take(pa.array(text)), pc.cast(pa.array(place), pa.string()), "_")
                    best[c].put(q[good], s[good], pa.Table.from_arrays([chunk, key.take(pa.array(text))], ["chunk_id", "document_id"]))
                best[c].shrink()
    for c, own in best.items():
        yield from scan._emit(own, ids, schema, c)


def top_windows(docs: DataFrame, key: str, sizes: dict[str, tuple[int, int]], queries: DataFrame, query: str, k: int = search.TOP_K, text: str = "text", by: str = "config_id") -> tuple[DataFrame, DataFrame]:
    """(by, query, chunk_id, document_id, score, rank) and the distinct corpora (by): `scan.sparse_corpora` of `chunking.chunk_fixed_all`, where sizes has the
    (size, overlap) of each corpus, document_id is key and chunk_id key, '_' and the window's number. Texts are read when this is called."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("document_id"), F.col(text).alias("text"))

    def chunks(d: DataFrame) -> DataFrame:
        name = F.concat_ws("_", F.coalesce(F.col("document_id").cast("string"), F.lit("null")), "chunk_index")
        return chunking.chunk_fixed_all(d, "document_id", sizes).select(F.col("strategy").alias(by), name.alias("chunk_id"), "document_id", "text")

    asked = scan.asked_terms(queries, query)
    same = F.xxhash64("document_id")
    several = stored(docs.groupBy(same.alias("_h")).agg(F.count("*").alias("n")).where("n > 1").select("_h"), "several")
    shared = several.count() > 0
    once = docs.withColumn("_h", same).join(several, "_h", "left_anti").drop("_h") if shared else docs
    twice = chunks(docs.withColumn("_h", same).join(several, "_h", "left_semi")) if shared else None
    if asked.count() > scan.LIMIT // len(sizes):
        return scan.sparse_corpora(chunks(docs), "chunk_id", queries, query, k, by=(by,), carry=("document_id",))
    rows = asked.toArrow()
    ids, number, terms, place = scan.numbered(rows, [query])
    out = StructType([docs.schema["document_id"], *(StructField(c, IntegerType() if c == "words" else ArrayType(IntegerType())) for c in _COLUMNS)])
    table = stored(spread(once).mapInArrow(partial(_placed, known=Places(terms.to_pylist())), out), "places")
    shapes = [(size, max(size - overlap, 1)) for size, overlap in sizes.values()]
    totals = table.mapInArrow(partial(_counts, shapes=shapes, terms=len(terms)), "corpus int, place int, n long").groupBy("corpus", "place").agg(F.sum("n").alias("n")).collect()
    names = list(sizes)
    n, length, df = np.zeros(len(sizes)), np.zeros(len(sizes)), np.zeros((len(sizes), len(terms)))
    for r in totals:
        if r.place >= 0:
            df[r.corpus, r.place] += r.n
        else:
            (n if r.place == _WINDOWS else length)[r.corpus] += r.n
    if shared:
        counted = stored(scan.counted(twice, [by, "chunk_id", "document_id"], terms), "counts")
        for r in counted.groupBy(by).agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect():
            n[names.index(r[by])] += r.n
            length[names.index(r[by])] += r.dl
        flat = scan.shared_counts(counted, [by], "chunk_id")
        for r in flat.groupBy(by, "_i").agg(F.count("*").alias("n")).collect():
            df[names.index(r[by]), r["_i"]] += r.n
    idf = {(c,): (float(length[i] / n[i]), np.where(df[i] > 0, np.log1p((n[i] - df[i] + 0.5) / (df[i] + 0.5)), 0.0)) for i, c in enumerate(names) if n[i]}
    tf = rows["tf"].to_numpy().astype(float)
    corpora = {}
    for c, (avgdl, own) in idf.items():
        have = np.flatnonzero(own[place] > 0)
        corpora[c] = _Corpus(shapes[names.index(c[0])], number[have], place[have], tf[have] * own[place[have]], own, avgdl)
    best_of = StructType([StructField(by, StringType()), asked.schema[query], StructField("chunk_id", StringType()), docs.schema["document_id"], StructField("score", DoubleType())])
    found = table.mapInArrow(partial(_best, corpora=corpora, ids=ids, k=k, schema=to_arrow_schema(best_of)), best_of)
    if shared:
        scored = scan.shared_scores(flat, asked, terms, idf, query, [StructField(by, StringType())], "chunk_id")
        of = counted.select(by, "chunk_id", "document_id").distinct()
        found = found.unionByName(scored.join(of, [by, "chunk_id"]).select(*best_of.names))
    return search.top_k(found, k, [by, query], "chunk_id"), spark.createDataFrame([c for c in idf], StructType([StructField(by, StringType())]))
