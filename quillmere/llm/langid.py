"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

A language is a probability for each piece of the vocabulary. A word's probability is the sum over
all its segmentations into pieces, by a forward pass; a text's is the product over its words. The
pieces' probabilities are fitted by expectation-maximisation (forward and backward passes give the
expected counts) on whole texts of a bounded random sample: about SAMPLE texts a language (the
documented bound), chosen by hash. Counts of texts by language cover all training rows.

Words are runs of letters (ASCII letters and all non-ASCII characters) of any length, lower-cased, with
the vocabulary's word mark before them. The passes run over the distinct words of a chunk of rows in
blocks of like length, hold the last positions that a piece can reach back to, and are rescaled where
their values become small. Languages are taken in blocks of BLOCK, in the fit and in
the prediction: a worker holds one block's probabilities (BLOCK x vocabulary) at a time and each text's
best language and sum so far, so any number of languages is learned; the driver holds the counts
of the pieces that a language's sample has.

fit says how a text compares with the sample texts of its language: its log-probability a code point,
less their median, in robust standard deviations, which are wider for short texts by the square root of
1 + SHORT / code points. A text in a language that was not learned, or of no language, is far below 0. The
sample is cached; a part lost with an executor is read again.

Defined cases: text null or without a letter gives 'und', score 0 and fit null; so do all texts if
nothing can be learned. Empty tables give no rows. A null doc_id is not held out and is not learned from. Ties go to the language first in
order of name. Prediction reads the text alone; repeated ids and other columns change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import prepare, table

VOCABULARY = "piece_bpe_32k.model"
SAMPLE, ROUNDS, CODES, BLOCK, FOLDS = 300, 3, 400_000, 64, 5
UNKNOWN, SMOOTH, SHORT, LEAST_SPREAD = 1e-7, 200.0, 200, 0.1
MARK = "▁"
_TABLE = wh.byte_table(909, fold=True)
_GAPS = np.zeros(256, bool)
_GAPS[:128] = True
_GAPS[65:91] = _GAPS[97:123] = False
_CHAR_MULT = 0xC2B2AE3D27D4EB4F | 1
_CHAR_POWERS = wh.Powers(_CHAR_MULT)
_SLOTS = 18


class Pieces:
    """Vocabulary pieces of letters, found by the hash of their code points."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.model = model
        self.texts = [t for t in (sp.id_to_piece(i) for i in range(sp.get_piece_size())) if (t.lstrip(MARK).isalpha() and t == t.lower() and t.count(MARK) <= 1) or t == MARK]
        self.longest = max(map(len, self.texts))
        self.hash = np.array([self._hash(t) for t in self.texts], np.uint64)
        first, second = self._slots(self.hash)
        self.one, self.two = np.full(1 << _SLOTS, -1, np.int32), np.full(1 << _SLOTS, -1, np.int32)
        self.rest: dict[int, int] = {}
        for k, (a, b) in enumerate(zip(first.tolist(), second.tolist(), strict=True)):
            if self.one[a] < 0:
                self.one[a] = k
            elif self.two[b] < 0:
                self.two[b] = k
            else:
                self.rest[int(self.hash[k])] = k

    @staticmethod
    def _hash(text: str) -> int:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        total = np.uint64(sum(int(c + 1) * pow(_CHAR_MULT, k, 1 << 64) for k, c in enumerate(codes)) & (2**64 - 1))
        return int(wh.mix(np.array([total ^ np.uint64(len(text))], np.uint64))[0])

    @staticmethod
    def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << _SLOTS) - 1)
        return (h & mask).astype(np.int64), (h >> np.uint64(30) & mask).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; len(texts) where there is none."""
        none = len(self.texts)
        first, second = self._slots(h)
        a, b = self.one[first], self.two[second]
        out = np.where((a >= 0) & (self.hash[a] == h), a, np.where((b >= 0) & (self.hash[b] == h), b, none))
        for value, k in self.rest.items():
            out[h == np.uint64(value)] = k
        return out

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Running hashes of the code points of words, a word a row."""
        total = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _CHAR_POWERS.get(codes.shape[1])[0], axis=1, out=total[:, 1:])
        return total

    def ends(self, total: np.ndarray, j: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, piece numbers) of the pieces that end at position j of the words with these sums."""
        down = _CHAR_POWERS.get(j + 1)[1]
        for size in range(1, min(j, self.longest) + 1):
            ids = self.find(wh.mix((total[:, j] - total[:, j - size]) * down[j - size] ^ np.uint64(size)))
            if size == 1 or (ids < len(self.texts)).any():
                yield size, ids


_worker: list[Pieces] = []


def worker_pieces(model: bytes) -> Pieces:
    if not _worker or _worker[0].model != model:
        _worker[:] = [Pieces(model)]
    return _worker[0]


def _gain(p: np.ndarray, size: int, ids: np.ndarray) -> np.ndarray:
    """Probabilities of pieces; p has a row of zeros for no piece, where a single character gets UNKNOWN."""
    gain = p[ids]
    if size == 1:
        gain[ids == len(p) - 1] = UNKNOWN
    return gain


def _rescaled(value: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values with small rows brought up to 1, and the logarithms of what they stand for."""
    top = value.max(axis=1, keepdims=True)
    low = (top < 1e-150) & (top > 0)
    if not low.any():
        return value, log
    scale = np.where(low, top, 1.0)
    return value / scale, log + np.log(scale)


def _add(total: np.ndarray, value: np.ndarray, log: np.ndarray, own: np.ndarray) -> None:
    """Adds value, which stands at scale log, to total, which stands at scale own."""
    total += value if log is own else value * np.exp(log - own)


def _forward(pieces: Pieces, codes: np.ndarray, sizes: np.ndarray, p: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Log-probabilities (word, language) of words, longest first, padded to one length; with keep
    also the (values, logarithm of their scale) of every position."""
    total, out = pieces.sums(codes), np.zeros((len(codes), p.shape[1]))
    held: list = [(np.ones((len(codes), p.shape[1])), np.zeros((len(codes), 1)))]
    for j in range(1, codes.shape[1] + 1):
        n = int(np.searchsorted(-sizes, -j, "right"))  # words that reach position j
        own = held[j - 1][1][:n] if len(held[j - 1][1]) != n else held[j - 1][1]
        new = np.zeros((n, p.shape[1]))
        for size, ids in pieces.ends(total[:n], j):
            value, log = held[j - size]
            same = log is held[j - 1][1]
            _add(new, value[:n] * _gain(p, size, ids), own if same else log[:n], own)
        held.append(_rescaled(new, own))
        done = slice(int(np.searchsorted(-sizes, -j, "left")), n)
        out[done] = np.log(np.maximum(held[j][0][done], 1e-300)) + held[j][1][done]
        if not keep and j > pieces.longest:
            held[j - pieces.longest - 1] = None
    return out, held


def _steps(pieces: Pieces, code: np.ndarray, block: int = 4096) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """For each position of one word, (position, lengths, numbers) of the pieces that end there."""
    total, sizes = pieces.sums(code[None, :])[0], np.arange(1, pieces.longest + 1)
    for low in range(1, len(total), block):
        at = np.arange(low, min(low + block, len(total)))
        begin = at[:, None] - sizes
        inside = np.maximum(begin, 0)
        ids = pieces.find(wh.mix((total[at][:, None] - total[inside]) * _CHAR_POWERS.get(len(total))[1][inside] ^ sizes.astype(np.uint64)).reshape(-1)).reshape(begin.shape)
        used = (begin >= 0) & ((ids < len(pieces.texts)) | (sizes == 1))
        row, col = np.nonzero(used)
        edge = np.searchsorted(row, np.arange(len(at) + 1)).tolist()
        size, piece = (col + 1).tolist(), ids[row, col]
        for k in range(len(at)):
            yield low + k, size[edge[k] : edge[k + 1]], piece[edge[k] : edge[k + 1]]


def _forward_one(pieces: Pieces, code: np.ndarray, p: np.ndarray) -> np.ndarray:
    """_forward for one long word: the last positions in a ring, rescaled by language."""
    n, none = pieces.longest + 1, len(p) - 1
    ring, log = np.zeros((n, p.shape[1])), np.zeros(p.shape[1])
    ring[0] = 1.0
    for j, size, ids in _steps(pieces, code):
        gain = p[ids]
        if ids[0] == none:
            gain[0] = UNKNOWN
        new = (ring[[(j - x) % n for x in size]] * gain).sum(axis=0)
        ring[j % n] = new
        if j % 8 == 0 and new.min() < 1e-100:
            ring /= new
            log += np.log(new)
    return np.log(ring[len(code) % n]) + log


def _counts_one(pieces: Pieces, code: np.ndarray, q: np.ndarray, weight: float, counts: np.ndarray) -> None:
    """Expected counts of pieces in one word of a language with probabilities q: a forward and a
    backward pass, each value kept with the logarithm of its scale."""
    steps = [(size, ids, [float(x) if k < len(q) - 1 else UNKNOWN for k, x in zip(ids.tolist(), q[ids], strict=True)]) for _, size, ids in _steps(pieces, code)]
    value, scale = [1.0], [0.0]
    for j, (size, _, gain) in enumerate(steps, 1):
        own = scale[-1]
        new = sum(value[j - x] * g * (1.0 if scale[j - x] == own else math.exp(scale[j - x] - own)) for x, g in zip(size, gain, strict=True))
        if new < 1e-100:
            new, own = 1.0, own + math.log(new)
        value.append(new)
        scale.append(own)
    n = len(steps)
    back, at = [0.0] * n + [1.0], [0.0] * (n + 1)
    whole = math.log(value[n]) + scale[n]
    for j in range(n, 0, -1):
        size, ids, gain = steps[j - 1]
        if 0 < back[j] < 1e-100:
            back[j], at[j] = 1.0, at[j] + math.log(back[j])
        for x, k, g in zip(size, ids.tolist(), gain, strict=True):
            flow = back[j] * g
            counts[k] += weight * value[j - x] * flow * math.exp(scale[j - x] + at[j] - whole)
            if back[j - x] == 0.0:
                at[j - x] = at[j]
            if at[j - x] == at[j]:
                back[j - x] += flow
            else:
                most = max(at[j - x], at[j])
                back[j - x], at[j - x] = back[j - x] * math.exp(at[j - x] - most) + flow * math.exp(at[j] - most), most


def _log_probability(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log-probabilities (word, language)."""
    out = np.zeros((len(words), p.shape[1]))
    for at, codes, sizes in _blocks(words):
        if _alone(codes):
            for k, i in enumerate(at.tolist()):
                out[i] = _forward_one(pieces, codes[k, : sizes[k]], p)
        else:
            out[at] = _forward(pieces, codes, sizes, p)[0]
    return out


def _expected(pieces: Pieces, words: list[str], p: np.ndarray, lang: int, weight: np.ndarray, counts: np.ndarray) -> None:
    """Adds the expected counts of pieces in words of one language."""
    q = p[:, lang : lang + 1]
    for at, codes, sizes in _blocks(words):
        if _alone(codes):
            for k, i in enumerate(at.tolist()):
                _counts_one(pieces, codes[k, : sizes[k]], q[:, 0], float(weight[i]), counts)
        else:
            _expected_block(pieces, codes, sizes, q, weight[at], counts)


def _alone(codes: np.ndarray) -> bool:
    """Whether a block is so long and of so few words that word by word is quicker; the sums are the same."""
    return len(codes) < 16 and codes.shape[1] > 64


def _expected_block(pieces: Pieces, codes: np.ndarray, sizes: np.ndarray, q: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
    whole, held = _forward(pieces, codes, sizes, q, keep=True)
    total, length = pieces.sums(codes), codes.shape[1]
    back = [(np.zeros((len(codes), 1)), np.zeros((len(codes), 1))) for _ in range(length + 1)]
    for j in range(length, 0, -1):
        n = int(np.searchsorted(-sizes, -j, "right"))
        value, log = back[j]
        value[sizes == j] = 1.0
        value, log = back[j] = _rescaled(value, log)
        for size, ids in pieces.ends(total[:n], j):
            flow = value[:n] * _gain(q, size, ids)
            before, at = held[j - size]
            odds = before[:n] * flow * np.exp(np.minimum(at[:n] + log[:n] - whole[:n], 700))
            np.add.at(counts, ids, odds[:, 0] * weight[:n])
            there, scale = back[j - size]
            # Both are brought to the larger scale, so that neither overflows.
            most = np.where(there[:n] > 0, np.maximum(scale[:n], log[:n]), log[:n])
            there[:n] = there[:n] * np.exp(np.minimum(scale[:n] - most, 0)) + flow * np.exp(log[:n] - most)
            scale[:n] = most


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, code points, lengths) of words of like length, longest first, about CODES code points at a time."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-size, kind="stable")
    k = 0
    while k < len(order):
        longest = int(size[order[k]])
        own = order[k : k + max(1, CODES // longest)]
        own = own[size[own] * 4 >= longest * 3]
        codes = np.zeros((len(own), longest), np.uint32)
        joined = "".join([texts[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass")
        codes[np.arange(longest) < size[own][:, None]] = np.frombuffer(joined, np.uint32)
        yield own, codes, size[own]
        k += len(own)


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts; for each word in place its text's number and word's number; letters by text."""
    found = wh.words(data, offsets, _TABLE, gaps=_GAPS)
    _, first, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
    words = [data[s:e].tobytes().decode(errors="replace").lower() for s, e in zip(found.start[first].tolist(), found.end[first].tolist(), strict=True)]
    doc = found.doc()
    letters = np.zeros(len(offsets) - 1, bool)
    has = np.fromiter((any(map(str.isalpha, w)) for w in words), bool, len(words))
    letters[doc[has[inverse]]] = True
    return [MARK + w for w in words], doc, inverse, letters


def _counted(batches: Iterator[pa.RecordBatch], model: object, p: object, first: int) -> Iterator[pa.RecordBatch]:
    """Expected counts of pieces by language of the block that begins at first, over the training texts of a partition."""
    pieces, prob = worker_pieces(model.value), p.value
    counts = np.zeros((prob.shape[1], len(pieces.texts) + 1))
    for batch in batches:
        data, offsets = wh.text_buffer(batch.column("text"))
        lang = np.array(batch.column("place").to_pylist(), np.int64) - first
        for i, j in wh.chunks(offsets):
            units, doc, unit, _ = _distinct(data, offsets[i : j + 1])
            for c in np.unique(lang[i:j]):
                own = np.bincount(unit[lang[i:j][doc] == c], minlength=len(units))
                used = np.flatnonzero(own)
                _expected(pieces, [units[k] for k in used.tolist()], prob, int(c), own[used].astype(float), counts[c])
    rows, ids = np.nonzero(counts[:, :-1] > 1e-9)
    yield pa.RecordBatch.from_arrays([pa.array((rows + first).astype(np.int32)), pa.array(ids.astype(np.int32)), pa.array(counts[rows, ids])], names=["lang", "piece", "n"])


def _block(sent: object, alone: bool) -> np.ndarray:
    """A block's probabilities; one of several is read again each time, so that a worker holds one."""
    return sent.value if alone or not getattr(sent, "_path", None) else sent.load_from_path(sent._path)


def _predicted(batches: Iterator[pa.RecordBatch], model: object, blocks: list, langs: list[str], typical: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    pieces = worker_pieces(model.value)
    for batch in batches:
        data, offsets = wh.text_buffer(batch.column("text"))
        for i, j in wh.chunks(offsets):
            score, pred, fit = np.zeros(j - i), np.full(j - i, -1), np.full(j - i, np.nan)
            units, doc, unit, letters = _distinct(data, offsets[i : j + 1])
            if langs and units:
                best, most, odds = np.zeros(j - i, np.int64), np.full(j - i, -np.inf), np.zeros(j - i)
                base = 0
                for sent in blocks:
                    prob = _block(sent, len(blocks) == 1)
                    log = _log_probability(pieces, units, prob)
                    total = np.stack([np.bincount(doc, weights=log[unit, c], minlength=j - i) for c in range(prob.shape[1])], axis=1)
                    top = total.max(axis=1)
                    best = np.where(top > most, base + total.argmax(axis=1), best)
                    higher = np.maximum(most, top)
                    odds = odds * np.exp(most - higher) + np.exp(total - higher[:, None]).sum(axis=1)
                    most, base = higher, base + prob.shape[1]
                pred[letters] = best[letters]
                score[letters] = (1.0 / odds)[letters]
                size = np.maximum(np.bincount(doc, weights=np.fromiter(map(len, units), float, len(units))[unit], minlength=j - i), 1)
                per = most / size
                if typical is not None:
                    middle, spread = typical[best].T
                    per = (per - middle) / (spread * np.sqrt(1 + SHORT / size))
                fit[letters] = per[letters]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([langs[k] if k >= 0 else "und" for k in pred], pa.string()), pa.array(score), pa.array(fit, from_pandas=True)], names=["doc_id", "lang_pred", "score", "fit"])


def held_out(doc_id: object = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class LanguageModel:
    """Piece probabilities by language, on the driver and broadcast."""

    def __init__(self, spark: SparkSession, vocabulary: str | None = None) -> None:
        prepare(spark)
        with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
            model = f.read()
        self.spark, self.pieces, self.model = spark, Pieces(model), spark.sparkContext.broadcast(model)
        self.langs: list[str] = []
        self.blocks: list = []
        self.typical = np.zeros((0, 2))

    def fit(self, rows: DataFrame, sample: int = SAMPLE) -> LanguageModel:
        """rows (key, text, lang): about sample rows of each language are read, chosen by their key's hash."""
        rows = rows.where("text is not null and lang is not null")
        seen = rows.groupBy("lang").count().collect()
        self.langs = sorted(r[0] for r in seen)
        if not seen:
            return self
        place = {x: k for k, x in enumerate(self.langs)}
        shares = self.spark.createDataFrame([(x, place[x], min(1.0, sample / n)) for x, n in seen], "lang string, place int, share double")
        met = rows.select("key", "text", "lang").join(F.broadcast(shares), "lang")
        chosen = met.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.col("share") * float(1 << 40)).select("text", "place").repartition(12).cache()
        n, starts = len(self.pieces.texts), range(0, len(self.langs), BLOCK)
        size = np.fromiter(map(len, self.pieces.texts), np.int64, n)
        first = (0.02 ** np.minimum(size, 8))[:, None]
        sent = [self._send(np.tile(first, (1, min(BLOCK, len(self.langs) - k)))) for k in starts]
        for _ in range(ROUNDS):
            found, share_all = [], np.zeros((n, 1))
            for k, p in zip(starts, sent, strict=True):
                own = chosen if len(sent) == 1 else chosen.where(F.col("place").between(k, k + BLOCK - 1))
                how = partial(_counted, model=self.model, p=p, first=k)
                found.append(own.mapInArrow(how, "place int, piece int, n double").groupBy("place", "piece").agg(F.sum("n").alias("n")).toPandas())
                counts = self._counts(found[-1], k)
                share_all += (counts / np.maximum(counts.sum(axis=0), 1)).sum(axis=1, keepdims=True)
                p.destroy()
            share_all = share_all / len(self.langs) + 1.0 / n / 100
            sent = [self._send(self._counts(f, k) + SMOOTH * share_all / share_all.sum()) for k, f in zip(starts, found, strict=True)]
        self.blocks = sent
        own = chosen.select(F.col("place").alias("doc_id"), "text").mapInArrow(self._how(None), "doc_id int, lang_pred string, score double, fit double")
        every = own.where("fit is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list("fit")).alias("x"))
        middle = lambda x: F.get(x, F.floor(F.size(x) / 2).cast("int"))
        every = every.withColumn("m", middle(F.col("x"))).withColumn("d", F.array_sort(F.transform("x", lambda v: F.abs(v - F.col("m")))))
        self.typical = np.tile([0.0, 1.0], (len(self.langs), 1))
        for place, m, d in every.select("doc_id", "m", middle(F.col("d"))).collect():
            self.typical[place] = m, max(1.4826 * d, LEAST_SPREAD)
        chosen.unpersist()
        return self

    def _how(self, typical: np.ndarray | None) -> Callable:
        return partial(_predicted, model=self.model, blocks=self.blocks, langs=self.langs, typical=typical)

    def _counts(self, found: object, first: int) -> np.ndarray:
        counts = np.zeros((len(self.pieces.texts), min(BLOCK, len(self.langs) - first)))
        counts[found["piece"], found["place"] - first] = found["n"]
        return counts

    def _send(self, p: np.ndarray) -> object:
        """A block's probabilities, with a row of zeros for no piece."""
        return self.spark.sparkContext.broadcast(np.vstack([p / p.sum(axis=0), np.zeros((1, p.shape[1]))]))

    def predict(self, docs: DataFrame) -> DataFrame:
        """documents (doc_id, text) -> (doc_id, lang_pred, score, fit), one row per input row."""
        return docs.select("doc_id", "text").mapInArrow(self._how(self.typical), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, fit double")


def trained_on(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """The model learned from the rows of docs (doc_id, text, lang) that are not held out."""
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key"), "text", "lang")
    return LanguageModel(docs.sparkSession).fit(rows, sample)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return trained_on(docs).predict(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
