"""Quality rules: plain counts of a text, and the fertility of a public tokeniser on it.

Each word of a text is encoded on its own with a public byte-fallback vocabulary (a word's pieces
never cross white space there). Measured per text: code points per token, tokens per word, share of
byte-fallback tokens, and entropy of the token distribution as a share of the most that so many tokens, ENTROPY_CAP
at most, could have. A text is kept if it passes the plain rules and lies within two kinds of bands:
fixed ones for its script (that of most letters, by UTF-8 lead bytes), and ones for its language,
around the median of all texts of that language, some robust standard deviations wide (from
histograms over all texts with tokens) and wider for short texts, by the square root of 1 + SHORT /
tokens. A language's half-width is wider by SHRINK / texts of the learned one, so a band comes on smoothly as
a language's texts grow: no number of texts or tokens switches one on.

Texts are read once, map-side; the measures, a hundred bytes a text, go to a table in the shared
folder, and counts by language and histogram bin are all that is exchanged and reaches the driver
(BINS equal bins a measure and language, and beyond them bins that widen by 1 / BINS of the value, so
that no value is cut: some BINS more for each factor of e). The vocabulary's file is read on the driver and broadcast (its
size is fixed). Words are encoded once for each chunk of rows, so memory is bounded by a chunk: a few
MB of text, or one longer text.

Bands are a row for each language, made and joined in Spark (broadcast while a count finds at most
BROADCAST_LANGUAGES); nothing of them reaches the driver.

Defined cases: null and white-space texts have no words, so base_failed is true and kept false, with
measures null. A null language is one of its own, apart from the empty string. Repeated ids and other
columns change nothing. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wordhash as wh
from .shared import prepare, table, written

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
ENTROPY_CAP, SHORT, SHRINK, BINS, BROADCAST_LANGUAGES = 512, 300, 100.0, 2000, 100_000
#: Per script: least and most code points per token, most byte-fallback share, least and most entropy share.
BANDS: dict[str, tuple[float, float, float, float, float]] = {
    "latin": (1.35, 6.5, 0.05, 0.45, 1.0),
    "cyrillic": (1.0, 6.0, 0.10, 0.45, 1.0),
    "greek": (0.8, 5.0, 0.20, 0.40, 1.0),
    "cjk": (0.4, 3.0, 0.60, 0.35, 1.0),
    "other": (0.3, 6.0, 0.80, 0.35, 1.0),
}
#: Measures with a band by language: the width of a histogram bin, the half-width of the band in robust
#: standard deviations, and its least half-width.
LEARNED = {"chars_per_token": (0.005, 6.0, 0.1), "tokens_per_word": (0.005, 6.0, 0.25), "entropy_share": (0.001, 4.0, 0.05)}
_TABLE = wh.byte_table(505, fold=False)
_SCRIPT = np.full(256, -1, np.int8)
for _range, _code in ((range(65, 91), 0), (range(97, 123), 0), (range(0xC3, 0xCB), 0), (range(0xD0, 0xD5), 1), (range(0xCD, 0xD0), 2), (range(0xE3, 0xEE), 3), (range(0xD5, 0xE3), 4), (range(0xEE, 0xF5), 4)):
    _SCRIPT[list(_range)] = _code
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_OUT = "doc_id {}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, in_script boolean, script string, n_tokens long, chars_per_token double, tokens_per_word double, byte_share double, entropy_share double"


class Encoder:
    """Token ids of words; byte-fallback ids are those of the vocabulary's byte pieces."""

    def __init__(self, model: bytes) -> None:
        self.model = model
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, counts)."""
        ids = self.sp.encode(words, num_threads=1)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for row in ids for x in row), np.int64, int(counts.sum()))
        return flat, counts


_worker: list[Encoder] = []


def worker_encoder(model: bytes) -> Encoder:
    if not _worker or _worker[0].model != model:
        _worker[:] = [Encoder(model)]
    return _worker[0]


def _by_text(values: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offset])


def repeated_words(found: wh.Words, size: int) -> np.ndarray:
    """Per text, its words inside a window of size words that it holds at least twice."""
    win, ok = wh.windows(found.hash, size), wh.window_starts(found.offset, size)
    at = np.flatnonzero(ok)
    doc, win = found.doc()[at], win[at]
    order = np.lexsort((win, doc))
    same = (win[order][1:] == win[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(found.hash) + 1, np.int32)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + size, -1)
    return _by_text(np.cumsum(change[:-1]) > 0, found.offset)


def repeated_lines(text: str | None) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def token_measures(data: np.ndarray, found: wh.Words, encoder: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: tokens, byte-fallback tokens, entropy in bits."""
    n_docs = len(found.offset) - 1
    _, first, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
    raw = data.tobytes() if len(first) else b""
    flat, counts = encoder.encode([raw[s:e].decode(errors="replace") for s, e in zip(found.start[first].tolist(), found.end[first].tolist(), strict=True)])
    begin = np.cumsum(counts) - counts
    n_bytes = _by_text(encoder.is_byte[flat], np.append(begin, len(flat))) if len(flat) else np.zeros(len(counts), np.int64)
    tokens, fallback = _by_text(counts[inverse], found.offset), _by_text(n_bytes[inverse], found.offset)
    entropy = np.zeros(n_docs)
    each = counts[inverse]
    at = np.repeat(begin[inverse] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    key = np.repeat(found.doc(), each) * len(encoder.is_byte) + flat[at]
    key.sort()
    if len(key):
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        c = np.diff(np.append(edge, len(key))).astype(float)
        part = np.bincount(key[edge] // len(encoder.is_byte), weights=c * np.log2(c), minlength=n_docs)
        has = tokens > 0
        entropy[has] = np.log2(tokens[has]) - part[has] / tokens[has]
    return tokens, fallback, entropy


def _rules(batches: Iterator[pa.RecordBatch], model: object, bands: dict) -> Iterator[pa.RecordBatch]:
    encoder = worker_encoder(model.value)
    names = list(BANDS)
    limits = np.array([bands[n] for n in names])
    for batch in batches:
        data, offsets = wh.text_buffer(batch.column("text"))
        for i, j in wh.chunks(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            found = wh.words(part, own, _TABLE)
            n_words = found.counts.astype(np.int64)
            chars = _by_text(((part & 0xC0) != 0x80) & ~wh.SPACE[part], own)
            repeat = repeated_words(found, REPEAT_WINDOW)
            lines = np.fromiter((repeated_lines(t.as_py()) for t in batch.column("text").slice(i, j - i)), np.int64, j - i)
            code = _SCRIPT[part]
            script = np.stack([_by_text(code == c, own) for c in range(len(names))]).argmax(axis=0)
            tokens, fallback, entropy = token_measures(part, found, encoder)
            some = tokens > 0
            per = np.divide(chars, tokens, out=np.zeros(j - i), where=some)
            share = np.divide(fallback, tokens, out=np.zeros(j - i), where=some)
            ratio = np.divide(entropy, np.log2(np.clip(tokens, 2, ENTROPY_CAP)), out=np.zeros(j - i), where=some)
            failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
            lim = limits[script]
            wide = np.sqrt(1 + SHORT / np.maximum(tokens, 1))
            good = (per >= lim[:, 0]) & (per <= lim[:, 1]) & (share <= lim[:, 2] * wide) & (ratio >= 1 - (1 - lim[:, 3]) * wide) & (ratio <= lim[:, 4])
            measures = [pa.array(x, mask=~some) for x in (per, tokens / np.maximum(n_words, 1), share, ratio)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), batch.column("lang").slice(i, j - i), *map(pa.array, (n_words, chars, _by_text(_SYMBOL[part], own), lines, repeat, failed, good)), pa.array([names[k] if s else None for k, s in zip(script, some, strict=True)], pa.string()), pa.array(tokens), *measures],
                names=[x.split()[0] for x in _OUT.split(", ")],
            )


def _bin(value: F.Column, width: float) -> F.Column:
    """Number of a value's bin: BINS of one width, then of the same share of the value without end."""
    top = BINS * width
    return F.when(value < top, F.floor(value / width)).otherwise(BINS + F.floor(BINS * F.log(value / top))).cast("int")


def _middle(b: F.Column, width: float) -> F.Column:
    inside = F.lit(BINS * width) * F.exp((b - BINS + 0.5) / BINS)
    return F.when(b < BINS, (b + 0.5) * width).otherwise(inside)


def language_bands(measured: DataFrame) -> DataFrame:
    """(band_lang, then centre and half-width of each learned measure), from histograms over all texts."""
    some = measured.where(F.col("n_tokens") > 0)
    cells = [F.struct(F.lit(name).alias("name"), _bin(F.col(name), width).alias("b")) for name, (width, _, _) in LEARNED.items()]
    counts = some.select("lang", F.explode(F.array(*cells)).alias("x")).groupBy("lang", "x.name", "x.b").agg(F.count("*").alias("n"))
    pick = lambda values: F.coalesce(*(F.when(F.col("name") == name, F.lit(v)) for name, v in values.items()))
    width, spread, least = (pick({name: v[k] for name, v in LEARNED.items()}) for k in range(3))
    every = Window.partitionBy("lang", "name")

    rows = counts.withColumn("x", _middle(F.col("b"), width)).withColumn("texts", F.sum("n").over(every))
    for value, out in (("x", "middle"), ("away", "deviation")):
        if value == "away":
            rows = rows.withColumn("away", F.abs(F.col("x") - F.col("middle")))
        rows = rows.withColumn("up", F.sum("n").over(every.orderBy(value)))
        rows = rows.withColumn(out, F.min(F.when(2 * F.col("up") >= F.col("texts"), F.col(value))).over(every))
    learned = F.greatest(spread * 1.4826 * F.col("deviation"), least) * (1 + F.lit(SHRINK) / F.col("texts"))
    rows = rows.select("lang", "name", "middle", learned.alias("half"))
    told = [F.max(F.when(F.col("name") == name, F.col(c))).alias(f"{name}_{e}") for name in LEARNED for c, e in (("middle", "mid"), ("half", "half"))]
    return rows.groupBy(F.col("lang").alias("band_lang")).agg(*told)


def quality_rules(docs: DataFrame, vocabulary: str | None = None, bands: dict | None = None) -> DataFrame:
    """documents (doc_id, text, lang) -> a row per document with the counts, the measures and the verdict."""
    spark = docs.sparkSession
    prepare(spark)
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    measured = written(docs.select("doc_id", "text", "lang").mapInArrow(partial(_rules, model=model, bands=bands or BANDS), _OUT.format(dict(docs.dtypes)["doc_id"])), "measures")
    learned = written(language_bands(measured), "bands")
    learned = F.broadcast(learned) if learned.count() <= BROADCAST_LANGUAGES else learned
    met = measured.join(learned, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    near = F.lit(True)
    for name in LEARNED:
        near = near & F.coalesce(F.abs(F.col(name) - F.col(f"{name}_mid")) <= F.col(f"{name}_half") * F.sqrt(1 + SHORT / F.greatest(F.col("n_tokens"), F.lit(1))), F.lit(True))
    kept = ~F.col("base_failed") & F.col("in_script") & near
    counts = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return met.select(*counts, kept.alias("kept"), "script", "n_tokens", "chars_per_token", "tokens_per_word", "byte_share", "entropy_share")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
