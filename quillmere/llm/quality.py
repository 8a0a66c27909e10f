"""Quality classifier: ridge regression on random Fourier features of document statistics.

Cosines of random projections approximate a Gaussian kernel over standardised statistics of a text.
Each partition sums its share of the normal equations (features x features, whatever its rows); the
sums meet row by row of the matrix, so no task gathers whole matrices, and the driver solves one
system of WIDTH + 1 unknowns. Raw scores become probabilities by isotonic calibration: labels are
counted in BINS score bins, and adjacent violators are pooled over those bins.

Texts are read once: statistics go to a table in the shared folder (a few dozen floats a text), and
training and scoring use that table. All labelled rows that are not held out are learned from.

Defined cases: null, empty or word-less texts have all statistics 0 and get a score. Several labels
of one doc_id count as their mean; null labels and null doc_ids are not learned from (a null doc_id is
not held out). Without labels every score is 0.5. Repeated ids are scored each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .fertility import _by_text, repeated_lines, repeated_words
from .shared import prepare, table, written

WIDTH, RIDGE, SCALE, BINS, FOLDS, CUT = 256, 1e-3, 0.5, 2000, 5, 0.3
_TABLE = wh.byte_table(1010, fold=True)
STATISTICS = (
    "log_words", "word_length", "word_spread", "symbols", "bars", "dup_lines", "repeat_words", "repeat_pairs", "distinct", "top_word",
    "upper", "digits", "stops", "commas", "other_marks", "non_ascii", "log_line", "long_words", "short_words", "byte_entropy",
)


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_FLAGS = [_flag(x) for x in (b"#*$%&<>", b"|", bytes(range(65, 91)), b"0123456789", b".!?", b",;:", b"\"'()[]{}/\\@=_~^`+-", bytes(range(128, 256)))]


def statistics(data: np.ndarray, offsets: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    found = wh.words(data, offsets, _TABLE)
    n = found.counts.astype(float)
    some = np.maximum(n, 1)
    size = (found.end - found.start).astype(np.int64)
    chars = np.maximum(np.diff(offsets), 1).astype(float)
    flags = [_by_text(f[data], offsets) for f in _FLAGS]
    doc = found.doc()
    order = np.lexsort((found.hash, doc))
    d, h = doc[order], found.hash[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    often = np.diff(np.append(at, len(h)))
    top = np.zeros(len(n))
    np.maximum.at(top, d[at], often)
    mean = _by_text(size, found.offset) / some
    spread = np.sqrt(np.maximum(_by_text(size * size, found.offset) / some - mean * mean, 0))
    lines = np.array([(t or "").count("\n") + 1 for t in texts], float)
    entropy = np.zeros(len(n))
    for k, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if e > s:
            c = np.bincount(data[s:e], minlength=256)
            c = c[c > 0] / (e - s)
            entropy[k] = -(c * np.log2(c)).sum()
    symbols, bars, upper, digits, stops, commas, marks, high = (f / chars for f in flags)
    columns = [
        np.log1p(n), mean, spread, symbols, bars, [repeated_lines(t) for t in texts] / lines, repeated_words(found, 8) / some, repeated_words(found, 3) / some, np.bincount(d[at], minlength=len(n)) / some, top / some,
        upper, digits, stops, commas, marks, high, np.log1p(chars / lines), _by_text(size > 12, found.offset) / some, _by_text(size <= 3, found.offset) / some, entropy,
    ]
    out = np.stack([np.asarray(c, np.float32) for c in columns], axis=1)
    out[n == 0] = 0
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = wh.text_buffer(batch.column("text"))
        for i, j in wh.chunks(offsets):
            x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], batch.column("text").slice(i, j - i).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, len(STATISTICS)).astype(float)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, len(STATISTICS)))
    for batch in batches:
        x = _matrix(batch)
        total += [np.full(x.shape[1], len(x)), x.sum(axis=0), (x * x).sum(axis=0)]
    k = np.arange(len(STATISTICS))
    yield pa.RecordBatch.from_arrays([pa.array(k), *map(pa.array, total)], names=["k", "n", "s", "q"])


def _features(x: np.ndarray, centre: np.ndarray, width: np.ndarray, seed: int = 10) -> np.ndarray:
    """Random Fourier features of the standardised statistics, and a constant."""
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(size=(x.shape[1], WIDTH)) * SCALE / np.sqrt(2), rng.uniform(0, 2 * np.pi, WIDTH)
    z = np.clip((x - centre) / width, -6, 6)
    return np.hstack([np.sqrt(2 / WIDTH) * np.cos(z @ omega + phase), np.ones((len(x), 1))])


def _equations(batches: Iterator[pa.RecordBatch], scaling: tuple) -> Iterator[pa.RecordBatch]:
    """A partition's sums: for each row of the matrix, its products with all features and with the label."""
    total = np.zeros((WIDTH + 1, WIDTH + 2))
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            z = _features(_matrix(part), *scaling)
            y = part.column("y").to_numpy(zero_copy_only=False)
            total += z.T @ np.hstack([z, y[:, None]])
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1)), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the rows of equal i; the input is sorted by i."""
    held, total = None, None
    for batch in batches:
        for i, sums in zip(batch.column("i").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            if i != held:
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([total.tobytes()], pa.binary())], names=["i", "sums"])
                held, total = i, np.zeros(WIDTH + 2)
            total = total + np.frombuffer(sums)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([total.tobytes()], pa.binary())], names=["i", "sums"])


def _raw(x: np.ndarray, scaling: tuple, beta: np.ndarray) -> np.ndarray:
    return _features(x, *scaling) @ beta


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def _binned(batches: Iterator[pa.RecordBatch], scaling: tuple, beta: np.ndarray) -> Iterator[pa.RecordBatch]:
    n, s = np.zeros(BINS), np.zeros(BINS)
    for batch in batches:
        b = _bin(_raw(_matrix(batch), scaling, beta))
        n += np.bincount(b, minlength=BINS)
        s += np.bincount(b, weights=batch.column("y").to_numpy(zero_copy_only=False), minlength=BINS)
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(s[used])], names=["bin", "n", "s"])


def isotonic(bins: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: (block centres, non-decreasing rates)."""
    blocks: list[list[float]] = []
    for b, c, t in zip(bins, n, s, strict=True):
        blocks.append([b * c, c, t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    done = np.array(blocks)
    return done[:, 0] / done[:, 1], done[:, 2] / done[:, 1]


def _scored(batches: Iterator[pa.RecordBatch], scaling: tuple, beta: np.ndarray | None, curve: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.full(batch.num_rows, 0.5)
        if beta is not None and batch.num_rows:
            score = np.interp((_raw(_matrix(batch), scaling, beta) + 0.5) / 2 * BINS, *curve)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(score, 0, 1))], names=["doc_id", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents (doc_id, text), labels (doc_id, y) -> (doc_id, score), one row per document; learns from all labels given."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    measured = written(docs.select("doc_id", "text").mapInArrow(_measured, f"doc_id {kind}, x binary"), "statistics")
    m = measured.mapInArrow(_moments, "k long, n double, s double, q double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).toPandas().sort_values("k")
    scaling, beta, curve = None, None, None
    if len(m) and m["n"].iloc[0]:
        mean = (m["s"] / m["n"]).to_numpy()
        scaling = (mean, np.sqrt(np.maximum((m["q"] / m["n"]).to_numpy() - mean**2, 1e-9)))
        labels = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.avg("y").cast("double").alias("y"))
        rows = measured.join(labels, "doc_id").select("x", "y")
        sums = rows.mapInArrow(partial(_equations, scaling=scaling), "i long, sums binary")
        sums = sums.repartition(min(32, WIDTH), "i").sortWithinPartitions("i").mapInArrow(_added, "i long, sums binary").toPandas().sort_values("i")
        if len(sums):
            a = np.stack([np.frombuffer(x) for x in sums["sums"]])
            beta = np.linalg.solve(a[:, :-1] + RIDGE * np.eye(WIDTH + 1), a[:, -1])
            b = rows.mapInArrow(partial(_binned, scaling=scaling, beta=beta), "bin long, n double, s double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas().sort_values("bin")
            curve = isotonic(b["bin"].to_numpy() + 0.5, b["n"].to_numpy(), b["s"].to_numpy())
    return measured.mapInArrow(partial(_scored, scaling=scaling, beta=beta, curve=curve), f"doc_id {kind}, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    scores = quality_scores(docs, labels.where(~out).select("doc_id", F.col("quality").alias("y")))
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
