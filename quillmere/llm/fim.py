"""Fill-in-the-middle: texts cut at two seeded token ranks and put out in another order of their pieces.

A token is white space with the word after it, or white space at the end of a text. A text is decoded to
a UTF-32 array of code points; neighbouring classes (white space or not) are compared, SLICE at a time,
and flatnonzero gives the token ends, over the whole text. Two ranks drawn by the id's
hash choose the ends of prefix and middle; the pieces are sliced from the code points and encoded
again. Texts are read once, by Arrow batches, and nothing is exchanged.

A text stays plain if it is empty, holds one of the marks, or is not drawn (rate in 100). Of the others,
spm_rate in 100 have the suffix first. Marks must not overlap (no end of one begins another), so that
`restored` finds each of them again and rebuilds the exact text.

Defined cases: a null text counts as empty; a null id is drawn as "null". Rows are independent: repeated
ids draw alike, and equal texts under other ids differ. Other columns pass through; columns named as
the results are replaced. Memory is that of a batch of texts, and of one text's code points and token ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_prefix, prepare, table

SLICE = 1 << 20
RESULT = "n long, form string, prefix_chars long, middle_chars long, fim_text string"


class Marks(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def check(self) -> None:
        """Marks that could be found at a place where none was put are refused."""
        meet = any(a[-k:] == b[:k] for a in self for b in self for k in range(1, min(len(a), len(b)) + (a != b)))
        if not all(self) or len(set(self)) < 3 or meet or any(a in b for a in self for b in self if a != b):
            raise ValueError(f"marks must be non-empty, distinct and without overlap: {tuple(self)}")


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def encoded(pieces: list[np.ndarray]) -> str:
    return np.concatenate(pieces).tobytes().decode("utf-32-le", "surrogatepass")


def token_ends(chars: np.ndarray, size: int = SLICE) -> np.ndarray:
    """The position after each token, over all code points, size of them at a time."""
    found, last = [np.zeros(0, np.int64)], True
    for at in range(0, len(chars), size):
        p = chars[at : at + size]
        space = (p == 32) | ((p >= 9) & (p <= 13))
        before = np.concatenate([[last], space[:-1]])
        found.append(np.flatnonzero(space & ~before) + at)  # white space begins where a word ends
        last = bool(space[-1])
    if len(chars):
        found.append(np.array([len(chars)]))
    return np.concatenate(found)


def draws(key: object, seed: int) -> list[int]:
    """Four unsigned integers of an id."""
    digest = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(key: object, text: str | None, seed: int, rate: int, spm_rate: int, marks: Marks) -> tuple:
    """(tokens, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    chars = points(text)
    ends = token_ends(chars)
    n = len(ends)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = [points(marks.prefix), chars[:a]], [points(marks.middle), chars[a:b]], [points(marks.suffix), chars[b:]]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, encoded(suffix + prefix + middle)
    return n, "psm", a, b - a, encoded(prefix + suffix + middle)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: Marks = Marks()) -> DataFrame:
    """docs plus n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and fim_text."""
    marks = Marks(*marks)
    marks.check()
    prepare(docs.sparkSession)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for keys, texts in batches:
            rows = [transform(k.as_py(), t.as_py(), seed, rate, spm_rate, marks) for k, t in zip(keys, texts, strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    made = free_prefix(docs) + "_fim"
    out = docs.withColumn(made, F.arrow_udf(run, RESULT)(F.col(key), F.col(text)))
    return out.withColumns({c.split()[0]: F.col(f"{made}.{c.split()[0]}") for c in RESULT.split(", ")}).drop(made)


def restored(fim_text: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The exact text, from an output and its form alone."""
    part = lambda x, mark, k: F.split_part(x, F.lit(mark), F.lit(k))
    first, second = part(fim_text, marks.middle, 1), part(fim_text, marks.middle, 2)
    psm = F.concat(part(part(first, marks.prefix, 2), marks.suffix, 1), second, part(first, marks.suffix, 2))
    spm = F.concat(part(first, marks.prefix, 2), second, part(part(first, marks.suffix, 2), marks.prefix, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(fim_text)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("fim_text")).alias("output_sha256"), sha(restored(F.col("fim_text"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), numbers AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM drawn
), cuts AS (
  SELECT doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), pieces AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:low], ''), '') AS a, coalesce(array_to_string(units[low + 1:high], ''), '') AS b, coalesce(array_to_string(units[high + 1:], ''), '') AS c
  FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""
